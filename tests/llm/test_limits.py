"""Inputs that once ended a job: long runs of digits, many long words, clashing names and empty tables in the pipeline."""
import random
import re

import public_tokenizers
import pytest
import tiktoken
from tiktoken.load import load_tiktoken_bpe

import corpus_pipeline
from rankspark.llm import bpe, pii

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_long_runs_of_digits():
    zeros = "0" * 5000
    plain = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    for text in (f"{zeros}.1.2.3", f"x {zeros}1.{zeros}2.003.255 y", f"{'9' * 5000}.1.2.3 and 1.2.3.4", zeros):
        want = [m.span() for m in plain.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split("."))]
        assert [(a, b) for kind, a, b, _ in pii.base(text) if kind == "ip"] == want


def test_many_long_words_and_runs():
    r = random.Random(1)
    words = ["".join(r.choices("abcdefgh", k=150)) for _ in range(7000)]
    library = tiktoken.Encoding("ranks", pat_str=bpe.PATTERN, mergeable_ranks=load_tiktoken_bpe(RANKS), special_tokens={})
    text = " ".join(words)
    ids, plain = bpe.Codec(bpe.read_ranks(RANKS)).texts([text])[0]
    assert ids == b"".join(i.to_bytes(4, "little") for i in library.encode_ordinary(text)) and plain == text.encode()
    runs = list(bpe._runs([w.encode() for w in words] + [b"x" * 10_000_000, b"y"]))
    assert max(sum(min(len(w), bpe.LONG_WORD) * len(w) for w in run) for run in runs if len(run) > 1) <= bpe.RUN_ROWS
    assert sum(map(len, runs)) == 7002


CLASH = "doc_id long, text string, lang string, source string, n_chars long, kept_id long, id string, n long, kept boolean, digest string"


def test_pipeline_stages_with_clashing_names_and_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    r = random.Random(3)
    long = " ".join(f"w{r.randrange(10**6)}" for _ in range(60_000))
    a = " ".join(f"v{r.randrange(400)}" for _ in range(60))
    rows = [(1, a), (2, a), (2, a), (3, long), (4, long + " more"), (None, "only null id"), (None, "only null id"), (5, "twice"), (5, "twice"), (6, None), (7, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 1, 9, "x", 8, False, "d") for i, t in rows], CLASH)
    got = corpus_pipeline.near_dedup(spark, df, str(tmp_path))
    assert got.columns == df.columns
    assert sorted((x.doc_id or -1, len(x.text or "")) for x in got.collect()) == sorted(
        [(1, len(a)), (3, len(long)), (-1, 12), (5, 5), (6, 0), (7, 0)])
    for _, stage in corpus_pipeline.STAGES[2:]:
        assert stage(spark, df, str(tmp_path)).count() == len(rows)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0


def test_a_process_keeps_its_codec_and_learned_words(monkeypatch):
    ranks = bpe.read_ranks(RANKS)
    first = bpe.own_codec(("a", bpe.PATTERN), lambda: ranks, bpe.PATTERN)
    want = first.texts(["some words, some words.", "words! "])
    assert bpe.own_codec(("a", bpe.PATTERN), lambda: pytest.fail("read again"), bpe.PATTERN) is first
    monkeypatch.setattr(bpe, "KEEP_UNITS", 1)
    monkeypatch.setattr(bpe, "KEEP_WORDS", 1)  # every lookup may drop the elder generation
    assert first.texts(["some words, some words.", "words! "]) == want
    monkeypatch.setattr(first, "words", lambda part: pytest.fail("learned again"))
    assert first.texts(["some words, some words."])[0] == want[0]
    assert bpe.own_codec(("b", bpe.PATTERN), lambda: ranks, bpe.PATTERN) is not first


def test_caches_of_any_size_give_the_library_s_ids(monkeypatch):
    library = tiktoken.Encoding("ranks", pat_str=bpe.PATTERN, mergeable_ranks=load_tiktoken_bpe(RANKS), special_tokens={})
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("etaoin", k=rng.randrange(1, 5))) + rng.choice(["", ",", "."]) for _ in range(rng.randrange(60))) for _ in range(80)]
    monkeypatch.setattr(bpe, "KEEP_UNITS", 20)
    monkeypatch.setattr(bpe, "KEEP_WORDS", 7)
    codec = bpe.Codec(bpe.read_ranks(RANKS))
    for i in range(0, 80, 4):
        for text, (ids, plain) in zip(texts[i:i + 4], codec.texts(texts[i:i + 4]), strict=True):
            assert ids == b"".join(x.to_bytes(4, "little") for x in library.encode_ordinary(text)) and plain.decode() == text
