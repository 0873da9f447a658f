"""Operators of the optional part against brute force, round trips and held-out data, and on odd inputs."""
import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from rankspark.llm import boosting, bpe, decontaminate, html, langid, licences, minhash, pii, tagger, topk, urls, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, component long, bucket string, key long"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "b", 2) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, a null id, repeated rows, a repeated id, a very long text; columns that clash with internal names."""
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, "a b c d e f g"), (6, "a b c d e f g"), (7, "a b c d e f g"),
            (7, "x y z"), (None, "a b c d e f g"), (8, long), (9, long + " w"), (10, "12 34"), (11, "né été où"), (12, "a b c d e f g h i j k l m n o p q r s t u v x")]
    return docs(spark, rows), rows


@pytest.fixture(scope="module")
def empty(spark):
    return docs(spark, [])


def shingle_sets(rows, size):
    out = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append((i, frozenset(tuple(w[k:k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])))
    return out


def brute_components(rows, size, percent):
    sets = shingle_sets(rows, size)
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in sets:
        for j, b in sets:
            if a and b and i < j and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets}


def near_copies(seed, n=60):
    r = random.Random(seed)
    base = [f"w{r.randrange(400)}" for _ in range(90)]
    rows = []
    for i in range(n):
        w = list(base) if i % 3 else [f"v{r.randrange(400)}" for _ in range(60)]
        for _ in range(r.randrange(7)):
            w[r.randrange(len(w))] = f"e{r.randrange(30)}"
        rows.append((i, " ".join(w)))
    return rows + [(1000 + i, t) for i, t in rows[::4]]


@pytest.mark.parametrize(("size", "percent", "seed"), [(3, 85, 1), (5, 80, 2)])
def test_near_duplicates_equal_brute_force(spark, size, percent, seed):
    rows = near_copies(seed)
    got = minhash.near_duplicates(docs(spark, rows), size=size, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute_components(rows, size, percent)


def test_open_pairs_lose_no_link(spark):
    """Copies around a least document that is itself far from most of them: links exist only between the others."""
    r = random.Random(5)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(40):
        w = list(base)
        for k in r.sample(range(0, 100, 4), 7 if i == 0 else r.randrange(6)):
            w[k] = f"x{i}_{k}"
        rows.append((i, " ".join(w)))
    got = minhash.near_duplicates(docs(spark, rows), size=3, percent=85).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in got} == brute_components(rows, 3, 85)


def test_near_duplicates_on_odd_rows(spark, odd, empty):
    df, rows = odd
    got = minhash.near_duplicates(df, size=3, percent=85)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    out = got.collect()
    assert len(out) == len(rows)
    by = defaultdict(list)
    for r in out:
        by[r.doc_id].append((r.n_shingles, r.component_id, r.kept))
    assert by[1] == by[2][:0] + [(0, 1, True)] and by[3] == [(0, 3, True)] and by[5] == [(1, 5, True)]
    assert by[None] == [(5, None, True)] and by[6] == [(5, None, False)] * 2  # the null id comes first
    assert by[9][0][1] == 8
    assert minhash.near_duplicates(empty).count() == 0


def test_sketch_fills_every_bin_and_estimates_similarity():
    r = np.random.default_rng(3)
    for n in (1, 2, 5, 50, 3000):
        assert minhash.sketch(r.integers(0, 1 << 63, n).astype(np.uint64)).max() < np.iinfo(np.uint64).max
    shared, rest = r.integers(0, 1 << 63, 800).astype(np.uint64), r.integers(0, 1 << 63, 400).astype(np.uint64)
    a, b = np.concatenate([shared, rest[:200]]), np.concatenate([shared, rest[200:]])
    assert abs((minhash.sketch(a) == minhash.sketch(b)).mean() - 800 / 1200) < 0.15


def test_language(spark, odd, empty):
    r = random.Random(1)
    vocabulary = {"aa": "kata moro pilu tasa nemi".split(), "bb": "strix grund wolt zweik brunft".split(), "cc": "ção não ões lhe muito".split()}
    rows = [(i, " ".join(r.choices(vocabulary[x], k=r.randrange(5, 80))), x) for i in range(240) for x in [r.choice("abc") * 2]]
    mixed = " ".join(r.choices(vocabulary["aa"], k=96)) + " " + " ".join(r.choices(vocabulary["bb"], k=64))
    rows += [(900, mixed, None), (901, None, "aa"), (902, "12 ... 34", "aa"), (903, "", None), (None, "kata moro", "zz")]
    got = {x.doc_id: x for x in langid.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    held = [(x, got[x[0]]) for x in rows[:240] if got[x[0]].held_out]
    assert len(held) > 30 and all(x[2] == p.lang_pred for x, p in held)
    assert got[900].languages == ["aa", "bb"] and abs(got[900].score - 0.6) < 0.06
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (901, 902, 903))
    assert got[None].held_out is False and got[None].lang_pred == "aa"  # nothing is learned from a null id
    assert langid.predict(odd[0]).count() == len(odd[1]) and langid.predict(empty).count() == 0
    nothing = langid.predict(spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")).first()
    assert nothing.lang_pred == "und"


def test_texts_in_several_languages_are_not_rejected(spark):
    r = random.Random(9)
    sounds = {"aa": ("kmtpn", "aiou"), "bb": ("strgw", "eyu"), "cc": ("lfvdj", "oai"), "dd": ("bhzxq", "ueo")}
    words = {x: ["".join(r.choice(part) for _ in range(r.randrange(2, 5)) for part in parts) for _ in range(400)] for x, parts in sounds.items()}

    def text(x, n):
        return " ".join(r.choices(words[x], k=n))
    rows = [(i, text(x, 60), x) for i in range(400) for x in [r.choice("abcd") * 2]]
    mixes = [(n, k, " ".join(text(x, n) for x in list(words)[:k])) for n in (20, 150, 500, 3000) for k in (2, 3, 4)]
    mixes += [(n, k, " ".join(r.choice(words[x]) for _ in range(n) for x in list(words)[:k])) for n in (150, 3000) for k in (2, 4)]
    rows += [(1000 + i, t, None) for i, (_, _, t) in enumerate(mixes)]
    junk = " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(500))
    rows += [(2000, junk, None), (2001, junk + " " + text("aa", 100), None), (2002, text("aa", 2000) + " " + junk, None)]
    got = {x.doc_id: x for x in langid.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [x for i, x in enumerate(mixes) if got[1000 + i].rejected] == []
    assert (got[2000].rejected, got[2001].rejected, got[2002].rejected) == (True, True, False)
    assert not any(got[i].rejected for i in range(400))


@pytest.fixture(scope="module")
def known():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_bpe_equals_the_library(known):
    codec = bpe.Codec(bpe.read_ranks(RANKS))
    r = random.Random(1)
    texts = ["", "  hello   world \n\n x  ", "it's we'll", " a", "b ", "a  b", "\t\ttabs \t x", "a" * 1500, "=" * 999, "日本語 テキスト", "🙂🙂 🙂", "\r\n a \r\n",
             "<|endoftext|> hi", "ab" * 400, "a\u3000b \u2009c", "x" * 159 + " " + "y" * 161]
    texts += ["".join(r.choice("ab \n\t'sé1.!\xa0") for _ in range(r.randrange(80))) for _ in range(300)]
    texts += ["".join(r.choice("abcdefghinoraeiou") for _ in range(500)) for _ in range(3)]
    for t, (ids, plain) in zip(texts, codec.texts(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == known.encode_ordinary(t) and plain == t.encode()


def test_every_token_is_its_own_encoding():
    """The property that makes merging all pairs of least rank at once exact."""
    ranks = bpe.read_ranks(RANKS)
    some = list(ranks)[::7]
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.Codec(ranks).words(some)[0]] == [[ranks[t]] for t in some]


def test_bpe_caches_forget_without_loss(known, monkeypatch):
    monkeypatch.setattr(bpe, "KEEP_UNITS", 5)
    codec = bpe.Codec(bpe.read_ranks(RANKS))
    for k in range(6):
        t = " ".join(f"word{i % 9}{k}" for i in range(20)) + " the end"
        assert np.frombuffer(codec.texts([t])[0][0], "<u4").tolist() == known.encode_ordinary(t)


def test_bpe_on_odd_rows(spark, odd, empty, known):
    df, rows = odd
    got = bpe.encode(df, RANKS, digest=True).collect()
    want = Counter((i, hashlib.sha256(np.array(known.encode_ordinary(t or ""), "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert Counter((r.doc_id, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert bpe.encode(empty, RANKS).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "phone" and 9 <= len(d) <= 15 \
                    or kind == "card" and 13 <= len(d) <= 19 and pii.luhn(d):
                yield kind, m.start(), m.end(), True


def test_base_spans_equal_plain_matching():
    r = random.Random(2)
    texts = ["".join(r.choice("a1@.+- (25)_é") for _ in range(r.randrange(70))) for _ in range(4000)]
    texts += ["a.b@c.d.e_f@g.h", "0" * 50 + "1.2.3.4", "4539 1488 0343 6467 and 4539148803436467", "+1 (017) 555-7713", "x@y@z.w", "1" * 5000 + "@" + "a" * 5000]
    for t in texts:
        assert pii.base(t) == list(plain_spans(t)), t[:80]


@pytest.fixture(scope="module")
def personal():
    r = random.Random(4)

    def card():
        d = [r.randrange(10) for _ in range(15)]
        return next(x for x in ("".join(map(str, [*d, k])) for k in range(10)) if pii.luhn(x))
    words = "the of and to in is on by it or an be at as".split()
    return [f"{' '.join(r.choices(words, k=r.randrange(3, 9)))} {v} {' '.join(r.choices(words, k=r.randrange(3, 12)))}"
            for _ in range(120) for v in (f"{r.choice(words)}.{r.randrange(99)}@mail{r.randrange(9)}.example.com", ".".join(str(r.randrange(256)) for _ in range(4)),
                                         card(), f"+1 ({r.randrange(100, 999)}) 555-{r.randrange(1000, 9999)}")]


def test_tagger_learns_held_out_spellings(personal):
    model = tagger.train(*pii.examples(personal[:320]), len(pii.KINDS) + 1)
    windows, tags = pii.examples(personal[320:])
    got = model.decode(windows)
    assert (got == tags)[tags > 0].mean() > 0.97 and (got == tags).mean() > 0.97
    long = " ".join(["the of and"] * 40)
    text = f"{long} and.77 (at) mail3.example.com {long} 4539.1488.0343.6467 {long}"
    found = [(k, text[a:b]) for k, a, b, base in pii.find(model, [text])[0] if not base]
    assert ("email", "and.77 (at) mail3.example.com") in found and ("card", "4539.1488.0343.6467") in found
    assert pii.find(model, [long, "", "no data 2024 here"]) == [[], [], []]


def test_addresses_without_a_digit_are_found(personal):
    model = tagger.train(*pii.examples(personal[:320]), len(pii.KINDS) + 1)
    prose = " ".join(["the of and"] * 40)
    for address in ("jane.doe (at) example (dot) com", "jane at example dot com", "jane.doe [at] mail.example [dot] com", "as.the (at) example.com"):
        for shift in range(0, 120, 17):
            text = f"{prose} {'of ' * (shift // 3)}{address} {prose}"
            found = pii.find(model, [text])[0]
            assert [(k, text[a:b], own) for k, a, b, own in found] == [("email", address, False)], (address, shift, [text[a:b] for _, a, b, _ in found])
    plain = f"{prose} it is at noon. Then the of {prose} look at as. Of the {prose}"
    assert pii.find(model, [plain]) == [[]]


def test_training_snippets_are_labelled_ones(spark, personal):
    """The first digit of every text is a year; personal data comes later, or only in other spellings."""
    lead = "In 2024 " + "the of and " * 30
    hidden = lead + "write to and.77 (at) mail3.example.com " + "the of and " * 30
    for rows in ([lead + x for x in personal[:200]], [lead]):
        df = docs(spark, list(enumerate([*rows, hidden])))
        found = {r.doc_id: [hidden[s.start:s.end] for s in r.found if not s.base] for r in pii.personal_data(df).collect()}
        assert found[len(rows)] == ["and.77 (at) mail3.example.com"]
    assert pii.fit(docs(spark, [(1, "nothing to find"), (2, None)])) is None
    assert [k for k, _ in pii.snippets(lead + personal[0])] == ["email", "none"]


def test_gradient_is_that_of_the_loss():
    model = tagger.Tagger.new(3, 4, 1)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    r = np.random.default_rng(0)
    ids, tags = r.integers(0, 98, (6, 3)), r.integers(0, 3, (6, 3))
    _, g = model.gradient(ids, tags)
    for name in model.p:
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        was, losses = model.p[name][at], []
        for step in (1e-3, -1e-3):
            model.p[name][at] = was + step
            losses.append(model.gradient(ids, tags)[0])
        model.p[name][at] = was
        assert abs((losses[0] - losses[1]) / 2e-3 - g[name][at]) < 2e-3 * max(1, abs(g[name][at])), name


def test_personal_data_on_odd_rows(spark, odd, empty):
    df, rows = odd
    df = df.unionByName(docs(spark, [(20, "é a.b@c.example"), (None, "+1 (017) 555-7713 x")]))
    got = pii.personal_data(df)
    out = {r.doc_id: r for r in got.select("doc_id", *pii.digests(got["found"])).collect()}
    assert out[20].spans == "email:2:15" and out[20].base_sha256 == hashlib.sha256(b"email:2:15").hexdigest() and out[20].n_email == 1
    assert out[1].spans == "" and out[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.personal_data(empty).count() == 0
    mask = pii.masker(spark, None)
    masked = {r.doc_id: r.t for r in df.select("doc_id", mask(df["text"]).alias("t")).collect()}
    assert masked[20] == "é [EMAIL]" and masked[1] is None and masked[2] == ""


def test_decontamination_equals_brute_force(spark, odd, empty):
    r = random.Random(3)
    vocabulary = [f"{a}{b}" for a in ("ka", "mo", "ri", "su") for b in ("ten", "lor", "pix", "gan", "ud")]
    items = [(i, " ".join(r.choices(vocabulary, k=r.randrange(6, 60))).capitalize() + ". " + " ".join(r.choices(vocabulary, k=6)) + ".") for i in range(40)]
    rows = [(i, " ".join(r.choices(vocabulary, k=r.randrange(0, 300)))) for i in range(120)]
    for i, item in [(3, 7), (4, 0), (5, 39), (5, 12)]:
        w = rows[i][1].split(" ")
        at = r.randrange(len(w) + 1)
        rows[i] = (i, " ".join([*w[:at], items[item][1], *w[at:]]))
    bench = spark.createDataFrame([*items, (None, None), (99, "")], "item_id long, text string")

    def held(t, item):
        w, x = re.findall("[a-z0-9]+", t.lower()), decontaminate.split_item(0, item)
        own = re.findall("[a-z0-9]+", item.lower())
        there = {tuple(w[k:k + 5]) for k in range(len(w) - 4)}
        cover = [False] * len(own)
        for k in range(len(own) - 4):
            if tuple(own[k:k + 5]) in there:
                cover[k:k + 5] = [True] * 5
        q = x.question
        return sum(cover[:q]) >= 0.8 * q and sum(cover[q:]) >= 0.8 * (len(own) - q)
    want = {(i, k) for i, t in rows for k, item in items if held(t, item)}
    got = decontaminate.contaminated(docs(spark, rows), bench).collect()
    assert {(x.doc_id, x.item_id) for x in got} == want >= {(3, 7), (4, 0), (5, 39), (5, 12)}
    assert decontaminate.contaminated(odd[0], bench).count() == 0 and decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.contaminated(odd[0], bench.limit(0)).count() == 0


def test_bounds_hold_and_blocks_are_enough():
    """Block-max retrieval finds exactly what scoring every passage with every item finds."""
    r = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    part = decontaminate.index([decontaminate.split_item(i, " ".join(r.choices(words, k=r.randrange(3, 20)))) for i in range(50)])[0]
    texts = [" ".join(r.choices(words, k=r.randrange(0, 80))) for _ in range(40)]
    hashes = [decontaminate._words(t) for t in texts]
    rows = np.concatenate([[0], np.cumsum([len(h) for h in hashes])])
    got = {(i, j) for i, j, _ in decontaminate.retrieve(part, np.concatenate(hashes), rows)}
    want = set()
    step = part.window // 2
    for i, h in enumerate(hashes):
        for s in range(0, max(1, len(h) - part.window + step), step):
            ids = np.unique(part.ids(h[s:s + part.window]))
            want |= {(i, int(j)) for j in np.flatnonzero(part.impacts[ids].sum(axis=0, dtype=float) >= decontaminate.THRESHOLD)} if len(h) else set()
    assert got == want and got


def test_warc_links_digests_and_round_trip(spark, tmp_path):
    page = "<html><head><title>t</title></head><body><p>One &amp; two<p>three</body></html>"
    rows = [(1, "http://a.example/", page, 5), (2, None, None, 5), (None, "http://b.example/", "", 5), (1, "http://a.example/", page, 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, key int")
    source = warc.responses(pages)
    out = warc.derived(source).collect()
    assert len(out) == 8
    one = [r for r in out if r.key == 1 and r.warc_type == "conversion"]
    assert one[0] == one[1] and one[0].block == "One & two\nthree" and one[0].source_digest == warc.digest(page.encode())
    meta = next(r for r in out if r.key == 1 and r.warc_type == "metadata")
    assert meta.refers_to == one[0].refers_to and f"refers-to: {meta.refers_to}" in meta.block
    assert "http-header-Content-Type: text/html; charset=utf-8" in meta.block and f"warc-header-WARC-Record-ID: {meta.refers_to}" in meta.block
    assert next(r for r in out if r.key == 2 and r.warc_type == "conversion").block == ""
    assert warc.derived(warc.responses(pages.limit(0))).count() == 0
    records = warc.derived(source)
    warc.write(records, str(tmp_path / "w"))
    back = warc.read(spark, str(tmp_path / "w")).collect()
    assert len(back) == 8 and all(r.complete for r in back)
    assert Counter(r.block for r in back) == Counter(r.block for r in out)
    assert {dict((h.name, h.value) for h in r.warc_headers)["WARC-Refers-To"] for r in back} == {r.refers_to for r in out}


def test_main_text_on_held_out_layouts(spark):
    model = html.fit()
    made = list(html.layouts(150, seed=77))
    got = html.extract(model, [h for h, _, _ in made])
    assert np.mean([a == b for a, (_, b, _) in zip(got, made, strict=True)]) > 0.85
    rows = [(1, "u", None, "x"), (2, "u", "", "x"), (3, "u", "no tags &lt;", "x"), (None, None, "<nav><a href=x>menu</a></nav><article><h1>A&nbsp;b</h1><p>c\n d<script>'</p>'</script><br>e, and more words to make up a paragraph.<p>f stands for a second paragraph, as long as this.</article>", "x"),
            (5, "u", "<" * 5000 + "<p" * 3000, "x"), (6, "u", "<div>" * 3000 + "deep", "x")]
    out = {r.page_id: r for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert out[1].text == out[2].text == "" and out[1].n_chars == 0
    assert out[None].text == "A b\nc d e, and more words to make up a paragraph.\nf stands for a second paragraph, as long as this."
    assert out[None].n_chars == len(out[None].text) and len(out) == 6


def test_head_ends_without_its_end_tag():
    def shown(page):
        return "".join(x for _, x, _ in html.parse(page).runs).strip()
    for end in ("</head>", ""):
        for body in ("<body>", ""):
            page = f"<html><head><meta charset=u><title>t</title><style>a</style><script>b</script>{end}{body}<article><p>one<p>two</article>"
            assert shown(page) == "onetwo", page
    assert shown("<head><noscript><img src=x></noscript><title>t</title><p>one") == "one"
    assert shown("<head><title>t</title>one<p>two") == "onetwo"


def test_decoding_is_the_best_labelling_without_contradictions():
    page = html.parse("<div><p>a</p><p>b</p><aside><p>c</p></aside></div>")
    n = len(page.parent)

    def value(marks, score):
        for i in range(1, n):
            above = marks[page.parent[i] - 1] if page.parent[i] else 0
            if above and marks[i - 1] != above:
                return -np.inf
        return sum({1: s, -1: -s, 0: -html.MIXED}[m] for m, s in zip(marks, score[1:], strict=True))
    r = np.random.default_rng(1)
    for _ in range(60):
        score = r.normal(scale=2, size=n)
        best = max(value(m, score) for m in itertools.product((1, -1, 0), repeat=n - 1))
        assert value(html.labels(page, score)[1:], score) == pytest.approx(best)


def test_boosting_separates():
    r = np.random.default_rng(2)
    x = r.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    m = boosting.boost(x[:1500], y[:1500])
    assert ((m.logits(x[1500:]) > 0) == y[1500:]).mean() > 0.95


def test_licences(spark, empty):
    text = "\n".join(["Kata moro pilu.", "Licensed### under%%% the Apache*** License, Version 2.0.", "moro kata license tasa nemi pilu", "Released under the MIT License."])
    rows = [(i, f"Moro kata {i} tasa pilu nemi. Pilu tasa moro nemi {i}.\nSecond line kata {i} nemi tasa") for i in range(60)] + [(100, text), (100, text), (101, None), (102, ""), (None, "All rights reserved.")]
    got = licences.scan(docs(spark, rows)).collect()
    assert all(r.doc_id in (100, None) for r in got)
    found = Counter((r.doc_id, r.paragraph, r.family) for r in got)
    assert found[(100, 1, "Apache-2.0")] == 2 and found[(100, 3, "MIT")] == 2 and found[(None, 0, "proprietary")] == 1
    assert not any(r.paragraph == 2 and r.family != "unknown" for r in got)
    assert licences.scan(empty).count() == 0


def test_notices_in_the_ordinary_sample_are_not_lost(spark):
    """Notices without a word of the legal filter, and ordinary lines with their words, meet the sample."""
    notices = {"GPL": licences.TEMPLATES["GPL"][2], "BSD": licences.TEMPLATES["BSD"][2]}
    rows = [(i, f"Moro kata {i} tasa pilu nemi.\nThe software is in binary and source form {i} for redistribution, gpl tasa") for i in range(60)]
    rows += [(100 + i, t) for i, t in enumerate(notices.values())]
    got = {(r.doc_id, r.family) for r in licences.scan(docs(spark, rows)).collect()}
    assert {x for x in got if x[1] != "unknown"} == {(100, "GPL"), (101, "BSD")}


@pytest.mark.parametrize("n", [0, 3, 300])
def test_top_k_equals_brute_force(spark, n):
    r = np.random.default_rng(n)
    vectors = [(int(i), [float(v) for v in np.round(r.normal(size=8), 1)]) for i in range(n)]
    bad = [(1000, None), (1050, [1.0, None]), (1100, [float("nan")] * 8), (1150, [float("inf")] * 8), (None, [1.0] * 8)] if n else []
    df = spark.createDataFrame([(i, v, 7) for i, v in vectors + bad + vectors[:2]], "vec_id long, embedding array<float>, score int")
    q = {i: np.floor(256 * np.float32(v).astype(float)).astype(int) for i, v in vectors}
    want = set()
    for i in q:
        if i % 50 == 0:
            top = sorted((-int(q[i] @ v), j) for j, v in q.items() if j != i)[:5]
            want |= {(i, k + 1, j, -s) for k, (s, j) in enumerate(top)}
    assert {tuple(x) for x in topk.top_k(df).collect()} == want


def test_top_k_broadcasts_nothing_and_groups_do_not_change_it(spark, monkeypatch):
    r = np.random.default_rng(1)
    df = spark.createDataFrame([(i, [float(v) for v in r.integers(-3, 4, 4)]) for i in range(600)], "vec_id long, embedding array<double>")
    whole = topk.top_k(df, every=5)
    assert "Broadcast" not in whole._jdf.queryExecution().toString()
    monkeypatch.setattr(topk, "GROUP", 50)
    monkeypatch.setattr(topk, "QUERIES", 16)
    monkeypatch.setattr(topk, "BLOCK", 8)
    assert sorted(topk.top_k(df, every=5).collect()) == sorted(whole.collect())


def test_search_stops_early_and_stays_exact():
    r = np.random.default_rng(4)
    m = np.repeat(r.integers(-200, 200, (40, 8)), topk.BLOCK, axis=0).astype(float) + r.integers(0, 3, (40 * topk.BLOCK, 8))
    ids = np.arange(len(m))
    got = {(a, b): s for a, b, s in topk.search(ids[:9], m[:9], ids, m, 5)}
    scores = m[:9] @ m.T
    scores[np.arange(9), np.arange(9)] = -np.inf
    for i in range(9):
        top = sorted((-scores[i, j], j) for j in ids)[:5]
        assert {(i, int(j)): -s for s, j in top} == {k: v for k, v in got.items() if k[0] == i}


def test_url_verdicts(spark):
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1")]
    cases = [("http://A.EXAMPLE.org/es/5?x", "a.example.org", "/es/5", "example.org/es/", "block"), ("https://example.org/en/12#f", "example.org", "/en/12", "example.org/en/1", "block"),
             ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"), ("http://bad.example.com", "bad.example.com", "", None, "block"),
             ("x://www.bad.example.com?q=/", "www.bad.example.com", "", None, "block"), ("http://good.example.com/a", "good.example.com", "/a", None, "allow"),
             ("nothing", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("http://example.org", "example.org", "", None, "allow")]
    df = spark.createDataFrame([(i, c[0], "clash") for i, c in enumerate(cases)] + [(None, cases[0][0], "clash")], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(df, rules, urls.keys(spark, ["bad.example.com", None])).collect()}
    assert got == {**{i: c[1:] for i, c in enumerate(cases)}, None: cases[0][1:]}
    assert urls.judge(df.limit(0), rules, urls.keys(spark, ["x"])).count() == 0


def test_cascade_is_exact_for_its_universe(spark, monkeypatch):
    monkeypatch.setattr(urls, "BITS_PER_KEY", 2)  # many false positives, many levels
    all_keys = spark.range(3000).selectExpr("concat('k', id) AS key")
    listed = all_keys.where("crc32(key) % 5 = 0")
    levels = urls.cascade(listed, all_keys)
    assert len(levels) > 2
    rows = all_keys.select("key", *[x.row.scalar().alias(f"bloom_{i}") for i, x in enumerate(levels)])
    from pyspark.sql import functions as F
    wrong = rows.where(urls.member(levels, F.col("key")) != F.expr("crc32(key) % 5 = 0")).count()
    assert wrong == 0


def test_pipeline_stages(spark, tmp_path):
    r = random.Random(6)
    vocabulary = [f"{a}{b}" for a in ("ka", "mo", "ri", "su", "te") for b in ("ten", "lor", "pix", "gan", "ud")]

    def text(n):
        return " ".join(r.choices(vocabulary, k=n))
    item = text(30)
    a, b = text(80), text(80)
    rows = [(1, a), (2, a), (3, a + " end"), (4, b), (5, text(40) + " " + item + " " + text(20)), (6, "... 123"), (7, None), (8, text(50) + " x.1@mail.example.com"), (9, text(60)), (9, text(60))]
    df = docs(spark, rows)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at = df
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == df.columns
        kept[name] = sorted(x.doc_id for x in at.collect())
    assert kept["language"] == [1, 2, 3, 4, 5, 8, 9, 9]
    assert kept["near_dedup"] == [1, 4, 5, 8, 9, 9]
    assert kept["decontamination"] == kept["personal_data"] == [1, 4, 8, 9, 9]
    masked = {x.doc_id: x for x in at.collect()}[8]
    assert masked.text.endswith("[EMAIL]") and masked.n_chars == len(masked.text)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 5
