"""Language proportions of documents by a mixture of n-gram models.

Each learned language is a multinomial over byte trigrams centred on letters. A document is a sequence of segments of eight
words; expectation-maximisation estimates how its segments divide among the languages and a background of equally likely
trigrams. Sets of the first 1, 2, ... languages are compared by penalised likelihood.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankspark.llm.common import slices, utf8
from rankspark.llm.words import LOWER

#: Hashed trigrams; a model is BINS x languages numbers, whatever the corpus.
BINS = 1 << 17
SEGMENT = 8
ROUNDS = 12
#: A text is rejected if the background holds more than this share of its trigrams, in a mixture fitted word by word.
BACKGROUND = 0.5
#: Evidence for the background, in nats, that chance in a short text does not reach.
REJECT_MARGIN = 200.0
SMOOTHING = 0.1
#: The model is broadcast: at most so many languages (0.5 MB each).
MOST_LANGUAGES = 400

_CLASS = np.zeros(256, np.int64)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)
_CLASS[128:] = 27 + np.arange(128) % 100


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(byte position, bin) of the trigram centred on every letter byte, and whether a word starts there."""
    c = _CLASS[LOWER[data]]
    before, after = np.zeros_like(c), np.zeros_like(c)
    before[1:], after[:-1] = c[:-1], c[1:]
    inner = offsets[1:-1]
    before[inner[inner < len(c)]] = 0
    after[inner[inner > 0] - 1] = 0
    at = np.flatnonzero(c)
    code = (before[at] << 14) | (c[at] << 7) | after[at]
    return at, ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(47)).astype(np.int64), before[at] == 0


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    #: BINS x (languages + background) log probabilities
    logs: np.ndarray

    @staticmethod
    def of(counts: dict[str, np.ndarray]) -> Model:
        names = tuple(sorted(counts))
        if not names:
            return Model((), np.zeros((BINS, 1), np.float32))
        table = np.stack([counts[x] for x in names], axis=1).astype(np.float64)
        seen = max(int((table.sum(axis=1) > 0).sum()), 2)
        logs = np.log(table + SMOOTHING) - np.log(table.sum(axis=0) + SMOOTHING * seen)
        return Model(names, np.column_stack([logs, np.full(BINS, -np.log(seen))]).astype(np.float32))


def learn(df: DataFrame, text: str, lang: str) -> Model:
    """Trigram counts of every row with a text and a language. Tasks count whole partitions; only sums are shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(0).to_pylist()
            data, offsets = utf8(batch.column(1))
            for lo, hi in slices(offsets):
                own = offsets[lo:hi + 1] - offsets[lo]
                at, bins, _ = trigrams(data[offsets[lo]:offsets[hi]], own)
                ends = np.searchsorted(at, own)
                of = {x: k for k, x in enumerate(sorted(set(names[lo:hi])))}
                row = np.repeat(np.array([of[x] for x in names[lo:hi]]), np.diff(ends))
                both, n = np.unique(row * BINS + bins, return_counts=True)
                for x, k in of.items():
                    part = (both >= k * BINS) & (both < (k + 1) * BINS)
                    sums.setdefault(x, np.zeros(BINS, np.int64))[both[part] - k * BINS] += n[part]
        for x, n in sums.items():
            bins = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(bins), pa.string()), pa.array(bins), pa.array(n[bins])],
                                             names=["lang", "bin", "n"])
    rows = df.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))
    counted = rows.dropna().mapInArrow(run, "lang string, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    got = (counted.groupBy("lang").agg(F.collect_list("bin").alias("bins"), F.collect_list("n").alias("ns"))
           .limit(MOST_LANGUAGES + 1).collect())  # a list holds BINS numbers at most
    if len(got) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    out = {}
    for x in got:
        out[x.lang] = np.zeros(BINS, np.int64)
        out[x.lang][x.bins] = x.ns
    return Model.of(out)


def _segments(model: Model, data: np.ndarray, offsets: np.ndarray, size: int = SEGMENT) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihood of every segment of ``size`` words under every component, and the segment offsets of each row."""
    at, bins, starts = trigrams(data, offsets)
    if not len(at):
        return np.zeros((0, model.logs.shape[1])), np.zeros(len(offsets), np.int64)
    rows = np.searchsorted(at, offsets)
    word = np.cumsum(starts) - 1
    first = np.concatenate([word, [word[-1] + 1]])[rows]  # words before each row
    first_of = np.repeat(first[:-1], np.diff(rows))
    new = starts & ((word - first_of) % size == 0)
    begin = np.flatnonzero(new)
    return np.add.reduceat(model.logs[bins], begin, axis=0, dtype=np.float64), np.searchsorted(begin, rows)


def _sum(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Row sums over offsets, zero for empty rows."""
    total = np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values, axis=0)])
    return total[rows[1:]] - total[rows[:-1]]


def mixture(logs: np.ndarray, rows: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, log likelihood) of each row's mixture over its ``allowed`` components."""
    n = np.diff(rows)
    own = np.repeat(np.arange(len(n)), n)
    share = allowed / allowed.sum(axis=1, keepdims=True)
    top = logs.max(axis=1, keepdims=True)
    p = np.exp(logs - top)
    like = np.zeros(len(n))
    for _ in range(ROUNDS):
        joint = p * share[own]
        total = np.maximum(joint.sum(axis=1, keepdims=True), 1e-300)
        share = np.where(n[:, None] > 0, _sum(joint / total, rows) / np.maximum(n, 1)[:, None], share)
        like = _sum(np.log(total) + top, rows)[:, 0]
    return share, like


def infer(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the selected languages and of the background, and each component's likelihood of the whole row."""
    logs, rows = _segments(model, data, offsets)
    like, width = _sum(logs, rows), len(model.languages)
    out = np.zeros((len(rows) - 1, width + 1))
    # where one language is the likeliest component of every segment, no mixture of any set is likelier: it is settled
    top = logs.argmax(axis=1)[:, None] == np.arange(width + 1)
    settled = (_sum(top.astype(np.int64), rows) == np.diff(rows)[:, None]) & (np.diff(rows)[:, None] > 0)
    settled[:, width] = False
    out[settled] = 1
    left = np.flatnonzero(~settled.any(axis=1) & (np.diff(rows) > 0))
    if len(left) and width:
        own = np.zeros(len(rows) - 1, bool)
        own[left] = True
        out[left] = _select(logs[np.repeat(own, np.diff(rows))], np.concatenate([[0], np.cumsum(np.diff(rows)[left])]), width)
    return out, like


def _select(logs: np.ndarray, rows: np.ndarray, width: int) -> np.ndarray:
    """The proportions under the best penalised set of the first k languages of each row."""
    n = len(rows) - 1
    share, _ = mixture(logs, rows, np.ones((n, width + 1)))
    order = np.argsort(-share[:, :width], axis=1, kind="stable")
    penalty = 0.5 * np.log(np.maximum(np.diff(rows), 2)) + 3.0
    best, best_score = share, np.full(n, -np.inf)
    for k in range(1, width + 1):
        allowed = np.zeros((n, width + 1))
        np.put_along_axis(allowed, order[:, :k], 1, axis=1)
        allowed[:, width] = 1
        own, like = mixture(logs, rows, allowed)
        score = like - k * penalty
        better = score > best_score
        best, best_score = np.where(better[:, None], own, best), np.where(better, score, best_score)
    return best


def background(model: Model, data: np.ndarray) -> tuple[float, float]:
    """The background's share of a text's trigrams in the mixture of words, and the nats it adds to the languages' own.

    Words and not segments: where languages alternate within a segment, no language explains the segment.
    """
    logs, rows = _segments(model, data, np.array([0, len(data)]), 1)
    if not len(logs):
        return 0.0, 0.0
    every = np.ones((1, logs.shape[1]))
    share, like = mixture(logs, rows, every)
    every[0, -1] = 0
    _, without = mixture(logs, rows, every)
    joint = np.exp(logs - logs.max(axis=1, keepdims=True)) * share
    n = logs[:, -1]  # as the number of trigrams: all have the same probability
    return float((joint[:, -1] / joint.sum(axis=1)) @ n / n.sum()), float(like[0] - without[0])


RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                       T.StructField("languages", T.ArrayType(T.StringType())),
                       T.StructField("proportions", T.ArrayType(T.DoubleType())), T.StructField("rejected", T.BooleanType())])


def predictor(model: Model):
    """Column function: text -> struct of RESULT.

    ``lang_pred`` is the learned language with the largest proportion (ties: the first by name), ``score`` its proportion,
    ``languages`` the selected set with ``proportions``. ``und``, with score 0, if the text is null, empty or has no letter,
    or nothing was learned. ``rejected``: ``und``, or the background alone explains the whole text better than
    any language alone, by more than REJECT_MARGIN nats.
    """
    names = model.languages
    sent: list = []

    def far(model: Model, data: np.ndarray) -> bool:
        share, nats = background(model, data)
        return share > BACKGROUND and nats > REJECT_MARGIN

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = sent[0].value
        for column in parts:
            data, offsets = utf8(column)
            shares, likes = [np.zeros((0, len(names) + 1))], [np.zeros((0, len(names) + 1))]
            letters = []
            for lo, hi in slices(offsets):
                part, own = data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
                for to, got in zip((shares, likes), infer(model, part, own), strict=True):
                    to.append(got)
                low = LOWER[part]
                plain = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122))])
                for i, some in enumerate(plain[own[1:]] > plain[own[:-1]]):
                    letters.append(bool(some) or any(map(str.isalpha, part[own[i]:own[i + 1]].tobytes().decode("utf-8", "replace"))))
            known, like = np.concatenate(shares)[:, :len(names)], np.concatenate(likes)
            if names:  # a text that is all background is still nearest to one language
                top = np.where(known.max(axis=1, initial=0) > 0, known.argmax(axis=1), like[:, :-1].argmax(axis=1))
            out = []
            for i, some in enumerate(letters):
                if not some or not names:
                    out.append(("und", 0.0, [], [], True))
                    continue
                kept = [(names[j], float(known[i, j])) for j in np.argsort(-known[i], kind="stable") if known[i, j] > 0.01]
                out.append((names[top[i]], float(min(known[i, top[i]], 1.0)), [x for x, _ in kept], [x for _, x in kept],
                            bool(like[i, -1] > like[i, :-1].max()) and far(model, data[offsets[i]:offsets[i + 1]])))
            yield pa.array([dict(zip(RESULT.names, x, strict=True)) for x in out],
                           pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("languages", pa.list_(pa.string())),
                                      ("proportions", pa.list_(pa.float64())), ("rejected", pa.bool_())]))

    def column(spark, text: Column) -> Column:
        sent.append(spark.sparkContext.broadcast(model))
        return F.arrow_udf(run, RESULT)(text.cast("string"))
    return column


def held_out(key: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; a null id is neither held out nor learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predict(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, and the fields of RESULT, one row per row of ``df``.

    Learns from the text and language of rows that are not held out; repeated rows count as often as they occur. The
    language, source and id of a row never enter its prediction. An empty table gives no rows.
    """
    id_, out = F.col(f"`{key}`"), F.col(f"`{text}`")
    model = learn(df.where(id_.isNotNull() & ~held_out(id_)), text, lang)
    rows = df.select(id_.alias("doc_id"), held_out(id_).alias("held_out"), predictor(model)(df.sparkSession, out).alias("p"))
    return rows.select("doc_id", "held_out", *[F.col(f"p.{x}").alias(x) for x in RESULT.names])
