"""Benchmark items inside training documents: BM25 retrieval with block-max bounds, then overlap of question and answer.

Test items are the indexed side, every passage of every training document is a query. Impacts are divided by the item's
score for itself, so one threshold holds for all items. Items lie in blocks of like length; the sum of a block's largest
impacts bounds the score of a passage with each of its items, and only blocks whose bound reaches the threshold are scored.
Every pair above the threshold is retrieved, and confirmed if most words of the item's question and of its answer lie in
runs of words that the document has as well.
"""
from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark.llm.common import slices, utf8
from rankspark.llm.words import SEPARATOR, shingles, word_hashes

K1, B = 1.2, 0.75
BLOCK, PART_ITEMS = 16, 512
#: Share of an item's own score that a passage must reach, and share of question and answer words that must be shared.
THRESHOLD, OVERLAP, RUN = 0.5, 0.8, 5
#: One broadcast holds parts of at most so many bytes; a larger benchmark takes further passes over the documents.
MOST_BYTES = 1 << 26

#: Everything in ASCII that is neither letter nor digit separates words.
_SEPARATOR = SEPARATOR.copy()
_SEPARATOR[[b for b in range(128) if not chr(b).isalnum()]] = True


def _words(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return word_hashes(data, np.array([0, len(data)]), _SEPARATOR)[0]


@dataclass
class Item:
    id: int | None
    words: np.ndarray
    #: number of words of the question; the answer is the rest
    question: int


def split_item(id_: int | None, text: str) -> Item:
    """Question and answer: the last sentence is the answer, or the second half of a single sentence."""
    words = _words(text)
    ends = [m.end() for m in re.finditer(r"[.!?]+\s+", text)]
    question = len(_words(text[:ends[-1]])) if ends else 0
    return Item(id_, words, question if 0 < question < len(words) else (len(words) + 1) // 2)


@dataclass
class Part:
    items: list[Item]
    terms: np.ndarray
    #: terms x items, impacts divided by each item's own score; terms x blocks, their maxima
    impacts: np.ndarray
    maxima: np.ndarray
    window: int

    @property
    def size(self) -> int:
        return self.impacts.nbytes + self.maxima.nbytes + self.terms.nbytes

    def ids(self, words: np.ndarray) -> np.ndarray:
        """Row of each word's term, or the empty last row."""
        at = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        return np.where(self.terms[at] == words, at, len(self.terms))


def index(items: list[Item]) -> list[Part]:
    """Impact matrices of items with words, by length; statistics are those of all items."""
    items = sorted((x for x in items if len(x.words)), key=lambda x: len(x.words))
    if not items:
        return []
    sets = [np.unique(x.words, return_counts=True) for x in items]
    terms, df = np.unique(np.concatenate([s for s, _ in sets]), return_counts=True)
    idf = np.log(1 + (len(items) - df + 0.5) / (df + 0.5))
    mean = np.mean([len(x.words) for x in items])
    out = []
    for at in range(0, len(items), PART_ITEMS):
        part, own = items[at:at + PART_ITEMS], sets[at:at + PART_ITEMS]
        used = np.unique(np.concatenate([s for s, _ in own]))
        impacts = np.zeros((len(used) + 1, -(-len(part) // BLOCK) * BLOCK), np.float32)
        for j, (x, (s, tf)) in enumerate(zip(part, own, strict=True)):
            w = idf[np.searchsorted(terms, s)] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(x.words) / mean))
            impacts[np.searchsorted(used, s), j] = w / w.sum()
        maxima = impacts.reshape(len(used) + 1, -1, BLOCK).max(axis=2)
        out.append(Part(part, used, impacts, np.ascontiguousarray(maxima), max(len(x.words) for x in part)))
    return out


def retrieve(part: Part, words: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """(row, item, score) of every passage and item whose score reaches the threshold, best passage of each pair.

    Passages are windows as long as the longest item, every half window; the last one ends with the text.
    """
    step = max(1, part.window // 2)
    counts = np.diff(rows)
    n = np.where(counts > 0, np.maximum(1, -(-(counts - part.window) // step) + 1), 0)
    row = np.repeat(np.arange(len(n)), n)
    start = rows[row] + step * (np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n))
    end = np.minimum(start + part.window, rows[row + 1])
    ids = part.ids(words)
    # bounds: repeated words count again, which only raises them
    known = np.flatnonzero(ids < len(part.terms))
    total = np.zeros((len(known) + 1, part.maxima.shape[1]), np.float64)
    np.cumsum(part.maxima[ids[known]], axis=0, out=total[1:], dtype=np.float64)
    first, last = np.searchsorted(known, start), np.searchsorted(known, end)
    bound = total[last] - total[first]
    p, block = np.nonzero(bound >= THRESHOLD - 1e-6)
    if not len(p):
        return
    n = last[p] - first[p]
    own = np.repeat(np.arange(len(p)), n)
    at = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    pair = np.sort(own * (len(part.terms) + 1) + ids[known[first[p][own] + at]])
    pair = pair[np.diff(pair, prepend=-1) > 0]
    own, terms = np.divmod(pair, len(part.terms) + 1)
    rows_of = part.impacts.reshape(len(part.terms) + 1, -1, BLOCK)[terms, block[own]]
    scores = np.add.reduceat(rows_of, np.searchsorted(own, np.arange(len(p))), axis=0, dtype=np.float64)
    best: dict[tuple[int, int], float] = {}
    for k, j in zip(*np.nonzero(scores >= THRESHOLD), strict=True):
        key = (int(row[p[k]]), int(block[k] * BLOCK + j))
        best[key] = max(best.get(key, 0.0), float(scores[k, j]))
    for (r, j), score in sorted(best.items()):
        yield r, j, score


def overlap(item: Item, words: np.ndarray) -> tuple[float, float]:
    """Shares of the question's and the answer's words that lie in runs of RUN words which the text has as well."""
    size = min(RUN, len(item.words))
    own, _ = shingles(item.words, np.array([0, len(item.words)]), size)
    there, _ = shingles(words, np.array([0, len(words)]), size)
    hit = np.isin(own, there) if len(words) >= size else np.zeros(len(own), bool)
    covered = np.zeros(len(item.words), bool)
    for i in range(size):
        covered[i:i + len(hit)] |= hit
    q = item.question
    return float(covered[:q].mean()), float(covered[q:].mean()) if q < len(covered) else float(covered.mean())


def read_items(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> list[bytes]:
    """Pickled groups of index parts, each of bounded size. The benchmark is the bounded side: it is read by the driver."""
    rows = benchmark.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).dropDuplicates()
    parts = index([split_item(x.id, x.text or "") for x in sorted(rows.toLocalIterator(), key=lambda x: (x.id is None, x.id, x.text or ""))])
    groups: list[list[Part]] = []
    size = MOST_BYTES
    for part in parts:
        if size + part.size > MOST_BYTES and (groups or size):
            groups.append([])
            size = 0
        groups[-1].append(part)
        size += part.size
    return [pickle.dumps(g) for g in groups]


MATCH = "array<struct<item_id: long, score: double, question_overlap: double, answer_overlap: double>>"
_MATCH = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())]))


def matcher(spark: SparkSession, group: bytes):
    """Column function: text -> the confirmed items of one group."""
    sent = spark.sparkContext.broadcast(group)

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        parts: list[Part] = pickle.loads(sent.value)
        for column in columns:
            data, offsets = utf8(column)
            out: list[list[tuple]] = []
            for lo, hi in slices(offsets):
                words, _, _, rows = word_hashes(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], _SEPARATOR)
                found: list[list[tuple]] = [[] for _ in range(hi - lo)]
                for part in parts:
                    for r, j, score in retrieve(part, words, rows):
                        item = part.items[j]
                        q, a = overlap(item, words[rows[r]:rows[r + 1]])
                        if q >= OVERLAP and a >= OVERLAP:
                            found[r].append((item.id, score, q, a))
                out += found
            names = ("item_id", "score", "question_overlap", "answer_overlap")
            yield pa.array([[dict(zip(names, m, strict=True)) for m in ms] for ms in out], _MATCH)

    def column(text: Column) -> Column:
        return F.arrow_udf(run, MATCH)(text.cast("string"))
    return column


def matches(spark: SparkSession, benchmark: DataFrame, text: Column) -> Column:
    """All confirmed items of a text; an empty array if the benchmark has no words."""
    groups = [matcher(spark, g)(text) for g in read_items(benchmark)]
    return F.concat(*groups) if groups else F.array().cast(MATCH)


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap: one row per document row and confirmed item.

    Null and empty texts or items match nothing; repeated rows each have their matches; a null id is kept as null; an empty
    table gives no rows; other columns are not read. Texts are searched whole.
    """
    found = docs.select(F.col(f"`{key}`").alias("doc_id"), F.inline(matches(docs.sparkSession, benchmark, F.col(f"`{text}`"))))
    return found
