"""Byte-level BPE encoding and decoding by recursive DuckDB queries inside Spark tasks.

A text is cut at spaces between two visible characters, where no pre-token can span, so each distinct space-free unit is
split by the tokenizer's pattern once and its distinct pre-tokens are merged once a worker process. Token-position rows of the new words join
the merge table; each round contracts every word's leftmost pair of least rank; words without a mergeable pair drop out of
the recursion. Decoding joins the ids with the vocabulary and aggregates the bytes in position order.
"""
from __future__ import annotations

import base64
import gc
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The pre-token pattern of the rank file (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts are worked through in runs of about so many characters, words in runs of so many; bounds a task's memory.
RUN_CHARS, RUN_WORDS = 1 << 20, 40_000
#: A process keeps twice so many units and pre-tokens at most; others are learned again when they come.
KEEP_UNITS, KEEP_WORDS = 200_000, 400_000
#: A recursion keeps what every round made, at most the square of a word's bytes in rows; runs hold so many such rows.
RUN_ROWS = 3_000_000
#: Longer words, of which one alone can exceed any run, are merged by the same step in a table that is replaced per round.
LONG_WORD = 160

#: White space other than space and newline; a text with any is cut by pattern.
_ODD_SPACE = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0  -     　]")
_MARKS = frozenset(",.;:!?")
_CUT = regex.compile(r"(?<=\S) (?=\S)")

PAIRS = "SELECT w, g, tok, lead(g) OVER (ORDER BY g) AS ng, CASE WHEN lead(w) OVER (ORDER BY g) = w THEN lead(tok) OVER (ORDER BY g) END AS nt{step} FROM {t}"

ENCODE = f"""WITH RECURSIVE t(w, g, tok, step) AS (
 SELECT w, g, tok, 0 FROM start
 UNION ALL
 (WITH p AS MATERIALIZED ({PAIRS.format(t='t', step=', step')}),
  best AS (SELECT p.w, min(m.merged::BIGINT << 31 | p.g) AS k, arg_min(p.ng, m.merged::BIGINT << 31 | p.g) AS gone
           FROM p JOIN merges m ON m.l = p.tok AND m.r = p.nt GROUP BY p.w)
  SELECT p.w, p.g, CASE WHEN p.g = (k & 2147483647) THEN (k >> 31)::INT ELSE p.tok END, p.step + 1
  FROM p JOIN best ON best.w = p.w WHERE p.g <> gone))
SELECT w, g, tok FROM t JOIN (SELECT w, max(step) AS step FROM t GROUP BY w) last USING (w, step) ORDER BY g"""

#: One round for long words: every second pair of each run of adjacent best pairs, so that none overlap.
ROUND = f"""CREATE OR REPLACE TEMP TABLE merging AS
WITH p AS ({PAIRS.format(t='merging', step='')}),
 r AS (SELECT p.*, m.merged, min(m.merged) OVER (PARTITION BY w) AS best, row_number() OVER (ORDER BY g) AS n FROM p LEFT JOIN merges m ON m.l = p.tok AND m.r = p.nt),
 h AS (SELECT *, coalesce(merged = best, false) AS hit FROM r),
 s AS (SELECT *, coalesce(lag(hit) OVER (PARTITION BY w ORDER BY g), false) AS was FROM h),
 d AS (SELECT *, hit AND (n - max(CASE WHEN hit AND NOT was THEN n END) OVER (PARTITION BY w ORDER BY g ROWS UNBOUNDED PRECEDING)) % 2 = 0 AS joins FROM s),
 e AS (SELECT *, coalesce(lag(joins) OVER (PARTITION BY w ORDER BY g), false) AS gone FROM d)
SELECT w, g, CASE WHEN joins THEN best ELSE tok END AS tok FROM e WHERE NOT gone"""

DECODE = "SELECT w, string_agg(hex(vocabulary.bytes), '' ORDER BY g) AS hex FROM ids JOIN vocabulary ON vocabulary.id = ids.tok GROUP BY w ORDER BY w"


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file: one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Cache(dict):
    """unit or pre-token -> what was made of it, in two generations: when the younger is full the elder is dropped, so frequent units stay."""

    def __init__(self):
        self.elder: dict = {}

    def __missing__(self, unit: str):
        self[unit] = out = self.elder[unit]
        return out

    def lacking(self, units: set[str]) -> set[str]:
        new = units.difference(self)
        return {u for u in new if u not in self.elder} if self.elder else new

    def turn(self, most: int) -> None:
        if len(self) > most:
            self.elder = dict(self)
            self.clear()


class Codec:
    """The merge table and vocabulary in an in-memory database of this task's process, with bounded caches of units."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import duckdb

        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        splits = [(ranks[t[:i]], ranks[t[i:]], n) for t, n in ranks.items() for i in range(1, len(t))
                  if t[:i] in ranks and t[i:] in ranks]
        left, right, merged = zip(*splits, strict=True) if splits else ((), (), ())
        self._table("merges", pa.table({"l": pa.array(left, pa.int32()), "r": pa.array(right, pa.int32()), "merged": pa.array(merged, pa.int32())}))
        self._table("vocabulary", pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "bytes": pa.array(list(ranks), pa.binary())}))
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.pattern, self.usual = regex.compile(pattern), pattern == PATTERN
        #: pre-token -> (ids, decoded bytes); units that differ in a mark or the space before them share their words
        self.known = Cache()
        #: (ids, decoded bytes) of units at a text's start and after a space
        self.first, self.rest = (Cache(), Cache()), (Cache(), Cache())

    def _table(self, name: str, rows: pa.Table) -> None:
        self.db.register("arrow_rows", rows)
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM arrow_rows")
        self.db.unregister("arrow_rows")

    def _arrow(self, sql: str) -> pa.Table:
        return self.db.sql(sql).to_arrow_table()

    def words(self, words: list[bytes]) -> tuple[list[bytes], list[bytes]]:
        """The ids (as little-endian 32-bit integers) and the decoded bytes of each pre-token."""
        n = np.array([len(x) for x in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        w = np.repeat(np.arange(len(words), dtype=np.int32), n)
        rows = pa.table({"w": w, "g": np.arange(len(data), dtype=np.int32), "tok": self.byte[data]})
        long = n[w] > LONG_WORD
        self._table("start", rows.filter(pa.array(~long)))
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE ids AS {ENCODE}")
        if long.any():
            self._table("merging", rows.filter(pa.array(long)))
            before = -1
            while (now := self.db.sql("SELECT count(*) FROM merging").fetchall()[0][0]) != before:
                before = now
                self.db.execute(ROUND)
            self.db.execute("INSERT INTO ids SELECT w, g, tok FROM merging")
        ids = self._arrow("SELECT w, tok FROM ids ORDER BY g")
        tokens = ids["tok"].to_numpy().astype("<u4").tobytes()
        ends = (4 * np.searchsorted(ids["w"].to_numpy(), np.arange(len(words) + 1))).tolist()
        plain = self._arrow(DECODE)["hex"].to_pylist()
        return [tokens[i:j] for i, j in zip(ends, ends[1:])], list(map(bytes.fromhex, plain))

    def _pieces(self, lead: str, unit: str) -> list[str]:
        """The unit's pre-tokens; words, and words before one mark, need no pattern."""
        if self.usual:
            if unit.isalpha():
                return [lead + unit]
            if unit[-1:] in _MARKS and unit[:-1].isalpha():
                return [lead + unit[:-1], unit[-1]]
        return self.pattern.findall(lead + unit)

    def _learn(self, units: set[str], caches: tuple[Cache, Cache], lead: str) -> None:
        pieces = {u: self._pieces(lead, u) for u in units}
        self.known.turn(KEEP_WORDS)
        for part in _runs([p.encode() for p in self.known.lacking({p for ps in pieces.values() for p in ps})]):
            self.known.update(zip((p.decode() for p in part), zip(*self.words(part), strict=True), strict=True))
        ids, plain = caches
        for u, ps in pieces.items():
            if len(ps) == 1:
                ids[u], plain[u] = self.known[ps[0]]
            else:
                of, text = zip(*map(self.known.__getitem__, ps), strict=True)
                ids[u], plain[u] = b"".join(of), b"".join(text)

    def texts(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """(ids, decoded bytes) of each text."""
        cut = [_cut(x) for x in texts]
        for caches, units, lead in ((self.first, {x[0] for x in cut if x[0]}, ""),
                                    (self.rest, {u for x in cut for u in x[1:]}, " ")):
            for cache in caches:  # both hold the same units
                cache.turn(KEEP_UNITS)
            if new := caches[0].lacking(units):
                self._learn(new, caches, lead)
        return [tuple((first[x[0]] if x[0] else b"") + b"".join(map(rest.__getitem__, x[1:]))
                      for first, rest in zip(self.first, self.rest, strict=True)) for x in cut]


def _runs(words: list[bytes]) -> Iterator[list[bytes]]:
    """The words in runs of at most RUN_WORDS words and about RUN_ROWS rows of work; a larger word is a run of its own."""
    part, rows = [], 0
    for w in words:
        cost = min(len(w), LONG_WORD) * len(w)
        if part and (len(part) == RUN_WORDS or rows + cost > RUN_ROWS):
            yield part
            part, rows = [], 0
        part.append(w)
        rows += cost
    if part:
        yield part


def _cut(text: str) -> list[str]:
    if "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or _ODD_SPACE.search(text):
        return _CUT.split(text)
    return text.split(" ")


RESULT = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()),
                       T.StructField("decoded", T.BinaryType())])
DIGEST = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
                       T.StructField("decoded_sha256", T.StringType())])


#: The worker process's last codec and what it was made for; later tasks of the process find the words learned so far.
_own: tuple[tuple, Codec] | None = None


def own_codec(key: tuple, ranks: Callable[[], dict[bytes, int]], pattern: str) -> Codec:
    """The process's codec for the key, made anew if it served another rank file or pattern."""
    global _own
    if _own is None or _own[0] != key:
        _own = None
        _own = key, Codec(ranks(), pattern)
    return _own[1]


def codec(spark: SparkSession, path: str, pattern: str = PATTERN, digest: bool = False):
    """Column function: text -> struct of n_tokens, ids and decoded bytes, or with ``digest`` their SHA-256 in hex.

    The rank file (about a megabyte, whatever the corpus) is read once on the driver and broadcast. Special tokens are
    ordinary text. A null or empty text has no tokens. Texts are encoded whole, however long.
    """
    ranks = read_ranks(path)
    sent = spark.sparkContext.broadcast(ranks)
    key = hashlib.sha256(repr(list(ranks.items())).encode()).hexdigest(), pattern

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        collecting = gc.isenabled()
        gc.disable()  # millions of short-lived lists, none in a cycle
        try:
            own = own_codec(key, lambda: sent.value, pattern)
            for column in parts:
                out: list = []
                waiting: list[str] = []
                chars = 0

                def flush() -> None:
                    for ids, plain in own.texts(waiting):
                        if digest:
                            ids, plain, n = hashlib.sha256(ids).hexdigest(), hashlib.sha256(plain).hexdigest(), len(ids) // 4
                        else:
                            n = len(ids) // 4
                        out.append((n, ids, plain))
                    waiting.clear()

                for x in column:
                    waiting.append(x.as_py() or "")
                    chars += len(waiting[-1])
                    if chars >= RUN_CHARS:
                        flush()
                        chars = 0
                flush()
                kind = pa.string() if digest else pa.binary()
                fields = (DIGEST if digest else RESULT).names
                yield pa.StructArray.from_arrays(
                    [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], kind), pa.array([x[2] for x in out], kind)], fields)
        finally:
            if collecting:  # the worker serves other stages too
                gc.enable()

    def column(text: Column) -> Column:
        return F.arrow_udf(run, DIGEST if digest else RESULT)(text.cast("string"))
    return column


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """key and the fields of RESULT (or DIGEST), one row per row of ``df``; nothing is shuffled. Repeated rows and null ids
    are encoded like any other; an empty table gives no rows; other columns are not read."""
    rows = df.select(F.col(f"`{key}`").alias("doc_id"), codec(df.sparkSession, path, digest=digest)(F.col(f"`{text}`")).alias("p"))
    return rows.select("doc_id", "p.*")
