"""Near-duplicate classes by fast similarity sketching.

A sketch has ``BANDS * ROWS`` coordinates. In round i every shingle is placed into one hashed bin with the value
i + uniform; from round t on the bin is i - t itself, so all t coordinates are filled after 2t rounds at the latest, and
with t log t shingles after about one. Each coordinate keeps its least value, which two sets share with a probability
equal to their similarity. Bands of coordinates propose links and the full shingle sets confirm them.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankspark.llm.common import slices, texts, utf8, written
from rankspark.llm.words import mix, shingles, word_hashes

#: 25 bands of 4: a pair of similarity 0.8 is missed with a probability of 2e-6, one of 0.85 with 1e-8.
BANDS, ROWS = 25, 4
BINS = BANDS * ROWS
_ODD = mix(np.arange(1, 2 * BINS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
_FOLD = mix(np.arange(100, 100 + BINS, dtype=np.uint64)).reshape(BANDS, ROWS) | np.uint64(1)


def sketch(elements: np.ndarray) -> np.ndarray:
    """The sketch of a non-empty set of 64-bit hashes. Later rounds cannot lower a bin filled earlier."""
    out = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
    at, step = 0, 1
    while at < 2 * BINS:
        rounds = np.arange(at, min(at + step, 2 * BINS), dtype=np.uint64)
        h = mix((elements[None, :] ^ _ODD[rounds.astype(np.int64)][:, None]) * np.uint64(0x9E3779B97F4A7C15))
        bins = np.where(rounds[:, None] < BINS, ((h >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32),
                        rounds[:, None] - np.uint64(BINS))
        values = (rounds[:, None] << np.uint64(48)) | (mix(h) >> np.uint64(16))
        np.minimum.at(out, bins.ravel().astype(np.int64), values.ravel())
        at += step
        if out.max() < np.iinfo(np.uint64).max:
            break
        step = max(1, min(8 * step, (1 << 18) // max(len(elements), 1)))
    return out


def bands(sketched: np.ndarray) -> np.ndarray:
    folded = (mix(sketched.reshape(BANDS, ROWS)) * _FOLD).sum(axis=1, dtype=np.uint64)
    return mix(folded + np.arange(BANDS, dtype=np.uint64))


SKETCH = T.StructType([T.StructField("node", T.LongType()), T.StructField("n", T.LongType()),
                       T.StructField("s1", T.LongType()), T.StructField("s2", T.LongType()),
                       T.StructField("bands", T.ArrayType(T.LongType()))])


def sets_of(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = utf8(column)
    for lo, hi in slices(offsets):
        words, _, _, rows = word_hashes(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
        hashes, at = shingles(words, rows, size)
        for i in range(hi - lo):
            yield np.unique(hashes[at[i]:at[i + 1]])


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """node, n (set size), s1 and s2 (128-bit name of the set), bands. A null id is the least long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, names, flat, ends = [], [], [], [0]
            for e in sets_of(batch.column(1), size):
                n.append(len(e))
                if len(e):
                    names.append((mix(e ^ np.uint64(0xA5A5)).sum(dtype=np.uint64), mix(e + np.uint64(0x5A5A)).sum(dtype=np.uint64)))
                    flat.append(bands(sketch(e)))
                else:
                    names.append((np.uint64(0), np.uint64(0)))
                ends.append(len(flat) * BANDS)
            key = np.array(names, np.uint64).reshape(-1, 2).view(np.int64)
            values = np.concatenate(flat).view(np.int64) if flat else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(key[:, 0]), pa.array(key[:, 1]),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int64()))],
                names=["node", "n", "s1", "s2", "bands"])
    return docs.select(F.coalesce("key", F.lit(-(1 << 63))).alias("key"), "text").mapInArrow(run, SKETCH)


def confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """a, b of ``pairs`` with the exact shared and joint set sizes and whether they are linked.

    Only texts of paired documents travel. A document in many pairs is a skewed key of two plain equi-joins, which Spark
    splits at run time; nothing is gathered per document.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))
                    for x, y in zip(sets_of(batch.column(2), size), sets_of(batch.column(3), size), strict=True)]
            got = np.array(both, np.int64).reshape(-1, 3)
            union = got[:, 1] + got[:, 2] - got[:, 0]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(got[:, 0]), pa.array(union),
                 pa.array(100 * got[:, 0] >= percent * union)], names=["a", "b", "shared", "joint", "linked"])
    text = docs.select(F.coalesce("key", F.lit(-(1 << 63))).alias("key"), "text")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    # repeated rows of one id: any of them, by the least text
    text = text.join(ids, "key", "left_semi").groupBy("key").agg(F.min("text").alias("text"))
    text = written(text, "paired-texts")
    left = text.select(F.col("key").alias("a"), F.col("text").alias("text_a"))
    right = text.select(F.col("key").alias("b"), F.col("text").alias("text_b"))
    return (pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
            .mapInArrow(run, "a long, b long, shared long, joint long, linked boolean"))


def components(edges: DataFrame) -> DataFrame:
    """node, component (least node reachable) of every node in ``edges`` (a, b).

    Alternates joining larger neighbours and smaller neighbours to a node's least neighbour until nothing changes. A hub
    is one key of a plain join and of partial aggregates; each round is written.
    """
    def least(e: DataFrame) -> DataFrame:
        return e.groupBy("a").agg(F.min("b").alias("m"))

    e = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = (both.join(least(both), "a").select(F.col("b").alias("x"), F.least("a", "m").alias("m"), "a")
                 .where("x > a").select(F.col("x").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        large = written(large, "edges")
        small = (large.join(least(large), "a")
                 .select(F.explode(F.array(F.struct("b", F.col("m")), F.struct(F.col("a").alias("b"), F.col("m")))).alias("p"))
                 .select(F.col("p.b").alias("a"), F.col("p.m").alias("b")).where("a <> b").distinct())
        e = written(small, "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before == now:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def open_pairs(open_docs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """a, b: pairs of ``open_docs`` (rep, n, component, apart) that may be linked and are not yet connected.

    Each set is ordered from its rarest shingle (among these documents) to its commonest. A linked pair shares a shingle
    within the first n - least overlap + 1 of both, and the overlap cannot exceed what is left after the first shared one:
    in a group of near copies, whose common shingles come last, only sets with a rare shingle in common meet. Exact.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(sets_of(batch.column(1), size))
            ids = np.repeat(batch.column(0).to_numpy(), [len(x) for x in sets])
            flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(flat)], names=["rep", "shingle"])
    text = (docs.select(F.coalesce("key", F.lit(-(1 << 63))).alias("rep"), "text").join(open_docs.select("rep"), "rep", "left_semi")
            .groupBy("rep").agg(F.min("text").alias("text")))
    rows = written(text.mapInArrow(run, "rep long, shingle long"), "open-shingles")
    shared = rows.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    rows = rows.join(shared, "shingle")
    held = rows.groupBy("rep").agg(F.count("*").alias("held"))  # the others are rarer still: they come first
    order = Window.partitionBy("rep").orderBy("df", "shingle")
    firsts = written(
        rows.withColumn("k", F.row_number().over(order)).join(open_docs.join(held, "rep"), "rep")
        .withColumn("at", F.col("n") - F.col("held") + F.col("k")).where(f"100 * (n - at + 1) >= {percent} * n")
        .select("shingle", "rep", "n", "at", "component", "apart"), "firsts")
    x = firsts.where("apart").select("shingle", *[F.col(c).alias(f"{c}_x") for c in ("rep", "n", "at", "component")])
    y = firsts.select("shingle", *[F.col(c).alias(f"{c}_y") for c in ("rep", "n", "at", "component")])
    enough = f"{100 + percent} * (least(n_x - at_x, n_y - at_y) + 1) >= {percent} * (n_x + n_y)"
    return (x.join(y, "shingle").where("component_x <> component_y").where(enough)
            .select(F.greatest("rep_x", "rep_y").alias("a"), F.least("rep_x", "rep_y").alias("b")).distinct())


def links(sketched: DataFrame, docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(classes, edges): every set with its class's least node (s1, s2, rep), and confirmed links between reps.

    Equal sets are one class first. In each band bucket every class is compared with the bucket's least class. A pair that
    this leaves open - in different components, and not ruled out because distance is a metric: |d(x, least) - d(y, least)|
    is at most d(x, y) - is then compared itself. So a large group of near copies costs its size, not its square.
    """
    classes = written(sketched.where("n > 0").groupBy("s1", "s2").agg(
        F.min("node").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")), "classes")
    rows = classes.select("rep", "n", F.explode("bands").alias("bucket"))
    leader = (rows.groupBy("bucket").agg(F.min(F.struct("rep", "n")).alias("l"), F.max("rep").alias("most"))
              .where("most > l.rep").select("bucket", F.col("l.rep").alias("leader"), F.col("l.n").alias("leader_n")))
    members = written(rows.join(leader, "bucket"), "members")
    near = f"100 * least(n, leader_n) >= {percent} * greatest(n, leader_n)"
    stars = members.where("rep <> leader").where(near).select(F.col("rep").alias("a"), F.col("leader").alias("b")).distinct()
    tested = written(confirmed(stars, docs, size, percent), "tested")
    edges = tested.where("linked").select("a", "b")
    part = written(components(edges), "parts")

    known = members.join(part.withColumnRenamed("node", "rep"), "rep", "left").withColumn(
        "component", F.coalesce("component", "rep"))
    open_buckets = (known.groupBy("bucket").agg(F.min("component").alias("c0"), F.max("component").alias("c1"),
                                                F.count("*").alias("size")).where("c0 < c1 and size > 2").select("bucket"))
    home = part.select(F.col("node").alias("leader"), F.col("component").alias("home"))
    rest = known.join(open_buckets, "bucket", "left_semi").join(home, "leader", "left")
    rest = written(rest.groupBy("rep", "n", "component").agg(
        F.max(F.col("component") != F.coalesce("home", "leader")).alias("apart")), "open")
    pairs = open_pairs(rest, docs, size, percent)
    pairs = written(pairs, "open-pairs")
    more = confirmed(pairs, docs, size, percent).where("linked").select("a", "b")
    return classes.select("s1", "s2", "rep"), edges.unionByName(written(more, "more"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``df``: doc_id, n_shingles, component_id (least id reachable by links), kept.

    Two documents are linked if 100 * shared >= percent * joint distinct shingles of ``size`` words. Rows without words
    (null, empty, blank) have no shingles and are components of their own. Rows that repeat an id
    give a row each, judged by its own text; where two texts have the same least id, links are confirmed on the lesser
    text. A null id comes before all others and is returned as null. Ties do not occur: components are named by the least
    id. An empty table gives no rows; other columns are not read.
    """
    docs = texts(df, key, text)
    sketched = written(sketches(docs, size), "sketches")
    classes, edges = links(sketched, docs, size, percent)
    parts = components(edges)
    null = F.lit(-(1 << 63))
    joined = sketched.select("node", "n", "s1", "s2").join(classes, ["s1", "s2"], "left").withColumn(
        "rep", F.coalesce("rep", "node"))
    out = joined.join(parts.withColumnRenamed("node", "rep"), "rep", "left").withColumn(
        "component", F.coalesce("component", "rep"))
    return out.select(F.nullif("node", null).alias("doc_id"), F.col("n").alias("n_shingles"),
                      F.nullif("component", null).alias("component_id"), (F.col("node") == F.col("component")).alias("kept"))
