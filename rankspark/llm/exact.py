"""Exact duplicates by an index of live digests: cuckoo filters over shards of digests, with the stored keys beside them.

A shard is a cuckoo table: two buckets of four slots per digest, a slot holds a 16-bit fingerprint and the place of its
stored key. Inserts move residents to their other bucket; when that does not end, the table overflows and is rebuilt twice
as large from the stored keys, which a bare filter could not do. A fingerprint hit counts only if the stored digest is the
same in full, so false hits change nothing and deletes remove the right slot.

Digests are aggregated before they move, so a text with any number of copies is one key. Rows that ask for their group are
spread over as many pieces as their shard has rows to serve; each piece carries a copy of that one shard, whose size is
bounded by the number of shards.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark.llm.common import written
from rankspark.llm.words import mix

#: Slots of a bucket, moves before an insert counts as overflow, stored keys aimed at per shard, rows per probing task.
SLOTS, MOVES, SHARD_KEYS, PIECE = 4, 500, 50_000, 200_000

STATE = "shard long, buckets long, prints binary, places binary, digests binary, n binary, keep binary, has_keep binary, keep_row binary"
ENTRY = "digest binary, key long, row long"


class CuckooTable:
    """A cuckoo filter of 256-bit digests with its stored keys; places of deleted keys are used again."""

    def __init__(self, buckets: int = 2) -> None:
        self.buckets = buckets
        self.prints = [0] * (buckets * SLOTS)
        self.places = [-1] * (buckets * SLOTS)
        self.digests = np.zeros((0, 32), np.uint8)
        self.used = np.zeros(0, bool)

    @staticmethod
    def hashed(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint (from 1), first bucket and distance to the second, before they are cut to the number of buckets."""
        words = np.ascontiguousarray(digests).view("<u8").reshape(-1, 4)
        prints = (words[:, 1] % np.uint64(65535) + np.uint64(1)).astype(np.int64)
        return prints, words[:, 0], mix(prints.astype(np.uint64))

    def __len__(self) -> int:
        return int(self.used.sum())

    def find(self, digests: np.ndarray) -> np.ndarray:
        """The place of each digest's stored key, -1 if it is not live. Every hit is verified in full."""
        out = np.full(len(digests), -1)
        prints, first, shift = self.hashed(digests)
        table, places, mask = np.array(self.prints), np.array(self.places), np.uint64(self.buckets - 1)
        for bucket in (first & mask, (first ^ shift) & mask):
            for slot in range(SLOTS):
                at = bucket.astype(np.int64) * SLOTS + slot
                hit = np.flatnonzero((table[at] == prints) & (out < 0))
                hit = hit[(self.digests[places[at[hit]]] == digests[hit]).all(axis=1)]
                out[hit] = places[at[hit]]
        return out

    def insert(self, digests: np.ndarray) -> np.ndarray:
        """Stores digests that are new and distinct; returns their places."""
        free = np.flatnonzero(~self.used)[:len(digests)]
        more = len(digests) - len(free)
        places = np.concatenate([free, len(self.used) + np.arange(more)]).astype(np.int64)
        self.digests = np.concatenate([self.digests, np.zeros((more, 32), np.uint8)])
        self.used = np.concatenate([self.used, np.zeros(more, bool)])
        self.digests[places], self.used[places] = digests, True
        if not self._place(places):
            self._resize()
        return places

    def _place(self, places: np.ndarray) -> bool:
        mask, prints, table = self.buckets - 1, self.prints, self.places
        p, first, shift = self.hashed(self.digests[places])
        moves = {}
        for place, print_, bucket, step in zip(places.tolist(), p.tolist(), first.tolist(), shift.tolist(), strict=True):
            bucket &= mask
            for turn in range(MOVES):
                for b in (bucket, (bucket ^ step) & mask):
                    at = b * SLOTS
                    if 0 in prints[at:at + SLOTS]:
                        at += prints[at:at + SLOTS].index(0)
                        prints[at], table[at] = print_, place
                        break
                else:  # both are full: take a resident's slot and find that one a new bucket
                    at = b * SLOTS + turn % SLOTS
                    prints[at], print_, table[at], place = print_, prints[at], place, table[at]
                    step = moves.setdefault(print_, int(mix(np.array([print_], np.uint64))[0]))
                    bucket = (b ^ step) & mask
                    continue
                break
            else:
                return False
        return True

    def _resize(self) -> None:
        """Twice the buckets until all stored keys fit."""
        live = np.flatnonzero(self.used)
        while True:
            self.buckets *= 2
            self.prints, self.places = [0] * (self.buckets * SLOTS), [-1] * (self.buckets * SLOTS)
            if self._place(live):
                return

    def delete(self, digests: np.ndarray) -> np.ndarray:
        """Takes live digests out; returns the places of their keys. Digests that are not live are passed over."""
        places = self.find(digests)
        places = places[places >= 0]
        table = np.array(self.places)
        for at in np.flatnonzero(np.isin(table, places) & (np.array(self.prints) > 0)).tolist():
            self.prints[at], self.places[at] = 0, -1
        self.used[places] = False
        return places


def _numbers(column: pa.ChunkedArray, kind: str = "<i8") -> np.ndarray:
    return np.frombuffer(column[0].as_py(), kind)


def _stacked(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


class Shard:
    """A cuckoo table with group size, kept id and kept row per stored key, as one row of the state."""

    def __init__(self, state: pa.Table) -> None:
        self.table = CuckooTable()
        self.n, self.keep, self.has_keep, self.keep_row = (np.zeros(0, t) for t in ("<i8", "<i8", bool, "<i8"))
        if state.num_rows:
            t = self.table
            t.buckets = state["buckets"][0].as_py()
            t.prints, t.places = (_numbers(state[c]).tolist() for c in ("prints", "places"))
            t.digests = _stacked(state["digests"]).copy()
            self.n, self.keep, self.keep_row = (_numbers(state[c]).copy() for c in ("n", "keep", "keep_row"))
            self.has_keep = _numbers(state["has_keep"], "?").copy()
            t.used = self.n > 0

    def update(self, changes: pa.Table) -> None:
        """Sets group size and kept row of each changed digest; a size of 0 deletes it."""
        digests, n = _stacked(changes["digest"]), changes["n"].to_numpy()
        self.table.delete(digests[n == 0])
        live = np.flatnonzero(n > 0)
        places = self.table.find(digests[live])
        new = places < 0
        places[new] = self.table.insert(digests[live[new]])
        more = len(self.table.used) - len(self.n)
        self.n, self.keep, self.has_keep, self.keep_row = (
            np.concatenate([x, np.zeros(more, x.dtype)]) for x in (self.n, self.keep, self.has_keep, self.keep_row))
        keep = changes["keep"].combine_chunks()
        self.n[places], self.keep_row[places] = n[live], changes["keep_row"].fill_null(0).to_numpy()[live]
        self.keep[places], self.has_keep[places] = keep.fill_null(0).to_numpy()[live], keep.is_valid().to_numpy(zero_copy_only=False)[live]
        self.n[~self.table.used] = 0

    def state(self, shard: int) -> pa.Table:
        t = self.table
        columns = [np.array(t.prints), np.array(t.places), t.digests, self.n, self.keep, self.has_keep, self.keep_row]
        names = [c.split()[0] for c in STATE.split(", ")]
        return pa.Table.from_arrays([pa.array([shard]), pa.array([t.buckets]), *(pa.array([c.tobytes()], pa.binary()) for c in columns)], names=names)


def _updated(key: tuple, state: pa.Table, changes: pa.Table) -> pa.Table:
    one = Shard(state)
    one.update(changes)
    return one.state(key[0].as_py())


def _probed(key: tuple, state: pa.Table, asked: pa.Table) -> pa.Table:
    names = ["row", "n", "keep", "keep_row"]
    if not asked.num_rows:
        return pa.table({c: pa.array([], pa.int64()) for c in names})
    one = Shard(state)
    at = one.table.find(_stacked(asked["digest"]))
    gone = at < 0
    n, row = (np.zeros(len(at), np.int64) if not len(x) else np.where(gone, 0, x[at]) for x in (one.n, one.keep_row))
    keep = pa.array(one.keep[at], mask=gone | ~one.has_keep[at]) if len(one.n) else pa.nulls(len(at), pa.int64())
    return pa.Table.from_arrays([asked["row"], pa.array(n), keep, pa.array(row)], names=names)


def digested(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """digest, key, row of every row, written once: a null text is the empty one, ``row`` numbers the rows."""
    return written(df.select(F.unhex(F.sha2(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), 256)).alias("digest"),
                             F.col(f"`{key}`").cast("long").alias("key"), F.monotonically_increasing_id().alias("row")), "digests")


def _groups(entries: DataFrame) -> DataFrame:
    top = F.max(F.struct("key", "row"))
    return entries.groupBy("digest").agg(F.count("*").alias("n"), top["key"].alias("keep"), top["row"].alias("keep_row"))


class LiveIndex:
    """The live rows and the sharded cuckoo index over their digests. Each change gives a new index over written tables;
    the old one stays readable, so a job that is run again starts from the same state."""

    def __init__(self, entries: DataFrame, state: DataFrame, shards: int) -> None:
        self.entries, self.state, self.shards = entries, state, shards

    @classmethod
    def empty(cls, spark: SparkSession) -> LiveIndex:
        return cls(spark.createDataFrame([], ENTRY), spark.createDataFrame([], STATE), 1)

    @classmethod
    def of(cls, entries: DataFrame) -> LiveIndex:
        """The index of written rows."""
        return cls.empty(entries.sparkSession)._changed(entries, written(_groups(entries), "changes"))

    def _shard(self, df: DataFrame) -> DataFrame:
        return df.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(self.shards)))

    def _changed(self, entries: DataFrame, changes: DataFrame) -> LiveIndex:
        keys = changes.count()
        if self.shards > 1 or not self.state.isEmpty():
            keys += self.state.agg(F.coalesce(F.sum(F.length("digests")) / 32, F.lit(0))).first()[0]
        wanted = 1 << max(0, int(keys // SHARD_KEYS)).bit_length()
        if wanted > 2 * self.shards and not self.state.isEmpty():  # the shards themselves have outgrown their bound: all keys anew
            return LiveIndex.of(entries)
        new = LiveIndex(entries, self.state, wanted if self.state.isEmpty() else self.shards)
        pairs = new.state.groupBy("shard").cogroup(new._shard(changes).groupBy("shard"))
        new.state = written(pairs.applyInArrow(_updated, STATE), "shards")
        return new

    def insert(self, df: DataFrame, key: str = "doc_id", text: str = "text") -> LiveIndex:
        """Adds every row; a row inserted twice counts twice."""
        batch = digested(df, key, text)
        entries = written(self.entries.unionByName(batch), "entries")
        return self._changed(entries, self._affected(entries, batch))

    def delete(self, df: DataFrame, key: str = "doc_id", text: str = "text") -> LiveIndex:
        """Takes out all live rows of equal key and text; others are passed over."""
        batch = digested(df, key, text).select("digest", "key").distinct()
        gone = batch.select(F.col("digest").alias("gone_digest"), F.col("key").alias("gone_key"))
        entries = written(self.entries.join(gone, F.col("digest").eqNullSafe(F.col("gone_digest")) & F.col("key").eqNullSafe(F.col("gone_key")), "left_anti"), "entries")
        return self._changed(entries, self._affected(entries, batch))

    @staticmethod
    def _affected(entries: DataFrame, batch: DataFrame) -> DataFrame:
        found = batch.select("digest").distinct().join(_groups(entries), "digest", "left")
        return written(found.withColumn("n", F.coalesce("n", F.lit(0))), "changes")

    def lookup(self, asked: DataFrame) -> DataFrame:
        """``asked`` (digest, key, row; ``row`` distinct) with n, keep, keep_row of its live group; n is 0 if there is none.

        A shard with many askers is asked in pieces of about PIECE rows.
        """
        asked = self._shard(asked)
        load = asked.groupBy("shard").count().select("shard", F.ceil(F.col("count") / PIECE).alias("pieces"))
        load = written(load, "load")  # one short row per shard
        of = asked.select("shard", "digest", "row").join(load, "shard")
        of = of.select("shard", F.pmod(F.xxhash64("row"), F.col("pieces")).alias("piece"), "digest", "row")
        held = self.state.join(load, "shard").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1))).drop("pieces")
        pairs = held.groupBy("shard", "piece").cogroup(of.groupBy("shard", "piece"))
        return pairs.applyInArrow(_probed, "row long, n long, keep long, keep_row long")


def exact_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, keep_id, group_size, kept, text_sha256 of every row: rows of identical text form a group, that of the largest key stays.

    Null texts equal empty ones. Null keys sort lowest; among rows that repeat key and text one stays, so every group keeps
    exactly one row. Other columns are not read, an empty table gives no rows, and only digests of texts are moved.
    """
    asked = digested(df, key, text)
    found = LiveIndex.of(asked).lookup(asked)
    # the answers go back to their rows by number, evenly spread
    rows = asked.join(found, "row")
    kind = df.schema[key].dataType
    return rows.select(F.col("key").cast(kind).alias(key), F.col("keep").cast(kind).alias("keep_id"), F.col("n").alias("group_size"),
                       (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
