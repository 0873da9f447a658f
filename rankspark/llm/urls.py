"""URL verdicts: longest-prefix rules first, else exact membership in a block list by a Bloom filter cascade.

Level 1 encodes the listed keys. Over the complete universe of keys that the corpus holds, its false positives are known, so
level 2 encodes those; level 3 encodes the listed keys that level 2 takes for false positives, and so on until a level has
none. Walking the levels then answers membership exactly for every key of the universe, without a join.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark.llm.common import written

HASHES, BITS_PER_KEY = 4, 8
#: A level's words are one value of the plan: at most so many bits (4 MB). Longer lists take a semi-join.
MOST_BITS = 1 << 25
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): what follows the first ``://`` up to ``/ ? #``, A-Z lower-cased, and then up to ``? #``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def suffixes(host: Column) -> Column:
    """A host and its parent domains, longest first."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def _bit(key: Column, level: int, i: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level * HASHES + i)), F.lit(bits))


class Level:
    """One Bloom filter as a one-row table of 64-bit words."""

    def __init__(self, keys: DataFrame, n: int, level: int):
        self.level = level
        self.bits = 64 * max(1, -(-n * BITS_PER_KEY // 64))
        spark = keys.sparkSession
        set_bits = keys.select(F.explode(F.array(*[_bit(F.col("key"), level, i, self.bits) for i in range(HASHES)])).alias("b"))
        words = set_bits.groupBy(F.floor(F.col("b") / 64).alias("id")).agg(
            F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("b") % 64).cast("int"))).alias("w"))
        dense = spark.range(0, self.bits // 64, 1, 1).join(words, "id", "left").select(
            F.struct("id", F.coalesce("w", F.lit(0).cast("long")).alias("w")).alias("p"))
        self.row = written(dense.agg(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["w"]).alias("words")), "bloom")

    def holds(self, key: Column, words: Column) -> Column:
        out = F.lit(True)
        for i in range(HASHES):
            b = _bit(key, self.level, i, self.bits)
            word = F.get(words, F.floor(b / 64).cast("int"))
            out = out & (F.call_function("shiftright", word, (b % 64).cast("int")).bitwiseAND(1) == 1)
        return out


def cascade(listed: DataFrame, universe: DataFrame) -> list[Level] | None:
    """Levels for the keys of ``listed`` within ``universe`` (column ``key`` each), or None if they exceed MOST_BITS."""
    listed = written(listed.select(F.col("key").cast("string").alias("key")).dropna().distinct(), "listed")
    universe = universe.select("key").distinct()
    if listed.count() * BITS_PER_KEY > MOST_BITS:
        return None
    own = written(universe.join(listed, "key", "left_semi"), "keys")
    other = written(universe.join(listed, "key", "left_anti"), "keys")
    levels: list[Level] = []
    n = own.count()
    while n or not levels:
        level = Level(own, n, len(levels))
        levels.append(level)
        passing = other.select("key", level.row.scalar().alias("words")).where(level.holds(F.col("key"), F.col("words")))
        own, other = written(passing.select("key"), "keys"), own
        n = own.count()
        if n * BITS_PER_KEY > MOST_BITS:
            return None
    return levels


def member(levels: Sequence[Level], key: Column) -> Column:
    """Whether a key of the universe is listed; level i's words are in the column ``bloom_i``."""
    out = F.lit(len(levels) % 2 == 1)
    for i in reversed(range(len(levels))):
        out = F.when(levels[i].holds(key, F.col(f"bloom_{i}")), out).otherwise(F.lit(i % 2 == 1))
    return out


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], listed: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, listed: one row per row of ``pages``.

    ``rules`` are (verdict, host, path). A rule fits its host and all subdomains if the path starts with the rule's; the
    longest host and path win (ties: the first given), else the verdict is ``block`` for listed hosts (or hosts with a
    listed parent domain) and ``allow`` for others. A null url, or one without ``://``, has an empty host and path, fits no
    rule and is not listed. Repeated rows and null ids are judged like any other; an empty table gives no rows; other
    columns are not read.
    """
    host, path = parts(F.col(f"`{url}`").cast("string"))
    rows = pages.select(F.col(f"`{key}`").alias("page_id"), host.alias("host"), path.alias("path"))
    universe = rows.select("host").distinct().select(F.explode(suffixes(F.col("host"))).alias("key")).where("key <> ''")
    levels = cascade(listed, universe)
    if levels is None:
        hosts = rows.select("host").distinct().select("host", F.explode(suffixes(F.col("host"))).alias("key"))
        hit = hosts.join(listed.select("key").distinct(), "key", "left_semi").select("host").distinct().withColumn("listed", F.lit(True))
        rows = rows.join(hit, "host", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    else:
        rows = rows.select("*", *[x.row.scalar().alias(f"bloom_{i}") for i, x in enumerate(levels)])
        known = F.exists(suffixes(F.col("host")), lambda k: (k != "") & member(levels, k))
        rows = rows.withColumn("listed", known).drop(*[f"bloom_{i}" for i in range(len(levels))])
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("listed"), "block").otherwise("allow")
    for says, h, p in reversed(sorted(rules, key=lambda x: -len(x[1] + x[2]))):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "listed")


def keys(spark: SparkSession, values: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(x,) for x in values], "key string")
