"""Filters, de-duplication, quarantine."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rankspark.functions.scalar import EXACT_OR_UPPER, p_activity, parse_censored


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def size_filters(records: DataFrame, limits: dict[str, tuple[float, float]], group: Sequence[str],
                 distinct="fragment", min_group: int = 2) -> DataFrame:
    """ranges on size columns, then groups with fewer than ``min_group`` distinct fragments are dropped."""
    for c, (lo, hi) in limits.items():
        records = records.where(F.col(c).between(lo, hi))
    # one counted row per (group, fragment) first: the distinct count never sees raw duplicates
    big = (records.select(*group, distinct).distinct().groupBy(*group).agg(F.count("*").alias("_n"))
           .where(F.col("_n") >= min_group).drop("_n"))
    return records.join(big, list(group), "left_semi")


def valid_record(relation, value, kind, kinds: Sequence[str], *required) -> Column:
    """exact relation, known type, castable number and present ids."""
    ok = (_c(relation) == "=") & _c(kind).isin(list(kinds)) & _c(value).try_cast("double").isNotNull()
    for r in required:
        ok = ok & _c(r).isNotNull()
    return F.coalesce(ok, F.lit(False))


def active_measurements(df: DataFrame, keep: Sequence[str], endpoints: dict[str, str],
                        threshold: float = 6.0) -> DataFrame:
    """Wide endpoint texts to rows; only values that are active for certain survive."""
    cells = F.array(*[F.struct(F.lit(e).alias("endpoint"), parse_censored(c).alias("m")) for e, c in endpoints.items()])
    p = df.select(*keep, F.explode(cells).alias("_c")).select(*keep, "_c.endpoint", "_c.m.relation", "_c.m.value")
    p = p.where(F.col("value").isNotNull() & F.col("relation").isin(EXACT_OR_UPPER))
    return (p.withColumnRenamed("value", "value_nm").withColumn("pactivity", p_activity("value_nm"))
            .where(F.col("pactivity") >= threshold))


def dedupe(df: DataFrame, keys: Sequence[str], order: Sequence[str], last: bool = False) -> DataFrame:
    """first (or last) row per key by an explicit order, as an aggregate with map-side combine."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    return (df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")
            .select(*df.columns))


def tag_reasons(df: DataFrame, reasons: Sequence[tuple[str, Column]], duplicate_keys: Sequence[str],
                order: Sequence[str]) -> DataFrame:
    """first failing rule per row; of the rows that pass, all but the first per key are duplicates."""
    why = F.lit(None).cast("string")
    for name, cond in reversed(list(reasons)):
        why = F.when(cond, name).otherwise(why)
    tagged = df.withColumn("reason", why)
    first = (tagged.where(F.col("reason").isNull()).groupBy(*duplicate_keys)
             .agg(F.min(F.struct(*order)).alias("_first")))
    dup = F.col("reason").isNull() & (F.struct(*order) != F.col("_first"))
    return (tagged.join(first, list(duplicate_keys), "left")
            .withColumn("reason", F.when(dup, "duplicate").otherwise(F.col("reason"))).drop("_first"))


def reason_counts(tagged: DataFrame) -> DataFrame:
    return tagged.groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


def quarantine(df: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows kept, rows set aside)."""
    k = ids.select(key).distinct()
    return df.join(k, key, "left_anti"), df.join(k, key, "left_semi")


def drop_nonheldout_positives(test: DataFrame, heldout: DataFrame, column: str, label="label") -> DataFrame:
    """positives whose value is not held out are removed, never turned into negatives."""
    h = heldout.select(column).distinct().withColumn("_h", F.lit(True))
    return (test.join(h, column, "left")
            .where(~((F.col(label) == 1) & F.col("_h").isNull())).drop("_h").select(*test.columns))


def collapse_category(df: DataFrame, train: DataFrame, column: str, min_rows: int = 500, min_positive: int = 20,
                      label="label", out="category") -> DataFrame:
    """Categories below train support become ``__OTHER__``, nulls ``__MISSING__``."""
    name = F.coalesce(F.col(column).cast("string"), F.lit("__MISSING__"))
    kept = (train.groupBy(name.alias("_c")).agg(F.count("*").alias("_n"), F.sum(label).alias("_p"))
            .where((F.col("_n") >= min_rows) & (F.col("_p") >= min_positive)).select("_c"))
    return (df.withColumn("_name", name).join(kept, F.col("_name") == F.col("_c"), "left")
            .withColumn(out, F.coalesce("_c", F.lit("__OTHER__"))).drop("_c", "_name"))


def top_n_other(df: DataFrame, column: str, n: int = 50, out="category") -> DataFrame:
    """The n most frequent categories, the rest ``OTHER``."""
    top = (df.groupBy(column).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), column).limit(n)
           .select(F.col(column).alias("_c")))
    return (df.join(F.broadcast(top), F.col(column) == F.col("_c"), "left")
            .withColumn(out, F.coalesce("_c", F.lit("OTHER"))).drop("_c"))


def frequency_bin(queries: DataFrame, counts: DataFrame, train_flag: str, positives="candidate",
                  query="query_id") -> DataFrame:
    """Mean train frequency of a query's positives against the train tertiles."""
    from rankspark.operators.quantiles import exact_quantiles
    f = queries.join(counts, positives, "left").na.fill(0, ["n"])
    per = f.groupBy(query, train_flag).agg(F.avg("n").alias("mean_freq"))
    cut = exact_quantiles(per.where(F.col(train_flag)), "mean_freq", [1 / 3, 2 / 3], names=["a", "b"])
    limits = cut.select(F.struct("a", "b").alias("s"))
    m = F.col("mean_freq")
    return (per.withColumn("_s", limits.scalar())
            .withColumn("freq_bin", F.when(m <= F.col("_s.a"), "rare").when(m <= F.col("_s.b"), "medium")
                        .otherwise("frequent")).drop("_s"))
