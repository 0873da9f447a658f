"""Train-only counts, priors with back-off, and candidate expansion."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rankspark.session import BROADCAST_ROWS, broadcast_when_small, cut_lineage

SALTS = 8
#: Rows of the long matrix that one task expands, so that sorts by query stay in memory at every size.
CELLS_PER_TASK = 400_000


def freq_priors(positives: DataFrame, levels: dict[str, list[str]] | None = None,
                candidate="candidate") -> DataFrame:
    """A1: positive counts at several key levels, one pass with grouping sets.

    Returns level, the key columns (null where the level does not use them), candidate, n.
    """
    levels = levels or {"global": [], "context": ["context"], "anchor": ["anchor"],
                        "anchor_context": ["anchor", "context"]}
    keys = sorted({k for ks in levels.values() for k in ks})
    sets = [[F.col(k) for k in ks] + [F.col(candidate)] for ks in levels.values()]
    g = positives.groupingSets(sets, *keys, candidate).agg(
        F.count("*").alias("n"), F.grouping_id(*keys, candidate).alias("_g"))
    name = F.lit(None).cast("string")
    for level, ks in levels.items():
        bits = sum(1 << (len(keys) - i) for i, k in enumerate(keys) if k not in ks)
        name = F.when(F.col("_g") == bits, level).otherwise(name)
    return g.select(name.alias("level"), *keys, candidate, F.col("n").cast("bigint").alias("n"))


def freq_score(positives: DataFrame, frame: DataFrame, candidate="candidate", out="score_freq") -> DataFrame:
    """A2: train count over the largest count; 0 for unseen candidates."""
    counts, _ = broadcast_when_small(positives.groupBy(candidate).agg(F.count("*").cast("double").alias("_n")))
    top = counts.agg(F.max("_n"))
    return (frame.join(counts, candidate, "left")
            .withColumn(out, F.coalesce(F.col("_n"), F.lit(0.0)) / F.coalesce(top.scalar(), F.lit(1.0)))
            .drop("_n"))


def freq_variants(positives: DataFrame, candidate="candidate", anchor="anchor") -> DataFrame:
    """A3: log, tf-idf, diversity and concentration forms of the candidate count."""
    c = positives.groupBy(candidate).agg(F.count("*").cast("double").alias("c"),
                                         F.countDistinct(anchor).cast("double").alias("df"))
    stats = positives.agg(F.countDistinct(anchor).cast("double"))
    c = c.withColumn("_n", stats.scalar()).withColumn("_max", c.agg(F.max("c")).scalar())
    return c.select(candidate, "c", "df",
                    (F.log1p("c") / F.log1p("_max")).alias("log_freq"),
                    (F.col("c") / F.col("_max") * F.log(F.col("_n") / (1 + F.col("df")))).alias("tfidf"),
                    (F.col("df") / (F.col("_n") + 1)).alias("diversity"),
                    (F.col("c") / F.col("df") / F.col("_max")).alias("concentration"))


def success_matrix(positives: DataFrame, anchor="anchor", candidate="candidate") -> DataFrame:
    """A4: share of each candidate among its anchor's positives, kept sparse."""
    cell = positives.groupBy(anchor, candidate).agg(F.count("*").alias("n"))
    row = cell.groupBy(anchor).agg(F.sum("n").alias("_t"))
    return cell.join(row, anchor).select(anchor, candidate, "n", (F.col("n") / F.col("_t")).alias("share"))


def train_vocab(positives: DataFrame, context="context", candidate="candidate") -> DataFrame:
    """(context, candidate) pairs seen in train with their frequency."""
    return positives.groupBy(context, candidate).agg(F.count("*").alias("freq"))


def vocab_table(positives: DataFrame, context="context", candidate="candidate") -> DataFrame:
    """Candidate, frequency, sorted list and number of its contexts."""
    per = positives.groupBy(candidate, context).agg(F.count("*").alias("_n"))
    return per.groupBy(candidate).agg(
        F.sum("_n").alias("freq"), F.array_join(F.array_sort(F.collect_list(context)), ";").alias("contexts"),
        F.count("*").alias("n_contexts"))


def expand_candidates(queries: DataFrame, vocab: DataFrame, positives: DataFrame, query="query_id",
                      context="context", candidate="candidate", label="label", carry: Sequence[str] = (),
                      salts: int = SALTS, max_vocab: int = BROADCAST_ROWS, cells: int = CELLS_PER_TASK) -> DataFrame:
    """Every query with the vocabulary of its context; the full vocabulary when the context is unseen.

    The query table is written with each query's set of positives: every pass over the matrix starts from that short table.
    It is repartitioned by query before it grows, into so many parts that none grows to more than about ``cells`` rows.
    A vocabulary of at most ``max_vocab`` counted rows is broadcast: the long matrix is produced in place, already clustered
    by query, and later windows need no exchange and sort no more than a part. Otherwise it is an equi-join on (context, salt): a query takes one salt, the
    vocabulary is repeated per salt, so a context holding a third of the queries is spread.
    Unseen contexts share the key of the full vocabulary.
    """
    by_context = vocab.select(F.concat(F.lit("c|"), F.col(context)).alias("_k"), candidate, *carry)
    everything = (vocab.groupBy(candidate).agg(*[F.sum(c).alias(c) for c in carry]) if carry
                  else vocab.select(candidate).distinct()).select(F.lit("all").alias("_k"), candidate, *carry)
    v, small = broadcast_when_small(by_context.unionByName(everything), max_vocab)
    seen = v.select("_k").distinct().withColumnRenamed("_k", "_seen")
    pos = positives.groupBy(query).agg(F.collect_set(candidate).alias("_pos"))
    own = F.concat(F.lit("c|"), F.col(context))
    q = (queries.join(pos, query, "left").join(seen, own == F.col("_seen"), "left")
         .withColumn("_k", F.coalesce("_seen", F.lit("all"))).drop("_seen"))
    least = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    longest = v.groupBy("_k").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    q = cut_lineage(q)
    q = q.repartition(max(least, -(-q.count() * longest // cells)), query)
    hit = F.coalesce(F.array_contains("_pos", F.col(candidate)), F.lit(False))
    if small:
        cells = q.join(v, "_k")
    else:
        q = q.withColumn("_s", F.pmod(F.xxhash64(query), F.lit(salts)).cast("int"))
        v = v.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        cells = q.join(v, ["_k", "_s"]).drop("_s")
    return cells.withColumn(label, F.when(hit, 1).otherwise(0)).drop("_k", "_pos")


def conditional_priors(matrix: DataFrame, alpha: float = 1.0, label="label", candidate="candidate",
                       levels: dict[str, list[str]] | None = None) -> DataFrame:
    """Exposure, positives, smoothed rate and logit per level; smoothing pulls to the global positive rate."""
    levels = levels or {"P0": [], "P1": ["context"], "P2": ["anchor"], "P4": ["anchor", "context"]}
    keys = sorted({k for ks in levels.values() for k in ks})
    sets = [[F.col(k) for k in ks] + [F.col(candidate)] for ks in levels.values()]
    g = matrix.groupingSets(sets, *keys, candidate).agg(
        F.count("*").cast("bigint").alias("exposure"), F.sum(label).cast("bigint").alias("positives"),
        F.grouping_id(*keys, candidate).alias("_g"))
    name = F.lit(None).cast("string")
    for level, ks in levels.items():
        bits = sum(1 << (len(keys) - i) for i, k in enumerate(keys) if k not in ks)
        name = F.when(F.col("_g") == bits, level).otherwise(name)
    base = matrix.agg(F.avg(F.col(label).cast("double")))
    rate = (F.col("positives") + alpha * F.col("_base")) / (F.col("exposure") + alpha)
    return (g.withColumn("_base", base.scalar()).withColumn("rate", rate)
            .select(name.alias("level"), *keys, candidate, "exposure", "positives", "rate",
                    F.log(F.col("rate") / (1 - F.col("rate"))).alias("logit")))


def lookup_priors(frame: DataFrame, priors: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Left joins of prior tables; columns become ``<level>_logit``, ``_rate``, ``_exposure``.

    No broadcast hint: a prior table grows with the vocabulary, Spark broadcasts it only while it is small.
    """
    for level, (table, on) in priors.items():
        t = table.select(*on, F.col("logit").alias(f"{level}_logit"), F.col("rate").alias(f"{level}_rate"),
                         F.col("exposure").cast("double").alias(f"{level}_exposure"))
        frame = frame.join(t, on, "left")
    return frame


def backoff_cascade(frame: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Logit, support and rate of the first level that has a prior."""
    pick = lambda part: F.coalesce(*[F.col(f"{lv}_{part}") for lv in levels])
    level = F.lit(None).cast("string")
    for lv in reversed(levels):
        level = F.when(F.col(f"{lv}_logit").isNotNull(), lv).otherwise(level)
    return (frame.withColumn("backoff_level", level).withColumn("backoff_logit", pick("logit"))
            .withColumn("backoff_support", pick("exposure")).withColumn("backoff_rate", pick("rate")))


def prior_coverage(frame: DataFrame, levels: Sequence[str]) -> DataFrame:
    return frame.agg(F.count("*").alias("rows"), *[
        F.avg(F.col(f"{lv}_logit").isNotNull().cast("double")).alias(f"{lv}_coverage") for lv in levels])


def continuation_prior(frame: DataFrame, top: str, levels: Sequence[str], mix_with: str) -> DataFrame:
    """Confidence mix at the top level, discounts of ln 2, ln 4, ln 8 below it, and PMI differences."""
    peak = frame.agg(F.greatest(F.max(F.coalesce(F.col(f"{top}_exposure"), F.lit(0.0))), F.lit(10.0)))
    f = frame.withColumn("_peak", peak.scalar())
    conf = F.least(F.coalesce(F.col(f"{top}_exposure"), F.lit(0.0)) / F.col("_peak"), F.lit(1.0))
    value = F.when(F.col(f"{top}_logit").isNotNull(),
                   conf * F.col(f"{top}_logit") + (1 - conf) * F.col(f"{mix_with}_logit"))
    for i, lv in enumerate(levels, 1):
        value = value.when(F.col(f"{lv}_logit").isNotNull(), F.col(f"{lv}_logit") - F.log(F.lit(float(2 ** i))))
    f = f.withColumn("continuation", value)
    chain = [top, *levels]
    for a, b in zip(chain, chain[1:]):
        f = f.withColumn(f"pmi_{a}_{b}", F.col(f"{a}_logit") - F.col(f"{b}_logit"))
    return f.drop("_peak")


def direct_prior(queries: DataFrame, edges: DataFrame, template="template", candidate="candidate") -> DataFrame:
    """Strongest edge weight of the same template."""
    best = edges.groupBy(template, candidate).agg(F.max("weight").alias("direct_prior"))
    return queries.join(best, [template, candidate], "left").na.fill(0.0, ["direct_prior"])


def most_conservative(entries: DataFrame, keys: Sequence[str], severity: Sequence[str], column: str,
                      carry: Sequence[str]) -> DataFrame:
    """The worst entry per key; ``severity`` lists the worst value first."""
    order = F.array_position(F.array(*[F.lit(s) for s in severity]), F.col(column))
    known = F.when(order == 0, F.lit(len(severity) + 1)).otherwise(order)
    return (entries.groupBy(*keys).agg(F.min_by(F.struct(column, *carry), F.struct(known, *carry)).alias("_e"))
            .select(*keys, "_e.*"))


def zero_fill(metrics: DataFrame, universe: DataFrame, key="query_id", columns: Sequence[str] = ()) -> DataFrame:
    """One row per key of the universe, missing metrics as 0."""
    return universe.select(key).distinct().join(metrics, key, "left").na.fill(0, list(columns))


def candidate_set_sizes(matrix: DataFrame, by: Sequence[str], query="query_id") -> DataFrame:
    """Mean, median, p90 and maximum of the candidates per query."""
    n = matrix.groupBy(*by, query).agg(F.count("*").alias("n"))
    return n.groupBy(*by).agg(F.count("*").alias("queries"), F.avg("n").alias("mean_size"),
                              F.percentile("n", 0.5).alias("p50"), F.percentile("n", 0.9).alias("p90"),
                              F.max("n").alias("max_size"))


def prior_support(frame: DataFrame, support: str, carry: Sequence[str] = (), query="query_id") -> DataFrame:
    """Support statistics per query."""
    return frame.groupBy(query).agg(
        *[F.min(c).alias(c) for c in carry], F.percentile(support, 0.5).alias("median_support"),
        F.avg(support).alias("mean_support"), F.percentile(support, 0.9).alias("p90_support"),
        F.max(support).alias("max_support"))


def softmax_scores(frame: DataFrame, score: str, temperature: float, query="query_id", out="softmax") -> DataFrame:
    """Softmax of score over temperature in the query, maximum subtracted."""
    from pyspark.sql import Window
    w = Window.partitionBy(query)
    f = frame.withColumn("_e", F.exp((F.col(score) - F.max(score).over(w)) / temperature))
    return f.withColumn(out, F.col("_e") / F.sum("_e").over(w)).drop("_e")
