"""Mapping of the star-schema test tables to the library's inputs, and the same in SQL for the checks.

query = customer, anchor = nation, context = market segment, candidate = part type and size,
train = orders before ``TRAIN_END``, label = bought afterwards.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rankspark.functions.hashing import tie_key
from rankspark.functions.scalar import content_score, pair_deltas
from rankspark.functions.bits import packed_tanimoto, packed_phi
from rankspark.operators.priors import expand_candidates, train_vocab
from rankspark.operators.ranking import rank_candidates
from rankspark.session import broadcast_when_small

TRAIN_END = "1999-09-01"


_SCHEMAS: dict[str, T.StructType] = {}


def table(spark: SparkSession, d: str, name: str, *cols: str) -> DataFrame:
    """One of the given tables. The schema is inferred once per path and then passed to the reader."""
    path = f"{d}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    df = spark.read.schema(_SCHEMAS[path]).parquet(path)
    return df.select(*cols) if cols else df


def purchases(spark: SparkSession, d: str) -> DataFrame:
    """One row per order line with the ranking keys."""
    li = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
               "l_extendedprice", "l_discount")
    orders = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    cust = table(spark, d, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    part = table(spark, d, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    return (li.join(orders, li.l_orderkey == orders.o_orderkey)
            .join(cust, F.col("o_custkey") == cust.c_custkey)
            .join(part, li.l_partkey == part.p_partkey)
            .select(F.concat(F.lit("q"), "o_custkey").alias("query_id"),
                    F.concat(F.lit("n"), "c_nationkey").alias("anchor"),
                    F.col("c_mktsegment").alias("context"),
                    F.concat_ws(":", "p_type", "p_size").alias("candidate"),
                    (F.col("o_orderdate") < F.lit(TRAIN_END).cast("timestamp_ntz")).alias("is_train"),
                    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                    "l_discount", "o_orderdate", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"))


PURCH = f"""purch AS (
 SELECT 'q'||o_custkey AS query_id, 'n'||c_nationkey AS anchor, c_mktsegment AS context,
  p_type||':'||p_size AS candidate, o_orderdate < TIMESTAMP '{TRAIN_END}' AS is_train,
  l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, o_orderdate,
  p_name, p_brand, p_type, p_size, p_retailprice
 FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey
 JOIN part ON l_partkey=p_partkey)"""


def train_positives(spark, d) -> DataFrame:
    return (purchases(spark, d).where("is_train")
            .select("query_id", "anchor", "context", "candidate").distinct())


def test_positives(spark, d) -> DataFrame:
    return purchases(spark, d).where("not is_train").select("query_id", "candidate").distinct()


POS = """pos AS (SELECT DISTINCT query_id, anchor, context, candidate FROM purch WHERE is_train),
tpos AS (SELECT DISTINCT query_id, candidate FROM purch WHERE NOT is_train),
vocab AS (SELECT DISTINCT context, candidate FROM pos)"""


def query_table(spark, d) -> DataFrame:
    return table(spark, d, "customer", "c_custkey", "c_nationkey", "c_mktsegment").select(
        F.concat(F.lit("q"), "c_custkey").alias("query_id"),
        F.concat(F.lit("n"), "c_nationkey").alias("anchor"),
        F.col("c_mktsegment").alias("context"))


def matrix(spark, d) -> DataFrame:
    """Candidate matrix: query_id, anchor, context, candidate, label."""
    return expand_candidates(query_table(spark, d), train_vocab(train_positives(spark, d)),
                             test_positives(spark, d))


MATRIX = """qt AS (SELECT 'q'||c_custkey AS query_id, 'n'||c_nationkey AS anchor, c_mktsegment AS context FROM customer),
m AS (SELECT qt.query_id, qt.anchor, qt.context, v.candidate,
  CASE WHEN t.candidate IS NULL THEN 0 ELSE 1 END AS label
 FROM qt JOIN vocab v ON qt.context=v.context
 LEFT JOIN tpos t ON t.query_id=qt.query_id AND t.candidate=v.candidate)"""


def _level_counts(pos: DataFrame, keys: list[str], name: str) -> DataFrame:
    return pos.groupBy(*keys).agg(F.count("*").cast("double").alias(name))


def scored(spark, d, profile: DataFrame | None = None) -> DataFrame:
    """Matrix with two train-only scores: context frequency and anchor frequency. ``profile`` holds further columns of a query."""
    pos = train_positives(spark, d)
    queries = query_table(spark, d)
    if profile is not None:
        queries = queries.join(profile, "query_id", "left")
    m = expand_candidates(queries, train_vocab(pos), test_positives(spark, d), carry=["freq"])
    level, _ = broadcast_when_small(_level_counts(pos, ["anchor", "candidate"], "score_b"))
    return (m.join(level, ["anchor", "candidate"], "left")
            .select(*queries.columns, "candidate", "label",
                    F.col("freq").cast("double").alias("score_a"),
                    F.coalesce("score_b", F.lit(0.0)).alias("score_b")))


SCORED = """cc AS (SELECT context, candidate, count(*)::DOUBLE AS score_a FROM pos GROUP BY ALL),
ac AS (SELECT anchor, candidate, count(*)::DOUBLE AS score_b FROM pos GROUP BY ALL),
sc AS (SELECT m.*, coalesce(score_a,0.0) AS score_a, coalesce(score_b,0.0) AS score_b,
  md5(m.query_id||'|'||m.candidate) AS tie
 FROM m LEFT JOIN cc ON cc.context=m.context AND cc.candidate=m.candidate
 LEFT JOIN ac ON ac.anchor=m.anchor AND ac.candidate=m.candidate)"""


def ranked(spark, d) -> DataFrame:
    """Scored matrix with both ranks; one exchange by query serves both windows."""
    df = scored(spark, d)
    df = rank_candidates(df, "score_a", "rank_a")
    return rank_candidates(df, "score_b", "rank_b")


RANKED = """rk AS (SELECT *,
  row_number() OVER (PARTITION BY query_id ORDER BY score_a DESC, tie, candidate) AS rank_a,
  row_number() OVER (PARTITION BY query_id ORDER BY score_b DESC, tie, candidate) AS rank_b FROM sc)"""


def _bit(c: str):
    """Bit position 0..59 of a word, as a one-bit mask."""
    pos = F.pmod(F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("bigint"), F.lit(60)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), pos)


def _cents_avg(c: str):
    """Mean of a two-digit decimal column through whole cents: the same for any order of addition."""
    return F.sum(F.round(F.col(c) * 100).cast("bigint")).cast("double") / (F.count(c) * 100.0)


def cents_sql(c: str) -> str:
    return f"sum(round({c}*100)::BIGINT)::DOUBLE/(count({c})*100.0::DOUBLE)"


def candidate_profile(spark, d) -> DataFrame:
    """Per candidate: packed word set of its part names and five properties."""
    p = purchases(spark, d).where("is_train")
    return p.groupBy("candidate").agg(
        F.bit_or(_bit("p_name")).alias("c_bits"),
        F.max("p_size").cast("double").alias("c1"),
        F.countDistinct("p_brand").cast("double").alias("c2"),
        _cents_avg("p_retailprice").alias("c3"), _cents_avg("l_discount").alias("c4"),
        _cents_avg("l_quantity").alias("c5"))


def query_profile(spark, d) -> DataFrame:
    p = purchases(spark, d).where("is_train")
    return p.groupBy("query_id").agg(
        F.bit_or(_bit("p_name")).alias("q_bits"),
        F.max("p_size").cast("double").alias("q1"),
        F.countDistinct("p_brand").cast("double").alias("q2"),
        _cents_avg("p_retailprice").alias("q3"), _cents_avg("l_discount").alias("q4"),
        _cents_avg("l_quantity").alias("q5"))


def featured(spark, d, base: DataFrame | None = None) -> DataFrame:
    """Matrix with sim, phi, d1..d5; queries without history get zero features."""
    own = query_profile(spark, d)
    df = scored(spark, d, own) if base is None else base.join(own, "query_id", "left")
    profile, _ = broadcast_when_small(candidate_profile(spark, d))
    df = df.join(profile, "candidate", "left")
    deltas = pair_deltas([f"q{i}" for i in range(1, 6)], [f"c{i}" for i in range(1, 6)])
    df = df.select("query_id", "anchor", "context", "candidate", "label", "score_a", "score_b",
                   packed_tanimoto("q_bits", "c_bits").alias("sim"),
                   packed_phi("q_bits", "c_bits", 60).alias("phi"),
                   *[x.alias(f"d{i}") for i, x in enumerate(deltas, 1)]).na.fill(
        0.0, ["sim", "phi", "d1", "d2", "d3", "d4", "d5"])
    return df.withColumn("score_c", content_score())


def _sql_profile(key: str, letter: str) -> str:
    return f"""SELECT {key},
  bit_or((1::BIGINT) << ((('0x'||substr(md5(p_name),1,8))::BIGINT % 60)::INT)) AS {letter}_bits,
  max(p_size)::DOUBLE AS {letter}1, count(DISTINCT p_brand)::DOUBLE AS {letter}2,
  {cents_sql('p_retailprice')} AS {letter}3, {cents_sql('l_discount')} AS {letter}4,
  {cents_sql('l_quantity')} AS {letter}5 FROM purch WHERE is_train GROUP BY {key}"""


FEATURED = f"""cprof AS ({_sql_profile('candidate', 'c')}),
qprof AS ({_sql_profile('query_id', 'q')}),
ft0 AS (SELECT sc.*, bit_count(q_bits & c_bits)::DOUBLE AS bi, bit_count(q_bits)::DOUBLE AS bq,
  bit_count(c_bits)::DOUBLE AS bc, q1,q2,q3,q4,q5,c1,c2,c3,c4,c5
 FROM sc LEFT JOIN cprof ON cprof.candidate=sc.candidate LEFT JOIN qprof ON qprof.query_id=sc.query_id),
ft1 AS (SELECT query_id, anchor, context, candidate, label, score_a, score_b, tie,
  coalesce(bi/greatest(bq+bc-bi,0.001),0.0) AS sim,
  coalesce(CASE WHEN bq*bc*(60.0::DOUBLE-bq)*(60.0::DOUBLE-bc) > 0
   THEN (60.0::DOUBLE*bi-bq*bc)/sqrt(bq*bc*(60.0::DOUBLE-bq)*(60.0::DOUBLE-bc)) ELSE 0.0 END,0.0) AS phi,
  coalesce(abs(c1-q1),0.0) AS d1, coalesce(abs(c2-q2),0.0) AS d2,
  coalesce(abs(c3-q3)/greatest(q3,1.0),0.0) AS d3, coalesce(abs(c4-q4)/greatest(abs(q4)+1.0,1.0),0.0) AS d4,
  coalesce(abs(c5-q5)/greatest(q5+1.0,1.0),0.0) AS d5 FROM ft0),
ft AS (SELECT *, 0.75::DOUBLE*sim + 0.25::DOUBLE*(1.0::DOUBLE/(1.0::DOUBLE+d1+d2+d3+d4)) AS score_c FROM ft1)"""


def fragments(spark, d, core: str = "l_orderkey") -> DataFrame:
    """Fragment records: core, context (return flag and status), fragment (type and size), entity (part)."""
    li = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus",
               "l_extendedprice", "l_quantity", "l_shipdate")
    part = table(spark, d, "part", "p_partkey", "p_type", "p_size", "p_name")
    return li.join(part, li.l_partkey == part.p_partkey).select(
        F.col(core).cast("string").alias("core"),
        F.concat_ws("|", "l_returnflag", "l_linestatus").alias("context"),
        F.concat_ws(":", "p_type", "p_size").alias("fragment"),
        F.col("l_partkey").alias("entity"), F.col("p_size").alias("size"), F.col("p_type").alias("kind"),
        F.col("l_suppkey").alias("target"), F.col("l_extendedprice").alias("amount"),
        F.col("l_quantity").alias("quantity"), "l_shipdate", "p_name")


FRAG = """fr AS (SELECT l_orderkey::VARCHAR AS core, l_suppkey::VARCHAR AS core_s,
  l_returnflag||'|'||l_linestatus AS context,
  p_type||':'||p_size AS fragment, l_partkey AS entity, p_size AS size, p_type AS kind, l_suppkey AS target,
  l_extendedprice AS amount, l_quantity AS quantity, l_shipdate, p_name
 FROM lineitem JOIN part ON l_partkey=p_partkey)"""

WITH = "WITH " + ",\n".join([PURCH, POS, MATRIX, SCORED, RANKED, FEATURED, FRAG])


def sql(body: str, ctes: str = "") -> str:
    """Check query over the shared fixture tables, with further ``ctes``."""
    return WITH + (",\n" + ctes if ctes else "") + "\n" + body


def ranked_c(spark, d) -> DataFrame:
    df = featured(spark, d)
    for s in "abc":
        df = rank_candidates(df, f"score_{s}", f"rank_{s}")
    return df


RANKED_C = """rc AS (SELECT *,
  row_number() OVER (PARTITION BY query_id ORDER BY score_a DESC, tie, candidate) AS rank_a,
  row_number() OVER (PARTITION BY query_id ORDER BY score_b DESC, tie, candidate) AS rank_b,
  row_number() OVER (PARTITION BY query_id ORDER BY score_c DESC, tie, candidate) AS rank_c FROM ft)"""
