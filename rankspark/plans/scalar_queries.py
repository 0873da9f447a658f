"""Sources, projections and filters over the test tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from rankspark.functions import hashing as H
from rankspark.functions import scalar as S
from rankspark.functions.scalar import r6
from rankspark.operators import filters as FL
from rankspark.operators import quantiles as Q
from rankspark.plans import fixtures as fx
from rankspark.plans.registry import query
from rankspark.session import broadcast_when_small
from rankspark.sources import audit as A
from rankspark.sources import tables as TB

# texts with censor signs built from order lines
RAW = """raw AS (SELECT *, CASE l_linenumber % 7 WHEN 0 THEN '< '||l_quantity::INT WHEN 1 THEN '>'||(l_quantity::INT*40)
  WHEN 2 THEN '=1,'||(100+l_quantity::INT) WHEN 3 THEN ' ~'||(l_quantity::INT*40)||' ' WHEN 4 THEN 'n/a'
  WHEN 5 THEN (l_quantity::INT)||'.5e1' ELSE '<='||(l_quantity::INT*60) END AS raw_a,
  CASE WHEN l_discount > 0.05 THEN ''||(l_quantity::INT*100) ELSE 'x'||l_quantity::INT END AS raw_b FROM lineitem),
parsed AS (SELECT *, CASE WHEN lower(trim(raw_a)) NOT IN ('','na','n/a','nan','none','null')
   THEN regexp_extract(replace(trim(raw_a),',',''), '^(<=|>=|<|>|=|~)?\\s*([0-9]*\\.?[0-9]+(?:[eE][-+]?\\d+)?)', 2) END AS va,
  regexp_extract(replace(trim(raw_a),',',''), '^(<=|>=|<|>|=|~)?\\s*([0-9]*\\.?[0-9]+(?:[eE][-+]?\\d+)?)', 1) AS ra,
  regexp_extract(replace(trim(raw_b),',',''), '^(<=|>=|<|>|=|~)?\\s*([0-9]*\\.?[0-9]+(?:[eE][-+]?\\d+)?)', 2) AS vb,
  regexp_extract(replace(trim(raw_b),',',''), '^(<=|>=|<|>|=|~)?\\s*([0-9]*\\.?[0-9]+(?:[eE][-+]?\\d+)?)', 1) AS rb
  FROM raw),
meas AS (SELECT l_orderkey, l_partkey, 'A' AS endpoint, CASE WHEN ra IN ('','~') THEN '=' ELSE ra END AS relation, try_cast(va AS DOUBLE) AS v FROM parsed
 UNION ALL SELECT l_orderkey, l_partkey, 'B', CASE WHEN rb IN ('','~') THEN '=' ELSE rb END, try_cast(vb AS DOUBLE) FROM parsed)"""


def raw_texts(spark, d):
    li = fx.table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount",
                  "l_extendedprice")
    q = F.col("l_quantity").cast("int")
    m = F.col("l_linenumber") % 7
    cat = lambda *xs: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in xs])
    raw_a = (F.when(m == 0, cat("< ", q)).when(m == 1, cat(">", q * 40)).when(m == 2, cat("=1,", q + 100))
             .when(m == 3, cat(" ~", q * 40, " ")).when(m == 4, "n/a").when(m == 5, cat(q, ".5e1"))
             .otherwise(cat("<=", q * 60)))
    raw_b = F.when(F.col("l_discount") > 0.05, cat("", q * 100)).otherwise(cat("x", q))
    return li.withColumn("raw_a", raw_a).withColumn("raw_b", raw_b)


@query("parse_censored", "P1", "WITH " + RAW + """
SELECT relation, count(*) AS n, sum(v) AS total FROM meas WHERE endpoint='A' AND v > 0 GROUP BY relation""")
def parse_censored(spark, d):
    m = raw_texts(spark, d).select(S.parse_censored("raw_a").alias("m")).where("m is not null")
    return m.groupBy(F.col("m.relation").alias("relation")).agg(F.count("*").alias("n"),
                                                                F.sum("m.value").alias("total"))


@query("active_measurements", "P2", "WITH " + RAW + """
SELECT endpoint, relation, count(*) AS n, round(avg(9.0::DOUBLE-log10(v)),6) AS mean_activity FROM meas
WHERE v > 0 AND relation IN ('=','<','<=') AND 9.0::DOUBLE-log10(v) >= 6.0 GROUP BY ALL""")
def active_measurements(spark, d):
    m = FL.active_measurements(raw_texts(spark, d), ["l_orderkey"], {"A": "raw_a", "B": "raw_b"})
    return m.groupBy("endpoint", "relation").agg(F.count("*").alias("n"), r6(F.avg("pactivity")).alias("mean_activity"))


@query("coalesced_key", "P3", """WITH k AS (SELECT p_partkey,
 array_to_string(list_distinct_ordered, '|') AS key, p_name FROM (SELECT *, list_filter([a,b,c], lambda x: x IS NOT NULL) AS l,
  CASE WHEN a IS NOT NULL AND a=b THEN list_filter([a,c], lambda x: x IS NOT NULL)
       WHEN b IS NOT NULL AND b=c THEN list_filter([a,b], lambda x: x IS NOT NULL)
       WHEN a IS NOT NULL AND a=c THEN list_filter([a,b], lambda x: x IS NOT NULL)
       ELSE list_filter([a,b,c], lambda x: x IS NOT NULL) END AS list_distinct_ordered
  FROM (SELECT *, CASE WHEN p_size%5=0 THEN NULL WHEN p_size%3=0 THEN p_type ELSE p_brand END AS a,
    CASE WHEN p_size%5=0 THEN NULL WHEN p_size%2=0 THEN p_type END AS b,
    CASE WHEN p_size%5=0 THEN NULL WHEN p_size%7=0 THEN p_brand END AS c FROM part)))
SELECT p_partkey, CASE WHEN key='' THEN 'name:'||substr(md5(p_name),1,24) ELSE key END AS key FROM k""")
def coalesced_key(spark, d):
    p = fx.table(spark, d, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size")
    live = F.col("p_size") % 5 != 0
    s = F.col("p_size")
    key = S.coalesced_key([(F.when(live & (s % 3 == 0), F.col("p_type")), F.when(live & (s % 3 != 0), F.col("p_brand"))),
                           (F.when(live & (s % 2 == 0), F.col("p_type")), F.lit(" ")),
                           (F.lit(None).cast("string"), F.when(live & (s % 7 == 0), F.col("p_brand")))], "p_name")
    return p.select("p_partkey", key.alias("key"))


@query("stable_ids", "P4", """SELECT o_orderkey, 'shop:'||substr(md5(o_custkey||'|'||o_orderpriority||'|'||o_orderkey),1,24) AS query_id,
 substr(md5(o_orderkey::VARCHAR),1,16) AS short_id FROM orders""")
def stable_ids(spark, d):
    return fx.table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderpriority").select(
        "o_orderkey", F.concat(F.lit("shop:"), H.stable_hash(24, "o_custkey", "o_orderpriority", "o_orderkey"))
        .alias("query_id"), H.stable_hash(16, "o_orderkey").alias("short_id"))


@query("text_keys", "P5", """WITH t AS (SELECT doc_id, trim(regexp_replace(coalesce(text,''),'\\s+',' ','g')) AS c,
 list_filter(list_transform(string_split(coalesce(lang,'')||'| |'||coalesce(source,'')||'||x', '|'), lambda e: trim(e)), lambda e: e<>'') AS parts FROM documents)
SELECT t.doc_id, md5(c) AS clean_md5, len(c) AS clean_length, len(parts)::BIGINT AS n_parts, array_to_string(parts,'|') AS piped,
 lang||'||'||source||'||'||t.doc_id AS key FROM t JOIN documents USING (doc_id)""")
def text_keys(spark, d):
    t = fx.table(spark, d, "documents", "doc_id", "text", "lang", "source")
    parts = S.parse_list(F.concat("lang", F.lit("| |"), "source", F.lit("||x")))
    c = S.clean_text("text")
    return t.select("doc_id", F.md5(c).alias("clean_md5"), F.length(c).cast("bigint").alias("clean_length"),
                    F.size(parts).cast("bigint").alias("n_parts"), S.pipe_join(parts).alias("piped"),
                    S.canonical_key("lang", "source", "doc_id").alias("key"))


@query("pair_deltas", "P6", fx.sql("SELECT context, count(*) AS n, " + ", ".join(
    f"round(avg(d{i}),6) AS d{i}" for i in range(1, 6)) + " FROM ft GROUP BY context"))
def pair_deltas(spark, d):
    return fx.featured(spark, d).groupBy("context").agg(
        F.count("*").alias("n"), *[r6(F.avg(f"d{i}")).alias(f"d{i}") for i in range(1, 6)])


@query("content_score", "P7", fx.sql("SELECT anchor, round(avg(sim),6) AS sim, round(avg(phi),6) AS phi, "
                                     "round(avg(score_c),6) AS content, round(max(score_c),6) AS best FROM ft GROUP BY anchor"))
def content_score(spark, d):
    return fx.featured(spark, d).groupBy("anchor").agg(
        r6(F.avg("sim")).alias("sim"), r6(F.avg("phi")).alias("phi"), r6(F.avg("score_c")).alias("content"),
        r6(F.max("score_c")).alias("best"))


@query("score_buckets", "P8", """WITH e AS (SELECT list_distinct_sorted AS edges FROM (SELECT
  list_sort(list_distinct(quantile_cont(l_extendedprice, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]))) AS list_distinct_sorted FROM lineitem
  WHERE l_linestatus='F'))
SELECT len(list_filter(edges[2:len(edges)-1], lambda x: x <= l_extendedprice))::INT AS bucket, count(*) AS n,
 round(min(l_extendedprice),6) AS lowest, round(max(l_extendedprice),6) AS highest FROM lineitem, e GROUP BY 1""")
def score_buckets(spark, d):
    li = fx.table(spark, d, "lineitem", "l_extendedprice", "l_linestatus")
    edges = Q.quantile_edges(li.where("l_linestatus = 'F'"), "l_extendedprice", 10)
    b = li.withColumn("_e", edges.scalar()).withColumn("bucket", S.assign_bucket("l_extendedprice", "_e"))
    return b.groupBy("bucket").agg(F.count("*").alias("n"), r6(F.min("l_extendedprice")).alias("lowest"),
                                   r6(F.max("l_extendedprice")).alias("highest"))


@query("qcut_rank", "P9", """SELECT o_orderkey, greatest(1, ceil((r-1)*4/(n-1)::DOUBLE))::INT AS bin FROM (SELECT o_orderkey,
 row_number() OVER (ORDER BY o_totalprice, md5('qcut|'||o_orderkey)) AS r, count(*) OVER () AS n FROM orders)""")
def qcut_rank(spark, d):
    return Q.qcut_rank(fx.table(spark, d, "orders", "o_orderkey", "o_totalprice"), "o_totalprice", ["o_orderkey"], 4
                       ).select("o_orderkey", "bin")


@query("fixed_bins", "P10", """SELECT CASE WHEN x>0 AND x<=0.3 THEN '<0.3' WHEN x>0.3 AND x<=0.4 THEN '0.3-0.4' WHEN x>0.4 AND x<=0.5 THEN '0.4-0.5'
  WHEN x>0.5 AND x<=0.6 THEN '0.5-0.6' WHEN x>0.6 AND x<=1.0 THEN '>0.6' END AS similarity_bin,
 CASE WHEN y>0 AND y<=10 THEN '0-10' WHEN y>10 AND y<=100 THEN '10-100' WHEN y>100 AND y<=1000 THEN '100-1K' WHEN y>1000 AND y<=10000 THEN '1K-10K' WHEN y>10000 THEN '10K+' END AS support_bin,
 CASE WHEN z>0 AND z<=1 THEN 'rank=1' WHEN z>1 AND z<=5 THEN 'rank=2-5' WHEN z>5 AND z<=10 THEN 'rank=6-10' WHEN z>10 AND z<=20 THEN 'rank=11-20' WHEN z>20 THEN 'rank>20' END AS rank_bin,
 count(*) AS n FROM (SELECT l_quantity/50.0::DOUBLE AS x, l_extendedprice/10.0::DOUBLE AS y, l_linenumber*l_linenumber AS z FROM lineitem) GROUP BY ALL""")
def fixed_bins(spark, d):
    li = fx.table(spark, d, "lineitem", "l_quantity", "l_extendedprice", "l_linenumber")
    return li.groupBy(S.similarity_bin(F.col("l_quantity") / 50.0).alias("similarity_bin"),
                      S.support_bin(F.col("l_extendedprice") / 10.0).alias("support_bin"),
                      S.rank_bin(F.col("l_linenumber") * F.col("l_linenumber")).alias("rank_bin")).agg(
        F.count("*").alias("n"))


@query("bands", "P11", """WITH x AS (SELECT l_discount*30.0::DOUBLE-2.0::DOUBLE AS delta, l_linenumber-1 AS f, (l_returnflag='R')::INT AS lab, l_linestatus FROM lineitem)
SELECT CASE WHEN delta>=0.5 THEN 'improved_delta_ge_0p5' WHEN delta>=-0.5 THEN 'retained_delta_ge_minus_0p5' WHEN delta<=-1.0 THEN 'degraded_delta_le_minus_1p0' ELSE 'ambiguous_delta_minus1p0_to_minus0p5' END AS band,
 CASE WHEN f=0 THEN '0' WHEN f=1 THEN '1' WHEN f<5 THEN '2-4' ELSE '5+' END AS freq_band,
 CASE WHEN lab=1 THEN '' WHEN f*3>=10 THEN 'high_freq_hard' WHEN f*3>=1 THEN 'random_same_attach' ELSE 'global_random' END AS neg_type,
 CASE WHEN l_linestatus='O' THEN 1 ELSE 0 END AS norm_label, count(*) AS n FROM x GROUP BY ALL""")
def bands(spark, d):
    li = fx.table(spark, d, "lineitem", "l_discount", "l_linenumber", "l_returnflag", "l_linestatus")
    f = F.col("l_linenumber") - 1
    return li.groupBy(S.activity_band(F.col("l_discount") * 30.0 - 2.0).alias("band"),
                      S.frequency_band(f).alias("freq_band"),
                      S.negative_type(f * 3, F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("neg_type"),
                      S.normalise_label(F.when(F.col("l_linestatus") == "O", "Positive ").otherwise("decoy"))
                      .alias("norm_label")).agg(F.count("*").alias("n"))


@query("collapse_category", "P12", fx.sql("""SELECT CASE WHEN n>=200 AND p>=20 THEN m.anchor ELSE '__OTHER__' END AS category,
 count(*) AS n, sum(label)::BIGINT AS positives FROM m JOIN k ON k.anchor=m.anchor GROUP BY 1""",
    "k AS (SELECT anchor, count(*) AS n, sum(label) AS p FROM m WHERE context IN ('BUILDING','MACHINERY') GROUP BY anchor)"))
def collapse_category(spark, d):
    m = fx.matrix(spark, d)
    c = FL.collapse_category(m, m.where(F.col("context").isin("BUILDING", "MACHINERY")), "anchor", 200, 20)
    seen = m.where(F.col("context").isin("BUILDING", "MACHINERY")).select("anchor").distinct()
    return c.join(seen, "anchor", "left_semi").groupBy("category").agg(
        F.count("*").alias("n"), F.sum("label").cast("bigint").alias("positives"))


@query("top_n_other", "P12", fx.sql("""SELECT coalesce(t.candidate,'OTHER') AS category, count(*) AS n FROM pos
 LEFT JOIN (SELECT candidate FROM pos GROUP BY candidate ORDER BY count(*) DESC, candidate LIMIT 50) t ON t.candidate=pos.candidate GROUP BY 1"""))
def top_n_other(spark, d):
    return FL.top_n_other(fx.train_positives(spark, d), "candidate", 50).groupBy("category").agg(F.count("*").alias("n"))


@query("frequency_bin", "P13", fx.sql("""SELECT query_id, is_train, round(mf,6) AS mean_freq,
 CASE WHEN mf<=a THEN 'rare' WHEN mf<=b THEN 'medium' ELSE 'frequent' END AS freq_bin FROM per, cuts""",
    """gf AS (SELECT candidate, count(*) AS n FROM pos GROUP BY 1),
per AS (SELECT query_id, is_train, avg(coalesce(n,0)::DOUBLE) AS mf FROM (SELECT DISTINCT query_id, is_train, candidate FROM purch) u
 LEFT JOIN gf USING (candidate) GROUP BY ALL),
cuts AS (SELECT quantile_cont(mf,1.0::DOUBLE/3) AS a, quantile_cont(mf,2.0::DOUBLE/3) AS b FROM per WHERE is_train)"""))
def frequency_bin(spark, d):
    counts = fx.train_positives(spark, d).groupBy("candidate").agg(F.count("*").alias("n"))
    used = fx.purchases(spark, d).select("query_id", "is_train", "candidate").distinct()
    return FL.frequency_bin(used, counts, "is_train").withColumn("mean_freq", r6("mean_freq"))


FLAGS = """cf0 AS (SELECT p_type||':'||p_size AS candidate, any_value(p_size) AS size, any_value(p_type) AS kind, """+fx.cents_sql("p_retailprice")+""" AS price FROM part GROUP BY 1),
cf AS (SELECT candidate, (price > (SELECT quantile_cont(price,0.95) FROM cf0))::INT AS reject, (size>40)::INT AS warning,
 (size%7=0)::INT AS geometry, (size<=30)::INT AS ready, (kind='PROMO' AND size<=2)::INT AS pending FROM cf0)"""


def candidate_flags(spark, d):
    c = (fx.table(spark, d, "part", "p_type", "p_size", "p_retailprice")
         .groupBy(F.concat_ws(":", "p_type", "p_size").alias("candidate"))
         .agg(F.max("p_size").alias("size"), F.max("p_type").alias("kind"), fx._cents_avg("p_retailprice").alias("price")))
    top = Q.exact_quantiles(c, "price", [0.95], names=["q"])
    f = lambda x: F.when(x, 1).otherwise(0)
    flags = c.withColumn("_q", top.scalar()).select(
        "candidate", f(F.col("price") > F.col("_q")).alias("reject"), f(F.col("size") > 40).alias("warning"),
        f(F.col("size") % 7 == 0).alias("geometry"), f(F.col("size") <= 30).alias("ready"),
        f((F.col("kind") == "PROMO") & (F.col("size") <= 2)).alias("pending"))
    return broadcast_when_small(flags)[0]


#: Labels of the tiers (fixed values).
PENDING_TIER, REJECT_TIER, EXPERT_TIER = "Tier0_DATA_PENDING", "Tier3_HARD_REJECT", "Tier2_EXPERT_REVIEW"
STANDARD_TIER, OTHER_TIER = "Tier1_STANDARD_REVIEW", "TierX_OTHER_REVIEWABLE"


def tier_rules(*more_for_experts):
    """Rules of the test flags; ``more_for_experts`` are further grounds for a closer look."""
    raised = {c: F.col(c) == 1 for c in ("pending", "reject", "warning", "geometry", "ready")}
    experts = F.greatest(raised["warning"], raised["geometry"], *more_for_experts)
    return {PENDING_TIER: raised["pending"], REJECT_TIER: raised["reject"], EXPERT_TIER: experts, STANDARD_TIER: raised["ready"]}


@query("action_tier", "P14", fx.sql("""SELECT CASE WHEN pending=1 THEN 'Tier0_DATA_PENDING' WHEN reject=1 THEN 'Tier3_HARD_REJECT'
 WHEN (rank_b<=50 AND rank_a>50) OR warning=1 OR geometry=1 THEN 'Tier2_EXPERT_REVIEW' WHEN ready=1 THEN 'Tier1_STANDARD_REVIEW'
 ELSE 'TierX_OTHER_REVIEWABLE' END AS tier, count(*) AS n, sum(label)::BIGINT AS positives FROM rk JOIN cf ON cf.candidate=rk.candidate
 WHERE rank_a<=50 OR rank_b<=50 GROUP BY 1""", FLAGS))
def action_tier(spark, d):
    r = fx.ranked(spark, d).where("rank_a <= 50 or rank_b <= 50").join(candidate_flags(spark, d), "candidate")
    tier = S.first_match(tier_rules((F.col("rank_b") <= 50) & (F.col("rank_a") > 50)), OTHER_TIER)
    return r.groupBy(tier.alias("tier")).agg(F.count("*").alias("n"), F.sum("label").cast("bigint").alias("positives"))


@query("review_bucket", "P15", """WITH x AS (SELECT CASE WHEN l_linenumber<7 THEN l_tax*25.0::DOUBLE END AS dist,
 CASE l_returnflag WHEN 'A' THEN true WHEN 'R' THEN false END AS clean, CASE WHEN l_linenumber<>6 THEN l_discount*6.0::DOUBLE END AS clash, l_quantity>40 AS w FROM lineitem)
SELECT CASE WHEN dist IS NULL THEN 'GENERATION_FAIL' WHEN clean=false OR clash>0.5 THEN 'HARD_CLASH'
 WHEN clean AND coalesce(clash<=0.5,true) AND dist<1.0 AND NOT w THEN 'REVIEW_READY'
 WHEN clean AND coalesce(clash<=0.5,true) AND dist<1.0 THEN 'GEOMETRY_OK_PROPERTY_SHIFT' WHEN w THEN 'NEEDS_MEDCHEM_REVIEW'
 WHEN clean AND coalesce(clash<=0.5,true) AND dist<2.0 THEN 'CLEAN_BUT_SEMANTIC_WARNING' WHEN dist>=2.0 AND clean THEN 'POOR_GEOMETRY'
 ELSE 'UNCLASSIFIED' END AS bucket, count(*) AS n FROM x GROUP BY 1""")
def review_bucket(spark, d):
    li = fx.table(spark, d, "lineitem", "l_linenumber", "l_tax", "l_returnflag", "l_discount", "l_quantity")
    far = F.when(F.col("l_linenumber") < 7, F.col("l_tax") * 25.0)
    clean = F.col("l_returnflag") == "A"
    bumps = F.when(F.col("l_linenumber") != 6, F.col("l_discount") * 6.0) > 0.5
    warned = F.col("l_quantity") > 40
    fits = clean & ~F.coalesce(bumps, F.lit(False))
    # labels are fixed values; the caller's order decides
    b = S.first_match({
        "GENERATION_FAIL": far.isNull(), "HARD_CLASH": (F.col("l_returnflag") == "R") | bumps,
        "REVIEW_READY": fits & (far < 1.0) & ~warned, "GEOMETRY_OK_PROPERTY_SHIFT": fits & (far < 1.0), "NEEDS_MEDCHEM_REVIEW": warned,
        "CLEAN_BUT_SEMANTIC_WARNING": fits & (far < 2.0), "POOR_GEOMETRY": clean & (far >= 2.0)}, "UNCLASSIFIED")
    return li.groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))


@query("interaction_features", "P16", fx.sql("""SELECT context, round(avg(sim*ln(1.0::DOUBLE+score_a)),6) AS i1, round(avg(sim*ln(1.0::DOUBLE+score_b)),6) AS i2,
 round(avg((d3+1.0::DOUBLE)/(d5+1.0::DOUBLE+1e-10)),6) AS i3, round(avg(d1*d1),6) AS i4 FROM ft GROUP BY context"""))
def interaction_features(spark, d):
    f = S.interaction_features("sim", F.log1p("score_a"), F.log1p("score_b"), F.col("d3") + 1.0, F.col("d5") + 1.0, "d1")
    return fx.featured(spark, d).groupBy("context").agg(*[r6(F.avg(x)).alias(f"i{i}") for i, x in enumerate(f, 1)])


EDGES = """edges AS (SELECT anchor AS template, candidate, """+fx.cents_sql("l_discount")+"""*20.0::DOUBLE-0.9::DOUBLE AS improvement, count(DISTINCT l_suppkey) AS n_sources
 FROM purch WHERE is_train GROUP BY ALL)"""


def edge_table(spark, d):
    p = fx.purchases(spark, d).where("is_train")
    return p.groupBy(F.col("anchor").alias("template"), "candidate").agg(
        (fx._cents_avg("l_discount") * 20.0 - 0.9).alias("improvement"),
        F.countDistinct("l_suppkey").alias("n_sources"))


@query("edge_weight", "P17", fx.sql("""SELECT template, round(avg(greatest(0.0::DOUBLE,improvement)*ln(1.0::DOUBLE+n_sources)),6) AS full_activity_publication, 1.0::DOUBLE AS uniform_edge,
 round(avg(greatest(0.0::DOUBLE,improvement)),6) AS activity_only, round(avg(ln(1.0::DOUBLE+n_sources)),6) AS publication_only FROM edges GROUP BY template""", EDGES))
def edge_weight(spark, d):
    return edge_table(spark, d).groupBy("template").agg(
        *[r6(F.avg(S.edge_weight(m, "improvement", "n_sources"))).alias(m) for m in S.EDGE_MODES])


@query("size_filters", "F1", "WITH " + fx.FRAG + """, k AS (SELECT * FROM fr WHERE size BETWEEN 5 AND 40 AND quantity BETWEEN 2 AND 45),
g AS (SELECT core, context FROM k GROUP BY ALL HAVING count(DISTINCT fragment)>=2)
SELECT k.context, count(*) AS n, count(DISTINCT k.core) AS cores FROM k JOIN g ON g.core=k.core AND g.context=k.context GROUP BY 1""")
def size_filters(spark, d):
    k = FL.size_filters(fx.fragments(spark, d), {"size": (5, 40), "quantity": (2, 45)}, ["core", "context"])
    return k.groupBy("context").agg(F.count("*").alias("n"), F.countDistinct("core").alias("cores"))


@query("valid_record", "F2", "WITH " + RAW + """ SELECT l_linenumber, count(*) AS n, sum((va IS NOT NULL AND ra IN ('','~','=') AND l_linenumber IN (2,3,4,5,6)
 AND try_cast(va AS DOUBLE) IS NOT NULL)::INT)::BIGINT AS valid FROM parsed GROUP BY 1""")
def valid_record(spark, d):
    t = raw_texts(spark, d).withColumn("m", S.parse_censored("raw_a"))
    ok = FL.valid_record("m.relation", F.col("m.value").cast("string"), F.col("l_linenumber").cast("string"),
                         ["2", "3", "4", "5", "6"], "l_partkey", "l_orderkey")
    return t.groupBy("l_linenumber").agg(F.count("*").alias("n"), F.sum(ok.cast("int")).cast("bigint").alias("valid"))


_ALL = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]


@query("dedupe_first_last", "F3", f"""SELECT kind, count(*) AS n, sum(l_partkey)::BIGINT AS part_sum, round(avg(l_extendedprice),6) AS mean_price FROM (
 SELECT 'first' AS kind, * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(_ALL)})=1
 UNION ALL SELECT 'last' AS kind, * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(c + ' DESC' for c in _ALL)})=1) GROUP BY kind""")
def dedupe_first_last(spark, d):
    li = fx.table(spark, d, "lineitem", "l_orderkey", "l_linenumber", *_ALL)
    both = None
    for kind in ("first", "last"):
        x = FL.dedupe(li, ["l_orderkey", "l_linenumber"], _ALL, last=kind == "last").withColumn("kind", F.lit(kind))
        both = x if both is None else both.unionByName(x)
    return both.groupBy("kind").agg(F.count("*").alias("n"), F.sum("l_partkey").alias("part_sum"),
                                    r6(F.avg("l_extendedprice")).alias("mean_price"))


@query("clean_with_counters", "F4", f"""WITH t AS (SELECT *, CASE WHEN l_discount=0 THEN 'parse_fail' WHEN l_quantity<5 THEN 'too_small' WHEN l_quantity>45 THEN 'too_large' END AS reason FROM lineitem),
u AS (SELECT CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY reason IS NULL, l_orderkey, l_linenumber ORDER BY {', '.join(_ALL)})>1 THEN 'duplicate' ELSE coalesce(reason,'valid') END AS reason FROM t)
SELECT reason, count(*) AS n FROM u GROUP BY 1""")
def clean_with_counters(spark, d):
    li = fx.table(spark, d, "lineitem", "l_orderkey", "l_linenumber", *_ALL)
    t = FL.tag_reasons(li, [("parse_fail", F.col("l_discount") == 0), ("too_small", F.col("l_quantity") < 5),
                            ("too_large", F.col("l_quantity") > 45)], ["l_orderkey", "l_linenumber"], _ALL)
    return FL.reason_counts(t)


@query("quarantine", "F5", fx.sql("""SELECT side, count(*) AS n, count(DISTINCT query_id) AS queries FROM (
 SELECT CASE WHEN query_id IN (SELECT query_id FROM tpos) THEN 'quarantined' ELSE 'kept' END AS side, query_id FROM purch WHERE is_train) GROUP BY side"""))
def quarantine(spark, d):
    keep, aside = FL.quarantine(fx.purchases(spark, d).where("is_train"), fx.test_positives(spark, d), "query_id")
    both = keep.select(F.lit("kept").alias("side"), "query_id").unionByName(
        aside.select(F.lit("quarantined").alias("side"), "query_id"))
    return both.groupBy("side").agg(F.count("*").alias("n"), F.countDistinct("query_id").alias("queries"))


@query("drop_nonheldout_positives", "F6", fx.sql("""SELECT context, count(*) AS n, sum(label)::BIGINT AS positives FROM m
 WHERE NOT (label=1 AND candidate NOT IN (SELECT candidate FROM h)) GROUP BY context""",
    "h AS (SELECT DISTINCT candidate FROM m WHERE ('0x'||substr(md5(candidate),1,8))::BIGINT % 3 = 0)"))
def drop_nonheldout_positives(spark, d):
    m = fx.matrix(spark, d)
    held = fx.train_positives(spark, d).select("candidate").distinct().where(H.hash_fold("candidate", 3) == 0)
    return FL.drop_nonheldout_positives(m, held, "candidate").groupBy("context").agg(
        F.count("*").alias("n"), F.sum("label").cast("bigint").alias("positives"))


@query("read_table", "S1 S2", "SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice),6) AS mean_price FROM orders GROUP BY 1")
def read_table(spark, d):
    o = fx.table(spark, d, "orders", "o_orderkey", "o_orderpriority", "o_totalprice")
    path = TB.write_table(o, TB.scratch_folder(spark, "orders") + ".csv.gz")
    back = TB.read_table(spark, path, o.schema)
    return back.groupBy("o_orderpriority").agg(F.count("*").alias("n"), r6(F.avg("o_totalprice")).alias("mean_price"))


@query("scan_jsonl_shards", "S3", "SELECT event_type, count(*) AS n, round(avg(value),6) AS mean_value FROM events GROUP BY 1")
def scan_jsonl_shards(spark, d):
    e = fx.table(spark, d, "events", "event_id", "event_type", "value")
    path = TB.scratch_folder(spark, "events")
    e.repartition(4, "event_id").write.json(path)
    s = TB.scan_jsonl_shards(spark, path + "/*.json", e.schema)
    return s.groupBy("event_type").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean_value"))


@query("scan_tsv", "S4", "SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal),6) AS mean_balance FROM customer GROUP BY 1")
def scan_tsv(spark, d):
    c = fx.table(spark, d, "customer", "c_custkey", "c_mktsegment", "c_acctbal")
    path = TB.scratch_folder(spark, "customer")
    c.write.option("sep", "\t").option("header", True).csv(path)
    return TB.scan_tsv(spark, path, c.schema).groupBy("c_mktsegment").agg(
        F.count("*").alias("n"), r6(F.avg("c_acctbal")).alias("mean_balance"))


@query("write_sharded", "S5 S7", "SELECT l_returnflag, count(*) AS n, count(DISTINCT l_orderkey) AS orders, true AS files_bounded FROM lineitem GROUP BY 1")
def write_sharded(spark, d):
    li = fx.table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_returnflag")
    path = TB.write_sharded(li, TB.scratch_folder(spark, "lines"), "l_orderkey", ["l_returnflag"], 5000, 8)
    back = spark.read.parquet(path).withColumn("_file", F.col("_metadata.file_path"))
    per = back.groupBy("l_returnflag", "_file").agg(F.count("*").alias("n"), F.collect_set("l_orderkey").alias("k"))
    big = per.groupBy("l_returnflag").agg((F.max("n") <= 5000).alias("files_bounded"))
    return back.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("orders")
                                            ).join(big, "l_returnflag")


@query("matrix_violations", "S6", fx.sql("""SELECT 'bad_label' AS "check", sum((l_linenumber NOT IN (0,1))::INT)::BIGINT AS violations FROM purch
UNION ALL SELECT 'null_key', 0::BIGINT
UNION ALL SELECT 'duplicate_pair', count(*) FROM (SELECT query_id, candidate FROM purch GROUP BY ALL HAVING count(*)>1)"""))
def matrix_violations(spark, d):
    return A.matrix_violations(fx.purchases(spark, d).withColumn("label", F.col("l_linenumber")))


@query("validate_matrix", "S6", fx.sql("SELECT 'm' AS dataset, count(*) AS n, sum(label)::BIGINT AS positives FROM m"))
def validate_matrix(spark, d):
    return A.validate_matrix(fx.matrix(spark, d), "m").groupBy("dataset").agg(
        F.count("*").alias("n"), F.sum("label").cast("bigint").alias("positives"))


@query("profile_sources", "S8", fx.sql("""SELECT source, sum(n)::BIGINT AS rows, count(*) AS unique_keys, (sum(n)-count(*))::BIGINT AS repeated_rows,
 sum((m>1)::INT)::BIGINT AS shared_keys, round(sum((m>1)::INT)::DOUBLE/count(*),6) AS shared_ratio FROM (SELECT *, count(*) OVER (PARTITION BY k) AS m FROM (
  SELECT CASE WHEN is_train THEN 'train' ELSE 'test' END AS source, query_id||'|'||candidate AS k, count(*) AS n FROM purch GROUP BY ALL)) GROUP BY source"""))
def profile_sources(spark, d):
    p = fx.purchases(spark, d).select(F.when(F.col("is_train"), "train").otherwise("test").alias("source"),
                                      H.joined("query_id", "candidate").alias("k"))
    return A.profile_sources(p, "source", "k").withColumn("shared_ratio", r6("shared_ratio"))


@query("column_availability", "S9", """WITH j AS (SELECT d.doc_id, text, lang, source, quality, toxic FROM documents d LEFT JOIN labels l ON l.doc_id=d.doc_id)
SELECT c AS "column", filled, (SELECT count(*) FROM j) AS rows, CASE WHEN (SELECT count(quality)+count(toxic) FROM j)>0 THEN 'PARTIAL' ELSE 'STRUCTURE_ONLY' END AS verdict FROM (
 SELECT 'doc_id' AS c, count(doc_id) AS filled FROM j UNION ALL SELECT 'text', sum((trim(text)<>'')::INT)::BIGINT FROM j UNION ALL SELECT 'lang', sum((trim(lang)<>'')::INT)::BIGINT FROM j
 UNION ALL SELECT 'source', sum((trim(source)<>'')::INT)::BIGINT FROM j UNION ALL SELECT 'quality', count(quality) FROM j UNION ALL SELECT 'toxic', count(toxic) FROM j)""")
def column_availability(spark, d):
    j = fx.table(spark, d, "documents", "doc_id", "text", "lang", "source").join(
        fx.table(spark, d, "labels"), "doc_id", "left")
    return A.column_availability(j, ["doc_id", "text", "lang", "source", "quality", "toxic"], ["quality", "toxic"])


_SPLIT = "CASE WHEN ('0x'||substr(md5(anchor),1,8))::BIGINT % 3 = 0 THEN 'test' ELSE 'train' END"


def split_by_anchor(df):
    return df.withColumn("split", F.when(H.hash_fold("anchor", 3) == 0, "test").otherwise("train"))


@query("dataset_stats", "S10", fx.sql(f"""SELECT q.*, candidates, anchors, contexts, anchor_contexts FROM (SELECT split, sum(n)::BIGINT AS rows, count(*) AS queries, sum(p)::BIGINT AS positives,
 min(n) AS min_candidates, quantile_cont(n,0.5)::DOUBLE AS median_candidates, max(n) AS max_candidates, min(p)::BIGINT AS min_positives,
 quantile_cont(p,0.5)::DOUBLE AS median_positives, max(p)::BIGINT AS max_positives, sum((p=1)::INT)::BIGINT AS single_positive, sum((p>1)::INT)::BIGINT AS multi_positive
 FROM (SELECT split, query_id, count(*) AS n, sum(label)::BIGINT AS p FROM ms GROUP BY ALL) GROUP BY split) q JOIN (SELECT split, count(DISTINCT candidate) AS candidates,
 count(DISTINCT anchor) AS anchors, count(DISTINCT context) AS contexts, count(DISTINCT (anchor,context)) AS anchor_contexts FROM ms GROUP BY split) k ON k.split=q.split""",
    f"ms AS (SELECT *, {_SPLIT} AS split FROM m)"))
def dataset_stats(spark, d):
    return A.dataset_stats(split_by_anchor(fx.matrix(spark, d)))
