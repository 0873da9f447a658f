"""Pair mining, matrices, decoys and samples over the test tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from rankspark.functions import bits as B
from rankspark.functions.scalar import r6
from rankspark.operators import pairs as PR
from rankspark.operators import priors as P
from rankspark.operators import sampling as SA
from rankspark.plans import fixtures as fx
from rankspark.plans.prior_queries import rounded
from rankspark.plans.registry import query

FR = "WITH " + fx.FRAG
MEMBERS = """mem AS (SELECT core, context, fragment, min(entity) AS entity FROM fr GROUP BY ALL),
pairs AS (SELECT a.core, a.context, a.fragment AS old_fragment, a.entity AS old_id, b.fragment AS new_fragment, b.entity AS new_id,
 a.fragment||'>>'||b.fragment AS transform, substr(md5(a.core||'|'||a.context||'|'||a.fragment||'|'||b.fragment),1,16) AS pair_id
 FROM mem a JOIN mem b ON a.core=b.core AND a.context=b.context AND a.fragment<>b.fragment),
tf AS (SELECT transform, count(*) AS n FROM pairs GROUP BY 1)"""


@query("mine_pairs", "J1", FR + ", " + MEMBERS + " SELECT pair_id, core, context, old_fragment, new_fragment, old_id, new_id, transform FROM pairs")
def mine_pairs(spark, d):
    return PR.mine_pairs(fx.fragments(spark, d)).select(
        "pair_id", "core", "context", "old_fragment", "new_fragment", "old_id", "new_id", "transform")


@query("mine_pairs_large_groups", "J1", FR + """, mem AS (SELECT core_s AS core, context, fragment FROM fr GROUP BY ALL)
SELECT core, context, (n*(n-1))::BIGINT AS pairs, n AS group_size FROM (SELECT core, context, count(*) AS n FROM mem GROUP BY ALL) WHERE n>=2""")
def mine_pairs_large_groups(spark, d):
    p = PR.mine_pairs(fx.fragments(spark, d, "l_suppkey"), block=64)
    return p.groupBy("core", "context", "group_size").agg(F.count("*").alias("pairs"))


@query("group_explosion_report", "A5", FR + """ SELECT core_s AS core, context, n, (n*(n-1)/2)::BIGINT AS pairs, (n>100)::INT AS capped FROM (SELECT core_s, context, count(DISTINCT fragment) AS n FROM fr GROUP BY ALL)""")
def group_explosion_report(spark, d):
    return PR.group_explosion_report(fx.fragments(spark, d, "l_suppkey"), ["core", "context"])


@query("transform_frequency", "A5", FR + ", " + MEMBERS + " SELECT transform, n, (n>=5)::INT AS recurrent FROM tf")
def transform_frequency(spark, d):
    return PR.transform_frequency(PR.mine_pairs(fx.fragments(spark, d)))


def _records(spark, d):
    o = fx.table(spark, d, "orders", "o_orderkey", "o_orderpriority").select(
        F.col("o_orderkey").cast("string").alias("core"), F.col("o_orderpriority").alias("priority"))
    return fx.fragments(spark, d).drop("target").join(o, "core")


GRP = """ro AS (SELECT fr.*, o_orderpriority AS priority FROM fr JOIN orders ON core=o_orderkey::VARCHAR),
lig AS (SELECT priority, core, context, fragment, count(DISTINCT entity) AS support FROM ro GROUP BY ALL),
qs AS (SELECT l.*, n_fragments, n_fragments-1 AS n_positive, greatest((n_fragments-1)*5, 20-(n_fragments-1), 0)::INT AS want,
  'shop:'||substr(md5(priority||'|'||core||'|'||context||'|'||l.fragment),1,24) AS query_id
 FROM lig l JOIN (SELECT priority, core, context, count(*) AS n_fragments FROM lig GROUP BY ALL HAVING count(*)>=2) s USING (priority, core, context)),
vf AS (SELECT fragment, row_number() OVER (ORDER BY md5('7|'||fragment), fragment) AS p FROM (SELECT DISTINCT fragment FROM ro)),
vs AS (SELECT count(*) AS size FROM vf)"""
EASY = """w AS (SELECT q.*, i, (('0x'||substr(md5(query_id),1,8))::BIGINT + i) % size + 1 AS p FROM qs q, vs, unnest(range(0, least(want+n_fragments,size)::BIGINT)) t(i)),
neg AS (SELECT w.query_id, vf.fragment AS candidate, row_number() OVER (PARTITION BY w.query_id ORDER BY i) AS k, want FROM w JOIN vf USING (p)
 WHERE NOT EXISTS (SELECT 1 FROM lig l WHERE l.priority=w.priority AND l.core=w.core AND l.context=w.context AND l.fragment=vf.fragment)),
ng AS (SELECT query_id, candidate FROM neg WHERE k<=want)"""
KEYS = ["priority", "core", "context"]


@query("build_candidate_matrix", "J2 N4", FR + ", " + GRP + ", " + EASY + """, mx AS (SELECT query_id, candidate, 0 AS label FROM ng UNION ALL
 SELECT q.query_id, l.fragment, 1 FROM qs q JOIN lig l ON l.priority=q.priority AND l.core=q.core AND l.context=q.context AND l.fragment<>q.fragment WHERE q.query_id IN (SELECT query_id FROM ng))
SELECT mx.context_ AS context, count(*) AS rows, count(DISTINCT query_id) AS queries, sum(label)::BIGINT AS positives, sum(('0x'||substr(md5(query_id||'|'||candidate),1,8))::BIGINT)::BIGINT AS fingerprint
FROM (SELECT mx.*, q.context AS context_ FROM mx JOIN qs q USING (query_id)) mx GROUP BY 1""")
def build_candidate_matrix(spark, d):
    from rankspark.functions.hashing import hash_int, joined
    m = PR.build_candidate_matrix(_records(spark, d), KEYS, "shop")
    return m.groupBy("context").agg(
        F.count("*").alias("rows"), F.countDistinct("query_id").alias("queries"),
        F.sum("label").cast("bigint").alias("positives"),
        F.sum(hash_int(joined("query_id", "candidate"))).alias("fingerprint"))


@query("matrix_audit", "J2", FR + ", " + GRP + ", " + EASY + """, mx AS (SELECT query_id, candidate, 0 AS label FROM ng UNION ALL
 SELECT q.query_id, l.fragment, 1 FROM qs q JOIN lig l ON l.priority=q.priority AND l.core=q.core AND l.context=q.context AND l.fragment<>q.fragment WHERE q.query_id IN (SELECT query_id FROM ng))
SELECT count(*) AS queries, sum(n)::BIGINT AS rows, sum(p)::BIGINT AS positives, min(n) AS min_candidates, max(n) AS max_candidates, (SELECT count(DISTINCT fragment) FROM qs WHERE query_id IN (SELECT query_id FROM mx)) AS anchors,
 (SELECT count(DISTINCT candidate) FROM mx) AS candidates FROM (SELECT query_id, count(*) AS n, sum(label) AS p FROM mx GROUP BY 1)""")
def matrix_audit(spark, d):
    return PR.matrix_audit(PR.build_candidate_matrix(_records(spark, d), KEYS, "shop"))


@query("negatives_same_target", "N4", FR + ", " + GRP + """, vn AS (SELECT priority, context, fragment, row_number() OVER (PARTITION BY priority, context ORDER BY md5('7|'||fragment), fragment) AS p, count(*) OVER (PARTITION BY priority, context) AS size
  FROM (SELECT DISTINCT priority, context, fragment FROM ro)),
vns AS (SELECT DISTINCT priority, context, size FROM vn),
w0 AS (SELECT q.*, i, (('0x'||substr(md5(query_id),1,8))::BIGINT + i) % size + 1 AS p FROM qs q JOIN vns USING (priority, context), unnest(range(0, least(want+n_fragments,size)::BIGINT)) t(i)),
w1 AS (SELECT q.*, i, (('0x'||substr(md5(query_id),1,8))::BIGINT + i) % size + 1 AS p FROM qs q, vs, unnest(range(0, least((want+n_fragments)*2,size)::BIGINT)) t(i)),
dr AS (SELECT query_id, candidate, min(tier*1000000+i) AS o FROM (SELECT w0.query_id, fr2.fragment AS candidate, 0 AS tier, i FROM w0 JOIN vn fr2 ON fr2.priority=w0.priority AND fr2.context=w0.context AND fr2.p=w0.p
  UNION ALL SELECT query_id, vf.fragment, 1, i FROM w1 JOIN vf USING (p)) GROUP BY ALL),
neg AS (SELECT dr.query_id, dr.candidate, o//1000000 AS tier, q.context, q.want, row_number() OVER (PARTITION BY dr.query_id ORDER BY o) AS k FROM dr JOIN qs q USING (query_id)
 WHERE NOT EXISTS (SELECT 1 FROM lig l WHERE l.priority=q.priority AND l.core=q.core AND l.context=q.context AND l.fragment=dr.candidate))
SELECT context, tier::INT AS tier, count(*) AS n, count(DISTINCT query_id) AS queries, sum(('0x'||substr(md5(query_id||'|'||candidate),1,8))::BIGINT)::BIGINT AS fingerprint FROM neg WHERE k<=want GROUP BY ALL""")
def negatives_same_target(spark, d):
    from rankspark.functions.hashing import hash_int, joined
    r = _records(spark, d)
    q = PR.matrix_queries(r, KEYS, "shop")
    n = PR.negatives(r, q, KEYS, "same_target", pool_keys=["priority", "context"], carry=["context"])
    return n.groupBy("context", "tier").agg(F.count("*").alias("n"), F.countDistinct("query_id").alias("queries"),
                                            F.sum(hash_int(joined("query_id", "candidate"))).alias("fingerprint"))


@query("negatives_content_matched", "N4", FR + ", " + GRP + """, pr AS (SELECT DISTINCT fragment, kind, size FROM fr),
need AS (SELECT fragment AS anchor, max(want+n_fragments) AS need FROM qs GROUP BY 1),
ca AS (SELECT a.fragment AS anchor, c.fragment AS candidate, row_number() OVER (PARTITION BY a.fragment ORDER BY 0.75::DOUBLE*(a.kind=c.kind)::INT+0.25::DOUBLE*(1.0::DOUBLE/(1.0::DOUBLE+abs(c.size-a.size))) DESC, md5(c.fragment) DESC) AS i
  FROM pr a, pr c WHERE a.fragment IN (SELECT anchor FROM need)),
neg AS (SELECT q.query_id, ca.candidate, q.context, q.want, row_number() OVER (PARTITION BY q.query_id ORDER BY i, ca.candidate) AS k FROM qs q JOIN need ON need.anchor=q.fragment JOIN ca ON ca.anchor=q.fragment AND ca.i<=need.need
 WHERE NOT EXISTS (SELECT 1 FROM lig l WHERE l.priority=q.priority AND l.core=q.core AND l.context=q.context AND l.fragment=ca.candidate))
SELECT context, count(*) AS n, count(DISTINCT query_id) AS queries, sum(('0x'||substr(md5(query_id||'|'||candidate),1,8))::BIGINT)::BIGINT AS fingerprint FROM neg WHERE k<=want GROUP BY ALL""")
def negatives_content_matched(spark, d):
    from rankspark.functions.hashing import hash_int, joined
    r = _records(spark, d)
    q = PR.matrix_queries(r, KEYS, "shop")
    n = PR.negatives(r, q, KEYS, "content", content=PR.Content({"size": 0.25}, {"kind": 0.75}), props=r.select("fragment", "kind", "size").distinct(), carry=["context"])
    return n.groupBy("context").agg(
        F.count("*").alias("n"), F.countDistinct("query_id").alias("queries"),
        F.sum(hash_int(joined("query_id", "candidate"))).alias("fingerprint"))


FACTS = """facts AS (SELECT DISTINCT l_partkey AS entity, l_suppkey AS target, date_trunc('month', o_orderdate)::DATE::VARCHAR AS month, l_extendedprice AS value FROM lineitem JOIN orders ON l_orderkey=o_orderkey)"""


def facts(spark, d):
    li = fx.table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice")
    o = fx.table(spark, d, "orders", "o_orderkey", "o_orderdate")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("l_partkey").alias("entity"), F.col("l_suppkey").alias("target"),
        F.trunc("o_orderdate", "month").cast("string").alias("month"), F.col("l_extendedprice").alias("value")).distinct()


@query("comparable_pairs", "J3", FR + ", " + MEMBERS + ", " + FACTS + """ SELECT pair_id, count(*) AS n, round(median(x),6) AS median_delta, round(min(x),6) AS min_delta, round(max(x),6) AS max_delta FROM (
 SELECT p.pair_id, b.value-a.value AS x FROM pairs p JOIN facts a ON a.entity=p.old_id JOIN facts b ON b.entity=p.new_id AND a.target=b.target AND a.month=b.month) GROUP BY 1""")
def comparable_pairs(spark, d):
    c = PR.comparable_pairs(PR.mine_pairs(fx.fragments(spark, d)), facts(spark, d), ["target", "month"])
    return rounded(PR.delta_summary(c), "median_delta", "min_delta", "max_delta")


@query("pair_join_audit", "J4", FR + ", " + MEMBERS + ", " + FACTS + """ SELECT count(*) AS pairs, count(*) FILTER (old_id IN (SELECT entity FROM facts) AND new_id IN (SELECT entity FROM facts)) AS both_have,
 (SELECT count(DISTINCT pair_id) FROM pairs p JOIN (SELECT DISTINCT entity, target FROM facts) a ON a.entity=p.old_id JOIN (SELECT DISTINCT entity, target FROM facts) b ON b.entity=p.new_id AND a.target=b.target) AS same_target,
 (SELECT count(DISTINCT pair_id) FROM pairs p JOIN (SELECT DISTINCT entity, month FROM facts) a ON a.entity=p.old_id JOIN (SELECT DISTINCT entity, month FROM facts) b ON b.entity=p.new_id AND a.month=b.month) AS same_condition,
 (SELECT count(DISTINCT pair_id) FROM pairs p JOIN facts a ON a.entity=p.old_id JOIN facts b ON b.entity=p.new_id AND a.month=b.month AND a.target=b.target) AS comparable FROM pairs""")
def pair_join_audit(spark, d):
    month = F.year("month") * 12 + F.month("month")
    a = PR.pair_join_audit(PR.mine_pairs(fx.fragments(spark, d)), facts(spark, d).withColumn("month", month), "target", "month")
    return a.agg(F.count("*").alias("pairs"), *[F.sum(c).cast("bigint").alias(c) for c in (
        "both_have", "same_target", "same_condition", "comparable")])


@query("expand_candidates", "J7", fx.sql("""SELECT q.context, count(*) AS rows, count(DISTINCT q.query_id) AS queries, count(t.candidate) AS positives FROM qt q JOIN (SELECT context, candidate FROM vocab WHERE context<>'BUILDING' UNION ALL SELECT DISTINCT 'BUILDING', candidate FROM vocab WHERE context<>'BUILDING') v ON v.context=q.context
 LEFT JOIN tpos t ON t.query_id=q.query_id AND t.candidate=v.candidate GROUP BY 1"""))
def expand_candidates(spark, d):
    v = P.train_vocab(fx.train_positives(spark, d)).where("context <> 'BUILDING'")
    m = P.expand_candidates(fx.query_table(spark, d), v, fx.test_positives(spark, d))
    return m.groupBy("context").agg(F.count("*").alias("rows"), F.countDistinct("query_id").alias("queries"),
                                    F.sum("label").cast("bigint").alias("positives"))


REQ = "req AS (SELECT DISTINCT context||'/'||fragment AS request_id, context, fragment, size AS bin FROM fr)"


@query("property_matched", "J14", FR + ", " + REQ + """ SELECT request_id, context, fragment, pick FROM (SELECT r.request_id, r.context, p.fragment, row_number() OVER (PARTITION BY r.request_id ORDER BY md5('3|'||r.request_id||'|'||p.fragment), p.fragment) AS pick
 FROM req r JOIN req p ON p.context=r.context AND abs(p.bin-r.bin)<=1 AND p.fragment<>r.fragment) WHERE pick<=3""")
def property_matched(spark, d):
    f = fx.fragments(spark, d).select(F.concat_ws("/", "context", "fragment").alias("request_id"), "context", "fragment",
                                      F.col("size").alias("bin")).distinct()
    return PR.property_matched(f, f, 3, 3)


# --- sampling ------------------------------------------------------------------------------------------------

@query("reservoir", "N1", "SELECT o_custkey FROM (SELECT DISTINCT o_custkey FROM orders) ORDER BY md5('5|'||o_custkey), o_custkey LIMIT 200")
def reservoir(spark, d):
    return SA.reservoir(fx.table(spark, d, "orders", "o_custkey"), 200, ["o_custkey"], 5)


@query("stratified_sample", "N2", """WITH q AS (SELECT o_orderpriority, greatest(round(1000.0::DOUBLE*count(*)/(SELECT count(*) FROM orders)),1) AS quota FROM orders GROUP BY 1)
SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('5|'||o_orderkey)) AS rn FROM orders) JOIN q USING (o_orderpriority) WHERE rn<=quota""")
def stratified_sample(spark, d):
    o = fx.table(spark, d, "orders", "o_orderkey", "o_orderpriority")
    return SA.stratified_sample(o, "o_orderpriority", ["o_orderkey"], 1000, 5).select("o_orderpriority", "o_orderkey")


@query("stratified_sample_equal", "N2", """SELECT o_orderstatus, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('6|'||o_orderkey)) AS rn FROM orders) WHERE rn<=greatest(floor(300/(SELECT count(DISTINCT o_orderstatus) FROM orders)),1)""")
def stratified_sample_equal(spark, d):
    o = fx.table(spark, d, "orders", "o_orderkey", "o_orderstatus")
    return SA.stratified_sample(o, "o_orderstatus", ["o_orderkey"], 300, 6, equal=True)


@query("one_per_query_first", "N3", fx.sql("""SELECT query_id, candidate FROM (SELECT *, md5('4|'||query_id||'|'||candidate) AS h, row_number() OVER (PARTITION BY query_id ORDER BY md5('4|'||query_id||'|'||candidate), candidate) AS rn FROM pos) ORDER BY (rn>1)::INT, h, query_id, candidate LIMIT 2000"""))
def one_per_query_first(spark, d):
    p = fx.train_positives(spark, d).select("query_id", "candidate")
    return SA.one_per_query_first(p, 2000, 4)


@query("weak_labels", "N5", FR + ", " + MEMBERS + """ SELECT context, weak_label, count(*) AS n, round(avg(confidence),6) AS confidence FROM (SELECT context, (n>=3)::INT AS weak_label, CASE WHEN n>=3 THEN least(n/20.0::DOUBLE,1.0) ELSE 0.5 END AS confidence FROM pairs JOIN tf USING (transform)) GROUP BY ALL""")
def weak_labels(spark, d):
    p = PR.mine_pairs(fx.fragments(spark, d))
    w = SA.weak_labels(p, PR.transform_frequency(p), recurrent=3)
    return w.groupBy("context", "weak_label").agg(F.count("*").alias("n"), r6(F.avg("confidence")).alias("confidence"))


DECOYS = """dp AS (SELECT context, fragment, row_number() OVER (PARTITION BY context ORDER BY md5('9|'||fragment), fragment) AS p, count(*) OVER (PARTITION BY context) AS size FROM (SELECT DISTINCT context, fragment FROM fr)),
dsz AS (SELECT DISTINCT context, size FROM dp),
decoys AS (SELECT pair_id, x.context, old_fragment, fragment AS decoy FROM (SELECT pairs.*, (('0x'||substr(md5('9|'||pair_id),1,8))::BIGINT % size)+1 AS p FROM pairs JOIN dsz USING (context)) x JOIN dp ON dp.context=x.context AND dp.p=x.p WHERE fragment<>old_fragment AND fragment<>new_fragment)"""


@query("random_decoys", "N6", FR + ", " + MEMBERS + ", " + DECOYS + " SELECT pair_id, context, old_fragment, decoy FROM decoys")
def random_decoys(spark, d):
    f = fx.fragments(spark, d)
    return SA.random_decoys(PR.mine_pairs(f), f, 9)


@query("benchmark_manifest", "N7", FR + ", " + MEMBERS + ", " + DECOYS + """ SELECT label, context, count(*) AS n FROM (SELECT DISTINCT context, old_fragment, new_fragment, 1 AS label FROM pairs UNION ALL
 SELECT DISTINCT context, old_fragment, decoy, 0 FROM decoys WHERE (context, old_fragment, decoy) NOT IN (SELECT context, old_fragment, new_fragment FROM pairs)) GROUP BY ALL""")
def benchmark_manifest(spark, d):
    f = fx.fragments(spark, d)
    p = PR.mine_pairs(f)
    dec = SA.random_decoys(p, f, 9).withColumnRenamed("decoy", "new_fragment")
    m = SA.benchmark_manifest(p, dec, ["context", "old_fragment", "new_fragment"])
    return m.groupBy("label", "context").agg(F.count("*").alias("n"))


@query("downsample_negatives", "N8", fx.sql("""SELECT label, context, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('2|'||query_id||'|'||candidate)) AS rn FROM m) WHERE label=1 OR rn<=2*(SELECT sum(label) FROM m) GROUP BY ALL"""))
def downsample_negatives(spark, d):
    s = SA.downsample_negatives(fx.matrix(spark, d), 2, 2, ["query_id", "candidate"])
    return s.groupBy("label", "context").agg(F.count("*").alias("n"))


@query("hard_negative_weight", "N9", fx.sql("""SELECT m.label, m.context, count(*) AS n, sum(CASE WHEN m.label=0 AND s>0.3 THEN 2.0 ELSE 1.0 END)::BIGINT AS total_weight FROM m LEFT JOIN (
 SELECT m.query_id, m.candidate, max(bit_count(b.c_bits & p.c_bits)::DOUBLE/greatest(bit_count(b.c_bits)+bit_count(p.c_bits)-bit_count(b.c_bits & p.c_bits)::DOUBLE,0.001)) AS s
 FROM m JOIN cprof b ON b.candidate=m.candidate JOIN (SELECT m.query_id, c_bits FROM m JOIN cprof c ON c.candidate=m.candidate WHERE label=1) p ON p.query_id=m.query_id WHERE m.label=0 GROUP BY ALL) h ON h.query_id=m.query_id AND h.candidate=m.candidate GROUP BY ALL"""))
def hard_negative_weight(spark, d):
    m = fx.matrix(spark, d).join(fx.candidate_profile(spark, d).select("candidate", "c_bits"), "candidate")
    w = SA.hard_negative_weight(m, "c_bits", B.packed_tanimoto)
    return w.groupBy("label", "context").agg(F.count("*").alias("n"), F.sum("weight").cast("bigint").alias("total_weight"))


@query("pos_neg_pairs", "N10", fx.sql("""SELECT context, label, count(*) AS n, round(avg(f1),6) AS mean_f1, round(avg(f2),6) AS mean_f2 FROM (SELECT j.context, v.label, v.s*(pa-na) AS f1, v.s*(pb-nb) AS f2 FROM j, (VALUES (1,1.0::DOUBLE),(0,-1.0::DOUBLE)) v(label,s)) GROUP BY ALL""",
    """hh AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY md5('8|'||query_id||'|'||candidate), candidate) AS r, count(*) OVER (PARTITION BY query_id, label) AS c FROM sc),
wk AS (SELECT p.query_id, p.context, p.score_a AS pa, p.score_b AS pb, ((p.r-1)*least(ceil(100.0/p.c)::BIGINT,n.c)+i) % n.c + 1 AS place FROM (SELECT * FROM hh WHERE label=1) p JOIN (SELECT DISTINCT query_id, c FROM hh WHERE label=0) n ON n.query_id=p.query_id,
  unnest(range(0, least(ceil(100.0/p.c)::BIGINT,n.c))) t(i) WHERE (p.r-1)*least(ceil(100.0/p.c)::BIGINT,n.c)+i < 100),
j AS (SELECT wk.*, n.score_a AS na, n.score_b AS nb FROM wk JOIN hh n ON n.query_id=wk.query_id AND n.label=0 AND n.r=wk.place)"""))
def pos_neg_pairs(spark, d):
    s = fx.scored(spark, d)
    p = SA.pos_neg_pairs(s, ["score_a", "score_b"], 100, 8).join(
        fx.query_table(spark, d).select("query_id", "context"), "query_id")
    return p.groupBy("context", "label").agg(F.count("*").alias("n"), r6(F.avg(F.col("diff")[0])).alias("mean_f1"),
                                             r6(F.avg(F.col("diff")[1])).alias("mean_f2"))


@query("round_robin_sample", "N11", """WITH s AS (SELECT p_type, count(*) AS stratum_size FROM part GROUP BY 1)
SELECT p_type, p_partkey, turn, (stratum_size < 50.0/(SELECT count(*) FROM s))::INT AS underfilled FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY md5('1|'||p_partkey)) AS turn FROM part) JOIN s USING (p_type) ORDER BY turn, stratum_size DESC, p_type LIMIT 50""")
def round_robin_sample(spark, d):
    p = fx.table(spark, d, "part", "p_partkey", "p_type")
    return SA.round_robin_sample(p, "p_type", ["p_partkey"], 50, 1).select("p_type", "p_partkey", "turn", "underfilled")
