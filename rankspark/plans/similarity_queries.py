"""Similarity joins, retrieval, clustering and components over the test tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from rankspark.functions import bits as B
from rankspark.functions.hashing import hash_fold
from rankspark.functions.scalar import edge_weight, r6
from rankspark.operators import graph as G
from rankspark.operators import metrics as M
from rankspark.operators import priors as P
from rankspark.operators import ranking as R
from rankspark.operators import similarity as V
from rankspark.plans import fixtures as fx
from rankspark.plans.prior_queries import rounded
from rankspark.plans.registry import query
from rankspark.plans.scalar_queries import EDGES, edge_table
from rankspark.schema import flag
from rankspark.session import cut_lineage

TEXT_BITS = 1 << 20
SHINGLES = r"""dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w<>'') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, (('0x'||substr(md5(array_to_string(w[i:i+2],' ')),1,8))::BIGINT % {n})::INT AS bit FROM dw, unnest(range(1, greatest(len(w)-2,1)::BIGINT+1)) t(i)),
sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1)"""


def document_bits(spark, d, n_bits=TEXT_BITS):
    t = fx.table(spark, d, "documents", "doc_id", "text")
    return t.select("doc_id", B.fingerprint(B.word_shingles("text", 3), n_bits).alias("bits"))


@query("fingerprint", "V1", "WITH " + SHINGLES.replace("{n}", "2048") + " SELECT doc_id, count(*) AS n_bits, sum(bit)::BIGINT AS bit_sum, min(bit) AS first_bit FROM sh GROUP BY 1")
def fingerprint(spark, d):
    return document_bits(spark, d, 2048).select(
        "doc_id", F.size("bits").cast("bigint").alias("n_bits"),
        F.aggregate("bits", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("bit_sum"), F.col("bits")[0].alias("first_bit"))


PAIRS = SHINGLES.replace("{n}", str(TEXT_BITS)) + """, hs AS (SELECT doc_id, md5(string_agg(bit::VARCHAR, ',' ORDER BY bit)) AS h FROM sh GROUP BY 1),
rp AS (SELECT min(doc_id) AS doc_id, count(*) AS copies FROM hs GROUP BY h),
rs AS (SELECT sh.* FROM sh JOIN rp USING (doc_id)),
tp AS (SELECT key_a, key_b, shared, x.n AS size_a, y.n AS size_b, shared::DOUBLE/greatest(x.n+y.n-shared::DOUBLE,0.001) AS similarity FROM (SELECT a.doc_id AS key_a, b.doc_id AS key_b, count(*) AS shared FROM rs a JOIN rs b ON a.bit=b.bit AND a.doc_id<b.doc_id GROUP BY ALL) p
 JOIN sz x ON x.doc_id=key_a JOIN sz y ON y.doc_id=key_b WHERE shared::DOUBLE/greatest(x.n+y.n-shared::DOUBLE,0.001)>=0.5)"""


def document_sets(spark, d):
    """(distinct sets, written once, document -> representative)."""
    reps, members = V.equal_sets(document_bits(spark, d), "doc_id", "bits")
    return cut_lineage(reps), members


def document_pairs(reps, threshold=0.5):
    return V.tanimoto_join(reps, reps, threshold, "doc_id", "doc_id", same=True)


@query("tanimoto_join", "V2 V3", "WITH " + PAIRS + f""" SELECT key_a, key_b, shared, round(similarity,6) AS similarity, round(({TEXT_BITS}.0::DOUBLE*shared-size_a*size_b)/sqrt(size_a::DOUBLE*size_b*({TEXT_BITS}.0::DOUBLE-size_a)*({TEXT_BITS}.0::DOUBLE-size_b)),6) AS phi FROM tp""")
def tanimoto_join(spark, d):
    p = V.with_phi(document_pairs(document_sets(spark, d)[0]), TEXT_BITS)
    return p.select("key_a", "key_b", "shared", r6("similarity").alias("similarity"), r6("phi").alias("phi"))


@query("equal_sets", "V2", "WITH " + PAIRS + " SELECT doc_id, copies FROM rp WHERE copies>1")
def equal_sets(spark, d):
    reps, _ = V.equal_sets(document_bits(spark, d), "doc_id", "bits")
    return reps.where("copies > 1").select("doc_id", "copies")


# customers as templates: the set of candidates they bought
def customer_bits(spark, d):
    p = fx.train_positives(spark, d)
    return p.groupBy(F.col("query_id").alias("key")).agg(F.collect_set("candidate").alias("bits"))


FOLD = "('0x'||substr(md5(query_id),1,8))::BIGINT % 3"
CB = f"""cs AS (SELECT query_id, count(*) AS n FROM pos GROUP BY 1),
simc AS (SELECT key_a, key_b, shared::DOUBLE/greatest(x.n+y.n-shared::DOUBLE,0.001) AS similarity FROM (SELECT a.query_id AS key_a, b.query_id AS key_b, count(*) AS shared FROM (SELECT * FROM pos WHERE {FOLD}=0) a JOIN (SELECT * FROM pos WHERE {FOLD}<>0) b ON a.candidate=b.candidate GROUP BY ALL) p
 JOIN cs x ON x.query_id=key_a JOIN cs y ON y.query_id=key_b),
nr AS (SELECT *, row_number() OVER (PARTITION BY key_a ORDER BY similarity DESC, key_b) AS place FROM simc)"""


def split_customers(spark, d):
    c = customer_bits(spark, d)
    new = hash_fold("key", 3) == 0
    return c.where(new), c.where(~new)


@query("nearest_anchor_transfer", "J8", fx.sql("SELECT key_a, key_b, round(similarity,6) AS similarity, (SELECT count(*) FROM pos WHERE query_id=key_b) AS borrowed FROM nr WHERE place=1", CB))
def nearest_anchor_transfer(spark, d):
    a, b = split_customers(spark, d)
    n = V.nearest(a, b, 1)
    stat = fx.train_positives(spark, d).groupBy(F.col("query_id").alias("key_b")).agg(F.count("*").alias("borrowed"))
    return n.join(stat, "key_b").select("key_a", "key_b", r6("similarity").alias("similarity"), "borrowed")


@query("similarity_histogram", "J8", fx.sql("SELECT least(floor(round(similarity*10,9)),9)::INT AS bin, count(*) AS n, round(avg(similarity),6) AS mean_similarity FROM nr WHERE place=1 GROUP BY 1", CB))
def similarity_histogram(spark, d):
    a, b = split_customers(spark, d)
    return rounded(V.similarity_histogram(V.nearest(a, b, 1)), "mean_similarity")


@query("similarity_prior", "J9", fx.sql("""SELECT key_a AS key, candidate, round(sum(similarity*w),6) AS prior FROM simc JOIN (SELECT query_id AS key_b, candidate, count(*)::DOUBLE AS w FROM purch WHERE is_train GROUP BY ALL) e USING (key_b) WHERE similarity>=0.12 GROUP BY ALL""", CB))
def similarity_prior(spark, d):
    a, b = split_customers(spark, d)
    e = fx.purchases(spark, d).where("is_train").groupBy(F.col("query_id").alias("template"), "candidate").agg(
        F.count("*").cast("double").alias("weight"))
    return rounded(V.similarity_priors(a, b, e, {"prior": 0.12}), "prior")


@query("propose_nearest", "R3", fx.sql("""SELECT key_a AS anchor, candidate, row_number() OVER (PARTITION BY key_a ORDER BY place, r, candidate) AS rank FROM (SELECT key_a, candidate, min((place, r)) AS o, min((place, r))[1] AS place, min((place, r))[2] AS r FROM nr JOIN tc ON tc.query_id=nr.key_b WHERE place<=100 AND r<=5 GROUP BY key_a, candidate) QUALIFY rank<=10""",
    CB + """, tc AS (SELECT query_id, candidate, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, candidate) AS r FROM purch WHERE is_train GROUP BY query_id, candidate)"""))
def propose_nearest(spark, d):
    from pyspark.sql import Window
    a, b = split_customers(spark, d)
    c = fx.purchases(spark, d).where("is_train").groupBy(F.col("query_id").alias("anchor"), "candidate").agg(F.count("*").alias("n"))
    top = c.withColumn("rank", F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("n"), "candidate"))).where("rank <= 5")
    return V.propose_by_search(a, b, top, 100, 5, 10)


@query("c3f_score", "R4", fx.sql("""SELECT anchor, candidate, round((coalesce(c,0.0)+0.5::DOUBLE*f)/(ws+0.5::DOUBLE),6) AS score FROM (SELECT key_a AS anchor, candidate, f FROM (SELECT DISTINCT key_a FROM nr) x, (SELECT candidate, count(*)/max(count(*)) OVER ()::DOUBLE AS f FROM pos WHERE """ + FOLD + """<>0 GROUP BY candidate)) fr0
 JOIN (SELECT key_a AS anchor, sum(similarity) AS ws FROM nr WHERE place<=10 GROUP BY 1) w USING (anchor)
 LEFT JOIN (SELECT key_a AS anchor, candidate, sum(similarity/n) AS c FROM nr JOIN pos ON pos.query_id=nr.key_b JOIN cs ON cs.query_id=nr.key_b WHERE place<=10 GROUP BY ALL) k USING (anchor, candidate)""", CB))
def c3f_score(spark, d):
    a, b = split_customers(spark, d)
    pos = fx.train_positives(spark, d).select(F.col("query_id").alias("anchor"), "candidate")
    tr = pos.where(hash_fold("anchor", 3) != 0)
    cnt = tr.groupBy("candidate").agg(F.count("*").cast("double").alias("n"))
    freq = cnt.withColumn("freq", F.col("n") / cnt.agg(F.max("n")).scalar()).drop("n")
    frame = P.expand_candidates(a.select(F.col("key").alias("anchor"), F.lit("any").alias("context")),
                                cnt.select("candidate", F.lit("any").alias("context")), pos, query="anchor")
    s = V.c3f_score(frame.select("anchor", "candidate"), V.nearest(a, b, 10), P.success_matrix(tr), freq, 10, 0.5)
    return s.select("anchor", "candidate", r6("score").alias("score"))


@query("anchor_similarity", "R21", fx.sql("SELECT query_id, candidate, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, tie, candidate) AS rank, round(sim,6) AS sim FROM ft QUALIFY rank<=10"))
def anchor_similarity(spark, d):
    return R.top_k(fx.featured(spark, d), "sim", 10).select("query_id", "candidate", "rank", r6("sim").alias("sim"))


CBITS = """cb AS (SELECT DISTINCT p_type||':'||p_size AS candidate, (('0x'||substr(md5(p_name),1,8))::BIGINT % 2048)::INT AS bit FROM part),
cn AS (SELECT candidate, count(*) AS n FROM cb GROUP BY 1),
ct AS (SELECT query_id, bit, count(*)/max(k)::DOUBLE AS v FROM pos JOIN cb USING (candidate) JOIN (SELECT query_id, count(*) AS k FROM pos GROUP BY 1) USING (query_id) GROUP BY ALL),
csum AS (SELECT query_id, sum(v) AS s FROM ct GROUP BY 1),
cd AS (SELECT m.query_id, m.candidate, m.context, sum(v) AS dot FROM m JOIN cb ON cb.candidate=m.candidate JOIN ct ON ct.query_id=m.query_id AND ct.bit=cb.bit GROUP BY ALL)"""


@query("centroid_score", "V11", fx.sql("""SELECT m.context, count(*) AS n, round(avg(coalesce(dot,0.0)/(s+n-coalesce(dot,0.0)+1e-10)),6) AS mean_score, round(max(coalesce(dot,0.0)/(s+n-coalesce(dot,0.0)+1e-10)),6) AS best FROM m JOIN csum ON csum.query_id=m.query_id JOIN cn ON cn.candidate=m.candidate
 LEFT JOIN cd ON cd.query_id=m.query_id AND cd.candidate=m.candidate GROUP BY 1""", CBITS))
def centroid_score(spark, d):
    part = fx.table(spark, d, "part", "p_type", "p_size", "p_name")
    bits = part.groupBy(F.concat_ws(":", "p_type", "p_size").alias("candidate")).agg(
        B.fingerprint(F.collect_set("p_name"), 2048).alias("bits"))
    pos = fx.train_positives(spark, d).select("query_id", "candidate")
    m = fx.matrix(spark, d).join(pos.select("query_id").distinct(), "query_id", "left_semi")
    s = V.centroid_score(m, pos, bits)
    return s.groupBy("context").agg(F.count("*").alias("n"), r6(F.avg("score")).alias("mean_score"), r6(F.max("score")).alias("best"))


# --- vectors -------------------------------------------------------------------------------------------------

EM = """em AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE*x::DOUBLE))) AS nm FROM embeddings)"""
RING = EM + """, rg AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('5|'||vec_id), vec_id) AS i, count(*) OVER (PARTITION BY label) AS n FROM em),
rp AS (SELECT a.label, a.vec_id AS old_id, b.vec_id AS new_id, a.v AS ov, b.v AS nv, a.nm AS onm, b.nm AS nnm FROM rg a JOIN rg b ON a.label=b.label AND b.i=a.i%a.n+1 WHERE a.n>1)"""


def vectors(spark, d):
    return fx.table(spark, d, "embeddings")


@query("delta_vectors", "V4", "WITH " + RING + """ SELECT label, old_id, new_id, round(sqrt(list_sum([(nv[i]-ov[i])*(nv[i]-ov[i]) FOR i IN range(1,len(ov)+1)])),6) AS delta_norm, round(list_sum([nv[i]*ov[i] FOR i IN range(1,len(ov)+1)])/greatest(onm*nnm,1e-12),6) AS cosine FROM rp""")
def delta_vectors(spark, d):
    p = V.delta_vectors(V.ring_pairs(vectors(spark, d), "vec_id", "embedding", 5, ["label"]))
    return p.select("label", "old_id", "new_id", r6("delta_norm").alias("delta_norm"), r6("cosine").alias("cosine"))


@query("within_vs_cross", "V5", "WITH " + RING.replace("'5|'", "'0|'") + """, ra AS (SELECT *, row_number() OVER (ORDER BY md5('0-all|'||vec_id), vec_id) AS j, count(*) OVER () AS c FROM em),
cs AS (SELECT 'within' AS kind, list_sum([nv[i]*ov[i] FOR i IN range(1,len(ov)+1)])/greatest(onm*nnm,1e-12) AS c FROM rp UNION ALL SELECT 'random', list_sum([a.v[i]*b.v[i] FOR i IN range(1,len(a.v)+1)])/greatest(a.nm*b.nm,1e-12) FROM ra a JOIN ra b ON b.j=a.j%a.c+1)
SELECT kind, count(*) AS n, round(avg(c),6) AS mean, round(stddev_samp(c),6) AS std, round(min(c),6) AS min, round(max(c),6) AS max FROM cs GROUP BY 1""")
def within_vs_cross(spark, d):
    return rounded(V.within_vs_cross(vectors(spark, d), "vec_id", "embedding", "label"), "mean", "std", "min", "max")


#: All pairs of differences, which the Spark side never forms.
MARGINS = RING + """, dl AS (SELECT new_id AS id, [nv[i]-ov[i] FOR i IN range(1,len(ov)+1)] AS v, label FROM rp),
un AS (SELECT *, sqrt(list_sum([x*x FOR x IN v])) AS nm FROM dl),
gr AS (SELECT id, 'transform' AS kind, label::VARCHAR AS member FROM dl UNION ALL SELECT id, 'context', (id%3)::VARCHAR FROM dl UNION ALL SELECT id, 'both', label||':'||(id%3) FROM dl UNION ALL SELECT id, 'random', substr(md5('0|'||id),1,1) FROM dl),
pr AS (SELECT a.id AS x, b.id AS y, list_sum([a.v[i]*b.v[i] FOR i IN range(1,len(a.v)+1)])/greatest(a.nm*b.nm,1e-12) AS c FROM un a JOIN un b ON a.id<>b.id),
mg AS (SELECT g.kind, g.member, count(DISTINCT x) AS n, avg(c) FILTER (h.member=g.member) AS w, avg(c) FILTER (h.member<>g.member) AS a FROM pr JOIN gr g ON g.id=x JOIN gr h ON h.id=y AND h.kind=g.kind GROUP BY 1,2)"""


@query("group_margins", "V5", "WITH " + MARGINS + " SELECT kind, member, n, round(w,6) AS within_mean, round(a,6) AS cross_mean, round(w-a,6) AS margin FROM mg")
def group_margins(spark, d):
    """Differences that share the transform, the context, both, or a random draw."""
    p = V.delta_vectors(V.ring_pairs(vectors(spark, d), "vec_id", "embedding", 5, ["label"]))
    context = F.pmod("new_id", F.lit(3)).cast("string")
    g = p.select("delta", F.col("label").alias("transform"), context.alias("context"), F.concat_ws(":", F.col("label").cast("string"), context).alias("both"),
                 F.substring(F.md5(F.concat(F.lit("0|"), F.col("new_id").cast("string"))), 1, 1).alias("random"))
    return rounded(V.group_margins(g, "delta", ["transform", "context", "both", "random"]), "within_mean", "cross_mean", "margin")


TOPK = EM + """, tk AS (SELECT a.vec_id AS query_key, b.vec_id AS pool_key, a.label AS lq, b.label AS lp, round(list_sum([a.v[i]*b.v[i] FOR i IN range(1,len(a.v)+1)])/greatest(a.nm*b.nm,1e-12),9) AS cosine,
 row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_sum([a.v[i]*b.v[i] FOR i IN range(1,len(a.v)+1)])/greatest(a.nm*b.nm,1e-12),9) DESC, b.vec_id) AS rank FROM em a JOIN em b ON a.vec_id<>b.vec_id)"""


def neighbours(spark, d, k=10):
    v = vectors(spark, d)
    return V.vector_top_k(v, v, k, exclude_self=True)


@query("vector_top_k", "T2", "WITH " + TOPK + " SELECT query_key, pool_key, round(cosine,6) AS cosine, rank FROM tk WHERE rank<=10")
def vector_top_k(spark, d):
    return rounded(neighbours(spark, d), "cosine")


@query("knn_purity", "V6", "WITH " + TOPK + " SELECT lq AS label, count(*) AS n, round(avg((lq=lp)::INT),6) AS purity, round(1.0::DOUBLE/(SELECT count(DISTINCT label) FROM em),6) AS chance FROM tk WHERE rank<=10 GROUP BY 1")
def knn_purity(spark, d):
    return rounded(V.knn_purity(neighbours(spark, d), vectors(spark, d), "vec_id", "label"), "purity", "chance")


@query("retrieval_eval", "V7", "WITH " + TOPK + """ SELECT lq AS label, count(*) AS n, round(avg((best<=1)::INT),6) AS hit1, round(avg((best<=5)::INT),6) AS hit5, round(avg(coalesce(1.0::DOUBLE/best,0.0)),6) AS mrr, round(avg(coverage),6) AS coverage FROM (
 SELECT query_key, max(lq) AS lq, coalesce(min(CASE WHEN lq=lp THEN rank END),99) AS best, sum((lq=lp)::INT)/max(c)::DOUBLE AS coverage FROM tk JOIN (SELECT label, count(*)-1 AS c FROM em GROUP BY 1) z ON z.label=lq WHERE rank<=10 GROUP BY 1) GROUP BY 1""".replace("coalesce(1.0::DOUBLE/best,0.0)", "CASE WHEN best<99 THEN 1.0::DOUBLE/best ELSE 0.0 END"))
def retrieval_eval(spark, d):
    v = vectors(spark, d)
    near = neighbours(spark, d)
    lab = v.select(F.col("vec_id").alias("query_key"), F.col("label").alias("lq"))
    pl = v.select(F.col("vec_id").alias("pool_key"), F.col("label").alias("lp"))
    size = v.groupBy(F.col("label").alias("lq")).agg((F.count("*") - 1).alias("c"))
    j = near.join(lab, "query_key").join(pl, "pool_key").withColumn("label", flag(F.col("lq") == F.col("lp")))
    m = M.metrics_from_ranks(j, "rank", query="query_key", carry=["lq"], random=False, no_positive="zero")
    m = m.join(size, "lq").withColumn("coverage", F.col("n_positive") / F.col("c"))
    return m.groupBy(F.col("lq").alias("label")).agg(F.count("*").alias("n"), *[r6(F.avg(c)).alias(c) for c in ("hit1", "hit5", "mrr", "coverage")])


@query("mean_delta_predictor", "R20")
def mean_delta_predictor(spark, d):
    v = vectors(spark, d)
    pairs = cut_lineage(V.delta_vectors(V.ring_pairs(v, "vec_id", "embedding", 5, ["label"])))
    out = None
    for name, by in (("zero", None), ("global", []), ("context", ["label"])):
        if by is None:
            q = pairs.withColumn("q", F.col("old_vec").cast("array<double>"))
        elif by:
            q = V.shift_vectors(pairs.join(V.mean_delta(pairs, by), by), "old_vec", "offset", "q")
        else:
            q = V.shift_vectors(pairs.withColumn("offset", V.mean_delta(pairs).scalar()), "old_vec", "offset", "q")
        near = V.vector_top_k(q.select(F.col("old_id").alias("vec_id"), F.col("q").alias("embedding")),
                              v.select("vec_id", "embedding"), 20, exclude_self=True)
        r = near.join(pairs.select(F.col("old_id").alias("query_key"), F.col("new_id").alias("pool_key")), ["query_key", "pool_key"])
        one = r.agg(F.lit(name).alias("predictor"), F.count("*").alias("hits20"), r6(F.sum(1.0 / F.col("rank"))).alias("reciprocal_sum"))
        out = one if out is None else out.unionByName(one)
    return out


@query("anchor_cluster_profile", "V13", fx.sql("""SELECT cluster, count(*) AS queries, round(avg(hit10),6) AS hit10, round(avg(mrr),6) AS mrr, string_agg(CASE WHEN arank<=3 THEN anchor END, ';' ORDER BY arank) FILTER (first_of_anchor) AS top_anchors FROM (
 SELECT d.*, n_regionkey AS cluster, dense_rank() OVER (PARTITION BY n_regionkey ORDER BY ac DESC, anchor) AS arank, row_number() OVER (PARTITION BY anchor ORDER BY query_id)=1 AS first_of_anchor FROM (SELECT *, count(*) OVER (PARTITION BY anchor) AS ac FROM dd) d JOIN nation ON 'n'||n_nationkey=anchor) GROUP BY 1""",
    "dd AS (SELECT query_id, min(anchor) AS anchor, coalesce((min(CASE WHEN label=1 THEN rank_a END)<=10)::INT,0) AS hit10, 1.0::DOUBLE/min(CASE WHEN label=1 THEN rank_a END) AS mrr FROM rk GROUP BY 1 HAVING sum(label)>0)"))
def anchor_cluster_profile(spark, d):
    from pyspark.sql import Window
    m = M.metrics_from_ranks(fx.ranked(spark, d), "rank_a", random=False, carry=["anchor"])
    n = fx.table(spark, d, "nation", "n_nationkey", "n_regionkey").select(
        F.concat(F.lit("n"), "n_nationkey").alias("anchor"), F.col("n_regionkey").alias("cluster"))
    m = m.join(n, "anchor")
    a = m.groupBy("cluster", "anchor").agg(F.count("*").alias("c"))
    a = a.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("c"), "anchor"))).where("r <= 3")
    top = a.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "anchor"))),
                                                            lambda x: x["anchor"]), ";").alias("top_anchors"))
    g = m.groupBy("cluster").agg(F.count("*").alias("queries"), r6(F.avg("hit10")).alias("hit10"), r6(F.avg("mrr")).alias("mrr"))
    return g.join(top, "cluster")


# --- graph ---------------------------------------------------------------------------------------------------

@query("connected_components", "V10", "WITH RECURSIVE " + PAIRS + """, ed AS (SELECT key_a AS a, key_b AS b FROM tp UNION SELECT key_b, key_a FROM tp), reach(a, b) AS (SELECT a, b FROM ed UNION SELECT r.a, e.b FROM reach r JOIN ed e ON r.b=e.a),
cm AS (SELECT a AS node, least(a, min(b)) AS component FROM reach GROUP BY a)
SELECT node, component FROM cm UNION ALL SELECT doc_id, doc_id FROM rp WHERE doc_id NOT IN (SELECT node FROM cm)""")
def connected_components(spark, d):
    reps, _ = document_sets(spark, d)
    return G.connected_components(document_pairs(reps), reps.select("doc_id"), "key_a", "key_b")


@query("leader_cluster", "V9")
def leader_cluster(spark, d):
    reps, members = document_sets(spark, d)
    c = G.leader_cluster(reps.select("doc_id"), document_pairs(reps, 0.6), "doc_id", "key_a", "key_b")
    return members.join(c.select(F.col("node").alias("doc_id"), "leader", "cluster"), "doc_id").select("member", "leader", "cluster")


def order_items(spark, d):
    """Queries and the transforms they hold: customers and the (part, supplier) offers they bought."""
    return fx.purchases(spark, d).select("query_id", F.concat_ws("/", "l_partkey", "l_suppkey").alias("key"))


@query("component_split", "L2")
def component_split(spark, d):
    s = G.component_split(fx.table(spark, d, "documents", "doc_id", "source", "lang").select(
        "doc_id", F.concat_ws("/", "source", "lang").alias("key")), "doc_id", "key", 1)
    return s.groupBy("split").agg(F.count("*").alias("items"), F.countDistinct("component").alias("components"))


@query("blind_split_search", "L3")
def blind_split_search(spark, d):
    docs = fx.table(spark, d, "documents", "doc_id", "source", "lang")
    items = docs.select("doc_id", F.concat_ws("/", "source", "lang").alias("key"))
    comp = G.connected_components(G.shared_key_edges(items, "doc_id", "key"), items.select("doc_id")).select(
        F.col("node").alias("doc_id"), "component")
    fixed = fx.table(spark, d, "labels", "doc_id", "toxic").where("toxic = 1")
    trials, _ = G.blind_split_search(comp, fixed.join(docs.where("lang = 'fr'"), "doc_id"),
                                     docs.select("doc_id", F.col("lang").alias("candidate")), trials=16, min_blind=50, item="doc_id")
    return trials.select("trial", "n_blind", "n_val", r6("seen_blind").alias("seen_blind"), r6("seen_val").alias("seen_val"), "components")
