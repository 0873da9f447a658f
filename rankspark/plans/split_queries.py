"""Splits and leakage audits over the test tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from rankspark.functions import hashing as H
from rankspark.operators import metrics as M
from rankspark.operators import splits as L
from rankspark.plans import fixtures as fx
from rankspark.plans.fusion_queries import WIDE, wide
from rankspark.plans.prior_queries import rounded
from rankspark.plans.registry import query


def side_sql(col: str, seed: str, name: str = "sd", src: str = "m", frac: str = "0.7") -> str:
    return f"""{name} AS (SELECT {col}, i<=greatest(1,least(n-1,floor(n*{frac}::DOUBLE))) AS is_tr FROM (SELECT {col}, row_number() OVER (ORDER BY md5('{seed}|'||{col})) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT {col} FROM {src} WHERE label=1)))"""


def report_sql(col: str) -> str:
    return f"""SELECT (SELECT count(*) FROM tr) AS train_rows, (SELECT count(*) FROM te) AS test_rows, (SELECT count(DISTINCT query_id) FROM tr) AS train_queries, (SELECT count(DISTINCT query_id) FROM te) AS test_queries,
 (SELECT sum(label)::BIGINT FROM tr) AS train_positives, (SELECT sum(label)::BIGINT FROM te) AS test_positives, (SELECT count(*) FROM (SELECT query_id FROM tr INTERSECT SELECT query_id FROM te)) AS query_overlap,
 (SELECT count(*) FROM (SELECT {col} FROM tr INTERSECT SELECT {col} FROM te)) AS value_overlap, (SELECT count(*) FROM (SELECT {col} FROM tr INTERSECT SELECT {col} FROM te WHERE label=1)) AS positive_value_overlap"""


@query("group_split", "L1", fx.sql(report_sql("anchor"), side_sql("anchor", "0") + ", tr AS (SELECT m.* FROM m JOIN sd ON sd.anchor=m.anchor WHERE is_tr), te AS (SELECT m.* FROM m JOIN sd ON sd.anchor=m.anchor WHERE NOT is_tr)"))
def group_split(spark, d):
    s = L.group_split(fx.matrix(spark, d), "anchor")
    return L.split_report(s.where("side = 'train'"), s.where("side = 'test'"), "anchor")


def _held(col: str, seed: str, exclude: bool, strict: bool = False) -> str:
    c = side_sql(col, seed) + f", tq AS (SELECT DISTINCT query_id FROM m JOIN sd ON sd.{col}=m.{col} WHERE label=1 AND NOT is_tr)"
    ex = " AND query_id NOT IN (SELECT query_id FROM tq)" if exclude else ""
    if strict:
        c += f""", ng AS (SELECT {col}, i<=floor(n*0.7::DOUBLE) AS is_tr FROM (SELECT {col}, row_number() OVER (ORDER BY md5('{seed}-neg|'||{col})) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT {col} FROM m WHERE {col} NOT IN (SELECT {col} FROM sd)))),
sp AS (SELECT * FROM sd UNION ALL SELECT * FROM ng),
tr AS (SELECT * FROM m WHERE {col} IN (SELECT {col} FROM sp WHERE is_tr){ex}),
te AS (SELECT * FROM m WHERE query_id IN (SELECT query_id FROM tq) AND {col} IN (SELECT {col} FROM sp WHERE NOT is_tr))"""
    else:
        c += f""", tr AS (SELECT * FROM m WHERE {col} NOT IN (SELECT {col} FROM sd WHERE NOT is_tr){ex}),
te AS (SELECT * FROM m WHERE query_id IN (SELECT query_id FROM tq) AND NOT (label=1 AND {col} NOT IN (SELECT {col} FROM sd WHERE NOT is_tr)))"""
    return c


@query("value_heldout_split", "L4", fx.sql(report_sql("candidate"), _held("candidate", "1", True)))
def value_heldout_split(spark, d):
    return L.flag_report(L.flagged_split(fx.matrix(spark, d), "candidate", seed=1, exclude_test_queries=True), "candidate")


@query("strict_heldout_split", "L5", fx.sql(report_sql("candidate"), _held("candidate", "2", False, True)))
def strict_heldout_split(spark, d):
    return L.flag_report(L.flagged_split(fx.matrix(spark, d), "candidate", seed=2, strict=True), "candidate")


@query("core_heldout_split", "L6", fx.sql(report_sql("context"), _held("context", "3", False)))
def core_heldout_split(spark, d):
    return L.flag_report(L.flagged_split(fx.matrix(spark, d), "context", seed=3), "context")


@query("inner_folds", "L7", fx.sql("""SELECT f AS fold, (SELECT count(*) FROM m WHERE candidate NOT IN (SELECT candidate FROM v WHERE v.f=x.f) AND query_id NOT IN (SELECT query_id FROM m JOIN v ON v.candidate=m.candidate WHERE label=1 AND v.f=x.f)) AS train_rows,
 (SELECT count(*) FROM m WHERE query_id IN (SELECT query_id FROM m JOIN v ON v.candidate=m.candidate WHERE label=1 AND v.f=x.f) AND NOT (label=1 AND candidate NOT IN (SELECT candidate FROM v WHERE v.f=x.f))) AS val_rows FROM (VALUES (0),(1),(2)) x(f)""",
    "v AS (SELECT DISTINCT candidate, (('0x'||substr(md5(candidate),1,8))::BIGINT % 3)::INT AS f FROM m WHERE label=1)"))
def inner_folds(spark, d):
    rows = L.fold_flags(fx.matrix(spark, d), "candidate", exclude_queries=True)
    n = rows.agg(*[F.count_if(F.col(c)[i]).alias(f"{c}{i}") for c in ("in_fit", "in_val") for i in range(3)])
    return n.select(F.explode(F.array(*[F.struct(F.lit(i).alias("fold"), F.col(f"in_fit{i}").alias("train_rows"), F.col(f"in_val{i}").alias("val_rows"))
                                        for i in range(3)])).alias("r")).select("r.*")


@query("hash_folds", "L8", """SELECT c_custkey, (('0x'||substr(md5(c_custkey::VARCHAR),1,8))::BIGINT % 5)::INT AS fold, ('0x'||substr(md5(c_custkey::VARCHAR),1,8))::BIGINT % 10000 < 2500 AS mask,
 CASE WHEN dg<6 THEN 'train' WHEN dg<8 THEN 'val' ELSE 'test' END AS template_side FROM (SELECT c_custkey, (6*list_sum([('0x'||substr(md5(c_custkey::VARCHAR),i,1))::INT FOR i IN range(1,32)])+('0x'||substr(md5(c_custkey::VARCHAR),32,1))::INT) % 10 AS dg FROM customer)""")
def hash_folds(spark, d):
    return fx.table(spark, d, "customer", "c_custkey").select(
        "c_custkey", H.hash_fold("c_custkey", 5).alias("fold"), H.hash_mask("c_custkey", 0.25).alias("mask"),
        H.template_split("c_custkey").alias("template_side"))


@query("leakage_audit", "L9", fx.sql("""SELECT key, train_values, test_values, shared, round(shared/greatest(test_values,1)::DOUBLE,6) AS shared_ratio, CASE WHEN shared=0 THEN 'PASS' WHEN shared/greatest(test_values,1)::DOUBLE<=0.05 THEN 'WARN' ELSE 'FAIL' END AS verdict FROM (
 SELECT key, sum(t)::BIGINT AS train_values, sum(e)::BIGINT AS test_values, sum(t*e)::BIGINT AS shared FROM (SELECT key, value, max((split='train')::INT) AS t, max((split='test')::INT) AS e FROM (
  SELECT split, 'anchor' AS key, anchor AS value FROM u UNION ALL SELECT split, 'candidate', candidate FROM u UNION ALL SELECT split, 'query_id', query_id FROM u UNION ALL SELECT split, 'transform', anchor||'>>'||candidate FROM u UNION ALL SELECT split, 'pair', query_id||'|'||candidate FROM u) GROUP BY ALL) GROUP BY key)""",
    "u AS (SELECT CASE WHEN ('0x'||substr(md5(anchor),1,8))::BIGINT % 3 = 0 THEN 'test' ELSE 'train' END AS split, * FROM m)"))
def leakage_audit(spark, d):
    from rankspark.plans.scalar_queries import split_by_anchor
    m = split_by_anchor(fx.matrix(spark, d)).withColumn("transform", F.concat_ws(">>", "anchor", "candidate")).withColumn(
        "pair", F.concat_ws("|", "query_id", "candidate"))
    return rounded(L.leakage_audit(m, "split", ["anchor", "candidate", "query_id", "transform", "pair"]), "shared_ratio")


@query("benchmark_contamination", "L9", r"""WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w<>'') AS w FROM documents),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+7],' ') AS s FROM dw, unnest(range(1, greatest(len(w)-7,1)::BIGINT+1)) t(i)),
bw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w<>'') AS w FROM benchmark),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i+7],' ') AS s FROM bw, unnest(range(1, greatest(len(w)-7,1)::BIGINT+1)) t(i))
SELECT item_id, count(DISTINCT doc_id) AS documents, count(DISTINCT s) AS shared_shingles FROM bs JOIN ds USING (s) GROUP BY 1""")
def benchmark_contamination(spark, d):
    from rankspark.functions import bits as B
    sh = lambda t, i: fx.table(spark, d, t, i, "text").select(i, F.explode(B.word_shingles("text", 8)).alias("s")).distinct()
    return sh("benchmark", "item_id").join(sh("documents", "doc_id"), "s").groupBy("item_id").agg(
        F.countDistinct("doc_id").alias("documents"), F.countDistinct("s").alias("shared_shingles"))


@query("annotate_vocab", "L10", fx.sql("""SELECT query_id, vocab_flag, targets, seen_anchor FROM (SELECT q.query_id, CASE WHEN bool_and(v.candidate IS NOT NULL) THEN 'all' WHEN bool_or(v.candidate IS NOT NULL) THEN 'any' ELSE 'none' END AS vocab_flag, count(*) AS targets, max((a.query_id IS NOT NULL)::INT) AS seen_anchor
 FROM qt q JOIN tpos t ON t.query_id=q.query_id LEFT JOIN (SELECT DISTINCT candidate FROM purch WHERE is_train AND anchor NOT IN ('n1','n5') AND context<>'MACHINERY') v ON v.candidate=t.candidate LEFT JOIN (SELECT DISTINCT query_id FROM pos) a ON a.query_id=q.query_id GROUP BY 1)"""))
def annotate_vocab(spark, d):
    from rankspark.plans.fusion_queries import held_positives
    a = L.annotate_vocab(fx.query_table(spark, d), fx.test_positives(spark, d), held_positives(spark, d))
    a = L.seen_flag(a, fx.train_positives(spark, d), ["query_id"], "seen_anchor")
    return a.select("query_id", "vocab_flag", "targets", "seen_anchor")


@query("temporal_split", "L11", fx.sql("""SELECT 'train' AS side, count(*) AS n, count(DISTINCT query_id) AS queries FROM purch WHERE is_train UNION ALL SELECT 'test', count(*), count(DISTINCT query_id) FROM purch WHERE NOT is_train AND (query_id, candidate) NOT IN (SELECT query_id, candidate FROM purch WHERE is_train)"""))
def temporal_split(spark, d):
    tr, te = L.temporal_split(fx.purchases(spark, d), "o_orderdate", fx.TRAIN_END, ["query_id", "candidate"])
    r = lambda x, n: x.agg(F.lit(n).alias("side"), F.count("*").alias("n"), F.countDistinct("query_id").alias("queries"))
    return r(tr, "train").unionByName(r(te, "test"))


@query("seen_unseen_performance", "L13", fx.sql("""SELECT flag, seen, count(*) AS n, round(avg(hit10_a),6) AS hit10_a, round(avg(mrr_a),6) AS mrr_a FROM (SELECT wm.*, (s.query_id IS NOT NULL)::INT AS q, (t.anchor IS NOT NULL)::INT AS ac FROM wm LEFT JOIN (SELECT DISTINCT query_id FROM sp) s ON s.query_id=wm.query_id
 LEFT JOIN (SELECT DISTINCT anchor, context FROM sp) t ON t.anchor=wm.anchor AND t.context=wm.context), LATERAL (SELECT 'seen_query' AS flag, q AS seen UNION ALL SELECT 'seen_transform', ac) x GROUP BY ALL""",
    WIDE + ", sp AS (SELECT DISTINCT query_id, anchor, context, candidate FROM purch WHERE is_train AND anchor NOT IN ('n1','n5') AND context<>'MACHINERY')"))
def seen_unseen_performance(spark, d):
    from rankspark.plans.fusion_queries import held_positives
    sp = held_positives(spark, d)
    w = L.seen_flag(wide(spark, d), sp, ["query_id"], "seen_query")
    w = L.seen_flag(w, sp, ["anchor", "context"], "seen_transform")
    return rounded(L.seen_unseen_performance(w, ["seen_query", "seen_transform"], ["hit10_a", "mrr_a"]), "hit10_a", "mrr_a")


@query("random_row_split", "L14", fx.sql("""SELECT split, context, count(*) AS n, count(DISTINCT query_id) AS queries FROM (SELECT *, CASE WHEN i<=floor(n*0.8::DOUBLE) THEN 'train' WHEN i<=floor(n*0.9::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM (
 SELECT *, row_number() OVER (ORDER BY md5('21|'||query_id||'|'||candidate)) AS i, count(*) OVER () AS n FROM pos)) GROUP BY ALL"""))
def random_row_split(spark, d):
    s = L.random_row_split(fx.train_positives(spark, d), ["query_id", "candidate"], 21)
    return s.groupBy("split", "context").agg(F.count("*").alias("n"), F.countDistinct("query_id").alias("queries"))
