"""Flagship: frequency ranking measured end to end."""
from __future__ import annotations

from pyspark.sql import functions as F

from rankspark.functions.scalar import r6
from rankspark.operators import metrics as M
from rankspark.operators import priors as P
from rankspark.plans import fixtures as fx
from rankspark.plans.registry import query

HITS = ["hit1", "hit5", "hit10", "mrr", "ndcg10"]


def metric_sql(source: str, rank: str, keys: str = "query_id", zero: bool = False) -> str:
    """Per-query metrics from a rank column, in SQL."""
    where = "" if zero else "WHERE n_positive > 0"
    return f"""SELECT *, coalesce((best_rank<=1)::INT,0) AS hit1, coalesce((best_rank<=5)::INT,0) AS hit5,
  coalesce((best_rank<=10)::INT,0) AS hit10, coalesce(1.0::DOUBLE/best_rank,0.0) AS mrr,
  CASE WHEN n_positive>0 THEN dcg/list_sum([1.0::DOUBLE/log2(i+1.0::DOUBLE) FOR i IN range(1,(least(n_positive,10)+1)::BIGINT)]) ELSE 0.0 END AS ndcg10
 FROM (SELECT {keys}, min(anchor) AS anchor, min(context) AS context, count(*) AS n_candidates,
   sum(label)::BIGINT AS n_positive, min(CASE WHEN label=1 THEN {rank} END) AS best_rank,
   sum(CASE WHEN label=1 AND {rank}<=10 THEN 1.0::DOUBLE/log2({rank}+1.0::DOUBLE) ELSE 0.0 END) AS dcg
  FROM {source} GROUP BY {keys}) {where}"""


def random_hit_sql(k: int, n: str = "n_candidates", p: str = "n_positive") -> str:
    return (f"CASE WHEN {n}<=0 OR {p}<=0 THEN 0.0 WHEN least({k},{n}) > {n}-{p} THEN 1.0 ELSE "
            f"1.0::DOUBLE - list_reduce([1.0::DOUBLE] || [({n}-{p}-i)::DOUBLE/({n}-i) FOR i IN "
            f"range(0,least({k},{n})::BIGINT)], lambda a, b: a*b) END")


@query("frequency_benchmark", "A2 W1 M1 A11", fx.sql(f"""
SELECT count(*) AS n_queries, count(DISTINCT anchor) AS n_groups,
 {", ".join(f"round(avg({c}),6) AS query_{c}" for c in HITS)},
 {", ".join(f"(SELECT round(avg(x),6) FROM (SELECT avg({c}) AS x FROM d GROUP BY anchor)) AS macro_{c}" for c in HITS)}
FROM d""", f"""gf AS (SELECT candidate, count(*)::DOUBLE AS n FROM pos GROUP BY candidate),
s AS (SELECT m.*, coalesce(n,0.0)/(SELECT max(n) FROM gf) AS score_freq, md5(query_id||'|'||m.candidate) AS tie
 FROM m LEFT JOIN gf ON gf.candidate=m.candidate),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score_freq DESC, tie, candidate) AS rank FROM s),
d AS ({metric_sql('r', 'rank')})"""))
def frequency_benchmark(spark, d):
    frame = P.freq_score(fx.train_positives(spark, d), fx.matrix(spark, d))
    detail = M.ranking_metrics(frame, "score_freq", carry=["anchor"], random=False)
    out = M.macro_mean(detail, "anchor", HITS)
    return out.select("n_queries", "n_groups", *[r6(c).alias(c) for c in out.columns if c[:2] in ("qu", "ma")])
