"""Negatives are drawn inside the row of their query, facts meet by condition before they meet pairs."""
import random

import pytest

from rankspark.operators import pairs as PR

KEYS = ["target", "core"]


def records(spark):
    r = random.Random(5)
    rows = [(f"t{r.randrange(3)}", f"c{r.randrange(25)}", f"f{r.randrange(30)}", r.randrange(90)) for _ in range(400)]
    return spark.createDataFrame([(t, c, f, e, int(f[1:]) // 7, f"k{int(f[1:]) % 3}") for t, c, f, e in rows],
                                 "target string, core string, fragment string, entity long, size int, kind string").distinct()


def same(a, b):
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    return sorted(map(tuple, a.select(cols).collect())) == sorted(map(tuple, b.select(cols).collect()))


@pytest.mark.parametrize("mode", ["easy", "same_target", "content"])
def test_listed_negatives_are_those_of_the_joins(spark, mode):
    r = records(spark)
    q = PR.matrix_queries(r, KEYS, "t", ratio=2, min_candidates=6)
    kw = dict(pool_keys=["target"], content=PR.Content({"size": 0.25}, {"kind": 0.75}), props=r.select("fragment", "kind", "size").distinct())
    listed = PR.negatives(r, q, KEYS, mode, carry=["core"], **kw)
    assert listed.count() > 500
    assert same(listed, PR.negatives(r, q, KEYS, mode, carry=["core"], max_pool=0, **kw))


def test_matrix_rows_come_from_the_row_of_the_query(spark):
    r = records(spark)
    m = PR.build_candidate_matrix(r, KEYS, "t", ratio=2, min_candidates=6)
    assert same(m, PR.build_candidate_matrix(r, KEYS, "t", ratio=2, min_candidates=6, max_pool=0))
    p = m._jdf.queryExecution().executedPlan().toString()
    assert p.index("Generate explode") < p.index("Exchange")  # nothing moves after the rows are made


def test_comparable_pairs_are_those_of_all_meetings(spark, monkeypatch):
    r = random.Random(2)
    pairs = spark.createDataFrame([(f"p{i}", r.randrange(12), r.randrange(12)) for i in range(80)], "pair_id string, old_id long, new_id long")
    facts = spark.createDataFrame([(r.randrange(12), r.randrange(3), f"m{r.randrange(4)}", float(r.randrange(50))) for _ in range(150)],
                                  "entity long, target int, month string, value double")
    met = PR.comparable_pairs(pairs, facts, ["target", "month"])
    # the pairs meet condition by condition, they are not repeated per fact
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "least(old_id" in plan
    rows = sorted(map(tuple, met.select(sorted(met.columns)).collect()))
    monkeypatch.setattr(PR, "MEETINGS_PER_FACT", 0)
    other = PR.comparable_pairs(pairs, facts, ["target", "month"])
    assert met.columns == other.columns
    assert rows == sorted(map(tuple, other.select(sorted(met.columns)).collect())) and len(rows) > 100
