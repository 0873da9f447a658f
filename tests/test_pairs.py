from itertools import permutations

from pyspark.sql import functions as F

from rankspark.operators import pairs as PR

REC = "target string, core string, context string, fragment string, entity string"


def test_blocks_give_exactly_all_pairs(spark):
    rows = [("t", "hot", "x", f"f{i}", str(i)) for i in range(60)] + [("t", "c2", "x", f, f) for f in "ab"] + [("t", "c3", "x", "z", "z")]
    df = spark.createDataFrame(rows + rows[:20], REC)
    got = {(r.core, r.old_fragment, r.new_fragment) for r in PR.mine_pairs(df, block=7).collect()}
    want = {("hot", f"f{a}", f"f{b}") for a, b in permutations(range(60), 2)} | {("c2", "a", "b"), ("c2", "b", "a")}
    assert got == want
    assert PR.mine_pairs(df, block=7).count() == len(want)


def test_matrix_labels_and_negatives(spark):
    rows = [("T", "core_a", "C|N", "acetyl", "a1"), ("T", "core_a", "C|N", "propionyl", "a2"),
            ("T", "core_b", "C|N", "benzoyl", "b1"), ("T", "core_b", "C|N", "fluoro", "b2")]
    df = spark.createDataFrame(rows, REC)
    m = PR.build_candidate_matrix(df, ["target", "core", "context"], "t", ratio=1, min_candidates=2)
    assert m.select("core").distinct().count() == 2
    q = m.where("anchor = 'acetyl'").collect()
    assert {r.candidate for r in q if r.label == 1} == {"propionyl"}
    neg = {r.candidate for r in q if r.label == 0}
    assert neg and neg <= {"benzoyl", "fluoro"}
    a = PR.matrix_audit(m).first()
    assert a.queries == 4 and a.positives == 4 and a.rows == 8


def test_negative_modes_honour_their_order(spark):
    rows = [("T", "c1", "x", "a", "1"), ("T", "c1", "x", "b", "2"), ("T", "c2", "x", "near", "3"), ("U", "c3", "x", "far1", "4"),
            ("U", "c3", "x", "far2", "5"), ("U", "c4", "y", "far3", "6")]
    df = spark.createDataFrame(rows, REC)
    keys = ["target", "core", "context"]
    q = PR.matrix_queries(df, keys, "t", ratio=1, min_candidates=3)
    n = PR.negatives(df, q, keys, "same_target", pool_keys=["target", "context"]).join(q.where("core = 'c1'"), "query_id")
    got = {}
    for r in n.collect():
        got.setdefault(r.anchor, []).append((r.tier, r.candidate))
    assert all((0, "near") in v and len(v) == 2 for v in got.values()) and len(got) == 2
    props = spark.createDataFrame([(f, float(i)) for i, f in enumerate(["a", "b", "near", "far1", "far2", "far3"])], "fragment string, size double")
    c = PR.negatives(df, q, keys, "content", props=props, content=PR.Content({"size": 1.0})).join(
        q.where("anchor = 'a'"), "query_id")
    assert {r.candidate for r in c.collect()} == {"near", "far1"}


def test_property_band(spark):
    f = spark.createDataFrame([(f"r{i}", "x", f"f{i}", i) for i in range(6)], "request_id string, context string, fragment string, bin int")
    out = PR.property_matched(f, f, 5, 1).collect()
    assert {(r.request_id, r.fragment) for r in out} == {(f"r{i}", f"f{j}") for i in range(6) for j in (i - 1, i + 1) if 0 <= j < 6}


def test_content_order_is_exact_over_many_fragments(spark):
    """6,000 fragments of few and of many distinct properties, nulls and a hot cell, against scoring every pair."""
    import hashlib
    import random
    r = random.Random(4)
    props = [(f"f{i}", r.choice(["a", "b", "c", None]), r.choice([1.0, 2.0, r.random() * 300, r.random() * 3, None]), r.randrange(40)) for i in range(6000)]
    props += [(f"h{i}", "a", 7.5, 3) for i in range(200)]
    df = spark.createDataFrame(props, "fragment string, kind string, size double, rings int")
    asked = [(p[0], n) for p, n in zip(r.sample(props, 12), [1, 2, 5, 40, 300, 7, 3, 1, 9, 20, 60, 2], strict=True)] + [("h0", 150), ("f0", 7000)]
    need = spark.createDataFrame(asked, "anchor string, _need int")
    content = PR.Content({"size": 0.5, "rings": 0.25}, {"kind": 0.75})
    got = {}
    for x in PR.content_order(df, need, content).collect():
        got.setdefault(x.anchor, []).append((x._i, x.candidate))
    known = {p[0]: p[1:] for p in props}

    def near(x, y):
        return 0.0 if x is None or y is None else 1.0 / (1.0 + abs(y - x))
    for anchor, n in asked:
        k, s, g = known[anchor]
        score = {f: 0.75 * (k is not None and k == a) + 0.5 * near(s, b) + 0.25 * near(g, c) for f, (a, b, c) in known.items()}
        want = sorted(known, key=lambda f: (score[f], hashlib.md5(f.encode()).hexdigest()), reverse=True)[:n]
        assert [f for _, f in sorted(got[anchor])] == want


def test_pair_join_audit_equals_all_meetings_and_lists_none(spark):
    """Null targets and conditions meet nothing; a pair stays one row however many facts its sides have."""
    import random
    from rankspark.operators import pairs as PR
    r = random.Random(6)
    pairs = [(f"p{i}", r.choice([*range(8), None]), r.choice([*range(8), None])) for i in range(60)]
    facts = [(r.choice([*range(6), None]), r.choice([1, 2, 3, 4, None]), r.choice(["a", "b", "c", None])) for _ in range(40)]
    of = lambda e: [f for f in facts if e is not None and f[0] == e]
    want = set()
    for p, a, b in pairs:
        met = [(x, y) for x in of(a) for y in of(b)]
        t = lambda x, y: x[1] is not None and x[1] == y[1]
        c = lambda x, y: x[2] is not None and x[2] == y[2]
        want.add((p, int(bool(met)), *(int(any(f(x, y) for x, y in met)) for f in (t, c, lambda x, y: t(x, y) and c(x, y)))))
    got = PR.pair_join_audit(spark.createDataFrame(pairs, "pair_id string, old_id long, new_id long"),
                             spark.createDataFrame(facts, "entity long, target long, month string"), "target", "month")
    assert {tuple(x) for x in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2
