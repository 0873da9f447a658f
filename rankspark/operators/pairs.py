"""Pair mining, matrix construction and joins over pairs."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from rankspark.functions.hashing import hash_int, hash_order, joined, stable_hash
from rankspark.operators.ranking import md5_bucket_row_number
from rankspark.schema import flag
from rankspark.session import BROADCAST_ROWS, broadcast_when_small, cut_lineage

BLOCK = 128
#: Size from which the report of groups flags one as large.
BIG_GROUP = 100


def group_members(records: DataFrame, keys: Sequence[str], fragment="fragment", entity="entity") -> DataFrame:
    """Distinct fragments per group with their smallest entity: repeated records never reach the join."""
    return records.groupBy(*keys, fragment).agg(F.min(entity).alias(entity))


def mine_pairs(records: DataFrame, keys: Sequence[str] = ("core", "context"), fragment="fragment",
               entity="entity", block: int = BLOCK) -> DataFrame:
    """Directed old -> new pairs of different fragments in one group.

    A group with more than ``block`` members is cut into hash blocks and joined block by block, so no join key ever
    holds more than about block x block pairs: a hot group is spread over many tasks and its result stays whole.
    """
    keys = list(keys)
    m = group_members(records, keys, fragment, entity)
    size = m.groupBy(*keys).agg(F.count("*").alias("group_size")).where("group_size >= 2")
    m = m.join(size, keys)
    nb = F.ceil(F.col("group_size") / block).cast("int")
    mine = F.pmod(F.xxhash64(fragment), nb).cast("int")
    others = F.sequence(F.lit(0), nb - 1)
    a = m.select(*keys, "group_size", F.col(fragment).alias("old_fragment"), F.col(entity).alias("old_id"),
                 mine.alias("_x"), F.explode(others).alias("_y"))
    b = m.select(*keys, F.col(fragment).alias("new_fragment"), F.col(entity).alias("new_id"),
                 mine.alias("_y"), F.explode(others).alias("_x"))
    p = a.join(b, [*keys, "_x", "_y"]).where(F.col("old_fragment") != F.col("new_fragment")).drop("_x", "_y")
    return p.withColumn("transform", F.concat_ws(">>", "old_fragment", "new_fragment")).withColumn(
        "pair_id", stable_hash(16, *keys, "old_fragment", "new_fragment"))


def group_explosion_report(records: DataFrame, keys: Sequence[str], fragment="fragment") -> DataFrame:
    """A5: members, unordered pairs and the big-group flag."""
    g = records.select(*keys, fragment).distinct().groupBy(*keys).agg(F.count("*").alias("n"))
    return g.withColumn("pairs", (F.col("n") * (F.col("n") - 1) / 2).cast("bigint")).withColumn(
        "capped", flag(F.col("n") > BIG_GROUP))


def transform_frequency(pairs: DataFrame, recurrent: int = 5) -> DataFrame:
    """A5: how often each transform was mined."""
    return pairs.groupBy("transform").agg(F.count("*").alias("n")).withColumn(
        "recurrent", flag(F.col("n") >= recurrent))


def matrix_queries(records: DataFrame, keys: Sequence[str], dataset: str, min_fragments: int = 2,
                   ratio: int = 5, min_candidates: int = 20, fragment="fragment", entity="entity") -> DataFrame:
    """One query per (group, fragment) with the number of positives and requested negatives."""
    keys = list(keys)
    lig = records.select(*keys, fragment, entity).distinct().groupBy(*keys, fragment).agg(F.count("*").alias("support"))
    size = lig.groupBy(*keys).agg(F.count("*").alias("n_fragments")).where(F.col("n_fragments") >= min_fragments)
    q = lig.join(size, keys).withColumn("n_positive", F.col("n_fragments") - 1)
    want = F.greatest(F.col("n_positive") * ratio, F.lit(min_candidates) - F.col("n_positive"), F.lit(0))
    return q.withColumnRenamed(fragment, "anchor").withColumn("want", want.cast("int")).withColumn(
        "query_id", F.concat(F.lit(dataset + ":"), stable_hash(24, *keys, "anchor")))


def _walk(queries: DataFrame, pool: DataFrame, on: Sequence[str], steps: Column, tier: int) -> DataFrame:
    """Each query reads ``steps`` consecutive places of a hash-ordered pool from its own start.

    The join meets only as many rows as it returns; no query is paired with the whole pool.
    """
    n = F.col("_size")
    places = F.least(steps, n).cast("int")
    w = (queries.withColumn("_i", F.explode(F.when(places > 0, F.sequence(F.lit(0), places - 1))))
         .withColumn("_p", F.pmod(hash_int(F.col("query_id")) + F.col("_i"), n) + 1))
    return w.join(pool, [*on, "_p"]).select("query_id", F.col("_f").alias("candidate"), F.lit(tier).alias("tier"), "_i")


def _pool(records: DataFrame, on: Sequence[str], seed, fragment: str) -> tuple[DataFrame, DataFrame]:
    """(pool with places, pool sizes) per key; the key list may be empty."""
    f = records.select(*on, F.col(fragment).alias("_f")).distinct()
    p = md5_bucket_row_number(f, seed, ["_f"], "_p", within=on, digits=2)
    return p, f.groupBy(*on).agg(F.count("*").alias("_size"))


@dataclass(frozen=True)
class Content:
    """Similarity of two fragments: the sum of weight x [equal] over ``same`` and weight / (1 + |difference|) over ``near``."""

    near: dict[str, float]
    same: dict[str, float] = field(default_factory=dict)

    def score(self) -> Column:
        """Over columns a_* and c_*. A null never matches."""
        parts = [F.lit(w) * F.when(F.col(f"a_{c}") == F.col(f"c_{c}"), 1).otherwise(0) for c, w in self.same.items()]
        parts += [F.lit(w) * (F.lit(1.0) / (F.lit(1.0) + self.distance(c))) for c, w in self.near.items()]
        return reduce(add, parts)

    @staticmethod
    def distance(c: str) -> Column:
        return F.coalesce(F.abs(F.col(f"c_{c}") - F.col(f"a_{c}")).cast("double"), F.lit(float("inf")))


def _placed(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``name``: the place of every row in the order, from 0. Sorted by ranges; only partition sizes meet in one place."""
    rows = cut_lineage(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_m", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    sizes = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")
    return rows.withColumn("_part", part).join(sizes, "_part").withColumn(
        name, F.col("_before") + F.col("_m") - F.shiftleft("_part", 33)).drop("_m", "_part", "_before")


def content_order(props: DataFrame, need: DataFrame, content: Content, fragment="fragment", first: int = 8) -> DataFrame:
    """(anchor, candidate, _i): the ``_need`` best candidates of every anchor by content score, ties by falling md5. Exact.

    A threshold search over sorted lists. Fragments of equal properties are one cell, which no anchor can tell apart, so
    cells are searched and only the first members of a cell ever return. Each near column has two lists of cells: ordered
    within the cells of equal ``same`` columns, and ordered over all. An anchor's cell is walked outwards from its own place,
    twice as far per round. What was not met is no nearer than the frontier of a list, and outside its block it lacks the
    least weight of ``same`` too: a cell leaves when these bounds fall below the score at which its need is covered.
    """
    same, near = list(content.same), list(content.near)
    cells = cut_lineage(props.groupBy(*same, *near).agg(F.countDistinct(fragment).alias("_size")))
    lists = [(f"p_{c}", [c, *same, *(x for x in near if x != c)]) for c in near]
    if same:
        lists += [(f"b_{c}", [*same, c, *(x for x in near if x != c)]) for c in near]
    for name, order in lists:
        cells = _placed(cells, order, name)
    cells = cut_lineage(cells.withColumn("cell", F.col(lists[0][0])))
    total = cells.count()
    match = reduce(and_, [F.col(f"a_{c}").eqNullSafe(F.col(f"_{c}")) for c in [*same, *near]])
    cell_of = props.select(F.col(fragment).alias("member"), *[F.col(c).alias(f"_{c}") for c in [*same, *near]]).distinct().join(
        cells.select("cell", *[F.col(c).alias(f"a_{c}") for c in [*same, *near]]), match).select("member", "cell")
    cell_of = cut_lineage(cell_of)
    anchors = need.join(cell_of.withColumnRenamed("member", "anchor"), "anchor")
    start = anchors.groupBy("cell").agg(F.max("_need").alias("need")).join(cells.drop("_size"), "cell")
    if same:
        edges = cells.groupBy(*same).agg(*[f(f"b_{c}").alias(f"{n}_{c}") for c in near for n, f in (("lo", F.min), ("hi", F.max))])
        start = start.join(edges.select(*[F.col(c).alias(f"_{c}") for c in same], *[f"{n}_{c}" for c in near for n in ("lo", "hi")]),
                           reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in same])).drop(*[f"_{c}" for c in same])
    start = start.withColumnsRenamed({"cell": "a_cell", **{c: f"a_{c}" for c in [*same, *near]}})
    active = cut_lineage(start)
    found, at, step = None, 0, first
    whole = sum(content.same.values())
    while not active.isEmpty():
        away = F.sequence(F.lit(at), F.lit(at + step - 1))
        away = F.array_distinct(F.concat(away, F.transform(away, lambda x: -x)))
        met = None
        for name, _ in lists:
            c, inner = name[2:], name.startswith("b_")
            lo, hi = (F.col(f"lo_{c}"), F.col(f"hi_{c}")) if inner else (F.lit(0), F.lit(total - 1))
            ask = active.select("a_cell", *[f"a_{x}" for x in [*same, *near]], lo.alias("_lo"), hi.alias("_hi"), F.col(name).alias("_own"), F.explode(away).alias("_o"))
            ask = ask.withColumn("_place", F.col("_own") + F.col("_o")).where("_place between _lo and _hi")
            there = cells.select(F.col(name).alias("_place"), "cell", "_size", *[F.col(x).alias(f"c_{x}") for x in [*same, *near]])
            rows = ask.join(there, "_place").select("a_cell", "cell", "_size", content.score().alias("score"), F.lit(name).alias("_list"),
                                                    F.when(F.abs("_o") == at + step - 1, content.distance(c)).alias("_front"))
            met = rows if met is None else met.unionByName(rows)
        met = cut_lineage(met)
        # a list whose outermost places are both past its ends has been seen whole
        fronts = met.groupBy("a_cell").agg(*[F.min(F.when(F.col("_list") == name, F.col("_front"))).alias(f"f_{name}") for name, _ in lists])
        new = met.groupBy("a_cell", "cell").agg(F.first("_size").alias("_size"), F.first("score").alias("score"))
        seen = new if found is None else found.unionByName(new).groupBy("a_cell", "cell").agg(F.first("_size").alias("_size"), F.first("score").alias("score"))
        w = Window.partitionBy("a_cell").orderBy(F.desc("score")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        seen = seen.join(start.select("a_cell", "need"), "a_cell").withColumn("_held", F.sum("_size").over(w))
        covered = seen.where("_held >= need").groupBy("a_cell").agg(F.max("score").alias("enough"))
        found = cut_lineage(seen.join(covered, "a_cell", "left").where(F.col("enough").isNull() | (F.col("score") >= F.col("enough")))
                            .select("a_cell", "cell", "_size", "score"))

        def bound(kind: str, weight: float) -> Column:
            fronts_ = [F.col(f"f_{kind}_{c}") for c in near]
            value = reduce(add, [F.lit(w) / (F.lit(1.0) + f) for f, w in zip(fronts_, content.near.values(), strict=True)]) + weight
            return F.coalesce(value, F.lit(-1.0))  # a list without a front has ended
        far = bound("p", whole - (min(content.same.values()) if same else 0.0))
        most = F.greatest(far, F.when(far < 0, -1.0).otherwise(bound("b", whole))) if same else far
        active = cut_lineage(active.join(fronts, "a_cell").join(covered, "a_cell", "left").where(
            (most >= 0) & (F.col("enough").isNull() | (most >= F.col("enough") - 1e-12))).select(active.columns))
        at, step = at + step, 2 * step
    md5 = F.md5("member").desc()
    reach = need.agg(F.max("_need")).scalar()
    members = cell_of.withColumn("_k", F.row_number().over(Window.partitionBy("cell").orderBy(md5))).where(F.col("_k") <= reach)
    if found is None:
        return need.sparkSession.createDataFrame([], "anchor string, candidate string, _i int")
    ranked = found.select("a_cell", "cell", "score").join(members, "cell").withColumn("_i", F.row_number().over(Window.partitionBy("a_cell").orderBy(F.desc("score"), md5)))
    return (anchors.withColumnRenamed("cell", "a_cell").join(ranked, "a_cell").where(F.col("_i") <= F.col("_need"))
            .select("anchor", F.col("member").alias("candidate"), "_i"))


def _in_order(pool: DataFrame, on: Sequence[str], place: str, member: str, name: str) -> DataFrame:
    """One row per key with the members of its pool by place."""
    members = F.transform(F.array_sort(F.collect_list(F.struct(place, member))), lambda s: s[member])
    return pool.groupBy(*on).agg(members.alias(name))


def listed_negatives(records: DataFrame, queries: DataFrame, keys: Sequence[str], mode: str, seed, pool_keys: Sequence[str],
                     content: Content | None, props: DataFrame | None, fragment: str, max_pool: int) -> DataFrame | None:
    """``queries`` with ``_own``, the fragments of its group, and ``_negatives``, an array of (candidate, tier); None beyond
    ``max_pool`` rows of a pool.

    The pools are short next to the draws, so they travel to the queries: a query reads its places, drops its own fragments
    and keeps what it wants inside its row. No draw is joined, sorted or moved.
    """
    own = records.where(F.col(fragment).isNotNull()).groupBy(*keys).agg(F.collect_set(fragment).alias("_own"))
    base = queries.join(own, list(keys), "left").withColumn("_own", F.coalesce("_own", F.array().cast("array<string>")))
    reach, start = F.col("want") + F.col("n_fragments"), hash_int(F.col("query_id"))
    free = lambda a: F.filter(a, lambda c: ~F.coalesce(F.array_contains("_own", c), F.lit(False)))
    tier = lambda a, i: F.transform(a, lambda c: F.struct(c.alias("candidate"), F.lit(i).alias("tier")))

    def walk(twice: Column, n: Column, steps: Column) -> Column:
        return F.slice(twice, F.pmod(start, n).cast("int") + 1, F.greatest(F.least(steps, n), F.lit(0)).cast("int"))
    if mode == "content":
        need = base.groupBy("anchor").agg(F.max(reach).alias("_need"))
        best, small = broadcast_when_small(content_order(props.where(F.col(fragment).isNotNull()), need, content, fragment), max_pool)
        if not small:
            return None
        lists = F.broadcast(_in_order(best, ["anchor"], "_i", "candidate", "_list"))
        drawn = tier(free(F.col("_list")), 0)
        base = base.join(lists, "anchor")
    else:
        everything, small = broadcast_when_small(_pool(records, [], seed, fragment)[0], max_pool)
        if not small:
            return None
        whole = _in_order(everything, [], "_p", "_f", "_list").select(F.concat("_list", "_list").alias("_all"), F.greatest(F.size("_list"), F.lit(1)).alias("_n"))
        base = base.crossJoin(F.broadcast(whole))
        twice, n = F.col("_all"), F.col("_n")
        if mode == "easy":
            drawn = tier(free(walk(twice, n, reach)), 0)
        else:
            near, small = broadcast_when_small(_pool(records, pool_keys, seed, fragment)[0], max_pool)
            if not small:
                return None
            lists = _in_order(near, pool_keys, "_p", "_f", "_list").select(*pool_keys, F.concat("_list", "_list").alias("_twice"), F.size("_list").alias("_size"))
            base = base.join(F.broadcast(lists), list(pool_keys), "left")
            base = base.withColumn("_near", F.coalesce(walk(F.col("_twice"), F.col("_size"), reach), F.array().cast("array<string>")))
            rest = F.array_except(walk(twice, n, reach * 2), F.col("_near"))
            drawn = F.concat(tier(free(F.col("_near")), 0), tier(free(rest), 1))
    return base.withColumn("_negatives", F.slice(drawn, 1, F.greatest(F.col("want"), F.lit(0)))).select(*queries.columns, "_own", "_negatives")


def negatives(records: DataFrame, queries: DataFrame, keys: Sequence[str], mode: str = "easy", seed=7,
              pool_keys: Sequence[str] = (), content: Content | None = None, props: DataFrame | None = None,
              fragment="fragment", carry: Sequence[str] = (), max_pool: int = BROADCAST_ROWS) -> DataFrame:
    """Requested negatives per query, never a fragment of the query's own group: query_id, candidate, tier and the
    columns of the query named in ``carry``.

    easy: hash order over the whole vocabulary. same_target: the pool of ``pool_keys`` first, then the vocabulary.
    content: highest content score first, over all fragments of ``props``. Pools of more than ``max_pool`` rows are joined.
    """
    keys, pool_keys, carry = list(keys), list(pool_keys), list(carry)
    if mode not in ("easy", "same_target", "content"):
        raise ValueError(f"unsupported negative mode: {mode}")
    lists = listed_negatives(records, queries, keys, mode, seed, pool_keys, content, props, fragment, max_pool)
    if lists is not None:
        return lists.select("query_id", *carry, F.explode("_negatives").alias("_e")).select("query_id", "_e.*", *carry)
    own = records.select(*keys, F.col(fragment).alias("candidate")).distinct()
    base = queries.select("query_id", *keys, "anchor", "n_fragments", "want")
    everything, size = _pool(records, [], seed, fragment)
    reach = F.col("want") + F.col("n_fragments")
    rank = [F.col("tier"), F.col("_i")]
    if mode == "easy":
        drawn = _walk(base.withColumn("_size", size.scalar()), everything, [], reach, 0)
    elif mode == "same_target":
        near, near_size = _pool(records, pool_keys, seed, fragment)
        first = _walk(base.join(near_size, pool_keys), near, pool_keys, reach, 0)
        rest = _walk(base.withColumn("_size", size.scalar()), everything, [], reach * 2, 1)
        drawn = first.unionByName(rest).groupBy("query_id", "candidate").agg(
            F.min(F.struct("tier", "_i")).alias("_s")).select("query_id", "candidate", "_s.tier", "_s._i")
    else:
        # the score depends on (anchor, candidate) only: rank once per anchor, then serve all of its queries
        need = base.groupBy("anchor").agg(F.max(reach).alias("_need"))
        best = content_order(props.where(F.col(fragment).isNotNull()), need, content, fragment)
        drawn = base.select("query_id", "anchor").join(best, "anchor").select(
            "query_id", "candidate", F.lit(0).alias("tier"), "_i")
    free = (drawn.join(base.select("query_id", *keys, "want"), "query_id")
            .join(own, [*keys, "candidate"], "left_anti"))
    w = Window.partitionBy("query_id").orderBy(*rank, "candidate")
    out = free.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= F.col("want")).select("query_id", "candidate", "tier")
    return out.join(queries.select("query_id", *carry), "query_id") if carry else out


def build_candidate_matrix(records: DataFrame, keys: Sequence[str], dataset: str = "matrix", mode: str = "easy",
                           ratio: int = 5, min_candidates: int = 20, fragment="fragment", entity="entity",
                           seed=7, pool_keys: Sequence[str] = (), content: Content | None = None, props: DataFrame | None = None,
                           max_pool: int = BROADCAST_ROWS) -> DataFrame:
    """Positives are the pairs of the query's group, negatives those of :func:`negatives`; queries without negatives are
    left out. Next to short pools a query's rows are made from its own row."""
    keys = list(keys)
    q = matrix_queries(records, keys, dataset, ratio=ratio, min_candidates=min_candidates, fragment=fragment,
                       entity=entity)
    kw = dict(seed=seed, pool_keys=list(pool_keys), content=content, props=props)
    lists = listed_negatives(records, q, keys, mode, fragment=fragment, max_pool=max_pool, **kw)
    if lists is not None:
        row = lambda c, y: F.struct(c.alias("candidate"), F.lit(y).alias("label"))
        rows = F.concat(F.transform(F.filter("_own", lambda c: c != F.col("anchor")), lambda c: row(c, 1)),
                        F.transform("_negatives", lambda e: row(e["candidate"], 0)))
        return (lists.where(F.size("_negatives") > 0).withColumn("_e", F.explode(rows))
                .select("query_id", "_e.*", *keys, "anchor", "n_fragments", "support", "n_positive").withColumn("dataset", F.lit(dataset)))
    kw["max_pool"] = max_pool
    neg = negatives(records, q, keys, mode, fragment=fragment, **kw).select("query_id", "candidate").withColumn(
        "label", F.lit(0))
    pairs = mine_pairs(records, keys, fragment, entity)
    pos = pairs.join(q.select(*keys, F.col("anchor").alias("old_fragment"), "query_id"), [*keys, "old_fragment"])
    pos = (pos.select("query_id", F.col("new_fragment").alias("candidate"))
           .join(neg.select("query_id").distinct(), "query_id", "left_semi").withColumn("label", F.lit(1)))
    head = q.select("query_id", *keys, "anchor", "n_fragments", "support", "n_positive")
    return pos.unionByName(neg).join(head, "query_id").withColumn("dataset", F.lit(dataset))


def matrix_audit(matrix: DataFrame) -> DataFrame:
    per = matrix.groupBy("query_id").agg(F.count("*").alias("n"), F.sum("label").alias("p"))
    sizes = per.agg(F.count("*").alias("queries"), F.sum("n").alias("rows"), F.sum("p").cast("bigint").alias("positives"),
                    F.min("n").alias("min_candidates"), F.max("n").alias("max_candidates"))
    keys = matrix.agg(F.countDistinct("anchor").alias("anchors"), F.countDistinct("candidate").alias("candidates"))
    return sizes.withColumn("_k", keys.select(
        F.struct(*keys.columns)).scalar()).select(*sizes.columns, "_k.*")


#: Comparisons a fact up to which facts meet by condition first.
MEETINGS_PER_FACT = 64


def comparable_pairs(pairs: DataFrame, facts: DataFrame, on: Sequence[str], value="value",
                     entity="entity") -> DataFrame:
    """Both sides of a pair measured under the same conditions; delta = new - old.

    Facts meet under their condition, once for both directions, and what has met is joined with the pairs: a pair is not
    repeated for every fact of its old side. Where conditions hold so many facts that this would be more than
    ``MEETINGS_PER_FACT`` meetings a fact, the pairs are joined with the facts of their old side instead.
    """
    sizes = facts.groupBy(*on).agg(F.count("*").cast("double").alias("n"))
    total = sizes.agg(F.sum("n"), F.sum(F.col("n") * F.col("n")) / 2).first()
    if total[0] and total[1] <= MEETINGS_PER_FACT * total[0]:
        a = facts.select(F.col(entity).alias("_a"), *on, F.col(value).alias("_va"))
        b = facts.select(F.col(entity).alias("_b"), *on, F.col(value).alias("_vb"))
        met = a.join(b, list(on)).where(F.col("_a") <= F.col("_b"))
        ordered = pairs.withColumns({"_a": F.least("old_id", "new_id"), "_b": F.greatest("old_id", "new_id")}).where(
            "old_id is not null and new_id is not null")
        ahead = F.col("old_id") <= F.col("new_id")
        sides = {"_old": F.when(ahead, F.col("_va")).otherwise(F.col("_vb")), "_new": F.when(ahead, F.col("_vb")).otherwise(F.col("_va"))}
        return (ordered.join(met, ["_a", "_b"]).withColumns(sides).drop("_a", "_b", "_va", "_vb")
                .withColumn("delta", F.col("_new") - F.col("_old")).select(
                    "new_id", *on, "old_id", *[c for c in pairs.columns if c not in ("new_id", "old_id")], "_old", "_new", "delta"))
    old = facts.select(F.col(entity).alias("old_id"), *on, F.col(value).alias("_old"))
    new = facts.select(F.col(entity).alias("new_id"), *on, F.col(value).alias("_new"))
    return (pairs.join(old, "old_id").join(new, ["new_id", *on])
            .withColumn("delta", F.col("_new") - F.col("_old")))


def delta_summary(compared: DataFrame, key="pair_id") -> DataFrame:
    """Per pair median, extremes and number of comparisons."""
    from rankspark.operators.quantiles import exact_quantiles
    compared = cut_lineage(compared.select(key, "delta"))
    base = compared.groupBy(key).agg(F.count("*").alias("n"), F.min("delta").alias("min_delta"),
                                     F.max("delta").alias("max_delta"))
    return base.join(exact_quantiles(compared, "delta", [0.5], [key], ["median_delta"]), key)


def pair_join_audit(pairs: DataFrame, facts: DataFrame, target: str, condition: str, entity="entity") -> DataFrame:
    """Per pair whether both sides have facts, a common target, a common condition, both at once.

    An entity's targets and conditions travel as sets, so a pair is one row however many facts its sides have.
    """
    met = F.col(target).isNotNull() & F.col(condition).isNotNull()
    sets = facts.groupBy(entity).agg(F.collect_set(target).alias("t"), F.collect_set(condition).alias("c"),
                                     F.collect_set(F.when(met, F.struct(target, condition))).alias("b"))
    side = lambda name: sets.select(F.col(entity).alias(name), F.struct("t", "c", "b").alias(f"_{name}"))
    p = pairs.select("pair_id", "old_id", "new_id").join(side("old_id"), "old_id", "left").join(side("new_id"), "new_id", "left")
    shared = lambda x: F.arrays_overlap(F.col("_old_id")[x], F.col("_new_id")[x])
    flags = {"both_have": F.col("_old_id").isNotNull() & F.col("_new_id").isNotNull(), "same_target": shared("t"),
             "same_condition": shared("c"), "comparable": shared("b")}
    p = p.select("pair_id", *[flag(F.coalesce(f, F.lit(False))).alias(n) for n, f in flags.items()])
    return p.groupBy("pair_id").agg(*[F.max(n).alias(n) for n in flags])


def property_matched(requests: DataFrame, pool: DataFrame, n: int, seed, key="context", bin="bin",
                     request="request_id", member="fragment", width: int = 1) -> DataFrame:
    """Per request n pool members of the same key within ``width`` bins, in hash order."""
    r = requests.select(request, key, F.col(member).alias("_own"),
                        F.explode(F.sequence(F.col(bin) - width, F.col(bin) + width)).alias(bin))
    p = pool.select(key, bin, member).distinct()
    j = r.join(p, [key, bin]).where(F.col(member) != F.col("_own"))
    w = Window.partitionBy(request).orderBy(hash_order(seed, request, member), member)
    return j.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= n).select(request, key, member, "pick")
