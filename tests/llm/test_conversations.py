"""Conversation repair against a best-first search over all edits, its SQL twin on odd rows, and long conversations."""
import hashlib
import heapq
import random
import re

import duckdb
import pytest

from rankspark.llm import conversations, queries


def cheapest(rows):
    """(cost, audit) of the cheapest edits of (role, text, fault) rows, ties to the least audit."""
    done, queue = {}, [(0, "", 0, 0)]
    while queue:
        cost, audit, i, state = heapq.heappop(queue)
        if (i, state) in done:
            continue
        done[i, state] = (cost, audit)
        given = {0: 2, 1: 2, 2: 3, 3: 2}[state]
        heapq.heappush(queue, (cost + 3, audit + "I", i, given))
        if i < len(rows):
            role, _, fault = rows[i]
            heapq.heappush(queue, (cost + 4, audit + "D", i + 1, state))
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                heapq.heappush(queue, (cost + 3 + extra, audit + "R", i + 1, given))
                to = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}.get(role[:1], {}).get(state)
                if to is not None:
                    heapq.heappush(queue, (cost + extra, audit + "K", i + 1, to))
    return min(done[len(rows), 0], done[len(rows), 3])


@pytest.mark.parametrize("settle", [4, 4096])
def test_audits_equal_a_search_over_all_edits(monkeypatch, settle):
    monkeypatch.setattr(conversations, "SETTLE", settle)
    r = random.Random(settle)
    for _ in range(600):
        rows = [(r.choice(["user", "assistant", "system", "tool", ""]), f"t{i}", r.choice([None, None, None, "blank", "duplicate", "truncated"]))
                for i in range(r.randrange(15))]
        one = conversations.Repair()
        for i, (role, text, fault) in enumerate(rows):
            one.row(i, role, text.encode(), fault)
        *_, cost, audit, digest = one.result()
        assert (cost, audit) == cheapest(rows)
        repaired = conversations.replayed(audit, [(a, b) for a, b, _ in rows])
        assert re.fullmatch("(s?(ua)+)?", "".join(a[0] for a, _ in repaired))
        assert digest == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in repaired).encode()).hexdigest()


def test_order_of_linked_audits_and_a_planted_collision(monkeypatch):
    r = random.Random(5)

    def built(tree, text):
        node = 0
        for c in text:
            node = tree.add(node, c)
        return node
    for modulus in ((1 << 61) - 1, 3):  # three residues: every comparison meets collisions
        monkeypatch.setattr(conversations.Audits, "MODULUS", modulus)
        tree = conversations.Audits()
        texts = ["".join(r.choice("DIKR") if r.random() < 0.1 else "K" for _ in range(r.randrange(40))) for _ in range(60)]
        nodes = [built(tree, t) for t in texts]
        assert all(tree.less(x, y) == (a < b) for x, a in zip(nodes, texts) for y, b in zip(nodes, texts))


ROWS = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi?"), (1, 2, "assistant", "Hello."), (1, None, None, None), (1, 2, "assistant", "Hello."),
        (1, 9, "user", "Hi?"), (2, 5, "user", ""), (2, 5, "tool", "x!"), (2, 5, "assistant", "x \n\t"), (None, 0, "user", "a."), (None, None, "user", "b."),
        (4, 1, "user", "word " * 200_000 + "."), (4, 2, "assistant", "é" * 1000), (5, 3, "", "No role."), (6, -4, "User", "Upper. \x0b")]
SCHEMA = "conv_id long, turn long, role string, text string, conv int, gone string, fault long, seen long, h long"


def test_odd_rows_equal_the_sql(spark, tmp_path):
    r = random.Random(1)
    rows = ROWS + [(c, t, r.choice(["user", "assistant", "system"]), r.choice(["Yes.", "No", "So what?", " ", "Fine!"])) for c in range(10, 60)
                   for t in range(r.randrange(1, 9))]
    spark.createDataFrame([(*x, 1, "g", 2, 3, 4) for x in rows], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(map(str, map(tuple, queries.op11_repair(spark, str(tmp_path)).collect())))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert got == sorted(map(str, con.execute(queries.OP11_SQL).fetchall()))


def test_empty_table_and_undamaged_rows(spark):
    assert conversations.repair(spark.createDataFrame([], SCHEMA)).collect() == []
    got = conversations.repair(spark.createDataFrame([(1, 0, "user", "Hi?", 1, "g", 2, 3, 4), (1, 3, "assistant", "Oh.", 1, "g", 2, 3, 4)], SCHEMA)).first()
    assert (got.gaps, got.illegal, got.cost, got.audit) == (2, 0, 0, "KK")
    assert got.repaired_sha256 == hashlib.sha256(b"user:Hi?\nassistant:Oh.").hexdigest()


def test_a_long_conversation_settles_its_prefix(monkeypatch):
    monkeypatch.setattr(conversations, "SETTLE", 64)
    r, one = random.Random(2), conversations.Repair()
    rows = [(r.choice(["user", "assistant"]), f"t{i}", r.choice([None, "blank", "truncated"])) for i in range(3000)]
    for i, (role, text, fault) in enumerate(rows):
        one.row(i, role, text.encode(), fault)
    *_, cost, audit, _ = one.result()
    assert (cost, audit) == cheapest(rows)
