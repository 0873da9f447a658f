"""Exact duplicates against grouping by text; the cuckoo table and the live index against sets."""
import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from rankspark.llm import exact

SCHEMA = "doc_id long, text string, key string, row int, n long, shard string, digest string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "k", 1, 2, "s", "d") for i, t in rows], SCHEMA)


def digests(texts):
    return np.frombuffer(b"".join(hashlib.sha256(str(t).encode()).digest() for t in texts), np.uint8).reshape(-1, 32)


@pytest.mark.parametrize("width", [1 << 64, 3])
def test_table_follows_a_set_through_inserts_deletes_and_overflow(monkeypatch, width):
    if width == 3:  # few fingerprints: false hits everywhere, so every answer rests on the stored keys
        plain = exact.CuckooTable.hashed

        def poor(d):
            _, first, _ = plain(d)
            prints = (first % np.uint64(3)).astype(np.int64) + 1
            return prints, first, exact.mix(prints.astype(np.uint64))
        monkeypatch.setattr(exact.CuckooTable, "hashed", staticmethod(poor))
    r, table, live = random.Random(1), exact.CuckooTable(), set()
    for turn in range(60):
        new = sorted({r.randrange(5000) for _ in range(120)} - live)
        table.insert(digests(new))
        live |= set(new)
        if turn % 2:
            out = r.sample(sorted(live), len(live) // 3)
            assert len(table.delete(digests(out))) == len(out)
            live -= set(out)
            assert len(table.delete(digests(out[:1]))) == 0
        assert len(table) == len(live)
        assert set(np.flatnonzero(table.find(digests(range(5000))) >= 0).tolist()) == live
    assert table.buckets > 2  # it has overflowed


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    top = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(str((i, top[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest())) for i, t in rows), len(groups)


@pytest.mark.parametrize(("shard", "piece"), [(50_000, 200_000), (7, 5)])
def test_duplicates_equal_grouping(spark, monkeypatch, shard, piece):
    monkeypatch.setattr(exact, "SHARD_KEYS", shard)
    monkeypatch.setattr(exact, "PIECE", piece)
    r = random.Random(3)
    rows = [(i, f"text {r.randrange(60)}") for i in range(200)] + [(i, "hot") for i in range(300, 500)]
    rows += [(1, None), (2, ""), (3, " "), (3, " "), (None, "hot"), (None, "only null"), (None, "only null"), (5, "é" * 200_000), (6, "é" * 200_000), (-4, "text 1")]
    got = exact.exact_duplicates(docs(spark, rows)).collect()
    want, groups = brute(rows)
    assert sorted(str((x.doc_id, x.keep_id, x.group_size, x.text_sha256)) for x in got) == want
    kept = [x for x in got if x.kept]
    assert len(kept) == len({x.text_sha256 for x in kept}) == groups and all(x.doc_id == x.keep_id for x in kept)
    assert exact.exact_duplicates(docs(spark, [])).collect() == []


def test_live_index_inserts_and_deletes(spark, monkeypatch):
    monkeypatch.setattr(exact, "SHARD_KEYS", 5)
    first, more = [(i, f"t{i % 7}") for i in range(20)], [(i, f"t{i % 11}") for i in range(20, 60)]
    index = exact.LiveIndex.empty(spark).insert(docs(spark, first)).insert(docs(spark, more))
    gone = [x for x in first + more if x[1] in ("t3", "t10")] + [(59, f"t{59 % 11}"), (1, "not there")]
    live = [x for x in first + more if x not in gone]
    shrunk = index.delete(docs(spark, gone))
    grown = shrunk.insert(docs(spark, [(99, "t3")]))
    for state, rows in ((index, first + more), (shrunk, live), (grown, [*live, (99, "t3")])):
        asked = exact.digested(docs(spark, [(i, f"t{i}") for i in range(12)]))
        found = {x.key: (x.n, x.keep) for x in asked.join(state.lookup(asked), "row").collect()}
        of = defaultdict(list)
        for i, t in rows:
            of[t].append(i)
        assert found == {i: (len(of[f"t{i}"]), max(of[f"t{i}"], default=None)) for i in range(12)}
