"""Periodic runs against a scan of every period, common extensions against comparison, odd rows."""
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from rankspark.llm import periods

SCHEMA = "doc_id long, text string, key string, h long, word int, start long"


def every_run(words):
    found = {}
    for p in range(1, len(words) // 4 + 1):
        i = 0
        while i + p < len(words):
            start = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            length = i - start + p
            if length >= max(6, 4 * p) and i > start:
                found.setdefault((start, length), p)
            i += i == start
    return sorted((s, p, n) for (s, n), p in found.items())


def repetitive(r, most):
    out = []
    while len(out) < most:
        x = r.random()
        if x < 0.4:
            out += [r.randrange(3) for _ in range(r.randrange(1, 9))] * r.randrange(1, 20)
        elif x < 0.5:
            out += out[-40:] * r.randrange(1, 5)
        else:
            out += [r.randrange(50) for _ in range(r.randrange(1, 20))]
    return out


@pytest.mark.parametrize("step", [7, 1 << 21])
def test_runs_equal_a_scan_of_every_period(monkeypatch, step):
    monkeypatch.setattr(periods, "STEP", step)
    r = random.Random(step)
    for _ in range(60 if step > 7 else 10):
        rows = [repetitive(r, r.choice([0, 3, 30, 400])) for _ in range(r.randrange(1, 9))]
        got = periods.runs(np.array([x for w in rows for x in w], np.int64), np.concatenate([[0], np.cumsum([len(w) for w in rows])]).astype(np.int64))
        assert [tuple(x) for x in got.tolist()] == [(i, s, n, p) for i, w in enumerate(rows) for s, p, n in every_run(w)]


def test_cover_and_common_extensions():
    assert (periods.SYNC >= 0).all() and set(periods.SYNC.ravel()) <= set(range(periods.MODULUS))
    r = random.Random(4)
    for _ in range(40):
        words = np.array([r.randrange(2) for _ in range(r.randrange(1, 60))] * r.randrange(1, 9) + [7])
        common = periods.CommonExtension(words)
        pairs = [(i, j) for i, j in ((r.randrange(len(words)), r.randrange(len(words))) for _ in range(100)) if i != j]
        if not pairs:
            continue
        want = []
        for i, j in pairs:
            k = 0
            while max(i, j) + k < len(words) and words[i + k] == words[j + k]:
                k += 1
            want.append(k)
        assert common(*np.array(pairs).T).tolist() == want


def brute_row(key, text, plant):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(key).encode()), len(w)
    if plant and key is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    found = every_run(w)
    best = max(found, key=lambda x: (x[2] / x[1], -x[0], -x[1]), default=None)
    gone = {i for s, p, m in found for i in range(s + p, s + m)}

    def sha(x):
        return hashlib.sha256(x.encode()).hexdigest()
    return (key, len(found), *((best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4),
            sha("".join(f"{s},{m},{p}\n" for s, p, m in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


@pytest.mark.parametrize("plant", [False, True])
def test_odd_rows(spark, plant):
    r = random.Random(9)
    rows = [(1, None), (2, ""), (3, " \t\n\x0b"), (4, "a"), (5, "a a a a a"), (6, "a a a a a a"), (6, "a a a a a a"), (None, "x y x y x y x y"), (7, "é è é è é è é è "),
            (8, "\x0bA a\x1ca a a a a a"), (9, "ab " * 3000), (10, "w" * 300_000 + " z" * 6)]
    rows += [(i, " ".join(f"w{x}" for x in repetitive(r, r.choice([5, 60, 300])))) for i in range(11, 90)]
    df = spark.createDataFrame([(*x, "k", 5, 6, 7) for x in rows], SCHEMA)
    got = periods.periodic(df, plant=plant).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(brute_row(i, t, plant)) for i, t in rows)
    assert periods.periodic(df.limit(0)).collect() == []


def test_a_long_text_of_many_runs():
    r = random.Random(2)
    words = np.array(repetitive(r, 60_000))
    got = periods.runs(words, np.array([0, len(words)]))
    at = 31_000  # a scan of a window: runs that lie inside it and do not touch its ends
    window = words[at:at + 3000].tolist()
    inside = [(s + at, p, n) for s, p, n in every_run(window) if s > 0 and s + n < len(window)]
    assert set(inside) == {(s, p, n) for _, s, n, p in got.tolist() if s > at and s + n < at + len(window) and 4 * p <= len(window)}
