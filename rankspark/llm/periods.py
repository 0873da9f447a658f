"""Runs of periodic words: stretches that repeat a group of words at least four times.

A run of smallest period p and length L matches itself at distance p in L - p >= 3 p consecutive places, so one of the
grid places 0, 3p, 6p, ... of its text lies among them: the grids of all periods have n/3 times a harmonic sum of places.
From a matching place the match is extended both ways, first by a few direct comparisons, which settle nearly all places,
then by longest-common-extension queries.

Those sort only the suffixes at the places of a difference cover: for any two places there is an offset below the modulus
at which both are sampled. A query compares the words before it directly and reads the rest as the least of the common
prefixes between two ranks, from a sparse table.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankspark.llm.common import slices, utf8
from rankspark.llm.words import SEPARATOR

#: A perfect difference set: every residue is the difference of two members (fixed values).
MODULUS, COVER = 31, (0, 1, 3, 8, 12, 18)
#: Grid places looked at in one step.
STEP = 1 << 21

COLUMNS = ("n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")


def sync_offsets(modulus: int = MODULUS, cover: tuple[int, ...] = COVER) -> np.ndarray:
    """[i mod m, j mod m] -> the least offset d at which both i + d and j + d are sampled."""
    inside = np.zeros(modulus, bool)
    inside[list(cover)] = True
    r = np.arange(modulus)
    out = np.full((modulus, modulus), -1)
    for d in range(modulus):
        both = inside[(r[:, None] + d) % modulus] & inside[(r[None, :] + d) % modulus]
        out[(out < 0) & both] = d
    return out


SYNC = sync_offsets()


def extend(words: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray | int, step: int = 1) -> np.ndarray:
    """How many words agree from i and j on (backwards for step -1), ``most`` at most, by direct comparison."""
    out = np.zeros(len(i), np.int64)
    most = np.broadcast_to(most, len(i))
    live = np.flatnonzero(most > 0)
    k = 0
    while len(live):
        live = live[words[i[live] + step * k] == words[j[live] + step * k]]
        k += 1
        out[live] = k
        live = live[most[live] > k]
    return out


class CommonExtension:
    """Longest common extensions of places in ``words``. Pairs asked for must differ before the end of the words."""

    def __init__(self, words: np.ndarray) -> None:
        n = len(words)
        ranks = np.unique(words, return_inverse=True)[1].astype(np.int64)
        blocks = n // MODULUS + 1
        # past the end come words that occur once
        self.words = np.concatenate([ranks, np.arange(n, n + 2 * MODULUS + 1)])
        place = (np.arange(blocks)[:, None] * MODULUS + np.array(COVER)).ravel()
        self.slot = np.full(MODULUS, -1)
        self.slot[list(COVER)] = np.arange(len(COVER))
        levels = [self._windows(place)]
        jump = len(COVER)
        while levels[-1].max() + 1 < len(place):
            before = levels[-1].astype(np.int64)
            later = np.full(len(place), -1, np.int64)
            later[:-jump] = before[jump:] if jump < len(place) else -1
            if jump >= len(place):  # equal ranks past every end: the words there occur once
                later = -1 - np.arange(len(place))
            levels.append(np.unique(before * (2 * len(place) + 1) + later, return_inverse=True)[1].astype(np.int32))
            jump *= 2
        self.rank = levels[-1]
        order = np.argsort(self.rank, kind="stable")
        x, y = order[:-1].copy(), order[1:].copy()
        common = np.zeros(len(x), np.int64)
        for k in range(len(levels) - 2, -1, -1):
            inside = (x < len(place)) & (y < len(place))
            at = np.flatnonzero(inside)
            at = at[levels[k][x[at]] == levels[k][y[at]]]
            x[at] += len(COVER) << k
            y[at] += len(COVER) << k
            common[at] += MODULUS << k
        del levels
        inside = np.flatnonzero((x < len(place)) & (y < len(place)))
        common[inside] += extend(self.words, place[x[inside]], place[y[inside]], MODULUS)
        self.table = [common.astype(np.int32)]
        width = 1
        while 2 * width <= len(common):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def _windows(self, place: np.ndarray) -> np.ndarray:
        """Ranks of the MODULUS words from every sampled place, some words packed into each sort key."""
        size = int(self.words.max()) + 1
        bits = max(1, size.bit_length())
        rank = np.zeros(len(place), np.int64)
        at, top = 0, 1
        while at < MODULUS:
            used = top.bit_length()
            while at < MODULUS and used + bits <= 62:
                rank = (rank << bits) | self.words[place + at]
                used += bits
                at += 1
            rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
            top = int(rank.max()) + 1
        return rank.astype(np.int32)

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        d = SYNC[i % MODULUS, j % MODULUS]
        out = extend(self.words, i, j, d)
        go = np.flatnonzero(out == d)
        x, y = (self.rank[self._sample(z[go] + d[go])] for z in (i, j))
        lo, hi = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        least = np.zeros(len(go), np.int64)
        for k in np.unique(level):
            here = np.flatnonzero(level == k)
            t = self.table[k]
            least[here] = np.minimum(t[lo[here]], t[hi[here] - (1 << int(k))])
        out[go] += least
        return out

    def _sample(self, place: np.ndarray) -> np.ndarray:
        return place // MODULUS * len(COVER) + self.slot[place % MODULUS]


def runs(words: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """(row, start, length, period) of all runs of every row, ordered by row, start, period; starts count within the row.

    ``words`` are whole numbers from 0, ``rows`` their offsets per row.
    """
    n, k = np.diff(rows), len(rows) - 1
    # a word that occurs once before, between and after the rows
    walled = np.empty(len(words) + k + 1, np.int64)
    wall = rows + np.arange(k + 1)
    inside = np.ones(len(walled), bool)
    inside[wall] = False
    walled[inside], walled[wall] = words, -1 - np.arange(k + 1)
    base, periods = wall[:-1] + 1, n // 4
    pair_row = np.repeat(np.arange(k), periods)
    pair_p = 1 + np.arange(len(pair_row)) - np.repeat(np.cumsum(periods) - periods, periods)
    count = -(-(n[pair_row] - pair_p) // (3 * pair_p))
    ends = np.cumsum(count)
    kept: list[np.ndarray] = []
    at = 0
    while at < len(pair_row):
        # one pair may have more places than a step
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP, "right")))
        c, p = count[at:to], pair_p[at:to]
        pair = np.repeat(np.arange(to - at), c)
        place = base[pair_row[at:to]][pair] + 3 * p[pair] * (np.arange(len(pair)) - np.repeat(np.cumsum(c) - c, c))
        hit = np.flatnonzero(walled[place] == walled[place + p[pair]])
        row, p, i = pair_row[at:to][pair[hit]], p[pair[hit]], place[hit]
        need = np.maximum(3 * p, 5)
        ahead = extend(walled, i, i + p, MODULUS)
        back = extend(walled, i - 1, i + p - 1, MODULUS, -1)
        go = np.flatnonzero((ahead + back >= need) | (ahead == MODULUS) | (back == MODULUS))
        kept.append(np.stack([row[go], p[go], i[go], ahead[go], back[go]]))
        at = to
    if not kept:
        return np.zeros((0, 4), np.int64)
    row, p, i, ahead, back = np.concatenate(kept, axis=1)
    far, near = np.flatnonzero(ahead == MODULUS), np.flatnonzero(back == MODULUS)
    if len(far) or len(near):
        # only the rows with open places are sorted, walls included
        open_rows = np.unique(row[np.concatenate([far, near])])
        sizes = n[open_rows] + 2
        first = np.cumsum(sizes) - sizes
        source = np.repeat(wall[open_rows] - first, sizes) + np.arange(int(sizes.sum()))
        part = walled[source]
        walls = np.concatenate([first, first + sizes - 1])
        part[walls] = -1 - np.arange(len(walls))
        move = np.zeros(k, np.int64)
        move[open_rows] = first - wall[open_rows]
        if len(far):
            x = i[far] + move[row[far]]
            ahead[far] = CommonExtension(part)(x, x + p[far])
        if len(near):
            x = len(part) - i[near] - move[row[near]]  # the mirror of the word before i
            back[near] = CommonExtension(part[::-1])(x, x - p[near])
    fine = ahead + back >= np.maximum(3 * p, 5)
    row, p, start, length = row[fine], p[fine], (i - back - base[row])[fine], (ahead + back + p)[fine]
    # a multiple of the smallest period gives the same stretch: the least period of each stretch stays
    order = np.lexsort((p, length, start, row))
    found = np.stack([row, start, length, p], axis=1)[order]
    first = np.ones(len(found), bool)
    first[1:] = (found[1:, :3] != found[:-1, :3]).any(axis=1)
    found = found[first]
    return found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number, start byte and size of every word in order, equal numbers for equal words only, and the offsets per row."""
    n = len(data)
    inside = ~SEPARATOR[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:n]
    ends[:-1] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    at = np.concatenate([[0], np.cumsum(end - start)])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(data[inside])])
    ids = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    return ids, start, end - start, np.searchsorted(start, offsets)


def planted(rows: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The word that stands at each place once rows with h mod 10 = 0 are made periodic from a place on (h < 0: never)."""
    out = np.arange(rows[-1])
    for r in np.flatnonzero((h >= 0) & (h % 10 == 0) & (np.diff(rows) > 0)):
        n, g = int(rows[r + 1] - rows[r]), int(h[r]) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        out[rows[r] + a:rows[r + 1]] = rows[r] + a + np.arange(n - a) % p
    return out


def dropped(found: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Whether each word lies in a run after that run's first period."""
    change = np.zeros(int(rows[-1]) + 1, np.int64)
    begin = rows[found[:, 0]] + found[:, 1]
    np.add.at(change, begin + found[:, 3], 1)
    np.add.at(change, begin + found[:, 2], -1)
    return np.cumsum(change)[:-1] > 0


def joined(data: np.ndarray, start: np.ndarray, size: np.ndarray, row: np.ndarray, k: int) -> tuple[bytes, np.ndarray]:
    """The words of each row with one space after every word, and the rows' byte offsets."""
    to = np.cumsum(size + 1)
    out = np.full(int(to[-1]) if len(to) else 0, 0x20, np.uint8)
    write = np.ones(len(out), bool)
    write[to - 1] = False
    shift = start - (np.cumsum(size) - size)
    out[write] = data[np.repeat(shift, size) + np.arange(int(size.sum()))]
    return out.tobytes(), np.concatenate([[0], to])[np.searchsorted(row, np.arange(k + 1))]


def _results(data: np.ndarray, offsets: np.ndarray, h: np.ndarray) -> Iterator[tuple]:
    ids, start, size, rows = tokens(data, offsets)
    word = planted(rows, h)
    ids, start, size = ids[word], start[word], size[word]
    found = runs(ids, rows)
    k = len(rows) - 1
    stay = np.flatnonzero(~dropped(found, rows))
    row_of = np.repeat(np.arange(k), np.diff(rows))[stay]
    text, at = joined(data, start[stay], size[stay], row_of, k)
    part = np.searchsorted(found[:, 0], np.arange(k + 1))
    for r in range(k):
        mine = found[part[r]:part[r + 1], 1:].tolist()
        best = None
        for s, length, p in mine:  # in order of start and period: the first of equals stays
            if best is None or length * best[2] > best[1] * p:
                best = (s, length, p)
        listed = "".join(f"{s},{length},{p}\n" for s, length, p in mine)
        yield (len(mine), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
               hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text[at[r]:max(at[r], at[r + 1] - 1)]).hexdigest())


def periodic(df: DataFrame, key: str = "doc_id", text: str = "text", plant: bool = False) -> DataFrame:
    """key, n_runs, start, length, period, exponent_milli of the run of greatest exponent, digests of all runs and of the
    words outside repetitions.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text. A run has a smallest period q, at least max(6, 4 q) words, and no
    neighbour that keeps the period. Without runs the four columns of the greatest are null. With ``plant`` rows whose
    crc32(key) is divisible by 10 are made periodic first. Null and empty texts have no words and the digests of nothing; a
    null key gives a row (never planted); repeated rows give equal rows; an empty table gives none; no other column is read.
    Rows are independent: no shuffle, steps of about one megabyte of text, a longer text is a step of its own.
    """
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"),
                     (F.coalesce(F.crc32(F.col(f"`{key}`").cast("string")), F.lit(-1)) if plant else F.lit(-1)).cast("long").alias("h"))
    names = ["key", *(c.split()[0] for c in COLUMNS.split(", "))]
    kinds = [*[pa.int64()] * 5, pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            h = batch.column(2).to_numpy()
            for lo, hi in slices(offsets):
                got = _results(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], h[lo:hi])
                columns = [pa.array(c, t) for c, t in zip(zip(*got, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *columns], names=names)
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, {COLUMNS}").withColumnRenamed("key", key)
