"""Conversation structure repair: the cheapest audit of edits that gives every conversation a well-formed order of roles.

One forward pass per conversation keeps, for each state of the pattern ``(s?(ua)+)?`` on role initials, the cheapest edits
that reach it. Audits share their prefixes as linked nodes. A node knows its ancestors at distances 1, 2, 4, ... and the
rolling hash of its whole prefix, so two audits of equal cost are compared at the end of their longest common prefix, found
by descending over the ancestors; the prefix that the hashes call equal is then verified node by node up to a shared node.

An audit alone fixes roles and texts of the repaired rows: a state has one role that may follow (after user comes
assistant, else user), and two audits of equal cost that reach one state are never prefixes of each other, because what one
had more would be inserts that cost. So the least prefix stays least whatever follows.
"""
from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters that are no visible character.
BLANKS = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States of the output so far: nothing, after a system row, after user, after assistant. What an initial leads to.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: The role (and state) that an insert or a new role gives in each state.
GIVEN = [(USER, b"user:"), (USER, b"user:"), (ASSISTANT, b"assistant:"), (USER, b"user:")]
WELL_FORMED = {"su", "ua", "au"}
#: Nodes after which the common prefix of all live audits is settled and forgotten.
SETTLE = 4096

COLUMNS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class Audits:
    """A tree of edit initials. Strings are nodes; the root is the empty string."""

    MODULUS, BASE = (1 << 61) - 1, 911_382_323

    def __init__(self) -> None:
        self.up: list[list[int]] = [[]]
        self.last, self.depth, self.hash = [""], [0], [0]
        self.equal: set[tuple[int, int]] = set()

    def add(self, node: int, initial: str) -> int:
        up, far, k = [node], node, 0
        while k < len(self.up[far]):
            far = self.up[far][k]
            up.append(far)
            k += 1
        self.up.append(up)
        self.last.append(initial)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * self.BASE + ord(initial)) % self.MODULUS)
        return len(self.last) - 1

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.last[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def _lifted(self, node: int, depth: int) -> int:
        while self.depth[node] > depth:
            node = self.up[node][(self.depth[node] - depth).bit_length() - 1]
        return node

    def _same(self, x: int, y: int) -> bool:
        """Whether two strings that their hashes call equal are equal, by walking to a shared or known pair of nodes."""
        a, b = x, y
        while a != b and (a, b) not in self.equal:
            if self.last[a] != self.last[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        self.equal.add((x, y))
        return True

    def less(self, x: int, y: int) -> bool:
        """Whether the string of ``x`` sorts before that of ``y``."""
        if x == y:
            return False
        depth = min(self.depth[x], self.depth[y])
        a, b = self._lifted(x, depth), self._lifted(y, depth)
        if self.hash[a] == self.hash[b]:
            if self._same(a, b):
                return self.depth[x] < self.depth[y]
            return self.text(x) < self.text(y)  # a collision of hashes
        for k in range(len(self.up[a]) - 1, -1, -1):
            if k < len(self.up[a]) and self.hash[self.up[a][k]] != self.hash[self.up[b][k]]:
                a, b = self.up[a][k], self.up[b][k]
        if self._same(self.up[a][0], self.up[b][0]):
            return self.last[a] < self.last[b]
        return self.text(x) < self.text(y)


class Repair:
    """The state of one conversation while its rows pass in order. Memory does not grow with the texts."""

    def __init__(self) -> None:
        self.audits = Audits()
        self.settled: list[str] = []
        self.settle_at = SETTLE
        #: state -> (cost, node, digest of the repaired rows so far)
        self.best: dict[int, tuple[int, int, object]] = {NOTHING: (0, 0, hashlib.sha256())}
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.before: str | None = None
        self.least = self.most = self.turn = None
        self.turns = 0
        self._insert()

    def _better(self, best: dict, state: int, cost: int, node: int, initial: str, digest, line: bytes, first: bool) -> None:
        known = best.get(state)
        if known is not None and cost > known[0]:
            return
        new = self.audits.add(node, initial) if initial else node
        if known is None or cost < known[0] or self.audits.less(new, known[1]):
            best[state] = (cost, new, digest, line, first)

    @staticmethod
    def _digested(digest, line: bytes | None, first: bool):
        if line is None:
            return digest
        digest = digest.copy()
        digest.update(line if first else b"\n" + line)
        return digest

    def _insert(self) -> None:
        """Inserts between two rows. They cost, so three rounds reach every state."""
        for _ in range(3):
            new: dict = {}
            for state, (cost, node, digest) in self.best.items():
                to, line = GIVEN[state]
                if to not in self.best or cost + INSERT <= self.best[to][0]:
                    self._better(new, to, cost + INSERT, node, "I", digest, line, state == NOTHING)
            changed = False
            for state, (cost, node, digest, line, first) in new.items():
                known = self.best.get(state)
                if known is None or cost < known[0] or (cost == known[0] and self.audits.less(node, known[1])):
                    self.best[state] = (cost, node, self._digested(digest, line, first))
                    changed = True
            if not changed:
                return

    def row(self, turn: int | None, role: str, text: bytes, fault: str | None) -> None:
        if turn is not None:
            self.least = turn if self.least is None else self.least
            self.turns += turn != self.turn
            self.most = self.turn = turn
        initial = role[:1]
        if self.before is not None:
            self.counts["illegal"] += self.before + initial not in WELL_FORMED
        self.before = initial
        if fault:
            self.counts[fault] += 1
        extra = TRUNCATED if fault == "truncated" else 0
        keep, steps, own = fault not in ("blank", "duplicate"), NEXT.get(initial, {}), role.encode() + b":" + text
        new: dict = {}
        if keep:  # the cheapest first: costlier edits make no node
            for state in steps.keys() & self.best.keys():
                cost, node, digest = self.best[state]
                self._better(new, steps[state], cost + extra, node, "K", digest, own, state == NOTHING)
            for state, (cost, node, digest) in self.best.items():
                to, given = GIVEN[state]
                self._better(new, to, cost + REROLE + extra, node, "R", digest, given + text, state == NOTHING)
        for state, (cost, node, digest) in self.best.items():
            self._better(new, state, cost + DELETE, node, "D", digest, None, False)
        self.best = {s: (cost, node, self._digested(digest, line, first)) for s, (cost, node, digest, line, first) in new.items()}
        self._insert()
        if len(self.audits.last) > self.settle_at:
            self._settle()

    def _settle(self) -> None:
        texts = {s: self.audits.text(node) for s, (_, node, _) in self.best.items()}
        shared = os.path.commonprefix(list(texts.values()))
        self.settled.append(shared)
        self.audits = Audits()
        nodes: dict[tuple[int, str], int] = {}
        for state, (cost, _, digest) in self.best.items():
            node = 0
            for initial in texts[state][len(shared):]:
                if (node, initial) not in nodes:
                    nodes[node, initial] = self.audits.add(node, initial)
                node = nodes[node, initial]
            self.best[state] = (cost, node, digest)
        self.settle_at = 2 * len(self.audits.last) + SETTLE

    def result(self) -> tuple:
        ends = [self.best[s] for s in (NOTHING, ASSISTANT) if s in self.best]
        best = ends[0]
        for end in ends[1:]:
            if end[0] < best[0] or (end[0] == best[0] and self.audits.less(end[1], best[1])):
                best = end
        gaps = 0 if self.most is None else min(self.most - self.least + 1 - self.turns, (1 << 63) - 1)
        audit = "".join(self.settled) + self.audits.text(best[1])
        return (gaps, *self.counts.values(), best[0], audit, best[2].hexdigest())


def damaged(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, text of every row after its damage by crc32("conv:turn") mod 20, and ``gone`` for dropped rows.

    0 drops the row (its texts become null), 1 empties its text, 2 takes out ``.!?``, 3 repeats it, 4 makes it the user's.
    Null roles and texts, and nulls inside the hashed string, are one space.
    """
    def of(name: str, kind: str) -> Column:
        return F.coalesce(F.col(f"`{name}`").cast(kind), F.lit(" "))
    h = F.crc32(F.concat(of(conv, "string"), F.lit(":"), of(turn, "string"))) % 20
    rows = df.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), of(role, "string").alias("role"),
                     of(text, "string").alias("text"), h.alias("h"))
    said = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).when(F.col("h") != 0, F.col("text"))
    rows = rows.select("conv", "turn", F.when(F.col("h") == 4, "user").when(F.col("h") != 0, F.col("role")).alias("role"), said.alias("text"),
                       (F.col("h") == 0).alias("gone"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("h") == 3, 2).otherwise(1))).alias("copy"))
    return rows.drop("copy")


def faults(rows: DataFrame) -> DataFrame:
    """Adds ``fault``, the first of blank, duplicate and truncated that a row has, and orders each conversation in one partition.

    One exchange: the rows of a conversation meet in one partition, where the earlier rows of equal role and text are found by
    a sort that spills, then the rows are put in order of turn (nulls first), role and text.
    """
    rest = F.rtrim(F.col("text"), F.lit(BLANKS))
    rows = rows.repartition("conv").withColumn("seen", F.row_number().over(Window.partitionBy("conv", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first())))
    fault = F.when(F.length(rest) == 0, "blank").when(F.col("seen") > 1, "duplicate").when(~F.right(rest, F.lit(1)).isin(".", "!", "?"), "truncated")
    return rows.withColumn("fault", fault).sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text", "seen")


def _conversations(batches: Iterator[pa.RecordBatch], finish) -> Iterator[tuple]:
    """(conv, what ``finish`` makes of the state) of each conversation of ordered rows, streamed."""
    conv, repair, some = None, None, False
    for batch in batches:
        for key, *row, gone in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not some or key != conv:
                if some:
                    yield conv, finish(repair)
                conv, repair, some = key, Repair(), True
            if not gone:
                turn, role, text, fault = row
                repair.row(turn, role, text.encode(), fault)
    if some:
        yield conv, finish(repair)


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", damage: bool = False) -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    Rows count in order of turn (nulls first), then role, then text. Keeping a row is free, a new role costs 3, deleting 4
    (the only edit for blank and duplicate rows), an inserted row 3, and a truncated row that stays 3 more. The audit is the
    cheapest edits' initials in order, of equal ones the least; its digest covers the repaired ``role:text`` lines. With
    ``damage`` the rows are damaged first; a conversation without rows left has zeros, an empty audit and the digest of
    nothing. A null conversation is one of its own, null roles and texts are one space, repeated rows are duplicates, an
    empty table gives no rows, other columns are not read, and no text is too long: texts pass as a stream.

    The digest of a conversation is a chain over its texts, so one task has to read them in order; it keeps the digest and
    the live end of the audits per state, not the rows, and both sorts spill.
    """
    if damage:
        rows = damaged(df, conv, turn, role, text)
    else:
        rows = df.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), F.coalesce(F.col(f"`{role}`").cast("string"), F.lit(" ")).alias("role"),
                         F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(" ")).alias("text"), F.lit(False).alias("gone"))
    kind = rows.schema["conv"].dataType
    ordered = faults(rows).select("conv", "turn", "role", "text", "fault", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv", *(c.split()[0] for c in COLUMNS.split(", "))]
        held: list[tuple] = []
        size, typed = 0, None

        def out() -> pa.RecordBatch:
            kinds = [typed, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

        def watched() -> Iterator[pa.RecordBatch]:
            nonlocal typed
            for batch in batches:
                typed = batch.schema.field(0).type
                yield batch
        for key, got in _conversations(watched(), Repair.result):
            held.append((key, *got))
            size += 200 + len(got[6])
            if size > 1 << 20:
                yield out()
                held, size = [], 0
        if held:
            yield out()
    return ordered.mapInArrow(run, f"conv {kind.simpleString()}, {COLUMNS}").withColumnRenamed("conv", conv)


def replayed(audit: str, rows: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The repaired (role, text) rows: an audit applied to the rows it was made for."""
    out, state, at = [], NOTHING, 0
    for edit in audit:
        role, text = rows[at] if edit != "I" else ("", "")
        at += edit != "I"
        if edit == "D":
            continue
        if edit != "K":
            role = GIVEN[state][1][:-1].decode()
        state = NEXT[role[:1]][state]
        out.append((role, text))
    return out
