"""Personal data in whole texts: base patterns, and spans that a character-level tagger adds.

The tagger learns from labelled spans (the base spans of a bounded sample, some rewritten into spellings that the patterns
do not know) and on snippets without any. At run time overlapping windows are decoded, each character takes the tag of the window in whose middle it
lies, tags of all windows are joined into spans over the whole text, and spans that meet a base span or cannot be of their
kind are dropped.
"""
from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark.llm.common import written
from rankspark.llm.tagger import PAD, Tagger, classes, train

KINDS = ("email", "ip", "card", "phone")
#: Windows of so many characters begin every STEP characters.
WIDTH, STEP = 96, 64
#: Snippets that the tagger is trained on, at most.
SAMPLE = 1200
RUN_WINDOWS = 4096

# A digit run is matched from its start or not at all, which is what leftmost matching does, in linear time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"(?<![0-9])[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SOME = re.compile("[0-9@]")

Span = tuple[str, int, int, bool]


def luhn(digits: str) -> bool:
    total = sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits)))
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _part(digits: str) -> bool:
    """Whether a part of an address is at most 255, whatever its leading zeros; long runs of digits never become numbers."""
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", max(done, at + 1))


def base(text: str) -> list[Span]:
    """Base spans by kind, then start."""
    if not _SOME.search(text):
        return []
    out = [("email", a, b, True) for a, b in emails(text)]
    out += [("ip", m.start(), m.end(), True) for m in _IP.finditer(text)
            if all(_part(x) for x in m.group().split("."))]
    for m in _CARD.finditer(text):
        d = _digits(m.group())
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end(), True))
    if "+" in text:
        out += [("phone", m.start(), m.end(), True) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


_SPELT = re.compile(r"[A-Za-z0-9._%+-]+\s?(?:@|[(\[]at[)\]]|\sat\s)\s?[A-Za-z0-9-]+(?:\s?(?:\.|[(\[]dot[)\]]|\sdot\s)\s?[A-Za-z0-9-]+)+")
#: What every match of _SPELT holds: the at sign or word, a label, a dot or its word, and the begin of a label.
_CUE = re.compile(r"(?:@|[(\[]at[)\]]|\sat\s)\s?[A-Za-z0-9-]+?\s?(?:\.|[(\[]dot[)\]]|\sdot\s)\s?[A-Za-z0-9-]")
_NUMBERS = re.compile(r"[0-9]+(?:\s?\.\s?[0-9]+){3}")
_DIALLED = re.compile(r"[+(]?[0-9][\x20().0-9/-]+[0-9]")
_GROUPED = re.compile(r"[0-9]+(?:[\x20._/-]{1,2}[0-9]+)+")


def plausible(kind: str, text: str) -> bool:
    """Whether an added span can be of its kind at all. E-mail addresses need a cue of _CUE, the other kinds a digit."""
    if kind == "email":
        return bool(_SPELT.fullmatch(text))
    d = _digits(text)
    if kind == "ip":
        return bool(_NUMBERS.fullmatch(text)) and all(len(x) <= 3 and int(x) <= 255 for x in re.findall("[0-9]+", text))
    if kind == "card":
        return bool(_GROUPED.fullmatch(text)) and 13 <= len(d) <= 19 and luhn(d)
    return bool(_DIALLED.fullmatch(text)) and 9 <= len(d) <= 15 and any(not c.isdigit() for c in text)


def respelt(kind: str, text: str, turn: int) -> str:
    """A spelling of a span that the base patterns miss."""
    if kind == "email":
        at, dot = ((" (at) ", "."), (" [at] ", " [dot] "), (" at ", " dot "), (" (at) ", " (dot) "))[turn % 4]
        local, _, domain = text.partition("@")
        if turn // 4 % 2:  # every second cycle of spellings has no digit
            local, domain = (re.sub("[0-9]+", "", x).strip(".-") or x for x in (local, domain))
        return local + at + domain.replace(".", dot)
    if kind == "ip":
        return text.replace(".", " . " if turn % 2 else ". ")
    if kind == "card":
        d = _digits(text)
        return ("." if turn % 2 else "  ").join(d[i:i + 4] for i in range(0, len(d), 4))
    return text.lstrip("+0123456789").strip() or text


def examples(snippets: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Windows and tags from labelled snippets: as they are, and with their spans respelt."""
    windows, tags = [], []
    turns = dict.fromkeys(KINDS, 0)  # each kind goes through its own spellings
    for turn, text in enumerate(snippets):
        spans = sorted(base(text), key=lambda s: (s[1], -s[2]))
        for new in (False, True):
            parts, marks, at = [], [], 0
            for kind, a, b, _ in spans:
                if a < at:
                    continue
                word = respelt(kind, text[a:b], turns[kind]) if new else text[a:b]
                turns[kind] += new
                parts += [text[at:a], word]
                marks += [np.zeros(a - at, np.int64), np.full(len(word), KINDS.index(kind) + 1)]
                at = b
            parts.append(text[at:])
            marks.append(np.zeros(len(text) - at, np.int64))
            codes, mark = _codes("".join(parts)), np.concatenate(marks)
            shift = turn * 13 % max(1, min(90, len(codes) - 40))
            codes, mark = codes[shift:shift + WIDTH], mark[shift:shift + WIDTH]
            windows.append(np.pad(codes, (0, WIDTH - len(codes)), constant_values=PAD))
            tags.append(np.pad(mark, (0, WIDTH - len(mark))))
    return np.array(windows).reshape(-1, WIDTH), np.array(tags).reshape(-1, WIDTH)


def _codes(text: str) -> np.ndarray:
    return classes(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))


#: Every base or added span holds one of these.
_TRIGGER = re.compile(r"[0-9@+]|[(\[]at[)\]]|\sat\s")
_WORDED = re.compile(r"@|[(\[](?:at|dot)[)\]]|\sdot\s")


def _spelt(text: str) -> bool:
    """Whether a text without base spans may hold a span in another spelling, and is no safe example of none."""
    return bool(_WORDED.search(text)) or any(plausible(kind, m.group()) for kind, p in (("ip", _NUMBERS), ("card", _GROUPED), ("phone", _DIALLED))
                                             for m in p.finditer(text))


def snippets(text: str) -> Iterator[tuple[str, str]]:
    """(kind, snippet) around every base span, and around triggers away from all spans: "none", or "open" if it may hold
    a span in another spelling."""
    spans = sorted(base(text), key=lambda s: s[1:3])
    for kind, a, _, _ in spans:
        yield kind, text[max(0, a - 60):a + 120]
    after = i = 0
    for m in _TRIGGER.finditer(text):
        if m.start() < after:
            continue
        lo, hi = max(0, m.start() - 60), m.start() + 120
        while i < len(spans) and spans[i][2] <= lo:
            i += 1
        if i < len(spans) and spans[i][1] < hi:
            continue
        after = hi
        yield "open" if _spelt(text[lo:hi]) else "none", text[lo:hi]


def made_up(kind: str, turn: int) -> str:
    """An invented value that the base patterns know."""
    r = random.Random(turn)
    if kind == "email":
        w = ["".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(r.randrange(2, 4))) + r.choice(["", "n", "s"]) for _ in range(3)]
        return f"{w[0]}{r.choice(['', '.' + w[1], str(r.randrange(99))])}@{w[2]}.{r.choice(['com', 'org', 'net', 'example.com', 'co.uk'])}"
    if kind == "ip":
        return ".".join(str(r.randrange(256)) for _ in range(4))
    if kind == "card":
        d = "".join(str(r.randrange(10)) for _ in range(15))
        return next(d + k for k in "0123456789" if luhn(d + k))
    return f"+{r.randrange(1, 99)} ({r.randrange(100, 999)}) {r.randrange(100, 999)}-{r.randrange(1000, 9999)}"


def fit(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> Tagger | None:
    """A tagger trained on at most ``sample`` snippets: for each kind those of least hash around its base spans, wherever they
    are in any document, and as many without a span. A kind with few is filled up with invented values in such snippets. None
    only if no text holds anything that a span needs. The sample bounds what is learned from, not what is searched."""
    most = sample // (len(KINDS) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, dict[str, int]] = {}
        for batch in batches:
            for x in batch.column(0):
                for kind, s in snippets(x.as_py() or ""):
                    own = kept.setdefault(kind, {})
                    own[s] = int.from_bytes(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=7).digest(), "big")
                    if len(own) >= 4 * most:
                        kept[kind] = dict(sorted(own.items(), key=lambda v: (v[1], v[0]))[:most])
        rows = [(kind, h, s) for kind, own in kept.items() for s, h in sorted(own.items(), key=lambda v: (v[1], v[0]))[:most]]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string()))],
                                         names=["kind", "h", "s"])
    least = written(docs.select(F.col(f"`{text}`").cast("string")).mapInArrow(run, "kind string, h long, s string"), "snippets")
    got = {k: [r.s for r in least.where(F.col("kind") == k).distinct().orderBy("h", "s").limit(most).collect()] for k in (*KINDS, "none", "open")}
    if not any(got.values()):
        return None
    plain = got["none"] or ["the text of a page that holds no number and no address, and goes on like this for some more words"]
    chosen = got["none"][:]
    for kind in KINDS:
        chosen += got[kind]
        for turn in range(max(0, most // 2 - len(got[kind]))):
            w = plain[turn % len(plain)].split(" ")
            chosen.append(" ".join([*w[:len(w) // 3], made_up(kind, turn), *w[len(w) // 3:]]))
    return train(*examples(chosen), len(KINDS) + 1)


def added(model: Tagger, texts: list[str], found: list[list[Span]]) -> list[list[Span]]:
    """Spans that the tagger adds to the base spans of each text.

    Only windows with a digit or at sign, or within a window's width of a spelt-out address's cue, are decoded: runs of tags
    grow by that width at most, so in the others no span could be accepted, and they are tagged 0.
    """
    at: list[tuple[int, int]] = []
    codes = {}
    for i, text in enumerate(texts):
        hits = {k for m in _SOME.finditer(text) for p in (m.start(),)
                for k in (p // STEP, p // STEP - 1) if k >= 0 and p < k * STEP + WIDTH}
        for m in _CUE.finditer(text) if "at" in text or "@" in text else ():
            hits.update(range(max(0, (m.start() - WIDTH) // STEP), min(len(text) - 1, m.end() + WIDTH) // STEP + 1))
        if hits:
            codes[i] = _codes(text)
            at += [(i, k) for k in sorted(hits)]
    tagged: dict[int, list[tuple[int, np.ndarray]]] = {}
    for lo in range(0, len(at), RUN_WINDOWS):
        part = at[lo:lo + RUN_WINDOWS]
        windows = np.full((len(part), WIDTH), PAD)
        for row, (i, k) in enumerate(part):
            piece = codes[i][k * STEP:k * STEP + WIDTH]
            windows[row, :len(piece)] = piece
        for (i, k), path in zip(part, model.decode(windows), strict=True):
            tagged.setdefault(i, []).append((k, path))
    margin = (WIDTH - STEP) // 2
    out: list[list[Span]] = [[] for _ in texts]
    for i, paths in tagged.items():
        text = texts[i]
        tags = np.zeros(len(text), np.int8)
        for k, path in paths:  # each window owns its middle; the first also owns the text's start, the last its end
            lo = k * STEP + (margin if k else 0)
            hi = min(len(text), k * STEP + WIDTH - margin if k * STEP + WIDTH < len(text) else len(text))
            tags[lo:hi] = path[lo - k * STEP:hi - k * STEP]
        taken = sorted((a, b) for _, a, b, _ in found[i])
        for kind, a, b in _whole(text, tags):
            if kind == "email" and (m := _SPELT.search(text, a, b)):  # without tagged words around the address
                a, b = m.span()
            if not any(x < b and a < y for x, y in taken) and plausible(kind, text[a:b]):
                out[i].append((kind, a, b, False))
    return out


def _whole(text: str, tags: np.ndarray) -> list[tuple[str, int, int]]:
    """Runs of one tag, grown to white space (at most a window's width) and joined where they then meet, without punctuation around them."""
    change = np.flatnonzero(np.diff(tags, prepend=0, append=0)).tolist()
    grown: list[list[int]] = []
    for a, b in zip(change, change[1:], strict=False):
        tag = int(tags[a]) if a < len(tags) else 0
        if tag:
            least, most = max(0, a - WIDTH), min(len(text), b + WIDTH)
            while a > least and not text[a - 1].isspace():
                a -= 1
            while b < most and not text[b].isspace():
                b += 1
            if grown and grown[-1][0] == tag and a <= grown[-1][2]:
                grown[-1][2] = max(b, grown[-1][2])
            else:
                grown.append([tag, a, b])
    out = []
    for tag, a, b in grown:
        while a < b and not (text[a].isalnum() or text[a] in "+("):
            a += 1
        while a < b and not text[b - 1].isalnum():
            b -= 1
        if a < b:
            out.append((KINDS[tag - 1], a, b))
    return out


def find(model: Tagger | None, texts: list[str]) -> list[list[Span]]:
    """All spans of each text: kinds in order, then by start."""
    found = [base(x) for x in texts]
    extra = added(model, texts, found) if model else [[]] * len(texts)
    return [sorted(a + b, key=lambda s: (KINDS.index(s[0]), s[1])) for a, b in zip(found, extra, strict=True)]


SPANS = "array<struct<kind: string, start: long, end: long, base: boolean>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def _runs(column: pa.Array, most: int = 1 << 22) -> Iterator[list[str]]:
    """The column's texts (null: empty) in lists of about ``most`` characters."""
    part, size = [], 0
    for x in column:
        part.append(x.as_py() or "")
        size += len(part[-1])
        if size >= most:
            yield part
            part, size = [], 0
    yield part


def finder(spark: SparkSession, model: Tagger | None):
    """Column function: text -> SPANS (code points, end exclusive)."""
    sent = spark.sparkContext.broadcast(model)

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            spans = [s for part in _runs(column) for s in find(sent.value, part)]
            yield pa.array([[dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in x] for x in spans], _SPANS)
    return lambda text: F.arrow_udf(run, SPANS)(text.cast("string"))


def masker(spark: SparkSession, model: Tagger | None):
    """Column function: text -> text with every span replaced by its kind in brackets; null stays null. Overlapping spans
    are replaced as one, by the first one's kind."""
    sent = spark.sparkContext.broadcast(model)

    def masked(text: str, spans: list[Span]) -> str:
        parts, at = [], 0
        for kind, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
            if a >= at:
                parts += [text[at:a], f"[{kind.upper()}]"]
            at = max(at, b)
        return "".join([*parts, text[at:]])

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            out = [masked(x, s) for part in _runs(column) for x, s in zip(part, find(sent.value, part), strict=True)]
            yield pa.array(out, pa.string(), mask=np.array(column.is_null().to_pylist(), bool))
    return lambda text: F.arrow_udf(run, "string")(text.cast("string"))


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ``found`` (SPANS), one row per row of ``docs``.

    A null or empty text has no spans; texts are searched whole; repeated rows and null ids are searched like any other; an
    empty table gives no rows; other columns are not read.
    """
    find_in = finder(docs.sparkSession, fit(docs, text))
    return docs.select(F.col(f"`{key}`").alias("doc_id"), find_in(F.col(f"`{text}`")).alias("found"))


def digests(found: Column) -> list[Column]:
    """n_email ... n_phone and base_sha256 of the base spans, and ``spans`` of all."""
    def named(x: Column) -> Column:
        return F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    def count(kind: str) -> Column:
        return F.size(F.filter(found, lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    own = F.filter(found, lambda s: s["base"])
    counts = [count(k) for k in KINDS]
    return [*counts, F.sha2(named(own), 256).alias("base_sha256"), named(found).alias("spans")]
