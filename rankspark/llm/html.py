"""Main text of web pages: boosted trees over DOM nodes, decoded over the tree.

Every element gets a score from its subtree's size and density, its attribute tokens, its ancestors, depth and siblings. The
decoding maximises the sum of scores, less a cost for each undecided element, under one rule: below a kept element everything is kept, below a dropped one everything
is dropped, and only an undecided element may have both. The trees are trained on generated layouts with known parts.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark.llm.boosting import Boosted, boost

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>"""
    r"""|<([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+|[0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Content that is never text of a page.
RAW = frozenset("script style noscript template iframe svg textarea select option button title canvas audio video head".split())
_UNPARSED = frozenset("script style textarea title iframe".split())
#: Elements that a head may hold: any other closes an open head.
_IN_HEAD = frozenset("base basefont bgsound link meta title script style noscript noframes template object head html".split())
#: What an element with both kept and dropped parts costs.
MIXED = 1.0
BLOCKS = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer
form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody thead tfoot tr caption ul""".split())
#: An opening tag of the key closes an open element of the value.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

#: Attribute tokens by meaning, and tags by role (plain vocabulary).
TOKENS = {
    "advert": "ad ads advert adverts advertisement adslot adsense banner promo promotion promoted sponsor sponsored dfp",
    "notice": "cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe signup paywall toast warning disclaimer",
    "menu": "menu nav navbar navigation breadcrumb breadcrumbs toolbar topbar pagination pager skip tabs",
    "frame": "header masthead footer foot copyright legal colophon bottom",
    "side": "sidebar side aside widget rail related recommended recommendations trending popular more tags categories share social sharing follow author bio",
    "comment": "comment comments reply replies discussion disqus respond commentlist thread reviews",
    "form": "form login search searchbox contact poll survey",
    "content": "article content post entry story main body text maincontent articlebody prose page",
}
_TOKEN_BIT = {w: 1 << k for k, ws in enumerate(TOKENS.values()) for w in ws.split()}
TAGS = {"nav": "nav menu", "header": "header", "footer": "footer", "aside": "aside", "form": "form fieldset label input legend",
        "article": "article", "main": "main", "heading": "h1 h2 h3 h4 h5 h6", "paragraph": "p blockquote pre", "list": "ul ol dl",
        "item": "li dt dd", "box": "div section body html", "table": "table tbody thead tfoot tr td th", "link": "a", "dialog": "dialog"}
_TAG_BIT = {t: 1 << k for k, ts in enumerate(TAGS.values()) for t in ts.split()}


@dataclass
class Page:
    """Elements in document order, and the text runs between block boundaries."""
    parent: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    tag: list[int] = field(default_factory=list)
    token: list[int] = field(default_factory=list)
    #: (element, text, starts a block)
    runs: list[tuple[int, str, bool]] = field(default_factory=list)
    linked: list[bool] = field(default_factory=list)


@lru_cache(1 << 14)
def _tokens(attributes: str) -> int:
    bits = 0
    for m in _ATTRIBUTE.finditer(attributes):
        for w in _WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", m[1] or m[2] or m[3] or "").lower()):
            bits |= _TOKEN_BIT.get(w, 0)
    return bits


def parse(html: str) -> Page:
    page = Page([-1], [0], [0], [0])
    stack: list[tuple[str, int]] = [("", 0)]
    at, raw, links, fresh = 0, 0, 0, True
    last = html.rfind(">") + 1

    def text(piece: str) -> None:
        nonlocal fresh
        if stack[-1][0] == "head" and piece.strip():
            close(len(stack) - 1)
        if not raw and piece:
            if "&" in piece:
                piece = unescape(piece)
            page.runs.append((stack[-1][1], piece, fresh))
            page.linked.append(links > 0)
            fresh = False

    def close(depth: int) -> None:
        nonlocal raw, links, fresh
        while len(stack) > depth:
            name, i = stack.pop()
            page.end[i] = len(page.parent)
            raw -= name in RAW
            links -= name == "a"
            fresh = fresh or name in BLOCKS

    while True:
        m = _TOKEN.search(html, at, last) if at < last else None
        if m is None:
            text(html[at:])
            break
        text(html[at:m.start()])
        at = m.end()
        if m[1]:
            name = m[1].lower()
            depth = next((d for d in range(len(stack) - 1, 0, -1) if stack[d][0] == name), 0)
            if depth:
                close(depth)
            elif name == "p":
                fresh = True
            continue
        name = m[2] or m[4]
        if not name:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:-3])
            continue
        name = name.lower()
        if name not in _IN_HEAD and stack[-1][0] in ("head", "noscript"):
            head = next((d for d in range(len(stack) - 1, 0, -1) if stack[d][0] == "head"), 0)
            if head and (stack[-1][0] == "head" or name == "body"):
                close(head)
        if name in BLOCKS:
            fresh = True
            if any(x == "p" for x, _ in stack[-4:]) and name not in ("html", "body"):
                close(next(d for d in range(len(stack) - 1, 0, -1) if stack[d][0] == "p"))
        if name in _CLOSES:
            for d in range(len(stack) - 1, 0, -1):
                if stack[d][0] in _CLOSES[name]:
                    close(d)
                    break
                if stack[d][0] in ("ul", "ol", "dl", "table", "select"):
                    break
        if name == "br" or name in ("td", "th"):
            text(" ")
        if name in VOID:
            continue
        attributes = m[3] or m[5] or ""
        i = len(page.parent)
        page.parent.append(stack[-1][1])
        page.end.append(i + 1)
        page.tag.append(_TAG_BIT.get(name, 0))
        page.token.append(_tokens(attributes) if attributes else 0)
        if attributes.endswith("/") and name in ("svg", "path", "use"):
            continue
        stack.append((name, i))
        raw += name in RAW
        links += name == "a"
        if name in _UNPARSED:
            end = re.compile(rf"</{name}\b", re.I).search(html, at)
            at = end.start() if end else len(html)
    close(0)
    page.end[0] = len(page.parent)
    return page


def features(pages: list[Page]) -> np.ndarray:
    """One row per element of all pages in order (the first of each page is its root)."""
    sizes = np.array([len(p.parent) for p in pages])
    base = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    own = np.repeat(base, sizes)
    parent = np.concatenate([np.array(p.parent) for p in pages])
    root = parent < 0
    parent = np.where(root, 0, parent) + own
    end = np.concatenate([np.array(p.end) for p in pages]) + own
    tag, token = (np.concatenate([np.array(getattr(p, k), np.int64) for p in pages]) for k in ("tag", "token"))
    n = len(parent)
    run_of = np.array([base[k] + i for k, p in enumerate(pages) for i, _, _ in p.runs], np.int64)
    chars = np.array([len(s.strip()) for p in pages for _, s, _ in p.runs], np.float64)
    marks = np.array([s.count(",") + s.count(".") for p in pages for _, s, _ in p.runs], np.float64)
    linked = np.array([x for p in pages for x in p.linked], np.float64)
    at = np.arange(n)

    def below(values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(values)])
        return total[end] - total[at]
    own_text = np.bincount(run_of, chars, n)
    text, commas, link = below(own_text), below(np.bincount(run_of, marks, n)), below(np.bincount(run_of, chars * linked, n))
    elements = (end - at).astype(float)
    paragraphs = below(((tag & _TAG_BIT["p"]) > 0).astype(float))
    above_tag, above_token, depth = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
    # parents come first, so a few passes of pointer doubling settle ancestors of any depth
    jump, above_tag, above_token, depth = parent.copy(), np.where(root, 0, tag[parent]), np.where(root, 0, token[parent]), (~root).astype(float)
    while (jump != own).any():
        above_tag, above_token, depth = above_tag | above_tag[jump], above_token | above_token[jump], depth + depth[jump]
        jump = jump[jump]
    children = np.bincount(parent[~root], minlength=n).astype(float)
    whole = np.maximum(text[own], 1)
    before = np.concatenate([[0.0], np.cumsum(own_text)])[:-1]
    columns = [text, own_text, text / elements, link / np.maximum(text, 1), commas / np.maximum(text, 1), elements, paragraphs,
               text / whole, (before - before[own]) / whole, depth, children, children[parent],
               (text[parent] - own_text[parent]) / np.maximum(children[parent], 1), text / np.maximum(text[parent], 1)]
    for bits, width in ((tag, len(TAGS)), (above_tag, len(TAGS)), (token, len(TOKENS)), (above_token, len(TOKENS))):
        columns += [(bits >> k & 1).astype(float) for k in range(width)]
    return np.stack(columns, axis=1)


def labels(page: Page, score: np.ndarray) -> list[int]:
    """1 kept, -1 dropped, 0 undecided: the labelling of greatest total score (less MIXED for each undecided element) in which
    everything below a kept element is kept and everything below a dropped one dropped. The root is undecided."""
    n = len(score)
    keep, drop, best = score.tolist(), (-score).tolist(), [-MIXED] * n
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        keep[p] += keep[i]
        drop[p] += drop[i]
        best[p] += max(keep[i], drop[i], best[i])
    out = [0] * n
    for i in range(1, n):
        above = out[page.parent[i]]
        if above or keep[i] >= max(drop[i], best[i]):
            out[i] = above or 1
        elif drop[i] > best[i]:
            out[i] = -1
    return out


def decode(page: Page, score: np.ndarray) -> np.ndarray:
    """Whether each element's own text is kept; that of an undecided element is if its own score is positive."""
    return np.array([x > 0 or x == 0 and s > 0 for x, s in zip(labels(page, score), score, strict=True)])


def blocks(page: Page, kept: np.ndarray) -> str:
    out: list[list[str]] = []
    fresh = True
    for i, piece, starts in page.runs:
        fresh = fresh or starts
        if kept[i]:
            if fresh or not out:
                out.append([])
            out[-1].append(piece)
            fresh = False
    joined = (" ".join("".join(x).split()) for x in out)
    return "\n".join(x for x in joined if x)


def layouts(pages: int, seed: int = 11) -> Iterator[tuple[str, str, set[str]]]:
    """Generated pages with the text of their main part and its text runs: articles in varied containers among varied other parts."""
    r = np.random.default_rng(seed)
    vocabulary = ["".join(r.choice(list("etaoinshrdlu"), r.integers(1, 10))) for _ in range(800)]

    def words(lo: int, hi: int) -> str:
        return " ".join(r.choice(vocabulary, r.integers(lo, hi)))

    def sentence(lo: int = 3, hi: int = 60) -> str:
        return words(lo, hi).capitalize() + "."

    def pick(*options: str) -> str:
        return options[r.integers(len(options))]

    def token(kind: str) -> str:
        return f'{pick("class", "id")}="{pick("", "", "x ", "js-")}{pick(*TOKENS[kind].split())}{pick("", "", "-1", " box")}"'

    def wrap(tag: str, inner: str, attributes: str = "") -> str:
        return f"<{tag}{' ' + attributes if attributes else ''}>{inner}</{tag}>"

    def links(n: int) -> str:
        return wrap(pick("ul", "ol"), "".join(wrap("li", wrap("a", words(1, 4), 'href="/x"')) for _ in range(n)))

    def filling() -> str:
        return pick(sentence(), words(2, 30), "&copy; " + sentence(), wrap("p", sentence()), wrap("p", sentence()) + wrap("p", sentence()),
                    links(r.integers(1, 6)), wrap("a", sentence(2, 9), 'href="/x"'), wrap("h3", words(1, 4)) + pick(links(4), wrap("p", sentence())))

    def junk(kind: str) -> str:
        if kind == "menu":
            return wrap("nav", links(r.integers(2, 12)), pick("", token("menu"))) if r.random() < 0.6 else wrap("div", links(r.integers(2, 12)), token("menu"))
        if kind == "header":
            return wrap("header", wrap(pick("h1", "div", "p", "a"), words(1, 5)) + pick("", filling()), pick("", token("frame")))
        if kind == "footer":
            return wrap("footer", filling(), pick("", token("frame"))) if r.random() < 0.8 else wrap("div", filling(), 'class="footer"')
        if kind == "aside":
            return wrap("aside", filling())
        if kind == "comment":
            return wrap(pick("section", "div", "ol"), "".join(wrap(pick("div", "article", "li"), wrap("p", sentence()), pick("", token("comment"))) for _ in range(r.integers(1, 6))), token("comment"))
        if kind == "form":
            return wrap("form", wrap("label", words(1, 4)) + "<input name=q>" + wrap("button", words(1, 2)) + pick("", wrap("p", sentence(2, 12))), pick("", token("form")))
        return wrap(pick("div", "section", "aside", "div"), filling(), token(kind))

    kinds = ("menu", "header", "footer", "side", "aside", "comment", "form", "advert", "notice")
    for _ in range(pages):
        parts, texts, runs = [], [], set()
        brief = r.random() < 0.3
        for _ in range(r.integers(1, 3) if brief else r.integers(1, 14)):
            s = sentence(1, 9) if brief and r.random() < 0.7 else sentence(1, 90)
            tag = pick("p", "p", "p", "p", "h2", "blockquote", "li", "pre")
            inner = pick(s, s, s, wrap("b", s), words(1, 5) + " " + wrap("a", s, 'href="/y"')) if tag == "p" else s
            open_ended = tag == "p" and r.random() < 0.2
            parts.append(wrap(pick("ul", "ol"), wrap("li", inner)) if tag == "li" else f"<p><b>{s}<br>" if open_ended else wrap(tag, inner))
            runs.update(x.strip() for x in re.split("<[^>]*>", s if open_ended else inner))
            texts.append(s if open_ended else " ".join(re.sub("<[^>]*>", "", inner).split()))
            if r.random() < 0.08:
                parts.append(junk(pick("advert", "side", "form", "notice", "aside")))
        if r.random() < 0.8:
            title = words(2, 12)
            h = wrap("h1", title)
            parts.insert(0, wrap("header", h) if r.random() < 0.1 else h)
            texts.insert(0, title)
            runs.add(title)
        body = "".join(parts)
        main = pick(wrap("article", body, pick("", token("content"))), wrap("article", body), wrap("main", body), wrap("div", body, token("content")),
                    wrap("main", wrap("article", body)), wrap("section", body, token("content")), wrap("div", wrap("div", body, token("content")), pick("", token("content"))))
        lead = "".join(junk(pick(*kinds)) for _ in range(r.integers(0, 4)))
        tail = "".join(junk(pick(*kinds)) for _ in range(r.integers(0, 4)))
        page = pick(wrap("div", lead + main + tail, pick("", 'id="wrap"', 'class="page"')), lead + main + tail)
        yield f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title></head><body>{page}</body></html>", "\n".join(texts), runs


@lru_cache(1)
def fit(pages: int = 900) -> Boosted:
    """Trees trained on ``pages`` generated pages. An element is labelled by whether most of its text is in the main part."""
    made = list(layouts(pages))
    parsed = [parse(html) for html, _, _ in made]
    labels, weights = [], []
    for page, (_, _, runs) in zip(parsed, made, strict=True):
        n = len(page.parent)
        inside, total = np.zeros(n + 1), np.zeros(n + 1)
        for i, s, _ in page.runs:
            size = len(s.strip())
            total[i + 1] += size
            inside[i + 1] += size if s.strip() in runs else 0
        a, b = np.cumsum(inside), np.cumsum(total)
        end = np.array(page.end)
        share = (a[end] - a[:n]) / np.maximum(b[end] - b[:n], 1)
        labels.append(share > 0.5)
        # containers of both kinds teach nothing
        weights.append(((share > 0.97) | (share < 0.03)) & (b[end] > b[:n]))
    x, y, w = features(parsed), np.concatenate(labels).astype(float), np.concatenate(weights)
    return boost(x[w], y[w], trees=60)


def extract(model: Boosted, htmls: list[str]) -> list[str]:
    if not htmls:
        return []
    pages = [parse(x) for x in htmls]
    score = model.logits(features(pages))
    out, at = [], 0
    for page in pages:
        n = len(page.parent)
        out.append(blocks(page, decode(page, score[at:at + n])))
        at += n
    return out


def extractor(spark: SparkSession, model: Boosted):
    """Column function: html -> main text; a null or empty page has none."""
    sent = spark.sparkContext.broadcast(model)

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            out: list[str] = []
            part, size = [], 0
            for x in column:
                part.append(x.as_py() or "")
                size += len(part[-1])
                if size > 1 << 21:
                    out += extract(sent.value, part)
                    part, size = [], 0
            yield pa.array(out + extract(sent.value, part), pa.string())
    return lambda html: F.arrow_udf(run, "string")(html.cast("string"))


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: one row per row of ``pages``; nothing is shuffled.

    A null or empty page, or one without a main part, has an empty text. Pages are read whole; repeated rows and null ids are
    extracted like any other; an empty table gives no rows; other columns are not read.
    """
    text: Column = extractor(pages.sparkSession, fit())(F.col(f"`{html}`"))
    rows = pages.select(F.col(f"`{key}`").alias("page_id"), F.col(f"`{url}`").alias("url"), text.alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
