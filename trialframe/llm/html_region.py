"""Main text of HTML pages as the maximum-scoring subsequence of their tokens.

A page is a sequence of tags and words. Words score positive, less so inside elements
that in labelled pages hold little main text, and slightly below zero in elements
that are left out; tags score negative.
One linear scan finds the contiguous run with the greatest sum, the content region;
elements of a kind that is not content are left out of it.

The weights come from pages labelled by their own markup: main text is what stands
in ``article``, ``main`` or an element with the role of one. For each kind of element (its
name, and its name with a class or id) words inside and outside of the main text are
counted on a bounded sample of pages: ``sample`` pages, least hash of the HTML first.
Well-known names enter as prior counts, so that kinds the sample lacks still weigh.

Scripts, styles, comments and the like hold no words. Character references are
decoded, white space within a block becomes one space, blocks are joined by a line
feed in page order. Nothing is dropped by length. NULL, empty and unlabelled pages,
and pages without words, are handled alike: the text is what the region holds, and
empty where there is none. Unclosed tags, elements and comments end with the page.
Rows pass through, repeated or not.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F, types as T

from .arrow import append_columns

SAMPLE = 2000
#: Kinds of elements kept from the sample, the most frequent ones.
MAX_KINDS = 20_000

# Names of HTML elements by their part in a page.
_RAW = ["script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "select", "title", "xmp", "noembed", "noframes"]
_VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
_INLINE = ["a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "input", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"]
_SPACE = ["br"]
_MAIN = ["article", "main"]
_SIDE = ["nav", "header", "footer", "aside", "form", "button", "menu", "dialog", "fieldset", "head"]
_SIDE_NAMES = [
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies",
    "disqus", "footer", "form", "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pagination",
    "popup", "promo", "promotion", "recommended", "related", "replies", "respond", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor",
    "sponsored", "subscribe", "toc", "toolbar", "topbar", "widget",
]
_SIDE_ROLES = ["navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar", "toolbar"]

_PRIOR = 40.0
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?>[^>\"']++|\"[^\"]{0,65536}+\"|'[^']{0,65536}+'|[\"'])*+)(?:>|\Z)|[^<]++|<",
    re.S,
)
_NAMED = re.compile(r"""\b(class|id|role|itemprop)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++))""", re.I)
_PART = re.compile(r"[A-Za-z]+")

#: A token of a page: ("tag", name, kinds, opening) or ("text", words as written).
Event = tuple


def _kinds(name: str, attributes: str) -> tuple[str, ...]:
    """What an element is counted as, and, first, whether it is main or side matter by markup."""
    marks, kinds = [], [name]
    if name in _MAIN:
        marks.append("+")
    elif name in _SIDE:
        marks.append("-")
    if attributes and "=" in attributes:
        for key, *values in _NAMED.findall(attributes):
            value = "".join(values).lower()
            if key.lower() == "role":
                marks += ["+"] * (value in ("main", "article")) + ["-"] * (value in _SIDE_ROLES)
            elif key.lower() == "itemprop":
                marks += ["+"] * (value == "articlebody")
            else:
                for token in value.split():
                    kinds.append(f"{name}.{re.sub(r'[0-9]+', '0', token)}")
                    if any(p in _SIDE_SET for p in _PART.findall(token)):
                        marks.append("-")
    return ("-" if "-" in marks else "+" if marks else "", *kinds)


_SIDE_SET = frozenset(_SIDE_NAMES)
_VOID_SET, _RAW_SET, _INLINE_SET = frozenset(_VOID), frozenset(_RAW), frozenset(_INLINE)


def events(page: str) -> Iterator[Event]:
    """Tags and texts in order; raw elements are skipped with all they hold."""
    at, n = 0, len(page)
    known: dict[tuple[str, str], tuple[str, ...]] = {}
    ends: dict[str, re.Pattern] = {}
    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        name = m[2]
        if name is None:
            text = m[0]
            if text[0] != "<" or text == "<":
                yield "text", text
            continue
        name = name.lower()
        if m[1]:
            yield "tag", name, (), False
            continue
        key = (name, m[3])
        if key not in known:
            if len(known) > 4096:
                known.clear()
            known[key] = _kinds(name, m[3])
        if name in _RAW_SET:
            if not m[3].endswith("/") or name in ("script", "style", "title", "textarea"):
                ends.setdefault(name, re.compile(rf"</{name}\b[^>]*>", re.I))
                close = ends[name].search(page, at)
                at = close.end() if close else n
            continue
        yield "tag", name, known[key], True


class _Open:
    """The open elements while a page is read."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.kinds: list[tuple[str, ...]] = []

    def tag(self, name: str, kinds: tuple[str, ...], opening: bool) -> None:
        if opening:
            if name == "p" and name in self.names[-3:]:
                self.close("p")
            if name not in _VOID_SET:
                self.names.append(name)
                self.kinds.append(kinds)
        elif name in self.names:
            self.close(name)

    def close(self, name: str) -> None:
        at = len(self.names) - 1 - self.names[::-1].index(name)
        del self.names[at:], self.kinds[at:]


def count_kinds(page: str) -> dict[str, list[int]]:
    """For each kind of element: words inside and outside of the labelled main text, and pages."""
    out: dict[str, list[int]] = {}
    seen = list(events(page))
    if not any(e[0] == "tag" and e[3] and e[2][0] == "+" for e in seen):
        return out
    now = _Open()
    for e in seen:
        if e[0] == "tag":
            now.tag(*e[1:])
            continue
        words = len(e[1].split())
        if not words:
            continue
        main = any(k[0] == "+" for k in now.kinds)
        for kind in {k for ks in now.kinds for k in ks[1:]}:
            out.setdefault(kind, [0, 0])[0 if main else 1] += words
    return out


class Weights:
    """Weights of words by the elements around them, and of tags."""

    def __init__(self, counts: dict[str, tuple[float, float]]) -> None:
        self.counts = counts
        self.known: dict[tuple[str, ...], tuple[float, bool]] = {}

    def kind(self, kinds: tuple[str, ...]) -> tuple[float, bool]:
        """(log odds of main text inside such an element, whether to leave such an element out)."""
        if kinds not in self.known:
            mark, name, *named = kinds
            odds, side = 1.0, False
            for kind in ([name] if mark else []) + named:
                inside, outside = self.counts.get(kind, (0, 0))
                prior = _PRIOR if mark == "-" else 0.0
                value = math.log((inside + 1.0) / (outside + prior + 1.0))
                if inside + outside + prior >= 20:
                    odds = min(odds, max(-4.0, value))
            if mark == "+":
                odds, side = 1.0, False
            else:
                side = odds < -1.0
            self.known[kinds] = odds, side
        return self.known[kinds]

    def tag(self, name: str) -> float:
        inside, outside = self.counts.get(name, (0, 0))
        return -0.1 if name in _INLINE_SET else max(-1.0, min(-0.15, math.log((inside + 10.0) / (outside + 10.0))))


def main_text(page: str | None, weights: Weights) -> str:
    """The blocks of the best region, joined by line feeds."""
    if not page:
        return ""
    now = _Open()
    odds: list[float] = []
    steps: list[tuple] = []  # (score, event number) is all the scan needs
    kept: list[tuple] = []
    for e in events(page):
        if e[0] == "tag":
            _, name, kinds, opening = e
            now.tag(name, kinds, opening)
            kept.append(("tag", name))
            steps.append(weights.tag(name))
            continue
        state = [weights.kind(k) for k in now.kinds]
        text = _html.unescape(e[1]) if "&" in e[1] else e[1]
        words = len(text.split())
        weight = min((o for o, _ in state), default=1.0)
        side = any(s for _, s in state)
        # what is left out anyway hardly parts the region that surrounds it
        steps.append(-min(1.0, 0.05 * words) if side else words * max(weight, 0.5))
        kept.append(("side" if side else "text", text))
    best, first, last, total, start = 0.0, 0, -1, 0.0, 0
    for i, value in enumerate(steps):
        if total <= 0:
            total, start = 0.0, i
        total += value
        if total > best:
            best, first, last = total, start, i
    blocks: list[str] = []
    piece: list[str] = []
    for what, value in kept[first : last + 1]:
        if what == "text":
            piece.append(value)
        elif what == "tag" and value not in _INLINE_SET:
            if value in _SPACE:
                piece.append(" ")
            else:
                blocks.append(" ".join("".join(piece).split()))
                piece = []
    blocks.append(" ".join("".join(piece).split()))
    return "\n".join(b for b in blocks if b)


def learn(pages: DataFrame, sample: int = SAMPLE) -> dict[str, tuple[float, float]]:
    """Word counts inside and outside of main text for each kind of element, from labelled pages."""
    labelled = pages.where(F.col("html").rlike(r"(?i)<(article|main)\b|role\s*=\s*.?(main|article)|articleBody"))
    chosen = labelled.select("html", F.xxhash64("html").alias("h")).orderBy("h").limit(sample).select("html")

    def run(batches):
        import pyarrow as pa

        total: dict[str, Counter] = {}
        for batch in batches:
            for page in batch.column(0).to_pylist():
                for kind, (inside, outside) in count_kinds(page).items():
                    total.setdefault(kind, Counter()).update({"in": inside, "out": outside})
        yield pa.RecordBatch.from_pydict({
            "kind": pa.array(list(total), pa.string()),
            "inside": pa.array([c["in"] for c in total.values()], pa.int64()),
            "outside": pa.array([c["out"] for c in total.values()], pa.int64()),
        })

    rows = (
        chosen.mapInArrow(run, "kind string, inside long, outside long").groupBy("kind")
        .agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
        .orderBy(F.desc(F.col("inside") + F.col("outside")), "kind").limit(MAX_KINDS).collect()
    )
    return {r.kind: (r.inside, r.outside) for r in rows}


def extract(pages: DataFrame, counts: dict[str, tuple[float, float]], out: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append the main text of each page's HTML."""

    def make():
        weights = Weights(counts)
        return lambda rows: [[main_text(page, weights) for page in rows]]

    return append_columns(pages, ["html"], [T.StructField(out, T.StringType())], make, keep)


def main_texts(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """page_id, url, text and its length in code points, of every row."""
    found = extract(pages, learn(pages, sample), keep=["page_id", "url"])
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
