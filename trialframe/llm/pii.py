"""Personal data by patterns, and by contexts that known identifiers teach.

Base spans are e-mail addresses, IP addresses, card and phone numbers, by their
written form. Their contexts, the two words before or the words on either side, become
lexical patterns. Spark scores the graph of patterns and instances in rounds: a
pattern by the mean score of its distinct instances, base spans by one, another
instance by the best other pattern that it stands in. A pattern that is confident enough, for one
kind, on enough distinct known instances and documents, discovers other candidates
in its place, as spans of its kind. Candidates are, in this order and without overlap, addresses
(names joined by dots and the like, or by a sign or the word for it, with or without a
digit; e-mail only), tokens of letters and digits (any kind), and numbers (digit groups
joined by blanks, dots, hyphens or brackets; any kind but e-mail). They may have any length.

Places count code points, the end not included. Base spans always stay, and a
discovered one never overlaps a base span. NULL and empty texts have no spans. Rows
that agree in id and text are one document; each gets its spans.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql import DataFrame, functions as F, types as T

from ..sources.scratch import stored
from .arrow import append_columns

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 4
#: What a pattern needs to discover: mean score, known distinct instances, documents.
CONFIDENCE = 0.9
SUPPORT = 5
DOCUMENTS = 3

# Written forms. Possessive runs keep them linear in the text.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"[^\s\"'=:,;<>()\[\]{}]*[0-9][^\s\"'=:,;<>()\[\]{}]*")
_LETTER = re.compile(r"[^\W\d_]")
_NUMBER = re.compile(r"(?<![^\W_])(?:\+ ?)?\(?[0-9]++(?![^\W\d_])(?:[ ().-]{1,3}[0-9]++(?![^\W\d_]))*+")
_AT = r"@|[ ]?[(\[{<][ ]?(?:at|AT)[ ]?[)\]}>][ ]?"
_DOT = r"\.|[ ]?[(\[{<][ ]?(?:dot|DOT)[ ]?[)\]}>][ ]?|[ ](?:dot|DOT)[ ]"
_NAME = r"[A-Za-z0-9][A-Za-z0-9._%+-]*+"
_ADDRESS = re.compile(
    rf"(?<![A-Za-z0-9._%+@-])(?:{_NAME}(?:(?:{_AT})[A-Za-z0-9-]++(?:(?:{_DOT})[A-Za-z0-9-]++)*+"
    rf"|[ ](?:at|AT)[ ][A-Za-z0-9-]++(?:(?:{_DOT})[A-Za-z0-9-]++)++)"
    r"|[A-Za-z][A-Za-z0-9]*+(?:[._%+-]++[A-Za-z0-9]++)++)"
)
_WORDS = re.compile(r"\S+")
_DIGITS = frozenset("0123456789")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    out, at, done = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            done = m.end()
        else:
            # no address starts before this sign; the next one's local part starts after it
            done = at + 1
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str | None) -> list[Span]:
    """Leftmost spans without overlap for each kind, checked, in the order of kinds and places."""
    if not text:
        return []
    out = _emails(text)
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c in _DIGITS for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def _word(text: str, start: int, end: int) -> str:
    """A word as patterns hold it: its last characters, with every number as 0."""
    return re.sub(r"[0-9]+", "0", text[max(start, end - 200) : end].lower())[-40:]


class _Words:
    """The words of a text, to find those around a span whatever their length."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.spans = [m.span() for m in _WORDS.finditer(text)]
        self.starts = [a for a, _ in self.spans]

    def contexts(self, start: int, end: int) -> list[str]:
        """Patterns around a span: the two words before, and the words on either side."""
        n = bisect_left(self.starts, start)
        left = [_word(self.text, a, min(b, start)) for a, b in self.spans[max(0, n - 2) : n]]
        n = max(0, bisect_right(self.starts, end) - 1)
        after = [_word(self.text, max(a, end), b) for a, b in self.spans[n : n + 2] if b > end][:1]
        out = []
        if len(left) == 2:
            out.append(f"2 {left[0]} {left[1]}")
        if left and after:
            out.append(f"1 {left[-1]} * {after[0]}")
        return out


def _offered(text: str, spans: list[Span]) -> Iterator[tuple[str, int, int]]:
    """(form, start, end) of what may be discovered, clear of the base spans and of each other."""
    found = [("address", *m.span()) for m in _ADDRESS.finditer(text) if _LETTER.search(m[0])]
    if _DIGIT.search(text):
        for m in _TOKEN.finditer(text):
            start, end = m.span()
            while end > start and text[end - 1] in ".!?*#%&$|":
                end -= 1
            if _LETTER.search(text, start, end):
                found.append(("token", start, end))
        found += [("number", *m.span()) for m in _NUMBER.finditer(text)]
    taken = sorted((s, e) for _, s, e in spans)
    for form in ("address", "token", "number"):
        at, free = 0, []
        reach = list(accumulate((e for _, e in taken), max))
        starts = [s for s, _ in taken]
        for what, start, end in found:
            if what == form:
                at = bisect_left(starts, end)
                if not at or reach[at - 1] <= start:
                    free.append((start, end))
                    yield form, start, end
        taken = sorted(taken + free)


def candidates(text: str | None, spans: list[Span]) -> list[tuple[str, str | None, str | None, int, int, str]]:
    """(pattern, kind or None, form or None, start, end, instance) of base spans and of what may be discovered."""
    if not text:
        return []
    offered = [(None, form, start, end) for form, start, end in _offered(text, spans)]
    every = [(kind, None, start, end) for kind, start, end in spans] + offered
    if not every:
        return []
    words = _Words(text)
    return [
        (p, kind, form, start, end, text[start:end])
        for kind, form, start, end in every for p in words.contexts(start, end)
    ]


_SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_CANDIDATE = T.StructType([
    T.StructField("pattern", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("form", T.StringType()),
    T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("instance", T.StringType()),
])


def with_base_spans(documents: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Append base (array of kind, start, end) and candidates."""

    def make():
        def work(texts):
            spans = [base_spans(t) for t in texts]
            return [spans, [candidates(t, s) for t, s in zip(texts, spans)]]

        return work

    new = [T.StructField("base", T.ArrayType(_SPAN)), T.StructField("candidates", T.ArrayType(_CANDIDATE))]
    return append_columns(documents, ["text"], new, make, keep)


def confident_patterns(
    found: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT, documents: int = DOCUMENTS
) -> DataFrame:
    """(pattern, kind) from rows (doc, pattern, kind or NULL, instance), by rounds over their graph."""
    # an edge for each pattern and distinct instance; its kind is that of the base span
    edges = found.groupBy("pattern", "instance").agg(F.max("kind").alias("kind"), F.count_distinct("doc").alias("docs"))
    widths = edges.groupBy("pattern").agg(
        F.count("*").alias("width"), F.count("kind").alias("known"), F.sum("docs").alias("docs"),
        F.mode("kind", True).alias("own"),
    )
    # patterns without enough known instances can never discover nor raise an instance enough
    able = widths.where((F.col("known") >= support) & (F.col("docs") >= documents)).select("pattern", "width", "own")
    graph = stored(edges.join(able, "pattern").select("pattern", "instance", "kind", "width", "own"), "graph")
    known = F.when(F.col("kind").isNotNull(), (F.col("kind") == F.col("own")).cast("double"))
    scores = graph.groupBy("pattern", "own").agg(F.avg(F.coalesce(known, F.lit(0.0))).alias("score"))
    for _ in range(rounds):
        scores = stored(scores, "patterns")
        # an unknown instance counts by the best other pattern of the kind that it stands in
        held = graph.where("kind is null").join(scores.select("pattern", "score"), "pattern").select("instance", "own", "pattern", "score")
        top = held.groupBy("instance", "own").agg(F.max(F.struct("score", "pattern")).alias("top"))
        both = held.join(top, ["instance", "own"])
        second = both.where("pattern != top.pattern").groupBy("instance", "own").agg(F.max("score").alias("second"))
        unknown = both.join(second, ["instance", "own"], "left").select(
            "pattern", "own", F.when(F.col("pattern") != F.col("top.pattern"), F.col("top.score")).otherwise(F.coalesce("second", F.lit(0.0))).alias("s")
        )
        certain = graph.where("kind is not null").select("pattern", "own", known.alias("s"))
        scores = certain.unionByName(unknown).groupBy("pattern", "own").agg(F.avg("s").alias("score"))
    return stored(scores.where(F.col("score") >= confidence).select("pattern", F.col("own").alias("kind")), "confident")


def all_spans(documents: DataFrame, **options) -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end; spans holds base and discovered ones) of every row."""
    hashed = documents.withColumn("__h", F.xxhash64("text"))
    read = stored(with_base_spans(hashed, keep=["doc_id", "__h"]), "spans")
    found = read.select(
        F.struct("doc_id", "__h").alias("doc"), F.explode("candidates").alias("c")
    ).select("doc", "c.*")
    patterns = confident_patterns(found.select("doc", "pattern", "kind", "instance"), **options)
    new = (
        found.where("kind is null").drop("kind").join(patterns, "pattern")
        .where("form = 'token' or (form = 'address') = (kind = 'email')")
        .groupBy(F.col("doc.doc_id").alias("__id"), F.col("doc.__h").alias("__kh"), "start", "end").agg(F.min("kind").alias("kind"))
        .groupBy("__id", "__kh").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more"))
    )
    same = read["doc_id"].eqNullSafe(new["__id"]) & (read["__h"] == new["__kh"])
    order = F.array_sort(
        F.concat("base", F.coalesce("more", F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>"))),
        lambda a, b: F.when(_order(a) < _order(b), -1).when(_order(a) > _order(b), 1)
        .when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0),
    )
    return read.join(new, same, "left").select("doc_id", "base", order.alias("spans"))


def _order(span):
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), span["kind"])


def _written(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _is_kind(kind: str):
    return lambda span: span["kind"] == kind


def report(documents: DataFrame, **options) -> DataFrame:
    """Per row: base counts by kind, the digest of the base spans, and all spans as text."""
    found = all_spans(documents, **options)
    counts = [F.size(F.filter("base", _is_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans")
    )
