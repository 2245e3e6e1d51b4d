"""Quality rules learned as a decision list over statistics of texts.

Sequential covering: a rule is a conjunction of thresholds on statistics. It grows on two
thirds of the labelled texts, condition by condition by information gain, and is pruned on
the other third. It is for the rarer verdict; the texts it covers leave, and the next rule
is sought among the rest, until one is not precise enough. What no rule covers gets the more
frequent verdict. Rules at the end that do not lower the error go again. The list is emitted as
one Spark conditional expression, and each threshold is the shortest number that cuts alike.

Statistics come from whole texts; words are runs without ASCII white space, lines end at \\n.
Before the list a base rule rejects: fewer than 50 words, or more than half of the words in
three-word windows that occur twice or more.

It is learned from at most ``rows`` distinct labelled texts, by least hash, each once however many
copies it has; a text with differing labels counts as the worse one (0). Without labels
the list is empty and every text that passes the base rule stays. NULL and empty texts
have no words and fail the base rule. Rows that repeat are judged alike, each on its own.
A NULL ``doc_id`` takes no part in the learning.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..sources.scratch import stored
from .arrow import append_columns

#: Distinct labelled texts to learn from, at most.
ROWS = 12_000
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_CONDITIONS = 4
#: Lower estimate of the precision that a rule must have.
PRECISION = 0.9
HELD_OUT = "crc32(cast(doc_id as string)) % 5 = 0"

BASE_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
COUNTS = [*BASE_COUNTS, "n_chars", "n_lines", "n_distinct", "n_upper", "n_letters", "n_digits", "n_marks", "n_closed", "n_short"]
_INNER = [f"__{c}" for c in COUNTS]
_SYMBOLS = b"#*$%&|<>"
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b not in _SYMBOLS)


#: Statistics that rules are made of: one count over another, or a count alone.
STATISTICS: dict[str, tuple[str, str | None]] = {
    "words": ("n_words", None),
    "chars_per_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "repeated_line_share": ("n_dup_lines", "n_lines"),
    "repeated_word_share": ("n_repeat_words", "n_words"),
    "distinct_word_share": ("n_distinct", "n_words"),
    "upper_share": ("n_upper", "n_letters"),
    "letter_share": ("n_letters", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "marks_per_word": ("n_marks", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
    "closed_line_share": ("n_closed", "n_lines"),
    "short_word_share": ("n_short", "n_words"),
}


def statistic(name: str) -> Column:
    """The statistic over the counts of a text; 0 where there is nothing to divide by."""
    part, whole = STATISTICS[name]
    if whole is None:
        return F.col(f"__{part}").cast("double")
    return F.coalesce(F.col(f"__{part}") / F.nullif(F.col(f"__{whole}"), F.lit(0)), F.lit(0.0))


def counts(text: str | None) -> list[int]:
    """The counts of one text, in the order of ``COUNTS``."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    chars = int(byte.sum() - byte[0x80:0xC0].sum())  # bytes that do not go on with a character
    blank = int(byte[9:14].sum() + byte[32])
    wide = int(byte[0xC0:].sum())
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    lines, seen, repeated, closed = 0, set(), 0, 0
    for line in raw.split(b"\n"):
        bare = line.strip()
        if bare:
            lines += 1
            closed += bare.endswith((b".", b"!", b"?"))
            repeated += line in seen
            seen.add(line)
    upper = int(byte[65:91].sum())
    return [
        n, chars - blank, int(byte[list(_SYMBOLS)].sum()), repeated, _in_repeats(ids, len(number)), chars, lines,
        len(number), upper, upper + int(byte[97:123].sum()) + wide, int(byte[48:58].sum()), int(byte[list(_MARKS)].sum()),
        closed, sum(len(w) <= 2 for w in words),
    ]


def _in_repeats(ids: np.ndarray, distinct: int, size: int = 3) -> int:
    """Words that lie in a window of ``size`` words which occurs twice or more."""
    n = len(ids) - size + 1
    if n < 2:
        return 0
    window = ids[:n]
    for k in range(1, size):
        # numbered anew after each word, so the product stays small
        window = np.unique(window * distinct + ids[k : k + n], return_inverse=True)[1]
    often = np.bincount(window)[window] > 1
    inside = np.zeros(len(ids), bool)
    for k in range(size):
        inside[k : k + n] |= often
    return int(inside.sum())


def with_counts(documents: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The kept columns and the counts, each named with two leading underscores."""

    def make():
        return lambda texts: list(zip(*map(counts, texts))) or [[] for _ in COUNTS]

    return append_columns(documents, ["text"], [T.StructField(c, T.LongType()) for c in _INNER], make, keep)


# ---------------------------------------------------------------- the list


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool  # statistic > threshold, else <= threshold
    threshold: float

    def column(self) -> Column:
        value = statistic(self.name)
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)

    def holds(self, x: np.ndarray) -> np.ndarray:
        value = x[:, list(STATISTICS).index(self.name)]
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.threshold!r}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    keep: bool

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for c in self.conditions:
            out &= c.holds(x)
        return out

    def __str__(self) -> str:
        return f"{'keep' if self.keep else 'reject'} if {' and '.join(map(str, self.conditions))}"


@dataclass(frozen=True)
class DecisionList:
    rules: tuple[Rule, ...]
    default: bool

    def _choose(self, values: Sequence[Column], otherwise: Column) -> Column:
        out = None
        for rule, value in zip(self.rules, values):
            held = rule.conditions[0].column()
            for c in rule.conditions[1:]:
                held = held & c.column()
            out = F.when(held, value) if out is None else out.when(held, value)
        return otherwise if out is None else out.otherwise(otherwise)

    def expression(self) -> Column:
        """The verdict, true to keep: the first rule that holds decides."""
        return self._choose([F.lit(r.keep) for r in self.rules], F.lit(self.default))

    def rule_number(self) -> Column:
        """The place of the rule that decides, from 1; 0 for the default."""
        return self._choose([F.lit(i) for i in range(1, len(self.rules) + 1)], F.lit(0))

    def verdicts(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.default)
        for rule in reversed(self.rules):
            out[rule.holds(x)] = rule.keep
        return out

    def __str__(self) -> str:
        return "\n".join([*map(str, self.rules), f"else {'keep' if self.default else 'reject'}"])


def shortest_between(low: float, high: float) -> float:
    """The number of fewest decimals that is at least ``low`` and under ``high``."""
    middle = low + (high - low) / 2
    for digits in range(16):
        t = round(middle, digits)
        if low <= t < high:
            return t
    return low


def _best_condition(x: np.ndarray, hit: np.ndarray) -> Condition | None:
    """The threshold with the largest gain of information about the hits."""
    p0, n0 = hit.sum(), (~hit).sum()
    before = np.log2(p0 / (p0 + n0))
    best, found = 1e-9, None
    for j, name in enumerate(STATISTICS):
        order = np.argsort(x[:, j], kind="stable")
        value, ordered = x[order, j], hit[order]
        cut = np.flatnonzero(value[1:] > value[:-1])
        if not len(cut):
            continue
        p, n = np.cumsum(ordered)[cut].astype(float), np.cumsum(~ordered)[cut].astype(float)
        for above, (a, b) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
            gain = a * (np.log2(np.maximum(a, 1e-12) / (a + b)) - before)
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, found = gain[k], Condition(name, above, shortest_between(float(value[cut[k]]), float(value[cut[k] + 1])))
    return found


def _grown(x: np.ndarray, hit: np.ndarray) -> tuple[Condition, ...]:
    conditions: list[Condition] = []
    while len(conditions) < MAX_CONDITIONS and hit.any() and not hit.all():
        more = _best_condition(x, hit)
        if more is None:
            break
        conditions.append(more)
        inside = more.holds(x)
        x, hit = x[inside], hit[inside]
    return tuple(conditions)


def _pruned(conditions: tuple[Condition, ...], x: np.ndarray, hit: np.ndarray) -> tuple[Condition, ...]:
    """The leading conditions that hold best on texts not grown on."""
    inside, best, kept = np.ones(len(x), bool), -2.0, conditions
    for k, c in enumerate(conditions, 1):
        inside = inside & c.holds(x)
        p, n = (inside & hit).sum(), (inside & ~hit).sum()
        value = (p - n) / (p + n) if p + n else -1.0
        if value > best:
            best, kept = value, conditions[:k]
    return kept


def learn(x: np.ndarray, good: np.ndarray, precision: float = PRECISION) -> DecisionList:
    """The list for rows of statistics and whether each is of good quality; row order splits them."""
    if not len(good):
        return DecisionList((), True)
    default = bool(2 * good.sum() >= len(good))
    hit = good != default
    third = np.arange(len(good)) % 3 == 2
    left = np.ones(len(good), bool)
    rules: list[Rule] = []
    while (hit & left & ~third).any() and (~hit & left & ~third).any():
        grow, prune = left & ~third, left & third
        conditions = _pruned(_grown(x[grow], hit[grow]), x[prune], hit[prune])
        rule = Rule(conditions, not default)
        covered = rule.holds(x) & left
        if not conditions or ((covered & hit).sum() + 1) / (covered.sum() + 2) < precision:
            break
        rules.append(rule)
        left &= ~covered
    found = DecisionList(tuple(rules), default)
    while found.rules:
        shorter = DecisionList(found.rules[:-1], found.default)
        if (shorter.verdicts(x) != good).sum() > (found.verdicts(x) != good).sum():
            break
        found = shorter
    return found


def fit_on(
    documents: DataFrame, labels: DataFrame, training: str = f"NOT ({HELD_OUT})", rows: int = ROWS, label: str = "quality",
) -> DecisionList:
    """Learn from the labelled documents that satisfy the SQL condition ``training`` on doc_id."""
    marks = labels.select(F.col("doc_id").alias("__id"), F.col(f"`{label}`").cast("int").alias("__y"))
    marks = marks.where("__id IS NOT NULL AND __y IN (0, 1)").groupBy("__id").agg(F.min("__y").alias("__y"))
    known = documents.where(training).select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("__h"))
    texts = stored(
        known.join(marks, F.col("doc_id") == F.col("__id")).groupBy("__h").agg(F.min("__y").alias("__y"), F.min("doc_id").alias("__id")),
        "labelled",
    )
    # a threshold on the hash leaves little more than is wanted, so no task hands on more than its share
    spread = F.pmod(F.xxhash64("__h"), F.lit(1 << 30))
    share = min(1.0, 1.1 * rows / max(texts.count(), 1))
    few = stored(texts.where(spread < int(share * (1 << 30)) + 1).orderBy(spread, "__h").limit(rows), "chosen")
    mine = documents.join(
        few, (documents["doc_id"] == few["__id"]) & (F.xxhash64(F.coalesce(documents["text"], F.lit(""))) == few["__h"]))
    # repeated rows of one id and text are one text here
    marked = with_counts(mine, ["__h", "__y"]).select("__h", "__y", *[statistic(n).alias(n) for n in STATISTICS]).dropDuplicates(["__h"])
    learned = marked.orderBy(F.xxhash64("__h"), "__h").collect()  # at most ``rows`` rows of numbers
    x = np.array([[r[n] for n in STATISTICS] for r in learned], float).reshape(-1, len(STATISTICS))
    return learn(x, np.array([r["__y"] == 1 for r in learned], bool))


def judged(documents: DataFrame, found: DecisionList, keep: Sequence[str]) -> DataFrame:
    """The kept columns, the base counts, base_failed, kept, and rule: the number of the rule that decides.

    ``rule`` is 0 for the default and NULL where the base rule rejects. Kept columns whose
    names clash with a result give way to it.
    """
    results = {*BASE_COUNTS, "base_failed", "kept", "rule"}
    own = [c for c in keep if c.lower() not in results]
    failed = (F.col("__n_words") < MIN_WORDS) | (100 * F.col("__n_repeat_words") > MAX_REPEAT_PERCENT * F.col("__n_words"))
    return with_counts(documents, own).select(
        *[F.col(f"`{c}`") for c in own], *[F.col(f"__{c}").alias(c) for c in BASE_COUNTS], failed.alias("base_failed"),
        (~failed & found.expression()).alias("kept"), F.when(~failed, found.rule_number()).alias("rule"),
    )


def quality(documents: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """Every document by rules learned from the labels outside the held-out fold, which is marked."""
    found = fit_on(documents, labels, rows=rows)
    fold = F.coalesce(F.expr(HELD_OUT), F.lit(False)).alias("held_out")
    return judged(documents, found, ["doc_id"]).select("*", fold)
