"""Toxicity by a support vector machine over a subsequence string kernel.

Two words are compared by the gap-weighted kernel over subsequences of three
characters: each common subsequence counts ``DECAY`` to the power of the characters
it spans in either word, so inserted or dropped characters weaken a match instead of
breaking it. Words become vectors by the Nyström method, as their kernels with a set
of landmark words. Training data are sentences of labelled documents: a sentence of
a clean document is clean, one of a toxic document that holds a witness word is
toxic, the rest is unknown. A sentence is represented by its most telling word (a
witness, chosen anew in each round), and a linear machine separates the sentences.

Since the kernel is a scalar product of subsequence vectors, the machine over
landmarks equals one weight for each subsequence of a witness; that table is what tasks use. A
text's score is the calibrated margin of its most insulting word. Spaced-out
letters are joined, and words with digits or signs inside are also tried with these
read as letters or left out.

The machine is fitted on the driver on a bounded sample: at most ``per_class`` texts
of each label, least hash of the text first, and of a text at most ``MAX_WORDS``
distinct words in hash order. Scoring covers whole texts of all rows.

Words longer than ``SPAN`` characters are scored by overlapping parts. NULL and
empty texts, and all texts if a label is missing from the training rows, score the
prior. Labels other than 0 and 1 and NULLs are ignored; a document with several
labels counts as toxic if one says so. Rows pass through, repeated or not.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from .arrow import append_columns

DECAY = 0.7
SPAN = 12
PER_CLASS = 1500
MAX_WORDS = 4000
#: Landmarks besides the witnesses, and witnesses that are landmarks, those with most evidence.
LANDMARKS = 400
WITNESSES = 1000
#: Stray letters tried at each inner place of a witness, and the weight of altered witnesses, in labels.
STRAYS = 4
ALTERED = 0.3
#: Strength of the ridge of the machine over words.
RIDGE = 1e-6
#: Subsequence numbers up to which tables are dense.
_DENSE = 1 << 21
#: Distinct clean words that train the machine, besides those nearest to witnesses.
CLEAN_WORDS = 6000
#: Toxic texts let pass that weigh as much as one clean text rejected, by shares of either.
CLEAN_COST = 3.0
_CACHE_WORDS = 100_000
#: Subsequences of words that are looked up at once.
_CELLS = 250_000
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")
_SPACED = re.compile(r"(?<!\S)(?:\w[^\w\s]{0,2}\s+){2,}\w(?!\S)")
#: Digits and signs commonly written for letters.
_LOOKALIKES = str.maketrans("013457@$!", "oieastasi")


def forms(token: str) -> list[str]:
    """What a token may stand for: itself, without inner signs, and with look-alikes read as letters."""
    word = _EDGE.sub("", token)
    if not word or word.isalpha():
        return [word] if len(word) > 1 else []
    letters = _INNER.sub("", word)
    alike = _INNER.sub("", token.translate(_LOOKALIKES))
    return [x for x in dict.fromkeys((letters, alike)) if len(x) > 1]


def tokens(text: str) -> set[str]:
    """Distinct raw tokens of a lower-cased text; runs of spaced-out letters come joined as well."""
    lowered = unicodedata.normalize("NFC", text).lower() if not text.isascii() else text.lower()
    found = set(lowered.split())
    if " " in lowered:
        for run in _SPACED.findall(lowered):
            found.add(re.sub(r"[\W_]+", "", run))
    return found


def pieces_of(word: str) -> list[str]:
    if len(word) <= SPAN:
        return [word]
    step = SPAN // 2
    return [word[i : i + SPAN] for i in range(0, len(word) - step, step)]


class Subsequences:
    """Weighted subsequences of three over an alphabet; other characters never match."""

    def __init__(self, alphabet: str) -> None:
        self.alphabet = alphabet
        self.number = {c: i + 1 for i, c in enumerate(alphabet)}
        self.size = len(alphabet) + 1
        kind = np.int32 if self.size**3 < 1 << 31 else np.int64
        self.lookup = np.zeros(0x110000 if any(ord(c) > 0xFFFF for c in alphabet) else 0x10000, kind)
        for c, i in self.number.items():
            self.lookup[ord(c)] = i
        self.plans: dict[int, tuple] = {}

    def plan(self, n: int):
        if n not in self.plans:
            at = np.array(list(combinations(range(n), 3)), np.int64).reshape(-1, 3)
            self.plans[n] = at, (DECAY ** (at[:, 2] - at[:, 0] + 1)).astype(np.float32)
        return self.plans[n]

    def letters(self, words: list[str]) -> np.ndarray:
        """Letter numbers of words of one length."""
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1)
        return self.lookup[np.where(codes < len(self.lookup), codes, 0)]

    def codes(self, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, weight = self.plan(letters.shape[1])
        first, second, third = letters[:, at[:, 0]], letters[:, at[:, 1]], letters[:, at[:, 2]]
        code = (first * self.size + second) * self.size + third
        return np.where((first > 0) & (second > 0) & (third > 0), code, 0), weight

    def norms(self, words: list[str]) -> np.ndarray:
        """Square roots of the kernels of words of one length with themselves."""
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1)
        n = codes.shape[1]
        same = codes[:, :, None] == codes[:, None, :]
        # level[i, j]: weight of common subsequences that end at i and j, spans counted from their start
        level = same * DECAY**2
        for _ in range(2):
            reach = np.zeros_like(level)
            for i in range(1, n):
                row = np.zeros(len(words))
                for j in range(1, n):
                    row = DECAY * row + level[:, i - 1, j - 1] * DECAY
                    reach[:, i, j] = DECAY * reach[:, i - 1, j] + DECAY * row
            level = same * reach
        return np.sqrt(level.sum(axis=(1, 2)))


class Places:
    """Row numbers of the subsequences that occur; of any other, the number of rows."""

    def __init__(self, kept: np.ndarray, size: int) -> None:
        self.kept, self.dense = kept, None
        if size**3 <= _DENSE or not len(kept):
            self.dense = np.full(size**3 if len(kept) else 1, len(kept), np.int64)
            self.dense[kept] = np.arange(len(kept))

    def __getitem__(self, code: np.ndarray) -> np.ndarray:
        if self.dense is not None:
            return self.dense[code if len(self.kept) else np.zeros_like(code)]
        at = np.minimum(np.searchsorted(self.kept, code), len(self.kept) - 1)
        return np.where(self.kept[at] == code, at, len(self.kept))


class Scorer:
    """Margins of words from one weight per subsequence; keeps the words seen last."""

    def __init__(self, alphabet: str, kept: np.ndarray, weights: np.ndarray, bias: float) -> None:
        self.space, self.weights, self.bias = Subsequences(alphabet), weights, bias
        self.place = Places(kept, self.space.size)
        self.table = weights[self.place.dense] if self.place.dense is not None and len(kept) else None
        self.cache: dict[str, float] = {}

    def learn(self, raw: set[str]) -> None:
        parts: dict[str, float] = {}
        used = {t: [p for w in forms(t) for p in pieces_of(w)] for t in raw}
        by_length = defaultdict(list)
        for p in {p for ps in used.values() for p in ps}:
            by_length[len(p)].append(p)
        for n, words in by_length.items():
            size = max(1, _CELLS // max(1, n * (n - 1) * (n - 2) // 6))
            for at in range(0, len(words), size):
                block = words[at : at + size]
                if n < 3:
                    parts.update((w, self.bias) for w in block)
                    continue
                code, weight = self.space.codes(self.space.letters(block))
                found = self.weights[self.place[code]] if self.table is None else self.table[code]
                raw_margin = (found * weight).sum(axis=1)
                # only words near an insult are worth their norm; it is 0.2 at least
                margin = np.full(len(block), self.bias)
                some = np.flatnonzero(raw_margin > 0)
                if len(some):
                    margin[some] += raw_margin[some] / self.space.norms([block[i] for i in some])
                parts.update(zip(block, margin.tolist()))
        cache, bias = self.cache, self.bias
        for t, ps in used.items():
            cache[t] = max((parts[p] for p in ps), default=bias)

    def margins(self, texts: list[str | None]) -> np.ndarray:
        """For each text the largest margin of a word; the bias where there is none."""
        raw = [tokens(t) if t else set() for t in texts]
        used = set().union(*raw)
        cache = self.cache
        missing = used.difference(cache)
        if missing:
            # unseen words of all texts at once: the work is in arrays over many words
            if len(cache) + len(missing) > _CACHE_WORDS:
                cache.clear()
                missing = used
            self.learn(missing)
        return np.array([max(map(cache.__getitem__, r), default=self.bias) for r in raw])


def _by_length(words: list[str], most: int):
    """Row numbers of words of one length, at most so many at a time; too short ones are left out."""
    groups = defaultdict(list)
    for i, w in enumerate(words):
        if len(w) >= 3:
            groups[len(w)].append(i)
    for n, rows in groups.items():
        size = max(1, most // (n * (n - 1) * (n - 2) // 6))
        for at in range(0, len(rows), size):
            yield rows[at : at + size]


def _kernels(space: Subsequences, words: list[str], place: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Kernels of words with vectors over the placed subsequences (its last row is 0)."""
    out = np.zeros((len(words), vectors.shape[1]), np.float32)
    for rows in _by_length(words, 4_000_000 // vectors.shape[1]):
        block = [words[i] for i in rows]
        code, weight = space.codes(space.letters(block))
        out[rows] = np.einsum("bcm,c->bm", vectors[place[code]], weight) / space.norms(block)[:, None]
    return out


def _vectors(space: Subsequences, words: list[str], place: np.ndarray, width: int) -> np.ndarray:
    """Normalised subsequence vectors of a few words, as columns, with a last row of 0."""
    out = np.zeros((width + 1, len(words)), np.float32)
    for rows in _by_length(words, _CELLS):
        block = [words[i] for i in rows]
        code, weight = space.codes(space.letters(block))
        at = place[code]
        np.add.at(out, (at, np.array(rows)[:, None]), np.broadcast_to(weight, at.shape))
        out[:, rows] /= space.norms(block)
    out[-1] = 0
    return out


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, strength: float = 0.01) -> np.ndarray:
    """Linear machine with squared hinge loss, by Newton steps; the last entry is the bias."""
    n = x.shape[1] + 1
    w = np.zeros(n)
    ridge = np.full(n, strength * weight.sum())
    ridge[-1] = 1e-6 * weight.sum()
    for _ in range(60):
        left, right = np.diag(ridge), np.zeros(n)
        for at in range(0, len(x), 1024):  # a few rows at once: no copy of all of them
            block = np.hstack([x[at : at + 1024], np.ones((len(x[at : at + 1024]), 1))])
            own = y[at : at + 1024]
            inside = own * (block @ w) < 1
            a = block[inside]
            scaled = a * weight[at : at + 1024][inside][:, None]
            left += scaled.T @ a
            right += scaled.T @ own[inside]
        new = np.linalg.solve(left, right)
        if np.abs(new - w).max() < 1e-9:
            return new
        w = new
    return w  # the last steps alternate between sets that differ in rows on the margin


def _clusters(bags: list[np.ndarray], df: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A number for each bag; near copies, which share rare words' least hashes, get the same."""
    parent = list(range(len(bags)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    seen: dict[tuple[int, int], list[int]] = {}
    common = max(20, len(bags) // 100)
    kept = []
    for i, bag in enumerate(bags):
        rare = bag[(df[bag] > 1) & (df[bag] <= common)]
        kept.append(rare)
        codes = hashes[rare]
        for k in range(4 if len(rare) >= 8 else 0):
            least = int(((codes * np.uint64(2 * k + 0x9E3779B1) + np.uint64(k * 0x85EBCA6B)) & np.uint64(0xFFFFFFFF)).min())
            others = seen.setdefault((k, least), [])
            # one rare word in common is no copy yet, and chains of such would join unlike texts
            for j in others:
                if root(i) != root(j):
                    both = len(np.intersect1d(rare, kept[j], assume_unique=True))
                    if 2 * both >= len(rare) + len(kept[j]) - both:
                        parent[root(i)] = root(j)
            if all(root(j) != root(i) for j in others):
                others.append(i)
    return np.array([root(i) for i in range(len(bags))])


def _witnesses(bags: list[np.ndarray], toxic: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words that clean bags hardly hold, the share of toxic ones among the groups that hold them, and these toxic groups."""
    words = np.concatenate(bags)
    df = np.bincount(words, minlength=len(hashes))
    groups = _clusters(bags, df, hashes)
    size = [len(b) for b in bags]
    # a cluster of near copies counts once for each label
    held = np.unique(np.column_stack([words, np.repeat(toxic, size), np.repeat(groups, size)])[df[words] >= 3], axis=0)
    a = np.bincount(held[held[:, 1] == 1, 0], minlength=len(hashes))
    b = np.bincount(held[held[:, 1] == 0, 0], minlength=len(hashes))
    nt, nc = len(np.unique(groups[toxic])), len(np.unique(groups[~toxic]))
    prior = nt / (nt + nc)
    expected = np.maximum((a + b) * prior, 1e-9)
    sure = (a - expected) / np.sqrt(expected * (1 - prior)) > 3.5 - (b == 0)
    found = np.flatnonzero((a >= 3) & sure & (a / nt > 8 * b / nc))
    # a toxic group counts for its strongest words only: what stands beside a word twice as
    # strong is explained by it, and chance words of such texts are no witnesses
    strength = np.zeros(len(hashes))
    strength[found] = a[found] ** 2 / (a + b)[found]
    own = held[(held[:, 1] == 1) & (strength[held[:, 0]] > 0)]
    best = np.zeros(len(bags))
    np.maximum.at(best, own[:, 2], strength[own[:, 0]])
    left = np.bincount(own[2 * strength[own[:, 0]] >= best[own[:, 2]], 0], minlength=len(hashes))
    found = found[left[found] >= 3]
    return found, a[found] / (a + b)[found], a[found]


def _misspelt(word: str, alphabet: str) -> list[str]:
    """The word with one character more: a doubled one, and stray ones, at each inner place."""
    out = []
    for i in range(1, len(word) if 3 <= len(word) < SPAN else 0):
        at = zlib.crc32(f"{word} {i}".encode("utf-8", "surrogatepass"))
        stray = [alphabet[(at + k * (len(alphabet) // STRAYS + 1)) % len(alphabet)] for k in range(STRAYS)]
        out += [word[:i] + word[i - 1 :], *(word[:i] + c + word[i:] for c in stray)]
    return out


class Model:
    """A fitted machine: what tasks need to score texts."""

    def __init__(self, alphabet: str = "a", kept=None, weights=None, bias: float = -1.0, slope: float = 0.0, offset: float = 0.0):
        self.alphabet, self.bias, self.slope, self.offset = alphabet, bias, slope, offset
        # sorted numbers of the subsequences with a weight; the last weight is that of all others
        self.kept = np.empty(0, np.int64) if kept is None else kept
        self.weights = np.zeros(1, np.float32) if weights is None else weights

    def scorer(self) -> Scorer:
        return Scorer(self.alphabet, self.kept, self.weights, self.bias)

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.asarray(margin, float) + self.offset, -500, 500)))


def _prior_only(n_toxic: int, n_clean: int) -> Model:
    share = (n_toxic + 1e-3) / (n_toxic + n_clean + 2e-3)
    return Model(offset=float(np.log(share / (1 - share))) if n_toxic + n_clean else -1.0)


def fit(texts: list[str], labels: list[int]) -> Model:
    """Train on labelled texts."""
    toxic = np.array(labels, bool)
    number: dict[str, int] = {}
    bags, sentences = [], []
    for text in texts:
        own = []
        for part in _SENTENCE.split(text):
            words = {p for t in tokens(part) for w in forms(t) for p in pieces_of(w)}
            if words:
                own.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words)))
        sentences.append(own)
        bags.append(np.unique(np.concatenate(own)) if own else np.empty(0, np.int32))
    if not toxic.any() or toxic.all() or not number:
        return _prior_only(int(toxic.sum()), int((~toxic).sum()))
    names = np.array(list(number), object)
    number.clear()
    hashes = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in names], np.uint64)
    bags = [b if len(b) <= MAX_WORDS else b[np.argsort(hashes[b], kind="stable")[:MAX_WORDS]] for b in bags]
    found, share, groups = _witnesses(bags, toxic, hashes)
    if not len(found):
        return _prior_only(int(toxic.sum()), int((~toxic).sum()))

    witnesses = names[found].tolist()
    # landmarks by evidence: toxic groups, then their share
    order = np.lexsort((names[found].astype(str), -share, -groups))
    positive = [witnesses[i] for i in order[:WITNESSES]]
    alphabet = "".join(sorted({c for w in witnesses for c in w}))
    space = Subsequences(alphabet)
    used: set[int] = set()
    for w in witnesses:
        if len(w) >= 3:
            used.update(np.unique(space.codes(space.letters([w]))[0]).tolist())
    kept = np.array(sorted(used - {0}), np.int64)
    place = Places(kept, space.size)

    # distinct clean words: a hash sample, and those that come nearest to a witness
    clean = np.unique(np.concatenate([b for b, y in zip(bags, toxic) if not y]))
    clean = clean[np.argsort(hashes[clean], kind="stable")]
    words = [w for w in names[clean].tolist() if len(w) >= 3]
    nearness = np.zeros(len(words))
    for at in range(0, len(witnesses), 160):
        seeds = _vectors(space, witnesses[at : at + 160], place, len(kept))
        for i in range(0, len(words), 10_000):
            near = _kernels(space, words[i : i + 10_000], place, seeds).max(axis=1)
            nearness[i : i + 10_000] = np.maximum(nearness[i : i + 10_000], near)
    hard = [words[i] for i in np.argsort(-nearness, kind="stable")[:CLEAN_WORDS]]
    negative = list(dict.fromkeys([*hard, *words[:CLEAN_WORDS]]))
    landmarks = [*positive, *hard[:LANDMARKS]]
    marks = _vectors(space, landmarks, place, len(kept))
    values, vectors = np.linalg.eigh(marks.T.astype(float) @ marks)
    good = values > 1e-6 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])

    # sentences: a clean one by its most telling word, a toxic one by its witness
    chosen = list(dict.fromkeys([*witnesses, *negative]))
    row = dict(zip(chosen, range(len(chosen))))
    of = np.array([row.get(w, -1) for w in names.tolist()])
    is_witness = np.zeros(len(chosen), bool)
    is_witness[: len(witnesses)] = True
    clean_words = set(words)
    altered, by = [], []
    for i in order[:WITNESSES]:
        new = [v for v in dict.fromkeys(_misspelt(witnesses[i], alphabet)) if v not in clean_words]
        altered += new
        by += [groups[i] / max(1, len(new))] * len(new)
    x = (_kernels(space, chosen, place, marks) @ whiten).astype(np.float32)
    bent = (_kernels(space, altered, place, marks) @ whiten).astype(np.float32)
    toxic_rows, clean_rows = [], []
    for own, y in zip(sentences, toxic):
        for s in own:
            r = of[s]
            r = r[(r >= 0) & is_witness[r]] if y else r[r >= 0]
            if len(r):
                (toxic_rows if y else clean_rows).append(r)
    margin = np.zeros(len(chosen))
    margin[: len(witnesses)] = share
    for _ in range(4):
        pos = Counter(int(r[margin[r].argmax()]) for r in toxic_rows)
        neg = Counter(int(r[margin[r].argmax()]) for r in clean_rows)
        for w in negative:
            neg[row[w]] += 1 - int(is_witness[row[w]])
        rows = np.array([*pos, *neg])
        y = np.array([1.0] * len(pos) + [-1.0] * len(neg))
        # a word counts by the root of the sentences it stands for, each label by half
        c = np.sqrt(np.array([*pos.values(), *neg.values()], float))
        c[: len(pos)] /= max(c[: len(pos)].sum(), 1e-9)
        c[len(pos) :] /= max(c[len(pos) :].sum(), 1e-9)
        # altered witnesses count more by their toxic groups
        extra = ALTERED * np.array(by) / max(1e-9, sum(by))
        beta = _machine(np.vstack([x[rows], bent]), np.append(y, np.ones(len(bent))), np.append(c, extra), RIDGE)
        margin = x @ beta[:-1] + beta[-1]

    weights = np.append(marks[:-1] @ (whiten @ beta[:-1]), 0.0).astype(np.float32)
    model = Model(alphabet, kept, weights, float(beta[-1]))
    scorer = model.scorer()
    margins = np.concatenate([scorer.margins(texts[i : i + 250]) for i in range(0, len(texts), 250)])
    model.slope, model.offset = _calibrate(margins, np.array(labels, float))
    return model


def _calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope by logistic regression, classes weighted alike; offset so that 0.5 lies at the best cut.

    A clean text above the cut weighs as CLEAN_COST toxic ones below it; of cuts that
    are as good, the one in the middle of the widest gap.
    """
    c = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    x = np.column_stack([margin, np.ones(len(margin))])
    w = np.zeros(2)
    ridge = np.diag([1e-4, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (c * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (c * (y - p)) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    slope = float(max(w[0], 0.0))
    at = np.unique(margin)
    if len(at) < 2 or not slope:
        return slope, float(w[1])
    toxic, clean = np.sort(margin[y > 0]), np.sort(margin[y == 0])
    # the cut above at[i]: toxic texts at or below it are missed, clean ones above it rejected
    missed = np.searchsorted(toxic, at[:-1], side="right") / len(toxic)
    rejected = 1 - np.searchsorted(clean, at[:-1], side="right") / len(clean)
    loss = missed + CLEAN_COST * rejected
    best = np.flatnonzero(loss <= loss.min() + 1e-12)
    i = best[np.argmax(np.diff(at)[best])]
    return slope, -slope * float(at[i] + at[i + 1]) / 2


def fit_on(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, training: str = "true") -> Model:
    """Fit on labelled documents for which the SQL condition ``training`` on doc_id holds."""
    marks = labels.where("toxic in (0, 1) and doc_id is not null").where(training).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = (
        documents.select("doc_id", "text").where("text is not null and doc_id is not null").where(training)
        .withColumn("h", F.xxhash64("text"))
    )
    texts, y = [], []
    for value in (1, 0):
        ids = marks.where(F.col("toxic") == value)
        # the sample is chosen by hash alone; texts are fetched only for it
        chosen = rows.join(ids, "doc_id").groupBy("h").agg(F.min("doc_id").alias("doc_id")).orderBy("h").limit(per_class)
        found = rows.join(F.broadcast(chosen), ["h", "doc_id"], "left_semi").select("h", "text").collect()
        for _, text in sorted({(r.h, r.text) for r in found}):
            texts.append(text)
            y.append(value)
    return fit(texts, y)


def score(documents: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Append score (double, 0 to 1) and predicted (1 from a score of 0.5)."""

    def make():
        scorer = model.scorer()

        def work(texts):
            p = model.probability(scorer.margins(texts))
            return [p, (p >= 0.5).astype("int32")]

        return work

    new = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return append_columns(documents, ["text"], new, make, keep)


HELD_OUT = "crc32(cast(doc_id as string)) % 5 = 0"


def held_out_scores(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    model = fit_on(documents, labels, per_class, f"NOT ({HELD_OUT})")
    scored = score(documents, model, keep=["doc_id"])
    return scored.select("doc_id", F.coalesce(F.expr(HELD_OUT), F.lit(False)).alias("held_out"), "score", "predicted")


def without_toxic(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """The rows not rejected, with their columns; learnt from all labels but the held-out fold."""
    model = fit_on(documents, labels, per_class, f"NOT ({HELD_OUT})")
    marked = documents.withColumn("__text", F.col("text"))

    def make():
        scorer = model.scorer()
        return lambda texts: [model.probability(scorer.margins(texts)) < 0.5]

    return append_columns(marked, ["__text"], [T.StructField("__kept", T.BooleanType())], make, documents.columns).where("__kept").drop("__kept")
