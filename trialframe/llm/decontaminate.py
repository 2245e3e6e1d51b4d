"""Documents that hold a benchmark item, by q-gram filtering and banded alignment.

Texts are compared in lower case with every white-space run as one space. By the
q-gram lemma a region within ``k`` edits of an item of length ``m`` shares at least
``m - q + 1 - k q`` of its q-grams, all on diagonals that lie within ``k`` of each
other. So shared q-grams are counted in diagonal bands of width ``2 (k + 1)`` that
overlap by half; every such region lies in one of them. Bands with enough are
retained and verified by alignment in a band around them, where enough places of the
item take part too.

The edit budget of an item is ``rate`` times its length, less where the lemma would
leave fewer than ``MIN_SHARED`` shared q-grams. An item under ``min_chars`` characters is
matched exactly where no letter or digit adjoins it: its budget is 0.

The distinct items are an index in each task: about ``slice_chars`` characters of them at a
time; a larger benchmark is taken in slices, each over all documents. Between slices
the documents are written and read again, so a stage holds one slice only.
Bands are counted in blocks of the text. The places of a q-gram within an item count as runs
of neighbours, so a repetitive text costs a few counters at each place, and a band is
dropped once no later place can reach it.

NULL and empty texts hold nothing, and NULL and empty items are left out. A NULL item
id reads -1. Items that repeat are reported each. Rows with the same ``doc_id`` are reported each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from ..sources.scratch import stored
from .arrow import append_columns

Q = 8
RATE = 0.1
MIN_SHARED = 6
MIN_CHARS = 24
SLICE_CHARS = 4_000_000
#: Characters that are hashed at once, and band counts that are made at once.
_BLOCK = 1 << 17
_COUNTS = 1 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit polynomial hash of each q-gram, built from those of half the length."""
    if len(codes) < q:
        return np.empty(0, np.uint64)
    power, width, hashed = _MULTIPLIER, 1, codes
    done, done_width = None, 0
    with np.errstate(over="ignore"):
        while True:
            if q & width:
                n = len(codes) - done_width - width + 1
                done = hashed[:n] if done is None else done[:n] * power + hashed[done_width : done_width + n]
                done_width += width
            if width * 2 > q:
                return done
            hashed = hashed[:-width] * power + hashed[width:]
            power, width = power * power, width * 2


class Index:
    """The q-grams of some items, sorted by hash, with a bitmap in front.

    An entry is a run of places of a q-gram in an item whose gaps are at most a band's width.
    Every band between the ends of a run then holds a place of it, and two runs share no band.
    """

    def __init__(self, items: list[tuple[int, str]], q: int, rate: float) -> None:
        self.q, self.ids, self.texts = q, [i for i, _ in items], [t for _, t in items]
        self.length = np.array([len(t) for t in self.texts], np.int64)
        fits = (self.length - q + 1 - MIN_SHARED) // q
        self.budget = np.maximum(0, np.minimum((self.length * rate).astype(np.int64), fits))
        self.needed = np.maximum(1, self.length - q + 1 - self.budget * q)
        self.step = self.budget + 1
        hashes = [gram_hashes(_codes(t), q) for t in self.texts]
        flat = np.concatenate(hashes)
        item = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
        at = np.concatenate([np.arange(len(h)) for h in hashes])
        order = np.lexsort((at, item, flat))
        flat, item, at = flat[order], item[order], at[order]
        new = np.ones(len(flat), bool)
        new[1:] = (flat[1:] != flat[:-1]) | (item[1:] != item[:-1]) | (at[1:] - at[:-1] > 2 * self.step[item[1:]])
        run = np.flatnonzero(new)
        self.item, self.first = item[run], at[run]
        self.last = at[np.append(run[1:], len(flat)) - 1]
        self.grams, start = np.unique(flat[run], return_index=True)
        self.start = np.append(start, len(run))
        self.shift = np.uint64(64 - max(16, int(len(self.grams)).bit_length() + 5))
        self.ranked: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.bitmap = np.zeros(1 << (64 - int(self.shift)), bool)
        self.bitmap[self._slot(self.grams)] = True

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (hashes * _MULTIPLIER) >> self.shift

    def hits(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Shared q-grams in blocks: place in the codes, entry; about _COUNTS band counts at once."""
        widest = int(((self.last - self.first) // self.step[self.item]).max()) + 3
        for at in range(0, max(0, len(codes) - self.q + 1), _BLOCK):
            hashed = gram_hashes(codes[at : at + _BLOCK + self.q - 1], self.q)
            maybe = np.flatnonzero(self.bitmap[self._slot(hashed)])
            gram = np.minimum(np.searchsorted(self.grams, hashed[maybe]), len(self.grams) - 1)
            sure = self.grams[gram] == hashed[maybe]
            maybe, gram = maybe[sure], gram[sure]
            n = self.start[gram + 1] - self.start[gram]
            upto = np.cumsum(n)
            done = 0
            while done < len(maybe):
                before = int(upto[done - 1]) if done else 0
                end = max(done + 1, int(np.searchsorted(upto, before + max(1, _COUNTS // widest), side="right")))
                k = n[done:end]
                entry = np.repeat(self.start[gram[done:end]] - (upto[done:end] - k - before), k) + np.arange(k.sum())
                yield np.repeat(maybe[done:end] + at, k), entry
                done = end

    def regions(self, codes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text number, item, lowest diagonal in the text) of each band with enough shared q-grams.

        Shared q-grams are counted by their places in the text, so the counts of blocks add up.
        Diagonals of all texts lie on one line, with room between texts for no band to span two.
        """
        if not len(self.grams):
            return
        longest = int(self.length.max())
        room = longest + 2 * int(self.step.max())
        origin = starts + np.arange(len(starts)) * room + longest
        span = len(codes) + len(starts) * room + longest + 3
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for place, entry in self.hits(codes):
            doc = np.searchsorted(starts, place, side="right") - 1
            line = place + doc * room + longest
            item = self.item[entry]
            step = self.step[item]
            # a diagonal lies in two bands: its own and the one below
            low = (line - self.last[entry]) // step - 1
            n = (line - self.first[entry]) // step - low + 1
            ends = np.cumsum(n)
            band = np.repeat(low - (ends - n), n) + np.arange(ends[-1])
            more, times = np.unique(np.repeat(item * span, n) + band + 1, return_counts=True)
            both, where = np.unique(np.concatenate([keys, more]), return_inverse=True)
            counts = np.bincount(where, np.concatenate([counts, times]), len(both)).astype(np.int64)
            keys = both
            # what the next place can no longer reach is complete
            item = keys // span
            closed = (keys % span + 1) * self.step[item] <= int(line[-1]) - self.length[item]
            yield from self._retained(keys[closed], counts[closed], span, origin)
            keys, counts = keys[~closed], counts[~closed]
        yield from self._retained(keys, counts, span, origin)

    def _retained(self, keys, counts, span, origin) -> Iterator[tuple[int, int, int]]:
        item = keys // span
        enough = counts >= self.needed[item]
        for j, band in zip(item[enough].tolist(), (keys[enough] % span - 1).tolist()):
            step = int(self.step[j])
            doc = int(np.searchsorted(origin - int(self.length[j]), (band + 2) * step - 1, side="right")) - 1
            yield doc, j, band * step - int(origin[doc])


    def shared(self, j: int, window: np.ndarray, low: int, high: int) -> int:
        """Places of item j whose q-gram the window holds on diagonals low to high."""
        if j not in self.ranked:
            self.ranked[j] = np.unique(gram_hashes(_codes(self.texts[j]), self.q), return_inverse=True)
        grams, rank = self.ranked[j]
        hashed = gram_hashes(window, self.q)
        found = np.minimum(np.searchsorted(grams, hashed), len(grams) - 1)
        place = np.flatnonzero(grams[found] == hashed)
        # one number for q-gram and place, with room for places outside of the window
        room = len(window) + 2 * len(rank) + 2 * (high - low) + 2
        key = np.sort(found[place] * room + place)
        at = np.arange(len(rank))
        least = rank * room + np.maximum(at + low, 0)
        first = np.searchsorted(key, least)
        key = np.append(key, np.iinfo(np.int64).max)
        return int(np.count_nonzero((at + high >= 0) & (key[first] <= rank * room + at + high)))


class Short:
    """Items too short for the lemma, found exactly where no letter or digit adjoins them."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        import ahocorasick

        self.ids, self.texts = [i for i, _ in items], [t for _, t in items]
        self.automaton = ahocorasick.Automaton()
        by: dict[str, list[int]] = {}
        for j, text in enumerate(self.texts):
            by.setdefault(text, []).append(j)
        for text, numbers in by.items():
            self.automaton.add_word(text, (len(text), numbers))
        self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item number, start, end, 0), without overlaps of an item with itself."""
        out, free = [], {}
        for last, (width, numbers) in self.automaton.iter(text):
            start, end = last + 1 - width, last + 1
            if start and text[start - 1].isalnum() and text[start].isalnum():
                continue
            if end < len(text) and text[last].isalnum() and text[end].isalnum():
                continue
            for j in numbers:
                if free.get(j, 0) <= start:
                    free[j] = end
                    out.append((j, start, end, 0))
        return sorted(out)


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best region of the text on diagonals low to high.

    Among regions with the fewest edits the one that ends first; None over budget.
    Row i of the band holds text places ``low + i`` to ``high + i``.
    """
    far = budget + 1
    width = high - low + 1
    offset = np.arange(width)
    start_at = low + offset
    inside = (start_at >= 0) & (start_at <= len(text))
    cost = np.where(inside, 0, far)
    begin = np.where(inside, start_at, -1)
    for i in range(len(item)):
        at = low + i + offset  # the text character that a diagonal step consumes
        legal = (at >= 0) & (at < len(text))
        miss = np.ones(width, np.int64)
        miss[legal] = text[at[legal]] != item[i]
        best = np.where(legal, cost + miss, far)
        source = begin
        down = np.append(cost[1:], far) + 1
        less = down < best
        best, source = np.where(less, down, best), np.where(less, np.append(begin[1:], -1), source)
        # insertions run along the row: the least of an earlier cost plus the distance
        level = best - offset
        least = np.minimum.accumulate(level)
        origin = np.maximum.accumulate(np.where(level == least, offset, 0))
        cost = np.where((at + 1 >= 0) & (at + 1 <= len(text)), np.minimum(least + offset, far), far)
        begin = source[origin]
        if cost.min() > budget:
            return None
    edits = int(cost.min())
    at = int(np.flatnonzero(cost == edits)[0])
    return edits, int(begin[at]), int(low + len(item) + at)


def matches(index: Index, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
    """For each normal text its (item number, start, end, edits), overlapping regions of an item merged."""
    starts = np.cumsum([0, *[len(t) + 1 for t in texts]])[:-1]
    codes = _codes("\0".join(texts))
    found: list[dict[int, list]] = [{} for _ in texts]
    needles: dict[int, np.ndarray] = {}
    for d, j, low in index.regions(codes, starts):
        k, m = int(index.budget[j]), int(index.length[j])
        high = low + 2 * (k + 1) - 1
        begin, end = max(0, low - k), min(len(texts[d]), high + m + k + 1)
        exact = texts[d].find(index.texts[j], begin, end)
        if exact >= 0:
            hit = (0, exact, exact + m)
        else:
            if j not in needles:
                needles[j] = _codes(index.texts[j])
            part = codes[starts[d] + begin : starts[d] + end]
            # the band was retained by places of the text; places of the item bind as well
            if index.shared(j, part, low - begin, high - begin) < index.needed[j]:
                continue
            hit = align(needles[j], part, low - k - begin, high + k - begin, k)
            if hit is None:
                continue
            hit = (hit[0], hit[1] + begin, hit[2] + begin)
        kept = found[d].setdefault(j, [])
        near = [x for x in kept if x[1] < hit[2] and hit[1] < x[2]]
        if not near or hit < min(near):
            found[d][j] = [x for x in kept if x not in near] + [hit]
    return [sorted((j, s, e, c) for j, hits in by.items() for c, s, e in hits) for by in found]


_LEAK = T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("start", T.LongType()),
    T.StructField("end", T.LongType()), T.StructField("edits", T.IntegerType()),
])


def with_leaks(
    documents: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE, min_chars: int = MIN_CHARS,
    slice_chars: int = SLICE_CHARS, out: str = "leaks", keep: list[str] | None = None,
) -> DataFrame:
    """Append the regions that match items: an array of (item_id, start, end, edits).

    Places count characters of the normal text, the end not included.
    """
    if min_chars < q + MIN_SHARED:
        raise ValueError("min_chars must leave MIN_SHARED q-grams")
    usable = (
        benchmark.where(F.col("text").isNotNull())
        .groupBy(F.coalesce(F.col("item_id").cast("long"), F.lit(-1).cast("long")).alias("item_id"), "text")
        .agg(F.count("*").alias("times"))
    )
    total = usable.agg(F.sum(F.length("text"))).first()[0] or 0
    slices = total // slice_chars + 1
    kept = list(keep or documents.columns)
    result, names = documents, []
    for part in range(slices):
        rows = usable.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(slices)) == part).collect()
        times = Counter()
        for r in rows:
            times[r.item_id, normal(r.text)] += r.times
        items = sorted(x for x in times if x[1])
        name = f"__leaks{part}"

        def make(items=items, times=times):
            long = [x for x in items if len(x[1]) >= min_chars]
            short = [x for x in items if len(x[1]) < min_chars]
            index = Index(long, q, rate) if long else None
            exact = Short(short) if short else None

            def work(texts):
                read = [normal(t or "") for t in texts]
                rows = [[] for _ in texts]
                if index is not None:
                    for row, hits in zip(rows, matches(index, read)):
                        row += [(long[j], s, e, c) for j, s, e, c in hits]
                if exact is not None:
                    for row, text in zip(rows, read):
                        row += [(short[j], s, e, c) for j, s, e, c in exact.matches(text)]
                return [[[(x[0], s, e, c) for x, s, e, c in row for _ in range(times[x])] for row in rows]]

            return work

        columns = [*dict.fromkeys([*kept, "text"]), *names]
        result = append_columns(result, ["text"], [T.StructField(name, T.ArrayType(_LEAK))], make, columns)
        names.append(name)
        if part < slices - 1:
            result = stored(result, "leaks")
    return result.select(
        *[F.col(f"`{c}`") for c in kept if c.lower() != out.lower()], F.flatten(F.array(*names)).alias(out)
    )


def leaks(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row for each region of a document that matches an item."""
    found = with_leaks(documents, benchmark, keep=["doc_id"], out="leaks", **options)
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def without_leaks(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows that hold no item, with their columns."""
    found = with_leaks(documents, benchmark, out="__leaks", **options)
    return found.where(F.size("__leaks") == 0).drop("__leaks")
