"""Ranked lexical search by an Aho-Corasick scan of the documents, without an index of them.

All terms of the items go into one automaton, each with a blank before and behind. A text
is made a run of terms in single bytes (A-Z lower-cased, every separator a blank), so the
automaton finds whole terms only, and their counts come straight from the text. A first
scan counts documents and terms, per task and then over all tasks; a second one scores each text for
all items that a found term belongs to, and a task hands on its best ``top`` of each item.
The texts are read twice and never shuffled.

The automaton is sent to every task, so its size is bounded: items are dealt into slices
of about ``term_bytes`` bytes of terms by a hash of their id, and each slice is a scan of
its own. An item is never split.

Every row of the documents is a document, also one that repeats another or has no id
(NULL ids rank last among equal scores). NULL and empty texts have no terms. Rows of the
items that share an id are one item; items without an id or without a term have no result.
Equal scores rank by ascending ``doc_id``.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator, Sequence
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..sources.scratch import stored

TOP = 10
#: Bytes of terms that one automaton holds, about; it takes some hundred times as much memory at most.
TERM_BYTES = 1 << 20
_BLANK = 32
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else _BLANK for b in range(256)
)


def guarded(text: str | None) -> bytes:
    """The text's terms with blanks around each."""
    return b" %b " % (text or "").encode("utf-8", "surrogatepass").translate(_TABLE)


def terms(text: str | None) -> list[bytes]:
    return guarded(text).split()


def n_terms(bare: bytes) -> int:
    inside = np.frombuffer(bare, np.uint8) != _BLANK
    return int(np.count_nonzero(inside[1:] & ~inside[:-1]))


class Automaton:
    """Counts of known terms in a text."""

    def __init__(self, known: Sequence[bytes]):
        import ahocorasick

        self.found = ahocorasick.Automaton()
        for i, term in enumerate(known):
            self.found.add_word(f" {term.decode('latin-1')} ", i)
        if known:
            self.found.make_automaton()
        self.empty = not known

    def counts(self, bare: bytes) -> dict[int, int]:
        if self.empty:
            return {}
        return Counter(map(itemgetter(1), self.found.iter(bare.decode("latin-1"))))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        columns = [batch.column(i) for i in range(batch.num_columns)]
        for row in range(batch.num_rows):  # one text at a time leaves Arrow
            yield tuple(c[row].as_py() for c in columns)


def _item_terms(items: DataFrame) -> DataFrame:
    """Distinct (item, term)."""

    def run(batches):
        for item, text in _texts(batches):
            found = list(set(terms(text)))
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.int64()), pa.array(found, pa.binary())], names=["item", "term"])

    rows = items.select(F.col("item_id").cast("long").alias("item"), "text").where("item_id IS NOT NULL")
    return rows.mapInArrow(run, "item long, term binary").distinct()


def _statistics(documents: DataFrame, known: list[bytes]) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and the documents that hold each known term."""

    def run(batches):
        automaton = Automaton(known)
        held, n, total = np.zeros(len(known), np.int64), 0, 0
        for (text,) in _texts(batches):
            bare = guarded(text)
            size = n_terms(bare)
            n, total = n + (size > 0), total + size
            seen = list(automaton.counts(bare))
            held[seen] += 1
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([[-1, -2], at])), pa.array(np.concatenate([[n, total], held[at]]))], names=["term", "n"])

    sums = documents.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    of = {r.term: r.n for r in sums.collect()}  # a row per term of the slice
    return of.get(-1) or 0, of.get(-2) or 0, np.array([of.get(i, 0) for i in range(len(known))], np.int64)


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


class Postings:
    """The items of each term, and the scores that a text's counts give to items."""

    def __init__(self, of_term: list[list[int]], weights: list[int], n: int, total: int, items: int):
        lengths = np.array([len(x) for x in of_term], np.int64)
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        self.items = np.array([i for x in of_term for i in x], np.int64)
        self.weights = np.array(weights, np.int64)
        self.n, self.total, self.size = n, total, items

    def scores(self, counts: dict[int, int], size: int) -> np.ndarray:
        out = np.zeros(self.size, np.int64)
        at = np.fromiter(counts.keys(), np.int64, len(counts))
        tf = np.fromiter(counts.values(), np.int64, len(counts))
        m = 10 + 90 * size * self.n // self.total
        each = self.weights[at] * (1_000_000_000 * tf // (1000 * tf + 8 * m))
        lengths = self.ends[at] - self.starts[at]
        first = np.cumsum(lengths) - lengths
        place = np.arange(int(lengths.sum())) + np.repeat(self.starts[at] - first, lengths)
        np.add.at(out, self.items[place], np.repeat(each, lengths))
        return out


def _best(documents: DataFrame, known: list[bytes], of_term: list[list[int]], ids: list[int], stats, top: int) -> DataFrame:
    """(item_id, doc_id, score): each task's best ``top`` of each item."""
    n, total, held = stats
    weights = [weight(n, int(h)) for h in held]

    def run(batches):
        automaton = Automaton(known)
        postings = Postings(of_term, weights, n, total, len(ids))
        heaps: list[list] = [[] for _ in ids]  # worst first: low score, then no id, then large id
        least = np.ones(len(ids), np.int64)  # scores below these cannot enter
        for doc, text in _texts(batches):
            bare = guarded(text)
            counts = automaton.counts(bare)
            if not counts:
                continue
            scores = postings.scores(counts, n_terms(bare))
            for i in np.flatnonzero(scores >= least).tolist():
                entry, heap = (int(scores[i]), doc is not None, -(doc or 0)), heaps[i]
                if len(heap) < top:
                    heapq.heappush(heap, entry)
                else:
                    heapq.heappushpop(heap, entry)
                if len(heap) == top:
                    least[i] = heap[0][0]
        rows = [(ids[i], -e[2] if e[1] else None, e[0]) for i, heap in enumerate(heaps) for e in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["item_id", "doc_id", "score"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "item_id long, doc_id long, score long")


def search(documents: DataFrame, items: DataFrame, top: int = TOP, term_bytes: int = TERM_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item with a score above 0.

    ``documents`` has doc_id and text, ``items`` item_id and text; other columns are not read.
    """
    spark = documents.sparkSession
    wanted = stored(_item_terms(items), "terms")
    total_bytes = wanted.agg(F.sum(F.octet_length("term") + 2)).first()[0] or 0
    slices = max(1, -(-total_bytes // term_bytes))
    parts = []
    for part in range(slices):
        mine = wanted.where(F.pmod(F.xxhash64("item"), F.lit(slices)) == part).collect()  # about term_bytes
        ids = sorted({r.item for r in mine})
        known = sorted({bytes(r.term) for r in mine})
        place, at = {t: i for i, t in enumerate(known)}, {x: i for i, x in enumerate(ids)}
        of_term: list[list[int]] = [[] for _ in known]
        for r in mine:
            of_term[place[bytes(r.term)]].append(at[r.item])
        stats = _statistics(documents, known)
        if known and stats[0]:
            parts.append(_best(documents, known, of_term, ids, stats, top))
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")


SQL = f"""
WITH found AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents
), sized AS (
  SELECT doc_id, terms, len(terms) AS n FROM found WHERE len(terms) > 0
), total AS (
  SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS l FROM sized
), wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL
), words AS (
  SELECT doc_id, n, unnest(terms) AS term FROM sized
), tf AS (
  SELECT doc_id, n, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM wanted) GROUP BY ALL
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(nn) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM tf, total GROUP BY term
), scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // l)))) AS BIGINT) AS score
  FROM tf JOIN w USING (term) JOIN wanted USING (term), total GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= {TOP}
"""
