"""SimHash fingerprints and their links by a binary trie self-join.

Fingerprints that differ in at most three of 64 bits agree on one of four blocks of
16 bits at least. So four tries are built, one for each block moved to the front,
and in each only node pairs below the same 16-bit node are followed. From there two
nodes are walked down together, bit by bit: their children pair up, differing bits
add up, and a pair ends once they exceed the budget.

Work is over distinct fingerprints, so exact copies cost one row. Nodes with many
distinct fingerprints are split further in Spark, as pairs of smaller nodes within
the budget, before any task gathers them: a task never holds more than
``NODE_ROWS`` rows of a side. Links within a task are reduced to one edge for each
fingerprint, so no group is written out as all its pairs.

NULL and empty texts have fingerprint zero and are linked like any other. A NULL
``doc_id`` takes part and is never a component's smallest id (a component of only
such rows has a NULL id). Repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..sources.scratch import stored
from .arrow import append_columns
from .components import connected

BUDGET = 3
BLOCK = 16
#: Rows of a trie node beyond which Spark splits it.
NODE_ROWS = 2048
#: Bits that one split goes down.
STEP = 4
_BITS_AT_ONCE = 1 << 15


def fingerprint(text: str | None, size: int = 3) -> int:
    """Majority bits of the hashes of all word shingles, as a signed 64-bit integer."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - size + 1)
    last = ends[min(size, len(words)) - 1 :]
    of = xxhash.xxh64_intdigest
    hashes = np.fromiter((of(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), last.tolist())), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _BITS_AT_ONCE):
        part = hashes[at : at + _BITS_AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.add.reduce(np.unpackbits(part, axis=1, bitorder="little"), axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def with_fingerprint(
    df: DataFrame, text: str = "text", out: str = "fp", size: int = 3, keep: list[str] | None = None
) -> DataFrame:
    def make():
        return lambda texts: [[fingerprint(t, size) for t in texts]]

    return append_columns(df, [text], [T.StructField(out, T.LongType())], make, keep)


def _rotated(fp: str, by: F.Column) -> F.Column:
    bits = by * BLOCK
    turned = F.expr(f"shiftleft({fp}, turn * {BLOCK}) | shiftrightunsigned({fp}, 64 - turn * {BLOCK})")
    return F.when(bits == 0, F.col(fp)).otherwise(turned)


def _node(depth: int, column: str = "turned") -> F.Column:
    return F.shiftrightunsigned(column, 64 - depth) if depth < 64 else F.col(column)


def links(fingerprints: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Distinct ``fp`` to edges (a, b) that connect exactly what the links connect."""
    if budget >= 64 // BLOCK:
        raise ValueError(f"the four blocks find at most {64 // BLOCK - 1} differing bits")
    rows = (
        fingerprints.select("fp", F.explode(F.array(*[F.lit(i) for i in range(64 // BLOCK)])).alias("turn"))
        .select("turn", _rotated("fp", F.col("turn")).alias("turned"))
        .withColumn("node", _node(BLOCK))
    )
    crowded = stored(rows.groupBy("turn", "node").count().where(F.col("count") > NODE_ROWS), "crowded")
    units = [
        rows.join(crowded, ["turn", "node"], "left_anti")
        .select("turn", F.lit(BLOCK).alias("depth"), F.col("node").alias("a"), F.col("node").alias("b"),
                F.lit(0).alias("err"), F.lit(0).alias("side"), "turned")
    ]
    if not crowded.isEmpty():
        units += _split(stored(rows.join(crowded.select("turn", "node"), ["turn", "node"], "left_semi").drop("node"), "below"), crowded, budget)
    members = units[0]
    for more in units[1:]:
        members = members.unionByName(more)
    unit = ["turn", "depth", "a", "b"]
    dealt = members.repartition(*unit).sortWithinPartitions(*unit, "side", "turned")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _walk_all(batches, budget):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["a", "b"])

    return dealt.select("turn", "depth", "a", "b", "err", "side", "turned").mapInArrow(run, "a long, b long").distinct()


def _split(rows: DataFrame, crowded: DataFrame, budget: int) -> list[DataFrame]:
    """Members of the node pairs below crowded nodes, at the depth where both are small."""
    pairs = crowded.select("turn", F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0).alias("err"))
    out = []
    for depth in range(BLOCK + STEP, 65, STEP):
        sizes = rows.groupBy("turn", _node(depth).alias("node")).count().withColumn("up", F.expr(f"shiftrightunsigned(node, {STEP})"))
        left = sizes.select("turn", F.col("up").alias("a"), F.col("node").alias("a2"), F.col("count").alias("na"))
        right = sizes.select("turn", F.col("up").alias("b"), F.col("node").alias("b2"), F.col("count").alias("nb"))
        below = stored(
            pairs.join(left, ["turn", "a"]).join(right, ["turn", "b"])
            .withColumn("err", F.col("err") + F.bit_count(F.expr(f"(a2 ^ b2) & {(1 << STEP) - 1}")))
            .where((F.col("err") <= budget) & ((F.col("a") != F.col("b")) | (F.col("a2") <= F.col("b2"))))
            .select("turn", F.col("a2").alias("a"), F.col("b2").alias("b"), "err", F.greatest("na", "nb").alias("most")),
            "pairs",
        )
        small = F.lit(True) if depth == 64 else F.col("most") <= NODE_ROWS
        ready = below.where(small).select("turn", F.lit(depth).alias("depth"), "a", "b", "err")
        at = rows.withColumn("node", _node(depth))
        for side, name in ((0, "a"), (1, "b")):
            those = ready if side == 0 else ready.where("a != b")
            out.append(
                at.withColumnRenamed("node", name).join(those, ["turn", name])
                .select("turn", "depth", "a", "b", "err", F.lit(side).alias("side"), "turned")
            )
        pairs = below.where(~small).drop("most")
        if pairs.isEmpty():
            break
    return out


def _walk_all(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges from sorted unit members; whole units are walked together, a few at a time."""
    held: list[np.ndarray] = []
    for batch in batches:
        held.append(np.column_stack([np.asarray(c).astype(np.int64) for c in batch.columns]))
        if sum(map(len, held)) < 8 * NODE_ROWS:
            continue
        block = np.concatenate(held)
        differs = np.flatnonzero((block[1:, :4] != block[:-1, :4]).any(axis=1))
        if not len(differs):
            held = [block]
            continue
        held = [block[differs[-1] + 1 :]]
        yield from _walk_block(block[: differs[-1] + 1], budget)
    if held:
        yield from _walk_block(np.concatenate(held), budget)


def _walk_block(block: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    edge = np.flatnonzero((block[1:, :4] != block[:-1, :4]).any(axis=1)) + 1
    first = np.concatenate([[0], edge])
    stop = np.concatenate([edge, [len(block)]])
    side = np.concatenate([[0], np.cumsum(block[:, 5])])
    middle = stop - (side[stop] - side[first])
    self_pair = block[first, 2] == block[first, 3]
    work = np.where(self_pair, (stop - first) ** 2 // 2, (middle - first) * (stop - middle))
    useful = work > 0
    first, middle, stop, self_pair, work = (x[useful] for x in (first, middle, stop, self_pair, work))
    group = np.cumsum(work) // (NODE_ROWS * NODE_ROWS)
    for g in np.unique(group):
        i = group == g
        lo, hi = first[i].min(), stop[i].max()
        rows = block[lo:hi]
        a0, m, b1, own = first[i] - lo, middle[i] - lo, stop[i] - lo, self_pair[i]
        yield _reduce(rows, *_walk(
            rows[:, 6].view(np.uint64), rows[a0, 1],
            a0, m, np.where(own, a0, m), np.where(own, m, b1), rows[a0, 4], budget,
        ))


def _walk(keys, depth, la, ha, lb, hb, err, budget):
    """Index pairs within the budget, by walking pairs of trie nodes (row ranges) down."""
    found_a, found_b = [], []
    front = np.empty((5, 0), np.int64)
    waiting = np.stack([la, ha, lb, hb, err])
    for bit in range(int(depth.min()) if len(depth) else 64, 64):
        front = np.concatenate([front, waiting[:, depth == bit]], axis=1)
        small = (front[1] - front[0]) * (front[3] - front[2]) <= 64
        if small.any():
            _leaves(keys, front[:, small], found_a, found_b, budget)
            front = front[:, ~small]
        if not front.shape[1]:
            continue
        ones = np.concatenate([[0], np.cumsum((keys >> np.uint64(63 - bit)) & np.uint64(1)).astype(np.int64)])
        la, ha, lb, hb, err = front
        ma, mb = ha - (ones[ha] - ones[la]), hb - (ones[hb] - ones[lb])
        own = la == lb
        kids = [
            np.stack([la, ma, lb, mb, err]), np.stack([ma, ha, mb, hb, err]),
            np.stack([la, ma, mb, hb, err + 1]), np.stack([ma, ha, lb, mb, err + 1])[:, ~own],
        ]
        front = np.concatenate(kids, axis=1)
        front = front[:, (front[0] < front[1]) & (front[2] < front[3]) & (front[4] <= budget)]
    front = np.concatenate([front, waiting[:, depth == 64]], axis=1)
    _leaves(keys, front, found_a, found_b, budget)
    return np.concatenate(found_a), np.concatenate(found_b)


def _leaves(keys, front, found_a, found_b, budget) -> None:
    """Pairs of the last small nodes; the whole keys are compared once more."""
    la, ha, lb, hb, _ = front
    width = hb - lb
    n = (ha - la) * width
    which = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    a, b = la[which] + at // np.maximum(width[which], 1), lb[which] + at % np.maximum(width[which], 1)
    near = (a != b) & (np.bitwise_count(keys[a] ^ keys[b]) <= budget)
    found_a.append(a[near])
    found_b.append(b[near])


def _reduce(rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One edge to the first of its component for each linked row, as fingerprints."""
    label = np.arange(len(rows))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    at = np.flatnonzero(label != np.arange(len(rows)))
    bits = (rows[:, 0] * BLOCK).astype(np.uint64)
    keys = rows[:, 6].view(np.uint64)
    turned = np.where(bits == 0, keys, (keys >> bits) | (keys << (np.uint64(64) - np.maximum(bits, np.uint64(1)))))
    own = turned.view(np.int64)
    return own[at], own[label[at]]


def component_ids(marked: DataFrame, budget: int = BUDGET, key: str = "doc_id") -> DataFrame:
    """(key, fp) rows to (fp, component_id): the smallest key reachable over links."""
    least = stored(marked.groupBy("fp").agg(F.min(key).alias("least")), "fingerprints")
    roots = connected(links(least.select("fp"), budget))
    placed = least.join(roots, least.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return placed.join(smallest, "root").select("fp", "component_id")


def near_duplicates(documents: DataFrame, budget: int = BUDGET, size: int = 3) -> DataFrame:
    """(doc_id, fingerprint in hexadecimal, component_id) for every row."""
    marked = stored(with_fingerprint(documents, size=size, keep=["doc_id"]), "marked")
    return marked.join(component_ids(marked, budget), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def deduplicate(documents: DataFrame, budget: int = BUDGET, size: int = 3) -> DataFrame:
    """One row of each component: its smallest doc_id, then the smallest text hash.

    NULL ids come last. Rows that agree in id and text are one document.
    """
    texted = documents.withColumn("__h", F.xxhash64("text"))
    marked = stored(with_fingerprint(texted, size=size, keep=["doc_id", "__h"]), "marked")
    order = F.struct(F.isnull("doc_id").alias("missing"), "doc_id", "__h")
    best = marked.withColumn("own", order).groupBy("fp").agg(F.min("own").alias("own"))
    best = stored(best, "best")
    roots = connected(links(best.select("fp"), budget))
    kept = (
        best.join(roots, best.fp == roots.node, "left")
        .groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("own").alias("own"))
        .select(F.col("own.doc_id").alias("__id"), F.col("own.__h").alias("__kh"))
    )
    rows = texted.dropDuplicates(["doc_id", "__h"])
    same = rows["doc_id"].eqNullSafe(kept["__id"]) & (rows["__h"] == kept["__kh"])
    return rows.join(kept, same, "left_semi").select(*[F.col(f"`{c}`") for c in documents.columns])
