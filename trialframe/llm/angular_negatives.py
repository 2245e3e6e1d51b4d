"""Hard negatives by angular triangle filtering and integer scores.

Vectors become integers, ``floor(scale * x)``, and the score of two is their inner product.
Each row stores its norm and its angles to a few reference directions. By the triangle
inequality on the sphere the angle between two rows lies between the largest difference
and the least sum of their angles to a reference; its cosine times both norms bounds the
score. Bounds are widened by more than rounding can do, so no row is lost. Only rows whose
interval of scores meets a window asked for are scored, exactly, in integers.

Rows lie in cells by nearest reference. A cell keeps the range of its angles and norms, so
an anchor is sent to the cells only that its windows meet. A cell is cut into blocks of
about ``block_rows`` by a hash of the id: a cell with a third of all rows is many tasks'
work. A task holds one block and reads the anchors sent to it as a stream.

Three passes: an anchor's own block gives a first bound for its positives; its positives
are then found over all cells above that bound; last its negatives, in the windows that
the positives give. Each block hands on its best few, which are ranked in Spark.

Rows with a NULL id or label, a NULL vector, or a NULL or non-finite component take no
part; nor do rows whose integer vector is longer than 2^31, since scores might not fit 64
bits. Rows that repeat an id are one row: the least vector, then label. A row
competes with rows of its own number of components only. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..sources.scratch import stored

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
#: Hundredths of the positive's score between which a negative's score must lie.
LOW, HIGH = 50, 95
REFERENCES = 8
#: Vectors among which references are picked, at most.
SAMPLE = 4096
BLOCK_ROWS = 8192
MAX_NORM = float(2**31)
_AT_ONCE = 64
_LEAST, _MOST = -(2**63), 2**63 - 1
_CELL = ["dim", "cell"]
_BLOCK = [*_CELL, "salt"]
_WINDOWS = "array<struct<key: long, score: long, low: long, high: long>>"


def clean(vectors: DataFrame, key: str, vector: str, label: str, scale: float = SCALE) -> DataFrame:
    """(id, label, dim, v) of the rows that take part, each id once."""
    scaled = F.transform(F.col(f"`{vector}`").cast("array<double>"), lambda x: x * F.lit(float(scale)))
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    squared = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    rows = vectors.select(
        F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), scaled.alias("v"))
    usable = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).where(finite)
    whole = usable.where(F.sqrt(squared) < MAX_NORM - 2**20).select(
        "id", F.struct(F.transform("v", lambda x: F.floor(x).cast("int")).alias("v"), "label").alias("own"))
    return whole.groupBy("id").agg(F.min("own").alias("own")).select(
        "id", "own.label", F.size("own.v").alias("dim"), "own.v")


def references(rows: DataFrame, count: int, sample: int) -> dict[int, np.ndarray]:
    """Unit vectors far from each other, up to ``count`` for each number of components.

    Picked among the rows with the least hashes of their vectors, ``sample`` at most.
    """
    hashed = rows.where(F.exists("v", lambda x: x != 0)).withColumn("h", F.xxhash64("v"))
    n = hashed.count()
    share = min(1.0, 1.2 * sample / max(n, 1))
    few = hashed.where(F.pmod("h", F.lit(1 << 30)) <= int(share * (1 << 30)))
    of: dict[int, list] = {}
    for r in few.orderBy("h", "id").limit(sample).select("dim", "v").collect():
        of.setdefault(r.dim, []).append(r.v)
    out = {}
    for dim, found in of.items():
        x = np.array(found, float)
        x /= np.sqrt((x * x).sum(axis=1))[:, None]
        picked = [int(np.argmax(x @ x.sum(axis=0)))]
        nearest = x @ x[picked[0]]
        while len(picked) < min(count, len(x)):
            far = int(np.argmin(nearest))
            if nearest[far] > 1 - 1e-9:
                break
            picked.append(far)
            nearest = np.maximum(nearest, x @ x[far])
        out[dim] = x[picked]
    return out


def slack(dim: int) -> float:
    """More than an angle of two vectors can be wrong by, and than a sum of two such angles."""
    return 4 * float(np.sqrt((dim + 8) * 2.3e-16)) + 1e-9


def _unit_angles(x: np.ndarray, norm: np.ndarray, refs: np.ndarray) -> np.ndarray:
    cosine = x @ refs.T / np.where(norm > 0, norm, 1.0)[:, None]
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def measured(rows: DataFrame, refs: dict[int, np.ndarray]) -> DataFrame:
    """Append the norm, the angles to the references, and the cell: the nearest one, -1 without any."""
    schema = T.StructType([*rows.schema, *T.StructType.fromDDL("norm double, angles array<double>, cell int")])
    at = rows.columns.index("dim"), rows.columns.index("v")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            dims = np.asarray(batch.column(at[0]))
            order = np.argsort(dims, kind="stable")
            batch, dims = batch.take(pa.array(order)), dims[order]
            for start, end in _runs([dims]):
                part = batch.slice(start, end - start)
                x = _matrix(part.column(at[1])).astype(float)
                norm = np.sqrt((x * x).sum(axis=1))
                toward = refs.get(int(dims[start]))
                angles = np.zeros((len(x), 0)) if toward is None else _unit_angles(x, norm, toward)
                cell = angles.argmin(axis=1) if angles.shape[1] else np.full(len(x), -1)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(norm), _lists(angles), pa.array(cell, pa.int32())],
                    names=[*part.schema.names, "norm", "angles", "cell"])

    return rows.mapInArrow(run, schema)


def _runs(keys: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Bounds of the stretches in which all keys stay the same."""
    n = len(keys[0])
    if n:
        change = np.zeros(n - 1, bool)
        for k in keys:
            change |= k[1:] != k[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), n]
        yield from zip(cuts[:-1], cuts[1:])


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten())
    return flat.reshape(len(column), len(flat) // max(len(column), 1))


def _lists(x: np.ndarray) -> pa.Array:
    ends = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel()))


def cells(rows: DataFrame, block_rows: int, count: int) -> DataFrame:
    """For each cell the number of its blocks and the ranges of norms and angles."""
    each = [F.get("angles", F.lit(j)) for j in range(count)]
    return rows.groupBy(*_CELL).agg(
        F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("long").alias("blocks"),
        F.min("norm").alias("norm_low"), F.max("norm").alias("norm_high"),
        F.array_compact(F.array(*[F.min(a) for a in each])).alias("angle_low"),
        F.array_compact(F.array(*[F.max(a) for a in each])).alias("angle_high"),
    )


class _Block:
    """Rows of one block as arrays, and the exact scores of those an anchor may want."""

    def __init__(self, parts: list[pa.RecordBatch]):
        whole = pa.Table.from_batches(parts).combine_chunks()
        column = {n: whole.column(n).combine_chunks() for n in ("id", "label", "v", "norm", "angles")}
        self.ids, self.labels, self.norm = (np.asarray(column[c]) for c in ("id", "label", "norm"))
        order = np.argsort(self.ids, kind="stable")
        self.ids, self.labels, self.norm = self.ids[order], self.labels[order], self.norm[order]
        self.x, self.angles = _matrix(column["v"])[order], _matrix(column["angles"])[order]
        # float sums are exact whole numbers as long as no partial sum passes 2^53
        self.reach = float(self.norm.max(initial=0.0))
        self.wide = self.x.astype(float)

    def bounds(self, angles: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lowest and highest possible score of each anchor with each row."""
        apart = np.zeros((len(norm), len(self.norm)))
        reach = np.full(apart.shape, np.pi)
        for j in range(self.angles.shape[1]):
            a, b = angles[:, j, None], self.angles[None, :, j]
            np.maximum(apart, np.abs(a - b), out=apart)
            total = a + b
            np.minimum(reach, np.minimum(total, 2 * np.pi - total), out=reach)
        err = slack(self.x.shape[1])
        size = norm[:, None] * self.norm[None, :]
        margin = size * 1e-9 + 1
        low = size * np.cos(np.minimum(reach + err, np.pi)) - margin
        return low, size * np.cos(np.maximum(apart - err, 0.0)) + margin

    def scores(self, at: np.ndarray, anchor: np.ndarray, norm: float) -> np.ndarray:
        if norm * self.reach < 2.0**52:
            rows = self.wide if len(at) == len(self.wide) else self.wide[at]
            return (rows @ anchor.astype(float)).astype(np.int64)
        return self.x[at].astype(np.int64) @ anchor.astype(np.int64)


def _matched(block: _Block, anchors: pa.RecordBatch, same: bool, top: int) -> Iterator[pa.RecordBatch]:
    get = {n: anchors.column(n) for n in ("id", "label", "v", "norm", "angles", "windows")}
    ids, labels, norm = (np.asarray(get[c]) for c in ("id", "label", "norm"))
    x, angles, windows = _matrix(get["v"]), _matrix(get["angles"]), get["windows"].to_pylist()
    out: list[tuple] = []
    for start in range(0, len(ids), _AT_ONCE):
        part = slice(start, start + _AT_ONCE)
        low, high = block.bounds(angles[part], norm[part])
        for i, (lo, hi) in enumerate(zip(low, high), start):
            fits = (block.labels == labels[i]) == same
            meets = np.zeros(len(fits), bool)
            for w in windows[i]:
                meets |= (hi >= w["low"]) & (lo <= w["high"])
            at = np.flatnonzero(fits & meets & (block.ids != ids[i]))
            if not len(at):
                continue
            scores = block.scores(at, x[i], float(norm[i]))
            for w in windows[i]:
                inside = np.flatnonzero((scores >= w["low"]) & (scores <= w["high"]))
                if len(inside) > top:  # every score above the last place, and all that tie with it
                    least = np.partition(scores[inside], len(inside) - top)[len(inside) - top]
                    inside = inside[scores[inside] >= least]
                best = inside[np.lexsort((block.ids[at[inside]], -scores[inside]))[:top]]
                out += [(int(ids[i]), w["key"], w["score"], int(block.ids[at[k]]), int(scores[k])) for k in best]
    names = ["anchor", "key", "key_score", "id", "score"]
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(5)], names=names)


def _scan(rows: DataFrame, anchors: DataFrame, same: bool, top: int) -> DataFrame:
    """(anchor, key, key_score, id, score, rank): the best ``top`` rows in each window of each anchor.

    Both sides carry their block; an anchor is there once for each block that it is sent to.
    """
    columns = [*_BLOCK, "kind", "id", "label", "v", "norm", "angles", "windows"]
    both = rows.withColumns({"kind": F.lit(0), "windows": F.lit(None).cast(_WINDOWS)}).select(columns).unionByName(
        anchors.withColumn("kind", F.lit(1)).select(columns))
    # a fixed number, since run-time coalescing goes by bytes, and the work is per pair
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        block, held, packed = None, [], None
        for batch in batches:
            keys = [np.asarray(batch.column(i)) for i in range(4)]
            for start, end in _runs(keys):
                here, part = tuple(int(k[start]) for k in keys[:3]), batch.slice(start, end - start)
                if keys[3][start] == 0:
                    if here != block:
                        block, held, packed = here, [], None
                    held.append(part)
                elif here == block:
                    packed = packed or _Block(held)
                    yield from _matched(packed, part, same, top)

    found = both.repartition(parts, *_BLOCK).sortWithinPartitions(*_BLOCK, "kind").mapInArrow(
        run, "anchor long, key long, key_score long, id long, score long")
    order = Window.partitionBy("anchor", "key").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _reaches(wanted: Column) -> Column:
    """Whether a cell next to an anchor may hold a score in a window: its own bounds against them."""
    ends = F.zip_with("angle_low", "angle_high", lambda a, b: F.struct(a.alias("low"), b.alias("high")))
    each = F.zip_with("angles", ends, lambda a, e: F.struct(a.alias("own"), e["low"].alias("low"), e["high"].alias("high")))
    gap = F.transform(each, lambda e: F.greatest(e["own"] - e["high"], e["low"] - e["own"]))
    apart = F.aggregate(gap, F.lit(0.0), lambda a, g: F.greatest(a, g))

    def widest(e):
        first, last = e["own"] + e["low"], e["own"] + e["high"]
        bend = F.when((first <= np.pi) & (last >= np.pi), np.pi)
        return F.coalesce(bend, F.greatest(F.least(first, 2 * np.pi - first), F.least(last, 2 * np.pi - last)))

    reach = F.aggregate(F.transform(each, widest), F.lit(float(np.pi)), lambda a, g: F.least(a, g))
    err = 4 * F.sqrt((F.col("dim") + 8) * 2.3e-16) + 1e-9
    far, near = F.cos(F.least(reach + err, F.lit(float(np.pi)))), F.cos(F.greatest(apart - err, F.lit(0.0)))
    big, small = F.col("norm") * F.col("norm_high"), F.col("norm") * F.col("norm_low")
    high = F.greatest(big * near, small * near) + big * 1e-9 + 1
    low = F.least(big * far, small * far) - big * 1e-9 - 1
    return F.exists(wanted, lambda w: (high >= w["low"]) & (low <= w["high"]))


def _sent(anchors: DataFrame, ranges: DataFrame) -> DataFrame:
    """Each anchor once for every block of every cell that one of its windows meets."""
    near = anchors.drop("cell", "blocks", "salt").join(ranges, "dim").where(_reaches(F.col("windows")))
    return near.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))


def mine(
    vectors: DataFrame, anchors: str, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
    scale: float = SCALE, block_rows: int = BLOCK_ROWS, count: int = REFERENCES, sample: int = SAMPLE,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors`` is a SQL condition on ``id``. An anchor's positives are its best ``positives``
    other rows of its label; for each, the first ``negatives`` rows of other labels whose score
    lies between ``low`` and ``high`` hundredths of the positive's.
    """
    rows = stored(clean(vectors, key, vector, label, scale), "vectors")
    refs = references(rows, count, sample)
    rows = stored(measured(rows, refs), "measured")
    ranges = stored(cells(rows, block_rows, count), "cells")
    placed = rows.join(ranges.select(*_CELL, "blocks"), _CELL).withColumn("salt", F.pmod(F.xxhash64("id"), F.col("blocks")))
    chosen = rows.where(anchors)

    def windowed(df: DataFrame, floor: Column) -> DataFrame:
        one = F.struct(F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("score"),
                       floor.cast("long").alias("low"), F.lit(_MOST).cast("long").alias("high"))
        return df.withColumn("windows", F.array(one).cast(_WINDOWS))

    own = windowed(placed.where(anchors), F.lit(_LEAST))
    first = _scan(placed, own, True, positives).groupBy("anchor").agg(
        F.when(F.count(F.lit(1)) == positives, F.min("score")).alias("floor"))
    floors = stored(first.withColumnRenamed("anchor", "id"), "floors")
    bounded = windowed(chosen.join(floors, "id", "left"), F.coalesce("floor", F.lit(_LEAST))).drop("floor")
    best = stored(_scan(placed, _sent(bounded, ranges), True, positives).select("anchor", "id", "score"), "positives")
    # scores p of 0 or more have a window: from low hundredths of p, rounded up, to high hundredths, rounded down
    hundreds = F.expr("score div 100")
    window = F.struct(
        F.col("id").alias("key"), "score",
        (hundreds * low + F.expr(f"(score % 100 * {low} + 99) div 100")).alias("low"),
        (hundreds * high + F.expr(f"(score % 100 * {high}) div 100")).alias("high"))
    wanted = best.where("score >= 0").groupBy("anchor").agg(F.collect_list(window).cast(_WINDOWS).alias("windows"))
    asked = chosen.join(wanted, chosen["id"] == wanted["anchor"]).drop("anchor")
    found = _scan(placed, _sent(asked, ranges), False, negatives)
    return found.select(
        F.col("anchor").alias("anchor_id"), F.col("key").alias("positive_id"), "rank",
        F.col("id").alias("negative_id"), F.col("key_score").alias("positive_score"), F.col("score").alias("negative_score"))


SQL = f"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}
)
SELECT anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= {NEGATIVES}
"""
