"""Removal of lines that many sites share, by distinct-site sketches.

A line is compared without its outer spaces. For each line hash a HyperLogLog sketch
counts the sites it occurs on; sketches merge on the map side and once more in the
shuffle, so a line that a third of all documents carry costs one row in each task.
Lines clearly over or under the threshold are settled by the sketch; those within
its error band get an exact distinct count. A line on ``min_sites`` sites or more is
boilerplate: all its occurrences go but the first (smallest ``doc_id``, then text,
then position), so that no passage is lost from the corpus altogether.

Blank lines stay and are never counted. A NULL text stays NULL and has no lines; a
NULL site counts for no line; a NULL ``doc_id`` sorts first. Rows that agree in id
and text are one document and are treated alike. No row is dropped: a document whose
lines all go has an empty text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ..sources.scratch import stored
from .arrow import append_columns

MIN_SITES = 10
#: The sketch has 2 ** LG_K registers; its relative standard error is 1.04 / 2 ** (LG_K / 2).
LG_K = 12
#: Standard errors on either side of the threshold within which lines are counted exactly.
BAND = 4.0

_KEY = ["h1", "h2"]


def _lines(documents: DataFrame, site: str) -> DataFrame:
    """One row for each line that is not blank, by a 96-bit hash of its text."""
    split = documents.select(
        "doc_id", F.xxhash64("text").alias("h"), F.col(f"`{site}`").cast("string").alias("site"),
        F.posexplode(F.split("text", "\n")).alias("pos", "line"),
    )
    bare = F.trim("line")
    return split.where(bare != "").select(
        "doc_id", "h", "site", "pos", F.xxhash64(bare).alias("h1"), F.hash(bare, F.lit("line")).alias("h2")
    )


def boilerplate(documents: DataFrame, min_sites: int = MIN_SITES, site: str = "source", lg_k: int = LG_K) -> DataFrame:
    """(h1, h2, first) of each line on ``min_sites`` sites or more; ``first`` is the occurrence that stays."""
    lines = _lines(documents, site)
    spread = lines.groupBy(*_KEY).agg(
        F.hll_sketch_agg("site", lg_k).alias("sites"),
        F.min(F.struct("doc_id", "h", "pos")).alias("first"),
    )
    margin = BAND * 1.04 / 2 ** (lg_k / 2)
    likely = stored(
        spread.select(*_KEY, "first", F.hll_sketch_estimate("sites").alias("estimate"))
        .where(F.col("estimate") >= min_sites * (1 - margin) - 1),
        "likely",
    )
    near = likely.where(F.col("estimate") <= min_sites * (1 + margin) + 1)
    counted = (
        lines.join(near.select(*_KEY), _KEY, "left_semi").where("site is not null")
        .select(*_KEY, "site").distinct().groupBy(*_KEY).count().where(F.col("count") >= min_sites)
    )
    clear = likely.where(F.col("estimate") > min_sites * (1 + margin) + 1)
    return clear.select(*_KEY, "first").unionByName(near.join(counted.select(*_KEY), _KEY).select(*_KEY, "first"))


def remove_boilerplate(
    documents: DataFrame, min_sites: int = MIN_SITES, site: str = "source", lg_k: int = LG_K,
    counts: bool = True, keep: list[str] | None = None,
) -> DataFrame:
    """The rows with ``text`` cleaned; with ``counts`` also n_lines and n_removed (long)."""
    keep = keep or documents.columns
    shared = stored(boilerplate(documents, min_sites, site, lg_k), "boilerplate")
    gone = (
        _lines(documents, site).join(shared, _KEY)
        .where(~F.struct("doc_id", "h", "pos").eqNullSafe(F.col("first")))
        .groupBy(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).agg(F.collect_set("pos").alias("__gone"))
    )
    rows = documents.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, "doc_id", "text"])])
    joined = rows.join(
        gone, rows["doc_id"].eqNullSafe(gone["__id"]) & (F.xxhash64(rows["text"]) == gone["__h"]), "left"
    ).drop("__id", "__h")

    def make():
        def work(texts, removed):
            cleaned, n_lines, n_removed = [], [], []
            for text, gone in zip(texts, removed):
                lines = [] if text is None else text.split("\n")
                n_lines.append(len(lines))
                n_removed.append(len(gone or ()))
                if gone:
                    gone = set(gone)
                    text = "\n".join(x for i, x in enumerate(lines) if i not in gone)
                cleaned.append(text)
            return (cleaned, n_lines, n_removed) if counts else (cleaned,)

        return work

    new = [T.StructField("text", T.StringType())]
    if counts:
        new += [T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())]
    out = append_columns(joined, ["text", "__gone"], new, make, [c for c in keep if c != "text"])
    fresh = [f.name for f in new if f.name != "text"]
    return out.select(*[f"`{c}`" for c in keep if c.lower() not in fresh], *fresh)


SQL = f"""
WITH pieces AS (
  SELECT doc_id, source, text, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL
), lines AS (
  SELECT doc_id, source, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM pieces
), shared AS (
  SELECT trim(line) AS bare, min((doc_id, pos)) AS keep_at FROM lines WHERE trim(line) <> ''
  GROUP BY 1 HAVING count(DISTINCT source) >= {MIN_SITES}
), marked AS (
  SELECT l.doc_id, l.line, l.pos, s.bare IS NOT NULL AND (l.doc_id, l.pos) <> s.keep_at AS gone
  FROM lines l LEFT JOIN shared s ON trim(l.line) = s.bare
)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text,
  count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed
FROM marked GROUP BY doc_id
UNION ALL SELECT doc_id, NULL, 0, 0 FROM documents WHERE text IS NULL
"""
