"""URL verdicts by host rules and by trust spread over the link graph.

Rules (host, path) fit a host and its subdomains where the URL's path starts with
the rule's; the longest wins. They are part of the program, a short list. For URLs
no rule fits, the host decides: personalised PageRank spreads trust from hosts with
allowed pages along links, and distrust from hosts blocked as a whole against them
(who links to a blocked host is distrusted). A host is blocked where its distrust
exceeds its trust times ``tolerance``; a host that neither reaches is allowed.

Edges are links between different hosts, weighted by their number, aggregated before
the walk. A step joins ranks to edges by host and sums; mass at hosts without links
returns to the seeds. Ranks are written after each step, which cuts the lineage.

A NULL URL, or one without ``://``, has an empty host and path and is allowed unless a
rule fits; it takes no part in the graph. Repeated rows count repeatedly. NULL or
empty HTML has no links.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, functions as F

from ..sources.scratch import drop_path, fresh_path, stored

#: The rules of the test tables, as (verdict, host, path).
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
DAMPING = 0.85
TOLERANCE = 1.0
#: The walk ends once no more than this share of all mass moves, or raises after MAX_STEPS.
SETTLED = 1e-6
MAX_STEPS = 100

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]*)"""


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits, else NULLs; of two as long, the first given."""
    text = verdict = None
    for decision, name, start in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        text = F.when(fits, name + start) if text is None else text.when(fits, name + start)
        verdict = F.when(fits, decision) if verdict is None else verdict.when(fits, decision)
    none = F.lit(None).cast("string")
    return (none, none) if text is None else (text, verdict)


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, links) between different hosts, from the pages' anchors."""
    links = pages.select(
        host_of(F.col("url")).alias("src"), F.explode(F.expr(f"regexp_extract_all(html, r'{_sql(_LINK)}', 1)")).alias("href")
    )
    full = F.when(F.col("href").startswith("//"), F.concat(F.lit("http:"), "href")).otherwise(F.col("href"))
    return (
        links.select("src", host_of(full).alias("dst")).where("src != '' and dst != '' and src != dst")
        .groupBy("src", "dst").agg(F.count("*").alias("links"))
    )


def _sql(pattern: str) -> str:
    return pattern.replace("'", "\\x27")


def spread(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING) -> DataFrame:
    """Personalised PageRank: edges (src, dst, share), seeds (host, seed) that sum to 1, to (host, rank)."""
    spark = edges.sparkSession
    ranks, old = seeds.select("host", F.col("seed").alias("rank")), None
    for _ in range(MAX_STEPS):
        moved = (
            ranks.join(edges, ranks.host == edges.src).groupBy(F.col("dst").alias("host"))
            .agg(F.sum(F.col("rank") * F.col("share")).alias("moved"))
        )
        lost = 1.0 - (moved.agg(F.sum("moved")).first()[0] or 0.0)
        given = seeds.select("host", (F.col("seed") * ((1 - damping) + damping * lost)).alias("rank"))
        arrived = moved.select("host", (F.col("moved") * damping).alias("rank"))
        path = fresh_path(spark, "ranks")
        (
            given.unionByName(arrived).withColumn("was", F.lit(0.0))
            .unionByName(ranks.select("host", F.lit(0.0).alias("rank"), F.col("rank").alias("was")))
            .groupBy("host").agg(F.sum("rank").alias("rank"), F.sum("was").alias("was")).write.parquet(path)
        )
        new = spark.read.parquet(path)
        change = new.agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0] or 0.0
        if old:
            drop_path(spark, old)
        ranks, old = new.select("host", "rank"), path
        if change <= SETTLED:
            return ranks
    raise RuntimeError("trust did not settle")


def _shares(edges: DataFrame) -> DataFrame:
    total = edges.groupBy("src").agg(F.sum("links").alias("total"))
    return stored(edges.join(total, "src").select("src", "dst", (F.col("links") / F.col("total")).alias("share")), "shares")


def _seeds(counts: DataFrame) -> DataFrame:
    total = counts.agg(F.sum("n")).first()[0] or 1
    return counts.select("host", (F.col("n") / F.lit(float(total))).alias("seed"))


def verdicts(pages: DataFrame, rules=RULES, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """page_id, host, path, rule, verdict of every row, and trust and distrust of its host."""
    rules = list(rules)
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    text, decision = rule_of(F.col("host"), F.col("path"), rules)
    judged = parsed.withColumns({"rule": text, "decided": decision})
    by_host = stored(
        judged.where("host != ''").groupBy("host").agg(
            F.count("*").alias("pages"), F.count_if(F.col("decided") == "allow").alias("allowed")
        ), "hosts",
    )
    edges = stored(host_edges(pages), "edges")
    # a linked host without pages can be a blocked seed as well
    known = by_host.select("host").unionByName(edges.select(F.col("dst").alias("host"))).distinct()
    whole = rule_of(F.col("host"), F.lit("/"), rules)[1]
    trusted = stored(_seeds(by_host.where("allowed > 0").select("host", F.col("allowed").alias("n"))), "trusted")
    blocked = stored(_seeds(known.where(whole == "block").select("host", F.lit(1).alias("n"))), "blocked")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "links")
    trust = spread(_shares(edges), trusted, damping).withColumnRenamed("rank", "trust")
    distrust = spread(_shares(back), blocked, damping).withColumnRenamed("rank", "distrust")
    scores = stored(trust.join(distrust, "host", "full").na.fill(0.0, ["trust", "distrust"]), "trust")
    joined = judged.join(scores, "host", "left").na.fill(0.0, ["trust", "distrust"])
    method = F.when(F.col("distrust") > F.col("trust") * tolerance, "block").otherwise("allow")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("decided", method).alias("verdict"), "trust", "distrust")


def allowed_pages(pages: DataFrame, **options) -> DataFrame:
    """The rows whose page_id is allowed (repeated ids: if none of them is blocked)."""
    blocked = verdicts(pages, **options).where("verdict = 'block'").select(F.col("page_id").alias("__id")).distinct()
    return pages.join(blocked, pages["page_id"].eqNullSafe(blocked["__id"]), "left_anti")
