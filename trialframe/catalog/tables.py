"""Joins, aggregates, windows, sorts, unions and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import coding, missing
from ..operators import aggregates, joins, medians, reshape, standardize, windows
from ..sources import scratch
from .registry import null_if, query, rounded, table

# ---------------------------------------------------------------- joins

_FLAGGED = """SELECT l_orderkey, l_linenumber, l_quantity, nullif(l_returnflag, 'R') AS flag,
                     l_linestatus AS status, 2021 AS year
              FROM lineitem"""


def _flagged(spark, folder):
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity",
        null_if(F.col("l_returnflag"), "R").alias("flag"),
        F.col("l_linestatus").alias("status"), F.lit(2021).alias("year"),
    )


_MULTI_KEY = f"""
    WITH l AS ({_FLAGGED}),
         r AS (SELECT flag, status, year, CAST(sum(l_quantity) AS DOUBLE) AS total FROM l
               WHERE status = 'F' GROUP BY flag, status, year)
    SELECT l.*, r.total
    FROM l LEFT JOIN r ON l.flag IS NOT DISTINCT FROM r.flag
        AND l.status IS NOT DISTINCT FROM r.status AND l.year IS NOT DISTINCT FROM r.year"""


def _multi_key(spark, folder, salt):
    left = _flagged(spark, folder)
    keys = ["flag", "status", "year"]
    right = left.filter(F.col("status") == "F").groupBy(*keys).agg(
        F.sum("l_quantity").alias("total")
    )
    if not salt:
        right = scratch.stored(right, "totals")  # of known size, so it can be broadcast
    return joins.left_join(left, right, keys, salt)


@query("join_left_multi_key", _MULTI_KEY)
def join_left_multi_key(spark, folder):
    return _multi_key(spark, folder, None)


@query("join_left_salted", _MULTI_KEY)
def join_left_salted(spark, folder):
    return _multi_key(spark, folder, 8)


@query("join_left_one_to_many", """
    SELECT c_custkey, c_name, o_orderkey, o_totalprice
    FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F'""")
def join_left_one_to_many(spark, folder):
    customers = table(spark, folder, "customer").select(
        "c_custkey", "c_name", F.lit("F").alias("status")
    )
    orders = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("status"),
        "o_orderkey", "o_totalprice",
    )
    return joins.left_join(customers, orders, ["c_custkey", "status"]).drop("status")


@query("join_left_four_key", """
    WITH l AS (SELECT o_orderkey, o_orderstatus AS status, o_orderpriority AS priority,
                      CAST(o_custkey AS DOUBLE) AS point,
                      CAST(year(o_orderdate) AS INTEGER) AS year, o_totalprice
               FROM orders),
         r AS (SELECT status, priority, point, year, max(o_totalprice) AS top
               FROM l WHERE status <> 'P' GROUP BY ALL)
    SELECT l.*, r.top
    FROM l LEFT JOIN r USING (status, priority, point, year)""")
def join_left_four_key(spark, folder):
    left = table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_custkey").cast("double").alias("point"),
        F.year("o_orderdate").alias("year"), "o_totalprice",
    )
    keys = ["status", "priority", "point", "year"]
    right = left.filter(F.col("status") != "P").groupBy(*keys).agg(
        F.max("o_totalprice").alias("top")
    )
    return joins.left_join(left, right, keys)


@query("join_dictionary", """
    WITH d AS (SELECT DISTINCT p_type, 'type ' || p_type AS accepted FROM part
               WHERE p_type <> 'ECONOMY')
    SELECT p_partkey, coalesce(d.accepted, p_name) AS species
    FROM part LEFT JOIN d ON part.p_type = d.p_type""")
def join_dictionary(spark, folder):
    part = table(spark, folder, "part").select("p_partkey", "p_name", "p_type")
    dictionary = part.filter(F.col("p_type") != "ECONOMY").select(
        F.col("p_type").alias("old"), F.concat(F.lit("type "), "p_type").alias("accepted")
    )
    out = joins.correct_by_dictionary(part, "p_type", dictionary, "old", "accepted")
    return out.select("p_partkey", F.coalesce("accepted", "p_name").alias("species"))


@query("join_class_lookup", """
    SELECT l_orderkey, l_linenumber, nullif(l_returnflag, 'R') AS flag,
           CASE WHEN l_returnflag = 'A'
                THEN (SELECT r_regionkey FROM region WHERE r_name = 'ASIA')
                ELSE (SELECT r_regionkey FROM region WHERE r_name = 'EUROPE') END AS site_value
    FROM lineitem""")
def join_class_lookup(spark, folder):
    rows = _flagged(spark, folder).select("l_orderkey", "l_linenumber", "flag")
    return joins.class_lookup(
        rows, "flag", ["A"], table(spark, folder, "region"), "r_name", "ASIA", "EUROPE",
        {"site_value": "r_regionkey"},
    )


# ---------------------------------------------------------------- aggregates

# Low values stand for missing measurements.
_EVENTS = """SELECT event_id, user_id, event_type, CASE WHEN value >= 5 THEN value END AS value
             FROM events"""


def _events(spark, folder):
    return table(spark, folder, "events").select(
        "event_id", "user_id", "event_type",
        F.when(F.col("value") >= 5, F.col("value")).alias("value"),
    )


@query("agg_group_mean", f"""
    SELECT user_id, event_type, round(avg(value), 9) AS value FROM ({_EVENTS}) GROUP BY ALL""")
def agg_group_mean(spark, folder):
    out = aggregates.group_means(_events(spark, folder), ["user_id", "event_type"], ["value"])
    return rounded(out, 9, "value")


@query("agg_centroid", f"""
    SELECT user_id, event_type,
           CASE WHEN count(*) = count(value) THEN round(avg(value), 9) END AS mean_value
    FROM ({_EVENTS}) GROUP BY ALL""")
def agg_centroid(spark, folder):
    out = aggregates.centroids(_events(spark, folder), ["user_id", "event_type"], ["value"])
    return rounded(out, 9, "mean_value")


@query("agg_group_median", """
    SELECT l_returnflag, l_linestatus, round(median(quantity), 5) AS quantity,
           round(median(l_extendedprice), 5) AS price
    FROM (SELECT *, CASE WHEN l_tax > 0 THEN l_quantity END AS quantity FROM lineitem)
    GROUP BY ALL""")
def agg_group_median(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        "l_returnflag", "l_linestatus", F.col("l_extendedprice").alias("price"),
        F.when(F.col("l_tax") > 0, F.col("l_quantity")).alias("quantity"),
    )
    out = medians.group_median(rows, ["l_returnflag", "l_linestatus"], ["quantity", "price"])
    return rounded(out, 5, "quantity", "price")


@query("agg_group_median_small", f"""
    SELECT user_id, round(median(value), 9) AS value FROM ({_EVENTS}) GROUP BY ALL""")
def agg_group_median_small(spark, folder):
    out = medians.group_median(
        _events(spark, folder), ["user_id"], ["value"], small_groups=True
    )
    return rounded(out, 9, "value")


@query("agg_median_strict", f"""
    SELECT user_id, event_type,
           CASE WHEN count(*) = count(value) THEN round(median(value), 9) END AS value
    FROM ({_EVENTS}) GROUP BY ALL""")
def agg_median_strict(spark, folder):
    out = medians.group_median(
        _events(spark, folder), ["user_id", "event_type"], ["value"], strict=True
    )
    return rounded(out, 9, "value")


@query("agg_sum_strict", f"""
    SELECT user_id, event_type,
           CASE WHEN count(*) = count(value) THEN round(sum(value), 2) END AS total
    FROM ({_EVENTS}) GROUP BY ALL""")
def agg_sum_strict(spark, folder):
    return _events(spark, folder).groupBy("user_id", "event_type").agg(
        F.round(missing.strict_sum(F.col("value")), 2).alias("total")
    )


@query("agg_group_share", """
    SELECT o_orderpriority, round_even(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM orders), 0)
           AS n
    FROM orders GROUP BY ALL""")
def agg_group_share(spark, folder):
    return aggregates.group_share(table(spark, folder, "orders"), ["o_orderpriority"])


@query("agg_missing_profile", f"""
    SELECT event_type,
           round_even(count(*) FILTER (value IS NULL) / count(*)::DOUBLE * 100, 1) AS value,
           round_even(0.0::DOUBLE, 1) AS user_id
    FROM ({_EVENTS}) GROUP BY ALL""")
def agg_missing_profile(spark, folder):
    return aggregates.missing_profile(
        _events(spark, folder), ["event_type"], ["value", "user_id"]
    )


@query("agg_missing_profile_fixed", f"""
    SELECT event_type,
           round_even(count(*) FILTER (value IS NULL) / 290.0::DOUBLE * 100, 1) AS value
    FROM ({_EVENTS}) GROUP BY ALL""")
def agg_missing_profile_fixed(spark, folder):
    return aggregates.missing_profile(
        _events(spark, folder), ["event_type"], ["value"], out_of=290.0
    )


@query("agg_distinct", f"SELECT DISTINCT flag FROM ({_FLAGGED})")
def agg_distinct(spark, folder):
    return _flagged(spark, folder).select("flag").distinct()


@query("agg_presence_rate", f"""
    SELECT user_id, event_type,
           CASE WHEN count(*) = count(value)
                THEN round(count(*) FILTER (value > 10) / 30.0::DOUBLE * 100, 5) END AS above
    FROM ({_EVENTS}) GROUP BY ALL""")
def agg_presence_rate(spark, folder):
    rows = _events(spark, folder).withColumn("excess", F.col("value") - 10)
    out = aggregates.presence_rate(rows, ["user_id", "event_type"], {"above": "excess"}, 30)
    return rounded(out, 5, "above")


@query("agg_two_level", """
    WITH s AS (SELECT event_type, user_id, round(sum(value), 2) AS total FROM events GROUP BY ALL)
    SELECT event_type, round(median(total), 5) AS total FROM s GROUP BY ALL""")
def agg_two_level(spark, folder):
    sums = table(spark, folder, "events").groupBy("event_type", "user_id").agg(
        F.round(missing.strict_sum(F.col("value")), 2).alias("total")
    )
    return rounded(medians.group_median(sums, ["event_type"], ["total"], strict=True, store_input=True), 5, "total")


# ---------------------------------------------------------------- windows and scaling


@query("win_partition_share", """
    SELECT l_orderkey, l_linenumber, l_quantity,
           sum(l_quantity) OVER (PARTITION BY l_returnflag) AS total,
           round(l_quantity / sum(l_quantity) OVER (PARTITION BY l_returnflag), 10) AS share
    FROM lineitem""")
def win_partition_share(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_quantity"
    )
    out = windows.partition_share(rows, ["l_returnflag"], "l_quantity").drop("l_returnflag")
    return rounded(out, 10, "share")


_PRIORITIES = ["3-MEDIUM", "1-URGENT", "5-LOW", "2-HIGH"]


@query("win_cumsum_midpoint", """
    WITH g AS (SELECT o_orderstatus,
                      CASE WHEN o_orderpriority IN ('3-MEDIUM', '1-URGENT', '5-LOW', '2-HIGH')
                           THEN o_orderpriority END AS priority,
                      sum(o_totalprice) AS value
               FROM orders GROUP BY ALL),
         p AS (SELECT o_orderstatus, priority, value,
                      value / sum(value) OVER (PARTITION BY o_orderstatus) AS prop,
                      CASE priority WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2
                           WHEN '5-LOW' THEN 3 WHEN '2-HIGH' THEN 4 END AS level_order
               FROM g),
         c AS (SELECT *, sum(prop) OVER (PARTITION BY o_orderstatus
                      ORDER BY level_order DESC NULLS LAST ROWS UNBOUNDED PRECEDING) AS cumsum
               FROM p)
    SELECT o_orderstatus, priority, level_order, round(value, 2) AS value,
           round(prop, 9) AS prop, round(cumsum, 9) AS cumsum, round(cumsum - prop / 2, 9) AS pos
    FROM c""")
def win_cumsum_midpoint(spark, folder):
    rows = table(spark, folder, "orders").select(
        "o_orderstatus", F.col("o_orderpriority").alias("priority"),
        F.col("o_totalprice").alias("value"),
    )
    out = windows.running_share(rows, "priority", _PRIORITIES, "value", ["o_orderstatus"])
    return rounded(rounded(out, 2, "value"), 9, "prop", "cumsum", "pos")


# A tax of zero stands for a missing quantity.
_MEASURED = """SELECT l_orderkey, l_linenumber, l_returnflag,
                      CASE WHEN l_tax > 0 THEN l_quantity END AS q, l_extendedprice AS p,
                      l_discount AS d
               FROM lineitem"""


def _measured(spark, folder):
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag",
        F.when(F.col("l_tax") > 0, F.col("l_quantity")).alias("q"),
        F.col("l_extendedprice").alias("p"), F.col("l_discount").alias("d"),
    )


@query("win_zscore", f"""
    WITH m AS ({_MEASURED})
    SELECT l_orderkey, l_linenumber,
           round((q - (SELECT avg(q) FROM m)) / (SELECT nullif(stddev_samp(q), 0) FROM m), 7) AS q,
           round((p - (SELECT avg(p) FROM m)) / (SELECT nullif(stddev_samp(p), 0) FROM m), 7) AS p
    FROM m""")
def win_zscore(spark, folder):
    rows = _measured(spark, folder).select("l_orderkey", "l_linenumber", "q", "p")
    return rounded(standardize.standardize(rows, {"q": F.col("q"), "p": F.col("p")}), 7, "q", "p")


@query("win_log_zscore", f"""
    WITH m AS (SELECT l_orderkey, l_linenumber, ln(CASE WHEN d > 0 THEN d * 10 END) AS d,
                      ln(p) AS p FROM ({_MEASURED}))
    SELECT l_orderkey, l_linenumber,
           round((d - (SELECT avg(d) FROM m)) / (SELECT stddev_samp(d) FROM m), 6) AS d,
           round((p - (SELECT avg(p) FROM m)) / (SELECT stddev_samp(p) FROM m), 6) AS p
    FROM m""")
def win_log_zscore(spark, folder):
    rows = _measured(spark, folder).select("l_orderkey", "l_linenumber", "d", "p")
    logs = {"d": F.ln(F.col("d") * 10), "p": F.ln(F.col("p"))}
    return rounded(standardize.standardize(rows, logs), 6, "d", "p")


@query("win_impute_group_mean", f"""
    SELECT l_orderkey, l_linenumber, l_returnflag,
           round(CASE WHEN l_returnflag IN ('A', 'N')
                 THEN coalesce(q, avg(q) OVER (PARTITION BY l_returnflag)) ELSE q END, 6) AS q
    FROM ({_MEASURED})""")
def win_impute_group_mean(spark, folder):
    rows = _measured(spark, folder).select("l_orderkey", "l_linenumber", "l_returnflag", "q")
    out = standardize.impute_group_mean(rows, "l_returnflag", {"A": ["q"], "N": ["q"]})
    return rounded(out, 6, "q")


@query("win_zscore_impute", f"""
    WITH m AS ({_MEASURED}),
         z AS (SELECT l_orderkey, l_linenumber, l_returnflag,
                      (q - (SELECT avg(q) FROM m)) / (SELECT stddev_samp(q) FROM m) AS q FROM m)
    SELECT l_orderkey, l_linenumber, l_returnflag,
           round(CASE WHEN l_returnflag = 'R'
                 THEN coalesce(q, avg(q) OVER (PARTITION BY l_returnflag)) ELSE q END, 7) AS q
    FROM z""")
def win_zscore_impute(spark, folder):
    rows = _measured(spark, folder).select("l_orderkey", "l_linenumber", "l_returnflag", "q")
    out = standardize.standardize(rows, {"q": F.col("q")}, "l_returnflag", {"R": ["q"]})
    return rounded(out, 7, "q")


# ---------------------------------------------------------------- sorts, unions, reshaping


@query("sort_text", "SELECT c_name, c_mktsegment FROM customer ORDER BY c_mktsegment, c_name")
def sort_text(spark, folder):
    return table(spark, folder, "customer").select("c_name", "c_mktsegment").orderBy(
        "c_mktsegment", "c_name"
    )


@query("ord_factor_levels", """
    SELECT o_orderkey, CASE WHEN o_orderpriority IN ('3-MEDIUM', '1-URGENT', '5-LOW', '2-HIGH')
                            THEN o_orderpriority END AS priority,
           CASE o_orderpriority WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2 WHEN '5-LOW' THEN 3
                WHEN '2-HIGH' THEN 4 END AS level_order
    FROM orders ORDER BY level_order DESC NULLS LAST""")
def ord_factor_levels(spark, folder):
    priority = F.col("o_orderpriority")
    return table(spark, folder, "orders").select(
        "o_orderkey", coding.as_level(priority, _PRIORITIES).alias("priority"),
        coding.level_order(priority, _PRIORITIES).alias("level_order"),
    ).orderBy(F.desc_nulls_last("level_order"))


@query("set_union_by_name", """
    SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer
    UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier""")
def set_union_by_name(spark, folder):
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("segment"),
    )
    suppliers = table(spark, folder, "supplier").select(
        F.col("s_name").alias("name"), F.col("s_suppkey").alias("id")
    )
    return reshape.stack(customers, suppliers)


@query("reshape_wider", """
    SELECT o_orderkey, o_custkey,
           max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS F,
           max(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS O,
           max(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END) AS P
    FROM orders GROUP BY ALL""")
def reshape_wider(spark, folder):
    orders = table(spark, folder, "orders")
    return reshape.wider(
        orders, ["o_orderkey", "o_custkey"], "o_orderstatus", "o_totalprice", ["F", "O", "P"]
    )


@query("reshape_wider_merged", """
    SELECT user_id,
           round(avg(CASE WHEN event_type = 'click' THEN value END), 9) AS click,
           round(avg(CASE WHEN event_type = 'view' THEN value END), 9) AS view
    FROM events GROUP BY ALL""")
def reshape_wider_merged(spark, folder):
    events = table(spark, folder, "events")
    out = reshape.wider(events, ["user_id"], "event_type", "value", ["click", "view"], "mean")
    return rounded(out, 9, "click", "view")


@query("reshape_longer", f"""
    SELECT l_orderkey, l_linenumber, 'q' AS var, q AS value FROM ({_MEASURED})
    UNION ALL SELECT l_orderkey, l_linenumber, 'p', p FROM ({_MEASURED})
    UNION ALL SELECT l_orderkey, l_linenumber, 'd', d FROM ({_MEASURED})""")
def reshape_longer(spark, folder):
    return reshape.longer(
        _measured(spark, folder), ["l_orderkey", "l_linenumber"], ["q", "p", "d"]
    )
