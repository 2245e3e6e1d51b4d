"""Sources, projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import coding, missing, numeric, rules, text
from ..operators import columns
from ..sources import readers, scratch, writers
from .registry import null_if, query, table

# ---------------------------------------------------------------- sources and sinks


def _write_csv(df, sep=",", encoding="UTF-8"):
    path = scratch.fresh_path(df.sparkSession, "csv")
    (df.write.option("header", True).option("sep", sep).option("encoding", encoding)
     .option("nullValue", "NA").csv(path))
    return path


@query("src_csv", """
    SELECT c_custkey, c_name, c_nationkey, nullif(c_mktsegment, 'MACHINERY') AS segment,
           CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance
    FROM customer""")
def src_csv(spark, folder):
    rows = table(spark, folder, "customer").select(
        "c_custkey", "c_name", "c_nationkey",
        null_if(F.col("c_mktsegment"), "MACHINERY").alias("segment"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"),
    )
    schema = "c_custkey bigint, c_name string, c_nationkey int, segment string, balance double"
    return readers.read_csv(spark, _write_csv(rows), schema)


@query("src_csv_semicolon", """
    SELECT s_suppkey, s_name || ' é' AS s_name, s_acctbal FROM supplier""")
def src_csv_semicolon(spark, folder):
    rows = table(spark, folder, "supplier").select(
        "s_suppkey", F.concat("s_name", F.lit(" é")).alias("s_name"), "s_acctbal"
    )
    path = _write_csv(rows, ";", "ISO-8859-1")
    schema = "s_suppkey bigint, s_name string, s_acctbal double"
    return readers.read_csv_semicolon(spark, path, schema, "ISO-8859-1")


@query("src_csv_decimal_comma", "SELECT p_partkey, p_brand, p_retailprice FROM part")
def src_csv_decimal_comma(spark, folder):
    price = F.replace(F.col("p_retailprice").cast("string"), F.lit("."), F.lit(","))
    rows = table(spark, folder, "part").select(
        "p_partkey", "p_brand", price.alias("p_retailprice")
    )
    return readers.read_csv_decimal_comma(
        spark, _write_csv(rows, ";"), "p_partkey bigint, p_brand string, p_retailprice double"
    )


@query("src_clean_header", """
    SELECT n_nationkey AS moisture, n_name AS site_name, n_regionkey AS region_key FROM nation""")
def src_clean_header(spark, folder):
    mangled = table(spark, folder, "nation").toDF("Moisture......", "Site.Name", "Region (key)")
    return readers.clean_names(mangled)


@query("src_typed", """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS price
    FROM orders""")
def src_typed(spark, folder):
    price = F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(
        F.col("o_totalprice").cast("string")
    )
    rows = table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"), price.alias("price")
    )
    return readers.read_typed(rows, "o_orderkey bigint, price double")


@query("src_parquet", "SELECT l_orderkey, l_partkey, l_quantity, l_returnflag FROM lineitem")
def src_parquet(spark, folder):
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_returnflag"
    )


@query("snk_snapshot", """
    SELECT event_id, user_id, event_type, value, CAST('2021-07-01' AS DATE) AS run_date
    FROM events""")
def snk_snapshot(spark, folder):
    base = scratch.fresh_path(spark, "snapshot")
    rows = table(spark, folder, "events").select("event_id", "user_id", "event_type", "value")
    writers.write_snapshot(rows, base, "2021-07-01")
    return readers.read_snapshot(spark, base)


@query("snk_result_csv", """
    SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority""")
def snk_result_csv(spark, folder):
    result = table(spark, folder, "orders").groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n")
    )
    path = writers.write_result_csv(result, scratch.fresh_path(spark, "result"), files=1)
    return readers.read_csv(spark, path, "o_orderpriority string, n bigint")


# ---------------------------------------------------------------- projections


@query("proj_select", "SELECT o_orderkey, o_totalprice FROM orders")
def proj_select(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", "o_totalprice")


@query("proj_drop", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def proj_drop(spark, folder):
    return table(spark, folder, "customer").drop("c_acctbal", "c_nationkey")


@query("proj_where_numeric", "SELECT p_partkey, p_size, p_retailprice FROM part")
def proj_where_numeric(spark, folder):
    part = table(spark, folder, "part")
    return part.select(columns.numeric_columns(part))


@query("proj_prefix", "SELECT p_name, p_brand, p_type, p_size, p_partkey, p_retailprice FROM part")
def proj_prefix(spark, folder):
    part = table(spark, folder, "part").withColumn("other", F.lit(1))
    return part.select(columns.prefixed(part, "p_"))


@query("proj_rename", "SELECT s_suppkey AS id, s_name AS label, s_nationkey, s_acctbal FROM supplier")
def proj_rename(spark, folder):
    return table(spark, folder, "supplier").withColumnsRenamed(
        {"s_suppkey": "id", "s_name": "label"}
    )


@query("proj_sequential_mutate", """
    WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity / 50 AS rate, l_tax FROM lineitem)
    SELECT l_orderkey, l_linenumber, round(rate * 100, 6) AS rate,
           round(rate / (l_tax + 1), 6) AS ratio
    FROM a""")
def proj_sequential_mutate(spark, folder):
    # rate is used raw by ratio, then overwritten
    return columns.mutate(
        table(spark, folder, "lineitem"),
        [
            ("rate", F.col("l_quantity") / 50),
            ("ratio", F.round(F.col("rate") / (F.col("l_tax") + 1), 6)),
            ("rate", F.round(F.col("rate") * 100, 6)),
        ],
    ).select("l_orderkey", "l_linenumber", "rate", "ratio")


@query("proj_across_round", """
    SELECT l_orderkey, l_linenumber, round_even(l_quantity / 8, 1) AS l_quantity,
           round_even(l_extendedprice / 3, 4) AS l_extendedprice
    FROM lineitem""")
def proj_across_round(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber",
        (F.col("l_quantity") / 8).alias("l_quantity"),
        (F.col("l_extendedprice") / 3).alias("l_extendedprice"),
    )
    rows = columns.across(rows, ["l_quantity"], lambda c: numeric.half_even(c, 1))
    return columns.across(rows, ["l_extendedprice"], lambda c: numeric.half_even(c, 4))


@query("proj_scalar_lookup", """
    SELECT s_suppkey,
           s_nationkey - (SELECT n_regionkey FROM nation WHERE n_name = 'NATION_3') AS gap
    FROM supplier""")
def proj_scalar_lookup(spark, folder):
    nation = table(spark, folder, "nation")
    region = columns.lookup_value(nation, "n_name", "NATION_3", "n_regionkey")
    return table(spark, folder, "supplier").select(
        "s_suppkey", (F.col("s_nationkey") - region).alias("gap")
    )


# ---------------------------------------------------------------- filters

_CUSTOMERS = """SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment, c_acctbal
                FROM customer"""


def _customers(spark, folder):
    return table(spark, folder, "customer").select(
        "c_custkey", null_if(F.col("c_mktsegment"), "BUILDING").alias("segment"), "c_acctbal"
    )


@query("filter_neq", f"SELECT * FROM ({_CUSTOMERS}) WHERE segment <> 'MACHINERY'")
def filter_neq(spark, folder):
    return _customers(spark, folder).filter(F.col("segment") != "MACHINERY")


@query("filter_in", f"SELECT * FROM ({_CUSTOMERS}) WHERE segment IN ('MACHINERY', 'FURNITURE')")
def filter_in(spark, folder):
    return _customers(spark, folder).filter(
        missing.in_set(F.col("segment"), ["MACHINERY", "FURNITURE"])
    )


@query("filter_not_in_null_safe", f"""
    SELECT * FROM ({_CUSTOMERS})
    WHERE segment IS NULL OR segment NOT IN ('MACHINERY', 'FURNITURE')""")
def filter_not_in_null_safe(spark, folder):
    return _customers(spark, folder).filter(
        missing.not_in_set(F.col("segment"), ["MACHINERY", "FURNITURE"])
    )


@query("filter_not_missing", """
    SELECT * FROM (
        SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '' WHEN 'O' THEN NULL
               ELSE o_orderstatus END AS status
        FROM orders)
    WHERE status IS NOT NULL AND status <> ''""")
def filter_not_missing(spark, folder):
    status = F.col("o_orderstatus")
    rows = table(spark, folder, "orders").select(
        "o_orderkey",
        F.when(status == "F", "").when(status != "O", status).alias("status"),
    )
    return rows.filter(missing.present(F.col("status")))


@query("filter_regex", """
    SELECT p_partkey, p_name, coalesce(regexp_matches(nullif(p_name, 'red widget'), 'in|ol'), FALSE)
           AS found
    FROM part""")
def filter_regex(spark, folder):
    name = null_if(F.col("p_name"), "red widget")
    return table(spark, folder, "part").select(
        "p_partkey", "p_name", missing.matches(name, "in|ol").alias("found")
    )


@query("filter_outlier_rule", """
    SELECT * FROM (
        SELECT l_orderkey, l_linenumber, nullif(l_returnflag, 'N') AS species,
               nullif(l_quantity, 50) AS height
        FROM lineitem)
    WHERE NOT (species = 'A' AND height > 40)""")
def filter_outlier_rule(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber",
        null_if(F.col("l_returnflag"), "N").alias("species"),
        null_if(F.col("l_quantity"), 50.0).alias("height"),
    )
    return rows.filter(rules.not_both(F.col("species") == "A", F.col("height") > 40))


@query("filter_site_rule", """
    SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus FROM lineitem
    WHERE (l_returnflag IN ('A', 'N') AND l_linestatus IN ('F'))
       OR (l_returnflag IN ('R') AND l_linestatus IN ('O'))""")
def filter_site_rule(spark, folder):
    rows = table(spark, folder, "lineitem")
    kept = rows.filter(
        rules.any_pairing(
            F.col("l_returnflag"), F.col("l_linestatus"),
            [(["A", "N"], ["F"]), (["R"], ["O"])],
        )
    )
    return kept.select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")


# ---------------------------------------------------------------- scalar functions


@query("fn_regex_keys", r"""
    SELECT o_orderkey, nullif(regexp_extract(o_orderpriority, '^\d'), '') AS code,
           nullif(regexp_extract(o_orderpriority, '^\d-(.*)$', 1), '') AS name,
           nullif(regexp_extract(o_orderpriority, '[0-9]-([LM])', 1), '') AS letter
    FROM orders""")
def fn_regex_keys(spark, folder):
    key = F.col("o_orderpriority")
    return table(spark, folder, "orders").select(
        "o_orderkey",
        text.extract(key, r"^\d").alias("code"),
        text.extract(key, r"(?<=^\d-).*$").alias("name"),
        text.extract(key, "(?<=[0-9]-)[LM]").alias("letter"),
    )


@query("fn_characters", """
    SELECT c_custkey, substr(c_name, 1, 4) AS code, substr(c_name, 10, 4) AS number
    FROM customer""")
def fn_characters(spark, folder):
    name = F.col("c_name")
    return table(spark, folder, "customer").select(
        "c_custkey", text.characters(name, 1, 4).alias("code"),
        text.characters(name, 10, 13).alias("number"),
    )


@query("fn_paste", """
    SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'P'), 'NA') || o_orderpriority AS glued,
           coalesce(nullif(o_orderstatus, 'P'), 'NA') || ' ' || o_orderpriority AS spaced
    FROM orders""")
def fn_paste(spark, folder):
    parts = null_if(F.col("o_orderstatus"), "P"), F.col("o_orderpriority")
    return table(spark, folder, "orders").select(
        "o_orderkey", text.paste(*parts).alias("glued"), text.paste(*parts, sep=" ").alias("spaced")
    )


@query("fn_pad", """
    SELECT p_partkey,
           CASE WHEN p_size BETWEEN 1 AND 10 THEN lpad(CAST(p_size AS VARCHAR), 2, '0') END AS rep,
           CASE WHEN p_size IN (2, 4, 6, 8, 10, 12, 14, 16, 18, 20)
                THEN lpad(CAST(CAST(p_size / 2 AS INTEGER) AS VARCHAR), 2, '0') END AS half_rep
    FROM part""")
def fn_pad(spark, folder):
    size = F.col("p_size").cast("double")
    return table(spark, folder, "part").select(
        "p_partkey", text.replicate_code(size).alias("rep"),
        text.replicate_code(size / 2).alias("half_rep"),
    )


@query("fn_parse_number", """
    SELECT o_orderkey, round(o_totalprice, 2) AS amount, CAST(o_custkey AS DOUBLE) AS customer,
           CAST(NULL AS DOUBLE) AS nothing
    FROM orders""")
def fn_parse_number(spark, folder):
    written = F.concat(F.lit("about "), F.format_number("o_totalprice", 2), F.lit(" kg, 3 times"))
    return table(spark, folder, "orders").select(
        "o_orderkey",
        text.parse_number(written).alias("amount"),
        text.to_number(F.col("o_custkey").cast("string")).alias("customer"),
        text.to_number(F.col("o_orderpriority")).alias("nothing"),
    )


@query("fn_date_parse", """
    SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS day
    FROM orders""")
def fn_date_parse(spark, folder):
    stamp = F.when(F.col("o_orderstatus") == "P", "31/02/2021 10:00").otherwise(
        F.concat(F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(" 10:00"))
    )
    return table(spark, folder, "orders").select("o_orderkey", text.parse_day(stamp).alias("day"))


@query("fn_replace", """
    SELECT p_partkey, regexp_replace(p_brand, '#([0-9]+)$', '-\\1') AS brand FROM part""")
def fn_replace(spark, folder):
    return table(spark, folder, "part").select(
        "p_partkey", F.regexp_replace("p_brand", "#([0-9]+)$", "-$1").alias("brand")
    )


@query("fn_case_when", """
    SELECT l_orderkey, l_linenumber,
           CASE WHEN l_quantity < 10 THEN 'low' WHEN l_quantity < 30 THEN 'mid' END AS size,
           CASE WHEN l_quantity < 10 THEN 'low' WHEN l_quantity < 30 THEN 'mid'
                ELSE l_returnflag END AS size_or_flag
    FROM lineitem""")
def fn_case_when(spark, folder):
    quantity = F.col("l_quantity")
    cases = [(quantity < 10, "low"), (quantity < 30, "mid")]
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber",
        coding.first_match(cases).alias("size"),
        coding.first_match(cases, F.col("l_returnflag")).alias("size_or_flag"),
    )


@query("fn_recode", """
    SELECT c_custkey,
           CASE c_mktsegment WHEN 'MACHINERY' THEN 'M' WHEN 'FURNITURE' THEN 'F'
                ELSE c_mktsegment END AS passed,
           CASE c_mktsegment WHEN 'MACHINERY' THEN 'M' WHEN 'FURNITURE' THEN 'F' END AS known
    FROM customer""")
def fn_recode(spark, folder):
    codes = {"MACHINERY": "M", "FURNITURE": "F"}
    segment = F.col("c_mktsegment")
    return table(spark, folder, "customer").select(
        "c_custkey", coding.recode(segment, codes).alias("passed"),
        coding.translate(segment, codes).alias("known"),
    )


@query("fn_ifelse_null", """
    SELECT l_orderkey, l_linenumber,
           CASE WHEN l_tax = 0 THEN NULL WHEN l_quantity > 25 THEN 1 ELSE 0 END AS many
    FROM lineitem""")
def fn_ifelse_null(spark, folder):
    quantity = F.when(F.col("l_tax") != 0, F.col("l_quantity"))
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", missing.if_else(quantity > 25, 1, 0).alias("many")
    )


@query("fn_fill_missing", f"""
    SELECT c_custkey, coalesce(segment, 'none') AS segment, segment IS NULL AS gap
    FROM ({_CUSTOMERS})""")
def fn_fill_missing(spark, folder):
    return _customers(spark, folder).select(
        "c_custkey", F.coalesce("segment", F.lit("none")).alias("segment"),
        F.col("segment").isNull().alias("gap"),
    )


@query("fn_bankers_round", """
    SELECT l_orderkey, l_linenumber, round_even(l_quantity / 2, 0) AS half,
           round_even(l_quantity / 8, 2) AS eighth
    FROM lineitem""")
def fn_bankers_round(spark, folder):
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber",
        numeric.half_even(F.col("l_quantity") / 2).alias("half"),
        numeric.half_even(F.col("l_quantity") / 8, 2).alias("eighth"),
    )


@query("fn_safe_divide", """
    SELECT l_orderkey, l_linenumber, round(l_discount / nullif(l_tax, 0), 6) AS ratio,
           round(ln(CASE WHEN l_tax > 0 THEN l_tax END), 6) AS log_tax
    FROM lineitem""")
def fn_safe_divide(spark, folder):
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.round(numeric.ratio(F.col("l_discount"), F.col("l_tax")), 6).alias("ratio"),
        F.round(F.ln("l_tax"), 6).alias("log_tax"),
    )


@query("fn_significance", """
    SELECT l_orderkey, l_linenumber,
           CASE WHEN p IS NULL THEN NULL WHEN p >= 0.05::DOUBLE THEN 'ns' ELSE '*' END AS mark,
           CASE WHEN p < 0.05::DOUBLE THEN '*' ELSE '' END AS star
    FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_tax > 0 THEN l_discount END AS p
          FROM lineitem)""")
def fn_significance(spark, folder):
    p = F.when(F.col("l_tax") > 0, F.col("l_discount"))
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", numeric.mark_or_ns(p).alias("mark"),
        numeric.mark_or_blank(p).alias("star"),
    )


@query("fn_format_label", """
    SELECT l_orderkey, l_linenumber, printf('%.2f%%', l_quantity / 64 * 100) AS label
    FROM lineitem""")
def fn_format_label(spark, folder):
    # sixty-fourths have an exact binary form, so no digit hangs on the last bit
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", numeric.percent_label(F.col("l_quantity") / 64).alias("label")
    )


@query("fn_unit_derivations", """
    SELECT l_orderkey, l_linenumber,
           round(l_extendedprice * 1e-4 / (l_quantity / 1e6), 3) AS sla,
           round(l_quantity / 1e6 / (l_extendedprice * 1e-4), 14) AS lma,
           round(l_quantity / nullif(l_tax * 1e-3, 0), 3) AS ldmc,
           l_quantity / 10 AS lnc
    FROM lineitem""")
def fn_unit_derivations(spark, folder):
    c = F.col
    sla = numeric.specific_leaf_area(c("l_extendedprice"), c("l_quantity"))
    ldmc = numeric.dry_matter_content(c("l_quantity"), c("l_tax"))
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.round(sla, 3).alias("sla"),
        F.round(numeric.ratio(F.lit(1.0), sla), 14).alias("lma"),
        F.round(ldmc, 3).alias("ldmc"),
        (c("l_quantity") / 10).alias("lnc"),
    )


@query("fn_mass_loss", """
    SELECT l_orderkey, l_linenumber,
           round((l_quantity - l_quantity * l_discount) / l_quantity, 8) AS green,
           round((l_linenumber - l_tax) / l_linenumber, 8) AS red,
           round((l_quantity + l_linenumber)
                 - (l_quantity * l_discount + l_tax) / (l_linenumber + l_quantity), 8) AS total,
           round(((l_quantity + l_linenumber) - (l_quantity * l_discount + l_tax))
                 / (l_linenumber + l_quantity), 8) AS joint
    FROM lineitem""")
def fn_mass_loss(spark, folder):
    c = F.col
    green = c("l_quantity"), c("l_quantity") * c("l_discount")
    red = c("l_linenumber").cast("double"), c("l_tax")
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.round(numeric.mass_loss(*green), 8).alias("green"),
        F.round(numeric.mass_loss(*red), 8).alias("red"),
        F.round(numeric.total_decomposition(*green, *red), 8).alias("total"),
        F.round(numeric.joint_mass_loss(*green, *red), 8).alias("joint"),
    )


@query("fn_indicator_interaction", """
    SELECT l_orderkey, l_linenumber, ecc, l_quantity * ecc AS quantity_ecc
    FROM (SELECT l_orderkey, l_linenumber, l_quantity,
                 CASE WHEN nullif(l_returnflag, 'R') IN ('A') THEN 0.0::DOUBLE
                      ELSE 1.0::DOUBLE END AS ecc
          FROM lineitem)""")
def fn_indicator_interaction(spark, folder):
    flag = null_if(F.col("l_returnflag"), "R")
    rows = table(spark, folder, "lineitem").withColumn("ecc", coding.indicator(flag, ["A"]))
    return rows.select(
        "l_orderkey", "l_linenumber", "ecc", (F.col("l_quantity") * F.col("ecc")).alias("quantity_ecc")
    )
