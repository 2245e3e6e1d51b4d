"""The experiment's pipelines, fed with source tables that Spark shapes from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import linmodel, ordination, permute
from ..plans import effects, partition, plots, traits, vocabulary as v
from ..sources import readers, scratch
from . import models
from .registry import null_if, query, rounded, table

# ---------------------------------------------------------------- source tables


def _two(c):
    return F.lpad(c.cast("string"), 2, "0")


def nutrient_source(spark, folder):
    """One leaf sample per order; low-priority orders carry an unreadable plot."""
    status = F.col("o_orderstatus")
    code = F.when(status == "F", "LT").when(status == "O", "LC").otherwise("GC")
    plot = F.concat(code, _two(F.month("o_orderdate")), F.lit("-"), "o_orderkey")
    return table(spark, folder, "orders").select(
        F.when(F.col("o_orderpriority") == "5-LOW", "plot ?").otherwise(plot).alias("plot"),
        (F.col("o_totalprice") / 1000).alias("n"),
    )


_NUTRIENT = """
    SELECT CASE WHEN o_orderpriority = '5-LOW' THEN NULL
                ELSE CASE o_orderstatus WHEN 'F' THEN 'AlpineWarmed' WHEN 'O' THEN 'SubalpineControl'
                     ELSE 'AlpineControl' END END AS combi_fac,
           CASE WHEN o_orderpriority = '5-LOW' THEN NULL
                ELSE lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') END AS rep,
           CASE WHEN o_orderpriority = '5-LOW' THEN NULL
                ELSE CAST(o_orderkey AS DOUBLE) END AS num_point,
           2021 AS year, o_totalprice / 1000 / 10 AS lnc
    FROM orders"""

_COMMENTS = {
    "1-URGENT": "Scorzo", "2-HIGH": "Viola calcarta", "3-MEDIUM": "hypericum richeri ",
    "4-NOT SPECIFIED": "something green",
}
_TAXONOMY = [
    ("Viola calcarata", "Viola calcarata"), ("Hypericum richeri", "Hypericum richeri"),
    ("Viola biflora", "Viola biflora"), ("Ribes", "Ribes"),
]


def trait_source(spark, folder):
    """Five long rows per order, an order being one measured individual."""
    c = F.col
    status, month = c("o_orderstatus"), F.month("o_orderdate")
    site = F.when(status == "P", "G").otherwise("L")
    arm = F.when(status == "F", "T").otherwise("C")
    mass = c("o_totalprice") / 1000
    comments = F.lit(None).cast("string")
    for priority, text in _COMMENTS.items():
        comments = F.when(c("o_orderpriority") == priority, text).otherwise(comments)
    wide = table(spark, folder, "orders").select(
        F.concat_ws("_", site, _two(month), arm).alias("subplotmaincode"),
        c("o_orderkey").cast("double").alias("num_point"),
        F.when(month <= 9, 2021).otherwise(2022).alias("year"),
        comments.alias("comments"),
        F.when(status == "F", "Patzkea").when(status == "O", "Anthyllis vulneraria")
        .otherwise("Campanula scheuchzeri").alias("lb_nom"),
        c("o_custkey").cast("string").alias("cd_ref"),
        F.lit("unit").alias("code_unite"),
        mass.alias("D_Mass"),
        F.when(month == 6, mass / 2).when(status != "P", mass * 4).alias("F_Mass"),
        F.dayofmonth("o_orderdate").cast("double").alias("L_Area"),
        (month * 10).cast("double").alias("H_Veg"),
        F.lit(1.0).alias("H_Repr"),
    )
    ids = ["subplotmaincode", "num_point", "year", "comments", "lb_nom", "cd_ref", "code_unite"]
    codes = ["D_Mass", "F_Mass", "L_Area", "H_Veg", "H_Repr"]
    return wide.unpivot(ids, codes, "code_trait", "value")


def _name_dictionary(spark, measured):
    taxonomy = spark.createDataFrame(_TAXONOMY, "name string, accepted string")
    return traits.reconcile_names(measured, taxonomy)


def _individuals(spark, folder):
    measured = trait_source(spark, folder)
    nutrients = traits.nutrient_table(nutrient_source(spark, folder))
    return traits.trait_table(measured, _name_dictionary(spark, measured), nutrients)


_INDIVIDUALS = f"""
    o AS (SELECT *, month(o_orderdate) AS mo, o_totalprice / 1000 AS mass FROM orders),
    i AS (SELECT CAST(o_orderkey AS DOUBLE) AS num_point,
                 CASE WHEN mo <= 9 THEN 2021 ELSE 2022 END AS year,
                 CASE o_orderpriority
                      WHEN '1-URGENT' THEN 'Scorzoneroides pyrenaica var. helvetica'
                      WHEN '2-HIGH' THEN 'Viola calcarata'
                      WHEN '3-MEDIUM' THEN 'Hypericum richeri'
                      ELSE CASE o_orderstatus WHEN 'F' THEN 'Patzkea paniculata subsp. paniculata'
                           WHEN 'O' THEN 'Anthyllis vulneraria' ELSE 'Campanula scheuchzeri' END
                      END AS species,
                 CASE o_orderstatus WHEN 'F' THEN 'AlpineWarmed' WHEN 'O' THEN 'SubalpineControl'
                      ELSE 'AlpineControl' END AS combi_fac,
                 lpad(CAST(mo AS VARCHAR), 2, '0') AS rep, CAST(mo * 10 AS DOUBLE) AS height,
                 day(o_orderdate) * 1e-4::DOUBLE / (mass / 1e6) AS sla,
                 1 / (day(o_orderdate) * 1e-4::DOUBLE / (mass / 1e6)) AS lma,
                 mass / ((CASE WHEN mo = 6 THEN mass / 2 WHEN o_orderstatus <> 'P'
                               THEN mass * 4 END) * 0.001::DOUBLE) AS ldmc
          FROM o),
    nu AS ({_NUTRIENT}),
    ind AS (SELECT i.*, nu.lnc
            FROM i LEFT JOIN nu ON i.combi_fac = nu.combi_fac AND i.rep = nu.rep
                 AND i.num_point = nu.num_point AND i.year = nu.year
            WHERE NOT (species LIKE '%Patzkea%' AND i.combi_fac = 'AlpineControl')
              AND NOT (species = 'Anthyllis vulneraria' AND height > 80)
              AND NOT coalesce(species = 'Hypericum richeri' AND ldmc > 1000,
                               species = 'Hypericum richeri'))"""
_TRAIT_MEANS = """
    tm AS (SELECT combi_fac, year, rep, avg(ldmc) AS ldmc, avg(sla) AS sla, avg(lma) AS lma,
                  avg(height) AS vheight, avg(lnc) AS lnc
           FROM ind WHERE year = 2021 AND species <> 'Campanula scheuchzeri' GROUP BY ALL)"""


@query("nutrient_table", _NUTRIENT)
def nutrient_table(spark, folder):
    return traits.nutrient_table(nutrient_source(spark, folder))


@query("name_reconciliation", """
    WITH names AS (SELECT DISTINCT p_name AS name FROM part),
    sub AS (SELECT DISTINCT CASE WHEN p_size < 10 THEN replace(p_name, 'widget', 'wigdget')
                                 WHEN p_size < 20 THEN upper(p_name)
                                 WHEN p_size < 30 THEN replace(p_name, 'i', '')
                                 WHEN p_size < 40 THEN nullif(p_name, 'red bolt')
                                 ELSE p_name || ' unknown' END AS comments FROM part),
    best AS (SELECT comments, min({'d': levenshtein(lower(trim(comments)), name), 'n': name}) AS b
             FROM sub, names WHERE levenshtein(lower(trim(comments)), name) <= 1 GROUP BY comments),
    all_ AS (SELECT sub.comments, CASE WHEN sub.comments = 'RED RING' THEN 'ring, red'
                    WHEN b.n IN ('blue bolt', 'small ring') THEN NULL ELSE b.n END AS species
             FROM sub LEFT JOIN best ON sub.comments = best.comments)
    SELECT * FROM all_ WHERE species IS NOT NULL AND species <> ''""")
def name_reconciliation(spark, folder):
    name, size = F.col("p_name"), F.col("p_size")
    part = table(spark, folder, "part")
    submitted = part.select(
        F.when(size < 10, F.replace(name, F.lit("widget"), F.lit("wigdget")))
        .when(size < 20, F.upper(name))
        .when(size < 30, F.replace(name, F.lit("i"), F.lit("")))
        .when(size < 40, null_if(name, "red bolt"))
        .otherwise(F.concat(name, F.lit(" unknown"))).alias("comments")
    )
    taxonomy = part.select(name.alias("name"), name.alias("accepted"))
    return traits.reconcile_names(
        submitted, taxonomy, 1, {"RED RING": "ring, red"}, ["blue bolt", "small ring"]
    )


@query("trait_table", f"""
    WITH {_INDIVIDUALS}
    SELECT num_point, year, species, combi_fac, rep, height, round(sla, 10) AS sla,
           round(lma, 12) AS lma, round(ldmc, 6) AS ldmc, round(lnc, 9) AS lnc
    FROM ind""")
def trait_table(spark, folder):
    out = _individuals(spark, folder)
    return rounded(rounded(rounded(rounded(out, 10, "sla"), 12, "lma"), 6, "ldmc"), 9, "lnc")


@query("trait_means", f"""
    WITH {_INDIVIDUALS}, {_TRAIT_MEANS}
    SELECT combi_fac, year, rep, round(ldmc, 4) AS ldmc, round(sla, 8) AS sla,
           round(lma, 6) AS lma, round(vheight, 6) AS vheight, round(lnc, 7) AS lnc FROM tm""")
def trait_means(spark, folder):
    out = traits.trait_means(_individuals(spark, folder))
    out = rounded(rounded(out, 8, "sla"), 6, "lma", "vheight")
    return rounded(rounded(out, 4, "ldmc"), 7, "lnc")


@query("trait_gaps", f"""
    WITH {_INDIVIDUALS}
    SELECT combi_fac,
           {', '.join(
               f"round_even(count(*) FILTER ({c} IS NULL) / 290::DOUBLE * 100, 1) AS {c}"
               for c in ('height', 'sla', 'lma', 'ldmc', 'lnc'))}
    FROM ind
    WHERE year = 2021 AND combi_fac IN ('AlpineControl', 'AlpineWarmed', 'SubalpineControl')
    GROUP BY combi_fac""")
def trait_gaps(spark, folder):
    return traits.trait_gaps(_individuals(spark, folder), individuals=290.0)


@query("growth_form_shares", """
    SELECT p_type AS growth_form,
           round_even(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM part), 0) AS n
    FROM part GROUP BY p_type""")
def growth_form_shares(spark, folder):
    species = table(spark, folder, "part").select(F.col("p_type").alias("growth_form"))
    return traits.growth_form_shares(species)


# ---------------------------------------------------------------- plot-level sources


def _logger_rows(spark, folder):
    """A reading of the logger for each line item, in the logger's own columns."""
    c = F.col
    flag, line = c("l_returnflag"), c("l_linenumber")
    return table(spark, folder, "lineitem").select(
        F.concat(F.date_format("l_shipdate", "dd/MM/yyyy"), F.lit(" 10:00:00")).alias("timestamp"),
        F.concat(F.lit("plot "), (line * 2).cast("string")).alias("plot"),
        F.when(flag == "A", "GC").when(flag == "R", "LT")
        .when(c("l_linestatus") == "F", "LC").otherwise("GT").alias("site"),
        F.when(line <= 3, "D").when(line <= 5, "C").otherwise("X").alias("subplot"),
        F.when(c("l_tax") > 0, c("l_quantity") / 4).alias("moisture"),
    )


def _moisture_readings(spark, folder):
    """The readings by way of a logger file with decimal commas and a mangled header."""
    text = F.replace(F.col("moisture").cast("string"), F.lit("."), F.lit(","))
    rows = _logger_rows(spark, folder).withColumn("moisture", text)
    path = scratch.fresh_path(spark, "moisture")
    named = rows.toDF("TimeStamp", "Plot", "Site", "Subplot", "Moisture......")
    named.write.option("header", True).option("sep", ";").option("nullValue", "NA").csv(path)
    schema = "TimeStamp string, Plot string, Site string, Subplot string, `Moisture......` double"
    readings = plots.moisture_readings(
        readers.clean_names(readers.read_csv_decimal_comma(spark, path, schema))
    )
    return scratch.stored(readings, "readings")  # text is parsed once


_MOISTURE = """
    mo AS (SELECT CASE l_returnflag WHEN 'A' THEN 'AlpineControl' WHEN 'R' THEN 'AlpineWarmed'
                       ELSE CASE l_linestatus WHEN 'F' THEN 'SubalpineControl'
                            ELSE 'SubalpineCooled' END END AS combi_fac,
                  CASE WHEN l_linenumber <= 5
                       THEN lpad(CAST(l_linenumber * 2 AS VARCHAR), 2, '0') END AS rep,
                  median(CASE WHEN l_tax > 0 THEN l_quantity / 4 END) AS moisture
           FROM lineitem
           WHERE CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN l_linenumber IN (4, 5)
                      ELSE l_linenumber NOT IN (4, 5) END
           GROUP BY ALL)"""


@query("moisture_days", """
    SELECT CAST(l_shipdate AS DATE) AS doy, count(*) AS n FROM lineitem GROUP BY ALL""")
def moisture_days(spark, folder):
    return _moisture_readings(spark, folder).groupBy("doy").agg(F.count(F.lit(1)).alias("n"))


@query("plot_moisture", f"WITH {_MOISTURE} SELECT combi_fac, rep, moisture FROM mo")
def plot_moisture(spark, folder):
    return plots.plot_moisture(_moisture_readings(spark, folder))


def _microscope_counts(spark, folder):
    """One viewed field per event; a sample is the event type and hour on one day."""
    kind = F.col("event_type")
    code = (
        F.when(kind == "click", "LT").when(kind == "view", "LC").when(kind == "purchase", "GC")
        .when(kind == "error", "LA").otherwise("GT")
    )
    hour = F.date_format("ts", "HH")
    value = F.when((F.col("value") >= 1) | (hour != "02"), F.col("value"))
    return table(spark, folder, "events").select(
        F.concat(code, hour).alias("sample"),
        F.dayofmonth("ts").alias("sample_no"),
        (value - 8).alias("arbuscule"), (value - 20).alias("hypha"),
    )


_MYCO = """
    f AS (SELECT CASE event_type WHEN 'click' THEN 'AlpineWarmed' WHEN 'view' THEN 'SubalpineControl'
                      WHEN 'purchase' THEN 'AlpineControl' WHEN 'error' THEN 'LA'
                      ELSE 'SubalpineCooled' END AS combi_fac,
                 strftime(ts, '%H') AS rep, day(ts) AS sample_no,
                 CASE WHEN value >= 1 OR strftime(ts, '%H') <> '02' THEN value END AS value
          FROM events),
    sa AS (SELECT combi_fac, rep, sample_no,
                  CASE WHEN count(*) = count(value)
                       THEN count(*) FILTER (value - 8 > 0) / 30::DOUBLE * 100 END AS a,
                  CASE WHEN count(*) = count(value)
                       THEN count(*) FILTER (value - 20 > 0) / 30::DOUBLE * 100 END AS h
           FROM f WHERE combi_fac <> 'LA' GROUP BY ALL),
    my AS (SELECT combi_fac, rep,
                  CASE WHEN count(*) = count(a) THEN median(a) END AS arbuscule_occ,
                  CASE WHEN count(*) = count(h) THEN median(h) END AS hypha_occ
           FROM sa GROUP BY ALL)"""


@query("root_colonisation", f"""
    WITH {_MYCO}
    SELECT combi_fac, rep, round(arbuscule_occ, 7) AS arbuscule_occ,
           round(hypha_occ, 7) AS hypha_occ FROM my""")
def root_colonisation(spark, folder):
    out = plots.root_colonisation(_microscope_counts(spark, folder))
    return rounded(out, 7, "arbuscule_occ", "hypha_occ")


def _environment(spark, folder):
    name, key = F.col("r_name"), F.col("r_regionkey")
    return table(spark, folder, "region").select(
        F.when(name == "ASIA", "alpine").when(name == "EUROPE", "subalpine")
        .otherwise(F.lower(name)).alias("site"),
        (key * 3.25 + 9).alias("soil_temperature_shallow_july"),
        (key * 10.5 + 120).alias("length_gs_annual"),
    )


@query("site_differences", """
    WITH e AS (SELECT any_value(r_regionkey) FILTER (r_name = 'EUROPE') AS s,
                      any_value(r_regionkey) FILTER (r_name = 'ASIA') AS a FROM region)
    SELECT round_even((s - a) * 3.25::DOUBLE, 0) AS warming,
           round_even((s - a) * 10.5::DOUBLE, 0) AS gsl FROM e""")
def site_differences(spark, folder):
    return plots.site_differences(_environment(spark, folder))


# ---------------------------------------------------------------- integrated plot table

# Plot column: its SQL over line items.
_BASE_COLUMNS = {
    "plant_below_n_concentration": "avg(l_tax * l_quantity)",
    "plant_below_winrhizo_rtd": "avg(l_discount * l_quantity)",
    "plant_below_winrhizo_srl": "avg(l_extendedprice / l_quantity)",
    "plant_below_winrhizo_diameter_average": "avg(l_discount + l_tax)",
    "plant_up_aun": "stddev_samp(l_quantity)",
    "plant_below_whole_sample_mass_dry": "stddev_samp(l_extendedprice / 1000)",
    "soil_tea_bag_green_mass_air_dry_2020": "avg(l_quantity)",
    "soil_tea_bag_green_mass_dry_2021": "avg(l_quantity * (0.3 + l_discount))",
    "soil_tea_bag_red_mass_air_dry_2020": "avg(l_extendedprice / 1000)",
    "soil_tea_bag_red_mass_dry_2021": "avg(l_extendedprice / 1000 * (0.5 + l_tax))",
    "plant_below_qpcr_rdna_16s_copies_matrix_concentration": "avg(l_quantity * l_quantity)",
    "soil_qpcr_rdna_16s_copies_matrix_concentration": "avg(l_extendedprice * l_tax)",
    "soil_p_concentration": "avg(l_discount * l_extendedprice)",
    "soil_nitrate_concentration": "avg(l_tax * l_extendedprice)",
    "soil_om_concentration": "avg(l_tax * l_discount)",
}
# Plot column: the replicate where it was not measured.
_GAPS = {
    "plant_below_winrhizo_srl": "03", "plant_below_winrhizo_rtd": "03",
    "plant_below_qpcr_rdna_16s_copies_matrix_concentration": "05",
    "soil_tea_bag_green_mass_dry_2021": "06", "soil_om_concentration": "07",
}
_GROUP = """CASE l_returnflag WHEN 'A' THEN 'AlpineControl' WHEN 'R' THEN 'AlpineWarmed'
                 ELSE CASE l_linestatus WHEN 'F' THEN 'SubalpineControl'
                      ELSE 'SubalpineCooled' END END"""
_REP = "lpad(CAST(month(l_shipdate) AS {text}), 2, '0')"


def _base_plots(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        F.expr(_GROUP).alias("combi_fac"), F.expr(_REP.format(text="STRING")).alias("rep"),
        "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    )
    means = rows.groupBy("combi_fac", "rep").agg(
        *[F.expr(e).alias(c) for c, e in _BASE_COLUMNS.items()]
    )
    return means.withColumns(
        {c: F.when(F.col("rep") != rep, F.col(c)) for c, rep in _GAPS.items()}
    )


def _plot_table(spark, folder):
    """The integrated table, stored because every analysis passes over it again."""
    return scratch.stored(
        plots.integrate(
            _base_plots(spark, folder),
            traits.trait_means(_individuals(spark, folder)),
            plots.plot_moisture(plots.moisture_readings(_logger_rows(spark, folder))),
            plots.root_colonisation(_microscope_counts(spark, folder)),
            _environment(spark, folder),
        ),
        "plots",
    )


_CELLS = ", ".join(
    f"CASE WHEN rep <> '{_GAPS[c]}' THEN {c} END AS {c}" if c in _GAPS else c
    for c in _BASE_COLUMNS
)
_PLOTS = f"""{_INDIVIDUALS}, {_TRAIT_MEANS}, {_MOISTURE}, {_MYCO},
    b0 AS (SELECT {_GROUP} AS combi_fac, {_REP.format(text='VARCHAR')} AS rep,
                  {', '.join(f'{e} AS {c}' for c, e in _BASE_COLUMNS.items())}
           FROM lineitem GROUP BY 1, 2),
    b AS (SELECT combi_fac, rep, {_CELLS} FROM b0 WHERE combi_fac <> 'SubalpineCooled'),
    pt AS (SELECT b.*, 2021 AS year, tm.ldmc, tm.sla, tm.lma, tm.vheight, tm.lnc, mo.moisture,
                  my.arbuscule_occ, my.hypha_occ,
                  CASE WHEN b.combi_fac = 'AlpineControl' THEN a.t ELSE s.t END AS soil_temperature,
                  CASE WHEN b.combi_fac = 'AlpineControl' THEN a.g ELSE s.g END
                      AS growing_season_length
           FROM b LEFT JOIN tm ON b.combi_fac = tm.combi_fac AND b.rep = tm.rep AND tm.year = 2021
           LEFT JOIN mo ON b.combi_fac = mo.combi_fac AND b.rep = mo.rep
           LEFT JOIN my ON b.combi_fac = my.combi_fac AND b.rep = my.rep,
           (SELECT r_regionkey * 3.25::DOUBLE + 9 AS t, r_regionkey * 10.5::DOUBLE + 120 AS g
            FROM region WHERE r_name = 'ASIA') AS a,
           (SELECT r_regionkey * 3.25::DOUBLE + 9 AS t, r_regionkey * 10.5::DOUBLE + 120 AS g
            FROM region WHERE r_name = 'EUROPE') AS s)"""
_PLOT_VALUES = [
    *_BASE_COLUMNS, "ldmc", "sla", "lma", "vheight", "lnc", "moisture", "arbuscule_occ",
    "hypha_occ", "soil_temperature", "growing_season_length",
]


@query("plot_table", f"""
    WITH {_PLOTS}
    SELECT combi_fac, rep, year, {', '.join(f'round({c}, 5) AS {c}' for c in _PLOT_VALUES)}
    FROM pt""")
def plot_table(spark, folder):
    return rounded(_plot_table(spark, folder), 5, *_PLOT_VALUES)


# Derived variable: its SQL over the plot table; the first 16 are scaled as logs.
_GREEN = "(soil_tea_bag_green_mass_air_dry_2020 - soil_tea_bag_green_mass_dry_2021)" \
         " / soil_tea_bag_green_mass_air_dry_2020"
_RED = "(soil_tea_bag_red_mass_air_dry_2020 - soil_tea_bag_red_mass_dry_2021)" \
       " / soil_tea_bag_red_mass_air_dry_2020"
_TOTAL = "soil_tea_bag_green_mass_air_dry_2020 + soil_tea_bag_red_mass_air_dry_2020" \
         " - (soil_tea_bag_green_mass_dry_2021 + soil_tea_bag_red_mass_dry_2021)" \
         " / (soil_tea_bag_red_mass_air_dry_2020 + soil_tea_bag_green_mass_air_dry_2020)"
_DERIVED = {
    "lma": "lma", "lnc": "lnc", "rnc": "plant_below_n_concentration",
    "rtd": "plant_below_winrhizo_rtd", "srl": "plant_below_winrhizo_srl",
    "rd": "plant_below_winrhizo_diameter_average", "vh": "vheight",
    "above_productivity": "plant_up_aun",
    "below_productivity": "plant_below_whole_sample_mass_dry",
    "rate_green_teabag": _GREEN, "rate_red_teabag": _RED, "tot_decomp": _TOTAL,
    "ratio_decomp": f"({_GREEN}) / ({_RED})",
    "qpcr_root": "plant_below_qpcr_rdna_16s_copies_matrix_concentration",
    "qpcr_soil": "soil_qpcr_rdna_16s_copies_matrix_concentration",
    "tot_qpcr": "plant_below_qpcr_rdna_16s_copies_matrix_concentration"
                " + soil_qpcr_rdna_16s_copies_matrix_concentration",
    "arbuscule": "arbuscule_occ", "moisture": "moisture",
    "soil_nitrate": "soil_nitrate_concentration", "soil_p": "soil_p_concentration",
    "soil_om": "soil_om_concentration", "soil_temperature": "soil_temperature",
}
_FILLED_SUBALPINE = ("srl", "rd", "rnc", "rtd", "below_productivity", "qpcr_root", "qpcr_soil",
                     "tot_qpcr", "arbuscule")
_FILLED_ALPINE = ("rate_green_teabag", "tot_decomp", "tot_qpcr", "qpcr_root")


def derived_ctes(scaled):
    """``dv``: the derived variables of the plots ``pt``, not rounded."""
    names = list(_DERIVED)
    raw, z, filled = [], [], []
    for i, name in enumerate(names):
        e = _DERIVED[name]
        raw.append(f"ln(CASE WHEN {e} > 0 THEN {e} END) AS {name}" if scaled and i < 16
                   else f"{e} AS {name}")
        z.append(f"({name} - avg({name}) OVER ()) / nullif(stddev_samp({name}) OVER (), 0) AS {name}"
                 if scaled else name)
        groups = [g for g, cols in (("SubalpineControl", _FILLED_SUBALPINE),
                                    ("AlpineControl", _FILLED_ALPINE)) if name in cols]
        cases = " ".join(
            f"WHEN combi_fac = '{g}' THEN coalesce({name}, avg({name}) OVER (PARTITION BY combi_fac))"
            for g in groups
        )
        filled.append(f"CASE {cases} ELSE {name} END AS {name}" if cases else name)
    return f"""raw AS (SELECT combi_fac, rep, {', '.join(raw)} FROM pt),
    z_raw AS (SELECT combi_fac, rep, {', '.join(z)} FROM raw),
    dv AS (SELECT combi_fac, rep, {', '.join(filled)} FROM z_raw)"""


def _derived_sql(scaled):
    return f"""
    WITH {_PLOTS},
    {derived_ctes(scaled)}
    SELECT combi_fac, rep, {', '.join(f'round({name}, 6) AS {name}' for name in _DERIVED)} FROM dv"""


@query("derived_scaled", _derived_sql(True))
def derived_scaled(spark, folder):
    return rounded(plots.derive(_plot_table(spark, folder), True), 6, *_DERIVED)


@query("derived_unscaled", _derived_sql(False))
def derived_unscaled(spark, folder):
    return rounded(plots.derive(_plot_table(spark, folder), False), 6, *_DERIVED)


# ---------------------------------------------------------------- effect sizes

_MEMBERS = {"A to N": ("A", "N"), "N to R": ("N", "R")}
_NAMES = {"quantity": "lma", "price": "vh", "discount": "soil_p_concentration"}


def _effects(spark, folder):
    moments = scratch.stored(models._moments(spark, folder), "moments")
    moments = moments.replace(_NAMES, subset=["var"])
    means = effects.annotate(linmodel.marginal_means(moments))
    contrasts = effects.annotate(linmodel.planned_contrasts(moments, models._CONTRASTS))
    return effects.effect_table(means, contrasts, ["A", "N", "R"], _MEMBERS, ("A", "R"))


_EFFECTS = f"""
    WITH {models._FIT},
    named AS (SELECT *, CASE var WHEN 'quantity' THEN 'LMA' WHEN 'price' THEN 'VH'
                       WHEN 'discount' THEN 'Total P concentration' ELSE var END AS label,
                     CASE var WHEN 'quantity' THEN 'Conservation gradient'
                       WHEN 'price' THEN 'Plant size' END AS type,
                     CASE var WHEN 'quantity' THEN 2 WHEN 'price' THEN 1 END AS type_order,
                     CASE WHEN var IN ('quantity', 'price') THEN 'Aboveground' ELSE 'soil' END
                         AS plant,
                     CASE WHEN var IN ('quantity', 'price') THEN 'Functional traits'
                          WHEN var = 'discount' THEN 'EC' ELSE 'ES' END AS es
              FROM fit),
    pair AS (SELECT a.var, a.grp AS g1, b.grp AS g2, b.mean - a.mean AS est,
                    (b.mean - a.mean) / sqrt(a.s2 * (1.0::DOUBLE / a.n + 1.0::DOUBLE / b.n)) AS t,
                    a.df
             FROM fit a JOIN fit b ON a.var = b.var
                  AND (a.grp, b.grp) IN (('A', 'N'), ('N', 'R'))),
    rho AS (SELECT var, -(1.0::DOUBLE / nn) / sqrt((1.0::DOUBLE / na + 1.0::DOUBLE / nn)
                    * (1.0::DOUBLE / nn + 1.0::DOUBLE / nr)) AS rho
            FROM (SELECT var, any_value(n) FILTER (grp = 'A') AS na,
                         any_value(n) FILTER (grp = 'N') AS nn, any_value(n) FILTER (grp = 'R') AS nr
                  FROM fit GROUP BY var)),
    con AS (SELECT pair.*, g1 || ' to ' || g2 AS contrast, {models._JOINT_TAIL} AS p
            FROM pair JOIN rho USING (var)),
    member AS (SELECT var, g1 AS grp, contrast, est, p FROM con
               UNION ALL SELECT var, g2, contrast, est, p FROM con),
    eff AS (SELECT label AS var, named.grp, n, round(mean, 8) AS estimate, type, type_order, plant, es,
                   contrast, round(abs(est), 8) AS magnitude,
                   CASE WHEN p >= 0.05 THEN 'ns' WHEN p < 0.05 THEN '*' END AS mark,
                   CASE named.grp WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS grp_order
            FROM named LEFT JOIN member ON named.var = member.var AND named.grp = member.grp)"""
_EFFECT_COLUMNS = ["var", "grp", "n", "estimate", "type", "type_order", "plant", "es", "contrast",
                   "magnitude", "mark", "grp_order"]


@query("effect_sizes", f"{_EFFECTS} SELECT {', '.join(_EFFECT_COLUMNS)} FROM eff")
def effect_sizes(spark, folder):
    return rounded(_effects(spark, folder).select(*_EFFECT_COLUMNS), 8, "estimate", "magnitude")


@query("effect_segments", f"""{_EFFECTS}
    SELECT {', '.join(_EFFECT_COLUMNS)} FROM eff
    WHERE grp IN ('A', 'N') AND contrast = 'A to N'""")
def effect_segments(spark, folder):
    out = effects.segments(_effects(spark, folder), "A to N", ("A", "N"))
    return rounded(out.select(*_EFFECT_COLUMNS), 8, "estimate", "magnitude")


def _batch_sql(source, variables):
    """``fit`` of each variable of ``source(combi_fac, ...)`` by treatment, and ``dims`` of all variables."""
    rows = " UNION ALL ".join(f"SELECT combi_fac AS grp, '{x}' AS var, {x}::DOUBLE AS x FROM {source}" for x in variables)

    def text(value):
        return "NULL" if value is None else f"'{value}'"

    dims = ", ".join(f"({', '.join(map(text, row))})" for row in v.VARIABLES)
    order = " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(v.TYPE_LEVELS, 1))
    return f"""
    lines AS ({rows}),
    m AS (SELECT var, grp, count(x) AS n, avg(x) AS mean, var_samp(x) AS variance FROM lines WHERE x IS NOT NULL GROUP BY ALL),
    c AS (SELECT *, count(*) OVER w AS k, CAST(sum(n) OVER w AS BIGINT) AS nobs,
                 sum((n - 1) * variance) OVER w AS sse, sum(n * mean) OVER w / sum(n) OVER w AS gm
          FROM m WINDOW w AS (PARTITION BY var)),
    c2 AS (SELECT *, nobs - k AS df, sum(n * (mean - gm) * (mean - gm)) OVER (PARTITION BY var) AS ssb FROM c),
    fit AS (SELECT *, CASE WHEN sse > {linmodel._PERFECT} * (sse + ssb) THEN sse / (nobs - k) END AS s2 FROM c2),
    dims AS (SELECT var, label, type, CASE type {order} END AS type_order, plant, es
             FROM (VALUES {dims}) AS d(var, label, type, plant, es))"""


def _batch_effects_sql(source, variables):
    """``eff``: group means with the contrasts each group takes part in."""
    first, second = (f"('{a}', '{b}')" for a, b in (("AlpineControl", "AlpineWarmed"), ("AlpineWarmed", "SubalpineControl")))
    order = " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(v.TREATMENTS, 1))
    return f"""{_batch_sql(source, variables)},
    pair AS (SELECT a.var, a.grp AS g1, b.grp AS g2, b.mean - a.mean AS est, a.df,
                    (b.mean - a.mean) / sqrt(a.s2 * (1.0::DOUBLE / a.n + 1.0::DOUBLE / b.n)) AS t
             FROM fit a JOIN fit b ON a.var = b.var AND (a.grp, b.grp) IN ({first}, {second})),
    rho AS (SELECT var, -(1.0::DOUBLE / nn) / sqrt((1.0::DOUBLE / na + 1.0::DOUBLE / nn) * (1.0::DOUBLE / nn + 1.0::DOUBLE / nr)) AS rho
            FROM (SELECT var, any_value(n) FILTER (grp = 'AlpineControl') AS na, any_value(n) FILTER (grp = 'AlpineWarmed') AS nn,
                         any_value(n) FILTER (grp = 'SubalpineControl') AS nr FROM fit GROUP BY var)),
    con AS (SELECT pair.*, CASE g1 WHEN 'AlpineControl' THEN 'Warming effect' ELSE 'Warming lag' END AS contrast, {models._JOINT_TAIL} AS p
            FROM pair JOIN rho USING (var)),
    member AS (SELECT var, g1 AS grp, contrast, est, p FROM con UNION ALL SELECT var, g2, contrast, est, p FROM con),
    eff AS (SELECT coalesce(label, fit.var) AS var, fit.grp, n, CASE WHEN abs(mean) < 5e-7 THEN 0.0::DOUBLE ELSE round(mean, 6) END AS estimate, round(sqrt(s2 / n), 6) AS std_error,
                   type, type_order, coalesce(plant, 'soil') AS plant, coalesce(es, 'ES') AS es, contrast, round(abs(est), 6) AS magnitude,
                   CASE WHEN p >= 0.05 THEN 'ns' WHEN p < 0.05 THEN '*' END AS mark, CASE fit.grp {order} END AS grp_order
            FROM fit LEFT JOIN member ON fit.var = member.var AND fit.grp = member.grp LEFT JOIN dims ON fit.var = dims.var)"""


_BATCH_COLUMNS = ["var", "grp", "n", "estimate", "std_error", "type", "type_order", "plant", "es", "contrast", "magnitude", "mark",
                  "grp_order"]
_STRESS_NAME = " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in v.STRESS_LABELS.items())
_STRESS_ORDER = " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(v.STRESS_LABELS, 1))


def _batch(rows, variables):
    fit = linmodel.fit_one_way(rows, "combi_fac", variables, v.CONTRASTS)
    out = effects.effect_table(effects.annotate(fit.means), effects.annotate(fit.contrasts))
    # no negative zero after rounding
    whole = F.when(F.abs("estimate") < 5e-7, 0.0).otherwise(F.col("estimate"))
    return rounded(out.withColumn("estimate", whole), 6, "estimate", "std_error", "magnitude")


@query("stress_effects", f"""
    WITH {_PLOTS},
    {_batch_effects_sql("pt", v.STRESS_VARIABLES)}
    SELECT CASE var {_STRESS_NAME} END AS var, CASE var {_STRESS_ORDER} END AS var_order, {", ".join(_BATCH_COLUMNS[1:])} FROM eff""")
def stress_effects(spark, folder):
    """Means, errors and contrasts of the stress conditions over the plot table."""
    out = effects.label_stress_conditions(_batch(_plot_table(spark, folder), v.STRESS_VARIABLES))
    return out.select("var", "var_order", *_BATCH_COLUMNS[1:])


def _responses(spark, folder, scaled):
    return plots.analysis_groups(plots.derive(_plot_table(spark, folder), scaled))


def _responses_sql(scaled):
    return f"""
    WITH {_PLOTS},
    {derived_ctes(scaled)},
    {_batch_effects_sql("dv", v.RESPONSE_VARIABLES)}
    SELECT {", ".join(_BATCH_COLUMNS)} FROM eff"""


@query("response_effects", _responses_sql(True))
def response_effects(spark, folder):
    """The same for the standardised responses."""
    return _batch(_responses(spark, folder, True), v.RESPONSE_VARIABLES).select(*_BATCH_COLUMNS)


@query("response_effects_unscaled", _responses_sql(False))
def response_effects_unscaled(spark, folder):
    """The same in the responses' own units."""
    return _batch(_responses(spark, folder, False), v.RESPONSE_VARIABLES).select(*_BATCH_COLUMNS)


@query("response_models", f"""
    WITH {_PLOTS},
    {derived_ctes(False)},
    {_batch_sql("dv", v.RESPONSE_VARIABLES)},
    g AS (SELECT DISTINCT var, k, nobs, df, sse, ssb, s2 FROM fit)
    SELECT coalesce(label, g.var) AS var, type, type_order, coalesce(plant, 'soil') AS plant, coalesce(es, 'ES') AS es,
           round(ssb / nullif(sse + ssb, 0), 8) AS r_squared,
           round(1 - sse / nullif(sse + ssb, 0) * (nobs - 1) / df, 8) AS adj_r_squared,
           round(ssb / (k - 1) / s2, 5) AS statistic, nobs, df AS df_residual,
           round(exp(-df / 2.0::DOUBLE * ln(1 + 2 * (ssb / (k - 1) / s2) / df)), 8) AS p_value
    FROM g LEFT JOIN dims ON g.var = dims.var""")
def response_models(spark, folder):
    """The fit of each response in its own unit, with the classes of its variable."""
    fit = linmodel.fit_one_way(_responses(spark, folder, False), "combi_fac", v.RESPONSE_VARIABLES, v.CONTRASTS)
    out = effects.annotate(fit.models).select(
        "var", "type", "type_order", "plant", "es", "r_squared", "adj_r_squared", "statistic", "nobs", "df_residual", "p_value")
    return rounded(rounded(out, 8, "r_squared", "adj_r_squared", "p_value"), 5, "statistic")


# ---------------------------------------------------------------- ordination tables

_TERM_LABELS = {"x1": "First", "x2": "Second", "Residual": "Residuals"}
_TERM_LEVELS = ["Second", "First", "Residuals"]


@query("variance_partition", models._suppliers_sql(models._TERM_DRAWS) + f""",
    terms AS ({models._terms_sql(12, ["x1", "x2"])}),
    named AS (SELECT CASE term WHEN 'x1' THEN 'First' WHEN 'x2' THEN 'Second' ELSE 'Residuals' END
                     AS term,
                 CASE term WHEN 'x2' THEN 1 WHEN 'x1' THEN 2 ELSE 3 END AS level_order,
                 prop, CASE WHEN p_value < 0.05 THEN '*' ELSE '' END AS mark
          FROM terms),
    q AS (SELECT *, sum(prop) OVER (ORDER BY level_order DESC ROWS UNBOUNDED PRECEDING) AS cumsum
          FROM named)
    SELECT term, level_order, mark, round(prop, 7) AS prop, round(cumsum, 7) AS cumsum,
           round(cumsum - prop / 2, 7) AS pos,
           CASE WHEN prop >= 0.01
                THEN term || ' ' || mark || ' ' || chr(10) || ' ' || printf('%.2f%%', prop * 100) END
               AS label
    FROM q""")
def variance_partition(spark, folder):
    out = partition.variance_partition(models._terms(spark, folder), _TERM_LABELS, _TERM_LEVELS)
    return rounded(out, 7, "prop", "cumsum", "pos")


def _line_tables(spark, folder):
    rows = models._measures(spark, folder)
    fit = ordination.redundancy(rows, models._OUTCOMES, models._TERMS)
    return partition.ordination_tables(fit, rows, "l_returnflag")


@query("site_centroids", f"""{models._SPECIES},
    mid AS (SELECT avg(turnover) AS mp, avg(reduction) AS md FROM m),
    sc AS (SELECT l_returnflag,
                  ((turnover - mp) * p1 + (reduction - md) * d1) / sqrt(e1) AS r1,
                  ((turnover - mp) * p2 + (reduction - md) * d2) / sqrt(e2) AS r2
           FROM m, v, mid)
    SELECT l_returnflag, round(avg(r1), 3) AS mean_rda1, round(avg(r2), 3) AS mean_rda2
    FROM sc GROUP BY ALL""")
def site_centroids(spark, folder):
    return rounded(_line_tables(spark, folder).centroids, 3, "mean_rda1", "mean_rda2")


@query("response_contributions", f"""{models._SPECIES}
    SELECT 'turnover' AS var, round_even(p1 * p1 * 100, 2) AS rda1, round_even(p2 * p2 * 100, 2) AS rda2
    FROM v UNION ALL
    SELECT 'reduction', round_even(d1 * d1 * 100, 2), round_even(d2 * d2 * 100, 2) FROM v""")
def response_contributions(spark, folder):
    return _line_tables(spark, folder).response_contributions


@query("term_contributions", f"""{models._BIPLOT}
    SELECT var, round_even(rda1 * rda1 / sum(rda1 * rda1) OVER () * 100, 2) AS rda1,
           round_even(rda2 * rda2 / sum(rda2 * rda2) OVER () * 100, 2) AS rda2 FROM bi""")
def term_contributions(spark, folder):
    return _line_tables(spark, folder).term_contributions
