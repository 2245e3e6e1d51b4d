"""The experiment's ordinations end to end, over plots that grow in number with the data.

A plot is a supplier's lines under one treatment; its measures are means and deviations
over them, with gaps as in the field.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ordination, permute
from ..plans import partition, plots, vocabulary as v
from ..sources.scratch import stored
from . import composites, models
from .matrix_sql import eigen, eliminated, fitted, moments, places, two_components
from .registry import query, rounded, table

# Plot column: its expression over line items, the same in both engines.
_MEASURED = {
    "lma": "avg(l_extendedprice / 1000)", "lnc": "avg(l_discount * 100 + 1)", "vheight": "avg(l_quantity)",
    "plant_below_n_concentration": "avg(l_tax * l_quantity)",
    "plant_below_winrhizo_rtd": "avg(l_discount * l_tax * 100)",
    "plant_below_winrhizo_srl": "stddev_samp(l_extendedprice / 1000)",
    "plant_below_winrhizo_diameter_average": "stddev_samp(l_discount)",
    "plant_up_aun": "stddev_samp(l_quantity)",
    "plant_below_whole_sample_mass_dry": "stddev_samp(l_tax * l_quantity)",
    "soil_tea_bag_green_mass_air_dry_2020": "avg(l_quantity * l_quantity)",
    "soil_tea_bag_green_mass_dry_2021": "avg(l_quantity * l_quantity * (0.3 + l_discount))",
    "soil_tea_bag_red_mass_air_dry_2020": "avg(l_extendedprice / 1000)",
    "soil_tea_bag_red_mass_dry_2021": "avg(l_extendedprice / 1000 * (0.5 + l_tax))",
    "plant_below_qpcr_rdna_16s_copies_matrix_concentration": "avg(l_linenumber * l_quantity)",
    "soil_qpcr_rdna_16s_copies_matrix_concentration": "avg(l_extendedprice * l_tax)",
    "soil_p_concentration": "avg(l_discount * l_extendedprice)",
    "soil_nitrate_concentration": "avg(l_tax * l_linenumber)",
    "soil_om_concentration": "avg(l_tax * l_discount)",
    "arbuscule_occ": "avg(l_linenumber * l_linenumber)",
    "moisture": "stddev_samp(l_linenumber * l_discount)",
}
# Plot column: the suppliers, modulo 7, where it was not measured.
_MISSING = {
    "plant_below_winrhizo_srl": 3, "plant_below_winrhizo_rtd": 3,
    "plant_below_qpcr_rdna_16s_copies_matrix_concentration": 5, "soil_om_concentration": 6,
}
_TEMPERATURE = "CASE WHEN combi_fac = 'AlpineControl' THEN 12.5 ELSE 15.75 END"


def _plots(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        F.expr(composites._GROUP).alias("combi_fac"), "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax",
    ).where("combi_fac <> 'SubalpineCooled'")
    means = rows.groupBy("combi_fac", "l_suppkey").agg(*[F.expr(e).alias(c) for c, e in _MEASURED.items()])
    gaps = {c: F.when(F.col("l_suppkey") % 7 != k, F.col(c)) for c, k in _MISSING.items()}
    gaps |= {"rep": F.col("l_suppkey").cast("string"), "soil_temperature": F.expr(_TEMPERATURE).cast("double")}
    return means.withColumns(gaps).drop("l_suppkey")


def _derived(spark, folder):
    """Stored, because every analysis passes over it again."""
    return stored(plots.analysis_groups(plots.derive(stored(_plots(spark, folder), "plots"))), "derived")


_CELLS = ", ".join(f"CASE WHEN l_suppkey % 7 <> {_MISSING[c]} THEN {e} END AS {c}" if c in _MISSING else f"{e} AS {c}"
                   for c, e in _MEASURED.items())
_DERIVED = f"""pt AS (
      SELECT *, ({_TEMPERATURE})::DOUBLE AS soil_temperature FROM (
        SELECT combi_fac, CAST(l_suppkey AS VARCHAR) AS rep, {_CELLS}
        FROM (SELECT *, {composites._GROUP} AS combi_fac FROM lineitem)
        WHERE combi_fac <> 'SubalpineCooled' GROUP BY combi_fac, l_suppkey)),
    {composites.derived_ctes(True)}"""


# ---------------------------------------------------------------- SQL of a redundancy analysis


def _fit_sql(source, columns, responses, rows="full_rows"):
    """``el``, ``fi`` and ``ei``: the fit of ``rows``, which ``source`` defines."""
    q, p = len(columns), len(columns) + len(responses)
    complete = " AND ".join(f"{c} IS NOT NULL" for c in [*columns, *responses])
    return f"""
    WITH RECURSIVE {source},
    used AS (SELECT * FROM {rows} WHERE {complete}),
    {moments("used", [*columns, *responses])},
    {eliminated(q, p)},
    {fitted(q, p)},
    {eigen(len(responses), "fi_matrix")}"""


def _ranks(blocks):
    return {name: " + ".join(f"(m[{j}][{j}] > 1e-9 * c[{j}][{j}])::BIGINT" for j in own) for name, own in blocks}


def _terms_sql(source, columns, responses, blocks, draws, rid, digits=8, rows="full_rows"):
    """``tested``: the sequential test of each block of columns, by free permutation.

    ``blocks`` are (term, places of its columns, from 1); ``rid`` is the text that identifies a row.
    """
    q = len(columns)
    at = {c: i for i, c in enumerate([*columns, *responses], 1)}

    def z(j):
        total = " + ".join(f"t[{j}][{u}] * ({c} - mean[{u}])" for u, c in enumerate(columns[:j], 1))
        return f"CASE WHEN m[{j}][{j}] > 1e-9 * c[{j}][{j}] THEN ({total}) / sqrt(m[{j}][{j}] * (n - 1)) ELSE 0 END AS z{j}"

    zs, cs = ", ".join(z(j) for j in range(1, q + 1)), ", ".join(f"{y} - mean[{at[y]}] AS c_{y}" for y in responses)
    paired = ", ".join(f"sum(stay.z{j} * swap.c_{y}) AS s{j}_{y}" for j in range(1, q + 1) for y in responses)
    seen = ", ".join(f"sum(z{j} * c_{y}) AS s{j}_{y}" for j in range(1, q + 1) for y in responses)

    def squares(own):
        return " + ".join(f"s{j}_{y} * s{j}_{y}" for j in own for y in responses)

    ranks = _ranks(blocks)
    each = ", ".join(f"{squares(own)} AS ss_{k}" for k, (_, own) in enumerate(blocks))
    old = ", ".join(f"o.ss_{k} AS o_{k}" for k in range(len(blocks)))
    total = " + ".join(f"c[{at[y]}][{at[y]}]" for y in responses)
    whole = " + ".join(f"ss_{k}" for k in range(len(blocks)))
    before = " + ".join(f"o_{k}" for k in range(len(blocks)))
    rank = ", ".join(f"{r} AS r_{k}" for k, r in enumerate(ranks.values()))
    degrees = " + ".join(f"r_{k}" for k in range(len(blocks)))
    rows_sql = [f"""
      SELECT {k + 1} AS ord, '{name}' AS term, any_value(r_{k}) AS df,
        CASE WHEN any_value(r_{k}) > 0 THEN round(any_value(o_{k} / (n - 1)), {digits}) END AS variance,
        CASE WHEN any_value(r_{k}) > 0 THEN round(any_value(o_{k} / r_{k} / oe), 5) END AS statistic,
        CASE WHEN any_value(r_{k}) > 0 THEN (1 + count(*) FILTER (ss_{k} / r_{k} / pe >= o_{k} / r_{k} / oe * (1 - 1e-9)))
          / (count(*) + 1)::DOUBLE END AS p_value,
        CASE WHEN any_value(r_{k}) > 0 THEN round(any_value(o_{k} / sst), 8) END AS prop FROM both_sums""" for k, (name, _) in enumerate(blocks)]
    rows_sql.append(f"""
      SELECT {len(blocks) + 1}, 'Residual', any_value(df), round(any_value((sst - ({before})) / (n - 1)), {digits}), NULL, NULL,
        round(any_value((sst - ({before})) / sst), 8) FROM both_sums""")
    return f"""{_fit_sql(source, columns, responses, rows)},
    zs AS (SELECT {rid} AS rid, '' AS st, {zs}, {cs} FROM used, el),
    {places("zs", draws, models._SEED, [f"c_{y}" for y in responses])},
    ps AS (SELECT b, {paired} FROM swap JOIN stay USING (pos) GROUP BY b),
    p AS (SELECT b, {each} FROM ps),
    o AS (SELECT {each} FROM (SELECT {seen} FROM zs)),
    facts AS (SELECT n, {rank}, ({total}) * (n - 1) AS sst FROM el),
    known_sums AS (SELECT *, n - 1 - ({degrees}) AS df FROM (SELECT facts.*, {old} FROM facts, o)),
    both_sums AS (SELECT *, (sst - ({before})) / df AS oe, (sst - ({whole})) / df AS pe FROM known_sums, p),
    tested AS ({" UNION ALL ".join(rows_sql)})"""


def _partition_sql(labels, levels):
    """Shares by term label, running over the levels from the last."""
    named = " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in labels.items())
    order = " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(levels, 1))
    return f""",
    named AS (SELECT CASE term {named} ELSE term END AS term, prop, CASE WHEN p_value < 0.05 THEN '*' ELSE '' END AS mark FROM tested),
    placed AS (SELECT *, CASE term {order} END AS level_order FROM named),
    running AS (SELECT *, sum(prop) OVER (ORDER BY level_order DESC ROWS UNBOUNDED PRECEDING) AS cumsum FROM placed)
    SELECT term, level_order, mark, round(prop, 6) AS prop, round(cumsum, 6) AS cumsum, round(cumsum - prop / 2, 6) AS pos,
           CASE WHEN prop >= 0.01 THEN term || ' ' || mark || ' ' || chr(10) || ' ' || printf('%.2f%%', prop * 100) END AS label
    FROM running"""


_SCORES = """,
    sites AS (SELECT combi_fac, rep, axis,
                     list_inner_product(list_transform(range(1, len(v) + 1), lambda y: [{ys}][y] - mean[{q} + y]), v) / sqrt(value) AS score
              FROM used, el, ei WHERE axis <= 2)"""


def _sites_sql(columns, responses):
    return _SCORES.format(ys=", ".join(responses), q=len(columns)) + """
    SELECT combi_fac, rep, round(any_value(score) FILTER (axis = 1), 5) AS rda1, round(any_value(score) FILTER (axis = 2), 5) AS rda2
    FROM sites GROUP BY combi_fac, rep"""


def _centroids_sql(columns, responses):
    return _SCORES.format(ys=", ".join(responses), q=len(columns)) + """
    SELECT combi_fac, round(avg(score) FILTER (axis = 1), 5) AS mean_rda1, round(avg(score) FILTER (axis = 2), 5) AS mean_rda2
    FROM sites GROUP BY combi_fac"""


def _responses_sql(responses):
    names = "[" + ", ".join(f"'{y}'" for y in responses) + "]"
    return f"""
    SELECT {names}[y] AS var, round_even(any_value(v[y] * v[y]) FILTER (axis = 1) * 100, 2) AS rda1,
           round_even(any_value(v[y] * v[y]) FILTER (axis = 2) * 100, 2) AS rda2
    FROM ei, range(1, {len(responses) + 1}) AS responses(y) GROUP BY y"""


def _columns_sql(columns, responses, names):
    """Contributions of the predictors, from their correlations with the axes."""
    q, m = len(columns), len(responses)
    along = f"list_sum(list_transform(range(1, {m + 1}), lambda y: m[j][{q} + y] * v[y])) / sqrt(m[j][j] * value)"
    labels = "[" + ", ".join(f"'{names.get(c, c)}'" for c in columns) + "]"
    return f""",
    u AS (SELECT j, axis, {along} AS u FROM el, ei, range(1, {q + 1}) AS predictors(j) WHERE axis <= 2 AND m[j][j] > 1e-9 * c[j][j]),
    score AS (SELECT {labels}[x] AS var, axis, sum(m[j][x] / sqrt(m[j][j] * c[x][x]) * u) AS s
              FROM u, el, range(1, {q + 1}) AS predictors(x) WHERE j <= x AND m[x][x] > 1e-9 * c[x][x] GROUP BY x, axis),
    shares AS (SELECT var, axis, s * s / sum(s * s) OVER (PARTITION BY axis) * 100 AS share FROM score)
    SELECT var, round_even(any_value(share) FILTER (axis = 1), 2) AS rda1, round_even(any_value(share) FILTER (axis = 2), 2) AS rda2
    FROM shares GROUP BY var"""


def _r_squared_sql(columns, responses):
    q = len(columns)
    rank = " + ".join(f"(m[{j}][{j}] > 1e-9 * c[{j}][{j}])::BIGINT" for j in range(1, q + 1))
    total = " + ".join(f"c[{q + y}][{q + y}]" for y in range(1, len(responses) + 1))
    fit = " + ".join(f"a[{y}][{y}]" for y in range(1, len(responses) + 1))
    return f""",
    r AS (SELECT n, {rank} AS q, {total} AS total, {fit} AS fit FROM el, fi_matrix)
    SELECT round(fit, 7) AS constrained, round(total, 7) AS total, round(fit / total, 8) AS r_squared,
           round(1 - (1 - fit / total) * (n - 1) / (n - 1 - q), 8) AS adj_r_squared FROM r"""


# ---------------------------------------------------------------- functions on traits and climate change

_INTERACTIONS = {f"{t}_ecc": f"{t}:ecc" for t in v.TRAITS}
_FUNCTION_COLUMNS = [*v.TRAITS, "ecc", *_INTERACTIONS]
_FUNCTION_ROWS = f"""{_DERIVED},
    marked AS (SELECT *, CASE WHEN combi_fac IN ('AlpineControl', 'SubalpineControl') THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS ecc
               FROM dv),
    full_rows AS (SELECT *, {", ".join(f"{t} * ecc AS {t}_ecc" for t in v.TRAITS)} FROM marked)"""
_FUNCTION_FIT = _fit_sql(_FUNCTION_ROWS, _FUNCTION_COLUMNS, v.FUNCTIONS)
_RID = "length(combi_fac) || ':' || combi_fac || length(rep) || ':' || rep"


def _singles(columns, names=None):
    return [((names or {}).get(c, c), [i]) for i, c in enumerate(columns, 1)]


def _functions(spark, folder):
    return partition.function_model(_derived(spark, folder))


_FUNCTION_TESTED = _terms_sql(
    _FUNCTION_ROWS, _FUNCTION_COLUMNS, v.FUNCTIONS, _singles(_FUNCTION_COLUMNS, _INTERACTIONS), models._TERM_DRAWS, _RID)


def _partition(fit, rows, labels, levels):
    sums = permute.permuted_sums(fit, rows, ["combi_fac", "rep"], models._TERM_DRAWS, models._SEED)
    out = partition.variance_partition(permute.terms_test(fit, sums), labels, levels)
    return rounded(out, 6, "prop", "cumsum", "pos")


@query("function_partition", _FUNCTION_TESTED + _partition_sql(v.FUNCTION_TERM_LABELS, v.FUNCTION_TERM_LEVELS))
def function_partition(spark, folder):
    """Functions on traits, climate change and interactions: 15 terms, tested one after the other."""
    return _partition(*_functions(spark, folder), v.FUNCTION_TERM_LABELS, v.FUNCTION_TERM_LEVELS)


@query("function_terms", _FUNCTION_FIT + " " + " UNION ALL ".join(
    f"SELECT {i} AS ord, '{name}' AS term, {r} AS df, {r} = 0 AS aliased, n FROM el"
    for i, (name, r) in enumerate(_ranks(_singles(_FUNCTION_COLUMNS, _INTERACTIONS)).items(), 1)))
def function_terms(spark, folder):
    """Rank of each term and whether earlier ones determine it, with the number of complete rows."""
    return _functions(spark, folder)[0].terms_table()


@query("function_rsquare", _FUNCTION_FIT + _r_squared_sql(_FUNCTION_COLUMNS, v.FUNCTIONS))
def function_rsquare(spark, folder):
    out = _functions(spark, folder)[0].r_squared()
    return rounded(rounded(out, 7, "constrained", "total"), 8, "r_squared", "adj_r_squared")


def _function_tables(spark, folder):
    fit, rows = _functions(spark, folder)
    return partition.ordination_tables(fit, rows, "combi_fac", ["rep"])


@query("function_sites", _FUNCTION_FIT + _sites_sql(_FUNCTION_COLUMNS, v.FUNCTIONS))
def function_sites(spark, folder):
    return rounded(_function_tables(spark, folder).sites, 5, "rda1", "rda2")


@query("function_centroids", _FUNCTION_FIT + _centroids_sql(_FUNCTION_COLUMNS, v.FUNCTIONS))
def function_centroids(spark, folder):
    return rounded(_function_tables(spark, folder).centroids, 5, "mean_rda1", "mean_rda2")


@query("function_contributions", _FUNCTION_FIT + _responses_sql(v.FUNCTIONS))
def function_contributions(spark, folder):
    return _function_tables(spark, folder).response_contributions


@query("function_term_contributions", _FUNCTION_FIT + _columns_sql(_FUNCTION_COLUMNS, v.FUNCTIONS, _INTERACTIONS))
def function_term_contributions(spark, folder):
    return _function_tables(spark, folder).term_contributions


# ---------------------------------------------------------------- traits on site conditions

_STRESS_ROWS = f"{_DERIVED}, full_rows AS (SELECT * FROM dv WHERE combi_fac IN ('AlpineWarmed', 'AlpineControl'))"
_STRESS_FIT = _fit_sql(_STRESS_ROWS, v.SITE_CONDITIONS, v.TRAITS)
_STRESS_TESTED = _terms_sql(
    _STRESS_ROWS, v.SITE_CONDITIONS, v.TRAITS, _singles(v.SITE_CONDITIONS), models._TERM_DRAWS, _RID)


def _stress(spark, folder):
    return partition.stress_model(_derived(spark, folder))


@query("stress_partition", _STRESS_TESTED + _partition_sql(v.STRESS_TERM_LABELS, v.STRESS_TERM_LEVELS))
def stress_partition(spark, folder):
    """Traits on the conditions of the site, over warmed and control alpine plots."""
    return _partition(*_stress(spark, folder), v.STRESS_TERM_LABELS, v.STRESS_TERM_LEVELS)


@query("stress_rsquare", _STRESS_FIT + _r_squared_sql(v.SITE_CONDITIONS, v.TRAITS))
def stress_rsquare(spark, folder):
    out = _stress(spark, folder)[0].r_squared()
    return rounded(rounded(out, 7, "constrained", "total"), 8, "r_squared", "adj_r_squared")


def _stress_tables(spark, folder):
    fit, rows = _stress(spark, folder)
    return partition.ordination_tables(fit, rows, "combi_fac", ["rep"])


@query("stress_sites", _STRESS_FIT + _sites_sql(v.SITE_CONDITIONS, v.TRAITS))
def stress_sites(spark, folder):
    return rounded(_stress_tables(spark, folder).sites, 5, "rda1", "rda2")


@query("stress_centroids", _STRESS_FIT + _centroids_sql(v.SITE_CONDITIONS, v.TRAITS))
def stress_centroids(spark, folder):
    return rounded(_stress_tables(spark, folder).centroids, 5, "mean_rda1", "mean_rda2")


@query("stress_contributions", _STRESS_FIT + _responses_sql(v.TRAITS))
def stress_contributions(spark, folder):
    return _stress_tables(spark, folder).response_contributions


@query("stress_term_contributions", _STRESS_FIT + _columns_sql(v.SITE_CONDITIONS, v.TRAITS, {}))
def stress_term_contributions(spark, folder):
    return _stress_tables(spark, folder).term_contributions


# ---------------------------------------------------------------- components of the control plots

_CONTROLS = f"""
    WITH RECURSIVE {_DERIVED},
    used AS (SELECT * FROM dv WHERE combi_fac IN ('SubalpineControl', 'AlpineControl')
             AND {" AND ".join(f"{t} IS NOT NULL" for t in v.TRAITS)}),
    {two_components("used", v.TRAITS)}"""
_CONTROL_SCORES = f"""{_CONTROLS},
    weights AS (SELECT list(w1 ORDER BY i) AS w1, list(w2 ORDER BY i) AS w2 FROM rc),
    scores AS (SELECT combi_fac, rep, list_inner_product(d, w1) AS rc1, list_inner_product(d, w2) AS rc2
               FROM (SELECT combi_fac, rep, [{", ".join(f"{t} - mean[{i}]" for i, t in enumerate(v.TRAITS, 1))}] AS d FROM used, mo), weights)"""


def _controls(spark, folder):
    return partition.control_components(_derived(spark, folder))


@query("control_loadings", f"""{_CONTROLS}
    SELECT [{", ".join(f"'{t}'" for t in v.TRAITS)}][i] AS variable, round(l1, 6) AS rc1, round(l2, 6) AS rc2,
           CASE WHEN i IN ({", ".join(str(i) for i, t in enumerate(v.TRAITS, 1) if t in v.ABOVE_GROUND)})
                THEN 'Above-ground traits' ELSE 'Below-ground traits' END AS type FROM rc""")
def control_loadings(spark, folder):
    """Rotated loadings of the traits over the two control groups, by the part of the plant."""
    return rounded(_controls(spark, folder).loadings, 6, "rc1", "rc2")


@query("control_scores", f"{_CONTROL_SCORES} SELECT combi_fac, rep, round(rc1, 5) AS rc1, round(rc2, 5) AS rc2 FROM scores")
def control_scores(spark, folder):
    return rounded(_controls(spark, folder).scores, 5, "rc1", "rc2")


@query("control_centroids", f"""{_CONTROL_SCORES}
    SELECT combi_fac, round(avg(rc1), 5) AS mean_rc1, round(avg(rc2), 5) AS mean_rc2 FROM scores GROUP BY combi_fac""")
def control_centroids(spark, folder):
    return rounded(_controls(spark, folder).centroids, 5, "mean_rc1", "mean_rc2")


# ---------------------------------------------------------------- a factor as a term

_ZONES = ["low", "middle", "high"]
_ZONE = "CASE s_nationkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'middle' ELSE 'high' END"
_FACTOR_ROWS = f"""full_rows AS (
      SELECT *, (zone = 'middle')::DOUBLE AS zone_middle, (zone = 'high')::DOUBLE AS zone_high FROM (
        SELECT CAST(l_suppkey AS VARCHAR) AS k, any_value({_ZONE}) AS zone, avg(l_quantity) AS x1, avg(l_tax) * 100 AS x2,
               avg(l_extendedprice) / 1000 AS y1, avg(l_discount) * 100 AS y2, avg(l_quantity * l_discount) AS y3
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1))"""


@query("rda_perm_factor", _terms_sql(
    _FACTOR_ROWS, ["x1", "zone_middle", "zone_high", "x2"], ["y1", "y2", "y3"], [("x1", [1]), ("zone", [2, 3]), ("x2", [4])],
    models._TERM_DRAWS, "length(k) || ':' || k") + " SELECT * FROM tested")
def rda_perm_factor(spark, folder):
    """A factor of three levels between two covariates: two columns, one test."""
    rows = models._suppliers(spark, folder).withColumn("zone", F.expr(_ZONE))
    rows, zone = ordination.with_levels(rows, "zone", _ZONES)
    fit = ordination.redundancy(rows, ["y1", "y2", "y3"], ["x1", zone, "x2"])
    out = permute.terms_test(fit, permute.permuted_sums(fit, rows, ["l_suppkey"], models._TERM_DRAWS, models._SEED))
    return rounded(rounded(rounded(out, 8, "variance"), 5, "statistic"), 8, "prop")
