"""Model fits and inference. The SQL solves the same normal equations by its own route."""

import re

from pyspark.sql import functions as F

from checks import adapters as A
from checks.base import check, rounded, rounded_sql as rs
from checks.joins_and_aggregates import ORDER, admissions, severity
from checks.newton_sql import fit as fit_sql, profile_ends, recursive, t_critical, t_two_sided
from visitlens.operators import fits as M, grouped_fits as G
from visitlens.operators.design import Factor, Numeric, Product, design_cells
from visitlens.operators.profiles import profile_intervals
from visitlens.operators.wide import eliminated_fit
from visitlens.plans import diagnosis as D, rates as R

TERM_COLUMNS = ["estimate", "std_error", "statistic", "p_value"]
TERMS_SQL = "SELECT term, " + ", ".join(f"{rs(c, 5)} AS {c}" for c in TERM_COLUMNS) + " FROM terms"


def terms_out(terms, digits=5):
    return terms.select("term", *[rounded(F.col(c), digits).alias(c) for c in TERM_COLUMNS])


def with_fit(views, cells, names, family="gaussian"):
    return recursive(f"{A.views(*views)}, {fit_sql(cells, names, family)}")


def dummies(column, levels):
    return [f"CAST({column} = {v} AS INTEGER)" for v in levels]


def cell_sql(xs, y, view, off="0", where="true"):
    columns = ", ".join(f"CAST({x} AS DOUBLE) AS x{i}" for i, x in enumerate(["1", *xs]))
    return f"SELECT {columns}, CAST({y} AS DOUBLE) AS y, CAST({off} AS DOUBLE) AS off, CAST(count(*) AS DOUBLE) AS w FROM {view} WHERE {where} GROUP BY ALL"


# --- linear models ---------------------------------------------------------------------------

OLS_NAMES = ["(Intercept)", "year_since", "urgency", "gender2", "region3Countryside", "region3Surrounding Area", "log_population", "patient_maximum"]
OLS_CELLS = cell_sql(["year_since", "urgency", "CAST(gender = 2 AS INTEGER)", "CAST(region3 = 'Countryside' AS INTEGER)",
                      "CAST(region3 = 'Surrounding Area' AS INTEGER)", "ln(exposure)", "patient_maximum"], "severity", "severity")
LOG_POPULATION = Numeric("log_population", "ln(exposure)")
MAIN_TERMS = [Numeric("year_since"), Numeric("urgency"), Factor("gender"), Factor("region3"), LOG_POPULATION, Numeric("patient_maximum")]


def main_fit(spark, d):
    return M.fit_linear(severity(spark, d), MAIN_TERMS, "severity")


@check("ols", with_fit(["severity"], OLS_CELLS, OLS_NAMES) + TERMS_SQL)
def ols(spark, d):
    return terms_out(main_fit(spark, d).terms(spark))


@check("linear_table", with_fit(["severity"], OLS_CELLS, OLS_NAMES).rstrip() + f""", {t_critical('raw_terms')}
    SELECT term, {', '.join(f"{rs(e, 5)} AS {c}" for c, e in {'estimate': 'estimate', 'std_error': 'std_error', 'lower': 'estimate - t * std_error',
    'upper': 'estimate + t * std_error', 'p_value': 'p_value'}.items())} FROM terms JOIN critical USING (dof)""")
def linear_table(spark, d):
    """Estimates of the main linear fit with their t intervals."""
    table = M.linear_table(main_fit(spark, d), spark)
    return table.select("term", *[rounded(F.col(c), 5).alias(c) for c in ("estimate", "std_error", "lower", "upper", "p_value")])


@check("design_matrix", f"""{A.views('severity')} SELECT ingest_key, CAST(1 AS DOUBLE) AS x0, CAST(year_since AS DOUBLE) AS x1, CAST(urgency AS DOUBLE) AS x2, CAST(gender = 2 AS DOUBLE) AS x3,
    CAST(region3 = 'Countryside' AS DOUBLE) AS x4, CAST(region3 = 'Surrounding Area' AS DOUBLE) AS x5, CAST(year_since * urgency AS DOUBLE) AS x6, {rs('ln(exposure)')} AS x7 FROM severity""")
def design_matrix(spark, d):
    from visitlens.operators.design import build_design
    terms = [Numeric("year_since"), Numeric("urgency"), Factor("gender"), Factor("region3"), Product(Numeric("year_since"), Numeric("urgency")), LOG_POPULATION]
    table = build_design(severity(spark, d), terms, "severity", keep=["ingest_key"]).matrix_table("ingest_key")
    return table.select("ingest_key", *[f"x{i}" for i in range(7)], rounded(F.col("x7")).alias("x7"))


RATE_LEVELS = ["0", "1.5", "3", "4"]
RATE_NAMES = ["(Intercept)", "year_since", *[f"region{v}" for v in RATE_LEVELS]]


def rate_cells(view, where="population IS NOT NULL", levels=RATE_LEVELS):
    return cell_sql(["year_since", *dummies("region", levels)], "log_count", view, "ln(population)", where)


RATE_TERMS = [Numeric("year_since"), Factor("region", "1")]


def rate_fit(rates):
    return M.fit_linear(rates, RATE_TERMS, "log_count", "ln(population)")


def rates(spark, d):
    return R.region_year_rates(A.visits(spark, d), A.population(spark, d))


def rates_first(spark, d):
    return R.region_year_rates_first(A.visits(spark, d), A.population(spark, d), ORDER)


def rates_filled(spark, d):
    return R.region_year_rates_filled(admissions(spark, d), A.population(spark, d))


@check("ols_offset", with_fit(["rates"], rate_cells("rates"), RATE_NAMES) + TERMS_SQL)
def ols_offset(spark, d):
    return terms_out(rate_fit(rates(spark, d)).terms(spark))


MANY_LEVELS = f"""{A.views('severity')}, c AS (SELECT patient_id AS g, CAST(severity AS DOUBLE) AS y, CAST(year_since AS DOUBLE) AS a, CAST(urgency AS DOUBLE) AS b FROM severity),
    m AS (SELECT g, CAST(count(*) AS DOUBLE) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb FROM c GROUP BY g),
    s AS (SELECT count(*) AS n, sum((a - ma) * (a - ma)) AS aa, sum((a - ma) * (b - mb)) AS ab, sum((b - mb) * (b - mb)) AS bb, sum((a - ma) * (y - my)) AS ta,
        sum((b - mb) * (y - my)) AS tb, sum((y - my) * (y - my)) AS yy FROM c JOIN m USING (g)),
    f AS (SELECT *, (bb * ta - ab * tb) / det AS ba, (aa * tb - ab * ta) / det AS bw, bb / det AS iaa, -ab / det AS iab, aa / det AS ibb
        FROM (SELECT *, aa * bb - ab * ab AS det FROM s)),
    v AS (SELECT *, (yy - ba * ta - bw * tb) / (n - (SELECT count(*) FROM m) - 2) AS s2 FROM f),
    r AS (SELECT * FROM m ORDER BY g LIMIT 1),
    t AS (SELECT '(Intercept)' AS term, my - ba * ma - bw * mb AS estimate, sqrt(s2 * (1 / r.n + ma * ma * iaa + 2 * ma * mb * iab + mb * mb * ibb)) AS std_error FROM r, v
      UNION ALL SELECT 'year_since', ba, sqrt(s2 * iaa) FROM v UNION ALL SELECT 'urgency', bw, sqrt(s2 * ibb) FROM v
      UNION ALL SELECT 'patient_id' || CAST(m.g AS VARCHAR), (m.my - ba * m.ma - bw * m.mb) - (r.my - ba * r.ma - bw * r.mb),
        sqrt(s2 * (1 / m.n + 1 / r.n + (m.ma - r.ma) * (m.ma - r.ma) * iaa + 2 * (m.ma - r.ma) * (m.mb - r.mb) * iab + (m.mb - r.mb) * (m.mb - r.mb) * ibb))
        FROM m, r, v WHERE m.g <> r.g)"""


@check("ols_many_levels", f"{MANY_LEVELS} SELECT term, {rs('estimate', 5)} AS estimate, {rs('std_error', 5)} AS std_error, {rs('estimate / std_error', 4)} AS statistic FROM t")
def ols_many_levels(spark, d):
    """An effect of its own for every patient, however many there are."""
    terms = [Numeric("year_since"), Numeric("urgency")]
    cells = design_cells(severity(spark, d), [*terms, Factor("patient_id")], "severity")
    fit = eliminated_fit(cells, terms, Factor("patient_id"), "gaussian")
    return fit.terms(spark).select("term", *[rounded(F.col(c), k).alias(c) for c, k in (("estimate", 5), ("std_error", 5), ("statistic", 4))])


SUBSETS = {"capital": ["0", "1", "1.5"], "rest": ["0", "3", "4"]}


def subset_sql(name, levels):
    first, *others = ["1", "0", "1.5"] if name == "capital" else levels
    cells = rate_cells("rates", f"population IS NOT NULL AND region IN ({', '.join(levels)})", others)
    body = with_fit(["rates"], cells, ["(Intercept)", "year_since", *[f"region{v}" for v in others]])
    return f"SELECT * FROM ({body} SELECT '{name}' AS subset, term, {', '.join(f'{rs(c, 5)} AS {c}' for c in TERM_COLUMNS)} FROM terms)"


@check("ols_subset_compare", " UNION ALL ".join(subset_sql(n, v) for n, v in SUBSETS.items()))
def ols_subset_compare(spark, d):
    table = rates(spark, d)
    parts = []
    for name, levels in SUBSETS.items():
        fit = M.fit_linear(table.filter(F.col("region").isin([float(v) for v in levels])),
                           [Numeric("year_since"), Factor("region", "1" if name == "capital" else "0")], "log_count", "ln(population)")
        parts.append(terms_out(fit.terms(spark)).select(F.lit(name).alias("subset"), "*"))
    return parts[0].unionByName(parts[1])


# --- a line per group ------------------------------------------------------------------------

LINES = f"""{A.views('letter_years')}, g AS (SELECT category, count(*) AS n, avg(year) AS xm, regr_slope(total, year) AS slope, regr_intercept(total, year) AS icept,
    regr_sxx(total, year) AS sxx, regr_syy(total, year) AS syy, regr_syy(total, year) - regr_slope(total, year) * regr_sxy(total, year) AS rss FROM letter_years GROUP BY category),
    tt AS (SELECT category, '(Intercept)' AS term, icept AS estimate, sqrt(rss / (n - 2)) * sqrt(1.0 / n + xm * xm / sxx) AS std_error, n - 2 AS dof FROM g UNION ALL
    SELECT category, 'year', slope, sqrt(rss / (n - 2)) / sqrt(sxx), n - 2 FROM g)"""
GROUP_TERMS = f"SELECT category, term, {rs('estimate', 4)} AS estimate, {rs('std_error', 4)} AS std_error, {rs('estimate / std_error', 4)} AS statistic, {rs(t_two_sided('estimate / std_error', 'dof'), 5)} AS p_value FROM tt"


def letter_years(spark, d):
    return D.letters_by_year(A.diagnosed_visits(spark, d), A.DX_SLOTS)


def group_terms(spark, d):
    return G.fit_by_group(letter_years(spark, d), "category", "year", "total")


def group_out(terms):
    return terms.select("category", "term", *[rounded(F.col(c), 4).alias(c) for c in TERM_COLUMNS[:3]], rounded(F.col("p_value"), 5).alias("p_value"))


@check("ols_by_group", f"{LINES} {GROUP_TERMS}")
def ols_by_group(spark, d):
    return group_out(group_terms(spark, d))


@check("filter_significant", f"SELECT * FROM ({LINES} {GROUP_TERMS}) WHERE term = 'year' AND p_value < 0.2")
def filter_significant(spark, d):
    return group_out(G.significant(group_terms(spark, d), "year", 0.2))


@check("fit_stats_by_group", f"{LINES} SELECT category, {rs('1 - rss / syy')} AS r_squared, {rs('(1 - rss / syy) * (n - 2) / (rss / syy)', 5)} AS f_statistic FROM g")
def fit_stats_by_group(spark, d):
    stats = G.fit_statistics(letter_years(spark, d), "category", "year", "total")
    return stats.select("category", rounded(F.col("r_squared")).alias("r_squared"), rounded(F.col("f_statistic"), 5).alias("f_statistic"))


@check("f_critical", f"""{recursive(LINES)}, dofs AS (SELECT n - 2 AS dof FROM g), {t_critical('dofs')}
    SELECT category, {rs('(1 - rss / syy) * (n - 2) / (rss / syy)', 5)} AS f_statistic, {rs('t * t', 5)} AS f_critical FROM g JOIN critical ON dof = n - 2""")
def f_critical(spark, d):
    """With one predictor the critical value is the square of the t that leaves the level in both tails."""
    stats = G.fit_statistics(letter_years(spark, d), "category", "year", "total")
    return stats.select("category", rounded(F.col("f_statistic"), 5).alias("f_statistic"), rounded(F.col("f_critical"), 5).alias("f_critical"))


AUGMENT = f"""{LINES}, a AS (SELECT l.*, g.*, icept + slope * year AS fitted, total - icept - slope * year AS residual, 1.0 / n + pow(year - xm, 2) / sxx AS hat
    FROM letter_years l JOIN g USING (category))"""
AUGMENT_COLUMNS = {"fitted": "fitted", "residual": "residual", "hat": "hat", "sigma_without": "sqrt((rss - residual * residual / (1 - hat)) / (n - 3))",
                   "cooks_distance": "residual * residual / (rss / (n - 2)) * hat / pow(1 - hat, 2) / 2", "std_residual": "residual / sqrt(rss / (n - 2) * (1 - hat))"}


def augmented(spark, d):
    return G.augment_by_group(letter_years(spark, d), "category", "year", "total")


@check("augment_by_group", f"{AUGMENT} SELECT category, year, total, {', '.join(f'{rs(e, 4)} AS {c}' for c, e in AUGMENT_COLUMNS.items())} FROM a")
def augment_by_group(spark, d):
    return augmented(spark, d).select("category", "year", "total", *[rounded(F.col(c), 4).alias(c) for c in AUGMENT_COLUMNS])


@check("icd_trend_report", f"""{AUGMENT}, s AS (SELECT category FROM ({GROUP_TERMS}) WHERE term = 'year' AND p_value < 0.2)
    SELECT category, year, {rs('fitted', 4)} AS fitted, {rs('residual', 4)} AS residual, {rs('slope', 4)} AS slope, {rs('1 - rss / syy')} AS r_squared FROM a SEMI JOIN s USING (category)""")
def icd_trend_report(spark, d):
    report = D.trend_report(A.diagnosed_visits(spark, d), A.DX_SLOTS, level=0.2)
    return report.select("category", "year", *[rounded(F.col(c), 4).alias(c) for c in ("fitted", "residual", "slope")], rounded(F.col("r_squared")).alias("r_squared"))


# --- generalised linear models ---------------------------------------------------------------

LOGIT_NAMES = ["(Intercept)", "sexO", "sexP", "statusO", "stay_hours"]
LOGIT_CELLS = cell_sql(["CAST(sex = 'O' AS INTEGER)", "CAST(sex = 'P' AS INTEGER)", "CAST(status = 'O' AS INTEGER)", "stay_hours"], "response", "responses")
LOGIT_TERMS = [Factor("sex"), Factor("status"), Numeric("stay_hours")]


def logit_fit(spark, d, where="true"):
    return M.fit_glm(A.responses(spark, d).filter(where), LOGIT_TERMS, "response", "binomial")


@check("logit_glm", with_fit(["responses"], LOGIT_CELLS, LOGIT_NAMES, "binomial") + TERMS_SQL)
def logit_glm(spark, d):
    return terms_out(logit_fit(spark, d).terms(spark))


POISSON_CELLS = cell_sql(["year_since", *dummies("region", RATE_LEVELS)], "count", "rates", "ln(population)", "population IS NOT NULL")


def poisson_fit(spark, d):
    return M.fit_glm(rates(spark, d), RATE_TERMS, "count", "poisson", "ln(population)")


@check("poisson_glm", with_fit(["rates"], POISSON_CELLS, RATE_NAMES, "poisson") + TERMS_SQL)
def poisson_glm(spark, d):
    return terms_out(poisson_fit(spark, d).terms(spark))


NEGATIVE_SQL = recursive(f"{A.views('rates')}, {fit_sql(POISSON_CELLS, RATE_NAMES, 'negative_binomial', 60)}")


@check("negbin_glm", NEGATIVE_SQL + TERMS_SQL)
def negbin_glm(spark, d):
    return terms_out(M.fit_negative_binomial(rates(spark, d), RATE_TERMS, "count", "ln(population)").terms(spark))


@check("prior_terms", with_fit(["responses"], LOGIT_CELLS, LOGIT_NAMES, "binomial") + f"SELECT term, {rs('estimate', 5)} AS mean, {rs('2 * std_error', 5)} AS scale FROM terms")
def prior_terms(spark, d):
    return M.prior_terms(logit_fit(spark, d).terms(spark)).select("term", rounded(F.col("mean"), 5).alias("mean"), rounded(F.col("scale"), 5).alias("scale"))


@check("sink_terms", with_fit(["responses"], LOGIT_CELLS, LOGIT_NAMES, "binomial") + f"SELECT term, {rs('estimate', 5)} AS mean, {rs('2 * std_error', 5)} AS scale FROM terms")
def sink_terms(spark, d):
    from checks.base import scratch
    from visitlens.sources.tables import read_snapshot, write_snapshot
    folder = scratch(spark)
    write_snapshot(prior_terms(spark, d), folder, "priors", "1")
    return read_snapshot(spark, folder, "priors", "1")


VIF_NAMES = ["(Intercept)", "year_since", "urgency", "log_population", "patient_maximum"]
VIF_CELLS = cell_sql(["year_since", "urgency", "ln(exposure)", "patient_maximum"], "severity", "severity")


@check("vif", with_fit(["severity"], VIF_CELLS, VIF_NAMES) + " UNION ALL ".join(
    f"SELECT '{n}' AS term, {rs(f'v_{i}_{i} * (SELECT sum(w * x{i} * x{i}) - pow(sum(w * x{i}), 2) / sum(w) FROM cells)', 5)} AS gvif FROM model"
    for i, n in enumerate(VIF_NAMES) if i))
def vif(spark, d):
    fit = M.fit_linear(severity(spark, d), [Numeric("year_since"), Numeric("urgency"), LOG_POPULATION, Numeric("patient_maximum")], "severity")
    return M.variance_inflation(fit, spark).select("term", rounded(F.col("gvif"), 5).alias("gvif"))


ODDS_SQL = f"SELECT term AS parameter, {rs('exp(estimate)', 5)} AS odds_ratio, {rs('exp(estimate - 1.96 * std_error)', 5)} AS lower, {rs('exp(estimate + 1.96 * std_error)', 5)} AS upper, {rs('p_value', 5)} AS p_value FROM terms"


@check("odds_table", with_fit(["responses"], LOGIT_CELLS, LOGIT_NAMES, "binomial") + ODDS_SQL)
def odds_table(spark, d):
    odds = M.odds_table(logit_fit(spark, d).terms(spark))
    return odds.select("parameter", *[rounded(F.col(c), 5).alias(c) for c in ("odds_ratio", "lower", "upper", "p_value")])


PROFILE_SQL = f""", {profile_ends(len(LOGIT_NAMES), 0.95)} SELECT term AS parameter, {rs('exp(max(estimate))', 5)} AS odds_ratio, {rs('max(CASE WHEN side = -1 THEN reached END)', 5)} AS lower,
    {rs('max(CASE WHEN side = 1 THEN reached END)', 5)} AS upper, {rs('max(p_value)', 5)} AS p_value FROM terms JOIN (SELECT side,
    CASE j {' '.join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(LOGIT_NAMES))} END AS term,
    CASE j {' '.join(f'WHEN {i} THEN exp(c{i})' for i in range(len(LOGIT_NAMES)))} END AS reached FROM ends) USING (term) GROUP BY term"""


@check("odds_profile", with_fit(["responses"], LOGIT_CELLS, LOGIT_NAMES, "binomial") + PROFILE_SQL)
def odds_profile(spark, d):
    odds = profile_intervals(logit_fit(spark, d), spark)
    return odds.select("parameter", *[rounded(F.col(c), 5).alias(c) for c in ("odds_ratio", "lower", "upper", "p_value")])


DRAW_ODDS = f"""SELECT parameter, {rs('exp(quantile_cont(value, 0.5))', 5)} AS odds_ratio, {rs('exp(quantile_cont(value, 0.025))', 5)} AS lower,
    {rs('exp(quantile_cont(value, 0.975))', 5)} AS upper, 'Bayesian' AS type FROM draws GROUP BY parameter"""
GLM_ODDS = f"SELECT term AS parameter, {rs('exp(estimate)', 5)} AS odds_ratio, {rs('exp(estimate - 1.96 * std_error)', 5)} AS lower, {rs('exp(estimate + 1.96 * std_error)', 5)} AS upper, 'GLM' AS type FROM terms"
ODDS_COMPARE_SQL = with_fit(["responses", "draws"], LOGIT_CELLS, LOGIT_NAMES, "binomial") + f"{GLM_ODDS} UNION ALL {DRAW_ODDS}"


def compared_odds(spark, d):
    from visitlens.operators.posterior import compare_odds
    stacked = compare_odds(logit_fit(spark, d).terms(spark), A.draws(spark, d))
    return stacked.select("parameter", *[rounded(F.col(c), 5).alias(c) for c in ("odds_ratio", "lower", "upper")], "type")


@check("odds_compare", ODDS_COMPARE_SQL)
def odds_compare(spark, d):
    return compared_odds(spark, d)


@check("error_bars", ODDS_COMPARE_SQL)
def error_bars(spark, d):
    return compared_odds(spark, d)


def second_fit(cells, names, prefix, family="gaussian"):
    """The CTEs of another fit under a prefix, for queries that need two."""
    text = fit_sql(cells, names, family)
    return re.sub(r"\b(cells|it|fitted|model|raw_terms|terms)\b", rf"{prefix}_\1", text)


SMALL_NAMES = ["(Intercept)", "sexO", "sexP", "stay_hours"]
SMALL_CELLS = cell_sql(["CAST(sex = 'O' AS INTEGER)", "CAST(sex = 'P' AS INTEGER)", "stay_hours"], "response", "responses", where="status = 'O'")


@check("coef_compare", with_fit(["responses"], LOGIT_CELLS, LOGIT_NAMES, "binomial").rstrip() + ", " + second_fit(SMALL_CELLS, SMALL_NAMES, "sm", "binomial")
       + f""" SELECT replace(term, 'sex', '') AS predictor, {rs('coalesce(a.estimate, 0)', 5)} AS estimate_large, {rs('coalesce(b.estimate, 0)', 5)} AS estimate_small
       FROM terms a FULL JOIN sm_terms b USING (term)""")
def coef_compare(spark, d):
    large = logit_fit(spark, d).terms(spark)
    small = M.fit_glm(A.responses(spark, d).filter("status = 'O'"), [Factor("sex"), Numeric("stay_hours")], "response", "binomial").terms(spark)
    both = M.compare_coefficients(large, small, "estimate", "sex")
    return both.select("predictor", *[rounded(F.col(c), 5).alias(c) for c in ("estimate_large", "estimate_small")])


DIFF = "(a.estimate - b.estimate)"
SPREAD = "sqrt(a.std_error * a.std_error + b.std_error * b.std_error)"
WELCH = f"(pow({SPREAD}, 4) / (pow(a.std_error, 4) / (a.dof - 1) + pow(b.std_error, 4) / (b.dof - 1)))"


@check("coef_diff_test", with_fit(["rates", "rates_first"], rate_cells("rates"), RATE_NAMES).rstrip() + ", " + second_fit(rate_cells("rates_first"), RATE_NAMES, "fv")
       + f""", j AS (SELECT term, {DIFF} AS difference, {DIFF} / {SPREAD} AS t_value, {WELCH} AS df FROM terms a JOIN fv_terms b USING (term))
       SELECT term, {rs('difference', 4)} AS difference, {rs('t_value', 4)} AS t_value, {rs('df', 3)} AS df, {rs(t_two_sided('t_value', 'df'), 4)} AS p_value FROM j""")
def coef_diff_test(spark, d):
    tested = M.coefficient_differences(rate_fit(rates(spark, d)), rate_fit(rates_first(spark, d)), spark)
    return tested.select("term", rounded(F.col("difference"), 4).alias("difference"), rounded(F.col("t_value"), 4).alias("t_value"), rounded(F.col("df"), 3).alias("df"), rounded(F.col("p_value"), 4).alias("p_value"))


ETA = " + ".join(f"b{i} * x{i}" for i in range(len(RATE_NAMES)))
BACK_REGION = "(" + " + ".join(f"{v} * x{i}" for i, v in enumerate(RATE_LEVELS, start=2)) + " + (1 - " + " - ".join(f"x{i}" for i in range(2, 6)) + "))"


def rate_scored(fit, table):
    from visitlens.operators.design import OFFSET
    return fit.score(table.filter("population is not null").withColumn(OFFSET, F.ln("population")), out="link")


@check("predict_score", with_fit(["rates"], rate_cells("rates"), RATE_NAMES) + f"SELECT CAST(x1 AS INTEGER) AS year_since, {rs(BACK_REGION, 1)} AS region, {rs(f'{ETA} + off', 5)} AS link FROM cells, model")
def predict_score(spark, d):
    table = rates(spark, d)
    scored = rate_scored(rate_fit(table), table)
    return scored.select(F.col("year_since").cast("int").alias("year_since"), rounded(F.col("region"), 1).alias("region"), rounded(F.col("link"), 5).alias("link"))


@check("bias_by_region", with_fit(["rates"], rate_cells("rates"), RATE_NAMES) + f"SELECT CAST(x1 + 2010 AS INTEGER) AS year, {rs(BACK_REGION, 1)} AS region, {rs(f'exp({ETA} + off) - exp(y)', 3)} AS bias FROM cells, model")
def bias_by_region(spark, d):
    table = rates(spark, d)
    bias = R.bias(rate_scored(rate_fit(table), table), "link")
    return bias.select("year", rounded(F.col("region"), 1).alias("region"), rounded(F.col("bias"), 3).alias("bias"))


@check("residuals_table", with_fit(["rates_filled"], rate_cells("rates_filled"), RATE_NAMES) + f"SELECT CAST(x1 AS INTEGER) AS year_since, {rs(f'{ETA} + off', 5)} AS fitted, {rs(f'y - off - ({ETA})', 5)} AS residual FROM cells, model")
def residuals_table(spark, d):
    rows = rate_fit(rates_filled(spark, d)).predictions()
    return rows.select(F.col("year_since").cast("int").alias("year_since"), rounded(F.col("fitted"), 5).alias("fitted"), rounded(F.col("residual"), 5).alias("residual"))
