"""Distributions, residual tests, figure tables, forests and penalised models."""

from pyspark.sql import functions as F

from checks import adapters as A
from checks.base import check, rounded, rounded_sql as rs
from checks.joins_and_aggregates import REGION_SQL, region, severity
from checks.models import (
    AUGMENT, BACK_REGION, ETA, LINES, LOG_POPULATION, MAIN_TERMS, OLS_CELLS, OLS_NAMES, RATE_NAMES, RATE_TERMS, augmented, bias_by_region, cell_sql,
    NEGATIVE_SQL, POISSON_CELLS, letter_years, main_fit, rate_cells, rate_fit, rates, rates_filled, second_fit, with_fit,
)
from checks.newton_sql import _solve, normal_quantile, normal_two_sided, recursive
from visitlens.operators import distributions as X, fits as M, forest as FO, normality as N, plotdata as P, series as SE, smooth_and_mixed as SM
from visitlens.operators.design import Factor, Numeric, Product
from visitlens.plans import cohort as C
from visitlens.plans.rates import counts_by_region_year


def counts(spark, d):
    return counts_by_region_year(A.visits(spark, d))


def out(df, digits, *plain, **columns):
    """Plain columns unchanged, the others rounded."""
    return df.select(*plain, *[rounded(F.col(c), n if (n := columns.get(c)) else digits).alias(c) for c in df.columns if c not in plain])


# --- distributions ---------------------------------------------------------------------------

LOGNORMAL = """l AS (SELECT count(*) AS n, avg(ln(count)) AS mean_log, stddev_samp(ln(count)) AS sd_log, stddev_pop(ln(count)) AS sd_ml, sum(ln(count)) AS sum_log FROM rates)"""
PARETO = """p0 AS (SELECT count(*) AS n, CAST(min(count) AS DOUBLE) AS scale_ml, sum(ln(count)) AS sum_log, sum(ln(count / (SELECT min(count) FROM rates))) AS ex FROM rates),
    p AS (SELECT n, 1 + n / ex AS shape, scale_ml / (n / ex) AS scale, n / ex AS shape_ml, scale_ml, sum_log FROM p0)"""


@check("fit_lognormal", f"""{A.views('rates')}, {LOGNORMAL} SELECT n, {rs('mean_log')} AS mean_log, {rs('sd_log')} AS sd_log,
    {rs('-n / 2.0 * ln(2 * pi()) - n * ln(sd_log) - (SELECT sum(pow(ln(count) - mean_log, 2)) FROM rates) / (2 * sd_log * sd_log)', 4)} AS log_likelihood,
    {rs('-n / 2.0 * ln(2 * pi()) - n * ln(sd_ml) - n / 2.0 - sum_log', 4)} AS log_likelihood_full FROM l""")
def fit_lognormal(spark, d):
    f = X.lognormal_fit(counts(spark, d), "count")
    return f.select("n", *[rounded(F.col(c), k).alias(c) for c, k in (("mean_log", 6), ("sd_log", 6), ("log_likelihood", 4), ("log_likelihood_full", 4))])


PARETO_LL = "n * ln({a}) + n * {a} * ln({s}) - ({a} + 1) * sum_log"


@check("fit_pareto", f"""{A.views('rates')}, {PARETO} SELECT n, {rs('shape')} AS shape, {rs('scale', 4)} AS scale, {rs('shape_ml')} AS shape_ml, {rs('scale_ml')} AS scale_ml,
    {rs(PARETO_LL.format(a='shape', s='scale'), 4)} AS log_likelihood, {rs(PARETO_LL.format(a='shape_ml', s='scale_ml'), 4)} AS log_likelihood_full FROM p""")
def fit_pareto(spark, d):
    f = X.pareto_fit(counts(spark, d), "count")
    return f.select("n", *[rounded(F.col(c), k).alias(c) for c, k in (("shape", 6), ("scale", 4), ("shape_ml", 6), ("scale_ml", 6), ("log_likelihood", 4), ("log_likelihood_full", 4))])


@check("pmf_table", f"""{A.views('rates')}, {LOGNORMAL}, {PARETO}, m AS (SELECT avg(count) AS mean_n, max(count) AS top FROM rates), k AS (SELECT unnest(range(0, (SELECT top FROM m) + 1)) AS value)
    SELECT value, {rs('exp(value * ln(mean_n) - mean_n - lgamma(value + 1.0))', 8)} AS poisson,
    {rs('exp(lgamma(value + 300.0) - lgamma(300.0) - lgamma(value + 1.0) + 300 * ln(0.75) + value * ln(0.25))', 8)} AS negative_binomial,
    {rs("CASE WHEN value = 0 THEN 0 ELSE exp(-pow((ln(greatest(value, 1)) - mean_log) / sd_log, 2) / 2) / (greatest(value, 1) * sd_log * sqrt(2 * pi())) * l.n * 25 END", 6)} AS log_normal,
    {rs("CASE WHEN value >= scale_ml THEN CASE WHEN value >= scale THEN shape * pow(scale / value, shape) / value * l.n * 25 ELSE 0 END END", 6)} AS pareto FROM k, m, l, p""")
def pmf_table(spark, d):
    t = X.density_table(counts(spark, d), "count")
    return t.select("value", rounded(F.col("poisson"), 8).alias("poisson"), rounded(F.col("negative_binomial"), 8).alias("negative_binomial"),
                    rounded(F.col("log_normal")).alias("log_normal"), rounded(F.col("pareto")).alias("pareto"))


@check("overdispersion", f"{A.views('rates')} SELECT {rs('avg(count)')} AS mean, {rs('var_samp(count)', 4)} AS variance, {rs('var_samp(count) / avg(count)')} AS ratio FROM rates")
def overdispersion(spark, d):
    o = X.overdispersion(counts(spark, d), "count")
    return o.select(rounded(F.col("mean")).alias("mean"), rounded(F.col("variance"), 4).alias("variance"), rounded(F.col("ratio")).alias("ratio"))


POISSON_MU = f"exp({ETA} + off)"
KNOWN_RATES = "(SELECT * FROM rates WHERE population IS NOT NULL)"


@check("aic_compare", NEGATIVE_SQL.rstrip() + ", " + second_fit(POISSON_CELLS, RATE_NAMES, "po", "poisson") + f""",
    {LOGNORMAL.replace('FROM rates', f'FROM {KNOWN_RATES}')}, {PARETO.replace('FROM rates', f'FROM {KNOWN_RATES}')},
    pois AS (SELECT 12 - 2 * sum(w * (y * ln({POISSON_MU}) - {POISSON_MU} - lgamma(y + 1))) AS aic FROM po_cells, po_model),
    nbin AS (SELECT 14 - 2 * sum(w * (lgamma(y + th) - lgamma(th) - lgamma(y + 1) + th * ln(th / (th + mu)) + y * ln(mu / (th + mu)))) AS aic
        FROM (SELECT *, exp(lt) AS th, {POISSON_MU} AS mu FROM cells, model))
    SELECT 'Log-Normal' AS model, {rs('4 - 2 * (-n / 2.0 * ln(2 * pi()) - n * ln(sd_log) - (n - 1) / 2.0)', 3)} AS aic_as_given, {rs('4 - 2 * (-n / 2.0 * ln(2 * pi()) - n * ln(sd_ml) - n / 2.0 - sum_log)', 3)} AS aic_comparable FROM l
    UNION ALL SELECT 'Pareto', {rs('4 - 2 * (' + PARETO_LL.format(a='shape', s='scale') + ')', 3)}, {rs('4 - 2 * (' + PARETO_LL.format(a='shape_ml', s='scale_ml') + ')', 3)} FROM p
    UNION ALL SELECT 'Poisson', {rs('aic', 3)}, {rs('aic', 3)} FROM pois UNION ALL SELECT 'Negative Binomial', {rs('aic', 3)}, {rs('aic', 3)} FROM nbin""")
def aic_compare(spark, d):
    table = X.compare_aic(rates(spark, d).filter("population is not null"), "count", RATE_TERMS, "ln(population)")
    return table.select("model", *[rounded(F.col(c), 3).alias(c) for c in ("aic_as_given", "aic_comparable")])


# --- tests -----------------------------------------------------------------------------------

# Published critical values of the unit-root statistic with trend, by size of the series.
UNIT_ROOT = """(VALUES (25, [-4.38, -3.95, -3.60, -3.24, -1.14, -0.80, -0.50, -0.15]), (50, [-4.15, -3.80, -3.50, -3.18, -1.19, -0.87, -0.58, -0.24]),
    (100, [-4.04, -3.73, -3.45, -3.15, -1.22, -0.90, -0.62, -0.28]), (250, [-3.99, -3.69, -3.43, -3.13, -1.23, -0.92, -0.64, -0.31]),
    (500, [-3.98, -3.68, -3.42, -3.13, -1.24, -0.93, -0.65, -0.32]), (100000, [-3.96, -3.66, -3.41, -3.12, -1.25, -0.94, -0.66, -0.33]))"""

# The regression in long form, column by column; the order follows from the number of rows, and the system is solved one pivot at a time.
ADF_SQL = f"""{recursive(A.views('series'))}, x AS (SELECT row_number() OVER (ORDER BY ts, event_id) AS i, value AS v FROM series),
    o AS (SELECT count(*) AS n, CAST(floor(pow(count(*) - 1, 1.0 / 3) + 1e-9) AS BIGINT) AS k FROM x),
    s AS (SELECT i, v AS level, step FROM (SELECT i, v, lead(v) OVER (ORDER BY i) - v AS step FROM x) WHERE step IS NOT NULL),
    u AS (SELECT s.* FROM s, o WHERE i > k),
    z AS (SELECT i, CAST(0 AS BIGINT) AS c, CAST(1 AS DOUBLE) AS v FROM u UNION ALL SELECT i, 1, level - (SELECT avg(level) FROM u) FROM u
        UNION ALL SELECT i, 2, i - (SELECT avg(i) FROM u) FROM u
        UNION ALL SELECT u.i, u.i - s.i + 2, s.step FROM u JOIN o ON true JOIN s ON s.i >= u.i - k AND s.i < u.i
        UNION ALL SELECT i, k + 3, step FROM u, o),
    g AS (SELECT a.c AS r, b.c AS c, sum(a.v * b.v) AS v FROM z a JOIN z b ON a.i = b.i GROUP BY 1, 2),
    w(p, r, c, v) AS (SELECT CAST(0 AS BIGINT), r, c, v FROM g UNION ALL
        SELECT m.p + 1, m.r, m.c, CASE WHEN m.r = m.p AND m.c = m.p THEN 1 / d.v WHEN m.r = m.p THEN m.v / d.v WHEN m.c = m.p THEN -m.v / d.v
            ELSE m.v - a.v * b.v / d.v END
        FROM w m JOIN w d ON d.r = m.p AND d.c = m.p JOIN w a ON a.r = m.r AND a.c = m.p JOIN w b ON b.r = m.p AND b.c = m.c, o WHERE m.p < k + 3),
    f AS (SELECT max(CASE WHEN r = 1 AND c = k + 3 THEN v END) AS b, max(CASE WHEN r = 1 AND c = 1 THEN v END) AS inv, max(CASE WHEN r = k + 3 AND c = k + 3 THEN v END) AS rss,
        (SELECT count(*) FROM u) - max(k) - 3 AS dof FROM w, o WHERE p = k + 3),
    t AS (SELECT b / sqrt(rss / dof * inv) AS statistic FROM f),
    table_of(size, v) AS (SELECT * FROM {UNIT_ROOT}),
    lo AS (SELECT * FROM table_of, o WHERE size <= greatest(least(n - 1, 100000), 25) ORDER BY size DESC LIMIT 1),
    hi AS (SELECT * FROM table_of, o WHERE size >= greatest(least(n - 1, 100000), 25) ORDER BY size LIMIT 1),
    crit AS (SELECT unnest([0.01, 0.025, 0.05, 0.10, 0.90, 0.95, 0.975, 0.99]) AS level, unnest(list_transform(range(1, 9), lambda j: CAST(lo.v[j] AS DOUBLE)
        + CASE WHEN hi.size > lo.size THEN (greatest(least(lo.n - 1, 100000), 25) - lo.size) * (hi.v[j] - lo.v[j]) / CAST(hi.size - lo.size AS DOUBLE) ELSE 0 END)) AS point FROM lo, hi),
    line AS (SELECT level, point, lead(level) OVER (ORDER BY point) AS next_level, lead(point) OVER (ORDER BY point) AS next_point FROM crit)
    SELECT {rs('statistic', 4)} AS statistic, CAST(k AS INTEGER) AS lag_order, {rs("""CASE WHEN statistic <= (SELECT min(point) FROM crit) THEN 0.01 WHEN statistic >= (SELECT max(point) FROM crit) THEN 0.99
        ELSE (SELECT max(level + (statistic - point) / (next_point - point) * (next_level - level)) FROM line WHERE statistic >= point AND statistic < next_point) END""")} AS p_value FROM t, o"""


def placed(spark, d):
    return SE.indexed(A.series(spark, d), ["ts", "event_id"])


@check("adf_test", ADF_SQL)
def adf_test(spark, d):
    """At its default order, which grows with the series."""
    return N.adf_test(placed(spark, d), "value", "position").select(
        rounded(F.col("statistic"), 4).alias("statistic"), "lag_order", rounded(F.col("p_value")).alias("p_value"))


RESIDUALS = f"res AS (SELECT y - off - ({ETA}) AS r, {ETA} + off AS fitted, x0, x1, x2, x3, x4, x5, w FROM cells, model)"


def rate_residuals(spark, d):
    return rate_fit(rates_filled(spark, d)).predictions()


@check("ks_normal", with_fit(["rates_filled"], rate_cells("rates_filled"), RATE_NAMES).rstrip() + f""", {RESIDUALS},
    z AS (SELECT row_number() OVER (ORDER BY r) AS i, count(*) OVER () AS n, (r - (SELECT avg(r) FROM res)) / (SELECT stddev_samp(r) FROM res) AS z FROM res),
    c AS (SELECT i, n, CASE WHEN z < 0 THEN tail / 2 ELSE 1 - tail / 2 END AS f FROM (SELECT *, {normal_two_sided('z')} AS tail FROM z))
    SELECT max(n) AS n, {rs('max(greatest(i / n - f, f - (i - 1) / n))')} AS statistic FROM c""")
def ks_normal(spark, d):
    return N.ks_normal(rate_residuals(spark, d), "residual").select("n", rounded(F.col("statistic")).alias("statistic"))


def poly(values, x):
    return " + ".join(f"{v!r} * pow({x}, {i})" for i, v in enumerate(values))


SHAPIRO = f"""o AS (SELECT grp, v, row_number() OVER (PARTITION BY grp ORDER BY v) AS i, count(*) OVER (PARTITION BY grp) AS n FROM src),
    sc AS (SELECT *, {normal_quantile('((i - 0.375) / (n + 0.25))')} AS m FROM o), ss AS (SELECT grp, sum(m * m) AS mm, 1 / sqrt(max(n)) AS u FROM sc GROUP BY grp),
    wl AS (SELECT sc.grp, m / sqrt(mm) + {poly([0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056], 'u')} AS an, m AS mn FROM sc JOIN ss USING (grp) WHERE i = n),
    wn AS (SELECT sc.grp, m / sqrt(mm) + {poly([0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633], 'u')} AS an1, m AS mn1 FROM sc JOIN ss USING (grp) WHERE i = n - 1),
    a AS (SELECT grp, v, n, CASE WHEN i = n THEN an WHEN i = 1 THEN -an WHEN i = n - 1 THEN an1 WHEN i = 2 THEN -an1
        ELSE m / sqrt((mm - 2 * mn * mn - 2 * mn1 * mn1) / (1 - 2 * an * an - 2 * an1 * an1)) END AS wt FROM sc JOIN ss USING (grp) JOIN wl USING (grp) JOIN wn USING (grp)),
    s AS (SELECT grp, max(n) AS n, pow(sum(wt * v), 2) / (var_pop(v) * count(*)) AS w FROM a GROUP BY grp),
    zz AS (SELECT grp, n, w, CASE WHEN n <= 11 THEN (-ln(-2.273 + 0.459 * n - ln(1 - w)) - ({poly([0.5440, -0.39978, 0.025054, -6.714e-4], 'n')})) / exp({poly([1.3822, -0.77857, 0.062767, -0.0020322], 'n')})
        ELSE (ln(1 - w) - ({poly([-1.5861, -0.31082, -0.083751, 0.0038915], 'ln(n)')})) / exp({poly([-0.4803, -0.082676, 0.0030302], 'ln(n)')}) END AS z FROM s)
    SELECT grp, n, {rs('w', 5)} AS w, {rs('CASE WHEN z > 0 THEN tail / 2 ELSE 1 - tail / 2 END', 4)} AS p_value FROM (SELECT *, {normal_two_sided('z')} AS tail FROM zz)"""


@check("shapiro_wilk", f"{A.views('series')}, src AS (SELECT user_id AS grp, value AS v FROM series), {SHAPIRO}")
def shapiro_wilk(spark, d):
    t = N.shapiro_wilk(A.series(spark, d), ["user_id"], "value")
    return t.select(F.col("user_id").alias("grp"), "n", rounded(F.col("w"), 5).alias("w"), rounded(F.col("p_value"), 4).alias("p_value"))


# --- figure tables ---------------------------------------------------------------------------


@check("bars_stacked", f"{A.views('responses')} SELECT strftime(arrival_date, '%Y-%m') AS month, response, count(*) AS n FROM responses GROUP BY ALL")
def bars_stacked(spark, d):
    return P.stacked_counts(A.responses(spark, d).withColumn("month", F.date_format("arrival_date", "yyyy-MM")), "month", "response")


@check("bars_share", f"{A.views('responses')} SELECT *, {rs('n / sum(n) OVER (PARTITION BY arrival_mode)')} AS share FROM (SELECT arrival_mode, response, count(*) AS n FROM responses GROUP BY ALL)")
def bars_share(spark, d):
    t = P.stacked_shares(A.responses(spark, d), "arrival_mode", "response")
    return t.withColumn("share", rounded(F.col("share")))


FACET_VARIABLES = ["arrival_mode", "status", "line"]


@check("bars_share_facet", f"{A.views('responses')} " + " UNION ALL ".join(
    f"SELECT *, {rs('n / sum(n) OVER (PARTITION BY level, sex)')} AS share FROM (SELECT '{v}' AS variable, CAST({v} AS VARCHAR) AS level, sex, response, count(*) AS n FROM responses GROUP BY ALL)" for v in FACET_VARIABLES))
def bars_share_facet(spark, d):
    t = P.facet_shares(A.responses(spark, d), FACET_VARIABLES, "response", ["sex"])
    return t.withColumn("share", rounded(F.col("share")))


@check("histogram_width", f"{A.views('rates')} SELECT CAST(ceil((count - 12.5) / 25) * 25 AS DOUBLE) AS centre, count(*) AS n, {rs('count(*) / sum(count(*)) OVER ()')} AS share FROM rates GROUP BY 1")
def histogram_width(spark, d):
    return P.histogram(counts(spark, d), "count", 25).withColumn("share", rounded(F.col("share")))


@check("histogram_sturges", f"""{A.views('visits')} , s AS (SELECT count(age) AS n, CAST(min(age) AS DOUBLE) AS lo, CAST(max(age) AS DOUBLE) AS hi FROM visits),
    r AS (SELECT *, (hi - lo) / ceil(log2(n) + 1) AS rough FROM s), p AS (SELECT *, pow(10, floor(log10(rough))) AS unit FROM r),
    w AS (SELECT lo, unit * CASE WHEN rough / unit > 7 THEN 10 WHEN rough / unit > 2.8 THEN 5 WHEN rough / unit > 1.4 THEN 2 ELSE 1 END AS width FROM p),
    b AS (SELECT greatest(ceil(age / width), floor(lo / width) + 1) AS bin, width FROM visits, w WHERE age IS NOT NULL)
    SELECT (bin - 1) * width AS low, bin * width AS high, count(*) AS n FROM b GROUP BY ALL""")
def histogram_sturges(spark, d):
    return P.histogram_between(A.visits(spark, d), "age")


@check("box_stats", f"""{A.views('responses')}, q AS (SELECT response, {', '.join(f'quantile_cont(stay_hours, {p}) AS {n}' for p, n in ((0, 'min'), (.25, 'q1'), (.5, 'median'), (.75, 'q3'), (1, 'max')))} FROM responses GROUP BY 1)
    SELECT response, {', '.join(f'CAST(max(q.{n}) AS DOUBLE) AS {n}' for n in ('min', 'q1', 'median', 'q3', 'max'))},
    min(stay_hours) FILTER (stay_hours BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low, max(stay_hours) FILTER (stay_hours BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high,
    count(*) FILTER (NOT (stay_hours BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))) AS n_beyond FROM responses JOIN q USING (response) GROUP BY response""")
def box_stats(spark, d):
    return P.box_stats(A.responses(spark, d), "response", "stay_hours")


@check("line_series", with_fit(["rates"], rate_cells("rates"), RATE_NAMES) + f"SELECT CAST(x1 + 2010 AS INTEGER) AS year, {rs(BACK_REGION, 1)} AS region, {rs(f'exp({ETA} + off) - exp(y)', 3)} AS bias FROM cells, model")
def line_series(spark, d):
    return bias_by_region(spark, d).orderBy("region", "year")


@check("scatter_fit", f"{A.views('severity')} SELECT {REGION_SQL}, regr_count(severity, year) AS n, {rs('regr_slope(severity, year)')} AS slope, {rs('regr_intercept(severity, year)', 4)} AS intercept FROM severity GROUP BY region")
def scatter_fit(spark, d):
    t = P.trend_lines(severity(spark, d), "year", "severity", ["region"])
    return t.select(region(), "n", rounded(F.col("slope")).alias("slope"), rounded(F.col("intercept"), 4).alias("intercept"))


@check("resid_fitted", with_fit(["rates_filled"], rate_cells("rates_filled"), RATE_NAMES).rstrip() + f", {RESIDUALS} SELECT {rs('fitted', 5)} AS fitted, {rs('r', 5)} AS residual, w AS n FROM res")
def resid_fitted(spark, d):
    t = P.residual_fitted(rate_fit(rates_filled(spark, d)))
    return t.select(rounded(F.col("fitted"), 5).alias("fitted"), rounded(F.col("residual"), 5).alias("residual"), "n")


@check("scale_location", f"{AUGMENT} SELECT category, year, {rs('fitted', 4)} AS fitted, {rs('sqrt(abs(residual))', 4)} AS scale FROM a")
def scale_location(spark, d):
    return P.with_scale(augmented(spark, d)).select("category", "year", rounded(F.col("fitted"), 4).alias("fitted"), rounded(F.col("scale"), 4).alias("scale"))


@check("qq_points", f"""{AUGMENT}, r AS (SELECT category, year, residual, row_number() OVER (PARTITION BY category ORDER BY residual, year) AS rank, count(*) OVER (PARTITION BY category) AS nn FROM a)
    SELECT category, rank, {rs('residual', 4)} AS residual, {rs(normal_quantile('((rank - (CASE WHEN nn <= 10 THEN 0.375 ELSE 0.5 END)) / (nn + 1 - 2 * (CASE WHEN nn <= 10 THEN 0.375 ELSE 0.5 END)))'), 5)} AS theoretical FROM r""")
def qq_points(spark, d):
    t = P.qq_points(augmented(spark, d), ["category"], "residual", ["year"])
    return t.select("category", "rank", rounded(F.col("residual"), 4).alias("residual"), rounded(F.col("theoretical"), 5).alias("theoretical"))


HAT = " + ".join(f"v_{min(i, j)}_{max(i, j)} * x{i} * x{j}" for i in range(8) for j in range(8))
MAIN_ETA = " + ".join(f"b{i} * x{i}" for i in range(8))


@check("leverage_cooks", with_fit(["severity"], OLS_CELLS, OLS_NAMES).rstrip() + f""", hh AS (SELECT {MAIN_ETA} AS fitted, y - ({MAIN_ETA}) AS residual, {HAT} AS hat, w AS n, dispersion FROM cells, model)
    SELECT {rs('fitted', 4)} AS fitted, {rs('residual', 4)} AS residual, {rs('hat')} AS hat, {rs('residual / sqrt(dispersion * (1 - hat))', 4)} AS std_residual,
    {rs('residual * residual / dispersion * hat / pow(1 - hat, 2) / 8')} AS cooks_distance, n FROM hh""")
def leverage_cooks(spark, d):
    t = P.leverage(main_fit(spark, d))
    return t.select(*[rounded(F.col(c), k).alias(c) for c, k in (("fitted", 4), ("residual", 4), ("hat", 6), ("std_residual", 4), ("cooks_distance", 6))], "n")


LOESS_SUMS = ", ".join([f"sum(wt * pow(dx, {i + j})) AS s_{i}_{j}" for i in range(3) for j in range(i, 3)] + [f"sum(wt * total * pow(dx, {i})) AS t_{i}" for i in range(3)])


@check("loess_line", f"""{A.views('letter_years')}, e AS (SELECT category, min(year) AS lo, max(year) AS hi, count(*) AS nn FROM letter_years GROUP BY 1),
    gr AS (SELECT category, nn, place, lo + (hi - lo) * place / 79.0 AS pt FROM e, range(0, 80) r(place)),
    di AS (SELECT g.*, l.total, l.year - pt AS dx, row_number() OVER (PARTITION BY category, place ORDER BY abs(l.year - pt)) AS i FROM gr g JOIN letter_years l USING (category)),
    ba AS (SELECT *, min(abs(dx)) FILTER (i >= floor(nn * 0.75 + 0.00001)) OVER (PARTITION BY category, place) AS h FROM di),
    we AS (SELECT *, CASE WHEN abs(dx) < h THEN pow(1 - pow(abs(dx) / h, 3), 3) ELSE 0 END AS wt FROM ba)
    SELECT category, {rs('pt', 4)} AS year, {rs('b0', 3)} AS smooth FROM {_solve(f'(SELECT category, place, pt, {LOESS_SUMS} FROM we GROUP BY category, place, pt)', 3, 'category, pt')}""")
def loess_line(spark, d):
    t = P.loess_line(letter_years(spark, d), "category", "year", "total")
    return t.select("category", rounded(F.col("year"), 4).alias("year"), rounded(F.col("smooth"), 3).alias("smooth"))


# --- forests and penalised models ------------------------------------------------------------


def forest(spark, d):
    columns = ["ingest_key", "patient_id", "country", "severity", "visit_number", "age", "gender", "urgency", "patient_maximum", "exposure", "year_since", "region3"]
    return FO.fit_forest(severity(spark, d).select(*columns), "severity", "ingest_key", exclude=["patient_id"], trees=40, depth=6)


@check("forest_regression")
def forest_regression(spark, d):
    return FO.forest_fit(forest(spark, d))


@check("forest_importance")
def forest_importance(spark, d):
    return FO.forest_importance(forest(spark, d), "ingest_key")


@check("importance_bars")
def importance_bars(spark, d):
    return FO.ranked_importance(FO.forest_importance(forest(spark, d), "ingest_key"))


@check("spline_gam")
def spline_gam(spark, d):
    smooths = [SM.Smooth("year"), SM.Smooth("log_population", "ln(exposure)")]
    return SM.fit_gam(severity(spark, d), smooths, [Factor("region")], "severity")[0]


@check("random_intercept_logit")
def random_intercept_logit(spark, d):
    table = A.responses(spark, d).join(A.visits(spark, d).select(F.col("ingest_key").alias("visit_key"), "country"), "visit_key")
    priors = (M.prior_terms(M.fit_glm(table, [Factor("sex"), Factor("status")], "response", "binomial").terms(spark)).select(
        "term", F.when(F.col("term") == "(Intercept)", "normal").otherwise("t").alias("family"), "mean", "scale", F.lit(3.0).alias("df")))
    return SM.fit_random_intercept_logit(table, [Factor("sex"), Factor("status"), Numeric("stay_hours")], "country", "response", priors)
