"""Joins, grids and aggregations."""

from pyspark.sql import functions as F

from checks import adapters as A
from checks.base import check, rounded, rounded_sql as rs
from visitlens.functions import scalars as S
from visitlens.operators import levels as L, summaries as Q, tables as T, visits as V
from visitlens.plans.rates import counts_by_region_year, region_population
from visitlens.sources import tables as IO

ORDER = ["visit_date", "ingest_key"]
REGION_SQL = "CAST(region AS DOUBLE) AS region"


def region():
    return F.col("region").cast("double").alias("region")



@check("join_left_2key", f"""{A.views('rates')} SELECT year, {REGION_SQL}, count, {rs('population', 3)} AS population FROM rates""")
def join_left_2key(spark, d):
    counts = counts_by_region_year(A.visits(spark, d))
    joined = counts.join(region_population(A.population(spark, d)), ["year", "region"], "left")
    return joined.select("year", region(), "count", rounded(F.col("population"), 3).alias("population"))


@check("join_inner_2key", f"""{A.views('visits', 'population')} SELECT ingest_key, year, {REGION_SQL}, {rs('pow(10, log10_pop)', 3)} AS population
    FROM visits JOIN population USING (year, region)""")
def join_inner_2key(spark, d):
    joined = A.visits(spark, d).join(A.population(spark, d), ["year", "region"])
    return joined.select("ingest_key", "year", region(), rounded(F.pow(F.lit(10.0), "log10_pop"), 3).alias("population"))


@check("join_back_group_agg", f"""{A.views('visits')} SELECT ingest_key, severity, max(severity) OVER (PARTITION BY patient_id) AS worst FROM visits""")
def join_back_group_agg(spark, d):
    return V.patient_maximum(A.visits(spark, d), "patient_id", "severity", "worst").select("ingest_key", "severity", "worst")


@check("join_full_suffix", f"""{A.views('visits')} SELECT country, a.n AS n_large, b.n AS n_small FROM
    (SELECT country, count(*) AS n FROM visits WHERE gender = 1 AND country <> 'NATION_3' GROUP BY 1) a FULL JOIN
    (SELECT country, count(*) AS n FROM visits WHERE gender = 2 AND country <> 'NATION_7' GROUP BY 1) b USING (country)""")
def join_full_suffix(spark, d):
    v = A.visits(spark, d)
    counted = [
        v.filter((F.col("gender") == g) & (F.col("country") != c)).groupBy("country").agg(F.count(F.lit(1)).alias("n"))
        for g, c in ((1, "NATION_3"), (2, "NATION_7"))
    ]
    return T.full_join_suffixed(*counted, "country", ("_large", "_small"))


@check("cross_grid", f"{A.views('visits')} SELECT * FROM (SELECT DISTINCT year FROM visits), (SELECT DISTINCT {REGION_SQL} FROM visits)")
def cross_grid(spark, d):
    return T.cross_grid(A.visits(spark, d), "year", "region").select("year", region())


@check("zero_fill_grid", f"{A.views('rates_filled')} SELECT year, {REGION_SQL}, count FROM rates_filled")
def zero_fill_grid(spark, d):
    return T.zero_fill_grid(counts_by_region_year(admissions(spark, d)), "year", "region", "count").select("year", region(), "count")


def admissions(spark, d):
    """Urgent visits with one region-year taken out, so that the grid has an empty cell."""
    v = A.visits(spark, d)
    return v.filter((F.col("urgency") == 1) & ((F.col("patient_id") % 97 != 0) | (F.col("year") != 1997))
                    & ((F.col("region") != 4) | (F.col("year") != 1998)))


@check("semi_lookup", f"{A.views('visits')} SELECT ingest_key, country FROM visits WHERE country IN ('NATION_1', 'NATION_2', 'NATION_11')")
def semi_lookup(spark, d):
    table = IO.lookup_table(spark, [("a", "NATION_1"), ("a", "NATION_2"), ("b", "NATION_11"), ("c", "NATION_5")], "area string, code string")
    return T.keep_listed(A.visits(spark, d), F.col("country"), table.filter(F.col("area").isin("a", "b")), "code").select("ingest_key", "country")


@check("anti_lookup", f"{A.views('visits')} SELECT ingest_key, urgency FROM visits WHERE urgency IS NULL OR urgency NOT IN (2, 3)")
def anti_lookup(spark, d):
    table = IO.lookup_table(spark, [(2,), (3,)], "code int")
    return T.drop_listed(A.visits(spark, d), F.col("urgency"), table, "code").select("ingest_key", "urgency")


@check("map_lookup", """SELECT event_id, CASE event_type WHEN 'error' THEN 'ICU' WHEN 'click' THEN 'ER' WHEN 'view' THEN 'Rehabilitation'
    WHEN 'purchase' THEN 'HOSPITAL ADMISSION' ELSE 'Uncategorized' END AS category FROM events""")
def map_lookup(spark, d):
    table = T.flag_matrix_to_map(
        A.departments(spark).withColumn("NAME", S.clean_department(F.col("NAME"))), "NAME",
        ["ICU", "ER", "HOSPITAL ADMISSION", "Rehabilitation"],
    )
    events = A.scan(spark, d, "events").select("event_id", "event_type")
    return T.lookup(events, F.col("event_type"), table, "NAME", "category", "category", "Uncategorized").select("event_id", "category")


@check("index_lookup", f"""{A.views('visits')} SELECT ingest_key, CAST(i AS INTEGER) AS country_index FROM visits JOIN
    (SELECT country, row_number() OVER (ORDER BY country) AS i FROM (SELECT DISTINCT country FROM visits)) USING (country)""")
def index_lookup(spark, d):
    return L.encode(A.visits(spark, d), "country", "country_index").select("ingest_key", "country_index")


@check("count_by_keys", f"{A.views('visits')} SELECT year, {REGION_SQL}, count(*) AS count FROM visits GROUP BY ALL")
def count_by_keys(spark, d):
    return counts_by_region_year(A.visits(spark, d)).select("year", region(), "count")


@check("max_by_key", f"""{A.views('visits')} SELECT patient_id, max(visit_number) AS patient_maximum FROM
    (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY visit_date, ingest_key) AS visit_number FROM visits)
    WHERE gender <> 0 AND urgency IS NOT NULL GROUP BY 1""")
def max_by_key(spark, d):
    numbered = V.visit_number(A.visits(spark, d), "patient_id", ORDER).filter((F.col("gender") != 0) & F.col("urgency").isNotNull())
    return numbered.groupBy("patient_id").agg(F.max("visit_number").alias("patient_maximum"))


@check("mean_by_key", f"{A.views('severity')} SELECT region3, {rs('avg(exposure)', 4)} AS population FROM severity GROUP BY 1")
def mean_by_key(spark, d):
    return severity(spark, d).groupBy("region3").agg(rounded(F.avg("exposure"), 4).alias("population"))


def severity(spark, d):
    from visitlens.plans.severity import severity_table
    return severity_table(A.visits(spark, d), A.population(spark, d), ORDER)


LETTERS = ["E", "L", "M", "P", "S"]
TOTALS = [f"{x}_total" for x in LETTERS]


@check("sum_across_by_key", f"{A.views('visits', 'letters')} SELECT year, "
       + ", ".join(f"count(*) FILTER (letter = '{x}') AS {x}_total" for x in LETTERS)
       + " FROM visits JOIN letters USING (ingest_key) GROUP BY year")
def sum_across_by_key(spark, d):
    from visitlens.plans.diagnosis import letter_counts
    return T.sum_across(letter_counts(A.diagnosed_visits(spark, d), A.DX_SLOTS, LETTERS), "year", TOTALS).select(
        "year", *[F.col(c).cast("long").alias(c) for c in TOTALS])


@check("col_sums", f"{A.views('visits', 'letters')} SELECT letter || '_total' AS category, count(*) AS total FROM visits JOIN letters USING (ingest_key) GROUP BY 1")
def col_sums(spark, d):
    from visitlens.plans.diagnosis import letter_counts
    return T.column_sums(letter_counts(A.diagnosed_visits(spark, d), A.DX_SLOTS, LETTERS), TOTALS, "category", "total")


@check("freq_1way", f"{A.views('visits')} SELECT urgency, count(*) AS n FROM visits WHERE urgency IS NOT NULL GROUP BY 1")
def freq_1way(spark, d):
    return Q.frequencies(A.visits(spark, d), "urgency")


@check("freq_1way_na", f"{A.views('visits')} SELECT urgency, count(*) AS n FROM visits GROUP BY 1")
def freq_1way_na(spark, d):
    return Q.frequencies(A.visits(spark, d), "urgency", with_null=True)


@check("crosstab_2way", f"""{A.views('responses')} SELECT arrival_mode, count(*) FILTER (response = 0) AS n_0, count(*) FILTER (response = 1) AS n_1
    FROM responses GROUP BY 1""")
def crosstab_2way(spark, d):
    return Q.crosstab(A.responses(spark, d), "arrival_mode", "response", [0, 1])


@check("null_counts", f"{A.views('visits')} SELECT count(*) - count(age) AS age, count(*) - count(urgency) AS urgency, count(*) - count(region) AS region FROM visits")
def null_counts(spark, d):
    return Q.null_counts(A.visits(spark, d).select("age", "urgency", "region"))


@check("null_profile_long", f"""{A.views('visits')} SELECT 'age' AS "column", count(*) - count(age) AS num_na FROM visits UNION ALL
    SELECT 'urgency', count(*) - count(urgency) FROM visits UNION ALL SELECT 'region', count(*) - count(region) FROM visits""")
def null_profile_long(spark, d):
    return Q.null_profile_long(A.visits(spark, d).select("age", "urgency", "region"))


@check("rare_level_lump", f"""{A.views('visits')} SELECT ingest_key, CASE WHEN count(*) OVER (PARTITION BY patient_id) < 10 THEN '>50'
    ELSE CAST(patient_id AS VARCHAR) END AS patient_id FROM visits""")
def rare_level_lump(spark, d):
    return Q.lump_rare(A.visits(spark, d).select("ingest_key", "patient_id"), "patient_id", 10)


@check("keep_other", f"""{A.views('visits')} SELECT ingest_key, CASE WHEN country IN ('NATION_1', 'NATION_4') THEN country ELSE '>50' END AS country FROM visits""")
def keep_other(spark, d):
    return A.visits(spark, d).select("ingest_key", Q.keep_levels(F.col("country"), ["NATION_1", "NATION_4"]).alias("country"))


@check("distinct_values", f"{A.views('visits')} SELECT DISTINCT country FROM visits")
def distinct_values(spark, d):
    return A.visits(spark, d).select("country").distinct()


@check("count_distinct", f"{A.views('visits')} SELECT count(DISTINCT country) - 1 AS n_countries, count(DISTINCT year) - 1 AS n_years FROM visits")
def count_distinct(spark, d):
    return A.visits(spark, d).agg((F.count_distinct("country") - 1).alias("n_countries"), (F.count_distinct("year") - 1).alias("n_years"))


@check("moments", f"""{A.views('rates')} SELECT {rs('avg(count)')} AS mean, {rs('var_samp(count)', 4)} AS variance, {rs('stddev_samp(count)')} AS sd,
    min(count) AS min, max(count) AS max FROM rates""")
def moments(spark, d):
    m = Q.moments(counts_by_region_year(A.visits(spark, d)), "count")
    return m.select(rounded(F.col("mean")).alias("mean"), rounded(F.col("variance"), 4).alias("variance"), rounded(F.col("sd")).alias("sd"), "min", "max")


@check("share_where", f"{A.views('visits')} SELECT {rs('avg(CASE WHEN severity = 0 THEN 1.0 ELSE 0.0 END)')} AS share_zero FROM visits")
def share_where(spark, d):
    return A.visits(spark, d).agg(rounded(F.avg((F.col("severity") == 0).cast("double"))).alias("share_zero"))


SUMMARY_COLUMNS = ["age", "severity", "urgency"]


@check("summary_table", f"{A.views('visits')} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS n, count(*) - count({c}) AS n_missing, count(DISTINCT {c}) AS n_distinct, {rs(f'avg({c})')} AS mean,
    {rs(f'stddev_samp({c})')} AS sd, """ + ", ".join(f"{rs(f'quantile_cont({c}, {p})')} AS {n}" for p, n in
    ((0, "min"), (0.25, "q1"), (0.5, "median"), (0.75, "q3"), (1, "max"))) + " FROM visits" for c in SUMMARY_COLUMNS))
def summary_table(spark, d):
    s = Q.summary_table(A.visits(spark, d), SUMMARY_COLUMNS)
    return s.select("column", "n", "n_missing", "n_distinct", *[rounded(F.col(c)).alias(c) for c in ("mean", "sd", "min", "q1", "median", "q3", "max")])


@check("draw_summary", f"""{A.views('draws')} SELECT parameter, {rs('avg(value)')} AS mean, {rs('stddev_samp(value)')} AS sd, {rs('quantile_cont(value, 0.5)')} AS median,
    {rs('quantile_cont(value, 0.025)')} AS ci_low, {rs('quantile_cont(value, 0.975)')} AS ci_high FROM draws GROUP BY parameter""")
def draw_summary(spark, d):
    s = Q.draw_summary(A.draws(spark, d))
    return s.select("parameter", *[rounded(F.col(c)).alias(c) for c in ("mean", "sd", "median", "ci_low", "ci_high")])


@check("pearson_corr", f"{A.views('severity')} SELECT {rs('corr(severity, patient_maximum)')} AS correlation FROM severity")
def pearson_corr(spark, d):
    return severity(spark, d).agg(rounded(F.corr("severity", "patient_maximum")).alias("correlation"))


@check("rmse", f"{A.views('visits')} SELECT {rs('sqrt(avg(pow(severity - (urgency - 1), 2)))')} AS rmse FROM visits")
def rmse(spark, d):
    return A.visits(spark, d).agg(rounded(Q.rmse(F.col("severity"), F.col("urgency") - 1)).alias("rmse"))


@check("pseudo_r2", f"""{A.views('visits')} SELECT {rs('sum(pow(urgency - severity, 2))')} AS rss, {rs('regr_syy(severity, 1)', 4)} AS tss,
    {rs('1 - sum(pow(urgency - severity, 2)) / regr_syy(severity, 1)')} AS r_squared FROM visits WHERE urgency IS NOT NULL""")
def pseudo_r2(spark, d):
    s = Q.pseudo_r2(A.visits(spark, d), "severity", "urgency")
    return s.select(rounded(F.col("rss")).alias("rss"), rounded(F.col("tss"), 4).alias("tss"), rounded(F.col("r_squared")).alias("r_squared"))
