"""Windows, sorts, samples, set operations, reshaping and scalar functions."""

from pyspark.sql import functions as F

from checks import adapters as A
from checks.base import check, rounded, rounded_sql as rs
from checks.joins_and_aggregates import LETTERS, ORDER, REGION_SQL, TOTALS, region, severity
from visitlens.functions import fixed_values as fixed, scalars as S
from visitlens.operators import levels as L, series as SE, summaries as Q, tables as T, visits as V
from visitlens.plans import diagnosis as D
from visitlens.plans.rates import counts_by_region_year, region_year_rates
from visitlens.sources import tables as IO


def numbered_sql(order):
    return f"row_number() OVER (PARTITION BY patient_id ORDER BY {order}) AS visit_number"


@check("visit_number", f"{A.views('visits')} SELECT ingest_key, {numbered_sql('visit_date, ingest_key')} FROM visits")
def visit_number(spark, d):
    return V.visit_number(A.visits(spark, d), "patient_id", ORDER).select("ingest_key", "visit_number")


@check("visit_number_input_order", f"{A.views('visits')} SELECT ingest_key, {numbered_sql('ingest_key')} FROM visits")
def visit_number_input_order(spark, d):
    return V.visit_number(A.visits(spark, d), "patient_id", ["ingest_key"]).select("ingest_key", "visit_number")


@check("first_per_key", f"{A.views('first_visits')} SELECT patient_id, ingest_key, year, severity FROM first_visits")
def first_per_key(spark, d):
    return V.first_visits(A.visits(spark, d), "patient_id", ORDER).select("patient_id", "ingest_key", "year", "severity")


@check("group_max_window", f"{A.views('severity')} SELECT ingest_key, visit_number, patient_maximum FROM severity")
def group_max_window(spark, d):
    return severity(spark, d).select("ingest_key", "visit_number", "patient_maximum")


def placed(spark, d):
    return SE.indexed(A.series(spark, d), ["ts", "event_id"])


@check("diff_lag1", f"{A.views('series')} SELECT event_id, {rs('value - p')} AS difference FROM (SELECT *, lag(value) OVER (ORDER BY ts, event_id) AS p FROM series) WHERE p IS NOT NULL")
def diff_lag1(spark, d):
    return SE.difference(placed(spark, d), "value", "position").select("event_id", rounded(F.col("difference")).alias("difference"))


@check("acf", f"""{A.views('series')}, s AS (SELECT row_number() OVER (ORDER BY ts, event_id) AS i, value - (SELECT avg(value) FROM series) AS x FROM series)
    SELECT CAST(k AS INTEGER) AS lag, {rs('sum(a.x * b.x) / (SELECT sum(x * x) FROM s)', 8)} AS acf
    FROM range(0, 169) r(k), s a JOIN s b ON b.i = a.i + k GROUP BY k""")
def acf(spark, d):
    return SE.autocorrelation(placed(spark, d), "value", "position", 168).select("lag", rounded(F.col("acf"), 8).alias("acf"))


@check("index_to_year", f"""{A.views('rates')} SELECT {REGION_SQL}, CAST(1995 + row_number() OVER (PARTITION BY region ORDER BY year) - 1 AS INTEGER) AS year, count FROM rates""")
def index_to_year(spark, d):
    from visitlens.operators.skew import number_rows
    counted = number_rows(counts_by_region_year(A.visits(spark, d)), ["region"], ["year"], "place")
    return counted.select(region(), (F.col("place") + 1994).cast("int").alias("year"), "count")


@check("ordered_levels", f"""{A.views('visits')} SELECT arrival_mode AS level, CAST(row_number() OVER (ORDER BY arrival_mode <> 'FURNITURE', arrival_mode) AS INTEGER) AS code
    FROM (SELECT DISTINCT arrival_mode FROM visits)""")
def ordered_levels(spark, d):
    return L.level_dictionary(A.visits(spark, d), "arrival_mode", "FURNITURE")


@check("sort_keys", f"{A.views('visits')} SELECT patient_id, CAST(visit_date AS VARCHAR) AS visit_date, ingest_key FROM visits ORDER BY patient_id, visit_date, ingest_key")
def sort_keys(spark, d):
    return A.visits(spark, d).orderBy("patient_id", *ORDER).select("patient_id", F.col("visit_date").cast("string").alias("visit_date"), "ingest_key")


@check("sort_distinct", f"{A.views('visits')} SELECT DISTINCT age FROM visits ORDER BY age")
def sort_distinct(spark, d):
    return A.visits(spark, d).select("age").distinct().orderBy("age")


@check("sample_n", f"{A.views('visits')} SELECT ingest_key, year, severity FROM visits ORDER BY md5(CAST(ingest_key AS VARCHAR) || ':123'), ingest_key LIMIT 650")
def sample_n(spark, d):
    return Q.sample_n(A.visits(spark, d), "ingest_key", 650, 123).select("ingest_key", "year", "severity")


@check("union_rows", f"{A.views('visits')} SELECT patient_id, year, 'F' AS kind FROM visits WHERE gender = 1 UNION ALL SELECT patient_id, year, 'O' FROM visits WHERE gender = 2")
def union_rows(spark, d):
    v = A.visits(spark, d)
    return T.union_tables([v.filter(F.col("gender") == g).select("patient_id", "year", F.lit(k).alias("kind")) for g, k in ((1, "F"), (2, "O"))])


UNPIVOTED = f"(UNPIVOT diagnoses ON {', '.join(A.DX_SLOTS)} INTO NAME slot VALUE code)"


@check("stack_columns", f"{A.views('diagnoses')} SELECT visit_key, code FROM {UNPIVOTED} WHERE code <> '-'")
def stack_columns(spark, d):
    return T.stack_columns(D.blank_missing(A.diagnoses(spark, d), A.DX_SLOTS), A.DX_SLOTS, "code", ["visit_key"])


@check("distinct_rows", f"{A.views('letters')} SELECT DISTINCT letter FROM letters")
def distinct_rows(spark, d):
    return D.first_letters(A.diagnoses(spark, d), A.DX_SLOTS).select("letter").distinct()


@check("pivot_longer", f"{A.views('letter_years')} SELECT year, category, total FROM letter_years")
def pivot_longer(spark, d):
    kept = A.diagnosed_visits(spark, d).filter((F.col("gender") != 0) & F.col("urgency").isNotNull())
    yearly = T.sum_across(D.letter_counts(kept, A.DX_SLOTS, LETTERS), "year", TOTALS)
    return T.pivot_longer(yearly.select("year", *[F.col(c).cast("long").alias(c) for c in TOTALS]), ["year"], "category", "total")


LETTER_COUNT_SQL = ", ".join(f"count(*) FILTER (letter = '{x}') AS {x}_total" for x in LETTERS)


@check("expand_prefix_counts", f"{A.views('letters')} SELECT ingest_key AS visit_key, {LETTER_COUNT_SQL} FROM letters GROUP BY 1")
def expand_prefix_counts(spark, d):
    return D.letter_counts(A.diagnoses(spark, d), A.DX_SLOTS).select("visit_key", *[F.col(c).cast("long").alias(c) for c in TOTALS])


@check("nest_map_unnest", f"""{A.views('letter_years')} SELECT category, {rs('regr_intercept(total, year)', 4)} AS intercept, {rs('regr_slope(total, year)')} AS slope
    FROM letter_years GROUP BY category""")
def nest_map_unnest(spark, d):
    yearly = D.letters_by_year(A.diagnosed_visits(spark, d), A.DX_SLOTS)
    x, y = F.col("year").cast("double"), F.col("total").cast("double")
    return yearly.groupBy("category").agg(rounded(F.regr_intercept(y, x), 4).alias("intercept"), rounded(F.regr_slope(y, x)).alias("slope"))


@check("flag_matrix_to_map", f"{A.views('departments')} SELECT name, arg_max(category, place) AS category FROM departments GROUP BY name")
def flag_matrix_to_map(spark, d):
    seen = A.scan(spark, d, "events").select("event_type").distinct()
    matrix = A.departments(spark).withColumn("NAME", S.clean_department(F.col("NAME")))
    matrix = matrix.join(seen, F.col("NAME") == F.col("event_type"), "left_semi")
    found = T.flag_matrix_to_map(matrix, "NAME", ["ICU", "ER", "HOSPITAL ADMISSION", "Rehabilitation"])
    return found.withColumnRenamed("NAME", "name")


@check("constant_column", f"{A.views('visits')} SELECT ingest_key, 'GLM' AS type FROM visits")
def constant_column(spark, d):
    return A.visits(spark, d).select("ingest_key", F.lit("GLM").alias("type"))


def scalar_check(name, view, key, spark_columns, sql_columns):
    """A scalar function over a whole adapter: {alias: Column} beside {alias: SQL}."""
    sources = {"visits": A.visits, "responses": A.responses, "diagnoses": A.diagnoses, "care_paths": A.care_paths}
    columns = ", ".join(f"{e} AS {a}" for a, e in sql_columns.items())

    @check(name, f"{A.views(view)} SELECT {', '.join(key)}, {columns} FROM {view}")
    def run(spark, d):
        return sources[view](spark, d).select(*key, *[c.alias(a) for a, c in spark_columns().items()])

    return run


V1, R1, D1, P1 = ["ingest_key"], ["visit_key", "line"], ["visit_key"], ["patient_id"]
c = F.col

scalar_check("f_lower", "visits", V1, lambda: {"mode": F.lower("arrival_mode")}, {"mode": "lower(arrival_mode)"})
scalar_check("f_substr", "diagnoses", D1, lambda: {"letter": F.substring("ICD1", 1, 1)}, {"letter": "substr(ICD1, 1, 1)"})
scalar_check("f_detect", "diagnoses", D1,
             lambda: {"is_e": S.starts_with(S.na_if(c("ICD1"), "-"), "E"), "has_dot2": S.contains_any_code(c("ICD2"), ["\\.2"])},
             {"is_e": "coalesce(starts_with(nullif(ICD1, '-'), 'E'), false)", "has_dot2": "regexp_matches(ICD2, '\\.2')"})
scalar_check("f_regex_replace", "visits", V1, lambda: {"short": F.regexp_replace("country", "NATION|_", "")}, {"short": "regexp_replace(country, 'NATION|_', '', 'g')"})
scalar_check("f_split", "care_paths", P1, lambda: {"steps": F.size(S.split_path(c("care_path")))}, {"steps": "CAST(len(string_split_regex(care_path, ';\\s*')) AS INTEGER)"})
scalar_check("f_first_element", "care_paths", P1, lambda: {"first": F.try_element_at(S.split_path(c("care_path")), F.lit(1))}, {"first": "string_split_regex(care_path, ';\\s*')[1]"})
SORTED_UNIQUE = "list_reduce(list_prepend([]::VARCHAR[], list_transform(string_split_regex(care_path, ';\\s*'), lambda x: [x])), lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE list_concat(a, b) END)"
scalar_check("f_array_unique", "care_paths", P1, lambda: {"kinds": F.array_join(F.array_distinct(S.split_path(c("care_path"))), "|")}, {"kinds": f"array_to_string({SORTED_UNIQUE}, '|')"})
scalar_check("f_array_join", "care_paths", P1, lambda: {"joined": F.array_join(S.split_path(c("care_path")), " > ")}, {"joined": "replace(care_path, '; ', ' > ')"})
scalar_check("f_array_map", "care_paths", P1,
             lambda: {"mapped": F.array_join(F.transform(S.split_path(c("care_path")), lambda s: F.coalesce(F.element_at(F.create_map(F.lit("error"), F.lit("ICU"), F.lit("click"), F.lit("ER")), s), F.lit(fixed.UNCATEGORIZED))), ";")},
             {"mapped": "array_to_string(list_transform(string_split_regex(care_path, ';\\s*'), lambda x: CASE x WHEN 'error' THEN 'ICU' WHEN 'click' THEN 'ER' ELSE 'Uncategorized' END), ';')"})
scalar_check("f_concat", "visits", V1, lambda: {"label": F.concat_ws("-", "arrival_mode", "year"), "pasted": F.concat(c("country"), F.lit("!"))}, {"label": "concat_ws('-', arrival_mode, year)", "pasted": "country || '!'"})
scalar_check("f_year", "visits", V1, lambda: {"y": F.year("visit_date")}, {"y": "CAST(year(visit_date) AS INTEGER)"})
scalar_check("f_quarter", "visits", V1, lambda: {"quarteryear": S.quarter_label(c("visit_date"))}, {"quarteryear": "CAST(year(visit_date) AS VARCHAR) || '-Q' || CAST(quarter(visit_date) AS VARCHAR)"})
scalar_check("f_year_month", "visits", V1, lambda: {"ym": S.year_month(c("visit_date"))}, {"ym": "strftime(visit_date, '%Y-%m')"})
scalar_check("f_month_ordinal", "visits", V1, lambda: {"month": S.month_ordinal(F.add_months("visit_date", 150))},
             {"month": "CASE WHEN (year(visit_date + INTERVAL 150 MONTH) - 2010) * 12 + month(visit_date + INTERVAL 150 MONTH) BETWEEN 1 AND 168 THEN CAST((year(visit_date + INTERVAL 150 MONTH) - 2010) * 12 + month(visit_date + INTERVAL 150 MONTH) AS INTEGER) END"})
scalar_check("f_date_literal", "visits", V1, lambda: {"late": c("visit_date") >= F.to_date(F.lit("1998-01-01"))}, {"late": "visit_date >= DATE '1998-01-01'"})
scalar_check("f_within_days", "responses", R1, lambda: {"response": S.within_days(c("arrival_date"), c("death_date"))}, {"response": "CAST(response AS INTEGER)"})
for name, spark_fn, sql_fn in (("f_log", F.ln, "ln({})"), ("f_exp", lambda x: F.exp(-x / 10), "exp(-{} / 10.0)"), ("f_pow10", lambda x: F.pow(F.lit(10.0), x), "pow(10, {})"),
                               ("f_sqrt", F.sqrt, "sqrt({})"), ("f_abs", lambda x: F.abs(x - 3), "abs({} - 3)"), ("f_log_shift", lambda x: S.log_shift(x - 1), "ln({} - 1 + 0.1)"),
                               ("f_sub_const", lambda x: x - 2010, "({} - 2010)")):
    scalar_check(name, "visits", V1, lambda fn=spark_fn: {"v": rounded(fn(c("severity") + 1))}, {"v": rs(sql_fn.format("(severity + 1)"))})
scalar_check("f_if_else", "visits", V1, lambda: {"hurry": S.if_else(c("urgency") == 1, "now", "later")}, {"hurry": "CASE WHEN urgency IS NULL THEN NULL WHEN urgency = 1 THEN 'now' ELSE 'later' END"})
scalar_check("f_case_when", "visits", V1, lambda: {"class": S.first_match([(c("urgency") == 1, "high"), (c("urgency") <= 3, "mid")], "rest")}, {'"class"': "CASE WHEN urgency = 1 THEN 'high' WHEN urgency <= 3 THEN 'mid' ELSE 'rest' END"})
scalar_check("f_case_match", "visits", V1,
             lambda: {"arrival": S.recode_exact(c("arrival_mode"), {"AUTOMOBILE": "Ambulance Service", "MACHINERY": "Ambulance Service", "HOUSEHOLD": "Family"}, "Unknown", "BUILDING")},
             {"arrival": "CASE arrival_mode WHEN 'AUTOMOBILE' THEN 'Ambulance Service' WHEN 'MACHINERY' THEN 'Ambulance Service' WHEN 'HOUSEHOLD' THEN 'Family' WHEN 'BUILDING' THEN NULL ELSE 'Unknown' END"})
scalar_check("f_bin_age", "visits", V1, lambda: {"age_group": S.age_group(c("age"))}, {"age_group": "CASE WHEN age IS NULL THEN 'NA' WHEN age <= 17 THEN '0-17' WHEN age <= 65 THEN '18-65' ELSE '65+' END"})
scalar_check("f_bin_gcs", "visits", V1, lambda: {"gcs": S.gcs_group(c("age") % 18)},
             {"gcs": "CASE WHEN age % 18 BETWEEN 13 AND 15 THEN 'GCS 13-15' WHEN age % 18 BETWEEN 9 AND 12 THEN 'GCS 9-12' WHEN age % 18 BETWEEN 3 AND 8 THEN 'GCS 3-8' END"})
scalar_check("f_na_if", "diagnoses", D1, lambda: {x: S.na_if(c(x), "-") for x in A.DX_SLOTS}, {x: f"nullif({x}, '-')" for x in A.DX_SLOTS})
scalar_check("f_replace_na", "visits", V1, lambda: {"urgency": F.coalesce("urgency", F.lit(0))}, {"urgency": "coalesce(urgency, 0)"})
scalar_check("f_is_na", "visits", V1, lambda: {"no_age": c("age").isNull().cast("int")}, {"no_age": "CAST(age IS NULL AS INTEGER)"})
scalar_check("f_as_numeric", "diagnoses", D1, lambda: {"n": S.as_number(F.substring("ICD1", 2, 4))}, {"n": "TRY_CAST(substr(ICD1, 2, 4) AS DOUBLE)"})
scalar_check("f_as_character", "visits", V1, lambda: {"t": c("patient_id").cast("string")}, {"t": "CAST(patient_id AS VARCHAR)"})
scalar_check("f_as_integer", "diagnoses", D1, lambda: {"n": S.as_number(F.substring("ICD1", 2, 2), "int")}, {"n": "TRY_CAST(substr(ICD1, 2, 2) AS INTEGER)"})
scalar_check("f_row_count_match", "diagnoses", D1, lambda: {"n_s": S.count_prefixed(A.DX_SLOTS, "S")}, {"n_s": "CAST(" + " + ".join(f"CAST(starts_with({x}, 'S') AS INTEGER)" for x in A.DX_SLOTS) + " AS INTEGER)"})


@check("f_override", f"{A.views('rates')} SELECT year, {REGION_SQL}, {rs('CASE WHEN region = 0 THEN 100000.0 ELSE population END', 3)} AS exposure FROM rates")
def f_override(spark, d):
    rates = region_year_rates(A.visits(spark, d), A.population(spark, d))
    return rates.select("year", region(), rounded(S.exposure(c("region"), c("population")), 3).alias("exposure"))


@check("f_month_sequence", f"""{A.views('visits')} SELECT strftime(m, '%Y-%m') AS month, count(ingest_key) AS n
    FROM (SELECT unnest(generate_series(DATE '1995-01-01', DATE '2001-12-01', INTERVAL 1 MONTH)) AS m) LEFT JOIN visits ON strftime(visit_date, '%Y-%m') = strftime(m, '%Y-%m') GROUP BY 1""")
def f_month_sequence(spark, d):
    calendar = spark.range(1).select(F.explode(S.month_sequence("1995-01-01", "2001-12-01")).alias("m")).select(S.year_month(c("m")).alias("month"))
    seen = A.visits(spark, d).groupBy(S.year_month(c("visit_date")).alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return calendar.join(seen, "month", "left").fillna({"n": 0})


def level_check(name, sql, make):
    @check(name, f"{A.views('visits')} {sql}")
    def run(spark, d):
        return make(A.visits(spark, d))


def level_sql(column, where="true", first="false"):
    return f"SELECT {column} AS level, CAST(row_number() OVER (ORDER BY {first}, {column}) AS INTEGER) AS code FROM (SELECT DISTINCT {column} FROM visits WHERE {where} AND {column} IS NOT NULL)"


level_check("f_as_factor", level_sql("urgency"), lambda v: L.level_dictionary(v, "urgency"))
level_check("f_relevel", level_sql("country", first="country <> 'NATION_9'"), lambda v: L.level_dictionary(v, "country", "NATION_9"))
level_check("f_droplevels", level_sql("urgency", "urgency > 1"), lambda v: L.level_dictionary(v.filter(c("urgency") > 1), "urgency"))
