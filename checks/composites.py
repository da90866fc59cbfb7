"""The composite queries: cohort, model tables, rates, severity and diagnosis trends."""

from pyspark.sql import functions as F

from checks import adapters as A
from checks.base import check, rounded, rounded_sql as rs
from checks.joins_and_aggregates import ORDER, REGION_SQL, admissions, region, severity
from visitlens.plans import cohort as C, diagnosis as D, rates as R
from visitlens.sources.tables import lookup_table


def dictionaries(spark):
    arrivals = [("AUTOMOBILE", "Ambulance Service"), ("MACHINERY", "Ambulance Service"), ("HOUSEHOLD", "Family")]
    places = [("nation_1", "home", 1), ("nation_2", "home", 1), ("nation_2", "traffic accidents", 2),
              ("nation_5", "traffic accidents", 2), ("nation_6", "traffic accidents", 2)]
    return C.Dictionaries(
        codes=["E1.", "S2.\\.3", "P0.\\.1", "L"],
        excluded_episodes=lookup_table(spark, [("E5",)], "episode_name string"),
        postcodes=lookup_table(spark, [(str(100 + i),) for i in range(19)], "postcode string"),
        arrivals=lookup_table(spark, arrivals, "value string, result string"),
        causes=lookup_table(spark, [("BUILDING", "Work"), ("AUTOMOBILE", "Transportation/traffic")], "value string, result string"),
        places=lookup_table(spark, places, "value string, result string, priority int"),
    )


def cohort(spark, d):
    return C.cohort(A.registry(spark, d), dictionaries(spark))


def pathed(spark, d):
    return C.categorise_care_path(C.missing_flags(cohort(spark, d)), A.departments(spark))


MODEL_COLUMNS = ["patient_id", "monthyear", "postalcode", "response", "age_group", "sex", "arrival", "cause", "place",
                 "care_path", "stay_hours", "missing_gcs", "missing_cause", "missing_arrival", "missing_care_path"]
COHORT_SQL = ", ".join(C.COHORT_COLUMNS).replace("monthyear", "CAST(monthyear AS INTEGER) AS monthyear")
MODEL_SQL = ", ".join(MODEL_COLUMNS).replace("monthyear", "CAST(monthyear AS INTEGER) AS monthyear")


@check("cohort_build", f"{A.views('cohort')} SELECT {COHORT_SQL} FROM cohort")
def cohort_build(spark, d):
    return cohort(spark, d)


@check("missing_flags", f"{A.views('flagged')} SELECT patient_id, visit_count, missing_gcs, missing_cause, missing_arrival, missing_care_path FROM flagged")
def missing_flags(spark, d):
    return C.missing_flags(cohort(spark, d)).select("patient_id", "visit_count", "missing_gcs", "missing_cause", "missing_arrival", "missing_care_path")


CATEGORY_LIST = """list_transform(string_split_regex(care_path, ';\\s*'), lambda x: CASE x WHEN 'error' THEN 'ICU' WHEN 'click' THEN 'ER'
    WHEN 'view' THEN 'Rehabilitation' WHEN 'purchase' THEN 'HOSPITAL ADMISSION' ELSE 'Uncategorized' END)"""


@check("carepath_categorise", f"""{A.views('care_paths')} SELECT patient_id, visit_date, categories,
    CASE WHEN first = 'Rehabilitation' THEN 'Uncategorized' ELSE first END AS care_path FROM (SELECT patient_id, CAST(visit_date AS VARCHAR) AS visit_date, cats[1] AS first,
    array_to_string(list_reduce(list_prepend([]::VARCHAR[], list_transform(cats, lambda x: [x])), lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE list_concat(a, b) END), '; ') AS categories
    FROM (SELECT *, {CATEGORY_LIST} AS cats FROM care_paths))""")
def carepath_categorise(spark, d):
    paths = A.care_paths(spark, d).withColumn(
        "categories", F.array_join(C.path_categories(F.col("care_path"), C.department_map(A.departments(spark))), "; "))
    return C.categorise_care_path(paths, A.departments(spark)).select("patient_id", F.col("visit_date").cast("string").alias("visit_date"), "categories", "care_path")


@check("model_tables", f"""{A.views('large')} SELECT 'large' AS kind, {MODEL_SQL} FROM large UNION ALL
    SELECT 'small', {MODEL_SQL} FROM large WHERE care_path <> 'Uncategorized'""")
def model_tables(spark, d):
    large, small = C.model_tables(pathed(spark, d))
    return large.select(F.lit("large").alias("kind"), *MODEL_COLUMNS).unionByName(small.select(F.lit("small").alias("kind"), *MODEL_COLUMNS))


ARRIVAL3 = "CASE arrival WHEN 'Ambulance Service' THEN 'Ambulance' WHEN 'Family' THEN 'Family' ELSE 'Other' END AS arrival"


@check("eda_refine", f"""{A.views('large')} SELECT 'large' AS kind, patient_id, CASE WHEN count(*) OVER (PARTITION BY postalcode) < 50 THEN '>50' ELSE postalcode END AS postalcode,
    age_group, {ARRIVAL3} FROM large WHERE age_group <> '0-17' UNION ALL
    SELECT 'small', patient_id, CASE WHEN postalcode IN ('101', '104', '110', '>50') THEN postalcode ELSE '>50' END, age_group, {ARRIVAL3}
    FROM large WHERE care_path <> 'Uncategorized' AND age_group <> '0-17'""")
def eda_refine(spark, d):
    tables = C.refine_for_models(*C.model_tables(pathed(spark, d)), ["101", "104", "110", ">50"])
    parts = [t.select(F.lit(k).alias("kind"), "patient_id", "postalcode", "age_group", "arrival") for t, k in zip(tables, ("large", "small"))]
    return parts[0].unionByName(parts[1])


def rate_sql(view):
    region3 = "" if view == "rates_filled" else "region3, "
    return f"""{A.views(view)} SELECT year, {REGION_SQL}, count, {rs('population', 3)} AS population, {region3}
        CAST(year_since AS INTEGER) AS year_since, {rs('log_count')} AS log_count FROM {view}"""


def rate_columns(rates, filled=False):
    return rates.select("year", region(), "count", rounded(F.col("population"), 3).alias("population"), *([] if filled else ["region3"]),
                        F.col("year_since").cast("int").alias("year_since"), rounded(F.col("log_count")).alias("log_count"))


@check("region_year_rates", rate_sql("rates"))
def region_year_rates(spark, d):
    return rate_columns(R.region_year_rates(A.visits(spark, d), A.population(spark, d)))


@check("region_year_rates_first", rate_sql("rates_first"))
def region_year_rates_first(spark, d):
    return rate_columns(R.region_year_rates_first(A.visits(spark, d), A.population(spark, d), ORDER))


@check("region_year_rates_filled", rate_sql("rates_filled"))
def region_year_rates_filled(spark, d):
    return rate_columns(R.region_year_rates_filled(admissions(spark, d), A.population(spark, d)), True)


@check("severity_table", f"""{A.views('severity')} SELECT patient_id, ingest_key, year, {REGION_SQL}, age, gender, urgency, severity, visit_number,
    patient_maximum, {rs('exposure', 3)} AS exposure, CAST(year_since AS INTEGER) AS year_since, region3 FROM severity""")
def severity_table(spark, d):
    return severity(spark, d).select("patient_id", "ingest_key", "year", region(), "age", "gender", "urgency", "severity", "visit_number",
                                     "patient_maximum", rounded(F.col("exposure"), 3).alias("exposure"), F.col("year_since").cast("int").alias("year_since"), "region3")


@check("icd_letter_totals", f"{A.views('visits', 'letters')} SELECT letter || '_total' AS category, count(*) AS total FROM visits JOIN letters USING (ingest_key) GROUP BY 1")
def icd_letter_totals(spark, d):
    return D.letter_totals(A.diagnosed_visits(spark, d), A.DX_SLOTS)


@check("icd_letter_by_year", f"{A.views('letter_years')} SELECT year, category, total FROM letter_years")
def icd_letter_by_year(spark, d):
    return D.letters_by_year(A.diagnosed_visits(spark, d), A.DX_SLOTS)
