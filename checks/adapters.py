"""The test tables seen as visits, population, diagnoses, responses, care paths, series and draws.

Every adapter has its Spark form and the same definition as a SQL view (`views`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from visitlens.functions import scalars as S
from visitlens.operators.sizing import local_table, small_table
from visitlens.sources.tables import scan_table

DX_SLOTS = [f"ICD{i}" for i in range(1, 8)]


# Schemas of the test tables: with them a scan needs no job of its own to read file footers.
SCHEMAS = {
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "embeddings": "vec_id long, embedding array<float>, label int",
}


def scan(spark: SparkSession, d: str, name: str) -> DataFrame:
    return scan_table(spark, d, name, StructType.fromDDL(SCHEMAS[name]))


def region_code() -> Column:
    key = F.col("n_regionkey")
    return F.when(key == 2, F.lit("1.5").cast("decimal(4,1)")).otherwise(key.cast("decimal(4,1)"))


def visits(spark: SparkSession, d: str) -> DataFrame:
    joined = (
        scan(spark, d, "orders")
        .join(scan(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(scan(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    )
    year = F.year("o_orderdate")
    digit = F.substring("o_orderpriority", 1, 1).cast("int")
    return joined.select(
        F.col("o_custkey").alias("patient_id"),
        F.col("o_orderkey").alias("ingest_key"),
        F.to_date("o_orderdate").alias("visit_date"),
        year.alias("year"),
        region_code().alias("region"),
        F.col("n_name").alias("country"),
        F.when(F.col("o_custkey") % 50 != 0, ((F.col("o_custkey") * 7 + year) % 100).cast("int")).alias("age"),
        F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(0).alias("gender"),
        F.when(digit != 4, digit).alias("urgency"),
        F.col("c_mktsegment").alias("arrival_mode"),
        (F.floor("o_totalprice") % 5).cast("int").alias("severity"),
    )


def population(spark: SparkSession, d: str) -> DataFrame:
    """(year, region, log10_pop) with a total row per year; (2001, 4) is left out so that a key is missing."""
    counted = (
        scan(spark, d, "lineitem")
        .join(scan(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(scan(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .groupBy(F.year("l_shipdate").alias("year"), region_code().alias("region"))
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(~((F.col("year") == 2001) & (F.col("region") == 4)))
    )
    counted = small_table(counted)
    totals = counted.groupBy("year").agg(F.sum("n").alias("n")).withColumn("region", F.lit(9).cast("decimal(4,1)"))
    return counted.unionByName(totals).select("year", "region", F.log10("n").alias("log10_pop"))


def diagnoses(spark: SparkSession, d: str) -> DataFrame:
    """Seven diagnosis columns per visit, "-" where a slot is empty."""
    code = F.concat(
        F.substring("p_type", 1, 1), F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit("."),
        F.col("l_linenumber").cast("string"),
    )
    lines = scan(spark, d, "lineitem").join(
        scan(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")
    )
    slots = [
        F.coalesce(F.min(F.when(F.col("l_linenumber") == i, code)), F.lit("-")).alias(name)
        for i, name in enumerate(DX_SLOTS, start=1)
    ]
    return lines.groupBy(F.col("l_orderkey").alias("visit_key")).agg(*slots)


def diagnosed_visits(spark: SparkSession, d: str) -> DataFrame:
    found = diagnoses(spark, d)
    return visits(spark, d).join(found, F.col("ingest_key") == F.col("visit_key")).drop("visit_key")


def responses(spark: SparkSession, d: str) -> DataFrame:
    """Arrival and, for some, death, with the 90-day response."""
    lines = scan(spark, d, "lineitem").join(
        scan(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    rows = lines.select(
        F.col("l_orderkey").alias("visit_key"),
        F.col("l_linenumber").alias("line"),
        F.col("o_orderdate").alias("arrival_date"),
        F.when(F.col("l_returnflag") == "R", F.col("l_shipdate")).alias("death_date"),
        F.col("l_linestatus").alias("status"),
        F.col("l_quantity").alias("stay_hours"),
        F.col("o_orderpriority").alias("arrival_mode"),
        F.col("o_orderstatus").alias("sex"),
    )
    return rows.withColumn("response", S.within_days(F.col("arrival_date"), F.col("death_date")))


def care_paths(spark: SparkSession, d: str) -> DataFrame:
    """One path per user and day: event types in time order, "; " between them."""
    steps = F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type")))
    return (
        scan(spark, d, "events")
        .groupBy(F.col("user_id").alias("patient_id"), F.to_date("ts").alias("visit_date"))
        .agg(F.array_join(F.transform(steps, lambda s: s["event_type"]), "; ").alias("care_path"))
    )


def registry(spark: SparkSession, d: str) -> DataFrame:
    """A visit registry with every column the cohort needs, dates moved onto the closed calendar."""
    v = visits(spark, d).join(diagnoses(spark, d), F.col("ingest_key") == F.col("visit_key"))
    paths = care_paths(spark, d).select(
        F.col("patient_id").alias("user"), F.dayofmonth("visit_date").alias("day"), "care_path"
    )
    users = scan(spark, d, "events").agg(F.max("user_id") + 1).first()[0]
    v = v.join(paths, (F.col("patient_id") % users == F.col("user")) & (F.col("ingest_key") % 30 + 1 == F.col("day")), "left")
    arrival = F.add_months("visit_date", 150)
    key, patient = F.col("ingest_key"), F.col("patient_id")
    return v.select(
        "patient_id", "ingest_key", F.col("age").cast("double").alias("age"),
        (patient % 6).cast("string").alias("sex_code"),
        F.when(F.col("country") == "NATION_3", "SE").otherwise("IS").alias("nationality"),
        (100 + patient % 41 % 23).cast("string").alias("postcode"),
        arrival.cast("timestamp").alias("arrival_date"),
        F.when(key % 3 == 0, F.date_add(arrival, (key % 300 - 50).cast("int"))).cast("timestamp").alias("death_date"),
        F.when(F.col("urgency") != 2, F.concat(F.lit("E"), "urgency")).alias("episode_name"),
        (key % 480 / 10.0).alias("stay_hours"),
        F.concat_ws(" ", *DX_SLOTS).alias("dx_text"),
        F.when(F.col("gender") != 0, F.col("arrival_mode")).alias("cause"),
        F.when(key % 11 == 0, "NA").when(key % 13 != 0, F.col("arrival_mode")).alias("arrival_mode"),
        F.col("country").alias("place"), (F.col("age") % 18).cast("double").alias("gcs"), "care_path",
    )


def departments(spark: SparkSession) -> DataFrame:
    """Department flags; `purchase` carries two categories and `signup` none."""
    rows = [
        ('[1] "error"', 1, None, None, None), ('[2] "click"', 0, 1, None, None),
        ('[3] "view"', None, None, None, 1), ('[4] "purchase"', None, 1, 1, None),
        ('[5] "signup"', None, None, None, None),
    ]
    return local_table(
        spark, rows, "NAME string, `ICU` int, `ER` int, `HOSPITAL ADMISSION` int, `Rehabilitation` int"
    )


def series(spark: SparkSession, d: str) -> DataFrame:
    return scan(spark, d, "events").select("ts", "event_id", "user_id", "value")


def draws(spark: SparkSession, d: str) -> DataFrame:
    return scan(spark, d, "embeddings").select(
        (F.col("vec_id") % 4).cast("int").alias("chain"),
        F.floor(F.col("vec_id") / 4).cast("int").alias("iter"),
        F.posexplode("embedding").alias("place", "draw"),
    ).select("chain", "iter", F.concat(F.lit("p"), "place").alias("parameter"), F.col("draw").cast("double").alias("value"))


REGION_SQL = "CAST(CASE n_regionkey WHEN 2 THEN 1.5 ELSE n_regionkey END AS DECIMAL(4,1))"

VIEWS = {
    "visits": f"""SELECT o_custkey AS patient_id, o_orderkey AS ingest_key, CAST(o_orderdate AS DATE) AS visit_date,
        CAST(year(o_orderdate) AS INTEGER) AS year, {REGION_SQL} AS region, n_name AS country,
        CASE WHEN o_custkey % 50 <> 0 THEN CAST((7 * o_custkey + year(o_orderdate)) % 100 AS INTEGER) END AS age,
        CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS gender,
        CASE WHEN substr(o_orderpriority, 1, 1) <> '4' THEN CAST(substr(o_orderpriority, 1, 1) AS INTEGER) END AS urgency,
        c_mktsegment AS arrival_mode, CAST(CAST(floor(o_totalprice) AS BIGINT) % 5 AS INTEGER) AS severity
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "pop_counts": f"""SELECT year, region, count(*) AS n FROM
        (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, {REGION_SQL} AS region
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)
        WHERE NOT (year = 2001 AND region = 4) GROUP BY year, region""",
    "population": """SELECT year, region, log10(n) AS log10_pop FROM pop_counts
        UNION ALL SELECT year, CAST(9 AS DECIMAL(4,1)), log10(sum(n)) FROM pop_counts GROUP BY year""",
    "diagnoses": "SELECT l_orderkey AS visit_key, " + ", ".join(
        f"coalesce(min(CASE WHEN l_linenumber = {i} THEN code END), '-') AS {name}"
        for i, name in enumerate(DX_SLOTS, start=1)
    ) + """ FROM (SELECT l_orderkey, l_linenumber,
        substr(p_type, 1, 1) || lpad(CAST(p_size AS VARCHAR), 2, '0') || '.' || CAST(l_linenumber AS VARCHAR) AS code
        FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY l_orderkey""",
    "diagnosed": "SELECT v.*, " + ", ".join(DX_SLOTS) + " FROM visits v JOIN diagnoses ON ingest_key = visit_key",
    "responses": """SELECT *, CASE WHEN death_date IS NOT NULL AND arrival_date IS NOT NULL
        AND epoch_us(death_date) - epoch_us(arrival_date) <= 90 * 86400000000 THEN 1 ELSE 0 END AS response
        FROM (SELECT l_orderkey AS visit_key, l_linenumber AS line, o_orderdate AS arrival_date,
        CASE WHEN l_returnflag = 'R' THEN l_shipdate END AS death_date, l_linestatus AS status,
        l_quantity AS stay_hours, o_orderpriority AS arrival_mode, o_orderstatus AS sex
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "care_paths": """SELECT user_id AS patient_id, CAST(ts AS DATE) AS visit_date,
        string_agg(event_type, '; ' ORDER BY ts, event_id) AS care_path FROM events GROUP BY ALL""",
    "registry": """SELECT patient_id, ingest_key, CAST(age AS DOUBLE) AS age, CAST(patient_id % 6 AS VARCHAR) AS sex_code,
        CASE WHEN country = 'NATION_3' THEN 'SE' ELSE 'IS' END AS nationality,
        CAST(100 + patient_id % 41 % 23 AS VARCHAR) AS postcode, CAST(visit_date + INTERVAL 150 MONTH AS DATE) AS arrival_date,
        CASE WHEN ingest_key % 3 = 0 THEN CAST(visit_date + INTERVAL 150 MONTH AS DATE) + CAST(ingest_key % 300 - 50 AS INTEGER) END AS death_date,
        CASE WHEN urgency <> 2 THEN 'E' || urgency END AS episode_name, CAST(ingest_key % 480 AS DOUBLE) / 10 AS stay_hours,
        concat_ws(' ', ICD1, ICD2, ICD3, ICD4, ICD5, ICD6, ICD7) AS dx_text,
        CASE WHEN gender <> 0 THEN arrival_mode END AS cause,
        CASE WHEN ingest_key % 11 = 0 THEN 'NA' WHEN ingest_key % 13 <> 0 THEN arrival_mode END AS arrival_mode,
        country AS place, CAST(age % 18 AS DOUBLE) AS gcs, p.care_path
        FROM visits JOIN diagnoses ON ingest_key = visit_key LEFT JOIN
        (SELECT patient_id AS usr, dayofmonth(visit_date) AS dom, care_path FROM care_paths) p
        ON patient_id % (SELECT max(user_id) + 1 FROM events) = usr AND ingest_key % 30 + 1 = dom""",
    "included": """SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY ingest_key) AS visit_count FROM registry
        WHERE regexp_matches(dx_text, 'E1.|S2.\\.3|P0.\\.1|L') AND nationality = 'IS'
        AND (episode_name IS NULL OR episode_name NOT IN ('E5')) AND CAST(postcode AS INTEGER) BETWEEN 100 AND 118""",
    "cohort": """SELECT patient_id, CASE WHEN (year(arrival_date) - 2010) * 12 + month(arrival_date) BETWEEN 1 AND 168
        THEN (year(arrival_date) - 2010) * 12 + month(arrival_date) END AS monthyear,
        CAST(year(arrival_date) AS VARCHAR) || '-Q' || CAST(quarter(arrival_date) AS VARCHAR) AS quarteryear,
        CASE WHEN n_post < 50 THEN '>50' ELSE postcode END AS postalcode,
        CASE WHEN death_date IS NOT NULL AND date_diff('day', arrival_date, death_date) <= 90 THEN 1 ELSE 0 END AS response,
        CASE WHEN age IS NULL THEN 'NA' WHEN age <= 17 THEN '0-17' WHEN age <= 65 THEN '18-65' ELSE '65+' END AS age_group,
        CASE WHEN sex_code IN ('1', '3') THEN 'male' ELSE 'female' END AS sex,
        CASE WHEN arrival_mode = 'NA' THEN NULL WHEN arrival_mode IN ('AUTOMOBILE', 'MACHINERY') THEN 'Ambulance Service'
        WHEN arrival_mode = 'HOUSEHOLD' THEN 'Family' ELSE 'Unknown' END AS arrival,
        CASE cause WHEN 'BUILDING' THEN 'Work' WHEN 'AUTOMOBILE' THEN 'Transportation/traffic' ELSE 'Unknown' END AS cause,
        CASE WHEN place IN ('NATION_1', 'NATION_2') THEN 'home' WHEN place IN ('NATION_5', 'NATION_6') THEN 'traffic accidents' ELSE 'unknown' END AS place,
        care_path, visit_count,
        CASE WHEN gcs BETWEEN 13 AND 15 THEN 'GCS 13-15' WHEN gcs BETWEEN 9 AND 12 THEN 'GCS 9-12' WHEN gcs BETWEEN 3 AND 8 THEN 'GCS 3-8' END AS gcs_group,
        stay_hours FROM (SELECT *, count(*) OVER (PARTITION BY postcode) AS n_post FROM included) WHERE sex_code IN ('1', '2', '3', '4')""",
    "flagged": """SELECT * EXCLUDE (gcs_group), CAST(gcs_group IS NULL AS INTEGER) AS missing_gcs, CASE WHEN cause = 'Unknown' THEN 1 ELSE 0 END AS missing_cause,
        CASE WHEN arrival IS NULL THEN NULL WHEN arrival = 'Unknown' THEN 1 ELSE 0 END AS missing_arrival,
        CAST(care_path IS NULL AS INTEGER) AS missing_care_path FROM cohort""",
    "pathed": """SELECT * REPLACE (CASE WHEN care_path LIKE 'error%' THEN 'ICU' WHEN care_path LIKE 'click%' THEN 'ER'
        WHEN care_path LIKE 'purchase%' THEN 'HOSPITAL ADMISSION' ELSE 'Uncategorized' END AS care_path) FROM flagged""",
    "large": "SELECT * EXCLUDE (visit_count) FROM pathed WHERE visit_count = 1",
    "departments": """SELECT * FROM (VALUES ('error', 'ICU', 0), ('click', 'ER', 1), ('view', 'Rehabilitation', 4),
        ('purchase', 'ER', 1), ('purchase', 'HOSPITAL ADMISSION', 2)) t(name, category, place)""",
    "series": "SELECT ts, event_id, user_id, value FROM events",
    "draws": """SELECT CAST(vec_id % 4 AS INTEGER) AS chain, CAST(vec_id // 4 AS INTEGER) AS iter,
        'p' || CAST(place - 1 AS VARCHAR) AS parameter, CAST(embedding[place] AS DOUBLE) AS value
        FROM embeddings, LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS place)""",
    "rates": """SELECT c.year, c.region, c.n AS count, pow(10, p.log10_pop) AS population,
        CASE WHEN c.region = 1 THEN 'Capital' WHEN c.region = 1.5 THEN 'Surrounding Area' ELSE 'Other' END AS region3,
        c.year - 2010 AS year_since, ln(c.n) AS log_count
        FROM (SELECT year, region, count(*) AS n FROM visits GROUP BY ALL) c
        LEFT JOIN (SELECT * FROM population WHERE region <> 9) p USING (year, region)""",
    "first_visits": """SELECT * FROM visits QUALIFY row_number() OVER
        (PARTITION BY patient_id ORDER BY visit_date, ingest_key) = 1""",
    "rates_first": """SELECT c.year, c.region, c.n AS count, pow(10, p.log10_pop) AS population,
        CASE WHEN c.region = 1 THEN 'Capital' WHEN c.region = 1.5 THEN 'Surrounding Area' ELSE 'Other' END AS region3,
        c.year - 2010 AS year_since, ln(c.n) AS log_count
        FROM (SELECT year, region, count(*) AS n FROM first_visits GROUP BY ALL) c
        LEFT JOIN (SELECT * FROM population WHERE region <> 9) p USING (year, region)""",
    "admissions": "SELECT * FROM visits WHERE urgency = 1 AND (patient_id % 97 <> 0 OR year <> 1997) AND (region <> 4 OR year <> 1998)",
    "rates_filled": """SELECT g.year, g.region, coalesce(c.n, 0) AS count, pow(10, p.log10_pop) AS population,
        g.year - 2010 AS year_since, ln(coalesce(c.n, 0) + 0.1) AS log_count
        FROM (SELECT * FROM (SELECT DISTINCT year FROM admissions), (SELECT DISTINCT region FROM admissions)) g
        LEFT JOIN (SELECT year, region, count(*) AS n FROM admissions GROUP BY ALL) c USING (year, region)
        LEFT JOIN (SELECT * FROM population WHERE region <> 9) p USING (year, region)""",
    "severity": """SELECT v.*,
        CASE WHEN region = 0 THEN 100000.0::DOUBLE ELSE pow(10, p.log10_pop) END AS exposure,
        year - 2010 AS year_since, CASE WHEN region = 1 THEN 'Capital' WHEN region = 1.5 THEN 'Surrounding Area'
        ELSE 'Countryside' END AS region3
        FROM (SELECT *, max(visit_number) OVER (PARTITION BY patient_id) AS patient_maximum
        FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY visit_date, ingest_key)
        AS visit_number FROM visits) WHERE gender <> 0 AND urgency IS NOT NULL) v
        JOIN population p USING (year, region)""",
    "letters": "SELECT visit_key AS ingest_key, substr(code, 1, 1) AS letter FROM (UNPIVOT diagnoses ON "
        + ", ".join(DX_SLOTS) + " INTO NAME slot VALUE code) WHERE code <> '-'",
    "letter_years": """SELECT year, letter || '_total' AS category, count(*) AS total FROM visits JOIN letters USING (ingest_key)
        WHERE gender <> 0 AND urgency IS NOT NULL GROUP BY ALL""",
}

DEPENDS = {
    "registry": ["visits", "diagnoses", "care_paths"], "included": ["registry"], "cohort": ["included"], "flagged": ["cohort"],
    "pathed": ["flagged"], "large": ["pathed"],
    "population": ["pop_counts"], "diagnosed": ["visits", "diagnoses"], "rates": ["visits", "population"],
    "first_visits": ["visits"], "rates_first": ["first_visits", "population"], "admissions": ["visits"],
    "rates_filled": ["admissions", "population"], "severity": ["visits", "population"], "letters": ["diagnoses"],
    "letter_years": ["visits", "letters"],
}


def views(*names: str) -> str:
    """A WITH clause defining the named views and those they need."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in DEPENDS.get(name, []):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in ordered)
