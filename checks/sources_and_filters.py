"""Scans, sinks, projections, filters and predicates."""

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType, TimestampNTZType

from checks import adapters as A
from checks.base import check, rounded, rounded_sql as rs, scratch
from visitlens.functions import fixed_values as fixed, scalars as S
from visitlens.operators import series as SE, tables as T
from visitlens.sources import tables as IO

ORDERS_SCHEMA = StructType([
    StructField("o_orderkey", LongType()), StructField("o_custkey", LongType()),
    StructField("o_orderstatus", StringType()), StructField("o_totalprice", DoubleType()),
    StructField("o_orderdate", TimestampNTZType()), StructField("o_orderpriority", StringType()),
])


@check("scan_table", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders")
def scan_table(spark, d):
    return IO.scan_table(spark, d, "orders", ORDERS_SCHEMA).withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


@check("scan_lookup", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def scan_lookup(spark, d):
    path = IO.write_csv(A.scan(spark, d, "nation"), f"{scratch(spark)}/nation")
    nation = IO.scan_csv(spark, path, "n_nationkey int, n_name string, n_regionkey int")
    customer = A.scan(spark, d, "customer")
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


VISIT_COLUMNS = "patient_id, ingest_key, CAST(visit_date AS VARCHAR) AS visit_date, year, CAST(region AS DOUBLE) AS region, age, gender, urgency, severity"


def plain(df):
    return df.select("patient_id", "ingest_key", F.col("visit_date").cast("string").alias("visit_date"), "year",
                     F.col("region").cast("double").alias("region"), "age", "gender", "urgency", "severity")


@check("scan_snapshot", f"{A.views('visits')} SELECT {VISIT_COLUMNS} FROM visits")
def scan_snapshot(spark, d):
    folder = scratch(spark)
    IO.write_snapshot(A.visits(spark, d), folder, "visits", "1", ["year"])
    return plain(IO.read_snapshot(spark, folder, "visits", "1"))


@check("sink_snapshot", f"{A.views('visits')} SELECT {VISIT_COLUMNS} FROM visits")
def sink_snapshot(spark, d):
    folder = scratch(spark)
    IO.write_snapshot(A.visits(spark, d), folder, "visits", "1")
    return plain(IO.read_snapshot(spark, folder, "visits", "1"))


@check("snapshot_versions", f"""{A.views('visits')} SELECT '1' AS version, count(*) AS n_rows, false AS newest FROM visits WHERE severity > 3
    UNION ALL SELECT '2', count(*), true FROM visits""")
def snapshot_versions(spark, d):
    """The published versions, and whether a reader that names none gets as many rows."""
    folder, visits = scratch(spark), A.visits(spark, d)
    IO.write_snapshot(visits.filter("severity > 3"), folder, "visits", "1", ["year"])
    IO.write_snapshot(visits, folder, "visits", "2")
    read = IO.read_snapshot(spark, folder, "visits").agg(F.count(F.lit(1))).scalar()
    return IO.published_snapshots(spark, folder, "visits").select("version", "n_rows", (F.col("n_rows") == read).alias("newest"))


@check("sink_csv", f"{A.views('visits')} SELECT year, CAST(region AS DOUBLE) AS region, count(*) AS n FROM visits GROUP BY ALL")
def sink_csv(spark, d):
    counts = A.visits(spark, d).groupBy("year", F.col("region").cast("double").alias("region")).agg(F.count(F.lit(1)).alias("n"))
    return IO.scan_csv(spark, IO.write_csv(counts, f"{scratch(spark)}/counts"), "year int, region double, n long")


@check("samples_io", f"{A.views('draws')} SELECT chain, iter, parameter, value FROM draws")
def samples_io(spark, d):
    folder = scratch(spark)
    IO.write_draws(A.draws(spark, d), folder, "draws", "1")
    back = IO.read_snapshot(spark, folder, "draws", "1")
    return back.select("chain", "iter", "parameter", "value")


@check("sink_trend", f"{A.views('letter_years')} SELECT year, category, total FROM letter_years")
def sink_trend(spark, d):
    from visitlens.plans.diagnosis import letters_by_year
    trend = letters_by_year(A.diagnosed_visits(spark, d), A.DX_SLOTS)
    return IO.scan_csv(spark, IO.write_csv(trend, f"{scratch(spark)}/trend"), "year int, category string, total long")


@check("inline_dict", """SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'wheels' WHEN 'MACHINERY' THEN 'wheels'
    WHEN 'BUILDING' THEN 'site' END AS kind FROM customer""")
def inline_dict(spark, d):
    kinds = IO.lookup_table(spark, [("AUTOMOBILE", "wheels"), ("MACHINERY", "wheels"), ("BUILDING", "site")], "c_mktsegment string, kind string")
    return A.scan(spark, d, "customer").join(kinds, "c_mktsegment", "left").select("c_custkey", "kind")


@check("profile_shape", """SELECT (SELECT count(*) FROM orders) AS n_rows, * FROM (VALUES (1, 'o_orderkey', 'bigint'),
    (2, 'o_custkey', 'bigint'), (3, 'o_orderstatus', 'string'), (4, 'o_totalprice', 'double'),
    (5, 'o_orderdate', 'timestamp_ntz'), (6, 'o_orderpriority', 'string')) t(ordinal, "column", type)""")
def profile_shape(spark, d):
    return IO.profile_shape(IO.scan_table(spark, d, "orders"))


@check("select_cols", f"{A.views('visits')} SELECT patient_id, year, CAST(region AS DOUBLE) AS region FROM visits")
def select_cols(spark, d):
    return A.visits(spark, d).select("patient_id", "year", F.col("region").cast("double").alias("region"))


@check("select_rename", f"{A.views('visits')} SELECT patient_id AS research_id, severity AS score, arrival_mode AS arrival FROM visits")
def select_rename(spark, d):
    names = {"patient_id": "research_id", "severity": "score", "arrival_mode": "arrival"}
    return A.visits(spark, d).select(*[F.col(old).alias(new) for old, new in names.items()])


@check("rename_cols", "SELECT c_custkey AS patient, c_name, c_nationkey AS country, c_acctbal, c_mktsegment FROM customer")
def rename_cols(spark, d):
    return A.scan(spark, d, "customer").withColumnsRenamed({"c_custkey": "patient", "c_nationkey": "country"})


@check("drop_cols", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def drop_cols(spark, d):
    return A.scan(spark, d, "customer").drop("c_name", "c_acctbal")


@check("select_by_pattern", f"{A.views('diagnoses')} SELECT {', '.join(A.DX_SLOTS)} FROM diagnoses")
def select_by_pattern(spark, d):
    found = A.diagnoses(spark, d)
    return found.select(*T.columns_matching(found, "icd.*"))


@check("derive_col", f"{A.views('visits')} SELECT ingest_key, year - 2010 AS year_since, {rs('ln(severity + 1)')} AS log_score FROM visits")
def derive_col(spark, d):
    return A.visits(spark, d).withColumns({
        "year_since": F.col("year") - fixed.CALENDAR_START_YEAR, "log_score": rounded(F.ln(F.col("severity") + 1)),
    }).select("ingest_key", "year_since", "log_score")


@check("filter_eq_ne", f"{A.views('visits')} SELECT ingest_key, gender, arrival_mode FROM visits WHERE gender <> 0 AND arrival_mode = 'BUILDING'")
def filter_eq_ne(spark, d):
    return A.visits(spark, d).filter((F.col("gender") != 0) & (F.col("arrival_mode") == "BUILDING")).select("ingest_key", "gender", "arrival_mode")


@check("filter_index", f"""{A.views('visits')} SELECT ingest_key, age FROM visits
    WHERE CASE WHEN age IS NULL THEN 'NA' WHEN age <= 17 THEN '0-17' ELSE 'older' END <> '0-17'""")
def filter_index(spark, d):
    return A.visits(spark, d).filter(S.age_group(F.col("age")) != "0-17").select("ingest_key", "age")


@check("filter_notnull", f"{A.views('visits')} SELECT ingest_key, urgency FROM visits WHERE urgency IS NOT NULL")
def filter_notnull(spark, d):
    return A.visits(spark, d).filter(F.col("urgency").isNotNull()).select("ingest_key", "urgency")


@check("filter_in", f"{A.views('visits')} SELECT ingest_key, urgency FROM visits WHERE urgency IN (1, 5)")
def filter_in(spark, d):
    return A.visits(spark, d).filter(S.is_in(F.col("urgency"), [1, 5])).select("ingest_key", "urgency")


@check("filter_not_in", f"{A.views('visits')} SELECT ingest_key, urgency FROM visits WHERE urgency IS NULL OR urgency NOT IN (1, 5)")
def filter_not_in(spark, d):
    return A.visits(spark, d).filter(S.not_in(F.col("urgency"), [1, 5])).select("ingest_key", "urgency")


@check("filter_code_match", f"{A.views('diagnoses')} SELECT visit_key, ICD1 FROM diagnoses WHERE regexp_matches(ICD1 || ' ' || ICD2, 'E1.\\.1|P0[1-5].2|S4')")
def filter_code_match(spark, d):
    text = F.concat_ws(" ", "ICD1", "ICD2")
    return A.diagnoses(spark, d).filter(S.contains_any_code(text, ["E1.\\.1", "P0[1-5].2", "S4"])).select("visit_key", "ICD1")


@check("position_where", f"""{A.views('visits')} SELECT position, ingest_key, severity FROM
    (SELECT *, row_number() OVER (ORDER BY visit_date, ingest_key) AS position FROM visits) WHERE severity > 3""")
def position_where(spark, d):
    placed = SE.indexed(A.visits(spark, d).select("visit_date", "ingest_key", "severity"), ["visit_date", "ingest_key"])
    return placed.filter(F.col("severity") > 3).select("position", "ingest_key", "severity")


@check("slice_rows", f"""{A.views('visits')} SELECT position, ingest_key, severity FROM
    (SELECT *, row_number() OVER (ORDER BY visit_date, ingest_key) AS position FROM visits) WHERE position BETWEEN 501 AND 800""")
def slice_rows(spark, d):
    placed = SE.indexed(A.visits(spark, d).select("visit_date", "ingest_key", "severity"), ["visit_date", "ingest_key"])
    return SE.slice_rows(placed, 501, 800).select("position", "ingest_key", "severity")


@check("subset_per_level", f"{A.views('rates')} SELECT CAST(region AS DOUBLE) AS region, count(*) AS n_years, CAST(sum(count) AS BIGINT) AS n_visits FROM rates GROUP BY region")
def subset_per_level(spark, d):
    from visitlens.plans.rates import counts_by_region_year
    counts = counts_by_region_year(A.visits(spark, d))
    return counts.groupBy(F.col("region").cast("double").alias("region")).agg(F.count(F.lit(1)).alias("n_years"), F.sum("count").alias("n_visits"))
