"""Heavy keys take another plan than the others but must give the same rows."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from visitlens.operators import skew, sizing, summaries, tables


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows on one key, some on the null key, the rest spread."""
    n = F.col("id")
    key = F.when(n % 3 == 0, 7).when(n % 17 == 0, F.lit(None)).otherwise(n % 101)
    return spark.range(9_000).select(
        key.cast("long").alias("k"), F.xxhash64(n).alias("when"), n.alias("id"), (n * 37 % 1000 / 10).alias("v")
    ).repartition(6)


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_hot_tokens_find_the_heavy_key(spark, skewed):
    hot = skew.hot_tokens(skewed, ["k"])
    heavy = spark.range(1).select(F.xxhash64(F.lit(7).cast("long"))).first()[0]
    assert heavy in hot and len(hot) <= 20


def test_numbering_is_the_same_on_both_plans(skewed):
    hot = skew.hot_tokens(skewed, ["k"], 0.05)
    plain = skew.number_rows(skewed, ["k"], ["when", "id"], "i", hot=[])
    spread = skew.number_rows(skewed, ["k"], ["when", "id"], "i", hot=hot)
    assert rows(plain) == rows(spread.select(*plain.columns))


def test_numbering_keeps_descending_order(skewed):
    hot = skew.hot_tokens(skewed, ["k"], 0.05)
    order = [F.desc("when"), "id"]
    assert rows(skew.number_rows(skewed, ["k"], order, "i", hot=[])) == rows(skew.number_rows(skewed, ["k"], order, "i", hot=hot))


def test_group_value_on_rows_with_salts_and_nulls(skewed):
    hot = skew.hot_tokens(skewed, ["k"], 0.05)
    plain = skew.with_group_value(skewed, ["k"], [], top=F.max("v"))
    salted = skew.with_group_value(skewed, ["k"], hot, top=F.max("v"))
    assert rows(plain) == rows(salted)
    assert plain.filter("k is null and top is null").count() == 0


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_salted_join_matches_plain_join(skewed, how):
    table = skewed.groupBy("k").agg(F.count("*").alias("n")).filter("k % 2 = 1")
    hot = skew.hot_tokens(skewed, ["k"], 0.05)
    assert rows(skew.join_per_key(skewed, table, ["k"], how, [])) == rows(skew.join_per_key(skewed, table, ["k"], how, hot))


def test_global_index_is_the_sorted_position(skewed):
    placed = skew.global_index(skewed, ["when", "id"])
    got = [r["id"] for r in placed.orderBy("position").collect()]
    want = [r["id"] for r in skewed.orderBy("when", "id").collect()]
    assert got == want
    assert [r["position"] for r in placed.orderBy("position").collect()] == list(range(9_000))


def test_quantiles_without_group_buffers(skewed):
    probabilities = [0, 0.025, 0.25, 0.5, 0.975, 1]
    plain = {r["k"]: r["q"] for r in summaries.quantiles(skewed, ["k"], "v", probabilities, "q", spread=False).collect()}
    spread = {r["k"]: r["q"] for r in summaries.quantiles(skewed, ["k"], "v", probabilities, "q", spread=True).collect()}
    assert plain.keys() == spread.keys()
    for key, values in plain.items():
        np.testing.assert_allclose(spread[key], values, atol=1e-9)


@pytest.mark.parametrize("longest", [1_000_000, 50])
def test_quantiles_of_long_groups_come_from_brackets(spark, monkeypatch, longest):
    """Long and short groups, a null key, ties, a constant group, and quantiles at and next to both ends."""
    i = F.col("id")
    rows = spark.range(200_000).select(
        F.when(i < 90_000, "wide").when(i < 130_000, "ties").when(i < 160_000, "flat").when(i < 185_000, None)
        .otherwise(F.concat(F.lit("s"), i % 700)).alias("k"),
        F.when(i < 90_000, F.pmod(F.xxhash64(i), F.lit(1_000_003)) / 7.0).when(i < 130_000, F.when(i % 3 == 0, 5.0).otherwise((i % 40).cast("double")))
        .when(i < 160_000, 2.5).otherwise(F.pmod(F.xxhash64(i), F.lit(997)).cast("double")).alias("v"))
    rows = rows.unionByName(spark.createDataFrame([("wide", None), ("none", None)], "k string, v double")).repartition(7)
    probabilities = [0.5, 0.0, 0.0004, 0.025, 0.25, 0.975, 0.9999, 1.0]
    monkeypatch.setattr(summaries, "LONGEST_BRACKET", longest)
    plain, found = ({r["k"]: r["q"] for r in summaries.quantiles(rows, ["k"], "v", probabilities, "q", spread=s).collect()} for s in (False, True))
    assert len(found) == 704 and found.keys() == plain.keys()
    for k in plain:
        assert found[k] == pytest.approx(plain[k], rel=1e-12)


def test_quantiles_sort_no_rows(spark, monkeypatch):
    """Rows are aggregated, never ranked."""
    monkeypatch.setattr(summaries, "number_rows", None)
    rows = spark.range(60_000).select(F.lit("a").alias("k"), F.pmod(F.xxhash64("id"), F.lit(50_000)).cast("double").alias("v"))
    assert summaries.quantiles(rows, ["k"], "v", [0.1]).count() == 1
    assert summaries.quantiles(rows.filter("v < 0"), ["k"], "v", [0.1]).count() == 0


def test_overall_quantiles_need_no_key(skewed):
    got = summaries.quantiles(skewed, [], "v", [0.5], "q", spread=True).first()["q"][0]
    assert got == pytest.approx(np.median([r["v"] for r in skewed.collect()]))


def test_sample_is_that_of_a_full_ranking(skewed):
    rank = F.md5(F.concat(F.col("id").cast("string"), F.lit(":5")))
    sample = rows(summaries.sample_n(skewed, "id", 120, 5))
    assert sample == rows(skewed.orderBy(rank, "id").limit(120)) and sum(sample.values()) == 120
    assert rows(summaries.sample_n(skewed, "id", 20_000, 5)) == rows(skewed)


def test_grid_of_values_with_nulls(skewed):
    got = rows(tables.cross_grid(skewed.select("k", (F.col("id") % 5).alias("five")), "five", "k"))
    keys = {r["k"] for r in skewed.collect()} - {None}
    assert got == Counter((five, key) for five in range(5) for key in keys)


def test_rare_levels_with_long_lists_take_the_join(skewed, monkeypatch):
    plain = rows(summaries.lump_rare(skewed, "k", 60))
    monkeypatch.setattr(summaries, "rows_if_small", lambda df: None)
    assert rows(summaries.lump_rare(skewed, "k", 60)) == plain
    assert any(key[0] == ">50" for key in plain) and any(key[0] is None for key in plain)


def test_small_table_is_only_marked_when_small(spark):
    few = sizing.small_table(spark.range(10))
    assert few.count() == 10
    many = spark.range(30)
    assert sizing.small_table(many, 20) is many


def test_local_session_may_fall_back_to_its_own_checkpoint_folder(spark):
    assert sizing.checkpoint_folder(spark)
