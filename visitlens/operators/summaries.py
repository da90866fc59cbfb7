"""Frequencies, shares, null profiles, moments, quantiles and exact-size samples."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from visitlens.functions import fixed_values as fixed
from visitlens.operators.sizing import durable, local_table, range_partitions, rows_if_small, scalar, small_table
from visitlens.operators.skew import join_per_key, number_rows


def frequencies(df: DataFrame, column: str, with_null: bool = False, out: str = "n") -> DataFrame:
    """Rows per level; missing values are a level of their own only on request."""
    rows = df if with_null else df.filter(F.col(column).isNotNull())
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias(out))


def crosstab(df: DataFrame, row: str, column: str, levels: Sequence, prefix: str = "n_") -> DataFrame:
    """Level by level counts with zero cells, as one aggregate over given column levels."""
    cells = [
        F.count_if(F.col(column).eqNullSafe(F.lit(level))).alias(f"{prefix}{level}") for level in levels
    ]
    return df.filter(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(row).agg(*cells)


def null_counts(df: DataFrame) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])


def null_profile_long(df: DataFrame) -> DataFrame:
    """(column, num_na) for every column, and no rows at all when nothing is missing."""
    wide = null_counts(df)
    some = F.greatest(*[F.col(c) for c in wide.columns], F.lit(0)) > 0
    return wide.filter(some).unpivot([], wide.columns, "column", "num_na")


def lump_rare(
    df: DataFrame, column: str, minimum: int = fixed.RARE_LEVEL_MINIMUM, label: str = fixed.RARE_LEVEL_LABEL
) -> DataFrame:
    """Levels with fewer than `minimum` rows become `label`; nulls stay null."""
    rare = (
        frequencies(df, column, out="_n").filter(F.col("_n") < minimum).select(column, F.lit(True).alias("_rare"))
    )
    few = rows_if_small(rare)
    if few is not None:
        # Broadcasting the short list leaves the rows where they are.
        joined = df.join(F.broadcast(local_table(df.sparkSession, few, rare.schema)), column, "left")
    else:
        joined = join_per_key(df, rare, [column])
    lumped = F.when(F.col("_rare"), F.lit(label)).otherwise(F.col(column).cast("string"))
    return joined.select(*[lumped.alias(c) if c == column else F.col(c) for c in df.columns])


def keep_levels(column: Column, kept: Sequence[str], other: str = fixed.RARE_LEVEL_LABEL) -> Column:
    """Listed levels stay, every other known level becomes `other`."""
    return F.when(column.isNull(), F.lit(None)).when(column.isin(list(kept)), column).otherwise(other)


def moments(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.avg(column).alias("mean"),
        F.var_samp(column).alias("variance"),
        F.stddev_samp(column).alias("sd"),
        F.min(column).alias("min"),
        F.max(column).alias("max"),
    )


SKETCH = 2_000
SHORT_GROUP = 10 * SKETCH
LONGEST_BRACKET = 1_000_000


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Sequence[float],
    out: str = "quantiles",
    spread: bool = True,
) -> DataFrame:
    """Exact linearly interpolated quantiles per group, as an array in the order asked for.

    Nothing is sorted as a whole: mergeable rank sketches give each quantile of a long group a bracket of values, a second
    pass counts what lies below the brackets and ranks only the values inside. Short groups, at most `SHORT_GROUP` rows, take
    the built-in percentile. `spread=False` takes it for all groups, where they are known to be short.
    """
    if not keys:
        # One constant key makes the whole table a single heavy group.
        whole = df.select(F.lit(0).alias("_all"), value)
        return quantiles(whole, ["_all"], value, probabilities, out, spread).drop("_all")
    keys, wanted = list(keys), [float(p) for p in probabilities]
    rows = df.select(*keys, F.col(value).cast("double").alias(value)).filter(F.col(value).isNotNull())
    if not spread:
        return rows.groupBy(*keys).agg(F.percentile(value, wanted).alias(out))
    slack, steps = 2 / SKETCH, sorted(set(wanted))
    ends = [e for p in steps for e in (max(p - slack, 0.0), min(p + slack, 1.0))]
    stats = durable(rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_size"), F.min(value).alias("_least"), F.max(value).alias("_most"),
        F.percentile_approx(value, ends, SKETCH).alias("_ends")))
    groups, total, longest, shortest = stats.agg(F.count(F.lit(1)), F.sum("_size"), F.max("_size"), F.min("_size")).first()
    if not groups or longest <= SHORT_GROUP:
        return rows.groupBy(*keys).agg(F.percentile(value, wanted).alias(out))
    # Heavy keys are known from the sizes; no more than 1 / share of them can be.
    heavy = stats.filter(F.col("_size") > max(0.5 / range_partitions(stats), 1e-4) * total).select(F.xxhash64(*keys)).collect()
    heavy = [r[0] for r in heavy]
    sized = join_per_key(rows, small_table(stats), keys, "inner", heavy, match_nulls=True)
    found = _bracketed(sized.filter(F.col("_size") > SHORT_GROUP), stats.filter(F.col("_size") > SHORT_GROUP), keys, value, wanted, steps, out)
    if shortest > SHORT_GROUP:
        return found
    return found.unionByName(sized.filter(F.col("_size") <= SHORT_GROUP).groupBy(*keys).agg(F.percentile(value, wanted).alias(out)))


def _bracketed(sized: DataFrame, stats: DataFrame, keys: list[str], value: str, wanted: list[float], steps: list[float], out: str) -> DataFrame:
    """Quantiles of long groups; `sized` rows carry the ends of all brackets, two per step in ascending order."""
    v = F.col(value)
    # The outermost brackets reach the ends of the group.
    low = [F.col("_least") if p - 2 / SKETCH <= 0 else F.get("_ends", F.lit(2 * i)) for i, p in enumerate(steps)]
    high = [F.col("_most") if p + 2 / SKETCH >= 1 else F.get("_ends", F.lit(2 * i + 1)) for i, p in enumerate(steps)]
    under = sum(((v >= x).cast("int") for x in low), F.lit(0))  # brackets from this one on lie above the value
    inside = [F.when(v.between(a, b), F.struct(F.lit(i).alias("_step"), v.alias(value))) for i, (a, b) in enumerate(zip(low, high))]
    below = F.struct(under.alias("_step"), F.lit(None).cast("double").alias(value))
    places = F.filter(F.array(below, *inside), lambda x: x.isNotNull())
    counted = durable(
        sized.select(*keys, F.explode(places).alias("_at")).groupBy(*keys, F.col("_at")["_step"].alias("_step"), F.col("_at")[value].alias(value))
        .agg(F.count(F.lit(1)).alias("_copies")))
    bases = counted.filter(v.isNull()).groupBy(*keys).agg(F.array(*[
        F.coalesce(F.sum(F.when(F.col("_step") <= i, F.col("_copies"))), F.lit(0)) for i in range(len(steps))]).alias("_below"))
    inner = counted.filter(v.isNotNull())
    own = [*keys, "_step"]
    most = inner.groupBy(*own).count().agg(F.max("count")).first()[0]
    if most > LONGEST_BRACKET:
        placed = cumulative_counts(inner, own, value)
    else:
        earlier = Window.partitionBy(*own).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        placed = inner.withColumn("_before", F.coalesce(F.sum("_copies").over(earlier), F.lit(0)))
    # One row per group on the other side; brackets are a small part of the rows.
    sizes = join_per_key(bases, stats.select(*keys, "_size"), keys, "inner", [], match_nulls=True)
    placed = join_per_key(placed, small_table(sizes), keys, "inner", [], match_nulls=True)
    before = F.col("_before") + F.get("_below", F.col("_step"))
    picks = []
    for i, p in enumerate(steps):
        height = (F.col("_size") - 1) * F.lit(p)
        for name, rank in ((f"_low{i}", F.floor(height)), (f"_high{i}", F.ceil(height))):
            holds = (F.col("_step") == i) & (before <= rank) & (rank < before + F.col("_copies"))
            picks.append(F.max(F.when(holds, v)).alias(name))
    picked = placed.groupBy(*keys).agg(*picks, F.max("_size").alias("_size"))
    values = []
    for p in wanted:
        i = steps.index(p)
        height = (F.col("_size") - 1) * F.lit(p)
        lower, upper = F.col(f"_low{i}"), F.col(f"_high{i}")
        missed = F.raise_error(F.lit("a rank sketch missed its quantile")).cast("double")
        values.append(F.when(lower.isNull() | upper.isNull(), missed).otherwise(lower + (upper - lower) * (height - F.floor(height))))
    return picked.select(*keys, F.array(*values).alias(out))


def counted_quantiles(
    counted: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float], out: str = "quantiles", spread: bool = True
) -> DataFrame:
    """As `quantiles`, from the distinct values of each group with their number of rows, `_copies`."""
    keys, wanted = list(keys), [float(p) for p in probabilities]
    if not spread:
        return counted.groupBy(*keys).agg(F.percentile(value, wanted, F.col("_copies")).alias(out))
    sizes = counted.groupBy(*keys).agg(F.sum("_copies").alias("_size"))
    placed = join_per_key(cumulative_counts(counted, keys, value), small_table(sizes), keys, "inner", match_nulls=True)
    picks, values = [], []
    for i, p in enumerate(wanted):
        height = (F.col("_size") - 1) * F.lit(p)
        for name, rank in ((f"_low{i}", F.floor(height)), (f"_high{i}", F.ceil(height))):
            holds = (F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_copies"))
            picks.append(F.max(F.when(holds, F.col(value))).alias(name))
        lower, upper = F.col(f"_low{i}"), F.col(f"_high{i}")
        values.append(lower + (upper - lower) * (height - F.floor(height)))
    return placed.groupBy(*keys).agg(*picks, F.max("_size").alias("_size")).select(*keys, F.array(*values).alias(out))


def cumulative_counts(distinct: DataFrame, keys: list[str], value: str) -> DataFrame:
    """`_before`: rows before each distinct value (`_copies` rows each) of its group, by a two-level running sum.

    Values are ranked without holding a group in one task; ranks are cut into blocks, the running sum
    is taken inside a block, and the block totals, few per group, carry the sums of earlier blocks.
    """
    block = 100_000
    ranked = number_rows(distinct, keys, [value], "_rank").withColumn(
        "_block", F.floor((F.col("_rank") - 1) / F.lit(block))
    )
    totals = ranked.groupBy(*keys, "_block").agg(F.sum("_copies").alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.withColumn("_base", F.coalesce(F.sum("_total").over(earlier), F.lit(0))).drop("_total")
    inside = Window.partitionBy(*keys, "_block").orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
    within = ranked.withColumn("_inside", F.coalesce(F.sum("_copies").over(inside), F.lit(0)))
    joined = join_per_key(within, bases, [*keys, "_block"], hot=[], match_nulls=True)
    return joined.withColumn("_before", F.col("_base") + F.col("_inside"))


def summary_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per numeric column: count, missing, distinct, mean, sd and the five quartile points."""
    long = df.select([F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "column", "value")
    basics = long.groupBy("column").agg(
        F.count("value").alias("n"),
        F.count_if(F.col("value").isNull()).alias("n_missing"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("sd"),
    )
    # Two-step distinct count: values are deduplicated over all tasks before they are counted.
    distinct = (
        long.filter("value is not null").groupBy("column", "value").count().groupBy("column")
        .agg(F.count(F.lit(1)).alias("n_distinct"))
    )
    points = quantiles(long, ["column"], "value", [0, 0.25, 0.5, 0.75, 1])
    names = ["min", "q1", "median", "q3", "max"]
    return (
        basics.join(distinct, "column", "left").join(points, "column", "left")
        .select("column", "n", "n_missing", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"), "mean", "sd",
                *[F.get("quantiles", F.lit(i)).alias(n) for i, n in enumerate(names)])
    )


def draw_summary(draws: DataFrame, spread: bool = True) -> DataFrame:
    """Mean, sd, median and the 95 % interval of each parameter's draws."""
    basics = draws.groupBy("parameter").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    points = quantiles(draws, ["parameter"], "value", [0.5, 0.025, 0.975], spread=spread)
    return basics.join(points, "parameter").select(
        "parameter", "mean", "sd",
        *[F.get("quantiles", F.lit(i)).alias(n) for i, n in enumerate(["median", "ci_low", "ci_high"])],
    )


def rmse(observed: Column, predicted: Column) -> Column:
    return F.sqrt(F.avg(F.pow(predicted - observed, F.lit(2))))


def pseudo_r2(df: DataFrame, observed: str, predicted: str) -> DataFrame:
    """1 − RSS/TSS on the response scale, from one pass."""
    gap = F.col(predicted) - F.col(observed)
    return df.filter(F.col(observed).isNotNull() & F.col(predicted).isNotNull()).agg(
        F.sum(gap * gap).alias("rss"), F.regr_syy(F.col(observed).cast("double"), F.lit(1.0)).alias("tss")
    ).select("rss", "tss", (1 - F.col("rss") / F.col("tss")).alias("r_squared"))


def share_of_total(df: DataFrame, count: str, out: str = "share") -> DataFrame:
    return df.withColumn(out, F.col(count) / scalar(df, F.sum(count)))


def sample_n(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """Exactly `n` rows, those with the smallest keyed hashes: uniform, seeded and repeatable.

    A hash cutoff keeps about `n` candidates first, so no task sorts the whole; if the cutoff kept too
    few, the full table is ranked.
    """
    rank = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    rows = df
    total = df.count()
    wanted = n + 10 * math.sqrt(n) + 100
    if total > wanted:
        cutoff = format(int(wanted / total * 2**32), "08x")
        near = df.filter(rank < cutoff)
        rows = near if near.count() >= n else df
    return rows.orderBy(rank, key).limit(n)
