"""Fits whose factors have more levels than a dense matrix could hold.

One wide factor is eliminated: its block of the normal equations is diagonal, so sums per level reduce the system to
the other columns, exactly and with standard errors; level effects stay a table. Several wide factors, or products with
one, become sparse rows (column numbers and values) and are solved by preconditioned conjugate gradients, where a step is
one pass that sends a task's sums per column.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from visitlens.functions import special
from visitlens.operators import design as D
from visitlens.operators.design import INTERCEPT, OFFSET, RESPONSE, WEIGHT, Factor, Numeric, Product, Term
from visitlens.operators.sizing import SMALL_TABLE_BYTES, durable, local_table
from visitlens.operators.skew import hot_tokens, join_per_key, number_rows

TERMS_SCHEMA = "term string, estimate double, std_error double, statistic double, p_value double"
MOST_STEPS = 50
MOST_INNER_STEPS = 1_000
TOLERANCE = 1e-10
NEWTON_TOLERANCE = 1e-6
LARGEST_LINK = 30.0
MOST_COLUMNS = SMALL_TABLE_BYTES // 8


def factors_of(terms: Sequence[Term]) -> dict[str, Factor]:
    parts = [p for t in terms for p in ((t.left, t.right) if isinstance(t, Product) else (t,))]
    return {p.name: p for p in parts if isinstance(p, Factor)}


def level_name(name: str, kind: str) -> Column:
    """Factor and level as the name of a column; whole numbers without decimals."""
    level = F.col(f"`{name}`")
    text = level.cast("string")
    if kind in ("double", "float"):
        text = F.when(level == F.floor(level), level.cast("decimal(38,0)").cast("string")).otherwise(text)
    elif kind.startswith("decimal"):
        text = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.concat(F.lit(name), text)


def level_table(cells: DataFrame, factor: Factor) -> DataFrame:
    """(level, `_rank`, `_name`): all levels in order from 0, the reference first."""
    name, kind = factor.name, dict(cells.dtypes)[factor.name]
    levels = cells.select(f"`{name}`").distinct().withColumn("_name", level_name(name, kind))
    first = [] if factor.reference is None else [F.desc(F.col("_name") == f"{name}{D.level_text(factor.reference)}")]
    return durable(number_rows(levels, [], [*first, f"`{name}`"], "_rank").withColumn("_rank", F.col("_rank") - 1))


# sparse rows

@dataclass
class SparseDesign:
    """`rows`: response, weight, offset, `_index` and `_value` of the columns that are not 0; `columns`: index, name."""

    rows: DataFrame
    columns: DataFrame
    size: int


def sparse_design(cells: DataFrame, terms: Sequence[Term], keep: Sequence[str] = ()) -> SparseDesign:
    """Treatment contrasts of any number of levels over the rows of `cells`; the intercept is column 0."""
    spark = cells.sparkSession
    ranks = {name: level_table(cells, factor) for name, factor in factors_of(terms).items()}
    sizes = {name: table.count() for name, table in ranks.items()}
    rows = cells
    for name, table in ranks.items():
        rows = join_per_key(rows, table.select(f"`{name}`", F.col("_rank").alias(f"_rank_{name}")), [name], "left")

    def part(term: Numeric | Factor) -> tuple[int, Column, Column, DataFrame]:
        """Columns of a term, the place of the row's own one (-1: none), its value, and the names of all."""
        if isinstance(term, Numeric):
            return 1, F.lit(0).cast("long"), F.col(f"`{term.name}`"), local_table(spark, [(0, term.name)], "place long, name string")
        skip = 0 if term.full else 1
        names = ranks[term.name].filter(F.col("_rank") >= skip).select((F.col("_rank") - skip).alias("place"), F.col("_name").alias("name"))
        return sizes[term.name] - skip, F.col(f"`_rank_{term.name}`") - skip, F.lit(1.0), names

    start, places, values = 1, [F.lit(0).cast("long")], [F.lit(1.0)]
    names = local_table(spark, [(0, INTERCEPT)], "index long, name string")
    for term in terms:
        if isinstance(term, Product):
            (n, a, x, left), (m, b, y, right) = part(term.left), part(term.right)
            size, place, value = n * m, F.when((a >= 0) & (b >= 0), a * m + b).otherwise(-1), x * y
            other = right.select(F.col("place").alias("other"), F.col("name").alias("other_name"))
            # One side of a product in a model is short; its columns are the product's own, so this is no larger than the result.
            own = left.join(F.broadcast(other) if m <= n else other).select(
                (F.col("place") * m + F.col("other")).alias("place"), F.concat_ws(":", "name", "other_name").alias("name"))
        else:
            size, place, value, own = part(term)
        places.append(F.when(place >= 0, place + start))
        values.append(value)
        names = names.unionByName(own.select((F.col("place") + start).alias("index"), "name"))
        start += size
    cell = F.array(*[F.struct(p.alias("i"), v.cast("double").alias("v")) for p, v in zip(places, values)])
    filled = F.filter(cell, lambda c: c["i"].isNotNull() & (c["v"] != 0))
    rows = rows.select(RESPONSE, WEIGHT, OFFSET, *keep, filled.alias("_cell")).select(
        RESPONSE, WEIGHT, OFFSET, *keep, F.col("_cell")["i"].alias("_index"), F.col("_cell")["v"].alias("_value"))
    return SparseDesign(rows, names, start)


def _sparse_sums(rows: DataFrame, size: int, weigh) -> np.ndarray:
    """Sum over the rows of `weigh(y, w, offset, dot) -> amount per row` times the row's columns, one sum per column.

    `dot(v)` is the row's product with a vector. A task sends a row per column it has met; `size` numbers reach the driver.
    """
    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            y, w, offset = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            lists = batch.column(3)
            row = np.repeat(np.arange(len(y)), np.diff(lists.offsets.to_numpy()))
            index, value = lists.flatten().to_numpy(), batch.column(4).flatten().to_numpy()

            def dot(v: np.ndarray) -> np.ndarray:
                return np.bincount(row, value * v[index], len(y))

            amount, power = weigh(y, w, offset, dot)
            total += np.bincount(index, amount[row] * value**power, size)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"index": met.astype(np.int64), "sum": total[met]})

    parts = rows.select(RESPONSE, WEIGHT, OFFSET, "_index", "_value").mapInArrow(passed, "index long, sum double")
    found = parts.groupBy("index").agg(F.sum("sum").alias("sum")).toPandas()
    out = np.zeros(size)
    out[found["index"].to_numpy()] = found["sum"].to_numpy()
    return out


def _moments(family: str, link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance function at the link."""
    if family == "gaussian":
        return link, np.ones_like(link)
    if family == "poisson":
        mean = np.exp(np.minimum(link, 2 * LARGEST_LINK))
        return mean, mean
    mean = 1 / (1 + np.exp(-np.clip(link, -LARGEST_LINK, LARGEST_LINK)))
    return mean, mean * (1 - mean)


def conjugate_gradients(design: SparseDesign, family: str) -> tuple[np.ndarray, int, bool]:
    """Estimates by Newton steps (one for a linear fit), each solved by conjugate gradients; steps and success."""
    rows, size = design.rows, design.size
    if size > MOST_COLUMNS:
        raise ValueError(f"{size} columns: more than {MOST_COLUMNS} are fitted only where one factor holds nearly all of them")
    beta = np.zeros(size)
    if family != "gaussian":
        total, of_y = rows.agg(F.sum(WEIGHT), F.sum(F.col(WEIGHT) * F.col(RESPONSE))).first()
        mean = of_y / total
        beta[0] = math.log(mean / (1 - mean)) if family == "binomial" else math.log(mean)
    passes = 0
    for step in range(1, MOST_STEPS + 1):
        at = beta

        def score(y, w, offset, dot):
            return w * (y - _moments(family, dot(at) + offset)[0]), 1

        def curvature(y, w, offset, dot):
            return w * _moments(family, dot(at) + offset)[1], 2

        gradient, diagonal = _sparse_sums(rows, size, score), _sparse_sums(rows, size, curvature)
        scale = 1 / np.where(diagonal > 0, diagonal, np.inf)
        move, residual = np.zeros(size), gradient.copy()
        solved = scale * residual
        direction, level = solved.copy(), float(residual @ solved)
        # Newton steps need not be exact, the next one mends them; a linear fit has only one.
        goal, passes = (TOLERANCE if family == "gaussian" else NEWTON_TOLERANCE)**2 * max(level, 1e-300), passes + 2
        for _ in range(MOST_INNER_STEPS):
            if level <= goal:
                break
            ahead = direction

            def bend(y, w, offset, dot):
                return w * _moments(family, dot(at) + offset)[1] * dot(ahead), 1

            image = _sparse_sums(rows, size, bend)
            length, passes = level / float(direction @ image), passes + 1
            move += length * direction
            residual -= length * image
            solved = scale * residual
            level, before = float(residual @ solved), level
            direction = solved + level / before * direction
        beta = beta + move
        if family == "gaussian" or np.max(np.abs(move)) <= 1e-9 * max(1.0, np.max(np.abs(beta))):
            return beta, passes, level <= goal
    return beta, passes, False


# fits

@dataclass
class WideFit:
    """A fit with its level effects as tables; `effects` has the wide factor's effect per level, null where there is none."""

    family: str
    n: float
    df_residual: float
    measures: dict[str, float | None]
    table: DataFrame
    rows: DataFrame
    wide: str | None = None
    effects: DataFrame | None = None
    slopes: Column | None = None
    levels: dict[str, list] | None = None

    def terms(self, spark: SparkSession | None = None) -> DataFrame:
        """(term, estimate, std_error, statistic, p_value); errors are null after conjugate gradients."""
        return self.table

    def summary(self, spark: SparkSession) -> DataFrame:
        """One row: size, residual degrees of freedom and the measures of the family."""
        values = {"n": float(self.n), "df_residual": float(self.df_residual), **self.measures}
        return local_table(spark, [tuple(values.values())], ", ".join(f"{k} double" for k in values))

    def _fitted(self, df: DataFrame) -> DataFrame:
        if self.effects is None:
            raise ValueError("fits by conjugate gradients are scored through their terms")
        joined = join_per_key(df, self.effects.select(f"`{self.wide}`", "_effect"), [self.wide], "left")
        linked = joined.withColumn("link", F.col("_effect") + self.slopes + F.col(OFFSET)).drop("_effect")
        mean = {"gaussian": F.col("link"), "poisson": F.exp("link"), "binomial": 1 / (1 + F.exp(-F.col("link")))}[self.family]
        return linked.withColumn("fitted", mean)

    def predictions(self) -> DataFrame:
        """Cells with link, fitted value and response residual; `_w` is the number of rows in the cell."""
        return self._fitted(self.rows).withColumn("residual", F.col(RESPONSE) - F.col("fitted"))

    def score(self, df: DataFrame, response_scale: bool = True, out: str = "fitted") -> DataFrame:
        """Predictions for rows with the model's columns and the offset column; null for null and unseen levels."""
        known = F.lit(True)
        for name, levels in (self.levels or {}).items():
            known = known & F.coalesce(F.col(f"`{name}`").isin(levels), F.lit(False))
        columns = [c for c in df.columns if c not in ("link", "fitted", out)]
        return self._fitted(df.select(*columns)).select(
            *columns, F.when(known, F.col("fitted" if response_scale else "link")).alias(out))


def _tested(table: DataFrame, family: str, df_residual: float) -> DataFrame:
    table = table.withColumn("statistic", F.col("estimate") / F.col("std_error"))
    if family == "gaussian":
        p = special.t_two_sided_udf("statistic", F.lit(float(df_residual)))
    else:
        p = 2 * special.normal_upper_udf(F.abs("statistic"))
    return table.select("term", "estimate", "std_error", "statistic", F.when(F.col("statistic").isNotNull(), p).alias("p_value"))


def _weigher(family: str):
    """Working weight and working response as columns of (weight, response, link without offset, link)."""
    def columns(w: Column, y: Column, free: Column, link: Column) -> tuple[Column, Column]:
        if family == "gaussian":
            return w, y - F.col(OFFSET)
        if family == "poisson":
            mu = F.exp(F.least(link, F.lit(2 * LARGEST_LINK)))
            return w * mu, free + (y - mu) / mu
        mu = 1 / (1 + F.exp(-F.greatest(F.least(link, F.lit(LARGEST_LINK)), F.lit(-LARGEST_LINK))))
        return w * mu * (1 - mu), free + (y - mu) / (mu * (1 - mu))

    return columns


def _deviance(family: str, y: Column, link: Column) -> Column:
    """Unit deviance, up to a constant of the data for counts and shares."""
    if family == "poisson":
        return 2 * (F.exp(link) - y * link)
    return 2 * (F.greatest(link, F.lit(0.0)) + F.log1p(F.exp(-F.abs(link))) - y * link)


def eliminated_fit(cells: DataFrame, terms: Sequence[Term], wide: Factor, family: str) -> WideFit:
    """The fit with the columns of `wide` eliminated; `terms` are the others, narrow enough for a dense matrix.

    Working weights w and response z give per level the sums W, u = Σ w x and r = Σ w z. With T the cross products of (x, z) over all
    cells, T - Σ (u, r)(u, r)' / W is the system of the other columns. Columns are centred first, so that little cancels.
    """
    spark, key = cells.sparkSession, f"`{wide.name}`"
    others = D.design_of(cells, terms)
    columns = [c for name, c in others.columns.items() if name != INTERCEPT]
    names = [name for name in others.columns if name != INTERCEPT]
    p, w, y = len(columns), F.col(WEIGHT), F.col(RESPONSE)
    hot = hot_tokens(cells, [wide.name])
    first = cells.agg(F.sum(w).alias("n"), F.sum(w * y).alias("y"), F.sum(w * (y - F.col(OFFSET))).alias("z"), *[F.sum(w * c) for c in columns]).first()
    n, centre = first[0], [x / first[0] for x in first[3:]]
    shift = first["z"] / n if family == "gaussian" else 0.0
    centred = [c - F.lit(m) for c, m in zip(columns, centre)]
    weigh = _weigher(family)

    beta = np.zeros(p)
    mean = first["y"] / n
    start = {"gaussian": 0.0, "poisson": math.log(mean) if mean > 0 else 0.0, "binomial": math.log(mean / (1 - mean)) if 0 < mean < 1 else 0.0}[family]
    effects, deviance, converged = None, math.inf, family == "gaussian"
    for step in range(1, MOST_STEPS + 1):
        if effects is None:
            rows, level = cells, F.lit(start) + F.lit(0.0)
        else:
            rows, level = join_per_key(cells, effects.select(key, "_effect"), [wide.name], "left", hot=hot), F.col("_effect")
        free = level + (D.dot(centred, beta) if p else F.lit(0.0))
        weight, target = weigh(w, y, free, free + F.col(OFFSET))
        rows = rows.select(key, weight.alias("_v"), (target - F.lit(shift)).alias("_z"), *[c.alias(f"_x{i}") for i, c in enumerate(centred)])
        xs = [F.col(f"_x{i}") for i in range(p)]
        sums = durable(rows.groupBy(key).agg(
            F.sum("_v").alias("_W"), F.sum(F.col("_v") * F.col("_z")).alias("_r"), F.array(*[F.sum(F.col("_v") * x) for x in xs]).cast("array<double>").alias("_u")))
        whole = D.cross_products(rows, [*xs, F.col("_z")], F.col("_v"))
        between = D.cross_products(sums, [*[F.col("_u")[i] for i in range(p)], F.col("_r")], 1 / F.col("_W"))
        reduced = whole - between
        kept = D.independent_columns(reduced[:p, :p], scale=np.diag(whole)[:p])
        inverse = D.inverse(reduced[np.ix_(kept, kept)]) if kept else np.zeros((0, 0))
        beta = np.zeros(p)
        beta[kept] = inverse @ reduced[kept, p]
        fitted = F.aggregate(F.zip_with("_u", F.lit([float(b) for b in beta]), lambda u, b: u * b), F.lit(0.0), lambda a, b: a + b) if p else F.lit(0.0)
        effects = sums.withColumn("_effect", (F.col("_r") - fitted) / F.col("_W") + F.lit(shift))
        if family == "gaussian":
            break
        effects = durable(effects)
        linked = join_per_key(cells, effects.select(key, "_effect"), [wide.name], "left", hot=hot)
        link = F.col("_effect") + (D.dot(centred, beta) if p else F.lit(0.0)) + F.col(OFFSET)
        found = linked.agg(F.sum(w * _deviance(family, y, link))).first()[0]
        converged = abs(found - deviance) <= 1e-10 * (abs(found) + 0.1)
        deviance = found
        if converged:
            break
    effects = durable(effects)
    levels = effects.count()
    df_residual = n - levels - len(kept)
    measures: dict[str, float | None] = {}
    sigma2 = 1.0
    if family == "gaussian":
        rss = max(reduced[p, p] - beta[kept] @ reduced[kept, p], 0.0)
        sigma2 = rss / df_residual if df_residual > 0 else math.nan
        total, rank = whole[p, p], levels + len(kept) - 1
        r2 = 1 - rss / total if total > 0 else math.nan
        f = (total - rss) / rank / sigma2 if rank and sigma2 > 0 else math.nan
        loglik = -0.5 * n * (math.log(2 * math.pi * rss / n) + 1) if rss > 0 else math.nan
        measures = {
            "sigma": math.sqrt(sigma2) if sigma2 == sigma2 else None, "r_squared": r2,
            "adj_r_squared": 1 - (1 - r2) * (n - 1) / df_residual if df_residual > 0 else None, "f_statistic": f, "df_model": float(rank),
            "f_p_value": float(special.f_upper(np.array([f]), rank, df_residual)[0]) if f == f else None,
            "rss": rss, "log_likelihood": loglik, "aic": 2 * (levels + len(kept) + 1) - 2 * loglik}
    table = _effect_terms(spark, effects, wide, names, beta, kept, inverse, np.array(centre), sigma2)
    slopes = (D.dot(columns, beta) if p else F.lit(0.0)) - F.lit(float(beta @ np.array(centre)) if p else 0.0)
    fit = WideFit(family, n, df_residual, measures, durable(_tested(table, family, df_residual)), cells, wide.name, effects, slopes, others.levels)
    if family != "gaussian":
        link = F.col("link")
        likelihood = -_deviance(family, y, link) / 2
        if family == "poisson":
            likelihood = likelihood - special.log_gamma_udf(y + 1.0)
        loglik = fit._fitted(cells).agg(F.sum(w * likelihood)).first()[0]
        if family == "poisson":  # against the saturated model
            full = cells.agg(F.sum(w * F.when(y > 0, y * F.ln(y) - y).otherwise(0.0))).first()[0]
            deviance = 2 * full + deviance
        fit.measures = {"log_likelihood": loglik, "aic": 2 * (levels + len(kept)) - 2 * loglik, "mean": mean,
                        "iterations": float(step), "converged": float(converged), "deviance": deviance}
    return fit


def _effect_terms(spark, effects, wide, names, beta, kept, inverse, centre, sigma2) -> DataFrame:
    """Intercept, other columns and contrasts of the levels with the reference, with their standard errors."""
    p = len(names)
    table = level_table(effects.select(f"`{wide.name}`"), wide)
    joined = effects.select(f"`{wide.name}`", "_W", "_u", "_effect").join(table, wide.name)
    base = joined.filter("_rank = 0").first()
    if base is None:
        return local_table(spark, [], "term string, estimate double, std_error double")
    base_mean = np.array(base["_u"], float) / base["_W"]
    full = np.zeros((p, p))
    full[np.ix_(kept, kept)] = inverse
    at_zero = base_mean + centre if p else base_mean  # the intercept stands where all columns are 0
    intercept = base["_effect"] - (float(beta @ centre) if p else 0.0)
    rows = [(INTERCEPT, intercept, math.sqrt(max(sigma2 * (1 / base["_W"] + at_zero @ full @ at_zero), 0.0)))]
    own = set(kept)
    rows += [(name, float(beta[i]), math.sqrt(max(sigma2 * full[i, i], 0.0))) if i in own else (name, None, None) for i, name in enumerate(names)]

    def contrasts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight, effect = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            apart = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(len(weight), p) / weight[:, None] - base_mean
            spread = 1 / weight + 1 / base["_W"] + ((apart @ full) * apart).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(effect - base["_effect"]), pa.array(np.sqrt(np.maximum(sigma2 * spread, 0.0)))],
                names=["term", "estimate", "std_error"])

    others = joined.filter("_rank > 0").select("_name", "_W", "_effect", "_u").mapInArrow(contrasts, "term string, estimate double, std_error double")
    return local_table(spark, rows, "term string, estimate double, std_error double").unionByName(others)


def iterated_fit(cells: DataFrame, terms: Sequence[Term], family: str) -> WideFit:
    """The fit on sparse rows by conjugate gradients; no standard errors, as these need the inverse."""
    design = sparse_design(cells, terms)
    design.rows = durable(design.rows)
    beta, passes, converged = conjugate_gradients(design, family)
    spark = cells.sparkSession
    known = spark.createDataFrame(pa.table({"index": np.arange(design.size), "estimate": beta}))
    table = design.columns.join(known, "index").select(
        F.col("name").alias("term"), "estimate", *[F.lit(None).cast("double").alias(c) for c in ("std_error", "statistic", "p_value")])
    w, y = F.col(WEIGHT), F.col(RESPONSE)
    n, of_y = cells.agg(F.sum(w), F.sum(w * y)).first()
    return WideFit(family, n, n - design.size, {"mean": of_y / n, "passes": float(passes), "converged": float(converged)}, durable(table), cells)


def fit_wide(cells: DataFrame, terms: Sequence[Term], family: str, levels: dict[str, list | None]) -> WideFit:
    """Eliminates the one wide factor where it stands alone in its term, else iterates on sparse rows.

    `levels` has None for the wide factors. `cells` must be durable or cheap, as every step reads them.
    """
    wide = {name for name, known in levels.items() if known is None}
    inside = {p.name for t in terms if isinstance(t, Product) for p in (t.left, t.right)}
    if len(wide) == 1 and not wide & inside:
        name, = wide
        factor = next(t for t in terms if t.name == name)
        return eliminated_fit(cells, [t for t in terms if t.name != name], factor, family)
    return iterated_fit(cells, terms, family)
