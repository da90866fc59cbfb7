"""Penalised models: spline smooths with GCV, and a logit with informed priors and random intercepts.

Both reduce the rows to cells once; each step is one or two passes over them, the rest is p × p arithmetic.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DecimalType, FractionalType

from visitlens.operators.design import (
    RESPONSE, WEIGHT, Factor, Numeric, Term, build_design, cross_products, dot, working_products,
)
from visitlens.operators.fits import _trials
from visitlens.operators.sizing import durable, local_table, small_table
from visitlens.operators.skew import hot_tokens, join_per_key


@dataclass(frozen=True)
class Smooth:
    """A smooth of a numeric column or expression with at most `size` cubic basis functions."""

    name: str
    expression: str | None = None
    size: int = 10


def basis_columns(x: Column, low: float, high: float, size: int) -> list[Column]:
    """Equally spaced cubic B-splines in closed form, as plain column expressions."""
    step = (high - low) / (size - 3)
    columns = []
    for j in range(size):
        u = F.abs((x - F.lit(low + (j - 1) * step)) / F.lit(step))
        inner = (4 - 6 * u * u + 3 * u * u * u) / 6
        columns.append(F.when(u < 1, inner).when(u < 2, F.pow(2 - u, F.lit(3)) / 6).otherwise(0.0))
    return columns


def fit_gam(df: DataFrame, smooths: Sequence[Smooth], terms: Sequence[Term], response: str):
    """Additive Gaussian model; the penalty of each smooth minimises generalised cross-validation.

    Returns (summary of smooths, parametric terms, cells with fitted values).
    """
    spark = df.sparkSession
    raw = [Numeric(s.name, s.expression) for s in smooths]
    design = build_design(df, [*raw, *terms], response)
    fixed = [n for n in design.names if design.term_of[n] not in {s.name for s in smooths}]
    columns = [design.columns[n] for n in fixed]
    ranges = design.cells.agg(*[f(F.col(f"`{s.name}`")) for s in smooths for f in (F.min, F.max)]).first()
    blocks = []
    for i, s in enumerate(smooths):
        distinct = design.cells.select(f"`{s.name}`").distinct().limit(s.size).count()
        size = max(4, min(s.size, distinct))
        basis = basis_columns(F.col(f"`{s.name}`"), ranges[2 * i], ranges[2 * i + 1], size)
        blocks.append(range(len(columns), len(columns) + size))
        columns += basis
    y = F.col(RESPONSE)
    whole = cross_products(design.cells, [*columns, y], F.col(WEIGHT))
    gram, moment, yy, n = whole[:-1, :-1], whole[:-1, -1], whole[-1, -1], whole[0, 0]
    # Each smooth sums to zero over the rows, so the intercept stays identified.
    change = np.eye(len(columns))[:, : len(fixed)]
    penalties, spans, at = [], [], len(fixed)
    for block in blocks:
        mean = gram[0, list(block)][:, None]
        null = np.linalg.qr(mean, mode="complete")[0][:, 1:]
        wide = np.zeros((len(columns), null.shape[1]))
        wide[list(block)] = null
        change = np.hstack([change, wide])
        second = np.diff(np.eye(len(block)), 2, axis=0)
        penalties.append(null.T @ second.T @ second @ null)
        spans.append(range(at, at + null.shape[1]))
        at += null.shape[1]
    gram, moment = change.T @ gram @ change, change.T @ moment
    scale = np.trace(gram) / len(gram)

    def solve(lambdas):
        penalty = np.zeros_like(gram)
        for span, matrix, strength in zip(spans, penalties, lambdas):
            penalty[np.ix_(span, span)] += strength * scale * matrix
        inverse = np.linalg.pinv(gram + penalty, hermitian=True)
        beta = inverse @ moment
        influence = inverse @ gram
        rss = max(yy - 2 * beta @ moment + beta @ gram @ beta, 0.0)
        edf = float(np.trace(influence))
        return n * rss / (n - edf) ** 2, beta, influence, inverse, rss, edf

    grid = 10.0 ** np.arange(-6.0, 5.0, 0.5)
    lambdas = [1.0] * len(smooths)
    for _ in range(4):
        for i in range(len(smooths)):
            lambdas[i] = min(grid, key=lambda v: solve([*lambdas[:i], v, *lambdas[i + 1:]])[0])
    gcv, beta, influence, inverse, rss, edf = solve(lambdas)
    sigma2 = rss / (n - edf)
    errors = np.sqrt(np.maximum(np.diag(inverse @ gram @ inverse) * sigma2, 0.0))
    parametric = local_table(
        spark, [(name, float(b), float(e)) for name, b, e in zip(fixed, beta, errors)],
        "term string, estimate double, std_error double",
    )
    total = yy - whole[0, -1] ** 2 / n
    summary = local_table(
        spark,
        [(s.name, float(np.trace(influence[np.ix_(span, span)])), float(v), float(gcv), float(1 - rss / total), float(n))
         for s, span, v in zip(smooths, spans, lambdas)],
        "smooth string, edf double, penalty double, gcv double, r_squared double, n double",
    )
    fitted = design.cells.withColumn("fitted", dot(columns, change @ beta)).withColumn("residual", y - F.col("fitted"))
    return summary, parametric, fitted


@dataclass(frozen=True)
class Prior:
    """Prior of one coefficient: normal (no df) or Student t."""

    mean: float
    scale: float
    df: float | None = None


def priors_from_table(table: DataFrame, names: Sequence[str]) -> dict[str, Prior]:
    """Priors of the coefficients `names` from a (term, family, mean, scale, df) table with one row per coefficient."""
    wanted = local_table(table.sparkSession, [(name,) for name in names], "term string")
    rows = table.join(wanted, "term", "left_semi").collect()
    return {r["term"]: Prior(r["mean"], r["scale"], r["df"] if r["family"] == "t" else None) for r in rows}


def fit_random_intercept_logit(
    df: DataFrame,
    terms: Sequence[Term],
    group: str,
    response: str,
    priors: Mapping[str, Prior] | DataFrame | None = None,
    precision_prior: tuple[float, float] = (0.01, 0.01),
    max_steps: int = 60,
    tol: float = 1e-8,
):
    """Posterior mode with a Laplace approximation: (parameter, estimate, sd, lower, upper).

    Student t priors act as normal ones whose precision is updated at each step. The precision of the
    random intercepts maximises its marginal posterior by fixed-point steps (well-determined intercepts
    over their sum of squares). Intercepts are eliminated group by group: each step sums the cells per group
    and only the fixed effects' matrix reaches the driver, so there may be any number of groups. Rows with a
    null group are left out.
    """
    design = build_design(df.dropna(subset=[group]), terms, response, keep=[group])
    cells = _trials(design.cells)
    names, columns = design.names, list(design.columns.values())
    size = len(names)
    priors = priors_from_table(priors, names) if isinstance(priors, DataFrame) else dict(priors or {})
    settings = [priors.get(name, Prior(0.0, 10.0)) for name in names]
    centre = np.array([p.mean for p in settings])
    beta, tau = np.zeros(size), 1.0
    share = cells.agg(F.sum(F.col(WEIGHT) * F.col(RESPONSE)) / F.sum(WEIGHT)).first()[0]
    beta[0] = math.log(share / (1 - share))
    hot = hot_tokens(cells, [group])
    effects = durable(cells.select(group).distinct().withColumn("_u", F.lit(0.0)))
    mean = lambda eta: 1 / (1 + F.exp(-eta))
    curve = lambda eta: mean(eta) * (1 - mean(eta))
    shared = F.array(*[F.col(f"_s{j}") for j in range(size)])
    for step in range(1, max_steps + 1):
        joined = join_per_key(cells, small_table(effects), [group], "inner", hot)
        link = dot(columns, beta) + F.col("_u")
        system = working_products(
            joined, columns, link,
            weight_of=lambda eta: F.col(WEIGHT) * curve(eta),
            target_of=lambda eta: (F.col(RESPONSE) - mean(eta)) / curve(eta),
        )
        precision = np.array([
            (p.df + 1) / (p.df * p.scale**2 + (b - p.mean) ** 2) if p.df else 1 / p.scale**2
            for p, b in zip(settings, beta)
        ])
        weighed = joined.withColumn("_eta", link).withColumn("_c", F.col(WEIGHT) * curve(F.col("_eta")))
        sums = durable(weighed.groupBy(group).agg(
            F.max("_u").alias("_u"),
            (F.sum("_c") + tau).alias("_d"),
            (F.sum(F.col(WEIGHT) * (F.col(RESPONSE) - mean(F.col("_eta")))) - tau * F.max("_u")).alias("_g"),
            *[F.sum(F.col("_c") * c).alias(f"_s{j}") for j, c in enumerate(columns)],
        ))
        each = [F.col(f"_s{j}") for j in range(size)]
        root = F.sqrt("_d")
        folded = cross_products(
            sums, [*[s / root for s in each], F.col("_g") / root, *[s / F.col("_d") for s in each], 1 / root], F.lit(1.0))
        hessian = system[:-1, :-1] + np.diag(precision) - folded[:size, :size]
        gradient = system[:-1, -1] - precision * (beta - centre) - folded[:size, size]
        covariance = np.linalg.inv(hessian)
        moved = covariance @ gradient
        spread = folded[size + 1:-1, size + 1:-1]
        shift = (F.col("_g") - dot(each, moved)) / F.col("_d")
        most, squares, mixed, steps, groups = sums.select("_u", shift.alias("_m")).agg(
            F.max(F.abs("_m")), F.sum(F.col("_u") * F.col("_u")), F.sum(F.col("_u") * F.col("_m")),
            F.sum(F.col("_m") * F.col("_m")), F.count(F.lit(1)),
        ).first()
        largest = max(float(np.max(np.abs(moved))), most)
        damping = min(1.0, 4.0 / max(largest, 1e-12))
        beta = beta + moved * damping
        effects = sums.select(group, (F.col("_u") + damping * shift).alias("_u"))
        determined = groups - tau * float(folded[-1, -1] + np.sum(covariance * spread))
        total = squares + 2 * damping * mixed + damping**2 * steps
        updated = (2 * precision_prior[0] + max(determined, 0.0)) / (2 * precision_prior[1] + total)
        change = max(largest, abs(math.log(updated / tau)))
        tau = updated
        if change < tol:
            break
    else:
        warnings.warn(f"the random-intercept fit had not converged after {max_steps} steps", stacklevel=2)
    fixed = [(n, float(b), float(s)) for n, b, s in zip(names, beta, np.sqrt(np.diag(covariance)))]
    fixed.append(("precision", float(tau), None))
    # |half · s|² is s' covariance s
    half = F.array(*[F.lit(row) for row in np.linalg.cholesky(covariance).T.tolist()])
    add = lambda total, v: total + v
    product = lambda row: F.aggregate(F.zip_with(row, shared, lambda x, y: x * y), F.lit(0.0), add)
    through = F.aggregate(F.transform(half, lambda row: F.pow(product(row), F.lit(2))), F.lit(0.0), add)
    random = sums.select(
        F.concat(F.lit(group), _shown(cells, group)).alias("parameter"), (F.col("_u") + damping * shift).alias("estimate"),
        F.sqrt(1 / F.col("_d") + through / (F.col("_d") * F.col("_d"))).alias("sd"),
    )
    rows = local_table(df.sparkSession, fixed, "parameter string, estimate double, sd double").union(random)
    return rows.withColumns({"lower": F.col("estimate") - 1.96 * F.col("sd"), "upper": F.col("estimate") + 1.96 * F.col("sd")})


def _shown(df: DataFrame, column: str) -> Column:
    """Levels as `level_text` writes them: numbers without zeros at the end."""
    text = F.col(f"`{column}`").cast("string")
    kind = df.schema[column].dataType
    if isinstance(kind, (DecimalType, FractionalType)):
        return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return text
