"""Profile-likelihood intervals of logistic and Poisson fits.

An end of an interval is where the likelihood, maximised over all other coefficients, has fallen by the level's amount. All
open ends move in one pass over the cells per step; tasks sum scores and information, small matrices reach the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from visitlens.functions import special
from visitlens.operators.design import OFFSET, RESPONSE, WEIGHT, inverse
from visitlens.operators.fits import Fit
from visitlens.operators.sizing import local_table

MOST_STEPS = 100
BLOCK_BYTES = 32 * 1024 * 1024
LOWEST = 4.0
OVERFLOW = -1e300


def profile_intervals(fit: Fit, spark: SparkSession, level: float = 0.95) -> DataFrame:
    """(parameter, odds_ratio, lower, upper, p_value) with profile-likelihood limits, on the scale of exp(estimate).

    A limit that is not found, as when the likelihood levels off because a predictor separates the responses, is null, as
    is everything of a term that depends on earlier ones.
    """
    if fit.family not in ("binomial", "poisson"):
        raise ValueError("profile intervals are for logistic and Poisson fits")
    peak = fit.estimates[fit.kept]
    (top,), _, (information,) = _likelihoods(fit, peak[None, :])
    drop = float(special.normal_quantile(np.array([0.5 + level / 2]))[0]) ** 2 / 2
    covariance = inverse(information)
    ends = [(j, side) for j in range(len(peak)) for side in (-1, 1)]
    size = max(1, BLOCK_BYTES // (8 * (len(peak) + 1) ** 2))
    found: dict[tuple[int, int], float] = {}
    for at in range(0, len(ends), size):
        found |= _profile_ends(fit, peak, covariance, top - drop, drop, ends[at:at + size])
    rows = []
    place = {j: i for i, j in enumerate(fit.kept)}
    for j, (name, estimate, _, _, p) in enumerate(fit.term_rows()):
        low, high = (_exp(found.get((place.get(j), side))) for side in (-1, 1))
        rows.append((name, _exp(estimate), low, high, p))
    return local_table(spark, rows, "parameter string, odds_ratio double, lower double, upper double, p_value double")


def _exp(value: float | None) -> float | None:
    return None if value is None else math.exp(value)


def _profile_ends(fit: Fit, peak, covariance, target: float, drop: float, ends) -> dict[tuple[int, int], float]:
    """Newton steps for: the likelihood is `target`, and its slope along every other coefficient is nought.

    A step that ends far below the target is halved.
    """
    errors = np.sqrt(np.diag(covariance))
    points = {key: peak for key in ends}
    moves = {(j, side): side * math.sqrt(2 * drop) * covariance[j] / errors[j] for j, side in ends}
    found: dict[tuple[int, int], float] = {}
    for _ in range(MOST_STEPS):
        if not moves:
            break
        keys = list(moves)
        for key, value, slope, information in zip(keys, *_likelihoods(fit, np.array([points[k] + moves[k] for k in keys]))):
            j, side = key
            if value < target - LOWEST * drop:
                moves[key] = moves[key] / 2
                continue
            points[key] = points[key] + moves[key]
            move = _next_move(value - target, slope, information, j, side)
            if move is None:
                del moves[key]
            elif np.max(np.abs(move) / errors) < 1e-7:
                found[key] = float(points[key][j] + move[j])
                del moves[key]
            else:
                moves[key] = move
    return found


def _next_move(above: float, slope: np.ndarray, information: np.ndarray, j: int, side: int) -> np.ndarray | None:
    """To where the quadratic around the point, at its highest over the other coefficients, meets the target."""
    if np.any(np.diag(information) <= np.finfo(float).tiny):
        return None
    try:
        spread = inverse(information)
    except np.linalg.LinAlgError:
        return None
    move = spread @ slope
    room = 2 * (above + slope @ move / 2) / spread[j, j]
    move = move + side * math.sqrt(max(room, 0.0)) * spread[j]
    return move if np.all(np.isfinite(move)) else None


def _likelihoods(fit: Fit, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-likelihood without its constant, score and information at each of the points, from one pass over the cells."""
    columns = list(fit.design.columns.values())
    table = fit.design.cells.select(
        RESPONSE, WEIGHT, OFFSET, F.array(*[columns[i].cast("double") for i in fit.kept]).alias("x"))
    p, binomial = points.shape[1], fit.family == "binomial"

    def sums(batches):
        totals = np.zeros((len(points), 1 + p + p * p))
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch["x"].to_numpy())
            y, w, shift = (batch[c].to_numpy() for c in (RESPONSE, WEIGHT, OFFSET))
            for total, point in zip(totals, points):
                eta = x @ point + shift
                with np.errstate(over="ignore", invalid="ignore"):
                    small = np.exp(-np.abs(eta))  # the weight stays above nought where the probability rounds to 0 or 1
                    mu = np.where(eta > 0, 1.0, small) / (1 + small) if binomial else np.exp(eta)
                    total[0] += w @ (y * eta - (np.logaddexp(0.0, eta) if binomial else mu))
                    total[1:1 + p] += x.T @ (w * (y - mu))
                    total[1 + p:] += ((x * (w * (small / (1 + small) ** 2 if binomial else mu))[:, None]).T @ x).ravel()
        beyond = ~np.isfinite(totals).all(axis=1)
        totals[beyond] = 0.0
        totals[beyond, 0] = OVERFLOW
        yield pd.DataFrame({"point": np.arange(len(points)), "sums": list(totals)})

    parts = table.mapInPandas(sums, "point int, sums array<double>")
    whole: Column = vector_to_array(Summarizer.sum(array_to_vector("sums")))
    rows = parts.groupBy("point").agg(whole.alias("sums")).orderBy("point").collect()
    values = np.array([r["sums"] for r in rows])
    return values[:, 0], values[:, 1:1 + p], values[:, 1 + p:].reshape(-1, p, p)
