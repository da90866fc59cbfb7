"""Model terms to numeric columns, and the cross-product pass every fit is built on.

Rows are first reduced to cells: one row per distinct combination of the used columns with its count.
The cells are made durable, so fits iterate over them and nothing re-reads the raw rows, not even after
an executor is lost.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, functions as F

from visitlens.operators.sizing import durable

MAX_LEVELS = 2_000
INTERCEPT = "(Intercept)"
WEIGHT, RESPONSE, OFFSET = "_w", "_y", "_offset"


@dataclass(frozen=True)
class Numeric:
    """A numeric predictor: a column, or an SQL expression under a name of its own."""

    name: str
    expression: str | None = None

    def raw(self) -> dict[str, Column]:
        return {self.name: F.expr(self.expression or f"`{self.name}`").cast("double")}


@dataclass(frozen=True)
class Factor:
    """A categorical predictor in treatment contrasts; the reference level defaults to the first sorted one."""

    name: str
    reference: object = None
    full: bool = False

    def raw(self) -> dict[str, Column]:
        return {self.name: F.col(f"`{self.name}`")}


@dataclass(frozen=True)
class Product:
    """Interaction of two terms; list the main effects beside it."""

    left: Numeric | Factor
    right: Numeric | Factor

    @property
    def name(self) -> str:
        return f"{self.left.name}:{self.right.name}"

    def raw(self) -> dict[str, Column]:
        return {**self.left.raw(), **self.right.raw()}


Term = Numeric | Factor | Product


@dataclass
class Design:
    """Cells with the model columns as expressions over them."""

    cells: DataFrame
    columns: dict[str, Column]
    term_of: dict[str, str]
    levels: dict[str, list] = field(default_factory=dict)
    uncounted: DataFrame | None = None

    @property
    def rows(self) -> DataFrame:
        """Cells that still tell responses apart, where `cells` holds shares of them."""
        return self.cells if self.uncounted is None else self.uncounted

    @property
    def names(self) -> list[str]:
        return list(self.columns)

    def matrix_table(self, *extra: str | Column) -> DataFrame:
        """Cells with response, weight and offset, the predictors as x0, x1, …"""
        xs = [c.alias(f"x{i}") for i, c in enumerate(self.columns.values())]
        return self.cells.select(RESPONSE, WEIGHT, OFFSET, *extra, *xs)

    def linear_predictor(self, estimates: Sequence[float]) -> Column:
        """Σ estimate × column over the cells; columns without an estimate count nothing."""
        return dot(list(self.columns.values()), estimates)


def dot(columns: Sequence[Column], values: Sequence[float]) -> Column:
    """Σ value × column. The values form one array literal, so the generated code does not change with them
    and repeated passes reuse its compiled form."""
    known = [0.0 if v != v else float(v) for v in values]
    products = F.zip_with(F.array(*columns), F.lit(known), lambda x, b: x * b)
    return F.aggregate(products, F.lit(0.0), lambda total, v: total + v)


def level_text(level) -> str:
    if isinstance(level, Decimal):
        return format(level.normalize(), "f")
    if isinstance(level, float) and level.is_integer():
        return str(int(level))
    return str(level)


def build_design(
    df: DataFrame,
    terms: Sequence[Term],
    response: str,
    offset: str | None = None,
    to_cells: bool = True,
    keep: Sequence[str] = (),
) -> Design:
    """Rows with a null in any used column are deleted; the rest become cells and model columns.

    `offset` is an SQL expression. `keep` names columns carried along unchanged (they split cells).
    """
    cells = design_cells(df, terms, response, offset, to_cells, keep)
    return design_of(cells, terms)


def design_cells(
    df: DataFrame, terms: Sequence[Term], response: str, offset: str | None = None, to_cells: bool = True, keep: Sequence[str] = (),
) -> DataFrame:
    """The used columns of complete rows with response, offset and weight; equal rows as one durable cell."""
    raw: dict[str, Column] = {}
    for term in terms:
        raw.update(term.raw())
    used = {**raw, RESPONSE: F.expr(response).cast("double"), OFFSET: F.expr(offset or "0").cast("double")}
    rows = df.select(*[c.alias(n) for n, c in used.items()], *[k for k in keep if k not in used]).dropna(subset=list(used))
    if not to_cells:
        return rows.withColumn(WEIGHT, F.lit(1.0))
    return durable(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).cast("double").alias(WEIGHT)))


def find_levels(cells: DataFrame, terms: Sequence[Term]) -> dict[str, list | None]:
    """Sorted levels per factor with the reference first; None for a factor of more than `MAX_LEVELS`."""
    factors = {f.name: f for t in terms for f in ((t.left, t.right) if isinstance(t, Product) else (t,)) if isinstance(f, Factor)}
    levels: dict[str, list | None] = {}
    for name, factor in factors.items():
        found = cells.select(f"`{name}`").distinct().limit(MAX_LEVELS + 1).collect()
        if len(found) > MAX_LEVELS:
            levels[name] = None
            continue
        values = sorted(r[0] for r in found)
        if factor.reference is not None:
            first = next(v for v in values if level_text(v) == level_text(factor.reference))
            values = [first, *(v for v in values if v != first)]
        levels[name] = values
    return levels


def design_of(cells: DataFrame, terms: Sequence[Term], levels: dict[str, list | None] | None = None) -> Design:
    """Dense model columns over cells; `levels` as `find_levels` gives them, if it was asked already."""
    levels = find_levels(cells, terms) if levels is None else levels
    for name, values in levels.items():
        if values is None:
            raise ValueError(f"{name} has more than {MAX_LEVELS} levels: linear, logistic and Poisson fits and sparse designs take them, dense models do not")

    def columns_of(term: Term) -> dict[str, Column]:
        if isinstance(term, Numeric):
            return {term.name: F.col(f"`{term.name}`")}
        if isinstance(term, Factor):
            shown = levels[term.name] if term.full else levels[term.name][1:]
            return {
                f"{term.name}{level_text(v)}": F.when(F.col(f"`{term.name}`") == F.lit(v), 1.0).otherwise(0.0)
                for v in shown
            }
        return {
            f"{a}:{b}": x * y
            for a, x in columns_of(term.left).items() for b, y in columns_of(term.right).items()
        }

    columns, term_of = {INTERCEPT: F.lit(1.0)}, {INTERCEPT: INTERCEPT}
    for term in terms:
        for name, column in columns_of(term).items():
            columns[name], term_of[name] = column, term.name
    return Design(cells, columns, term_of, levels)


def _bind(value: Column, body) -> Column:
    """`body(value)` with the value evaluated once per row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _gram(df: DataFrame, vector: Column, size: int) -> np.ndarray:
    vectors = MLUtils.convertVectorColumnsFromML(df.select(array_to_vector(vector).alias("v")), "v")
    return RowMatrix(vectors, 0, size).computeGramianMatrix().toArray()


def cross_products(df: DataFrame, columns: Sequence[Column], weight: Column) -> np.ndarray:
    """C'WC over all rows: one JVM pass with tree aggregation, a small matrix on the driver."""
    values = F.array(*[c.cast("double") for c in columns])
    return _gram(df, _bind(F.sqrt(weight), lambda root: F.transform(values, lambda v: v * root)), len(columns))


def working_products(df: DataFrame, columns: Sequence[Column], link: Column, weight_of, target_of) -> np.ndarray:
    """C'WC of the columns and a working response; weight and response are functions of the link,
    which is evaluated once per row."""

    def weighted(eta: Column) -> Column:
        parts = F.struct(F.sqrt(weight_of(eta)).alias("root"), target_of(eta).alias("target"))
        return _bind(parts, lambda p: F.transform(
            F.array(*[c.cast("double") for c in columns], p["target"]), lambda v: v * p["root"]
        ))

    return _gram(df, _bind(link, weighted), len(columns) + 1)


def independent_columns(gram: np.ndarray, tolerance: float = 1e-11, scale: np.ndarray | None = None) -> list[int]:
    """Columns that are not combinations of earlier ones, by a Cholesky sweep in the given order.

    `scale` has the squares of the columns before others were eliminated, where some were.
    """
    scale = np.sqrt(np.maximum(np.diag(gram) if scale is None else scale, 1e-300))
    work = gram / np.outer(scale, scale)
    kept: list[int] = []
    for j in range(len(work)):
        if gram[j, j] <= 0 or work[j, j] <= tolerance:
            continue
        kept.append(j)
        work = work - np.outer(work[:, j], work[j, :]) / work[j, j]
    return kept


def inverse(gram: np.ndarray) -> np.ndarray:
    """Inverse of a cross-product matrix, columns brought to one scale first."""
    scale = np.sqrt(np.diag(gram))
    return np.linalg.inv(gram / np.outer(scale, scale)) / np.outer(scale, scale)
