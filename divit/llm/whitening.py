"""Whitening of embeddings by upper-triangle column aggregates.

Spark SQL expressions sum the centred products of every pair of dimensions i <= j in one aggregation; the d x d covariance, whose size hangs on
the dimensions alone, comes to the driver, LAPACK decomposes it there, and rows are projected by generated SQL expressions again. Nothing moves but sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import quoted

SCALE, SHIFT = 64, 1_000_000
#: Sums that one aggregation holds; more (vectors of over 127 dimensions) take further passes over the rows.
SUMS = 8192
#: Eigenvalues up to this share of the trace count as zero: no row differs along them.
FLAT = 1e-12


def _rows(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, x) of the usable vectors, where x are whole numbers; of vectors of several lengths those of the commonest (the longest of these) stay."""
    vec = f"cast({quoted(vec_col)} as array<double>)"
    usable = f"size({vec}) > 0 and not exists({vec}, c -> c is null or isnan(c) or abs(c) = double('infinity'))"
    x = f"transform({vec}, c -> cast(floor({SCALE}D * c) as long) + {SHIFT}L)"
    return df.where(f"{quoted(vec_col)} is not null and {usable}").select(F.col(quoted(id_col)).alias("id"), F.expr(x).alias("x"))


@contextmanager
def _split_code(spark: SparkSession) -> Iterator[None]:
    """Generated code in many small methods: thousands of sums are too many for the one method of a whole stage."""
    name = "spark.sql.codegen.wholeStage"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _sums(df: DataFrame, terms: list[str]) -> list[float]:
    """The sum of each term over all rows: one row of sums reaches the driver."""
    out: list[float] = []
    with _split_code(df.sparkSession):
        for at in range(0, len(terms), SUMS):
            out += df.selectExpr(*(f"sum({t}) as s{k}" for k, t in enumerate(terms[at : at + SUMS]))).collect()[0]
    return out


def triangle(df: DataFrame, columns: list[str], means: list[str], n: int) -> np.ndarray:
    """The covariance of columns (divisor n), each centred by its mean, an SQL literal, before products are summed."""
    d = len(columns)
    centred = df.selectExpr(*(f"{c} - {m} as y{i}" for i, (c, m) in enumerate(zip(columns, means))))
    sums = _sums(centred, [f"y{i} * y{j}" for i in range(d) for j in range(i, d)])
    out = np.zeros((d, d))
    out[np.triu_indices(d)] = np.array(sums, np.float64) / n
    return out + np.triu(out, 1).T


def _literal(v: float) -> str:
    return f"{float(v)!r}D"


def whiten(df: DataFrame, components: int = 32, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Whitened coordinates of each usable row along the first components, and how well they are white.

    Rows whose vector is null, empty, or holds null or non-finite entries are dropped, and rows whose vector has another length than most (the
    longer length, if two are as common). Returns id_col, component int (from 1, by falling eigenvalue), n long, deviation long (the sum over dimensions
    of (n * x - S)^2, exact; beyond a long it is an error), whitened double, explained double and identity_error double. Along components
    without variance (one row, equal rows, fewer rows than dimensions) whitened is null, and identity_error leaves them out; it is null where no
    component varies. Null ids stay null, repeated rows count each. An empty table gives no rows; other columns are not read.
    """
    rows = _rows(df, id_col, vec_col)
    most = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    schema = f"{quoted(id_col)} {df.schema[id_col].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if most is None:
        return df.sparkSession.createDataFrame([], schema)
    d, n = most["d"], most["count"]
    rows = rows.where(F.size("x") == d)
    x = [f"x[{i}]" for i in range(d)]
    total = _sums(rows, x)
    means = [_literal(s / n) for s in total]
    covariance = triangle(rows, x, means, n)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    trace = float(np.trace(covariance))
    k = min(components, d)
    varied = sum(bool(v > FLAT * trace and trace > 0) for v in values[:k])
    weights = vectors[:, :varied] / np.sqrt(values[:varied])
    error = None
    if varied:
        made = rows.selectExpr(*(" + ".join(f"({x[i]} - {means[i]}) * {_literal(weights[i, c])}" for i in range(d)) + f" as w{c}" for c in range(varied)))
        w = [f"w{c}" for c in range(varied)]
        middle = [_literal(s / n) for s in _sums(made, w)]
        error = float(np.abs(triangle(made, w, middle, n) - np.eye(varied)).max())
    deviation = "cast(" + " + ".join(f"({n}L * {c} - {s}L) * ({n}L * {c} - {s}L)" for c, s in zip(x, total)) + " as long)"
    # a row for each component, with the component's weights beside it: one short sum instead of one for each component
    each = [f"named_struct('component', {c + 1}, 'w', " + (f"array({', '.join(map(_literal, weights[:, c]))})" if c < varied else "cast(null as array<double>)") + f", 'explained', {_literal(values[c] / trace if trace > 0 else 0)})" for c in range(k)]
    told = rows.selectExpr("id", "x", f"{deviation} as deviation", f"explode(array({', '.join(each)})) as e")
    whitened = " + ".join(f"({x[i]} - {means[i]}) * e.w[{i}]" for i in range(d))
    known = f"cast({n} as long) as n", "deviation", f"{whitened} as whitened", "e.explained", f"cast({'null' if error is None else _literal(error)} as double) as identity_error"
    return told.selectExpr("id", "e.component", *known).withColumnRenamed("id", id_col)
