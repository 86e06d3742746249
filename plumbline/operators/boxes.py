"""Principal-axis boxes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import durable, lookup_join

_PAIRS = ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def principal_axes(
    xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series
) -> pd.Series:
    """Right-handed rotation (row-major) whose columns are the axes by falling variance."""
    m = np.stack([s.to_numpy(float) for s in (xx, xy, xz, xy, yy, yz, xz, yz, zz)], axis=1)
    _, vectors = np.linalg.eigh(m.reshape(-1, 3, 3))
    axes = vectors[:, :, ::-1].copy()
    axes[np.linalg.det(axes) < 0, :, 2] *= -1.0
    return pd.Series(list(axes.reshape(-1, 9)))


def moment_aggregates(xyz: Sequence[str]) -> list[Column]:
    """Mean and covariance aggregates: nine mergeable numbers, combined map-side."""
    c = [F.col(n).cast("double") for n in xyz]
    return [
        F.array(*[F.avg(v) for v in c]).alias("mean"),
        *[F.covar_pop(c[i], c[j]).alias(f"c{i}{j}") for i, j in _PAIRS],
    ]


def with_axes(stats: DataFrame) -> DataFrame:
    """Replace the covariance columns of per-key statistics by the principal axes."""
    names = [f"c{i}{j}" for i, j in _PAIRS]
    return stats.withColumn("axes", principal_axes(*names)).drop(*names)


def span_aggregates(xyz: Sequence[str]) -> list[Column]:
    """Range along the axes of rows that carry `mean` and `axes`."""
    offset = [F.col(n).cast("double") - F.col("mean")[i] for i, n in enumerate(xyz)]
    local = [
        offset[0] * F.col("axes")[j] + offset[1] * F.col("axes")[3 + j] + offset[2] * F.col("axes")[6 + j]
        for j in range(3)
    ]
    return [F.min(v).alias(f"lo{j}") for j, v in enumerate(local)] + [
        F.max(v).alias(f"hi{j}") for j, v in enumerate(local)
    ]


def fitted_extent() -> Column:
    return F.array(*[F.col(f"hi{j}") - F.col(f"lo{j}") for j in range(3)])


def oriented_boxes(
    points: DataFrame, keys: Sequence[str], xyz: Sequence[str] = ("x", "y", "z")
) -> DataFrame:
    """PCA box per key as `(keys, n, mean, obb)`.

    Two aggregations over the points: the covariance, then the range along the axes
    found from it. Below three points the box is a point with identity axes.
    """
    stats = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *moment_aggregates(xyz))
    axes = durable(with_axes(stats))
    located = lookup_join(points.select(*keys, *xyz), axes.drop("n"), list(keys))
    spans = located.groupBy(*keys).agg(*span_aggregates(xyz))
    full = axes.join(spans, list(keys))
    middle = [(F.col(f"lo{j}") + F.col(f"hi{j}")) / 2.0 for j in range(3)]
    rot = lambda i, j: F.col("axes")[3 * i + j]
    center = F.array(*[
        F.col("mean")[i] + (rot(i, 0) * middle[0] + rot(i, 1) * middle[1] + rot(i, 2) * middle[2])
        for i in range(3)
    ])
    nested = F.array(*[F.array(*[rot(i, j) for j in range(3)]) for i in range(3)])
    identity = F.array(*[F.array(*[F.lit(1.0 if i == j else 0.0) for j in range(3)]) for i in range(3)])
    enough = F.col("n") >= 3
    box = F.struct(
        F.when(enough, center).otherwise(F.col("mean")).alias("center"),
        F.when(enough, fitted_extent()).otherwise(F.array(*[F.lit(0.0)] * 3)).alias("extent"),
        F.when(enough, nested).otherwise(identity).alias("R"),
    )
    return full.select(*keys, "n", "mean", box.alias("obb"))
