"""Per-dimension statistics and the masked expectation of every value."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from maskmix.functions.arrays import double, double_array
from maskmix.functions.kernels import Expectation, list_column
from maskmix.functions.runtime import map_arrow


@dataclass(frozen=True)
class DimensionModel:
    """One entry per dimension: value range, noise mean, noise variance and masked count."""

    low: list[float]
    high: list[float]
    noise_mean: list[float]
    noise_variance: list[float]
    n_masked: list[int]
    n_points: int
    scaled: bool = False

    @property
    def dims(self) -> int:
        return len(self.low)

    def normalised(self) -> "DimensionModel":
        """The same noise model after each dimension is mapped to [0, 1]."""
        span = [h - l for l, h in zip(self.low, self.high)]
        mean, variance = [], []
        for l, s, m, v, n in zip(self.low, span, self.noise_mean, self.noise_variance, self.n_masked):
            known = n > 0 and s > 0
            mean.append((m - l) / s if known else 0.0)
            variance.append(v / s**2 if known else 0.0)
        return DimensionModel(self.low, self.high, mean, variance, self.n_masked, self.n_points, True)

    def kernel(self) -> Expectation:
        """The same for use inside tasks; with ``scaled`` raw values are min-max scaled first."""
        if not self.scaled:
            return Expectation(self.noise_mean, self.noise_variance)
        return Expectation(self.noise_mean, self.noise_variance, self.low, inverse_span(self))


def explode_dims(points: DataFrame, *arrays: str) -> DataFrame:
    """Long form: one row per point and dimension."""
    keep = [c for c in points.columns if c not in arrays]
    zipped = F.arrays_zip(*[F.col(a) for a in arrays])
    return points.select(*keep, F.posexplode(zipped).alias("dim", "cell")).select(
        *keep, "dim", *[F.col(f"cell.{a}").alias(a) for a in arrays]
    )


def dimension_table(points: DataFrame) -> DataFrame:
    """Range and noise statistics per dimension in one pass; partial sums keep the shuffle tiny.

    The noise of a dimension is made of the values whose soft mask is not exactly one.
    """
    noise = F.when(F.col("w") != 1, F.col("x"))
    return (
        explode_dims(points.select("x", "w"), "x", "w")
        .groupBy("dim")
        .agg(
            F.min("x").alias("low"),
            F.max("x").alias("high"),
            F.coalesce(F.avg(noise), double(0)).alias("noise_mean"),
            F.coalesce(F.var_pop(noise), double(0)).alias("noise_variance"),
            F.count(noise).alias("n_masked"),
            F.count("*").alias("n_points"),
        )
    )


def dimension_model(points: DataFrame) -> DimensionModel:
    """The d-row statistics table as plain lists; its size is the feature count, not the data."""
    rows = sorted(dimension_table(points).collect(), key=lambda r: r["dim"])
    return DimensionModel(
        [r["low"] for r in rows],
        [r["high"] for r in rows],
        [r["noise_mean"] for r in rows],
        [r["noise_variance"] for r in rows],
        [r["n_masked"] for r in rows],
        rows[0]["n_points"] if rows else 0,
    )


def inverse_span(stats: DimensionModel) -> list[float]:
    return [1.0 / (h - l) if h > l else 0.0 for l, h in zip(stats.low, stats.high)]


def normalise(points: DataFrame, stats: DimensionModel) -> DataFrame:
    """Min-max scale ``x``; a constant dimension becomes zero."""
    low, inverse = double_array(stats.low), double_array(inverse_span(stats))
    scaled = F.transform("x", lambda v, i: (v - F.get(low, i)) * F.get(inverse, i))
    return points.withColumn("x", scaled)


def expectation(x, w, mean):
    """Expected value of a partly masked measurement."""
    return w * x + (1 - w) * mean


def correction(x, w, mean, variance):
    """Variance of a partly masked measurement."""
    y = expectation(x, w, mean)
    return w * x * x + (1 - w) * (mean * mean + variance) - y * y


def mask_expectation(points: DataFrame, noise: DimensionModel) -> DataFrame:
    """Replace values by expectations ``y``; add corrections ``corr`` and effective dimensions ``q``.

    The model steps do this on the fly from ``x`` and ``w``; this form is for results and checks.
    """
    expectations = noise.kernel()
    rest = [c for c in points.columns if c not in ("x", "w")]
    arrays = T.ArrayType(T.DoubleType())
    schema = T.StructType(
        [points.schema[c] for c in rest]
        + [T.StructField(c, arrays) for c in ("y", "corr", "w")]
        + [T.StructField("q", T.DoubleType())]
    )

    def step(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            y, corr, w = expectations.of(batch)
            columns = [batch.column(c) for c in rest]
            columns += [list_column(y), list_column(corr), list_column(w), pa.array(w.sum(axis=1))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return map_arrow(points.select(*rest, "x", "w"), step, schema)


def point_model(points: DataFrame, scale: bool = True) -> DimensionModel:
    """Everything the model steps need to know about the dimensions."""
    stats = dimension_model(points)
    return stats.normalised() if scale else stats
