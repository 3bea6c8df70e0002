"""M-step: class moments, cluster masks and covariances."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from maskmix.config import MixtureConfig
from maskmix.functions import kernels as K
from maskmix.functions.runtime import apply_arrow, map_arrow
from maskmix.operators.dimensions import DimensionModel

MODEL_SCHEMA = (
    "cluster_id INT, n BIGINT, mean ARRAY<DOUBLE>, unmasked ARRAY<INT>, block ARRAY<DOUBLE>, "
    "variance ARRAY<DOUBLE>, ok BOOLEAN, root_inverse ARRAY<DOUBLE>, inv_diag ARRAY<DOUBLE>, "
    "log_root_det DOUBLE"
)
MODEL_ARROW = pa.schema(
    [
        ("cluster_id", pa.int32()),
        ("n", pa.int64()),
        ("mean", pa.list_(pa.float64())),
        ("unmasked", pa.list_(pa.int32())),
        ("block", pa.list_(pa.float64())),
        ("variance", pa.list_(pa.float64())),
        ("ok", pa.bool_()),
        ("root_inverse", pa.list_(pa.float64())),
        ("inv_diag", pa.list_(pa.float64())),
        ("log_root_det", pa.float64()),
    ]
)


def needs_products(config: MixtureConfig) -> bool:
    """Whether a dimension can be unmasked in some cluster; masked ones take their variance from the corrections alone."""
    return not config.use_masks or config.points_for_cluster_mask < math.inf


def moment_cells(
    points: DataFrame, noise: DimensionModel, gram_for_noise: bool = False, tasks: int | None = None
) -> DataFrame:
    """Summed moments of ``(class, x, w)`` as ``(class, stat, i, j, v)`` cells, relative to the noise mean."""
    return unpack_cells(packed_cells(points, noise, gram_for_noise, tasks))


def packed_cells(
    points: DataFrame, noise: DimensionModel, gram_for_noise: bool = False, tasks: int | None = None, products: bool = True
) -> DataFrame:
    """Summed moments of ``(class, x, w)`` under packed keys, without second moments if not ``products``.

    Each task adds up its own points first; the cells are then summed by Spark under the key
    (class, stat, i, j), so even a class that holds most points is spread over many reducers.  With
    ``tasks`` that many tasks read several partitions each, without a shuffle, and hand on fewer cells.
    """
    expectations = noise.kernel()
    nu = expectations.mean

    def partial(batches):
        sums = K.MomentSums(len(nu), gram_for_noise, products=products)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            y, corr, w = expectations.of(batch)
            sums.add(batch.column("class").to_numpy(zero_copy_only=False), y - nu, w, corr)
            if sums.bytes > K.FLUSH_BYTES:
                yield from sums.cells()
                sums = K.MomentSums(len(nu), gram_for_noise, products=products)
        yield from sums.cells()

    if tasks is not None:
        points = points.coalesce(tasks)
    return summed(map_arrow(points.select("class", "x", "w"), partial, K.CELL_SCHEMA))


def summed(cells: DataFrame) -> DataFrame:
    return cells.groupBy("cell").agg(F.sum("v").alias("v"))


def moved_cells(moved: DataFrame, noise: DimensionModel, products: bool = True) -> DataFrame:
    """What points that changed their class add to the packed cells: ``(old_class, class, x, w)`` counts for
    the new class and, with the opposite sign, for the old one."""
    expectations = noise.kernel()
    nu = expectations.mean

    def partial(batches):
        sums = [K.MomentSums(len(nu), products=products) for _ in range(2)]

        def cells():
            for one, sign in zip(sums, (1.0, -1.0)):
                for batch in one.cells():
                    values = pa.array(sign * batch.column("v").to_numpy())
                    yield pa.RecordBatch.from_arrays([batch.column("cell"), values], names=["cell", "v"])

        for batch in batches:
            if batch.num_rows == 0:
                continue
            y, corr, w = expectations.of(batch)
            for one, name in zip(sums, ("class", "old_class")):
                one.add(batch.column(name).to_numpy(zero_copy_only=False), y - nu, w, corr)
            if sum(one.bytes for one in sums) > K.FLUSH_BYTES:
                yield from cells()
                sums = [K.MomentSums(len(nu), products=products) for _ in range(2)]
        yield from cells()

    return map_arrow(moved.select("old_class", "class", "x", "w"), partial, K.CELL_SCHEMA)


def unpack_cells(cells: DataFrame) -> DataFrame:
    """``(class, stat, i, j, v)`` from packed keys; a missing position is -1."""
    p, s = K.POSITION_BITS, K.STAT_BITS
    position, kind = (1 << p) - 1, (1 << s) - 1
    return cells.selectExpr(
        f"CAST(shiftright(cell, {2 * p + s}) AS INT) AS class",
        f"CAST(shiftright(cell, {2 * p}) & {kind} AS INT) AS stat",
        f"CAST(shiftright(cell, {p}) & {position} AS INT) - 1 AS i",
        f"CAST(cell & {position} AS INT) - 1 AS j",
        "v",
    )


def m_step(points: DataFrame, noise: DimensionModel, config: MixtureConfig, tasks: int | None = None) -> DataFrame:
    """One row per non-empty class: mean, block-plus-diagonal covariance and its factor.

    A group holds the summed cells of one class, at most d*d/2 + 3d + 1 rows however many points.
    Classes without points have no row, which is how empty clusters die.
    """
    return model_of_cells(packed_cells(points, noise, tasks=tasks, products=needs_products(config)), noise, config)


def run_cells(
    points: DataFrame, noise: DimensionModel, stride: int, tasks: int | None = None, products: bool = True
) -> DataFrame:
    """Packed cells of several fits at once: ``class`` is an array, and class c of fit r counts as ``r * stride + c``."""
    expectations = noise.kernel()
    nu = expectations.mean

    def partial(batches):
        sums = K.MomentSums(len(nu), stride=stride, products=products)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            y, corr, w = expectations.of(batch)
            classes, rel = K.matrix(batch.column("class")), y - nu
            for r in range(classes.shape[1]):
                sums.add(classes[:, r] + r * stride, rel, w, corr)
                if sums.bytes > K.FLUSH_BYTES:
                    yield from sums.cells()
                    sums = K.MomentSums(len(nu), stride=stride, products=products)
        yield from sums.cells()

    if tasks is not None:
        points = points.coalesce(tasks)
    return summed(map_arrow(points.select("class", "x", "w"), partial, K.CELL_SCHEMA))


def model_of_cells(
    cells: DataFrame, noise: DimensionModel, config: MixtureConfig, stride: int | None = None, sums: bool = False
) -> DataFrame:
    """The same from summed packed cells.  A class whose points have all left has no row either.  With ``stride``
    every so many classes begin with a noise class of their own; with ``sums`` a column has those of the step."""
    nu, sigma2 = noise.noise_mean, noise.noise_variance
    prior, mask_points = config.prior_point, config.points_for_cluster_mask if config.use_masks else 0.0
    schema = MODEL_ARROW.append(pa.field("sums", pa.list_(pa.float64()))) if sums else MODEL_ARROW

    def model(table: pa.Table) -> pa.Table:
        parts = [table.column(c).to_numpy() for c in ("stat", "i", "j", "v")]
        c = table.column("class")[0].as_py()
        if parts[3][parts[0] == K.COUNT].sum() < 0.5:
            return schema.empty_table()
        n, mean, unmasked, block, diagonal = K.covariance_from_moments(parts, nu, sigma2, prior, mask_points)
        if (c % stride if stride else c) == 0:  # noise is uniform: only its size matters
            factor = K.Factor(True, np.zeros((0, 0)), np.zeros(len(nu)), 0.0)
        else:
            factor = K.factorise(unmasked, block, diagonal)
        row = {
            "cluster_id": c,
            "n": int(round(n)),
            "mean": mean.tolist(),
            "unmasked": unmasked.tolist(),
            "block": block.ravel().tolist(),
            "variance": diagonal.tolist(),
            "ok": factor.ok,
            "root_inverse": factor.root_inverse.ravel().tolist(),
            "inv_diag": factor.inv_diag.tolist(),
            "log_root_det": None if math.isnan(factor.log_root_det) else factor.log_root_det,
        }
        if sums:
            at = parts[0] == K.STEP
            row["sums"] = parts[3][at][np.argsort(parts[1][at])].tolist()
        return pa.Table.from_pylist([row], schema=schema)

    return apply_arrow(unpack_cells(cells), ["class"], model, MODEL_SCHEMA + (", sums ARRAY<DOUBLE>" if sums else ""))


def mixing_weights(counts: dict[int, int], n_points: int, config: MixtureConfig) -> dict[int, float]:
    """Prior-smoothed class proportions; the noise class never reaches zero."""
    alive = set(counts) | {0}
    total = n_points + config.noise_point + config.prior_point * (len(alive) - 1)
    return {
        c: (counts.get(c, 0) + (config.prior_point if c else config.noise_point)) / total for c in alive
    }


def weight_column(c: Column, n: Column, n_points: int, clusters: int, config: MixtureConfig) -> Column:
    """The proportion of class ``c`` with ``n`` points, where ``clusters`` classes other than noise are alive."""
    extra = F.when(c == 0, F.lit(float(config.noise_point))).otherwise(F.lit(float(config.prior_point)))
    return (n + extra) / F.lit(float(n_points + config.noise_point + config.prior_point * clusters))
