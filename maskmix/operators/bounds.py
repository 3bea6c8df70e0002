"""Exact assignment that scores few clusters: bounds on all others are kept between iterations.

A point keeps its two best classes and a lower bound of every other class's score.  When the models
change, the score of cluster k at ``r = y - nu`` falls by at most a number that follows from how far the
quadratic form of that cluster moved and from ``|r|`` and the point's correction alone.  The bound falls by
the largest such number.  If both kept classes, scored exactly, stay strictly below it, no other class can
be among the two best, and the point is done with two scores.  Every other point is scored against all
clusters, which renews its bound.  Classes and scores are those of a full step.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from maskmix.config import MixtureConfig
from maskmix.functions import kernels as K
from maskmix.functions.runtime import map_arrow
from maskmix.operators.dimensions import DimensionModel
from maskmix.operators.moments import needs_products
from maskmix.operators.scoring import ASSIGN_SCHEMA, MixtureModel

BOUNDED_SCHEMA = ASSIGN_SCHEMA + ", bound DOUBLE, scored INT"
COUNTED_SCHEMA = BOUNDED_SCHEMA + ", " + K.CELL_SCHEMA
BOUNDED_ARROW = pa.schema(
    [("point_id", pa.int64())] + [(c, pa.int32()) for c in ("old_class", "class", "class2")]
    + [(c, pa.float64()) for c in ("nlp", "nlp2", "q", "bound")] + [("scored", pa.int32())]
)
#: Largest matrix whose smallest eigenvalue is computed; beyond it the norm of the matrix bounds it.
EIGEN_DIMS = 256
#: Part of a bound and of a score by which rounding could have changed them.
SLACK = 1e-9


def can_bound(model: MixtureModel, config: MixtureConfig) -> bool:
    """Bounds need the whole model at hand, and every cluster a candidate of every point."""
    return config.bounded_steps and config.min_mask_overlap <= 0 and len(model.slices) == 1 and (
        not model.slices[0] or isinstance(model.slices[0][0], dict)
    )


def _form(cluster: dict, nu: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """Unmasked dimensions, their inverse covariance, the inverse diagonal, the shift, and what is constant."""
    unmasked = np.asarray(cluster["unmasked"], dtype=int)
    root = np.asarray(cluster["root_inverse"], dtype=float).reshape(len(unmasked), len(unmasked))
    constant = cluster["log_root_det"] + 0.5 * math.log(2 * math.pi) * len(nu) - math.log(cluster["weight"])
    return unmasked, root.T @ root, np.asarray(cluster["inv_diag"], dtype=float), np.asarray(cluster["mean"]) - nu, constant


def cluster_drift(old: dict, new: dict, nu: np.ndarray) -> tuple[float, float, float, float]:
    """``(a, b, c, s)``: the score of a point falls by at most ``a |r|^2 + b |r| + c + s * correction``."""
    u0, block0, inv0, m0, c0 = _form(old, nu)
    u1, block1, inv1, m1, c1 = _form(new, nu)
    dims = np.union1d(u0, u1)
    rest = np.setdiff1d(np.arange(len(nu)), dims)
    change = np.zeros((len(dims), len(dims)))
    linear = np.zeros(len(nu))
    level = c1 - c0
    for unmasked, block, inv, m, sign in ((u0, block0, inv0, m0, -1.0), (u1, block1, inv1, m1, 1.0)):
        at = np.searchsorted(dims, unmasked)
        whole = np.zeros_like(change)
        whole[np.ix_(at, at)] = block
        others = np.setdiff1d(np.arange(len(dims)), at)
        whole[others, others] = inv[dims[others]]
        change += sign * whole
        pulled = inv * m
        pulled[dims] = whole @ m[dims]
        linear -= sign * pulled
        level += sign * 0.5 * float(m @ pulled)
    change *= 0.5
    least = 0.0
    if len(dims):
        least = float(np.linalg.eigvalsh(change)[0]) if len(dims) <= EIGEN_DIMS else -float(np.linalg.norm(change))
    if len(rest):
        least = min(least, 0.5 * float((inv1 - inv0)[rest].min()))
    return max(0.0, -least), float(np.linalg.norm(linear)), max(0.0, -level), max(0.0, -0.5 * float((inv1 - inv0).min()))


def model_drift(old: MixtureModel, new: MixtureModel, nu: np.ndarray) -> np.ndarray | None:
    """One row of four numbers per class that changed, noise included; None if bounds cannot go on.

    A class that takes part now and did not before has no bound to start from."""
    before = {m["cluster_id"]: m for m in old.slices[0]}
    rows = [(0.0, 0.0, max(0.0, old.noise_score - new.noise_score), 0.0)]
    for cluster in new.slices[0]:
        known = before.get(cluster["cluster_id"])
        if known is None:
            return None
        same = all(np.array_equal(known[c], cluster[c]) for c in ("mean", "unmasked", "root_inverse", "inv_diag"))
        if same:
            level = math.log(cluster["weight"]) - math.log(known["weight"]) + known["log_root_det"] - cluster["log_root_det"]
            rows.append((0.0, 0.0, max(0.0, level), 0.0))
        else:
            rows.append(cluster_drift(known, cluster, nu))
    return np.array(rows)


def with_unknown_bound(classes: DataFrame) -> DataFrame:
    """A class table whose points have no second class and no bound yet."""
    return classes.select("point_id", "class", F.lit(-1).alias("class2"), F.lit(-math.inf).alias("bound"))


def assign_bounded(
    points: DataFrame,
    model: MixtureModel,
    drift: np.ndarray | None,
    noise: DimensionModel,
    config: MixtureConfig,
    allow_noise: bool = True,
    count: bool = False,
) -> DataFrame:
    """As ``scoring.assign``, with two columns more: the bound, and how many clusters were scored.

    ``points`` have ``class2`` and ``bound`` of the last step beside ``class``; ``drift`` is that from the model
    of the last step to ``model``, or None for a step without bounds.  A kept class that is gone, or that a
    deletion made both the best and the second-best, leaves its points without a bound.  With ``count`` the points
    add up to the packed cells of their new classes on the way, with the sums of the step; rows of cells have the
    columns ``cell, v`` and no others."""
    spark, noise_score, expectations = points.sparkSession, model.noise_score, noise.kernel()
    first = (0, noise_score) if allow_noise else (-1, math.inf)
    shared = spark.sparkContext.broadcast(K.Scorer(model.slices[0], noise.noise_mean, config.huge_score))
    model.shared.append(shared)
    products = needs_products(config)
    schema = BOUNDED_ARROW if not count else pa.schema([*BOUNDED_ARROW, ("cell", pa.int64()), ("v", pa.float64())])

    def step(batches):
        s = shared.value
        sums = K.MomentSums(len(s.nu), products=products) if count else None

        def cells():
            for part in sums.cells():
                columns = [part.column(f.name) if f.name in ("cell", "v") else pa.nulls(part.num_rows, f.type) for f in schema]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            if batch.num_rows == 0:
                continue
            n = batch.num_rows
            y, corr, w = expectations.of(batch)
            rel = y - s.nu
            c1, c2 = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("class", "class2"))
            bound = batch.column("bound").to_numpy(zero_copy_only=False).copy()
            v1, v2, done = np.full(n, np.inf), np.full(n, np.inf), np.zeros(n, bool)
            if drift is not None:
                square = (rel**2).sum(axis=1)
                sizes = np.stack([square, np.sqrt(square), np.ones(n), corr.sum(axis=1)], axis=1)
                bound -= (sizes @ drift.T).max(axis=1)
                bound -= SLACK * np.where(np.isfinite(bound), np.abs(bound), 0.0)
                at = np.flatnonzero((bound > -np.inf) & (c1 != c2) & s.known(c1, allow_noise) & s.known(c2, allow_noise))
                v1[at] = s.own(rel[at], corr[at], c1[at], noise_score)
                v2[at] = s.own(rel[at], corr[at], c2[at], noise_score)
                highest = np.maximum(v1[at], v2[at])
                done[at] = (highest < config.huge_score) & (highest + SLACK * np.abs(highest) < bound[at])
                swap = done & ((v2 < v1) | ((v2 == v1) & (c2 < c1)))
                c1[swap], c2[swap] = c2[swap], c1[swap]
                v1[swap], v2[swap] = v2[swap], v1[swap]
            scored = np.where(done, 2, len(s.ids))
            left = np.flatnonzero(~done)
            for a in range(0, len(left), K.ROWS_AT_ONCE):
                at = left[a : a + K.ROWS_AT_ONCE]
                scores = np.concatenate([np.full((len(at), 1), first[1]), s.scores(y[at], corr[at])], axis=1)
                ids = np.concatenate([[first[0]], s.ids])
                (i1, b1), (i2, b2), (_, b3) = K.lowest(scores, ids, config.huge_score, 3)
                # a missing candidate counts as the noise class, and is not known to be one of the best
                c1[at], v1[at] = np.where(i1 < 0, 0, i1), np.where(i1 < 0, noise_score, b1)
                c2[at], v2[at] = np.where(i2 < 0, 0, i2), np.where(i2 < 0, noise_score, b2)
                bound[at] = np.where(i2 < 0, -np.inf, b3)
            q = w.sum(axis=1)
            columns = [
                batch.column("point_id"), batch.column("class"), pa.array(c1.astype(np.int32)),
                pa.array(c2.astype(np.int32)), pa.array(v1), pa.array(v2), pa.array(q),
                pa.array(bound), pa.array(scored.astype(np.int32)),
            ]
            columns += [pa.nulls(n, f.type) for f in schema][len(columns) :]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)
            if sums is not None:
                moved = batch.column("class").to_numpy(zero_copy_only=False) != c1
                sums.add(c1, rel, w, corr)
                sums.add_step(c1, np.stack([q * (q + 1) / 2 + q + 1, v1, v2 - v1, moved, scored], axis=1))
                if sums.bytes > K.FLUSH_BYTES:
                    yield from cells()
                    sums = K.MomentSums(len(s.nu), products=products)
        if sums is not None:
            yield from cells()

    given = points.select("point_id", "class", "class2", "bound", "x", "w")
    return map_arrow(given, step, COUNTED_SCHEMA if count else BOUNDED_SCHEMA)
