"""E-step and C-step: scores of points under the model, best and second-best class."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from maskmix.config import MixtureConfig
from maskmix.functions import kernels as K
from maskmix.functions.runtime import map_arrow
from maskmix.operators.dimensions import DimensionModel
from maskmix.operators.moments import mixing_weights
from maskmix.workspace import Workspace

SCORE_COLUMNS = ["cluster_id", "mean", "unmasked", "root_inverse", "inv_diag", "log_root_det"]
ASSIGN_SCHEMA = "point_id BIGINT, old_class INT, class INT, class2 INT, nlp DOUBLE, nlp2 DOUBLE, q DOUBLE"
SCORE_SCHEMA = "point_id BIGINT, class INT, cluster_id INT, mahalanobis DOUBLE, variance_term DOUBLE, nlp DOUBLE"


@dataclass
class MixtureModel:
    """Cluster sizes and weights, with the table that holds the large parts of each cluster."""

    table: DataFrame
    counts: dict[int, int]
    weights: dict[int, float]
    singular: list[int]
    slices: list[list[dict]] = field(default_factory=list)
    shared: list = field(default_factory=list)

    def release(self) -> None:
        """Drop the broadcasts of the passes so far; for when their results are written."""
        for one in self.shared:
            one.destroy()
        self.shared.clear()

    @property
    def clusters(self) -> list[int]:
        """Usable clusters, ascending, noise left out."""
        return sorted(c for c in self.counts if c and c not in self.singular)

    @property
    def alive(self) -> int:
        return len(set(self.counts) | {0})

    @property
    def noise_score(self) -> float:
        return -math.log(self.weights[0])


def slice_bytes(dims: int) -> int:
    """Upper bound of the scoring data of one cluster, which holds its factor twice."""
    return 8 * (2 * dims * dims + 12 * dims + 64)


def collect_arrays(rows: DataFrame) -> list[dict]:
    """Rows with list columns as numpy arrays; Arrow keeps numbers out of Python objects."""
    table = rows.toArrow()
    out = []
    for name in table.column_names:
        column = table.column(name)
        if pa.types.is_list(column.type):
            values = [v.values.to_numpy(zero_copy_only=False) for v in column]
        else:
            values = column.to_pylist()
        out.append(values)
    return [dict(zip(table.column_names, row)) for row in zip(*out)]


def read_model(
    model: DataFrame, dims: int, config: MixtureConfig, workspace=None, name: str = "model", most: int | None = None
) -> MixtureModel:
    """Bring the model to the driver in slices whose size is bounded by the configuration.

    More than ``most`` rows (``max_possible_clusters`` by default) are an error.  A model that could be
    too large for one slice is written to the workspace first, under a ``name`` of its own, and read
    back slice by slice.
    """
    at_once = max(1, config.model_broadcast_bytes // slice_bytes(dims))
    most = config.max_possible_clusters if most is None else most
    small = most <= at_once
    if not small and workspace is not None:
        model = workspace.save(model, name)
    if small:
        rows = collect_arrays(model.select(*SCORE_COLUMNS, "n", "ok").limit(most + 1))
        sizes = {r["cluster_id"]: r["n"] for r in rows}
        singular = [r["cluster_id"] for r in rows if not r["ok"]]
        slices = [[r for r in rows if r["cluster_id"] and r["ok"]]]
    else:
        heads = model.select("cluster_id", "n", "ok").limit(most + 1).collect()
        sizes = {r["cluster_id"]: r["n"] for r in heads}
        singular = [r["cluster_id"] for r in heads if not r["ok"]]
        usable = sorted(c for c in sizes if c and c not in singular)
        slices = [usable[k : k + at_once] for k in range(0, len(usable), at_once)] or [[]]
    if len(sizes) > most:
        raise ValueError(f"more than {most} classes; max_possible_clusters is {config.max_possible_clusters}")
    weights = mixing_weights(sizes, sum(sizes.values()), config)
    out = MixtureModel(model, sizes, weights, singular)
    if small:
        for r in slices[0]:
            r["weight"] = weights[r["cluster_id"]]
    out.slices = slices
    return out


def read_summed(model: DataFrame, config: MixtureConfig) -> tuple[MixtureModel, list[dict]]:
    """The model of ``model_of_cells`` with sums, for classes that were scored with a model in one slice, and the
    ``class_summary`` of the points it was made from."""
    rows = collect_arrays(model.select(*SCORE_COLUMNS, "n", "ok", "sums"))
    names = ("params", "nlp", "loss", "changed", "scored")
    sums = []
    for r in rows:
        one = dict(zip(names, r["sums"].tolist()))
        whole = {k: int(round(one[k])) for k in ("changed", "scored")}
        sums.append({"class": r["cluster_id"], "n": r["n"], **one, **whole, "params": one["params"] / r["n"]})
    sizes = {r["cluster_id"]: r["n"] for r in rows}
    singular = [r["cluster_id"] for r in rows if not r["ok"]]
    weights = mixing_weights(sizes, sum(sizes.values()), config)
    usable = [r | {"weight": weights[r["cluster_id"]]} for r in rows if r["cluster_id"] and r["ok"]]
    return MixtureModel(model, sizes, weights, singular, [usable]), sums


def load_slice(model: MixtureModel, part: list) -> list[dict]:
    if not part or isinstance(part[0], dict):
        return part
    rows = collect_arrays(model.table.where(F.col("cluster_id").isin(part)).select(*SCORE_COLUMNS))
    return [r | {"weight": model.weights[r["cluster_id"]]} for r in rows]


def _broadcast_scorers(spark, model: MixtureModel, noise: DimensionModel, config: MixtureConfig):
    for part in model.slices:
        one = spark.sparkContext.broadcast(K.Scorer(load_slice(model, part), noise.noise_mean, config.huge_score))
        model.shared.append(one)
        yield one


def assign(
    points: DataFrame,
    model: MixtureModel,
    noise: DimensionModel,
    config: MixtureConfig,
    allow_noise: bool = True,
    workspace: Workspace | None = None,
    name: str = "slices",
) -> DataFrame:
    """Best and second-best class of every point; the points-by-clusters scores are never stored.

    Narrow: one pass per model slice in the same stage, each carrying the two best so far.  With a
    workspace the two best are written between slices and joined to the points again, so that one slice
    is on the executors at a time.  ``class`` of the input is kept as ``old_class``.  A cluster whose
    covariance is singular takes no part.
    """
    spark = points.sparkSession
    overlap_floor, noise_score = config.min_mask_overlap, model.noise_score
    first_candidates = (0, noise_score) if allow_noise else (-1, math.inf)
    expectations = noise.kernel()
    carried = "point_id BIGINT, old_class INT, class INT, class2 INT, nlp DOUBLE, nlp2 DOUBLE, x ARRAY<DOUBLE>, w ARRAY<DOUBLE>"
    state = points.select(
        "point_id",
        F.col("class").alias("old_class"),
        F.lit(first_candidates[0]).alias("class"),
        F.lit(-1).alias("class2"),
        F.lit(first_candidates[1]).cast("double").alias("nlp"),
        F.lit(math.inf).alias("nlp2"),
        "x",
        "w",
    )
    for k, scorer in enumerate(_broadcast_scorers(spark, model, noise, config)):
        last = k == len(model.slices) - 1

        def step(batches, scorer=scorer, last=last):
            s = scorer.value
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                held_ids = np.stack([batch.column("class").to_numpy(), batch.column("class2").to_numpy()], axis=1)
                held = np.stack([batch.column("nlp").to_numpy(), batch.column("nlp2").to_numpy()], axis=1)
                y, corr, w = expectations.of(batch)
                c1, v1, c2, v2 = s.best_two(y, corr, held_ids, held, w, overlap_floor)
                if last:  # a missing candidate counts as the noise class
                    c1, v1 = np.where(c1 < 0, 0, c1), np.where(c1 < 0, noise_score, v1)
                    c2, v2 = np.where(c2 < 0, 0, c2), np.where(c2 < 0, noise_score, v2)
                columns = {
                    "point_id": batch.column("point_id"),
                    "old_class": batch.column("old_class"),
                    "class": pa.array(c1.astype(np.int32)),
                    "class2": pa.array(c2.astype(np.int32)),
                    "nlp": pa.array(v1),
                    "nlp2": pa.array(v2),
                }
                columns |= {"q": pa.array(w.sum(axis=1))} if last else {c: batch.column(c) for c in ("x", "w")}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        state = map_arrow(state, step, ASSIGN_SCHEMA if last else carried)
        if workspace is not None and not last:
            narrow = workspace.save(state.drop("x", "w"), f"{name}-{k % 2}")
            model.release()
            state = points.select("point_id", "x", "w").join(narrow.hint("shuffle_hash"), "point_id")
    return state


def score_matrix(
    points: DataFrame, model: MixtureModel, noise: DimensionModel, config: MixtureConfig
) -> DataFrame:
    """Every (point, cluster) score in long form, noise included; for dumps and checks."""
    spark, noise_score, expectations = points.sparkSession, model.noise_score, noise.kernel()
    base = points.select("point_id", "class", "x", "w")
    out = base.select(
        "point_id",
        "class",
        F.lit(0).alias("cluster_id"),
        F.lit(0.0).alias("mahalanobis"),
        F.lit(0.0).alias("variance_term"),
        F.lit(noise_score).alias("nlp"),
    )
    for scorer in _broadcast_scorers(spark, model, noise, config):

        def rows(batches, scorer=scorer):
            s = scorer.value
            for batch in batches:
                n, k = batch.num_rows, len(s.ids)
                if n == 0 or k == 0:
                    continue
                y, corr, _ = expectations.of(batch)
                mahal, extra = s.mahalanobis(y - s.nu), s.variance_term(corr)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(batch.column("point_id").to_numpy(), k)),
                        pa.array(np.repeat(batch.column("class").to_numpy(), k)),
                        pa.array(np.tile(s.ids, n).astype(np.int32)),
                        pa.array(mahal.ravel()),
                        pa.array(extra.ravel()),
                        pa.array((0.5 * (mahal + extra) + s.const).ravel()),
                    ],
                    names=["point_id", "class", "cluster_id", "mahalanobis", "variance_term", "nlp"],
                )

        out = out.unionByName(map_arrow(base, rows, SCORE_SCHEMA))
    return out


def overlaps(points: DataFrame, model: MixtureModel, dims: int) -> DataFrame:
    """``point_id, cluster_id, overlap``: soft mask mass of a point on a cluster's unmasked dimensions."""
    out = None
    for part in model.slices:
        rows = sorted(load_slice(model, part), key=lambda r: r["cluster_id"])
        ids = np.array([r["cluster_id"] for r in rows], dtype=np.int32)
        member = np.zeros((dims, len(rows)))
        for k, r in enumerate(rows):
            member[np.asarray(r["unmasked"], dtype=int), k] = 1.0

        def step(batches, ids=ids, member=member):
            for batch in batches:
                mass = K.matrix(batch.column("w")) @ member if batch.num_rows else np.zeros((0, len(ids)))
                points_of = np.repeat(batch.column("point_id").to_numpy(), len(ids))
                columns = [pa.array(points_of), pa.array(np.tile(ids, batch.num_rows)), pa.array(mass.ravel())]
                yield pa.RecordBatch.from_arrays(columns, names=["point_id", "cluster_id", "overlap"])

        found = map_arrow(points.select("point_id", "w"), step, "point_id BIGINT, cluster_id INT, overlap DOUBLE")
        out = found if out is None else out.union(found)
    return out


SUM_COLUMNS = ("mahalanobis", "variance_term", "nlp")


def score_sums(points: DataFrame, model: MixtureModel, noise: DimensionModel, config: MixtureConfig) -> DataFrame:
    """Per class and cluster: number of points, and sum, least and largest of the three score columns.

    Scores are added up inside the tasks; what leaves a task is a row per class and cluster."""
    spark, expectations = points.sparkSession, noise.kernel()
    schema = "class INT, cluster_id INT, n BIGINT, " + ", ".join(
        f"{c}_total DOUBLE, {c}_low DOUBLE, {c}_high DOUBLE" for c in SUM_COLUMNS
    )
    out = None
    for scorer in _broadcast_scorers(spark, model, noise, config):

        def sums(batches, scorer=scorer):
            s = scorer.value
            held: dict[int, list] = {}
            for batch in batches:
                if batch.num_rows == 0 or not len(s.ids):
                    continue
                classes = batch.column("class").to_numpy(zero_copy_only=False)
                y, corr, _ = expectations.of(batch)
                mahal, extra = s.mahalanobis(y - s.nu), s.variance_term(corr)
                values = (mahal, extra, 0.5 * (mahal + extra) + s.const)
                for c in np.unique(classes).tolist():
                    at = classes == c
                    old = held.get(c)
                    new = [int(at.sum())]
                    for k, v in enumerate(values):
                        part = (v[at].sum(axis=0), v[at].min(axis=0), v[at].max(axis=0))
                        if old is not None:
                            t, low, high = old[k + 1]
                            part = (t + part[0], np.minimum(low, part[1]), np.maximum(high, part[2]))
                        new.append(part)
                    if old is not None:
                        new[0] += old[0]
                    held[c] = new
            for c, (n, *parts) in held.items():
                k = len(s.ids)
                columns = [pa.array(np.full(k, c, np.int32)), pa.array(s.ids.astype(np.int32)), pa.array(np.full(k, n, np.int64))]
                columns += [pa.array(v) for part in parts for v in part]
                names = ["class", "cluster_id", "n"] + [f"{x}_{y}" for x in SUM_COLUMNS for y in ("total", "low", "high")]
                yield pa.RecordBatch.from_arrays(columns, names=names)

        part = map_arrow(points.select("class", "x", "w"), sums, schema)
        out = part if out is None else out.unionByName(part)
    merged = [F.sum("n").alias("n")]
    for c in SUM_COLUMNS:
        merged += [F.sum(f"{c}_total").alias(f"{c}_total"), F.min(f"{c}_low").alias(f"{c}_low"), F.max(f"{c}_high").alias(f"{c}_high")]
    return out.groupBy("class", "cluster_id").agg(*merged)


def own_scores(
    points: DataFrame, model: MixtureModel, noise: DimensionModel, config: MixtureConfig
) -> DataFrame:
    """Per class: size, sum of own-cluster scores without the mixing weight, sum of parameter counts."""
    spark, expectations = points.sparkSession, noise.kernel()
    parts = []
    for scorer in _broadcast_scorers(spark, model, noise, config):

        def sums(batches, scorer=scorer):
            s = scorer.value
            place = {c: k for k, c in enumerate(s.ids.tolist())}
            total, params = np.zeros(len(s.ids)), np.zeros(len(s.ids))
            size = np.zeros(len(s.ids), dtype=np.int64)
            weights = np.log([m["weight"] for m in s.clusters])
            for batch in batches:
                classes = batch.column("class").to_numpy(zero_copy_only=False)
                y, corr, w = expectations.of(batch)
                q = w.sum(axis=1)
                for c in np.unique(classes).tolist():
                    if c in place:
                        k, at = place[c], classes == c
                        one = K.Scorer([s.clusters[k]], s.nu)
                        total[k] += one.scores(y[at], corr[at]).sum() + at.sum() * weights[k]
                        size[k] += at.sum()
                        params[k] += (q[at] * (q[at] + 1) / 2 + q[at] + 1).sum()
            yield pa.RecordBatch.from_arrays(
                [pa.array(s.ids.astype(np.int32)), pa.array(size), pa.array(total), pa.array(params)],
                names=["class", "n", "nlp", "params"],
            )

        parts.append(map_arrow(points.select("class", "x", "w"), sums, "class INT, n BIGINT, nlp DOUBLE, params DOUBLE"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    totals = [F.sum(c).alias(c) for c in ("n", "nlp", "params")]
    return out.groupBy("class").agg(*totals).where("n > 0")
