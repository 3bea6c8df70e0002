"""Several fits in the same passes over the points: one scan serves every start that is still running.

A point has one row, with an array of classes, one per running fit.  An iteration is one M-step over all of
them (class c of fit r is class ``r * stride + c`` there), one pass that scores the clusters of every fit, and one
summary per fit and class, so its jobs do not depend on the number of fits.  A fit that is done leaves the arrays.
"""

from __future__ import annotations

import logging
import math
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from maskmix.config import MixtureConfig
from maskmix.functions import kernels as K
from maskmix.functions.runtime import map_arrow
from maskmix.operators.dimensions import DimensionModel
from maskmix.operators.masks import start_arrays
from maskmix.operators.moments import mixing_weights, model_of_cells, run_cells
from maskmix.operators.scoring import SCORE_COLUMNS, MixtureModel, collect_arrays, slice_bytes
from maskmix.operators.selection import class_summary, deletion_candidate, moved_summary, outcome_of
from maskmix.plans.fit import FitResult, Hooks, PreparedPoints, fit_once, is_full_step, metric_row, with_class
from maskmix.workspace import Workspace

log = logging.getLogger("maskmix")

RUNS_SCHEMA = (
    "point_id BIGINT, old_class ARRAY<INT>, class ARRAY<INT>, class2 ARRAY<INT>, nlp ARRAY<DOUBLE>, nlp2 ARRAY<DOUBLE>, q DOUBLE"
)


def run_models(rows: list[dict], runs: int, stride: int, config: MixtureConfig) -> list[MixtureModel]:
    """The model of each fit from the rows of all."""
    out = []
    for r in range(runs):
        own = [m | {"cluster_id": m["cluster_id"] - r * stride} for m in rows if m["cluster_id"] // stride == r]
        counts = {m["cluster_id"]: m["n"] for m in own}
        singular = [m["cluster_id"] for m in own if not m["ok"]]
        weights = mixing_weights(counts, sum(counts.values()), config)
        usable = [m | {"weight": weights[m["cluster_id"]]} for m in own if m["cluster_id"] and m["ok"]]
        out.append(MixtureModel(None, counts, weights, singular, [usable]))
    return out


def assign_runs(points: DataFrame, models: list[MixtureModel], noise: DimensionModel, config: MixtureConfig):
    """Best and second-best class of every point in every fit, and the broadcast to drop once it is written."""
    spark, expectations, floor = points.sparkSession, noise.kernel(), config.min_mask_overlap
    scorers = [K.Scorer(m.slices[0], noise.noise_mean, config.huge_score) for m in models]
    shared = spark.sparkContext.broadcast((scorers, [m.noise_score for m in models]))

    def step(batches):
        own, noise_scores = shared.value
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            y, corr, w = expectations.of(batch)
            c1, c2 = (np.zeros((n, len(own)), np.int32) for _ in range(2))
            v1, v2 = (np.zeros((n, len(own))) for _ in range(2))
            for r, (s, level) in enumerate(zip(own, noise_scores)):
                held_ids, held = np.tile([0, -1], (n, 1)), np.tile([level, math.inf], (n, 1))
                a, va, b, vb = s.best_two(y, corr, held_ids, held, w, floor)
                c1[:, r], v1[:, r] = np.where(a < 0, 0, a), np.where(a < 0, level, va)
                c2[:, r], v2[:, r] = np.where(b < 0, 0, b), np.where(b < 0, level, vb)
            columns = [batch.column("point_id"), batch.column("class"), *(K.list_column(x) for x in (c1, c2, v1, v2))]
            names = ["point_id", "old_class", "class", "class2", "nlp", "nlp2", "q"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(w.sum(axis=1))], names=names)

    return map_arrow(points.select("point_id", "class", "x", "w"), step, RUNS_SCHEMA), shared


def by_run(assigned: DataFrame) -> DataFrame:
    """One row per point and fit, only to be summed up."""
    zipped = F.arrays_zip("old_class", "class", "class2", "nlp", "nlp2")
    rows = assigned.select("q", F.posexplode(zipped).alias("run", "s"))
    return rows.select("run", "q", *[F.col(f"s.{c}").alias(c) for c in ("old_class", "class", "class2", "nlp", "nlp2")])


def fit_many(
    points: PreparedPoints, starts: list[tuple[int, int]], config: MixtureConfig, workspace: Workspace, hooks: Hooks = Hooks()
) -> dict[int, FitResult]:
    """Fits from several ``(start clusters, seed)``, with the results of one fit after the other.

    As many fits go together as their models are within ``model_broadcast_bytes``; one that alone is
    larger is fitted alone."""
    out: dict[int, FitResult] = {}
    room = config.model_broadcast_bytes // slice_bytes(points.noise.dims)
    group: list[int] = []
    for run, (k, _) in enumerate(starts):
        if group and sum(starts[r][0] for r in group) + k > room:
            out |= _fit_group(points, group, starts, config, workspace, hooks)
            group = []
        if k > room:
            out[run] = fit_once(points, k, config, workspace, run, hooks)
        else:
            group.append(run)
    if group:
        out |= _fit_group(points, group, starts, config, workspace, hooks)
    return out


def _fit_group(points, group: list[int], starts, config: MixtureConfig, workspace: Workspace, hooks: Hooks) -> dict[int, FitResult]:
    n, stride, label = points.n_points, config.max_possible_clusters, group[0]
    first, classes_of = start_arrays(points.frame, [starts[r] for r in group], config)
    current = workspace.save(first, f"together-start-{label}")
    begun = dict(zip(group, classes_of))
    if hooks.on_start is not None:
        for place, run in enumerate(group):
            hooks.on_start(current.select("point_id", F.get("class", F.lit(place)).alias("class")), begun[run])
    active, iteration = list(group), 0
    score, full = dict.fromkeys(group, 0.0), dict.fromkeys(group, True)
    metrics: dict[int, list[dict]] = {r: [] for r in group}
    out: dict[int, FitResult] = {}
    while active:
        began = time.perf_counter()
        labelled = with_class(points, current.select("point_id", "class"))
        table = model_of_cells(run_cells(labelled, points.noise, stride, points.moment_tasks), points.noise, config, stride)
        models = run_models(collect_arrays(table.select(*SCORE_COLUMNS, "n", "ok")), len(active), stride, config)
        found, shared = assign_runs(labelled, models, points.noise, config)
        assigned = workspace.save(found, f"together-{label}-{iteration % 2}")
        shared.destroy()
        exploded = by_run(assigned)
        summary: dict[int, list[dict]] = {r: [] for r in range(len(active))}
        for row in class_summary(exploded, "run").collect():
            summary[row["run"]].append(row.asDict())
        alive = [set(m.clusters) | {0} for m in models]
        gone = [deletion_candidate(summary[r], alive[r], n, config) for r in range(len(active))]
        moved: dict[int, list[dict]] = {r: [] for r in range(len(active))}
        deleted = F.array(*[F.lit(-1 if c is None else c) for c in gone])
        if any(c is not None for c in gone):
            for row in moved_summary(exploded, F.get(deleted, F.col("run")), "run").collect():
                moved[row["run"]].append(row.asDict())
        pairs = F.arrays_zip("class", "class2")
        left = F.transform(pairs, lambda z, i: F.when(z["class"] == F.get(deleted, i), z["class2"]).otherwise(z["class"]))
        current = assigned.select("point_id", left.alias("class"))
        iteration += 1
        staying = []
        for place, run in enumerate(active):
            outcome = outcome_of(summary[place], gone[place], moved[place], alive[place], n, config)
            old, score[run] = score[run], outcome.score
            step, last_full = ("F" if full[run] else "Q"), full[run]
            full[run] = is_full_step(outcome.changed, n, iteration, outcome.score, old, config)
            seconds = (time.perf_counter() - began) / len(active)
            metrics[run].append(metric_row(points, run, iteration - 1, step, outcome, 0, seconds, n, len(models[place].clusters)))
            own = current.select("point_id", F.get("class", F.lit(place)).alias("class"))
            over = iteration > config.max_iter
            if hooks.on_better is not None and not over and old > outcome.score:
                hooks.on_better(own)
            if over:
                log.warning("run %d stopped after max_iter = %d iterations without convergence", run, config.max_iter)
            if over or (outcome.changed == 0 and last_full):
                saved = workspace.save(own, f"classes-{run}")
                out[run] = FitResult(saved, outcome.score, models[place], outcome.alive, begun[run], metrics[run])
            else:
                staying.append(place)
        if len(staying) < len(active):
            active = [active[p] for p in staying]
            current = current.withColumn("class", F.array(*[F.get("class", F.lit(p)) for p in staying]) if staying else F.col("class"))
        log.info("iteration %d: %d of %d fits are running", iteration - 1, len(active), len(group))
    return out
