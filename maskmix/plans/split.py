"""Splitting clusters in two, all of them at once.

Sub-clusters of cluster c are classes 2c and 2c + 1 of one shared model, and a point is only scored
against the two halves of its own cluster.  A large cluster is therefore spread over all tasks.
"""

from __future__ import annotations

import logging
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from maskmix.config import MixtureConfig
from maskmix.functions import kernels as K
from maskmix.functions.runtime import map_arrow
from maskmix.functions.arrays import effective_dims, parameter_count, portable_hash
from maskmix.operators.moments import m_step
from maskmix.operators.scoring import load_slice, own_scores, read_model
from maskmix.operators.selection import class_penalty
from maskmix.sources.rows import join_small

log = logging.getLogger("maskmix")

def seed_halves(members: DataFrame, seed: int) -> DataFrame:
    """A seeded half of each cluster: class 2c or 2c + 1."""
    side = portable_hash(F.col("point_id"), seed) % 2
    return members.select("point_id", "class", (F.col("class") * 2 + side).cast("int").alias("half"))


def sub_weights(counts: dict[int, int], config: MixtureConfig) -> dict[int, float]:
    """Mixing weights inside each parent, whose own noise class is present but empty."""
    out = {}
    for half, n in counts.items():
        sibling = counts.get(half ^ 1, 0)
        alive = 2 if sibling else 1
        out[half] = (n + config.prior_point) / (n + sibling + config.noise_point + config.prior_point * alive)
    return out


def _halves_model(points, halves, config, workspace):
    labelled = points.frame.join(halves.hint("shuffle_hash"), "point_id")
    model = read_model(
        m_step(labelled.drop("class").withColumnRenamed("half", "class"), points.noise, config, points.moment_tasks),
        points.noise.dims, config, workspace, f"halves-model-{uuid.uuid4().hex}", 2 * config.max_possible_clusters,
    )
    weights = sub_weights({c: n for c, n in model.counts.items() if c}, config)
    return labelled, model, weights


def assign_halves(labelled: DataFrame, model, weights: dict[int, float], noise) -> DataFrame:
    """The better half of each point's own cluster; one narrow pass per model slice."""
    spark, expectations = labelled.sparkSession, noise.kernel()
    keep = "point_id BIGINT, class INT, old_half INT, half INT, nlp DOUBLE"
    state = labelled.select(
        "point_id", "class", F.col("half").alias("old_half"), "half", F.lit(math.inf).alias("nlp"), "x", "w"
    )
    for k, part in enumerate(model.slices):
        last = k == len(model.slices) - 1
        clusters = [m | {"weight": weights[m["cluster_id"]]} for m in load_slice(model, part)]
        shared = spark.sparkContext.broadcast({m["cluster_id"]: m for m in clusters})

        def step(batches, shared=shared, last=last):
            scorers = {}
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                parent = batch.column("class").to_numpy(zero_copy_only=False)
                y, corr, w = expectations.of(batch)
                half = batch.column("half").to_numpy(zero_copy_only=False).copy()
                nlp = batch.column("nlp").to_numpy(zero_copy_only=False).copy()
                for c in np.unique(parent).tolist():
                    if c not in scorers:
                        held = [shared.value[h] for h in (2 * c, 2 * c + 1) if h in shared.value]
                        scorers[c] = K.Scorer(held, noise.noise_mean) if held else None
                    if scorers[c] is None:
                        continue
                    at = np.flatnonzero(parent == c)
                    scores = scorers[c].scores(y[at], corr[at])
                    best = scores.min(axis=1)
                    lower = best < nlp[at]
                    half[at[lower]] = scorers[c].ids[scores.argmin(axis=1)][lower]
                    nlp[at[lower]] = best[lower]
                columns = {name: batch.column(name) for name in ("point_id", "class", "old_half")}
                columns |= {"half": pa.array(half.astype(np.int32)), "nlp": pa.array(nlp)}
                columns |= {"q": pa.array(w.sum(axis=1))} if last else {c: batch.column(c) for c in ("x", "w")}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        state = map_arrow(state, step, keep + (", q DOUBLE" if last else ", x ARRAY<DOUBLE>, w ARRAY<DOUBLE>"))
    return state


def _half_summary(assigned: DataFrame) -> list[dict]:
    rows = assigned.groupBy("class", "half").agg(
        F.count("*").alias("n"),
        F.sum("nlp").alias("nlp"),
        F.avg(parameter_count(F.col("q"))).alias("params"),
        F.count(F.when(F.col("old_half") != F.col("half"), 1)).alias("changed"),
    )
    return [r.asDict() for r in rows.collect()]


def local_scores(summary: list[dict], config: MixtureConfig) -> dict[int, tuple[float, int]]:
    """Score and number of halves in use for each parent cluster."""
    out = {}
    for c in {r["class"] for r in summary}:
        rows = [r for r in summary if r["class"] == c]
        n = sum(r["n"] for r in rows)
        score = sum(r["nlp"] + class_penalty(r["params"], n, config) for r in rows)
        out[c] = (score, len(rows))
    return out


def try_splits(points, current: DataFrame, score: float, outcome, config: MixtureConfig, workspace):
    """Classes after the accepted splits, or None.  Decisions follow ascending cluster ids.

    A split must lower the score inside its cluster and then the total score.  The total for every
    candidate follows from per-class sums: a class outside the candidate changes only through its
    mixing weight.
    """
    members = current.where(F.col("class") != 0).select("point_id", "class")
    if outcome.alive >= config.max_possible_clusters - 1 or not members.take(1):
        return None

    # one cluster each, for comparison
    single = members.withColumn("half", (F.col("class") * 2).cast("int"))
    labelled, one, weights = _halves_model(points, single, config, workspace)
    unsplit = local_scores(_half_summary(assign_halves(labelled, one, weights, points.noise)), config)

    # two clusters each
    halves = workspace.save(seed_halves(members, config.random_seed), "halves-start")
    for k in range(config.max_iter):
        labelled, two, weights = _halves_model(points, halves, config, workspace)
        assigned = workspace.save(assign_halves(labelled, two, weights, points.noise), f"halves-{k % 2}")
        summary = _half_summary(assigned)
        halves = assigned.select("point_id", "class", "half")
        if sum(r["changed"] for r in summary) == 0:
            break
    else:
        log.warning("halves still changed after max_iter = %d iterations", config.max_iter)
    split = local_scores(summary, config)
    promising = sorted(c for c in split if split[c][1] == 2 and split[c][0] < unsplit[c][0])
    if not promising:
        return None

    # class sums without mixing weights, for whole clusters and for halves
    n = points.n_points
    whole_points = points.frame.join(current.select("point_id", "class").hint("shuffle_hash"), "point_id")
    whole_model = read_model(m_step(whole_points, points.noise, config, points.moment_tasks), points.noise.dims, config, workspace, f"whole-model-{uuid.uuid4().hex}")
    whole = {r["class"]: r for r in own_scores(whole_points, whole_model, points.noise, config).collect()}
    labelled, two, _ = _halves_model(points, halves, config, workspace)
    half_points = labelled.drop("class").withColumnRenamed("half", "class")
    part = {r["class"]: r for r in own_scores(half_points, two, points.noise, config).collect()}
    pieces = {c: {"n": r["n"], "nlp": r["nlp"], "params": r["params"] / r["n"]} for c, r in whole.items()}
    noise_n = whole_model.counts.get(0, 0)
    noise_params = whole_points.where("class = 0").agg(F.avg(parameter_count(effective_dims(F.col("w"))))).first()[0]
    noise_penalty = class_penalty(noise_params or 0.0, n, config)
    used = set(whole_model.counts) | {0}
    taken: dict[int, int] = {}
    for c in promising:
        if 2 * c not in part or 2 * c + 1 not in part:
            continue
        free = next((f for f in range(1, config.max_possible_clusters) if f not in used), None)
        if free is None:
            break
        trial = {k: v for k, v in pieces.items() if k != c}
        for half, name in ((2 * c, c), (2 * c + 1, free)):
            trial[name] = {"n": part[half]["n"], "nlp": part[half]["nlp"], "params": part[half]["params"] / part[half]["n"]}
        total = n + config.noise_point + config.prior_point * len(trial)
        new_score = -noise_n * math.log((noise_n + config.noise_point) / total) + noise_penalty
        for t in trial.values():
            weight = (t["n"] + config.prior_point) / total
            new_score += t["nlp"] - t["n"] * math.log(weight) + class_penalty(t["params"], n, config)
        if config.always_split_bimodal or new_score < score:
            pieces, taken[c] = trial, free
            used.add(free)
    if not taken:
        return None
    moved = current.sparkSession.createDataFrame([(2 * c + 1, free) for c, free in taken.items()], "half int, moved int")
    renamed = join_small(halves.select("point_id", "half"), moved, "half").select("point_id", "moved")
    return current.select("point_id", "class").join(renamed, "point_id", "left").select(
        "point_id", F.coalesce("moved", "class").cast("int").alias("class")
    )
