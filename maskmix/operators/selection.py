"""Penalties, cluster deletion and the total score, from per-class sums."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from maskmix.config import MixtureConfig
from maskmix.functions.arrays import parameter_count


def class_summary(assigned: DataFrame, *also: str) -> DataFrame:
    """Per class, and per ``also``: size, mean parameter count, own score, loss if deleted, points that moved here."""
    scored = F.sum("scored") if "scored" in assigned.columns else F.lit(0)
    return assigned.groupBy(*also, "class").agg(
        scored.cast("long").alias("scored"),
        F.count("*").alias("n"),
        F.avg(parameter_count(F.col("q"))).alias("params"),
        F.sum("nlp").alias("nlp"),
        F.sum(F.col("nlp2") - F.col("nlp")).alias("loss"),
        F.count(F.when(F.col("old_class") != F.col("class"), 1)).alias("changed"),
    )


def moved_summary(assigned: DataFrame, candidate, *also: str) -> DataFrame:
    """What each class gains when the candidate's points go to their second-best class; a number or a column."""
    return (
        assigned.where(F.col("class") == candidate)
        .groupBy(*also, F.col("class2").alias("class"))
        .agg(
            F.count("*").alias("n"),
            F.avg(parameter_count(F.col("q"))).alias("params"),
            F.sum("nlp2").alias("nlp"),
            F.count(F.when(F.col("old_class") != F.col("class2"), 1)).alias("changed"),
        )
    )


def class_penalty(params: float, n_points: int, config: MixtureConfig) -> float:
    return config.penalty_k * 2 * params + config.penalty_k_log_n * params * math.log(n_points) / 2


def cluster_penalty(params: float, n_points: int, config: MixtureConfig) -> float:
    """What one cluster with ``params`` parameters adds to the penalty of an unmasked mixture."""
    return config.penalty_k * params + config.penalty_k_log_n * params * math.log(n_points) / 2


def classical_penalty(dims: int, alive: int, n_points: int, config: MixtureConfig) -> float:
    """Penalty of an unmasked mixture with ``alive`` classes; noise adds no parameters."""
    if alive == 1:
        return 0.0
    return cluster_penalty((dims * (dims + 1) / 2 + dims + 1) * (alive - 1), n_points, config)


@dataclass
class StepOutcome:
    """Totals of one iteration after a possible deletion."""

    deleted: int | None
    deleted_points: int
    changed: int
    raw: float
    penalty: float
    alive: int
    scored: int = 0  # point and cluster pairs whose score was computed, where the step counts them

    @property
    def score(self) -> float:
        return self.raw + self.penalty


def deletion_candidate(rows: list[dict], alive: set[int], n_points: int, config: MixtureConfig) -> int | None:
    """The cluster whose removal lowers the score most, lowest id first; none if no removal helps.

    An alive cluster that lost all its points has neither loss nor penalty, so it is never chosen.
    """
    best, chosen = config.huge_score, None
    by_class = {r["class"]: r for r in rows}
    gain = class_penalty if config.use_masks else cluster_penalty
    for c in sorted(alive - {0}):
        r = by_class.get(c)
        delta = r["loss"] - gain(r["params"], n_points, config) if r else 0.0
        if delta < best:
            best, chosen = delta, c
    return chosen if best < 0 else None


def conclude(
    assigned: DataFrame, alive: set[int], n_points: int, config: MixtureConfig, delete: bool = True,
    rows: list[dict] | None = None,
) -> StepOutcome:
    """Reduce an assignment table to the iteration's totals; only per-class rows reach the driver, or are known as ``rows``."""
    if rows is None:
        rows = [r.asDict() for r in class_summary(assigned).collect()]
    gone = deletion_candidate(rows, alive, n_points, config) if delete else None
    moved = [] if gone is None else [r.asDict() for r in moved_summary(assigned, gone).collect()]
    return outcome_of(rows, gone, moved, alive, n_points, config)


def outcome_of(
    rows: list[dict], gone: int | None, moved: list[dict], alive: set[int], n_points: int, config: MixtureConfig
) -> StepOutcome:
    """Totals from the class sums, and from those of the deleted class's points in their second-best classes."""
    sums = {r["class"]: r for r in rows}
    scored = sum(r["scored"] for r in rows)
    gone_points = 0
    if gone is not None:
        gone_points = sums.pop(gone)["n"]
        for r in moved:
            held = sums.get(r["class"])
            if held is None:
                sums[r["class"]] = r
                continue
            n = held["n"] + r["n"]
            held["params"] = (held["params"] * held["n"] + r["params"] * r["n"]) / n
            held["n"], held["nlp"] = n, held["nlp"] + r["nlp"]
            held["changed"] += r["changed"]
    left = len((alive | {0}) - {gone})
    if config.use_masks:
        penalty = sum(class_penalty(r["params"], n_points, config) for r in sums.values())
    else:  # every point has the same number of parameters
        params = next((r["params"] for r in sums.values()), 0.0)
        penalty = cluster_penalty(params * (left - 1), n_points, config)
    return StepOutcome(
        deleted=gone,
        deleted_points=gone_points,
        changed=sum(r["changed"] for r in sums.values()),
        raw=sum(r["nlp"] for r in sums.values()),
        penalty=penalty,
        alive=left,
        scored=scored,
    )


def apply_deletion(assigned: DataFrame, deleted: int | None) -> DataFrame:
    """Points of the deleted class take their second-best class."""
    if deleted is None:
        return assigned
    out = F.col("class") == deleted
    return assigned.withColumn("nlp", F.when(out, F.col("nlp2")).otherwise(F.col("nlp"))).withColumn(
        "class", F.when(out, F.col("class2")).otherwise(F.col("class"))
    )
