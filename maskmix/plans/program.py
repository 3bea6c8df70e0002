"""Clustering from files to files."""

from __future__ import annotations

import logging
import time

from pyspark.sql import DataFrame, SparkSession

from maskmix.config import MixtureConfig
from maskmix.operators.dimensions import point_model
from maskmix.operators.moments import m_step
from maskmix.operators.scoring import read_model, score_matrix
from maskmix.plans.fit import FitResult, Hooks, fit, resume
from maskmix.sources import sinks, text
from maskmix.workspace import Workspace

log = logging.getLogger("maskmix")


def cluster_files(
    spark: SparkSession, config: MixtureConfig, start_labels: str = "", journal: str | None = None
) -> FitResult:
    """Read features and masks, fit or continue from labels, and write every output asked for.

    ``journal`` names a folder in which the fit keeps its progress; run again with it, the program goes on there."""
    base, n = config.file_base, config.elec_no
    workspace = Workspace(spark, "program")
    points = workspace.save(text.read_points(spark, config), "points")
    began = time.perf_counter()

    def start_dump(classes: DataFrame, count: int) -> None:
        sinks.write_start_classes(classes, count, base, n)

    def temp_labels(classes: DataFrame) -> None:
        sinks.write_temp_labels(classes, base, n)

    hooks = Hooks(start_dump, temp_labels if config.save_temp_every_iter else None)
    if start_labels:
        classes, _ = text.read_labels(spark, start_labels)
        result = resume(points, classes, config, workspace, hooks, journal)
    else:
        result = fit(points, config, workspace, hooks, journal)
    write_outputs(points, result, config, workspace)
    report(result, time.perf_counter() - began)
    return result


def write_outputs(points: DataFrame, result: FitResult, config: MixtureConfig, workspace: Workspace) -> None:
    spark, base, n = points.sparkSession, config.file_base, config.elec_no
    sinks.write_labels(result.classes, f"{base}.clu.{n}")
    sinks.write_metrics(spark, result.metrics_frame(spark), f"{base}.log.{n}")
    if config.save_sorted and config.use_masks:
        width = len(points.select("x").first()["x"])
        ranked = sinks.write_sorted_points(points, width, base, n, workspace)
        sinks.write_sorted_labels(ranked, result.classes, base, n)
    if config.save_covariance_means or config.dist_dump:
        noise = point_model(points, config.normalise)
        classed = points.join(result.classes, "point_id")
        table = workspace.save(m_step(classed, noise, config), "final-model")
        if config.save_covariance_means:
            sinks.write_means(table, f"{base}.mean.{n}")
        if config.dist_dump:
            model = read_model(table, noise.dims, config, workspace)
            sinks.write_scores(score_matrix(classed, model, noise, config), f"{base}.scores.{n}")


def report(result: FitResult, seconds: float) -> None:
    """Time per iteration and per unit of work."""
    steps = len(result.metrics)
    d2n = sum(m["d2n"] for m in result.metrics)
    d3n = sum(m["d3n"] for m in result.metrics)
    log.info(
        "%d iterations, %.1f ms each, %.3f ns per d2n, %.3f ps per d3n, %.2f s in all",
        steps, 1e3 * seconds / steps, 1e9 * seconds / d2n, 1e12 * seconds / d3n, seconds,
    )
