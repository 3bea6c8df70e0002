"""Writers for labels, models, sorted data and dumps."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from maskmix.functions.arrays import binary_mask
from maskmix.functions.runtime import map_arrow
from maskmix.sources.rows import join_small, number_sorted


def write_lines(rows: DataFrame, key: str, line, header: str, path: str) -> None:
    """A header, then one line per row ordered by ``key``; range partitions become the part files."""
    spark = rows.sparkSession
    body = rows.select(F.col(key).cast("long").alias("key"), line.alias("line"))
    top = spark.range(1).select(F.lit(-1).cast("long").alias("key"), F.lit(header).alias("line"))
    body.union(top).orderBy("key").select("line").write.mode("overwrite").text(path)


def spaced(values) -> F.Column:
    return F.array_join(F.transform(values, lambda v: v.cast("string")), " ")


def write_matrix(rows: DataFrame, values: str, width: int, path: str, key: str = "point_id") -> None:
    write_lines(rows, key, spaced(F.col(values)), str(width), path)


def label_table(classes: DataFrame) -> DataFrame:
    """Non-empty classes with their dense labels: noise is 1, the others follow in id order.

    One row per class, so ordering them in one task is safe.
    """
    used = classes.where("class <> 0").groupBy("class").agg(F.count("*").alias("n"))
    return used.select("class", (F.row_number().over(Window.orderBy("class")) + 1).cast("int").alias("label"))


def relabel(classes: DataFrame) -> DataFrame:
    """Replace ``class`` by its dense ``label``."""
    labels = label_table(classes)
    return join_small(classes, labels, "class", "left").withColumn("label", F.coalesce("label", F.lit(1))).drop("class")


def label_count(classes: DataFrame) -> int:
    """Highest label; counts noise even if it is empty."""
    return classes.where("class <> 0").select("class").distinct().count() + 1


def write_labels(classes: DataFrame, path: str) -> None:
    """Label file: the count, then one label per point in point order."""
    write_lines(relabel(classes), "point_id", F.col("label").cast("string"), str(label_count(classes)), path)


def write_temp_labels(classes: DataFrame, base: str, elec_no: int) -> None:
    """Labels of a running fit, beside the final ones."""
    write_labels(classes, f"{base}.temp.clu.{elec_no}")


def write_start_classes(classes: DataFrame, count: int, base: str, elec_no: int) -> None:
    """Start classes as they are, zero-based, under the number of start classes."""
    path = f"{base}.initialclusters.{count}.clu.{elec_no}"
    write_lines(classes, "point_id", F.col("class").cast("string"), str(count), path)


def write_means(model: DataFrame, path: str) -> None:
    """Mean and covariance parts of every class; at most one row per class."""
    model.select("cluster_id", "n", "mean", "unmasked", "block", "variance").write.mode("overwrite").parquet(path)


def mask_order(points: DataFrame, workspace) -> DataFrame:
    """Dense ``rank`` by (mask, point), masks compared position by position."""
    if "mask" not in points.columns:
        points = points.withColumn("mask", binary_mask(F.col("w")))
    return number_sorted(points, ["mask", "point_id"], "rank", workspace)


def write_sorted_points(points: DataFrame, width: int, base: str, elec_no: int, workspace) -> DataFrame:
    """Features and binary masks in mask order; returns the ranked points."""
    ranked = mask_order(points, workspace)
    write_matrix(ranked, "x", width, f"{base}.sorted.fet.{elec_no}", "rank")
    write_matrix(ranked, "mask", width, f"{base}.sorted.mask.{elec_no}", "rank")
    return ranked


def write_sorted_labels(ranked: DataFrame, classes: DataFrame, base: str, elec_no: int) -> None:
    labels = relabel(classes)
    lines = ranked.select("rank", "point_id").join(labels, "point_id")
    write_lines(lines, "rank", F.col("label").cast("string"), str(label_count(classes)), f"{base}.sorted.clu.{elec_no}")


def write_scores(scores: DataFrame, path: str) -> None:
    scores.write.mode("overwrite").parquet(path)


def printed_rows(rows: DataFrame, key: str, values: str) -> DataFrame:
    """``(key, line)`` with five significant digits per number, each followed by a blank."""

    def step(batches):
        for batch in batches:
            lines = ["".join("%.5g " % v for v in row) for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, pa.string())], names=[key, "line"])

    return map_arrow(rows.select(F.col(key).cast("long"), values), step, f"{key} BIGINT, line STRING")


def write_metrics(spark: SparkSession, metrics: DataFrame, path: str) -> None:
    """The run log: one row per iteration."""
    metrics.orderBy("run", "iteration").write.mode("overwrite").parquet(path)
