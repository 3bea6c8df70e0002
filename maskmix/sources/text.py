"""Readers for the text formats: features, soft masks, labels and voltage traces.

A matrix file holds its width on line 1 and then one whitespace-separated row per line.  Line order
is the identity of a point, so rows are numbered by file, block and place in the block.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from maskmix.config import MixtureConfig
from maskmix.functions.arrays import binary_mask, drop_last, select_bits
from maskmix.sources.rows import number_rows


def open_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines with the columns that order them; a missing path raises AnalysisException."""
    lines = spark.read.text(path).select(
        F.trim("value").alias("line"),
        file_order(F.col("_metadata.file_path")).alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )
    return lines.where(F.length("line") > 0)


def file_order(path: Column) -> Column:
    """Sorts part files by their number, which has more than five digits from part 100000 on."""
    part = F.regexp_extract(path, r"part-(\d+)[^/]*$", 1)
    folder = F.regexp_replace(path, r"part-\d+[^/]*$", "")
    number = F.when(part != "", F.lpad(part, 20, "0")).otherwise("")
    return F.concat_ws("\u0001", folder, number, path)


def first_line(spark: SparkSession, path: str) -> str:
    """The header, read from the first file only."""
    files = sorted(spark.read.text(path).inputFiles(), key=_part_number)
    for file in files:
        head = spark.read.text(file).where(F.length(F.trim("value")) > 0).head(1)
        if head:
            return head[0]["value"].strip()
    raise ValueError(f"{path} is empty")


def _part_number(file: str) -> tuple:
    found = re.search(r"part-(\d+)[^/]*$", file)
    return (file[: found.start()], int(found[1]), file) if found else (file, -1, file)


def read_matrix(spark: SparkSession, path: str, rectangular: bool = True) -> tuple[DataFrame, int]:
    """``(point_id, x)`` and the width named in the header.

    A row of another width raises when it is read; ``rectangular=False`` is for label files, whose
    header is a count of classes."""
    width = int(first_line(spark, path))
    rows = number_rows(open_lines(spark, path), "row", ["file", "block"]).where(F.col("row") > 0)
    values = F.transform(F.split("line", r"\s+"), lambda v: v.cast("double"))
    if rectangular:
        message = F.concat(F.lit(f"{path}: row "), F.col("row"), F.lit(f" does not have {width} values"))
        values = F.when(F.size(values) == width, values).otherwise(F.raise_error(message).cast("array<double>"))
    return rows.select((F.col("row") - 1).alias("point_id"), values.alias("x")), width


def select_features(values, config: MixtureConfig):
    """Bit-string selection if one is given, else all but the last N features."""
    if config.use_features:
        return select_bits(values, config.use_features)
    return drop_last(values, config.drop_last_n_features)


def read_features(spark: SparkSession, config: MixtureConfig) -> DataFrame:
    x, _ = read_matrix(spark, f"{config.file_base}.fet.{config.elec_no}")
    return x.select("point_id", select_features(F.col("x"), config).alias("x"))


def read_masks(spark: SparkSession, config: MixtureConfig) -> DataFrame:
    w, _ = read_matrix(spark, f"{config.file_base}.fmask.{config.elec_no}")
    return w.select("point_id", select_features(F.col("x"), config).alias("w"))


def read_points(spark: SparkSession, config: MixtureConfig) -> DataFrame:
    """Features joined with soft masks; different widths are an error.  Without masks all weights are one."""
    if not config.use_masks:
        return read_features(spark, config).withColumn("w", F.transform("x", lambda v: F.lit(1.0)))
    base, n = config.file_base, config.elec_no
    fet, fmask = f"{base}.fet.{n}", f"{base}.fmask.{n}"
    widths = int(first_line(spark, fet)), int(first_line(spark, fmask))
    if widths[0] != widths[1]:
        raise ValueError(f"feature file has {widths[0]} features, mask file has {widths[1]}")
    both = read_features(spark, config).join(read_masks(spark, config), "point_id", "full_outer")
    lacking = F.col("x").isNull() | F.col("w").isNull()
    message = F.concat(F.lit(f"{fet} and {fmask} differ in length: only one has row "), F.col("point_id"))
    checked = F.when(lacking, F.raise_error(message).cast("array<double>")).otherwise(F.col("x"))
    return both.select("point_id", checked.alias("x"), "w")


def read_binary_masks(spark: SparkSession, config: MixtureConfig) -> DataFrame:
    return read_masks(spark, config).select("point_id", binary_mask(F.col("w")).alias("mask"))


def read_labels(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """``(point_id, class)`` from one-based labels, and the class count of the header."""
    rows, count = read_matrix(spark, path, rectangular=False)
    return rows.select("point_id", (F.get("x", F.lit(0)).cast("int") - 1).alias("class")), count


def read_traces(spark: SparkSession, path: str, channels: int = 32) -> DataFrame:
    """``(sample, channel, v)`` from a stream of numbers, all channels of a sample together."""
    tokens = open_lines(spark, path).select("file", "block", F.explode(F.split("line", r"\s+")).alias("token"))
    numbered = number_rows(tokens, "place", ["file", "block"])
    return numbered.select(
        F.floor(F.col("place") / channels).alias("sample"),
        (F.col("place") % channels).cast("int").alias("channel"),
        F.col("token").cast("double").alias("v"),
    )
