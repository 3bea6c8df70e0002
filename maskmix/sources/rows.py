"""Row placement: partitions for small scans, dense row numbers without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

SMALL_ROWS = 100_000


def spread(df: DataFrame, *by: str) -> tuple[DataFrame, int]:
    """A scan with at least one partition per core, and its partition count.

    Only a table too small to occupy the cores is moved; a large scan stays as it is.  Rows go by the
    hash of ``by``, which lets the planner drop columns that nobody reads before they move, or else
    of the whole row; neither needs a sort, unlike dealing them out in turn.
    """
    parts, cores = df.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism
    return (df, parts) if parts >= cores else (df.repartition(cores, *(by or df.columns)), cores)


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner", most: int = SMALL_ROWS) -> DataFrame:
    """Join with a table expected to be small: broadcast if it has at most ``most`` rows, checked
    here, else the ordinary join.  Keeps ``big`` in place, whatever its key distribution."""
    small = small.persist()
    return big.join(F.broadcast(small) if small.count() <= most else small, on, how)


def number_rows(df: DataFrame, name: str, order: list[str] | None = None) -> DataFrame:
    """Add a dense zero-based ``name`` in the current order of rows.

    ``order`` names columns that put the pieces of the input in order (for files: path and offset);
    without it the partition number does.  Rows are counted per piece, the counts (one row per
    piece) are summed up in order, and each row adds its place inside its piece.
    """
    place = F.monotonically_increasing_id()
    pieces = order or ["__piece"]
    df = df.withColumn("__place", place)
    if order is None:
        df = df.withColumn("__piece", F.spark_partition_id())
    counts = df.groupBy(*pieces).agg(F.count("*").alias("__n"), F.min("__place").alias("__first"))
    before = Window.orderBy(*pieces).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *pieces, "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")
    )
    out = join_small(df, offsets, pieces, most=10 * SMALL_ROWS)
    number = F.col("__before") + F.col("__place") - F.col("__first")
    drop = ["__place", "__first", "__before"] + ([] if order else ["__piece"])
    return out.withColumn(name, number.cast("long")).drop(*drop)


def number_sorted(df: DataFrame, keys: list[str], name: str, workspace) -> DataFrame:
    """Dense zero-based rank by ``keys`` (which must be unique) over any number of rows.

    Range partitions hold consecutive keys.  The partition of each row is written with it, because
    the range bounds are sampled and must not differ between the counting and the numbering pass.
    """
    parts = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__piece", F.spark_partition_id())
    stored = workspace.save(parts.withColumn("__place", F.monotonically_increasing_id()), f"sorted-{name}")
    counts = stored.groupBy("__piece").agg(F.count("*").alias("__n"), F.min("__place").alias("__first"))
    before = Window.orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "__piece", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")
    )
    number = (F.col("__before") + F.col("__place") - F.col("__first")).cast("long")
    return join_small(stored, offsets, "__piece").withColumn(name, number).drop("__piece", "__place", "__first", "__before")
