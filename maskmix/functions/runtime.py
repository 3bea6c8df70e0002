"""Running the package's Arrow helpers on executors."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Rows a step gets at once; Spark sends up to 10,000, and a step holds several arrays of as many rows.
BATCH_ROWS = 2048

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="maskmix-package-")) / package.name
    archive = shutil.make_archive(str(target), "zip", package.parent, package.name)
    spark.sparkContext.addPyFile(archive)
    _shipped.add(application)


def in_pieces(batches):
    """The same rows in batches of at most ``BATCH_ROWS``; a piece is a view, not a copy."""
    for batch in batches:
        for at in range(0, max(1, batch.num_rows), BATCH_ROWS):
            yield batch.slice(at, BATCH_ROWS)


def map_arrow(df: DataFrame, step, schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with the package available to the workers and a bound on the rows of a batch."""
    ship_package(df.sparkSession)
    return df.mapInArrow(lambda batches: step(in_pieces(batches)), schema)


def apply_arrow(df: DataFrame, keys: list[str], step, schema: str) -> DataFrame:
    """``applyInArrow`` per group; callers keep every group bounded."""
    ship_package(df.sparkSession)
    return df.groupBy(*keys).applyInArrow(step, schema)
