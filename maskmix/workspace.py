"""Tables a run writes between its steps, so that no step depends on lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    application = spark.sparkContext.applicationId
    if application not in _local_roots:
        _local_roots[application] = tempfile.mkdtemp(prefix="maskmix-")
    return _local_roots[application]


class Workspace:
    """Parquet tables below one run folder."""

    def __init__(self, spark: SparkSession, name: str = "run"):
        self.spark = spark
        self.root = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"

    @classmethod
    def at(cls, spark: SparkSession, root: str) -> "Workspace":
        """Tables below a folder that is known beforehand, so that another driver finds them."""
        made = cls.__new__(cls)
        made.spark, made.root = spark, root.rstrip("/")
        return made

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def save(self, df: DataFrame, table: str) -> DataFrame:
        """Write ``df`` and return a scan of what was written."""
        df.write.mode("overwrite").parquet(self.path(table))
        return self.load(table, df.schema)

    def load(self, table: str, schema=None) -> DataFrame:
        reader = self.spark.read
        if schema is not None:
            reader = reader.schema(schema)
        return reader.parquet(self.path(table))
