"""A mixture model that a stream keeps up to date.

The model is what follows from packed moment cells.  A micro-batch adds its own cells to those kept, which are
multiplied by ``decay`` first; the sums are written as a new version, and one appended record makes it the latest.
A batch that is delivered again finds its record and changes nothing; one that was lost before its record is
computed again from the version before it.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from maskmix.config import MixtureConfig
from maskmix.operators.dimensions import DimensionModel
from maskmix.operators.moments import model_of_cells, packed_cells, summed
from maskmix.operators.scoring import MixtureModel, assign, read_model
from maskmix.workspace import Workspace

RECORDS = "batch BIGINT, points BIGINT"


class StreamedModel:
    """Versions of a model below ``path``; the noise model and the scaling of values stay as given."""

    def __init__(self, spark: SparkSession, path: str, noise: DimensionModel, config: MixtureConfig, decay: float = 1.0):
        if not 0 < decay <= 1:
            raise ValueError(f"decay is above 0 and at most 1, not {decay}")
        self.spark, self.noise, self.config, self.decay = spark, noise, config, decay
        self.workspace = Workspace.at(spark, path)

    def _records(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(RECORDS).parquet(self.workspace.path("records"))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def version(self) -> int | None:
        """The last batch whose points are in the model."""
        records = self._records()
        return None if records is None else records.agg(F.max("batch")).first()[0]

    def cells(self) -> DataFrame | None:
        version = self.version()
        return None if version is None else self.workspace.load(f"cells-{version}")

    def table(self) -> DataFrame:
        """One row per class, as an M-step gives."""
        cells = self.cells()
        if cells is None:
            raise ValueError(f"no version of a model below {self.workspace.root}")
        return model_of_cells(cells, self.noise, self.config)

    def model(self) -> MixtureModel:
        return read_model(self.table(), self.noise.dims, self.config, self.workspace, f"model-{self.version()}")

    def update(self, batch: DataFrame, batch_id: int) -> None:
        """Add ``(x, w)`` with their ``class``; without that column points take their best class first."""
        known = self.version()
        if known is not None and batch_id <= known:
            return
        if "class" not in batch.columns:
            points = batch.withColumn("point_id", F.monotonically_increasing_id()).withColumn("class", F.lit(0))
            points = self.workspace.save(points.select("point_id", "class", "x", "w"), f"points-{batch_id}")
            model = self.model()
            best = self.workspace.save(assign(points, model, self.noise, self.config).select("point_id", "class"), f"best-{batch_id}")
            model.release()
            batch = points.drop("class").join(best, "point_id")
        new = packed_cells(batch.select(F.col("class").cast("int"), "x", "w"), self.noise)
        if known is not None:
            old = self.workspace.load(f"cells-{known}").withColumn("v", F.col("v") * F.lit(self.decay))
            new = summed(old.unionByName(new))
        self.workspace.save(new, f"cells-{batch_id}")
        record = self.spark.createDataFrame([(batch_id, batch.count())], RECORDS)
        record.coalesce(1).write.mode("append").parquet(self.workspace.path("records"))

    def score(self, points: DataFrame) -> DataFrame:
        """Class of every ``(point_id, x, w)`` under the latest version."""
        return assign(points.select("point_id", "x", "w").withColumn("class", F.lit(0)), self.model(), self.noise, self.config).drop("old_class")


def learn(stream: DataFrame, model: StreamedModel, checkpoint: str, **trigger) -> StreamingQuery:
    """Start updating ``model`` from a stream of ``(x, w)`` or ``(x, w, class)``."""
    return stream.writeStream.foreachBatch(model.update).option("checkpointLocation", checkpoint).trigger(**trigger).start()
