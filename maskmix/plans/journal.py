"""A record of a running fit, from which another driver goes on after the last finished iteration.

Below one folder lie the tables of the fit and ``records``: one row per finished iteration, appended when its
assignment table is complete, and one per finished run.  An iteration writes the slot that the record before it
does not name, so whatever a lost driver left half written is never read.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from maskmix.config import MixtureConfig
from maskmix.workspace import Workspace

RECORDS = "run INT, iteration INT, finished BOOLEAN, points BIGINT, config STRING, state STRING"


class Journal:
    def __init__(self, spark: SparkSession, path: str, config: MixtureConfig, n_points: int):
        self.spark, self.path, self.n_points = spark, path.rstrip("/"), n_points
        self.config = repr(config)
        self.workspace = Workspace.at(spark, f"{self.path}/tables")
        self.records: dict[int, dict[int, dict]] = {}
        self.finished: dict[int, dict] = {}
        for r in self._read():
            if (r["config"], r["points"]) != (self.config, n_points):
                raise ValueError(f"{path} is the journal of a fit of {r['points']} points with {r['config']}")
            state = json.loads(r["state"])
            if r["finished"]:
                self.finished[r["run"]] = state
            else:
                self.records.setdefault(r["run"], {})[r["iteration"]] = state

    def _read(self) -> list:
        try:
            return self.spark.read.schema(RECORDS).parquet(f"{self.path}/records").collect()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    def _append(self, run: int, iteration: int, finished: bool, state: dict) -> None:
        row = (run, iteration, finished, self.n_points, self.config, json.dumps(state))
        self.spark.createDataFrame([row], RECORDS).coalesce(1).write.mode("append").parquet(f"{self.path}/records")

    def commit(self, run: int, iteration: int, state: dict) -> None:
        """``state`` is all that the next iteration needs beside the tables it names."""
        self._append(run, iteration, False, state)
        self.records.setdefault(run, {})[iteration] = state

    def finish(self, run: int, state: dict) -> None:
        self._append(run, -1, True, state)
        self.finished[run] = state

    def last(self, run: int) -> dict | None:
        """State after the last finished iteration of a run, with the metrics of all of them; None before the first."""
        known = self.records.get(run)
        if not known:
            return None
        return known[max(known)] | {"metrics": [known[i]["metric"] for i in sorted(known)]}
