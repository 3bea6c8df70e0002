import numpy as np
import pytest
from pyspark.sql import functions as F

from maskmix.detection import traces as T
from maskmix.detection.config import DetectionConfig
from maskmix.streaming.detection import detect_stream
from maskmix.workspace import Workspace

RATE, CHANNELS, SAMPLES = 2000.0, 6, 700
CONFIG = DetectionConfig(chunk_size_seconds=0.05, detect_spikes_symbol=0)
SCHEMA = "shank long, ts timestamp, sample long, channel int, v double, note string"


def recording(seed):
    rng = np.random.default_rng(seed)
    grid = rng.normal(size=(SAMPLES, CHANNELS))
    grid[100:103, 2] += 6
    grid[398:402, 1:4] -= 5  # across the borders of most batches
    turn = 0.7 * np.pi * np.arange(200)  # a component longer than a batch
    grid[300:500, 4] += 8 * np.cos(turn)
    grid[300:500, 5] += 8 * np.sin(turn)
    grid[640:] = 0
    return grid


@pytest.fixture(scope="module")
def expected(spark):
    """Thresholds, and crossings and spikes of the table version, by shank."""
    line = spark.createDataFrame([(c, c + 1) for c in range(CHANNELS - 1)], "src int, dst int")
    limits = spark.createDataFrame([(1.0, 1.6)], "weak double, strong double")
    crossings, found = set(), set()
    for shank in (0, 1):
        rows = [(s, c, float(v)) for s, line_ in enumerate(recording(shank)) for c, v in enumerate(line_)]
        traces = spark.createDataFrame(rows, "sample long, channel int, v double")
        weak = T.crossings(T.band_pass(traces, CONFIG, RATE), limits, CONFIG)
        labelled = T.label_crossings(weak, line, CONFIG, CHANNELS, Workspace(spark))
        crossings |= {(shank, r["sample"], r["channel"], r["strong"], round(r["v"], 6)) for r in labelled.collect()}
        spikes = T.spikes(labelled, CONFIG).collect()
        found |= {(shank, r["component"], r["sample"], r["channel"], r["n"]) for r in spikes}
    assert len(found) > 10 and max(n for *_, n in found) > 200
    return line, limits, crossings, found


def write(spark, folder, batches, seed=0):
    """One file per batch; samples of a batch change places with those of the next one."""
    rng = np.random.default_rng(seed)
    place = np.arange(SAMPLES) + rng.integers(-15, 16, SAMPLES)
    order = np.argsort(place, kind="stable")
    for at, some in enumerate(np.array_split(order, batches)):
        rows = [(k, int(s), c, float(recording(k)[s, c])) for k in (0, 1) for s in some.tolist() for c in range(CHANNELS)]
        rows = [rows[i] for i in rng.permutation(len(rows))]
        df = spark.createDataFrame(rows, "shank long, sample long, channel int, v double")
        ts = F.timestamp_micros(F.lit(1_000_000_000_000_000) + F.col("sample") * 500)
        df = df.select("shank", ts.alias("ts"), "sample", "channel", "v", F.lit("x").alias("note"))
        if at == 0:
            df = df.unionByName(spark.createDataFrame([(0, None, 3, 1, 9.0, None), (1, None, None, 77, None, None)], SCHEMA))
        df.coalesce(1).write.mode("append").parquet(folder)
        yield at


def run(spark, ws, line, limits, files):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(ws.path("in"))
    found = detect_stream(stream, ["shank"], line, limits, CONFIG, RATE, CHANNELS, "20 milliseconds")
    query = (
        found.writeStream.format("parquet").option("path", ws.path("out")).option("checkpointLocation", ws.path("progress"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return found.schema


@pytest.mark.parametrize("batches, files, restarts", [(1, 1, False), (6, 1, False), (9, 2, False), (5, 1, True)])
def test_stream_equals_table(spark, expected, batches, files, restarts):
    line, limits, crossings, found = expected
    ws = Workspace(spark, "stream-detection")
    for _ in write(spark, ws.path("in"), batches, batches):
        if restarts:
            schema = run(spark, ws, line, limits, files)
    if not restarts:
        schema = run(spark, ws, line, limits, files)
    rows = ws.load("out", schema).collect()
    got = [(r["shank"], r["sample"], r["channel"], r["strong"], round(r["v"], 6)) for r in rows if r["kind"] == "crossing"]
    assert len(got) == len(set(got)) and set(got) == crossings
    spikes = [(r["shank"], r["component"], r["sample"], r["channel"], r["n"]) for r in rows if r["kind"] == "spike"]
    assert len(spikes) == len(set(spikes)) and set(spikes) == found
