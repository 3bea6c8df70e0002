"""Tables arrive whole as streams, as one file or as a folder of part files."""

import pytest

from maskmix.queries import stream


@pytest.mark.parametrize("parts", [1, 3])
def test_a_table_of_files_streams_whole(spark, tmp_path, parts):
    rows = spark.createDataFrame([(k, float(k)) for k in range(30)], "event_id long, value double")
    folder = str(tmp_path / "sf")
    rows.repartition(parts, "event_id").write.parquet(f"{folder}/events.parquet")
    rows.write.parquet(f"{folder}/other_events.parquet")
    ws = stream.Q.Workspace(spark, "test")
    found = stream._drain(stream._stream(spark, folder, "events"), ws)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, rows.collect()))


def test_a_table_of_one_file_streams_whole(spark):
    folder = "/root/testdata/sf0.001"
    found = stream._drain(stream._stream(spark, folder, "events"), stream.Q.Workspace(spark, "test"))
    assert found.count() == spark.read.parquet(f"{folder}/events.parquet").count() > 0
