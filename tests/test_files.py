import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from conftest import blobs
from maskmix.__main__ import parse
from maskmix.config import MixtureConfig
from maskmix.plans.program import cluster_files
from maskmix.sources import sinks, text
from maskmix.sources.rows import join_small, number_rows, number_sorted
from maskmix.workspace import Workspace, checkpoint_root


def put(path, lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def matrix_lines(m):
    return [str(m.shape[1])] + [" ".join(repr(float(v)) for v in row) for row in m]


def test_reads_points_and_selects_features(spark, tmp_path):
    x, w, _ = blobs(1, n=20)
    put(tmp_path / "a.fet.2", matrix_lines(x) + ["", "  "])
    put(tmp_path / "a.fmask.2", matrix_lines(w))
    base = str(tmp_path / "a")
    rows = text.read_points(spark, MixtureConfig(file_base=base, elec_no=2)).orderBy("point_id").collect()
    np.testing.assert_array_equal([r["x"] for r in rows], x)
    np.testing.assert_array_equal([r["w"] for r in rows], w)
    assert [r["point_id"] for r in rows] == list(range(20))
    dropped = text.read_features(spark, MixtureConfig(file_base=base, elec_no=2, drop_last_n_features=2))
    assert dropped.orderBy("point_id").first()["x"] == x[0, :3].tolist()
    bits = text.read_points(spark, MixtureConfig(file_base=base, elec_no=2, use_features="0101"))
    assert bits.orderBy("point_id").first()["x"] == x[0, [1, 3]].tolist()
    mask = text.read_binary_masks(spark, MixtureConfig(file_base=base, elec_no=2)).orderBy("point_id").collect()
    np.testing.assert_array_equal([r["mask"] for r in mask], (w == 1).astype(int))


def test_different_widths_are_an_error(spark, tmp_path):
    x, w, _ = blobs(2, n=4)
    put(tmp_path / "b.fet.1", matrix_lines(x))
    put(tmp_path / "b.fmask.1", matrix_lines(w[:, :4]))
    with pytest.raises(ValueError, match="features"):
        text.read_points(spark, MixtureConfig(file_base=str(tmp_path / "b")))


def test_missing_file_is_an_error(spark, tmp_path):
    with pytest.raises(AnalysisException):
        text.open_lines(spark, str(tmp_path / "none")).count()


def test_order_holds_over_many_files_and_blocks(spark, tmp_path):
    """A later file is larger, so Spark plans it first; small splits cut every file."""
    folder = tmp_path / "many"
    folder.mkdir()
    put(folder / "part-0", ["3"] + [f"{i} 0 0" for i in range(5)])
    put(folder / "part-1", [f"{i} 0 0" for i in range(5, 400)])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        frame, width = text.read_matrix(spark, str(folder))
        rows = frame.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert width == 3 and sorted((r["point_id"], r["x"][0]) for r in rows) == [(i, float(i)) for i in range(400)]


def test_labels_go_out_dense_and_come_back(spark, tmp_path):
    classes = spark.createDataFrame([(i, c) for i, c in enumerate([7, 3, 0, 7, 12])], "point_id long, class int")
    path = str(tmp_path / "c.clu.1")
    sinks.write_labels(classes, path)
    got, count = text.read_labels(spark, path)
    assert count == 4 and [r["class"] for r in got.orderBy("point_id").collect()] == [2, 1, 0, 2, 3]
    no_noise = spark.createDataFrame([(0, 5), (1, 6)], "point_id long, class int")
    assert sinks.label_count(no_noise) == 3


def test_traces_fill_samples_across_lines(spark, tmp_path):
    put(tmp_path / "t.txt", ["1 2 3", "4", "5 6 7 8"])
    rows = text.read_traces(spark, str(tmp_path / "t.txt"), 4).collect()
    assert sorted((r["sample"], r["channel"], r["v"]) for r in rows) == [(i // 4, i % 4, i + 1.0) for i in range(8)]


def test_numbering_is_dense(spark):
    frame = spark.range(0, 1000, 1, 7).where("id % 3 <> 0")
    got = number_rows(frame, "n").orderBy("id").collect()
    assert [r["n"] for r in got] == list(range(len(got)))
    shuffled = frame.repartition(5).withColumn("k", -F.col("id"))
    got = number_sorted(shuffled, ["k"], "n", Workspace(spark)).orderBy("k").collect()
    assert [r["n"] for r in got] == list(range(len(got)))


def test_small_joins_check_the_size(spark):
    big, small = spark.range(100), spark.range(10).withColumn("v", F.col("id") * 2)
    for most, broadcast in ((10, True), (9, False)):
        joined = join_small(big, small, "id", most=most)
        assert joined.count() == 10
        plan = joined._jdf.queryExecution().optimizedPlan().toString()
        assert ("broadcast" in plan) == broadcast


def test_printed_rows(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.000012345678, 123456.0])], "id long, v array<double>")
    assert sinks.printed_rows(frame, "id", "v").first()["line"] == "1 1.2346e-05 1.2346e+05 "


def test_program_writes_what_is_asked_for(spark, tmp_path):
    x, w, _ = blobs(3, n=60)
    put(tmp_path / "p.fet.1", matrix_lines(x))
    put(tmp_path / "p.fmask.1", matrix_lines(w))
    config = MixtureConfig(
        file_base=str(tmp_path / "p"), mask_starts=4, points_for_cluster_mask=4, save_sorted=True,
        save_covariance_means=True, save_temp_every_iter=True, dist_dump=True,
    )
    result = cluster_files(spark, config)
    labels, count = text.read_labels(spark, str(tmp_path / "p.clu.1"))
    assert labels.count() == 60 and count == labels.where("class > 0").select("class").distinct().count() + 1
    log = spark.read.parquet(str(tmp_path / "p.log.1"))
    assert log.count() == len(result.metrics)
    assert (tmp_path / "p.initialclusters.4.clu.1").exists() and (tmp_path / "p.mean.1").exists()
    assert (tmp_path / "p.scores.1").exists() and (tmp_path / "p.temp.clu.1").exists()
    order, _ = text.read_labels(spark, str(tmp_path / "p.sorted.clu.1"))
    masks, _ = text.read_matrix(spark, str(tmp_path / "p.sorted.mask.1"))
    rows = [tuple(r["x"]) for r in masks.orderBy("point_id").collect()]
    assert rows == sorted(rows) and order.count() == 60
    again = cluster_files(spark, config, start_labels=str(tmp_path / "p.clu.1"))
    assert again.classes.count() == 60


def test_options_become_configuration():
    config, start, journal = parse(["base", "3", "--split", "seeded", "--max-iter", "5", "--normalise", "false", "--start-labels", "s"])
    assert (config.file_base, config.elec_no, config.split, config.max_iter, config.normalise) == ("base", 3, "seeded", 5, False)
    assert start == "s"


def test_mask_starts_override_the_cluster_range():
    assert list(MixtureConfig().starting_clusters()) == [500]
    assert list(MixtureConfig(mask_starts=0).starting_clusters()) == list(range(100, 111))


class FakeSession:
    """As much of a session as the folder lookup reads."""

    def __init__(self, master, named=None):
        self.master, self.named, self.applicationId = master, named, f"app-{master}-{named}"
        self.sparkContext = self.conf = self

    def get(self, *_):
        return self.named

    def getCheckpointDir(self):
        return None


def test_checkpoint_folder_comes_from_the_session():
    assert checkpoint_root(FakeSession("yarn", "hdfs://shared/folder/")) == "hdfs://shared/folder"
    local = FakeSession("local[2]")
    assert checkpoint_root(local) == checkpoint_root(local)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_root(FakeSession("yarn"))


def test_workspace_tables(spark):
    space = Workspace(spark, "x")
    assert space.root.startswith(checkpoint_root(spark))
    assert space.save(spark.range(3), "t").count() == 3


def test_lengths_that_differ_raise(spark, tmp_path):
    from maskmix.config import MixtureConfig
    from maskmix.sources import text

    base = tmp_path / "e"

    def write(kind, rows):
        (tmp_path / f"e.{kind}.1").write_text("2\n" + "\n".join(rows) + "\n")

    config = MixtureConfig(file_base=str(base))
    write("fet", ["1 2", "3 4", "5 6"])
    write("fmask", ["1 0", "1 1"])
    with pytest.raises(Exception, match="differ in length"):
        text.read_points(spark, config).collect()
    write("fmask", ["1 0", "1", "0 0"])
    with pytest.raises(Exception, match="does not have 2 values"):
        text.read_points(spark, config).collect()
    write("fmask", ["1 0", "1 1", "0 0"])
    assert text.read_points(spark, config).count() == 3


def test_part_files_in_order_of_their_number(spark, tmp_path):
    from maskmix.sources import text

    for number, row in ((0, "1\n0"), (10001, "1"), (99999, "2"), (100000, "3"), (100001, "4")):
        (tmp_path / f"part-{number:05d}-x.txt").write_text(f"{row}\n")
    rows, width = text.read_matrix(spark, str(tmp_path))
    assert width == 1 and [r.x[0] for r in rows.orderBy("point_id").collect()] == [0, 1, 2, 3, 4]
