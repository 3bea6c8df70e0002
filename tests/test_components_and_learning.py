"""Components of long chains and hot nodes, hubs in blocks, and a model that a stream builds."""

import numpy as np
import pytest
from conftest import blobs
from pyspark.sql import functions as F

from maskmix.config import MixtureConfig
from maskmix.detection.probe import adjacency_blocks
from maskmix.operators import components as C
from maskmix.operators.dimensions import point_model
from maskmix.operators.moments import m_step
from maskmix.streaming.learning import StreamedModel, learn
from maskmix.workspace import Workspace


def plain_roots(links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {x: find(x) for x in parent if find(x) != x}


@pytest.mark.parametrize("kind", ["chain", "hub", "random", "none"])
@pytest.mark.parametrize("at_once", [1_000_000, 50])
def test_components(spark, monkeypatch, kind, at_once):
    rng = np.random.default_rng(3)
    order = rng.permutation(10_000)
    links = {
        "chain": list(zip(order[:-1].tolist(), order[1:].tolist())),  # far apart in the layout by id
        "hub": [(77, int(x)) for x in order[:4500]] + [(int(x), int(x) + 1) for x in range(9000, 9500)],
        "random": [tuple(map(int, p)) for p in rng.integers(0, 3000, (2000, 2))],
        "none": [],
    }[kind]
    monkeypatch.setattr(C, "LINKS_AT_ONCE", at_once)
    frame = spark.createDataFrame(links, "a long, b long").repartition(7)
    got = {r.node: r.component for r in C.component_roots(frame, Workspace(spark, "t")).collect()}
    assert got == plain_roots(links)


def test_least_reachable():
    nodes, least = C.least_reachable(np.array([5, 9, 2]), np.array([9, 7, 2]))
    assert nodes.tolist() == [2, 5, 7, 9] and least.tolist() == [2, 5, 5, 5]


def test_hubs_are_cut_into_blocks(spark):
    links = [(0, k) for k in range(1, 2001)] + [(1, 2), (2, 1), (3, 3)]
    got = adjacency_blocks(spark.createDataFrame(links, "src long, dst long"), block_neighbours=100).collect()
    hub = [r for r in got if r.channel == 0]
    assert sorted(n for r in hub for n in r.neighbours) == list(range(1, 2001))
    assert len(hub) == 20 and max(len(r.neighbours) for r in hub) < 200 and {r.degree for r in hub} == {2000}
    assert [(r.block, r.neighbours) for r in got if r.channel == 1] == [(0, [0, 2])]


def rows_of(table):
    return {r.cluster_id: (r.n, np.array(r["mean"]), np.array(r.variance), r.log_root_det) for r in table.collect()}


def same(one, two):
    assert set(one) == set(two)
    for c in one:
        assert one[c][0] == two[c][0]
        np.testing.assert_allclose(one[c][1], two[c][1], rtol=1e-9, atol=1e-12)
        np.testing.assert_allclose(one[c][2], two[c][2], rtol=1e-9, atol=1e-12)


def test_a_stream_builds_the_model_of_all_rows(spark, make_points, tmp_path):
    x, w, label = blobs(1, n=240, d=3)
    points = make_points(x, w).join(spark.createDataFrame([(i, int(c) + 1) for i, c in enumerate(label)], "point_id long, class int"), "point_id")
    config = MixtureConfig(points_for_cluster_mask=2.0)
    noise = point_model(points)
    points = points.select("x", "w", "class").repartition(6).cache()
    points.write.parquet(str(tmp_path / "in"))
    kept = StreamedModel(spark, str(tmp_path / "model"), noise, config)
    arriving = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    learn(arriving, kept, str(tmp_path / "progress"), availableNow=True).awaitTermination()
    assert kept.version() == 2
    same(rows_of(kept.table()), rows_of(m_step(points, noise, config)))
    before = rows_of(kept.table())
    kept.update(points.limit(50), 1)  # a batch that comes again
    same(rows_of(kept.table()), before)
    learn(arriving, kept, str(tmp_path / "progress"), availableNow=True).awaitTermination()
    assert kept.version() == 2
    # points without a class take the best one of the version before
    kept.update(points.drop("class").limit(60), 3)
    assert sum(n for n, *_ in rows_of(kept.table()).values()) == 300
    scored = kept.score(make_points(x, w))
    assert scored.count() == 240 and scored.where(F.col("class") > 0).count() > 0


def test_decay(spark, make_points, tmp_path):
    x, w, _ = blobs(2, n=80, d=2)
    points = make_points(x, w).withColumn("class", F.lit(1))
    noise = point_model(points)
    kept = StreamedModel(spark, str(tmp_path / "m"), noise, MixtureConfig(), decay=0.5)
    with pytest.raises(ValueError):
        kept.table()
    for batch in range(3):
        kept.update(points.where(F.col("point_id") % 3 == batch), batch)
    y = noise.kernel()(np.array(x), np.array(w))[0]
    weight = 0.5 ** (2 - np.arange(80) % 3)
    got = rows_of(kept.table())[1]
    np.testing.assert_allclose(got[1], (y * weight[:, None]).sum(axis=0) / weight.sum(), rtol=1e-9)
    assert got[0] == round(weight.sum())
    with pytest.raises(ValueError):
        StreamedModel(spark, str(tmp_path / "m"), noise, MixtureConfig(), decay=0.0)
