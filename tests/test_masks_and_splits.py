import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import Dense
from conftest import blobs
from maskmix.config import MixtureConfig
from maskmix.functions import arrays as A
from maskmix.operators.masks import distinct_masks, nearest_mask, sample_masks, start_classes, with_mask
from maskmix.operators.selection import StepOutcome
from maskmix.plans.fit import choose_subset, prepare_points, resume
from maskmix.plans.split import sub_weights, try_splits
from maskmix.workspace import Workspace


def test_nearest_mask_equals_brute_force(make_points):
    x, w, _ = blobs(1, n=80)
    masked = with_mask(make_points(x, w))
    chosen = [list(r["mask"]) for r in sample_masks(distinct_masks(masked), 6, 3).select("mask").collect()]
    assert len({tuple(c) for c in chosen}) == 6
    mask = (w == 1).astype(int)
    distance = np.array([[(m != np.array(c)).sum() for c in chosen] for m in mask])
    got = {r["point_id"]: r for r in nearest_mask(masked, chosen).collect()}
    for i in range(80):
        assert got[i]["distance"] == distance[i].min() and got[i]["class"] == distance[i].argmin() + 1
    for r in nearest_mask(masked, chosen, first_wins=False, seed=5).collect():
        assert distance[r["point_id"], r["class"] - 1] == distance[r["point_id"]].min()


def test_fewer_masks_than_starts(make_points):
    x = np.random.default_rng(0).random((30, 4))
    w = np.tile([[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 1]], (10, 1)).astype(float)
    labels, count = start_classes(make_points(x, w), 500, MixtureConfig(), seed=1)
    assert count == 4
    by_mask = {}
    for r in labels.collect():
        by_mask.setdefault(r["point_id"] % 3, set()).add(r["class"])
    assert sorted(map(tuple, by_mask.values())) == [(1,), (2,), (3,)]


def test_single_start_is_noise(make_points):
    x, w, _ = blobs(2, n=10)
    labels, count = start_classes(make_points(x, w), 1, MixtureConfig(), seed=1)
    assert count == 1 and {r["class"] for r in labels.collect()} == {0}


def test_frequent_masks_are_drawn_more_often(spark):
    rows = [(k * 1000 + i, [k]) for k in range(4) for i in range(600 if k == 0 else 20)]
    masks = distinct_masks(spark.createDataFrame(rows, "point_id long, mask array<int>")).cache()
    first = [sample_masks(masks, 1, seed).first()["mask"][0] for seed in range(40)]
    assert first.count(0) > 25


def test_subset_takes_one_point_per_stride(spark):
    points = spark.range(5, 1000, 3).select(F.col("id").alias("point_id"))
    ids = sorted(r["point_id"] for r in choose_subset(points, 7, 2, Workspace(spark)).collect())
    places = [(i - 5) // 3 for i in ids]
    assert [p // 7 for p in places] == list(range(332 // 7))
    assert len({p % 7 for p in places}) > 3


def test_portable_hash_is_spread_out(spark):
    u = spark.range(20000).select(A.portable_uniform(F.col("id"), 3).alias("u"))
    row = u.agg(F.min("u"), F.max("u"), F.avg("u"), F.stddev_pop("u")).first()
    assert row[0] > 0 and row[1] < 1
    assert row[2] == pytest.approx(0.5, abs=0.02) and row[3] == pytest.approx(math.sqrt(1 / 12), abs=0.02)


def two_blobs(n=160, d=4, seed=0):
    rng = np.random.default_rng(seed)
    side = np.arange(n) % 2
    x = rng.normal(size=(n, d)) * 0.03 + np.where(side[:, None] == 0, 0.2, 0.8)
    w = np.ones((n, d))
    for k in range(d):  # hidden cells give every dimension a noise model
        w[k::5, k] = 0.0
    return x, w, side


def split_once(make_points, make_classes, x, w, start, config):
    points = prepare_points(make_points(x, w), config)
    dense = Dense(x, w, config)
    scores = {c: dense.score(m) for c, m in dense.models(np.array(start)).items()}
    penalty = sum(dense.penalty(np.array(start)).values())
    score = sum(scores[c][i] for i, c in enumerate(start)) + penalty
    outcome = StepOutcome(None, 0, 0, score - penalty, penalty, len(set(start) | {0}))
    current = make_classes(start)
    got = try_splits(points, current, score, outcome, config, Workspace(points.frame.sparkSession))
    points.release()
    return dense, score, got


def test_accepted_split_lowers_the_total_score(spark, make_points, make_classes):
    x, w, _ = two_blobs()
    config = MixtureConfig(points_for_cluster_mask=4, split="seeded")
    dense, score, got = split_once(make_points, make_classes, x, w, [3] * 160, config)
    labels = {r["point_id"]: r["class"] for r in got.collect()}
    final = np.array([labels[i] for i in range(160)])
    assert set(final) == {1, 3}
    scores = {c: dense.score(m) for c, m in dense.models(final).items()}
    new = sum(scores[c][i] for i, c in enumerate(final)) + sum(dense.penalty(final).values())
    assert new < score


def test_one_blob_is_left_alone(make_points, make_classes):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 4))
    w = np.ones((120, 4))
    w[rng.random((120, 4)) < 0.2] = 0.0
    config = MixtureConfig(points_for_cluster_mask=4, split="seeded")
    assert split_once(make_points, make_classes, x, w, [1] * 120, config)[2] is None


def test_sliced_split_gives_the_same_classes(make_points, make_classes):
    x, w, _ = two_blobs(seed=2)
    start = [1 if i < 80 else 2 for i in range(160)]
    out = []
    for size in (512 * 1024 * 1024, 1):
        config = MixtureConfig(points_for_cluster_mask=4, split="seeded", model_broadcast_bytes=size)
        got = split_once(make_points, make_classes, x, w, start, config)[2]
        out.append(sorted(tuple(r) for r in got.collect()) if got is not None else None)
    assert out[0] is not None and out[0] == out[1]


def test_fit_with_splitting_ends_lower(make_points, make_classes):
    x, w, _ = two_blobs(seed=3)
    start = make_classes([1] * 160)
    config = MixtureConfig(points_for_cluster_mask=4, split="seeded")
    plain = resume(make_points(x, w), start, MixtureConfig(points_for_cluster_mask=4))
    split = resume(make_points(x, w), start, config)
    assert split.score < plain.score and any(m["did_split"] for m in split.metrics)
    final = {r["point_id"]: r["class"] for r in split.classes.collect()}
    assert len(final) == 160 and len(set(final.values()) - {0}) > 1


def test_sub_weights():
    config = MixtureConfig()
    weights = sub_weights({2: 10, 3: 5, 8: 4}, config)
    assert weights[2] == pytest.approx(11 / 18) and weights[3] == pytest.approx(6 / 18) and weights[8] == pytest.approx(5 / 6)
