import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from brute import Dense
from conftest import blobs
from maskmix.config import MixtureConfig
from maskmix.functions import kernels as K
from maskmix.operators.dimensions import dimension_model, mask_expectation, point_model
from maskmix.operators.moments import m_step, mixing_weights, moment_cells
from maskmix.operators.scoring import assign, own_scores, read_model, score_matrix
from maskmix.operators.selection import classical_penalty, conclude, deletion_candidate
from maskmix.plans.fit import expectation_maximisation, fit, is_full_step, prepare_points, resume, wants_split
from maskmix.workspace import Workspace


def prepare(points):
    """Points as the model steps take them, and their dimension model."""
    return points, point_model(points)


def expected(points):
    model = point_model(points)
    return mask_expectation(points, model), model


def values(frame, *columns, key="point_id"):
    rows = frame.orderBy(key).select(*columns).collect()
    return [np.array(c) for c in zip(*rows)]


def check_run(make_points, make_classes, x, w, start, config):
    result = resume(make_points(x, w), make_classes(start), config)
    classes, log = Dense(x, w, config).run(start)
    assert [m["deleted"] for m in result.metrics] == [g for g, *_ in log]
    assert [m["changed"] for m in result.metrics] == [c for _, c, *_ in log]
    np.testing.assert_allclose([m["raw"] for m in result.metrics], [r for *_, r, _ in log], rtol=1e-8, atol=1e-6)
    np.testing.assert_allclose([m["penalty"] for m in result.metrics], [p for *_, p in log], rtol=1e-9)
    (got,) = values(result.classes, "class")
    np.testing.assert_array_equal(got, classes)
    return result


@pytest.mark.parametrize("seed,scale,mask_points", [(0, True, 10.0), (1, False, 3.0), (2, True, math.inf), (3, True, 0.0)])
def test_loop_equals_dense_version(make_points, make_classes, seed, scale, mask_points):
    x, w, _ = blobs(seed)
    start = np.random.default_rng(seed).integers(0, 5, len(x))
    config = MixtureConfig(normalise=scale, points_for_cluster_mask=mask_points)
    check_run(make_points, make_classes, x, w, start, config)


def test_loop_with_other_prior_and_penalty(make_points, make_classes):
    x, w, label = blobs(5, n=70)
    config = MixtureConfig(prior_point=3.0, penalty_k=0.5, penalty_k_log_n=0.25, points_for_cluster_mask=5)
    check_run(make_points, make_classes, x, w, label + 1, config)


def test_full_masks_need_no_correction(make_points):
    x, _, _ = blobs(3)
    frame, noise = expected(make_points(x, np.ones_like(x)))
    assert noise.noise_mean == [0.0] * 5 and noise.noise_variance == [0.0] * 5 and noise.n_masked == [0] * 5
    (corr,) = values(frame, "corr")
    np.testing.assert_allclose(corr, 0, atol=1e-12)


def test_hidden_points_equal_noise(make_points, make_classes):
    x, _, _ = blobs(4, n=30)
    frame, noise = expected(make_points(x, np.zeros_like(x)))
    y, corr = values(frame, "y", "corr")
    np.testing.assert_allclose(y, np.tile(noise.noise_mean, (30, 1)))
    np.testing.assert_allclose(corr, np.tile(noise.noise_variance, (30, 1)), atol=1e-12)
    check_run(make_points, make_classes, x, np.zeros_like(x), [1] * 15 + [2] * 15, MixtureConfig())


def test_constant_dimension_scales_to_zero(make_points):
    x, w, _ = blobs(6)
    x[:, 2] = 7.0
    frame, noise = expected(make_points(x, w))
    (y,) = values(frame, "y")
    assert noise.noise_variance[2] == 0 and not y[:, 2].any()


def test_singular_cluster_takes_no_part(make_points, make_classes):
    """A constant dimension without noise variance leaves every covariance singular: all is noise."""
    x, _, label = blobs(6, n=40)
    x[:, 1] = 3.0
    result = check_run(make_points, make_classes, x, np.ones_like(x), label + 1, MixtureConfig())
    assert result.model is not None and {r["class"] for r in result.classes.collect()} == {0}


def test_one_point_cluster_and_no_noise_points(make_points, make_classes):
    x, w, label = blobs(8)
    start = label + 1
    start[0] = 9
    check_run(make_points, make_classes, x, w, start, MixtureConfig(points_for_cluster_mask=4))


def test_result_does_not_depend_on_partitions_or_order(make_points, make_classes):
    x, w, label = blobs(9)
    scores = set()
    for parts in (1, 2, 7):
        result = resume(make_points(x, w, parts), make_classes(label + 1), MixtureConfig(points_for_cluster_mask=4))
        scores.add(round(result.score, 6))
    assert len(scores) == 1


def test_sliced_model_gives_the_same_classes(spark, make_points, make_classes):
    x, w, _ = blobs(10, n=120, groups=4)
    start = np.arange(120) % 7
    whole, small = MixtureConfig(points_for_cluster_mask=4), MixtureConfig(points_for_cluster_mask=4, model_broadcast_bytes=1)
    frame, noise = prepare(make_points(x, w))
    frame = frame.join(make_classes(start), "point_id").cache()
    columns = ["old_class", "class", "class2", "nlp", "nlp2"]
    one = read_model(m_step(frame, noise, whole), 5, whole)
    many = read_model(m_step(frame, noise, small), 5, small, Workspace(spark))
    assert len(one.slices) == 1 and len(many.slices) == 6
    a = values(assign(frame, one, noise, whole), *columns)
    b = values(assign(frame, many, noise, small), *columns)
    for left, right in zip(a, b):
        np.testing.assert_allclose(left, right)
    sums = [
        {r["class"]: r["nlp"] for r in own_scores(frame, m, noise, c).collect()} for m, c in ((one, whole), (many, small))
    ]
    assert sums[0].keys() == sums[1].keys()
    np.testing.assert_allclose(list(sums[0].values()), [sums[1][k] for k in sums[0]])


def test_score_matrix_and_own_scores_agree(make_points, make_classes):
    x, w, label = blobs(11)
    config = MixtureConfig(points_for_cluster_mask=4)
    frame, noise = prepare(make_points(x, w))
    frame = frame.join(make_classes(label), "point_id").cache()
    model = read_model(m_step(frame, noise, config), 5, config)
    dense = Dense(x, w, config)
    want = {c: dense.score(m) for c, m in dense.models(label).items()}
    for r in score_matrix(frame, model, noise, config).collect():
        assert r["nlp"] == pytest.approx(want[r["cluster_id"]][r["point_id"]], rel=1e-8, abs=1e-8)
    for r in own_scores(frame, model, noise, config).collect():
        shift = math.log(model.weights[r["class"]]) * r["n"]
        assert r["nlp"] == pytest.approx(want[r["class"]][label == r["class"]].sum() + shift, rel=1e-8)


def test_no_noise_assignment_and_overlap_floor(make_points, make_classes):
    x, w, label = blobs(12)
    frame, noise = prepare(make_points(x, w))
    frame = frame.join(make_classes(label), "point_id").cache()
    config = MixtureConfig(points_for_cluster_mask=4)
    model = read_model(m_step(frame, noise, config), 5, config)
    c, c2 = values(assign(frame, model, noise, config, allow_noise=False), "class", "class2")
    assert set(c) <= {1, 2} and not (c == c2).any()
    strict = MixtureConfig(points_for_cluster_mask=4, min_mask_overlap=2.0)
    (c,) = values(assign(frame, model, noise, strict, allow_noise=False), "class")
    dense = Dense(x, w, config)
    free = {k: dense.w[label == k].sum(axis=0) >= 4 for k in (1, 2)}
    near = np.stack([dense.w[:, free[k]].sum(axis=1) >= 2.0 for k in (1, 2)], axis=1)
    assert (c[~near.any(axis=1)] == 0).all() and all(near[i, k - 1] for i, k in enumerate(c) if k)


def test_maximum_iterations_stop_the_loop(make_points, make_classes):
    x, w, label = blobs(13)
    result = resume(make_points(x, w), make_classes(label + 1), MixtureConfig(max_iter=0))
    assert len(result.metrics) == 1


def test_fit_and_subset_fit_cover_every_point(make_points):
    x, w, _ = blobs(14, n=200)
    points = make_points(x, w)
    result = fit(points, MixtureConfig(mask_starts=4, n_starts=2, points_for_cluster_mask=4))
    assert result.classes.count() == 200 and {m["run"] for m in result.metrics} == {0, 1}
    by_run = {}
    for m in result.metrics:
        by_run[m["run"]] = m["score"]
    assert result.score == min(by_run.values())
    part = fit(points, MixtureConfig(mask_starts=4, subset=3, points_for_cluster_mask=4))
    assert part.classes.select("point_id").distinct().count() == 200


def test_classical_penalty():
    config = MixtureConfig(penalty_k=1.0)
    assert classical_penalty(3, 1, 50, config) == 0
    assert classical_penalty(3, 4, 50, config) == pytest.approx(30 + 30 * math.log(50) / 2)


def test_full_step_and_split_schedule():
    config = MixtureConfig(split="seeded")
    assert is_full_step(0, 100, 7, 1.0, 2.0, config) and is_full_step(6, 100, 7, 1.0, 2.0, config)
    assert is_full_step(3, 100, 20, 1.0, 2.0, config) and is_full_step(3, 100, 7, 3.0, 2.0, config)
    assert not is_full_step(3, 100, 7, 1.0, 2.0, config)
    assert [i for i in range(1, 150) if wants_split(i, 5, True, config)] == [20, 59, 99, 139]
    assert wants_split(3, 0, True, config) and not wants_split(3, 0, False, config)
    assert not wants_split(20, 0, True, MixtureConfig())


def test_deletion_picks_the_lowest_id_on_a_tie():
    config = MixtureConfig()
    row = {"n": 5, "params": 2.0, "nlp": 1.0, "changed": 0}
    rows = [row | {"class": c, "loss": loss} for c, loss in ((3, 1.0), (2, 1.0), (1, 9.0), (0, 0.0))]
    assert deletion_candidate(rows, {0, 1, 2, 3}, 100, config) == 2
    assert deletion_candidate([r | {"loss": 50.0} for r in rows], {0, 1, 2, 3}, 100, config) is None


def test_empty_alive_cluster_is_not_deleted():
    rows = [{"class": 0, "n": 5, "params": 2.0, "nlp": 1.0, "loss": 1.0, "changed": 0}]
    assert deletion_candidate(rows, {0, 1}, 100, MixtureConfig()) is None


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.integers(0, 30), st.integers(1, 1000), min_size=1), st.floats(0.5, 5))
def test_weights_sum_to_one(counts, prior):
    weights = mixing_weights(counts, sum(counts.values()), MixtureConfig(prior_point=prior))
    assert sum(weights.values()) == pytest.approx(1) and weights[0] > 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 6), st.integers(1, 20))
def test_two_lowest_equals_sorting(seed, clusters, n):
    rng = np.random.default_rng(seed)
    scores = rng.integers(0, 4, (n, clusters)).astype(float)
    scores[rng.random((n, clusters)) < 0.1] = np.nan
    ids = np.sort(rng.choice(50, clusters, replace=False))
    c1, v1, c2, v2 = K.two_lowest(scores, ids, 1e30)
    for i in range(n):
        order = sorted((s, c) for s, c in zip(scores[i], ids) if not math.isnan(s))
        want = [c for _, c in order] + [-1, -1]
        assert [c1[i], c2[i]] == want[:2]


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 4), st.integers(1, 5))
def test_moment_sums_equal_direct_sums(seed, classes, batches):
    rng = np.random.default_rng(seed)
    d = 6
    sums, rows = K.MomentSums(d, True), []
    for _ in range(batches):
        n = int(rng.integers(1, 9))
        c = rng.integers(0, classes, n)
        r = rng.normal(size=(n, d)) * (rng.random((n, d)) < 0.5)
        w, e = rng.random((n, d)), rng.random((n, d))
        sums.add(c, r, w, e)
        rows += list(zip(c, r, w, e))
    table = pa.Table.from_batches(list(sums.cells())).to_pandas()
    key, p = table["cell"], 2**K.POSITION_BITS
    table = table.assign(i=(key // p) % p - 1, j=key % p - 1, stat=(key // p**2) % 8)
    table["class"] = key // (8 * p**2)
    for c in set(int(row[0]) for row in rows):
        mine = [row for row in rows if row[0] == c]
        r = np.array([row[1] for row in mine])
        part = table[table["class"] == c]
        gram = np.zeros((d, d))
        cells = part[part["stat"] == K.GRAM]
        gram[cells["i"], cells["j"]] = cells["v"]
        np.testing.assert_allclose(np.triu(r.T @ r), gram, atol=1e-12)
        assert part[part["stat"] == K.COUNT]["v"].item() == len(mine)
        np.testing.assert_allclose(part[part["stat"] == K.SUM_CORR]["v"], np.sum([row[3] for row in mine], axis=0))


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 5))
def test_factor_equals_dense_inverse(seed, u):
    rng = np.random.default_rng(seed)
    d = 5
    unmasked = np.sort(rng.choice(d, u, replace=False))
    root = rng.normal(size=(u, u))
    block, diagonal = root @ root.T + 0.1 * np.eye(u), rng.random(d) + 0.1
    full = np.diag(diagonal)
    full[np.ix_(unmasked, unmasked)] = block
    factor = K.factorise(unmasked, block, diagonal)
    assert factor.ok
    np.testing.assert_allclose(factor.inv_diag, np.diag(np.linalg.inv(full)), rtol=1e-6)
    assert factor.log_root_det == pytest.approx(np.linalg.slogdet(full)[1] / 2)


def test_factor_reports_failure():
    assert not K.factorise(np.array([0, 1]), np.array([[1.0, 2.0], [2.0, 1.0]]), np.ones(3)).ok
    assert not K.factorise(np.array([0]), np.array([[1.0]]), np.array([1.0, 0.0])).ok
    assert not K.factorise(np.array([0]), np.array([[np.nan]]), np.ones(2)).ok


def test_moments_survive_an_early_flush(make_points, make_classes, monkeypatch):
    x, w, label = blobs(15)
    frame, noise = prepare(make_points(x, w))
    frame = frame.join(make_classes(label), "point_id")
    rows = lambda: sorted(map(tuple, moment_cells(frame, noise).collect()))
    normal = rows()
    monkeypatch.setattr(K, "FLUSH_BYTES", 1)
    for a, b in zip(normal, rows()):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4])


def test_fewer_moment_tasks_give_the_same_cells(make_points, make_classes):
    x, w, label = blobs(19)
    frame, noise = prepare(make_points(x, w, 7))
    frame = frame.join(make_classes(label), "point_id")
    many, few = (sorted(map(tuple, moment_cells(frame, noise, tasks=t).collect())) for t in (None, 2))
    assert [c[:4] for c in many] == [c[:4] for c in few]
    np.testing.assert_allclose([c[4] for c in many], [c[4] for c in few])


def test_dimension_model_matches_numpy(make_points):
    x, w, _ = blobs(16)
    got = dimension_model(make_points(x, w))
    dense = Dense(x, w, MixtureConfig(normalise=False))
    np.testing.assert_allclose(got.noise_mean, dense.nu)
    np.testing.assert_allclose(got.noise_variance, dense.s2)
    assert got.n_masked == (w != 1).sum(axis=0).tolist()


def test_loop_joins_without_moving_points(make_points, make_classes):
    """Only the class table is exchanged when classes meet the laid-out points."""
    from maskmix.plans.fit import with_class

    x, w, label = blobs(17)
    points = prepare_points(make_points(x, w), MixtureConfig())
    plan = with_class(points, make_classes(label))._jdf.queryExecution().executedPlan().toString()
    before_cache = plan.split("InMemoryRelation")[0]
    assert "ShuffledHashJoin" in plan and "Exchange" not in before_cache.split("InMemoryTableScan")[0]
    points.release()


def test_conclude_counts_moves(spark):
    rows = [(i, 1, 1 + i % 2, 0, 1.0, 100.0, 2.0) for i in range(10)]
    frame = spark.createDataFrame(rows, "point_id long, old_class int, class int, class2 int, nlp double, nlp2 double, q double")
    out = conclude(frame, {0, 1, 2}, 10, MixtureConfig())
    assert out.deleted is None and out.changed == 5 and out.raw == 10.0
    assert frame.agg(F.sum("nlp")).first()[0] == out.raw


def test_one_cluster_start_is_all_noise(spark, make_points):
    x, w, _ = blobs(18)
    prepared = prepare_points(make_points(x, w), MixtureConfig())
    start = prepared.frame.select("point_id", F.lit(0).alias("class"))
    result = expectation_maximisation(prepared, start, MixtureConfig(), Workspace(spark))
    assert {r["class"] for r in result.classes.collect()} == {0}
    prepared.release()


def test_labels_must_cover_the_points_and_fit_the_limit(spark, make_points, make_classes):
    x, w, label = blobs(seed=4, n=40)
    points = make_points(x, w)
    with pytest.raises(ValueError, match="39 labels for 40 points"):
        resume(points, make_classes(label + 1).where("point_id > 0"))
    with pytest.raises(ValueError, match="labels for 40 points"):
        resume(points, make_classes(label + 1).union(make_classes(label + 1).limit(1)))
    with pytest.raises(ValueError, match="max_possible_clusters"):
        resume(points, make_classes(np.arange(40)), MixtureConfig(max_possible_clusters=5))


def test_large_class_ids_keep_their_name(spark, make_points, make_classes):
    x, w, label = blobs(seed=4, n=60)
    points = make_points(x, w)
    small = {r.point_id: r["class"] for r in resume(points, make_classes(label + 1), MixtureConfig(max_iter=0)).classes.collect()}
    big = {r.point_id: r["class"] for r in resume(points, make_classes((label + 1) * 2**21), MixtureConfig(max_iter=0)).classes.collect()}
    assert big == {i: c * 2**21 for i, c in small.items()}
