"""Differences and bounds change what is read and scored, never what comes out."""

from dataclasses import replace

import numpy as np
import pytest
from conftest import blobs

from maskmix.config import MixtureConfig
from maskmix.functions import kernels as K
from maskmix.operators.bounds import cluster_drift
from maskmix.plans.fit import resume

PLAIN = MixtureConfig(bounded_steps=False, differences="never", points_for_cluster_mask=2.0, penalty_k_log_n=0.3)


def run(points, start, config):
    result = resume(points, start, config)
    return dict((r.point_id, r["class"]) for r in result.classes.collect()), result


@pytest.mark.parametrize("seed,groups,normalise", [(1, 5, True), (2, 4, False)])
def test_same_fit_in_every_way(make_points, make_classes, seed, groups, normalise):
    x, w, label = blobs(seed, n=400, d=4, groups=groups, spread=0.08)
    w = np.maximum(w, 0.2)
    rng = np.random.default_rng(seed + 50)
    start = make_classes(np.where(rng.random(400) < 0.3, rng.integers(1, 2 * groups, 400), label + 1))
    points = make_points(x, w)
    plain = replace(PLAIN, normalise=normalise)
    want, slow = run(points, start, plain)
    clusters = [m["scored"] // 400 for m in slow.metrics]
    assert len(slow.metrics) > 3
    for config in (
        replace(plain, bounded_steps=True),
        replace(plain, differences="always"),
        replace(plain, differences="always", bounded_steps=True, recount_every=2),
        replace(plain, differences="auto", bounded_steps=True),
    ):
        got, fast = run(points, start, config)
        assert got == want
        assert len(fast.metrics) == len(slow.metrics)
        for a, b in zip(fast.metrics, slow.metrics):
            assert [a[k] for k in ("step", "alive", "deleted", "changed")] == [b[k] for k in ("step", "alive", "deleted", "changed")]
            assert a["score"] == pytest.approx(b["score"], rel=1e-9, abs=1e-6)
        if config.bounded_steps:
            assert all(a["scored"] <= 400 * max(k, 2) for a, k in zip(fast.metrics, clusters))
            assert fast.metrics[-1]["scored"] < slow.metrics[-1]["scored"] or clusters[-1] <= 2
        if config.differences == "always" and config.recount_every > 5:
            for one, nxt in zip(fast.metrics, fast.metrics[1:]):
                assert nxt["moment_points"] == one["changed"]


def random_cluster(rng, d, c):
    unmasked = np.flatnonzero(rng.random(d) < 0.6)
    root = rng.normal(size=(len(unmasked), len(unmasked)))
    diagonal = rng.random(d) + 0.1
    factor = K.factorise(unmasked, root @ root.T + np.eye(len(unmasked)), diagonal)
    return {
        "cluster_id": c, "mean": rng.normal(size=d), "unmasked": unmasked, "weight": rng.random() + 0.01,
        "root_inverse": factor.root_inverse.ravel(), "inv_diag": factor.inv_diag, "log_root_det": factor.log_root_det,
    }


@pytest.mark.parametrize("seed", range(5))
@pytest.mark.parametrize("eigen", [256, 0])
def test_drift_bounds_every_fall(monkeypatch, seed, eigen):
    from maskmix.operators import bounds

    monkeypatch.setattr(bounds, "EIGEN_DIMS", eigen)
    rng, d = np.random.default_rng(seed), 6
    nu = rng.normal(size=d)
    for _ in range(20):
        old, new = random_cluster(rng, d, 1), random_cluster(rng, d, 1)
        y, corr = rng.normal(size=(200, d)) * rng.random() * 5, rng.random((200, d))
        fall = K.Scorer([old], nu).scores(y, corr)[:, 0] - K.Scorer([new], nu).scores(y, corr)[:, 0]
        a, b, c, s = cluster_drift(old, new, nu)
        r = np.linalg.norm(y - nu, axis=1)
        assert (fall <= (a * r**2 + b * r + c + s * corr.sum(axis=1)) * (1 + 1e-9) + 1e-7).all()
        assert max(cluster_drift(old, old, nu)) == 0.0


def test_own_scores_equal_the_matrix():
    rng, d = np.random.default_rng(9), 7
    nu = rng.normal(size=d)
    scorer = K.Scorer([random_cluster(rng, d, c) for c in (2, 5, 9)], nu)
    y, corr = rng.normal(size=(50, d)), rng.random((50, d))
    ids = rng.choice([0, 2, 5, 9], 50)
    whole = np.concatenate([np.full((50, 1), 3.5), scorer.scores(y, corr)], axis=1)
    want = whole[np.arange(50), [[0, 2, 5, 9].index(i) for i in ids]]
    assert scorer.own(y - nu, corr, ids, 3.5) == pytest.approx(want)
    assert scorer.known(np.array([0, 1, 2, 9, -1])).tolist() == [True, False, True, True, False]
    assert not scorer.known(np.array([0]), allow_noise=False)[0]


def test_lowest_three():
    scores = np.array([[3.0, 1.0, 1.0, 2.0], [np.inf, 5.0, 1e31, np.nan]])
    found = K.lowest(scores, np.array([0, 4, 6, 8]), 1e30, 3)
    assert [ids.tolist() for ids, _ in found] == [[4, 4], [6, -1], [8, -1]]


def test_one_slice_at_a_time_gives_the_same_fit(make_points, make_classes):
    x, w, label = blobs(7, n=150, d=3, groups=4)
    points, start = make_points(x, w), make_classes((label + np.arange(150) % 2) % 5 + 1)
    want, _ = run(points, start, PLAIN)
    got, sliced = run(points, start, replace(PLAIN, model_broadcast_bytes=1, bounded_steps=True))
    assert got == want and sliced.score == pytest.approx(run(points, start, PLAIN)[1].score, rel=1e-9)
