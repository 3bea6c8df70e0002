"""Fits that lose their driver, and fits without masks."""

from dataclasses import replace

import numpy as np
import pytest
from brute import Dense
from conftest import blobs

from maskmix.config import MixtureConfig
from maskmix.operators.masks import start_classes
from maskmix.plans import fit as plan
from maskmix.plans.fit import fit, resume

CONFIG = MixtureConfig(mask_starts=6, n_starts=2, points_for_cluster_mask=2.0, penalty_k_log_n=0.3)
PARTS = ("run", "iteration", "step", "alive", "deleted", "deleted_points", "changed", "did_split")


class Lost(RuntimeError):
    pass


def losing(monkeypatch, after: int):
    """The driver is lost after so many assignments were written and before they are recorded."""
    calls = {"n": 0}
    whole = plan.conclude

    def conclude(*a, **k):
        calls["n"] += 1
        if calls["n"] == after:
            raise Lost
        return whole(*a, **k)

    monkeypatch.setattr(plan, "conclude", conclude)


@pytest.mark.parametrize("config", [CONFIG, replace(CONFIG, subset=2, n_starts=1), replace(CONFIG, differences="always", n_starts=1, split="seeded", split_first=2)])
def test_a_lost_fit_goes_on(spark, make_points, monkeypatch, tmp_path, config):
    x, w, _ = blobs(4, n=160, d=3, groups=4)
    points = make_points(x, w)
    want = fit(points, config)
    classes = {r.point_id: r["class"] for r in want.classes.collect()}
    steps = len(want.metrics) + (config.subset > 1)
    path = str(tmp_path / "journal")
    done = 0
    for after in (1, 3, 2, 4):
        with monkeypatch.context() as patch:
            losing(patch, after)
            try:
                fit(points, config, journal=path)
                break
            except Lost:
                done += after - 1
    got = fit(points, config, journal=path)
    assert done < steps + 8
    assert {r.point_id: r["class"] for r in got.classes.collect()} == classes
    assert [[m[k] for k in PARTS] for m in got.metrics] == [[m[k] for k in PARTS] for m in want.metrics]
    assert [m["score"] for m in got.metrics] == pytest.approx([m["score"] for m in want.metrics], rel=1e-9)
    again = fit(points, config, journal=path)  # finished: nothing is computed anew
    assert again.score == got.score and [m["seconds"] for m in again.metrics] == [m["seconds"] for m in got.metrics]
    with pytest.raises(ValueError, match="is the journal of a fit"):
        fit(points, replace(config, penalty_k=1.0), journal=path)


def test_a_lost_resume_goes_on(make_points, make_classes, monkeypatch, tmp_path):
    x, w, label = blobs(6, n=150, d=3, groups=3)
    points, start = make_points(x, w), make_classes((label + np.arange(150) % 2) % 4 + 1)
    config = replace(CONFIG, mask_starts=0)
    want = resume(points, start, config)
    path = str(tmp_path / "journal")
    with monkeypatch.context() as patch:
        losing(patch, 2)
        with pytest.raises(Lost):
            resume(points, start, config, journal=path)
    got = resume(points, start, config, journal=path)
    assert [[m[k] for k in PARTS] for m in got.metrics] == [[m[k] for k in PARTS] for m in want.metrics]
    assert sorted(map(tuple, got.classes.collect())) == sorted(map(tuple, want.classes.collect()))


class Plain(Dense):
    """Full covariances of raw points and the penalty of a plain mixture."""

    def __init__(self, x, config):
        super().__init__(x, np.ones_like(x), config)

    def covariance(self, members):
        y = self.y[members]
        mean = y.mean(axis=0)
        return mean, (y - mean).T @ (y - mean) / (members.sum() + self.config.prior_point - 1)

    def one(self):
        p = self.d * (self.d + 1) / 2 + self.d + 1
        return self.config.penalty_k * p + self.config.penalty_k_log_n * p * np.log(self.n) / 2

    def penalty(self, classes):  # of a class, as far as deletions look at it
        return {c: self.one() for c in set(classes.tolist())}


@pytest.mark.parametrize("seed,normalise,penalty", [(0, True, 1.0), (1, False, 1.0), (2, True, 0.1)])
def test_fit_without_masks(make_points, make_classes, seed, normalise, penalty):
    x, w, label = blobs(seed, n=240, d=3, groups=3, spread=0.1)
    start = np.where(np.random.default_rng(seed).random(240) < 0.2, 4, label + 1)
    config = MixtureConfig(use_masks=False, normalise=normalise, penalty_k_log_n=penalty)
    got = resume(make_points(x, w), make_classes(start), config)
    dense = Plain(x, config)
    classes, alive = start, set(start.tolist()) | {0}
    for m in got.metrics:
        alive = set(classes.tolist()) | {0}
        new, gone, raw, _ = dense.step(classes)
        assert (m["deleted"], m["changed"]) == (gone, int((new != classes).sum()))
        assert m["raw"] == pytest.approx(raw, rel=1e-9)
        assert m["penalty"] == pytest.approx(dense.one() * (len(alive - {gone}) - 1), rel=1e-9)
        classes = new
    assert [r["class"] for r in got.classes.orderBy("point_id").collect()] == classes.tolist()


def test_starts_without_masks(make_points):
    x, w, _ = blobs(1, n=200)
    labels, k = start_classes(make_points(x, w), 5, MixtureConfig(use_masks=False), seed=3)
    found = {r.point_id: r["class"] for r in labels.collect()}
    assert k == 5 and set(found.values()) == {1, 2, 3, 4} and len(found) == 200
    again, _ = start_classes(make_points(x, w, parts=7), 5, MixtureConfig(use_masks=False), seed=3)
    assert {r.point_id: r["class"] for r in again.collect()} == found
    assert MixtureConfig(mask_starts=0, use_masked_initial_conditions=True).starts_from_masks
    assert not MixtureConfig(mask_starts=0).starts_from_masks
    with pytest.raises(ValueError):
        MixtureConfig(use_masks=False, split="seeded")
    with pytest.raises(ValueError):
        MixtureConfig(differences="sometimes")


def test_whole_fit_without_masks(make_points):
    x, w, _ = blobs(2, n=150, d=3, groups=3)
    result = fit(make_points(x, w), MixtureConfig(use_masks=False, mask_starts=0, min_clusters=3, max_clusters=4))
    assert {m["run"] for m in result.metrics} == {0, 1} and result.classes.count() == 150


@pytest.mark.parametrize("seed,config", [
    (0, replace(CONFIG, n_starts=3)),
    (1, replace(CONFIG, mask_starts=0, min_clusters=3, max_clusters=6, n_starts=1, use_masked_initial_conditions=True)),
    (2, MixtureConfig(use_masks=False, mask_starts=0, min_clusters=1, max_clusters=4)),
    (3, replace(CONFIG, n_starts=3, max_iter=2, model_broadcast_bytes=9000)),
])
def test_fits_together_equal_fits_one_by_one(make_points, seed, config):
    x, w, _ = blobs(seed, n=200, d=3, groups=4)
    points = make_points(x, w)
    want, got = fit(points, replace(config, together=False)), fit(points, config)
    assert [[m[k] for k in PARTS] for m in got.metrics] == [[m[k] for k in PARTS] for m in want.metrics]
    assert [m["score"] for m in got.metrics] == pytest.approx([m["score"] for m in want.metrics], rel=1e-9)
    assert (got.score, got.alive, got.start_clusters) == (pytest.approx(want.score), want.alive, want.start_clusters)
    assert sorted(map(tuple, got.classes.collect())) == sorted(map(tuple, want.classes.collect()))
