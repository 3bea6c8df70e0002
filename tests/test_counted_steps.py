"""A scoring pass that also counts moments: one pass over the points per iteration, with the same run."""

from dataclasses import replace

import numpy as np
from conftest import blobs

from maskmix.config import MixtureConfig
from maskmix.operators import moments
from maskmix.plans import fit as plan
from maskmix.plans.fit import resume


def run(make_points, make_classes, config, journal=None):
    x, w, _ = blobs(seed=3, n=240, d=6, groups=4, spread=0.2)
    start = np.arange(240) % 6 + 1
    result = resume(make_points(x, w), make_classes(start), config, journal=journal)
    log = [(m["alive"], m["deleted"], m["deleted_points"], m["changed"], m["scored"]) for m in result.metrics]
    return log, [m["score"] for m in result.metrics], sorted(map(tuple, result.classes.collect()))


def test_models_come_from_the_scoring_pass(make_points, make_classes, monkeypatch, tmp_path):
    config = replace(MixtureConfig(), differences="auto", points_for_cluster_mask=2.0, penalty_k_log_n=0.2)
    passes = []
    counted = plan.packed_cells
    monkeypatch.setattr(plan, "packed_cells", lambda *a, **k: passes.append(1) or counted(*a, **k))
    log, score, classes = run(make_points, make_classes, config)
    deletions = sum(row[1] is not None for row in log)
    assert len(passes) <= 1 + deletions < len(log)
    monkeypatch.setattr(plan.PreparedPoints, "moment_tasks", 1)  # a pass of its own for every M-step
    log1, score1, classes1 = run(make_points, make_classes, config)
    assert (log, classes) == (log1, classes1) and np.allclose(score, score1, rtol=1e-9)
    monkeypatch.undo()
    assert run(make_points, make_classes, config, str(tmp_path / "journal"))[2] == classes


def test_masked_models_need_no_products(make_points, make_classes):
    from maskmix.operators.dimensions import dimension_model

    x, w, label = blobs(n=60)
    points = make_points(x, w)
    noise = dimension_model(points)
    labelled = points.join(make_classes(label + 1), "point_id")
    config = replace(MixtureConfig(), points_for_cluster_mask=float("inf"))
    assert not moments.needs_products(config) and moments.needs_products(MixtureConfig())
    whole = moments.packed_cells(labelled, noise)
    few = moments.packed_cells(labelled, noise, products=False)
    assert few.count() == 3 * (3 * 5 + 1) < whole.count()
    rows = [sorted(map(tuple, moments.model_of_cells(c, noise, config).select("cluster_id", "n", "mean", "variance").collect())) for c in (whole, few)]
    assert [r[:2] for r in rows[0]] == [r[:2] for r in rows[1]]
    assert np.allclose([r[2:] for r in rows[0]], [r[2:] for r in rows[1]], rtol=1e-12)
