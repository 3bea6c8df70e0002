import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from maskmix.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "6g")


@pytest.fixture
def make_points(spark):
    """A DataFrame (point_id, x, w) from two matrices, spread over several partitions."""

    def build(x, w, parts=3):
        rows = [(i, [float(v) for v in a], [float(v) for v in b]) for i, (a, b) in enumerate(zip(x, w))]
        return spark.createDataFrame(rows, "point_id long, x array<double>, w array<double>").repartition(parts)

    return build


@pytest.fixture
def make_classes(spark):
    def build(classes):
        return spark.createDataFrame([(i, int(c)) for i, c in enumerate(classes)], "point_id long, class int")

    return build


def blobs(seed=0, n=90, d=5, groups=3, spread=0.05):
    """Clustered points with masks that are one on a group's own dimensions and partial elsewhere."""
    rng = np.random.default_rng(seed)
    centres = rng.random((groups, d))
    label = rng.integers(0, groups, n)
    x = centres[label] + spread * rng.normal(size=(n, d))
    w = rng.choice([0.0, 0.3, 1.0], size=(n, d), p=[0.3, 0.2, 0.5])
    return x, w, label
