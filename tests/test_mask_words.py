import numpy as np
import pytest

from maskmix.operators.masks import differing, mask_words


@pytest.mark.parametrize("width", [1, 7, 64, 65, 200])
def test_packed_distances_equal_a_direct_count(width):
    rng = np.random.default_rng(width)
    one, two = rng.integers(0, 2, (30, width)), rng.integers(0, 2, (9, width))
    assert (differing(mask_words(one), mask_words(two)) == (one[:, None] != two[None]).sum(axis=2)).all()
