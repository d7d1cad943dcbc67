import numpy as np
import pytest

from geolake.llm.simhash import shard_masks


@pytest.mark.parametrize("n", [10_000, 10_000_000])
def test_share_of_pairs_that_meet_does_not_depend_on_the_table(n):
    masks = shard_masks(n, 256, 39)
    rng = np.random.default_rng(1)
    met = 0
    for _ in range(2000):
        differ = np.zeros(4, np.uint64)
        for i in rng.choice(256, 39, replace=False).tolist():
            differ[i // 64] |= np.uint64(1 << (i % 64))
        met += bool(((masks & differ) == 0).all(axis=1).any())
    assert met >= 0.995 * 2000
