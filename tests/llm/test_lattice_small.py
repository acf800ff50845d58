"""Meeting rate of op1_lattice at few dimensions."""

from __future__ import annotations

import numpy as np
import pytest

from tarnwick.llm import lattice


@pytest.mark.parametrize("d", [2, 4, 8, 12, 15, 16, 64])
def test_pairs_at_the_border_meet(d):
    r, n = np.random.default_rng(1), 8000
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x = unit(r.standard_normal((n, d)))
    y = r.standard_normal((n, d))
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * unit(y - (x * y).sum(axis=1, keepdims=True) * x)
    a, b = (lattice.cells(v, np.zeros(n, dtype=np.int64)).reshape(n, lattice.TABLES, lattice.LISTED) for v in (x, y))
    meet = ((a[:, :, :1] == b) | (b[:, :, :1] == a)).any(axis=(1, 2))
    assert meet.mean() >= 0.999
