from __future__ import annotations

import numpy as np
import pytest

from tarnwick.llm import lattice
from tests.llm.brute import Union

SCHEMA = "vec_id long, embedding array<float>, label int, id string, n long"


def vectors(seed: int = 1, n: int = 300, d: int = 64):
    r = np.random.default_rng(seed)
    base = r.standard_normal((n // 6, d))
    x = np.repeat(base, 6, axis=0) + r.standard_normal((n // 6 * 6, d)) * r.choice([0.0, 0.05, 0.14, 0.2], (n // 6 * 6, 1))
    rows = [(k, [float(v) for v in row], int(k // 6 % 4), "x", 1) for k, row in enumerate(x.astype(np.float32))]
    bad = [None, [], [0.0] * d, [float("nan")] + [1.0] * (d - 1), [float("inf")] + [1.0] * (d - 1), [None] + [1.0] * (d - 1), rows[0][1][:3], [3e38] * d]
    rows += [(1000 + k, v, 0, "x", 1) for k, v in enumerate(bad)] + [(2000, rows[0][1], None, "x", 1), (None, rows[0][1], 0, "x", 1), (2001, [3e38] * d, 0, "x", 1)]
    return rows + [rows[0], rows[0]]


def plain(rows):
    own = {}
    for i, v, label, *_ in rows:
        if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, dtype=np.float32).astype(float)
            x = x / np.abs(x).max()
            own[i] = (label, x / np.linalg.norm(x))
    u, n = Union(), dict.fromkeys((r[0] for r in rows), 0)
    for i, (a, x) in own.items():
        for j, (b, y) in own.items():
            if i != j and a == b and len(x) == len(y) and x @ y >= 0.98:
                n[i] += 1
                u.join(i, j)
    return {i: (k, None if i is None else u.find(i)) for i, k in n.items()}


@pytest.mark.parametrize("block", [lattice.BLOCK, 4])
def test_links(spark, monkeypatch, block):
    monkeypatch.setattr(lattice, "BLOCK", block)
    rows = vectors()
    got = lattice.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    want = plain(rows)
    assert len(got) == len(rows)
    assert all((r["n_links"], r["component_id"]) == want[r["vec_id"]] and r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in got)


def test_empty(spark):
    assert lattice.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_recall():
    r = np.random.default_rng(2)
    x = lattice.unit(r.standard_normal((2000, 64)))
    t = r.standard_normal((2000, 64))
    t -= (t * x).sum(axis=1, keepdims=True) * x
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * lattice.unit(t)
    zero = np.zeros(2000, dtype=np.int64)
    a, b = (lattice.cells(v, zero).reshape(2000, lattice.TABLES, lattice.LISTED) for v in (x, y))
    met = ((a[:, :, :1] == b).any(axis=2) | (b[:, :, :1] == a).any(axis=2)).any(axis=1)
    assert met.mean() >= 0.995


def test_e8():
    r = np.random.default_rng(3)
    z = r.standard_normal((200, 8)) * 2
    p = lattice.nearest_e8(z)
    assert (np.abs(2 * p - np.rint(2 * p)) < 1e-9).all() and (np.rint(p.sum(axis=1)) % 2 == 0).all()
    near = ((z[:, None] - p[:, None] - lattice.roots()[None]) ** 2).sum(axis=2).min(axis=1)
    assert (((z - p) ** 2).sum(axis=1) <= near + 1e-9).all()
