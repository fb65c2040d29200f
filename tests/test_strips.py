import math

import numpy as np
import pyarrow as pa
import pytest

from skylattice.functions.bins import make_bins
from skylattice.operators import blocks, strips


def cap(rng, n, centre, radius):
    """Unit vectors spread evenly within a radius."""
    c = np.array(centre, float) / np.linalg.norm(centre)
    z, phi = 1 - rng.uniform(0, 1, n) * (1 - math.cos(radius)), rng.uniform(0, 2 * math.pi, n)
    e = np.cross(np.eye(3)[np.argmin(np.abs(c))], c)
    e /= np.linalg.norm(e)
    side = np.sqrt(1 - z * z)
    v = np.outer(z, c) + np.outer(side * np.cos(phi), e) + np.outer(side * np.sin(phi), np.cross(c, e))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def parts_of(rng, n, plain):
    weight = rng.integers(0, 4, n).astype(float) if plain else rng.uniform(0.5, 2.0, n)
    return np.column_stack([weight, np.ones(n) if plain else rng.integers(1, 3, n), np.ones(n)])


def square(p, q):
    x, y, z = (p[..., k] - q[..., k] for k in range(3))
    return x * x + y * y + z * z


@pytest.mark.parametrize("centre, near, far, bins", [
    ((0, 0, 1), 0.2, 0.5, make_bins(10, 1.0, 15.0)),
    ((1, 2, -3), math.pi, math.pi, make_bins(6, 0.0, 44.0, "linear")),
    ((1, 1, 0), 1e-6, 1e-6, make_bins(4, 1e-5, 1e-4, "linear")),
    ((0.1, 0.2, 1), 0.3, 1e-3, make_bins(3, 0.0, 8.0, "linear")),
])
@pytest.mark.parametrize("closed, plain", [(False, True), (True, True), (False, False)])
def test_sums_are_those_of_all_pairs(monkeypatch, centre, near, far, bins, closed, plain):
    monkeypatch.setattr(strips, "MOST_PAIRS", 0)
    rng = np.random.default_rng(3)
    a, b = cap(rng, 500, centre, near), cap(rng, 700, centre, far)
    b[:150], b[150:200] = a[:150], a[0]
    parts, others = parts_of(rng, len(a), plain), parts_of(rng, len(b), plain)
    d2 = square(a[:, None, :], b[None, :, :])
    # Two edges are the very separations of pairs.
    inside = d2[(d2 > 0) & (d2 < bins.edges2[-1])]
    edges2 = np.sort([*bins.edges2, *np.quantile(inside, [0.2, 0.7], method="nearest")])
    assert strips.may_strip(a, parts, b, others, edges2)
    found = strips.strip_sums(a, parts, b, others, edges2, closed)
    for edge, one in zip(edges2, found):
        below = d2 <= edge if closed else d2 < edge
        expected = (parts * (below.astype(float) @ others)).sum(0)
        assert list(one[1:]) == list(expected[1:])
        assert one[0] == expected[0] if plain else one[0] == pytest.approx(expected[0], rel=1e-12)


def test_crowds_are_not_compared_pair_by_pair(monkeypatch):
    rng, bins = np.random.default_rng(4), make_bins(6, 5.0, 15.0)
    a, b = cap(rng, 6000, (1, 0, 0), 0.13), cap(rng, 30000, (1, 0, 0), 0.39)
    compared, below = [], strips._below
    monkeypatch.setattr(strips, "_below", lambda left, right, *rest: compared.append(len(left) * len(right)) or below(left, right, *rest))
    monkeypatch.setattr(blocks.PairSums, "_compare", lambda self, a, i, b, j, *rest: compared.append((a.starts[i + 1] - a.starts[i]) * (b.starts[j + 1] - b.starts[j])))
    made = [blocks.make_blocks(*v.T, pa.array(np.ones(len(v))), np.ones(len(v)), np.zeros(len(v), int)) for v in (a, b)]
    sums = blocks.PairSums(bins.edges2, False)
    sums.meet(*made, np.ones((len(made[0]), len(made[1])), int))
    assert sum(compared) < 0.7 * len(a) * len(b)
    few = sum(int((square(one, b) < bins.edges2[-1]).sum() - (square(one, b) < bins.edges2[0]).sum()) for one in a[:, None, :][:, 0])
    assert sum(pairs for _, pairs, _ in sums.sums.values()) == few


@pytest.mark.parametrize("weights", [[1e-9, 1.0, 1e9], [-0.1, 0.3, 0.7]])
def test_weights_that_totals_would_spoil_are_left_to_matrices(monkeypatch, weights):
    monkeypatch.setattr(strips, "MOST_PAIRS", 0)
    v = cap(np.random.default_rng(5), 3, (1, 0, 0), 0.1)
    parts = np.column_stack([weights, np.ones(3), np.ones(3)])
    assert not strips.may_strip(v, parts, v, parts, np.array(make_bins(3).edges2))
