"""Pairs below each of some separations, between two crowds, at a cost that follows the circles around the points and not the pairs in them.

The points of one crowd are dealt in strips of latitude, about as high as points lie apart, and along them in short cells.  Those of the other are cut in knots of a
few that lie together.  A circle that is within reach of all points of a knot cuts each strip at two places: what lies between is a difference of running
totals.  Only the points between that circle and the one that is out of reach of all are compared, as matrices.  Cuts are widened by far more than rounding, and
pairs that are not clear of an edge are computed again in the order in which `proximity.D2` adds, so counts are exact.
"""

from __future__ import annotations

import math
import sys

import numpy as np
from pyspark import cloudpickle

# The few functions below travel with the job, so that executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Crowds of a smaller product of sizes are compared pair by pair.
MOST_PAIRS = 5_000_000
#: Circles up to this size, around points that lie within _NEAR of each other, stay clear of the poles of their own frame.
_LARGEST, _NEAR = math.radians(45.0), math.radians(20.0)
#: Cells of a strip, for each height of it.
_FINE = 4
#: Points of a knot.
_KNOT = 32
#: Far above rounding, for angles and for cosines over the product of two latitudes'.
_SLACK = 1e-9
#: Cuts of circles with strips, and points between circles, that are worked out at once.
_AT_ONCE, _MOST_POINTS = 40_000, 1_000_000


def _tame(weights: np.ndarray, others: np.ndarray) -> bool:
    """Whether differences of running totals of these weights are as good as sums: whole numbers, or such of one sign and like size."""
    if all((one == np.rint(one)).all() for one in (weights, others)) and np.abs(weights).sum() * np.abs(others).sum() < 2.0**53:
        return True
    both = np.concatenate([weights, others])
    both = both[both != 0]
    return bool((both > 0).all() and both.max() <= both.min() * 2.0**20)


def may_strip(at: np.ndarray, parts: np.ndarray, others: np.ndarray, other_parts: np.ndarray, edges2: np.ndarray) -> bool:
    """Whether `strip_sums` is exact for these crowds and pays."""
    if len(at) * len(others) <= MOST_PAIRS or edges2[-1] > (2.0 * math.sin(_LARGEST / 2.0)) ** 2:
        return False
    if any((np.abs((one * one).sum(1) - 1.0) > 1e-12).any() for one in (at, others)):
        return False
    return parts[:, 1].sum() * other_parts[:, 1].sum() < 2.0**53 and _tame(parts[:, 0], other_parts[:, 0])


def _close(at: np.ndarray, parts: np.ndarray):
    """The points in halves along the longest side, down to such as lie within _NEAR of their mean."""
    middle = at.mean(0)
    size = math.sqrt(float((middle * middle).sum()))
    if size > 0.5 and ((at - middle / size) ** 2).sum(1).max() <= (2.0 * math.sin(_NEAR / 2.0)) ** 2:
        yield middle / size, at, parts
        return
    axis = int(np.argmax(at.max(0) - at.min(0)))
    order = np.argpartition(at[:, axis], len(at) // 2)
    for rows in (order[: len(at) // 2], order[len(at) // 2 :]):
        yield from _close(at[rows], parts[rows])


def strip_sums(at: np.ndarray, parts: np.ndarray, others: np.ndarray, other_parts: np.ndarray, edges2: np.ndarray, closed: bool) -> np.ndarray:
    """For each edge the sums of products of `parts` over the pairs below it (`closed`: or on it): one row an edge, one column a part."""
    found = np.zeros((len(edges2), parts.shape[1]))
    most = 2.0 * math.asin(math.sqrt(edges2[-1]) / 2.0)
    for middle, near, near_parts in _close(at, parts):
        reach = 2.0 * math.sin(min(math.pi, _NEAR + most + 1e-4) / 2.0)
        rows = ((others - middle) ** 2).sum(1) <= reach * reach
        if rows.any():
            found += _around(middle, near, near_parts, others[rows], other_parts[rows], edges2, closed)
    return found


def _knots(at: np.ndarray, rows: np.ndarray):
    """The rows in halves along the longest side, down to knots."""
    if len(rows) <= _KNOT:
        yield rows
        return
    here = at[rows]
    axis = int(np.argmax(here.max(0) - here.min(0)))
    order = np.argpartition(here[:, axis], len(rows) // 2)
    yield from _knots(at, rows[order[: len(rows) // 2]])
    yield from _knots(at, rows[order[len(rows) // 2 :]])


class _Strips:
    """The points of a crowd in strips and cells of a frame, with running totals of their parts."""

    def __init__(self, frame: np.ndarray, at: np.ndarray, parts: np.ndarray):
        turned = at @ frame
        lat, lon = np.arcsin(np.clip(turned[:, 2], -1.0, 1.0)), np.arctan2(turned[:, 1], turned[:, 0])
        bottom, self.left = lat.min(), lon.min()
        # Strips are as high as a point's share of the sky that these points take up is wide.
        high, wide = lat.max() - bottom, lon.max() - self.left
        self.height = max(math.sqrt(high * wide / len(at)), high / (4 * len(at)), wide / (4 * len(at)), 1e-7)
        n_strips, self.n_cells = int(high / self.height) + 1, int(wide / self.height * _FINE) + 1
        strip = np.minimum(((lat - bottom) / self.height).astype(np.int64), n_strips - 1)
        cell = np.minimum(((lon - self.left) * (_FINE / self.height)).astype(np.int64), self.n_cells - 1)
        place = strip * self.n_cells + cell
        order = np.argsort(place, kind="stable")
        at, self.parts = at[order], parts[order]
        norm = (at * at).sum(1)
        self.norm = norm.max()
        self.first_in = np.concatenate(([0], np.cumsum(np.bincount(place, minlength=n_strips * self.n_cells))))
        # Parts that are the same for all points are multiples of the number.
        self.totals = [None if (column == column[0]).all() else np.concatenate(([0.0], np.cumsum(column))) for column in self.parts.T]
        self.varied = [k for k, total in enumerate(self.totals) if total is not None]
        # What a comparison needs of a point, in one row: position, norm, one, the parts that vary.
        self.table = np.column_stack([at, norm, np.ones(len(at)), self.parts[:, self.varied]])
        self.bounds = bottom + self.height * np.arange(n_strips + 1)
        # What is rounded into the last strip may lie above it.
        self.bounds[-1] = max(self.bounds[-1], lat.max())

    def cells(self, lon: np.ndarray, how) -> np.ndarray:
        return np.clip(how((lon - self.left) * (_FINE / self.height)), 0, self.n_cells).astype(np.int64)

    def stretches(self, lat: np.ndarray, lon: np.ndarray, inner: np.ndarray, outer: np.ndarray) -> tuple[np.ndarray, ...]:
        """Around each place (latitudes ascend) the stretches of points in each strip: `row`, and where the outer and the inner circle begin and end.

        All points within `outer` are between the first and the last, all between the middle two are within `inner`.
        """
        low = max(0, int(np.searchsorted(self.bounds, (lat - outer).min(), "right")) - 1)
        high = min(len(self.bounds) - 1, int(np.searchsorted(self.bounds, (lat + outer).max(), "right")))
        z, cosine = (np.asarray(f(self.bounds[low : max(low, high) + 1]))[None, :] for f in (np.sin, np.cos))
        z_p, cos_p, c = np.sin(lat)[:, None], np.cos(lat)[:, None], np.cos(outer)[:, None]
        if z.shape[1] < 2:
            none = np.zeros(0, np.int64)
            return none, none, none, none, none
        # The cosine of half the stretch of a parallel that lies in the circle.
        base = 1.0 / (cos_p * cosine)
        over = (c - z_p * z) * base
        best = np.minimum(over[:, :-1], over[:, 1:])
        # The longest stretch is at sine z / c; it shrinks on both sides.
        at_top = np.searchsorted(z[0], z_p[:, 0] / c[:, 0], "right") - 1
        rows = np.flatnonzero((at_top >= 0) & (at_top < best.shape[1]))
        best[rows, at_top[rows]] = np.sqrt(np.maximum(0.0, c[rows, 0] ** 2 - z_p[rows, 0] ** 2)) / cos_p[rows, 0]
        rows, strips = np.nonzero(best < 1.0 + _SLACK)
        wide = np.arccos(np.clip(best[rows, strips] - _SLACK, -1.0, 1.0)) + _SLACK
        within = (np.cos(np.maximum(inner, 0.0))[:, None] - z_p * z) * base
        worst = np.maximum(within[:, :-1], within[:, 1:])[rows, strips] + _SLACK
        worst[inner[rows] <= 0] = 1.0
        sure = np.arccos(np.clip(worst, -1.0, 1.0)) - _SLACK
        middle, base = lon[rows], (strips + low) * self.n_cells
        first = self.first_in[base + self.cells(middle - wide, np.floor)]
        last = self.first_in[base + np.minimum(self.cells(middle + wide, np.floor) + 1, self.n_cells)]
        begin, end = self.first_in[base + self.cells(middle - sure, np.ceil)], self.first_in[base + self.cells(middle + sure, np.floor)]
        none = (worst >= 1.0) | (end <= begin)
        return rows, first, np.where(none, last, begin), np.where(none, last, end), last


def _around(middle, at, parts, others, other_parts, edges2, closed) -> np.ndarray:
    axis = np.eye(3)[np.argmin(np.abs(middle))]
    east = np.cross(axis, middle)
    east /= np.sqrt((east * east).sum())
    frame = np.column_stack([middle, east, np.cross(middle, east)])
    strips = _Strips(frame, others, other_parts)
    knots = list(_knots(at, np.arange(len(at))))
    starts = np.concatenate(([0], np.cumsum([len(knot) for knot in knots])))
    order = np.concatenate(knots)
    at, parts = at[order], parts[order]
    whole = np.add.reduceat(parts, starts[:-1], axis=0)
    centre = np.add.reduceat(at, starts[:-1], axis=0)
    centre /= np.sqrt((centre * centre).sum(1))[:, None]
    apart = ((at - np.repeat(centre, np.diff(starts), axis=0)) ** 2).sum(1)
    size = 2.0 * np.arcsin(np.minimum(1.0, np.sqrt(np.maximum.reduceat(apart, starts[:-1])) / 2.0)) + _SLACK
    turned = centre @ frame
    lat, lon = np.arcsin(np.clip(turned[:, 2], -1.0, 1.0)), np.arctan2(turned[:, 1], turned[:, 0])
    order = np.argsort(lat, kind="stable")
    norm = (at * at).sum(1)
    left, slack = np.column_stack([-2.0 * at, np.ones(len(at)), norm]), 4e-14 * (norm.max() + strips.norm)
    found = np.zeros((len(edges2), parts.shape[1]))
    for edge, limit in enumerate(edges2):
        if limit < 0 or (limit == 0 and not closed):
            continue
        radius = 2.0 * math.asin(math.sqrt(limit) / 2.0)
        # Rounding of a squared separation shifts a small circle by more than an angle.
        margin = _SLACK if radius > 1e-4 else 1e-6
        step = max(4, min(512, int(_AT_ONCE / (2.0 * radius / strips.height + 2.0))))
        for start in range(0, len(order), step):
            some = order[start : start + step]
            rows, first, begin, end, last = strips.stretches(lat[some], lon[some], radius - size[some] - margin, radius + size[some] + margin)
            for k, total in enumerate(strips.totals):
                sure = (end - begin) * strips.parts[0, k] if total is None else total[end] - total[begin]
                found[edge, k] += (np.bincount(rows, sure, len(some)) * whole[some, k]).sum()
            # The stretches between both circles, by knot.
            of, from_, sizes = np.concatenate([rows, rows]), np.concatenate([first, end]), np.concatenate([begin - first, last - end])
            by = np.argsort(of, kind="stable")
            of, from_, sizes = of[by], from_[by], sizes[by]
            ends = np.concatenate(([0], np.cumsum(sizes)))
            bounds = ends[np.searchsorted(of, np.arange(len(some) + 1))]
            one = 0
            while one < len(some):
                # As many knots at once as have few points around them.
                until = max(one + 1, int(np.searchsorted(bounds, bounds[one] + _MOST_POINTS, "right")) - 1)
                part = slice(*np.searchsorted(of, [one, until]))
                j = np.repeat(from_[part] - ends[:-1][part], sizes[part]) + np.arange(bounds[one], bounds[until])
                table = np.take(strips.table, j, axis=0, mode="clip")
                for knot in range(one, until):
                    here = slice(bounds[knot] - bounds[one], bounds[knot + 1] - bounds[one])
                    if here.start < here.stop:
                        own = slice(starts[some[knot]], starts[some[knot] + 1])
                        below = _below(left[own], table[here, :5], limit, slack, closed, at[own])
                        found[edge] += _products(below, parts[own], table[here, 4:], strips)
                one = until
    return found


def _products(below: np.ndarray, parts: np.ndarray, others: np.ndarray, strips: _Strips) -> np.ndarray:
    """Sums of the products of parts over the pairs that are set."""
    number = below.astype(np.float64) @ others
    inner = number[:, :1] * strips.parts[0]
    inner[:, strips.varied] = number[:, 1:]
    return (parts * inner).sum(0)


def _below(left: np.ndarray, right: np.ndarray, limit: float, slack: float, closed: bool, at: np.ndarray) -> np.ndarray:
    d2 = left @ right.T
    below, perhaps = d2 < limit - slack, d2 <= limit + slack
    if np.count_nonzero(below) != np.count_nonzero(perhaps):
        i, j = np.nonzero(below ^ perhaps)
        # The order of the operations is that of `proximity.D2`.
        x, y, z = (at[i] - right[j, :3]).T
        exact = x * x + y * y + z * z
        below[i, j] = exact <= limit if closed else exact < limit
    return below
