"""Pair counts between groups of points that Spark has brought together, block by block.

Crowds of two tags are counted by `strips`.  Else, within a group the points of one tag (`is_random`, `region`) are cut in blocks of at most BLOCK that lie together.  Two blocks whose separations all fall in one bin
are counted by products, two outside all bins leave, and only the others are compared point by point, as matrices.  The products of a matrix are
good to about 1e-15, kept in single precision; pairs that are not clear of an edge are computed again in the order in which `proximity.D2` adds, so bins are exact.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from skylattice.functions.bins import Bins
from skylattice.operators.strips import may_strip, strip_sums

# The few functions below travel with the job, so that executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 512
#: Pairs of blocks whose boxes are held against each other at once.
_AT_ONCE = 500_000
#: Points of a block are counted by weight and number where these are so few, else multiplied out.
_MOST_ALIKE = 8
_NAMES = ("x", "y", "z", "weight", "n")


def is_placed(x: str = "x", y: str = "y", z: str = "z") -> Column:
    """Whether a position is there and finite: other points are in no pair."""
    return F.coalesce(F.expr(f"abs({x}) + abs({y}) + abs({z}) < double('Infinity')"), F.lit(False))


@dataclass
class Blocks:
    """Points in blocks: block i has the rows `starts[i]` to `starts[i + 1]`.  `parts` has weight (NULL: 0), number and whether there is a weight."""

    at: np.ndarray
    parts: np.ndarray
    starts: np.ndarray
    tag: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    total: np.ndarray
    plain: np.ndarray
    alike: list

    def __len__(self) -> int:
        return len(self.tag)


def _cut(at: np.ndarray, rows: np.ndarray) -> Iterator[np.ndarray]:
    """The rows in halves along the longest side, down to blocks."""
    if len(rows) <= BLOCK:
        yield rows
        return
    here = at[rows]
    axis = int(np.argmax(here.max(0) - here.min(0)))
    middle = len(rows) // 2
    order = np.argpartition(here[:, axis], middle)
    yield from _cut(at, rows[order[:middle]])
    yield from _cut(at, rows[order[middle:]])


def make_blocks(x, y, z, weight, n, tag: np.ndarray) -> Blocks:
    """Blocks of one tag each; points without a finite position are left out."""
    at, n = np.column_stack([x, y, z]).astype(np.float64), np.asarray(n, np.float64)
    valued = ~np.asarray(weight.is_null())
    weight = np.where(valued, np.asarray(weight.fill_null(0.0)), 0.0)
    placed = np.isfinite(at).all(1)
    cut, tags = [], []
    for one in np.unique(tag[placed]):
        for rows in _cut(at, np.flatnonzero(placed & (tag == one))):
            cut.append(rows)
            tags.append(one)
    order = np.concatenate(cut) if cut else np.zeros(0, np.int64)
    starts = np.concatenate(([0], np.cumsum([len(rows) for rows in cut]))).astype(np.int64)
    at, parts = at[order], np.column_stack([weight, n, valued]).astype(np.float64)[order]
    if not cut:
        none = np.zeros((0, 3))
        return Blocks(at, parts, starts, np.zeros(0, np.int64), none, none, none, np.zeros(0, bool), [])
    over = lambda how, values: how.reduceat(values, starts[:-1], axis=0)
    alike = [_alike(parts[first:last]) for first, last in zip(starts, starts[1:])]
    return Blocks(
        at, parts, starts, np.asarray(tags), over(np.minimum, at), over(np.maximum, at), over(np.add, parts), over(np.logical_and, np.isfinite(parts[:, 0])), alike)


class PairSums:
    """Adds up pairs by (bin, tag of a, tag of b): weighted sum, pairs, and pairs with a weight."""

    def __init__(self, edges2: list[float], upper_closed: bool):
        self.edges, self.side, self.closed = np.array(edges2), "left" if upper_closed else "right", upper_closed
        self.sums: dict[tuple[int, int, int], list] = {}

    def _place(self, d2: np.ndarray) -> np.ndarray:
        """Number of the bin; -1 below the first, the number of bins above the last."""
        return np.searchsorted(self.edges, d2, self.side) - 1

    def _add(self, bin_: int, tag_a: int, tag_b: int, factor: int, weighted: float, pairs: int, valued: int) -> None:
        if not pairs:
            return
        one = self.sums.setdefault((int(bin_), int(tag_a), int(tag_b)), [0.0, 0, 0])
        one[0] += factor * weighted
        one[1] += factor * pairs
        one[2] += valued

    def meet(self, a: Blocks, b: Blocks, factor: np.ndarray) -> None:
        """All pairs of blocks, each pair of points `factor[i, j]` times (0: not at all); `factor` depends on the tags alone."""
        factor = self._by_strips(a, b, factor)
        step = max(1, _AT_ONCE // max(1, len(b)))
        for first in range(0, len(a), step):
            self._meet(a, np.arange(first, min(len(a), first + step)), b, factor[first : first + step])

    def _by_strips(self, a: Blocks, b: Blocks, factor: np.ndarray) -> np.ndarray:
        """Adds up the tags that are crowded on both sides; the factors that are left."""
        factor = factor.copy()
        for tag_a in np.unique(a.tag):
            for tag_b in np.unique(b.tag):
                i, j = np.flatnonzero(a.tag == tag_a), np.flatnonzero(b.tag == tag_b)
                times = int(factor[i[0], j[0]])
                p, q = slice(a.starts[i[0]], a.starts[i[-1] + 1]), slice(b.starts[j[0]], b.starts[j[-1] + 1])
                if not times or not (a.plain[i].all() and b.plain[j].all()) or not may_strip(a.at[p], a.parts[p], b.at[q], b.parts[q], self.edges):
                    continue
                below = strip_sums(a.at[p], a.parts[p], b.at[q], b.parts[q], self.edges, self.closed)
                for bin_, (weighted, pairs, valued) in enumerate(below[1:] - below[:-1]):
                    self._add(bin_, tag_a, tag_b, times, float(weighted), int(pairs), int(valued))
                factor[i[0] : i[-1] + 1, j[0] : j[-1] + 1] = 0
        return factor

    def _meet(self, a: Blocks, rows: np.ndarray, b: Blocks, factor: np.ndarray) -> None:
        least, most = 0.0, 0.0
        for k in range(3):
            # The same operations in the same order as for two points: rounding keeps order, so no pair is outside of its boxes' bounds.
            above, below = a.lo[rows, None, k] - b.hi[None, :, k], b.lo[None, :, k] - a.hi[rows, None, k]
            gap = np.maximum(0.0, np.maximum(above, below))
            span = np.maximum(a.hi[rows, None, k] - b.lo[None, :, k], b.hi[None, :, k] - a.lo[rows, None, k])
            least, most = least + gap * gap, most + span * span
        first, last = self._place(least), self._place(most)
        for i, j in zip(*np.nonzero((factor != 0) & (last >= 0) & (first < len(self.edges) - 1))):
            self._compare(a, int(rows[i]), b, int(j), int(factor[i, j]), int(first[i, j]), int(last[i, j]))

    def _compare(self, a: Blocks, i: int, b: Blocks, j: int, factor: int, first: int, last: int) -> None:
        # Products of sums are exact for numbers of rows as long as they stay below 2^53.
        plain = a.plain[i] and b.plain[j] and a.total[i, 1] * b.total[j, 1] < 2.0**53
        if first == last and plain:
            weighted, pairs, valued = a.total[i] * b.total[j]
            self._add(first, a.tag[i], b.tag[j], factor, float(weighted), int(pairs), int(valued))
            return
        p, q = a.at[a.starts[i] : a.starts[i + 1]], b.at[b.starts[j] : b.starts[j + 1]]
        parts, others = a.parts[a.starts[i] : a.starts[i + 1]], b.parts[b.starts[j] : b.starts[j + 1]]
        norm_p, norm_q = (p * p).sum(1), (q * q).sum(1)
        left = np.column_stack([-2.0 * p, norm_p, np.ones(len(p))])
        right = np.column_stack([q, np.ones(len(q)), norm_q])
        d2, slack = left @ right.T, 4e-14 * (norm_p.max() + norm_q.max())
        # Rounding keeps order: what is clear in single precision is clear.
        d2, before = d2.astype(np.float32), None
        for edge in range(first, last + 1):
            # Pairs below the upper edge of this bin, as bits; all are below that of the last.
            below = self._below(d2, self.edges[edge + 1], slack, p, q) if edge < last else np.full((len(p), -(-len(q) // 64) * 8), 255, np.uint8)
            if 0 <= edge < len(self.edges) - 1:
                inside = below if before is None else below ^ before
                self._add(edge, a.tag[i], b.tag[j], factor, *_summed(inside, parts, others, b.alike[j], plain))
            before = below

    def _below(self, d2: np.ndarray, edge: float, slack: float, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        below, perhaps = d2 < np.float32(edge - slack), d2 <= np.float32(edge + slack)
        if np.count_nonzero(below) != np.count_nonzero(perhaps):
            i, j = np.nonzero(below ^ perhaps)
            x, y, z = (p[i] - q[j]).T
            exact = x * x + y * y + z * z
            below[i, j] = exact <= edge if self.closed else exact < edge
        return _bits(below)


def _bits(rows: np.ndarray) -> np.ndarray:
    """Rows of truth values as bits, in whole words."""
    packed = np.packbits(rows, axis=1)
    whole = np.zeros((len(rows), -(-rows.shape[1] // 64) * 8), np.uint8)
    whole[:, : packed.shape[1]] = packed
    return whole


def _summed(inside: np.ndarray, parts: np.ndarray, others: np.ndarray, alike: tuple | None, plain: bool) -> tuple[float, int, int]:
    """Weighted sum, pairs and pairs with a weight over the bits that are set."""
    if plain and alike is not None:
        bits, values = alike
        counts = np.bitwise_count(inside.view(np.uint64)[:, None, :] & bits[None, :, :]).astype(np.float64)
        sums = (parts.T @ counts.reshape(len(parts), -1)).reshape(3, *bits.shape).sum(2)
        weighted, pairs, valued = (sums * values.T).sum(1)
        return float(weighted), int(pairs), int(valued)
    inside = np.unpackbits(inside, axis=1, count=len(others))
    if plain:
        weighted, pairs, valued = (parts * (inside.astype(np.float64) @ others)).sum(0)
        return float(weighted), int(pairs), int(valued)
    i, j = np.nonzero(inside)
    valued = (parts[i, 2] * others[j, 2]) > 0
    pairs = sum(int(one) * int(other) for one, other in zip(parts[i, 1].astype(np.int64), others[j, 1].astype(np.int64)))
    with np.errstate(invalid="ignore", over="ignore"):
        return float((parts[i, 0] * others[j, 0])[valued].sum()), pairs, int(valued.sum())


def _alike(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """The different weights and numbers of a block's points, and for each the points that have it, as bits; None where they are many."""
    values, which = np.unique(parts, axis=0, return_inverse=True)
    if len(values) > _MOST_ALIKE:
        return None
    return _bits(which.reshape(1, -1) == np.arange(len(values))[:, None]).view(np.uint64), values


def _tags(a: pa.Table, b: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Table]:
    """Numbers of the tags of the rows of both sides, and the table of tags."""
    both = pa.concat_tables([
        pa.table({"is_random": side[f"{p}_is_random"], "region": side[f"{p}_region"]}) for p, side in (("a", a), ("b", b))]).combine_chunks()
    codes, known = [], []
    for name in ("is_random", "region"):
        coded = both[name].combine_chunks().dictionary_encode(null_encoding="encode")
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        # Numbered by value: the groups of a crowd that is dealt in strips must agree on which of two tags comes first.
        order = pc.sort_indices(coded.dictionary)
        rank = np.empty(len(order), np.int64)
        rank[np.asarray(order)] = np.arange(len(order))
        codes.append(rank[np.asarray(coded.indices)])
        known.append(coded.dictionary.take(order))
    packed, tag = np.unique(codes[0] * (len(known[1]) + 1) + codes[1], return_inverse=True)
    table = pa.table({"is_random": known[0].take(pa.array(packed // (len(known[1]) + 1))), "region": known[1].take(pa.array(packed % (len(known[1]) + 1)))})
    return tag[: len(a)], tag[len(a) :], table


def _column(table: pa.Table, name: str) -> pa.Array:
    return table[name].combine_chunks()


def _blocks_of(table: pa.Table, prefix: str, tag: np.ndarray) -> Blocks:
    x, y, z = (np.asarray(table[f"{prefix}_{axis}"].to_numpy(), np.float64) for axis in "xyz")
    return make_blocks(x, y, z, _column(table, f"{prefix}_weight"), table[f"{prefix}_n"].to_numpy(), tag)


def _result(found: PairSums, tags: pa.Table, schema: pa.Schema) -> pa.Table:
    """One row for each bin and pair of tags, `weighted` NULL where no pair has a weight."""
    rows = list(found.sums.items())
    of = [pa.array([key[k] for key, _ in rows], pa.int64()) for k in (1, 2)]
    columns = [pa.array([key[0] for key, _ in rows], pa.int32())]
    columns += [tags["is_random"].take(at) for at in of] + [tags["region"].take(at) for at in of]
    columns += [pa.array([one[0] if one[2] else None for _, one in rows], pa.float64()), pa.array([one[1] for _, one in rows], pa.int64())]
    return pa.table([pa.chunked_array([c]) if isinstance(c, pa.Array) else c for c in columns], names=schema.names).cast(schema)


def _of_result(region_type: str, is_random_type: str) -> str:
    return (f"bin int, a_is_random {is_random_type}, b_is_random {is_random_type}, a_region {region_type}, b_region {region_type}, "
            "weighted double, pairs bigint")


def _arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def _tasks(df: DataFrame) -> int:
    """A few kilobytes of points can be millions of pairs: the number of tasks does not follow from the bytes."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def group_sums(a: DataFrame, b: DataFrame, keys: list[str], bins: Bins, upper_closed: bool, once: bool) -> DataFrame:
    """Sums over the pairs (row of a, row of b) that share `keys`: `bin`, the tags of both sides, `weighted`, `pairs`.

    Sides have `x`, `y`, `z`, `weight`, `n`, `is_random` and `region`, prefixed `a_` and `b_`.  With `once` b has `b_same` too, whether the row is
    in its own group, where a has the same rows: unordered pairs are then to be counted twice within data and within random, and data-random
    ones once.  A point with itself is among them, once.  Rows of a group are in the memory of one task.
    """
    kinds = {field.name: field.dataType.simpleString() for field in a.schema.fields}
    schema = _of_result(kinds["a_region"], kinds["a_is_random"])
    arrow = _arrow(schema)
    edges2 = bins.edges2

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = PairSums(edges2, upper_closed)
        if not len(left) or not len(right):
            return arrow.empty_table()
        tag_a, tag_b, tags = _tags(left, right)
        first = _blocks_of(left, "a", tag_a)
        same = np.asarray(right["b_same"].to_numpy(), bool) if once else np.zeros(len(right), bool)
        kind = np.asarray(tags["is_random"].to_numpy())
        for own in (False, True):
            rows = np.flatnonzero(same == own)
            if not len(rows):
                continue
            second = _blocks_of(right.take(pa.array(rows)), "b", tag_b[rows])
            factor = np.ones((len(first), len(second)), np.int64)
            if once:
                one, other = first.tag[:, None], second.tag[None, :]
                factor = np.where(kind[one] == kind[other], 2, 1)
                if own:
                    # Both orders of a pair meet here: those of one tag count as they are, of two tags one order does.
                    factor = np.where(one == other, 1, np.where(one < other, factor, 0))
            found.meet(first, second, factor)
        return _result(found, tags, arrow)

    columns = [f"{{}}_{name}" for name in (*_NAMES, "is_random", "region")]
    sides = []
    for side, prefix in ((a, "a"), (b, "b")):
        extra = ["b_same"] if once and prefix == "b" else []
        side = side.withColumn(f"{prefix}_weight", F.col(f"{prefix}_weight").cast("double"))
        sides.append(side.select(*keys, *[name.format(prefix) for name in columns], *extra).repartition(_tasks(a), *keys).groupBy(*keys))
    return sides[0].cogroup(sides[1]).applyInArrow(run, schema)


def leaf_sums(a: DataFrame, b: DataFrame, key: str, bins: Bins, upper_closed: bool) -> DataFrame:
    """Sums over chosen pairs of leaves, as `group_sums` gives them.

    Sides have `key`, the tags and `x`, `y`, `z`, `weight`, `n` as arrays, one row a leaf, prefixed `a_` and `b_`.  a has a struct `a_leaf` that names each leaf,
    b has `b_partners`: structs of such a `leaf` and `factor`, how often each pair of points counts.
    """
    kinds = {field.name: field.dataType.simpleString() for field in a.schema.fields}
    schema = _of_result(kinds["a_region"], kinds["a_is_random"])
    arrow = _arrow(schema)
    edges2 = bins.edges2

    def made(table: pa.Table, prefix: str, tag: np.ndarray) -> Iterator[Blocks]:
        columns = [_column(table, f"{prefix}_{name}") for name in _NAMES]
        for row in range(len(table)):
            x, y, z, weight, n = (column[row].values for column in columns)
            yield make_blocks(np.asarray(x), np.asarray(y), np.asarray(z), weight, np.asarray(n), np.full(len(x), tag[row]))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return arrow.empty_table()
        found = PairSums(edges2, upper_closed)
        tag_a, tag_b, tags = _tags(left, right)
        named = lambda leaf: tuple(leaf.values())
        leaves = dict(zip(map(named, left["a_leaf"].to_pylist()), made(left, "a", tag_a)))
        for partners, second in zip(right["b_partners"].to_pylist(), made(right, "b", tag_b)):
            for one in partners:
                first = leaves[named(one["leaf"])]
                found.meet(first, second, np.full((len(first), len(second)), one["factor"]))
        return _result(found, tags, arrow)

    sides = [side.repartition(_tasks(a), key).groupBy(key) for side in (a, b)]
    return sides[0].cogroup(sides[1]).applyInArrow(run, schema)
