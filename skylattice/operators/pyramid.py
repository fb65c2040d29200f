"""Pair counts by a count pyramid: work follows the edges of the bins and not the number of pairs.

The nested cells are a tree.  Each node has the number and weight of its points and the box around them, so the least and the greatest separation of two
nodes are known without their points.  A pair of nodes whose separations all fall in one bin is counted by products; one that lies outside all bins
leaves; only the others are split, level by level, down to leaves of some hundred points, which `blocks` compares.  The
separations of boxes and of points are made by the same operations in the same order, and rounding keeps order, so the counts are those of all pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.functions.bins import Bins
from skylattice.functions.cells import with_nest
from skylattice.operators.blocks import leaf_sums
from skylattice.operators.paircount import KINDS, _prefixed, as_points, by_kind, merge_copies, with_empty_bins
from skylattice.session import checkpointed

FINEST = 29
TAGS = ["is_random", "region"]
_BOX = [f"{side}_{axis}" for axis in "xyz" for side in ("lo", "hi")]
_SUMMARY = ["n", "weight", "rows", *_BOX]


@dataclass
class PairSums:
    """`sums` as of `paircount.pair_sums`; `account`: (`how`, `node_pairs`, `pairs`) with how counted, outside, points.

    The `pairs` of the account add up to all pairs of rows: ordered ones within data and within random, data-random ones once.
    """

    sums: DataFrame
    account: DataFrame


def _merged_nodes(nodes: DataFrame, node: Column) -> DataFrame:
    """Summaries of the nodes or points that share `node`."""
    edges = [F.min(name).alias(name) if name.startswith("lo") else F.max(name).alias(name) for name in _BOX]
    return nodes.groupBy(*TAGS, node.alias("node")).agg(F.sum("n").alias("n"), F.sum("weight").alias("weight"), F.sum("rows").alias("rows"), *edges)


def count_tree(points: DataFrame, leaf_rows: int, top: int) -> tuple[DataFrame, DataFrame]:
    """The nodes of the trees of each tag, and the points with their leaf.

    Nodes: `is_random`, `region`, `node` (4 * 4^order + cell, so the children of a node are 4 * node + 0 .. 3), `n`, `weight`, `rows`, the box and `leaf`.
    Leaves are at one order, but where a node has more than `leaf_rows` positions it is split further.  Orders above `top` are left out.
    """
    placed = with_nest(merge_copies(points, *TAGS), FINEST, "pix29", vector=("x", "y", "z"))
    box = {f"{side}_{axis}": F.col(axis) for axis in "xyz" for side in ("lo", "hi")}
    placed = checkpointed(placed.select(*TAGS, "x", "y", "z", "weight", "n", "pix29", F.lit(1).cast("bigint").alias("rows")))
    total, order = placed.count(), top
    while order < FINEST and 6 * leaf_rows << 2 * order < total:
        order += 1
    at = lambda order: F.lit(4 << 2 * order) + F.shiftright("pix29", 2 * (FINEST - order))
    first, levels, settled, rest = order, [], [], placed
    while True:
        nodes = _merged_nodes(rest.withColumns(box), at(order))
        nodes = checkpointed(nodes.withColumn("leaf", (F.col("rows") <= leaf_rows) | F.lit(order == FINEST)))
        levels.append(nodes)
        crowded = nodes.where("NOT leaf").select(*TAGS, "node")
        rest = rest.withColumn("node", at(order))
        if not crowded.limit(1).count():
            settled.append(rest)
            break
        settled.append(rest.join(crowded, [*TAGS, "node"], "left_anti"))
        rest = rest.join(crowded, [*TAGS, "node"], "left_semi").drop("node")
        order += 1
    up = levels[0]
    for _ in range(first - top):
        up = _merged_nodes(up, F.shiftright("node", 2)).withColumn("leaf", F.lit(False))
        levels.append(up)
    nodes, leaves = levels[0], None
    for level in levels[1:]:
        nodes = nodes.unionByName(level)
    for part in settled:
        part = part.select(*TAGS, "node", "x", "y", "z", "weight", "n")
        leaves = part if leaves is None else leaves.unionByName(part)
    return checkpointed(nodes), checkpointed(leaves)


def _squared(parts: list[str]) -> Column:
    """The sum of squares in the order in which `proximity.D2` adds them."""
    return F.expr(" + ".join(f"({part}) * ({part})" for part in parts))


def _separations() -> tuple[Column, Column]:
    """Squares of the least and the greatest separation of the boxes of a and b."""
    least = [f"greatest(0D, a_lo_{axis} - b_hi_{axis}, b_lo_{axis} - a_hi_{axis})" for axis in "xyz"]
    most = [f"greatest(a_hi_{axis} - b_lo_{axis}, b_hi_{axis} - a_lo_{axis})" for axis in "xyz"]
    return _squared(least), _squared(most)


def pyramid_sums(
    points: DataFrame, bins: Bins, upper_closed: bool = False, kinds: tuple[str, ...] = KINDS, leaf_rows: int = 2048, top: int = 1
) -> PairSums:
    """The result of `paircount.pair_sums` for the same points, or for some of its `kinds`, without meeting every pair."""
    nodes, leaves = count_tree(points, leaf_rows, top)
    a, b = _prefixed(nodes.select(*TAGS, "node", *_SUMMARY, "leaf"), "a_"), _prefixed(nodes.select(*TAGS, "node", *_SUMMARY, "leaf"), "b_")
    keys_a, keys_b = [f"a_{name}" for name in (*TAGS, "node")], [f"b_{name}" for name in (*TAGS, "node")]
    start, stop = 4 << 2 * top, 16 << 2 * top
    wanted = (F.col("a_is_random") + F.col("b_is_random")).isin([KINDS.index(kind) for kind in kinds])
    tops = nodes.where((F.col("node") >= start) & (F.col("node") < stop)).select(*TAGS, "node")
    tops_a = _prefixed(tops, "a_").withColumn("b_node", F.explode(F.expr(f"sequence({start}L, {stop - 1}L)")))
    ordered = F.struct(*keys_a) <= F.struct(*keys_b)
    pairs = checkpointed(tops_a.join(_prefixed(tops, "b_"), "b_node").where(wanted & ordered).select(*keys_a, *keys_b))
    same = F.lit(True)
    for one, other in zip(keys_a, keys_b):
        same &= F.col(one) == F.col(other)
    # An unordered pair within data or within random is met once and counts twice.
    times = F.when(same | (F.col("a_is_random") != F.col("b_is_random")), 1).otherwise(2)
    group = [
        (F.col("a_is_random") + F.col("b_is_random")).alias("kind"), F.col("bin"),
        F.least("a_region", "b_region").alias("region_1"), F.greatest("a_region", "b_region").alias("region_2"),
    ]
    sums = [F.sum(times * F.col("a_weight") * F.col("b_weight")).alias("weighted"), F.sum(times * F.col("a_n") * F.col("b_n")).alias("pairs")]
    low, high = (F.lit(bins.edges2[i]) for i in (0, -1))
    least, most = _separations()
    counted, accounts, open_leaves = [], [], []
    while pairs.limit(1).count():
        met = pairs.join(a, keys_a).join(b, keys_b).withColumns({"least": least, "most": most})
        outside = (F.col("most") <= low) | (F.col("least") > high) if upper_closed else (F.col("most") < low) | (F.col("least") >= high)
        first, last = bins.of_chord2(F.col("least"), upper_closed), bins.of_chord2(F.col("most"), upper_closed)
        met = met.withColumns({"bin": first, "last": last})
        how = F.when(outside, "outside").when(F.col("bin") == F.col("last"), "counted").when(F.col("a_leaf") & F.col("b_leaf"), "points").otherwise("split")
        met = checkpointed(met.withColumn("how", how).select(*keys_a, *keys_b, "a_leaf", "b_leaf", "a_n", "b_n", "a_weight", "b_weight", "bin", "how"))
        counted.append(met.where("how = 'counted'").groupBy(*group).agg(*sums))
        accounts.append(met.where("how <> 'split'").groupBy("how").agg(F.count("*").alias("node_pairs"), F.sum(times * F.col("a_n") * F.col("b_n")).alias("pairs")))
        open_leaves.append(met.where("how = 'points'").select(*keys_a, *keys_b))
        below = lambda side: F.when(F.col(f"{side}_leaf"), F.array(f"{side}_node")).otherwise(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: 4 * F.col(f"{side}_node") + i))
        split = met.where("how = 'split'").withColumn("own", same)
        split = split.withColumn("a_child", F.explode(below("a"))).withColumn("b_child", F.explode(below("b")))
        split = split.where(~F.col("own") | (F.col("a_child") <= F.col("b_child"))).drop("a_node", "b_node")
        split = split.withColumnsRenamed({"a_child": "a_node", "b_child": "b_node"}).select(*keys_a, *keys_b)
        # Only children that have points.
        pairs = checkpointed(split.join(a.select(*keys_a), keys_a, "left_semi").join(b.select(*keys_b), keys_b, "left_semi"))
    close = open_leaves[0] if open_leaves else pairs
    for part in open_leaves[1:]:
        close = close.union(part)
    found = by_kind(_near_sums(close, leaves, same, bins, upper_closed))
    for part in counted:
        found = found.unionByName(part)
    found = found.groupBy("kind", "bin", "region_1", "region_2").agg(F.sum("weighted").alias("weighted"), F.sum("pairs").alias("pairs"))
    found = found.withColumn("kind", F.get(F.array(*[F.lit(kind) for kind in KINDS]), F.col("kind").cast("int")))
    account = accounts[0] if accounts else met_nothing(points)
    for part in accounts[1:]:
        account = account.union(part)
    return PairSums(found, account.groupBy("how").agg(F.sum("node_pairs").alias("node_pairs"), F.sum("pairs").alias("pairs")))


#: Leaves that are compared in one group, as orders above theirs: up to 4^_ABOVE of them, with all their partners.
_ABOVE = 2


def _near_sums(close: DataFrame, leaves: DataFrame, same: Column, bins: Bins, upper_closed: bool) -> DataFrame:
    """Sums of the pairs of points of the leaf pairs `close`.  A leaf goes once to every group that has partners of it, with the list of them."""
    arrays = [F.col(f"_points.{name}").alias(name) for name in ("x", "y", "z", "weight", "n")]
    blocks = leaves.groupBy(*TAGS, "node").agg(F.collect_list(F.struct("x", "y", "z", "weight", "n")).alias("_points")).select(*TAGS, "node", *arrays)
    a, b = _prefixed(blocks, "a_"), _prefixed(blocks, "b_")
    group, leaf = F.shiftright("a_node", 2 * _ABOVE).alias("group"), F.struct("a_is_random", "a_region", "a_node").alias("a_leaf")
    # An unordered pair is met once, but within a leaf both orders are.
    factor = F.when(same | (F.col("a_is_random") != F.col("b_is_random")), 1).otherwise(2).alias("factor")
    partners = close.groupBy(group, "b_is_random", "b_region", "b_node").agg(F.collect_list(F.struct(leaf.alias("leaf"), factor)).alias("b_partners"))
    b = partners.join(b, ["b_is_random", "b_region", "b_node"])
    return leaf_sums(a.select(group, leaf, "*"), b, "group", bins, upper_closed)


def met_nothing(points: DataFrame) -> DataFrame:
    return points.sparkSession.createDataFrame([], "how string, node_pairs bigint, pairs bigint")


def pyramid_auto(points: DataFrame, bins: Bins, **tuning) -> DataFrame:
    """`paircount.auto_histogram` by the pyramid."""
    return with_empty_bins(pyramid_sums(as_points(points), bins, kinds=("dd",), **tuning).sums.select("bin", "weighted", "pairs"), bins)


def pyramid_cross(left: DataFrame, right: DataFrame, bins: Bins, **tuning) -> DataFrame:
    """`paircount.cross_histogram` by the pyramid."""
    both = as_points(left).unionByName(as_points(right, True))
    return with_empty_bins(pyramid_sums(both, bins, kinds=("dr",), **tuning).sums.select("bin", "weighted", "pairs"), bins)
