"""Running totals and ranks over large ordered groups without a large window.

A window over a whole group runs in one task.  Here positions are integers, and the group is cut in blocks of
2^16 positions: block totals are accumulated first (recursively, while the blocks are many), then each block adds its
own running total.  With one row per position no window ever holds more than 2^16 rows, whatever the data.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice.functions.cells import with_centre

BLOCK_BITS = 16


def prefix_sum(
    df: DataFrame, keys: list[str], position: str, values: dict[str, str], bits: int, low_bits: int = 0
) -> DataFrame:
    """Add, per group of `keys`, the sum of a value over all smaller positions.

    `values` maps new column -> summed column.  Rows must be unique per (keys, position); rows with a NULL key or
    position are dropped.  Positions are below 2^(low_bits + bits); the lowest `low_bits` are expected to be equal
    everywhere (a wrong guess costs only balance).
    """
    if not keys:
        return prefix_sum(df.withColumn("_all", F.lit(0)), ["_all"], position, values, bits, low_bits).drop("_all")
    levels = max(1, math.ceil(bits / BLOCK_BITS))
    if levels == 1:
        window = Window.partitionBy(*keys).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({new: F.coalesce(F.sum(old).over(window), F.lit(0)) for new, old in values.items()})
    step = math.ceil(bits / levels)
    block = f"_block{levels}"
    # One shuffle serves the totals, the join and the window below.  It is run once only if both uses of it stay
    # identical: so NULLs go before it (the join would filter them on its side), the block is never NULL, and the
    # totals look at every column (or pruning would narrow their side).
    df = df.dropna(subset=[*keys, position])
    df = df.withColumn(block, F.coalesce(F.shiftright(F.col(position), low_bits + step), F.lit(0)))
    df = df.repartition(*keys, block)
    totals = df.groupBy(*keys, block).agg(
        *[F.sum(old).alias(f"_total_{new}") for new, old in values.items()], F.max(F.xxhash64(*df.columns)).alias("_seen")
    ).where("_seen IS NOT NULL").drop("_seen")
    carry = prefix_sum(totals, keys, block, {f"_carry_{new}": f"_total_{new}" for new in values}, bits - step)
    carry = carry.select(*keys, block, *[f"_carry_{new}" for new in values])
    window = Window.partitionBy(*keys, block).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(carry, [*keys, block])
        .withColumns({
            new: F.col(f"_carry_{new}") + F.coalesce(F.sum(old).over(window), F.lit(0)) for new, old in values.items()
        })
        .drop(block, *[f"_carry_{new}" for new in values])
    )


def global_rank(df: DataFrame, position: str, bits: int, keys: list[str] | None = None, out: str = "rank") -> DataFrame:
    """0-based rank of each row by a unique integer position."""
    ranked = prefix_sum(df.withColumn("_one", F.lit(1).cast("bigint")), keys or [], position, {out: "_one"}, bits)
    return ranked.drop("_one")


def _rank_in_slices(df: DataFrame, keys: list[str], slice_position: str, bits: int, order: list[Column], out: str) -> DataFrame:
    """Rank by (slice, then `order`): rows before the slice plus the place in it.  Slices must be small."""
    counts = df.groupBy(*keys, slice_position).agg(F.count("*").alias("_count"))
    before = prefix_sum(counts, keys, slice_position, {"_before": "_count"}, bits).drop("_count")
    window = Window.partitionBy(*keys, slice_position).orderBy(*order)
    return (
        df.join(before, [*keys, slice_position])
        .withColumn(out, F.col("_before") + F.row_number().over(window) - 1)
        .drop("_before")
    )


def rank_label(rank: Column, size: Column, pieces: int = 32) -> Column:
    """Label of a rank: rank div (size div pieces).

    Integer division can leave up to twice as many labels as pieces; a table with fewer rows than pieces gets its rank.
    """
    return F.floor(rank / F.greatest(F.floor(size / F.lit(pieces)), F.lit(1)))


def equal_runs(rank: Column, size: Column, pieces: int) -> Column:
    """Piece 0..pieces-1 of a rank when piece i starts at size * i div pieces."""
    return F.floor(((rank + 1) * pieces - 1) / size)


def contiguous_regions(mask: DataFrame, order: int, count: int, pix: str = "pix_nest") -> DataFrame:
    """All mask cells in id order cut in `count` runs whose lengths differ by one at most; (`pix_nest`, `region`)."""
    cells = mask.select(F.col(pix).alias("pix_nest")).distinct()
    ranked = global_rank(cells, "pix_nest", 2 * order + 4)
    size = cells.agg(F.count("*")).scalar()
    return ranked.select("pix_nest", equal_runs(F.col("rank"), size, count).cast("int").alias("region"))


def tile_shape(count: int) -> tuple[int, int]:
    """(stripes, pieces per stripe) whose product is the wanted number of regions, as near to a square as its divisors allow."""
    pieces = next(n for n in range(math.isqrt(count), 0, -1) if count % n == 0)
    return count // pieces, pieces


def tiled_regions(mask: DataFrame, order: int, count: int, pix: str = "pix_nest") -> DataFrame:
    """Equal-count tiles: stripes in longitude, each cut in pieces in colatitude; (`pix_nest`, `stripe`, `piece`, `region`)."""
    stripes, pieces = tile_shape(count)
    nside = 1 << order
    cells = mask.select(F.col(pix).alias("pix_nest")).distinct()
    size = cells.agg(F.count("*")).scalar()
    cells = with_centre(cells, order, "pix_nest")
    # A slice of longitude as wide as one equatorial cell crosses every ring once or so: a few thousand rows at most.
    cells = cells.withColumn("_slice", F.floor(F.col("phi") * (4 * nside / (2 * math.pi))))
    ranked = _rank_in_slices(cells, [], "_slice", order + 3, [F.col("phi"), F.col("pix_nest")], "_rank")
    ranked = ranked.withColumn("stripe", equal_runs(F.col("_rank"), size, stripes).cast("int"))
    # One ring of one stripe is bounded by the ring length.
    ranked = ranked.withColumn("_ring", F.floor(F.col("theta") * (4 * nside / math.pi)))
    within = _rank_in_slices(ranked, ["stripe"], "_ring", order + 3, [F.col("theta"), F.col("_rank")], "_place")
    ends = [F.floor(size * (F.col("stripe") + F.lit(step)) / F.lit(stripes)) for step in (0, 1)]
    return (
        within.withColumn("_size", ends[1] - ends[0])
        .withColumn("piece", equal_runs(F.col("_place"), F.col("_size"), pieces).cast("int"))
        .select("pix_nest", "stripe", "piece", (F.col("stripe") * pieces + F.col("piece")).alias("region"))
    )
