"""What several operators share: text batches for Arrow functions, the training fold, global ranks, lineage cuts."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skylattice.session import checkpointed, scratch_folder

#: The characters between words, as a regular expression class.
BLANK = r"\x20\x09-\x0D"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def held_out(key: str) -> Column:
    """True for the third of the keys that no model may learn from; false for a NULL key."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def keep_about(key: Column, wanted: Column) -> Column:
    """A fixed pseudo-random choice of rows: true for the share `wanted` (0 to 1) of the keys."""
    return F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) < wanted * (1 << 30)


def slices(batch: pa.RecordBatch, text: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part has at most `most` bytes of text, or a single row."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    start = 0
    while start < len(lengths):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def laid_out(flat: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(runs of these sizes, which lie one behind the other, in this order; where each begins, and the end)."""
    ends = np.concatenate(([0], np.cumsum(sizes[order])))
    starts = np.cumsum(sizes) - sizes
    return flat[np.repeat(starts[order] - ends[:-1], sizes[order]) + np.arange(ends[-1])], ends


def give_back() -> None:
    """Return unused memory of this process to the system: what a driver has learned from stays with it otherwise."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def map_texts(
    df: DataFrame, schema: str, work: Callable[[list[str | None]], list], text: str = "text", keep: bool = False, most: int = 2_000_000
) -> DataFrame:
    """Add the columns of `schema`, computed from whole texts in bounded parts; the text column is left out unless `keep`.

    `work` gets a list of texts and returns one list or array for each new column.
    """
    kept = [name for name in df.columns if keep or name != text]
    fields = [f"`{name}` {df.schema[name].dataType.simpleString()}" for name in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = None
        for batch in batches:
            for part in slices(batch, text, most):
                found = work(part.column(text).to_pylist())
                types = types or [pa_type(kind) for kind in schema_types]
                yield pa.RecordBatch.from_arrays(
                    [part.column(name) for name in kept] + [pa.array(x, type=t) for x, t in zip(found, types)],
                    names=[*kept, *schema_names],
                )

    pieces = [piece.strip().split(" ", 1) for piece in schema.split(";")]
    schema_names, schema_types = [piece[0] for piece in pieces], [piece[1] for piece in pieces]
    return df.mapInArrow(run, ", ".join(fields + [f"{name} {kind}" for name, kind in pieces]))


def numbered_columns(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The same rows with their columns named by place (`in0`, `in1`, ...), and those names by the columns' own.

    Working columns start with `_`, so none can clash with a column of the table; `toDF` with the old names puts them back.
    """
    names = {name: f"in{place}" for place, name in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def pa_type(kind: str) -> pa.DataType:
    simple = {
        "string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(),
        "binary": pa.binary(), "float": pa.float32(),
    }
    if kind.startswith("array<") and kind.endswith(">"):
        return pa.list_(pa_type(kind[6:-1]))
    if kind.startswith("struct<"):
        parts = [part.split(":") for part in kind[7:-1].split(",")]
        return pa.struct([(name, pa_type(part)) for name, part in parts])
    return simple[kind]


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to the shared folder as Parquet and read again: smaller than a checkpoint for many rows."""
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def ranked(df: DataFrame, order: list[Column], out: str = "rank") -> DataFrame:
    """Number the rows from 0 in a total order, without a window over the whole table.

    The sorted rows are written to the shared folder once, so that the partition sizes and the rows agree; each row then
    has its place in its partition plus the sizes of the partitions before.  Meant for narrow rows.
    """
    placed = checkpointed(df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = sizes.select(
        "_part", (F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_rows")).alias("_before")
    )
    return (
        placed.withColumn("_part", part)
        .join(before, "_part")
        .withColumn(out, F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_part", "_place", "_before")
    )
