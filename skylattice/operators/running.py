"""Running totals over ordered groups of any size, with one shuffle.

Rows are dealt by sampled ranges of the order, so a group is split where it is large.  Each partition makes one pass over its sorted rows
and is written to the shared folder together with the number of the partition; the last row of each partition says what its last group has so far.
Those rows, one a partition, are added up on the driver and given to the partitions behind.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.session import scratch_folder


def running(
    df: DataFrame, keys: list[str], order: list[str], sums: dict[str, str] | None = None, xors: dict[str, str] | None = None, spread: bool = False
) -> DataFrame:
    """Add totals over all rows of the same `keys` up to and with the own row, in ascending `order` (NULLs first).

    `sums` and `xors` map new column -> column of whole numbers or, for sums, doubles; their NULLs count as 0.  Keys must not be NULL.  Rows that are equal in
    `order` come in any order among themselves; with `spread` they are dealt over partitions, too (for tables where a large share of the
    rows may be equal in it).
    """
    session = df.sparkSession
    sums, xors = sums or {}, xors or {}
    plain = list(df.columns)
    by = [*keys, *order] + ["_spread"] * spread
    if spread:
        df = df.withColumn("_spread", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1024)).cast("int"))
    kinds = {new: df.schema[old].dataType.simpleString() for new, old in {**sums, **xors}.items()}
    kinds = {new: "double" if kind in ("double", "float") else "bigint" for new, kind in kinds.items()}
    fields = [f"`{name}` {df.schema[name].dataType.simpleString()}" for name in plain]
    fields += [f"`{name}` {kind}" for name, kind in kinds.items()] + ["_part int", "_last boolean"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, state, waiting = TaskContext.get().partitionId(), None, None

        def out(batch: pa.RecordBatch, columns: dict[str, np.ndarray], last: bool) -> pa.RecordBatch:
            flags = np.zeros(batch.num_rows, bool)
            flags[-1] = last
            arrays = [batch.column(name) for name in plain] + [pa.array(column) for column in columns.values()]
            arrays += [pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(flags)]
            return pa.RecordBatch.from_arrays(arrays, names=[*plain, *columns, "_part", "_last"])

        for batch in batches:
            count = batch.num_rows
            if not count:
                continue
            if waiting is not None:
                yield out(*waiting, False)
            start = np.zeros(count, bool)
            firsts = []
            for key in keys:
                values = batch.column(key).to_numpy(zero_copy_only=False)
                start[1:] |= values[1:] != values[:-1]
                firsts.append((values[0], values[-1]))
            goes_on = state is not None and all(first == old for (first, _), old in zip(firsts, state[0]))
            start[0] = True
            place = np.flatnonzero(start)
            group = np.cumsum(start) - 1
            columns = {}
            for new, old in {**sums, **xors}.items():
                kind = np.float64 if kinds[new] == "double" else np.int64
                values = batch.column(old).fill_null(0).to_numpy(zero_copy_only=False).astype(kind)
                if goes_on:
                    values = values.copy()
                    values[0] = values[0] ^ state[1][new] if new in xors else values[0] + state[1][new]
                if new in xors:
                    total = np.bitwise_xor.accumulate(values)
                    columns[new] = total ^ (total[place] ^ values[place])[group]
                elif kind is np.float64 and len(place) > 1:
                    # Each group on its own: a difference of totals would not give the same doubles.
                    columns[new] = np.concatenate([np.cumsum(one) for one in np.split(values, place[1:])])
                else:
                    total = np.cumsum(values)
                    columns[new] = total - (total[place] - values[place])[group]
            state = ([last for _, last in firsts], {new: column[-1] for new, column in columns.items()})
            waiting = (batch, columns)
        if waiting is not None:
            yield out(*waiting, True)

    path = scratch_folder(session, "running")
    df.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(run, ", ".join(fields)).write.parquet(path)
    found = session.read.parquet(path)
    # One row for each partition that has rows.
    ends = sorted(found.where("_last").select("_part", *keys, *kinds).collect(), key=lambda row: row["_part"])
    carried = []
    for before, row in zip(ends, ends[1:]):
        same = bool(carried) and all(before[key] == carried[-1][f"_before_{key}"] for key in keys)
        entry = {"_at": row["_part"], **{f"_before_{key}": before[key] for key in keys}}
        for new in kinds:
            join = operator.xor if new in xors else operator.add
            entry[f"_more_{new}"] = join(before[new], carried[-1][f"_more_{new}"]) if same else before[new]
        carried.append(entry)
    kept = [*plain, *kinds]
    if not carried:
        return found.select(*kept)
    schema = ["_at int"] + [f"`_before_{key}` {df.schema[key].dataType.simpleString()}" for key in keys] + [f"`_more_{new}` {kind}" for new, kind in kinds.items()]
    table = F.broadcast(session.createDataFrame(carried, ", ".join(schema)))
    joined = found.join(table, F.col("_part") == F.col("_at"), "left")
    continues = F.col("_at").isNotNull()
    for key in keys:
        continues &= F.col(key) == F.col(f"_before_{key}")
    for new in kinds:
        more = F.col(f"_more_{new}")
        joined = joined.withColumn(new, F.when(continues, F.col(new).bitwiseXOR(more) if new in xors else F.col(new) + more).otherwise(F.col(new)))
    return joined.select(*kept)
