"""Nearest neighbours by a permutation index, with an exact end.

Some vectors are pivots.  Every vector is represented by the order of the pivots by nearness, and posted under each pivot with
the place the pivot has in its order: a block of vectors is a set of inverted files, one per pivot.  A query adds up, file
after file, how far its own places lie from the posted ones (the footrule distance of the orders), and scores the nearest share
of the block by exact cosine.  The last of its best is then the mark that any other row must reach: vectors that have the same pivot
first lie in a cone around it, cones too far off are passed over, and all rows of the others are held against the mark.  So
the order decides how much is skipped and never the result.  Queries and vectors meet block by block; a block has a
bounded number of rows whatever the data, and gives back only the few best of each query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skylattice.llm.common import read

PIVOTS = 120
#: Rows of a block of vectors and of a block of queries, about.
BLOCK_ROWS, QUERY_ROWS = 12_000, 4_000
#: Share of a block that is scored first.
CANDIDATES = 0.08


def usable(vector: Column) -> Column:
    """True for a vector that can have a cosine: not NULL, no NULL or non-finite component, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def choose_pivots(vectors: DataFrame, key: str, vector: str, count: int = PIVOTS) -> np.ndarray:
    """At most `count` unit vectors that lie apart: of a fixed pseudo-random choice of 8 * `count` rows, always the one farthest from those taken."""
    rows = vectors.orderBy(F.xxhash64(key), key).limit(8 * count).select(vector).collect()
    if not rows:
        return np.zeros((0, 0))
    size = max(set(lengths := [len(row[0]) for row in rows]), key=lambda n: (lengths.count(n), n))
    units = _unit(np.array([row[0] for row in rows if len(row[0]) == size], float))
    taken, nearest = [0], units @ units[0]
    # Copies of a taken direction, rescaled or not, have a cosine of 1 up to rounding.
    while len(taken) < count and nearest.min() < 1 - 1e-9:
        taken.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, units @ units[taken[-1]])
    return units[taken]


def _unit(vectors: np.ndarray) -> np.ndarray:
    # Scaled first, so that squares of very large or small components do not overflow or vanish.
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def build_index(vectors: DataFrame, pivots: np.ndarray, key: str, vector: str) -> DataFrame:
    """(`_id`, `_vector`, `_places`): packed components, and the place of each pivot in the order by nearness."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            near = _unit(rows) @ shared.value.T
            places = np.argsort(np.argsort(-near, axis=1, kind="stable"), axis=1, kind="stable").astype(np.int8)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([row.tobytes() for row in rows]), pa.array([row.tobytes() for row in places])],
                names=["_id", "_vector", "_places"],
            )

    kept = vectors.where(F.size(vector) == pivots.shape[1]).select(F.col(key).cast("bigint").alias("_id"), vector)
    return kept.mapInArrow(run, "_id bigint, _vector binary, _places binary")


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


def _search(queries: pd.DataFrame, block: pd.DataFrame, pivots: np.ndarray, count: int, share: float) -> pd.DataFrame:
    """The best `count` rows of a block for each query, as (query_id, vec_id, score)."""
    empty = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
    if not len(queries) or not len(block):
        return empty
    # Of equal vectors only the smallest ids can be among the best, one more than asked for as a query leaves itself out.
    block = block.sort_values("_id", kind="stable")
    block = block[block.groupby("_vector", sort=False).cumcount() <= count]
    # Rows that have the same pivot first stand together.
    first = np.frombuffer(b"".join(block["_places"]), np.int8).reshape(len(block), -1).argmin(axis=1)
    order = np.argsort(first, kind="stable")
    block, first = block.iloc[order], first[order]
    ids = block["_id"].to_numpy()
    raw = np.frombuffer(b"".join(block["_vector"]), float).reshape(len(block), -1)
    size = np.abs(raw).max(axis=1, keepdims=True)
    vectors = raw / size
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    units = vectors / norms[:, None]
    # The cones: first row, pivot, and the largest angle to the pivot.
    starts = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1])))
    ends, centres = np.append(starts[1:], len(ids)), pivots[first[starts]]
    reach = np.maximum.reduceat(_angles((units * pivots[first]).sum(axis=1)), starts)
    # What rounding can do to a cosine, and to an angle (most where the cosine is about 1).
    slack, angle_slack = 16 * raw.shape[1] * np.finfo(float).eps, 1e-5
    # The inverted files: one row for each pivot.
    posted = np.ascontiguousarray(np.frombuffer(b"".join(block["_places"]), np.int8).reshape(len(block), -1).T)
    wanted = min(len(ids), max(50 * count, int(share * len(ids))))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for own, vector, places in zip(queries["_id"].to_numpy(), queries["_vector"], queries["_places"]):
        apart = np.abs(posted - np.frombuffer(places, np.int8)[:, None]).sum(axis=0, dtype=np.int32)
        near = np.argpartition(apart, wanted - 1)[:wanted] if wanted < len(ids) else np.arange(len(ids))
        query = np.frombuffer(vector, float)
        query = query / np.abs(query).max()
        length = np.sqrt((query * query).sum())

        def scores(rows: np.ndarray) -> np.ndarray:
            # Row by row, so that equal vectors get equal scores wherever they stand.
            return (vectors[rows] * query).sum(axis=1) / (norms[rows] * length)

        near = near[ids[near] != own]
        if wanted < len(ids):
            mark = np.partition(scores(near), -count)[-count]
            open_ = _angles(centres @ query / length) - reach <= _angles(mark) + angle_slack
            if open_.all():
                near = np.flatnonzero(units @ query / length >= mark - slack)
            else:
                near = np.concatenate(
                    [start + np.flatnonzero(units[start:end] @ query / length >= mark - slack) for start, end in zip(starts[open_], ends[open_])]
                )
            near = near[ids[near] != own]
        score = scores(near)
        best = np.lexsort((ids[near], -score))[:count]
        found.append((np.full(len(best), own), ids[near][best], score[best]))
    columns = [np.concatenate(parts) for parts in zip(*found)]
    return pd.DataFrame(dict(zip(empty.columns, columns)))


def search(
    vectors: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", count: int = 5, share: float = CANDIDATES
) -> DataFrame:
    """(`query_id`, `rank`, `vec_id`, `score`): the `count` nearest rows for every row where `queries` holds.

    No nearer row is missed.  Nearness is the cosine, ties go to the smaller key, a query is not its own neighbour.  Rows without a usable vector (see
    `usable`), with a NULL key or with a number of components other than most take no part.  Rows that share a key
    must be the same.  With fewer rows than asked for all are returned; an empty table gives an empty result.
    """
    rows = vectors.where(usable(F.col(vector)) & F.col(key).isNotNull()).withColumn("_query", queries).dropDuplicates([key])
    rows = rows.select(key, vector, "_query")
    pivots = choose_pivots(rows, key, vector)
    result = "query_id bigint, vec_id bigint, score double"
    if not len(pivots):
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    index = build_index(rows, pivots, key, vector)
    asked = build_index(rows.where("_query"), pivots, key, vector)
    total, n_asked = rows.agg(F.count("*"), F.count_if("_query")).head()
    blocks, parts = -(-total // BLOCK_ROWS), max(1, -(-n_asked // QUERY_ROWS))

    def cell(salt: str, n: int) -> Column:
        return F.pmod(F.xxhash64("_id", F.lit(salt)), F.lit(n)).cast("int")

    # Every block of vectors meets every block of queries.
    left = asked.withColumns({"_part": cell("q", parts), "_block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    right = index.withColumns({"_block": cell("v", blocks), "_part": F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))})
    found = (
        left.groupBy("_part", "_block").cogroup(right.groupBy("_part", "_block"))
        .applyInPandas(lambda a, b: _search(a, b, pivots, count, share), result)
    )
    place = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= count)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
