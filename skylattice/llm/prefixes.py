"""The prefix trie of conversations: one node for each different sequence of first turns.

Every prefix of every conversation has a digest of 128 bits, made from the digests of its turns and their places by a running exclusive or.  A count-min sketch of
those digests has cells that count up to two.  It never estimates too low, so where it says one, no other
conversation starts so: that node is written from its own row.  Only prefixes that may be shared go through a shuffle, and are
grouped exactly there.

No sum over a subtree is carried up the tree.  Where conversation c is the smallest member of a node it is so of all nodes further down its path, so a path has two
parts, up to a depth o(c) and from there on; all sums over a subtree are sums over the members of its top, of numbers that a member knows
once it knows o(c).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.llm.common import read, stored
from skylattice.operators.running import running

#: Rows of the sketch; its cells a row are twice the prefixes, at most MOST_CELLS (then fewer singletons are seen, and more rows are grouped).
SKETCH_ROWS, LEAST_CELLS, MOST_CELLS = 4, 1 << 12, 1 << 24
CHUNK = 1 << 16
#: Conversations whose ids are joined to one piece of text before it is hashed with the others of its node.
PIECE_IDS = 8192
EMPTY = hashlib.sha256(b"").hexdigest()


def numbered_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(`conv`, `pos`, `m1`, `m2`, `size`) for each turn: its number from 1 in its conversation, the digest of role and text, code points of its text.

    Turns are ordered by `turn` (NULL first), equal ones by digest.  NULL role or text is empty.  Rows without a conversation belong to none and are left out.
    Repeated rows are turns of their own.
    """
    spoken, said = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.md5(F.concat(F.length(spoken).cast("string"), F.lit(":"), spoken, said))
    halves = [F.conv(F.substring(digest, start, 16), 16, -10).cast("bigint") for start in (1, 17)]
    rows = df.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("bigint").alias("conv"), F.col(turn).alias("turn"),
        # With the first bit turned over, the halves sort like the digest in hexadecimal.
        *[half.bitwiseXOR(F.lit(-(1 << 63))).alias(name) for half, name in zip(halves, ("m1", "m2"))],
        F.length(said).cast("bigint").alias("size"), F.lit(1).cast("bigint").alias("one"),
    )
    return running(rows, ["conv"], ["turn", "m1", "m2"], sums={"pos": "one"}, spread=True).select("conv", "pos", "m1", "m2", "size")


def _cells(depth: np.ndarray, p1: np.ndarray, p2: np.ndarray, cells: int) -> list[np.ndarray]:
    """A cell in each row of the sketch."""
    x, y = p1.view(np.uint64) + depth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), p2.view(np.uint64) | np.uint64(1)
    found = []
    for row in range(SKETCH_ROWS):
        z = x + np.uint64(row) * y
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        found.append(((z ^ (z >> np.uint64(31))) & np.uint64(cells - 1)).astype(np.int64))
    return found


def _arrays(batch: pa.RecordBatch, names: list[str]) -> list[np.ndarray]:
    return [batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64) for name in names]


def _sketch(prefixes: DataFrame, cells: int) -> np.ndarray:
    """For each row of the sketch a bitmap of the cells that were counted twice or more."""
    chunk = min(CHUNK, cells)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = None
        for batch in batches:
            if batch.num_rows:
                counts = np.zeros((SKETCH_ROWS, cells), np.uint8) if counts is None else counts
                for row, places in enumerate(_cells(*_arrays(batch, ["d", "p1", "p2"]), cells)):
                    own, times = np.unique(places, return_counts=True)
                    counts[row, own] = np.minimum(counts[row, own] + np.minimum(times, 2), 2)
        if counts is not None:
            flat = counts.reshape(-1, chunk)
            for i in np.flatnonzero(flat.any(axis=1)):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(flat[i].tobytes(), 1)])], names=["chunk", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(chunk, np.uint8)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(total >= 2, bitorder="little").tobytes()])], names=["chunk", "bits"])

        for batch in batches:
            for i, one in zip(batch.column("chunk").to_pylist(), batch.column("counts")):
                if i != now:
                    if now is not None:
                        yield out()
                    now, total = i, np.zeros(chunk, np.uint8)
                total = np.minimum(total + np.frombuffer(zlib.decompress(one.as_buffer()), np.uint8), 2)
        if now is not None:
            yield out()

    parts = prefixes.select("d", "p1", "p2").mapInArrow(count, "chunk int, counts binary").repartition("chunk").sortWithinPartitions("chunk")
    bits = np.zeros((SKETCH_ROWS * cells // chunk, chunk // 8), np.uint8)
    for row in parts.mapInArrow(merge, "chunk int, bits binary").collect():  # SKETCH_ROWS * cells bits in all
        bits[row["chunk"]] = np.frombuffer(row["bits"], np.uint8)
    return bits.reshape(SKETCH_ROWS, -1)


def _screened(prefixes: DataFrame) -> DataFrame:
    """Add `maybe`, that the prefix may be shared, and `above`, that the one before it may be (the root may always be)."""
    cells = LEAST_CELLS
    rows = prefixes.count()
    while cells < min(2 * rows, MOST_CELLS):
        cells *= 2
    bits = prefixes.sparkSession.sparkContext.broadcast(_sketch(prefixes, cells))
    names = ["conv", "d", "p1", "p2", "cum", "size", "stop"]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def twice(depth: np.ndarray, p1: np.ndarray, p2: np.ndarray) -> np.ndarray:
            sure = np.ones(len(depth), bool)
            for row, places in enumerate(_cells(depth, p1, p2, cells)):
                sure &= (bits.value[row, places >> 3] >> (places & 7).astype(np.uint8) & 1).astype(bool)
            return sure

        for batch in batches:
            d, p1, p2, x1, x2 = _arrays(batch, ["d", "p1", "p2", "x1", "x2"])
            maybe, above = twice(d, p1, p2), twice(d - 1, p1 ^ x1, p2 ^ x2) | (d == 1)
            yield pa.RecordBatch.from_arrays([batch.column(name) for name in names] + [pa.array(maybe), pa.array(above)], names=[*names, "maybe", "above"])

    schema = "conv bigint, d bigint, p1 bigint, p2 bigint, cum bigint, size bigint, stop boolean, maybe boolean, above boolean"
    return prefixes.mapInArrow(look, schema)


def _hashed_lists(ends: DataFrame) -> DataFrame:
    """(`d`, `p1`, `p2`, `listed`): SHA-256 of the ascending `conv` of each node, joined by commas.

    Numbers become pieces of text where ranges of them lie; a node's pieces are then hashed one after the other as they come, so no list is ever held whole.
    """
    node = ["p1", "p2", "d"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(key: tuple, first: int, numbers: list[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (*key, first)] + [pa.array([",".join(numbers)])], names=[*node, "first", "piece"])

        now, first, numbers = None, 0, []
        for batch in batches:
            for *key, conv in zip(*[batch.column(name).to_pylist() for name in [*node, "conv"]]):
                if tuple(key) != now or len(numbers) == PIECE_IDS:
                    if numbers:
                        yield out(now, first, numbers)
                    now, first, numbers = tuple(key), conv, []
                numbers.append(str(conv))
        if numbers:
            yield out(now, first, numbers)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(keys: list[tuple], values: list[str]) -> pa.RecordBatch:
            columns = list(zip(*keys)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns] + [pa.array(values, pa.string())], names=[*node, "listed"])

        now, digest = None, None
        for batch in batches:
            keys, values = [], []
            for *key, piece in zip(*[batch.column(name).to_pylist() for name in [*node, "piece"]]):
                if tuple(key) == now:
                    digest.update(b",")
                else:
                    if now is not None:
                        keys.append(now)
                        values.append(digest.hexdigest())
                    now, digest = tuple(key), hashlib.sha256()
                digest.update(piece.encode())
            yield out(keys, values)
        if now is not None:
            yield out([now], [digest.hexdigest()])

    dealt = ends.select(*node, "conv").repartitionByRange(*node, "conv").sortWithinPartitions(*node, "conv")
    joined = dealt.mapInArrow(pieces, "p1 bigint, p2 bigint, d bigint, first bigint, piece string")
    return joined.repartition(*node).sortWithinPartitions(*node, "first").mapInArrow(whole, "p1 bigint, p2 bigint, d bigint, listed string")


def _own_hash(conv: Column) -> Column:
    return F.sha2(conv.cast("string"), 256)


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """All nodes, one row each: `conv_id` (its smallest member), `depth`, `parent_conv_id` (that of its parent; NULL for the root), `n_convs`, `n_children`,
    `n_leaves` and `saved_tokens` (over its subtree: childless nodes; code points of last texts, but for one member of each node), `ends_sha256` (of the
    members that end here).

    `turns` has `conv`, `d` (1, 2, ... in each conversation), `m1`, `m2` (digest of the turn) and `size`; `convs` one row for each conversation: `conv` and
    `n`, its number of turns (0 is a member of the root alone).  Without conversations there are no nodes.
    """
    node = ["d", "p1", "p2"]
    hashed = turns.join(convs, "conv").select(
        "conv", "d", "size", (F.col("d") == F.col("n")).alias("stop"),
        F.xxhash64("d", "m1", "m2", F.lit("first")).alias("x1"), F.xxhash64(F.lit("second"), "m2", "m1", "d").alias("x2"),
    )
    prefixes = running(hashed, ["conv"], ["d"], sums={"cum": "size"}, xors={"p1": "x1", "p2": "x2"})
    rows = stored(_screened(prefixes), "prefixes")
    zero = F.lit(0).cast("bigint")
    roots = convs.select("conv", *[zero.alias(name) for name in [*node, "cum", "size"]], (F.col("n") == 0).alias("stop"))
    shared = rows.where("maybe").select("conv", *node, "cum", "size", "stop").union(roots)
    groups = shared.groupBy(*node).agg(F.min("conv").alias("first"), F.count("*").alias("n"), F.sum(F.col("stop").cast("bigint")).alias("ends"))
    members = stored(shared.join(groups, node), "members")
    # What each conversation is the smallest member of begins below the last node that another is the smallest of.
    own = F.col("first") == F.col("conv")
    paths = members.groupBy("conv").agg(
        F.max(F.when(~own, F.struct("d", "first", "cum"))).alias("last"), F.max("stop").alias("stopped"),
        F.max(F.col("stop") & own & (F.col("n") == F.col("ends"))).alias("leaf"),
    ).select(
        "conv", (F.coalesce("last.d", F.lit(-1)) + 1).cast("bigint").alias("own_from"), F.col("last.first").alias("parent"),
        F.coalesce("last.cum", F.lit(0)).alias("shared_size"), (~F.col("stopped") | F.col("leaf")).cast("bigint").alias("leaf"),
    )
    paths = stored(paths, "paths")
    known = members.join(paths, "conv")
    parent = F.when(F.col("d") > F.col("own_from"), F.col("conv")).otherwise(F.col("parent"))
    child = (F.col("own_from") <= F.col("d") + 1) & ~F.col("stop")
    saved = F.when(F.col("d") < F.col("own_from"), F.col("shared_size") - F.col("cum") + F.col("size")).otherwise(0)
    grouped = known.groupBy(*node).agg(
        F.min("conv").alias("conv_id"), F.max(F.when(own, parent)).alias("parent_conv_id"), F.count("*").alias("n_convs"),
        F.sum(child.cast("bigint")).alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum(saved).alias("saved_tokens"),
        F.max("ends").alias("ends"), F.max(F.when(F.col("stop"), F.col("conv"))).alias("ended"),
    )
    listed = _hashed_lists(members.where(F.col("stop") & (F.col("ends") > 1)))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    grouped = grouped.join(listed, node, "left").withColumn(
        "ends_sha256", F.when(F.col("ends") == 0, F.lit(EMPTY)).when(F.col("ends") == 1, _own_hash(F.col("ended"))).otherwise(F.col("listed"))
    ).withColumnRenamed("d", "depth").select(*columns)
    # Singletons: written from their own rows, but for the parent of the first of each path.
    tails = rows.where("NOT maybe").withColumns({
        "conv_id": F.col("conv"), "depth": F.col("d"), "n_convs": F.lit(1).cast("bigint"), "n_children": F.when(F.col("stop"), 0).otherwise(1).cast("bigint"),
        "n_leaves": F.lit(1).cast("bigint"), "saved_tokens": zero, "ends_sha256": F.when(F.col("stop"), _own_hash(F.col("conv"))).otherwise(F.lit(EMPTY)),
    })
    inner = tails.where("NOT above").withColumn("parent_conv_id", F.col("conv")).select(*columns)
    tops = tails.where("above").join(paths.select("conv", "own_from", "parent"), "conv").withColumn("parent_conv_id", parent).select(*columns)
    return grouped.union(inner).union(tops)


def trie(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """`prefix_trie` of the conversations of `df` as they are (see `numbered_turns` for NULLs, ties and repeated rows; other columns are not read)."""
    turns = numbered_turns(df, conv, turn, role, text)
    return prefix_trie(turns.withColumnRenamed("pos", "d"), turns.groupBy("conv").agg(F.max("pos").alias("n")))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`turns` and `convs` of `prefix_trie` where the first turns of a conversation c are those of conversation c - c % 100.

    h = crc32(c) % 6 turns are taken from there (all if there are fewer, none if there is no such conversation), and then c's own from its turn h + 1 on.
    """
    counts = turns.groupBy("conv").agg(F.max("pos").alias("own"))
    counts = counts.withColumns({"h": F.crc32(F.col("conv").cast("string").cast("binary")) % 6, "base": F.col("conv") - F.col("conv") % 100})
    sizes = counts.where("conv = base").select("base", F.col("own").alias("n_base"))
    convs = counts.join(sizes, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = stored(convs.withColumn("n", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "conversations")
    heads = turns.where("pos <= 5 AND conv % 100 = 0").withColumnRenamed("conv", "base")
    taken = convs.select("conv", "base", "h").join(heads, "base").where("pos <= h").select("conv", F.col("pos").alias("d"), "m1", "m2", "size")
    kept = turns.join(convs.select("conv", "h", "taken"), "conv").where("pos > h")
    kept = kept.select("conv", (F.col("taken") + F.col("pos") - F.col("h")).alias("d"), "m1", "m2", "size")
    return taken.union(kept), convs.select("conv", "n")


OP12_SQL = """
WITH bits AS (
    SELECT list(v ORDER BY i) AS t FROM (
        SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v
        FROM range(256) r(i))
), turns AS (
    SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS x, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS m
    FROM conversations WHERE conv_id IS NOT NULL
), numbered AS (
    SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, m) AS pos FROM turns
), ids AS (
    SELECT c, c - c % 100 AS base, xor(4294967295, list_reduce(
        list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
        lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) % 6 AS h
    FROM (SELECT DISTINCT c FROM turns), bits
), heads AS (
    SELECT ids.c, pos AS d, r, x, m FROM ids JOIN numbered n ON n.c = ids.base AND pos <= h
), taken AS (
    SELECT ids.c, h, count(heads.c) AS k FROM ids LEFT JOIN heads ON heads.c = ids.c GROUP BY ALL
), seq AS (
    SELECT * FROM heads
    UNION ALL SELECT n.c, k + pos - h AS d, r, x, m FROM numbered n JOIN taken USING (c) WHERE pos > h
), ends AS (
    SELECT taken.c, coalesce(max(d), 0) AS n FROM taken LEFT JOIN seq USING (c) GROUP BY ALL
), paths AS (
    SELECT c, d, string_agg(m, '') OVER (PARTITION BY c ORDER BY d) AS p, length(x) AS size FROM seq
    UNION ALL SELECT c, 0, '', 0 FROM taken
), nodes AS (
    SELECT d, p, min(c) AS first, count(*) AS n, any_value(size) AS size,
        sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = ends.n), '')) AS listed
    FROM paths JOIN ends USING (c) GROUP BY d, p
), children AS (
    SELECT b.d, b.p, a.first AS child, b.first AS parent, a.d AS child_d FROM nodes a
    JOIN paths q ON q.c = a.first AND q.d = a.d - 1 JOIN nodes b ON b.d = q.d AND b.p = q.p
), counted AS (
    SELECT nodes.*, (SELECT count(*) FROM children k WHERE k.d = nodes.d AND k.p = nodes.p) AS kids FROM nodes
), sums AS (
    SELECT q.d, q.p, count(*) FILTER (u.kids = 0) AS leaves, sum((u.n - 1) * u.size) AS saved
    FROM counted u JOIN paths q ON q.c = u.first AND q.d <= u.d GROUP BY q.d, q.p
)
SELECT v.first::BIGINT AS conv_id, v.d::BIGINT AS depth, up.parent::BIGINT AS parent_conv_id, v.n::BIGINT AS n_convs, v.kids::BIGINT AS n_children,
    s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, v.listed AS ends_sha256
FROM counted v JOIN sums s ON s.d = v.d AND s.p = v.p LEFT JOIN children up ON up.child = v.first AND up.child_d = v.d
"""


def op12_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*rebuilt(numbered_turns(read(spark, sf_dir, "conversations"))))
