"""N-gram Jaccard join: the groups that links make, a link being two documents that share a percentage of their word shingles.

`op8_jaccard` takes shingles of 4 words and 85 %; both are arguments.

Copies with the same set of shingles stand for one document.  For a link two sets must share one of the few shingles that
come first in a fixed order (prefix filter), so documents meet only under those.  First each document is compared with
one member of every meeting, which joins most groups of near copies.  Where a meeting still holds several
groups, its members are dealt in tiles of bounded size, banded by set size, and compared by hashed bitmaps: the bits that
one has and the other lacks bound the overlap from above.  What passes is verified on the sorted arrays of shingle hashes.  No link
between different groups is lost; pairs within a group need no further look.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.llm.common import keep_about, numbered_columns, ranked, read, slices, stored
from skylattice.llm.components import components
from skylattice.session import checkpointed

#: The defaults, those of `op8_jaccard`: words of a shingle, and linked when 100 * intersection >= PERCENT * union.
WORDS, PERCENT = 4, 85
TILE = 1024
#: Meeting keys are hashes of so many bits: a clash makes a needless meeting, and short keys halve the shuffle.
KEY_BITS = 48
#: A shingle in so many of the about SAMPLE_ROWS sampled documents is common: it comes last in the order of shingles.
SAMPLE_ROWS, COMMON = 10_000, 10
BLOOM_BITS = 26

_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    if len(_powers[0]) < size:
        for place, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[place] = np.cumprod(steps)
    return _powers[0][:size], _powers[1][:size]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Sorted different 64-bit hashes of the shingles of each text; words are in small ASCII letters, parted by white space."""
    raws = [(text or "").encode("utf-8", "surrogatepass") for text in texts]
    joined = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
    power, inverse = _power_tables(len(joined) + 1)
    flags = np.concatenate(([False], _IS_WORD[joined], [False]))
    edges = np.flatnonzero(flags[1:] != flags[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((_LOWER[joined] + np.uint64(1)) * power[: len(joined)], dtype=np.uint64)))
    hashes = _mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    stops = np.cumsum([len(raw) + 1 for raw in raws])
    bounds = np.concatenate(([0], np.searchsorted(starts, stops)))
    weights = [np.uint64((2 * step + 1) * 0xD6E8FEB86659FD93 & _MASK) for step in range(words)]
    if len(hashes) >= words:
        n = len(hashes) - words + 1
        grams = np.full(n, 0x1234567, np.uint64)
        for step in range(words):
            grams = _mixed(grams * np.uint64(0xA0761D6478BD642F) + hashes[step : step + n] * weights[step])
    found = []
    for first, last in zip(bounds, bounds[1:]):
        if last - first >= words:
            found.append(np.unique(grams[first : last - words + 1]))
        elif last > first:
            whole = np.full(1, 0x7654321 + int(last - first), np.uint64)
            for one in hashes[first:last]:
                whole = _mixed(whole * np.uint64(0xA0761D6478BD642F) + one)
            found.append(whole)
        else:
            found.append(np.zeros(0, np.uint64))
    return found


def signature(hashes: np.ndarray) -> bytes:
    """Bitmap with one bit for each hash; its width, a power of two, is two to four times their number."""
    bits = np.zeros(max(64, 1 << (2 * len(hashes)).bit_length()), bool)
    bits[(_mixed(hashes) & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def fold(bits: bytes, width: int) -> np.ndarray:
    """A bitmap as 64-bit words, folded to `width` bytes by laying its parts on each other."""
    return np.bitwise_or.reduce(np.frombuffer(bits, np.uint64).reshape(-1, width // 8), axis=0)


def prefix_length(size: int, percent: int = PERCENT) -> int:
    return size - -(-size * percent // 100) + 1


def _each_text(df: DataFrame, schema: str, rows, words: int) -> DataFrame:
    """`rows(ids, sets)` gives the columns for a part of (`_id`, `_text`) with shingles of `words` words."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text", 1_000_000):
                columns = rows(part.column("_id"), shingle_sets(part.column("_text").to_pylist(), words))
                if columns is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(column) for column in columns], names=names)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def common_shingles(rows: DataFrame, words: int = WORDS) -> np.ndarray:
    """Shingles that stand in many documents of a bounded sample; at most sample shingles / COMMON of them.

    They only decide the order of shingles, so what the sample misses costs time and changes no result.
    """
    total = rows.count()
    sample = rows.where(keep_about(F.col("_id"), F.lit(min(1.0, SAMPLE_ROWS / max(total, 1)))))
    sets = _each_text(sample, "hashes array<bigint>", lambda ids, sets: [[one.view(np.int64) for one in sets]], words)
    counts = sets.select(F.explode("hashes").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    return np.sort(counts.select("h").toPandas()["h"].to_numpy(np.int64).view(np.uint64))


def _described(rows: DataFrame, common: np.ndarray, words: int, percent: int) -> DataFrame:
    """(`_id`, `n`, `digest`, `keys`, `bits`) of each row."""
    shared = rows.sparkSession.sparkContext.broadcast(common)

    def describe(ids: pa.Array, sets: list[np.ndarray]) -> list:
        common, keys, digests = shared.value, [], []
        for one in sets:
            place = np.minimum(np.searchsorted(common, one), max(len(common) - 1, 0))
            frequent = common[place] == one if len(common) else np.zeros(len(one), bool)
            ordered = np.concatenate((one[~frequent], one[frequent]))
            keys.append((ordered[: prefix_length(len(one), percent)] >> np.uint64(64 - KEY_BITS)).astype(np.int64) if len(one) else np.zeros(0, np.int64))
            mixed = _mixed(one)
            digests.append(int(mixed.sum(dtype=np.uint64) ^ np.uint64(len(one))).to_bytes(8, "big") + int(np.bitwise_xor.reduce(_mixed(mixed + np.uint64(1)))).to_bytes(8, "big"))
        return [ids, [len(one) for one in sets], digests, keys, [signature(one) for one in sets]]

    return _each_text(rows, "_id bigint, n bigint, digest binary, keys array<bigint>, bits binary", describe, words)


def _may_link(n_a: np.ndarray, n_b: np.ndarray, only_a: np.ndarray, only_b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """False where the bits that only one side has leave too small an overlap."""
    overlap = np.minimum(n_a - only_a, n_b - only_b)
    return (100 + percent) * overlap >= percent * (n_a + n_b)


def _with_bits(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """The pairs (`a`, `b`) whose sizes and bitmaps allow a link."""
    sides = [known.select(F.col("_id").alias(name), F.col("n").alias(f"n_{name}"), F.col("bits").alias(f"bits_{name}")) for name in "ab"]
    joined = pairs.join(sides[0], "a").join(sides[1], "b").where(
        (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(name).to_pylist() for name in ("n_a", "n_b", "bits_a", "bits_b")]
            good = []
            for n_a, n_b, bits_a, bits_b in zip(*columns):
                a, b = (fold(bits, min(len(bits_a), len(bits_b))) for bits in (bits_a, bits_b))
                good.append(bool(_may_link(n_a, n_b, np.bitwise_count(a & ~b).sum(dtype=np.int64), np.bitwise_count(b & ~a).sum(dtype=np.int64), percent)))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return joined.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(run, "a bigint, b bigint")


def _bloom(ids: DataFrame) -> np.ndarray:
    """Bitmap of fixed size that holds the hashes of all ids; it fills up on large tables, and then only prunes less."""
    place = F.pmod(F.xxhash64("_id"), F.lit(1 << BLOOM_BITS))
    parts = (
        ids.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit"))
        .groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    )
    # Buckets are numbered from 1, but position 0 falls in bucket 0.
    width = len(parts[0]["bits"]) if parts else 4096
    bits = np.zeros(((1 << BLOOM_BITS) // (width * 8) + 2, width), np.uint8)
    for part in parts:
        bits[part["bucket"]] |= np.frombuffer(bytes(part["bits"]), np.uint8)
    return bits


def _verified(pairs: DataFrame, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (`a`, `b`) that are links, by the sorted arrays of their shingles.

    Arrays are made again from the texts of those documents that are in a pair: a bitmap of fixed size leaves out most others
    before their text is cut, and a join the rest.
    """
    ids = checkpointed(pairs.select(F.col("a").alias("_id")).union(pairs.select(F.col("b").alias("_id"))).distinct())
    bloom = rows.sparkSession.sparkContext.broadcast(_bloom(ids))
    place = F.pmod(F.xxhash64("_id"), F.lit(1 << BLOOM_BITS))
    placed = rows.select("_id", "_text", F.bitmap_bucket_number(place).alias("_bucket"), F.bitmap_bit_position(place).alias("_bit"))

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, bit = batch.column("_bucket").to_numpy(), batch.column("_bit").to_numpy()
            inside = bloom.value[bucket, bit // 8] >> (bit % 8).astype(np.uint8) & 1
            for part in slices(batch.filter(pa.array(inside.astype(bool))), "_text", 1_000_000):
                sets = shingle_sets(part.column("_text").to_pylist(), words)
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array([one.tobytes() for one in sets])], names=["_id", "hashes"])

    sets = placed.mapInArrow(arrays, "_id bigint, hashes binary").join(ids, "_id", "left_semi")
    # The array of `a` goes to where the array of `b` is: many documents are compared with one.
    left = pairs.join(sets.withColumnRenamed("hashes", "x"), pairs["a"] == sets["_id"]).select("a", "b", "x")
    both = left.join(sets.withColumnRenamed("hashes", "y"), left["b"] == sets["_id"]).select("a", "b", "x", "y")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                place = np.minimum(np.searchsorted(b, a), len(b) - 1)
                shared = int((b[place] == a).sum())
                good.append(100 * shared >= percent * (len(a) + len(b) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(check, "a bigint, b bigint")


def _share(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted arrays have a number in common."""
    if not len(x) or not len(y):
        return False
    place = np.minimum(np.searchsorted(x, y), len(x) - 1)
    return bool((x[place] == y).any())


def _tile_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of different groups within a tile whose sizes and bitmaps allow a link, and that meet in no tile of an earlier meeting.

    `members` has `key`, `low`, `high` (the tile), `side` (-1: compare all, else 0 against 1), `_id`, `n`, `group`, `bits`, `before` (the open meetings
    with a smaller key that the document is in, ascending).
    """
    names = ["key", "low", "high", "side", "_id", "n", "group", "bits", "before"]

    def compare(tile: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        n, group, side = tile["n"], tile["group"], tile["side"]
        none = np.zeros(0, np.int64)
        if (group == group[0]).all():
            return none, none
        width = np.array([len(one) for one in tile["bits"]])
        folded: dict[int, np.ndarray] = {}

        def at_width(wanted: int) -> np.ndarray:
            if wanted not in folded:
                folded[wanted] = np.zeros((len(n), wanted // 8), np.uint64)
                for i in np.flatnonzero(width >= wanted):
                    folded[wanted][i] = fold(tile["bits"][i], wanted)
            return folded[wanted]

        a_rows, b_rows = (np.arange(len(n)),) * 2 if side[0] < 0 else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        found_a, found_b = [], []
        # Rows come by size, so those of a linkable size are one stretch.
        sizes = n[b_rows]
        for a in a_rows:
            first = np.searchsorted(sizes, -(-percent * n[a] // 100)) if side[0] >= 0 else np.searchsorted(b_rows, a, "right")
            b = b_rows[first : np.searchsorted(sizes, 100 * n[a] // percent, "right")]
            b = b[group[b] != group[a]]
            if not len(b):
                continue
            # Linkable sizes differ so little that no bitmap is folded more than once or twice.
            bits = at_width(int(min(width[a], width[b].min())))
            only_a = np.bitwise_count(bits[a] & ~bits[b]).sum(axis=1, dtype=np.int64)
            only_b = np.bitwise_count(bits[b] & ~bits[a]).sum(axis=1, dtype=np.int64)
            b = b[_may_link(n[a], n[b], only_a, only_b, percent)]
            before = tile["before"]
            if len(b) and len(before[a]):
                b = b[[not _share(before[a], before[other]) for other in b]]
            found_a.append(np.full(len(b), tile["_id"][a]))
            found_b.append(tile["_id"][b])
        return np.concatenate(found_a or [none]), np.concatenate(found_b or [none])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A pair may meet in many tiles of a task; it leaves the task once (once for every million found).
        rest: dict[str, np.ndarray] | None = None
        found: list[np.ndarray] = []

        def unique() -> pa.RecordBatch:
            pairs = np.unique(np.concatenate([*found, np.zeros((0, 2), np.int64)]), axis=0)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        def add(tile: dict[str, np.ndarray]) -> None:
            a, b = compare(tile)
            found.append(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1))

        for batch in batches:
            if not batch.num_rows:
                continue
            now = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in names}
            if rest is not None:
                now = {name: np.concatenate((rest[name], now[name])) for name in names}
            change = np.ones(len(now["key"]), bool)
            change[1:] = (now["key"][1:] != now["key"][:-1]) | (now["low"][1:] != now["low"][:-1]) | (now["high"][1:] != now["high"][:-1])
            starts = np.flatnonzero(change)
            for start, end in zip(starts, starts[1:]):
                add({name: now[name][start:end] for name in names})
            # The last tile may go on in the next batch.
            rest = {name: now[name][starts[-1] :] for name in names}
            if sum(map(len, found)) > 1_000_000:
                yield unique()
        if rest is not None:
            add(rest)
        yield unique()
        pa.default_memory_pool().release_unused()

    tiles = members.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "n", "_id")
    return tiles.select(*names).mapInArrow(run, "a bigint, b bigint").distinct()


def _numbered(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame | None, bool]:
    """`docs` with `_id`, a whole number for each key and text; (`_id`, `_key`) of those whose number is not their key; whether a key is repeated.

    The number is the key where all rows of a key have the same text.  Other texts, and those without a key, are numbered behind
    the largest key (before the smallest where there is no room).  Without such rows the second is None.
    """
    marked = docs.withColumns({"_key": F.col(key).cast("bigint"), "_mark": F.xxhash64(text)})
    keys = marked.groupBy("_key").agg(F.min("_mark").alias("_m0"), F.max("_mark").alias("_m1"), F.count("*").alias("_n"))
    several = checkpointed(keys.where("_key IS NULL OR _n > 1"))
    odd = several.where("_key IS NULL OR _m0 <> _m1").select("_key")
    repeated = several.limit(1).count() > 0
    if not repeated or not odd.limit(1).count():
        return marked.withColumn("_id", F.col("_key")).drop("_key", "_mark"), None, repeated
    texts = marked.select("_key", "_mark").join(odd.withColumnRenamed("_key", "_o"), F.col("_key").eqNullSafe(F.col("_o")), "left_semi").distinct()
    order = ranked(texts, [F.col("_key").asc_nulls_last(), F.col("_mark").asc()])
    count, (low, high) = order.count(), marked.agg(F.coalesce(F.min("_key"), F.lit(0)), F.coalesce(F.max("_key"), F.lit(0))).head()
    base = high + 1 if high + count < 1 << 63 else low - count
    order = checkpointed(order.select((F.lit(base) + F.col("rank")).cast("bigint").alias("_id"), F.col("_key").alias("_o"), F.col("_mark").alias("_m")))
    found = marked.join(order, F.col("_key").eqNullSafe(F.col("_o")) & (F.col("_mark") == F.col("_m")), "left")
    found = found.withColumn("_id", F.coalesce("_id", "_key")).drop("_key", "_mark", "_o", "_m")
    return found, order.select("_id", F.col("_o").alias("_key")), repeated


def _one_each(rows: DataFrame, text: str, repeated: bool) -> DataFrame:
    """(`_id`, `_text`), one row for each number: rows that share it have the same text."""
    found = rows.select("_id", F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return found.groupBy("_id").agg(F.min("_text").alias("_text")) if repeated else found


def join_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(`key`, `n_shingles`, `component_id`): the size of each row's set, and the smallest key that links lead to.

    Two documents are linked when they share at least `percent` % of the different shingles of `words` words that either has.
    A text with fewer words has all its words as one shingle; one without words has an empty set and is linked with
    nothing.  Keys are whole numbers.  Rows with a NULL key are compared like others; their `component_id` is NULL where no linked
    row has a key.  Rows that share a key but not the text are documents of their own.  Other columns are not read.

    The result is the groups and not the pairs of the join: links within a group that others already join are not looked for.
    """
    read = docs.select(F.col(key).alias("in_key"), F.col(text).alias("in_text"))
    rows, names, repeated = _numbered(read, "in_key", "in_text")
    found = _components_of(_one_each(rows, "in_text", repeated), words, percent)
    if repeated:
        found = rows.select("_id").join(found, "_id")
    if names is not None:
        found = _with_keys(found, names)
        least = found.groupBy("_component").agg(F.min("_key").alias("_least"))
        found = found.join(least, "_component").select(F.col("_key").alias("_id"), "n", F.col("_least").alias("_component"))
    return found.select(F.col("_id").alias(key), F.col("n").alias("n_shingles"), F.col("_component").alias("component_id"))


def _with_keys(found: DataFrame, names: DataFrame) -> DataFrame:
    joined = found.join(names.select(F.col("_id").alias("_o"), "_key"), F.col("_id") == F.col("_o"), "left")
    return joined.withColumn("_key", F.when(F.col("_o").isNull(), F.col("_id")).otherwise(F.col("_key"))).drop("_o")


def one_of_each_group(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of `docs` with the smallest key of each group of `join_groups`, one of each; a row without a key only where none has one.

    Between rows of that key in the group a fixed order of their contents decides.  Rows without words are linked with nothing: of those
    that share a key and the text one stays, and all that have no key.  Columns may have any names.
    """
    order = docs.columns
    docs, own = numbered_columns(docs)
    key, text = own[key], own[text]
    rows, names, repeated = _numbered(docs, key, text)
    found = _components_of(_one_each(rows, text, repeated), words, percent)
    alone = None
    if names is None:
        kept = found.where("_id = _component").select("_id").distinct()
    else:
        found = _with_keys(found, names)
        nothing = F.col("_key").isNull() & (F.col("n") == 0)
        alone = found.where(nothing).select("_id").distinct()
        first = F.min(F.struct(F.col("_key").isNull().alias("none"), "_key", "_id")).alias("_first")
        kept = found.where(~nothing).groupBy("_component").agg(first).select("_first._id")
    columns = F.struct(*docs.columns)
    one = rows.join(kept, "_id").groupBy("_id").agg(F.min_by(columns, F.xxhash64(*docs.columns)).alias("_row")).select("_row.*")
    return (one if alone is None else one.union(rows.join(alone, "_id", "left_semi").select(*docs.columns))).toDF(*order)


def _components_of(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """(`_id`, `n`, `_component`) for each row (`_id`, `_text`): the size of its set, and the smallest `_id` that links lead to."""
    described = stored(_described(rows, common_shingles(rows, words), words, percent), "sets")
    # One document stands for all with the same set.
    stand = described.where("n > 0").groupBy("digest", "n").agg(F.min("_id").alias("_id"))
    known = described.select("_id", "n", "bits")
    # Meetings: documents under one of their first shingles.
    meeting = described.select("_id", F.col("n").cast("int").alias("n"), "keys").join(stand.select("_id"), "_id", "left_semi")
    meeting = meeting.select("_id", "n", F.explode("keys").alias("key"))
    shared = meeting.groupBy("key").agg(F.min("_id").alias("first"), F.max("_id").alias("last")).where("first < last")
    met = stored(meeting.join(shared.select("key"), "key"), "meetings")
    # Meetings of the same members are one.
    sets = met.groupBy("key").agg(F.count("*").alias("rows"), *[F.bit_xor(F.xxhash64(F.lit(seed), "_id")).alias(f"h{seed}") for seed in (1, 2)])
    members = met.join(sets.groupBy("rows", "h1", "h2").agg(F.min("key").alias("key")).select("key"), "key")
    # Each is compared with one of about its size.
    banded = members.withColumn("band", F.floor(F.log("n") / math.log(100 / percent)).cast("int"))
    pivots = banded.groupBy("key", "band").agg(F.min("_id").alias("b"))
    stars = banded.join(pivots, ["key", "band"]).where("_id <> b").select(F.col("_id").alias("a"), "b").distinct()
    links = checkpointed(_verified(checkpointed(_with_bits(stars, known, percent)), rows, words, percent))
    groups = components(links)
    # Meetings that still hold several groups.
    named = banded.join(groups.withColumnRenamed("node", "_id"), "_id", "left").select("key", "_id", "band", F.coalesce("component", "_id").alias("group"))
    several = named.groupBy("key").agg(F.count("*").alias("rows"), F.min("group").alias("g0"), F.max("group").alias("g1")).where("g0 < g1")
    left = stored(named.join(several.select("key", "rows"), "key"), "open-meetings")
    # A small meeting is one tile.  A larger one is banded: sizes are linked to those of the same band and of the one below, so a tile
    # holds two neighbouring bands; and a tile of many rows is cut in blocks that are compared two by two.
    bands = F.when(F.col("rows") <= TILE, F.array(F.lit(0))).otherwise(F.array("band", F.col("band") + 1))
    wide = left.withColumn("tile", F.explode(bands)).drop("rows")
    tiles = wide.groupBy("key", "tile").agg(F.count("*").alias("rows"), F.min("group").alias("g0"), F.max("group").alias("g1"))
    tiles = tiles.where("g0 < g1").select("key", "tile", F.ceil(F.col("rows") / TILE).cast("int").alias("cuts"))
    own = F.pmod(F.xxhash64("_id"), F.col("cuts")).cast("int")
    dealt = wide.join(tiles, ["key", "tile"]).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    # A pair is reported at the first of the meetings that both are in.
    others = left.groupBy("_id").agg(F.collect_list("key").alias("open"))
    dealt = dealt.join(others, "_id").withColumn("before", F.sort_array(F.filter("open", lambda one: one < F.col("key"))))
    dealt = dealt.select(
        F.xxhash64("key", "tile").alias("key"), "before", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
        F.when(F.col("own") == F.col("other"), -1).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"), "_id", "group",
    )
    dealt = dealt.join(known, "_id")
    more = _verified(checkpointed(_tile_pairs(dealt, percent)), rows, words, percent)
    groups = components(links.union(more))
    whole = groups.select(F.col("node").alias("_id"), "component")
    classes = stand.join(whole, "_id", "left").select("digest", "n", F.coalesce("component", "_id").alias("_component"))
    return described.select("_id", "n", "digest").join(classes, ["digest", "n"], "left").select(
        "_id", "n", F.coalesce("_component", "_id").alias("_component")
    )


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_groups(read(spark, sf_dir, "documents"))
