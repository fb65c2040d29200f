"""Mixing sources to target weights by Sainte-Laguë apportionment.

Sources weigh 1, 2, 3, 1, 2, 3, ... in the order of their names and share the total; a target stops at `epochs` times
its source's size and the excess is shared anew.  The mix is dealt in blocks of equal size: blocks go to sources by highest quotients
target / (2 k + 1), then each source's blocks go to its shards in the same way, by the shards' sizes.  A shard is a bounded number of documents
in a seeded order, and takes its blocks from the start of that order, round after round: whole passes, then a part of one.

Quotients are never listed: a divisor a little too large gives seats that every source surely gets, and only the few
that are left are ranked.  Everything is DataFrame operations; ranks are those of a distributed sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skylattice.llm.common import BLANK, numbered_columns, ranked, read
from skylattice.session import checkpointed

EPOCHS = 3
BLOCK = 16
#: Rows of a shard, about.
SHARD_ROWS = 4096
SEED = 17


def words(text: Column) -> Column:
    """Number of words; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{BLANK}]+")), F.lit(0)).cast("bigint")


def seeded(key: Column, seed: int) -> Column:
    """A hash that looks random and that other engines can compute too."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))


def with_targets(sizes: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """(`source`, `source_size`) -> those with `weight` and `target`.

    The level that targets rise to per unit of weight is found by raising it until no further source reaches its stop:
    each round is one sum over the sources, and only numbers come back.
    """
    order = [F.col("source").isNull(), F.hex(F.encode("source", "utf-8"))]
    sources = checkpointed(
        ranked(sizes, [column.asc() for column in order]).select("source", "source_size", (F.col("rank") % 3 + 1).alias("weight"))
    )
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).head()[0]
    level_up, level_down = total, sources.agg(F.coalesce(F.sum("weight"), F.lit(1))).head()[0]
    cap = F.col("source_size") * epochs
    while True:
        # target at this level: weight * up / down, against the stop
        stops = cap.cast("decimal(38,0)") * level_down <= F.col("weight").cast("decimal(20,0)") * level_up
        full, free = sources.agg(
            F.coalesce(F.sum(F.when(stops, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~stops, F.col("weight"))), F.lit(0))
        ).head()
        if free == 0 or (total - full, free) == (level_up, level_down):
            break
        level_up, level_down = total - full, free
    target = F.when(stops, cap.cast("double")).otherwise((F.col("weight") * level_up).cast("double") / level_down)
    return sources.withColumn("target", target)


def apportion(units: DataFrame, group: str, unit: str, votes: str, seats: str) -> DataFrame:
    """Add `given`: the seats each unit gets by Sainte-Laguë within its group; ties go to the unit that sorts first.

    `votes` may be zero (no seat), `seats` is the same in all rows of a group.  With n units and V votes, the divisor V / (seats - n/2)
    surely gives too few seats and V / (seats + n/2) enough: between them lie at most 2n quotients, and those are ranked.
    """
    sums = units.groupBy(F.col(group).alias("_g")).agg(F.sum(votes).alias("_cast"), F.count("*").alias("_units"))
    known = units.join(sums, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")

    def at(shift: Column) -> Column:
        share = F.col(votes) * F.greatest(F.col(seats) + shift, F.lit(0.0)) / F.col("_cast")
        return F.when(F.col("_cast") > 0, F.floor(share + 0.5)).otherwise(0).cast("bigint")

    low = F.greatest(at(-F.col("_units") / 2) - 1, F.lit(0))
    bounded = checkpointed(known.withColumns({"_low": low, "_high": at(F.col("_units") / 2) + 1}).drop("_cast", "_units"))
    left = bounded.groupBy(group).agg((F.max(seats) - F.sum("_low")).alias("_left"))
    steps = bounded.where(F.col(votes) > 0).select(group, unit, votes, F.explode(F.sequence("_low", "_high")).alias("_k"))
    steps = steps.select(group, unit, (F.col(votes).cast("double") / (2 * F.col("_k") + 1)).alias("_quotient"))
    lined = ranked(steps, [F.col(group).asc_nulls_last(), F.col("_quotient").desc(), F.col(unit).asc_nulls_last()], "_rank")
    lined = checkpointed(lined)
    first = lined.groupBy(group).agg(F.min("_rank").alias("_first")).join(left.withColumnRenamed(group, "_g"), F.col(group).eqNullSafe(F.col("_g"))).drop("_g")
    won = (
        lined.join(first.withColumnRenamed(group, "_g"), F.col(group).eqNullSafe(F.col("_g"))).where(F.col("_rank") - F.col("_first") < F.col("_left"))
        .groupBy(F.col(group).alias("_g"), F.col(unit).alias("_u")).agg(F.count("*").alias("_won"))
    )
    return (
        bounded.join(won, F.col(group).eqNullSafe(F.col("_g")) & F.col(unit).eqNullSafe(F.col("_u")), "left")
        .withColumn("given", F.col("_low") + F.coalesce("_won", F.lit(0)))
        .drop("_low", "_high", "_g", "_u", "_won")
    )


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = SEED, block: int = BLOCK, epochs: int = EPOCHS) -> DataFrame:
    """(`key`, `source`, `size`, `source_size`, `target`, `taken`): how many words of each row the mix takes, repeats counted.

    A row is taken in whole passes, then once more up to `taken % size` words from its start.  A NULL text has size 0 and
    NULL is a source of its own, the last one.  Repeated rows are rows of their own.  Other columns are not read.
    """
    rows = docs.select(F.col(key).alias("_key"), F.col(source).alias("source"), words(F.col(text)).alias("size"))
    taken = _mix(checkpointed(rows.withColumn("_hash", seeded(F.col("_key"), seed))), block, epochs)
    return taken.select(F.col("_key").alias(key), F.col("source").alias(source), "size", "source_size", "target", "taken")


def _mix(rows: DataFrame, block: int, epochs: int) -> DataFrame:
    """Add `source_size`, `target` and `taken` to rows (`source`, `size`, `_hash`, ...)."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    sized = with_targets(sizes, epochs)
    # Sources get whole blocks of the mix.
    sized = sized.withColumn("_all", F.lit(0)).withColumn("_votes", F.col("target"))
    total = sized.agg(F.sum("target")).head()[0] or 0.0
    given = apportion(sized.withColumn("_seats", F.lit(round(total / block))), "_all", "source", "_votes", "_seats")
    given = given.select("source", "source_size", "target", F.col("given").alias("_blocks"))
    # Shards are as many as a source's rows ask for, so the largest source has no larger ones.
    shards = sizes.select(F.col("source").alias("_s"), F.ceil(F.col("_rows") / SHARD_ROWS).alias("_shards"))
    sharded = rows.join(shards, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    shard = F.conv(F.substring("_hash", 1, 8), 16, 10).cast("bigint") % F.col("_shards")
    sharded = sharded.withColumn("_shard", shard).drop("_shards")
    shard_sizes = sharded.groupBy("source", "_shard").agg(F.sum("size").alias("_shard_size"))
    quotas = apportion(
        shard_sizes.join(given.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s"),
        "source", "_shard", "_shard_size", "_blocks",
    )
    quotas = quotas.select(
        F.col("source").alias("_s"), F.col("_shard").alias("_t"), "source_size", "target", "_shard_size",
        F.least(F.col("given") * block, F.col("_shard_size") * epochs).alias("_words"),
    )
    # Both sides lie by (source, shard), and so does the window: one shuffle of narrow rows.
    window = Window.partitionBy("source", "_shard").orderBy("_hash", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sharded.withColumn("_before", F.coalesce(F.sum("size").over(window), F.lit(0)))
    placed = placed.join(quotas, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_shard") == F.col("_t")))
    passes = F.when(F.col("_shard_size") > 0, F.floor(F.col("_words") / F.col("_shard_size"))).otherwise(0)
    rest = F.col("_words") - passes * F.col("_shard_size")
    part = F.greatest(F.least(rest - F.col("_before"), F.col("size")), F.lit(0))
    return placed.select(*rows.columns, "source_size", "target", (passes * F.col("size") + part).cast("bigint").alias("taken"))


def mixed(
    docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = SEED, block: int = BLOCK, epochs: int = EPOCHS
) -> DataFrame:
    """The documents of the mix, with the columns of `docs`: each as often as it is taken whole, and once cut after the words of a part.

    Every row gets what `mix` takes of it, also where rows share a key or have none; the copies of a row are equal rows.  A NULL text has
    no words and is never taken.  A column `n_chars` follows the text; columns may have any names.
    """
    order = docs.columns
    docs, own_names = numbered_columns(docs)
    key, source, text, length = own_names[key], own_names[source], own_names[text], own_names.get("n_chars")
    # A row is known by key, source and text; rows that are equal in all three are counted.
    names = ["_key", "_source", "_same"]
    own = {"_key": F.col(key), "_source": F.col(source), "_same": F.xxhash64(text)}
    rows = docs.select(F.col(key).alias("_key"), F.col(source).alias("source"), words(F.col(text)).alias("size"), own["_same"].alias("_same"))
    rows = checkpointed(rows.withColumn("_hash", seeded(F.col("_key"), seed)))
    taken = _mix(rows, block, epochs).select("_key", F.col("source").alias("_source"), "_same", F.struct("taken", "size").alias("_mix"))
    known = docs.withColumns(own)
    if rows.groupBy("_key", "source", "_same").count().where("count > 1").limit(1).count():
        equal = Window.partitionBy(*names)
        taken = taken.withColumn("_n", F.row_number().over(equal.orderBy(F.col("_mix").desc())))
        known = known.withColumn("_n", F.row_number().over(equal.orderBy(F.xxhash64(*docs.columns))))
        names = [*names, "_n"]
    taken = taken.where("_mix.taken > 0").withColumnsRenamed({name: f"{name}_t" for name in names})
    same = F.lit(True)
    for name in names:
        same &= F.col(name).eqNullSafe(F.col(f"{name}_t"))
    joined = known.join(taken, same)
    whole = F.floor(F.col("_mix.taken") / F.col("_mix.size"))
    part = (F.col("_mix.taken") - whole * F.col("_mix.size")).cast("int")
    # Cut behind each word: the pieces put together again are the text itself.
    pieces = F.split(F.col(text), f"(?<=[^{BLANK}])(?=[{BLANK}])")
    start = F.array_join(F.slice(pieces, 1, part), "")
    copies = F.concat(
        F.array_repeat(F.col(text), whole.cast("int")), F.when(part > 0, F.array(start)).otherwise(F.array().cast("array<string>"))
    )
    rows = joined.withColumn("_copy", F.explode(copies))
    columns = [F.col("_copy").alias(name) if name == text else F.length("_copy").cast("bigint").alias(name) if name == length else F.col(name) for name in docs.columns]
    return rows.select(*columns).toDF(*order)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


#: The same by the definition: every quotient is listed and the highest are taken.
OP2_SQL = f"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, source, md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS hash,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size
  FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n,
    (row_number() OVER (ORDER BY source IS NULL, hex(encode(source))) - 1) % 3 + 1 AS weight
  FROM rows_ GROUP BY source
), level_ AS (
  SELECT 0 AS step, sum(source_size)::BIGINT AS up, sum(weight)::BIGINT AS down, -1::BIGINT AS up0, -1::BIGINT AS down0 FROM sizes
  UNION ALL
  SELECT step + 1, (SELECT sum(source_size)::BIGINT - coalesce(sum(CASE WHEN {EPOCHS}::HUGEINT * source_size * down <= weight::HUGEINT * up THEN {EPOCHS} * source_size END), 0)::BIGINT FROM sizes),
    (SELECT coalesce(sum(CASE WHEN {EPOCHS}::HUGEINT * source_size * down > weight::HUGEINT * up THEN weight END), 0)::BIGINT FROM sizes), up, down
  FROM level_ WHERE down > 0 AND (up, down) <> (up0, down0) AND step < 1000
), final_ AS (
  SELECT up, down FROM level_ WHERE down > 0 ORDER BY step DESC LIMIT 1
), targets AS (
  SELECT source, source_size, n, CASE WHEN {EPOCHS}::HUGEINT * source_size * down <= weight::HUGEINT * up THEN ({EPOCHS} * source_size)::DOUBLE
    ELSE (weight * up)::DOUBLE / down END AS target
  FROM sizes, final_
), blocks AS (
  SELECT source, count(*) AS n_blocks FROM (
    SELECT source, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, source NULLS LAST) AS place
    FROM (SELECT source, target, unnest(range(0, (target / {BLOCK})::BIGINT + 50)) AS k FROM targets WHERE target > 0)
  ) WHERE place <= (SELECT round(sum(target) / {BLOCK}) FROM targets) GROUP BY source
), sharded AS (
  SELECT r.*, ('0x' || substr(hash, 1, 8))::BIGINT % ceil(n / {SHARD_ROWS})::BIGINT AS shard
  FROM rows_ r JOIN sizes s ON r.source IS NOT DISTINCT FROM s.source
), shard_sizes AS (
  SELECT source, shard, sum(size)::BIGINT AS shard_size FROM sharded GROUP BY ALL
), quotas AS (
  SELECT source, shard, count(*) AS given FROM (
    SELECT source, shard, n_blocks, row_number() OVER (PARTITION BY source ORDER BY shard_size::DOUBLE / (2 * k + 1) DESC, shard) AS place
    FROM (
      SELECT s.source, shard, shard_size, n_blocks, unnest(range(0, n_blocks)) AS k
      FROM shard_sizes s JOIN blocks b ON s.source IS NOT DISTINCT FROM b.source WHERE shard_size > 0
    )
  ) WHERE place <= n_blocks GROUP BY ALL
), placed AS (
  SELECT r.doc_id, r.source, r.size, t.source_size, t.target, s.shard_size,
    least(coalesce(q.given, 0) * {BLOCK}, s.shard_size * {EPOCHS}) AS words,
    coalesce(sum(r.size) OVER (PARTITION BY r.source, r.shard ORDER BY r.hash, r.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sharded r
  JOIN shard_sizes s ON r.source IS NOT DISTINCT FROM s.source AND r.shard = s.shard
  JOIN targets t ON r.source IS NOT DISTINCT FROM t.source
  LEFT JOIN quotas q ON r.source IS NOT DISTINCT FROM q.source AND r.shard = q.shard
)
SELECT doc_id, size, source_size, target, source,
  (CASE WHEN shard_size > 0 THEN words // shard_size * size + greatest(least(words % shard_size - before, size), 0) ELSE 0 END)::BIGINT AS taken
FROM placed
"""
