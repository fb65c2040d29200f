"""Coverage maps as text: ASCII `1/0,3 2/17-20` or JSON `{"1":[0,3]}`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.functions.cells import MAX_ORDER
from skylattice.operators.coverage import coalesce, to_cell_runs, to_uniq


def text_tasks(spark: SparkSession) -> int:
    """Texts are short for what they say: the number of tasks that make or read them does not follow from the bytes."""
    return 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def parse_coverage(texts: DataFrame, order: int = MAX_ORDER) -> DataFrame:
    """Text maps (`set_id`, `text`) to merged ranges at order 29.  The text need not be well formed.

    Each order marker starts a section of its own; values before the first marker belong to order 0.
    """
    # Two kinds of token are looked for in the text as it stands: a number with a slash or colon behind it, and a number with
    # perhaps a second one behind a dash.  Whatever else stands between them does not matter.
    texts = texts.repartition(text_tasks(texts.sparkSession), F.xxhash64("set_id", "text"))
    marker, value = r"(\d+)\"?\s*[/:]", r"(\d+)(?:\s*-\s*(\d+))?"
    sections = F.split("text", rf"(?={marker})(?<!\d)")
    tokens = texts.select("set_id", F.explode(sections).alias("section")).select(
        "set_id",
        F.coalesce(F.nullif(F.regexp_extract("section", "^" + marker, 1), F.lit("")), F.lit("0")).cast("int").alias("order"),
        F.regexp_replace("section", "^" + marker, "").alias("items"),
    )
    items = tokens.select("set_id", "order", F.explode(F.regexp_extract_all("items", F.lit(value), F.lit(0))).alias("item"))
    ends = F.split("item", r"\s*-\s*")
    shift = F.lit(2) * (F.lit(MAX_ORDER) - F.col("order"))
    ranges = items.select("set_id", "order", F.get(ends, 0).cast("bigint").alias("first"),
                          F.coalesce(F.get(ends, 1), F.get(ends, 0)).cast("bigint").alias("last"))
    return coalesce(ranges.select(
        "set_id",
        F.call_function("shiftleft", F.col("first"), shift).alias("lo"),
        F.call_function("shiftleft", F.col("last") + 1, shift).alias("hi"),
    ), order)


#: Items of one piece of text.
PIECE = 4096


def format_coverage(ranges: DataFrame, json: bool = False, order: int = MAX_ORDER) -> DataFrame:
    """(`set_id`, `order`, `part`, `text`): text of every non-empty set in pieces of about PIECE items at most, each a map of its own.

    A piece holds cells of one order that lie together, so any selection of pieces can be read by `parse_coverage`.
    `join_pieces` makes one text of a set that is known to fit.
    """
    merged = coalesce(ranges, order)
    if json:
        items = to_uniq(merged, order).select("set_id", "order", F.col("pix").alias("first"), F.col("pix").cast("string").alias("item"))
    else:
        single = F.col("last") == F.col("first") + 1
        items = to_cell_runs(merged, order).select(
            "set_id", "order", "first",
            F.when(single, F.col("first").cast("string"))
            .otherwise(F.concat_ws("-", F.col("first").cast("string"), (F.col("last") - 1).cast("string"))).alias("item"))
    # Pieces are stretches of the sky: PIECE cells of the order, whichever of them are in the set.
    items = items.withColumn("part", F.floor(F.col("first") / F.lit(PIECE)).cast("bigint"))
    listed = items.groupBy("set_id", "order", "part").agg(F.array_sort(F.collect_list(F.struct("first", "item"))).alias("items"))
    values = F.array_join(F.col("items.item"), ",")
    name = F.col("order").cast("string")
    text = F.concat(F.lit('{"'), name, F.lit('":['), values, F.lit("]}")) if json else F.concat(name, F.lit("/"), values)
    return listed.select("set_id", "order", "part", text.alias("text"))


def join_pieces(pieces: DataFrame, json: bool = False) -> DataFrame:
    """(`set_id`, `text`): one text per set, each order once.  The whole text of a set has to fit a row."""
    body = F.regexp_extract("text", r"\[(.*)\]" if json else "/(.*)", 1)
    by_order = pieces.groupBy("set_id", "order").agg(F.array_sort(F.collect_list(F.struct("part", body.alias("body")))).alias("parts"))
    values, name = F.array_join(F.col("parts.body"), ","), F.col("order").cast("string")
    section = F.concat(F.lit('"'), name, F.lit('":['), values, F.lit("]")) if json else F.concat(name, F.lit("/"), values)
    texts = by_order.groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct("order", section.alias("section")))).alias("sections"))
    joined = F.array_join(F.col("sections.section"), ", " if json else " ")
    return texts.select("set_id", (F.concat(F.lit("{"), joined, F.lit("}")) if json else joined).alias("text"))
