"""Document fingerprints: a Merkle tree over the paragraphs and sections of a text.

A text is cut into pieces at line ends and behind certain words, so that the cuts depend on what stands around them and not
on how far they are from the start.  The pieces are the leaves (paragraphs), each with the digest of its exact characters.  A section ends at
a leaf whose digest ends with the digit 0, about every tenth; its digest is that of its leaves' digests.  The root is the
digest of the section digests.  Equal roots mean equal texts; where roots differ, the sections and leaves that differ
say where.  All of it is built from SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skylattice.llm.common import ranked, read

#: A piece ends behind the white space that follows a line end, a mark, or a word with one of these last letters.
CUT = r"(?<=[\n.,;:!?|]\s)(?=\S)|(?<=\n)(?=\S)|(?<=[aenst]\s)(?=\S)"


def leaf_texts(text: Column) -> Column:
    """The pieces of a text in order; put together they are the text.  The empty text has none."""
    return F.when(F.length(text) > 0, F.split(text, CUT)).otherwise(F.array().cast("array<string>"))


def leaf_digests(text: Column) -> Column:
    return F.transform(leaf_texts(text), lambda piece: F.xxhash64(piece))


def short_digests(leaves: Column) -> Column:
    """31 bits of each digest: enough to compare two trees, and half as much to move."""
    return F.transform(leaves, lambda leaf: F.pmod(leaf, F.lit((1 << 31) - 1)).cast("int"))


def with_tree(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add `{name}_leaves` (digest of each leaf), `{name}_lengths`, `{name}_sections` (digests) and `{name}_root`.

    A NULL text counts as empty.
    """
    df = df.withColumn("_pieces", leaf_texts(F.coalesce(F.col(text), F.lit(""))))
    df = df.withColumns({
        f"{name}_leaves": F.transform("_pieces", lambda piece: F.xxhash64(piece)),
        f"{name}_lengths": F.transform("_pieces", lambda piece: F.length(piece)),
    }).drop("_pieces")
    # One string of all leaf digests, parted behind each that ends with 0: linear in the text, whatever its length.
    line = F.array_join(F.col(f"{name}_leaves").cast("array<string>"), " ")
    sections = F.transform(F.split(line, "(?<=0) "), lambda part: F.md5(part.cast("binary")))
    df = df.withColumn(f"{name}_sections", F.when(F.size(f"{name}_leaves") > 0, sections).otherwise(F.array().cast("array<string>")))
    return df.withColumn(f"{name}_root", F.sha2(F.array_join(f"{name}_sections", " ").cast("binary"), 256))


def fingerprint(name: str) -> Column:
    """Root and section digests as one string: equal exactly for equal texts."""
    short = F.transform(f"{name}_sections", lambda digest: F.substring(digest, 1, 8))
    return F.concat(F.col(f"{name}_root"), F.lit(":"), F.array_join(short, "."))


def likeness(one: Column, other: Column) -> Column:
    """Share of different leaves that two trees have in common, counting both (0 to 1); two empty texts are alike."""
    both, total = F.size(F.array_intersect(one, other)), F.size(F.array_distinct(one)) + F.size(F.array_distinct(other))
    return F.when(total > 0, F.round(2.0 * both / total, 6)).otherwise(1.0)


def changed_span(one: str, other: str) -> tuple[Column, Column]:
    """(start, end) in code points of the leaves of `one` that differ from `other`: those between the equal ones at both ends.

    Equal texts give (NULL, NULL).  An insertion between equal leaves gives an empty span.
    """
    a, b, lengths = F.col(f"{one}_leaves"), F.col(f"{other}_leaves"), F.col(f"{one}_lengths")
    shorter = F.least(F.size(a), F.size(b))

    def equal_at_start(left: Column, right: Column) -> Column:
        differ = F.array_position(F.zip_with(left, right, lambda x, y: ~x.eqNullSafe(y)), True).cast("int")
        return F.when(differ > 0, differ - 1).otherwise(shorter)

    head = F.least(equal_at_start(a, b), shorter)
    tail = F.least(equal_at_start(F.reverse(a), F.reverse(b)), shorter - head)
    total = lambda part: F.aggregate(part, F.lit(0), lambda x, y: x + y).cast("bigint")
    differs = F.col(f"{one}_root") != F.col(f"{other}_root")
    start = total(F.slice(lengths, F.lit(1), head))
    return F.when(differs, start), F.when(differs, total(F.slice(lengths, F.lit(1), F.size(a) - tail)))


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(`key`, `n_chars`, `_text`, `_third`, `_head`, `next_leaves`): each row with what it needs of the next document.

    `_head` is as many first code points of the next document as a third of this one has, `next_leaves` its leaves.  The next document
    is the one with the next smaller whole-number key; after the smallest comes the largest, and a NULL key counts as the
    smallest 64-bit number.  Where rows share a key, the smallest text is the next document.  Texts move once; of a next document
    only the wanted head and the digests move on.
    """
    none = F.lit(-(1 << 63))
    # Both joins below read these rows with the same two columns, so that the texts are dealt by key once.
    rows = docs.select(F.coalesce(F.col(key).cast("bigint"), none).alias("_k"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    third = F.floor(F.length("_text") / 3).cast("int")
    order = ranked(rows.groupBy("_k").agg(F.max(third).alias("_want")), [F.col("_k").desc()])
    size = order.agg(F.count("*")).head()[0]
    # Each key learns the key before it, which is the one that wants its head.
    before = order.select(F.col("_k").alias("_for"), "_want", ((F.col("rank") + 1) % F.lit(max(size, 1))).alias("rank"))
    links = before.join(order.select("_k", "rank"), "rank").drop("rank")
    first = Window.partitionBy("_k").orderBy("_text")
    heads = (
        rows.join(links, "_k")
        .withColumn("_n", F.row_number().over(first)).where("_n = 1")
        .select("_for", F.expr("left(_text, _want)").alias("_head"), short_digests(leaf_digests(F.col("_text"))).alias("next_leaves"))
    )
    return rows.join(heads, F.col("_k") == F.col("_for")).select(
        F.nullif("_k", none).alias(key), "_text", F.length("_text").cast("bigint").alias("n_chars"), third.alias("_third"), "_head", "next_leaves"
    )


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_next(read(spark, sf_dir, "documents"))
    edited = F.concat(F.expr("left(_text, int(n_chars) - _third)"), F.expr("left(_head, _third)"))
    rows = with_tree(with_tree(rows.withColumn("_edited", edited), "_text", "own"), "_edited", "edited")
    start, end = changed_span("own", "edited")
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint("own").alias("fingerprint"), fingerprint("edited").alias("edited_fingerprint"),
        likeness(F.col("own_leaves"), F.col("edited_leaves")).alias("near_edited"),
        likeness(short_digests(F.col("own_leaves")), F.col("next_leaves")).alias("near_next"), start.alias("edit_start"), end.alias("edit_end"),
    )
