"""A corpus pipeline: toxic documents go, one of each group of near copies stays, secrets are masked, sources are mixed to
target weights, and the mix is packed into windows of tokens.

Every stage is written and read again, so a lost executor costs no more than the stage it was lost in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.llm import jaccard, mixing, packing, secrets, toxicity
from skylattice.llm.common import numbered_columns, read
from skylattice.session import scratch_folder

#: From this score on a document is toxic.
TOXIC_FROM = 0.7
#: Near copies share at least so many percent of their shingles of so many words.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC_FROM, unchanged; learned from the labels outside the held-out third.

    NULL and empty texts are scored like others, repeated rows stay repeated.  Without labels nothing is toxic.
    """
    labels = toxicity.sampled_labels(read(spark, sf_dir, "labels"))
    model = toxicity.fit(toxicity.labelled(docs, labels))
    rows, names = numbered_columns(docs)
    kept = toxicity.score(rows, model, names["text"], keep_text=True).where(F.col("score") < TOXIC_FROM)
    return kept.select(*rows.columns).toDF(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies (links at NEAR_PERCENT % of shingles of NEAR_WORDS words).

    Documents without words are linked with nothing and stay.  Rows that share an id are one document only where their texts
    belong to one group; NULL ids come last, and of groups without an id one document stays.
    """
    return jaccard.one_of_each_group(docs, words=NEAR_WORDS, percent=NEAR_PERCENT)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in the place of every secret; n_chars, where there is one, follows the text.  A NULL text stays NULL."""
    masked = secrets.masked(docs, secrets.thresholds(docs))
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it whole, and once cut where it takes a part; n_chars follows the text.

    Copies of a document are equal rows with its doc_id, and documents of their own in packing.  NULL texts hold no words and are not taken.
    """
    return mixing.mixed(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document in its sequence; a NULL text is the end id alone."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near duplicates", keep_one_of_each_group),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: Learned scores and tokeniser ids are nothing that SQL expresses.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{scratch_folder(spark, 'pipeline')}/{name.replace(' ', '-')}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
