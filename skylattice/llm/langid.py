"""Language of whole texts: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased, every run of characters that are no letters becomes one blank, and each run of one to three
characters is hashed into a fixed number of buckets.  The model is a matrix of log probabilities, labels by buckets, held
as whole numbers, so that sums are exact and equal texts get equal scores in whatever batch they come.  It is broadcast:
its size is the number of labels times the number of buckets, whatever the corpus.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.llm.common import held_out, keep_about, map_texts, read, slices

UNKNOWN = "und"
ORDERS = 3
BUCKET_BITS = 15
#: Log probabilities are multiples of 1 / SCALE.
SCALE = 4096
_BLANK = 32


@functools.cache
def _letters() -> np.ndarray:
    """Code point -> its lower-case letter, or a blank."""
    table = np.full(0x110000, _BLANK, np.uint32)
    for point in range(0x110000):
        char = chr(point)
        if char.isalpha():
            table[point] = ord(char.lower()[0])
    table[0] = 0
    return table


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letters of all texts with blanks between words, first and end position of each text).

    Two zeros stand after each text, so n-grams that begin in a text never reach the next one.
    """
    joined = "\0\0".join((text or "").replace("\0", " ") for text in texts) + "\0\0"
    letters = _letters()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    blank = letters == _BLANK
    keep = np.ones(len(letters), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    letters = letters[keep]
    zeros = np.flatnonzero(letters == 0)
    ends = zeros[::2]
    return letters, np.concatenate(([0], ends[:-1] + 2)), ends


def buckets(letters: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Bucket of the n-gram that begins at each position (the last positions of all get that of a shorter one)."""
    padded = np.concatenate((letters, np.zeros(order - 1, np.uint32)))
    mixed = np.full(len(letters), 0x9E3779B1 * order & 0xFFFFFFFF, np.uint32)
    for step in range(order):
        mixed ^= padded[step : step + len(letters)]
        mixed *= np.uint32(0x85EBCA6B)
        mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0xC2B2AE35)
    return (mixed >> np.uint32(32 - bits)).astype(np.int64)


@dataclass
class LanguageModel:
    """`table[label, bucket]` are log probabilities in units of 1 / SCALE, `prior[label]` likewise."""

    labels: list[str]
    table: np.ndarray
    prior: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        letters, starts, ends = symbols(texts)
        seen = np.concatenate(([0], np.cumsum((letters != _BLANK) & (letters != 0))))
        known = (seen[ends] > seen[starts]) & bool(self.labels)
        if not self.labels:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        cells = [buckets(letters, order, BUCKET_BITS) for order in range(1, ORDERS + 1)]
        sums = np.empty((len(self.labels), len(texts)), np.int64)
        for label, row in enumerate(self.table):
            total = np.concatenate(([0], np.cumsum(sum(row[cell] for cell in cells), dtype=np.int64)))
            sums[label] = total[ends] - total[starts] + self.prior[label]
        best = sums.argmax(axis=0)
        odds = np.exp(np.minimum(0, (sums - sums.max(axis=0)) / SCALE))
        score = np.round(1 / odds.sum(axis=0), 6)
        return (
            [self.labels[b] if k else UNKNOWN for b, k in zip(best, known)],
            np.where(known, score, 0.0).tolist(),
        )


def fit(
    docs: DataFrame, key: str = "doc_id", label: str = "lang", text: str = "text", rows_per_label: int = 8000, smoothing: float = 0.5
) -> LanguageModel:
    """Learn from the rows whose label and text are not NULL.

    About `rows_per_label` whole texts of each label are used (all, if there are fewer), chosen by a hash of the key.  Each
    task adds up its own counts; what is shuffled and collected is bounded by labels times buckets.
    """
    rows = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).alias("_key"), F.col(label).cast("string").alias("_label"), F.col(text).alias("_text")
    )
    counts = {row["_label"]: row["count"] for row in rows.groupBy("_label").count().collect()}
    labels = sorted(counts)
    if not labels:
        return LanguageModel([], np.zeros((0, 1 << BUCKET_BITS), np.int32), np.zeros(0, np.int64))
    pairs = [F.lit(part) for name in labels for part in (name, rows_per_label / counts[name])]
    chosen = rows.where(keep_about(F.col("_key"), F.create_map(*pairs)[F.col("_label")])).select("_label", "_text")
    index = {name: i for i, name in enumerate(labels)}
    width = 1 << BUCKET_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(index) * width, np.int64)
        for batch in batches:
            for part in slices(batch, "_text", 2_000_000):
                letters, starts, ends = symbols(part.column("_text").to_pylist())
                owner = np.full(len(letters), -1, np.int64)
                for name, start, end in zip(part.column("_label").to_pylist(), starts, ends):
                    owner[start:end] = index[name] * width
                inside = owner >= 0
                for order in range(1, ORDERS + 1):
                    cells = (owner + buckets(letters, order, BUCKET_BITS))[inside]
                    total += np.bincount(cells, minlength=len(total))
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], names=["cell", "n"])

    sums = chosen.mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    dense = np.zeros(len(labels) * width)
    dense[sums["cell"].to_numpy(np.int64)] = sums["n"].to_numpy(float)
    dense = dense.reshape(len(labels), width) + smoothing
    table = np.round(np.log(dense / dense.sum(axis=1, keepdims=True)) * SCALE).astype(np.int32)
    shares = np.array([counts[name] for name in labels], float)
    return LanguageModel(labels, table, np.round(np.log(shares / shares.sum()) * SCALE).astype(np.int64))


def predict(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Add `lang_pred` and `score` (the posterior probability, 0 to 1); the text column is left out.

    NULL, empty and letterless texts get `und` with score 0, and so does everything if nothing could be learned.  Ties go
    to the label that sorts first.  Repeated rows stay repeated, further columns stay as they are, but for columns of these two
    names, which are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score")
    return map_texts(docs, "lang_pred string; score double", lambda texts: shared.value.predict(texts), text)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out("doc_id")))
    return predict(docs.select("doc_id", held_out("doc_id").alias("held_out"), "text"), model)
