"""Secrets in whole texts: three fixed patterns, and a battery of randomness tests for every other long token.

A token is a run of 16 or more of the characters that keys are written in.  Its encoding is inferred (the smallest
alphabet that holds all its characters), and three tests ask whether its symbols are even and independent: chi-squared
against the even distribution, the number of runs above and below the middle of the alphabet, and the correlation of
neighbours.  Fisher's method combines them.  A token that fails is not random.  One that passes may still be a word, if it is
short: so a second probability says how often written words of that length and alphabet look so even and change so
often between small letters, capitals and digits.  False discoveries are controlled on that one, over all tokens of all documents in
the same band of lengths (Benjamini and Hochberg, on a histogram of fixed size).
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.llm.common import map_texts, numbered_columns, read, slices

#: Fixed patterns, in the order in which kinds are listed.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "random")
WORDS = (b"passw", b"secret", b"token", b"api")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX, MIN_TOKEN = 12, 18, 16, 16

_TOKEN = np.zeros(256, bool)
_TOKEN[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"]] = True
#: Alphabets from small to large; a token's encoding is the first that holds it.
ALPHABETS = [
    ("decimal", "0123456789"),
    ("hex", "0123456789abcdef"),
    ("hex upper", "0123456789ABCDEF"),
    ("lower", "abcdefghijklmnopqrstuvwxyz"),
    ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("lower and digits", "abcdefghijklmnopqrstuvwxyz0123456789"),
    ("upper and digits", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"),
    ("letters", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base62", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64 for urls", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    ("any", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
]
_PLACES = []
for _, _chars in ALPHABETS:
    _row = np.full(256, -1, np.int64)
    _row[[*_chars.encode()]] = np.arange(len(_chars))
    _PLACES.append((_row, len(_chars)))
#: Kind of each character: capital, small letter, digit, other.
_CLASS = np.full(256, 3, np.int8)
_CLASS[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 0
_CLASS[[*b"abcdefghijklmnopqrstuvwxyz"]] = 1
_CLASS[[*b"0123456789"]] = 2

#: How written words differ from random ones: the chance that two letters of a word are equal, and the chance that the next
#: character is of another class.
SAME_LETTER, SWITCH = 0.066, 0.08
#: Lowest length of each band, and the finest probability that is told apart: 10 ** (-LAST / STEPS).
BANDS = (16, 20, 24, 32, 48, 96)
STEPS, LAST = 4, 200


def _tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _fisher(ps: list[float]) -> float:
    """Chance of a product as small, for independent even probabilities."""
    half = -sum(math.log(max(p, 1e-300)) for p in ps)
    term, total = 1.0, 1.0
    for i in range(1, len(ps)):
        term *= half / i
        total += term
    return min(1.0, math.exp(-half) * total)


def battery(token: bytes) -> tuple[float, float, str]:
    """(probability of tests this bad if random, probability of looking this random if written, encoding)."""
    raw = np.frombuffer(token, np.uint8)
    n = len(raw)
    for (places, size), (name, _) in zip(_PLACES, ALPHABETS):
        index = places[raw]
        if index.min() >= 0:
            break
    squares = float((np.bincount(index) ** 2).sum())
    chi = squares * size / n - n
    spread = math.sqrt(2 * (size - 1) * (n - 1) / n)
    even = _tail((chi - (size - 1)) / spread)
    high = index >= size / 2
    above = int(high.sum())
    if 0 < above < n:
        runs = 1 + int((high[1:] != high[:-1]).sum())
        expected = 2 * above * (n - above) / n + 1
        variance = (expected - 1) * (expected - 2) / (n - 1)
        steady = 2 * _tail(abs(runs - expected) / math.sqrt(max(variance, 1e-9))) if variance > 0 else 1.0
    else:
        steady = 2 * 0.5**n
    centred = index - index.mean()
    power = float((centred**2).sum())
    serial = 0.0 if power == 0 else 2 * _tail(abs(float((centred[1:] * centred[:-1]).sum()) / power + 1 / n) * math.sqrt(n))
    random = _fisher([even, min(1.0, steady), min(1.0, serial)])
    # A written token with more classes is still letters for the most part: it repeats symbols as often as words do.
    same = max(SAME_LETTER, 1.5 / size)
    mean = size * (1 + (n - 1) * same) - n
    flat = _tail((mean - chi) / (spread * math.sqrt(size * same)))
    kinds = _CLASS[raw]
    switches = int((kinds[1:] != kinds[:-1]).sum())
    often = _at_least(switches, n - 1, SWITCH)
    return random, _fisher([flat, often]), name


def _at_least(k: int, n: int, p: float) -> float:
    """Upper tail of the binomial distribution."""
    if k == 0:
        return 1.0
    logs = [
        math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
        for i in range(k, min(n, k + 200) + 1)
    ]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


@dataclass
class Found:
    """Spans of one text in code points: `base` as (start, place of the kind, end), `tokens` as (start, end, band, bin)."""

    base: list[tuple[int, int, int]] = field(default_factory=list)
    tokens: list[tuple[int, int, int, int]] = field(default_factory=list)


def find(texts: list[str | None], random_at_least: float = 1e-3) -> list[Found]:
    """Base spans of each text, and its tokens that pass the tests, each with the bin of its second probability."""
    found = [Found() for _ in texts]
    raws = [(text or "").encode("utf-8", "surrogatepass") for text in texts]
    for text, raw, one in zip(texts, raws, found):
        small = raw.lower()
        if any(word in small for word in WORDS):
            for hit in ASSIGN.finditer(text):
                if len(hit[2]) >= MIN_ASSIGN:
                    one.base.append((hit.start(), 0, hit.end()))
    joined = b"\n".join(raws)
    flags = np.concatenate(([False], _TOKEN[np.frombuffer(joined, np.uint8)], [False]))
    edges = np.flatnonzero(flags[1:] != flags[:-1])
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= MIN_TOKEN
    firsts = np.concatenate(([0], np.cumsum([len(raw) + 1 for raw in raws])[:-1])) if raws else np.zeros(0, int)
    owners = np.searchsorted(firsts, starts[long], "right") - 1
    points: dict[int, np.ndarray] = {}
    for owner, start, end in zip(owners.tolist(), starts[long].tolist(), ends[long].tolist()):
        one, first, token = found[owner], int(firsts[owner]), joined[start:end]
        if len(texts[owner]) == len(raws[owner]):
            at = lambda i, first=first: i - first
        else:
            if owner not in points:
                points = {owner: np.concatenate(([0], np.cumsum(np.frombuffer(raws[owner], np.uint8) & 0xC0 != 0x80)))}
            at = lambda i, first=first, place=points[owner]: int(place[i - first])
        for kind, pattern, least in ((1, ACCESS, MIN_ACCESS), (2, HEX, MIN_HEX)):
            for hit in pattern.finditer(token):
                if hit.end() - hit.start() >= least:
                    one.base.append((at(start + hit.start()), kind, at(start + hit.end())))
        random, written, _ = battery(token)
        if random >= random_at_least:
            band = sum(end - start >= least for least in BANDS) - 1
            cell = min(LAST, int(-math.log10(max(written, 1e-300)) * STEPS))
            one.tokens.append((at(start), at(end), band, cell))
    for one in found:
        one.base.sort()
        one.tokens = [
            token for token in one.tokens if not any(start < token[1] and token[0] < end for start, _, end in one.base)
        ]
    return found


def thresholds(docs: DataFrame, text: str = "text", rate: float = 0.01) -> list[int]:
    """For each band of lengths the lowest bin that counts as a discovery, so that about `rate` of them are false.

    All tokens of all documents count.  Only a histogram of bands by bins leaves the tasks.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(BANDS), LAST + 1), np.int64)
        for batch in batches:
            for part in slices(batch, "_text", 2_000_000):
                for one in find(part.column("_text").to_pylist()):
                    for _, _, band, cell in one.tokens:
                        total[band, cell] += 1
        band, cell = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(band), pa.array(cell), pa.array(total[band, cell])], names=["band", "cell", "n"]
        )

    rows = docs.select(F.col(text).alias("_text")).mapInArrow(count, "band bigint, cell bigint, n bigint")
    total = np.zeros((len(BANDS), LAST + 1), np.int64)
    for row in rows.groupBy("band", "cell").agg(F.sum("n").alias("n")).collect():
        total[row["band"], row["cell"]] = row["n"]
    least = []
    for counts in total:
        reached = counts[::-1].cumsum()[::-1]
        expected = counts.sum() * 10.0 ** (-np.arange(LAST + 1) / STEPS)
        good = np.flatnonzero((expected <= rate * reached) & (reached > 0))
        least.append(int(good[0]) if len(good) else LAST + 1)
    return least


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def _all_spans(one: Found, least: list[int]) -> list[tuple[int, int, int]]:
    return sorted(one.base + [(start, 3, end) for start, end, band, cell in one.tokens if cell >= least[band]])


def scan(docs: DataFrame, least: list[int], text: str = "text") -> DataFrame:
    """Add `n_assign`, `n_access`, `n_hex`, `n_random`, `base_sha256` and `spans`; the text column is left out.

    A NULL text counts as empty: no spans, and the digest of the empty string.  Repeated rows stay repeated.  Columns that already have
    one of these names are replaced.
    """
    names = ["n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"]

    def work(texts: list[str | None]) -> list:
        columns: list[list] = [[] for _ in names]
        for one in find(texts):
            spans = _all_spans(one, least)
            for kind in range(4):
                columns[kind].append(sum(span[1] == kind for span in spans))
            columns[4].append(hashlib.sha256(_written(one.base).encode()).hexdigest())
            columns[5].append(_written(spans))
        return columns

    schema = "; ".join(f"{name} {'bigint' if name[0] == 'n' else 'string'}" for name in names)
    return map_texts(docs.drop(*names), schema, work, text)


def masked(docs: DataFrame, least: list[int], text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The same rows with every span replaced by `mark`; overlapping spans become one.

    A NULL text stays NULL, repeated rows stay repeated, columns may have any names.
    """
    order = docs.columns
    docs, own = numbered_columns(docs)
    names, text = docs.columns, own[text]

    def work(texts: list[str | None]) -> list:
        changed = []
        for value, one in zip(texts, find(texts)):
            parts, done = [], 0
            for start, _, end in _all_spans(one, least):
                if start >= done:
                    parts += [value[done:start], mark]
                done = max(done, end)
            changed.append(value if not parts else "".join(parts) + value[done:])
        return [changed]

    renamed = docs.withColumnRenamed(text, "_raw")
    return map_texts(renamed, f"{text} string", work, "_raw").select(*names).toDF(*order)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, thresholds(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random")
