"""Toxicity of whole texts: a support vector machine on a gap-weighted subsequence kernel, with Nyström landmarks.

A text becomes 31 letters (the plain ones and classes of common accented ones; look-alike digits and signs read as letters, one blank for everything else, blanks
between single letters closed).  Its sentences are compared in windows of WINDOW symbols.  The kernel of two windows counts
the subsequences of four symbols that both have, each weighted by DECAY for every symbol it skips (at most two), over the root of the
windows' lengths.  Inserted characters and gaps so only weaken a match.

Kernel features are few enough (32 ** 4) to be written out, hence the decision function of the machine, a sum of kernels to
landmarks, becomes one table of weights: scoring a text is looking up ten numbers per symbol, and is the exact kernel sum.
The score of a text is the calibrated largest margin of its windows.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.llm.common import give_back, held_out, keep_about, map_texts, read, slices

SYMBOLS = 32
LENGTH, MOST_GAPS, DECAY = 4, 2, 0.75
WINDOW, STEP = 24, 6
#: Rows of a matrix that the driver holds in double precision at once, beside the matrix itself.
PART = 512
#: Signs that stand for letters in disguised words (fixed values).
LOOKS_LIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
#: Accented letters that have a class of their own; others are read without their accent.
ACCENTED = ("é", "èêàâ", "äá", "öóüú", "ñçßí")
#: Skips before the second, third and fourth symbol.
GAPS = [(a, b, c) for a in range(3) for b in range(3) for c in range(3) if a + b + c <= MOST_GAPS]
FEATURES = SYMBOLS**LENGTH


@functools.cache
def _codes() -> np.ndarray:
    """Code point -> 1 to 26 for a plain letter (other scripts are folded on them), 27 to 31 for accented ones, 0 for the rest."""
    table = np.zeros(0x110000, np.uint8)
    for point in range(0x110000):
        char = chr(point)
        if char.isalpha():
            plain = unicodedata.normalize("NFKD", char)[0].lower() if point < 0x2C00 else char
            table[point] = ord(plain) - 96 if "a" <= plain <= "z" else 1 + point % 26
    for place, letters in enumerate(ACCENTED):
        for char in letters + letters.upper().replace("SS", "ẞ"):
            table[ord(char)] = 27 + place
    return table


@functools.cache
def _disguised() -> np.ndarray:
    table = np.zeros(128, np.uint8)
    for sign, letter in LOOKS_LIKE.items():
        table[ord(sign)] = ord(letter) - 96
    return table


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols of all texts, each with blanks around it; first and end position of each text)."""
    # Eight blanks part two texts, more than any subsequence spans; they come as zeros that are kept.
    joined = ("\0" * 8).join((text or "").replace("\0", " ") for text in texts) + "\0" * 8
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = _codes()[points]
    # A sign is a disguised letter only before one: digits in numbers and marks at the end of words stay blanks.
    small = np.flatnonzero((codes == 0) & (points < 128) & (points > 0))
    small = small[_disguised()[points[small]] > 0]
    after = codes[np.minimum(small + 1, len(codes) - 1)] > 0
    before = (codes[small - 1] > 0) & (small > 0)
    inside = small[after & (before | (points[small] != ord("!")))]
    codes[inside] = _disguised()[points[inside]]
    kept = points == 0
    blank = (codes == 0) & ~kept
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    codes, kept = codes[keep], kept[keep]
    # Blanks between two single letters are closed, so spaced-out words read as words.
    letter = codes > 0
    padded = np.concatenate(([False, False], letter, [False, False]))
    single_before = padded[1:-3] & ~padded[:-4]
    single_after = padded[3:-1] & ~padded[4:]
    keep = letter | kept | ~(single_before & single_after)
    codes, kept = codes[keep], kept[keep]
    ends = np.flatnonzero(kept)[::8]
    return codes, np.concatenate(([0], ends[:-1] + 8)), ends


def positions(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For each position the sum of the table's weights over the subsequences that begin there."""
    n = len(codes)
    padded = np.concatenate((codes, np.zeros(LENGTH + MOST_GAPS, np.uint8))).astype(np.int32)
    size = len(padded)
    pairs = [np.zeros(size, np.int32) for _ in range(MOST_GAPS + 1)]
    for gap, pair in enumerate(pairs):
        pair[: size - 1 - gap] = padded[: size - 1 - gap] * SYMBOLS + padded[1 + gap :]
    total = np.zeros(n, np.float32)
    for a, b, c in GAPS:
        second = 2 + a + b
        key = pairs[a][:n] * (SYMBOLS * SYMBOLS)
        key += pairs[c][second : second + n] if second + n <= size else np.pad(pairs[c][second:], (0, second + n - size))
        total += table[key] * np.float32(DECAY ** (a + b + c))
    return total


def window_features(window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, weights) of one window, repeated features added up."""
    keys, weights = [], []
    for a, b, c in GAPS:
        second, third, fourth = 1 + a, 2 + a + b, 3 + a + b + c
        n = len(window) - fourth
        if n > 0:
            w = window.astype(np.int64)
            keys.append(((w[:n] * SYMBOLS + w[second : second + n]) * SYMBOLS + w[third : third + n]) * SYMBOLS + w[fourth : fourth + n])
            weights.append(np.full(n, DECAY ** (a + b + c)))
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0)
    found, place = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(place, np.concatenate(weights)) / np.sqrt(len(window))


def window_sums(values: np.ndarray, start: int, end: int) -> np.ndarray:
    """Sums over the windows of one text; a short text is one window."""
    sums = np.concatenate(([0.0], np.cumsum(values[start:end], dtype=np.float64)))
    firsts = np.arange(0, max(1, end - start - WINDOW + STEP), STEP)
    lasts = np.minimum(firsts + WINDOW, end - start)
    return (sums[lasts] - sums[firsts]) / np.sqrt(np.maximum(lasts - firsts, 1))


@dataclass
class ToxicityModel:
    """`table` is the kernel expansion over features; a text's largest margin m gives 1 / (1 + exp(-slope * m - constant))."""

    table: np.ndarray
    slope: float
    constant: float

    def margins(self, texts: list[str | None]) -> np.ndarray:
        codes, starts, ends = symbols(texts)
        values = positions(codes, self.table)
        return np.array([window_sums(values, start, end).max() for start, end in zip(starts, ends)])

    def score(self, texts: list[str | None]) -> np.ndarray:
        return np.round(1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.constant, -50, 50))), 6)


def _kernel(windows: list[np.ndarray], landmarks: list[np.ndarray]) -> np.ndarray:
    """Kernel of every window with every landmark."""
    parts = [window_features(mark) for mark in landmarks]
    every = np.concatenate([keys for keys, _ in parts])
    order = np.argsort(every, kind="stable")
    # The landmarks that have a feature, feature by feature: a matrix of both would be some hundred times as large.
    features, starts = np.unique(every[order], return_index=True)
    counts = np.diff(np.append(starts, len(every)))
    columns = np.repeat(np.arange(len(landmarks)), [len(keys) for keys, _ in parts])[order]
    entries = np.concatenate([weights for _, weights in parts]).astype(np.float32)[order]
    dense = np.zeros((len(GAPS) * max(map(len, windows), default=0), len(landmarks)), np.float32)
    found = np.zeros((len(windows), len(landmarks)), np.float32)
    for row, window in enumerate(windows):
        keys, weights = window_features(window)
        place = np.minimum(np.searchsorted(features, keys), len(features) - 1)
        good = features[place] == keys
        if good.any():
            place = place[good]
            times = counts[place]
            at = np.repeat(starts[place] - np.cumsum(times) + times, times) + np.arange(times.sum())
            lines = np.repeat(np.arange(len(place)), times)
            dense[lines, columns[at]] = entries[at]
            found[row] = weights[good].astype(np.float32) @ dense[: len(place)]
            dense[lines, columns[at]] = 0
    return found


def _squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float, steps: int = 25) -> np.ndarray:
    """Primal support vector machine with squared hinge loss, by Newton steps; the last column of x is the constant."""
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(steps):
        left, right = ridge.copy(), np.zeros(len(w))
        for start in range(0, len(x), 4000):
            part, side = x[start : start + 4000], y[start : start + 4000]
            margin = np.concatenate([part[i : i + PART] @ w for i in range(0, len(part), PART)])
            active = np.flatnonzero(side * margin < 1)
            near = np.empty((len(active), len(w)))
            for i in range(0, len(active), PART):
                near[i : i + PART] = part[active[i : i + PART]]
            share = cost * weight[start : start + 4000][active]
            for i in range(0, len(w), PART // 4):
                weighted = near.T[i : i + PART // 4] * share
                left[i : i + PART // 4] += weighted @ near
                right[i : i + PART // 4] += weighted @ side[active]
        new = np.linalg.solve(left, right)
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w


def _logistic(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Platt's calibration: slope and constant on targets drawn in from 0 and 1."""
    n1, n0 = label.sum(), (1 - label).sum()
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    centre, width = margin.mean(), max(margin.std(), 1e-9)
    x = np.stack([(margin - centre) / width, np.ones(len(margin))], axis=1)
    weight = np.full(len(margin), 1 / len(margin))
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        gradient = x.T @ (weight * (p - target)) + 1e-4 * w * [1, 0]
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-4, 1e-9])
        step = np.linalg.solve(hessian, gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / width), float(w[1] - w[0] * centre / width)


def fit(
    docs: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", rows_per_label: int = 2500,
    most_chars: int = 20_000, landmarks: int = 600, rounds: int = 2, cost: float = 100.0, seed: int = 7,
) -> ToxicityModel:
    """Learn from rows labelled 0 or 1.

    The sample is bounded: about `rows_per_label` texts of each label, chosen by a hash of the key, of at most `most_chars`
    characters; it comes to the driver as one byte per letter.  A label holds for all sentences of its text.  Since most sentences of
    a toxic text are harmless, only its most telling windows count as toxic; the choice starts from the odds of the
    features and is made anew with each round's machine.  Without both labels every text gets score 0.
    """
    rows = docs.where(F.col(label).isin(0, 1) & F.col(text).isNotNull() & (F.length(text) <= most_chars)).select(
        F.col(key).alias("_key"), F.col(label).cast("int").alias("_label"), F.col(text).alias("_text")
    )
    counts = {row["_label"]: row["count"] for row in rows.groupBy("_label").count().collect()}
    if len(counts) < 2:
        return ToxicityModel(np.zeros(FEATURES, np.float32), 0.0, -50.0)
    pairs = [F.lit(part) for one in counts for part in (one, rows_per_label / counts[one])]
    chosen = rows.where(keep_about(F.col("_key"), F.create_map(*pairs)[F.col("_label")])).select("_key", "_label", "_text")

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text", 2_000_000):
                codes, starts, ends = symbols(part.column("_text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("_key").cast(pa.string()), part.column("_label"), pa.array([codes[s:e].tobytes() for s, e in zip(starts, ends)])],
                    names=["_key", "_label", "codes"],
                )

    # Sorted, so that a rerun learns the same whatever the order of the tasks.
    sample = sorted((row["_key"], row["_label"], bytes(row["codes"])) for row in chosen.mapInArrow(coded, "_key string, _label int, codes binary").collect())
    texts = [np.frombuffer(codes, np.uint8) for _, _, codes in sample]
    labels = np.array([one for _, one, _ in sample], float)
    del sample
    model = _learn(texts, labels, landmarks, rounds, cost, np.random.default_rng(seed))
    del texts
    give_back()
    return model


def _learn(texts: list[np.ndarray], labels: np.ndarray, n_landmarks: int, rounds: int, cost: float, rng: np.random.Generator) -> ToxicityModel:
    if len(set(labels.tolist())) < 2:
        return ToxicityModel(np.zeros(FEATURES, np.float32), 0.0, -50.0)
    # Odds of each feature: in how many texts of either label it stands.
    seen = np.zeros((2, FEATURES), np.float32)
    for text, one in zip(texts, labels):
        seen[int(one)][window_features(text)[0]] += 1
    totals = [max(1, (labels == one).sum()) for one in (0, 1)]
    table = (np.log((seen[1] + 0.5) / (totals[1] + 1)) - np.log((seen[0] + 0.5) / (totals[0] + 1))).astype(np.float32)
    # Rare features say little yet.
    table[seen.sum(axis=0) < 3] = 0
    del seen
    first: list[list[int]] = [[] for _ in texts]
    for turn in range(rounds):
        sums = [window_sums(positions(text, table), 0, len(text)) for text in texts]
        usual = np.quantile([one.max() for one, label in zip(sums, labels) if not label], 0.98)
        toxic, harmless = [], []
        for text, one, label, by_odds in zip(texts, sums, labels, first):
            if label:
                # What the odds point at stays, or a machine that knows the plainest words would forget the others.
                picks = _peaks(one, usual, 5) + by_odds
                by_odds += picks * (turn == 0)
            else:
                # The hardest windows and others at random.
                picks = _peaks(one, np.inf, 1) + _peaks(one, one.max() * 0.6, 3) + rng.integers(0, len(one), 3).tolist()
            (toxic if label else harmless).extend(text[i * STEP : i * STEP + WINDOW] for i in sorted(set(picks)))
        windows = toxic + harmless
        y = np.concatenate((np.ones(len(toxic)), -np.ones(len(harmless))))
        marks = [toxic[i] for i in rng.permutation(len(toxic))[: n_landmarks * 3 // 4]]
        marks += [harmless[i] for i in rng.permutation(len(harmless))[: n_landmarks - len(marks)]]
        inner = _kernel(marks, marks).astype(np.float64)
        values, vectors = np.linalg.eigh((inner + inner.T) / 2)
        good = values > 1e-4 * values[-1]
        root = vectors[:, good] / np.sqrt(values[good])
        x = np.ones((len(windows), root.shape[1] + 1), np.float32)
        for start in range(0, len(windows), 4000):
            found = _kernel(windows[start : start + 4000], marks)
            for i in range(0, len(found), PART):
                x[start + i : start + min(i + PART, len(found)), :-1] = found[i : i + PART] @ root
        del found
        weight = np.where(y > 0, len(y) / (2 * len(toxic)), len(y) / (2 * len(harmless)))
        w = _squared_hinge(x, y, weight, cost / len(y) * 100)
        del x  # or the next round's would be made beside it
        give_back()
        share = root @ w[:-1]
        table = np.zeros(FEATURES, np.float64)
        for mark, part in zip(marks, share):
            keys, weights = window_features(mark)
            table[keys] += part * weights
        table = table.astype(np.float32)
    margins = np.array([window_sums(positions(text, table), 0, len(text)).max() for text in texts])
    slope, constant = _logistic(margins, labels)
    return ToxicityModel(table, max(slope, 0.0), constant)


def _peaks(sums: np.ndarray, least: float, most: int) -> list[int]:
    """The highest windows, at most `most` that do not overlap; the first always, the others if they reach `least`."""
    picks: list[int] = []
    left = sums.copy()
    apart = WINDOW // STEP
    while len(picks) < most:
        i = int(left.argmax())
        if picks and not left[i] >= least:
            break
        picks.append(i)
        left[max(0, i - apart + 1) : i + apart] = -np.inf
    return picks


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", keep_text: bool = False) -> DataFrame:
    """Add `score`, 0 to 1; the text column is left out unless `keep_text`.

    NULL, empty and letterless texts are scored like any other, as one window without features.  Repeated rows stay repeated.  A
    column `score` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs.drop("score"), "score double", lambda texts: [shared.value.score(texts)], text, keep_text)


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents of a bounded sample of labels: its size is a parameter of `sampled_labels`, so it may be broadcast."""
    return docs.select("doc_id", "text").join(F.broadcast(labels), "doc_id")


def sampled_labels(labels: DataFrame, key: str = "doc_id", label: str = "toxic", rows_per_label: int = 4000) -> DataFrame:
    """About `rows_per_label` labelled keys of each label outside the held-out third; a key with both labels is toxic."""
    rows = labels.where(F.col(label).isin(0, 1) & ~held_out(key)).groupBy(key).agg(F.max(label).alias(label))
    counts = {row[label]: row["count"] for row in rows.groupBy(label).count().collect()}
    if not counts:
        return rows
    pairs = [F.lit(part) for one in counts for part in (one, rows_per_label / counts[one])]
    return rows.where(keep_about(F.col(key), F.create_map(*pairs)[F.col(label)]))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(labelled(docs, sampled_labels(read(spark, sf_dir, "labels"))))
    scored = score(docs.select("doc_id", held_out("doc_id").alias("held_out"), "text"), model)
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
