"""Periodic runs of words, found in a grammar.

The words of a batch of texts are numbers.  Re-Pair replaces pairs of neighbouring symbols by new symbols (nonterminals), the most frequent
pairs first, until no pair stands twice; what is left of a text is halved over and over.  A run lies across the
boundary between the two halves of the smallest nonterminal that holds it whole, and is at least four periods long, so on one side of that boundary two
periods stand side by side.  For each nonterminal all periods are tried at its boundary once, by hashes; what is found is
carried to every place where the nonterminal was made, and of intervals with the same period only the maximal ones stay.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.llm.common import read, slices

#: A run has at least so many words, and at least so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Trials (nonterminal, period) that are worked on at a time.
STEP = 1 << 20
#: Stretches are compared modulo these primes, each with a base of its own.
PRIMES, BASES = (2147483647, 2147483629), (1103515245, 747796405)


class Text:
    """Equality of stretches of numbers, by polynomial hashes of random words modulo two primes of 31 bits."""

    def __init__(self, words: np.ndarray):
        self.words, self.power, self.sums = words, [], []
        draw = np.random.default_rng(20240229)
        for prime, base in zip(PRIMES, BASES):
            power = np.ones(1, np.int64)
            while len(power) <= len(words):
                power = np.concatenate((power, power * pow(base, len(power), prime) % prime))
            drawn = draw.integers(1, prime, int(words.max(initial=-1)) + 1)
            sums = np.concatenate((np.zeros(1, np.int64), np.cumsum(drawn[words] * power[: len(words)] % prime)))
            self.power.append(power)
            self.sums.append(sums % prime)

    def equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the stretches from `a` and from `b` >= a, `size` long, are the same."""
        same = np.ones(len(a), bool)
        for prime, power, sums in zip(PRIMES, self.power, self.sums):
            same &= (sums[a + size] - sums[a]) % prime * power[b - a] % prime == (sums[b + size] - sums[b]) % prime
        return same

    def reach(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """For how many words, at most `most`, the text from `a` is that from `b` >= a; `back`: that before them."""
        low, high = np.zeros(len(a), np.int64), most.astype(np.int64).copy()
        while (open_ := low < high).any():
            mid = (low + high + 1) // 2
            shift = mid if back else 0
            fits = self.equal(a - shift, b - shift, mid)
            low = np.where(open_ & fits, mid, low)
            high = np.where(open_ & ~fits, mid - 1, high)
        return low


def _chosen(codes: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs to replace, and which of `codes` they are, none touching another: the better rank first, in a row of equal pairs every second from the left.

    `codes` are the places (increasing) of candidates, `rank` their order.
    """
    touch = np.flatnonzero(np.diff(codes) == 1)
    keep = np.ones(len(codes), bool)
    if not len(touch):
        return codes, keep
    before, after = np.zeros(len(codes), bool), np.zeros(len(codes), bool)
    before[touch + 1] = True
    after[touch] = True
    worse = np.zeros(len(codes), bool)
    worse[1:] |= before[1:] & (rank[:-1] < rank[1:])
    worse[:-1] |= after[:-1] & (rank[1:] < rank[:-1])
    keep &= ~worse
    # Rows of touching places with one rank.
    joined = np.zeros(len(codes), bool)
    joined[1:] = before[1:] & (rank[:-1] == rank[1:])
    start = np.flatnonzero(~joined)
    within = np.arange(len(codes)) - np.repeat(start, np.diff(np.append(start, len(codes))))
    keep &= within % 2 == 0
    return codes[keep], keep


def repair(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair over whole numbers `words`; pairs across two texts (`text` numbers them) are none.

    Returns for each replacement the rule's number, and the first word, boundary and end of what it covers, and at last the first
    words of the symbols that are left.  A round replaces the pairs at least a quarter as frequent as the most frequent one, those first that are
    more frequent; the rounds end when no pair is left twice.
    """
    symbols, starts = words.astype(np.int64), np.arange(len(words))
    # Places whose pair crosses a text's end or stands once: it will never stand twice, unless one of its symbols is replaced.
    over = np.append(text[1:] != text[:-1], True) if len(words) else np.zeros(0, bool)
    once = over.copy()
    size, rules, next_symbol = len(words), [], int(words.max(initial=-1)) + 1
    first_rule = next_symbol
    while True:
        places = np.flatnonzero(~once)
        code = symbols[places] * next_symbol + symbols[places + 1]
        # A pair alone in its bucket stands once; the others are counted exactly.
        buckets = 1 << max(10, min(20, len(places).bit_length() + 1))
        bucket = (_mixed(code) & np.uint64(buckets - 1)).astype(np.int64)
        several = np.bincount(bucket, minlength=buckets)[bucket] > 1
        once[places[~several]] = True
        places, code = places[several], code[several]
        pairs, number, count = np.unique(code, return_inverse=True, return_counts=True)
        once[places[count[number] == 1]] = True
        most = int(count.max(initial=0))
        if most < 2:
            break
        often = count >= max(2, most // 4)
        rank_of = np.empty(len(pairs), np.int64)
        rank_of[np.lexsort((pairs, -count))] = np.arange(len(pairs))
        wanted = often[number]
        rank = rank_of[number[wanted]]
        chosen, kept = _chosen(places[wanted], rank)
        # Each chosen pair has a rule of its own.
        named, rule = np.unique(rank[kept], return_inverse=True)
        behind = np.append(starts, size)[chosen + 2]
        rules.append((rule + next_symbol, starts[chosen], starts[chosen + 1], behind))
        symbols[chosen] = rule + next_symbol
        over[chosen] = over[chosen + 1]
        once[chosen] = over[chosen]
        before = chosen[chosen > 0] - 1
        once[before] = over[before]
        left = np.ones(len(symbols), bool)
        left[chosen + 1] = False
        symbols, starts, over, once = symbols[left], starts[left], over[left], once[left]
        next_symbol += len(named)
        if next_symbol > 1 << 31:
            raise ValueError("more than 2 ** 31 symbols in one batch")
    parts = [np.concatenate([part[i] for part in rules]) if rules else np.zeros(0, np.int64) for i in range(4)]
    return parts[0] - first_rule, parts[1], parts[2], parts[3], starts


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _halved(starts: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, boundary, end) of the nodes of balanced trees over the symbols left of each text.

    `starts` are the first words of all symbols, `bounds` the first words of the texts and the end of the last.
    """
    stop = np.append(starts, bounds[-1])
    low, high = np.searchsorted(starts, bounds[:-1]), np.searchsorted(starts, bounds[1:])
    found = []
    while True:
        more = high - low > 1
        low, high = low[more], high[more]
        if not len(low):
            break
        mid = (low + high) // 2
        found.append((stop[low], stop[mid], stop[high]))
        low, high = np.concatenate((low, mid)), np.concatenate((mid, high))
    return tuple(np.concatenate([one[i] for one in found]) if found else np.zeros(0, np.int64) for i in range(3))


def _across(text: Text, low: np.ndarray, mid: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """(number of the node, start, end, period) of the periodic stretches across `mid` within [low, high) that are long enough.

    They are maximal within the node, and periods are smallest.
    """
    most = (high - low) // LEAST_PERIODS
    most[high - low < LEAST_WORDS] = 0
    ends = np.cumsum(most)
    total, found, done = int(ends[-1]) if len(ends) else 0, [], 0
    while done < total:
        upto = min(total, done + STEP)
        trial = np.arange(done, upto)
        node = np.searchsorted(ends, trial, "right")
        q = trial - (ends[node] - most[node]) + 1
        done = upto
        m, lo, hi = mid[node], low[node], high[node]
        # Two periods side by side before the boundary, or behind it: one word decides most trials.
        words = text.words
        left, right = m - 2 * q >= lo, m + 2 * q <= hi
        left &= words[m - 1] == words[np.maximum(m - 1 - q, 0)]
        right &= words[m] == words[np.minimum(m + q, len(words) - 1)]
        for way, start in ((left, -2), (right, 0)):
            some = np.flatnonzero(way)
            a = m[some] + start * q[some]
            some = some[text.equal(a, a + q[some], q[some])]
            if not len(some):
                continue
            a, period, which = m[some] + start * q[some], q[some], node[some]
            begin = a - text.reach(a, a + period, a - low[which], True)
            end = a + 2 * period + text.reach(a + period, a + 2 * period, high[which] - a - 2 * period, False)
            good = (end - begin >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)) & (begin < mid[which]) & (end > mid[which])
            found.append(np.stack((which, begin, end, period))[:, good])
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    all_ = np.concatenate(found, axis=1)
    all_ = all_[:, np.lexsort((all_[3], all_[2], all_[1], all_[0]))]
    first = np.append(True, (all_[:3, 1:] != all_[:3, :-1]).any(axis=0))[: all_.shape[1]]
    return tuple(all_[:, first])


def runs_of(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All runs of the texts words[bounds[i]:bounds[i + 1]]: (number of the text, start within it, length, period), by text, start, period."""
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    text = Text(words)
    rule, low, mid, high, rest = repair(words, owner)
    # Each nonterminal is looked at where it was made first.
    _, site = np.unique(rule, return_index=True)
    which, begin, end, period = _across(text, low[site], mid[site], high[site])
    # Its other places have the same runs: sites of a rule stand together in `sorted_sites`.
    order = np.argsort(rule, kind="stable")
    own = rule[site[which]]
    count_of = np.bincount(rule)[own]
    again = np.repeat(np.arange(len(which)), count_of)
    step = np.arange(len(again)) - np.repeat(np.cumsum(count_of) - count_of, count_of)
    moved = low[order[np.searchsorted(rule[order], own)[again] + step]] - low[site[which[again]]]
    top = _across(text, *_halved(rest, bounds))
    begin, end = np.concatenate((begin[again] + moved, top[1])), np.concatenate((end[again] + moved, top[2]))
    period = np.concatenate((period[again], top[3]))
    # Intervals of one period that touch in a whole period are parts of one run, which was found whole at the smallest node around it.
    order = np.lexsort((-end, begin, period))
    begin, end, period = begin[order], end[order], period[order]
    doc = np.searchsorted(bounds, begin, "right") - 1
    keep = np.ones(len(begin), bool)
    if len(begin):
        group = np.cumsum(np.append(True, period[1:] != period[:-1])) * (len(words) + 1)
        furthest = np.maximum.accumulate(end + group)
        keep[1:] = end[1:] + group[1:] > np.maximum(furthest[:-1], group[1:])
    begin, end, period, doc = begin[keep], end[keep], period[keep], doc[keep]
    order = np.lexsort((period, begin, doc))
    begin, end, period, doc = begin[order], end[order], period[order], doc[order]
    return doc, begin - bounds[doc], end - begin, period


def split_words(text: str | None) -> list[bytes]:
    """The words between blanks of ASCII, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", rebuild=None) -> DataFrame:
    """(`key`, `runs`, `collapsed`) for each row: its runs (array of start, length, period; words from 0, by start and period), and the
    text whose words are joined by one blank and of whose runs only the first period is left.

    Words stand between ASCII blanks.  A run is a stretch of at least LEAST_WORDS words and LEAST_PERIODS times its smallest period that cannot be
    extended.  NULL, empty and blank texts have no runs and an empty `collapsed`.  Repeated rows each have a row; a NULL key is
    kept.  Other columns are not read.  `rebuild(key, n)`, if given, returns for each place of a text of n words the place its word is taken from (or None).
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = "_key " + kind + ", runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text", 2_000_000):
                keys = part.column("_key")
                parted = [split_words(one) for one in part.column("_text").to_pylist()]
                if rebuild is not None:
                    for i, one in enumerate(keys.to_pylist()):
                        places = rebuild(one, len(parted[i]))
                        if places is not None:
                            words = parted[i]
                            parted[i] = [words[j] for j in places.tolist()]
                bounds = np.concatenate(([0], np.cumsum([len(words) for words in parted]))).astype(np.int64)
                known: dict[bytes, int] = {}
                ids = np.fromiter((known.setdefault(word, len(known)) for words in parted for word in words), np.int64, int(bounds[-1]))
                doc, start, length, period = runs_of(ids, bounds)
                first = np.searchsorted(doc, np.arange(len(parted) + 1))
                collapsed = []
                for i, words in enumerate(parted):
                    a, b = first[i], first[i + 1]
                    if a < b:
                        change = np.zeros(len(words) + 1, np.int64)
                        np.add.at(change, start[a:b] + period[a:b], 1)
                        np.add.at(change, start[a:b] + length[a:b], -1)
                        words = list(compress(words, (np.cumsum(change[:-1]) == 0).tolist()))
                    collapsed.append(b" ".join(words).decode("utf-8", "surrogatepass"))
                structs = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (start, length, period)], ["start", "length", "period"])
                listed = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), structs).cast(run_type)
                yield pa.RecordBatch.from_arrays([keys, listed, pa.array(collapsed, pa.string())], names=["_key", "runs", "collapsed"])

    return docs.selectExpr(f"`{key}` AS _key", f"`{text}` AS _text").mapInArrow(run, schema).withColumnRenamed("_key", key)


def made_periodic(key: int | None, n: int) -> np.ndarray | None:
    """For a tenth of the keys: from some word on, the text repeats a stretch of itself."""
    if key is None or n == 0:
        return None
    h = zlib.crc32(str(key).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(read(spark, sf_dir, "documents"), rebuild=made_periodic)
    # The greatest exact quotient: length1 * period2 > length2 * period1, else the earlier in the order of `runs`.
    best = F.reduce(
        "runs", F.try_element_at("runs", F.lit(1)),
        lambda a, b: F.when(b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a),
    )
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    chosen = found.withColumn("best", best)
    return chosen.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
