"""Runs found by the grammar against a search over all periods."""

import hashlib
import random
import re
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from skylattice.llm.common import read
from skylattice.llm.runs import find_runs, made_periodic, op13_runs, repair, runs_of

from .conftest import EDGES


def brute(words):
    """(start, length, period) of all runs, by start and period."""
    found, n = [], len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            part = words[i : j + q]
            if len(part) >= max(6, 4 * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                found.append((i, len(part), q))
            i = j
    return sorted(found, key=lambda run: (run[0], run[2]))


def by_grammar(texts):
    bounds = np.concatenate(([0], np.cumsum([len(text) for text in texts]))).astype(np.int64)
    found = [[] for _ in texts]
    for doc, *run in zip(*(x.tolist() for x in runs_of(np.array([word for text in texts for word in text], np.int64), bounds))):
        found[doc].append(tuple(run))
    return found


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=4))
def test_small_alphabets(texts):
    assert by_grammar(texts) == [brute(text) for text in texts]


def test_planted_runs():
    draw = random.Random(11)
    for _ in range(60):
        texts = []
        for _ in range(draw.randint(1, 5)):
            text = [draw.randrange(draw.choice([2, 5, 300])) for _ in range(draw.choice([0, 5, 6, 40, 200]))]
            for _ in range(3):
                if len(text) > 4:
                    a = draw.randrange(len(text))
                    p, size = 1 + draw.randrange(max(1, (len(text) - a) // 4)), draw.randint(1, len(text) - a)
                    for i in range(a, a + size):
                        text[i] = text[a + (i - a) % p]
            texts.append(text)
        texts.append(texts[0])
        assert by_grammar(texts) == [brute(text) for text in texts]


def test_known_strings():
    fibonacci, other = [0, 1], [0]
    while len(fibonacci) < 300:
        fibonacci, other = fibonacci + other, fibonacci
    thue_morse = [bin(i).count("1") & 1 for i in range(4096)]
    texts = [fibonacci, thue_morse[:400], [7] * 5, [7] * 6, [7] * 5000, [1, 2] * 3, [1, 2] * 4, ([0] * 6 + [1]) * 5]
    found = by_grammar(texts)
    assert found[2:7] == [[], [(0, 6, 1)], [(0, 5000, 1)], [], [(0, 8, 2)]]
    for i in (0, 1, 7):
        assert found[i] == brute(texts[i])
    assert by_grammar([thue_morse * 5])[0] == [(0, 20480, 4096)]


def test_grammar_spells_the_texts_and_leaves_no_pair_twice():
    draw = random.Random(12)
    words = np.array([draw.randrange(6) for _ in range(3000)] + [5] * 70, np.int64)
    text = np.repeat([0, 1, 2], [1000, 1500, 570])
    rule, low, mid, high, rest = repair(words, text)
    spelt = {}
    for one, a, b, c in zip(rule, low, mid, high):
        assert a < b < c and text[a] == text[c - 1]
        assert spelt.setdefault(int(one), (words[a:b].tolist(), words[b:c].tolist())) == (words[a:b].tolist(), words[b:c].tolist())
    made = {(int(a), int(c)): -1 - int(one) for one, a, c in zip(rule, low, high)}
    symbols = [(made.get((int(a), int(b)), int(words[a])), int(text[a])) for a, b in zip(rest, [*rest[1:], len(words)])]
    pairs = [(a[0], b[0]) for a, b in zip(symbols, symbols[1:]) if a[1] == b[1]]
    twice = {pair for pair in pairs if pairs.count(pair) > 1}
    assert all(a == b for a, b in twice)  # a row of three equal symbols holds its pair twice, but overlapping


def answer(doc_id, text):
    words = re.findall("[^\x20\x09-\x0D]+", text or "")
    places = made_periodic(doc_id, len(words))
    words = words if places is None else [words[i] for i in places]
    runs = brute(words)
    dropped = {i for start, length, q in runs for i in range(start + q, start + length)}
    best = min(runs, key=lambda run: (-Fraction(run[1], run[2]), run[0], run[2]), default=(None,) * 3)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{a},{b},{c}\n" for a, b, c in runs), " ".join(w for i, w in enumerate(words) if i not in dropped))]
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, *sha)


def test_query_against_all_periods(spark, tmp_path):
    docs = read(spark, "/root/testdata/sf0.001", "documents").selectExpr("doc_id", "substring(text, 1, 1500) AS text")
    more = [(1000 + i, text if len(text or "") < 20_000 else text[:9000]) for i, text in enumerate(EDGES)]
    more += [(2000, "a b c " * 9 + "x" + " x" * 8), (2001, "á\xa0b\x1cc " * 7), (2001, "á\xa0b\x1cc " * 7), (None, "w " * 9)]
    table = docs.union(spark.createDataFrame(more, "doc_id bigint, text string"))
    table.write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted(map(tuple, op13_runs(spark, str(tmp_path)).collect()), key=repr)
    assert found == sorted((answer(*row) for row in table.collect()), key=repr)


def test_made_periodic():
    import zlib

    keys = [key for key in range(300) if zlib.crc32(str(key).encode()) % 10 == 0]
    assert keys and made_periodic(keys[0], 0) is None and made_periodic(None, 5) is None
    for key in range(300):
        places, g = made_periodic(key, 57), zlib.crc32(str(key).encode()) // 10
        assert (places is not None) == (key in keys)
        if places is not None:
            a = g % 57
            p = 1 + (57 - a) // (3 + g % 8)
            assert places.tolist() == [i if i < a else a + (i - a) % p for i in range(57)]


def test_table(spark, edges, nothing):
    found = {row["doc_id"]: row for row in find_runs(edges).collect()}
    assert find_runs(edges).count() == len(EDGES) + 2 and find_runs(nothing).count() == 0
    assert found[0]["runs"] == found[1]["runs"] == found[2]["runs"] == [] and found[0]["collapsed"] == found[2]["collapsed"] == ""
    assert [tuple(run) for run in found[11]["runs"]] == [(0, 60_000, 1)] and found[11]["collapsed"] == "long"
    assert found[4]["collapsed"] == "Word word WORD word"
