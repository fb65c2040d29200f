import random
import re

import numpy as np
from pyspark.sql import functions as F

from skylattice.llm import jaccard
from skylattice.llm.components import components
from tests.llm.conftest import EDGES, SCHEMA, rows


def brute(texts):
    sets = {}
    for i, text in texts.items():
        small = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", small)
        sets[i] = {tuple(words[k : k + 4]) for k in range(len(words) - 3)} if len(words) >= 4 else {tuple(words)} if words else set()
    group = {i: i for i in sets}
    order = sorted(sets)
    changed = True
    links = [
        (a, b) for a in order for b in order if a < b and sets[a] and sets[b]
        and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    ]
    while changed:
        changed = False
        for a, b in links:
            least = min(group[a], group[b])
            changed |= group[a] != least or group[b] != least
            group[a] = group[b] = least
    return {i: (len(sets[i]), group[i]) for i in sets}, links


def test_every_link_is_found(spark, prose, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 8)
    draw = random.Random(11)
    texts = list(EDGES[:11]) + ["Word WORD word word", "a b", "A\tB", "a b c", "b a"]
    for family in range(6):
        words = prose(family, 60 + 40 * family).split()
        for _ in range(14):
            own = list(words)
            for _ in range(draw.randint(0, 4 + family)):
                own[draw.randrange(len(own))] = prose(draw.random(), 1)
            texts.append(" ".join(own[: len(own) - draw.randint(0, 6)]))
    passage = prose(500, 60)
    texts += [passage + " " + prose(600 + i, 6 + i % 4) for i in range(40)]
    texts += [prose(700 + i, 80) + " " + passage for i in range(20)]
    wanted, links = brute(dict(enumerate(texts)))
    assert len(links) > 100
    found = jaccard.join_groups(spark.createDataFrame(rows(texts), SCHEMA).repartition(4)).collect()
    assert {row.doc_id: (row.n_shingles, row.component_id) for row in found} == wanted


def test_hashes_are_sets_of_shingles(prose):
    texts = [prose(1, 50), prose(1, 50).upper(), "  " + prose(1, 50).replace(" ", "\n\t") + " ", prose(2, 50), "a b a b a b a b", "é É"]
    sets = jaccard.shingle_sets(texts)
    assert (sets[0] == sets[1]).all() and (sets[0] == sets[2]).all() and not np.intersect1d(sets[0], sets[3]).size
    assert len(sets[4]) == 2 and len(sets[5]) == 1


def test_bitmaps_bound_from_above(prose):
    draw = random.Random(3)
    for _ in range(60):
        words = prose(draw.random(), draw.randint(4, 300)).split()
        own = [w if draw.random() > 0.03 else "new" for w in words]
        a, b = jaccard.shingle_sets([" ".join(words), " ".join(own)])
        x, y = (np.frombuffer(jaccard.signature(one), np.uint64) for one in (a, b))
        shared = len(np.intersect1d(a, b))
        only_a, only_b = (np.bitwise_count(p & ~q).sum(dtype=np.int64) for p, q in ((x, y), (y, x)))
        assert min(len(a) - only_a, len(b) - only_b) >= shared
        if 100 * shared >= 85 * (len(a) + len(b) - shared):
            assert jaccard._may_link(len(a), len(b), only_a, only_b)


def test_components(spark):
    draw = random.Random(9)
    links = [(i, i + 1) for i in range(0, 60)] + [(100 + draw.randrange(40), 100 + draw.randrange(40)) for _ in range(30)] + [(7, 7)]
    group = {i: i for pair in links for i in pair}
    for _ in range(100):
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    alone = {i for i in group if all(a == b for a, b in links if i in (a, b))}
    found = {row.node: row.component for row in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == {i: g for i, g in group.items() if i not in alone}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_edges(edges, nothing):
    found = jaccard.join_groups(edges).collect()
    assert len(found) == edges.count()
    by = {row.doc_id: row for row in found}
    assert [by[i].n_shingles for i in range(4)] == [0, 0, 0, 1] and by[10].component_id == 9 and by[2].component_id == 2
    assert jaccard.join_groups(nothing).count() == 0


def test_rows_without_a_key_and_repeated_keys(spark, prose):
    one, two, three = prose(1, 40), prose(2, 40), prose(3, 40)
    data = [(5, one), (None, one + " more"), (None, two), (None, two + " more"), (None, two), (None, ""), (None, ""), (7, three), (7, one), (3, three), (9, None), (None, None)]
    docs = spark.createDataFrame([(i, text, k) for k, (i, text) in enumerate(data)], "doc_id bigint, text string, place int")
    found = jaccard.join_groups(docs.repartition(3)).collect()
    key = lambda row: tuple(-1 if x is None else x for x in row)
    wanted = [
        (5, 37, 5), (None, 38, 5), (None, 37, None), (None, 38, None), (None, 37, None), (None, 0, None), (None, 0, None), (7, 37, 3), (7, 37, 5), (3, 37, 3),
        (9, 0, 9), (None, 0, None),
    ]
    sizes = {text: len(one) for text, one in zip((t for _, t in data), jaccard.shingle_sets([t for _, t in data]))}
    assert sorted(map(key, found)) == sorted(key((i, sizes[text], group)) for (i, text), (_, _, group) in zip(data, wanted))
    # Near the ends of the 64 bits there is still room on one side.
    high = docs.withColumn("doc_id", F.col("doc_id") + ((1 << 63) - 10))
    shift = (1 << 63) - 10
    shifted = jaccard.join_groups(high).collect()
    assert sorted(key([x and i != 1 and x - shift or x for i, x in enumerate(row)]) for row in shifted) == sorted(map(key, found))
    kept = [sorted(row.place for row in jaccard.one_of_each_group(docs.repartition(n)).collect()) for n in (1, 4)]
    assert kept[0] == kept[1]
    # One of each group; of the group without a key any one text; all without words and key.
    assert {0, 9, 10, 5, 6, 11} <= set(kept[0]) and len(kept[0]) == 7 and set(kept[0]) - {0, 9, 10, 5, 6, 11} <= {2, 3, 4}


def test_many_equal_rows_are_one_document(spark, prose):
    words = prose(90, 60).split()
    other = words.copy()
    other[-1] = "changed"
    data = [(1, " ".join(words))] * 200 + [(2, " ".join(other))] * 200 + [(3, prose(91, 60))] + [(None, " ".join(words))] * 50
    docs = spark.createDataFrame(data, "doc_id bigint, text string").repartition(4)
    found = jaccard.join_groups(docs).collect()
    assert len(found) == len(data)
    assert {(row["doc_id"], row["component_id"]) for row in found} == {(1, 1), (2, 1), (None, 1), (3, 3)}
    assert sorted(row["doc_id"] for row in jaccard.one_of_each_group(docs, words=4, percent=85).collect()) == [1, 3]


def test_a_pair_leaves_the_first_tile_it_meets_in_alone(spark):
    a, b = (jaccard.shingle_sets([text])[0] for text in ("a b c d e f g h", "a b c d e f g x"))
    rows = [(key, 0, 0, -1, i, len(one), i, jaccard.signature(one), before) for key, before in ((5, []), (6, [5]), (7, [5, 6])) for i, one in ((1, a), (2, b))]
    members = spark.createDataFrame(rows, "key bigint, low int, high int, side int, _id bigint, n bigint, group bigint, bits binary, before array<bigint>")
    assert [tuple(row) for row in jaccard._tile_pairs(members, 50).collect()] == [(1, 2)]
    apart = members.where("key > 5")
    assert jaccard._tile_pairs(apart, 50).count() == 0
