import random
from fractions import Fraction

from pyspark.sql import functions as F

from skylattice.llm import mixing
from tests.llm.conftest import SCHEMA, rows


def highest(votes, seats):
    """Sainte-Laguë by the definition: one seat after the other."""
    given = {unit: 0 for unit in votes}
    for _ in range(seats):
        best = min((unit for unit in votes if votes[unit] > 0), key=lambda unit: (-Fraction(votes[unit], 2 * given[unit] + 1), unit))
        given[best] += 1
    return given


def test_apportionment_by_the_definition(spark):
    draw = random.Random(6)
    votes = {(g, u): draw.choice([0, 1, 7, 7, draw.randint(1, 900)]) for g in range(4) for u in range(g * 6 + 1)}
    votes[0, 0] = 5
    seats = {g: draw.randint(0, 120) for g in range(4)}
    units = spark.createDataFrame([(g, u, v, seats[g]) for (g, u), v in votes.items()], "g int, u int, v bigint, s int")
    found = {(row.g, row.u): row.given for row in mixing.apportion(units, "g", "u", "v", "s").collect()}
    for g in range(4):
        own = {u: v for (gg, u), v in votes.items() if gg == g}
        assert {u: found[g, u] for u in own} == highest(own, seats[g])


def test_targets_and_taken(spark, prose):
    sizes = {"a": 400, "b": 20, "c": 300, "d": 30, None: 50}
    texts, sources = [], []
    for source, n in sizes.items():
        for i in range(n):
            texts.append(prose(i * 31 + n, 1 + i % 50))
            sources.append(source)
    docs = spark.createDataFrame(rows(texts, sources=sources), SCHEMA)
    found = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, again), key=str)
    total = sum(row.size for row in found)
    by = {}
    for row in found:
        assert row.size == len(texts[row.doc_id].split()) and 0 <= row.taken <= 3 * row.size
        entry = by.setdefault(row.source, [row.source_size, row.target, 0, 0])
        entry[2] += row.taken
        entry[3] += row.size
    weights = dict(zip(["a", "b", "c", "d", None], [1, 2, 3, 1, 2]))
    level = min(entry[1] / weights[s] for s, entry in by.items() if entry[1] >= 3 * entry[0]) if any(e[1] >= 3 * e[0] for e in by.values()) else 0
    free = [s for s, entry in by.items() if entry[1] < 3 * entry[0]]
    assert len({round(by[s][1] / weights[s], 6) for s in free}) == 1 and level <= by[free[0]][1] / weights[free[0]] + 1e-6
    assert abs(sum(entry[1] for entry in by.values()) - total) < 1e-6
    for size, target, taken, summed in by.values():
        assert size == summed and abs(taken - target) <= max(2 * mixing.BLOCK, 0.01 * target)
    mixed = mixing.mixed(docs).collect()
    words = {}
    for row in mixed:
        assert texts[row.doc_id].startswith(row.text) and row.n_chars == len(row.text)
        words[row.doc_id] = words.get(row.doc_id, 0) + len(row.text.split())
    assert words == {row.doc_id: row.taken for row in found if row.taken}


def test_edges(edges, nothing):
    found = mixing.mix(edges).collect()
    assert len(found) == edges.count() and all(row.taken == 0 == row.size for row in found if row.doc_id < 3)
    assert mixing.mix(nothing).count() == 0
    assert mixing.mixed(edges).columns == edges.columns and mixing.mixed(nothing).count() == 0
    words = F.length("text")
    assert mixing.mixed(edges).where(words.isNull()).count() == 0


def test_rows_that_share_a_key_or_have_none(spark, prose):
    texts = [prose(i, 3 + i % 40) for i in range(300)]
    texts[7] = texts[8] = texts[9]
    ids = [None if i % 3 else i // 30 for i in range(300)]
    ids[7] = ids[8] = ids[9] = None
    data = [(ids[i], text, "en", "abc"[i % 7 % 3] if i not in (7, 8, 9) else "a", len(text)) for i, text in enumerate(texts)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    wanted, found = {}, {}
    for row in mixing.mix(docs).collect():
        wanted[row.source] = wanted.get(row.source, 0) + row.taken
    most = {}
    for row in mixing.mixed(docs.repartition(4)).collect():
        found[row.source] = found.get(row.source, 0) + len(row.text.split())
        most[row.doc_id, row.source, row.text] = most.get((row.doc_id, row.source, row.text), 0) + 1
    assert found == {source: taken for source, taken in wanted.items() if taken}
    whole = {(i, source, text) for i, text, _, source, _ in data}
    assert all(n <= mixing.EPOCHS * sum((i, source, text) == row for i, text, _, source, _ in data for row in [one]) for one, n in most.items() if one in whole)
