"""The prefix trie against one that is built in Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from skylattice.llm import prefixes
from skylattice.llm.prefixes import numbered_turns, op12_prefixes, prefix_trie, rebuilt, trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth int, first string"


def by_hand(rows, rebuild=False):
    """All nodes of (conv, turn, role, text) rows."""
    convs = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            said = (role or "", text or "")
            digest = hashlib.md5(f"{len(said[0])}:{said[0]}{said[1]}".encode()).hexdigest()
            convs[conv].append((turn is not None, turn or 0, digest, said))
    turns = {conv: [said for *_, said in sorted(found)] for conv, found in convs.items()}
    if rebuild:
        heads = {conv: zlib.crc32(str(conv).encode()) % 6 for conv in turns}
        turns = {conv: turns.get(conv // 100 * 100, [])[: heads[conv]] + own[heads[conv] :] for conv, own in turns.items()}
    members = defaultdict(list)
    for conv, path in turns.items():
        for depth in range(len(path) + 1):
            members[tuple(path[:depth])].append(conv)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[child] for child in children[node]) or 1
        saved[node] = sum(saved[child] for child in children[node]) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
    return sorted((
        min(found), len(node), min(members[node[:-1]]) if node else None, len(found), len(children[node]), leaves[node], saved[node],
        hashlib.sha256(",".join(map(str, sorted(conv for conv in found if len(turns[conv]) == len(node)))).encode()).hexdigest(),
    ) for node, found in members.items())


def table(spark, rows):
    return spark.createDataFrame([(*row, 1, "x") for row in rows], SCHEMA).repartition(5)


def drawn(seed, convs, longest=9, words="abc"):
    draw = random.Random(seed)
    rows = [(conv, turn, draw.choice(["user", "bot", None]), draw.choice(words) * draw.randint(0, 2)) for conv in range(convs) for turn in range(draw.randint(1, longest))]
    draw.shuffle(rows)
    return rows


def compared(found, rows, rebuild=False):
    found = sorted(map(tuple, found.collect()), key=lambda row: tuple((x is not None, x) for x in row))
    assert found == sorted(by_hand(rows, rebuild), key=lambda row: tuple((x is not None, x) for x in row))


@pytest.mark.parametrize("seed", [1, 2])
def test_plain_conversations(spark, seed):
    rows = drawn(seed, 150)
    compared(trie(table(spark, rows)), rows)


def test_rebuilt_conversations(spark):
    rows = [row for row in drawn(3, 330, words="abcdefgh") if row[0] != 200]
    compared(prefix_trie(*rebuilt(numbered_turns(table(spark, rows)))), rows, rebuild=True)


def test_a_sketch_that_is_full_changes_nothing(spark, monkeypatch):
    rows = drawn(4, 80, words="abcdefghijkl")
    monkeypatch.setattr(prefixes, "LEAST_CELLS", 64)
    monkeypatch.setattr(prefixes, "MOST_CELLS", 64)
    compared(trie(table(spark, rows)), rows)


def test_copies_and_a_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "PIECE_IDS", 7)
    rows = [(conv, turn, "user", f"text {turn}") for conv in range(60) for turn in range(4)]
    rows += [(1000, turn, "user", f"text {turn}") for turn in range(900)] + [(1001, turn, "user", f"text {turn}") for turn in range(880)]
    compared(trie(table(spark, rows)), rows)


def test_nulls_ties_and_repeated_rows(spark):
    rows = [
        (1, None, None, None), (1, None, "a", "x"), (1, 0, "a", "y"), (1, 0, "a", "y"), (1, 0, "b", ""), (None, 0, "a", "lost"), (2, 5, None, ""), (2, 5, "a", "x"),
        (2, 9, "", None), (-3, 1, "a", "é😀"), (-3, 1, "a", "é😀"), (3, 1, "aé", "😀"), (4, 0, "b", "z" * 100_000), (5, 0, "b", "z" * 100_000),
    ]
    compared(trie(table(spark, rows)), rows)


def test_no_rows(spark):
    assert trie(table(spark, [(None, 1, "a", "b")]).where("turn > 1")).count() == 0


def test_turnless_conversations_are_members_of_the_root(spark, tmp_path):
    # Conversations whose own turns are all replaced, by turns of a conversation that is not there.
    rows = [(conv, 0, "user", f"hello {conv}") for conv in range(101, 140)]
    table(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    compared(op12_prefixes(spark, str(tmp_path)), rows, rebuild=True)
