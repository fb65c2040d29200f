"""Encoding against the sentencepiece library, decoding there and back."""

import random

import numpy as np
import pytest

from skylattice.llm.pieces import coder, encode

from .conftest import EDGES

HARD = [
    "  a  b ", "▁x", "x▁y z", "▁", " ", "a\tb\n", "ﬁ é", "<s> x </s>", "<0x0A>", "中文字符，测试。", "³²¹.", "foo_, bar_.", "\n\n  \n", "the the", "é", "🇩🇪👩‍👩‍👧", " " * 77,
    "a\rb;\r\n", "�", " x", "İ. x", "def f(x):\n    return x\n",
]


def test_equals_the_library():
    own = coder()
    texts = [text or "" for text in EDGES] + HARD
    draw = random.Random(7)
    alphabet = [chr(x) for x in [*range(32, 127), 9, 10, 13, 0xE9, 0x2581, 0x4E2D, 0x1F600, 0x301]]
    texts += ["".join(draw.choices(alphabet, k=draw.randint(0, 60))) for _ in range(3000)]
    ids = own.encode(texts)
    theirs = own.library.encode(texts, add_eos=True)
    assert [one.tolist() for one in ids] == theirs
    assert own.decode(ids) == own.library.decode(theirs) == [text.replace("▁", " ") for text in texts]


def test_agenda_takes_the_best_pair_first_and_the_left_one_of_equals():
    own = coder()
    draw = random.Random(8)
    for _ in range(300):
        part = "".join(draw.choices("theriandos▁", k=draw.randint(1, 25)))
        symbols = list(part)
        while True:  # every step looks at all pairs
            ranks = [own.order.get(a + b, 1 << 60) for a, b in zip(symbols, symbols[1:])]
            if not ranks or min(ranks) == 1 << 60:
                break
            i = ranks.index(min(ranks))
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        assert own.merged(part) == symbols


def test_broken_bytes_are_marked():
    own = coder()
    row = np.array([own.spelt[0xE2], own.spelt[0x82], *own.encode(["on"])[0]], np.int32)
    assert own.decode([row, row[:0]]) == [own.library.decode(row.tolist()), ""]


def test_remembered_parts_are_dropped_in_generations(monkeypatch):
    from skylattice.llm import pieces

    monkeypatch.setattr(pieces, "MOST_BYTES", 3000)
    own = pieces.PieceCoder(__import__("public_tokenizers").path("piece_bpe_32k.model"))
    texts = [f"word{i} other{i % 7}" for i in range(300)] * 2
    assert [one.tolist() for one in own.encode(texts)] == own.library.encode(texts, add_eos=True)
    assert len(own._young) < 20 and len(own._old) < 20


def test_table(spark, edges, nothing):
    found = encode(edges).orderBy("doc_id", "n_chars").collect()
    assert len(found) == len(EDGES) + 2 and all(row["agrees"] for row in found)
    by_id = {row["doc_id"]: row for row in found}
    for i, text in enumerate(EDGES):
        assert by_id[i]["decoded"] == (text or "") and by_id[i]["ids"][-1] == 2
        assert by_id[i]["extra"] == [1] and by_id[i]["rank"] == 1
    assert by_id[0]["ids"] == by_id[1]["ids"] == [2]
    assert encode(nothing).count() == 0
    assert encode(edges, checked=False).columns == [name for name in edges.columns if name != "text"] + ["ids", "decoded"]
    with pytest.raises(ValueError):
        encode(edges.withColumnRenamed("rank", "ids"))


def test_a_part_and_its_final_marks_are_remembered_apart():
    import pyarrow as pa

    own = __import__("skylattice.llm.pieces", fromlist=["PieceCoder"]).PieceCoder(__import__("public_tokenizers").path("piece_bpe_32k.model"))
    marked = [f"word{i}{mark}" for i in "abc" for mark in (".%%", ",%%", "")]
    texts = [" ".join(marked), None, "", "\n\n", "▁", *HARD, "\nfoo  bar\n baz\n▁▁"]
    theirs = own.library.encode([text or "" for text in texts], add_eos=True)
    assert [one.tolist() for one in own.encode(pa.array(["x", *texts, "y"]).slice(1, len(texts)))] == theirs
    assert "▁worda" in own._young and "▁worda.%%" not in own._young
    assert own.encode([]) == [] and [one.tolist() for one in own.encode([None])] == [[own.end]]
