import functools
import time
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from skylattice.llm import packing
from tests.llm.conftest import SCHEMA, rows


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def whole(found, texts, tokenizer, window):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for row in found:
        pieces[row.doc_id].append(row)
        sequences[row.sequence_id].append(row)
    for doc_id, text in texts.items():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        done = 0
        for row in sorted(pieces[doc_id], key=lambda row: row.start):
            assert row.start == done and row.doc_tokens == len(ids)
            part = ids[row.start : row.start + row.length]
            assert row.ids == part and row.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
            done += row.length
        assert done == len(ids)
    padding = 0
    for parts in sequences.values():
        parts.sort(key=lambda row: row.offset)
        assert [row.offset for row in parts] == [sum(p.length for p in parts[:i]) for i in range(len(parts))]
        total = sum(row.length for row in parts)
        assert 0 < total <= window
        padding += 0 if total & (total - 1) == 0 else window - total
    return padding


def test_round_trip(spark, prose, tokenizer):
    texts = [prose(i, 3 + i * 17 % 400) for i in range(120)] + ["don't <|endoftext|> it's. A.b, c..", "Ä́ ﬁ́ ..., x", None, ""]
    docs = spark.createDataFrame(rows(texts), SCHEMA).repartition(2)
    found = packing.pack(docs, window=512, with_ids=True).collect()
    assert whole(found, dict(enumerate(texts)), tokenizer, 512) == 0


def test_level_is_the_one_with_the_smallest_sum_of_squares():
    packer = packing.Packer(window=40)
    rng = np.random.default_rng(2)
    for _ in range(300):
        size = int(rng.integers(1, 40))
        fill = packer.best(size)

        def cost(f):
            level = packer.level.copy()
            if f:
                level[f] -= 1
            if f + size < 40:
                level[f + size] += 1
            return int((level[1:40] ** 2).sum())

        choices = [0] + [f for f in range(1, 41 - size) if packer.level[f]]
        assert cost(fill) == min(map(cost, choices))
        packer.add(packing.Piece(0, 0, b"\0" * 4 * size, size))


def test_edges(spark, edges, nothing, tokenizer):
    rows_ = {row.doc_id: row.text for row in edges.collect()}
    found = packing.pack(edges.dropDuplicates(["doc_id"]), with_ids=True).collect()
    assert whole(found, rows_, tokenizer, 4096) == 0
    assert packing.pack(edges).groupBy("doc_id").sum("length").count() == len(rows_)
    assert packing.pack(nothing).count() == 0


def test_marks_behind_every_character(tokenizer):
    encoder = packing._encoder(None)
    assert encoder.by_words
    points = [point for point in range(1, 0x30000) if not 0xD800 <= point < 0xE000]
    for mark in (".", ",%%"):
        texts = [f"ab{chr(point)}{mark} x" for point in points]
        expected = [found.ids for found in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        assert [np.frombuffer(ids, "<u4").tolist() for ids in encoder.encode(texts)] == expected


def test_words_are_forgotten_in_generations(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "MOST_BYTES", 3000)
    encoder = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    for i in range(60):
        texts = [f"Word{i}. other{i % 5}, {'long' * 40}... x", None, ""]
        assert [np.frombuffer(ids, "<u4").tolist() for ids in encoder.encode(texts)] == [tokenizer.encode(text or "", add_special_tokens=False).ids for text in texts]
        assert len(encoder._young) < 30 and len(encoder._old) < 30 and not any(len(word) > 64 for word in encoder._young)


def test_a_file_with_other_rules_encodes_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, other = packing.Encoder(path), Tokenizer.from_file(path)
    texts = ["A  B\nc, d.", "", "x"]
    assert not encoder.by_words
    assert [np.frombuffer(ids, "<u4").tolist() for ids in encoder.encode(texts)] == [other.encode(text).ids for text in texts]


def test_every_placement_of_a_whole_table_has_the_least_sum_of_squares():
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").combine_chunks()
    packer, most_open = packing.Packer(), 0
    for ids in packing._encoder(None).encode(texts):
        size = (len(ids) // 4 + 1) % 4096
        if size:
            level = packer.level.copy()
            changes = {0: 2 * level[size] + 1}
            for fill in np.flatnonzero(level[: 4097 - size]).tolist():
                if fill:
                    changes[fill] = -2 * level[fill] + 1 + (2 * level[fill + size] + 1 if fill + size < 4096 else 0)
            assert changes[packer.best(size)] == min(changes.values())
            packer.add(packing.Piece(0, 0, b"\0" * 4 * size, size))
        most_open = max(most_open, int(packer.level.sum()))
    assert packer.level.max() <= 4 and most_open < 1000


def test_words_are_kept_from_task_to_task_and_given_back(monkeypatch):
    monkeypatch.setattr(packing, "KEPT_SECONDS", 0.3)
    monkeypatch.setattr(packing, "_encoder", functools.cache(lambda path: object()))
    packing._stay()
    first = packing._encoder(None)
    packing._leave()
    packing._stay()
    time.sleep(0.6)
    assert packing._encoder(None) is first
    packing._leave()
    time.sleep(0.6)
    assert packing._encoder.cache_info().currsize == 0


def test_a_second_task_of_a_worker_finds_the_encoder(spark, prose):
    docs = spark.createDataFrame(rows([prose(i, 20) for i in range(40)]), SCHEMA).repartition(8)
    packing.pack(docs).count()
    made = docs.coalesce(1).mapInPandas(lambda parts: [pd.DataFrame({"n": [packing._encoder.cache_info().currsize]}) for _ in parts][:1], "n long")
    packing.pack(docs.coalesce(1)).count()
    assert made.collect()[0].n == 1


def test_new_words_are_encoded_many_in_one_text(tokenizer, monkeypatch):
    encoder, taken = packing.Encoder(public_tokenizers.path("word_bpe_49k.json")), []
    plain = encoder._encode
    monkeypatch.setattr(encoder, "_encode", lambda texts: taken.extend(texts) or plain(texts))
    words = [f"{a}{b}{c}" for a in "abcdef" for b in "éou" for c in "nrst"]
    texts = [" ".join(words), " ".join(word.upper() + ",." for word in words if word.isascii()), "a0b 10,00 0 <|endoftext|>. x<|endoftext|>0\t1 J̌. ́x ... 'll"]
    for _ in range(2):
        assert [np.frombuffer(ids, "<u4").tolist() for ids in encoder.encode(texts)] == [tokenizer.encode(text, add_special_tokens=False).ids for text in texts]
    assert len(taken) < len(words) / 4
