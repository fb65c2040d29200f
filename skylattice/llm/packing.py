"""Sum-of-squares packing of tokenised documents into windows.

Documents arrive one after the other.  Full windows are cut off a long one; the rest is placed whole: among all fill levels that have an open window with room, and a
new window, the one is taken that makes the sum of the squared numbers of open windows per level smallest (ties: the fuller
window).  A level array holds those numbers.  The rule keeps few windows at a level, so a task has at most some windows for each of
the levels open, of four bytes a token.  At the end of a task the emptiest open windows fill up the fullest, and the last one is cut at powers of two, which need no
padding.  Every task packs what it reads, on its own: there is no shuffle.
"""

from __future__ import annotations

import functools
import json
import os
import threading
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from skylattice.llm.common import give_back, laid_out, read, slices

#: Bytes of words that a worker remembers in each of two generations, an entry being counted with its overhead; longer words are not remembered.
MOST_BYTES, ENTRY_BYTES, LONGEST = 56_000_000, 190, 64
#: New words are encoded so many in one text, parted by a digit, which is one id of its own under the rules below.
TOGETHER, DIGIT = 64, "0"
#: A worker that goes on with other stages keeps the vocabulary and the words for so many seconds.
KEPT_SECONDS = 5.0
#: The rules under which blanks and line breaks part words, and a mark behind a letter is on its own: those of word_bpe_49k.json.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Encoder:
    """Token ids of a text as little-endian 32-bit bytes.

    Under the rules above each word between blanks and line breaks is encoded on its own and remembered.  Words of ASCII in small letters, and
    marks behind a letter or digit, are encoded once for all words that have them.  With a file of other rules whole texts are encoded.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self._tokenizer.to_str())
        normalizer, parts = rules.get("normalizer") or {}, (rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.by_words = [one["type"] for one in normalizer.get("normalizers", [])] == NORMALIZERS and parts[0].get("pattern") == {"Regex": PATTERN}
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._used = 0
        self._parts_marks: dict[str, bool] = {}
        self._between = array("I", self._tokenizer.encode(DIGIT, add_special_tokens=False).ids)[0]

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", found.ids).tobytes() for found in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word.  Words without the separator's digit go as one text, since a call costs more than a word."""
        plain = [word for word in words if DIGIT not in word and "<|" not in word]
        found: dict[str, bytes] = {}
        for start in range(0, len(plain), TOGETHER * 256):
            groups = [plain[i : i + TOGETHER] for i in range(start, min(start + TOGETHER * 256, len(plain)), TOGETHER)]
            for group, ids in zip(groups, self._encode([f" {DIGIT} ".join(group) for group in groups])):
                at = np.flatnonzero(np.frombuffer(ids, "<u4") == self._between) * 4
                if len(at) == len(group) - 1:
                    found.update(zip(group, map(ids.__getitem__, map(slice, [0, *(at + 4).tolist()], [*at.tolist(), len(ids)]))))
        others = [word for word in words if word not in found]
        found.update(zip(others, self._encode(others)))
        return [found[word] for word in words]

    def _recalled(self, words: set[str]) -> set[str]:
        """The words that are not remembered; those of the older generation are carried to the younger."""
        new = words.difference(self._young)
        again = {word: self._old[word] for word in new if word in self._old}
        self._add(again)
        return new.difference(again)

    def _add(self, ids: dict[str, bytes]) -> None:
        self._young.update(ids)
        self._used += len(ids) * ENTRY_BYTES + 2 * sum(map(len, ids)) + sum(map(len, ids.values()))

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        if not self.by_words:
            return self._encode([text or "" for text in texts.to_pylist()])
        parted = pc.split_pattern(pc.replace_substring(texts.fill_null(""), "\n", " "), " ")
        coded = parted.flatten().dictionary_encode()
        roots, marks, mark_of = self._parted_marks(coded.dictionary)
        root_of, roots = roots.indices.to_numpy(), roots.dictionary.to_numpy(zero_copy_only=False).tolist()
        parts = [*roots, *marks]
        missing = list(self._recalled(set(parts)))
        self._add(dict(zip(missing, self._encode_words(missing))))
        known = list(map(self._young.__getitem__, parts))
        for part in [part for part in missing if len(part) > LONGEST]:
            self._used -= ENTRY_BYTES + 2 * len(part) + len(self._young.pop(part))
        if self._used > MOST_BYTES:
            self._young, self._old, self._used = {}, self._young, 0
        # The ids of the different words, each a root's and its marks', then laid out in the order of the texts.
        flat, sizes = np.frombuffer(b"".join(known), "<u4"), np.fromiter(map(len, known), np.int64, len(known)) // 4
        flat, ends = laid_out(flat, sizes, np.stack((root_of, mark_of + len(roots)), axis=1).ravel())
        flat, ends = laid_out(flat, np.diff(ends[::2]), coded.indices.to_numpy())
        ids = flat.tobytes()
        bounds = (ends[np.concatenate(([0], np.cumsum(parted.value_lengths().to_numpy())))] * 4).tolist()
        return [ids[first:last] for first, last in zip(bounds, bounds[1:])]

    def _parted_marks(self, words: pa.Array) -> tuple[pa.DictionaryArray, list[str], np.ndarray]:
        """(words in small letters without final marks, the different marks, which of them each word has): a root's ids and its marks' in a row are the word's."""
        words = pc.if_else(pc.string_is_ascii(words), pc.ascii_lower(words), words)
        roots = pc.ascii_rtrim(words, punctuation)
        cut = pc.and_(pc.greater(pc.binary_length(roots), 0), pc.less(pc.binary_length(roots), pc.binary_length(words)))
        cut = pc.and_not(cut, pc.match_substring(words, "<|"))
        ends = pc.if_else(cut, pc.utf8_slice_codeunits(roots, -1), "").dictionary_encode()
        alone = pa.array([bool(one) and self._stands_alone(one) for one in ends.dictionary.to_pylist()], pa.bool_())
        cut = alone.take(ends.indices)
        places = np.flatnonzero(cut.to_numpy(zero_copy_only=False))
        sizes = pc.utf8_length(roots.take(pa.array(places))).to_pylist()
        marks: dict[str, int] = {"": 0}
        mark_of = np.zeros(len(words), np.int64)
        mark_of[places] = [marks.setdefault(word[size:], len(marks)) for word, size in zip(words.take(pa.array(places)).to_pylist(), sizes)]
        return pc.if_else(cut, roots, words).dictionary_encode(), list(marks), mark_of

    def _stands_alone(self, character: str) -> bool:
        """Whether a mark behind this character is no part of its word: the character may have become another by the rules."""
        known = self._parts_marks.get(character)
        if known is None:
            spelt = self._tokenizer.normalizer.normalize_str(character + ".")
            known = len(spelt) > 1 and self._tokenizer.pre_tokenizer.pre_tokenize_str(spelt)[-1][1] == (len(spelt) - 1, len(spelt))
            self._parts_marks[character] = known
        return known


@functools.cache
def _encoder(path: str | None) -> Encoder:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return Encoder(path)


_leaving: list[threading.Timer] = []


def _stay() -> None:
    """Keep the encoder: a task has begun."""
    while _leaving:
        _leaving.pop().cancel()


def _forget() -> None:
    _encoder.cache_clear()
    give_back()


def _leave() -> None:
    """Give the encoder back unless another task begins soon, which would learn the same words again."""
    _leaving.append(threading.Timer(KEPT_SECONDS, _forget))
    _leaving[-1].daemon = True
    _leaving[-1].start()


@dataclass
class Piece:
    row: object
    start: int
    ids: bytes
    tokens: int

    @property
    def size(self) -> int:
        return len(self.ids) // 4

    def cut(self, size: int) -> tuple[Piece, Piece]:
        return (
            Piece(self.row, self.start, self.ids[: 4 * size], self.tokens),
            Piece(self.row, self.start + size, self.ids[4 * size :], self.tokens),
        )


class Packer:
    """Packs pieces into windows; `add` and `finish` return the sequences that are complete."""

    def __init__(self, window: int = 4096):
        self.window = window
        self.level = np.zeros(window + 1, np.int64)
        self.windows: list[list[list[Piece]]] = [[] for _ in range(window + 1)]

    def _take(self, fill: int) -> list[Piece]:
        self.level[fill] -= 1
        return self.windows[fill].pop()

    def _put(self, fill: int, pieces: list[Piece]) -> None:
        self.level[fill] += 1
        self.windows[fill].append(pieces)

    def best(self, size: int) -> int:
        """Fill level to place `size` tokens at; 0 is a new window."""
        level, room = self.level, self.window - size
        grown = 2 * level[size : self.window + 1] + 1
        grown[room] = 0  # a full window is open no more
        change = grown - 2 * level[: room + 1] + 1
        change[level[: room + 1] == 0] = np.iinfo(np.int64).max
        change[0] = 2 * level[size] + 1
        return room - int(change[::-1].argmin())

    def add(self, piece: Piece) -> list[list[Piece]]:
        done = []
        while piece.size >= self.window:
            full, piece = piece.cut(self.window)
            done.append([full])
        if piece.size:
            fill = self.best(piece.size)
            pieces = self._take(fill) if fill else []
            pieces.append(piece)
            if fill + piece.size == self.window:
                done.append(pieces)
            else:
                self._put(fill + piece.size, pieces)
        return done

    def finish(self) -> list[list[Piece]]:
        left = [pieces for fill in range(self.window, 0, -1) for pieces in self.windows[fill]]
        done = []
        first, last = 0, len(left) - 1
        while first < last:
            room = self.window - sum(piece.size for piece in left[first])
            while room and last > first:
                piece = left[last].pop()
                if piece.size > room:
                    piece, rest = piece.cut(room)
                    left[last].append(rest)
                left[first].append(piece)
                room -= piece.size
                if not left[last]:
                    last -= 1
            if room:
                break
            done.append(left[first])
            first += 1
        rest = left[first] if first < len(left) else []
        total = sum(piece.size for piece in rest)
        for bit in range(total.bit_length() - 1, -1, -1):
            room, sequence = total & (1 << bit), []
            while room:
                piece = rest.pop(0)
                if piece.size > room:
                    piece, more = piece.cut(room)
                    rest.insert(0, more)
                sequence.append(piece)
                room -= piece.size
            if sequence:
                done.append(sequence)
        return done


def pack(
    docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 4096, end_id: int = 2, vocabulary: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """One row for each piece of a document: `key`, `start`, `length`, `ids_crc32`, `doc_tokens`, `sequence_id`, `offset`.

    `vocabulary` is the path of a tokeniser file that every executor can read (NULL: word_bpe_49k.json of the public ones).
    A NULL or empty text is the end id alone.  Repeated rows are documents of their own.  Other columns are not read.  With
    `with_ids` the ids come along as an array.
    """
    kind = docs.schema[key].dataType
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _stay()
        encoder, packer, number, key_type = _encoder(vocabulary), Packer(window), TaskContext.get().partitionId() << 40, None

        def written(sequences: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal number
            columns: list[list] = [[] for _ in range(8)]
            for sequence in sequences:
                offset = 0
                for piece in sequence:
                    row = (piece.row, piece.start, piece.size, zlib.crc32(piece.ids), piece.tokens, number, offset)
                    for column, value in zip(columns, row):
                        column.append(value)
                    columns[7].append(np.frombuffer(piece.ids, "<u4").astype(np.int32) if with_ids else None)
                    offset += piece.size
                number += 1
            types = [key_type] + [pa.int64()] * 6 + [pa.list_(pa.int32())] * with_ids
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types)], names=names)

        for batch in batches:
            for part in slices(batch, "_text", 1_000_000):
                key_type, done = part.schema.field(0).type, []
                for row, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1))):
                    ids += end
                    done += packer.add(Piece(row, 0, ids, len(ids) // 4))
                if done:
                    yield written(done)
        if key_type is not None:
            yield written(packer.finish())
        _leave()
        pa.default_memory_pool().release_unused()

    names = ["_key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    schema = f"_key {kind.simpleString()}, " + ", ".join(f"{name} bigint" for name in names[1:7]) + ", ids array<int>" * with_ids
    return docs.selectExpr(f"`{key}` AS _key", f"`{text}` AS _text").mapInArrow(run, schema).withColumnRenamed("_key", key)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
