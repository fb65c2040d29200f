"""Encoding and decoding with the merge-type (BPE) vocabularies of the sentencepiece library.

The characters of a text are symbols at first.  An agenda holds every adjacent pair of symbols that makes a piece, ordered by
score and then by place; the first pair is merged, the pairs it makes with its neighbours join the agenda, and so on until it is
empty.  What is no piece then is spelt in byte pieces.  Two neighbouring characters that stand next to each other in no piece can never be
merged, so a text is parted at blanks, line breaks and such final marks, and parts are remembered.  The agendas of all new parts of a batch are worked
off side by side in arrays, a step of each at a time; a long part has a heap of its own.  In the same Arrow batch the result can be held against the library.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.llm.common import laid_out, read, slices

#: Bytes of parts that a worker remembers in each of two generations, an entry being counted with its overhead.
MOST_BYTES, ENTRY_BYTES, LONGEST = 128_000_000, 170, 64
_PLACE = (1 << 32) - 1
_NEVER = np.int64(1 << 40)


class PieceCoder:
    """Encoder and decoder of one model file of kind BPE; pieces, scores and kinds are read through the library."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        model, size = self.library, self.library.vocab_size()
        names = [model.id_to_piece(i) for i in range(size)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(size)]
        plain = [i for i in range(size) if not special[i]]
        self.ids = {names[i]: i for i in plain}
        steps = {score: rank for rank, score in enumerate(sorted({model.get_score(i) for i in plain}, reverse=True))}
        self.order = {names[i]: steps[model.get_score(i)] for i in plain}
        self.spelt = {int(names[i][3:-1], 16): i for i in range(size) if model.is_byte(i)}
        self.unknown, self.end = model.unk_id(), model.eos_id()
        self._check(names, plain)
        self.adjacent = {piece[i : i + 2] for piece in self.ids for i in range(len(piece) - 1)}
        self._character = np.full(0x110000, -1, np.int64)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self._character[ord(piece)] = i
        self._codes, self._ranks, self._made = self._pairs()
        values = [
            b"" if model.is_control(i) else " ⁇ ".encode() if model.is_unknown(i)
            else bytes([int(names[i][3:-1], 16)]) if model.is_byte(i) else names[i].replace("▁", " ").encode()
            for i in range(size)
        ]
        self._length = np.array([len(value) for value in values])
        self._start = np.concatenate(([0], np.cumsum(self._length)[:-1]))
        self._bytes = np.frombuffer(b"".join(values), np.uint8)
        self._blank = np.array([not special[i] and names[i].startswith("▁") for i in range(size)])
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._used = 0

    def _check(self, names: list[str], plain: list[int]) -> None:
        """What the rules below take for granted of a model."""
        model = self.library
        probe = " a  b▁\tc\nﬁ "
        if model.normalize(probe) != "▁" + probe.replace(" ", "▁") or model.normalize(""):
            raise ValueError("a model that keeps texts as they are and puts a blank before them is needed")
        if any(model.is_unused(i) for i in plain) or len(self.spelt) != 256 or any("\n" in names[i] for i in plain):
            raise ValueError("a model with all byte pieces, and without unused pieces and line breaks in pieces, is needed")
        if any("▁" in names[i].lstrip("▁") for i in plain):
            raise ValueError("a model whose pieces have blanks in front alone is needed")

    def merged(self, part: str) -> list[str]:
        """The symbols that are left of a part when no two neighbours make a piece."""
        order, symbols, count = self.order, list(part), len(part)
        agenda = []
        for i in range(count - 1):
            rank = order.get(symbols[i] + symbols[i + 1])
            if rank is not None:
                agenda.append(rank << 32 | i)
        if not agenda:
            return symbols
        heapify(agenda)
        after, before = list(range(1, count + 1)), list(range(-1, count - 1))
        while agenda:
            entry = heappop(agenda)
            left = entry & _PLACE
            right = after[left]
            if not symbols[left] or right >= count:
                continue
            pair = symbols[left] + symbols[right]
            if order.get(pair) != entry >> 32:
                continue  # one of the two has been merged with another meanwhile
            symbols[left], symbols[right] = pair, ""
            behind = after[left] = after[right]
            if behind < count:
                before[behind] = left
                rank = order.get(pair + symbols[behind])
                if rank is not None:
                    heappush(agenda, rank << 32 | left)
            ahead = before[left]
            if ahead >= 0:
                rank = order.get(symbols[ahead] + pair)
                if rank is not None:
                    heappush(agenda, rank << 32 | ahead)
        return [symbol for symbol in symbols if symbol]

    def _pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted codes of the pairs of ids that make a piece, with its rank and its id."""
        rows = sorted(
            (self.ids[piece[:i]] << 32 | self.ids[piece[i:]], self.order[piece], whole)
            for piece, whole in self.ids.items() for i in range(1, len(piece)) if piece[:i] in self.ids and piece[i:] in self.ids
        )
        return tuple(np.array(column, np.int64) for column in zip(*[*rows, (1 << 62, int(_NEVER), -1)]))

    def _agenda(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of what pairs of ids make; _NEVER where they make none."""
        code = left << 32 | right
        place = np.searchsorted(self._codes, code)
        made = (self._codes[place] == code) & (left >= 0) & (right >= 0)
        return np.where(made, self._ranks[place], _NEVER), self._made[place]

    def _side_by_side(self, parts: list[str]) -> list[bytes]:
        """The ids of each part: a round takes the first pair of every agenda."""
        point = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32).astype(np.int64)
        owner = np.repeat(np.arange(len(parts)), [len(part) for part in parts])
        symbol = self._character[point]
        done: list[tuple[np.ndarray, ...]] = []
        rank, made = self._agenda(symbol[:-1], symbol[1:])
        rank, made = np.append(rank, _NEVER), np.append(made, -1)
        rank[:-1][owner[1:] != owner[:-1]] = _NEVER
        while len(symbol):
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            sizes = np.diff(np.append(starts, len(symbol)))
            # The smallest rank of a part, and of equal ones the first.
            first = np.minimum.reduceat(rank << 22 | np.arange(len(symbol)), starts)
            going = first >> 22 < _NEVER
            if not going.all():
                over = np.repeat(~going, sizes)
                done.append((owner[over], symbol[over], point[over]))
                owner, symbol, point, rank, made = (x[~over] for x in (owner, symbol, point, rank, made))
                if not len(symbol):
                    break
                shift = np.cumsum(over)
                at = first[going] & ((1 << 22) - 1)
                at -= shift[at]
            else:
                at = first & ((1 << 22) - 1)
            symbol[at] = made[at]
            left = np.ones(len(symbol), bool)
            left[at + 1] = False
            at = at - np.arange(len(at))  # one symbol goes from every part
            owner, symbol, point, rank, made = (x[left] for x in (owner, symbol, point, rank, made))
            for place in (at - 1, at):
                inside = (place >= 0) & (place + 1 < len(symbol))
                inside[inside] = owner[place[inside]] == owner[place[inside] + 1]
                rank[place[~inside & (place >= 0)]] = _NEVER
                place = place[inside]
                rank[place], made[place] = self._agenda(symbol[place], symbol[place + 1])
        owner, symbol, point = (np.concatenate([one[i] for one in done]) for i in range(3))
        order = np.argsort(owner, kind="stable")
        owner, symbol, point = owner[order], symbol[order], point[order]
        times = np.ones(len(symbol), np.int64)
        strange = np.flatnonzero(symbol < 0)
        spelt = [[self.spelt[byte] for byte in chr(x).encode()] for x in point[strange].tolist()]
        times[strange] = [len(one) for one in spelt]
        ids = np.repeat(symbol, times)
        ids[np.repeat(symbol < 0, times)] = [i for one in spelt for i in one]
        ends = np.cumsum(np.bincount(owner, times, len(parts)).astype(np.int64)) * 4
        raw = ids.astype("<i4").tobytes()
        return [raw[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]

    def _with_heap(self, part: str) -> bytes:
        found: list[int] = []
        for symbol in self.merged(part):
            one = self.ids.get(symbol)
            if one is not None:
                found.append(one)
            else:
                found.extend(self.spelt[byte] for byte in symbol.encode())
        return np.array(found, "<i4").tobytes()

    def _keep(self, part: str, ids: bytes) -> None:
        if len(part) <= LONGEST:
            self._young[part] = ids
            self._used += ENTRY_BYTES + 2 * len(part) + len(ids)
            if self._used > MOST_BYTES:
                self._young, self._old, self._used = {}, self._young, 0

    def _ids(self, parts: set[str]) -> dict[str, bytes]:
        found: dict[str, bytes] = {}
        new = []
        for part in parts:
            ids = self._young.get(part)
            if ids is None:
                ids = self._old.get(part)
                if ids is None:
                    new.append(part)
                    continue
                self._keep(part, ids)
            found[part] = ids
        made: dict[str, bytes] = {}
        short = [part for part in new if len(part) <= LONGEST]
        for i in range(0, len(short), 1 << 15):
            some = short[i : i + (1 << 15)]
            made.update(zip(some, self._side_by_side(some)))
        made.update((part, self._with_heap(part)) for part in new if len(part) > LONGEST)
        for part, ids in made.items():
            self._keep(part, ids)
        found.update(made)
        return found

    def _parted(self, texts: pa.Array) -> tuple[pa.StringArray, np.ndarray]:
        """(the parts of all texts, the first of each text and the end): a part is a line break, or blanks with what follows them up to the next."""
        spaced = pc.replace_substring(texts.fill_null(""), " ", "▁")
        spaced = pc.if_else(pc.equal(spaced, ""), "", pc.binary_join_element_wise("▁", spaced, ""))
        bounds = np.frombuffer(spaced.buffers()[1], np.int32)[spaced.offset : spaced.offset + len(spaced) + 1]
        raw = spaced.buffers()[2] if bounds[-1] else pa.py_buffer(b"")
        points = np.frombuffer(raw, np.uint8)[: bounds[-1]]
        blank = np.zeros(len(points), bool)
        blank[:-2] = (points[:-2] == 0xE2) & (points[1:-1] == 0x96) & (points[2:] == 0x81)
        first, line = blank.copy(), points == 10
        first[3:] &= ~blank[:-3]
        first |= line
        first[1:] |= line[:-1]
        first[: bounds[0]] = False
        first[bounds[:-1][np.diff(bounds) > 0]] = True
        starts = np.flatnonzero(first)
        return pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, bounds[-1]).astype(np.int32)), raw), np.searchsorted(starts, bounds)

    def encode(self, texts: pa.Array | list[str | None]) -> list[np.ndarray]:
        """The ids of each text with the end id last; None is an empty text."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        if not len(texts):
            return []
        parts, firsts = self._parted(texts)
        coded = parts.dictionary_encode()
        # Final marks that no piece joins to what is before them are on their own.
        words = coded.dictionary
        roots = pc.ascii_rtrim(words, punctuation)
        places = np.flatnonzero(pc.and_(pc.greater(pc.binary_length(roots), 0), pc.less(pc.binary_length(roots), pc.binary_length(words))).to_numpy(zero_copy_only=False))
        units = words.to_numpy(zero_copy_only=False).tolist()
        marks: dict[str, int] = {"": 0}
        mark_of = np.zeros(len(units), np.int64)
        for place, size in zip(places.tolist(), pc.utf8_length(roots.take(pa.array(places))).to_pylist()):
            part = units[place]
            if part[size - 1 : size + 1] not in self.adjacent:
                units[place] = part[:size]
                mark_of[place] = marks.setdefault(part[size:], len(marks))
        rooted = pa.array(units, pa.string()).dictionary_encode()
        units = [*rooted.dictionary.to_numpy(zero_copy_only=False).tolist(), *marks]
        known = {**self._ids(set(units) - {""}), "": b""}
        raw = [*map(known.__getitem__, units), np.array([self.end], "<i4").tobytes()]
        flat, sizes = np.frombuffer(b"".join(raw), "<i4"), np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        # Each part is a root and marks, and behind the parts of a text there is the end id.
        whole = np.append(np.stack((rooted.indices.to_numpy(), mark_of + len(rooted.dictionary)), axis=1).ravel(), (len(raw) - 1, len(rooted.dictionary)))
        flat, ends = laid_out(flat, sizes, whole)
        flat, ends = laid_out(flat, np.diff(ends[::2]), np.insert(coded.indices.to_numpy(), firsts[1:], len(words)))
        bounds = ends[firsts + np.arange(len(firsts))].tolist()
        return [flat[first:last] for first, last in zip(bounds, bounds[1:])]

    def decode(self, rows: list[np.ndarray]) -> list[str]:
        """The text of each row of ids; bytes that are no UTF-8 become U+FFFD each."""
        sizes = np.array([len(row) for row in rows], np.int64)
        ids = np.concatenate([*rows, np.zeros(0, np.int32)]).astype(np.int64)
        length = self._length[ids]
        stops = np.concatenate(([0], np.cumsum(length)))
        place = np.repeat(self._start[ids] - stops[:-1], length) + np.arange(stops[-1])
        raw = self._bytes[place].tobytes()
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        found = []
        for first, last in zip(bounds[:-1], bounds[1:]):
            own = raw[stops[first] : stops[last]]
            spoken = ids[first:last][length[first:last] > 0]
            if len(spoken) and self._blank[spoken[0]]:
                own = own[1:]
            try:
                found.append(own.decode())
            except UnicodeDecodeError:
                found.append(_with_marks(own))
        return found


def _with_marks(raw: bytes) -> str:
    found, place = [], 0
    while place < len(raw):
        for size in (1, 2, 3, 4):
            try:
                found.append(raw[place : place + size].decode())
                place += size
                break
            except UnicodeDecodeError:
                continue
        else:
            found.append("�")
            place += 1
    return "".join(found)


@functools.cache
def coder(path: str | None = None) -> PieceCoder:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return PieceCoder(path)


def encode(docs: DataFrame, text: str = "text", vocabulary: str | None = None, checked: bool = True) -> DataFrame:
    """Add `ids` (array<int>, the end id last) and `decoded` (the text made of them), and if `checked` the boolean `agrees`: that the
    sentencepiece library gives the same ids and the same decoded text.

    `text` is left out of the result, the other columns stay; one that is named like a new one raises ValueError.  `vocabulary` is the path of a model file that
    every executor can read (NULL: piece_bpe_32k.model of the public ones).  A NULL or empty text has the end id alone and is decoded to an empty
    text.  Whole texts are encoded, repeated rows each on their own.
    """
    names = [name for name in docs.columns if name != text]
    added = ["ids", "decoded"] + ["agrees"] * checked
    if clash := set(names) & set(added):
        raise ValueError(f"columns named like results: {sorted(clash)}")
    fields = [f"`{name}` {docs.schema[name].dataType.simpleString()}" for name in names]
    fields += ["ids array<int>", "decoded string"] + ["agrees boolean"] * checked

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(vocabulary)
        for batch in batches:
            for part in slices(batch, text, 1_000_000):
                texts = [one or "" for one in part.column(text).to_pylist()]
                ids = own.encode(part.column(text))
                decoded = own.decode(ids)
                offsets = np.concatenate(([0], np.cumsum([len(one) for one in ids]))).astype(np.int32)
                columns = [part.column(name) for name in names]
                columns += [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]))), pa.array(decoded, pa.string())]
                if checked:
                    theirs = own.library.encode(texts, add_eos=True, num_threads=1, out_type="numpy")
                    again = own.library.decode(theirs, num_threads=1)
                    columns.append(pa.array([
                        np.array_equal(a, b) and x == y for a, b, x, y in zip(ids, theirs, decoded, again)
                    ], pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, names=names + added)

    return docs.select(*names, text).mapInArrow(run, ", ".join(fields))


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), "agrees",
    )
