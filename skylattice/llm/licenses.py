"""License notices in whole texts: fixed phrases, and short notices with a bounded number of edits.

A notice that may have k edits is cut in k + 1 parts.  By the pigeonhole principle at least one part stands unchanged in every
match, so an automaton over all parts finds every place where a match can be.  Only there the bounded-error matching of the regex
library verifies the edits and gives the span.
"""

from __future__ import annotations

import functools
import re

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from skylattice.llm.common import map_texts, read

#: Fixed phrases and their labels.
PHRASES = [(("mit", "license"), "mit"), (("apache", "license"), "apache"), (("general", "public", "license"), "gpl")]
#: Labels and short notices, in small letters.  One edit is allowed for every TOLERANCE characters.
NOTICES = [
    ("agpl", "gnu affero general public license"),
    ("apache", "licensed under the apache license, version 2.0"),
    ("bsd", "redistribution and use in source and binary forms"),
    ("cc", "creative commons attribution"),
    ("cc", "licensed under cc by"),
    ("gpl", "licensed under the gnu general public license"),
    ("gpl", "this program is free software: you can redistribute it and/or modify"),
    ("isc", "permission to use, copy, modify, and/or distribute this software"),
    ("lgpl", "gnu lesser general public license"),
    ("mit", "permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("mit", "released under the mit license"),
    ("mpl", "subject to the terms of the mozilla public license"),
    ("proprietary", "all rights reserved"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
TOLERANCE = 10

_WORD = "0-9a-z\x80-\xff"
_BASE = [
    (re.compile(rf"(?<![{_WORD}]){rf'[^{_WORD}]+'.join(words)}(?![{_WORD}])".encode("latin-1")), label) for words, label in PHRASES
]
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(128, 256)]] = True
#: Small letters, and a blank for every white character: both keep the length.
_PLAIN = bytes(32 if 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))


@functools.cache
def _machinery() -> tuple[ahocorasick.Automaton, list]:
    """(automaton of all parts, its values being (notice, place in it); label, length, edits, pattern of each notice)."""
    automaton, notices, parts = ahocorasick.Automaton(), [], {}
    for number, (label, notice) in enumerate(NOTICES):
        edits = len(notice) // TOLERANCE
        bounds = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
        for start, end in zip(bounds, bounds[1:]):
            parts.setdefault(notice[start:end], []).append((number, start))
        notices.append((label, len(notice), edits, regex.compile(f"(?b)(?:{regex.escape(notice)}){{e<={edits}}}")))
    for part, places in parts.items():
        automaton.add_word(part, (len(part), places))
    automaton.make_automaton()
    return automaton, notices


def fuzzy_spans(plain: str) -> list[tuple[int, int, str, int, float]]:
    """(start, end, label, edits, likeness) of the notices in a text of one byte per character, by start."""
    automaton, notices = _machinery()
    diagonals: dict[int, list[int]] = {}
    for last, (length, places) in automaton.iter(plain):
        for number, start in places:
            diagonals.setdefault(number, []).append(last + 1 - length - start)
    spans = set()
    for number, begins in diagonals.items():
        label, length, edits, pattern = notices[number]
        begins.sort()
        done = 0
        for i, begin in enumerate(begins):
            # Parts of one match lie within `edits` of each other, so a cluster ends at a wider step.
            if i + 1 < len(begins) and begins[i + 1] - begin <= edits and begins[i + 1] - begins[done] <= 2 * edits:
                continue
            left = max(0, begins[done] - edits)
            hit = pattern.search(plain, left, max(0, begin) + length + edits)
            if hit:
                wrong = sum(hit.fuzzy_counts)
                spans.add((hit.start(), hit.end(), label, wrong, 1 - wrong / length))
            done = i + 1
    return sorted(spans)


def find(texts: list[str | None]) -> list[list]:
    """Columns n_words, n_base, first_word, last_word, base_labels, labels, score and spans (code points) of whole texts."""
    rows = []
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        plain = raw.translate(_PLAIN)
        flags = np.concatenate(([False], _IS_WORD[np.frombuffer(plain, np.uint8)]))
        starts = np.flatnonzero(flags[1:] & ~flags[:-1])
        places, base = [], set()
        if b"license" in plain:
            for pattern, label in _BASE:
                hits = [hit.start() for hit in pattern.finditer(plain)]
                places += hits
                base |= {label} if hits else set()
        words = np.searchsorted(starts, places)
        spans = fuzzy_spans(plain.decode("latin-1"))
        best = max((span[4] for span in spans), default=0.0)
        if spans and len(raw) != len(text):
            points = np.concatenate(([0], np.cumsum(np.frombuffer(raw, np.uint8) & 0xC0 != 0x80)))
            spans = [(int(points[s]), int(points[e]), *more) for s, e, *more in spans]
        rows.append((
            len(starts), len(places), int(words.min()) if places else None, int(words.max()) if places else None,
            ",".join(sorted(base)), ",".join(sorted(base | {span[2] for span in spans})), 1.0 if base else round(best, 6),
            ",".join(f"{label}:{start}:{end}:{edits}" for start, end, label, edits, _ in spans),
        ))
    return [list(column) for column in zip(*rows)]


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, n_base, first_word, last_word, base_labels, labels, score and spans; the text column is left out.

    `spans` lists label:start:end:edits of the verified notices.  `score` is 1 with a fixed phrase, else the largest likeness of a notice, else 0.
    A NULL text counts as empty: no words, no labels, score 0.  Repeated rows stay repeated.  Columns that already have one of these
    names are replaced.
    """
    kinds = {
        "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string",
        "labels": "string", "score": "double", "spans": "string",
    }
    return map_texts(docs.drop(*kinds), "; ".join(f"{name} {kind}" for name, kind in kinds.items()), find, text)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
