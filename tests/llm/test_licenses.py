import re

from skylattice.llm import licenses
from tests.llm.conftest import EDGES, SCHEMA, rows


def base(text):
    small = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", small)
    places, labels = [], set()
    for phrase, label in licenses.PHRASES:
        for i in range(len(words)):
            if tuple(words[i : i + len(phrase)]) == phrase:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_by_words(spark):
    texts = EDGES + [
        "MIT - License, mit\nlicense", "commit license", "mit licenses", "éMIT license", "The GNU General Public License v2, general.public;license",
        "Apache  License apache License MIT license", "permit license mit é license",
    ]
    found = {row.doc_id: row for row in licenses.scan(spark.createDataFrame(rows(texts), SCHEMA)).collect()}
    for i, text in enumerate(texts):
        row = found[i]
        assert (row.n_words, row.n_base, row.first_word, row.last_word, row.base_labels) == base(text or "")
        assert set(filter(None, row.base_labels.split(","))) <= set(row.labels.split(",")) and 0 <= row.score <= 1


def distance(a, b):
    """Smallest edit distance of a to any part of b."""
    line = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, line[j] + 1, line[j - 1] + (x != y)))
        line = new
    return min(line)


def test_every_notice_with_few_edits_is_found():
    import random

    draw = random.Random(4)
    for label, notice in licenses.NOTICES:
        for _ in range(6):
            chars = list(notice)
            for _ in range(draw.randint(0, len(notice) // licenses.TOLERANCE)):
                place = draw.randrange(len(chars))
                chars[place : place + 1] = draw.choice([[], ["q"], [chars[place], "z"]])
            text = "some words before " + "".join(chars) + " and after it all"
            if distance(notice, text) <= len(notice) // licenses.TOLERANCE:
                assert label in {span[2] for span in licenses.fuzzy_spans(text)}, text


def test_spans_are_code_points(spark):
    text = "éé Licenced under the\tApache Licence, Version 2.0 ü"
    row = licenses.scan(spark.createDataFrame(rows([text]), SCHEMA)).head()
    label, start, end, edits = row.spans.split(":")
    assert (label, edits) == ("apache", "2") and text[int(start) : int(end)] == "Licenced under the\tApache Licence, Version 2.0"
    assert row.labels == "apache" and row.base_labels == "" and row.score > 0.9


def test_edges(edges, nothing):
    found = licenses.scan(edges).collect()
    assert len(found) == edges.count() and all(row.n_words == 0 for row in found if row.doc_id < 3)
    assert licenses.scan(nothing).count() == 0
