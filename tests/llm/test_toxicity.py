import itertools
import random

import numpy as np
import pytest

from skylattice.llm import toxicity
from tests.llm.conftest import SCHEMA, rows

INSULTS = ["scoundrel", "nitwit", "imbecile"]


@pytest.fixture(scope="module")
def labelled(prose):
    texts, labels = [], []
    for i in range(160):
        words = prose(i, 60).split(" ")
        if i % 2:
            for k in range(3):
                words.insert(random.Random(i * 7 + k).randrange(len(words)), INSULTS[(i + k) % 3])
        texts.append(" ".join(words) + ".")
        labels.append(i % 2)
    return texts, labels


def test_kernel_is_the_sum_over_subsequences():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 4, 15).astype(np.uint8), rng.integers(0, 4, 12).astype(np.uint8)

    def features(window):
        found = {}
        for places in itertools.combinations(range(len(window)), 4):
            skips = places[-1] - places[0] - 3
            if skips <= toxicity.MOST_GAPS:
                key = tuple(int(window[i]) for i in places)
                found[key] = found.get(key, 0) + toxicity.DECAY**skips
        return found

    left, right = features(a), features(b)
    wanted = sum(left[key] * right.get(key, 0) for key in left) / np.sqrt(len(a) * len(b))
    assert abs(toxicity._kernel([a], [b])[0, 0] - wanted) < 1e-4
    table = np.zeros(toxicity.FEATURES, np.float32)
    keys, weights = toxicity.window_features(b)
    table[keys] = weights
    padded = np.concatenate((a, np.zeros(8, np.uint8)))
    inside = sum(
        toxicity.positions(padded, table)[i] for i in range(len(a))
    )
    zero_tail = features(np.concatenate((a, np.zeros(8, np.uint8))))
    wanted = sum(zero_tail[key] * right.get(key, 0) for key in zero_tail) / np.sqrt(len(b))
    rest = sum(toxicity.positions(padded, table)[len(a) :])
    assert abs(inside + rest - wanted) < 1e-3


def test_held_out_and_disguised(spark, labelled, prose):
    texts, labels = labelled
    docs = spark.createDataFrame([(i, text, label) for i, (text, label) in enumerate(zip(texts, labels))], "doc_id bigint, text string, toxic int")
    model = toxicity.fit(docs.where("doc_id < 120"), landmarks=100)
    scores = {row.doc_id: row.score for row in toxicity.score(docs.drop("toxic"), model).collect()}
    right = sum((scores[i] >= 0.5) == bool(labels[i]) for i in range(120, 160))
    assert right >= 38
    clean = prose(999, 12)
    harsh = [f"{clean} {word} {clean}" for word in ("scoundrel", "s c o u n d r e l", "sc0undrel", "scoundxrel", "scound-rel", "imbec1le")]
    assert all(score > 5 * model.score([clean])[0] for score in model.score(harsh)), model.score(harsh)


def test_scores_do_not_depend_on_the_batch(labelled):
    texts, labels = labelled
    codes = [toxicity.symbols([text]) for text in texts]
    model = toxicity._learn([c[s[0] : e[0]] for c, s, e in codes], np.array(labels, float), 60, 1, 100.0, np.random.default_rng(1))
    together = model.score(texts + [None, "", "x"])
    assert np.allclose(together, [model.score([text])[0] for text in texts + [None, "", "x"]], atol=2e-6)


def test_edges(spark, edges, nothing):
    marked = edges.selectExpr("doc_id", "text", "CAST(doc_id % 2 AS int) AS toxic")
    model = toxicity.fit(marked, landmarks=10)
    found = toxicity.score(edges, model).collect()
    assert len(found) == edges.count() and all(0 <= row.score <= 1 for row in found)
    kept = toxicity.score(edges.drop("score"), model, keep_text=True)
    assert kept.columns == [*edges.drop("score").columns, "score"] and kept.count() == edges.count()
    none = toxicity.fit(nothing.selectExpr("doc_id", "text", "1 AS toxic"))
    assert toxicity.score(nothing, none).count() == 0
    assert {row.score for row in toxicity.score(edges, none).collect()} == {0.0}
    assert toxicity.sampled_labels(nothing.selectExpr("doc_id", "1 AS toxic")).count() == 0


def test_a_driver_that_has_learned_gives_its_memory_back(spark, monkeypatch):
    given = []
    monkeypatch.setattr(toxicity, "give_back", lambda: given.append(1))
    docs = spark.createDataFrame([(i, ("you rotten fool " if i % 2 else "a quiet green field ") * (3 + i % 5), i % 2) for i in range(40)], "doc_id long, text string, toxic int")
    toxicity.fit(docs, landmarks=20)
    assert given


def test_the_driver_holds_no_matrix_of_features_and_landmarks():
    import tracemalloc

    rng = np.random.default_rng(3)
    windows = [rng.integers(0, 32, toxicity.WINDOW).astype(np.uint8) for _ in range(300)]
    tracemalloc.start()
    found = toxicity._kernel(windows[:50], windows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for row, column in ((0, 0), (3, 7), (49, 299)):
        keys, weights = toxicity.window_features(windows[row])
        table = np.zeros(toxicity.FEATURES)
        others, theirs = toxicity.window_features(windows[column])
        table[others] = theirs
        assert abs(found[row, column] - weights @ table[keys]) < 1e-4
    assert peak < 15e6
