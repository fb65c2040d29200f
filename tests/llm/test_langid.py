from skylattice.llm import langid
from tests.llm.conftest import SCHEMA, rows


def test_held_out_accuracy(spark, prose):
    tongues = {"xx": ("the", "on", "er", "ti"), "yy": ("que", "ño", "ci", "as"), "zz": ("sch", "ü", "ein", "keit")}
    texts, langs = [], []
    for name, syllables in tongues.items():
        texts += [prose(i, 30, syllables) for i in range(40)]
        langs += [name] * 40
    docs = spark.createDataFrame(rows(texts, langs), SCHEMA)
    model = langid.fit(docs.where("doc_id % 2 = 0"))
    found = langid.predict(docs.where("doc_id % 2 = 1").select("doc_id", "lang", "text"), model).collect()
    assert sum(row.lang == row.lang_pred for row in found) >= 58
    assert all(0 <= row.score <= 1 for row in found)


def test_by_the_formula():
    """The score is the naive Bayes posterior, counted n-gram by n-gram."""
    import numpy as np

    rng = np.random.default_rng(1)
    table = rng.integers(-9 * 4096, -4096, (2, 1 << langid.BUCKET_BITS)).astype(np.int32)
    model = langid.LanguageModel(["a", "b"], table, np.array([-100, -900]))
    texts = ["Hello, World 12", "ab", "Ünï  x"]
    letters, starts, ends = langid.symbols(texts)
    for text, start, end in zip(texts, starts, ends):
        sums = model.prior.astype(float)
        alone, s, e = langid.symbols([text])
        assert (alone[s[0] : e[0]] == letters[start:end]).all()
        for order in (1, 2, 3):
            for bucket in langid.buckets(alone, order, langid.BUCKET_BITS)[s[0] : e[0]]:
                sums = sums + table[:, bucket]
        label, score = model.predict([text])
        odds = np.exp((sums - sums.max()) / langid.SCALE)
        assert label == [["a", "b"][int(sums.argmax())]] and abs(score[0] - odds.max() / odds.sum()) < 1e-6


def test_edges(edges, nothing):
    found = langid.predict(edges, langid.fit(edges)).collect()
    assert len(found) == edges.count()
    by = {row.doc_id: row for row in found}
    for doc_id in (0, 1, 2, 5):
        assert (by[doc_id].lang_pred, by[doc_id].score) == ("und", 0.0)
    assert by[3].lang_pred == "en" and by[3].extra == [1]
    empty = langid.fit(nothing)
    assert langid.predict(nothing, empty).count() == 0
    assert {row.lang_pred for row in langid.predict(edges, empty).collect()} == {"und"}
