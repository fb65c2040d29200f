"""Columns of the user's whose names are those of working columns come back as they were."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skylattice.llm import jaccard, urls

NAMES = [
    "_id", "_key", "_mark", "_text", "_m0", "_n", "_o", "_component", "_row", "_raw", "_source", "_same", "_mix", "_copy", "_hash", "_own_score", "score",
    "n", "rows", "key", "bits", "in0", "in1", "_first", "_shard", "_url", "a.b",
]


@pytest.fixture(scope="module")
def docs(spark, prose):
    texts = [prose(i % 12, 40) for i in range(16)] + [None, "", prose(40, 30) + " password=0123456789abcdef0123"]
    data = [(i if i != 5 else None, text, "en", "ab"[i % 2], len(text or "")) for i, text in enumerate(texts)]
    plain = spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    # The value of each further column tells its row and itself.
    return plain.select("*", *[F.concat(F.lit(f"{name}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))).alias(name) for name in NAMES])


@pytest.mark.parametrize("stage", ["toxicity", "near duplicates", "secrets", "mixing"])
def test_stages_keep_all_columns(spark, tmp_path, docs, stage):
    spark.createDataFrame([(i, i % 2) for i in range(16)], "doc_id bigint, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    found = dict(corpus_pipeline.STAGES)[stage](spark, docs, str(tmp_path))
    assert found.columns == docs.columns and [f.dataType for f in found.schema] == [f.dataType for f in docs.schema]
    rows = found.collect()
    known = {row.doc_id: row for row in docs.collect()}
    assert rows
    for row in rows:
        before = known[row.doc_id]
        assert row[5:] == before[5:] and (row.lang, row.source) == (before.lang, before.source)
        assert row.text == before.text or stage in ("secrets", "mixing")


def test_secrets_without_lengths(spark, docs):
    assert corpus_pipeline.mask_secrets(spark, docs.drop("n_chars"), "").columns == docs.drop("n_chars").columns


@pytest.mark.parametrize("key, text", [("_id", "_text"), ("_key", "_mark"), ("n", "key")])
def test_groups_under_any_names(spark, prose, key, text):
    data = [(i, prose(i % 3, 30)) for i in range(9)] + [(None, prose(1, 30)), (3, prose(2, 30))]
    plain = jaccard.join_groups(spark.createDataFrame(data, "doc_id bigint, text string"))
    other = jaccard.join_groups(spark.createDataFrame(data, f"{key} bigint, {text} string"), key, text)
    assert other.columns[0] == key
    assert sorted(map(repr, map(tuple, plain.collect()))) == sorted(map(repr, map(tuple, other.collect())))


def test_urls_keep_other_columns(spark):
    data = [("http://a.org/x", 1, 2, 3, "h"), (None, 4, 5, 6, "h")]
    pages = spark.createDataFrame(data, "url string, _url int, _both int, _decided int, Host string")
    found = urls.judge(pages, urls.RULES, urls.fit(urls.LABELLED))
    assert found.columns == ["_url", "_both", "_decided", "host", "path", "rule", "score", "verdict"]
    assert sorted(tuple(row)[:5] for row in found.collect()) == [(1, 2, 3, "a.org", "/x"), (4, 5, 6, "", "")]
