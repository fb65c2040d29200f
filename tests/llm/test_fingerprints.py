import hashlib

from pyspark.sql import functions as F

from skylattice.llm import fingerprints
from tests.llm.conftest import EDGES, SCHEMA, rows


def result(docs):
    rows_ = fingerprints.with_next(docs)
    edited = F.concat(F.expr("left(_text, int(n_chars) - _third)"), F.expr("left(_head, _third)"))
    rows_ = fingerprints.with_tree(fingerprints.with_tree(rows_.withColumn("_edited", edited), "_text", "own"), "_edited", "edited")
    start, end = fingerprints.changed_span("own", "edited")
    return rows_.select(
        "doc_id", "n_chars", "_edited", "own_root", fingerprints.fingerprint("own").alias("print"), start.alias("start"), end.alias("end"),
        fingerprints.likeness(F.col("own_leaves"), F.col("edited_leaves")).alias("near"),
        fingerprints.likeness(fingerprints.short_digests(F.col("own_leaves")), F.col("next_leaves")).alias("next"), "own_lengths",
    )


def test_edits_and_roots(spark, prose):
    texts = EDGES[:11] + [prose(i, 40 + i) + ".\n" + prose(i + 1, 30) for i in range(12)] + EDGES[12:]
    docs = spark.createDataFrame(rows(texts), SCHEMA).repartition(3)
    order = sorted(range(len(texts)), reverse=True)
    prints = {}
    for row in result(docs).collect():
        text = texts[row.doc_id] or ""
        after = texts[order[(order.index(row.doc_id) + 1) % len(order)]] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        assert (row.n_chars, row._edited) == (len(text), edited) and sum(row.own_lengths) == len(text)
        prints.setdefault(row.print, set()).add(text)
        assert 0 <= row.near <= 1 and 0 <= row.next <= 1
        assert (row.start is None) == (text == edited) and (text == edited) <= (row.near == 1)
        if row.start is not None:
            kept = next((i for i, (x, y) in enumerate(zip(text, edited)) if x != y), min(len(text), len(edited)))
            assert row.start <= kept <= max(row.end, row.start) <= len(text)
    assert all(len(same) == 1 for same in prints.values()) and len(prints) == len({text or "" for text in texts})


def test_query_digest(spark, tmp_path, prose):
    texts = [prose(i, 20) for i in range(7)]
    spark.createDataFrame(rows(texts), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    for row in fingerprints.op7_fingerprints(spark, str(tmp_path)).collect():
        text, after = texts[row.doc_id], texts[(row.doc_id - 1) % 7]
        third = len(text) // 3
        assert row.edited_sha256 == hashlib.sha256((text[: len(text) - third] + after[:third]).encode()).hexdigest()
        assert row.near_edited > row.near_next


def test_edges(spark, edges, nothing):
    assert result(edges).count() == edges.count() and result(nothing).count() == 0
    odd = spark.createDataFrame([(None, "a b c. d e f"), (None, "a b c. d e f"), (3, None), (3, "x y z. x y")], "doc_id bigint, text string")
    assert result(odd).count() == 4
    plan = result(edges)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
