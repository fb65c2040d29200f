import numpy as np

from pyspark.sql import functions as F

from skylattice.llm import neighbours

SCHEMA = "vec_id bigint, embedding array<float>, label int, rank string"


def table(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "old") for i, v in enumerate(vectors)], SCHEMA)


def brute(vectors, queries, count=5):
    kept = {i: np.array(v, np.float32).astype(float) for i, v in enumerate(vectors)}
    found = {}
    for q in queries:
        scores = []
        for i, v in kept.items():
            if i != q:
                scores.append((-float((v * kept[q]).sum() / np.sqrt((v * v).sum() * (kept[q] ** 2).sum())), i))
        found[q] = sorted((round(s, 12), i) for s, i in scores)[:count]
    return found


def test_recall_and_scores(spark):
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(3000, 24)).round(3).tolist()
    for i in range(400, 700):
        vectors[i] = vectors[400]
    found = {}
    for row in neighbours.search(table(spark, vectors), F.col("vec_id") % 50 == 0).collect():
        found.setdefault(row.query_id, []).append((row.rank, row.vec_id, row.score))
    wanted = brute(vectors, range(0, 3000, 50))
    assert set(found) == set(wanted)
    hits = 0
    for q, rows in found.items():
        rows.sort()
        assert [row[0] for row in rows] == [1, 2, 3, 4, 5] and q not in {row[1] for row in rows}
        hits += len({row[1] for row in rows} & {i for _, i in wanted[q]})
        by = dict((i, s) for s, i in brute(vectors, [q], 3000)[q])
        assert all(abs(score + by[i]) < 1e-9 for _, i, score in rows)
    assert hits / (5 * len(wanted)) >= 0.9
    assert [row[1] for row in found[450]] == [400, 401, 402, 403, 404] and [row[1] for row in found[400]] == [401, 402, 403, 404, 405]


def test_edges(spark):
    vectors = [[1.0, 0], None, [0.0, 0.0], [float("nan"), 1], [float("inf"), 1], [None, 1.0], [], [2.0, 0.0], [0.0, -3.0]]
    rows = neighbours.search(table(spark, vectors), F.lit(True)).collect()
    found = {(row.query_id, row.rank): (row.vec_id, row.score) for row in rows}
    assert found == {(0, 1): (7, 1.0), (0, 2): (8, 0.0), (7, 1): (0, 1.0), (7, 2): (8, 0.0), (8, 1): (0, 0.0), (8, 2): (7, 0.0)}
    assert neighbours.search(table(spark, vectors).limit(0), F.lit(True)).count() == 0
    assert neighbours.search(table(spark, vectors), F.col("vec_id") < 0).count() == 0


def test_near_and_rescaled_copies_hide_nothing(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(6000, 32)).astype(np.float32)
    # A third of the table: near copies of one vector, half of them rescaled.
    for i in range(0, 6000, 3):
        vectors[i] = vectors[0] * (1.0 if i % 2 else 2.0 ** (i % 5)) + (rng.normal(size=32) * 1e-3 if i % 4 else 0)
    asked = range(0, 6000, 50)
    found = {}
    for row in neighbours.search(table(spark, vectors.tolist()), F.col("vec_id") % 50 == 0).collect():
        found.setdefault(row.query_id, []).append((row.rank, row.vec_id, row.score))
    units = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    for q in asked:
        cosines = units @ units[q]
        rows = sorted(found[q])
        assert len({i for _, i, _ in rows} - {q}) == 5 and all(abs(score - cosines[i]) < 1e-9 for _, i, score in rows)
        cosines[q] = -2
        assert np.allclose([score for _, _, score in rows], np.sort(cosines)[-5:][::-1], rtol=0, atol=1e-12)


def test_pivots_lie_apart(spark):
    rng = np.random.default_rng(2)
    vectors = [((i % 7 + 1) * np.ones(8)).tolist() if i % 3 else rng.normal(size=8).tolist() for i in range(300)]
    pivots = neighbours.choose_pivots(table(spark, vectors), "vec_id", "embedding", 30)
    cosines = pivots @ pivots.T - 2 * np.eye(len(pivots))
    assert len(pivots) == 30 and cosines.max() < 1 - 1e-6
