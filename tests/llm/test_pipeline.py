import random

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from skylattice.llm import jaccard, secrets
from tests.llm.conftest import SCHEMA, rows


def test_stages(spark, tmp_path, prose):
    texts = [prose(i, 40) for i in range(60)]
    texts[10] = texts[11] = texts[12]
    texts[20] += " password=0123456789abcdef0123"
    texts[30] = None
    for i in range(40, 60):
        texts[i] = texts[i] + f" nitwit {prose(i + 5, 8)} scoundrel imbecile " + prose(i, 9)
    data = spark.createDataFrame(rows(texts, sources=["ab"[i % 2] for i in range(60)]), SCHEMA)
    data.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, int(i >= 40)) for i in range(60)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        path = str(tmp_path / name)
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append({row.doc_id: row for row in docs.collect()})
        if name != "packing":
            assert docs.columns == before.columns
    clean, single, masked, mixed, packed = seen
    assert set(range(40)) <= set(clean) and len(clean) <= 45
    assert set(clean) - set(single) == {11, 12}
    assert masked[20].text.endswith("password=0123456789abcdef0123") is False and "[SECRET]" in masked[20].text
    assert masked[20].n_chars == len(masked[20].text) and set(masked) == set(single)
    assert 30 not in mixed and set(mixed) <= set(masked)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    total = sum(len(tokenizer.encode(row.text).ids) + 1 for row in spark.read.parquet(str(tmp_path / "mixing")).collect())
    assert spark.read.parquet(str(tmp_path / "packing")).groupBy().sum("length").head()[0] == total
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.columns == spark.read.parquet(str(tmp_path / "packing")).columns
    assert whole.groupBy().sum("length").head()[0] == total


def test_stages_on_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_use_the_operators():
    assert corpus_pipeline.secrets is secrets and corpus_pipeline.jaccard is jaccard
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near duplicates", "secrets", "mixing", "packing"]


def test_near_copies_by_five_words_and_four_fifths(spark, prose):
    draw = random.Random(4)
    texts = []
    for family in range(8):
        words = prose(900 + family, 100).split()
        # 100 words and the same with more behind: 96 / 114 and 96 / 120 link, 96 / 121 does not.
        texts += [" ".join(words + prose(950 + 10 * family + more, more).split()) for more in (0, 18, 24, 25)][:: 1 if family % 2 else -1]
        for edits in range(1, 6):
            own = list(words)
            for place in draw.sample(range(100), edits):
                own[place] = f"new{family}x{place}"
            texts.append(" ".join(own))

    def shingles(text):
        words = text.lower().split()
        return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}

    sets = [shingles(text) for text in texts]
    shares = {(a, b): 100 * len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in range(len(sets)) for b in range(a)}
    assert any(80 <= share < 81 for share in shares.values()) and any(79 < share < 80 for share in shares.values())
    group = list(range(len(texts)))
    for _ in texts:
        for (a, b), share in shares.items():
            if share >= 80:
                group[a] = group[b] = min(group[a], group[b])
    kept = corpus_pipeline.keep_one_of_each_group(spark, spark.createDataFrame(rows(texts), SCHEMA), "")
    assert sorted(row.doc_id for row in kept.collect()) == sorted(set(group))


def test_repeated_and_missing_ids(spark, prose):
    one, two, three, four = (prose(i, 60) for i in range(4))
    data = [(4, one), (4, two), (4, one + " end"), (None, three), (None, three), (None, three + " end"), (None, two), (6, four), (6, four)]
    docs = spark.createDataFrame([(i, text, "en", "s", len(text)) for i, text in data], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    runs = [sorted(map(str, corpus_pipeline.keep_one_of_each_group(spark, docs.repartition(n), "").collect())) for n in (1, 5)]
    assert runs[0] == runs[1] and len(runs[0]) == 4
    kept = [(row.doc_id, row.text) for row in corpus_pipeline.keep_one_of_each_group(spark, docs, "").collect()]
    assert (4, two) in kept and (6, four) in kept and len({(4, one), (4, one + " end")} & set(kept)) == 1
    assert len({(None, three), (None, three + " end")} & set(kept)) == 1
