"""The pipeline's stages, each held against what it should do to planted documents."""

import random

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(17)
    word = lambda: "".join(rnd.choice("abcdefghijklm") for _ in range(rnd.randint(2, 8)))
    passage = " ".join(word() for _ in range(60))
    docs, labels = [], []
    for i in range(400):
        words = [word() for _ in range(rnd.randint(40, 90))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(5):
                words[rnd.randrange(len(words))] = rnd.choice(["zorgig", "blarpung", "snekol"])
        docs.append([i, " ".join(words), "en", "s", 0])
        labels.append((i, 1, int(toxic)))
    docs[1][1] += " " + " ".join(word() for _ in range(60))
    docs[2][1] = docs[1][1]
    docs[3][1] = docs[1][1].replace(docs[1][1].split()[20], "changed", 1)
    for i in (6, 7):
        docs[i][1] += " " + passage
    docs[8][1] += " write me@site.org or +1 555 123 4567"
    docs[9][1], docs[11][1] = "", None
    rows = [(i, t, a, b, None if t is None else len(t)) for i, t, a, b, _ in docs]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, passage


def test_stages(spark, corpus, tmp_path):
    folder, passage = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs
        if name != "packing":
            assert docs.columns == columns
    ids = lambda n: {r.doc_id for r in seen[n].select("doc_id").collect()}
    clean = {i for i in range(400) if i % 5}
    assert ids("toxicity") == clean
    assert ids("ngram_jaccard") == clean - {2, 3} == ids("suffix_dedup") == ids("pii")
    texts = {r.doc_id: r.text for r in seen["pii"].collect()}
    assert passage in texts[6] and passage[10:-10] not in texts[7] and len(texts[7]) > 100
    assert texts[8].endswith("write <EMAIL> or <PHONE>") and texts[9] == "" and texts[11] is None
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in seen["pii"].collect())
    assert seen["packing"].agg(F.count_distinct("doc_id")).first()[0] == len(clean) - 2
    # the same documents and ids; which of equal lengths stands where is free
    once, again = (df.groupBy("doc_id").agg(F.max("doc_tokens").alias("n"), F.sum("length").alias("length")).collect() for df in (corpus_pipeline.run(spark, folder), seen["packing"]))
    assert {tuple(r) for r in once} == {tuple(r) for r in again} and all(r.n == r.length for r in once)


def test_empty_corpus(spark, corpus, tmp_path):
    folder, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() == 0


def test_odd_rows_in_every_stage(spark, odd, corpus, tmp_path):
    """Null and repeated ids, null, empty, blank and very long texts, repeated rows, columns with clashing names."""
    folder, _ = corpus
    docs = odd().unionByName(odd(["a b c d e f g h other text under an id that repeats"])).withColumn("kept", F.lit("x"))
    left = {"toxicity": 14, "ngram_jaccard": 10, "suffix_dedup": 10, "pii": 10}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / name))
        columns, before, docs = docs.columns, docs, spark.read.parquet(str(tmp_path / name))
        if name == "packing":
            assert docs.where("start = 0").count() == before.count()
        else:
            assert docs.columns == columns and docs.count() == left[name], name
            assert docs.where("text is null").count() == 1
    ids = sorted(r.doc_id for r in spark.read.parquet(str(tmp_path / "ngram_jaccard")).where("doc_id is not null").collect())
    # 0 twice, with two texts; 4 and the null id are copies, 6 is one of 5, and 8 was there twice
    assert ids == [0, 0, 1, 2, 3, 5, 7, 8, 9, 10]
