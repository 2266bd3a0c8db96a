"""The pipeline's stages, each on what the former one kept."""

import random

import corpus_pipeline
from cadenza.llm import queries


def test_stages_take_effect(spark, tmp_path):
    random.seed(8)
    vocabulary = ["".join(random.choices("abcdefghij", k=random.randint(3, 8))) for _ in range(600)]
    fresh = lambda n: " ".join(random.choices(vocabulary, k=n))
    passage = " ".join(w[:4] for w in fresh(55).split())  # under 300 bytes
    rows, labels = [], []
    for i in range(400):
        text = fresh(random.randint(60, 150))
        toxic = i % 8 == 0
        if toxic:
            text += " " + " ".join(random.choices(["zuvox", "zuvoxed", "drekky"], k=5))
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, rows[1][1], "en", "s1", 0), (1001, rows[1][1], "en", "s2", 0), (1001, rows[1][1], "en", "s2", 0), (1002, None, "en", "s0", None)]
    rows += [(1100 + i, f"{fresh(80)} {passage} {fresh(70)} me@mail{i}.example.com", "en", "s0", 0) for i in range(6)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = queries.table(spark, folder, "documents")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        found = stage(spark, docs, folder)
        found.write.parquet(f"{folder}/stage{k}")
        before, docs = docs, spark.read.parquet(f"{folder}/stage{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == before.columns
            kept[name] = {(r.doc_id, r.text) for r in docs.collect()}
    ids = {name: {i for i, _ in rows} for name, rows in kept.items()}
    toxic = {i for i in range(400) if i % 8 == 0}
    assert len(ids["toxicity"] & toxic) <= 2 and len(ids["toxicity"] - toxic) >= 355
    assert ids["simhash_near_dedup"] == ids["toxicity"] - {1000, 1001}
    texts = dict(kept["suffix_array_dedup"])
    assert len(passage) < 300 and sum(passage in (texts[1100 + i] or "") for i in range(6)) == 1 and texts[5] == rows[5][1]
    assert sum(passage[20:-20] in (texts[1100 + i] or "") for i in range(6)) == 1
    assert all("<EMAIL>" in dict(kept["pii"])[1100 + i] for i in range(6))
    assert {r.doc_id for r in docs.collect()} == ids["pii"]
    assert corpus_pipeline.run(spark, folder).count() == docs.count()


#: Columns that are called like those of the operators.
CLASHING = "doc_id long, text string, n_chars int, source string, score double, th int, root string, keep_id string, kept_text string, redacted int, k0 int, c1 int, spans string, own_text string"


def rows_of(values):
    return [(i, t, 0, "s", 0.5, 1, "r", "x", "y", 2, 3, 4, "z", "o") for i, t in values]


def test_null_and_shared_ids_lose_no_document(spark, tmp_path):
    random.seed(9)
    fresh = lambda: " ".join("".join(random.choices("abcdefghij", k=6)) for _ in range(60))
    texts = [fresh() for _ in range(7)]
    values = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (7, texts[5]), (8, texts[6]), (8, texts[6]), (9, texts[6]), (None, None), (10, ""), (11, "x " * 50_000)]
    labels = spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows_of(values), CLASHING)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, str(tmp_path))
        assert found.columns == docs.columns
        got = sorted(((r.doc_id, r.text) for r in found.collect()), key=str)
        if name == "simhash_near_dedup":
            want = [*values[:7], (10, ""), (11, "x " * 50_000)]
            assert got == sorted(want, key=str)
        else:
            assert len(got) == len(values)
        packed = corpus_pipeline.pack_sequences(spark, docs, str(tmp_path))
    assert packed.count() >= len(values) - 1


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([], CLASHING)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
