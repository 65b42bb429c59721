from collections import Counter

import corpus_pipeline
from critiq.llm import common
from critiq.llm.near_dup import near_duplicates
from critiq.llm.packing import token_ids, tokenizer_files
from critiq.llm.pii import base_spans

SF = "/root/testdata/sf0.001"


def odd_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(10_000, None, None, None, None), (10_001, "", "en", "src1", 0),
           (None, "Plain words of a text without an id.", "en", None, 36),
           (10_002, "mail a.b@c.example.com or +1 (826) 555-4081 190.137.223.20 now", "en", "s", 60)]
    return docs.union(spark.createDataFrame(odd, docs.schema)).union(docs.limit(3))


def test_stages(spark):
    docs = odd_documents(spark)
    columns = docs.columns
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, SF))
        steps[name] = docs.toPandas()
    names = list(steps)
    assert names == ["quality", "near_duplicates", "personal_data", "mixing", "packing"]
    for name in names[:-1]:
        assert list(steps[name].columns) == columns
    # One document of each group, and each group has one.
    left = steps["near_duplicates"]
    assert left.doc_id.dropna().is_unique
    judged = near_duplicates(spark.createDataFrame(left[["doc_id", "text"]].dropna(
    ).astype({"doc_id": "int64"})))
    assert judged.filter("not kept").count() == 0
    # Personal data is gone; nothing else is.
    after = steps["personal_data"]
    assert len(after) == len(left) and Counter(after.doc_id.dropna()) == Counter(left.doc_id.dropna())
    assert not any(base_spans(t or "") for t in after.text)
    before = dict(zip(left.doc_id, left.text))
    for i, t in zip(after.doc_id, after.text):
        if i in before and not base_spans(before[i] or "") and "phone" not in (t or ""):
            assert (t or "") == (before[i] or "")
    # All are drawn, and all tokens are packed.
    drawn = steps["mixing"]
    assert set(drawn.doc_id.dropna()) == set(after.doc_id.dropna())
    files = tokenizer_files()
    assert steps["packing"].length.sum() == sum(len(token_ids(t, files)) for t in drawn.text)


def test_run_is_the_stages_on_documents(spark):
    found = corpus_pipeline.run(spark, SF)
    docs = common.read_table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, SF))
    drop = ["sequence_id", "offset"]
    assert Counter(map(tuple, found.drop(*drop).collect())) == Counter(
        map(tuple, docs.drop(*drop).collect()))


def test_stages_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, SF))
    assert docs.count() == 0
