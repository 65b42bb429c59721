import random
import shutil

import pytest
from pyspark.sql import functions as F

from critiq.operators.bm25 import bm25_search, query_terms
from critiq.operators.postings import (
    block_bounds, read_postings, remaining_blocks, search_postings, write_postings,
)

WORDS = [f"word{i}" for i in range(60)] + ["straße", "ﬁn", "x", "foo_bar", "漢字"]


def corpus(spark, n, seed=0, lengths=(0, 30)):
    rng = random.Random(seed)
    weights = [1 / (i + 1) for i in range(len(WORDS))]
    rows = [
        (f"d{i:05}", " ".join(rng.choices(WORDS, weights, k=rng.randint(*lengths))) or None)
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "source_id string, content string").repartition(3)


def questions(spark, n, seed=1):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.randint(0, 6)))) for i in range(n)]
    return spark.createDataFrame(rows, "query_id long, question string")


def rows_of(found):
    return sorted((r.query_id, r["rank"], r.source_id, round(r.score, 6)) for r in found.collect())


@pytest.mark.parametrize("per_block, k", [(16, 3), (100_000, 10)])
def test_equals_the_scan(spark, tmp_path, per_block, k):
    documents, asked = corpus(spark, 300), questions(spark, 30)
    postings = write_postings(documents, str(tmp_path / "p"), documents_per_block=per_block)
    want = rows_of(bm25_search(documents, asked, k))
    assert rows_of(search_postings(postings, asked, k)) == want


def test_other_constants(spark, tmp_path):
    documents, asked, k = corpus(spark, 100, 5), questions(spark, 10, 6), 4
    postings = write_postings(documents, str(tmp_path / "p"), documents_per_block=32)
    other = rows_of(bm25_search(documents, asked, k, k1=0.9, b=0.1))
    assert rows_of(search_postings(postings, asked, k, k1=0.9, b=0.1)) == other


def test_ties_go_by_id(spark, tmp_path):
    documents = spark.createDataFrame(
        [(f"d{i:03}", "same text here") for i in range(200)], "source_id string, content string"
    )
    asked = spark.createDataFrame([(1, "text")], "query_id long, question string")
    postings = write_postings(documents, str(tmp_path / "p"), documents_per_block=4)
    found = rows_of(search_postings(postings, asked, 7))
    assert [r[2] for r in found] == [f"d{i:03}" for i in range(7)]


def test_a_search_reads_no_text_and_keeps_long_ids(spark, tmp_path):
    source = str(tmp_path / "source")
    corpus(spark, 120).select(
        F.substring("source_id", 2, 9).cast("long").alias("n"), "content"
    ).write.parquet(source)
    documents, asked = spark.read.parquet(source), questions(spark, 20)
    want = sorted(map(tuple, bm25_search(documents, asked, 4, id_column="n").collect()))
    write_postings(documents, str(tmp_path / "p"), id_column="n", documents_per_block=16)
    shutil.rmtree(source)
    postings = read_postings(spark, str(tmp_path / "p"))
    for _ in range(2):
        got = search_postings(postings, asked, 4, id_column="n")
        assert got.schema["n"].dataType.simpleString() == "bigint"
        assert [(a[0], a[1], round(a[2], 6)) for a in sorted(map(tuple, got.collect()))] == [
            (a[0], a[1], round(a[2], 6)) for a in want
        ]


def test_blocks_that_can_not_win_are_not_scored(spark, tmp_path):
    rows = [(f"d{i:05}", "common " * 30 + ("rare" if i in (7, 70, 700) else "plain"))
            for i in range(1000)]
    documents = spark.createDataFrame(rows, "source_id string, content string")
    postings = write_postings(documents, str(tmp_path / "p"), documents_per_block=10)
    asked = spark.createDataFrame([(1, "rare common")], "query_id long, question string")
    _, bounds = block_bounds(postings, query_terms(asked, "query_id", "question"), "query_id")
    assert bounds.count() > 80
    best = search_postings(postings, asked, 3)
    assert {r.source_id for r in best.collect()} == {"d00007", "d00070", "d00700"}
    first = bounds.orderBy(F.desc("bound")).limit(2)
    assert remaining_blocks(bounds, first, best, 3).count() <= 3


def test_only_question_terms_are_read(spark, tmp_path):
    postings = write_postings(corpus(spark, 300), str(tmp_path / "p"))
    files = postings.rows.select("bucket").distinct().count()
    assert files > 20
    asked = spark.createDataFrame([(1, "word3")], "query_id long, question string")
    plan = search_postings(postings, asked, 3)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan


def test_refusals_and_nothing_found(spark, tmp_path):
    documents = corpus(spark, 20)
    with pytest.raises(ValueError):
        write_postings(documents.unionByName(documents), str(tmp_path / "twice"))
    with pytest.raises(ValueError):
        write_postings(documents.limit(0), str(tmp_path / "none"))
    postings = write_postings(documents, str(tmp_path / "p"))
    unknown = spark.createDataFrame([(1, "nowhere to be seen"), (2, None)],
                                    "query_id long, question string")
    assert search_postings(postings, unknown, 3).isEmpty()
    with pytest.raises(ValueError):
        search_postings(postings, unknown, 0)


def test_documents_without_tokens_count(spark, tmp_path):
    documents = spark.createDataFrame(
        [("a", "word one"), ("b", None), ("c", ""), ("d", "! ?")], "source_id string, content string"
    )
    asked = spark.createDataFrame([(1, "word")], "query_id long, question string")
    postings = write_postings(documents, str(tmp_path / "p"))
    assert (postings.documents, postings.total_length) == (4, 2)
    assert rows_of(search_postings(postings, asked, 3)) == rows_of(bm25_search(documents, asked, 3))


@pytest.mark.parametrize("most, shuffled", [(1_000_000, 0), (3, 2)])
def test_document_lists_are_not_exchanged(spark, tmp_path, monkeypatch, most, shuffled):
    """Nothing but scores is, up to the bound; beyond it the same rows come out."""
    from critiq.operators import postings as P

    documents, asked = corpus(spark, 300), questions(spark, 30)
    postings = write_postings(documents, str(tmp_path / "p"), documents_per_block=16)
    monkeypatch.setattr(P, "PAIRS_PER_PASS", most)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        weights, bounds = block_bounds(
            postings, query_terms(asked, "query_id", "question"), "query_id"
        )
        scored = P._scored(postings, weights, bounds, "query_id", 1.5, 0.75)
        plan = scored._jdf.queryExecution().sparkPlan().toString()
        joins = plan.count("SortMergeJoin") + plan.count("ShuffledHashJoin")
        assert joins == shuffled
        got = rows_of(search_postings(postings, asked, 4))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == rows_of(bm25_search(documents, asked, 4))


def test_blocks_are_scored_from_whole_lists(spark, tmp_path, monkeypatch):
    """No row per question and document is exchanged; the scores are those of the joins."""
    from critiq.operators import postings as P

    documents, asked = corpus(spark, 300), questions(spark, 30)
    postings = write_postings(documents, str(tmp_path / "p"), documents_per_block=16)
    weights, bounds = block_bounds(
        postings, query_terms(asked, "query_id", "question"), "query_id"
    )
    scored = P._scored(postings, weights, bounds, "query_id", 1.5, 0.75)
    assert "Generate" not in scored._jdf.queryExecution().executedPlan().toString()
    few = P._scored(postings, weights, bounds, "query_id", 1.5, 0.75, k=2)
    got, best = ({(r[0], r[1]): r[2] for r in df.collect()} for df in (scored, few))
    monkeypatch.setattr(P, "PAIRS_PER_PASS", 3)
    joined = P._scored(postings, weights, bounds, "query_id", 1.5, 0.75)
    want = {(r[0], r[1]): r[2] for r in joined.collect()}
    assert got.keys() == want.keys() and best.items() <= got.items() and len(best) < len(got)
    assert all(abs(got[key] - want[key]) < 1e-8 for key in want)


def test_rows_hold_every_document_of_a_block(spark, tmp_path):
    documents = spark.createDataFrame(
        [(i, " ".join(["aa"] * (1 + i % 3) + ["bb"] * (i % 2))) for i in range(40)],
        "source_id bigint, content string",
    )
    rows = write_postings(documents, str(tmp_path / "p"), documents_per_block=10).rows.collect()
    held = {}
    for r in rows:
        assert r["held_by"] == len(r["held"])
        assert r["shortest"] == min(d["length"] for d in r["held"])
        for d in r["held"]:
            held[r["term"], d["id"]] = (r["frequency"], d["length"])
    words = {i: (1 + i % 3, i % 2) for i in range(40)}
    assert held == {("aa", i): (a, a + b) for i, (a, b) in words.items()} | {
        ("bb", i): (b, a + b) for i, (a, b) in words.items() if b
    }
    assert len({(r["term"], r["block"], r["frequency"]) for r in rows}) == len(rows)
