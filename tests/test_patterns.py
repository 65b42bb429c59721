import random

import pytest

from critiq.operators.patterns import containing


def pairs(spark, texts, passages, **options):
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    wanted = spark.createDataFrame(
        [(f"p{i}", p) for i, p in enumerate(passages)], "item string, said string"
    )
    found = containing(
        documents.repartition(3), wanted, id_column="doc_id", text_column="text",
        passage_column="item", passage_text_column="said", **options,
    )
    assert found.columns == ["item", "doc_id"]
    return sorted(map(tuple, found.collect()))


def brute_force(texts, passages):
    return sorted(
        (f"p{i}", d) for i, p in enumerate(passages) for d, t in enumerate(texts)
        if p is not None and t is not None and p in t
    )


@pytest.mark.parametrize("bound", [20, 1_000_000])
def test_equals_every_pair(spark, bound):
    rng = random.Random(3)
    signs = "aab\n é漢😀"
    texts = ["".join(rng.choices(signs, k=rng.randrange(40))) for _ in range(80)] + [None, ""]
    passages = ["".join(rng.choices(signs, k=rng.randrange(1, 5))) for _ in range(25)]
    passages += [passages[0], "", None, "never there", "a" * 30]
    got = pairs(spark, texts, passages, characters_per_pass=bound)
    assert got == brute_force(texts, passages) and len(got) > 100


def test_nothing_to_look_for_or_in(spark):
    assert pairs(spark, ["a", "b"], [None]) == []
    assert pairs(spark, ["a", "b"], [""]) == [("p0", 0), ("p0", 1)]
    assert pairs(spark, [None], ["a"]) == []


def test_long_passages_and_overlaps(spark):
    long = "word " * 30_000
    texts = [long, long + "x", "ab" * 50, "aba"]
    passages = [long, "ababab", "b", "aba", long + "x"]
    assert pairs(spark, texts, passages) == brute_force(texts, passages)
