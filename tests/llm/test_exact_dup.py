import hashlib
import random
import re

from pyspark.sql import functions as F

from critiq.llm.exact_dup import exact_duplicates

SCHEMA = "doc_id long, text string, keep_id string, hash int, place string"


def brute_force(rows):
    """Sorted (id, keep_id, size, sha) of every row, and how many rows of a class stay."""
    groups = {}
    for doc, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(doc)
    found = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        found += [(i, keep, len(ids), sha) for i in ids]
    return sorted(found, key=str), len(groups)


def check(spark, rows, **options):
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    got = exact_duplicates(docs.repartition(3), **options).collect()
    want, kept = brute_force(rows)
    assert sorted([(r[0], r[1], r[2], r[4]) for r in got], key=str) == want
    assert sum(r.kept for r in got) == kept
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert len({r.text_sha256 for r in got if r.kept}) == kept


def awkward(seed=1, n=400):
    rng = random.Random(seed)
    parts = ["a", "b", " ", "  ", "\t", "\n\n", "\r\n", " ", "\x0b \x0c", "é", "漢", "\x1c"]
    return [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(5)))) for i in range(n)]


def test_awkward_texts(spark):
    check(spark, awkward())


def test_nulls_repeats_and_long_texts(spark):
    long = "word " * 300_000
    rows = [(None, None), (None, ""), (4, ""), (4, None), (4, ""), (7, "x"), (7, "x"), (7, "y"),
            (None, "lone"), (None, "two"), (None, "two"), (1, long), (9, long + " "), (3, long + "x")]
    check(spark, rows)


def test_weak_hashes_are_told_apart_by_bytes(spark):
    rows = awkward(2, 300) + [(1000 + i, f"alone {i}") for i in range(50)] + [(None, "a"), (5, "a")]
    check(spark, rows, hash_of=lambda sha: F.unhex(F.concat(F.lit("0"), F.substring(sha, 1, 1))))
    check(spark, rows, hash_of=lambda sha: F.unhex(F.lit("00")))


def test_empty_table(spark):
    got = exact_duplicates(spark.createDataFrame([], SCHEMA))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert got.isEmpty()


def test_one_text_holds_a_third(spark):
    rows = [(i, "same  text" if i % 3 else f"other {i // 2}") for i in range(3000, 0, -1)]
    check(spark, rows)


def test_no_python_worker(spark):
    plan = exact_duplicates(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    text = plan._jdf.queryExecution().toString()
    assert "Arrow" not in text and "Python" not in text


def test_string_ids(spark):
    docs = spark.createDataFrame([("b", "t"), ("a", "t "), ("c", "t  ")], "k string, t string")
    got = {r.k: (r.keep_id, r.kept) for r in exact_duplicates(docs, "k", "t").collect()}
    assert got == {"b": ("b", True), "a": ("a", True), "c": ("a", False)}
