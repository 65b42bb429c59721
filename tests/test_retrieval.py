import math
import random
from collections import Counter
from datetime import date

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from critiq.functions.plugins import embed
from critiq.operators import bm25
from critiq.operators.bm25 import bm25_search
from critiq.operators.explore import ReviewFilter
from critiq.operators.scan_topk import query_passes
from critiq.operators.vector_search import search, vector_search
from critiq.plans.tables import letter_counts


def _ranking(docs, question, k, k1=1.5, b=0.75):
    """Scores in plain Python over ``{id: tokens}``."""
    n = len(docs)
    average = sum(map(len, docs.values())) / n
    held = Counter(t for words in docs.values() for t in set(words))
    scored = []
    for key, words in docs.items():
        often = Counter(words)
        score = 0.0
        for term in sorted(set(question)):
            if often[term]:
                idf = math.log(1 + (n - held[term] + 0.5) / (held[term] + 0.5))
                norm = k1 * (1 - b + b * len(words) / max(average, 1.0))
                score += idf * often[term] * (k1 + 1) / (often[term] + norm)
        if score > 0:
            scored.append((-round(score, 9), key))
    return [key for _, key in sorted(scored)[:k]]


def _docs(spark, docs, partitions=3):
    rows = [(k, " ".join(v)) for k, v in docs.items()]
    return spark.createDataFrame(rows, "source_id string, content string").repartition(partitions)


def _queries(spark, questions):
    return spark.createDataFrame(list(questions.items()), "query_id int, question string")


def _found(result):
    found = {}
    for r in sorted(result.collect(), key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append(r.source_id)
    return found


def test_many_questions_read_a_corpus_tokenised_once(spark, monkeypatch):
    """No pass tokenises again; a question that comes twice counts its terms once."""
    monkeypatch.setattr(bm25, "PAIRS_IN_PLACE", 10)
    monkeypatch.setattr(bm25, "_CELLS", 50)
    rng = random.Random(7)
    words = [f"w{i}" for i in range(80)]
    docs = {f"d{i:03d}": rng.choices(words, k=rng.randint(1, 30)) for i in range(200)}
    questions = {i: " ".join(rng.choices(words, k=8)) for i in range(20)}
    asked = _queries(spark, questions)
    found = bm25_search(_docs(spark, docs), asked.unionByName(asked), 5, pairs_per_pass=250)
    assert "regexp_extract_all" not in found._jdf.queryExecution().executedPlan().toString()
    assert _found(found) == {q: _ranking(docs, t.split(), 5) for q, t in questions.items()}


@pytest.mark.parametrize("rows", [3, 70, 500])
def test_a_block_scores_and_bounds_its_hits(rows):
    rng = np.random.default_rng(rows)
    held = rng.random((rows, 12)) < np.linspace(0.01, 0.9, 12)
    value = held * rng.random((rows, 12)).round(1)
    row, word = np.nonzero(held)
    block = bm25.DocumentBlock(rows, row, word, value[row, word], 12)
    terms = [(t, block.ends[t], block.ends[t + 1]) for t in range(0, 12, 2)]
    scores = block.scores(terms)
    want = value[:, ::2].sum(axis=1)
    assert np.allclose(scores[:rows], want) and not scores[rows:].any()
    for k in (1, 5):
        least = np.sort(want)[-min(k, rows)]
        hits = block.best(scores, -np.inf, k)
        assert set(np.flatnonzero((want >= least) & (want > 0))) == set(hits)
        assert not len(block.best(scores, want.max() + 1, k))


@pytest.mark.parametrize("pairs_per_pass", [1_000_000, 40])
def test_bm25_equals_brute_force(spark, monkeypatch, pairs_per_pass):
    monkeypatch.setattr(bm25, "_BLOCK", 7)
    monkeypatch.setattr(bm25, "_CELLS", 300)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    docs = {
        f"d{i:03d}": rng.choices(words, weights=[60 - i for i in range(60)], k=rng.randint(1, 40))
        for i in range(300)
    }
    # a third of the documents are copies of one
    docs.update({f"c{i:03d}": ["w1", "w2", "w3"] for i in range(150)})
    questions = {i: " ".join(rng.choices(words + ["nowhere"], k=6)) for i in range(40)}
    found = _found(
        bm25_search(
            _docs(spark, docs), _queries(spark, questions), 7, pairs_per_pass=pairs_per_pass
        )
    )
    expected = {q: _ranking(docs, text.split(), 7) for q, text in questions.items()}
    assert found == {q: ids for q, ids in expected.items() if ids}


def test_bm25_normalises_and_does_not_pad(spark):
    docs = {"crispy": ["ＣＲＩＳＰＹ", "crust"], "other": ["quiet", "dining", "room"]}
    questions = {1: "crispy", 2: "wheelchair parking", 3: "", 4: "a _"}
    assert _found(bm25_search(_docs(spark, docs), _queries(spark, questions))) == {1: ["crispy"]}


def test_bm25_checks_its_input(spark):
    questions = _queries(spark, {1: "crispy"})
    docs = _docs(spark, {"a": ["crispy"]})
    with pytest.raises(ValueError, match="k is below 1"):
        bm25_search(docs, questions, 0)
    with pytest.raises(ValueError, match="no document to rank"):
        bm25_search(docs.limit(0), questions)
    rows = spark.createDataFrame([("a",), ("a",), ("",), (None,), ("b",)], "source_id string")
    checked = bm25.check_document_ids(rows, "source_id").collect()
    assert {(r.source_id, r.documents) for r in checked} == {("a", 2), ("", 1), (None, 1)}


def test_passes_are_within_their_bound_and_whole(spark):
    rows = [(q, t) for q in range(40) for t in range(1 + q % 7)] + [(99, t) for t in range(30)]
    pairs = spark.createDataFrame(rows, "query_id int, term int")
    parts = [p.collect() for p in query_passes(pairs, "query_id", DataFrame.count, 12)]
    assert sorted(tuple(r) for part in parts for r in part) == sorted(rows)
    for part in parts:
        # only a question that is too large by itself goes beyond the bound
        assert len(part) <= 12 or {r.query_id for r in part} == {99}
    seen = [r.query_id for part in parts for r in {r.query_id: r for r in part}.values()]
    assert len(seen) == len(set(seen))


def _nearest(index, query, k, distance):
    order = sorted((round(distance(np.array(v), np.array(query)), 9), i) for i, v in index.items())
    return [i for _, i in order[:k]]


DISTANCES = {
    "l2": lambda a, b: float(((a - b) ** 2).sum()),
    "ip": lambda a, b: float(1 - a @ b),
    "cosine": lambda a, b: float(1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b)),
}


@pytest.mark.parametrize("metric", list(DISTANCES))
@pytest.mark.parametrize("cells", [8_000_000, 16])
def test_vectors_equal_brute_force(spark, metric, cells):
    rng = np.random.default_rng(2)
    index = {f"v{i:03d}": [float(x) for x in rng.integers(-3, 4, 4) + 0.5] for i in range(200)}
    index.update({f"z{i:03d}": [1.5, 0.5, -0.5, 2.5] for i in range(100)})
    queries = {i: [float(x) for x in rng.integers(-3, 4, 4) + 0.5] for i in range(9)}
    rows = spark.createDataFrame(list(index.items()), "source_id string, embedding array<float>")
    asks = spark.createDataFrame(list(queries.items()), "query_id int, embedding array<double>")
    found = _found(
        vector_search(rows.repartition(3), asks, 6, metric=metric, cells_per_pass=cells)
    )
    expected = {q: _nearest(index, v, 6, DISTANCES[metric]) for q, v in queries.items()}
    assert found == expected


def test_close_distances_far_from_the_origin(spark):
    far = [(f"v{i}", [1e6 + i * 1e-3, 1e6]) for i in range(20)]
    rows = spark.createDataFrame(far, "source_id string, embedding array<double>")
    asks = spark.createDataFrame([(1, [1e6, 1e6])], "query_id int, embedding array<double>")
    found = vector_search(rows, asks, 3).orderBy("rank").collect()
    assert [r.source_id for r in found] == ["v0", "v1", "v2"]
    assert found[1].distance == pytest.approx(1e-6, rel=1e-3)


def test_vector_search_checks_its_input(spark):
    rows = spark.createDataFrame([("a", [1.0])], "source_id string, embedding array<double>")
    asks = rows.selectExpr("1 AS query_id", "embedding")
    with pytest.raises(ValueError, match="k is below 1"):
        vector_search(rows, asks, 0)
    with pytest.raises(ValueError, match="metric"):
        vector_search(rows, asks, 1, metric="hamming")
    assert vector_search(rows.limit(0), asks).count() == 0
    assert vector_search(rows, asks.limit(0)).count() == 0


def test_filters_apply_before_ranking(spark):
    index = spark.createDataFrame(
        [
            ("a", "near", 1, date(2024, 1, 1), "Negative", "Roma", "IT", [0.0]),
            ("b", "next", 5, date(2024, 3, 1), "positive", "Roma", "it", [1.0]),
            ("c", "far", 4, None, "Positive", None, None, [2.0]),
            ("d", "bare", None, None, None, None, None, [3.0]),
        ],
        "source_id string, content string, rating int, date date, sentiment string, "
        "restaurant string, country string, embedding array<double>",
    )
    asks = spark.createDataFrame([(1, [0.0])], "query_id int, embedding array<double>")

    def ids(k=5, **bounds):
        rows = search(index, asks, k, criteria=ReviewFilter(**bounds)).orderBy("rank").collect()
        return [r.source_id for r in rows]

    assert ids() == ["a", "b", "c", "d"]
    assert ids(min_rating=4) == ["b", "c"]
    assert ids(k=1, min_rating=4) == ["b"]
    assert ids(end_date=date(2024, 2, 1)) == ["a"]
    assert ids(sentiments=["POSITIVE"]) == ["b", "c"]
    assert ids(countries=["It"], restaurants=["ROMA"]) == ["a", "b"]
    row = search(index, asks, 1).head()
    assert (row.content, row.rating, row.distance) == ("near", 1, 0.0)


def test_embedding_plug_point(spark):
    df = spark.createDataFrame([(1, "abba"), (2, "zz")], "i int, content string")
    rows = {r.i: r.embedding for r in embed(df, letter_counts).collect()}
    assert rows[1][:2] == [2.0, 2.0] and rows[2][25] == 2.0
    assert embed(df, letter_counts).filter(F.size("embedding") == 26).count() == 2


def test_bm25_refuses_missing_and_repeated_ids(spark):
    docs = spark.createDataFrame(
        [("a", "crispy crust"), ("a", "crispy"), ("b", "x")], "source_id string, content string"
    )
    with pytest.raises(ValueError, match="distinct IDs"):
        bm25_search(docs, _queries(spark, {1: "crispy"}))
    with pytest.raises(ValueError, match="distinct IDs"):
        bm25_search(docs.filter("content = 'x'").selectExpr("'' AS source_id", "content"),
                    _queries(spark, {1: "x"}))


@pytest.mark.parametrize("zeros", [1, 2, 4, 9])
def test_zero_vectors_lose_no_neighbours(spark, zeros):
    """A zero vector has the cosine distance 1, to any other."""
    rows = [(f"v{i}", [float(i + 1), 1.0]) for i in range(8)]
    rows += [(f"z{i}", [0.0, 0.0]) for i in range(zeros)]
    index = spark.createDataFrame(rows, "source_id string, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 1.0]), (2, [0.0, 0.0])],
                                  "query_id int, embedding array<double>")
    found = vector_search(index.repartition(1), asked, 3, metric="cosine").collect()
    by_query = {q: [(r.source_id, r.distance) for r in sorted(found, key=lambda r: r.rank)
                    if r.query_id == q] for q in (1, 2)}
    assert [i for i, _ in by_query[1]] == ["v0", "v1", "v2"]
    assert by_query[2] == [("v0", 1.0), ("v1", 1.0), ("v2", 1.0)]
    whole = vector_search(index, asked, 100, metric="cosine")
    assert whole.count() == 2 * len(rows)


def test_vectors_without_a_number_are_left_out(spark):
    index = spark.createDataFrame(
        [("a", [1.0, 0.0]), ("b", [float("nan"), 0.0]), ("c", [2.0, 0.0])],
        "source_id string, embedding array<double>",
    )
    asked = index.filter("source_id = 'a'").selectExpr("1 AS query_id", "embedding")
    for metric in ("l2", "cosine", "ip"):
        found = vector_search(index.repartition(1), asked, 2, metric=metric).collect()
        assert {r.source_id for r in found} == {"a", "c"}, metric


def test_filters_of_each_question(spark):
    """One search with a filter per question equals a filtered search per question."""
    from critiq.operators.vector_search import Bound

    rng = random.Random(4)
    rows = [
        (f"s{i:03d}", [rng.random() for _ in range(4)], rng.choice([None, 1, 2, 3, 4, 5]),
         rng.choice([None, date(2024, 1, 1 + i % 28)]), rng.choice([None, "Roma", "PARIS", "Straße"]))
        for i in range(200)
    ]
    index = spark.createDataFrame(
        rows, "source_id string, embedding array<double>, rating int, date date, restaurant string")
    asks = [(1, None, None, None, None), (2, 4, None, None, []), (3, 2, 3, None, ["roma"]),
            (4, None, None, date(2024, 1, 20), ["paris", "STRASSE"]), (5, 9, None, None, None),
            (6, None, 1, date(2024, 1, 5), [None])]
    wanted = [(q, [rng.random() for _ in range(4)], *rest) for q, *rest in asks]
    queries = spark.createDataFrame(
        wanted, "query_id int, embedding array<double>, low int, high int, since date, "
        "places array<string>")
    bounds = [Bound("rating", "low", "least"), Bound("rating", "high", "most"),
              Bound("date", "since", "from"), Bound("restaurant", "places", "among")]
    found = {}
    for metric in ("l2", "cosine"):
        result = vector_search(index, queries, 5, metric=metric, bounds=bounds)
        for r in sorted(result.collect(), key=lambda r: (r.query_id, r.rank)):
            found.setdefault((metric, r.query_id), []).append(r.source_id)
        for q, vector, low, high, since, places in wanted:
            kept = [
                r for r in rows
                if (low is None or (r[2] is not None and r[2] >= low))
                and (high is None or (r[2] is not None and r[2] <= high))
                and (since is None or (r[3] is not None and r[3] >= since))
                and (not places or (r[4] is not None and r[4].casefold() in
                                    {p.casefold() for p in places if p is not None}))
            ]
            alone = spark.createDataFrame(kept, index.schema)
            one = queries.filter(F.col("query_id") == q)
            want = [r.source_id for r in sorted(
                vector_search(alone, one, 5, metric=metric).collect(), key=lambda r: r.rank)]
            assert found.get((metric, q), []) == want
    shown = search(index, queries, 5, bounds=bounds).collect()
    assert {r.query_id for r in shown} == {1, 2, 3, 4}


def test_batches_are_scored_in_parts_of_bounded_tokens(spark, monkeypatch):
    """However many long documents a batch has, and with nulls and empty lists among them."""
    import pyarrow as pa

    from critiq.operators import bm25

    monkeypatch.setattr(bm25, "_TOKENS", 10)
    lists = [["a"] * n for n in (3, 0, 7, 1, 25, 10, 0)] + [None, ["b"] * 4, ["c"] * 6, ["d"]]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(len(lists))), pa.array(lists, pa.list_(pa.string()))],
        names=["id", "tokens"],
    )
    parts = list(bm25._small_parts([batch, batch.slice(4, 3), batch.slice(0, 0)]))
    assert [i for p in parts for i in p.column(0).to_pylist()] == [*range(len(lists)), 4, 5, 6]
    for part in parts:
        assert part.num_rows == 1 or len(part.column(1).flatten()) <= 10
    assert len(parts) < 10


def test_python_workers_get_few_texts_at_once(spark):
    from critiq.operators.bm25 import bm25_search
    from critiq.operators.patterns import containing

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    documents = spark.createDataFrame([("d1", "some words")], "source_id string, content string")
    asked = spark.createDataFrame([(1, "words")], "query_id long, question string")
    try:
        for use in (
            lambda: bm25_search(documents, asked),
            lambda: containing(documents, asked, id_column="source_id", text_column="content",
                               passage_column="query_id", passage_text_column="question"),
        ):
            spark.conf.set(name, "10000")
            assert use().count() == 1
            assert int(spark.conf.get(name)) <= 1000
    finally:
        spark.conf.set(name, before)
