import json
from hashlib import sha256

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from critiq.operators import cases as C
from critiq.operators import metrics as M
from critiq.operators import report as R
from critiq.operators.evaluate import evaluate_answers, evaluate_bm25, retrieval_observations
from critiq.plans.tables import letter_counts
from critiq.functions.plugins import embed
from critiq.sources.cases import read_cases, read_manifest
from critiq.sources.registry import file_facts
from critiq.sources.report import write_report

FACTS = "array<struct<answer_terms:array<string>,source_terms:array<string>>>"


def _case(**changes):
    case = {
        "id": "one", "split": "test", "category": "taste", "difficulty": "easy",
        "question": "Is it crisp?", "expected_action": "answer", "gold_source_ids": ["a"],
        "source_labels": ["A"],
        "reference_facts": [{"answer_terms": ["crisp"], "source_terms": ["crispy"]}],
    }
    case.update(changes)
    return {k: v for k, v in case.items() if v is not ...}


def _write(tmp_path, case_list, **head):
    manifest = {
        "schema_version": C.MANIFEST_SCHEMA, "evaluation_set_id": "t",
        "dataset": {"file": "r.csv", "sha256": "0" * 64, "row_count": 2}, "cases": case_list,
    }
    manifest.update(head)
    path = tmp_path / "cases.json"
    path.write_text(json.dumps(manifest, indent=1))
    return str(path)


def _rules(spark, tmp_path, case, more=()):
    path = _write(tmp_path, [case, *more])
    return {r.rule for r in C.case_violations(read_cases(spark, path)).collect()}


@pytest.mark.parametrize(
    "changes, rule",
    [
        ({}, None),
        ({"expected_action": "guess"}, "expected_action"),
        ({"expected_action": ...}, "expected_action"),
        ({"gold_source_ids": ["a", " "]}, "string_arrays"),
        ({"gold_source_ids": [1]}, "string_arrays"),
        ({"gold_source_ids": "a"}, "string_arrays"),
        ({"source_labels": ...}, "string_arrays"),
        ({"reference_facts": ["x"]}, "string_arrays"),
        ({"reference_facts": [{"answer_terms": ["a"], "source_terms": [2]}]}, "string_arrays"),
        ({"id": " "}, "id_and_question"),
        ({"question": ...}, "id_and_question"),
        ({"split": ""}, "category_split_difficulty"),
        ({"gold_source_ids": ["a", " a"], "source_labels": ["A", "B"]}, "gold_distinct"),
        ({"expected_action": "abstain"}, "abstain_has_no_gold"),
        ({"source_labels": ["A", "B"]}, "label_per_gold"),
        ({"reference_facts": [{"answer_terms": [], "source_terms": ["b"]}]}, "fact_terms"),
        ({"gold_source_ids": [], "source_labels": []}, "answer_has_gold"),
        ({"reference_facts": []}, "answer_has_fact"),
    ],
)
def test_case_rules(spark, tmp_path, changes, rule):
    found = _rules(spark, tmp_path, _case(**changes))
    assert found == set() if rule is None else rule in found


def test_case_ids_are_unique(spark, tmp_path):
    assert _rules(spark, tmp_path, _case(), [_case(id="one ")]) == {"id_unique"}


def test_manifest_rules(spark, tmp_path):
    def rules(dataset=None, **head):
        manifest = read_manifest(spark, _write(tmp_path, [_case()], **head))
        return {r.rule for r in C.manifest_violations(manifest, dataset).collect()}

    assert rules() == set()
    assert rules(schema_version="1") == {"schema_version"}
    assert rules(cases=[]) == {"has_cases"}
    manifest = read_manifest(spark, _write(tmp_path, [_case()], **{"dataset": []}))
    assert {r.rule for r in C.manifest_violations(manifest).collect()} == {
        "has_dataset", "sha256_form", "row_count_positive"
    }
    bad = {"sha256": "A" * 64, "row_count": "2"}
    manifest = read_manifest(spark, _write(tmp_path, [_case()], **{"dataset": bad}))
    assert {r.rule for r in C.manifest_violations(manifest).collect()} == {
        "sha256_form", "row_count_positive"
    }
    content = 'Review,Note\n"a\nb",1\nc,2\n'
    (tmp_path / "r.csv").write_text(content)
    facts = file_facts(spark, str(tmp_path / "r.csv"))
    assert tuple(facts.head()) == (sha256(content.encode()).hexdigest(), 2)
    assert rules(facts) == {"sha256_equal"}
    good = {"sha256": sha256(content.encode()).hexdigest(), "row_count": 2}
    manifest = read_manifest(spark, _write(tmp_path, [_case()], **{"dataset": good}))
    assert C.manifest_violations(manifest, facts).count() == 0
    wrong = {**good, "row_count": 3}
    manifest = read_manifest(spark, _write(tmp_path, [_case()], **{"dataset": wrong}))
    assert [r.rule for r in C.manifest_violations(manifest, facts).collect()] == ["row_count_equal"]


def test_gold_by_id_or_by_title(spark):
    cases = spark.createDataFrame(
        [("ids", ["a", "zz"], ["T"]), ("titles", [], ["T", "U", "T"])],
        "id string, gold_source_ids array<string>, source_labels array<string>",
    )
    docs = spark.createDataFrame(
        [("a", "T"), ("b", "T"), ("c", None)], "source_id string, title string"
    )
    gold = {(r.case_id, r.source_id) for r in C.resolve_gold(cases, docs).collect()}
    assert gold == {("ids", "a"), ("ids", "zz"), ("titles", "a"), ("titles", "b")}
    missing = {tuple(r) for r in C.missing_gold(cases, docs).collect()}
    assert missing == {("ids", "source_id", "zz"), ("titles", "title", "U")}


def test_retrieval_metrics(spark):
    gold = spark.createDataFrame(
        [("first", "a"), ("second", "b"), ("second", "c")], "case_id string, source_id string"
    )
    ranked = spark.createDataFrame(
        [("first", "x", 1), ("first", "a", 2), ("second", "b", 1), ("second", "x", 2),
         ("second", "c", 3), ("abstain", "x", 1)],
        "case_id string, source_id string, rank int",
    )
    row = M.retrieval_metrics(gold, ranked, 2).head()
    assert tuple(row) == (0.75, 1.0, 0.75, 2, 2)
    nothing = M.retrieval_metrics(gold.limit(0), ranked, 2).head()
    assert tuple(nothing) == (0.0, 0.0, 0.0, 0, 2)
    with pytest.raises(ValueError, match="k is below 1"):
        M.retrieval_metrics(gold, ranked, 0)


def test_every_case_is_observed_once(spark):
    cases = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    seen = spark.createDataFrame([("a",), ("b",), ("b",), ("d",)], "case_id string")
    found = {tuple(r) for r in C.incomplete_observations(cases, seen).collect()}
    assert found == {("b", 1, 2), ("c", 1, 0), ("d", 0, 1)}
    with pytest.raises(ValueError, match="needs one observation"):
        C.require_complete(cases, seen)
    C.require_complete(cases, cases.withColumnRenamed("id", "case_id"))


def _scored(spark, observed, facts=None):
    answerable = facts or [(["CRISPY", "Straße"], ["perfectly crispy"]), (["thin"], ["thin"])]
    cases = spark.createDataFrame(
        [("answer", "answer", answerable, "taste"), ("abstain", "abstain", [], "none")],
        f"id string, expected_action string, reference_facts {FACTS}, category string",
    )
    rows = spark.createDataFrame(
        observed,
        "case_id string, retrieved_source_ids array<string>, cited_source_ids array<string>, "
        "cited_text string, answer string, abstained boolean, outcome string",
    )
    gold = spark.createDataFrame([("answer", "a"), ("answer", "z")],
                                 "case_id string, source_id string")
    return cases, rows, M.answer_metrics(cases, rows, gold).head().asDict()


def test_answer_metrics(spark):
    silent = ("abstain", ["b"], [], "", "no", True, "unknown")
    _, _, scores = _scored(
        spark,
        [("answer", ["a", "b"], ["a"], "Perfectly CRISPY.", "In der STRASSE [1].", False,
          "answered"), silent],
    )
    assert scores == {
        "retrieval_recall": 0.5, "citation_validity": 1.0, "reference_term_support_proxy": 0.5,
        "expected_action_accuracy": 1.0, "answer_success_rate": 1.0, "abstention_recall": 1.0,
        "case_count": 2, "answerable_case_count": 1, "abstention_case_count": 1,
    }
    _, _, scores = _scored(
        spark,
        [("answer", ["a"], ["q"], "", "", False, "citation_validation_rejection"),
         ("abstain", ["b"], ["b"], "", "", True, "answered")],
    )
    assert scores["citation_validity"] == scores["answer_success_rate"] == 0.0
    assert scores["abstention_recall"] == scores["expected_action_accuracy"] == 0.0
    for abstained, cited, expected in ((False, ["a"], 1.0), (True, ["a"], 0.0), (False, [], 0.0)):
        row = ("answer", ["a"], cited, "", "", abstained, "unknown")
        assert _scored(spark, [row, silent])[2]["answer_success_rate"] == expected


def test_no_case_is_an_error(spark):
    cases = spark.createDataFrame([], f"id string, expected_action string, reference_facts {FACTS}")
    rows = spark.createDataFrame(
        [],
        "case_id string, retrieved_source_ids array<string>, cited_source_ids array<string>, "
        "cited_text string, answer string, abstained boolean, outcome string",
    )
    gold = spark.createDataFrame([], "case_id string, source_id string")
    with pytest.raises(PySparkException, match="no case to score"):
        M.answer_metrics(cases, rows, gold).collect()


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 999, 1000, 5001])
def test_exact_median(spark, n):
    from statistics import median

    values = [float((i * 7919) % 1009) for i in range(n)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
    assert R.exact_median(df, "v").head()[0] == (median(values) if values else None)


@pytest.mark.parametrize("n", [30_000, 30_001])
def test_median_by_several_brackets(spark, monkeypatch, n):
    monkeypatch.setattr(R, "MEDIAN_ROWS", 10)
    df = spark.range(n).selectExpr("CAST((id * 7919) % 1000003 AS DOUBLE) * id AS v").repartition(4)
    values = sorted(float((i * 7919) % 1000003) * i for i in range(n))
    want = (values[(n - 1) // 2] + values[n // 2]) / 2
    assert R.exact_median(df, "v").head()[0] == want


def test_median_of_copies(spark):
    df = spark.range(9000).selectExpr("CASE WHEN id % 3 = 0 THEN id ELSE 5 END AS v")
    assert R.exact_median(df, "v").head()[0] == 5.0


def test_whole_evaluation_and_report(spark, tmp_path):
    index = embed(
        spark.createDataFrame(
            [("a", "A", "Crispy crust aaa"), ("b", "B", "Thin base bbb"), ("c", "B", "Cold ccc")],
            "source_id string, title string, content string",
        ),
        letter_counts,
    )
    path = _write(
        tmp_path,
        [
            _case(id="x", question="crispy crust aaa?", source_labels=["A"]),
            _case(id="y", question="thin base", gold_source_ids=["b", "c"],
                  source_labels=["B", "B"], category="base"),
            _case(id="z", question="zzz qqq", expected_action="abstain", gold_source_ids=[],
                  source_labels=[], reference_facts=[], category="none"),
        ],
    )
    cases = read_cases(spark, path)
    assert C.case_violations(cases).count() == 0

    def model(prompts):
        return [
            "INSUFFICIENT_EVIDENCE" if "zzz" in p else "Crisp and crispy [1]." for p in prompts
        ]

    rag, observed = evaluate_answers(cases, index, letter_counts, model, 2)
    scores = rag.head()
    assert scores.abstention_recall == 1.0 and scores.answer_success_rate == 1.0
    assert scores.reference_term_support_proxy == 0.5
    bm25, ranked = evaluate_bm25(cases, index, 2)
    assert bm25.head().evaluated_case_count == 2 and bm25.head().recall_at_k == 0.75

    seen = {r.case_id: r for r in retrieval_observations(cases, ranked).collect()}
    assert seen["y"].retrieved_source_ids == ["b"] and seen["z"].retrieved_source_ids == []
    assert seen["x"].outcome == "retrieval_only"

    observed = observed.withColumn("latency_ms", F.lit(2.5))
    gold = C.resolve_gold(cases, index)
    report = R.build_report(
        cases, observed, rag=rag, semantic=bm25, bm25=bm25,
        configuration={"top_k": "2"}, provenance={"engine": "spark"},
    )
    rows = R.serialize_observations(observed, gold)
    assert "raw_response" not in rows.columns
    out = str(tmp_path / "report")
    write_report(report, out, observations={"rag": rows}, gold=gold,
                 counts=R.report_counts(cases, observed))
    head = json.loads(next((tmp_path / "report/head").glob("*.json")).read_text())
    assert list(head) == sorted(head) and head["schema_version"] == 3
    assert head["evaluation_set"]["case_count"] == 3
    assert head["timing"]["rag_total_latency_ms"] == 7.5
    assert head["diagnostics"]["outcomes"] == {
        "answered": 2, "model_abstention_confirmed_after_repair": 1
    }
    assert head["diagnostics"]["repair_attempt_count"] == 1
    assert head["results"]["rag"]["case_count"] == 3
    assert head["generated_at"].endswith("Z")
    lines = spark.read.json(f"{out}/observations/rag").orderBy("case_id").collect()
    assert lines[1].relevant_source_count == 2 and lines[0].latency_ms == 2.5
    raw = R.serialize_observations(observed, gold, include_raw_responses=True)
    by_case = {r.case_id: r for r in raw.collect()}
    assert by_case["z"].relevant_source_count == 0 and by_case["x"].raw_response
    assert spark.read.json(f"{out}/gold").count() == 3
    assert spark.read.json(f"{out}/counts").filter("kind = 'category'").count() == 3


def test_counts_have_no_bound(spark):
    """Any number of gold pairs, categories and labels is counted."""
    cases = spark.range(1500).selectExpr("'c' || id AS category", "'answer' AS expected_action")
    observed = spark.createDataFrame(
        [("x", "answered", None, None)],
        "case_id string, outcome string, initial_failure_reason string, failure_reason string",
    )
    counts = R.report_counts(cases, observed)
    assert counts.filter("kind = 'category'").count() == 1500
    columns = ("retrieved_source_ids array<string>, cited_source_ids array<string>, answer string, "
               "abstained boolean, latency_ms double, repair_attempted boolean")
    rows = observed.select("*", *[
        F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in columns.split(", ")])
    gold = spark.range(1200).selectExpr("'x' AS case_id", "'s' || id AS source_id")
    assert R.serialize_observations(rows, gold).head().relevant_source_count == 1200


def test_evaluations_refuse_gold_that_does_not_exist(spark):
    index = embed(
        spark.createDataFrame([("a", "A", "crispy"), ("b", "B", "thin")],
                              "source_id string, title string, content string"),
        letter_counts,
    )
    schema = "id string, question string, gold_source_ids array<string>, source_labels array<string>"
    fine = ("x", "crispy?", ["a"], ["A"])
    for broken in (("y", "thin?", ["nowhere"], ["B"]), ("y", "thin?", [], ["No such title"])):
        cases = spark.createDataFrame([fine, broken], schema)
        with pytest.raises(ValueError, match="not among the documents"):
            evaluate_bm25(cases, index)
        with pytest.raises(ValueError, match="not among the documents"):
            evaluate_answers(cases, index, letter_counts, lambda p: ["x [1]."] * len(p))


def test_short_passages_are_found(spark, tmp_path):
    from critiq.plans.tables import passage_gold

    docs = [(1, "one two three four five"), (2, "ten"), (3, None), (4, "unspaced漢字text")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(
        str(tmp_path / "documents.parquet"))
    items = [(1, "two three four"), (2, "en"), (3, "漢字"), (4, "two thr"), (5, "zzz"), (6, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(
        str(tmp_path / "benchmark.parquet"))
    pairs = {tuple(r) for r in passage_gold(spark, str(tmp_path)).collect()}
    assert pairs == {(1, 1), (2, 2), (3, 4), (4, 1)}


def test_retrieval_from_observations_equals_the_ranking(spark):
    cases = spark.createDataFrame([("x",), ("y",), ("z",)], "id string")
    ranked = spark.createDataFrame(
        [("x", "a", 1), ("x", "b", 2), ("x", "c", 3), ("y", "c", 1)],
        "case_id string, source_id string, rank int")
    gold = spark.createDataFrame([("x", "b"), ("x", "c"), ("y", "d"), ("z", "a")],
                                 "case_id string, source_id string")
    observed = retrieval_observations(cases, ranked)
    for k in (1, 2, 5):
        assert (M.retrieval_from_observations(gold, observed, k).head()
                == M.retrieval_metrics(gold, ranked, k).head())
