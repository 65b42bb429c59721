import random
import re

import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from critiq.operators import answers as A
from critiq.operators.metrics import observations

TOKEN = A.ABSTAIN_TOKEN


@pytest.fixture
def matches(spark):
    return spark.createDataFrame(
        [
            (1, 1, "review-a", 0.08, 5, None, "Good", "Roma", "IT", "The crust was crispy."),
            (1, 2, "review-b", 0.1, None, None, None, None, None, "The crust was thin."),
        ],
        "query_id int, rank int, source_id string, distance double, rating int, date date, "
        "sentiment string, restaurant string, country string, content string",
    )


@pytest.fixture
def judge(spark, matches):
    def run(*responses):
        evidence = A.collect_evidence(matches).select("evidence")
        rows = spark.createDataFrame(list(enumerate(responses)), "i int, response string")
        judged = A.validate_answers(rows.join(evidence, how="cross"))
        found = judged.orderBy("i").select("verdict.*").collect()
        return [
            (r.reason, r.answer, [(c.citation_number, c.source_id) for c in r.cited])
            for r in found
        ]

    return run


def test_verdicts(judge):
    a, b = (1, "review-a"), (2, "review-b")
    cases = {
        "Thin [2]; crispy [1].": (None, "Thin [1]; crispy [2].", [(1, "review-b"), (2, "review-a")]),
        "Crispy [review-a] and [1], thin [review-b].": (
            None, "Crispy [1] and [1], thin [2].", [a, b]
        ),
        " Fine [1]. \n": (None, "Fine [1].", [a]),
        "Plain.": ("missing_citations", None, []),
        "Odd [-1] [] [a b].": ("missing_citations", None, []),
        "Far [3].": ("out_of_range_citation", None, []),
        "Zero [0].": ("out_of_range_citation", None, []),
        "Padded [01].": ("out_of_range_citation", None, []),
        "Huge [99999999999999999999].": ("out_of_range_citation", None, []),
        "Else [review-x] [9].": ("unknown_citation", None, []),
        "Else [9] [review-x].": ("out_of_range_citation", None, []),
        f"\n {TOKEN} \n": ("clean_abstention", None, []),
        f"Crispy [1].\n{TOKEN}": (None, "Crispy [1].", [a]),
        f"{TOKEN}\r\nCrispy [1].\x85Thin [2].": (None, "Crispy [1].\nThin [2].", [a, b]),
        f"Note {TOKEN} [1].": ("embedded_control_token", None, []),
        f"{TOKEN}\n {TOKEN} \n{TOKEN}": ("invalid_remainder", None, []),
        "": ("invalid_remainder", None, []),
        "Costs $1 \\ [1]": (None, "Costs $1 \\ [1]", [a]),
    }
    assert dict(zip(cases, judge(*cases))) == cases


def _judge_plain(response, ids):
    text = response.strip()
    if text == TOKEN:
        return "clean_abstention", None
    if TOKEN in text:
        kept = [line for line in text.splitlines() if line.strip() != TOKEN]
        if any(TOKEN in line for line in kept):
            return "embedded_control_token", None
        text = "\n".join(kept).strip()
    if not text:
        return "invalid_remainder", None
    pattern = re.compile(r"\[([A-Za-z0-9][A-Za-z0-9_-]*)\]")
    known = {str(n): i for n, i in enumerate(ids, 1)}
    order = []
    marks = pattern.findall(text)
    if not marks:
        return "missing_citations", None
    for mark in marks:
        target = known.get(mark, mark)
        if target not in ids:
            return ("out_of_range_citation" if mark.isdigit() else "unknown_citation"), None
        if target not in order:
            order.append(target)
    place = {i: n for n, i in enumerate(order, 1)}
    return None, pattern.sub(lambda m: f"[{place[known.get(m[1], m[1])]}]", text)


def test_random_responses_against_plain_python(judge):
    rng = random.Random(11)
    parts = [
        "[1]", "[2]", "[3]", "[01]", "[review-a]", "[review-b]", "[x]", "[", "]", "word", " ",
        "\n", "\r\n", "\x1c", "\x1f", " ", TOKEN, f"\n{TOKEN}\n", "[[1]]", "$1", "\\",
    ]
    responses = ["".join(rng.choices(parts, k=rng.randint(1, 7))) for _ in range(800)]
    got = [(reason, answer) for reason, answer, _ in judge(*responses)]
    assert got == [_judge_plain(r, ["review-a", "review-b"]) for r in responses]


def test_context_prompt_and_label(spark, matches):
    text = A.assemble_context(matches).head().context
    assert text == (
        "[1]\nSource ID: review-a\nRating: 5/5\nSentiment: Good\nRestaurant: Roma\nCountry: IT\n"
        "The crust was crispy.\n\n[2]\nSource ID: review-b\nThe crust was thin."
    )
    prompt = spark.range(1).select(A.prompt_text(F.lit("  Crisp {x}? "), F.lit(text))).head()[0]
    assert "\nCrisp {x}?\n" in prompt and text in prompt and "only the supplied reviews" in prompt
    repair = spark.range(1).select(A.prompt_text(F.lit("Q"), F.lit(""), repair=True)).head()[0]
    assert "could not be accepted" in repair and "at least one supplied review" in repair
    labels = matches.orderBy("rank").select(A.evidence_labels(matches)).collect()
    assert labels[0][0] == "[1] · Roma · IT · Good · 5/5 · distance 0.080"
    assert labels[1][0] == "[2] · distance 0.100"
    with pytest.raises(PySparkException, match="needs a question"):
        spark.range(1).select(A.prompt_text(F.lit(" \n"), F.lit(""))).collect()
    with pytest.raises(PySparkException, match="no source ID"):
        A.assemble_context(matches.withColumn("source_id", F.lit(""))).collect()


# first response, second response -> answer kind, abstained, first reason, last reason, outcome
STATES = [
    ("Fine [2].", "unused", "Fine [1].", False, None, None, "answered"),
    (TOKEN, "Now [1].", "Now [1].", False, "clean_abstention", None, "answered_after_repair"),
    ("Far [9].", "Now [1].", "Now [1].", False, "out_of_range_citation", None,
     "answered_after_repair"),
    (TOKEN, TOKEN, A.NO_MATCH_TEXT, True, "clean_abstention", "clean_abstention",
     "model_abstention_confirmed_after_repair"),
    (TOKEN, "Bad [9].", A.NO_MATCH_TEXT, True, "clean_abstention", "out_of_range_citation",
     "model_abstention_preserved_after_failed_repair"),
    ("Plain.", TOKEN, A.NO_MATCH_TEXT, True, "missing_citations", "clean_abstention",
     "model_abstention_after_repair"),
    ("Plain.", "Still plain.", A.REJECTION_TEXT, False, "missing_citations", "missing_citations",
     "citation_validation_rejection_after_repair"),
    (f"Note {TOKEN} [1].", "unused", A.REJECTION_TEXT, False, None, "embedded_control_token",
     "citation_validation_rejection"),
    (f"{TOKEN}\n{TOKEN}", "unused", A.REJECTION_TEXT, False, None, "invalid_remainder",
     "citation_validation_rejection"),
]


def _many(spark, matches):
    """The two matches for every state, and two questions with none or no ID."""
    ids = spark.range(len(STATES)).withColumnRenamed("id", "q")
    rows = matches.drop("query_id").join(ids, how="cross").withColumnRenamed("q", "query_id")
    lost = matches.filter("rank = 1").withColumn("query_id", F.lit(101).cast("bigint"))
    return rows.unionByName(lost.withColumn("source_id", F.lit(None).cast("string")))


def test_answer_flow_calls_the_model_once_per_round(spark, matches):
    first = {f"question {i}": s[0] for i, s in enumerate(STATES)}
    second = {f"question {i}": s[1] for i, s in enumerate(STATES)}

    def model(prompts: pd.Series):
        out = []
        for prompt in prompts:
            question = prompt.split("Question:\n")[1].split("\n")[0]
            out.append((second if "could not be accepted" in prompt else first)[question])
        return out

    asked = [(i, f"question {i}") for i in [*range(len(STATES)), 100, 101]]
    questions = spark.createDataFrame(asked, "query_id bigint, question string")
    final = A.answer_queries(questions, _many(spark, matches), model)
    seen = {r.case_id: r for r in observations(final).collect()}
    for i, (raw, repair, answer, abstained, initial, last, outcome) in enumerate(STATES):
        row = seen[i]
        assert (row.answer, row.abstained, row.outcome) == (answer, abstained, outcome), i
        assert (row.initial_failure_reason, row.failure_reason) == (initial, last)
        assert row.raw_response == raw and row.repair_attempted == (initial is not None)
        assert row.repair_response == (repair if initial else None)
        assert row.retrieved_source_ids == ["review-a", "review-b"]
    assert seen[0].cited_source_ids == ["review-b"]
    assert seen[0].cited_text == "The crust was thin."
    assert (seen[100].answer, seen[100].outcome) == (A.NO_MATCH_TEXT, "empty_retrieval")
    assert seen[100].failure_reason == "empty_retrieval" and not seen[100].abstained
    assert (seen[101].answer, seen[101].outcome) == (
        A.REJECTION_TEXT, "retrieved_source_missing_id"
    )
    assert seen[101].retrieved_source_ids == [] and seen[101].raw_response == ""


def test_single_round_tables(spark, matches):
    """Without repair responses an abstention is the model's, and a null response is a reason."""
    evidence = A.collect_evidence(matches).select("evidence")
    said = [(1, "INSUFFICIENT_EVIDENCE", None), (2, None, None), (3, "Crispy [1].", None),
            (4, "Crispy.", None), (5, None, "Fixed [1]."), (6, "Crispy.", "Fixed [1].")]
    rows = spark.createDataFrame(said, "query_id int, response string, repair_response string")
    final = A.final_answers(rows.join(evidence, how="cross"))
    got = {r.case_id: r for r in observations(final).collect()}
    assert {i: r.outcome for i, r in got.items()} == {
        1: "model_abstention", 2: "citation_validation_rejection", 3: "answered",
        4: "citation_validation_rejection", 5: "citation_validation_rejection",
        6: "answered_after_repair",
    }
    assert all(r.answer for r in got.values())
    assert got[2].failure_reason == got[5].failure_reason == "missing_response"
    assert got[1].abstained and got[1].answer == A.NO_MATCH_TEXT
    assert [i for i, r in got.items() if r.repair_attempted] == [6]
