"""Evaluation cases: rules, gold resolution, completeness of observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from critiq.functions.text import strip

# The manifest schema, its actions and the form of its hash.
MANIFEST_SCHEMA = "rag-eval-cases/2.0"
ACTIONS = ("answer", "abstain")
SHA256_FORM = "^[0-9a-f]{64}$"

BROADCAST_TITLES = 100_000


def _blank(col: Column) -> Column:
    return F.coalesce(strip(col) == "", F.lit(True))


def _unusable(strings: Column) -> Column:
    """Not an array, or an array with a blank or null in it."""
    return strings.isNull() | F.exists(strings, _blank)


def case_violations(cases: DataFrame) -> DataFrame:
    """``id, rule``: every case that breaks a rule, once per rule.

    Columns as ``sources.cases.read_cases`` gives them; ``mistyped`` is optional.
    """
    gold, labels, facts = (
        F.col("gold_source_ids"), F.col("source_labels"), F.col("reference_facts")
    )
    abstain = F.col("expected_action") == "abstain"
    answer = F.col("expected_action") == "answer"
    bad_lists = _unusable(gold) | _unusable(labels) | facts.isNull() | F.exists(
        facts, lambda f: _unusable(f["answer_terms"]) | _unusable(f["source_terms"])
    )
    if "mistyped" in cases.columns:
        bad_lists = bad_lists | (F.size("mistyped") > 0)
    rules = {
        "expected_action": ~F.coalesce(F.col("expected_action").isin(*ACTIONS), F.lit(False)),
        "string_arrays": bad_lists,
        "id_and_question": _blank(F.col("id")) | _blank(F.col("question")),
        "category_split_difficulty": _blank(F.col("category"))
        | _blank(F.col("split"))
        | _blank(F.col("difficulty")),
        "gold_distinct": F.size(F.array_distinct(F.transform(gold, strip))) < F.size(gold),
        "abstain_has_no_gold": abstain
        & ((F.size(gold) > 0) | (F.size(labels) > 0) | (F.size(facts) > 0)),
        "label_per_gold": F.size(gold) != F.size(labels),
        "fact_terms": F.exists(
            facts, lambda f: (F.size(f["answer_terms"]) == 0) | (F.size(f["source_terms"]) == 0)
        ),
        "answer_has_gold": answer & (F.size(gold) == 0),
        "answer_has_fact": answer & (F.size(facts) == 0),
    }
    broken = F.filter(
        F.array(*[F.when(failed, F.lit(name)) for name, failed in rules.items()]),
        lambda rule: rule.isNotNull(),
    )
    case_id = strip(F.col("id")).alias("id")
    per_row = cases.select(case_id, F.explode(broken).alias("rule"))
    repeated = (
        cases.groupBy(case_id)
        .agg(F.count("*").alias("n"))
        .filter("n > 1")
        .select("id", F.lit("id_unique").alias("rule"))
    )
    return per_row.unionByName(repeated)


def manifest_violations(manifest: DataFrame, dataset: DataFrame | None = None) -> DataFrame:
    """Rules of the manifest head, and of the dataset file where it is given.

    ``manifest`` is one row (``schema_version, case_count, sha256, row_count``,
    ``has_dataset``); ``dataset`` is one row (``sha256, row_count``).
    """
    row_count = F.col("row_count").try_cast("bigint")
    rules = {
        "schema_version": ~F.coalesce(F.col("schema_version") == MANIFEST_SCHEMA, F.lit(False)),
        "has_cases": ~F.coalesce(F.col("case_count") > 0, F.lit(False)),
        "has_dataset": ~F.col("has_dataset"),
        "sha256_form": ~F.coalesce(F.col("sha256").rlike(SHA256_FORM), F.lit(False)),
        "row_count_positive": ~F.coalesce(row_count >= 1, F.lit(False)),
    }
    if dataset is not None:
        facts = dataset.select(F.struct("sha256", "row_count")).scalar()
        manifest = manifest.withColumn("actual", facts)
        rules["sha256_equal"] = F.col("sha256") != F.col("actual.sha256")
        rules["row_count_equal"] = row_count != F.col("actual.row_count")
    named = F.array(*[F.when(failed, F.lit(name)) for name, failed in rules.items()])
    return manifest.select(F.explode(F.filter(named, lambda r: r.isNotNull())).alias("rule"))


def _declared(cases: DataFrame, column: str, case_column: str) -> DataFrame:
    return cases.select(
        F.col(case_column).alias("case_id"), F.explode(column).alias("wanted")
    )


def _by_title(cases: DataFrame) -> DataFrame:
    return cases.filter(F.coalesce(F.size("gold_source_ids"), F.lit(0)) <= 0)


def resolve_gold(cases: DataFrame, documents: DataFrame, case_column: str = "id") -> DataFrame:
    """``case_id, source_id``: declared IDs, else every ID under a declared title.

    Kept as rows, as a title may belong to any number of documents.
    """
    by_id = _declared(cases, "gold_source_ids", case_column).select(
        "case_id", F.col("wanted").alias("source_id")
    )
    titles = documents.filter(F.col("title").isNotNull()).select(
        F.col("title").alias("wanted"), "source_id"
    )
    declared = _declared(_by_title(cases), "source_labels", case_column).distinct()
    if declared.limit(BROADCAST_TITLES + 1).count() <= BROADCAST_TITLES:
        # A title of very many documents then stays spread over their tasks;
        # beyond the bound, adaptive execution splits such a title's partition.
        declared = F.broadcast(declared)
    by_title = titles.join(declared, "wanted").select("case_id", "source_id")
    return by_id.unionByName(by_title).distinct()


def missing_gold(cases: DataFrame, documents: DataFrame, case_column: str = "id") -> DataFrame:
    """``case_id, kind, wanted``: declared IDs and titles the documents lack."""
    ids = documents.select(F.col("source_id").alias("wanted"))
    titles = documents.select(F.col("title").alias("wanted")).distinct()
    no_id = _declared(cases, "gold_source_ids", case_column).join(ids, "wanted", "left_anti")
    no_title = _declared(_by_title(cases), "source_labels", case_column).join(
        titles, "wanted", "left_anti"
    )
    return no_id.select("case_id", F.lit("source_id").alias("kind"), "wanted").unionByName(
        no_title.select("case_id", F.lit("title").alias("kind"), "wanted")
    )


def require_gold(cases: DataFrame, documents: DataFrame, case_column: str = "id") -> None:
    """Raise where a case declares an ID or a title that no document has."""
    lacking = missing_gold(cases, documents, case_column).limit(5).collect()
    if lacking:
        named = ", ".join(f"{r.case_id}: {r.kind} {r.wanted}" for r in lacking)
        raise ValueError(f"declared gold is not among the documents ({named})")


def incomplete_observations(
    cases: DataFrame, observations: DataFrame, case_column: str = "id"
) -> DataFrame:
    """Case IDs that are not observed exactly once, or not cases at all."""
    wanted = cases.select(
        F.col(case_column).alias("case_id"), F.lit(1).alias("c"), F.lit(0).alias("o")
    )
    seen = observations.select("case_id", F.lit(0).alias("c"), F.lit(1).alias("o"))
    return (
        wanted.unionByName(seen)
        .groupBy("case_id")
        .agg(F.sum("c").alias("cases"), F.sum("o").alias("observations"))
        .filter("cases <> 1 OR observations <> 1")
    )


def require_complete(
    cases: DataFrame, observations: DataFrame, case_column: str = "id"
) -> None:
    if not incomplete_observations(cases, observations, case_column).isEmpty():
        raise ValueError("every case needs one observation, and every observation a case")
