"""Scores of retrieval and of answers against gold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from critiq.functions.text import casefold, casefold_label

ANSWERED = ("answered", "answered_after_repair")


def _mean(value: Column) -> Column:
    """Mean that is 0.0 over nothing."""
    return F.coalesce(F.avg(value), F.lit(0.0))


def hits_per_case(gold: DataFrame, ranked: DataFrame) -> DataFrame:
    """``case_id, gold, found, best_rank`` for every case that has gold.

    Joined on (case, source), so that a case with very much gold spreads over
    tasks; counts per case are then summed map-side.
    """
    places = ranked.groupBy("case_id", "source_id").agg(F.min("rank").alias("rank"))
    return (
        gold.join(places, ["case_id", "source_id"], "left")
        .groupBy("case_id")
        .agg(
            F.count("*").alias("gold"),
            F.count("rank").alias("found"),
            F.min("rank").alias("best_rank"),
        )
    )


def retrieval_metrics(gold: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
    """One row of recall, hit rate and mean reciprocal rank over the first ``k``.

    ``gold`` is distinct (``case_id, source_id``), ``ranked`` has a ``rank``
    from 1. Cases without gold do not count.
    """
    if k < 1:
        raise ValueError("k is below 1")
    cases = hits_per_case(gold, ranked.filter(F.col("rank") <= k))
    return cases.agg(
        _mean(F.col("found") / F.col("gold")).alias("recall_at_k"),
        _mean((F.col("found") > 0).cast("double")).alias("hit_rate_at_k"),
        _mean(F.coalesce(1.0 / F.col("best_rank"), F.lit(0.0))).alias("mrr_at_k"),
        F.count("*").alias("evaluated_case_count"),
        F.lit(k).alias("limit"),
    )


def observed_ranking(observed: DataFrame) -> DataFrame:
    """``case_id, source_id, rank`` of what observations say was retrieved."""
    return observed.select(
        "case_id", F.posexplode("retrieved_source_ids").alias("place", "source_id")
    ).select("case_id", "source_id", (F.col("place") + 1).alias("rank"))


def retrieval_from_observations(gold: DataFrame, observed: DataFrame, k: int) -> DataFrame:
    """Retrieval metrics of a run from its own observations, without a second search."""
    return retrieval_metrics(gold, observed_ranking(observed), k)


def compare_retrievers(gold: DataFrame, rankings: dict[str, DataFrame], k: int) -> DataFrame:
    """Retrieval metrics per named ranking, over the same cases."""
    rows = [
        retrieval_metrics(gold, ranked, k).select(F.lit(name).alias("retriever"), "*")
        for name, ranked in rankings.items()
    ]
    result = rows[0]
    for row in rows[1:]:
        result = result.unionByName(row)
    return result


def outcome() -> Column:
    """Outcome of a final answer row."""
    first, last = F.col("initial_failure_reason"), F.col("failure_reason")
    clean = F.lit("clean_abstention")
    abstention = (
        F.when(~F.col("repair_attempted"), "model_abstention")
        .when(first.eqNullSafe(clean) & last.eqNullSafe(clean),
              "model_abstention_confirmed_after_repair")
        .when(first.eqNullSafe(clean), "model_abstention_preserved_after_failed_repair")
        .otherwise("model_abstention_after_repair")
    )
    rejection = F.when(
        F.col("repair_attempted"), "citation_validation_rejection_after_repair"
    ).otherwise("citation_validation_rejection")
    return (
        F.when(last.eqNullSafe("retrieved_source_missing_id"), "retrieved_source_missing_id")
        .when(F.size("retrieved_source_ids") == 0, "empty_retrieval")
        .when(F.col("abstained"), abstention)
        .when(F.size("cited") == 0, rejection)
        .when(F.col("repair_attempted"), "answered_after_repair")
        .otherwise("answered")
    )


def observations(answers: DataFrame, query_column: str = "query_id") -> DataFrame:
    """Observation per final answer; a ``latency_ms`` column is carried along."""
    latency = (
        F.col("latency_ms") if "latency_ms" in answers.columns else F.lit(None)
    ).cast("double")
    return answers.select(
        F.col(query_column).alias("case_id"),
        "retrieved_source_ids",
        F.transform("cited", lambda c: c["source_id"]).alias("cited_source_ids"),
        F.array_join(F.transform("cited", lambda c: c["content"]), "\n").alias("cited_text"),
        "answer",
        "abstained",
        outcome().alias("outcome"),
        latency.alias("latency_ms"),
        "raw_response",
        "repair_response",
        "initial_failure_reason",
        "failure_reason",
        "repair_attempted",
    )


def support_per_case(cases: DataFrame, observed: DataFrame, case_column: str = "id") -> DataFrame:
    """``case_id, support``: share of a case's facts found in answer and sources."""
    joined = cases.select(
        F.col(case_column).alias("case_id"), "expected_action", "reference_facts"
    ).join(
        observed.select(
            "case_id",
            "abstained",
            "cited_source_ids",
            casefold(F.col("answer")).alias("_answer"),
            casefold(F.col("cited_text")).alias("_sources"),
        ),
        "case_id",
    )
    return joined.select("case_id", _support().alias("support"))


def _support() -> Column:
    """Needs ``expected_action, reference_facts, abstained, cited_source_ids`` and
    the folded ``_answer`` and ``_sources``."""

    def any_in(terms: Column, text: Column) -> Column:
        return F.exists(terms, lambda t: F.contains(text, casefold_label(t)))

    supported = F.filter(
        F.col("reference_facts"),
        lambda fact: any_in(fact["answer_terms"], F.col("_answer"))
        & any_in(fact["source_terms"], F.col("_sources")),
    )
    facts = F.size("reference_facts")
    kept_silent = F.col("abstained") & (F.size("cited_source_ids") == 0)
    return (
        F.when(F.col("expected_action") == "abstain", kept_silent.cast("double"))
        .when(facts == 0, F.lit(1.0))
        .otherwise(F.size(supported) / facts)
    )


def answer_metrics(
    cases: DataFrame, observed: DataFrame, gold: DataFrame, case_column: str = "id"
) -> DataFrame:
    """One row of answer scores; no case at all is an error.

    Every case needs exactly one observation (``cases.require_complete``). The
    observations are read twice: pass a written table where they cost much.
    """
    joined = cases.select(
        F.col(case_column).alias("case_id"), "expected_action", "reference_facts"
    ).join(
        observed.select(
            "case_id",
            "retrieved_source_ids",
            "cited_source_ids",
            "abstained",
            "outcome",
            casefold(F.col("answer")).alias("_answer"),
            casefold(F.col("cited_text")).alias("_sources"),
        ),
        "case_id",
    )
    retrieved = observed.select(
        "case_id", F.posexplode("retrieved_source_ids").alias("rank", "source_id")
    )
    recall = hits_per_case(gold, retrieved).agg(_mean(F.col("found") / F.col("gold"))).scalar()

    cited = F.col("cited_source_ids")
    silent = (F.col("abstained") & (F.size(cited) == 0)).cast("double")
    success = (
        F.col("outcome").isin(*ANSWERED)
        | ((F.col("outcome") == "unknown") & ~F.col("abstained") & (F.size(cited) > 0))
    ).cast("double")
    uncovered = F.size(F.array_except(cited, F.col("retrieved_source_ids")))
    valid = ((F.size(cited) > 0) & (uncovered == 0)).cast("double")
    abstain = F.col("expected_action") == "abstain"

    per_case = joined.select(
        abstain.alias("abstain"),
        silent.alias("silent"),
        success.alias("success"),
        valid.alias("valid"),
        _support().alias("support"),
    )
    answerable = ~F.col("abstain")
    no_case = F.raise_error(F.lit("there is no case to score")).cast("double")
    scores = per_case.agg(
        F.when(F.count("*") == 0, no_case)
        .otherwise(_mean(F.when(answerable, F.col("valid"))))
        .alias("citation_validity"),
        _mean(F.when(answerable, F.col("support"))).alias("reference_term_support_proxy"),
        _mean(
            F.when(F.col("abstain"), F.col("silent")).otherwise(F.col("success"))
        ).alias("expected_action_accuracy"),
        _mean(F.when(answerable, F.col("success"))).alias("answer_success_rate"),
        _mean(F.when(F.col("abstain"), F.col("silent"))).alias("abstention_recall"),
        F.count("*").alias("case_count"),
        F.count_if(answerable).alias("answerable_case_count"),
        F.count_if(F.col("abstain")).alias("abstention_case_count"),
    )
    return scores.select(recall.alias("retrieval_recall"), "*")
