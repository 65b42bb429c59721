"""Whole evaluations: retrieval by keyword, and answers by a model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from critiq.functions.plugins import EmbedFunction, ModelFunction, embed
from critiq.operators.answers import answer_queries
from critiq.operators.bm25 import bm25_search
from critiq.operators.cases import require_complete, require_gold, resolve_gold
from critiq.operators.metrics import answer_metrics, observations, retrieval_metrics
from critiq.operators.vector_search import Bound, search
from critiq.session import materialize


def evaluate_bm25(
    cases: DataFrame, documents: DataFrame, k: int = 5
) -> tuple[DataFrame, DataFrame]:
    """Retrieval metrics of BM25 on the case questions, and its ranking.

    Gold that is declared but not among the documents is an error.
    """
    require_gold(cases, documents)
    ranked = bm25_search(documents, cases, k, query_column="id").withColumnRenamed("id", "case_id")
    return retrieval_metrics(resolve_gold(cases, documents), ranked, k), ranked


def retrieval_observations(cases: DataFrame, ranked: DataFrame) -> DataFrame:
    """Observations of a retriever alone, with outcome ``retrieval_only``."""
    found = ranked.groupBy("case_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "source_id"))).alias("found")
    )
    nothing = F.array().cast("array<string>")
    ids = F.transform("found", lambda f: f["source_id"])
    return (
        cases.select(F.col("id").alias("case_id"))
        .join(found, "case_id", "left")
        .select(
            "case_id",
            F.coalesce(ids, nothing).alias("retrieved_source_ids"),
            nothing.alias("cited_source_ids"),
            F.lit("").alias("cited_text"),
            F.lit("").alias("answer"),
            F.lit(False).alias("abstained"),
            F.lit("retrieval_only").alias("outcome"),
            F.lit(None).cast("double").alias("latency_ms"),
            F.lit("").alias("raw_response"),
            F.lit(None).cast("string").alias("repair_response"),
            F.lit(None).cast("string").alias("initial_failure_reason"),
            F.lit(None).cast("string").alias("failure_reason"),
            F.lit(False).alias("repair_attempted"),
        )
    )


def evaluate_answers(
    cases: DataFrame,
    index: DataFrame,
    embed_fn: EmbedFunction,
    model: ModelFunction,
    k: int = 5,
    bounds: Sequence[Bound] = (),
) -> tuple[DataFrame, DataFrame]:
    """Answer metrics of semantic retrieval with a model, and the observations.

    Gold that is declared but not in the index is an error. ``bounds`` name filter
    columns of ``cases``.
    """
    require_gold(cases, index)
    limits = sorted({b.limit for b in bounds})
    asked = cases.select(F.col("id").alias("query_id"), "question", *limits)
    queries = materialize(embed(asked, embed_fn, "question"))
    matches = search(index, queries, k, bounds=bounds)
    observed = materialize(
        observations(answer_queries(queries.select("query_id", "question"), matches, model))
    )
    require_complete(cases, observed)
    return answer_metrics(cases, observed, resolve_gold(cases, index)), observed
