"""Report over an evaluation: counts, timing and serialised observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from critiq.session import materialize

SCHEMA_VERSION = 3
# Share of the ranks on either side of the middle that an estimate may be off.
_MEDIAN_SLACK = 0.001
_MEDIAN_ACCURACY = 10_000
#: Distinct values of the middle that are put in order at the end.
MEDIAN_ROWS = 10_000


def report_counts(cases: DataFrame, observed: DataFrame) -> DataFrame:
    """``kind, label, n``: categories, outcomes and failure reasons."""
    kinds = (
        ("category", cases, "category"),
        ("outcome", observed, "outcome"),
        ("initial_failure_reason", observed, "initial_failure_reason"),
        ("final_failure_reason", observed, "failure_reason"),
    )
    result = None
    for kind, table, column in kinds:
        counted = (
            table.filter(F.col(column).isNotNull())
            .groupBy(F.col(column).alias("label"))
            .agg(F.count("*").alias("n"))
            .select(F.lit(kind).alias("kind"), "label", "n")
        )
        result = counted if result is None else result.unionByName(counted)
    return result


def exact_median(df: DataFrame, column: str) -> DataFrame:
    """One row ``median``; null over nothing.

    Selection by narrowing: approximate percentiles bracket the middle rank, a count tells how
    many values lie below and inside, and the next round looks inside only, a few thousandths
    of the last one's values. Rounds are plain aggregates; the last bracket is read as at most
    ``MEDIAN_ROWS`` (value, count) rows.
    """
    spark = df.sparkSession
    values = materialize(
        df.filter(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    )
    count = values.count()
    if not count:
        return spark.createDataFrame([(None,)], "median double")
    middle = [_ranked(values, rank, count) for rank in {(count + 1) // 2, count // 2 + 1}]
    return spark.createDataFrame([(sum(middle) / len(middle),)], "median double")


def _ranked(values: DataFrame, rank: int, count: int) -> float:
    """The value of a rank, from 1, of ``count`` values ``v``."""
    inside = values
    while True:
        counted = inside.groupBy("v").agg(F.count("*").alias("n"))
        if count <= MEDIAN_ROWS or len(counted.limit(MEDIAN_ROWS + 1).select("v").take(
            MEDIAN_ROWS + 1
        )) <= MEDIAN_ROWS:
            for row in sorted(counted.collect(), key=lambda r: (r["v"] != r["v"], r["v"])):
                rank -= row["n"]
                if rank <= 0:
                    return row["v"]
        share = (rank - 0.5) / count
        low, high = inside.agg(
            F.percentile_approx(
                "v",
                [max(0.0, share - _MEDIAN_SLACK), min(1.0, share + _MEDIAN_SLACK)],
                _MEDIAN_ACCURACY,
            )
        ).head()[0]
        between = inside.filter((F.col("v") >= low) & (F.col("v") <= high))
        below = inside.filter(F.col("v") < low).count()
        held = between.count()
        if not below < rank <= below + held or held == count:
            raise ArithmeticError("percentiles did not bracket the middle")
        inside, rank, count = between, rank - below, held


def latency_summary(observed: DataFrame) -> DataFrame:
    """One row of total, mean and median latency, rounded half-even to 3 digits."""

    def rounded(value: Column) -> Column:
        return F.bround(F.coalesce(value, F.lit(0.0)), 3)

    median = exact_median(observed, "latency_ms").scalar()
    return observed.agg(
        F.coalesce(F.sum("latency_ms"), F.lit(0.0)).alias("total"),
        F.avg("latency_ms").alias("mean"),
    ).select(
        rounded(F.col("total")).alias("rag_total_latency_ms"),
        rounded(F.col("mean")).alias("rag_mean_latency_ms"),
        rounded(median).alias("rag_median_latency_ms"),
    )


def _counter(counts: DataFrame, kind: str) -> Column:
    """Outcomes or reasons, which are closed sets, as a sorted map."""
    entries = F.array_sort(F.collect_list(F.struct("label", "n")))
    return counts.filter(F.col("kind") == kind).agg(F.map_from_entries(entries)).scalar()


def _one(row: DataFrame) -> Column:
    return row.select(F.struct(*row.columns)).scalar()


def build_report(
    cases: DataFrame,
    observed: DataFrame,
    *,
    rag: DataFrame,
    semantic: DataFrame,
    bm25: DataFrame,
    configuration: dict[str, str] | None = None,
    provenance: dict[str, str] | None = None,
    generated_at: str | None = None,
    include_raw_responses: bool = False,
) -> DataFrame:
    """One nested row of everything but observations, gold and categories.

    These have no bound and stay tables: ``serialize_observations``, the gold pairs
    and ``report_counts``.
    """
    counts = report_counts(cases, observed)

    def text_map(values: dict[str, str] | None) -> Column:
        pairs = [F.lit(x) for item in sorted((values or {}).items()) for x in item]
        return F.create_map(*pairs).cast("map<string,string>")

    sizes = cases.agg(
        F.count("*").alias("case_count"),
        F.count_if(F.col("expected_action") != "abstain").alias("answerable_case_count"),
        F.count_if(F.col("expected_action") == "abstain").alias("abstention_case_count"),
    )
    repairs = observed.agg(
        F.count_if("repair_attempted").alias("repair_attempt_count"),
        F.count_if(F.col("outcome") == "answered_after_repair").alias("repair_success_count"),
    )
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()),
                        "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    set_struct, repair_struct = _one(sizes), _one(repairs)
    return cases.sparkSession.range(1).select(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        (F.lit(generated_at) if generated_at else now).alias("generated_at"),
        text_map(configuration).alias("configuration"),
        text_map(provenance).alias("provenance"),
        F.struct(
            *[set_struct[c].alias(c) for c in sizes.columns],
        ).alias("evaluation_set"),
        F.struct(
            _one(semantic).alias("semantic_retrieval"),
            _one(bm25).alias("bm25_baseline"),
            _one(rag).alias("rag"),
        ).alias("results"),
        _one(latency_summary(observed)).alias("timing"),
        F.struct(
            _counter(counts, "outcome").alias("outcomes"),
            _counter(counts, "initial_failure_reason").alias("initial_failure_reasons"),
            _counter(counts, "final_failure_reason").alias("final_failure_reasons"),
            *[repair_struct[c].alias(c) for c in repairs.columns],
            F.lit(include_raw_responses).alias("raw_responses_included"),
        ).alias("diagnostics"),
    )


def serialize_observations(
    observed: DataFrame,
    gold: DataFrame,
    *,
    include_raw_responses: bool = False,
) -> DataFrame:
    """Observation rows for the report; model responses only on request.

    Gold is counted here and kept as rows in its own table.
    """
    sizes = gold.groupBy("case_id").agg(F.count("*").alias("relevant_source_count"))
    raw = ["raw_response", "repair_response"] if include_raw_responses else []
    count = F.coalesce(F.col("relevant_source_count"), F.lit(0))
    return (
        observed.join(sizes, "case_id", "left")
        .select(
            "case_id",
            count.alias("relevant_source_count"),
            "retrieved_source_ids",
            "cited_source_ids",
            "answer",
            "abstained",
            "outcome",
            "latency_ms",
            "initial_failure_reason",
            "failure_reason",
            "repair_attempted",
            *raw,
        )
    )
