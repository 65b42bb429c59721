"""Prompts from evidence, and validation of batches of cited answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from critiq.functions.plugins import ModelFunction, generate
from critiq.functions.text import LINE_BREAK, strip
from critiq.session import materialize

# Texts and names that results are compared by.
ABSTAIN_TOKEN = "INSUFFICIENT_EVIDENCE"
NO_MATCH_TEXT = "I could not find any reviews matching the current question and filters."
REJECTION_TEXT = (
    "I could not produce an answer with citations that match the retrieved reviews."
)
MISSING_RESPONSE = "missing_response"
CITATION = r"\[([A-Za-z0-9][A-Za-z0-9_-]*)\]"
REPAIRABLE = (
    "clean_abstention", "missing_citations", "out_of_range_citation", "unknown_citation"
)

_ANSWER_RULES = (
    "Answer the question from only the supplied reviews and add nothing to them. "
    "Mark every claim with the number of the review it rests on, such as [1]; use no "
    "other numbers and no source IDs. Say so where the reviews disagree or say little; "
    "that alone is no reason to withhold an answer. If no review bears on the question, "
    f"reply with {ABSTAIN_TOKEN} and nothing else."
)
_REPAIR_RULES = (
    "The previous response could not be accepted. Read the reviews again. If at least "
    "one supplied review bears on the question, answer from the reviews alone, with "
    "their limits, and mark every claim with a supplied number such as [1]. If none "
    f"does, reply with {ABSTAIN_TOKEN} and nothing else; never put that word beside an "
    "answer."
)

EVIDENCE_FIELDS = (
    "rank", "source_id", "distance", "rating", "date", "sentiment", "restaurant",
    "country", "content",
)
_SECTION_FIELDS = ("rating", "date", "sentiment", "restaurant", "country")


def collect_evidence(matches: DataFrame, query_column: str = "query_id") -> DataFrame:
    """The k matches of each query as one array in rank order.

    ``matches`` is a top-k result, so a group has at most k rows. Missing
    metadata columns count as absent values.
    """
    types = {"rank": "int", "distance": "double", "rating": "int", "date": "date"}
    columns = [
        (F.col(f) if f in matches.columns else F.lit(None)).cast(types.get(f, "string")).alias(f)
        for f in EVIDENCE_FIELDS
    ]
    return matches.groupBy(query_column).agg(
        F.array_sort(F.collect_list(F.struct(*columns))).alias("evidence")
    )


def _labelled(label: str, value: Column, suffix: str = "") -> Column:
    text = F.concat(F.lit(f"{label}: "), value.cast("string"), F.lit(suffix))
    return F.when(value.isNotNull(), text)


def _has_no_id(e: Column) -> Column:
    return e["source_id"].isNull() | (e["source_id"] == "")


def context_text(evidence: Column) -> Column:
    """Numbered sections, a blank line between; a match without ID is an error."""

    def section(e: Column) -> Column:
        lines = F.concat_ws(
            "\n",
            F.concat(F.lit("["), e["rank"].cast("string"), F.lit("]")),
            F.concat(F.lit("Source ID: "), e["source_id"]),
            *[
                _labelled(f.capitalize(), e[f], "/5" if f == "rating" else "")
                for f in _SECTION_FIELDS
            ],
            e["content"],
        )
        missing = F.raise_error(F.lit("retrieved review has no source ID")).cast("string")
        return F.when(_has_no_id(e), missing).otherwise(lines)

    return F.array_join(F.transform(evidence, section), "\n\n")


def assemble_context(matches: DataFrame, query_column: str = "query_id") -> DataFrame:
    collected = collect_evidence(matches, query_column)
    return collected.select(query_column, context_text(F.col("evidence")).alias("context"))


def evidence_labels(matches: DataFrame) -> Column:
    """One display line per match: number, labels, rating, date, distance."""
    rating = F.concat(F.col("rating").cast("string"), F.lit("/5"))
    return F.concat_ws(
        " · ",
        F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("]")),
        *[F.col(c) for c in ("restaurant", "country", "sentiment")],
        rating,
        F.col("date").cast("string"),
        F.concat(F.lit("distance "), F.format_string("%.3f", F.col("distance"))),
    )


def prompt_text(question: Column, context: Column, *, repair: bool = False) -> Column:
    """Prompt of the first or the repair round; an empty question is an error."""
    asked = strip(question)
    rules = _REPAIR_RULES if repair else _ANSWER_RULES
    closing = "\n\nCorrected answer:\n" if repair else "\n\nAnswer:\n"
    text = F.concat(
        F.lit(f"You analyse customer reviews. {rules}\n\nQuestion:\n"),
        asked,
        F.lit("\n\nReviews:\n"),
        context,
        F.lit(closing),
    )
    empty = F.raise_error(F.lit("a prompt needs a question")).cast("string")
    return F.when(asked == "", empty).otherwise(text)


def validate_answers(
    df: DataFrame,
    response: str = "response",
    evidence: str = "evidence",
    output: str = "verdict",
) -> DataFrame:
    """Add ``output``: struct of reason (null when valid), answer, cited.

    Citations are evidence numbers or source IDs; they are renumbered by first
    use. All of it is built-in expressions over the row.
    """
    text, ids, kept = F.col("_text"), F.col("_ids"), F.col("_kept")
    cited, resolved, order = F.col("_cited"), F.col("_resolved"), F.col("_order")
    token = F.lit(ABSTAIN_TOKEN)

    steps = (
        df.withColumn("_text", strip(F.col(response)))
        .withColumn("_ids", F.transform(F.col(evidence), lambda e: e["source_id"]))
        .withColumn(
            "_kept",
            F.filter(F.split(text, LINE_BREAK, -1), lambda line: strip(line) != token),
        )
        .withColumn("_embedded", F.exists(kept, lambda line: F.contains(line, token)))
        .withColumn(
            "_clean",
            F.when(F.contains(text, token), strip(F.array_join(kept, "\n"))).otherwise(text),
        )
        .withColumn("_cited", F.regexp_extract_all("_clean", F.lit(CITATION), F.lit(1)))
    )

    def resolve(c: Column) -> Column:
        number = F.when(c.rlike("^[1-9][0-9]*$"), c.try_cast("int"))
        by_number = F.when(number <= F.size(ids), F.get(ids, number - 1))
        return F.coalesce(by_number, F.when(F.array_contains(ids, c), c))

    steps = (
        steps.withColumn("_resolved", F.transform(cited, resolve))
        .withColumn(
            "_bad",
            F.get(
                F.filter(cited, lambda c: resolve(c).isNull()),
                F.lit(0),
            ),
        )
        .withColumn("_order", F.array_distinct(resolved))
        .withColumn("_parts", F.split("_clean", CITATION, -1))
    )

    def renumbered(part: Column, i: Column) -> Column:
        place = F.array_position(order, F.get(resolved, i)).cast("string")
        mark = F.concat(F.lit("["), place, F.lit("]"))
        return F.concat(part, F.coalesce(mark, F.lit("")))

    no_id = F.exists(F.col(evidence), _has_no_id)
    reason = (
        F.when(F.col(response).isNull(), MISSING_RESPONSE)
        .when(text == token, "clean_abstention")
        .when(F.contains(text, token) & F.col("_embedded"), "embedded_control_token")
        .when(F.col("_clean") == "", "invalid_remainder")
        .when(no_id, "retrieved_source_missing_id")
        .when(F.size(cited) == 0, "missing_citations")
        .when(F.col("_bad").rlike("^[0-9]+$"), "out_of_range_citation")
        .when(F.col("_bad").isNotNull(), "unknown_citation")
    )

    def citation(source: Column, i: Column) -> Column:
        match = F.get(F.col(evidence), F.array_position(ids, source).cast("int") - 1)
        return F.struct(
            (i + 1).alias("citation_number"),
            source.alias("source_id"),
            match["distance"].alias("distance"),
            match["content"].alias("content"),
        )

    no_citations = F.array().cast(
        "array<struct<citation_number:int,source_id:string,distance:double,content:string>>"
    )
    valid = F.col("_reason").isNull()
    return (
        steps.withColumn("_reason", reason)
        .withColumn(
            output,
            F.struct(
                F.col("_reason").alias("reason"),
                F.when(
                    valid, F.array_join(F.transform("_parts", renumbered), "")
                ).alias("answer"),
                F.when(valid, F.transform(order, citation)).otherwise(no_citations).alias("cited"),
            ),
        )
        .drop(
            "_text", "_ids", "_kept", "_embedded", "_clean", "_cited", "_resolved", "_bad",
            "_order", "_parts", "_reason",
        )
    )


def needs_repair(verdict: str = "verdict") -> Column:
    return F.coalesce(F.col(f"{verdict}.reason").isin(*REPAIRABLE), F.lit(False))


def final_answers(
    df: DataFrame,
    response: str = "response",
    repair_response: str = "repair_response",
    evidence: str = "evidence",
    keep: tuple[str, ...] = ("query_id",),
) -> DataFrame:
    """Final state per question after at most one repair round.

    ``evidence`` may be null or empty where nothing was retrieved; a repair
    response counts only where the first response could be repaired. A null
    repair response is no repair: a clean abstention then is the model's answer,
    other reasons stand. A null first response is a reason of its own.
    """
    no_evidence = F.array().cast(df.schema[evidence].dataType)
    rows = df.withColumn("_evidence", F.coalesce(F.col(evidence), no_evidence))
    judged = validate_answers(rows, response, "_evidence", "_first")
    judged = validate_answers(judged, repair_response, "_evidence", "_second")

    empty = F.size("_evidence") == 0
    no_id = F.exists("_evidence", _has_no_id)
    asked = ~empty & ~no_id
    first, second = F.col("_first"), F.col("_second")
    accepted = asked & first["reason"].isNull()
    repaired = asked & needs_repair("_first") & F.col(repair_response).isNotNull()
    rescued = repaired & second["reason"].isNull()
    declined = first["reason"] == "clean_abstention"
    abstained = (repaired & ~rescued & (declined | (second["reason"] == "clean_abstention"))) | (
        asked & ~repaired & F.coalesce(declined, F.lit(False))
    )
    return judged.select(
        *keep,
        F.when(empty | abstained, F.lit(NO_MATCH_TEXT))
        .when(accepted, first["answer"])
        .when(rescued, second["answer"])
        .otherwise(F.lit(REJECTION_TEXT))
        .alias("answer"),
        F.when(accepted, first["cited"])
        .when(rescued, second["cited"])
        .otherwise(F.slice(first["cited"], 1, 0))
        .alias("cited"),
        F.when(asked, F.transform("_evidence", lambda e: e["source_id"]))
        .otherwise(F.array().cast("array<string>"))
        .alias("retrieved_source_ids"),
        F.coalesce(abstained, F.lit(False)).alias("abstained"),
        F.when(asked, F.col(response)).otherwise("").alias("raw_response"),
        F.when(repaired, F.col(repair_response)).alias("repair_response"),
        F.when(repaired, first["reason"]).alias("initial_failure_reason"),
        F.when(empty, "empty_retrieval")
        .when(no_id, "retrieved_source_missing_id")
        .when(repaired, second["reason"])
        .otherwise(first["reason"])
        .alias("failure_reason"),
        F.coalesce(repaired, F.lit(False)).alias("repair_attempted"),
    )


def answer_queries(
    queries: DataFrame,
    matches: DataFrame,
    model: ModelFunction,
    query_column: str = "query_id",
    question_column: str = "question",
) -> DataFrame:
    """Prompt, generate, validate and repair once, for all questions together.

    Evidence and responses are written down before they are used: the corpus is
    searched once, and neither a lost executor nor a second use of the result
    calls the model again for rows that are done.
    """
    rows = materialize(queries.join(collect_evidence(matches, query_column), query_column, "left"))
    ready = F.col("evidence").isNotNull() & ~F.exists("evidence", _has_no_id)
    context = context_text(F.col("evidence"))
    question = F.col(question_column)

    asked = rows.filter(ready).withColumn("prompt", prompt_text(question, context))
    first = materialize(generate(asked, model).select(query_column, "response"))
    answered = rows.join(first, query_column, "left")
    failed = validate_answers(answered.filter(F.col("response").isNotNull())).filter(needs_repair())
    again = failed.withColumn("prompt", prompt_text(question, context, repair=True))
    second = materialize(
        generate(again, model, output="repair_response").select(query_column, "repair_response")
    )
    return final_answers(answered.join(second, query_column, "left"), keep=(query_column,))
