"""Review, case and answer tables derived from the given tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from critiq.functions.plugins import embed
from critiq.operators.bm25 import bm25_search
from critiq.operators.mapping import ColumnMapping
from critiq.operators.normalize import normalize_reviews
from critiq.operators.patterns import containing
from critiq.operators.scan_topk import with_documents
from critiq.operators.vector_search import vector_search
from critiq.session import READ_PARTITIONS, materialize

TOP_K = 5


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """The table as it lies, or dealt out if the session asks for it."""
    wanted = df.sparkSession.conf.get(READ_PARTITIONS, None)
    return df if wanted is None else df.repartition(int(wanted), key)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, "documents"), "doc_id")


def _rating() -> Column:
    return F.when(F.col("doc_id") % 7 != 0, (F.col("doc_id") % 5 + 1).cast("int"))


def _date() -> Column:
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int"))
    return F.when(F.col("doc_id") % 11 != 0, day)


def _sentiment() -> Column:
    return F.when(F.col("quality") == 1, "Positive").when(F.col("quality") == 0, "Negative")


def _labelled(spark: SparkSession, sf_dir: str, with_labels: bool) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    if not with_labels:
        return docs.withColumns({"quality": F.lit(None).cast("int"),
                                 "toxic": F.lit(None).cast("int")})
    return docs.join(read_table(spark, sf_dir, "labels"), "doc_id", "left")


REVIEW_MAPPING = ColumnMapping(
    review="Review Text", date="Created At", rating="Stars", sentiment="Sentiment",
    restaurant="Venue", country="Market",
)


def reviews(spark: SparkSession, sf_dir: str, with_labels: bool = True) -> DataFrame:
    """Canonical reviews, keyed by ``doc_id``, with two extras of one reduced name."""
    source = _labelled(spark, sf_dir, with_labels)
    named = source.select(
        "doc_id",
        F.col("text").alias("Review Text"),
        F.col("lang").alias("Market"),
        F.col("source").alias("Venue"),
        _sentiment().alias("Sentiment"),
        _rating().alias("Stars"),
        _date().alias("Created At"),
        F.col("n_chars").alias("N Chars"),
        F.col("toxic").alias("n_chars"),
        F.col("toxic").alias("!?"),
    )
    return normalize_reviews(named, REVIEW_MAPPING, keep=["doc_id"])


def raw_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same reviews as text with faults in them."""
    key = F.col("doc_id")
    stars = (
        F.when(key % 13 == 0, "7").when(key % 13 == 1, "4.5").when(key % 13 == 2, "abc")
        .when(key % 13 == 3, "  ").when(key % 13 == 4, "5d").when(key % 13 == 5, " 4.0 ")
        .when(key % 13 == 6, "inf").otherwise(_rating().cast("string"))
    )
    created = (
        F.when(key % 17 == 0, "not-a-date").when(key % 17 == 1, "2024/03/15")
        .when(key % 17 == 2, "20240315").when(key % 17 == 3, "15 Mar 2024")
        .when(key % 17 == 4, "2024-03-15T10:20:30").when(key % 17 == 5, "2024-02-30")
        .when(key % 17 == 6, "03/15/2024").when(key % 17 == 7, "March 15, 2024")
        .when(key % 17 == 8, "\t").otherwise(_date().cast("string"))
    )
    return _labelled(spark, sf_dir, True).select(
        "doc_id",
        F.when(key % 19 == 0, " \n ").otherwise(F.concat(F.lit("\t "), "text", F.lit(" \n")))
        .alias("Review Text"),
        F.concat(F.lit(" "), "lang").alias("Market"),
        F.col("source").alias("Venue"),
        F.coalesce(_sentiment(), F.lit("  ")).alias("Sentiment"),
        stars.alias("Stars"),
        created.alias("Created At"),
        F.col("n_chars").cast("string").alias("N Chars"),
        F.when(key % 3 == 0, " ").otherwise(F.col("toxic").cast("string")).alias("Toxic"),
    )


def plain_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews of text, language and source only, so that exact copies occur."""
    named = read_table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("text").alias("Review"),
        F.col("lang").alias("Country"),
        F.col("source").alias("Restaurant"),
    )
    return normalize_reviews(named, keep=["doc_id"])


def letter_counts(texts: pd.Series) -> list[list[float]]:
    """Stand-in for an embedding model: how often each letter a-z occurs."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    return [[float(t.count(c) + t.count(c.upper())) for c in letters] for t in texts]


def stand_in_model(prompts: pd.Series) -> list[str]:
    """Stand-in for a chat model: a response by the length of the question."""
    first = ("Text [2]; more [1].", "Text [99].", "INSUFFICIENT_EVIDENCE", "Text.")
    answers = []
    for prompt in prompts:
        question = prompt.partition("Question:\n")[2].partition("\n\nReviews:\n")[0]
        if prompt.endswith("Corrected answer:\n"):
            answers.append("Fixed [1]." if len(question) % 3 else "INSUFFICIENT_EVIDENCE")
        else:
            answers.append(first[len(question) % 4])
    return answers


def letter_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with metadata and letter-count vectors."""
    rows = documents(spark, sf_dir).select(
        "doc_id",
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("source_id"),
        F.col("text").alias("content"),
        F.col("lang").alias("country"),
        F.col("source").alias("restaurant"),
        _rating().alias("rating"),
        _date().alias("date"),
        F.lit(None).cast("string").alias("sentiment"),
    )
    return embed(rows, letter_counts)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("question")
    )


def label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vector per label of the embeddings table."""
    cells = read_table(spark, sf_dir, "embeddings").select(
        "label", F.posexplode("embedding").alias("position", "x")
    )
    means = cells.groupBy("label", "position").agg(
        F.round(F.avg(F.col("x").cast("double")), 4).alias("x")
    )
    # One entry per dimension of the vectors.
    return means.groupBy("label").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("position", "x"))), lambda c: c["x"]
        ).alias("embedding")
    ).select(F.col("label").alias("query_id"), "embedding")


def passage_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``item_id, doc_id`` where a document contains a benchmark passage."""
    return containing(
        documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"),
        id_column="doc_id", text_column="text",
        passage_column="item_id", passage_text_column="text",
    )


def keyword_matches(
    spark: SparkSession, sf_dir: str, k: int = TOP_K, k1: float = 1.5
) -> DataFrame:
    """``query_id, doc_id, score, rank`` of BM25 for every passage."""
    return bm25_search(
        documents(spark, sf_dir), questions(spark, sf_dir), k,
        id_column="doc_id", text_column="text", k1=k1,
    )


def letter_matches(spark: SparkSession, sf_dir: str, k: int = TOP_K) -> DataFrame:
    """``query_id, source_id, distance, rank`` of the letter-count vectors."""
    wanted = materialize(embed(questions(spark, sf_dir), letter_counts, "question"))
    return vector_search(letter_index(spark, sf_dir), wanted, k)


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest documents of every passage with their metadata."""
    shown = read_table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("source_id"),
        F.col("text").alias("content"),
        F.col("lang").alias("country"),
        F.col("source").alias("restaurant"),
        _rating().alias("rating"),
        _date().alias("date"),
        F.lit(None).cast("string").alias("sentiment"),
    )
    rows = TOP_K * questions(spark, sf_dir).count()
    matches = keyword_matches(spark, sf_dir).select(
        "query_id",
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("source_id"),
        "rank",
        F.round("score", 3).alias("distance"),
    )
    return with_documents(matches, shown, "source_id", rows)


def responses(collected: DataFrame) -> DataFrame:
    """A first and a second response per question, of every kind there is."""
    kind = F.col("query_id") % 8
    first_id = F.get(F.col("evidence"), F.lit(0))["source_id"]
    first = (
        F.when(kind == 0, "Text [1].")
        .when(kind == 1, "Text [2]; more [1].")
        .when(kind == 2, F.concat(F.lit("Text ["), first_id, F.lit("].")))
        .when(kind == 3, "Text.")
        .when(kind == 4, "Text [99].")
        .when(kind == 5, "Text [nope].")
        .when(kind == 6, "INSUFFICIENT_EVIDENCE")
        .otherwise("Note INSUFFICIENT_EVIDENCE [1].")
    )
    again = F.col("query_id") % 3
    second = (
        F.when(again == 0, "Fixed [1].")
        .when(again == 1, "INSUFFICIENT_EVIDENCE")
        .otherwise("Still wrong.")
    )
    return collected.select(
        "*",
        first.alias("response"),
        second.alias("repair_response"),
        (F.col("query_id") + 100.0).alias("latency_ms"),
    )


def passage_cases(
    spark: SparkSession, sf_dir: str, gold: DataFrame | None = None
) -> DataFrame:
    """A case per passage: to be answered where a document contains it."""
    if gold is None:
        gold = passage_gold(spark, sf_dir).withColumnRenamed("item_id", "case_id")
    known = gold.select(F.col("case_id").alias("query_id"), F.lit(True).alias("known")).distinct()
    whole = F.col("question")
    absent = F.concat(F.lit("zz"), whole)
    facts = F.array(
        F.struct(
            F.array(F.lit("TEXT"), F.lit("fixed")).alias("answer_terms"),
            F.array(whole, F.lit("no such words")).alias("source_terms"),
        ),
        F.struct(
            F.array(F.lit("More [2]")).alias("answer_terms"),
            F.array(absent, F.lit("THE")).alias("source_terms"),
        ),
    )
    return questions(spark, sf_dir).join(known, "query_id", "left").select(
        F.col("query_id").alias("id"),
        "question",
        F.when(F.col("known"), "answer").otherwise("abstain").alias("expected_action"),
        F.when(F.col("known"), facts).otherwise(F.slice(facts, 1, 0)).alias("reference_facts"),
        F.concat(F.lit("group "), (F.col("query_id") % 4).cast("string")).alias("category"),
    )


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as documents, titled by their conversation."""
    turns = read_table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    rows = turns.select(
        F.concat_ws("-", "conv_id", "turn").alias("source_id"),
        F.concat(F.lit("conversation "), F.col("conv_id").cast("string")).alias("title"),
        F.col("text").alias("content"),
    )
    return spread(rows, "source_id")


def turn_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as cases whose gold is declared by title."""
    turns = read_table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    return turns.select(
        F.concat_ws("-", "conv_id", "turn").alias("id"),
        F.col("text").alias("question"),
        F.array().cast("array<string>").alias("gold_source_ids"),
        F.array(F.concat(F.lit("conversation "), F.col("conv_id").cast("string"))).alias(
            "source_labels"
        ),
    )


def faulty_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as manifest cases with faults sown in by turn and conversation."""
    turns = read_table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    kind = F.col("conv_id") % 13
    base = F.concat_ws("-", "conv_id", "turn")
    none = F.array().cast("array<string>")
    gold = (
        F.when(kind == 3, F.array(base, base)).when(kind == 4, none)
        .when(kind == 5, F.array(base, F.lit(" "))).otherwise(F.array(base))
    )
    labels = (
        F.when(kind == 3, F.array(F.lit("a"), F.lit("b"))).when(kind == 4, none)
        .when(kind == 5, F.array(F.lit("a"), F.lit("b")))
        .when(kind == 6, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))
    )
    terms = F.when(kind == 7, none).otherwise(F.array(F.lit("word")))
    fact = F.array(F.struct(terms.alias("answer_terms"), terms.alias("source_terms")))
    return turns.select(
        F.when(kind == 1, " ").when(kind == 9, F.concat(F.lit("same "), "conv_id"))
        .otherwise(base).alias("id"),
        F.when(kind == 2, "\t").otherwise(F.col("text")).alias("question"),
        F.when(kind == 10, "").otherwise("test").alias("split"),
        F.lit("general").alias("category"),
        F.lit("hard").alias("difficulty"),
        F.when(kind == 0, "guess").when(kind == 11, "abstain").otherwise("answer").alias(
            "expected_action"
        ),
        gold.alias("gold_source_ids"),
        labels.alias("source_labels"),
        F.when(kind == 8, F.slice(fact, 1, 0)).otherwise(fact).alias("reference_facts"),
    )


def replied_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those user turns whose conversation has a reply, so that their gold exists."""
    titles = replies(spark, sf_dir).select("title").distinct()
    wanted = turn_cases(spark, sf_dir)
    return wanted.join(titles, F.get("source_labels", F.lit(0)) == F.col("title"), "left_semi")
