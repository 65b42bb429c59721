"""Registered queries: every operator over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from critiq.functions.plugins import embed
from critiq.functions.text import tokens
from critiq.operators import answers as A
from critiq.operators import bm25, cases, explore, identity, metrics, report
from critiq.operators.documents import build_documents, metadata_entries
from critiq.operators.evaluate import evaluate_answers, evaluate_bm25, retrieval_observations
from critiq.operators.mapping import ColumnMapping
from critiq.operators.normalize import normalize_reviews, violations
from critiq.operators.postings import search_postings, write_postings
from critiq.operators.reconcile import missing_documents, reconcile_index, reconciled, stale_ids
from critiq.operators.vector_cells import search_cells, write_cells
from critiq.operators.vector_search import Bound, search, vector_search
from critiq.plans import tables as T
from critiq.session import materialize, scratch_dir
from critiq.sources import index as sources_index
from critiq.sources.cases import read_cases
from critiq.sources.index import index_count, read_index, write_batch
from critiq.sources.registry import file_digests, file_facts, register_dataset
from critiq.sources.report import write_report
from critiq.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]

VIEW = explore.ReviewFilter(
    min_rating=2,
    max_rating=4,
    start_date=date(2024, 2, 1),
    end_date=date(2024, 10, 31),
    sentiments=("POSITIVE", "negative"),
    countries=("EN", "De", "fr"),
)
INDEX_VIEW = explore.ReviewFilter(
    min_rating=2, start_date=date(2024, 2, 1), countries=("EN", "De")
)


def _extras_text(extras: Column) -> Column:
    return F.array_join(F.transform(extras, lambda e: F.concat(e["k"], F.lit("="), e["v"])), ";")


def normalized(spark, sf):
    rows = normalize_reviews(T.raw_reviews(spark, sf), T.REVIEW_MAPPING, keep=["doc_id"])
    return _canonical_rows(rows)


def violation_rows(spark, sf):
    return violations(T.raw_reviews(spark, sf), T.REVIEW_MAPPING, keep=["doc_id"])


def filtered(spark, sf):
    rows = explore.filter_reviews(T.reviews(spark, sf), VIEW)
    return rows.select("doc_id", "Date", "Rating", "Sentiment", "Restaurant", "Country")


def summary(spark, sf):
    return explore.summarize(T.reviews(spark, sf))


def rating_histogram(spark, sf):
    return explore.rating_histogram(T.reviews(spark, sf))


def sentiment_counts(spark, sf):
    return explore.sentiment_counts(T.reviews(spark, sf))


def polarity(spark, sf):
    return explore.polarity_counts(T.reviews(spark, sf))


def kpi_row(spark, sf):
    return explore.kpi_row(T.reviews(spark, sf), VIEW)


def kpi_row_unlabelled(spark, sf):
    return explore.kpi_row(T.plain_records(spark, sf))


def rating_distribution(spark, sf):
    return explore.distribution(T.reviews(spark, sf), VIEW)


def distribution_top10(spark, sf):
    return explore.distribution(T.plain_records(spark, sf))


def availability(spark, sf):
    return explore.availability(T.reviews(spark, sf))


def facets(spark, sf):
    return explore.facet_values(T.reviews(spark, sf))


def date_bounds(spark, sf):
    return explore.date_bounds(T.reviews(spark, sf))


def preview(spark, sf):
    return explore.preview(T.reviews(spark, sf), ["doc_id"])


def record_digest(spark, sf):
    return identity.with_digest(T.reviews(spark, sf)).select("doc_id", "digest")


def source_ids(spark, sf):
    return identity.assign_source_ids(T.plain_records(spark, sf), ["doc_id"]).select(
        "doc_id", "source_id"
    )


def source_ids_keyless(spark, sf):
    return identity.assign_source_ids(T.plain_records(spark, sf).drop("doc_id")).select(
        "source_id", F.length("Review").alias("review_length")
    )


def fingerprint(spark, sf):
    return identity.storage_names(
        identity.dataset_fingerprint(T.plain_records(spark, sf)), "/data"
    )


def fingerprint_sum(spark, sf):
    return identity.sum_fingerprint(T.plain_records(spark, sf))


def _identified(spark, sf):
    return identity.assign_source_ids(T.reviews(spark, sf), ["doc_id"])


def documents_content(spark, sf):
    return build_documents(_identified(spark, sf)).select("source_id", "content")


def metadata_keys(spark, sf):
    return metadata_entries(build_documents(_identified(spark, sf)))


def _snapshots(spark, sf):
    """Documents before and after the labels arrived."""
    before = identity.source_id_set(T.reviews(spark, sf, with_labels=False))
    return before, identity.source_id_set(T.reviews(spark, sf))


def stale(spark, sf):
    return stale_ids(*_snapshots(spark, sf))


def missing(spark, sf):
    return missing_documents(*_snapshots(spark, sf)).select("source_id")


def reconcile(spark, sf):
    return reconciled(*_snapshots(spark, sf))


def embedded(spark, sf):
    rows = embed(T.documents(spark, sf).select("doc_id", "text"), T.letter_counts, "text")
    whole = F.transform("embedding", lambda x: x.cast("bigint").cast("string"))
    return rows.select("doc_id", F.array_join(whole, ",").alias("vector"))


def _nearest(spark, sf, metric, zero=None):
    index = T.read_table(spark, sf, "embeddings").select("vec_id", "embedding")
    if zero is not None:
        nothing = F.transform("embedding", lambda x: x * 0)
        index = index.withColumn("embedding", F.when(zero, nothing).otherwise(F.col("embedding")))
    found = vector_search(
        index, T.label_centroids(spark, sf), 10, metric=metric, id_column="vec_id"
    )
    return found.withColumn("distance", F.round("distance", 6))


def vector_topk(spark, sf):
    return _nearest(spark, sf, "l2")


def vector_topk_cosine(spark, sf):
    return _nearest(spark, sf, "cosine")


def vector_topk_ip(spark, sf):
    return _nearest(spark, sf, "ip")


def vector_topk_cells(spark, sf):
    """The rows nearest to the mean of each label, from an index of cells."""
    index = T.read_table(spark, sf, "embeddings").select("vec_id", "embedding")
    cells = write_cells(index, scratch_dir(spark), id_column="vec_id", rows_per_cell=256)
    found = search_cells(cells, T.label_centroids(spark, sf), 10, id_column="vec_id")
    return found.withColumn("distance", F.round("distance", 6))


def vector_topk_filtered(spark, sf):
    wanted = materialize(embed(T.questions(spark, sf), T.letter_counts, "question"))
    found = search(T.letter_index(spark, sf), wanted, T.TOP_K, criteria=INDEX_VIEW)
    return found.select("query_id", "source_id", "distance", "rank", "rating", "date", "country")


def vector_topk_per_query_filter(spark, sf):
    """Rating, date and country limits that differ from question to question."""
    key = F.col("query_id")
    asked = T.questions(spark, sf).select(
        "*",
        F.when(key % 3 != 0, (key % 5 + 1).cast("int")).alias("rating_from"),
        F.when(key % 4 == 0, F.date_add(F.lit("2024-02-01").cast("date"), (key % 100).cast("int")))
        .alias("since"),
        F.when(key % 2 == 0, F.array(F.lit("EN"), F.lit("de"))).alias("countries"),
    )
    bounds = [Bound("rating", "rating_from", "least"), Bound("date", "since", "from"),
              Bound("country", "countries", "among")]
    wanted = materialize(embed(asked, T.letter_counts, "question"))
    found = search(T.letter_index(spark, sf), wanted, T.TOP_K, bounds=bounds)
    return found.select("query_id", "source_id", "distance", "rank")


def vector_topk_zero(spark, sf):
    """Cosine search of vectors of which most are zero."""
    return _nearest(spark, sf, "cosine", zero=F.col("vec_id") % 100 > 0)


def token_text(spark, sf):
    return T.documents(spark, sf).select(
        "doc_id", F.array_join(tokens(F.col("text")), " ").alias("tokens")
    )


def _corpus(spark, sf):
    return bm25.tokenized(T.documents(spark, sf), "doc_id", "text")


def bm25_stats(spark, sf):
    return bm25.corpus_statistics(_corpus(spark, sf))


def bm25_document_frequencies(spark, sf):
    return bm25.document_frequencies(_corpus(spark, sf))


def bm25_postings(spark, sf):
    return bm25.term_frequencies(_corpus(spark, sf), "doc_id")


def bm25_topk(spark, sf):
    return T.keyword_matches(spark, sf).withColumn("score", F.round("score", 6))


def bm25_stored_topk(spark, sf):
    """The best documents of every passage from postings that are written first."""
    postings = write_postings(
        T.documents(spark, sf), scratch_dir(spark), id_column="doc_id", text_column="text"
    )
    found = search_postings(postings, T.questions(spark, sf), T.TOP_K, id_column="doc_id")
    return found.withColumn("score", F.round("score", 6))


def bm25_document_check(spark, sf):
    turns = T.read_table(spark, sf, "conversations").select(
        F.when(F.col("turn") > 0, F.col("conv_id").cast("string")).alias("source_id")
    )
    return bm25.check_document_ids(turns, "source_id")


def gold_pairs(spark, sf):
    return T.passage_gold(spark, sf)


def _passage_gold(spark, sf):
    return T.passage_gold(spark, sf).select(
        F.col("item_id").alias("case_id"), F.col("doc_id").alias("source_id")
    )


def _rounded(scores: DataFrame) -> DataFrame:
    """Means without the digits that the order of a float sum decides."""
    return scores.select(
        *[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in scores.dtypes]
    )


def _ranked(matches, id_column):
    return matches.select(
        F.col("query_id").alias("case_id"), F.col(id_column).alias("source_id"), "rank"
    )


def retrieval_metrics(spark, sf):
    ranked = _ranked(T.keyword_matches(spark, sf), "doc_id")
    return _rounded(metrics.retrieval_metrics(_passage_gold(spark, sf), ranked, T.TOP_K))


def hits_per_case(spark, sf):
    ranked = _ranked(T.keyword_matches(spark, sf), "doc_id")
    return metrics.hits_per_case(_passage_gold(spark, sf), ranked)


def retriever_comparison(spark, sf):
    gold = _document_gold(spark, sf)
    keyword = _ranked(T.keyword_matches(spark, sf), "doc_id").withColumn(
        "source_id", F.concat(F.lit("doc-"), F.col("source_id").cast("string"))
    )
    vector = _ranked(T.letter_matches(spark, sf), "source_id")
    rankings = {"bm25": keyword, "semantic": vector}
    return _rounded(metrics.compare_retrievers(gold, rankings, T.TOP_K))


def gold_by_title(spark, sf):
    return cases.resolve_gold(T.turn_cases(spark, sf), T.replies(spark, sf))


def missing_gold(spark, sf):
    return cases.missing_gold(T.turn_cases(spark, sf), T.replies(spark, sf))


def evaluate_replies(spark, sf):
    found = evaluate_bm25(T.replied_cases(spark, sf), T.replies(spark, sf), T.TOP_K)
    return _rounded(found[0])


def retrieval_only(spark, sf):
    wanted = T.turn_cases(spark, sf)
    ranked = bm25.bm25_search(T.replies(spark, sf), wanted, T.TOP_K, query_column="id")
    ranked = ranked.withColumnRenamed("id", "case_id")
    return retrieval_observations(wanted, ranked).select(
        "case_id", "outcome", F.array_join("retrieved_source_ids", ",").alias("retrieved")
    )


def evidence_context(spark, sf):
    return A.assemble_context(T.evidence(spark, sf))


def evidence_labels(spark, sf):
    matches = T.evidence(spark, sf)
    return matches.select("query_id", "rank", A.evidence_labels(matches).alias("label"))


def prompts(spark, sf):
    context = A.assemble_context(T.evidence(spark, sf))
    rows = T.questions(spark, sf).join(context, "query_id")
    return rows.select(
        "query_id",
        A.prompt_text(F.col("question"), F.col("context")).alias("answer_prompt"),
        A.prompt_text(F.col("question"), F.col("context"), repair=True).alias("repair_prompt"),
    )


def _responses(spark, sf):
    return T.responses(A.collect_evidence(T.evidence(spark, sf)))


def validate_answers(spark, sf):
    judged = A.validate_answers(_responses(spark, sf))
    ids = F.transform("verdict.cited", lambda c: c["source_id"])
    return judged.select(
        "query_id",
        F.col("verdict.reason").alias("reason"),
        F.col("verdict.answer").alias("answer"),
        F.array_join(ids, ",").alias("cited"),
        A.needs_repair().alias("repairable"),
    )


def _final(spark, sf, matches=None):
    collected = A.collect_evidence(matches or T.evidence(spark, sf))
    rows = T.responses(T.questions(spark, sf).join(collected, "query_id", "left"))
    return A.final_answers(rows, keep=("query_id", "latency_ms"))


def _observed(spark, sf, matches=None):
    """Observations, written down, as most uses read them more than once."""
    return materialize(metrics.observations(_final(spark, sf, matches)))


def _document_gold(spark, sf):
    pairs = T.passage_gold(spark, sf)
    return pairs.select(
        F.col("item_id").alias("case_id"),
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("source_id"),
    )


def final_answers(spark, sf):
    ids = F.transform("cited", lambda c: c["source_id"])
    return _final(spark, sf).select(
        "query_id", "answer", F.array_join(ids, ",").alias("cited"), "abstained",
        "raw_response", "repair_response", "initial_failure_reason", "failure_reason",
        "repair_attempted", metrics.outcome().alias("outcome"),
    )


def single_round_answers(spark, sf):
    """First responses alone, as of a run without a repair round."""
    collected = A.collect_evidence(T.evidence(spark, sf))
    rows = T.responses(T.questions(spark, sf).join(collected, "query_id", "left"))
    final = A.final_answers(rows.withColumn("repair_response", F.lit(None).cast("string")))
    ids = F.transform("cited", lambda c: c["source_id"])
    return final.select(
        "query_id", "answer", F.array_join(ids, ",").alias("cited"), "abstained",
        "failure_reason", metrics.outcome().alias("outcome"),
    )


def retrieval_from_observations(spark, sf):
    found = metrics.retrieval_from_observations(
        _document_gold(spark, sf), _observed(spark, sf), T.TOP_K
    )
    return _rounded(found)


def evaluated_answers(spark, sf):
    """Passages answered by a stand-in model from the letter index, and scored."""
    gold = materialize(_document_gold(spark, sf))
    declared = gold.groupBy("case_id").agg(F.collect_set("source_id").alias("gold_source_ids"))
    nothing = F.array().cast("array<string>")
    wanted = (
        T.passage_cases(spark, sf, gold)
        .join(declared.withColumnRenamed("case_id", "id"), "id", "left")
        .withColumns({"gold_source_ids": F.coalesce("gold_source_ids", nothing),
                      "source_labels": nothing})
    )
    index = T.letter_index(spark, sf).withColumn("title", F.lit(None).cast("string"))
    rag, _ = evaluate_answers(wanted, index, T.letter_counts, T.stand_in_model, T.TOP_K)
    return _rounded(rag)


def outcome_counts(spark, sf):
    return _observed(spark, sf).groupBy("outcome").agg(F.count("*").alias("n"))


def support_proxy(spark, sf):
    return metrics.support_per_case(T.passage_cases(spark, sf), _observed(spark, sf))


def answer_metrics(spark, sf):
    gold = materialize(_document_gold(spark, sf))
    wanted = T.passage_cases(spark, sf, gold)
    return _rounded(metrics.answer_metrics(wanted, _observed(spark, sf), gold))


def report_counts(spark, sf):
    return report.report_counts(T.passage_cases(spark, sf), _observed(spark, sf))


def latency_summary(spark, sf):
    return report.latency_summary(_observed(spark, sf))


def serialized_observations(spark, sf):
    gold = _document_gold(spark, sf)
    rows = report.serialize_observations(_observed(spark, sf), gold)
    return rows.select(
        "case_id", "relevant_source_count",
        F.array_join("retrieved_source_ids", ",").alias("retrieved"),
        F.array_join("cited_source_ids", ",").alias("cited"),
        "outcome", "latency_ms",
    )


def evaluation_report(spark, sf):
    # Each of these is read several times by the report.
    matches = materialize(T.evidence(spark, sf))
    gold = materialize(_document_gold(spark, sf))
    wanted = materialize(T.passage_cases(spark, sf, gold))
    observed = _observed(spark, sf, matches)
    keyword = _ranked(matches, "source_id")
    vector = _ranked(T.letter_matches(spark, sf), "source_id")
    built = report.build_report(
        wanted,
        observed,
        rag=metrics.answer_metrics(wanted, observed, gold),
        semantic=metrics.retrieval_metrics(gold, vector, T.TOP_K),
        bm25=metrics.retrieval_metrics(gold, keyword, T.TOP_K),
        generated_at="2024-01-01T00:00:00Z",
    )
    rows = built.select(
        "schema_version",
        "generated_at",
        *[
            F.col(f"evaluation_set.{c}").alias(c)
            for c in ("case_count", "answerable_case_count", "abstention_case_count")
        ],
        F.col("results.semantic_retrieval.recall_at_k").alias("semantic_recall"),
        F.col("results.bm25_baseline.recall_at_k").alias("bm25_recall"),
        F.col("results.rag.answer_success_rate").alias("answer_success_rate"),
        F.col("timing.rag_median_latency_ms").alias("rag_median_latency_ms"),
        F.to_json("diagnostics.outcomes").alias("outcomes"),
        F.col("diagnostics.repair_attempt_count").alias("repair_attempt_count"),
        F.col("diagnostics.repair_success_count").alias("repair_success_count"),
    )
    return _rounded(rows)


def report_files(spark, sf):
    """Label counts of an evaluation, written with its observations and read back."""
    path = scratch_dir(spark)
    observed = _observed(spark, sf)
    gold = materialize(_document_gold(spark, sf))
    write_report(
        report.latency_summary(observed), path, gold=gold,
        observations={"rag": report.serialize_observations(observed, gold)},
        counts=report.report_counts(T.passage_cases(spark, sf, gold), observed),
    )
    return spark.read.schema("kind string, label string, n bigint").json(f"{path}/counts")


def _manifest(spark, sf):
    """The passages as the one JSON document of a case manifest; returns its path."""
    key = F.col("item_id")
    abstain, name = key % 5 == 0, F.concat(F.lit("doc-"), key.cast("string"))
    nothing = F.array().cast("array<string>")
    fact = F.struct(
        F.array(F.concat(F.lit(" "), name)).alias("answer_terms"),
        F.array(F.substring("text", 1, 5)).alias("source_terms"),
    )
    case = F.struct(
        F.concat(F.lit("case-"), key.cast("string")).alias("id"),
        F.lit("test").alias("split"), F.lit("easy").alias("difficulty"),
        F.concat(F.lit("kind "), (key % 3).cast("string")).alias("category"),
        F.concat(F.lit("\t"), "text", F.lit(" ")).alias("question"),
        F.when(abstain, "abstain").otherwise("answer").alias("expected_action"),
        F.when(abstain, nothing).otherwise(F.array(name)).alias("gold_source_ids"),
        F.when(abstain, nothing).otherwise(F.array(name)).alias("source_labels"),
        F.when(abstain, F.array().cast("array<struct<answer_terms:array<string>,"
                                       "source_terms:array<string>>>"))
        .otherwise(F.array(fact)).alias("reference_facts"),
    )
    whole = T.read_table(spark, sf, "benchmark").agg(F.to_json(F.struct(
        F.lit("rag-eval-cases/2.0").alias("schema_version"),
        F.lit("passages").alias("evaluation_set_id"),
        F.collect_list(case).alias("cases"),
    )).alias("value"))
    path = scratch_dir(spark)
    whole.coalesce(1).write.text(path)
    return path


def case_manifest(spark, sf):
    """Cases of the passages, written as a manifest and read back."""
    rows = read_cases(spark, _manifest(spark, sf))
    return rows.select(
        "id", "question", "category", "split", "difficulty", "expected_action",
        F.array_join("gold_source_ids", ",").alias("gold"),
        F.array_join(F.flatten(F.transform("reference_facts", lambda f: f["answer_terms"])), ",")
        .alias("answer_terms"),
        F.size("mistyped").alias("mistyped"),
    )


def source_integrity(spark, sf):
    """Rows of the documents as CSV, and files whose digest depends on how it is made."""
    folder = _csv_copy(spark, sf)
    facts = file_facts(spark, folder)
    streamed = file_digests(spark, folder, whole_bytes=0)
    torn = facts.join(streamed, facts["sha256"] == streamed["digest"], "left_anti")
    return facts.agg(F.max("row_count").alias("row_count")).withColumn(
        "differing", torn.agg(F.count("*")).scalar()
    )


def index_fingerprint(spark, sf):
    """Fingerprint of an index that first held other records, from its commits alone."""
    path = scratch_dir(spark)
    records = T.plain_records(spark, sf)
    half = records.filter(F.col("doc_id") % 2 == 0).withColumn("Country", F.lit("none"))
    for part in (half, records):
        identified = identity.assign_source_ids(part, ["doc_id"])
        built = build_documents(identified, keep=("digest",)).select("source_id", "digest")
        existing = read_index(spark, path, ["source_id"])
        if existing is None:
            write_batch(spark, path, built)
        else:
            write_batch(
                spark, path, missing_documents(existing, built), stale_ids(existing, built)
            )
    return spark.range(1).select(
        F.lit(sources_index.index_fingerprint(spark, path)).alias("fingerprint")
    )


def index_size(spark, sf):
    """Rows of an index of the documents."""
    path = scratch_dir(spark)
    write_batch(spark, path, T.letter_index(spark, sf).select("source_id", "embedding"))
    return spark.range(1).select(F.lit(index_count(spark, path)).cast("bigint").alias("documents"))


def case_violations(spark, sf):
    return cases.case_violations(T.faulty_cases(spark, sf))


def incomplete_observations(spark, sf):
    """Assistant turns observed against user turns, by conversation."""
    turns = T.read_table(spark, sf, "conversations")
    by_role = {
        role: turns.filter(F.col("role") == role).select(
            F.col("conv_id").cast("string").alias("case_id")
        )
        for role in ("user", "assistant")
    }
    return cases.incomplete_observations(by_role["user"], by_role["assistant"], "case_id")


def _canonical_rows(reviews: DataFrame) -> DataFrame:
    return reviews.withColumn("_extra", _extras_text(F.col("_extra")))


def _csv_copy(spark, sf):
    """The documents as CSV files; returns their folder."""
    folder = f"{scratch_dir(spark)}/csv"
    rows = T.documents(spark, sf).select(
        F.col("text").alias("Review"), F.col("lang").alias("Market"),
        F.col("source").alias("Venue"), F.col("n_chars").alias("Size"),
    )
    rows.write.options(header=True, quoteAll=True, escape='"').csv(folder)
    return folder


def registered_dataset(spark, sf):
    """Documents written as CSV, registered, and read back in canonical form."""
    chosen = register_dataset(spark, _csv_copy(spark, sf), scratch_dir(spark))
    return _canonical_rows(spark.read.parquet(chosen.data_path))


def index_snapshot(spark, sf):
    """An index before and then after the labels arrived."""
    path = scratch_dir(spark)
    for with_labels in (False, True):
        reviews = T.reviews(spark, sf, with_labels=with_labels)
        built = build_documents(identity.assign_source_ids(reviews, ["doc_id"]))
        reconcile_index(
            spark, path, built, T.letter_counts,
            embed_partitions=2 * spark.sparkContext.defaultParallelism,
        )
    return read_index(spark, path, ["source_id", "content", "rating"])


def stream_index(spark, sf):
    """Documents written as CSV and taken up by the folder stream."""
    path = scratch_dir(spark)
    jobs.stream_index(
        spark, _csv_copy(spark, sf), ["Review", "Market", "Venue", "Size"],
        ColumnMapping(review="Review", country="Market", restaurant="Venue"),
        path, T.letter_counts, f"{path}/checkpoint",
    ).awaitTermination()
    return read_index(spark, path, ["source_id"])


def stream_search(spark, sf):
    """Passages as a stream of questions to an index of the documents."""
    path = scratch_dir(spark)
    index = T.letter_index(spark, sf).select("source_id", "content", "rating", "embedding")
    write_batch(spark, path, index)
    asked = spark.readStream.schema("item_id bigint, text string").parquet(
        f"{sf}/benchmark.parque[t]"
    )
    jobs.stream_search(
        asked.select(F.col("item_id").alias("query_id"), F.col("text").alias("question")),
        path, T.letter_counts, f"{path}/matches", f"{path}/checkpoint", T.TOP_K,
    ).awaitTermination()
    return spark.read.parquet(f"{path}/matches").select(
        "query_id", "source_id", "distance", "rank", "rating"
    )


def answer_flow(spark, sf):
    """Retrieve, prompt, answer, validate and repair with a stand-in model."""
    final = A.answer_queries(T.questions(spark, sf), T.evidence(spark, sf), T.stand_in_model)
    return metrics.observations(final).select(
        "case_id", "answer", "abstained", "raw_response", "repair_response",
        "initial_failure_reason", "failure_reason", "outcome",
        F.array_join("cited_source_ids", ",").alias("cited"),
    )


QUERIES: dict[str, Query] = {
    "normalize_reviews": normalized,
    "violations": violation_rows,
    "filter_reviews": filtered,
    "summary": summary,
    "rating_histogram": rating_histogram,
    "sentiment_counts": sentiment_counts,
    "polarity": polarity,
    "kpi_row": kpi_row,
    "kpi_row_unlabelled": kpi_row_unlabelled,
    "rating_distribution": rating_distribution,
    "distribution_top10": distribution_top10,
    "availability": availability,
    "facets": facets,
    "date_bounds": date_bounds,
    "preview": preview,
    "record_digest": record_digest,
    "source_ids": source_ids,
    "source_ids_keyless": source_ids_keyless,
    "fingerprint": fingerprint,
    "fingerprint_sum": fingerprint_sum,
    "documents_content": documents_content,
    "metadata_keys": metadata_keys,
    "stale_ids": stale,
    "missing_ids": missing,
    "reconcile": reconcile,
    "embed": embedded,
    "vector_topk": vector_topk,
    "vector_topk_cells": vector_topk_cells,
    "vector_topk_cosine": vector_topk_cosine,
    "vector_topk_ip": vector_topk_ip,
    "vector_topk_filtered": vector_topk_filtered,
    "vector_topk_per_query_filter": vector_topk_per_query_filter,
    "vector_topk_zero": vector_topk_zero,
    "tokens": token_text,
    "bm25_stats": bm25_stats,
    "bm25_document_frequencies": bm25_document_frequencies,
    "bm25_postings": bm25_postings,
    "bm25_topk": bm25_topk,
    "bm25_stored_topk": bm25_stored_topk,
    "bm25_document_check": bm25_document_check,
    "gold_pairs": gold_pairs,
    "hits_per_case": hits_per_case,
    "retrieval_metrics": retrieval_metrics,
    "retriever_comparison": retriever_comparison,
    "gold_by_title": gold_by_title,
    "missing_gold": missing_gold,
    "evaluate_replies": evaluate_replies,
    "retrieval_only": retrieval_only,
    "evidence_context": evidence_context,
    "evidence_labels": evidence_labels,
    "prompts": prompts,
    "validate_answers": validate_answers,
    "final_answers": final_answers,
    "single_round_answers": single_round_answers,
    "retrieval_from_observations": retrieval_from_observations,
    "evaluate_answers": evaluated_answers,
    "outcome_counts": outcome_counts,
    "support_proxy": support_proxy,
    "answer_metrics": answer_metrics,
    "report_counts": report_counts,
    "latency_summary": latency_summary,
    "serialized_observations": serialized_observations,
    "evaluation_report": evaluation_report,
    "report_files": report_files,
    "case_manifest": case_manifest,
    "source_integrity": source_integrity,
    "index_size": index_size,
    "index_fingerprint": index_fingerprint,
    "case_violations": case_violations,
    "incomplete_observations": incomplete_observations,
    "registered_dataset": registered_dataset,
    "index_snapshot": index_snapshot,
    "stream_index": stream_index,
    "stream_search": stream_search,
    "answer_flow": answer_flow,
}
