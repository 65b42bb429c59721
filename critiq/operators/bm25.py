"""BM25 keyword ranking of a corpus for a table of questions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from critiq.functions.text import tokens
from critiq.operators.scan_topk import SCORE_DIGITS, best_hits, query_passes, rank_top_k, scan
from critiq.session import materialize

K1 = 1.5
B = 0.75
# (question, term) pairs that travel with a task in one pass, about 20 bytes each.
PAIRS_PER_PASS = 4_000_000
#: Beyond so many pairs the work lies in scoring: the corpus is written down tokenised, dealt
#: out evenly, and read back by every pass.
PAIRS_IN_PLACE = 100_000
#: (document, term) pairs of a block of documents, and questions whose hits are ranked at once.
_CELLS = 1 << 20
_BLOCK = 1024
#: Hits that wait to be ranked.
_HITS = 1 << 18
#: A term that so large a part of a block's documents hold is kept as a column of the block.
_WIDE = 1 / 8
#: Tokens that are scored at once, with a dozen arrays of their number.
_TOKENS = 1 << 18
# Stands for "any document" beside the terms; tokens are never empty.
_EVERY = ""


def token_list(text: Column) -> Column:
    """Tokens of a text; one that is null has none."""
    return F.coalesce(tokens(text), F.array().cast("array<string>"))


def tokenized(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``id, tokens``; a document without text has none, and is a document."""
    return documents.select(id_column, token_list(F.col(text_column)).alias("tokens"))


def query_terms(queries: DataFrame, query_column: str, text_column: str) -> DataFrame:
    """Distinct terms per question: ``query id, term``."""
    terms = F.array_distinct(tokens(F.col(text_column)))
    return queries.select(query_column, F.explode(terms).alias("term"))


def corpus_statistics(tokenized_documents: DataFrame) -> DataFrame:
    """One row: ``document_count, total_length, average_length``."""
    return tokenized_documents.agg(
        F.count("*").alias("document_count"),
        F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("total_length"),
    ).withColumn("average_length", F.try_divide("total_length", "document_count"))


def term_frequencies(tokenized_documents: DataFrame, id_column: str) -> DataFrame:
    """Postings: ``id, term, frequency, length``."""
    return (
        tokenized_documents.select(
            id_column, F.size("tokens").alias("length"), F.explode("tokens").alias("term")
        )
        .groupBy(id_column, "length", "term")
        .agg(F.count("*").alias("frequency"))
    )


def document_frequencies(tokenized_documents: DataFrame) -> DataFrame:
    """``term, documents``; terms are made distinct in the row, so that only
    per-task counts are exchanged."""
    return (
        tokenized_documents.select(F.explode(F.array_distinct("tokens")).alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("documents"))
    )


def check_document_ids(documents: DataFrame, id_column: str) -> DataFrame:
    """IDs that are missing or used more than once, with how often."""
    return (
        documents.groupBy(id_column)
        .agg(F.count("*").alias("documents"))
        .filter(
            F.col(id_column).isNull()
            | (F.col(id_column).cast("string") == "")
            | (F.col("documents") > 1)
        )
    )


def _lookup(tokenized_documents: DataFrame, terms: DataFrame) -> pa.Table:
    """Documents and their total length, per question term and for the corpus.

    ``terms`` is bounded by the pass; tokens of no question are dropped before
    anything is exchanged.
    """
    wanted = terms.select("term").distinct()
    everything = wanted.sparkSession.range(0, 1, 1, 1).select(F.lit(_EVERY).alias("term"))
    return (
        tokenized_documents.select(
            F.size("tokens").cast("bigint").alias("length"),
            F.explode(F.array_append(F.array_distinct("tokens"), F.lit(_EVERY))).alias("term"),
        )
        .join(F.broadcast(wanted.unionByName(everything)), "term", "left_semi")
        .groupBy("term")
        .agg(F.count("*").alias("documents"), F.sum("length").alias("length"))
        .toArrow()
    )


def bm25_search(
    documents: DataFrame,
    queries: DataFrame,
    k: int = 5,
    *,
    id_column: str = "source_id",
    text_column: str = "content",
    query_column: str = "query_id",
    question_column: str = "question",
    k1: float = K1,
    b: float = B,
    pairs_per_pass: int = PAIRS_PER_PASS,
) -> DataFrame:
    """``query id, id, score, rank`` of the k best documents per question.

    Only positive scores count; ties go by ID. Two scans of the corpus per
    pass: one counts documents per question term, one scores. Every document that
    shares a term with a question is scored, so that the work grows with their number.
    """
    if k < 1:
        raise ValueError("k is below 1")
    if not check_document_ids(documents, id_column).isEmpty():
        raise ValueError("BM25 needs documents with present, distinct IDs")
    corpus = tokenized(documents, id_column, text_column)
    pairs = materialize(query_terms(queries, query_column, question_column))
    if pairs.limit(PAIRS_IN_PLACE + 1).count() > PAIRS_IN_PLACE:
        tasks = 4 * documents.sparkSession.sparkContext.defaultParallelism
        corpus = materialize(corpus.repartition(tasks, id_column))
    best = [
        _search_pass(corpus, part, k, id_column, query_column, k1, b)
        for part in query_passes(pairs, query_column, DataFrame.count, pairs_per_pass)
    ]
    return rank_top_k(
        reduce(DataFrame.unionByName, best),
        query_column,
        [F.desc("score"), F.asc(id_column)],
        k,
    )


def small_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in parts of at most ``_TOKENS`` tokens; a longer document stands alone."""
    for batch in batches:
        lengths = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
        ends = np.cumsum(np.nan_to_num(lengths).astype(np.int64))
        start = 0
        while start < len(ends):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + _TOKENS, "right")))
            yield batch.slice(start, stop - start)
            start = stop


class DocumentBlock:
    """Documents with the places and values of every term they hold."""

    def __init__(self, rows: int, row: np.ndarray, word: np.ndarray, value: np.ndarray, words: int):
        order = np.argsort(word, kind="stable")
        self.rows, self.row, self.value = rows, row[order].astype(np.intp), value[order]
        self.ends = np.concatenate(([0], np.cumsum(np.bincount(word, minlength=words))))
        # Room for whole columns of 64 rows.
        self.width = -(-rows // 64)
        self.columns: dict[int, np.ndarray] = {}

    def column(self, word: int, start: int, stop: int) -> np.ndarray:
        if word not in self.columns:
            dense = np.zeros(64 * self.width)
            dense[self.row[start:stop]] = self.value[start:stop]
            self.columns[word] = dense
        return self.columns[word]

    def scores(self, terms: list[tuple[int, int, int]]) -> np.ndarray:
        """Scores of all documents, from (word, start, stop) of a question's terms."""
        few = [t for t in terms if 0 < t[2] - t[1] <= self.rows * _WIDE]
        if few:
            total = np.bincount(
                np.concatenate([self.row[a:b] for _, a, b in few]),
                np.concatenate([self.value[a:b] for _, a, b in few]),
                64 * self.width,
            )
        else:
            total = np.zeros(64 * self.width)
        for word, start, stop in terms:
            if stop - start > self.rows * _WIDE:
                total += self.column(word, start, stop)
        return total

    def best(self, scores: np.ndarray, floor: float, k: int) -> np.ndarray:
        """Documents with a score that the k best, rounded, may have; few more than k."""
        low = floor
        if self.width > k:
            # As many groups as columns: the k-th of their maxima is a bound below.
            tops = scores.reshape(64, self.width).max(axis=0)
            low = max(low, np.partition(tops, self.width - k)[self.width - k])
        low -= 10.0**-SCORE_DIGITS
        hits = np.flatnonzero(scores >= low) if low > 0 else np.flatnonzero(scores > 0)
        if len(hits) > k:
            held = scores[hits]
            least = np.partition(held, len(held) - k)[len(held) - k] - 10.0**-SCORE_DIGITS
            hits = hits[held >= least]
        return hits


def _blocks(
    batches: Iterator[pa.RecordBatch],
    words: pa.Array,
    weight: np.ndarray,
    average: float,
    k1: float,
    b: float,
) -> Iterator[tuple[pa.Array, DocumentBlock]]:
    """Blocks of documents, with their IDs, of at most ``_CELLS`` documents and pairs of a
    document and a term; a longer document stands alone."""
    ids, held, rows, cells = [], [], 0, 0

    def done() -> tuple[pa.Array, DocumentBlock]:
        row, word, value = (np.concatenate(column) for column in zip(*held))
        return pa.concat_arrays(ids), DocumentBlock(rows, row, word, value, len(words))

    for batch in small_parts(batches):
        lists = batch.column(1)
        length = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        length = np.nan_to_num(length).astype(np.int64)
        row = np.repeat(np.arange(len(length)), length)
        word = pc.index_in(lists.flatten(), words)
        hit = pc.is_valid(word).to_numpy(zero_copy_only=False)
        word = word.fill_null(0).to_numpy()[hit].astype(np.int64)
        stride = max(len(words), 1)
        cell, often = np.unique(row[hit] * stride + word, return_counts=True)
        row, word = np.divmod(cell, stride)
        damping = k1 * (1 - b + b * length[row] / average)
        value = weight[word] * (often * (k1 + 1) / (often + damping))
        start = 0
        while start < len(length):
            before = int(np.searchsorted(row, start))
            ends = np.searchsorted(row, np.arange(start, len(length)), "right") - before
            room = _CELLS - cells - rows
            stop = start + int(np.searchsorted(ends + np.arange(1, len(ends) + 1), room, "right"))
            if stop == start:
                if rows:
                    yield done()
                    ids, held, rows, cells = [], [], 0, 0
                    continue
                stop = start + 1
            after = before + int(ends[stop - 1 - start])
            ids.append(batch.column(0).slice(start, stop - start))
            held.append((row[before:after] - start + rows, word[before:after], value[before:after]))
            rows, cells, start = rows + stop - start, cells + after - before, stop
    if rows:
        yield done()


#: As in earlier versions.
_small_parts = small_parts


def _search_pass(
    corpus: DataFrame,
    pairs: DataFrame,
    k: int,
    id_column: str,
    query_column: str,
    k1: float,
    b: float,
) -> DataFrame:
    found = _lookup(corpus, pairs)
    every = pc.equal(found["term"], _EVERY)
    whole = found.filter(every).to_pylist()
    if not whole:
        raise ValueError("there is no document to rank")
    document_count, total_length = whole[0]["documents"], whole[0]["length"]
    average = max(total_length / document_count, 1.0)
    found = found.filter(pc.invert(every)).sort_by("term")
    held = found["documents"].to_numpy().astype(np.float64)
    idf = np.log(1 + (document_count - held + 0.5) / (held + 0.5))

    vocabulary = pa.array(found["term"].to_numpy(), pa.string())
    stride = max(len(vocabulary), 1)
    table = pairs.toArrow().combine_chunks()
    terms = pc.index_in(table["term"], vocabulary)
    encoded = pc.dictionary_encode(table[query_column]).combine_chunks()
    known = pc.is_valid(terms).to_numpy()
    # A question that comes twice has its terms once.
    asked = np.unique(
        encoded.indices.to_numpy()[known].astype(np.int64) * stride
        + terms.to_numpy().astype(np.float64)[known].astype(np.int64)
    )
    query_of_pair, term_of_pair = np.divmod(asked, stride)
    shared = corpus.sparkSession.sparkContext.broadcast(
        (vocabulary, idf, term_of_pair.astype(np.int32), query_of_pair.astype(np.int32))
    )

    def hits(batches: Iterator[pa.RecordBatch], floor: np.ndarray):
        words, weight, pair_term, pair_query = shared.value
        for ids, block in _blocks(batches, words, weight, average, k1, b):
            for first in range(0, len(floor), _BLOCK):
                lo, hi = np.searchsorted(pair_query, [first, first + _BLOCK])
                term = pair_term[lo:hi]
                start, stop = block.ends[term], block.ends[term + 1]
                met = stop > start
                places = zip(
                    *(x[met].tolist() for x in (pair_query[lo:hi], term, start, stop))
                )
                row, query, score, waiting = [], [], [], 0
                for q, group in groupby(places, lambda place: place[0]):
                    scores = block.scores([place[1:] for place in group])
                    best = block.best(scores, floor[q], k)
                    row.append(best)
                    query.append(np.full(len(best), q))
                    score.append(scores[best])
                    waiting += len(best)
                    if waiting >= _HITS:
                        yield ids, first, *map(np.concatenate, (row, query, score))
                        row, query, score, waiting = [], [], [], 0
                if waiting:
                    yield ids, first, *map(np.concatenate, (row, query, score))

    def best_of(batches: Iterator[pa.RecordBatch], query_count: int):
        floor = np.full(query_count, -np.inf)
        return best_hits(hits(batches, floor), floor, k)

    return scan(corpus, id_column, pairs.schema[query_column], encoded.dictionary, best_of)
