"""BM25 over stored postings: a corpus is tokenised once and then searched any number of times.

Postings are rows of (term, block of documents, frequency) with the documents that hold the
term so often. They lie in folders by a hash of the term and sorted by term in their files,
so that a search reads the terms of its questions and nothing else, and no text. Documents
are dealt to blocks of bounded expected size by a hash of their ID.

The shortest document of a row bounds what the row can add to a score. A search sums these
bounds per (question, block), reading no document lists; scores the most promising blocks of
each question; and then only those others whose bound reaches the k-th score so found. Lists
are exchanged by block and added up there; beyond a bound of the questions all steps are joins
and aggregates over their whole table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import (
    ArrayType, DoubleType, LongType, StringType, StructField, StructType,
)

from critiq.operators.bm25 import (
    B, K1, DocumentBlock, check_document_ids, query_terms, small_parts, token_list,
)
from critiq.operators.scan_topk import SCORE_DIGITS, rank_top_k
from critiq.session import materialize, small_batches

DOCUMENTS_PER_BLOCK = 1024
BUCKETS = 64
#: Blocks whose postings of one bucket are written by one task.
BLOCKS_PER_SLICE = 4096
#: Blocks per question that are scored first.
FIRST_BLOCKS = 2
#: (question, term) or (question, block) pairs that are broadcast.
PAIRS_PER_PASS = 1_000_000
#: Rows that a Python worker hands over at once.
_ROWS = 10_000
#: Room for the rounding of sums when a bound is compared with a score.
_MARGIN = 1e-6
_CORPUS = "documents bigint, total_length bigint, blocks bigint"


@dataclass(frozen=True)
class Postings:
    """A stored corpus: its rows and the figures that scores need."""

    rows: DataFrame
    documents: int
    total_length: int
    blocks: int

    @property
    def average_length(self) -> float:
        return max(self.total_length / self.documents, 1.0)


def _bucket(term: Column | str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple]:
    """(value, batches) for each run of equal values of ``column``."""
    value, held = None, []
    for batch in batches:
        keys = batch.column(column).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for start, stop in zip(cuts[:-1], cuts[1:]):
            if start == stop:
                continue
            if held and keys[start] != value:
                yield value, held
                held = []
            value = keys[start]
            held.append(batch.slice(start, stop - start))
    if held:
        yield value, held


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Places where a value of sorted columns differs from the one before."""
    changed = np.any([np.diff(c) != 0 for c in columns], axis=0)
    return np.concatenate(([0], np.flatnonzero(changed) + 1))


def _grouped(corpus: DataFrame, id_column: str) -> DataFrame:
    """Rows ``block, term, frequency, shortest, held_by, held`` of ``id, tokens, block``,
    whose blocks lie together."""
    kind = corpus.schema[id_column].dataType
    held = StructType([StructField("id", kind), StructField("length", LongType())])
    schema = StructType(
        [StructField("block", LongType()), StructField("term", StringType()),
         StructField("frequency", LongType()), StructField("shortest", LongType()),
         StructField("held_by", LongType()), StructField("held", ArrayType(held))]
    )

    def rows_of(block: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        ids, terms, places, counts, sizes, before = [], [], [], [], [], 0
        for part in small_parts(parts):
            lists = part.column(1)
            length = np.nan_to_num(
                pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            ).astype(np.int64)
            words = pc.dictionary_encode(lists.flatten())
            stride = max(len(words.dictionary), 1)
            row = np.repeat(np.arange(len(length)), length)
            cells, often = np.unique(
                row * stride + words.indices.to_numpy(zero_copy_only=False), return_counts=True
            )
            row, word = np.divmod(cells, stride)
            ids.append(part.column(0))
            terms.append(words.dictionary.take(pa.array(word)))
            places.append(row + before)
            counts.append(often)
            sizes.append(length)
            before += len(length)
        words = pc.dictionary_encode(pa.concat_arrays(terms))
        word = words.indices.to_numpy(zero_copy_only=False)
        if not len(word):
            return None
        place, often, length = map(np.concatenate, (places, counts, sizes))
        order = np.lexsort((often, word))
        place, often, word = place[order], often[order], word[order]
        start = _starts(word, often)
        length = length[place]
        documents = pa.StructArray.from_arrays(
            [pa.concat_arrays(ids).take(pa.array(place)), pa.array(length)], ["id", "length"]
        )
        ends = np.append(start, len(place))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(start), block)),
             words.dictionary.take(pa.array(word[start])), pa.array(often[start]),
             pa.array(np.minimum.reduceat(length, start)), pa.array(np.diff(ends)),
             pa.ListArray.from_arrays(pa.array(ends, pa.int32()), documents)],
            names=["block", "term", "frequency", "shortest", "held_by", "held"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, parts in _runs(batches, "block"):
            rows = rows_of(block, parts)
            if rows is not None:
                for start in range(0, len(rows), _ROWS):
                    yield rows.slice(start, _ROWS)

    small_batches(corpus.sparkSession)
    return corpus.mapInArrow(run, schema)


def write_postings(
    documents: DataFrame,
    path: str,
    *,
    id_column: str = "source_id",
    text_column: str = "content",
    documents_per_block: int = DOCUMENTS_PER_BLOCK,
) -> Postings:
    """Write the postings of a corpus into a new folder; its head is written last.

    Missing and repeated IDs are an error, looked for once per corpus.
    """
    if not check_document_ids(documents, id_column).isEmpty():
        raise ValueError("BM25 needs documents with present, distinct IDs")
    spark = documents.sparkSession
    count = documents.count()
    blocks = max(1, -(-count // documents_per_block))
    slices = -(-blocks // BLOCKS_PER_SLICE)
    block = F.pmod(F.xxhash64(F.col(id_column)), F.lit(blocks))
    dealt = (
        documents.select(id_column, text_column, block.alias("block"))
        # The text is exchanged once; the documents of a block are then grouped where they lie.
        .repartition("block")
        .sortWithinPartitions("block")
    )
    corpus = dealt.select(
        *[F.col(c) for c in (id_column, "block")], token_list(F.col(text_column)).alias("tokens")
    ).select(id_column, "tokens", "block")
    (
        _grouped(corpus, id_column)
        .withColumn("bucket", _bucket("term"))
        .repartition("bucket", F.pmod("block", F.lit(slices)))
        .sortWithinPartitions("bucket", "term", "block")
        .write.partitionBy("bucket").parquet(f"{path}/rows")
    )
    rows = spark.read.parquet(f"{path}/rows") if count else None
    total = 0
    if rows is not None:
        total = rows.agg(F.sum(F.col("frequency") * F.col("held_by"))).head()[0] or 0
    head = spark.createDataFrame([(count, total, blocks)], _CORPUS)
    head.coalesce(1).write.parquet(f"{path}/head")
    return read_postings(spark, path)


def read_postings(spark: SparkSession, path: str) -> Postings:
    head = spark.read.schema(_CORPUS).parquet(f"{path}/head").head()
    if not head["documents"]:
        raise ValueError("there is no document to rank")
    return Postings(spark.read.parquet(f"{path}/rows"), *head)


def _weighted(frequency: Column, length: Column, average: float, k1: float, b: float) -> Column:
    return frequency * (k1 + 1) / (frequency + k1 * (1 - b + b * length / average))


def block_bounds(
    postings: Postings, asked: DataFrame, query_column: str, k1: float = K1, b: float = B
) -> tuple[DataFrame, DataFrame]:
    """``query, term, weight`` of terms that occur, and ``query, block, bound``.

    ``asked`` has the distinct terms per question. Document lists aren't read.
    """
    bounded = asked.limit(PAIRS_PER_PASS + 1).count() <= PAIRS_PER_PASS
    small = F.broadcast if bounded else (lambda df: df)
    buckets = [r[0] for r in asked.select(_bucket("term")).distinct().collect()]
    heads = materialize(
        postings.rows.filter(F.col("bucket").isin(buckets))
        .join(small(asked.select("term").distinct()), "term", "left_semi")
        .select("term", "block", "frequency", "shortest", "held_by")
    )
    held = F.col("holders")
    idf = F.log(1 + (postings.documents - held + 0.5) / (held + 0.5))
    weights = materialize(
        heads.groupBy("term").agg(F.sum("held_by").alias("holders"))
        .join(asked, "term")
        .select(query_column, "term", idf.alias("weight"))
    )
    part = _weighted(
        F.col("frequency"), F.col("shortest"), postings.average_length, k1, b
    )
    tops = heads.groupBy("term", "block").agg(F.max(part).alias("top"))
    bounds = (
        tops.join(small(weights), "term")
        .groupBy(query_column, "block")
        .agg(F.sum(F.col("weight") * F.col("top")).alias("bound"))
    )
    return weights, materialize(bounds)


def _scored(
    postings: Postings, weights: DataFrame, blocks: DataFrame, query_column: str,
    k1: float, b: float, k: int | None = None,
) -> DataFrame:
    """``query, id, score`` of all documents of (question, block) pairs with a shared term.

    With ``k`` documents of a block that aren't among its k best may be left out.
    """
    buckets = [r[0] for r in weights.select(_bucket("term")).distinct().collect()]
    pairs = blocks.select(query_column, "block")
    held = postings.rows.filter(F.col("bucket").isin(buckets))
    if all(df.limit(PAIRS_PER_PASS + 1).count() <= PAIRS_PER_PASS for df in (weights, pairs)):
        return _scored_blocks(postings, held, weights, pairs, query_column, k1, b, k)
    part = _weighted(F.col("frequency"), F.col("d.length"), postings.average_length, k1, b)
    met = held.join(pairs.join(weights, query_column), ["term", "block"])
    return (
        met.select(query_column, "weight", "frequency", F.explode("held").alias("d"))
        .select(query_column, F.col("d.id").alias("id"), (F.col("weight") * part).alias("part"))
        .groupBy(query_column, "id")
        .agg(F.round(F.sum("part"), SCORE_DIGITS).alias("score"))
    )


def _scored_blocks(
    postings: Postings, held: DataFrame, weights: DataFrame, pairs: DataFrame,
    query_column: str, k1: float, b: float, k: int | None,
) -> DataFrame:
    """The same from lists that are exchanged once, by block; questions travel with the tasks."""
    spark = held.sparkSession
    asked, wanted = weights.toArrow(), pairs.toArrow()
    vocabulary = pa.array(pc.unique(asked["term"]).to_pylist(), pa.string())
    number = pc.dictionary_encode(wanted[query_column]).combine_chunks()
    queries = number.dictionary
    query = pc.index_in(asked[query_column], queries)
    known = pc.is_valid(query).to_numpy()
    query = query.to_numpy().astype(np.float64)[known].astype(np.int64)
    term = pc.index_in(asked["term"], vocabulary).to_numpy()[known].astype(np.int64)
    idf = np.zeros(len(vocabulary))
    idf[term] = asked["weight"].to_numpy()[known]
    order = np.argsort(query, kind="stable")
    ends = np.searchsorted(query[order], np.arange(len(queries) + 1))
    place = np.argsort(wanted["block"].to_numpy(), kind="stable")
    shared = spark.sparkContext.broadcast(
        (vocabulary, idf, term[order], ends, queries,
         wanted["block"].to_numpy()[place], number.indices.to_numpy()[place])
    )
    id_type = held.schema["held"].dataType.elementType["id"].dataType
    schema = StructType(
        [pairs.schema[query_column], StructField("id", id_type), StructField("score", DoubleType())]
    )
    arrow, average = to_arrow_schema(schema), postings.average_length

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, weight, terms, ends, queries, block_of, query_of = shared.value
        for key, parts in _runs(batches, "block"):
            rows = pa.Table.from_batches(parts).combine_chunks()
            lists = pa.concat_arrays(rows["held"].chunks)
            size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            documents = lists.flatten()
            ids = pc.dictionary_encode(documents.field("id"))
            length = documents.field("length").to_numpy()
            frequency = np.repeat(rows["frequency"].to_numpy(), size)
            word = np.repeat(pc.index_in(rows["term"], words).to_numpy(), size)
            damping = k1 * (1 - b + b * length / average)
            value = weight[word] * (frequency * (k1 + 1) / (frequency + damping))
            block = DocumentBlock(
                len(ids.dictionary), ids.indices.to_numpy(), word, value, len(words)
            )
            lo, hi = np.searchsorted(block_of, [key, key + 1])
            query, row, found = [], [], []
            for q in query_of[lo:hi].tolist():
                mine = terms[ends[q] : ends[q + 1]]
                start, stop = block.ends[mine], block.ends[mine + 1]
                met = stop > start
                if not met.any():
                    continue
                scores = block.scores([*zip(*(x[met].tolist() for x in (mine, start, stop)))])
                best = block.best(scores, -np.inf, block.rows if k is None else k)
                query.append(np.full(len(best), q))
                row.append(best)
                found.append(scores[best])
            if query:
                query, row, found = map(np.concatenate, (query, row, found))
                columns = [queries.take(pa.array(query)), ids.dictionary.take(pa.array(row)),
                           pa.array(np.round(found, SCORE_DIGITS) + 0.0)]
                yield pa.RecordBatch.from_arrays(
                    [c.cast(f.type) for c, f in zip(columns, arrow)], arrow.names
                )

    small_batches(spark)
    return (
        held.join(F.broadcast(weights.select("term").distinct()), "term", "left_semi")
        .join(F.broadcast(pairs.select("block").distinct()), "block", "left_semi")
        .select("block", "term", "frequency", "held")
        .repartition("block")
        .sortWithinPartitions("block")
        .mapInArrow(score, schema)
    )


def remaining_blocks(bounds: DataFrame, first: DataFrame, best: DataFrame, k: int) -> DataFrame:
    """Pairs beside the ``first`` ones whose bound reaches the k-th of the ``best`` scores."""
    query = bounds.columns[0]
    kth = best.filter(F.col("rank") == k).select(query, F.col("score").alias("kth"))
    return (
        bounds.join(first.select(query, "block"), [query, "block"], "left_anti")
        .join(kth, query, "left")
        .filter(F.col("kth").isNull() | (F.col("bound") * (1 + _MARGIN) + _MARGIN >= F.col("kth")))
        .drop("kth")
    )


def search_postings(
    postings: Postings,
    queries: DataFrame,
    k: int = 5,
    *,
    id_column: str = "source_id",
    query_column: str = "query_id",
    question_column: str = "question",
    k1: float = K1,
    b: float = B,
) -> DataFrame:
    """``query id, id, score, rank`` of the k best documents per question.

    The same rows as ``bm25_search`` over the documents. ``k1`` and ``b`` are free, as rows
    hold frequencies and lengths.
    """
    if k < 1:
        raise ValueError("k is below 1")
    asked = materialize(query_terms(queries, query_column, question_column))
    weights, bounds = block_bounds(postings, asked, query_column, k1, b)
    order = Window.partitionBy(query_column).orderBy(F.desc("bound"), "block")
    first = materialize(
        bounds.withColumn("nth", F.row_number().over(order))
        .filter(F.col("nth") <= FIRST_BLOCKS).drop("nth")
    )
    ranking = [F.desc("score"), F.asc("id")]
    scored = _scored(postings, weights, first, query_column, k1, b, k)
    best = materialize(rank_top_k(scored, query_column, ranking, k))
    rest = materialize(remaining_blocks(bounds, first, best, k))
    others = _scored(postings, weights, rest, query_column, k1, b, k)
    found = rank_top_k(best.drop("rank").unionByName(others), query_column, ranking, k)
    return found.withColumnRenamed("id", id_column)
