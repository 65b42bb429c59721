"""Exact top-k of every query in one scan of a corpus.

The queries of one pass are small enough to travel with each task, so that the
corpus is read where it lies and is never shuffled. A task keeps its k best rows
per query while it reads; only those are exchanged and ranked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from critiq.session import small_batches

# Scores are compared after rounding, so that the order of float sums is not seen.
SCORE_DIGITS = 9
# Rows of IDs and numbers, about a hundred bytes each.
BROADCAST_MATCHES = 500_000


def query_passes(
    queries: DataFrame,
    key: str,
    size: Callable[[DataFrame], int],
    bound: int,
    level: int = 0,
) -> Iterator[DataFrame]:
    """Split queries by a hash of their key until each part is within ``bound``.

    Parts are measured, not assumed. Only a single query may exceed the bound.
    """
    total = size(queries)
    if total <= bound or queries.select(key).distinct().limit(2).count() < 2:
        yield queries
        return
    count = -(-2 * total // bound)
    slot = F.pmod(F.xxhash64(key, F.lit(level)), F.lit(count))
    for number in range(count):
        yield from query_passes(queries.filter(slot == number), key, size, bound, level + 1)


def _kept_best(
    kept: dict[int, pd.DataFrame],
    first: int,
    fresh: pd.DataFrame,
    floor: np.ndarray,
    k: int,
) -> None:
    """Take ``q, score, id`` rows in among the k best of the queries from ``first`` on.

    ``floor`` is raised to the k-th score of queries that have one.
    """
    both = pd.concat([kept[first], fresh]) if first in kept else fresh
    ranked = both.sort_values(["q", "score", "id"], ascending=[True, False, True])
    place = ranked.groupby("q").cumcount()
    full = ranked[place == k - 1]
    floor[full["q"].to_numpy()] = full["score"].to_numpy()
    kept[first] = ranked[place < k]


def _rows(ids: pa.Array, row: np.ndarray, query: np.ndarray, score: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame(
        {"q": query, "score": score, "id": ids.take(pa.array(row)).to_pandas().astype(object)}
    )


def best_rows(
    scored: Iterable[tuple[pa.Array, int, np.ndarray]],
    query_count: int,
    k: int,
) -> pd.DataFrame:
    """k best ``(q, score, id)`` per query of a stream of score matrices.

    Each item is (row IDs, number of the first query, rows x queries scores);
    larger is better and ``-inf`` leaves a pair out. Equal scores go by ID.
    """
    kept: dict[int, pd.DataFrame] = {}
    floor = np.full(query_count, -np.inf)
    for ids, first, scores in scored:
        scores = np.round(scores, SCORE_DIGITS) + 0.0
        scores[np.isnan(scores)] = -np.inf
        rows, width = scores.shape
        low = floor[first : first + width]
        if rows > k:
            low = np.maximum(low, np.partition(scores, rows - k, axis=0)[rows - k])
        d, q = np.nonzero((scores >= low) & np.isfinite(scores))
        if len(d):
            _kept_best(kept, first, _rows(ids, d, q + first, scores[d, q]), floor, k)
    return pd.concat(kept.values()) if kept else pd.DataFrame()


def best_hits(
    found: Iterable[tuple[pa.Array, int, np.ndarray, np.ndarray, np.ndarray]],
    floor: np.ndarray,
    k: int,
) -> pd.DataFrame:
    """k best ``(q, score, id)`` per query of a stream of single hits.

    Each item is (row IDs, number of the first query of its group, and per hit its row,
    query and score). Between items ``floor`` is raised to the k-th score of each query.
    """
    kept: dict[int, pd.DataFrame] = {}
    for ids, first, row, query, score in found:
        score = np.round(score, SCORE_DIGITS) + 0.0
        if len(row):
            _kept_best(kept, first, _rows(ids, row, query, score), floor, k)
    return pd.concat(kept.values()) if kept else pd.DataFrame()


def scan(
    corpus: DataFrame,
    id_column: str,
    query_field: StructField,
    query_ids: pa.Array,
    best_of: Callable[[Iterator[pa.RecordBatch], int], pd.DataFrame],
) -> DataFrame:
    """Task-level best rows as ``query id, id_column, score``.

    ``best_of`` gets a task's batches and the number of queries; it gives ``q, score, id``.
    """
    schema = StructType(
        [query_field, corpus.schema[id_column], StructField("score", DoubleType())]
    )
    arrow = to_arrow_schema(schema)
    shared_ids = corpus.sparkSession.sparkContext.broadcast(query_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_queries = shared_ids.value
        best = best_of(batches, len(all_queries))
        if len(best):
            columns = [
                all_queries.take(pa.array(best["q"].to_numpy(np.int64))).cast(arrow[0].type),
                pa.array(best["id"].tolist(), arrow[1].type),
                pa.array(best["score"].to_numpy(np.float64), arrow[2].type),
            ]
            yield pa.RecordBatch.from_arrays(columns, arrow.names)

    small_batches(corpus.sparkSession)
    return corpus.mapInArrow(run, schema)


def with_documents(
    matches: DataFrame, documents: DataFrame, id_column: str, match_rows: int
) -> DataFrame:
    """Matches with the columns of their documents.

    ``match_rows`` bounds the matches: k rows per question. Up to a checked bound
    they are sent to the documents, which then are read but not exchanged.
    """
    small = F.broadcast(matches) if match_rows <= BROADCAST_MATCHES else matches
    return documents.join(small, id_column)


def rank_top_k(scored: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows per group in a total order, with their ``rank``."""
    if k < 1:
        raise ValueError("k is below 1")
    window = Window.partitionBy(group).orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)
