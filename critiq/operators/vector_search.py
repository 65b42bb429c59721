"""Exact nearest documents of a table of query vectors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from critiq.functions.text import casefold_label
from critiq.operators.scan_topk import (
    best_rows, query_passes, rank_top_k, scan, with_documents,
)

METRICS = ("l2", "cosine", "ip")
# Numbers in the query vectors that travel with a task in one pass.
CELLS_PER_PASS = 8_000_000
_CELLS = 4_000_000
_BLOCK = 256


@dataclass(frozen=True)
class Bound:
    """A filter of each question: ``limit`` in the query table limits ``column`` of the index.

    ``kind`` is "least" or "most" for numbers, "from" or "until" for dates, all inclusive, or
    "among" for an array of labels, compared case-folded; an empty array is no filter.
    """

    column: str
    limit: str
    kind: str

    def sides(self, number: int) -> tuple[Column, Column]:
        """What a row and a question are compared by."""
        value, limit = F.col(self.column), F.col(self.limit)
        if self.kind == "among":
            label, labels = casefold_label(value), F.transform(limit, casefold_label)
            return label.alias(f"_value{number}"), labels.alias(f"_limit{number}")
        if self.kind in ("from", "until"):
            value, limit = (F.unix_date(x.cast("date")) for x in (value, limit))
        elif self.kind not in ("least", "most"):
            raise ValueError("a bound is least, most, from, until or among")
        return (value.cast("double").alias(f"_value{number}"),
                limit.cast("double").alias(f"_limit{number}"))

    def values(self, column: pa.Array) -> np.ndarray:
        if self.kind == "among":
            return np.array(column.to_pylist(), object)
        return column.to_numpy(zero_copy_only=False).astype(np.float64)

    def limits(self, column: pa.ChunkedArray) -> np.ndarray:
        if self.kind == "among":
            made = np.empty(len(column), object)
            for i, labels in enumerate(column.to_pylist()):
                made[i] = frozenset(x for x in labels or () if x is not None) or None
                if labels and made[i] is None:
                    made[i] = frozenset()
            return made
        return column.to_numpy().astype(np.float64)

    def met(self, value: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """rows x questions"""
        if self.kind == "among":
            held = np.ones((len(value), len(limit)), bool)
            for j, labels in enumerate(limit):
                if labels is not None:
                    held[:, j] = [v is not None and v in labels for v in value]
            return held
        with np.errstate(invalid="ignore"):
            low = self.kind in ("least", "from")
            inside = value[:, None] >= limit if low else value[:, None] <= limit
        return inside | np.isnan(limit)


def _matrix(vectors: pa.Array) -> np.ndarray:
    rows = len(vectors)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if vectors.null_count or (rows and (len(flat) % rows or len(vectors[0]) * rows != len(flat))):
        raise ValueError("vectors must be present and of one length")
    return flat.reshape(rows, -1)


def _directions(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors; a zero vector stays zero, so that its cosine distance is 1."""
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, size, out=np.zeros_like(vectors), where=size > 0)


def _distances(
    rows: np.ndarray, queries: np.ndarray, metric: str, k: int, met: np.ndarray | None = None
) -> np.ndarray:
    """Distances rows x queries; pairs that cannot be among the k best are inf.

    ``met`` tells which pairs count at all.
    """
    if metric in ("ip", "cosine"):
        if metric == "cosine":
            rows, queries = _directions(rows), _directions(queries)
        out = 1.0 - rows @ queries.T
        if met is not None:
            out[~met] = np.inf
        return out
    # The expanded square loses digits to cancellation: use it, with a margin,
    # only to find the pairs worth the plain sum of squared differences.
    size = (rows**2).sum(axis=1)[:, None] + (queries**2).sum(axis=1)[None, :]
    rough = size - 2.0 * (rows @ queries.T)
    margin = 1e-12 * size
    if met is not None:
        rough[~met] = np.inf
    out = np.full(rough.shape, np.inf)
    limit = np.inf
    if len(rows) > k:
        limit = np.partition(rough + margin, k - 1, axis=0)[k - 1]
    close = rough - margin <= limit
    d, q = np.nonzero(close if met is None else close & met)
    for start in range(0, len(d), 65_536):
        i, j = d[start : start + 65_536], q[start : start + 65_536]
        out[i, j] = ((rows[i] - queries[j]) ** 2).sum(axis=1)
    return out


def vector_search(
    index: DataFrame,
    queries: DataFrame,
    k: int = 5,
    *,
    metric: str = "l2",
    id_column: str = "source_id",
    vector_column: str = "embedding",
    query_column: str = "query_id",
    query_vector_column: str = "embedding",
    cells_per_pass: int = CELLS_PER_PASS,
    bounds: Sequence[Bound] = (),
) -> DataFrame:
    """``query id, id, distance, rank`` of the k nearest rows per query.

    ``bounds`` are filters of each question: columns of ``queries`` that limit a
    column of ``index``, applied inside the one scan. A null bound is none; a
    null value meets no bound.

    Distance is the squared Euclidean distance by default, else ``1 - cosine``
    or ``1 - inner product``; ties go by ID. A zero vector has the cosine
    distance 1; pairs without a number for a distance are left out. Filter ``index`` beforehand: as
    every row is compared, filtering first and last give the same result, and
    first lets the condition reach the scan.
    """
    if k < 1:
        raise ValueError("k is below 1")
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {', '.join(METRICS)}")
    sides = [b.sides(i) for i, b in enumerate(bounds)]
    corpus = index.select(id_column, vector_column, *[value for value, _ in sides])
    wanted = queries.select(
        query_column, F.col(query_vector_column).alias("_vector"), *[limit for _, limit in sides]
    )
    best = [
        _search_pass(corpus, part, k, metric, id_column, query_column, bounds)
        for part in query_passes(wanted, query_column, _cells, cells_per_pass)
    ]
    nearest = reduce(DataFrame.unionByName, best).withColumn("distance", -F.col("score") + 0.0)
    return rank_top_k(
        nearest.drop("score"), query_column, [F.asc("distance"), F.asc(id_column)], k
    )


def _cells(queries: DataFrame) -> int:
    return queries.agg(F.coalesce(F.sum(F.size("_vector")), F.lit(0))).head()[0]


def _search_pass(
    corpus: DataFrame,
    queries: DataFrame,
    k: int,
    metric: str,
    id_column: str,
    query_column: str,
    bounds: Sequence[Bound] = (),
) -> DataFrame:
    table = queries.toArrow().combine_chunks()
    query_ids = pa.concat_arrays(table[query_column].chunks) if len(table) else pa.array(
        [], table.schema.field(query_column).type
    )
    vectors = np.zeros((0, 1))
    if len(table):
        vectors = _matrix(pa.concat_arrays(table["_vector"].chunks))
    limits = [b.limits(table[f"_limit{i}"]) for i, b in enumerate(bounds)]
    shared = corpus.sparkSession.sparkContext.broadcast((vectors, limits))

    def score(batches: Iterator[pa.RecordBatch]):
        every, limit_of = shared.value
        for batch in batches:
            if not len(batch) or not len(every):
                continue
            rows = _matrix(batch.column(1))
            values = [b.values(batch.column(2 + i)) for i, b in enumerate(bounds)]
            for first in range(0, len(every), _BLOCK):
                block = every[first : first + _BLOCK]
                step = max(1, _CELLS // max(len(block), rows.shape[1]))
                for start in range(0, len(rows), step):
                    part = rows[start : start + step]
                    met = None
                    for b, value, limit in zip(bounds, values, limit_of, strict=True):
                        fits = b.met(
                            value[start : start + len(part)], limit[first : first + _BLOCK]
                        )
                        met = fits if met is None else met & fits
                    distance = _distances(part, block, metric, k, met)
                    yield batch.column(0).slice(start, len(part)), first, -distance

    return scan(
        corpus, id_column, queries.schema[query_column], query_ids,
        lambda batches, query_count: best_rows(score(batches), query_count, k),
    )


def search(
    index: DataFrame,
    queries: DataFrame,
    k: int = 5,
    *,
    criteria=None,
    **options,
) -> DataFrame:
    """Filtered ``vector_search`` over an index table, with the matched documents.

    ``criteria`` is a ``ReviewFilter``; an index names its metadata columns in
    lower case, which Spark resolves to the same columns.
    """
    kept = index if criteria is None else index.filter(criteria.condition())
    id_column = options.get("id_column", "source_id")
    matches = vector_search(kept, queries, k, **options)
    shown = kept.drop(options.get("vector_column", "embedding"))
    return with_documents(matches, shown, id_column, k * queries.count())
