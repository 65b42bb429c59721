"""Exact top-k search by inner product over a vector-approximation file.

Every component of a vector is also kept as the number of a cell of equal integer width
between the least and the greatest value of its dimension. The cells alone give a lower and
an upper bound of a score. A search scans the cells, drops what cannot reach the k-th lower
bound, and reads exact vectors in the order of their bounds until the k-th result is certain.

Defined results: vectors that are null or hold null or non-finite components take no part, as
do rows without an id. Rows that share an id count as one, with the smallest of their vectors.
Shorter vectors are filled up with zeros (an empty vector is all zeros). Components have no
limit: blocks with one beyond ``WIDE`` are kept as they are and multiplied in Python's whole
numbers, without cells. A score beyond 64 bits is given as the nearest one the result's type
holds. Equal scores go by the smaller id. Empty tables give no rows; other columns of the
input are ignored.
"""

from __future__ import annotations

import math
import operator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from critiq.llm.blocks import (
    ABSENT, block_count, block_search, clean_vectors, packed_blocks,
)
from critiq.llm.common import packed, written

SCALE = 256
CELL_BITS = 6
DATA_ROWS = 8192
QUERY_ROWS = 1024
#: Vectors with a larger component have no place in the cells.
WIDE = float(1 << 22)
_AT_ONCE = 128


def whole_numbers(vectors: np.ndarray) -> np.ndarray:
    """floor(256 * x) of finite components, in 64-bit integers or in Python's."""
    if np.abs(vectors).max(initial=0.0) <= WIDE:
        return np.floor(vectors * SCALE).astype(np.int64)
    # Beyond 2^53 a component is whole by itself.
    exact = [math.floor(x * SCALE) if abs(x) < 2.0**53 else int(x) * SCALE for x in vectors.flat]
    made = np.empty(vectors.size, object)
    made[:] = exact
    return made.reshape(vectors.shape)


def search_wide(
    q: np.ndarray, q_ids: np.ndarray, exact: np.ndarray, ids: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """The k best (scores, ids) of one data block for every query, without cells."""
    edge = np.iinfo(np.int64)
    scores = np.full((len(q), k), edge.min, np.int64)
    found = np.full((len(q), k), ABSENT, np.int64)
    for i in range(len(q)):
        rows = np.flatnonzero(ids != q_ids[i])
        every = [sum(map(operator.mul, row, q[i].tolist())) for row in exact[rows].tolist()]
        best = sorted(zip(every, ids[rows].tolist()), key=lambda r: (-r[0], r[1]))[:k]
        scores[i, : len(best)] = [min(max(s, edge.min + 1), edge.max) for s, _ in best]
        found[i, : len(best)] = [n for _, n in best]
    return scores, found


def cells(vectors: np.ndarray, low: np.ndarray, width: np.ndarray) -> np.ndarray:
    return ((vectors - low) // width).astype(np.uint8)


def search_block(
    q: np.ndarray, q_ids: np.ndarray, codes: np.ndarray, exact: np.ndarray, ids: np.ndarray,
    low: np.ndarray, width: np.ndarray, k: int,
) -> tuple[np.ndarray, np.ndarray]:
    """The k best (scores, ids) of one data block for every query, own row left out.

    All sums are doubled, so that the middles of cells are whole numbers.
    """
    n = len(ids)
    scores = np.full((len(q), k), np.iinfo(np.int64).min, np.int64)
    found = np.full((len(q), k), ABSENT, np.int64)
    if n == 0:
        return scores, found
    middle = 2 * low + (2 * codes.astype(np.int64) + 1) * width - 1
    largest = int(np.abs(q).max(initial=0)) * int(np.abs(middle).max(initial=0)) * max(1, q.shape[1])
    kind = np.float32 if 2 * largest < 1 << 23 else np.float64 if 2 * largest < 1 << 52 else object
    middle = np.ascontiguousarray(middle.T.astype(kind))
    slack = np.abs(q).astype(kind) @ (width - 1).astype(kind)
    big = exact.astype(object) if kind is object else exact.astype(np.int64)
    for at in range(0, len(q), _AT_ONCE):
        part = slice(at, at + _AT_ONCE)
        about = q[part].astype(kind) @ middle
        if kind is object:
            about = about.astype(np.float64)
            spare = np.abs(about).max(initial=0.0) * 1e-9
        else:
            spare = 0
        place = np.searchsorted(ids, q_ids[part])
        own = np.minimum(place, n - 1)
        mine = ids[own] == q_ids[part]
        about[np.flatnonzero(mine), own[mine]] = -np.inf
        keep = min(k, n)
        least = np.partition(about, n - keep, axis=1)[:, n - keep]
        cut = (least - 2 * slack[part].astype(about.dtype) - spare)[:, None]
        some, where = np.nonzero((about >= cut) & (about > -np.inf))
        bounds = np.searchsorted(some, np.arange(len(about) + 1))
        for i in range(len(about)):
            cand = where[bounds[i] : bounds[i + 1]]
            if len(cand) == 0:
                continue
            upper = about[i, cand].astype(np.float64) + float(slack[at + i]) + spare
            order = np.argsort(-upper, kind="stable")
            cand, upper = cand[order], upper[order]
            best_s, best_i, read = np.zeros(0, big.dtype), np.zeros(0, np.int64), 0
            while read < len(cand):
                if len(best_s) >= k and 2 * best_s[k - 1] > upper[read]:
                    break
                more = cand[read : read + 4 * k]
                read += len(more)
                best_s = np.concatenate([best_s, big[more] @ q[at + i].astype(big.dtype)])
                best_i = np.concatenate([best_i, ids[more]])
                top = np.lexsort((best_i, -best_s))[:k]
                best_s, best_i = best_s[top], best_i[top]
            if big.dtype == object:
                edge = np.iinfo(np.int64)
                best_s = np.array([min(max(int(s), edge.min + 1), edge.max) for s in best_s])
            scores[at + i, : len(best_s)] = best_s
            found[at + i, : len(best_i)] = best_i
    return scores, found


def exact_topk(
    queries: DataFrame, data: DataFrame, k: int = 5, cell_bits: int = CELL_BITS,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """The k highest integer inner products of every query among all rows but its own.

    Returns query_id, rank, vec_id, score. The two tables need the same kind of ids: a row
    is a query's own if the ids are equal.
    """
    items = written(clean_vectors(data, id_col, vector_col))
    narrow = items.filter(F.forall("vec", lambda x: F.abs(x) <= WIDE))
    edges = (
        narrow.select(F.posexplode("vec").alias("dim", "x")).groupBy("dim")
        .agg(F.min(F.floor(F.col("x") * SCALE)).alias("low"), F.max(F.floor(F.col("x") * SCALE)).alias("high"))
        .orderBy("dim").collect()
    )
    sizes = items.agg(
        F.min(F.size("vec")).alias("n"), F.max(F.size("vec")).alias("most"),
        F.count("*").alias("rows"),
    ).first()
    dims = max(1, sizes.most or 0)
    # Dimensions that only vectors without cells have are zero in the others.
    rest = [0] * (dims - len(edges))
    low = np.array([r.low for r in edges] + rest, np.int64)
    high = np.array([r.high for r in edges] + rest, np.int64)
    if sizes.n is not None and sizes.n < dims:
        low, high = np.minimum(low, 0), np.maximum(high, 0)
    width = -((low - high - 1) // (1 << cell_bits))
    blocks = block_count(sizes.rows, DATA_ROWS)

    def pack_data(ids: np.ndarray, vectors: np.ndarray, _: int) -> dict:
        if np.abs(vectors).max(initial=0.0) > WIDE:
            return {"ids": packed(ids), "codes": b"", "exact": packed(vectors)}
        whole = whole_numbers(vectors)
        return {"ids": packed(ids), "codes": packed(cells(whole, low, width)),
                "exact": packed(whole.astype(np.int32))}

    def pack_queries(ids: np.ndarray, vectors: np.ndarray, _: int) -> dict:
        return {"ids": packed(ids), "exact": packed(vectors)}

    asked = clean_vectors(queries, id_col, vector_col)
    asked = asked.select("item", F.slice("vec", 1, dims).alias("vec"))
    q_blocks = block_count(asked.count(), QUERY_ROWS)

    def kernel(q: dict, d: dict) -> tuple[np.ndarray, np.ndarray]:
        asked = whole_numbers(np.frombuffer(q["exact"]).reshape(-1, dims))
        q_ids, ids = np.frombuffer(q["ids"], np.int64), np.frombuffer(d["ids"], np.int64)
        wide = len(ids) > 0 and not len(d["codes"])
        if wide:
            exact = whole_numbers(np.frombuffer(d["exact"]).reshape(-1, dims))
        else:
            exact = np.frombuffer(d["exact"], np.int32).reshape(-1, dims)
        if wide or asked.dtype == object:
            return search_wide(asked, q_ids, exact, ids, k)
        codes = np.frombuffer(d["codes"], np.uint8).reshape(-1, dims)
        return search_block(asked, q_ids, codes, exact, ids, low, width, k)

    return block_search(
        packed_blocks(asked, q_blocks, pack_queries, dims),
        packed_blocks(items, blocks, pack_data, dims),
        blocks, kernel, k, "long",
    )
