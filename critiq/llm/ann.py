"""Approximate nearest neighbours by inner product: multi-index hashing of learned codes.

Rows are dealt into ranges of the norm, each within a factor of the square root of two. In a
range, vectors are lengthened by one component so that all have the range's largest norm;
queries are scaled to it. Then the largest inner product is the smallest distance, whatever the
norms in other ranges. Both are centred at the range's mean, and rotations learned from a bounded
sample of the range (``SAMPLE_ROWS`` rows, by hash of the id) turn them into binary codes:
principal directions, then alternating steps that bring the rotated sample near its signs. A
code is split into substrings. Every segment of a range has one table per substring, from the
substring's value to the rows that have it. A query looks up every value within
``PROBE_RADIUS`` bits of its own in every table. By the pigeonhole principle this retrieves
every code within ``TABLES * (PROBE_RADIUS + 1) - 1`` bits of the query's, and many beyond.
Retrieved rows are put in the order of their whole codes' distance; in that order their original
vectors are read and ranked, in batches of ``BATCH`` times k, until the k-th score stays the
same over ``PATIENCE`` batches. Where a segment gives fewer than k rows, the radius grows until
it gives k or is read whole. Every row is indexed, buckets have no
cap, and a bucket that holds most rows only makes a segment's scan longer, as rows are never
paired outside a task.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take
no part, as do rows without an id. Rows that share an id count as one, with the smallest of
their vectors; shorter vectors are filled up with zeros. Equal scores go by the smaller id.
Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from critiq.llm.blocks import ABSENT, block_count, block_search, clean_vectors, packed_blocks
from critiq.llm.common import hash_fraction, packed, written

TABLES = 36
PROBE_RADIUS = 2
SEGMENT_ROWS = 8192
QUERY_ROWS = 1024
SAMPLE_ROWS = 4096
BATCH = 2
PATIENCE = 4
#: Rounding of a norm that must not part equal vectors.
NORM_SLACK = 1e-6
LEARN_STEPS = 20


def learn_rotations(sample: np.ndarray, bits: int, seed: int = 7) -> np.ndarray:
    """Projection matrix (dims x bits): rotations of the principal directions, learned in turn."""
    rng = np.random.default_rng(seed)
    dims = sample.shape[1]
    values, axes = np.linalg.eigh(sample.T @ sample + 1e-9 * np.eye(dims))
    axes = axes[:, ::-1]
    reduced = sample @ axes
    made = []
    for _ in range(-(-bits // dims)):
        turn, _ = np.linalg.qr(rng.standard_normal((dims, dims)))
        for _ in range(LEARN_STEPS):
            signs = np.where(reduced @ turn >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(signs.T @ reduced)
            turn = (left @ right).T
        made.append(axes @ turn)
    return np.hstack(made)[:, :bits].astype(np.float32)


def code_bits(vectors: np.ndarray, rotations: np.ndarray) -> np.ndarray:
    return vectors.astype(np.float32) @ rotations >= 0


def substrings(bits: np.ndarray, width: int) -> np.ndarray:
    """Values (rows x tables) of the codes' substrings."""
    parts = bits.reshape(len(bits), -1, width)
    return parts @ (1 << np.arange(width, dtype=np.int64)[::-1])


def packed_codes(bits: np.ndarray) -> np.ndarray:
    """Codes in 64-bit words (rows x words)."""
    eighths = np.packbits(bits, axis=1)
    whole = np.zeros((len(bits), -(-eighths.shape[1] // 8) * 8), np.uint8)
    whole[:, : eighths.shape[1]] = eighths
    return whole.view(np.uint64)


def lookup_masks(width: int, radius: int) -> np.ndarray:
    """All differences of at most ``radius`` bits."""
    made = [0]
    for r in range(1, min(radius, width) + 1):
        made += [sum(1 << b for b in bits) for bits in combinations(range(width), r)]
    return np.array(made, np.int64)


@cache
def growing_masks(width: int, radius: int) -> list[np.ndarray]:
    """``lookup_masks`` of every radius from the given one up to all values."""
    every = np.arange(1 << width, dtype=np.int64)
    bits = sum((every >> b) & 1 for b in range(width))
    every = every[np.argsort(bits, kind="stable")]
    ends = np.cumsum(np.bincount(bits))
    return [every[:end] for end in ends[min(radius, width) :]]


def segment_tables(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Per table the rows in the order of their value, and where each value begins."""
    rows, begins = [], []
    for column in values.T:
        rows.append(np.argsort(column, kind="stable").astype(np.int32))
        counts = np.bincount(column, minlength=1 << width)
        begins.append(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    return np.array(rows), np.array(begins)


def probe(value: np.ndarray, rows: np.ndarray, begins: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Rows of a segment that share a bucket within reach with the query, ascending."""
    keys = value[:, None] ^ masks[None, :]
    table = np.broadcast_to(np.arange(len(value))[:, None], keys.shape)
    start, end = begins[table, keys], begins[table, keys + 1]
    filled = end > start
    start, size = start[filled], (end - start)[filled]
    start = start + table[filled] * rows.shape[1]
    places = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
    seen = np.zeros(rows.shape[1], bool)
    seen[rows.ravel()[places]] = True
    return np.flatnonzero(seen)


def search_segment(
    q: np.ndarray, q_ids: np.ndarray, q_values: np.ndarray, q_codes: np.ndarray,
    vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, begins: np.ndarray,
    codes: np.ndarray, masks: list[np.ndarray], k: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows for every query, and how many vectors were read for it.

    ``masks`` are those of growing radius, the last of all values.
    """
    scores = np.full((len(q), k), -np.inf)
    found = np.full((len(q), k), ABSENT, np.int64)
    read = np.zeros(len(q), np.int64)
    for i in range(len(q)):
        for reach in masks:
            near = probe(q_values[i], rows, begins, reach)
            near = near[ids[near] != q_ids[i]]
            if len(near) >= k or len(near) >= len(ids) - 1:
                break
        apart = np.bitwise_count(codes[near] ^ q_codes[i]).sum(axis=1, dtype=np.int64)
        near = near[np.lexsort((ids[near], apart))]
        best, best_ids, kth, same = np.zeros(0), np.zeros(0, np.int64), -np.inf, 0
        while read[i] < len(near) and same < PATIENCE:
            part = near[read[i] : read[i] + BATCH * k]
            read[i] += len(part)
            best = np.concatenate([best, vectors[part] @ q[i]])
            best_ids = np.concatenate([best_ids, ids[part]])
            order = np.lexsort((best_ids, -best))[:k]
            best, best_ids = best[order], best_ids[order]
            if len(best) == k:
                same = same + 1 if best[-1] == kth else 0
                kth = best[-1]
        scores[i, : len(best)], found[i, : len(best)] = best, best_ids
    return scores, found, read


@dataclass
class NormRange:
    """Codes of the rows whose squared norms have the same binary exponent."""

    longest: float
    width: int
    blocks: int
    first: int  # number of the first segment
    centre: np.ndarray | None = None
    rotations: np.ndarray | None = None

    def longer(self, vectors: np.ndarray) -> np.ndarray:
        size = (vectors**2).sum(1)
        rest = np.sqrt(np.maximum(0.0, self.longest - size))[:, None]
        return np.hstack([vectors, rest])

    def learned(self, sample: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Centre and rotations; without finite squares all rows get the same code."""
        wide = self.longer(sample)
        centre = wide.mean(0) if len(wide) else np.zeros(wide.shape[1])
        if not np.isfinite(wide).all() or not np.isfinite(self.longest):
            return np.zeros(wide.shape[1]), np.zeros((wide.shape[1], bits), np.float32)
        unit = math.sqrt(self.longest) or 1.0
        return centre, learn_rotations((wide - centre) / unit, bits)

    def data_bits(self, vectors: np.ndarray) -> np.ndarray:
        return self.bits(self.longer(vectors))

    def query_bits(self, vectors: np.ndarray) -> np.ndarray:
        size = np.sqrt((vectors**2).sum(1))[:, None]
        scaled = vectors * (math.sqrt(self.longest) / np.where(size > 0, size, 1.0))
        return self.bits(np.hstack([scaled, np.zeros_like(size)]))

    def bits(self, wide: np.ndarray) -> np.ndarray:
        unit = math.sqrt(self.longest) or 1.0
        return code_bits((wide - self.centre) / unit, self.rotations)


def norm_ranges(items: DataFrame, dims: int, tables: int) -> dict[int, NormRange]:
    """Ranges by the binary exponent of the squared norm (column ``power``) of all rows."""
    facts = items.groupBy("power").agg(
        F.count("*").alias("rows"), F.max("size").alias("longest")
    ).orderBy("power").collect()
    ranges: dict[int, NormRange] = {}
    first = 0
    for r in facts:
        blocks = block_count(r.rows, SEGMENT_ROWS)
        width = min(16, max(4, int(math.log2(max(2, r.rows / blocks)))))
        ranges[r.power] = NormRange(r.longest, width, blocks, first)
        first += blocks
    if not facts:
        return ranges
    taken = F.lit(False)
    for r in facts:
        some = hash_fraction(F.col("item"), SAMPLE_ROWS / r.rows, "ann")
        taken = F.when(F.col("power") == r.power, some).otherwise(taken)

    def learn(key: tuple, table: pa.Table) -> pa.Table:
        power = key[0].as_py()
        sample = np.zeros((table.num_rows, dims))
        order = np.argsort(table["item"].to_numpy(), kind="stable")
        for i, j in enumerate(order):
            vec = table["vec"][int(j)].as_py()
            sample[i, : len(vec)] = vec
        centre, turned = ranges[power].learned(sample, tables * ranges[power].width)
        return pa.table({
            "power": pa.array([power], pa.int32()), "centre": pa.array([packed(centre)]),
            "rotations": pa.array([packed(turned)]),
        })

    learned = items.filter(taken).select("power", "item", "vec").groupBy("power").applyInArrow(
        learn, "power int, centre binary, rotations binary"
    )
    for r in learned.collect():
        ranges[r.power].centre = np.frombuffer(r.centre, np.float64)
        ranges[r.power].rotations = np.frombuffer(r.rotations, np.float32).reshape(dims + 1, -1)
    for x in ranges.values():
        if x.rotations is None:  # no row was sampled
            x.centre, x.rotations = x.learned(np.zeros((0, dims)), tables * x.width)
    return ranges


def nearest(
    queries: DataFrame, data: DataFrame, k: int = 20, tables: int = TABLES,
    radius: int = PROBE_RADIUS, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """The k nearest rows found for every query: query_id, rank, vec_id, score."""
    alive = F.exists("vec", lambda x: x != 0)
    size = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    items = clean_vectors(data, id_col, vector_col).filter(alive).withColumn("size", size)
    slack = F.greatest("size", F.lit(5e-324)) * (1 + NORM_SLACK)
    power = F.floor(F.log2(slack)).cast("int")
    items = written(items.withColumn("power", power))
    dims = items.agg(F.max(F.size("vec"))).first()[0] or 1
    ranges = norm_ranges(items, dims, tables)
    blocks = max(1, sum(r.blocks for r in ranges.values()))
    shared = items.sparkSession.sparkContext.broadcast(ranges)
    segment, range_of = F.lit(0), {0: next(iter(ranges), 0)}
    for p, r in ranges.items():
        place = F.lit(r.first) + F.pmod(F.xxhash64("item"), F.lit(r.blocks)).cast("int")
        segment = F.when(F.col("power") == p, place).otherwise(segment)
        range_of |= {r.first + i: p for i in range(r.blocks)}

    def pack_data(ids: np.ndarray, vectors: np.ndarray, number: int) -> dict:
        names = "ids", "vectors", "rows", "begins", "codes", "power"
        own = shared.value.get(range_of[number])
        if own is None:
            return dict.fromkeys(names, b"")
        bits = own.data_bits(vectors)
        rows, begins = segment_tables(substrings(bits, own.width), own.width)
        held = ids, vectors, rows, begins, packed_codes(bits), np.array([range_of[number]])
        return {n: packed(x) for n, x in zip(names, held, strict=True)}

    def pack_queries(ids: np.ndarray, vectors: np.ndarray, _: int) -> dict:
        return {"ids": packed(ids), "vectors": packed(vectors)}

    def kernel(q: dict, d: dict) -> tuple[np.ndarray, np.ndarray]:
        ids = np.frombuffer(d["ids"], np.int64)
        own = shared.value[int(np.frombuffer(d["power"], np.int64)[0])]
        asked = np.frombuffer(q["vectors"], np.float64).reshape(-1, dims)
        bits = own.query_bits(asked)
        scores, found, _ = search_segment(
            asked, np.frombuffer(q["ids"], np.int64), substrings(bits, own.width),
            packed_codes(bits), np.frombuffer(d["vectors"], np.float64).reshape(-1, dims), ids,
            np.frombuffer(d["rows"], np.int32).reshape(tables, len(ids)),
            np.frombuffer(d["begins"], np.int32).reshape(tables, -1),
            np.frombuffer(d["codes"], np.uint64).reshape(len(ids), -1),
            growing_masks(own.width, radius), k,
        )
        return scores, found

    asked = clean_vectors(queries, id_col, vector_col).filter(alive)
    asked = asked.select("item", F.slice("vec", 1, dims).alias("vec"))
    q_blocks = block_count(asked.count(), QUERY_ROWS)
    return block_search(
        packed_blocks(asked, q_blocks, pack_queries, dims),
        packed_blocks(items.select("item", "vec", "power"), blocks, pack_data, dims, segment),
        blocks, kernel, k, "double",
    )
