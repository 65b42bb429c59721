"""Exact nearest rows from a stored index of cells, of which a search reads the near ones only.

Vectors are dealt to the nearest of some centres, which are found on a bounded sample; where
they lie decides what is read, never what is found. A cell's rows are stored in blocks in the
order of their distance to the centre, each block with the least and the largest such
distance. By the triangle inequality a block whose ring is farther from a question than its
k-th row so far can't hold a nearer row.

A search compares each question with the nearest cells that together hold k rows, passes the
k-th distance on, and then reads those blocks of other cells that may hold a nearer one. The
centres travel with the tasks (at most ``MAX_CELLS``); questions are sent to the blocks while
they are few by count, else both are exchanged by cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, FloatType

from critiq.operators.scan_topk import best_rows, rank_top_k
from critiq.operators.vector_search import METRICS, _directions, _distances, _matrix
from critiq.session import materialize

ROWS_PER_CELL = 2048
MAX_CELLS = 1024
SAMPLE_PER_CELL = 32
ROWS_PER_BLOCK = 1024
QUERIES_PER_CHUNK = 256
#: Numbers in question vectors that are sent to all tasks.
BROADCAST_CELLS = 16_000_000
#: Cell of rows without a direction or without finite numbers; every search reads it.
ODD = -1
_ROUNDS = 6
_SLACK = 1e-9


@dataclass(frozen=True)
class Rings:
    """Centre, radius and rows of each cell in the order of ``numbers``; sent to tasks."""

    numbers: np.ndarray
    centres: np.ndarray
    radius: np.ndarray
    rows: np.ndarray
    directions: bool
    single: bool


@dataclass(frozen=True)
class Cells:
    blocks: DataFrame
    rings: Rings


def _nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    rough = (centres**2).sum(axis=1)[None, :] - 2.0 * (vectors @ centres.T)
    return rough.argmin(axis=1)


def _centres(sample: np.ndarray, count: int) -> np.ndarray:
    """Means of a few rounds over the sample; a centre without rows moves to a far row."""
    rng = np.random.default_rng(11)
    distinct = np.unique(sample, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:count]].copy()
    for _ in range(_ROUNDS):
        place = _nearest(sample, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, place, sample)
        held = np.bincount(place, minlength=len(centres))
        used = held > 0
        centres[used] = sums[used] / held[used, None]
        if not used.all():
            far = ((sample - centres[place]) ** 2).sum(axis=1).argsort()[::-1]
            centres[~used] = sample[far[: (~used).sum()]]
    return centres


def write_cells(
    index: DataFrame,
    path: str,
    *,
    id_column: str = "source_id",
    vector_column: str = "embedding",
    directions: bool = False,
    rows_per_cell: int = ROWS_PER_CELL,
) -> Cells:
    """Store the vectors of an index by cell in a new folder; its head is written last.

    ``directions`` deals by direction, as a search by cosine needs. Vectors must be present
    and of one length.
    """
    spark = index.sparkSession
    rows = index.select(F.col(id_column).alias("id"), F.col(vector_column).alias("vector"))
    count = rows.count()
    wanted = min(MAX_CELLS, max(1, -(-count // rows_per_cell)))
    taken = (
        rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_PER_CELL * wanted)
        .select(F.col("vector").cast("array<double>").alias("vector")).toArrow()
    )["vector"].combine_chunks()
    sample = _usable(_matrix(taken), directions)[1] if count else np.zeros((0, 1))
    sample = sample if len(sample) else np.zeros((1, sample.shape[1]))
    shared = spark.sparkContext.broadcast(_centres(sample, wanted))
    single = rows.schema["vector"].dataType == ArrayType(FloatType(), True)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        for batch in batches:
            if not len(batch):
                continue
            vectors = _matrix(batch.column(1))
            fine, usable = _usable(vectors, directions)
            cell, distance = np.full(len(vectors), ODD), np.zeros(len(vectors))
            cell[fine] = _nearest(usable, centres) if len(usable) else 0
            distance[fine] = np.linalg.norm(usable - centres[cell[fine]], axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell, pa.int32()), pa.array(distance)],
                names=["id", "vector", "cell", "distance"],
            )

    id_type = rows.schema["id"].dataType
    kind = f"id {id_type.simpleString()}, vector {rows.schema['vector'].dataType.simpleString()}"
    # The hint lets a cell with very many rows be split over tasks.
    dealt = rows.mapInArrow(place, f"{kind}, cell int, distance double").hint("rebalance", "cell")
    packed = dealt.sortWithinPartitions("cell", "distance").mapInArrow(
        _packer(to_arrow_type(id_type), "<f4" if single else "<f8"),
        f"cell int, near double, far double, held int, ids array<{id_type.simpleString()}>, "
        "vectors binary",
    )
    packed.write.partitionBy("cell").parquet(f"{path}/blocks")
    if count:
        found = spark.read.parquet(f"{path}/blocks").groupBy("cell").agg(
            F.max("far").alias("radius"), F.sum("held").alias("rows")
        ).collect()  # one row per cell
    else:
        found = []
    centres = shared.value
    head = [
        (int(r["cell"]), centres[r["cell"]].tolist() if r["cell"] != ODD else None, r["radius"],
         r["rows"], directions, single)
        for r in found
    ]
    spark.createDataFrame(head, _HEAD).coalesce(1).write.parquet(f"{path}/head")
    return read_cells(spark, path)


_HEAD = (
    "cell int, centre array<double>, radius double, rows bigint, directions boolean, "
    "single boolean"
)


def read_cells(spark: SparkSession, path: str) -> Cells:
    head = spark.read.schema(_HEAD).parquet(f"{path}/head").orderBy("cell").collect()
    if not head:
        nothing = np.zeros(0)
        return Cells(
            None, Rings(np.zeros(0, int), np.zeros((0, 1)), nothing, nothing, False, False)
        )
    dims = next((len(r["centre"]) for r in head if r["centre"] is not None), 1)
    rings = Rings(
        np.array([r["cell"] for r in head]),
        np.array([r["centre"] or [0.0] * dims for r in head]),
        # Nothing is ever too far from the cell of odd rows.
        np.array([np.inf if r["cell"] == ODD else r["radius"] for r in head]),
        np.array([r["rows"] for r in head]),
        head[0]["directions"],
        head[0]["single"],
    )
    return Cells(spark.read.parquet(f"{path}/blocks"), rings)


def _usable(vectors: np.ndarray, directions: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which rows can be dealt, and those rows."""
    with np.errstate(over="ignore", invalid="ignore"):
        size = np.linalg.norm(vectors, axis=1)
    fine = np.isfinite(size) & ((size > 0) | (not directions))
    return fine, _directions(vectors[fine]) if directions else vectors[fine]


def _packer(id_type: pa.DataType, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(parts).combine_chunks()
            distance = rows["distance"].to_numpy()
            vectors = _matrix(rows["vector"].combine_chunks()).astype(kind)
            ids = pa.ListArray.from_arrays(
                pa.array([0, len(rows)], pa.int32()), rows["id"].combine_chunks().cast(id_type)
            )
            return pa.RecordBatch.from_arrays(
                [rows["cell"].combine_chunks()[:1], pa.array([distance[0]]),
                 pa.array([distance[-1]]), pa.array([len(rows)], pa.int32()), ids,
                 pa.array([vectors.tobytes()], pa.binary())],
                names=["cell", "near", "far", "held", "ids", "vectors"],
            )

        for batch in batches:
            cell = batch.column(2).to_numpy()
            ends = [*(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)] if len(cell) else []
            first = 0
            for end in ends:
                if held and held[0].column(2)[0].as_py() != cell[first]:
                    yield block(held)
                    held = []
                while first < end:
                    room = ROWS_PER_BLOCK - sum(len(h) for h in held)
                    held.append(batch.slice(first, min(room, end - first)))
                    first += len(held[-1])
                    if sum(len(h) for h in held) == ROWS_PER_BLOCK:
                        yield block(held)
                        held = []
        if held:
            yield block(held)

    return run


def _least(metric: str, queries: np.ndarray, centres: np.ndarray, near, far) -> np.ndarray:
    """Lower bounds of the distance, questions x rings.

    ``queries`` are directions where the cells are. Infinite rings have no bound.
    """
    size = np.linalg.norm(queries, axis=1)[:, None]
    slack = _SLACK * (1 + size + np.linalg.norm(centres, axis=1)[None, :])
    with np.errstate(invalid="ignore"):
        if metric == "ip":
            bound = 1.0 - (queries @ centres.T + size * far) - slack * (1 + size)
        else:
            apart = np.stack([np.linalg.norm(centres - q, axis=1) for q in queries])
            gap = np.maximum(np.maximum(apart - far, near - apart) - slack, 0.0)
            bound = gap**2 / (2.0 if metric == "cosine" else 1.0)
    return np.where(np.isinf(far), -np.inf, bound)


def _requests(rings: Rings, queries: DataFrame, metric: str, k: int, first: bool) -> DataFrame:
    """``query, vector, kth, cell`` of cells to read.

    First the nearest cells that hold k rows together; then, with ``kth`` known, the others
    that may hold a nearer row.
    """
    numbers, centres, radius, rows = rings.numbers, rings.centres, rings.radius, rings.rows
    query_type = to_arrow_type(queries.schema["query"].dataType)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            vectors = _matrix(batch.column("vector"))
            asked = _directions(vectors) if rings.directions else vectors
            least = _least(metric, asked, centres, np.zeros(len(radius)), radius)
            # Nearest by centre, so that the first cells are good ones inside their rings too.
            order = np.argsort(_least(metric, asked, centres, 0.0, np.zeros(len(radius))), axis=1)
            odd = numbers[order] == ODD
            many = np.where(odd, 0, rows[order])
            before = np.cumsum(many, axis=1) - many
            near = np.zeros(least.shape, bool)
            np.put_along_axis(near, order, (before < k) | odd, axis=1)
            chosen = near
            if not first:
                kth = batch.column("kth").to_numpy(zero_copy_only=False).astype(np.float64)
                kth = np.where(np.isnan(kth), np.inf, kth)
                chosen = ~near & (least <= kth[:, None] + _SLACK)
            q, c = np.nonzero(chosen)
            yield pa.RecordBatch.from_arrays(
                [batch.column("query").take(pa.array(q)).cast(query_type),
                 batch.column("vector").take(pa.array(q)), batch.column("kth").take(pa.array(q)),
                 pa.array(numbers[c], pa.int32())],
                names=["query", "vector", "kth", "cell"],
            )

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema)
    return queries.mapInArrow(choose, f"{fields}, cell int")


def _packed_requests(requests: DataFrame, chunks: int) -> DataFrame:
    """Questions of a cell in chunks: ``cell, queries, kths, asked``."""
    query_type = requests.schema["query"].dataType.simpleString()
    arrow_type = to_arrow_type(requests.schema["query"].dataType)

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        vectors = _matrix(table["vector"].combine_chunks())
        kths = table["kth"].to_numpy()
        kths = np.where(np.isnan(kths.astype(np.float64)), np.inf, kths.astype(np.float64))
        queries = pa.ListArray.from_arrays(
            pa.array([0, len(table)], pa.int32()), table["query"].combine_chunks().cast(arrow_type)
        )
        return pa.table({
            "cell": pa.array([key[0].as_py()], pa.int32()), "queries": queries,
            "kths": pa.array([kths.tobytes()], pa.binary()),
            "asked": pa.array([vectors.tobytes()], pa.binary()),
        })

    chunk = F.pmod(F.xxhash64("query"), F.lit(chunks))
    return requests.withColumn("chunk", chunk).groupBy("cell", "chunk").applyInArrow(
        pack, f"cell int, queries array<{query_type}>, kths binary, asked binary"
    )


def _compared(
    cells: Cells, requests: DataFrame, metric: str, k: int, chunks: int, dims: int
) -> DataFrame:
    """``query, id, distance`` of the k best rows per question and block read."""
    wanted = [r[0] for r in requests.select("cell").distinct().collect()]  # at most MAX_CELLS
    small = requests.count() * dims <= BROADCAST_CELLS
    asked = materialize(_packed_requests(requests, chunks))
    blocks = cells.blocks.filter(F.col("cell").isin(wanted))
    pairs = blocks.join(F.broadcast(asked) if small else asked, "cell").select(
        "cell", "near", "far", "ids", "vectors", "queries", "kths", "asked"
    )
    rings = cells.rings
    number = {int(n): i for i, n in enumerate(rings.numbers)}
    query_field, id_field = asked.schema["queries"].dataType, cells.blocks.schema["ids"].dataType
    query_type, id_type = (to_arrow_type(f.elementType) for f in (query_field, id_field))
    kind = "<f4" if rings.single else "<f8"

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cell, near, far = (batch.column(j)[i].as_py() for j in range(3))
                ids, queries = batch.column(3)[i].values, batch.column(5)[i].values
                kths = np.frombuffer(batch.column(6)[i].as_buffer())
                every = np.frombuffer(batch.column(7)[i].as_buffer()).reshape(len(kths), -1)
                odd = cell == ODD
                centre = rings.centres[number[cell]][None, :]
                directed = _directions(every) if rings.directions else every
                ring = np.array([0.0 if odd else near]), np.array([np.inf if odd else far])
                least = _least(metric, directed, centre, *ring)[:, 0]
                chosen = np.flatnonzero(least <= kths + _SLACK)
                if not len(chosen):
                    continue
                rows = np.frombuffer(batch.column(4)[i].as_buffer(), kind).astype(np.float64)
                rows = rows.reshape(len(ids), -1)
                distance = _distances(rows, every[chosen], metric, k)
                best = best_rows([(ids, 0, -distance)], len(chosen), k)
                if not len(best):
                    continue
                place = chosen[best["q"].to_numpy(np.int64)]
                yield pa.RecordBatch.from_arrays(
                    [queries.take(pa.array(place)).cast(query_type),
                     pa.array(best["id"].tolist(), id_type),
                     pa.array(-best["score"].to_numpy(np.float64) + 0.0)],
                    names=["query", "id", "distance"],
                )

    return pairs.mapInArrow(
        compare,
        f"query {query_field.elementType.simpleString()}, "
        f"id {id_field.elementType.simpleString()}, distance double",
    )


def requested_cells(
    cells: Cells, queries: DataFrame, k: int, metric: str = "l2"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Requests of both steps and the rows found by the first; ``queries``: query, vector."""
    asked = queries.withColumn("kth", F.lit(None).cast("double"))
    chunks, dims = _shape(cells, queries)
    first = materialize(_requests(cells.rings, asked, metric, k, True))
    ranking = [F.asc("distance"), F.asc("id")]
    found = materialize(
        rank_top_k(_compared(cells, first, metric, k, chunks, dims), "query", ranking, k)
    )
    kth = found.filter(F.col("rank") == k).select("query", F.col("distance").alias("kth"))
    known = queries.join(kth, "query", "left").select("query", "vector", "kth")
    return first, materialize(_requests(cells.rings, known, metric, k, False)), found


def _shape(cells: Cells, queries: DataFrame) -> tuple[int, int]:
    return max(1, -(-queries.count() // QUERIES_PER_CHUNK)), cells.rings.centres.shape[1]


def search_cells(
    cells: Cells,
    queries: DataFrame,
    k: int = 5,
    *,
    metric: str = "l2",
    id_column: str = "source_id",
    query_column: str = "query_id",
    query_vector_column: str = "embedding",
) -> DataFrame:
    """``query id, id, distance, rank`` of the k nearest rows per query.

    The same rows as ``vector_search`` over the index.
    """
    if k < 1:
        raise ValueError("k is below 1")
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {', '.join(METRICS)}")
    if len(cells.rings.numbers) and cells.rings.directions != (metric == "cosine"):
        raise ValueError("cosine needs cells of directions, other metrics cells of vectors")
    if not len(cells.rings.numbers):
        raise ValueError("the index has no rows")
    wanted = materialize(
        queries.select(
            F.col(query_column).alias("query"),
            F.col(query_vector_column).cast("array<double>").alias("vector"),
        )
    )
    _, others, found = requested_cells(cells, wanted, k, metric)
    chunks, dims = _shape(cells, wanted)
    more = _compared(cells, others, metric, k, chunks, dims)
    ranking = [F.asc("distance"), F.asc("id")]
    best = rank_top_k(found.drop("rank").unionByName(more), "query", ranking, k)
    return best.select(
        F.col("query").alias(query_column), F.col("id").alias(id_column), "distance", "rank"
    )
