"""Search of query blocks against data blocks: packing, pairing and running results.

Both sides are packed into blocks of bounded size. Every query block meets every data block
in one join on the data block's number; a task keeps the best rows per query over all data
blocks it sees, so that only k rows per query and task are exchanged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query blocks whose results a task holds before it hands the oldest on.
HELD_BLOCKS = 64


def clean_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(item, vec) with finite vectors only; of rows that share an id, the smallest vector."""
    x = F.col("vec")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = df.select(
        F.col(id_col).cast("long").alias("item"),
        F.col(vector_col).cast("array<double>").alias("vec"),
    ).filter(F.col("item").isNotNull() & x.isNotNull() & fine)
    return rows.groupBy("item").agg(F.min("vec").alias("vec"))


def block_count(rows: int, per_block: int) -> int:
    return max(1, -(-rows // per_block))


def packed_blocks(
    df: DataFrame, blocks: int, pack: Callable[[np.ndarray, np.ndarray, int], dict], dims: int,
    block: Column | None = None,
) -> DataFrame:
    """One row per block: ids and what ``pack(ids, vectors, dims)`` makes of its vectors.

    Vectors shorter than ``dims`` are filled up with zeros. Where the caller tells the number
    of a row's ``block``, ``pack`` gets that number in place of ``dims``.
    """
    told = block is not None
    names = list(pack(np.zeros(1, np.int64), np.zeros((1, dims)), 0 if told else dims))

    def build(key: tuple, table: pa.Table) -> pa.Table:
        ids = table["item"].to_numpy()
        vectors = np.zeros((len(ids), dims))
        lists = table["vec"].combine_chunks()
        lengths = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        if (lengths == dims).all():
            vectors[:] = flat.reshape(len(ids), dims)
        else:
            vectors[np.arange(dims)[None, :] < lengths[:, None]] = flat
        order = np.argsort(ids, kind="stable")
        made = pack(ids[order], vectors[order], key[0].as_py() if told else dims)
        return pa.table(
            {"block": pa.array([key[0].as_py()], pa.int32())}
            | {n: pa.array([made[n]], pa.binary()) for n in names}
        )

    schema = "block int, " + ", ".join(f"{n} binary" for n in names)
    if block is None:
        block = F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int")
    return df.withColumn("block", block).groupBy("block").applyInArrow(build, schema)


def merged(
    a: tuple[np.ndarray, np.ndarray] | None, b: tuple[np.ndarray, np.ndarray], k: int
) -> tuple[np.ndarray, np.ndarray]:
    """The k best (scores, ids) of two results per query; absent places have id -1 at the end."""
    if a is None:
        return b
    scores, ids = np.hstack([a[0], b[0]]), np.hstack([a[1], b[1]])
    order = np.lexsort((ids, -scores, ids == ABSENT), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


ABSENT = np.iinfo(np.int64).max


def block_search(
    queries: DataFrame,
    data: DataFrame,
    data_blocks: int,
    kernel: Callable[[dict, dict], tuple[np.ndarray, np.ndarray]],
    k: int,
    score_type: str,
) -> DataFrame:
    """The k best (query_id, rank, vec_id, score) per query over all pairs of blocks.

    ``kernel`` gets a query block and a data block as dictionaries of bytes and returns
    (scores, ids) with k columns. Ties go to the smaller id.
    """
    q_names = [c for c in queries.columns if c != "block"]
    d_names = [c for c in data.columns if c != "block"]
    every = F.explode(F.sequence(F.lit(0), F.lit(data_blocks - 1))).alias("block")
    asked = queries.select(
        F.col("block").alias("q_block"), every, *[F.col(c).alias(f"q_{c}") for c in q_names]
    ).repartition(data_blocks, "block")
    held = data.select("block", *[F.col(c).alias(f"d_{c}") for c in d_names])
    pairs = asked.join(held.repartition(data_blocks, "block").hint("shuffle_hash"), "block")
    kind = pa.int64() if score_type == "long" else pa.float64()

    def rows(asked_ids: np.ndarray, best: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        scores, ids = best
        there = ids != ABSENT
        query = np.repeat(asked_ids, there.sum(1))
        return pa.RecordBatch.from_arrays(
            [pa.array(query, pa.int64()), pa.array(ids[there], pa.int64()),
             pa.array(scores[there], kind)],
            names=["query_id", "vec_id", "score"],
        )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i] for n in batch.schema.names}
                number = row["q_block"].as_py()
                q = {c: row[f"q_{c}"].as_buffer() for c in q_names}
                d = {c: row[f"d_{c}"].as_buffer() for c in d_names}
                asked_ids = np.frombuffer(q["ids"], np.int64).copy()
                held_best = best.pop(number, (asked_ids, None))[1]
                best[number] = asked_ids, merged(held_best, kernel(q, d), k)
                if len(best) > HELD_BLOCKS:
                    yield rows(*best.pop(next(iter(best))))
        for asked_ids, found in best.values():
            yield rows(asked_ids, found)

    found = pairs.drop("block").mapInArrow(
        search, f"query_id long, vec_id long, score {score_type}"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
