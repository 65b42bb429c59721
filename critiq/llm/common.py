"""Shared folders, written intermediate tables and batch text kernels of this subpackage."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from critiq.session import scratch_dir

CHUNK_BYTES = 1 << 19
BATCH_ROWS = 1000
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    The copy survives lost executors, cuts the lineage and is read with column pruning.
    """
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table from ``written`` that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def map_texts(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` over batches of at most ``BATCH_ROWS`` rows, as texts may be long.

    The session's limit is lowered for good, since it is read when the plan runs; other
    queries only see smaller batches.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_BATCH_CONF)) <= BATCH_ROWS:
        conf.set(_BATCH_CONF, str(BATCH_ROWS))
    return df.mapInArrow(function, schema)


def hash_fraction(key: Column, fraction: float, seed: str) -> Column:
    """Whether the hash of ``key`` falls into the given share of all hashes."""
    if fraction >= 1.0:
        return F.lit(True)
    cut = int(fraction * (1 << 31))
    return F.pmod(F.xxhash64(key.cast("string"), F.lit(seed)), F.lit(1 << 31)) < cut


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string array without copying; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type)
    if texts.null_count:
        texts = texts.fill_null("")
    buffers = texts.buffers()
    kind = np.int64 if wide else np.int32
    if len(texts) == 0 or buffers[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(buffers[1], kind)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    offsets = offsets.astype(np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit values (in place)."""
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(CHUNK_BYTES + 1, 1 << math.ceil(math.log2(n + 1)))
    if size not in _POWERS:
        ones = np.ones(size, np.uint64)
        ones[1:] = np.uint64(_BASE)
        back = np.ones(size, np.uint64)
        back[1:] = np.uint64(_BASE_INVERSE)
        _POWERS.clear()
        _POWERS[size] = np.cumprod(ones), np.cumprod(back)
    return _POWERS[size]


#: White space of the word definition: space and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def chunks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``CHUNK_BYTES``; a longer document stands alone."""
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def run_hashes(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray, plus: int = 1
) -> np.ndarray:
    """64-bit hash of each byte run ``data[start:end]``.

    A polynomial over the ring of 64-bit numbers: one running sum gives every run's value,
    and the inverse of the base shifts it to the run's own start.
    """
    forward, back = _powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(plus)) * forward[: len(data)], out=total[1:])
    return mixed((total[ends] - total[starts]) * back[starts])


def word_spans(
    data: np.ndarray, offsets: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of documents begin and end, and each document's first word."""
    if len(data) == 0:
        nothing = np.zeros(0, np.int64)
        return nothing, nothing, np.zeros(len(offsets), np.int64)
    solid = ~SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of documents, and each document's first word.

    Returns (hashes, bounds): document i has ``hashes[bounds[i]:bounds[i + 1]]``.
    """
    starts, ends, bounds = word_spans(data, offsets)
    if len(starts) == 0:
        return np.zeros(0, np.uint64), bounds
    return run_hashes(LOWER[data], starts, ends), bounds


def packed(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array).tobytes()
