"""Content-addressed datasets, and digests of source files."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from critiq.operators.mapping import ColumnMapping, detect_mapping
from critiq.operators.normalize import normalize_reviews, raise_on_violations, violations
from critiq.sources.csv import csv_columns, read_reviews

#: Files up to this size are read as one value, of which a task holds several copies.
WHOLE_BYTES = 1 << 24
_BYTE_ORDER_MARK = b"\xef\xbb\xbf"


@dataclass(frozen=True)
class DatasetSelection:
    data_path: str
    index_path: str
    collection: str
    digest: str
    review_count: int
    mapping: ColumnMapping


def file_digests(
    spark: SparkSession, path: str, suffix: bytes = b"", whole_bytes: int = WHOLE_BYTES
) -> DataFrame:
    """``path, length, digest``: SHA-256 of each file's bytes and a suffix, at any size.

    Files up to ``whole_bytes`` are values of the binary reader; larger ones are streamed in
    pieces through the task that hashes them. Empty files have no row.
    """
    files = spark.read.format("binaryFile").load(path)
    content = F.concat(F.col("content"), F.lit(suffix)) if suffix else F.col("content")
    digests = files.filter(F.col("length") <= whole_bytes).select(
        "path", "length", F.sha2(content, 256).alias("digest")
    )
    large = files.filter(F.col("length") > whole_bytes).select("path", "length")
    if large.isEmpty():
        return digests
    return digests.unionByName(_streamed_digests(spark, path, suffix, whole_bytes))


def _streamed_digests(spark: SparkSession, path: str, suffix: bytes, above: int) -> DataFrame:
    """Digests of files above a size, from their lines in order.

    The bytes between line feeds are those of the file; whether a line feed ends it, and
    whether a byte order mark begins it, which the reader leaves out, follows from its length.
    """
    lines = spark.read.schema("value string").option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_size").alias("length"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("line"),
        F.col("value").cast("binary").alias("value"),
    ).filter(F.col("length") > above)
    # Lines of a split have rising numbers; splits of a file lie in order of their start.
    ordered = lines.repartition("path").sortWithinPartitions("path", "start", "line")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, seen, marked, running = None, 0, None, None

        def done() -> pa.RecordBatch:
            missing = current[1] - seen
            if missing not in (0, 1, 3, 4):
                raise ValueError(f"{current[0]} is not read as its bytes")
            ends = missing in (1, 4)
            chosen = marked if missing >= 3 else running
            chosen.update((b"\n" if ends else b"") + suffix)
            return pa.RecordBatch.from_arrays(
                [pa.array([current[0]]), pa.array([current[1]], pa.int64()),
                 pa.array([chosen.hexdigest()])],
                names=["path", "length", "digest"],
            )

        for batch in batches:
            for file, length, value in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(4)
            ):
                if current is None or current[0] != file:
                    if current is not None:
                        yield done()
                    current, seen = (file, length), 0
                    running, marked = hashlib.sha256(), hashlib.sha256(_BYTE_ORDER_MARK)
                    feed = b""
                data = feed + (value.as_py() or b"")
                running.update(data)
                marked.update(data)
                seen, feed = seen + len(data), b"\n"
        if current is not None:
            yield done()

    return ordered.mapInArrow(digest, "path string, length bigint, digest string")


def dataset_digest(spark: SparkSession, path: str, suffix: bytes = b"") -> str:
    """Sum of the digests of a dataset's files as numbers, modulo 2^256.

    It doesn't depend on the order of the files, and that of one file is its digest.
    """
    words = [F.conv(F.substring("digest", 4 * i + 1, 4), 16, 10).cast("bigint") for i in range(16)]
    sums = file_digests(spark, path, suffix).agg(*[F.sum(w) for w in words]).head()
    total = sum((n or 0) << 16 * (15 - i) for i, n in enumerate(sums))
    return f"{total % (1 << 256):064x}"


def file_facts(spark: SparkSession, path: str) -> DataFrame:
    """One row ``sha256, row_count`` of a CSV file, rows by the CSV reader."""
    count = read_reviews(spark, path).agg(F.count("*").alias("n")).scalar()
    return file_digests(spark, path).select(
        F.col("digest").alias("sha256"), count.alias("row_count")
    )


def _complete(spark: SparkSession, path: str) -> bool:
    """Whether a write of ``path`` came to its end; an aborted one has no marker."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def register_dataset(
    spark: SparkSession, path: str, root: str, mapping: ColumnMapping | None = None
) -> DatasetSelection:
    """Validate a CSV, then keep its canonical form under a key of content and mapping."""
    chosen = mapping or detect_mapping(csv_columns(spark, path))
    raw = read_reviews(spark, path)
    raise_on_violations(violations(raw, chosen))
    digest = dataset_digest(spark, path, b"\x00" + chosen.to_json().encode())
    data_path = f"{root.rstrip('/')}/datasets/{digest}"
    if not _complete(spark, data_path):
        normalize_reviews(raw, chosen).write.mode("overwrite").parquet(data_path)
    return DatasetSelection(
        data_path=data_path,
        index_path=f"{root.rstrip('/')}/index/{digest}",
        collection=f"reviews_{digest[:12]}",
        digest=digest,
        review_count=spark.read.parquet(data_path).count(),
        mapping=chosen,
    )
