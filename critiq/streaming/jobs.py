"""Incremental indexing of a folder, and search over a stream of questions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from critiq.functions.plugins import EmbedFunction, embed
from critiq.operators.documents import build_documents
from critiq.operators.identity import (
    ID_DIGITS, assign_source_ids, copies_held, with_digest, with_occurrence,
)
from critiq.operators.mapping import ColumnMapping
from critiq.operators.normalize import normalize_reviews, raise_on_violations, violations
from critiq.operators.vector_search import search
from critiq.session import materialize, small_batches
from critiq.sources.csv import CSV_OPTIONS, null_words_as_null
from critiq.sources.index import has_tag, read_index, write_batch

_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_RECORD = "__record"
_OCCURRENCE = "__occurrence"
#: Digits of a digest that deal it to one of 4,096 buckets of the stream's state.
BUCKET_DIGITS = 3


def add_reviews(
    spark: SparkSession,
    index_path: str,
    reviews: DataFrame,
    embed_fn: EmbedFunction,
    tag: str,
) -> None:
    """Add canonical reviews to an index once per ``tag``.

    Copies of a record already there count on from the snapshot. A batch that
    comes again after its commit is left out.
    """
    if has_tag(spark, index_path, tag):
        return
    existing = read_index(spark, index_path, ["source_id"])
    taken = None
    if existing is not None:
        # Only IDs of the batch's own records are counted.
        arriving = with_digest(reviews).select(
            F.substring("digest", 1, ID_DIGITS).alias("id_digest")
        )
        held = F.element_at(F.split("source_id", "_"), 2)
        same = existing.join(arriving, held == F.col("id_digest"), "left_semi")
        taken = copies_held(same)
    documents = build_documents(assign_source_ids(reviews, taken=taken))
    write_batch(spark, index_path, embed(documents, embed_fn), tag=tag)


class CopyCounter(StatefulProcessor):
    """Numbers the copies of a record: the state of a bucket is how many there were per digest."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.copies = handle.getMapState("copies", "id_digest string", "copies bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            numbers = np.zeros(len(part), np.int64)
            for digest, places in part.groupby("id_digest").indices.items():
                held = (digest,)
                copies = self.copies.getValue(held)[0] if self.copies.containsKey(held) else 0
                numbers[places] = np.arange(copies + 1, copies + 1 + len(places))
                self.copies.updateValue(held, (copies + len(places),))
            yield part[["record", "id_digest"]].assign(occurrence=numbers)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for digest, copies in zip(initialState["id_digest"], initialState["copies"]):
            self.copies.updateValue((digest,), (int(copies),))

    def close(self) -> None:
        pass


def numbered_copies(
    rows: DataFrame, mapping: ColumnMapping, held: DataFrame | None = None
) -> DataFrame:
    """``record, id_digest, occurrence`` of a stream of raw rows.

    Occurrences count on over the life of the stream in its state store, beginning with
    ``held`` (of ``copies_held``). ``record`` is the raw row as JSON. Digests are dealt to
    buckets, so that a call of the state's function sees many of them.
    """
    raw = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))
    keyed = with_digest(normalize_reviews(rows.withColumn(_RECORD, raw), mapping, keep=[_RECORD]))
    keyed = keyed.select(
        F.col(_RECORD).alias("record"), F.substring("digest", 1, ID_DIGITS).alias("id_digest")
    )
    bucket = F.substring("id_digest", 1, BUCKET_DIGITS).alias("bucket")
    small_batches(rows.sparkSession)
    return keyed.select("*", bucket).groupBy("bucket").transformWithStateInPandas(
        CopyCounter(), "record string, id_digest string, occurrence bigint", "Append", "None",
        initialState=None if held is None else held.select("*", bucket).groupBy("bucket"),
    )


def stream_index(
    spark: SparkSession,
    folder: str,
    columns: Sequence[str],
    mapping: ColumnMapping,
    index_path: str,
    embed_fn: EmbedFunction,
    checkpoint: str,
    name: str = "index",
) -> StreamingQuery:
    """Watch a folder of CSV files and index what arrives, until none is left.

    Copies of a record are counted in the stream's state, which starts from the index as it
    is when the stream first starts; from then on the stream is its only writer. No batch
    reads the index.
    """
    schema = StructType([StructField(c, StringType()) for c in columns])
    arriving = null_words_as_null(
        # Each file's own header must be that of the stream.
        spark.readStream.schema(schema).options(**CSV_OPTIONS, enforceSchema=False).csv(folder)
    )
    existing = read_index(spark, index_path, ["source_id"])
    numbered = numbered_copies(
        arriving, mapping, None if existing is None else copies_held(existing)
    )

    def add(batch: DataFrame, epoch: int) -> None:
        session, tag = batch.sparkSession, f"{name}:{epoch}"
        if has_tag(session, index_path, tag):
            return
        # Read twice below; the state must be asked for once.
        batch = materialize(batch)
        rows = batch.select(F.from_json("record", schema).alias("r"), "occurrence").select(
            "r.*", F.col("occurrence").alias(_OCCURRENCE)
        )
        raise_on_violations(violations(rows.drop(_OCCURRENCE), mapping))
        reviews = normalize_reviews(rows, mapping, keep=[_OCCURRENCE])
        identified = with_occurrence(reviews, _OCCURRENCE).drop(_OCCURRENCE)
        write_batch(session, index_path, embed(build_documents(identified), embed_fn), tag=tag)

    # State with values of its own needs this store; the query keeps the setting it starts with.
    before = spark.conf.get(_STATE_STORE, None)
    spark.conf.set(_STATE_STORE, _ROCKS)
    try:
        return (
            numbered.writeStream.foreachBatch(add)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        if before is None:
            spark.conf.unset(_STATE_STORE)
        else:
            spark.conf.set(_STATE_STORE, before)


def stream_search(
    questions: DataFrame,
    index_path: str,
    embed_fn: EmbedFunction,
    output: str,
    checkpoint: str,
    k: int = 5,
    event_time: str | None = None,
    late: str = "1 hour",
) -> StreamingQuery:
    """Answer a stream of ``query_id, question`` with the k nearest documents.

    Each batch has its own output folder, so that a repeated batch replaces it.
    Without an index a batch fails, and its questions come again. With the column of an
    ``event_time`` a question that comes again within ``late`` is answered once; one that is
    later than that beside the latest event is left out.
    """
    if event_time is not None:
        questions = questions.withWatermark(event_time, late).dropDuplicatesWithinWatermark(
            ["query_id"]
        )

    def answer(batch: DataFrame, epoch: int) -> None:
        index = read_index(batch.sparkSession, index_path)
        if index is None:
            raise ValueError(f"no index at {index_path}; the questions will come again")
        matches = search(index, materialize(embed(batch, embed_fn, "question")), k)
        matches.write.mode("overwrite").parquet(f"{output}/batch={epoch}")

    return (
        questions.writeStream.foreachBatch(answer)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
