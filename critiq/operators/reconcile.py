"""Keep an index in step with its documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from critiq.functions.plugins import EmbedFunction, embed
from critiq.session import materialize
from critiq.sources.index import read_index, write_batch

BROADCAST_IDS = 500_000


def stale_ids(existing: DataFrame, desired: DataFrame) -> DataFrame:
    """IDs in the index that no document has any more."""
    return existing.select("source_id").join(desired.select("source_id"), "source_id", "left_anti")


def missing_documents(existing: DataFrame, desired: DataFrame) -> DataFrame:
    """Documents the index does not hold yet."""
    return desired.join(existing.select("source_id"), "source_id", "left_anti")


def reconcile_index(
    spark: SparkSession,
    path: str,
    documents: DataFrame,
    embed_fn: EmbedFunction,
    embed_partitions: int | None = None,
) -> tuple[int, int]:
    """Embed what is missing, remove what is stale; returns both counts.

    Running it again changes nothing. ``embed_partitions`` spreads the embedding
    calls, which cost far more than their bytes suggest.
    """
    existing = read_index(spark, path, ["source_id"])
    missing, stale = documents, None
    if existing is not None:
        # IDs are compared first: where little is new, texts are not exchanged.
        new = materialize(missing_documents(existing, documents.select("source_id")))
        few = new.count() <= BROADCAST_IDS
        missing = documents.join(F.broadcast(new) if few else new, "source_id", "left_semi")
        stale = stale_ids(existing, documents)
    if embed_partitions:
        missing = missing.repartition(embed_partitions, "source_id")
    return write_batch(spark, path, embed(missing, embed_fn), stale)


def reconciled(existing: DataFrame, desired: DataFrame) -> DataFrame:
    """What a reconcile does to each ID: ``source_id, action`` of keep, add, drop."""
    kept = existing.select("source_id").join(desired.select("source_id"), "source_id", "left_semi")
    return (
        kept.selectExpr("source_id", "'keep' AS action")
        .unionByName(
            missing_documents(existing, desired).selectExpr("source_id", "'add' AS action")
        )
        .unionByName(stale_ids(existing, desired).selectExpr("source_id", "'drop' AS action"))
    )
