"""Exact duplicates: groups of one 128-bit content hash, with bytes compared inside them.

Texts are equal when identical after each run of white space (space, 0x09-0x0D) has become
one space. Only hashes are grouped for all rows, counted map-side. The texts of rows whose
hash occurs again, and of no others, are then grouped by (hash, text): a second text under
a hash is a collision, and the rows of such hashes are classed by hash and text. So a text
that occurs once never travels, and copies of one text are merged in each task before they
do, however many there are.

Everything is DataFrame functions: no Python worker runs.

Defined results: a null text is the empty text. Null IDs come last, so that a class has a
null ``keep_id`` only where all its IDs are null. Of rows that repeat an ID and a text, one
stays. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from critiq.llm.common import written
from critiq.operators.membership import KeyBitmap, key_bitmap

#: A class of more than this share of all rows is joined by broadcast, so that its rows stay
#: where they lie; there are at most as many such classes as its inverse.
HOT_SHARE = 1e-4
#: What is longer than one space of a run, or no space: a lone space stays as it is.
_RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _RUNS, " ")


def content_hash(sha256: Column) -> Column:
    """128 bits of a text's SHA-256 in hexadecimal."""
    return F.unhex(F.substring(sha256, 1, 32))


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    hash_of: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """``id_col, keep_id, group_size, kept, text_sha256`` of every row.

    ``hash_of`` makes the binary content hash from the SHA-256; a weaker one gives the same
    result by way of more collisions.
    """
    texts = (
        docs.select(F.col(id_col).alias("id"), normalized(F.col(text_col)).alias("text"))
        .withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
        .withColumn("hash", hash_of(F.col("sha")))
    )
    # The place is fixed once it is written; it tells rows apart that repeat an ID.
    digests = written(
        texts.select("id", "sha", "hash", F.monotonically_increasing_id().alias("place"))
    )
    classes = _classes(digests, ["hash"])
    bitmap = key_bitmap(classes, F.xxhash64("hash"), classes.count())
    collided = _collided(texts, bitmap)
    if collided.isEmpty():
        found = _attached(digests, classes, ["hash"], bitmap)
    else:
        # Nothing but rows of hashes with several texts is read again with its text.
        mixed = bitmap.marked(texts, F.xxhash64("hash"), "again").filter("again").drop("again")
        mixed = written(
            mixed.join(collided, "hash", "left_semi")
            .select("id", "sha", "hash", "text", F.monotonically_increasing_id().alias("place"))
        )
        plain = _attached(
            digests.join(collided, "hash", "left_anti"), classes, ["hash"], bitmap
        )
        exact = _classes(mixed, ["hash", "text"])
        found = plain.unionByName(_attached(mixed, exact, ["hash", "text"]))
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", "text_sha256")


def _classes(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur again, with the ID and the place that stay and the number of rows."""
    first = F.coalesce(F.min_by("place", "id"), F.min("place"))
    return written(
        rows.groupBy(*keys)
        .agg(F.min("id").alias("keep_id"), first.alias("keep_place"), F.count("*").alias("rows"))
        .filter("rows > 1")
    )


def _collided(texts: DataFrame, bitmap: KeyBitmap) -> DataFrame:
    """Hashes under which texts of different bytes lie; copies are merged where they lie."""
    again = bitmap.marked(texts.select("hash", "text"), F.xxhash64("hash"), "again")
    distinct = again.filter("again").groupBy("hash", "text").agg(F.count("*").alias("rows"))
    return written(
        distinct.groupBy("hash").agg(F.count("*").alias("texts"))
        .filter("texts > 1").select("hash")
    )


def _attached(
    rows: DataFrame, classes: DataFrame, keys: Sequence[str], bitmap: KeyBitmap | None = None
) -> DataFrame:
    """Every row with its class; rows that occur once, or in a large class, stay in place."""
    least = HOT_SHARE * max(rows.count(), 1)
    large, small = classes.filter(F.col("rows") > least), classes.filter(F.col("rows") <= least)
    columns = ["id", "sha", "place", *keys]
    if bitmap is None:
        marked = rows.select(*columns, F.lit(True).alias("again"))
    else:
        marked = bitmap.marked(rows.select(*columns), F.xxhash64("hash"), "again")
    again = marked.filter("again").drop("again")
    joined = [
        again.join(F.broadcast(large), list(keys)),
        again.join(F.broadcast(large), list(keys), "left_anti").join(small, list(keys), "left"),
        marked.filter(~F.col("again")).select(
            *columns, F.col("id").alias("keep_id"), F.col("place").alias("keep_place"),
            F.lit(1).cast("bigint").alias("rows"),
        ),
    ]
    result = joined[0].unionByName(joined[1]).unionByName(joined[2])
    alone = F.col("rows").isNull()
    return result.select(
        "id",
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("rows", F.lit(1).cast("bigint")).alias("group_size"),
        F.coalesce(F.col("place") == F.col("keep_place"), F.lit(True)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
