"""Bitmaps of hashed keys: tell rows that surely have no match before anything is exchanged.

A bitmap has sixteen bits per key, up to ``MAX_BITS``, and is sent to all tasks, so that
128 MB are its proven bound. Of rows without a match about one in sixteen passes; beyond
64 million keys more do, which costs time but never changes a result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from critiq.session import materialize

BITS_PER_KEY = 16
MAX_BITS = 1 << 30
# Bits that one value of the bitmap functions holds.
_WORD_BITS = 1 << 15
_BIT = (
    "(shiftright(cast(conv(hex(substring(_bits, cast(shiftright(_at, 3) AS int) + 1, 1)), 16, 10)"
    " AS int), cast(_at & 7 AS int)) & 1) = 1"
)


@dataclass(frozen=True)
class KeyBitmap:
    """Rows ``_word, _bits`` that together hold ``size`` bits."""

    words: DataFrame
    size: int

    def marked(self, rows: DataFrame, key: Column, name: str) -> DataFrame:
        """``rows`` with a boolean column that is false where no key can be equal.

        ``key`` is a bigint; no column of ``rows`` may be called _word, _at or _bits.
        """
        place = F.pmod(key, F.lit(self.size))
        return (
            rows.withColumn("_word", F.shiftright(place, 15))
            .withColumn("_at", place.bitwiseAND(F.lit(_WORD_BITS - 1)))
            .join(F.broadcast(self.words), "_word", "left")
            .select(*rows.columns, F.coalesce(F.expr(_BIT), F.lit(False)).alias(name))
        )


def key_bitmap(keys: DataFrame, key: Column, count: int) -> KeyBitmap:
    """Bitmap of the bigint ``key`` of ``count`` rows, written down once."""
    wanted = max(_WORD_BITS, 1 << max(BITS_PER_KEY * count - 1, 1).bit_length())
    size = min(MAX_BITS, wanted)
    place = F.pmod(key, F.lit(size))
    words = (
        keys.select(
            F.shiftright(place, 15).alias("_word"),
            place.bitwiseAND(F.lit(_WORD_BITS - 1)).alias("_at"),
        )
        .groupBy("_word")
        .agg(F.bitmap_construct_agg("_at").alias("_bits"))
    )
    return KeyBitmap(materialize(words), size)
