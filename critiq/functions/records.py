"""Canonical record payload and its digest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Canonical columns in schema order.
CANONICAL_COLUMNS = (
    "Title",
    "Date",
    "Rating",
    "Sentiment",
    "Restaurant",
    "Country",
    "Review",
)
EXTRA_COLUMN = "_extra"
EXTRA_TYPE = "array<struct<k:string,v:string>>"

# Control characters whose JSON escape has a letter in it: the JVM writes the
# letter in upper case, the digest is defined over lower case.
_LETTER_ESCAPES = ("0B", "0E", "0F", "1A", "1B", "1C", "1D", "1E", "1F")
_LETTER_CONTROLS = r"\\u00[01][A-F]"


def _lower_escapes(json: Column) -> Column:
    fixed = json
    for code in _LETTER_ESCAPES:
        fixed = F.regexp_replace(
            fixed,
            rf"(?<!\\)((?:\\\\)*)\\u00{code}",
            rf"$1\\u00{code.lower()}",
        )
    return F.when(json.rlike(_LETTER_CONTROLS), fixed).otherwise(json)


def record_payload() -> Column:
    """Compact JSON of a canonical row: keys sorted, nulls kept, extras sorted."""
    canonical = F.struct(
        *[
            (F.date_format("Date", "yyyy-MM-dd") if name == "Date" else F.col(name)).alias(name)
            for name in sorted(CANONICAL_COLUMNS)
        ]
    )
    extras = F.transform(
        F.array_sort(F.coalesce(F.col(EXTRA_COLUMN), F.array().cast(EXTRA_TYPE))),
        lambda e: F.array(e["k"], e["v"]),
    )
    body = F.struct(canonical.alias("canonical"), extras.alias("extras"))
    return _lower_escapes(F.to_json(body, {"ignoreNullFields": "false"}))


def record_digest() -> Column:
    """SHA-256 hex of the payload."""
    return F.sha2(record_payload(), 256)
