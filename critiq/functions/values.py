"""Parsing of ratings and dates that arrive as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from critiq.functions.text import clean_text

NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"

_CLOCK = (
    r"([T ]+([01]?\d|2[0-3]):[0-5]\d(:[0-5]\d([.,]\d+)?)?"
    r"( ?[aApP][mM])?( ?(Z|UTC|GMT|[+-]\d{2}:?\d{2}))?)?$"
)

# Accepted dates: shape of the date part, then Spark patterns tried in order.
# A slash or dash date is read month first, and day first where that fails.
_DATE_FORMATS = (
    (r"^\d{4}-\d{1,2}-\d{1,2}", ("yyyy-M-d",)),
    (r"^\d{4}/\d{1,2}/\d{1,2}", ("yyyy/M/d",)),
    (r"^\d{4}\.\d{1,2}\.\d{1,2}", ("yyyy.M.d",)),
    (r"^\d{8}", ("yyyyMMdd",)),
    (r"^\d{1,2}/\d{1,2}/\d{4}", ("M/d/yyyy", "d/M/yyyy")),
    (r"^\d{1,2}-\d{1,2}-\d{4}", ("M-d-yyyy", "d-M-yyyy")),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}", ("M.d.yyyy", "d.M.yyyy")),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}", ("d MMM yyyy",)),
    (r"^\d{1,2} [A-Za-z]{4,9} \d{4}", ("d MMMM yyyy",)),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}", ("d-MMM-yyyy",)),
    (r"^[A-Za-z]{3} \d{1,2},? \d{4}", ("MMM d yyyy",)),
    (r"^[A-Za-z]{4,9} \d{1,2},? \d{4}", ("MMMM d yyyy",)),
    (r"^\d{4}-\d{2}", ("yyyy-MM",)),
    (r"^\d{4}", ("yyyy",)),
)


def parse_number(col: Column) -> Column:
    text = clean_text(col)
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def parse_rating(col: Column) -> Column:
    """Text of a whole number from 1 to 5, else null."""
    return whole_rating(parse_number(col))


def whole_rating(number: Column) -> Column:
    return F.when(number.between(1, 5) & (number % 1 == 0), number.cast("int"))


def _capitalised(col: Column) -> Column:
    return F.regexp_replace(F.initcap(col), ",", "")


def parse_date(col: Column) -> Column:
    """Calendar date of a date or time stamp in one of the known shapes, else null."""
    text = clean_text(col)
    attempts = []
    for shape, formats in _DATE_FORMATS:
        part = F.regexp_extract(text, shape, 0)
        if "A-Za-z" in shape:
            # month names: any case in the data, title case in the pattern
            part = _capitalised(part)
            if shape.startswith(r"^\d{1,2}-"):
                part = F.initcap(F.translate(F.regexp_extract(text, shape, 0), "-", " "))
                formats = ("d MMM yyyy",)
        dates = [F.try_to_timestamp(part, F.lit(f)).cast("date") for f in formats]
        attempts.append(F.when(text.rlike(shape + _CLOCK), F.coalesce(*dates)))
    return F.coalesce(*attempts)
