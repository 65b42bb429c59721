"""Any review table to the canonical schema, with violations as a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    DataType,
    DateType,
    DecimalType,
    FractionalType,
    NumericType,
    StringType,
    TimestampNTZType,
    TimestampType,
)

from critiq.functions.records import CANONICAL_COLUMNS, EXTRA_COLUMN, EXTRA_TYPE
from critiq.functions.text import clean_text, strip
from critiq.functions.values import parse_date, parse_rating, whole_rating
from critiq.operators.mapping import (
    ColumnMapping,
    ReviewDataError,
    detect_mapping,
    validate_mapping,
)

# Rules in the order in which a strict run reports them.
RULES = (
    ("Review", "a Review is blank"),
    ("Rating", "a Rating is no whole number in 1..5"),
    ("Date", "a Date is not readable"),
)

_TYPES = {"Rating": "int", "Date": "date"}


def is_canonical(df: DataFrame) -> bool:
    return {*CANONICAL_COLUMNS, EXTRA_COLUMN} <= set(df.columns)


def _name(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def _as_text(column: str, kind: DataType) -> Column:
    text = _name(column).cast("string")
    return F.initcap(text) if isinstance(kind, BooleanType) else text


def _extras(df: DataFrame, columns: Sequence[str]) -> Column:
    entries = [
        F.struct(F.lit(c).alias("k"), _as_text(c, df.schema[c].dataType).alias("v"))
        for c in columns
    ]
    packed = F.filter(F.array(*entries), lambda e: strip(e["v"]) != "") if entries else F.array()
    return packed.cast(EXTRA_TYPE)


def _supplied(column: str, kind: DataType) -> Column:
    """Is there a value at all? Blank text and not-a-number are none."""
    value = clean_text(_name(column)) if isinstance(kind, StringType) else _name(column)
    if isinstance(kind, FractionalType) and not isinstance(kind, DecimalType):
        value = F.when(~F.isnan(value), value)
    return value.isNotNull()


def _rating(column: str, kind: DataType) -> Column:
    if isinstance(kind, NumericType):
        return whole_rating(_name(column))
    return parse_rating(_name(column))


def _date(column: str, kind: DataType) -> Column:
    # Typed dates need no parsing, and bounds on them reach the scan.
    if isinstance(kind, DateType):
        return _name(column)
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return _name(column).cast("date")
    return parse_date(_name(column))


def _text(column: str, kind: DataType) -> Column:
    return clean_text(_as_text(column, kind))


_PARSERS = {"Rating": _rating, "Date": _date}


def _resolve(df: DataFrame, mapping: ColumnMapping | None) -> ColumnMapping:
    if len({c.lower() for c in df.columns}) < len(df.columns):
        repeated = sorted({c for c in df.columns if df.columns.count(c) > 1})
        if repeated:
            raise ReviewDataError(f"duplicate column names: {', '.join(repeated)}")
    resolved = mapping or detect_mapping(df.columns)
    validate_mapping(resolved, df.columns)
    return resolved


def normalize_reviews(
    df: DataFrame,
    mapping: ColumnMapping | None = None,
    *,
    keep: Sequence[str] = (),
    strict: bool = False,
) -> DataFrame:
    """Canonical columns plus ordered extras, in one projection.

    Columns in ``keep`` are row keys of the caller: they are carried along and
    are neither a role nor an extra. A canonical table is returned as it is.
    Values that break a rule are null here and are listed by ``violations``;
    with ``strict`` they raise instead.
    """
    if is_canonical(df):
        return df
    resolved = _resolve(df.drop(*keep), mapping)
    if strict:
        raise_on_violations(violations(df, resolved, keep=keep))
    columns: list[Column] = [_name(c) for c in keep]
    for canonical in CANONICAL_COLUMNS:
        source = getattr(resolved, canonical.lower())
        if source is None:
            value = F.lit(None).cast(_TYPES.get(canonical, "string"))
        else:
            value = _PARSERS.get(canonical, _text)(source, df.schema[source].dataType)
        columns.append(value.alias(canonical))
    used = {*resolved.columns(), *keep}
    extras = [c for c in df.columns if c not in used]
    return df.select(*columns, _extras(df, extras).alias(EXTRA_COLUMN))


def violations(
    df: DataFrame,
    mapping: ColumnMapping | None = None,
    *,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per broken rule: keys, rule, position of the rule, raw value."""
    if is_canonical(df):
        broken = F.array(_finding(0, F.col("Review"), F.col("Review").isNull()))
    else:
        resolved = _resolve(df.drop(*keep), mapping)
        review = _name(resolved.review)
        checks = [_finding(0, review, clean_text(review).isNull())]
        for position in (1, 2):
            rule = RULES[position][0]
            source = getattr(resolved, rule.lower())
            if source is not None:
                kind = df.schema[source].dataType
                failed = _supplied(source, kind) & _PARSERS[rule](source, kind).isNull()
                checks.append(_finding(position, _name(source), failed))
        broken = F.array(*checks)
    return df.select(
        *[_name(c) for c in keep],
        F.explode(F.filter(broken, lambda f: f.isNotNull())).alias("finding"),
    ).select(*keep, "finding.*")


def _finding(position: int, raw: Column, failed: Column) -> Column:
    return F.when(
        failed,
        F.struct(
            F.lit(RULES[position][0]).alias("rule"),
            F.lit(position).alias("rule_order"),
            raw.cast("string").alias("value"),
        ),
    )


def raise_on_violations(found: DataFrame) -> None:
    """Raise for the first broken rule, with how many rows break it."""
    counts = found.groupBy("rule_order").count().orderBy("rule_order").head(1)
    if counts:
        position, rows = counts[0]
        raise ReviewDataError(f"{RULES[position][1]} in {rows} rows")
