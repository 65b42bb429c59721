"""Filters, summaries, facets and distributions over canonical reviews."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from critiq.functions.records import EXTRA_COLUMN
from critiq.functions.text import casefold_label

# Labels that count as praise and as complaint.
POSITIVE_LABELS = ("positive", "pos", "favorable", "favourable", "happy")
NEGATIVE_LABELS = ("negative", "neg", "unfavorable", "unfavourable", "unhappy")

FIELDS = ("Rating", "Date", "Sentiment", "Restaurant", "Country", "Title")
RATINGS = (1, 2, 3, 4, 5)
TOP_LABELS = 10


@dataclass(frozen=True)
class ReviewFilter:
    """Bounds are inclusive; an unset bound or empty list does not filter."""

    min_rating: int | None = None
    max_rating: int | None = None
    start_date: date | None = None
    end_date: date | None = None
    sentiments: Sequence[str] = ()
    restaurants: Sequence[str] = ()
    countries: Sequence[str] = ()

    def __post_init__(self) -> None:
        low, high = self.min_rating, self.max_rating
        if low is not None and high is not None and low > high:
            raise ValueError("min_rating is above max_rating")
        first, last = self.start_date, self.end_date
        if first is not None and last is not None and first > last:
            raise ValueError("start_date lies behind end_date")

    def condition(self) -> Column:
        """Bounds are plain comparisons, so that they reach the scan."""
        parts = [F.lit(True)]
        for name, low, high in (
            ("Rating", self.min_rating, self.max_rating),
            ("Date", self.start_date, self.end_date),
        ):
            if low is not None:
                parts.append(F.col(name) >= F.lit(low))
            if high is not None:
                parts.append(F.col(name) <= F.lit(high))
        for name, wanted in (
            ("Sentiment", self.sentiments),
            ("Restaurant", self.restaurants),
            ("Country", self.countries),
        ):
            if wanted:
                folded = sorted({value.casefold() for value in wanted})
                parts.append(casefold_label(F.col(name)).isin(folded))
        combined = parts[0]
        for part in parts[1:]:
            combined = combined & part
        return combined


def filter_reviews(reviews: DataFrame, criteria: ReviewFilter) -> DataFrame:
    return reviews.filter(criteria.condition())


def _label_totals(reviews: DataFrame) -> DataFrame:
    """Partial totals per (restaurant, country).

    Distinct counts then run over one row per pair instead of three copies of
    every review.
    """
    return reviews.groupBy("Restaurant", "Country").agg(
        F.count("*").alias("n"),
        F.sum("Rating").alias("rating_sum"),
        F.count("Rating").alias("rated"),
        F.count_if(F.col("Rating") >= 4).alias("high"),
        F.count_if(F.col("Rating") <= 2).alias("low"),
        F.min("Date").alias("first"),
        F.max("Date").alias("last"),
    )


def _total(column: str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0)).cast("bigint")


def summarize(reviews: DataFrame) -> DataFrame:
    """One row: counts, mean rating, high and low ratings, dates, distinct labels."""
    return _label_totals(reviews).agg(
        _total("n").alias("total_reviews"),
        F.try_divide(F.sum("rating_sum"), F.sum("rated")).alias("average_rating"),
        _total("high").alias("high_rated"),
        _total("low").alias("low_rated"),
        F.min("first").alias("first_date"),
        F.max("last").alias("last_date"),
        F.countDistinct("Restaurant").alias("restaurant_count"),
        F.countDistinct("Country").alias("country_count"),
    )


def rating_histogram(reviews: DataFrame) -> DataFrame:
    """Reviews per rating 1 to 5, zeros included."""
    counted = reviews.agg(
        F.array(
            *[
                F.struct(
                    F.lit(r).alias("rating"), F.count_if(F.col("Rating") == r).alias("reviews")
                )
                for r in RATINGS
            ]
        ).alias("bars")
    )
    return counted.select(F.inline("bars"))


def sentiment_counts(reviews: DataFrame) -> DataFrame:
    return (
        reviews.filter(F.col("Sentiment").isNotNull())
        .groupBy(F.col("Sentiment").alias("sentiment"))
        .agg(F.count("*").alias("reviews"))
        .orderBy("sentiment")
    )


def polarity_counts(reviews: DataFrame) -> DataFrame:
    """Praise and complaint counts; labels are folded once per distinct label."""
    labels = reviews.groupBy("Sentiment").agg(F.count("*").alias("n"))
    return labels.agg(*_polarity(F.col("n")))


def _polarity(n: Column) -> list[Column]:
    folded = casefold_label(F.col("Sentiment"))
    return [
        F.coalesce(F.sum(F.when(folded.isin(*labels), n)), F.lit(0)).cast("bigint").alias(name)
        for name, labels in (("positive", POSITIVE_LABELS), ("negative", NEGATIVE_LABELS))
    ]


def availability(reviews: DataFrame) -> DataFrame:
    """One row of flags: does any review have the field?"""
    return reviews.agg(
        *[
            F.coalesce(F.bool_or(F.col(f).isNotNull()), F.lit(False)).alias(f"has_{f.lower()}")
            for f in FIELDS
        ]
    )


def available(reviews: DataFrame, fields: Sequence[str]) -> list[str]:
    """Those of the fields that any review has, in their order.

    Asked at plan time, in one aggregate of these columns, where the answer decides
    which columns a plan reads.
    """
    held = availability(reviews).select(*[f"has_{f.lower()}" for f in fields]).head()
    return [f for f, there in zip(fields, held, strict=True) if there]


def first_available(reviews: DataFrame, fields: Sequence[str]) -> str | None:
    """The first of the fields that any review has."""
    return next(iter(available(reviews, fields)), None)


def kpi_row(reviews: DataFrame, criteria: ReviewFilter = ReviewFilter()) -> DataFrame:
    """Four figures; which ones depends on the fields the unfiltered set has."""
    view = filter_reviews(reviews, criteria)
    kind = first_available(reviews, ("Rating", "Sentiment", "Restaurant"))
    n = F.col("n")
    if kind == "Rating":
        figures = view.agg(
            F.count("*").alias("n"),
            F.avg("Rating").alias("a"),
            F.count_if(F.col("Rating") >= 4).alias("b"),
            F.count_if(F.col("Rating") <= 2).alias("c"),
        )
    elif kind == "Sentiment":
        labels = view.groupBy("Sentiment").agg(F.count("*").alias("n"))
        positive, negative = _polarity(n)
        figures = labels.agg(
            _total("n").alias("n"),
            F.count("Sentiment").alias("a"),
            positive.alias("b"),
            negative.alias("c"),
        )
    elif kind == "Restaurant":
        pairs = view.groupBy("Restaurant", "Country").agg(
            F.count("*").alias("n"), F.count("Date").alias("dated")
        )
        figures = pairs.agg(
            _total("n").alias("n"),
            F.countDistinct("Restaurant").alias("a"),
            F.countDistinct("Country").alias("b"),
            _total("dated").alias("c"),
        )
    else:
        figures = view.agg(
            F.count("*").alias("n"),
            F.count("Date").alias("a"),
            F.count("Title").alias("b"),
            F.count_if(F.size(EXTRA_COLUMN) > 0).alias("c"),
        )
    return figures.select(
        F.lit((kind or "other").lower()).alias("kind"),
        F.col("n").alias("reviews_in_view"),
        F.col("a").cast("double").alias("first_figure"),
        F.col("b").cast("double").alias("second_figure"),
        F.col("c").cast("double").alias("third_figure"),
    )


def distribution(reviews: DataFrame, criteria: ReviewFilter = ReviewFilter()) -> DataFrame:
    """Bars of the richest field the unfiltered set has.

    Ratings 1 to 5 with zeros, else sentiments, else the ten largest
    restaurants or countries, else one total. Equal counts go by label.
    """
    view = filter_reviews(reviews, criteria)
    kind = first_available(reviews, ("Rating", "Sentiment", "Restaurant", "Country"))
    if kind is None:
        bars = view.agg(F.count("*").alias("reviews")).withColumn("label", F.lit("Reviews"))
    elif kind == "Rating":
        bars = rating_histogram(view).withColumn("label", F.col("rating").cast("string"))
    else:
        bars = (
            view.filter(F.col(kind).isNotNull())
            .groupBy(F.col(kind).alias("label"))
            .agg(F.count("*").alias("reviews"))
        )
        if kind != "Sentiment":
            bars = bars.orderBy(F.desc("reviews"), "label").limit(TOP_LABELS)
    return bars.select(F.lit((kind or "total").lower()).alias("kind"), "label", "reviews")


def facet_values(reviews: DataFrame) -> DataFrame:
    """Distinct labels per category in order: ``facet, value``."""
    facets = F.explode(
        F.array(
            *[
                F.struct(F.lit(c.lower()).alias("facet"), F.col(c).alias("value"))
                for c in ("Sentiment", "Restaurant", "Country")
            ]
        )
    )
    distinct = reviews.select("Sentiment", "Restaurant", "Country").distinct()
    return (
        distinct.select(facets.alias("f"))
        .select("f.*")
        .filter(F.col("value").isNotNull())
        .distinct()
        .orderBy("facet", "value")
    )


def date_bounds(reviews: DataFrame) -> DataFrame:
    return reviews.agg(F.min("Date").alias("first_date"), F.max("Date").alias("last_date"))


def preview(reviews: DataFrame, tie_break: Sequence[str] = ()) -> DataFrame:
    """Rows in view, newest first, without columns that are null throughout.

    The ``tie_break`` columns let the range sort split a date that many rows share.
    """
    fields = ("Date", "Rating", "Sentiment", "Restaurant", "Country", "Title")
    shown = available(reviews, fields)
    order = [F.desc_nulls_last("Date")] if "Date" in shown else []
    order += [F.col(c) for c in tie_break]
    rows = reviews.select(*tie_break, *shown, "Review")
    return rows.orderBy(*order) if order else rows
