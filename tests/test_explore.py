from datetime import date

import pytest

from critiq.operators import explore as X
from critiq.operators.normalize import normalize_reviews

COLUMNS = ["Title", "Date", "Rating", "Sentiment", "Restaurant", "Country", "Review"]


@pytest.fixture
def sample(review_rows):
    return review_rows(
        [
            ("A", "2024-01-01", "1", "Negative", "Roma", "IT", "bad"),
            ("B", "2024-03-01", "4", "POSITIVE", "roma", "it", "good"),
            (None, None, "5", "Straße", "Luna", None, "great"),
            (None, "2024-02-01", None, None, None, "FR", "none"),
        ],
        COLUMNS,
    )


def test_summary_and_histogram(sample):
    row = X.summarize(sample).head()
    assert (row.total_reviews, row.high_rated, row.low_rated) == (4, 2, 1)
    assert row.average_rating == pytest.approx(10 / 3)
    assert (row.first_date, row.last_date) == (date(2024, 1, 1), date(2024, 3, 1))
    assert (row.restaurant_count, row.country_count) == (3, 3)
    bars = {r.rating: r.reviews for r in X.rating_histogram(sample).collect()}
    assert bars == {1: 1, 2: 0, 3: 0, 4: 1, 5: 1}


def test_empty_set(sample):
    nothing = sample.limit(0)
    row = X.summarize(nothing).head()
    assert row.total_reviews == 0 and row.average_rating is None and row.first_date is None
    assert {r.reviews for r in X.rating_histogram(nothing).collect()} == {0}
    assert [tuple(r) for r in X.distribution(nothing).collect()] == [("total", "Reviews", 0)]


def _titles(df):
    return sorted(r.Review for r in df.collect())


def test_filters(sample):
    def only(**bounds):
        return _titles(X.filter_reviews(sample, X.ReviewFilter(**bounds)))

    assert only() == ["bad", "good", "great", "none"]
    assert only(min_rating=2) == ["good", "great"]
    assert only(max_rating=4) == ["bad", "good"]
    assert only(start_date=date(2024, 2, 1)) == ["good", "none"]
    assert only(end_date=date(2024, 2, 1)) == ["bad", "none"]
    assert only(restaurants=["ROMA"]) == ["bad", "good"]
    assert only(sentiments=["STRASSE"]) == ["great"]
    assert only(countries=["it"], min_rating=3) == ["good"]
    with pytest.raises(ValueError, match="min_rating"):
        X.ReviewFilter(min_rating=4, max_rating=2)
    with pytest.raises(ValueError, match="start_date"):
        X.ReviewFilter(start_date=date(2024, 2, 1), end_date=date(2024, 1, 1))


def test_kpi_row_follows_the_fields_of_the_whole_set(spark, sample):
    row = X.kpi_row(sample, X.ReviewFilter(min_rating=4)).head()
    assert tuple(row) == ("rating", 2, 4.5, 2.0, 0.0)
    # availability is that of the unfiltered set
    row = X.kpi_row(sample, X.ReviewFilter(start_date=date(2030, 1, 1))).head()
    assert tuple(row) == ("rating", 0, None, 0.0, 0.0)

    def kinds(columns, rows):
        schema = ", ".join(f"{c} string" for c in columns)
        return tuple(X.kpi_row(normalize_reviews(spark.createDataFrame(rows, schema))).head())

    assert kinds(["Review", "Sentiment"], [("a", "Happy"), ("b", "neg"), ("c", "odd")]) == (
        "sentiment", 3, 3.0, 1.0, 1.0
    )
    assert kinds(["Review", "Venue", "Country"], [("a", "V", "X"), ("b", "W", "X")]) == (
        "restaurant", 2, 2.0, 1.0, 0.0
    )
    assert kinds(["Review", "Title", "Other"], [("a", "T", None), ("b", None, "o")]) == (
        "other", 2, 0.0, 1.0, 1.0
    )


def test_distribution_takes_the_ten_largest(review_rows):
    rows = [(f"r{i:02d}", "x") for i in range(12) for _ in range(12 - i)]
    bars = X.distribution(review_rows(rows, ["Restaurant", "Review"])).collect()
    assert sorted((b.label, b.reviews) for b in bars) == [(f"r{i:02d}", 12 - i) for i in range(10)]
    rated = review_rows([("5", "x"), ("5", "y")], ["Rating", "Review"])
    assert sorted(tuple(r)[1:] for r in X.distribution(rated).collect()) == [
        ("1", 0), ("2", 0), ("3", 0), ("4", 0), ("5", 2)
    ]


def test_facets_availability_preview_polarity(sample):
    facets = [(r.facet, r.value) for r in X.facet_values(sample).collect()]
    assert facets == sorted(facets) and ("country", "FR") in facets and len(facets) == 9
    flags = X.availability(sample.filter("Rating IS NULL")).head().asDict()
    assert flags == {
        "has_rating": False, "has_date": True, "has_sentiment": False,
        "has_restaurant": False, "has_country": True, "has_title": False,
    }
    shown = X.preview(sample.filter("Title IS NULL"))
    assert shown.columns == ["Date", "Rating", "Sentiment", "Restaurant", "Country", "Review"]
    assert [r.Review for r in X.preview(sample).collect()] == ["good", "none", "bad", "great"]
    assert tuple(X.polarity_counts(sample).head()) == (1, 1)
    assert [tuple(r) for r in X.sentiment_counts(sample).collect()] == [
        ("Negative", 1), ("POSITIVE", 1), ("Straße", 1)
    ]
