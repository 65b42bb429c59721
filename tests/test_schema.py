from datetime import date

import pytest
from pyspark.errors import PySparkException

from critiq.operators.mapping import (
    ColumnMapping,
    ReviewDataError,
    detect_mapping,
    suggest_mapping,
    validate_mapping,
)
from critiq.operators.normalize import normalize_reviews, violations
from critiq.sources.csv import csv_columns, read_reviews


def test_aliases_pick_the_longest_then_the_leftmost():
    assert suggest_mapping(["Review", "Customer Review"])["review"] == "Customer Review"
    assert suggest_mapping(["re-view", "Review"])["review"] == "re-view"
    found = detect_mapping(
        ["Country", "Restaurant Name", "Sentiment", "Review Title", "Review Date", "Review"]
    )
    assert found == ColumnMapping(
        review="Review", title="Review Title", date="Review Date", sentiment="Sentiment",
        restaurant="Restaurant Name", country="Country",
    )


def test_substrings_are_no_alias():
    found = suggest_mapping(["Review", "Label ID", "Region Code"])
    assert found["sentiment"] is None and found["country"] is None


def test_a_review_column_is_required():
    with pytest.raises(ReviewDataError, match="no review text column"):
        detect_mapping(["Identifier", "Notes Code"])


def test_mapping_names_existing_columns_once():
    with pytest.raises(ReviewDataError, match="do not exist: Nope"):
        validate_mapping(ColumnMapping(review="Nope"), ["Text"])
    with pytest.raises(ReviewDataError, match="more than one role: Text"):
        validate_mapping(ColumnMapping(review="Text", title="Text"), ["Text"])


def test_unknown_names_by_manual_mapping(spark):
    df = spark.createDataFrame(
        [("Cafe", "2024-05-01", " Nice place ", "Happy", "x")],
        "Venue string, `Published On` string, `Customer Words` string, Mood string, `a.b` string",
    )
    row = normalize_reviews(
        df,
        ColumnMapping(review="Customer Words", restaurant="Venue", date="Published On",
                      sentiment="Mood"),
    ).head()
    assert row.Review == "Nice place" and row.Restaurant == "Cafe"
    assert row.Date == date(2024, 5, 1) and row.Sentiment == "Happy"
    assert row.Title is None and row.Rating is None and row.Country is None
    assert [(e.k, e.v) for e in row._extra] == [("a.b", "x")]


def test_ratings_and_dates(spark):
    ratings = {
        "4": 4, " 4.0 ": 4, "4.5": None, "0": None, "6": None, "5d": None, "inf": None,
        "nan": None, "4e0": 4, "": None, None: None, "+3": 3, "abc": None,
    }
    df = spark.createDataFrame([("x", k) for k in ratings], "Review string, Rating string")
    got = {r[0]: r[1] for r in zip(ratings, [r.Rating for r in normalize_reviews(df).collect()])}
    assert got == ratings
    bad = {r.value for r in violations(df).collect()}
    assert bad == {"4.5", "0", "6", "5d", "inf", "nan", "abc"}

    march = date(2024, 3, 15)
    dates = {
        "2024-03-15": march, "2024-3-15 08:30": march, "2024-03-15T10:00:00Z": march,
        "20240315": march, "03/15/2024": march, "15/03/2024": march, "March 15, 2024": march,
        "mar 15 2024": march, "15 MARCH 2024": march, "15-Mar-2024": march, "2024/03/15": march,
        "2024-03": date(2024, 3, 1), "2024-02-30": None, "2024-03-15 25:00": None,
        "not-a-date": None, " ": None, None: None, "May 5, 2024": date(2024, 5, 5),
    }
    df = spark.createDataFrame([("x", k) for k in dates], "Review string, `Date` string")
    got = dict(zip(dates, [r.Date for r in normalize_reviews(df).collect()]))
    assert got == dates
    assert {r.value for r in violations(df).collect()} == {
        "2024-02-30", "2024-03-15 25:00", "not-a-date"
    }


def test_typed_columns_are_taken_as_they_are(spark):
    df = spark.sql(
        "SELECT 'x' AS Review, 4.0D AS Rating, timestamp'2024-01-02 03:04:05' AS Date, "
        "true AS flag, 12 AS `Order ID`"
    )
    row = normalize_reviews(df).head()
    assert (row.Rating, row.Date) == (4, date(2024, 1, 2))
    assert [(e.k, e.v) for e in row._extra] == [("flag", "True"), ("Order ID", "12")]


def test_strict_reports_rules_in_order(spark):
    df = spark.createDataFrame(
        [("ok", "7", "not-a-date")], "Review string, Rating string, `Date` string"
    )
    with pytest.raises(ReviewDataError, match="Rating is no whole number"):
        normalize_reviews(df, strict=True)
    blank = spark.createDataFrame([("  ", "7")], "Review string, Rating string")
    with pytest.raises(ReviewDataError, match="Review is blank"):
        normalize_reviews(blank, strict=True)


def test_canonical_tables_pass_through(spark):
    df = normalize_reviews(spark.createDataFrame([("a", "b")], "Review string, Other string"))
    assert normalize_reviews(df) is df
    assert violations(df).count() == 0


def test_duplicate_headers_are_refused(spark):
    df = spark.createDataFrame([("a", "b")], ["Review", "Review"])
    with pytest.raises(ReviewDataError, match="duplicate column"):
        normalize_reviews(df)


def test_csv(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text('Review,Note,Order\n"two\nlines, ""quoted""",NA,1\nplain,,\nshort\n')
    assert csv_columns(spark, str(path)) == ["Review", "Note", "Order"]
    rows = [tuple(r) for r in read_reviews(spark, str(path)).collect()]
    assert rows == [
        ('two\nlines, "quoted"', None, "1"), ("plain", None, None), ("short", None, None)
    ]
    wide = tmp_path / "w.csv"
    wide.write_text("Review,Note\na,b,c\n")
    with pytest.raises(PySparkException, match="more fields"):
        read_reviews(spark, str(wide)).collect()
    empty = tmp_path / "e.csv"
    empty.write_text("")
    with pytest.raises(ValueError, match="no columns"):
        csv_columns(spark, str(empty))
    with pytest.raises(ValueError, match="header"):
        csv_columns(spark, str(tmp_path / "missing.csv"))


def test_files_of_other_column_order_are_read_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Review,Country\nfine,IT\n")
    (tmp_path / "b.csv").write_text("Country,Review\nFR,good\n")
    (tmp_path / "c.csv").write_text("Review,Country\r\nplain,DE\r\n")
    rows = read_reviews(spark, str(tmp_path)).select("Review", "Country").collect()
    assert sorted(map(tuple, rows)) == [("fine", "IT"), ("good", "FR"), ("plain", "DE")]
    (tmp_path / "d.csv").write_text("Review,Town\nx,Rome\n")
    with pytest.raises(ValueError, match="different columns"):
        read_reviews(spark, str(tmp_path))


def test_a_rating_that_is_no_number_is_absent(spark):
    df = spark.createDataFrame(
        [("a", float("nan")), ("b", 4.0), ("c", 4.5)], "Review string, Rating double"
    )
    assert [r.value for r in violations(df).collect()] == ["4.5"]
    rows = {r.Review: r.Rating for r in normalize_reviews(df).collect()}
    assert rows == {"a": None, "b": 4, "c": None}
    normalize_reviews(df.filter("Review <> 'c'"), strict=True)
