import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from critiq.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "critiq-tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def review_rows(spark):
    """Canonical reviews from plain tuples (Title, Date, Rating, Review, ...)."""
    from critiq.operators.normalize import normalize_reviews

    def build(rows, columns):
        schema = ", ".join(f"`{c}` string" for c in columns)
        return normalize_reviews(spark.createDataFrame(rows, schema))

    return build
