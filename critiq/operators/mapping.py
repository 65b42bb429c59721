"""Which source column plays which role; works on column names at plan time."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import asdict, dataclass

from critiq.functions.text import plain_name

# Accepted names per role, roles in order of choice.
ROLE_ALIASES = {
    "review": (
        "review", "reviewtext", "customerreview", "feedback", "customerfeedback",
        "comment", "comments", "body", "content",
    ),
    "title": ("title", "reviewtitle", "headline", "subject"),
    "date": (
        "date", "reviewdate", "createdat", "publishedat", "publishedon", "timestamp",
        "submissiondate",
    ),
    "rating": ("rating", "stars", "star", "score", "reviewscore"),
    "sentiment": ("sentiment", "polarity", "sentimentlabel", "label"),
    "restaurant": (
        "restaurant", "restaurantname", "venue", "business", "businessname", "locationname",
    ),
    "country": ("country", "nation", "market", "region"),
}


class ReviewDataError(ValueError):
    """A dataset that cannot be used as it is."""


@dataclass(frozen=True)
class ColumnMapping:
    review: str
    title: str | None = None
    date: str | None = None
    rating: str | None = None
    sentiment: str | None = None
    restaurant: str | None = None
    country: str | None = None

    def as_dict(self) -> dict[str, str | None]:
        return asdict(self)

    def to_json(self) -> str:
        return json.dumps(self.as_dict(), sort_keys=True, separators=(",", ":"))

    def columns(self) -> list[str]:
        return [column for column in self.as_dict().values() if column is not None]


def suggest_mapping(columns: Iterable[str]) -> dict[str, str | None]:
    """Column per role by exact alias: the longest alias, then the leftmost column."""
    free = [str(column) for column in columns]
    chosen: dict[str, str | None] = {}
    for role, aliases in ROLE_ALIASES.items():
        named = [column for column in free if plain_name(column) in aliases]
        # max() keeps the first of equals, which is the leftmost
        best = max(named, key=lambda column: len(plain_name(column)), default=None)
        chosen[role] = best
        free = [column for column in free if column != best]
    return chosen


def detect_mapping(columns: Iterable[str]) -> ColumnMapping:
    chosen = suggest_mapping(columns)
    if chosen["review"] is None:
        raise ReviewDataError("no review text column found; name one in the mapping")
    return ColumnMapping(**chosen)


def validate_mapping(mapping: ColumnMapping, columns: Iterable[str]) -> None:
    used = mapping.columns()
    missing = sorted(set(used) - {str(column) for column in columns})
    if missing:
        raise ReviewDataError(f"mapped columns do not exist: {', '.join(missing)}")
    repeated = sorted({column for column in used if used.count(column) > 1})
    if repeated:
        raise ReviewDataError(f"column mapped to more than one role: {', '.join(repeated)}")
