"""Report files."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_report(
    report: DataFrame,
    path: str,
    *,
    observations: dict[str, DataFrame] | None = None,
    gold: DataFrame | None = None,
    counts: DataFrame | None = None,
) -> None:
    """JSON under ``path``: one head record, and the large parts as JSON lines.

    Null fields are kept. Observations go to ``observations/<name>``, gold pairs
    to ``gold`` and all label counts to ``counts``, each written in parallel.
    """
    parts = {"head": report.coalesce(1), "gold": gold, "counts": counts}
    parts |= {f"observations/{name}": rows for name, rows in (observations or {}).items()}
    for name, rows in parts.items():
        if rows is not None:
            ordered = rows.select(*sorted(rows.columns))
            ordered.write.mode("overwrite").option("ignoreNullFields", False).json(
                f"{path}/{name}"
            )
