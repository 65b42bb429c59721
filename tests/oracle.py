"""Run registered queries against their SQL in DuckDB on the same files."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pyarrow as pa

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _rows(table: pa.Table) -> list[tuple]:
    names = sorted(table.column_names)

    def value(x):
        return round(x, 9) if isinstance(x, float) else x

    columns = [[value(x) for x in table[n].to_pylist()] for n in names]
    return sorted(zip(*columns), key=lambda r: tuple((x is None, str(x)) for x in r))


def _types(table: pa.Table) -> dict[str, str]:
    return {n: str(table.schema.field(n).type).replace("large_", "") for n in table.column_names}


def difference(spark, sf_dir: str, query, sql: str) -> str | None:
    """What differs between the two results, or None."""
    ours = query(spark, sf_dir).toArrow()
    con = connect(sf_dir)
    theirs = con.sql(sql).to_arrow_table()
    if _types(ours) != _types(theirs):
        return f"types {_types(ours)} / {_types(theirs)}"
    a, b = _rows(ours), _rows(theirs)
    if len(a) != len(b):
        return f"{len(a)} rows / {len(b)} rows; first {a[:1]} / {b[:1]}"
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        return f"{len(wrong)} of {len(a)} rows differ, first {str(wrong[0])[:1500]}"
    return None
