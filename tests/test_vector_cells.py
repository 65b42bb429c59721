import math

import numpy as np
import pytest

from critiq.operators.vector_cells import (
    read_cells, requested_cells, search_cells, write_cells,
)
from critiq.operators.vector_search import vector_search

ROWS = "source_id string, embedding array<double>"
ASKED = "query_id long, embedding array<double>"


def vectors(n, dims, seed, clusters=12, spread=0.2):
    rng = np.random.default_rng(seed)
    middles = rng.standard_normal((clusters, dims))
    return middles[rng.integers(0, clusters, n)] + spread * rng.standard_normal((n, dims))


def table(spark, found, schema, name="v{:05}"):
    named = [(name.format(i) if isinstance(name, str) else i, [float(x) for x in v])
             for i, v in enumerate(found)]
    return spark.createDataFrame(named, schema).repartition(3)


def rows_of(found):
    return sorted((r[0], r["rank"], r[1], round(r.distance, 7)) for r in found.collect())


@pytest.mark.parametrize("metric, k", [("l2", 1), ("l2", 7), ("ip", 4), ("cosine", 5)])
def test_equals_the_scan(spark, tmp_path, metric, k):
    found = vectors(900, 8, 1) * np.linspace(0.2, 4, 900)[:, None]
    index = table(spark, found, ROWS)
    asked = table(spark, np.vstack([vectors(25, 8, 2), found[:5]]), ASKED, None)
    cells = write_cells(
        index, str(tmp_path / "c"), directions=metric == "cosine", rows_per_cell=40
    )
    assert len(cells.rings.numbers) > 15
    want = rows_of(vector_search(index, asked, k, metric=metric))
    assert rows_of(search_cells(cells, asked, k, metric=metric)) == want


def test_few_rows_are_read(spark, tmp_path):
    found = vectors(3000, 6, 3, clusters=30, spread=0.05)
    cells = write_cells(table(spark, found, ROWS), str(tmp_path / "c"), rows_per_cell=60)
    asked = table(spark, found[::100], ASKED, None).toDF("query", "vector")
    first, others, _ = requested_cells(cells, asked, 5)
    pairs = first.unionByName(others).select("query", "cell").distinct().collect()
    held = dict(zip(cells.rings.numbers.tolist(), cells.rings.rows.tolist()))
    read = sum(held[r.cell] for r in pairs)
    assert read < 0.2 * 3000 * 30


def test_ties_zero_and_odd_vectors(spark, tmp_path):
    found = np.vstack([np.ones((300, 3)), np.zeros((20, 3)), vectors(100, 3, 4)])
    found = np.vstack([found, [[math.nan, 1, 1], [math.inf, 0, 0]]])
    index = table(spark, found, ROWS)
    asked = table(spark, [[1, 1, 1], [0, 0, 0], [-1, 2, 0.5], [math.nan, 0, 0]], ASKED, None)
    for metric in ("l2", "cosine", "ip"):
        cells = write_cells(
            index, str(tmp_path / metric), directions=metric == "cosine", rows_per_cell=30
        )
        want = rows_of(vector_search(index, asked, 6, metric=metric))
        assert rows_of(search_cells(cells, asked, 6, metric=metric)) == want


def test_float_vectors_and_long_ids_are_kept(spark, tmp_path):
    found = vectors(400, 5, 6).astype(np.float32)
    index = table(spark, found, "n long, e array<float>", None)
    asked = table(spark, found[:10].astype(float), ASKED, None)
    write_cells(index, str(tmp_path / "c"), id_column="n", vector_column="e", rows_per_cell=50)
    cells = read_cells(spark, str(tmp_path / "c"))
    assert cells.rings.single
    got = search_cells(cells, asked, 3, id_column="n")
    want = vector_search(index, asked, 3, id_column="n", vector_column="e")
    assert rows_of(got) == rows_of(want)


def test_k_beyond_the_rows_and_refusals(spark, tmp_path):
    index = table(spark, vectors(7, 4, 8), ROWS)
    asked = table(spark, vectors(3, 4, 9), ASKED, None)
    cells = write_cells(index, str(tmp_path / "c"), rows_per_cell=2)
    assert rows_of(search_cells(cells, asked, 50)) == rows_of(vector_search(index, asked, 50))
    assert search_cells(cells, asked.limit(0), 3).isEmpty()
    with pytest.raises(ValueError):
        search_cells(cells, asked, 0)
    with pytest.raises(ValueError):
        search_cells(cells, asked, 1, metric="cosine")
    empty = write_cells(index.limit(0), str(tmp_path / "none"))
    with pytest.raises(ValueError):
        search_cells(empty, asked, 1)
