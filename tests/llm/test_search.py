import numpy as np
import pytest

from critiq.llm import ann, exact_topk
from critiq.llm.blocks import ABSENT, merged

ROWS = "vec_id long, embedding array<float>, label int, rank int, block int, item int, score int"


def table(spark, rows):
    """Rows of (id, vector) with further columns whose names clash with our own."""
    return spark.createDataFrame([(i, v, 1, 2, 3, 4, 5) for i, v in rows], ROWS)


def vectors(n, dims=6, seed=1):
    rng = np.random.default_rng(seed)
    return [(i, [float(np.float32(x)) for x in rng.standard_normal(dims)]) for i in range(n)]


def brute(rows, asked, k, scale):
    """Plain ranking; rows of one id count once, with the smallest vector."""
    best = {}
    for i, v in rows:
        if v is not None and i is not None and all(x is not None and np.isfinite(x) for x in v):
            best[i] = min(best.get(i, v), v)
    made = {}
    for q in asked:
        if q not in best:
            continue
        scored = []
        for i, v in best.items():
            if i != q:
                pairs = zip(best[q], v)
                scored.append((-sum(scale(a) * scale(b) for a, b in pairs), i))
        made[q] = [(r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return made


def as_dict(df):
    made = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        made.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return made


ODD = [
    (500, None), (501, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (502, [float("nan")] * 6),
    (503, [float("inf")] + [0.0] * 5), (504, []), (505, [0.5, -0.25]), (506, [0.0] * 6),
    (None, [1.0] * 6),
]


def test_exact_topk_equals_plain_ranking(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "DATA_ROWS", 40)
    monkeypatch.setattr(exact_topk, "QUERY_ROWS", 8)
    rows = vectors(150) + ODD
    rows += [(600 + i, rows[3][1]) for i in range(20)] + [rows[3], rows[3]]
    rows += [(700, [3.0] * 6), (700, [-1.0] * 6)]
    data = table(spark, rows)
    asked = [i for i in [*range(0, 150, 10), 3, 505, 506, 504, 600, 700, 500]]
    found = exact_topk.exact_topk(data.filter(data.vec_id.isin(asked)), data, k=5)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    floor = lambda x: int(np.floor(256 * float(np.float32(x))))
    assert as_dict(found) == brute(rows, asked, 5, floor)


def test_exact_topk_of_large_components_and_few_rows(spark, monkeypatch):
    """2^24 components and more; 9e6 becomes 2,304,000,000."""
    rows = [(1, [9e6, 1.0]), (2, [9e6, -1.0]), (3, [8e6, 0.5]), (4, [-16777217.0, 3.0]),
            (5, [0.5, 0.25]), (6, [-0.3, 0.1]), (7, [3e38, -2.0])]
    rows += [(10 + i, v) for i, (_, v) in enumerate(vectors(40, 2))]
    data = table(spark, rows)
    floor = lambda x: int(float(np.float32(x)) * 256 // 1)
    want = brute(rows, [r[0] for r in rows], 5, floor)
    assert any(abs(s) > 1 << 62 for _, _, s in want[1])
    top = np.iinfo(np.int64)
    want = {q: [(r, i, min(max(s, top.min + 1), top.max)) for r, i, s in found]
            for q, found in want.items() if q != 7}
    for rows_per_block in (8192, 8):
        monkeypatch.setattr(exact_topk, "DATA_ROWS", rows_per_block)
        found = as_dict(exact_topk.exact_topk(data, data, k=5))
        found.pop(7)
        assert found == want


def test_searches_of_empty_tables(spark):
    none = table(spark, [])
    some = table(spark, vectors(5))
    for search in (exact_topk.exact_topk, ann.nearest):
        assert search(none, none).count() == 0
        assert search(some, none).count() == 0
        assert search(none, some).count() == 0


def test_bounds_never_lose_a_result():
    rng = np.random.default_rng(0)
    for trial in range(20):
        exact = rng.integers(-300, 300, (90, 5))
        if trial % 2:
            exact[30:80] = exact[30]
        low, high = exact.min(0), exact.max(0)
        width = -((low - high - 1) // 8)
        ids, q = np.sort(rng.choice(1000, 90, False)), rng.integers(-300, 300, (7, 5))
        scores, found = exact_topk.search_block(
            q, np.full(7, -1), exact_topk.cells(exact, low, width), exact, ids, low, width, 5
        )
        for i in range(7):
            want = sorted(zip(-(exact @ q[i]), ids))[:5]
            assert list(zip(-scores[i], found[i])) == want


def test_results_merge_by_score_then_id():
    a = np.array([[9, 5, 0]]), np.array([[4, 7, ABSENT]])
    b = np.array([[9, 5, 5]]), np.array([[2, 1, 8]])
    scores, ids = merged(a, b, 3)
    assert scores.tolist() == [[9, 9, 5]] and ids.tolist() == [[2, 4, 1]]


def test_every_code_within_the_radius_is_probed():
    rng = np.random.default_rng(2)
    tables, width, radius = 4, 6, 1
    bits = rng.integers(0, 2, (400, tables * width))
    values = bits.reshape(400, tables, width) @ (1 << np.arange(width)[::-1])
    rows, begins = ann.segment_tables(values, width)
    masks = ann.lookup_masks(width, radius)
    assert len(masks) == 7
    for i in range(30):
        found = set(ann.probe(values[i], rows, begins, masks).tolist())
        near = np.flatnonzero((bits != bits[i]).sum(1) <= tables * (radius + 1) - 1)
        assert set(near.tolist()) <= found


@pytest.mark.parametrize("share", [0.0, 0.4])
def test_nearest_reaches_the_recall(spark, monkeypatch, share):
    """Also where a large share of all rows are one vector."""
    monkeypatch.setattr(ann, "SEGMENT_ROWS", 700)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[: int(share * 1500)] = x[0]
    rows = [(i, [float(v) for v in x[i]]) for i in range(1500)]
    data = table(spark, rows)
    found = as_dict(ann.nearest(data.filter("vec_id % 20 = 0"), data, k=20))
    wide = x.astype(np.float64)
    hits = 0
    for q in range(0, 1500, 20):
        score = wide @ wide[q]
        score[q] = -9
        order = np.lexsort((np.arange(1500), -score))[:20]
        hits += len({i for _, i, _ in found[q]} & set(order.tolist()))
        assert [r for r, *_ in found[q]] == list(range(1, 21))
        for _, i, s in found[q]:
            assert abs(s - score[i]) < 1e-12
        keys = [(-s, i) for _, i, s in found[q]]
        assert keys == sorted(keys)
    assert hits >= 0.9 * 20 * 75


def test_nearest_leaves_out_what_takes_no_part(spark):
    rows = vectors(12) + ODD
    data = table(spark, rows)
    found = as_dict(ann.nearest(data, data, k=30))
    fine = {*range(12), 505}
    assert set(found) == fine
    assert all({i for _, i, _ in v} <= fine - {q} for q, v in found.items())


def test_recall_on_the_given_vectors(spark):
    data = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    found = ann.nearest(data.filter("vec_id % 20 = 0"), data, k=20)
    rows = [(r.vec_id, list(r.embedding)) for r in data.collect()]
    asked = [i for i, _ in rows if i % 20 == 0]
    want = brute(rows, asked, 20, float)
    got = as_dict(found)
    hits = sum(len({i for _, i, _ in got[q]} & {i for _, i, _ in want[q]}) for q in asked)
    assert hits >= 0.9 * 20 * len(asked)


def test_recall_with_mixed_norms_and_an_outlier(spark, monkeypatch):
    """One vector of norm 100 among others whose norms differ by a factor of 25."""
    monkeypatch.setattr(ann, "SEGMENT_ROWS", 700)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((1500, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = x * np.exp(rng.uniform(np.log(0.2), np.log(5.0), (1500, 1)))
    x[7] *= 100 / np.linalg.norm(x[7])
    x = x.astype(np.float32)
    rows = [(i, [float(v) for v in x[i]]) for i in range(1500)]
    data = table(spark, rows)
    found = as_dict(ann.nearest(data.filter("vec_id % 20 = 0"), data, k=20))
    wide = x.astype(np.float64)
    hits = 0
    for q in range(0, 1500, 20):
        score = wide @ wide[q]
        score[q] = -np.inf
        order = np.lexsort((np.arange(1500), -score))[:20]
        assert [r for r, *_ in found[q]] == list(range(1, 21))
        hits += len({i for _, i, _ in found[q]} & set(order.tolist()))
    assert hits >= 0.9 * 20 * 75


def test_queries_get_k_rows_where_they_exist(spark):
    """Opposite vectors share no bucket within reach."""
    rows = [(i, [1.0 + i / 1000] * 32) for i in range(40)] + [(99, [-1.0] * 32)]
    data = table(spark, rows)
    found = as_dict(ann.nearest(data.filter("vec_id = 99"), data, k=20))
    assert [r for r, *_ in found[99]] == list(range(1, 21))


def test_masks_grow_to_all_values():
    grown = ann.growing_masks(6, 2)
    assert sorted(grown[0].tolist()) == sorted(ann.lookup_masks(6, 2).tolist())
    assert len(grown) == 5 and sorted(grown[-1].tolist()) == list(range(64))


@pytest.mark.parametrize("clusters", [0, 50])
def test_a_tenth_of_the_rows_is_read_at_most(clusters):
    """10,000 rows in one segment: recall and vectors read."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((10_000, 64))
    if clusters:
        x = rng.standard_normal((clusters, 64))[rng.integers(0, clusters, len(x))] + 0.7 * x
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    own = ann.NormRange(1.0 + 1e-9, 13, 1, 0)
    own.centre, own.rotations = own.learned(x[: ann.SAMPLE_ROWS], ann.TABLES * 13)
    bits, ids = own.data_bits(x), np.arange(len(x))
    rows, begins = ann.segment_tables(ann.substrings(bits, 13), 13)
    asked = own.query_bits(x[::100])
    _, found, read = ann.search_segment(
        x[::100], ids[::100], ann.substrings(asked, 13), ann.packed_codes(asked), x, ids, rows,
        begins, ann.packed_codes(bits), ann.growing_masks(13, ann.PROBE_RADIUS), 20,
    )
    hits = 0
    for q, got in zip(ids[::100], found):
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(set(np.argsort(-score)[:20].tolist()) & set(got.tolist()))
    assert hits >= 0.9 * 20 * 100
    assert read.mean() <= 0.1 * len(x)


def test_unit_vectors_share_a_range():
    x = np.random.default_rng(1).standard_normal((400, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    size = (x.astype(np.float64) ** 2).sum(1)
    assert (size < 1).any() and (size >= 1).any()
    powers = np.floor(np.log2(size * (1 + ann.NORM_SLACK)))
    assert set(powers) == {0.0}
