import math
import re
from collections import Counter

import pytest

from critiq.llm.mixing import mix_sources, mixed_rows, plan_mix, solve_exponent

DOCS = "doc_id long, text string, source string, epochs int, `end` int, block int"


def documents(spark, sizes=(("a", 700), ("b", 150), ("c", 40), (None, 25))):
    rows, n = [], 0
    for source, count in sizes:
        for i in range(count):
            rows.append((n, "w " * (i % 9), source, 1, 2, 3))
            n += 1
    return spark.createDataFrame(rows, DOCS), rows


def tokens(text):
    return len([w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]) + 1


def sizes(rows):
    made = Counter()
    for r in rows:
        made[r[2]] += tokens(r[1])
    return made


def weights(size, exponent):
    total = sum(size.values())
    raised = {s: (n / total) ** exponent for s, n in size.items()}
    return {s: r / sum(raised.values()) for s, r in raised.items()}


def bisected(size, fits):
    low, high = 0.0, 1.0
    if fits(weights(size, 0.0)):
        return 0.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if fits(weights(size, middle)) else (middle, high)
    return high


def test_covering_mix_draws_every_document(spark):
    docs, rows = documents(spark)
    size = sizes(rows)
    top = max(size.values())

    def fits(w):
        budget = max(size[s] / w[s] for s in size)
        return max(budget * w[s] / size[s] for s in size) <= 2.0 + 1e-12

    mix = plan_mix(docs, max_repeats=2.0)
    assert abs(mix.exponent - bisected(size, fits)) < 1e-6
    drawn = mixed_rows(docs, mix).collect()
    times = Counter(r.doc_id for r in drawn)
    assert set(times) == {r[0] for r in rows} and max(times.values()) <= 2
    assert all(times[r[0]] == 1 for r in rows if r[2] == "a")
    got = Counter()
    for r in drawn:
        got[r.source] += tokens(r.text)
    for s in size:
        want = math.floor(size[s] * (size[s] / top) ** (mix.exponent - 1) + 1e-6)
        assert want - 10 <= got[s] <= want


@pytest.mark.parametrize("entropy", [1.0, 0.8])
def test_mix_of_a_given_entropy_and_budget(spark, entropy):
    docs, rows = documents(spark)
    size = sizes(rows)

    def fits(w):
        return -sum(x * math.log(x) for x in w.values()) <= entropy

    mix = plan_mix(docs, budget_share=0.5, max_repeats=None, entropy=entropy)
    exponent = bisected(size, fits)
    assert abs(mix.exponent - exponent) < 1e-6
    got = Counter()
    for r in mixed_rows(docs, mix).collect():
        got[r.source] += tokens(r.text)
    for s, w in weights(size, exponent).items():
        target = w * 0.5 * sum(size.values())
        assert target - 11 <= got[s] <= target + 1


def test_epochs_are_block_permutations(spark):
    docs, _ = documents(spark, (("a", 300), ("b", 60)))
    drawn = mixed_rows(docs, plan_mix(docs, max_repeats=3.0)).collect()
    order = {}
    for e in (1, 2):
        part = sorted((r["__block"], r["__row"], r.doc_id)
                      for r in drawn if r.source == "b" and r["__epoch"] == e)
        order[e] = [d for _, _, d in part]
    assert len(order[1]) == 60 and set(order[2]) <= set(order[1])
    assert order[2] != [d for d in order[1] if d in set(order[2])]


def test_odd_rows_and_columns(spark):
    rows = [(1, None, "s", 0, 0, 0), (1, None, "s", 0, 0, 0), (None, "", None, 0, 0, 0),
            (2, "x " * 100_000, "t", 0, 0, 0), (3, "a b", "t", None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    out = mix_sources(docs)
    assert out.columns == docs.columns
    times = Counter(r.doc_id for r in out.collect())
    assert set(times) == {1, 2, 3, None} and times[2] == 1 and times[1] in (2, 4)
    assert mix_sources(docs.limit(0)).count() == 0
    assert Counter(r.doc_id for r in mix_sources(docs).collect()) == times
    with pytest.raises(ValueError):
        plan_mix(docs, max_repeats=2.0, entropy=1.0)


def test_targets_beyond_the_natural_shares(spark):
    shares = spark.createDataFrame([(0.6,), (0.3,), (0.1,)], "share double")
    x = solve_exponent(shares, None, None, 0.3)
    w = [s**x for s in (0.6, 0.3, 0.1)]
    w = [y / sum(w) for y in w]
    assert x > 1 and abs(-sum(y * math.log(y) for y in w) - 0.3) < 1e-6
    even = spark.createDataFrame([(0.5,), (0.5,)], "share double")
    with pytest.raises(ValueError):
        solve_exponent(even, None, None, 0.3)
    with pytest.raises(ValueError):
        solve_exponent(shares, 3.0, 2.0, None)
    assert solve_exponent(shares, 2.0, 2.0, None) == 1.0
