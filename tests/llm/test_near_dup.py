import re

import numpy as np
import pyarrow as pa
import pytest

from critiq.llm import near_dup
from critiq.llm.components import connected
from critiq.llm.common import text_buffers, word_hashes

COLUMNS = "doc_id long, text string, n long, kept string, component_id int, doc int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2, 3) for i, t in rows], COLUMNS)


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split("[\x20\x09-\x0d]+", low) if w]
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    label = {i: i for i, _ in rows}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            both = len(s & t)
            if both and 100 * both >= 75 * len(s | t):
                x, y = sorted((root(i), root(j)))
                label[y] = x
    return {i: (len(s), root(i), root(i) == i) for i, s in sets}


def corpus(seed=0, families=12):
    rng = np.random.default_rng(seed)
    word = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for f in range(families):
        base = rng.choice(word, rng.integers(8, 120)).tolist()
        for _ in range(rng.integers(1, 9)):
            copy = list(base)
            for _ in range(rng.integers(0, max(1, len(base) // 12))):
                copy[rng.integers(len(copy))] = f"x{rng.integers(10**6)}"
            rows.append((n * 7 % 1009, " ".join(copy)))
            n += 1
    return rows


def check(spark, rows):
    found = near_dup.near_duplicates(table(spark, rows))
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found.collect()}
    assert got == brute(rows)


def test_components_equal_plain_ones(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 3)
    rows = corpus()
    text = rows[0][1]
    rows += [
        (2000, None), (2001, ""), (2002, " \n\t"), (2003, "One two"), (2004, "one  TWO"),
        (2005, "Émile one"), (2006, "émile one"), (2007, text.upper()), (2008, text + " end"),
        (2009, "a b c d e"), (2010, "a b c d e "), (2011, "same " * 300), (2012, "same " * 20),
        (2013, "x\x1cy\x85z a b c"), (2014, "y" * 300_000), (2015, " ".join(map(str, range(30_000)))),
    ]
    check(spark, rows)


def test_chain_of_versions_is_one_component(spark):
    words = [f"c{i}" for i in range(140)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 60])) for i in range(20)]
    check(spark, rows)
    assert brute(rows)[19][1] == 0


def test_large_group_around_the_threshold(spark):
    """Many versions, linked to some and not to others, meet in the same buckets."""
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(120):
        copy = list(base)
        for _ in range(rng.integers(1, 4)):
            copy[rng.integers(60)] = f"v{rng.integers(40)}"
        rows.append((i, " ".join(copy)))
    check(spark, rows)


def test_rows_without_id_and_repeated_rows(spark):
    text = " ".join(f"t{i}" for i in range(30))
    rows = [(None, text), (5, text), (5, text), (3, text), (None, None)]
    got = near_dup.near_duplicates(table(spark, rows)).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got if r.doc_id is not None) == [
        (3, 3, True), (5, 3, False), (5, 3, False),
    ]
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)] * 2
    left = near_dup.one_of_each(table(spark, rows + [(8, "lone one"), (8, "lone one")]))
    assert left.columns == [c.split()[0] for c in COLUMNS.split(", ")]
    assert sorted((r.doc_id or -1, r.text or "") for r in left.collect()) == [
        (-1, ""), (-1, text), (3, text), (8, "lone one"),
    ]


def test_empty_table(spark):
    assert near_dup.near_duplicates(table(spark, [])).count() == 0
    assert near_dup.one_of_each(table(spark, [])).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(9)
    pool = rng.integers(0, 1 << 62, 4000).astype(np.uint64)
    one, two = np.unique(pool[:3000]), np.unique(pool[1000:])
    a, b = near_dup.min_max_signatures([one, two])
    assert abs((a == b).mean() - 0.5) < 0.15
    assert not near_dup.min_max_signatures([np.zeros(0, np.uint64)]).any()


@pytest.mark.parametrize("common", [0, 300, 600, 700, 899, 1000])
def test_bound_never_hides_a_link(common):
    rng = np.random.default_rng(common)
    pool = rng.integers(0, 1 << 62, 3000).astype(np.uint64)
    x, y = np.unique(pool[:1000]), np.unique(np.append(pool[:common], pool[1000 : 2000 - common]))
    both = len(np.intersect1d(x, y))
    linked = 100 * both >= 75 * (len(x) + len(y) - both)
    assert near_dup.may_be_similar(near_dup.bars(x), near_dup.bars(y), len(x), len(y)) >= linked


def test_word_hashes_follow_the_word_definition():
    texts = ["Foo  bar\nfoo", None, "", "  ", "FOO", "été Été", "a\x0bb\x1cc"]
    data, offsets = text_buffers(pa.array(texts))
    hashes, bounds = word_hashes(data, offsets)
    assert np.diff(bounds).tolist() == [3, 0, 0, 0, 1, 2, 2]
    assert hashes[0] == hashes[2] == hashes[3] and hashes[0] != hashes[1]
    assert hashes[4] != hashes[5]


def test_connected_labels(spark):
    rng = np.random.default_rng(1)
    edges = [(i, i + 1) for i in range(60)] + [(int(a), int(b)) for a, b in
                                              rng.integers(100, 400, (150, 2))] + [(7, 7)]
    label = {}

    def root(x):
        label.setdefault(x, x)
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            label[y] = x
    got = connected(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.label for r in got} == {x: root(x) for x in label}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0
