import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from critiq.llm import packing
from critiq.llm.packing import (
    cut, pack, packing_plan, rounded_program, token_ids, tokenizer_files,
)

FILES = tokenizer_files()
EXACT = Tokenizer.from_file(FILES[0])
DOCS = "doc_id long, text string, length int, rank int, salt int, piece int"


def ids_of(text):
    return [*EXACT.encode(text or "", add_special_tokens=False).ids, 0]


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(max_codepoint=0x3FF, exclude_categories=["Cs"]),
                         st.sampled_from(list(" \n\t'sdé1A")),
                         st.characters(exclude_categories=["Cs"])), max_size=40))
def test_ids_equal_the_tokenizer(text):
    assert token_ids(text, FILES).tolist() == ids_of(text)


@pytest.mark.parametrize("text", [
    None, "", "<|endoftext|>", "a<|endoftext|>b", " " * 3000 + "x", "a" * 5000, "\n" * 2500,
    "I'm we'll don't 'S", "é ß x\x85y\x1cz", "日本語 ١٢٣ ½²³", "x \t \n  y",
])
def test_ids_of_odd_texts(text):
    assert token_ids(text, FILES).tolist() == ids_of(text)


def held(plan, capacity):
    made = Counter()
    for n, items in plan:
        assert n > 0 and sum(items) <= capacity
        for x in items:
            made[x] += n
    return made


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 400), max_size=20))
def test_plans_hold_every_item_once(bars):
    lengths = np.array(sorted(bars), np.int64)
    counts = np.array([bars[x] for x in sorted(bars)], np.int64)
    plan = packing_plan(lengths, counts, 64)
    assert held(plan, 64) == Counter(bars)


def first_fit_decreasing(items, capacity):
    rooms = []
    for x in sorted(items, reverse=True):
        for i, room in enumerate(rooms):
            if room >= x:
                rooms[i] -= x
                break
        else:
            rooms.append(capacity - x)
    return len(rooms)


@pytest.mark.parametrize("seed", range(6))
def test_plans_need_few_sequences(seed):
    random.seed(seed)
    items = [random.choice([random.randint(1, 256), random.randint(60, 130), 85, 128])
             for _ in range(1500)]
    bars = Counter(items)
    lengths = np.array(sorted(bars), np.int64)
    plan = packing_plan(lengths, np.array([bars[x] for x in sorted(bars)], np.int64), 256)
    used = sum(n for n, _ in plan)
    assert used <= 1.002 * first_fit_decreasing(items, 256) + 1


def long_tailed(seed, n):
    """Histogram of lengths like those of a corpus: many short documents, few long ones."""
    drawn = np.random.default_rng(seed).lognormal(6.3, 1.1, n).astype(int).clip(1, 2047)
    return np.unique(drawn, return_counts=True)


def test_the_program_places_most_pieces():
    lengths, counts = long_tailed(1, 2500)
    left = counts.astype(np.int64)
    made = held(rounded_program(lengths.astype(np.int64), left, 2048), 2048)
    assert sum(made.values()) >= 0.5 * counts.sum()
    assert all(made[x] + n == c for x, n, c in zip(lengths, left, counts))
    used = sum(n for n, _ in packing_plan(lengths, counts, 2048))
    assert used <= -(-int((lengths * counts).sum()) // 2048) + 1


def test_the_program_helps_where_there_are_many(monkeypatch):
    lengths, counts = long_tailed(2, 1200)
    counts = counts * 100
    used = sum(n for n, _ in packing_plan(lengths, counts, 2048))
    monkeypatch.setattr(packing, "rounded_program", lambda *_: [])
    alone = sum(n for n, _ in packing_plan(lengths, counts, 2048))
    assert used <= alone


def test_configurations_beat_best_fit():
    """Thirds of the capacity that a decreasing fit pairs badly."""
    lengths, counts = np.array([26, 36, 38]), np.array([300, 300, 300])
    assert sum(n for n, _ in packing_plan(lengths, counts, 100)) <= 302


def test_only_the_first_piece_is_shorter():
    assert np.diff(cut(5000, 2048)).tolist() == [904, 2048, 2048]
    assert np.diff(cut(4096, 2048)).tolist() == [2048, 2048]
    assert np.diff(cut(1, 2048)).tolist() == [1]


def test_packed_table(spark):
    rng = np.random.default_rng(0)
    texts = ["word " * int(n) for n in rng.integers(1, 900, 120)]
    texts += ["same text"] * 300 + [None, "", "long text " * 4000, "x" * 30_000]
    rows = [(i, t, 1, 2, 3, 4) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, "no id", 1, 2, 3, 4)]
    docs = spark.createDataFrame(rows, DOCS)
    found = pack(docs).toPandas()
    assert list(found.columns) == [
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    want = Counter()
    for i, t, *_ in rows:
        ids = np.array(ids_of(t), "<u4")
        n = -(-len(ids) // 2048)
        edges = [0] + [len(ids) - 2048 * (n - 1 - j) for j in range(n)]
        for p, (a, b) in enumerate(zip(edges, edges[1:])):
            want[(i if i is not None else -1, p, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    got = Counter(
        (int(r.doc_id) if r.doc_id == r.doc_id else -1, r.piece, r.start, r.length, r.ids_crc32)
        for r in found.itertuples())
    assert got == want
    ends = {}
    for r in found.sort_values(["sequence_id", "offset"]).itertuples():
        assert ends.get(r.sequence_id, 0) == r.offset
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048
    assert len(ends) <= -(-int(found.length.sum()) // 2048) + 2


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], DOCS)).count() == 0
