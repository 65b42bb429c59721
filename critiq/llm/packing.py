"""Packing of tokenised documents into sequences of equal length.

Documents are tokenised once; the pieces' lengths form a histogram of at most ``CAPACITY``
bars, whatever the number of documents. On it a configuration linear program (fewest
sequences, each filled by one pattern of lengths) is solved by multiplicative weights: a
knapsack dynamic program over the capacity prices patterns, and each round raises the use of
the best full patterns of the lengths that are covered least, whose prices then fall. Uses are
rounded from the largest on, and the program is solved anew for what is left, until it places
little more; that rest is filled in by best fit over groups of equal sequences. The plan has a
size bound given by the capacity alone.
Pieces are numbered within their length in salted groups and look up their place in the plan.

Defined results: null text is empty and gives one piece of the end token. Longer documents are
cut from the end, so that only the first piece is shorter than the capacity. Repeated rows and
rows without an id are packed like all others. Empty tables give no rows; other columns are
ignored.
"""

from __future__ import annotations

import base64
import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from critiq.llm.common import map_texts, written

CAPACITY = 2048
END_ID = 0
ROUNDS = 30
#: An item's price is less by so many tokens, so that patterns of few items come first.
PER_ITEM = 4.0
NOISE = 0.01
#: How fast the price of a length falls with the share of its items that is covered.
RATE = 20.0
#: A round uses no length more than so many times its part.
SPREAD = 4.0
#: A pattern is used at least so often in a round.
MIN_STEP = 0.1
#: A solution that places less of the room left than this is the last one, and so is one that
#: leaves less than ``MIN_ROOM`` sequences.
MIN_GAIN = 0.1
MIN_ROOM = 40
ROWS_PER_GROUP = 1000
#: Texts of these characters only, with no long run and no special token, are split alike by
#: both tokenizer libraries; others go to the slower one.
_PLAIN = re.compile("[^\t\n\r\x20-\x7e\xc0-ſ]")
_LONG_RUN = 1000


def tokenizer_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path(
        "byte_bpe_50k.tiktoken"
    )


@lru_cache(maxsize=2)
def _fast(json_file: str, ranks_file: str):
    """The faster encoder, and the special tokens that it doesn't know."""
    import public_tokenizers
    import tiktoken

    with open(ranks_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    with open(json_file, "rb") as file:
        specials = [t["content"] for t in json.load(file)["added_tokens"]]
    return tiktoken.Encoding(
        "bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    ), specials


@lru_cache(maxsize=2)
def _exact(json_file: str):
    """The tokenizer itself; loaded only where a text needs it."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(json_file)


def token_ids(text: str | None, files: tuple[str, str]) -> np.ndarray:
    """Ids of a text by the tokenizer of ``files``, then the end token."""
    fast, specials = _fast(*files)
    text = text or ""
    plain = (
        not _PLAIN.search(text) and not any(s in text for s in specials)
        and max(map(len, text.split()), default=0) < _LONG_RUN
        and " " * _LONG_RUN not in text and "\n" * _LONG_RUN not in text
    )
    if plain:
        ids = fast.encode_to_numpy(text)
    else:
        ids = np.array(_exact(files[0]).encode(text, add_special_tokens=False).ids, np.uint32)
    return np.append(ids.astype("<u4"), np.uint32(END_ID))


def cut(length: int, capacity: int) -> np.ndarray:
    """Where the pieces of a document of that many tokens begin and end."""
    ends = np.arange(length, 0, -capacity)[::-1]
    return np.concatenate([[0], ends])


def token_pieces(
    docs: DataFrame, files: tuple[str, str], capacity: int, id_col: str, text_col: str
) -> DataFrame:
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = token_ids(text.as_py(), files)
                edges = cut(len(ids), capacity)
                raw = memoryview(ids.tobytes())
                for n, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    rows.append((doc, n, int(a), int(b - a), zlib.crc32(raw[4 * a : 4 * b])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(
                    zip(*rows, strict=True) if rows else [[]] * 5,
                    [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()], strict=True,
                )],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    texts = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    return map_texts(
        texts, pieces, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def _knapsack(lengths: np.ndarray, value: np.ndarray, capacity: int):
    """Best value of every capacity, and the last length taken (-1: none)."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int64)
    for c in range(1, capacity + 1):
        fit = np.searchsorted(lengths, c, "right")
        best[c] = best[c - 1]
        if fit:
            tried = best[c - lengths[:fit]] + value[:fit]
            top = int(tried.argmax())
            if tried[top] > best[c]:
                best[c], last[c] = tried[top], top
    return best, last


def _trace(last: np.ndarray, lengths: np.ndarray, c: int) -> list[int]:
    items = []
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            items.append(int(last[c]))
            c -= int(lengths[last[c]])
    return items


def configuration_program(
    lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS
) -> dict[tuple[int, ...], float]:
    """Fractional uses of full patterns (ascending indices into ``lengths``).

    Covering by multiplicative weights: a length's price is the room it takes, times a weight
    that falls with the share of its items that is covered. Each round prices patterns by one
    knapsack program and raises, for the lengths that are covered least, the use of the best
    pattern with that length, until a ``1 / rounds`` part of all room is used.
    """
    rng = np.random.default_rng(5)
    used: dict[tuple[int, ...], float] = {}
    covered = np.zeros(len(lengths))
    room = float((lengths * counts).sum()) / rounds
    for _ in range(rounds):
        weight = np.exp(-RATE * (covered - covered.min()))
        # Equal prices are told apart by a little noise, else all patterns share their fillers.
        price = lengths * weight * (1 + NOISE * rng.random(len(lengths))) - PER_ITEM
        _, last = _knapsack(lengths, price, capacity)
        taken, limit = np.zeros(len(lengths)), np.maximum(1.0, SPREAD * counts / rounds)
        filled = 0.0
        for lead in np.argsort(covered - lengths * 1e-9, kind="stable"):
            if filled >= room:
                break
            items = np.array([lead, *_trace(last, lengths, int(capacity - lengths[lead]))])
            size = int(lengths[items].sum())
            if size < capacity:
                continue
            which, times = np.unique(items, return_counts=True)
            step = float(((limit[which] - taken[which]) / times).min())
            if (times > counts[which]).any() or step < MIN_STEP:
                continue
            pattern = tuple(int(x) for x in np.repeat(which, times))
            used[pattern] = used.get(pattern, 0.0) + step
            taken[which] += step * times
            filled += step * size
        covered += taken / counts
        if not filled:
            break
    return used


def rounded_program(
    lengths: np.ndarray, left: np.ndarray, capacity: int
) -> list[tuple[int, tuple[int, ...]]]:
    """Whole uses of patterns, by solving and rounding in turn; lowers ``left``.

    Uses are rounded from the largest on, as far as the items go that are still left; what
    remains is solved anew, until a solution places little more.
    """
    plan: list[tuple[int, tuple[int, ...]]] = []
    while True:
        some = np.flatnonzero(left)
        before = int((lengths[some] * left[some]).sum())
        if before < MIN_ROOM * capacity:
            return plan
        solved = configuration_program(lengths[some], left[some].astype(float), capacity)
        for pattern, use in sorted(solved.items(), key=lambda x: (-x[1], x[0])):
            which, times = np.unique(some[list(pattern)], return_counts=True)
            n = min(max(1, int(use)), int((left[which] // times).min()))
            if n:
                left[which] -= n * times
                plan.append((n, tuple(int(x) for x in np.repeat(lengths[which], times))))
        if before - int((lengths * left).sum()) < MIN_GAIN * before:
            return plan


def packing_plan(
    lengths: np.ndarray, counts: np.ndarray, capacity: int
) -> list[tuple[int, tuple[int, ...]]]:
    """(number of sequences, lengths in each) that hold every item exactly once."""
    plan = [(int(n), (int(x),)) for x, n in zip(lengths, counts, strict=True) if x == capacity]
    short = lengths < capacity
    lengths, left = lengths[short].astype(np.int64), counts[short].astype(np.int64)
    if len(lengths) == 0:
        return plan
    rooms: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    for n, items in rounded_program(lengths, left, capacity):
        rooms.setdefault(capacity - sum(items), []).append((n, items))
    for i in np.argsort(-lengths, kind="stable"):
        length, todo = int(lengths[i]), int(left[i])
        while todo:
            room = next((c for c in range(length, capacity) if rooms.get(c)), None)
            if room is None:
                fit = capacity // length
                n = max(1, todo // fit)
                rooms.setdefault(capacity - length * min(fit, todo), []).append(
                    (n, (length,) * min(fit, todo))
                )
                todo -= n * min(fit, todo)
                continue
            n, items = rooms[room].pop()
            each = min(room // length, max(1, todo // n))
            take = min(n, todo // each)
            if take < n:
                rooms[room].append((n - take, items))
            rooms.setdefault(room - each * length, []).append((take, items + (length,) * each))
            todo -= take * each
    return plan + [g for c in sorted(rooms) for g in rooms[c]]


def _places(plan: list[tuple[int, tuple[int, ...]]]) -> tuple[np.ndarray, ...]:
    """Per run of equal places: length, first rank, first sequence and offset; sorted."""
    rows, begun, sequence = [], {}, 0
    for n, items in plan:
        offset = 0
        for length in items:
            rows.append((length, begun.get(length, 0), sequence, offset))
            begun[length] = begun.get(length, 0) + n
            offset += length
        sequence += n
    table = np.array(sorted(rows) or np.zeros((0, 4)), np.int64).reshape(-1, 4)
    return tuple(table.T.copy())


def pack(
    docs: DataFrame, files: tuple[str, str] | None = None, capacity: int = CAPACITY,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    files = files or tokenizer_files()
    pieces = written(token_pieces(docs, files, capacity, id_col, text_col))
    bars = pieces.groupBy("length").count().orderBy("length").collect()
    lengths = np.array([r["length"] for r in bars], np.int64)
    counts = np.array([r["count"] for r in bars], np.int64)
    of, rank0, sequence0, offset0 = _places(packing_plan(lengths, counts, capacity))

    # Rank within the length: salted groups of bounded size, and the counts before each.
    spark = docs.sparkSession
    groups = spark.createDataFrame(
        [(int(x), int(-(-n // ROWS_PER_GROUP))) for x, n in zip(lengths, counts, strict=True)],
        "length long, groups long",
    )
    salted = pieces.join(F.broadcast(groups), "length").withColumn(
        "salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("groups"))
    ).drop("groups")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(
        Window.unboundedPreceding, -1
    )
    first = salted.groupBy("length", "salt").count().select(
        "length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first")
    )
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("n", F.row_number().over(inside)).join(first, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("first") + F.col("n") - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = of * (1 << 42) + rank0
        for batch in batches:
            length = batch.column(3).to_numpy()
            rank = batch.column(5).to_numpy()
            at = np.searchsorted(keys, length * (1 << 42) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence0[at] + rank - rank0[at]),
                 pa.array(offset0[at])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, "
        "sequence_id long, offset long"
    )
