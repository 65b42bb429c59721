"""Near-duplicate documents by min-max hashing.

A document is the set of its distinct five-word shingles. Each of ``PERMUTATIONS`` random
functions of a set gives two signature values, the least and the greatest hash, so that half
the hash evaluations of plain MinHash are needed. Bands of ``BAND_ROWS`` values are bucket
keys. At a similarity of 0.75 a pair of large sets shares no band with a probability of 5 in a
million; of sets of 3 and 4 shingles, whose least and greatest hash agree less often together,
with 1 in 10,000. A pair that shares a band is never lost.

1. One scan gives set size, set fingerprint and bucket keys. Equal sets form one class;
   only the class representative goes on.
2. In each bucket every member is held against the smallest one; the pairs are confirmed on
   full sets and joined to components.
3. Buckets whose members are still in several components are compared in full, but for pairs
   inside the largest of them: in pairs of blocks of about ``BLOCK`` members, so that a hot
   bucket is dealt to many tasks, and inside a task
   by an upper bound of what two sets share, so that hardly other pairs than links leave it. They are confirmed on full sets as well. Pairs inside one component need
   no confirmation.

No bucket, group or number of partners is capped.

Defined results: text that is null, empty or has no words has an empty set and is linked with
nothing; fewer than five words are one shingle. Rows without an id keep their own row with a
null component and ``kept`` true. Rows that share an id are judged one by one and bear the
same id in links. Other columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from critiq.llm.common import (
    chunks, dropped, map_texts, mixed, packed, text_buffers, word_hashes, written,
)
from critiq.llm.components import connected

SHINGLE_WORDS = 5
PERMUTATIONS = 64
BAND_ROWS = 4
SIMILAR = (75, 100)
BLOCK = 256
FULL_BAR = 255
#: Bars are first compared folded to at most so many.
FOLD = 128
_SEED = 20240917
_STEP = 0xD6E8FEB86659FD93


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs of five words, repeats included; shorter sequences are one."""
    n = len(words)
    if n == 0:
        return words
    length = min(n, SHINGLE_WORDS)
    total = np.zeros(n - length + 1, np.uint64)
    for j in range(length):
        total += words[j : j + len(total)] * np.uint64(pow(_STEP, j, 1 << 64))
    return mixed(total + np.uint64(length))


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The ascending distinct shingle hashes of each text."""
    data, offsets = text_buffers(texts)
    for first, last in chunks(data, offsets):
        part = offsets[first : last + 1]
        words, bounds = word_hashes(data[part[0] : part[-1]], part - part[0])
        for i in range(last - first):
            yield np.unique(shingle_hashes(words[bounds[i] : bounds[i + 1]]))


def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(_SEED)
    factor = rng.integers(0, 1 << 63, PERMUTATIONS, np.int64).astype(np.uint64)
    return factor << np.uint64(1) | np.uint64(1), rng.integers(
        0, 1 << 63, PERMUTATIONS, np.int64
    ).astype(np.uint64)


def min_max_signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(documents x 2 * PERMUTATIONS) values; rows of empty sets are zero."""
    made = np.zeros((len(sets), 2 * PERMUTATIONS), np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return made
    flat = np.concatenate([sets[i] for i in full])
    begins = np.cumsum([0] + [len(sets[i]) for i in full[:-1]])
    high = np.uint64(32)
    for k, (factor, shift) in enumerate(zip(*_functions(), strict=True)):
        image = (flat * factor + shift) >> high
        made[full, 2 * k] = np.minimum.reduceat(image, begins)
        made[full, 2 * k + 1] = np.maximum.reduceat(image, begins)
    return made


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """(documents x bands) bucket keys; the band's number is part of the key."""
    bands = signatures.shape[1] // BAND_ROWS
    rows = signatures.reshape(len(signatures), bands, BAND_ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), rows.shape[:2]).copy()
    for j in range(BAND_ROWS):
        key = mixed(key * np.uint64(_STEP) + rows[:, :, j])
    return key.view(np.int64)


def _groups(texts: pa.Array, bytes_at_once: int = 1 << 21) -> Iterator[list[np.ndarray]]:
    held, size = [], 0
    for made in shingle_sets(texts):
        held.append(made)
        size += made.nbytes
        if size >= bytes_at_once:
            yield held
            held, size = [], 0
    if held:
        yield held


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    salt = np.uint64(0x5851F42D4C957F2D)
    for batch in batches:
        at = 0
        for sets in _groups(batch.column(1)):
            signatures = min_max_signatures(sets)
            marks = [(int(s.sum()), int(mixed(s ^ salt).sum())) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(at, len(sets)),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(np.array([m[0] for m in marks], np.uint64).view(np.int64)),
                    pa.array(np.array([m[1] for m in marks], np.uint64).view(np.int64)),
                    pa.array([packed(s) for s in signatures], pa.binary()),
                ],
                names=["doc", "n", "mark", "mark2", "signature"],
            )
            at += len(sets)


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            rows = np.array([np.frombuffer(x, np.uint32) for x in part.column(1).to_pylist()])
            keys = band_keys(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(part.column(0).to_numpy(), keys.shape[1])),
                    pa.array(keys.ravel()),
                ],
                names=["doc", "key"],
            )


def bars(hashes: np.ndarray) -> np.ndarray:
    """Counts of a set's hashes by their low bits, in at least twice as many bars as hashes."""
    size = 1 << max(6, int(2 * len(hashes) - 1).bit_length())
    counts = np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.minimum(counts, FULL_BAR).astype(np.uint8)


def may_be_similar(x: np.ndarray, y: np.ndarray, n_x: int, n_y: int) -> bool:
    """Whether two sets can reach the similarity, by an upper bound of what they share."""
    while len(x) > len(y):
        x, y = y, x
    if x.max() == FULL_BAR or y.max() == FULL_BAR:
        return True
    folded = y.reshape(-1, len(x)).sum(0, dtype=np.int64)
    most = int(np.minimum(x, folded).sum())
    part, whole = SIMILAR
    return whole * most >= part * (n_x + n_y - most)


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for sets in _groups(batch.column(1)):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, len(sets)),
                 pa.array([packed(s) for s in sets], pa.binary()),
                 pa.array([packed(bars(s)) for s in sets], pa.binary())],
                names=["doc", "hashes", "bars"],
            )
            at += len(sets)


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, whole = SIMILAR
    for batch in batches:
        linked = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x = np.frombuffer(x.as_buffer(), np.uint64)
            y = np.frombuffer(y.as_buffer(), np.uint64)
            place = np.minimum(np.searchsorted(y, x), len(y) - 1)
            common = int((y[place] == x).sum())
            linked.append(whole * common >= part * (len(x) + len(y) - common))
        keep = pa.array(linked, pa.bool_())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"]
        )


def _similar_size(x: str, y: str):
    part, whole = SIMILAR
    return (F.col(x) * whole >= F.col(y) * part) & (F.col(y) * whole >= F.col(x) * part)


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("doc").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("doc").alias("b"), F.col("hashes").alias("y"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return rows.mapInArrow(_confirmed, "a long, b long")


def _pairs_in_block(key: tuple, table: pa.Table) -> pa.Table:
    """Pairs of two blocks of a bucket that are in different components and may be links."""
    one, two = key[1].as_py(), key[2].as_py()
    docs, comps, sizes = (table[c].to_numpy() for c in ("doc", "comp", "n"))
    sides = table["side"].to_numpy()
    counts = [np.frombuffer(x, np.uint8) for x in table["bars"].to_pylist()]
    part, whole = SIMILAR
    widths = np.array([len(c) for c in counts])
    full = np.array([c.max(initial=0) == FULL_BAR for c in counts])
    folds: dict[int, np.ndarray] = {}

    def reachable(i: int, other: np.ndarray) -> np.ndarray:
        """Those whose folded bars don't rule a link out, by one bound for all of them."""
        width = min(int(widths[other].min()), int(widths[i]), FOLD)
        if width not in folds:
            folds[width] = np.array([
                c.reshape(-1, width).sum(0, dtype=np.int32) if len(c) >= width
                else np.zeros(width, np.int32) for c in counts
            ])
        held = folds[width]
        most = np.minimum(held[other], held[i]).sum(1, dtype=np.int64)
        near = whole * most >= part * (sizes[other] + sizes[i] - most)
        return other[near | full[other] | full[i]]

    left = np.flatnonzero(sides == one)
    right = left if one == two else np.flatnonzero(sides == two)
    a, b = [], []
    for i in left:
        other = right[docs[right] > docs[i]] if one == two else right
        size = sizes[other]
        other = other[
            (comps[other] != comps[i]) & (size * whole >= sizes[i] * part)
            & (sizes[i] * whole >= size * part)
        ]
        if len(other):
            other = reachable(i, other)
            fine = [may_be_similar(counts[i], counts[j], sizes[i], sizes[j]) for j in other]
            other = other[np.array(fine, bool)]
            a.append(np.full(len(other), docs[i]))
            b.append(docs[other])
    none = np.zeros(0, np.int64)
    a, b = np.concatenate([none, *a]), np.concatenate([none, *b])
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    signed = written(map_texts(
        texts, _signed, "doc long, n long, mark long, mark2 long, signature binary"
    ))
    mark = ["mark", "mark2", "n"]
    known = F.col("doc").isNotNull() & (F.col("n") > 0)
    # Small tables are written before they are joined: Spark then broadcasts them if it may, and
    # else can split a hot key of the large side.
    equal = written(
        signed.filter(known).groupBy(*mark)
        .agg(F.min("doc").alias("class"), F.count("*").alias("copies"))
        .filter("copies > 1").drop("copies")
    )
    members = written(
        signed.join(equal, mark, "left").select(
            "doc", "n", F.coalesce("class", "doc").alias("class"), "signature"
        )
    )
    dropped(signed)
    heads = members.filter(known & (F.col("doc") == F.col("class")))
    heads = heads.select("doc", "n", "signature")
    keys = heads.select("doc", "signature").mapInArrow(_banded, "doc long, key long")
    keys = written(keys)
    buckets = keys.groupBy("key").agg(
        F.min("doc").alias("head"), F.max("doc").alias("last")
    ).filter(F.col("head") < F.col("last"))
    live = written(keys.join(written(buckets.drop("last")), "key"))
    dropped(keys)
    involved = written(live.select("doc").distinct())
    sizes = heads.select("doc", "n").join(involved, "doc", "left_semi").distinct()
    again = texts.join(involved.hint("shuffle_hash"), "doc", "left_semi")
    sets = map_texts(again, _set_rows, "doc long, hashes binary, bars binary")
    sets = written(sets.filter(F.length("hashes") > 0))
    star = (
        live.filter(F.col("doc") != F.col("head"))
        .select(F.col("head").alias("a"), F.col("doc").alias("b")).distinct()
        .join(sizes.select(F.col("doc").alias("a"), F.col("n").alias("n_a")), "a")
        .join(sizes.select(F.col("doc").alias("b"), F.col("n").alias("n_b")), "b")
        .filter(_similar_size("n_a", "n_b")).select("a", "b")
    )
    links = written(confirmed(star, sets))
    labels = connected(links)

    placed = live.join(
        labels.select(F.col("node").alias("doc"), F.col("label")), "doc", "left"
    ).select("key", "doc", F.coalesce("label", "doc").alias("comp"))
    placed = written(placed)
    # Members of a bucket's largest component meet the others only, never each other: they lie
    # in blocks below zero, the others in blocks from zero on.
    several = (
        placed.groupBy("key", "comp").agg(F.count("*").alias("n"))
        .groupBy("key").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("n"))
        .filter(F.col("top.n") < F.col("n"))
    )
    several = written(several.select(
        "key", F.col("top.comp").alias("main"),
        F.ceil(F.col("top.n") / BLOCK).cast("int").alias("mains"),
        F.ceil((F.col("n") - F.col("top.n")) / BLOCK).cast("int").alias("rests"),
    ))
    is_main = F.col("comp") == F.col("main")
    spread = F.xxhash64("doc")
    rows = (
        placed.join(several, "key")
        .withColumn("side", F.when(is_main, -1 - F.pmod(spread, F.col("mains")))
                    .otherwise(F.pmod(spread, F.col("rests"))).cast("int"))
        .withColumn("other", F.explode(F.sequence(
            F.when(is_main, F.lit(0)).otherwise(-F.col("mains")), F.col("rests") - 1)))
        .withColumn("one", F.least("side", "other")).withColumn("two", F.greatest("side", "other"))
        .join(heads.dropDuplicates(["doc"]).select("doc", "n"), "doc")
        .join(sets.select("doc", "bars"), "doc")
        .select("key", "one", "two", "doc", "comp", "n", "side", "bars")
    )
    more = rows.groupBy("key", "one", "two").applyInArrow(_pairs_in_block, "a long, b long")
    further = written(confirmed(more.distinct(), sets))
    if further.limit(1).count():
        labels = connected(links.union(further))

    found = members.select("doc", "n", "class").join(
        labels.select(F.col("node").alias("class"), F.col("label")), "class", "left"
    )
    component = F.when(F.col("doc").isNotNull(), F.coalesce("label", "class"))
    return found.select(
        F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("doc") == component, F.lit(True)).alias("kept"),
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` without those whose group keeps another document.

    Repeated rows of one id count as copies: the first of them in the order of all their
    columns stays. Rows without an id stay.
    """
    judged = near_duplicates(docs, id_col, text_col)
    gone = written(judged.filter(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct())
    left = docs.join(gone, F.col(id_col) == F.col("__gone"), "left_anti")
    again = docs.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id"))
    again = again.count().filter("count > 1").select("__id")
    if again.limit(1).count() == 0:
        return left
    again = written(again)
    single = left.join(again, F.col(id_col) == F.col("__id"), "left_anti")
    repeated = left.join(again, F.col(id_col) == F.col("__id"), "left_semi")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    first = repeated.groupBy(F.col(id_col).alias("__id")).agg(F.min(whole).alias("__row"))
    return single.unionByName(first.select("__row.*"))
