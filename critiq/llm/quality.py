"""Quality of documents: random-indexing word vectors and a small calibrated network.

A text is read as runs of letters, digits or other signs (case kept, digits alike), each hashed
to one of ``BUCKETS`` word places. Every place has a sparse random index vector; its word vector
is the sum of the index vectors of what stands before and after it in all documents, in whole
numbers, so that the result doesn't depend on the order of work. A document is pooled from its
words' vectors: mean, spread, and mean product of neighbours. A two-layer network is trained on
at most ``SAMPLE_ROWS`` labelled rows (a documented bound, taken by hash of the id) and its
outputs are calibrated by one temperature on rows kept from training.

Defined results: null and empty texts are pooled to zeros and get the network's value for that.
Labels other than 0 and 1 are ignored; with labels of one class only the score is that class,
without any it is 0.5. A row without an id isn't held out. Repeated rows are scored one by one,
repeated labels count once each. Other columns are passed on or ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from critiq.llm.common import (
    SPACE, chunks, hash_fraction, map_texts, packed, run_hashes, text_buffers,
)

BUCKETS = 1 << 14
DIMS = 24
NONZEROS = 3
SAMPLE_ROWS = 20_000
HIDDEN = 32
EPOCHS = 60
THRESHOLD = 0.7
FEATURES = 3 * DIMS + 1
_PIECE = 1 << 19

#: 0 white space, 1 letters, 2 digits, 3 other signs.
_KIND = np.full(256, 3, np.uint8)
_KIND[SPACE] = 0
_KIND[65:91] = 1
_KIND[97:123] = 1
_KIND[128:] = 1
_KIND[48:58] = 2
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[48:58] = 48


def token_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word place of every run, and the bounds of each document's runs."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    kind = _KIND[data]
    first = np.empty(len(kind), bool)
    first[0] = True
    first[1:] = kind[1:] != kind[:-1]
    first[offsets[(offsets > 0) & (offsets < len(data))]] = True
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], len(kind))
    solid = kind[starts] != 0
    starts, ends = starts[solid], ends[solid]
    places = (run_hashes(_FOLD[data], starts, ends) % np.uint64(BUCKETS)).astype(np.int64)
    return places, np.searchsorted(starts, offsets)


def _index_vectors(after: bool) -> tuple[np.ndarray, np.ndarray]:
    """Dimensions and signs (places x NONZEROS) of the index vectors."""
    rng = np.random.default_rng(31 + after)
    return (
        rng.integers(0, DIMS, (BUCKETS, NONZEROS)),
        rng.choice(np.array([-1, 1]), (BUCKETS, NONZEROS)),
    )


def context_sums(docs: DataFrame, text_col: str) -> DataFrame:
    """(place, d0, d1, ...) summed over all documents."""
    names = [f"d{i}" for i in range(DIMS)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS * DIMS)
        sides = [_index_vectors(False), _index_vectors(True)]
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for a, b in chunks(data, offsets):
                part = offsets[a : b + 1]
                places, bounds = token_runs(data[part[0] : part[-1]], part - part[0])
                if len(places) < 2:
                    continue
                same = np.ones(len(places) - 1, bool)
                cuts = bounds[1:-1]
                same[cuts[(cuts > 0) & (cuts < len(places))] - 1] = False
                left, right = places[:-1][same], places[1:][same]
                for word, near, (dims, signs) in (
                    (right, left, sides[0]), (left, right, sides[1]),
                ):
                    total += np.bincount(
                        (word[:, None] * DIMS + dims[near]).ravel(),
                        weights=signs[near].ravel(), minlength=BUCKETS * DIMS,
                    )
        rows = total.reshape(BUCKETS, DIMS).astype(np.int64)
        seen = np.flatnonzero(rows.any(1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen, pa.int64()), *[pa.array(rows[seen, i]) for i in range(DIMS)]],
            names=["place", *names],
        )

    schema = "place long, " + ", ".join(f"{n} long" for n in names)
    rows = map_texts(docs.select(text_col), count, schema)
    return rows.groupBy("place").agg(*[F.sum(n).alias(n) for n in names])


def pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """(documents x FEATURES) pooled word vectors."""
    data, offsets = text_buffers(texts)
    made = np.zeros((len(offsets) - 1, FEATURES), np.float32)
    for a, b in chunks(data, offsets):
        part = offsets[a : b + 1]
        places, bounds = token_runs(data[part[0] : part[-1]], part - part[0])
        n = np.diff(bounds)
        if not n.any():
            continue
        sums = np.zeros((3, b - a, DIMS))
        document = np.repeat(np.arange(b - a), n)
        for at in range(0, len(places), _PIECE // 4):
            stop = min(len(places), at + _PIECE // 4)
            own = document[at:stop]
            begins = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            e = vectors[places[at:stop]]
            following = vectors[places[at + 1 : stop + 1]]
            beside = np.zeros_like(e)
            inside = document[at + 1 : stop + 1] == own[: len(following)]
            beside[: len(following)] = e[: len(following)] * following * inside[:, None]
            for i, x in enumerate((e, e * e, beside)):
                sums[i, own[begins]] += np.add.reduceat(x, begins, axis=0)
        share = np.maximum(n, 1)[:, None]
        mean = sums[0] / share
        spread = np.sqrt(np.maximum(0.0, sums[1] / share - mean**2))
        beside = sums[2] / np.maximum(n - 1, 1)[:, None]
        made[a:b] = np.hstack([mean, spread, beside, np.log1p(n)[:, None]])
    return made


@dataclass
class QualityModel:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float

    def logits(self, features: np.ndarray) -> np.ndarray:
        x = (features - self.mean) / self.scale
        w1, b1, w2, b2 = self.layers
        return np.maximum(0.0, x @ w1 + b1) @ w2 + b2

    def score(self, texts: pa.Array) -> np.ndarray:
        z = self.logits(pooled(texts, self.vectors).astype(np.float64)) / self.temperature
        return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))


def train_network(x: np.ndarray, y: np.ndarray, seed: int = 5) -> list[np.ndarray]:
    """Two layers by Adam on the log loss."""
    rng = np.random.default_rng(seed)
    w = [
        rng.standard_normal((x.shape[1], HIDDEN)) * np.sqrt(2 / x.shape[1]), np.zeros(HIDDEN),
        rng.standard_normal(HIDDEN) * np.sqrt(1 / HIDDEN), np.zeros(()),
    ]
    m, v, t = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 256):
            i = order[at : at + 256]
            h = np.maximum(0.0, x[i] @ w[0] + w[1])
            g = (1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -60, 60))) - y[i]) / len(i)
            back = np.outer(g, w[2]) * (h > 0)
            grads = [x[i].T @ back + 1e-5 * w[0], back.sum(0), h.T @ g + 1e-5 * w[2], g.sum()]
            t += 1
            for p, gr in enumerate(grads):
                m[p] = 0.9 * m[p] + 0.1 * gr
                v[p] = 0.999 * v[p] + 0.001 * gr**2
                w[p] = w[p] - 0.003 * (m[p] / (1 - 0.9**t)) / (np.sqrt(v[p] / (1 - 0.999**t)) + 1e-8)
    return w


def calibrated_temperature(z: np.ndarray, y: np.ndarray) -> float:
    """Temperature of the least log loss, by a search over its logarithm."""
    grid = np.exp(np.linspace(np.log(0.25), np.log(8.0), 61))
    losses = [np.mean(np.logaddexp(0.0, np.where(y > 0, -z, z) / t)) for t in grid]
    return float(grid[int(np.argmin(losses))]) if len(z) else 1.0


def held_out(id_col: str):
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def fit_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> QualityModel:
    vectors = np.zeros((BUCKETS, DIMS), np.float32)
    for r in context_sums(docs, text_col).toLocalIterator():
        vectors[r["place"]] = r[1:]
    vectors /= np.maximum(1e-9, np.linalg.norm(vectors, axis=1, keepdims=True))

    usable = labels.select(F.col(id_col).alias("__id"), F.col("quality").alias("__y")).filter(
        F.col("__y").isin(0, 1) & F.col("__id").isNotNull() & ~held_out("__id")
    )
    share = SAMPLE_ROWS / max(1, usable.count())
    sample = usable.filter(hash_fraction(F.col("__id"), share, "quality"))
    # At most about SAMPLE_ROWS pairs of id and label.
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(
        F.broadcast(sample), "__id"
    )

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pooled(batch.column(1), vectors)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([packed(f) for f in made], pa.binary())],
                names=["id", "y", "x"],
            )

    taken = rows.select(F.col("__id").cast("long"), "__text", F.col("__y").cast("int"))
    taken = map_texts(taken, features, "id long, y int, x binary")
    taken = sorted((r.id, r.y, bytes(r.x)) for r in taken.collect())
    x = np.array([np.frombuffer(r[2], np.float32) for r in taken], np.float64).reshape(-1, FEATURES)
    y = np.array([r[1] for r in taken], np.float64)
    if len(set(y)) < 2:
        level = {0.0: -60.0, 1.0: 60.0}[y[0]] if len(y) else 0.0
        layers = [np.zeros((FEATURES, 1)), np.zeros(1), np.zeros(1), np.array(level)]
        return QualityModel(vectors, np.zeros(FEATURES), np.ones(FEATURES), layers, 1.0)
    check = np.array([r[0] * 2654435761 % 97 < 19 for r in taken])
    if len(set(y[~check])) < 2 or not check.any():
        check[:] = False
    mean, scale = x[~check].mean(0), x[~check].std(0) + 1e-6
    layers = train_network((x[~check] - mean) / scale, y[~check])
    model = QualityModel(vectors, mean, scale, layers, 1.0)
    model.temperature = calibrated_temperature(model.logits(x[check]), y[check])
    return model


def score_quality(
    docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.score(batch.column(2))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score),
                 pa.array((score >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"),
        F.col(text_col).alias("text"),
    )
    return map_texts(rows, judge, "doc_id long, held_out boolean, score double, predicted int")


def accepted(
    docs: DataFrame, model: QualityModel, text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """The rows of ``docs``, all columns, whose text the model predicts to be good."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.score(batch.column(at))
            yield batch.filter(pa.array(score >= threshold))

    return map_texts(docs, sift, docs.schema)
