"""Masked pseudo-likelihood of documents under a bidirectional window network.

Every token is predicted from two tokens on either side by a network in numpy: an embedding
per word and side, a hidden layer, and a softmax in two levels. P(token | window) is the
network's probability of the token's class, times the token's share of all tokens of its
class. A document's score is the sum of the logarithms over its tokens.

Words are counted over all documents, in a Spark table keyed by their full 64-bit hash that
grows with the vocabulary. The ``VOCABULARY`` most frequent words travel with the tasks: they
have embeddings of their own; the first of them are classes of their own, the others are
classed by the windows they stand in (k-means). All other words take embedding and class from
their last two bytes, and their counts are joined when documents are scored, so that no count
is approximate and nothing that grows is broadcast. A class of such words keeps half a count
for words that were never seen. So the probabilities of all words and of the unseen ones of
each class sum to 1 in every window.

All windows of all documents make the model. The classes come from exact sums over them. The
network begins with about ``SAMPLE`` windows, taken by hash from all positions; then every task
trains its own copy on all windows of its documents, and the copies are averaged, embeddings by
how often a task met their word. As many tasks train as the cluster has cores, so that what they
exchange doesn't grow with the documents; they send rows that they met only, sums in the
shortest types that hold them. Other files of the same documents give other steps.

Texts lie in one stream with two ends between them, so that a word's window is what lies beside
it. Training takes runs of neighbouring words in random order, ``_WIDE`` windows a step: the
embeddings of a run are read once, and the gradients of the windows that share a word are added
by shifts before rows are summed.

Defined results: null texts and texts without words have no words and score 0. Repeated rows
count as often as they occur and are each scored. Without any document all classes are alike.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from critiq.llm.common import (
    LOWER, chunks, map_texts, mixed, packed, run_hashes, text_buffers, word_spans, written,
)

VOCABULARY = 1 << 17
#: Classes: single frequent words, groups of frequent words, groups of other words.
SINGLE, GROUPS, RARE = 40, 56, 32
CLASSES = SINGLE + GROUPS + RARE
HIDDEN = 32
SAMPLE = 400_000
UNSEEN = 0.5
_EPOCHS = 3
_BATCH = 1024
#: Windows of a step on all documents.
_WIDE = 4096
#: Neighbouring words that are trained on together.
_RUN = 64
_RATE = 0.05
#: Windows whose class scores stay in a core's cache.
_BLOCK = 1 << 10
#: Words of a long text whose signs are held at once.
_STRETCH = 1 << 17
#: Embedding rows that tasks exchange at once.
_ROWS = 1 << 12
#: Window positions: two words before, two after.
_STEPS = (-1, -2, 1, 2)
_REACH = 2
#: Where a sample's columns (the word, then its window) lie in a run.
_IN_ORDER = (2, 1, 0, 3, 4)
#: Rows that occur at most so often are summed turn by turn.
_TURNS = 16
#: Frequent words are found by the first bits of their hash.
_SHIFT = np.uint64(64 - 18)
#: Exponents within float32, even for sums.
_TAME = 80.0
_SHORT = (np.int8, np.int16, np.int32, np.int64)


@dataclass
class Words:
    """Words of a chunk of documents: hashes, groups by ending, and documents' first words."""

    hashes: np.ndarray
    endings: np.ndarray
    bounds: np.ndarray

    def window(self, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words around each word (words x 4), and whether they are there."""
        of = np.arange(len(self.hashes)) if of is None else of
        document = np.searchsorted(self.bounds, of, "right") - 1
        at = of[:, None] + np.array(_STEPS)[None, :]
        low, high = self.bounds[:-1][document], self.bounds[1:][document]
        inside = (at >= low[:, None]) & (at < high[:, None])
        return np.where(inside, at, 0), inside

    def laid_out(self, values: np.ndarray, end) -> tuple[np.ndarray, np.ndarray]:
        """Where words lie in a stream with two ends around every text, and the stream."""
        size = np.diff(self.bounds)
        spots = np.arange(len(values)) + _REACH * np.repeat(np.cumsum(size > 0), size)
        stream = np.full(len(values) + _REACH * (np.count_nonzero(size) + 1), end, values.dtype)
        stream[spots] = values
        return spots, stream


def _words(texts: pa.Array) -> Iterator[tuple[int, Words]]:
    """(first document, words) of chunks of a text column."""
    data, offsets = text_buffers(texts)
    for a, b in chunks(data, offsets):
        part = offsets[a : b + 1]
        text = LOWER[data[part[0] : part[-1]]]
        starts, ends, bounds = word_spans(text, part - part[0])
        if len(starts) == 0:
            yield a, Words(np.zeros(0, np.uint64), np.zeros(0, np.int64), bounds)
            continue
        tail = text[ends - 1].astype(np.uint64)
        several = ends - starts > 1
        tail[several] += text[ends[several] - 2].astype(np.uint64) << np.uint64(8)
        endings = (mixed(tail + np.uint64(1)) % np.uint64(RARE)).astype(np.int64)
        yield a, Words(run_hashes(text, starts, ends), endings, bounds)


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``word, ending, n`` of every word of all documents; ``word`` is its hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, words in _words(batch.column(0)):
                found, first, n = np.unique(words.hashes, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.astype(np.int64)),
                     pa.array(words.endings[first], pa.int32()), pa.array(n)],
                    names=["word", "ending", "n"],
                )

    rows = map_texts(docs.select(text_col), count, "word long, ending int, n long")
    # Equal hashes of unequal endings, if any, are one word.
    return written(
        rows.groupBy("word").agg(F.min("ending").alias("ending"), F.sum("n").alias("n"))
    )


def _sampled(docs: DataFrame, text_col: str, model: WindowModel, share: float) -> np.ndarray:
    """Embedding rows (windows x 5: the word, then its window)."""
    cut = np.uint64(min(share, 1.0) * (2**64 - 1025))
    shared = docs.sparkSession.sparkContext.broadcast(model.without_layers())

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for _, words in _words(batch.column(0)):
                if not len(words.hashes):
                    continue
                spots, stream = words.laid_out(words.hashes, np.uint64(0))
                key = words.hashes.copy()
                for step in _STEPS:
                    key += stream[spots + step]
                    key = mixed(key)
                size = np.diff(words.bounds)
                key += (np.arange(len(key)) - np.repeat(words.bounds[:-1], size)).astype(np.uint64)
                chosen = np.flatnonzero(mixed(key) <= cut)
                at, inside = words.window(chosen)
                own = model.places(words.hashes[chosen], words.endings[chosen])
                around = model.places(words.hashes[at].ravel(), words.endings[at].ravel())
                around = np.where(inside, around.reshape(at.shape), model.end)
                rows = [own, *around.T]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r.astype(np.int32)) for r in rows],
                    names=[f"r{j}" for j in range(5)],
                )

    schema = ", ".join(f"r{j} int" for j in range(5))
    found = map_texts(docs.select(text_col), take, schema).limit(2 * SAMPLE).toArrow()
    shared.destroy()
    rows = np.column_stack([found[f"r{j}"].to_numpy() for j in range(5)]).astype(np.int64)
    # A fixed order, whatever order the tasks came in.
    return rows[np.lexsort(rows.T)]


@dataclass
class WindowModel:
    """Frequent words, their classes and log shares, and the network's layers.

    Embedding rows: the frequent words in the order of their hashes, then one per ending,
    then that of a text's end. Their first half holds for words before, the second after.
    """

    words: np.ndarray
    classes: np.ndarray
    shares: np.ndarray
    rare_totals: np.ndarray
    sides: np.ndarray
    far: np.ndarray
    bias: np.ndarray
    output: np.ndarray
    offset: np.ndarray

    def __post_init__(self):
        starts = np.arange(1 << (64 - int(_SHIFT)), dtype=np.uint64) << _SHIFT
        self._first = np.searchsorted(self.words, starts).astype(np.int32)
        self._ended = np.append(self.words, np.uint64(2**64 - 1))

    @property
    def end(self) -> int:
        """Embedding row of a text's end."""
        return len(self.words) + RARE

    def without_layers(self) -> WindowModel:
        """What places of words need."""
        return replace(self, **{n: None for n in ("sides", *_DENSE)})

    def places(self, hashes: np.ndarray, endings: np.ndarray) -> np.ndarray:
        """Embedding rows of words."""
        n = len(self.words)
        at = self._first.take((hashes >> _SHIFT).astype(np.int64)).astype(np.int64)
        later = np.flatnonzero(self._ended.take(at) < hashes)
        while len(later):
            at[later] += 1
            later = later[self._ended.take(at[later]) < hashes[later]]
        return np.where((self._ended.take(at) == hashes) & (at < n), at, n + endings)

    def stream(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Embedding rows of words; where words lie in the stream of all rows, and the stream."""
        own = self.places(words.hashes, words.endings)
        return own, *words.laid_out(own, self.end)

    def hidden(self, near: np.ndarray) -> np.ndarray:
        """Hidden layer of all words of runs but two at either end.

        ``near`` are their embeddings (runs x words x 2 HIDDEN).
        """
        left, right = near[..., :HIDDEN], near[..., HIDDEN:]
        total = left[:, :-4] + right[:, 4:]
        total *= self.far
        total += left[:, 1:-3]
        total += right[:, 3:-1]
        total += self.bias
        return np.tanh(total, out=total)

    def class_scores(self, hidden: np.ndarray) -> np.ndarray:
        """Scores of the classes, less each row's largest where exponents might not hold them."""
        z = hidden @ self.output
        z += self.offset
        reach = np.abs(self.output).sum(axis=0)
        if (self.offset + reach).max() > _TAME or (self.offset - reach).max() < -_TAME:
            z -= z.max(axis=1, keepdims=True)
        return z

    def class_logs(self, window: np.ndarray) -> np.ndarray:
        """Log-probabilities of the classes for rows of window places (words x 4)."""
        runs = np.insert(window, 0, self.end, axis=1)[:, _IN_ORDER]
        z = self.class_scores(self.hidden(self.sides[runs])[:, 0])
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def targets(self, own: np.ndarray) -> np.ndarray:
        """Classes of embedding rows."""
        return np.append(self.classes, SINGLE + GROUPS + np.arange(RARE)).take(own)

    def token_logs(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Per word its log-probability, without the log count of a rare one; and which are."""
        own, spots, stream = self.stream(words)
        rare = own >= len(self.words)
        goal = np.zeros(len(stream), np.int64)
        goal[spots] = self.targets(own)
        logs = np.empty(len(stream))
        ones = np.ones(CLASSES, np.float32)
        for a in range(0, len(stream) - 2 * _REACH, _BLOCK):
            part = stream[a : a + _BLOCK + 2 * _REACH]
            z = self.class_scores(self.hidden(self.sides.take(part, axis=0)[None])[0])
            inner = slice(a + _REACH, a + _REACH + len(z))
            chosen = z[np.arange(len(z)), goal[inner]]
            logs[inner] = chosen - np.log(np.exp(z, out=z) @ ones)
        logs = logs[spots]
        logs[~rare] += self.shares[own[~rare]]
        logs[rare] -= np.log(self.rare_totals[words.endings[rare]])
        return logs, rare


def _grouped(features: np.ndarray, groups: int, rounds: int = 10) -> np.ndarray:
    """k-means on directions; rows without a direction are dealt out by turns."""
    size = np.linalg.norm(features, axis=1, keepdims=True)
    unit = np.divide(features, size, out=np.zeros_like(features), where=size > 0)
    place = np.arange(len(unit)) % groups
    for _ in range(rounds):
        sums = np.zeros((groups, unit.shape[1]), unit.dtype)
        np.add.at(sums, place, unit)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        middles = np.divide(sums, norm, out=sums, where=norm > 0)
        place = np.where(size[:, 0] > 0, (unit @ middles.T).argmax(axis=1), place)
    return place


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of an ascending array, and where each begins."""
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    return ordered[starts], starts


def _summed(places: np.ndarray, parts: np.ndarray, kind=None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places, most frequent first, and the sums of their rows."""
    order = np.argsort(places, kind="stable")
    rows, starts = _runs(places[order])
    often = np.diff(starts, append=len(order))
    by = np.argsort(-often, kind="stable")
    starts, often = starts[by], often[by]
    sums = parts.take(order[starts], axis=0).astype(kind or parts.dtype, copy=False)
    many = int(np.searchsorted(-often, -_TURNS))
    for i in range(many):
        same = order[starts[i] : starts[i] + often[i]]
        sums[i] = parts.take(same, axis=0).sum(axis=0, dtype=sums.dtype)
    for turn in range(1, _TURNS):
        last = int(np.searchsorted(-often, -turn))
        if last > many:
            sums[many:last] += parts.take(order[starts[many:last] + turn], axis=0)
    return rows[by], sums


def _shortened(sums: np.ndarray) -> tuple[bytes, bytes]:
    """The shortest type that holds each row of whole numbers (0: all are 0), and the rows."""
    least = np.minimum(sums.min(axis=1), -sums.max(axis=1))
    kinds = np.searchsorted([0, 2**7 - 1, 2**15 - 1, 2**31 - 1], -least).astype(np.uint8)
    rows = [packed(sums[kinds == k].astype(t)) for k, t in enumerate(_SHORT, 1)]
    return packed(kinds), b"".join(rows)


def _lengthened(kinds: bytes, rows: bytes) -> np.ndarray:
    """The rows of ``_shortened``."""
    kinds, first = np.frombuffer(kinds, np.uint8), 0
    sums = np.zeros((len(kinds), 2 * HIDDEN), np.int64)
    for k, kind in enumerate(_SHORT, 1):
        here = kinds == k
        n = np.count_nonzero(here) * 2 * HIDDEN
        sums[here] = np.frombuffer(rows, kind, n, first).reshape(-1, 2 * HIDDEN)
        first += n * np.dtype(kind).itemsize
    return sums


def _shared_out(docs: DataFrame, text_col: str) -> DataFrame:
    """The texts in no more parts than there are cores, as each part sends a whole model."""
    return docs.select(text_col).coalesce(docs.sparkSession.sparkContext.defaultParallelism)


def _contexts(
    docs: DataFrame, text_col: str, model: WindowModel, signs: np.ndarray
) -> np.ndarray:
    """Sums of the signs of the words left and right of every frequent word, over all documents."""
    n = len(model.words)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.without_layers(), np.hstack(list(signs))))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, signs = shared.value
        sums = np.zeros((n, 2 * HIDDEN), np.int64)
        for batch in batches:
            for _, words in _words(batch.column(0)):
                if not len(words.hashes):
                    continue
                stream = model.stream(words)[2]
                for a in range(0, len(stream) - 2, _STRETCH):
                    part = stream[a : a + _STRETCH + 2]
                    near = signs.take(part, axis=0)
                    around = np.hstack([near[:-2, :HIDDEN], near[2:, HIDDEN:]])
                    own = part[1:-1]
                    frequent = np.flatnonzero(own < n)
                    if len(frequent):
                        around = around.take(frequent, axis=0)
                        rows, added = _summed(own[frequent], around, np.int32)
                        sums[rows] += added
        for a in range(0, n, _ROWS):
            if sums[a : a + _ROWS].any():
                kinds, rows = _shortened(sums[a : a + _ROWS])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a], pa.int32()), pa.array([kinds]), pa.array([rows])],
                    names=["first", "kinds", "rows"],
                )

    def add(table: pa.Table) -> pa.Table:
        total = sum(_lengthened(r["kinds"], r["rows"]) for r in table.to_pylist())
        return pa.table({"first": table["first"][:1],
                         "sums": pa.array([packed(total.astype(np.float32))])})

    schema = "first int, sums binary"
    parts = map_texts(_shared_out(docs, text_col), gather, "first int, kinds binary, rows binary")
    features = np.zeros((n, 2 * HIDDEN), np.float32)
    for row in parts.groupBy("first").applyInArrow(add, schema).toArrow().to_pylist():
        found = np.frombuffer(row["sums"], np.float32).reshape(-1, 2 * HIDDEN)
        features[row["first"] : row["first"] + len(found)] = found
    shared.destroy()
    return features


def _classes(docs: DataFrame, text_col: str, model: WindowModel, counts: np.ndarray) -> np.ndarray:
    """Class of every frequent word: by itself, or by the windows it stands in."""
    words = model.words
    order = np.lexsort((words, -counts))
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    rng = np.random.default_rng(17)
    rows = len(words) + RARE + 1
    signs = rng.choice(np.array([-5, 5], np.int8), (2, rows, HIDDEN))
    # What lies beyond the thousand most frequent words says little by itself.
    signs[:, : len(words)][:, rank >= 1000] //= 5
    classes = SINGLE + _grouped(_contexts(docs, text_col, model, signs), GROUPS)
    classes[order[:SINGLE]] = np.arange(min(SINGLE, len(words)))
    return classes


_DENSE = ("far", "bias", "output", "offset")


class Training:
    """Fits the layers of a model in place: Adagrad on the mean log loss."""

    def __init__(self, model: WindowModel, past: dict[str, np.ndarray] | None = None):
        self.model = model
        self.layers = {n: getattr(model, n) for n in ("sides", *_DENSE)}
        self.past = past or {n: np.full_like(v, 1e-6) for n, v in self.layers.items()}

    def _step(self, name: str, gradient: np.ndarray) -> None:
        past = self.past[name]
        past += gradient**2
        self.layers[name] -= _RATE * gradient / np.sqrt(past)

    def _step_rows(self, rows: np.ndarray, gradient: np.ndarray) -> None:
        past = self.past["sides"].take(rows, axis=0)
        past += gradient**2
        self.past["sides"][rows] = past
        np.divide(gradient, np.sqrt(past, out=past), out=past)
        past *= _RATE
        self.layers["sides"][rows] -= past

    def _softmax(self, hidden: np.ndarray, goal: np.ndarray) -> np.ndarray:
        """Step of the output layer; the loss by what the hidden layer's tanh is taken of."""
        model = self.model
        n = np.float32(np.count_nonzero(goal >= 0))
        back = np.empty_like(hidden)
        output, offset = np.zeros_like(model.output), np.zeros_like(model.offset)
        ones = np.ones(CLASSES, np.float32)
        for a in range(0, len(goal), _BLOCK):
            h, g = hidden[a : a + _BLOCK], goal[a : a + _BLOCK]
            p = model.class_scores(h)
            np.exp(p, out=p)
            total = p @ ones
            p[np.arange(len(g)), g] -= total
            share = np.where(g >= 0, 1 / (n * total), np.float32(0))
            output += (h * share[:, None]).T @ p
            offset += share @ p
            part = np.matmul(p, model.output.T, out=back[a : a + _BLOCK])
            part *= share[:, None]
            part *= 1 - h**2
        self._step("output", output)
        self._step("offset", offset)
        return back

    def batch(self, runs: np.ndarray, goal: np.ndarray) -> None:
        """Step on runs of rows; classes of all but two at either end, -1 for a text's end."""
        model = self.model
        near = model.sides.take(runs.ravel(), axis=0).reshape(*runs.shape, 2 * HIDDEN)
        hidden = model.hidden(near)
        back = self._softmax(hidden.reshape(-1, HIDDEN), goal.ravel()).reshape(hidden.shape)
        beyond = near[:, :-4, :HIDDEN] + near[:, 4:, HIDDEN:]
        beyond *= back
        further = back * model.far
        gradient = np.zeros_like(near)
        left, right = gradient[..., :HIDDEN], gradient[..., HIDDEN:]
        left[:, 1:-3] = back
        left[:, :-4] += further
        right[:, 3:-1] = back
        right[:, 4:] += further
        self._step("bias", back.reshape(-1, HIDDEN).sum(axis=0))
        self._step("far", beyond.reshape(-1, HIDDEN).sum(axis=0))
        self._step_rows(*_summed(runs.ravel(), gradient.reshape(-1, 2 * HIDDEN)))

    def epoch(
        self, runs: np.ndarray, goal: np.ndarray, rng: np.random.Generator, size: int = _BATCH
    ) -> None:
        """Train on all runs in random order, about ``size`` windows at once."""
        order = rng.permutation(len(goal))
        size = max(1, size // goal.shape[1])
        for a in range(0, len(order), size):
            take = order[a : a + size]
            self.batch(runs[take], goal[take])


def _in_runs(stream: np.ndarray, spots: np.ndarray, classes: np.ndarray, end: int):
    """Runs of a stream, two words longer at either end than what they train, and classes."""
    n = -(-(len(stream) - 2 * _REACH) // _RUN) * _RUN
    rows = np.full(n + 2 * _REACH, end, stream.dtype)
    rows[: len(stream)] = stream
    goal = np.full(n, -1, np.int64)
    goal[spots - _REACH] = classes
    runs = np.lib.stride_tricks.sliding_window_view(rows, _RUN + 2 * _REACH)[::_RUN]
    return runs, goal.reshape(-1, _RUN)


def _trained_on_all(
    docs: DataFrame, text_col: str, model: WindowModel, past: dict[str, np.ndarray]
) -> None:
    """Train on every window of all documents, in place.

    Tasks send by how much their copies changed, those of embeddings in half precision.
    """
    rows = len(model.sides)
    shared = docs.sparkSession.sparkContext.broadcast((model, past))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, before = shared.value
        own_copy = replace(start, **{n: getattr(start, n).copy() for n in before})
        training = Training(own_copy, {n: v.copy() for n, v in before.items()})
        part = TaskContext.get().partitionId()
        rng = np.random.default_rng((3, part))
        met = {"left": np.zeros(rows, np.int64), "right": np.zeros(rows, np.int64)}
        seen = 0
        for batch in batches:
            for _, words in _words(batch.column(0)):
                if not len(words.hashes):
                    continue
                own, spots, stream = own_copy.stream(words)
                runs, goal = _in_runs(stream, spots, own_copy.targets(own), own_copy.end)
                training.epoch(runs, goal, rng, _WIDE)
                seen += len(own)
                for side, steps in (("left", _STEPS[:2]), ("right", _STEPS[2:])):
                    for step in steps:
                        met[side] += np.bincount(stream[spots + step], minlength=rows)
        if not seen:
            return
        change = {n: v - getattr(start, n) for n, v in training.layers.items()}
        dense = np.concatenate([change[n].ravel() for n in _DENSE])
        sent = [("dense", 0, np.array([seen]), dense)]
        halves = {"left": change["sides"][:, :HIDDEN], "right": change["sides"][:, HIDDEN:]}
        for name, often in met.items():
            for a in range(0, rows, _ROWS):
                here = often[a : a + _ROWS]
                if here.any():
                    sent.append((name, a, here,
                                 halves[name][a : a + _ROWS][here > 0].astype(np.float16)))
        for name, first, often, layer in sent:
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([first], pa.int32()), pa.array([part], pa.int32()),
                 pa.array([packed(often)]), pa.array([packed(layer)])],
                names=["name", "first", "part", "often", "layer"],
            )

    def average(table: pa.Table) -> pa.Table:
        total = weights = 0
        for row in table.sort_by("part").to_pylist():
            often = np.frombuffer(row["often"], np.int64).astype(np.float64)
            kind = np.float32 if row["name"] == "dense" else np.float16
            here = np.flatnonzero(often)
            sent = np.frombuffer(row["layer"], kind).reshape(len(here), -1)
            layer = np.zeros((len(often), sent.shape[1]))
            layer[here] = sent
            total = total + often[:, None] * layer
            weights = weights + often
        mean = total / np.maximum(weights, 1.0)[:, None]
        return pa.table({"name": table["name"][:1], "first": table["first"][:1],
                         "met": pa.array([packed(weights > 0)]),
                         "layer": pa.array([packed(mean.astype(np.float32))])})

    copies = map_texts(
        _shared_out(docs, text_col), train,
        "name string, first int, part int, often binary, layer binary",
    )
    averaged = copies.groupBy("name", "first").applyInArrow(
        average, "name string, first int, met binary, layer binary"
    )
    for row in averaged.toArrow().to_pylist():
        met, layer = np.frombuffer(row["met"], bool), np.frombuffer(row["layer"], np.float32)
        if row["name"] == "dense":
            for name in _DENSE:
                held = getattr(model, name)
                held += layer[: held.size].reshape(held.shape)
                layer = layer[held.size :]
        else:
            side = slice(HIDDEN) if row["name"] == "left" else slice(HIDDEN, None)
            held = model.sides[row["first"] : row["first"] + len(met), side]
            held[met] += layer.reshape(len(met), -1)[met]
    shared.destroy()


def fit_lm(docs: DataFrame, text_col: str = "text") -> tuple[WindowModel, DataFrame]:
    """The network and the table of all words' counts."""
    counts = word_counts(docs, text_col)
    top = counts.orderBy(F.desc("n"), "word").limit(VOCABULARY).toArrow()
    words = top["word"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(words)
    words, often = words[order], top["n"].to_numpy().astype(np.float64)[order]
    endings = top["ending"].to_numpy()[order]
    by_ending = np.zeros(RARE)
    tokens = 0
    for row in counts.groupBy("ending").agg(F.sum("n").alias("n")).collect():
        by_ending[row["ending"]] = row["n"]
        tokens += row["n"]
    rare_totals = by_ending - np.bincount(endings, weights=often, minlength=RARE) + UNSEEN

    rng = np.random.default_rng(29)
    rows = len(words) + RARE + 1
    model = WindowModel(
        words, np.zeros(len(words), np.int64), np.zeros(len(words)), rare_totals,
        sides=np.hstack([0.1 * rng.standard_normal((rows, HIDDEN)) for _ in range(2)])
        .astype(np.float32),
        far=np.full(HIDDEN, 0.5, np.float32), bias=np.zeros(HIDDEN, np.float32),
        output=np.zeros((HIDDEN, CLASSES), np.float32), offset=np.zeros(CLASSES, np.float32),
    )
    model.classes = _classes(docs, text_col, model, often)
    totals = np.bincount(model.classes, weights=often, minlength=CLASSES)
    model.shares = np.log(often / totals[model.classes])
    totals[SINGLE + GROUPS :] = rare_totals
    with np.errstate(divide="ignore"):
        start = np.log(totals / max(totals.sum(), 1.0))
    # Classes without words are never predicted.
    model.offset[:] = np.where(totals > 0, start, -1e9)
    sample = _sampled(docs, text_col, model, SAMPLE / max(tokens, 1))
    runs, goal = sample[:, _IN_ORDER], model.targets(sample[:, :1])
    training, rng = Training(model), np.random.default_rng(3)
    for _ in range(_EPOCHS):
        training.epoch(runs, goal, rng)
    _trained_on_all(docs, text_col, model, training.past)
    return model, counts


def score_lm(
    docs: DataFrame, fitted: tuple[WindowModel, DataFrame], id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_tokens, log_likelihood and its mean per word (null without words)."""
    model, counts = fitted
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.zeros(batch.num_rows)
            n = np.zeros(batch.num_rows, np.int64)
            owners, rare_words = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for first, words in _words(batch.column(1)):
                size = np.diff(words.bounds)
                n[first : first + len(size)] = size
                full = np.flatnonzero(size)
                if len(full):
                    logs, rare = shared.value.token_logs(words)
                    total[first + full] = np.add.reduceat(logs, words.bounds[full])
                    owners.append(first + np.repeat(np.arange(len(size)), size)[rare])
                    rare_words.append(words.hashes[rare])
            owner, word = np.concatenate(owners), np.concatenate(rare_words)
            starts = np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array(total),
                 pa.ListArray.from_arrays(pa.array(starts), pa.array(word.astype(np.int64)))],
                names=["doc_id", "n_tokens", "known", "rare"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scored = written(
        map_texts(rows, score, "doc_id long, n_tokens long, known double, rare array<long>")
        .withColumn("place", F.monotonically_increasing_id())
    )
    seen = scored.select("place", F.explode("rare").alias("word"))
    often = F.log(F.coalesce(F.col("n").cast("double"), F.lit(UNSEEN)))
    added = seen.join(counts.select("word", "n"), "word", "left").groupBy("place").agg(
        F.sum(often).alias("added")
    )
    total = F.col("known") + F.coalesce("added", F.lit(0.0))
    return scored.drop("rare").join(added, "place", "left").select(
        "doc_id", "n_tokens", total.alias("log_likelihood"),
        F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("mean_log_likelihood"),
    )
