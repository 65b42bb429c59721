import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from critiq.llm import lm_score
from critiq.llm.common import LOWER, mixed, run_hashes
from critiq.llm.lm_score import GROUPS, RARE, SINGLE, UNSEEN, fit_lm, score_lm

DOCS = "doc_id long, text string, n_tokens int, word long, place long, rare int"


@pytest.fixture(autouse=True)
def few_frequent_words(monkeypatch):
    """Most words of these corpora are beyond the vocabulary."""
    monkeypatch.setattr(lm_score, "VOCABULARY", 60)


def table(spark, texts):
    return spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in enumerate(texts)], DOCS)


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", low) if w]


def hash_of(word):
    data = LOWER[np.frombuffer(word.encode(), np.uint8)]
    return run_hashes(data, np.array([0]), np.array([len(data)]))[0]


def ending_of(word):
    raw = word.encode()
    tail = raw[-1] + (256 * raw[-2] if len(raw) > 1 else 0)
    return int(mixed(np.array([tail + 1], np.uint64))[0] % np.uint64(RARE))


def corpus(seed=0, n=200):
    """Two kinds of text with words, and rare words, of their own."""
    rng = np.random.default_rng(seed)
    texts = []
    for i in range(n):
        said = []
        for _ in range(rng.integers(3, 30)):
            if i % 2:
                said += ["the", f"noun{rng.integers(6)}", "is", f"kind{rng.integers(900)}ing"]
            else:
                said += ["le", f"nom{rng.integers(6)}", "est", f"sorte{rng.integers(900)}eux"]
        texts.append(" ".join(said))
    return texts


class Plain:
    """Probabilities from the model's arrays and the counts, word by word."""

    def __init__(self, model, counted):
        self.model, self.count, self.rows = model, counted, {}
        self.place = {int(h): i for i, h in enumerate(model.words)}

    def row(self, word):
        if word not in self.rows:
            self.rows[word] = self._row(word)
        return self.rows[word]

    def _row(self, word):
        if word is None:
            return len(self.model.words) + RARE
        return self.place.get(int(hash_of(word)), len(self.model.words) + ending_of(word))

    def log(self, said, j):
        m = self.model
        at = [self.row(said[j + d]) if 0 <= j + d < len(said) else self.row(None)
              for d in (-1, -2, 1, 2)]
        classes = m.class_logs(np.array([at]))[0]
        own = self.row(said[j])
        if own < len(m.words):
            group = [w for w in self.count if self.row(w) < len(m.words)
                     and m.classes[self.row(w)] == m.classes[own]]
            share = self.count[said[j]] / sum(self.count[w] for w in group)
            return classes[m.classes[own]] + np.log(share)
        group = [w for w in self.count if self.row(w) == own]
        share = self.count.get(said[j], UNSEEN) / (sum(self.count[w] for w in group) + UNSEEN)
        return classes[SINGLE + GROUPS + ending_of(said[j])] + np.log(share)


def test_scores_equal_plain_sums(spark):
    texts = [*corpus(n=16), None, "", " \n", "One", "A B\x0bc Ünd é", "long tail " * 40]
    asked = [*texts, "never seen words", "the unheard is kindest"]
    fitted = fit_lm(table(spark, texts))
    found = score_lm(table(spark, asked), fitted)
    assert found.columns == ["doc_id", "n_tokens", "log_likelihood", "mean_log_likelihood"]
    got = {r.doc_id: r for r in found.collect()}
    plain = Plain(fitted[0], Counter(w for t in texts for w in words(t)))
    assert len(plain.count) > 100 and len(got) == len(asked)
    for i, t in enumerate(asked):
        said = words(t)
        total = sum(plain.log(said, j) for j in range(len(said)))
        assert got[i].n_tokens == len(said)
        assert abs(got[i].log_likelihood - total) <= 1e-4 * max(1.0, abs(total))
        if said:
            assert abs(got[i].mean_log_likelihood - got[i].log_likelihood / len(said)) < 1e-9
        else:
            assert got[i].mean_log_likelihood is None


def test_probabilities_of_all_words_sum_to_one(spark):
    texts = corpus(n=40)
    model, counts = fit_lm(table(spark, texts))
    plain = Plain(model, Counter(w for t in texts for w in words(t)))
    assert counts.count() == len(plain.count)
    for around in (["the", "noun1", None, "kind7ing", "the"], ["le", "nom2", None, "x", "y"]):
        total = 0.0
        for w in plain.count:
            said = [w if a is None else a for a in around]
            total += np.exp(plain.log(said, 2))
        said = np.array([[plain.row(around[1]), plain.row(around[0]), plain.row(around[3]),
                          plain.row(around[4])]])
        logs = model.class_logs(said)[0]
        unseen = sum(
            np.exp(logs[SINGLE + GROUPS + e]) * UNSEEN / model.rare_totals[e] for e in range(RARE)
        )
        assert abs(total + unseen - 1) < 1e-4


def test_rare_words_score_by_their_context(spark):
    fitted = fit_lm(table(spark, corpus()))
    asked = ["the noun1 is kind77ing the noun2", "le nom1 est kind77ing le nom2",
             "le nom1 est sorte77eux le nom2", "the noun1 is sorte77eux the noun2"]
    got = {r.doc_id: r.log_likelihood for r in score_lm(table(spark, asked), fitted).collect()}
    assert got[0] > got[1] + 1 and got[2] > got[3] + 1


def test_order_of_words_matters(spark):
    texts = corpus()
    rng = np.random.default_rng(4)
    fitted = fit_lm(table(spark, texts))
    mixed_up = [" ".join(rng.permutation(t.split()).tolist()) for t in texts]
    right = {r.doc_id: r.log_likelihood for r in score_lm(table(spark, texts), fitted).collect()}
    wrong = {r.doc_id: r.log_likelihood for r in score_lm(table(spark, mixed_up), fitted).collect()}
    assert np.mean([right[i] > wrong[i] for i in right]) > 0.95


def test_words_of_a_vocabulary_are_counted_apart(spark):
    """Nothing is hashed to a fixed number of places."""
    texts = [" ".join(f"w{i}x{j}" for j in range(500)) for i in range(40)]
    counts = lm_score.word_counts(table(spark, [*texts, texts[0]]))
    assert counts.count() == 20_000
    assert counts.filter("n = 2").count() == 500


def test_windows_stay_inside_their_text():
    (first, found), = lm_score._words(pa.array(["a b", "", "c", "d e f"]))
    at, inside = found.window()
    assert first == 0 and found.bounds.tolist() == [0, 2, 2, 3, 6]
    assert inside.sum(axis=1).tolist() == [1, 1, 0, 2, 2, 2]
    assert at[3, 2:].tolist() == [4, 5] and at[5, :2].tolist() == [4, 3]


def test_empty_corpus_and_repeats(spark):
    none = spark.createDataFrame([], DOCS)
    fitted = fit_lm(none)
    assert score_lm(none, fitted).count() == 0
    some = score_lm(table(spark, ["never seen", "never seen"]), fitted).collect()
    assert len({r.log_likelihood for r in some}) == 1 and np.isfinite(some[0].log_likelihood)
    rows = [(None, "a b"), (1, "a b"), (1, "a b")]
    docs = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in rows], DOCS)
    assert score_lm(docs, fit_lm(docs)).count() == 3



def test_all_documents_train_the_network(spark, monkeypatch):
    """The beginning meets next to none of the windows; all of them teach what follows what."""
    monkeypatch.setattr(lm_score, "SAMPLE", 20)
    texts = corpus(n=1200)
    docs = table(spark, texts).repartition(3)
    asked = ["the noun1 is kind77ing the noun2", "le noun1 est kind77ing le noun2"]
    model = fit_lm(docs)
    got = {r.doc_id: r.log_likelihood for r in score_lm(table(spark, asked), model).collect()}
    assert got[0] > got[1] + 4
    calls = []
    monkeypatch.setattr(lm_score, "_trained_on_all", lambda *a: calls.append(a))
    alone = fit_lm(docs)
    assert calls and not np.array_equal(alone[0].output, model[0].output)
    assert (alone[0].classes == model[0].classes).all()


def test_classes_come_from_all_windows(spark):
    """Sums of signs over every window, however the documents lie."""
    texts = corpus(n=60)
    model, _ = fit_lm(table(spark, texts))
    n = len(model.words)
    signs = np.random.default_rng(1).integers(-5, 6, (2, n + RARE + 1, lm_score.HIDDEN))
    got = lm_score._contexts(table(spark, texts).repartition(5), "text", model,
                             signs.astype(np.int8))
    plain = Plain(model, {})
    want = np.zeros_like(got)
    for t in texts:
        said = [None, *words(t), None]
        for i in range(1, len(said) - 1):
            if plain.row(said[i]) < n:
                want[plain.row(said[i])] += np.r_[
                    signs[0, plain.row(said[i - 1])], signs[1, plain.row(said[i + 1])]
                ]
    assert np.array_equal(got, want)


def sent_parts(spark, monkeypatch, texts, parts=3):
    """Tables that tasks send, by their columns, while a model is fitted."""
    found, real = {}, lm_score.map_texts

    def caught(docs, function, schema):
        rows = real(docs, function, schema)
        found[schema] = rows.collect() if "binary" in schema else None
        return rows

    monkeypatch.setattr(lm_score, "map_texts", caught)
    model, _ = fit_lm(table(spark, texts).repartition(parts, "doc_id"))
    return model, [r for _, r in sorted(found.items()) if r]


def test_tasks_send_what_they_met(spark, monkeypatch):
    """No row of a word that a task never met, and sums as short as they are."""
    monkeypatch.setattr(lm_score, "VOCABULARY", 4000)
    texts = [" ".join(f"w{i}x{j}" for j in range(100)) for i in range(30)]
    model, (sums, copies) = sent_parts(spark, monkeypatch, texts)
    assert len(model.words) == 3000 and len({r.part for r in copies}) > 1
    for side in ("left", "right"):
        got = sum(len(r.layer) for r in copies if r.name == side)
        # A word lies in one text; ends come with every task.
        assert got <= (3000 + len({r.part for r in copies})) * lm_score.HIDDEN * 2
    assert sum(len(r.rows) for r in sums) == 3000 * 2 * lm_score.HIDDEN


def test_short_sums_are_exact():
    rng = np.random.default_rng(5)
    sums = np.zeros((300, 2 * lm_score.HIDDEN), np.int64)
    for i, top in enumerate((1, 127, 128, 2**15 - 1, 2**15, 2**31 - 1, 2**31, 2**40), 1):
        sums[i, rng.integers(64)], sums[100 + i, rng.integers(64)] = top, -top
        sums[200 + i] = rng.integers(-top, top + 1, 64)
    assert np.array_equal(lm_score._lengthened(*lm_score._shortened(sums)), sums)


def test_sums_of_rows():
    rng = np.random.default_rng(6)
    places = np.minimum(rng.geometric(0.02, 5000), 200)
    parts = rng.integers(-5, 6, (5000, 4)).astype(np.int8)
    want = np.zeros((201, 4), np.int64)
    np.add.at(want, places, parts)
    rows, sums = lm_score._summed(places, parts, np.int32)
    got = np.zeros_like(want)
    got[rows] = sums
    assert len(set(rows)) == len(rows) == len(set(places)) and np.array_equal(got, want)


def test_classes_of_texts_beyond_a_stretch(spark, monkeypatch):
    texts = corpus(n=40)
    model, _ = fit_lm(table(spark, texts))
    signs = np.random.default_rng(2).integers(
        -5, 6, (2, len(model.words) + RARE + 1, lm_score.HIDDEN)
    ).astype(np.int8)
    want = lm_score._contexts(table(spark, texts), "text", model, signs)
    monkeypatch.setattr(lm_score, "_STRETCH", 7)
    assert np.array_equal(lm_score._contexts(table(spark, texts), "text", model, signs), want)


def small_model(hashes, rng):
    rows = len(hashes) + RARE + 1
    draw = lambda *shape: (0.5 * rng.standard_normal(shape)).astype(np.float32)
    return lm_score.WindowModel(
        hashes, rng.integers(0, SINGLE, len(hashes)), np.zeros(len(hashes)), np.ones(RARE),
        draw(rows, 2 * lm_score.HIDDEN), draw(lm_score.HIDDEN), draw(lm_score.HIDDEN),
        draw(lm_score.HIDDEN, lm_score.CLASSES), draw(lm_score.CLASSES),
    )


def test_places_of_words_with_equal_first_bits():
    rng = np.random.default_rng(7)
    far = rng.integers(0, 2**63, 3000).astype(np.uint64) * np.uint64(2)
    near = np.arange(500, dtype=np.uint64) * np.uint64(3)
    hashes = np.unique(np.concatenate([far, near, [np.uint64(2**64 - 1)]]))
    asked = np.concatenate([hashes, hashes + np.uint64(1), [np.uint64(0)]])
    endings = rng.integers(0, RARE, len(asked))
    for words in (hashes[:-1], hashes, hashes[:0]):
        at = {int(h): i for i, h in enumerate(words)}
        want = [at.get(int(h), len(words) + e) for h, e in zip(asked, endings)]
        assert small_model(words, rng).places(asked, endings).tolist() == want


def test_a_step_on_runs_is_that_of_their_windows():
    """Squares of the loss's slopes, as Adagrad keeps them, against every window by itself."""
    rng = np.random.default_rng(8)
    model = small_model(np.arange(20, dtype=np.uint64), rng)
    found = lm_score.Words(rng.integers(0, 26, 150).astype(np.uint64),
                           rng.integers(0, RARE, 150), np.array([0, 1, 1, 3, 90, 150]))
    own, spots, stream = model.stream(found)
    goal = model.targets(own)
    at, inside = found.window()
    windows = np.where(inside, own[at], model.end)
    assert np.array_equal(windows, stream[spots[:, None] + np.array(lm_score._STEPS)])

    h, m = lm_score.HIDDEN, {n: getattr(model, n).astype(np.float64)
                             for n in ("sides", *lm_score._DENSE)}
    slope = {n: np.zeros_like(v) for n, v in m.items()}
    for (a, b, c, d), g in zip(windows, goal):
        left, right = m["sides"][:, :h], m["sides"][:, h:]
        beyond = left[b] + right[d]
        t = np.tanh(left[a] + right[c] + m["far"] * beyond + m["bias"])
        p = np.exp(t @ m["output"] + m["offset"])
        p /= p.sum()
        p[g] -= 1
        p /= len(goal)
        back = (m["output"] @ p) * (1 - t**2)
        slope["output"] += np.outer(t, p)
        slope["offset"] += p
        slope["bias"] += back
        slope["far"] += back * beyond
        for row, part, size in ((a, slice(h), 1), (b, slice(h), m["far"]),
                                (c, slice(h, None), 1), (d, slice(h, None), m["far"])):
            slope["sides"][row, part] += back * size
    training = lm_score.Training(model)
    runs, classes = lm_score._in_runs(stream, spots, goal, model.end)
    assert runs.shape[1] == classes.shape[1] + 4 and (classes >= 0).sum() == 150
    training.batch(runs, classes)
    for name, want in slope.items():
        got = np.sqrt(np.maximum(training.past[name] - 1e-6, 0))
        assert np.allclose(got, np.abs(want), rtol=1e-3, atol=2e-4), name
        moved = np.abs(want) > 1e-3
        assert (np.sign(m[name] - training.layers[name])[moved] == np.sign(want[moved])).all()


def test_scores_far_apart_stay_finite():
    rng = np.random.default_rng(9)
    model = small_model(np.arange(20, dtype=np.uint64), rng)
    hidden = np.tanh(rng.standard_normal((50, lm_score.HIDDEN))).astype(np.float32)
    mild = model.class_scores(hidden)
    for add in (500.0, -500.0):
        model.offset += np.float32(add)
        z = model.class_scores(hidden)
        p, q = np.exp(z), np.exp(mild)
        assert np.allclose(p / p.sum(1, keepdims=True), q / q.sum(1, keepdims=True), atol=1e-3)
        model.offset -= np.float32(add)
