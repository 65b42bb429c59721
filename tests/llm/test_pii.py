import hashlib
import itertools
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from critiq.llm import pii
from critiq.llm.pii import Field, Finder, base_spans, find_pii, fit_pii, mask_pii, masked

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    found = [(0, *m.span()) for m in EMAIL.finditer(text)]
    found += [(1, *m.span()) for m in IP.finditer(text)
              if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = [int(c) for c in m[0] if c not in " -"][::-1]
        total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits))
        if 13 <= len(digits) <= 19 and total % 10 == 0:
            found.append((2, *m.span()))
    found += [(3, *m.span()) for m in PHONE.finditer(text)
              if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


CARD_NO = "4111 1111 1111 1111"


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(
    ["a", "B7", "@", ".", "..", "-", " ", "+", "+1", "(", ")", "255", "256", "0001", "1", "é",
     "1.2.3.4", "x@y.z", "%", "\n", CARD_NO, "9" * 14, "٣"]), max_size=14).map("".join))
def test_base_equals_the_patterns(text):
    assert base_spans(text) == plain_spans(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000 + "@", "@" * 100_000, "1" * 300_000 + "." * 3, "1." * 100_000,
                 "+1" + " " * 300_000 + "x", "a@" * 100_000, "9" * 300_000):
        base_spans(text)


def small_field(seed):
    rng = np.random.default_rng(seed)
    shape = (pii.SHAPES + 1, pii.LABELS)
    field = Field(*(rng.normal(0, 0.3, shape) for _ in range(3)), np.zeros(pii.LABELS),
                  rng.normal(0, 0.5, (pii.LABELS, pii.LABELS)))
    field.own[:, 0] += rng.choice([0.0, 6.0], pii.SHAPES + 1)
    return field


def test_viterbi_equals_trying_all_paths():
    rng = np.random.default_rng(0)
    scores = rng.normal(size=(3, 4, pii.LABELS))
    steps = rng.normal(size=(pii.LABELS, pii.LABELS))
    lengths = np.array([4, 1, 3])
    got = pii.viterbi(scores, lengths, steps)
    for s, n, labels in zip(scores, lengths, got):
        def value(p):
            return sum(s[i, x] for i, x in enumerate(p)) + sum(
                steps[a, b] for a, b in zip(p, p[1:]))
        best = max(itertools.product(range(pii.LABELS), repeat=int(n)), key=value)
        assert tuple(labels[:n]) == best


def test_splitting_at_settled_words_changes_nothing():
    for seed in range(6):
        field = small_field(seed)
        text = " ".join(f"{'ab1.@-+'[i % 7] * (i % 5 + 1)}{i % 11}x" for i in range(80))
        finder = Finder(field)
        shapes, starts, _ = pii.word_shapes(np.frombuffer(text.encode(), np.uint8))
        before, after = pii._beside(shapes)
        scores = field.scores(shapes, before, after)[None]
        whole = pii.viterbi(scores, np.array([len(shapes)]), field.steps)[0]
        got = np.zeros(len(shapes), int)
        for run_scores, run_starts, _ in finder.open_runs(text):
            part = pii.viterbi(run_scores[None], np.array([len(run_scores)]), field.steps)[0]
            got[np.searchsorted(starts, run_starts)] = part
        assert (got == whole).all()


def test_training_raises_the_likelihood_of_its_labels():
    rows = []
    for i in range(40):
        shapes = np.array([5, 7, 5, 9, 5]) if i % 2 else np.array([5, 5, 5, 5, 5])
        labels = np.array([0, 1, 0, 7, 0]) if i % 2 else np.zeros(5, int)
        rows.append((shapes, *pii._beside(shapes), labels))
    field = pii.train_field(rows)
    scores = np.array([field.scores(*r[:3]) for r in rows])
    got = pii.viterbi(scores, np.full(40, 5), field.steps)
    assert (got == np.array([r[3] for r in rows])).all()


DOCS = "doc_id long, text string, n_chars long, spans string, kind int"


def documents(spark):
    rows = []
    for i in range(150):
        word = f"some plain words number {i} and more of them here"
        own = [f"mail me at user{i}@host{i % 7}.example.com now", f"server 10.{i}.3.77 is up",
               f"card {CARD_NO} was used", f"call +1 ({200 + i}) 555-{1000 + i} today", word][i % 5]
        rows.append((i, f"{word}\n{own} {word}", 50, "s", 1))
    rows += [(900, None, None, None, None), (901, "", 0, "", 0), (902, "plain text only", 15, "", 0),
             (903, "call +1 (826) 555-4081 190.137.223.20 please", 44, "", 0),
             (904, "x " * 200_000 + "a@b.cd", 7, "", 0), (905, "Licensed under 4.0, version 3.", 1, "", 0)]
    rows += [rows[0], (None, "é a@b.cd", 8, "", 0)]
    return spark.createDataFrame(rows, DOCS), rows


def test_table_of_documents(spark):
    docs, rows = documents(spark)
    field = fit_pii(docs)
    found = find_pii(docs, field)
    assert found.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    texts = {r[0]: r[1] or "" for r in rows}
    got = found.collect()
    assert len(got) == len(rows)
    for r in got:
        base = plain_spans(texts[r.doc_id])
        said = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in base)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [
            sum(b[0] == k for b in base) for k in range(4)]
        assert {*said.split(",")} <= {*r.spans.split(",")}
        if r.doc_id != 903:
            assert r.spans == said
    # The phone number that a longer failing match of the base has swallowed.
    row = next(r for r in got if r.doc_id == 903)
    assert row.n_phone == 0 and "phone:5:22" in row.spans and "ip:23:37" in row.spans


def test_masking_keeps_columns_and_clean_texts(spark):
    docs, rows = documents(spark)
    out = mask_pii(docs, fit_pii(docs))
    assert out.schema == docs.schema
    got = {r.doc_id: r for r in out.collect()}
    assert got[900].text is None and got[900].n_chars is None
    assert got[902].text == "plain text only" and got[902].n_chars == 15
    assert got[905].text == rows[155][1]
    assert got[903].text == "call <phone> <ip> please" and got[903].n_chars == 24
    assert "<email>" in got[0].text and "@" not in got[0].text and got[0].n_chars == len(got[0].text)
    assert got[904].text.endswith("x <email>")
    again = mask_pii(out, fit_pii(docs))
    assert {r.text for r in again.collect()} == {r.text for r in got.values()}


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "no data here", 1, "", 0)], DOCS)
    assert find_pii(docs, fit_pii(docs)).collect()[0].spans == ""
    none = docs.limit(0)
    assert find_pii(none, fit_pii(none)).count() == 0


def test_masks_of_overlapping_spans():
    assert masked("ab12cd", [(0, 0, 4), (2, 2, 4)]) == "<email>cd"
    assert masked("ab", []) == "ab"


def test_negatives_come_from_all_of_a_text_of_any_length():
    import pyarrow as pa

    from critiq.llm.pii import NEGATIVES, WINDOW, _training_windows

    for n in (300, 9000):
        text = " ".join(f"n{i}x" if i % 3 else "word" for i in range(n))
        (batch,) = _training_windows([pa.record_batch({"text": pa.array([text])})])
        kinds = batch.column(0).to_pylist()
        assert kinds.count(1) == NEGATIVES and kinds.count(0) == 1
    # Not the first ones: windows at the very beginning would be shorter on the left.
    lengths = {len(w) for w in batch.column(2).to_pylist()}
    assert lengths == {4 * 8 * (2 * WINDOW + 1)}
