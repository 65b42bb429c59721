"""Personal data in texts: fixed patterns, and a linear-chain conditional random field.

The base finds e-mail addresses, IP addresses, card and phone numbers by pattern and checks.
The field reads a text as words and sees only their shapes (letters and digits folded, repeats
collapsed) at a word and its two neighbours. It is trained on a small table of windows around
base spans and elsewhere, labelled by the base, without windows that hold a failing match, from
documents chosen by hash (``SAMPLE_DOCS`` documents, ``SAMPLE_WINDOWS`` windows: documented
bounds), and decoded by Viterbi in batches. Its spans are added where they overlap no base span
and have the kind's bare form: an @ between word signs, four numbers of at most 255, 13 to 19
digits that pass Luhn, or 9 to 15 digits. So it finds what a longer failing match of the base
has swallowed.

Decoding whole texts is cheap and exact: words that no best labelling can put inside a span, by
an upper bound of what any run of words around them can gain, split a text. Only the runs
between are decoded.

Defined results: null and empty texts have no spans. Positions are code points. Repeated rows
are treated one by one; other columns are ignored or passed on. Without any base span in the
sample the field adds nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from critiq.llm.common import SPACE, hash_fraction, map_texts, mixed, packed, run_hashes

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS = 20_000
SAMPLE_WINDOWS = 4_000
WINDOW = 6
#: Words with a digit or an @ outside all spans around which a text gives windows.
NEGATIVES = 4
_TELLING = np.zeros(256, np.int64)
_TELLING[[*range(48, 58), 64]] = 1
SHAPES = 1 << 14
STEPS = 100
LABELS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind

_LOCAL = "".join(c for c in map(chr, range(128)) if re.match("[A-Za-z0-9._%+-]", c))
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOOSE_DOMAIN = re.compile(r"[\w-]+(?:\.[\w-]+)*")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_RUN = re.compile("[0-9](?:[ -]?[0-9]){12}")
_WORD = re.compile("[^\x20\x09-\x0d]+")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _is_card(text: str) -> bool:
    digits = text.replace(" ", "").replace("-", "")
    return 13 <= len(digits) <= 19 and _luhn(digits)


def _is_ip(text: str) -> bool:
    return all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in text.split("."))


def _is_phone(text: str) -> bool:
    return 9 <= sum("0" <= c <= "9" for c in text) <= 15


def _emails(text: str, domain: re.Pattern) -> Iterator[tuple[int, int]]:
    """Spans of a local part, @ and domain, from left to right, in linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = done + len(text[done:at].rstrip(_LOCAL))
        m = domain.match(text, at + 1) if start < at else None
        done = m.end() if m else at + 1
        if m:
            yield start, done
        at = text.find("@", done)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Spans of four numbers with dots, from left to right, in linear time."""
    for chain in _CHAIN.finditer(text):
        if chain[0].count(".") < 3:
            continue
        at, parts = chain.start(), chain[0].split(".")
        for i in range(0, len(parts) - 3, 4):
            end = at + sum(map(len, parts[i : i + 4])) + 3
            yield at, end
            at = end + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind, then start."""
    found = []
    if "@" in text:
        found += [(0, s, e) for s, e in _emails(text, _DOMAIN)]
    if not _DIGIT.search(text):
        return found
    if "." in text:
        found += [(1, s, e) for s, e in _ips(text) if _is_ip(text[s:e])]
    if _RUN.search(text):
        found += [(2, *m.span()) for m in _CARD.finditer(text) if _is_card(m[0])]
    if "+" in text:
        found += [(3, *m.span()) for m in _PHONE.finditer(text) if _is_phone(m[0])]
    return found


def failing_spans(text: str) -> list[tuple[int, int, int]]:
    """Matches of the patterns that fail their checks: what is inside is not known."""
    found = [(1, s, e) for s, e in _ips(text) if not _is_ip(text[s:e])]
    if _RUN.search(text):
        found += [(2, *m.span()) for m in _CARD.finditer(text)
                  if not _is_card(m[0]) and _RUN.match(m[0])]
    return found + [(3, *m.span()) for m in _PHONE.finditer(text) if not _is_phone(m[0])]


# Byte classes of word shapes: a lower, A upper, 9 digit, other signs as they are.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 57
_SHAPE[128:] = 97


def word_shapes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shape number, first and last byte of every word of a text."""
    if len(data) == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = ~SPACE[data]
    edges = np.diff(solid.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    folded = _SHAPE[data]
    new = np.ones(len(data), bool)
    new[1:] = folded[1:] != folded[:-1]
    new[starts] = True
    new &= solid
    place = np.concatenate([[0], np.cumsum(new)])
    shapes = run_hashes(folded[new], place[starts], place[ends])
    # Length classes of words with digits: 1-3, 4-7, 8-12 and more.
    size = np.searchsorted([4, 8, 13], ends - starts, "right")
    digit = np.add.reduceat((folded == 57).astype(np.int32), starts) > 0
    return ((shapes + np.uint64(7919) * (size * digit).astype(np.uint64)) % np.uint64(SHAPES)
            ).astype(np.int64), starts, ends


@dataclass
class Field:
    """Weights: own, left and right shape by label, label bias, and transitions."""

    own: np.ndarray
    left: np.ndarray
    right: np.ndarray
    bias: np.ndarray
    steps: np.ndarray

    def scores(self, shapes: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        return self.own[shapes] + self.left[before] + self.right[after] + self.bias

    def open_words(self, scores: np.ndarray) -> np.ndarray:
        """Words that a best labelling may put inside a span; all others are outside.

        A run of words inside spans must not score less than the same run outside. Its gain is
        at most the sum over its words of the best gain of a label, with the best transition
        inside a run for each, and the best way in and out. A word is open if some run that
        holds it can reach a gain of zero: the best sum that ends in the word and the best that
        begins there follow from running extremes of one cumulative sum.
        """
        rest = self.steps - self.steps[0, 0]
        inner = rest[1:, 1:].max()
        gain = scores[:, 1:].max(1) - scores[:, 0] + inner
        # A run at an end of the text has no way in or out.
        spare = max(0.0, rest[0, 1:].max()) + max(0.0, rest[1:, 0].max()) - inner
        total = np.concatenate([[0.0], np.cumsum(gain)])
        ending = total[1:] - np.minimum.accumulate(total[:-1])
        beginning = np.maximum.accumulate(total[:0:-1])[::-1] - total[:-1]
        return ending + beginning - gain + spare > -1e-6 * (1.0 + np.abs(total[-1]))


NO_SHAPE = SHAPES  # beyond either end of a text


def _beside(shapes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.append(NO_SHAPE, shapes[:-1]), np.append(shapes[1:], NO_SHAPE)


def viterbi(scores: np.ndarray, lengths: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Best labels (sequences x places) of padded scores (sequences x places x labels)."""
    n, width, _ = scores.shape
    best, back = scores[:, 0], np.zeros(scores.shape, np.int8)
    for t in range(1, width):
        tried = best[:, :, None] + steps[None]
        back[:, t] = tried.argmax(1)
        after = tried.max(1) + scores[:, t]
        live = (t < lengths)[:, None]
        best = np.where(live, after, best)
    labels = np.zeros((n, width), np.int64)
    at = best.argmax(1)
    for t in range(width - 1, -1, -1):
        labels[:, t] = np.where(t < lengths, at, 0)
        if t:
            at = np.where(t < lengths, back[np.arange(n), t, at], at)
    return labels


def train_field(windows: list[tuple[np.ndarray, ...]], steps: int = STEPS) -> Field:
    """Maximum likelihood by Adagrad over (shapes, left, right, labels) windows."""
    shape = (SHAPES + 1, LABELS)
    field = Field(np.zeros(shape), np.zeros(shape), np.zeros(shape), np.zeros(LABELS),
                  np.zeros((LABELS, LABELS)))
    if not windows:
        field.bias[0] = 50.0
        return field
    width = max(len(w[0]) for w in windows)
    lengths = np.array([len(w[0]) for w in windows])
    x, a, b, y = (
        np.array([np.pad(w[i], (0, width - len(w[i])), constant_values=NO_SHAPE if i < 3 else 0)
                  for w in windows]) for i in range(4)
    )
    live = np.arange(width)[None, :] < lengths[:, None]
    n = len(windows)
    parts = (field.own, field.left, field.right, field.bias, field.steps)
    seen = [np.full_like(p, 1e-8) for p in parts]
    truth = np.zeros((n, width, LABELS))
    truth[np.arange(n)[:, None], np.arange(width)[None, :], y] = 1.0
    truth *= live[:, :, None]
    pairs = np.zeros((LABELS, LABELS))
    both = live[:, 1:]
    np.add.at(pairs, (y[:, :-1][both], y[:, 1:][both]), 1.0)
    for _ in range(steps):
        e = field.scores(x, a, b)
        forward = np.zeros_like(e)
        forward[:, 0] = e[:, 0]
        high = field.steps.max()
        jump = np.exp(field.steps - high)
        for t in range(1, width):
            top = forward[:, t - 1].max(1, keepdims=True)
            forward[:, t] = np.log(np.exp(forward[:, t - 1] - top) @ jump) + top + high + e[:, t]
        behind = np.zeros_like(e)
        for t in range(width - 2, -1, -1):
            z = behind[:, t + 1] + e[:, t + 1]
            top = z.max(1, keepdims=True)
            told = np.log(np.exp(z - top) @ jump.T) + top + high
            behind[:, t] = np.where(live[:, t + 1 : t + 2], told, 0.0)
        whole = forward[np.arange(n), lengths - 1]
        top = whole.max(1, keepdims=True)
        total = (np.log(np.exp(whole - top).sum(1, keepdims=True)) + top)[:, :, None]
        chance = np.exp(forward + behind - total) * live[:, :, None]
        expected = np.zeros_like(pairs)
        for t in range(1, width):
            some = live[:, t]
            z = (forward[some, t - 1, :, None] + field.steps[None]
                 + (e[some, t] + behind[some, t])[:, None, :] - total[some])
            expected += np.exp(z).sum(0)
        gap = (truth - chance)[live]
        slopes = [np.zeros_like(field.own) for _ in range(3)]
        for slope, where in zip(slopes, (x, a, b), strict=True):
            np.add.at(slope, where[live], gap)
        slopes += [gap.sum(0), pairs - expected]
        for part, slope, past in zip(parts, slopes, seen, strict=True):
            slope -= 1e-2 * part
            past += slope**2
            part += 0.3 * slope / np.sqrt(past)
    return field


def _word_labels(text: str, data: np.ndarray, starts: np.ndarray, ends: np.ndarray,
                 spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Label of each word from spans in code points."""
    labels = np.zeros(len(starts), np.int64)
    for kind, start, end in spans:
        first = len(text[:start].encode())
        last = first + len(text[start:end].encode())
        touched = np.flatnonzero((starts < last) & (ends > first))
        labels[touched] = 2 + 2 * kind
        labels[touched[:1]] = 1 + 2 * kind
    return labels


def _training_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for value in batch.column(0):
            text = value.as_py() or ""
            data = np.frombuffer(text.encode(), np.uint8)
            shapes, starts, ends = word_shapes(data)
            if len(shapes) == 0:
                continue
            spans = base_spans(text)
            labels = _word_labels(text, data, starts, ends, spans)
            unsure = _word_labels(text, data, starts, ends, failing_spans(text)) > 0
            before, after = _beside(shapes)
            marked = np.flatnonzero(labels % 2 == 1)
            # Around every span, around ``NEGATIVES`` other words with a digit or an @, taken by
            # hash wherever they stand, and one at random.
            telling = np.concatenate([[0], np.cumsum(_TELLING[data])])
            odd = np.flatnonzero((labels == 0) & (telling[ends] > telling[starts]))
            mark = int.from_bytes(hashlib.md5(text.encode()).digest()[:6], "big")
            turn = mixed(odd.astype(np.uint64) + np.uint64(mark))
            odd = odd[np.argsort(turn, kind="stable")[:NEGATIVES]]
            centres = [(c, 1) for c in marked] + [(c, 1) for c in odd]
            centres.append((mark % len(shapes), 0))
            for c, kind in centres:
                part = slice(max(0, c - WINDOW), c + WINDOW + 1)
                if unsure[part].any():
                    continue
                four = np.array([shapes[part], before[part], after[part], labels[part]])
                order = hashlib.md5(f"{mark}:{c}".encode()).hexdigest()
                rows.append((kind, order, packed(four)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string()),
             pa.array([r[2] for r in rows], pa.binary())],
            names=["kind", "order", "window"],
        )


def fit_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Field:
    share = SAMPLE_DOCS / max(1, docs.count())
    sample = docs.filter(hash_fraction(F.coalesce(F.col(id_col).cast("string"), F.lit("")), share, "pii"))
    rows = map_texts(
        sample.select(text_col), _training_windows, "kind int, order string, window binary"
    )
    windows = []
    for kind in (0, 1):
        taken = rows.filter(F.col("kind") == kind).orderBy("order", "window")
        for r in taken.limit(SAMPLE_WINDOWS // 2).collect():
            windows.append(tuple(np.frombuffer(bytes(r.window), np.int64).reshape(4, -1)))
    if not any((w[3] > 0).any() for w in windows):
        windows = []
    return train_field(windows)


_FORM = {
    1: re.compile(r"[0-9]{1,3}(?:[.,][0-9]{1,3}){3}"),
    2: re.compile(r"[0-9](?:[ .-]?[0-9]){12,18}"),
    3: re.compile(r"[+(]?[0-9](?:[ ().-]{0,2}[0-9]){8,14}"),
}


def _formed(said: str, kind: int) -> tuple[int, int] | None:
    """Where words that the field has marked hold the bare form of their kind."""
    if kind == 0:
        span = next(_emails(said, _LOOSE_DOMAIN), None)
    else:
        span = m.span() if (m := _FORM[kind].search(said)) else None
    if span is None:
        return None
    start, end = span
    if said[max(0, start - 1) : start].isalnum() or said[end : end + 1].isalnum():
        return None
    text = said[start:end]
    fine = (
        kind in (0, 3) or (kind == 1 and _is_ip(text.replace(",", ".")))
        or (kind == 2 and _is_card(text.replace(".", "")))
    )
    return span if fine else None


class Finder:
    """All spans of texts; holds what is derived from a field."""

    def __init__(self, field: Field):
        self.field = field

    def open_runs(self, text: str) -> list[tuple[np.ndarray, ...]]:
        """Runs of words that need decoding: (scores, first bytes, last bytes)."""
        data = np.frombuffer(text.encode(), np.uint8)
        shapes, starts, ends = word_shapes(data)
        if len(shapes) == 0:
            return []
        field, made = self.field, []
        every = field.scores(shapes, *_beside(shapes))
        live = np.flatnonzero(field.open_words(every))
        if len(live) == 0:
            return []
        for run in np.split(live, np.flatnonzero(np.diff(live) > 1) + 1):
            scores = every[run]
            # The words around a run are outside.
            if run[0] > 0:
                scores[0] = scores[0] + field.steps[0]
            if run[-1] + 1 < len(shapes):
                scores[-1] = scores[-1] + field.steps[:, 0]
            made.append((scores, starts[run], ends[run]))
        return made

    def spans(self, texts: list[str]) -> list[tuple[list, list]]:
        """(base, all) spans of each text."""
        base = [base_spans(t) for t in texts]
        runs = [(i, *r) for i, t in enumerate(texts) for r in self.open_runs(t)]
        added: list[list] = [[] for _ in texts]
        runs.sort(key=lambda r: len(r[1]))
        at = 0
        while at < len(runs):
            # Runs of like length are decoded together; a very long one stands alone.
            width = max(8, 2 * len(runs[at][1]))
            stop, room = at, 0
            while stop < len(runs) and len(runs[stop][1]) <= width and room < 1 << 18:
                room += width
                stop += 1
            part = runs[at:stop]
            lengths = np.array([len(r[1]) for r in part])
            scores = np.zeros((len(part), int(lengths.max()), LABELS))
            for row, r in zip(scores, part, strict=True):
                row[: len(r[1])] = r[1]
            for labels, r in zip(viterbi(scores, lengths, self.field.steps), part, strict=True):
                if labels.any():
                    added[r[0]] += self._read(texts[r[0]], labels, r[2], r[3])
            at = stop
        result = []
        for own, more in zip(base, added, strict=True):
            taken = [(s, e) for _, s, e in own]
            extra = [x for x in more if all(x[2] <= s or x[1] >= e for s, e in taken)]
            result.append((own, sorted({*own, *extra})))
        return result

    def _read(self, text: str, labels: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list:
        raw, found, i = text.encode(), [], 0
        while i < len(starts):
            label = int(labels[i])
            j = i + 1
            if label:
                kind = (label - 1) // 2
                while j < len(starts) and labels[j] == 2 + 2 * kind:
                    j += 1
                first = len(raw[: starts[i]].decode())
                said = raw[starts[i] : ends[j - 1]].decode()
                span = _formed(said, kind)
                if span:
                    found.append((kind, first + span[0], first + span[1]))
            i = j
        return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def _batches(values: pa.Array, at_once: int = 1 << 20) -> Iterator[list[str]]:
    held, size = [], 0
    for v in values:
        held.append(v.as_py() or "")
        size += len(held[-1])
        if size >= at_once:
            yield held
            held, size = [], 0
    if held:
        yield held


def find_pii(
    docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(shared.value)
        for batch in batches:
            rows = []
            for texts in _batches(batch.column(1)):
                for base, every in finder.spans(texts):
                    counts = [sum(s[0] == k for s in base) for k in range(len(KINDS))]
                    digest = hashlib.sha256(joined(base).encode()).hexdigest()
                    rows.append((*counts, digest, joined(every)))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]],
                names=names,
            )

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS)
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    return map_texts(rows, find, schema + ", base_sha256 string, spans string")


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind in angle brackets."""
    made, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            made += [text[at:start], f"<{KINDS[kind]}>"]
        at = max(at, end)
    return "".join([*made, text[at:]])


def mask_pii(
    docs: DataFrame, field: Field, text_col: str = "text", size_col: str | None = "n_chars"
) -> DataFrame:
    """``docs`` with personal data masked; ``size_col`` is set anew where a text changed."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    at = docs.columns.index(text_col)
    size_at = docs.columns.index(size_col) if size_col in docs.columns else None

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(shared.value)
        for batch in batches:
            texts, sizes = [], []
            old = batch.column(size_at) if size_at is not None else None
            for part in _batches(batch.column(at)):
                for text, (_, spans) in zip(part, finder.spans(part), strict=True):
                    i = len(texts)
                    if spans:
                        text = masked(text, spans)
                        texts.append(text)
                        sizes.append(len(text))
                    else:
                        texts.append(batch.column(at)[i].as_py())
                        sizes.append(old[i].as_py() if old is not None else None)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if size_at is not None:
                columns[size_at] = pa.array(sizes, batch.schema.field(size_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return map_texts(docs, mask, docs.schema)
