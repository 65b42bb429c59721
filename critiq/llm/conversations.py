"""Repair of conversation structure by Viterbi decoding with survivor coalescence.

The rows of a conversation, ordered by turn (nulls first; rows of one turn by role, then by
the digest of their text), are edited as cheaply as possible until the initials of their
roles read ``(s?(ua)+)?``: nothing, or a system row at most and then pairs of user and
assistant. Keep costs 0, a new role (user or assistant) 1, deletion 2, an inserted empty row
of user or assistant 5; a truncated row that stays costs 5 more. Blank and repeated rows must
go. Of equally cheap repairs the one whose initials (K, R, D, I) are least in ASCII wins.

Decoding reads a conversation once, row by row. Four states (nothing yet, system, user, pair
complete) each keep one survivor. Their edits form a tree of back pointers with counts of
references: a survivor that loses gives back the nodes that only it held, and as soon as all
survivors share an ancestor the edits up to it are final and leave the tree. Survivors that
can't win any more are dropped at once: a complete pair can do whatever the first two states
can, but keep a system row, which costs 2 to delete. Two repairs with the same state after
the same rows and the same cost never continue one another, as more letters would be dearer
insertions; so they are ordered by rank where they part, which holds for whole tied suffixes.

Only flags and digests of rows travel to the decoder. The texts are streamed once more beside
the finished edits, so that no text waits for a decision. A conversation is read by one task,
which holds its unresolved edits but no rows: the hash of a repaired conversation is
sequential, and its audit is one value.

Defined results: null roles and texts are one space; a role without an initial s, u or a can't
be kept; null conversation IDs are one conversation; null turns come first and are left out of
gaps; equal rows are repeated ones; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from critiq.llm.common import map_texts, written

KEEP, REROLE, DELETE, INSERT = b"KRDI"
_COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
_CUT = 5
#: States: nothing yet, system, user, pair complete. Those of a whole conversation: 0 and 3.
_KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_NEW = (2, 2, 3, 2)
_ROLE = ("", "", "user", "assistant")
#: Where a state is reached from by insertions: (state, how many).
_INSERTED = ((), (), ((0, 1), (1, 1), (3, 1)), ((2, 1), (0, 2), (1, 2)))
_LEGAL = {"su", "ua", "au"}
_SPACES = " \t\n\x0b\f\r"
#: One record repeated over a whole conversation is split over so many tasks.
_SALTS = 64
_REPORT = (
    "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"
)
_REPORTS_PER_BATCH = 1000
_BATCH_BYTES = 1 << 22


class _Edits:
    """Tree of back pointers; ``root`` is the last edit that is final."""

    def __init__(self) -> None:
        self.parent, self.letter, self.held, self.below = [0, 0], bytearray(2), [0, 0], [0, 0]
        self.free: list[int] = []
        self.root = 1
        self.done = bytearray()

    def add(self, parent: int, letter: int) -> int:
        """A node that nothing holds yet below ``parent``."""
        if self.free:
            node = self.free.pop()
            self.parent[node], self.letter[node] = parent, letter
        else:
            node = len(self.parent)
            self.parent.append(parent)
            self.letter.append(letter)
            self.held.append(0)
            self.below.append(0)
        self.held[parent] += 1
        # The numbers of all children, each taken out again when it goes.
        self.below[parent] ^= node
        return node

    def release(self, node: int) -> None:
        self.held[node] -= 1
        while not self.held[node] and node != self.root:
            above = self.parent[node]
            self.held[above] -= 1
            self.below[above] ^= node
            self.free.append(node)
            node = above

    def settle(self) -> None:
        """Move the root down while all survivors share the next edit."""
        held, below, root = self.held, self.below, self.root
        while held[root] == 1 and below[root]:
            child = below[root]
            self.done.append(self.letter[child])
            held[root] = below[root] = 0
            self.free.append(root)
            root = child
        self.root = root

    def waiting(self) -> int:
        """Nodes in use."""
        return len(self.parent) - 2 - len(self.free)


class Decoder:
    """Survivors of one conversation: per state its cost, its order, inserted rows and edits."""

    def __init__(self) -> None:
        self.edits = _Edits()
        self.edits.held[1] += 1
        # (cost, rank, insertions after the last row's edit, node of that edit)
        self.best: list[tuple | None] = self._with_insertions([(0, 0, 1), None, None, None])

    def row(self, initial: str, forced: bool, cut: bool) -> None:
        extra = _CUT if cut else 0
        found: list[tuple | None] = [None] * 4

        def offer(state: int, cost: int, old: tuple, letter: int) -> None:
            entry = (cost, old[1], b"I" * old[2] + bytes((letter,)), old[3])
            if found[state] is None or entry[:3] < found[state][:3]:
                found[state] = entry

        for state, old in enumerate(self.best):
            if old is None:
                continue
            offer(state, old[0] + _COST[DELETE], old, DELETE)
            if not forced:
                kept = _KEPT[state].get(initial)
                if kept is not None:
                    offer(kept, old[0] + extra, old, KEEP)
                offer(_NEW[state], old[0] + _COST[REROLE] + extra, old, REROLE)

        order = {key: i for i, key in enumerate(sorted({e[1:3] for e in found if e}))}
        before = {old[3] for old in self.best if old}
        ends: list[tuple | None] = [None] * 4
        for state, entry in enumerate(found):
            if entry:
                node = entry[3]
                for letter in entry[2]:
                    node = self.edits.add(node, letter)
                self.edits.held[node] += 1
                ends[state] = (entry[0], order[entry[1:3]], node)
        for node in before:
            self.edits.release(node)
        self.best = self._with_insertions(ends)
        self.edits.settle()

    def _with_insertions(self, ends: list[tuple | None]) -> list[tuple | None]:
        """Survivors by state, also through inserted rows; ends that lose are given back."""
        best: list[tuple | None] = []
        for state in range(4):
            options = [(e[0], e[1], 0, e[2]) for e in [ends[state]] if e]
            for source, times in _INSERTED[state]:
                if ends[source]:
                    cost, rank, node = ends[source]
                    options.append((cost + times * _COST[INSERT], rank, times, node))
            best.append(min(options, default=None))
        start, system, _, pair = best
        if start and pair and pair[0] + _COST[DELETE] < start[0]:
            best[0] = start = None
        if system and any(o and o[:2] < system[:2] for o in (start, pair)):
            best[1] = None
        used = {b[3] for b in best if b}
        for end in ends:
            if end and end[2] not in used:
                self.edits.release(end[2])
        return best

    def finish(self) -> tuple[int, str]:
        """Cost and initials of the best repair."""
        cost, _, times, node = min(b for b in (self.best[0], self.best[3]) if b)
        for other in {b[3] for b in self.best if b} - {node}:
            self.edits.release(other)
        self.edits.settle()
        return cost, (bytes(self.edits.done) + b"I" * times).decode()


class _Conversation:
    """Counts and decoder over the rows of one conversation."""

    def __init__(self) -> None:
        self.decoder = Decoder()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = None
        self.initial: str | None = None

    def row(self, turn: int | None, initial: str, blank: bool, again: bool, cut: bool) -> None:
        if self.initial is not None and self.initial + initial not in _LEGAL:
            self.illegal += 1
        self.initial = initial
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last = turn
            self.turns += 1
        self.blank += blank
        again = again and not blank
        self.duplicate += again
        cut = cut and not blank and not again
        self.truncated += cut
        self.decoder.row(initial, blank or again, cut)

    def report(self) -> tuple:
        cost, audit = self.decoder.finish()
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


def _plain(rows: DataFrame, names: tuple[str, str, str, str]) -> DataFrame:
    """``conv, turn, role, text, digest`` without null roles and texts."""
    conv, turn, role, text = (F.col(n) for n in names)
    space = F.lit(" ")
    return rows.select(
        conv.alias("conv"), turn.cast("bigint").alias("turn"),
        F.coalesce(role.cast("string"), space).alias("role"),
        F.coalesce(text.cast("string"), space).alias("text"),
    ).withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def _flagged(plain: DataFrame) -> DataFrame:
    """Rows without their texts: ``conv, turn, role, digest, blank, cut, again``.

    A record that occurs many times in one conversation is first thinned out within parts.
    """
    end = F.substring(F.rtrim("text", F.lit(_SPACES)), -1, 1)
    rows = written(
        plain.select(
            "conv", "turn", "role", "digest", (end == "").alias("blank"),
            (~end.isin(".", "!", "?")).alias("cut"),
            F.monotonically_increasing_id().alias("place"),
        )
    )
    salt = F.pmod("place", F.lit(_SALTS))
    same = ["conv", "role", "digest"]
    inside = Window.partitionBy(*same, salt).orderBy("turn", "place")
    # What isn't the first of its part can't be the first of all and stays in its part.
    part = F.when(F.col("nth") > 1, salt)
    across = Window.partitionBy(*same, part).orderBy("turn", "place")
    return (
        rows.withColumn("nth", F.row_number().over(inside))
        .withColumn("of_first", F.row_number().over(across))
        .withColumn("again", (F.col("nth") > 1) | (F.col("of_first") > 1))
        .drop("nth", "of_first", "place")
    )


def _ordered(rows: DataFrame, *after: Column | str) -> DataFrame:
    """All rows of a conversation one after another in one partition, headers first."""
    order = ["conv", F.col("role").isNotNull(), "turn", "role", "digest", *after]
    return rows.repartition("conv").sortWithinPartitions(*order)


def repair_reports(
    rows: DataFrame,
    conversations: DataFrame | None = None,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """``conv, gaps, blank, duplicate, truncated, illegal, cost, audit`` per conversation.

    ``conversations`` has IDs (``conv_col``) to report also where they have no rows.
    """
    flagged = _flagged(_plain(rows, (conv_col, turn_col, role_col, text_col)))
    if conversations is not None:
        flagged = flagged.unionByName(
            conversations.select(F.col(conv_col).alias("conv")).distinct(),
            allowMissingColumns=True,
        )
    stream = _ordered(flagged, "again").select(
        "conv", "turn", F.substring("role", 1, 1).alias("initial"), "blank", "again", "cut"
    )
    kind = to_arrow_type(stream.schema["conv"].dataType)
    names = ["conv", *[f.split()[0] for f in _REPORT.split(", ")], "audit"]
    kinds = [kind, *[pa.int64()] * 6, pa.string()]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, number, open_one = None, None, False
        reports: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            columns = zip(*reports) if reports else [()] * len(names)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=names
            )

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for conv, turn, initial, blank, again, cut in zip(*columns):
                if not open_one or conv != number:
                    if open_one:
                        reports.append((number, *current.report()))
                        size += len(reports[-1][-1])
                    if len(reports) >= _REPORTS_PER_BATCH or size > _BATCH_BYTES:
                        yield flush()
                        reports, size = [], 0
                    current, number, open_one = _Conversation(), conv, True
                if initial is not None:
                    current.row(turn, initial, blank, again, cut)
        if open_one:
            reports.append((number, *current.report()))
        yield flush()

    conv_kind = stream.schema["conv"].dataType.simpleString()
    return stream.mapInArrow(decode, f"conv {conv_kind}, {_REPORT}, audit string")


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conversation, place, turn, role, text, edit) of repaired rows, in order.

    A conversation begins with (number, -1, audit, ...) of its header.
    """
    number, audit, at, state, place = None, "", 0, 0, 0
    opened = False

    def inserted() -> Iterator[tuple]:
        nonlocal at, state, place
        while at < len(audit) and audit[at] == "I":
            state = _NEW[state]
            yield number, place, None, _ROLE[state], "", "insert"
            at, place = at + 1, place + 1

    for batch in batches:
        for i in range(batch.num_rows):
            header = batch.column("audit")[i].as_py()
            if header is not None:
                if opened:
                    yield from inserted()
                number, audit, at, state, place = batch.column("conv")[i].as_py(), header, 0, 0, 0
                opened = True
                yield number, -1, batch, i, "", "header"
                continue
            yield from inserted()
            edit, at = audit[at], at + 1
            if edit == "D":
                continue
            role, text = batch.column("role")[i].as_py(), batch.column("text")[i].as_py()
            if edit == "K":
                state = _KEPT[state][role[:1]]
            else:
                state = _NEW[state]
                role = _ROLE[state]
            name = "keep" if edit == "K" else "new role"
            yield number, place, batch.column("turn")[i].as_py(), role, text, name
            place += 1
    if opened:
        yield from inserted()


def _with_headers(
    rows: DataFrame, reports: DataFrame, names: tuple[str, str, str, str]
) -> DataFrame:
    plain = _plain(rows, names)
    kept = [c for c in reports.columns if c != "conv"]
    stream = _ordered(plain.unionByName(reports, allowMissingColumns=True))
    return stream.select("conv", "turn", "role", "text", *kept)


def repaired_rows(
    rows: DataFrame,
    reports: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """The rows of repaired conversations: ``conv, place, turn, role, text, edit``.

    ``reports`` are those of the same rows. ``place`` counts from 0 within a conversation;
    inserted rows have no turn and no text.
    """
    stream = _with_headers(rows, reports, (conv_col, turn_col, role_col, text_col))
    conv = stream.schema["conv"].dataType
    names = ["conv", "place", "turn", "role", "text", "edit"]
    kinds = [to_arrow_type(conv), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            columns = zip(*held) if held else [()] * len(names)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=names
            )

        for event in _replayed(batches):
            if event[5] == "header":
                continue
            held.append(event)
            size += len(event[4])
            if len(held) >= _REPORTS_PER_BATCH or size > _BATCH_BYTES:
                yield flush()
                held, size = [], 0
        yield flush()

    kind = conv.simpleString()
    schema = f"conv {kind}, place bigint, turn bigint, role string, text string, edit string"
    return map_texts(stream, replay, schema)


def repaired_digests(
    rows: DataFrame,
    reports: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """``reports`` with ``repaired_sha256``: hash of ``role:text`` lines of what is left."""
    stream = _with_headers(rows, reports, (conv_col, turn_col, role_col, text_col))
    names = reports.columns
    kinds = [to_arrow_type(reports.schema[n].dataType) for n in names]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        size = 0
        report, running = None, hashlib.sha256()

        def flush() -> pa.RecordBatch:
            columns = zip(*done) if done else [()] * (len(names) + 1)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, [*kinds, pa.string()])],
                names=[*names, "repaired_sha256"],
            )

        for event in _replayed(batches):
            if event[5] == "header":
                if report is not None:
                    done.append((*report, running.hexdigest()))
                    size += len(report[-1])
                if len(done) >= _REPORTS_PER_BATCH or size > _BATCH_BYTES:
                    yield flush()
                    done, size = [], 0
                batch, i = event[2], event[3]
                report = [batch.column(n)[i].as_py() for n in names]
                running = hashlib.sha256()
                continue
            if event[1]:
                running.update(b"\n")
            running.update(f"{event[3]}:{event[4]}".encode())
        if report is not None:
            done.append((*report, running.hexdigest()))
        yield flush()

    fields = [f"{n} {reports.schema[n].dataType.simpleString()}" for n in names]
    return map_texts(stream, digest, ", ".join([*fields, "repaired_sha256 string"]))


def repaired(
    rows: DataFrame, conversations: DataFrame | None = None, conv_col: str = "conv_id", **columns
) -> DataFrame:
    """Report of every conversation with the digest of its repaired rows."""
    reports = written(repair_reports(rows, conversations, conv_col, **columns))
    found = repaired_digests(rows, reports, conv_col, **columns)
    return found.withColumnRenamed("conv", conv_col)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows ``conv_id, turn, role, text`` with faults dealt by crc32(``conv_id:turn``) % 20:
    0 drops a row, 1 empties its text, 2 takes its ``.!?``, 3 repeats it, 4 makes it user."""
    space = F.lit(" ")
    key = F.concat(
        F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
        F.coalesce(F.col("turn").cast("string"), space),
    )
    fault = F.crc32(key.cast("binary")) % 20
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    times = F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1)
    return rows.select(
        "conv_id", "turn",
        F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", ""))
        .otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(0), times)).alias("time"),
    ).drop("time")
