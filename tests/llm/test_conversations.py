import hashlib
import random
import re
import zlib

import pytest

from critiq.llm.conversations import (
    Decoder, damaged, repair_reports, repaired, repaired_rows,
)

SCHEMA = "conv_id long, turn long, role string, text string, audit string, digest int, place long"
LEGAL = re.compile(r"(s?(ua)+)?\Z")
BEGUN = re.compile(r"s?(ua)*u?\Z")


def cheapest(rows):
    """(cost, letters, lines) over every edit sequence; rows: (role, text, forced, cut)."""
    best = None

    def go(i, cost, letters, lines):
        nonlocal best
        initials = "".join(r[:1] or "-" for r, _ in lines)
        if best is not None and cost > best[0] or cost > 2 * len(rows):
            return
        if not BEGUN.match(initials):
            return
        if i == len(rows):
            if LEGAL.match(initials):
                entry = (cost, letters, lines)
                best = entry if best is None else min(best, entry, key=lambda e: e[:2])
        else:
            role, text, forced, cut = rows[i]
            go(i + 1, cost + 2, letters + "D", lines)
            if not forced:
                go(i + 1, cost + 5 * cut, letters + "K", lines + [(role, text)])
                for new in ("user", "assistant"):
                    go(i + 1, cost + 1 + 5 * cut, letters + "R", lines + [(new, text)])
        for new in ("user", "assistant"):
            go(i, cost + 5, letters + "I", lines + [(new, "")])

    go(0, 0, "", [])
    return best


def faults(rows):
    """(role, text, forced, cut) and counts (blank, duplicate, truncated) of ordered rows."""
    seen, out, counts = set(), [], [0, 0, 0]
    for role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        again = (role, text) in seen
        seen.add((role, text))
        kind = 0 if not solid else 1 if again else 2 if solid[-1] not in ".!?" else None
        if kind is not None:
            counts[kind] += 1
        out.append((role, text, kind in (0, 1), kind == 2))
    return out, counts


def brute_force(table):
    """Report per conversation of (conv, turn, role, text) rows before damage."""
    found = {}
    for conv in {r[0] for r in table}:
        rows = []
        for _, turn, role, text in (r for r in table if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
            fault = zlib.crc32(key.encode()) % 20
            role = "user" if fault == 4 else role
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            rows += [(turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1],
                                 hashlib.sha256(r[2].encode()).digest()))
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
        edited, counts = faults([r[1:] for r in rows])
        cost, audit, lines = cheapest(edited)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        illegal = sum(p not in ("su", "ua", "au") for p in pairs)
        found[conv] = (gaps, *counts, illegal, cost, audit, sha)
    return found


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 3, 4) for r in rows], SCHEMA).repartition(3)


def check(spark, rows):
    table = frame(spark, rows)
    got = {r[0]: tuple(r[1:]) for r in repaired(damaged(table), table).collect()}
    assert got == brute_force(rows)


def conversations(seed, n, longest=6):
    rng = random.Random(seed)
    roles = ["user", "user", "assistant", "assistant", "system", "tool", "", None]
    texts = ["Yes.", "Go on!", "no end", " ", "", None, "\x0b\x1c", "Ok?\r\n", "漢。", "Mr. X"]
    rows = []
    for conv in range(n):
        for place in range(rng.randrange(1, longest)):
            turn = place if rng.random() < 0.8 else rng.choice([None, place + 3, 0])
            rows.append((conv, turn, rng.choice(roles), rng.choice(texts)))
    return rows


def test_awkward_conversations(spark):
    rows = conversations(4, 150) + [(None, None, None, None), (None, 1, "user", "Hi."),
                                    (None, 2, "assistant", "Ho.")]
    check(spark, rows + rows[:20])


def test_every_short_pattern_equals_all_edit_sequences():
    rng = random.Random(8)
    for _ in range(2500):
        size = rng.randrange(0, 6)
        rows = [(rng.choice(["user", "assistant", "system", "x"]), str(i),
                 rng.random() < 0.15, False) for i in range(size)]
        rows = [(r, t, f, not f and rng.random() < 0.2) for r, t, f, _ in rows]
        decoder = Decoder()
        for role, _, forced, cut in rows:
            decoder.row(role[:1], forced, cut)
        assert decoder.finish() == cheapest(rows)[:2]


def plain_decoding(rows):
    """Whole strings for every state."""
    steps = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}

    def widened(best):
        for _ in range(4):
            for s, (cost, text) in list(best.items()):
                for t in set(steps[s].values()) - {1}:
                    best[t] = min(best.get(t, (cost + 5, text + "I")), (cost + 5, text + "I"))
        return best

    best = widened({0: (0, "")})
    for initial, forced, cut in rows:
        fresh = {}
        for s, (cost, text) in best.items():
            options = [(s, cost + 2, "D")]
            if not forced:
                options += [(t, cost + 5 * cut, "K") for i, t in steps[s].items() if i == initial]
                options += [(t, cost + 1 + 5 * cut, "R")
                            for i, t in steps[s].items() if i in "ua"]
            for t, price, letter in options:
                fresh[t] = min(fresh.get(t, (price, text + letter)), (price, text + letter))
        best = widened(fresh)
    return min(best[s] for s in (0, 3) if s in best)


def test_long_conversations_equal_whole_strings():
    rng = random.Random(2)
    for weights in ([1, 1, 0.1], [5, 1, 0.1], [1, 0, 0], [0, 1, 1]):
        rows = [(rng.choices("uas", weights)[0], rng.random() < 0.1, rng.random() < 0.1)
                for _ in range(300)]
        decoder = Decoder()
        for row in rows:
            decoder.row(*row)
        assert decoder.finish() == plain_decoding(rows)


def test_settled_edits_leave_the_tree():
    decoder, most = Decoder(), 0
    rng = random.Random(1)
    for i in range(20_000):
        decoder.row("ua"[i % 2] if rng.random() > 0.05 else "u", rng.random() < 0.05, False)
        most = max(most, decoder.edits.waiting())
    assert most < 400
    assert len(decoder.finish()[1]) >= 20_000


def test_undecided_edits_are_kept_whole():
    decoder = Decoder()
    for _ in range(4001):
        decoder.row("u", False, False)
    assert decoder.finish() == (2002, "D" + "KR" * 2000)


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be good."), (1, 1, "assistant", "Hello."), (1, 2, "assistant", "So."),
            (1, 3, "user", " "), (2, 5, "user", "And?"), (3, 1, "tool", "")]
    table = frame(spark, rows)
    reports = repair_reports(table, table)
    got = sorted(map(tuple, repaired_rows(table, reports).collect()))
    assert got == [
        (1, 0, 0, "system", "Be good.", "keep"),
        (1, 1, 1, "user", "Hello.", "new role"),
        (1, 2, 2, "assistant", "So.", "keep"),
    ]
    audits = {r.conv: (r.cost, r.audit) for r in reports.collect()}
    assert audits == {1: (3, "KRKD"), 2: (2, "D"), 3: (2, "D")}


def test_one_conversation_holds_most_rows(spark):
    rng = random.Random(5)
    rows = [(7, i, "user" if i % 2 else "assistant", rng.choice(["Same.", "Other!", f"{i}."]))
            for i in range(5000)]
    rows += [(i, 0, "user", "Hi.") for i in range(8, 60)]
    table = frame(spark, rows)
    got = {r.conv: r for r in repair_reports(table).collect()}
    marked, counts = faults([r[2:] for r in rows if r[0] == 7])
    want = plain_decoding([(r[:1], forced, cut) for r, _, forced, cut in marked])
    assert (got[7].cost, got[7].audit) == want
    assert [got[7].blank, got[7].duplicate, got[7].truncated] == counts
    assert len(got) == 53


def test_empty_table(spark):
    table = frame(spark, [])
    got = repaired(damaged(table), table)
    assert got.isEmpty() and got.columns == [
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        "repaired_sha256",
    ]


def test_conversation_without_rows_after_damage(spark):
    conv = next(c for c in range(100) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    table = frame(spark, [(conv, 0, "user", "Gone.")])
    got = repaired(damaged(table), table).collect()
    assert [tuple(r) for r in got] == [
        (conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    ]


@pytest.mark.parametrize("text", ["long " * 400_000 + "end."])
def test_long_text(spark, text):
    check(spark, [(1, 0, "user", text), (1, 1, "assistant", text)])
