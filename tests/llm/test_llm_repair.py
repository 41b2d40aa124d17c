"""Repair of conversations against a plain version that searches over all edits."""

import hashlib
import heapq
import re
import zlib

import numpy as np
import pytest

from reviewlens.llm import repair

NOT_BLANK = re.compile(r"[^\x20\x09-\x0D]")


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def plain_repair(turns):
    """Shortest path over (rows done, state), ordered by cost, then by edits: Dijkstra on whole strings."""
    steps = {"s": {"": "s"}, "u": {"": "u", "s": "u", "a": "u"}, "a": {"u": "a"}}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, edits, at, state, out = heapq.heappop(heap)
        if at == len(turns) and state in ("", "a"):
            return cost, edits, out
        if (at, state) in done:
            continue
        done.add((at, state))
        for role in ("user", "assistant"):
            if state in steps[role[0]]:
                heapq.heappush(heap, (cost + 3, edits + "I", at, role[0], (*out, (role, ""))))
        if at < len(turns):
            role, text, fault = turns[at]
            heapq.heappush(heap, (cost + 4, edits + "D", at + 1, state, out))
            if fault in (None, "truncated"):
                extra = 3 if fault else 0
                if state in steps.get(role[:1], {}):
                    heapq.heappush(heap, (cost + extra, edits + "K", at + 1, role[0], (*out, (role, text))))
                for target in ("user", "assistant"):
                    if state in steps[target[0]]:
                        heapq.heappush(heap, (cost + 3 + extra, edits + "R", at + 1, target[0], (*out, (target, text))))


def plain_report(rows):
    kept, report = plain_damage(rows), []
    for conv in {row[0] for row in rows}:
        own = sorted((r for r in kept if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        seen, turns = set(), []
        for _, _, role, text in own:
            marks = NOT_BLANK.findall(text)
            fault = "blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else None
            seen.add((role, text))
            turns.append((role, text, fault))
        known = [r[1] for r in own if r[1] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        faults = [t[2] for t in turns]
        initials = [t[0][:1] for t in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, edits, out = plain_repair(turns)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
        report.append((conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, edits, sha))
    return sorted(report, key=repr)


def conversations():
    rng = np.random.default_rng(17)
    texts = ["Yes.", "No!", "What?", "cut off", " \t\n", "", "Fine.\n ", "été.", None, "a.b", "Same."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "umpire"]
    rows = []
    for conv in range(150):
        n = int(rng.integers(1, 14))
        rows += [(conv, int(t), roles[int(rng.integers(0, len(roles)))], texts[int(rng.integers(0, len(texts)))]) for t in rng.choice(30, n, replace=False)]
    for conv in range(200, 260):  # mostly whole
        rows += [(conv, 0, "system", "Be kind.")] + [(conv, t, ("assistant", "user")[t % 2], f"Turn {t}.") for t in range(1, 9)]
    rows += [(300, t, "user", "same words.") for t in range(400)]  # long, all duplicates but one
    rows += [(301, t, ("user", "assistant")[t % 2], f"Long {t}" + ".?"[t % 3 : t % 3 + 1]) for t in range(700)]
    rows += [(None, 1, "user", "Hello."), (None, 2, "assistant", "Hi."), (302, None, "assistant", "Only."), (303, 5, "user", None)]
    rows += [(304, 7, "user", "Twice."), (304, 7, "user", "Twice."), (305, 1, "user", "x" * 300_000 + "."), (305, 2, "assistant", "y.")]
    # A conversation of which nothing is left.
    gone = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    return [*rows, (gone, 1, "user", "Gone.")]


def frame(spark, rows):
    schema = "conv_id long, turn long, role string, text string, kind int, digest string, is_turn int, audit string"
    return spark.createDataFrame([(*row, 1, "x", 2, "y") for row in rows], schema).repartition(3)


def test_report_equals_search_over_all_edits(spark):
    rows = conversations()
    found = repair.damage_and_repair(frame(spark, rows))
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got, wanted = sorted((tuple(r) for r in found.collect()), key=repr), plain_report(rows)
    assert got == wanted
    assert any(row[7] == "" for row in wanted) and {c for row in wanted for c in row[7]} == set("DIKR")
    assert repair.damage_and_repair(frame(spark, rows[:1]).where("false")).count() == 0


def test_repaired_turns_are_whole_conversations(spark):
    turns = frame(spark, conversations())
    audited = repair.audits(turns)
    by = {}
    for row in repair.repaired_turns(turns, audited).orderBy("conv_id", "position").collect():
        by.setdefault(row.conv_id, []).append(row)
    for rows in by.values():
        assert [row.position for row in rows] == list(range(len(rows)))
        assert re.fullmatch("(s?(ua)+)?", "".join(row.role[0] for row in rows))
    whole = next(rows for conv, rows in by.items() if conv == 200)
    assert [row.text for row in whole] == ["Be kind.", *(f"Turn {t}." for t in range(1, 9))]


@pytest.mark.parametrize("per_round", [1, 16])
def test_grammar_shortens_and_changes_nothing(spark, per_round):
    rng = np.random.default_rng(2)
    strings = ["".join(rng.choice(list("aefghijklmnop"), int(rng.integers(0, 40)))) for _ in range(200)]
    df = spark.createDataFrame([(s,) for s in strings * 2], "symbols string")
    rules = repair.shared_grammar(df, rounds=6, per_round=per_round)
    assert len(rules) == len(set(rules)) and (per_round > 1 or len(rules) == 6)
    shared, plain = repair.transfer_matrices(rules), repair.transfer_matrices([])
    for text in strings:
        assert repair.cheapest(text, rules, shared) == repair.cheapest(text, [], plain)


def test_ropes_compare_like_texts():
    rng = np.random.default_rng(8)
    for _ in range(300):
        parts = ["".join(rng.choice(list("DIKR"), int(rng.integers(0, 50)), p=[0.9, 0.05, 0.03, 0.02])) for _ in range(8)]
        a = repair.Rope("")
        for part in parts:
            a = a + repair.Rope(part)
        text = "".join(parts)
        cut = int(rng.integers(0, len(text) + 1))
        changed = text[:cut] + str(rng.choice(list("DIKR"))) + text[cut + 1 :]
        b = repair.Rope(changed[:30]) + (repair.Rope(changed[30:90]) + repair.Rope(changed[90:]))
        assert str(a) == text and str(b) == changed
        assert (a < b, b < a) == (text < changed, changed < text)
