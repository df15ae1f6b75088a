"""Conversation repair against all edits of short conversations, and on odd rows."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from finsift.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, Audit string, kind int, place string"


def brute(turns):
    """The cheapest (cost, audit, lines) over all edits: a state machine without the program's gaps and minima."""
    seen, states, end = set(), {"": (0, "", [])}, {}
    goes = lambda s, t: t in {"": "su", "s": "u", "u": "a", "a": "u"}[s]

    def inserted(states):
        for _ in range(2):
            for s, (c, a, lines) in list(states.items()):
                t = "a" if s == "u" else "u"
                one = (c + 3, a + "I", [*lines, ("user" if t == "u" else "assistant") + ":"])
                if t not in states or one[:2] < states[t][:2]:
                    states[t] = one
        return states

    counts = {"blank": 0, "duplicate": 0, "truncated": 0}
    for role, text in turns:
        bare = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        after = {}
        for s, (c, a, lines) in inserted(dict(states)).items():
            able = [("D", s, 4, [])]
            if fault not in ("blank", "duplicate"):
                more = 3 if fault else 0
                able += [("K", role[:1], more, [f"{role}:{text}"])] if role[:1] and role[:1] in "sua" else []
                able += [("R", r[0], 3 + more, [f"{r}:{text}"]) for r in ("user", "assistant")]
            for letter, t, price, line in able:
                if letter == "D" or goes(s, t):
                    one = (c + price, a + letter, lines + line)
                    if t not in after or one[:2] < after[t][:2]:
                        after[t] = one
        states = after
    end = inserted(dict(states))
    cost, audit, lines = min((end[s] for s in end if s in ("", "a")), key=lambda x: x[:2])
    assert re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in lines))
    return cost, audit, lines, counts


def all_edits(turns):
    """Every edit sequence of a very short conversation with at most three insertions in a row."""
    best, seen, faults = None, set(), []
    for role, text in turns:
        bare = text.strip()
        faults.append("go" if not bare or (role, text) in seen else "cut" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    ins = [x for n in range(3) for x in itertools.product(("user", "assistant"), repeat=n)]
    for letters in itertools.product("DKR", repeat=len(turns)):
        if any(f == "go" and x != "D" for f, x in zip(faults, letters, strict=True)):
            continue
        for roles in itertools.product(*(("user", "assistant") if x == "R" else ("",) for x in letters)):
            for gaps in itertools.product(ins, repeat=len(turns) + 1):
                said, audit, cost = [], "", 0
                for i in range(len(turns) + 1):
                    said += [r + ":" for r in gaps[i]]
                    audit, cost = audit + "I" * len(gaps[i]), cost + 3 * len(gaps[i])
                    if i < len(turns):
                        audit += letters[i]
                        cost += {"K": 0, "R": 3, "D": 4}[letters[i]] + (3 if faults[i] == "cut" and letters[i] != "D" else 0)
                        said += [] if letters[i] == "D" else [(roles[i] or turns[i][0]) + ":" + turns[i][1]]
                if re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in said)) and (best is None or (cost, audit) < best[:2]):
                    best = (cost, audit, said)
    return best


def own(turns):
    now = repair.Repair()
    for role, text in turns:
        bare = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
        now.add(role, text, not bare, not bare or bare[-1] not in ".!?")
    return now.result()


def test_program_equals_all_edits():
    draw = random.Random(5)
    turn = lambda: (draw.choice(["system", "user", "assistant", "tool", ""]), draw.choice(["A.", "B!", "c", " "]))
    for n in (0, 1, 2):
        for _ in range(40):
            turns = [turn() for _ in range(n)]
            assert own(turns) == all_edits(turns)[:2] == brute(turns)[:2], turns


def test_program_equals_state_machine_on_long_conversations():
    draw = random.Random(7)
    for _ in range(300):
        turns = [(draw.choice(["system", "user", "assistant", "assistant", "user", "x"]), draw.choice([f"{i} a.", f"{i} b", "again.", ""])) for i in range(draw.randrange(60))]
        assert own(turns) == brute(turns)[:2]
    before = repair.step.cache_info().currsize
    own([(draw.choice(["user", "assistant", "system"]), f"{i}." if draw.random() < 0.5 else "") for i in range(50_000)])
    assert repair.step.cache_info().currsize < before + 500


@pytest.fixture(scope="module")
def rows(spark):
    long = "word " * 200_000
    return [
        (1, 0, "system", "Be kind.", "x", 0, "p"), (1, 1, "user", "Hello?", None, 1, None), (1, 2, "assistant", long + ".", "x", 0, "p"),
        (2, None, None, None, "x", 0, "p"), (2, 5, "user", "One.", "x", 0, "p"), (2, 5, "user", "One.", "x", 0, "p"), (2, 2, "assistant", "Two", "x", 0, "p"),
        (None, 1, "user", "Hi.", "x", 0, "p"), (None, 4, "user", "Hm.", "x", 0, "p"), (3, None, None, "", "x", 0, "p"), (4, None, "user", "", "x", 0, "p"), (4, 1, "User", "Ça va?", "x", 0, "p"),
    ]


def test_odd_rows(spark, rows):
    turns = repair.ordered(spark.createDataFrame(rows, SCHEMA))
    told = repair.reports(turns)
    by = {}
    for r in sorted(rows, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1], r[2] or " ", hashlib.md5((r[3] or " " if r[3] is None else r[3]).encode()).hexdigest())):
        by.setdefault(r[0], []).append((r[2] or " ", " " if r[3] is None else r[3]))
    got = {r.conv_id: r for r in told.collect()}
    assert got.keys() == by.keys()
    lines = {}
    for r in repair.repaired(turns, told).collect():
        lines.setdefault(r.conv_id, {})[r.place] = f"{r.role}:{r.text}"
    for conv, given in by.items():
        cost, audit, said, counts = brute(given)
        assert (got[conv].cost, got[conv].audit) == (cost, audit)
        assert {k: got[conv][k] for k in counts} == counts
        assert [lines.get(conv, {})[i] for i in range(len(said))] == said
    hashes = {r.conv_id: r.sha256 for r in repair.line_hashes(repair.repaired(turns, told)).collect()}
    assert hashes == {c: hashlib.sha256("\n".join(brute(g)[2]).encode()).hexdigest() for c, g in by.items() if brute(g)[2]}


def test_query_on_odd_rows(spark, rows, tmp_path):
    gone = next(i for i in range(1000, 2000) if zlib.crc32(f"{i}:7".encode()) % 20 == 0)
    spark.createDataFrame([*rows, (gone, 7, "user", "Lost.", "", 0, "")], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in repair.op11_conversation_repair(spark, str(tmp_path)).collect()}
    assert got.keys() == {1, 2, 3, 4, None, gone}
    last = got[gone]
    assert tuple(last)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[3].gaps == 0


def test_empty_table(spark):
    turns = repair.ordered(spark.createDataFrame([], SCHEMA))
    assert repair.reports(turns).count() == 0 and repair.repaired(turns, repair.reports(turns)).count() == 0
