"""Repair against a best-first search over all edits, on conversations with nulls, ties, repeats and any roles."""

import heapq
import random
import re
import zlib
from collections import defaultdict
from hashlib import sha256

from planlens.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, live string, kind int, signature string, audit string"
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def damage(rows):
    out = []
    for conv, turn, role, text, *_ in rows:
        show = lambda v: " " if v is None else str(v)
        k = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if k == 0:
            continue
        new = (conv, turn, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
        out += [new, new] if k == 3 else [new]
    return out


def cheapest(rows):
    """rows: (role, fault).  Cost, audit and lines by taking the cheapest, then least, list of edits first."""
    queue = [(0, "", 0, "", ())]
    while True:
        cost, audit, i, roles, lines = heapq.heappop(queue)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, "\n".join(lines)
        for role in ("user", "assistant"):
            heapq.heappush(queue, (cost + 5, audit + "I", i, roles + role[0], (*lines, f"{role}:"))) if whole(roles + role[0]) else None
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(queue, (cost + 2, audit + "D", i + 1, roles, lines))
            if fault in ("", "truncated"):
                late = 5 * (fault == "truncated")
                if role and whole(roles + role[0]):
                    heapq.heappush(queue, (cost + late, audit + "K", i + 1, roles + role[0], (*lines, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    if whole(roles + new[0]):
                        heapq.heappush(queue, (cost + 1 + late, audit + "R", i + 1, roles + new[0], (*lines, f"{new}:{text}")))


def whole(roles):
    return re.fullmatch("s?(ua)*u?", roles)


def plain(rows):
    convs = defaultdict(list)
    for r in rows:
        convs[r[0]]  # a conversation stays without rows
    for r in damage(rows):
        convs[r[0]].append(r)
    out = {}
    for conv, turns in convs.items():
        turns.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, marked = set(), []
        for _, _, role, text in turns:
            last = BLANK.findall(text)[-1:]
            marked.append((role, text, "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else ""))
            seen.add((role, text))
        known = [t[1] for t in turns if t[1] is not None]
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit, text = cheapest(marked)
        out[conv] = (max(known) - min(known) + 1 - len(set(known)) if known else 0, *(sum(m[2] == f for m in marked) for f in ("blank", "duplicate", "truncated")),
                     illegal, cost, audit, sha256(text.encode()).hexdigest())
    return out


def check(spark, rows):
    made = repair.repair(spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], SCHEMA)).collect()
    got = {r["conv_id"]: tuple(r[1:]) for r in made}
    assert len(got) == len(made)
    assert got == plain(rows)


def test_random_conversations(spark):
    r = random.Random(4)
    texts = ["Yes.", "No", "Why?", "", " \t", None, "Line\nend!  ", "été ?", "stop. \n", "a. b"]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "User", "", None, "s", "unit"]
    rows = []
    for conv in range(260):
        turn = r.choice([0, 5, -3])
        for _ in range(r.randint(1, 6)):
            rows.append((conv if conv else None, r.choice([turn, turn, turn, None]), r.choice(roles), r.choice(texts)))
            turn += r.choice([0, 1, 1, 1, 2])
    check(spark, rows)


def test_proper_conversations(spark):
    rows = [(c, t, ("system" if t == 0 and c % 4 == 0 else "user" if (t + (c % 4 == 0)) % 2 == 0 else "assistant"), f"Row {t} of {c}.") for c in range(150) for t in range(2 + c % 5)]
    check(spark, rows)


def test_no_rows(spark):
    assert repair.repair(spark.createDataFrame([], SCHEMA)).collect() == []


def test_conversation_without_rows_after_damage(spark):
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = repair.repair(spark.createDataFrame([(lost, 0, "user", "Hi.", "x", 1, "y", "z")], SCHEMA)).first()
    assert tuple(got) == (lost, 0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())


def test_long_conversation(spark):
    """Far longer than a batch: the stream keeps its state from one to the next."""
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"Row {t}.") for t in range(25_000)]
    got = repair.repair(spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], SCHEMA)).first()
    after = damage(rows)
    fate = {t: zlib.crc32(f"1:{t}".encode()) % 20 for t in range(25_000)}
    assert got["gaps"] == max(t for t in fate if fate[t]) - min(t for t in fate if fate[t]) + 1 - sum(1 for t in fate if fate[t])
    assert got["blank"] == sum(k == 1 for k in fate.values()) and got["duplicate"] == sum(k == 3 for k in fate.values())
    assert len(got["audit"].replace("I", "")) == len(after)
    automaton, marks = repair.Automaton(), []
    for i, (_, t, role, text) in enumerate(after):
        gone = not text or (i and after[i - 1] == after[i])
        marks.append("x" if gone else role[0].upper() if text[-1] != "." else role[0])
    assert automaton.read("".join(marks)) == (got["cost"], got["audit"])


def test_shared_ends_change_nothing():
    r = random.Random(1)
    every = sorted({"".join(r.choice("suaoSUAOx") for _ in range(r.randint(0, 9))) for _ in range(2000)}, key=lambda s: s[::-1])
    shared = repair.Automaton()
    for s in every:
        assert shared.read(s) == repair.Automaton().read(s)
    assert len(shared.known) < 1500  # entries, not ends
