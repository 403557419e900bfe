"""Conversation repair against a plain search over all edits, whole and in pieces."""

import hashlib
import random
import re
import zlib

import pytest

from contactsheet.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, _h string, seg map<string,string>"


def plain(rows, start=0, ends=(0, 3)):
    """Least (cost, audit) by relaxing all states row by row, audits carried along."""
    steps, need = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}, {0: 2, 1: 2, 2: 3, 3: 2}

    def inserted(now):
        for _ in range(4):
            for s, (c, a) in list(now.items()):
                now[need[s]] = min(now.get(need[s], (9**9, "")), (c + 2, a + "I"))
        return now

    now = inserted({start: (0, "")})
    for r in rows:
        new = {}
        for s, (c, a) in now.items():
            ways = [(s, c + 3, a + "D")]
            if r != "-":
                t = r.isupper()
                ways.append((need[s], c + 2 + t, a + "R"))
                if s in steps.get(r.lower(), {}):
                    ways.append((steps[r.lower()][s], c + t, a + "K"))
            for t, c2, a2 in ways:
                new[t] = min(new.get(t, (9**9, "")), (c2, a2))
        now = inserted(new)
    return min((now[s] for s in ends if s in now), default=None)


def expected(rows):
    """The contract over (conv_id, turn, role, text) rows, read literally."""
    text = lambda x: " " if x is None else x
    convs = {}
    for conv, turn, role, said in rows:
        own = convs.setdefault(conv, [])
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, said = text(role), text(said)
        said = "" if k == 1 else re.sub("[.!?]", "", said) if k == 2 else said
        own += [(turn, "user" if k == 4 else role, said)] * (0 if k == 0 else 2 if k == 3 else 1)
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        faults, seen = [], set()
        for _, role, said in own:
            kept = re.sub(r"[\x20\x09-\x0D]", "", said)
            faults.append("b" if not kept else "d" if (role, said) in seen else "t" if kept[-1] not in ".!?" else ".")
            seen.add((role, said))
        initials = [r[1][:1] for r in own]
        line = "".join("-" if f in "bd" else (i if i in ("s", "u", "a") else "x").upper() if f == "t" else i if i in ("s", "u", "a") else "x" for i, f in zip(initials, faults))
        cost, audit = plain(line)
        lines, last, rest = [], "", list(own)
        for e in audit:
            new = "assistant" if last == "u" else "user"
            row = rest.pop(0) if e != "I" else (None, new, "")
            if e != "D":
                lines.append(f"{new if e == 'R' else row[1]}:{row[2]}")
                last = lines[-1][0]
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
        turns = {r[0] for r in own} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") or not a or not b for a, b in zip(initials, initials[1:]))
        out[conv] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def test_both_searches_meet_at_the_least_audit():
    rng = random.Random(4)
    for n in [*range(9), *range(9)] * 60:
        rows = "".join(rng.choice("suaxSUA-uaua") for _ in range(n))
        assert repair.cheapest(rows) == plain(rows), rows
        s, t = rng.randrange(4), rng.randrange(4)
        assert repair.cheapest(rows, s, (t,)) == plain(rows, s, (t,)), (rows, s, t)
    for n in (300, 2000):
        rows = "".join(rng.choice("suaxUA-uauauaua") for _ in range(n))
        assert repair.cheapest(rows) == plain(rows)
    assert repair.cheapest("", 0, (1,)) is None


def talk(rng, conv, n, odd=0.3):
    said = ["Yes.", "No!", "Is it?", "so it is", "", " \t", "é 1.2.", "x. ", None, "long " * 50 + "."]
    roles = ["system", "user", "assistant", "tool", "", None, "sub", "User"]
    for turn in range(n):
        role = rng.choice(roles) if rng.random() < odd else ("user", "assistant")[turn % 2]
        yield conv, None if rng.random() < 0.03 else turn * (2 if rng.random() < 0.1 else 1), role, rng.choice(said) if rng.random() < odd else f"Answer {rng.random()}."


def distinct_turns(rows):
    """Rows of one conversation and turn have no order that the contract fixes: one of them stays."""
    seen, out = set(), []
    for r in rows:
        if (r[0], r[1]) not in seen:
            seen.add((r[0], r[1]))
            out.append(r)
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_conversations_whole_and_in_pieces(spark, parts):
    rng = random.Random(parts)
    rows = [r for conv in range(60) for r in talk(rng, conv, rng.randrange(1, 9))]
    rows += [r for r in talk(rng, 1000, 700, 0.2)] + [r for r in talk(rng, None, 40)] + [(77, 5, "user", "only.")]
    rows = distinct_turns(rows)
    df = spark.createDataFrame([(*r, "mine", {"a": "b"}) for r in rows], SCHEMA)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = repair.repair(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = expected(rows)
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == want[r["conv_id"]], r["conv_id"]


def test_copies_of_rows_and_dropped_conversations(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    same = next(i for i in range(5000, 6000) if zlib.crc32(f"{i}:1".encode()) % 20 > 4)
    rows = [(gone, 0, "user", "x.")] + [(same, 1, "user", "Same.")] * 30
    got = {r["conv_id"]: r for r in repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)).collect()}
    assert tuple(got[gone])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert (got[same]["duplicate"], got[same]["cost"], got[same]["audit"]) == (29, 29 * 3 + 2, "K" + "D" * 29 + "I")
    assert repair.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
