import hashlib
import itertools
import random
import re
import zlib

import pytest

from passagework.llm.auction import ENDS, KEPT, NEXT, START, STATES, arcs, cheapest, crossing
from passagework.llm.repair import ROLE_OF, damage, repair_conversations, repair_digests

CODES = range(12)


def by_dynamic_program(codes, exits=ENDS, last=True, state=START):
    """Least (cost, letters) to each state, row by row."""
    best = {state: (0, "")}

    def insert():
        changed = True
        while changed:
            changed = False
            for q, (cost, letters) in list(best.items()):
                if NEXT[q] not in best or (cost + 2, letters + "I") < best[NEXT[q]]:
                    best[NEXT[q]] = (cost + 2, letters + "I")
                    changed = True

    for code in codes:
        insert()
        after = {}
        for q, (cost, letters) in best.items():
            for letter, more, t in arcs(code, q):
                after[t] = min(after.get(t, (10**9, "")), (cost + more, letters + letter))
        best = after
    if last:
        insert()
    return min((c + exits[q], s, q) for q, (c, s) in best.items() if exits[q] is not None)


def test_auction_finds_the_cheapest_and_least_way():
    for n in range(4):
        for codes in itertools.product(CODES, repeat=n):
            assert cheapest(bytes(codes), ENDS, True, (START,)) == [by_dynamic_program(codes)]
    rng = random.Random(1)
    for _ in range(150):
        codes = bytes(rng.choices(CODES, [rng.choice([1, 5, 10]) for _ in CODES], k=rng.randint(0, 40)))
        want = by_dynamic_program(codes)
        for block in (3, 7, 64):
            assert cheapest(codes, ENDS, True, (START,), block)[0] == want
        cut = rng.randint(0, len(codes))
        first, second = codes[:cut], codes[cut:]
        exits = tuple(row[0] for row in crossing(second, True, 5))
        costs = crossing(first, False, 5)[START]
        assert min(costs[t] + exits[t] for t in range(STATES) if costs[t] is not None) == want[0]
        way = cheapest(first, exits, False, (START,), 5)[0]
        rest = cheapest(second, ENDS, True, tuple(range(STATES)), 5)[way[2]]
        assert way[0] == want[0] and way[1] + rest[1] == want[1]


def plain_version(rows):
    held, out = {}, {}
    for conv, turn, role, text in rows:
        own = held.setdefault(conv, [])
        key, role, text = ":".join(" " if x is None else str(x) for x in (conv, turn)), " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(key.encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        if fault:
            own += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    for conv, own in held.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        seen, codes, faults = set(), [], [0, 0, 0]
        for _, role, text in own:
            said = text.rstrip(" \t\n\x0b\x0c\r")
            kind = 0 if not said else 1 if (role, text) in seen else 2 if said[-1] not in ".!?" else 3
            if kind < 3:
                faults[kind] += 1
            codes.append(max({"s": 0, "u": 1, "a": 2}.get(role[:1], 3), 0) + (8, 8, 4, 0)[kind])
            seen.add((role, text))
        turns = {x[0] for x in own if x[0] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit, _ = by_dynamic_program(codes)
        lines, state, at = [], START, 0
        for letter in audit:
            if letter == "K":
                state = KEPT[state][codes[at] & 3]
                lines.append(f"{own[at][1]}:{own[at][2]}")
            elif letter != "D":
                state = NEXT[state]
                lines.append(f"{ROLE_OF[state]}:{own[at][2] if letter == 'R' else ''}")
            at += letter != "I"
        out[conv] = (gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


SCHEMA = "conv_id long, turn long, role string, text string, conv string, part long, id long, place int, code string"


def hard_rows():
    rng = random.Random(2)
    roles = ["user", "assistant", "system", "tool", None, "", "user", "assistant"]
    texts = [None, "", "a.", "b", "Hi there! ", "ok?\n", "\t ", "été .", "x\ny.", "z" * 5_000 + "."]
    rows = []
    for conv in [None, 1, 2, 3, 4, 5, 6, 7]:
        for k in range(2_500 if conv == 3 else rng.randint(1, 9)):
            rows.append((conv, rng.choice([None, k, k, k // 2]), rng.choice(roles), rng.choice([*texts, f"x{k}."])))
    # One conversation and one turn that hold a third of all rows.
    return rows + [(8, 5, "user", "same.")] * 1_200 + [(9, k, "user" if k % 2 == 0 else "assistant", f"{k}.") for k in range(8)]


def test_repair_equals_the_plain_version(spark):
    rows = hard_rows()
    given = spark.createDataFrame([(*r, "c", 1, 2, 3, "d") for r in rows], SCHEMA).repartition(5)
    got = repair_digests(given, damage(given)).collect()
    want = plain_version(rows)
    assert len(got) == len(want) and {r.conv_id: tuple(r)[1:] for r in got} == want


def test_a_clean_conversation_stays(spark):
    rows = [(1, 0, "system", "s."), (1, 1, "user", "Q?"), (1, 2, "assistant", "A."), (2, 0, "user", "x"), (2, 2, "user", "y.")]
    made = repair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    told = {r.conv_id: r for r in made.conversations.collect()}
    assert told[1].audit == "KKK" and told[1].cost == 0 and told[2].gaps == 1 and told[2].truncated == 1 and told[2].illegal == 1
    turns = [(r.edit, r.role, r.text) for r in sorted(made.turns.collect(), key=lambda r: (r.conv_id, r.part, r.place))]
    assert turns[:3] == [("K", "system", "s."), ("K", "user", "Q?"), ("K", "assistant", "A.")] and turns[3][1:] in [("user", "x"), ("user", "y.")]


@pytest.mark.parametrize("rows", [[], [(1, None, None, None)]])
def test_repair_of_nothing(spark, rows):
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    none = given.where("false")
    got = repair_digests(given, none).collect()
    assert [tuple(r) for r in got] == [(r[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in rows]
    assert repair_conversations(none).turns.count() == 0
