"""Conversation repair against dynamic programming over plain rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracegrain.llm import turns

STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NEXT = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
SCHEMA = "conv_id long, turn long, role string, text string, cost long, kind int, audit string, part int"


def cheapest(kinds, start=0, ends=(0, 3)):
    """(cost, audit) by a table over rows and places, whole strings compared."""
    now = {start: (0, "")}

    def inserted(states):
        for _ in range(3):
            for q, (c, a) in list(states.items()):
                to = NEXT[q][0]
                if to not in states or (c + 2, a + "I") < states[to]:
                    states[to] = (c + 2, a + "I")
        return states

    for k in range(0, len(kinds), 2):
        role, fault = kinds[k], kinds[k + 1]
        after = {}
        for q, (c, a) in inserted(now).items():
            options = [(q, c + 3, a + "D")]
            if fault != "2":
                late = fault == "1"
                if (q, role) in STEP:
                    options.append((STEP[q, role], c + late, a + "K"))
                options.append((NEXT[q][0], c + 2 + late, a + "R"))
            for to, cost, audit in options:
                after[to] = min(after.get(to, (1 << 60, "")), (cost, audit))
        now = after
    return min((v for q, v in inserted(now).items() if q in ends), default=None)


def plain(rows):
    """The audit row of one conversation, from its (turn, role, text)."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, kinds, numbers = set(), "", Counter()
    for _, role, text in rows:
        kept = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else ""
        seen.add((role, text))
        numbers[fault] += 1
        kinds += (role[:1] if role[:1] in ("s", "u", "a") else "-") + {"": "0", "truncated": "1"}.get(fault, "2")
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    known = [r[0] for r in rows if r[0] is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    cost, audit = cheapest(kinds)
    out, q, at = [], 0, 0
    for e in audit:
        if e == "I":
            q, name = NEXT[q]
            out.append((name, ""))
            continue
        _, role, text = rows[at]
        at += 1
        if e == "K":
            q = STEP[q, role[:1]]
            out.append((role, text))
        elif e == "R":
            q, name = NEXT[q]
            out.append((name, text))
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return (gaps, numbers["blank"], numbers["duplicate"], numbers["truncated"], illegal, cost, audit, sha), out


def conversations():
    rng = random.Random(4)
    rows = []

    def turn(c, t):
        role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "umpire"])
        text = rng.choice(["Good day.", "What?", "no stop", " \t", "", None, f"own {c} {t}.", f"own {c} {t}", "Zeile\nzwei! \n", "é"])
        rows.append((c, t, role, text))

    for c in range(60):
        for t in range(rng.randint(1, 9)):
            turn(c, rng.choice([t, t, t, None, t + 3]))
    for t in range(150):  # more than a block
        turn(100, t)
    for t in range(40):
        turn(None, t // 2)
    rows += [(200, 5, "user", "the same.")] * 90 + [(201, None, "user", f"{k}.") for k in range(30)]
    rows += [(300, t, ("user", "assistant")[t % 2], "x" * 3000 + ".") for t in range(600)]  # over a megabyte
    return [r + (1, 2, "x", 3) for r in rows]


@pytest.mark.parametrize("start,ends", [(0, (0, 3)), (1, (2,)), (2, (3,)), (3, (3,)), (0, (1,))])
def test_search_finds_the_cheapest_and_least(start, ends):
    rng = random.Random(11)
    for _ in range(300):
        kinds = "".join(rng.choice("sua-") + rng.choice("000012") for _ in range(rng.randint(0, 9)))
        assert turns.search(kinds, start, ends) == cheapest(kinds, start, ends), kinds


def test_blocks_give_the_answer_of_one_search():
    rng = random.Random(12)
    for n in (turns.BLOCK, turns.BLOCK + 1, 3 * turns.BLOCK + 5):
        for _ in range(4):
            kinds = "".join(rng.choice("uauas-") + rng.choice("00000012") for _ in range(n))
            assert turns.answer(kinds) == cheapest(kinds)
    assert turns.answer("") == (0, "") and turns.answer("u2" * 100) == (300, "D" * 100)


@pytest.mark.parametrize("parts", [1, 7])
def test_audit_of_every_conversation(spark, parts):
    rows = conversations()
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = spark.createDataFrame(rows, SCHEMA).repartition(3)
        got = {r.conv_id: tuple(r)[1:] for r in turns.audit(df, spark.createDataFrame([(c,) for c in (0, None, 777)], "conv_id long")).collect()}
        fixed = turns.repair(df).orderBy("conv_id", "place").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    for c in {r[0] for r in rows}:
        want, out = plain([r[1:4] for r in rows if r[0] == c])
        assert got.pop(c) == want, c
        assert [(r.role, r.text) for r in fixed if r.conv_id == c] == out
    assert got == {777: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_damage(spark):
    rows = [r for r in conversations() if r[0] is None or r[0] < 100] + [(500, t, "assistant", "One. Two!") + (1, 2, "x", 3) for t in range(300)]
    want = []
    for c, t, role, text, *_ in rows:
        shown = [" " if x is None else x for x in (c, t, role, text)]
        fate = zlib.crc32(f"{shown[0]}:{shown[1]}".encode()) % 20
        role, text = "user" if fate == 4 else shown[2], "" if fate == 1 else re.sub("[.!?]", "", shown[3]) if fate == 2 else shown[3]
        want += [(c, t, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    got = Counter(tuple(r) for r in turns.damage(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == Counter(want)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert turns.audit(turns.damage(empty), empty).collect() == [] and turns.repair(empty).collect() == []
    assert turns.faults(empty).select(F.count("*")).first()[0] == 0
