"""Conversation repair against a plain recursion over all edits."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest

from hyrank.llm import repair
from test_llm_operators import folder, rows

TURNS = "conv_id long, turn long, role string, text string"


def plain_best(rows):
    """(cost, audit, repaired lines) of rows (role, text, must go, truncated)."""
    nxt = {0: 2, 1: 2, 2: 3, 3: 2}

    @lru_cache(None)
    def best(i, state, inserted):
        found = [(0, "")] if i == len(rows) and state in (0, 3) else []
        if inserted < 2:
            c, a = best(i, nxt[state], inserted + 1)
            found.append((c + 5, "I" + a))
        if i < len(rows):
            role, _, gone, short = rows[i]
            c, a = best(i + 1, state, 0)
            found.append((c + 2, "D" + a))
            if not gone:
                keep = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((role[:1], state))
                for to, letter, cost in ((keep, "K", 0), (nxt[state], "R", 1)):
                    if to is not None:
                        c, a = best(i + 1, to, 0)
                        found.append((c + cost + 5 * short, letter + a))
        return min(found, default=(10 ** 9, ""))

    cost, audit = best(0, 0, 0)
    out, i = [], 0
    for e in audit:
        speaker = "user" if sum(not x.startswith("s") for x in out) % 2 == 0 else "assistant"
        if e == "I":
            out.append(f"{speaker}:")
            continue
        if e != "D":
            out.append(f"{rows[i][0] if e == 'K' else speaker}:{rows[i][1]}")
        i += 1
    return cost, audit, out


def plain(turns):
    """The contract of op13 in plain Python: {conv_id: row}."""
    sp = lambda v: " " if v is None else v
    groups = {c: [] for c, *_ in turns}
    for c, t, role, text in turns:
        lot, role, text = zlib.crc32(f"{sp(c)}:{sp(t)}".encode()) % 20, sp(role), sp(text)
        if lot:
            row = (t, "user" if lot == 4 else role, "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text)
            groups[c] += [row] * (2 if lot == 3 else 1)
    out = {}
    for c, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        seen, marked, faults = set(), [], [0, 0, 0]
        for _, role, text in own:
            marks = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = 0 if not marks else 1 if (role, text) in seen else 2 if marks[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                faults[fault] += 1
            marked.append((role, text, fault in (0, 1), fault == 2))
        cost, audit, lines = plain_best(tuple(marked))
        known = [t for t, *_ in own if t is not None]
        out[c] = {"conv_id": c, "gaps": max(known) - min(known) + 1 - len(set(known)) if known else 0, "blank": faults[0],
                  "duplicate": faults[1], "truncated": faults[2],
                  "illegal": sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:])),
                  "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}
    return out


def random_turns(rng, n):
    out = []
    for c in range(n):
        for t in range(rng.randrange(0, 12)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "usher", None])
            text = rng.choice(["Well.", "Yes!", "cut off", "", " \n", "Same?", "Straße é 😀.", "a.b", None, "Done. \t"])
            out.append((None if c == 3 else c, None if t == 0 and c % 5 == 0 else t * rng.choice([1, 1, 2]), role, text))
    # one row a (conversation, turn): the order of ties is this operator's own
    return list({(c, t): (c, t, r, x) for c, t, r, x in out}.values())


def test_matches_plain_edits(spark):
    rng = random.Random(3)
    turns = random_turns(rng, 400)
    turns += [(1000, 1, "user", "Hello."), (1001, 5, None, None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in turns], TURNS + ", code string, late int")
    got = rows(repair.op13(spark, folder(spark, conversations=df)))
    want = plain(turns)
    assert len(got) == len(want)
    for r in got:
        assert r == want[r["conv_id"]]
    assert {x for r in got for x in r["audit"]} == set("DKR")         # an insertion costs more than the deletion beside it


def test_empty_and_all_dropped(spark):
    none = folder(spark, conversations=spark.createDataFrame([], TURNS))
    assert repair.op13(spark, none).count() == 0
    turn = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    gone = folder(spark, conversations=spark.createDataFrame([(7, turn, "user", "Hi.")], TURNS))
    assert rows(repair.op13(spark, gone)) == [{"conv_id": 7, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0,
                                               "audit": "", "repaired_sha256": repair.EMPTY_SHA}]


def test_copies_in_one_turn_and_far_apart(spark):
    turns = [(1, 1, "user", "A."), (1, 1, "user", "A."), (1, 2, "assistant", "B."), (1, 9, "user", "A."), (1, 9, "user", "A.")]
    found, fixed = repair.repair(spark.createDataFrame(turns, TURNS))
    r = rows(found)[0]
    assert (r["duplicate"], r["cost"], r["audit"], r["gaps"]) == (3, 6, "KDKDD", 6)
    assert [(x["place"], x["edit"], x["role"], x["text"]) for x in sorted(rows(fixed), key=lambda x: x["place"])] == \
        [(0, "K", "user", "A."), (1, "K", "assistant", "B.")]


@pytest.mark.parametrize("size", [1, 7, 64])
def test_pieces_of_long_conversations(monkeypatch, size):
    rng = np.random.default_rng(size)
    codes = [rng.integers(0, 16, rng.integers(0, 200)).astype(np.uint8) for _ in range(60)]
    codes = [c & ~np.uint8(8) | np.where(c & 4, 0, c & 8).astype(np.uint8) for c in codes]
    whole = repair.audits(codes)
    monkeypatch.setattr(repair, "SEGMENT", size)
    cut = repair.audits(codes)
    assert whole[1] == cut[1] and (whole[0] == cut[0]).all()
    for c, cost, audit in zip(codes, *whole):
        plain_rows = tuple(("suax"[x & 3], "", bool(x & 4), bool(x & 8)) for x in c.tolist()) if len(c) < 150 else None
        if plain_rows is not None:
            assert plain_best(plain_rows)[:2] == (cost, audit)


def test_very_long_conversation():
    codes = np.tile(np.array([1, 2, 1, 1, 10], np.uint8), 40_000)
    cost, audit = repair.audits([codes])
    assert cost[0] == repair.costs(codes, np.array([0, len(codes)]), repair.END)[0, 0]
    assert len(audit[0].replace("I", "")) == len(codes)
    price = {"D": 2, "I": 5, "R": 1, "K": 0}
    at = spent = 0
    for e in audit[0]:
        spent += price[e]
        if e != "I":
            spent += 5 * (e != "D" and codes[at] >= 8)
            at += 1
    assert spent == cost[0]
