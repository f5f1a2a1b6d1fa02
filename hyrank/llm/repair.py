"""Repair of conversation structure by cheapest edits.

A conversation's roles must read ``(s?(ua)+)?`` by their initials: an optional
system turn, then user and assistant in turn, or nothing. Edits: Keep (0),
Rerole to user or assistant (1), Delete (2; required for blank and duplicate
rows), Insert an empty user or assistant turn anywhere (5). A truncated row
that stays costs 5 more.

1. Faults are found row by row in DataFrame functions. A duplicate is told by a grouped
   minimum of the turn for each (conversation, role, text), combined map-side, so a row
   repeated without end is one row a task; copies in one turn stand beside each other later.
2. The rows of a conversation, in order, become one byte each (initial and fault). The audit
   that the result carries has one letter a row, so these bytes are no larger than a result row;
   texts take no part.
3. Costs by dynamic programming over (rows done, state): 0 nothing yet, 1 after s, 2 after u,
   3 after a; 0 and 3 may end. All conversations of a batch run side by side in numpy.
4. Path ranking by prefix doubling over the nodes (rows done, state) and the arcs that reach the
   least cost. A node's rank by its first letter comes first; ranks by twice as many letters
   come from the pair (own rank, rank of the node that many letters on), and pointers double
   along. The arcs out of one node have different letters (the letter and the state give
   the next node), so one pointer a node is enough. The final ranks choose each node's arc; the
   doubled pointers of these arcs list the path from the start without walking it.
   Conversations of more than SEGMENT rows are ranked piece by piece: a piece's last costs
   are all it must know of what follows.
5. Rows and audits meet, each conversation sorted behind its audit, and stream through: what is kept
   is written out, role changed where the audit says so.

Order of rows: turn (null first), then role, then the hash of the text. A null conv_id is
one conversation of its own. Empty roles have no initial: such a row can only be reroled or
deleted. Null roles and texts count as one space. An empty table gives an empty result. Other
columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hyrank.llm.common import table
from hyrank.session import scratch_path

# Costs and edits, in ASCII order of the letters.
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
LETTERS = "DIKR"
SEGMENT = 1 << 15
BATCH_ROWS = 1 << 15

#: State after Keep by initial (s, u, a, other), after Rerole and Insert; -1: not allowed.
KEEP_TO = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1, -1, -1, -1]], np.int8)
NEXT_TO = np.array([2, 2, 3, 2], np.int8)
FAR = np.int64(1) << 60

BLANK = r"[^\x20\x09-\x0D]"
#: Code of a row: initial (0..3) + 4 x must go + 8 x truncated.
GONE_BIT, CUT_BIT = 4, 8

REPORT = ("conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, n_rows long")
FAULTS = ("blank", "duplicate", "truncated")


def last_mark(text: Column) -> Column:
    """The last character that is not white space ('' if there is none)."""
    return F.regexp_extract(text, r"(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)


def keyed(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, h): null roles and texts as one space; ``h`` orders and tells texts apart."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
                        F.concat(F.xxhash64(text).cast("string"), F.lit(":"), F.crc32(text.cast("binary")).cast("string"),
                                 F.lit(":"), F.length(text).cast("string")).alias("h"))


def _codes(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, h, code, late) of keyed rows; ``late``: the same role and text has an earlier turn."""
    group = rows.groupBy("conv_id", "role", "h").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("turn")).alias("_first"))
    again = group.where("_n > 1").select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("h").alias("_h"), "_first")
    both = rows.join(again, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("h") == F.col("_h")), "left")
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    mark = last_mark(F.col("text"))
    late = F.col("_first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("_first.turn"))
    code = kind + F.when(mark == "", GONE_BIT).otherwise(0) + F.when(F.instr(F.lit(".!?"), mark) == 0, CUT_BIT).otherwise(0)
    return both.select("conv_id", "turn", "role", "h", code.cast("int").alias("code"), late.alias("late"))


# ---------------------------------------------------------------- costs and paths

def _row_costs(code: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs to the end by Delete, Keep and Rerole of one row of each of m conversations: three (m, 4) arrays.

    ``after``: (m, 4) costs behind the row.
    """
    m = np.arange(len(code))[:, None]
    extra = np.where(code & CUT_BIT, TRUNCATED, 0)[:, None]
    goes = ((code & GONE_BIT) > 0)[:, None]
    to = KEEP_TO[code & 3]
    keep = np.where((to < 0) | goes, FAR, after[m, np.maximum(to, 0)] + extra)
    rerole = np.where(goes, FAR, after[:, NEXT_TO] + REROLE + extra)
    return after + DELETE, keep, rerole


def _with_inserts(base: np.ndarray) -> np.ndarray:
    """Costs when turns may be inserted first: two in a row at most are ever useful."""
    one = np.minimum(base, base[:, NEXT_TO] + INSERT)
    return np.minimum(one, one[:, NEXT_TO] + INSERT)


END = _with_inserts(np.array([[0, FAR, FAR, 0]], np.int64))


def costs(codes: np.ndarray, off: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """Costs to the end from every node: conversation c's place i, state s at row off[c] + c + i."""
    n = np.diff(off)
    first = off[:-1] + np.arange(len(n))
    out = np.empty((int(off[-1]) + len(n), 4), np.int64)
    out[first + n] = behind
    order = np.argsort(-n, kind="stable")            # those that still have rows lead
    size = n[order]
    for back in range(1, int(n.max(initial=0)) + 1):
        at = order[:int(np.searchsorted(-size, -back, "right"))]
        place = n[at] - back
        d, k, r = _row_costs(codes[off[at] + place], out[first[at] + place + 1])
        out[first[at] + place] = _with_inserts(np.minimum(np.minimum(d, k), r))
    return out


def least_paths(codes: np.ndarray, off: np.ndarray, v: np.ndarray, start: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letters, edges, last state) of the ASCII-least cheapest path of each conversation, from state ``start``.

    ``v``: all costs; ``ends``: whether a conversation's last place is its end, where turns may still be inserted.
    Letters are 0..3 (places in LETTERS).
    """
    n = np.diff(off)
    first = off[:-1] + np.arange(len(n))
    rows = len(v)
    target = np.full((4, rows, 4), -1, np.int64)              # by letter: the node an arc that keeps the least cost leads to
    inner = np.ones(rows, bool)
    inner[first + n] = False
    at = np.flatnonzero(inner)
    d, k, r = _row_costs(codes, v[at + 1])
    states = np.arange(4)
    steps = ((0, d, np.broadcast_to(states, d.shape)), (2, k, np.maximum(KEEP_TO[codes & 3], 0)), (3, r, np.broadcast_to(NEXT_TO, r.shape)))
    for letter, cost, to in steps:
        target[letter, at] = np.where(cost == v[at], (at[:, None] + 1) * 4 + to, -1)
    may = inner.copy()
    may[(first + n)[ends]] = True
    insert = may[:, None] & (v[:, NEXT_TO] + INSERT == v)
    done = (first + n)[ends]
    insert[done[:, None], np.array([0, 3])] = False            # a path that may end ends: the shorter one is less
    target[1] = np.where(insert, np.arange(rows)[:, None] * 4 + NEXT_TO, -1)
    target = target.reshape(4, rows * 4)

    node = np.arange(rows * 4)
    has = target >= 0
    letter = np.where(has.any(axis=0), has.argmax(axis=0), -1)
    pointer = np.where(letter >= 0, target[np.maximum(letter, 0), node], node)
    rank = letter + 1                                          # by one letter; 0: nothing follows
    reach = 1
    while reach < 2 * int(n.max(initial=0)) + 4:                # no path has more letters: at most one insert before each row and two at the end
        rank = np.unique(rank * np.int64(rows * 4 + 5) + rank[pointer], return_inverse=True)[1]
        pointer = pointer[pointer]
        reach *= 2
    # the final ranks choose: least letter first, then the least of what follows
    value = np.where(has, np.arange(4)[:, None] * np.int64(rows * 4 + 5) + rank[np.maximum(target, 0)], FAR)
    best = value.argmin(axis=0)
    moves = has.any(axis=0)
    step = np.where(moves, target[best, node], node)
    length = moves.astype(np.int64)                            # letters up to the end of the path
    powers = [step]
    while True:
        longer = length + length[powers[-1]]
        if np.array_equal(longer, length):
            break
        length = longer
        powers.append(powers[-1][powers[-1]])
    begin = first * 4 + start
    count = length[begin]
    edge = np.concatenate([[0], np.cumsum(count)])
    walk = np.repeat(begin, count)
    t = np.arange(int(edge[-1])) - np.repeat(edge[:-1], count)
    for bit, jump in enumerate(powers):
        walk = np.where(t >> bit & 1, jump[walk], walk)
    last = begin
    for bit, jump in enumerate(powers):
        last = np.where(count >> bit & 1, jump[last], last)
    return best[walk], edge, last % 4


def audits(codes: list[np.ndarray]) -> tuple[np.ndarray, list[str]]:
    """(cost, audit) of each conversation, given the codes of its rows."""
    cost, found = np.zeros(len(codes), np.int64), [""] * len(codes)
    names = np.frombuffer(LETTERS.encode(), np.uint8)
    long = [i for i, c in enumerate(codes) if len(c) > SEGMENT]
    short = [i for i, c in enumerate(codes) if len(c) <= SEGMENT]
    if short:
        off = np.concatenate([[0], np.cumsum([len(codes[i]) for i in short])]).astype(np.int64)
        flat = np.concatenate([codes[i] for i in short])
        v = costs(flat, off, np.repeat(END, len(short), axis=0))
        letters, edge, _ = least_paths(flat, off, v, np.zeros(len(short), np.int64), np.ones(len(short), bool))
        text = names[letters].tobytes().decode()
        for j, i in enumerate(short):
            cost[i], found[i] = v[off[j] + j, 0], text[edge[j]:edge[j + 1]]
    for i in long:
        c = codes[i]
        cuts = np.append(np.arange(0, len(c), SEGMENT), len(c))
        behind = [END]                                         # of every piece, from the last to the first
        for lo, hi in zip(cuts[-2::-1], cuts[:0:-1]):
            behind.append(costs(c[lo:hi], np.array([0, hi - lo]), behind[-1])[:1])
        cost[i], state, parts = behind[-1][0, 0], 0, []
        for lo, hi, after in zip(cuts[:-1], cuts[1:], behind[-2::-1]):
            own = np.array([0, hi - lo])
            letters, _, last = least_paths(c[lo:hi], own, costs(c[lo:hi], own, after), np.array([state]), np.array([hi == len(c)]))
            parts.append(names[letters].tobytes())
            state = int(last[0])
        found[i] = b"".join(parts).decode()
    return cost, found


# ---------------------------------------------------------------- Spark jobs

def reports(rows: DataFrame) -> DataFrame:
    """One row (schema REPORT) for each conversation of ``keyed`` rows."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    src = _codes(rows).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "h")

    class State:
        """What is known of the conversation that streams by: a byte a row and a few numbers."""

        def __init__(self, conv):
            self.conv, self.codes, self.last = conv, bytearray(), None
            self.low = self.high = self.turn = None
            self.turns, self.faults, self.illegal = 0, [0, 0, 0], 0

        def add(self, turn, role, h, code, late):
            same = self.last == (turn, role, h)
            kind, blank, cut_off = code & 3, code & GONE_BIT, code & CUT_BIT
            again = late or same
            for f, is_fault in enumerate((blank, again, cut_off)):
                if is_fault:
                    self.faults[f] += 1
                    break
            if self.codes and (self.codes[-1] & 3, kind) not in ((0, 1), (1, 2), (2, 1)):
                self.illegal += 1
            self.codes.append(kind | (GONE_BIT if blank or again else 0) | (CUT_BIT if cut_off and not blank and not again else 0))
            if turn is not None and turn != self.turn:
                self.turns += 1
                self.low, self.high, self.turn = (turn if self.low is None else self.low), turn, turn
            self.last = (turn, role, h)

        def gaps(self):
            return 0 if self.low is None else self.high - self.low + 1 - self.turns

    def batch(done):
        cost, audit = audits([np.frombuffer(bytes(s.codes), np.uint8) for s in done])
        columns = [[s.conv for s in done], [s.gaps() for s in done], *([s.faults[f] for s in done] for f in range(3)),
                   [s.illegal for s in done], cost, audit, [len(s.codes) for s in done]]
        return pa.RecordBatch.from_pydict({name.split()[0]: pa.array(c, conv_type if i == 0 else None)
                                           for i, (name, c) in enumerate(zip(REPORT.split(", "), columns))})

    conv_type = None

    def run(batches):
        nonlocal conv_type
        now, done, size = None, [], 0
        for b in batches:
            conv_type = b.schema.field("conv_id").type
            for row in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "h", "code", "late"))):
                if now is None or row[0] != now.conv:
                    if now is not None:
                        done.append(now)
                        size += len(now.codes) + 1
                        if size >= BATCH_ROWS:
                            yield batch(done)
                            done, size = [], 0
                    now = State(row[0])
                now.add(*row[1:])
        if now is not None:
            yield batch([*done, now])

    return src.mapInArrow(run, REPORT.format(kind=kind))


REPAIRED = "conv_id {kind}, place long, edit string, role string, text string"


def repaired_rows(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The conversations after their edits: rows (conv_id, place from 0, edit K, R or I, role, text), those
    of one conversation in one partition, in order. Deleted rows are left out."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    none = F.lit(None)
    first = found.select("conv_id", F.lit(0).alias("side"), none.cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("h"),
                         F.col("audit").alias("text"))
    both = first.unionByName(rows.select("conv_id", F.lit(1).alias("side"), "turn", "role", "h", "text"))
    src = both.repartition("conv_id").sortWithinPartitions("conv_id", "side", "turn", "role", "h")

    def run(batches):
        audit, at, place, names, turn_of = "", 0, 0, ("user", "assistant"), 0
        conv = None
        for b in batches:
            out = []

            def inserts():
                nonlocal at, place, turn_of
                while at < len(audit) and audit[at] == "I":
                    out.append((conv, place, "I", names[turn_of], ""))
                    at, place, turn_of = at + 1, place + 1, 1 - turn_of

            for c, side, role, text in zip(*(b.column(x).to_pylist() for x in ("conv_id", "side", "role", "text"))):
                if side == 0:
                    conv, audit, at, place, turn_of = c, text, 0, 0, 0
                    continue
                inserts()
                edit = audit[at]
                at += 1
                if edit != "D":
                    system = place == 0 and edit == "K" and role[:1] == "s"
                    out.append((c, place, edit, role if edit == "K" else names[turn_of], text))
                    place += 1
                    turn_of = turn_of if system else 1 - turn_of
                if 0 < len(audit) - at <= 2 and audit[at:] in ("I", "II"):
                    inserts()                                  # behind the last row
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field("conv_id").type), pa.array(cols[1], pa.int64()),
                                              *(pa.array(x, pa.string()) for x in cols[2:])],
                                             names=["conv_id", "place", "edit", "role", "text"])

    return src.mapInArrow(run, REPAIRED.format(kind=kind))


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of ``repaired_rows``; one row at a time, no conversation is held."""
    kind = repaired.schema["conv_id"].dataType.simpleString()

    def run(batches):
        now, state, conv_type = None, None, None
        for b in batches:
            conv_type = b.schema.field("conv_id").type
            done = []
            for c, place, role, text in zip(*(b.column(x).to_pylist() for x in ("conv_id", "place", "role", "text"))):
                if place == 0:
                    if state is not None:
                        done.append((now, state.hexdigest()))
                    now, state = c, hashlib.sha256()
                state.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            yield _hashed(done, conv_type)
        if state is not None:
            yield _hashed([(now, state.hexdigest())], conv_type)

    return repaired.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def _hashed(done, conv_type):
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], conv_type), pa.array([x for _, x in done], pa.string())],
                                      names=["conv_id", "repaired_sha256"])


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reports, repaired rows) of a table with conv_id, turn, role and text; see REPORT and REPAIRED."""
    spark = turns.sparkSession
    rows = keyed(turns)
    path = scratch_path(spark, "conversation-reports")
    reports(rows).write.parquet(path)
    found = spark.read.parquet(path)
    return found, repaired_rows(rows, found)


def damaged(turns: DataFrame) -> DataFrame:
    """The damage of the query: by crc32(conv_id:turn) % 20 a row is dropped (0), emptied (1), stripped of its
    sentence ends (2), repeated (3), made a user's (4) or left alone. Nulls in key, role and text: one space."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), word("role").alias("role"), word("text").alias("text"), lot.alias("_lot"))
    text = F.when(F.col("_lot") == 1, "").when(F.col("_lot") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_lot") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("_lot") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.where("_lot != 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def op13(spark, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found, rows = repair(damaged(turns))
    names = [c.split()[0] for c in REPORT.split(", ")][1:-1]
    hashes = digests(rows).select(F.col("conv_id").alias("_h"), "repaired_sha256")
    found = found.join(hashes, F.col("conv_id").eqNullSafe(F.col("_h")), "left").drop("_h")
    ids = turns.select(F.col("conv_id").alias("_id")).distinct()
    out = ids.join(found, F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    filled = [F.coalesce(n, F.lit("")).alias(n) if n == "audit" else F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in names]
    return out.select(F.col("_id").alias("conv_id"), *filled, F.coalesce("repaired_sha256", F.lit(EMPTY_SHA)).alias("repaired_sha256"))


def _oracle() -> str:
    """The query in SQL: costs and least audits from the last row to the first, as strings of cost and letters. (With these prices no
    turn is ever inserted, so a row's letter stands at the row's place.)"""
    def add(v: str, cost: str, letter: str) -> str:
        return f"lpad((substr({v}, 1, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || '{letter}' || substr({v}, 10)"

    nxt, keep = (2, 2, 3, 2), ("WHEN r = 's' THEN v[2] WHEN r = 'u' THEN v[3]", "WHEN r = 'u' THEN v[3]", "WHEN r = 'a' THEN v[4]", "WHEN r = 'u' THEN v[3]")
    stay = "(fault IS NULL OR fault = 2)"
    base = ", ".join(
        f"least({add(f'v[{s + 1}]', '2', 'D')}, CASE WHEN {stay} THEN {add(f'(CASE {keep[s]} END)', 'extra', 'K')} END, "
        f"CASE WHEN {stay} THEN {add(f'v[{nxt[s] + 1}]', '1 + extra', 'R')} END)" for s in range(4))
    inserted = ", ".join(f"least(b[{s + 1}], {add(f'b[{nxt[s] + 1}]', '5', 'I')})" for s in range(4))
    return rf"""
WITH RECURSIVE t AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
c AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda x: ascii(x)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, i: xor(x >> 1, 3988292384::BIGINT * (x & 1)))),
  4294967295::BIGINT) % 20 AS lot FROM t),
d AS (SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role,
  CASE lot WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM c, unnest(CASE WHEN lot = 3 THEN [0, 1] ELSE [0] END) AS u(copy) WHERE lot <> 0),
j AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS r,
  regexp_extract(text, '(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) AS mark FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM j),
f AS MATERIALIZED (SELECT *, CASE WHEN mark = '' THEN 0 WHEN again THEN 1 WHEN mark NOT IN ('.', '!', '?') THEN 2 END AS fault,
  CASE WHEN mark NOT IN ('', '.', '!', '?') AND NOT again THEN 5 ELSE 0 END AS extra,
  lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r AS pair FROM o),
p AS (SELECT conv_id, max(i) + 1 AS i, ['000000000', '000000010II', '000000005I', '000000000'] AS v FROM f GROUP BY conv_id
  UNION ALL SELECT conv_id, i, v FROM (
    SELECT conv_id, i, [{inserted.replace("b[", "w[")}] AS v FROM (
      SELECT conv_id, i, [{inserted}] AS w FROM (
        SELECT f.conv_id, f.i, [{base}] AS b FROM p JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i - 1)))),
a AS (SELECT conv_id, substr(v[1], 1, 9)::BIGINT AS cost, substr(v[1], 10) AS audit FROM p WHERE i = 1),
k AS (SELECT f.conv_id, f.role, f.text, f.r, f.i, substr(a.audit, f.i, 1) AS letter,
  row_number() OVER (PARTITION BY f.conv_id ORDER BY f.i) - 1 AS place FROM f JOIN a ON f.conv_id IS NOT DISTINCT FROM a.conv_id
  WHERE substr(a.audit, f.i, 1) <> 'D'),
s AS (SELECT *, max(CASE WHEN place = 0 AND letter = 'K' AND r = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS sys FROM k),
h AS (SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - sys) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || text,
  chr(10) ORDER BY place)) AS digest FROM s GROUP BY conv_id),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 0) AS blank,
  count(*) FILTER (fault = 1) AS duplicate, count(*) FILTER (fault = 2) AS truncated,
  count(*) FILTER (i > 1 AND coalesce(pair, '') NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT n.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
  coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) n LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM n.conv_id
  LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM n.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM n.conv_id
"""


ORACLE = _oracle()
