r"""Repair of the turn structure of conversations by a run-length DP (operator 13).

A conversation is sound if the initials of its roles read ``(s?(ua)+)?`` and no
row is blank, repeated or cut short.  Edits, in any mixture: Keep (K) a row for
0, Rerole (R) it to user or assistant for 1, Delete (D) it for 2 (the only choice
for a blank or repeated row), Insert (I) an empty user or assistant row anywhere
for 5; a row cut short that stays adds 5.  The cheapest edits are wanted and, of
equally cheap ones, those whose initials in order are least in ASCII.

A row matters to the DP only by its symbol: its role's initial (s, u, a, other)
and its fault (none, cut short, must go).  Equal consecutive symbols are one run.
A symbol is a 4 x 4 matrix over (min, +) between the states of the pattern
(nothing yet, after s, after u, after a), insertions before the row included.
From a run's end to its start the costs to go are advanced by the powers
T, T^2, T^4, ... of its symbol, which are computed once and kept.  Then the choices
are unrolled forwards: at each row the least letter that the costs to go allow,
and since the state leaves only one role for an insertion or a new role, the
letters tell the repaired rows.  Costs to go inside a run come from the run's end
by the same powers, ``UNROLL`` rows at a time.

Two passes over Spark's sorted rows keep memory bounded.  The first carries no
texts: faults are found natively (repeats by a window over conversation and
digest, which spreads a hot conversation), and a task streams symbols; it holds a
conversation's runs and its audit, a byte a row.  The second streams the rows
with their audits and gives the repaired turns one by one.

Defined cases: a null role or text is one space (a null turn, too, in the key of
the damage); rows of one turn are ordered by the MD5 of role and text, equal ones
are rows of their own, of which the first is the original; a role without an
initial (an empty one) can't be kept; a null conv_id takes no part; a conversation
without rows has zeros and an empty audit; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeframe.sources.scratch import materialize, written_side

KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 1, 2, 5, 5
WHITE = " \t\n\x0b\x0c\r"
#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a.  The state after an s is 1; a user follows 0, 1 and 3, an assistant follows 2.
NEXT = (2, 2, 3, 2)
NEVER = 1 << 60
UNROLL = 1 << 12
FINE, SHORT, GONE = 0, 1, 2
ROLES = "sua"  # the code of any other initial is 3

Matrix = tuple[tuple[int, ...], ...]


def damage_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of the damaged conversations, for trials of the repair, and gone: the row was dropped (it stays, so that its conversation is known).

    crc32 of ``conv_id:turn`` modulo 20 decides: 0 drops the row, 1 empties its text, 2 takes its ``.!?`` out, 3 repeats it, 4 makes its role user.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    ).where("conv_id is not null")
    kind = F.crc32(F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20
    rows = rows.withColumn("kind", kind)
    rows = rows.withColumn("text", F.when(F.col("kind") <= 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))).withColumn("gone", F.col("kind") == 0)
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", "role", "text", "gone", copies.alias("copy")).drop("copy")


def _digest(role: Column, text: Column) -> Column:
    """MD5 of role and text; the role's length keeps them apart."""
    return F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))


def _symbols(turns: DataFrame) -> DataFrame:
    """The narrow rows of the first pass: conv_id, turn, digest, copy (0 for the first of equal rows), role (0 to 3), fault, gone, and whether the row is blank, repeated or cut short."""
    last = F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1))
    initial = F.substring("role", 1, 1)
    rows = turns.select(
        "conv_id", "turn", "gone",
        F.unhex(_digest(F.col("role"), F.col("text"))).alias("digest"),
        F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3).cast("byte").alias("role"),
        (last == "").alias("blank"), (~last.isin("", ".", "!", "?")).alias("short"),
    )
    seen = Window.partitionBy("conv_id", "digest", "gone").orderBy(F.asc_nulls_first("turn"))
    rows = rows.withColumn("copy", F.least(F.row_number().over(seen) - 1, F.lit(1)).cast("byte"))
    fault = F.when(F.col("gone"), 4).when(F.col("blank"), 1).when(F.col("copy") > 0, 2).when(F.col("short"), 3).otherwise(0)
    return rows.select("conv_id", "turn", "digest", "copy", "role", fault.cast("byte").alias("fault"))


# --- the DP over one conversation


def _times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(a[i][k] + b[k][j] for k in range(4)) for j in range(4)) for i in range(4))


def _insertions() -> Matrix:
    """Cheapest insertions (none, one or two) from state to state."""
    one = tuple(tuple(0 if i == j else INSERT if NEXT[i] == j else NEVER for j in range(4)) for i in range(4))
    return _times(one, _times(one, one))


INSERTIONS = _insertions()
#: Costs to go after the last row: insertions up to an accepting state (0 or 3).
AT_END = tuple(min(INSERTIONS[q][0], INSERTIONS[q][3]) for q in range(4))


def _moves(role: int, fault: int, state: int) -> Iterator[tuple[str, int, int]]:
    """Letter, cost and next state of each way to pass a row, least letter first."""
    yield "D", DELETE, state
    if fault != GONE:
        more = CUT_SHORT if fault == SHORT else 0
        if role == 0 and state == 0:
            yield "K", KEEP + more, 1
        elif role in (1, 2) and NEXT[state] == role + 1:
            yield "K", KEEP + more, NEXT[state]
        yield "R", REROLE + more, NEXT[state]


@lru_cache(maxsize=None)
def transition(symbol: int, power: int) -> Matrix:
    """Costs from state to state over 2**power rows of one symbol (role * 3 + fault); 12 symbols and 63 powers at most."""
    if power:
        half = transition(symbol, power - 1)
        return _times(half, half)
    row = [[NEVER] * 4 for _ in range(4)]
    for q in range(4):
        for _, cost, to in _moves(symbol // 3, symbol % 3, q):
            row[q][to] = min(row[q][to], cost)
    return _times(INSERTIONS, tuple(map(tuple, row)))


def _back(symbol: int, rows: int, costs: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to go before ``rows`` rows of one symbol, from those after them."""
    power = 0
    while rows:
        if rows & 1:
            costs = tuple(min(a + b for a, b in zip(line, costs)) for line in transition(symbol, power))
        rows, power = rows >> 1, power + 1
    return costs


def _unroll(symbol: int, rows: int, state: int, after: tuple[int, ...], out: list[str]) -> int:
    """Append the letters of ``rows`` rows of one symbol and return the state after them."""
    for done in range(0, rows, UNROLL):
        block = min(UNROLL, rows - done)
        togo = [_back(symbol, rows - done - block, after)]
        for _ in range(block):
            togo.append(_back(symbol, 1, togo[-1]))
        for left in range(block, 0, -1):
            here, there = togo[left], togo[left - 1]
            passed = False
            while not passed:
                ways = [*_moves(symbol // 3, symbol % 3, state)]
                best = next((w for w in ways if w[0] == "D" and w[1] + there[w[2]] == here[state]), None)
                if best is None and INSERT + here[NEXT[state]] == here[state]:
                    out.append("I")
                    state = NEXT[state]
                    continue
                letter, _, state = best or next(w for w in ways if w[0] != "D" and w[1] + there[w[2]] == here[state])
                out.append(letter)
                passed = True
    return state


@lru_cache(maxsize=1 << 16)
def _repair_short(runs: tuple[tuple[int, int], ...]) -> tuple[int, str]:
    return _repair(runs)


def _repair(runs: tuple[tuple[int, int], ...]) -> tuple[int, str]:
    after = [AT_END]
    for symbol, rows in reversed(runs):
        after.append(_back(symbol, rows, after[-1]))
    cost, state, out = after[-1][0], 0, []
    for i, (symbol, rows) in enumerate(runs):
        state = _unroll(symbol, rows, state, after[len(runs) - 1 - i], out)
    while state not in (0, 3):
        out.append("I")
        state = NEXT[state]
    return cost, "".join(out)


def repair_runs(runs: tuple[tuple[int, int], ...]) -> tuple[int, str]:
    """Cost and audit of one conversation given as runs (symbol, number of rows); short ones are remembered."""
    return _repair_short(runs) if len(runs) <= 32 else _repair(runs)


# --- the first pass

REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


class _Open:
    """What a task holds of the conversation that it streams."""

    def __init__(self, conv: int):
        self.conv, self.faults, self.illegal = conv, [0, 0, 0, 0], 0
        self.low = self.high = self.last_turn = self.last_role = None
        self.turns, self.runs = 0, []

    def add(self, turn: np.ndarray, null: np.ndarray, role: np.ndarray, fault: np.ndarray) -> None:
        """More rows in order; nulls stand first."""
        for k, n in zip(*(x.tolist() for x in np.unique(fault, return_counts=True))):
            self.faults[k] += n
        if not len(role):
            return
        before = role if self.last_role is None else np.concatenate([[self.last_role], role])
        a, b = before[:-1], before[1:]
        self.illegal += int((~(((a == 0) | (a == 2)) & (b == 1) | (a == 1) & (b == 2))).sum())
        self.last_role = int(role[-1])
        known = turn[~null]
        if len(known):
            self.low = int(known[0]) if self.low is None else self.low
            self.turns += 1 + int((known[1:] != known[:-1]).sum()) - (self.last_turn == int(known[0]))
            self.high = self.last_turn = int(known[-1])
        symbol = np.where((fault == 1) | (fault == 2), 9 + GONE, role.astype(np.int64) * 3 + (fault == 3))
        cut = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]]))
        for s, n in zip(symbol[cut].tolist(), np.diff(np.append(cut, len(symbol))).tolist()):
            if self.runs and self.runs[-1][0] == s:
                n += self.runs.pop()[1]
            self.runs.append((s, n))

    def close(self) -> tuple:
        cost, audit = repair_runs(tuple(self.runs))
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv, min(gaps, (1 << 63) - 1), *self.faults[1:], self.illegal, cost, audit)


def repair_report(turns: DataFrame) -> DataFrame:
    """One row for each conversation: its faults, the cost of its repair and the audit (the initials of the edits).

    ``turns`` holds conv_id, turn, role, text and, as ``damage_turns`` gives it, gone: rows that only make their conversation known.
    """
    if "gone" not in turns.columns:
        turns = turns.withColumn("gone", F.lit(False))
    rows = _symbols(turns).repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "digest", "copy").select("conv_id", "turn", "role", "fault")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())])
        done, letters, now = [], 0, None

        def give():
            nonlocal letters
            columns = list(zip(*done))
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
            done.clear()
            letters = 0
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("conv_id").to_numpy(zero_copy_only=False)
            null = batch.column("turn").is_null().to_numpy(zero_copy_only=False)
            turn = batch.column("turn").fill_null(0).to_numpy(zero_copy_only=False)
            role, fault = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("role", "fault"))
            edge = np.concatenate([[0], np.flatnonzero(conv[1:] != conv[:-1]) + 1, [len(conv)]]).tolist()
            for a, b in zip(edge[:-1], edge[1:]):
                if now is None or now.conv != conv[a]:
                    if now is not None:
                        done.append(now.close())
                        letters += len(done[-1][-1])
                        if len(done) >= 4096 or letters >= 1 << 20:
                            yield give()
                    now = _Open(int(conv[a]))
                there = fault[a:b] != 4
                now.add(turn[a:b][there], null[a:b][there], role[a:b][there], fault[a:b][there])
        if now is not None:
            done.append(now.close())
            yield give()

    return rows.mapInArrow(run, REPORT)


# --- the second pass


def repaired_turns(turns: DataFrame, report: DataFrame) -> DataFrame:
    """conv_id, place (from 0), edit, role and text of every row of the repaired conversations; a partition holds whole conversations, in order.

    ``report`` is what ``repair_report`` gave for the same rows.
    """
    if "gone" in turns.columns:
        turns = turns.where("not gone")
    rows = turns.select("conv_id", F.lit(1).alias("kind"), "turn", F.unhex(_digest(F.col("role"), F.col("text"))).alias("digest"), "role", "text", F.lit(None).cast("string").alias("audit"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("digest", "binary"), ("role", "string"), ("text", "string"))]
    audits = report.where("audit != ''").select("conv_id", F.lit(0).alias("kind"), *none, "audit")
    both = rows.unionByName(audits).repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.asc_nulls_first("turn"), "digest").select("conv_id", "role", "text", "audit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
        conv, audit, at, place, state, out, size = None, "", 0, 0, 0, [], 0

        def emit(edit, role, text):
            nonlocal place, size
            out.append((conv, place, edit, role, text))
            place += 1
            size += len(text) + 64

        def insert():
            """Insertions before the next row."""
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                state = NEXT[state]
                emit("I", "user" if state == 2 else "assistant", "")
                at += 1

        def give():
            nonlocal size
            got = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out.clear()
            size = 0
            return got

        for batch in batches:
            for c, role, text, letters in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "role", "text", "audit"))):
                if letters is not None:
                    conv, audit, at, place, state = c, letters, 0, 0, 0
                    insert()
                    continue
                edit = audit[at]
                at += 1
                if edit == "R":
                    state = NEXT[state]
                    emit("R", "user" if state == 2 else "assistant", text)
                elif edit == "K":
                    state = 1 if role[:1] == "s" else NEXT[state]
                    emit("K", role, text)
                insert()
                if size >= 1 << 20:
                    yield give()
        if out:
            yield give()

    return both.mapInArrow(run, "conv_id long, place long, edit string, role string, text string")


def turn_digests(repaired: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of its rows ``role:text``, joined by line feeds, of rows that come whole and in order (``repaired_turns``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen, done = None, None, []

        def give():
            got = pa.RecordBatch.from_pydict({"conv_id": pa.array([c for c, _ in done], pa.int64()), "repaired_sha256": pa.array([d for _, d in done], pa.string())})
            done.clear()
            return got

        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in ("conv_id", "role", "text")))
            for conv, part in groupby(rows, key=lambda r: r[0]):
                body = "\n".join(f"{role}:{text}" for _, role, text in part).encode()
                if conv != now:
                    if seen is not None:
                        done.append((now, seen.hexdigest()))
                    now, seen = conv, hashlib.sha256(body)
                else:
                    seen.update(b"\n" + body)
            if len(done) >= 4096:
                yield give()
        if seen is not None:
            done.append((now, seen.hexdigest()))
        if done:
            yield give()

    return repaired.select("conv_id", "role", "text").mapInArrow(run, "conv_id long, repaired_sha256 string")


def repair_conversations(turns: DataFrame) -> DataFrame:
    """The report of each conversation with the digest of its repaired rows."""
    report = materialize(repair_report(turns), "repair-report")
    digests = written_side(turn_digests(repaired_turns(turns, report)), "repair-digests", 1 << 20, F.lit(9))
    empty = hashlib.sha256(b"").hexdigest()
    return report.join(digests, "conv_id", "left").withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(empty)))
