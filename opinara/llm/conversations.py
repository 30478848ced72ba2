"""Conversation structure repair: one integer minimum over a DAG decides edits, cost and audit at once.

The rows of a conversation, by turn, are repaired to an optional system turn and pairs of user and
assistant by keeping, re-roling, deleting and inserting rows. A path through the DAG of (row, state) is
weighed by one big integer: its high digits are the cost, its low digits, of a fixed width, are the
letters of the audit in their places, with zeros behind the end. So the ordinary integer minimum is the
cheapest path, and of equally cheap ones that whose audit is least in ASCII order.

A conversation may hold a third of all rows, so it is never gathered. Equal rows are counted before the
shuffle; rows are dealt by ranges of conversation, turn, role and the front of the text, so a long
conversation lies in many tasks; each task weighs blocks of `BLOCK_ROWS` rows from every state to every
state. Per conversation only those few integers meet, to choose the state between blocks; the texts
then stream past, a block at a time, to be edited.

Defined cases: null roles and texts are one space; null turns come first and do not count as turns; a
null conv_id is a conversation of its own; rows of one turn are ordered by role, then text; a role that
begins with none of s, u and a (an empty one too) cannot be kept; empty and very long texts are kept
whole; a conversation without rows has zeros, an empty audit and the hash of the empty text; extra
columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from decimal import Decimal
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.llm.common import BATCH_ROWS, give_back

BLOCK_ROWS = 128
BLOCK_CHARS = 500_000
FRONT = 64  # characters of a text that deal out rows of one turn and role
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2  # costs
TRUNCATED = 1  # more, for a truncated row that stays
_BITS = 3  # of a digit
_DIGIT = {"D": 1, "I": 2, "K": 3, "R": 4}  # in ASCII order; zero stands behind the end
_LETTER = {n: c for c, n in _DIGIT.items()}
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
STATES = range(4)
_AFTER = ({"s": _SYSTEM, "u": _USER}, {"u": _USER}, {"a": _ASSISTANT}, {"u": _USER})
_WANTED = (_USER, _USER, _ASSISTANT, _USER)  # the state after a re-roled or inserted row
_NAME = {_USER: "user", _ASSISTANT: "assistant"}
_ENDS = (_START, _ASSISTANT)
_LEGAL = ("su", "ua", "au")
_SPACE = " \t\n\v\f\r"


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage by crc32 of `conv_id:turn`; a dropped row has a null role.

    Of twenty remainders 0 drops the row, 1 empties its text, 2 removes its sentence ends, 3 repeats it
    and 4 makes it a user's.
    """
    def said(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = (F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(said("text"), ".!?", ""))
            .otherwise(said("text")))
    role = F.when(kind == 4, F.lit("user")).otherwise(said("role"))
    copies = F.when(kind == 3, 2).otherwise(1)
    return conversations.select("conv_id", "turn", F.when(kind != 0, role).alias("role"),
                                F.when(kind != 0, text).alias("text"), copies.alias("copies"))


@dataclass(frozen=True)
class Scale:
    """How weights of audits of at most so many letters are written."""

    width: int

    def edit(self, cost: int, letter: str) -> int:
        """What an edit adds to the weight of the path behind it, once that has made place for its letter."""
        return (cost << (_BITS * self.width)) + (_DIGIT[letter] << (_BITS * (self.width - 1)))

    def later(self, weight: int | None, places: int = 1) -> int | None:
        """The same cost with all letters so many places later; None, no path, stays None."""
        if weight is None:
            return None
        low = weight & ((1 << (_BITS * self.width)) - 1)
        return weight - low + (low >> (_BITS * places))


def _least(a: int | None, b: int | None) -> int | None:
    return b if a is None or (b is not None and b < a) else a


def inserted(own: list[int | None], scale: Scale) -> list[int | None]:
    """The least weights from each state when rows may be inserted first; a third brings nothing new."""
    now, insert = own, scale.edit(INSERT, "I")
    for _ in range(2):
        after = {s: scale.later(now[s]) for s in (_USER, _ASSISTANT)}
        after = {s: None if w is None else w + insert for s, w in after.items()}
        now = [_least(own[s], after[_WANTED[s]]) for s in STATES]
    return now


def weigh(rows: Sequence[tuple[str, str]], ends: list[int | None], scale: Scale) -> list[int | None]:
    """The least weight from each state over rows of (initial of the role, fault) to the ends given."""
    now, delete = ends, scale.edit(DELETE, "D")
    stay = {more: (scale.edit(REROLE + more, "R"), scale.edit(KEEP + more, "K")) for more in (0, TRUNCATED)}
    for initial, fault in reversed(rows):
        after = [scale.later(w) for w in now]
        own = [None if w is None else w + delete for w in after]
        if fault not in ("blank", "duplicate"):
            rerole, keep = stay[TRUNCATED if fault == "truncated" else 0]
            for s in STATES:
                if (w := after[_WANTED[s]]) is not None:
                    own[s] = _least(own[s], w + rerole)
                if initial in _AFTER[s] and (w := after[_AFTER[s][initial]]) is not None:
                    own[s] = _least(own[s], w + keep)
        now = inserted(own, scale)
    return now


def width_of(n_rows: int) -> int:
    """Digits enough for any audit of so many rows: two insertions at most before each and at the end."""
    return 3 * n_rows + 2


def letters(weight: int, width: int) -> str:
    """The audit that a weight's low digits spell."""
    out = []
    for place in range(width - 1, -1, -1):
        digit = (weight >> (_BITS * place)) & ((1 << _BITS) - 1)
        if not digit:
            break
        out.append(_LETTER[digit])
    return "".join(out)


def matrix(rows: Sequence[tuple[str, str]]) -> list[list[int | None]]:
    """For each end state the least weights of a block from every state."""
    scale = Scale(width_of(len(rows)))
    return [weigh(rows, [0 if s == t else None for s in STATES], scale) for t in STATES]


def edited(audit: str, state: int, rows: Sequence[tuple[str, str]]) -> tuple[list[tuple], int]:
    """(letter, role, text) of what stays and is inserted, and the state behind it."""
    out, at = [], 0
    for letter in audit:
        if letter == "D":
            at += 1
            continue
        role, text = ("", "") if letter == "I" else rows[at]
        if letter == "K":
            state = _AFTER[state][role[:1]]
        else:
            state = _WANTED[state]
            role = _NAME[state]
        at += letter != "I"
        out.append((letter, role, text))
    return out, state


@dataclass
class Block:
    """Rows of one conversation that follow each other, and what they add to its figures."""

    rows: list[tuple[str, str]] = field(default_factory=list)
    faults: list[str] = field(default_factory=list)
    turns: list[int] = field(default_factory=list)
    chars: int = 0

    def add(self, role: str, text: str, turn: int | None, fault: str) -> None:
        gone = fault in ("blank", "duplicate")
        self.rows.append((role, "" if gone else text))
        self.faults.append(fault)
        self.chars += 0 if gone else len(text)
        if turn is not None and (not self.turns or self.turns[-1] != turn):
            self.turns.append(turn)

    def figures(self) -> dict:
        initials = [r[:1] for r, _ in self.rows]
        pairs = zip(initials, initials[1:], strict=False)
        weights = matrix([(i, f) for i, f in zip(initials, self.faults, strict=True)])
        return {
            "n": len(self.rows), "blank": self.faults.count("blank"),
            "duplicate": self.faults.count("duplicate"), "truncated": self.faults.count("truncated"),
            "illegal": sum(a + b not in _LEGAL for a, b in pairs),
            "first": initials[0] if initials else None, "last": initials[-1] if initials else None,
            "low": self.turns[0] if self.turns else None, "high": self.turns[-1] if self.turns else None,
            "turns": len(self.turns),
            "weights": [None if w is None else w.to_bytes(w.bit_length() // 8 + 1, "big")
                        for row in weights for w in row],
        }


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
FIGURES = ("n int, blank int, duplicate int, truncated int, illegal int, first string, last string, "
           "low bigint, high bigint, turns int, weights array<binary>")
_ARROW_FIGURES = pa.struct([
    *((n, pa.int32()) for n in ("n", "blank", "duplicate", "truncated", "illegal")),
    ("first", pa.string()), ("last", pa.string()), ("low", pa.int64()), ("high", pa.int64()),
    ("turns", pa.int32()), ("weights", pa.list_(pa.binary()))])


def _fault(text: str, seen: bool) -> str:
    body = text.rstrip(_SPACE)
    if not body:
        return "blank"
    return "duplicate" if seen else "" if body[-1] in ".!?" else "truncated"


def _blocks(batches: Iterator[pa.RecordBatch], block_rows: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows to blocks, each as its figures (part 0) and as its roles and texts (part 1)."""
    task, held, size, block, conv, number = TaskContext.get().partitionId(), [], 0, None, None, 0

    def closed() -> None:
        nonlocal number, size
        held.append((conv, number, block))
        number, size = number + 1, size + block.chars + 200 * len(block.rows)

    def out() -> pa.RecordBatch:
        n, kind = len(held), conv_type
        return pa.RecordBatch.from_arrays([
            pa.array([c for c, _, _ in held] * 2, kind), pa.array([0] * n + [1] * n, pa.int32()),
            pa.array([task] * (2 * n), pa.int32()), pa.array([i for _, i, _ in held] * 2, pa.int64()),
            pa.array([b.figures() for _, _, b in held] + [None] * n, _ARROW_FIGURES),
            pa.array([None] * n + [[r for r, _ in b.rows] for _, _, b in held], pa.list_(pa.string())),
            pa.array([None] * n + [[t for _, t in b.rows] for _, _, b in held], pa.list_(pa.string())),
        ], ["conv_id", "part", "task", "number", "figures", "roles", "texts"])

    for batch in batches:
        conv_type = batch.schema.field("conv_id").type
        for row in zip(*(batch.column(c).to_pylist() for c in
                         ("conv_id", "turn", "role", "text", "copies", "earlier")), strict=True):
            key, turn, role, text, copies, earlier = row
            if block is None or key != conv:
                if block is not None:
                    closed()
                conv, block = key, Block()
            for copy in range(copies if role is not None else 0):
                if len(block.rows) >= block_rows or block.chars >= BLOCK_CHARS:
                    closed()
                    block = Block()
                block.add(role, text, turn, _fault(text, earlier or copy > 0))
            if size > 2 * BLOCK_CHARS:
                yield out()
                held, size = [], 0
    if block is not None:
        closed()
        yield out()
    give_back()


@dataclass
class Solution:
    """The figures of a conversation, and for each of its blocks the audit and the state before it."""

    figures: dict
    audits: list[str]
    states: list[int]
    tail: str


def solve(blocks: Sequence[dict]) -> Solution:
    """From the figures of its blocks, in order; only their weights meet here, no row and no text."""
    widths = [width_of(b["n"]) for b in blocks]
    weights = []
    for b in blocks:
        flat = [None if w is None else int.from_bytes(w, "big") for w in b["weights"]]
        weights.append([flat[i:i + len(STATES)] for i in range(0, len(flat), len(STATES))])
    width = sum(widths) + 2
    scale = Scale(width)
    now = inserted([0 if s in _ENDS else None for s in STATES], scale)
    tails, choices = list(now), []
    for own, ends in zip(reversed(widths), reversed(weights), strict=True):
        best, choice = [None] * 4, [0] * 4
        for s in STATES:
            for t in STATES:
                joined = _joined(ends[t][s], own, now[t], scale)
                if joined is not None and (best[s] is None or joined < best[s]):
                    best[s], choice[s] = joined, t
        now = best
        choices.append(choice)
    choices.reverse()
    state, states, audits = _START, [], []
    for own, ends, choice in zip(widths, weights, choices, strict=True):
        states.append(state)
        audits.append(letters(ends[choice[state]][state], own))
        state = choice[state]
    full = [b for b in blocks if b["n"]]
    turned = [b for b in blocks if b["turns"]]
    shared = sum(a["high"] == b["low"] for a, b in zip(turned, turned[1:], strict=False))
    figures = {k: sum(b[k] for b in blocks) for k in ("blank", "duplicate", "truncated", "illegal")}
    figures["illegal"] += sum(a["last"] + b["first"] not in _LEGAL
                              for a, b in zip(full, full[1:], strict=False))
    figures["gaps"] = (turned[-1]["high"] - turned[0]["low"] + 1 - sum(b["turns"] for b in turned) + shared
                       if turned else 0)
    figures["cost"] = now[_START] >> (_BITS * width)
    tail = letters(tails[state], width)
    figures["audit"] = "".join(audits) + tail
    return Solution(figures, audits, states, tail)


def _joined(block: int | None, own: int, rest: int | None, scale: Scale) -> int | None:
    """The weight of a block's path and then the rest: costs add up, the letters follow."""
    if block is None or rest is None:
        return None
    cost, digits = block >> (_BITS * own), block & ((1 << (_BITS * own)) - 1)
    used = own - ((digits & -digits).bit_length() - 1) // _BITS if digits else 0
    return ((cost << (_BITS * scale.width)) + (digits << (_BITS * (scale.width - own)))
            + scale.later(rest, used))


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, solution, rows that stay or are new, whether these are its last) for every block."""
    figures, solution, at = [], None, 0
    for batch in batches:
        for i in range(batch.num_rows):
            if batch.column(1)[i].as_py() == 0:  # figures: of the next conversation if texts came last
                figures, solution = [] if solution else figures, None
                figures.append(batch.column(2)[i].as_py())
                continue
            if solution is None:
                solution, at = solve(figures), 0
            rows = list(zip(batch.column(3)[i].as_py(), batch.column(4)[i].as_py(), strict=True))
            done, state = edited(solution.audits[at], solution.states[at], rows)
            at += 1
            last = at == len(solution.audits)
            yield batch.column(0)[i].as_py(), solution, done + (
                edited(solution.tail, state, [])[0] if last else []), last
    give_back()


def _dealt(rows: DataFrame, block_rows: int) -> DataFrame:
    """Blocks of all conversations, sorted within each: all figures of one, then its texts."""
    own = [F.col(c) for c in ("conv_id", "turn", "role", "text")]
    rows = rows if "copies" in rows.columns else rows.withColumn("copies", F.lit(1))
    plain = rows.select(F.col("conv_id"), F.when(F.col("role").isNotNull(), F.col("turn").cast("bigint")).alias("turn"),
                        "role", F.when(F.col("role").isNotNull(), F.col("text")).alias("text"), "copies")
    counted = plain.groupBy(*own).agg(F.sum("copies").cast("int").alias("copies")).withColumn(
        "body", F.md5(F.concat_ws("\u0001", F.octet_length("role").cast("string"), "role", "text").cast("binary")))
    place = F.coalesce(F.col("turn").cast("decimal(20,0)"), F.lit(Decimal(-(2**63) - 1)).cast("decimal(20,0)"))
    seen = counted.groupBy("conv_id", "body").agg(
        F.min(place).alias("first"), F.max(place).alias("last"), F.sum("copies").alias("all"))
    # The number of all copies only keeps both readers of the counted rows alike, so they share a shuffle.
    seen = seen.where((F.col("first") < F.col("last")) & (F.col("all") > 1)).select(
        F.col("conv_id").alias("_conv"), F.col("body").alias("_body"), "first")
    joined = counted.join(seen, F.col("conv_id").eqNullSafe(F.col("_conv"))
                          & (F.col("body") == F.col("_body")), "left")
    earlier = F.coalesce(F.col("first") < place, F.lit(False))
    faulty = joined.select(*own, "copies", earlier.alias("earlier"), F.substring("text", 1, FRONT).alias("front"))
    dealt = faulty.repartitionByRange("conv_id", "turn", "role", "front").sortWithinPartitions(
        "conv_id", "turn", "role", "text").drop("front")
    kind = dict(rows.dtypes)["conv_id"]
    blocks = dealt.mapInArrow(lambda b: _blocks(b, block_rows), f"conv_id {kind}, part int, task int, number bigint, "
                              f"figures struct<{FIGURES.replace(' ', ':').replace(',:', ',')}>, "
                              "roles array<string>, texts array<string>")
    return blocks.repartition("conv_id").sortWithinPartitions("conv_id", "part", "task", "number").select(
        "conv_id", "part", "figures", "roles", "texts")


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The repaired rows: conv_id, place (from 0), role, text, edit (K, R or I).

    rows: conv_id, turn, role, text, and copies where rows are repeated; a row with a null role only
    tells that its conversation exists.
    """
    kind = dict(rows.dtypes)["conv_id"]

    def run(batches):
        place = 0
        conv_type, batches = _typed(batches)
        for conv, _, done, last in _solved(batches):
            if done:
                yield pa.RecordBatch.from_arrays([
                    pa.array([conv] * len(done), conv_type),
                    pa.array(range(place, place + len(done)), pa.int64()),
                    *(pa.array([d[i] for d in done], pa.string()) for i in (1, 2, 0)),
                ], ["conv_id", "place", "role", "text", "edit"])
            place = 0 if last else place + len(done)

    return _dealt(rows, block_rows).mapInArrow(
        run, f"conv_id {kind}, place bigint, role string, text string, edit string")


def digests(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per conversation: its figures, the audit, and the hash of its repaired rows, which
    stream past; rows as for repair()."""
    kind = dict(rows.dtypes)["conv_id"]

    def run(batches):
        out, digest, between = [], hashlib.sha256(), ""
        conv_type, batches = _typed(batches)

        def flushed():
            kinds = [conv_type, *[pa.int64()] * len(COUNTS), pa.string(), pa.string()]
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, ["conv_id", *COUNTS, "audit", "repaired_sha256"])

        for conv, solution, done, last in _solved(batches):
            for _, role, text in done:
                digest.update(f"{between}{role}:{text}".encode("utf-8", "replace"))
                between = "\n"
            if last:
                f = solution.figures
                out.append((conv, *(f[c] for c in COUNTS), f["audit"], digest.hexdigest()))
                digest, between = hashlib.sha256(), ""
                if len(out) >= BATCH_ROWS or len(f["audit"]) > BLOCK_CHARS:
                    yield flushed()
        if out:
            yield flushed()

    return _dealt(rows, block_rows).mapInArrow(
        run, f"conv_id {kind}, {', '.join(c + ' bigint' for c in COUNTS)}, audit string, "
        "repaired_sha256 string")


def _typed(batches: Iterator[pa.RecordBatch]) -> tuple[pa.DataType, Iterator[pa.RecordBatch]]:
    """The type of conv_id and the same batches."""
    first = next(batches, None)
    if first is None:
        return pa.null(), iter(())
    return first.schema.field("conv_id").type, chain((first,), batches)
