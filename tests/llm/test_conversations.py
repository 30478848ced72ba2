"""Operator 12 against a search over all edits, and a plain reading of the damage."""

import hashlib
import heapq
import random
import zlib
from collections import defaultdict

import pytest

from opinara.llm import conversations as c
from opinara.llm import queries

SPACE = " \t\n\v\f\r"


def damage(rows):
    """{conv_id: damaged rows in order}"""
    out = defaultdict(list)
    said = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        kept, role, text = out[conv], said(role), said(text)
        kind = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        text = {1: "", 2: text.translate(str.maketrans("", "", ".!?"))}.get(kind, text)
        kept += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    for kept in out.values():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return out


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        body = text.strip(SPACE)
        out.append("blank" if not body else "duplicate" if (role, text) in seen
                   else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired rows), by a search in the order of cost and audit."""
    wrong = faults(rows)
    heap = [(0, "", 0, "", ())]  # cost, audit, row, initials so far, repaired rows
    done = set()
    while heap:
        cost, audit, i, state, kept = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            return cost, audit, list(kept)
        if (i, state) in done:
            continue
        done.add((i, state))
        wanted = "a" if state == "u" else "u"
        name = {"a": "assistant", "u": "user"}[wanted]
        heapq.heappush(heap, (cost + 2, audit + "I", i, wanted, (*kept, (name, ""))))
        if i == len(rows):
            continue
        _, role, text = rows[i]
        heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, kept))
        if wrong[i] not in ("blank", "duplicate"):
            more = wrong[i] == "truncated"
            heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, wanted, (*kept, (name, text))))
            if role[:1] == wanted or (state == "" and role[:1] == "s"):
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[:1], (*kept, (role, text))))
    raise AssertionError


def expected(rows):
    out = {}
    for conv, kept in damage(rows).items():
        wrong = faults(kept)
        turns = {t for t, _, _ in kept if t is not None}
        pairs = zip(kept, kept[1:], strict=False)
        cost, audit, repaired = cheapest(kept)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0,
                     *(wrong.count(f) for f in ("blank", "duplicate", "truncated")),
                     sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairs), cost, audit,
                     hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest())
    return out


def drawn(seed, n_convs, most):
    rng = random.Random(seed)
    rows = []
    for conv in range(n_convs):
        for turn in range(rng.randrange(1, most)):
            role = rng.choice(("user", "assistant", "user", "assistant", "system", "tool", "", None))
            text = rng.choice(("Yes.", "No!", "Why?", "well", "a b c.", "", " \t", None, f"t{turn}."))
            rows.append((conv, rng.choice((turn, turn, turn * 2, None)), role, text))
    return rows


def answered(spark, rows, block_rows=c.BLOCK_ROWS):
    """The query's rows for a table with extra columns of clashing names."""
    table = spark.createDataFrame([(*r, 1, "x", "y") for r in rows],
                                  "conv_id bigint, turn bigint, role string, text string, copies int, "
                                  "part string, figures string").repartition(5)
    got = c.digests(c.damaged(table), block_rows).collect()
    assert len(got) == len({r.conv_id for r in got})
    return {r.conv_id: tuple(r)[1:] for r in got}


@pytest.mark.parametrize("block_rows", [c.BLOCK_ROWS, 1, 3])
def test_same_as_a_search(spark, block_rows):
    rows = drawn(1, 150, 9)
    rows += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Ho."), (None, None, None, None)]
    assert answered(spark, rows, block_rows) == expected(rows)


def test_blocks_compose():
    """Blocks of any size give what one block gives."""
    rng = random.Random(3)
    for _ in range(60):
        rows = [(rng.choice("suax"), rng.choice(("", "", "blank", "truncated"))) for _ in range(rng.randrange(12))]
        found = set()
        for size in (1, 2, 5, 100):
            blocks = []
            for i in range(0, max(1, len(rows)), size):
                block = c.Block()
                for initial, fault in rows[i:i + size]:
                    block.add(initial, "t", None, fault)
                blocks.append(block.figures())
            solved = c.solve(blocks)
            found.add((solved.figures["cost"], solved.figures["audit"], solved.figures["illegal"]))
        assert len(found) == 1


def test_given_conversations(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet")
            .select("conv_id", "turn", "role", "text").collect()]
    got = queries.op12_conversation_repair(spark, sf)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                           "repaired_sha256"]
    assert {r.conv_id: tuple(r)[1:] for r in got.collect()} == expected(rows)


def test_one_long_conversation(spark):
    """Thousands of rows of one conversation, most of them equal or without a turn."""
    rng = random.Random(5)
    rows = [(7, i, rng.choice(("user", "assistant")), f"text {i}.") for i in range(3000)]
    rows += [(7, None, "user", "again")] * 2000 + [(7, i, "user", "same at many turns.") for i in range(1000)]
    rows += [(8, 0, "user", "x" * 1_500_000 + "."), (8, 1, "assistant", "y " * 700_000 + "?")]
    got = answered(spark, rows)
    want = expected(rows)
    assert got == want
    plain = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    repaired = c.repair(c.damaged(plain)).orderBy("conv_id", "place").collect()
    for conv in (7, 8):
        text = "\n".join(f"{r.role}:{r.text}" for r in repaired if r.conv_id == conv)
        assert hashlib.sha256(text.encode()).hexdigest() == want[conv][-1]
        assert [r.place for r in repaired if r.conv_id == conv] == list(range(
            sum(r.conv_id == conv for r in repaired)))


def test_empty(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    assert c.digests(c.damaged(spark.createDataFrame([], schema))).collect() == []
    assert c.repair(c.damaged(spark.createDataFrame([], schema))).collect() == []
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = answered(spark, [(dropped, 0, "user", "Hi.")])
    assert got == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
