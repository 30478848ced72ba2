"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared in lower case with white space collapsed. An item of n characters may
differ from its place in a text by k = floor(ERROR_RATE * n) edits; it is split into k + 1 pieces,
of which at least one must then stand in the text unchanged. One automaton finds all exact piece
hits in a text; the surrounding of each hit is verified with Myers' bit-parallel distance.

The items are replicated to the tasks in blocks of bounded size, one pass over the texts for each
block, so that any number of items is handled.

Defined cases: null and empty texts match nothing; null and blank items are ignored; an item that
stands in a text several times is reported once for each place; repeated items and repeated rows
each give their own rows; very long texts are searched whole; extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm.common import give_back, map_batches, slices

ERROR_RATE = 0.08
BLOCK_CHARS = 4_000_000


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, rate: float) -> list[tuple[int, str]]:
    """(offset, piece) of the floor(rate * length) + 1 pieces of nearly equal length."""
    n = int(rate * len(item)) + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def distance(item: str, text: str, most: int) -> tuple[int, int] | None:
    """(least distance of the item to a part of text, end of that part), None if over most."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(item):
        masks[ch] = masks.get(ch, 0) | 1 << i
    top, full = 1 << len(item) - 1, (1 << len(item)) - 1
    up, down, now, best, end = full, 0, len(item), most + 1, 0
    for at, ch in enumerate(text):
        x = masks.get(ch, 0) | down
        d = ((up + (x & up)) ^ up) | x
        less, more = up & d, down | (full & ~(up | d))
        if more & top:
            now += 1
        elif less & top:
            now -= 1
            if now < best:
                best, end = now, at + 1
        more = (more << 1) & full
        up, down = ((less << 1) & full) | (full & ~(d | more)), d & more
        if now - (len(text) - at) >= best:
            break  # what is left cannot improve it
    return (best, end) if best <= most else None


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: Sequence[tuple[int, str]], rate: float):
        self.items = [(key, text) for key, text in ((k, normal(t)) for k, t in items) if text]
        self.budget = [int(rate * len(t)) for _, t in self.items]
        hits: dict[str, list[tuple[int, int]]] = {}
        for number, (_, text) in enumerate(self.items):
            for offset, piece in pieces(text, rate):
                hits.setdefault(piece, []).append((number, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in hits.items():
            self.automaton.add_word(piece, (len(piece), where))
        if hits:
            self.automaton.make_automaton()

    def find(self, raw: str | None) -> Iterator[tuple[int, int, int, int]]:
        """(item number, start, end, distance) in the normalised text, without overlaps."""
        text = normal(raw)
        if not text or not self.items:
            return
        starts: dict[int, list[int]] = {}
        for end, (length, where) in self.automaton.iter(text):
            for number, offset in where:
                starts.setdefault(number, []).append(end + 1 - length - offset)
        for number, at in starts.items():
            item, k = self.items[number][1], self.budget[number]
            found: list[tuple[int, int, int]] = []
            for start in sorted(set(at)):
                if start >= 0 and text.startswith(item, start):
                    found.append((0, start, start + len(item)))
                    continue
                first = max(0, start - k)
                got = distance(item, text[first:max(0, start + len(item) + k)], k)
                if got:
                    cost, end = got[0], first + got[1]
                    # Where the part begins: the same distance read backwards from its end.
                    back = distance(item[::-1], text[first:end][::-1], cost)
                    found.append((cost, end - back[1], end))
            taken: list[tuple[int, int, int]] = []
            for cost, a, b in sorted(found):
                if all(b <= c or a >= d for _, c, d in taken):
                    taken.append((cost, a, b))
            yield from ((number, a, b, cost) for cost, a, b in sorted(taken, key=lambda x: x[1]))

    def any(self, raw: str | None) -> bool:
        return next(self.find(raw), None) is not None


def _blocks(items: DataFrame, key: str, text: str, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """All items, block by block; each block has about block_chars characters."""
    items = items.where(F.col(text).isNotNull())
    total = items.agg(F.coalesce(F.sum(F.length(text)), F.lit(0))).first()[0]
    n = -(-total // block_chars)
    place = F.pmod(F.xxhash64(text), F.lit(max(n, 1)))
    for i in range(n):
        got = items.where(place == i).select(F.col(key), F.col(text)).collect()
        yield sorted((tuple(r) for r in got), key=lambda r: (str(r[0]), r[1]))


def find(docs: DataFrame, items: DataFrame, keep: Sequence[str], text: str = "text",
         item_key: str = "item_id", item_text: str = "text", rate: float = ERROR_RATE,
         block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each place of an item: the columns in keep, item_id, start, end, distance,
    n_chars of the item. Places count in the normalised text."""
    names = [f"k{i}" for i in range(len(keep))]
    cols = [F.col(c).alias(n) for c, n in zip(keep, names, strict=True)]
    narrow = docs.select(*cols, F.col(text).cast("string").alias("t"))
    types = {f.name: f.dataType.simpleString() for f in narrow.schema}
    made = "item_id bigint, start bigint, end bigint, distance bigint, item_chars bigint"
    schema = ", ".join([*(f"{n} {types[n]}" for n in names), made])
    parts = []
    for block in _blocks(items, item_key, item_text, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def work(batch, shared=shared, made=[]):  # noqa: B006 - one matcher for a task's batches
            if not made:
                made.append(Matcher(shared.value, rate))
            m, rows, out = made[0], [], []
            for i, t in enumerate(batch["t"].to_pylist()):
                for number, a, b, cost in m.find(t):
                    rows.append(i)
                    out.append((m.items[number][0], a, b, cost, len(m.items[number][1])))
            if not rows:
                return None
            at = pa.array(rows)
            return pa.RecordBatch.from_arrays(
                [*(batch[n].take(at) for n in names),
                 *(pa.array(c, pa.int64()) for c in zip(*out, strict=True))],
                [*names, "item_id", "start", "end", "distance", "item_chars"])

        parts.append(map_batches(narrow, work, schema))
    done = parts[0] if parts else docs.sparkSession.createDataFrame([], schema)
    for part in parts[1:]:
        done = done.unionAll(part)
    return done.select(*(F.col(n).alias(c) for n, c in zip(names, keep, strict=True)),
                       "item_id", "start", "end", "distance", "item_chars")


def remove(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id",
           item_text: str = "text", rate: float = ERROR_RATE,
           block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs, all their columns unchanged, without those that hold an item."""
    at, schema = docs.columns.index(text), docs.schema
    for block in _blocks(items, item_key, item_text, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            m = Matcher(shared.value, rate)
            for batch in slices(batches):
                clean = np.array([not m.any(t) for t in batch.column(at).to_pylist()], bool)
                if clean.any():
                    yield batch.filter(pa.array(clean))
            give_back()

        docs = docs.mapInArrow(run, schema)
    return docs
