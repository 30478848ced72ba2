"""Substring dedup by prefix-partitioned suffix trees over words.

A passage of `window` words is repeated where it starts in several documents. The suffixes that
matter begin with such a passage; they are split by a prefix into groups that fit in memory, and in
each group the tree is refined level by level (1, 2, 4, ... words) down to the inner nodes at depth
`window`: suffixes under one such node share the passage, and overlapping nodes chain up to the
maximal repeats.

Choosing the groups. Every passage holds a word group of `GRAM` words with the least hash, its anchor,
and equal passages have equal anchors. (1) The anchors of each document are counted; only those in
two documents or more can belong to a repeat, which leaves most of the corpus out before any text
is moved. (2) Suffixes are grouped by the anchor, and neighbouring suffixes with one anchor travel
as one piece of text. (3) An anchor whose different pieces hold more than `TREE_WORDS` words together gets the
longest prefix there is, the whole passage: then a group is a node of its own, and all that is asked of
it, the smallest and largest document, is an aggregate that never lists its suffixes. So no task holds more
than twice `TREE_WORDS` words of a tree. Equal pieces are merged in each task before the shuffle, keeping
the smallest and largest document, so a group of copies of any size arrives as a few rows; which
document a piece was cut from is joined back by the piece's digest.

Defined cases: null texts have no words; documents with fewer words than the window keep all; rows
with a null key keep all and do not count as a document; rows that repeat a key are one document,
which removes nothing from itself; long words and texts are used whole; all other columns pass
through `strip` unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm.common import WHOLE_BATCH, chunks, give_back, map_batches, mix, stored

WINDOW = 50
GRAM = 10
MOST_WINDOWS = 256
TREE_WORDS = 500_000


def _bytes(texts: list[str]) -> list[bytes]:
    return [t.encode("utf-8", "replace") for t in texts]


def word_hashes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, first byte, hash) of every word; bytes count in the texts joined by a newline."""
    x = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    inside = ~((x == 32) | ((x >= 9) & (x <= 13)))
    at = np.flatnonzero(inside & np.concatenate(([True], ~inside[:-1])))
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64)
    index = np.flatnonzero(inside)
    first = np.searchsorted(index, at)
    size = np.diff(np.append(first, len(index)))
    power = np.cumprod(np.full(int(size.max()), 0x9E3779B97F4A7C15, np.uint64))
    value = (x[index].astype(np.uint64) + np.uint64(1)) * power[np.arange(len(index)) - np.repeat(first, size)]
    ends = np.cumsum([len(r) + 1 for r in raw])
    return np.searchsorted(ends, at, "right"), at, mix(np.add.reduceat(value, first))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each word on."""
    if len(h) < n:
        return h[:0]
    out = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[j:j + len(out)]
    return mix(out)


def sliding_least(g: np.ndarray, n: int) -> np.ndarray:
    """The least of n neighbours from each place on."""
    size = 1
    while size * 2 <= n:
        g = np.minimum(g[:len(g) - size], g[size:])
        size *= 2
    return np.minimum(g[:len(g) - (n - size)], g[n - size:]) if n > size else g


def anchored_runs(raw: list[bytes], window: int):
    """Runs of neighbouring windows of one text with one anchor: arrays of text number, first window
    (in words of all texts), number of windows, anchor; and the arrays of the words."""
    owner, at, h = word_hashes(raw)
    gram = min(GRAM, window)
    if len(h) < window:
        none = np.zeros(0, np.int64)
        return (none, none, none, none), (owner, at, h)
    least = sliding_least(grams(h, gram), window - gram + 1)
    ok = owner[:len(least)] == owner[window - 1:]
    place = np.flatnonzero(ok)
    if not len(place):
        none = np.zeros(0, np.int64)
        return (none, none, none, none), (owner, at, h)
    whose, anchor = owner[place], least[place].view(np.int64)
    new = np.concatenate(([True], (np.diff(place) != 1) | (np.diff(whose) != 0) | (np.diff(anchor) != 0)))
    # Long runs (periodic texts) are cut, which keeps every window in its group.
    begin = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    new |= (np.arange(len(place)) - begin[run]) % MOST_WINDOWS == 0
    begin = np.flatnonzero(new)
    return (whose[begin], place[begin], np.diff(np.append(begin, len(place))), anchor[begin]), (owner, at, h)


def _digest(data: bytes) -> tuple[int, int]:
    d = xxhash.xxh128_digest(data)
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _pieces(texts: list[str | None], anchors, large, window: int):
    """(row, first word, windows, anchor, text of the piece) for the windows with a listed anchor; those
    of a large anchor one by one."""
    for first, part in chunks(texts):
        raw = _bytes(part)
        (whose, place, count, anchor), (owner, at, _) = anchored_runs(raw, window)
        if not len(whose):
            continue
        joined = b"\n".join(raw) + b"\n"
        starts = np.searchsorted(owner, np.arange(len(part)))
        ends = np.append(at[1:], len(joined))
        for w, p, n, a in zip(whose.tolist(), place.tolist(), count.tolist(), anchor.tolist(), strict=True):
            row = first + w
            if a in anchors[row]:
                own = p - int(starts[w])
                step = 1 if a in large[row] else n
                for i in range(0, n, step):
                    text = joined[at[p + i]:ends[p + i + step - 1 + window - 1]]
                    yield row, own + i, step, a, b" ".join(text.split())


def deep_nodes(ids: np.ndarray, depth: int) -> np.ndarray:
    """For every place, the number of the tree's node at the depth; ids: no two ends alike."""
    rank, size = np.unique(ids, return_inverse=True)[1].astype(np.int64), 1

    def pair(a, b):
        return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1].astype(np.int64)

    while size * 2 <= depth:
        rank, size = pair(rank[:len(rank) - size], rank[size:]), size * 2
    return pair(rank[:len(rank) - (depth - size)], rank[depth - size:]) if depth > size else rank


def subtree(rows: list[tuple[bytes, int, int]], window: int) -> Iterator[tuple]:
    """For each different piece: digest, smallest document, and the runs of windows that also start
    in a smaller one (offsets, lengths). rows: (text, smallest, largest document)."""
    seen: dict[bytes, list[int]] = {}
    for text, low, high in rows:
        own = seen.setdefault(text, [low, high])
        own[0], own[1] = min(own[0], low), max(own[1], high)
    words: dict[bytes, int] = {}
    ids, sizes = [], []
    for number, text in enumerate(seen):
        one = [words.setdefault(w, len(words)) for w in text.split(b" ")]
        ids += one
        ids.append(-1 - number)
        sizes.append(len(one) + 1)
    node = deep_nodes(np.array(ids, np.int64), window)
    sizes = np.array(sizes)
    first = np.cumsum(sizes) - sizes
    low = np.array([v[0] for v in seen.values()], np.int64)
    count = sizes - window  # windows of each piece, besides the mark at its end
    piece = np.repeat(np.arange(len(sizes)), count)
    place = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count) + first[piece]
    mine = node[place]
    least = np.full(int(mine.max(initial=0)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, mine, low[piece])
    earlier = least[mine] < low[piece]
    cuts = np.cumsum(count)
    for number, (text, (a, b)) in enumerate(seen.items()):
        hit = earlier[cuts[number] - count[number]:cuts[number]]
        if a != b or hit.any():
            step = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
            yield (*_digest(text), a, step[::2].tolist(), (step[1::2] - step[::2]).tolist())


def find_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW,
                 tree_words: int = TREE_WORDS) -> DataFrame:
    """doc, sign (hash of the text), spans: array of (first word, words) whose windows also start in
    a document with a smaller key; one row for each document with any."""
    rows = docs.select(F.col(key).cast("bigint").alias("doc"), F.xxhash64(text).alias("sign"),
                       F.col(text).cast("string").alias("t")).where("doc IS NOT NULL AND t IS NOT NULL")

    def anchors(batch):
        ids, out = batch["doc"].to_numpy(), [[], [], [], []]
        for first, part in chunks(batch["t"].to_pylist()):
            (whose, place, count, anchor), (_, _, h) = anchored_runs(_bytes(part), window)
            words = count + window - 1
            same = [xxhash.xxh64_intdigest(h[p:p + n]) for p, n in zip(place.tolist(), words.tolist(), strict=True)]
            for x, y in zip(out, (anchor, ids[first + whose], words, np.array(same, np.uint64).view(np.int64)),
                            strict=True):
                x.append(y)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["anchor", "doc", "words", "piece"])

    marked = map_batches(rows.select("doc", "t"), anchors, "anchor bigint, doc bigint, words bigint, piece bigint")
    found = stored(marked, "anchors")
    # Copies of a piece are merged before they meet, so they count once.
    pieces = found.groupBy("anchor", "piece").agg(F.min("doc").alias("a"), F.max("doc").alias("b"),
                                                  F.max("words").alias("words"))
    again = pieces.groupBy("anchor").agg(F.min("a").alias("a"), F.max("b").alias("b"),
                                         F.sum("words").alias("words")).where("a < b")
    marks = found.select("anchor", "doc").join(again.select("anchor", (F.col("words") > tree_words).alias("large")), "anchor")
    marks = marks.groupBy("doc").agg(
        F.collect_set("anchor").alias("anchors"),
        F.collect_set(F.when(F.col("large"), F.col("anchor"))).alias("large"))
    some = stored(rows.join(marks, "doc"), "repeating")

    def sets(batch):
        return [[set(x) for x in batch[c].to_pylist()] for c in ("anchors", "large")]

    def cut(batch):
        ids, merged = batch["doc"].to_pylist(), {}
        listed, large = sets(batch)
        small = [x - y for x, y in zip(listed, large, strict=True)]
        for row, _, _, route, piece in _pieces(batch["t"].to_pylist(), small, large, window):
            own = merged.setdefault((route, piece), [ids[row], ids[row]])
            own[0], own[1] = min(own[0], ids[row]), max(own[1], ids[row])
        if not merged:
            return None
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in merged], pa.int64()), pa.array([k[1] for k in merged], pa.binary()),
             pa.array([v[0] for v in merged.values()]), pa.array([v[1] for v in merged.values()])],
            ["route", "piece", "low", "high"])

    def whole(batch):
        ids, merged = batch["doc"].to_pylist(), {}
        large = sets(batch)[1]
        for row, _, _, _, piece in _pieces(batch["t"].to_pylist(), large, large, window):
            own = merged.setdefault(_digest(piece), [ids[row], ids[row]])
            own[0], own[1] = min(own[0], ids[row]), max(own[1], ids[row])
        if not merged:
            return None
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in merged]), pa.array([k[1] for k in merged]),
             pa.array([v[0] for v in merged.values()]), pa.array([v[1] for v in merged.values()])],
            ["s1", "s2", "low", "high"])

    groups = map_batches(some, cut, "route bigint, piece binary, low bigint, high bigint", WHOLE_BATCH)
    groups = groups.repartition("route").sortWithinPartitions("route")
    passages = map_batches(some.where(F.size("large") > 0), whole, "s1 bigint, s2 bigint, low bigint, high bigint",
                           WHOLE_BATCH)
    passages = passages.groupBy("s1", "s2").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    none = F.array().cast("array<int>")

    def trees(batches):
        held, words, last = [], 0, None

        def grow():
            out = list(zip(*subtree(held, window), strict=True))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()),
                     pa.array(out[3], pa.list_(pa.int32())), pa.array(out[4], pa.list_(pa.int32()))],
                    ["s1", "s2", "low", "offsets", "lengths"])

        for batch in batches:
            for route, *row in zip(*(batch[c].to_pylist() for c in ("route", "piece", "low", "high")),
                                   strict=True):
                if route != last and words >= tree_words:
                    yield from grow()
                    held, words = [], 0
                held.append(row)
                words += row[0].count(b" ") + 2
                last = route
        if held:
            yield from grow()
        give_back()

    nodes = groups.mapInArrow(
        trees, "s1 bigint, s2 bigint, low bigint, offsets array<int>, lengths array<int>")
    nodes = nodes.unionAll(passages.where("low < high").select(
        "s1", "s2", "low", none.alias("offsets"), none.alias("lengths")))

    def occurrences(batch):
        out = [(*_digest(piece), row, own, n)
               for row, own, n, _, piece in _pieces(batch["t"].to_pylist(), *sets(batch), window)]
        if not out:
            return None
        s1, s2, row, own, n = zip(*out, strict=True)
        at = pa.array(row, pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), batch["doc"].take(at), batch["sign"].take(at),
             pa.array(own, pa.int32()), pa.array(n, pa.int32())], ["s1", "s2", "doc", "sign", "own", "n"])

    where = map_batches(some, occurrences, "s1 bigint, s2 bigint, doc bigint, sign bigint, own int, n int")
    hit = where.join(nodes, ["s1", "s2"]).where("doc > low OR size(offsets) > 0")
    # A piece that stands in a smaller document goes whole, else the windows that do.
    span = F.when(F.col("doc") > F.col("low"), F.array(F.struct(
        F.col("own").alias("first"), (F.col("n") + window - 1).alias("words")))).otherwise(
        F.transform(F.arrays_zip("offsets", "lengths"), lambda x: F.struct(
            (F.col("own") + x["offsets"]).alias("first"), (x["lengths"] + window - 1).alias("words"))))
    return (hit.select("doc", "sign", span.alias("s")).groupBy("doc", "sign")
            .agg(F.flatten(F.collect_list("s")).alias("spans")))


def strip(docs: DataFrame, spans: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """All columns of docs, and after them kept_text (words left, joined by one space; null stays
    null), n_words and n_removed, which replace nothing."""
    keys = docs.withColumns({"__doc": F.col(key).cast("bigint"), "__sign": F.xxhash64(text)})
    joined = keys.join(spans.toDF("__doc", "__sign", "__spans"), ["__doc", "__sign"], "left")
    names = [f"k{i}" for i in range(len(docs.columns))]
    narrow = joined.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)),
                           F.col(text).cast("string").alias("t"), F.col("__spans").alias("s"))
    types = {f.name: f.dataType.simpleString() for f in narrow.schema}

    def work(batch):
        kept, n_words, n_removed = [], [], []
        for t, spans in zip(batch["t"].to_pylist(), batch["s"].to_pylist(), strict=True):
            words = (t or "").encode("utf-8", "replace").split()
            out, at = [], 0
            for x in sorted(spans or (), key=lambda s: s["first"]):
                out += words[at:x["first"]]
                at = max(at, x["first"] + x["words"])
            out += words[at:]
            kept.append(None if t is None else b" ".join(out).decode("utf-8", "replace"))
            n_words.append(len(words))
            n_removed.append(len(words) - len(out))
        return pa.RecordBatch.from_arrays(
            [*(batch[n] for n in names), pa.array(kept, pa.string()), pa.array(n_words, pa.int64()),
             pa.array(n_removed, pa.int64())], [*names, "kept_text", "n_words", "n_removed"])

    schema = ", ".join([*(f"{n} {types[n]}" for n in names),
                        "kept_text string, n_words bigint, n_removed bigint"])
    return map_batches(narrow, work, schema).select(
        *(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)),
        "kept_text", "n_words", "n_removed")


def oracle(table: str = "documents", window: int = WINDOW) -> str:
    """The same in DuckDB SQL, from all windows of all documents."""
    return f"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
               FROM {table}),
    p AS (SELECT doc_id, i, array_to_string(w[i:i + {window - 1}], ' ') AS s
          FROM (SELECT doc_id, w, unnest(range(1, len(w) - {window - 2})) AS i FROM d)),
    r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS low FROM p)
          WHERE low < doc_id),
    g AS (SELECT doc_id, list(DISTINCT q) AS gone
          FROM (SELECT doc_id, unnest(range(i, i + {window})) AS q FROM r) GROUP BY doc_id),
    k AS (SELECT d.doc_id, w, CASE WHEN gone IS NULL THEN w ELSE
            list_transform(list_filter(list_zip(w, range(1, len(w) + 1)),
                                       lambda x: NOT list_contains(gone, x[2])), lambda x: x[1]) END AS kept
          FROM d LEFT JOIN g USING (doc_id))
    SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - len(kept))::BIGINT AS n_removed,
           sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256
    FROM k"""
