"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

A public merge-type piece model is read from a file (its path is a parameter; nothing is trained).
A text is cut into runs that no piece crosses. In each run an agenda offers the adjacent pair whose
union is the best-ranked piece (the leftmost of equals); a keyed hash of seed, document key, number
of the run and place of the pair decides whether that merge is skipped. A skipped merge stays
skipped until a neighbour has grown, as a new pair. So a text has one segmentation under a seed,
another under another seed, and a word is segmented differently at its different places.

The agendas of all runs of a batch advance together: runs of one length are rows of an array, and
each round takes the best pair of every row. Runs of over `LONG` characters use a heap each.

Characters without a piece become their UTF-8 bytes, also the model's own blank sign where a text
holds it, so decoding gives every text back exactly; a space before the text is added and removed.

Defined cases: a null text has null ids and decodes to null; an empty text has no ids and decodes to
the empty text; very long texts and runs are encoded whole; equal texts under equal keys get equal
ids; extra columns are returned only when named in keep.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm.common import chunks, map_batches, mix

DROPOUT = 0.1
LONG = 32
_BLANK = 0x2581  # the model's sign for a space
_NEVER = 1 << 30
_PLACES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_WORKER: dict = {}


def skipped(base: np.ndarray, begin, middle, end, limit: int) -> np.ndarray:
    """Whether the merge of [begin, middle) and [middle, end) is skipped: a keyed hash below limit."""
    x = base.copy()
    for place, factor in zip((begin, middle, end), _PLACES, strict=True):
        x += place.astype(np.uint64) * factor
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)) < np.uint64(limit)


class Table:
    """Pairs of pieces and the pieces they make, as hash tables for whole arrays of pairs."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        self.keys = np.array([a << 32 | b for a, b in pairs] or [-1], np.int64)
        made = np.array(list(pairs.values()) or [(_NEVER, -1)], np.int64)
        self.level, self.piece = made[:, 0].astype(np.int32), made[:, 1].astype(np.int32)
        self.slots, left = [], np.arange(len(pairs))
        for bits in (20, 18, 16, 16, 16, 16, 16, 16):  # what collides in one goes into the next
            slots = np.full(1 << bits, -1, np.int32)
            at = self._hash(self.keys[left], len(self.slots), bits)
            slots[at] = left
            self.slots.append((bits, slots))
            left = left[slots[at] != left]
            if not len(left):
                break
        if len(left):
            raise ValueError("pieces do not fit the tables")

    @staticmethod
    def _hash(key: np.ndarray, number: int, bits: int) -> np.ndarray:
        factor = np.uint64((0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019 * 2 * number) % (1 << 64))
        return ((key.astype(np.uint64) * factor) >> np.uint64(64 - bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(level, piece) of each pair; level is never where they make no piece."""
        key = a.astype(np.int64) << 32 | b.astype(np.int64)
        key[(a < 0) | (b < 0)] = -2
        level, piece = np.full(len(key), _NEVER, np.int32), np.full(len(key), -1, np.int32)
        open_ = np.arange(len(key))
        for number, (bits, slots) in enumerate(self.slots):
            at = slots[self._hash(key[open_], number, bits)]
            taken = at >= 0
            open_, at = open_[taken], at[taken]
            hit = self.keys[at] == key[open_]
            level[open_[hit]], piece[open_[hit]] = self.level[at[hit]], self.piece[at[hit]]
            open_ = open_[~hit]
            if not len(open_):
                break
        return level, piece


class Pieces:
    """A merge-type piece model."""

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.byte_ids = np.full(256, -1, np.int32)
        bytes_of: list[bytes] = []
        scores: dict[str, tuple[float, int]] = {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                bytes_of.append(b"")
            else:
                piece = piece.replace(chr(_BLANK), " ")
                scores[piece] = (-sp.get_score(i), i)
                bytes_of.append(piece.encode())
        self.id = {p: i for p, (_, i) in scores.items()}
        self.char = np.full(0x110000, -1, np.int32)
        for p, i in self.id.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        # Better scores first; equal scores are one level, and then the leftmost pair goes first.
        levels = {s: n for n, s in enumerate(sorted({s for s, _ in scores.values()}))}
        self.level = {p: levels[s] for p, (s, _) in scores.items()}
        self.table = Table({(self.id[p[:k]], self.id[p[k:]]): (self.level[p], i)
                            for p, i in self.id.items() for k in range(1, len(p))
                            if p[:k] in self.id and p[k:] in self.id})
        # Runs: a blank begins one only if no piece holds a blank behind another character.
        self.whole = any(re.search(r"[^ ] ", p) or "\n" in p for p in self.id)
        sizes = np.array([len(x) for x in bytes_of])
        self.first, self.size = np.cumsum(sizes) - sizes, sizes
        self.blob = np.frombuffer(b"".join(bytes_of), np.uint8)

    def rows(self, codes: np.ndarray, base: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """For runs of one length (rows of code points): ids, and which places still begin a piece."""
        n, size = codes.shape
        ids, live = self.char[codes], np.ones((n, size), bool)
        if size == 1:
            return ids, live
        level, made = np.full((n, size), _NEVER, np.int32), np.full((n, size), -1, np.int32)
        found = self.table.find(ids[:, :-1].ravel(), ids[:, 1:].ravel())
        level[:, :-1], made[:, :-1] = (x.reshape(n, size - 1) for x in found)
        after = np.tile(np.arange(1, size + 1, dtype=np.int16), (n, 1))
        before = np.tile(np.arange(-1, size - 1, dtype=np.int16), (n, 1))
        row = np.arange(n)
        while True:
            i = level[row].argmin(1)
            go = level[row, i] < _NEVER
            row, i = row[go], i[go]
            if not len(row):
                return ids, live
            r, j = row, after[row, i]
            end = after[r, j]
            if limit:
                drop = skipped(base[r], i, j, end, limit)
                level[r[drop], i[drop]] = _NEVER
                r, i, j, end = r[~drop], i[~drop], j[~drop], end[~drop]
            ids[r, i] = made[r, i]
            live[r, j] = False
            level[r, j] = _NEVER
            level[r, i] = _NEVER
            after[r, i] = end
            more = end < size
            r1, i1, e1 = r[more], i[more], end[more]
            before[r1, e1] = i1
            level[r1, i1], made[r1, i1] = self.table.find(ids[r1, i1], ids[r1, e1])
            p = before[r, i]
            more = p >= 0
            r2, i2, p2 = r[more], i[more], p[more]
            level[r2, p2], made[r2, p2] = self.table.find(ids[r2, p2], ids[r2, i2])

    def agenda(self, codes: np.ndarray, base: int, limit: int) -> list[tuple[int, int]]:
        """(id, first code point) of the pieces of one run, with a heap of candidate merges."""
        run, n = "".join(map(chr, codes.tolist())), len(codes)
        end, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def offer(a: int, b: int):
            if a >= 0 and b < n and chr(_BLANK) not in run[a:end[b]]:
                level = self.level.get(run[a:end[b]])
                if level is not None:
                    heapq.heappush(heap, (level, a, b, end[b]))

        for a in range(n - 1):
            offer(a, a + 1)
        own = np.array([base], np.uint64)
        while heap:
            _, a, b, stop = heapq.heappop(heap)
            if end[a] != b or end[b] != stop:
                continue  # one side has grown or is gone
            if limit and skipped(own, np.array([a]), np.array([b]), np.array([stop]), limit)[0]:
                continue
            end[a], end[b] = stop, -1
            if stop < n:
                before[stop] = a
            offer(before[a], a)
            offer(a, stop)
        parts, a = [], 0
        while a < n:
            parts.append((-1 if codes[a] == _BLANK else self.id.get(run[a:end[a]], -1), int(codes[a])))
            a = end[a]
        return parts

    def encode(self, texts: Sequence[str], keys: Sequence[str], seed: int,
               dropout: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has). An empty text has none."""
        limit = int(dropout * (1 << 32))
        sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        codes = np.frombuffer("".join(" " + t for t in texts if t).encode("utf-32-le"), np.uint32)
        if not len(codes):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
        new = np.concatenate(([True], owner[1:] != owner[:-1]))
        mark = codes == _BLANK
        if not self.whole:
            space, line = codes == 32, codes == 10
            new[1:] |= (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
        new[1:] |= mark[1:] | mark[:-1]
        start = np.flatnonzero(new)
        length = np.diff(np.append(start, len(codes)))
        whose = owner[start]
        first = np.searchsorted(whose, np.arange(len(texts)))
        salt = np.array([xxhash.xxh64_intdigest(k.encode("utf-8", "replace"), seed) for k in keys], np.uint64)
        base = mix(salt[whose] + (np.arange(len(start)) - first[whose]).astype(np.uint64))
        # The pieces of every run, in groups of equal length, then put in the order of the runs.
        count, groups = np.zeros(len(start), np.int64), []
        order = np.argsort(length, kind="stable")
        edges = np.flatnonzero(np.diff(length[order], prepend=-1))
        for a, b in zip(edges, np.append(edges[1:], len(order)), strict=True):
            runs, size = order[a:b], int(length[order[a]])
            if size > LONG:
                for run in runs.tolist():
                    parts = self.agenda(codes[start[run]:start[run] + size], int(base[run]), limit)
                    count[run] = len(parts)
                    groups.append((np.array([run]), *map(np.array, zip(*parts, strict=True))))
                continue
            block = codes[start[runs][:, None] + np.arange(size)]
            ids, live = self.rows(block, base[runs], limit)
            ids[block == _BLANK] = -1
            count[runs] = live.sum(1)
            groups.append((runs, ids[live], block[live]))
        place = np.cumsum(count) - count
        out, code = np.empty(int(count.sum()), np.int32), np.empty(int(count.sum()), np.uint32)
        for runs, ids, firsts in groups:
            n = count[runs]
            at = np.arange(len(ids)) + np.repeat(place[runs] - (np.cumsum(n) - n), n)
            out[at], code[at] = ids, firsts
        whose = np.repeat(whose, count)
        if (out < 0).any():
            out, whose = self._as_bytes(out, code, whose)
        return out, np.bincount(whose, minlength=len(texts))

    def _as_bytes(self, ids, code, whose):
        """Characters without a piece as the pieces of their UTF-8 bytes."""
        size = np.where(ids >= 0, 1, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))
        at = np.cumsum(size) - size
        out = np.repeat(ids, size)
        for k in range(4):
            use = (ids < 0) & (size > k)
            rest = code[use] >> (6 * (size[use] - 1 - k)).astype(np.uint32)
            lead = np.array([0, 0, 0xC0, 0xE0, 0xF0], np.uint32)[size[use]]
            out[at[use] + k] = self.byte_ids[(rest | lead) if k == 0 else (rest & 63) | 0x80]
        return out, np.repeat(whose, size)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of consecutive stretches of ids."""
        size = self.size[ids]
        ends = np.cumsum(size)
        data = self.blob[np.arange(int(size.sum())) + np.repeat(self.first[ids] - (ends - size), size)].tobytes()
        cuts = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))].tolist()
        return [data[a + 1:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:], strict=False)]


def _pieces(model: bytes) -> Pieces:
    """The model of a worker process, kept between its tasks."""
    key = xxhash.xxh64_intdigest(model)
    if key not in _WORKER:
        _WORKER[key] = Pieces(model)
    return _WORKER[key]


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: bytes, keep: Sequence[str], text: str = "text", key: str = "doc_id",
           seed: int = 1, dropout: float = DROPOUT) -> DataFrame:
    """The columns in keep, and ids array<int>. dropout 0 gives the model's own segmentation."""
    names = [f"k{i}" for i in range(len(keep))]
    cols = [F.col(c).alias(n) for c, n in zip(keep, names, strict=True)]
    narrow = docs.select(*cols, F.col(text).cast("string").alias("t"),
                         F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"))
    types = {f.name: f.dataType.simpleString() for f in narrow.schema}
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch):
        pieces = _pieces(shared.value)
        keys, ids, counts = batch["key"].to_pylist(), [], []
        for first, part in chunks(batch["t"].to_pylist()):
            got, n = pieces.encode(part, keys[first:first + len(part)], seed, dropout)
            ids.append(got)
            counts.append(n)
        ends = np.concatenate(([0], np.cumsum(np.concatenate(counts)))).astype(np.int32)
        null = np.append(batch["t"].is_null().to_numpy(zero_copy_only=False), False)
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=null), pa.array(np.concatenate(ids)))
        return pa.RecordBatch.from_arrays([*(batch[c] for c in names), lists], [*names, "ids"])

    schema = ", ".join([*(f"{c} {types[c]}" for c in names), "ids array<int>"])
    done = map_batches(narrow, work, schema)
    return done.select(*(F.col(c).alias(k) for c, k in zip(names, keep, strict=True)), "ids")


def decode(encoded: DataFrame, model: bytes, keep: Sequence[str], ids: str = "ids") -> DataFrame:
    """The columns in keep, and the text that the ids stand for."""
    names = [f"k{i}" for i in range(len(keep))]
    cols = [F.col(c).alias(n) for c, n in zip(keep, names, strict=True)]
    narrow = encoded.select(*cols, F.col(ids).cast("array<int>").alias("ids"))
    types = {f.name: f.dataType.simpleString() for f in narrow.schema}
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def work(batch):
        pieces, column = _pieces(shared.value), batch["ids"]
        counts = np.array([n or 0 for n in column.value_lengths().to_pylist()], np.int64)
        values, texts, at = column.flatten().to_numpy(zero_copy_only=False), [], 0
        # Stretches of rows of bounded size, as in encoding.
        edge = np.cumsum(counts) // 1_000_000
        for rows in np.split(np.arange(len(counts)), np.flatnonzero(np.diff(edge)) + 1):
            n = int(counts[rows].sum())
            texts += pieces.decode(values[at:at + n], counts[rows])
            at += n
        null = column.is_null().to_numpy(zero_copy_only=False)
        return pa.RecordBatch.from_arrays(
            [*(batch[c] for c in names), pa.array(texts, pa.string(), mask=null)], [*names, "text"])

    schema = ", ".join([*(f"{c} {types[c]}" for c in names), "text string"])
    done = map_batches(narrow, work, schema)
    return done.select(*(F.col(c).alias(k) for c, k in zip(names, keep, strict=True)), "text")


def digests(docs: DataFrame, model: bytes, text: str = "text", key: str = "doc_id",
            seed: int = 1, dropout: float = DROPOUT) -> DataFrame:
    """key, n_ids, ids_sha256 (of the ids, comma-joined), text_sha256 (of the decoded text),
    lossless: for every row, after encoding and decoding it."""
    whole = docs.select(key, F.sha2(F.col(text).cast("binary"), 256).alias("was"), text)
    coded = encode(whole, model, [key, "was"], text, key, seed, dropout)
    coded = coded.withColumns({
        "n_ids": F.coalesce(F.size("ids"), F.lit(0)).cast("bigint"),
        "ids_sha256": F.sha2(F.array_join("ids", ",").cast("binary"), 256)})
    back = decode(coded, model, [key, "was", "n_ids", "ids_sha256"])
    now = F.sha2(F.col("text").cast("binary"), 256)
    return back.select(key, "n_ids", "ids_sha256", now.alias("text_sha256"),
                       now.eqNullSafe(F.col("was")).alias("lossless"))
