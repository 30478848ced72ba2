"""Cross-tokenizer alignment: an inverted index of token pairs, held as bitmaps of documents.

Two tokenizers cut one text, a byte-level one (A) and a piece model (B). Their tokens tile the same
bytes, so between two neighbouring ends of either stands exactly one linked pair of tokens; where both
end, a group ends. One pass over the whole texts encodes, links and numbers the documents: a task
deals them into chunks, and for each pair of ids in a chunk it writes a compressed bitmap of the documents
that link it (their numbers, or bits where that is shorter) and planes of the same form for
further links in one document: plane k stands for 2^(k-1) more.

The bitmaps of a pair's chunks do not overlap, so their union has the sum of their bits: plane 0 gives the
documents of a pair, all planes by weight its links. These counts are summed in each task before the
shuffle, and the highest of each B id is a table of at most its vocabulary. Joined back to the postings,
each bitmap returns its pair's score to the documents in it, added up a chunk at a time. A pair
that nearly all documents hold has many bitmaps, never one long list; the join may split them.

Defined cases: a null or empty text, and one whose tokens do not spell it (the piece model's own blank
sign in the text), has no tokens, zeros and empty groups; special tokens' strings are plain text; equal
texts get equal figures; a null or repeated key is kept; very long texts are encoded whole,
in windows that end where neither tokenizer can join anything; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from opinara.llm.common import chunks, give_back, slices, stored

CHUNK_DOCS = 1 << 16
CHUNK_LINKS = 6_000_000
WINDOW_CHARS = 200_000
ROWS = 50_000  # of an Arrow batch of postings
_BLANK = "▁"
_WORKER: dict = {}


@dataclass(frozen=True)
class Files:
    """Both tokenizers as their files hold them."""

    a: str
    b: bytes

    @staticmethod
    def read(a_path: str, b_path: str) -> Files:
        with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
            return Files(a.read(), b.read())


def byte_signs() -> dict[str, int]:
    """The sign by which a byte-level vocabulary writes each byte: printable ones by themselves."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Side:
    """The bytes of every id of one tokenizer, and each id written with the signs that may follow it."""

    def __init__(self, tokens: list[bytes], end: str):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.said = np.array([[f"{i}," for i in range(len(tokens))],
                              [f"{i}{end}" for i in range(len(tokens))]], object)

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        if not size.sum():
            return self.blob[:0]
        start = np.repeat(self.first[ids] - (np.cumsum(size) - size), size)
        return self.blob[start + np.arange(len(start))]


class Pair:
    """Both tokenizers, ready to encode."""

    def __init__(self, files: Files):
        self.a = Tokenizer.from_str(files.a)
        self.a.encode_special_tokens = True
        signs = byte_signs()
        added = {t["content"] for t in json.loads(files.a)["added_tokens"]}
        spelled = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            spelled[i] = token.encode() if token in added else bytes(signs[c] for c in token)
        self.left = Side(spelled, "|")
        self.b = b = sentencepiece.SentencePieceProcessor(model_proto=files.b)
        pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        self.right = Side([bytes([int(p[3:5], 16)]) if b.is_byte(i)
                           else b"" if b.is_control(i) or b.is_unknown(i)
                           else p.replace(_BLANK, " ").encode() for i, p in enumerate(pieces)], ";")
        # A window may begin with a blank if no piece holds one behind another sign.
        self.cuts = not any(_BLANK in p.lstrip(_BLANK) for p in pieces)

    def windows(self, text: str, most: int = WINDOW_CHARS) -> list[str]:
        """A blank and the text, cut before single blanks between letters, where tokens of both end."""
        out, at, text = [], 0, " " + text
        while self.cuts and len(text) - at > most:
            cut = re.compile("(?<=[a-z]) (?=[a-z])").search(text, at + most)
            if cut is None:
                break
            out.append(text[at:cut.start()])
            at = cut.start()
        return [*out, text[at:]]

    def encode(self, texts: list[str], most: int = WINDOW_CHARS) -> tuple[np.ndarray, ...]:
        """Ids of A, tokens of A in each text, ids of B, tokens of B in each text."""
        parts = [self.windows(t, most) for t in texts]
        flat = [w for p in parts for w in p]
        owner = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
        out = []
        for ids in ([e.ids for e in self.a.encode_batch_fast(flat, add_special_tokens=False)],
                    self.b.encode([w[1:] for w in flat], num_threads=1)):
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            out.append(np.fromiter(itertools.chain.from_iterable(ids), np.int64, int(sizes.sum())))
            out.append(np.bincount(owner, sizes, len(texts)).astype(np.int64))
        return tuple(out)


def _pair(files: Files) -> Pair:
    key = xxhash.xxh128_digest(files.a.encode() + files.b)
    if key not in _WORKER:
        _WORKER[key] = Pair(files)
    return _WORKER[key]


@dataclass
class Linked:
    """Some texts' figures, by text, and the linked ids, by link; groups: as `a1,a2|b1;a3|b2`."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[str]
    owner: np.ndarray
    a: np.ndarray
    b: np.ndarray


def link(pair: Pair, texts: list[str | None], most: int = WINDOW_CHARS) -> Linked:
    n = len(texts)
    use = np.array([i for i, t in enumerate(texts) if t], int)
    raw = [(" " + texts[i]).encode("utf-8", "replace") for i in use]
    a, n_a, b, n_b = pair.encode([texts[i] for i in use], most) if len(use) else (np.zeros(0, int),) * 4
    length = np.array([len(r) for r in raw], np.int64)
    same = np.ones(len(use), bool)
    for side, ids, count in ((pair.left, a, n_a), (pair.right, b, n_b)):
        whose = np.repeat(np.arange(len(use)), count)
        same &= np.bincount(whose, side.size[ids], len(use)).astype(np.int64) == length
        kept = same[whose]
        spelled, text = side.spelled(ids[kept]), b"".join(r for r, s in zip(raw, same, strict=True) if s)
        wrong = spelled != np.frombuffer(text, np.uint8)
        if wrong.any():
            of = np.repeat(np.flatnonzero(same), length[same])
            same[of[wrong]] = False
    a, b = (ids[same[np.repeat(np.arange(len(use)), count)]] for ids, count in ((a, n_a), (b, n_b)))
    at = use[same]
    out = [np.zeros(n, np.int64) for _ in range(4)]
    out[0][at], out[1][at] = n_a[same], n_b[same]
    groups, total = [""] * n, int(length[same].sum())
    if not total:
        return Linked(*out, groups, *(np.zeros(0, np.int64),) * 3)
    ends = np.zeros(total + 1, np.uint8)
    ends[np.cumsum(pair.left.size[a])] |= 1
    ends[np.cumsum(pair.right.size[b])] |= 2
    place = np.flatnonzero(ends)
    of_a, of_b, both = ends[place] & 1 > 0, ends[place] & 2 > 0, ends[place] == 3
    owner = at[np.searchsorted(np.cumsum(length[same]), place, "left")]
    out[2] += np.bincount(owner[both], minlength=n)
    out[3] += np.bincount(owner, minlength=n)
    # Written in the order of the groups: of each the tokens of A, then those of B.
    group = np.cumsum(both) - both
    ga, gb = group[of_a], group[of_b]
    count_a, count_b = (np.bincount(g, minlength=int(group[-1]) + 1) for g in (ga, gb))
    said = np.empty(len(a) + len(b), object)
    last = [np.append(g[1:] != g[:-1], True).astype(int) for g in (ga, gb)]
    said[np.arange(len(a)) + (np.cumsum(count_b) - count_b)[ga]] = pair.left.said[last[0], a]
    said[np.arange(len(b)) + np.cumsum(count_a)[gb]] = pair.right.said[last[1], b]
    said, cut = said.tolist(), np.cumsum(n_a[same] + n_b[same]).tolist()
    for i, lo, hi in zip(at.tolist(), [0, *cut], cut, strict=False):
        groups[i] = "".join(said[lo:hi])[:-1]
    link_a = a[np.cumsum(of_a) - of_a]
    return Linked(*out, groups, owner, link_a, b[np.cumsum(of_b) - of_b])


POSTING = ("a", "b", "chunk", "plane", "n", "bits", "docs")


def postings(codes: np.ndarray, n_docs: int, chunk: int) -> Iterator[pa.RecordBatch]:
    """The bitmaps and planes of a chunk's links; codes: a, b (20 bits) and document (16 bits) of each."""
    codes.sort()
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))[:len(codes)])
    more = np.diff(np.append(first, len(codes))) - 1
    codes = codes[first]
    for plane in range(int(more.max(initial=0)).bit_length() + 1):
        some = codes[more >> (plane - 1) & 1 > 0] if plane else codes
        if not len(some):
            continue
        key, docs = some >> 16, (some & 0xFFFF).astype("<u2")
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        n = np.diff(np.append(start, len(key)))
        dense = 16 * n > n_docs
        for lo in range(0, len(start), ROWS):
            hi = min(lo + ROWS, len(start))
            yield _posting_rows(key[start[lo:hi]], docs, start[lo:hi], n[lo:hi], dense[lo:hi], n_docs, chunk, plane)


def _posting_rows(key, docs, start, n, dense, n_docs, chunk, plane) -> pa.RecordBatch:
    """Postings of one plane: the numbers of the documents, or one bit for each document of the chunk."""
    size = np.where(dense, -(-n_docs // 8), 2 * n)
    offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    data = np.zeros(int(offsets[-1]), np.uint8)
    base, end = int(start[0]), int(start[-1] + n[-1])
    whose = np.repeat(np.arange(len(n)), n)
    own = docs[base:end]
    sparse = ~dense[whose]
    at = offsets[whose] + 2 * (np.arange(len(whose)) - (start - base)[whose])
    data[at[sparse]], data[at[sparse] + 1] = own[sparse] & 0xFF, own[sparse] >> 8
    np.bitwise_or.at(data, offsets[whose[~sparse]] + (own[~sparse] >> 3),
                     (1 << (own[~sparse] & 7)).astype(np.uint8))
    k = len(n)
    return pa.RecordBatch.from_arrays([
        pa.array((key >> 20).astype(np.int32)), pa.array((key & 0xFFFFF).astype(np.int32)),
        pa.array(np.full(k, chunk, np.int64)), pa.array(np.full(k, plane, np.int32)),
        pa.array(n.astype(np.int32)), pa.array(dense),
        pa.Array.from_buffers(pa.binary(), k, [None, pa.py_buffer(offsets), pa.py_buffer(data)])], list(POSTING))


def index(docs: DataFrame, files: Files, keep: Sequence[str], text: str = "text",
          digest: bool = True) -> DataFrame:
    """Stored rows of two kinds: documents (chunk, number and figures, the columns in keep as k0, k1 ...)
    and postings (a is not null). digest: groups is the SHA-256 of the groups, else the groups."""
    names = [f"k{i}" for i in range(len(keep))]
    narrow = docs.select(*(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)),
                         F.col(text).cast("string").alias("t"))
    types = {f.name: f.dataType.simpleString() for f in narrow.schema}
    shared = docs.sparkSession.sparkContext.broadcast(files)
    figures = ("n_a", "n_b", "n_groups", "n_links")

    def run(batches):
        pair, task, number = _pair(shared.value), TaskContext.get().partitionId(), 0
        codes, n_codes, n_docs, kinds = [], 0, 0, None

        def rows(batch):
            """All columns, those of the other kind null."""
            k = batch.num_rows
            return pa.RecordBatch.from_arrays(
                [batch[c] if c in batch.schema.names else pa.nulls(k, t) for c, t in kinds.items()], list(kinds))

        def flushed():
            nonlocal codes, n_codes, n_docs, number
            if codes:
                every = np.concatenate(codes)
                codes = []
                for batch in postings(every, n_docs, task << 32 | number):
                    yield rows(batch)
            codes, n_codes, n_docs, number = [], 0, 0, number + 1

        for batch in slices(batches):
            kinds = kinds or {n: batch.schema.field(n).type for n in names} | {
                "number": pa.int32(), **{f: pa.int64() for f in figures}, "groups": pa.string(),
                "a": pa.int32(), "b": pa.int32(), "chunk": pa.int64(), "plane": pa.int32(), "n": pa.int32(),
                "bits": pa.bool_(), "docs": pa.binary()}
            for first, part in chunks(batch["t"].to_pylist()):
                if n_codes >= CHUNK_LINKS or n_docs + len(part) > CHUNK_DOCS:
                    yield from flushed()
                found = link(pair, part)
                codes.append(found.a << 36 | found.b << 16 | (found.owner + n_docs))
                n_codes += len(found.a)
                said = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in found.groups] \
                    if digest else found.groups
                own = batch.slice(first, len(part))
                yield rows(pa.RecordBatch.from_arrays(
                    [*(own[n] for n in names),
                     pa.array(np.arange(n_docs, n_docs + len(part)), pa.int32()),
                     *(pa.array(getattr(found, f)) for f in figures), pa.array(said, pa.string()),
                     pa.array(np.full(len(part), task << 32 | number))],
                    [*names, "number", *figures, "groups", "chunk"]))
                n_docs += len(part)
        if kinds:
            yield from flushed()
        give_back()

    schema = ", ".join([*(f"{n} {types[n]}" for n in names), "number int", *(f"{f} bigint" for f in figures),
                        "groups string, a int, b int, chunk bigint, plane int, n int, bits boolean, docs binary"])
    return stored(narrow.mapInArrow(run, schema), "pair-index")


def _weight() -> Column:
    """Links that a document in a row's bitmap stands for."""
    return F.expr("shiftleft(1L, greatest(plane - 1, 0))")


def pair_counts(rows: DataFrame) -> DataFrame:
    """a, b, docs (documents that link the pair) and links (of the corpus), from the bitmaps' bits."""
    return rows.where("a IS NOT NULL").select("a", "b", "plane", "n", _weight().alias("w")).groupBy("a", "b").agg(
        F.sum(F.when(F.col("plane") == 0, F.col("n")).otherwise(0)).alias("docs"),
        F.sum(F.col("n") * F.col("w")).alias("links"))


def scored(rows: DataFrame) -> DataFrame:
    """chunk, number, n_best and count_sum of every document with a link: what its postings return."""
    counts = pair_counts(rows).select("a", "b", "links")
    # At most one row for each id of B.
    highest = counts.groupBy("b").agg(F.max("links").alias("most")).withColumnRenamed("b", "_b")
    marked = counts.join(F.broadcast(highest), F.col("b") == F.col("_b")).select(
        "a", "b", "links", (F.col("links") == F.col("most")).alias("best"))
    given = rows.where("a IS NOT NULL").select("a", "b", "chunk", "bits", "docs", _weight().alias("w"))
    met = given.join(marked, ["a", "b"]).select(
        "chunk", "bits", "docs", (F.col("w") * F.col("links")).alias("sum"),
        F.when(F.col("best"), F.col("w")).otherwise(F.lit(0).cast("bigint")).alias("best"))

    def run(batches):
        now, sums = None, None

        def closed():
            some = np.flatnonzero(sums[0])
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(some), now, np.int64)), pa.array(some.astype(np.int32)),
                 pa.array(sums[1][some]), pa.array(sums[0][some])], ["chunk", "number", "n_best", "count_sum"])

        for batch in batches:
            chunk, bits = batch["chunk"].to_numpy(), batch["bits"].to_numpy(zero_copy_only=False)
            values = [batch["sum"].to_numpy(), batch["best"].to_numpy()]
            offsets = np.frombuffer(batch["docs"].buffers()[1], np.int32)[
                batch["docs"].offset:batch["docs"].offset + batch.num_rows + 1].astype(np.int64)
            data = np.frombuffer(batch["docs"].buffers()[2], np.uint8)
            cuts = np.flatnonzero(np.concatenate(([True], chunk[1:] != chunk[:-1])))
            for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(chunk)], strict=True):
                if chunk[lo] != now:
                    if now is not None:
                        yield closed()
                    now, sums = int(chunk[lo]), np.zeros((2, CHUNK_DOCS), np.int64)
                listed = lo + np.flatnonzero(~bits[lo:hi])
                size = (offsets[listed + 1] - offsets[listed]) // 2
                at = np.repeat(offsets[listed] - 2 * (np.cumsum(size) - size), size) + 2 * np.arange(size.sum())
                docs = data[at].astype(np.int64) | data[at + 1].astype(np.int64) << 8
                for out, value in zip(sums, values, strict=True):
                    np.add.at(out, docs, np.repeat(value[listed], size))
                for i in (lo + np.flatnonzero(bits[lo:hi])).tolist():
                    hit = np.flatnonzero(np.unpackbits(data[offsets[i]:offsets[i + 1]], bitorder="little"))
                    for out, value in zip(sums, values, strict=True):
                        out[hit] += value[i]
        if now is not None:
            yield closed()
        give_back()

    return met.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(
        run, "chunk bigint, number int, n_best bigint, count_sum bigint")


def align(docs: DataFrame, files: Files, keep: Sequence[str], text: str = "text",
          digest: bool = True) -> DataFrame:
    """The columns in keep, n_a, n_b, n_groups, n_links, n_best, count_sum, and groups (or its SHA-256)."""
    rows = index(docs, files, keep, text, digest)
    names = [f"k{i}" for i in range(len(keep))]
    figures = ("n_a", "n_b", "n_groups", "n_links")
    own = rows.where("number IS NOT NULL").select(*names, "chunk", "number", *figures, "groups")
    done = own.join(scored(rows), ["chunk", "number"], "left")
    return done.select(
        *names, *figures, F.coalesce("n_best", F.lit(0)).alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups").toDF(
        *keep, *figures, "n_best", "count_sum", "groups_sha256" if digest else "groups")
