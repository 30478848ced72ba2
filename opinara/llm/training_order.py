"""Training-order materialisation: token sequences in keyed random order, in fixed-stride shards.

Every document is tokenised with a public vocabulary and an end mark, and cut into sequences of
`seq_len` tokens, the last one padded with the mark. The sequences have a dense index (the tasks'
counts, summed up, and a running number in each task). A Feistel network under a key permutes the
next power of four of indices; results beyond the number of sequences are permuted again until they
fall inside (cycle-walking), so every sequence gets its own slot and every slot is used. Rows are
then dealt to partitions by ranges of slots, `SHARDS_PER_TASK` shards each: equal ranges of known
borders, so neither sampling nor sorting across partitions is needed, and no key can be hot.

A shard holds `shard_size` sequences of `stride` bytes each (uint16 ids, little-endian), so slot s
stands in shard s // shard_size at byte (s % shard_size) * stride, and reading can resume at any slot.
Shards are written under a temporary name and then renamed, so a task that is run again leaves the same
files. The index follows the layout of the input (its splits), so the order is repeatable for equal input
files and settings; the tokens are stored before they are counted, so a lost executor changes nothing.

Defined cases: a null text counts as empty; an empty text is one sequence of end marks with no
token; repeated rows are sequences of their own; an empty table gives no rows; extra columns are
not returned.
"""

from __future__ import annotations

import base64
import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm.common import give_back, slices, stored

SEQ_LEN = 256
SHARD_SIZE = 8192
SHARDS_PER_TASK = 16
ROUNDS = 4
_WORKER: dict = {}


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _encoding(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    key = (xxhash.xxh128_digest(ranks), pattern)
    if key not in _WORKER:
        pairs = (line.split() for line in ranks.splitlines() if line)
        _WORKER[key] = tiktoken.Encoding("file", pat_str=pattern, special_tokens={},
                                         mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs})
    return _WORKER[key]


def feistel(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of 0 .. n - 1, element by element."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    rng = np.random.Generator(np.random.PCG64(key))
    keys = rng.integers(0, 1 << 63, ROUNDS, dtype=np.uint64) | np.uint64(1)

    def once(x):
        left, right = x >> shift, x & mask
        for k in keys:
            f = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * (k ^ np.uint64(0xBF58476D1CE4E5B9))
            left, right = right, left ^ ((f >> np.uint64(32)) & mask)
        return (left << shift) | right

    out = once(index.astype(np.uint64))
    while True:
        beyond = np.flatnonzero(out >= np.uint64(n))
        if not len(beyond):
            return out.astype(np.int64)
        out[beyond] = once(out[beyond])


def tokens(docs: DataFrame, ranks: bytes, pattern: str, end_mark: int, seq_len: int,
           text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, task, first (its first sequence in the task), tokens (uint16 with end mark)."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        enc, task, first = _encoding(shared.value, pattern), TaskContext.get().partitionId(), 0
        for batch in slices(batches):
            ids, firsts = [], []
            for t in batch["t"].to_pylist():
                got = np.append(enc.encode_to_numpy(t, disallowed_special=()), end_mark)
                ids.append(got.astype("<u2").tobytes())
                firsts.append(first)
                first += -(-len(got) // seq_len)
            yield pa.RecordBatch.from_arrays(
                [batch["k"], pa.array([task] * len(ids), pa.int32()), pa.array(firsts, pa.int64()),
                 pa.array(ids, pa.binary())], ["doc_id", "task", "first", "tokens"])

    return docs.select(F.col(key).cast("bigint").alias("k"),
                       F.coalesce(F.col(text), F.lit("")).alias("t")).mapInArrow(
        run, "doc_id bigint, task int, first bigint, tokens binary")


@dataclass(frozen=True)
class Order:
    """The stored tokens, how many sequences they make, and the first index of every task's."""

    kept: DataFrame
    n: int
    base: dict[int, int]


def ordered(docs: DataFrame, ranks: bytes, pattern: str, end_mark: int, seq_len: int, text: str, key: str) -> Order:
    if end_mark >= 1 << 16:
        raise ValueError("ids must fit 16 bits")
    kept = stored(tokens(docs, ranks, pattern, end_mark, seq_len, text, key), "tokens")
    length = F.length("tokens") / 2
    per_task = kept.groupBy("task").agg(F.sum(F.ceil(length / seq_len)).alias("n")).collect()
    base, n = {}, 0
    for row in sorted(per_task):  # one row for each split of the input
        base[row.task] = n
        n += row.n
    return Order(kept, n, base)


def sequences(batch: pa.RecordBatch, base: dict[int, int], n: int, order_key: int, seq_len: int,
              end_mark: int) -> tuple[np.ndarray, ...]:
    """Slot, row of the batch, number in the document, tokens of the text, and ids of every sequence."""
    data = [np.frombuffer(x, "<u2") for x in batch["tokens"].to_pylist()]
    size = np.array([len(x) for x in data])
    count = -(-size // seq_len)
    part = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    begin = np.array([base[t] for t in batch["task"].to_pylist()]) + batch["first"].to_numpy()
    slot = feistel(np.repeat(begin, count) + part, n, order_key)
    flat = np.full((int(count.sum()), seq_len), end_mark, "<u2")
    at = np.repeat((np.cumsum(count) - count) * seq_len - (np.cumsum(size) - size), size)
    flat.reshape(-1)[np.arange(size.sum()) + at] = np.concatenate(data)
    # The end mark is no token of the text; the last sequence may hold nothing else.
    real = np.minimum(seq_len, np.repeat(size - 1, count) - part * seq_len)
    return slot, np.repeat(np.arange(len(count)), count), part, real.astype(np.int64), flat


def materialise(docs: DataFrame, ranks: bytes, pattern: str, end_mark: int, order_key: int = 1,
                seq_len: int = SEQ_LEN, shard_size: int = SHARD_SIZE, per_task: int = SHARDS_PER_TASK,
                text: str = "text", key: str = "doc_id") -> DataFrame:
    """slot, shard, byte_offset, doc_id, part (number of the sequence in its document), n_tokens,
    tokens (stride bytes): partitions are ranges of slots, sorted by slot, and hold whole shards."""
    order = ordered(docs, ranks, pattern, end_mark, seq_len, text, key)
    n, stride, shared = order.n, seq_len * 2, docs.sparkSession.sparkContext.broadcast(order.base)

    def place(batches):
        for batch in slices(batches):
            slot, row, part, real, flat = sequences(batch, shared.value, n, order_key, seq_len, end_mark)
            payload = pa.FixedSizeBinaryArray.from_buffers(
                pa.binary(stride), len(slot), [None, pa.py_buffer(flat.tobytes())]).cast(pa.binary())
            rows = pa.RecordBatch.from_arrays(
                [pa.array(slot), batch["doc_id"].take(pa.array(row)), pa.array(part), pa.array(real), payload],
                ["slot", "doc_id", "part", "n_tokens", "tokens"])
            yield from slices([rows], 4096)
        give_back()

    rows = order.kept.mapInArrow(
        place, "slot bigint, doc_id bigint, part bigint, n_tokens bigint, tokens binary")
    shard = F.floor(F.col("slot") / shard_size)
    target = F.floor(shard / per_task).cast("int")
    return (rows.repartitionById(max(1, -(-n // (shard_size * per_task))), target).sortWithinPartitions("slot")
            .select("slot", shard.cast("bigint").alias("shard"),
                    (F.col("slot") % shard_size * stride).alias("byte_offset"),
                    "doc_id", "part", "n_tokens", "tokens"))


def _system(folder: str):
    """The file system of a folder, and its path there."""
    from pyarrow import fs
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder.removeprefix("file:")
    return fs.FileSystem.from_uri(folder)


def write_shards(docs: DataFrame, folder: str, ranks: bytes, pattern: str, end_mark: int, order_key: int = 1,
                 seq_len: int = SEQ_LEN, shard_size: int = SHARD_SIZE, per_task: int = SHARDS_PER_TASK,
                 text: str = "text", key: str = "doc_id") -> DataFrame:
    """Writes one file for each shard under a folder that all executors reach (any URI that Arrow's
    file systems know), each under a temporary name first, and returns shard, file, n_sequences.

    What one batch has for a task is one compressed row; the task puts it in place, in an array of its
    per_task shards. A task that is run again writes the same bytes to the same names."""
    order = ordered(docs, ranks, pattern, end_mark, seq_len, text, key)
    n, room, shared = order.n, shard_size * per_task, docs.sparkSession.sparkContext.broadcast(order.base)

    def pack(batches):
        packer = zstandard.ZstdCompressor(level=3)
        for batch in slices(batches):
            slot, _, _, _, flat = sequences(batch, shared.value, n, order_key, seq_len, end_mark)
            by = np.argsort(slot)
            cuts = np.flatnonzero(np.diff(slot[by] // room, prepend=-1))
            parts = [by[a:b] for a, b in zip(cuts, [*cuts[1:], len(by)], strict=True)]
            yield from slices([pa.RecordBatch.from_arrays(
                [pa.array([int(slot[p[0]] // room) for p in parts], pa.int32()),
                 pa.array([slot[p].tobytes() for p in parts], pa.binary()),
                 pa.array([packer.compress(flat[p].tobytes()) for p in parts], pa.binary())],
                ["target", "slots", "data"])], 4096)
        give_back()

    def run(batches):
        system, root = _system(folder)
        place, held, base = zstandard.ZstdDecompressor(), None, 0
        for batch in batches:
            for target, slots, data in zip(*(batch[c].to_pylist() for c in ("target", "slots", "data")), strict=True):
                if held is None:
                    base = target * room
                    held = np.empty((min(room, n - base), seq_len), "<u2")
                held[np.frombuffer(slots, np.int64) - base] = np.frombuffer(
                    place.decompress(data), "<u2").reshape(-1, seq_len)
        if held is None:
            return
        system.create_dir(root, recursive=True)
        for at in range(0, len(held), shard_size):
            shard, part = (base + at) // shard_size, held[at:at + shard_size]
            name = f"shard-{shard:08d}.bin"
            temporary = f"{root}/.{name}-{TaskContext.get().taskAttemptId()}"
            with system.open_output_stream(temporary) as out:
                out.write(part.tobytes())
            system.move(temporary, f"{root}/{name}")
            yield pa.RecordBatch.from_pydict(
                {"shard": pa.array([shard], pa.int64()), "file": [name], "n_sequences": pa.array([len(part)], pa.int64())})
        del held
        give_back()

    packed = order.kept.mapInArrow(pack, "target int, slots binary, data binary")
    return packed.repartitionById(max(1, -(-n // room)), "target").mapInArrow(
        run, "shard bigint, file string, n_sequences bigint")


def read_back(manifest: DataFrame, folder: str, seq_len: int = SEQ_LEN, shard_size: int = SHARD_SIZE) -> DataFrame:
    """shard, file, first_slot, n_sequences, n_bytes, sha256 of the files as they stand in the folder;
    manifest: shard and file of each."""
    def run(batches):
        system, root = _system(folder)
        for batch in batches:
            sizes, digests = [], []
            for name in batch["file"].to_pylist():
                digest, size = hashlib.sha256(), 0
                with system.open_input_stream(f"{root}/{name}") as f:
                    while data := f.read(1 << 20):
                        digest.update(data)
                        size += len(data)
                sizes.append(size)
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch["shard"], batch["file"], pa.array(sizes, pa.int64()), pa.array(digests, pa.string())],
                ["shard", "file", "n_bytes", "sha256"])

    found = manifest.select("shard", "file").repartition("shard").mapInArrow(
        run, "shard bigint, file string, n_bytes bigint, sha256 string")
    return found.select("shard", "file", (F.col("shard") * shard_size).alias("first_slot"),
                        F.floor(F.col("n_bytes") / (2 * seq_len)).cast("bigint").alias("n_sequences"), "n_bytes", "sha256")


def read_slots(folder: str, first: int, count: int, seq_len: int = SEQ_LEN,
               shard_size: int = SHARD_SIZE) -> np.ndarray:
    """count sequences from slot first on, read in order from the shards."""
    system, root = _system(folder)
    out, stride = [], seq_len * 2
    while count > 0:
        shard, at = divmod(first, shard_size)
        take = min(count, shard_size - at)
        with system.open_input_file(f"{root}/shard-{shard:08d}.bin") as f:
            f.seek(at * stride)
            out.append(np.frombuffer(f.read(take * stride), "<u2").reshape(-1, seq_len))
        first, count = first + take, count - take
    return np.concatenate(out) if out else np.zeros((0, seq_len), "<u2")
