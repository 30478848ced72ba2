"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, exact reranking.

Rotations are learned on a bounded sample of unit vectors (principal axes, then alternating between
the nearest binary codes and the best rotation, from several starts), so that the signs of the rotated
vector are a balanced code. The code is cut into parts, one for each table; codes that differ in
fewer bits than there are tables share a part. Part width follows the number of vectors, so that unlike
vectors rarely share a part however many there are, and the number of tables follows from the width: the
least that meets a pair at the least cosine with probability `RECALL`. Pairs that share a part
are compared by the bits of one whole code, what is left by cosine in double precision on the vectors.

Vectors of each length are indexed by themselves. The commonest `MOST_LENGTHS` lengths have rotations of
their own; those of any others are random. Equal vectors are one class with a size: a group of copies of
any size is one vector in the search, and its links are counted by its size. Buckets are
joined by key, never gathered; a part that very many different vectors share is split by Spark as a
skewed join. The index covers every row; only the rotations are learned on the sample.

Defined cases: null, zero and non-finite vectors link with nothing and are their own component; equal
vectors link with cosine 1, vectors of different lengths never; an empty table gives no rows; a repeated
vec_id counts as so many vectors; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opinara.llm.common import map_batches, stored
from opinara.llm.graph import components

SAMPLE = 4096
MOST_LENGTHS = 64
LEAST_COSINE = 0.95
RECALL = 0.995
#: Part width for each doubling of the number of vectors: above 1, so candidates grow slower than the rows
#: times the tables.
WIDTH = 1.25
CODE = 64
#: Standard deviations beyond which a linked pair's codes do not differ.
SPREAD = 5.0


@dataclass(frozen=True)
class Plan:
    """Tables, part width, bits of the whole code, and the bits in which linked codes differ at most."""

    tables: int
    width: int
    bits: int
    differ: int

    @staticmethod
    def of(rows: int, dim: int, least: float, recall: float = RECALL) -> Plan:
        """For so many vectors: a hyperplane parts two of them with probability angle / pi."""
        apart = math.acos(max(-1.0, min(1.0, least))) / math.pi
        width = min(60, math.ceil(WIDTH * math.log2(max(rows, 4))) + 1)
        same = (1 - apart) ** width
        tables = 1 if same >= recall else math.ceil(math.log(1 - recall) / math.log(1 - same))
        bits = min(CODE - 1, dim * -(-tables * width // dim))
        return Plan(tables, width, bits, math.ceil(bits * apart + SPREAD * math.sqrt(bits * apart * (1 - apart))))


def usable(vector: str) -> F.Column:
    """Whether a vector can have a cosine: no null, no other than finite components, not zero."""
    v = F.col(vector).cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~odd & F.exists(v, lambda x: x != 0), F.lit(False))


def learn(sample: np.ndarray, rounds: int = 20, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) of iterative quantisation; code = signs of (x - mean) @ projection."""
    mean = sample.mean(0)
    x = sample - mean
    _, _, axes = np.linalg.svd(x, full_matrices=len(x) < x.shape[1])
    v = x @ axes.T
    turn = random_turn(x.shape[1], seed)
    for _ in range(rounds):
        code = np.where(v @ turn >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(v.T @ code)
        turn = left @ right
    return mean, axes.T @ turn


def random_turn(dim: int, seed: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))[0]


@dataclass(frozen=True)
class Rotations:
    """Enough rotations of one length for all tables' bits, and what to do with them."""

    plan: Plan
    mean: np.ndarray
    turns: tuple[np.ndarray, ...]

    @staticmethod
    def of(plan: Plan, dim: int, sample: np.ndarray | None = None) -> Rotations:
        """Learned on the sample, or random without one."""
        number = -(-plan.tables * plan.width // dim)
        if sample is None:
            return Rotations(plan, np.zeros(dim), tuple(random_turn(dim, k) for k in range(number)))
        learned = [learn(sample, seed=k) for k in range(number)]
        return Rotations(plan, learned[0][0], tuple(t for _, t in learned))

    def codes(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The parts (one column for each table) and the whole code of every vector."""
        unit = vectors / np.abs(vectors).max(1, keepdims=True)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        bit = np.concatenate([(unit - self.mean) @ t >= 0 for t in self.turns], 1)
        p = self.plan
        powers = 1 << np.arange(max(p.width, p.bits), dtype=np.int64)
        parts = bit[:, :p.tables * p.width].reshape(len(bit), p.tables, p.width) @ powers[:p.width]
        return parts, bit[:, :p.bits] @ powers[:p.bits]


def classes(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """rep, v, n: one row for each different vector; rep is its smallest key."""
    v = F.col(vector).cast("array<double>")
    return (rows.where(usable(vector)).select(F.col(key).alias("id"), v.alias("v"))
            .groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("n")))


def rotations(groups: DataFrame, least: float, sample: int, most_lengths: int) -> tuple[dict, Plan]:
    """The rotations of the commonest lengths, and the plan for all others."""
    dim = F.size("v")
    lengths = groups.groupBy(dim.alias("dim")).count()
    top = lengths.orderBy(F.desc("count"), "dim").limit(most_lengths).collect()
    rest = max(4, (lengths.agg(F.sum("count")).first()[0] or 0) - sum(r["count"] for r in top))
    each = max(256, sample // max(1, len(top)))
    place = F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("rep"), "rep"))
    some = groups.select("rep", "v", dim.alias("dim")).where(F.col("dim").isin([r.dim for r in top]))
    found: dict[int, list] = {}
    for r in some.withColumn("place", place).where(F.col("place") <= each).select("dim", "v").collect():
        found.setdefault(r.dim, []).append(r.v)
    out = {}
    for r in top:
        x = np.array(found[r.dim])
        x /= np.abs(x).max(1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        out[r.dim] = Rotations.of(Plan.of(r["count"], r.dim, least), r.dim, x)
    return out, Plan.of(rest, 1, least)


def candidates(groups: DataFrame, least: float = LEAST_COSINE, sample: int = SAMPLE,
               most_lengths: int = MOST_LENGTHS) -> DataFrame:
    """a, b for the pairs of different vectors that share a part and whose codes are near, a < b."""
    known, rest = rotations(groups, least, sample, most_lengths)
    shared = groups.sparkSession.sparkContext.broadcast((known, rest))

    def code(batch):
        (known, rest), by_dim, out = shared.value, {}, []
        vectors = batch["v"].to_pylist()
        for i, v in enumerate(vectors):
            by_dim.setdefault(len(v), []).append(i)
        for dim, rows in by_dim.items():
            turns = known.get(dim) or Rotations.of(
                Plan(rest.tables, rest.width, min(CODE - 1, dim * -(-rest.tables * rest.width // dim)), CODE), dim)
            parts, whole = turns.codes(np.array([vectors[i] for i in rows]))
            n, m = parts.shape
            out.append(pa.RecordBatch.from_arrays(
                [batch["rep"].take(pa.array(np.repeat(rows, m))), pa.array(np.full(n * m, dim, np.int32)),
                 pa.array(np.tile(np.arange(m, dtype=np.int32), n)), pa.array(parts.ravel()),
                 pa.array(np.repeat(whole, m)), pa.array(np.full(n * m, turns.plan.differ, np.int32))],
                ["rep", "dim", "t", "p", "code", "differ"]))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if out else None

    put = map_batches(groups.select("rep", "v"), code,
                      "rep bigint, dim int, t int, p bigint, code bigint, differ int", 512)
    first = put.select(F.col("rep").alias("a"), "dim", "t", "p", F.col("code").alias("x"), "differ")
    second = put.select(F.col("rep").alias("b"), "dim", "t", "p", F.col("code").alias("y"))
    near = F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= F.col("differ")
    return first.join(second, ["dim", "t", "p"]).where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def links(groups: DataFrame, least: float = LEAST_COSINE, sample: int = SAMPLE,
          most_lengths: int = MOST_LENGTHS) -> DataFrame:
    """a, b, cosine for the pairs of different vectors found, a < b."""
    pairs = candidates(groups, least, sample, most_lengths)
    unit = groups.select("rep", F.transform("v", lambda x: x / F.array_max(F.transform(
        "v", F.abs))).alias("v"))
    first, second = unit.toDF("a", "va"), unit.toDF("b", "vb")

    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)

    cosine = dot("va", "vb") / F.sqrt(dot("va", "va") * dot("vb", "vb"))
    return (pairs.join(first, "a").join(second, "b").select("a", "b", cosine.alias("cosine"))
            .where(F.col("cosine") >= least))


def near_duplicates(rows: DataFrame, key: str = "vec_id", vector: str = "embedding",
                    least: float = LEAST_COSINE, **search) -> DataFrame:
    """One row per vector: key, n_links, component_id, kept."""
    groups = stored(classes(rows, key, vector), "vectors")
    found = stored(links(groups, least, **search), "links")
    both = found.select("a", "b").unionAll(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sizes = groups.select(F.col("rep").alias("b"), "n")
    linked = both.join(sizes, "b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    part = components(found, "a", "b").withColumnRenamed("node", "rep")
    info = groups.join(linked, "rep", "left").join(part, "rep", "left").select(
        "v", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"))
    own = rows.select(F.col(key).alias("key"), F.when(
        usable(vector), F.col(vector).cast("array<double>")).alias("v"))
    return own.join(info, "v", "left").select(
        F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component_id", "key").alias("component_id"),
        F.coalesce(F.col("component_id") == F.col("key"), F.lit(True)).alias("kept"))
