"""N-gram Jaccard join with adaptive multi-match prefixes, and the classes that its links form.

A document is its set of hashed n-word shingles. All shingles have one global order, rarest first, by
a count sketch of fixed size over the whole corpus. If two sets are linked, their prefixes of
|s| - need + m shingles (need: the least overlap) share at least m shingles. Each document chooses its
m from the estimated cost: a longer prefix reads more entries, but asks for more shared shingles
before anything is verified. A pair is a candidate if it shares as many as the smaller m of the two.

Documents with equal sets are one class from the start, so copies are never compared. The entries of
one shingle are read as a sorted stream. Where few sets (`SMALL` at most) share it, their pairs are
counted. Where many do, such as a group of near copies, no pairs are made: the set whose shingles are
the most common is the centre, and each other set is joined to it alone. That loses no link that
counts for the classes: if a and b share no difference from the centre c (nothing both added or both
lack), then J(a, b) <= min(J(a, c), J(b, c)), so a linked pair is linked through c already. Sets not
linked to the centre are compared with those that share a difference, by an index of the differences
inside the group. A group of more than `PART` sets is dealt out in parts, each with a copy of the centre;
what is not linked to the centre there (and nothing else: two sets that are need no link of their own) then
goes to every part and meets the members there in such an index. No task holds more of a group than a part,
and of the links found in a part only those are given that join what was not joined there.

Verification uses whole sets, so every link reported is exact up to 64-bit hashes, and classes are
the connected components of all links.

Defined cases: null texts and texts without words have an empty set and are their own class; with
fewer words than n the whole sequence is the one shingle; equal rows are in one class; a null key is
its own class, null; very long texts are used whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm.common import WHOLE_BATCH, chunks, give_back, map_batches, slices, stored
from opinara.llm.graph import components
from opinara.llm.repeats import grams, word_hashes

CELLS = 1 << 20
BLOCK = 1 << 12
MOST_MATCHES = 5
SMALL = 16
PART = 256


def shingle_sets(texts: list[str | None], n: int) -> Iterator[np.ndarray]:
    """The sorted, distinct shingle hashes of each text."""
    for _, part in chunks(texts):
        owner, _, h = word_hashes([t.encode("utf-8", "replace").lower() for t in part])
        cuts = np.searchsorted(owner, np.arange(len(part) + 1))
        g = grams(h, n)
        for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
            if b - a >= n:
                yield np.unique(g[a:b - n + 1])
            elif b > a:
                yield grams(h[a:b], b - a)
            else:
                yield g[:0]


def sign(s: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh128_digest(s.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:12], "little", signed=True)


def least_overlap(size: int, threshold: tuple[int, int]) -> int:
    return -(-threshold[0] * size // threshold[1])


def linked(overlap, a, b, threshold: tuple[int, int]):
    return threshold[1] * overlap >= threshold[0] * (a + b - overlap)


def survey(docs: DataFrame, n: int, text: str, key: str) -> DataFrame:
    """Stored rows of two kinds: doc, hash of the text, sign and size of its set; and the task's
    part of the count sketch, cell block by cell block."""
    rows = docs.select(F.col(key).cast("bigint").alias("doc"), F.xxhash64(text).alias("body"),
                       F.col(text).cast("string").alias("t"))

    def run(batches):
        cells = np.zeros(CELLS, np.int64)
        names = ["doc", "body", "s1", "s2", "size", "block", "counts"]
        for batch in slices(batches):
            signs, sizes = [], []
            for s in shingle_sets(batch["t"].to_pylist(), n):
                signs.append(sign(s))
                sizes.append(len(s))
                np.add.at(cells, (s & np.uint64(CELLS - 1)).astype(np.int64), 1)
            k = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [batch["doc"], batch["body"], pa.array([x[0] for x in signs], pa.int64()),
                 pa.array([x[1] for x in signs], pa.int32()), pa.array(sizes, pa.int64()),
                 pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names)
        parts = cells.astype(np.int32).reshape(-1, BLOCK)
        some = np.flatnonzero(parts.any(1))
        k = len(some)
        for at in range(0, k, 64):
            use = some[at:at + 64]
            m = len(use)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()),
                 pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64()), pa.array(use, pa.int32()),
                 pa.array([parts[i].tobytes() for i in use], pa.binary())], names)
        give_back()

    return stored(rows.mapInArrow(run, "doc bigint, body bigint, s1 bigint, s2 int, size bigint,"
                                       " block int, counts binary"), "survey")


def sketch(parts: DataFrame) -> np.ndarray:
    """The summed sketch: CELLS counts, whatever the size of the corpus."""
    def add(batches):
        now, total = None, None
        for batch in batches:
            for block, counts in zip(batch["block"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                if block != now:
                    if now is not None:
                        yield pa.RecordBatch.from_pydict({"block": pa.array([now], pa.int32()),
                                                          "counts": [total.tobytes()]})
                    now, total = block, np.zeros(BLOCK, np.int64)
                total += np.frombuffer(counts, np.int32)
        if now is not None:
            yield pa.RecordBatch.from_pydict({"block": pa.array([now], pa.int32()),
                                              "counts": [total.tobytes()]})

    out = np.zeros((CELLS // BLOCK, BLOCK), np.int64)
    rows = parts.where("block IS NOT NULL").select("block", "counts")
    for row in (rows.repartition("block").sortWithinPartitions("block")
                .mapInArrow(add, "block int, counts binary").collect()):
        out[row.block] = np.frombuffer(row.counts, np.int64)
    return out.reshape(-1)


def matches_asked(estimate: np.ndarray, usual: float, size: int, need: int) -> int:
    """m: how many shared prefix shingles the document asks for. estimate: counts, in prefix order.

    A prefix reads its entries; of the documents met, at most entries / m are met m times, and each
    of these costs a comparison of whole sets.
    """
    most = min(MOST_MATCHES, need)
    lengths = size - need + np.arange(1, most + 1)
    entries = np.cumsum(np.maximum(estimate - usual, 0) + 1)[lengths - 1]
    return int(np.argmin(entries + entries / np.arange(1, most + 1) * size)) + 1


def prefixes(docs: DataFrame, counts: np.ndarray, n: int, threshold: tuple[int, int],
             text: str, key: str) -> DataFrame:
    """token, rank (the lower, the more central the set), sign, size, asked: the prefix entries."""
    usual = float(np.median(counts))
    shared = docs.sparkSession.sparkContext.broadcast(counts.astype(np.int32))

    def enter(batch):
        table = shared.value
        seen, out = set(), {k: [] for k in ("token", "rank", "s1", "s2", "size", "asked")}
        for s in shingle_sets(batch["t"].to_pylist(), n):
            own = sign(s)
            if not len(s) or own in seen:
                continue  # equal sets of a batch are entered once
            seen.add(own)
            size, need = len(s), least_overlap(len(s), threshold)
            est = table[(s & np.uint64(CELLS - 1)).astype(np.int64)]
            order = np.lexsort((s, est))
            asked = matches_asked(est[order], usual, size, need)
            take = order[:size - need + asked]
            out["token"].append(s[take].view(np.int64))
            out["rank"].append(np.full(len(take), -int(1000 * np.log2(1 + est).mean()), np.int32))
            for k, v, kind in (("s1", own[0], np.int64), ("s2", own[1], np.int32),
                               ("size", size, np.int32), ("asked", asked, np.int32)):
                out[k].append(np.full(len(take), v, kind))
        if not out["token"]:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in out.values()], list(out))

    rows = docs.where(F.col(key).isNotNull()).select(F.col(text).cast("string").alias("t"))
    return map_batches(rows, enter, "token bigint, rank int, s1 bigint, s2 int, size int, asked int",
                       WHOLE_BATCH)


def meetings(entries: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """c (centre), b (member), star: whom to compare with whom. Sets that share a rare shingle meet
    in pairs (counted against what they ask for), those that share a common one meet its centre."""
    def meet(batches):
        token, held, centre, out = None, [], None, []

        def batch_of(rows):
            c1, c2, b1, b2, asked, star = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(c1, pa.int64()), pa.array(c2, pa.int32()), pa.array(b1, pa.int64()),
                 pa.array(b2, pa.int32()), pa.array(asked, pa.int32()), pa.array(star, pa.int32())],
                ["c1", "c2", "b1", "b2", "asked", "star"])

        def pairs():
            for i, (_, a1, a2, asize, aasked) in enumerate(held):
                for _, b1, b2, bsize, basked in held[i + 1:]:
                    if threshold[1] * min(asize, bsize) >= threshold[0] * max(asize, bsize):
                        first, second = sorted(((a1, a2), (b1, b2)))
                        out.append((*first, *second, min(aasked, basked), 0))

        for batch in batches:
            cols = [batch[c].to_pylist() for c in ("token", "rank", "s1", "s2", "size", "asked")]
            for t, *row in zip(*cols, strict=True):
                if t != token:
                    if centre is None:
                        pairs()
                    token, held, centre = t, [], None
                if centre is not None:
                    if (row[1], row[2]) != last:
                        out.append((*centre, row[1], row[2], 1, 1))
                elif not held or (row[1], row[2]) != last:
                    held.append(row)
                    if len(held) > SMALL:
                        centre = (held[0][1], held[0][2])
                        out.extend((*centre, r[1], r[2], 1, 1) for r in held[1:])
                last = (row[1], row[2])
            if len(out) > 20_000:
                yield batch_of(out)
                out = []
        if centre is None:
            pairs()
        if out:
            yield batch_of(out)

    order = entries.repartition("token").sortWithinPartitions("token", "rank", "s1", "s2")
    met = order.mapInArrow(meet, "c1 bigint, c2 int, b1 bigint, b2 int, asked int, star int")
    return (met.groupBy("c1", "c2", "b1", "b2")
            .agg(F.count("*").alias("n"), F.max("asked").alias("asked"), F.max("star").alias("star"))
            .where("star = 1 OR n >= asked").select("c1", "c2", "b1", "b2", "star"))


class Forest:
    """Union-find over numbers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[j] = i
        return i != j


def cross(ids: list[int], sizes: np.ndarray, lacks: np.ndarray, deltas: list[np.ndarray],
          to_centre: np.ndarray, centre_size: int, threshold: tuple[int, int]) -> Iterator[tuple[int, int]]:
    """Links among the members of one centre: enough of them to connect all that are linked.

    deltas: what a member has added or lacks, as sorted distinct numbers; lacks: how many it lacks;
    to_centre: whether it is linked to the centre, as which number 0 of the forest counts.
    """
    n = len(ids)
    forest = Forest(n + 1)
    for i in np.flatnonzero(to_centre).tolist():
        forest.join(0, i + 1)
    lonely = np.flatnonzero(~to_centre)
    if not len(lonely) or n < 2:
        return
    flat = np.concatenate(deltas)
    whose = np.repeat(np.arange(n), [len(d) for d in deltas])
    values, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    order = np.argsort(inverse, kind="stable")
    by_value, first = whose[order], np.cumsum(count) - count
    ends = np.cumsum([len(d) for d in deltas])
    need = np.array([least_overlap(s, threshold) for s in sizes.tolist()])
    for i in lonely.tolist():
        own = inverse[ends[i] - len(deltas[i]):ends[i]]
        # Links share at least so many differences, so one of the rarest len - asked + 1 is shared.
        asked = max(1, int(need[i]) - centre_size + int(lacks[i]))
        if asked > len(own):
            continue
        rare = own[np.argsort(count[own], kind="stable")][:len(own) - asked + 1]
        met = np.unique(np.concatenate([by_value[first[v]:first[v] + count[v]] for v in rare]))
        root = forest.find(i + 1)
        met = np.array([j for j in met.tolist() if forest.find(j + 1) != root], int)
        if not len(met):
            continue
        common = np.bincount(np.concatenate([by_value[first[v]:first[v] + count[v]] for v in own]),
                             minlength=n)[met]
        overlap = centre_size - lacks[i] - lacks[met] + common
        for j in met[linked(overlap, sizes[i], sizes[met], threshold)].tolist():
            if forest.join(i + 1, j + 1):
                yield ids[i], ids[j]


def dealt(members: DataFrame, part: int) -> DataFrame:
    """c1, c2, part, split, b1, b2, kind: the members of large groups in parts, the centre (kind 0) in each."""
    sizes = members.groupBy("c1", "c2").count()
    large = sizes.where(F.col("count") > part).select("c1", "c2", F.ceil(F.col("count") / part).cast("int").alias("parts"))
    rows = members.join(large, ["c1", "c2"], "left")
    own = F.array(F.pmod(F.xxhash64("b1", "b2"), F.col("parts")).cast("int"))
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    put = F.when(F.col("parts").isNull(), F.array(F.lit(0))).when(F.col("kind") == 0, every).otherwise(own)
    return rows.select("c1", "c2", F.explode(put).alias("part"), F.col("parts").isNotNull().alias("split"),
                       "b1", "b2", "kind")


def compare(groups: DataFrame, n: int, threshold: tuple[int, int]) -> DataFrame:
    """Compares the members of each centre. groups: c1, c2, part, split, kind (0: the centre itself, 1: to
    be compared with it alone, 2: with the other members too), rep, t. Gives a, b for links; and for the
    groups that are split, rows with centre, a, size, lacks, near and deltas instead of inner links."""
    def run(batches):
        now, centre, rep, members, out, rest = None, None, None, [], [], []
        batches = slices(batches, 256)

        def finish():
            if members:
                ids, sizes, lacks, deltas, near = zip(*members, strict=True)
                out.extend(cross(list(ids), np.array(sizes), np.array(lacks), list(deltas),
                                 np.array(near), len(centre), threshold))

        def batch_of():
            k, m = len(out), len(rest)
            r = list(zip(*rest, strict=True)) or [[]] * 7
            made = pa.RecordBatch.from_arrays(
                [pa.array([*(x[0] for x in out), *r[1]], pa.int64()),
                 pa.array([*(x[1] for x in out), *[None] * m], pa.int64()),
                 *(pa.array([*[None] * k, *r[i]], pa.int64()) for i in (0, 2, 3, 4)),
                 pa.array([*[None] * k, *r[5]], pa.bool_()),
                 pa.array([*[None] * k, *r[6]], pa.list_(pa.int64()))],
                ["a", "b", "centre", "size", "lacks", "centre_size", "near", "deltas"])
            out.clear()
            rest.clear()
            return made

        for batch in batches:
            sets = shingle_sets(batch["t"].to_pylist(), n)
            cols = [batch[c].to_pylist() for c in ("c1", "c2", "part", "split", "kind", "rep")]
            for c1, c2, part, split, kind, own, s in zip(*cols, sets, strict=True):
                if (c1, c2, part) != now:
                    finish()
                    now, centre, rep, members = (c1, c2, part), s, own, []
                    continue  # kind 0 comes first
                overlap = len(np.intersect1d(s, centre, assume_unique=True))
                near = bool(linked(overlap, len(s), len(centre), threshold))
                if near:
                    out.append((rep, own))
                if kind == 2:
                    delta, lacks = np.setxor1d(s, centre, assume_unique=True), len(centre) - overlap
                    if split:
                        rest.append((rep, own, len(s), lacks, len(centre), near, delta.view(np.int64).tolist()))
                    else:
                        members.append((own, len(s), lacks, delta, near))
            if out or rest:
                yield batch_of()
        finish()
        if out or rest:
            yield batch_of()
        give_back()

    order = groups.repartition("c1", "c2", "part").sortWithinPartitions("c1", "c2", "part", "kind")
    return order.mapInArrow(run, "a bigint, b bigint, centre bigint, size bigint, lacks bigint,"
                                 " centre_size bigint, near boolean, deltas array<bigint>")


def compare_rest(rest: DataFrame, threshold: tuple[int, int], part: int) -> DataFrame:
    """The links inside the groups that are split: each member not linked to the centre is sent to every
    part of its group, where an index of the members' differences counts what they share with it."""
    lonely = rest.where(~F.col("near"))
    asked = lonely.select("centre").distinct()
    parts = rest.join(asked, "centre", "left_semi").groupBy("centre").agg(
        F.ceil(F.count("*") / part).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("a"), F.col("parts")).cast("int")
    members = rest.join(parts, "centre").withColumns({"part": own, "kind": F.lit(0)})
    queries = lonely.join(parts, "centre").withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("kind", F.lit(1))
    columns = ["centre", "part", "kind", "a", "size", "lacks", "centre_size", "deltas"]

    def run(batches):
        now, held, index, out = None, [], None, []

        def built():
            """The members' ids, sizes and lacks, and their differences in order, with whose they are."""
            ids, sizes, lacks, deltas = zip(*held, strict=True)
            flat = np.concatenate(deltas)
            whose = np.repeat(np.arange(len(ids)), [len(d) for d in deltas])
            by = np.argsort(flat, kind="stable")
            number = {x: i for i, x in enumerate(ids)}
            return ids, np.array(sizes), np.array(lacks), flat[by], whose[by], number, Forest(len(ids))

        def links(a, size, lacks, centre_size, deltas):
            ids, sizes, their, flat, whose, number, forest = index
            lo, hi = np.searchsorted(flat, deltas), np.searchsorted(flat, deltas, "right")
            met = np.concatenate([whose[i:j] for i, j in zip(lo, hi, strict=True)] or [whose[:0]])
            common = np.bincount(met, minlength=len(ids))
            near = (common > 0) & linked(centre_size - lacks - their + common, size, sizes, threshold)
            # One link to each tree of the part joins all that are linked to it.
            first = number.get(a)
            for j in np.flatnonzero(near).tolist():
                if ids[j] != a and (first is None or forest.join(first, j)):
                    first = j if first is None else first
                    yield a, ids[j]

        for batch in batches:
            for c, p, kind, a, size, lacks, centre_size, deltas in zip(
                    *(batch[n].to_pylist() for n in columns), strict=True):
                if (c, p) != now:
                    now, held, index = (c, p), [], None
                deltas = np.array(deltas, np.int64)
                if kind == 0:  # members come first
                    held.append((a, size, lacks, deltas))
                elif held:
                    index = index or built()
                    out.extend(links(a, size, lacks, centre_size, deltas))
            if out:
                x, y = zip(*out, strict=True)
                out = []
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])
        give_back()

    rows = members.select(columns).unionAll(queries.select(columns))
    return rows.repartition("centre", "part").sortWithinPartitions("centre", "part", "kind").mapInArrow(
        run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, n: int = 5, threshold: tuple[int, int] = (80, 100),
                    text: str = "text", key: str = "doc_id", part: int = PART) -> DataFrame:
    """doc, body (xxhash64 of the text), n_shingles, component (least doc of its class): one row for
    each row of docs. threshold: links need threshold[1] * intersection >= threshold[0] * union."""
    parts = survey(docs, n, text, key)
    counts = sketch(parts)
    sets = parts.where("block IS NULL").select("doc", "body", "s1", "s2", "size")
    classes = (sets.where("size > 0 AND doc IS NOT NULL").groupBy("s1", "s2")
               .agg(F.min(F.struct("doc", "body")).alias("m"))
               .select("s1", "s2", F.col("m.doc").alias("rep"), F.col("m.body").alias("body")))
    met = stored(meetings(prefixes(docs, counts, n, threshold, text, key), threshold), "meetings")
    members = met.select("c1", "c2", "b1", "b2", (F.col("star") + 1).alias("kind")).unionAll(
        met.select("c1", "c2", F.col("c1").alias("b1"), F.col("c2").alias("b2"), F.lit(0)).distinct())
    members = stored(dealt(members, part), "members")
    wanted = members.select(F.col("b1").alias("s1"), F.col("b2").alias("s2")).distinct()
    reps = classes.join(wanted, ["s1", "s2"], "left_semi")
    texts = docs.select(F.col(key).cast("bigint").alias("rep"), F.xxhash64(text).alias("body"),
                        F.col(text).cast("string").alias("t"))
    found = reps.join(texts, ["rep", "body"]).select("s1", "s2", "rep", "t").dropDuplicates(["s1", "s2"])
    groups = members.join(found.withColumnsRenamed({"s1": "b1", "s2": "b2"}), ["b1", "b2"]).select(
        "c1", "c2", "part", "split", "kind", "rep", "t")
    compared = stored(compare(groups, n, threshold), "compared")
    edges = compared.where("centre IS NULL").select("a", "b").unionAll(
        compare_rest(compared.where("centre IS NOT NULL"), threshold, part))
    linked_to = components(edges, "a", "b").withColumnRenamed("node", "rep")
    ids = classes.select("s1", "s2", "rep").join(linked_to, "rep", "left").select(
        "s1", "s2", F.coalesce("component", "rep").alias("component"))
    searched = F.when((F.col("size") > 0) & F.col("doc").isNotNull(), F.col("s1"))
    return (sets.withColumn("s1", searched).join(ids, ["s1", "s2"], "left")
            .select("doc", "body", F.col("size").alias("n_shingles"),
                    F.coalesce("component", "doc").alias("component")))


def oracle(n: int, threshold: tuple[int, int], table: str = "documents") -> str:
    """The same in DuckDB SQL: all pairs that share a shingle, and a recursive walk over the links."""
    return f"""
    WITH RECURSIVE w AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM {table}),
    s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {n} THEN [array_to_string(w, ' ')]
            ELSE list_distinct(list_transform(range(1, len(w) - {n - 2}),
                               lambda i: array_to_string(w[i:i + {n - 1}], ' '))) END AS s FROM w),
    e AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id
          GROUP BY a.doc_id, b.doc_id, a.n, b.n
          HAVING {threshold[1]} * count(*) >= {threshold[0]} * (a.n + b.n - count(*))),
    l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
    c(id, other) AS (SELECT doc_id, doc_id FROM s UNION SELECT c.id, l.b FROM c JOIN l ON c.other = l.a)
    SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, m.component_id
    FROM s JOIN (SELECT id, min(other) AS component_id FROM c GROUP BY id) m ON m.id = s.doc_id"""
