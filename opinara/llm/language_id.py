"""Language identification: averaged hashed subword embeddings, a linear softmax, rejection.

A text becomes the mean of the embeddings of its hashed character n-grams (inside words, with word
edges); a linear layer and a softmax follow. Both are trained together by stochastic gradient
descent in numpy on a bounded sample, in one task of an executor. A temperature and a rejection
threshold are fitted on a part of the sample that training does not see, and on texts made from it that
have no one language: even mixtures of two, shuffled letters, and the rows of a class that a second
training leaves out. Since the layer is linear, embedding and layer fold into one table of class scores
per bucket, which is all that the executors need.

Defined cases: null, empty and letterless texts are `und` with score 0 and rejected; a text whose
n-grams were never trained gets the most likely class by the bias; equal texts get equal results;
very long texts are read in windows that end between words (a word of over `CHUNK_CHARS` letters
counts as several);
other columns of the input are kept in `predict(..., keep=...)` only when named. With no labelled
row at all everything is `und`; with one class alone no text that has a letter can be told from it.
"""

from __future__ import annotations

import random
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm.common import chunks, give_back, learn, map_batches, sample_per_class, slices

UNKNOWN = "und"
BUCKETS = 1 << 15
ORDERS = (2, 3, 4)
PER_CLASS = 400
CHUNK_CHARS = 500_000
#: A mixture with this share of one language has a majority, and is to be kept.
MAJORITY = 0.6
#: So many classes are left out in turn, each by a training of a part of the steps.
LEFT_OUT = 4
LEFT_OUT_STEPS = 3
#: Training reads a cut of so many characters of a longer text, at a place that the text itself decides.
SAMPLE_CHARS = 200_000
SHUFFLED_CHARS = 2000
_LETTERS: np.ndarray | None = None


@dataclass(frozen=True)
class Model:
    """Class names, a table of class scores per bucket, the bias, and the rejection threshold."""

    classes: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float


def _letters() -> np.ndarray:
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTERS


def subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of every n-gram, in text order for each n-gram length."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer(("\n".join(lowered) + "\n").encode("utf-32-le", "replace"), np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + 1 for t in lowered])
    letter = _letters()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    points, owner, letter = points[keep], owner[keep], letter[keep]
    # One mark of a word's edge at the front, then letters and edges alternate as they stand.
    points = np.concatenate(([np.uint32(0)], np.where(letter, points, np.uint32(0))))
    letter = np.concatenate(([False], letter))
    owner = np.concatenate(([np.int32(0)], owner))
    owners, buckets = [], []
    inner = np.ones(max(0, len(points) - 1), bool)
    for n in range(2, max(ORDERS) + 1):
        count = len(points) - n + 1
        if count <= 0:
            break
        if n > 2:
            inner = inner[:count] & letter[n - 2:n - 2 + count]
        if n not in ORDERS:
            continue
        h = np.full(count, n, np.uint32)
        for j in range(n):
            h = (h ^ points[j:j + count]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        use = inner[:count] & (letter[:count] | letter[1:count + 1])
        owners.append(owner[1:count + 1][use])
        buckets.append((h[use] & np.uint32(BUCKETS - 1)).astype(np.int32))
    if not owners:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    return np.concatenate(owners), np.concatenate(buckets)


def _cut(text: str, size: int) -> str:
    """A text of at most that size whole, else so much of it from a place that its hash decides."""
    rest = len(text) - size
    return text if rest <= 0 else text[(at := _seed(text) % (rest + 1)):at + size]


def _seed(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace"))


def _spans(text: str) -> list[str]:
    """The text (a cut of a very long one) and three short cuts, so that short texts are learned as well."""
    text = _cut(text, SAMPLE_CHARS)
    n = len(text)
    return [text, *(text[n * k // 4:n * k // 4 + 40 * k] for k in (1, 2, 3) if n > 160)]


def _shuffled(text: str) -> str:
    """A cut of a text with its letters in another order, and all else in place."""
    text = _cut(text, SHUFFLED_CHARS)
    letters = [c for c in text if c.isalpha()]
    random.Random(_seed(text)).shuffle(letters)
    rest = iter(letters)
    return "".join(next(rest) if c.isalpha() else c for c in text)


def fit(rows: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id",
        per_class: int = PER_CLASS, dim: int = 16, steps: int = 30_000, rate: float = 0.5,
        most_errors: float = 0.01, seed: int = 7) -> Model:
    """Trains on about per_class labelled rows of each class (twice as many at most)."""
    sample = sample_per_class(rows.where(F.col(text).isNotNull()), label, key, per_class)
    sample = sample.select(F.col(text).alias("t"), F.col(label).cast("string").alias("y"))

    def features(batch):
        out = {"y": [], "odd": [], "ids": [], "n": []}
        for t, y in zip(batch["t"].to_pylist(), batch["y"].to_pylist(), strict=True):
            for odd, span in [*((False, x) for x in _spans(t)), (True, _shuffled(t))]:
                ids, n = np.unique(subwords([span])[1], return_counts=True)
                if len(ids):
                    out["y"].append(y)
                    out["odd"].append(odd)
                    out["ids"].append(ids.astype(np.int32).tobytes())
                    out["n"].append(n.astype(np.int32).tobytes())
        return pa.RecordBatch.from_pydict(out)

    found = map_batches(sample, features, "y string, odd boolean, ids binary, n binary")
    return learn(found, lambda got: _fitted(got, dim, steps, rate, most_errors, seed))


def _fitted(got: list[dict], dim: int, steps: int, rate: float, most_errors: float, seed: int) -> Model:
    """The model of feature rows: class, whether the letters were shuffled, buckets and counts."""
    classes = tuple(sorted({r["y"] for r in got}))
    if not classes:
        return Model((), np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 1.0)
    data, shuffled = [], []
    got.sort(key=lambda r: (r["y"], *map(xxhash.xxh64_intdigest, (r["ids"], r["n"]))))
    for r in got:
        (shuffled if r["odd"] else data).append(
            (classes.index(r["y"]), np.frombuffer(r["ids"], np.int32), np.frombuffer(r["n"], np.int32)))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(data))
    held, used = [data[i] for i in order[:len(order) // 5]], [data[i] for i in order[len(order) // 5:]]
    table, bias = _train(used, len(classes), dim, steps, rate, rng)
    raw, truth = _raw(table, bias, held), np.array([y for y, _, _ in held], int)
    # The layer is linear, so the scores of a mixture are the mixture of the scores.
    pairs = rng.permutation(len(held)), rng.permutation(len(held))
    first, second = (x[truth[pairs[0]] != truth[pairs[1]]] for x in pairs)
    even = (raw[first] + raw[second]) / 2
    major = MAJORITY * raw[first] + (1 - MAJORITY) * raw[second]
    temperature = _temperature(raw, truth, even, truth[first], truth[second])
    odd = [even, _raw(table, bias, shuffled[::5])]
    odd = [_softmax(x / temperature).max(1) for x in odd]
    for c in rng.permutation(len(classes))[:LEFT_OUT].tolist() if len(classes) > 2 else ():
        def without(rows, c=c):
            return [(y - (y > c), ids, n) for y, ids, n in rows if y != c]
        own, left = without(held), [x for x in held if x[0] == c]
        if own and left:
            t, b = _train(without(used), len(classes) - 1, dim, steps // LEFT_OUT_STEPS, rate, rng)
            other, y = _raw(t, b, own), np.array([y for y, _, _ in own], int)
            i, j = rng.permutation(len(own)), rng.permutation(len(own))
            i, j = i[y[i] != y[j]], j[y[i] != y[j]]
            warm = _temperature(other, y, (other[i] + other[j]) / 2, y[i], y[j])
            odd.append(_softmax(_raw(t, b, left) / warm).max(1))
    p = _softmax(np.concatenate((raw, major)) / temperature)
    return Model(classes, table.astype(np.float32), bias, temperature,
                 _threshold(p, np.concatenate((truth, truth[first])), np.concatenate(odd), most_errors))


def _train(data: list[tuple], n_classes: int, dim: int, steps: int, rate: float,
           rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """The table of class scores and the bias, learned from rows of class, buckets and counts."""
    emb = rng.uniform(-1, 1, (BUCKETS, dim)).astype(np.float32) / dim
    out, bias = np.zeros((dim, n_classes), np.float32), np.zeros(n_classes)
    # As many steps for few rows as for many, so that little data is learned as well.
    epochs, done = max(1, steps // max(1, len(data))), 0
    for _ in range(epochs):
        for i in rng.permutation(len(data)):
            y, ids, n = data[i]
            share = (n / n.sum()).astype(np.float32)[:, None]
            mean = (emb[ids] * share).sum(0)
            p = _softmax(mean @ out + bias)
            p[y] -= 1
            step = rate * (1 - done / (epochs * len(data)))
            back = (out @ p).astype(np.float32)
            out -= (step * np.outer(mean, p)).astype(np.float32)
            bias -= step * 0.1 * p
            emb[ids] -= step * share * back
            done += 1
    return emb @ out, bias


def _raw(table: np.ndarray, bias: np.ndarray, rows: list[tuple]) -> np.ndarray:
    """The class scores of rows of class, buckets and counts."""
    return np.array([(table[ids] * (n / n.sum())[:, None]).sum(0) + bias for _, ids, n in rows]
                    or np.zeros((0, len(bias))))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _temperature(raw: np.ndarray, truth: np.ndarray, even: np.ndarray, one: np.ndarray,
                 two: np.ndarray) -> float:
    """The temperature with the least negative log likelihood on rows that training did not see and on
    even mixtures, of which either class is half right. Without mixtures, rows that are all told
    rightly would ask for a temperature of zero."""
    if not len(truth):
        return 1.0
    grid, loss = np.geomspace(0.05, 5, 40), []
    for t in grid:
        loss.append(-np.log(_softmax(raw / t)[np.arange(len(truth)), truth] + 1e-12).mean())
        if len(even):
            p, at = np.log(_softmax(even / t) + 1e-12), np.arange(len(even))
            loss[-1] -= (p[at, one] + p[at, two]).mean() / 2
    return float(grid[int(np.argmin(loss))])


def _threshold(p: np.ndarray, truth: np.ndarray, odd: np.ndarray, most_errors: float) -> float:
    """The lowest confidence above which at most that share of the unseen rows is wrong, and which at
    most that share of the odd texts (confidences) reaches; but not so high that more than that share
    of the rows told rightly is rejected. It is above the confidence of a text that says nothing."""
    best, wrong = p.max(1), p.argmax(1) != truth
    least = 1.0 if p.shape[1] < 2 else 1.01 / p.shape[1]
    if not len(truth) or wrong.all():
        return least
    order = np.argsort(-best, kind="stable")
    share = np.cumsum(wrong[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(share <= most_errors)
    want = 1.0 if not len(good) else float(best[order][good[-1]]) if good[-1] + 1 < len(order) else 0.0
    if len(odd):
        want = max(want, float(np.quantile(odd, 1 - most_errors)))
    return max(least, min(want, float(np.quantile(best[~wrong], most_errors))))


def _windows(text: str, most: int) -> list[str]:
    """The text in windows of about that size; n-grams end at word edges, so none is lost or new."""
    out, at = [], 0
    while len(text) - at > most:
        end = at + most
        while end > at and text[end - 1].isalpha():
            end -= 1
        end = end if end > at else at + most
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def _sums(m: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For every text the sum of its n-grams' class scores, and their number."""
    sums, count = np.zeros((len(texts), len(m.classes))), np.zeros(len(texts))
    owner, bucket = subwords(texts)
    edges = np.flatnonzero(np.diff(owner, prepend=-1))
    if len(edges):
        np.add.at(sums, owner[edges], np.add.reduceat(m.table[bucket], edges, axis=0, dtype=np.float64))
        count = np.bincount(owner, minlength=len(texts)).astype(float)
    return sums, count


def classify(m: Model, texts: list[str | None]) -> tuple[list[str | None], np.ndarray]:
    """The likeliest class of each text and its calibrated probability; None without a letter."""
    best, conf = [None] * len(texts), np.zeros(len(texts))
    for first, part in chunks(texts, CHUNK_CHARS) if m.classes else ():
        if len(part) == 1 and len(part[0]) > CHUNK_CHARS:
            sums, count = map(sum, zip(*(_sums(m, [x]) for x in _windows(part[0], CHUNK_CHARS)),
                                       strict=True))
        else:
            sums, count = _sums(m, part)
        for i in range(len(part)):
            if count[i]:
                p = _softmax((sums[i] / count[i] + m.bias) / m.temperature)
                best[first + i], conf[first + i] = m.classes[int(p.argmax())], float(p.max())
    return best, conf


def accepted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs that are not rejected, with all their columns unchanged."""
    at, shared = docs.columns.index(text), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in slices(batches):
            best, conf = classify(shared.value, batch.column(at).to_pylist())
            keep = np.array([b is not None and c >= shared.value.threshold
                             for b, c in zip(best, conf, strict=True)], bool)
            if keep.any():
                yield batch.filter(pa.array(keep))
        give_back()

    return docs.mapInArrow(run, docs.schema)


def predict(docs: DataFrame, model: Model, keep: Sequence[str], text: str = "text") -> DataFrame:
    """The columns in keep, and lang_pred, score (0 to 1) and rejected for every row."""
    names = [f"k{i}" for i in range(len(keep))]
    cols = [F.col(c).alias(n) for c, n in zip(keep, names, strict=True)]
    cols.append(F.col(text).cast("string").alias("t"))
    narrow = docs.select(*cols)
    types = {f.name: f.dataType.simpleString() for f in narrow.schema}
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batch):
        m = shared.value
        best, conf = classify(m, batch["t"].to_pylist())
        found = [b or UNKNOWN for b in best]
        rejected = [b is None or c < m.threshold for b, c in zip(best, conf, strict=True)]
        return pa.RecordBatch.from_arrays(
            [*(batch[n] for n in names), pa.array(found, pa.string()), pa.array(conf, pa.float64()),
             pa.array(rejected, pa.bool_())], [*names, "lang_pred", "score", "rejected"])

    schema = ", ".join([*(f"{n} {types[n]}" for n in names),
                        "lang_pred string, score double, rejected boolean"])
    done = map_batches(narrow, score, schema)
    return done.select(*(F.col(n).alias(c) for n, c in zip(names, keep, strict=True)),
                       "lang_pred", "score", "rejected")
