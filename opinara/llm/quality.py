"""Quality classifier: attention-based multiple-instance learning over the passages of a document.

A document is cut into passages of `WORDS` words; every passage of the whole text becomes a vector
of character-class, word and repetition figures, is encoded by a small tanh layer, and gets a
weight from a gated attention layer, normalised over the document. The weighted sum of the encoded
passages is scored by a logistic layer. Only document labels are used: the attention learns which
passages decide. All layers are trained together (Adam, numpy) on a bounded, class-balanced sample,
in one task of an executor; the bias is then set back to the class shares of all labelled rows.

Defined cases: null and empty texts count as one passage without words and get a score like any
other; very long texts have many passages, all of which are scored, a window of the text at a time
(only training keeps to `SAMPLE_PASSAGES` of a document); a passage of over `CHUNK_CHARS` characters
counts as several; equal texts get equal scores; without labelled rows every score is 0.5. Only the
columns named in keep are returned besides.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm.common import CHUNK_CHARS, chunks, learn, map_batches, mix, sample_per_class

WORDS = 48
PER_CLASS = 1000
#: Of a sampled document with more passages, training sees so many, evenly spread.
SAMPLE_PASSAGES = 512
#: Kinds of characters: separator within docs, lower, upper, digit, blank, line end, sentence and
#: clause marks, quotes, brackets, dashes, other ASCII signs, letters and signs beyond ASCII.
KINDS = 12
_KIND: np.ndarray | None = None
N_FEATURES = KINDS * KINDS + 9
DOC_WORDS = KINDS * KINDS + 5  # the one feature of a passage that needs the whole document


def _kinds() -> np.ndarray:
    global _KIND
    if _KIND is None:
        kind = np.full(0x110000, 11, np.uint8)
        for i in range(0x3000):
            ch = chr(i)
            if ch.isalpha():
                kind[i] = 2 if ch.isupper() else 1
            elif ch.isdigit():
                kind[i] = 3
            elif ch == "\n":
                kind[i] = 5
            elif ch.isspace():
                kind[i] = 4
            elif i < 128:
                kind[i] = {".": 6, ",": 6, ";": 6, ":": 6, "?": 6, "!": 10, "'": 7, '"': 7,
                           "(": 8, ")": 8, "[": 8, "]": 8, "-": 9}.get(ch, 10)
        kind[0x3000:0xA000] = 1
        kind[0] = 0
        _KIND = kind
    return _KIND


def passages(texts: list[str], end: str = "\n") -> tuple[np.ndarray, np.ndarray]:
    """(text number of every passage, its features), passages in order, one at least for each."""
    points = np.frombuffer(("\n".join(texts) + end).encode("utf-32-le", "replace"), np.uint32)
    lengths = np.array([len(t) + 1 for t in texts])
    lengths[-1] += len(end) - 1
    owner = np.repeat(np.arange(len(texts)), lengths)
    kind = _kinds()[points]
    blank = (kind == 4) | (kind == 5)
    before = np.concatenate(([True], blank[:-1]))
    start = ~blank & before
    word = np.cumsum(start)  # words up to and with this one
    firsts = np.cumsum(lengths) - lengths
    base = word[firsts] - start[firsts]
    in_text = np.maximum(word - base[owner] - 1, 0)
    per_text = np.maximum(1, -(-(word[firsts + lengths - 1] - base) // WORDS))
    offset = np.cumsum(per_text) - per_text
    passage = offset[owner] + np.minimum(in_text // WORDS, per_text[owner] - 1)
    total = int(per_text.sum())
    whose = np.repeat(np.arange(len(texts)), per_text)
    size = np.bincount(passage, minlength=total).astype(float)
    same = passage[1:] == passage[:-1]
    pair = passage[1:].astype(np.int64) * (KINDS * KINDS) + kind[:-1].astype(np.int64) * KINDS + kind[1:]
    grams = np.bincount(pair[same], minlength=total * KINDS * KINDS).reshape(total, -1)
    feats = np.zeros((total, N_FEATURES), np.float32)
    feats[:, :KINDS * KINDS] = np.sqrt(grams / size[:, None])
    n_words = np.bincount(passage[start], minlength=total)
    at = np.flatnonzero(start)
    if len(at):
        # A hash of each word: a sum of scrambled characters, each scrambled with its place.
        index = np.flatnonzero(~blank)
        place = index - at[word[index] - 1]
        h = mix(points[index].astype(np.uint64) + (place.astype(np.uint64) << np.uint64(32)))
        h = np.add.reduceat(h, np.searchsorted(index, at))
        owners = passage[at]
        order = np.lexsort((h, owners))
        o, s = owners[order], h[order]
        fresh = np.concatenate(([True], (o[1:] != o[:-1]) | (s[1:] != s[:-1])))
        distinct = np.bincount(o[fresh], minlength=total)
        length = np.diff(np.append(at, len(points)))
        long = np.bincount(owners, np.minimum(length, 60), minlength=total)
        square = np.bincount(owners, np.minimum(length, 60) ** 2.0, minlength=total)
        again = np.bincount(owners[1:], (h[1:] == h[:-1]) & (owners[1:] == owners[:-1]), minlength=total)
    else:
        distinct = long = square = again = np.zeros(total)
    n = np.maximum(n_words, 1)
    docs_words = np.bincount(whose, n_words)[whose]
    feats[:, KINDS * KINDS:] = np.stack([
        distinct / n, long / n / 10, np.sqrt(np.maximum(square / n - (long / n) ** 2, 0)) / 10,
        again / n, np.log1p(n_words) / 4, np.log1p(docs_words) / 8, n_words == 0,
        np.log1p(size) / 8, 1 / n], 1)
    return whose, feats


def windows(text: str, most: int = CHUNK_CHARS) -> Iterator[str]:
    """The text in windows of at most that size, each with whole passages."""
    at = 0
    while len(text) - at > most:
        kind = _kinds()[np.frombuffer(text[at:at + most].encode("utf-32-le", "replace"), np.uint32)]
        blank = (kind == 4) | (kind == 5)
        start = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
        whole = max(0, len(start) - 1) // WORDS * WORDS
        end = at + (int(start[whole]) if whole else most)
        yield text[at:end]
        at = end
    yield text[at:]


def long_passages(text: str, most: int = CHUNK_CHARS) -> Iterator[np.ndarray]:
    """The features of a long text's passages, a window at a time."""
    n_words, left = sum(_counted(w) for w in windows(text, most)), len(text)
    for window in windows(text, most):
        left -= len(window)
        feats = passages([window], "" if left else "\n")[1]
        feats[:, DOC_WORDS] = np.log1p(n_words) / 8
        yield feats


def _counted(window: str) -> int:
    kind = _kinds()[np.frombuffer(window.encode("utf-32-le", "replace"), np.uint32)]
    blank = (kind == 4) | (kind == 5)
    return np.count_nonzero(~blank & np.concatenate(([True], blank[:-1])))


def _sampled(text: str) -> tuple[np.ndarray, np.ndarray]:
    """As passages([text]), for a long text, with SAMPLE_PASSAGES of each window at most."""
    feats = np.concatenate([f[np.linspace(0, len(f) - 1, min(len(f), SAMPLE_PASSAGES)).astype(int)]
                            for f in long_passages(text)])
    return np.zeros(len(feats), int), feats


@dataclass(frozen=True)
class Model:
    """Scaling of the features and the weights of the layers; None where nothing was learned."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray] | None


def _attended(w, x):
    """Encoded passages, both parts of their gate, and their unnormalised weights."""
    h = np.tanh(x @ w["enc"] + w["enc_b"])
    t, g = np.tanh(h @ w["att"]), 1 / (1 + np.exp(-(h @ w["gate"])))
    return h, t, g, np.exp(np.clip((t * g) @ w["pick"], -30, 30))


def _top(w, z):
    return 1 / (1 + np.exp(-np.clip(z @ w["top"] + w["top_b"], -30, 30)))


def _forward(w, x, whose, n):
    """Scores of n documents, and what the backward pass needs. x: scaled passages, in order."""
    h, t, g, e = _attended(w, x)
    a = e / np.bincount(whose, e, n)[whose]
    z = np.stack([np.bincount(whose, a * h[:, j], n) for j in range(h.shape[1])], 1)
    return _top(w, z), (h, t, g, a, z)


def _gradients(w, x, whose, p, y, kept):
    h, t, g, a, z = kept
    d = (p - y) / len(y)
    out = {"top": z.T @ d, "top_b": np.array([d.sum()])}
    dz = d[:, None] * w["top"]
    da = (dz[whose] * h).sum(1)
    de = a * (da - np.bincount(whose, a * da, len(y))[whose])
    out["pick"] = (t * g).T @ de
    dtg = de[:, None] * w["pick"]
    dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
    out["att"], out["gate"] = h.T @ dt, h.T @ dg
    dh = a[:, None] * dz[whose] + dt @ w["att"].T + dg @ w["gate"].T
    dh *= 1 - h * h
    return out | {"enc": x.T @ dh, "enc_b": dh.sum(0)}


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality",
        key: str = "doc_id", per_class: int = PER_CLASS, width: int = 24, epochs: int = 25,
        rate: float = 0.01, decay: float = 1e-4, seed: int = 5) -> Model:
    """Trains on about per_class rows of label 0 and as many of label 1 (twice that at most).

    The sample is drawn from the labels alone, so it is of bounded size when it meets the texts.
    """
    rows = labels.select(F.col(label).cast("int").alias("y"), F.col(key).alias("k")).where(
        F.col("y").isin(0, 1))
    shares = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    sample = F.broadcast(sample_per_class(rows, "y", "k", per_class))
    texts = docs.select(F.col(text).alias("t"), F.col(key).alias("k"))

    def encode(batch):
        out = {"y": [], "x": []}
        labels = batch["y"].to_pylist()
        for first, part in chunks(batch["t"].to_pylist()):
            long = len(part) == 1 and len(part[0]) > CHUNK_CHARS
            whose, feats = _sampled(part[0]) if long else passages(part)
            cuts = np.searchsorted(whose, np.arange(len(part) + 1))
            for i in range(len(part)):
                n = cuts[i + 1] - cuts[i]
                some = cuts[i] + np.arange(min(n, SAMPLE_PASSAGES)) * n // min(n, SAMPLE_PASSAGES)
                out["y"].append(labels[first + i])
                out["x"].append(feats[some].astype(np.float16).tobytes())
        return pa.RecordBatch.from_pydict({"y": pa.array(out["y"], pa.int32()), "x": out["x"]})

    found = map_batches(texts.join(sample, "k").select("t", "y"), encode, "y int, x binary")
    return learn(found, lambda got: _fitted(got, shares, width, epochs, rate, decay, seed))


def _fitted(got: list[dict], shares: dict[int, int], width: int, epochs: int, rate: float,
            decay: float, seed: int) -> Model:
    """The model of rows of a label and a document's passages; shares: labelled rows of each label."""
    if not got:
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), None)
    got.sort(key=lambda r: (r["y"], r["x"]))
    bags = [np.frombuffer(r["x"], np.float16).reshape(-1, N_FEATURES).astype(np.float32) for r in got]
    y = np.array([r["y"] for r in got], float)
    every = np.concatenate(bags)
    mean, scale = every.mean(0), every.std(0) + 0.02
    bags = [(b - mean) / scale for b in bags]
    rng = np.random.default_rng(seed)
    w = {"enc": rng.normal(0, N_FEATURES ** -0.5, (N_FEATURES, width)), "enc_b": np.zeros(width),
         "att": rng.normal(0, width ** -0.5, (width, width // 2)),
         "gate": rng.normal(0, width ** -0.5, (width, width // 2)),
         "pick": rng.normal(0, width ** -0.5, width // 2),
         "top": rng.normal(0, width ** -0.5, width), "top_b": np.zeros(1)}
    one = {k: np.zeros_like(v) for k, v in w.items()}
    two = {k: np.zeros_like(v) for k, v in w.items()}
    step = 0
    for epoch in range(epochs):
        for part in np.array_split(rng.permutation(len(bags)), max(1, len(bags) // 32)):
            x = np.concatenate([bags[i] for i in part])
            whose = np.repeat(np.arange(len(part)), [len(bags[i]) for i in part])
            p, kept = _forward(w, x, whose, len(part))
            grads, step = _gradients(w, x, whose, p, y[part], kept), step + 1
            for k, v in grads.items():
                v = v + decay * w[k]
                one[k] = 0.9 * one[k] + 0.1 * v
                two[k] = 0.999 * two[k] + 0.001 * v * v
                w[k] = w[k] - rate * (1 - epoch / epochs) * (one[k] / (1 - 0.9 ** step)) / (
                    np.sqrt(two[k] / (1 - 0.999 ** step)) + 1e-8)
    # Back from the balanced sample to the shares of all labelled rows.
    odds = (shares.get(1, 0) + 1) / (shares.get(0, 0) + 1) * ((y == 0).sum() + 1) / ((y == 1).sum() + 1)
    w["top_b"] = w["top_b"] + np.log(odds)
    return Model(mean, scale, w)


def _scaled(m: Model, feats: np.ndarray) -> np.ndarray:
    """Features in half precision, as in training, then scaled."""
    return (feats.astype(np.float16).astype(float) - m.mean) / m.scale


def _long_score(m: Model, text: str) -> tuple[float, int]:
    """The score of one long text and its number of passages: weighted sums, added up by window."""
    total, weight, n = 0.0, 0.0, 0
    for feats in long_passages(text):
        n += len(feats)
        if m.weights is not None:
            h, _, _, e = _attended(m.weights, _scaled(m, feats))
            total, weight = total + e @ h, weight + e.sum()
    if m.weights is None:
        return 0.5, n
    return round(float(_top(m.weights, (total / weight)[None])[0]), 9), n


def score(docs: DataFrame, model: Model, keep: Sequence[str], text: str = "text") -> DataFrame:
    """The columns in keep, score (0 to 1, higher: label 1 likelier) and n_passages."""
    names = [f"k{i}" for i in range(len(keep))]
    cols = [F.col(c).alias(n) for c, n in zip(keep, names, strict=True)]
    cols.append(F.col(text).cast("string").alias("t"))
    narrow = docs.select(*cols)
    types = {f.name: f.dataType.simpleString() for f in narrow.schema}
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch):
        m, scores, count = shared.value, [], []
        for _, part in chunks(batch["t"].to_pylist()):
            if len(part) == 1 and len(part[0]) > CHUNK_CHARS:
                p, n = _long_score(m, part[0])
                scores.append(np.array([p]))
                count.append(np.array([n]))
                continue
            whose, feats = passages(part)
            count.append(np.bincount(whose, minlength=len(part)))
            if m.weights is None:
                scores.append(np.full(len(part), 0.5))
            else:
                # Rounded, since the last bits depend on where in a batch a text stands.
                scores.append(np.round(_forward(m.weights, _scaled(m, feats), whose, len(part))[0], 9))
        return pa.RecordBatch.from_arrays(
            [*(batch[n] for n in names), pa.array(np.concatenate(scores).astype(float)),
             pa.array(np.concatenate(count).astype(np.int64))], [*names, "score", "n_passages"])

    schema = ", ".join([*(f"{n} {types[n]}" for n in names), "score double, n_passages bigint"])
    done = map_batches(narrow, work, schema)
    return done.select(*(F.col(n).alias(c) for n, c in zip(names, keep, strict=True)),
                       "score", "n_passages")
