"""Quality rules as a bitmask ledger: every rule is evaluated once, policies and ablations read bits.

One pass over the whole texts writes measurements; the rules are expressions over these, and each sets
one bit of `failed`. A rule keeps its bit for ever. A policy is a version number and the rules it asks
for, so it is a mask: a document is kept when failed & mask is zero. Another policy, and what each rule
does within one (documents that fail it, that fail it alone, that are kept without it), are bitwise
aggregates over the stored ledger; no text is read again.

Measurements are exact but for words and lines, which are compared by 64-bit hashes and by 128-bit
digests in very long texts. Defined cases: a null text is empty, has no words and fails the rule for
short texts; only space, tab and line ends divide words; very long texts are read in windows, with
the figures of the whole text; equal texts get equal rows; a null or repeated key is kept as it
is; other columns are returned only when named in keep; an empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.llm.common import CHUNK_CHARS, chunks, map_batches, mix
from opinara.llm.repeats import word_hashes

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended",
            "n_letters", "n_upper", "n_lettered")
_SPACE = b" \t\n\v\f\r"
_ENDS = tuple(c.encode() for c in ".!?:;\"')”»…")


def _table(signs: bytes) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(signs)] = 1
    return out


_SYMBOL, _UPPER = _table(b"#*$%&|<>"), _table(bytes(range(65, 91)))
_LETTER = _table(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(0xC0, 0x100)))
_BODY = 1 - _table(_SPACE + bytes(range(0x80, 0xC0)))  # the first byte of every character of a word

#: Rule -> (its bit, when it fails). Bits are never given to another rule.
RULES: dict[str, tuple[int, Callable[[], Column]]] = {
    "short": (0, lambda: F.col("n_words") < 50),
    "repeated_words": (1, lambda: 100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    "symbols": (2, lambda: 10 * F.col("n_symbols") > F.col("n_words")),
    "repeated_lines": (3, lambda: 10 * F.col("n_dup_lines") > 3 * F.col("n_lines")),
    "word_length": (4, lambda: (F.col("word_chars") < 3 * F.col("n_words"))
                    | (F.col("word_chars") > 10 * F.col("n_words"))),
    "open_lines": (5, lambda: 2 * F.col("n_ended") < F.col("n_lines")),
    "capitals": (6, lambda: 10 * F.col("n_upper") > 3 * F.col("n_letters")),
    "words_without_letters": (7, lambda: 10 * F.col("n_lettered") < 8 * F.col("n_words")),
}
BASE = ("short", "repeated_words")
#: Version -> the rules that a kept document must pass.
POLICIES: dict[int, tuple[str, ...]] = {
    1: BASE,
    2: (*BASE, "symbols", "repeated_lines", "word_length"),
    3: (*BASE, "symbols", "repeated_lines", "word_length", "open_lines", "capitals", "words_without_letters"),
}
LATEST = max(POLICIES)


def mask(rules: Sequence[str]) -> int:
    return sum(1 << RULES[r][0] for r in rules)


def _windows(raw: bytes, most: int) -> Iterator[bytes]:
    """A long text in windows that end behind a space or line end, where there is one."""
    at = 0
    while len(raw) - at > most:
        end = max(raw.rfind(s, at, at + most) for s in (b" ", b"\n", b"\t"))
        end = end + 1 if end >= at else next(
            (i for i in range(at + most, len(raw)) if raw[i] in _SPACE), len(raw) - 1) + 1
        yield raw[at:end]
        at = end
    yield raw[at:]


def repeated(owner: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which words stand in a run of three words that their text holds twice or more."""
    cover = np.zeros(len(h), bool)
    if len(h) < 3:
        return cover
    g = mix(h[:-2] * np.uint64(0x9E3779B97F4A7C15) + mix(h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:]))
    at = np.flatnonzero(owner[:-2] == owner[2:])
    at = at[np.lexsort((g[at], owner[at]))]
    same = (g[at][1:] == g[at][:-1]) & (owner[at][1:] == owner[at][:-1])
    hit = np.zeros(len(at), bool)
    hit[1:] |= same
    hit[:-1] |= same
    for k in range(3):
        cover[at[hit] + k] = True
    return cover


def _line_figures(raw: bytes) -> tuple[int, int, int]:
    """Lines with a word, those equal to an earlier one, and those that end with a mark."""
    seen: set[bytes] = set()
    n = ended = at = 0
    while at <= len(raw):
        end = raw.find(b"\n", at)
        line = raw[at:len(raw) if end < 0 else end]
        body = line.rstrip(_SPACE)
        if body:
            n += 1
            ended += body.endswith(_ENDS)
            seen.add(xxhash.xxh128_digest(line) if len(raw) > CHUNK_CHARS else line)
        at = len(raw) + 1 if end < 0 else end + 1
    return n, n - len(seen), ended


def measure(texts: list[str | None], most: int = CHUNK_CHARS) -> dict[str, np.ndarray]:
    """The measurements of every text."""
    out = {m: np.zeros(len(texts), np.int64) for m in MEASURES}
    for first, part in chunks(texts, most):
        raw = [t.encode("utf-8", "replace") for t in part]
        for i, r in enumerate(raw):
            out["n_lines"][first + i], out["n_dup_lines"][first + i], out["n_ended"][first + i] = _line_figures(r)
        pieces = [raw] if len(raw) > 1 or len(raw[0]) <= most else ([w] for w in _windows(raw[0], most))
        owners, hashes = [], []
        for piece in pieces:
            at = first + np.arange(len(piece))
            x = np.frombuffer(b"\n".join(piece) + b"\n", np.uint8)
            starts = np.cumsum([0, *(len(p) + 1 for p in piece[:-1])])
            for name, table in (("word_chars", _BODY), ("n_symbols", _SYMBOL), ("n_letters", _LETTER),
                                ("n_upper", _UPPER)):
                out[name][at] += np.add.reduceat(table[x], starts)
            owner, begin, h = word_hashes(piece)
            out["n_words"][at] += np.bincount(owner, minlength=len(piece))
            if len(begin):
                lettered = np.add.reduceat(_LETTER[x], begin) > 0
                out["n_lettered"][at] += np.bincount(owner[lettered], minlength=len(piece))
            owners.append(owner)
            hashes.append(h)
        owner = np.concatenate(owners)
        cover = repeated(owner, np.concatenate(hashes))
        out["n_repeat_words"][first:first + len(part)] = np.bincount(owner[cover], minlength=len(part))
    return out


def ledger(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns in keep, all measurements, and failed: one bit for each rule."""
    names = [f"k{i}" for i in range(len(keep))]
    narrow = docs.select(*(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)),
                         F.col(text).cast("string").alias("t"))
    types = {f.name: f.dataType.simpleString() for f in narrow.schema}

    def work(batch):
        found = measure(batch["t"].to_pylist())
        return pa.RecordBatch.from_arrays(
            [*(batch[n] for n in names), *(pa.array(found[m]) for m in MEASURES)], [*names, *MEASURES])

    schema = ", ".join([*(f"{n} {types[n]}" for n in names), *(f"{m} bigint" for m in MEASURES)])
    bits = [F.when(fails(), F.lit(1 << bit)).otherwise(F.lit(0)) for bit, fails in RULES.values()]
    failed = sum(bits[1:], bits[0]).cast("bigint")
    return map_batches(narrow, work, schema).select("*", failed.alias("failed")).toDF(
        *keep, *MEASURES, "failed")


def passes(version: int = LATEST, policies: Mapping[int, Sequence[str]] = POLICIES) -> Column:
    """Whether a row of the ledger is kept under a policy."""
    return F.col("failed").bitwiseAND(F.lit(mask(policies[version]))) == 0


def ablations(rows: DataFrame, policies: Mapping[int, Sequence[str]] = POLICIES) -> DataFrame:
    """version, rule, n, kept, fails, fails_alone, kept_without for every rule of every policy.

    fails_alone: documents that no other rule of the policy drops; kept_without: documents kept by the
    policy without the rule. One aggregate of bits over the ledger, counted in each task first.
    """
    failed = F.col("failed")

    def count(bits: int, value: int) -> Column:
        return F.count_if(failed.bitwiseAND(F.lit(bits)) == value)

    figures = []
    for version, rules in policies.items():
        whole = mask(rules)
        for rule in rules:
            bit = mask([rule])
            figures.append(F.struct(
                F.lit(version).alias("version"), F.lit(rule).alias("rule"),
                F.count(F.lit(1)).alias("n"), count(whole, 0).alias("kept"), count(bit, bit).alias("fails"),
                count(whole, bit).alias("fails_alone"), count(whole & ~bit, 0).alias("kept_without")))
    return rows.agg(F.array(*figures).alias("figures")).select(F.inline("figures"))


def oracle(table: str = "documents") -> str:
    """The query in DuckDB SQL, from words and lines as they stand."""
    word, body = r"'[^\x20\x09-\x0D]+'", r"'[^\x20\x09-\x0D]'"
    bits = {
        "short": "n_words < 50", "repeated_words": "100 * n_repeat_words > 50 * n_words",
        "symbols": "10 * n_symbols > n_words", "repeated_lines": "10 * n_dup_lines > 3 * n_lines",
        "word_length": "(word_chars < 3 * n_words OR word_chars > 10 * n_words)",
        "open_lines": "2 * n_ended < n_lines", "capitals": "10 * n_upper > 3 * n_letters",
        "words_without_letters": "10 * n_lettered < 8 * n_words",
    }
    failed = " + ".join(f"CASE WHEN {bits[r]} THEN {1 << b} ELSE 0 END" for r, (b, _) in RULES.items())
    ends = "', '".join(e.decode().replace("'", "''") for e in _ENDS)
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM {table}),
    w AS (SELECT *, regexp_extract_all(t, {word}) AS w,
                 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {body})) AS l FROM d),
    g AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n
          FROM (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
                FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w))),
    p AS (SELECT r, count(DISTINCT q) AS n_repeat_words
          FROM (SELECT r, unnest(range(i, i + 3)) AS q FROM g WHERE n > 1) GROUP BY r),
    m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
                 length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                 len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
                 len(l) AS n_lines,
                 len(list_filter(l, lambda x: right(rtrim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12)
                     || chr(13)), 1) IN ('{ends}'))) AS n_ended,
                 length(regexp_replace(t, '[^A-Za-z\\x{{80}}-\\x{{10FFFF}}]', '', 'g')) AS n_letters,
                 length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper,
                 len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z\\x{{80}}-\\x{{10FFFF}}]'))) AS n_lettered
          FROM w LEFT JOIN p USING (r)),
    f AS (SELECT *, {failed} AS failed FROM m)
    SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars,
           n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
           n_repeat_words::BIGINT AS n_repeat_words, failed & {mask(BASE)} <> 0 AS base_failed,
           failed & {mask(POLICIES[LATEST])} = 0 AS kept, failed::BIGINT AS failed
    FROM f"""
