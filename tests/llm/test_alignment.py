"""Operator 13 against plain loops over the libraries' own tokens."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from opinara.llm import alignment as al
from opinara.llm import queries

DATA = "/root/testdata"
FILES = al.Files.read(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def tokens(texts):
    """For each text the (id, begin, end) of both tokenizers' tokens, or none."""
    t = Tokenizer.from_str(FILES.a)
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_proto=FILES.b)
    signs = al.byte_signs()
    out = []
    for text in texts:
        both = []
        if text:
            a = t.encode(" " + text, add_special_tokens=False).ids
            said = [[(i, bytes(signs[c] for c in t.id_to_token(i))) for i in a], []]
            for i in sp.encode(text):
                p = sp.id_to_piece(i)
                said[1].append((i, bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()))
            if all(b"".join(b for _, b in s) == (" " + text).encode() for s in said):
                for s in said:
                    ends = np.cumsum([len(b) for _, b in s]).tolist()
                    both.append([(i, e - len(b), e) for (i, b), e in zip(s, ends, strict=True)])
        out.append(both or [[], []])
    return out


def expected(rows):
    """The query's rows, by checking all pairs of tokens."""
    found, counts = [], Counter()
    for a, b in tokens([t for _, t in rows]):
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        ends = sorted({x[2] for x in a} & {y[2] for y in b})
        groups, low = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(x[0]) for x in s if low < x[2] <= end) for s in (a, b)))
            low = end
        counts.update(links)
        found.append((len(a), len(b), len(ends), links, ";".join(groups)))
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    return [(i, n_a, n_b, n, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links),
             hashlib.sha256(g.encode()).hexdigest() if g else "")
            for (i, _), (n_a, n_b, n, links, g) in zip(rows, found, strict=True)], counts


def drawn(seed, n):
    rng = random.Random(seed)
    words = ["the", "house", "naïve", "日本", "\U0001f600", "  ", "\n", "\t", "1234", "don't", "x" * 30, "é", "\x00",
             "<|endoftext|>", "<s>", "</s>", "<0x41>", " ", "a▁b", "und", "...", " "]
    return ["".join(rng.choice(words) + rng.choice((" ", "")) for _ in range(rng.randrange(1, 40))) for _ in range(n)]


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


def test_same_as_all_pairs(spark):
    texts = [*drawn(1, 200), None, "", " ", "▁", "the house", "the house", "plain words " * 50]
    rows = [(i % 190 or None, t) for i, t in enumerate(texts)]
    want, _ = expected(rows)
    docs = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows],
                                 "doc_id bigint, text string, a int, chunk int, groups string").repartition(3)
    got = al.align(docs, FILES, ["doc_id"])
    assert got.columns == COLUMNS and ordered(got.collect()) == ordered(want)
    assert any(r[1] == 0 and r[-1] == "" for r in want)
    assert al.align(docs.limit(0), FILES, ["doc_id"]).count() == 0
    whole = al.align(docs, FILES, ["doc_id", "groups"], digest=False)
    assert whole.columns == ["doc_id", "groups", *COLUMNS[1:-1], "groups"]
    assert sorted(hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "" for r in whole.collect()) == sorted(
        r[-1] for r in want)


def test_given_documents(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = [r for r in rows if len(r[1] or "") < 6000]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want, counts = expected(rows)
    assert ordered(al.align(docs, FILES, ["doc_id"]).collect()) == ordered(want)
    found = al.pair_counts(al.index(docs, FILES, ["doc_id"])).collect()
    assert {(r.a, r.b): r.links for r in found} == counts


def test_whole_table(spark, sf):
    got = queries.op13_token_alignment(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.n_links >= max(r.n_a, r.n_b) and r.n_groups <= min(r.n_a, r.n_b) for r in got)


@pytest.mark.parametrize("n_docs", [5, 3000])
def test_bitmaps_hold_every_link(n_docs):
    """Chunks of few and many documents: numbers, bits and planes together give the links back."""
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 4, 50_000) * 7000, rng.integers(0, 3, 50_000)
    doc = (rng.random(50_000) ** 3 * n_docs).astype(np.int64)
    want = Counter(zip(a.tolist(), b.tolist(), doc.tolist(), strict=True))
    got, planes = Counter(), set()
    for batch in al.postings(a << 36 | b << 16 | doc, n_docs, 9):
        for r in batch.to_pylist():
            docs = (np.flatnonzero(np.unpackbits(np.frombuffer(r["docs"], np.uint8), bitorder="little"))
                    if r["bits"] else np.frombuffer(r["docs"], "<u2"))
            assert len(docs) == r["n"] and r["chunk"] == 9
            planes.add((r["plane"], r["bits"]))
            for d in docs.tolist():
                got[r["a"], r["b"], d] += 1 << max(r["plane"] - 1, 0)
    assert got == want and len({p for p, _ in planes}) > 2


def test_windows_of_long_texts_give_the_same():
    pair = al.Pair(FILES)
    texts = [" ".join(drawn(s, 20)) for s in range(10)]
    whole, cut = pair.encode(texts, 10**9), pair.encode(texts, 50)
    assert len(pair.windows(texts[0], 50)) > 3
    for x, y in zip(whole, cut, strict=True):
        assert x.tolist() == y.tolist()
