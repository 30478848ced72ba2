"""Operators 1, 3, 4, 5 and 8: against SQL, brute force, and a public encoder."""

import hashlib
import random
import textwrap

import brute
import compare
import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from opinara.llm import decontaminate, jaccard, licenses, pieces, queries, repeats

MODEL = public_tokenizers.path("piece_bpe_32k.model")
#: Rows every text operator has to stand: null, empty, blank, odd signs, ties, a null key.
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one"), (6, "x " * 3000), (7, "x " * 3000),
       (8, "w" * 50_000), (9, "▁a  b c\x00 \U0001f600"), (None, "one two three four")]


def table(spark, rows):
    """Text rows with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "a", 1, 2.0, "z") for i, t in rows],
                                 "doc_id bigint, text string, t string, k0 int, score double, ids string")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_as_sql(spark, sf, name):
    con = compare.connect(sf)
    assert compare.differences(queries.QUERIES[name](spark, sf), con, queries.ORACLE[name]) == []


def passages(seed, n_docs, n_shared, length, vocabulary=300):
    """Documents of random words, some of which hold shared passages."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocabulary)}"
    shared = [[word() for _ in range(length)] for _ in range(n_shared)]
    rows = []
    for i in range(n_docs):
        text = [word() for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            cut = rng.randrange(length)
            text += rng.choice(shared)[cut:] + [word() for _ in range(rng.randrange(8))]
        rows.append((i * 7 % n_docs, rng.choice((" ", "\n", "  ")).join(text)))
    return rows


@pytest.mark.parametrize("tree_words", [repeats.TREE_WORDS, 1])
def test_repeats(spark, tree_words):
    rows = passages(1, 60, 5, 40) + [(100, "a b " * 60), (101, "a b " * 50), (102, "b a " * 50)]
    want = brute.stripped(rows, 12)
    docs = table(spark, rows).repartition(5)
    spans = repeats.find_repeats(docs, window=12, tree_words=tree_words)
    got = repeats.strip(docs, spans).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == want
    assert any(n for _, n, _ in want.values())


def test_repeats_with_one_header_in_a_third_of_all_documents(spark):
    """Headers shorter than the window, each followed by a text of its own: nothing of it merges."""
    rng = random.Random(12)
    for length in (10, 11):
        header = [f"h{k}" for k in range(length)]
        rows = [(i, " ".join((header if i % 3 == 0 else []) + [f"w{rng.randrange(10**6)}" for _ in range(14)]))
                for i in range(3000)]
        rows += [(9000 + i, rows[i][1]) for i in range(6)]
        docs = table(spark, rows)
        got = repeats.strip(docs, repeats.find_repeats(docs, window=12, tree_words=3000)).collect()
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == brute.stripped(rows, 12)


def test_repeats_odd_rows(spark):
    docs = table(spark, [*ODD, ODD[6]])
    got = repeats.strip(docs, repeats.find_repeats(docs))
    assert got.columns == [*docs.columns, "kept_text", "n_words", "n_removed"]
    rows = [(r.doc_id, r.n_words, r.n_removed) for r in got.collect()]
    assert sorted(rows, key=str) == sorted(
        [(1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 1, 0), (5, 1, 0), (6, 3000, 0), (7, 3000, 3000),
         (7, 3000, 3000), (8, 1, 0), (9, 3, 0), (None, 4, 0)], key=str)
    none = docs.limit(0)
    assert repeats.strip(none, repeats.find_repeats(none)).count() == 0


def near_copies(seed, groups, copies, length, edits):
    rng = random.Random(seed)
    rows, key = [], 0
    for _ in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(length)]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randrange(edits + 1)):
                text[rng.randrange(length)] = f"e{rng.randrange(40)}"
            rows.append((key, " ".join(text)))
            key += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("n", "num", "part"), [(3, 90, jaccard.PART), (3, 90, 4), (5, 80, jaccard.PART), (5, 80, 4)])
def test_jaccard(spark, n, num, part):
    rows = near_copies(2, 3, 45, 120, 5) + [(1000 + i, t) for i, t in passages(3, 40, 4, 40)]
    want = brute.jaccard_classes(rows, n, num, 100)
    found = jaccard.near_duplicates(table(spark, rows).repartition(6), n, (num, 100), part=part)
    assert {r.doc: (r.n_shingles, r.component) for r in found.collect()} == want
    assert len({c for _, c in want.values()}) < len(rows)


def classes_by_matrix(rows, n, num):
    """{id: smallest id reachable}, from the overlaps of all pairs as one matrix product."""
    sets = [brute.shingles(t, n) for _, t in rows]
    number = {s: k for k, s in enumerate(sorted(set().union(*sets)))}
    hits = np.zeros((len(sets), len(number)), np.float32)
    for i, s in enumerate(sets):
        hits[i, [number[x] for x in s]] = 1
    size, overlap = hits.sum(1), hits @ hits.T
    linked = 100 * overlap >= num * (size[:, None] + size[None] - overlap)
    best = np.arange(len(sets))
    while True:
        now = np.where(linked, best[None], len(sets)).min(1)
        if (now == best).all():
            return {i: rows[b][0] for (i, _), b in zip(rows, best.tolist(), strict=True)}
        best = now


def test_jaccard_of_many_near_copies(spark):
    """Near copies with edits of their own: right classes, and no part of more than some hundred rows."""
    rng = random.Random(14)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(3000):
        text = list(base)
        for _ in range(1 + (i % 10 == 0) * rng.randrange(9)):
            text[rng.randrange(60)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    docs = table(spark, rows).repartition(8)
    got = {r.doc: r.component for r in jaccard.near_duplicates(docs, 3, (90, 100)).collect()}
    want = classes_by_matrix(rows, 3, 90)
    assert got == want and len(set(want.values())) > 100
    entries = [(c, 0, b, 0, kind) for c in range(3) for b, kind in [(c, 0), *((100 + k, 2) for k in range(3000 * c))]]
    members = spark.createDataFrame(entries, "c1 bigint, c2 int, b1 bigint, b2 int, kind int")
    parts = jaccard.dealt(members, 256).groupBy("c1", "part").agg({"kind": "count"}).collect()
    assert max(r[2] for r in parts) < 2 * 256
    dealt = jaccard.dealt(members, 256)
    assert dealt.where("kind = 2").count() == 9000 and dealt.where("kind = 0").count() == len(parts)


def test_jaccard_odd_rows(spark):
    docs = table(spark, [*ODD, ODD[3]])
    got = [(r.doc, r.n_shingles, r.component) for r in jaccard.near_duplicates(docs, 3).collect()]
    assert sorted(got, key=str) == sorted(
        [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 6),
         (8, 1, 8), (9, 1, 9), (None, 2, None)], key=str)
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0


def test_edit_matching(spark):
    rng = random.Random(4)
    items = [(i, " ".join(f"q{rng.randrange(90)}" for _ in range(12))) for i in range(6)]
    items += [(6, None), (7, " \n"), (8, items[0][1])]
    rows = []
    for i in range(60):
        item = list(rng.choice(items[:6])[1])
        for _ in range(rng.randrange(7)):
            at = rng.randrange(len(item))
            item[at:at + rng.randrange(2)] = rng.choice("abc")
        filler = " ".join(f"q{rng.randrange(90)}" for _ in range(20))
        rows.append((100 + i, f"{filler} {''.join(item).upper() if i % 3 else filler} {filler}"))
    docs, bench = table(spark, rows + ODD), spark.createDataFrame(items, "item_id bigint, text string")
    want = set()
    for key, item in items:
        item = decontaminate.normal(item)
        if item:
            for d, t in rows:
                cost = brute.edit_search(item, decontaminate.normal(t))
                if cost <= int(decontaminate.ERROR_RATE * len(item)):
                    want.add((d, key, cost))
    for block in (4_000_000, 100):
        found = decontaminate.find(docs, bench, ["doc_id"], block_chars=block).collect()
        least = {}
        for r in found:
            least[r.doc_id, r.item_id] = min(r.distance, least.get((r.doc_id, r.item_id), 99))
        assert {(d, i, n) for (d, i), n in least.items()} == want
        clean = decontaminate.remove(docs, bench, block_chars=block)
        assert clean.columns == docs.columns
        kept = [r.doc_id for r in clean.collect()]
        assert sorted(kept, key=str) == sorted(
            [d for d, _ in rows + ODD if d not in {d for d, _, _ in want} or d is None], key=str)
    assert want
    assert decontaminate.find(docs, bench.limit(0), ["doc_id"]).count() == 0
    assert decontaminate.find(docs.limit(0), bench, ["doc_id"]).count() == 0
    assert decontaminate.remove(docs.limit(0), bench).count() == 0


def test_decontaminate_query(spark, sf):
    """Every item that stands in a text unchanged is found, with distance 0."""
    docs = {r.doc_id: decontaminate.normal(r.text)
            for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: decontaminate.normal(r.text)
             for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    exact = {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
    found = queries.op5_decontaminate(spark, sf).collect()
    assert {(r.doc_id, r.item_id) for r in found if r.distance == 0} == exact
    for r in found:
        assert brute.edit_search(items[r.item_id], docs[r.doc_id][r.start:r.end]) == r.distance


def test_license_blocks(spark):
    rows = [(1, "x Licensed under the Apache License, Version 2.0. y"), (2, "Released under the MIT License"),
            (3, "Released under\nthe MIT License"), (4, "CC by cc-BY 4"), (5, None), (6, ""),
            (7, "the license under mit was released"), (8, "all rights reserved, cc by")]
    got = {r.doc_id: r for r in licenses.scan(table(spark, rows), ["doc_id", "t", "score"][:1]).collect()}
    assert (got[1].labels, got[1].score, got[1].n_base, got[1].first_word) == ("apache-2.0", 1.0, 0, None)
    assert (got[2].labels, got[3].labels, got[7].labels) == ("mit", "mit", "mit")
    assert (got[4].n_base, got[4].first_word, got[4].last_word, got[4].base_labels) == (2, 0, 2, "cc-by")
    assert (got[5].n_words, got[5].labels, got[5].score, got[6].n_words) == (0, "", 0.0, 0)
    assert (got[8].base_labels, got[8].first_word, got[8].last_word) == ("cc-by,reserved", 0, 3)
    assert licenses.scan(table(spark, ODD), ["doc_id", "text", "k0"]).count() == len(ODD)
    assert licenses.scan(table(spark, rows).limit(0), ["doc_id"]).count() == 0


def wrapped(text, width, mark=""):
    return "\n".join(mark + line for line in textwrap.wrap(text, width))


def notice(label, at=-1):
    return [t for name, _, t in licenses.TEMPLATES if name == label][at]


#: (text, labels by hand)
NOTICES = [
    ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"),
    ("This work is licensed under the GNU Affero General Public License, version 3.", "agpl-3.0,gpl"),
    ("Licensed under the GNU Lesser General Public License, version 2.1", "gpl,lgpl-2.1"),
    ("Licensed under the GNU General Public License, version 2", "gpl,gpl-2.0"),
    ("licensed under the GNU\nGeneral Public\nLicense version 2", "gpl,gpl-2.0"),
    ("First of all.\n\nReleased under the\n\nMIT License.\nAnd more.", "mit"),
    (wrapped(notice("mit"), 60, " * "), "mit"),
    ("MIT License\n\nCopyright (c) 2020 Someone\n\n" + wrapped(notice("mit"), 78), "mit"),
    (wrapped(notice("bsd-3-clause") + " " + notice("bsd-2-clause").split("distribution. ")[1], 70, "# "), "bsd-3-clause"),
    (wrapped(notice("bsd-2-clause"), 70, "# "), "bsd-2-clause"),
    (wrapped(notice("bsd"), 40), "bsd"),
    (wrapped(notice("apache-2.0"), 50).replace("at\n", "at\n http://www.apache.org/licenses/LICENSE-2.0 \n"), "apache-2.0"),
    (wrapped(notice("lgpl-2.1", 1), 72), "gpl,lgpl-2.1"),
    (wrapped(notice("gpl-3.0"), 72), "gpl,gpl-3.0"),
    (wrapped(notice("agpl-3.0"), 72), "agpl-3.0,gpl"),
    (wrapped(notice("zlib"), 66), "zlib"),
    ("Licensed under CC BY-NC 4.0", "cc-by,cc-by-nc-4.0"),
    ("Licensed under CC BY-SA 4.0", "cc-by,cc-by-sa-4.0"),
    ("Licensed under CC BY 4.0", "cc-by,cc-by-4.0"),
    ("CC BY-NC 4.0 was licensed under other terms.\nLicensed under CC BY 4.0", "cc-by,cc-by-4.0,cc-by-nc-4.0"),
    # Words that stand scattered over a long text are no notice.
    ("\n".join(f"word{i} {w} other{i}" for i, w in enumerate("released under the mit license".split())
               for _ in range(9)), ""),
    ("the house is under the hill", ""),
]


def test_license_notices_by_hand(spark):
    docs = table(spark, [(i, t) for i, (t, _) in enumerate(NOTICES)])
    got = {r.doc_id: r.labels for r in licenses.scan(docs, ["doc_id"]).collect()}
    assert got == {i: labels for i, (_, labels) in enumerate(NOTICES)}


def test_license_blocks_same_as_all_pairs():
    """The filters lose nothing: against every block and every template, for random words and lines."""
    rng = random.Random(6)
    templates = [(f"l{i}", " ".join(w[:i % 3]), " ".join(w)) for i in range(12)
                 for w in [rng.sample([f"t{k}" for k in range(14)], rng.randrange(1, 9))]]
    for _ in range(400):
        index = licenses.Index(templates, {f"t{k}".encode(): rng.randrange(5) for k in range(14)}, (3, 4))
        lines = [[f"t{rng.randrange(20)}".encode() for _ in range(rng.randrange(1, 5))] for _ in range(rng.randrange(8))]
        want, hits = {}, {}
        for start in range(len(lines)):
            for label, needs, text in templates:
                words, block = text.encode().split(), list(lines[start])
                for line in lines[start + 1:]:
                    if len(block) + len(line) > licenses.SLACK * len(words):
                        break
                    block += line
                share = len(set(words) & set(block)) / len(set(words))
                if 4 * len(set(words) & set(block)) >= 3 * len(set(words)) and set(needs.encode().split()) <= set(block):
                    hits.setdefault(start, []).append((label, set(needs.split()), share))
        for found in hits.values():
            for label, needs, share in found:
                if not any(needs < other for _, other, _ in found):
                    want[label] = max(want.get(label, 0), share)
        assert index.matches(lines) == want


def test_no_affero_without_the_word(spark):
    rows = queries.op3_licenses(spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id").collect()
    assert any("gpl-3.0" in r.labels.split(",") for r in rows)
    assert all("affero" in r.text.lower() for r in rows if "agpl" in r.labels)


def test_pieces_without_dropout_are_the_models_own(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    texts += ["  two  blanks ", "\n\n", " ", "a", "", "é漢\t字", "w" * 200, "\U0001f600\x7f", "word " * 9]
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    ids, counts = pieces.Pieces(pieces.read_model(MODEL)).encode(texts, [""] * len(texts), 1, 0.0)
    got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == sp.encode(texts)


def test_pieces_dropout(spark):
    own = pieces.Pieces(pieces.read_model(MODEL))
    runs = ["international", " understanding", "zzz", " a", "x" * 30, "reunification", "▁", " é漢字"]
    for run in runs:
        codes = np.array([[ord(c) for c in run]], np.uint32)
        for base in range(20):
            ids, live = own.rows(codes, np.array([base], np.uint64), 1 << 30)
            # The heap for long runs and the rows of short ones take the same merges.
            want = own.agenda(codes[0], base, 1 << 30)
            assert live.sum() == len(want) and (run == "▁" or ids[live].tolist() == [i for i, _ in want])
    text = "An understanding of international organisations " * 50
    first, other, _ = (own.encode([text, text], ["7", "8"], s, 0.3) for s in (1, 2, 1))
    again, plain = own.encode([text], ["7"], 1, 0.3), own.encode([text], ["7"], 1, 0.0)
    one = first[0][:first[1][0]].tolist()
    assert one == again[0].tolist() != first[0][first[1][0]:].tolist()
    assert one != other[0][:other[1][0]].tolist() and len(one) > len(plain[0])
    for ids, counts in (first, other, again, plain):
        assert set(own.decode(ids, counts)) == {text}
    docs = table(spark, [*ODD, *ODD])
    coded = pieces.encode(docs, pieces.read_model(MODEL), ["doc_id", "text"])
    back = pieces.decode(coded.withColumnRenamed("text", "was"), pieces.read_model(MODEL), ["doc_id", "was"])
    assert all(r.text == r.was for r in back.collect())
    got = pieces.digests(docs, pieces.read_model(MODEL)).collect()
    assert len(got) == len(docs.collect()) and all(r.lossless for r in got)
    by_key = {}
    for r in got:
        assert by_key.setdefault(r.doc_id, r) == r
    assert by_key[2].text_sha256 == hashlib.sha256(b"").hexdigest() and by_key[1].text_sha256 is None
    assert pieces.digests(docs.limit(0), pieces.read_model(MODEL)).count() == 0
