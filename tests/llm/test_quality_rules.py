"""Operator 11 against a plain count, and its policies and ablations against loops."""

import random
import re
from collections import Counter

import brute
import compare
import numpy as np
import pytest

from opinara.llm import quality_rules as q
from opinara.llm import queries

DATA = "/root/testdata"


def plain(text):
    text = text or ""
    w = brute.words(text)
    runs = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    again = {i + k for i in range(len(w) - 2) if runs[tuple(w[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if brute.words(x)]
    letter = r"[A-Za-z]|[^\x00-\x7F]"
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(again), "n_lines": len(lines),
        "n_ended": sum(x.rstrip(" \t\n\v\f\r")[-1] in ".!?:;\"')”»…" for x in lines),
        "n_letters": len(re.findall(letter, text)), "n_upper": len(re.findall("[A-Z]", text)),
        "n_lettered": sum(bool(re.search(letter, x)) for x in w),
    }


def drawn(seed, n):
    rng = random.Random(seed)
    signs = ["a", "b c", "der Fluß", "É", "x#", "|", " ", "\n", "\n", "\t", ".", "!\n", " ", "\x1c", "1", "ABC"]
    return ["".join(rng.choice(signs) + rng.choice(("", " ")) for _ in range(rng.randrange(120))) for _ in range(n)]


@pytest.mark.parametrize("most", [1_000_000, 40])
def test_measurements(most):
    texts = [*drawn(1, 300), None, "", " \n\t", "w" * 300, "one", "a b a b a b", "a\n\na\n \na"]
    got = q.measure(texts, most)
    for name in q.MEASURES:
        assert got[name].tolist() == [plain(t)[name] for t in texts], name


def test_a_very_long_text():
    text = "the house and a garden with trees.\n" * 60_000 + "x" * 1_500_000 + " end"
    got = q.measure([text, "a b"])
    assert {k: int(v[0]) for k, v in got.items()} == plain(text)


def test_same_as_sql(spark):
    con = compare.connect(f"{DATA}/sf0.01")
    assert compare.differences(queries.op11_quality_rules(spark, f"{DATA}/sf0.01"), con,
                               queries.ORACLE["op11_quality_rules"]) == []


def test_clean_documents_are_kept_and_bad_ones_go(spark):
    labels = spark.read.parquet(f"{DATA}/sf0.01/labels.parquet")
    rows = queries.op11_quality_rules(spark, f"{DATA}/sf0.01").join(labels, "doc_id").collect()
    clean = [r for r in rows if r.quality == 1 and not r.base_failed]
    assert np.mean([r.kept for r in clean]) >= 0.99
    assert np.mean([r.kept for r in rows if r.quality == 0]) <= 0.1


def test_odd_rows_policies_and_ablations(spark):
    texts = [None, "", *drawn(2, 200), "good words stand here. " * 3 + " ".join(f"w{i}" for i in range(60)) + ".",
             *[" ".join(f"{c}{i}" for i in range(70)) + "." for c in ("word", "WORD", "#w", "a very")] * 2]
    table = spark.createDataFrame([(i % 190 or None, t, 1, "x", 2) for i, t in enumerate(texts)],
                                  "doc_id bigint, text string, failed int, t string, n_words int").repartition(4)
    rows = q.ledger(table, ["doc_id", "t"])
    assert rows.columns == ["doc_id", "t", *q.MEASURES, "failed"]
    got = rows.collect()
    assert len(got) == len(texts) and q.ledger(table.limit(0)).count() == 0
    for version, rules in q.POLICIES.items():
        kept = sum(not any(r.failed >> q.RULES[x][0] & 1 for x in rules) for r in got)
        assert rows.where(q.passes(version)).count() == kept
    found = {(r.version, r.rule): r for r in q.ablations(rows).collect()}
    assert set(found) == {(v, r) for v, rules in q.POLICIES.items() for r in rules}
    for (version, rule), r in found.items():
        bits, bit = q.mask(q.POLICIES[version]), q.mask([rule])
        assert r.n == len(got)
        assert r.kept == sum(x.failed & bits == 0 for x in got)
        assert r.fails == sum(x.failed & bit != 0 for x in got)
        assert r.fails_alone == sum(x.failed & bits == bit for x in got)
        assert r.kept_without == sum(x.failed & bits & ~bit == 0 for x in got) == r.kept + r.fails_alone
