"""Operators 2, 6, 7, 9, 10 and the pipeline: held-out accuracy, round trips, brute force."""

import base64
import functools
import hashlib
import itertools
import math
import random
import subprocess
import sys
import time
from collections import Counter
from pathlib import Path

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from opinara.llm import (
    decontaminate,
    graph,
    html_text,
    language_id,
    quality,
    queries,
    training_order,
    vectors,
)
from opinara.sources import sinks

DATA = "/root/testdata"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "1234 !?"), (5, "a"), (6, "und der die das " * 9000),
       (7, "w" * 50_000), (8, "a"), (8, "a"), (None, "the house")]
SCHEMA = "doc_id bigint, text string, lang string, t string, score double, k0 int"


def odd(spark):
    return spark.createDataFrame([(i, t, None, "x", 0.5, 3) for i, t in ODD], SCHEMA)


def test_language(spark):
    got = queries.op9_language_id(spark, f"{DATA}/sf0.01").join(
        spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 1000 and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got) and sum(r.rejected for r in got) <= 10


def test_language_odd_rows(spark, sf):
    model = language_id.fit(spark.read.parquet(f"{sf}/documents.parquet"), per_class=20)
    got = language_id.predict(odd(spark), model, ["doc_id", "t", "score"])
    assert got.columns == ["doc_id", "t", "score", "lang_pred", "score", "rejected"]
    rows = sorted((str(r[0]), r[3]) for r in got.collect())
    assert [k for k, lang in rows if lang == "und"] == ["1", "2", "3", "4"]
    kept = language_id.accepted(odd(spark), model)
    assert kept.columns == odd(spark).columns
    assert {r.doc_id for r in kept.collect()} <= {5, 6, 7, 8, None}
    assert language_id.predict(odd(spark).limit(0), model, ["doc_id"]).count() == 0
    none = language_id.fit(odd(spark))
    assert {r.lang_pred for r in language_id.predict(odd(spark), none, ["doc_id"]).collect()} == {"und"}


def test_language_rejects_texts_of_no_language(spark, monkeypatch):
    """Junk letters and an unknown script are rejected in op9 and leave the pipeline; clean texts stay."""
    rng, at = random.Random(3), f"{DATA}/sf0.01"
    junk = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz   ") for _ in range(300)) for _ in range(20)]
    junk += ["これは日本語の文章です。モデルはこの文字を見たことがありません。"]
    docs = spark.read.parquet(f"{at}/documents.parquet").unionByName(spark.createDataFrame(
        [(50_000 + i, t, None, "x", len(t)) for i, t in enumerate(junk)],
        "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    monkeypatch.setattr(queries, "_table", lambda *_: docs)
    got = queries.op9_language_id(spark, at).collect()
    assert all(r.rejected and r.lang_pred != "und" for r in got if r.doc_id >= 50_000)
    assert sum(r.rejected for r in got if r.doc_id < 50_000) <= 10
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, at).collect()}
    assert kept == {r.doc_id for r in got if not r.rejected}
    # Rows that are all told rightly still leave a threshold.
    p = np.array([[0.9, 0.1], [0.2, 0.8]])
    assert language_id._threshold(p, np.array([0, 1]), np.array([0.6, 0.55]), 0.01) == pytest.approx(0.6, abs=0.01)


def test_quality(spark):
    labels = spark.read.parquet(f"{DATA}/sf0.01/labels.parquet")
    got = queries.op2_quality(spark, f"{DATA}/sf0.01").join(labels, "doc_id", "left").collect()
    held = [r for r in got if r.held_out and r.quality is not None]
    assert len(got) == 1000 and sum(r.predicted == r.quality for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_quality_gradients():
    """The hand-written backward pass against differences of the loss."""
    rng = np.random.default_rng(1)
    w = {"enc": rng.normal(size=(5, 4)), "enc_b": rng.normal(size=4), "att": rng.normal(size=(4, 2)),
         "gate": rng.normal(size=(4, 2)), "pick": rng.normal(size=2), "top": rng.normal(size=4),
         "top_b": rng.normal(size=1)}
    x, whose, y = rng.normal(size=(7, 5)), np.array([0, 0, 0, 1, 2, 2, 2]), np.array([1.0, 0, 1])

    def loss(w):
        p = quality._forward(w, x, whose, 3)[0]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    p, kept = quality._forward(w, x, whose, 3)
    grads = quality._gradients(w, x, whose, p, y, kept)
    for k, v in w.items():
        for at in np.ndindex(v.shape):
            two = []
            for step in (1e-5, -1e-5):
                other = {a: b.copy() for a, b in w.items()}
                other[k][at] += step
                two.append(loss(other))
            assert grads[k][at] == pytest.approx((two[0] - two[1]) / 2e-5, abs=1e-6)


def test_quality_odd_rows(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels, per_class=20)
    got = quality.score(odd(spark), model, ["doc_id", "score"])
    assert got.columns == ["doc_id", "score", "score", "n_passages"]
    rows = got.toDF("doc_id", "own", "score", "n_passages").collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.own == 0.5 for r in rows)
    assert {r.n_passages for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert next(r.n_passages for r in rows if r.doc_id == 6) == 750
    assert len({r.score for r in rows if r.doc_id in (5, 8)}) == 1
    assert quality.score(odd(spark).limit(0), model, ["doc_id"]).count() == 0
    none = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.score(odd(spark), none, ["doc_id"]).collect()} == {0.5}


def test_windows_of_long_texts_give_the_same():
    rng = random.Random(4)
    text = "".join(rng.choice((" ", "  ", "\n")) + "".join(rng.choices("abcÄß.,7", k=rng.randrange(1, 9)))
                   for _ in range(5000))
    for t in (text, text + " ", "x" + text):
        want = quality.passages([t])[1]
        assert (np.concatenate(list(quality.long_passages(t, 3000))) == want).all()
        own = np.bincount(language_id.subwords([t])[1], minlength=language_id.BUCKETS)
        parts = language_id._windows(t, 3000)
        assert "".join(parts) == t and len(parts) > 5
        assert (own == sum(np.bincount(language_id.subwords([p])[1], minlength=language_id.BUCKETS)
                           for p in parts)).all()


LONG_TEXT = """
import resource, sys
from opinara.llm import language_id, quality
import numpy as np
text = "the house and a garden with trees, " * (20_000_000 // 35)
rng = np.random.default_rng(1)
width = 24
w = {"enc": rng.normal(size=(quality.N_FEATURES, width)), "enc_b": np.zeros(width),
     "att": rng.normal(size=(width, 12)), "gate": rng.normal(size=(width, 12)),
     "pick": rng.normal(size=12), "top": rng.normal(size=width), "top_b": np.zeros(1)}
m = quality.Model(np.zeros(quality.N_FEATURES), np.ones(quality.N_FEATURES), w)
score, n = quality._long_score(m, text)
assert 0 <= score <= 1 and n == -(-len(text.split()) // quality.WORDS)
table = rng.normal(size=(language_id.BUCKETS, 4)).astype(np.float32)
m = language_id.Model(tuple("abcd"), table, np.zeros(4), 1.0, 0.3)
best, conf = language_id.classify(m, [text, "x"])
assert best[0] is not None and language_id.classify(m, [text[:len(text) // 2]])[0][0] == best[0]
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""


def test_a_text_of_twenty_million_characters_takes_little_memory():
    done = subprocess.run([sys.executable, "-c", LONG_TEXT], capture_output=True, text=True, timeout=300,
                          cwd=Path(__file__).resolve().parents[2], check=True)
    assert int(done.stdout) < 500


def test_only_models_come_to_the_driver(spark, sf, monkeypatch):
    """What learn() brings back is one row, whose size does not follow the sample."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows, fetch = [], type(docs).collect

    def collect(self):
        rows.append(fetch(self))
        return rows[-1]

    monkeypatch.setattr(type(docs), "collect", collect)
    for fit, size in ((lambda: quality.fit(docs, labels), 100_000), (lambda: language_id.fit(docs), 2_000_000)):
        rows.clear()
        fit()
        got = [r for part in rows for r in part]
        assert len(got) <= 10 and max(len(r.model) for r in got if "model" in r) < size


@pytest.mark.parametrize("n", [1, 2, 3, 17, 256, 1000, 4097])
def test_feistel_is_a_permutation(n):
    for key in (1, 2):
        got = training_order.feistel(np.arange(n), n, key)
        assert sorted(got.tolist()) == list(range(n))
    assert n < 17 or (training_order.feistel(np.arange(n), n, 1) != got).any()


def test_training_order(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").repartition(4)
    docs = docs.unionByName(odd(spark).select(F.col("doc_id") + 10_000, "text").toDF("doc_id", "text"))
    ranks = training_order.read_ranks(RANKS)
    order = {"ranks": ranks, "pattern": public_tokenizers.PATTERN, "end_mark": 50256, "seq_len": 64, "shard_size": 50}
    rows = training_order.materialise(docs, **order, per_task=3)
    assert rows.rdd.getNumPartitions() > 5
    written = training_order.write_shards(docs, f"file://{tmp_path}/shards", **order, per_task=4).collect()
    got = sorted(rows.collect())
    assert [r.slot for r in got] == list(range(len(got)))
    assert all((r.shard, r.byte_offset) == (r.slot // 50, r.slot % 50 * 128) for r in got)
    assert sum(r.n_sequences for r in written) == len(got) and len(written) == -(-len(got) // 50)
    back = training_order.read_slots(f"file://{tmp_path}/shards", 0, len(got), 64, 50)
    assert [x.tobytes() for x in back.astype("<u2")] == [bytes(r.tokens) for r in got]
    resumed = training_order.read_slots(f"file://{tmp_path}/shards", 77, 90, 64, 50)
    assert (resumed == back[77:167]).all()
    enc, texts = training_order._encoding(ranks, public_tokenizers.PATTERN), {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    parts = {}
    for r in got:
        parts.setdefault(r.doc_id, []).append((r.part, bytes(r.tokens)[:2 * r.n_tokens]))
    for key, values in texts.items():
        if key is not None and len(values) == 1:
            ids = b"".join(t for _, t in sorted(parts[key]))
            assert np.frombuffer(ids, "<u2").tolist() == enc.encode_ordinary(values[0] or "")
    assert training_order.materialise(docs.limit(0), ranks, public_tokenizers.PATTERN, 50256).count() == 0


def test_training_order_query(spark, sf):
    """The files that the query read back, against shards made by plain loops."""
    enc = training_order._encoding(training_order.read_ranks(RANKS), public_tokenizers.PATTERN)
    sequences = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():  # one split, so in this order
        ids = [*enc.encode_ordinary(r.text or ""), queries.END_MARK]
        ids += [queries.END_MARK] * (-len(ids) % training_order.SEQ_LEN)
        sequences += [ids[i:i + training_order.SEQ_LEN] for i in range(0, len(ids), training_order.SEQ_LEN)]
    slots = training_order.feistel(np.arange(len(sequences)), len(sequences), 1)
    data = np.empty((len(sequences), training_order.SEQ_LEN), "<u2")
    data[slots] = sequences
    size = training_order.SHARD_SIZE
    want = [(k, k * size, len(part), part.nbytes, hashlib.sha256(part.tobytes()).hexdigest())
            for k, part in enumerate(data[i:i + size] for i in range(0, len(data), size))]
    got = queries.op6_training_order(spark, sf).orderBy("shard").collect()
    assert [(r.shard, r.first_slot, r.n_sequences, r.n_bytes, r.sha256) for r in got] == want


def test_shards_written_again_are_the_same(spark, sf, tmp_path):
    ranks = training_order.read_ranks(RANKS)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    folder = f"file://{tmp_path}/shards"
    found = []
    manifest = training_order.write_shards(docs, folder, ranks, public_tokenizers.PATTERN, 50256, shard_size=20,
                                           per_task=2)
    for _ in range(2):
        manifest.collect()
        found.append(sorted(training_order.read_back(manifest, folder, shard_size=20).collect()))
    assert found[0] == found[1] and len(found[0]) > 4
    assert {p.name for p in (tmp_path / "shards").iterdir()} == {r.file for r in found[0]}


def test_encoders_are_told_apart_by_their_ranks():
    lines = training_order.read_ranks(RANKS).splitlines()
    at = [i for i, line in enumerate(lines) if len(line) == len(lines[5000])][:2000:1999]
    swapped = list(lines)
    one, two = (lines[i].split() for i in at)
    swapped[at[0]], swapped[at[1]] = one[0] + b" " + two[1], two[0] + b" " + one[1]
    a, b = (training_order._encoding(b"\n".join(x), public_tokenizers.PATTERN) for x in (lines, swapped))
    word = base64.b64decode(one[0])
    assert a.encode_single_token(word) == int(one[1]) != b.encode_single_token(word) == int(two[1])


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head>
<body><header>Site</header><nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie notice">Ok?</div>
<article><h1>Head &amp; more</h1><p>One <b>bold</b>
  text<br>next<p>Two &lt;tags&gt; &copy;<ul><li>first<li>second</ul><form>Name</form>
<aside>Side</aside><div class="ad">Buy</div><section id="comments"><p>Nice!</p></section></article>
<div class="sidebar">More</div><footer>Foot</footer></body></html>"""


def test_html(spark):
    pages = [(1, "http://a.org/1", PAGE), (2, None, None), (3, "http://a.org/3", ""),
             (4, "x", "plain &am <p>a<p>b"), (5, "http://b.org/", "<article><p>cut off <b>here"),
             (5, "http://b.org/", "<article><p>cut off <b>here")]
    pages += [(6, None, '<body class="has-sidebar"><div class="site-header">Top</div><div class="with-sidebar">'
               '<article class="post"><p class="lead">In</p><div id="cookie-banner">Ok</div></article></div>'
               '<section class="reader-comments"><article class="comment">No</article></section></body>')]
    # A host whose pages all show the same frame and the same last lines, declared by nothing: the tree finds them.
    for i in range(30):
        pages.append((100 + i, f"http://c.org/{i}", f"<body><div><p>Same frame</p></div><center><p>Text {i}"
                      f" of its own</p>{'<p>And more</p>' * (i % 3)}</center></body>"))
    df = spark.createDataFrame([(*p, "x", 1) for p in pages],
                               "page_id bigint, url string, html string, t string, host int")
    got = html_text.extract(df, ["page_id", "url", "host"])
    assert got.columns == ["page_id", "url", "host", "text", "n_chars"]
    texts = {r.page_id: r for r in got.collect()}
    assert texts[1].text == "\n\n".join(["Head & more", "One bold text next", "Two <tags> ©", "first", "second"])
    assert (texts[2].text, texts[3].text, texts[2].n_chars) == ("", "", 0)
    assert texts[4].text == "plain &am\n\na\n\nb" and texts[5].text == "cut off here"
    assert texts[6].text == "In"
    assert all(texts[100 + i].text == f"Text {i} of its own" for i in range(30)) and got.count() == len(pages)
    assert texts[102].n_chars == len(texts[102].text)
    assert html_text.extract(df.limit(0), ["page_id"]).count() == 0


def test_html_tree_inside_articles(spark):
    """A block that all articles of a host repeat goes, though nothing declares it as noise."""
    pages = [(i, f"http://d.org/{i}", f'<main><h1>Title {i}</h1><p><b>Note</b> text<br>{i} of its own</p>'
              f'<div class="box"><p>Join us today</p></div><p>End {i * i}</p></main>') for i in range(30)]
    # The same page at many addresses is no noise.
    pages += [(100 + i, f"http://e.org/{i}", "<article><h1>One</h1><p>page</p></article>") for i in range(30)]
    # A plain last paragraph, on few pages, behind any number of others; one page says something else there.
    pages += [(200 + i, f"http://f.org/{i}", f"<main><h1>Title {i}</h1>" + f"<p>own {i}</p>" * (2 + i % 3)
               + f"<p>{'Join us today' if i else 'A last word'}</p></main>") for i in range(9)]
    # Copies of one long article among others: what only they show is theirs.
    pages += [(300 + i, f"http://g.org/{i}", f"<main><h1>Title {min(i, 6)}</h1>"
               + "".join(f"<p>{min(i, 6)} says {k}</p>" for k in range(4 if i < 6 else 20)) + "</main>")
              for i in range(16)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    for bound in (html_text.LIST_BYTES, 0):  # the lists broadcast, or joined
        texts = {r.page_id: r.text for r in html_text.extract(df, ["page_id"], list_bytes=bound).collect()}
        assert all(texts[i] == f"Title {i}\n\nNote text {i} of its own\n\nEnd {i * i}" for i in range(30))
        assert all(texts[100 + i] == "One\n\npage" for i in range(30))
        for i in range(9):
            own = [f"Title {i}"] + [f"own {i}"] * (2 + i % 3) + ["A last word"] * (i == 0)
            assert texts[200 + i].split("\n\n") == own
        assert all(len(texts[300 + i].split("\n\n")) == (5 if i < 6 else 21) for i in range(16))


def random_host(rng, number):
    """Pages of one host as trees of (tag, children): a frame that pages share, with parts of their own."""
    def frame(depth):
        tag = rng.choice(["div", "section", "ul"] if depth else ["p", "h2", "div"])
        kinds = lambda: ["own", "same", "often", None, *([frame(depth - 1)] * 3 if depth else [])]
        return [tag, [rng.choice(kinds()) for _ in range(rng.randrange(1, 4))], rng.randrange(10**6)]

    frames = [frame(3) for _ in range(rng.randrange(2, 5))]

    def shown(part, page):
        tag, children, key = part
        out = []
        for k, child in enumerate(children):
            if isinstance(child, list):
                if key % 7 or page % 2:
                    out.append(shown(child, page))
            elif child:
                said = {"own": f"page {page}", "same": "all", "often": "most" if page % 9 else f"but {page}"}[child]
                out.append(f" {said} {key % 100} {k} ")
        return (tag, out)

    return [("main", [shown(f, page) for f in frames]) for page in range(rng.randrange(3, 25))]


def as_html(tree):
    tag, children = tree
    return f"<{tag}>" + "".join(c if isinstance(c, str) else as_html(c) for c in children) + f"</{tag}>"


def plain_style_tree(pages):
    """For every page the blocks that are left, by a style tree of nested dicts."""
    tree = {}

    def own(node):
        return " ".join(" ".join(c for c in node[1] if isinstance(c, str)).split())

    def said(node):
        return [own(node)] + [x for c in node[1] if not isinstance(c, str) for x in said(c)]

    def places(node, path):
        runs = [list(g) for _, g in itertools.groupby((c for c in node[1] if not isinstance(c, str)), lambda c: c[0])]
        looks = tuple(r[0][0] for r in runs)
        yield node, path, looks
        for number, run in enumerate(runs):
            for i, child in enumerate(run):
                place = "last" if 0 < i == len(run) - 1 else i
                yield from places(child, (*path, looks, number, place, child[0]))

    for page in pages:
        texts = tuple(said(page))
        for node, path, looks in places(page, ()):
            seen = tree.setdefault(path, ([], []))
            seen[0].append((looks, texts))
            if own(node):
                seen[1].append((own(node), texts))

    def entropy(values):
        if len(values) < 2:
            return 1.0
        again = [n for v, n in Counter(v for v, _ in values).items()
                 if n > 1 and len({t for x, t in values if x == v}) > 1]
        return 1 - sum(n * math.log(n) for n in again) / len(values) / math.log(len(values))

    def looks_entropy(values):
        if len(values) < 2:
            return 1.0
        return 1 - sum(n * math.log(n) for n in Counter(v for v, _ in values).values()) / len(values) / math.log(
            len(values))

    def noise(path):
        looks, texts = tree[path]
        above = tree[path[:-4]][0] if path else looks
        return (len(looks) >= html_text.LEAST_PAGES and len(looks) >= html_text.LEAST_SHARE * len(above)
                and looks_entropy(looks) < html_text.LEAST_IMPORTANCE
                and (not texts or entropy(texts) < html_text.LEAST_IMPORTANCE))

    def shared(path, text):
        return len({t for x, t in tree[path][1] if x == text}) > 1

    for page in pages:
        where = {id(node): path for node, path, _ in places(page, ())}

        def goes(node, where=where):
            path, text = where[id(node)], own(node)
            return noise(path) and (not text or shared(path, text)) and all(
                goes(c) for c in node[1] if not isinstance(c, str))

        def blocks(node, cut, top=True):
            if not top and cut and goes(node):
                return
            run = ""
            for child in node[1]:
                if isinstance(child, str):
                    run += child
                else:
                    yield " ".join(run.split())
                    run = ""
                    yield from blocks(child, cut, False)
            yield " ".join(run.split())

        every, left = ([b for b in blocks(page, cut) if b] for cut in (False, True))
        yield left if left and 2 * sum(map(len, left)) > sum(map(len, every)) else every


def test_html_same_as_a_plain_style_tree(spark):
    rng = random.Random(11)
    hosts = [random_host(rng, n) for n in range(20)]
    rows = [(h * 100 + i, f"http://h{h}.org/{i}", as_html(p)) for h, pages in enumerate(hosts) for i, p in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4)
    got = {r.page_id: r.text for r in html_text.extract(df, ["page_id"]).collect()}
    want, cut = {}, 0
    for h, pages in enumerate(hosts):
        for i, blocks in enumerate(plain_style_tree(pages)):
            want[h * 100 + i] = "\n\n".join(blocks)
            cut += want[h * 100 + i] != html_text.main_text(html_text.parse(as_html(pages[i])))
    assert got == want and cut > 20


@pytest.mark.parametrize("markup", [
    "<div>" * 100_000 + "x", "<i>" * 100_000 + "</b>" * 100_000, "<p><div>" + "<i>" * 50_000 + "<hr>" * 50_000,
    "<ul><li>" * 50_000, "<table><tr><td>" * 30_000, "<a " * 50_000, "<!--" * 50_000, "<![CDATA[" * 50_000,
    "<p>" + "<i>a</i>" * 50_000])
def test_html_deep_and_open_markup(markup):
    begin = time.monotonic()
    html_text.main_text(html_text.parse(markup), html_text.Noise(frozenset([0]), frozenset([(0, 0)])))
    assert time.monotonic() - begin < 20


def test_html_names_of_content():
    """Parts of names, ids of headings, layout classes and a form around the page hide no content."""
    text = lambda html: html_text.main_text(html_text.parse(html)).split("\n\n")
    page = ('<article><h2 id="social-impact">A</h2><section id="market-share"><h2>Market share</h2><p>B</section>'
            '<section id="cookies"><h2>Cookies</h2><p>C</section><h2 id="related-work">D</h2><p class="notice">E'
            '<div class="share-buttons">no</div><div id="cookie-banner">no</div>'
            '<section id="comments"><h2>Comments</h2>no</section></article>')
    assert text(page) == ["A", "Market share", "B", "Cookies", "C", "D", "E"]
    assert text('<body><div class="has-sidebar"><p>Text</div><div class="sidebar">no</div>') == ["Text"]
    assert text('<main><div class="content has-sidebar"><p>Text</div></main>') == ["Text"]
    assert text("<body><form id=f><nav>no</nav><p>All the text of it</form>") == ["All the text of it"]
    assert text("<body><form><main><p>Text</main><p>no</form>") == ["Text"]
    assert text("<body><p>A long text of the page<form>Name</form>") == ["A long text of the page"]


def test_html_query(spark, sf):
    """The given pages against a reading of their article alone."""
    import html
    import re

    got = {r.page_id: r.text for r in queries.op7_html_text(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    for r in pages:
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"<br>", " ", re.sub(r"</?b>", "", article)))
        want = [" ".join(html.unescape(x).split()) for x in parts]
        assert got[r.page_id] == "\n\n".join(x for x in want if x)
    assert len(got) == len(pages)


def test_vectors(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    n, _ = brute.cosine_links(rows, 0.95)
    got = {r.vec_id: r for r in queries.op10_vectors(spark, sf).collect()}
    assert set(got) == set(n) and all(got[i].n_links <= n[i] for i in n)
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


def planted(seed, cosines, dim, others):
    """Random vectors, and one near copy of each of the first at the cosine given."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(others, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = [x]
    for i, c in enumerate(cosines):
        side = rng.normal(size=dim)
        side -= (side @ x[i]) * x[i]
        side /= np.linalg.norm(side)
        out.append((c * x[i] + math.sqrt(1 - c * c) * side)[None] * rng.uniform(0.1, 9))
    return np.concatenate(out)


def as_vectors(spark, x, first=0):
    return spark.createDataFrame([(first + i, v) for i, v in enumerate(x.tolist())],
                                 "vec_id bigint, embedding array<double>")


@pytest.mark.parametrize("dim", [16, 64])
def test_vectors_recall_of_planted_pairs(spark, dim):
    """Pairs at the least cosine and above, among vectors that are not near."""
    cosines = [c for c in (0.9501, 0.955, 0.96, 0.97, 0.98, 0.99, 0.999) for _ in range(200)]
    x = planted(7, cosines, dim, 2000)
    found = {(r.a, r.b) for r in vectors.links(vectors.classes(as_vectors(spark, x), "vec_id", "embedding")).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(unit @ unit.T >= 0.95, 1))
    real = set(zip(a.tolist(), b.tolist(), strict=True))
    assert found <= real and len(real) >= len(cosines)
    assert len(found) >= 0.99 * len(real)
    hard = [(i, 2000 + i) for i in range(200)]
    assert len(found.intersection(hard)) >= 0.98 * len(hard)


def test_vectors_in_clusters(spark):
    """Clusters of near copies: links counted and components as by all pairs."""
    rng = np.random.default_rng(8)
    x = [rng.normal(size=(400, 64))]
    for n, spread in ((120, 0.02), (40, 0.1), (30, 0.17), (20, 0.22)):
        x.append(rng.normal(size=64) + rng.normal(size=(n, 64)) * spread)
    rows = list(enumerate(np.concatenate(x).tolist()))
    n, part = brute.cosine_links(rows, 0.95)
    got = {r.vec_id: r for r in vectors.near_duplicates(as_vectors(spark, np.concatenate(x))).collect()}
    assert sum(n.values()) > 10_000 and all(got[i].n_links <= n[i] for i in n)
    assert sum(r.n_links for r in got.values()) >= 0.98 * sum(n.values())
    assert sum(got[i].component_id == part[i] for i in part) >= 0.99 * len(part)


def test_vectors_of_every_length(spark):
    """Near vectors of rare lengths link like any others, learned rotations or not."""
    rng = np.random.default_rng(9)
    tables = [as_vectors(spark, rng.normal(size=(300, 64)))]
    pairs = []
    for k, dim in enumerate((1, 2, 3, 5, 30, 100)):
        v, first = rng.normal(size=dim), 1000 + 10 * k
        tables.append(as_vectors(spark, np.stack([v, v * 1.5 + 0.001, v + 0.002, -v]), first))
        pairs.append(first)
    rows = functools.reduce(lambda a, b: a.unionAll(b), tables)
    for most in (vectors.MOST_LENGTHS, 2):
        got = {r.vec_id: r for r in vectors.near_duplicates(rows, most_lengths=most).collect()}
        for first in pairs:
            assert [got[first + i].n_links for i in range(4)] == [2, 2, 2, 0]
            assert [got[first + i].component_id for i in range(4)] == [first, first, first, first + 3]


def test_vectors_candidates_follow_the_rows(spark):
    """Five times the vectors without a link give at most six times the candidates."""
    rng, counts = np.random.default_rng(10), []
    for n in (2000, 10_000):
        groups = vectors.classes(as_vectors(spark, rng.normal(size=(n, 64))), "vec_id", "embedding")
        plan = vectors.Plan.of(n, 64, 0.95)
        # Those that share a part, before their codes are compared: the expectation for random codes.
        counts.append(n * n / 2 * plan.tables / 2 ** plan.width)
        assert vectors.candidates(groups).count() <= counts[-1]
    assert counts[1] <= 6 * counts[0]
    for n in (10**4, 10**6, 10**8, 10**10):
        one, five = (vectors.Plan.of(k, 64, 0.95) for k in (n, 5 * n))
        assert 25 * five.tables / 2 ** five.width <= 8 * one.tables / 2 ** one.width


def test_vectors_odd_rows(spark):
    rng = random.Random(5)
    base = [rng.gauss(0, 1) for _ in range(8)]
    rows = [(10, base), (3, base), (4, [2 * x for x in base]), (5, None), (6, [0.0] * 8),
            (7, [1.0, None] * 4), (8, [float("nan")] * 8), (9, [float("inf")] * 8), (11, []),
            *((20 + i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(30))]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows],
                               "vec_id bigint, embedding array<double>, v string, n int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect()}
    assert got[10] == (2, 3, False) and got[3] == (2, 3, True) and got[4] == (2, 3, False)
    assert all(got[i] == (0, i, True) for i in (5, 6, 7, 8, 9, 11)) and len(got) == len(rows)
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_components_leave_one_round_behind(spark, tmp_path, monkeypatch):
    """A long path and a star: right components, and no folders of the rounds before the last."""
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(7, 7)]
    monkeypatch.setattr(sinks, "shared_folder", lambda spark: str(tmp_path))
    got = graph.components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()
    assert {r.node: r.component for r in got} == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)}
    assert len(list(tmp_path.iterdir())) == 1
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").collect() == []


def test_pipeline(spark, sf):
    """Each stage on what the one before kept, against plain Python."""
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "ngram_jaccard_join", "substring_dedup", "benchmark_decontamination",
                     "sentencepiece"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(
        odd(spark).select(F.col("doc_id") + 10_000, "text", "lang", F.lit("src"), F.lit(0)).toDF(
            "doc_id", "text", "lang", "source", "n_chars"))
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language_id"](spark, docs, sf).cache()
    assert kept.columns == docs.columns and kept.count() >= docs.count() - 8
    assert all(any(c.isalpha() for c in r.text) for r in kept.collect())

    rows = [r for r in kept.collect() if r.doc_id is not None]
    part = brute.jaccard_classes([(r.doc_id, r.text) for r in rows], 5, 80, 100)
    single = stages["ngram_jaccard_join"](spark, kept, sf).cache()
    assert {r.doc_id for r in single.collect()} - {None} == {i for i, (_, c) in part.items() if c == i}

    rows = [(r.doc_id, r.text) for r in single.collect() if r.doc_id is not None]
    want = {i: (t if not (cut := s[1]) else s[2]) for (i, t), s in
            zip(rows, brute.stripped(rows, 50).values(), strict=True)} if len(dict(rows)) == len(rows) else None
    cut = stages["substring_dedup"](spark, single, sf).cache()
    assert cut.columns == docs.columns
    if want:
        assert {r.doc_id: r.text for r in cut.collect() if r.doc_id is not None} == want

    items = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = stages["benchmark_decontamination"](spark, cut, sf).cache()
    hold = {r.doc_id for r in cut.collect() if any(x in decontaminate.normal(r.text) for x in items)}
    assert not hold & {r.doc_id for r in clean.collect()}
    assert cut.count() - clean.count() <= len(hold) + 2

    last = stages["sentencepiece"](spark, clean, sf).collect()
    assert len(last) == clean.count() and all(r.lossless for r in last)
    whole = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in whole.collect()} <= {r.doc_id for r in docs.collect()}
    for name, stage in stages.items():
        assert stage(spark, docs.limit(0), sf).count() == 0, name
