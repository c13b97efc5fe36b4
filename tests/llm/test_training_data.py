"""Each operator against brute force or a library, and the awkward inputs: nulls, empty and very long texts, ties and
repeated rows, empty tables, extra columns with clashing names."""

from __future__ import annotations

import math
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontamination, embedding_dedup, html_extraction, html_pages, katz, language_id, near_dedup, quality, sentencepiece_fst, textcore, token_counts, toxicity
from tessera.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text: str | None) -> set:
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def sentence(r: random.Random, n: int, pool: str = "abcdefgh") -> str:
    return " ".join("".join(r.choice(pool) for _ in range(r.randint(1, 6))) for _ in range(n))


AWKWARD = [(1, None), (2, ""), (3, "   \n\t "), (4, "x"), (5, "ONE two"), (6, "one TWO"), (6, "one TWO"), (None, "null id text here with more words"), (8, "ünï cödé 😀 日本語 <|endoftext|> end"), (9, "w " * 30000), (10, "a b ▁c\x00d"), (11, "y" * 70000)]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(i, t, None, "s", None) for i, t in AWKWARD], DOCS).withColumns({"score": F.lit("clash"), "ids": F.lit(1), "train": F.lit(0), "lang_pred": F.lit("clash"), "n": F.lit(3), "rep": F.lit("r")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_word_hashes_follow_the_definition():
    r = random.Random(3)
    texts = ["", " ", None, "A b\tC\x0bd\x0c e\r\nf", " wide "] + ["".join(r.choice("aBc \t\né日") for _ in range(r.randint(0, 60))) for _ in range(300)]
    b = next(textcore.blocks(iter([pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})])))
    _, _, row, h = textcore.words(b)
    want = [(i, w) for i, t in enumerate(texts) for w in words(t)]
    assert row.tolist() == [i for i, _ in want]
    assert len(set(h.tolist())) == len({w for _, w in want}) == len(set(zip(h.tolist(), [w for _, w in want], strict=True)))
    sets = textcore.shingle_sets(b)
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]


def test_components_match_brute_force(spark):
    r = random.Random(5)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7)]
    got = {x["node"]: x["component"] for x in components(spark, spark.createDataFrame(edges, "u long, v long"))[0].collect()}
    root = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in root}
    assert components(spark, spark.createDataFrame([], "u long, v long"))[0].count() == 0


# --- 1: pages --------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def extractor():
    return html_extraction.learn(500)


def test_pages_give_the_article_only(extractor):
    page = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body><header class="site-header">Top <a href="/">Home</a></header>
    <nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav><div class="cookie-banner">We use cookies <button>OK</button></div><article><h1>The   title&amp;more</h1>
    <p>First <b>bold</b>text,
      with a <a href="#">link</a>.<p>Second&nbsp;paragraph of the story goes on for some words, it does.<div class="ad">Buy now!</div><script>var a = "<p>no</p>";</script><p>Third <br>one, again with a number of words.</article>
    <section class="comments"><h3>2 comments</h3><div class="comment"><p>I like it.</p></div></section><aside class="sidebar"><h3>Related</h3><ul><li><a href="/c">C</a></ul></aside><!-- hidden --><form><label>Name</label><input></form><footer>&copy; us</footer></body></html>"""
    assert extractor.texts([page]) == ["The title&more First boldtext, with a link. Second paragraph of the story goes on for some words, it does. Third one, again with a number of words."]


def test_pages_held_out_accuracy(extractor):
    good = 0
    for i in range(80):
        p = html_extraction.parse(html_pages.annotated(5_000_000 + i))
        keep = html_extraction.decode(p.parent, extractor.trees.margin(html_extraction.features(p, extractor.odds)))
        good += html_extraction.assemble(p, keep) == html_extraction.assemble(p, p.mark)
    assert good >= 68


def test_decoding_never_contradicts():
    r = np.random.default_rng(1)
    for _ in range(50):
        n = 12
        parent = [-1] + [int(r.integers(0, i)) for i in range(1, n)]
        m = r.normal(0, 2, n)
        keep = html_extraction.decode(parent, m)
        value = lambda y, m=m: sum(-np.logaddexp(0, -m[i]) if y[i] else -np.logaddexp(0, m[i]) for i in range(1, n))
        best = max((value(y), y) for bits in range(1 << (n - 1)) if all((y := [True] + [bool(bits >> k & 1) for k in range(n - 1)])[i] <= y[parent[i]] for i in range(1, n)))
        assert all(keep[i] <= keep[parent[i]] for i in range(1, n))
        assert value(keep) == pytest.approx(best[0])


def test_pages_awkward(spark, extractor):
    rows = [(1, "u", None), (2, None, ""), (2, "u", "plain & simple"), (None, "u", "<p>a</p"), (3, "u", "<div " * 3000), (4, "u", "</p></div><b>x</b>"), (5, "u", "<p title='>'>q</p>")]
    got = html_extraction.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)), extractor).collect()
    assert [r["page_id"] for r in got] == [1, 2, 2, None, 3, 4, 5]
    assert got[0]["text"] == got[1]["text"] == "" and got[2]["text"] == "plain & simple" and got[5]["text"] == "x"
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_extraction.extract(spark, spark.createDataFrame([], "page_id long, url string, html string"), extractor).count() == 0


@pytest.mark.parametrize(
    "source",
    ["<a" * 500_000, "<b" * 500_000, 'a <b"' * 200_000, "</x>" * 250_000, "<b>" * 330_000, "<b><td>" + "<i>" * 160_000 + "</b>" * 120_000, "<head>" * 160_000, "<p><li>" * 140_000, "<b \"'>" * 160_000, "<b x='\"' y=\"'\" '>" * 60_000, "<b \"<b '" * 90_000 + ">", "<div class=a>" * 80_000, "&#" + "9" * 1_000_000 + ";", "<!--" * 250_000, "<!" * 500_000, "&" * 1_000_000],
    ids=lambda s: s[:12],
)
def test_malformed_pages_take_time_in_proportion_to_their_size(extractor, source):
    began = time.process_time()
    extractor.texts([source])
    assert time.process_time() - began < 10


def test_parsing_of_odd_markup():
    segments = lambda s: " ".join(re.sub("[|]+", "|", "".join(x[1] if x else "|" for x in html_extraction.parse(s).segments)).split())
    assert segments("<ul><li><p>a<li><p>b</ul>c") == "|a|b|c" and html_extraction.parse("<ul><li><p>a<li><p>b</ul>c").depth == [0, 1, 2, 3, 2, 3]
    assert segments("a <!--x--> b <!----> c <!--> d <!---> e <!-- f") == "a b c d e"
    assert segments("1 < 2 <3 <b title='<>'>x</b> <b title='>y") == "1 < 2 <3 x y"
    assert segments("&#65;&#x42;&#0000000000067;&#99999999999;&#xFFFFFFFFFF;&amp;lt;&nosuch;") == "ABC\ufffd\ufffd&lt;&nosuch;"


# --- 2: language -----------------------------------------------------------------------------------------------------


def test_languages_are_told_apart(spark):
    r = random.Random(2)
    pools = {"aa": "abcdefgh", "bb": "mnopqrst", "cc": "éàüñö"}
    rows = [(i, sentence(r, r.randint(5, 60), pools[k]), k if i % 11 else None, "s", 0) for i, k in enumerate(random.Random(1).choices(list(pools), k=300))]
    docs = spark.createDataFrame(rows, DOCS)
    model = language_id.learn(docs)
    got = {x["doc_id"]: x for x in language_id.identify(spark, docs, model).collect()}
    truth = {i: next(k for k, p in pools.items() if set(t) - {" "} <= set(p)) for i, t, *_ in rows}
    assert sum(got[i]["lang_pred"] == truth[i] for i in truth) >= 297
    assert all(0 <= x["score"] <= 1 for x in got.values())


def test_language_awkward(spark, awkward, empty):
    assert language_id.identify(spark, empty, language_id.learn(empty)).count() == 0
    got = language_id.identify(spark, awkward, language_id.learn(awkward)).collect()
    assert len(got) == len(AWKWARD) and {x["lang_pred"] for x in got} == {"und"}  # nothing to learn from
    model = language_id.fit({"aa": ["abab abab"] * 5, "zz": ["zyzy zyzy"] * 5})
    got = language_id.identify(spark, awkward.union(awkward.limit(1).withColumn("text", F.lit("12 .,! 34"))), model).collect()
    assert got[-1]["lang_pred"] == "und" and got[-1]["score"] == 0
    assert [x["lang_pred"] for x in got[:3]] == ["und"] * 3


# --- 3: token counts -------------------------------------------------------------------------------------------------


def test_token_counts_equal_the_library(spark, awkward, empty):
    tok = token_counts.tokenizer("byte_bpe_50k.json")
    r = random.Random(4)
    extra = [(100 + i, "".join(r.choice("ab 'st1!\n\té日😀 　") for _ in range(r.randint(0, 200)))) for i in range(200)]
    docs = awkward.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string")).withColumn("tokens", F.lit("clash"))
    got = Counter((x["doc_id"], x["n_bytes"], x["n_tokens"], x["over_limit"]) for x in token_counts.count_tokens(docs).collect())
    want = Counter()
    for i, t in AWKWARD + extra:
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        want[(i, len((t or "").encode()), n, n > 512)] += 1
    assert got == want
    assert token_counts.count_tokens(empty).count() == 0


# --- 4: embeddings ---------------------------------------------------------------------------------------------------


def test_embeddings_match_brute_force(spark):
    r = np.random.default_rng(4)
    base = r.normal(0, 1, (40, 64))
    rows = []
    for i in range(400):
        v = base[i % 40] + r.normal(0, r.choice([0.02, 0.1, 0.3]), 64)
        rows.append((i, v.astype(np.float32).tolist(), int(i % 3)))
    rows += [(400 + i, rows[i % 7][1], rows[i % 7][2]) for i in range(60)]
    rows += [(500, None, 1), (501, [0.0] * 64, 1), (502, [float("nan")] * 64, 1), (503, [None] * 64, 1), (504, rows[0][1], None), (505, [], 1), (506, [1.0, 2.0], 1), (507, [2.0, 4.0], 1), (None, rows[0][1], rows[0][2])]
    got = {x["vec_id"]: x for x in embedding_dedup.labelled(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit("x"))).collect()}
    ok = {i: np.array(v, np.float64) for i, v, lab in rows if i is not None and v and lab is not None and None not in v and np.isfinite(v).all() and any(v)}
    label = {i: lab for i, _, lab in rows}
    links = defaultdict(set)
    ids = sorted(ok)
    for a in ids:
        for b in ids:
            if a < b and label[a] == label[b] and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= 0.98:
                links[a].add(b)
                links[b].add(a)
    assert len(got) == len(rows)
    found = sum(got[i]["n_links"] for i in got)
    assert found >= 0.97 * sum(map(len, links.values())) and all(got[i]["n_links"] <= len(links[i]) for i in got)
    for i in (500, 501, 502, 503, 504, 505):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert got[507]["component_id"] == 506 and not got[507]["kept"]
    assert got[None]["component_id"] is None and got[None]["kept"]
    assert embedding_dedup.labelled(spark, spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_embeddings_equal_their_sql(spark, monkeypatch):
    """Repeated rows and ids, equal vectors under several ids and labels, doubles closer to the threshold than floats tell."""
    import duckdb

    r = np.random.default_rng(8)
    base = r.normal(0, 1, (12, 16))
    rows = [(int(r.integers(0, 60)), (base[i % 12] + r.normal(0, r.choice([0.01, 0.1]), 16)).tolist(), int(r.integers(0, 2))) for i in range(120)]
    rows += rows[:30] + [(i + 100, v, lab) for i, v, lab in rows[:30]] + [(7, None, 1), (7, rows[0][1], None), (8, [0.0] * 16, 0), (300, None, 0), (300, None, 0)]
    # cosine 0.98 to the last digits: above and below, equal as floats
    for k, c in enumerate((0.98 + 1e-10, 0.98 - 1e-10)):
        rows += [(400 + 2 * k, [1.0, 0.0], 5 + k), (401 + 2 * k, [c, math.sqrt(1 - c * c)], 5 + k)]
    rows += [(1, rows[0][1], 9), (1, rows[0][1], 9), (2, rows[0][1], 9)]
    for block in (1024, 8):
        monkeypatch.setattr(embedding_dedup, "BLOCK", block)
        embeddings = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
        con = duckdb.connect()
        con.register("embeddings", embeddings.toArrow())
        want = Counter(con.sql(embedding_dedup.OP4_SQL).fetchall())
        got = Counter(tuple(x) for x in embedding_dedup.labelled(spark, embeddings).select("vec_id", "n_links", "component_id", "kept").collect())
        assert got == want


@pytest.mark.parametrize("dim", [3, 64, 768])
def test_embedding_links_are_found_at_the_threshold(spark, dim):
    r = np.random.default_rng(dim)
    n = 400
    a, b = r.normal(size=(2, n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = 0.9801
    rows = [(i, v.tolist(), i % n) for i, v in enumerate(np.concatenate([a, c * a + np.sqrt(1 - c * c) * b]))]
    got = embedding_dedup.labelled(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert got.where("n_links = 1").count() >= 0.95 * 2 * n
    for magnitude in (6, 14, 20):
        axes, tables = embedding_dedup.plan(dim, magnitude, 0.98)
        x, y = (embedding_dedup.hashes(v, axes, tables) for v in (a, c * a + np.sqrt(1 - c * c) * b))
        met = ((x[:, :, :1] == y) | (y[:, :, :1] == x)).any((1, 2))
        assert met.mean() >= 0.98


def test_embedding_meetings_grow_with_the_vectors():
    """Random vectors: pairs that meet, each of which is compared, per vector."""
    r = np.random.default_rng(1)
    each = {}
    for n in (1000, 4000, 16000):
        axes, tables = embedding_dedup.plan(64, math.ceil(math.log2(n)), 0.98)
        code = embedding_dedup.hashes(r.normal(size=(n, 64)), axes, tables)
        met = 0
        for t in range(tables):
            kinds, size = np.unique(code[:, t], return_counts=True)
            met += int((size * (size - 1) // 2).sum())
        each[n] = met / n
    assert each[16000] < 4 * max(each[1000], 0.5)


def test_hot_embeddings_are_split(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    r = np.random.default_rng(6)
    one = r.normal(0, 1, 32)
    rows = [(i, (one + r.normal(0, 0.02, 32)).tolist(), 1) for i in range(150)]
    got = embedding_dedup.labelled(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert {x["component_id"] for x in got} == {0} and {x["n_links"] for x in got} == {149}


# --- 5 and 9: classifiers --------------------------------------------------------------------------------------------


def labelled_texts(seed: int, n: int):
    r = random.Random(seed)
    out = []
    for i in range(n):
        t = sentence(r, r.randint(10, 120), "abcdefghij").split()
        bad = i % 4 == 0
        if bad:
            t[r.randrange(len(t))] = r.choice(["zuxor", "zuxorn", "vikka"])
        out.append((i, " ".join(t), 1 if bad else 0))
    return out


def test_toxicity_learns_words_and_their_forms(spark):
    train = labelled_texts(1, 600)
    net = toxicity.train([t for _, t, _ in train], np.array([y for *_, y in train]))
    held = labelled_texts(2, 200)
    p = np.concatenate([net.probability(net.documents(b)) for b in toxicity.blocks_of([t for _, t, _ in held])])
    y = np.array([y for *_, y in held])
    assert ((p >= 0.5) == (y == 1)).mean() >= 0.95


def test_toxicity_training_is_bounded_in_memory():
    r = np.random.default_rng(11)
    pool = np.array([sentence(random.Random(i), 1, "abcdefghijklmnop") + "aeiou"[i % 5] for i in range(20_000)])
    texts = [" ".join(r.choice(pool, 900)) + " zuxor" * (i % 4 == 0) for i in range(1000)]
    toxicity.train(["one", "two"], np.array([0, 1]))  # loads what is loaded at first use
    tracemalloc.start()
    try:
        net = toxicity.train(texts, np.array([i % 4 == 0 for i in range(1000)]).astype(int))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # the driver holds parameters and their moments (three times) and a few times the texts
    assert peak <= 3 * sum(x.nbytes for x in net.p.values()) + 10 * sum(map(len, texts))


def test_toxicity_training_in_pieces_counts_as_one(monkeypatch):
    texts = [t for _, t, _ in labelled_texts(3, 230)] + ["", "12 34", "ÜNÏ zuxor " * 300, "one"]
    y = np.array([i % 3 == 0 for i in range(len(texts))]).astype(np.float64)
    whole = toxicity.words_of(next(toxicity.blocks_of(texts)))
    monkeypatch.setattr(toxicity, "PIECE_BYTES", 500)
    monkeypatch.setattr(toxicity, "PIECE_WORDS", 50)
    monkeypatch.setattr(toxicity, "PIECE_KINDS", 7)
    w = toxicity.words_of_texts(texts)
    for k in ("row", "kind", "slot", "chars", "of", "hash"):
        assert np.array_equal(getattr(w, k), getattr(whole, k))
    own = [np.bincount(w.of, w.chars == c, minlength=len(w.slot)) > 0 for c in np.unique(w.chars)]
    docs, stem_docs = toxicity.documents_with(w, np.searchsorted(w.of, np.arange(len(w.slot) + 1)), y)
    has = np.zeros((len(texts), len(w.slot)), bool)
    has[w.row, w.kind] = True
    assert np.array_equal(docs, [(1 - y) @ has, y @ has])
    for c, kinds in zip(np.unique(w.chars), own, strict=True):
        if c >= 1 << toxicity.CHAR_BITS:
            some = has[:, kinds].any(1)
            assert np.array_equal(stem_docs[:, c - (1 << toxicity.CHAR_BITS)], [(1 - y) @ some, y @ some])
    net = toxicity.Network()
    net.p["char"][:] = np.random.default_rng(1).normal(size=net.p["char"].shape)
    small = net.inputs(w)
    first, _ = toxicity.windows(w.row, len(texts))
    kinds = np.concatenate(list(toxicity.kinds_of(w, first, 13)))
    plain = [[w.kind[i] if i < len(w.row) and w.row[i] == w.row[f] else len(w.slot) for i in range(f, f + toxicity.SPAN)] for f in first]
    assert np.array_equal(kinds, plain)
    monkeypatch.setattr(toxicity, "PIECE_KINDS", 1 << 14)
    assert np.array_equal(small, net.inputs(whole))


def test_toxicity_gradients(monkeypatch):
    monkeypatch.setattr(toxicity, "F32", np.float64)
    r = np.random.default_rng(0)
    net = toxicity.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = r.normal(0, 1, (9, toxicity.WIDTH))
    x[-1] = 0
    kinds = r.integers(0, 8, (4, toxicity.SPAN))
    kinds[2, 5:] = 8
    y, w = np.array([1.0, 0, 1, 0]), np.ones(4)
    g, dx, _ = net.gradients(kinds, x, y, w)
    for k in ("Wf", "Uf", "cb", "Ub", "A", "a", "w", "b"):
        i = tuple(int(r.integers(0, s)) for s in net.p[k].shape)
        old = net.p[k][i]
        ends = []
        for e in (1e-5, -1e-5):
            net.p[k][i] = old + e
            ends.append(net.gradients(kinds, x, y, w)[2])
        net.p[k][i] = old
        assert (ends[0] - ends[1]) / 2e-5 == pytest.approx(g[k][i], rel=1e-4, abs=1e-8)


def test_windows_cover_every_word():
    row = np.repeat(np.arange(5), [0, 3, 24, 25, 100])
    first, doc = toxicity.windows(row, 5)
    at = textcore.bounds(row, 5)
    for d in range(5):
        seen = {k for f in first[doc == d] for k in range(f, min(f + toxicity.SPAN, at[d + 1]))}
        assert seen == set(range(at[d], at[d + 1]))


def test_quality_learns(spark):
    r = random.Random(7)
    make = lambda i: (sentence(r, r.randint(20, 200)), 1) if i % 3 else ("| ".join(sentence(r, r.randint(20, 200)).upper().split()), 0)
    train, held = [make(i) for i in range(300)], [make(i) for i in range(90)]
    net = quality.train([t for t, _ in train], np.array([y for _, y in train]))
    p = np.concatenate([net.probability(net.documents(b)) for b in toxicity.blocks_of([t for t, _ in held])])
    assert ((p >= 0.7) == (np.array([y for _, y in held]) == 1)).mean() >= 0.97


def test_quality_gradients():
    r = np.random.default_rng(0)
    net = quality.Attention()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    f, doc, y = r.normal(0, 0.3, (7, quality.FEATURES)), np.array([0, 0, 1, 1, 1, 2, 2]), np.array([1.0, 0, 1])
    g = net.gradients(f, doc, y, np.ones(3))

    def loss():
        p = toxicity.sigmoid(net.forward(f, doc))
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    for k in net.p:
        i = tuple(int(r.integers(0, s)) for s in net.p[k].shape)
        old = net.p[k][i]
        net.p[k][i] = old + 1e-6
        a = loss()
        net.p[k][i] = old - 1e-6
        b = loss()
        net.p[k][i] = old
        assert (a - b) / 2e-6 == pytest.approx(g[k][i], rel=1e-3, abs=1e-6)


@pytest.mark.parametrize("op,label", [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers_awkward(spark, awkward, empty, op, label):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 12)] + [(None, 1, 1), (4, None, None), (5, 1, 1)], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(i, 1, 1) for i in range(1, 12)], "doc_id long, quality int, toxic int")
    for lab in (none, some, one):
        got = op.score(spark, awkward, op.learn(awkward, lab)).collect()
        assert len(got) == len(AWKWARD) and all(0 <= x["score"] <= 1 for x in got)
        assert op.score(spark, empty, op.learn(empty, lab)).count() == 0


# --- 6: decontamination ----------------------------------------------------------------------------------------------


def test_contained_items_are_all_found(spark):
    r = random.Random(6)
    items = [(i, sentence(r, r.choice([1, 3, 5, 8, 15, 16, 17, 33, 60, 130]))) for i in range(60)] + [(60, None), (61, ""), (7, "again the same id but another text of eight words")]
    docs = []
    for i in range(200):
        w = sentence(r, r.randint(0, 400)).split()
        own = (r.choice(items)[1] or "").split()
        if r.random() < 0.7:
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                if own:
                    own[r.randrange(len(own))] = "changed"
            at = r.randint(0, len(w))
            w[at:at] = own
        docs.append((i, "  ".join(w).upper() if i % 3 else " ".join(w)))
    docs += [(900, None), (901, ""), (None, items[12][1])]
    got = Counter((x["doc_id"], x["item_id"], x["shared"]) for x in decontamination.contaminated(spark, spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(0)), spark.createDataFrame(items, "item_id long, text string")).collect())
    want = Counter()
    for i, t in docs:
        for k, x in items:
            s = shingles(x)
            n = len(s & shingles(t))
            if s and n >= 0.8 * len(s) - 1e-9:
                want[(i, k, n)] += 1
    assert got == want and len(want) > 40
    left = decontamination.decontaminate(spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {x["doc_id"] for x in left.collect()} == {i for i, _ in docs} - {i for i, *_ in want}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contaminated(spark, left, none).count() == 0 and decontamination.decontaminate(spark, left, none).count() == left.count()


def test_items_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "ITEMS", 2)
    monkeypatch.setattr(decontamination, "ITEM_SHINGLES", 5)
    items = [(i, f"a{i} b c d e f g{i}") for i in range(5)]
    docs = [(i, f"x y {t} z") for i, t in items]
    got = {(x["doc_id"], x["item_id"]) for x in decontamination.contaminated(spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(i, i) for i in range(5)}


# --- 7: SentencePiece ------------------------------------------------------------------------------------------------


def test_encoding_equals_the_library(spark, awkward, empty):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    r = random.Random(7)
    extra = [(100 + i, "".join(r.choice("ab cde thing on▁\n\té日😀") for _ in range(r.randint(0, 150)))) for i in range(400)]
    docs = awkward.union(spark.createDataFrame(extra, "doc_id long, text string").select("doc_id", "text", *[F.lit(None).alias(c) for c in awkward.columns[2:]]))
    got = sentencepiece_fst.encode(docs).collect()
    assert len(got) == len(AWKWARD) + len(extra)
    for x in got:
        want = sp.encode(x["text"] or "")
        assert x["ids"] == want and x["n_tokens"] == len(want) and x["decoded"] == sp.decode(want)
    assert sentencepiece_fst.encode(empty).count() == 0


def test_decoding_of_any_ids_equals_the_library():
    import public_tokenizers
    import sentencepiece

    t = sentencepiece_fst.transducer("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    r = random.Random(8)
    for _ in range(300):
        ids = [r.choice([r.randint(3, 258), r.randint(259, 31999)]) for _ in range(r.randint(1, 12))]
        assert t.decode(ids) == sp.decode(ids)


# --- 8: near-duplicates ----------------------------------------------------------------------------------------------


def near_brute(docs: list, percent: int) -> dict:
    ids = [i for i, _ in docs if i is not None]
    root = {i: i for i in ids}
    sets = [(i, shingles(t)) for i, t in docs if i is not None]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def copies(seed: int) -> list:
    r = random.Random(seed)
    docs = []
    for _ in range(25):
        base = sentence(r, r.randint(3, 120)).split()
        for _ in range(r.choice([1, 2, 5, 9])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 5])):
                w[r.randrange(len(w))] = "edit" + str(r.randint(0, 99))
            docs.append((len(docs), " ".join(w)))
    r.shuffle(docs)
    return docs


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_match_brute_force(spark, percent):
    docs = copies(percent) + [(i, t) for i, t in [(1000, None), (1001, ""), (1002, " "), (1003, "two words"), (1004, "two words"), (1005, "TWO  words"), (None, "two words")]]
    got = {x["doc_id"]: x for x in near_dedup.labelled(spark, spark.createDataFrame(docs, "doc_id long, text string").withColumn("rep", F.lit(1)), percent).collect()}
    want = near_brute(docs, percent)
    assert {i: x["component_id"] for i, x in got.items() if i is not None} == want
    assert all(x["kept"] == (x["component_id"] == i) for i, x in got.items() if i is not None)
    assert got[None]["component_id"] is None and got[None]["kept"]
    assert {i: x["n_shingles"] for i, x in got.items()} == {i: len(shingles(t)) for i, t in docs}


def test_large_groups_are_split(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BUCKET_BLOCK", 8)
    monkeypatch.setattr(near_dedup, "TEXT_BLOCK", 8)
    r = random.Random(9)
    base = sentence(r, 150).split()
    docs = []
    for i in range(120):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = f"e{r.randint(0, 9)}"
        docs.append((i, " ".join(w)))
    got = {x["doc_id"]: x["component_id"] for x in near_dedup.labelled(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == near_brute(docs, 85)


@pytest.mark.parametrize("sides", [(0,), (1, 2)])
def test_pivots_connect_what_all_pairs_connect(monkeypatch, sides):
    r = np.random.default_rng(12)
    base = r.integers(0, 256, (6, near_dedup.MINIMA), dtype=np.uint8)
    sig = base[r.integers(0, 6, 500)]
    noise = r.random(sig.shape) < r.choice([0.01, 0.1, 0.2], 500)[:, None]
    sig = np.where(noise, r.integers(0, 256, sig.shape), sig).astype(np.uint8)
    group = np.sort(r.integers(0, 4, 500))
    batch = pa.RecordBatch.from_pydict({"band": pa.array(np.full(500, 3, np.int32)), "key": pa.array(group), "bi": pa.array(np.zeros(500, np.int32)), "bj": pa.array(np.zeros(500, np.int32)), "side": pa.array(r.choice(sides, 500).astype(np.int32)), "rep": pa.array(np.arange(500)), "n": pa.array(np.full(500, 100)), "sig": pa.array([x.tobytes() for x in sig], pa.binary())})
    parts = []
    for least in (10**9, 8):
        monkeypatch.setattr(near_dedup, "PIVOT_FROM", least)
        root = np.arange(500)
        for edges in near_dedup.forests(iter([batch]), 85):
            root = near_dedup.merge(root, *(edges.column(c).to_numpy() for c in ("u", "v")))
        parts.append(root.tolist())
    assert parts[0] == parts[1] and 4 < len(set(parts[0])) < 490


def test_groups_are_bounded_by_bytes_and_whole(monkeypatch):
    monkeypatch.setattr(near_dedup, "GROUP_BYTES", 40_000)
    parts = [pa.RecordBatch.from_pydict({"comp": [i // 3, (i + 1) // 3], "text": ["x" * 10_000] * 2}) for i in range(0, 60, 2)]
    got = list(near_dedup.groups(iter(parts), ("comp",), 2048))
    assert sum(b.num_rows for b in got) == 60 and len(got) >= 10
    whole = [set(b.column("comp").to_pylist()) for b in got]
    assert sum(map(len, whole)) == len(set().union(*whole))
    assert all(b.schema.field("text").type == pa.large_string() for b in got)


def test_rows_are_never_dropped_in_joining(monkeypatch):
    class Split:
        """A table whose chunks can't be combined, as one of over 2 GB."""

        def __init__(self, table):
            self.table, self.schema, self.num_rows = table, table.schema, table.num_rows

        from_batches = classmethod(lambda cls, parts: cls(pa.Table.from_batches(parts)))
        cast = combine_chunks = lambda self, *_: self

        def to_batches(self):
            return self.table.to_batches()

    parts = [pa.RecordBatch.from_pydict({"text": ["a"]}), pa.RecordBatch.from_pydict({"text": ["b"]})]
    assert near_dedup.joined(parts).num_rows == 2
    fake = type("Arrow", (), {"__getattr__": lambda _, k: Split if k == "Table" else getattr(pa, k)})()
    monkeypatch.setattr(near_dedup, "pa", fake)
    with pytest.raises(RuntimeError):
        near_dedup.joined(parts)


def test_components_of_long_texts_are_split(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SHINGLE_BLOCK", 600)
    most = []
    own = near_dedup.with_texts

    def with_texts(*args):
        out = own(*args)
        most.append(out.groupBy("comp", "bi").count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(near_dedup, "with_texts", with_texts)
    r = random.Random(10)
    base = sentence(r, 150).split()
    docs = []
    for i in range(40):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = f"e{r.randint(0, 9)}"
        docs.append((i, " ".join(w)))
    got = {x["doc_id"]: x["component_id"] for x in near_dedup.labelled(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == near_brute(docs, 85)
    assert 0 < most[0] < 30


def test_near_duplicates_awkward(spark, awkward, empty):
    assert near_dedup.labelled(spark, empty).count() == 0
    got = near_dedup.labelled(spark, awkward).collect()
    assert len(got) == len(AWKWARD)
    by = {x["doc_id"]: x["component_id"] for x in got}
    assert by[6] == 5 and by[1] == 1 and by[2] == 2


def test_posterior_bounds_keep_true_pairs():
    least = near_dedup.least_matches(85, near_dedup.MINIMA)
    assert list(least) == sorted(least) and 60 <= least[-1] <= 85
    r = np.random.default_rng(0)
    lost = 0
    for _ in range(2000):
        hits = np.cumsum(r.random(near_dedup.MINIMA) < 0.85)
        lost += any(hits[min((k + 1) * near_dedup.BATCH, near_dedup.MINIMA) - 1] < m for k, m in enumerate(least))
    assert lost <= 4


# --- 10: language model ----------------------------------------------------------------------------------------------


class Brute:
    """Katz back-off counted and evaluated word by word."""

    def __init__(self, seqs: list, order: int):
        self.n = order
        self.count = [Counter() for _ in range(order + 1)]
        for s in seqs:
            for i in range(len(s)):
                for k in range(1, order + 1):
                    self.count[k][self.gram(s, i, k)] += 1
        coc = [[sum(v == r for v in c.values()) for r in range(1, katz.TOP + 2)] for c in self.count]
        self.uni = katz.Unigrams([len(self.count[1]), sum(self.count[1].values()), *coc[1]])
        self.d = [katz.discounts(c) for c in coc]
        self.after = defaultdict(dict)
        for k in range(2, order + 1):
            for g, c in self.count[k].items():
                self.after[g[:-1]][g[-1]] = c

    @staticmethod
    def gram(s: list, i: int, k: int) -> tuple:
        return (*["<s>"] * max(0, k - 1 - i), *s[max(0, i - k + 1) : i + 1])

    def share(self, h: tuple, c: int) -> float:
        size = sum(self.after[h].values()) + all(c > katz.TOP for c in self.after[h].values())
        return (self.d[len(h) + 1][c] if c <= katz.TOP else 1) * c / size

    def p(self, h: tuple, w: str) -> float:
        if not h:
            return float(self.uni.p(np.array([self.count[1][w,]]))[0])
        if h not in self.after:
            return self.p(h[1:], w)
        c = self.after[h].get(w, 0)
        return self.share(h, c) if c else self.alpha(h) * self.p(h[1:], w)

    def alpha(self, h: tuple) -> float:
        own = self.after[h]
        return (1 - sum(self.share(h, c) for c in own.values())) / (1 - sum(self.p(h[1:], w) for w in own))

    def score(self, s: list) -> float:
        return sum(np.log10(self.p(self.gram(s, i, self.n)[:-1], s[i])) for i in range(len(s)))


def katz_texts() -> list:
    r = random.Random(10)
    pool = [sentence(r, 1) for _ in range(60)]
    docs = [(i, " ".join(r.choice(pool[: r.choice([5, 60])]) for _ in range(r.randint(0, 80))) + (" new" + str(i) if i % 9 == 0 else "")) for i in range(150)]
    return [*docs, *[(200 + i, "a b c") for i in range(20)], (500, None), (501, "")]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_katz_matches_brute_force_and_sums_to_one(spark, monkeypatch, order):
    monkeypatch.setattr(katz, "PART_BYTES", 4000)  # several partitions
    docs = katz_texts()
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in docs}
    got = {x["doc_id"]: x for x in katz.score_texts(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(3), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0, order).collect()}
    seqs = {i: [*words(t), "</s>"] for i, t in docs}
    brute = Brute([s for i, s in seqs.items() if not held[i]], order)
    uni = brute.count[1]
    every = [w for (w,) in uni]
    for h in [(), *[h for h in brute.after if len(h) < 3 or h[0] == "<s>"][:60]]:
        assert sum(brute.p(h, w) for w in every) + brute.p(h, "never seen") == pytest.approx(1, abs=1e-9)
    total = sum(uni.values())
    for i, s in seqs.items():
        x = got[i]
        assert (x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"]) == (held[i], len(s), sum(uni[w,] > 0 for w in s), total)
        assert x["base_score"] == pytest.approx(sum(np.log10((uni[w,] + 0.1) / (total + 0.1 * (len(uni) + 1))) for w in s))
        assert x["score"] == pytest.approx(brute.score(s), rel=1e-9)


def test_katz_probabilities_sum_to_one_after_the_start_and_hot_histories(spark, monkeypatch):
    """P of every next word after a prefix is the difference of two scores; all of them and the unknown word's make one."""
    monkeypatch.setattr(katz, "HOT_TOKENS", 3)
    train = spark.createDataFrame([(i, t) for i, t in enumerate(["a b c"] * 20 + ["a a b", "a c b d", "d a b c"])], "doc_id long, text string")
    model = katz.fit(spark, train)
    assert len(model.hot[1][0]) >= 3 and len(model.hot[2][0]) >= 3
    prefixes, last = ["", "a", "a b", "a a", "d", "b", "zzz", "a b c"], ["a", "b", "c", "d", "never"]
    rows = [(p, w, " ".join([*p.split(), w])) for p in prefixes for w in last] + [(p, None, p) for p in prefixes]
    got = {x["doc_id"]: x["score"] for x in katz.score(spark, spark.createDataFrame([(i, t) for i, (*_, t) in enumerate(rows)], "doc_id long, text string"), model).collect()}
    brute = Brute([[*t.split(), "</s>"] for t in ["a b c"] * 20 + ["a a b", "a c b d", "d a b c"]], 3)
    for p in prefixes:
        # the score of a text has the end's probability in it, which brute force takes away again
        mass = 0.0
        for i, (q, w, t) in enumerate(rows):
            if q == p:
                s = t.split()
                end = np.log10(brute.p(brute.gram([*s, "</s>"], len(s), 3)[:-1], "</s>"))
                assert got[i] == pytest.approx(brute.score([*s, "</s>"]), rel=1e-12)
                if w is not None:
                    mass += 10 ** (got[i] - end - (brute.score([*s[:-1], "</s>"]) - np.log10(brute.p(brute.gram([*s[:-1], "</s>"], len(s) - 1, 3)[:-1], "</s>"))))
                else:
                    mass += 10**end
        assert mass == pytest.approx(1, abs=1e-9)


def test_katz_is_the_same_whatever_is_hot(spark, monkeypatch):
    r = random.Random(11)
    docs = spark.createDataFrame([(i, " ".join(r.choice("a a a a b c d e f".split()) for _ in range(200))) for i in range(40)] + [(50 + i, f"start {r.choice('abc')}") for i in range(30)], "doc_id long, text string").repartition(4)
    monkeypatch.setattr(katz, "PART_BYTES", 2000)
    cold = {x["doc_id"]: x["score"] for x in katz.score_texts(spark, docs, F.col("doc_id") % 5 != 0).collect()}
    for least in (10, 0):
        monkeypatch.setattr(katz, "HOT_TOKENS", least)
        assert {x["doc_id"]: x["score"] for x in katz.score_texts(spark, docs, F.col("doc_id") % 5 != 0).collect()} == cold


def test_katz_stored_model_scores_as_the_joint_run(spark, monkeypatch):
    monkeypatch.setattr(katz, "PART_BYTES", 4000)
    docs = spark.createDataFrame(katz_texts(), "doc_id long, text string").repartition(3)
    train = F.col("doc_id") % 3 != 0
    joint = {x["doc_id"]: x["score"] for x in katz.score_texts(spark, docs, train).collect()}
    model = katz.fit(spark, docs.where(train))
    assert {x["doc_id"]: x["score"] for x in katz.score(spark, docs, model).collect()} == joint


def test_katz_awkward(spark, awkward, empty):
    got = katz.score_texts(spark, awkward, F.lit(True)).collect()
    assert len(got) == len(AWKWARD) and all(np.isfinite(x["score"]) for x in got)
    assert katz.score_texts(spark, empty, F.lit(True)).count() == 0
    assert all(np.isfinite(x["score"]) and x["train_tokens"] == 0 for x in katz.score_texts(spark, awkward, F.lit(False)).collect())


def test_discounts_are_sane():
    for n in ([100, 50, 30, 20, 15, 10], [0] * 6, [5, 0, 0, 0, 0, 0], [1, 2, 3, 4, 5, 6]):
        d = katz.discounts(n)
        assert all(0 < x < 1 for x in d[1:])
