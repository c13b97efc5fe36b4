"""Every query of the training-data operators on awkward tables, the trained ones against plain loops over the same
model, and held-out accuracy on the given labels."""

from __future__ import annotations

import os
import random
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import html_extraction, html_pages, katz, language_id, quality, queries, toxicity
from tessera.llm.common import excerpt

SF = "/root/testdata/sf0.01"
POOLS = {"aa": "abcdefgh", "bb": "mnopqrst"}


def prose(r: random.Random, lang: str, n: int) -> str:
    return " ".join("".join(r.choice(POOLS[lang]) for _ in range(r.randint(1, 6))) for _ in range(n))


def documents() -> list:
    r = random.Random(5)
    rows = []
    for i in range(240):
        lang = r.choice("ab") * 2
        text = prose(r, lang, r.randint(5, 80))
        if i % 5 == 0:
            text += " zuxor vikka"
        if i % 7 == 0:
            text = "| ".join(text.upper().split())
        rows.append((i, text, lang if i % 9 else None, "s", len(text)))
    rows += [(300, None, "aa", None, None), (301, "", "bb", "s", 0), (302, "  \t\n", None, "s", 4), (303, "12 34 --", "aa", "s", 8), (None, rows[0][1], "aa", "s", 1), (None, None, None, None, None)]
    rows += [rows[3], rows[3], (4, "another text under an id that is there already", "aa", "s", 1), (304, "w " * 40_000, "bb", "s", 1), (305, "y" * 50_000, "bb", "s", 1), (306, "ünï cödé 😀 日本語 <|endoftext|>", "aa", "s", 1)]
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with awkward rows and columns named like the operators' own."""
    top = str(tmp_path_factory.mktemp("tables"))
    rows = documents()
    clash = {c: F.lit(c) for c in ("score", "evidence", "lang_pred", "held_out", "ids", "n_tokens", "block", "bucket", "rep", "node", "n", "f1", "train", "tokens", "place", "comp")}
    write = lambda name, data, ddl: spark.createDataFrame(data, ddl).withColumns(clash).repartition(3).write.parquet(f"{top}/{name}.parquet")
    write("documents", rows, "doc_id long, text string, lang string, source string, n_chars long")
    write("labels", [(i, int(i % 7 != 0), int(i % 5 == 0)) for i in range(240)] + [(None, 1, 1), (3, None, None), (999, 0, 1)], "doc_id long, quality int, toxic int")
    write("benchmark", [(1, rows[10][1]), (2, None), (3, ""), (None, rows[11][1]), (1, rows[12][1])], "item_id long, text string")
    write("pages", [(1, "u", html_pages.annotated(3)), (2, None, None), (None, "u", ""), (1, "u", html_pages.annotated(4)), (4, "u", "<a" * 5000)], "page_id long, url string, html string")
    r = np.random.default_rng(3)
    base = r.normal(0, 1, (6, 8))
    vectors = [(i, (base[i % 6] + r.normal(0, 0.02, 8)).astype(np.float32).tolist(), i % 2) for i in range(40)]
    write("embeddings", [*vectors, vectors[0], (None, vectors[0][1], 0), (50, None, 0), (51, [0.0] * 8, 1), (52, [float("nan")] * 8, 1), (53, vectors[0][1], None), (54, [], 0)], "vec_id long, embedding array<float>, label int")
    return top


@pytest.fixture(scope="module")
def empty(spark, folder, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "benchmark", "pages", "embeddings"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).coalesce(1).write.parquet(f"{top}/{name}.parquet")
    return top


COLUMNS = {
    "op1_html_extraction": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op2_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op3_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op4_embedding_dedup": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op5_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op6_decontamination": {"doc_id": "bigint", "item_id": "bigint"},
    "op7_sentencepiece": {"doc_id": "bigint", "ids": "array<int>", "n_tokens": "bigint", "decoded": "string"},
    "op8_near_dedup": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op9_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op10_katz": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
}
FOLDS = {"op2_language_id": (5, 0), "op5_quality": (4, 2), "op9_toxicity": (5, 0), "op10_katz": (10, 0)}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_queries_on_awkward_and_empty_tables(spark, folder, empty, name):
    run = queries.queries()[name]
    none = run(spark, empty)
    assert dict(none.dtypes).items() >= COLUMNS[name].items() and none.count() == 0
    rows = run(spark, folder).collect()
    docs = documents()
    if name in ("op1_html_extraction", "op4_embedding_dedup", "op6_decontamination"):
        ids = {"op1_html_extraction": [1, 1, 2, 4, None], "op4_embedding_dedup": [*range(40), 50, 51, 52, 53, 54, None]}
        if name in ids:
            assert Counter(r[0] for r in rows) == Counter(ids[name])
        else:
            assert {(r["doc_id"], r["item_id"]) for r in rows} >= {(10, 1), (12, 1)} and all(r["item_id"] is not None for r in rows)
        return
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, *_ in docs)
    if name in FOLDS:
        mod, k = FOLDS[name]
        assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % mod == k) for r in rows)
    if "predicted" in rows[0]:
        least = 0.7 if name == "op5_quality" else 0.5
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= least) for r in rows)
    if name == "op2_language_id":
        assert {r["doc_id"] for r in rows if r["lang_pred"] == "und"} == {300, 301, 302, 303, None} and all(0 <= r["score"] <= 1 for r in rows)
    if name == "op8_near_dedup":
        assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in rows)


def test_language_filters_against_exact_sets():
    """Shares of n-grams from plain sets, without hashing or filters."""
    r = random.Random(1)
    samples = {k: [prose(r, k, r.randint(5, 60)) + " " + prose(r, "aa", 3) for _ in range(60)] for k in POOLS}
    model = language_id.fit(samples)
    flat = lambda t: bytes(int(x) for x in language_id.FLAT[np.frombuffer(t.encode(), np.uint8)])
    grams = lambda b, n: [b[i : i + n] for i in range(len(b) - n + 1) if b"  " not in b[i : i + n]]
    held = {}
    for n in language_id.ORDERS:
        counts = {k: Counter(grams(flat("\n\n".join(v)), n)) for k, v in samples.items()}
        rate = {k: {g: x / sum(c.values()) for g, x in c.items()} for k, c in counts.items()}
        held[n] = {k: {g for g, x in c.items() if x >= 2 and rate[k][g] >= 0.25 * max(rate[j].get(g, 0) for j in counts)} for k, c in counts.items()}
    texts = [prose(r, r.choice(list(POOLS)), r.randint(1, 80)) for _ in range(150)] + ["Ab mn. ab", "zz zz", "a"]
    block = next(toxicity.blocks_of(texts))
    lang, _, _ = language_id.predict(model, block)
    share, _ = language_id.evidence(model, block)
    for i, t in enumerate(texts):
        total = sum(len(grams(flat(t), n)) for n in language_id.ORDERS)
        want = {k: sum(g in held[n][k] for n in language_id.ORDERS for g in grams(flat(t), n)) / max(1, total) for k in POOLS}
        assert share[i] == pytest.approx([want[k] for k in model.langs], abs=0.02)
        if abs(want["aa"] - want["bb"]) > 0.04:
            assert lang[i] == max(want, key=want.get)


def test_quality_scores_against_a_plain_loop():
    r = random.Random(2)
    texts = [prose(r, "aa", n) for n in (1, 63, 64, 65, 200, 700)] + ["", "| A B | 12"]
    net = quality.train([*texts, *(t.upper() for t in texts)], np.array([1] * 8 + [0] * 8))
    got = net.documents(next(toxicity.blocks_of(texts)))
    p = net.p
    for t, g in zip(texts, got, strict=True):
        words = t.split()
        bags = [" ".join(words[i : i + quality.PASSAGE]) for i in range(0, max(1, len(words)), quality.PASSAGE)]
        # a passage's last blank belongs to it in a text, so it is put back where words follow
        bags = [b + " " if i < len(bags) - 1 else b for i, b in enumerate(bags)]
        h, e = [], []
        for b in bags:
            x = quality.passages(next(toxicity.blocks_of([b])))[0][0]
            state = np.maximum(x @ p["E"] + p["e"], 0)
            h.append(state)
            e.append((np.tanh(state @ p["V"]) / (1 + np.exp(-(state @ p["U"])))) @ p["a"])
        a = np.exp(np.array(e) - max(e))
        z = sum(w * s for w, s in zip(a / a.sum(), h, strict=True))
        assert g == pytest.approx(float(z @ p["w"] + p["b"][0]), abs=2e-3)


def test_toxicity_scores_against_a_plain_loop():
    r = random.Random(3)
    texts = [prose(r, "aa", n) for n in (1, 11, 12, 23, 24, 25, 36, 37, 120)] + ["", "12 34"]
    net = toxicity.train([*texts, *(t + " zuxor" for t in texts)] * 2, np.array(([0] * 11 + [1] * 11) * 2))
    got = net.documents(next(toxicity.blocks_of(texts)))
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    n = toxicity.HIDDEN
    sig = lambda x: 1 / (1 + np.exp(-x))

    def read(vectors: list, d: str) -> list:
        h, out = np.zeros(n), []
        for x in vectors if d == "f" else vectors[::-1]:
            g = x @ p[f"W{d}"] + p[f"c{d}"]
            z, q = np.split(sig(g[: 2 * n] + h @ p[f"U{d}"][:, : 2 * n]), 2)
            h = h + z * (np.tanh(g[2 * n :] + (q * h) @ p[f"U{d}"][:, 2 * n :]) - h)
            out.append(h)
        return out if d == "f" else out[::-1]

    for t, g in zip(texts, got, strict=True):
        w = toxicity.words_of(next(toxicity.blocks_of([t])))
        vectors = net.inputs(w)[:-1][w.kind].astype(np.float64) if len(w.kind) else []
        spans = [vectors[i : i + toxicity.SPAN] for i in range(0, max(1, len(vectors) - toxicity.SPAN + toxicity.STEP), toxicity.STEP)] if len(vectors) else []
        assert sum(len(s) > 0 for s in spans) == len(spans)
        logits = []
        for s in spans:
            h = [np.concatenate(x) for x in zip(read(list(s), "f"), read(list(s), "b"), strict=True)]
            e = np.exp(np.array([np.tanh(x @ p["A"]) @ p["a"] for x in h]))
            logits.append(sum(a * x for a, x in zip(e / e.sum(), h, strict=True)) @ p["w"] + p["b"][0])
        assert g == pytest.approx(max(logits) if logits else p["b"][0], abs=1e-3)


class Plain(HTMLParser):
    """All text outside raw elements, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.raw = [], 0

    def handle_starttag(self, tag, attrs):
        self.raw += tag in html_extraction.RAW and tag not in html_extraction.VOID
        self.out.append(" " if tag in html_extraction.BLOCKS or tag == "br" else "")

    def handle_endtag(self, tag):
        self.raw -= tag in html_extraction.RAW
        self.out.append(" " if tag in html_extraction.BLOCKS else "")

    def handle_data(self, data):
        if not self.raw:
            self.out.append(data)


def test_pages_with_all_kept_against_the_standard_parser():
    for i in range(60):
        source = html_pages.annotated(7_000_000 + i)
        plain = Plain()
        plain.feed(source)
        page = html_extraction.parse(source)
        assert html_extraction.assemble(page, [True] * len(page.tag)).split() == "".join(plain.out).split()


def test_excerpts_cover_long_texts(spark):
    rows = [(i, "".join(f"{k:08d}" for k in range(n))) for i, n in enumerate((0, 1, 1250, 1251, 50_000))] + [(9, None)]
    got = {r["i"]: r["e"] for r in spark.createDataFrame(rows, "i int, t string").select("i", excerpt(F.col("t"), 10_000).alias("e")).collect()}
    assert got[9] is None and all(got[i] == t for i, t in rows[:3])
    for i in (3, 4):
        pieces = got[i].split(" ")
        assert len(pieces) == 10 and all(len(p) == 1000 and p in rows[i][1] for p in pieces)
        assert rows[i][1].startswith(pieces[0]) and rows[i][1].endswith(pieces[-1])


needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables aren't here")


@needs_tables
def test_held_out_accuracy_on_the_given_labels(spark):
    labels, docs = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = language_id.op2_language_id(spark, SF).join(docs, "doc_id").where("held_out and lang is not null").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert got >= 0.97
    for run, label, least in ((quality.op5_quality, "quality", 0.93), (toxicity.op9_toxicity, "toxic", 0.9)):
        assert run(spark, SF).join(labels, "doc_id").where("held_out").agg(F.avg((F.col(label) == F.col("predicted")).cast("int"))).first()[0] >= least


@needs_tables
def test_the_language_model_beats_its_base_on_held_out_texts(spark):
    row = katz.op10_katz(spark, SF).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert row[0] > row[1]


@needs_tables
def test_pages_of_the_table_give_articles(spark):
    rows = html_extraction.op1_html_extraction(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/pages.parquet").count()
    assert np.mean([r["n_chars"] > 200 for r in rows]) > 0.9 and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert not any("<" in r["text"] and "</" in r["text"] for r in rows)
