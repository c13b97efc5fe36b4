"""The pipeline's stages against brute force: nulls, repeated rows and clashing columns."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline

WORDS = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu"]


def prose(r: random.Random, n: int) -> str:
    return " ".join(r.choice(WORDS) for _ in range(n))


def test_one_row_of_each_group_stays(spark):
    r = random.Random(2)
    a, b, c, d, e, f = (prose(r, 60) for _ in range(6))
    near = c + " end"
    rows = [(5, a), (5, a), (5, a), (None, b), (None, b), (9, c), (8, near), (8, d), (4, e), (None, e), (None, f), (8, d), (1, ""), (1, ""), (2, None)]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, row int").repartition(3)
    got = corpus_pipeline.distinct(spark, docs, "")
    assert got.columns == docs.columns
    assert Counter((x["doc_id"], x["text"]) for x in got.collect()) == Counter([(5, a), (None, b), (8, near), (8, d), (4, e), (None, f), (1, ""), (1, ""), (2, None)])


def test_short_items_and_items_without_id_are_found_inside_documents(spark, tmp_path):
    r = random.Random(3)
    items = [(1, "Iota KAPPA"), (None, "theta  theta mu zeta"), (3, "omega"), (4, ""), (5, None), (None, prose(r, 20)), (7, prose(r, 30)), (None, None)]
    docs = [(i, prose(r, r.randint(0, 25))) for i in range(150)]
    docs += [(200 + k, f"{prose(r, 9)} {t or ''} {prose(r, 9)}") for k, (_, t) in enumerate(items)] + [(None, "omega"), (300, None), (301, "omegas iota"), (302, "kappa iota"), (303, "iota"), (303, "kappa")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int").repartition(2)

    def leaks(text):
        w = (text or "").lower().split()
        for _, t in items:
            x = (t or "").lower().split()
            k = min(len(x), 5)
            own = {tuple(x[i : i + k]) for i in range(len(x) - k + 1)} if x else set()
            if own and len(own & {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}) >= 0.8 * len(own) - 1e-9:
                return True
        return False

    got = corpus_pipeline.uncontaminated(spark, frame, str(tmp_path))
    assert got.columns == frame.columns
    want = Counter((i, t) for i, t in docs if not leaks(t))
    assert Counter((x["doc_id"], x["text"]) for x in got.collect()) == want and 20 < sum(want.values()) < len(docs) - 6


def test_texts_of_an_unlearned_language_are_dropped(spark):
    r = random.Random(4)
    mother = {"aa": WORDS, "bb": ["un", "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho"]}
    rows = [(i, " ".join(r.choice(mother[k]) for _ in range(r.randint(8, 40))), k) for i, k in enumerate(r.choices(list(mother), k=120))]
    # the other language shares the beginnings of some words with a learned one
    other = ["alphorn", "betuwe", "gammel", "deltaag", "epistel", "zetmeel", "thermiek", "kapper", "lammeren", "museum"]
    rows += [(1000 + i, " ".join(r.choice(other) for _ in range(r.randint(8, 40))), None) for i in range(40)]
    rows += [(None, rows[0][1], None), (3, rows[0][1], "bb"), (2000, None, "aa"), (2001, "", None), (2002, "12 34", "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = corpus_pipeline.language(spark, docs, "")
    assert got.columns == docs.columns
    assert Counter(tuple(x) for x in got.collect()) == Counter([*rows[:120], *rows[160:162]])


def corpus() -> tuple[list, list, list, list]:
    """(documents, labels, benchmark items, documents that must be left) with each stage's reasons to drop a row, nulls,
    repeated rows and columns named like the stages' results."""
    r = random.Random(6)
    pool = ["".join(r.choice("bcdfghklmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 3))) for _ in range(150)]
    text = lambda n=40: " ".join(r.choice(pool) for _ in range(n))
    items = [(1, text(25)), (None, text(18)), (3, "qwo vex"), (4, None)]
    fine = [(i, text(r.randint(30, 60)), "aa") for i in range(400)]
    toxic, labels = [], [(i, 0) for i in range(400)]
    for i in range(400, 560):
        w = text().split()
        for _ in range(3):
            w[r.randrange(len(w))] = r.choice(["zuxor", "vikka"])
        toxic.append((i, " ".join(w), "aa"))
        labels.append((i, 1))
    copies = [(i + 600, fine[i][1], "aa") for i in range(20)] + [(600 + 20 + i, fine[i + 20][1] + " end", "aa") for i in range(20)] + [(None, fine[50][1], None), fine[60], fine[60]]
    leaks = [(700 + k, f"{text(15)} {t} {text(15)}", "aa") for k, (_, t) in enumerate(items[:3])]
    foreign = [(720 + i, " ".join("xyzqjw"[r.randrange(6)] * 3 + "wyjq"[r.randrange(4)] for _ in range(20)), None) for i in range(10)] + [(740, None, "aa"), (741, "", None), (742, "12 34", None)]
    lone = text()
    docs = [*fine, *toxic, *copies, *leaks, *foreign, (None, lone, None), (None, lone, None)]
    r.shuffle(docs)
    return docs, labels, items, [*fine, (None, lone, None)]


def test_run_and_its_stages(spark, tmp_path):
    docs, labels, items, left = corpus()
    frame = spark.createDataFrame([(*x, f"s{i}", i, i) for i, x in enumerate(docs)], "doc_id long, text string, lang string, score string, evidence long, row long").repartition(3)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in [*labels, (None, 1), (3, 0)]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    whole = {x["row"]: tuple(x) for x in frame.collect()}

    def check(got, want):
        assert got.columns == frame.columns
        rows = [tuple(x) for x in got.collect()]
        assert all(whole[x[5]] == x for x in rows) and len({x[5] for x in rows}) == len(rows)
        assert Counter(x[:2] for x in rows) == Counter(x[:2] for x in want)

    known = [x for x in docs if x[1] and set(x[1]) & set("aeiou")]
    check(corpus_pipeline.language(spark, frame, str(tmp_path)), known)
    fit = frame.where(F.col("text").rlike("[aeiou]"))
    check(corpus_pipeline.clean(spark, fit, str(tmp_path)), [x for x in known if "zuxor" not in x[1] and "vikka" not in x[1]])
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(x["doc_id"] for x in got.collect()) == Counter(i for i, *_ in left)


def test_stages_on_empty_tables_and_without_labels(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, score int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", spark.createDataFrame([], "item_id long, text string"))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns and got.count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    one = spark.createDataFrame([(1, "some text", "aa", 1), (None, "some text", None, 2)], docs.schema)
    assert corpus_pipeline.clean(spark, one, str(tmp_path)).count() == 2
