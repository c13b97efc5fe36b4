"""Pruning by stored part boxes, folders of CSV files, sampled cuts, and what stored files refuse."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions.schema import ROW_ID, Field, Kind, Schema
from tessera.operators import layout
from tessera.operators.index import Index, InvalidIndex
from tessera.operators.layout import BuildConfig
from tessera.operators.predicates import Predicate
from tessera.sources import csv
from tessera.sources.archive import Archive, read_batch, write_batch
from tessera.sources.store import ArchiveError, Store

SCHEMA = Schema([Field("x", Kind.INTEGER), Field("y", Kind.FLOAT, True), Field("c", Kind.CATEGORY, True)])


@pytest.fixture(scope="module")
def rows():
    r = random.Random(1)
    return [(i, r.randint(0, 999), None if r.random() < 0.1 else r.random() * 100, r.choice(["a", "b", None])) for i in range(2000)]


@pytest.fixture(scope="module")
def archive(spark, rows, tmp_path_factory):
    df = spark.createDataFrame(rows, SCHEMA.spark())
    return Archive.create(spark, f"file://{tmp_path_factory.mktemp('stored')}/t", df, SCHEMA, ["x"], BuildConfig(max_leaf=50, max_depth=32))


def files_read(df) -> int:
    return len({r[0] for r in df.select(F.input_file_name()).distinct().collect()})


def asked(r: random.Random) -> list:
    low = r.randint(0, 999)
    out = [Predicate.range("x", low, low + r.choice([0, 20, 400, 2000]))]
    if r.random() < 0.4:
        out.append(Predicate.range("y", 0.0, r.random() * 120))
    if r.random() < 0.3:
        out.append(Predicate.equals("c", r.choice("ab")))
    return out


def brute(rows: list, predicates: list) -> list:
    at = {"x": 1, "y": 2, "c": 3}
    return sorted(row[0] for row in rows if all(row[at[p.field]] is not None and p.low <= row[at[p.field]] <= p.high for p in predicates))


def test_planned_contracts_match_brute_force(archive, rows):
    t = archive.table()
    r = random.Random(2)
    for _ in range(25):
        q = asked(r)
        want = brute(rows, q)
        assert sorted(x[0] for x in t.row_ids(q, planned=True).collect()) == want
        assert t.count(q, planned=True).first()[0] == len(want) and t.exists(q, planned=True).first()[0] == bool(want)


def test_a_narrow_query_scans_few_files_once(archive, rows):
    t = archive.table()
    q = [Predicate.range("x", 100, 140)]
    planned = t.rows(q, planned=True)
    plan = planned._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and "PartitionFilters: [" in plan and "part" in plan
    assert 0 < files_read(t._pruned(t.plan(q))) < files_read(t.base) / 4
    everything = [Predicate.range("x", -5, 5000)]
    covered, left = t._split(t.plan(everything), True)
    assert covered == len(rows) and left.base.count() == 0
    # a null is never covered
    some = t._split(t.plan([Predicate.range("y", -1.0, 101.0)]), True)
    assert some[0] + some[1].count([Predicate.range("y", -1.0, 101.0)]).first()[0] == sum(x[2] is not None for x in rows)


def test_planned_with_pending_rows_and_tombstones(spark, archive, rows):
    more = [(5000 + i, i, 1.0, "b") for i in range(0, 900, 7)]
    gone = [i for i in range(0, 6000, 3)]
    t = archive.table().with_delta(spark.createDataFrame(more, SCHEMA.spark()))
    both = t.with_tombstones(spark.createDataFrame([(i,) for i in gone], "id long"))
    r = random.Random(4)
    for _ in range(6):
        q = asked(r)
        want = brute(rows + more, q)
        assert t.count(q, planned=True).first()[0] == len(want) and t.exists(q, planned=True).first()[0] == bool(want)
        left = [i for i in want if i % 3]
        assert both.count(q, planned=True).first()[0] == len(left) and sorted(x[0] for x in both.row_ids(q, planned=True).collect()) == left


def test_sampled_cuts_keep_rows_and_bound_parts(spark):
    r = random.Random(5)
    points = [(i, float(r.randint(0, 50)), 7.0 if i % 3 else r.random()) for i in range(3000)] + [(10_000 + i, 1.0, 1.0) for i in range(2000)]
    df = spark.createDataFrame(points, f"{ROW_ID} long, x double, y double")
    config = BuildConfig(max_leaf=64, max_depth=32, exact_rows=300)
    coarse = layout.coarse_paths(df, ["x", "y"], config)
    sizes = [x["count"] for x in coarse.groupBy("path").count().collect()]
    assert sum(sizes) == len(points) and max(sizes) <= 300  # rows equal in all dimensions are parted too
    plan = coarse._jdf.queryExecution().analyzed().toString()
    assert plan.count("CASE WHEN") < 40
    got = layout.cluster(df, ["x", "y"], config)
    assert sorted(x[0] for x in got.select(ROW_ID).collect()) == sorted(i for i, *_ in points)
    assert Index.build(df, ["x", "y"], config).validation().where("violations > 0").count() == 0


def put(path, text: str) -> str:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return f"file://{path.parent}"


def test_csv_folders_are_read_by_name(spark, tmp_path):
    put(tmp_path / "f/a.csv", "a,b\n1,2\n")
    folder = put(tmp_path / "f/b.csv", " b , a \n20,10\n")
    put(tmp_path / "f/empty.csv", "")
    df, schema = csv.read_csv(spark, folder)
    assert schema.names == ["a", "b"] and sorted((r["a"], r["b"]) for r in df.collect()) == [(1, 2), (10, 20)]
    assert sorted(r[ROW_ID] for r in df.collect()) == [1, 2]
    put(tmp_path / "f/c.csv", 'b,"more, of it",a\n5,"x\ny",4\n')
    with pytest.raises(csv.CsvError, match="other files"):
        csv.read_csv(spark, folder)
    wanted = Schema([Field("a", Kind.INTEGER), Field("b", Kind.INTEGER)])
    assert sorted((r["a"], r["b"]) for r in csv.read_csv(spark, folder, wanted)[0].collect()) == [(1, 2), (4, 5), (10, 20)]
    put(tmp_path / "f/d.csv", "b\n1\n")
    with pytest.raises(csv.CsvError, match="no columns"):
        csv.read_csv(spark, folder, wanted)
    for name, text in (("twice", "a,a\n1,2\n"), ("ragged", "a,b\n1,2,3\n"), ("none", "")):
        with pytest.raises(csv.CsvError):
            csv.read_csv(spark, put(tmp_path / name / "x.csv", text))


def test_stored_files_refuse_what_was_changed(spark, tmp_path, rows):
    df = spark.createDataFrame(rows[:200], SCHEMA.spark())
    path = f"file://{tmp_path}/batch"
    assert write_batch(df, path, SCHEMA) == 200
    again, schema = read_batch(spark, path)
    assert schema == SCHEMA and sorted(map(tuple, again.collect()), key=lambda x: x[0]) == rows[:200]
    df.limit(1).write.mode("append").parquet(f"{path}/rows")
    with pytest.raises(ArchiveError):
        read_batch(spark, path)
    points = spark.createDataFrame([(i, float(i), float(-i)) for i in range(50)], f"{ROW_ID} long, x double, y double")
    index = Index.build(points, ["x", "y"], BuildConfig(8))
    index.save(f"file://{tmp_path}/index")
    index.release()
    assert Index.load(spark, f"file://{tmp_path}/index").rows.count() == 50
    store = Store(spark, f"file://{tmp_path}/index")
    store.replace("index.json", store.read("index.json").replace('\\"dims\\": [\\"x\\"', '\\"dims\\": [\\"z\\"'))
    with pytest.raises(InvalidIndex):
        Index.load(spark, f"file://{tmp_path}/index")


def test_pending_batches_add_files_and_vacuum_keeps_what_is_used(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, SCHEMA.spark())
    a = Archive.create(spark, f"file://{tmp_path}/t", df.where(F.col(ROW_ID) < 1800), SCHEMA, ["x"], BuildConfig(max_leaf=100))
    a = a.put_delta(df.where(F.col(ROW_ID).between(1800, 1899))).put_delta(df.where(F.col(ROW_ID) >= 1900))
    assert a.manifest.delta_versions == (2, 3) and a.manifest.delta_rows == 200
    with pytest.raises(ArchiveError):
        a.put_delta(df.where(F.col(ROW_ID).isin(1850)))
    a = a.put_tombstones(spark.createDataFrame([(5,)], "id long")).put_tombstones(spark.createDataFrame([(6,)], "id long"))
    assert a.vacuum() == ["v=4"]
    assert sorted(r[0] for r in Archive.load(spark, a.root, check=True).table().scan().select(ROW_ID).collect()) == [i for i in range(2000) if i not in (5, 6)]
