"""What only shows on tables of more than one range, node or task."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.functions import ordering
from tessera.functions.schema import ROW_ID, Field, Kind, Schema
from tessera.operators import layout, reports
from tessera.operators.layout import BuildConfig
from tessera.operators.predicates import Predicate
from tessera.sources.archive import Archive


@pytest.fixture
def apart(spark):
    """Small partitions stay apart, as those of large tables do."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def spread(spark, n: int):
    """Points that lie in no order, with many equal ones on either axis."""
    return spark.range(0, n, 1, 3).select(F.col("id").alias(ROW_ID), (F.col("id") * 7919 % 10007).cast("double").alias("x"), (F.col("id") * 31 % 170).cast("double").alias("y"), F.repeat(F.lit("z"), (F.col("id") % 90).cast("int")).alias("more"))


def test_ranks_are_those_of_one_sort(spark, apart, monkeypatch):
    monkeypatch.setattr(ordering, "RANGE_ROWS", 5000, raising=False)
    got = ordering.ranked(spread(spark, 60_000), ["x", "y", ROW_ID])
    rows = sorted(got.collect(), key=lambda r: (r["x"], r["y"], r[ROW_ID]))
    assert [r["place"] for r in rows] == list(range(60_000))


def test_ranks_put_nulls_last(spark, monkeypatch):
    monkeypatch.setattr(ordering, "RANGE_ROWS", 2, raising=False)
    rows = [(1, [1.0, None]), (2, None), (3, [1.0]), (4, [1.0, float("nan")]), (None, [1.0]), (5, []), (6, [None])]
    got = ordering.ranked(spark.createDataFrame(rows, "i long, v array<float>"), ["v", "i"]).collect()
    assert [r["i"] for r in sorted(got, key=lambda r: r["place"])] == [5, 3, None, 4, 1, 6, 2]


def test_packed_leaves_are_full(spark, apart, monkeypatch):
    monkeypatch.setattr(ordering, "RANGE_ROWS", 5000, raising=False)
    leaves = reports.packed_layout(spread(spark, 60_000), ["x", "y"]).groupBy("leaf_id").agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b")).orderBy("leaf_id").collect()
    assert {r["n"] for r in leaves} == {16} and len(leaves) == 3750
    assert all(one["b"] <= other["a"] for one, other in zip(leaves, leaves[1:], strict=False))


def test_a_task_splits_no_more_than_its_bytes(spark, monkeypatch):
    monkeypatch.setattr(layout, "TASK_BYTES", 160_000, raising=False)
    points = spread(spark, 20_000)  # 24 bytes and 44.5 of text on average
    coarse = layout.coarse_paths(points, ["x", "y"], BuildConfig(max_leaf=64, max_depth=32))
    sizes = [r["n"] for r in coarse.groupBy("path").agg(F.sum(F.lit(32) + F.length("more")).alias("n")).collect()]
    assert len(sizes) > 4 and max(sizes) < 2 * 160_000
    got = layout.cluster(points, ["x", "y"], BuildConfig(max_leaf=64, max_depth=32))
    assert sorted(r[0] for r in got.select(ROW_ID).collect()) == list(range(20_000))
    # rows that are equal in all dimensions too
    same = points.withColumns({"x": F.lit(1.0), "y": F.lit(2.0)})
    assert max(r["n"] for r in layout.coarse_paths(same, ["x", "y"], BuildConfig(max_leaf=64, max_depth=32)).groupBy("path").agg(F.sum(F.lit(32) + F.length("more")).alias("n")).collect()) < 2 * 160_000


def test_parts_of_many_small_leaves_are_few_and_listed_once(spark, tmp_path):
    schema = Schema([Field("x", Kind.FLOAT), Field("y", Kind.FLOAT), Field("more", Kind.CATEGORY)])
    a = Archive.create(spark, f"file://{tmp_path}/t", spread(spark, 6000).withColumn("more", F.col("y").cast("string")), schema, ["x", "y"], BuildConfig(max_leaf=20))
    assert a.manifest.statistics.leaves > 150 and 32 < len(a.manifest.parts) <= 64
    assert a.data() is a.data()
    for p in a.manifest.parts:  # boxes are those of the rows
        rows = a.data().where(F.col("part") == p.part).collect()
        assert len(rows) == p.rows and all(p.bounds[c] == (min(r[c] for r in rows), max(r[c] for r in rows)) for c in ("x", "y", "more"))
    assert Archive.load(spark, a.root, check=True).table().count([Predicate.range("x", 0.0, 99.0)], planned=True).first()[0] == sum(i * 7919 % 10007 < 100 for i in range(6000))


def test_kd_parts_have_leaves_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(layout, "TASK_BYTES", 48_000, raising=False)
    kd = reports.kd_layout(spread(spark, 20_000).select(ROW_ID, "x", "y"), ["x", "y"], 64, 3000)
    rows = kd.collect()
    assert sorted(r[ROW_ID] for r in rows) == list(range(20_000))
    leaves = {}
    for r in rows:
        leaves.setdefault(r["path"], []).append((r["x"], r["y"]))
    assert max(map(len, leaves.values())) <= 64 and len({p[:4] for p in leaves}) == 10  # 2000 rows a task
    assert sorted((r[ROW_ID], r["path"]) for r in rows) == sorted((r[ROW_ID], r["path"]) for r in kd.collect())
