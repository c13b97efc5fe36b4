"""CSV-driven lifecycle: the entity table with appended rows, tombstones and policies."""

from __future__ import annotations

import pytest

from tessera.functions.boxes import widest_variance
from tessera.functions.encoders import EncodingError
from tessera.functions.schema import ROW_ID, Field, Kind, Schema
from tessera.operators import csv_lifecycle, maintenance, reports
from tessera.operators.layout import BuildConfig
from tessera.operators.maintenance import Policy, PolicyError, RebuildPlan
from tessera.operators.predicates import Predicate
from tessera.sources.archive import Archive, ArchiveError
from tessera.sources.csv import CsvError, CsvOptions

ENTITY = Schema([Field("entity_id", Kind.INTEGER), Field("score", Kind.FLOAT), Field("class", Kind.CATEGORY), Field("observed_at", Kind.TIMESTAMP_MS)])
OPTIONS = CsvOptions(row_id="entity_id")
HEAD = "entity_id,score,class,observed_at\n"
BASE = HEAD + "100,12.5,alpha,1000\n101,12.5,beta,1100\n102,25.0,alpha,1200\n103,18.0,alpha,1300\n"
FIRST = HEAD + "104,16.0,alpha,1400\n105,80.0,beta,1500\n"
ASKED = [Predicate.range("score", 10.0, 20.0), Predicate.equals("class", "alpha")]


@pytest.fixture
def put(tmp_path):
    def write(name: str, text: str) -> str:
        (tmp_path / name).write_text(text)
        return f"file://{tmp_path}/{name}"

    return write


def ids(df) -> list[int]:
    return sorted(r[ROW_ID] for r in df.select(ROW_ID).collect())


def test_rows_tombstones_and_policy(spark, tmp_path, put):
    a = csv_lifecycle.create(spark, f"file://{tmp_path}/t", put("base.csv", BASE), ENTITY, OPTIONS, None, BuildConfig(2))
    a = csv_lifecycle.delta(a, put("first.csv", FIRST), OPTIONS)
    a = csv_lifecycle.tombstones(a, put("gone.csv", "entity_id\n100\n"), OPTIONS)
    assert ids(a.table().rows(ASKED)) == [103, 104]
    plan = maintenance.planned_rewrite(a)
    assert (plan.base_rows, plan.appended, plan.removed, plan.resulting_rows) == (4, 2, 1, 5)
    b, d = csv_lifecycle.maintain(a, Policy(10, 1, 9000))
    assert d.action == "rebuild" and ids(b.table().rows(ASKED)) == [103, 104] and b.manifest.rows == 5
    c = csv_lifecycle.append(b, put("second.csv", HEAD + "106,14.0,alpha,1600\n107,8.0,beta,1700\n"), OPTIONS)
    assert ids(c.table().rows(ASKED)) == [103, 104, 106]
    assert ids(c.table().record(106)) == [106] and c.table().record(100).count() == 0
    assert reports.compared_typed(c.table(), ASKED, 1)["agreement"]


def test_failures_leave_the_archive(spark, tmp_path, put):
    a = csv_lifecycle.create(spark, f"file://{tmp_path}/t", put("base.csv", BASE), ENTITY, OPTIONS, None, BuildConfig(2))
    before = a.manifest.to_json()
    with pytest.raises(CsvError):
        csv_lifecycle.append(a, put("bad.csv", HEAD + "104,x,alpha,1\n"), OPTIONS)
    with pytest.raises(ArchiveError):
        csv_lifecycle.delta(a, put("same.csv", HEAD + "100,1.0,alpha,1\n"), OPTIONS)
    with pytest.raises(CsvError):
        csv_lifecycle.tombstones(a, put("none.csv", "other\n1\n"), OPTIONS)
    with pytest.raises(PolicyError):
        csv_lifecycle.maintain(a, Policy(0, 1, 1))
    with pytest.raises((CsvError, EncodingError)):
        csv_lifecycle.create(spark, f"file://{tmp_path}/u", put("empty.csv", HEAD + "1,,alpha,1\n"), ENTITY, OPTIONS)
    assert Archive.load(spark, a.root, check=True).manifest.to_json() == before
    for bad in ((0, 1, 0), (1, 0, 0), (1, -1, 0), (2, 1, 3)):
        with pytest.raises(PolicyError):
            RebuildPlan(*bad)


def test_small_measures(spark):
    df = spark.createDataFrame([(0.0, 5.0, 1.0), (1.0, 9.0, 1.0)], "a float, b float, c float")
    assert widest_variance(df, ["a", "b", "c"]) == 1
    one, other = reports.baseline_footprint("kd_tree", 10, 4, 2), reports.baseline_footprint("r_tree", 10, 2, 2)
    assert reports.footprint_comparison(one, other)["nodes_ratio"] == 0.5
