"""The typed range engine: validation, contracts against a flat scan, index, planner, storage lifecycle, CSV."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import registry
from tessera.functions.boxes import Box, BoxError, bounds
from tessera.functions.encoders import Dictionary, DimensionMapping, EncodingError, RecordEncoder
from tessera.functions.schema import ROW_ID, Field, Kind, RecordError, Schema, SchemaError, check_record, validate
from tessera.operators import layout, maintenance, predicates, reports
from tessera.operators.index import Index, InvalidIndex
from tessera.operators.layout import BuildConfig
from tessera.operators.maintenance import Policy, PolicyError, decide
from tessera.operators.predicates import Predicate, plan
from tessera.operators.table import DeltaError, Table, statistics_of
from tessera.plans.planner import Contract, Statistics, choose
from tessera.sources import csv, generators
from tessera.sources.archive import Archive, ArchiveError, Manifest, Store

ENTITY = Schema([Field("entity_id", Kind.INTEGER), Field("score", Kind.FLOAT), Field("class", Kind.CATEGORY), Field("observed_at", Kind.TIMESTAMP_MS)])
ROWS = [(100, 1, 12.5, "alpha", 1000), (101, 2, 12.5, "beta", 1100), (102, 3, 25.0, "alpha", 1200), (103, 4, 18.0, "alpha", 1300), (104, 5, 18.0, "beta", 1400)]
SCORE = Predicate.range("score", 10.0, 20.0)
ALPHA = Predicate.equals("class", "alpha")


@pytest.fixture
def entity(spark):
    return spark.createDataFrame(ROWS, ENTITY.spark())


def ids(df) -> list[int]:
    return sorted(r[ROW_ID] for r in df.select(ROW_ID).collect())


# --- schema, records, predicates -------------------------------------------------------------------------------------


def test_schema_and_record_validation(spark, entity):
    for bad in ([], [Field("", Kind.TEXT)], [Field("a", Kind.TEXT), Field("a", Kind.INTEGER)]):
        with pytest.raises(SchemaError):
            Schema(bad)
    assert check_record(ENTITY, [1, 1.0, "a", 5])
    for bad in ([1, 1.0, "a"], [1, 1, "a", 5], [None, 1.0, "a", 5], [True, 1.0, "a", 5]):
        with pytest.raises(RecordError):
            check_record(ENTITY, bad)
    assert validate(entity, ENTITY) is entity
    with pytest.raises(RecordError):
        validate(entity.union(entity.limit(1)), ENTITY)
    with pytest.raises(SchemaError):
        validate(entity.drop("score"), ENTITY)
    assert Schema.from_dict(ENTITY.to_dict()) == ENTITY


@pytest.mark.parametrize(
    "p,error",
    [
        (Predicate.equals("nope", 1), predicates.UnknownField), (Predicate.equals(9, 1), predicates.UnknownField), (Predicate.equals("score", None), predicates.NullLiteral), (Predicate.equals("score", 1), predicates.TypeMismatch), (Predicate.equals("entity_id", 1.0), predicates.TypeMismatch),
        (Predicate.equals("score", math.nan), predicates.NotFinite), (Predicate.range("score", 0.0, math.inf), predicates.NotFinite), (Predicate.range("class", "a", "b"), predicates.RangeUnsupported), (Predicate.range("score", 2.0, 1.0), predicates.InvertedRange), (Predicate.equals("class", "gamma"), predicates.UnknownCategory),
    ],
)
def test_predicate_errors(p, error):
    with pytest.raises(error):
        plan(ENTITY, [p], {"class": Dictionary(["alpha", "beta"])})


def test_conjunctions(spark, entity):
    with pytest.raises(predicates.EmptyConjunction):
        plan(ENTITY, [])
    with pytest.raises(predicates.NotIndexable):
        plan(Schema([Field("t", Kind.TEXT)]), [Predicate.equals("t", "x")])
    p = plan(ENTITY, [SCORE, Predicate.range("score", 15.0, 30.0)])
    assert p.box == {"score": (15.0, 20.0)} and not p.unsatisfiable
    assert plan(ENTITY, [SCORE, Predicate.range("score", 21.0, 30.0)]).unsatisfiable
    assert plan(ENTITY, [ALPHA, Predicate.equals("class", "beta")]).unsatisfiable
    t = Table(ENTITY, entity)
    assert ids(t.rows([SCORE, ALPHA])) == [100, 103]
    assert ids(t.rows([Predicate.equals(1, 12.5)])) == [100, 101]
    empty = t.rows([SCORE, Predicate.range("score", 21.0, 30.0)])
    assert "LocalTableScan <empty>" in empty._jdf.queryExecution().executedPlan().toString() and empty.count() == 0


def test_filters_reach_the_scan(spark, tmp_path, entity):
    entity.write.parquet(str(tmp_path / "e"))
    got = Table(ENTITY, spark.read.parquet(str(tmp_path / "e"))).row_ids([SCORE, ALPHA])
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    text = got._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(score,10.0)" in text and "EqualTo(class,alpha)" in text
    assert "ReadSchema: struct<row_id:bigint,score:double,class:string>" in text


def test_nulls_nans_and_extremes_never_match(spark):
    schema = Schema([Field("v", Kind.FLOAT, True), Field("i", Kind.INTEGER, True)])
    rows = [(1, None, None), (2, float("nan"), 0), (3, -0.0, 2**63 - 1), (4, 0.0, -(2**63)), (5, float("inf"), 1)]
    t = Table(schema, spark.createDataFrame(rows, schema.spark()))
    assert ids(t.rows([Predicate.equals("v", 0.0)])) == [3, 4]
    assert ids(t.rows([Predicate.range("v", -1e308, 1e308)])) == [3, 4]
    assert ids(t.rows([Predicate.equals("i", 2**63 - 1)])) == [3]


# --- tables: contracts, deltas, tombstones ---------------------------------------------------------------------------


def test_contracts_with_delta_and_tombstones(spark, entity):
    delta = spark.createDataFrame([(105, 6, 16.0, "alpha", 1500), (106, 7, 80.0, "gamma", 1600)], ENTITY.spark())
    t = Table(ENTITY, entity, dictionaries={"class": Dictionary(["alpha", "beta"])}).with_delta(delta).with_tombstones(spark.createDataFrame([(100,), (100,), (999,)], "id long"))
    assert ids(t.row_ids([SCORE, ALPHA])) == [103, 105]
    assert t.count([SCORE, ALPHA]).first()[0] == 2 and t.exists([SCORE, ALPHA]).first()[0] is True
    assert t.count([Predicate.range("score", 500.0, 600.0)]).first()[0] == 0 and t.exists([Predicate.range("score", 500.0, 600.0)]).first()[0] is False
    seen = []
    t.visit_row_ids([SCORE], seen.append)
    assert sorted(seen) == [101, 103, 104, 105]
    rows = []
    t.visit_rows([ALPHA, SCORE], rows.append)
    assert sorted(r["entity_id"] for r in rows) == [4, 6]
    assert ids(t.rows([Predicate.equals("class", "gamma")])) == [106]  # a label of the delta alone
    assert ids(t.scan()) == [101, 102, 103, 104, 105, 106]
    assert t.value_of(105, "score").first()[0] == 16.0
    assert t.stats([SCORE, ALPHA]).first().asDict() == {"total_records": 7, "candidate_records": 7, "matched_records": 2, "candidate_ratio": 1.0}


def test_delta_errors(spark, entity):
    t = Table(ENTITY, entity)
    with pytest.raises(DeltaError):
        t.with_delta(entity.limit(0))
    with pytest.raises(RecordError):
        t.with_delta(entity.limit(1))
    with pytest.raises(SchemaError):
        t.with_delta(entity.drop("score"))


def test_random_predicates_equal_a_flat_scan(spark):
    r = random.Random(1)
    schema = Schema([Field("a", Kind.INTEGER), Field("b", Kind.FLOAT), Field("c", Kind.CATEGORY)])
    rows = [(i, r.randint(-5, 5), round(r.uniform(-1, 1), 1), r.choice("xyz")) for i in range(300)]
    df = spark.createDataFrame(rows, schema.spark()).persist()
    dicts = {"c": Dictionary("xyz")}
    t = Table(schema, df, dictionaries=dicts, statistics=statistics_of(df, schema, dicts, 9, 5))
    for _ in range(12):
        lo, hi = sorted((r.randint(-6, 6), r.randint(-6, 6)))
        u, v = sorted((round(r.uniform(-1, 1), 1), round(r.uniform(-1, 1), 1)))
        label = r.choice("xyz")
        ps = r.sample([Predicate.range("a", lo, hi), Predicate.range("b", u, v), Predicate.equals("c", label), Predicate.equals("a", lo)], r.randint(1, 3))
        want = [i for i, a, b, c in rows if all((p.low <= {"a": a, "b": b, "c": c}[p.field] <= p.high) for p in ps)]
        assert ids(t.rows(ps)) == want == ids(t.rows(ps, planned=True))


# --- encoders, boxes -------------------------------------------------------------------------------------------------


def test_encoders(spark, entity):
    e = RecordEncoder.from_batch(entity, ENTITY)
    assert e.dictionaries["class"].labels == ("alpha", "beta")
    assert [tuple(r) for r in e.encode(entity).orderBy(ROW_ID).limit(2).collect()] == [(100, 1.0, 12.5, 0.0, 1000.0), (101, 2.0, 12.5, 1.0, 1100.0)]
    with pytest.raises(EncodingError):
        RecordEncoder(ENTITY, {"class": Dictionary(["alpha"])}).encode(entity)
    with pytest.raises(EncodingError):
        RecordEncoder.from_batch(entity, Schema([Field("class", Kind.TEXT)]))
    with pytest.raises(RecordError):
        RecordEncoder.from_batch(entity.withColumn("score", F.lit(None).cast("double")), ENTITY)
    for bad in ([], ["a", "a"], [""]):
        with pytest.raises(EncodingError):
            Dictionary(bad)
    m = DimensionMapping(ENTITY, [("score", (0, 2)), ("class", (1,))])
    assert m.dimensions == 3 and m.field_of(2) == "score" and m.dimensions_of("score") == [0, 2]
    with pytest.raises(SchemaError):
        DimensionMapping(ENTITY, [("score", (0,)), ("class", (0,))])


def test_boxes():
    a, b = Box((0, 0), (10, 10)), Box((2, 2), (3, 3))
    assert a.classify(b) == "covered" and b.classify(a) == "partial" and a.classify(Box((11, 0), (12, 1))) == "disjoint" and a.classify(Box((0,), (1,))) == "disjoint"
    assert a.contains((0, 10)) and not a.contains((0, 10.1)) and not a.contains((1,))
    for bad in (((), ()), ((1,), (0,)), ((0,), (math.inf,)), ((0, 1), (2,))):
        with pytest.raises(BoxError):
            Box(*bad)


# --- the index -------------------------------------------------------------------------------------------------------


def test_cut_rules():
    assert layout.cut_of(np.array([0, 1, 2, 100], np.float32)) == 3  # a dominant gap
    assert layout.cut_of(np.array([0, 1, 2, 3], np.float32)) == 2  # none
    assert layout.cut_of(np.array([0, 0, 5, 5, 5], np.float32)) == 2  # the only positive gap
    assert layout.cut_of(np.array([7, 7, 7, 7], np.float32)) == 2
    assert layout.cut_of(np.array([0, 10, 11, 12, 22], np.float32)) == 1  # equal gaps, equally far: the first


@pytest.mark.parametrize(
    "points,low,high",
    [
        ([(-5,), (-1,), (0,), (1,), (2,), (8,)], (0,), (2,)), ([(-2, -1), (0, 0), (1, 3), (4, 8), (9, 9)], (-10, -10), (10, 10)), ([(0, 0), (1, 1), (2, 2), (3, 3)], (10, 10), (12, 12)),
        ([(k, 2 * k, 3 * k) for k in range(6)], (1, 2, 3), (3, 6, 9)), ([(k, 10 - k) for k in range(5)], (1, 7), (3, 9)),
    ],
)
def test_index_contracts_equal_a_flat_scan(spark, points, low, high):
    dims = [f"d{i}" for i in range(len(low))]
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], f"{ROW_ID} long, " + ", ".join(f"{d} float" for d in dims))
    region = Box(low, high)
    want = [i for i, p in enumerate(points) if region.contains(p)]
    index = Index.checked(df, dims, BuildConfig(2, 8))
    assert ids(index.query(region)) == want
    assert ids(index.dereference(index.references(region))) == want
    assert index.count(region).first()[0] == len(want) and index.exists(region) == bool(want)
    seen = []
    index.visit(region, lambda r: seen.append(r[ROW_ID]))
    assert sorted(seen) == want
    s = index.stats(region).first()
    assert s["matched_records"] == len(want) and s["total_records"] == len(points)
    with pytest.raises(ValueError):
        index.query(Box((0,) * (len(low) + 1), (1,) * (len(low) + 1)))


def test_published_counters(spark):
    small = registry.published(spark, False, 8, "cluster_boundary_range").first()
    assert (small["visited_nodes"], small["retained_leaves"], small["reconstructed_records"], small["matched_records"]) == (13, 2, 10, 5)
    large = registry.published(spark, True, 16, "large_cross_cluster_boundary").first()
    assert (large["visited_nodes"], large["retained_leaves"], large["covered_leaves"], large["reconstructed_records"], large["matched_records"], large["max_leaf"], large["avg_leaf"]) == (45, 10, 8, 78, 71, 8, 7.81)


def test_depth_limit_gives_an_invalid_index(spark):
    p = generators.clusters(spark, *generators.LARGE).drop("cluster")
    index = Index.build(p, ["x", "y"], BuildConfig(8, 8))
    assert index.leaves.agg(F.max("cardinality")).first()[0] == 63
    s = index.stats(dict(generators.workloads(True))["large_cross_cluster_boundary"]).first()
    assert (s["visited_nodes"], s["retained_leaves"], s["reconstructed_records"], s["matched_records"]) == (27, 3, 94, 71)
    with pytest.raises(InvalidIndex):
        Index.checked(p, ["x", "y"], BuildConfig(8, 8))


def test_coarse_phase_keeps_all_rows_and_rules(spark):
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(0, 1, (900, 2)), r.normal(50, 1, (900, 2)), np.zeros((300, 2))]).astype(np.float32)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], f"{ROW_ID} long, x float, y float")
    index = Index.build(df, ["x", "y"], BuildConfig(64, 32, exact_rows=250))
    assert ids(index.rows) == list(range(2100))
    assert {v["check"]: v["violations"] for v in index.validation().collect()} == dict.fromkeys(index.violations(), 0)
    region = Box((-1, -1), (49.5, 50))
    assert ids(index.query(region)) == [i for i, p in enumerate(x) if region.contains(p)]
    assert index.count(region).first()[0] == index.query(region).count()


def test_each_violation_is_found(spark):
    index = Index.build(generators.clusters(spark, *generators.SMALL).drop("cluster"), ["x", "y"], BuildConfig(8, 8))
    n = index.nodes

    def bad(nodes=None, rows=None, leaf=8):
        i = Index(index.rows if rows is None else rows, n if nodes is None else nodes, index.dims, BuildConfig(leaf))
        return {v["check"] for v in i.validation().collect() if v["violations"]}

    assert bad() == set()
    assert "node_ids" in bad(n.union(n.where("node_id = 3")))
    assert "dimensions" in bad(n.withColumn("min_x", F.when(F.col("node_id") == 2, float("nan")).otherwise(F.col("min_x"))))
    assert bad(leaf=4) == {"leaf_cardinality"}
    assert "leaf_shapes" in bad(rows=index.rows.where(f"{ROW_ID} <> 5"))
    assert "leaf_rows_in_bounds" in bad(rows=index.rows.withColumn("x", F.col("x") + 1))
    assert "ownership" in bad(n.withColumn("cardinality", F.when(F.col("path") == "", 7).otherwise(F.col("cardinality"))))
    assert "topology" in bad(n.withColumn("parent_id", F.when(F.col("node_id") == 4, 999).otherwise(F.col("parent_id"))))
    assert "parent_bounds" in bad(n.withColumn("max_x", F.when(F.col("path") == "", 5.0).otherwise(F.col("max_x"))))


# --- the planner -----------------------------------------------------------------------------------------------------


def stats_of(n=10_000, leaves=200, nodes=399, dims=2) -> Statistics:
    return Statistics(n, nodes, leaves, {f"d{i}": (0.0, 100.0) for i in range(dims)}, {}, {})


def test_planner_rules():
    schema = Schema([Field(f"d{i}", Kind.FLOAT) for i in range(8)])
    p = lambda lo, hi, d="d0": plan(schema, [Predicate.range(d, lo, hi)])
    c = choose(p(0.0, 5.0), stats_of(), Contract.ROW_IDS)
    assert (c.strategy, c.reason, c.bucket) == ("traversal", "selective_geometry", "selective")
    assert choose(p(0.0, 60.0), stats_of(), Contract.COUNT).reason == "broad_geometry"
    assert choose(p(0.0, 60.0), stats_of(), Contract.ROWS).reason == "broad_materialized_query"
    assert choose(p(0.0, 30.0), stats_of(), Contract.ROW_IDS).reason == "cost_model_override"
    assert choose(p(200.0, 300.0), stats_of(), Contract.ROW_IDS).reason == "no_candidates_estimated"
    assert choose(plan(schema, [Predicate.range("d0", 0.0, 1.0), Predicate.range("d0", 2.0, 3.0)]), stats_of(), Contract.ROW_IDS).reason == "unsatisfiable_plan"
    assert choose(p(0.0, 5.0), stats_of(0), Contract.ROW_IDS).reason == "empty_index"
    d = choose(p(0.0, 5.0), stats_of(), Contract.ROW_IDS, 10)
    assert (d.strategy, d.append_delta_scan) == ("hybrid", True)
    assert choose(p(0.0, 30.0), stats_of(dims=8), Contract.ROW_IDS).reason == "high_dimensional_low_constraint_query"
    assert choose(p(5.0, 5.0), stats_of(2, 2, 3), Contract.ROW_IDS).candidate_records == 1


def test_planner_never_drops_a_tiny_product():
    schema = Schema([Field(f"d{i}", Kind.FLOAT) for i in range(8)])
    ps = [Predicate.range(f"d{i}", 1.0, 1.0001) for i in range(8)]
    assert choose(plan(schema, ps), stats_of(dims=8), Contract.ROW_IDS).strategy != "no_op"


def test_label_frequencies(spark, entity):
    dicts = {"class": Dictionary(["alpha", "beta"])}
    t = Table(ENTITY, entity, dictionaries=dicts, statistics=statistics_of(entity, ENTITY, dicts, 3, 2))
    c = t.explain([ALPHA], Contract.COUNT)
    assert (c.candidate_ratio, c.uses_label_frequency, c.reason) == (0.6, True, "broad_categorical_equality")


# --- storage lifecycle -----------------------------------------------------------------------------------------------


def archive(spark, tmp_path, entity) -> Archive:
    return Archive.create(spark, f"file://{tmp_path}/t", entity, ENTITY, config=BuildConfig(2, exact_rows=3))


def test_archive_lifecycle(spark, tmp_path, entity):
    a = archive(spark, tmp_path, entity)
    more = spark.createDataFrame([(105, 6, 16.0, "alpha", 1500), (106, 7, 80.0, "beta", 1600)], ENTITY.spark())
    a = a.put_delta(more).put_tombstones(spark.createDataFrame([(100,)], "id long"))
    before = ids(Archive.load(spark, a.root, check=True).table().rows([SCORE, ALPHA], planned=True))
    assert before == [103, 105]
    assert maintenance.inspect(a, Policy(10, 1, 9000)).action == "rebuild"
    b, d = maintenance.maintain(a, Policy(10, 1, 9000))
    assert (d.action, d.reason) == ("rebuild", "append_and_compaction_reached")
    again = Archive.load(spark, b.root, check=True)
    assert ids(again.table().rows([SCORE, ALPHA])) == before
    assert (again.manifest.rows, again.manifest.delta_rows, again.manifest.tombstones) == (6, 0, 0)
    assert {r["section"] for r in again.footprint().collect()} >= {"manifest", "data", "nodes"} and maintenance.status(again, Policy())["bytes"] > 0
    assert maintenance.maintain(again, Policy())[1].action == "none"


def test_append_keeps_tombstones_and_compact_clears_them(spark, tmp_path, entity):
    a = archive(spark, tmp_path, entity).put_tombstones(spark.createDataFrame([(101,), (105,)], "id long"))
    a = maintenance.append(a, spark.createDataFrame([(105, 6, 16.0, "gamma", 1500)], ENTITY.spark()))
    assert a.manifest.tombstones == 2 and ids(a.table().scan()) == [100, 102, 103, 104]
    assert a.manifest.dictionaries["class"].labels == ("alpha", "beta", "gamma")
    a = maintenance.compact(a)
    assert a.manifest.tombstones == 0 and ids(a.table().scan()) == [100, 102, 103, 104]


def test_archive_errors_leave_the_table_alone(spark, tmp_path, entity):
    a = archive(spark, tmp_path, entity)
    version = a.manifest.version
    with pytest.raises(ArchiveError):
        a.put_delta(entity.limit(1))
    with pytest.raises(ArchiveError):
        a.put_tombstones(spark.createDataFrame([], "id long"))
    with pytest.raises(ArchiveError):
        a.put_tombstones(spark.createDataFrame([(1,), (1,)], "id long"))
    assert Archive.load(spark, a.root, check=True).manifest.version == version
    gone = a.put_tombstones(entity.select(ROW_ID))
    with pytest.raises(ArchiveError):
        maintenance.compact(gone)
    assert ids(Archive.load(spark, a.root).data()) == [100, 101, 102, 103, 104]
    Store(spark, a.root).replace("manifest.json", a.manifest.to_json().replace('"content": ', '"content": 1'))
    with pytest.raises(ArchiveError):
        Archive.load(spark, a.root, check=True)
    with pytest.raises(ArchiveError):
        Manifest.from_json('{"magic": "other"}')
    with pytest.raises(ArchiveError):
        Archive.load(spark, f"file://{tmp_path}/nothing")


def test_policy():
    p = Policy()
    assert [decide(p, 10_000, n, t).action for n, t in ((0, 0), (5, 0), (1024, 0), (5, 1024), (0, 1024), (0, 1023))] == ["none", "append", "rebuild", "rebuild", "compact", "none"]
    assert decide(p, 100, 0, 25).reason == "tombstone_ratio_reached"
    for bad in ((0, 1, 1), (1, 0, 1), (1, 1, 0)):
        with pytest.raises(PolicyError):
            Policy(*bad)
    with pytest.raises(PolicyError):
        decide(p, 0, 1, 1)


def test_streaming_appends_once(spark, tmp_path, entity):
    from tessera.streaming.delta import append_stream

    a = archive(spark, tmp_path, entity)
    more = spark.createDataFrame([(105, 6, 16.0, "alpha", 1500), (100, 6, 16.0, "alpha", 1500)], ENTITY.spark())
    more.write.parquet(str(tmp_path / "in"))
    for k in range(2):  # a second run replays all
        append_stream(spark.readStream.schema(ENTITY.spark()).parquet(str(tmp_path / "in")), a.root, str(tmp_path / f"cp{k}")).awaitTermination()
    assert ids(Archive.load(spark, a.root).table().scan()) == [100, 101, 102, 103, 104, 105]


# --- CSV -------------------------------------------------------------------------------------------------------------


def write(tmp_path, text: str) -> str:
    (tmp_path / "f.csv").write_bytes(text.encode())
    return f"file://{tmp_path}/f.csv"


def test_csv_inference_and_rows(spark, tmp_path):
    path = write(tmp_path, ' id , flag,n,x,s,void\n1,TRUE,+5, 1.5 ,"a ""q""\nb",\n2,false,-7,2e3,inf,\n3,,9,.5, c ,\n')
    raw = csv.read_strings(spark, path, csv.CsvOptions())
    schema = csv.infer_schema(raw)
    assert [(f.name, f.kind, f.nullable) for f in schema.fields] == [("id", Kind.INTEGER, False), ("flag", Kind.BOOLEAN, True), ("n", Kind.INTEGER, False), ("x", Kind.FLOAT, False), ("s", Kind.TEXT, False), ("void", Kind.TEXT, True)]
    df, _ = csv.read_csv(spark, path, None, csv.CsvOptions(row_id="id"))
    got = [tuple(r) for r in df.orderBy(ROW_ID).collect()]
    assert got[0] == (1, 1, True, 5, 1.5, 'a "q"\nb', None) and got[2] == (3, 3, None, 9, 0.5, "c", None)
    assert ids(csv.read_csv(spark, path)[0]) == [1, 2, 3]
    assert ids(csv.read_row_ids(spark, path, csv.CsvOptions(row_id="id"))) == [1, 2, 3]
    assert ids(csv.read_csv(spark, path, None, csv.CsvOptions(first_row_id=10))[0]) == [10, 11, 12]


@pytest.mark.parametrize("text", ["a,b\n1,2\n3\n", "a,a\n1,2\n", "a,b\n1,2,3\n"])
def test_csv_shape_errors(spark, tmp_path, text):
    with pytest.raises(csv.CsvError):
        csv.read_csv(spark, write(tmp_path, text))


def test_csv_value_errors(spark, tmp_path):
    path = write(tmp_path, "a,b\n1,x\n1,y\n")
    for schema, options in ((Schema([Field("b", Kind.INTEGER)]), csv.CsvOptions()), (Schema([Field("c", Kind.TEXT)]), csv.CsvOptions()), (None, csv.CsvOptions(row_id="a")), (None, csv.CsvOptions(row_id="b")), (None, csv.CsvOptions(row_id="z")), (None, csv.CsvOptions(kinds={"z": Kind.TEXT}))):
        with pytest.raises(csv.CsvError):
            csv.read_csv(spark, path, schema, options)


# --- reports and registry --------------------------------------------------------------------------------------------


def test_baselines_agree_and_summaries_add_up(spark):
    m = reports.workload_metrics(spark, False).persist()
    rows = m.collect()
    assert len(rows) == 24
    by = {}
    for r in rows:
        by.setdefault(r["workload"], set()).add(r["matched"])
        assert r["candidates"] >= r["matched"]
    assert all(len(v) == 1 for v in by.values())
    a = {r["baseline"]: r for r in reports.aggregated(m).collect()}
    assert a["flat_scan"]["weighted_ratio"] == 1.0 and a["index"]["candidates"] < a["flat_scan"]["candidates"]
    assert reports.top_ratio(m).first()["baseline"] == "flat_scan"
    index = Index.build(generators.clusters(spark, *generators.SMALL).drop("cluster"), ["x", "y"], BuildConfig(8, 8))
    assert reports.compared(index, index.rows, Box((18, 18), (52, 52)), 1)["agreement"]
    levels = reports.packed_levels(bounds(reports.packed_layout(index.rows, ["x", "y"]), ["x", "y"], ["leaf_id"]), ["x", "y"])
    assert levels[-1].first()["cardinality"] == 60


def test_registry_has_sql_for_every_query():
    assert set(registry.queries()) == set(registry.oracle_sql()) and len(registry.queries()) >= 90


@pytest.mark.parametrize("name", ["rows", "tombstoned_delta_rows", "structural_split_axis", "split_quality", "execution_stats", "maintenance_decision", "csv_roundtrip", "encode_record"])
def test_registry_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    got, want = registry.queries()[name](spark, sf), con.execute(registry.oracle_sql()[name])
    cols = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(cols)
    norm = lambda rows: sorted((tuple(float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r) for r in rows), key=str)
    assert norm(tuple(r[c] for c in cols) for r in got.collect()) == norm(want.fetchall())
