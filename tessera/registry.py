"""Registry: one query for each operator, with the SQL that it must equal."""

from __future__ import annotations

import json
import tempfile
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import boxes, encoders
from tessera.functions.boxes import Box
from tessera.functions.encoders import DimensionMapping, RecordEncoder
from tessera.functions.ordering import ranked
from tessera.functions.schema import ROW_ID, Field, Kind, Schema, milliseconds, typed
from tessera.operators import cli, csv_lifecycle, layout, maintenance, reports
from tessera.operators.index import Index, InvalidIndex
from tessera.operators.layout import BuildConfig
from tessera.operators.predicates import Predicate, PredicateError, plan
from tessera.operators.table import Table, statistics_of
from tessera.plans.planner import Contract, Statistics, choose
from tessera.sources import csv, generators
from tessera.sources.archive import Archive, content_hash, read_batch, write_batch
from tessera.sources.store import ArchiveError, Store
from tessera.streaming.delta import append_stream

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

ORDERS = Schema([Field("o_custkey", Kind.INTEGER), Field("o_orderstatus", Kind.CATEGORY), Field("o_totalprice", Kind.FLOAT), Field("o_orderdate", Kind.TIMESTAMP_MS), Field("o_orderpriority", Kind.CATEGORY)])
EVENTS = Schema([Field("ts", Kind.TIMESTAMP_MS), Field("user_id", Kind.INTEGER), Field("event_type", Kind.CATEGORY), Field("value", Kind.FLOAT), Field("props", Kind.TEXT)])
ITEM = Schema([Field("l_partkey", Kind.INTEGER), Field("l_quantity", Kind.FLOAT), Field("l_discount", Kind.FLOAT), Field("l_returnflag", Kind.CATEGORY)])
#: 1995-01-01 and 1996-01-01 in milliseconds.
T95, T96 = 788918400000, 820454400000


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def orders(spark: SparkSession, sf: str) -> DataFrame:
    return typed(read(spark, sf, "orders"), ORDERS, "o_orderkey", {"o_orderdate": milliseconds("o_orderdate")})


def events(spark: SparkSession, sf: str) -> DataFrame:
    return typed(read(spark, sf, "events"), EVENTS, "event_id", {"ts": milliseconds("ts")})


def orders_table(spark: SparkSession, sf: str) -> Table:
    return Table(ORDERS, orders(spark, sf))


def events_table(spark: SparkSession, sf: str) -> Table:
    return Table(EVENTS, events(spark, sf))


O_SQL = "SELECT o_orderkey AS row_id, o_custkey, o_orderstatus, o_totalprice, epoch_us(o_orderdate) // 1000 AS o_orderdate, o_orderpriority FROM orders"
E_SQL = "SELECT event_id AS row_id, epoch_us(ts) // 1000 AS ts, user_id, event_type, value, props FROM events"
PRICE = Predicate.range("o_totalprice", 100000.0, 200000.0)
STATUS = Predicate.equals("o_orderstatus", "F")
DAY = Predicate.range("o_orderdate", T95, T96)
WHERE = "o_totalprice BETWEEN 100000 AND 200000 AND o_orderstatus = 'F'"


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """A planned conjunction over the orders."""
    return orders_table(spark, sf).rows([PRICE, STATUS])


# --- predicates and conjunctions -------------------------------------------------------------------------------------


@query("typed_eq_int", f"SELECT * FROM ({O_SQL}) WHERE o_custkey = 7")
def _(s, d):
    return orders_table(s, d).rows([Predicate.equals("o_custkey", 7)])


@query("typed_eq_float", f"SELECT * FROM ({O_SQL}) WHERE o_totalprice = (SELECT min(o_totalprice) FROM orders)")
def _(s, d):
    low = read(s, d, "orders").agg(F.min("o_totalprice")).first()[0]
    return orders_table(s, d).rows([Predicate.equals("o_totalprice", low)])


@query("typed_eq_category", f"SELECT * FROM ({E_SQL}) WHERE event_type = 'click'")
def _(s, d):
    return events_table(s, d).rows([Predicate.equals("event_type", "click")])


@query("typed_eq_ts", f"SELECT * FROM ({E_SQL}) WHERE ts = (SELECT epoch_us(min(ts)) // 1000 FROM events)")
def _(s, d):
    first = read(s, d, "events").agg(milliseconds(F.min("ts"))).first()[0]
    return events_table(s, d).rows([Predicate.equals("ts", first)])


@query("typed_eq_text_unindexed", f"SELECT * FROM ({E_SQL}) WHERE props = (SELECT min(props) FROM events)")
def _(s, d):
    low = read(s, d, "events").agg(F.min("props")).first()[0]
    return events(s, d).where(plan(EVENTS, [Predicate.equals("props", low)], indexed=False).column())


@query("typed_range_int", f"SELECT * FROM ({O_SQL}) WHERE o_custkey BETWEEN 10 AND 40")
def _(s, d):
    return orders_table(s, d).rows([Predicate.range("o_custkey", 10, 40)])


@query("typed_range_float", f"SELECT * FROM ({O_SQL}) WHERE o_totalprice BETWEEN 100000 AND 200000")
def _(s, d):
    return orders_table(s, d).rows([PRICE])


@query("typed_range_ts", f"SELECT * FROM ({O_SQL}) WHERE o_orderdate BETWEEN {T95} AND {T96}")
def _(s, d):
    return orders_table(s, d).rows([DAY])


@query("typed_range_boundaries", "SELECT l_discount, count(*) AS n FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 GROUP BY 1")
def _(s, d):
    p = plan(Schema([Field("l_discount", Kind.FLOAT)]), [Predicate.range(0, 0.05, 0.07)])
    return read(s, d, "lineitem").where(p.column()).groupBy("l_discount").agg(F.count("*").alias("n"))


@query("typed_conj_2", f"SELECT * FROM ({O_SQL}) WHERE {WHERE}")
def _(s, d):
    return orders_table(s, d).rows([PRICE, STATUS])


@query("typed_conj_4", f"SELECT * FROM ({O_SQL}) WHERE {WHERE} AND o_orderdate BETWEEN {T95} AND {T96} AND o_custkey BETWEEN 1 AND 700")
def _(s, d):
    return orders_table(s, d).rows([PRICE, STATUS, DAY, Predicate.range("o_custkey", 1, 700)])


@query("typed_conj_same_field_intersect", f"SELECT * FROM ({O_SQL}) WHERE o_totalprice BETWEEN 150000 AND 200000")
def _(s, d):
    return orders_table(s, d).rows([PRICE, Predicate.range("o_totalprice", 150000.0, 300000.0)])


@query("typed_unsatisfiable", f"SELECT * FROM ({O_SQL}) WHERE false")
def _(s, d):
    return orders_table(s, d).rows([PRICE, Predicate.range("o_totalprice", 250000.0, 300000.0)])


@query("typed_eq_ordinal", f"SELECT * FROM ({O_SQL}) WHERE o_custkey = 7")
def _(s, d):
    return orders_table(s, d).rows([Predicate.equals(0, 7)])


@query("validation_errors", "SELECT * FROM (VALUES ('unknown field', 'UnknownField'), ('unknown ordinal', 'UnknownField'), ('null literal', 'NullLiteral'), ('text for a number', 'TypeMismatch'), ('integer for a float', 'TypeMismatch'), ('not a number', 'NotFinite'), ('infinite', 'NotFinite'), ('range of a category', 'RangeUnsupported'), ('inverted range', 'InvertedRange'), ('no predicate', 'EmptyConjunction')) t(\"case\", error)")
def _(s, d):
    cases = {
        "unknown field": [Predicate.equals("nothing", 1)], "unknown ordinal": [Predicate.equals(99, 1)], "null literal": [Predicate.equals("o_custkey", None)], "text for a number": [Predicate.equals("o_custkey", "7")], "integer for a float": [Predicate.equals("o_totalprice", 7)],
        "not a number": [Predicate.equals("o_totalprice", float("nan"))], "infinite": [Predicate.range("o_totalprice", 0.0, float("inf"))], "range of a category": [Predicate.range("o_orderstatus", "A", "F")], "inverted range": [Predicate.range("o_custkey", 9, 1)], "no predicate": [],
    }
    out = []
    for name, asked in cases.items():
        try:
            orders_table(s, d).rows(asked)
            out.append((name, "none"))
        except PredicateError as e:
            out.append((name, type(e).__name__))
    return s.createDataFrame(out, "case string, error string")


@query("typed_empty_result", f"SELECT * FROM ({O_SQL}) WHERE o_totalprice BETWEEN -5 AND -1")
def _(s, d):
    return orders_table(s, d).rows([Predicate.range("o_totalprice", -5.0, -1.0)])


# --- output contracts ------------------------------------------------------------------------------------------------


@query("row_ids", f"SELECT o_orderkey AS row_id FROM orders WHERE {WHERE}")
def _(s, d):
    return orders_table(s, d).row_ids([PRICE, STATUS])


@query("rows", f"SELECT * FROM ({O_SQL}) WHERE {WHERE}")
def _(s, d):
    return orders_table(s, d).rows([PRICE, STATUS])


@query("count", f"SELECT count(*) AS matches FROM orders WHERE {WHERE}")
def _(s, d):
    return orders_table(s, d).count([PRICE, STATUS])


@query("exists_true", f"SELECT count(*) > 0 AS has_match FROM orders WHERE {WHERE}")
def _(s, d):
    return orders_table(s, d).exists([PRICE, STATUS])


@query("exists_false", "SELECT count(*) > 0 AS has_match FROM orders WHERE o_totalprice BETWEEN -5 AND -1")
def _(s, d):
    return orders_table(s, d).exists([Predicate.range("o_totalprice", -5.0, -1.0)])


@query("visit_ids_collected", "SELECT o_orderkey AS row_id FROM orders WHERE o_custkey BETWEEN 10 AND 40")
def _(s, d):
    seen: list[int] = []
    orders_table(s, d).visit_row_ids([Predicate.range("o_custkey", 10, 40)], seen.append)
    return s.createDataFrame([(x,) for x in seen], "row_id long")


@query("visit_rows_collected", f"SELECT * FROM ({O_SQL}) WHERE o_custkey BETWEEN 10 AND 20")
def _(s, d):
    seen = []
    orders_table(s, d).visit_rows([Predicate.range("o_custkey", 10, 20)], seen.append)
    return s.createDataFrame(seen, ORDERS.spark())


@query("field_projection", "SELECT o_totalprice FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)")
def _(s, d):
    return orders_table(s, d).value_of(read(s, d, "orders").agg(F.min("o_orderkey")).first()[0], "o_totalprice")


# --- tombstones and deltas -------------------------------------------------------------------------------------------


def tombstoned(s: SparkSession, d: str) -> Table:
    """Ids divisible by 7, and some that no row has."""
    ids = read(s, d, "orders").where("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias(ROW_ID)).union(s.range(10).select((-F.col("id") - 1).alias(ROW_ID)))
    return orders_table(s, d).with_tombstones(ids)


def with_delta(s: SparkSession, d: str) -> Table:
    """Base: ids whose last digit is below 8; delta: the rest."""
    every = orders(s, d)
    return Table(ORDERS, every.where(F.pmod(ROW_ID, F.lit(10)) < 8)).with_delta(every.where(F.pmod(ROW_ID, F.lit(10)) >= 8))


for _tag, _make, _cond in (
    ("tombstoned", tombstoned, "row_id % 7 <> 0"),
    ("delta", with_delta, "true"),
    ("tombstoned_delta", lambda s, d: with_delta(s, d).with_tombstones(tombstoned(s, d).tombstones), "row_id % 7 <> 0"),
):
    _from = f"FROM ({O_SQL}) WHERE {WHERE} AND {_cond}"
    query(f"{_tag}_ids", f"SELECT row_id {_from}")(lambda s, d, m=_make: m(s, d).row_ids([PRICE, STATUS]))
    query(f"{_tag}_rows", f"SELECT * {_from}")(lambda s, d, m=_make: m(s, d).rows([PRICE, STATUS]))
    query(f"{_tag}_count", f"SELECT count(*) AS matches {_from}")(lambda s, d, m=_make: m(s, d).count([PRICE, STATUS]))
    query(f"{_tag}_exists", f"SELECT count(*) > 0 AS has_match {_from}")(lambda s, d, m=_make: m(s, d).exists([PRICE, STATUS]))


@query("delta_stats", f"SELECT count(*) AS total_records, count(*) AS candidate_records, count(*) FILTER (WHERE {WHERE}) AS matched_records, 1.0::DOUBLE AS candidate_ratio FROM orders")
def _(s, d):
    return with_delta(s, d).stats([PRICE, STATUS])


# --- encoders --------------------------------------------------------------------------------------------------------


@query("encode_record", "SELECT o_orderkey AS row_id, CAST(o_custkey AS REAL) AS x0, CAST(r AS REAL) AS x1, CAST(o_totalprice AS REAL) AS x2, CAST(epoch_us(o_orderdate) // 1000 AS REAL) AS x3 FROM orders JOIN (SELECT o_orderstatus, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS r FROM orders GROUP BY 1) USING (o_orderstatus)")
def _(s, d):
    df = orders(s, d).drop("o_orderpriority")
    enc = RecordEncoder.from_batch(df, Schema(ORDERS.fields[:4]))
    return enc.encode(df)


@query("encode_dictionary_first_seen", "SELECT event_type AS label, row_number() OVER (ORDER BY min(event_id)) - 1 AS code FROM events GROUP BY 1")
def _(s, d):
    labels = encoders.first_seen(events(s, d), "event_type").labels
    return s.createDataFrame(list(zip(labels, range(len(labels)), strict=True)), "label string, code long")


@query("encode_by_label_table", "SELECT event_id AS row_id, code FROM events JOIN (SELECT event_type, row_number() OVER (ORDER BY min(event_id)) - 1 AS code FROM events GROUP BY 1) USING (event_type)")
def _(s, d):
    df = events(s, d)
    return encoders.coded(df, "event_type", encoders.label_table(df, "event_type"), "code").select(ROW_ID, "code")


@query("encode_boolean", "SELECT event_id AS row_id, CASE WHEN value > 50 THEN 1.0::DOUBLE ELSE 0.0 END AS x0 FROM events")
def _(s, d):
    schema = Schema([Field("big", Kind.BOOLEAN)])
    df = read(s, d, "events").select(F.col("event_id").alias(ROW_ID), (F.col("value") > 50).alias("big"))
    return RecordEncoder(schema, {}).encode(df).select(ROW_ID, F.col("x0").cast("double").alias("x0"))


@query("dimension_mapping", "SELECT * FROM (VALUES (0, 'o_custkey'), (1, 'o_orderstatus'), (2, 'o_totalprice'), (3, 'o_orderdate'), (4, 'o_orderpriority')) t(dimension, field)")
def _(s, d):
    m = DimensionMapping.identity(ORDERS)
    return s.createDataFrame([(i, m.field_of(i)) for i in range(m.dimensions)], "dimension int, field string")


# --- boxes, bounds, splits -------------------------------------------------------------------------------------------

#: Points in two dimensions of the orders, and a fixed grid over them that SQL can repeat.
DIMS = ["x", "y"]
P_SQL = "SELECT o_orderkey AS row_id, o_totalprice AS x, CAST(o_custkey AS DOUBLE) AS y FROM orders"
G_SQL = f"SELECT *, CAST(floor(x / 50000) * 100 + floor(y / 100) AS BIGINT) AS leaf_id FROM ({P_SQL})"
L_SQL = f"SELECT leaf_id, count(*) AS cardinality, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, (max(x) - min(x)) * (max(y) - min(y)) AS volume FROM ({G_SQL}) GROUP BY 1"
REGION = Box((100000.0, 100.0), (220000.0, 450.0))
R_SQL = "x BETWEEN 100000 AND 220000 AND y BETWEEN 100 AND 450"
C_SQL = "CASE WHEN max_x < 100000 OR min_x > 220000 OR max_y < 100 OR min_y > 450 THEN 'D' WHEN min_x >= 100000 AND max_x <= 220000 AND min_y >= 100 AND max_y <= 450 THEN 'C' ELSE 'P' END"


def points(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "orders").select(F.col("o_orderkey").alias(ROW_ID), F.col("o_totalprice").alias("x"), F.col("o_custkey").cast("double").alias("y"))


def grid(s: SparkSession, d: str) -> DataFrame:
    return points(s, d).withColumn("leaf_id", (F.floor(F.col("x") / 50000) * 100 + F.floor(F.col("y") / 100)).cast("long"))


def grid_index(s: SparkSession, d: str) -> Index:
    """The grid as an index: one root over all its cells."""
    rows = grid(s, d).withColumn("row_index", F.row_number().over(Window.partitionBy("leaf_id").orderBy(ROW_ID)) - 1)
    leaf = boxes.bounds(rows, DIMS, ["leaf_id"]).select(F.col("leaf_id").alias("node_id"), F.lit("0").alias("path"), F.lit(-1).cast("long").alias("parent_id"), F.lit(True).alias("is_leaf"), "cardinality", *[f"{m}_{x}" for x in DIMS for m in ("min", "max")])
    root = boxes.bounds(rows, DIMS).select(F.lit(-1).cast("long").alias("node_id"), F.lit("").alias("path"), F.lit(None).cast("long").alias("parent_id"), F.lit(False).alias("is_leaf"), "cardinality", *[f"{m}_{x}" for x in DIMS for m in ("min", "max")])
    return Index(rows, root.union(leaf), DIMS, BuildConfig(1_000_000))


@query("centroid_by_leaf", f"SELECT leaf_id, round(avg(x) / 7, 4) AS c_x, round(avg(y) / 7, 4) AS c_y FROM ({G_SQL}) GROUP BY 1")
def _(s, d):
    return encoders.centroids(grid(s, d), DIMS, "leaf_id").select("leaf_id", F.round(F.col("c_x") / 7, 4).alias("c_x"), F.round(F.col("c_y") / 7, 4).alias("c_y"))


@query("residuals", f"SELECT row_id, round((x - avg(x) OVER (PARTITION BY leaf_id)) / 7, 3) AS r_x, round((y - avg(y) OVER (PARTITION BY leaf_id)) / 7, 3) AS r_y FROM ({G_SQL})")
def _(s, d):
    return encoders.residuals(grid(s, d), DIMS, "leaf_id", [ROW_ID]).select(ROW_ID, F.round(F.col("r_x") / 7, 3).alias("r_x"), F.round(F.col("r_y") / 7, 3).alias("r_y"))


@query("reconstruct", f"SELECT row_id, round(x, 3) AS x, round(y, 3) AS y FROM ({P_SQL})")
def _(s, d):
    r = encoders.residuals(grid(s, d), DIMS, "leaf_id", [ROW_ID])
    return encoders.reconstructed(r, DIMS, [ROW_ID]).select(ROW_ID, F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query("bounds_root", f"SELECT count(*) AS cardinality, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM ({P_SQL})")
def _(s, d):
    return boxes.bounds(points(s, d), DIMS)


@query("volume", f"SELECT leaf_id, round(volume, 3) AS volume FROM ({L_SQL})")
def _(s, d):
    return boxes.bounds(grid(s, d), DIMS, ["leaf_id"]).select("leaf_id", F.round(boxes.volume(DIMS), 3).alias("volume"))


@query("extent", f"SELECT leaf_id, round((max_x - min_x) + (max_y - min_y), 3) AS extent FROM ({L_SQL})")
def _(s, d):
    return boxes.bounds(grid(s, d), DIMS, ["leaf_id"]).select("leaf_id", F.round(boxes.extent(DIMS), 3).alias("extent"))


@query("density", f"SELECT leaf_id, round(CASE WHEN volume > 0 THEN cardinality / volume ELSE -1 END, 9) AS density FROM ({L_SQL})")
def _(s, d):
    c = boxes.density(DIMS)
    return boxes.bounds(grid(s, d), DIMS, ["leaf_id"]).select("leaf_id", F.round(F.when(c < float("inf"), c).otherwise(-1.0), 9).alias("density"))


@query("variance_by_dimension", f"SELECT round(var_pop(x), 2) AS var_x, round(var_pop(y), 2) AS var_y FROM ({P_SQL})")
def _(s, d):
    return boxes.variances(points(s, d), DIMS).select(F.round("var_x", 2).alias("var_x"), F.round("var_y", 2).alias("var_y"))


@query("median_split_axis", f"SELECT row_id, row_number() OVER (ORDER BY x, row_id) - 1 < (SELECT count(*) FROM orders) // 2 AS is_left FROM ({P_SQL})")
def _(s, d):
    r = layout.ranked(points(s, d).withColumn("g", F.lit(0)), "x", ["g"])
    return r.select(ROW_ID, (F.col("rn") < F.floor(F.col("n") / 2)).alias("is_left"))


_RANK = f"SELECT leaf_id, row_number() OVER w - 1 AS rn, count(*) OVER (PARTITION BY leaf_id) AS n, y - lag(y) OVER w AS gap FROM ({G_SQL}) WINDOW w AS (PARTITION BY leaf_id ORDER BY y, row_id)"
_CUT = f"SELECT leaf_id, n, n // 2 AS middle, max(gap) AS widest, arg_max(rn, gap * 1e9 - abs(rn - n // 2) - rn * 1e-6) AS spot, quantile_disc(gap, 0.5) FILTER (WHERE gap > 0) AS usual, count(*) FILTER (WHERE gap > 0) AS positive FROM ({_RANK}) WHERE rn > 0 GROUP BY 1, 2"


@query("structural_split_axis", f"SELECT leaf_id, n, middle, CASE WHEN positive = 1 OR (positive > 1 AND widest >= 4 * usual) THEN spot ELSE middle END AS cut FROM ({_CUT})")
def _(s, d):
    return layout.structural_cuts(grid(s, d), "y", ["leaf_id"]).select("leaf_id", "n", F.col("middle").cast("long").alias("middle"), F.col("cut").cast("long").alias("cut"))


@query("split_quality", f"""
SELECT round(pv, 2) AS parent_volume, round(lv + rv, 2) AS child_volume, round((pv - lv - rv) / pv, 6) AS volume_reduction, round(pe, 3) AS parent_extent, round(le + re, 3) AS child_extent, round((pe - le - re) / pe, 6) AS extent_reduction, l AS left_rows, r AS right_rows, abs(l - r) AS balance_penalty, round(greatest(0, CASE WHEN least(lbx, rbx) < greatest(lax, rax) OR least(lby, rby) < greatest(lay, ray) THEN 0 ELSE least(lbx, rbx) - greatest(lax, rax) + least(lby, rby) - greatest(lay, ray) END), 3) AS overlap
FROM (SELECT *, (bx - ax) * (by_ - ay) AS pv, (lbx - lax) * (lby - lay) AS lv, (rbx - rax) * (rby - ray) AS rv, bx - ax + by_ - ay AS pe, lbx - lax + lby - lay AS le, rbx - rax + rby - ray AS re
FROM (SELECT min(x) AS ax, max(x) AS bx, min(y) AS ay, max(y) AS by_, count(*) FILTER (WHERE x < 150000) AS l, count(*) FILTER (WHERE x >= 150000) AS r,
min(x) FILTER (WHERE x < 150000) AS lax, max(x) FILTER (WHERE x < 150000) AS lbx, min(y) FILTER (WHERE x < 150000) AS lay, max(y) FILTER (WHERE x < 150000) AS lby,
min(x) FILTER (WHERE x >= 150000) AS rax, max(x) FILTER (WHERE x >= 150000) AS rbx, min(y) FILTER (WHERE x >= 150000) AS ray, max(y) FILTER (WHERE x >= 150000) AS rby FROM ({P_SQL})))""")
def _(s, d):
    q = layout.split_quality(points(s, d), DIMS, F.col("x") < 150000, [])
    places = {"parent_volume": 2, "child_volume": 2, "volume_reduction": 6, "parent_extent": 3, "child_extent": 3, "extent_reduction": 6, "overlap": 3}
    return q.select(*[F.round(c, places[c]).alias(c) if c in places else c for c in q.columns])


@query("best_split_root", "SELECT 0 AS axis, 20 AS cut")
def _(s, d):
    x = generators.clusters(s, *generators.SMALL).orderBy(ROW_ID).select(*DIMS).toPandas().to_numpy("float32")
    b = layout.best_split(x)
    return s.createDataFrame([(b.axis, b.cut)], "axis int, cut int")


@query("structure_metrics", f"SELECT count(*) AS leaf_count, min(cardinality) AS min_cardinality, max(cardinality) AS max_cardinality, round(avg(cardinality), 6) AS avg_cardinality, round(sum(volume), 1) AS total_volume, round(sum(cardinality) / sum(volume), 9) AS density, count(*) FILTER (WHERE volume = 0) AS zero_volume_leaves FROM ({L_SQL})")
def _(s, d):
    m = layout.structure_metrics(boxes.bounds(grid(s, d), DIMS, ["leaf_id"]), DIMS)
    return m.withColumns({"avg_cardinality": F.round("avg_cardinality", 6), "total_volume": F.round("total_volume", 1), "density": F.round("density", 9)})


_PAIR = f"SELECT greatest(0, CASE WHEN least(a.max_x, b.max_x) < greatest(a.min_x, b.min_x) OR least(a.max_y, b.max_y) < greatest(a.min_y, b.min_y) THEN 0 ELSE least(a.max_x, b.max_x) - greatest(a.min_x, b.min_x) + least(a.max_y, b.max_y) - greatest(a.min_y, b.min_y) END) AS o FROM ({L_SQL}) a JOIN ({L_SQL}) b ON a.leaf_id < b.leaf_id"


@query("sibling_overlap", f"SELECT count(*) AS sibling_pairs, count(*) FILTER (WHERE o > 0) AS overlapping_pairs, round(sum(o), 2) AS total_overlap, round(avg(o), 6) AS average_overlap FROM ({_PAIR})")
def _(s, d):
    o = layout.sibling_overlap(grid_index(s, d).nodes, DIMS)
    return o.withColumns({"total_overlap": F.round("total_overlap", 2), "average_overlap": F.round("average_overlap", 6)})


@query("footprint", f"SELECT n AS rows, k AS node_count, 2 * n AS residual_scalars, 2 * k AS centroid_scalars, 4 * k AS bounds_scalars, 2 * n + 6 * k AS total_scalars, 4 * (2 * n + 6 * k) AS total_bytes, 8 * n AS raw_bytes, round((2 * n + 6 * k) / (2 * n), 6) AS overhead_ratio FROM (SELECT CAST(sum(cardinality) AS BIGINT) AS n, count(*) + 1 AS k FROM ({L_SQL}))")
def _(s, d):
    return layout.footprint(grid_index(s, d).nodes, 2).withColumn("overhead_ratio", F.round("overhead_ratio", 6))


# --- index execution -------------------------------------------------------------------------------------------------


@query("classify_leaf_boxes", f"SELECT leaf_id, {C_SQL} AS coverage FROM ({L_SQL})")
def _(s, d):
    return grid_index(s, d).leaves.select(F.col("node_id").alias("leaf_id"), REGION.coverage(DIMS).alias("coverage"))


@query("retained_leaves", f"SELECT leaf_id, cardinality, {C_SQL} AS coverage FROM ({L_SQL}) WHERE {C_SQL} <> 'D'")
def _(s, d):
    return grid_index(s, d).retained(REGION).select(F.col("node_id").alias("leaf_id"), "cardinality", "coverage")


@query("box_query_points", f"SELECT x, y FROM ({P_SQL}) WHERE {R_SQL}")
def _(s, d):
    return grid_index(s, d).points(REGION)


@query("count_via_leaves", f"SELECT count(*) AS matches FROM ({P_SQL}) WHERE {R_SQL}")
def _(s, d):
    return grid_index(s, d).count(REGION)


@query("exists_via_leaves", f"SELECT count(*) > 0 AS has_match FROM ({P_SQL}) WHERE {R_SQL}")
def _(s, d):
    return s.createDataFrame([(grid_index(s, d).exists(REGION),)], "has_match boolean")


_REF = f"SELECT leaf_id, row_number() OVER (PARTITION BY leaf_id ORDER BY row_id) - 1 AS row_index, row_id, x, y FROM ({G_SQL})"


@query("references", f"SELECT leaf_id, row_index FROM ({_REF}) WHERE {R_SQL}")
def _(s, d):
    return grid_index(s, d).references(REGION).select("leaf_id", F.col("row_index").cast("long").alias("row_index"))


@query("dereference", f"SELECT row_id, x, y FROM ({P_SQL}) WHERE {R_SQL}")
def _(s, d):
    i = grid_index(s, d)
    return i.dereference(i.references(REGION)).select(ROW_ID, "x", "y")


@query("execution_stats", f"SELECT 1 + count(*) AS visited_nodes, count(*) AS total_leaves, count(*) FILTER (WHERE c <> 'D') AS retained_leaves, count(*) FILTER (WHERE c = 'C') AS covered_leaves, round(count(*) FILTER (WHERE c <> 'D') / count(*), 6) AS retained_leaf_ratio, CAST(sum(cardinality) AS BIGINT) AS total_records, CAST(coalesce(sum(cardinality) FILTER (WHERE c <> 'D'), 0) AS BIGINT) AS reconstructed_records, (SELECT count(*) FROM ({P_SQL}) WHERE {R_SQL}) AS matched_records, round(coalesce(sum(cardinality) FILTER (WHERE c <> 'D'), 0) / sum(cardinality), 6) AS candidate_ratio, CAST(sum(cardinality) FILTER (WHERE c = 'D') AS BIGINT) AS records_pruned FROM (SELECT *, {C_SQL} AS c FROM ({L_SQL}))")
def _(s, d):
    return grid_index(s, d).stats(REGION).withColumns({"retained_leaf_ratio": F.round("retained_leaf_ratio", 6), "candidate_ratio": F.round("candidate_ratio", 6)})


def published(s: SparkSession, large: bool, depth: int, workload: str) -> DataFrame:
    """Traversal counters of a generated data set."""
    p = generators.clusters(s, *(generators.LARGE if large else generators.SMALL)).drop("cluster")
    i = Index.build(p, DIMS, BuildConfig(8, depth))
    region = dict(generators.workloads(large))[workload]
    return i.stats(region).select("visited_nodes", "retained_leaves", "covered_leaves", "reconstructed_records", "matched_records").join(i.leaves.agg(F.max("cardinality").alias("max_leaf"), F.round(F.avg("cardinality"), 2).alias("avg_leaf")))


@query("index_small_counters", "SELECT CAST(13 AS BIGINT) AS visited_nodes, CAST(2 AS BIGINT) AS retained_leaves, CAST(0 AS BIGINT) AS covered_leaves, CAST(10 AS BIGINT) AS reconstructed_records, CAST(5 AS BIGINT) AS matched_records, CAST(5 AS BIGINT) AS max_leaf, 5.0::DOUBLE AS avg_leaf")
def _(s, d):
    return published(s, False, 8, "cluster_boundary_range")


@query("index_large_counters", "SELECT CAST(45 AS BIGINT) AS visited_nodes, CAST(10 AS BIGINT) AS retained_leaves, CAST(8 AS BIGINT) AS covered_leaves, CAST(78 AS BIGINT) AS reconstructed_records, CAST(71 AS BIGINT) AS matched_records, CAST(8 AS BIGINT) AS max_leaf, 7.81::DOUBLE AS avg_leaf")
def _(s, d):
    return published(s, True, 16, "large_cross_cluster_boundary")


@query("built_index_query", f"SELECT row_id FROM ({P_SQL}) WHERE {R_SQL}")
def _(s, d):
    return Index.build(points(s, d), DIMS, BuildConfig(256, 24)).query(REGION).select(ROW_ID)


@query("built_index_count", f"SELECT count(*) AS matches FROM ({P_SQL}) WHERE {R_SQL}")
def _(s, d):
    return Index.build(points(s, d), DIMS, BuildConfig(256, 24)).count(REGION)


@query("index_file", f"SELECT row_id FROM ({P_SQL}) WHERE {R_SQL}")
def _(s, d):
    path = folder(s)
    Index.build(points(s, d), DIMS, BuildConfig(256, 24)).save(path)
    return Index.load(s, path).query(REGION).select(ROW_ID)


@query("rows_in_leaf_order", f"SELECT leaf_id, row_index, row_number() OVER (ORDER BY leaf_id, row_index) - 1 AS place FROM ({_REF}) WHERE {R_SQL}")
def _(s, d):
    got = grid_index(s, d).query_in_order(REGION).select("leaf_id", F.col("row_index").cast("long").alias("row_index"))
    return s.createDataFrame([(r[0], r[1], i) for i, r in enumerate(got.collect())], "leaf_id long, row_index long, place long")


@query("reusable_rows", f"SELECT row_id FROM ({P_SQL}) WHERE {R_SQL}")
def _(s, d):
    buffer: list = [None]
    grid_index(s, d).query_into(REGION, buffer)
    return s.createDataFrame([(r[ROW_ID],) for r in buffer], "row_id long")


@query("visit_references", f"SELECT leaf_id, row_index FROM ({_REF}) WHERE {R_SQL}")
def _(s, d):
    seen: list = []
    grid_index(s, d).visit_references(REGION, lambda leaf, at: seen.append((leaf, at)))
    return s.createDataFrame(seen, "leaf_id long, row_index long")


@query("exists_inspected", "SELECT * FROM (VALUES ('cluster_boundary_range', true, 4::BIGINT), ('full_dataset_range', true, 1), ('empty_far_range', false, 0), ('large_cross_cluster_boundary', true, 5), ('large_full_dataset_range', true, 1)) t(workload, has_match, inspected_rows)")
def _(s, d):
    out = None
    for large, names in ((False, ("cluster_boundary_range", "full_dataset_range", "empty_far_range")), (True, ("large_cross_cluster_boundary", "large_full_dataset_range"))):
        i = Index.build(generators.clusters(s, *(generators.LARGE if large else generators.SMALL)).drop("cluster"), DIMS, BuildConfig(8, 16 if large else 8))
        for name in names:
            one = i.exists_inspected(dict(generators.workloads(large))[name]).select(F.lit(name).alias("workload"), "has_match", "inspected_rows")
            out = one if out is None else out.union(one)
    return out


@query("checked_build", "SELECT * FROM (VALUES ('good', false), ('too deep for its leaves', true)) t(\"case\", refused)")
def _(s, d):
    p = generators.clusters(s, *generators.LARGE).drop("cluster")
    out = []
    for name, depth in (("good", 16), ("too deep for its leaves", 8)):
        try:
            Index.checked(p, DIMS, BuildConfig(8, depth)).release()
            out.append((name, False))
        except InvalidIndex:
            out.append((name, True))
    return s.createDataFrame(out, "case string, refused boolean")


@query("validate_good", "SELECT * FROM (VALUES ('node_ids', 0::BIGINT), ('dimensions', 0), ('leaf_cardinality', 0), ('leaf_shapes', 0), ('leaf_rows_in_bounds', 0), ('ownership', 0), ('topology', 0), ('parent_bounds', 0)) t(\"check\", violations)")
def _(s, d):
    p = generators.clusters(s, *generators.SMALL).drop("cluster")
    return Index.build(p, DIMS, BuildConfig(8, 8)).validation()


@query("validate_corrupted", f"SELECT * FROM (VALUES ('leaf_cardinality', (SELECT count(*) FROM ({L_SQL}) WHERE cardinality > 3)), ('leaf_rows_in_bounds', (SELECT count(*) FROM ({G_SQL}) JOIN ({L_SQL}) USING (leaf_id) WHERE x < min_x + 1))) t(\"check\", violations)")
def _(s, d):
    i = grid_index(s, d)
    bad = i.nodes.withColumn("min_x", F.when(F.col("is_leaf"), F.col("min_x") + 1).otherwise(F.col("min_x")))
    return Index(i.rows, bad, DIMS, BuildConfig(3)).validation().where("check in ('leaf_cardinality', 'leaf_rows_in_bounds')")


@query("embedding_box_query", "SELECT vec_id FROM embeddings WHERE " + " AND ".join(f"embedding[{i}] BETWEEN -0.3 AND 0.3" for i in range(1, 65)))
def _(s, d):
    return read(s, d, "embeddings").where(Box([-0.3] * 64, [0.3] * 64).match_array("embedding")).select("vec_id")


# --- planner ---------------------------------------------------------------------------------------------------------


def planned(s: SparkSession, d: str) -> Table:
    df = orders(s, d)
    dicts = {k: encoders.first_seen(df, k) for k in ("o_orderstatus", "o_orderpriority")}
    return Table(ORDERS, df, None, None, dicts, statistics_of(df, ORDERS, dicts, 31, 16))


@query("candidate_ratio_estimate", "SELECT round(ceil(100000 / (max(o_totalprice) - min(o_totalprice)) * count(*)) / count(*), 9) AS candidate_ratio FROM orders")
def _(s, d):
    return s.createDataFrame([(planned(s, d).explain([PRICE], Contract.ROW_IDS).candidate_ratio,)], "candidate_ratio double").select(F.round("candidate_ratio", 9).alias("candidate_ratio"))


@query("category_frequency", "SELECT o_orderstatus AS label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS ratio FROM orders GROUP BY 1")
def _(s, d):
    st = planned(s, d).statistics
    return s.createDataFrame([(k, n, n / st.rows) for k, n in st.frequencies["o_orderstatus"].items()], "label string, n long, ratio double").withColumn("ratio", F.round("ratio", 9))


_N = "(SELECT count(*) FROM orders)"
_CAND = f"(SELECT CAST(ceil(100000 / (max(o_totalprice) - min(o_totalprice)) * {_N}) AS BIGINT) FROM orders)"


_LEAVES = "(SELECT CAST(ceil(100000 / (max(o_totalprice) - min(o_totalprice)) * 16) AS BIGINT) FROM orders)"
_KEPT = "(CASE WHEN contract IN ('rows', 'visit_rows') THEN candidates ELSE 0 END)"


@query("plan_diagnostics", f"SELECT contract, candidates AS candidate_records, CASE WHEN 11 * candidates + leaves + ceil(leaves / 16 * 15) + {_KEPT} > 1.1 * (2 * {_N} + {_KEPT}) THEN 'flat_scan' ELSE 'traversal' END AS strategy, 2 * {_N} + {_KEPT} AS cost_flat FROM (SELECT unnest(['row_ids', 'rows', 'count', 'visit_row_ids', 'visit_rows']) AS contract, {_CAND} AS candidates, {_LEAVES} AS leaves)")
def _(s, d):
    t = planned(s, d)
    p = t.plan([PRICE])
    got = [choose(p, t.statistics, c) for c in Contract if c is not Contract.EXISTS]
    return s.createDataFrame([(c.contract, c.candidate_records, c.strategy, c.cost_flat) for c in got], "contract string, candidate_records long, strategy string, cost_flat long")


@query("selectivity_bucket", "SELECT o_orderstatus AS label, CASE WHEN count(*) / sum(count(*)) OVER () <= 0.15 THEN 'selective' WHEN count(*) / sum(count(*)) OVER () >= 0.5 THEN 'broad' ELSE 'moderate' END AS bucket FROM orders GROUP BY 1")
def _(s, d):
    t = planned(s, d)
    return s.createDataFrame([(k, t.explain([Predicate.equals("o_orderstatus", k)], Contract.COUNT).bucket) for k in t.dictionaries["o_orderstatus"].labels], "label string, bucket string")


@query("planned_rows", f"SELECT * FROM ({O_SQL}) WHERE {WHERE}")
def _(s, d):
    return clustered(s, d).rows([PRICE, STATUS], planned=True)


@query("planned_count", f"SELECT count(*) AS matches FROM orders WHERE {WHERE}")
def _(s, d):
    return clustered(s, d).count([PRICE, STATUS], planned=True)


@query("planned_exists", f"SELECT count(*) > 0 AS has_match FROM orders WHERE {WHERE}")
def _(s, d):
    return clustered(s, d).exists([PRICE, STATUS], planned=True)


NARROW = [Predicate.range("o_totalprice", 100000.0, 110000.0), Predicate.range("o_custkey", 1, 500)]
N_WHERE = "o_totalprice BETWEEN 100000 AND 110000 AND o_custkey BETWEEN 1 AND 500"


@query("planned_narrow_rows", f"SELECT * FROM ({O_SQL}) WHERE {N_WHERE}")
def _(s, d):
    return clustered(s, d).rows(NARROW, planned=True)


@query("flat_narrow_rows", f"SELECT * FROM ({O_SQL}) WHERE {N_WHERE}")
def _(s, d):
    return clustered(s, d).rows(NARROW)


@query("covered_count", "SELECT count(*) AS matches FROM orders WHERE o_totalprice BETWEEN 0 AND 300000")
def _(s, d):
    return clustered(s, d).count([Predicate.range("o_totalprice", 0.0, 300000.0)], planned=True)


#: A plan for each reason: (reason, strategy, rows, nodes, leaves, fields in the hierarchy, pending rows, predicates).
REASONS = [
    ("unsatisfiable_plan", "no_op", 1000, 31, 16, 2, 0, ((0, 10, 20), (0, 30, 40))), ("empty_index", "no_op", 0, 0, 0, 2, 0, ((0, 10, 20),)), ("no_candidates_estimated", "no_op", 1000, 31, 16, 2, 0, ((0, 200, 300),)),
    ("append_delta_scan", "hybrid", 1000, 31, 16, 2, 5, ((0, 10, 20),)), ("broad_categorical_equality", "flat_scan", 1000, 31, 16, 2, 0, (("c", "a"),)), ("high_dimensional_low_constraint_query", "flat_scan", 1000, 31, 16, 9, 0, ((0, 0, 30),)),
    ("broad_materialized_query", "flat_scan", 1000, 31, 16, 2, 0, ((0, 0, 90),)), ("broad_geometry", "flat_scan", 1000, 31, 16, 2, 0, ((0, 0, 90),)), ("adversarial_geometry", "flat_scan", 1000, 3, 2, 2, 0, ((0, 0, 15),)),
    ("selective_geometry", "traversal", 1000, 31, 16, 2, 0, ((0, 0, 10),)), ("moderate_geometry", "traversal", 1000, 3, 1, 2, 0, ((0, 0, 15),)), ("cost_model_override", "flat_scan", 1000, 31, 16, 2, 0, ((0, 0, 30),)),
    ("dimension_mismatch", "flat_scan", 1000, 31, 16, 1, 0, ((1, 0, 10),)),
]


@query("planner_reasons", "SELECT * FROM (VALUES " + ", ".join(f"('{r[0]}', '{r[1]}')" for r in REASONS) + ") t(reason, strategy)")
def _(s, d):
    out = []
    for wanted, _, rows, nodes, leaves, n, pending, asked in REASONS:
        schema = Schema([*[Field(f"f{i}", Kind.INTEGER) for i in range(max(n, 2))], Field("c", Kind.CATEGORY)])
        root = {f"f{i}": (0, 100) for i in range(n)} | ({"c": (0, 1)} if n == 2 else {})
        p = plan(schema, [Predicate.equals(*a) if len(a) == 2 else Predicate.range(*a) for a in asked])
        contract = {"broad_materialized_query": Contract.ROWS, "adversarial_geometry": Contract.EXISTS}.get(wanted, Contract.COUNT)
        got = choose(p, Statistics(rows, nodes, leaves, root if rows else {}, {"c": {"a": 900, "b": 100}}, {"c": ["a", "b"]}), contract, pending)
        out.append((got.reason, got.strategy))
    return s.createDataFrame(out, "reason string, strategy string")


# --- storage lifecycle -----------------------------------------------------------------------------------------------


def folder(s: SparkSession) -> str:
    """A new folder for a table: in the shared folder that the session names, else a temporary one of a local run."""
    import uuid

    named = s.conf.get("spark.checkpoint.dir", None) or s.sparkContext.getCheckpointDir()
    if not named and not s.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{named}/table-{uuid.uuid4().hex}" if named else f"file://{tempfile.mkdtemp(prefix='table-')}/t"


def archived(s: SparkSession, d: str, base: DataFrame | None = None) -> Archive:
    df = orders(s, d) if base is None else base
    return Archive.create(s, folder(s), df, ORDERS, ["o_totalprice", "o_custkey"], BuildConfig(max_leaf=2000, exact_rows=1_000_000))


_CLUSTERED: dict[tuple[str, str], Archive] = {}


def clustered(s: SparkSession, d: str) -> Table:
    """The orders as a clustered table, written once for each session and scale."""
    key = (s.sparkContext.applicationId, d)
    if key not in _CLUSTERED:
        _CLUSTERED[key] = archived(s, d)
    return _CLUSTERED[key].table()


@query("archive_roundtrip", O_SQL)
def _(s, d):
    a = archived(s, d)
    return Archive.load(s, a.root, check=True).table().scan()


@query("archive_pruned_query", f"SELECT * FROM ({O_SQL}) WHERE o_totalprice BETWEEN 100000 AND 110000 AND o_custkey BETWEEN 1 AND 500")
def _(s, d):
    return archived(s, d).table().rows([Predicate.range("o_totalprice", 100000.0, 110000.0), Predicate.range("o_custkey", 1, 500)], planned=True)


def lifecycle(s: SparkSession, d: str) -> Archive:
    """Base: ids with last digit below 8; pending: the rest; tombstones: ids divisible by 7."""
    every = orders(s, d)
    a = archived(s, d, every.where(F.pmod(ROW_ID, F.lit(10)) < 8))
    return a.put_delta(every.where(F.pmod(ROW_ID, F.lit(10)) >= 8)).put_tombstones(every.where(F.col(ROW_ID) % 7 == 0).select(ROW_ID))


@query("append_batch", O_SQL)
def _(s, d):
    every = orders(s, d)
    a = archived(s, d, every.where(F.pmod(ROW_ID, F.lit(10)) < 8))
    return maintenance.append(a, every.where(F.pmod(ROW_ID, F.lit(10)) >= 8)).table().scan()


@query("compact", f"SELECT * FROM ({O_SQL}) WHERE row_id % 7 <> 0 AND row_id % 10 < 8")
def _(s, d):
    a = maintenance.compact(lifecycle(s, d))
    return a.data().select(ROW_ID, *ORDERS.names)


@query("maintain_rebuild", f"SELECT * FROM ({O_SQL}) WHERE row_id % 7 <> 0")
def _(s, d):
    a, _ = maintenance.maintain(lifecycle(s, d), maintenance.Policy(1, 1, 1))
    return a.data().select(ROW_ID, *ORDERS.names)


@query("lifecycle_query", f"SELECT * FROM ({O_SQL}) WHERE {WHERE} AND row_id % 7 <> 0")
def _(s, d):
    return lifecycle(s, d).table().rows([PRICE, STATUS], planned=True)


@query("tombstone_merge", "SELECT o_orderkey AS row_id FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 5 = 0")
def _(s, d):
    every = orders(s, d)
    a = archived(s, d).put_tombstones(every.where(F.col(ROW_ID) % 7 == 0).select(ROW_ID)).put_tombstones(every.where(F.col(ROW_ID) % 5 == 0).select(ROW_ID))
    return a.tombstones()


@query("archive_counts", "SELECT count(*) FILTER (WHERE o_orderkey % 10 < 8) AS rows, count(*) FILTER (WHERE o_orderkey % 10 >= 8) AS delta_rows, count(*) FILTER (WHERE o_orderkey % 7 = 0) AS tombstones FROM orders")
def _(s, d):
    m = lifecycle(s, d).manifest
    return s.createDataFrame([(m.rows, m.delta_rows, m.tombstones)], "rows long, delta_rows long, tombstones long")


_IN = "SELECT o_orderkey AS k, 1 + o_custkey * 13 AS base_rows, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey % 2000 END AS pending_rows, o_custkey * 7 % 1500 AS tombstones FROM orders"


@query("maintenance_decision", f"SELECT *, tombstones * 10000 // base_rows AS tombstone_ratio, CASE WHEN pending_rows > 0 AND (tombstones >= 1024 OR tombstones * 10000 // base_rows >= 2500 OR pending_rows >= 1024) THEN 'rebuild' WHEN pending_rows > 0 THEN 'append' WHEN tombstones >= 1024 OR tombstones * 10000 // base_rows >= 2500 THEN 'compact' ELSE 'none' END AS action, CASE WHEN pending_rows > 0 AND (tombstones >= 1024 OR tombstones * 10000 // base_rows >= 2500) THEN 'append_and_compaction_reached' WHEN pending_rows >= 1024 THEN 'append_rows_reached' WHEN pending_rows > 0 THEN 'pending_rows' WHEN tombstones >= 1024 THEN 'tombstone_count_reached' WHEN tombstones * 10000 // base_rows >= 2500 THEN 'tombstone_ratio_reached' ELSE 'nothing_pending' END AS reason FROM ({_IN})")
def _(s, d):
    rows = read(s, d, "orders").selectExpr("o_orderkey AS k", "1 + o_custkey * 13 AS base_rows", "CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey % 2000 END AS pending_rows", "o_custkey * 7 % 1500 AS tombstones")
    return maintenance.decisions(rows, maintenance.Policy())


@query("content_hash_rows", "SELECT count(*) AS rows FROM orders")
def _(s, d):
    return content_hash(orders(s, d)).select("rows")


@query("content_hash_checks", "SELECT count(*) AS rows, true AS same_reordered, false AS same_changed, false AS same_doubled FROM orders")
def _(s, d):
    df = orders(s, d)
    variants = [df, df.orderBy(F.desc("o_totalprice")).repartition(3), df.withColumn("o_custkey", F.when(F.col(ROW_ID) == read(s, d, "orders").agg(F.min("o_orderkey")).first()[0], -1).otherwise(F.col("o_custkey"))), df.union(df)]
    (n, one), (_, again), (_, changed), (_, doubled) = (tuple(content_hash(x).first()) for x in variants)
    return s.createDataFrame([(n, one == again, one == changed, one == doubled)], "rows long, same_reordered boolean, same_changed boolean, same_doubled boolean")


@query("archive_integrity", "SELECT * FROM (VALUES ('intact', false), ('a section of other files', true), ('a changed manifest', true), ('another kind', true), ('another format', true)) t(\"case\", refused)")
def _(s, d):
    a = archived(s, d)
    text = a.manifest.to_json()
    cases = {"intact": text, "a section of other files": None, "a changed manifest": text.replace('"rows": ', '"rows": 1', 1), "another kind": _sealed(text, kind="other"), "another format": _sealed(text, format=99)}
    store, out = Store(s, a.root), []
    for name, body in cases.items():
        if body is None:
            s.range(1).write.mode("append").parquet(f"{a.root}/v=1/nodes")
        else:
            store.replace("manifest.json", body)
        try:
            Archive.load(s, a.root)
            out.append((name, False))
        except ArchiveError:
            out.append((name, True))
    return s.createDataFrame(out, "case string, refused boolean")


def _sealed(manifest: str, **changes) -> str:
    """A manifest with changes, under a right length and checksum."""
    body = json.loads(manifest)["body"] | changes
    raw = json.dumps(body, indent=1, sort_keys=True).encode()
    return json.dumps({"length": len(raw), "crc32": zlib.crc32(raw), "body": body})


@query("archive_sections", "SELECT * FROM (VALUES ('data', true), ('delta', true), ('manifest', true), ('nodes', true), ('tombstones', true)) t(section, held)")
def _(s, d):
    return lifecycle(s, d).footprint().select("section", ((F.col("bytes") > 0) & (F.col("files") > 0)).alias("held"))


@query("operation_history", "SELECT * FROM (VALUES (0, 'create', (SELECT count(*) FROM orders WHERE o_orderkey % 10 < 8)), (1, 'delta', (SELECT count(*) FROM orders WHERE o_orderkey % 10 >= 8)), (2, 'tombstones', (SELECT count(*) FROM orders WHERE o_orderkey % 7 = 0)), (3, 'rebuild', (SELECT count(*) FROM orders WHERE o_orderkey % 7 <> 0))) t(place, action, rows)")
def _(s, d):
    a, _ = maintenance.maintain(lifecycle(s, d), maintenance.Policy(1, 1, 1))
    return s.createDataFrame([(i, h["action"], h.get("rows_written", h.get("rows"))) for i, h in enumerate(a.manifest.history)], "place int, action string, rows long")


@query("several_pending_batches", f"SELECT * FROM ({O_SQL}) WHERE {WHERE}")
def _(s, d):
    every = orders(s, d)
    a = archived(s, d, every.where(F.pmod(ROW_ID, F.lit(10)) < 7))
    for k in (7, 8, 9):
        a = a.put_delta(every.where(F.pmod(ROW_ID, F.lit(10)) == k))
    return Archive.load(s, a.root).table().rows([PRICE, STATUS], planned=True)


@query("batch_file", f"SELECT * FROM ({O_SQL}) WHERE row_id % 10 >= 8")
def _(s, d):
    path = folder(s)
    write_batch(orders(s, d).where(F.pmod(ROW_ID, F.lit(10)) >= 8), path, ORDERS)
    return read_batch(s, path)[0]


@query("mapped_archive", f"SELECT * FROM ({O_SQL}) WHERE {N_WHERE}")
def _(s, d):
    m = DimensionMapping(ORDERS, [("o_custkey", (1,)), ("o_totalprice", (0, 2))])
    a = Archive.create(s, folder(s), orders(s, d), ORDERS, config=BuildConfig(max_leaf=2000), mapping=m)
    assert a.manifest.mapping == (("o_totalprice", (0, 2)), ("o_custkey", (1,)))
    return Archive.load(s, a.root).table().rows(NARROW, planned=True)


@query("load_comparison", f"SELECT true AS agreement, count(*) AS matched FROM orders WHERE {WHERE}")
def _(s, d):
    r = reports.compared_load(archived(s, d), [PRICE, STATUS], lambda: archived(s, d))
    return s.createDataFrame([(r["agreement"], r["matched"])], "agreement boolean, matched long")


@query("append_comparison", f"SELECT true AS agreement, count(*) AS matched FROM orders WHERE {WHERE}")
def _(s, d):
    every = orders(s, d)
    r = reports.compared_append(lambda: archived(s, d, every.where(F.pmod(ROW_ID, F.lit(10)) < 8)), every.where(F.pmod(ROW_ID, F.lit(10)) >= 8), [PRICE, STATUS])
    return s.createDataFrame([(r["agreement"], r["matched"])], "agreement boolean, matched long")


@query("compaction_comparison", f"SELECT true AS agreement, count(*) FILTER (WHERE {WHERE}) AS matched, count(*) AS rows FROM orders WHERE o_orderkey % 7 <> 0")
def _(s, d):
    r = reports.compared_compaction(lambda: archived(s, d), orders(s, d).where(F.col(ROW_ID) % 7 == 0).select(ROW_ID), [PRICE, STATUS])
    return s.createDataFrame([(r["agreement"], r["matched"], r["rows"])], "agreement boolean, matched long, rows long")


# --- CSV -------------------------------------------------------------------------------------------------------------


def csv_of(s: SparkSession, d: str, table: str) -> str:
    path = folder(s)
    read(s, d, table).coalesce(1).write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return path


@query("csv_infer_schema", "SELECT * FROM (VALUES ('n_nationkey', 'integer', false), ('n_name', 'text', false), ('n_regionkey', 'integer', false)) t(field, kind, nullable)")
def _(s, d):
    schema = csv.infer_schema(csv.read_strings(s, csv_of(s, d, "nation"), csv.CsvOptions()))
    return s.createDataFrame([(f.name, f.kind.value, f.nullable) for f in schema.fields], "field string, kind string, nullable boolean")


@query("csv_roundtrip", "SELECT CAST(n_nationkey AS BIGINT) AS row_id, CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
def _(s, d):
    df, _ = csv.read_csv(s, csv_of(s, d, "nation"), None, csv.CsvOptions(row_id="n_nationkey", kinds={"n_name": Kind.CATEGORY}))
    return df


@query("csv_generated_row_ids", "SELECT count(*) AS n, CAST(1 AS BIGINT) AS first, count(*) AS last FROM nation")
def _(s, d):
    df, _ = csv.read_csv(s, csv_of(s, d, "nation"))
    return df.agg(F.count("*").alias("n"), F.min(ROW_ID).alias("first"), F.max(ROW_ID).alias("last"))


@query("csv_to_archive", "SELECT CAST(r_regionkey AS BIGINT) AS row_id, CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region")
def _(s, d):
    df, schema = csv.read_csv(s, csv_of(s, d, "region"), None, csv.CsvOptions(row_id="r_regionkey", kinds={"r_name": Kind.CATEGORY}))
    return Archive.create(s, folder(s), df, schema, config=BuildConfig(2)).table().scan()


@query("csv_folder_by_name", "SELECT CAST(n_nationkey AS BIGINT) AS row_id, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
def _(s, d):
    """Two files of a folder, with their columns in different orders and one that only one file has."""
    path, df = folder(s), read(s, d, "nation")
    for k, (where, cols) in enumerate((("n_nationkey < 10", ["n_nationkey", "n_name", "n_regionkey"]), ("n_nationkey >= 10", ["n_regionkey", "extra", "n_nationkey", "n_name"]))):
        df.where(where).withColumn("extra", F.lit("x,y")).select(*cols).coalesce(1).write.option("header", True).csv(f"{path}/part={k}")
    return csv.read_csv(s, path, Schema([Field("n_name", Kind.CATEGORY), Field("n_regionkey", Kind.INTEGER)]), NATION_ID)[0]


@query("csv_report_with_metadata", "SELECT 'small' AS dataset, 8::BIGINT AS leaf_rows, b AS baseline, 6::BIGINT AS workloads, 360::BIGINT AS total FROM (SELECT unnest(['flat_scan', 'kd_tree', 'r_tree', 'index']) AS b)")
def _(s, d):
    path = folder(s)
    csv.write_csv(reports.with_metadata(reports.aggregated(reports.workload_metrics(s, False)).select("baseline", "workloads", "total"), {"dataset": "small", "leaf_rows": 8}), path)
    got = csv.read_strings(s, path, csv.CsvOptions())
    return got.select("dataset", F.col("leaf_rows").cast("long").alias("leaf_rows"), "baseline", *[F.col(c).cast("long").alias(c) for c in ("workloads", "total")])


@query("command_line_reports", "SELECT * FROM (VALUES ('aggregate', 4::BIGINT), ('workloads', 24), ('low_selectivity_gap', 2)) t(report, rows)")
def _(s, d):
    path = folder(s)
    cli.main(["--dataset", "small", "--output", path])
    return s.createDataFrame([(n, csv.read_strings(s, f"{path}/{n}", csv.CsvOptions()).count()) for n in ("aggregate", "workloads", "low_selectivity_gap")], "report string, rows long")


NATION = Schema([Field("n_nationkey", Kind.INTEGER), Field("n_name", Kind.CATEGORY), Field("n_regionkey", Kind.INTEGER)])
NATION_ID = csv.CsvOptions(row_id="n_nationkey")
N_SQL = "SELECT CAST(n_nationkey AS BIGINT) AS row_id, CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation"


def nation_csv(s: SparkSession, d: str, where: str, *cols: str) -> str:
    path = folder(s)
    df = read(s, d, "nation").where(where)
    (df.select(*cols) if cols else df).coalesce(1).write.option("header", True).csv(path)
    return path


def nation_archive(s: SparkSession, d: str) -> Archive:
    return csv_lifecycle.create(s, folder(s), nation_csv(s, d, "n_nationkey < 20"), NATION, NATION_ID, ["n_regionkey", "n_nationkey"], BuildConfig(4))


@query("csv_append", N_SQL)
def _(s, d):
    return csv_lifecycle.append(nation_archive(s, d), nation_csv(s, d, "n_nationkey >= 20"), NATION_ID).table().scan()


@query("csv_delta_and_tombstones", f"SELECT * FROM ({N_SQL}) WHERE row_id % 5 <> 0")
def _(s, d):
    a = csv_lifecycle.delta(nation_archive(s, d), nation_csv(s, d, "n_nationkey >= 20"), NATION_ID)
    return csv_lifecycle.tombstones(a, nation_csv(s, d, "n_nationkey % 5 = 0", "n_nationkey"), NATION_ID).table().scan()


@query("csv_maintain", f"SELECT * FROM ({N_SQL}) WHERE row_id % 5 <> 0")
def _(s, d):
    a, _ = csv_lifecycle.maintain(nation_archive(s, d), maintenance.Policy(1, 1, 1), nation_csv(s, d, "n_nationkey >= 20"), nation_csv(s, d, "n_nationkey % 5 = 0", "n_nationkey"), NATION_ID)
    return a.data().select(ROW_ID, *NATION.names)


@query("rebuild_plan", "SELECT count(*) FILTER (WHERE o_orderkey % 10 < 8) AS base_rows, count(*) FILTER (WHERE o_orderkey % 10 >= 8) AS appended, count(*) FILTER (WHERE o_orderkey % 7 = 0) AS removed, count(*) FILTER (WHERE o_orderkey % 7 <> 0) AS resulting_rows FROM orders")
def _(s, d):
    p = maintenance.planned_rewrite(lifecycle(s, d))
    return s.createDataFrame([(p.base_rows, p.appended, p.removed, p.resulting_rows)], "base_rows long, appended long, removed long, resulting_rows long")


@query("stream_into_delta", O_SQL)
def _(s, d):
    every = orders(s, d)
    a = archived(s, d, every.where(F.pmod(ROW_ID, F.lit(10)) < 8))
    path = folder(s)
    every.where(F.pmod(ROW_ID, F.lit(10)) >= 8).write.parquet(path)
    append_stream(s.readStream.schema(ORDERS.spark()).parquet(path), a.root, folder(s)).awaitTermination()
    return Archive.load(s, a.root).table().scan()


@query("archive_comparison", f"SELECT true AS agreement, count(*) AS matched, 'rebuild' AS action FROM ({O_SQL}) WHERE {WHERE} AND row_id % 7 <> 0")
def _(s, d):
    r = reports.compared_archive(lambda: lifecycle(s, d), [PRICE, STATUS], maintenance.Policy(1, 1, 1))
    return s.createDataFrame([(r["agreement"], r["matched"], r["action"])], "agreement boolean, matched long, action string")


@query("typed_comparison", f"SELECT true AS agreement, count(*) AS matched FROM ({O_SQL}) WHERE {WHERE}")
def _(s, d):
    r = reports.compared_typed(clustered(s, d), [PRICE, STATUS], 1)
    return s.createDataFrame([(r["agreement"], r["matched"])], "agreement boolean, matched long")


# --- generators, baselines, reports ----------------------------------------------------------------------------------


@query("clustered_points", "SELECT i AS row_id, i // 20 AS cluster, CAST((i // 20) * 50 + i % 20 AS DOUBLE) AS x, CAST((i // 20) * 50 + i % 20 AS DOUBLE) AS y FROM range(60) t(i)")
def _(s, d):
    return generators.clusters(s, *generators.SMALL).select(ROW_ID, "cluster", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))


@query("range_workloads", "SELECT * FROM (VALUES ('cluster_range_000', 0.0::DOUBLE, 5.0::DOUBLE), ('cluster_range_001', 50, 55), ('cluster_range_002', 100, 105), ('empty_far_range', 200, 220), ('full_dataset_range', -10, 130), ('cluster_boundary_range', 18, 52)) t(workload, low, high)")
def _(s, d):
    return s.createDataFrame([(n, b.low[0], b.high[0]) for n, b in generators.workloads(False)], "workload string, low double, high double")


_WL = "(SELECT i * 50.0 AS low, i * 50.0 + 5 AS high, 'cluster_range_00' || i AS workload FROM range(3) t(i) UNION ALL SELECT * FROM (VALUES (200.0, 220.0, 'empty_far_range'), (-10.0, 130.0, 'full_dataset_range'), (18.0, 52.0, 'cluster_boundary_range')) v)"
_PT = "(SELECT (i // 20) * 50 + i % 20 AS x FROM range(60) t(i))"


@query("workload_flat_scan", f"SELECT workload, (SELECT count(*) FROM {_PT} p WHERE p.x BETWEEN w.low AND w.high) AS matched FROM {_WL} w")
def _(s, d):
    p = generators.clusters(s, *generators.SMALL)
    out = None
    for n, b in generators.workloads(False):
        one = reports.flat_scan(p, DIMS, b).agg(F.lit(n).alias("workload"), F.count("*").alias("matched"))
        out = one if out is None else out.union(one)
    return out


#: Metrics that SQL can repeat: 60 workloads over the orders by customer group, as if of three baselines.
def metrics(s: SparkSession, d: str) -> DataFrame:
    base = read(s, d, "orders").groupBy((F.col("o_custkey") % 60).alias("w")).agg(F.count("*").alias("total"), F.count_if(F.col("o_custkey") % 7 < F.col("o_orderkey") % 8).alias("candidates"), F.count_if((F.col("o_custkey") % 7 < F.col("o_orderkey") % 8) & (F.col("o_custkey") % 3 == 0)).alias("matched"))
    b = base.withColumn("baseline", F.when(F.col("w") % 3 == 0, "index").when(F.col("w") % 3 == 1, "kd_tree").otherwise("r_tree"))
    return b.select("baseline", F.concat(F.lit("w"), F.col("w")).alias("workload"), "total", "candidates", "matched", (F.col("candidates") / F.col("total")).alias("candidate_ratio"))


_M = "(SELECT CASE w % 3 WHEN 0 THEN 'index' WHEN 1 THEN 'kd_tree' ELSE 'r_tree' END AS baseline, 'w' || w AS workload, total, candidates, matched, candidates / total AS candidate_ratio FROM (SELECT o_custkey % 60 AS w, count(*) AS total, count(*) FILTER (WHERE o_custkey % 7 < o_orderkey % 8) AS candidates, count(*) FILTER (WHERE o_custkey % 7 < o_orderkey % 8 AND o_custkey % 3 = 0) AS matched FROM orders GROUP BY 1))"


@query("aggregate_summary", f"SELECT baseline, count(*) AS workloads, CAST(sum(total) AS BIGINT) AS total, CAST(sum(candidates) AS BIGINT) AS candidates, CAST(sum(matched) AS BIGINT) AS matched, round(avg(candidate_ratio), 6) AS mean_ratio, round(sum(candidates) / sum(total), 6) AS weighted_ratio FROM {_M} GROUP BY 1")
def _(s, d):
    return reports.aggregated(metrics(s, d)).withColumns({"mean_ratio": F.round("mean_ratio", 6), "weighted_ratio": F.round("weighted_ratio", 6)})


_B = "CASE WHEN matched / total <= 0 THEN 'empty' WHEN matched / total <= 0.25 THEN 'low' WHEN matched / total <= 0.5 THEN 'medium' WHEN matched / total < 1 THEN 'high' ELSE 'full' END"
_BS = f"SELECT baseline, {_B} AS bucket, count(*) AS workloads, CAST(sum(candidates) AS BIGINT) AS candidates, CAST(sum(matched) AS BIGINT) AS matched, round(avg(candidate_ratio), 6) AS mean_ratio FROM {_M} GROUP BY 1, 2"


@query("bucketed_summary", f"SELECT *, CASE bucket WHEN 'empty' THEN 1 WHEN 'low' THEN 2 WHEN 'medium' THEN 3 WHEN 'high' THEN 4 ELSE 5 END AS place FROM ({_BS})")
def _(s, d):
    return reports.by_selectivity(metrics(s, d)).withColumn("mean_ratio", F.round("mean_ratio", 6))


@query("pruning_efficiency", f"SELECT workload, round(1 - candidate_ratio, 9) AS pruning_efficiency FROM {_M}")
def _(s, d):
    return reports.pruning(metrics(s, d)).select("workload", F.round("pruning_efficiency", 9).alias("pruning_efficiency"))


@query("low_gap", f"SELECT baseline, workloads, candidates, candidates - (SELECT candidates FROM ({_BS}) WHERE baseline = 'index' AND bucket = 'low') AS gap FROM ({_BS}) WHERE bucket = 'low' AND baseline IN ('kd_tree', 'r_tree') AND (SELECT count(*) FROM ({_BS}) WHERE baseline = 'index' AND bucket = 'low') > 0")
def _(s, d):
    return reports.low_selectivity_gap(metrics(s, d))


@query("top_ratio", f"SELECT baseline, round(sum(candidates) / sum(total), 6) AS weighted_ratio FROM {_M} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def _(s, d):
    return reports.top_ratio(metrics(s, d)).select("baseline", F.round("weighted_ratio", 6).alias("weighted_ratio"))


@query("baseline_footprints", "SELECT * FROM (VALUES ('kd_tree', 60::BIGINT, 15::BIGINT, 720::BIGINT), ('r_tree', 60, 5, 560)) t(baseline, rows, nodes, bytes)")
def _(s, d):
    p = generators.clusters(s, *generators.SMALL).drop("cluster")
    levels = reports.packed_levels(boxes.bounds(reports.packed_layout(p, DIMS), DIMS, ["leaf_id"]), DIMS)
    nodes = {"kd_tree": reports.kd_nodes(p, DIMS).count(), "r_tree": sum(x.count() for x in levels)}
    got = [reports.baseline_footprint(k, 60, n, 2) for k, n in nodes.items()]
    return s.createDataFrame([(g["baseline"], g["rows"], g["nodes"], g["bytes"]) for g in got], "baseline string, rows long, nodes long, bytes long")


@query("interleaved_timing", "SELECT * FROM (VALUES ('a', 5::BIGINT, true), ('b', 5, true)) t(run, calls, timed)")
def _(s, d):
    order: list[str] = []
    t = reports.measured({"a": lambda: order.append("a"), "b": lambda: order.append("b")}, iterations=4, warm_up=1)
    assert order == ["a", "b", *"abbaabba"]
    return s.createDataFrame([(k, order.count(k), t[k] >= 0) for k in t], "run string, calls long, timed boolean")


@query("lexicographic_sort", "SELECT vec_id, row_number() OVER (ORDER BY embedding, vec_id) AS place FROM embeddings")
def _(s, d):
    return ranked(read(s, d, "embeddings"), ["embedding", "vec_id"]).select("vec_id", (F.col("place") + 1).alias("place"))


@query("baselines_agree", f"SELECT b AS baseline, workload, (SELECT count(*) FROM {_PT} p WHERE p.x BETWEEN w.low AND w.high) AS matched FROM {_WL} w, (SELECT unnest(['flat_scan', 'kd_tree', 'r_tree', 'index']) AS b)")
def _(s, d):
    return reports.workload_metrics(s, False).select("baseline", "workload", "matched")


@query("packed_layout", f"SELECT leaf_id, count(*) AS cardinality, min(x) AS min_x, max(x) AS max_x FROM (SELECT x, (row_number() OVER (ORDER BY x, y, row_id) - 1) // 16 AS leaf_id FROM ({P_SQL})) GROUP BY 1")
def _(s, d):
    return boxes.bounds(reports.packed_layout(points(s, d), DIMS), ["x"], ["leaf_id"])


@query("kd_layout_query", f"SELECT row_id FROM ({P_SQL}) WHERE {R_SQL}")
def _(s, d):
    kd = reports.kd_layout(points(s, d), DIMS, 64)
    leaf = boxes.bounds(kd, DIMS, ["path"])
    return kd.join(leaf.where(REGION.coverage(DIMS) != "D").select("path"), "path", "left_semi").where(REGION.match(DIMS)).select(ROW_ID)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
