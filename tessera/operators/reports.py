"""Baseline layouts, workload comparisons and their summaries."""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.boxes import Box, bounds
from tessera.functions.ordering import ranges, ranked
from tessera.functions.schema import ROW_ID
from tessera.sources import generators
from tessera.sources.archive import Archive

from .index import Index
from .layout import BuildConfig, node_table, task_rows
from .maintenance import Policy, append, compact, maintain
from .predicates import Predicate
from .table import Table

#: Rows in a leaf and children of a node of the packed (R-tree) layout; rows in a leaf of the alternating (KD) layout.
PACK_LEAF, PACK_FAN, KD_LEAF = 16, 8, 8


def flat_scan(points: DataFrame, dims: list[str], region: Box) -> DataFrame:
    """Every row is looked at."""
    return points.where(region.match(dims))


def kd_group(rows: pa.Table, dims: list[str], leaf: int, bits: int) -> pa.Table:
    rows = rows.take(pc.sort_indices(rows, sort_keys=[(ROW_ID, "ascending")]))
    x = np.stack([rows.column(d).to_numpy().astype(np.float32) for d in dims], 1)
    top = format(rows.column("part")[0].as_py(), f"0{bits}b") if bits else ""
    name, of = [], np.empty(len(x), np.int32)
    todo = [("", np.arange(len(x), dtype=np.int32))]
    while todo:
        p, at = todo.pop()
        if len(at) <= leaf:
            of[at] = len(name)
            name.append(top + p)
            continue
        order = at[np.argsort(x[at, len(p) % len(dims)], kind="stable")]
        todo += [(p + "0", order[: len(at) // 2]), (p + "1", order[len(at) // 2 :])]
    return rows.drop_columns(["part"]).append_column("path", pa.array(name, pa.string()).take(pa.array(of)))


def kd_layout(points: DataFrame, dims: list[str], leaf: int = KD_LEAF, exact_rows: int = 1_000_000) -> DataFrame:
    """Rows with the path of their leaf: the axes take turns, each cut at the middle. Parts of up to `exact_rows` rows, and
    what a task may hold, are cut in one task; above that, by ranges of the first axis (ties by the others, then id), whose
    number begins the path."""
    kinds = dict(points.dtypes)
    schema = f"{ROW_ID} long, " + ", ".join(f"`{d}` {kinds[d]}" for d in dims) + ", path string"
    own = points.select(ROW_ID, *dims)
    n, most = task_rows(own, exact_rows)
    own, parts = ranges(own, [*dims, ROW_ID], "part", most) if n > most else (own.withColumn("part", F.lit(0)), 1)
    bits = (parts - 1).bit_length()
    return own.groupBy("part").applyInArrow(lambda rows: kd_group(rows, dims, leaf, bits), schema)


def packed_layout(points: DataFrame, dims: list[str], leaf: int = PACK_LEAF) -> DataFrame:
    """Rows with leaf_id: sorted by the first axis (ties by the others, then id), `leaf` rows each."""
    return ranked(points.select(ROW_ID, *dims), [*dims, ROW_ID]).select(ROW_ID, *dims, F.floor(F.col("place") / leaf).alias("leaf_id"))


def packed_levels(leaves: DataFrame, dims: list[str], fan: int = PACK_FAN) -> list[DataFrame]:
    """Box tables from the leaves up to the root; a node of a level holds `fan` of the one below."""
    levels = [leaves]
    while levels[-1].count() > 1:
        up = levels[-1].withColumn("leaf_id", F.floor(F.col("leaf_id") / fan))
        levels.append(up.groupBy("leaf_id").agg(F.sum("cardinality").alias("cardinality"), *[F.min(f"min_{d}").alias(f"min_{d}") for d in dims], *[F.max(f"max_{d}").alias(f"max_{d}") for d in dims]))
    return levels


def baseline_footprint(name: str, rows: int, nodes: int, dims: int) -> dict:
    """Scalars that a layout keeps beside the rows."""
    return {"baseline": name, "rows": rows, "nodes": nodes, "point_scalars": rows * dims, "bounds_scalars": 2 * nodes * dims, "bytes": 4 * (rows * dims + 2 * nodes * dims)}


def workload_metrics(spark: SparkSession, large: bool) -> DataFrame:
    """(baseline, workload, total, candidates, matched, candidate_ratio) of the generated workloads, for a flat scan and the
    KD, packed and box-hierarchy layouts. Candidates are rows of leaves that a query meets."""
    count, size, spacing, step = generators.LARGE if large else generators.SMALL
    points = generators.clusters(spark, count, size, spacing, step).drop("cluster").persist()
    dims = ["x", "y"]
    total = count * size
    kd = kd_layout(points, dims)
    tables = {
        "kd_tree": bounds(kd, dims, ["path"]),
        "r_tree": bounds(packed_layout(points, dims), dims, ["leaf_id"]),
        "index": Index.build(points, dims, BuildConfig(8, 16 if large else 8)).leaves,
    }
    out = None
    for name, region in generators.workloads(large):
        got = flat_scan(points, dims, region).agg(F.count("*").alias("matched"))
        parts = {"flat_scan": points.agg(F.count("*").alias("candidates")), **{k: t.where(region.coverage(dims) != "D").agg(F.coalesce(F.sum("cardinality"), F.lit(0)).alias("candidates")) for k, t in tables.items()}}
        for k, c in parts.items():
            one = c.join(got).select(F.lit(k).alias("baseline"), F.lit(name).alias("workload"), F.lit(total).cast("long").alias("total"), F.col("candidates").cast("long"), "matched", (F.col("candidates") / total).alias("candidate_ratio"))
            out = one if out is None else out.union(one)
    return out


def selectivity(ratio: Column) -> Column:
    """Bucket of a candidate ratio."""
    return F.when(ratio <= 0, "empty").when(ratio <= 0.25, "low").when(ratio <= 0.5, "medium").when(ratio < 1, "high").otherwise("full")


#: Buckets in their fixed order.
BUCKETS = ("empty", "low", "medium", "high", "full")


def pruning(metrics: DataFrame) -> DataFrame:
    return metrics.withColumn("pruning_efficiency", 1 - F.col("candidate_ratio"))


def aggregated(metrics: DataFrame) -> DataFrame:
    """Sums, mean ratio and weighted ratio over the workloads of each baseline."""
    return metrics.groupBy("baseline").agg(
        F.count("*").alias("workloads"), F.sum("total").alias("total"), F.sum("candidates").alias("candidates"), F.sum("matched").alias("matched"), F.avg("candidate_ratio").alias("mean_ratio"),
        (F.sum("candidates") / F.sum("total")).alias("weighted_ratio"),
    )


def by_selectivity(metrics: DataFrame) -> DataFrame:
    """The same for each bucket that occurs; `place` is the bucket's fixed order."""
    b = selectivity(F.col("matched") / F.col("total"))
    return metrics.withColumn("bucket", b).groupBy("baseline", "bucket").agg(F.count("*").alias("workloads"), F.sum("candidates").alias("candidates"), F.sum("matched").alias("matched"), F.avg("candidate_ratio").alias("mean_ratio")).withColumn("place", F.array_position(F.array(*map(F.lit, BUCKETS)), F.col("bucket")).cast("int"))


def low_selectivity_gap(metrics: DataFrame) -> DataFrame:
    """Tree baselines against the hierarchy in the low bucket: candidates more or less; null if it has no workload there."""
    low = by_selectivity(metrics).where("bucket = 'low'")
    own = low.where("baseline = 'index'").select("bucket", F.col("candidates").alias("own"))
    return low.where("baseline in ('kd_tree', 'r_tree')").join(own, "bucket", "left").select("baseline", "workloads", "candidates", (F.col("candidates") - F.col("own")).alias("gap"))


def top_ratio(metrics: DataFrame) -> DataFrame:
    """The baseline with the highest weighted ratio; of equal ones the first by name."""
    return aggregated(metrics).orderBy(F.desc("weighted_ratio"), "baseline").limit(1)


def lexicographic(points: DataFrame, col: str) -> DataFrame:
    """Points in lexicographic order, shorter first."""
    return points.orderBy(col)


def measured(runs: dict[str, Callable[[], object]], iterations: int = 3, warm_up: int = 1) -> dict[str, float]:
    """Mean seconds of each run; the order alternates from round to round."""
    for f in runs.values():
        for _ in range(warm_up):
            f()
    spent = dict.fromkeys(runs, 0.0)
    for i in range(iterations):
        for k in list(runs) if i % 2 == 0 else list(reversed(runs)):
            t = time.perf_counter()
            runs[k]()
            spent[k] += time.perf_counter() - t
    return {k: v / iterations for k, v in spent.items()}


def compared(index: Index, points: DataFrame, region: Box, iterations: int = 3) -> dict:
    """One workload: all contracts must agree with a flat scan; then times and their ratio (flat / index)."""
    want = sorted(map(tuple, flat_scan(points, index.dims, region).select(*index.dims).collect()))
    refs = index.references(region)
    agree = sorted(map(tuple, index.points(region).collect())) == want == sorted(map(tuple, index.dereference(refs).select(*index.dims).collect())) and index.count(region).first()[0] == len(want) and index.exists(region) == bool(want)
    t = measured({"flat": lambda: flat_scan(points, index.dims, region).count(), "index": lambda: index.count(region).collect()}, iterations)
    return {"agreement": agree, "matched": len(want), "flat_seconds": t["flat"], "index_seconds": t["index"], "timing_ratio": t["flat"] / t["index"] if t["index"] else float("inf")}


def kd_nodes(points: DataFrame, dims: list[str]) -> DataFrame:
    return node_table(kd_layout(points, dims), dims)


# --- typed and archive comparisons -----------------------------------------------------------------------------------


def compared_typed(table: Table, asked: list[Predicate], iterations: int = 3) -> dict:
    """A typed query with and without the planner: equal answers under each contract, and times."""
    flat = sorted(r[0] for r in table.row_ids(asked).collect())
    plan = sorted(r[0] for r in table.row_ids(asked, planned=True).collect())
    agree = flat == plan and table.count(asked, planned=True).first()[0] == len(flat) and table.exists(asked, planned=True).first()[0] == bool(flat)
    t = measured({"flat": lambda: table.count(asked).collect(), "planned": lambda: table.count(asked, planned=True).collect()}, iterations)
    e = measured({"flat": lambda: table.exists(asked).collect(), "planned": lambda: table.exists(asked, planned=True).collect()}, iterations)
    return {"agreement": agree, "matched": len(flat), "flat_seconds": t["flat"], "planned_seconds": t["planned"], "exists_flat_seconds": e["flat"], "exists_planned_seconds": e["planned"]}


def compared_archive(make: Callable[[], Archive], asked: list[Predicate], policy: Policy) -> dict:
    """Load, pending-delta query, maintenance: the answer must be the same before and after; with the time of each."""
    a = make()
    seconds = {}

    def stopped(name: str, f: Callable[[], object]) -> object:
        out, seconds[name] = timed(f)
        return out

    loaded = stopped("load", lambda: Archive.load(a.spark, a.root, check=True))
    before = stopped("query_before", lambda: sorted(r[0] for r in loaded.table().row_ids(asked).collect()))
    after, decision = stopped("maintain", lambda: maintain(loaded, policy))
    got = stopped("query_after", lambda: sorted(r[0] for r in after.table().row_ids(asked).collect()))
    return {"agreement": before == got, "matched": len(got), "action": decision.action, "reason": decision.reason, **{f"{k}_seconds": v for k, v in seconds.items()}}


def timed(f: Callable[[], object]) -> tuple[object, float]:
    t = time.perf_counter()
    out = f()
    return out, time.perf_counter() - t


def compared_load(archive: Archive, asked: list[Predicate], rebuild: Callable[[], Archive]) -> dict:
    """Opening a stored table against building it again: equal answers, and the seconds of each."""
    want = sorted(r[0] for r in archive.table().row_ids(asked).collect())
    loaded, load = timed(lambda: Archive.load(archive.spark, archive.root))
    built, build = timed(rebuild)
    got = [sorted(r[0] for r in x.table().row_ids(asked, planned=True).collect()) for x in (loaded, built)]
    return {"agreement": got == [want, want], "matched": len(want), "load_seconds": load, "build_seconds": build}


def compared_append(make: Callable[[], Archive], batch: DataFrame, asked: list[Predicate]) -> dict:
    """A pending batch against a rebuild with it: equal answers, and the seconds of writing and asking each way."""
    pending, put = timed(lambda: make().put_delta(batch))
    rebuilt, build = timed(lambda: append(make(), batch))
    got, seconds = zip(*(timed(lambda x=x: sorted(r[0] for r in x.table().row_ids(asked, planned=True).collect())) for x in (pending, rebuilt)), strict=True)
    return {"agreement": got[0] == got[1], "matched": len(got[0]), "delta_seconds": put, "rebuild_seconds": build, "delta_query_seconds": seconds[0], "rebuilt_query_seconds": seconds[1]}


def compared_compaction(make: Callable[[], Archive], ids: DataFrame, asked: list[Predicate]) -> dict:
    """A table with tombstones against itself compacted: equal answers, rows kept, and the seconds of asking each."""
    before, put = timed(lambda: make().put_tombstones(ids))
    want, query = timed(lambda: sorted(r[0] for r in before.table().row_ids(asked).collect()))
    after, seconds = timed(lambda: compact(before))
    got, compacted = timed(lambda: sorted(r[0] for r in after.table().row_ids(asked, planned=True).collect()))
    return {"agreement": want == got, "matched": len(got), "rows": after.manifest.rows, "tombstone_seconds": put, "compact_seconds": seconds, "query_seconds": query, "compacted_query_seconds": compacted}


def with_metadata(report: DataFrame, metadata: dict) -> DataFrame:
    """A report with what it was made from in columns before it, the same in every row."""
    return report.select(*[F.lit(v).alias(k) for k, v in metadata.items()], "*")


def footprint_comparison(one: dict, other: dict) -> dict:
    """Two footprints side by side: `other` as a multiple of `one`."""
    return {f"{k}_ratio": (other[k] / one[k] if one[k] else float("inf")) for k in one if isinstance(one[k], (int, float)) and k in other}
