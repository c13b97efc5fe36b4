"""Building the box hierarchy that a table is clustered by.

Coarse phase: nodes above `exact_rows` rows or `TASK_BYTES` are cut into up to `FAN` parts a round, at medians of the
widest-spread dimension of a sample of their rows. One task a node makes its cuts; they come to the rows as arrays by a join
on the node, and one expression of constant size walks them, a step for each of their levels. Rows that are equal in all
dimensions are cut by a hash of their id, so that no part is larger than a task. The number of rounds is the logarithm of the
table's size; the driver holds no tree.
Exact phase: each remaining node goes to one task, which applies the split rules below to the end. A node's path of 0s and
1s names it; nodes are numbered in pre-order, which is the order of paths.

Split rules: on each axis rows are sorted (ties by row id); the cut is the widest gap if it stands out from the others,
else the middle. Of the axes the one with the least child volume wins, then least overlap of the children, largest volume
reduction, least child extent, largest extent reduction, best balance, largest variance, lowest axis.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import boxes
from tessera.functions.schema import ROW_ID

#: A gap stands out if it is so many times the lower median of the positive gaps.
DOMINANCE = 4.0
#: Bytes of rows that a task splits at most, about: a worker's memory is some multiple of it, whatever the table's size.
TASK_BYTES = 8 << 20
#: Parts that a coarse node is cut into in one round, and sampled rows for each.
FAN, SAMPLED = 1024, 64
#: In place of an axis: no cut; cut by a hash of the row id.
LEAF, BY_ID = -1, -2
#: Cut nodes are broadcast to the rows up to so many, by count.
BROADCAST_NODES = 100_000


@dataclass(frozen=True)
class BuildConfig:
    """Splitting stops at `target_leaf` rows or at `max_depth`; between target and `max_leaf` rows a split must reduce
    the volume (or, of a flat box, the extent). Leaves of 10^5 to 10^6 rows suit Parquet row groups."""

    max_leaf: int = 64
    max_depth: int = 32
    target_leaf: int | None = None
    exact_rows: int = 1_000_000

    def __post_init__(self):
        if self.max_leaf < 1 or self.max_depth < 0:
            raise ValueError("a leaf holds a row at least, and depth isn't negative")
        if self.target_leaf is not None and not 1 <= self.target_leaf <= self.max_leaf:
            raise ValueError("the target leaf size lies between 1 and the largest")

    @property
    def target(self) -> int:
        return self.target_leaf or self.max_leaf


@dataclass(frozen=True)
class Split:
    axis: int
    cut: int
    order: np.ndarray
    score: tuple
    reduces: bool


def cut_of(values: np.ndarray) -> int:
    """Where to cut sorted values: the dominant gap (of equal ones the nearest to the middle), else the middle."""
    middle = len(values) // 2
    gaps = np.diff(values)
    widest = gaps.max()
    positive = np.sort(gaps[gaps > 0])
    if not len(positive) or (len(positive) > 1 and widest < DOMINANCE * positive[(len(positive) - 1) // 2]):
        return middle
    at = np.flatnonzero(gaps == widest) + 1
    return int(at[np.argmin(np.abs(at - middle))])


def box_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x.min(0).astype(np.float64), x.max(0).astype(np.float64)


def measures(box: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    side = box[1] - box[0]
    return float(np.prod(side)), float(side.sum())


def reduction(parent: float, children: float) -> float:
    return (parent - children) / parent if parent > 0 else 0.0


def split_on(x: np.ndarray, axis: int, gaps: bool = True) -> Split:
    """The split of rows x on an axis, with its score (smaller is better)."""
    order = np.argsort(x[:, axis], kind="stable")
    cut = cut_of(x[order, axis]) if gaps else len(x) // 2
    whole, left, right = box_of(x), box_of(x[order[:cut]]), box_of(x[order[cut:]])
    (v, e), (lv, le), (rv, re_) = measures(whole), measures(left), measures(right)
    shared = np.minimum(left[1], right[1]) - np.maximum(left[0], right[0])
    meet = 0.0 if (shared < 0).any() else float(shared.sum())
    by_volume, by_extent = reduction(v, lv + rv), reduction(e, le + re_)
    score = (lv + rv, meet, -by_volume, le + re_, -by_extent, abs(len(x) - 2 * cut), -float(x[:, axis].astype(np.float64).var()), axis)
    return Split(axis, cut, order, score, by_volume > 0 or (v == 0 and by_extent > 0))


def best_split(x: np.ndarray, gaps: bool = True) -> Split:
    return min((split_on(x, a, gaps) for a in range(x.shape[1])), key=lambda s: s.score)


def split_tree(x: np.ndarray, config: BuildConfig, depth: int = 0) -> list[tuple[str, np.ndarray]]:
    """Leaves (path, rows in order) of the tree over rows x, in document order."""
    out: list[tuple[str, np.ndarray]] = []
    todo = [("", np.arange(len(x)), depth)]
    while todo:
        path, rows, level = todo.pop()
        if len(rows) > config.target and level < config.max_depth and len(rows) > 1:
            s = best_split(x[rows])
            if len(rows) > config.max_leaf or s.reduces:
                todo.append((path + "1", rows[s.order[s.cut :]], level + 1))
                todo.append((path + "0", rows[s.order[: s.cut]], level + 1))
                continue
        out.append((path, rows))
    return out


def split_group(rows: pa.Table, dims: list[str], config: BuildConfig) -> pa.Table:
    """The rows of a coarse node, leaf by leaf, with their leaf's path and their place in it."""
    rows = rows.take(pc.sort_indices(rows, sort_keys=[(ROW_ID, "ascending")]))
    top = rows.column("path")[0].as_py()
    x = np.stack([rows.column(d).to_numpy().astype(np.float32) for d in dims], 1)
    leaves = split_tree(x, config, len(top))
    order, size = np.concatenate([r for _, r in leaves]), [len(r) for _, r in leaves]
    path = pa.array(np.repeat(np.array([top + p for p, _ in leaves], object), size), pa.string())
    place = np.concatenate([np.arange(n) for n in size])
    rows = rows.take(order).drop_columns(["path"])
    return rows.append_column("path", path).append_column("row_index", pa.array(place))


def cuts_of(x: np.ndarray, share: float, config: BuildConfig, depth: int, fan: int) -> dict[str, list | bool]:
    """Cuts of a coarse node from a sample of its rows, `share` of them all: per node its axis, cut, child on the left
    (the one on the right follows it; a leaf is its own) and path below this node; and `more`: whether parts may be left that
    are too large, as the fan was used up or hashes of ids made them."""
    axis, cut, left, name, more = [LEAF], [0.0], [0], [""], False
    # a sample may miss some of a node's rows
    large = lambda n, node: (n + (3 * n**0.5 if share < 1 else 0)) / share > config.exact_rows and depth + len(name[node]) < config.max_depth
    todo = [(len(x), 0, np.arange(len(x)))]
    while todo and len(axis) < 2 * fan:
        todo.sort(key=lambda t: -t[0])
        n, node, rows = todo.pop(0)
        if not large(n, node):
            continue
        values = x[rows]
        d = int(values.var(0).argmax())
        one = np.unique(values[:, d])
        if len(one) > 1:
            middle = float(np.median(values[:, d]))
            middle = middle if middle > one[0] else float(one[1])
            low = values[:, d] < middle
            parts = [rows[low], rows[~low]]
            sizes = [len(parts[0]), len(parts[1])]
        else:
            d, middle, parts, sizes, more = BY_ID, 0.0, [rows, rows], [n / 2, n / 2], True
        axis[node], cut[node], left[node] = d, middle, len(axis)
        for k in (0, 1):
            todo.append((sizes[k], len(axis), parts[k]))
            axis.append(LEAF)
            cut.append(0.0)
            left.append(len(axis) - 1)
            name.append(name[node] + str(k))
    return {"axis": axis, "cut": cut, "left": left, "name": name, "more": more or any(large(n, node) for n, node, _ in todo)}


CUTS = "path string, __axis array<int>, __cut array<double>, __left array<int>, __name array<string>, __more boolean"


def task_rows(df: DataFrame, most: int) -> tuple[int, int]:
    """Rows of df, and how many of them a task may hold: `most`, and TASK_BYTES by their average width."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    wide = sum((F.coalesce(F.octet_length(f"`{n}`"), F.lit(0)) for n in text), F.lit(8 * len(df.columns)))
    n, size = df.agg(F.count("*"), F.coalesce(F.sum(wide.cast("long")), F.lit(0))).first()
    return n, max(1, min(most, TASK_BYTES * n // max(size, 1)))


def coarse_paths(points: DataFrame, dims: list[str], config: BuildConfig) -> DataFrame:
    """points with `path`, the coarse node of each row."""
    total, most = task_rows(points, config.exact_rows)
    points = points.withColumn("path", F.lit(""))
    if total <= most:
        return points
    config = replace(config, exact_rows=most)
    before = -1
    while True:
        large = points.groupBy("path").agg(F.count("*").alias("__n")).where(F.col("__n") > config.exact_rows).where(F.length("path") < config.max_depth)
        nodes, rows = (1, total) if before == -1 else large.agg(F.count("*"), F.coalesce(F.sum("__n"), F.lit(0))).first()
        if not nodes or (nodes, rows) == before:
            return points
        before = (nodes, rows)
        small = F.broadcast if nodes <= BROADCAST_NODES else lambda df: df
        share = F.least(F.lit(1.0), F.lit(float(FAN * SAMPLED)) / F.col("__n"))
        drawn = points.join(small(large.withColumn("__share", share).drop("__n")), "path")
        drawn = drawn.where(F.pmod(F.xxhash64(ROW_ID, F.lit(11)), F.lit(1 << 30)) < F.col("__share") * (1 << 30)).select("path", "__share", *[F.col(d).cast("double").alias(d) for d in dims])

        def cut(sample: pa.Table) -> pa.Table:
            x = np.stack([sample.column(d).to_numpy() for d in dims], 1)
            top = sample.column("path")[0].as_py()
            got = {"path": top} | {f"__{k}": v for k, v in cuts_of(x, sample.column("__share")[0].as_py(), config, len(top), FAN).items()}
            return pa.Table.from_pylist([got], schema=pa.schema([("path", pa.string()), ("__axis", pa.list_(pa.int32())), ("__cut", pa.list_(pa.float64())), ("__left", pa.list_(pa.int32())), ("__name", pa.list_(pa.string())), ("__more", pa.bool_())]))

        # a row for each node that is cut
        cuts = drawn.repartition(min(nodes, FAN), "path").groupBy("path").applyInArrow(cut, CUTS).persist()
        levels, more = cuts.agg(F.coalesce(F.max(F.array_max(F.transform("__name", F.length))), F.lit(0)), F.coalesce(F.max("__more"), F.lit(True))).first()
        value = F.array(*[F.col(d).cast("double") for d in dims])
        axis = lambda node: F.get("__axis", node)
        by_id = lambda i: F.pmod(F.call_function("shiftright", F.xxhash64(ROW_ID, F.lit(13)), i), F.lit(2)) == 1
        # no axis: a leaf, which stays where it is, or a cut by id
        right = lambda node, i: F.coalesce(F.get(value, axis(node)) >= F.get("__cut", node), (axis(node) == BY_ID) & by_id(i))
        node = F.aggregate(F.sequence(F.lit(0), F.lit(levels)), F.lit(0), lambda node, i: F.get("__left", node) + right(node, i).cast("int"))
        points = points.join(small(cuts), "path", "left").withColumn("path", F.when(F.col("__axis").isNull(), F.col("path")).otherwise(F.concat("path", F.get("__name", node)))).select(*points.columns)
        if not more:
            return points


def cluster(points: DataFrame, dims: list[str], config: BuildConfig) -> DataFrame:
    """points(row_id, dims, ..) with the path of each row's leaf and its place in it, row_index."""
    if not points.take(1):
        raise ValueError("an index needs a row at least")
    coarse = coarse_paths(points, dims, config)
    schema = T.StructType([*points.schema.fields, T.StructField("path", T.StringType()), T.StructField("row_index", T.LongType())])
    return coarse.groupBy("path").applyInArrow(lambda rows: split_group(rows, dims, config), schema)


def node_table(clustered: DataFrame, dims: list[str]) -> DataFrame:
    """Nodes (node_id, path, parent_id, depth, is_leaf, cardinality, min_/max_/c_<dim>) of clustered rows.

    Leaves come from one aggregate over the rows; inner nodes from the leaves alone."""
    leaf = clustered.groupBy("path").agg(F.count("*").alias("cardinality"), *[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("min", F.min), ("max", F.max))], *[F.sum(F.col(d).cast("double")).alias(f"sum_{d}") for d in dims])
    up = leaf.withColumn("leaf", F.col("path")).withColumn("k", F.explode(F.sequence(F.lit(0), F.length("path")))).withColumn("path", F.expr("substring(leaf, 1, k)"))
    nodes = up.groupBy("path").agg(F.sum("cardinality").alias("cardinality"), F.max(F.col("path") == F.col("leaf")).alias("is_leaf"), *[F.min(f"min_{d}").alias(f"min_{d}") for d in dims], *[F.max(f"max_{d}").alias(f"max_{d}") for d in dims], *[(F.sum(f"sum_{d}") / F.sum("cardinality")).alias(f"c_{d}") for d in dims])
    # one partition: there are as few nodes as leaves, not rows
    numbered = nodes.withColumn("node_id", F.row_number().over(Window.orderBy("path")) - 1)
    parent = numbered.select(F.col("path").alias("parent_path"), F.col("node_id").alias("parent_id"))
    return numbered.withColumn("parent_path", F.when(F.col("path") != "", F.expr("substring(path, 1, length(path) - 1)"))).join(parent, "parent_path", "left").withColumn("depth", F.length("path")).drop("parent_path")


# --- single splits and their measures, as relational plans -----------------------------------------------------------


def ranked(df: DataFrame, axis: str, by: list[str], tie: str = ROW_ID) -> DataFrame:
    """Rows with rn (0-based place on the axis), n and the gap before them, within each group."""
    w = Window.partitionBy(*by).orderBy(axis, tie)
    gap = F.col(axis).cast("double") - F.lag(F.col(axis).cast("double")).over(w)
    return df.withColumns({"rn": F.row_number().over(w) - 1, "n": F.count("*").over(Window.partitionBy(*by)), "gap": gap})


def structural_cuts(df: DataFrame, axis: str, by: list[str], tie: str = ROW_ID) -> DataFrame:
    """(by, n, middle, cut) of each group on one axis, without gathering a group."""
    r = ranked(df, axis, by, tie)
    middle = F.floor(F.col("n") / 2).cast("int")
    far = F.abs(F.col("rn") - middle)
    agg = r.where("rn > 0").groupBy(*by, "n").agg(
        F.max("gap").alias("widest"),
        F.max_by("rn", F.struct("gap", -far, -F.col("rn"))).alias("at"),
        F.expr("percentile_disc(0.5) within group (order by gap) filter (where gap > 0)").alias("usual"),
        F.count_if(F.col("gap") > 0).alias("positive"),
    )
    stands = (F.col("positive") == 1) | ((F.col("positive") > 1) & (F.col("widest") >= DOMINANCE * F.col("usual")))
    return agg.select(*by, "n", middle.alias("middle"), F.when(stands, F.col("at")).otherwise(middle).alias("cut"))


def split_quality(df: DataFrame, dims: list[str], side: Column, by: list[str]) -> DataFrame:
    """Measures of a split of each group by `side` (true: left child)."""
    aggs = []
    for tag, cond in (("p_", F.lit(True)), ("l_", side), ("r_", ~side)):
        aggs.append(F.count_if(cond).alias(f"{tag}cardinality"))
        for d in dims:
            aggs += [F.min(F.when(cond, F.col(d))).alias(f"{tag}min_{d}"), F.max(F.when(cond, F.col(d))).alias(f"{tag}max_{d}")]
    g = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    volume = lambda t: F.coalesce(boxes.volume(dims, t), F.lit(0.0))
    size = lambda t: F.coalesce(boxes.extent(dims, t), F.lit(0.0))
    shrink = lambda p, c: F.when(p > 0, (p - c) / p).otherwise(0.0)
    cv, ce = volume("l_") + volume("r_"), size("l_") + size("r_")
    return g.select(
        *by, volume("p_").alias("parent_volume"), cv.alias("child_volume"), shrink(volume("p_"), cv).alias("volume_reduction"), size("p_").alias("parent_extent"), ce.alias("child_extent"),
        shrink(size("p_"), ce).alias("extent_reduction"), F.col("l_cardinality").alias("left_rows"), F.col("r_cardinality").alias("right_rows"), F.abs(F.col("l_cardinality") - F.col("r_cardinality")).alias("balance_penalty"),
        boxes.overlap(dims, "l_", "r_").alias("overlap"),
    )


def structure_metrics(leaves: DataFrame, dims: list[str]) -> DataFrame:
    """One row over the leaf table: counts, sizes, volume, density, flat leaves."""
    v = boxes.volume(dims)
    total = F.sum(v)
    return leaves.agg(
        F.count("*").alias("leaf_count"), F.min("cardinality").alias("min_cardinality"), F.max("cardinality").alias("max_cardinality"), F.avg("cardinality").alias("avg_cardinality"), total.alias("total_volume"),
        F.when(total > 0, F.sum("cardinality") / total).when(F.sum("cardinality") > 0, F.lit(float("inf"))).otherwise(0.0).alias("density"), F.count_if(v == 0).alias("zero_volume_leaves"),
    )


def sibling_overlap(nodes: DataFrame, dims: list[str]) -> DataFrame:
    """One row over all pairs of siblings."""
    cols = [f"{n}_{d}" for d in dims for n in ("min", "max")]
    side = lambda t: nodes.where("parent_id is not null").select("parent_id", F.col("node_id").alias(f"{t}id"), *[F.col(c).alias(f"{t}{c}") for c in cols])
    o = boxes.overlap(dims, "a_", "b_")
    pairs = side("a_").join(side("b_"), "parent_id").where("a_id < b_id")
    return pairs.agg(F.count("*").alias("sibling_pairs"), F.count_if(o > 0).alias("overlapping_pairs"), F.coalesce(F.sum(o), F.lit(0.0)).alias("total_overlap"), F.coalesce(F.avg(o), F.lit(0.0)).alias("average_overlap"))


def footprint(nodes: DataFrame, dims: int) -> DataFrame:
    """Scalars and bytes (single precision) of the numeric layer."""
    rows = F.coalesce(F.sum(F.when(F.col("is_leaf"), F.col("cardinality"))), F.lit(0))
    n = F.count("*")
    out = nodes.agg(rows.alias("rows"), n.alias("node_count")).select("rows", "node_count", (F.col("rows") * dims).alias("residual_scalars"), (F.col("node_count") * dims).alias("centroid_scalars"), (F.col("node_count") * 2 * dims).alias("bounds_scalars"))
    total = F.col("residual_scalars") + F.col("centroid_scalars") + F.col("bounds_scalars")
    return out.withColumns({"total_scalars": total, "total_bytes": 4 * total, "raw_bytes": 4 * F.col("residual_scalars"), "overhead_ratio": F.when(F.col("residual_scalars") > 0, total / F.col("residual_scalars")).otherwise(0.0)})
