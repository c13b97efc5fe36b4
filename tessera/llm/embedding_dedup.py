"""Operator 4: near-duplicate embeddings by cross-polytope hashing.

A vector is normalised, rotated by three rounds of random signs and the fast Hadamard transform, and hashed to its
nearest signed axis; several such hashes make a bucket of a table. Each vector also probes the buckets next in order of
lost projection. Vectors meet in a bucket that is the own one of at least one of them; a pair is handled at the first
place where it meets, so that links are counted once, and verified by its cosine in double precision.

The number of axes grows with the logarithm of the vectors of a label and dimension, so that a bucket's members don't
grow with them; the number of tables follows from it: as many as miss a pair just at the threshold with a probability of
at most `MISS`, by the share of such pairs that one table finds (measured on random pairs of that dimension). Larger
cosines are missed far more seldom.

Equal vectors of a label form one class with a multiplicity, so copies are never paired; buckets with more members than a
block are dealt to pairs of blocks; a bucket returns one row per member (its links, and its root in the bucket's
spanning forest), not its pairs. Only vectors of equal label and dimension are compared. Vectors of floats are compared
as they are, others as doubles.

Vectors that are null, empty, zero or hold null or non-finite components, and those with a null label, link with nothing
and are their own component. Rows with a null id link with nothing, have a null component and are kept; each gives a row.
Rows with the same id are one node: they give one row, which counts the pairs of one of its rows and a linked row of
another id, and joins all that any of them links to. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Kept, components, prepare, read_table, small, write_table
from .near_dedup import dealt, groups, merge, starts_of

COSINE, MISS = 0.98, 1e-3
#: Axes of a bucket at least and at most, and further buckets of a table that a vector looks into.
LEAST_AXES, MOST_AXES, PROBES = 2, 5, 2
BLOCK = 1024
#: Buckets of up to so many members are compared together with others of their size.
SMALL = 32
KEYS = ("table", "label", "dim", "bucket", "bi", "bj")


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each column, times the root of their number; the height is a power of two."""
    w, h = len(x), 1
    while h < w:
        x = x.reshape(w // (2 * h), 2, h, -1)
        y = np.empty_like(x)
        np.add(x[:, 0], x[:, 1], out=y[:, 0])
        np.subtract(x[:, 0], x[:, 1], out=y[:, 1])
        x, h = y, 2 * h
    return x.reshape(w, -1)


def width_of(dim: int) -> int:
    """Vectors are padded to this width; of fewer axes there are too few different rotations."""
    return max(16, 1 << (dim - 1).bit_length())


def hashes(x: np.ndarray, axes: int, tables: int) -> np.ndarray:
    """(vectors, tables, 1 + probes) bucket codes; the first is the vector's own."""
    width = width_of(x.shape[1])
    x = np.pad(x, ((0, 0), (0, width - x.shape[1]))).T.astype(np.float32)
    out = np.empty((x.shape[1], tables, 1 + PROBES), np.int64)
    rows = np.arange(x.shape[1])
    for t in range(tables):
        best, loss, second = [], [], []
        for a in range(axes):
            r = np.random.default_rng((width, t, a))
            y = x
            for _ in range(3):
                y = hadamard(y * r.choice(np.array([-1, 1], np.float32), (width, 1)))
            size = np.abs(y)
            first = size.argmax(0)
            top = size[first, rows]
            size[first, rows] = -1
            next_ = size.argmax(0)
            best.append(2 * first + (y[first, rows] < 0))
            second.append(2 * next_ + (y[next_, rows] < 0))
            loss.append((top - size[next_, rows]) / np.sqrt(width))
        key = lambda parts: sum(p * (2 * width) ** k for k, p in enumerate(parts))
        out[:, t, 0] = key(best)
        # probes: replace one axis by its runner-up, cheapest first
        cost = np.argsort(np.stack(loss, 1), 1, kind="stable")
        other = np.stack([key([s if j == k else b for j, (b, s) in enumerate(zip(best, second, strict=True))]) for k in range(axes)], 1)
        for p in range(PROBES):
            out[:, t, 1 + p] = other[rows, cost[:, p]]
    return out


@cache
def chances(dim: int, axes: int, cosine: float, tables: int = 16) -> tuple[int, float]:
    """(tables of so many axes that together miss few enough of the pairs with just this cosine, share of other vectors
    that a vector meets in one), from random vectors of this dimension."""
    r = np.random.default_rng(4)
    a, n = r.normal(size=(2, 300, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    n -= (n * a).sum(1, keepdims=True) * a
    n /= np.maximum(np.linalg.norm(n, axis=1, keepdims=True), 1e-300)
    b = cosine * a + math.sqrt(max(0, 1 - cosine * cosine)) * n
    x, y = (hashes(v, axes, tables) for v in (a, b))
    hits = ((x[:, :, :1] == y) | (y[:, :, :1] == x)).any(2).sum(1)
    # that a choice of t tables has none of those that a pair meets in
    miss = np.array([np.mean([math.comb(tables - h, t) / math.comb(tables, t) for h in hits.tolist()]) for t in range(tables + 1)])
    few = np.flatnonzero(miss <= MISS)
    need = int(few[0]) if len(few) else math.ceil(tables * math.log(MISS) / math.log(max(miss[-1], 1e-9)))
    met = (x[:, None, :, :1] == x[None]).any(3).mean(2)
    return need, max(float((met.sum() - len(x)) / len(x) / (len(x) - 1)), (1 + 2 * PROBES) / (2 * width_of(dim)) ** axes)


@cache
def plan(dim: int, magnitude: int, cosine: float) -> tuple[int, int]:
    """(axes, tables) for about 2**magnitude vectors: the least work, of entries and of expected meetings."""
    best = (math.inf, LEAST_AXES, 1)
    for axes in range(LEAST_AXES, MOST_AXES + 1):
        if (2 * width_of(dim)) ** axes >= 2**62:
            break
        tables, met = chances(dim, axes, cosine)
        best = min(best, (tables * (1 + PROBES + 2.0**magnitude * met), axes, tables))
        if 2.0**magnitude * met < 0.1:  # more axes would only need more tables
            break
    return best[1:]


def unit(batch: pa.RecordBatch) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, rows, unit vectors in double precision) of a batch's vectors, by dimension."""
    v = batch.column("embedding")
    size = np.diff(v.offsets.to_numpy())
    flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    at = np.concatenate([[0], np.cumsum(size)])
    out = []
    for d in np.unique(size):
        own = np.flatnonzero(size == d)
        x = flat[at[own][:, None] + np.arange(d)]
        x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the norm
        out.append((int(d), own, x / np.sqrt((x * x).sum(1, keepdims=True))))
    return out


def coded(batches: Iterator[pa.RecordBatch], plans: dict[tuple[int, int], tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """Classes with the buckets of their vectors, table by table; 2**magnitude is about how many there are to tell apart."""
    for batch in batches:
        codes: list = [None] * batch.num_rows
        magnitude = batch.column("magnitude").to_numpy(zero_copy_only=False)
        for d, own, x in unit(batch) if batch.num_rows else ():
            for m in np.unique(magnitude[own]).tolist():
                some = np.flatnonzero(magnitude[own] == m)
                for i, c in zip(own[some].tolist(), hashes(x[some], *plans[d, m]).reshape(len(some), -1), strict=True):
                    codes[i] = c
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.list_(pa.int64()))], [*batch.schema.names, "codes"])


def first_here(x: np.ndarray, y: np.ndarray, table: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Whether pairs with codes x[i] and y[i] (tables, 1 + probes) meet in bucket[i] of table[i] and nowhere earlier."""
    at_y = (x[:, :, :1] == y).any(2)  # in x's own bucket
    at_x = (y[:, :, :1] == x).any(2)
    met = at_x | at_y
    own_x, own_y = x[:, :, 0], y[:, :, 0]
    where = np.where(at_y & at_x, np.minimum(own_x, own_y), np.where(at_y, own_x, own_y))
    rows = np.arange(len(x))
    return (met.argmax(1) == table) & met[rows, table] & (where[rows, table] == bucket)


def near_pairs(at: np.ndarray, x: np.ndarray, side: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of x, inside each group [at[g], at[g + 1]), with this cosine or more; small groups by size."""
    size = np.diff(at)
    for n in np.unique(size[(size > 1) & (size <= SMALL)]).tolist():
        every = at[:-1][size == n]
        many = max(1, (1 << 21) // (n * x.shape[1]))
        for i in range(0, len(every), many):
            rows = every[i : i + many, None] + np.arange(n)
            part = x[rows]
            yield from linked(rows, part @ part.transpose(0, 2, 1) >= cosine, side)
    for g in np.flatnonzero(size > SMALL).tolist():
        rows = np.arange(at[g], at[g + 1])[None]
        yield from linked(rows, (x[rows[0]] @ x[rows[0]].T >= cosine)[None], side)


def linked(rows: np.ndarray, near: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    s = side[rows]
    near &= (s[:, :, None] != s[:, None]) | (s[:, :, None] == 0)
    g, a, b = np.nonzero(np.triu(near, 1))
    a, b = rows[g, a], rows[g, b]
    for i in range(0, len(a), 1 << 16):
        yield a[i : i + (1 << 16)], b[i : i + (1 << 16)]


def links(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """Per member of a bucket with a link found here: (class, linked vectors, its smallest id, that of its root
    in the bucket's forest)."""
    for batch in groups(batches, KEYS, 4096):
        if not batch.num_rows:
            continue
        at = starts_of(batch, KEYS)
        node, rep, copies, side = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("node", "rep", "copies", "side"))
        table, bucket = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("table", "bucket"))
        codes = batch.column("codes")
        begin, flat = codes.offsets.to_numpy(), codes.values.to_numpy(zero_copy_only=False)
        root, count = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
        for d, own, x in unit(batch):
            # a group has vectors of one dimension
            mine = np.flatnonzero(np.isin(at[:-1], own))
            local = np.append(np.searchsorted(own, at[mine]), len(own))
            for p, q in near_pairs(local, x, side[own], cosine):
                p, q = own[p], own[q]
                size = begin[p + 1] - begin[p]
                for n in np.unique(size).tolist():
                    i = np.flatnonzero(size == n)
                    x_code, y_code = (flat[begin[k[i]][:, None] + np.arange(n)].reshape(len(i), -1, 1 + PROBES) for k in (p, q))
                    ok = i[first_here(x_code, y_code, table[p[i]], bucket[p[i]])]
                    a, b = p[ok], q[ok]
                    np.add.at(count, a, copies[b])
                    np.add.at(count, b, copies[a])
                    if len(a):
                        root = merge(root, a, b)
        own = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(count[own]), pa.array(rep[own]), pa.array(rep[root[own]])], ["node", "links", "u", "v"])


def same_id(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """Per id and pair of blocks of its vectors: how often two of its rows, of different vectors, are linked."""
    for batch in groups(batches, ("vec_id", "bi", "bj"), 4096):
        if not batch.num_rows:
            continue
        vec_id, rows, side = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("vec_id", "rows", "side"))
        label = batch.column("label").to_numpy(zero_copy_only=False)
        total = np.zeros(batch.num_rows, np.int64)
        for _, own, x in unit(batch):
            first = starts_of(batch.take(pa.array(own)), ("vec_id", "bi", "bj"))
            for p, q in near_pairs(first, x, side[own], cosine):
                ok = label[own[p]] == label[own[q]]
                p, q = own[p[ok]], own[q[ok]]
                np.add.at(total, p, 2 * rows[p] * rows[q])
        yield pa.RecordBatch.from_arrays([pa.array(vec_id[total > 0]), pa.array(total[total > 0])], ["vec_id", "linked"])


def labelled(spark: SparkSession, rows: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector of rows(vec_id, embedding, label)."""
    prepare(spark)
    kept = Kept(spark)
    kind = "float" if rows.schema["embedding"].dataType == T.ArrayType(T.FloatType()) else "double"
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"), "label")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(~bad, F.lit(False)) & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    # -0.0 and 0.0 are the same component
    rows = rows.withColumn("fine", fine).withColumn("same", F.transform("embedding", lambda x: x + F.lit(0.0).cast(kind)))
    rows = rows.withColumns({"f1": F.xxhash64("label", "same"), "f2": F.xxhash64(F.lit(42), "same", "label")}).drop("same")
    good = rows.where("fine").withColumn("dim", F.size("embedding"))
    sizes = kept(good.groupBy("label", "dim").agg(F.ceil(F.log2(F.count("*"))).cast("int").alias("magnitude")), "sizes")
    plans = {(r["dim"], r["magnitude"]): plan(r["dim"], r["magnitude"], cosine) for r in sizes.select("dim", "magnitude").distinct().collect()}  # no more than dimensions times bits
    classes = good.groupBy("label", "dim", "f1", "f2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    classes = classes.join(small(sizes), ["label", "dim"]).withColumn("node", F.monotonically_increasing_id())
    vectors = kept(classes.mapInArrow(partial(coded, plans=plans), T.StructType([*classes.schema.fields, T.StructField("codes", T.ArrayType(T.LongType()))])), "vectors")

    # a bucket by a hash of its name: the vectors themselves go only where some meet
    spots = vectors.select("node", "label", "dim", F.posexplode("codes").alias("pos", "bucket"))
    spots = spots.select("node", "pos", F.xxhash64(F.floor(F.col("pos") / (1 + PROBES)), "label", "dim", "bucket").alias("place"))
    shared = spots.groupBy("place").agg(F.count("*").alias("members"), F.max(F.col("pos") % (1 + PROBES) == 0).alias("owned")).where("members > 1 and owned").drop("owned")
    member = spots.join(shared, "place").drop("place").join(vectors.select("node", "label", "dim", "rep", "copies", "embedding", "codes"), "node")
    member = member.withColumns({"table": F.floor(F.col("pos") / (1 + PROBES)), "bucket": F.col("codes")[F.col("pos")]})
    found = dealt(member, ["table", "label", "dim", "bucket"], "members", BLOCK, by="node").select(*KEYS, "side", "node", "rep", "copies", "embedding", "codes").mapInArrow(partial(links, cosine=cosine), "node long, links long, u long, v long")
    found = kept(found, "links")

    edges, number = found.select("u", "v"), found.groupBy("node").agg(F.sum("links").alias("links"))
    repeated = kept(rows.where("vec_id is not null").groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id"), "repeated")
    twice = not repeated.isEmpty()
    if twice:  # an id's rows are one node of the graph
        own = good.join(repeated, "vec_id", "left_semi").select("vec_id", "label", "f1", "f2").join(vectors.select("node", "rep", "label", "f1", "f2"), ["label", "f1", "f2"])
        own = kept(own.groupBy("vec_id", "node", "rep").agg(F.count("*").alias("rows")), "own")
        edges = edges.union(own.select("vec_id", "rep"))
    comp = kept.also(components(spark, edges))
    named = vectors.select("node", "rep", "label", "f1", "f2", "copies").join(number, "node", "left").join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left")
    out = rows.select("vec_id", "fine", F.when(F.col("fine"), F.col("label")).alias("label"), "f1", "f2").join(named, ["label", "f1", "f2"], "left")
    c = F.when(F.col("vec_id").isNull(), None).when(F.col("fine"), F.coalesce("component", "rep")).otherwise(F.col("vec_id"))
    n = F.when(F.col("fine"), F.col("copies") - 1 + F.coalesce("links", F.lit(0))).otherwise(0)
    out = out.select("vec_id", n.cast("long").alias("n_links"), c.alias("component_id"))
    if twice:
        copies = own.groupBy("vec_id").agg(F.sum(F.col("rows") * (F.col("rows") - 1)).alias("less"), F.count("*").alias("members"))
        several = own.join(copies.where("members > 1").select("vec_id", "members"), "vec_id").join(vectors.select("node", "label", "embedding"), "node")
        linked_ids = dealt(several, ["vec_id"], "members", BLOCK, by="node").select("vec_id", "bi", "bj", "side", "rows", "label", "embedding").mapInArrow(partial(same_id, cosine=cosine), "vec_id long, linked long")
        less = copies.select("vec_id", "less").union(linked_ids).groupBy("vec_id").agg(F.sum("less").alias("less"))
        one = out.where("vec_id is not null").groupBy("vec_id").agg(F.sum("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
        one = one.join(less, "vec_id", "left").withColumn("n_links", F.greatest(F.lit(0), F.col("n_links") - F.coalesce("less", F.lit(0))))
        out = one.select(*out.columns).union(out.where("vec_id is null"))
    out, _ = write_table(spark, out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True))), "labelled")
    kept.drop()
    return out


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, read_table(spark, sf_dir, "embeddings"))


OP4_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS c FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.c),
c AS (SELECT a AS vec_id, min(c) AS component_id FROM r GROUP BY 1),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1)
SELECT c.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM c LEFT JOIN n ON n.vec_id = c.vec_id"""
