"""Shared plumbing of the training-data operators: tables, shared folder, held-out folds, graph components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A relation is broadcast only when a count has shown that it has at most so many (small) rows.
BROADCAST_ROWS = 1_000_000


#: Rows and bytes of an Arrow batch on its way to Python, where the session still has Spark's own (far larger) defaults.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": (str(2**26), str(8 << 20))}


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package wherever the driver was started, and bound the batches that they get."""
    for key, (default, ours) in BATCH.items():
        if spark.conf.get(key) in (default, f"{default}b"):
            spark.conf.set(key, ours)
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in parts:
        env["PYTHONPATH"] = os.pathsep.join([root, *parts])
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one of our own only where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


#: Shuffle files of a written table are of no more use.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaning(spark: SparkSession) -> Iterator[None]:
    """While this lasts, a query's shuffle files are deleted at its end."""
    before = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN, before)


#: Bytes of a row group of intermediate tables: a task holds one at a time, beside the Python workers of former stages.
ROW_GROUP = 32 << 20


def write_table(spark: SparkSession, df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Cut lineage: write to the shared folder as Parquet and read again. Survives lost executors."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    with cleaning(spark):
        df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def write_bucketed(spark: SparkSession, df: DataFrame, tag: str, key: str, buckets: int) -> tuple[DataFrame, str]:
    """As write_table, but dealt into buckets of `key`: joins by it then move the other side only. The table's name is
    known to the session's catalog; drop_table forgets it."""
    name = f"{tag}_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet OPTIONS (compression 'zstd') CLUSTERED BY ({key}) INTO {buckets} BUCKETS LOCATION '{shared_dir(spark)}/{name}'")
    with cleaning(spark):
        df.repartition(buckets, key).write.insertInto(name)
    return spark.table(name), name


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE {name}")
    drop_path(spark, f"{shared_dir(spark)}/{name}")


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def fold(col: str, mod: int):
    """crc32 of the id as text, modulo `mod`: the rule that fixes held-out rows."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % mod


def small(df: DataFrame) -> DataFrame:
    """A written table as the small side of a join: broadcast if a count shows that it may be; else one whose shuffle is
    its own, so that Spark can split the other side's frequent keys."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def bounded(df: DataFrame, rows: int, key: str) -> DataFrame:
    """At most `rows` rows of df, those with the smallest hashes of `key`: a bounded, repeatable sample for fitting."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(17)), key).limit(rows)


def excerpt(text: Column, longest: int, piece: int = 1000) -> Column:
    """A text of up to `longest` characters as it is; a longer one as pieces spread evenly over the whole of it, as many
    as `longest` holds. Bounds what a row of a training sample weighs, whatever its length."""
    n = longest // piece
    start = lambda i: F.floor(i * (F.length(text) - piece) / (n - 1)).cast("int") + 1
    pieces = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.substring(text, start(i), F.lit(piece)))
    return F.when(F.length(text) > longest, F.array_join(pieces, " ")).otherwise(text)


def is_fold(col: str, mod: int, k: int) -> Column:
    """Whether a row belongs to the held-out fold; one without an id doesn't."""
    return F.coalesce(fold(col, mod) == k, F.lit(False))


class Kept:
    """Tables written on the way to a result, deleted with it at hand."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __call__(self, df: DataFrame, tag: str) -> DataFrame:
        return self.also(write_table(self.spark, df, tag))

    def also(self, written: tuple[DataFrame, str]) -> DataFrame:
        self.paths.append(written[1])
        return written[0]

    def drop(self) -> None:
        for p in self.paths:
            drop_path(self.spark, p)


def components(spark: SparkSession, edges: DataFrame, rounds: int = 60) -> tuple[DataFrame, str]:
    """Connected components of `edges(u, v)`, as a written table and its path: rows (node, component), component the
    smallest node reachable.

    Alternating large-star and small-star steps, each a min-aggregate joined back, so that no neighbourhood is
    ever gathered in one place; every round is written to the shared folder. Nodes without a link don't appear.
    """
    cur, path = write_table(spark, edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "cc")
    mark = lambda d: tuple(d.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())
    seen = mark(cur)
    for _ in range(rounds if seen[0] else 0):
        # the exclusive or with 0 hides that the minima are partitioned by u already: both sides of each join then have
        # a shuffle of their own, and Spark can split a hub's edges among tasks
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").bitwiseXOR(F.lit(0)).alias("u"), F.least("u", "v").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").bitwiseXOR(F.lit(0)).alias("u"), "m")
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        nxt, npath = write_table(spark, small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct(), "cc")
        now = mark(nxt)
        drop_path(spark, path)
        cur, path = nxt, npath
        if now == seen:
            break
        seen = now
    else:
        if seen[0]:
            raise RuntimeError("components did not settle")
    roots = cur.select(F.col("v").alias("node")).distinct()
    out = write_table(spark, cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component"))), "components")
    drop_path(spark, path)
    return out


def appended(df: DataFrame, **kinds: str) -> T.StructType:
    """df's schema with fields added."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(", ".join(f"{k} {v}" for k, v in kinds.items())).fields])
