"""Ranks over whole tables without a task that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a range, about, and sampled rows for each.
RANGE_ROWS, SAMPLED = 100_000, 32


def sql_keys(df: DataFrame, by: list[str]) -> list[Column]:
    """Sort keys by which nulls come last, also within arrays, as in the SQL that results are compared with."""
    out = []
    for c in by:
        f, col = df.schema[c], F.col(f"`{c}`")
        if f.nullable:
            out.append(col.isNull())
        nulls = isinstance(f.dataType, T.ArrayType) and f.dataType.containsNull
        out.append(F.transform(col, lambda x: F.struct(x.isNull().alias("none"), x.alias("x"))) if nulls else col)
    return out


def ranges(df: DataFrame, by: list[str], name: str, rows: int | None = None) -> tuple[DataFrame, int]:
    """df with the number of each row's range in the order `by`, and how many ranges there are at most. Cuts are rows drawn
    by a hash of their keys: a row's range is a function of the table's rows, the same whenever and wherever the plan runs
    (a range partitioner draws anew for each job, and Spark may join its partitions). `by` should tell rows apart."""
    n = df.count()
    parts = max(1, -(-n // (rows or RANGE_ROWS)))
    if parts == 1:
        return df.withColumn(name, F.lit(0)), 1
    key = F.struct(*[F.col(f"`{c}`") for c in by])
    share = min(1.0, parts * SAMPLED / n)
    drawn = df.where(F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in by], F.lit(19)), F.lit(1 << 30)) < int(share * (1 << 30))).agg(F.sort_array(F.collect_list(key)).alias("__keys"))
    at = lambda i: F.get("__keys", F.floor(i * F.size("__keys") / parts).cast("int"))
    cuts = drawn.select(F.transform(F.sequence(F.lit(1), F.lit(parts - 1)), at).alias("__cuts")).persist()  # one row
    out = df.join(F.broadcast(cuts)).withColumn(name, F.lit(0))
    for k in reversed(range(parts.bit_length())):  # how many cuts are up to the row's keys, bit by bit
        out = out.withColumn(name, F.col(name) + F.when(F.get("__cuts", F.col(name) + ((1 << k) - 1)) <= key, 1 << k).otherwise(0))
    return out.drop("__cuts"), parts


def ranked(df: DataFrame, by: list[str], name: str = "place") -> DataFrame:
    """Rows with their rank from 0 in an order, nulls last: the place in the row's range and the sizes of the ranges before
    it, not one global window. `by` should tell rows apart."""
    keys = {f"__k{i}": c for i, c in enumerate(sql_keys(df, by))}
    dealt, parts = ranges(df.withColumns(keys), list(keys), "__p")
    sizes = {r["__p"]: r["count"] for r in dealt.groupBy("__p").count().collect()} if parts > 1 else {0: 0}
    at, first = 0, []
    for p in sorted(sizes):
        first.append((p, at))
        at += sizes[p]
    starts = df.sparkSession.createDataFrame(first, "__p int, __first long")
    rank = F.row_number().over(Window.partitionBy("__p").orderBy(*keys)) - 1
    return dealt.withColumn("__r", rank).join(F.broadcast(starts), "__p").withColumn(name, (F.col("__r") + F.col("__first")).cast("long")).drop("__p", "__r", "__first", *keys)
