"""CSV ingest: an all-string scan, explicit or inferred schema, exact casts, row ids from a column or generated.

Headers and cells are trimmed of Unicode white space; columns are matched by name, file by file; extra columns are ignored
where a schema says what is wanted; an empty cell is null. A file is split by Spark's reader only if no cell holds a line break (`multi_line=False`).
"""

from __future__ import annotations

from csv import reader
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.schema import ROW_ID, Field, Kind, Schema, SchemaError

SPACE = r"(?U)^\s+|\s+$"
#: What counts as a number: no type suffix, no words for infinity or not-a-number.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_BAD, _ORDER = "__malformed", "__order"


class CsvError(ValueError):
    pass


@dataclass(frozen=True)
class CsvOptions:
    """`row_id`: a column of unsigned ids, or None to number rows from `first_row_id` in file order. `kinds` override
    inferred kinds."""

    row_id: str | None = None
    first_row_id: int = 1
    kinds: dict[str, Kind] = field(default_factory=dict)
    multi_line: bool = True


def trimmed(col: str) -> Column:
    return F.nullif(F.regexp_replace(F.col(f"`{col}`"), SPACE, ""), F.lit(""))


def files_of(spark: SparkSession, path: str) -> list[str]:
    """The files below a path that hold any bytes, in order of their names."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(conf)
    out, todo = [], list(fs.globStatus(top) or [])
    while todo:
        s = todo.pop()
        name = s.getPath().getName()
        if s.isDirectory():
            todo += [c for c in fs.listStatus(s.getPath()) if not c.getPath().getName().startswith(("_", "."))]
        elif s.getLen() and not name.startswith(("_", ".")):
            out.append(s.getPath().toString())
    if not out:
        raise CsvError(f"no header: no file with content at {path}")
    return sorted(out)


def header_of(spark: SparkSession, file: str) -> tuple[str, ...]:
    """The trimmed names in a file's first record."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(file)
    stream = p.getFileSystem(conf).open(p)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(p)
    lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
    try:
        text = ""
        while (line := lines.readLine()) is not None:
            text += line
            if not text.strip():
                text = ""
            elif text.count('"') % 2 == 0:
                break
            else:
                text += "\n"
    finally:
        lines.close()
    names = tuple(x.strip() for x in next(iter(reader([text.removeprefix("\ufeff")])), []))
    if not any(names):
        raise CsvError(f"no header in {file}")
    if len(set(names)) != len(names):
        raise CsvError(f"duplicate headers in {file}: {sorted({n for n in names if names.count(n) > 1})}")
    return names


def read_strings(spark: SparkSession, path: str, options: CsvOptions, wanted: list[str] | None = None) -> DataFrame:
    """All columns as trimmed strings, empty ones null, in file order by `__order`. Each file's own header says where its
    columns are. Files must hold all `wanted` columns, of which others are ignored; or, if none are named, have the
    same names, in whatever order."""
    groups: dict[tuple[str, ...], list[str]] = {}
    for f in files_of(spark, path):
        groups.setdefault(header_of(spark, f), []).append(f)
    names = wanted or list(next(iter(groups)))
    for header, files in groups.items():
        if missing := [n for n in names if n not in header]:
            raise CsvError(f"no columns {missing} in {files[0]}")
        if wanted is None and (extra := [n for n in header if n not in names]):
            raise CsvError(f"columns {extra} in {files[0]} that other files don't have")
    given = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", options.multi_line).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("enforceSchema", True).option("mode", "PERMISSIVE").option("columnPruning", False).option("columnNameOfCorruptRecord", _BAD)
    out = None
    for header, files in groups.items():
        # ragged rows are caught by a corrupt-record column
        schema = T.StructType([T.StructField(n, T.StringType()) for n in header] + [T.StructField(_BAD, T.StringType())])
        one = given.schema(schema).csv(files)
        if len(header) == 1:  # a blank line is no record of a single column
            one = one.where(trimmed(header[0]).isNotNull())
        # the row is read whole, so that a ragged one shows whatever columns are asked for
        one = one.select(*[trimmed(n).alias(n) for n in names], _BAD)
        out = one if out is None else out.union(one)
    out = out.withColumn(_ORDER, F.monotonically_increasing_id())
    if bad := out.where(F.col(_BAD).isNotNull()).take(1):
        raise CsvError(f"a ragged row: {bad[0][_BAD]!r}")
    return out.drop(_BAD)


def as_kind(col: str, kind: Kind) -> Column:
    """The cell in its kind; null where it can't be read."""
    c = F.col(f"`{col}`")
    if kind in (Kind.INTEGER, Kind.TIMESTAMP_MS):
        return F.when(c.rlike(r"^[+-]?\d+$"), c.try_cast("long"))
    if kind is Kind.FLOAT:
        x = c.try_cast("double")
        return F.when(c.rlike(NUMBER) & (F.abs(x) < float("inf")), x)
    if kind is Kind.BOOLEAN:
        return F.when(F.lower(c) == "true", True).when(F.lower(c) == "false", False)
    return c


def infer_schema(df: DataFrame, kinds: dict[str, Kind] | None = None) -> Schema:
    """The first kind that all cells of a column satisfy: boolean, integer, float, text; nullable if a cell is empty; text
    if all are. One aggregate over the scan. Categories and timestamps are never inferred."""
    kinds = kinds or {}
    names = [c for c in df.columns if c not in (_ORDER, _BAD)]
    if unknown := set(kinds) - set(names):
        raise CsvError(f"kinds for unknown headers: {sorted(unknown)}")
    aggs = []
    for n in names:
        c = F.col(f"`{n}`")
        aggs += [F.count(c).alias(f"{n}\0any"), F.count_if(c.isNull()).alias(f"{n}\0null")]
        aggs += [F.count_if(c.isNotNull() & as_kind(n, k).isNull()).alias(f"{n}\0{k.value}") for k in (Kind.BOOLEAN, Kind.INTEGER, Kind.FLOAT)]
    got = df.agg(*aggs).first().asDict()
    out = []
    for n in names:
        kind = next((k for k in (Kind.BOOLEAN, Kind.INTEGER, Kind.FLOAT) if got[f"{n}\0any"] and not got[f"{n}\0{k.value}"]), Kind.TEXT)
        out.append(Field(n, kinds.get(n, kind), got[f"{n}\0null"] > 0))
    return Schema(out)


def to_typed(df: DataFrame, schema: Schema, options: CsvOptions) -> DataFrame:
    """Strings to a typed table; raises on cells that can't be read, missing columns, nulls and bad ids."""
    if missing := [n for n in schema.names if n not in df.columns]:
        raise CsvError(f"no columns {missing}")
    if options.row_id is not None and options.row_id not in df.columns:
        raise CsvError(f"no row-id column {options.row_id!r}")
    bad = [F.count_if(F.col(f"`{f.name}`").isNotNull() & as_kind(f.name, f.kind).isNull()).alias(f"unreadable {f.name}") for f in schema.fields]
    bad += [F.count_if(F.col(f"`{f.name}`").isNull()).alias(f"null {f.name}") for f in schema.fields if not f.nullable]
    if options.row_id is not None:
        bad.append(F.count_if(~F.coalesce(F.col(f"`{options.row_id}`").rlike(r"^\+?\d+$") & F.col(f"`{options.row_id}`").try_cast("long").isNotNull(), F.lit(False))).alias("unreadable row id"))
    found = {k: n for k, n in df.agg(*bad).first().asDict().items() if n}
    if found:
        raise CsvError(str(found))
    if options.row_id is not None:
        rid = F.col(f"`{options.row_id}`").cast("long")
        src = df
    else:
        src, rid = numbered(df, options.first_row_id)
    fields = [as_kind(f.name, f.kind).cast(f.kind.spark).alias(f.name, metadata={"kind": f.kind.value}) for f in schema.fields]
    out = src.select(rid.alias(ROW_ID), *fields)
    if twice := out.groupBy(ROW_ID).count().where("count > 1").take(1):
        raise CsvError(f"row id {twice[0][0]} is there twice")
    return out


def numbered(df: DataFrame, first: int) -> tuple[DataFrame, Column]:
    """Consecutive ids in file order without a global sort: rows are numbered inside their scan partition, partitions by
    their sizes (a small aggregate, one row for each partition)."""
    part = F.shiftright(F.col(_ORDER), 33)
    sizes = {r["p"]: r["n"] for r in df.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    at, offsets = first, {}
    for p in sorted(sizes):
        offsets[p] = at
        at += sizes[p]
    if at > 2**63 - 1:
        raise CsvError("row ids overflow")
    place = F.row_number().over(Window.partitionBy("__p").orderBy(_ORDER)) - 1
    pairs = df.sparkSession.createDataFrame(sorted(offsets.items()) or [(0, 0)], "__p long, __o long")
    src = df.withColumn("__p", part).withColumn("__n", place).join(F.broadcast(pairs), "__p")
    return src, F.col("__n") + F.col("__o")


def read_csv(spark: SparkSession, path: str, schema: Schema | None = None, options: CsvOptions | None = None) -> tuple[DataFrame, Schema]:
    """A typed table from CSV files, with its explicit or inferred schema."""
    options = options or CsvOptions()
    raw = read_strings(spark, path, options, None if schema is None else list(dict.fromkeys([*schema.names, *([options.row_id] if options.row_id else [])])))
    schema = schema or infer_schema(raw, options.kinds)
    return to_typed(raw, schema, options), schema


def read_row_ids(spark: SparkSession, path: str, options: CsvOptions) -> DataFrame:
    raw = read_strings(spark, path, options, [options.row_id] if options.row_id else None)
    if options.row_id is None:
        src, rid = numbered(raw, options.first_row_id)
        return src.select(rid.alias(ROW_ID))
    if options.row_id not in raw.columns:
        raise CsvError(f"no row-id column {options.row_id!r}")
    got = raw.select(F.when(F.col(options.row_id).rlike(r"^\+?\d+$"), F.col(options.row_id).try_cast("long")).alias(ROW_ID))
    if got.where(f"{ROW_ID} is null").take(1):
        raise CsvError("an unreadable row id")
    return got


def write_csv(df: DataFrame, path: str, files: int | None = 1) -> None:
    """A report as CSV with a header; one file by default, as reports are small."""
    (df.coalesce(files) if files else df).write.mode("overwrite").option("header", True).csv(path)

