"""Field kinds, schemas and record validation.

Category and text are both strings in Spark; the kind lives in the schema. Timestamps are whole milliseconds since the
epoch (long). Row ids are an explicit long column, unique and never null.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW_ID = "row_id"


class SchemaError(ValueError):
    pass


class RecordError(ValueError):
    pass


class Kind(Enum):
    INTEGER = "integer"
    FLOAT = "float"
    TEXT = "text"
    BOOLEAN = "boolean"
    TIMESTAMP_MS = "timestamp_ms"
    CATEGORY = "category"

    @property
    def spark(self) -> T.DataType:
        return {Kind.INTEGER: T.LongType(), Kind.FLOAT: T.DoubleType(), Kind.BOOLEAN: T.BooleanType(), Kind.TIMESTAMP_MS: T.LongType()}.get(self, T.StringType())

    @property
    def ranged(self) -> bool:
        """Whether closed ranges are supported."""
        return self in (Kind.INTEGER, Kind.FLOAT, Kind.TIMESTAMP_MS)

    @property
    def indexable(self) -> bool:
        return self is not Kind.TEXT

    def accepts(self, value: object) -> bool:
        """Whether a Python value has exactly this kind; there is no coercion."""
        if self in (Kind.INTEGER, Kind.TIMESTAMP_MS):
            return isinstance(value, int) and not isinstance(value, bool) and -(2**63) <= value < 2**63
        if self is Kind.FLOAT:
            return isinstance(value, float)
        if self is Kind.BOOLEAN:
            return isinstance(value, bool)
        return isinstance(value, str)


@dataclass(frozen=True)
class Field:
    name: str
    kind: Kind
    nullable: bool = False


@dataclass(frozen=True)
class Schema:
    fields: tuple[Field, ...]

    def __init__(self, fields):
        object.__setattr__(self, "fields", tuple(fields))
        if not self.fields:
            raise SchemaError("a schema needs at least one field")
        names = [f.name for f in self.fields]
        if any(not n.strip() for n in names):
            raise SchemaError("empty field name")
        if len(set(names)) != len(names):
            raise SchemaError(f"duplicate field names: {sorted({n for n in names if names.count(n) > 1})}")

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    def __getitem__(self, at: str | int) -> Field:
        if isinstance(at, int):
            if not 0 <= at < len(self.fields):
                raise SchemaError(f"no field number {at}")
            return self.fields[at]
        for f in self.fields:
            if f.name == at:
                return f
        raise SchemaError(f"no field {at!r}")

    def index(self, name: str) -> int:
        return self.names.index(self[name].name)

    def spark(self) -> T.StructType:
        return T.StructType([T.StructField(ROW_ID, T.LongType(), False), *[T.StructField(f.name, f.kind.spark, f.nullable, {"kind": f.kind.value}) for f in self.fields]])

    def to_dict(self) -> list[dict]:
        return [{"name": f.name, "kind": f.kind.value, "nullable": f.nullable} for f in self.fields]

    @classmethod
    def from_dict(cls, rows: list[dict]) -> Schema:
        return cls([Field(r["name"], Kind(r["kind"]), r["nullable"]) for r in rows])


def check_record(schema: Schema, values: list) -> list:
    """One record's values, checked by count, kind and nullability."""
    if len(values) != len(schema.fields):
        raise RecordError(f"{len(values)} values for {len(schema.fields)} fields")
    for f, v in zip(schema.fields, values, strict=True):
        if v is None:
            if not f.nullable:
                raise RecordError(f"field {f.name!r} isn't nullable")
        elif not f.kind.accepts(v):
            raise RecordError(f"field {f.name!r} is {f.kind.value}, got {type(v).__name__}")
    return values


def milliseconds(col: Column | str) -> Column:
    """Whole milliseconds since the epoch of a timestamp (with or without zone); rounds down."""
    return F.unix_millis(F.col(col).cast("timestamp") if isinstance(col, str) else col.cast("timestamp"))


def typed(df: DataFrame, schema: Schema, row_id: str, columns: dict[str, Column] | None = None) -> DataFrame:
    """df as a typed table: row_id and the schema's fields, in order. `columns` gives expressions for some fields."""
    columns = columns or {}
    return df.select(F.col(row_id).cast("long").alias(ROW_ID), *[columns.get(f.name, F.col(f.name)).cast(f.kind.spark).alias(f.name, metadata={"kind": f.kind.value}) for f in schema.fields])


def validate(df: DataFrame, schema: Schema, unique: bool = True) -> DataFrame:
    """Raise unless df fits the schema: columns, types, no null where none may be, unique row ids. Returns df."""
    want = {ROW_ID: T.LongType(), **{f.name: f.kind.spark for f in schema.fields}}
    have = {f.name: f.dataType for f in df.schema.fields}
    if have != want:
        raise SchemaError(f"columns {have} don't fit {want}")
    checks = [F.count_if(F.col(ROW_ID).isNull()).alias(ROW_ID), *[F.count_if(F.col(f.name).isNull()).alias(f.name) for f in schema.fields if not f.nullable]]
    bad = {k: n for k, n in df.agg(*checks).first().asDict().items() if n}
    if bad:
        raise RecordError(f"null in {bad}")
    if unique and (twice := df.groupBy(ROW_ID).count().where("count > 1").select(ROW_ID).limit(5).collect()):
        raise RecordError(f"duplicate row ids, among them {[r[0] for r in twice]}")
    return df


def finite(value: object) -> bool:
    return not isinstance(value, float) or math.isfinite(value)
