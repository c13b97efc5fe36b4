"""Encoders from typed fields to single-precision coordinates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordering import ranked
from .schema import ROW_ID, Kind, RecordError, Schema, SchemaError


class EncodingError(ValueError):
    pass


@dataclass(frozen=True)
class Dictionary:
    """Category labels in code order."""

    labels: tuple[str, ...]

    def __init__(self, labels):
        object.__setattr__(self, "labels", tuple(labels))
        if not self.labels:
            raise EncodingError("a dictionary needs a label")
        if any(not x for x in self.labels):
            raise EncodingError("empty label")
        if len(set(self.labels)) != len(self.labels):
            raise EncodingError("duplicate label")

    def code(self, label: str) -> int:
        try:
            return self.labels.index(label)
        except ValueError:
            raise EncodingError(f"unknown category {label!r}") from None

    def column(self, col: Column) -> Column:
        """The code; null for unknown labels."""
        if len(self.labels) > 1000:  # a long literal map would dominate the plan
            codes = F.create_map(*[x for i, s in enumerate(self.labels) for x in (F.lit(s), F.lit(i))])
            return F.try_element_at(codes, col)
        return F.when(F.array_position(F.array(*map(F.lit, self.labels)), col) > 0, F.array_position(F.array(*map(F.lit, self.labels)), col) - 1)


#: Labels that a dictionary on the driver, and so in plans and manifests, may hold. Fields of more labels are coded by a
#: table of their labels, see `label_table`.
MOST_LABELS = 100_000


def first_seen(df: DataFrame, field: str, position: str = ROW_ID) -> Dictionary:
    """Labels in order of first appearance, on the driver; at most MOST_LABELS."""
    rows = df.where(F.col(field).isNotNull()).groupBy(field).agg(F.min(position).alias("at")).orderBy("at").limit(MOST_LABELS + 1).collect()
    if len(rows) > MOST_LABELS:
        raise EncodingError(f"field {field!r} has over {MOST_LABELS} labels; code it by a table of labels")
    return Dictionary([r[field] for r in rows])


def label_table(df: DataFrame, field: str, position: str = ROW_ID) -> DataFrame:
    """(label, code) in order of first appearance, for any number of labels: ranks of an aggregate, nothing collected."""
    seen = df.where(F.col(field).isNotNull()).groupBy(F.col(field).alias("label")).agg(F.min(position).alias("at"))
    return ranked(seen, ["at", "label"], "code").select("label", "code")


def coded(df: DataFrame, field: str, table: DataFrame, name: str) -> DataFrame:
    """df with the code of each row's label, null for null and unknown labels, by a join with a table of labels."""
    return df.join(table.select(F.col("label").alias(field), F.col("code").alias(name)), field, "left")


@dataclass(frozen=True)
class RecordEncoder:
    """Per-field encoders in schema order."""

    schema: Schema
    dictionaries: dict[str, Dictionary]

    def __post_init__(self):
        for f in self.schema.fields:
            if not f.kind.indexable:
                raise EncodingError(f"field {f.name!r}: text can't be encoded")
            if f.kind is Kind.CATEGORY and f.name not in self.dictionaries:
                raise EncodingError(f"field {f.name!r}: no dictionary")

    @classmethod
    def from_batch(cls, df: DataFrame, schema: Schema) -> RecordEncoder:
        """Dictionaries from the data. Nulls can't be encoded and raise."""
        for f in schema.fields:
            if not f.kind.indexable:
                raise EncodingError(f"field {f.name!r}: text can't be encoded")
        bad = {k: n for k, n in df.agg(*[F.count_if(F.col(f.name).isNull()).alias(f.name) for f in schema.fields]).first().asDict().items() if n}
        if bad:
            raise RecordError(f"null can't be encoded: {bad}")
        return cls(schema, {f.name: first_seen(df, f.name) for f in schema.fields if f.kind is Kind.CATEGORY})

    def column(self, name: str) -> Column:
        f = self.schema[name]
        c = F.col(f.name)
        if f.kind is Kind.CATEGORY:
            c = self.dictionaries[name].column(c)
        elif f.kind is Kind.BOOLEAN:
            c = c.cast("int")
        return c.cast("float")

    def select(self, df: DataFrame) -> DataFrame:
        """(row_id, x0..xn); values that can't be encoded come out null (see `encode`)."""
        return df.select(ROW_ID, *[self.column(f.name).alias(f"x{i}") for i, f in enumerate(self.schema.fields)])

    def encode(self, df: DataFrame) -> DataFrame:
        """`select`, after a check that all values can be encoded; names a row id of the first bad rows if not."""
        out = self.select(df)
        bad = None
        for i in range(len(self.schema.fields)):
            c = F.col(f"x{i}")
            one = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
            bad = one if bad is None else bad | one
        if rows := out.where(bad).orderBy(ROW_ID).limit(1).collect():
            raise EncodingError(f"row {rows[0][ROW_ID]}: {rows[0].asDict()} isn't finite and known")
        return out


class DimensionMapping:
    """Which schema field feeds which coordinate; a dimension is used once, a field may be used often."""

    def __init__(self, schema: Schema, pairs: list[tuple[str, tuple[int, ...]]]):
        self.schema, self.pairs = schema, [(schema[n].name, tuple(d)) for n, d in pairs]
        used = [d for _, ds in self.pairs for d in ds]
        if not used:
            raise SchemaError("an empty mapping")
        if any(not ds for _, ds in self.pairs):
            raise SchemaError("a field without a dimension")
        if len(set(used)) != len(used):
            raise SchemaError("a dimension is used twice")
        self.dimensions = max(used) + 1

    @classmethod
    def identity(cls, schema: Schema) -> DimensionMapping:
        return cls(schema, [(n, (i,)) for i, n in enumerate(schema.names)])

    def field_of(self, dimension: int) -> str | None:
        return next((n for n, ds in self.pairs if dimension in ds), None)

    def dimensions_of(self, field: str) -> list[int]:
        return [d for n, ds in self.pairs if n == field for d in ds]


def centroids(df: DataFrame, dims: list[str], by: str) -> DataFrame:
    """Centroid of each group, in double precision."""
    return df.groupBy(by).agg(*[F.avg(F.col(d).cast("double")).alias(f"c_{d}") for d in dims])


def residuals(df: DataFrame, dims: list[str], by: str, keep: list[str]) -> DataFrame:
    """What each value differs from its group's centroid by: r_<dim>, with c_<dim>. One aggregate joined back, so a group
    of any size is never gathered in one task."""
    return df.join(centroids(df, dims, by), by).select(*keep, by, *[F.col(f"c_{d}") for d in dims], *[(F.col(d).cast("double") - F.col(f"c_{d}")).alias(f"r_{d}") for d in dims])


def reconstructed(df: DataFrame, dims: list[str], keep: list[str]) -> DataFrame:
    return df.select(*keep, *[(F.col(f"c_{d}") + F.col(f"r_{d}")).alias(d) for d in dims])


def vector_type() -> T.ArrayType:
    return T.ArrayType(T.FloatType(), False)
