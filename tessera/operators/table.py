"""Typed tables: a base, an optional pending delta, optional row tombstones, and every output contract over them.

One logical plan serves all: (base union delta) without tombstones, filtered by the exact typed predicate. Contracts are
projections or actions of it; the planner decides whether leaf boxes are used to skip data first.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tessera.functions.encoders import Dictionary
from tessera.functions.schema import ROW_ID, Kind, RecordError, Schema, SchemaError
from tessera.plans.planner import Choice, Contract, Statistics, choose

from .predicates import Plan, Predicate, plan

#: Tombstones are broadcast only up to so many ids (8 bytes each), by count.
BROADCAST_IDS = 2_000_000


class DeltaError(ValueError):
    pass


@dataclass(frozen=True)
class Part:
    """A folder of a clustered table: rows, closed bounds of each field in its own type, rows in which a field is null."""

    part: int
    rows: int
    bounds: dict[str, tuple]
    nulls: dict[str, int]

    def lies(self, p: Plan) -> str:
        """How its rows lie to a plan: D (none can match), C (all match) or P."""
        asked = {**p.box, **{n: (x, x) for n, x in p.labels.items() if p.schema[n].kind is Kind.CATEGORY}}
        covered = all(q.field in asked for q in p.predicates)
        for name, (low, high) in asked.items():
            if name not in self.bounds:  # null in all rows
                return "D"
            least, most = self.bounds[name]
            if most < low or least > high:
                return "D"
            covered &= low <= least and most <= high and not self.nulls.get(name)
        return "C" if covered else "P"


@dataclass
class Table:
    """`base` and `delta` are typed frames (row_id, fields). `parts`: boxes of the base's folders, if it is clustered;
    then the base has a partition column `part`."""

    schema: Schema
    base: DataFrame
    delta: DataFrame | None = None
    tombstones: DataFrame | None = None
    dictionaries: dict[str, Dictionary] = field(default_factory=dict)
    statistics: Statistics | None = None
    parts: tuple[Part, ...] = ()
    pending: int | None = None

    def with_delta(self, delta: DataFrame | None, check: bool = True) -> Table:
        """A view with pending rows: same schema, not empty, no id of the base."""
        if delta is not None and check:
            if [f.name for f in delta.schema.fields] != [ROW_ID, *self.schema.names] or [f.dataType for f in delta.schema.fields] != [f.dataType for f in self.schema.spark().fields]:
                raise SchemaError("the delta's schema isn't the table's")
            if not delta.take(1):
                raise DeltaError("an empty delta")
            if clash := delta.select(ROW_ID).join(self.base.select(ROW_ID), ROW_ID, "left_semi").take(1):
                raise RecordError(f"row id {clash[0][0]} is in base and delta")
            if twice := delta.groupBy(ROW_ID).count().where("count > 1").take(1):
                raise RecordError(f"row id {twice[0][0]} is in the delta twice")
        return replace(self, delta=delta, pending=None)

    def with_tombstones(self, ids: DataFrame | None) -> Table:
        """A view without some ids, of base and delta alike; unknown and repeated ids do no harm."""
        return replace(self, tombstones=None if ids is None else ids.select(F.col(ids.columns[0]).cast("long").alias(ROW_ID)).distinct())

    # --- plans -------------------------------------------------------------------------------------------------------

    def plan(self, predicates: list[Predicate]) -> Plan:
        known = self.dictionaries
        if self.delta is not None and known:  # labels that only the delta has can be asked for
            asked = {p.validated(self.schema).field: p.low for p in predicates if p.resolve(self.schema).kind is Kind.CATEGORY}
            known = {k: Dictionary([*d.labels, v]) if (v := asked.get(k)) is not None and v not in d.labels and self.delta.where(F.col(k) == v).take(1) else d for k, d in known.items()}
        return plan(self.schema, predicates, known)

    def explain(self, predicates: list[Predicate], contract: Contract) -> Choice:
        if self.statistics is None:
            raise ValueError("the table has no statistics")
        return choose(self.plan(predicates), self.statistics, contract, self._pending())

    def _visible(self, df: DataFrame) -> DataFrame:
        if self.tombstones is None:
            return df
        gone = self.tombstones
        if gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
            gone = F.broadcast(gone)
        return df.join(gone, ROW_ID, "left_anti")

    def _lies(self, p: Plan, kind: str) -> list[Part]:
        return [x for x in self.parts if x.lies(p) in kind]

    def _only(self, parts: list[Part]) -> DataFrame:
        """The base restricted to some of its parts: other folders aren't listed or read."""
        return self.base if len(parts) == len(self.parts) else self.base.where(F.col("part").isin([x.part for x in parts]))

    def _pruned(self, p: Plan) -> DataFrame:
        """The base restricted to parts whose boxes the plan meets; the plan is resolved on the boxes, without a job."""
        return self._only(self._lies(p, "PC")) if self.parts and not p.unsatisfiable else self.base

    def _traverses(self, p: Plan, contract: Contract) -> bool:
        return self.statistics is not None and choose(p, self.statistics, contract, self._pending()).strategy in ("traversal", "hybrid")

    def _pending(self) -> int:
        """Pending rows, counted once."""
        if self.pending is None:
            self.pending = 0 if self.delta is None else self.delta.count()
        return self.pending

    def _source(self, p: Plan, contract: Contract, planned: bool) -> DataFrame:
        base = self._pruned(p) if planned and self._traverses(p, contract) else self.base
        out = base.select(ROW_ID, *self.schema.names)
        return out if self.delta is None else out.unionByName(self.delta)

    def _split(self, p: Plan, planned: bool) -> tuple[int, Table] | None:
        """For a planned query that needs no rows: how many rows of covered parts match without a look at them, and the
        table that is left to look at. Tombstones may lie anywhere, so there must be none."""
        if not planned or not self.parts or self.tombstones is not None or p.unsatisfiable:
            return None
        return sum(x.rows for x in self._lies(p, "C")), replace(self, base=self._only(self._lies(p, "P")), parts=())

    # --- contracts ---------------------------------------------------------------------------------------------------

    def scan(self) -> DataFrame:
        """All visible rows."""
        out = self.base.select(ROW_ID, *self.schema.names)
        return self._visible(out if self.delta is None else out.unionByName(self.delta))

    def rows(self, predicates: list[Predicate], planned: bool = False, contract: Contract = Contract.ROWS) -> DataFrame:
        p = self.plan(predicates)
        return self._visible(self._source(p, contract, planned).where(p.column()))

    def row_ids(self, predicates: list[Predicate], planned: bool = False) -> DataFrame:
        return self.rows(predicates, planned, Contract.ROW_IDS).select(ROW_ID)

    def count(self, predicates: list[Predicate], planned: bool = False) -> DataFrame:
        """Planned, parts that the predicates cover count by their number of rows; the rest alone is read."""
        p = self.plan(predicates)
        covered, left = self._split(p, planned) or (0, None)
        rows = left.rows(predicates) if left is not None else self.rows(predicates, planned, Contract.COUNT)
        return rows.agg((F.count("*") + covered).alias("matches"))

    def exists(self, predicates: list[Predicate], planned: bool = False) -> DataFrame:
        """Planned, a covered part decides without a row being read."""
        p = self.plan(predicates)
        covered, left = self._split(p, planned) or (0, None)
        if covered:
            return self.base.sparkSession.range(1).select(F.lit(True).alias("has_match"))
        rows = left.rows(predicates) if left is not None else self.rows(predicates, planned, Contract.EXISTS)
        return rows.limit(1).agg((F.count("*") > 0).alias("has_match"))

    def visit_row_ids(self, predicates: list[Predicate], visitor: Callable[[int], None], planned: bool = False) -> None:
        for r in self.rows(predicates, planned, Contract.VISIT_ROW_IDS).select(ROW_ID).toLocalIterator():
            visitor(r[ROW_ID])

    def visit_rows(self, predicates: list[Predicate], visitor: Callable[[Row], None], planned: bool = False) -> None:
        for r in self.rows(predicates, planned, Contract.VISIT_ROWS).toLocalIterator():
            visitor(r)

    def stats(self, predicates: list[Predicate], planned: bool = False) -> DataFrame:
        """One row: records in all, candidates (after boxes, plus the whole delta), matches, candidate ratio. A planned
        query that needs no work reports zeros; an unsatisfiable unplanned one reports totals."""
        p = self.plan(predicates)
        spark = self.base.sparkSession
        if planned and self.statistics is not None and choose(p, self.statistics, Contract.ROW_IDS, 0).strategy == "no_op" and self.delta is None:
            return spark.range(1).select(*[F.lit(0).cast("long").alias(c) for c in ("total_records", "candidate_records", "matched_records")], F.lit(0.0).alias("candidate_ratio"))
        extra = self._pending()
        total = self.base.agg((F.count("*") + extra).alias("total_records"))
        use_boxes = not planned or self.statistics is None or choose(p, self.statistics, Contract.ROW_IDS, extra).strategy != "flat_scan"
        if p.unsatisfiable:
            seen = spark.range(1).select(F.lit(0).cast("long").alias("candidate_records"))
        elif use_boxes and self.parts:
            seen = spark.range(1).select(F.lit(sum(x.rows for x in self._lies(p, "PC")) + extra).cast("long").alias("candidate_records"))
        else:
            seen = self.base.agg((F.count("*") + extra).alias("candidate_records"))
        got = self.rows(predicates).agg(F.count("*").alias("matched_records"))
        return total.join(seen).join(got).select("total_records", "candidate_records", "matched_records", F.when(F.col("total_records") > 0, F.col("candidate_records") / F.col("total_records")).otherwise(0.0).alias("candidate_ratio"))

    def record(self, row_id: int) -> DataFrame:
        """The record of one row id, or none."""
        return self.scan().where(F.col(ROW_ID) == row_id)

    def value_of(self, row_id: int, name: str | int) -> DataFrame:
        """One field of one record."""
        return self.record(row_id).select(self.schema[name].name)


def statistics_of(base: DataFrame, schema: Schema, dictionaries: dict[str, Dictionary], nodes: int, leaves: int) -> Statistics:
    """One aggregate for the bounds, one for each category's frequencies."""
    fields = [f for f in schema.fields if f.kind.ranged or f.kind is Kind.CATEGORY]
    agg = base.agg(F.count("*").alias("n"), *[g(f.name).alias(f"{k}_{f.name}") for f in fields if f.kind.ranged for k, g in (("a", F.min), ("b", F.max))]).first()
    freq = {f.name: {r[f.name]: r["count"] for r in base.where(F.col(f.name).isNotNull()).groupBy(f.name).count().collect()} for f in fields if f.kind is Kind.CATEGORY}  # at most MOST_LABELS each, as dictionaries hold
    root = {}
    for f in fields:
        if f.kind.ranged:
            if agg[f"a_{f.name}"] is not None:
                root[f.name] = (agg[f"a_{f.name}"], agg[f"b_{f.name}"])
        elif freq[f.name]:
            codes = [dictionaries[f.name].code(x) for x in freq[f.name]]
            root[f.name] = (min(codes), max(codes))
    return Statistics(agg["n"], nodes, leaves, root, freq, {k: list(d.labels) for k, d in dictionaries.items()})
