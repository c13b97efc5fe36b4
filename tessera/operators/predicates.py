"""Typed predicates: equality and closed ranges, their validation, and conjunctions.

The exact typed predicate is the only source of truth; boxes may skip data but never decide.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.boxes import all_of
from tessera.functions.encoders import Dictionary
from tessera.functions.schema import Field, Kind, Schema, SchemaError, finite


class PredicateError(ValueError):
    """Base of all validation errors."""


class UnknownField(PredicateError):
    pass


class NullLiteral(PredicateError):
    pass


class TypeMismatch(PredicateError):
    pass


class NotFinite(PredicateError):
    pass


class RangeUnsupported(PredicateError):
    pass


class InvertedRange(PredicateError):
    pass


class UnknownCategory(PredicateError):
    pass


class NotIndexable(PredicateError):
    pass


class EmptyConjunction(PredicateError):
    pass


@dataclass(frozen=True)
class Predicate:
    """`field` by name or by number; `low` and `high` are both bounds of a closed range, equal for an equality."""

    field: str | int
    low: object
    high: object
    is_range: bool

    @classmethod
    def equals(cls, field: str | int, value: object) -> Predicate:
        return cls(field, value, value, False)

    @classmethod
    def range(cls, field: str | int, low: object, high: object) -> Predicate:
        return cls(field, low, high, True)

    def resolve(self, schema: Schema) -> Field:
        try:
            return schema[self.field]
        except SchemaError as e:
            raise UnknownField(str(e)) from None

    def validated(self, schema: Schema) -> Predicate:
        """This predicate with its field by name, or the error that it has."""
        f = self.resolve(schema)
        for v in (self.low, self.high):
            if v is None:
                raise NullLiteral(f"field {f.name!r}: null never matches")
            if not f.kind.accepts(v):
                raise TypeMismatch(f"field {f.name!r} is {f.kind.value}, the literal {v!r} isn't")
            if not finite(v):
                raise NotFinite(f"field {f.name!r}: {v!r}")
        if self.is_range:
            if not f.kind.ranged:
                raise RangeUnsupported(f"field {f.name!r}: {f.kind.value} has no ranges")
            if self.low > self.high:
                raise InvertedRange(f"field {f.name!r}: {self.low!r} > {self.high!r}")
        return Predicate(f.name, self.low, self.high, self.is_range)

    def column(self) -> Column:
        c = F.col(self.field)
        return c.between(self.low, self.high) if self.is_range else c == F.lit(self.low)


@dataclass(frozen=True)
class Plan:
    """A validated conjunction. `box`: closed bounds of each constrained numeric field, in the field's own type;
    `labels`: the label of each constrained category."""

    schema: Schema
    predicates: tuple[Predicate, ...]
    box: dict[str, tuple] = field(default_factory=dict)
    labels: dict[str, str] = field(default_factory=dict)
    unsatisfiable: bool = False

    def column(self) -> Column:
        """The exact row check; a contradiction folds to false, so that Catalyst plans an empty relation."""
        return F.lit(False) if self.unsatisfiable else all_of([p.column() for p in self.predicates])


def plan(schema: Schema, predicates: list[Predicate], dictionaries: dict[str, Dictionary] | None = None, indexed: bool = True) -> Plan:
    """Conjunction of predicates: at least one; ranges on a field intersect. With `indexed`, only kinds that an index
    holds are allowed, and categories must be known to their dictionary (if given)."""
    if not predicates:
        raise EmptyConjunction("no predicate; use scan() for all rows")
    box: dict[str, tuple] = {}
    labels: dict[str, str] = {}
    empty = False
    own = [p.validated(schema) for p in predicates]
    for p in own:
        kind = schema[p.field].kind
        if kind.ranged:
            low, high = box.get(p.field, (p.low, p.high))
            low, high = max(low, p.low), min(high, p.high)
            box[p.field] = (low, high)
            empty |= low > high
        elif kind is Kind.CATEGORY:
            known = (dictionaries or {}).get(p.field)
            if known is not None and p.low not in known.labels:
                raise UnknownCategory(f"field {p.field!r}: {p.low!r}")
            empty |= labels.setdefault(p.field, p.low) != p.low
        elif indexed:
            raise NotIndexable(f"field {p.field!r}: {kind.value} predicates can't be planned")
        else:
            empty |= labels.setdefault(p.field, p.low) != p.low
    return Plan(schema, tuple(own), box, labels, empty)
