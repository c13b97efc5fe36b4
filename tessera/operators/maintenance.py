"""Append, compaction and policy-driven maintenance of archives. Every step is a rewrite to a new version."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.schema import ROW_ID
from tessera.sources.archive import Archive, ArchiveError

from .layout import BuildConfig


class PolicyError(ValueError):
    pass


@dataclass(frozen=True)
class Policy:
    """Thresholds: pending rows, tombstones, and tombstones in basis points of base rows."""

    append_rows: int = 1024
    tombstones: int = 1024
    tombstone_ratio: int = 2500

    def __post_init__(self):
        if min(self.append_rows, self.tombstones, self.tombstone_ratio) < 1:
            raise PolicyError("thresholds are positive")


@dataclass(frozen=True)
class Decision:
    action: str
    reason: str
    base_rows: int
    pending_rows: int
    tombstones: int
    tombstone_ratio: int


def decide(policy: Policy, base: int, pending: int, tombstones: int) -> Decision:
    """What the policy asks for. Raw tombstones count, whether or not their ids exist."""
    if base < 1:
        raise PolicyError("no base rows")
    if base + pending > 2**63 - 1:
        raise PolicyError("too many rows")
    ratio = tombstones * 10_000 // base
    compact = "tombstone_count_reached" if tombstones >= policy.tombstones else "tombstone_ratio_reached" if ratio >= policy.tombstone_ratio else None
    if pending and compact:
        action, reason = "rebuild", "append_and_compaction_reached"
    elif pending >= policy.append_rows:
        action, reason = "rebuild", "append_rows_reached"
    elif pending:
        action, reason = "append", "pending_rows"
    elif compact:
        action, reason = "compact", compact
    else:
        action, reason = "none", "nothing_pending"
    return Decision(action, reason, base, pending, tombstones, ratio)


def inspect(archive: Archive, policy: Policy) -> Decision:
    """The decision, without writing."""
    m = archive.manifest
    return decide(policy, m.rows, m.delta_rows, m.tombstones)


def status(archive: Archive, policy: Policy) -> dict:
    """The decision and the footprint, without writing."""
    size = {r["section"]: r["bytes"] for r in archive.footprint().collect()}
    return {**asdict(inspect(archive, policy)), "bytes": sum(size.values()), "sections": size}


def rewrite(archive: Archive, rows: DataFrame, note: dict, keep_tombstones: bool, keep_delta: bool) -> Archive:
    """A new base version from `rows`. Leaves the former version's files in place; the manifest switches at the end."""
    m = archive.manifest
    carry = m
    if not keep_tombstones:
        carry = replace(carry, tombstones=0, tombstone_version=None)
    if not keep_delta:
        carry = replace(carry, delta_rows=0, delta_versions=())
    return Archive.create(archive.spark, archive.root, rows, m.schema, m.clustered_by, BuildConfig(**m.config), [*m.history, note], m.version + 1, m.dictionaries, carry)


def append(archive: Archive, new: DataFrame | None = None) -> Archive:
    """Base and new rows (or the pending delta) clustered afresh; tombstones stay. Ids must be new."""
    own = archive.data().select(ROW_ID, *archive.manifest.schema.names)
    more = archive.delta() if new is None else new
    if more is None:
        raise ArchiveError("nothing to append")
    n = more.count()
    return rewrite(archive, own.unionByName(more), {"action": "append", "rows": n}, True, new is not None)


def compact(archive: Archive) -> Archive:
    """Base without tombstoned rows, and no tombstones; it is an error if none is left."""
    gone = archive.tombstones()
    own = archive.data().select(ROW_ID, *archive.manifest.schema.names)
    left = own if gone is None else own.join(gone, ROW_ID, "left_anti")
    if not left.take(1):
        raise ArchiveError("compaction would leave no rows")
    return rewrite(archive, left, {"action": "compact", "removed": archive.manifest.rows - left.count()}, False, True)


def rebuild(archive: Archive) -> Archive:
    """Append the delta and drop tombstoned rows (of both) in one rewrite."""
    both = archive.data().select(ROW_ID, *archive.manifest.schema.names)
    if (d := archive.delta()) is not None:
        both = both.unionByName(d)
    if (gone := archive.tombstones()) is not None:
        both = both.join(gone, ROW_ID, "left_anti")
    if not both.take(1):
        raise ArchiveError("a rebuild would leave no rows")
    return rewrite(archive, both, {"action": "rebuild"}, False, False)


def maintain(archive: Archive, policy: Policy) -> tuple[Archive, Decision]:
    """Carry the policy's decision out."""
    d = inspect(archive, policy)
    run = {"append": append, "compact": compact, "rebuild": rebuild}.get(d.action)
    return (run(archive) if run else archive), d


def decisions(inputs: DataFrame, policy: Policy) -> DataFrame:
    """The policy over a frame of (base_rows, pending_rows, tombstones): many archives at once."""
    ratio = F.floor(F.col("tombstones") * 10_000 / F.col("base_rows"))
    many, share = F.col("tombstones") >= policy.tombstones, ratio >= policy.tombstone_ratio
    pending = F.col("pending_rows") > 0
    action = F.when(pending & ((many | share) | (F.col("pending_rows") >= policy.append_rows)), "rebuild").when(pending, "append").when(many | share, "compact").otherwise("none")
    reason = F.when(pending & (many | share), "append_and_compaction_reached").when(F.col("pending_rows") >= policy.append_rows, "append_rows_reached").when(pending, "pending_rows").when(many, "tombstone_count_reached").when(share, "tombstone_ratio_reached").otherwise("nothing_pending")
    return inputs.select("*", ratio.alias("tombstone_ratio"), action.alias("action"), reason.alias("reason"))


@dataclass(frozen=True)
class RebuildPlan:
    """What a rewrite reads and writes, checked for consistency before it runs."""

    base_rows: int
    appended: int
    removed: int

    def __post_init__(self):
        if self.base_rows < 1:
            raise PolicyError("no base rows")
        if min(self.appended, self.removed) < 0:
            raise PolicyError("negative counts")
        if self.appended == self.removed == 0:
            raise PolicyError("nothing to do")
        if self.removed >= self.base_rows + self.appended:
            raise PolicyError("no rows would be left")

    @property
    def resulting_rows(self) -> int:
        return self.base_rows + self.appended - self.removed


def planned_rewrite(archive: Archive) -> RebuildPlan:
    """The plan of a rebuild: ids that no row has don't count as removed."""
    rows = archive.data().select(ROW_ID)
    if (d := archive.delta()) is not None:
        rows = rows.union(d.select(ROW_ID))
    gone = archive.tombstones()
    return RebuildPlan(archive.manifest.rows, archive.manifest.delta_rows, 0 if gone is None else rows.join(gone, ROW_ID, "left_semi").count())
