"""A clustered table with its box hierarchy: numeric range execution under all output contracts, and validation."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tessera.functions.boxes import Box, any_of
from tessera.functions.schema import ROW_ID
from tessera.sources.store import Store

from . import layout
from .layout import BuildConfig


class InvalidIndex(ValueError):
    pass


@dataclass
class Index:
    """`rows`: row_id, leaf_id, row_index and one column for each dimension; `nodes`: the node table."""

    rows: DataFrame
    nodes: DataFrame
    dims: list[str]
    config: BuildConfig
    held: tuple[DataFrame, ...] = ()

    @classmethod
    def build(cls, points: DataFrame, dims: list[str], config: BuildConfig | None = None) -> Index:
        config = config or BuildConfig()
        clustered = layout.cluster(points, dims, config).persist()
        nodes = layout.node_table(clustered, dims).persist()
        ids = nodes.where("is_leaf").select("path", F.col("node_id").alias("leaf_id"))
        return cls(clustered.join(ids, "path").select(ROW_ID, "leaf_id", "row_index", *dims), nodes, dims, config, (clustered, nodes))

    @classmethod
    def checked(cls, points: DataFrame, dims: list[str], config: BuildConfig | None = None) -> Index:
        """Build, then raise with what violates the rules, if anything does."""
        out = cls.build(points, dims, config)
        bad = {r["check"]: r["violations"] for r in out.validation().collect() if r["violations"]}
        if bad:
            raise InvalidIndex(str(bad))
        return out

    @property
    def leaves(self) -> DataFrame:
        return self.nodes.where("is_leaf")

    def root(self) -> Row:
        return self.nodes.where("path = ''").first()

    def _fits(self, region: Box) -> None:
        if region.dimensions != len(self.dims):
            raise ValueError(f"a region of {region.dimensions} dimensions, an index of {len(self.dims)}")

    # --- traversal ---------------------------------------------------------------------------------------------------

    def retained(self, region: Box) -> DataFrame:
        """Leaves that the region meets, with coverage P or C."""
        self._fits(region)
        return self.leaves.withColumn("coverage", region.coverage(self.dims)).where("coverage <> 'D'")

    def visited(self, region: Box) -> DataFrame:
        """How many nodes a traversal looks at: the root; below it, the children of partial nodes, and all of covered
        ones."""
        self._fits(region)
        n = self.nodes.withColumn("cov", region.coverage(self.dims))
        p = n.select(F.col("node_id").alias("parent_id"), F.col("cov").alias("up"))
        root = n.where("path = ''").select(F.col("cov").alias("root")).first()["root"]
        if root != "P":  # decided at the root
            return n.where("path = ''").agg(F.count("*").alias("visited_nodes"))
        return n.join(p, "parent_id", "left").where("up is null or up <> 'D'").agg(F.count("*").alias("visited_nodes"))

    # --- output contracts --------------------------------------------------------------------------------------------

    def query(self, region: Box) -> DataFrame:
        """Rows in the region. The box itself reaches the scan, which skips row groups of clustered files."""
        self._fits(region)
        return self.rows.where(region.match(self.dims))

    def points(self, region: Box) -> DataFrame:
        return self.query(region).select(*self.dims)

    def references(self, region: Box) -> DataFrame:
        return self.query(region).select("leaf_id", "row_index")

    def dereference(self, refs: DataFrame) -> DataFrame:
        """Rows of references (leaf_id, row_index); further columns of refs, such as an ordinal, are kept."""
        return refs.join(self.rows, ["leaf_id", "row_index"])

    def visit(self, region: Box, visitor: Callable[[Row], None]) -> None:
        """Call the visitor with each row, a partition at a time."""
        for r in self.query(region).toLocalIterator():
            visitor(r)

    def count(self, region: Box) -> DataFrame:
        """Covered leaves count by their cardinality alone; only partial leaves are scanned."""
        kept = self.retained(region)
        covered = kept.where("coverage = 'C'").select(F.col("cardinality").alias("n"))
        partial = self.query(region).join(kept.where("coverage = 'P'").select(F.col("node_id").alias("leaf_id")), "leaf_id", "left_semi").select(F.lit(1).cast("long").alias("n"))
        return covered.union(partial).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("matches"))

    def exists(self, region: Box) -> bool:
        """True at the first covered leaf, else at the first row found."""
        return bool(self.retained(region).where("coverage = 'C'").take(1) or self.query(region).take(1))

    def exists_inspected(self, region: Box) -> DataFrame:
        """(has_match, inspected_rows): how many rows are looked at, leaf by leaf, until the first one that matches; in a
        covered leaf that is its first row. Without a match, all rows of the leaves that the region meets."""
        kept = self.retained(region).select(F.col("node_id").alias("leaf_id"), "cardinality")
        first = self.query(region).agg(F.min(F.struct("leaf_id", "row_index")).alias("first"))
        seen = F.when(F.col("first").isNull() | (F.col("leaf_id") < F.col("first.leaf_id")), F.col("cardinality")).when(F.col("leaf_id") == F.col("first.leaf_id"), F.col("first.row_index") + 1)
        looked = kept.join(first).agg(F.coalesce(F.sum(seen), F.lit(0)).cast("long").alias("inspected_rows"))  # first is one row
        return first.select(F.col("first").isNotNull().alias("has_match")).join(looked)

    def query_in_order(self, region: Box, parallel_from: int = 4) -> DataFrame:
        """Rows in the region in the order of their leaves. If it meets fewer than `parallel_from` leaves, one task reads
        them all; else the order is made by ranges of leaves."""
        got = self.query(region)
        few = self.retained(region).limit(parallel_from).count() < parallel_from
        return got.coalesce(1).sortWithinPartitions("leaf_id", "row_index") if few else got.orderBy("leaf_id", "row_index")

    def query_into(self, region: Box, buffer: list[Row]) -> None:
        """Replace the caller's buffer by the rows in the region; a partition is held at a time beside it."""
        buffer.clear()
        buffer.extend(self.query(region).toLocalIterator())

    def visit_references(self, region: Box, visitor: Callable[[int, int], None]) -> None:
        """Call the visitor with each row's leaf and place in it, a partition at a time."""
        for r in self.references(region).toLocalIterator():
            visitor(r["leaf_id"], r["row_index"])

    # --- files -------------------------------------------------------------------------------------------------------

    def save(self, path: str) -> None:
        """Rows by leaf, nodes, and a description with its length and checksum."""
        spark = self.nodes.sparkSession
        path = path.rstrip("/")
        self.rows.repartitionByRange("leaf_id").sortWithinPartitions("leaf_id", "row_index").write.mode("errorifexists").parquet(f"{path}/rows")
        self.nodes.write.mode("errorifexists").parquet(f"{path}/nodes")
        body = json.dumps({"magic": "tessera-index", "dims": self.dims, "config": asdict(self.config), "rows": self.rows.count(), "nodes": self.nodes.count()}, sort_keys=True)
        Store(spark, path).replace("index.json", json.dumps({"length": len(body), "crc32": zlib.crc32(body.encode()), "body": body}))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        """An index as saved; raises if its description is damaged or doesn't fit its rows and nodes."""
        path = path.rstrip("/")
        envelope = json.loads(Store(spark, path).read("index.json"))
        body = envelope["body"]
        if (len(body), zlib.crc32(body.encode())) != (envelope["length"], envelope["crc32"]):
            raise InvalidIndex("the description's length or checksum is wrong")
        d = json.loads(body)
        out = cls(spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/nodes"), d["dims"], BuildConfig(**d["config"]))
        if d["magic"] != "tessera-index" or (out.rows.count(), out.nodes.count()) != (d["rows"], d["nodes"]):
            raise InvalidIndex("rows or nodes aren't what the description says")
        return out

    def release(self) -> None:
        """Give up what `build` holds in memory."""
        for df in self.held:
            df.unpersist()

    def stats(self, region: Box) -> DataFrame:
        """One row: visited nodes, leaves, records and ratios of a traversal."""
        kept = self.retained(region)
        whole = self.nodes.where("path = ''").withColumn("root", region.coverage(self.dims)).select("root", F.col("cardinality").alias("total_records"))
        leaves = self.leaves.agg(F.count("*").alias("total_leaves"))
        held = kept.agg(F.count("*").alias("retained_leaves"), F.coalesce(F.sum("cardinality"), F.lit(0)).alias("reconstructed_records"), F.count_if(F.col("coverage") == "C").alias("covered_leaves"))
        got = self.query(region).agg(F.count("*").alias("matched_records"))
        one = self.visited(region)
        for part in (whole, leaves, held, got):
            one = one.join(part)  # each side is one row
        return one.select(
            "visited_nodes", "total_leaves", "retained_leaves", "covered_leaves", (F.col("retained_leaves") / F.col("total_leaves")).alias("retained_leaf_ratio"), "total_records", "reconstructed_records", "matched_records",
            (F.col("reconstructed_records") / F.col("total_records")).alias("candidate_ratio"), (F.col("total_records") - F.col("reconstructed_records")).alias("records_pruned"),
        )

    # --- validation --------------------------------------------------------------------------------------------------

    def violations(self) -> dict[str, DataFrame]:
        """The violating items of each check."""
        dims, n = self.dims, self.nodes
        up = n.select(F.col("node_id").alias("parent_id"), F.col("is_leaf").alias("p_leaf"), *[F.col(f"{m}_{d}").alias(f"p_{m}_{d}") for d in dims for m in ("min", "max")])
        kids = n.where("path <> ''")
        sums = kids.groupBy(F.col("parent_id").alias("node_id")).agg(F.sum("cardinality").alias("of_children"), F.count("*").alias("children"))
        leaf = self.leaves.select(F.col("node_id").alias("leaf_id"), "cardinality", *[f"{m}_{d}" for d in dims for m in ("min", "max")])
        real = self.rows.groupBy("leaf_id").agg(F.count("*").alias("rows"), F.countDistinct("row_index").alias("places"), F.max("row_index").alias("last"))
        return {
            "node_ids": n.groupBy("node_id").count().where("count > 1 or node_id is null"),
            "dimensions": n.where(any_of([F.col(f"{m}_{d}").isNull() | F.isnan(f"{m}_{d}") for d in dims for m in ("min", "max")] + [F.col(f"min_{d}") > F.col(f"max_{d}") for d in dims])),
            "leaf_cardinality": self.leaves.where(F.col("cardinality") > self.config.max_leaf).select("node_id", "cardinality"),
            "leaf_shapes": leaf.join(real, "leaf_id", "full").where("cardinality is null or rows is null or rows <> cardinality or places <> rows or last <> rows - 1").select("leaf_id", "cardinality", "rows"),
            "leaf_rows_in_bounds": self.rows.join(leaf, "leaf_id").where(any_of([(F.col(d) < F.col(f"min_{d}")) | (F.col(d) > F.col(f"max_{d}")) for d in dims])).select(ROW_ID, "leaf_id"),
            "ownership": n.join(sums, "node_id", "left").where("(is_leaf and children is not null) or (not is_leaf and (of_children is null or of_children <> cardinality))").select("node_id"),
            "topology": kids.join(up, "parent_id", "left").where("p_leaf is null or p_leaf").select("node_id", "parent_id"),
            "parent_bounds": kids.join(up, "parent_id").where(any_of([(F.col(f"min_{d}") < F.col(f"p_min_{d}")) | (F.col(f"max_{d}") > F.col(f"p_max_{d}")) for d in dims])).select("node_id", "parent_id"),
        }

    def validation(self) -> DataFrame:
        """(check, violations) of all eight checks."""
        out = None
        for name, bad in self.violations().items():
            one = bad.agg(F.lit(name).alias("check"), F.count("*").alias("violations"))
            out = one if out is None else out.union(one)
        return out
