"""Versioned on-disk tables.

A table is a folder: `manifest.json`, `v=N/data` (row_id, fields, leaf_id, row_index; a folder for each `part`, a run of
leaves; clustered by leaf), `v=N/nodes`, `v=N/tombstones`, and `v=N/delta` for each pending batch. The manifest holds the
boxes of the parts, at most `PARTS` of them, in the fields' own types: a query that meets some of them only lists and
reads their folders. Every change writes a new version and then replaces the manifest in one rename, so a failure leaves
the former version in place; files of former versions can be deleted with `vacuum`. Files go through Hadoop's file
system, so any store that Spark reads will do.
"""

from __future__ import annotations

import json
import time
import zlib
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.encoders import MOST_LABELS, Dictionary, DimensionMapping, RecordEncoder
from tessera.functions.schema import ROW_ID, Kind, Schema, SchemaError, validate
from tessera.operators import layout
from tessera.operators.layout import BuildConfig
from tessera.operators.table import Part, Table, statistics_of
from tessera.plans.planner import Statistics
from tessera.sources.store import ArchiveError, Store

FORMAT, MAGIC = 2, "tessera-table"
#: Parts of a table's data at most; rows of a part, about, in tables of more than a few parts. Each part is a folder that
#: is listed, opened and committed by itself, so that small ones cost more than they let a query skip.
PARTS, PART_ROWS, FEW_PARTS = 4096, 100_000, 64
KINDS = ("typed",)


@dataclass(frozen=True)
class Manifest:
    version: int
    schema: Schema
    dictionaries: dict[str, Dictionary]
    clustered_by: list[str]
    rows: int
    delta_rows: int
    tombstones: int
    content: str
    statistics: Statistics
    config: dict
    history: list[dict] = field(default_factory=list)
    delta_versions: tuple[int, ...] = ()
    tombstone_version: int | None = None
    parts: tuple[Part, ...] = ()
    base_version: int = 1
    kind: str = "typed"
    mapping: tuple[tuple[str, tuple[int, ...]], ...] = ()
    sections: dict[str, list[int]] = field(default_factory=dict)

    def to_json(self) -> str:
        s = self.statistics
        d = {k: getattr(self, k) for k in ("version", "base_version", "kind", "clustered_by", "rows", "delta_rows", "tombstones", "content", "config", "history", "delta_versions", "tombstone_version", "mapping", "sections")}
        d |= {"magic": MAGIC, "format": FORMAT, "schema": self.schema.to_dict(), "dictionaries": {k: list(x.labels) for k, x in self.dictionaries.items()}, "parts": [asdict(p) for p in self.parts], "statistics": asdict(s)}
        body = json.dumps(d, indent=1, sort_keys=True)
        return json.dumps({"length": len(body.encode()), "crc32": zlib.crc32(body.encode()), "body": d}, indent=1, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Manifest:
        try:
            envelope = json.loads(text)
        except json.JSONDecodeError as e:
            raise ArchiveError(f"not a manifest: {e}") from None
        d = envelope.get("body") if isinstance(envelope, dict) else None
        if not isinstance(d, dict) or d.get("magic") != MAGIC:
            raise ArchiveError("not a table")
        if d.get("format") != FORMAT:
            raise ArchiveError(f"format {d.get('format')}, this is {FORMAT}")
        body = json.dumps(d, indent=1, sort_keys=True).encode()
        if (len(body), zlib.crc32(body)) != (envelope.get("length"), envelope.get("crc32")):
            raise ArchiveError("the manifest's length or checksum is wrong")
        if d["kind"] not in KINDS:
            raise ArchiveError(f"a table of kind {d['kind']!r}")
        schema, s = Schema.from_dict(d["schema"]), d["statistics"]
        statistics = Statistics(s["rows"], s["nodes"], s["leaves"], {k: tuple(v) for k, v in s["root"].items()}, s["frequencies"], s["dictionary"])
        parts = tuple(Part(p["part"], p["rows"], {k: tuple(v) for k, v in p["bounds"].items()}, p["nulls"]) for p in d["parts"])
        same = {k: d[k] for k in ("version", "base_version", "kind", "clustered_by", "rows", "delta_rows", "tombstones", "content", "config", "history", "tombstone_version", "sections")}
        out = cls(schema=schema, dictionaries={k: Dictionary(v) for k, v in d["dictionaries"].items()}, statistics=statistics, parts=parts, delta_versions=tuple(d["delta_versions"]), mapping=tuple((n, tuple(x)) for n, x in d["mapping"]), **same)
        if out.version < 1 or out.rows < 1 or min(out.delta_rows, out.tombstones) < 0 or not 1 <= out.base_version <= out.version:
            raise ArchiveError("impossible counts")
        if set(out.clustered_by) - set(schema.names):
            raise ArchiveError("clustered by unknown fields")
        if out.statistics.leaves > out.statistics.nodes or out.statistics.rows != out.rows or sum(p.rows for p in parts) != out.rows:
            raise ArchiveError("statistics don't fit")
        return out


def content_hash(df: DataFrame) -> DataFrame:
    """An order-free hash of the rows, repeated ones counted as often as they occur: the sum of the rows' hashes modulo
    2**64, as digits; with the number of rows."""
    total = F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(20,0)")), F.lit(0).cast("decimal(30,0)"))
    return df.agg(F.count("*").alias("rows"), F.pmod(total, F.lit(str(2**64)).cast("decimal(30,0)")).cast("string").alias("content"))


def labels_of(df: DataFrame, name: str) -> Dictionary:
    """A category's labels in alphabetical order, at most MOST_LABELS."""
    rows = df.select(name).where(F.col(name).isNotNull()).distinct().limit(MOST_LABELS + 1).collect()
    if len(rows) > MOST_LABELS:
        raise SchemaError(f"field {name!r} has over {MOST_LABELS} labels: make it a text")
    return Dictionary(sorted(r[0] for r in rows) or ["?"])


def parts_of(written: DataFrame, schema: Schema) -> tuple[Part, ...]:
    """Rows, bounds and nulls of each part of a table's data, in one aggregate and one for each category; at most PARTS
    rows."""
    names = [f.name for f in schema.fields if f.kind.ranged or f.kind is Kind.CATEGORY]
    ends = lambda n, i: [F.min(n).alias(f"a{i}"), F.max(n).alias(f"b{i}")]
    aggs = [x for i, n in enumerate(names) if schema[n].kind.ranged for x in ends(f"`{n}`", i)]
    aggs += [F.count_if(F.col(f"`{n}`").isNull()).alias(f"n{i}") for i, n in enumerate(names)]
    # the least and the last of texts take a sort of what they are taken from: of the labels of a part, not of its rows
    texts = {i: {r["part"]: r for r in written.groupBy("part", f"`{n}`").count().groupBy("part").agg(*ends(f"`{n}`", i)).collect()} for i, n in enumerate(names) if not schema[n].kind.ranged}
    out = []
    for r in written.groupBy("part").agg(F.count("*").alias("rows"), *aggs).collect():
        own = lambda i, r=r: texts[i][r["part"]] if i in texts else r
        bounds = {n: (own(i)[f"a{i}"], own(i)[f"b{i}"]) for i, n in enumerate(names) if own(i)[f"a{i}"] is not None}
        out.append(Part(r["part"], r["rows"], bounds, {n: r[f"n{i}"] for i, n in enumerate(names) if r[f"n{i}"]}))
    return tuple(sorted(out, key=lambda p: p.part))


@dataclass
class Archive:
    spark: SparkSession
    root: str
    manifest: Manifest
    listed: dict[int, DataFrame] = field(default_factory=dict)

    # --- writing ----------------------------------------------------------------------------------------------------

    @classmethod
    def create(cls, spark: SparkSession, root: str, df: DataFrame, schema: Schema, clustered_by: list[str] | None = None, config: BuildConfig | None = None, history: list[dict] | None = None, version: int = 1, dictionaries: dict[str, Dictionary] | None = None, carry: Manifest | None = None, mapping: DimensionMapping | None = None) -> Archive:
        """Cluster, write a version, and publish its manifest. A mapping says which fields make the dimensions that rows
        are clustered by, in order and possibly more than once; else they are the fields of `clustered_by`."""
        began = time.perf_counter()
        validate(df, schema)
        config = config or BuildConfig(max_leaf=250_000)
        if mapping is not None:
            by = [mapping.field_of(i) for i in range(mapping.dimensions)]
        else:
            by = clustered_by or [f.name for f in schema.fields if f.kind.indexable][:8]
        if bad := [n for n in by if not schema[n].kind.indexable]:
            raise SchemaError(f"can't cluster by {bad}")
        once = list(dict.fromkeys(by))
        encoder = RecordEncoder.from_batch(df, Schema([schema[n] for n in once]))
        if dictionaries:  # keep the order of labels that are known
            encoder = RecordEncoder(encoder.schema, {k: Dictionary([*dictionaries[k].labels, *[x for x in d.labels if x not in dictionaries[k].labels]]) if k in dictionaries else d for k, d in encoder.dictionaries.items()})
        encoder.encode(df)  # raises on what can't be encoded
        dims = [f"__x{i}" for i in range(len(by))]
        names = [f"__f{i}" for i in range(len(schema.names))]
        own = df.select(ROW_ID, *[F.col(f"`{n}`").alias(k) for n, k in zip(schema.names, names, strict=True)], *[encoder.column(n).alias(d) for n, d in zip(by, dims, strict=True)])
        top = f"{root.rstrip('/')}/v={version}"
        # rows move once, to the task that splits their coarse node; leaves are numbered and parted as they lie
        layout.cluster(own, dims, config).write.mode("overwrite").parquet(f"{top}/placed")
        placed = spark.read.parquet(f"{top}/placed")
        layout.node_table(placed, dims).write.mode("overwrite").parquet(f"{top}/nodes")
        nodes = spark.read.parquet(f"{top}/nodes")
        count = nodes.agg(F.count("*").alias("n"), F.count_if("is_leaf").alias("l"), F.max("cardinality").alias("rows"), F.max("node_id").alias("last")).first()
        parts = min(PARTS, count["l"], max(FEW_PARTS, -(-count["rows"] // PART_ROWS)))
        ids = nodes.where("is_leaf").select("path", F.col("node_id").alias("leaf_id"), F.floor(F.col("node_id") * parts / (count["last"] + 1)).cast("int").alias("part"))
        ids = F.broadcast(ids) if count["l"] <= layout.BROADCAST_NODES else ids
        data = placed.join(ids, "path").select(ROW_ID, *[F.col(k).alias(n, metadata={"kind": schema[n].kind.value}) for n, k in zip(schema.names, names, strict=True)], "leaf_id", "row_index", "part")
        data.sortWithinPartitions("part", "leaf_id", "row_index").write.mode("overwrite").partitionBy("part").parquet(f"{top}/data")
        Store(spark, root).delete(f"v={version}/placed")
        written = spark.read.parquet(f"{top}/data")
        h = content_hash(written.select(ROW_ID, *schema.names)).first()
        every = {f.name: encoder.dictionaries.get(f.name) or labels_of(df, f.name) for f in schema.fields if f.kind is Kind.CATEGORY}
        note = {"action": "create", "rows": h["rows"]}
        m = Manifest(
            version, schema, every, once, h["rows"], 0, 0, h["content"], statistics_of(written, schema, every, count["n"], count["l"]), {"max_leaf": config.max_leaf, "max_depth": config.max_depth, "target_leaf": config.target_leaf, "exact_rows": config.exact_rows},
            history or [note], parts=parts_of(written, schema), base_version=version, mapping=tuple((n, tuple(i for i, x in enumerate(by) if x == n)) for n in once),
        )
        m.history[-1].update(base=version, rows_written=h["rows"], seconds=round(time.perf_counter() - began, 3))
        if carry is not None:
            m = replace(m, delta_rows=carry.delta_rows, delta_versions=carry.delta_versions, tombstones=carry.tombstones, tombstone_version=carry.tombstone_version)
        return cls(spark, root.rstrip("/"), m, {version: written})._publish()

    def _publish(self) -> Archive:
        """Write the manifest, with the length in bytes and the number of files of each section."""
        store = Store(self.spark, self.root)
        sections = {k: list(store.size(v)) for k, v in self.places().items() if k != "manifest"}
        self.manifest = replace(self.manifest, sections=sections)
        store.replace("manifest.json", self.manifest.to_json())
        return self

    @classmethod
    def load(cls, spark: SparkSession, root: str, check: bool = False) -> Archive:
        """Open a table. The manifest's kind, format, length and checksum are verified, and that each section has the
        bytes and files that it names; with `check`, the content is hashed and compared too."""
        out = cls(spark, root.rstrip("/"), Manifest.from_json(Store(spark, root).read("manifest.json")))
        if wrong := [r["section"] for r in out.inspect().collect() if not r["intact"]]:
            raise ArchiveError(f"sections {wrong} aren't what the manifest says")
        if check:
            h = content_hash(out.data().select(ROW_ID, *out.manifest.schema.names)).first()
            if (h["rows"], h["content"]) != (out.manifest.rows, out.manifest.content):
                raise ArchiveError("the content isn't what the manifest says")
        return out

    def inspect(self) -> DataFrame:
        """(section, bytes, files, intact) without reading any data."""
        store = Store(self.spark, self.root)
        rows = []
        for k, v in self.places().items():
            size = store.size(v)
            rows.append((k, *size, k == "manifest" or list(size) == self.manifest.sections.get(k)))
        return self.spark.createDataFrame(rows, "section string, bytes long, files long, intact boolean")

    def places(self) -> dict[str, str]:
        m = self.manifest
        out = {"manifest": "manifest.json", "data": f"v={m.base_version}/data", "nodes": f"v={m.base_version}/nodes"}
        out |= {"delta" if i == 0 else f"delta {i}": f"v={v}/delta" for i, v in enumerate(m.delta_versions)}
        return out | ({"tombstones": f"v={m.tombstone_version}/tombstones"} if m.tombstone_version and m.tombstones else {})

    def vacuum(self) -> list[str]:
        """Delete the files of former versions that this one doesn't use; readers of those versions lose them."""
        store = Store(self.spark, self.root)
        used = {v.rsplit("/", 1)[0] for v in self.places().values()} | {self.places()["manifest"]}
        gone = [n for n in store.names() if n.startswith("v=") and n not in used]
        for n in gone:
            store.delete(n)
        return gone

    def put_delta(self, df: DataFrame) -> Archive:
        """Add a pending batch: same schema, no id of base or delta. Only the batch is written; the ids of the table are
        read within the batch's range of ids alone."""
        m = self.manifest
        validate(df, m.schema)
        low, high = df.agg(F.min(ROW_ID), F.max(ROW_ID)).first()
        if low is None:
            raise ArchiveError("an empty delta")
        old = self.delta()
        known = self.data().select(ROW_ID) if old is None else self.data().select(ROW_ID).union(old.select(ROW_ID))
        if clash := df.select(ROW_ID).join(known.where(F.col(ROW_ID).between(low, high)), ROW_ID, "left_semi").take(1):
            raise ArchiveError(f"row id {clash[0][0]} is there already")
        v = m.version + 1
        df.select(ROW_ID, *m.schema.names).write.mode("overwrite").parquet(f"{self.root}/v={v}/delta")
        n = self.spark.read.parquet(f"{self.root}/v={v}/delta").count()
        return self._next(v, delta_rows=m.delta_rows + n, delta_versions=(*m.delta_versions, v), note={"action": "delta", "rows": n})

    def put_tombstones(self, ids: DataFrame) -> Archive:
        """Add tombstones: none or repeated ids in the request are errors, ids there already are merged."""
        own = ids.select(F.col(ids.columns[0]).cast("long").alias(ROW_ID))
        if not own.take(1):
            raise ArchiveError("no tombstones")
        if twice := own.groupBy(ROW_ID).count().where("count > 1").take(1):
            raise ArchiveError(f"tombstone {twice[0][0]} is there twice")
        old = self.tombstones()
        v = self.manifest.version + 1
        (own if old is None else old.union(own).distinct()).write.mode("overwrite").parquet(f"{self.root}/v={v}/tombstones")
        n = self.spark.read.parquet(f"{self.root}/v={v}/tombstones").count()
        return self._next(v, tombstones=n, tombstone_version=v, note={"action": "tombstones", "rows": n})

    def _next(self, version: int, note: dict, **changes) -> Archive:
        """A new manifest version over the same base files."""
        m = replace(self.manifest, history=[*self.manifest.history, {**note, "base": self.manifest.base_version}], **changes)
        self.manifest = replace(m, version=version)
        return self._publish()

    # --- reading ----------------------------------------------------------------------------------------------------

    @property
    def base_version(self) -> int:
        return self.manifest.base_version

    def data(self) -> DataFrame:
        """The base's rows; its files, which never change, are listed once."""
        if self.base_version not in self.listed:
            self.listed[self.base_version] = self.spark.read.parquet(f"{self.root}/v={self.base_version}/data")
        return self.listed[self.base_version]

    def nodes(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/v={self.base_version}/nodes")

    def delta(self) -> DataFrame | None:
        v = self.manifest.delta_versions
        return self.spark.read.parquet(*[f"{self.root}/v={x}/delta" for x in v]) if v else None

    def tombstones(self) -> DataFrame | None:
        v = self.manifest.tombstone_version
        return None if v is None or not self.manifest.tombstones else self.spark.read.parquet(f"{self.root}/v={v}/tombstones")

    def table(self) -> Table:
        """Base, delta and tombstones with all contracts."""
        m = self.manifest
        t = Table(m.schema, self.data(), None, None, m.dictionaries, m.statistics, m.parts)
        return t.with_delta(self.delta(), check=False).with_tombstones(self.tombstones())

    def footprint(self) -> DataFrame:
        """(section, bytes, files) of the current version."""
        return self.inspect().drop("intact")


def write_batch(df: DataFrame, path: str, schema: Schema) -> int:
    """A batch of typed rows as a file of its own, with its schema: rows written."""
    validate(df, schema)
    spark = df.sparkSession
    if not df.take(1):
        raise ArchiveError("an empty batch")
    df.select(ROW_ID, *schema.names).write.mode("errorifexists").parquet(f"{path.rstrip('/')}/rows")
    h = content_hash(spark.read.parquet(f"{path.rstrip('/')}/rows")).first()
    d = {"magic": "tessera-batch", "format": FORMAT, "schema": schema.to_dict(), "rows": h["rows"], "content": h["content"]}
    Store(spark, path).replace("batch.json", json.dumps(d, indent=1))
    return h["rows"]


def read_batch(spark: SparkSession, path: str, check: bool = True) -> tuple[DataFrame, Schema]:
    """The rows and the schema of a batch file; with `check`, its content is hashed and compared."""
    d = json.loads(Store(spark, path).read("batch.json"))
    if d.get("magic") != "tessera-batch" or d.get("format") != FORMAT:
        raise ArchiveError("not a batch of this format")
    rows = spark.read.parquet(f"{path.rstrip('/')}/rows")
    schema = Schema.from_dict(d["schema"])
    if check:
        h = content_hash(rows.select(ROW_ID, *schema.names)).first()
        if (h["rows"], h["content"]) != (d["rows"], d["content"]):
            raise ArchiveError("the content isn't what the batch says")
    return rows, schema
