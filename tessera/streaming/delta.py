"""Streaming ingest (an extension): micro-batches become pending deltas; maintenance runs when its policy asks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tessera.functions.schema import ROW_ID
from tessera.operators.maintenance import Policy, maintain
from tessera.sources.archive import Archive


def append_stream(stream: DataFrame, root: str, checkpoint: str, policy: Policy | None = None, **trigger) -> StreamingQuery:
    """Write a typed stream (row_id, fields) into the table at `root`. A batch that is replayed after a failure adds
    nothing, as ids there already are left out. A batch is written as a file of its own; nothing pending is rewritten."""

    def run(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        a = Archive.load(spark, root)
        own = batch.select(ROW_ID, *a.manifest.schema.names).dropDuplicates([ROW_ID])
        low, high = own.agg(F.min(ROW_ID), F.max(ROW_ID)).first()
        known = a.data().select(ROW_ID)
        if (old := a.delta()) is not None:
            known = known.union(old.select(ROW_ID))
        # ids are read within the batch's range alone: row groups beyond it are skipped
        fresh = own.join(known.where(F.col(ROW_ID).between(low, high)), ROW_ID, "left_anti") if low is not None else own
        if fresh.take(1):
            a = a.put_delta(fresh)
        if policy is not None:
            maintain(a, policy)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
