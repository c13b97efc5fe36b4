"""Rows of packed arrays that blocks of documents and buckets of hashes exchange."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame


def pack(x: np.ndarray) -> bytes:
    """Whole numbers >= 0 as compressed byte planes of the narrowest type that holds them, after its size."""
    if not len(x):
        return b""
    x = x.astype(np.min_scalar_type(int(x.max())))
    return bytes([x.itemsize]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T))


def unpack(raw: bytes | None, kind=np.int64) -> np.ndarray:
    if not raw:
        return np.zeros(0, kind)
    b = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), np.uint8)
    return np.ascontiguousarray(b.reshape(raw[0], -1).T).reshape(-1).view(f"u{raw[0]}").astype(kind)


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x.astype(np.uint64), prepend=np.uint64(0)))


def unpack_sorted(raw: bytes | None, kind=np.uint64) -> np.ndarray:
    return np.cumsum(unpack(raw, np.uint64), dtype=np.uint64).astype(kind)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def record(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


def schema_of(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def parts_of(code: np.ndarray, n: int) -> np.ndarray:
    """Partition of hashes: equal ranges, so that sorted hashes are sorted by partition."""
    return ((code >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """The rows of each bucket of a stream sorted by bucket."""
    held: list[dict] = []
    for r in rows_of(batches):
        if held and held[-1]["bucket"] != r["bucket"]:
            yield held[-1]["bucket"], held
            held = []
        held.append(r)
    if held:
        yield held[-1]["bucket"], held


def dealt_out(rows: DataFrame, buckets: int) -> DataFrame:
    """Each bucket to the partition of its number: hashed, several would meet in one."""
    return rows.repartitionById(buckets, "bucket").sortWithinPartitions("bucket")
