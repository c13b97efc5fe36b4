"""Vectorised text primitives over Arrow string batches: blocks of texts, words, word hashes, shingle sets."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are handled in blocks of so many bytes (one longer text is a block of its own).
BLOCK_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LETTER = np.zeros(256, bool)
LETTER[97:123] = LETTER[65:91] = LETTER[128:] = True
_RNG = np.random.default_rng(20240229)
BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)
_POW = np.ones(1 << 10, np.uint64)
_POW[1:] = STEP
_POW = np.cumprod(_POW, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    global _POW
    if n > len(_POW):
        p = np.full(2 * n, STEP, np.uint64)
        p[0] = 1
        _POW = np.cumprod(p, dtype=np.uint64)
    return _POW


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Block:
    """Some rows of a batch: `rows` (Arrow record batch slice), `data` (bytes of all texts), `offs` (row offsets)."""

    def __init__(self, rows: pa.RecordBatch, data: np.ndarray, offs: np.ndarray):
        self.rows, self.data, self.offs = rows, data, offs

    def __len__(self) -> int:
        return self.rows.num_rows

    def text(self, i: int) -> str:
        return self.data[self.offs[i] : self.offs[i + 1]].tobytes().decode("utf-8", "replace")


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut batches into blocks of at most `limit` bytes of text; null texts count as empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string())
        texts = texts.fill_null("")
        offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        i, n = 0, len(texts)
        while i < n:
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
            j = min(j, n)
            yield Block(batch.slice(i, j - i), data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            i = j
    trim()


def trim() -> None:
    """Give freed memory back to the system: Python workers live on between tasks and stages."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def spans(data: np.ndarray, offs: np.ndarray, outside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the maximal runs of bytes that aren't `outside`, never across rows."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = outside[:-1]
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = outside[1:]
    edge = offs[(offs > 0) & (offs < n)]
    before[edge] = True
    after[edge - 1] = True
    starts = np.flatnonzero(before & ~outside)
    ends = np.flatnonzero(after & ~outside) + 1
    row = np.searchsorted(offs, starts, side="right") - 1
    return starts, ends, row


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    total = int(lens.sum())
    first = np.cumsum(lens) - lens
    pos = np.arange(total) - np.repeat(first, lens)
    v = BYTE_CODE[data[np.repeat(starts, lens) + pos]] * powers(int(lens.max()))[pos]
    return mix(np.add.reduceat(v, first) + lens.astype(np.uint64))


def words(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of the texts with A-Z lowered: (starts, ends, row, hash)."""
    low = LOWER[block.data]
    starts, ends, row = spans(low, block.offs, SPACE[low])
    return starts, ends, row, hash_spans(low, starts, ends)


def bounds(row: np.ndarray, n: int) -> np.ndarray:
    """Offsets into a sorted row array: row i has [b[i], b[i + 1])."""
    return np.searchsorted(row, np.arange(n + 1, dtype=row.dtype))


_Q = np.uint64(0xD6E8FEB86659FD93)


def run_hashes(row: np.ndarray, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of all runs of k words inside a row, hashed as shingle_sets hashes a text of those k words alone."""
    n = max(len(h) - k + 1, 0)
    v = np.full(n, k, np.uint64)
    for j in range(k):
        v = v * _Q + h[j : n + j]
    own = row[:n] == row[len(row) - n :]
    return row[:n][own], mix(v ^ STEP)[own]


def shingle_sets(block: Block, k: int = 5) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its k-word shingles; of fewer words, one of the whole; of none, empty."""
    _, _, row, h = words(block)
    at = bounds(row, len(block))
    if len(h) >= k:
        s = h[: len(h) - k + 1].copy()
        for j in range(1, k):
            s = s * _Q + h[j : len(h) - k + 1 + j]
        s = mix(s)
    out = []
    for i in range(len(block)):
        a, b = int(at[i]), int(at[i + 1])
        if b - a >= k:
            out.append(np.unique(s[a : b - k + 1]))
        elif b > a:
            v = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for x in h[a:b]:
                    v = v * _Q + x
            out.append(mix(np.array([v], np.uint64) ^ STEP))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
