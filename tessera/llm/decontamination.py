"""Operator 6: benchmark decontamination by size-partitioned MinHash containment search.

Test items are short, documents long, so similarity is containment: the share of an item's distinct 5-word shingles that
a document holds (`CONTAINED`, 0.8 or more). Items are partitioned by size, in powers of two; the partition fixes how
many minima an item's bottom-k MinHash sketch keeps and how many of them a document must hold to be a candidate. With
m = the shingles that an item of the partition's largest size may lack, a sketch of 2m + 1 minima of which m + 1 must be
found can't miss an item, so recall is exact. Candidates are verified on full shingle sets.

The items are a stated query set, compared in blocks of `ITEMS` with all documents in one pass a block. Items and
documents with null or empty text have no shingles and match nothing; those of fewer than five words are one shingle,
which the search finds in texts of the same words only. `decontaminate` can look such short items up as runs of words
inside documents, and uses items with a null id too, which the search leaves out (it answers by id).
Repeated items and documents each give their own rows. Extra columns are kept by `decontaminate` and ignored by the
search.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, read_table
from .textcore import Block, blocks, mix, run_hashes, shingle_sets, words

CONTAINED = 0.8
#: Items compared in one pass over the documents; of at most ITEM_SHINGLES shingles in all: the broadcast's bound.
ITEMS = 20_000
ITEM_SHINGLES = 2_000_000
ORDER = np.uint64(0xA24BAED4963EE407)


def lacking(size: int, contained: float) -> int:
    """How many of `size` shingles a document may lack."""
    return size - -int(-contained * size // 1) if contained * size % 1 else size - int(contained * size)


class Items:
    """Some test items: shingle sets, and the sketches of all as one sorted table."""

    def __init__(self, ids: list[int], sets: list[np.ndarray], lengths: list[int], contained: float):
        self.ids, self.sets, self.contained = ids, sets, contained
        #: Hashes of the items of fewer than five words, by number of words.
        self.short = {k: np.unique(np.concatenate(own)) for k in range(1, 5) if (own := [s for s, n in zip(sets, lengths, strict=True) if n == k])}
        self.sizes = np.array([len(s) for s in sets], np.int64)
        need, keys, owner = [], [], []
        for i, s in enumerate(sets):
            top = 1 << int(max(len(s) - 1, 0)).bit_length()  # the partition holds sizes in (top / 2, top]
            m = max(lacking(n, contained) for n in range(top // 2 + 1, top + 1)) if len(s) else 0
            sketch = s[np.argsort(mix(s ^ ORDER), kind="stable")][: 2 * m + 1]
            need.append(max(1, len(sketch) - lacking(len(s), contained)) if len(s) else 1)
            keys.append(sketch)
            owner.append(np.full(len(sketch), i))
        key = np.concatenate([*keys, np.zeros(0, np.uint64)]).astype(np.uint64)
        own = np.concatenate([*owner, np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(key, kind="stable")
        self.need, self.key, self.own = np.array(need, np.int64), key[order], own[order]
        self.once, self.first, self.copies = np.unique(self.key, return_index=True, return_counts=True)

    def found(self, own: np.ndarray) -> list[tuple[int, int]]:
        """(item, shared shingles) of the items contained in a document's set."""
        if not len(own) or not len(self.once):
            return []
        at = np.searchsorted(self.once, own)
        at[at == len(self.once)] = 0
        at = at[self.once[at] == own]
        if not len(at):
            return []
        hit = np.concatenate([self.own[a : a + n] for a, n in zip(self.first[at], self.copies[at], strict=True)])
        item, n = np.unique(hit, return_counts=True)
        out = []
        for i in item[n >= self.need[item]]:
            s = self.sets[i]
            at = np.searchsorted(own, s)
            at[at == len(own)] = 0
            shared = int((own[at] == s).sum())
            if shared >= self.contained * len(s) - 1e-9:
                out.append((int(i), shared))
        return out


    def runs_found(self, block: Block) -> np.ndarray:
        """Which of a block's documents hold a short item as a run of words."""
        out = np.zeros(len(block), bool)
        if self.short:
            _, _, row, h = words(block)
            for k, own in self.short.items():
                at, v = run_hashes(row, h, k)
                out[at[np.isin(v, own)]] = True
        return out


def item_blocks(items: DataFrame, contained: float) -> Iterator[Items]:
    """The items in blocks; read through the driver a block at a time."""
    rows = items.where("text is not null").select("item_id", "text").toLocalIterator()
    while part := list(islice(rows, ITEMS)):
        sets, ids, lengths = [], [], []
        batch = pa.RecordBatch.from_pydict({"text": [r["text"] for r in part]}, schema=pa.schema([("text", pa.string())]))
        for b in blocks(iter([batch])):
            sets += shingle_sets(b)
            lengths += np.bincount(words(b)[2], minlength=len(b)).tolist()
        ids = [r["item_id"] for r in part]
        i = 0
        while i < len(ids):
            j = i + max(1, int(np.searchsorted(np.cumsum([len(s) for s in sets[i:]]), ITEM_SHINGLES, side="right")))
            yield Items(ids[i:j], sets[i:j], lengths[i:j], contained)
            i = j


def contaminated(spark: SparkSession, docs: DataFrame, items: DataFrame, contained: float = CONTAINED) -> DataFrame:
    """(doc_id, item_id, item_shingles, shared) of each document that contains an item."""
    prepare(spark)
    schema = "doc_id long, item_id long, item_shingles int, shared int"
    own = docs.select("doc_id", "text")

    def search(table: Items) -> DataFrame:
        held = spark.sparkContext.broadcast(table)  # at most ITEM_SHINGLES hashes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = held.value
            for b in blocks(batches):
                ids = b.rows.column(0).cast(pa.int64()).to_pylist()
                got = [(ids[i], t.ids[k], int(t.sizes[k]), n) for i, s in enumerate(shingle_sets(b)) for k, n in t.found(s)]
                yield pa.RecordBatch.from_arrays([pa.array([g[c] for g in got], kind) for c, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["doc_id", "item_id", "item_shingles", "shared"])

        return own.mapInArrow(run, schema)

    parts = [search(t) for t in item_blocks(items.where("item_id is not null"), contained)]
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], schema)


def decontaminate(spark: SparkSession, docs: DataFrame, items: DataFrame, contained: float = CONTAINED, runs: bool = False) -> DataFrame:
    """docs without the documents that contain an item; one pass a block of items, no shuffle of texts. With runs, items
    of fewer than five words are found inside longer documents, too."""
    prepare(spark)
    for t in item_blocks(items, contained):
        held = spark.sparkContext.broadcast(t)
        schema = docs.schema

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in blocks(batches):
                short = held.value.runs_found(b) if runs else np.zeros(len(b), bool)
                yield b.rows.filter(pa.array([not (x or held.value.found(s)) for s, x in zip(shingle_sets(b), short.tolist(), strict=True)], pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = contaminated(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "item_id", "item_shingles", "shared", (F.col("shared") / F.col("item_shingles")).alias("containment"))


_W = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
SHINGLES_SQL = "SELECT DISTINCT id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ') || ' #' || len(w)] ELSE [] END) AS s FROM (SELECT {id} AS id, " + _W + " AS w FROM {table})"
OP6_SQL = f"""
WITH d AS ({SHINGLES_SQL.format(id="doc_id", table="documents")}), b AS ({SHINGLES_SQL.format(id="item_id", table="benchmark")}),
n AS (SELECT id, count(*) AS n FROM b GROUP BY id),
m AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS k FROM d JOIN b ON d.s = b.s GROUP BY 1, 2)
SELECT doc_id, item_id, CAST(n AS INTEGER) AS item_shingles, CAST(k AS INTEGER) AS shared, k / n AS containment
FROM m JOIN n ON m.item_id = n.id WHERE k >= 0.8 * n"""
