"""Operator 3: exact token counts without materialising ids.

A byte-level BPE never merges across pre-tokens, so a text's length is the sum over its pre-tokens of the pieces of
each. Every block of documents is written as its distinct pre-tokens and each document's frequencies of them. The
distinct pre-tokens alone are dealt out by hash; each is encoded once where all blocks ask for it, and the numbers of
pieces go back to the blocks, which sum them up by document. So however many documents hold a pre-token, it moves once a
block; no id is kept, and no row made for an occurrence. The number of partitions follows the bytes of text.

Null text counts as empty (0 bytes, 0 tokens). Special strings inside a text count as the library's default does: each
is one token. Rows with a null or repeated id get a row each. Extra columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Kept, prepare, read_table, write_table
from .packing import by_bucket, dealt_out, pack, parts_of, rows_of, unpack
from .textcore import Block, blocks

#: The published split pattern of byte-level BPE (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK = 4 << 20
#: Bytes of text whose distinct pre-tokens a partition encodes on average.
PART_BYTES = 32 << 20


@cache
def tokenizer(name: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


@cache
def splitter(name: str):
    """(findall of the pattern, the library's own pre-tokeniser, pattern of special strings or None)."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec["pre_tokenizer"]
    if spec.get("normalizer") or pre["type"] != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError(f"{name}: only a plain byte-level BPE splits into independent pre-tokens here")
    added = spec.get("added_tokens") or []
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
        raise ValueError(f"{name}: added tokens that strip or need word edges aren't supported")
    special = regex.compile("|".join(regex.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None
    return regex.compile(PATTERN).findall, tokenizer(name).pre_tokenizer, special


def pretokens(text: str, name: str) -> tuple[list[str], int]:
    """(pre-tokens in order, number of special strings) of a text."""
    findall, library, special = splitter(name)
    parts, n = ([text], 0) if special is None or not special.search(text) else ((p := special.split(text)), len(p) - 1)
    out: list[str] = []
    for p in parts:
        # Below U+2000 both libraries agree on character classes; beyond it the tokenizer's own splitter decides.
        if p.isascii() or max(p, default="") < " ":
            out += findall(p)
        else:
            out += [p[a:b] for _, (a, b) in library.pre_tokenize_str(p)]
    return out, n


TABLES = "block long, ids array<bigint>, n_bytes binary, special binary, tokens array<string>, kinds binary, token binary, freq binary"
_ARROW = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("n_bytes", pa.binary()), ("special", pa.binary()), ("tokens", pa.list_(pa.string())), ("kinds", pa.binary()), ("token", pa.binary()), ("freq", pa.binary())])


def block_tables(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    base = TaskContext.get().partitionId() << 32
    for k, b in enumerate(blocks(batches, limit=BLOCK)):
        yield block_table(b, name, base + k)


def hashes_of(tokens: list[str]) -> np.ndarray:
    return np.array([zlib.crc32(t.encode()) for t in tokens], np.uint64) << np.uint64(32)


def block_table(b: Block, name: str, block: int) -> pa.RecordBatch:
    """A block's distinct pre-tokens by hash, and its documents' numbers of kinds, their pre-tokens and frequencies."""
    index: dict[str, int] = {}
    token, freq, kinds, special = [], [], [], []
    for i in range(len(b)):
        found, n = pretokens(b.text(i), name)
        c = Counter(found)
        special.append(n)
        kinds.append(len(c))
        token += [index.setdefault(t, len(index)) for t in c]
        freq += c.values()
    names = list(index)
    by_hash = np.argsort(hashes_of(names), kind="stable")
    place = np.empty(len(names), np.int64)
    place[by_hash] = np.arange(len(names))
    doc = np.repeat(np.arange(len(b)), kinds)
    token, freq = place[np.array(token, np.int64)], np.array(freq, np.int64)
    order = np.argsort(doc * max(1, len(names)) + token)
    token, freq = token[order], freq[order]
    # ascending within a document: packed as steps
    step = np.diff(token, prepend=0)
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    step[first] = token[first]
    row = (block, b.rows.column(0).cast(pa.int64()).to_pylist(), pack(np.diff(b.offs)), pack(np.array(special)), [names[i] for i in by_hash.tolist()], pack(np.array(kinds)), pack(step), pack(freq))
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _ARROW, strict=True)], schema=_ARROW)


def asked(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Each block's pre-tokens by bucket, in equal ranges of the hash."""
    for r in rows_of(batches):
        at = np.searchsorted(parts_of(hashes_of(r["tokens"]), buckets), np.arange(buckets + 1)).tolist()
        full = [(k, i, j) for k, (i, j) in enumerate(zip(at, at[1:], strict=False)) if j > i]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, *_ in full], pa.int32()), pa.array([r["block"]] * len(full), pa.int64()), pa.array([r["tokens"][i:j] for _, i, j in full], pa.list_(pa.string()))], ["bucket", "block", "tokens"])


def encoded(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    """Encode each distinct pre-token of a bucket once; answer each block with the numbers of pieces."""
    tok = tokenizer(name)
    for bucket, rows in by_bucket(batches):
        words = pa.array([t for r in rows for t in r["tokens"]], pa.string()).dictionary_encode()
        every = words.dictionary.to_pylist()
        pieces = np.zeros(len(every), np.int64)
        for i in range(0, len(every), 20_000):
            part = every[i : i + 20_000]
            pieces[i : i + len(part)] = [len(e) for e in tok.encode_batch_fast(part, add_special_tokens=False)]
        got = pieces[words.indices.to_numpy()]
        at = np.cumsum([0, *(len(r["tokens"]) for r in rows)])
        yield pa.RecordBatch.from_arrays([pa.array([r["block"] for r in rows], pa.int64()), pa.array([bucket] * len(rows), pa.int32()), pa.array([pack(got[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["block", "bucket", "pieces"])


def by_document(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    for r in rows_of(batches):
        n = len(r["ids"])
        pieces = np.concatenate([*(unpack(a["pieces"]) for a in sorted(r["told"] or [], key=lambda a: a["bucket"])), np.zeros(0, np.int64)])
        kinds, step = unpack(r["kinds"]), unpack(r["token"])
        if len(pieces) != r["n_tokens"]:
            raise RuntimeError("a block got no answer about some of its pre-tokens")
        # undo the steps, which start anew in each document
        at = np.concatenate([[0], np.cumsum(kinds)])
        total = np.concatenate([[0], np.cumsum(step)])
        doc = np.repeat(np.arange(n), kinds)
        each = np.concatenate([[0], np.cumsum(pieces[total[1:] - total[at[:-1]][doc]] * unpack(r["freq"]))])
        tokens = unpack(r["special"]) + each[at[1:]] - each[at[:-1]]
        yield pa.RecordBatch.from_arrays([pa.array(r["ids"], pa.int64()), pa.array(unpack(r["n_bytes"])), pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])


def count_tokens(docs: DataFrame, name: str = "byte_bpe_50k.json", limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of docs(doc_id, text)."""
    spark = prepare(docs.sparkSession)
    kept = Kept(spark)
    docs = docs.select("doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // PART_BYTES))
    tables = kept(docs.mapInArrow(partial(block_tables, name=name), TABLES), "tables")
    ask = tables.select("block", "tokens").mapInArrow(partial(asked, buckets=buckets), "bucket int, block long, tokens array<string>")
    told = kept(dealt_out(ask, buckets).mapInArrow(partial(encoded, name=name), "block long, bucket int, pieces binary"), "pieces")
    told = told.groupBy("block").agg(F.collect_list(F.struct("bucket", "pieces")).alias("told"))  # one answer a bucket
    own = tables.select("block", "ids", "n_bytes", "special", F.size("tokens").alias("n_tokens"), "kinds", "token", "freq")
    out, _ = write_table(spark, own.join(told, "block", "left").drop("block").mapInArrow(partial(by_document, limit=limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean"), "counts")
    kept.drop()
    return out


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"))
