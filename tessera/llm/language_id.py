"""Operator 2: language identification with language-bitmask n-gram filters.

One Bloom filter per n-gram order is shared by all languages: each of its positions holds a bit for every language
(bit-sliced), so that the AND over an n-gram's positions is the set of languages that contain it. The bits of a text's
n-grams are counted per language, the filter's known false-positive rate is taken off, and the largest share decides.

Learning reads rows with a text, an id and a non-null language, about `sample` of each language and at most `longest`
characters of each, spread over the whole text (documented bounds); scoring reads whole texts. Null or empty texts, and texts without a letter, get `und` with score 0. Ties go to the language
first in alphabetical order. With nothing to learn from, every text gets `und`. Rows with null or repeated ids get a row
each, those with a null id aren't held out. Extra columns are kept by `identify`, but for those named like its results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import appended, excerpt, fold, is_fold, prepare, read_table
from .textcore import LOWER, Block, blocks

ORDERS = (3, 4, 5)
HASHES = 2
MULT = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
#: ASCII letters are lowered, other ASCII is a blank, bytes of longer characters stay.
FLAT = LOWER.copy()
FLAT[[b for b in range(128) if not chr(b).isalpha()]] = 32


@dataclass
class Filters:
    langs: list[str]
    bits: int
    #: Per order and 64-bit word of languages: 2**bits positions.
    slices: dict[int, list[np.ndarray]] = field(default_factory=dict)
    false_rate: dict[int, np.ndarray] = field(default_factory=dict)


def ngrams(data: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, row bounds) of the byte n-grams of each row that hold no two blanks in a row."""
    if len(data) < n:
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    m = len(data) - n + 1
    code = np.zeros(m, np.uint64)
    for j in range(n):
        code |= data[j : j + m].astype(np.uint64) << np.uint64(8 * j)
    blank = data == 32
    double = np.zeros(len(data) + 1, np.int64)
    np.cumsum(blank[1:] & blank[:-1], out=double[1 : len(data)])
    double[len(data)] = double[len(data) - 1]
    good = double[n - 1 : n - 1 + m] == double[:m]
    for o in offs[1:-1]:
        good[max(0, o - n + 1) : o] = False
    keep = np.flatnonzero(good)
    return code[keep], np.searchsorted(keep, offs)


def place(code: np.ndarray, i: int, bits: int) -> np.ndarray:
    x = (code ^ (code >> np.uint64(17))) * MULT[i]
    return ((x ^ (x >> np.uint64(31))) * MULT[1 - i]) >> np.uint64(64 - bits)


def fit(samples: dict[str, list[str]], bits: int = 20, share: float = 0.25, least: int = 2) -> Filters:
    """Filters from texts by language: a language contains an n-gram that it uses at least `share` times as often
    as the language that uses it most, and at least `least` times."""
    langs = sorted(samples)
    out = Filters(langs, bits)
    flat = {k: FLAT[np.frombuffer("\n\n".join(v).encode(), np.uint8)] for k, v in samples.items()}
    for n in ORDERS:
        counted = [np.unique(ngrams(flat[k], np.array([0, len(flat[k])]), n)[0], return_counts=True) for k in langs]
        every = np.unique(np.concatenate([c[0] for c in counted])) if counted else np.zeros(0, np.uint64)
        rate, count = np.zeros((len(langs), len(every))), np.zeros((len(langs), len(every)), np.int64)
        for i, (g, c) in enumerate(counted):
            at = np.searchsorted(every, g)
            count[i, at] = c
            rate[i, at] = c / max(1, c.sum())
        member = (rate >= share * rate.max(0, initial=0)) & (count >= least)
        slices, false = [], np.zeros(len(langs))
        for w in range((len(langs) + 63) // 64):
            table = np.zeros(1 << bits, np.uint64)
            for i in range(64 * w, min(len(langs), 64 * w + 64)):
                for h in range(HASHES):
                    table[place(every[member[i]], h, bits)] |= np.uint64(1 << (i - 64 * w))
                false[i] = ((table >> np.uint64(i - 64 * w)) & np.uint64(1)).mean() ** HASHES
            slices.append(table.astype(np.uint8) if len(langs) <= 8 else table)
        out.slices[n], out.false_rate[n] = slices, false
    return out


def evidence(model: Filters, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(corrected share of n-grams per row and language, whether the row has a letter)."""
    flat = FLAT[block.data]
    rows, langs = len(block), len(model.langs)
    total, got = np.zeros(rows), np.zeros((rows, langs))
    for n in ORDERS:
        code, at = ngrams(flat, block.offs, n)
        size = np.diff(at)
        total += size
        full = np.flatnonzero(size)
        if not len(full):
            continue
        spots = [place(code, h, model.bits) for h in range(HASHES)]
        for w, table in enumerate(model.slices[n]):
            mask = table[spots[0]]
            for s in spots[1:]:
                mask = mask & table[s]
            for i in range(64 * w, min(langs, 64 * w + 64)):
                bit = (mask >> mask.dtype.type(i - 64 * w)) & mask.dtype.type(1)
                hits = np.add.reduceat(bit, at[full], dtype=np.int64)
                f = model.false_rate[n][i]
                got[full, i] += np.maximum(0, (hits - f * size[full]) / max(1e-9, 1 - f))
    lettered = np.zeros(rows, bool)
    some = np.flatnonzero(np.diff(block.offs))
    if len(some):
        ascii_letter = (flat != 32) & (flat < 128)
        lettered[some] = np.logical_or.reduceat(ascii_letter, block.offs[some])
        for i in some[~lettered[some]]:
            lettered[i] = any(c.isalpha() for c in block.text(i))
    return got / np.maximum(total, 1)[:, None], lettered


def predict(model: Filters, block: Block) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, score 0..1, evidence 0..1) of each row."""
    if not model.langs:
        return ["und"] * len(block), np.zeros(len(block)), np.zeros(len(block))
    share, lettered = evidence(model, block)
    best = share.argmax(1)
    top = share[np.arange(len(block)), best]
    rest = np.sort(share, 1)[:, -2] if share.shape[1] > 1 else np.zeros(len(block))
    score = np.where(lettered, top / np.maximum(top + rest, 1e-12), 0.0)
    return [model.langs[b] if ok else "und" for b, ok in zip(best, lettered)], np.clip(score, 0, 1), np.where(lettered, np.clip(top, 0, 1), 0.0)


def learn(docs: DataFrame, sample: int = 1000, longest: int = 10_000, held_out_mod: int = 5) -> Filters:
    """Fit on about `sample` rows of each language, none of them held out and at most twice as many in all; of texts of
    over `longest` characters, on pieces spread over the whole text."""
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (fold("doc_id", held_out_mod) != 0))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return fit({})
    chance = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1_000_000))
    cut = F.coalesce(*[F.when(F.col("lang") == k, F.lit(int(1e6 * min(1, sample / n)) + 1)) for k, n in sorted(counts.items())])
    picked = rows.where(chance < cut).select("lang", excerpt(F.col("text"), longest).alias("text"), chance.alias("chance")).orderBy("chance", "lang", "text").limit(2 * sample * len(counts))
    groups: dict[str, list[str]] = {k: [] for k in counts}
    for r in picked.select("lang", "text").collect():
        groups[r["lang"]].append(r["text"])
    return fit({k: v for k, v in groups.items() if v})


def identify(spark: SparkSession, docs: DataFrame, model: Filters) -> DataFrame:
    """docs with lang_pred, score and evidence appended."""
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded: 2**bits positions for each order and 64 languages
    own = docs.drop("lang_pred", "score", "evidence")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            lang, score, ev = predict(shared.value, b)
            yield pa.RecordBatch.from_arrays([*b.rows.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(ev)], [*b.rows.schema.names, "lang_pred", "score", "evidence"])

    return own.mapInArrow(run, appended(own, lang_pred="string", score="double", evidence="double"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = learn(docs)
    got = identify(spark, docs.select("doc_id", "text"), model)
    return got.select("doc_id", is_fold("doc_id", 5, 0).alias("held_out"), "lang_pred", "score")
