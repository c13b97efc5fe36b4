"""Operator 5: quality by attention-based multiple-instance learning.

A text is a bag of passages of `PASSAGE` words, covering it whole. A passage is described by how often its neighbouring
bytes pair up by kind (letters, capitals, digits, blanks, single punctuation marks), by hashed words, and by a few
shares (capitals, punctuation, repeated words, word length). An encoder (one hidden layer) maps it to a vector; a gated
attention layer, tanh(Vh) * sigmoid(Uh), weighs the passages of a text; the weighted vector is scored by a logistic
unit. Document labels train all parts together, by Adam in numpy, on at most `sample` labelled rows, and of texts of over
`longest` characters on pieces spread over the whole text (documented bounds); every fourth of them only calibrates.

Null or empty texts are one empty passage and get its score. With no labels or a single class, every score is that
class's share. Rows with null or repeated ids get a row each, those with a null id aren't held out; of rows with the same
id one is learned from. Extra columns are kept by `score`, but for one named score, which the result replaces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import appended, fold, is_fold, prepare, read_table
from .textcore import SPACE, Block, blocks, bounds, hash_spans, spans
from .toxicity import F32, Adam, blocks_of, labelled_sample, platt, sigmoid

PASSAGE = 64
KINDS = 24
WORD_BINS, SHARES, WIDTH, GATE = 256, 6, 16, 8
FEATURES = KINDS * KINDS + WORD_BINS + SHARES
_KIND = np.zeros(256, np.int64)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[32], _KIND[[9, 10, 13]], _KIND[128:] = 1, 2, 3, 4, 5, 6
for _i, _c in enumerate("|!#$%&*.,-=:/<>\"'"):
    _KIND[ord(_c)] = 7 + _i


def passages(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(features, document) of the passages of each text; a text without words has one empty passage."""
    data = block.data
    starts, ends, row = spans(data, block.offs, SPACE[data])
    at = bounds(row, len(block))
    size = np.diff(at)
    many = np.maximum(1, -(-size // PASSAGE))
    doc = np.repeat(np.arange(len(block)), many)
    base = np.cumsum(many) - many
    n = len(doc)
    f = np.zeros((n, FEATURES), F32)
    if not len(starts):
        return f, doc
    own = base[row] + (np.arange(len(row)) - at[row]) // PASSAGE  # passage of each word
    # bytes belong to the passage of the last word that began before them
    where = np.zeros(len(data), np.int64)
    where[starts[1:]] = np.diff(own)
    where = own[0] + np.cumsum(where)
    kind = _KIND[data]
    pair = kind[:-1] * KINDS + kind[1:]
    same = where[:-1] == where[1:]
    # in slices, so that the flat histogram stays small
    code = where[:-1][same] * (KINDS * KINDS) + pair[same]
    f[:, : KINDS * KINDS] = np.bincount(code, minlength=n * KINDS * KINDS).reshape(n, -1)
    total = np.maximum(f[:, : KINDS * KINDS].sum(1, keepdims=True), 1)
    shares = f[:, -SHARES:]
    grouped = f[:, : KINDS * KINDS].reshape(n, KINDS, KINDS).sum(2) / total
    shares[:, 0], shares[:, 1], shares[:, 2] = grouped[:, 2], grouped[:, 7:].sum(1), grouped[:, 3]
    h = hash_spans(data, starts, ends)
    number = np.bincount(own, minlength=n)
    words = np.maximum(number, 1)
    f[:, KINDS * KINDS : KINDS * KINDS + WORD_BINS] = np.bincount(own * WORD_BINS + (h >> np.uint64(56)).astype(np.int64), minlength=n * WORD_BINS).reshape(n, -1) / np.sqrt(words)[:, None] / 2
    order = np.lexsort((h, own))
    again = np.concatenate([[False], (h[order][1:] == h[order][:-1]) & (own[order][1:] == own[order][:-1])])
    shares[:, 3] = np.bincount(own[order], again, minlength=n) / words
    shares[:, 4] = np.bincount(own, ends - starts, minlength=n) / words / 16
    shares[:, 5] = np.log1p(number) / 5  # none in an empty passage, whatever texts are beside it
    np.sqrt(f[:, : KINDS * KINDS] / total, out=f[:, : KINDS * KINDS])
    shares *= 2
    return f, doc


def pooled(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, at, axis=0)


@dataclass
class Bags:
    f: np.ndarray
    doc: np.ndarray
    n: int


class Attention:
    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        g = lambda *s: r.normal(0, 1 / np.sqrt(s[0]), s).astype(F32)
        self.p = {"E": g(FEATURES, WIDTH) * F32(2), "e": np.zeros(WIDTH, F32), "V": g(WIDTH, GATE), "U": g(WIDTH, GATE), "a": g(GATE), "w": g(WIDTH), "b": np.zeros(1, F32)}
        self.slope, self.shift = 1.0, 0.0

    def forward(self, f: np.ndarray, doc: np.ndarray, tape: dict | None = None) -> np.ndarray:
        """Logits of bags 0..max(doc), none of them empty; doc is sorted."""
        p = self.p
        h = np.maximum(f @ p["E"] + p["e"], 0)
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-np.clip(h @ p["U"], -30, 30)))
        score = (v * u) @ p["a"]
        at = np.searchsorted(doc, np.arange(doc[-1] + 1))
        e = np.exp(score - np.maximum.reduceat(score, at)[doc])
        alpha = e / np.add.reduceat(e, at)[doc]
        z = pooled(alpha[:, None] * h, at)
        if tape is not None:
            tape |= {"h": h, "v": v, "u": u, "alpha": alpha, "z": z, "at": at}
        return z @ p["w"] + p["b"][0]

    def gradients(self, f: np.ndarray, doc: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
        p, t = self.p, {}
        do = (weight * (sigmoid(self.forward(f, doc, t)) - y) / len(y)).astype(F32)
        h, v, u, alpha, at = t["h"], t["v"], t["u"], t["alpha"], t["at"]
        dz = do[:, None] * p["w"]
        dh = alpha[:, None] * dz[doc]
        da = (h * dz[doc]).sum(1)
        ds = alpha * (da - np.add.reduceat(alpha * da, at)[doc])
        dv, du = ds[:, None] * p["a"] * u * (1 - v * v), ds[:, None] * p["a"] * v * u * (1 - u)
        dh = (dh + dv @ p["V"].T + du @ p["U"].T) * (h > 0)
        return {"w": do @ t["z"], "b": do.sum(keepdims=True), "a": ds @ (v * u), "V": h.T @ dv, "U": h.T @ du, "E": f.T @ dh, "e": dh.sum(0)}

    def documents(self, block: Block) -> np.ndarray:
        f, doc = passages(block)
        return self.forward(f, doc)

    def probability(self, logit: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * logit.astype(np.float64) + self.shift)


def train(texts: list[str], labels: np.ndarray, epochs: int = 12, size: int = 64, seed: int = 5) -> Attention:
    once = sorted({t: i for i, t in reversed(list(enumerate(texts)))}.values())
    texts, y = [texts[i] for i in once], np.asarray(labels, np.float64)[once]
    net = Attention(seed)
    if len(y) == 0 or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        net.slope, net.shift = 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        return net
    r = np.random.default_rng(seed)
    order = r.permutation(len(y))
    fit, rest = order[np.arange(len(y)) % 4 != 3], order[np.arange(len(y)) % 4 == 3]
    parts = []
    for i in range(0, len(fit), 256):
        done = i
        for b in blocks_of([texts[k] for k in fit[i : i + 256]]):
            f, doc = passages(b)
            parts.append((f.astype(np.float16), doc + done))
            done += len(b)
    f, doc = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    at = np.searchsorted(doc, np.arange(len(fit) + 1))
    target = y[fit]
    weight = np.where(target == 1, 0.5 / target.mean(), 0.5 / (1 - target.mean()))
    opt = Adam(net.p, 0.004)
    for _ in range(max(epochs, -(-1500 * size // max(1, len(fit) * 4)))):
        deal = r.permutation(len(fit))
        for i in range(0, len(deal), size):
            own = np.sort(deal[i : i + size])
            rows = np.concatenate([np.arange(at[k], at[k + 1]) for k in own])
            bag = np.repeat(np.arange(len(own)), at[own + 1] - at[own])
            g = net.gradients(f[rows].astype(F32), bag, target[own], weight[own])
            opt.step({k: v + 1e-4 * net.p[k] for k, v in g.items()})
    if len(set(y[rest])) == 2:
        net.slope, net.shift = platt(np.concatenate([net.documents(b) for b in blocks_of([texts[k] for k in rest])]).astype(np.float64), y[rest])
    return net


def learn(docs: DataFrame, labels: DataFrame, sample: int = 3000, longest: int = 40_000, held_out_mod: int = 4, held_out: int = 2) -> Attention:
    """Train on at most `sample` labelled rows that aren't held out; of texts of over `longest` characters, on pieces
    spread over the whole text."""
    fit = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", held_out_mod) != held_out))
    got = labelled_sample(docs, fit, "quality", sample, longest)
    return train(got["text"].tolist(), got["quality"].to_numpy())


def score(spark: SparkSession, docs: DataFrame, net: Attention) -> DataFrame:
    """docs with score (0 to 1) appended."""
    prepare(spark)
    shared = spark.sparkContext.broadcast(net)
    own = docs.drop("score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            yield pa.RecordBatch.from_arrays([*b.rows.columns, pa.array(shared.value.probability(shared.value.documents(b)))], [*b.rows.schema.names, "score"])

    return own.mapInArrow(run, appended(own, score="double"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    got = score(spark, docs.select("doc_id", "text"), learn(docs, read_table(spark, sf_dir, "labels")))
    return got.select("doc_id", is_fold("doc_id", 4, 2).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
