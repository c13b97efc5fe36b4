"""Operator 9: toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word (a maximal run of letters, A-Z lowered) is fed as the sum of a word vector (hashed) and the vectors of its
character trigrams and beginnings (hashed; so inflected forms share input). Windows of `SPAN` words overlap by half and
cover the whole text; each is read by a GRU in both directions, an attention layer pools the states, and a logistic unit scores the pooled state. The score of a text
is that of its worst window, mapped to a probability on the documents learned from.

Only documents are labelled, so training is multiple-instance: a toxic document is represented by its worst window, at
first the one with the word of highest log-odds, then the one that the network scores highest; clean documents by random
windows and those the network scores highest. Training uses at most `sample` labelled rows, and of texts of over `longest`
characters pieces spread over the whole text (documented bounds).

Null or empty texts, and texts without letters, have no window and get the score of an empty window. With a single class
to learn from, every score is that class's share; with no labels no text is toxic. Rows with null or repeated ids get a
row each, those with a null id aren't held out; of rows with the same id one is learned from. Extra columns are kept by
`score`, but for one named score, which the result replaces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import appended, bounded, excerpt, fold, is_fold, prepare, read_table
from .textcore import BLOCK_BYTES, LETTER, LOWER, Block, blocks, bounds, hash_spans, mix, spans, trim

SPAN, STEP = 24, 12
#: A word is learned if so many documents have it.
RARE = 4
WORD_BITS, CHAR_BITS, STEM_BITS, WIDTH, HIDDEN = 16, 12, 17, 8, 8
#: Training holds what grows with the texts in 32 bits, and works on so many bytes, words and kinds of words at a time.
PIECE_BYTES, PIECE_WORDS, PIECE_KINDS = 1 << 18, 1 << 16, 1 << 14
#: Lengths in bytes of the word beginnings that count as character input, so that inflected forms share it.
STEMS = (3, 4, 5, 6, 7, 8)
F32 = np.float32


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Words:
    """The words of a block: per occurrence its document and kind; per kind a word slot and character slots."""

    row: np.ndarray
    kind: np.ndarray
    slot: np.ndarray
    chars: np.ndarray
    of: np.ndarray
    hash: np.ndarray | None = None  # of each kind


def words_of(block: Block) -> Words:
    low = LOWER[block.data]
    starts, ends, row = spans(low, block.offs, ~LETTER[low])
    kinds, first, kind = np.unique(hash_spans(low, starts, ends), return_index=True, return_inverse=True)
    s, e = starts[first], ends[first]
    # character trigrams of "<word>", over bytes
    n = e - s
    of = np.repeat(np.arange(len(kinds)), n)
    pos = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(s, n) + pos
    left = np.where(pos > 0, low[np.maximum(at - 1, 0)], 60).astype(np.uint64)
    right = np.where(pos < np.repeat(n, n) - 1, low[np.minimum(at + 1, len(low) - 1)] if len(low) else 0, 62).astype(np.uint64)
    chars = (mix(left << np.uint64(16) | low[at].astype(np.uint64) << np.uint64(8) | right) >> np.uint64(64 - CHAR_BITS)).astype(np.int64)
    # beginnings of words, in slots of their own after those of the trigrams
    h = np.zeros(len(kinds), np.uint64)
    many, whose = [chars], [of]
    for k in range(max(STEMS)):
        own = np.flatnonzero(n > k)
        h[own] = (h[own] + low[s[own] + k].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        if k + 1 in STEMS:
            many.append((mix(h[own]) >> np.uint64(64 - STEM_BITS)).astype(np.int64) + (1 << CHAR_BITS))
            whose.append(own)
    of = np.concatenate(whose)
    order = np.argsort(of, kind="stable")
    chars, of = np.concatenate(many)[order], of[order]
    return Words(row, kind, (kinds >> np.uint64(64 - WORD_BITS)).astype(np.int64), chars, of, kinds)


def words_of_texts(texts: list[str]) -> Words:
    """The words of many texts as of one block, put together from small blocks: of each only what is new is kept."""
    seen = np.zeros(0, np.uint64)
    kind, rows, own = [], [], []  # of each block
    for i in range(0, len(texts), 100):
        for b in blocks_of(texts[i : i + 100], PIECE_BYTES):
            w = words_of(b)
            kind.append((w.kind.astype(np.int32), w.hash))
            rows.append(np.bincount(w.row, minlength=len(b)))
            at = np.searchsorted(seen, w.hash)
            new = np.append(seen, np.uint64(0))[at] != w.hash  # these give their characters
            new |= at == len(seen)
            seen = np.insert(seen, at[new], w.hash[new])
            own.append((w.hash[new], np.bincount(w.of, minlength=len(new))[new], w.chars[new[w.of]].astype(np.int32)))
    many = np.zeros(len(seen), np.int64)
    for h, size, _ in own:
        many[np.searchsorted(seen, h)] = size
    begin = np.cumsum(many) - many
    chars = np.empty(int(many.sum()), np.int32)
    for h, size, c in own:
        chars[np.repeat(begin[np.searchsorted(seen, h)] - (np.cumsum(size) - size), size) + np.arange(len(c))] = c
    del own
    kinds = np.empty(sum(len(k) for k, _ in kind), np.int32)
    end = len(kinds)
    while kind:
        k, h = kind.pop()
        kinds[end - len(k) : end] = np.searchsorted(seen, h)[k]
        end -= len(k)
    trim()
    row = np.repeat(np.arange(len(texts), dtype=np.int32), np.concatenate([*rows, np.zeros(0, np.int64)]))
    return Words(row, kinds, (seen >> np.uint64(64 - WORD_BITS)).astype(np.int64), chars, np.repeat(np.arange(len(seen), dtype=np.int32), many), seen)


def windows(row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, document) of windows of SPAN words that start every STEP words and cover each document's words."""
    at = bounds(row, n)
    size = np.diff(at)
    many = np.where(size > 0, np.maximum(1, -(-(size - SPAN) // STEP) + 1), 0)
    doc = np.repeat(np.arange(n), many)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    return at[doc] + k * STEP, doc


def kinds_of(w: Words, first: np.ndarray, size: int = 4096) -> Iterator[np.ndarray]:
    """The kinds of the words of windows, (windows, SPAN), of `size` windows at a time; past a document's end the number
    of kinds."""
    for i in range(0, len(first), size):
        at = first[i : i + size, None] + np.arange(SPAN)
        near = np.minimum(at, len(w.row) - 1)
        yield np.where((near == at) & (w.row[near] == w.row[at[:, :1]]), w.kind[near], len(w.slot))


def pieces(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of whole documents, bounded by `at`, of about PIECE_WORDS words."""
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + PIECE_WORDS, side="right")) - 1)
        yield int(at[i]), int(at[j])
        i = j


class Network:
    """Parameters by name; forward over windows, and gradients by back-propagation through time."""

    def __init__(self, seed: int = 9):
        r = np.random.default_rng(seed)
        g = lambda *s, k=0.3: (r.normal(0, k, s)).astype(F32)
        self.p = {"word": np.zeros((1 << WORD_BITS, WIDTH), F32), "char": np.concatenate([g(1 << CHAR_BITS, WIDTH, k=0.02), np.zeros((1 << STEM_BITS, WIDTH), F32)])}
        for d in "fb":
            self.p |= {f"W{d}": g(WIDTH, 3 * HIDDEN), f"U{d}": g(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, F32)}
        self.p |= {"A": g(2 * HIDDEN, HIDDEN), "a": g(HIDDEN), "w": g(2 * HIDDEN), "b": np.full(1, -2, F32)}
        self.slope, self.shift = 1.0, 0.0

    def inputs(self, w: Words) -> np.ndarray:
        """A vector for each kind of word, and a zero vector for padding last."""
        n = len(w.slot)
        out = np.zeros((n + 1, WIDTH), F32)
        for a in range(0, n, PIECE_KINDS):
            e = min(n, a + PIECE_KINDS)
            i, j = np.searchsorted(w.of, np.array([a, e], w.of.dtype))
            of, chars = w.of[i:j] - a, w.chars[i:j]
            count = np.sqrt(np.maximum(np.bincount(of, minlength=e - a), 1)).astype(F32)
            for k in range(WIDTH):
                out[a:e, k] = np.bincount(of, self.p["char"][chars, k], minlength=e - a) / count
        out[:n] += self.p["word"][w.slot]
        return out

    def direction(self, d: str, kinds: np.ndarray, x: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        """States (T, B, HIDDEN) of one direction; kinds (B, T) index x."""
        pre = x @ self.p[f"W{d}"]
        pre += self.p[f"c{d}"]
        u_zr, u_n = np.ascontiguousarray(self.p[f"U{d}"][:, : 2 * HIDDEN]), np.ascontiguousarray(self.p[f"U{d}"][:, 2 * HIDDEN :])
        batch, steps = kinds.shape
        h = np.zeros((batch, HIDDEN), F32)
        out = np.empty((steps, batch, HIDDEN), F32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g = pre[kinds[:, t]]
            zr = 1 / (1 + np.exp(-(g[:, : 2 * HIDDEN] + h @ u_zr)))
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = np.tanh(g[:, 2 * HIDDEN :] + (r * h) @ u_n)
            new = h + (z * mask[:, t, None]) * (c - h)
            if keep is not None:
                keep.append((t, h, z, r, c))
            h = out[t] = new
        return out

    def logits(self, kinds: np.ndarray, x: np.ndarray, tape: dict | None = None) -> np.ndarray:
        """kinds (B, T): rows of x; the last row of x is padding."""
        mask = (kinds != len(x) - 1).astype(F32)
        kf, kb = ([], []) if tape is not None else (None, None)
        h = np.concatenate([self.direction("f", kinds, x, mask, kf), self.direction("b", kinds, x, mask, kb)], 2)
        q = np.tanh(h @ self.p["A"])
        e = np.exp(q @ self.p["a"]) * mask.T
        alpha = e / np.maximum(e.sum(0), 1e-9)
        s = np.einsum("tb,tbh->bh", alpha, h)
        if tape is not None:
            tape |= {"mask": mask, "f": kf, "b": kb, "h": h, "q": q, "alpha": alpha, "s": s}
        return s @ self.p["w"] + self.p["b"][0]

    def gradients(self, kinds: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict, np.ndarray, float]:
        """(gradients of the dense parameters, gradient of x, loss)."""
        tape: dict = {}
        o = self.logits(kinds, x, tape)
        p = sigmoid(o)
        loss = float(-(weight * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).mean())
        do = (weight * (p - y) / len(y)).astype(F32)
        h, q, alpha, mask = tape["h"], tape["q"], tape["alpha"], tape["mask"]
        g = {"w": do @ tape["s"], "b": do.sum(keepdims=True)}
        ds = do[:, None] * self.p["w"]
        dh = alpha[:, :, None] * ds[None]
        da = np.einsum("bh,tbh->tb", ds, h)
        de = alpha * (da - (alpha * da).sum(0))
        g["a"] = np.einsum("tb,tbk->k", de, q)
        dq = de[:, :, None] * self.p["a"] * (1 - q * q)
        g["A"] = np.einsum("tbh,tbk->hk", h, dq)
        dh = dh + dq @ self.p["A"].T
        dx = np.zeros_like(x)
        for d, part in (("f", dh[:, :, :HIDDEN]), ("b", dh[:, :, HIDDEN:])):
            W, U = self.p[f"W{d}"], self.p[f"U{d}"]
            gW, gU, gc = np.zeros_like(W), np.zeros_like(U), np.zeros(3 * HIDDEN, F32)
            back = np.zeros((len(y), HIDDEN), F32)
            for t, prev, z, r, c in reversed(tape[d]):
                up = part[t] + back
                m = mask[:, t, None]
                dz = up * (c - prev) * m * z * (1 - z)
                dc = up * z * m * (1 - c * c)
                drh = dc @ U[:, 2 * HIDDEN :].T
                dr = drh * prev * r * (1 - r)
                gates = np.concatenate([dz, dr, dc], 1)
                back = up * (1 - z * m) + drh * r + gates[:, : 2 * HIDDEN] @ U[:, : 2 * HIDDEN].T
                xs = x[kinds[:, t]]
                gW += xs.T @ gates
                gc += gates.sum(0)
                gU[:, : 2 * HIDDEN] += prev.T @ gates[:, : 2 * HIDDEN]
                gU[:, 2 * HIDDEN :] += (r * prev).T @ dc
                np.add.at(dx, kinds[:, t], gates @ W.T)
            g |= {f"W{d}": gW, f"U{d}": gU, f"c{d}": gc}
        return g, dx, loss

    def window_logits(self, w: Words, first: np.ndarray, n_words: int, size: int = 4096) -> np.ndarray:
        x = self.inputs(w)
        return np.concatenate([np.zeros(0, F32), *(self.logits(k, x) for k in kinds_of(w, first, size))])

    def documents(self, block: Block) -> np.ndarray:
        """The logit of each text's worst window."""
        w = words_of(block)
        first, doc = windows(w.row, len(block))
        out = np.full(len(block), self.p["b"][0], F32)
        if len(first):
            o = self.window_logits(w, first, len(w.kind))
            full = np.flatnonzero(np.bincount(doc, minlength=len(block)))
            out[full] = np.maximum.reduceat(o, np.searchsorted(doc, full))
        return out

    def probability(self, logit: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * logit.astype(np.float64) + self.shift)


class Adam:
    def __init__(self, params: dict, rate: float):
        self.p, self.rate, self.t = params, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in params.items()} for _ in range(2))

    def step(self, grads: dict) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.p[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)

    def step_rows(self, k: str, rows: np.ndarray, g: np.ndarray) -> None:
        """A step for some rows of an embedding."""
        m, v = self.m[k], self.v[k]
        g = g + 1e-4 * self.p[k][rows]
        m[rows] += 0.1 * (g - m[rows])
        v[rows] += 0.001 * (g * g - v[rows])
        self.p[k][rows] -= self.rate * (m[rows] / (1 - 0.9 ** max(self.t, 1))) / (np.sqrt(v[rows] / (1 - 0.999 ** max(self.t, 1))) + 1e-8)


def constant(share: float) -> Network:
    net = Network()
    for k in ("w", "b"):
        net.p[k] = np.zeros_like(net.p[k])
    net.shift = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    return net


def blocks_of(texts: list[str], limit: int = BLOCK_BYTES) -> Iterator[Block]:
    return blocks(iter([pa.RecordBatch.from_pydict({"text": texts}, schema=pa.schema([("text", pa.string())]))]), limit=limit)


def train(texts: list[str], labels: np.ndarray, seed: int = 9) -> Network:
    """A network from labelled texts: copies count once, every fourth text only calibrates."""
    once = sorted({t: i for i, t in reversed(list(enumerate(texts)))}.values())
    texts, y = [texts[i] for i in once], np.asarray(labels, np.float64)[once]
    if len(y) == 0 or y.min() == y.max():
        return constant(float(y.mean()) if len(y) else 0.0)
    rest = np.zeros(len(y), bool)
    for v in (0, 1):  # of each class alike
        rest[np.flatnonzero(y == v)[3::4]] = True
    net = fit([t for t, r in zip(texts, rest, strict=True) if not r], y[~rest], seed=seed)
    if len(set(y[rest])) == 2:
        net.slope, net.shift = platt(np.concatenate([net.documents(b) for b in blocks_of([t for t, r in zip(texts, rest, strict=True) if r])]), y[rest])
    return net


def documents_with(w: Words, begin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents without and with label that have each kind of word (2, kinds) and each slot of word beginnings (2, slots).
    Counted in runs of whole documents; begin: where each kind's characters begin."""
    n = len(w.slot)
    stem = w.chars >= 1 << CHAR_BITS
    stems, begins = w.chars[stem] - (1 << CHAR_BITS), np.concatenate([[0], np.cumsum(stem)])[begin]
    docs, stem_docs = np.zeros((2, n)), np.zeros((2, 1 << STEM_BITS))
    for a, e in pieces(bounds(w.row, len(y))):
        kinds = np.unique(w.row[a:e] * np.int64(n) + w.kind[a:e])
        d, k = kinds // n, kinds % n
        each = begins[k + 1] - begins[k]
        spots = np.repeat(begins[k] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
        pair = np.unique(np.repeat(d << STEM_BITS, each) | stems[spots])
        for i, label in enumerate((1 - y, y)):
            np.add.at(docs[i], k, label[d])
            np.add.at(stem_docs[i], pair & ((1 << STEM_BITS) - 1), label[pair >> STEM_BITS])
    return docs, stem_docs


def fit(texts: list[str], y: np.ndarray, rounds: int = 3, epochs: int = 3, size: int = 256, seed: int = 9) -> Network:
    r = np.random.default_rng(seed)
    w = words_of_texts(texts)
    first, doc = windows(w.row, len(texts))
    net = Network(seed)
    # log-odds of words and their beginnings by document: the first guess of where a toxic document is toxic, and the
    # start of their vectors
    n = len(w.slot)

    def odds_of(hot: np.ndarray, cold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = np.log((hot + 0.5) / (y.sum() + 1)) - np.log((cold + 0.5) / ((1 - y).sum() + 1))
        z = np.maximum(z - 1.64 * np.sqrt(1 / (hot + 0.5) + 1 / (cold + 0.5)), 0)  # a lower bound of it
        known = hot + cold >= RARE  # rarer ones keep a zero vector: they'd only be learned by heart
        return np.where(known, z, 0), known

    begin = np.searchsorted(w.of, np.arange(n + 1, dtype=np.int32))
    docs, stem_docs = documents_with(w, begin, y)
    odds, known = odds_of(docs[1], docs[0])
    stem_odds, stem_known = odds_of(stem_docs[1], stem_docs[0])
    top = max(1.0, odds.max(initial=0), stem_odds.max(initial=0))
    net.p["word"][w.slot, 0] += (odds / top).astype(F32)
    net.p["char"][1 << CHAR_BITS :, 0] += (stem_odds / top).astype(F32)
    learnt = np.concatenate([np.ones(1 << CHAR_BITS, bool), stem_known])
    for i in range(0, len(w.of), PIECE_WORDS):
        of, chars = w.of[i : i + PIECE_WORDS], w.chars[i : i + PIECE_WORDS]
        stem = chars >= 1 << CHAR_BITS
        np.maximum.at(odds, of[stem], stem_odds[chars[stem] - (1 << CHAR_BITS)])
    trim()
    high = np.concatenate([odds, [0.0]])
    score = np.concatenate([high[k].max(1) for k in kinds_of(w, first)])
    opt = Adam(net.p, 0.01)
    count = np.sqrt(np.maximum(np.diff(begin), 1))
    toxic = y[doc] == 1
    for _ in range(rounds):
        order = np.lexsort((-score, doc))
        head = np.concatenate([[True], doc[order][1:] != doc[order][:-1]])
        worst = order[head]
        pos, hard = worst[toxic[worst]], worst[~toxic[worst]]
        easy = r.choice(np.flatnonzero(~toxic), min(len(hard) * 2, int((~toxic).sum())), replace=False)
        pick = np.concatenate([np.repeat(pos, 2), hard, easy])
        target = toxic[pick].astype(np.float64)
        weight = np.where(target == 1, 0.5 / target.mean(), 0.5 / (1 - target.mean()))
        for _ in range(epochs):
            deal = r.permutation(len(pick))
            for i in range(0, len(pick), size):
                own = deal[i : i + size]
                k = next(kinds_of(w, first[pick[own]]))
                used, local = np.unique(k, return_inverse=True)
                local = local.reshape(k.shape)
                real = used[used < len(w.slot)]
                spots = np.concatenate([np.arange(begin[u], begin[u + 1]) for u in real])
                of = np.repeat(np.arange(len(real)), begin[real + 1] - begin[real])
                part = Words(w.row, w.kind, w.slot[real], w.chars[spots], of)
                x = net.inputs(part)
                g, dx, _ = net.gradients(local, x, target[own], weight[own])
                opt.step({k: v + 1e-4 * net.p[k] for k, v in g.items()})
                often = known[real]
                slots, inv = np.unique(part.slot[often], return_inverse=True)
                gw = np.zeros((len(slots), WIDTH), F32)
                np.add.at(gw, inv, dx[:-1][often])
                opt.step_rows("word", slots, gw)
                often = learnt[part.chars]
                slots, inv = np.unique(part.chars[often], return_inverse=True)
                gc = np.zeros((len(slots), WIDTH), F32)
                np.add.at(gc, inv, (dx[:-1][of] / count[real][of][:, None].astype(F32))[often])
                opt.step_rows("char", slots, gc)
        score = net.window_logits(w, first, len(w.kind)).astype(np.float64)
    return net


def platt(x: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Slope >= 0 and shift of the logistic fit of y on x, by Newton steps with a small ridge."""
    mid, scale = float(x.mean()), float(x.std() + 1e-9)
    z = np.stack([(x - mid) / scale, np.ones_like(x)], 1)
    b = np.array([1.0, 0.0])
    for _ in range(steps):
        p = sigmoid(z @ b)
        g = z.T @ (p - y) + 1e-3 * b
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        d = np.linalg.solve(h, g)
        b -= np.clip(d, -1, 1)
        if abs(d).max() < 1e-9:
            break
    b[0] = max(b[0], 1e-3)
    return float(b[0] / scale), float(b[1] - b[0] * mid / scale)


def learn(docs: DataFrame, labels: DataFrame, sample: int = 4000, longest: int = 40_000, held_out_mod: int = 5) -> Network:
    """Train on at most `sample` labelled rows that aren't held out; of texts of over `longest` characters, on pieces
    spread over the whole text."""
    fit = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", held_out_mod) != 0))
    got = labelled_sample(docs, fit, "toxic", sample, longest)
    return train(got["text"].tolist(), got["toxic"].to_numpy())


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, sample: int, longest: int):
    """(doc_id, text, label) of at most `sample` labelled documents, as pandas; of one id the row with the least text."""
    lab = bounded(labels.groupBy("doc_id").agg(F.max(label).alias(label)), sample, "doc_id")
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(lab), "doc_id")
    return rows.groupBy("doc_id", label).agg(F.min(excerpt(F.col("text"), longest)).alias("text")).orderBy("doc_id").toPandas()


def score(spark: SparkSession, docs: DataFrame, net: Network) -> DataFrame:
    """docs with score (0 to 1) appended."""
    prepare(spark)
    shared = spark.sparkContext.broadcast(net)
    own = docs.drop("score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            yield pa.RecordBatch.from_arrays([*b.rows.columns, pa.array(shared.value.probability(shared.value.documents(b)))], [*b.rows.schema.names, "score"])

    return own.mapInArrow(run, appended(own, score="double"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    got = score(spark, docs.select("doc_id", "text"), learn(docs, read_table(spark, sf_dir, "labels")))
    return got.select("doc_id", is_fold("doc_id", 5, 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
