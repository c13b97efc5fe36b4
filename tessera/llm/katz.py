"""Operator 10: scoring of texts by a Katz back-off language model of any order (`ORDER`, three by default).

Counts are Good-Turing discounted up to `TOP` at every order. With T(h) the training tokens after history h, D(h) = T(h),
or T(h) + 1 if no count after h is discounted (else h would leave no mass), and h' the history without its first word:

    P(w|h) = d(c) c / D(h)         if w was seen c > 0 times after h
           = alpha(h) P(w|h')      if h was seen, but never before w
           = P(w|h')               if h was never seen
    alpha(h) = (1 - sum of P(w|h)) / (1 - sum of P(w|h')), both over the words seen after h.

The unigram order leaves its own discounted mass to one unknown word. So all probabilities after any history sum to one.
Histories at the start of a text are padded. What alpha needs of a history are eleven whole numbers (its successors
by count up to TOP, the same by their count one order below, and the sum of the frequent ones' counts there); they add
up without rounding, so it makes no difference how a history's successors are spread over partitions.

Everything is counted over all training documents, and stored:
1. Blocks of documents are written as word numbers (`tokens`).
2. Order by order, blocks deal out their distinct n-grams by history (a history of more than
   max(HOT_TOKENS, tokens / HOT) tokens by a hash of history and word); each partition adds up counts, stores its part of
   the order's count table (histories, words, counts) and answers every block: places, counts, and of histories that must
   back off their eleven numbers. The hot histories' numbers, at most HOT of them, are summed by a groupBy.
   An n-gram's number is its place in its order's table; so a history is one number, its n-gram's one order below, and
   goes where that table keeps it. The number of partitions follows the bytes of text (`PART_BYTES` each), whatever the
   session's settings.
3. With all counts of counts known, each block evaluates its n-grams order by order, the recursion above.

`fit` keeps the tables; `score` evaluates new texts on them. Words are told apart by 64-bit hashes.

Null text counts as empty: one end token after the start. With nothing to learn from, all scores use the unknown word
alone. Rows with null ids are training rows (their crc32 isn't 0 modulo 10), rows with repeated ids get a row each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_path, drop_table, fold, prepare, read_table, write_bucketed, write_table
from .packing import by_bucket, dealt_out, pack, pack_sorted, parts_of, record, rows_of, schema_of, unpack, unpack_sorted
from .textcore import blocks, bounds, mix, words

ORDER, TOP = 3, 5
BLOCK = 8 << 20
END = np.uint64(0x1D8E4E27C47D124F)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: A number after all others: of n-grams that aren't in a table, and of the start of a text.
LAST = np.iinfo(np.int64).max
#: Bytes of text whose n-grams a partition counts on average.
PART_BYTES = 8 << 20
#: Histories of more than 1/HOT of all tokens, and of more than HOT_TOKENS, are hot: at most HOT of each order.
HOT, HOT_TOKENS = 100_000, 1_000_000
#: Numbers kept of a history: successors by count, the same by count one order below, their sum of frequent counts.
FACTS = 2 * TOP + 1
STORED = -1  # the block number of a row of a stored count table


# --- the model's arithmetic ------------------------------------------------------------------------------------------


def counts_of_counts(c: np.ndarray) -> list[int]:
    return [int((c == r).sum()) for r in range(1, TOP + 2)]


def discounts(n: list[int]) -> np.ndarray:
    """Katz's discounts of counts 0..TOP (0 unused), from counts of counts 1..TOP + 1; where Good-Turing gives none in
    (0, 1), absolute discounting's (r - D) / r stands in."""
    d = np.ones(TOP + 1)
    flat = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    tail = (TOP + 1) * n[TOP] / n[0] if n[0] else 1.0
    for r in range(1, TOP + 1):
        gt = ((r + 1) * n[r] / (r * n[r - 1]) - tail) / (1 - tail) if n[r - 1] and tail < 1 else 0.0
        d[r] = gt if 0 < gt < 1 else (r - min(max(flat, 0.05), 0.95)) / r
    return d


def discounted(count: np.ndarray, d: np.ndarray) -> np.ndarray:
    """d(c) c; counts over TOP are whole."""
    return np.where(count > TOP, 1.0, d[np.minimum(count, TOP)]) * count


class Unigrams:
    """P(w) by count, and of the unknown word."""

    def __init__(self, stats: list[int]):
        self.distinct, self.total = stats[0], stats[1]
        self.d = discounts(stats[2:])
        n = np.array(stats[2 : 2 + TOP])
        left = float((n * np.arange(1, TOP + 1) * (1 - self.d[1:])).sum())
        self.all = self.total + (0 if left > 0 else 1)
        self.unknown = (left if left > 0 else 1) / max(1, self.all)

    def p(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, discounted(count, self.d) / max(1, self.all), self.unknown)


def facts_of(owner: np.ndarray, count: np.ndarray, below: np.ndarray, n: int) -> np.ndarray:
    """(n, FACTS) whole numbers of n histories from their seen successors' counts, here and one order below."""
    out = np.zeros((n, FACTS), np.int64)
    for k, c in ((0, count), (TOP, below)):
        low = c <= TOP
        out[:, k : k + TOP] = np.bincount(owner[low] * TOP + c[low] - 1, minlength=n * TOP).reshape(n, TOP)
    high = below > TOP
    np.add.at(out[:, 2 * TOP], owner[high], below[high])
    return out


def lone(facts: np.ndarray) -> np.ndarray:
    """1 for histories none of whose counts is discounted."""
    return (facts[:, :TOP].sum(1) == 0).astype(np.int64)


def alphas(facts: np.ndarray, size: np.ndarray, size_below: np.ndarray, d: np.ndarray, d_below: np.ndarray) -> np.ndarray:
    """Back-off weights of histories with these numbers; size: D(h), size_below: D(h')."""
    r = np.arange(1, TOP + 1)
    left = facts[:, :TOP] @ (r * (1 - d[1:])) + lone(facts)
    rest = (size_below - facts[:, 2 * TOP]) - facts[:, TOP : 2 * TOP] @ (r * d_below[1:])
    return left / size / (rest / size_below)


# --- blocks of documents ---------------------------------------------------------------------------------------------

TOKENS = "block long, ids array<bigint>, train binary, words binary, tokens binary, sizes binary"
TOKENS_SCHEMA = schema_of(TOKENS)


def block_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's distinct word hashes, its tokens as numbers into them (an end after each document), their sizes."""
    base = TaskContext.get().partitionId() << 32
    for k, b in enumerate(blocks(batches, limit=BLOCK)):
        _, _, row, h = words(b)
        at = bounds(row, len(b))
        every = np.empty(len(h) + len(b), np.uint64)
        every[np.arange(len(h)) + row] = h
        every[at[1:] + np.arange(len(b))] = END
        kinds, of = np.unique(every, return_inverse=True)
        train = b.rows.column(2).to_numpy(zero_copy_only=False).astype(bool)
        yield record(TOKENS_SCHEMA, [(base + k, b.rows.column(0).cast(pa.int64()).to_pylist(), pack(train), pack_sorted(kinds), pack(of), pack(np.diff(at).astype(np.int64) + 1))])


class Texts:
    """A block's tokens, and of each order its distinct n-grams as arrays: (history, word, suffix), and once they are
    known their numbers in the stored table and counts. A history is given by the place of its n-gram one order below;
    the place after the last one is the start of a text. Places follow the tables' numbers, unseen n-grams come last."""

    def __init__(self, r: dict):
        self.of = unpack(r["tokens"])
        self.kinds = int(self.of.max()) + 1
        self.sizes = unpack(r["sizes"])
        self.train = unpack(r["train"]).astype(bool)
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.token = self.of
        self.history = self.word = self.suffix = np.zeros(0, np.int64)
        self.ids: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.log_p: np.ndarray | None = None  # in the order of this order's n-grams

    def number(self, ids: np.ndarray, counts: np.ndarray) -> None:
        """The table's numbers (LAST: not in it) and counts of the n-grams of this order."""
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.of = place[self.of]
        self.ids.append(ids[order])
        self.counts.append(counts[order])
        if len(self.ids) == 1:
            self.token = self.of
        else:
            self.history, self.word, self.suffix = self.history[order], self.word[order], self.suffix[order]
        if self.log_p is not None:
            self.log_p = self.log_p[order]

    def next_order(self) -> None:
        v = self.kinds
        before = np.empty(len(self.of), np.int64)
        before[1:] = self.of[:-1]
        before[self.first] = len(self.ids[-1])
        code, own = np.unique(before * v + self.token, return_inverse=True)
        self.history, self.word = code // v, code % v
        self.suffix = np.empty(len(code), np.int64)
        self.suffix[own] = self.of
        self.of = own

    def training_counts(self) -> np.ndarray:
        return np.bincount(self.of, self.train[self.doc]).astype(np.int64)


# --- order 1 ---------------------------------------------------------------------------------------------------------

WORDS = "bucket int, block long, keys binary, counts binary, ranks binary"
WORDS_SCHEMA = schema_of(WORDS)
TOLD_WORDS = "block long, bucket int, keys binary, ranks binary, counts binary, stats array<bigint>"
TOLD_WORDS_SCHEMA = schema_of(TOLD_WORDS)


def word_counts(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for r in rows_of(batches):
        key, count = unpack_sorted(r["words"]), Texts(r).training_counts()
        at = np.searchsorted(parts_of(key, buckets), np.arange(buckets + 1))
        yield record(WORDS_SCHEMA, [(k, r["block"], pack_sorted(key[i:j]), pack(count[i:j]), None) for k, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)) if j > i])


def add_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum each word's counts and answer each block; the words seen, ranked by falling count, are the stored table.
    A stored table among the rows keeps its ranks."""
    for bucket, rows in by_bucket(batches):
        keys = [unpack_sorted(r["keys"]) for r in rows]
        kinds, of = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(of, np.concatenate([unpack(r["counts"]) for r in rows]), minlength=len(kinds)).astype(np.int64)
        rank = np.zeros(len(kinds), np.int64)
        held = [r for r in rows if r["block"] == STORED]
        if held:
            for r in held:
                rank[np.searchsorted(kinds, unpack_sorted(r["keys"]))] = unpack(r["ranks"])
        else:
            rank[np.argsort(-total, kind="stable")] = np.arange(len(kinds))
        seen = total > 0
        yield record(TOLD_WORDS_SCHEMA, [(STORED, bucket, pack_sorted(kinds[seen]), pack(rank[seen]), pack(total[seen]), [int(seen.sum()), int(total.sum()), *counts_of_counts(total)])])
        at = 0
        for r, k in zip(rows, keys, strict=True):
            own = of[at : at + len(k)]
            at += len(k)
            if r["block"] != STORED:
                yield record(TOLD_WORDS_SCHEMA, [(r["block"], bucket, None, pack(rank[own]), pack(total[own]), None)])


# --- orders 2 and up -------------------------------------------------------------------------------------------------

GRAMS = "bucket int, block long, heads binary, many binary, flags binary, words binary, counts binary, below binary"
GRAMS_SCHEMA = schema_of(GRAMS)
TOLD = "block long, bucket int, heads binary, many binary, flags binary, words binary, counts binary, below binary, ranks binary, facts binary, hot binary, stats array<bigint>"
TOLD_SCHEMA = schema_of(TOLD)
#: Flags of a history in a row: it is hot; it needs its numbers whatever its n-grams' counts.
IS_HOT, NEEDS = 1, 2


@dataclass
class Model:
    """What scoring needs: partitions of the tables, counts of counts by order, numbers of the hot histories, and the
    paths of the stored count tables."""

    order: int
    buckets: int
    starts: int
    #: Histories of more training tokens than this are hot.
    least_hot: int = HOT_TOKENS
    stats: list[list[int]] = field(default_factory=list)
    hot: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=lambda: [(np.zeros(0, np.int64), np.zeros((0, FACTS), np.int64))])
    paths: list[str] = field(default_factory=list)


class Dealt:
    """How a block deals out its n-grams of the order that `t` has reached: `gram`, those asked about, and `heads`, their
    histories, in the order of the rows. A history goes where the table one order below keeps its n-gram."""

    def __init__(self, t: Texts, model: Model):
        self.ids = np.append(t.ids[-1], LAST)
        #: T(h), of the start of texts too.
        self.size = np.append(t.counts[-1], model.starts)
        self.below = t.counts[-1][t.suffix]
        known = self.size[t.history] > 0
        asked = known & (self.below > 0)
        hot = self.size > model.least_hot
        self.needs = np.zeros(len(self.size), bool)
        self.needs[t.history[known & ~asked]] = True
        where = np.minimum(self.ids >> 32, model.buckets - 1)
        self.gram = np.flatnonzero(asked)
        history = t.history[self.gram]
        at, spread = where[history], hot[history]
        if spread.any():
            h, w = self.ids[history[spread]].astype(np.uint64), t.ids[0][t.word[self.gram[spread]]].astype(np.uint64)
            at[spread] = parts_of(mix(h ^ mix(w + _STEP)), model.buckets)
        place = at * len(self.ids) + history  # sorted but for hot histories
        if spread.any():
            order = np.argsort(place, kind="stable")
            self.gram, place = self.gram[order], place[order]
        first = np.flatnonzero(np.diff(place, prepend=-1))
        heads, self.many = place[first], np.diff(first, append=len(place))
        alone = self.needs & ~hot  # histories without an n-gram to ask about
        alone[history] = False
        if alone.any():
            alone = np.flatnonzero(alone)
            heads = np.concatenate([heads, where[alone] * len(self.ids) + alone])
            self.many = np.concatenate([self.many, np.zeros(len(alone), np.int64)])
            order = np.argsort(heads, kind="stable")
            heads, self.many = heads[order], self.many[order]
        self.heads, bucket = heads % len(self.ids), heads // len(self.ids)
        self.hot = hot[self.heads]
        #: Of each row its bucket, and the bounds of its histories and n-grams.
        first = np.flatnonzero(np.diff(bucket, prepend=-1))
        self.bucket = bucket[first]
        self.head_at = np.append(first, len(heads))
        self.gram_at = np.concatenate([[0], np.cumsum(self.many)])[self.head_at]

    def rows(self) -> Iterator[tuple[int, int, int, int, int]]:
        return zip(self.bucket.tolist(), self.head_at[:-1].tolist(), self.head_at[1:].tolist(), self.gram_at[:-1].tolist(), self.gram_at[1:].tolist(), strict=True)

    def flags(self, i: int, j: int) -> np.ndarray:
        return IS_HOT * self.hot[i:j] + NEEDS * self.needs[self.heads[i:j]]


def know_words(t: Texts, told: list[dict]) -> None:
    """Take in the answers about the block's words."""
    counts = joined(told, "counts")
    if len(counts) != t.kinds:
        raise RuntimeError("a block got no answer about some of its words")
    ids = np.concatenate([(a["bucket"] << 32) + unpack(a["ranks"]) for a in told])
    t.number(np.where(counts > 0, ids, LAST), counts)


def know_grams(t: Texts, d: Dealt, told: list[dict]) -> np.ndarray:
    """Counts of the block's n-grams of the order just dealt, from the answers about them."""
    counts, got = np.zeros(len(t.history), np.int64), joined(told, "counts")
    if [a["bucket"] for a in told] != d.bucket.tolist() or len(got) != len(d.gram):
        raise RuntimeError("a block got no answer about some of its n-grams")
    counts[d.gram] = got
    return counts


def number_grams(t: Texts, d: Dealt, told: list[dict], counts: np.ndarray) -> None:
    """Take in the counts and, from the answers, numbers of these n-grams."""
    ids = np.full(len(counts), LAST)
    ids[d.gram[counts[d.gram] > 0]] = np.concatenate([*((a["bucket"] << 32) + unpack_sorted(a["ranks"], np.int64) for a in told), np.zeros(0, np.int64)])
    t.number(ids, counts)


def joined(told: list[dict], name: str) -> np.ndarray:
    return np.concatenate([*(unpack(a[name]) for a in told), np.zeros(0, np.int64)])


def told_by_order(r: dict, order: int) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in range(order)]
    for a in sorted(r["told"], key=lambda a: a["bucket"]):
        out[a["n"] - 1].append(a)
    return out


def gram_counts(batches: Iterator[pa.RecordBatch], order: int, model: Model) -> Iterator[pa.RecordBatch]:
    """From blocks with the answers about lower orders: their distinct n-grams of this order, by history."""
    for r in rows_of(batches):
        told = told_by_order(r, order - 1)
        t = Texts(r)
        know_words(t, told[0])
        for k in range(2, order + 1):
            t.next_order()
            d = Dealt(t, model)
            if k < order:
                number_grams(t, d, told[k - 1], know_grams(t, d, told[k - 1]))
        own = t.training_counts()
        out = []
        for b, i, j, lo, hi in d.rows():
            gram = d.gram[lo:hi]
            out.append((b, r["block"], pack_sorted(d.ids[d.heads[i:j]]), pack(d.many[i:j]), pack(d.flags(i, j)), pack(t.ids[0][t.word[gram]]), pack(own[gram]), pack(d.below[gram])))
        yield record(GRAMS_SCHEMA, out)


def add_grams(batches: Iterator[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
    """Add up a bucket's n-grams, store its part of the count table (its numbers are their ranks), answer each block."""
    for bucket, rows in by_bucket(batches):
        heads, many, flags = [unpack_sorted(r["heads"], np.int64) for r in rows], [unpack(r["many"]) for r in rows], [unpack(r["flags"], np.uint8) for r in rows]
        hist, of_head = np.unique(np.concatenate(heads), return_inverse=True)
        word, of_word = np.unique(np.concatenate([unpack(r["words"]) for r in rows]), return_inverse=True)
        pair, of = np.unique(np.repeat(of_head, np.concatenate(many)) * max(1, len(word)) + of_word, return_inverse=True)
        owner, word = pair // max(1, len(word)), word[pair % max(1, len(word))]
        below = np.empty(len(pair), np.int64)
        below[of] = np.concatenate([unpack(r["below"]) for r in rows])  # of one n-gram all rows have the same
        times = np.bincount(of, np.concatenate([unpack(r["counts"]) for r in rows]), minlength=len(pair)).astype(np.int64)
        seen = times > 0
        facts = facts_of(owner[seen], times[seen], below[seen], len(hist))
        hot = np.zeros(len(hist), bool)
        hot[of_head[(np.concatenate(flags) & IS_HOT) > 0]] = True
        first = np.flatnonzero(np.diff(owner[seen], prepend=-1))
        held = owner[seen][first]
        yield record(TOLD_SCHEMA, [(STORED, bucket, pack_sorted(hist[held]), pack(np.diff(first, append=int(seen.sum()))), pack(IS_HOT * hot[held]), pack(word[seen]), pack(times[seen]), pack(below[seen]), None, None, pack(np.concatenate([hist[hot][:, None], facts[hot]], 1).ravel()), [int(seen.sum()), int(times.sum()), *counts_of_counts(times)])])
        rank = np.cumsum(seen) - 1
        lo = i = 0
        for r, h, m, f in zip(rows, heads, many, flags, strict=True):
            hi, j = lo + int(m.sum()), i + len(h)
            own, mine = of[lo:hi], of_head[i:j]
            lo, i = hi, j
            if r["block"] != STORED:
                count = times[own]
                back = wanted(count, m, f)
                # whether a history has no discounted count is told of all of them, their numbers only where they back off
                yield record(TOLD_SCHEMA, [(r["block"], bucket, None, None, pack(lone(facts[mine])), None, pack(count), None, None if last else pack_sorted(rank[own[count > 0]]), pack(facts[mine[back]].ravel()), None, None)])


def wanted(count: np.ndarray, many: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Which histories of a row are answered in full: those asked for, or with an n-gram never seen, unless hot."""
    never = np.bincount(np.repeat(np.arange(len(many)), many), count == 0, minlength=len(many)) > 0
    return (never | ((flags & NEEDS) > 0)) & ((flags & IS_HOT) == 0)


def evaluate(batches: Iterator[pa.RecordBatch], held: object) -> Iterator[pa.RecordBatch]:
    """Sums by document of the log-probabilities of its tokens."""
    model: Model = held.value
    uni = Unigrams(model.stats[0])
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    for r in rows_of(batches):
        told = told_by_order(r, model.order)
        t = Texts(r)
        know_words(t, told[0])
        n, count = len(t.sizes), t.counts[0]
        known = np.bincount(t.doc, (count > 0)[t.of], minlength=n).astype(np.int64)
        base = np.bincount(t.doc, np.log10((count + 0.1) / (uni.total + 0.1 * (uni.distinct + 1)))[t.of], minlength=n)
        log_p, d_below = np.log10(uni.p(count)), uni.d
        size_below, shorter = np.array([float(uni.all)]), np.zeros(len(count), np.int64)  # the empty history's D; which it is
        for k in range(2, model.order + 1):
            t.next_order()
            d, disc = Dealt(t, model), discounts(model.stats[k - 1][2:])
            count = know_grams(t, d, told[k - 1])
            size, back, facts = histories(d, told[k - 1], count, *model.hot[k - 1])
            log_a = np.where(size > 0, np.nan, 0.0)
            log_a[back] = np.log10(alphas(facts, size[back], size_below[np.append(shorter, len(size_below) - 1)[back]], disc, d_below))
            seen = count > 0
            log_p = np.where(seen, np.log10(np.where(seen, discounted(count, disc), 1.0) / np.maximum(size[t.history], 1)), log_p[t.suffix] + log_a[t.history])
            if k < model.order:
                t.log_p = log_p  # goes along as the n-grams are put in order
                number_grams(t, d, told[k - 1], count)
                log_p = t.log_p
            d_below, size_below, shorter = disc, size, t.suffix
        if np.isnan(log_p).any():
            raise RuntimeError("a block got no answer about a history that backs off")
        total = np.bincount(t.doc, log_p[t.of], minlength=n)
        yield pa.RecordBatch.from_arrays([pa.array(r["ids"], pa.int64()), pa.array(~t.train), pa.array(t.sizes), pa.array(known), pa.array(np.full(n, uni.total)), pa.array(base), pa.array(total)], names)


def histories(d: Dealt, told: list[dict], count: np.ndarray, hot_id: np.ndarray, hot_facts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(D(h) of the block's histories; those of which the numbers are there; these numbers)."""
    size, back, facts = d.size.astype(np.float64), [], []
    for a, (_, i, j, lo, hi) in zip(told, d.rows(), strict=True):
        h, hot = d.heads[i:j], d.hot[i:j]
        size[h[~hot]] += unpack(a["flags"])[~hot]
        back.append(h[wanted(count[d.gram[lo:hi]], d.many[i:j], d.flags(i, j))])
        facts.append(unpack(a["facts"]).reshape(-1, FACTS))
    if len(hot_id):
        at = np.minimum(np.searchsorted(hot_id, d.ids), len(hot_id) - 1)
        own = np.flatnonzero((hot_id[at] == d.ids) & (d.size > 0))
        back.append(own)
        facts.append(hot_facts[at[own]])
        size[own] += lone(facts[-1])
    return size, np.concatenate([*back, np.zeros(0, np.int64)]), np.concatenate([*facts, np.zeros((0, FACTS), np.int64)])


# --- the whole run ---------------------------------------------------------------------------------------------------


def summed(df: DataFrame) -> list[int]:
    """Statistics of all partitions added up; a handful of numbers."""
    got = df.where("stats is not null").select(F.posexplode("stats")).groupBy("pos").agg(F.sum("col").alias("n")).collect()
    at = {r["pos"]: r["n"] for r in got}
    return [int(at.get(k, 0)) for k in range(TOP + 3)]


def hot_numbers(told: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the hot histories, summed over the partitions that they are spread over; at most HOT rows."""
    names = [f"n{k}" for k in range(FACTS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows_of(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in unpack(r["hot"]).reshape(-1, FACTS + 1).T], ["id", *names])

    got = told.where("length(hot) > 0").select("hot").mapInArrow(run, ", ".join(f"{c} long" for c in ("id", *names)))
    rows = got.groupBy("id").agg(*[F.sum(c).alias(c) for c in names]).collect()
    x = np.array(sorted(tuple(r) for r in rows), np.int64).reshape(-1, FACTS + 1)
    return x[:, 0], x[:, 1:]


def run(spark: SparkSession, docs: DataFrame, train, order: int = ORDER, model: Model | None = None) -> tuple[DataFrame, Model, list[str], str]:
    """(scores, model, paths of the tables that only this run needs, name of the table of tokens). With a model its stored tables give all counts and
    `train` must be false; without one, the rows for which it holds are counted and the tables stored."""
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(train, F.lit(True)).alias("train"))
    hashed, hashed_path = write_table(spark, docs.mapInArrow(block_tokens, TOKENS), "hashed")
    drop, new = [], model is None
    if new:
        size = docs.agg(F.sum(F.octet_length("text")).alias("n"), F.count_if("train").alias("starts")).first()
        model = Model(order, max(1, -(-(size["n"] or 0) // PART_BYTES)), size["starts"])
    answers: DataFrame | None = None
    none = F.lit(None).cast("binary")
    for k in range(1, model.order + 1):
        if k == 1:
            asked, kind = hashed.mapInArrow(partial(word_counts, buckets=model.buckets), WORDS), TOLD_WORDS
            step = add_words
        else:
            asked, kind = met(tokens, answers, model.buckets).mapInArrow(partial(gram_counts, order=k, model=bare(model)), GRAMS), TOLD
            step = partial(add_grams, last=k == model.order)
        if not new:
            asked = asked.unionByName(spark.read.parquet(model.paths[k - 1]).where(F.col("block") == STORED).select(*asked.columns))
        told, path = write_table(spark, dealt_out(asked, model.buckets).mapInArrow(step, kind), f"grams{k}")
        if new:
            model.paths.append(path)
            model.stats.append(summed(told))
            model.least_hot = max(HOT_TOKENS, model.stats[0][1] // HOT)
            if k > 1:
                model.hot.append(hot_numbers(told))
        else:
            drop.append(path)
        if k == 1:  # from here on words are numbers
            tokens, name = write_bucketed(spark, hashed.drop("words"), "tokens", "block", model.buckets)
            drop_path(spark, hashed_path)
        own = told.where(F.col("block") != STORED).select("block", F.lit(k).alias("n"), "bucket", "counts", "ranks", *(F.col(c) if k > 1 else none.alias(c) for c in ("flags", "facts")))
        answers = own if answers is None else answers.unionByName(own)
    shared = spark.sparkContext.broadcast(model)  # at most HOT histories an order
    scores = met(tokens, answers, model.buckets).mapInArrow(partial(evaluate, held=shared), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scores, model, drop, name


def bare(model: Model) -> Model:
    """The model without its hot histories, small enough to go with each task."""
    return Model(model.order, model.buckets, model.starts, model.least_hot, model.stats)


def met(tokens: DataFrame, answers: DataFrame, buckets: int) -> DataFrame:
    """Blocks with all answers to them; a block has at most one of each order and bucket. The answers are dealt as the
    table of tokens lies, so that they move once and it doesn't."""
    told = answers.repartition(buckets, "block").groupBy("block").agg(F.collect_list(F.struct("n", "bucket", "ranks", "counts", "flags", "facts")).alias("told"))
    return tokens.join(told, "block").select(*tokens.columns, "told")


def fit(spark: SparkSession, docs: DataFrame, order: int = ORDER) -> Model:
    """A model of all rows of docs(doc_id, text). Its count tables stay in the shared folder, at `paths`."""
    _, model, paths, name = run(spark, docs, F.lit(True), order)
    forget(spark, paths, name)
    return model


def score(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """Scores of every row of docs(doc_id, text) under a fitted model."""
    scores, _, paths, name = run(spark, docs, F.lit(False), model.order, model)
    out, _ = write_table(spark, scores, "scores")
    forget(spark, paths, name)
    return out


def score_texts(spark: SparkSession, docs: DataFrame, train, order: int = ORDER) -> DataFrame:
    """Scores of every row of docs(doc_id, text); train: a boolean Column, whether a row is learned from."""
    scores, model, paths, name = run(spark, docs, train, order)
    out, _ = write_table(spark, scores, "scores")
    forget(spark, [*paths, *model.paths], name)
    return out


def forget(spark: SparkSession, paths: list[str], name: str) -> None:
    for p in paths:
        drop_path(spark, p)
    drop_table(spark, name)


def op10_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spark, read_table(spark, sf_dir, "documents"), fold("doc_id", 10) != 0)
