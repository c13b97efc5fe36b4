"""Operator 7: SentencePiece encoding and decoding as a weighted finite-state transducer.

Three machines are compiled from the model file: the normaliser N (dummy prefix, blank to U+2581), the piece machine P
(a trie of all pieces whose arcs spell a piece and end in it) and the byte fallback B (any character that is no piece,
to its UTF-8 bytes). For a BPE model a fourth machine C accepts piece sequences: a pair of neighbours has weight 0 if
merging the two texts from characters gives back just this pair, and infinity if not. A sequence is the BPE result of
its text exactly if each of its pairs is, so the only path of finite weight in (text . N . (P | B) . C) is the
encoding; the tropical-semiring shortest path over that lattice is computed left to right, and since the best path
to each position is unique, a position keeps one state. Other model types are refused: this file is a BPE model.

No piece holds U+2581 after another character, so the lattice falls apart before each blank. The distinct chunks of a
block of texts are composed together, chunks of equal length advancing by one position at a time in numpy; an arc of C is
compiled when first met and kept (a bounded cache of the worker process).

Null text counts as empty (no ids). Decoding undoes the dummy prefix; bytes that are no UTF-8 become U+FFFD as in the
library. Extra columns are kept by `encode`; `ids`, `n_tokens` and `decoded` of the input are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import appended, prepare, read_table
from .textcore import STEP, blocks, mix

BLANK = "▁"
CHUNK = re.compile(f"{BLANK}+[^{BLANK}]*")
#: Arcs and chunks kept in a worker; characters of chunks that advance together; chunks over LONG are cut further.
ARCS, KEPT, CELLS, LONG = 1_200_000, 250_000, 1 << 17, 64
#: Chunks of more characters than WIDE advance alone, by windows of so many positions.
WIDE, WINDOW = 1024, 1 << 15
SLOTS = 1 << 20
HASH = np.uint64(0xD1342543DE82EF95)
BLOCK = 2 << 20


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol-buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        x = shift = 0
        while True:
            b = data[i]
            i += 1
            x |= (b & 127) << shift
            if b < 128:
                return x
            shift += 7

    while i < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[i : i + n]
            i += n


class Numbered(dict):
    """Numbers keys as they are asked for; `new` lists those numbered since it was emptied."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        self.new.append(key)
        return n


class Transducer:
    """The compiled machines of one model file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            model = list(fields(f.read()))
        trainer = dict(x for k, v in model if k == 2 for x in fields(v))
        normal = dict(x for k, v in model if k == 3 for x in fields(v))
        if trainer.get(3, 1) != 2:
            raise ValueError("only BPE models are supported")
        if normal.get(2) or normal.get(1) not in (b"identity", None) or normal.get(4, 1):
            raise ValueError("only the identity normaliser without white-space removal is supported")
        self.prefix = bool(normal.get(3, 1))
        self.text: list[str] = []
        self.kind: list[int] = []
        score: list[float] = []
        for k, v in model:
            if k == 1:
                p = dict(fields(v))
                self.text.append(p[1].decode())
                self.kind.append(p.get(3, 1))
                score.append(float(np.frombuffer(p.get(2, bytes(4)), np.float32)[0]))
        self.piece = {t: i for i, (t, k) in enumerate(zip(self.text, self.kind, strict=True)) if k in (1, 4)}
        if any(k == 4 for k in self.kind) or any(BLANK in t.lstrip(BLANK) for t in self.piece):
            raise ValueError("user-defined pieces and pieces with an inner blank aren't supported")
        self.byte = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.text, self.kind, strict=True)) if k == 6}
        self.value = {i: b for b, i in self.byte.items()}
        self.unknown = next((i for i, k in enumerate(self.kind) if k == 2), 0)
        order = sorted(self.piece.values(), key=lambda i: -score[i])
        self.rank = {p: r for r, p in enumerate(order)}  # the lower, the sooner merged
        self.longest = max(map(len, self.piece))
        self.halves: dict[int, tuple[int, int] | None] = {}
        for p in self.piece.values():
            self.halves[p] = self._last_merge(self.text[p])
        self._forget_arcs()
        self._forget_chunks()
        #: What a piece decodes to; bytes beyond ASCII are put together in decode.
        self.surface = [t if k in (1, 4) else chr(self.value[i]) if i in self.value else "" if k == 3 else " ⁇ " for i, (t, k) in enumerate(zip(self.text, self.kind, strict=True))]
        self.high = np.array([self.value.get(i, 0) > 127 for i in range(len(self.text))])
        self.slot_key, self.slot_piece, self.probes = np.zeros(SLOTS, np.uint64), np.full(SLOTS, -1, np.int32), 1
        for i, h in zip(self.piece.values(), self.hash_all(list(self.piece)).tolist(), strict=True):
            k = 0
            while self.slot_key[at := ((h >> 44) + k) & (SLOTS - 1)]:
                k += 1
            self.slot_key[at], self.slot_piece[at] = h, i
            self.probes = max(self.probes, k + 1)
        self.prefix_bits = np.zeros(1 << 22, bool)
        self.prefix_bits[(self.hash_all(list({t[:k] for t in self.piece for k in range(1, len(t))}), True) >> np.uint64(42)).astype(np.int64)] = True

    @staticmethod
    def hash_all(texts: list[str], prefix: bool = False) -> np.ndarray:
        h, sizes = np.zeros(len(texts), np.uint64), np.array([len(t) for t in texts])
        for k in range(int(sizes.max(initial=0))):
            own = np.flatnonzero(sizes > k)
            h[own] = h[own] * HASH + mix(np.array([ord(texts[i][k]) for i in own], np.uint64) + STEP)
        return mix(h ^ STEP if prefix else h)

    def is_prefix(self, h: np.ndarray) -> np.ndarray:
        """Whether some longer piece may start so (never a false no; a false yes only costs a look-up)."""
        return self.prefix_bits[(h >> np.uint64(42)).astype(np.int64)]

    def _last_merge(self, text: str) -> tuple[int, int] | None:
        """The two pieces that merge into a piece last when it is built from characters; None for a character.
        A piece that its own characters never merge into can't occur: it gets (-1, -1)."""
        parts = list(text)
        last = None
        while len(parts) > 1:
            best = min(((self.rank[q], i) for i in range(len(parts) - 1) if (q := self.piece.get(parts[i] + parts[i + 1])) is not None), default=None)
            if best is None:
                return (-1, -1)
            i = best[1]
            if len(parts) == 2:
                a, b = self.piece.get(parts[0]), self.piece.get(parts[1])
                last = (-1, -1) if a is None or b is None else (a, b)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return last

    def allowed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Arcs of C: whether the texts of each a and b, one after the other, are merged into just a, b."""
        key = (a.astype(np.int64) << 32) | (b.astype(np.int64) + 1)
        out = self._known_arcs(key)
        new = out < 0
        if new.any():
            fresh = np.unique(key[new])
            if self.arcs + len(fresh) > ARCS:
                self._forget_arcs()
                fresh = np.unique(key)
            for k, at in zip(fresh.tolist(), self._arc_slot(fresh).tolist(), strict=True):
                while self.arc_key[at]:
                    at = (at + 1) & (2 * SLOTS - 1)
                self.arc_key[at], self.arc_ok[at] = k, self._meets(k >> 32, (k & 0xFFFFFFFF) - 1)
            self.arcs += len(fresh)
            out = self._known_arcs(key)
        return out == 1

    def _forget_arcs(self) -> None:
        self.arc_key, self.arc_ok, self.arcs = np.zeros(2 * SLOTS, np.int64), np.zeros(2 * SLOTS, np.int8), 0

    @staticmethod
    def _arc_slot(key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * HASH) >> np.uint64(43)).astype(np.int64)

    def _known_arcs(self, key: np.ndarray) -> np.ndarray:
        """1: allowed, 0: forbidden, -1: not compiled yet."""
        at = self._arc_slot(key)
        held = self.arc_key[at]
        out = np.where(held == key, self.arc_ok[at], np.int8(-1))
        left = np.flatnonzero((held != key) & (held != 0))
        while len(left):
            at[left] = (at[left] + 1) & (2 * SLOTS - 1)
            held = self.arc_key[at[left]]
            same = held == key[left]
            out[left[same]] = self.arc_ok[at[left[same]]]
            left = left[~same & (held != 0)]
        return out

    def _meets(self, a: int, b: int) -> bool:
        """One arc of C. Both pieces are undone merge by merge, the latest first. The pieces that face each other at the
        border at that time must not merge with each other before either is merged into what stands above it (on a tie
        of ranks the leftmost merge comes first)."""
        never = len(self.rank)
        # times at which the facing pieces of each side are merged away: (rank, side); later first
        until_a = until_b = (never, 0)
        rank, text = self.rank, self.text
        while True:
            joined = self.piece.get(text[a] + text[b])
            if joined is not None:
                r = rank[joined]
                # of equal rank the leftmost goes first: a's own merge lies left of the border, b's right of it
                if r < until_a[0] and r <= until_b[0]:
                    return False
            ha, hb = self.halves[a], self.halves[b]
            if ha is None and hb is None:
                return True
            if hb is None or (ha is not None and rank[a] > rank[b]):
                until_a, a = (rank[a], 0), ha[1]
            else:
                until_b, b = (rank[b], 0), hb[0]

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Piece ids of text hashes, -1 where there is none."""
        at = (h >> np.uint64(44)).astype(np.int64)
        out = np.full(len(h), -1, np.int32)
        for k in range(self.probes):
            slot = (at + k) & (SLOTS - 1)
            hit = self.slot_key[slot] == h
            out[hit] = self.slot_piece[slot[hit]]
        return out

    def paths(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Shortest paths of many chunks at once: (ids of all, number of each). Chunks of equal length advance together,
        one position at a time."""
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        letters = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.cumsum(sizes) - sizes
        found, counts = [], np.zeros(len(chunks), np.int64)
        for i in np.flatnonzero(sizes > WIDE).tolist():
            ids = self._long(letters[first[i] : first[i] + sizes[i]])
            counts[i] = len(ids)
            found.append((np.array([i]), ids))
        for n in np.unique(sizes[sizes <= WIDE]).tolist():
            own = np.flatnonzero(sizes == n)
            for part in np.array_split(own, -(-len(own) * max(n, 1) // CELLS)):
                ids, number = self._same_length(letters[first[part][:, None] + np.arange(n)], n)
                counts[part] = number
                found.append((part, ids))
        at = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int32)
        for part, ids in found:
            c = counts[part]
            out[np.repeat(at[part] - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))] = ids
        return out, counts

    def _same_length(self, letters: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        m = len(letters)
        code = mix(letters.astype(np.uint64) + STEP)
        spelled: dict[tuple[int, int], np.ndarray] = {}  # P: the piece spelled by [s, e)
        for s in range(n):
            h, rows = np.zeros(m, np.uint64), np.arange(m)
            for e in range(s + 1, min(n, s + self.longest) + 1):
                h = h * HASH + code[rows, e - 1]
                got = np.full(m, -1, np.int32)
                got[rows] = self.lookup(mix(h))
                spelled[s, e] = got
                more = self.is_prefix(mix(h ^ STEP))
                rows, h = rows[more], h[more]
                if not len(rows):
                    break
        state = np.full((m, n + 1), -2, np.int32)  # the piece that ends here; -1: byte fallback or start; -2: none
        back = np.zeros((m, n + 1), np.int32)
        state[:, 0] = -1
        for e in range(1, n + 1):
            todo = np.arange(m)
            for s in range(max(0, e - self.longest), e):
                got = spelled.get((s, e))
                if got is None or not len(todo):
                    continue
                cand = todo[(got[todo] >= 0) & (state[todo, s] != -2)]
                if not len(cand):
                    continue
                prev = state[cand, s]
                ok = prev == -1
                if not ok.all():
                    ok[~ok] = self.allowed(prev[~ok], got[cand[~ok]])
                cand = cand[ok]
                state[cand, e], back[cand, e] = got[cand], s
                todo = todo[state[todo, e] == -2]
            lone = todo[spelled[e - 1, e][todo] < 0]
            state[lone, e], back[lone, e] = -1, e - 1
        if (state[:, n] == -2).any():
            raise AssertionError("a chunk has no path")
        rev, of, end, rows = [], [], np.full(m, n), np.arange(m)
        while len(rows := rows[end[rows] > 0]):
            p, s = state[rows, end[rows]], back[rows, end[rows]]
            plain = p >= 0
            rev.append(p[plain])
            of.append(rows[plain])
            if not plain.all():
                for r, c in zip(rows[~plain].tolist(), letters[rows[~plain], s[~plain]].tolist(), strict=True):
                    raw = chr(c).encode("utf-8", "replace")
                    add = [self.byte[x] for x in reversed(raw)] if self.byte else [self.unknown]
                    rev.append(np.array(add, np.int32))
                    of.append(np.full(len(add), r))
            end[rows] = s
        row = np.concatenate(of) if of else np.zeros(0, np.int64)
        order = np.argsort(row[::-1], kind="stable")
        ids = (np.concatenate(rev) if rev else np.zeros(0, np.int32))[::-1]
        return ids[order], np.bincount(row, minlength=m)

    def _long(self, letters: np.ndarray) -> np.ndarray:
        """The shortest path of one long chunk: pieces are looked up for a window of positions at a time, and the states
        are advanced one by one. Time and memory are in proportion to its length."""
        n, k = len(letters), self.longest
        state, back = [-2] * (n + 1), np.zeros(n + 1, np.int32)
        state[0] = -1
        known: dict[int, bool] = {}
        for lo in range(0, n, WINDOW):
            ends = np.arange(lo + 1, min(n, lo + WINDOW) + 1)
            starts, at, piece = self._spelled(letters, max(0, lo + 1 - k), int(ends[-1]))
            mine = at > lo
            order = np.lexsort((starts[mine], at[mine]))
            starts, at, piece = (x[mine][order] for x in (starts, at, piece))
            bound = np.searchsorted(at, np.append(ends, ends[-1] + 1)).tolist()
            starts, piece = starts.tolist(), piece.tolist()
            if len(known) > ARCS:
                known.clear()
            for e, i, j in zip(ends.tolist(), bound[:-1], bound[1:], strict=True):
                for c in range(i, j):
                    p, q = state[starts[c]], piece[c]
                    if p == -2:
                        continue
                    ok = True
                    if p >= 0:
                        ok = known.get(p << 32 | q)
                        if ok is None:
                            ok = known[p << 32 | q] = self._meets(p, q)
                    if ok:
                        state[e], back[e] = q, starts[c]
                        break
                else:
                    if i == j or starts[j - 1] != e - 1:  # the character is no piece
                        state[e], back[e] = -1, e - 1
        if state[n] == -2:
            raise AssertionError("a chunk has no path")
        out, e = [], n
        while e:
            s = int(back[e])
            if state[e] >= 0:
                out.append(state[e])
            else:
                raw = chr(letters[s]).encode("utf-8", "replace")
                out += [self.byte[x] for x in reversed(raw)] if self.byte else [self.unknown]
            e = s
        return np.array(out[::-1], np.int32)

    def _spelled(self, letters: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of all pieces inside letters[lo:hi]."""
        code = mix(letters[lo:hi].astype(np.uint64) + STEP)
        rows, h = np.arange(hi - lo), np.zeros(hi - lo, np.uint64)
        out = []
        for size in range(1, self.longest + 1):
            fits = rows + size <= hi - lo
            rows, h = rows[fits], h[fits]
            h = h * HASH + code[rows + size - 1]
            got = self.lookup(mix(h))
            hit = got >= 0
            out.append((rows[hit] + lo, rows[hit] + lo + size, got[hit]))
            more = self.is_prefix(mix(h ^ STEP))
            rows, h = rows[more], h[more]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def chunks(self, text: str) -> list[str]:
        """The normaliser, and the cuts before blanks."""
        if not text:
            return []
        text = ((BLANK if self.prefix else "") + text).replace(" ", BLANK)
        found = CHUNK.findall(text)
        if text[0] != BLANK:
            found.insert(0, text[: (text + BLANK).index(BLANK)])
        if len(text) > LONG * len(found):  # long runs without a blank: also cut around characters that are no pieces
            found = [c for x in found for c in (self.cut(x) if len(x) > LONG else (x,))]
        return found

    def cut(self, chunk: str) -> list[str]:
        out, at = [], 0
        for i, c in enumerate(chunk):
            if c not in self.piece:
                out += [x for x in (chunk[at:i], c) if x]
                at = i + 1
        return out + [chunk[at:]] * (at < len(chunk))

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of each)."""
        if len(self.index) > KEPT:
            self._forget_chunks()
        seq, sizes = [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            own = self.chunks(t)
            sizes[i] = len(own)
            seq += map(self.index.__getitem__, own)
        if new := self.index.new:
            ids, counts = self.paths(new)
            self.flat, self.counts = np.concatenate([self.flat, ids]), np.concatenate([self.counts, counts])
            self.at = np.cumsum(self.counts) - self.counts
            self.index.new = []
        seq = np.array(seq, np.int64)
        each = self.counts[seq]
        total = np.concatenate([[0], np.cumsum(each)])
        ids = self.flat[np.repeat(self.at[seq] - total[:-1], each) + np.arange(total[-1])]
        edge = np.concatenate([[0], np.cumsum(sizes)])
        return ids, total[edge[1:]] - total[edge[:-1]]

    def _forget_chunks(self) -> None:
        self.index, self.flat, self.counts, self.at = Numbered(), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        out, raw = [], bytearray()

        def flush() -> None:
            """Bytes become text character by character; each byte that belongs to none becomes U+FFFD."""
            i = 0
            while i < len(raw):
                for n in range(1, 5):
                    try:
                        out.append(bytes(raw[i : i + n]).decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    n = 1
                    out.append("�")
                i += n
            raw.clear()

        for p in ids:
            if self.value.get(p, 0) > 127:
                raw.append(self.value[p])
                continue
            if raw:
                flush()
            out.append(self.surface[p])
        if raw:
            flush()
        return self.finish("".join(out))

    def spell(self, ids: list[int]) -> str:
        """decode for ids without bytes beyond ASCII."""
        return self.finish("".join(map(self.surface.__getitem__, ids)))

    def finish(self, text: str) -> str:
        if self.prefix and text.startswith(BLANK):
            text = text[1:]
        return text.replace(BLANK, " ")


@cache
def transducer(name: str) -> Transducer:
    import public_tokenizers

    return Transducer(public_tokenizers.path(name))


def run(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    t = transducer(name)
    for b in blocks(batches, limit=BLOCK):
        ids, n = t.encode_batch([b.text(i) for i in range(len(b))])
        at = np.concatenate([[0], np.cumsum(n)])
        lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
        high = np.concatenate([[0], np.cumsum(t.high[ids])])
        plain = (high[at[1:]] == high[at[:-1]]).tolist()
        every, at = ids.tolist(), at.tolist()
        text = [(t.spell if ok else t.decode)(every[i:j]) for i, j, ok in zip(at, at[1:], plain)]
        yield pa.RecordBatch.from_arrays([*b.rows.columns, lists, pa.array(n), pa.array(text, pa.string())], [*b.rows.schema.names, "ids", "n_tokens", "decoded"])


def encode(docs: DataFrame, name: str = "piece_bpe_32k.model") -> DataFrame:
    """docs with ids, n_tokens and decoded (the text that the ids decode to) appended."""
    prepare(docs.sparkSession)
    own = docs.drop("ids", "n_tokens", "decoded")
    return own.mapInArrow(partial(run, name=name), appended(own, ids="array<int>", n_tokens="long", decoded="string"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "ids", "n_tokens", "decoded")
