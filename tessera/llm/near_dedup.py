"""Operator 8: near-duplicates by banded MinHash with sequential Bayesian verification.

1. Every text becomes its set of distinct 5-word shingles (64-bit hashes), a fingerprint of the set and a signature of
   one byte per minimum (100 minima: 20 bands of 5). Texts with equal sets form one class, so copies are never paired.
2. The signatures of class representatives are dealt out by band key. Inside a bucket, pairs are compared one batch of
   16 minima after the other; after each batch a pair is dropped when the posterior probability that its similarity
   reaches the threshold has fallen below `MISS`. What survives leaves only a spanning forest, not all pairs.
3. The forests' edges are verified on full shingle sets: each text goes to its roots, a root to all parts of its group.
4. Where an edge fails, the components of the verified links on both its sides, all that it connected, are compared:
   the texts of the largest one go to one block each, the others to every block of the group, and pairs that survive the
   same pruning and aren't connected yet get their exact intersection.
5. Components of the verified links, with the smallest id of each.

Buckets and groups larger than a block are split, so that no task holds an unbounded group; a group's blocks are bounded by
shingles too, and no task gathers texts. No pair of different texts that agrees in a band is lost but for `MISS`; texts at
the threshold 0.85 agree in one of the bands with probability 1 - (1 - 0.85^5)^20 > 0.99999.

Null or empty texts have no shingles, link with nothing and are their own component; so are rows with a null id, whose
component is null and which are kept. Rows with the same id give a row each and share a component, that of all their texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Kept, components, prepare, read_table, small, write_table
from .textcore import blocks, mix, shingle_sets

BANDS, ROWS, BATCH = 20, 5, 16
MINIMA = BANDS * ROWS
MISS = 1e-6
#: Members of a bucket, and of a component (with their texts), that one task compares with as many others.
BUCKET_BLOCK, TEXT_BLOCK = 1024, 256
#: Buckets of more rows than this are compared by pivots.
PIVOT_FROM = 64
#: Shingles of a component that one such block holds on average, where its texts are long.
SHINGLE_BLOCK = 1 << 22
#: Groups of a sorted stream are handed on together up to about so many bytes.
GROUP_BYTES = 64 << 20
_RNG = np.random.default_rng(8)
_A = _RNG.integers(1, 2**31, MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 2**32, MINIMA, dtype=np.uint32)


def signature(own: np.ndarray) -> bytes:
    """The low bytes of the set's minima under MINIMA hash functions."""
    h = (own >> np.uint64(32)).astype(np.uint32)
    low = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(h), 1024):
        x = h[i : i + 1024] * _A[:, None] + _B[:, None]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        np.minimum(low, x.min(1), out=low)
    return low.astype(np.uint8).tobytes()


def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in blocks(batches):
        sets = shingle_sets(b)
        with np.errstate(over="ignore"):
            one = np.array([int(np.bitwise_xor.reduce(mix(s))) if len(s) else 0 for s in sets], np.uint64)
            two = np.array([int(np.add.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D)))) & (2**64 - 1) if len(s) else 0 for s in sets], np.uint64)
        yield pa.RecordBatch.from_arrays([b.rows.column(0).cast(pa.int64()), pa.array(np.array([len(s) for s in sets], np.int64)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array([signature(s) if len(s) else b"" for s in sets], pa.binary())], ["doc_id", "n", "f1", "f2", "sig"])


@cache
def least_matches(percent: int, minima: int) -> tuple[int, ...]:
    """For each batch of minima seen so far, the fewest matches with P(similarity >= threshold | matches) >= MISS.

    The prior of the similarity is uniform; a byte of different minima agrees with probability 1/256."""
    grid = (np.arange(4000) + 0.5) / 4000
    match = grid + (1 - grid) / 256
    high = grid >= percent / 100
    out = []
    for n in range(BATCH, minima + BATCH, BATCH):
        n = min(n, minima)
        m = np.arange(n + 1)[:, None]
        like = m * np.log(match) + (n - m) * np.log1p(-match)
        like = np.exp(like - like.max(1, keepdims=True))
        out.append(int(np.argmax(like[:, high].sum(1) / like.sum(1) >= MISS)))
    return tuple(out)


def plausible(a: np.ndarray, b: np.ndarray, sig: np.ndarray, size: np.ndarray, percent: int) -> np.ndarray:
    """Which of the pairs (a[i], b[i]) survive the size bound and every batch of minima."""
    small, large = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
    live = np.flatnonzero(100 * small >= percent * large)
    got = np.zeros(len(live), np.int64)
    for k, least in enumerate(least_matches(percent, MINIMA)):
        part = sig[:, k * BATCH : (k + 1) * BATCH]
        got = got + (part[a[live]] == part[b[live]]).sum(1)
        keep = got >= least
        live, got = live[keep], got[keep]
    return live


def merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least labels after joining a[i] with b[i]; root: labels so far, root[x] <= x."""
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == root).all():
            return root
        root = new


def groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], size: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    """Record batches that hold whole groups of a stream sorted by keys, small groups together: up to about `size` rows
    or GROUP_BYTES."""
    held: list[pa.RecordBatch] = []
    rows = volume = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        change = starts_of(batch, keys)[1:-1]
        if held and any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in keys):
            change = np.concatenate([[0], change])
        if len(change) and (rows + batch.num_rows >= size or volume + batch.nbytes >= GROUP_BYTES):
            cut = int(change[-1])
            yield joined([*held, batch.slice(0, cut)])
            held, rows, volume, batch = [], 0, 0, batch.slice(cut)
        held.append(batch)
        rows += batch.num_rows
        volume += batch.nbytes
    if held:
        yield joined(held)


def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One batch of all parts' rows, with 64-bit offsets: texts or bytes over 2 GB don't fit into one chunk otherwise."""
    wide = {pa.string(): pa.large_string(), pa.binary(): pa.large_binary()}
    table = pa.Table.from_batches(parts)
    table = table.cast(pa.schema([(f.name, wide.get(f.type, f.type)) for f in table.schema]))
    got = table.combine_chunks().to_batches()
    if len(got) != 1:
        raise RuntimeError(f"a group of {table.num_rows} rows doesn't fit into one batch")
    return got[0]


def starts_of(batch: pa.RecordBatch, keys: tuple[str, ...]) -> np.ndarray:
    cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
    return np.concatenate([[0], np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1, [batch.num_rows]]) if batch.num_rows else np.zeros(1, np.int64)


def pairs_in(at: np.ndarray, side: np.ndarray | None = None, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows inside each group [at[g], at[g + 1]), in portions of about `most`. With side (0: only the first
    block, 1: only the second), pairs of different blocks."""
    left = np.arange(at[-1])
    end = np.repeat(at[1:], np.diff(at))
    count = end - left - 1
    total = np.cumsum(count)
    i = 0
    while i < len(left):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + most, side="right")))
        c = count[i:j]
        a = np.repeat(left[i:j], c)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(c) - c, c)
        if side is not None:
            two = side[a] | side[b]
            ok = (two == 0) | (side[a] != side[b])  # side: 0 in a diagonal pair of blocks, else 1 and 2
            a, b = a[ok], b[ok]
        yield a, b
        i = j


def joined_by(root: np.ndarray, a: np.ndarray, b: np.ndarray, band: np.ndarray, sig: np.ndarray, size: np.ndarray, percent: int) -> np.ndarray:
    """Labels after joining those of the pairs (a[i], b[i]) that are plausible and agree in this band first."""
    live = plausible(a, b, sig, size, percent)
    a, b = a[live], b[live]
    first = np.ones(len(a), bool)
    for k in range(BANDS):
        own = np.flatnonzero(first & (band[a] > k))
        if len(own):
            part = sig[:, k * ROWS : (k + 1) * ROWS]
            first[own[(part[a[own]] == part[b[own]]).all(1)]] = False
    return merge(root, a[first], b[first]) if first.any() else root


def by_pivots(rows: np.ndarray, root: np.ndarray, join) -> np.ndarray:
    """Labels after comparing the first of a bucket's rows with all, and then those outside the largest component found."""
    step = max(1, (1 << 20) // len(rows))
    pairs = lambda pivots: (np.repeat(pivots, len(rows)), np.tile(rows, len(pivots)))
    root = join(root, *pairs(rows[:1]))
    largest = np.bincount(root[rows] - rows[0]).argmax() + rows[0]
    rest = rows[root[rows] != largest]
    for i in range(0, len(rest), step):
        root = join(root, *pairs(rest[i : i + step]))
    return root


def forests(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Edges (rep, root) that span the plausible pairs of each bucket (or pair of a bucket's blocks). In a bucket of over
    `PIVOT_FROM` rows the first row is compared with all; then the rows outside the largest component found, with all
    that they aren't connected with yet: pairs inside a component tell nothing new."""
    for batch in groups(batches, ("band", "key", "bi", "bj")):
        at = starts_of(batch, ("band", "key", "bi", "bj"))
        rep, size, side = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("rep", "n", "side"))
        band = batch.column("band").to_numpy(zero_copy_only=False)
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8).reshape(-1, MINIMA) if batch.num_rows else np.zeros((0, MINIMA), np.uint8)
        root = np.arange(len(rep))
        large = np.flatnonzero(np.diff(at) > PIVOT_FROM)
        alone = [np.arange(at[g], at[g + 1]) for g in large.tolist()]  # not paired here

        def join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
            ok = (root[a] != root[b]) & ((side[a] != side[b]) | (side[a] == 0))
            return joined_by(root, a[ok], b[ok], band, sig, size, percent)

        for a, b in pairs_in(np.unique(np.concatenate([at, *alone])), side):
            root = join(root, a, b)
        for rows in alone:
            root = by_pivots(rows, root, join)
        own = np.flatnonzero(root != np.arange(len(root)))
        yield pa.RecordBatch.from_arrays([pa.array(rep[own]), pa.array(rep[root[own]])], ["u", "v"])


def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A stream with each text replaced by the bytes of its shingle set, so that no texts are gathered."""
    for b in blocks(batches):
        sets = pa.array([s.tobytes() for s in shingle_sets(b)], pa.large_binary())
        yield pa.RecordBatch.from_arrays([sets if n == "text" else b.rows.column(n) for n in b.rows.schema.names], b.rows.schema.names)


def shingles_of(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(s.as_buffer(), np.uint64) for s in batch.column("text")]


def stars(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """For each edge (rep, root), one with side 0 being the root itself: whether the link is there."""
    for batch in groups(shingled(batches), ("comp", "bi"), 2048):
        if not batch.num_rows:
            continue
        at = starts_of(batch, ("comp", "bi"))
        rep, comp, side = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("rep", "comp", "side"))
        sets = shingles_of(batch)
        linked = np.zeros(batch.num_rows, bool)
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            roots = [sets[i] for i in range(lo, hi) if side[i] == 0]
            for i in np.flatnonzero(side[lo:hi] != 0) + lo:
                linked[i] = any(100 * (n := common(sets[i], r)) >= percent * (len(sets[i]) + len(r) - n) for r in roots)
        edge = side != 0
        yield pa.RecordBatch.from_arrays([pa.array(rep[edge]), pa.array(comp[edge]), pa.array(linked[edge])], ["u", "v", "linked"])


def common(a: np.ndarray, b: np.ndarray) -> int:
    """The size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def verified(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Spanning forests of the exact links, in a block of a group, between texts that aren't connected (`known`) yet."""
    for batch in groups(shingled(batches), ("comp", "bi"), 2048):
        if not batch.num_rows:
            continue
        at = starts_of(batch, ("comp", "bi"))
        rep, side, known = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("rep", "side", "known"))
        sets = shingles_of(batch)
        u, v = [], []
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            first, of = np.unique(known[lo:hi], return_index=True, return_inverse=True)[1:]
            start = first[of]
            root = exact_links(sets[lo:hi], side[lo:hi], start, percent)
            own = np.flatnonzero(root != start)
            u.append(rep[lo + own])
            v.append(rep[lo + root[own]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"])


#: Sides of a block: of the largest component, dealt once; of another one, at home in another block or in this one.
DATA, GUEST, HOME = 0, 1, 2


def exact_links(sets: list[np.ndarray], side: np.ndarray, start: np.ndarray, percent: int) -> np.ndarray:
    """Least labels of the components of exact links among some sets, from the labels `start`. Intersections with all
    others are counted at once from the postings of a set's shingles, and only where a plausible pair isn't connected
    yet. Pairs of two DATA sets or two GUEST sets aren't looked at here."""
    n, root = len(sets), start
    if n < 2:
        return root
    size = np.array([len(s) for s in sets], np.int64)
    sig = np.frombuffer(b"".join(signature(s) for s in sets), np.uint8).reshape(n, MINIMA)
    every, code = np.unique(np.concatenate(sets), return_inverse=True)
    edge = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(code, kind="stable")
    posting, begin = owner[order], np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(every)))])
    for i in range(n):
        b = np.arange(i + 1, n)
        b = b[(root[b] != root[i]) & ((side[b] != side[i]) | (side[b] == HOME))]
        if len(b):
            b = b[plausible(np.full(len(b), i), b, sig, size, percent)]
        if not len(b):
            continue
        own = code[edge[i] : edge[i + 1]]
        first, many = begin[own], begin[own + 1] - begin[own]
        spots = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        shared = np.bincount(posting[spots], minlength=n)[b]
        b = b[100 * shared >= percent * (size[i] + size[b] - shared)]
        if len(b):
            root = merge(root, np.full(len(b), i), b)
    return root


def dealt(rows: DataFrame, keys: list[str], count: str, block: int, by: str = "rep") -> DataFrame:
    """Rows of groups over `block` members go to every pair of blocks that theirs is part of: bi, bj, and side (0 in a
    pair of a block with itself, else 1 or 2)."""
    own = rows.withColumn("nb", F.ceil(F.col(count) / block).cast("int")).withColumn("own", F.pmod(F.xxhash64(by), F.col("nb")).cast("int"))
    wide = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    wide = wide.withColumns({"bi": F.least("own", "other"), "bj": F.greatest("own", "other"), "side": F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)})
    return wide.drop("nb", "own", "other").repartition(*keys, "bi", "bj").sortWithinPartitions(*keys, "bi", "bj")


def with_texts(docs: DataFrame, rows: DataFrame, sizes: DataFrame, everywhere: Column, kept: Kept) -> DataFrame:
    """rows(comp, rep, ..) with their texts, dealt to blocks of groups: those that are `everywhere` to every block of
    their group, others to one. A group has a block for each TEXT_BLOCK members (sizes: comp, members, volume) or
    SHINGLE_BLOCK shingles, whatever is more, up to one for each member. side: DATA, GUEST or HOME."""
    n = F.greatest(F.ceil(F.col("members") / TEXT_BLOCK), F.least(F.ceil(F.col("volume") / SHINGLE_BLOCK), F.col("members"))).cast("int")
    rows = rows.join(small(kept(sizes, "sizes")).select("comp", n.alias("nb")), "comp").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"))
    rows = rows.withColumn("bi", F.explode(F.when(everywhere, F.sequence(F.lit(0), F.col("nb") - 1)).otherwise(F.array("own"))))
    rows = rows.withColumn("side", F.when(~everywhere, DATA).when(F.col("bi") == F.col("own"), HOME).otherwise(GUEST)).drop("nb", "own")
    rows = kept(rows, "dealt")
    texts = docs.where("doc_id is not null").join(small(rows), F.col("doc_id") == F.col("rep")).drop("doc_id")
    return texts.repartition("comp", "bi").sortWithinPartitions("comp", "bi")


def labelled(spark: SparkSession, docs: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs(doc_id, text); links: 100 * intersection >=
    percent * union."""
    prepare(spark)
    kept = Kept(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = kept(docs.mapInArrow(sketches, "doc_id long, n long, f1 long, f2 long, sig binary"), "sketch")
    key = ["f1", "f2", "n"]
    # equal sets have equal signatures
    reps = kept(sketch.where("n > 0 and doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")), "reps")
    bands = reps.select("rep", F.posexplode(F.array(*[F.substring("sig", ROWS * k + 1, ROWS) for k in range(BANDS)])).alias("band", "part")).select("rep", "band", F.conv(F.hex("part"), 16, 10).cast("long").alias("key"))
    shared = bands.groupBy("band", "key").agg(F.count("*").alias("members")).where("members > 1")
    member = bands.join(shared, ["band", "key"]).join(reps.select("rep", "n", "sig"), "rep")
    edges = dealt(member, ["band", "key"], "members", BUCKET_BLOCK).select("band", "key", "bi", "bj", "side", "rep", "n", "sig").mapInArrow(partial(forests, percent=percent), "u long, v long")
    edges = kept(edges.where("u <> v").distinct(), "edges")

    volume = reps.groupBy("rep").agg(F.max("n").alias("n"))
    tested = kept(tested_edges(spark, docs, edges, volume, percent, kept), "tested")
    repeated = kept(sketch.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id"), "repeated")
    links = tested.where("linked").select("u", "v")
    if not repeated.isEmpty():  # an id's texts are one node
        links = links.union(sketch.where("n > 0").join(repeated, "doc_id").join(reps, key).select(F.col("doc_id").alias("u"), F.col("rep").alias("v")))
    comp = kept.also(components(spark, links))
    failed = tested.where("not linked").select("u", "v")
    if not failed.isEmpty():
        more = kept(more_links(spark, docs, failed, comp, volume, percent, kept), "more")
        comp = kept.also(components(spark, links.union(more)))
    # texts without words have no class, and all of them the same key
    named = reps.join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left").select(*key, F.coalesce("component", "rep").alias("component"))
    worded = sketch.where("n > 0").select("doc_id", *key).join(named, key, "left").select("doc_id", "n", "component")
    out = worded.union(sketch.where("n = 0").select("doc_id", "n", F.lit(None).cast("long")))
    if not repeated.isEmpty():
        again = repeated.join(comp, F.col("doc_id") == F.col("node")).select("doc_id", F.col("component").alias("joint"))
        out = out.join(again, "doc_id", "left").select("doc_id", "n", F.coalesce("joint", "component").alias("component"))
    c = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component", "doc_id"))
    out, _ = write_table(spark, out.select("doc_id", F.col("n").alias("n_shingles"), c.alias("component_id"), F.coalesce(c == F.col("doc_id"), F.lit(True)).alias("kept")), "labelled")
    kept.drop()
    return out


def tested_edges(spark: SparkSession, docs: DataFrame, edges: DataFrame, volume: DataFrame, percent: int, kept: Kept) -> DataFrame:
    """(u, v, linked) of the edges (u, v), by full shingle sets."""
    rows = edges.select(F.col("v").alias("comp"), F.col("u").alias("rep"), F.lit(False).alias("root"))
    sizes = edges.join(volume, F.col("u") == F.col("rep")).groupBy(F.col("v").alias("comp")).agg(F.count("*").alias("members"), F.sum("n").alias("volume"))
    rows = rows.union(sizes.select("comp", F.col("comp").alias("rep"), F.lit(True)))
    texts = with_texts(docs, rows, sizes, F.col("root"), kept)
    return texts.select("comp", "bi", F.when(F.col("root"), 0).otherwise(1).alias("side"), "rep", "text").mapInArrow(partial(stars, percent=percent), "u long, v long, linked boolean").groupBy("u", "v").agg(F.max("linked").alias("linked"))


def more_links(spark: SparkSession, docs: DataFrame, failed: DataFrame, comp: DataFrame, volume: DataFrame, percent: int, kept: Kept) -> DataFrame:
    """Links between components that were connected by failed edges only."""
    label = comp.select(F.col("node").alias("rep"), F.col("component").alias("known"))
    ends = failed.join(label.withColumnsRenamed({"rep": "u", "known": "a"}), "u", "left").join(label.withColumnsRenamed({"rep": "v", "known": "b"}), "v", "left")
    ends = ends.select(F.coalesce("a", "u").alias("u"), F.coalesce("b", "v").alias("v")).where("u <> v")
    coarse = kept.also(components(spark, ends)).select(F.col("node").alias("known"), F.col("component").alias("comp"))
    alone = failed.select(F.explode(F.array("u", "v")).alias("rep")).distinct().join(label, "rep", "left_anti").select("rep", F.col("rep").alias("known"))
    rest = kept(label.union(alone).join(coarse, "known").join(volume, "rep"), "rest")
    parts = rest.groupBy("comp", "known").agg(F.count("*").alias("members"), F.sum("n").alias("volume"))
    sizes = parts.groupBy("comp").agg(F.sum("members").alias("members"), F.sum("volume").alias("volume"), F.max(F.struct("members", "known"))["known"].alias("largest"))
    rows = rest.drop("n").join(small(kept(sizes.select("comp", "largest"), "largest")), "comp").withColumn("other", F.col("known") != F.col("largest")).drop("largest")
    texts = with_texts(docs, rows, sizes, F.col("other"), kept)
    return texts.select("comp", "bi", "side", "rep", "known", "text").mapInArrow(partial(verified, percent=percent), "u long, v long")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, read_table(spark, sf_dir, "documents"))


OP8_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT w.doc_id, count(s.s) AS n FROM w LEFT JOIN s ON w.doc_id = s.doc_id GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS c FROM n UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.c),
c AS (SELECT a AS doc_id, min(c) AS component_id FROM r GROUP BY 1)
SELECT n.doc_id, n.n AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept FROM n JOIN c ON n.doc_id = c.doc_id"""
