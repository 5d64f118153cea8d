"""Pairs of texts with nearly the same runs of words, on little disk: signatures of parts of the sets are shuffled, sets only of
rows that some other may resemble."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.session import cut_lineage

#: Keys that are broadcast at most, to leave rows out or to keep only theirs; beyond, both sides are shuffled.
BROADCAST_KEYS = 2_000_000
#: About so many rows tell which signatures are common. They settle an order, never what is found.
ORDERED_BY = 20_000
#: Bits of the buckets in which signatures are counted for that order.
COUNTED_BITS = 20
#: Parts a set has, for each element in which two similar sets of its class of sizes can differ.
PARTS = 1.35
#: Bytes of sketches that are broadcast at most; beyond, candidates meet only when their sets do.
SKETCH_BYTES = 64 << 20
#: Words, signatures and pairs that are worked on at once.
WORDS, HELD, AT_ONCE = 200_000, 500_000, 1_000_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _within(n: np.ndarray) -> np.ndarray:
    """0 .. n-1 for each n, one after the other."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def sets_of(words: pa.ListArray, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(the first row, the sizes of the sets, their hashes): distinct runs of n neighbouring words of each row, hashed and
    sorted; a row of fewer words is one run, one without words none."""
    lens = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = words.flatten().dictionary_encode()
    each = np.array([int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little") for w in flat.dictionary.to_pylist()], np.uint64)
    flat = flat.indices.to_numpy(zero_copy_only=False)
    ends = np.cumsum(lens)
    cuts = np.flatnonzero(np.diff(ends // WORDS, prepend=0)) if len(ends) else []
    for lo, hi in zip([0, *cuts], [*cuts, len(lens)]):
        if lo == hi:
            continue
        k = lens[lo:hi]
        w = each[flat[ends[lo] - lens[lo] : ends[hi - 1]]]
        runs = np.where(k > 0, np.maximum(k - n + 1, 1), 0)
        row = np.repeat(np.arange(hi - lo), runs)
        at = _within(runs)
        begin, left = (np.cumsum(k) - k)[row] + at, k[row] - at
        h = np.full(len(row), n, np.uint64)
        for j in range(n):
            h = _mix(h * np.uint64(31) + np.where(left > j, w[np.minimum(begin + j, len(w) - 1)], np.uint64(j)))
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        yield lo, np.bincount(row[new], minlength=hi - lo), h[new]


def signatures(sizes: np.ndarray, hashes: np.ndarray, threshold: float) -> tuple[np.ndarray, ...]:
    """(row of each entry, how many signatures it may miss, entry of each signature, signature, elements in its part).

    Sets of one class of sizes have the same number of parts, to which elements belong by hash; a signature stands for all
    elements of a part. Sets as similar as the threshold differ in a bounded number of elements, and so of parts: of any one
    order of all signatures they share one of the first so many, and one more. A set that may resemble one of the next class
    is an entry of that class too."""
    c = (1 - threshold) / (1 + threshold)
    bounds = [1]
    while bounds[-1] <= max([1, *sizes]) / threshold:
        bounds.append(int(np.ceil(bounds[-1] * max(2, 1 / threshold))))
    bounds = np.array([*bounds, 2 * bounds[-1] + 1])
    row = np.flatnonzero(sizes)
    own = np.searchsorted(bounds, sizes[row], "right") - 1
    up = np.flatnonzero(sizes[row] / threshold >= bounds[own + 1] - 1e-9)
    row, group = np.concatenate([row, row[up]]), np.concatenate([own, own[up] + 1])
    most = bounds[group + 1] - 1
    size = sizes[row]
    missed = np.floor(c * (size + np.minimum(np.floor(size / threshold + 1e-9), most)) + 1e-9).astype(np.int64)
    parts = np.floor(PARTS * 2 * c * most).astype(np.int64) + 1
    start = np.cumsum(parts) - parts
    h = hashes[np.repeat((np.cumsum(sizes) - sizes)[row], size) + _within(size)]
    slot = np.repeat(start, size) + (_mix(h + np.uint64(1)) % np.repeat(parts, size).astype(np.uint64)).astype(np.int64)
    v = _mix(h + np.uint64(2))
    total = int(parts.sum())
    # halves, as sums of floats are exact only up to 53 bits
    low = np.bincount(slot, (v & np.uint64(0xFFFFFFFF)).astype(float), total).astype(np.uint64)
    high = np.bincount(slot, (v >> np.uint64(32)).astype(float), total).astype(np.uint64)
    entry = np.repeat(np.arange(len(row)), parts)
    place = _mix(_mix(_within(parts).astype(np.uint64)) + np.repeat(group, parts).astype(np.uint64))
    return row, missed, entry, _mix(low + (high << np.uint64(32)) + place), np.bincount(slot, minlength=total)


def _bits(sizes: np.ndarray) -> np.ndarray:
    return 1 << np.maximum(6, np.ceil(np.log2(np.maximum(sizes, 1)))).astype(np.int64)


def sketches(sizes: np.ndarray, hashes: np.ndarray) -> bytes:
    """Of each set, as many bits as it has elements or more: whether the number of elements that fall on a bit is odd."""
    bits = _bits(sizes[sizes > 0])
    own = np.repeat(np.cumsum(bits) - bits, sizes[sizes > 0])
    at = own + (hashes & (np.repeat(bits, sizes[sizes > 0]) - 1).astype(np.uint64)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=int(bits.sum())) & 1).astype(np.uint8), bitorder="little").tobytes()


def by_bits(keys: np.ndarray, sizes: np.ndarray, words: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(keys in order, sketches as rows of whole numbers) by the bits of a sketch."""
    bits = _bits(sizes)
    start = np.cumsum(bits // 64) - bits // 64
    out = {}
    for b in np.unique(bits).tolist():
        at = np.flatnonzero(bits == b)
        at = at[np.argsort(keys[at])]
        out[b] = keys[at], words[start[at][:, None] + np.arange(b // 64)]
    return out


def _may(look: dict, a: tuple, b: tuple, threshold: float) -> np.ndarray:
    """Which pairs of (key, size) may be as similar as the threshold: bits in which two sketches differ are elements in which
    their sets do. A longer sketch is folded to the shorter one's length."""
    out = np.empty(len(a[0]), bool)
    most = np.floor((1 - threshold) / (1 + threshold) * (a[1].astype(np.int64) + b[1]) + 1e-9)
    x, y = _bits(a[1]), _bits(b[1])
    for p, q in {*zip(x.tolist(), y.tolist())}:
        these = np.flatnonzero((x == p) & (y == q))
        for k in range(0, len(these), step := max(1, (1 << 22) // max(p, q))):
            at = these[k : k + step]
            m, n = (look[z][1][np.searchsorted(look[z][0], c[at])] for z, c in ((p, a[0]), (q, b[0])))
            while m.shape[1] != n.shape[1]:
                if m.shape[1] < n.shape[1]:
                    m, n = n, m
                m = m[:, : m.shape[1] // 2] ^ m[:, m.shape[1] // 2 :]
            out[at] = np.bitwise_count(m ^ n).sum(1, dtype=np.int64) <= most[at]
    return out


def _pairs(keys: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float, look: dict | None) -> pa.RecordBatch:
    x, y = sizes[left], sizes[right]
    fits = (np.minimum(x, y) >= threshold * np.maximum(x, y) - 1e-9) & (keys[left] != keys[right])
    left, right = left[fits], right[fits]
    if look is not None:
        fits = _may(look, (keys[left], sizes[left]), (keys[right], sizes[right]), threshold)
        left, right = left[fits], right[fits]
    a, b = keys[left], keys[right]
    both = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], 1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.nulls(len(both), pa.binary())], ["a", "b", "job"])


def only(df: DataFrame, key: str, keys: DataFrame, how: str) -> DataFrame:
    """Rows of df by whether their key is among the keys, by a semi or an anti join."""
    return df.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, key, how)


def near_pairs(df: DataFrame, key: str, words: Column, n: int, threshold: float, total: int, block: int) -> DataFrame:
    """(key, other, overlap): Jaccard similarity of the n-word runs of each row with those of rows before it, at the threshold
    or over; key is a whole number, one of each row, and df has about `total` rows.

    Texts are read where they lie, once for signatures and sketches and once more for rows of candidate pairs; what is shuffled
    is some 7 bytes for each of the signatures that `signatures` asks for, by buckets of their hashes. Rows that share one are
    candidates if their sketches leave room; a signature of more than `block` rows is met block by block in other tasks. Sets
    themselves are shuffled for candidates only, whose overlap is exact."""
    spark = df.sparkSession
    kind = dict(df.dtypes)[key]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(6, int(np.ceil(np.log2(max(total, 1) / 4000 + 1))))
    top = lambda x, b: (x >> np.uint64(64 - b)).astype(np.int64)
    rows = df.withColumn(key, F.col(key).cast("bigint"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 << COUNTED_BITS, np.int64)
        for batch in batches:
            for _, sizes, hashes in sets_of(batch.column("ws"), n):
                sums += np.bincount(top(signatures(sizes, hashes, threshold)[3], COUNTED_BITS), minlength=len(sums))
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["bucket", "n"])

    few = rows.where(F.pmod(F.xxhash64(key), F.lit(max(1, total // ORDERED_BY))) == 0)
    sums = few.select(words.alias("ws")).mapInArrow(counted, "bucket BIGINT, n BIGINT").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    common = np.zeros(1 << COUNTED_BITS, np.uint8)
    common[sums.column(0).to_numpy()] = np.log2(1 + sums.column(1).to_numpy() / 4)
    shared = spark.sparkContext.broadcast(common)

    def about(k: np.ndarray, size: np.ndarray) -> bytes:
        return zlib.compress(np.diff(k, prepend=0).tobytes() + size.astype(np.int32).tobytes(), 1)

    def told(x: bytes) -> tuple[np.ndarray, np.ndarray]:
        x = zlib.decompress(x)
        return np.cumsum(np.frombuffer(x, np.int64, len(x) // 12)), np.frombuffer(x, np.int32, offset=len(x) // 12 * 8)

    def packed(parts: list[tuple], drawn: list[tuple]) -> pa.RecordBatch:
        k, size, s = (np.concatenate(x) for x in zip(*parts))
        bucket = top(s, bits)
        order = np.lexsort((k, bucket))
        k, size, s, bucket = k[order], size[order], s[order].astype(np.uint32), bucket[order]
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        spans = list(zip(cuts, [*cuts[1:], len(bucket)]))
        buckets, found = [*bucket[cuts], -1], [s[i:j].tobytes() for i, j in spans] + [b"".join(x for _, _, x in drawn)]
        whose = [about(k[i:j], size[i:j]) for i, j in spans] + [about(*(np.concatenate(x) for x in [*zip(*drawn)][:2]))]
        return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array(found, pa.binary()), pa.array(whose, pa.binary())], ["bucket", "s", "about"])

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, drawn, many = [], [], 0
        for batch in batches:
            keys = batch.column(key).to_numpy()
            for lo, sizes, hashes in sets_of(batch.column("ws"), n):
                row, missed, entry, s, count = signatures(sizes, hashes, threshold)
                order = np.lexsort((s, -count, shared.value[top(s, COUNTED_BITS)], entry))
                rank = _within(np.bincount(entry, minlength=len(row)))
                first = order[rank <= missed[entry]]  # entries stay where they are
                if len(first):
                    held.append((keys[lo + row[entry[first]]], sizes[row[entry[first]]], s[first]))
                many += len(first)
                some = np.flatnonzero(sizes)
                drawn.append((keys[lo + some], sizes[some], sketches(sizes, hashes)))
                if many >= HELD:
                    yield packed(held, drawn)
                    held, drawn, many = [], [], 0
        if held:
            yield packed(held, drawn)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            s = np.concatenate([np.frombuffer(x, np.uint32) for x, _ in rows])
            keys, sizes = (np.concatenate(x) for x in zip(*(told(y) for _, y in rows)))
            order = np.argsort(s, kind="stable")
            s, keys, sizes = s[order], keys[order], sizes[order]
            runs = np.diff(np.append(np.flatnonzero(np.diff(s.astype(np.int64), prepend=-1)), len(s)))
            for i in np.flatnonzero(runs > block):
                at = int(runs[:i].sum())
                blocks = [range(x, min(x + block, at + runs[i])) for x in range(at, at + runs[i], block)]
                for x in range(len(blocks)):
                    for y in range(x + 1):
                        p, q = slice(blocks[x].start, blocks[x].stop), slice(blocks[y].start, blocks[y].stop)
                        job = np.concatenate([[len(blocks[x])], keys[p], sizes[p], keys[q], sizes[q]]).astype(np.int64).tobytes()
                        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([job], pa.binary())], ["a", "b", "job"])
            before = np.where(np.repeat(runs, runs) > block, 0, _within(runs))
            ends = np.cumsum(before)
            cuts = np.flatnonzero(np.diff(ends // AT_ONCE, prepend=0))
            for i, j in zip([0, *cuts], [*cuts, len(s)]):
                if before[i:j].any():
                    left = np.repeat(np.arange(i, j), before[i:j])
                    yield _pairs(keys, sizes, left, left - 1 - _within(before[i:j]), threshold, look.value if look else None)

        last, rows = None, []
        for batch in batches:
            for bucket, s, about in zip(*(batch.column(c).to_pylist() for c in ("bucket", "s", "about"))):
                if bucket != last and rows:
                    yield from pairs(rows)
                    rows = []
                last = bucket
                rows.append((s, about))
        if rows:
            yield from pairs(rows)

    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for job in batch.column("job").to_pylist():
                x = np.frombuffer(job, np.int64)
                i, j = int(x[0]), (len(x) - 1) // 2 - int(x[0])
                keys, sizes = np.concatenate([x[1 : 1 + i], x[1 + 2 * i : 1 + 2 * i + j]]), np.concatenate([x[1 + i : 1 + 2 * i], x[1 + 2 * i + j :]])
                step = max(1, AT_ONCE // j)
                for k in range(0, i, step):
                    some = np.arange(k, min(k + step, i))
                    yield _pairs(keys, sizes, np.repeat(some, j), np.tile(np.arange(i, i + j), len(some)), threshold, look.value if look else None)

    kinds = "a BIGINT, b BIGINT, job BINARY"
    made = cut_lineage(rows.select(key, words.alias("ws")).mapInArrow(chosen, "bucket BIGINT, s BINARY, about BINARY"))
    drawn, look = made.where("bucket < 0"), None
    if (drawn.agg(F.sum(F.length("s"))).first()[0] or 0) <= SKETCH_BYTES and (got := drawn.select("s", "about").toArrow()).num_rows:
        keys, sizes = (np.concatenate(x) for x in zip(*map(told, got.column("about").to_pylist())))
        look = spark.sparkContext.broadcast(by_bits(keys, sizes, np.frombuffer(b"".join(got.column("s").to_pylist()), np.uint64)))
    dealt = made.where("bucket >= 0").repartition(tasks, "bucket").sortWithinPartitions("bucket")
    found = cut_lineage(dealt.mapInArrow(met, kinds))
    jobs = found.where("job IS NOT NULL").repartition(tasks).mapInArrow(crossed, kinds)
    pairs = cut_lineage(found.unionByName(jobs).where("job IS NULL").select("a", "b").distinct())

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(key)
            for lo, sizes, hashes in sets_of(batch.column("ws"), n):
                ends = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays([keys.slice(lo, len(sizes)), pa.array([hashes[e - z : e].tobytes() for e, z in zip(ends, sizes)], pa.binary())], [key, "hs"])

    @F.pandas_udf("double")
    def overlap(x: pd.Series, y: pd.Series) -> pd.Series:
        def of(p: bytes, q: bytes) -> float:
            both = len(np.intersect1d(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), assume_unique=True))
            return both / ((len(p) + len(q)) // 8 - both)

        return x.combine(y, of)

    asked = cut_lineage(pairs.select(F.explode(F.array("a", "b")).alias(key)).distinct())
    sets = only(rows, key, asked, "left_semi").select(key, words.alias("ws")).mapInArrow(kept, f"{key} BIGINT, hs BINARY")
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", overlap("x", "y").alias("overlap"))
    return both.where(F.col("overlap") >= threshold).select(F.col("a").cast(kind).alias(key), F.col("b").cast(kind).alias("other"), "overlap")
