"""Problem 8: documents, sized in tokens, put into containers of fixed capacity by dominance reduction and best fit.

Only how many items there are of each size decides a packing, and sizes are whole numbers up to the capacity, so the
instance is a histogram of at most `capacity` numbers, whatever the number of documents: that is all the driver sees.
It is packed there into patterns (sizes of one container, and how many containers have them):

1. Dominance reduction (Martello and Toth). For the largest size left, a set of at most three items is looked for that
   dominates every other container with that item: the items of any other set can be matched, alone or in groups, to
   single items of this one that are at least as large. That holds for a companion that fills the container exactly, for
   the largest companion where no two fit together, and, where no three do, for a largest companion as large as the best
   pair, or the two largest with no size between them. Such containers are fixed with all their multiples and leave the
   instance; a size without a provable choice is set aside.
2. The rest is packed by best fit, largest first, over the histogram of the room left.

The documents then learn their container without meeting each other: within its size each gets a rank (counts per
bucket, then ranks inside small buckets, so a size shared by a third of all documents spreads out), and the patterns say
which container holds which rank. Items above the capacity are cut into full pieces and a remainder first.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomtrace.session import cut_lineage

#: Buckets into which the items of one size are spread for ranking.
BUCKETS = 64


class _Sizes:
    """The sizes that still have items, ascending, with their counts."""

    def __init__(self, counts: dict[int, int]):
        self.n = {s: c for s, c in counts.items() if c > 0}
        self.order = sorted(self.n)

    def take(self, size: int, k: int) -> None:
        self.n[size] -= k
        if not self.n[size]:
            del self.n[size]
            self.order.pop(bisect_left(self.order, size))

    def put(self, size: int, k: int) -> None:
        if size not in self.n:
            insort(self.order, size)
        self.n[size] = self.n.get(size, 0) + k

    def at_most(self, room: int) -> int | None:
        i = bisect_left(self.order, room + 1)
        return self.order[i - 1] if i else None

    def between(self, low: int, high: int) -> bool:
        """Whether an item lies strictly between."""
        i = bisect_left(self.order, low + 1)
        return i < len(self.order) and self.order[i] < high

    def smallest(self, k: int) -> list[int]:
        """The k smallest items, repeated sizes counted."""
        out: list[int] = []
        for s in self.order:
            out += [s] * min(self.n[s], k - len(out))
            if len(out) == k:
                break
        return out


def _best_pair(left: _Sizes, room: int) -> tuple[int, int] | None:
    """The two items with the largest sum up to room; of equal sums the one with the larger item."""
    order, best = left.order, None
    i, j = 0, len(order) - 1
    while i <= j:
        total = order[i] + order[j]
        if total > room:
            j -= 1
            continue
        if i < j or left.n[order[i]] >= 2:
            if best is None or total > best[0] or total == best[0] and order[j] > best[2]:
                best = (total, order[i], order[j])
        i += 1
    return (best[2], best[1]) if best else None


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[Counter, int]], dict[int, int]]:
    """(fixed patterns with their multiples, the counts of what is left). Sizes are visited from the largest; one without
    a provable choice stays in the instance, as a companion for smaller ones too."""
    left, fixed = _Sizes(counts), []
    for big in sorted(left.n, reverse=True):
        room = capacity - big
        while left.n.get(big):
            left.take(big, 1)
            companions = _dominating(left, room)
            left.put(big, 1)
            if companions is None:
                break
            need = Counter([big, *companions])
            m = min(left.n[s] // c for s, c in need.items())
            for s, c in need.items():
                left.take(s, c * m)
            fixed.append((need, m))
    return fixed, left.n


def _dominating(left: _Sizes, room: int) -> tuple[int, ...] | None:
    """Companions that dominate any others in this room, if that can be shown."""
    low, one = left.smallest(3), left.at_most(room)
    if one is None:
        return ()
    if one == room or len(low) < 2 or low[0] + low[1] > room:
        return (one,)
    if len(low) < 3 or sum(low) > room:
        pair = _best_pair(left, room)
        second = left.at_most(min(room - one, one if left.n[one] > 1 else one - 1))
        if pair is None or one >= sum(pair):
            return (one,)
        if second is not None and not left.between(second, one):
            return (one, second)  # no other pair has a first item above `one` or a second one above `second`
    return None


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Counter, int]]:
    """Best fit, largest first: each item into the fullest container that takes it. Equal containers move together."""
    rooms: dict[int, list[tuple[Counter, int]]] = defaultdict(list)
    order: list[int] = []

    def put(room: int, pattern: Counter, m: int) -> None:
        if room not in rooms or not rooms[room]:
            if room not in rooms:
                insort(order, room)
        rooms[room].append((pattern, m))

    for size in sorted((s for s, c in counts.items() if c > 0), reverse=True):
        n = counts[size]
        while n:
            i = bisect_left(order, size)
            while i < len(order) and not rooms[order[i]]:
                rooms.pop(order[i])
                order.pop(i)
            if i == len(order):
                per = capacity // size
                if n >= per:
                    put(capacity - per * size, Counter({size: per}), n // per)
                if n % per:
                    put(capacity - (n % per) * size, Counter({size: n % per}), 1)
                break
            room = order[i]
            pattern, m = rooms[room].pop()
            fit = room // size
            full = min(m, n // fit)
            if full:
                put(room - fit * size, pattern + Counter({size: fit}), full)
                n -= full * fit
                m -= full
            if m and n and n < fit:
                put(room - n * size, pattern + Counter({size: n}), 1)
                m, n = m - 1, 0
            if m:
                put(room, pattern, m)
    return [(p, m) for room in order for p, m in rooms[room]]


def pack(counts: dict[int, int], capacity: int) -> list[tuple[Counter, int]]:
    """Patterns and multiples that hold every item once. Sizes lie between 1 and the capacity."""
    fixed, aside = reduce_by_dominance(counts, capacity)
    return fixed + best_fit(aside, capacity)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Containers that any packing needs: by volume, and one for each item over half the capacity."""
    volume = -(-sum(s * c for s, c in counts.items()) // capacity)
    return max(volume, sum(c for s, c in counts.items() if 2 * s > capacity))


def placement(patterns: list[tuple[Counter, int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each size: first rank of each stretch, first container of it, items of this size per container."""
    rank: Counter = Counter()
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    container = 0
    for pattern, m in patterns:
        for s, c in pattern.items():
            out[s].append((rank[s], container, c))
            rank[s] += c * m
        container += m
    return {s: tuple(np.array(x, np.int64) for x in zip(*v)) for s, v in out.items()}


def pieces(sizes: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """key, piece_no, n_tokens: an item above the capacity as full pieces and a remainder, any other as itself."""
    n = F.coalesce(F.col(size), F.lit(0)).cast("bigint")
    last = F.greatest(F.ceil(n / capacity) - 1, F.lit(0)).cast("int")
    return sizes.select(key, n.alias("n"), F.explode(F.sequence(F.lit(0), last)).alias("piece_no")).select(
        key, "piece_no", F.least(F.col("n") - F.col("piece_no") * capacity, F.lit(capacity)).cast("int").alias("n_tokens")
    )


def containers(sizes: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """key, piece_no, n_tokens, container: every item's container, numbered from 0.

    Items of size 0 or null take no room: they go to container 0. Items of equal size and equal keys are told apart by
    rank. An empty table gives no rows; further columns are ignored.
    """
    items = cut_lineage(pieces(sizes, key, size, capacity).withColumn("bucket", F.pmod(F.xxhash64(F.col(key), F.col("piece_no")), F.lit(BUCKETS)).cast("int")))
    by = items.where("n_tokens > 0").groupBy("n_tokens", "bucket").agg(F.count(F.lit(1)).alias("n")).collect()  # at most capacity x BUCKETS numbers
    counts: Counter = Counter()
    offset: dict[int, np.ndarray] = {}
    for r in by:
        counts[r["n_tokens"]] += r["n"]
        offset.setdefault(r["n_tokens"], np.zeros(BUCKETS, np.int64))[r["bucket"]] = r["n"]
    offset = {s: np.concatenate([[0], np.cumsum(v)[:-1]]) for s, v in offset.items()}
    where = items.sparkSession.sparkContext.broadcast((placement(pack(counts, capacity)), offset))
    ranked = items.withColumn("rank", F.row_number().over(W.partitionBy("n_tokens", "bucket").orderBy(key, "piece_no")) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretches, offsets = where.value
        for b in batches:
            n, bucket, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n_tokens", "bucket", "rank"))
            out = np.zeros(len(n), np.int64)
            for s in np.unique(n):
                if s > 0:
                    at = np.flatnonzero(n == s)
                    r = rank[at] + offsets[int(s)][bucket[at]]
                    first, container, per = stretches[int(s)]
                    i = np.searchsorted(first, r, "right") - 1
                    out[at] = container[i] + (r - first[i]) // per[i]
            yield pa.RecordBatch.from_arrays([b.column(key), b.column("piece_no"), b.column("n_tokens"), pa.array(out)], names=[key, "piece_no", "n_tokens", "container"])

    kind = dict(sizes.dtypes)[key]
    return ranked.select(key, "piece_no", "n_tokens", "bucket", "rank").mapInArrow(run, f"`{key}` {kind}, piece_no INT, n_tokens INT, container BIGINT")


def fill_report(assigned: DataFrame, capacity: int) -> DataFrame:
    """containers, tokens, fill, fewest_possible: how well the containers are used."""
    used = assigned.where("n_tokens > 0").groupBy("container").agg(F.sum("n_tokens").alias("used"), F.count_if(F.col("n_tokens") * 2 > capacity).alias("big"))
    return used.agg(F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"), F.max("used").alias("fullest"), F.coalesce(F.sum("big"), F.lit(0)).alias("big")).select(
        "containers", "tokens", "fullest", F.try_divide(F.col("tokens"), F.col("containers") * capacity).alias("fill"), F.greatest(F.ceil(F.col("tokens") / capacity), F.col("big")).alias("fewest_possible")
    )
