"""Similarity joins against brute force, with hot terms in blocks."""

from __future__ import annotations

import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtrace.operators import retrieval, similarity


def runs_of(text, n=5):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, threshold=0.8):
    classes = {}
    for k, t in rows:
        if k is not None:
            classes.setdefault(t, []).append(k)
    sets = {min(ks): runs_of(t) for t, ks in classes.items()}
    near = {(a, b): len(x & y) / len(x | y) for a, x in sets.items() for b, y in sets.items() if a > b and x and y and len(x & y) / len(x | y) >= threshold}
    out = {}
    for t, ks in classes.items():
        c = min(ks)
        best = max(((round(o, 9), -b) for (a, b), o in near.items() if a == c), default=None)
        for k in ks:
            out[k] = (c, sum(c in p for p in near), None if best is None else -best[1])
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    base = [rng.choices(words, k=rng.randint(8, 60)) for _ in range(25)]
    rows = []
    for k in range(160):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 3, 12])):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((k * 3, " ".join(t)))
    rows += [(5000 + k, "the same notice of the harbour library stands on every page of ours " + f"w{k % 9} end") for k in range(40)]
    rows += [(1, None), (2, None), (4, ""), (7, " \n"), (8, "two words"), (10, "Two, words!"), (None, "x y z"), (11, "漢字 かな 漢字 仮名 文 字"), (13, "漢字 かな 漢字 仮名 文 字 ")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [2000, 7])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(similarity, "BLOCK", block)
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").withColumn("hs", F.lit("x"))
    got = {r["doc_id"]: (r["class_id"], r["links"], r["other"]) for r in similarity.near_duplicates(df, "doc_id", F.col("text")).collect()}
    want = brute(rows)
    assert got == want
    assert sum(v[1] > 0 for v in want.values()) >= 30
    assert similarity.near_duplicates(df.limit(0), "doc_id", F.col("text")).count() == 0


def test_nearest_keeps_ties_by_key():
    q, m = np.array([[1.0, 0.0]]), np.tile([[1.0, 0.0]], (40, 1))
    keys = np.arange(40)[::-1]
    got = retrieval.nearest(q, np.array([7]), m, keys, 5)
    assert got[1].tolist() == [0, 1, 2, 3, 4]
    assert len(retrieval.nearest(q, np.array([7]), np.zeros((3, 2)), np.arange(3), 5)[0]) == 0


def test_vector_search_in_blocks_equals_one(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(k, [float(x) for x in rng.normal(size=6)]) for k in range(120)] + [(500, None), (501, [0.0] * 6)]
    df = spark.createDataFrame(rows, "k BIGINT, v ARRAY<DOUBLE>")
    q = df.where("k % 5 = 0")
    whole = sorted(map(tuple, retrieval.vector_top_k(df, q, "k", "v", 4, 0.1).collect()))
    monkeypatch.setattr(retrieval, "VECTOR_BYTES", 8 * 6 * 7)
    monkeypatch.setattr(retrieval, "VECTOR_ROWS", 3)
    assert sorted(map(tuple, retrieval.vector_top_k(df, q, "k", "v", 4, 0.1).collect())) == whole and whole
    assert retrieval.vector_top_k(df, q.limit(0), "k", "v", 4, 0.1).count() == 0
    unit = {k: np.array(v) / np.linalg.norm(v) for k, v in rows if v and any(v)}
    for k in (0, 55):
        best = sorted((-round(float(unit[k] @ unit[o]), 9), o) for o in unit if o != k)[:4]
        assert [o for s, o in best if -s >= 0.1] == [r[1] for r in sorted((r for r in whole if r[0] == k), key=lambda r: (-r[2], r[1]))]


def test_bm25_with_terms_too_many_to_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"red ferry {'noon ' * (k % 4)} {k}") for k in range(60)] + [(99, None), (100, "")], "d BIGINT, t STRING")
    qs = spark.createDataFrame([(1, "ferry at noon"), (2, "red 7 noon noon"), (3, None)], "q INT, t STRING")
    words = F.split(F.coalesce("t", F.lit("")), r"\s+")
    run = lambda: {(r["q"], r["d"]): round(r["score"], 9) for r in retrieval.bm25_scores(qs, "q", words, docs, "d", words).collect()}
    whole = run()
    monkeypatch.setattr(retrieval, "BROADCAST_TERMS", 1)
    assert run() == whole and whole


def test_running_sums_over_partitions(spark):
    from loomtrace.operators.selection import positions, running

    rng = random.Random(5)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), k, rng.choice([0, 1, 2, None])) for k in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g STRING, k INT, v INT")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["k"]: r["s"] for r in running(df, "g", ["k"], F.col("v"), "s").collect()}
        pos = {r["k"]: r["pos"] for r in positions(df, ["k"]).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sums, want = {}, {}
    for g, k, v in sorted(rows, key=lambda r: r[1]):
        sums[g] = sums.get(g, 0) + (v or 0)
        want[k] = sums[g]
    assert got == want and pos == {k: k for k in range(3000)}
    assert running(df.limit(0), "g", ["k"], F.col("v"), "s").count() == 0


def test_two_ended_and_marginal_on_long_groups(spark):
    from loomtrace.operators import windows

    rng = random.Random(8)
    rows = [(g, k, rng.randint(1, 9), "n") for g in ("hot", "a", None) for k in range(400 if g == "hot" else 7)]
    df = spark.createDataFrame(rows, "g STRING, k INT, size INT, n STRING")
    kept = {(r["g"], r["k"]): r["kept"] for r in windows.two_ended(df, "g", "k", F.col("size"), 60).collect()}
    assert len(kept) == len(rows)
    for g in ("hot", "a", None):
        sizes = [s for h, _, s, _ in rows if h == g]
        head = tail = used = 0
        if sum(sizes) <= 60:
            head = len(sizes)
        else:
            while head + tail < len(sizes):
                last = tail <= head
                s = sizes[len(sizes) - 1 - tail if last else head]
                if used + s > 60:
                    break
                used, tail, head = used + s, tail + last, head + (not last)
        assert [kept[(g, k)] for k in range(len(sizes))] == [k < head or k >= len(sizes) - tail for k in range(len(sizes))]
    gain = {(r["g"], r["k"]): r["marginal"] for r in windows.marginal(df, "g", "k", "size", 2.0).collect()}
    assert all(gain[(g, k)] == s - (2.0 if k == 0 else dict(((h, j), z) for h, j, z, _ in rows)[(g, k - 1)]) for g, k, s, _ in rows)
    near = {(r["g"], r["k"]): r["recent"] for r in windows.recent(df.withColumn("k", F.col("k") + 900), "g", "k", F.col("k"), 20).collect()}
    assert all(near[(g, k + 900)] == [j + 900 for j in range(max(0, k - 20), k)] for g, k, _, _ in rows)


@pytest.mark.parametrize("threshold, limits", [(0.8, {"SKETCH_BYTES": 0}), (0.8, {"BROADCAST_KEYS": 0}), (0.5, {}), (0.3, {"WORDS": 50, "HELD": 20, "AT_ONCE": 30})])
def test_near_duplicates_by_every_way_equal_brute_force(spark, monkeypatch, threshold, limits):
    from loomtrace.operators import near

    for name, x in limits.items():
        monkeypatch.setattr(near, name, x)
    rows = corpus(11)
    got = {r["doc_id"]: (r["class_id"], r["links"], r["other"]) for r in similarity.near_duplicates(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"), "doc_id", F.col("text"), threshold).collect()}
    assert got == brute(rows, threshold)


@pytest.mark.parametrize("threshold", [0.8, 0.55, 0.3])
def test_similar_sets_share_a_signature_and_sketches_leave_room(threshold):
    from loomtrace.operators import near

    rng = np.random.default_rng(6)
    sets = []
    for k in range(300):
        base = rng.integers(0, 1 << 63, rng.choice([1, 2, 3, 7, 8, 15, 40, 130, 300]), dtype=np.uint64)
        sets += [base, *(np.unique(np.concatenate([base[: max(1, int(len(base) * rng.uniform(threshold, 1)))], rng.integers(0, 1 << 63, rng.integers(0, 3), dtype=np.uint64)])) for _ in range(2))]
    sizes, hashes = np.array([len(x) for x in sets]), np.concatenate(sets)
    row, missed, entry, s, count = near.signatures(sizes, hashes, threshold)
    order = np.lexsort((s, -count, entry))
    first = order[near._within(np.bincount(entry, minlength=len(row))) <= missed[entry]]
    held = [set() for _ in sets]
    for e, x in zip(entry[first], s[first]):
        held[row[e]].add(x)
    look = near.by_bits(np.arange(len(sets)), sizes, np.frombuffer(near.sketches(sizes, hashes), np.uint64))
    pairs = [(a, b) for k in range(0, len(sets), 3) for a, b in ((k, k + 1), (k, k + 2), (k + 1, k + 2))]
    alike = [(a, b) for a, b in pairs if len(x := np.intersect1d(sets[a], sets[b])) / (len(sets[a]) + len(sets[b]) - len(x)) >= threshold]
    assert len(alike) > 300 and all(held[a] & held[b] for a, b in alike)
    a, b = np.array(alike).T
    assert near._may(look, (a, sizes[a]), (b, sizes[b]), threshold).all()
    far = np.arange(0, len(sets) - 3, 3)
    big = far[(sizes[far] > 100) & (sizes[far + 3] > 100)]
    assert threshold < 0.8 or len(big) > 5 and not near._may(look, (big, sizes[big]), (big + 3, sizes[big + 3]), threshold).any()


def test_near_duplicates_keep_less_on_disk_than_the_texts_are(spark):
    from urllib.parse import urlparse

    from loomtrace.session import shared_dir

    rng = random.Random(9)
    told = [" ".join(f"w{rng.randrange(900)}" for _ in range(12)) for _ in range(300)]
    rows = [(k, " ".join(f"{rng.choice(told)} n{rng.randrange(10**6)}" for _ in range(12))) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    shared_dir(spark)
    top = Path(urlparse(spark.sparkContext.getCheckpointDir()).path)
    held = lambda: sum(p.stat().st_size for p in top.rglob("*") if p.is_file())
    before = held()
    assert similarity.near_duplicates(df, "doc_id", F.col("text")).count() == len(rows)
    assert held() - before < sum(len(t) for _, t in rows)
