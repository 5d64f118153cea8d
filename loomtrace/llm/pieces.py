"""Problem 1: oversized observations cut into overlapping pieces at natural boundaries, by content-defined chunking.

A rolling hash over the content sets landmarks; each landmark snaps to the nearest natural boundary; a piece ends at
the best landmark between the minimum and the maximum size, failing one at the best boundary, failing that (no white
space, no sentence ends) at the unit with the least rolling hash between the two. The next piece begins at the last boundary at least `overlap` before that cut. Since a landmark depends on
the few units around it only, an edit moves the cuts near it and leaves the others.

Units are code points of a text, or elements of a list. Lists are cut by the hashes of their elements; Python sees
hashes, never the elements, and the JVM slices the lists.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Units that the rolling hash looks back over, and how many units lie between landmarks on average.
WINDOW, EVERY = 16, 64
#: A piece is at least this share of the limit, unless it is the last one.
MINIMUM = 0.5
#: How far a piece may begin before cut - overlap to reach a boundary, as a share of the overlap.
REACH_BACK = 1.0

_PARAGRAPH = re.compile(r"\n[ \t\r]*\n\s*")
_LINE = re.compile(r"\n\s*")
_SENTENCE = re.compile(r"(?<=[.!?…。！？])[\"”’)\]]*\s+|(?<=[。！？])(?=\S)")
_SPACE = re.compile(r"\s+")


def rolling(units: np.ndarray) -> np.ndarray:
    """A hash of the last WINDOW units at each position."""
    u = units.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    u ^= u >> np.uint64(29)
    h = np.zeros(len(u), np.uint64)
    weight = np.uint64(1)
    for k in range(min(WINDOW, len(u))):
        h[k:] += u[: len(u) - k] * weight
        weight = np.uint64((int(weight) * 0xBF58476D1CE4E5B9) % (1 << 64))
    h ^= h >> np.uint64(31)
    return h * np.uint64(0x94D049BB133111EB)


def text_boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a piece may begin or end, ascending, and their strength: 4 paragraph, 3 line, 2 sentence, 1 word."""
    at: dict[int, int] = {}
    for strength, rx in ((1, _SPACE), (2, _SENTENCE), (3, _LINE), (4, _PARAGRAPH)):
        for m in rx.finditer(text):
            at[m.end()] = strength
    if not at:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    pos = np.array(sorted(at), np.int64)
    return pos, np.array([at[p] for p in pos.tolist()], np.int64)


def group_boundaries(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every position in a list is a boundary; one where the kind of element changes is a strong one."""
    pos = np.arange(1, len(marks), dtype=np.int64)
    return pos, np.where(marks[1:] != marks[:-1], 3, 1).astype(np.int64)


def cuts(units: np.ndarray, pos: np.ndarray, strength: np.ndarray, size: int, overlap: int) -> list[tuple[int, int]]:
    """(begin, end) of the pieces of a sequence longer than `size`; each at most `size` long, each but the first beginning before the last one's end."""
    n = len(units)
    overlap = max(0, min(overlap, (size - 1) // 3))
    smallest = max(overlap * 2 + 1, int(size * MINIMUM))
    hashes = rolling(units)
    landmarks = np.flatnonzero(hashes % np.uint64(EVERY) == 0) + 1
    snapped = np.empty(0, np.int64)
    if len(pos) and len(landmarks):
        i = np.clip(np.searchsorted(pos, landmarks), 1, len(pos) - 1) if len(pos) > 1 else np.zeros(len(landmarks), np.int64)
        near = np.where(np.abs(pos[i] - landmarks) < np.abs(pos[i - 1] - landmarks), i, i - 1) if len(pos) > 1 else i
        snapped = np.unique(near)
    out, begin = [], 0
    while n - begin > size:
        lo, hi = begin + smallest, begin + size
        end = None
        for among in (snapped, np.arange(len(pos))):
            p = pos[among] if len(among) else pos[:0]
            a, b = np.searchsorted(p, lo), np.searchsorted(p, hi, "right")
            if b > a:
                s = strength[among[a:b]]
                end = int(p[a + np.flatnonzero(s == s.max())[0]])
                break
        end = end or lo + int(hashes[lo - 1 : hi].argmin())
        out.append((begin, end))
        target = end - overlap
        a, b = np.searchsorted(pos, target - int(overlap * REACH_BACK)), np.searchsorted(pos, target, "right")
        s = strength[a:b]
        start = int(pos[a + np.flatnonzero(s == s.max())[-1]]) if b > a else target
        begin = start if start > begin else target
    out.append((begin, n))
    return out


def text_pieces(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    if len(text) <= size:
        return [(0, len(text))]
    return cuts(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), *text_boundaries(text), size, overlap)


PARTS = "ARRAY<STRUCT<begin: INT, end: INT>>"


def _as_lists(parts: list[list[tuple[int, int]]]) -> pd.Series:
    return pd.Series([[{"begin": b, "end": e} for b, e in p] for p in parts])


def text_parts(size: int, overlap: int):
    """A UDF (text) -> the pieces' places; only the text leaves the JVM, and only the places come back."""

    @F.pandas_udf(PARTS)
    def places(text: pd.Series) -> pd.Series:
        return _as_lists([text_pieces(t, size, overlap) for t in text])

    return places.asNondeterministic()  # else the optimizer evaluates it twice, once to see that the list is not empty


def list_parts(size: int, overlap: int):
    """The same for lists, from the hashes of their elements and of what groups them."""

    @F.pandas_udf(PARTS)
    def places(hashes: pd.Series, marks: pd.Series) -> pd.Series:
        return _as_lists([cuts(np.asarray(h, np.int64).view(np.uint64), *group_boundaries(np.asarray(m, np.int64)), size, overlap) for h, m in zip(hashes, marks)])

    return places.asNondeterministic()  # else the optimizer evaluates it twice, once to see that the list is not empty


def split_texts(df: DataFrame, key: str, text: Column, size: int, overlap: int) -> DataFrame:
    """key, piece_no, begin, end, piece for the texts longer than `size` code points, per row; the JVM slices the texts, and a
    caller that needs no text shuffles none."""
    long = df.select(key, text.alias("text")).where(F.length("text") > size).withColumn("parts", text_parts(size, overlap)("text"))
    return long.select(key, "text", F.posexplode("parts").alias("piece_no", "part")).select(
        key, "piece_no", F.col("part.begin").alias("begin"), F.col("part.end").alias("end"), F.substring("text", F.col("part.begin") + 1, F.col("part.end") - F.col("part.begin")).alias("piece")
    )


def split_lists(df: DataFrame, key: str, items: Column, group: str | None, size: int, overlap: int) -> DataFrame:
    """key, piece_no, begin, end, items for the lists longer than `size`. `group` names the field of an element whose change is a natural boundary."""
    long = df.select(key, items.alias("items")).where(F.size("items") > size)
    hashes = F.transform("items", lambda e: F.xxhash64(e))
    marks = F.transform("items", lambda e: F.xxhash64(e[group]) if group else F.lit(0).cast("bigint"))
    return long.withColumn("parts", list_parts(size, overlap)(hashes, marks)).select(key, "items", F.posexplode("parts").alias("piece_no", "part")).select(
        key, "piece_no", F.col("part.begin").alias("begin"), F.col("part.end").alias("end"), F.slice("items", F.col("part.begin") + 1, F.col("part.end") - F.col("part.begin")).alias("items")
    )


def limits(size_limits: DataFrame) -> dict[str, tuple[int, int]]:
    """field: (max_size, overlap). The table has a fixed handful of rows."""
    return {r["field"]: (int(r["max_size"]), int(r["overlap"])) for r in size_limits.collect() if r["field"] and r["max_size"]}


def _all_pieces(steps: DataFrame, size_limits: DataFrame) -> DataFrame:
    """The pieces of every delivered row."""
    by = limits(size_limits)
    known = steps.where("step_id IS NOT NULL")
    text = split_texts(known, "step_id", F.col("observation.text"), *by["observation.text"])
    items = split_lists(known, "step_id", F.col("observation.elements"), "tag", *by["observation.elements"])
    kind = dict(items.dtypes)["items"]
    return text.select("step_id", F.lit("text").alias("field"), "piece_no", "begin", "end", "piece", F.lit(None).cast(kind).alias("items")).unionByName(
        items.select("step_id", F.lit("elements").alias("field"), "piece_no", "begin", "end", F.lit(None).cast("string").alias("piece"), "items")
    )


def observation_pieces(steps: DataFrame, size_limits: DataFrame) -> DataFrame:
    """step_id, field, piece_no, begin, end, piece, items: the ordered pieces of each oversized field of a step, once per step.

    Null, empty and fitting fields have no pieces; a text without any boundary is cut at its rolling hash's least values; null elements
    count as elements; further columns are ignored.
    """
    return _all_pieces(steps, size_limits).dropDuplicates(["step_id", "field", "piece_no"])


def oversized(steps: DataFrame, size_limits: DataFrame) -> DataFrame:
    """step_id, field of what had to be cut: the fields with a second piece. Only these two columns are shuffled."""
    return _all_pieces(steps, size_limits).where("piece_no = 1").select("step_id", "field").distinct()
