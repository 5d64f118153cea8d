"""Memory banks: the superseding log with its as-of view, and the in-place versioned table as an ordered fold."""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.operators.selection import ranked, running


def active_entries(bank: DataFrame) -> DataFrame:
    """S3: active entries with content; a missing status counts as active."""
    return bank.where("coalesce(status, 'active') = 'active' AND coalesce(content, '') <> ''")


def superseded(log: DataFrame, key: str, supersedes: str, position: str) -> DataFrame:
    """Adds `superseded_by` and `superseded_at`: the first later entry that names a row. One join on the named key; no fold."""
    later = log.where(F.col(supersedes).isNotNull()).groupBy(F.col(supersedes).alias(key)).agg(F.min_by(key, position).alias("superseded_by"), F.min(position).alias("superseded_at"))
    return log.join(later, key, "left")


def as_of(log: DataFrame, key: str, supersedes: str, position: str, at: Column) -> DataFrame:
    """The bank as a reader at a position sees it: entries before it that weren't superseded before it."""
    return superseded(log, key, supersedes, position).where((F.col(position) < at) & (F.col("superseded_at").isNull() | (F.col("superseded_at") >= at)))


def targets_as_of(readers: DataFrame, log: DataFrame, key: str, supersedes: str, position: str) -> DataFrame:
    """Adds `visible`: whether each reader's `target` is in the bank as of the reader's own position `at`, by the
    interval (position, superseded_at) of the target. One join on the target's key; null and unknown targets aren't visible."""
    spans = superseded(log, key, supersedes, position).select(F.col(key).alias("target"), F.col(position).alias("from_"), F.col("superseded_at").alias("to_"))
    seen = (F.col("from_") < F.col("at")) & (F.col("to_").isNull() | (F.col("to_") >= F.col("at")))
    return readers.join(spans, "target", "left").withColumn("visible", F.coalesce(seen, F.lit(False))).drop("from_", "to_")


VERSIONED = "chain STRING, id STRING, content STRING, scope STRING, status STRING, version INT, evidence ARRAY<STRING>, n_history INT"


class Bank:
    """The bank of one chain while its operations come in: entries by id, and how many hold each content."""

    def __init__(self) -> None:
        self.entries: dict[str, dict] = {}
        self.contents: Counter[str] = Counter()
        self.number = 0

    def put(self, key: str, content: str, scope: str, version: int, evidence: list[str], n_history: int) -> None:
        if key in self.entries:
            self.contents[self.entries[key]["content"].casefold()] -= 1
        elif m := re.fullmatch(r"mem_(\d+)", key):
            self.number = max(self.number, int(m.group(1)))
        self.contents[content.casefold()] += 1
        self.entries[key] = {"content": content, "scope": scope, "version": version, "evidence": evidence, "n_history": n_history}

    def apply(self, r) -> tuple[str | None, str | None]:
        """Takes an operation in; (the entry's id, None), or (None, why it is turned down)."""
        evidence = [] if r.evidence is None else list(r.evidence)
        reason = self.reject(r, evidence)
        if reason:
            return None, reason
        proof = [f"{r.task}:{e}" for e in evidence]
        if r.op == "add":
            key = f"mem_{self.number + 1:06d}"
            self.put(key, r.content or "", r.scope or "", 1, proof, 0)
            return key, None
        e = self.entries[r.target]
        kept = list(dict.fromkeys(e["evidence"] + proof)) if r.op == "refine" else proof
        self.put(r.target, r.content or "", r.scope or "", e["version"] + 1, kept, e["n_history"] + 1)
        return r.target, None

    def reject(self, r, evidence: list) -> str | None:
        """The last of the reasons that hold, as later ones overrule earlier ones."""
        reason = None if evidence else "missing_evidence_steps"
        if r.op == "add":
            return "duplicate_active_memory" if self.contents[(r.content or "").casefold()] > 0 else reason
        if r.op not in ("refine", "replace"):
            return "unknown_operation"
        target = self.entries.get(r.target)
        if target is None:
            return "unknown_or_inactive_target"
        return "no_change" if target["content"] == (r.content or "") and target["scope"] == (r.scope or "") else reason

    def rows(self, chain: str) -> pd.DataFrame:
        return pd.DataFrame(
            [(chain, k, e["content"], e["scope"], "active", e["version"], e["evidence"], e["n_history"]) for k, e in self.entries.items()],
            columns=["chain", "id", "content", "scope", "status", "version", "evidence", "n_history"],
        )


def in_order(df: DataFrame) -> DataFrame:
    """Rows of a chain together and in order, for a fold that sees a chain's rows one after the other."""
    return df.repartition("chain").sortWithinPartitions("chain", *(c for c in ("turn", "position") if c in df.columns))


def fold_operations(ops: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """The bank that a chain of add, refine and replace operations leaves, folded in order within each chain, from
    the bank that an earlier batch of operations left, if there is one.

    ops: chain, position, op, target, content, scope, task, evidence ARRAY<INT>; initial: as this function returns it.
    Rejected are operations without evidence, duplicates of an active content (by case folding), unknown targets and changes
    of nothing. Chains fold in parallel; operations stream by in Arrow batches, sorted, and only the current bank is held."""
    none = F.lit(None)
    rows = ops.select("chain", F.lit(1).alias("turn"), "position", "op", "target", "content", "scope", "task", F.col("evidence").cast("array<string>").alias("evidence"), none.cast("int").alias("version"), none.cast("int").alias("n_history"))
    if initial is not None:
        # what is there comes before all operations
        rows = rows.unionByName(initial.select("chain", F.lit(0).alias("turn"), none.cast(dict(ops.dtypes)["position"]).alias("position"), F.lit("have").alias("op"), F.col("id").alias("target"), "content", "scope", none.cast("string").alias("task"), "evidence", "version", "n_history"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain, bank = None, Bank()
        for batch in batches:
            for r in batch.itertuples(index=False):
                if r.chain != chain:
                    if bank.entries:
                        yield bank.rows(chain)
                    chain, bank = r.chain, Bank()
                if r.op == "have":
                    bank.put(r.target, r.content, r.scope, int(r.version), list(r.evidence), int(r.n_history))
                else:
                    bank.apply(r)
        if bank.entries:
            yield bank.rows(chain)

    return in_order(rows).mapInPandas(run, VERSIONED)


def capacity(n_tasks: Column, fraction: float, hard: Column) -> Column:
    """How many slots a chain has: a share of its tasks, rounded up, one at least; no bound where the budget isn't hard."""
    return F.when(hard, F.greatest(F.lit(1), F.ceil(n_tasks * fraction).cast("int")))


def within_budget(df: DataFrame, chain: str, position: str, writes: Column, slots: Column) -> DataFrame:
    """Adds `slot` (how many writes a chain has made up to here) and `allowed`: writes beyond the chain's slots are turned down."""
    slotted = running(df, chain, [position], writes.cast("int"), "slot")
    return slotted.withColumn("allowed", ~writes | slots.isNull() | (F.col("slot") <= slots))


def repaired_ids(df: DataFrame, key: str, order: str) -> DataFrame:
    """Ids made unique: the n-th row of an id gets the suffix _n."""
    r = ranked(df, key, [order], "i_", "n_")
    return r.withColumn(key, F.when(F.col("i_") == 1, F.col(key)).otherwise(F.concat_ws("_", key, F.col("i_")))).drop("i_", "n_")


class Postings:
    """Which entries of a bank hold a word, for the overlaps of a draft with all entries at once.

    A word of few entries has the list of them, a word of an eighth of all or more a row with a byte for each. What is a
    row is settled anew whenever the room for entries doubles, so rows take no more than lists would."""

    def __init__(self, room: int = 256) -> None:
        self.lists: dict[str, list] = {}
        self.rows: dict[str, np.ndarray] = {}
        self.sizes = np.zeros(room, np.int64)
        self.n = 0

    def shared(self, words: frozenset[str]) -> np.ndarray:
        """How many of the words each entry holds."""
        lists = [x[0][: x[1]] for w in words if (x := self.lists.get(w))]
        out = np.bincount(np.concatenate(lists, dtype=np.int64), minlength=self.n) if lists else np.zeros(self.n, np.int64)
        rows = [x for w in words if (x := self.rows.get(w)) is not None]
        for k in range(0, len(rows), 255):  # as many as a byte can count
            few = np.zeros(self.n, np.uint8)
            for x in rows[k : k + 255]:
                few += x[: self.n]
            out += few
        return out

    def change(self, i: int, old: frozenset[str], new: frozenset[str]) -> None:
        """Entry i, which may be the next one, had the old words and has the new ones."""
        if i == self.n:
            if i == len(self.sizes):
                self.grow()
            self.n += 1
        self.sizes[i] = len(new)
        for w in old - new:
            if w in self.rows:
                self.rows[w][i] = 0
            else:
                at = self.lists[w]
                at[1] -= 1
                at[0][np.flatnonzero(at[0][: at[1] + 1] == i)[0]] = at[0][at[1]]
                if not at[1]:
                    del self.lists[w]
        for w in new - old:
            if w in self.rows:
                self.rows[w][i] = 1
            elif (at := self.lists.get(w)) is None:
                self.lists[w] = [np.full(2, i, np.int32), 1]
            else:
                if at[1] == len(at[0]):
                    at[0] = np.concatenate([at[0], np.zeros_like(at[0])])
                at[0][at[1]] = i
                at[1] += 1

    def grow(self) -> None:
        n, room = self.n, 2 * self.n
        self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        rows = {}
        for w, x in self.rows.items():
            if 8 * (k := int(np.count_nonzero(x))) >= n:
                rows[w] = np.concatenate([x, np.zeros(room - n, np.uint8)])
            elif k:
                self.lists[w] = [np.flatnonzero(x).astype(np.int32), k]
        for w in [w for w, x in self.lists.items() if 8 * x[1] >= n]:
            ids, k = self.lists.pop(w)
            rows[w] = np.zeros(room, np.uint8)
            rows[w][ids[:k]] = 1
        self.rows = rows


def fold_merging(entries: DataFrame, threshold: float = 0.25, keep: float = 0.9) -> DataFrame:
    """A chain of drafts folded into a bank that merges: a draft whose words overlap an entry's by the threshold refines
    the best one (the earliest on ties); where it would lose more than a tenth of the entry's words, the texts are joined.

    entries: chain, position, content. Gives chain, id, content, version. Chains fold in parallel, drafts stream by sorted;
    the current bank is held with an index from words to its entries, which counts a draft's overlaps with all of them at once."""
    from loomtrace.functions.text import RANKING_STOPWORDS

    stop = frozenset(RANKING_STOPWORDS)

    def words(t: str) -> frozenset[str]:
        return frozenset(sys.intern(w) for w in re.findall("[a-z0-9]+", t.lower()) if w not in stop)

    def done(chain: str, bank: list[list]) -> Iterator[pd.DataFrame]:
        for k in range(0, len(bank), 1000):
            yield pd.DataFrame([(chain, f"mem_{i + 1:06d}", e[0], e[1]) for i, e in enumerate(bank[k : k + 1000], k)], columns=["chain", "id", "content", "version"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain, bank, index = None, [], Postings()
        for batch in batches:
            for r in batch.itertuples(index=False):
                if r.chain != chain:
                    yield from done(chain, bank)
                    chain, bank, index = r.chain, [], Postings()
                text = r.content or ""
                new, old, best = words(text), frozenset(), len(bank)
                if new and bank:
                    shared = index.shared(new)
                    scores = shared / (len(new) + index.sizes[: len(bank)] - shared)
                    first = int(scores.argmax())  # the earliest of the best
                    if shared[first] and scores[first] >= threshold:
                        best = first
                if best == len(bank):
                    bank.append([text, 1, new])
                else:
                    e = bank[best]
                    old = e[2]
                    joined = shared[best] / len(old) < keep and text not in e[0]
                    # no word goes over the blank between joined texts
                    e[:] = [f"{e[0]} {text}", e[1] + 1, old | new] if joined else [text, e[1] + 1, new]
                index.change(best, old, bank[best][2])
        yield from done(chain, bank)

    rows = entries.select("chain", "position", "content").where("chain IS NOT NULL")
    return in_order(rows).mapInPandas(run, "chain STRING, id STRING, content STRING, version INT")
