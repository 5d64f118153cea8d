"""Streaming forms: appended lines, memo by first writer, counters that trigger, windowed counts with late data."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def drain(stream: DataFrame, out: str, state: str, how: str = "append") -> StreamingQuery:
    """Run a stream over what is there to its end, into Parquet."""
    q = stream.writeStream.format("parquet").outputMode(how).option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def first_writer(stream: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    """K7: the first row of each key within the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, at: str, *by: str, size: str = "1 hour", late: str = "1 day") -> DataFrame:
    """§2.11 addition: counts per tumbling window, late rows up to the watermark; `at` must be a TIMESTAMP."""
    return stream.withWatermark(at, late).groupBy(F.window(at, size), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def crossing_triggers(stream: DataFrame, group: str, every: int = 8) -> DataFrame:
    """A row (group, size) each time a group's running size passes a multiple of `every`; a batch that passes several triggers once."""

    def fold(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else 0
        size = before + sum(len(c) for c in chunks)
        state.update((size,))
        if size // every > before // every:
            yield pd.DataFrame({group: [key[0]], "size": [size]})

    kind = dict(stream.dtypes)[group]
    return stream.groupBy(group).applyInPandasWithState(fold, f"`{group}` {kind}, size BIGINT", "size BIGINT", "append", GroupStateTimeout.NoTimeout)


def bank_events(stream: DataFrame) -> DataFrame:
    """G1 as a stream: each operation's fate (chain, position, op, memory_id, version, reason), with the chain's bank as state.

    Operations of a micro-batch are folded in order of position; the batch form is `banks.fold_operations`."""
    from loomtrace.operators.banks import Bank

    def fold(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bank = Bank()
        for name, e in (json.loads(state.get[0]) if state.exists else {}).items():
            bank.put(name, **e)
        out = []
        for r in pd.concat(list(chunks)).sort_values("position", kind="stable").itertuples(index=False):
            name, reason = bank.apply(r)
            out.append((key[0], int(r.position), r.op, name, bank.entries[name]["version"] if name else None, reason))
        state.update((json.dumps(bank.entries),))
        yield pd.DataFrame(out, columns=["chain", "position", "op", "memory_id", "version", "reason"]).astype({"version": "Int64"})

    return stream.groupBy("chain").applyInPandasWithState(fold, "chain STRING, position BIGINT, op STRING, memory_id STRING, version BIGINT, reason STRING", "bank STRING", "append", GroupStateTimeout.NoTimeout)


def folder(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S4 as a stream: a growing folder of JSON lines."""
    return spark.readStream.schema(schema).json(path)
