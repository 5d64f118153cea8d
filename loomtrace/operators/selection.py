"""Selection, sampling and splits. Seeded shuffles become orders by hash, so any engine picks the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType


def hash_order(*parts: Column) -> Column:
    """A fixed pseudo-random order: the MD5 of the parts."""
    return F.md5(F.concat_ws("|", *parts))


def exact_unique(df: DataFrame, key: list[str], order: list[str], n: int, must: bool = False) -> DataFrame:
    """L1: the first n rows of distinct keys, the first of each key by order; with `must`, an error when there are fewer."""
    once = df.withColumn("rn", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("rn = 1").drop("rn")
    out = once.orderBy(*order).limit(n)
    if must and out.count() < n:
        raise ValueError(f"fewer than {n} accepted rows")
    return out


#: monotonically_increasing_id keeps the number of a row in its partition in so many bits.
_ROW_BITS = 33


def _in_order(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows in one order over range partitions, kept, with `part_` and `row_`, the place within it, told where the rows lie."""
    from loomtrace.session import cut_lineage

    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    return cut_lineage(sorted_.withColumn("at_", at).withColumn("part_", F.shiftright("at_", _ROW_BITS)).withColumn("row_", F.col("at_").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))).drop("at_"))


def positions(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds `pos`, the position from 0 in one order of all rows, without sorting them in one task: a range partitioning,
    the partitions' counts (one number each), and the places within, numbered where the rows lie."""
    kept = _in_order(df, order)
    counts = {r["part_"]: r["n"] for r in kept.groupBy("part_").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, start = 0, {}
    for p in sorted(counts):
        start[p] = before
        before += counts[p]
    if not start:
        return df.withColumn("pos", F.lit(0).cast("bigint"))
    offset = F.element_at(F.create_map(*[F.lit(x) for p, s in start.items() for x in (p, s)]), F.col("part_")).cast("bigint")
    return kept.withColumn("pos", offset + F.col("row_")).drop("part_", "row_")


def running(df: DataFrame, group: str, order: list[str], value: Column, name: str) -> DataFrame:
    """Adds `name`, the sum of a whole-numbered value over the rows of the group up to this one, for groups of any size.

    Rows are summed up where they lie in a range partitioning by group and order; only a group that goes on in the next
    partition needs what came before, at most one number for each partition. Null values count as 0."""
    kept = _in_order(df.withColumn("value_", F.coalesce(value.cast("bigint"), F.lit(0).cast("bigint"))), [group, *order])
    # of each partition the first and the last group, and what they add: all a later one can need
    edges = kept.groupBy("part_").agg(F.min("row_").alias("lo_"), F.max("row_").alias("hi_"))
    ends = kept.join(F.broadcast(edges), "part_").where((F.col("row_") == F.col("lo_")) | (F.col("row_") == F.col("hi_"))).select("part_", group).distinct()
    sums = kept.join(F.broadcast(ends.withColumnRenamed(group, "group_")), ["part_"]).where(F.col(group).eqNullSafe(F.col("group_"))).groupBy("part_", group).agg(F.sum("value_").alias("sum_")).collect()
    before: dict = {}
    carried = []
    for r in sorted(sums, key=lambda r: r["part_"]):
        if before.get(r[group]):
            carried.append((r["part_"], r[group], before[r[group]]))
        before[r[group]] = before.get(r[group], 0) + r["sum_"]
    schema = StructType([*kept.drop("value_").schema.fields, StructField(name, LongType())])
    arrow = to_arrow_schema(schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carry = None, 0
        for b in batches:
            g, v = b.column(group), b.column("value_").to_numpy(zero_copy_only=False)
            keys = g.dictionary_encode()
            ids = pa.compute.fill_null(keys.indices, -1).to_numpy(zero_copy_only=False)
            sums = np.cumsum(v)
            new = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.empty(0, int)
            base = np.repeat(np.concatenate([[0], sums[new[1:] - 1]]) if len(new) else np.empty(0, int), np.diff(np.append(new, len(ids))))
            out = sums - base
            if len(out) and last is not None and last[0] == g[0].as_py():
                out[: new[1] if len(new) > 1 else len(out)] += carry
            if len(out):
                last, carry = (g[len(g) - 1].as_py(),), int(out[-1])
            cols = [b.column(f.name) for f in schema.fields[:-1]] + [pa.array(out, pa.int64())]
            yield pa.RecordBatch.from_arrays([c.cast(t.type) for c, t in zip(cols, arrow)], schema=arrow)

    out = kept.select(*kept.drop("value_").columns, "value_").mapInArrow(add, schema)
    if carried:
        kind = StructType([StructField("part_", LongType()), StructField("group_", df.schema[group].dataType), StructField("carried_", LongType())])
        more = F.broadcast(df.sparkSession.createDataFrame(carried, kind).withColumnRenamed("part_", "p_"))
        out = out.join(more, (F.col("part_") == F.col("p_")) & F.col(group).eqNullSafe(F.col("group_")), "left").withColumn(name, F.col(name) + F.coalesce("carried_", F.lit(0))).drop("p_", "group_", "carried_")
    return out.drop("part_", "row_")


def ranked(df: DataFrame, group: str, order: list[str], turn: str = "turn", n: str = "n") -> DataFrame:
    """Adds `turn` (rank from 1 within the group) and `n` (the group's rows): row_number for groups of any size. Positions
    come from a range partitioning by group and order, so a group with a third of all rows spreads over many tasks."""
    p = positions(df, [group, *order]).withColumnRenamed("pos", "pos_")
    ends = p.groupBy(F.col(group).alias("group_")).agg(F.min("pos_").alias("first_"), F.count(F.lit(1)).alias(n))
    return p.join(ends, F.col(group).eqNullSafe(F.col("group_"))).withColumn(turn, F.col("pos_") - F.col("first_") + 1).drop("pos_", "first_", "group_")


def batches(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """L2: adds `batch`, fixed-size slices of the order."""
    return positions(df, order).withColumn("batch", F.floor(F.col("pos") / size))


def chunks(df: DataFrame, order: list[str], n: int, total: int) -> DataFrame:
    """L3: adds `chunk` from 0: n near-equal slices, the larger first."""
    q, r = divmod(total, n)
    pos = F.col("pos")
    edge = r * (q + 1)
    late = F.lit(n - 1) if q == 0 else r + F.floor((pos - edge) / max(q, 1))
    return positions(df, order).withColumn("chunk", F.when(pos < edge, F.floor(pos / (q + 1))).otherwise(late).cast("int"))


def round_robin(df: DataFrame, stratum: str, order: Column, n: int) -> DataFrame:
    """L4: one row of each stratum in turn, strata in order, n in all."""
    r = df.withColumn("turn", F.row_number().over(W.partitionBy(stratum).orderBy(order)))
    return r.where(F.col("turn") <= n).orderBy("turn", stratum).limit(n)


def proportional(df: DataFrame, stratum: str, order: Column, n: int) -> DataFrame:
    """From each stratum round(n * share) rows, halves to even; sums may miss n by the rounding."""
    counts = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("size"))
    total = counts.agg(F.sum("size").alias("s")).first()["s"] or 1
    quota = counts.withColumn("quota", F.bround(F.lit(n) * F.col("size") / F.lit(total)).cast("int")).drop("size")
    few = df.withColumn("turn", F.row_number().over(W.partitionBy(stratum).orderBy(order))).where(F.col("turn") <= n).drop("turn")  # a limit per group that is applied before the shuffle
    return few.join(quota, stratum).withColumn("turn", F.row_number().over(W.partitionBy(stratum).orderBy(order))).where((F.col("turn") <= n) & (F.col("turn") <= F.col("quota")))


def one_of(df: DataFrame, group: str, order: Column) -> DataFrame:
    """One row of each group by hash order, not the best."""
    return df.withColumn("turn", F.row_number().over(W.partitionBy(group).orderBy(order))).where("turn = 1").drop("turn")


def cyclic(df: DataFrame, order: list[str], least: int) -> DataFrame:
    """Rows repeated in turn until there are at least `least`; adds `copy`. The result has whole rounds cut at `least`."""
    n = df.count()
    if not n:
        return df.withColumn("copy", F.lit(0))
    rounds = -(-least // n)
    out = positions(df, order).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(max(rounds, 1) - 1))))
    return out.where(F.col("copy") * n + F.col("pos") < max(least, n)).drop("pos")
