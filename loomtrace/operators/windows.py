"""Ordered operators: budgets, advantages, runs of events. All windows are partitioned by a run, task or group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtrace.operators.selection import ranked, running

#: Positions of a group that are looked over together.
BLOCK = 1000


def newest_first(df: DataFrame, group: str, order: str, size: Column, most: int) -> DataFrame:
    """The newest rows of each group whose sizes (at least 1) fit the budget, at least one row, up to the first that doesn't.

    No more than `most` rows can fit, so a limit per group comes before the shuffle and bounds what a task sorts."""
    w = W.partitionBy(group).orderBy(F.desc(order))
    few = df.withColumn("back", F.row_number().over(w)).where(F.col("back") <= most + 1)
    used = few.withColumn("used", F.sum(size).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return used.where((F.col("used") <= most) | (F.col("back") == 1)).drop("back")


def two_ended(df: DataFrame, group: str, order: str, size: Column, most: int) -> DataFrame:
    """Whole rows from both ends of a group within the budget, the tail first and in turns, up to the first overflow.

    Adds `kept`; a group that fits is kept whole. The row that doesn't fit ends the taking, as do all after it."""
    r = ranked(df.withColumn("size_", size.cast("bigint")), group, [order], "i_", "n_")
    tail = F.col("n_") - F.col("i_")  # 0 for the last
    head = F.col("i_") - 1
    # takes go tail0, head0, tail1, head1, ...: a row is reached from the nearer end
    used = running(r.withColumn("turn_", F.least(2 * tail, 2 * head + 1)), group, ["turn_"], F.col("size_"), "used_")
    total = df.groupBy(F.col(group).alias("group_")).agg(F.sum(size.cast("bigint")).alias("total_"))
    return used.join(total, F.col(group).eqNullSafe(F.col("group_"))).withColumn("kept", (F.col("total_") <= most) | (F.col("used_") <= most)).drop("turn_", "size_", "i_", "n_", "used_", "total_", "group_")


def round_robin_budget(df: DataFrame, group: str, verb: Column, order: str, size: Column, most: int) -> DataFrame:
    """One row of each verb in turn, verbs in order, up to the first that overflows the budget."""
    r = df.withColumn("verb", verb)
    r = r.withColumn("turn", F.row_number().over(W.partitionBy(group, "verb").orderBy(order)))
    used = F.sum(size).over(W.partitionBy(group).orderBy("turn", "verb").rowsBetween(W.unboundedPreceding, 0))
    return r.withColumn("used", used).where(F.col("used") <= most)


def second_pool(first: DataFrame, second: DataFrame, group: str, order: str, size: Column, most: int) -> DataFrame:
    """Rows of a second pool, in order, in what the first one has left of the budget, up to the first that overflows it.
    first: as round_robin_budget returns it; a group without rows there has the whole budget."""
    left = first.groupBy(group).agg(F.max("used").alias("taken_"))
    run = F.sum(size).over(W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    r = second.join(left, group, "left").withColumn("used", run + F.coalesce("taken_", F.lit(0)))
    return r.where(F.col("used") <= most).drop("taken_")


def group_advantage(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """A value less the mean of its group; sums to zero in each. The mean is aggregated and joined, so that a
    group with a third of all rows is neither sorted nor held by one task."""
    means = df.groupBy(*by).agg(F.avg(value).alias("mean_"))
    return df.join(means, by).withColumn("advantage", F.col(value) - F.col("mean_")).drop("mean_")


def marginal(df: DataFrame, group: str, order: str, value: str, baseline: float) -> DataFrame:
    """A value less the one before it in its group, the first less the baseline."""
    r = ranked(df, group, [order], "i_", "n_").drop("n_")
    before = r.select(F.col(group).alias("group_"), (F.col("i_") + 1).alias("turn_"), F.col(value).alias("before_"))
    j = r.join(before, F.col(group).eqNullSafe(F.col("group_")) & (F.col("i_") == F.col("turn_")), "left")
    return j.withColumn("marginal", F.col(value) - F.coalesce("before_", F.lit(baseline))).drop("i_", "group_", "turn_", "before_")


def repeats(df: DataFrame, group: str, order: str, key: Column) -> DataFrame:
    """Adds `nth`, how often a row's key has come up in its group so far."""
    return df.withColumn("key", key).withColumn("nth", F.row_number().over(W.partitionBy(group, "key").orderBy(order)))


def strikes(df: DataFrame, group: str, order: str, bad: Column, most: int = 3) -> DataFrame:
    """Adds `streak` (bad rows in a row up to here, reset by a good one) and `out` (the streak has reached `most`)."""
    islands = running(df.withColumn("bad", bad), group, [order], F.when(~F.col("bad"), 1).otherwise(0), "island")
    r = running(islands, group, [order], F.col("bad").cast("int"), "bads_")
    # bad rows up to an island's first row are those of the islands before it
    start = r.groupBy(group, "island").agg(F.min(F.col("bads_") - F.col("bad").cast("int")).alias("start_"))
    r = r.join(start, [group, "island"])
    return r.withColumn("streak", F.when(F.col("bad"), F.col("bads_") - F.col("start_")).otherwise(0)).withColumn("out", F.col("streak") >= most).drop("island", "bads_", "start_")


def crossings(df: DataFrame, group: str, place: str, size: str, every: int = 8) -> DataFrame:
    """The rows at which a growing size passes a multiple of `every`, once per crossing. `place` counts the rows of a
    group from 1; the row before comes by a join on (group, place)."""
    before = df.select(group, (F.col(place) + 1).alias(place), F.col(size).alias("before"))
    j = df.join(before, [group, place], "left").withColumn("before", F.coalesce("before", F.lit(0)))
    return j.where(F.floor(F.col(size) / every) > F.floor(F.col("before") / every))


def recent(df: DataFrame, group: str, position: str, item: Column, window: int = 20) -> DataFrame:
    """Adds `recent`: the items at the `window` positions before a row's, in order."""
    # a group is cut into blocks of positions, each with the `window` positions before it, so that a long one spreads
    block = F.floor(F.col(position) / BLOCK)
    late = F.pmod(F.col(position), F.lit(BLOCK)) >= BLOCK - window
    r = df.withColumn("own_", block).withColumn("block_", F.explode(F.when(late, F.array(block, block + 1)).otherwise(F.array(block))))
    w = W.partitionBy(group, "block_").orderBy(position).rangeBetween(-window, -1)
    return r.withColumn("recent", F.array_sort(F.collect_list(item).over(w))).where("own_ = block_").drop("own_", "block_")


def last_rows(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The newest n rows of each group."""
    return df.withColumn("back", F.row_number().over(W.partitionBy(group).orderBy(F.desc(order)))).where(F.col("back") <= n)
