"""Comparison of evaluation runs: summaries, paired outcomes, facets. Everything aggregates before it shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, at: str = "ingested_at") -> DataFrame:
    """One row for each key, the one delivered last; rows without a key are left out. Deliveries of a key have one content."""
    at_ = F.coalesce(F.col(at), F.lit("0001-01-01").cast("timestamp_ntz"))
    # one aggregate for each column, so that those nobody asks for are never read
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.max_by(c, at_).alias(c) for c in df.columns if c != key])


def spelled(c: str) -> Column:
    return F.lower(F.trim(F.col(c)))


def complete(runs: DataFrame) -> DataFrame:
    """Rollouts that ended in order, one row per run."""
    return latest(runs, "run_id").withColumn("status", spelled("status")).withColumn("domain", spelled("domain")).where("status = 'complete'")


def summary(runs: DataFrame, *by: str) -> DataFrame:
    """A1: runs, complete, errors, successes, pass_rate (null without complete runs), mean_reward."""
    done = F.col("status") == "complete"
    return runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(done).alias("complete"), F.count_if(F.col("status") == "error").alias("errors"), F.count_if(done & F.col("success")).alias("successes"),
        F.try_divide(F.count_if(done & F.col("success")).cast("double"), F.nullif(F.count_if(done), F.lit(0)).cast("double")).alias("pass_rate"), F.avg(F.when(done, F.col("reward"))).alias("mean_reward"),
    )


def zero_filled(df: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """A4: counts over a fixed domain, zeros included; other values are left out."""
    whole = df.sparkSession.createDataFrame([(v,) for v in domain], f"{column} STRING")
    return F.broadcast(whole).join(df.groupBy(column).agg(F.count(F.lit(1)).alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def task_outcomes(runs: DataFrame) -> DataFrame:
    """(source_task_id, model, outcome): the share of a task's complete runs that succeeded."""
    known = runs.where("source_task_id IS NOT NULL AND success IS NOT NULL")
    return known.groupBy("source_task_id", "model").agg(F.avg(F.col("success").cast("double")).alias("outcome"))


def paired(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The tasks both runs have, with outcomes a and b."""
    return a.select(key, F.col("outcome").alias("a")).join(b.select(key, F.col("outcome").alias("b")), key)


def utility(pairs: DataFrame) -> DataFrame:
    """Helped, hurt, unchanged by level, rates, delta and net utility (helped - 2 hurt) / n; one row."""
    a, b = F.col("a"), F.col("b")
    n = F.count(F.lit(1))
    return pairs.agg(
        n.alias("n"), F.count_if(b > a).alias("helped"), F.count_if(b < a).alias("hurt"), F.count_if((a == b) & (a > 0)).alias("unchanged_positive"), F.count_if((a == b) & (a <= 0)).alias("unchanged_zero"),
        F.avg("a").alias("rate_a"), F.avg("b").alias("rate_b"), (F.avg("b") - F.avg("a")).alias("delta"),
        F.try_divide((F.count_if(b > a) - 2 * F.count_if(b < a)).cast("double"), n.cast("double")).alias("net"),
    )


def flips(pairs: DataFrame) -> DataFrame:
    """Paired disagreement on success."""
    a, b = F.col("a") >= 0.5, F.col("b") >= 0.5
    return pairs.agg(F.count(F.lit(1)).alias("n"), F.count_if(a != b).alias("flips"), F.try_divide(F.count_if(a != b).cast("double"), F.count(F.lit(1)).cast("double")).alias("flip_rate"))


def agreement(runs: DataFrame, key: str, repeats: int) -> DataFrame:
    """Tasks with at least `repeats` runs, those whose runs all agree, and the share; one row."""
    per = runs.where(F.col(key).isNotNull() & F.col("success").isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("success").alias("low"), F.max("success").alias("high")).where(F.col("n") >= repeats)
    same = F.count_if(F.col("low") == F.col("high"))
    return per.agg(F.count(F.lit(1)).alias("tasks"), same.alias("agreeing"), F.try_divide(same.cast("double"), F.count(F.lit(1)).cast("double")).alias("agreement"))


def correlation(df: DataFrame, x: Column, y: Column) -> DataFrame:
    """Pearson correlation; null where either side doesn't vary."""
    both = df.where(x.isNotNull() & y.isNotNull()).select(x.cast("double").alias("x"), y.cast("double").alias("y"))
    s = both.agg(F.count(F.lit(1)).alias("n"), F.covar_pop("x", "y").alias("c"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    return s.select("n", F.when((F.col("sx") > 0) & (F.col("sy") > 0), F.col("c") / (F.col("sx") * F.col("sy"))).alias("r"))


def upper_median(c: Column) -> Column:
    """The element at n div 2 of the sorted values."""
    xs = F.sort_array(F.collect_list(c))
    return F.get(xs, F.floor(F.size(xs) / 2).cast("int"))


def upper_median_by_counts(df: DataFrame, by: str, value: str) -> DataFrame:
    """The same for groups of any size: equal values are counted first, and the running count is over distinct values only."""
    from pyspark.sql import Window as W

    counts = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy(by)
    run = counts.withColumn("upto", F.sum("n").over(w.orderBy(value))).withColumn("all", F.sum("n").over(w))
    return run.where(F.col("upto") > F.floor(F.col("all") / 2)).groupBy(by).agg(F.min(value).alias("p50"), F.first("all").alias("n"))


def digest(df: DataFrame, key: str, order: str, text: Column) -> DataFrame:
    """First 16 hex digits of the SHA-256 of a run's texts in order, joined by NUL."""
    parts = df.where(text.isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order), text.alias("t")))).alias("p"))
    return parts.select(key, F.substring(F.sha2(F.array_join(F.transform("p", lambda e: e["t"]), "\0"), 256), 1, 16).alias("digest"))


def same_result(a: DataFrame, b: DataFrame) -> DataFrame:
    """Whether two results are the same set of rows; one row (equal, only_a, only_b)."""
    x, y = a.distinct(), b.select(*a.columns).distinct()
    both = x.withColumn("s", F.lit(1)).unionByName(y.withColumn("s", F.lit(2))).groupBy(*a.columns).agg(F.sum("s").alias("s"))
    return both.agg(F.count_if(F.col("s") == 1).alias("only_a"), F.count_if(F.col("s") == 2).alias("only_b")).select((F.col("only_a") + F.col("only_b") == 0).alias("equal"), "only_a", "only_b")
