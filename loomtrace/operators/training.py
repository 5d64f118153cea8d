"""Training examples from runs: message lists, loss spans, segments, length profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.operators.selection import running


def training_role(role: Column) -> Column:
    """User and tool speak as user, every other role as assistant."""
    return F.when(F.lower(F.trim(role)).isin("user", "tool", "env", "environment"), "user").otherwise("assistant")


def assembled(messages: DataFrame, key: str, order: list[str], role: Column, content: Column, system: str) -> DataFrame:
    """(key, messages): a system message and the run's messages in order, as role and content."""
    m = messages.select(key, F.struct(*order, role.alias("role"), content.alias("content")).alias("m"))
    run = m.groupBy(key).agg(F.array_sort(F.collect_list("m")).alias("ms"))
    head = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")))
    return run.select(key, F.concat(head, F.transform("ms", lambda e: F.struct(e["role"].alias("role"), e["content"].alias("content")))).alias("messages"))


def segments(df: DataFrame, key: str, order: list[str], is_user: Column) -> DataFrame:
    """Adds `segment`: how many real user turns a run has had up to a row, for runs of any length."""
    return running(df, key, order, is_user.cast("int"), "segment")


def span_sums(tokens: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """(key, turn, n, total): the log-probabilities of the tokens that overlap each span, summed.

    tokens: key, s, e, logp; spans: key, turn, begin, finish. An interval join within a key: both sides are cut into
    blocks of 256 characters, so a long text spreads and only neighbours meet; a pair counts in its first shared block."""
    block = 256
    cut = lambda a, b: F.explode(F.sequence(F.floor(a / block), F.greatest(F.floor(a / block), F.floor((b - 1) / block))))
    t = tokens.withColumn("block", cut(F.col("s"), F.col("e")))
    p = spans.withColumn("block", cut(F.col("begin"), F.col("finish")))
    hit = t.join(p, [key, "block"]).where("s < finish AND e > begin").where(F.col("block") == F.greatest(F.floor(F.col("s") / block), F.floor(F.col("begin") / block)))
    return hit.groupBy(key, "turn").agg(F.count(F.lit(1)).alias("n"), F.sum("logp").alias("total"))


def loss_mask(tokens: Column, header: str, end: str) -> Column:
    """1 for the tokens of an array that lie between an assistant header and the end mark, the end mark included.

    Put together from the stretches between marks, so the work grows with the tokens, not with their square."""
    marks = F.filter(F.transform(tokens, lambda t, i: F.struct(i.alias("i"), t.alias("t"))), lambda m: m["t"].isin(header, end))
    k = F.greatest(F.size(marks) - 1, F.lit(0))
    until = F.concat(F.slice(F.transform(marks, lambda m: m["i"]), F.lit(2), k), F.array(F.size(tokens)))
    before = F.concat(F.array(F.lit("")), F.slice(F.transform(marks, lambda m: m["t"]), F.lit(1), k))
    spans = F.zip_with(marks, until, lambda m, j: F.struct(m["i"].alias("i"), m["t"].alias("t"), j.alias("j")))

    def stretch(m: Column, last: Column) -> Column:
        own = F.when((m["t"] != header) & (last == header), 1).otherwise(0)
        return F.concat(F.array(own), F.array_repeat(F.when(m["t"] == header, 1).otherwise(0), m["j"] - m["i"] - 1))

    zeros = lambda n: F.array_repeat(F.lit(0), n)
    return F.when(F.size(marks) == 0, zeros(F.size(tokens))).otherwise(F.concat(zeros(F.get(marks, F.lit(0))["i"]), F.flatten(F.zip_with(spans, before, stretch))))


def fitting(tokens: Column, head: Column, most: int) -> Column:
    """A token list that fits; else its head (the system turn) and the longest tail that fits with it, one token at least."""
    tail = F.greatest(F.lit(1), F.lit(most) - F.size(head))
    return F.when(F.size(tokens) <= most, tokens).otherwise(F.concat(head, F.slice(tokens, -tail, tail)))


def segment_examples(segmented: DataFrame, key: str, is_user: Column) -> DataFrame:
    """(key, segment, n, supervised): one example for each segment that begins with a user turn and has a reply."""
    return segmented.where("segment > 0").groupBy(key, "segment").agg(F.count(F.lit(1)).alias("n"), F.count_if(~is_user).alias("supervised")).where("supervised > 0")
