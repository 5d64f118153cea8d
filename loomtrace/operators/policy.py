"""The four-way routing policy as array expressions: features, distribution, loss scalars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.functions.text import RANKING_STOPWORDS, hashed_bag, tokens

#: The routes in the order of the policy's outputs.
ROUTES = ("memory", "sft", "both", "neither")


def features(success: Column, reward: Column, active: Column, recent: Column, draft: Column) -> Column:
    """Success, reward, active / 20, then the hashed words of the recent changes and of the draft: 35 numbers."""
    bag = lambda t: hashed_bag(tokens(t, RANKING_STOPWORDS))
    head = F.array(F.coalesce(success, F.lit(False)).cast("double"), F.coalesce(reward, F.lit(0.0)).cast("double"), (F.coalesce(active, F.lit(0)) / F.lit(20.0)).cast("double"))
    return F.concat(head, bag(recent), bag(draft))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def softmax(logits: Column) -> Column:
    """Probabilities by log-sum-exp."""
    top = F.array_max(logits)
    ex = F.transform(logits, lambda z: F.exp(z - top))
    return F.transform(ex, lambda e: e / F.aggregate(ex, F.lit(0.0), lambda s, x: s + x))


def argmax(p: Column) -> Column:
    """Index from 0 of the first maximum."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def entropy(p: Column) -> Column:
    return -F.aggregate(F.transform(p, lambda x: F.when(x > 0, x * F.ln(x)).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)


def temper(p: Column, ratio: float) -> Column:
    """A distribution at another temperature: softmax of ln(max(p, 1e-30)) * ratio."""
    return softmax(F.transform(p, lambda x: F.ln(F.greatest(x, F.lit(1e-30))) * ratio))


def sampled(p: Column, u: Column) -> Column:
    """Index by inverse distribution from a number in [0, 1)."""
    run = F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.aggregate(F.slice(p, F.lit(1), i), F.lit(0.0), lambda s, x: s + x))
    return F.least(F.size(F.filter(run, lambda c: c <= u)), F.size(p) - 1)


def loss(df: DataFrame, advantage: str, log_prob: str, h: str, weight: float = 0.01) -> DataFrame:
    """The policy-gradient term, the entropy term and their sum; one row."""
    pg, ent = -F.sum(F.col(advantage) * F.col(log_prob)), F.sum(h)
    return df.agg(pg.alias("pg_term"), ent.alias("entropy_sum"), (pg - weight * ent).alias("loss"))


def drift(df: DataFrame, before: str, after: str) -> DataFrame:
    """Largest and mean change of any route's probability."""
    d = F.array_max(F.zip_with(before, after, lambda a, b: F.abs(a - b)))
    return df.agg(F.max(d).alias("max_drift"), F.avg(d).alias("mean_drift"))
