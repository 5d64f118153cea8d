"""Overlap of token sets by an inverted index, containment, exact copies."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomtrace.operators import near
from loomtrace.session import cut_lineage


#: Buckets of hashed terms whose frequencies order the terms: at most so many numbers are broadcast, whatever the corpus.
BUCKETS = 1 << 18
#: Rows of a term's list of prefixes up to which it stays in one piece; longer lists are joined block by block.
BLOCK = 2000


def shingles(words: Column, n: int = 5) -> Column:
    """Runs of n neighbouring words, hashed; a text of fewer words is one run, one without words none."""
    k = F.size(words)
    runs = F.transform(F.sequence(F.lit(0), F.greatest(k - n, F.lit(0))), lambda i: F.xxhash64(F.array_join(F.slice(words, i + 1, F.lit(n)), " ")))
    return F.when(k > 0, runs).otherwise(F.array().cast("array<bigint>"))


def _by_rarity(bags: DataFrame, key: str) -> DataFrame:
    """(key, hs, size): each set of hashes, rarest first. Any one order of all terms makes the prefix filter exact; this one
    goes by the counts of hashed buckets, so that what is broadcast is bounded, and then by hash."""
    counts = bags.select(F.explode("hs").alias("h")).groupBy(F.pmod("h", F.lit(BUCKETS)).alias("bucket")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    freq = np.zeros(BUCKETS, np.int64)
    freq[counts.column(0).to_numpy()] = counts.column(1).to_numpy()
    shared = bags.sparkSession.sparkContext.broadcast(freq)

    @F.pandas_udf("array<bigint>")
    def ordered(hs: pd.Series) -> pd.Series:
        f = shared.value
        return pd.Series([h[np.lexsort((h, f[h % BUCKETS]))] for h in (np.asarray(x, np.int64) for x in hs)])

    return bags.select(key, ordered("hs").alias("hs"), "size")


def earlier_overlaps(df: DataFrame, key: str, terms: Column, threshold: float) -> DataFrame:
    """(key, other, overlap): Jaccard similarity of each row's term set with those of rows before it, at the threshold or over.

    Texts are read once; then only hashes move. Prefix filter: terms go from rare to common, and two sets that overlap
    that much share one of their first ``size - ceil(threshold * size) + 1`` terms; a pair is a candidate only if its sizes
    and the places of the shared term leave room for the overlap. A term with a long list is joined block by block, so no
    task meets all rows of a common term. Rows without terms are similar to none."""
    bags = df.select(key, F.array_distinct(terms).alias("ts")).where(F.size("ts") > 0)
    hashes = F.col("ts") if dict(bags.dtypes)["ts"] == "array<bigint>" else F.transform("ts", lambda t: F.xxhash64(t))
    kept = cut_lineage(_by_rarity(cut_lineage(bags.select(key, hashes.alias("hs"), F.size("ts").alias("size"))), key))
    cut = (F.col("size") - F.ceil(F.lit(threshold) * F.col("size") - 1e-9) + 1).cast("int")
    heads = kept.select(key, "size", F.posexplode(F.slice("hs", F.lit(1), F.greatest(cut, F.lit(1)))).alias("place", "term"))
    long = heads.groupBy("term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK).select("term", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    heads = heads.join(long, "term", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    a = heads.select(F.col(key).alias("a_key"), F.col("size").alias("a_size"), F.col("place").alias("a_place"), "term", F.col("own").alias("a_block"), each.alias("b_block"))
    b = heads.select(F.col(key).alias("b_key"), F.col("size").alias("b_size"), F.col("place").alias("b_place"), "term", F.col("own").alias("b_block"), each.alias("a_block"))
    least = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("a_size") + F.col("b_size")) - 1e-9)
    room = F.least(F.col("a_place"), F.col("b_place")) + 1 + F.least(F.col("a_size") - F.col("a_place"), F.col("b_size") - F.col("b_place")) - 1
    fits = (F.least("a_size", "b_size") >= F.lit(threshold) * F.greatest("a_size", "b_size") - 1e-9) & (room >= least)
    pairs = a.join(b, ["term", "a_block", "b_block"]).where((F.col("b_key") < F.col("a_key")) & fits).select("a_key", "b_key").distinct()
    both = pairs.join(kept.select(F.col(key).alias("a_key"), F.col("hs").alias("a_hs")), "a_key").join(kept.select(F.col(key).alias("b_key"), F.col("hs").alias("b_hs")), "b_key")
    shared = F.size(F.array_intersect("a_hs", "b_hs"))
    overlap = both.select(F.col("a_key").alias(key), F.col("b_key").alias("other"), (shared / (F.size("a_hs") + F.size("b_hs") - shared)).alias("overlap"))
    return overlap.where(F.col("overlap") >= threshold)


def near_duplicates(df: DataFrame, key: str, text: Column, threshold: float = 0.8, n: int = 5) -> DataFrame:
    """O5, O7, J8 over a corpus: (key, class_id, links, other, overlap), one row for each row of df with a key.

    Equal texts are one class, named by its least key, and only classes are compared: `links` is how many other classes
    the row's class resembles by n-word runs at the threshold, `other` the earlier one it resembles most (the least on
    ties), null if none. Null texts, and texts without a word, are classes of their own text."""
    rows = df.where(F.col(key).isNotNull()).select(key, text.alias("text"))
    named = F.min(key).over(W.partitionBy("digest"))
    digest = F.coalesce(F.unhex(F.md5("text")), F.lit(b""))
    members = cut_lineage(rows.select(key, digest.alias("digest")).withColumn("class_id", named).select(key, "class_id"))
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    firsts = near.only(rows, key, members.where(F.col(key) != F.col("class_id")).select(key), "left_anti")
    pairs = cut_lineage(near.near_pairs(firsts, key, words, n, threshold, members.count(), BLOCK).withColumnRenamed(key, "class_id"))
    links = pairs.select("class_id").unionByName(pairs.select(F.col("other").alias("class_id"))).groupBy("class_id").agg(F.count(F.lit(1)).alias("links"))
    best = pairs.groupBy("class_id").agg(F.max(F.struct(F.round("overlap", 9).alias("overlap"), (-F.col("other")).alias("other"))).alias("b"))
    told = links.join(best, "class_id", "left")
    return members.join(told, "class_id", "left").select(key, "class_id", F.coalesce("links", F.lit(0)).alias("links"), (-F.col("b.other")).alias("other"), F.col("b.overlap").alias("overlap"))


def best_overlap(df: DataFrame, key: str, words: Column, threshold: float = 0.25) -> DataFrame:
    """Each row's most similar earlier row, the earliest on ties; rows without one at the threshold are left out."""
    best = W.partitionBy(key).orderBy(F.round("overlap", 9).desc(), "other")
    return earlier_overlaps(df, key, words, threshold).withColumn("n", F.row_number().over(best)).where("n = 1").drop("n")


def containment(old: Column, new: Column) -> Column:
    """Share of the old words that the new ones keep; 1 if there are no old ones."""
    o = F.array_distinct(old)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(o, new)).cast("double"), F.size(o).cast("double")), F.lit(1.0))


def exact_copies(df: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, class_id, n): rows whose folded text another row has too, with the smallest key of the class.

    Grouping is on a 128-bit digest of the text, so texts themselves are not shuffled."""
    d = df.where(text.isNotNull()).select(key, F.md5(text).alias("digest"))
    classes = d.groupBy("digest").agg(F.min(key).alias("class_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return d.join(classes, "digest").select(key, "class_id", "n")
