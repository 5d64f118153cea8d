"""Ranked retrieval: BM25 over an inverted index, thresholded vector search, selection of validation tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomtrace.session import cut_lineage, cut_lineage_in_place, together

#: Fixed values of the ranking function.
K1, B, QUERY_CAP = 1.2, 0.75, 3
#: Rows of query terms up to which the query side is broadcast; the count is checked. Beyond, both sides are salted.
BROADCAST_TERMS = 200_000
SALT = 16
#: Bytes of query vectors that a scan takes along, and queries compared at once within a task.
VECTOR_BYTES, VECTOR_ROWS = 64 << 20, 1024


def postings(docs: DataFrame, key: str, words: Column) -> DataFrame:
    """K8: (key, term, tf, dl), the materialised index. Documents without words have no postings."""
    w = docs.select(key, words.alias("words"))
    # the outer explode keeps the optimizer from finding the words a second time, to filter out empty lists
    return w.select(key, F.size("words").alias("dl"), F.explode_outer("words").alias("term")).where("term IS NOT NULL").groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def query_terms(queries: DataFrame, key: str, words: Column) -> DataFrame:
    """(key, term, weight): each term's count in the query, capped."""
    return queries.select(key, F.explode(words).alias("term")).groupBy(key, "term").agg(F.least(F.count(F.lit(1)), F.lit(QUERY_CAP)).alias("weight"))


def hits_of(terms: DataFrame, small: bool, docs: DataFrame, key: str, words: Column) -> DataFrame:
    """(key, term, tf, dl): the postings of the terms asked for, and one row without a term for each document. Documents
    are read and tokenised once, for everything that the ranking needs; what is kept lies together by document."""
    wanted = terms.select(F.col("term").alias("wanted")).distinct()
    wanted = wanted.unionByName(docs.sparkSession.createDataFrame([(None,)], "wanted STRING"))
    if small:
        wanted = F.broadcast(wanted)
    # the mark that a document exists is a word that is null; explode keeps the optimizer from finding the words a second time
    rows = docs.select(F.col(key).alias("key_"), words.alias("words")).select("key_", F.size("words").alias("dl"), F.explode(F.array_append("words", F.lit(None).cast("string"))).alias("term"))
    met = rows.join(wanted, F.col("term").eqNullSafe(F.col("wanted")), "left_semi")
    return cut_lineage_in_place(together(met, "key_").groupBy("key_", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl")))


def bm25_scores(queries: DataFrame, q_key: str, q_words: Column, docs: DataFrame, d_key: str, d_words: Column) -> DataFrame:
    """O1: (q_key, d_key, score) of every pair that shares a term.

    Scores are summed where a document's postings lie; a following top_k keeps k of each query there before it shuffles.
    With more query terms than are broadcast, the join by term is salted by document, so a common word is no hot key."""
    terms = cut_lineage(query_terms(queries, q_key, q_words))
    small = terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    hits = hits_of(terms, small, docs, d_key, d_words)
    whole = hits.where("term IS NULL").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).first()  # two numbers
    return _scored(terms, small, hits.where("term IS NOT NULL"), whole["n"], whole["avgdl"], q_key, d_key)


def _scored(terms: DataFrame, small: bool, hits: DataFrame, n: int, avgdl: float | None, q_key: str, d_key: str) -> DataFrame:
    avgdl = max(avgdl or 0.0, 1.0)
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rated = terms.join(df, "term").withColumn("idf", F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))).select("term", F.col(q_key).alias("q_"), "idf", "weight")
    if small:
        both = hits.join(F.broadcast(rated), "term")
    else:
        salted = rated.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALT - 1).cast("bigint"))))
        both = hits.withColumn("salt", F.pmod(F.xxhash64("key_"), F.lit(SALT))).join(salted, ["term", "salt"])
    norm = K1 * (1 - B + B * F.col("dl") / F.lit(float(avgdl)))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + norm) * F.col("weight")
    return both.groupBy("key_", "q_").agg(F.sum(part).alias("score")).select(F.col("q_").alias(q_key), F.col("key_").alias(d_key), "score")


def bm25_from_index(queries: DataFrame, q_key: str, q_words: Column, path: str, d_key: str) -> DataFrame:
    """O1 from the index that `files.write_index` keeps (K8): no document is read again, and of the postings only the row
    groups that may hold a query's terms, since they lie by term."""
    spark = queries.sparkSession
    terms = cut_lineage(query_terms(queries, q_key, q_words))
    small = terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    wanted = terms.select("term").distinct()
    hits = spark.read.parquet(f"{path}/postings").join(F.broadcast(wanted) if small else wanted, "term", "left_semi")
    whole = spark.read.parquet(f"{path}/whole").first()  # two numbers
    kept = cut_lineage_in_place(together(hits.withColumnRenamed(d_key, "key_"), "key_"))
    return _scored(terms, small, kept, whole["n"], whole["avgdl"], q_key, d_key)


def top_k(scores: DataFrame, q_key: str, d_key: str, k: int) -> DataFrame:
    """The k best of each query; ties at nine digits go to the smaller key."""
    best = W.partitionBy(q_key).orderBy(F.round("score", 9).desc(), d_key)
    return scores.where("score > 0").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def nearest(q: np.ndarray, qid: np.ndarray, m: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(q, key, score) of the k best of a batch for each query, by score at nine digits, then key; ties are never cut by place."""
    by_key = np.argsort(own, kind="stable")
    m, own = m[by_key], own[by_key]
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(q @ np.divide(m, norm, out=np.zeros_like(m), where=norm > 0).T, 9)
    s[(qid[:, None] == own[None, :]) | (norm.T == 0)] = -2
    if s.shape[1] > k:
        least = -np.partition(-s, k - 1, axis=1)[:, k - 1]
        r, c = np.nonzero(s >= least[:, None])
        r, c = _first_k(r, c, s[r, c], k)
    else:
        r, c = np.indices(s.shape).reshape(2, -1)
    keep = s[r, c] > -2
    return qid[r[keep]], own[c[keep]], s[r[keep], c[keep]]


def _first_k(r: np.ndarray, c: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of candidates (row, column in order of keys, score), the k first of each row by score, then column."""
    order = np.lexsort((c, -s, r))
    r, c = r[order], c[order]
    first = np.searchsorted(r, r)
    keep = np.arange(len(r)) - first < k
    return r[keep], c[keep]


def vector_top_k(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int, threshold: float) -> DataFrame:
    """O3: (q, key, score): the k vectors nearest by cosine to each query, itself excluded, then those at or over the threshold.

    Queries come to the driver and go to the tasks in blocks of VECTOR_BYTES, one at a time, each with one scan of the
    vectors; each task keeps k per query from its part, and only those are shuffled. Results of a block are kept before
    the next one, if there is one. Null and zero vectors match nothing."""
    spark = vectors.sparkSession
    rank = W.partitionBy("q").orderBy(F.col("score").desc(), key)
    schema = f"q BIGINT, `{key}` BIGINT, score DOUBLE"
    found: list[DataFrame] = []

    def search(ids: list[int], mats: list[list[float]]) -> DataFrame:
        q = np.array(mats, np.float64)
        norm = np.linalg.norm(q, axis=1, keepdims=True)
        some = norm[:, 0] > 0
        block = spark.sparkContext.broadcast((np.array(ids, np.int64)[some], q[some] / norm[some]))  # at most VECTOR_BYTES

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qid, q = block.value
            for batch in batches:
                if not len(batch) or not len(qid):
                    continue
                own = batch.column(0).to_numpy(zero_copy_only=False)
                m = np.array(batch.column(1).to_pylist(), np.float64)
                for at in range(0, len(qid), VECTOR_ROWS):
                    got = nearest(q[at : at + VECTOR_ROWS], qid[at : at + VECTOR_ROWS], m, own, k)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], names=["q", key, "score"])

        near = vectors.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint"), vector).mapInArrow(run, schema)
        return near.withColumn("rank", F.row_number().over(rank)).where((F.col("rank") <= k) & (F.col("score") >= threshold)).drop("rank")

    ids: list[int] = []
    mats: list[list[float]] = []
    for row in queries.where(F.col(vector).isNotNull()).select(key, vector).toLocalIterator():
        ids.append(row[0])
        mats.append(row[1])
        if 8 * len(ids) * len(mats[0]) >= VECTOR_BYTES:
            found.append(cut_lineage(search(ids, mats)))
            ids, mats = [], []
    if ids:
        found.append(search(ids, mats))
    if not found:
        return spark.createDataFrame([], schema)
    out = found[0]
    for p in found[1:]:
        out = out.unionByName(p)
    return out


def validation_selection(ranked: DataFrame, key: str, score: str, outcome: str, failures: int = 2, successes: int = 1, controls: int = 2) -> DataFrame:
    """(key, part, place): tasks on which a memory is tried: the best-ranked failures and success, filled up by rank,
    and as controls the worst-ranked successes not among them, filled up from the end. Ties go to the smaller key.

    Only candidates are ranked: the best and worst few of all, of the failures and of the successes, each a top-n, so no
    task sorts all rows."""
    want, total = failures + successes, failures + successes + controls
    r = ranked.withColumn("kind", F.when(F.col(outcome) == 0, 0).when(F.col(outcome) == 1, 1).otherwise(2)).withColumn("r_", F.round(score, 9))
    best, worst = [F.desc("r_"), F.asc(key)], [F.asc("r_"), F.desc(key)]
    near = r.orderBy(*worst).limit(2 * total)
    for part in (r.orderBy(*best).limit(total), *(r.where(F.col("kind") == k).orderBy(*o).limit(n) for k in (0, 1) for o, n in ((best, total), (worst, 2 * total)))):
        near = near.unionByName(part)
    near = near.dropDuplicates([key]).withColumn("up", F.row_number().over(W.orderBy(*best)))
    near = near.withColumn("n_up", F.row_number().over(W.partitionBy("kind").orderBy("up")))
    first = F.when((F.col("kind") == 0) & (F.col("n_up") <= failures), 0).when((F.col("kind") == 1) & (F.col("n_up") <= successes), 1).otherwise(2)
    a = near.withColumn("phase", first).withColumn("place", F.row_number().over(W.orderBy("phase", "up")))
    related = a.where(F.col("place") <= want).select(key, F.lit("related").alias("part"), "place")
    b = near.join(related.select(key), key, "left_anti").withColumn("late", F.row_number().over(W.partitionBy("kind").orderBy(F.desc("up"))))
    phase = F.when((F.col("kind") == 1) & (F.col("late") <= controls), 0).otherwise(1)
    c = b.withColumn("place", F.row_number().over(W.orderBy(phase, F.desc("up")))).where(F.col("place") <= controls)
    return related.unionByName(c.select(key, F.lit("control").alias("part"), "place"))
