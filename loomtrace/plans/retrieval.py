"""Retrieval and overlap queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrace.functions.text import RANKING_STOPWORDS, RETRIEVAL_STOPWORDS, tokens
from loomtrace.operators import retrieval, similarity
from loomtrace.operators.selection import positions
from loomtrace.plans.registry import TRAJ, query, rounded, runs, table
from loomtrace.session import cut_lineage, ship, spread

#: The memory candidate that is looked up where an operator takes one query.
CANDIDATE = "ticket transfers and refund windows on the help page of the harbour library"


def toks(expr: str, words: list[str]) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({expr}, '')), '[a-z0-9]+'), lambda t: NOT list_contains([{', '.join(repr(w) for w in words)}], t))"


def _bm25(terms: str, docs: str) -> str:
    return f"""{docs}, dl AS (SELECT doc_id, len(ws) AS dl FROM doc), tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS term FROM doc) GROUP BY ALL),
        whole AS (SELECT count(*) AS n, greatest(coalesce(avg(len(ws)), 0), 1) AS avgdl FROM doc), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
        {terms}, score AS (SELECT q.id, tf.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) * weight) AS score
            FROM q JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id), whole GROUP BY ALL)"""


_DOC = f"doc AS (SELECT doc_id, {toks('concat_ws(chr(32), source, source, text)', RETRIEVAL_STOPWORDS)} AS ws FROM documents)"
_RANK = f"doc AS (SELECT doc_id, {toks('text', RANKING_STOPWORDS)} AS ws FROM documents)"


@query(
    f"""WITH {_bm25(f"q AS (SELECT id, term, least(count(*), 3) AS weight FROM (SELECT id, unnest({toks('instruction', RETRIEVAL_STOPWORDS)}) AS term FROM tasks) GROUP BY ALL)", _DOC)}
    SELECT id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM score WHERE score > 0) WHERE rank <= 3"""
)
def bm25_topk(spark, d):
    """The three best documents for each task's instruction, the source counted twice."""
    docs, tasks = spread(table(spark, d, "documents")), table(spark, d, "tasks")
    words = tokens(F.concat_ws(" ", "source", "source", "text"), RETRIEVAL_STOPWORDS)
    s = retrieval.bm25_scores(tasks, "id", tokens(F.col("instruction"), RETRIEVAL_STOPWORDS), docs, "doc_id", words)
    return retrieval.top_k(s, "id", "doc_id", 3).select("id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(
    f"""WITH {_bm25(f"q AS (SELECT 0 AS id, term, least(count(*), 3) AS weight FROM (SELECT unnest({toks(repr(CANDIDATE), RANKING_STOPWORDS)}) AS term) GROUP BY ALL)", _RANK)}
    SELECT doc_id, round(coalesce(score, 0), 6) AS score FROM documents LEFT JOIN score USING (doc_id)"""
)
def bm25_rank_all(spark, d):
    """O2: every document's score for one memory candidate, zeros kept."""
    docs = spread(table(spark, d, "documents"))
    q = spark.createDataFrame([(0, CANDIDATE)], "id INT, text STRING")
    s = retrieval.bm25_scores(q, "id", tokens(F.col("text"), RANKING_STOPWORDS), docs, "doc_id", tokens(F.col("text"), RANKING_STOPWORDS))
    return docs.select("doc_id").join(s.select("doc_id", "score"), "doc_id", "left").select("doc_id", F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"))


@query(
    """WITH s AS (SELECT q.vec_id AS q, v.vec_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)
    SELECT q, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s) WHERE rank <= 5 AND score >= 0.3"""
)
def vector_topk_threshold(spark, d):
    """O3: five nearest vectors of every fiftieth, then the threshold on the score."""
    ship(spark)
    v = table(spark, d, "embeddings")
    return retrieval.vector_top_k(v, v.where("vec_id % 50 = 0"), "vec_id", "embedding", 5, 0.3).select("q", "vec_id", F.round("score", 6).alias("score"))


_TASK = f"doc AS (SELECT id AS doc_id, {toks('instruction', RANKING_STOPWORDS)} AS ws FROM tasks)"


@query(
    f"""WITH {TRAJ}, oc AS (SELECT source_task_id AS id, max(CASE WHEN success THEN 1 ELSE 0 END) AS outcome FROM traj WHERE status = 'complete' AND success IS NOT NULL AND source_task_id IS NOT NULL GROUP BY ALL),
    {_bm25(f"q AS (SELECT 0 AS id, term, least(count(*), 3) AS weight FROM (SELECT unnest({toks(repr(CANDIDATE), RANKING_STOPWORDS)}) AS term) GROUP BY ALL)", _TASK)},
    r AS (SELECT t.id, coalesce(score, 0) AS score, outcome, row_number() OVER (ORDER BY round(coalesce(score, 0), 9) DESC, t.id) AS up FROM tasks t LEFT JOIN score s ON s.doc_id = t.id LEFT JOIN oc ON oc.id = t.id),
    a AS (SELECT *, CASE WHEN outcome = 0 AND row_number() OVER (PARTITION BY outcome ORDER BY up) <= 2 THEN 0 WHEN outcome = 1 AND row_number() OVER (PARTITION BY outcome ORDER BY up) <= 1 THEN 1 ELSE 2 END AS phase FROM r),
    rel AS (SELECT id, place FROM (SELECT id, row_number() OVER (ORDER BY phase, up) AS place FROM a) WHERE place <= 3),
    b AS (SELECT *, CASE WHEN outcome = 1 AND row_number() OVER (PARTITION BY outcome ORDER BY up DESC) <= 2 THEN 0 ELSE 1 END AS phase FROM r WHERE id NOT IN (SELECT id FROM rel)),
    con AS (SELECT id, place FROM (SELECT id, row_number() OVER (ORDER BY phase, up DESC) AS place FROM b) WHERE place <= 2)
    SELECT id, 'related' AS part, CAST(place AS INTEGER) AS place FROM rel UNION ALL SELECT id, 'control', CAST(place AS INTEGER) FROM con"""
)
def validation_selection(spark, d):
    """Tasks on which a memory candidate is tried, by rank and known outcome."""
    tasks = table(spark, d, "tasks")
    q = spark.createDataFrame([(0, CANDIDATE)], "q INT, text STRING")
    s = retrieval.bm25_scores(q, "q", tokens(F.col("text"), RANKING_STOPWORDS), tasks, "id", tokens(F.col("instruction"), RANKING_STOPWORDS))
    known = runs(spark, d).where("status = 'complete' AND success IS NOT NULL AND source_task_id IS NOT NULL").groupBy(F.col("source_task_id").alias("id")).agg(F.max(F.col("success").cast("int")).alias("outcome"))
    ranked = tasks.select("id").join(s.select("id", "score"), "id", "left").join(known, "id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return retrieval.validation_selection(cut_lineage(ranked), "id", "score", "outcome")


@query(
    f"""WITH s AS (SELECT id, list_distinct({toks('instruction', RANKING_STOPWORDS)}) AS ws FROM tasks), p AS (SELECT a.id, b.id AS other, len(list_intersect(a.ws, b.ws)) AS i, len(a.ws) + len(b.ws) AS n FROM s a JOIN s b ON b.id < a.id WHERE len(list_intersect(a.ws, b.ws)) > 0)
    SELECT id, other, round(i / (n - i), 6) AS overlap FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(i / (n - i), 9) DESC, other) AS r FROM p WHERE i / (n - i) >= 0.25) WHERE r = 1"""
)
def overlap_best(spark, d):
    """Each task's most similar earlier one by word overlap, at a quarter or over."""
    ship(spark)
    t = table(spark, d, "tasks")
    return similarity.best_overlap(t, "id", tokens(F.col("instruction"), RANKING_STOPWORDS)).select("id", "other", F.round("overlap", 6).alias("overlap"))


@query()
def near_duplicates(spark, d):
    """O5, O7, J8 over the memories: five-word runs, similarity 0.8; too slow as SQL on whole tables, held against brute force in the tests."""
    ship(spark)
    return rounded(similarity.near_duplicates(spread(table(spark, d, "documents")), "doc_id", F.col("text")), "overlap")


@query(
    f"""WITH s AS (SELECT doc_id, {toks("text", RANKING_STOPWORDS)} AS n FROM documents WHERE source IS NOT NULL), o AS (SELECT doc_id, lag(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS before FROM documents WHERE source IS NOT NULL)
    SELECT o.doc_id, before, round(CASE WHEN len(list_distinct(p.n)) = 0 THEN 1.0 ELSE len(list_intersect(list_distinct(p.n), s.n)) / len(list_distinct(p.n)) END, 6) AS retention FROM o JOIN s USING (doc_id) JOIN s p ON p.doc_id = before"""
)
def retention_pairs(spark, d):
    """How much of the words of the memory before it in its source each memory keeps; one source may hold a third of all."""
    docs = spread(table(spark, d, "documents")).where("source IS NOT NULL").select("source", "doc_id", F.array_distinct(tokens(F.col("text"), RANKING_STOPWORDS)).alias("ws"))
    p = positions(docs, ["source", "doc_id"])
    before = p.select((F.col("pos") + 1).alias("pos"), F.col("source").alias("source_"), F.col("doc_id").alias("before"), F.col("ws").alias("old"))
    both = p.join(before, "pos").where(F.col("source") == F.col("source_"))
    return both.select("doc_id", "before", F.round(similarity.containment(F.col("old"), F.col("ws")), 6).alias("retention"))


@query("""WITH c AS (SELECT text, min(doc_id) AS class_id, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1) SELECT doc_id, class_id, n FROM documents JOIN c USING (text)""")
def exact_duplicates(spark, d):
    """Documents whose text another one has too, with their class."""
    return similarity.exact_copies(table(spark, d, "documents"), "doc_id", F.col("text"))
