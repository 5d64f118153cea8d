"""Selection, sampling and split queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrace.operators import selection as sel
from loomtrace.plans.registry import REPLY, TRAJ, query, replies, runs, table

_H = "md5(concat_ws('|', '7', {}))"


@query(f"WITH {TRAJ}, o AS (SELECT source_task_id, run_id FROM traj WHERE success AND source_task_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_task_id ORDER BY run_id) = 1) SELECT source_task_id, run_id FROM o ORDER BY run_id LIMIT 25")
def exact_n_unique_selection(spark, d):
    """L1: the first 25 successes of distinct tasks (a selection of a stated size)."""
    r = runs(spark, d).where("success AND source_task_id IS NOT NULL").select("source_task_id", "run_id")
    return sel.exact_unique(r, ["source_task_id"], ["run_id"], 25)


@query("SELECT id, CAST((row_number() OVER (ORDER BY id) - 1) // 8 AS BIGINT) AS batch FROM tasks")
def fixed_batches(spark, d):
    """L2."""
    return sel.batches(table(spark, d, "tasks").select("id"), ["id"], 8).select("id", "batch")


@query("SELECT doc_id, CAST(ntile(7) OVER (ORDER BY doc_id) - 1 AS INTEGER) AS chunk FROM documents")
def near_equal_chunks(spark, d):
    """L3: seven slices, the larger first, without sorting the corpus in one task."""
    docs = table(spark, d, "documents").select("doc_id")
    return sel.chunks(docs, ["doc_id"], 7, docs.count()).select("doc_id", "chunk")


@query(f"SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY {_H.format('CAST(doc_id AS VARCHAR)')}) AS turn FROM documents WHERE source IS NOT NULL) ORDER BY turn, source LIMIT 60")
def round_robin_strata(spark, d):
    """L4: sixty documents, one of each source in turn (a sample of a stated size)."""
    docs = table(spark, d, "documents").where("source IS NOT NULL").select("source", "doc_id")
    return sel.round_robin(docs, "source", sel.hash_order(F.lit("7"), F.col("doc_id").cast("string")), 60).select("source", "doc_id")


@query(f"WITH c AS (SELECT source, round_even(150 * count(*) / (SELECT count(*) FROM documents WHERE source IS NOT NULL), 0) AS quota FROM documents WHERE source IS NOT NULL GROUP BY source) SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY {_H.format('CAST(doc_id AS VARCHAR)')}) AS turn FROM documents WHERE source IS NOT NULL) JOIN c USING (source) WHERE turn <= quota")
def proportional_quota(spark, d):
    """Quotas of 150 by share, halves to even."""
    docs = table(spark, d, "documents").where("source IS NOT NULL").select("source", "doc_id")
    return sel.proportional(docs, "source", sel.hash_order(F.lit("7"), F.col("doc_id").cast("string")), 150).select("source", "doc_id")


@query(f"SELECT lang, doc_id, CASE WHEN turn <= 0.8 * n THEN 'train' ELSE 'test' END AS part FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY {_H.format('CAST(doc_id AS VARCHAR)')}) AS turn, count(*) OVER (PARTITION BY lang) AS n FROM documents WHERE lang IS NOT NULL)")
def stratified_split(spark, d):
    """Four fifths of each language to train, by hash order; one language may hold most documents."""
    h = sel.hash_order(F.lit("7"), F.col("doc_id").cast("string"))
    r = sel.ranked(table(spark, d, "documents").where("lang IS NOT NULL").select("lang", "doc_id", h.alias("h")), "lang", ["h"])
    return r.select("lang", "doc_id", F.when(F.col("turn") <= 0.8 * F.col("n"), "train").otherwise("test").alias("part"))


@query("SELECT doc_id, doc_id % 40 + 1 AS level, CASE WHEN doc_id < 500 THEN 'test' WHEN doc_id < 1500 THEN 'dev' ELSE 'train' END AS part FROM documents")
def index_range_split(spark, d):
    """Parts by range of the index, levels by remainder."""
    i = F.col("doc_id")
    return table(spark, d, "documents").select("doc_id", (i % 40 + 1).alias("level"), F.when(i < 500, "test").when(i < 1500, "dev").otherwise("train").alias("part"))


@query(f"WITH {TRAJ} SELECT source_task_id, run_id FROM traj WHERE source_task_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_task_id ORDER BY {_H.format('run_id')}) = 1")
def random_candidate(spark, d):
    """One run of each task by hash, not the best."""
    r = runs(spark, d).where("source_task_id IS NOT NULL").select("source_task_id", "run_id")
    return sel.one_of(r, "source_task_id", sel.hash_order(F.lit("7"), F.col("run_id")))


@query("SELECT id FROM tasks ORDER BY id LIMIT 15")
def probe_set(spark, d):
    """The first fifteen ids (a set of a stated size)."""
    return table(spark, d, "tasks").select("id").orderBy("id").limit(15)


@query(f"WITH {REPLY}, m AS (SELECT source_task_id, list_sort(list(DISTINCT model)) AS ms FROM rp WHERE source_task_id IS NOT NULL AND model IS NOT NULL GROUP BY ALL), {TRAJ}, t AS (SELECT source_task_id, list_sort(list(DISTINCT model)) AS ms FROM traj WHERE source_task_id IS NOT NULL AND model IS NOT NULL GROUP BY ALL) SELECT source_task_id, array_to_string(list_sort(list_intersect(m.ms, t.ms)), ',') AS both, array_to_string(list_sort(list_filter(m.ms, lambda x: NOT list_contains(t.ms, x))), ',') AS only_replies, len(list_distinct(list_concat(m.ms, t.ms))) AS either FROM m JOIN t USING (source_task_id)")
def set_algebra(spark, d):
    """Models seen for a task in replies and in runs."""
    m = replies(spark, d, "source_task_id", "model").where("source_task_id IS NOT NULL AND model IS NOT NULL").groupBy("source_task_id").agg(F.sort_array(F.collect_set("model")).alias("m"))
    t = runs(spark, d).where("source_task_id IS NOT NULL AND model IS NOT NULL").groupBy("source_task_id").agg(F.sort_array(F.collect_set("model")).alias("t"))
    j = m.join(t, "source_task_id")
    return j.select("source_task_id", F.array_join(F.array_sort(F.array_intersect("m", "t")), ",").alias("both"), F.array_join(F.array_sort(F.array_except("m", "t")), ",").alias("only_replies"), F.size(F.array_union("m", "t")).cast("bigint").alias("either"))


@query("SELECT id, copy FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS pos FROM tasks) t, (SELECT CAST(unnest(range(0, 3)) AS INTEGER) AS copy) c WHERE copy * (SELECT count(*) FROM tasks) + pos < 1500")
def cyclic_repeat(spark, d):
    """The tasks in turn up to 1,500 rows."""
    return sel.cyclic(table(spark, d, "tasks").select("id"), ["id"], 1500).select("id", "copy")
