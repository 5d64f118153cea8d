"""Queries over ordered rows: budgets, advantages, streaks."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrace.functions.text import verb_key
from loomtrace.operators import selection, windows
from loomtrace.plans.registry import MSG, REPLY, STEP, TRAJ, messages, query, replies, rounded, runs, steps, table

#: The rate of the runs without memory, from which the first margin is measured (25 of 57 tasks).
BASELINE = 25 / 57


@query(f"WITH {TRAJ} SELECT run_id, source_task_id, round(reward - avg(reward) OVER (PARTITION BY source_task_id, model), 6) AS advantage FROM traj WHERE reward IS NOT NULL AND source_task_id IS NOT NULL")
def group_advantage(spark, d):
    """Sums to zero in each group."""
    r = runs(spark, d).where("reward IS NOT NULL AND source_task_id IS NOT NULL")
    return windows.group_advantage(r, ["source_task_id", "model"], "reward").select("run_id", "source_task_id", F.round("advantage", 6).alias("advantage"))


@query(f"WITH {TRAJ}, b AS (SELECT model, row_number() OVER (PARTITION BY model ORDER BY started_at, run_id) - 1 AS i, reward FROM traj WHERE reward IS NOT NULL AND model IS NOT NULL AND started_at IS NOT NULL), g AS (SELECT model, i // 8 AS batch, avg(reward) AS rate FROM b GROUP BY ALL) SELECT model, batch, round(rate, 6) AS rate, round(rate - coalesce(lag(rate) OVER (PARTITION BY model ORDER BY batch), {BASELINE!r}), 6) AS marginal FROM g")
def marginal_reward_lag(spark, d):
    """Batches of eight runs of a model by start."""
    return rounded(windows.marginal(_batches(spark, d), "model", "batch", "rate", BASELINE), "rate", "marginal").select("model", "batch", "rate", "marginal")


def _batches(spark, d):
    r = runs(spark, d).where("reward IS NOT NULL AND model IS NOT NULL AND started_at IS NOT NULL").select("model", "run_id", "started_at", "reward")
    r = selection.ranked(r, "model", ["started_at", "run_id"])
    return r.withColumn("batch", F.floor((F.col("turn") - 1) / 8)).groupBy("model", "batch").agg(F.avg("reward").alias("rate"))


@query(f"WITH {TRAJ}, b AS (SELECT model, row_number() OVER (PARTITION BY model ORDER BY started_at, run_id) - 1 AS i, reward FROM traj WHERE reward IS NOT NULL AND model IS NOT NULL AND started_at IS NOT NULL), g AS (SELECT model, i // 8 AS batch, avg(reward) AS rate FROM b GROUP BY ALL) SELECT model, batch, round(rate - avg(rate) OVER (PARTITION BY batch), 8) AS advantage FROM g")
def batch_index_advantage(spark, d):
    """Against the same batch of the other models."""
    return windows.group_advantage(_batches(spark, d), ["batch"], "rate").select("model", "batch", F.round("advantage", 8).alias("advantage"))


@query(f"WITH {STEP}, s AS (SELECT run_id, \"index\", action['action'] AS act FROM st) SELECT run_id, \"index\", (SELECT coalesce(string_agg(b.act, ',' ORDER BY b.\"index\"), '') FROM s b WHERE b.run_id = a.run_id AND b.\"index\" BETWEEN a.\"index\" - 20 AND a.\"index\" - 1) AS recent FROM s a")
def recent_changes_window(spark, d):
    """The actions of the twenty positions before each step."""
    s = steps(spark, d, F.element_at("action", F.lit("action")).alias("act"))
    r = windows.recent(s, "run_id", "index", F.when(F.col("act").isNotNull(), F.struct("index", "act")))
    return r.select("run_id", "index", F.array_join(F.transform("recent", lambda e: e["act"]), ",").alias("recent"))


@query(f"WITH {STEP} SELECT run_id, \"index\", CAST(row_number() OVER (PARTITION BY run_id ORDER BY \"index\" DESC) AS INTEGER) AS back FROM st QUALIFY back <= 3")
def last_three_history(spark, d):
    """W9."""
    return windows.last_rows(steps(spark, d), "run_id", "index", 3).select("run_id", "index", "back")


@query(f"WITH {MSG} SELECT run_id, message_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY \"index\" DESC, message_id DESC) AS INTEGER) AS back FROM ms WHERE observation IS NOT NULL AND \"index\" IS NOT NULL QUALIFY back <= 2")
def newest_turns(spark, d):
    """The two newest turns of the environment."""
    m = messages(spark, d, F.col("observation").isNotNull().alias("said")).where("said AND index IS NOT NULL").withColumn("at", F.struct("index", "message_id"))
    return windows.last_rows(m, "run_id", "at", 2).select("run_id", "message_id", "back")


@query(f"WITH {STEP}, q AS (SELECT run_id, step_id, \"index\", trim(regexp_replace(lower(action['text']), '\\s+', ' ', 'g')) AS key FROM st WHERE action['text'] IS NOT NULL) SELECT run_id, step_id, CAST(row_number() OVER (PARTITION BY run_id, key ORDER BY \"index\", step_id) AS INTEGER) AS nth FROM q QUALIFY nth > 1")
def repeat_query_detect(spark, d):
    """Texts entered before in the run, but for case and spacing."""
    m = steps(spark, d, F.element_at("action", F.lit("text")).alias("q")).where("q IS NOT NULL").withColumn("at", F.struct("index", "step_id"))
    return windows.repeats(m, "run_id", "at", F.trim(F.regexp_replace(F.lower("q"), r"\s+", " "))).where("nth > 1").select("run_id", "step_id", "nth")


@query(
    f"""WITH {STEP}, s AS (SELECT run_id, "index", coalesce(execution_error, '') <> '' AS bad FROM st), g AS (SELECT *, sum(CASE WHEN NOT bad THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY "index" ROWS UNBOUNDED PRECEDING) AS island FROM s)
    SELECT run_id, "index", CAST(streak AS BIGINT) AS streak FROM (SELECT *, CASE WHEN bad THEN sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, island ORDER BY "index" ROWS UNBOUNDED PRECEDING) ELSE 0 END AS streak FROM g) WHERE streak >= 2"""
)
def consecutive_strikes(spark, d):
    """Second and later failures in a row."""
    s = steps(spark, d, (F.coalesce("execution_error", F.lit("")) != "").alias("failed"))
    return windows.strikes(s, "run_id", "index", F.col("failed"), 3).where("streak >= 2").select("run_id", "index", "streak")


@query(f"WITH {TRAJ}, p AS (SELECT model, run_id, count(*) OVER (PARTITION BY model ORDER BY started_at, run_id ROWS UNBOUNDED PRECEDING) AS size FROM traj WHERE success AND started_at IS NOT NULL AND model IS NOT NULL) SELECT model, run_id, size FROM (SELECT *, coalesce(lag(size) OVER (PARTITION BY model ORDER BY size), 0) AS before FROM p) WHERE size // 8 > before // 8")
def multiple_crossing_trigger(spark, d):
    """Each eighth success of a model."""
    r = runs(spark, d).where("success AND started_at IS NOT NULL AND model IS NOT NULL").select("model", "run_id", "started_at")
    p = selection.ranked(r, "model", ["started_at", "run_id"]).select("model", "run_id", F.col("turn").alias("place"), F.col("turn").alias("size"))
    return windows.crossings(p, "model", "place", "size", 8).select("model", "run_id", "size")


@query(
    """SELECT source, doc_id, CAST(used AS BIGINT) AS used FROM (SELECT source, doc_id, sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING) AS used, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS back FROM documents WHERE text <> '' AND source IS NOT NULL) WHERE used <= 18000 OR back = 1"""
)
def newest_first_budget(spark, d):
    """The newest texts of each source within 18,000 characters."""
    docs = table(spark, d, "documents").where("text <> '' AND source IS NOT NULL").select("source", "doc_id", F.length("text").cast("bigint").alias("size"))
    return windows.newest_first(docs, "source", "doc_id", F.col("size"), 18000).select("source", "doc_id", "used")


@query(
    f"""WITH {STEP}, s AS (SELECT run_id, "index", coalesce(length(observation.text), 0) + 1 AS size FROM st), r AS (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY run_id ORDER BY "index") AS i, sum(size) OVER w AS total FROM s WINDOW w AS (PARTITION BY run_id)),
    t AS (SELECT *, least(2 * (n - i), 2 * (i - 1) + 1) AS turn FROM r), u AS (SELECT *, total <= 5000 OR sum(size) OVER (PARTITION BY run_id ORDER BY turn ROWS UNBOUNDED PRECEDING) <= 5000 AS kept FROM t) SELECT run_id, count(*) FILTER (kept) AS kept, count(*) FILTER (NOT kept) AS dropped FROM u GROUP BY run_id"""
)
def two_ended_elision(spark, d):
    """Whole steps from both ends of a run within 5,000 characters."""
    s = steps(spark, d, (F.coalesce(F.length("observation.text"), F.lit(0)) + 1).cast("bigint").alias("size"))
    e = windows.two_ended(s, "run_id", "index", F.col("size"), 5000)
    return e.groupBy("run_id").agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("dropped"))


_VERB = "CASE WHEN len(w) = 0 THEN act WHEN len(w) >= 2 AND w[1] IN ('look', 'pick', 'put', 'turn') THEN w[1] || ' ' || w[2] ELSE w[1] END"


@query(
    f"""WITH {MSG}, a AS (SELECT run_id, message_id, concat_ws(' ', action['action'], action['target'], action['object']) AS act FROM ms WHERE action['action'] IS NOT NULL), v AS (SELECT *, {_VERB} AS verb FROM (SELECT *, list_filter(regexp_split_to_array(act, '\\s+'), lambda x: x <> '') AS w FROM a)),
    r AS (SELECT *, row_number() OVER (PARTITION BY run_id, verb ORDER BY message_id) AS turn FROM v), u AS (SELECT *, sum(length(act) + 2) OVER (PARTITION BY run_id ORDER BY turn, verb ROWS UNBOUNDED PRECEDING) AS used FROM r) SELECT run_id, message_id, verb, CAST(used AS BIGINT) AS used FROM u WHERE used <= 60"""
)
def round_robin_budget(spark, d):
    """Commands of a run, one of each verb in turn, within 60 characters."""
    g = lambda k: F.element_at("action", F.lit(k))
    m = messages(spark, d, F.concat_ws(" ", g("action"), g("target"), g("object")).alias("act"), g("action").alias("a")).where("a IS NOT NULL")
    return windows.round_robin_budget(m, "run_id", verb_key(F.col("act")), "message_id", (F.length("act") + 2).cast("bigint"), 60).select("run_id", "message_id", "verb", "used")


@query(f"WITH {REPLY}, r AS (SELECT model, reply_id, substr(coalesce(content, ''), 1, 200) AS cell FROM rp WHERE model IS NOT NULL), u AS (SELECT *, row_number() OVER w AS n, sum(length(cell) + 1) OVER w AS used FROM r WINDOW w AS (PARTITION BY model ORDER BY reply_id ROWS UNBOUNDED PRECEDING)) SELECT model, md5(string_agg(cell, chr(10) ORDER BY reply_id)) AS rendered, count(*) AS shown FROM u WHERE n <= 200 AND used <= 6000 GROUP BY model")
def rendered_rows(spark, d):
    """At most 200 rows, 200 characters of a cell, 6,000 in all; the text is given by its digest."""
    from pyspark.sql import Window as W

    w = W.partitionBy("model").orderBy("reply_id").rowsBetween(W.unboundedPreceding, 0)
    r = replies(spark, d, "model", F.substring(F.coalesce("content", F.lit("")), 1, 200).alias("cell")).where("model IS NOT NULL")
    few = r.withColumn("n", F.row_number().over(W.partitionBy("model").orderBy("reply_id"))).where("n <= 200")
    u = few.withColumn("used", F.sum(F.length("cell") + 1).over(w)).where("used <= 6000")
    p = u.groupBy("model").agg(F.array_sort(F.collect_list(F.struct("reply_id", "cell"))).alias("p"), F.count(F.lit(1)).alias("shown"))
    return p.select("model", F.md5(F.array_join(F.transform("p", lambda e: e["cell"]), "\n")).alias("rendered"), "shown")


@query("SELECT user_id, event_id, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events)")
def event_sessions(spark, d):
    """§2.11 addition: sessions by a gap of thirty minutes."""
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    fresh = F.coalesce((F.col("ts") - F.lag("ts").over(w) > F.expr("INTERVAL 30 MINUTE")).cast("int"), F.lit(1))
    e = table(spark, d, "events").select("user_id", "event_id", "ts").withColumn("fresh", fresh)
    return e.select("user_id", "event_id", F.sum("fresh").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("session"))
