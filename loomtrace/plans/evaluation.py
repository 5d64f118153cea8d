"""Queries that compare runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrace.operators import evaluation as ev
from loomtrace.plans.registry import MSG, REPLY, STEP, TRAJ, messages, query, replies, rounded, runs, steps, table

_RATE = "round(count(*) FILTER (status = 'complete' AND success) / nullif(count(*) FILTER (status = 'complete'), 0), 6) AS pass_rate, round(avg(reward) FILTER (status = 'complete'), 6) AS mean_reward"
_COUNTS = "count(*) AS runs, count(*) FILTER (status = 'complete') AS complete, count(*) FILTER (status = 'error') AS errors, count(*) FILTER (status = 'complete' AND success) AS successes"
_OUT = "oc AS (SELECT source_task_id, model, avg(CASE WHEN success THEN 1.0 ELSE 0.0 END) AS outcome FROM traj WHERE status = 'complete' AND source_task_id IS NOT NULL AND success IS NOT NULL GROUP BY ALL)"
_PAIR = "pr AS (SELECT a.source_task_id, a.outcome AS a, b.outcome AS b FROM oc a JOIN oc b USING (source_task_id) WHERE a.model = 'agent-small-a' AND b.model = 'agent-large-a')"
CONTROL, TREATED = "agent-small-a", "agent-large-a"
#: How runs end, and routes.
ENDINGS = ["solved", "wrong_answer", "max_steps", "environment_error", "no_submission", "context_overflow"]


def _pairs(spark, d):
    o = ev.task_outcomes(runs(spark, d).where("status = 'complete'"))
    return ev.paired(o.where(F.col("model") == CONTROL), o.where(F.col("model") == TREATED), "source_task_id")


@query(f"WITH {TRAJ} SELECT model, {_COUNTS}, {_RATE} FROM traj GROUP BY model")
def pass_rate_summary(spark, d):
    """A1."""
    return rounded(ev.summary(runs(spark, d), "model"), "pass_rate", "mean_reward")


@query(f"WITH {TRAJ} SELECT coalesce(split, 'unlabeled') AS bucket, domain, {_COUNTS}, {_RATE} FROM traj GROUP BY ALL")
def pass_rate_by_bucket(spark, d):
    """A2: a null bucket is 'unlabeled'."""
    return rounded(ev.summary(runs(spark, d).withColumn("bucket", F.coalesce("split", F.lit("unlabeled"))), "bucket", "domain"), "pass_rate", "mean_reward")


@query(f"WITH {TRAJ} SELECT domain, status, model, count(*) AS n, CAST(grouping(domain) * 4 + grouping(status) * 2 + grouping(model) AS BIGINT) AS level FROM traj GROUP BY GROUPING SETS ((domain), (status), (model), (domain, status))")
def facet_grouping_sets(spark, d):
    """A10, A3 with grouping sets."""
    runs(spark, d).createOrReplaceTempView("loomtrace_runs")
    return spark.sql("SELECT domain, status, model, count(*) AS n, CAST(grouping(domain) * 4 + grouping(status) * 2 + grouping(model) AS BIGINT) AS level FROM loomtrace_runs GROUP BY GROUPING SETS ((domain), (status), (model), (domain, status))")


@query(
    f"""WITH {TRAJ} SELECT model, 'status' AS facet, status AS value, count(*) AS n FROM traj GROUP BY ALL UNION ALL SELECT model, 'ending', termination_reason, count(*) FROM traj GROUP BY ALL
    UNION ALL SELECT model, 'outcome', CAST(success AS VARCHAR), count(*) FROM traj GROUP BY ALL UNION ALL SELECT model, 'domain', domain, count(*) FROM traj GROUP BY ALL"""
)
def facet_counters(spark, d):
    """A3: several counters in one pass."""
    f = lambda c, n: F.struct(F.lit(n).alias("facet"), F.col(c).cast("string").alias("value"))
    stacked = runs(spark, d).select("model", F.explode(F.array(f("status", "status"), f("termination_reason", "ending"), f("success", "outcome"), f("domain", "domain"))).alias("f"))
    return stacked.groupBy("model", "f.facet", "f.value").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {TRAJ}, v AS (SELECT unnest([{', '.join(map(repr, ENDINGS))}]) AS termination_reason), c AS (SELECT termination_reason, count(*) AS n FROM traj GROUP BY ALL) SELECT v.termination_reason, coalesce(n, 0) AS n FROM v LEFT JOIN c USING (termination_reason)")
def choice_counts_zero_fill(spark, d):
    """A4."""
    return ev.zero_filled(runs(spark, d), "termination_reason", ENDINGS)


@query(f"WITH {TRAJ} SELECT model, count(*) FILTER (success) AS succeeded, count(*) FILTER (NOT success) AS failed, count(*) FILTER (success IS NULL) AS open FROM traj GROUP BY model")
def outcomes_pivot(spark, d):
    """A5."""
    k = F.when(F.col("success"), "succeeded").when(~F.col("success"), "failed").otherwise("open")
    return runs(spark, d).withColumn("k", k).groupBy("model").pivot("k", ["succeeded", "failed", "open"]).count().na.fill(0)


@query(f"WITH {TRAJ}, {_OUT}, {_PAIR} SELECT count(*) AS n, count(*) FILTER ((a >= 0.5) <> (b >= 0.5)) AS flips, round(count(*) FILTER ((a >= 0.5) <> (b >= 0.5)) / count(*), 6) AS flip_rate FROM pr")
def paired_flip_rate(spark, d):
    """A7, J1."""
    return rounded(ev.flips(_pairs(spark, d)), "flip_rate")


@query(
    f"""WITH {TRAJ}, {_OUT}, {_PAIR} SELECT count(*) AS n, count(*) FILTER (b > a) AS helped, count(*) FILTER (b < a) AS hurt, count(*) FILTER (a = b AND a > 0) AS unchanged_positive, count(*) FILTER (a = b AND a <= 0) AS unchanged_zero,
    round(avg(a), 6) AS rate_a, round(avg(b), 6) AS rate_b, round(avg(b) - avg(a), 6) AS delta, round((count(*) FILTER (b > a) - 2 * count(*) FILTER (b < a)) / count(*), 6) AS net FROM pr"""
)
def paired_utility(spark, d):
    """A8."""
    return rounded(ev.utility(_pairs(spark, d)), "rate_a", "rate_b", "delta", "net")


@query(f"WITH {TRAJ}, {_OUT}, a AS (SELECT DISTINCT source_task_id FROM oc WHERE model = '{CONTROL}'), b AS (SELECT DISTINCT source_task_id FROM oc WHERE model = '{TREATED}') SELECT source_task_id, 'a' AS side FROM a ANTI JOIN b USING (source_task_id) UNION ALL SELECT source_task_id, 'b' FROM b ANTI JOIN a USING (source_task_id)")
def only_in_one(spark, d):
    """J2, J7, L13."""
    o = ev.task_outcomes(runs(spark, d).where("status = 'complete'"))
    a, b = (o.where(F.col("model") == m).select("source_task_id").distinct() for m in (CONTROL, TREATED))
    return a.join(b, "source_task_id", "left_anti").withColumn("side", F.lit("a")).unionByName(b.join(a, "source_task_id", "left_anti").withColumn("side", F.lit("b")))


@query(f"WITH {TRAJ}, {_OUT}, c AS (SELECT source_task_id, outcome AS control FROM oc WHERE model = '{CONTROL}') SELECT model, count(*) AS n, round(avg(outcome), 6) AS rate, round(avg(outcome) - avg(control), 6) AS delta FROM oc JOIN c USING (source_task_id) GROUP BY model")
def level_matrix(spark, d):
    """Each level against the control on the tasks both have."""
    o = ev.task_outcomes(runs(spark, d).where("status = 'complete'"))
    c = o.where(F.col("model") == CONTROL).select("source_task_id", F.col("outcome").alias("control"))
    return rounded(o.join(c, "source_task_id").groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.avg("outcome").alias("rate"), (F.avg("outcome") - F.avg("control")).alias("delta")), "rate", "delta")


@query(
    f"""WITH {TRAJ}, {_OUT}, w AS (SELECT t.id, c.outcome AS control, r.outcome AS repair, t.split FROM tasks t LEFT JOIN (SELECT * FROM oc WHERE model = '{CONTROL}') c ON c.source_task_id = t.id LEFT JOIN (SELECT * FROM oc WHERE model = '{TREATED}') r ON r.source_task_id = t.id)
    SELECT split, count(*) AS tasks, count(*) FILTER (control IS NOT NULL AND repair IS NOT NULL) AS scored, count(*) FILTER (control < 0.5) AS failing, count(*) FILTER (control < 0.5 AND repair >= 0.5) AS rescued, count(*) FILTER (control >= 0.5 AND repair < 0.5) AS broken,
    round(count(*) FILTER (control < 0.5 AND repair >= 0.5) / nullif(count(*) FILTER (control < 0.5), 0), 6) AS rescue_rate FROM w GROUP BY split"""
)
def rescue_summary(spark, d):
    """Outcomes not known stay null and count in neither part."""
    o = ev.task_outcomes(runs(spark, d).where("status = 'complete'"))
    side = lambda m, n: o.where(F.col("model") == m).select(F.col("source_task_id").alias("id"), F.col("outcome").alias(n))
    w = table(spark, d, "tasks").select("id", "split").join(side(CONTROL, "control"), "id", "left").join(side(TREATED, "repair"), "id", "left")
    fail, fixed = F.col("control") < 0.5, (F.col("control") < 0.5) & (F.col("repair") >= 0.5)
    return rounded(
        w.groupBy("split").agg(
            F.count(F.lit(1)).alias("tasks"), F.count_if(F.col("control").isNotNull() & F.col("repair").isNotNull()).alias("scored"), F.count_if(fail).alias("failing"), F.count_if(fixed).alias("rescued"), F.count_if((F.col("control") >= 0.5) & (F.col("repair") < 0.5)).alias("broken"),
            F.try_divide(F.count_if(fixed).cast("double"), F.nullif(F.count_if(fail), F.lit(0)).cast("double")).alias("rescue_rate"),
        ),
        "rescue_rate",
    )


@query(f"WITH {TRAJ}, p AS (SELECT source_task_id, min(success) AS lo, max(success) AS hi FROM traj WHERE source_task_id IS NOT NULL AND success IS NOT NULL GROUP BY ALL HAVING count(*) >= 3) SELECT count(*) AS tasks, count(*) FILTER (lo = hi) AS agreeing, round(count(*) FILTER (lo = hi) / nullif(count(*), 0), 6) AS agreement FROM p")
def repeat_agreement(spark, d):
    """A11."""
    return rounded(ev.agreement(runs(spark, d), "source_task_id", 3), "agreement")


@query(f"WITH {TRAJ} SELECT domain, round(avg(reward), 6) AS mean, round(median(reward), 6) AS middle, round(avg(CASE WHEN reward > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive, count(*) FILTER (reward > 0.5) AS wins FROM traj WHERE reward IS NOT NULL GROUP BY domain")
def reward_profile(spark, d):
    """A12."""
    r = runs(spark, d).where("reward IS NOT NULL")
    return rounded(r.groupBy("domain").agg(F.avg("reward").alias("mean"), F.median("reward").alias("middle"), F.avg((F.col("reward") > 0).cast("double")).alias("positive"), F.count_if(F.col("reward") > 0.5).alias("wins")), "mean", "middle", "positive")


@query(f"WITH {TRAJ}, x AS (SELECT reward AS x, elapsed_seconds AS y FROM traj WHERE reward IS NOT NULL AND elapsed_seconds IS NOT NULL) SELECT count(*) AS n, round(CASE WHEN stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END, 6) AS r FROM x")
def reward_correlation(spark, d):
    """A13."""
    return rounded(ev.correlation(runs(spark, d), F.col("reward"), F.col("elapsed_seconds")), "r")


@query(f"WITH {TRAJ} SELECT model, CAST(sum(coalesce(usage.prompt_tokens, 0)) AS BIGINT) AS prompt_tokens, CAST(sum(coalesce(usage.completion_tokens, 0)) AS BIGINT) AS completion_tokens FROM traj GROUP BY model")
def usage_totals(spark, d):
    """A14."""
    t = lambda c: F.sum(F.coalesce(F.col(f"usage.{c}"), F.lit(0))).alias(c)
    return runs(spark, d).groupBy("model").agg(t("prompt_tokens"), t("completion_tokens"))


@query(f"WITH {TRAJ} SELECT source_task_id, count(*) FILTER (success) || '/' || count(*) AS met FROM traj WHERE source_task_id IS NOT NULL GROUP BY ALL")
def component_strings(spark, d):
    """A15."""
    return runs(spark, d).where("source_task_id IS NOT NULL").groupBy("source_task_id").agg(F.concat(F.count_if("success"), F.lit("/"), F.count(F.lit(1))).alias("met"))


@query(f"WITH {REPLY}, x AS (SELECT model, usage.completion_tokens AS t FROM rp WHERE usage.completion_tokens IS NOT NULL) SELECT model, count(*) AS n, min(t) AS least, list_sort(list(t))[len(list(t)) // 2 + 1] AS p50, max(t) AS most FROM x GROUP BY model")
def length_profile(spark, d):
    """The median is the upper one; equal lengths are counted first."""
    x = replies(spark, d, "model", F.col("usage.completion_tokens").alias("t")).where("t IS NOT NULL")
    mid = ev.upper_median_by_counts(x, "model", "t")
    return x.groupBy("model").agg(F.min("t").alias("least"), F.max("t").alias("most")).join(mid, "model").select("model", "n", "least", "p50", "most")


@query(f"WITH {MSG}, s AS (SELECT run_id, string_agg(coalesce(observation, '') || chr(1) || coalesce(action['action'], ''), chr(2) ORDER BY \"index\", message_id) AS seq FROM ms WHERE \"index\" IS NOT NULL GROUP BY run_id) SELECT count(DISTINCT seq) AS sequences, count(*) AS runs FROM s")
def distinct_sequences(spark, d):
    """Sequences are compared by digest."""
    text = F.concat(F.coalesce("observation", F.lit("")), F.lit("\x01"), F.coalesce(F.element_at("action", F.lit("action")), F.lit("")))
    m = messages(spark, d, text.alias("t")).where("index IS NOT NULL")
    s = m.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("index", "message_id", "t"))).alias("p")).select(F.md5(F.array_join(F.transform("p", lambda e: e["t"]), "\x02")).alias("seq"))
    return s.agg(F.countDistinct("seq").alias("sequences"), F.count(F.lit(1)).alias("runs"))


@query(f"WITH {TRAJ} SELECT count(*) FILTER (t.id IS NOT NULL) AS probe, count(*) FILTER (t.id IS NULL) AS held_out, round(avg(CASE WHEN success THEN 1.0 ELSE 0.0 END) FILTER (t.id IS NOT NULL), 6) AS probe_rate, round(avg(CASE WHEN success THEN 1.0 ELSE 0.0 END) FILTER (t.id IS NULL), 6) AS held_out_rate FROM traj LEFT JOIN (SELECT id FROM tasks WHERE split = 'dev') t ON t.id = source_task_id WHERE success IS NOT NULL")
def holdout_rates(spark, d):
    """A19, J6."""
    probe = table(spark, d, "tasks").where("split = 'dev'").select(F.col("id").alias("source_task_id"), F.lit(True).alias("in"))
    r = runs(spark, d).where("success IS NOT NULL").join(probe, "source_task_id", "left")
    y, inside = F.col("success").cast("double"), F.col("in").isNotNull()
    return rounded(r.agg(F.count_if(inside).alias("probe"), F.count_if(~inside).alias("held_out"), F.avg(F.when(inside, y)).alias("probe_rate"), F.avg(F.when(~inside, y)).alias("held_out_rate")), "probe_rate", "held_out_rate")


@query(f"WITH {REPLY}, p AS (SELECT prompt, count(DISTINCT content) AS answers, count(*) AS n FROM rp WHERE prompt IS NOT NULL GROUP BY prompt HAVING count(*) > 1) SELECT n, count(*) AS prompts, count(*) FILTER (answers = 1) AS invariant FROM p GROUP BY n")
def invariance_report(spark, d):
    """How many prompts asked several times got one answer."""
    r = replies(spark, d, F.md5("prompt").alias("p"), F.md5("content").alias("c")).where("p IS NOT NULL")
    return r.groupBy("p").agg(F.countDistinct("c").alias("answers"), F.count(F.lit(1)).alias("n")).where("n > 1").groupBy("n").agg(F.count(F.lit(1)).alias("prompts"), F.count_if(F.col("answers") == 1).alias("invariant"))


@query(
    f"""WITH {TRAJ}, c AS (SELECT unnest(['agent-small-a', 'agent-small-b', 'agent-large-a', 'agent-large-b', 'agent-none']) AS model), s AS (SELECT unnest(['train', 'dev', 'test']) AS split),
    r AS (SELECT model, split, avg(CASE WHEN success THEN 1.0 ELSE 0.0 END) AS rate FROM traj WHERE status = 'complete' AND success IS NOT NULL GROUP BY ALL) SELECT c.model, s.split, coalesce(CAST(round(rate, 4) AS VARCHAR), 'missing') AS shown FROM c CROSS JOIN s LEFT JOIN r ON r.model = c.model AND r.split = s.split"""
)
def grid_report(spark, d):
    """A fixed grid of models and splits; what is missing is shown as missing."""
    grid = spark.createDataFrame([(m, s) for m in ("agent-small-a", "agent-small-b", "agent-large-a", "agent-large-b", "agent-none") for s in ("train", "dev", "test")], "model STRING, split STRING")
    r = runs(spark, d).where("status = 'complete' AND success IS NOT NULL").groupBy("model", "split").agg(F.avg(F.col("success").cast("double")).alias("rate"))
    return F.broadcast(grid).join(r, ["model", "split"], "left").select("model", "split", F.coalesce(F.round("rate", 4).cast("string"), F.lit("missing")).alias("shown"))


@query(f"WITH {TRAJ}, {_OUT}, pool AS (SELECT id FROM tasks WHERE split = 'train') SELECT model, count(*) AS n, round(avg(outcome), 6) AS rate FROM oc ANTI JOIN pool ON oc.source_task_id = pool.id GROUP BY model")
def deleaked_rates(spark, d):
    """Rates on the tasks outside the training pool."""
    pool = table(spark, d, "tasks").where("split = 'train'").select(F.col("id").alias("source_task_id"))
    o = ev.task_outcomes(runs(spark, d).where("status = 'complete'")).join(pool, "source_task_id", "left_anti")
    return rounded(o.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.avg("outcome").alias("rate")), "rate")


@query(f"WITH {MSG} SELECT run_id, substr(sha256(string_agg(action['action'], chr(0) ORDER BY \"index\", message_id)), 1, 16) AS digest FROM ms WHERE action['action'] IS NOT NULL AND \"index\" IS NOT NULL GROUP BY run_id")
def trajectory_digest(spark, d):
    """O11."""
    act = F.element_at("action", F.lit("action"))
    m = messages(spark, d, act.alias("a")).where("a IS NOT NULL AND index IS NOT NULL").withColumn("at", F.struct("index", "message_id"))
    return ev.digest(m, "run_id", "at", F.col("a"))


@query("WITH a AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_acctbal > 0), b AS (SELECT DISTINCT o_custkey AS k FROM orders) SELECT (SELECT count(*) FROM a ANTI JOIN b USING (k)) + (SELECT count(*) FROM b ANTI JOIN a USING (k)) = 0 AS equal, (SELECT count(*) FROM a ANTI JOIN b USING (k)) AS only_a, (SELECT count(*) FROM b ANTI JOIN a USING (k)) AS only_b")
def sql_result_equivalence(spark, d):
    """Two SQL texts and whether their results are the same set."""
    for t in ("customer", "orders"):
        table(spark, d, t).createOrReplaceTempView(f"loomtrace_{t}")
    return ev.same_result(spark.sql("SELECT c_custkey AS k FROM loomtrace_customer WHERE c_acctbal > 0"), spark.sql("SELECT o_custkey AS k FROM loomtrace_orders"))


@query(f"WITH {TRAJ} SELECT source_task_id, model, round(avg(CASE WHEN success THEN 1.0 ELSE 0.0 END), 6) AS outcome FROM traj WHERE status = 'complete' AND source_task_id IS NOT NULL AND success IS NOT NULL GROUP BY ALL")
def outcome_map(spark, d):
    """F26, F23."""
    return rounded(ev.task_outcomes(runs(spark, d).where("status = 'complete'")), "outcome")


@query(f"WITH {STEP}, p AS (SELECT run_id, \"index\", action['action'] AS act FROM st) SELECT coalesce(lower(trim(act)), 'none') AS act, count(*) AS n, count(DISTINCT run_id) AS runs FROM p GROUP BY ALL")
def action_counts(spark, d):
    """A3 over steps."""
    s = steps(spark, d, F.element_at("action", F.lit("action")).alias("act"))
    return s.groupBy(F.coalesce(F.lower(F.trim("act")), F.lit("none")).alias("act")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("run_id").alias("runs"))
