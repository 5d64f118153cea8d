"""Queries of the rules on decisions, episodes and replies, of probes and placebos, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrace.operators import policy, rules, training, windows
from loomtrace.plans.banks import _P, _dist
from loomtrace.plans.records import _ACT, _TRIM, _WHY
from loomtrace.plans.registry import MSG, REPLY, STEP, TRAJ, messages, query, replies, rounded, runs, steps, table

_ELEMENTS = "array<struct<ref:int,tag:string,role:string,name:string,placeholder:string>>"
_JSON = """'{"user_id": "' || run_id || '", "items": [{"order_id": ' || length(coalesce(final_answer, '')) || '}, {"Email": ["' || coalesce(model, '') || '@Mail.example", "B\\"x"]}], "order_id": 2.5, "note": "' || regexp_replace(coalesce(error, ''), '["\\\\\\\\\\n]', '', 'g') || ' #ab12cd call 555-123-4567"}'"""


@query(
    rf"""WITH {TRAJ}, j AS (SELECT run_id, {_JSON} AS t FROM traj),
    v AS (SELECT run_id, list_concat(regexp_extract_all(t, '#[A-Za-z0-9_-]{{4,}}'), regexp_extract_all(t, '\b[A-Z0-9]{{6}}\b'), regexp_extract_all(t, '\b[\w.+-]+@[\w.-]+\.[A-Za-z]{{2,}}\b'), regexp_extract_all(t, '\b\d{{3}}[- ]\d{{3}}[- ]\d{{4}}\b'),
        [json_extract_string(t, '$.user_id'), json_extract_string(t, '$.items[0].order_id'), json_extract_string(t, '$.items[1].Email[0]'), 'B\"x']) AS ids FROM j)
    SELECT run_id, array_to_string(list_sort(list_distinct(list_transform(ids, lambda x: lower(x)))), '|') AS ids FROM v"""
)
def private_identifiers(spark, d):
    """F8: identifiers of a task's JSON by shape and by private key, at any depth."""
    error = F.regexp_replace(F.coalesce("error", F.lit("")), r'["\\\n]', "")
    json = F.concat(
        F.lit('{"user_id": "'), "run_id", F.lit('", "items": [{"order_id": '), F.length(F.coalesce("final_answer", F.lit(""))), F.lit('}, {"Email": ["'), F.coalesce("model", F.lit("")), F.lit('@Mail.example", "B\\"x"]}], "order_id": 2.5, "note": "'), error, F.lit(' #ab12cd call 555-123-4567"}'),
    )
    return runs(spark, d).select("run_id", F.array_join(rules.task_identifiers(json), "|").alias("ids"))


_K = "ascii(right(run_id, 1))"


@query(
    f"""WITH {TRAJ}, c AS (SELECT run_id, CASE {_K} % 5 WHEN 0 THEN 'memory' WHEN 1 THEN 'sft' WHEN 2 THEN 'both' WHEN 3 THEN 'neither' ELSE 'other' END AS route, CASE {_K} % 4 WHEN 0 THEN 'add' WHEN 1 THEN 'refine' WHEN 2 THEN 'replace' ELSE 'drop' END AS op,
        CASE WHEN {_K} % 3 > 0 THEN source_task_id END AS target, source_task_id IN (SELECT id FROM tasks WHERE split = 'train') AS known, final_answer AS content, split AS scope, reward AS confidence, error AS plan, CAST(floor(coalesce(elapsed_seconds, 0)) AS BIGINT) % 8 AS e, lower(split_part(coalesce(final_answer, ''), ' ', 1)) AS word FROM traj),
    w AS (SELECT *, CASE WHEN e = 7 THEN 'missing_evidence_steps' WHEN e > 5 THEN 'invalid_evidence_step' END AS ev, length(word) > 5 AND contains(lower(concat_ws(' ', content, scope)), word) AS leak FROM c),
    r AS (SELECT *, list_filter([CASE WHEN coalesce(content, '') = '' THEN 'missing_content' END, CASE WHEN coalesce(scope, '') = '' THEN 'missing_scope' END, CASE WHEN confidence IS NULL THEN 'invalid_confidence' END, coalesce(ev, CASE WHEN e % 2 = 1 THEN 'no_authoritative_message_in_evidence' END), CASE WHEN leak THEN 'task_identifier_leak:' || word END,
        CASE WHEN op = 'drop' THEN 'invalid_operation' WHEN op <> 'add' AND coalesce(target, '') = '' THEN 'missing_target' WHEN op <> 'add' AND NOT coalesce(known, false) THEN 'unknown_target' WHEN op = 'add' AND coalesce(target, '') <> '' THEN 'add_with_target' END], lambda x: x IS NOT NULL) AS m,
        list_filter([CASE WHEN coalesce(plan, '') = '' THEN 'missing_plan' ELSE ev END], lambda x: x IS NOT NULL) AS s FROM w)
    SELECT run_id, CASE route WHEN 'other' THEN 'invalid_route' WHEN 'memory' THEN array_to_string(m, ',') WHEN 'both' THEN array_to_string(m, ',') END AS memory, CASE route WHEN 'other' THEN 'invalid_route' WHEN 'sft' THEN array_to_string(s, ',') WHEN 'both' THEN array_to_string(s, ',') END AS sft FROM r"""
)
def decision_branches(spark, d):
    """a decision's memory and training branches, each with its own reasons, leaks included."""
    k = F.ascii(F.substring("run_id", -1, 1))
    pick = lambda n, *names: F.element_at(F.array(*[F.lit(x) for x in names]), k % n + 1)
    e = (F.floor(F.coalesce("elapsed_seconds", F.lit(0.0))) % 8).cast("int")
    lit = lambda *x: F.array(*[F.lit(v) for v in x])
    known = table(spark, d, "tasks").where("split = 'train'").select(F.col("id").alias("target_"), F.lit(True).alias("known"))
    r = runs(spark, d).join(known, F.col("source_task_id") == F.col("target_"), "left")
    word = F.lower(F.split_part(F.coalesce("final_answer", F.lit("")), F.lit(" "), F.lit(1)))
    memory, sft = rules.branch_reasons(
        pick(5, "memory", "sft", "both", "neither", "other"), pick(4, "add", "refine", "replace", "drop"), F.when(k % 3 > 0, F.col("source_task_id")), F.col("known"), F.col("final_answer"), F.col("split"), F.col("reward"), F.col("error"),
        F.when(e != 7, F.array(e)), lit(0, 1, 2, 3, 4, 5), lit(0, 2, 4), F.when(F.length(word) > 5, F.array(word)).otherwise(F.array().cast("array<string>")),
    )
    return r.select("run_id", F.array_join(memory, ",").alias("memory"), F.array_join(sft, ",").alias("sft"))


@query(
    f"""WITH {STEP}, f AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY "index") AS rn, {_K} % 4 AS k FROM st),
    g AS (SELECT run_id, k, "index" AS i, rn <= 64 AND action IS NOT NULL AND "index" % 7 <> 6 AS ok FROM f)
    SELECT run_id, CASE WHEN k = 0 THEN 'preserve_recorded' ELSE 'corrected' END AS mode, CASE WHEN k = 0 THEN 0 ELSE count(*) FILTER (ok) END AS n, CASE WHEN k = 0 THEN 0 ELSE count(*) FILTER (ok AND i % 3 = 0) END AS corrected, CASE WHEN k > 0 THEN min(i) FILTER (ok) END AS first, CASE WHEN k = 0 THEN 0 ELSE count(*) FILTER (ok) END AS supporting
    FROM g WHERE k < 3 GROUP BY run_id, k HAVING k = 0 OR count(*) FILTER (ok) > 0"""
)
def normalised_episodes(spark, d):
    """episodes as writers give them, in two modes, with their usable steps."""
    from pyspark.sql import Window as W

    k = F.ascii(F.substring("run_id", -1, 1)) % 4
    s = steps(spark, d, "action").withColumn("rn", F.row_number().over(W.partitionBy("run_id").orderBy("index"))).where(F.col("rn") <= rules.EPISODE_STEPS)
    i = F.col("index")
    none = F.lit(None)
    raw = F.struct(
        F.when((i % 7 != 6) & (i % 2 == 0), i).alias("source_step"), F.when(i % 7 != 6, i).alias("index"), F.when(i % 2 == 0, F.col("action")).alias("target_action"), F.col("action").alias("action"), F.when(i % 3 == 0, "corrected").otherwise(none).alias("label_type"), F.array(i, F.lit(-1), i).alias("supporting_steps"), none.cast("string").alias("rationale"),
    )
    lists = s.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("index", raw.alias("raw")).alias("x")), lambda a, b: a["index"] - b["index"]).alias("xs"))
    mode = F.when(k == 0, "preserve_recorded").when(k == 1, "corrected").when(k == 2, "").otherwise("other")
    e = lists.select("run_id", rules.normalised_episode(mode, F.transform("xs", lambda x: x["raw"])).alias("e")).where("e IS NOT NULL")
    st = F.col("e.steps")
    return e.select(
        "run_id", "e.mode", F.size(st).cast("bigint").alias("n"), F.size(F.filter(st, lambda x: x["label_type"] == "corrected")).cast("bigint").alias("corrected"), F.array_min(F.transform(st, lambda x: x["source_step"])).alias("first"), F.aggregate(st, F.lit(0), lambda a, x: a + F.size(x["supporting_steps"])).cast("bigint").alias("supporting"),
    )


_EP = f"""{_ACT}, {TRAJ}, w AS (SELECT *, {_WHY} AS why, count(*) OVER (PARTITION BY run_id) AS n_run, action IS NOT NULL AS has FROM n),
    e AS (SELECT run_id, ep, "index" AS i, n_run, execution_error, CASE WHEN ep > 1 AND "index" % 5 = 3 AND kind = 'click' THEN 'back' ELSE kind END AS k, CASE WHEN ep > 1 AND "index" % 5 = 3 AND kind = 'click' THEN NULL ELSE why END AS why, ep > 1 AND "index" % 5 = 3 AND kind = 'click' AS changed FROM w, (SELECT unnest([1, 2, 3]) AS ep) x WHERE has AND NOT (ep = 2 AND n_run % 4 = 0 AND "index" = 0)),
    p AS (SELECT run_id, ep, count(*) AS n, any_value(n_run) AS n_run, arg_max(k, i) = 'finish' AS ends, count(*) FILTER (k = 'finish') AS finishes, arg_min(why, i) FILTER (why IS NOT NULL) AS bad, bool_or(changed) AS changed, bool_or(coalesce(execution_error, '') <> '') AS failed FROM e GROUP BY run_id, ep),
    q AS (SELECT p.*, coalesce(success, false) AND NOT failed AS good FROM p LEFT JOIN traj USING (run_id)),
    r AS (SELECT *, CASE WHEN n <> n_run THEN 'incomplete_or_nonconsecutive_episode' WHEN NOT ends THEN 'missing_terminal_finish' WHEN finishes > 1 THEN 'finish_before_terminal_step' WHEN bad IS NOT NULL THEN bad WHEN ep = 1 AND NOT good THEN 'preserve_recorded_requires_successful_error_free_trajectory' END AS why FROM q),
    u AS (SELECT *, why IS NULL AND row_number() OVER (PARTITION BY run_id, changed, why IS NULL, n ORDER BY ep) > 1 AS again FROM r)"""


@query(f"WITH {_EP} SELECT run_id, CAST(ep AS INTEGER) AS episode, CASE WHEN why IS NOT NULL OR again THEN 'rejected' WHEN NOT changed AND good THEN 'accepted' ELSE 'needs_replay' END AS status, coalesce(why, CASE WHEN again THEN 'duplicate_episode' END) AS reason FROM u")
def episode_partition(spark, d):
    """Three episodes of each run (as recorded, corrected, corrected again) parted into accepted, needs_replay and rejected."""
    refs = F.transform(F.filter(F.coalesce("els", F.array().cast(_ELEMENTS)), lambda e: e["ref"].isNotNull()), lambda e: e["ref"].cast("string"))
    s = steps(spark, d, "action", F.col("observation.elements").alias("els"), (F.coalesce("execution_error", F.lit("")) != "").alias("failed")).withColumn("refs", refs).drop("els")
    n = s.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_run"))
    click = (F.col("index") % 5 == 3) & (F.lower(F.coalesce(F.element_at("action", F.lit("action")), F.lit(""))) == "click")
    e = s.where("action IS NOT NULL").join(n, "run_id").select("run_id", "index", "action", "n_run", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("episode"))
    e = e.where(~((F.col("episode") == 2) & (F.col("n_run") % 4 == 0) & (F.col("index") == 0)))
    e = e.select("run_id", "episode", F.when(F.col("episode") == 1, "preserve_recorded").otherwise("corrected").alias("mode"), F.col("index").alias("source_step"), F.when((F.col("episode") > 1) & click, F.create_map(F.lit("action"), F.lit("back"))).otherwise(F.col("action")).alias("action"))
    return rules.episode_partition(e, s, runs(spark, d).select("run_id", "success"))


@query(
    f"""WITH {REPLY}, x AS (SELECT reply_id, {_TRIM.format("coalesce(parsed['answer'], '')")} AS plan, {_TRIM.format("coalesce(parsed['note'], '')")} AS mistake_summary, list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(coalesce(content, ''), '[0-9]+'), lambda v: length(v) <= 6), lambda v: CAST(v AS INTEGER)))) AS e FROM rp)
    SELECT reply_id, plan, mistake_summary, array_to_string(e[1:24], ',') AS evidence FROM x WHERE plan <> ''"""
)
def writer_plans(spark, d):
    """replies as plans with their evidence."""
    g = lambda k: F.element_at("parsed", F.lit(k))
    e = F.transform(F.filter(F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit("([0-9]+)"), F.lit(1)), lambda v: F.length(v) <= 6), lambda v: v.cast("int"))
    r = replies(spark, d, "parsed", "content").select("reply_id", rules.writer_plan(g("answer"), g("note"), e).alias("p")).where("p IS NOT NULL")
    return r.select("reply_id", "p.plan", "p.mistake_summary", F.array_join(F.transform("p.evidence_steps", lambda v: v.cast("string")), ",").alias("evidence"))


@query(
    f"""WITH {STEP}, x AS (SELECT step_id, {_TRIM.format("action['note']")} AS note, lower(coalesce(action['action'], '')) AS kind, "index" AS i FROM st)
    SELECT step_id, CASE WHEN note <> '' AND lower(note) <> 'null' THEN note END AS context, CASE WHEN kind IN ('click', 'fill', 'press', 'scroll', 'back', 'goto', 'finish') THEN i END AS source_step, CASE WHEN kind IN ('click', 'fill', 'press', 'scroll', 'back', 'goto', 'finish') THEN kind END AS kind FROM x"""
)
def legacy_decisions(spark, d):
    """old artifacts in today's form."""
    s = steps(spark, d, "action").select("step_id", rules.legacy_decision(F.element_at("action", F.lit("note")), F.col("index"), F.col("action")).alias("r"))
    return s.select("step_id", "r.*")


@query(f"WITH {TRAJ} SELECT run_id, final_answer AS plan, coalesce(success, false) AS previous_success FROM traj WHERE status = 'complete' AND coalesce(final_answer, '') <> ''")
def sft_candidates(spark, d):
    """completed runs with an answer as candidates for training."""
    r = runs(spark, d)
    return rules.training_candidates(r, F.when(F.col("status") == "complete", "selected"), F.col("final_answer"), F.col("success")).select("run_id", F.col("final_answer").alias("plan"), "previous_success")


@query(f"WITH {TRAJ} SELECT run_id, source_task_id FROM traj WHERE coalesce(success, false)")
def verified_sources(spark, d):
    """the runs whose verifier succeeded."""
    return runs(spark, d).where(F.coalesce("success", F.lit(False))).select("run_id", "source_task_id")


_GRP = f"{TRAJ}, tk AS (SELECT split_part(source_task_id, '_', 1) AS grp, source_task_id AS task, bool_or(coalesce(success, false)) AS ok FROM traj WHERE source_task_id IS NOT NULL GROUP BY ALL)"


def _groups(spark, d):
    r = runs(spark, d).where("source_task_id IS NOT NULL").groupBy(F.col("source_task_id").alias("task")).agg(F.bool_or(F.coalesce("success", F.lit(False))).alias("ok"))
    return r.select(F.split_part("task", F.lit("_"), F.lit(1)).alias("grp"), "task", "ok")


@query(f"WITH {_GRP} SELECT a.grp, a.task, count(b.task) AS probes, min(b.task) AS probe FROM tk a LEFT JOIN tk b ON a.grp = b.grp AND a.task <> b.task AND b.ok GROUP BY ALL")
def same_group_probes(spark, d):
    """For each task the other tasks of its group that succeeded: how many, and the first."""
    return rules.group_probes(_groups(spark, d), "grp", "task", "ok")


@query(f"WITH {_GRP}, u AS (SELECT a.grp, a.task, md5('7|' || a.task) AS h FROM tk a WHERE EXISTS (SELECT 1 FROM tk b WHERE a.grp = b.grp AND a.task <> b.task AND b.ok)) SELECT a.grp, a.task, arg_min(b.task, b.h) AS placebo FROM u a LEFT JOIN u b ON a.grp <> b.grp GROUP BY ALL")
def other_group_placebos(spark, d):
    """For each task with a probe, one usable task of another group."""
    usable = rules.group_probes(_groups(spark, d), "grp", "task", "ok").where("probes > 0").select("grp", "task")
    return rules.placebos(usable, "grp", "task")


_NUM = "list_transform(list_filter(regexp_extract_all(coalesce({}, ''), '[0-9]+'), lambda v: length(v) <= 2), lambda v: CAST(v AS INTEGER))"


@query(
    f"""WITH {REPLY}, x AS (SELECT reply_id, list_concat(list_transform({_NUM.format("prompt")}, lambda v: 'old:' || v), list_transform({_NUM.format("content")}, lambda v: 'new:' || v)) AS b FROM rp),
    k AS (SELECT reply_id, b, list_transform(b, lambda v: split_part(v, ':', 2)) AS s FROM x) SELECT reply_id, array_to_string([b[i] FOR i IN range(1, len(b) + 1) IF list_position(s, s[i]) = i], ',') AS evidence FROM k WHERE len(b) > 0"""
)
def evidence_union(spark, d):
    """Evidence of the prompt and of the reply united by (task, step), the first kept."""
    nums = lambda c: F.transform(F.filter(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("([0-9]+)"), F.lit(1)), lambda v: F.length(v) <= 2), lambda v: v.cast("int"))
    r = replies(spark, d, "prompt", "content").select("reply_id", nums("prompt").alias("p"), nums("content").alias("c")).where(F.size("p") + F.size("c") > 0)
    tag = lambda c, n: F.transform(c, lambda v: F.struct(F.lit("t").alias("task"), v.alias("step"), F.lit(n).alias("from")))
    u = rules.evidence_union(tag("p", "old"), tag("c", "new"))
    return r.select("reply_id", F.array_join(F.transform(u, lambda e: F.concat(e["from"], F.lit(":"), e["step"].cast("string"))), ",").alias("evidence"))


_REFS = "list_transform(list_filter(coalesce(observation.elements, []), lambda e: e.ref IS NOT NULL), lambda e: 'Item ' || e.ref)"


@query(
    f"""WITH {STEP}, x AS (SELECT step_id, lower(coalesce(action['action'], '')) AS kind, action['ref'] AS ref, {_TRIM.format("coalesce(action['text'], '')")} AS q, {_REFS} AS items, len(list_filter(coalesce(observation.elements, []), lambda e: e.tag = 'input')) > 0 AS bar FROM st)
    SELECT step_id, CASE WHEN kind = 'fill' AND bar AND q <> '' THEN 'search[' || q || ']' WHEN kind = 'click' AND list_contains(items, 'Item ' || rtrim(ref)) THEN 'click[Item ' || rtrim(ref) || ']' END AS act FROM x"""
)
def page_grammar(spark, d):
    """The admissible action of a reply of several lines."""
    items = F.transform(F.filter(F.coalesce("els", F.array().cast(_ELEMENTS)), lambda e: e["ref"].isNotNull()), lambda e: F.concat(F.lit("Item "), e["ref"].cast("string")))
    bar = F.exists(F.coalesce("els", F.array().cast(_ELEMENTS)), lambda e: F.coalesce(e["tag"] == "input", F.lit(False)))
    kind = F.lower(F.coalesce(F.element_at("action", F.lit("action")), F.lit("")))
    text = F.regexp_replace(F.coalesce(F.element_at("action", F.lit("text")), F.lit("")), r"[\r\n]", " ")
    reply = F.when(kind == "fill", F.concat(F.lit("I look for it.\nsearch[<your query>]\n  `Search["), text, F.lit("]`"))).when(kind == "click", F.concat(F.lit("click[nothing]\nCLICK[ITEM "), F.coalesce(F.element_at("action", F.lit("ref")), F.lit("-")), F.lit("]"))).otherwise("Nothing to do.")
    return steps(spark, d, "action", F.col("observation.elements").alias("els")).select("step_id", rules.page_action(reply, bar, items).alias("act"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'explore|SELECT ' || doc_id || ' AS n' WHEN doc_id % 3 = 1 THEN 'submit|SELECT n FROM t WHERE n > ' || doc_id END AS command FROM documents")
def sql_commands(spark, d):
    """T4: commands of replies, fenced, in back-ticks, after other lines, or none."""
    k, n = F.col("doc_id") % 3, F.col("doc_id").cast("string")
    reply = F.when(k == 0, F.concat(F.lit("```sql\nEXPLORE:  SELECT "), n, F.lit(" AS n;;\n```"))).when(k == 1, F.concat(F.lit("I know enough now.\n`submit : SELECT n FROM t WHERE n > "), n, F.lit(";`\n"))).otherwise(F.concat(F.lit("To explore SELECT "), n))
    return table(spark, d, "documents").select("doc_id", rules.sql_command(reply).alias("command"))


@query(f"WITH {TRAJ}, f AS (SELECT run_id, {_K} % 3 AS k, reward AS r FROM traj) SELECT run_id, coalesce(CASE k WHEN 0 THEN r * 100 >= 100 WHEN 1 THEN r >= 1 - 1e-9 ELSE r > 0 END, false) AS success, round(coalesce(r, 0), 6) AS reward FROM f")
def score_thresholds(spark, d):
    """Success and reward by the thresholds of three families."""
    k = F.ascii(F.substring("run_id", -1, 1)) % 3
    family = F.when(k == 0, "science").when(k == 1, "shop").otherwise("sql")
    o = rules.score_outcome(family, F.when(k == 0, F.col("reward") * 100).otherwise(F.col("reward")))
    return rounded(runs(spark, d).select("run_id", o.alias("o")).select("run_id", "o.success", "o.reward"), "reward")


@query(
    """WITH t AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents WHERE text IS NOT NULL) SELECT doc_id, md5(array_to_string(CASE WHEN len(w) <= 40 THEN w ELSE list_concat(w[1:3], w[len(w) - 36:len(w)]) END, ' ')) AS kept FROM t"""
)
def trimmed_examples(spark, d):
    """Examples over forty tokens keep their head of three (the system turn) and the tail that fits with it."""
    w = F.split("text", " ")
    t = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", w.alias("w"))
    return t.select("doc_id", F.md5(F.array_join(training.fitting(F.col("w"), F.slice("w", 1, 3), 40), " ")).alias("kept"))


@query(f"WITH {MSG}, s AS (SELECT run_id, sum(CASE WHEN observation IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY \"index\", message_id ROWS UNBOUNDED PRECEDING) AS segment, observation, action FROM ms WHERE \"index\" IS NOT NULL) SELECT run_id, CAST(segment AS BIGINT) AS segment, count(*) AS n, count(*) FILTER (observation IS NULL) AS supervised FROM s WHERE segment > 0 GROUP BY ALL HAVING count(*) FILTER (observation IS NULL) > 0")
def segment_examples(spark, d):
    """One training example for each user turn that has a reply, with how many of its messages are supervised."""
    m = messages(spark, d, F.col("observation").isNotNull().alias("u")).where("index IS NOT NULL")
    return training.segment_examples(training.segments(m, "run_id", ["index", "message_id"], F.col("u")), "run_id", F.col("u"))


@query(
    f"""WITH {_P}, s AS (SELECT p, list_sum(list_transform(p, lambda v: v ** 8)) AS same, list_position(p, list_max(p)) AS top FROM q) SELECT count(*) AS n, round(avg(-list_sum(list_transform(p, lambda v: v * ln(v)))), 6) AS mean_entropy, round(avg(list_max(p)), 6) AS mean_top, round(avg(same), 6) AS mean_same, round(sum(ln(same)), 4) AS log_same,
    {", ".join(f"round(avg(p[{i + 1}]), 6) AS mean_{r}, count(*) FILTER (top = {i + 1}) AS n_{r}" for i, r in enumerate(policy.ROUTES))} FROM s"""
)
def policy_report(spark, d):
    """A18."""
    r = rounded(rules.policy_report(_dist(spark, d), "p", policy.ROUTES, 8), "mean_entropy", "mean_top", "mean_same", *[f"mean_{x}" for x in policy.ROUTES])
    return rounded(r, "log_same", digits=4)


@query(f"WITH {TRAJ}, c AS (SELECT model, run_id, reward, date_trunc('day', started_at) AS b FROM traj WHERE reward IS NOT NULL AND started_at IS NOT NULL AND model IS NOT NULL), h AS (SELECT model, b, lag(max(reward)) OVER (PARTITION BY model ORDER BY b) AS prev FROM c GROUP BY model, b) SELECT run_id, round(reward - coalesce(prev, 0.5), 6) AS gain FROM c JOIN h USING (model, b)")
def chosen_gain(spark, d):
    """Each run's reward less that of the run chosen on its model's day before."""
    c = runs(spark, d).where("reward IS NOT NULL AND started_at IS NOT NULL AND model IS NOT NULL").select("model", "run_id", "reward", F.date_trunc("day", "started_at").alias("b"))
    return rules.chosen_gain(c, "model", "b", "run_id", "reward", 0.5).select("run_id", F.round("gain", 6).alias("gain"))


@query(
    f"""WITH {STEP}, s AS (SELECT run_id, "index", coalesce(length(observation.text), 0) + 1 AS size FROM st), r AS (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY run_id ORDER BY "index") AS i, sum(size) OVER w AS total FROM s WINDOW w AS (PARTITION BY run_id)),
    t AS (SELECT *, least(2 * (n - i), 2 * (i - 1) + 1) AS turn FROM r), u AS (SELECT *, total <= 5000 OR sum(size) OVER (PARTITION BY run_id ORDER BY turn ROWS UNBOUNDED PRECEDING) <= 5000 AS kept FROM t),
    m AS (SELECT run_id, "index" AS at_, "index", NULL AS marker FROM u WHERE kept UNION ALL SELECT run_id, min("index"), NULL, '[... ' || count(*) || ' of ' || any_value(n) || ' steps elided ...]' FROM u WHERE NOT kept GROUP BY run_id)
    SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY at_) - 1 AS INTEGER) AS place, "index", marker FROM m"""
)
def elided_transcript(spark, d):
    """What is left of a run's transcript within 5,000 characters, with the marker where steps were left out."""
    s = steps(spark, d, (F.coalesce(F.length("observation.text"), F.lit(0)) + 1).cast("bigint").alias("size"))
    return rules.elided(windows.two_ended(s, "run_id", "index", F.col("size"), 5000), "run_id", "index").select("run_id", "place", "index", "marker")


@query("WITH m AS (SELECT max(doc_id) AS most FROM documents) SELECT id, printf('mem_%06d', CAST(row_number() OVER (ORDER BY id) + most AS BIGINT)) AS memory_id FROM tasks, m")
def next_memory_ids(spark, d):
    """Ids for new memories after the greatest in the bank."""
    bank = table(spark, d, "documents").select(F.format_string("mem_%06d", "doc_id").alias("id"))
    return rules.next_ids(bank, table(spark, d, "tasks").select("id"), "id")
