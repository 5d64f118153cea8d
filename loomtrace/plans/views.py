"""Views of records for prompts, facets of comparisons and further text rules, with their SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from loomtrace.functions import text as tx
from loomtrace.functions.text import RETRIEVAL_STOPWORDS, tokens, verb_key
from loomtrace.operators import banks, policy, retrieval, rules, selection, windows
from loomtrace.operators import validation as va
from loomtrace.operators import evaluation as ev
from loomtrace.plans.banks import _FOLD, _P, _dist, _operations, _shown_bank
from loomtrace.plans.evaluation import _OUT, _PAIR, CONTROL, TREATED, _pairs
from loomtrace.plans.ordered import _VERB
from loomtrace.plans.registry import MSG, REPLY, SQL, STEP, TRAJ, messages, query, replies, rounded, runs, steps, table
from loomtrace.session import shared_dir, ship, spread

_ELEMENTS = "array<struct<ref:int,tag:string,role:string,name:string,placeholder:string>>"


@query(f"WITH {STEP} SELECT step_id, md5(substr(coalesce(observation.text, ''), 1, 1200)) AS shown, length(coalesce(observation.text, '')) > 1200 AS was_cut FROM st")
def controller_view(spark, d):
    """Observations cut at 1,200 characters (the operator is about that budget)."""
    t = F.coalesce("observation.text", F.lit(""))
    return steps(spark, d, F.md5(F.substring(t, 1, 1200)).alias("shown"), (F.length(t) > 1200).alias("was_cut")).select("step_id", "shown", "was_cut")


@query(f"WITH {STEP}, n AS (SELECT run_id, count(*) AS n FROM st GROUP BY run_id), b AS (SELECT step_id, coalesce(observation.text, '') AS t, least(42000, greatest(1000, 100000 // n)) AS b FROM st JOIN n USING (run_id)) SELECT step_id, CAST(b AS INTEGER) AS budget, md5(substr(t, 1, b)) AS shown FROM b")
def tool_view(spark, d):
    """Observations within a budget for each step that shrinks with the run's steps."""
    s = steps(spark, d, F.coalesce("observation.text", F.lit("")).alias("t"))
    n = s.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    b = tx.step_budget(F.col("n")).cast("int")
    return s.join(n, "run_id").select("step_id", b.alias("budget"), F.md5(F.substring("t", F.lit(1), b)).alias("shown"))


@query(f"WITH {STEP} SELECT step_id, md5(substr(coalesce(observation.text, ''), 1, 4000)) AS shown, len(coalesce(observation.elements, [])[1:60]) AS elements, md5(array_to_string(list_transform(coalesce(observation.elements, [])[1:60], lambda e: coalesce(e.name, '')), '|')) AS names FROM st")
def review_view(spark, d):
    """Observations cut at 4,000 characters and 60 elements."""
    first = F.slice(F.coalesce("observation.elements", F.array().cast(_ELEMENTS)), 1, 60)
    s = steps(spark, d, F.md5(F.substring(F.coalesce("observation.text", F.lit("")), 1, 4000)).alias("shown"), F.size(first).cast("bigint").alias("elements"), F.md5(F.array_join(F.transform(first, lambda e: F.coalesce(e["name"], F.lit(""))), "|")).alias("names"))
    return s.select("step_id", "shown", "elements", "names")


@query(f"WITH {REPLY} SELECT reply_id, md5(substr(reasoning, 1, 2500)) AS shown FROM rp WHERE reasoning IS NOT NULL")
def reasoning_view(spark, d):
    """Reasoning cut at 2,500 characters."""
    return replies(spark, d, F.md5(F.substring("reasoning", 1, 2500)).alias("shown")).where("shown IS NOT NULL")


@query(f"""WITH {STEP} SELECT step_id, '{{"index":' || "index" || CASE WHEN action['action'] IS NOT NULL AND regexp_full_match(action['action'], '[A-Za-z_]+') THEN ',"action":"' || action['action'] || '"' ELSE '' END || CASE WHEN regexp_full_match(action['ref'], '[0-9]+') THEN ',"ref":"' || action['ref'] || '"' ELSE '' END || '}}' AS step FROM st""")
def agent_prompt_json(spark, d):
    """Steps without the page, as JSON that leaves out what is null."""
    g = lambda k, shape: F.when(F.element_at("action", F.lit(k)).rlike(f"^(?:{shape})$"), F.element_at("action", F.lit(k))).alias(k)
    return steps(spark, d, g("action", "[A-Za-z_]+"), g("ref", "[0-9]+")).select("step_id", F.to_json(F.struct("index", "action", "ref")).alias("step"))


@query(f"WITH {TRAJ}, {_OUT}, {_PAIR} SELECT source_task_id, CASE WHEN b >= 0.5 THEN 'gained' ELSE 'lost' END AS direction FROM pr WHERE (a >= 0.5) <> (b >= 0.5)")
def flipped_tasks(spark, d):
    """The tasks whose outcome flipped, one row each."""
    p = _pairs(spark, d)
    return p.where((F.col("a") >= 0.5) != (F.col("b") >= 0.5)).select("source_task_id", F.when(F.col("b") >= 0.5, "gained").otherwise("lost").alias("direction"))


@query(f"WITH {TRAJ}, t AS (SELECT model, source_task_id, stddev_pop(CASE WHEN success THEN 1.0 ELSE 0.0 END) AS s FROM traj WHERE status = 'complete' AND success IS NOT NULL AND source_task_id IS NOT NULL GROUP BY ALL HAVING count(*) >= 2) SELECT model, count(*) AS tasks, round(avg(s), 6) AS noise FROM t GROUP BY model")
def replicate_noise(spark, d):
    """How much repeats of a task differ, by model."""
    r = runs(spark, d).where("status = 'complete' AND success IS NOT NULL AND source_task_id IS NOT NULL")
    t = r.groupBy("model", "source_task_id").agg(F.stddev_pop(F.col("success").cast("double")).alias("s"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    return rounded(t.groupBy("model").agg(F.count(F.lit(1)).alias("tasks"), F.avg("s").alias("noise")), "noise")


@query(
    f"""WITH {TRAJ}, {_OUT}, c AS (SELECT source_task_id AS id, min(termination_reason) AS ending FROM traj WHERE status = 'complete' AND model = '{CONTROL}' GROUP BY ALL),
    w AS (SELECT t.id, t.split, c.ending, a.outcome AS control, b.outcome AS repair FROM tasks t JOIN c USING (id) JOIN (SELECT * FROM oc WHERE model = '{CONTROL}') a ON a.source_task_id = t.id LEFT JOIN (SELECT * FROM oc WHERE model = '{TREATED}') b ON b.source_task_id = t.id WHERE a.outcome < 0.5)
    SELECT CASE WHEN grouping(split) = 0 THEN 'split' ELSE 'ending' END AS facet, CASE WHEN grouping(split) = 0 THEN split ELSE ending END AS value, count(*) AS failing, count(*) FILTER (repair >= 0.5) AS rescued, round(count(*) FILTER (repair >= 0.5) / count(*), 6) AS rate FROM w GROUP BY GROUPING SETS ((split), (ending))"""
)
def rescue_facets(spark, d):
    """A10: of the tasks that fail in control, how many the repair rescues, by split and by how control ended; one pass for both facets."""
    r = runs(spark, d).where("status = 'complete'")
    o = ev.task_outcomes(r)
    side = lambda m, n: o.where(F.col("model") == m).select(F.col("source_task_id").alias("id"), F.col("outcome").alias(n))
    ending = r.where(F.col("model") == CONTROL).groupBy(F.col("source_task_id").alias("id")).agg(F.min("termination_reason").alias("ending"))
    w = table(spark, d, "tasks").select("id", "split").join(ending, "id").join(side(CONTROL, "control"), "id").join(side(TREATED, "repair"), "id", "left").where("control < 0.5")
    f = F.explode(F.array(F.struct(F.lit("split").alias("facet"), F.col("split").alias("value")), F.struct(F.lit("ending").alias("facet"), F.col("ending").alias("value"))))
    fixed = F.count_if(F.col("repair") >= 0.5)
    return rounded(w.select("repair", f.alias("f")).groupBy("f.facet", "f.value").agg(F.count(F.lit(1)).alias("failing"), fixed.alias("rescued"), (fixed / F.count(F.lit(1))).alias("rate")), "rate")


@query(f"WITH {TRAJ}, r AS (SELECT source_task_id, success, row_number() OVER (PARTITION BY source_task_id ORDER BY run_id) AS repeat FROM traj WHERE source_task_id IS NOT NULL AND success IS NOT NULL), t AS (SELECT source_task_id FROM r GROUP BY ALL HAVING count(*) >= 3) SELECT CAST(repeat AS BIGINT) AS repeat, count(*) AS tasks, round(avg(CASE WHEN success THEN 1.0 ELSE 0.0 END), 6) AS rate FROM r JOIN t USING (source_task_id) WHERE repeat <= 3 GROUP BY repeat")
def repeat_rates(spark, d):
    """The rate of the first, second and third repeat over the tasks that have all three."""
    r = runs(spark, d).where("source_task_id IS NOT NULL AND success IS NOT NULL").select("source_task_id", "run_id", "success")
    p = selection.ranked(r, "source_task_id", ["run_id"]).where("n >= 3 AND turn <= 3")
    return rounded(p.groupBy(F.col("turn").alias("repeat")).agg(F.count(F.lit(1)).alias("tasks"), F.avg(F.col("success").cast("double")).alias("rate")), "rate")


@query(f"WITH {TRAJ} SELECT source_task_id, count(*) AS repeats, count(*) FILTER (success) AS successes FROM traj WHERE source_task_id IS NOT NULL AND success IS NOT NULL GROUP BY ALL HAVING count(*) >= 3 AND min(success) <> max(success)")
def flipping_tasks(spark, d):
    """The tasks whose repeats disagree."""
    r = runs(spark, d).where("source_task_id IS NOT NULL AND success IS NOT NULL")
    t = r.groupBy("source_task_id").agg(F.count(F.lit(1)).alias("repeats"), F.count_if("success").alias("successes"))
    return t.where("repeats >= 3 AND successes > 0 AND successes < repeats")


@query(f"WITH {TRAJ} SELECT model, count(*) FILTER (success) AS verified, count(*) FILTER (termination_reason = 'solved') AS replayed, round(count(*) FILTER (success) / nullif(count(*) FILTER (termination_reason = 'solved'), 0), 6) AS yield FROM traj WHERE status = 'complete' GROUP BY model")
def repair_yield(spark, d):
    """Verified by replayed, null where nothing was replayed."""
    ok, all_ = F.count_if("success"), F.count_if(F.col("termination_reason") == "solved")
    y = F.try_divide(ok.cast("double"), F.nullif(all_, F.lit(0)).cast("double"))
    return rounded(runs(spark, d).where("status = 'complete'").groupBy("model").agg(ok.alias("verified"), all_.alias("replayed"), y.alias("yield")), "yield")


@query(f"WITH {REPLY}, f AS (SELECT reply_id, prompt, content, first_value(content) OVER (PARTITION BY prompt ORDER BY reply_id) AS a, row_number() OVER (PARTITION BY prompt ORDER BY reply_id) - 1 AS round FROM rp WHERE prompt IS NOT NULL AND content IS NOT NULL) SELECT reply_id, CAST(round AS INTEGER) AS round, CAST(CASE WHEN a = content THEN NULL ELSE coalesce(list_filter(range(0, least(length(a), length(content))), lambda i: substr(a, i + 1, 1) <> substr(content, i + 1, 1))[1], least(length(a), length(content))) END AS INTEGER) AS at FROM f WHERE round > 0")
def divergence_rounds(spark, d):
    """Where each repeat of a prompt parts from the first answer to it."""
    from pyspark.sql import Window as W

    r = replies(spark, d, F.md5("prompt").alias("p"), "content").where("p IS NOT NULL AND content IS NOT NULL")
    n = r.withColumn("round", F.row_number().over(W.partitionBy("p").orderBy("reply_id")) - 1)
    first = n.where("round = 0").select("p", F.col("content").alias("a"))
    return n.where("round > 0").join(first, "p").select("reply_id", "round", tx.first_divergence(F.col("a"), F.col("content")).alias("at"))


@query("WITH l AS (SELECT doc_id, doc_id % 40 + 1 AS level FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY md5(concat_ws('|', '7', CAST(doc_id AS VARCHAR)))) AS turn, count(*) OVER (PARTITION BY level) AS n FROM l) SELECT doc_id, level, CASE WHEN turn <= 0.7 * n THEN 'train' ELSE 'test' END AS part, level > 30 AS deep FROM r")
def depth_split(spark, d):
    """Disjoint parts of each depth by hash order, and the whole of the deep ones marked as a set of its own."""
    t = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 40 + 1).alias("level")).withColumn("h", selection.hash_order(F.lit("7"), F.col("doc_id").cast("string")))
    r = selection.ranked(t, "level", ["h"])
    return r.select("doc_id", "level", F.when(F.col("turn") <= 0.7 * F.col("n"), "train").otherwise("test").alias("part"), (F.col("level") > 30).alias("deep"))


@query(
    f"""WITH {MSG}, a AS (SELECT run_id, message_id, concat_ws(' ', action['action'], action['target'], action['object']) AS act FROM ms WHERE action['action'] IS NOT NULL), v AS (SELECT *, {_VERB} AS verb FROM (SELECT *, list_filter(regexp_split_to_array(act, '\\s+'), lambda x: x <> '') AS w FROM a)),
    r AS (SELECT *, row_number() OVER (PARTITION BY run_id, verb ORDER BY message_id) AS turn FROM v), u AS (SELECT *, sum(length(act) + 2) OVER (PARTITION BY run_id ORDER BY turn, verb ROWS UNBOUNDED PRECEDING) AS used FROM r), t AS (SELECT run_id, max(used) AS taken FROM u WHERE used <= 60 GROUP BY run_id),
    s AS (SELECT ms.run_id, message_id, CAST(sum(coalesce(length(observation), 0) % 50 + 1) OVER (PARTITION BY ms.run_id ORDER BY message_id ROWS UNBOUNDED PRECEDING) + coalesce(taken, 0) AS BIGINT) AS used FROM ms LEFT JOIN t ON t.run_id = ms.run_id WHERE observation IS NOT NULL) SELECT * FROM s WHERE used <= 200"""
)
def second_pool(spark, d):
    """A second pool of messages in what the commands of a run have left of the budget."""
    g = lambda k: F.element_at("action", F.lit(k))
    m = messages(spark, d, "observation", F.concat_ws(" ", g("action"), g("target"), g("object")).alias("act"), g("action").alias("a"))
    first = windows.round_robin_budget(m.where("a IS NOT NULL"), "run_id", verb_key(F.col("act")), "message_id", (F.length("act") + 2).cast("bigint"), 60)
    rest = m.where("observation IS NOT NULL").select("run_id", "message_id", (F.length("observation") % 50 + 1).cast("bigint").alias("size"))
    return windows.second_pool(first, rest, "run_id", "message_id", F.col("size"), 200).select("run_id", "message_id", "used")


@query(f"WITH {REPLY}, x AS (SELECT reply_id, list_concat(regexp_extract_all(coalesce(prompt, ''), '[0-9]+'), regexp_extract_all(coalesce(content, ''), '[0-9]+')) AS b FROM rp) SELECT reply_id, array_to_string([b[i] FOR i IN range(1, len(b) + 1) IF list_position(b, b[i]) = i], ',') AS numbers FROM x WHERE len(b) > 0")
def ordered_union(spark, d):
    """The numbers of prompt and reply, in the order in which they are first seen."""
    n = lambda c: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("([0-9]+)"), F.lit(1))
    return replies(spark, d, F.array_union(n("prompt"), n("content")).alias("u")).where(F.size("u") > 0).select("reply_id", F.array_join("u", ",").alias("numbers"))


@query(f"WITH {_P} SELECT doc_id, CAST(least(len(list_filter(range(1, 5), lambda k: list_sum(p[1:k]) <= (doc_id % 100) / 100.0)), 3) AS INTEGER) AS route FROM q")
def sampled_routes(spark, d):
    """Routes drawn by inverse distribution from a number of each document."""
    return _dist(spark, d).select("doc_id", policy.sampled(F.col("p"), (F.col("doc_id") % 100) / F.lit(100.0)).cast("int").alias("route"))


@query(f"WITH {STEP}, x AS (SELECT step_id, action['ref'] AS ref, list_transform(list_filter(coalesce(observation.elements, []), lambda e: e.ref IS NOT NULL), lambda e: 'Open ' || e.ref) AS items FROM st) SELECT step_id, CASE WHEN list_contains(items, 'Open ' || rtrim(ref)) THEN 'Open ' || rtrim(ref) END AS command FROM x")
def admissible_commands(spark, d):
    """T5: the admissible command in a reply of several lines, in the list's spelling."""
    items = F.transform(F.filter(F.coalesce("els", F.array().cast(_ELEMENTS)), lambda e: e["ref"].isNotNull()), lambda e: F.concat(F.lit("Open "), e["ref"].cast("string")))
    reply = F.concat(F.lit("I think I should\n  `OPEN "), F.coalesce(F.element_at("action", F.lit("ref")), F.lit("-")), F.lit("`\nnow"))
    return steps(spark, d, "action", F.col("observation.elements").alias("els")).select("step_id", rules.admissible_command(reply, items).alias("command"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'craft ' || doc_id || ' plank using 1 log' WHEN 1 THEN 'Get ' || doc_id || ' log' WHEN 2 THEN 'inventory' END AS command FROM documents")
def crafting_commands(spark, d):
    """Crafting commands by their three forms."""
    k, n = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    reply = F.when(k == 0, F.concat(F.lit("I need planks.\nAction: craft "), n, F.lit(" plank using 1 log\n"))).when(k == 1, F.concat(F.lit("```\nGet "), n, F.lit(" log\n```"))).when(k == 2, F.lit("`inventory`")).otherwise(F.concat(F.lit("get some logs\ncraft plank "), n))
    return table(spark, d, "documents").select("doc_id", rules.crafting_command(reply).alias("command"))


@query(SQL["bm25_topk"])
def bm25_by_index(spark, d):
    """K8, O1: the same from the index as it is kept in the shared folder."""
    from loomtrace.sources.files import write_index

    ship(spark)
    path = f"{shared_dir(spark).rstrip('/')}/index-{hashlib.md5(d.encode()).hexdigest()}"
    docs = spread(table(spark, d, "documents"))
    write_index(docs, "doc_id", tokens(F.concat_ws(" ", "source", "source", "text"), RETRIEVAL_STOPWORDS), path)
    s = retrieval.bm25_from_index(table(spark, d, "tasks"), "id", tokens(F.col("instruction"), RETRIEVAL_STOPWORDS), path, "doc_id")
    return retrieval.top_k(s, "id", "doc_id", 3).select("id", "doc_id", F.round("score", 6).alias("score"), "rank")


_BUDGET = _FOLD.replace("    f AS (SELECT DISTINCT chain", "    o_ AS (SELECT *, count(*) OVER (PARTITION BY chain) AS n FROM o), o2 AS (SELECT * FROM o_ WHERE rn <= greatest(1, ceil(n * 0.3))),\n    f AS (SELECT DISTINCT chain").replace("FROM f JOIN o ON", "FROM f JOIN o2 o ON")


@query(_BUDGET)
def budgeted_bank(spark, d):
    """The bank of a chain whose writes beyond three tenths of its operations are turned down."""
    ship(spark)
    ops = _operations(spark, d)
    n = ops.groupBy("chain").agg(F.count(F.lit(1)).alias("n"))
    w = banks.within_budget(ops.join(n, "chain"), "chain", "position", F.lit(True), banks.capacity(F.col("n"), 0.3, F.lit(True)))
    return _shown_bank(banks.fold_operations(w.where("allowed").drop("n", "slot", "allowed")))


@query(
    f"""WITH {STEP}, x AS (SELECT run_id, "index" AS i, trim(coalesce(observation.text, '')) = '' AS blank, lower(coalesce(action['action'], '')) AS k FROM st),
    p AS (SELECT run_id, bool_or(blank) AS blank, bool_or(k NOT IN ('click', 'fill', 'press', 'scroll', 'back', 'goto', 'finish')) AS other, arg_max(k, i) = 'finish' AS ends, count(*) FILTER (k = 'finish') AS finishes FROM x GROUP BY run_id)
    SELECT run_id, coalesce(CASE WHEN blank THEN 'blank_content' WHEN other THEN 'invalid_action_target' WHEN NOT ends THEN 'missing_terminal_finish' WHEN finishes > 1 THEN 'finish_before_terminal_step' END, 'ok') AS why FROM p"""
)
def action_chat_validation(spark, d):
    """browser runs as training chats whose answers are JSON actions."""
    s = steps(spark, d, F.col("observation.text").alias("shown"), F.lower(F.coalesce(F.element_at("action", F.lit("action")), F.lit(""))).alias("kind"))
    return va.action_chats(s, "run_id", "index", F.col("shown"), F.col("kind")).select("run_id", F.coalesce("why", F.lit("ok")).alias("why"))


@query(f"WITH {STEP}, e AS (SELECT run_id, \"index\" AS i, unnest(range(1, len(observation.elements) + 1)) AS k, unnest(observation.elements) AS e FROM st WHERE observation.elements IS NOT NULL) SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY i, k) - 1 AS BIGINT) AS place, e.ref AS ref FROM e")
def flattened_elements(spark, d):
    """The lists that are nested in a run's steps as one sequence, numbered anew, for runs of any length."""
    e = steps(spark, d, F.col("observation.elements").alias("els")).where("els IS NOT NULL").select("run_id", "index", F.posexplode("els").alias("k", "e")).select("run_id", "index", "k", F.col("e.ref").alias("ref"))
    return selection.ranked(e, "run_id", ["index", "k"]).select("run_id", (F.col("turn") - 1).alias("place"), "ref")
