"""Queries that reshape records: normalised operations, prompts, blocks, histories, examples."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrace.functions import text as tx
from loomtrace.operators import banks, validation as va
from loomtrace.plans.registry import MSG, REPLY, STEP, TRAJ, messages, query, replies, runs, steps, table


@query("SELECT split, CASE WHEN count(*) > 0 THEN md5('<memories>' || CAST(to_json(list(struct_pack(id := id, content := instruction) ORDER BY id)) AS VARCHAR) || '</memories>') END AS block FROM (SELECT * FROM tasks WHERE instruction IS NOT NULL QUALIFY row_number() OVER (PARTITION BY split ORDER BY id) <= 5) GROUP BY split")
def rendered_memory_block(spark, d):
    """P10: the first five tasks of each split as a block, by digest."""
    from pyspark.sql import Window as W

    t = table(spark, d, "tasks").where("instruction IS NOT NULL").withColumn("rn", F.row_number().over(W.partitionBy("split").orderBy("id"))).where("rn <= 5")
    e = t.groupBy("split").agg(F.array_sort(F.collect_list(F.struct("id", F.col("instruction").alias("content")))).alias("e"))
    return e.select("split", F.md5(tx.memory_block(F.col("e"))).alias("block"))


@query(f"WITH {MSG}, o AS (SELECT run_id, message_id, observation, row_number() OVER (PARTITION BY run_id ORDER BY \"index\" DESC, message_id DESC) AS back FROM ms WHERE observation IS NOT NULL AND \"index\" IS NOT NULL) SELECT message_id, md5(CASE WHEN back <= 2 THEN observation ELSE split_part(observation, chr(10), 1) END) AS shown FROM o")
def stripped_history(spark, d):
    """Only the two newest observations of a chat keep all their lines, by digest."""
    from pyspark.sql import Window as W

    m = messages(spark, d, "observation").where("observation IS NOT NULL AND index IS NOT NULL")
    back = F.row_number().over(W.partitionBy("run_id").orderBy(F.desc("index"), F.desc("message_id")))
    return m.withColumn("back", back).select("message_id", F.md5(F.when(F.col("back") <= 2, F.col("observation")).otherwise(F.split_part("observation", F.lit("\n"), F.lit(1)))).alias("shown"))


@query(f"WITH {STEP}, e AS (SELECT run_id, \"index\", unnest(list_sort(map_keys(action))) AS part FROM st WHERE action IS NOT NULL) SELECT run_id, part, CAST(row_number() OVER (PARTITION BY run_id ORDER BY \"index\", part) - 1 AS INTEGER) AS place FROM e")
def flattened_steps(spark, d):
    """The parts of a run's actions as one sequence, numbered anew."""
    from pyspark.sql import Window as W

    e = steps(spark, d, "action").where("action IS NOT NULL").select("run_id", "index", F.explode(F.map_keys("action")).alias("part"))
    return e.select("run_id", "part", (F.row_number().over(W.partitionBy("run_id").orderBy("index", "part")) - 1).alias("place"))


@query("SELECT id, lower(concat_ws(' ', instruction, start_url, answer_patterns[1])) AS text FROM tasks")
def catalog_texts(spark, d):
    """P17."""
    return table(spark, d, "tasks").select("id", tx.catalog_text(F.col("instruction"), F.col("start_url"), F.get("answer_patterns", F.lit(0))).alias("text"))


@query(f"WITH {STEP} SELECT run_id, lower(action['action']) AS kind, min(\"index\") AS first FROM st WHERE lower(action['action']) IN ('click', 'fill', 'goto') GROUP BY ALL")
def first_tool_calls(spark, d):
    """the first call of each known kind in a run."""
    s = steps(spark, d, F.element_at("action", F.lit("action")).alias("name"))
    return va.first_calls(s, "run_id", "name", "index", ["click", "fill", "goto"]).select("run_id", F.lower("name").alias("kind"), F.col("index").alias("first"))


@query(
    f"""WITH {STEP}, f AS (SELECT run_id, "index", lower(trim(action['action'])) AS op, action['ref'] AS ref FROM st QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY "index") <= 8)
    SELECT run_id, "index", op, CASE WHEN op IN ('click', 'fill') THEN ref END AS target FROM f WHERE op IN ('click', 'fill', 'press', 'scroll', 'goto', 'finish')"""
)
def normalised_operations(spark, d):
    """at most eight inputs of a run, without idle and unknown ones, a target only where the kind has one."""
    from pyspark.sql import Window as W

    g = lambda k: F.element_at("action", F.lit(k))
    s = steps(spark, d, F.lower(F.trim(g("action"))).alias("op"), g("ref").alias("ref")).withColumn("rn", F.row_number().over(W.partitionBy("run_id").orderBy("index"))).where("rn <= 8")
    return s.where(F.col("op").isin("click", "fill", "press", "scroll", "goto", "finish")).select("run_id", "index", "op", F.when(F.col("op").isin("click", "fill"), F.col("ref")).alias("target"))


@query(
    f"""WITH {TRAJ}, c AS (SELECT run_id, CASE WHEN success IS NULL THEN 'noop' WHEN success THEN 'add' ELSE 'drop' END AS op, final_answer AS content, split AS scope, reward AS confidence, CAST(floor(coalesce(elapsed_seconds, 0)) AS BIGINT) % 7 AS e FROM traj)
    SELECT run_id, CASE WHEN op = 'noop' THEN '' WHEN op <> 'add' THEN 'invalid_operation' ELSE array_to_string(list_filter([CASE WHEN coalesce(content, '') = '' THEN 'missing_content' END, CASE WHEN coalesce(scope, '') = '' THEN 'missing_scope' END, CASE WHEN confidence IS NULL OR confidence < 0 OR confidence > 1 THEN 'invalid_confidence' END,
        CASE WHEN e > 5 OR e < 0 THEN 'invalid_evidence_step' END, CASE WHEN e BETWEEN 0 AND 5 AND e % 2 = 1 THEN 'no_authoritative_message_in_evidence' END], lambda x: x IS NOT NULL), ',') END AS reasons, CASE WHEN lower(trim(termination_reason)) IN ('memory', 'sft', 'both', 'neither') THEN lower(trim(termination_reason)) ELSE 'invalid' END AS route FROM c JOIN traj USING (run_id)"""
)
def candidate_gate(spark, d):
    """each run's answer as a memory candidate, with the rules it breaks."""
    e = (F.floor(F.coalesce("elapsed_seconds", F.lit(0.0))) % 7).cast("int")
    op = F.when(F.col("success").isNull(), "noop").when(F.col("success"), "add").otherwise("drop")
    lit = lambda *x: F.array(*[F.lit(v) for v in x])
    why = va.candidate_reasons(op, F.col("final_answer"), F.col("split"), F.col("reward"), F.array(e), lit(0, 1, 2, 3, 4, 5), lit(0, 2, 4))
    return runs(spark, d).select("run_id", F.array_join(why, ",").alias("reasons"), F.coalesce(va.route_of(F.col("termination_reason")), F.lit("invalid")).alias("route"))


@query(
    """WITH l AS (SELECT doc_id, text, doc_id % 4 AS k, CASE WHEN doc_id % 4 IN (1, 2) THEN doc_id - 7 END AS target FROM documents), o AS (SELECT l.*, t.doc_id IS NOT NULL AS known, CASE k WHEN 0 THEN 'add' WHEN 1 THEN 'refine' WHEN 2 THEN 'replace' ELSE 'noop' END AS op FROM l LEFT JOIN documents t ON t.doc_id = l.target AND coalesce(t.text, '') <> '')
    SELECT doc_id, array_to_string(list_filter([CASE WHEN op = 'noop' THEN 'invalid_operation' END, CASE WHEN coalesce(text, '') = '' THEN 'missing_content' END, CASE WHEN op IN ('refine', 'replace') AND NOT known THEN 'unknown_target' END, CASE WHEN op IN ('refine', 'replace') AND target IS NULL THEN 'missing_target' END, CASE WHEN doc_id % 9 = 0 THEN 'missing_evidence_steps' END], lambda x: x IS NOT NULL), ',') AS reasons FROM o"""
)
def memory_gate(spark, d):
    """Memory operations against the bank."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    k = F.col("doc_id") % 4
    o = docs.withColumn("op", F.when(k == 0, "add").when(k == 1, "refine").when(k == 2, "replace").otherwise("noop")).withColumn("target", F.when(k.isin(1, 2), F.col("doc_id") - 7))
    bank = docs.where("coalesce(text, '') <> ''").select(F.col("doc_id").alias("target"), F.lit(True).alias("known"))
    evidence = F.when(F.col("doc_id") % 9 != 0, F.array(F.lit(0)))
    why = va.memory_reasons(F.col("op"), F.col("target"), F.col("known"), F.col("text"), evidence)
    return o.join(bank, "target", "left").select("doc_id", F.array_join(why, ",").alias("reasons"))


@query(f"WITH {REPLY} SELECT reply_id, starts_with(coalesce(content, ''), prompt) AS served FROM rp WHERE prompt IS NOT NULL")
def served_prefix(spark, d):
    """whether a text starts with what was served."""
    return replies(spark, d, F.startswith(F.coalesce("content", F.lit("")), F.col("prompt")).alias("served"), "prompt").where("prompt IS NOT NULL").select("reply_id", "served")


@query("SELECT id, CASE WHEN len(p) > 1 THEN array_to_string(p[1:len(p) - 1], '::') ELSE p[1] END AS grp, p[len(p)] AS name FROM (SELECT id, string_split(replace(id, '_', '::'), '::') AS p FROM tasks)")
def id_codec(spark, d):
    """T10."""
    p = tx.id_parts(F.replace(F.col("id"), F.lit("_"), F.lit("::")))
    return table(spark, d, "tasks").select("id", p.alias("p")).select("id", F.col("p.group").alias("grp"), F.col("p.name").alias("name"))


@query(f"WITH {MSG} SELECT message_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(string_split(observation, 'Exits:')[-1], '[.\\n]', '', 'g'), ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS exits FROM ms WHERE contains(observation, 'Exits:')")
def listed_exits(spark, d):
    """The items after a marker."""
    m = messages(spark, d, "observation").where("contains(observation, 'Exits:')")
    return m.select("message_id", F.array_join(tx.listed_actions(F.col("observation"), "Exits:"), "|").alias("exits"))


@query(f"WITH {STEP}, s AS (SELECT step_id, lower(action['action']) AS k, coalesce(action['ref'], '') AS ref, coalesce(action['key'], '') AS key, coalesce(action['amount'], '') AS amount, coalesce(action['url'], '') AS url FROM st WHERE lower(action['action']) IN ('click', 'press', 'scroll', 'back', 'goto')) SELECT step_id, CASE k WHEN 'click' THEN 'click(''' || ref || ''')' WHEN 'press' THEN 'press(''' || key || ''')' WHEN 'scroll' THEN 'scroll(' || amount || ')' WHEN 'back' THEN 'go_back()' ELSE CASE WHEN regexp_matches(url, '^https?://(?:localhost|127\\.0\\.0\\.1|[A-Za-z0-9_.-]+\\.example)(?:[:/]|$)') THEN 'goto(''' || url || ''')' END END AS code FROM s")
def action_code(spark, d):
    """T19."""
    s = steps(spark, d, "action").where(F.lower(F.element_at("action", F.lit("action"))).isin("click", "press", "scroll", "back", "goto"))
    return s.select("step_id", tx.action_code(F.col("action")).alias("code"))


@query(f"WITH {TRAJ} SELECT run_id, CASE WHEN coalesce(success, false) THEN '[guidance: an earlier run succeeded]' ELSE '[guidance: an earlier run failed]' END || chr(10) || trim(final_answer) AS block FROM traj WHERE final_answer IS NOT NULL")
def guidance_blocks(spark, d):
    """T20."""
    return runs(spark, d).where("final_answer IS NOT NULL").select("run_id", tx.guidance(F.col("final_answer"), F.col("success")).alias("block"))


@query(f"WITH {TRAJ}, g AS (SELECT source_task_id, avg(reward) FILTER (model = 'agent-large-a') AS a, avg(reward) FILTER (model = 'agent-large-b') AS b, avg(reward) FILTER (model = 'agent-small-a') AS base FROM traj WHERE source_task_id IS NOT NULL GROUP BY ALL) SELECT source_task_id, round(a - base, 6) AS actual, round(b - base, 6) AS placebo, a - base > b - base AS beats FROM g WHERE a IS NOT NULL AND b IS NOT NULL AND base IS NOT NULL")
def proxy_reward(spark, d):
    """A treatment's gain over the base, beside a placebo's."""
    m = lambda n: F.avg(F.when(F.col("model") == n, F.col("reward")))
    g = runs(spark, d).where("source_task_id IS NOT NULL").groupBy("source_task_id").agg(m("agent-large-a").alias("a"), m("agent-large-b").alias("b"), m("agent-small-a").alias("base")).where("a IS NOT NULL AND b IS NOT NULL AND base IS NOT NULL")
    return g.select("source_task_id", F.round(F.col("a") - F.col("base"), 6).alias("actual"), F.round(F.col("b") - F.col("base"), 6).alias("placebo"), (F.col("a") - F.col("base") > F.col("b") - F.col("base")).alias("beats"))


@query(f"WITH {MSG} SELECT run_id, CAST(sum(length(coalesce(observation, action['action'], ''))) AS BIGINT) AS size FROM ms GROUP BY run_id HAVING sum(length(coalesce(observation, action['action'], ''))) <= 400")
def within_length(spark, d):
    """Chats short enough to train on; longer ones are dropped whole."""
    m = messages(spark, d, F.length(F.coalesce("observation", F.element_at("action", F.lit("action")), F.lit(""))).alias("n"))
    return m.groupBy("run_id").agg(F.sum("n").alias("size")).where("size <= 400")


@query()
def merging_bank(spark, d):
    """The memories of each source folded into a bank that merges near-duplicates, texts given by their digests; an ordered fold, so no SQL."""
    from loomtrace.session import ship

    ship(spark)
    t = table(spark, d, "documents").where("text IS NOT NULL AND source IS NOT NULL").select(F.col("source").alias("chain"), F.col("doc_id").alias("position"), F.col("text").alias("content"))
    return banks.fold_merging(t).select("chain", "id", F.md5("content").alias("digest"), "version")
