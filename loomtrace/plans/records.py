"""Queries of the record rules and of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrace.functions import text as tx
from loomtrace.operators import validation as va
from loomtrace.plans.registry import MSG, REPLY, STEP, TRAJ, messages, query, replies, runs, steps, table

_TRIM = "regexp_replace(coalesce({0}, ''), '^\\s+|\\s+$', '', 'g')"


@query(f"WITH {TRAJ} SELECT run_id, coalesce(len(t.answer_patterns) > 0 AND len(list_filter(t.answer_patterns, lambda p: NOT regexp_matches(coalesce(final_answer, ''), '(?i)' || p))) = 0, false) AS matched FROM traj JOIN tasks t ON t.id = source_task_id")
def answer_patterns(spark, d):
    """F1."""
    t = table(spark, d, "tasks").select(F.col("id").alias("source_task_id"), "answer_patterns")
    return runs(spark, d).join(t, "source_task_id").select("run_id", va.all_match(F.col("answer_patterns"), F.col("final_answer")).alias("matched"))


@query(
    f"""WITH {MSG}, m AS (SELECT run_id, list(CASE WHEN observation IS NOT NULL THEN 'user' ELSE 'assistant' END ORDER BY "index", CASE WHEN observation IS NOT NULL THEN 0 ELSE 1 END, message_id) AS rs FROM ms WHERE "index" IS NOT NULL GROUP BY run_id)
    SELECT run_id, CASE WHEN len(rs) < 2 THEN 'too_short' WHEN len(rs) % 2 = 1 THEN 'even_length' WHEN len(list_filter(list_zip(rs, range(len(rs))), lambda x: (x[1] = 'user') <> (x[2] % 2 = 0))) > 0 THEN 'roles_do_not_alternate' ELSE 'ok' END AS why FROM m"""
)
def chat_shape_validation(spark, d):
    """the shape of each chat as a training example."""
    m = messages(spark, d, F.when(F.col("observation").isNotNull(), "user").otherwise("assistant").alias("r")).where("index IS NOT NULL")
    c = m.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("index", (F.col("r") != "user").alias("a"), "message_id", "r"))).alias("p"))
    roles = F.concat(F.array(F.lit("system")), F.transform("p", lambda e: e["r"]))
    why = va.chat_reason(roles, F.transform(roles, lambda r: F.lit("x")))
    return c.select("run_id", F.coalesce(why, F.lit("ok")).alias("why"))


@query(
    f"""WITH {MSG}, m AS (SELECT run_id, lower(trim(role)) AS r, row_number() OVER (PARTITION BY run_id ORDER BY "index", message_id) AS i FROM ms WHERE role IS NOT NULL),
    p AS (SELECT run_id, arg_min(r, i) AS head, count(*) FILTER (r = 'system') AS systems, bool_or(r NOT IN ('system', 'user', 'assistant', 'tool')) AS other, bool_or(r = 'assistant') AS speaks FROM m GROUP BY run_id)
    SELECT run_id, coalesce(CASE WHEN head <> 'system' THEN 'first_not_system' WHEN systems > 1 THEN 'system_twice' WHEN other THEN 'unknown_role' WHEN NOT speaks THEN 'no_assistant' END, 'ok') AS why FROM p"""
)
def tool_chat_roles(spark, d):
    """F16: why a run's roles are no tool chat."""
    m = messages(spark, d, F.lower(F.trim("role")).alias("r")).where("r IS NOT NULL")
    return va.tool_chats(m, "run_id", ["index", "message_id"], "r").select("run_id", F.coalesce("why", F.lit("ok")).alias("why"))


@query(
    r"""WITH x AS (SELECT doc_id, list_concat(regexp_extract_all(t, '#[A-Za-z0-9_-]{4,}'), list_concat(regexp_extract_all(t, '\b[A-Z0-9]{6}\b'), list_concat(regexp_extract_all(t, '\b[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b'), regexp_extract_all(t, '\b\d{3}[- ]\d{3}[- ]\d{4}\b')))) AS ids
        FROM (SELECT doc_id, regexp_replace(text, '[^\x00-\x7f]', ' ', 'g') AS t FROM documents WHERE text IS NOT NULL)) SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(ids, lambda i: lower(i)))), ',') AS ids FROM x WHERE len(ids) > 0"""
)
def identifier_harvest(spark, d):
    """F8: identifiers by their shapes; letters beyond ASCII end a word, in both engines."""
    ascii_ = F.regexp_replace("text", r"[^\x00-\x7f]", " ")
    w = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", tx.identifiers(ascii_).alias("i"))
    return w.where(F.size("i") > 0).select("doc_id", F.array_join("i", ",").alias("ids"))


@query(
    f"""WITH {TRAJ}, t AS (SELECT id, list_distinct(regexp_extract_all(lower(instruction), '[a-z]{{7,}}')) AS ids FROM tasks) SELECT run_id, array_to_string(list_sort(list_filter(ids, lambda i: contains(lower(coalesce(final_answer, '')), i)))[1:5], ',') AS leaked FROM traj JOIN t ON t.id = source_task_id"""
)
def identifier_leak(spark, d):
    """which long words of a task its answer holds, the first five."""
    t = table(spark, d, "tasks").select(F.col("id").alias("source_task_id"), F.array_distinct(F.regexp_extract_all(F.lower("instruction"), F.lit("([a-z]{7,})"), F.lit(1))).alias("ids"))
    return runs(spark, d).join(t, "source_task_id").select("run_id", F.array_join(tx.leaked(F.col("ids"), F.coalesce("final_answer", F.lit(""))), ",").alias("leaked"))


_WHY = f"""CASE WHEN kind NOT IN ('click', 'fill', 'press', 'scroll', 'back', 'goto', 'finish') THEN 'unsupported_action' WHEN needs AND ref IS NULL THEN 'missing_element_identifier' WHEN needs AND NOT list_contains(refs, ref) THEN 'element_not_in_source_observation'
        WHEN kind = 'press' AND ref IS NULL AND NOT has_ref THEN 'missing_element_identifier' WHEN kind = 'fill' AND txt IS NULL THEN 'missing_fill_value' WHEN kind = 'goto' AND {_TRIM.format("url")} = '' THEN 'missing_url' WHEN kind = 'finish' AND {_TRIM.format("ans")} = '' THEN 'missing_answer' END"""
_ACT = f"""{STEP}, s AS (SELECT step_id, run_id, "index", execution_error, lower(coalesce(action['action'], '')) AS kind, action['ref'] AS ref, action['text'] AS txt, action['url'] AS url, action['answer'] AS ans, list_contains(map_keys(action), 'ref') AS has_ref,
        list_transform(list_filter(coalesce(observation.elements, []), lambda e: e.ref IS NOT NULL), lambda e: CAST(e.ref AS VARCHAR)) AS refs, action FROM st),
    n AS (SELECT *, kind IN ('click', 'fill') OR (kind = 'press' AND ref IS NOT NULL) AS needs FROM s)"""


@query(f"WITH {_ACT} SELECT step_id, coalesce({_WHY}, 'ok') AS why FROM n WHERE action IS NOT NULL")
def action_validation(spark, d):
    """whether each action can have come from its observation."""
    s = steps(spark, d, "action", F.col("observation.elements").alias("els")).where("action IS NOT NULL")
    refs = F.transform(F.filter(F.coalesce("els", F.array().cast("array<struct<ref:int,tag:string,role:string,name:string,placeholder:string>>")), lambda e: e["ref"].isNotNull()), lambda e: e["ref"].cast("string"))
    return s.select("step_id", F.coalesce(va.action_reason(F.col("action"), refs), F.lit("ok")).alias("why"))


@query(f"""WITH {STEP}, p AS (SELECT run_id, "index", list_sort(list_filter(map_entries(action), lambda e: e.key NOT IN ('note', 'rationale'))) AS a FROM st WHERE action IS NOT NULL) SELECT p.run_id, p."index", CAST(p.a AS VARCHAR) = CAST(q.a AS VARCHAR) AS same FROM p JOIN p q ON q.run_id = p.run_id AND q."index" = p."index" - 1""")
def actions_equivalent(spark, d):
    """Whether each action repeats the one before but for remarks."""
    s = steps(spark, d, "action").where("action IS NOT NULL")
    q = s.select("run_id", (F.col("index") + 1).alias("index"), F.col("action").alias("before"))
    return s.join(q, ["run_id", "index"]).select("run_id", "index", va.equivalent(F.col("action"), F.col("before")).alias("same"))


@query(
    f"""WITH {TRAJ}, {_ACT}, w AS (SELECT run_id, "index", {_WHY} AS why, kind = 'finish' AS finish, coalesce(execution_error, '') <> '' AS failed FROM n),
    p AS (SELECT run_id, count(*) AS n, min("index") AS lo, max("index") AS hi, arg_max(finish, "index") AS ends, count(*) FILTER (finish) AS finishes, arg_min(why, "index") FILTER (why IS NOT NULL) AS bad, bool_or(failed) AS failed FROM w GROUP BY run_id),
    r AS (SELECT p.run_id, CASE WHEN lo <> 0 OR hi - lo + 1 <> n THEN 'incomplete_or_nonconsecutive_episode' WHEN NOT ends THEN 'missing_terminal_finish' WHEN finishes > 1 THEN 'finish_before_terminal_step' ELSE bad END AS reason, coalesce(success, false) AND NOT failed AS good FROM p LEFT JOIN traj USING (run_id))
    SELECT run_id, CASE WHEN reason IS NOT NULL THEN 'rejected' WHEN good THEN 'accepted' ELSE 'needs_replay' END AS status, reason FROM r"""
)
def episode_status(spark, d):
    """accepted, needs_replay or rejected for each browser run, with the first reason."""
    return va.episode_reasons(table(spark, d, "steps"), runs(spark, d))


@query(f"WITH {TRAJ} SELECT run_id, CASE WHEN coalesce(success, false) AND coalesce(reward, 0) > 0.5 THEN 'both' WHEN coalesce(success, false) THEN 'memory' WHEN coalesce(reward, 0) > 0.5 THEN 'sft' ELSE 'neither' END AS choice FROM traj")
def artifact_choice(spark, d):
    """two conditions as one of four labels."""
    return runs(spark, d).select("run_id", va.choice(F.col("success"), F.col("reward") > 0.5).alias("choice"))


@query(f"WITH {REPLY}, j AS (SELECT reply_id, CASE WHEN json_valid(content) AND content LIKE '{{%' THEN content WHEN json_valid(regexp_extract(content, '(?s)```(?:json)?\\s*(.*?)```', 1)) AND regexp_extract(content, '(?s)```(?:json)?\\s*(.*?)```', 1) LIKE '{{%' THEN regexp_extract(content, '(?s)```(?:json)?\\s*(.*?)```', 1) END AS o FROM rp WHERE content IS NOT NULL) SELECT reply_id, json_extract_string(o, '$.answer') AS answer FROM j WHERE o IS NOT NULL AND json_extract_string(o, '$.answer') IS NOT NULL")
def json_extract(spark, d):
    """The answer in a reply's JSON, raw or fenced."""
    r = replies(spark, d, tx.json_object(F.col("content")).alias("o"))
    return r.select("reply_id", F.get_json_object("o", "$.answer").alias("answer")).where("answer IS NOT NULL")


@query("SELECT doc_id, md5(CASE WHEN length(text) <= 600 THEN text ELSE substr(text, 1, 200) || ' ... ' || right(text, 400) END) AS excerpt, md5(CASE WHEN length(text) <= 600 THEN text ELSE substr(text, 1, 300) || '[' || CAST(length(text) - 600 AS VARCHAR) || ' omitted]' || right(text, 300) END) AS halves FROM documents WHERE text IS NOT NULL")
def head_tail_excerpt(spark, d):
    """Excerpts, given by their digests."""
    t = F.col("text")
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.md5(tx.head_tail(t, 600)).alias("excerpt"), F.md5(tx.half_half(t, 600)).alias("halves"))


@query(f"WITH {STEP}, n AS (SELECT run_id, count(*) AS n FROM st GROUP BY run_id) SELECT step_id, md5(CASE WHEN text IS NULL THEN '' WHEN length(text) <= b THEN text ELSE substr(text, 1, b) END) AS cut FROM (SELECT step_id, observation.text AS text, least(1200, least(42000, greatest(1000, CAST(floor(100000 / n) AS INTEGER)))) AS b FROM st JOIN n USING (run_id))")
def step_projection(spark, d):
    """Each observation within the smaller of 1,200 characters and its run's budget per step, given by its digest."""
    s = steps(spark, d, F.col("observation.text").alias("text"))
    n = s.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    b = F.least(F.lit(1200), tx.step_budget(F.col("n")))
    return s.join(n, "run_id").select("step_id", F.md5(F.coalesce(F.when(F.length("text") <= b, F.col("text")).otherwise(F.substring("text", F.lit(1), b)), F.lit(""))).alias("cut"))


@query(f"WITH {STEP} SELECT run_id, md5(string_agg(coalesce(action['action'], '-') || ':' || coalesce(action['ref'], '-'), ' ' ORDER BY \"index\")) AS shown, CAST(count(*) AS BIGINT) AS n FROM st GROUP BY run_id")
def agent_prompt_steps(spark, d):
    """A run's steps without the page bodies, in order."""
    g = lambda k: F.coalesce(F.element_at("action", F.lit(k)), F.lit("-"))
    s = steps(spark, d, F.concat(g("action"), F.lit(":"), g("ref")).alias("a"))
    return s.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("index", "a"))).alias("p")).select("run_id", F.md5(F.array_join(F.transform("p", lambda e: e["a"]), " ")).alias("shown"), F.size("p").cast("bigint").alias("n"))


@query("SELECT doc_id, substr(regexp_replace(source, '[^A-Za-z0-9._-]+', '_', 'g'), 1, 80) || '-' || substr(sha1(source), 1, 8) AS stem, split_part(source, '_', 1) AS prefix FROM documents WHERE source IS NOT NULL")
def safe_stems(spark, d):
    """T11, T16."""
    return table(spark, d, "documents").where("source IS NOT NULL").select("doc_id", tx.safe_stem(F.col("source")).alias("stem"), tx.group_prefix(F.col("source")).alias("prefix"))


@query(f"WITH {MSG} SELECT message_id, nullif(CASE WHEN lower(trim(role)) = 'null' THEN '' ELSE trim(role) END, '') AS role FROM ms")
def optional_strings(spark, d):
    """F18."""
    return messages(spark, d, "role").select("message_id", tx.optional_string(F.col("role")).alias("role"))


@query(f"WITH {REPLY}, p AS (SELECT reply_id, content AS a, prompt AS b FROM rp WHERE content IS NOT NULL AND prompt IS NOT NULL), n AS (SELECT *, least(length(a), length(b)) AS n FROM p) SELECT reply_id, CAST(CASE WHEN a = b THEN NULL ELSE coalesce(list_filter(range(0, n), lambda i: substr(a, i + 1, 1) <> substr(b, i + 1, 1))[1], n) END AS INTEGER) AS at FROM n")
def divergence_index(spark, d):
    """Where a reply parts from the prompt, whole texts."""
    return replies(spark, d, F.col("content").alias("a"), F.col("prompt").alias("b")).where("a IS NOT NULL AND b IS NOT NULL").select("reply_id", tx.first_divergence(F.col("a"), F.col("b")).alias("at"))


@query("SELECT doc_id, md5(trim(split_part(text || chr(10), '```', 1), ' ' || chr(10) || chr(9) || chr(13))) AS block FROM documents WHERE doc_id % 2 = 0 AND trim(split_part(text || chr(10), '```', 1), ' ' || chr(10) || chr(9) || chr(13)) <> ''")
def code_blocks(spark, d):
    """Fenced code of replies, by digest: every second document's text as a reply's block, the others without a fence."""
    reply = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Here it is:\n```python\n"), "text", F.lit("\n```\nand ```none```"))).otherwise(F.concat(F.lit("No block: "), "text"))
    r = table(spark, d, "documents").select("doc_id", F.trim(tx.code_block(reply), F.lit(" \n\t\r")).alias("c")).where("c <> ''")
    return r.select("doc_id", F.md5("c").alias("block"))


@query(f"WITH {MSG}, a AS (SELECT message_id, run_id, concat_ws(' ', action['action'], action['target']) AS cmd FROM ms WHERE action['action'] IS NOT NULL), v AS (SELECT run_id, lower(cmd) AS k, min(cmd) AS canonical FROM a GROUP BY ALL) SELECT message_id, canonical FROM a JOIN v ON v.run_id = a.run_id AND v.k = lower(a.cmd)")
def admissible_match(spark, d):
    """T5: commands matched to the admissible spelling without regard to case."""
    g = lambda k: F.element_at("action", F.lit(k))
    a = messages(spark, d, F.concat_ws(" ", g("action"), g("target")).alias("cmd"), g("action").alias("x")).where("x IS NOT NULL").withColumn("k", F.lower("cmd"))
    return a.join(a.groupBy("run_id", "k").agg(F.min("cmd").alias("canonical")), ["run_id", "k"]).select("message_id", "canonical")


@query(f"WITH {MSG} SELECT message_id, regexp_matches(lower(concat_ws(' ', action['action'], action['object'])), '^(get|craft|inventory|put|use|take)( .*)?$') AS grammatical FROM ms WHERE action['action'] IS NOT NULL")
def action_grammar(spark, d):
    """Commands that begin with a verb of a fixed list."""
    g = lambda k: F.element_at("action", F.lit(k))
    return messages(spark, d, F.lower(F.concat_ws(" ", g("action"), g("object"))).alias("c"), g("action").alias("x")).where("x IS NOT NULL").select("message_id", F.col("c").rlike(r"^(get|craft|inventory|put|use|take)( .*)?$").alias("grammatical"))


@query()
def closest_hint(spark, d):
    """For each target of a run the targets of that run that are spelled most alike; needs matching blocks, so no SQL."""
    from loomtrace.session import ship

    ship(spark)
    m = messages(spark, d, F.element_at("action", F.lit("target")).alias("t")).where("t IS NOT NULL")
    options = m.groupBy("run_id").agg(F.sort_array(F.collect_set(F.regexp_replace("t", r"\s*\d+$", ""))).alias("options"))
    words = m.select("run_id", "t").distinct().join(options, "run_id")
    return words.select("run_id", "t", F.array_join(tx.closest_hints()(F.col("t"), F.col("options")), ",").alias("hints"))


@query()
def canonical_memo_key(spark, d):
    """SHA-256 of a reply's JSON with sorted keys and without ids."""
    from loomtrace.session import ship

    ship(spark)
    r = replies(spark, d, tx.json_object(F.col("content")).alias("o")).where("o IS NOT NULL")
    return r.select("reply_id", F.sha2(tx.canonical_json("o"), 256).alias("key"))
