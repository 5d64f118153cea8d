"""Queries of memory banks, policy and training examples."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrace.functions.text import RANKING_STOPWORDS, hashed_bag, tokens
from loomtrace.operators import banks, policy, training
from loomtrace.plans.registry import MSG, STEP, TRAJ, messages, query, rounded, runs, steps, table
from loomtrace.plans.retrieval import toks

#: A bank as the documents give it: an entry replaces the one ten positions before in its source when its number divides by three.
_LOG = "lg AS (SELECT doc_id AS id, source AS scope, text AS content, doc_id AS position, CASE WHEN doc_id % 3 = 0 THEN doc_id - 10 END AS supersedes FROM documents), by_ AS (SELECT supersedes AS id, arg_min(id, position) AS superseded_by, min(position) AS superseded_at FROM lg WHERE supersedes IS NOT NULL GROUP BY supersedes)"


def _log(spark, d):
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("id"), F.col("source").alias("scope"), F.col("text").alias("content"), F.col("doc_id").alias("position"), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") - 10).alias("supersedes"))


@query(f"WITH {_LOG} SELECT id, superseded_by FROM lg LEFT JOIN by_ USING (id) WHERE coalesce(content, '') <> ''")
def bank_scd2_active(spark, d):
    """Each entry and what superseded it."""
    return banks.superseded(banks.active_entries(_log(spark, d).withColumn("status", F.lit(None).cast("string"))).unionByName(_log(spark, d).where("coalesce(content, '') = ''").withColumn("status", F.lit(None).cast("string"))), "id", "supersedes", "position").where("coalesce(content, '') <> ''").select("id", "superseded_by")


@query(f"WITH {_LOG} SELECT id FROM lg LEFT JOIN by_ USING (id) WHERE position < 500 AND (superseded_at IS NULL OR superseded_at >= 500)")
def bank_asof(spark, d):
    """The bank as seen at position 500."""
    return banks.as_of(_log(spark, d), "id", "supersedes", "position", F.lit(500)).select("id")


@query(f"WITH {_LOG}, r AS (SELECT id, position, position - 20 AS target FROM lg), s AS (SELECT id AS target, position AS from_, superseded_at FROM lg LEFT JOIN by_ USING (id)) SELECT r.id, target, coalesce(from_ < r.position AND (superseded_at IS NULL OR superseded_at >= r.position), false) AS visible FROM r LEFT JOIN s USING (target)")
def bank_asof_targets(spark, d):
    """Each document's target, the entry twenty positions before, looked up in the bank as of that document's own position."""
    log = _log(spark, d)
    readers = log.select("id", F.col("position").alias("at"), (F.col("position") - 20).alias("target"))
    return banks.targets_as_of(readers, log, "id", "supersedes", "position").select("id", "target", "visible")


_FOLD = f"""WITH RECURSIVE {TRAJ}, o AS (SELECT source_task_id AS chain, run_id AS task, final_answer AS content, coalesce(domain, '') AS scope, [(strpos('0123456789abcdef', substr(md5(run_id), 1, 1)) - 1) % 4][1] AS h, row_number() OVER (PARTITION BY source_task_id ORDER BY started_at, run_id) AS rn
        FROM traj WHERE source_task_id IS NOT NULL AND final_answer IS NOT NULL AND started_at IS NOT NULL),
    f AS (SELECT DISTINCT chain, CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(content VARCHAR, scope VARCHAR, version INTEGER, evidence VARCHAR, n_history INTEGER)[]) AS bank FROM o
        UNION ALL SELECT o.chain, o.rn, CASE WHEN h < 2 THEN CASE WHEN list_contains(list_transform(bank, lambda e: lower(e.content)), lower(o.content)) THEN bank
                ELSE list_append(bank, {{'content': o.content, 'scope': o.scope, 'version': 1, 'evidence': task || ':0', 'n_history': 0}}) END
            WHEN len(bank) = 0 OR (bank[1].content = o.content AND bank[1].scope = o.scope) THEN bank
            ELSE list_concat([{{'content': o.content, 'scope': o.scope, 'version': bank[1].version + 1, 'evidence': CASE WHEN h = 2 THEN bank[1].evidence || ',' || task || ':0' ELSE task || ':0' END, 'n_history': bank[1].n_history + 1}}], bank[2:]) END
        FROM f JOIN o ON o.chain = f.chain AND o.rn = f.rn + 1),
    l AS (SELECT chain, arg_max(bank, rn) AS bank FROM f GROUP BY chain), x AS (SELECT chain, unnest(range(1, len(bank) + 1)) AS i, bank FROM l)
    SELECT chain, printf('mem_%06d', i) AS id, bank[i].content AS content, bank[i].version AS version, bank[i].n_history AS n_history, bank[i].evidence AS evidence FROM x"""


def _operations(spark, d):
    r = runs(spark, d).where("source_task_id IS NOT NULL AND final_answer IS NOT NULL AND started_at IS NOT NULL")
    h = F.conv(F.substring(F.md5("run_id"), 1, 1), 16, 10).cast("int") % 4
    return r.select(
        F.col("source_task_id").alias("chain"), F.concat(F.lpad(F.unix_micros(F.col("started_at").cast("timestamp")).cast("string"), 20, "0"), F.col("run_id")).alias("position"), F.when(h < 2, "add").when(h == 2, "refine").otherwise("replace").alias("op"), F.lit("mem_000001").alias("target"),
        F.col("final_answer").alias("content"), F.coalesce("domain", F.lit("")).alias("scope"), F.col("run_id").alias("task"), F.array(F.lit(0)).alias("evidence"),
    )


def _shown_bank(bank):
    return bank.select("chain", "id", "content", "version", "n_history", F.array_join("evidence", ",").alias("evidence"))


@query(_FOLD)
def bank_fold(spark, d):
    """G1: a versioned bank per task from its runs' answers as operations, an ordered fold."""
    from loomtrace.session import ship

    ship(spark)
    return _shown_bank(banks.fold_operations(_operations(spark, d)))


@query(_FOLD)
def bank_handoff(spark, d):
    """The same bank by two batches of operations, the first one's bank and position handed to the second."""
    from loomtrace.session import cut_lineage, ship

    ship(spark)
    ops = _operations(spark, d)
    middle = ops.groupBy("chain").agg(F.percentile_approx(F.substring("position", 1, 20).cast("bigint"), 0.5).alias("middle"))
    parted = ops.join(middle, "chain").withColumn("early", F.substring("position", 1, 20).cast("bigint") <= F.col("middle"))
    first = cut_lineage(banks.fold_operations(parted.where("early")))
    return _shown_bank(banks.fold_operations(parted.where(~F.col("early")), first))


@query(f"WITH {TRAJ}, c AS (SELECT source_task_id, run_id, coalesce(success, false) AS writes, count(*) OVER (PARTITION BY source_task_id) AS n FROM traj WHERE source_task_id IS NOT NULL), s AS (SELECT *, sum(CASE WHEN writes THEN 1 ELSE 0 END) OVER (PARTITION BY source_task_id ORDER BY run_id ROWS UNBOUNDED PRECEDING) AS slot FROM c) SELECT source_task_id, run_id, CAST(slot AS BIGINT) AS slot, NOT writes OR slot <= greatest(1, ceil(n * 0.3)) AS allowed FROM s")
def chain_budget(spark, d):
    """Writes of a task's chain within three tenths of its runs."""
    from pyspark.sql import Window as W

    r = runs(spark, d).where("source_task_id IS NOT NULL").select("source_task_id", "run_id", F.coalesce("success", F.lit(False)).alias("writes"))
    r = r.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("source_task_id")))
    return banks.within_budget(r, "source_task_id", "run_id", F.col("writes"), banks.capacity(F.col("n"), 0.3, F.lit(True))).select("source_task_id", "run_id", "slot", "allowed")


@query(f"WITH w AS (SELECT doc_id, {toks('text', RANKING_STOPWORDS)} AS ws FROM documents), x AS (SELECT doc_id, len(ws) AS n, list_transform(ws, lambda t: strpos('0123456789abcdef', right(md5(t), 1)) - 1) AS h FROM w) SELECT doc_id, array_to_string(list_transform(range(0, 16), lambda b: CAST(CASE WHEN n = 0 THEN 0 ELSE CAST(round(1000 * len(list_filter(h, lambda y: y = b)) / n) AS BIGINT) END AS VARCHAR)), ',') AS bag FROM x")
def hashed_bow(spark, d):
    """Shares of words by hash, in thousandths."""
    bag = hashed_bag(tokens(F.col("text"), RANKING_STOPWORDS))
    return table(spark, d, "documents").select("doc_id", F.array_join(F.transform(bag, lambda x: F.round(x * 1000).cast("bigint").cast("string")), ",").alias("bag"))


#: Weights of the linear policy that the queries run, a fixed pattern.
_W = [[((i * 7 + j * 13) % 11 - 5) / 10 for j in range(35)] for i in range(4)]
_BAG = "list_transform(range(0, 16), lambda b: CASE WHEN len({0}) = 0 THEN 0.0 ELSE CAST(len(list_filter({0}, lambda t: strpos('0123456789abcdef', right(md5(t), 1)) - 1 = b)) AS DOUBLE) / len({0}) END)"


@query(
    f"""WITH {TRAJ}, w AS (SELECT run_id, success, reward, {toks("final_answer", RANKING_STOPWORDS)} AS a, {toks("instruction", RANKING_STOPWORDS)} AS i FROM traj LEFT JOIN tasks ON id = source_task_id),
    x AS (SELECT run_id, CAST(list_concat([CASE WHEN success THEN 1.0 ELSE 0.0 END, coalesce(reward, 0), 0.2], list_concat({_BAG.format("a")}, {_BAG.format("i")})) AS DOUBLE[]) AS x FROM w),
    z AS (SELECT run_id, [{", ".join(f"list_inner_product(x, CAST({row} AS DOUBLE[]))" for row in _W)}] AS z FROM x),
    e AS (SELECT run_id, list_transform(z, lambda v: exp(v - list_max(z))) AS e FROM z), p AS (SELECT run_id, list_transform(e, lambda v: v / list_sum(e)) AS p FROM e)
    SELECT run_id, ['memory', 'sft', 'both', 'neither'][list_position(p, list_max(p))] AS route, round(-list_sum(list_transform(p, lambda v: v * ln(v))), 6) AS entropy, round(p[1], 6) AS p_memory FROM p"""
)
def policy_features(spark, d):
    """Features, distribution, greatest route and entropy of each run."""
    return rounded(_policy(spark, d).select("run_id", F.col("route"), F.col("h").alias("entropy"), F.element_at("p", 1).alias("p_memory")), "entropy", "p_memory")


def _policy(spark, d):
    x = policy.features(F.col("success"), F.col("reward"), F.lit(4), F.col("final_answer"), F.col("instruction"))
    t = table(spark, d, "tasks").select(F.col("id").alias("source_task_id"), "instruction")
    r = runs(spark, d).join(t, "source_task_id", "left").select("run_id", "success", x.alias("x"))
    z = F.array(*[policy.dot(F.col("x"), F.array(*[F.lit(float(v)) for v in row])) for row in _W])
    r = r.select("run_id", "success", policy.softmax(z).alias("p"))
    names = F.array(*[F.lit(v) for v in policy.ROUTES])
    return r.withColumn("h", policy.entropy(F.col("p"))).withColumn("route", F.element_at(names, policy.argmax(F.col("p")) + 1))


_P = "p AS (SELECT doc_id, list_transform([1, 2, 3, 4], lambda k: exp(((doc_id * k) % 7) / 3.0)) AS e FROM documents), q AS (SELECT doc_id, list_transform(e, lambda v: v / list_sum(e)) AS p FROM p)"


def _dist(spark, d):
    z = F.array(*[((F.col("doc_id") * k) % 7) / F.lit(3.0) for k in (1, 2, 3, 4)])
    return table(spark, d, "documents").select("doc_id", policy.softmax(z).alias("p"))


@query(f"WITH {_P} SELECT doc_id, round(-list_sum(list_transform(p, lambda v: v * ln(v))), 6) AS entropy, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS best FROM q")
def route_entropy(spark, d):
    """Entropy and first greatest of a distribution."""
    return _dist(spark, d).select("doc_id", F.round(policy.entropy(F.col("p")), 6).alias("entropy"), policy.argmax(F.col("p")).alias("best"))


@query(f"WITH {_P}, t AS (SELECT doc_id, list_transform(p, lambda v: exp(ln(greatest(v, 1e-30)) * 0.5)) AS e FROM q) SELECT doc_id, round(e[1] / list_sum(e), 6) AS p0, round(e[4] / list_sum(e), 6) AS p3 FROM t")
def tempered(spark, d):
    """At half the inverse temperature."""
    t = policy.temper(F.col("p"), 0.5)
    return _dist(spark, d).select("doc_id", t.alias("t")).select("doc_id", F.round(F.element_at("t", 1), 6).alias("p0"), F.round(F.element_at("t", 4), 6).alias("p3"))


@query(f"WITH {_P}, t AS (SELECT p, list_transform(p, lambda v: exp(ln(greatest(v, 1e-30)) * 0.5)) AS e FROM q), u AS (SELECT p, list_transform(e, lambda v: v / list_sum(e)) AS r FROM t), m AS (SELECT list_max(list_transform(list_zip(p, r), lambda x: abs(x[1] - x[2]))) AS d FROM u) SELECT round(max(d), 6) AS max_drift, round(avg(d), 6) AS mean_drift FROM m")
def policy_drift(spark, d):
    """A21."""
    b = _dist(spark, d).withColumn("q", policy.temper(F.col("p"), 0.5))
    return rounded(policy.drift(b, "p", "q"), "max_drift", "mean_drift")


_H = "-(q * ln(q) + (1 - q) * ln(1 - q))"


@query(f"WITH {TRAJ}, g AS (SELECT reward - avg(reward) OVER (PARTITION BY model) AS a, 0.25 + CASE WHEN success THEN 0.5 ELSE 0 END AS q FROM traj WHERE reward IS NOT NULL) SELECT round(-sum(a * ln(q)), 4) AS pg_term, round(sum({_H}), 4) AS entropy_sum, round(-sum(a * ln(q)) - 0.01 * sum({_H}), 4) AS loss FROM g")
def grpo_loss(spark, d):
    """Loss scalars over runs, the entropy that of each run's two-way choice."""
    from loomtrace.operators.windows import group_advantage

    r = group_advantage(runs(spark, d).where("reward IS NOT NULL"), ["model"], "reward")
    r = r.withColumn("q", 0.25 + F.when(F.col("success"), 0.5).otherwise(0.0)).withColumn("lp", F.ln("q")).withColumn("h", policy.entropy(F.array(F.col("q"), 1 - F.col("q"))))
    return rounded(policy.loss(r, "advantage", "lp", "h"), "pg_term", "entropy_sum", "loss", digits=4)


@query(f"WITH {MSG} SELECT run_id, CAST(count(*) + 1 AS BIGINT) AS n, md5('system:S' || string_agg(chr(10) || CASE WHEN observation IS NOT NULL THEN 'user' ELSE 'assistant' END || ':' || coalesce(observation, action['action'], ''), '' ORDER BY \"index\", message_id)) AS rendered FROM ms WHERE \"index\" IS NOT NULL GROUP BY run_id")
def sft_messages(spark, d):
    """Message lists of the chats, by digest."""
    m = messages(spark, d, "observation", F.element_at("action", F.lit("action")).alias("act")).where("index IS NOT NULL")
    a = training.assembled(m, "run_id", ["index", "message_id"], training.training_role(F.when(F.col("observation").isNotNull(), "user").otherwise("assistant")), F.coalesce("observation", "act", F.lit("")), "S")
    return a.select("run_id", F.size("messages").cast("bigint").alias("n"), F.md5(F.array_join(F.transform("messages", lambda e: F.concat(e["role"], F.lit(":"), e["content"])), "\n")).alias("rendered"))


@query(f"WITH {MSG} SELECT run_id, message_id, CAST(sum(CASE WHEN observation IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY \"index\", message_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM ms WHERE \"index\" IS NOT NULL")
def segment_turns(spark, d):
    """Segments by user turn."""
    m = messages(spark, d, F.col("observation").isNotNull().alias("u")).where("index IS NOT NULL")
    return training.segments(m, "run_id", ["index", "message_id"], F.col("u")).select("run_id", "message_id", "segment")


@query(
    f"""WITH {STEP}, s AS (SELECT run_id, "index", "index" * 40 AS b, "index" * 40 + 25 AS e FROM st), k AS (SELECT run_id, CAST(unnest(range(0, (max("index") + 1) * 40, 7)) AS BIGINT) AS s FROM st GROUP BY run_id)
    SELECT s.run_id, s."index" AS turn, count(*) AS n, round(sum(CAST(-0.01 AS DOUBLE) * (k.s % 13)), 6) AS total FROM s JOIN k ON k.run_id = s.run_id AND k.s < s.e AND k.s + 7 > s.b GROUP BY ALL"""
)
def span_logprob(spark, d):
    """Log-probabilities of the tokens that overlap each turn's span."""
    st = steps(spark, d)
    spans = st.select("run_id", F.col("index").alias("turn"), (F.col("index") * 40).cast("bigint").alias("begin"), (F.col("index") * 40 + 25).cast("bigint").alias("finish"))
    top = st.groupBy("run_id").agg(F.max("index").alias("m"))
    toks_ = top.select("run_id", F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col("m") + 1) * 40 - 1, F.lit(7).cast("bigint"))).alias("s")).withColumn("e", F.col("s") + 7).withColumn("logp", F.lit(-0.01) * (F.col("s") % 13))
    return training.span_sums(toks_, spans, "run_id").select("run_id", "turn", "n", F.round("total", 6).alias("total"))


@query(
    """WITH w AS (SELECT doc_id, string_split(text, ' ') AS ws FROM documents WHERE text IS NOT NULL), k AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS t FROM w),
    m AS (SELECT *, last_value(CASE WHEN t IN ('the', 'of') THEN t END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM k)
    SELECT doc_id, CAST(count(*) FILTER (t <> 'the' AND mark = 'the') AS BIGINT) AS supervised FROM m GROUP BY doc_id"""
)
def loss_mask(spark, d):
    """Words after a header (`the`) up to the end mark (`of`), which counts too; what lies between an end and the next header doesn't."""
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.size(F.filter(training.loss_mask(F.split("text", " "), "the", "of"), lambda x: x == 1)).cast("bigint").alias("supervised"))


@query("WITH n AS (SELECT id, row_number() OVER (PARTITION BY split_part(id, '_', 1) ORDER BY id) AS n FROM tasks) SELECT id, CASE WHEN n = 1 THEN split_part(id, '_', 1) ELSE split_part(id, '_', 1) || '_' || n END AS fixed FROM n")
def id_repair(spark, d):
    """Prefixes made unique by suffixes."""
    t = table(spark, d, "tasks").select("id", F.split_part("id", F.lit("_"), F.lit(1)).alias("fixed")).withColumn("at", F.col("id"))
    return banks.repaired_ids(t, "fixed", "at").select("id", "fixed")
