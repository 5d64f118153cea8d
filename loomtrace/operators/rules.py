"""Rules on what a writer proposes: identifiers, decisions by branch, episodes, grammars of replies, probes and placebos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtrace.functions.text import folded, identifiers, leaked, optional_string, stripped
from loomtrace.operators.selection import hash_order, positions
from loomtrace.operators.validation import ACTIONS, action_reason, equivalent, first_reason, reasons

#: Keys whose values identify a person or an order.
PRIVATE_KEYS = ("user_id", "customer_id", "reservation_id", "order_id", "phone_number", "email")
#: Fixed value: how many steps of an episode are read.
EPISODE_STEPS = 64
#: Fixed value: how many evidence steps a plan keeps.
PLAN_EVIDENCE = 24

_SCALAR = r'"((?:[^"\\]|\\.)*)"|(-?\d+)(?![.\deE])'


def private_values(json: Column) -> Column:
    """F8: strings and whole numbers under PRIVATE_KEYS anywhere in a JSON text, alone or in a list, whatever the depth; lower case, sorted."""
    keys = "|".join(PRIVATE_KEYS)
    at = rf'(?i)(?<!\\)"(?:{keys})"\s*:\s*(\[[^\[\]{{}}]*\]|"(?:[^"\\]|\\.)*"|-?\d+(?![.\deE]))'
    values = F.regexp_extract_all(F.coalesce(json, F.lit("")), F.lit(at), F.lit(1))
    each = F.flatten(F.transform(values, lambda v: F.regexp_extract_all(v, F.lit(f"({_SCALAR})"), F.lit(1))))
    return F.array_sort(F.array_distinct(F.transform(each, lambda v: folded(F.regexp_replace(v, '^"|"$', "")))))


def task_identifiers(json: Column) -> Column:
    """F8: what four shapes find in a task's JSON, and what its private keys hold."""
    return F.array_sort(F.array_union(identifiers(json), private_values(json)))


def evidence_reason(evidence: Column, steps: Column, authoritative: Column | None = None) -> Column:
    """The reason why a branch's evidence doesn't count; null if it does. `authoritative`: the steps spoken by user or tool, where one of them is needed."""
    e = F.coalesce(evidence, F.array().cast("array<int>"))
    rules = [("missing_evidence_steps", F.size(e) == 0), ("invalid_evidence_step", F.size(F.array_except(e, steps)) > 0)]
    if authoritative is not None:
        rules.append(("no_authoritative_message_in_evidence", ~F.arrays_overlap(e, authoritative)))
    return first_reason(*rules)


def branch_reasons(
    route: Column, operation: Column, target: Column, target_known: Column, content: Column, scope: Column, confidence: Column, plan: Column, evidence: Column, steps: Column, authoritative: Column, ids: Column,
) -> tuple[Column, Column]:
    """(memory's reasons, sft's reasons) of a decision, each branch by itself; null for a branch that the route
    doesn't write. Only memory needs authoritative evidence and may not hold an identifier of its task."""
    none = F.lit(None).cast("array<string>")
    leaks = leaked(ids, F.concat_ws(" ", content, scope))
    memory = F.array_compact(
        F.concat(
            reasons(("missing_content", F.coalesce(content, F.lit("")) == ""), ("missing_scope", F.coalesce(scope, F.lit("")) == ""), ("invalid_confidence", confidence.isNull())),
            F.array(evidence_reason(evidence, steps, authoritative), F.when(F.size(leaks) > 0, F.concat(F.lit("task_identifier_leak:"), F.array_join(leaks, ",")))),
            F.array(first_reason(
                ("invalid_operation", ~F.coalesce(operation.isin("add", "refine", "replace"), F.lit(False))), ("missing_target", operation.isin("refine", "replace") & (F.coalesce(target.cast("string"), F.lit("")) == "")),
                ("unknown_target", operation.isin("refine", "replace") & ~F.coalesce(target_known, F.lit(False))), ("add_with_target", (operation == "add") & (F.coalesce(target.cast("string"), F.lit("")) != "")),
            )),
        )
    )
    sft = F.array_compact(F.array(F.coalesce(F.when(F.coalesce(plan, F.lit("")) == "", F.lit("missing_plan")), evidence_reason(evidence, steps))))
    bad = F.array(F.lit("invalid_route"))
    known = F.coalesce(route.isin("memory", "sft", "both", "neither"), F.lit(False))
    return F.when(~known, bad).when(route.isin("memory", "both"), memory).otherwise(none), F.when(~known, bad).when(route.isin("sft", "both"), sft).otherwise(none)


RAW_STEPS = "ARRAY<STRUCT<source_step: INT, index: INT, target_action: MAP<STRING,STRING>, action: MAP<STRING,STRING>, label_type: STRING, supporting_steps: ARRAY<INT>, rationale: STRING>>"


def normalised_episode(mode: Column, raw: Column) -> Column:
    """struct(mode, steps) of an episode as a writer gave it; null if it is of no known mode or has no step that can be
    used. Of the first EPISODE_STEPS steps those with a source step and an action are kept."""
    m = F.coalesce(F.trim(mode), F.lit(""))
    cut = F.slice(F.coalesce(raw, F.array().cast(RAW_STEPS)), 1, EPISODE_STEPS)
    at = lambda s: F.coalesce(s["source_step"], s["index"])
    act = lambda s: F.coalesce(s["target_action"], s["action"])
    steps = F.transform(
        F.filter(cut, lambda s: at(s).isNotNull() & act(s).isNotNull()),
        lambda s: F.struct(
            at(s).alias("source_step"), act(s).alias("target_action"), F.when(s["label_type"] == "corrected", "corrected").otherwise("recorded").alias("label_type"),
            F.array_sort(F.array_distinct(F.filter(F.coalesce(s["supporting_steps"], F.array().cast("array<int>")), lambda k: k >= 0))).alias("supporting_steps"), F.coalesce(F.trim(s["rationale"]), F.lit("")).alias("rationale"),
        ),
    )
    none = F.slice(steps, 1, 0)
    return F.when(m == "preserve_recorded", F.struct(m.alias("mode"), none.alias("steps"))).when(m.isin("", "corrected") & (F.size(steps) > 0), F.struct(F.lit("corrected").alias("mode"), steps.alias("steps")))


def episode_partition(episodes: DataFrame, steps: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, episode, status, reason): accepted, needs_replay or rejected by the first reason.

    episodes: run_id, episode, mode, source_step, action; steps: run_id, index, refs, action, failed; runs: run_id, success.
    An episode must have exactly the run's steps, end with its only finish, have actions that can come from their
    observations, and not repeat an earlier one of the run that passed. Everything joins on (run, step), so a long run is
    no hot key; episodes are told apart by a sum of hashes, so none is collected."""
    kind = F.lower(F.coalesce(F.element_at("action", F.lit("action")), F.lit("")))
    source = steps.select("run_id", F.col("index").alias("source_step"), "refs", F.col("action").alias("recorded"), "failed")
    whole = source.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_run"))
    bare = F.array_sort(F.map_entries("action"))
    e = episodes.withColumn("finish", kind == "finish").withColumn("hash_", F.xxhash64("source_step", bare).cast("decimal(38,0)")).join(source, ["run_id", "source_step"], "left")
    per = e.groupBy("run_id", "episode").agg(
        F.first("mode").alias("mode"), F.count(F.lit(1)).alias("n"), F.countDistinct(F.when(F.col("failed").isNotNull(), F.col("source_step"))).alias("met"), F.max_by("finish", "source_step").alias("ends"), F.count_if("finish").alias("finishes"),
        F.min(F.when(F.col("failed").isNotNull(), F.when(action_reason(F.col("action"), F.col("refs")).isNotNull(), F.struct("source_step", action_reason(F.col("action"), F.col("refs")).alias("why"))))).alias("bad"),
        F.bool_and(equivalent(F.col("recorded"), F.col("action"))).alias("same"), F.bool_or(F.coalesce("failed", F.lit(False))).alias("failed"), F.sum("hash_").alias("digest"),
    )
    j = per.join(whole, "run_id", "left").join(runs.select("run_id", "success"), "run_id", "left")
    good = F.coalesce("success", F.lit(False)) & ~F.col("failed")
    reason = first_reason(
        ("empty_source_trajectory", F.col("n_run").isNull()), ("incomplete_or_nonconsecutive_episode", (F.col("n") != F.col("n_run")) | (F.col("met") != F.col("n"))), ("missing_terminal_finish", ~F.coalesce("ends", F.lit(False))), ("finish_before_terminal_step", F.col("finishes") > 1),
    )
    why = F.coalesce(reason, F.col("bad.why"), F.when((F.col("mode") == "preserve_recorded") & ~good, F.lit("preserve_recorded_requires_successful_error_free_trajectory")))
    judged = j.withColumn("reason", why)
    earlier = judged.where("reason IS NULL").groupBy("run_id", "digest", "n").agg(F.min("episode").alias("first_"))
    once = judged.join(earlier, ["run_id", "digest", "n"], "left").withColumn("reason", F.coalesce("reason", F.when(F.col("episode") > F.col("first_"), F.lit("duplicate_episode"))))
    status = F.when(F.col("reason").isNotNull(), "rejected").when(F.coalesce("same", F.lit(False)) & good, "accepted").otherwise("needs_replay")
    return once.select("run_id", "episode", status.alias("status"), "reason")


def writer_plan(plan: Column, summary: Column, evidence: Column) -> Column:
    """struct(plan, mistake_summary, evidence_steps) with at most PLAN_EVIDENCE evidence steps, sorted; null without a plan."""
    steps = F.slice(F.array_sort(F.array_distinct(F.filter(F.coalesce(evidence, F.array().cast("array<int>")), lambda k: k >= 0))), 1, PLAN_EVIDENCE)
    return F.when(stripped(F.coalesce(plan, F.lit(""))) != "", F.struct(stripped(plan).alias("plan"), stripped(F.coalesce(summary, F.lit(""))).alias("mistake_summary"), steps.alias("evidence_steps")))


def legacy_decision(context: Column, source_step: Column, action: Column) -> Column:
    """struct(context, source_step, action) of an old artifact: '' and 'null' are null, actions outside the vocabulary are left out."""
    kind = F.lower(F.coalesce(F.element_at(action, F.lit("action")), F.lit("")))
    keep = source_step.isNotNull() & kind.isin(*ACTIONS)
    return F.struct(optional_string(context).alias("context"), F.when(keep, source_step).alias("source_step"), F.when(keep, kind).alias("kind"))


def training_candidates(records: DataFrame, status: Column, plan: Column, success: Column) -> DataFrame:
    """adds previous_success to the records selected for training that carry a plan."""
    return records.where((status == "selected") & (F.coalesce(plan, F.lit("")) != "")).withColumn("previous_success", F.coalesce(success, F.lit(False)))


def evidence_union(old: Column, new: Column) -> Column:
    """Both lists of struct(task, step, ..) in order, each (task, step) once, the first one kept."""
    both = F.concat(old, new)
    keys = F.transform(both, lambda e: F.struct(e["task"], e["step"]))
    return F.filter(both, lambda e, i: F.array_position(keys, F.struct(e["task"], e["step"])) == i + 1)


def _candidates(reply: Column) -> Column:
    """The whole reply, then each of its lines that shows something, without white space and back-ticks at the ends."""
    text = stripped(F.coalesce(reply, F.lit("")))
    lines = F.filter(F.transform(F.split(text, r"\r\n|\n|\r"), lambda x: stripped(F.regexp_replace(stripped(x), "^`+|`+$", ""))), lambda x: x != "")
    return F.concat(F.array(text), lines)


def page_action(reply: Column, search_bar: Column, clickables: Column) -> Column:
    """`search[..]` or `click[..]` of a reply: a search needs the bar and words of its own, a click a listed element,
    which is returned as it is spelled there; null if nothing is admissible."""
    lower = F.transform(clickables, lambda c: F.lower(c))

    def admitted(c: Column) -> Column:
        verb, arg = F.lower(F.regexp_extract(c, r"(?is)^(search|click)\[(.+)\]$", 1)), stripped(F.regexp_extract(c, r"(?is)^(search|click)\[(.+)\]$", 2))
        at = F.array_position(lower, F.lower(arg))
        return F.when((verb == "search") & search_bar & (arg != "") & (arg != "<your query>"), F.concat(F.lit("search["), arg, F.lit("]"))).when((verb == "click") & (at > 0), F.concat(F.lit("click["), F.get(clickables, (at - 1).cast("int")), F.lit("]")))

    return F.get(F.array_compact(F.transform(_candidates(reply), admitted)), F.lit(0))


#: The forms of a crafting command.
CRAFTING = r"(?is)^craft\s+.+\s+using\s+.+$|^get\s+\d+\s+.+$|^inventory$"


def crafting_command(reply: Column) -> Column:
    """The first of the reply and its lines that has one of three forms, without an `action:` before it; null if none has."""
    bare = F.transform(_candidates(reply), lambda c: stripped(F.regexp_replace(stripped(F.regexp_replace(c, "^`+|`+$", "")), r"^(?:action|Action)\s*:\s*", "")))
    return F.get(F.filter(bare, lambda c: c.rlike(CRAFTING)), F.lit(0))


def admissible_command(reply: Column, commands: Column) -> Column:
    """T5: the admissible command that the reply, or else its first line that is one, spells but for case; in the list's own spelling."""
    lower = F.transform(commands, lambda c: F.lower(c))
    found = F.transform(_candidates(reply), lambda c: F.get(commands, (F.array_position(lower, F.lower(c)) - 1).cast("int")))
    return F.get(F.filter(found, lambda c: c.isNotNull()), F.lit(0))


def sql_command(reply: Column) -> Column:
    """T4: 'explore|sql' or 'submit|sql' of a reply, whole or by line, without fences, back-ticks and the last semicolon; null if it commands nothing."""
    bare = stripped(F.regexp_replace(stripped(F.coalesce(reply, F.lit(""))), r"(?i)^```(?:sql)?\s*|\s*```$", ""))

    def command(c: Column) -> Column:
        verb, body = F.lower(F.regexp_extract(c, r"(?is)^(explore|submit)\s*:\s*(.+)$", 1)), F.regexp_extract(c, r"(?is)^(explore|submit)\s*:\s*(.+)$", 2)
        body = stripped(F.regexp_replace(stripped(F.regexp_replace(stripped(body), ";+$", "")), r"(?s)\s*```.*$", ""))
        return F.when((verb != "") & (body != ""), F.concat(verb, F.lit("|"), body))

    return F.get(F.array_compact(F.transform(_candidates(bare), command)), F.lit(0))


def score_outcome(family: Column, score: Column) -> Column:
    """struct(success, reward) by the thresholds of three families of environments: a score of 100, a score of 1, a reward above 0."""
    success = F.when(family == "science", score >= 100).when(family == "shop", score >= 1 - 1e-9).otherwise(score > 0)
    return F.struct(F.coalesce(success, F.lit(False)).alias("success"), F.coalesce(F.when(family == "science", score / 100.0).otherwise(score), F.lit(0.0)).alias("reward"))


def group_probes(tasks: DataFrame, group: str, task: str, success: str) -> DataFrame:
    """(group, task, probes, probe): how many other tasks of a task's group succeeded, and the first of them by id.

    The self join on the group without its pairs: a group's successes are counted and its first two kept, from which each
    task takes the one that isn't its own."""
    ok = tasks.where(F.coalesce(success, F.lit(False))).select(group, task)
    counts = ok.groupBy(group).agg(F.count(F.lit(1)).alias("n_"))
    first = ok.withColumn("r_", F.row_number().over(W.partitionBy(group).orderBy(task))).where("r_ <= 2")
    two = first.groupBy(group).agg(F.max(F.when(F.col("r_") == 1, F.col(task))).alias("a_"), F.max(F.when(F.col("r_") == 2, F.col(task))).alias("b_"))
    j = tasks.join(counts.join(two, group), group, "left")
    own = F.coalesce(success, F.lit(False)).cast("bigint")
    return j.select(group, task, (F.coalesce("n_", F.lit(0)) - own).alias("probes"), F.when(F.col("a_") == F.col(task), F.col("b_")).otherwise(F.col("a_")).alias("probe"))


def placebos(usable: DataFrame, group: str, task: str, seed: str = "7") -> DataFrame:
    """(group, task, placebo): for each task one of another group, the first in a fixed pseudo-random order.

    Only the first task of each group can be one, and only those of the first two groups are, so no complement is built."""
    h = hash_order(F.lit(seed), F.col(task))
    best = usable.groupBy(group).agg(F.min(F.struct(h.alias("h"), F.col(task).alias("t"))).alias("m"))
    two = [(r[group], r["m"]["t"]) for r in best.orderBy("m").limit(2).collect()]  # two rows
    other = F.coalesce(*[F.when(F.col(group) != g, F.lit(t)) for g, t in two], F.lit(None).cast("string"))
    return usable.select(group, task, other.alias("placebo"))


def elided(kept: DataFrame, group: str, order: str) -> DataFrame:
    """The rows that two_ended kept and, where it dropped some, one marker row in their place: adds `marker` (null for a
    step) and `place` from 0."""
    cut = kept.groupBy(group).agg(F.count_if(~F.col("kept")).alias("gone_"), F.count(F.lit(1)).alias("all_"), F.min(F.when(~F.col("kept"), F.col(order))).alias("at_")).where("gone_ > 0")
    text = F.concat(F.lit("[... "), F.col("gone_"), F.lit(" of "), F.col("all_"), F.lit(" steps elided ...]"))
    marks = cut.select(group, F.col("at_").alias("at_"), F.lit(None).cast(dict(kept.dtypes)[order]).alias(order), text.alias("marker"))
    rows = kept.where("kept").select(group, F.col(order).alias("at_"), order, F.lit(None).cast("string").alias("marker")).unionByName(marks)
    return rows.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy("at_")) - 1).drop("at_")


def next_ids(bank: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """Adds `memory_id` to new rows: mem_000001 and on, after the greatest number in the bank's ids. One number goes to the driver."""
    number = F.regexp_extract("id", r"^mem_(\d+)$", 1)
    most = bank.where(number != "").agg(F.max(number.cast("bigint"))).first()[0] or 0
    return positions(new, [order]).withColumn("memory_id", F.format_string("mem_%06d", F.col("pos") + 1 + most)).drop("pos")


def chosen_gain(candidates: DataFrame, chain: str, batch: str, key: str, rate: str, baseline: float) -> DataFrame:
    """Adds `gain`: a candidate's rate less that of the candidate chosen in the batch before, `baseline` before the first.

    The chosen one is a batch's best, the first by key on ties: one row a batch, and only those are ordered in their chain."""
    chosen = candidates.groupBy(chain, batch).agg(F.max(rate).alias("chosen_"))
    before = chosen.withColumn("before_", F.lag("chosen_").over(W.partitionBy(chain).orderBy(batch))).drop("chosen_")
    return candidates.join(before, [chain, batch]).withColumn("gain", F.col(rate) - F.coalesce("before_", F.lit(baseline))).drop("before_")


def policy_report(df: DataFrame, p: str, names: tuple[str, ...], k: int) -> DataFrame:
    """One row: decisions, mean entropy, mean greatest probability, mean chance that k draws agree, the logarithm of the
    chance that they agree on all decisions, and of each route the mean probability and how often it is the greatest."""
    from loomtrace.operators.policy import argmax, entropy

    c = F.col(p)
    same = F.aggregate(F.transform(c, lambda x: F.pow(x, F.lit(k))), F.lit(0.0), lambda s, x: s + x)
    each = [f for i, n in enumerate(names) for f in (F.avg(F.get(c, F.lit(i))).alias(f"mean_{n}"), F.count_if(argmax(c) == i).alias(f"n_{n}"))]
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg(entropy(c)).alias("mean_entropy"), F.avg(F.array_max(c)).alias("mean_top"), F.avg(same).alias("mean_same"), F.sum(F.ln(same)).alias("log_same"), *each)
