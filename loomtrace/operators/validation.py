"""Rules on records with reject reasons, as expressions on the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomtrace.functions.text import trimmed

#: The closed vocabularies.
ROUTES = ("memory", "sft", "both", "neither")
OPERATIONS = ("add", "refine", "replace")
ACTIONS = ("click", "fill", "press", "scroll", "back", "goto", "finish")


def reasons(*rules: tuple[str, Column]) -> Column:
    """The names of the rules that a row breaks, in order. A rule that can't be told (null) isn't broken."""
    return F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in rules]))


def first_reason(*rules: tuple[str, Column]) -> Column:
    """The first broken rule, null if none is."""
    return F.coalesce(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in rules])


def all_match(patterns: Column, answer: Column) -> Column:
    """every pattern is found in the answer, whatever the case; no pattern, no match."""
    return (F.size(F.coalesce(patterns, F.array().cast("array<string>"))) > 0) & F.coalesce(F.forall(patterns, lambda p: F.regexp(F.coalesce(answer, F.lit("")), F.concat(F.lit("(?i)"), p))), F.lit(False))


def candidate_reasons(operation: Column, content: Column, scope: Column, confidence: Column, evidence: Column, steps: Column, authoritative: Column) -> Column:
    """F6 without the leak rule: `steps` are the run's indexes, `authoritative` those spoken by user or tool."""
    e = F.coalesce(evidence, F.array().cast("array<int>"))
    unknown = F.size(F.array_except(e, steps)) > 0
    gate = reasons(
        ("missing_content", F.coalesce(content, F.lit("")) == ""), ("missing_scope", F.coalesce(scope, F.lit("")) == ""), ("invalid_confidence", confidence.isNull() | (confidence < 0) | (confidence > 1)),
        ("missing_evidence_steps", F.size(e) == 0), ("invalid_evidence_step", unknown), ("no_authoritative_message_in_evidence", (F.size(e) > 0) & ~unknown & ~F.arrays_overlap(e, authoritative)),
    )
    return F.when(operation == "noop", F.array().cast("array<string>")).when(operation != "add", F.array(F.lit("invalid_operation"))).otherwise(gate)


def route_of(route: Column) -> Column:
    """the route of the closed vocabulary, `invalid` for any other."""
    r = F.lower(F.trim(route))
    return F.when(r.isin(*ROUTES), r).otherwise(F.lit("invalid"))


def memory_reasons(operation: Column, target: Column, target_known: Column, content: Column, evidence: Column) -> Column:
    """F7, memory branch."""
    return reasons(
        ("invalid_operation", ~F.coalesce(operation.isin(*OPERATIONS), F.lit(False))), ("missing_content", F.coalesce(content, F.lit("")) == ""),
        ("unknown_target", operation.isin("refine", "replace") & ~F.coalesce(target_known, F.lit(False))), ("missing_target", operation.isin("refine", "replace") & target.isNull()),
        ("missing_evidence_steps", F.size(F.coalesce(evidence, F.array().cast("array<int>"))) == 0),
    )


def choice(memory: Column, sft: Column) -> Column:
    """two booleans as one of four labels; null counts as false."""
    m, s = F.coalesce(memory, F.lit(False)), F.coalesce(sft, F.lit(False))
    return F.when(m & s, "both").when(m, "memory").when(s, "sft").otherwise("neither")


def action_reason(action: Column, refs: Column) -> Column:
    """why a browser action can't have come from an observation with these element ids; null if it can."""
    get = lambda k: F.element_at(action, F.lit(k))
    kind, ref = F.lower(F.coalesce(get("action"), F.lit(""))), get("ref")
    needs = kind.isin("click", "fill") | ((kind == "press") & ref.isNotNull())
    return first_reason(
        ("unsupported_action", ~kind.isin(*ACTIONS)), ("missing_element_identifier", needs & ref.isNull()), ("element_not_in_source_observation", needs & ~F.coalesce(F.array_contains(refs, ref), F.lit(False))),
        ("missing_element_identifier", (kind == "press") & ref.isNull() & ~F.map_contains_key(action, F.lit("ref"))), ("missing_fill_value", (kind == "fill") & get("text").isNull()),
        ("missing_url", (kind == "goto") & (trimmed(get("url")) == "")), ("missing_answer", (kind == "finish") & (trimmed(get("answer")) == "")),
    )


def equivalent(a: Column, b: Column) -> Column:
    """two actions are equal but for their remarks."""
    bare = lambda m: F.array_sort(F.map_entries(F.map_filter(m, lambda k, v: ~k.isin("note", "rationale"))))
    return bare(a).eqNullSafe(bare(b))


def chat_reason(roles: Column, contents: Column) -> Column:
    """why a message list is no training chat: a system message, then user and assistant in turn, ending with the assistant."""
    n = F.size(roles)
    rest = F.slice(roles, F.lit(2), F.greatest(n - 1, F.lit(0)))
    turns = F.transform(rest, lambda r, i: F.when(i % 2 == 0, r == "user").otherwise(r == "assistant"))
    return first_reason(
        ("too_short", n < 3), ("first_not_system", F.get(roles, F.lit(0)) != "system"), ("even_length", n % 2 == 0), ("roles_do_not_alternate", ~F.forall(turns, lambda t: F.coalesce(t, F.lit(False)))), ("blank_content", F.exists(contents, lambda c: F.coalesce(F.trim(c), F.lit("")) == ""))
    )


def tool_chats(messages: DataFrame, run: str, order: list[str], role: str) -> DataFrame:
    """F16: (run, why): system first and only once, known roles, at least one assistant; null if all holds. Aggregates only, so a run of any length is one row."""
    r = F.col(role)
    per = messages.groupBy(run).agg(
        F.min_by(r, F.struct(*order)).alias("head_"), F.count_if(r == "system").alias("systems_"), F.bool_or(~r.isin("system", "user", "assistant", "tool")).alias("other_"), F.bool_or(r == "assistant").alias("speaks_")
    )
    why = first_reason(("first_not_system", F.col("head_") != "system"), ("system_twice", F.col("systems_") > 1), ("unknown_role", F.col("other_")), ("no_assistant", ~F.col("speaks_")))
    return per.select(run, why.alias("why"))


def action_chats(steps: DataFrame, run: str, order: str, shown: Column, kind: Column) -> DataFrame:
    """(run, why) for runs as chats of a system message and, for each step, what is shown and the action as JSON: nothing
    blank, only known actions, the last one a finish and no other; null if all holds. Aggregates only."""
    per = steps.groupBy(run).agg(
        F.bool_or(F.coalesce(F.trim(shown), F.lit("")) == "").alias("blank_"), F.bool_or(~F.coalesce(kind.isin(*ACTIONS), F.lit(False))).alias("unknown_"), F.max_by(F.coalesce(kind == "finish", F.lit(False)), order).alias("ends_"), F.count_if(kind == "finish").alias("finishes_")
    )
    why = first_reason(("blank_content", F.col("blank_")), ("invalid_action_target", F.col("unknown_")), ("missing_terminal_finish", ~F.col("ends_")), ("finish_before_terminal_step", F.col("finishes_") > 1))
    return per.select(run, why.alias("why"))


def first_calls(calls: DataFrame, owner: str, name: str, order: str, known: list[str]) -> DataFrame:
    """at most one call of each known tool, the first."""
    ok = calls.where(F.lower(F.col(name)).isin(*known))
    return ok.withColumn("rn", F.row_number().over(W.partitionBy(owner, F.lower(F.col(name))).orderBy(order))).where("rn = 1").drop("rn")


def guarded(df: DataFrame, ok: Column, message: str) -> DataFrame:
    """The rows, or an error as soon as one breaks the condition."""
    return df.where(F.when(F.coalesce(ok, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def episode_reasons(steps: DataFrame, runs: DataFrame) -> DataFrame:
    """F14 for recorded episodes: (run_id, status, reason) of each run as an episode of its own steps.

    accepted: complete, ends with its only finish, every action valid in its observation, the run successful and free of
    errors; needs_replay: the same without success; rejected: the first reason. One pass over steps, one row per run."""
    refs = F.transform(F.filter(F.coalesce(F.col("observation.elements"), F.array().cast("array<struct<ref:int,tag:string,role:string,name:string,placeholder:string>>")), lambda e: e["ref"].isNotNull()), lambda e: e["ref"].cast("string"))
    kind = F.lower(F.element_at("action", F.lit("action")))
    s = steps.where("run_id IS NOT NULL").select("step_id", "run_id", "index", action_reason(F.col("action"), refs).alias("why"), (kind == "finish").alias("finish"), (F.coalesce("execution_error", F.lit("")) != "").alias("failed"))
    once = s.groupBy("run_id", "index").agg(F.first("why").alias("why"), F.bool_or("finish").alias("finish"), F.bool_or("failed").alias("failed"))
    per = once.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("index").alias("lo"), F.max("index").alias("hi"), F.max_by("finish", "index").alias("ends"), F.count_if("finish").alias("finishes"),
        F.min(F.when(F.col("why").isNotNull(), F.struct("index", "why"))).alias("bad"), F.bool_or("failed").alias("failed"),
    )
    j = per.join(runs.select("run_id", "success"), "run_id", "left")
    reason = first_reason(
        ("incomplete_or_nonconsecutive_episode", (F.col("lo") != 0) | (F.col("hi") - F.col("lo") + 1 != F.col("n"))), ("missing_terminal_finish", ~F.coalesce("ends", F.lit(False))), ("finish_before_terminal_step", F.col("finishes") > 1)
    )
    why = F.coalesce(reason, F.col("bad.why"))
    status = F.when(why.isNotNull(), "rejected").when(F.coalesce("success", F.lit(False)) & ~F.coalesce("failed", F.lit(False)), "accepted").otherwise("needs_replay")
    return j.select("run_id", status.alias("status"), why.alias("reason"))
