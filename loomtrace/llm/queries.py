"""The queries of the problems, over whole tables, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.llm import abuse, common, conversations, packing, page_body, pieces, repeats, replies, residue, tokens
from loomtrace.session import ship, spread

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; those with page and document texts spread over the cores where they are a single small file."""
    t = common.table(spark, sf_dir, name)
    return spread(t) if name in ("steps", "documents", "model_replies") else t


def ready(spark: SparkSession) -> None:
    ship(spark)
    common.small_batches(spark)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return pieces.oversized(table(spark, sf_dir, "steps"), table(spark, sf_dir, "size_limits"))


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces with their texts' digests in place of the texts, and the number of elements in place of the lists."""
    ready(spark)
    got = pieces.observation_pieces(table(spark, sf_dir, "steps"), table(spark, sf_dir, "size_limits"))
    return got.select("step_id", "field", "piece_no", "begin", "end", F.md5("piece").alias("digest"), F.size("items").alias("n_items"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return page_body.frame_rows(table(spark, sf_dir, "steps"))


def p2_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return page_body.main_bodies(table(spark, sf_dir, "steps"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return residue.failing_fields(table(spark, sf_dir, "steps"))


def p3_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return residue.kept_steps(table(spark, sf_dir, "steps"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return replies.defects(table(spark, sf_dir, "model_replies"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return conversations.conversations(spark, f"{sf_dir}/messages.parquet").select("run_id", "turn", "message_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return repeats.repeated_runs(table(spark, sf_dir, "steps")).select("run_id", "first_index", "last_index")


def p6_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return repeats.collapsed(table(spark, sf_dir, "steps"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return tokens.encoded(table(spark, sf_dir, "documents"))


def _sizes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    ready(spark)
    return tokens.token_counts(table(spark, sf_dir, "documents")), pieces.limits(table(spark, sf_dir, "size_limits"))["documents.text"][0]


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes, capacity = _sizes(spark, sf_dir)
    return packing.containers(sizes, "doc_id", "n_tokens", capacity)


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes, capacity = _sizes(spark, sf_dir)
    return packing.fill_report(packing.containers(sizes, "doc_id", "n_tokens", capacity), capacity)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return abuse.flagged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "abuse_labels"))


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return abuse.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "abuse_labels"))


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return abuse.rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "abuse_labels"))


def queries() -> dict[str, Query]:
    return {k: v for k, v in globals().items() if k.startswith("p") and "_" in k and k[1].isdigit() and callable(v)}


def oracle_sql() -> dict[str, str]:
    limit = "(SELECT max_size FROM size_limits WHERE field = 'observation.{}')"
    visible = r"[^\p{Z}\p{C}\x{2800}\x{3164}\x{115F}\x{1160}\x{FFA0}\x{034F}\x{FE00}-\x{FE0F}]"
    return {
        "p1_found": f"""
            SELECT DISTINCT step_id, 'text' AS field FROM steps WHERE step_id IS NOT NULL AND length(observation.text) > {limit.format("text")}
            UNION ALL
            SELECT DISTINCT step_id, 'elements' FROM steps WHERE step_id IS NOT NULL AND len(observation.elements) > {limit.format("elements")}""",
        "p5_found": f"""
            WITH once AS (SELECT run_id, message_id, min("index") AS i, min(CASE
                    WHEN observation IS NOT NULL AND action IS NULL AND regexp_matches(observation, '{visible}') THEN 0
                    WHEN action IS NOT NULL AND observation IS NULL AND coalesce(regexp_matches(action['action'], '{visible}'), false) THEN 1 ELSE 2 END) AS s
                FROM messages WHERE run_id IS NOT NULL GROUP BY run_id, message_id),
            per AS (SELECT run_id, i, count(*) AS n, sum(CASE WHEN s = 0 THEN 1 ELSE 0 END) AS obs, sum(CASE WHEN s = 1 THEN 1 ELSE 0 END) AS act, bool_or(i IS NULL OR message_id IS NULL) AS bad FROM once GROUP BY run_id, i),
            good AS (SELECT run_id, min(i) AS lo FROM per GROUP BY run_id HAVING bool_and(n = 2 AND obs = 1 AND act = 1 AND NOT bad) AND min(i) IN (0, 1) AND max(i) - min(i) + 1 = count(*))
            SELECT o.run_id, CAST(2 * (o.i - g.lo) + o.s AS INTEGER) AS turn, o.message_id FROM once o JOIN good g USING (run_id)""",
    }
