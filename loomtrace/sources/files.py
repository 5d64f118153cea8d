"""Scans and sinks: task files, record folders, JSON lines, banks, pools, memo tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace import schemas
from loomtrace.operators.banks import active_entries
from loomtrace.operators.retrieval import postings
from loomtrace.operators.validation import guarded


def task_file(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """A JSON array of tasks; the first `most` by id where a number is given."""
    t = spark.read.schema(schemas.TASK).option("multiLine", True).json(path)
    return t.orderBy("id").limit(most) if most else t


def rollouts(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Complete records of a folder of JSON files, with their file; an error if one is of another split or had a memory bank."""
    r = spark.read.schema(schemas.ROLLOUT).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_path")).where("status = 'complete'")
    if split is not None:
        r = guarded(r, F.coalesce("split", F.lit("")) == split, "a record is of another split")
    return guarded(r, F.coalesce("memory_bank", F.lit("")) == "", "a record was made with a memory bank")


def bank(spark: SparkSession, path: str) -> DataFrame:
    """S3: id, scope and content of a bank's active entries."""
    return active_entries(spark.read.schema(schemas.ENTRY).option("multiLine", True).json(path)).select("id", "scope", "content")


def lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def in_order(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Several inputs with their place: `input` by order of the list, `row` within the file."""
    parts = [spark.read.schema(schema).json(p).withColumn("input", F.lit(i)).withColumn("row", F.monotonically_increasing_id()) for i, p in enumerate(paths)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def listing(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob, sorted, on any file system Spark knows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return sorted(s.getPath().toString() for s in found or [])


def latest_run(spark: SparkSession, pattern: str) -> str | None:
    """The last of the sorted paths, None without any."""
    found = listing(spark, pattern)
    return found[-1] if found else None


def last_checkpoint(spark: SparkSession, pattern: str) -> int | None:
    """The largest iteration in file stems such as 'iter_12.json'; others are skipped."""
    import re

    numbers = [int(m.group(1)) for p in listing(spark, pattern) if (m := re.search(r"(\d+)\.\w+$", p))]
    return max(numbers, default=None)


def completed_runs(spark: SparkSession, pattern: str) -> DataFrame:
    """(run, file) of the runs that have left a `summary.json`, by the folder's name."""
    files = listing(spark, pattern)
    rows = [(f.rstrip("/").split("/")[-2], f) for f in files if f.endswith("/summary.json")]
    return spark.createDataFrame(rows, "run STRING, file STRING")


def listed_games(spark: SparkSession, path: str, kinds: list[str], name: str = "") -> DataFrame:
    """Game files of a tree whose kind is wanted, whose folder's name holds `name`, and that are marked solvable."""
    g = spark.read.schema("kind STRING, solvable BOOLEAN").option("multiLine", True).option("recursiveFileLookup", True).json(path).withColumn("file", F.col("_metadata.file_path"))
    return g.where(F.col("kind").isin(*kinds) & F.coalesce("solvable", F.lit(False)) & F.contains("file", F.lit(name)))


def task_ids(spark: SparkSession, prefix: str, n: int, levels: int = 40) -> DataFrame:
    """Generated task ids with their level."""
    return spark.range(n).select(F.format_string(f"{prefix}_%04d", "id").alias("id"), (F.col("id") % levels + 1).alias("level"))


def page_elements(html: Column, most: int = 180, chars: int = 240) -> Column:
    """Names of links and buttons in a page's HTML, capped in number and length."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<(?:a|button)\b[^>]*>(.*?)</(?:a|button)>"), F.lit(1))
    plain = F.transform(found, lambda x: F.substring(F.trim(F.regexp_replace(F.regexp_replace(x, r"<[^>]*>", ""), r"\s+", " ")), 1, chars))
    return F.slice(F.filter(plain, lambda x: x != ""), 1, most)


def write_json(df: DataFrame, path: str) -> None:
    """K1: the rows as JSON, in the place of what was there."""
    df.write.mode("overwrite").json(path)


def append_lines(df: DataFrame, path: str) -> None:
    """K2."""
    df.write.mode("append").json(path)


def export(df: DataFrame, ok: Column, path: str) -> None:
    """K3: Parquet after validation: one row that breaks the condition fails the export."""
    guarded(df, ok, "a row isn't valid for export").write.mode("overwrite").parquet(path)


def pending(jobs: DataFrame, done: DataFrame, key: str, terminal: tuple[str, ...] = ("complete",)) -> DataFrame:
    """K4: the jobs without a record of a terminal status."""
    return jobs.join(done.where(F.col("status").isin(*terminal)).select(key).distinct(), key, "left_anti")


def snapshot(entries: DataFrame, path: str) -> None:
    """K5: the active bank and the whole one, from one computation."""
    from loomtrace.session import cut_lineage

    kept = cut_lineage(entries)
    active_entries(kept).write.mode("overwrite").json(f"{path}/active")
    kept.write.mode("overwrite").json(f"{path}/full")


def grow_pool(rows: DataFrame, path: str) -> int:
    """K6: append to a pool; returns its size."""
    rows.write.mode("append").parquet(path)
    return rows.sparkSession.read.parquet(path).count()


def memoise(wanted: DataFrame, compute, path: str) -> DataFrame:
    """K7: (key, value) of the wanted keys: those of the store, and the others computed, stored once and read back."""
    spark = wanted.sparkSession
    keys = wanted.select("key").where("key IS NOT NULL").distinct()
    store = spark.read.schema(schemas.MEMO).parquet(path) if listing(spark, f"{path}/*.parquet") else spark.createDataFrame([], schemas.MEMO)
    fresh = compute(keys.join(store.select("key"), "key", "left_anti")).dropDuplicates(["key"]).select("key", "value")
    fresh.write.mode("append").parquet(path)
    return spark.read.schema(schemas.MEMO).parquet(path).join(keys, "key", "left_semi")


def write_index(docs: DataFrame, key: str, words: Column, path: str) -> None:
    """K8: the inverted index, laid out by term, and beside it the number of documents and their mean length."""
    postings(docs, key, words).repartition("term").sortWithinPartitions("term", key).write.mode("overwrite").parquet(f"{path}/postings")
    docs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(words)).alias("avgdl")).write.mode("overwrite").parquet(f"{path}/whole")


def bank_rows(store: DataFrame) -> DataFrame:
    """Rows of a vector store as bank entries, all active."""
    return store.select("id", F.col("memory").alias("content"), F.coalesce("scope", F.lit("")).alias("scope"), F.lit("active").alias("status"))
