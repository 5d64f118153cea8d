"""Problem 5: conversations rebuilt from message rows by keyed streaming state.

The state is keyed by (run, index): what has been said and done at one place of a conversation, in four message ids and a
mark, whatever the number of messages or deliveries there. So one endless run, even one with a third of all rows, spreads
over many keys, and no key buffers a list. Event time is the time of ingestion: a place stays open while rows keep coming
within IDLE of each other (a session window), late ones are taken in while the watermark, LATENESS behind the newest row,
hasn't passed it, and it is emitted when the watermark has, or at the end mark that closes a finite input. Places that were
emitted more than once are merged, and a batch step joins the places of a run: good is a run all of whose places hold one
observation and one action and follow each other without a gap.

A finite table is read in one micro-batch (availableNow), so the watermark drops no row however late it came; a live
stream (`emitted`) drops what comes after the watermark has passed.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.llm.common import shown
from loomtrace.session import shared_dir

#: How late a message may come (the watermark's delay) and how long a place waits for more.
LATENESS = "7 days"
IDLE = "1 day"
#: The key of the mark that ends a finite input.
END = "\u0000end"

PLACES = "run_id STRING, index INT, said_first BIGINT, said_last BIGINT, done_first BIGINT, done_last BIGINT, broken BOOLEAN"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def speaker(observation: Column, action: Column) -> Column:
    """0 for the environment, 1 for the agent, 2 for a row that is blank, empty or both at once: it breaks its conversation."""
    said, acted = shown(observation), shown(F.element_at(action, F.lit("action")))
    is_obs, is_act = observation.isNotNull(), action.isNotNull()
    return F.when(is_obs & ~is_act & said, 0).when(is_act & ~is_obs & acted, 1).otherwise(2)


def prepared(messages: DataFrame) -> DataFrame:
    """The columns the state needs, with an event time for each row. Rows without run_id belong to no conversation."""
    # a stream begins with its watermark at 0 and drops what isn't later, so no event may be that early
    earliest = F.lit("1970-01-02").cast("timestamp")
    at = F.coalesce(F.col("ingested_at"), F.col("sent_at")).cast("timestamp")
    return messages.where("run_id IS NOT NULL").select(
        "run_id",
        F.col("message_id").cast("bigint").alias("message_id"),
        F.col("index").cast("int").alias("index"),
        speaker(F.col("observation"), F.col("action")).cast("int").alias("speaker"),
        F.greatest(F.coalesce(at, earliest), earliest).alias("event_time"),
    )


def _folded() -> list[Column]:
    """What a place keeps of its rows; merging what was kept twice gives the same as taking in all rows at once."""
    said, done = (F.when(F.col("speaker") == k, F.col("message_id")) for k in (0, 1))
    broken = F.col("index").isNull() | F.col("message_id").isNull() | (F.col("speaker") == 2)
    return [F.min(said).alias("said_first"), F.max(said).alias("said_last"), F.min(done).alias("done_first"), F.max(done).alias("done_last"), F.bool_or(broken).alias("broken")]


def emitted(stream: DataFrame, lateness: str = LATENESS, idle: str = IDLE) -> DataFrame:
    """The stateful part over a stream of prepared messages: one row for each place, once the watermark has passed its last message by `idle`."""
    folded = stream.withWatermark("event_time", lateness).groupBy(F.session_window("event_time", idle), "run_id", "index").agg(*_folded())
    return folded.select("run_id", "index", "said_first", "said_last", "done_first", "done_last", "broken")


def read_files(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A stream over a folder of Parquet files, or over one file."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).options(**options)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile():
        return reader.option("pathGlobFilter", where.getName()).parquet(where.getParent().toString())
    return reader.parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    """Deletes a work folder, wherever it lies; silent if the session has ended."""
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001
        pass


def run_stream(spark: SparkSession, path: str) -> DataFrame:
    """Drive a finite folder of message files through the stream to its end; returns the emitted places.

    The same query, under a live trigger, serves a growing folder. Work files lie in the shared folder, so an executor
    lost on the way only repeats its tasks; state and marks are deleted at the end of the input, the output with the session."""
    base = f"{shared_dir(spark).rstrip('/')}/conversations-{uuid.uuid4().hex}"
    control = f"{base}/control"
    static = prepared(spark.read.parquet(path))
    end = spark.createDataFrame([(END, 0, 0, 0)], "run_id STRING, message_id BIGINT, index INT, speaker INT").withColumn("event_time", F.lit("2200-01-01").cast("timestamp"))
    end.limit(0).write.parquet(control)
    keep = {k: spark.conf.get(k, None) for k in ("spark.sql.streaming.multipleWatermarkPolicy", "spark.sql.streaming.stateStore.providerClass")}
    spark.conf.set("spark.sql.streaming.multipleWatermarkPolicy", "max")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    atexit.register(_remove, spark, base)
    try:
        live = prepared(read_files(spark, path))
        marks = spark.readStream.schema(static.schema).parquet(control)
        out = emitted(live.unionByName(marks))
        for last in (False, True):
            if last:
                end.coalesce(1).write.mode("append").parquet(control)
            out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in keep.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
        for part in ("state", "control"):
            _remove(spark, f"{base}/{part}")
    return spark.read.schema(PLACES).parquet(f"{base}/out")


def assembled(places: DataFrame) -> DataFrame:
    """run_id, turn, message_id, index, speaker of every good conversation. Runs are summed up in five numbers; nothing collects one."""
    once = places.where(F.col("run_id") != END).groupBy("run_id", "index").agg(
        F.min("said_first").alias("said"), F.max("said_last").alias("said_last"), F.min("done_first").alias("done"), F.max("done_last").alias("done_last"), F.bool_or("broken").alias("broken"),
    )
    fine = ~F.col("broken") & F.coalesce(F.col("said") == F.col("said_last"), F.lit(False)) & F.coalesce(F.col("done") == F.col("done_last"), F.lit(False))
    runs = once.groupBy("run_id").agg(F.bool_and(fine).alias("good"), F.min("index").alias("lowest"), F.max("index").alias("highest"), F.count(F.lit(1)).alias("n"))
    good = runs.where("good AND lowest IN (0, 1) AND n = highest - lowest + 1").select("run_id", "lowest")
    both = F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("message_id"), F.lit(who).alias("speaker")) for k, c, who in ((0, "said", "environment"), (1, "done", "agent"))])
    turns = once.join(good, "run_id").select("run_id", "index", "lowest", F.explode(both).alias("m"))
    return turns.select("run_id", (2 * (F.col("index") - F.col("lowest")) + F.col("m.k")).alias("turn"), "m.message_id", "index", "m.speaker")


def conversations(spark: SparkSession, path: str) -> DataFrame:
    """run_id, turn, message_id, index, speaker: the good conversations among the message files of a path.

    Good: index starts at 0 or 1, has no gap and no null, and at each index there is exactly one observation, which
    comes first, and one action, neither blank. Repeated deliveries of a message count once; a row with both or
    neither of observation and action, and one without message_id, breaks its conversation; the spelling of `role`
    and the agent's clock play no part. An empty table gives no rows; further columns are ignored.
    """
    return assembled(run_stream(spark, path))
