"""Sessions and lineage.

Nothing here fixes a cluster's sizing: partitions, memory and the broadcast limit come from the session's own settings.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "loomtrace", cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it. Where that is unset: a local one if the session is
    local (tests), else an error, since no machine's own folder is shared."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), f"loomtrace-{os.getuid()}")
        os.makedirs(named, exist_ok=True)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: computed once, kept in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def together(df: DataFrame, key: str) -> DataFrame:
    """Rows brought together by a key, in the session's number of partitions."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def cut_lineage_in_place(df: DataFrame) -> DataFrame:
    """A checkpoint that is known to be partitioned as df is: grouping by its key, or by more, shuffles nothing after.
    Only a plan that isn't re-planned on the way tells its partitioning, so that is switched off meanwhile."""
    spark = df.sparkSession
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut_lineage(df)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once for each session, wherever they run."""
    import io
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    if getattr(sc, "_loomtrace_shipped", False):
        return
    here = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, str(p.relative_to(here.parent)))
    path = Path(tempfile.mkdtemp(prefix="loomtrace-")) / "loomtrace_package.zip"
    path.write_bytes(packed.getvalue())
    sc.addPyFile(str(path))
    sc._loomtrace_shipped = True


def spread(df: DataFrame) -> DataFrame:
    """A table that comes in fewer splits than half the cores (one small file) dealt out to all; any larger one as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df._jdf.rdd().getNumPartitions() <= cores else df
