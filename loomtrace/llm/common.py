"""What the operators of this subpackage share: table access, visibility of text, Arrow-batched mapping."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Java and RE2 class of characters that show nothing: separators, controls, format marks, fillers and joiners.
INVISIBLE = r"[\p{Z}\p{C}\x{2800}\x{3164}\x{115F}\x{1160}\x{FFA0}\x{034F}\x{FE00}-\x{FE0F}]"
VISIBLE = r"[^\p{Z}\p{C}\x{2800}\x{3164}\x{115F}\x{1160}\x{FFA0}\x{034F}\x{FE00}-\x{FE0F}]"

_BLANK_MARKS = frozenset("⠀ㅤᅟᅠﾠ͏")
#: Rows in one Arrow batch. Texts may be long; with the executors' memory this bounds what Python holds at once.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shown(col: Column) -> Column:
    """True where the text has at least one visible character; null and blank texts give false."""
    return F.coalesce(col.rlike(VISIBLE), F.lit(False))


def is_shown(text: str | None) -> bool:
    """The same in Python."""
    if not text:
        return False
    for c in text:
        if c.isalnum():
            return True
        if unicodedata.category(c)[0] not in "ZC" and c not in _BLANK_MARKS and not "︀" <= c <= "️":
            return True
    return False


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the Arrow batch size of the session where it is larger: page and document texts reach tens of thousands of characters."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))


def map_batches(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """mapInArrow over columns as Python lists: fn takes and returns {column: list}, once for each batch."""
    out = StructType.fromDDL(schema)
    arrow = to_arrow_schema(out)
    names = arrow.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = fn({n: c.to_pylist() for n, c in zip(b.schema.names, b.columns)})
            yield pa.RecordBatch.from_arrays([pa.array(cols[n], type=arrow.field(n).type) for n in names], schema=arrow)

    return df.mapInArrow(run, out)


def one_per_key(df: DataFrame, *keys: str) -> DataFrame:
    """One delivery for each key. Deliveries of a key have the same content, so any of them will do."""
    return df.dropDuplicates(list(keys))


_SPACES = re.compile(r"\s+")


def squeeze(text: str) -> str:
    return _SPACES.sub(" ", text).strip()
