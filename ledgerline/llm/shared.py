"""Tables in the folder that driver and executors share, and small helpers of the operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import drop_table, materialise, new_path, passing, shared_root  # noqa: F401

#: The ASCII white space that the contracts name, as a regular expression's character class.
BLANKS = r"\x20\x09-\x0D"


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns of ``df`` under the given names, and nothing else, so other columns can't clash.
    Names count by case, and one that occurs twice in ``df`` is an error of the caller."""
    return df.select(*[df[f"`{old}`"].alias(new) for new, old in columns.items()])


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


#: Rows that go to Python together; Spark's own number suits short rows, and texts are long.
BATCH_ROWS = 1000
_SETTING, _DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def small_batches(spark: SparkSession) -> None:
    """Have texts go to Python ``BATCH_ROWS`` at a time, unless the session says otherwise: a batch is held by the JVM, by the
    worker, and once more while it is taken apart. For jobs of many stages, whose workers and executors stay."""
    if spark.conf.get(_SETTING) == _DEFAULT:
        spark.conf.set(_SETTING, str(BATCH_ROWS))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@cache
def _trim():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return lambda pad: 0


def give_back() -> None:
    """A worker's unused memory to the system, and so to the JVM beside it, which both live on after the task."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def by_rows(batches: Iterator[pa.RecordBatch], most: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches in parts of some rows, so that what is made of a part is small beside the batch."""
    for batch in batches:
        for a in range(0, batch.num_rows, most):
            yield batch.slice(a, most)
