"""Helpers shared by the corpus operators: staging in the shared folder, words, keys."""

from __future__ import annotations

import contextlib
import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import dropped, shared_dir, staged, table  # noqa: F401  for the operators

#: White space that separates words: space and the controls 0x09 to 0x0D.
SPACE = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that `df` does not have, whatever the case."""
    held = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in held:
            n += "_"
        out.append(n)
    return out


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most `rows` rows from now on, where the session still has the default of 10,000: texts are long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def give_back() -> None:
    """Memory that a Python worker has freed goes back to the system; workers stay for the next task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def words(text) -> F.Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+"))


def n_words(text) -> F.Column:
    """The number of words as a long."""
    return F.size(words(text)).cast("long")
