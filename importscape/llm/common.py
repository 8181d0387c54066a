"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, stored

__all__ = ["file_system", "forget", "fresh_dir", "give_back", "hinted", "looked_up", "remembered", "shared_dir", "stored", "table", "tidy"]

#: Rows of one key from which it is joined apart, and keys that may be: a share of all rows that only so many keys can hold.
HOT_ROWS, HOT_KEYS = 1000, 1000


#: What drops the things that a Python worker keeps from task to task.
_remembered: list[Callable[[], None]] = []


def remembered(drop: Callable[[], None]) -> None:
    """Names what drops a thing that a worker keeps for later tasks of one operator."""
    _remembered.append(drop)


def give_back() -> None:
    """Gives a worker's free memory back to its machine; an idle worker would hold it beside the stages that run without it."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc; what is freed in pieces stays with the process otherwise
        trim(0)


def forget() -> None:
    """Drops what a worker keeps for other operators, whose stages ran in it before, and gives free memory back."""
    for drop in _remembered:
        drop()
    give_back()


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a function over a task's batches, in a worker that has forgotten other operators' things and holds no free memory after it."""

    @functools.wraps(run)
    def tidied(batches: Iterator) -> Iterator:
        forget()
        yield from run(batches)
        give_back()

    return tidied


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_dir(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder; nothing is created yet."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def hinted(df: DataFrame, rows: int, most: int) -> DataFrame:
    """df with a broadcast hint if its counted rows are within the bound; else unchanged, so that it is shuffled."""
    return F.broadcast(df) if rows <= most else df


def looked_up(rows: DataFrame, values: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with values, which holds each key once; a key that very many rows share is not one task's work.

    Keys of more than ``HOT_ROWS`` rows and of more than one in ``HOT_KEYS`` of all rows
    are counted before anything is shuffled; at most ``HOT_KEYS`` can be so. Their values
    are broadcast and their rows stay where they are. Null keys match nothing.
    """
    counts = stored(rows.groupBy(key).agg(F.count("*").alias("hot_rows")).where(F.col("hot_rows") > HOT_ROWS))
    if counts.isEmpty():
        return rows.join(values, key, how)
    least = rows.count() / HOT_KEYS
    hot = F.broadcast(counts.where(F.col("hot_rows") > least).select(key).where(F.col(key).isNotNull()))  # HOT_KEYS rows at most
    apart = rows.join(hot, key, "left_semi").join(F.broadcast(stored(values.join(hot, key, "left_semi"))), key, how)
    return apart.unionByName(rows.join(hot, key, "left_anti").join(values, key, how))


def file_system(uri: str):
    """pyarrow's file system and the path on it, for any scheme that executors may write to."""
    from pyarrow import fs

    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)
