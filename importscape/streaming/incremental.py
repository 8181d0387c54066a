"""Which files a run must read again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STAMPS = ("size", "mtime_ns", "ctime_ns")


def manifest_diff(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, status): added, deleted, changed or reused; reused only if size and both times are equal."""
    a, b = before.select("path", F.struct(*STAMPS).alias("was")), now.select("path", F.struct(*STAMPS).alias("is"))
    status = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "deleted").when(F.col("was").eqNullSafe(F.col("is")), "reused").otherwise("changed")
    return a.join(b, "path", "full").select("path", status.alias("status"))


def cache_status(diff: DataFrame, mode: str = "auto") -> DataFrame:
    """One row: counts of a diff, the share reused of what there is, and what the cache did.

    mode: off reads all, refresh reads all and keeps it, auto reuses what it can.
    """
    n = lambda *kinds: F.count_if(F.col("status").isin(*kinds)).cast("long")
    there, reused = n("added", "changed", "reused"), n("reused") if mode == "auto" else F.lit(0).cast("long")
    counted = diff.agg(there.alias("files_discovered"), reused.alias("files_reused"), (there - reused).alias("files_read"), n("added").alias("files_added"), n("changed").alias("files_changed"), n("deleted").alias("files_deleted"))
    ratio = F.coalesce(F.try_divide("files_reused", "files_discovered"), F.lit(0.0))
    status = F.when(F.lit(mode == "off"), "disabled").when(F.col("files_reused") == F.col("files_discovered"), "hit").when((F.col("files_reused") == 0) & (F.col("files_changed") == 0), "miss").otherwise("partial")
    return counted.select(F.lit(mode).alias("mode"), status.alias("status"), "*", ratio.alias("hit_ratio"))
