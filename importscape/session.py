"""Sessions, and how this package reaches the executors."""

from __future__ import annotations

import os
import tempfile
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: weakref.WeakSet = weakref.WeakSet()


def ship(spark: SparkSession) -> None:
    """Sends this package to the session's executors, once; Python operators there import it."""
    context = spark.sparkContext
    if context in _shipped:
        return
    top = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="ship-"), f"{top.name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    context.addPyFile(path)
    _shipped.add(context)


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """For tests and benches on one machine; a cluster brings its own settings."""
    conf = {"spark.sql.shuffle.partitions": partitions, "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g", "spark.sql.adaptive.enabled": "true"}
    return SparkSession.builder.master(f"local[{cores}]").config(map=conf).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir; on one machine alone it may be unset, on a cluster that raises."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        named = os.path.join(tempfile.gettempdir(), "checkpoints")
        os.makedirs(named, exist_ok=True)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Computes df once into the shared folder: later reads survive the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
