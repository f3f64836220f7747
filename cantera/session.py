"""Session defaults and how this library cuts a lineage."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}
#: Tables written to the shared folder and not yet removed, with their sessions.
_WRITTEN: dict[str, SparkSession] = {}


def get_session(app: str = "cantera", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's defaults; ``conf`` overrides them (dots as ``__``)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    Only where that setting is absent and the master is a plain ``local`` one (tests,
    laptops) a temporary folder is taken; on a cluster the absence is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not hasattr(spark, "_cantera_dir"):
        spark._cantera_dir = tempfile.mkdtemp(prefix="cantera-")
        atexit.register(shutil.rmtree, spark._cantera_dir, ignore_errors=True)
    return f"file://{spark._cantera_dir}"


def _delete(path: str, spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@atexit.register
def _clean() -> None:
    while _WRITTEN:
        _delete(*_WRITTEN.popitem())


class Cut:
    """A table written once to the shared folder: ``rows`` reads it, ``counts`` holds the values
    of the named aggregates, worked out in the same job; ``drop`` removes it early."""

    def __init__(self, df: DataFrame, **aggregates: Column) -> None:
        spark = df.sparkSession
        self.path = f"{shared_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
        seen = Observation() if aggregates else None
        watched = df.observe(seen, *[c.alias(k) for k, c in aggregates.items()]) if seen else df
        watched.write.parquet(self.path)
        _WRITTEN[self.path] = spark
        self.counts = dict(seen.get) if seen else {}
        self.rows = spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        if spark := _WRITTEN.pop(self.path, None):
            _delete(self.path, spark)


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a written table, computed once.

    The files live in the shared folder, so they outlive a lost executor, and their size is
    known to the planner; they go when the driver ends.
    """
    return Cut(df).rows


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def some(condition: Column | str) -> Column:
    """How many rows meet a condition."""
    return F.coalesce(F.sum(F.when(F.expr(condition) if isinstance(condition, str) else condition, 1).otherwise(0)), F.lit(0)).cast("bigint")
