"""Session helper, stage tables in the shared folder, and plan-time checks."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import ClassVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def get_session(name: str = "tidemark", cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the library is tested under; on a cluster pass your own session instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read: ``spark.checkpoint.dir``. Only a local session without that setting (tests) gets a
    temporary one; on a cluster it is an error."""
    sc = spark.sparkContext
    own = sc._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get()
    if configured := sc.getConf().get("spark.checkpoint.dir"):
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        sc.setCheckpointDir("file://" + os.path.join(tempfile.gettempdir(), "tidemark-checkpoints"))
    else:
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return sc._jsc.sc().getCheckpointDir().get()


class Stage:
    """A table written to the shared folder: cuts lineage, survives lost executors, and can be dropped when a later round replaces
    it, or together with all others by ``drop_stages``, once the results that read it are written."""

    made: ClassVar[list[Stage]] = []

    def __init__(self, df: DataFrame):
        spark = df.sparkSession
        self.path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)
        self.spark = spark
        Stage.made.append(self)

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        if self in Stage.made:
            Stage.made.remove(self)


@contextmanager
def drop_stages() -> Iterator[None]:
    """Drops the stage tables that are made within, at the end: ``with drop_stages(): query(...).write.parquet(...)``."""
    before = set(map(id, Stage.made))
    try:
        yield
    finally:
        for s in [s for s in Stage.made if id(s) not in before]:
            s.drop()


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back."""
    return Stage(df).df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def require_columns(df: DataFrame, *names: str) -> None:
    """Raise ``KeyError`` at plan time when a column is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {', '.join(missing)}")


def micros(c: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, or of one with zone as the session shows it; whatever the session zone."""
    c = F.col(c) if isinstance(c, str) else c
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c.cast("timestamp_ntz"))


def empty_like(spark: SparkSession, schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame([], schema)
