"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, what: str) -> str:
    """A fresh folder under spark.checkpoint.dir, or under /tmp/checkpoints where that is unset (tests, one machine)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or "file:///tmp/checkpoints"
    return f"{at.rstrip('/')}/lotewise/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` there and read it back: evaluated once, cut from its lineage, and safe from lost executors."""
    path = shared_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def once(df: DataFrame) -> DataFrame:
    """``df`` with its columns evaluated once a row, where it stands; it is observed under a name of its own.

    The optimizer moves a filter (that of an explode, too) down to the scan and writes each column out that it names, so
    a page that is parsed and then filtered is parsed again for each mention, and before it is dealt out to tasks. It
    moves nothing below what is observed.
    """
    return df.observe(f"once-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("rows"))


def dropped(df: DataFrame) -> None:
    """Delete the folders of a ``stored`` table that nothing reads any more."""
    jvm = df.sparkSession.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
