"""Lineage cuts that survive lost executors."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a local session without one gets a temporary folder."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        named = tempfile.mkdtemp(prefix="cladeworks-")
    spark.sparkContext.setCheckpointDir(named)
    return named


def pinned(df: DataFrame) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_written: dict[str, list[str]] = {}


def clear(spark: SparkSession) -> int:
    """Remove all tables that this application has stored so far, when nothing that reads them is left to run; their number."""
    gone = _written.pop(spark.sparkContext.applicationId, [])
    for path in gone:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    return len(gone)


class Rounds:
    """Rows of the rounds of a loop: each is written once to the shared folder, and read back. They stay until ``clear``."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.n = spark, 0
        self.path = f"{checkpoint_dir(spark).rstrip('/')}/rounds-{uuid4().hex}"
        _written.setdefault(spark.sparkContext.applicationId, []).append(self.path)

    def add(self, df: DataFrame) -> DataFrame:
        where = f"{self.path}/round={self.n}"
        self.n += 1
        self.schema = df.schema
        df.write.parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def all(self) -> DataFrame:
        """Rows of all rounds so far; later ones are not seen."""
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/round={k}" for k in range(self.n)])


def stored(df: DataFrame) -> DataFrame:
    return Rounds(df.sparkSession).add(df)
