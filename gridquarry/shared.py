"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.  One is made only for a local master, as in tests; on a cluster it has to be set."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = kept.get() if kept.isDefined() else None
    if not where and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not where:
        import tempfile

        where = tempfile.mkdtemp(prefix="gridquarry-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def stored(df: DataFrame, label: str, **options: int) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, and a lost executor costs no more than its own tasks.  options: the writer's."""
    path = f"{shared_dir(df.sparkSession)}/{re.sub('[^a-z0-9]', '-', label)}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unstored(df: DataFrame) -> None:
    """Remove what `stored` wrote, when nothing reads it any more."""
    jvm = df.sparkSession.sparkContext._jvm
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
