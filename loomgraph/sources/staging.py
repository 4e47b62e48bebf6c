"""Tables between steps, in a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a folder of our own where that is unset and the master is local."""
    conf = spark.sparkContext.getConf()
    shared = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not shared:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        if got.isDefined():
            shared = got.get()
        elif spark.sparkContext.master.startswith("local"):
            shared = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
            spark.sparkContext.setCheckpointDir(shared)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{shared.rstrip('/')}/loomgraph-{spark.sparkContext.applicationId}"


def fresh(spark: SparkSession, name: str) -> str:
    """A path below :func:`root` that nothing is at yet, removed when the application ends."""
    path = f"{root(spark)}/{name}-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read again: its plan ends here, and it survives lost executors. Removed when the application ends."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
