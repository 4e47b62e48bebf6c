"""What the operators share: shipping the package, scratch tables, reading inputs."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship as _ship

#: Rows of an Arrow batch where the session keeps Spark's default, which is made for narrow rows.
BATCH = 1000


def ship(spark: SparkSession) -> None:
    """Make this package importable in every Python worker, and batches of whole texts small."""
    _ship(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH))


#: The operator that this worker last worked for.
_LAST: list[str] = [""]


def trim() -> None:
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def _take_over(owner: str) -> None:
    """Let go of what other operators have left in this worker."""
    if _LAST[0] != owner:
        _LAST[0] = owner
        package = __name__.rpartition(".")[0]
        for name, module in list(sys.modules.items()):
            if name.startswith(package) and name != owner and module is not None:
                for held in list(vars(module).values()):
                    if hasattr(held, "cache_clear") and getattr(held, "__module__", owner) != owner:
                        held.cache_clear()
        trim()


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for a worker that lives on after its partition and may then serve another operator: memory is given back."""
    owner = run.__module__

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _take_over(owner)
        yield from run(batches)
        trim()

    return inner


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or one of our own where that is unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
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


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below :func:`scratch_root`, removed when the application ends."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def drop_scratch(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage ends here, and it survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = table(spark, path, df.schema)
    out.scratch_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables of :func:`written` that nothing reads any more."""
    for t in tables:
        if getattr(t, "scratch_path", None):
            drop_scratch(t.sparkSession, t.scratch_path)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that no other column can clash."""
    return df.select(*[F.col(f"`{n}`") for n in names])
