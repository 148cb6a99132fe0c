"""Sessions for this library."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import broadcast


#: Rows go to Python in batches of about so many bytes, unless the application sets its own limit: texts can be long, and workers are small.
BATCH_LIMIT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors this package, once per application, so that functions run there in Python find it, and bound the batches they get."""
    sc = spark.sparkContext
    if not sc.getConf().contains(BATCH_LIMIT):
        spark.conf.set(BATCH_LIMIT, BATCH_BYTES)
    if not getattr(sc, "_assetspan_shipped", False):
        here = Path(__file__).parent
        target = Path(tempfile.mkdtemp(prefix="assetspan-")) / "assetspan.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(here.rglob("*.py")):
                z.write(p, p.relative_to(here.parent))
        sc.addPyFile(str(target))
        sc._assetspan_shipped = True
    return spark


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder of the session and read it from there.

    The folder is what spark.checkpoint.dir names; a local session that has none gets a temporary one.
    """
    _shared(df.sparkSession)
    with _shuffles_removed(df.sparkSession):
        return df.select("*").checkpoint()


def _shared(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """As cut(), for wide tables that several readers take a few columns of: compressed columns in a folder of their own beside the checkpoints, which
    goes with them."""
    path = f"{_shared(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    with _shuffles_removed(df.sparkSession), _compiled(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kept = path
    return out


def freed(*tables: DataFrame) -> None:
    """Remove the folders of tables as kept() gave them, which nothing will read any more; other tables are left alone."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._kept) if getattr(t, "_kept", None) else None
        if path is not None:
            path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Whether Spark removes the shuffle files of a query when it has ended, and not only when the driver has forgotten it.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Above so many bytes the JVM interprets a method instead of compiling it; Spark then makes one of a whole stage no more, but several small ones.
HUGE, HUGE_BYTES = "spark.sql.codegen.hugeMethodLimit", "8000"


@contextmanager
def _set(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _shuffles_removed(spark: SparkSession):
    """What is written here leaves no shuffle files behind: it is read from where it was written."""
    return _set(spark, CLEANUP, "true")


def _compiled(spark: SparkSession):
    """What is written here, often from many columns, is not interpreted for being one method too large to compile."""
    return _set(spark, HUGE, HUGE_BYTES)


#: Up to so many rows of a few values each are broadcast; beyond it Spark shuffles both sides.
BROADCAST_ROWS = 300_000


def small(df: DataFrame) -> DataFrame:
    """df, which is cheap to count, as a broadcast side if it has at most BROADCAST_ROWS rows."""
    return broadcast(df) if df.count() <= BROADCAST_ROWS else df
