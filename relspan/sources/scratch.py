"""Intermediate tables in the folder that driver and executors share.

``spark.checkpoint.dir`` names that folder. Where it is unset (tests, a laptop)
a fresh local folder takes its place, for local masters alone.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
_MADE: list[tuple[SparkSession, str]] = []
#: A local file gets no .crc file beside it: Hadoop starts a process (chmod) for each file that it makes, which counts with as much memory as the
#: executor's JVM until it has begun. Other file systems than the local one don't read these options.
NO_CRC = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder's URI; sets Spark's own checkpoint folder where none is set."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError(f"{context.master} shares no local folders: set spark.checkpoint.dir to one that driver and executors share")
        if context.applicationId not in _LOCAL:
            _LOCAL[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="relspan-")
        named = _LOCAL[context.applicationId]
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named if ":/" in named else "file://" + named


def new_folder(spark: SparkSession, label: str) -> str:
    """URI of a folder that no other call uses; removed when this driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/relspan/{label}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


def staged(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write df once as Parquet in the shared folder, with further options of the writer, and return a scan of it.

    Cuts the lineage: a lost executor costs a re-read of the files, not a re-run.
    """
    path = new_folder(df.sparkSession, label)
    df.write.options(**NO_CRC, **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_counted(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """As staged(), with the number of rows, which is counted while they are written."""
    seen, names = Observation(), df.columns
    path = new_folder(df.sparkSession, label)
    df.observe(seen, F.count(F.lit(1)).alias("n")).select(*(f"`{c.replace('`', '``')}`" for c in names)).write.options(**NO_CRC).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), int(seen.get.get("n") or 0)


def stored_bytes(df: DataFrame) -> int:
    """Size of the files of a table that staged() has returned."""
    jvm, total = df.sparkSession.sparkContext._jvm, 0
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        where = jvm.org.apache.hadoop.fs.Path(path)
        total += where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
    return total


def discard(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete the tables that staged() has returned and that nothing will read again."""
    for df in frames:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if "/relspan/" in path:
                remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's file systems."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _remove_all() -> None:
    for spark, path in _MADE:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the JVM may have gone first
            return
