"""Intermediate tables, Arrow batch sizes and paths of any file system Hadoop knows.

Intermediate tables go to the folder named by ``spark.checkpoint.dir``, which driver and executors share on
a cluster. Only a local master may go without that setting; then a folder of this machine is used.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
LEAST_ROWS = 256


def scratch_dir(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: on a cluster intermediate tables need a shared folder")
        root = tempfile.mkdtemp(prefix="lexcheck-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends here and a lost
    executor costs a re-read, not a recomputation. The write's own shuffle files go when it is over."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def tasks_for(df: DataFrame, task_bytes: int = 4 << 20) -> int:
    """A number of shuffle partitions that grows with the files behind ``df``, so that a task's share does not; never under the session's."""
    spark = df.sparkSession
    total = 0
    for f in df.inputFiles():
        where = hadoop_path(spark, f)
        total += file_system(spark, where).getFileStatus(where).getLen()
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // task_bytes))


def discard(*frames: DataFrame) -> None:
    """Delete tables made by ``materialise`` that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        for f in df.inputFiles()[:1]:
            path = hadoop_path(spark, f).getParent()
            if re.fullmatch(r"[0-9a-f]{32}", path.getName()):
                file_system(spark, path).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows, so that very long texts do not meet in one batch. Frames are lazy, so the
    setting has to outlive the call; it is only ever lowered, and to one value, so no frame made here
    depends on which ran last."""
    if int(spark.conf.get(BATCH_ROWS)) not in range(1, LEAST_ROWS + 1):
        spark.conf.set(BATCH_ROWS, str(LEAST_ROWS))


def hadoop_path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def file_system(spark: SparkSession, path):
    return path.getFileSystem(spark._jsc.hadoopConfiguration())


def join(folder: str, name: str) -> str:
    """``name`` in ``folder``; a name with a scheme or from the root stands for itself."""
    return name if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", name) or name.startswith("/") else f"{folder.rstrip('/')}/{name}"


def exists(spark: SparkSession, path: str) -> bool:
    where = hadoop_path(spark, path)
    return file_system(spark, where).exists(where)


def children(spark: SparkSession, path: str) -> Iterator[tuple[str, bool]]:
    """(name, is a folder) of what is in a folder."""
    where = hadoop_path(spark, path)
    for status in file_system(spark, where).listStatus(where):
        yield status.getPath().getName(), status.isDirectory()


def replace_file(spark: SparkSession, source: str, target: str) -> None:
    """Rename a file over another, which is replaced in one step where the file system can."""
    jvm = spark._jvm
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    here, there = (file_system(spark, p).makeQualified(p) for p in (hadoop_path(spark, source), hadoop_path(spark, target)))
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(there.toUri(), spark._jsc.hadoopConfiguration()).rename(here, there, options)


def read_small_file(spark: SparkSession, path: str) -> str:
    """The text of a small file (settings, rules), read by the driver."""
    where = hadoop_path(spark, path)
    stream = file_system(spark, where).open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
