"""Session helpers: a local session for tests, and tables written to the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("splitmark")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``. Where that is unset on one machine (tests), a new temporary folder is made and kept
    for the session; on a cluster it is an error, as every executor would write to a disk of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    if not getattr(context, "_splitmark_dir", None):
        context._splitmark_dir = "file://" + tempfile.mkdtemp(prefix="splitmark-", dir=os.environ.get("TMPDIR"))
    return context._splitmark_dir


#: Rows that are worth a file and a task of their own; rows of texts, or of other long or dear values.
FILE_ROWS, LONG_ROWS = 50_000, 2048


def gathered(df: DataFrame, rows: int, per: int = FILE_ROWS) -> DataFrame:
    """``df``, of about ``rows`` rows at most, in no more partitions than they are worth at ``per`` rows each.

    Without Hadoop's native library the JVM starts processes for the rights of every file on a local disk, and each shares all of its
    memory until it runs its own program.
    """
    return df.coalesce(max(1, -(-rows // per)))


def written(df: DataFrame, name: str = "step", rows: int | None = None, per: int = FILE_ROWS) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage ends there, and lost executors lose nothing of it.

    ``rows``: about how many there are at most, so that a small table isn't cut into as many files as a shuffle has partitions.
    """
    if rows is not None:
        df = gathered(df, rows, per)
    path = f"{shared_dir(df.sparkSession)}/splitmark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._splitmark_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Removes tables that :func:`written` made and that nothing will read any more."""
    for table in tables:
        path = table._splitmark_path
        place = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def parallelism(spark: SparkSession) -> int:
    """Partitions that a shuffle makes; it grows with the cluster and the input, as its owner sets it."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
