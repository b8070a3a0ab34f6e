"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A single-JVM session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("docloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local-mode session may go without it; there a temporary folder is made once and
    remembered as the checkpoint folder.
    """
    context = spark.sparkContext
    named = (
        spark.conf.get("spark.checkpoint.dir", None)
        or context.getConf().get("spark.checkpoint.dir")
        or context.getCheckpointDir()
    )
    if named:
        if not context.getCheckpointDir():
            context.setCheckpointDir(named)
        return named
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    made = tempfile.mkdtemp(prefix="docloom-")
    context.setCheckpointDir(made)
    return context.getCheckpointDir() or made


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared scratch folder (not created)."""
    return f"{scratch_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


# For tables whose rows are large: Parquet looks whether a page is full after every row, not after 100, so
# that pages, and the native buffers that executors keep for their compression, stay near 1 MB.
LARGE_ROWS = {"parquet.page.size.row.check.min": "1"}


def cut(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and go on from there.

    It drops the lineage of iterated or much-used tables: a lost executor costs a re-read, not
    a recomputation, and the plans on top stay small. ``options`` are the writer's.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Repartition rows that come from fewer files than the cluster has cores; else leave them.

    Meant before slow per-row work on few files. A table of many files is not shuffled. Files are
    listed from the plan: no job runs.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df
