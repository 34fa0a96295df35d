"""Session defaults and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "peerscope", cores: int | str = 8, driver_memory: str = "16g") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by keys with the session's full number of partitions.

    Adaptive execution merges shuffle partitions by their bytes; steps whose cost is computation per
    row or group (peer statistics, pair scoring) must keep theirs. A grouping on the same keys
    right after reuses this partitioning, so it costs no second shuffle.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder for written tables: in the cluster's shared checkpoint folder.

    The folder is the session's ``spark.checkpoint.dir``; only a local session that names none gets a temporary one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = known.get() if known.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = os.path.join(tempfile.gettempdir(), f"peerscope-checkpoints-{os.getuid()}")
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new, empty scratch folder that is removed when the driver ends."""
    path = scratch_path(spark, name)
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(there)
    return drop_at_exit(spark, path)


def drop_at_exit(spark: SparkSession, path: str) -> str:
    """Have a written scratch table removed when the driver ends; nothing can read it any longer then."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(there)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage by writing the rows as a table and reading it back; the table goes when the driver ends.

    Used where several steps read the same costly rows, or must see the very same rows (offsets
    computed from a sorted layout and the rows of that layout), so that a lost executor cannot make
    them disagree. A written table is computed once, where a reliable checkpoint without a cache
    computes its rows twice, and later steps read only the columns they need.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(drop_at_exit(spark, path))
