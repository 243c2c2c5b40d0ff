"""Session-level helpers: table access, sessions for tests, lineage cuts in the shared folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import scriptorium

# Executors need no copy of the package: its functions travel with the plan.
cloudpickle.register_pickle_by_value(scriptorium)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir``; any path that Spark's readers open will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """A small table dealt out to all cores before work that takes long on each row; one of as many partitions as there are cores stays as it is.

    A file of one row group is else one task's, however many cores there are.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def local_session(cores: str = "8", partitions: str = "8", memory: str = "8g") -> SparkSession:
    """A session for tests and the benchmark."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("scriptorium")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; a local one only where that is unset and Spark runs in one process, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = os.path.join(tempfile.gettempdir(), "scriptorium-checkpoints")
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a table written below the shared folder, in a folder of the application's, and read again.

    It survives lost executors, and the plan behind it is gone, with its
    constraints and size estimates; these would else grow with the square of
    themselves in every round of an iteration. Whoever cleans the shared folder
    can drop the application's folder once it has ended.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/scriptorium-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
