"""Session settings for local runs; on a cluster the submitter's own settings stand."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def local_session(cpus: int | None = None, name: str = "filmgrain") -> SparkSession:
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def work_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session, where driver and executors are one process, may go without: it
    gets one temporary folder, removed when the process ends. On a cluster a missing setting is
    an error, as executors don't see each other's disks. What a job leaves in the named folder is its
    owner's to remove, like Spark's own checkpoints.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="filmgrain-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return _OWN[0]


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the work folder and read back: what several branches read is worked out once, and
    lost executors don't bring it back to its beginnings."""
    path = f"{work_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, so workers started elsewhere can import it."""
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="filmgrain-ship-")
    made = shutil.make_archive(os.path.join(folder, "filmgrain"), "zip", os.path.dirname(root), os.path.basename(root))
    spark.sparkContext.addPyFile(made)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
