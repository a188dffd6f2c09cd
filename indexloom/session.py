"""Session helpers: a local session for tests and benchmarks, and shared intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, name: str = "indexloom", memory: str = "16g") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named in `spark.checkpoint.dir`.

    Only where that is unset on a local master does a temporary folder stand in for it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return os.path.join(tempfile.gettempdir(), "indexloom-checkpoints")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/indexloom/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Cuts the lineage of an iterative job with a table that outlives its executors; being Parquet, it
    is read back by column and its size is known to the planner. `zstd` is worth its time for tables of ids and paths.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.mode("errorifexists").option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Even out a scan that has fewer partitions than there are cores.

    For work that is heavy per row. Input with partitions to spare, as any large one has, is not touched,
    nor is anything that has been shuffled already.
    """
    if df.isStreaming or "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= 2 * cores else df.repartition(cores)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession, root: str) -> None:
    """Let executors import the packages under `root`, which only the driver needs to have: Spark sends them a copy."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    # Spark reads the file again for every new executor, so it stays for the life of the driver
    folder = tempfile.mkdtemp(prefix="indexloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "indexloom_packages.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for package in ("indexloom", "workload"):
            for at, _, names in os.walk(os.path.join(root, package)):
                for name in sorted(names):
                    if name.endswith(".py"):
                        path = os.path.join(at, name)
                        out.write(path, os.path.relpath(path, root))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)
