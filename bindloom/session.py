"""Session defaults and the shared work folder."""

from __future__ import annotations

import functools
import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join side even where that costs one more shuffle later on
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


CLEANING = 10  # seconds
_cleaned = float("-inf")


def local_session(cpus: str = "8", app: str = "bindloom") -> SparkSession:
    """Session for tests and benches on one machine; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of its own; on a cluster a missing
    setting is an error, because executors do not share the driver's disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_folder()


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="bindloom-")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def configure(spark: SparkSession) -> SparkSession:
    """The library's settings of adaptive execution on a session of the user's own."""
    for key, value in DEFAULTS.items():
        if ".adaptive." in key:
            spark.conf.set(key, value)
    return spark


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage with a parquet table in the shared folder: survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._written_path = path
    return table


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes tables that ``written`` made and nothing reads any more, and lets Spark clean the shuffles behind them.

    Spark deletes the files of a shuffle when the driver has collected its last reference, which
    in a long job with a large heap may be much later than the disks would like. This is asked for once in
    ``CLEANING`` seconds at most.
    """
    global _cleaned
    jvm = spark.sparkContext._jvm
    for table in tables:
        path = jvm.org.apache.hadoop.fs.Path(table._written_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    if time.monotonic() - _cleaned > CLEANING:
        gc.collect()
        jvm.java.lang.System.gc()
        _cleaned = time.monotonic()
