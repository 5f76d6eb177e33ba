"""Spark session defaults and the shared checkpoint folder.

On a cluster the session is created by the platform; ``configure`` only fills
settings that are unset. ``checkpoint_dir`` reads ``spark.checkpoint.dir`` from
the session and only falls back to a fresh scratch folder when it is unset
(local runs and tests).
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings this library relies on. AQE re-plans joins/partition counts from
# runtime sizes and splits skewed shuffle partitions; the session time zone is
# pinned so timestamp arithmetic is reproducible.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # 10 MB: only genuinely small relations are auto-broadcast.
    "spark.sql.autoBroadcastJoinThreshold": str(10 * 1024 * 1024),
}


def build_local(cpus: int | None = None, shuffle_partitions: int | None = None,
                app: str = "kinframe") -> SparkSession:
    """Local session for tests and the benchmark (UI off, no extra ports)."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    b = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.driver.memory", os.environ.get("KINFRAME_DRIVER_MEM", "16g"))
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
         .config("spark.ui.showConsoleProgress", "false"))
    for k, v in DEFAULTS.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply DEFAULTS to an existing session where a key is not yet set."""
    for k, v in DEFAULTS.items():
        if spark.conf.get(k, None) in (None, ""):
            spark.conf.set(k, v)
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; a local one is made only if none is named and the master is local."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not current:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="kinframe-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return sc.getCheckpointDir() or current


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a Parquet table in the shared folder and read from it: for tables of many rows, which are several
    times smaller there than as a checkpoint. The table stays until the folder is cleared."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/kinframe-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers (for Arrow functions), once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    root, name = os.path.split(package)
    archive = os.path.join(tempfile.mkdtemp(prefix="kinframe-code-"), name)  # the driver serves it from here
    sc.addPyFile(shutil.make_archive(archive, "zip", root, name))
    _SHIPPED.add(sc.applicationId)
