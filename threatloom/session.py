"""Session set-up for tests and local runs, and shared-folder helpers for clusters."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "8", app: str = "threatloom") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # the JVM leaves methods over 8,000 bytes uncompiled: run such stages operator by operator
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        # large generated expressions: skip the call-site capture per Column call
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``.

    A local folder is made only where the setting is absent and the master is
    local (tests); a cluster without the setting is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="threatloom-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def _scratch_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/threatloom/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused path under the application's part of the shared folder."""
    return f"{_scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> None:
    """Delete the application's scratch tables; call it when no result that reads them is needed any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by writing a table to the shared folder and reading it back.

    Survives the loss of executors, unlike cached blocks, and gives later
    passes a columnar scan with column pruning.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Inputs that come in fewer parts than this are dealt out over the cores.
FEW_SPLITS = 16
#: Rows of a part of a larger input that is dealt out.
SPREAD_ROWS = 50_000


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use all cores for a table of few row groups, such as a single file with one.

    A split without the start of a row group gives an empty task, however many
    splits a file is cut into: the splits that hold rows are counted (from the
    footers, no column is read). Inputs of ``FEW_SPLITS`` such splits or more,
    or of one a core, pass through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    held = df.groupBy(F.spark_partition_id().alias("p")).count()
    filled, rows = held.agg(F.count("*"), F.coalesce(F.sum("count"), F.lit(0))).first()
    if filled >= min(cores, FEW_SPLITS):
        return df
    return df.repartition(max(cores, rows // SPREAD_ROWS), *keys)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))
