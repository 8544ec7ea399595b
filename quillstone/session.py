"""Session settings and shared-folder helpers used by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "quillstone", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("QUILLSTONE_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the setting is absent on one machine (tests) a temporary folder is made and set; on a cluster a folder
    of the driver's own would be of no use, so the setting must be there.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if known is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="quillstone-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(known)
        known = spark.sparkContext.getCheckpointDir()
    return known


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table of the shared folder: cuts the lineage and survives a lost executor."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.shared_path = path
    return kept


def forget(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made and that no later step reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.shared_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unsent(df: DataFrame) -> DataFrame:
    """df for a join that shuffles both sides and sorts them, whatever size Spark takes them for; neither is broadcast."""
    return df.hint("merge")


#: Rows, of all tables together, that one task gets to sort and join, so that its memory does not follow the input.
ROWS_A_PARTITION = 2_000_000


def dealt(rows: int, key: str, *tables: DataFrame) -> list[DataFrame]:
    """tables dealt out by key to more partitions than the session's where those would get more than ROWS_A_PARTITION of rows each."""
    n = -(-rows // ROWS_A_PARTITION)
    if n <= int(tables[0].sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return list(tables)
    return [df.repartition(n, key) for df in tables]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
