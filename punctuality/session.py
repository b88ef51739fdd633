"""Session settings and the shared folder that written intermediates go to."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Shuffle bytes aimed at per task. AQE coalesces smaller ones, so erring high on the
#: number of partitions is cheap and erring low spills.
TARGET_SHUFFLE_BYTES = 128 * 1024 * 1024


def shuffle_partitions(shuffle_bytes: int, cores: int) -> int:
    """Number of shuffle partitions for a job that moves ``shuffle_bytes``.

    A multiple of the core count, so that the last wave of tasks is full.
    """
    by_size = -(-int(shuffle_bytes) // TARGET_SHUFFLE_BYTES)
    waves = max(1, -(-by_size // cores))
    return waves * cores


def settings(shuffle_bytes: int, cores: int) -> dict[str, str]:
    """Configuration every plan of this package is written for."""
    return {
        "spark.sql.shuffle.partitions": str(shuffle_partitions(shuffle_bytes, cores)),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # The feed has local clocks and no zone: derived times are TIMESTAMP_NTZ and the
        # session zone must not move anything.
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.parquet.compression.codec": "zstd",
        # Without call-site capture a wide plan is built in a third of the time.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that every executor can reach.

    It lies below ``spark.checkpoint.dir``, or below the warehouse where that is unset, and is
    deleted when the session's JVM ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/cuts"
    own = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(own)
    files = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    files.mkdirs(folder)  # only what exists can be marked
    files.deleteOnExit(folder)
    return f"{own}/{name}"


def materialised(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage in a way that survives the loss of executors, and gives the optimizer
    the true size of the table, which is what decides between broadcast and shuffle joins.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
