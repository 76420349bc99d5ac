"""Tables written on the way, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset, a temporary one on a local master; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or "cluster" in master:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, which cuts its lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_ranges(df: DataFrame, order: list[str]) -> DataFrame:
    """df as a table with _range, the number of the range of `order` that a row lies in.

    A range sort gives ranges of about equally many rows, however the values are spread; it is written, so
    that whoever counts the rows of a range and whoever numbers them see the same ranges.
    """
    return written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")


def replace_days(df: DataFrame, path: str, time_ms: str, by: tuple[str, ...] = (), files: int = 8, hashed: tuple[str, ...] = ("symbol",)) -> None:
    """Writes df by day of `time_ms` (UTC), after the columns `by`; the days that df holds are replaced, others stay.

    So a run can be repeated. A folder gets at most `files` files, whatever the number of tasks: rows are dealt out by
    folder and a hash of `hashed`.
    """
    dealt = df.withColumn("day", F.date_from_unix_date(F.floor(F.col(time_ms) / 86_400_000).cast("int")))
    dealt = dealt.repartition(*by, "day", F.pmod(F.xxhash64(*hashed), F.lit(files)))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by, "day").parquet(path)
