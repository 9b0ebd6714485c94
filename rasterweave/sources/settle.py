"""Cut the lineage of small decision tables that several later steps use."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one in the warehouse where it is unset.

    Both are folders that driver and executors share. A warehouse on the driver's own disk is
    none, so on a cluster it is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        one_machine = re.match(r"local(\[|$)", spark.sparkContext.master)
        if not one_machine and re.match(r"(file:|/)", warehouse):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"{warehouse}/_settled"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Later steps then start from a stored table with known sizes instead of
    repeating its scans, and a lost executor repeats no more than its own task.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._settled_in = path
    return stored


def forget(*tables: DataFrame) -> None:
    """Delete settled tables. Call it when all that reads them has been stored itself."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._settled_in)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
