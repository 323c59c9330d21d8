"""Tables that a query reads several times: written once to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

_own_folder: list[str] = []


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet under spark.checkpoint.dir and read it again, so that what it takes is worked out once however often it is
    read. The table is deleted when the driver's JVM ends. Without that setting a folder of our own does in local mode; elsewhere df
    stays as it is."""
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            return df
        if not _own_folder:
            _own_folder.append(tempfile.mkdtemp(prefix="whinstone-"))
        shared = f"file://{_own_folder[0]}"
    path = f"{shared.rstrip('/')}/whinstone-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)
