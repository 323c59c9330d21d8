"""What the jobs share: configuration, logging, and a session for the command line."""

from __future__ import annotations

import argparse
import json
import logging
import sys
import uuid
from collections.abc import Callable
from dataclasses import fields
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

C = TypeVar("C")
log = logging.getLogger("jobs")


def configured(kind: type[C], path: str | None) -> C:
    """A configuration with what a small JSON file says; names that it doesn't know are an error."""
    given = {}
    if path:
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
    unknown = set(given) - {f.name for f in fields(kind)}
    if unknown:
        raise ValueError(f"{path}: unknown settings {sorted(unknown)}")
    return kind(**given)


def replace_partitions(rows: DataFrame, path: str, *by: str) -> None:
    """Write rows as Parquet partitioned by columns; only partitions that rows have are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def command_line(kind: type[C], run: Callable, *paths: str, description: str | None) -> None:
    """Parse paths and --config, run the job in a session of its own, and stop that session."""
    parser = argparse.ArgumentParser(description=description)
    for p in paths:
        parser.add_argument(p)
    parser.add_argument("--config", help="a JSON file; see the one beside the job")
    args = parser.parse_args()
    logging.basicConfig(stream=sys.stderr, level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(run.__name__).getOrCreate()
    try:
        run(spark, *(getattr(args, p) for p in paths), configured(kind, args.config))
    finally:
        spark.stop()


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder that is there for this call only, in the one that driver and executors share (in local mode, without
    spark.checkpoint.dir, in a temporary one)."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        shared = f"file://{tempfile.mkdtemp(prefix='jobs-')}"
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
