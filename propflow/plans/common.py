"""Reading tables for queries."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of few bytes and much work each, dealt to all tasks: a small file is read by one.

    ``keys`` must not be what the next step is dealt by, or the planner may drop the deal.
    """
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return rows.repartition(tasks, F.xxhash64(*keys))


_local: str | None = None


def scratch(spark: SparkSession) -> str:
    """A new folder, for files made by a query, that driver and executors share and can open: under ``spark.checkpoint.dir``.

    A folder of our own is made only where the setting is absent and the whole
    session runs in one process, as in tests.
    """
    global _local
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = _local = _local or tempfile.mkdtemp(prefix="propflow-")
    plain = re.sub("^file:(//)?(?=/)", "", root)
    if "://" in plain:
        raise ValueError("files are opened by name, so the shared folder must be on a mounted file system")
    path = f"{plain.rstrip('/')}/files-{uuid.uuid4().hex}"
    os.makedirs(path)
    return path
