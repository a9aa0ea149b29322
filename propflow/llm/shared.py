"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import types
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW_GROUP_BYTES = 16 << 20
_local_root: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A folder of our own is made only where the setting is absent and the whole
    session runs in one process, as in tests.
    """
    global _local_root
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="propflow-")
    return _local_root


def staged(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: cuts the lineage.

    A lost executor costs a reread of the table, never a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    # a writer holds a row group in memory, and tables here carry whole texts
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def numbered(df: DataFrame, order: list, name: str) -> tuple[DataFrame, int]:
    """``df`` with a column that numbers its rows from 0 in the order given, and the number of rows.

    Rows are dealt by range and sorted there; only the sizes of ranges, as many as
    partitions, meet in one place.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    rows, _ = staged(ranged.withColumn(name, F.monotonically_increasing_id()), "numbered")
    # the number of a row holds its partition above 33 bits, and its place there below
    place, part = F.col(name).bitwiseAND(F.lit((1 << 33) - 1)), F.shiftright(F.col(name), 33)
    sizes = sorted(map(tuple, rows.groupBy(part.alias("part")).count().collect()))
    before, at = [], 0
    for k, n in sizes:
        before.append((k, at))
        at += n
    lead = spark.createDataFrame(before, "_part long, _before long")
    return rows.join(F.broadcast(lead), part == F.col("_part")).select(*df.columns, (F.col("_before") + place).alias(name)), at


def discard(spark: SparkSession, *paths: str) -> None:
    """Remove staged tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)


def give_back() -> None:
    """Return freed memory of a worker process to the system, for workers outlive their tasks."""
    gc.collect()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def once_a_process(kind: str, key: str, make):
    """``make(key)``, kept for the later tasks of a worker process; of each kind the last one is kept.

    Functions travel to workers by value, so a global of a module that they name
    would not outlive a task: what is kept is held by a module of its own.
    """
    kept = sys.modules.setdefault("_propflow_kept", types.ModuleType("_propflow_kept")).__dict__
    found = kept.get(kind)
    if found is None or found[0] != key:
        found = kept[kind] = (key, make(key))
    return found[1]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(column: str = "text") -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def text_hash_of(df: DataFrame, column: str) -> Column:
    """Tells rows of one identifier but different texts apart."""
    return F.xxhash64(F.lit(5), F.coalesce(df[column].cast("string"), F.lit("")))


def keep_rows(docs: DataFrame, verdicts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs``, with all columns, that a verdict table keeps.

    ``verdicts`` has id, text_hash, group (what one row stays of) and kept, one
    row for each of ``docs``.  Where several rows of a group are alike in
    identifier, and so all kept, one of them stays.

    Rows are hashed to keys that are distinct, never sorted: their texts pass
    through the join one by one.
    """

    def on(rows: DataFrame, keys: DataFrame) -> Column:
        return rows[id_col].cast("long").eqNullSafe(keys["_id"]) & (text_hash_of(rows, text_col) == keys["_hash"])

    dropped = verdicts.where(~F.col("kept")).select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    tied = verdicts.where("kept").groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.first("id").alias("_id"), F.collect_set("text_hash").alias("hashes")).where("n > 1")
    left = docs.join(dropped.hint("shuffle_hash"), on(docs, dropped), "left_anti")
    tied, _ = staged(tied.select("_id", "group", F.explode("hashes").alias("_hash")).distinct(), "tied")
    if tied.isEmpty():
        return left
    again = left.join(tied, on(left, tied)).dropDuplicates(["group"]).select(*[left[c] for c in docs.columns])
    return left.join(tied, on(left, tied), "left_anti").unionByName(again)
