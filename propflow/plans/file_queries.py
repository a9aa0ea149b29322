"""Queries over real archives and files, which Spark makes from ``documents`` in the shared folder."""

from __future__ import annotations

import os
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propflow.operators.resume import file_problems
from propflow.plans.common import scratch, table
from propflow.sources.files import file_digests
from propflow.sources.zip_source import archives

_BUNDLE_SQL = "coalesce(source, 'none') || '-' || printf('%06d', doc_id // 1000)"


def _bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source whose numbers share a thousand go into one bundle."""
    bundle = F.format_string("%s-%06d", F.coalesce("source", F.lit("none")), F.floor(F.col("doc_id") / 1000))
    return table(spark, sf_dir, "documents").select(bundle.alias("bundle"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _zipped(spark: SparkSession, sf_dir: str) -> str:
    """A folder with an archive for each bundle, written by the tasks that hold them."""
    folder = scratch(spark)

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        path = f"{folder}/{rows.bundle.iloc[0]}.zip"
        with zipfile.ZipFile(f"{path}.{os.getpid()}", "w", zipfile.ZIP_DEFLATED) as archive:
            for doc_id, text in sorted(zip(rows.doc_id, rows.text)):
                archive.writestr(zipfile.ZipInfo(f"texts/{doc_id:012d}.txt"), text.encode(), zipfile.ZIP_DEFLATED)
        os.replace(f"{path}.{os.getpid()}", path)
        return pd.DataFrame({"path": [path]})

    _bundles(spark, sf_dir).groupBy("bundle").applyInPandas(write, "path string").write.format("noop").mode("overwrite").save()
    return folder


def archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives over 64 KiB are read by several tasks each; only members of a size in question are inflated."""
    where = [("file_size", ">=", 300), ("file_size", "<", 20_000), ("name", "suffix", ".txt")]
    return archives(spark, _zipped(spark, sf_dir), where, blockBytes=1 << 16, entries=1000, ratio=10_000).select("archive", "name", "file_size", "sha256", "damaged")


def file_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracked files that are absent or changed, by digests of the files themselves; some are tracked wrongly or not written."""
    folder = scratch(spark)

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        path = f"{folder}/{rows.bundle.iloc[0]}.bin"
        with open(f"{path}.{os.getpid()}", "wb") as f:
            for _, text in sorted(zip(rows.doc_id, rows.text)):
                f.write(text.encode())
        os.replace(f"{path}.{os.getpid()}", path)
        return pd.DataFrame({"path": [path]})

    rows = _bundles(spark, sf_dir)
    rows.where("substring(sha2(bundle, 256), 1, 1) <> '0'").groupBy("bundle").applyInPandas(write, "path string").write.format("noop").mode("overwrite").save()
    path = F.concat(F.lit(f"{folder}/"), F.col("bundle"), F.lit(".bin"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"]), "")
    wrong = F.when(F.substring(F.sha2("bundle", 256), 1, 1) == "1", " ").otherwise("")
    tracked = rows.groupBy("bundle").agg(text.alias("text")).select("bundle", path.alias("path"), F.sha2(F.concat("text", wrong), 256).alias("sha256"))
    problems = file_problems(tracked.select("path", "sha256"), file_digests(tracked.select("path")).where("problem IS NULL"), ["path"])
    return problems.select(F.regexp_extract("path", r"([^/]*)\.bin$", 1).alias("bundle"), "problem")


QUERIES = {f.__name__: f for f in (archive_members, file_integrity)}

SQL = {
    "archive_members": f"""
        SELECT {_BUNDLE_SQL} || '.zip' AS archive, 'texts/' || printf('%012d', doc_id) || '.txt' AS name, octet_length(encode(text))::BIGINT AS file_size, sha256(text) AS sha256, false AS damaged
        FROM documents WHERE octet_length(encode(text)) >= 300 AND octet_length(encode(text)) < 20000""",
    "file_integrity": f"""
        WITH b AS (SELECT DISTINCT {_BUNDLE_SQL} AS bundle FROM documents)
        SELECT bundle, CASE sha256(bundle)[1] WHEN '0' THEN 'missing' ELSE 'changed' END AS problem FROM b WHERE sha256(bundle)[1] IN ('0', '1')""",
}
