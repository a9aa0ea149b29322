"""Project documents and ingestion manifests as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, document): JSON files, with ``document`` (a variant) null for text that is no JSON or repeats a key."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return files.withColumn("document", strict_json(F.col("content")))


def strict_json(text: Column) -> Column:
    """A variant; null for text that is no JSON, or has a key twice."""
    return F.try_parse_json(text)


def project_problem(document: Column, path: Column, expected_id: Column | None = None) -> Column:
    """Why a project file is refused: no document, or an id that is not its folder's name."""
    own = F.try_variant_get(document, "$.project_id", "string")
    folder = F.element_at(F.split(path, "/"), -2) if expected_id is None else expected_id
    return F.when(document.isNull(), "not_a_document").when(~own.eqNullSafe(folder), "project_id")


def collection(projects: DataFrame, document: str, key: str, path: str, fields: dict[str, str]) -> DataFrame:
    """Rows of a keyed or ordered collection of each project: ordinal or key, and typed fields.

    Records that are no objects are left out, as everywhere where records are indexed.
    """
    items = F.try_variant_get(F.col(document), path, "array<variant>")
    rows = projects.select(key, F.posexplode(items).alias("ord", "_item"))
    return rows.select(key, "ord", *[F.try_variant_get("_item", f"$.{f}", t).alias(f) for f, t in fields.items()])


def asset_integrity(assets: DataFrame, files: DataFrame, key: str = "project_id") -> DataFrame:
    """Manifest assets with ``problem``: id and digest differ, repeated, file absent or changed; null if sound."""
    from pyspark.sql import Window

    seen = F.count(F.lit(1)).over(Window.partitionBy(key, "asset_id"))
    met = assets.withColumn("_n", seen).join(files.select(key, F.col("path").alias("relative_path"), F.col("sha256").alias("_actual")), [key, "relative_path"], "left")
    problem = (
        F.when(~F.col("asset_id").eqNullSafe(F.col("sha256")), "id")
        .when(F.col("_n") > 1, "repeated")
        .when(F.col("_actual").isNull(), "absent")
        .when(F.col("_actual") != F.col("sha256"), "changed")
    )
    return met.withColumn("problem", problem).drop("_n", "_actual")
