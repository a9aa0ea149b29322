"""Image analyses: agreement with assets, and what they change in a project."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def coverage(assets: DataFrame, analyses: DataFrame, key: str) -> DataFrame:
    """Identifiers on one side only: ``missing`` from the analyses, ``unknown`` to the assets."""
    missing = assets.select(key).distinct().join(analyses.select(key), key, "left_anti").select(key, F.lit("missing").alias("side"))
    unknown = analyses.select(key).distinct().join(assets.select(key), key, "left_anti").select(key, F.lit("unknown").alias("side"))
    return missing.unionByName(unknown)


def path_conflicts(assets: DataFrame, analyses: DataFrame, key: str, path: str) -> DataFrame:
    """Rows that agree in identifier and differ in path (a null differs from a path)."""
    a, b = assets.alias("a"), analyses.alias("b")
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}")).where(~F.col(f"a.{path}").eqNullSafe(F.col(f"b.{path}"))).select(
        F.col(f"a.{key}").alias(key), F.col(f"a.{path}").alias("asset_path"), F.col(f"b.{path}").alias("analysis_path")
    )


def asset_map(assets: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest assets met with the digests of their files: ``state`` ok, changed or absent."""
    met = assets.join(files.select(F.col("path").alias("_path"), F.col("sha256").alias("_actual")), F.col("relative_path") == F.col("_path"), "left")
    state = F.when(F.col("_actual").isNull(), "absent").when(F.col("_actual") != F.col("sha256"), "changed").otherwise("ok")
    return met.withColumn("state", state).drop("_path", "_actual")


def apply_analysis(assets: DataFrame, analyses: DataFrame, rights: bool = False, reviewed: bool = False, pii_ids: tuple[str, ...] = ()) -> DataFrame:
    """Classifications with rights and privacy set, and an ordinal for the selected, by project."""
    from pyspark.sql import Window

    met = analyses.join(assets.select("project_id", "image_id", "sha256"), ["project_id", "image_id"])
    order = Window.partitionBy("project_id", "selected").orderBy("ord")
    return (
        met.withColumns(
            {
                "rights_confirmed": F.lit(rights),
                "pii_reviewed": F.lit(reviewed),
                "contains_pii": F.col("image_id").isin(*pii_ids) if pii_ids else F.lit(False),
                "selected": F.col("curation_status") == "selected",
            }
        )
        .withColumn("selected_ord", F.when(F.col("selected"), F.row_number().over(order) - 1))
    )


#: Stages that a new selection reopens.
REOPENED = ("scene_planning", "prompts", "generation_package", "clip_import", "quality_control", "rendering")


def reset_stages(stages: DataFrame, done: str = "curation", reopened: tuple[str, ...] = REOPENED) -> DataFrame:
    return stages.withColumn("status", F.when(F.col("stage") == done, "complete").when(F.col("stage").isin(*reopened), "pending").otherwise(F.col("status")))


def summary(frame: DataFrame, group: str, **flags) -> DataFrame:
    """Counts of rows, and of rows where each named condition holds, by group."""
    return frame.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(k) for k, c in flags.items()])
