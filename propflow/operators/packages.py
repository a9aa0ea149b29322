"""Generation packages: what a plan hands on for generation by hand, and the digest that names it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propflow.functions.hashing import array_json, double_json, int_json, object_json, text_json

#: What a package without a provider says of itself.
SCHEMA_VERSION, MODE = 1, "manual"
#: Suffix of a curated image whose source has none, and the folder of curated images.
NO_SUFFIX, CURATED = ".img", "generation-package/curated-images/"


def _listed(rows: DataFrame, project: str, item: dict, name: str) -> DataFrame:
    """JSON objects of a project's scenes as one array, in order; a plan has ten scenes at most."""
    ordered = F.array_sort(F.collect_list(F.struct("sequence_index", "scene_id", object_json(item).alias("t"))))
    return rows.groupBy(project).agg(array_json(F.transform(ordered, lambda x: x["t"])).alias(name))


def manifests(scenes: DataFrame, plans: DataFrame, project: str = "project_id") -> DataFrame:
    """(project, n_scenes, plan_dependency_hash, manifest, package_fingerprint), one a plan.

    scenes: project, scene_id, sequence_index, source_image_id, source_sha256,
    source_path, prompt_en, duration_seconds, aspect_ratio, dependency_hash.
    plans: project, revision.  The manifest is canonical JSON, and the
    fingerprint its digest; a plan without scenes has a manifest without entries.
    """
    place, scene = int_json(F.col("sequence_index")), text_json(F.col("scene_id"))
    suffix = F.lower(F.regexp_extract("source_path", r"[^/.][^/]*(\.[^./]+)$", 1))
    curated = F.concat(F.lit(CURATED), "scene_id", F.when(suffix == "", NO_SUFFIX).otherwise(suffix))
    entry = {
        "scene_id": scene,
        "sequence_index": place,
        "source_image_id": text_json(F.col("source_image_id")),
        "source_sha256": text_json(F.col("source_sha256")),
        "curated_image_path": text_json(curated),
        "prompt": text_json(F.col("prompt_en")),
        "duration_seconds": double_json(F.col("duration_seconds")),
        "ratio": text_json(F.col("aspect_ratio")),
        "expected_filename": text_json(F.concat("scene_id", F.lit(".mp4"))),
    }
    entries = _listed(scenes, project, entry, "entries")
    depends = _listed(scenes, project, {"scene_id": scene, "sequence_index": place, "dependency_hash": text_json(F.col("dependency_hash"))}, "depends")
    counted = scenes.groupBy(project).agg(F.count(F.lit(1)).alias("n_scenes"))
    met = plans.join(entries, project, "left").join(depends, project, "left").join(counted, project, "left").fillna("[]", ["entries", "depends"]).fillna(0, ["n_scenes"])
    hashed = met.withColumn("plan_dependency_hash", F.sha2(object_json({"plan_revision": int_json(F.col("revision")), "scenes": F.col("depends")}), 256))
    core = {
        "schema_version": int_json(F.lit(SCHEMA_VERSION)),
        "project_id": text_json(F.col(project)),
        "mode": text_json(F.lit(MODE)),
        "plan_dependency_hash": text_json(F.col("plan_dependency_hash")),
        "provider_configured": F.lit("false"),
        "external_generation_authorized": F.lit("false"),
        "entries": F.col("entries"),
    }
    told = hashed.withColumn("manifest", object_json(core))
    return told.select(project, "n_scenes", "plan_dependency_hash", "manifest", F.sha2("manifest", 256).alias("package_fingerprint"))
