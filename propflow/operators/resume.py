"""Where a project can be taken up again: integrity of approvals, renders and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stages in order.
STAGES = ("curation", "scene_planning", "prompts", "generation_package", "clip_import", "quality_control", "rendering")


def _packed(digest: Column) -> Column:
    """A digest as bytes, half as many where it is 64 lower-case hex digits; equal for equal strings only."""
    raw = F.unhex(digest)
    return F.when((F.length(digest) == 64) & (F.lower(F.hex(raw)) == digest), F.concat(F.lit(b"\x01"), raw)).otherwise(F.concat(F.lit(b"\x00"), digest.cast("binary")))


def _unpacked(packed: Column) -> Column:
    rest = packed.substr(F.lit(2), F.octet_length(packed))
    return F.when(packed.substr(1, 1) == F.lit(b"\x01"), F.lower(F.hex(rest))).otherwise(rest.cast("string"))


def _digests(files: DataFrame, keys: list[str]) -> DataFrame:
    return files.select(*keys, _packed(F.col("sha256")).alias("_actual"))


def file_problems(tracked: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """Tracked files that are missing or changed."""
    met = tracked.select(*keys, _packed(F.col("sha256")).alias("_tracked")).join(_digests(files, keys), keys, "left")
    problem = F.when(F.col("_actual").isNull(), "missing").when(F.col("_actual") != F.col("_tracked"), "changed")
    return met.withColumn("problem", problem).where("problem IS NOT NULL").select(*keys, "problem")


def approvals(scenes: DataFrame, selections: DataFrame, clips: DataFrame, files: DataFrame, project: str) -> DataFrame:
    """Each scene with ``reason``, why its approval does not hold (null if it does), and ``is_error``.

    scenes: project, scene_id, dependency_hash.  selections: project, scene_id,
    status, compared, selected_clip_id, selected_sha256.  clips: project,
    clip_id, path, approved_copy_path, sha256, input_dependency_hash,
    input_dependency_valid.  files: project, path, sha256.
    """
    # Rows are narrowed before each shuffle: digests are packed, and go on only while they can matter.
    n = scenes.select(project, "scene_id", _packed(F.col("dependency_hash")).alias("_dependency"))
    early = F.when(~F.col("status").eqNullSafe(F.lit("approved")), "not_approved").when(~F.coalesce("compared", F.lit(False)), "not_compared")
    s = selections.select(project, "scene_id", F.col("selected_clip_id").alias("clip_id"), F.coalesce(early, F.lit("")).alias("_early"), F.when(early.isNull(), _packed(F.col("selected_sha256"))).alias("_selected"))
    c = clips.select(
        project, "clip_id", F.coalesce("approved_copy_path", "path").alias("path"), _packed(F.col("sha256")).alias("_clip"), _packed(F.col("input_dependency_hash")).alias("_input"),
        F.col("input_dependency_valid").eqNullSafe(F.lit(False)).alias("_invalid"),
    )
    chosen = n.join(s, [project, "scene_id"], "left").withColumn("_early", F.coalesce("_early", F.lit("not_approved")))
    chosen = chosen.withColumn("_dependency", F.when(F.col("_early") == "", F.col("_dependency")))
    found = chosen.join(c, [project, "clip_id"], "left").withColumn("_early", F.when((F.col("_early") == "") & F.col("_clip").isNull(), "no_clip").otherwise(F.col("_early")))
    sound = (F.col("_early") == "") & F.col("_clip").eqNullSafe(F.col("_selected"))
    late = F.when(F.col("_invalid"), "invalidated").when(~F.col("_input").eqNullSafe(F.col("_dependency")), "scene_changed")
    found = found.select(project, "path", "scene_id", "_early", late.alias("_late"), F.when(sound, F.col("_clip")).alias("_wanted"))
    met = found.join(_digests(files, [project, "path"]), [project, "path"], "left")
    reason = (
        F.when(F.col("_early") != "", F.col("_early"))
        .when(F.col("_actual").isNull(), "no_file")
        .when(~F.col("_actual").eqNullSafe(F.col("_wanted")), "file_changed")
        .otherwise(F.col("_late"))
    )
    error = reason.isin("not_compared", "no_clip", "no_file", "file_changed")
    return met.withColumns({"reason": reason, "is_error": F.coalesce(error, F.lit(False))}).select(project, "scene_id", "reason", "is_error", F.when(reason.isNull(), _unpacked(F.col("_actual"))).alias("preserved_sha256"))


def renders(projects: DataFrame, rendered: DataFrame, files: DataFrame, current: DataFrame, project: str) -> DataFrame:
    """Targets of each project, ``valid`` or ``stale``; the wide one is stale where there is no render of it.

    rendered: project, target, path, sha256, dependency_hash, fps.  current:
    project, target, dependency_hash as it would be now.
    """
    f = files.select(project, "path", F.col("sha256").alias("_actual"))
    now = current.select(project, "target", F.col("dependency_hash").alias("_now"))
    met = rendered.where(F.col("target").isin("16x9", "9x16")).join(f, [project, "path"], "left").join(now, [project, "target"], "left")
    good = F.col("_actual").eqNullSafe(F.col("sha256")) & F.coalesce("fps", F.lit(30)).between(1, 60) & F.col("dependency_hash").eqNullSafe(F.col("_now"))
    states = met.select(project, "target", F.when(good, "valid").otherwise("stale").alias("state"))
    lacking = projects.select(project).join(states.where("target = '16x9'"), project, "left_anti").select(project, F.lit("16x9").alias("target"), F.lit("stale").alias("state"))
    return states.unionByName(lacking)


def job_action(status: Column, job_id: Column) -> Column:
    """What to do about a job; never a new submission."""
    there = F.coalesce(job_id != "", F.lit(False))
    return (
        F.when(status.isin("submitted", "queued", "running") & there, "poll_existing")
        .when(status == "submission_pending", "reconcile_manually")
        .when(status.isin("failed", "rejected"), "retry_requires_new_consent")
        .when(status == "completed", "import_result_if_available")
        .otherwise("manual_review")
    )


def first_stage(selected: Column, scenes: Column, prompts: Column, packaged: Column, imported: Column, approved: Column, rendered: Column) -> Column:
    """The first stage that is not done, from counts and flags of a project.

    imported, approved: scenes with a clip, and with an approval that holds.
    """
    no = F.lit(False)
    return (
        F.when(~F.coalesce(selected > 0, no), "curation")
        .when(~F.coalesce(scenes > 0, no), "scene_planning")
        .when(~F.coalesce(prompts, no), "prompts")
        .when(~F.coalesce(packaged, no), "generation_package")
        .when(~F.coalesce(imported >= scenes, no), "clip_import")
        .when(~F.coalesce(approved >= scenes, no), "quality_control")
        .when(~F.coalesce(rendered, no), "rendering")
        .otherwise("complete")
    )


def preserved_stages(first: Column) -> Column:
    """Stages before the first that is not done; of quality control, what is approved."""
    stages = F.array(*[F.lit(s) for s in STAGES])
    at = F.array_position(stages, first).cast("int")
    before = F.when(at == 0, stages).otherwise(F.slice(stages, F.lit(1), F.greatest(at - 1, F.lit(0))))
    return F.when(first == "quality_control", F.concat(before, F.array(F.lit("quality_control_for_approved_scenes")))).otherwise(before)


def report(projects: DataFrame, scenes: DataFrame, approved: DataFrame, clips: DataFrame, targets: DataFrame, tracked: DataFrame, project: str) -> DataFrame:
    """One row a project: first stage not done, stages kept, scenes valid and not, and errors.

    projects: project, n_selected, prompts_complete, has_package.  approved,
    targets and tracked are results of the functions above.
    """
    by = approved.groupBy(project).agg(
        F.count(F.lit(1)).alias("n_scenes"),
        F.count_if(F.col("reason").isNull()).alias("n_valid"),
        F.array_sort(F.collect_list(F.when(F.col("reason").isNull(), F.col("scene_id")))).alias("valid_scene_ids"),
        F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.col("scene_id")))).alias("invalidated_scene_ids"),
        F.count_if("is_error").alias("n_approval_errors"),
    )
    got = scenes.select(project, "scene_id").join(clips.select(project, "scene_id").distinct(), [project, "scene_id"], "left_semi").groupBy(project).agg(F.count(F.lit(1)).alias("n_imported"))
    wide = targets.where("target = '16x9'").groupBy(project).agg(F.bool_or(F.col("state") == "valid").alias("rendered"))
    bad = tracked.groupBy(project).agg(F.count(F.lit(1)).alias("n_file_errors"))
    met = projects.join(by, project, "left").join(got, project, "left").join(wide, project, "left").join(bad, project, "left")
    zero = F.lit(0).cast("long")
    met = met.withColumns({c: F.coalesce(c, zero) for c in ("n_scenes", "n_valid", "n_imported", "n_approval_errors", "n_file_errors")})
    first = first_stage(F.col("n_selected"), F.col("n_scenes"), F.col("prompts_complete"), F.col("has_package"), F.col("n_imported"), F.col("n_valid"), F.col("rendered"))
    return met.withColumn("first_incomplete_stage", first).withColumns(
        {"preserved_stages": preserved_stages(F.col("first_incomplete_stage")), "valid": (F.col("n_approval_errors") + F.col("n_file_errors")) == 0}
    )
