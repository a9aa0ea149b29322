"""State transitions of projects: what one step of work turns tables into.

Each takes tables of many projects and gives tables; nothing is written here.
A caller publishes the results as a whole (sources.sinks) and appends a revision
of the project's document (operators.state).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propflow.functions.hashing import session_scope
from propflow.operators import assets, clips, gates, planning, quality, resume
from propflow.sources.images import probe_image


def ingest(existing: DataFrame, candidates: DataFrame, distance: int = 6, bits: int = 64) -> dict[str, DataFrame]:
    """Assets, rejected candidates and near duplicates after a batch.

    ``candidates``: sha256, position, relative_path, content, dhash, source
    struct, preferred.  Copies are hashed once, but each file's own suffix is
    held against its content.
    """
    probed = candidates.withColumn("probe", probe_image(F.col("relative_path"), F.col("content")))
    good = probed.where("probe.problem IS NULL").select("sha256", "position", "dhash", "source", "preferred", F.col("probe.format").alias("format"), F.col("probe.width").alias("width"), F.col("probe.height").alias("height"), F.octet_length("content").alias("size_bytes"))
    batch = assets.exact_assets(good).select("sha256", "first.dhash", "first.format", "first.width", "first.height", "first.size_bytes", "sources", "preferred", "exact_duplicate_count")
    after = assets.upsert(existing, batch)
    return {
        "assets": after,
        "rejected": probed.where("probe.problem IS NOT NULL").select("relative_path", F.col("probe.problem").alias("reason")),
        "near_duplicates": assets.near_pairs(after.select(F.col("sha256").alias("asset_id"), "dhash"), bits, distance),
    }


def plan(selected: DataFrame, previous: DataFrame, tombstones: DataFrame, seconds: float = 5.0, ratio: str = "16:9") -> dict[str, DataFrame]:
    """Scenes, new tombstones, changed scenes and projects whose render is undone.

    ``selected``: project_id, image_id, sha256, room_type, room_instance_id,
    sequence_index, additional_angle_value, camera_move, deformation_risk, and
    actual_sha256 of the file.  ``previous``: scenes as this gives them.
    """
    problem = planning.selection_problem(F.lit("photo"), F.col("room_type"), F.lit("selected"), F.col("sha256"), F.col("actual_sha256"))
    usable = selected.where(problem.isNull()).withColumnRenamed("sequence_index", "wanted_index")
    instance = F.coalesce("room_instance_id", F.concat_ws(":", "room_type", "image_id"))
    key = planning.scene_order(F.col("wanted_index"), planning.room_rank(F.col("room_type")), F.col("image_id"))
    chosen = planning.planned(usable, "project_id", key, instance, F.col("additional_angle_value"))
    named = planning.scene_ids(chosen, previous, tombstones, "project_id", "image_id")
    move = planning.camera_move(F.col("camera_move"), F.col("deformation_risk"), F.col("room_type"))
    scenes = named.withColumns({"camera_motion": move, "duration_seconds": F.lit(seconds), "aspect_ratio": F.lit(ratio)})
    scenes = scenes.withColumn("prompt_en", planning.prompt(F.col("camera_motion"), F.col("duration_seconds"), F.col("aspect_ratio")))
    digest = planning.scene_signature(*[F.col(c) for c in ("image_id", "sha256", "camera_motion", "duration_seconds", "aspect_ratio", "prompt_en")])
    scenes = scenes.withColumn("dependency_hash", digest)
    changed = planning.changed_scenes(previous, scenes, "project_id", "dependency_hash")
    return {
        "scenes": scenes,
        "tombstones": planning.new_tombstones(previous, scenes, tombstones, "project_id", "image_id"),
        "changed": changed,
        "render_undone": planning.render_undone(previous, scenes, changed, "project_id"),
    }


def import_clips(existing: DataFrame, files: DataFrame, scenes: DataFrame, tombstones: DataFrame, entries: DataFrame | None = None) -> dict[str, DataFrame]:
    """Clip records of imported files, and files that are refused, with the reason.

    The same bytes again give the record that is there.  ``entries``: project_id,
    scene_id, expected_filename of the scenes' package, where there is one.

    ``files``: project_id, scene_id, name, sha256, size_bytes, probe (struct), n
    (order).  A record that was invalidated stays so, even if its bytes come again.
    """
    keys = ["project_id", "scene_id"]
    about = scenes.select(*keys, "dependency_hash", F.col("duration_seconds").alias("_expected"), F.col("aspect_ratio").alias("_ratio"))
    if entries is None:
        named = about.withColumn("expected_filename", F.lit(None).cast("string"))
    else:
        named = clips.expected_filename(about, entries, keys)
    gone = tombstones.select(*keys).distinct().withColumn("_gone", F.lit(True))
    met = files.join(named.withColumn("_there", F.lit(True)), keys, "left").join(gone, keys, "left")
    active = F.coalesce("_there", F.lit(False)) & F.col("_gone").isNull()
    met = met.withColumn("reason", clips.refusal(F.col("size_bytes"), F.col("name"), F.col("expected_filename"), active))
    # files that are no clips take no number
    usable = met.where("reason IS NULL").drop("_there", "_gone", "expected_filename", "reason")
    numbered = clips.revisions(existing.select(*keys, "sha256", "revision"), usable, keys, ["n"]).where("NOT replayed")
    facts = numbered.withColumns(clips.probe_summary(F.col("probe")))
    issues = clips.technical_issues(F.col("video_stream_count"), F.col("duration_seconds"), F.col("_expected"), F.col("width"), F.col("height"), F.col("_ratio"), F.col("sample_aspect_ratio"))
    made = facts.withColumn("technical_issues", issues).withColumns(
        {
            "clip_id": F.concat(F.lit("clp_"), F.left(F.sha2(F.concat_ws(":", *keys, "sha256"), 256), F.lit(20))),
            "path": F.concat_ws("/", F.lit("scenes/imported"), "scene_id", clips.stored_name(F.col("revision"), F.col("sha256"), F.col("name"))),
            "technical_status": clips.technical_status(F.col("technical_issues")),
            "qc_status": clips.review_status(F.col("technical_issues")),
            "input_dependency_hash": F.col("dependency_hash"),
            "input_dependency_valid": F.lit(True),
        }
    )
    columns = [*keys, "clip_id", "revision", "path", "sha256", "technical_status", "technical_issues", "qc_status", "input_dependency_hash", "input_dependency_valid"]
    return {"clips": existing.select(*columns).unionByName(made.select(*columns)), "refused": met.where("reason IS NOT NULL").select(*keys, "name", "sha256", "reason")}


def record_reviews(reviews: DataFrame, existing: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """Reviews with why each is refused, and the selections that the others lead to.

    ``reviews``: project_id, scene_id, revision, status, issues, compared,
    evidence, n (order).  They are about the very revision they name.
    """
    keys = ["project_id", "scene_id"]
    # what the joins need not know is judged before them, so that they hold narrow rows
    cleaned = reviews.withColumn("issues", quality.clean_issues(F.col("issues")))
    cleaned = cleaned.withColumns({"_critical": F.size(quality.critical_issues(F.col("issues"))) > 0, "_lacking": quality.lacks_evidence(F.col("compared"), F.col("evidence"))})
    met = clips.find_revision(existing.select(*keys, "revision", "clip_id", "path", "sha256", "technical_status"), cleaned, keys)
    met = met.join(files.select("project_id", "path", F.col("sha256").alias("_actual")), ["project_id", "path"], "left")
    problem = quality.refusal(*[F.col(c) for c in ("status", "technical_status", "_critical", "sha256", "_actual", "_lacking")])
    judged = met.withColumn("problem", problem).drop("_actual", "_critical", "_lacking")
    return {"reviews": judged, "selections": quality.selections(judged.where("problem IS NULL"), keys, "n")}


def binding_reasons(pairs: list[tuple[str, Column, Column]]) -> list[Column]:
    """For named values of a signed scope and of the present manifest: the names where they differ."""
    return [F.when(~a.eqNullSafe(b), f"changed:{name}") for name, a, b in pairs]


def authorise(manifests: DataFrame, consents: DataFrame, entries: DataFrame, session: str | None) -> DataFrame:
    """Batches with all reasons against them; ``allowed`` only where there is none.

    manifests: batch, batch_fingerprint, payload, session_scope, cost_status,
    cost_amount, cost_budget, paid_retry.  A payload that does not have the
    fingerprint, or entries that are none, close the gate.
    """
    met = manifests.join(consents, "batch", "left").join(gates.entry_reasons(entries, ["batch"]), "batch", "left")
    scope = session_scope(F.lit(session).cast("string"))
    c = F.col
    reasons = [
        *gates.consent_reasons(c("batch_fingerprint"), c("consent_fingerprint"), c("consent_question"), c("approved"), scope, c("session_scope"), c("consent_scope")),
        *binding_reasons([("payload", F.sha2("payload", 256), c("batch_fingerprint"))]),
        *gates.cost_reasons(c("cost_status"), c("cost_amount"), c("cost_budget"), c("cost_question"), c("cost_confirmed"), c("cost_message"), c("risk_confirmed"), c("paid_retry"), c("retry_confirmed")),
    ]
    return met.withColumns(gates.verdict(reasons, c("entry_reasons"))).select("batch", "batch_fingerprint", "reasons", "allowed")


def render_inputs(scenes: DataFrame, selections: DataFrame, existing: DataFrame, files: DataFrame) -> DataFrame:
    """Approved clips in the order of scenes; a project with any scene that has none is left out whole."""
    held = resume.approvals(scenes, selections, existing, files, "project_id")
    short = held.where("reason IS NOT NULL").select("project_id").distinct()
    chosen = selections.select("project_id", "scene_id", F.col("selected_sha256").alias("clip_sha256"))
    return scenes.join(short, "project_id", "left_anti").join(chosen, ["project_id", "scene_id"])
