"""Queries over plans, clips, reviews, gates and resume reports, with their SQL.

The star-schema tables stand in for project records: conversations for scenes
(conversation = project, turn = place), events for clip, review and job records,
orders and lineitem for batches and their entries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propflow.functions.text import sample_times
from propflow.operators.assets import append_unique
from propflow.operators.clips import expected_filename, next_revision, review_status, revisions, technical_issues, technical_status
from propflow.operators.gates import batch_payload, cost_problem, cost_reasons, entries, submittable, verdict
from propflow.operators.packages import manifests
from propflow.operators.planning import (
    MOVES, MOVES_PL, PROMPT, ROOMS, camera_move, changed_scenes, contiguous, invalidate_clips, movement_text, plan_fingerprint, planned, prompt, render_undone, reorder, room_rank, scene_ids,
    scene_order, scene_signature, size_problem, tombstone,
)
from propflow.operators.profiles import aged, freshness
from propflow.operators.quality import critical_issues, selections, stage_complete
from propflow.operators.rendering import concat_list, dependency_hash, simple_filter
from propflow.operators.resume import approvals, file_problems, job_action, preserved_stages, renders, report
from propflow.operators.validation import column_rules
from propflow.plans.common import table
from propflow.sources.sinks import shot_list_markdown, shot_list_rows

NOW = "2024-01-20 00:00:00"


def _long(*names: str):
    return [F.col(n).cast("long").alias(n) for n in names]


def _scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as scenes, with a digest of what they show."""
    turns = table(spark, sf_dir, "conversations")
    return turns.select(
        F.col("conv_id").alias("project_id"),
        F.concat(F.lit("t"), F.col("turn").cast("string")).alias("scene_id"),
        F.col("turn").cast("int").alias("sequence_index"),
        "role",
        F.sha2("text", 256).alias("sha256"),
    )


def scene_contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contiguous(table(spark, sf_dir, "conversations"), "conv_id", "turn", "turn").select("conv_id", *_long("n"), "contiguous", "unique_ids")


_ROOM_SQL = "CASE lang WHEN 'en' THEN 'kitchen' WHEN 'fr' THEN 'exterior' WHEN 'de' THEN 'view' ELSE 'attic' END"


def scene_order_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    room = F.when(F.col("lang") == "en", "kitchen").when(F.col("lang") == "fr", "exterior").when(F.col("lang") == "de", "view").otherwise("attic")
    key = scene_order(F.when(F.col("toxic") == 1, F.col("n_chars")), room_rank(room), F.lpad(F.col("doc_id").cast("string"), 12, "0"))
    plan = planned(docs, "source", key, F.concat(room, F.lit(":"), F.col("n_chars").cast("string")), F.col("quality") == 1)
    return plan.select("source", "doc_id", *_long("sequence_index", "n_selected"), "unexplained_angle")


def scene_id_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    scenes = _scenes(spark, sf_dir).withColumnRenamed("sha256", "image")
    plan = scenes.groupBy("project_id", "image").agg(F.min("sequence_index").alias("sequence_index"))
    users = scenes.where("role = 'user'").groupBy("project_id", "image").agg(F.min("scene_id").alias("scene_id"))
    gone = scenes.where("role = 'system'")
    return scene_ids(plan, users, gone, "project_id", "image").select("project_id", "image", "scene_id", "reused")


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    old = _scenes(spark, sf_dir).where("role <> 'system'")
    new = _scenes(spark, sf_dir).where("sequence_index > 0 OR role = 'system'").withColumn("sha256", F.when(F.col("sequence_index") % 3 == 0, F.lit("edited")).otherwise(F.col("sha256")))
    return old, new


def scene_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changed_scenes(*_versions(spark, sf_dir), "project_id", "sha256")


def clip_invalidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = changed_scenes(*_versions(spark, sf_dir), "project_id", "sha256")
    clips = table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("project_id"), F.concat(F.lit("t"), (F.col("event_id") % 9).cast("string")).alias("scene_id"), (F.col("event_type") != "error").alias("input_dependency_valid")
    )
    return invalidate_clips(clips, changed, "project_id").select("event_id", "project_id", "scene_id", "input_dependency_valid")


def render_invalidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _versions(spark, sf_dir)
    return render_undone(old, new, changed_scenes(old, new, "project_id", "sha256"), "project_id")


def selective_dependency_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = (F.col("sequence_index") % 5 + 1).cast("double")
    signature = scene_signature(F.concat(F.lit("img_"), "sha256"), F.col("sha256"), F.col("role"), seconds, F.lit("16:9"), F.concat(F.lit('a "prompt" for '), "role"))
    return _scenes(spark, sf_dir).select("project_id", "scene_id", signature.alias("dependency_hash"))


def plan_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_fingerprint(_scenes(spark, sf_dir).withColumnRenamed("sha256", "dependency_hash"), "project_id").select("project_id", "plan_hash", *_long("n_scenes"))


def package_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package for each conversation, its turns as scenes; and one without scenes."""
    scenes = _scenes(spark, sf_dir).select(
        F.col("project_id").cast("string").alias("project_id"), "scene_id", "sequence_index", F.col("sha256").alias("source_image_id"), F.col("sha256").alias("source_sha256"),
        F.concat(F.lit("originals/"), "role", F.when(F.col("sequence_index") % 3 == 0, "").otherwise(".JPG")).alias("source_path"), F.concat(F.lit('a "still" of '), "role").alias("prompt_en"),
        (F.col("sequence_index") / 4 + 1).alias("duration_seconds"), F.lit("16:9").alias("aspect_ratio"), F.sha2("scene_id", 256).alias("dependency_hash"),
    )
    plans = scenes.groupBy("project_id").agg(F.max("sequence_index").alias("revision")).unionByName(spark.sql("SELECT 'none' AS project_id, 0L AS revision"))
    return manifests(scenes, plans).select("project_id", *_long("n_scenes"), "plan_dependency_hash", "package_fingerprint")


def plan_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = _scenes(spark, sf_dir).groupBy("project_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("role") == "system", F.lit("why"))).alias("reason"))
    return plans.select("project_id", "n", size_problem(F.col("n"), F.col("reason")).alias("problem"))


def scene_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    risk = F.when(F.col("p_size") > 40, "High").when(F.col("p_size") > 20, "low")
    room = F.element_at(F.array(*[F.lit(r) for r in ROOMS]), (F.col("p_partkey") % 20 + 1).cast("int"))
    asked = F.when(F.col("p_partkey") % 13 == 0, "subtle_slide_left").when(F.col("p_partkey") % 17 == 0, "zoom")
    move = camera_move(asked, risk, room)
    return table(spark, sf_dir, "part").select("p_partkey", move.alias("move"), movement_text(move, "pl").alias("movement_pl"), F.sha2(prompt(move, F.col("p_size") / 4 + 1, F.lit("9:16")), 256).alias("prompt_sha256"))


def scene_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    scenes = _scenes(spark, sf_dir).select("project_id", "scene_id", "sequence_index")
    listed = scenes.groupBy("project_id").agg(F.reverse(F.transform(F.array_sort(F.collect_list(F.struct("sequence_index", "scene_id"))), lambda x: x["scene_id"])).alias("ids"))
    orders = listed.select("project_id", F.when(F.col("project_id") % 4 == 0, F.slice("ids", 1, 2)).otherwise(F.col("ids")).alias("scene_ids"))
    return reorder(scenes, orders, "project_id").select("project_id", "scene_id", *_long("sequence_index"), "accepted")


def scene_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    scenes = _scenes(spark, sf_dir)
    removed = scenes.where("role = 'system'").select("project_id", "scene_id", F.lit("removed").alias("reason"))
    left, _ = tombstone(scenes, removed, "project_id")
    return left.select("project_id", "scene_id", *_long("sequence_index"))


def clip_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.sha2(F.concat("event_type", (F.floor("value") % 7).cast("string")), 256).alias("sha256"))
    old = events.where("1 = 0").select("user_id", "sha256", F.lit(0).alias("revision"))
    return revisions(old, events, ["user_id"], ["event_id"]).select("event_id", "user_id", *_long("revision"), "replayed")


def clip_next_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = table(spark, sf_dir, "events").select("user_id", "event_type", F.floor("value").cast("long").alias("revision"))
    return next_revision(clips, ["user_id", "event_type"])


def clip_technical_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    width, height = (F.col("l_quantity") * 100).cast("int"), F.when(F.col("l_linenumber") < 7, (F.col("l_quantity") * 56.25).cast("int"))
    issues = technical_issues(
        (F.col("l_linenumber") % 3).cast("int"), F.col("l_discount") * 100, F.lit(5.0), width, height, F.when(F.col("l_returnflag") == "A", "9:16").otherwise("16:9"), F.when(F.col("l_linestatus") == "F", "4:3")
    )
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = table(spark, sf_dir, "lineitem").select(*key, issues.alias("issues"))
    return rows.select(*key, F.array_join("issues", ",").alias("issues"), technical_status(F.col("issues")).alias("technical_status"), review_status(F.col("issues")).alias("qc_status"))


def sample_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.posexplode(sample_times(F.col("o_totalprice") / 1024)).alias("nth", "seconds")).select("o_orderkey", *_long("nth"), "seconds")


def expected_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    scenes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("scene_id"))
    named = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.concat("s_name", F.lit(".mov")).alias("expected_filename"))
    return expected_filename(scenes, named, ["key"])


def _reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "purchase", "approved").when(F.col("event_type") == "error", "rejected").otherwise("needs-manual-review")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("project_id"), F.concat(F.lit("t"), (F.floor("value") % 3).cast("string")).alias("scene_id"), "event_id", F.concat(F.lit("c"), (F.col("event_id") % 4).cast("string")).alias("clip_id"),
        (F.col("event_id") % 4).cast("int").alias("revision"), F.lit("x").alias("sha256"), status.alias("status"), (F.col("value") > 1).alias("compared"),
    )


def qc_selection_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = selections(_reviews(spark, sf_dir), ["project_id", "scene_id"], "event_id")
    return folded.withColumns({c: F.col(c).cast("long") for c in ("revision", "candidate_revision", "n_changes", "n_revoked")})


def qc_selection_fold_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reviews as those of one scene."""
    folded = selections(_reviews(spark, sf_dir).withColumn("scene_id", F.lit("hot")), ["scene_id"], "event_id")
    return folded.withColumns({c: F.col(c).cast("long") for c in ("revision", "candidate_revision", "n_changes", "n_revoked")})


def qc_stage_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over scenes of which an approval is the only kind of review counted."""
    done = _reviews(spark, sf_dir).where("status = 'approved'").select("project_id", "scene_id", "status", "compared")
    return stage_complete(_scenes(spark, sf_dir), done, "project_id").select("project_id", *_long("n_scenes", "n_approved"), "stage")


def issue_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    issue = F.when(F.col("event_type") == "error", "morphing").when(F.col("event_type") == "view", "duplicates").otherwise(F.col("event_type"))
    found = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_set(issue)).alias("issues"))
    return found.select("user_id", F.array_join("issues", ",").alias("issues"), F.array_join(critical_issues(F.col("issues")), ",").alias("critical"), F.array_join(append_unique(F.concat("issues", "issues")), ",").alias("unique_issues"))


def _resume_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """A project a customer: orders as scenes, their largest line as the selected clip, states from dates and flags."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("scene_id"), "o_orderstatus", "o_orderpriority", F.col("o_totalprice").cast("string").alias("h"))
    odd = F.col("scene_id") % 10
    scenes = orders.select("project_id", "scene_id", F.sha2(F.col("scene_id").cast("string"), 256).alias("dependency_hash"))
    sha = F.sha2("h", 256)
    chosen = orders.select(
        "project_id", "scene_id", F.when(F.col("o_orderstatus") == "P", "needs-manual-review").otherwise("approved").alias("status"), (F.col("o_orderpriority") != "5-LOW").alias("compared"),
        F.col("scene_id").alias("selected_clip_id"), sha.alias("selected_sha256"),
    )
    clips = orders.where("o_orderpriority <> '1-URGENT'").select(
        "project_id", "scene_id", F.col("scene_id").alias("clip_id"), F.concat(F.lit("a/"), F.col("scene_id").cast("string")).alias("path"), F.lit(None).cast("string").alias("approved_copy_path"), sha.alias("sha256"),
        F.when(odd == 3, F.lit("old")).otherwise(F.sha2(F.col("scene_id").cast("string"), 256)).alias("input_dependency_hash"), (odd != 4).alias("input_dependency_valid"),
    )
    files = orders.where(odd != 5).select("project_id", F.concat(F.lit("a/"), F.col("scene_id").cast("string")).alias("path"), F.when(odd == 6, F.lit("other")).otherwise(sha).alias("sha256"))
    projects = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("project_id"), F.when(F.col("c_acctbal") > 0, 1).otherwise(0).alias("n_selected"), (F.col("c_mktsegment") != "MACHINERY").alias("prompts_complete"), (F.col("c_nationkey") > 3).alias("has_package")
    )
    return {"projects": projects, "scenes": scenes, "selections": chosen, "clips": clips, "files": files}


def resume_approved_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _resume_tables(spark, sf_dir)
    return approvals(t["scenes"], t["selections"], t["clips"], t["files"], "project_id").select("project_id", "scene_id", "reason", "is_error")


def resume_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _resume_tables(spark, sf_dir)
    return file_problems(t["clips"].select("project_id", "path", "sha256"), t["files"], ["project_id", "path"])


def resume_first_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: the whole resume report of every project."""
    t = _resume_tables(spark, sf_dir)
    approved = approvals(t["scenes"], t["selections"], t["clips"], t["files"], "project_id")
    done = t["projects"].where("has_package").select("project_id", F.lit("16x9").alias("target"), F.lit("out.mp4").alias("path"), F.lit("r").alias("sha256"), F.lit("d").alias("dependency_hash"), F.lit(30).alias("fps"))
    there = done.select("project_id", "path", "sha256")
    targets = renders(t["projects"], done, there, done.select("project_id", "target", "dependency_hash"), "project_id")
    out = report(t["projects"], t["scenes"], approved, t["clips"], targets, resume_files(spark, sf_dir), "project_id")
    return out.select(
        "project_id", "first_incomplete_stage", F.array_join("preserved_stages", ",").alias("preserved_stages"), *_long("n_scenes", "n_valid", "n_imported", "n_approval_errors", "n_file_errors"), "valid"
    )


def job_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for x in ("signup", "submitted", "error", "failed", "purchase", "completed", "view", "submission_pending", "click", "cancelled")])
    job = F.when(F.col("event_id") % 3 == 0, F.lit("")).otherwise(F.col("event_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", job_action(kinds[F.col("event_type")], job).alias("action"))


def submission_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    intents = events.select(F.col("user_id").alias("scene_id"), (F.floor("value") % 5).cast("string").alias("batch_fingerprint")).distinct()
    jobs = events.select(F.col("user_id").alias("scene_id"), (F.floor(F.col("value") * 2) % 9).cast("string").alias("batch_fingerprint"), F.when(F.col("event_type") == "error", "queued").otherwise("failed").alias("status"))
    return submittable(intents, jobs)


def rights_pii_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    base = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("rights_confirmed"), F.lit(True).alias("pii_reviewed"), (F.col("toxic") == 1).alias("contains_pii"))
    over = docs.where("lang = 'de'").select("doc_id", F.lit(False).alias("rights_confirmed"), F.lit(None).cast("boolean").alias("pii_reviewed"), F.lit(None).cast("boolean").alias("contains_pii"))
    return entries(docs, base, over, ["doc_id"]).select("doc_id", "rights_status", "pii_status", "pii_reviewed")


def _cost_columns():
    status = F.when(F.col("o_orderstatus") == "F", "known").when(F.col("o_orderstatus") == "O", "unknown").otherwise("free")
    amount = F.when((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 10 != 0), F.col("o_totalprice") - 2000)
    budget = F.when(F.col("o_orderkey") % 7 != 0, F.lit(250000.0))
    return status, amount, budget


def cost_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, amount, budget = _cost_columns()
    return table(spark, sf_dir, "orders").select("o_orderkey", cost_problem(status, amount, budget).alias("problem"))


def generation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, amount, budget = _cost_columns()
    asked = F.when(F.col("o_orderpriority") > "2", "Czy potwierdzasz również wskazany koszt generowania?")
    reasons = cost_reasons(status, amount, budget, asked, F.col("o_orderpriority") > "3", F.lit(None).cast("string"), F.col("o_orderpriority") > "4", F.col("o_orderkey") % 2 == 0, F.lit(None).cast("boolean"))
    judged = table(spark, sf_dir, "orders").withColumns(verdict(reasons))
    return judged.select("o_orderkey", F.array_join("reasons", ",").alias("reasons"), "allowed")


def batch_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("part"))
    scenes = lines.select(
        "l_orderkey", F.col("l_linenumber").alias("sequence_index"), F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("scene_id"), F.sha2(F.col("part").cast("string"), 256).alias("original_sha256"),
        F.lit(None).cast("string").alias("upload_derivative_sha256"), F.lit(5.0).alias("duration_seconds"), F.lit("16:9").alias("aspect_ratio"),
    )
    from propflow.functions.hashing import int_json, text_json

    head = {"provider_name": text_json(F.lit("Żywy dostawca")), "retry_number": int_json(F.lit(0))}
    return batch_payload(scenes, ["l_orderkey"], head).select("l_orderkey", *_long("job_count"), "batch_fingerprint")


def render_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = _scenes(spark, sf_dir).select("project_id", "scene_id", "sequence_index", F.col("sha256").alias("clip_sha256"), F.when(F.col("role") == "user", "contain").otherwise("anchored_crop").alias("vertical_strategy"), F.lit(None).cast("string").alias("vertical_anchor"))
    return dependency_hash(inputs, "project_id", "16x9").unionByName(dependency_hash(inputs, "project_id", "9x16", 25))


def render_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("p_partkey") % 4
    strategy = F.when(kind == 0, "contain").when(kind == 3, F.when(F.col("p_partkey") % 8 == 3, "padded_background").otherwise("other")).otherwise("anchored_crop")
    anchor = F.when(kind == 1, "left").otherwise("bottom")
    return table(spark, sf_dir, "part").select("p_partkey", simple_filter(strategy, anchor, "9x16").alias("filter"))


def render_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _scenes(spark, sf_dir).withColumn("file", F.concat("role", F.lit("'s "), "scene_id", F.lit(".mp4")))
    return concat_list(names, "project_id", "file")


def profile_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit(NOW).cast("timestamp")
    seen = F.when(F.col("event_type") != "view", F.col("ts").cast("timestamp"))
    status = F.when(F.col("event_type") == "click", "blocked").otherwise("validated")
    return table(spark, sf_dir, "events").select("event_id", freshness(seen, now).alias("freshness"), aged(status, seen, now).alias("status"))


def shot_list_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shot_list_rows(_shots(spark, sf_dir)).withColumn("sequence_index", F.col("sequence_index").cast("long"))


def _shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scenes(spark, sf_dir).select(
        "project_id", "sequence_index", F.concat(F.col("project_id").cast("string"), F.lit("-"), "scene_id").alias("scene_id"), F.col("sha256").alias("source_image_id"), F.col("role").alias("room_type"),
        F.lit("static_hold").alias("camera_motion"), F.lit(2.5).alias("duration_seconds"), F.lit("16:9").alias("aspect_ratio"), F.concat(F.lit("hold, "), "role").alias("prompt_en"),
    )


def shot_list_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = shot_list_markdown(F.col("project_id").cast("string"), F.lit(None).cast("string"))
    return _shots(spark, sf_dir).groupBy("project_id").agg(F.sha2(text, 256).alias("sha256"))


ORDER_SCHEMA = {
    "type": "object",
    "required": ["o_orderkey", "o_orderstatus"],
    "properties": {
        "o_orderkey": {"type": "integer", "minimum": 10},
        "o_orderstatus": {"type": "string", "enum": ["F", "O"]},
        "o_totalprice": {"type": "number", "minimum": 5000, "maximum": 400000},
        "o_orderpriority": {"type": "string", "pattern": "^[1-4]-", "maxLength": 10},
    },
}


def schema_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", column_rules(ORDER_SCHEMA).alias("fault"))


QUERIES = {f.__name__: f for f in (
    scene_contiguity, scene_order_topk, scene_id_reuse, scene_diff, clip_invalidation, render_invalidation, selective_dependency_hash, plan_hash, package_manifests, plan_sizes, scene_prompts, scene_reorder, scene_tombstones,
    clip_revisions, clip_next_revision, clip_technical_issues, sample_timestamps, expected_files, qc_selection_fold, qc_selection_fold_hot, qc_stage_complete, issue_sets, resume_approved_chain, resume_files, resume_first_stage, job_actions,
    submission_allowed, rights_pii_gate, cost_gate, generation_gate, batch_fingerprint, render_fingerprint, render_filters, render_lists, profile_freshness, shot_list_csv, shot_list_text, schema_rules,
)}

_SCENES_SQL = "scenes AS (SELECT conv_id AS project_id, 't' || turn AS scene_id, turn AS sequence_index, role, sha256(text) AS sha256 FROM conversations)"
_VERSIONS_SQL = f"""{_SCENES_SQL}, old AS (SELECT * FROM scenes WHERE role <> 'system'),
  new AS (SELECT project_id, scene_id, sequence_index, role, CASE WHEN sequence_index % 3 = 0 THEN 'edited' ELSE sha256 END AS sha256 FROM scenes WHERE sequence_index > 0 OR role = 'system'),
  changed AS (SELECT coalesce(o.project_id, n.project_id) AS project_id, coalesce(o.scene_id, n.scene_id) AS scene_id,
      CASE WHEN o.project_id IS NULL THEN 'new' WHEN n.project_id IS NULL THEN 'removed' WHEN o.sha256 <> n.sha256 THEN 'changed' END AS change
    FROM old o FULL JOIN new n ON o.project_id = n.project_id AND o.scene_id = n.scene_id)"""
_COST_SQL = """c AS (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'known' WHEN 'O' THEN 'unknown' ELSE 'free' END AS status,
  CASE WHEN o_orderstatus = 'F' AND o_orderkey % 10 <> 0 THEN o_totalprice - 2000 END AS amount, CASE WHEN o_orderkey % 7 <> 0 THEN 250000.0::DOUBLE END AS budget FROM orders)"""
_RESUME_SQL = """o AS (SELECT o_custkey AS project_id, o_orderkey AS scene_id, o_orderkey % 10 AS odd, o_orderstatus, o_orderpriority FROM orders),
  a AS (SELECT project_id, scene_id, o_orderpriority <> '1-URGENT' AS imported, CASE WHEN o_orderstatus = 'P' THEN 'not_approved' WHEN o_orderpriority = '5-LOW' THEN 'not_compared'
      WHEN o_orderpriority = '1-URGENT' THEN 'no_clip' WHEN odd = 5 THEN 'no_file' WHEN odd = 6 THEN 'file_changed' WHEN odd = 4 THEN 'invalidated' WHEN odd = 3 THEN 'scene_changed' END AS reason FROM o),
  f AS (SELECT project_id, 'a/' || scene_id AS path, CASE odd WHEN 5 THEN 'missing' ELSE 'changed' END AS problem FROM o WHERE o_orderpriority <> '1-URGENT' AND odd IN (5, 6))"""

_MOVES_SQL = "CASE move " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in MOVES.items()) + " END"
_MOVES_PL_SQL = "CASE move " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in MOVES_PL.items()) + " END"
_ROOMS_SQL = "[" + ", ".join(f"'{r}'" for r in ROOMS) + "]"
_PROMPT_SQL = "printf('" + PROMPT.replace("'", "''") + f"', {_MOVES_SQL}, regexp_replace(regexp_replace(printf('%.6f', p_size / 4 + 1), '0+$', ''), '\\.$', ''), '9:16')"


def _render_sql(target: str, width: int, height: int, fps: int) -> str:
    wide = target == "16x9"
    strategy = "'contain'" if wide else "CASE WHEN role = 'user' THEN 'contain' ELSE 'anchored_crop' END"
    item = f"""'{{"clip_sha256":"' || sha256 || '","scene_id":"' || scene_id || '","sequence_index":' || sequence_index || ',"vertical_anchor":"center","vertical_strategy":"' || {strategy} || '"}}'"""
    head = '{"audio":"none","codec":"h264","fps":' + str(fps) + f',"height":{height},"inputs":['
    tail = '],"overlays":"none","pixel_format":"yuv420p","sample_aspect_ratio":"1:1","target":"' + target + f'","transition":"hard_cut","width":{width}}}'
    return f"""SELECT project_id, '{target}' AS target, count(DISTINCT sequence_index) = count(*) AND min(sequence_index) = 0 AND max(sequence_index) = count(*) - 1 AS complete,
      sha256('{head}' || string_agg({item}, ',' ORDER BY sequence_index) || '{tail}') AS dependency_hash FROM scenes GROUP BY project_id"""


_REVIEWS_SQL = """e AS (SELECT user_id AS project_id, 't' || (floor(value)::BIGINT % 3) AS scene_id, event_id, 'c' || (event_id % 4) AS clip_id, event_id % 4 AS revision, 'x' AS sha256,
      CASE event_type WHEN 'purchase' THEN 'approved' WHEN 'error' THEN 'rejected' ELSE 'needs-manual-review' END AS status, coalesce(value > 1, false) AS compared FROM events)"""


def _fold_sql(reviews: str, keys: str) -> str:
    """The rules of review, one review after the other."""
    held, approves = "f.status = 'approved'", "e.status = 'approved'"
    state = lambda chosen, noted, left: f"CASE WHEN {approves} THEN {chosen} WHEN coalesce({held}, false) AND f.clip <> e.clip_id THEN {noted} ELSE {left} END"
    none = "NULL::VARCHAR AS status, NULL::VARCHAR AS clip, NULL::BIGINT AS revision, NULL::VARCHAR AS sha256, NULL::BOOLEAN AS compared, NULL::VARCHAR AS candidate_status, NULL::VARCHAR AS candidate_clip, NULL::BIGINT AS candidate_revision"
    return f"""WITH RECURSIVE {_REVIEWS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY event_id) AS k FROM {reviews}),
      f AS (SELECT DISTINCT {keys}, 0::BIGINT AS k, {none}, 0::BIGINT AS n_changes, 0::BIGINT AS n_revoked FROM n
        UNION ALL SELECT {', '.join('f.' + k.strip() for k in keys.split(','))}, e.k, {state("'approved'", 'f.status', 'e.status')}, {state('e.clip_id', 'f.clip', 'NULL')}, {state('e.revision', 'f.revision', 'NULL')},
          {state('e.sha256', 'f.sha256', 'NULL')}, {state('e.compared', 'f.compared', 'NULL')}, {state('NULL', 'e.status', 'NULL')}, {state('NULL', 'e.clip_id', 'e.clip_id')}, {state('NULL', 'e.revision', 'e.revision')},
          f.n_changes + CASE WHEN {approves} AND NOT (coalesce({held}, false) AND f.clip = e.clip_id) THEN 1 ELSE 0 END,
          f.n_revoked + CASE WHEN NOT {approves} AND coalesce({held}, false) AND f.clip = e.clip_id THEN 1 ELSE 0 END
        FROM f JOIN n e ON e.k = f.k + 1 AND {' AND '.join(f'e.{k.strip()} = f.{k.strip()}' for k in keys.split(','))})
      SELECT * EXCLUDE (k) FROM f QUALIFY k = max(k) OVER (PARTITION BY {keys})"""


SQL = {
    "qc_selection_fold": _fold_sql("e", "project_id, scene_id"),
    "qc_selection_fold_hot": _fold_sql("(SELECT * REPLACE ('hot' AS scene_id) FROM e)", "scene_id"),
    "scene_contiguity": """SELECT conv_id, count(*) AS n, count(DISTINCT turn) = count(*) AND min(turn) = 0 AND max(turn) = count(*) - 1 AS contiguous, count(DISTINCT turn) = count(*) AS unique_ids
        FROM conversations GROUP BY conv_id""",
    "scene_order_topk": f"""
        WITH d AS (SELECT d.doc_id, source, n_chars, {_ROOM_SQL} AS room, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
        k AS (SELECT *, CASE WHEN toxic = 1 THEN 0 ELSE 1 END AS a, CASE WHEN toxic = 1 THEN n_chars ELSE CASE room WHEN 'exterior' THEN 0 WHEN 'kitchen' THEN 5 WHEN 'view' THEN 18 ELSE 999 END END AS b FROM d),
        r AS (SELECT *, row_number() OVER (PARTITION BY source, room || ':' || n_chars ORDER BY a, b, doc_id) > 1 AND NOT coalesce(quality = 1, false) AS bad,
              row_number() OVER (PARTITION BY source ORDER BY a, b, doc_id) - 1 AS sequence_index, count(*) OVER (PARTITION BY source) AS n_selected FROM k),
        w AS (SELECT *, bool_or(bad) OVER (PARTITION BY source) AS unexplained_angle FROM r)
        SELECT source, doc_id, sequence_index, n_selected, unexplained_angle FROM w WHERE sequence_index < 10""",
    "scene_id_reuse": f"""
        WITH {_SCENES_SQL}, p AS (SELECT DISTINCT project_id, sha256 AS image FROM scenes),
        u AS (SELECT project_id, sha256 AS image, min(scene_id) AS scene_id FROM scenes WHERE role = 'user' GROUP BY 1, 2),
        g AS (SELECT project_id, sha256 AS image, count(*) AS n FROM scenes WHERE role = 'system' GROUP BY 1, 2)
        SELECT p.project_id, p.image, coalesce(u.scene_id, 'scn_' || left(sha256(p.project_id || ':' || p.image || ':' || coalesce(g.n, 0)), 20)) AS scene_id, u.scene_id IS NOT NULL AS reused
        FROM p LEFT JOIN u ON p.project_id = u.project_id AND p.image = u.image LEFT JOIN g ON p.project_id = g.project_id AND p.image = g.image""",
    "scene_diff": f"WITH {_VERSIONS_SQL} SELECT * FROM changed WHERE change IS NOT NULL",
    "clip_invalidation": f"""
        WITH {_VERSIONS_SQL} SELECT e.event_id, e.user_id AS project_id, 't' || e.event_id % 9 AS scene_id,
          e.event_type <> 'error' AND NOT EXISTS (SELECT 1 FROM changed c WHERE c.change IS NOT NULL AND c.project_id = e.user_id AND c.scene_id = 't' || e.event_id % 9) AS input_dependency_valid FROM events e""",
    "render_invalidation": f"""
        WITH {_VERSIONS_SQL} SELECT DISTINCT project_id FROM changed WHERE change IS NOT NULL""",
    "selective_dependency_hash": f"""
        WITH {_SCENES_SQL} SELECT project_id, scene_id, sha256('{{"aspect_ratio":"16:9","camera_motion":"' || role || '","duration_seconds":' || (sequence_index % 5 + 1) || '.0,"prompt_en":"a \\"prompt\\" for ' || role ||
          '","source_image_id":"img_' || sha256 || '","source_sha256":"' || sha256 || '"}}') AS dependency_hash FROM scenes""",
    "plan_hash": f"""
        WITH {_SCENES_SQL} SELECT project_id, sha256('[' || string_agg('{{"dependency_hash":"' || sha256 || '","scene_id":"' || scene_id || '","sequence_index":' || sequence_index || '}}', ',' ORDER BY sequence_index) || ']') AS plan_hash,
          count(*) AS n_scenes FROM scenes GROUP BY project_id""",
    "package_manifests": f"""
        WITH {_SCENES_SQL}, e AS (SELECT project_id, sequence_index, scene_id, '{{"curated_image_path":"generation-package/curated-images/' || scene_id || CASE sequence_index % 3 WHEN 0 THEN '.img' ELSE '.jpg' END
          || '","duration_seconds":' || (sequence_index / 4 + 1)::DOUBLE::VARCHAR || ',"expected_filename":"' || scene_id || '.mp4","prompt":"a \\"still\\" of ' || role || '","ratio":"16:9","scene_id":"' || scene_id || '","sequence_index":' || sequence_index
          || ',"source_image_id":"' || sha256 || '","source_sha256":"' || sha256 || '"}}' AS entry,
          '{{"dependency_hash":"' || sha256(scene_id) || '","scene_id":"' || scene_id || '","sequence_index":' || sequence_index || '}}' AS depends FROM scenes),
        p AS (SELECT project_id::VARCHAR AS project_id, count(*) AS n_scenes, max(sequence_index) AS revision, string_agg(entry, ',' ORDER BY sequence_index) AS entries, string_agg(depends, ',' ORDER BY sequence_index) AS depends FROM e GROUP BY project_id
          UNION ALL SELECT 'none', 0, 0, '', ''),
        h AS (SELECT *, sha256('{{"plan_revision":' || revision || ',"scenes":[' || depends || ']}}') AS plan_dependency_hash FROM p)
        SELECT project_id, n_scenes, plan_dependency_hash, sha256('{{"entries":[' || entries || '],"external_generation_authorized":false,"mode":"manual","plan_dependency_hash":"' || plan_dependency_hash
          || '","project_id":"' || project_id || '","provider_configured":false,"schema_version":1}}') AS package_fingerprint FROM h""",
    "plan_sizes": f"""
        WITH {_SCENES_SQL} SELECT project_id, count(*) AS n, CASE WHEN count(*) > 10 THEN 'too_many' WHEN count(*) < 6 AND NOT bool_or(role = 'system') THEN 'reason_needed' END AS problem FROM scenes GROUP BY project_id""",
    "scene_prompts": f"""
        WITH m AS (SELECT *, {_ROOMS_SQL}[p_partkey % 20 + 1] AS room FROM part),
        n AS (SELECT *, CASE WHEN p_partkey % 13 = 0 THEN 'subtle_slide_left' WHEN p_partkey % 17 = 0 THEN NULL WHEN p_size > 40 THEN 'static_hold' WHEN room IN ('exterior', 'garden', 'view', 'terrace', 'balcony') THEN 'gentle_pan_right'
              ELSE 'slow_push_in' END AS move FROM m)
        SELECT p_partkey, move, {_MOVES_PL_SQL} AS movement_pl, sha256({_PROMPT_SQL.replace(_MOVES_SQL, f"coalesce({_MOVES_SQL}, 'null')")}) AS prompt_sha256 FROM n""",
    "scene_reorder": f"""
        WITH {_SCENES_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY project_id) AS n FROM scenes)
        SELECT project_id, scene_id, CASE WHEN project_id % 4 = 0 AND n > 2 THEN sequence_index ELSE n - 1 - sequence_index END AS sequence_index, NOT (project_id % 4 = 0 AND n > 2) AS accepted FROM n""",
    "scene_tombstones": f"""
        WITH {_SCENES_SQL} SELECT project_id, scene_id, row_number() OVER (PARTITION BY project_id ORDER BY sequence_index) - 1 AS sequence_index FROM scenes WHERE role <> 'system'""",
    "clip_revisions": """
        WITH e AS (SELECT event_id, user_id, event_type || (floor(value)::BIGINT % 7) AS h FROM events),
        f AS (SELECT *, min(event_id) OVER (PARTITION BY user_id, h) AS first FROM e),
        r AS (SELECT user_id, h, dense_rank() OVER (PARTITION BY user_id ORDER BY first) AS revision FROM (SELECT DISTINCT user_id, h, first FROM f))
        SELECT f.event_id, f.user_id, r.revision, f.event_id <> f.first AS replayed FROM f JOIN r ON f.user_id = r.user_id AND f.h = r.h""",
    "clip_next_revision": "SELECT user_id, event_type, max(floor(value)::BIGINT) + 1 AS next_revision FROM events GROUP BY 1, 2",
    "clip_technical_issues": """
        WITH p AS (SELECT *, (l_quantity * 100)::INT AS w, CASE WHEN l_linenumber < 7 THEN floor(l_quantity * 56.25)::INT END AS h, l_discount * 100 AS d, l_linenumber % 3 AS s FROM lineitem),
        i AS (SELECT *, list_filter([
            CASE WHEN w IS NULL OR h IS NULL OR w <= 0 OR h <= 0 THEN NULL WHEN abs(w::DOUBLE / h - CASE WHEN l_returnflag = 'A' THEN 9.0::DOUBLE / 16 ELSE 16.0::DOUBLE / 9 END) > 0.04 THEN 'aspect_ratio_mismatch' END,
            CASE WHEN d > 0 AND abs(d - 5.0) > 0.75 THEN 'duration_mismatch' END, CASE WHEN d <= 0 THEN 'duration_missing' END,
            CASE WHEN l_linestatus = 'F' THEN 'non_square_pixels' END,
            CASE WHEN w IS NULL OR h IS NULL OR w <= 0 OR h <= 0 THEN 'resolution_missing' END,
            CASE WHEN d <= 0 OR s <= 0 THEN 'sample_frames_unavailable' END,
            CASE WHEN s <> 1 THEN 'video_stream_count' END], lambda x: x IS NOT NULL) AS found FROM p),
        t AS (SELECT *, CASE WHEN list_has_any(found, ['video_stream_count', 'duration_missing', 'resolution_missing', 'sample_frames_unavailable']) THEN 'failed' WHEN len(found) = 0 THEN 'passed' ELSE 'needs-manual-review' END AS technical_status FROM i)
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, array_to_string(found, ',') AS issues, technical_status, CASE WHEN technical_status = 'failed' THEN 'rejected' ELSE 'needs-manual-review' END AS qc_status FROM t""",
    "sample_timestamps": """
        WITH d AS (SELECT o_orderkey, o_totalprice / 1024 AS d FROM orders)
        SELECT o_orderkey, unnest(range(5)) AS nth, unnest([0.0::DOUBLE, d * 0.25::DOUBLE, d * 0.5::DOUBLE, d * 0.75::DOUBLE, greatest(0.0::DOUBLE, d - least(0.04::DOUBLE, d / 10))]) AS seconds FROM d""",
    "expected_files": "SELECT c_custkey AS key, c_name AS scene_id, coalesce(s_name || '.mov', c_name || '.mp4') AS expected_filename FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey",
    "qc_stage_complete": f"""
        WITH {_SCENES_SQL}, g AS (SELECT DISTINCT user_id AS project_id, 't' || (floor(value)::BIGINT % 3) AS scene_id FROM events WHERE event_type = 'purchase' AND value > 1)
        SELECT s.project_id, count(*) AS n_scenes, count(g.scene_id) AS n_approved, CASE WHEN count(*) = count(g.scene_id) THEN 'complete' ELSE 'pending' END AS stage
        FROM scenes s LEFT JOIN g ON s.project_id = g.project_id AND s.scene_id = g.scene_id GROUP BY s.project_id""",
    "issue_sets": """
        WITH e AS (SELECT DISTINCT user_id, CASE event_type WHEN 'error' THEN 'morphing' WHEN 'view' THEN 'duplicates' ELSE event_type END AS i FROM events)
        SELECT user_id, string_agg(i, ',' ORDER BY i) AS issues, coalesce(string_agg(i, ',' ORDER BY i) FILTER (WHERE i IN ('morphing', 'duplicates')), '') AS critical, string_agg(i, ',' ORDER BY i) AS unique_issues FROM e GROUP BY user_id""",
    "resume_approved_chain": f"WITH {_RESUME_SQL} SELECT project_id, scene_id, reason, coalesce(reason IN ('not_compared', 'no_clip', 'no_file', 'file_changed'), false) AS is_error FROM a",
    "resume_files": f"WITH {_RESUME_SQL} SELECT * FROM f",
    "resume_first_stage": f"""
        WITH {_RESUME_SQL}, b AS (SELECT project_id, count(*) AS n, count(*) FILTER (WHERE reason IS NULL) AS v, count(*) FILTER (WHERE imported) AS i,
            count(*) FILTER (WHERE reason IN ('not_compared', 'no_clip', 'no_file', 'file_changed')) AS e FROM a GROUP BY project_id),
        g AS (SELECT project_id, count(*) AS fe FROM f GROUP BY project_id),
        m AS (SELECT c_custkey AS project_id, c_acctbal > 0 AS sel, c_mktsegment <> 'MACHINERY' AS prompts, c_nationkey > 3 AS packed, coalesce(n, 0) AS n_scenes, coalesce(v, 0) AS n_valid, coalesce(i, 0) AS n_imported,
            coalesce(e, 0) AS n_approval_errors, coalesce(fe, 0) AS n_file_errors FROM customer LEFT JOIN b ON c_custkey = b.project_id LEFT JOIN g ON c_custkey = g.project_id),
        s AS (SELECT *, CASE WHEN NOT sel THEN 'curation' WHEN n_scenes = 0 THEN 'scene_planning' WHEN NOT prompts THEN 'prompts' WHEN NOT packed THEN 'generation_package' WHEN n_imported < n_scenes THEN 'clip_import'
            WHEN n_valid < n_scenes THEN 'quality_control' ELSE 'complete' END AS first_incomplete_stage FROM m)
        SELECT project_id, first_incomplete_stage, CASE first_incomplete_stage WHEN 'curation' THEN '' WHEN 'scene_planning' THEN 'curation' WHEN 'prompts' THEN 'curation,scene_planning'
            WHEN 'generation_package' THEN 'curation,scene_planning,prompts' WHEN 'clip_import' THEN 'curation,scene_planning,prompts,generation_package'
            WHEN 'quality_control' THEN 'curation,scene_planning,prompts,generation_package,clip_import,quality_control_for_approved_scenes'
            ELSE 'curation,scene_planning,prompts,generation_package,clip_import,quality_control,rendering' END AS preserved_stages,
          n_scenes, n_valid, n_imported, n_approval_errors, n_file_errors, n_approval_errors + n_file_errors = 0 AS valid FROM s""",
    "job_actions": """
        SELECT event_id, CASE event_type WHEN 'signup' THEN CASE WHEN event_id % 3 = 0 THEN 'manual_review' ELSE 'poll_existing' END WHEN 'error' THEN 'retry_requires_new_consent' WHEN 'purchase' THEN 'import_result_if_available'
          WHEN 'view' THEN 'reconcile_manually' ELSE 'manual_review' END AS action FROM events""",
    "submission_allowed": """
        SELECT DISTINCT user_id AS scene_id, (floor(value)::BIGINT % 5)::VARCHAR AS batch_fingerprint FROM events e
        WHERE NOT EXISTS (SELECT 1 FROM events j WHERE j.event_type = 'error' AND j.user_id = e.user_id AND floor(j.value * 2)::BIGINT % 9 = floor(e.value)::BIGINT % 5)""",
    "rights_pii_gate": """
        SELECT d.doc_id, CASE WHEN lang <> 'de' AND quality = 1 THEN 'confirmed' ELSE 'unconfirmed' END AS rights_status,
          CASE WHEN toxic = 1 THEN 'contains_pii' WHEN l.doc_id IS NOT NULL THEN 'clear' ELSE 'unreviewed' END AS pii_status, l.doc_id IS NOT NULL AS pii_reviewed
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "cost_gate": f"""
        WITH {_COST_SQL} SELECT o_orderkey, CASE WHEN status = 'free' THEN 'status' WHEN amount < 0 THEN 'amount' WHEN status = 'known' AND amount IS NULL THEN 'amount_needed'
          WHEN status = 'known' AND amount > budget THEN 'over_budget' END AS problem FROM c""",
    "generation_gate": f"""
        WITH {_COST_SQL}, p AS (SELECT *, status <> 'known' OR coalesce(amount < 0, true) OR amount > 0 AS paid, coalesce(amount >= 0, false) AS good FROM c),
        r AS (SELECT o_orderkey, list_filter([CASE WHEN status = 'free' THEN 'cost_status' END, CASE WHEN status = 'known' AND NOT good THEN 'cost_amount' END,
            CASE WHEN status = 'known' AND good AND amount > budget THEN 'over_budget' END, CASE WHEN paid AND NOT o_orderpriority > '2' THEN 'cost_question' END,
            CASE WHEN paid AND NOT o_orderpriority > '3' THEN 'cost_not_confirmed' END, CASE WHEN status = 'unknown' THEN 'unknown_cost_message' END,
            CASE WHEN status = 'unknown' AND NOT o_orderpriority > '4' THEN 'risk_not_confirmed' END, CASE WHEN o_orderkey % 2 = 0 AND paid THEN 'retry_not_confirmed' END], lambda x: x IS NOT NULL) AS found FROM p)
        SELECT o_orderkey, array_to_string(found, ',') AS reasons, len(found) = 0 AS allowed FROM r""",
    "batch_fingerprint": """
        WITH l AS (SELECT l_orderkey, l_linenumber AS n, sha256(max(l_partkey)::VARCHAR) AS h FROM lineitem GROUP BY 1, 2)
        SELECT l_orderkey, count(*) AS job_count, sha256('{"assets":[' || string_agg('{"aspect_ratio":"16:9","duration_seconds":5.0,"original_sha256":"' || h || '","scene_id":"s' || n || '","upload_derivative_sha256":null}', ',' ORDER BY n) ||
          '],"job_count":' || count(*) || ',"provider_name":"Żywy dostawca","retry_number":0,"scene_ids":[' || string_agg('"s' || n || '"', ',' ORDER BY n) || ']}') AS batch_fingerprint FROM l GROUP BY l_orderkey""",
    "render_fingerprint": f"WITH {_SCENES_SQL} {_render_sql('16x9', 1920, 1080, 30)} UNION ALL {_render_sql('9x16', 1080, 1920, 25)}",
    "render_filters": """
        SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'scale=1080:1920:force_original_aspect_ratio=decrease:flags=lanczos,pad=1080:1920:(ow-iw)/2:(oh-ih)/2:color=black,setsar=1,fps=30,format=yuv420p'
          WHEN 1 THEN 'scale=1080:1920:force_original_aspect_ratio=increase:flags=lanczos,crop=1080:1920:0:(ih-oh)/2,setsar=1,fps=30,format=yuv420p'
          WHEN 2 THEN 'scale=1080:1920:force_original_aspect_ratio=increase:flags=lanczos,crop=1080:1920:(iw-ow)/2:ih-oh,setsar=1,fps=30,format=yuv420p'
          WHEN 3 THEN CASE p_partkey % 8 WHEN 3 THEN '[0:v]split=2[background][foreground];[background]scale=1080:1920:force_original_aspect_ratio=increase:flags=lanczos,crop=1080:1920,boxblur=20:10[blurred];[foreground]scale=1080:1920:force_original_aspect_ratio=decrease:flags=lanczos[front];[blurred][front]overlay=(W-w)/2:(H-h)/2,setsar=1,fps=30,format=yuv420p[out]' END END AS filter FROM part""",
    "render_lists": f"""
        WITH {_SCENES_SQL} SELECT project_id, string_agg('file ''' || role || '''\\''''s ' || scene_id || '.mp4''', chr(10) ORDER BY sequence_index) || chr(10) AS list FROM scenes GROUP BY project_id""",
    "profile_freshness": f"""
        WITH e AS (SELECT *, CASE WHEN event_type = 'view' THEN 'unverified' WHEN ts > TIMESTAMP '{NOW}' + INTERVAL 5 MINUTES THEN 'future' WHEN TIMESTAMP '{NOW}' > ts + INTERVAL 7 DAYS THEN 'stale' ELSE 'fresh' END AS freshness FROM events)
        SELECT event_id, freshness, CASE WHEN event_type = 'click' THEN 'blocked' WHEN freshness = 'stale' THEN 'stale' ELSE 'validated' END AS status FROM e""",
    "shot_list_csv": f"""
        WITH {_SCENES_SQL} SELECT sequence_index, project_id || '-' || scene_id AS scene_id, sha256 AS source_image_id, role AS room_type, 'static_hold' AS camera_move, 2.5::DOUBLE AS duration_seconds, '16:9' AS ratio,
          'nie_uruchomiono' AS generation_status, 'wymaga_kontroli_manualnej' AS qc_status, project_id || '-' || scene_id || '.mp4' AS expected_filename, 'hold, ' || role AS prompt FROM scenes""",
    "shot_list_text": f"""
        WITH {_SCENES_SQL}, t AS (SELECT project_id, sequence_index, '## ' || (sequence_index + 1) || '. ' || project_id || '-' || scene_id || E'\\n\\n- Typ pomieszczenia: `' || role || E'`\\n- Ruch kamery: static_hold\\n- Czas trwania: 2.5 s\\n- Format: `16:9`\\n- Status generowania: `nie_uruchomiono`\\n- Status kontroli jakości: `wymaga_kontroli_manualnej`\\n\\n```text\\nhold, ' || role || E'\\n```\\n' AS s FROM scenes)
        SELECT project_id, sha256(E'# Lista ujęć walkthrough\\n\\nProjekt: `' || project_id || E'`\\n\\n' || string_agg(s, chr(10) ORDER BY sequence_index)) AS sha256 FROM t GROUP BY project_id""",
    "schema_rules": """
        SELECT o_orderkey, CASE WHEN o_orderkey < 10 THEN '$[''o_orderkey'']: minimum' WHEN o_orderstatus NOT IN ('F', 'O') THEN '$[''o_orderstatus'']: enum' WHEN o_totalprice < 5000 THEN '$[''o_totalprice'']: minimum'
          WHEN o_totalprice > 400000 THEN '$[''o_totalprice'']: maximum' WHEN length(o_orderpriority) > 10 THEN '$[''o_orderpriority'']: maxLength' WHEN NOT regexp_matches(o_orderpriority, '^[1-4]-') THEN '$[''o_orderpriority'']: pattern' END AS fault FROM orders""",
}
