"""Queries of the smaller rules and joins, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propflow.functions.hashing import session_scope
from propflow.functions.rules import MOVEMENT_JOINS, is_single_movement
from propflow.functions.text import revision_name, utc_text, utc_time
from propflow.operators.analysis import apply_analysis, asset_map, reset_stages, summary
from propflow.operators.clips import active_scene
from propflow.operators.planning import ROOMS, new_tombstones, selection_problem
from propflow.operators.transitions import record_reviews
from propflow.plans.common import table


def selection_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as selected assets; what is wrong with one is settled by its key."""
    key = F.col("p_partkey")
    room = F.element_at(F.array(*[F.lit(r) for r in ROOMS], F.lit("cellar")), (key % (len(ROOMS) + 1) + 1).cast("int"))
    kind = F.when(key % 7 == 0, "floor_plan").when(key % 31 == 0, "painting").otherwise("photo")
    problem = selection_problem(kind, room, F.when(key % 5 == 0, "reserve").otherwise("selected"), F.when(key % 3 > 0, F.col("p_brand")), F.when(key % 11 == 0, F.lit(None)).when(key % 13 == 0, "other").otherwise(F.col("p_brand")))
    return table(spark, sf_dir, "part").select("p_partkey", problem.alias("problem"))


def review_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews of orders' lines as clips: each is about the very revision it names, and some are refused."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"))
    named = [F.col("l_orderkey").alias("project_id"), F.lit("s").alias("scene_id"), F.col("l_linenumber").alias("revision")]
    clips = lines.where("l_linenumber <> 6").select(
        *named, F.concat_ws("-", "l_orderkey", "l_linenumber").alias("clip_id"), F.concat(F.lit("c/"), F.col("l_linenumber").cast("string")).alias("path"), F.lit("h").alias("sha256"),
        F.when(F.col("l_quantity") > 45, "failed").otherwise("passed").alias("technical_status"),
    )
    files = lines.where("l_linenumber <> 5").select(F.col("l_orderkey").alias("project_id"), F.concat(F.lit("c/"), F.col("l_linenumber").cast("string")).alias("path"), F.when(F.col("l_linenumber") == 4, "g").otherwise("h").alias("sha256"))
    reviews = lines.select(
        *named, F.when(F.col("l_quantity") % 2 == 0, "approved").otherwise("rejected").alias("status"), F.when(F.col("l_quantity") % 8 == 0, F.array(F.lit(" morphing "))).otherwise(F.array(F.lit("noise"))).alias("issues"),
        (F.col("l_quantity") < 30).alias("compared"), F.when(F.col("l_quantity") % 10 != 0, "seen").alias("evidence"), F.col("l_linenumber").alias("n"),
    )
    return record_reviews(reviews, clips, files)["reviews"].select("project_id", F.col("revision").cast("long").alias("revision"), "status", "problem")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("project_id"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("scene_id"), F.col("role").alias("image_id"), "turn")


def active_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn is asked for; turns of the system are no scenes, and every fifth is a tombstone, once or twice."""
    turns = _turns(spark, sf_dir)
    scenes, gone = turns.where("image_id <> 'system'").select("project_id", "scene_id", "image_id"), turns.where("turn % 5 = 4")
    return active_scene(turns.select("project_id", "scene_id"), scenes, gone.unionByName(gone.where("turn = 4")), ["project_id", "scene_id"])


def retired_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes of images (roles) that the new plan has no more, but for those that are tombstones already."""
    turns = _turns(spark, sf_dir)
    kept = turns.where("image_id = 'user' OR project_id % 3 = 0")
    return new_tombstones(turns, kept, turns.where("turn % 4 = 1"), "project_id", "image_id").select("project_id", "scene_id", "image_id")


def asset_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a manifest's assets, met with digests of what is there."""
    docs = table(spark, sf_dir, "documents").select(F.format_string("a/%d.txt", "doc_id").alias("relative_path"), F.sha2("text", 256).alias("sha256"), "doc_id", "text")
    files = docs.where("doc_id % 9 <> 4").select(F.col("relative_path").alias("path"), F.when(F.col("doc_id") % 7 == 3, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.col("sha256")).alias("sha256"))
    return asset_map(docs.select("doc_id", "relative_path", "sha256"), files).select("doc_id", "state")


def asset_state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", F.col("lang").alias("state"), "n_chars")
    return summary(docs, "source", english=F.col("state") == "en", long=F.col("n_chars") > 1000)


def analysis_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as classified images: the selected of a project are numbered, and two images hold persons."""
    turns = _turns(spark, sf_dir)
    assets = turns.where("turn % 7 <> 6").select("project_id", F.col("scene_id").alias("image_id"), F.sha2("scene_id", 256).alias("sha256"))
    seen = turns.select("project_id", F.col("scene_id").alias("image_id"), F.when(F.col("image_id") == "user", "selected").otherwise("reserve").alias("curation_status"), F.col("turn").alias("ord"))
    found = apply_analysis(assets, seen, True, False, ("t1", "t3"))
    return found.select("project_id", "image_id", "selected", F.col("selected_ord").cast("long").alias("selected_ord"), "rights_confirmed", "pii_reviewed", "contains_pii")


def stage_resets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages of a project for each nation, after a new selection of images."""
    stages = F.array(*[F.lit(s) for s in ("listing", "curation", "scene_planning", "prompts", "rendering", "other")])
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(stages).alias("stage"), F.col("n_name").alias("status"))
    return reset_stages(rows)


def single_movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.element_at(F.array(F.lit(""), *[F.lit(m) for m in MOVEMENT_JOINS]), (F.col("p_partkey") % (len(MOVEMENT_JOINS) + 1) + 1).cast("int"))
    text = F.when(F.col("p_partkey") % 10 == 0, F.lit(" \t")).when(F.col("p_partkey") % 10 == 1, F.lit(None)).otherwise(F.concat("p_brand", mark, "p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", is_single_movement(text).alias("single"))


def session_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nonces of one to 300 characters, some with blanks at an edge or a control character."""
    n = F.col("p_partkey") % 300
    text = F.repeat(F.lit("x"), (n + 1).cast("int"))
    odd = F.when(F.col("p_partkey") % 17 == 0, F.concat(F.lit(" "), text)).when(F.col("p_partkey") % 19 == 0, F.concat(text, F.lit("\x01"), text)).otherwise(text)
    return table(spark, sf_dir, "part").select("p_partkey", session_scope(odd).alias("scope"))


def revision_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of stored revisions and their times, there and back."""
    moment = utc_text(F.date_trunc("second", "ts"))
    back = utc_time(F.when(F.col("event_id") % 5 == 0, F.regexp_replace(moment, "Z$", "+00:00")).otherwise(moment))
    return table(spark, sf_dir, "events").select(
        "event_id", revision_name((F.col("event_id") % 2000).cast("int"), F.sha2(F.col("event_id").cast("string"), 256), F.concat(F.lit("."), F.upper("event_type"))).alias("name"), moment.alias("time"), back.isNotNull().alias("read"),
    )


QUERIES = {f.__name__: f for f in (
    selection_problems, review_refusals, active_scenes, retired_scenes, asset_states, asset_state_counts, analysis_ordinals, stage_resets, single_movements, session_scopes, revision_names,
)}

_ROOM_SQL = "[" + ", ".join(f"'{r}'" for r in (*ROOMS, "cellar")) + f"][p_partkey % {len(ROOMS) + 1} + 1]"
_MARK_SQL = "[" + ", ".join(f"'{m}'" for m in ("", *MOVEMENT_JOINS)) + f"][p_partkey % {len(MOVEMENT_JOINS) + 1} + 1]"
_TURNS_SQL = "t AS (SELECT conv_id AS project_id, 't' || turn AS scene_id, role AS image_id, turn FROM conversations)"

SQL = {
    "selection_problems": f"""
        SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 31 = 0 THEN 'asset_kind' WHEN {_ROOM_SQL} = 'cellar' THEN 'room_type' WHEN p_partkey % 5 = 0 THEN 'curation_status'
          WHEN p_partkey % 7 = 0 THEN 'not_a_photo' WHEN p_partkey % 11 = 0 THEN 'no_file' WHEN p_partkey % 13 = 0 AND p_partkey % 3 > 0 THEN 'hash' END AS problem FROM part""",
    "review_refusals": """
        SELECT l_orderkey AS project_id, l_linenumber AS revision, CASE WHEN l_quantity % 2 = 0 THEN 'approved' ELSE 'rejected' END AS status,
          CASE WHEN l_quantity < 30 AND l_quantity % 10 = 0 THEN 'evidence_needed' WHEN l_quantity % 2 = 0 AND l_quantity > 45 THEN 'technical_failure' WHEN l_quantity % 8 = 0 THEN 'critical_issue'
            WHEN l_quantity % 2 = 0 AND l_linenumber IN (4, 5) THEN 'file_changed' END AS problem
        FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem WHERE l_linenumber <> 6 GROUP BY ALL)""",
    "active_scenes": f"WITH {_TURNS_SQL} SELECT project_id, scene_id, image_id FROM t WHERE image_id <> 'system' AND turn % 5 <> 4",
    "retired_scenes": f"""
        WITH {_TURNS_SQL} SELECT project_id, scene_id, image_id FROM t WHERE NOT (image_id = 'user' OR project_id % 3 = 0) AND turn % 4 <> 1""",
    "asset_states": "SELECT doc_id, CASE WHEN doc_id % 9 = 4 THEN 'absent' WHEN doc_id % 7 = 3 THEN 'changed' ELSE 'ok' END AS state FROM documents",
    "asset_state_counts": "SELECT source, count(*) AS n, count(*) FILTER (lang = 'en') AS english, count(*) FILTER (n_chars > 1000) AS long FROM documents GROUP BY source",
    "analysis_ordinals": f"""
        WITH {_TURNS_SQL}, s AS (SELECT *, image_id = 'user' AS selected FROM t WHERE turn % 7 <> 6)
        SELECT project_id, scene_id AS image_id, selected, CASE WHEN selected THEN row_number() OVER (PARTITION BY project_id, selected ORDER BY turn) - 1 END AS selected_ord,
          true AS rights_confirmed, false AS pii_reviewed, scene_id IN ('t1', 't3') AS contains_pii FROM s""",
    "stage_resets": """
        SELECT n_nationkey, stage, CASE stage WHEN 'curation' THEN 'complete' WHEN 'scene_planning' THEN 'pending' WHEN 'prompts' THEN 'pending' WHEN 'rendering' THEN 'pending' ELSE n_name END AS status
        FROM nation, (VALUES ('listing'), ('curation'), ('scene_planning'), ('prompts'), ('rendering'), ('other')) s(stage)""",
    "single_movements": f"SELECT p_partkey, p_partkey % 10 > 1 AND {_MARK_SQL} = '' AS single FROM part",
    "session_scopes": """
        SELECT p_partkey, CASE WHEN p_partkey % 17 <> 0 AND p_partkey % 19 <> 0 AND p_partkey % 300 BETWEEN 15 AND 255 THEN sha256(repeat('x', p_partkey % 300 + 1)) END AS scope FROM part""",
    "revision_names": """
        SELECT event_id, printf('rev-%03d-%s.%s', event_id % 2000, sha256(event_id::VARCHAR)[1:12], event_type) AS name, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS time, event_id % 5 <> 0 AS read FROM events""",
}
