"""Scene plans: selection, order, identity, prompts, and what a change of plan undoes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from propflow.functions.hashing import array_json, double_json, int_json, object_json, text_json
from propflow.functions.text import plain_number

#: Kinds, rooms in the order of a walk, movements with their wording.
KINDS = ("photo", "floor_plan", "map", "screenshot", "portrait", "logo", "other")
ROOMS = (
    "exterior", "entrance", "hallway", "living_room", "dining_room", "kitchen", "bedroom", "child_room", "office", "specialty_room",
    "wardrobe", "utility_room", "bathroom", "toilet", "garage", "balcony", "terrace", "garden", "view", "other",
)
OUTDOORS = ("exterior", "garden", "view", "terrace", "balcony")
MOVES = {
    "slow_push_in": "a single slow push-in, moving forward by approximately three percent of the frame depth",
    "slow_pull_back": "a single slow pull-back, moving backward by approximately three percent of the frame depth",
    "gentle_pan_left": "a single gentle pan to the left, rotating no more than four degrees",
    "gentle_pan_right": "a single gentle pan to the right, rotating no more than four degrees",
    "subtle_slide_left": "a single subtle lateral slide to the left, travelling no more than three percent of frame width",
    "subtle_slide_right": "a single subtle lateral slide to the right, travelling no more than three percent of frame width",
    "static_hold": "a single locked-off hold with only imperceptible natural camera breathing and no translation",
}
#: The movements in Polish.
MOVES_PL = {
    "slow_push_in": "powolny najazd do przodu",
    "slow_pull_back": "powolny odjazd do tyłu",
    "gentle_pan_left": "łagodna panorama w lewo",
    "gentle_pan_right": "łagodna panorama w prawo",
    "subtle_slide_left": "subtelny przejazd w lewo",
    "subtle_slide_right": "subtelny przejazd w prawo",
    "static_hold": "statyczne ujęcie z minimalnym naturalnym oddechem kamery",
}
#: The prompt, with places for movement, seconds and ratio.
PROMPT = (
    "Use the provided source image as the only visual source of truth for this shot. "
    "Preserve exactly the visible architecture, spatial geometry, composition, walls, "
    "doors, windows, floors, ceilings, furniture, decorations, materials, colors, and "
    "lighting. Keep all source objects present, stable, and in their original positions. "
    "Execute one camera movement only: %s, at a restrained cinematic speed, "
    "for exactly %s seconds. Produce realistic, physically plausible parallax "
    "and keep the output framing at %s. Do not redesign or replace the room. "
    "Do not create unseen rooms, new doors, new windows, openings, passages, objects, "
    "reflections, or unsupported areas beyond the source frame. Prevent disappearance, "
    "duplication, morphing, melting, bending, geometry drift, scene replacement, camera "
    "teleportation, unsupported doorway travel, and impossible reveals. Maintain locked "
    "source geometry and visual continuity within this single shot from first frame to last."
)
MOST_SCENES, ADVISED_SCENES = 10, 6
MOST_SECONDS, LEAST_SECONDS = 20.0, 1.0


def image_key(*aliases: Column) -> Column:
    """The identifier of a record that may carry it under several names."""
    return F.coalesce(*[F.when(a != "", a) for a in aliases])


def overlay(layers: list[DataFrame], key: str, columns: list[str]) -> DataFrame:
    """Records of the last layer, with columns from earlier ones it does not have.

    A layer has a value where its ``has_<column>`` is true (or, without such a
    column, always): a null that is there hides an earlier value.
    """
    *under, top = layers
    out = top
    for layer in reversed(under):
        renamed = layer.select(key, *[F.col(c).alias(f"_{c}") for c in layer.columns if c != key])
        out = out.join(renamed, key, "left")
        for c in columns:
            if c not in layer.columns:
                continue
            there = F.coalesce(F.col(f"_has_{c}"), F.lit(False)) if f"has_{c}" in layer.columns else F.lit(True)
            if c not in out.columns:
                out = out.withColumns({c: F.when(there, F.col(f"_{c}")), f"has_{c}": there})
                continue
            mine = F.col(f"has_{c}") if f"has_{c}" in out.columns else F.lit(True)
            out = out.withColumns({c: F.when(mine, F.col(c)).when(there, F.col(f"_{c}")), f"has_{c}": mine | there})
        out = out.drop(*[c for c in renamed.columns if c != key])
    return out


def selection_problem(asset_kind: Column, room_type: Column, status: Column, expected: Column, actual: Column) -> Column:
    """Why a selected asset cannot become a scene; null if it can."""
    return (
        F.when(~F.coalesce(asset_kind.isin(*KINDS), F.lit(False)), "asset_kind")
        .when(~F.coalesce(room_type.isin(*ROOMS), F.lit(False)), "room_type")
        .when(~F.coalesce(status == "selected", F.lit(False)), "curation_status")
        .when(asset_kind != "photo", "not_a_photo")
        .when(actual.isNull(), "no_file")
        .when(expected.isNotNull() & (expected != "") & (expected != actual), "hash")
    )


def room_rank(room_type: Column) -> Column:
    rank = F.lit(999)
    for i, room in reversed(list(enumerate(ROOMS))):
        rank = F.when(room_type == room, i).otherwise(rank)
    return rank


def scene_order(explicit: Column, rank: Column, image_id: Column) -> Column:
    """Sort key: explicit places first, then the walk through the rooms, then identifiers."""
    given = explicit.isNotNull() & (explicit >= 0)
    return F.struct(F.when(given, 0).otherwise(1).alias("a"), F.when(given, explicit).otherwise(rank).cast("long").alias("b"), image_id.cast("string").alias("c"))


def planned(assets: DataFrame, project: str, key: Column, instance: Column, angle: Column, most: int = MOST_SCENES) -> DataFrame:
    """The first ``most`` assets of each project, numbered from 0, with ``n_selected`` and ``unexplained_angle``.

    A second picture of a room needs a reason; that is judged over all selected
    assets, before the cut.
    """
    order = Window.partitionBy(project).orderBy("_key")
    again = F.row_number().over(Window.partitionBy(project, "_room").orderBy("_key")) > 1
    keyed = assets.withColumns({"_key": key, "_room": instance, "_angle": F.coalesce(angle, F.lit(False))})
    judged = keyed.withColumns({"_bad": again & ~F.col("_angle"), "sequence_index": F.row_number().over(order) - 1})
    whole = Window.partitionBy(project)
    judged = judged.withColumns({"unexplained_angle": F.bool_or("_bad").over(whole), "n_selected": F.count(F.lit(1)).over(whole)})
    return judged.where(F.col("sequence_index") < most).drop("_key", "_room", "_angle", "_bad")


def new_scene_id(*parts: Column) -> Column:
    """An identifier that no other project, image or number of removals gives."""
    return F.concat(F.lit("scn_"), F.left(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256), F.lit(20)))


def scene_ids(plan: DataFrame, previous: DataFrame, tombstones: DataFrame, project: str, image: str) -> DataFrame:
    """Scene identifiers: an image keeps the one it has; a new one is made from its removals so far."""
    removed = tombstones.groupBy(project, image).agg(F.count(F.lit(1)).alias("_removed"))
    known = previous.select(project, image, F.col("scene_id").alias("_previous"))
    met = plan.join(known, [project, image], "left").join(removed, [project, image], "left")
    made = new_scene_id(F.col(project), F.col(image), F.coalesce("_removed", F.lit(0)))
    return met.withColumns({"scene_id": F.coalesce("_previous", made), "reused": F.col("_previous").isNotNull()}).drop("_previous", "_removed")


def new_tombstones(previous: DataFrame, plan: DataFrame, tombstones: DataFrame, project: str, image: str) -> DataFrame:
    """Scenes whose image is no longer planned and that are not tombstones yet."""
    return previous.join(plan.select(project, image), [project, image], "left_anti").join(tombstones.select(project, "scene_id"), [project, "scene_id"], "left_anti")


def camera_move(requested: Column, risk: Column, room_type: Column) -> Column:
    """The one movement of a scene; null for a request that is not allowed."""
    return (
        F.when(requested.isNotNull(), F.when(requested.isin(*MOVES), requested))
        .when(F.lower(F.coalesce(risk, F.lit("medium"))) == "high", "static_hold")
        .when(room_type.isin(*OUTDOORS), "gentle_pan_right")
        .otherwise("slow_push_in")
    )


def prompt(move: Column, seconds: Column, ratio: Column) -> Column:
    words = F.create_map(*[F.lit(x) for pair in MOVES.items() for x in pair])
    return F.format_string(PROMPT, F.element_at(words, move), plain_number(seconds), ratio)


def movement_text(move: Column, language: str = "en") -> Column:
    """The wording of a movement, in English or Polish; null for one that is not allowed."""
    words = {"en": MOVES, "pl": MOVES_PL}[language]
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in words.items() for x in pair]), move)


def scene_signature(image: Column, sha256: Column, move: Column, seconds: Column, ratio: Column, text: Column) -> Column:
    """Digest of what a scene's clip depends on: not its place, so reordering undoes nothing."""
    return F.sha2(
        object_json(
            {
                "source_image_id": text_json(image),
                "source_sha256": text_json(sha256),
                "camera_motion": text_json(move),
                "duration_seconds": double_json(seconds),
                "aspect_ratio": text_json(ratio),
                "prompt_en": text_json(text),
            }
        ),
        256,
    )


def plan_fingerprint(scenes: DataFrame, project: str) -> DataFrame:
    """One digest a plan over its scenes' identifiers and digests, in order."""
    item = F.struct("sequence_index", object_json({"dependency_hash": text_json(F.col("dependency_hash")), "scene_id": text_json(F.col("scene_id")), "sequence_index": int_json(F.col("sequence_index"))}).alias("t"))
    ordered = F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"])
    return scenes.groupBy(project).agg(F.sha2(array_json(ordered), 256).alias("plan_hash"), F.count(F.lit(1)).alias("n_scenes"))


def size_problem(n: Column, reason: Column) -> Column:
    """Why a plan's number of scenes is refused; null if it is not."""
    return F.when(n > MOST_SCENES, "too_many").when((n > 0) & (n < ADVISED_SCENES) & F.coalesce(F.trim(reason) == "", F.lit(True)), "reason_needed")


def changed_scenes(old: DataFrame, new: DataFrame, project: str, signature: str) -> DataFrame:
    """Scenes that are new, different or gone, with which of these they are."""
    a = old.select(project, "scene_id", F.col(signature).alias("_old"), F.lit(True).alias("_was"))
    b = new.select(project, "scene_id", F.col(signature).alias("_new"), F.lit(True).alias("_is"))
    met = a.join(b, [project, "scene_id"], "full_outer")
    kind = F.when(F.col("_was").isNull(), "new").when(F.col("_is").isNull(), "removed").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    return met.withColumn("change", kind).where("change IS NOT NULL").select(project, "scene_id", "change")


def invalidate_clips(clips: DataFrame, changed: DataFrame, project: str) -> DataFrame:
    """Clips with ``input_dependency_valid`` false where their scene changed; others keep theirs."""
    keys = changed.select(project, "scene_id").distinct().withColumn("_changed", F.lit(True))
    return clips.join(keys, [project, "scene_id"], "left").withColumn("input_dependency_valid", F.col("input_dependency_valid") & F.col("_changed").isNull()).drop("_changed")


def render_undone(old: DataFrame, new: DataFrame, changed: DataFrame, project: str) -> DataFrame:
    """Projects whose render a plan undoes: any scene changed, or the order did."""
    def order(frame, name):
        return frame.groupBy(project).agg(F.transform(F.array_sort(F.collect_list(F.struct("sequence_index", "scene_id"))), lambda x: x["scene_id"]).alias(name))

    moved = order(old, "_a").join(order(new, "_b"), project, "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b"))).select(project)
    return moved.unionByName(changed.select(project)).distinct()


def contiguous(scenes: DataFrame, group: str, index: str, key: str) -> DataFrame:
    """By group: whether indexes run from 0 without gaps or repeats, and keys are unique."""
    n = F.count(F.lit(1))
    return scenes.groupBy(group).agg(
        n.alias("n"),
        ((F.count_distinct(index) == n) & (F.min(index) == 0) & (F.max(index) == n - 1) & (F.count(index) == n)).alias("contiguous"),
        (F.count_distinct(key) == n).alias("unique_ids"),
    )


def repeated(frame: DataFrame, *keys: str) -> DataFrame:
    return frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def reused_tombstones(scenes: DataFrame, tombstones: DataFrame, project: str) -> DataFrame:
    """Active scenes that bear the identifier of a tombstone."""
    return scenes.select(project, "scene_id").intersect(tombstones.select(project, "scene_id"))


def add_scene(scenes: DataFrame, added: DataFrame, project: str) -> DataFrame:
    """Scenes with others put in at their ``sequence_index`` (the end where null), renumbered."""
    both = scenes.withColumn("_added", F.lit(0)).unionByName(added.withColumn("_added", F.lit(-1)), allowMissingColumns=True)
    order = Window.partitionBy(project).orderBy(F.asc_nulls_last("sequence_index"), "_added", "scene_id")
    return both.withColumn("_ix", F.row_number().over(order) - 1).withColumn("sequence_index", F.col("_ix")).drop("_ix", "_added")


def tombstone(scenes: DataFrame, removed: DataFrame, project: str) -> tuple[DataFrame, DataFrame]:
    """Scenes left, renumbered, and tombstones of those removed; ``removed`` has the reason and time."""
    left = scenes.join(removed.select(project, "scene_id"), [project, "scene_id"], "left_anti")
    order = Window.partitionBy(project).orderBy("sequence_index")
    gone = scenes.join(removed, [project, "scene_id"]).withColumnRenamed("sequence_index", "last_sequence_index")
    return left.withColumn("sequence_index", F.row_number().over(order) - 1), gone


def reorder(scenes: DataFrame, orders: DataFrame, project: str) -> DataFrame:
    """Scenes in a new order (array ``scene_ids`` by project); ``accepted`` only if it is a permutation of them."""
    now = scenes.groupBy(project).agg(F.array_sort(F.collect_list("scene_id")).alias("_now"))
    judged = orders.join(now, project).withColumn("accepted", F.array_sort("scene_ids") == F.col("_now"))
    met = scenes.join(judged.select(project, "scene_ids", "accepted"), project, "left")
    place = F.array_position("scene_ids", F.col("scene_id")).cast("int") - 1
    return met.withColumn("sequence_index", F.when(F.col("accepted"), place).otherwise(F.col("sequence_index"))).drop("scene_ids")
