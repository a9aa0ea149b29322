"""Renders as plans: inputs in order, dependency digests, filters, profile checks.

Encoding itself belongs to an optional adapter (operators.media); all that
decides whether and how to encode is here, as columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propflow.functions.hashing import array_json, int_json, object_json, text_json

#: Targets with their sizes.
TARGETS = {"16x9": (1920, 1080), "9x16": (1080, 1920)}
FPS = 30
STRATEGIES = ("anchored_crop", "contain", "padded_background")
#: Where the crop begins for each anchor.
ANCHORS = {
    "center": ("(iw-ow)/2", "(ih-oh)/2"),
    "left": ("0", "(ih-oh)/2"),
    "right": ("iw-ow", "(ih-oh)/2"),
    "top": ("(iw-ow)/2", "0"),
    "bottom": ("(iw-ow)/2", "ih-oh"),
}


def dependency_hash(inputs: DataFrame, project: str, target: str, fps: int = FPS) -> DataFrame:
    """One digest a project over its clips in order and the profile; ``complete`` if places run from 0 without gaps.

    inputs: project, scene_id, sequence_index, clip_sha256, vertical_strategy, vertical_anchor.
    """
    width, height = TARGETS[target]
    wide = target == "16x9"
    item = object_json(
        {
            "scene_id": text_json(F.col("scene_id")),
            "sequence_index": int_json(F.col("sequence_index")),
            "clip_sha256": text_json(F.col("clip_sha256")),
            "vertical_strategy": text_json(F.lit("contain") if wide else F.col("vertical_strategy")),
            "vertical_anchor": text_json(F.lit("center") if wide else F.coalesce("vertical_anchor", F.lit("center"))),
        }
    )
    n = F.count(F.lit(1))
    whole = (F.count_distinct("sequence_index") == n) & (F.min("sequence_index") == 0) & (F.max("sequence_index") == n - 1)
    listed = inputs.groupBy(project).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("sequence_index", F.lit(-1)).alias("o"), item.alias("t")))).alias("_items"), whole.alias("complete"))
    fixed = {"codec": "h264", "pixel_format": "yuv420p", "sample_aspect_ratio": "1:1", "transition": "hard_cut", "audio": "none", "overlays": "none", "target": target}
    fields = {k: text_json(F.lit(v)) for k, v in fixed.items()} | {
        "width": int_json(F.lit(width)),
        "height": int_json(F.lit(height)),
        "fps": int_json(F.lit(fps)),
        "inputs": array_json(F.transform("_items", lambda x: x["t"])),
    }
    return listed.select(project, F.lit(target).alias("target"), "complete", F.sha2(object_json(fields), 256).alias("dependency_hash"))


def output_problem(probe: Column, target: str) -> Column:
    """The first way an output differs from its target's profile; null if it does not."""
    width, height = TARGETS[target]
    video = F.filter(probe["streams"], lambda s: s["codec_type"] == "video")
    audio = F.filter(probe["streams"], lambda s: s["codec_type"] == "audio")
    v = F.get(video, F.lit(0))
    return (
        F.when(~F.size(video).eqNullSafe(F.lit(1)), "video_streams")
        .when(~v["codec_name"].eqNullSafe(F.lit("h264")), "codec")
        .when(~v["pix_fmt"].eqNullSafe(F.lit("yuv420p")), "pixel_format")
        .when(~v["width"].eqNullSafe(F.lit(width)) | ~v["height"].eqNullSafe(F.lit(height)), "size")
        .when(v["sample_aspect_ratio"].isNotNull() & (v["sample_aspect_ratio"] != "1:1"), "sample_aspect_ratio")
        .when(F.size(audio) > 0, "audio")
    )


def simple_filter(strategy: Column, anchor: Column, target: str, fps: int = FPS) -> Column:
    """The filter of a clip for a target; null for a strategy or anchor that has none.

    ``padded_background`` has a graph of two branches.
    """
    width, height = TARGETS[target]
    end = f"setsar=1,fps={fps},format=yuv420p"
    place = F.create_map(*[x for k, v in ANCHORS.items() for x in (F.lit(k), F.lit(":".join(v)))])
    # fixed values: the two filters of one branch
    contain = f"scale={width}:{height}:force_original_aspect_ratio=decrease:flags=lanczos,pad={width}:{height}:(ow-iw)/2:(oh-ih)/2:color=black,{end}"
    crop = F.concat(F.lit(f"scale={width}:{height}:force_original_aspect_ratio=increase:flags=lanczos,crop={width}:{height}:"), place[anchor], F.lit(f",{end}"))
    return F.when(strategy == "contain", F.lit(contain)).when(strategy == "anchored_crop", crop).when(strategy == "padded_background", padded_filter(width, height, fps))


#: The graph of a clip before a blurred background of itself, with places for size (twice) and frames a second.
PADDED = (
    "[0:v]split=2[background][foreground];"
    "[background]scale={width}:{height}:force_original_aspect_ratio=increase:flags=lanczos,crop={width}:{height},boxblur=20:10[blurred];"
    "[foreground]scale={width}:{height}:force_original_aspect_ratio=decrease:flags=lanczos[front];"
    "[blurred][front]overlay=(W-w)/2:(H-h)/2,setsar=1,fps={fps},format=yuv420p[out]"
)


def padded_filter(width: int, height: int, fps: int = FPS) -> Column:
    """A graph with an output of its own, so it goes to ``-filter_complex``; the others go to ``-vf``."""
    return F.lit(PADDED.format(width=width, height=height, fps=fps))


def concat_line(name: Column) -> Column:
    """A line of a concat list; null for a name that is not a plain file name."""
    plain = (name != "") & (F.instr(name, "/") == 0) & ~name.isin(".", "..")
    return F.when(plain, F.concat(F.lit("file '"), F.replace(name, F.lit("'"), F.lit("'\\''")), F.lit("'")))


def concat_list(inputs: DataFrame, project: str, name: str) -> DataFrame:
    """The concat list of each project, in the order of its scenes."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("sequence_index", concat_line(F.col(name)).alias("t")))), lambda x: x["t"])
    return inputs.groupBy(project).agg(F.concat(F.array_join(ordered, "\n"), F.lit("\n")).alias("list"))


def memoised(wanted: DataFrame, rendered: DataFrame, files: DataFrame, project: str) -> DataFrame:
    """Wanted renders with ``reuse``: whether one with the same inputs is there, unchanged."""
    f = files.select(project, "path", F.col("sha256").alias("_actual"))
    r = rendered.join(f, [project, "path"], "left").select(project, "target", F.col("dependency_hash").alias("_done"), (F.col("_actual") == F.col("sha256")).alias("_same"))
    met = wanted.join(r, [project, "target"], "left")
    return met.withColumn("reuse", F.coalesce((F.col("_done") == F.col("dependency_hash")) & F.col("_same"), F.lit(False))).drop("_done", "_same")
