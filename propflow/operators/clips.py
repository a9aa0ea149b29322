"""Clips: matching files to scenes, revisions, technical checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from propflow.functions.text import finite, rational, revision_name

#: Suffixes of clips, and issues that fail one.
SUFFIXES = (".mp4", ".mov", ".mkv", ".webm")
FATAL = ("video_stream_count", "duration_missing", "resolution_missing", "sample_frames_unavailable")
LARGEST = 2 << 30


def active_scene(requests: DataFrame, scenes: DataFrame, tombstones: DataFrame, keys: list[str]) -> DataFrame:
    """Requests whose scene is active and no tombstone."""
    return requests.join(tombstones.select(*keys), keys, "left_anti").join(scenes, keys)


def expected_filename(scenes: DataFrame, entries: DataFrame, keys: list[str]) -> DataFrame:
    """Scenes with the file name their package expects (of several the least), or ``<scene_id>.mp4``."""
    named = entries.where("expected_filename <> ''").groupBy(*keys).agg(F.min("expected_filename").alias("expected_filename"))
    return scenes.join(named, keys, "left").withColumn("expected_filename", F.coalesce("expected_filename", F.concat("scene_id", F.lit(".mp4"))))


def revisions(existing: DataFrame, imports: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Imports with their revision: bytes a scene has already give the old one, others the next.

    ``existing`` has keys, sha256, revision; ``imports`` keys, sha256 and order
    columns.  The first of equal imports counts, later ones are replays.
    """
    first = Window.partitionBy(*keys, "sha256").orderBy(*order)
    fresh = imports.withColumn("_nth", F.row_number().over(first))
    old = existing.groupBy(*keys, "sha256").agg(F.min("revision").alias("_old"))
    top = existing.groupBy(*keys).agg(F.max("revision").alias("_top"))
    met = fresh.join(old, [*keys, "sha256"], "left").join(top, keys, "left")
    new = F.col("_old").isNull() & (F.col("_nth") == 1)
    count = F.sum(F.when(new, 1).otherwise(0)).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    numbered = met.withColumn("_made", F.when(new, F.coalesce("_top", F.lit(0)) + count))
    # a replay has the number of the import it repeats
    made = F.min("_made").over(Window.partitionBy(*keys, "sha256"))
    return numbered.withColumns({"revision": F.coalesce("_old", made).cast("int"), "replayed": ~new}).drop("_nth", "_old", "_top", "_made")


def next_revision(clips: DataFrame, keys: list[str]) -> DataFrame:
    return clips.groupBy(*keys).agg((F.coalesce(F.max("revision"), F.lit(0)) + 1).alias("next_revision"))


def stored_name(revision: Column, sha256: Column, name: Column) -> Column:
    """Name a clip is stored under; null for a suffix that is not a clip's."""
    suffix = F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1))
    return F.when(suffix.isin(*SUFFIXES), revision_name(revision, sha256, suffix))


def refusal(size_bytes: Column, name: Column, expected: Column, active: Column) -> Column:
    """Why a file is not imported as a scene's clip; null if it is."""
    return (
        F.when(~active, "scene_not_active")
        .when(size_bytes.isNull() | (size_bytes < 1), "empty")
        .when(size_bytes > LARGEST, "too_large")
        .when(stored_name(F.lit(1), F.lit("0" * 64), name).isNull(), "suffix")
        .when(F.element_at(F.split(name, "/"), -1) != expected, "unexpected_name")
    )


def find_revision(clips: DataFrame, requests: DataFrame, keys: list[str]) -> DataFrame:
    """The very revision a request names, never the latest in its place."""
    return requests.join(clips, [*keys, "revision"])


def probe_summary(probe: Column) -> dict[str, Column]:
    """Technical fields from a struct of probe results (see sources.images)."""
    streams = probe["streams"]
    video = F.filter(streams, lambda s: s["codec_type"] == "video")
    audio = F.filter(streams, lambda s: s["codec_type"] == "audio")
    first = F.get(video, F.lit(0))
    return {
        "duration_seconds": F.coalesce(finite(probe["format"]["duration"]), finite(first["duration"])),
        "width": first["width"],
        "height": first["height"],
        "sample_aspect_ratio": first["sample_aspect_ratio"],
        "average_fps": rational(first["avg_frame_rate"]),
        "codec_name": first["codec_name"],
        "pixel_format": first["pix_fmt"],
        "video_stream_count": F.coalesce(F.size(video), F.lit(0)),
        "audio_stream_count": F.coalesce(F.size(audio), F.lit(0)),
        "format_name": probe["format"]["format_name"],
    }


def technical_issues(streams: Column, duration: Column, expected: Column, width: Column, height: Column, ratio: Column, sar: Column) -> Column:
    """All issues of a clip, sorted: any ratio but 16:9 is held against 9:16."""
    tolerance = F.greatest(F.lit(0.6), expected * 0.15)
    no_duration = duration.isNull() | (duration <= 0)
    no_size = width.isNull() | height.isNull() | (width <= 0) | (height <= 0)
    target = F.when(ratio == "16:9", F.lit(16 / 9)).otherwise(F.lit(9 / 16))
    off = F.abs(F.try_divide(width.cast("double"), height.cast("double")) - target) > 0.04
    found = F.array(
        F.when(~streams.eqNullSafe(F.lit(1)), "video_stream_count"),
        F.when(no_duration, "duration_missing").when(F.abs(duration - expected) > tolerance, "duration_mismatch"),
        F.when(no_size, "resolution_missing").when(off, "aspect_ratio_mismatch"),
        F.when(sar.isNotNull() & ~sar.isin("1:1", "N/A"), "non_square_pixels"),
        F.when(no_duration | ~(streams > 0), "sample_frames_unavailable"),
    )
    return F.array_sort(F.array_distinct(F.array_compact(found)))


def technical_status(issues: Column) -> Column:
    fatal = F.arrays_overlap(issues, F.array(*[F.lit(x) for x in FATAL]))
    return F.when(fatal, "failed").when(F.size(issues) == 0, "passed").otherwise("needs-manual-review")


def review_status(issues: Column) -> Column:
    return F.when(technical_status(issues) == "failed", "rejected").otherwise("needs-manual-review")
