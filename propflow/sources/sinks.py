"""Writers: documents, shot lists, and stores that never overwrite.

Everything is staged and renamed, so a reader sees a whole result or none.
"""

from __future__ import annotations

import json
import os
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from propflow.functions.text import plain_number

#: Columns of the CSV shot list, and folders of a project.
CSV_COLUMNS = (
    "sequence_index", "scene_id", "source_image_id", "room_type", "camera_move", "duration_seconds",
    "ratio", "generation_status", "qc_status", "expected_filename", "prompt",
)
FOLDERS = (
    "source-images", "thumbnails", "contact-sheets", "rejected", "prompts", "generation-package", "scenes",
    "scenes/imported", "scenes/approved", "scenes/rejected", "final", "reports", "provider",
)


class Conflict(ValueError):
    """Other content is there under the same key."""


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return place, place(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def publish(df: DataFrame, path: str, form: str = "parquet", **options) -> None:
    """Write beside the target and rename; an earlier result is kept until the new one is there, and put back on failure."""
    spark = df.sparkSession
    place, fs = _file_system(spark, path)
    staged, backup = f"{path}.staged-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.format(form).options(**options).save(staged)
    had = fs.exists(place(path))
    if had and not fs.rename(place(path), place(backup)):
        raise OSError(f"{path} cannot be moved")
    if not fs.rename(place(staged), place(path)):
        if had:
            fs.rename(place(backup), place(path))
        raise OSError(f"{staged} cannot be moved to {path}")
    if had:
        fs.delete(place(backup), True)


def publish_all(frames: dict[str, DataFrame], form: str = "parquet") -> None:
    """Several results, or none: all are staged before any is moved."""
    if not frames:
        return
    spark = next(iter(frames.values())).sparkSession
    staged = {path: f"{path}.staged-{uuid.uuid4().hex}" for path in frames}
    place, fs = _file_system(spark, next(iter(frames)))
    moved: list[str] = []
    try:
        for path, df in frames.items():
            df.write.format(form).save(staged[path])
        for path in frames:
            if fs.exists(place(path)) or not fs.rename(place(staged[path]), place(path)):
                raise Conflict(path)
            moved.append(path)
    except Exception:
        for path in [*moved, *staged.values()]:
            fs.delete(place(path), True)
        raise


def write_document(spark: SparkSession, path: str, document: dict) -> None:
    """One JSON document: sorted keys, indented, raw Unicode, finite numbers only."""
    text = json.dumps(document, ensure_ascii=False, sort_keys=True, indent=2, allow_nan=False)
    publish(spark.createDataFrame([(text,)], "value string").coalesce(1), path, "text")


def append_new(df: DataFrame, path: str, key: str, content: str) -> None:
    """Append rows whose key is not there; the same content again is nothing, other content a Conflict.

    One writer at a time: two that append to one path at once need a lock of their own.
    """
    spark = df.sparkSession
    place, fs = _file_system(spark, path)
    unlike = df.groupBy(key).agg(F.count_distinct(F.struct(F.col(content).isNull(), F.coalesce(F.col(content).cast("string"), F.lit("")))).alias("n")).where("n > 1")
    if not unlike.isEmpty():
        raise Conflict(f"{path}: a batch has two contents under one key")
    df = df.dropDuplicates([key])
    if fs.exists(place(path)):
        old = spark.read.parquet(path).select(key, F.col(content).alias("_there"))
        if not df.join(old, key).where(~F.col(content).eqNullSafe(F.col("_there"))).isEmpty():
            raise Conflict(f"{path}: other content under a key")
        df = df.join(old.select(key), key, "left_anti")
    df.write.mode("append").parquet(path)


def shot_list_rows(scenes: DataFrame) -> DataFrame:
    """Scenes in the columns of the CSV shot list."""
    return scenes.select(
        "sequence_index", "scene_id", "source_image_id", "room_type", F.col("camera_motion").alias("camera_move"), "duration_seconds", F.col("aspect_ratio").alias("ratio"),
        F.lit("nie_uruchomiono").alias("generation_status"), F.lit("wymaga_kontroli_manualnej").alias("qc_status"),
        F.concat("scene_id", F.lit(".mp4")).alias("expected_filename"), F.col("prompt_en").alias("prompt"),
    )


def write_shot_list_csv(scenes: DataFrame, path: str) -> None:
    """One CSV file for one project's scenes (ten at most), in order."""
    publish(shot_list_rows(scenes).orderBy("sequence_index").coalesce(1), path, "csv", header="true", escape='"')


def shot_list_json(project: Column) -> Column:
    """A shot list as JSON, to be aggregated by project over scene columns."""
    scene = F.struct("sequence_index", "scene_id", "source_image_id", "room_type", "camera_motion", "duration_seconds", "aspect_ratio", "prompt_en")
    return F.to_json(F.struct(F.first(project).alias("project_id"), F.array_sort(F.collect_list(scene)).alias("scenes")))


def shot_list_markdown(project: Column, reason: Column) -> Column:
    """A shot list as Markdown, to be aggregated by project over scene columns."""
    section = F.concat(
        F.format_string("## %d. %s\n\n", F.col("sequence_index") + 1, F.col("scene_id")),
        F.format_string("- Typ pomieszczenia: `%s`\n- Ruch kamery: %s\n", "room_type", "camera_motion"),
        F.format_string("- Czas trwania: %s s\n- Format: `%s`\n", plain_number(F.col("duration_seconds")), "aspect_ratio"),
        F.lit("- Status generowania: `nie_uruchomiono`\n- Status kontroli jakości: `wymaga_kontroli_manualnej`\n\n"),
        F.concat(F.lit("```text\n"), "prompt_en", F.lit("\n```\n")),
    )
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("sequence_index", section.alias("t")))), lambda x: x["t"])
    head = F.concat(F.lit("# Lista ujęć walkthrough\n\nProjekt: `"), F.first(project), F.lit("`\n\n"))
    why = F.coalesce(F.concat(F.lit("Uzasadnienie krótszego planu: "), F.first(reason), F.lit("\n\n")), F.lit(""))
    return F.concat(head, why, F.array_join(ordered, "\n"))


def create_project(spark: SparkSession, root: str, project_id: str, manifest: dict) -> None:
    """A project's folders and first document, staged and renamed as one; a Conflict if it is there."""
    place, fs = _file_system(spark, root)
    target, staged = f"{root}/{project_id}", f"{root}/.{project_id}-{uuid.uuid4().hex}"
    for folder in FOLDERS:
        fs.mkdirs(place(f"{staged}/{folder}"))
    write_document(spark, f"{staged}/project.json", {**manifest, "project_id": project_id, "manifest_revision": 1})
    if fs.exists(place(target)) or not fs.rename(place(staged), place(target)):
        fs.delete(place(staged), True)
        raise Conflict(target)


def _versions(spark: SparkSession, root: str) -> list[int]:
    place, fs = _file_system(spark, root)
    folder = place(f"{root}/versions")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n.removesuffix(".json")) for n in names if re.fullmatch(r"\d{8}\.json", n))


def _pointer(spark: SparkSession, root: str, version: int) -> dict:
    return json.loads(spark.read.text(f"{root}/versions/{version:08d}.json", wholetext=True).first()[0])


def _point(spark: SparkSession, root: str, version: int, about: dict) -> bool:
    """Make a version's pointer, whole and only if there is none; whether this writer did."""
    place, fs = _file_system(spark, root)
    target, mine = place(f"{root}/versions/{version:08d}.json"), place(f"{root}/.pointer-{uuid.uuid4().hex}")
    fs.mkdirs(target.getParent())
    out = fs.create(mine, False)
    out.write(json.dumps(about, sort_keys=True).encode())
    out.close()
    try:
        if fs.getScheme() == "file":
            # a rename on a local file system would replace what is there; a link does not
            os.link(mine.toUri().getPath(), target.toUri().getPath())
            return True
        return not fs.exists(target) and fs.rename(mine, target)
    except FileExistsError:
        return False
    finally:
        fs.delete(mine, False)


def publish_package(frames: dict[str, DataFrame], root: str, content: str, form: str = "parquet") -> int:
    """Publish several results as the next version of a package: all are visible at once, or none is.

    Results are written where nobody looks, and one pointer file, which only one
    writer can make, names them.  ``content`` is the package's fingerprint: a
    retry, or another writer, of what is the last version already changes
    nothing and gets that version's number.  Writers of other contents each get a
    version of their own, in the order of their pointers.
    """
    spark = next(iter(frames.values())).sparkSession
    place, fs = _file_system(spark, root)
    data = f"{root}/data/{uuid.uuid4().hex}"
    done = False
    try:
        known = _versions(spark, root)
        if known and _pointer(spark, root, known[-1])["content"] == content:
            return known[-1]
        for name, df in frames.items():
            df.write.format(form).save(f"{data}/{name}")
        while not done:
            known = _versions(spark, root)
            if known and _pointer(spark, root, known[-1])["content"] == content:
                return known[-1]
            new = known[-1] + 1 if known else 1
            done = _point(spark, root, new, {"content": content, "form": form, "parts": {n: f"{data}/{n}" for n in frames}})
        return new
    finally:
        if not done:
            fs.delete(place(data), True)


def package(spark: SparkSession, root: str, version: int | None = None) -> dict[str, DataFrame]:
    """The results of a version of a package, the last one if none is named."""
    about = _pointer(spark, root, _versions(spark, root)[-1] if version is None else version)
    return {name: spark.read.format(about["form"]).load(path) for name, path in about["parts"].items()}
