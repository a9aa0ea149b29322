"""Image candidates from folders, archives and single files.

Listings are tables of entries (name, size, kind ...); every policy is a column
over them, and limits are aggregates, so one batch or a million are judged in
the same pass.  Python reads only the archive format itself.
"""

from __future__ import annotations

import hashlib
import io
import itertools
import lzma
import os
import stat
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from propflow.functions.rules import archive_name_problem
from propflow.functions.text import collision_key

#: Suffixes of images and of archives within archives.
IMAGES = (".jpg", ".jpeg", ".png")
NESTED = (".zip", ".7z", ".rar", ".tar", ".gz", ".tgz")
#: Members of an archive that are held at a time.
BATCH_BYTES = 8 << 20


@dataclass(frozen=True)
class Limits:
    """Bounds of one batch."""

    entries: int = 256
    images: int = 100
    file_bytes: int = 50 << 20
    total_bytes: int = 512 << 20
    archive_bytes: int = 256 << 20
    ratio: float = 200.0
    distance: int = 6
    depth: int = 32

    def __post_init__(self):
        whole = (self.entries, self.images, self.file_bytes, self.total_bytes, self.archive_bytes, self.distance)
        if any(isinstance(x, bool) or not isinstance(x, int) for x in whole):
            raise ValueError("bounds are whole numbers")
        ranges = {
            "entries": (1, 10_000), "images": (1, self.entries), "file_bytes": (1024, None), "total_bytes": (self.file_bytes, None),
            "archive_bytes": (1024, None), "ratio": (1.0, 10_000.0), "distance": (0, 64),
        }
        for name, (low, high) in ranges.items():
            value = getattr(self, name)
            if value < low or high is not None and value > high:
                raise ValueError(f"{name} must lie between {low} and {high}")


def suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"[^/.][^/]*?(\.[^./]+)$", 1))


def source_kind(name: Column, directory: Column) -> Column:
    """How a source is read: folder, archive, image or not at all."""
    return F.when(directory, "directory").when(suffix(name) == ".zip", "zip").when(suffix(name).isin(*IMAGES), "file").otherwise("unsupported")


#: What a damaged archive or member raises.
DAMAGE = (OSError, RuntimeError, zipfile.BadZipFile, EOFError, ValueError, NotImplementedError, zlib.error, lzma.LZMAError)
#: Bytes of a member or file read at a time.
PIECE_BYTES = 1 << 20


@dataclass(frozen=True)
class Member:
    """A member of an archive as its directory tells it, and what reading it told."""

    ix: int
    name: str
    directory: bool
    mode_kind: str
    encrypted: bool
    file_size: int
    packed_size: int
    nested: bool = False
    damaged: bool = False
    sha256: str | None = None
    content: bytes | None = None


def listed(ix: int, info: zipfile.ZipInfo) -> Member:
    kind = stat.S_IFMT(info.external_attr >> 16 & 0xFFFF)
    mode = {stat.S_IFLNK: "symlink", stat.S_IFDIR: "directory", stat.S_IFREG: "regular", 0: "regular"}.get(kind, "special")
    return Member(ix, info.orig_filename, info.is_dir() or mode == "directory", mode, bool(info.flag_bits & 1), info.file_size, info.compress_size)


def within(archive: zipfile.ZipFile, limits: Limits) -> bool:
    """Whether an archive's directory alone keeps the limits; if not, nothing of it is inflated."""
    members = archive.infolist()
    return len(members) <= limits.entries and sum(m.file_size for m in members) <= limits.total_bytes


def opened(archive: zipfile.ZipFile, info: zipfile.ZipInfo, member: Member, limits: Limits, keep: bool) -> Member:
    """The member with its digest, read in pieces, and its content if that is to be kept."""
    small = 0 < info.file_size <= min(limits.file_bytes, limits.ratio * max(1, info.compress_size))
    if member.directory or member.encrypted or not small:
        return member
    digest, size, head, pieces = hashlib.sha256(), 0, b"", []
    try:
        with archive.open(info) as f:
            while size <= limits.file_bytes and (piece := f.read(PIECE_BYTES)):
                digest.update(piece)
                size += len(piece)
                head = head or piece[:4]
                if keep:
                    pieces.append(piece)
    except DAMAGE:
        return replace(member, damaged=True)
    if size != info.file_size:
        return replace(member, damaged=True)
    return replace(member, nested=head in (b"PK\3\4", b"PK\5\6", b"PK\7\b"), sha256=digest.hexdigest(), content=b"".join(pieces) if keep else None)


ENTRIES = "archive string, ix int, name string, directory boolean, mode_kind string, encrypted boolean, file_size long, packed_size long, nested boolean, damaged boolean, content binary"


def zip_entries(archives: DataFrame, key: str, content: str, with_content: bool = False, limits: Limits = Limits()) -> DataFrame:
    """Entries of zip archives, in the order of their directories; a file that is no archive gives one damaged entry.

    Contents are read only where asked for, up to the limit of a file.
    """

    def one(name, data):
        try:
            archive = zipfile.ZipFile(io.BytesIO(data or b""))
        except DAMAGE:
            yield (name, -1, None, False, "regular", False, 0, 0, False, True, None)
            return
        open_ = within(archive, limits)
        for ix, info in enumerate(archive.infolist()):
            m = listed(ix, info)
            m = opened(archive, info, m, limits, with_content) if open_ else m
            yield (name, ix, m.name, m.directory, m.mode_kind, m.encrypted, m.file_size, m.packed_size, m.nested, m.damaged, m.content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()]
        names = [c.split()[0] for c in ENTRIES.split(", ")]
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, held = [], 0
                for row in one(name, data):
                    rows.append(row)
                    held += len(row[-1] or b"") + 200
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    data = F.when(F.octet_length(content) <= limits.archive_bytes, F.col(content))
    return archives.select(F.col(key).cast("string").alias("archive"), data.alias("content")).mapInArrow(run, ENTRIES)


def entry_problems(entries: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Entries with ``problem``: why the whole archive is refused (null for none), and ``accepted``."""
    whole = Window.partitionBy("archive")
    order = whole.orderBy("ix").rowsBetween(Window.unboundedPreceding, 0)
    size = F.when(F.col("directory"), 0).otherwise(F.col("file_size"))
    image = ~F.col("directory") & suffix(F.col("name")).isin(*IMAGES)
    keyed = entries.withColumn("key", collision_key(F.regexp_replace("name", "/$", ""))).withColumns(
        {
            "same": F.count("key").over(Window.partitionBy("archive", "key")),
            "total": F.sum(size).over(order),
            "n": F.count(F.lit(1)).over(whole),
            "images": F.count_if(image).over(whole),
        }
    )
    # a file where another entry has a folder
    files = keyed.where("NOT directory").select(F.col("archive").alias("a"), F.col("key").alias("k")).distinct()
    parts = F.split("key", "/")
    above = keyed.select("archive", "ix", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("up"), "key").where("up <> key")
    clash = above.join(files, (F.col("archive") == F.col("a")) & (F.col("up") == F.col("k")), "left_semi").select("archive", "ix").distinct().withColumn("clashes", F.lit(True))
    problem = (
        F.when((F.col("ix") < 0), "not_an_archive")
        .when(F.col("n") > limits.entries, "entries")
        .when(F.col("encrypted"), "encrypted")
        .when(F.col("mode_kind").isin("symlink", "special"), F.col("mode_kind"))
        .when(archive_name_problem(F.col("name"), F.col("directory")).isNotNull(), archive_name_problem(F.col("name"), F.col("directory")))
        .when(F.col("same") > 1, "collision")
        .when(~F.col("directory") & (F.col("file_size") > limits.file_bytes), "file_size")
        .when(F.col("total") > limits.total_bytes, "total_size")
        .when(~F.col("directory") & (F.col("file_size") > 0) & ((F.col("packed_size") == 0) | (F.col("file_size") / F.col("packed_size") > limits.ratio)), "ratio")
        .when(F.col("clashes"), "file_and_folder")
        .when(~F.col("directory") & (F.col("nested") | suffix(F.col("name")).isin(*NESTED)), "nested")
        .when(F.col("images") > limits.images, "images")
        .when(F.col("damaged"), "damaged")
    )
    out = keyed.join(clash, ["archive", "ix"], "left").withColumn("problem", problem)
    first = F.min_by("problem", F.when(F.col("problem").isNotNull(), F.col("ix"))).over(whole)
    return out.withColumn("archive_problem", first).withColumn("accepted", image & F.col("archive_problem").isNull()).drop("key", "same", "total", "n", "images", "clashes")


def folder_problems(entries: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The same for entries (batch, relative_path, kind, size) of scanned folders, in their order."""
    path = F.col("relative_path")
    order = Window.partitionBy("batch").orderBy(collision_key(path), path)
    depth = F.size(F.split(path, "/")) - 1
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    out = entries.withColumns(
        {
            "ix": F.row_number().over(order),
            "same": F.count(F.lit(1)).over(Window.partitionBy("batch", collision_key(path))),
            "total": F.sum("size").over(running),
            "images": F.count_if(suffix(path).isin(*IMAGES) & (F.col("kind") == "file")).over(Window.partitionBy("batch")),
        }
    )
    problem = (
        F.when(depth > limits.depth, "depth")
        .when(F.col("ix") > limits.entries, "entries")
        .when(archive_name_problem(path, F.lit(False)).isNotNull(), archive_name_problem(path, F.lit(False)))
        .when(F.col("same") > 1, "collision")
        .when(F.col("kind").isin("symlink", "special"), F.col("kind"))
        .when(F.col("total") > limits.total_bytes, "total_size")
        .when(suffix(path).isin(*NESTED) & (F.col("kind") == "file"), "nested")
        .when(suffix(path).isin(*IMAGES) & (F.col("size") > limits.file_bytes), "file_size")
        .when(F.col("images") > limits.images, "images")
    )
    judged = out.withColumn("problem", problem)
    first = F.min_by("problem", F.when(F.col("problem").isNotNull(), F.col("ix"))).over(Window.partitionBy("batch"))
    image = (F.col("kind") == "file") & suffix(path).isin(*IMAGES)
    return judged.withColumn("batch_problem", first).withColumns(
        {
            "accepted": image & F.col("batch_problem").isNull(),
            "reason": F.when((F.col("kind") == "file") & ~image & F.col("problem").isNull(), "unsupported_suffix"),
        }
    ).drop("same", "total", "images")


def folder_entries(folders: DataFrame, batch: str, path: str, limits: Limits = Limits()) -> DataFrame:
    """(batch, relative_path, kind, size) of all that lies under folders of a file system that tasks share.

    kind: file, symlink, special or directory (only those too deep to be gone
    into).  Links are named and never followed.  Of a folder over the limit of
    entries no more are listed than tell that it is.
    """

    def walk(top: str, inner: str, depth: int):
        for entry in sorted(os.scandir(os.path.join(top, inner)), key=lambda e: e.name):
            name = f"{inner}/{entry.name}" if inner else entry.name
            if entry.is_symlink():
                yield name, "symlink", 0
            elif entry.is_dir(follow_symlinks=False):
                if depth <= limits.depth:
                    yield from walk(top, name, depth + 1)
                else:
                    yield name, "directory", 0
            else:
                regular = entry.is_file(follow_symlinks=False)
                yield name, "file" if regular else "special", entry.stat(follow_symlinks=False).st_size if regular else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for key, top in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                found = list(itertools.islice(walk(top, "", 0), limits.entries + 1))
                names, kinds, sizes = zip(*found) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(names), pa.string()), pa.array(names, pa.string()), pa.array(kinds, pa.string()), pa.array(sizes, pa.int64())], ["batch", "relative_path", "kind", "size"])

    return folders.select(F.col(batch).cast("string"), F.col(path).cast("string")).mapInArrow(run, "batch string, relative_path string, kind string, size long")


def scan_folder(spark: SparkSession, path: str, limits: Limits = Limits()) -> DataFrame:
    """(path, modificationTime, length, content) of the images under a folder, not over the limit of a file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where((F.col("length") <= limits.file_bytes) & suffix(F.col("path")).isin(*IMAGES))


def folder_fingerprint(files: DataFrame, group: str, name: str, sha256: str) -> DataFrame:
    """One digest a folder over names and digests of its files, in the order of names."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(name).alias("n"), F.col(sha256).alias("h"))))
    body = F.array_join(F.transform(ordered, lambda x: F.concat(x["n"], F.lit("\0"), x["h"], F.lit("\0"))), "")
    return files.groupBy(group).agg(F.count(F.lit(1)).alias("n_files"), F.sha2(body, 256).alias("fingerprint"))


def missing_clips(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Scenes whose expected file is not among the files found (by name)."""
    return expected.join(found, expected.expected_filename == found.name, "left_anti")
