"""Digests of files of any size, for the joins that compare them with what is tracked."""

from __future__ import annotations

import hashlib
import os
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a file in memory at a time, and the most that a file may have (a clip's limit).
PIECE_BYTES, MOST_BYTES = 4 << 20, 2 << 30
_NAMES, _KINDS = ["path", "size", "sha256", "problem"], [pa.string(), pa.int64(), pa.string(), pa.string()]


def digest_of(path: str, most: int = MOST_BYTES, piece: int = PIECE_BYTES) -> tuple[int | None, str | None, str | None]:
    """(size, sha256, problem) of a regular file, read in pieces; a link is not followed.

    The file that was opened is the one that is judged, and a file that grew,
    shrank or was written while it was read is refused.
    """
    try:
        handle = os.open(path, os.O_RDONLY | os.O_NOFOLLOW | os.O_NONBLOCK)
    except OSError:
        kind = "symlink" if os.path.islink(path) else "unreadable" if os.path.lexists(path) else "absent"
        return None, None, kind
    with os.fdopen(handle, "rb", buffering=0) as f:
        before = os.fstat(f.fileno())
        if not stat.S_ISREG(before.st_mode):
            return None, None, "special"
        if before.st_size > most:
            return before.st_size, None, "too_large"
        digest, room, read = hashlib.sha256(), memoryview(bytearray(min(piece, before.st_size + 1))), 0
        while n := f.readinto(room):
            digest.update(room[:n])
            read += n
            if read > before.st_size:
                break
        after = os.fstat(f.fileno())
    if read != before.st_size or (after.st_size, after.st_mtime_ns) != (before.st_size, before.st_mtime_ns):
        return before.st_size, None, "changed_while_read"
    return read, digest.hexdigest(), None


def file_digests(files: DataFrame, path: str = "path", most: int = MOST_BYTES) -> DataFrame:
    """(path, size, sha256, problem) of each distinct path, on a file system that executors share.

    Paths are dealt to all tasks, and a task holds one piece of one file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # one row at a time: a file may take long, and rows found are not lost to a batch
            for name in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((name, *digest_of(name.removeprefix("file://"), most)), _KINDS)], _NAMES)

    # distinct deals paths by hash
    named = files.select(F.col(path).cast("string").alias("path")).where("path IS NOT NULL").distinct()
    return named.mapInArrow(run, "path string, size long, sha256 string, problem string")
