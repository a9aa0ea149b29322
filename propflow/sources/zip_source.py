"""Members of zip archives as a data source: ``spark.read.format("zip_members")``.

Partitions are planned from sizes: small archives share one, and the members of
a large archive are dealt by its directory, so one archive is read by many tasks.
Conditions on what a directory tells (name, size, kind and so on) are looked at
before a member is inflated.  A member is read in pieces; digests are made on the
way, and contents are kept only where they are asked for.

Options: ``path``, an archive or a folder of them, on a file system that driver
and executors share; ``blockBytes``, packed bytes of a partition; ``content``,
whether to give contents; ``where``, conditions as a JSON list of (column,
comparison, value), all of which must hold; and the names of ``Limits``.

Conditions are an option, and not taken from a query's own filters: this version
of Spark plans a relation's scans with one reader, so the filters of one scan
would be those of all others of the same frame in a query, and rows would be lost.

Links are not followed.  A file that is no archive gives one damaged row, and a
damaged member is a row like any other.
"""

from __future__ import annotations

import json
import operator
import os
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, fields

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D

from propflow.sources.archives import BATCH_BYTES, DAMAGE, Limits, Member, listed, opened, within

SCHEMA = "archive string, ix int, name string, directory boolean, mode_kind string, encrypted boolean, file_size long, packed_size long, nested boolean, damaged boolean, sha256 string, content binary"
_KINDS = [pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string(), pa.binary()]
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
#: Columns that are known before a member is inflated.
CHEAP = frozenset(_NAMES[:8])
BLOCK_BYTES = 64 << 20
#: Most tasks that members are dealt to; beyond, each takes several blocks in a row.
MOST_TASKS = 512


@dataclass
class Members(D.InputPartition):
    """Archives read whole (``last`` is None), or a range of one archive's members."""

    paths: list[str]
    first: int = 0
    last: int | None = None


@dataclass
class Several(D.InputPartition):
    """Blocks in a row, where there are very many."""

    parts: list[Members]


def put_together(parts: list[Members]) -> list[D.InputPartition]:
    """The same blocks for at most ``MOST_TASKS`` tasks; neighbours within an archive become one range."""
    if len(parts) <= MOST_TASKS:
        return parts
    out = []
    for k in range(MOST_TASKS):
        some: list[Members] = []
        for part in parts[len(parts) * k // MOST_TASKS : len(parts) * (k + 1) // MOST_TASKS]:
            if some and part.last is not None and some[-1].last == part.first and some[-1].paths == part.paths:
                some[-1] = Members(part.paths, some[-1].first, part.last)
            else:
                some.append(part)
        out.append(Several(some))
    return out


_COMPARISONS = {
    "=": operator.eq, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "in": lambda a, b: a in b, "prefix": str.startswith, "suffix": str.endswith, "contains": operator.contains,
}


def holds(conditions: list[tuple], row: dict) -> bool:
    """Whether all conditions hold; none does for a null."""
    return all(row[column] is not None and _COMPARISONS[comparison](row[column], value) for column, comparison, value in conditions)


class ZipMembers(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> D.DataSourceReader:
        return ZipReader({k.lower(): v for k, v in self.options.items()})


class ZipReader(D.DataSourceReader):
    def __init__(self, options: dict[str, str]):
        if not options.get("path"):
            raise ValueError("zip_members needs a path")
        self.path = options["path"].removeprefix("file://")
        self.block = int(options.get("blockbytes", BLOCK_BYTES))
        self.content = options.get("content", "false").lower() == "true"
        self.limits = Limits(**{f.name: (float if f.name == "ratio" else int)(options[f.name]) for f in fields(Limits) if f.name in options})
        self.where = [tuple(x) for x in json.loads(options.get("where", "[]"))]
        for column, comparison, _ in self.where:
            if column not in CHEAP or comparison not in _COMPARISONS:
                raise ValueError(f"no condition of the directory: {column} {comparison}")

    def _archives(self) -> Iterator[tuple[str, int]]:
        if not os.path.isdir(self.path):
            yield self.path, os.stat(self.path, follow_symlinks=False).st_size
            return
        for entry in sorted(os.scandir(self.path), key=lambda e: e.name):
            if entry.is_file(follow_symlinks=False) and entry.name.lower().endswith(".zip"):
                yield entry.path, entry.stat(follow_symlinks=False).st_size

    def _about(self, path: str, m: Member | None) -> dict:
        m = m or Member(-1, None, False, "regular", False, 0, 0)
        return {"archive": os.path.basename(path), "ix": m.ix, "name": m.name, "directory": m.directory, "mode_kind": m.mode_kind, "encrypted": m.encrypted, "file_size": m.file_size, "packed_size": m.packed_size}

    def partitions(self) -> list[D.InputPartition]:
        out: list[Members] = []
        some: list[str] = []
        held = 0
        of_name = [x for x in self.where if x[0] == "archive"]
        for path, size in self._archives():
            if not holds(of_name, {"archive": os.path.basename(path)}):
                continue
            if self.block < size <= self.limits.archive_bytes:
                # only large archives have their directories read here
                out += self._ranges(path)
                continue
            some.append(path)
            held += size
            if held >= self.block:
                out.append(Members(some))
                some, held = [], 0
        return put_together(out + ([Members(some)] if some else []) or [Members([])])

    def _ranges(self, path: str) -> list[Members]:
        try:
            with zipfile.ZipFile(path) as archive:
                sizes = [m.compress_size for m in archive.infolist()]
        except DAMAGE:
            return [Members([path])]
        out, first, held = [], 0, 0
        for k, size in enumerate(sizes):
            held += size
            if held >= self.block:
                out.append(Members([path], first, k + 1))
                first, held = k + 1, 0
        return out + ([Members([path], first, len(sizes))] if first < len(sizes) or not out else [])

    def _rows(self, part: Members) -> Iterator[tuple]:
        for path in part.paths:
            name = os.path.basename(path)
            try:
                if os.stat(path, follow_symlinks=False).st_size > self.limits.archive_bytes:
                    raise ValueError("an archive over the limit")
                archive = zipfile.ZipFile(path)
            except DAMAGE:
                if holds(self.where, self._about(path, None)):
                    yield (name, -1, None, False, "regular", False, 0, 0, False, True, None, None)
                continue
            with archive:
                open_, members = within(archive, self.limits), archive.infolist()
                for ix in range(part.first, len(members) if part.last is None else part.last):
                    m = listed(ix, members[ix])
                    if not holds(self.where, self._about(path, m)):
                        continue
                    m = opened(archive, members[ix], m, self.limits, self.content) if open_ else m
                    yield (name, ix, m.name, m.directory, m.mode_kind, m.encrypted, m.file_size, m.packed_size, m.nested, m.damaged, m.sha256, m.content)

    def read(self, partition: D.InputPartition) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for row in (row for part in getattr(partition, "parts", [partition]) for row in self._rows(part)):
            rows.append(row)
            held += len(row[-1] or b"") + 200
            if held > BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _KINDS)], _NAMES)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _KINDS)], _NAMES)


def archives(spark: SparkSession, path: str, where: tuple = (), **options) -> DataFrame:
    """Members of the archives at ``path``, those for which all conditions hold."""
    spark.dataSource.register(ZipMembers)
    return spark.read.format("zip_members").options(path=path, where=json.dumps(list(where)), **{k: str(v) for k, v in options.items()}).load()
