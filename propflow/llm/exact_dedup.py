"""Exact deduplication through a log-structured merge index of text digests.

1. Each task fills a memtable of (digest, identifier, count); a full memtable is
   flushed as sorted runs, one for each digest range ("shard"), each with a
   Bloom filter.  A memtable holds one entry for a digest however often it
   occurs, so a text that makes up a third of the corpus costs an entry a
   memtable.
2. Compaction merges the runs of a shard, smallest first.  The filter of the
   larger run tells which entries of the smaller can be in it; only those are
   searched for.  Merged entries keep the smallest identifier (or the largest)
   and the summed count.
3. Rows look their digest up in the index.  Entries that stand for several rows
   are hits, and every hit is verified byte by byte against the text of the row
   that stays; a mismatch stops the job.

Cases: a null text counts as empty.  A null identifier never stays unless all of
its group are null.  Rows alike in identifier and text share one verdict, and
each is counted in ``group_size``.  Other columns are not read.  An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propflow.llm.shared import keep_rows, partitions, staged, table, text_hash_of, text_of

MEMTABLE_ROWS = 65_536
#: Bits of a run's filter for each of its entries, and probes of it.
FILTER_BITS, PROBES = 10, 4
#: Most bits of the filter that tells hits when texts are read again.
HIT_FILTER_BITS = 1 << 26

_RUNS = "shard int, n long, digests binary, ids binary, counts binary, filter binary"


class Run:
    """Sorted distinct digests with an identifier and a count each, and a filter."""

    def __init__(self, digests: np.ndarray, ids: np.ndarray, counts: np.ndarray, bits: np.ndarray | None = None):
        self.digests, self.ids, self.counts = digests, ids, counts
        self.bits = self._filter() if bits is None else bits

    def _probes(self, digests: np.ndarray, size: int) -> np.ndarray:
        words = np.ascontiguousarray(digests).view("<u4").reshape(len(digests), 8)
        return words[:, 4 : 4 + PROBES] % np.uint32(size)

    def _filter(self) -> np.ndarray:
        size = max(64, len(self.digests) * FILTER_BITS + 7 & ~7)
        flags = np.zeros(size, np.uint8)
        flags[self._probes(self.digests, size).ravel()] = 1
        return np.packbits(flags)

    def maybe(self, digests: np.ndarray) -> np.ndarray:
        at = self._probes(digests, len(self.bits) * 8)
        return ((self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1)

    def merge(self, other: Run, best) -> Run:
        """This run, which is not the smaller one, with the entries of ``other``."""
        new = np.ones(len(other.digests), bool)
        asked = np.flatnonzero(self.maybe(other.digests))
        at = np.searchsorted(self.digests, other.digests[asked])
        inside = at < len(self.digests)
        asked, at = asked[inside], at[inside]
        same = self.digests[at] == other.digests[asked]
        asked, at = asked[same], at[same]
        self.ids[at] = best(self.ids[at], other.ids[asked])
        self.counts[at] += other.counts[asked]
        new[asked] = False
        if not new.any():
            return self
        digests = np.concatenate([self.digests, other.digests[new]])
        order = np.argsort(digests, kind="stable")
        return Run(
            digests[order],
            np.concatenate([self.ids, other.ids[new]])[order],
            np.concatenate([self.counts, other.counts[new]])[order],
        )


def _policy(keep: str):
    """How two identifiers combine, and the identifier that loses to all others."""
    info = np.iinfo(np.int64)
    return (np.maximum, info.min) if keep == "largest" else (np.minimum, info.max)


def _flush(digests: np.ndarray, ids: np.ndarray, best, shards: int) -> Iterator[dict]:
    order = np.argsort(digests, kind="stable")
    digests, ids = digests[order], ids[order]
    first = np.flatnonzero(np.r_[True, digests[1:] != digests[:-1]])
    counts = np.diff(np.r_[first, len(digests)]).astype(np.int64)
    digests, ids = digests[first], best.reduceat(ids, first)
    lead = np.ascontiguousarray(digests).view(np.uint8).reshape(-1, 32)[:, :4].astype(np.int64)
    shard = ((lead[:, 0] << 24 | lead[:, 1] << 16 | lead[:, 2] << 8 | lead[:, 3]) * shards) >> 32
    cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
    for a, b in zip(cuts, np.r_[cuts[1:], len(shard)]):
        yield _packed(int(shard[a]), Run(digests[a:b], ids[a:b], counts[a:b]))


def _packed(shard: int, run: Run) -> dict:
    return {
        "shard": shard,
        "n": len(run.digests),
        "digests": run.digests.tobytes(),
        "ids": run.ids.tobytes(),
        "counts": run.counts.tobytes(),
        "filter": run.bits.tobytes(),
    }


def _unpacked(row) -> Run:
    return Run(
        np.frombuffer(row.digests, "S32").copy(),
        np.frombuffer(row.ids, np.int64).copy(),
        np.frombuffer(row.counts, np.int64).copy(),
        np.frombuffer(row.filter, np.uint8),
    )


_ARROW_RUNS = pa.schema(
    [("shard", pa.int32()), ("n", pa.int64()), ("digests", pa.binary()), ("ids", pa.binary()), ("counts", pa.binary()), ("filter", pa.binary())]
)


def flush_runs(digests: DataFrame, keep: str, shards: int, memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """Sorted runs of a table (id long, digest binary of 32 bytes)."""
    best, loser = _policy(keep)

    def memtables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0
        for batch in batches:
            keys = batch.column(1).cast(pa.binary(32))
            ids = batch.column(0).fill_null(loser).to_numpy(zero_copy_only=False)
            raw = np.frombuffer(keys.buffers()[1], "S32", len(keys) + keys.offset)[keys.offset :]
            for at in range(0, len(raw), memtable_rows):
                held.append((raw[at : at + memtable_rows].copy(), ids[at : at + memtable_rows].copy()))
                rows += len(held[-1][0])
                if rows >= memtable_rows:
                    yield from out(held)
                    held, rows = [], 0
        if held:
            yield from out(held)

    def out(held):
        digests = np.concatenate([x[0] for x in held])
        if len(digests):
            yield pa.RecordBatch.from_pylist(list(_flush(digests, np.concatenate([x[1] for x in held]), best, shards)), _ARROW_RUNS)

    return digests.mapInArrow(memtables, _RUNS)


def compact(runs: DataFrame, keep: str) -> DataFrame:
    """One run for each shard."""
    best, _ = _policy(keep)

    def merged(key, segments):
        waiting = sorted((_unpacked(row) for row in segments.itertuples()), key=lambda r: -len(r.digests))
        while len(waiting) > 1:
            small = waiting.pop()
            other = waiting.pop()
            waiting.append(other.merge(small, best))
            # keep the list by falling size
            at = len(waiting) - 1
            while at and len(waiting[at].digests) > len(waiting[at - 1].digests):
                waiting[at], waiting[at - 1] = waiting[at - 1], waiting[at]
                at -= 1
        return pd.DataFrame([_packed(int(key[0]), waiting[0])])

    return runs.groupBy("shard").applyInPandas(merged, _RUNS)


def entries(index: DataFrame, keep: str, least: int = 1) -> DataFrame:
    """(digest, keep_id, group_size) of the entries that stand for ``least`` rows or more."""
    _, loser = _policy(keep)

    def opened(batches):
        for batch in batches:
            for row in batch.to_pandas().itertuples():
                run = _unpacked(row)
                for at in range(0, len(run.digests), 10_000):
                    part = slice(at, at + 10_000)
                    many = run.counts[part] >= least
                    ids = run.ids[part][many]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(ids), [None, pa.py_buffer(run.digests[part][many].tobytes())]).cast(pa.binary()),
                            pa.array(ids, mask=ids == loser),
                            pa.array(run.counts[part][many]),
                        ],
                        ["digest", "keep_id", "group_size"],
                    )

    return index.mapInArrow(opened, "digest binary, keep_id long, group_size long")


def _hit_filter(hits: DataFrame) -> np.ndarray:
    """A filter of bounded size over the digests of the hits."""
    size = 64
    wanted = min(HIT_FILTER_BITS, max(64, hits.count() * FILTER_BITS))
    while size < wanted:
        size *= 2
    place = [F.conv(F.substring(F.hex("digest"), 1 + 8 * k, 8), 16, 10).cast("long") % size for k in range(3)]
    words = (
        hits.select(F.explode(F.array(*place)).alias("bit"))
        .groupBy(F.expr("bit div 64").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("flags"))
        .toPandas()
    )
    out = np.zeros(size // 64, "<i8")
    out[words["word"].to_numpy(np.int64)] = words["flags"].to_numpy(np.int64)
    return out.view(np.uint8)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256, text_hash) for each row of ``docs``.

    ``keep``: ``smallest`` or ``largest``, the identifier that stays.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    digest = F.unhex(F.sha2("text", 256))
    shards = max(1, partitions(spark))
    runs = flush_runs(rows.select("id", digest.alias("digest")), keep, shards, memtable_rows)
    hits, _ = staged(entries(compact(runs, keep), keep, 2), "hits")
    bits = spark.sparkContext.broadcast(_hit_filter(hits))

    @F.pandas_udf("boolean")
    def maybe(digests: pd.Series) -> pd.Series:
        raw = np.frombuffer(b"".join(digests), ">u4").reshape(-1, 8)[:, :3].astype(np.int64) % (len(bits.value) * 8)
        return pd.Series(((bits.value[raw >> 3] >> (raw & 7).astype(np.uint8)) & 1).all(axis=1))

    # Texts are carried along for rows that may be hits only; the join settles which are.
    asked, _ = staged(
        rows.withColumn("digest", digest).withColumn("maybe", maybe("digest")).select(
            "id", "digest", text_hash_of(rows, "text").alias("text_hash"), F.when(F.col("maybe"), F.col("text")).alias("text")
        ),
        "asked",
    )
    stays = asked.where("text IS NOT NULL").select("digest", F.col("id").alias("keep_id"), F.col("text").alias("keep_text"))
    verified, _ = staged(
        hits.alias("h")
        .join(stays.alias("s"), (F.col("h.digest") == F.col("s.digest")) & F.col("h.keep_id").eqNullSafe(F.col("s.keep_id")))
        .select("h.digest", "h.keep_id", "group_size", "keep_text")
        .dropDuplicates(["digest"]),
        "verified",
    )
    joined = asked.join(verified, "digest", "left")
    same = F.when(
        F.col("group_size").isNotNull() & (F.col("text") != F.col("keep_text")),
        F.raise_error(F.lit("two texts have one SHA-256 digest")).cast("boolean"),
    ).otherwise(F.lit(True))
    keep_id = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return joined.where(same).select(
        F.col("id").alias(id_col),
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        F.col("text_hash"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row, with all its columns, of each group of equal texts."""
    verdicts, _ = staged(exact_dedup(docs, id_col, text_col, keep), "verdicts")
    return keep_rows(docs, verdicts.select(F.col(id_col).alias("id"), "text_hash", F.col("text_sha256").alias("group"), "kept"), id_col, text_col)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest").drop("text_hash")


SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
