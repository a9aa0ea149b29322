"""Mixing sources to target weights by a low-discrepancy schedule.

1. Sizes (words) are summed by source.  Sources in code-point order take the
   given weights in turn; their targets share a multiple of all words, and a
   source whose target would pass ``most`` times its size is held there, the
   excess going to the others by weight.
2. Each source is put in an order shuffled by a hash and cut into blocks of
   equal word counts.
3. Slot k of the schedule lies at the k-th point of the golden-ratio sequence,
   mapped through the cumulative weights of the sources; a source's slots are
   ranked, and rank r takes block ``r mod blocks`` in pass ``r div blocks``.  A
   source stops when its target is reached, in the middle of a block if need be;
   what the schedule leaves short by (its discrepancy) is put at its end.
4. Slots and blocks are joined, which gives the pieces of documents to read.

Running totals are taken in two levels, sums of small groups and then rows
within a group, so that no task gets a whole source.

Cases: null text has size 0 and is never taken; a null source is a source of its
own, after all others; null identifiers and repeated rows are rows like any
other.  An empty table, or one without words, gives targets of 0.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from propflow.llm.shared import staged, table, text_hash_of, text_of

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2.0
#: Blocks of a source: so many at least, of so many words at most.
LEAST_BLOCKS, MOST_WORDS = 64, 4096
#: Rows of a group whose running total one task takes.
GROUP_ROWS = 512
#: Slots of a chunk of the schedule.
CHUNK = 256
#: Points are multiples of 2 ** -31; the step is the odd number next to 2 ** 31 over the golden ratio.
POINTS, STEP = 1 << 31, 1327217885
#: A source table of at most this many rows is broadcast.
BROADCAST_SOURCES = 10_000


def word_count(text):
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: list[int], weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Words for each source, the sources being in order."""
    total = Fraction(sum(sizes)) * Fraction(share)
    weight = [Fraction(weights[i % len(weights)]) for i in range(len(sizes))]
    limit = [Fraction(most) * n for n in sizes]
    out = [Fraction(0)] * len(sizes)
    open_, left, rest = set(range(len(sizes))), total, sum(weight)
    # by the ratio at which a source reaches its limit: those held are a prefix
    for i in sorted(open_, key=lambda i: limit[i] / weight[i]):
        level = left / rest
        if level * weight[i] <= limit[i]:
            break
        out[i] = limit[i]
        left -= limit[i]
        open_.remove(i)
        rest -= weight[i]
    if open_:
        level = left / rest
        for i in open_:
            out[i] = level * weight[i]
    return [float(x) for x in out]


def _plan(spark: SparkSession, sized: DataFrame, weights, share: float, most: float) -> list[dict]:
    """One record a source: sizes, target, words to take, blocks."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows")).collect()
    rows = sorted(rows, key=lambda r: (r.source is None, (r.source or "").encode("utf-32-be")))
    out = []
    for i, (row, target) in enumerate(zip(rows, targets([r.words for r in rows], weights, share, most))):
        block = max(1, min(MOST_WORDS, row.words // LEAST_BLOCKS))
        out.append(
            {
                "sid": i,
                "source": row.source,
                "source_size": row.words,
                "target": target,
                "quota": min(round(target), math.floor(most * row.words)),
                "block": block,
                "blocks": max(1, -(-row.words // block)),
                "groups": max(1, -(-row.rows // GROUP_ROWS)),
            }
        )
    return out


_SOURCES = "sid int, source string, source_size long, target double, quota long, block long, blocks long, groups long"


def _pieces(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Parts of documents by block: (sid, block_no, row keys, from, to) in words of the block."""
    shuffled = F.shiftrightunsigned(F.xxhash64(F.lit(17), "id"), 33)
    placed = (
        sized.join(sources, sized.source.eqNullSafe(sources.source))
        .select("sid", "id", "size", "text_hash", "source_size", "target", "block", "groups", shuffled.alias("at"))
        .withColumn("grp", F.expr("shiftrightunsigned(at * groups, 31)"))
    )
    sums = placed.groupBy("sid", "grp").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("sid").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("sid", "grp", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("sid", "grp").orderBy("at", "id", "size", "text_hash")
    rows = placed.withColumns(
        {
            "nth": F.row_number().over(inside),
            "inner": F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        }
    )
    rows = rows.join(bases, ["sid", "grp"]).withColumn("start", F.col("base") + F.col("inner"))
    return (
        rows.withColumn("block_no", F.explode(F.expr("sequence(start div block, (start + greatest(size, 1) - 1) div block)")))
        .withColumn("from", F.expr("greatest(start, block_no * block) - block_no * block"))
        .withColumn("to", F.expr("least(start + size, (block_no + 1) * block) - block_no * block"))
        .drop("at", "inner", "base", "block")
    )


def schedule(spark: SparkSession, plan: list[dict]) -> DataFrame:
    """(k, sid, rank, block_no, pass, take): what each slot of the mix reads, in order of k."""
    # a pass's last block is short, so passes count by their blocks and only the rest by words
    need = [p["quota"] // max(1, p["source_size"]) * p["blocks"] + -(-(p["quota"] % max(1, p["source_size"])) // p["block"]) for p in plan]
    slots = sum(need)
    edges = np.array([POINTS * n // max(1, slots) for n in itertools.accumulate(need)], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in batch.column(0).to_pylist():
                k = np.arange(chunk * CHUNK, min(slots, (chunk + 1) * CHUNK), dtype=np.int64)
                sid = np.searchsorted(edges, (k % POINTS) * STEP % POINTS, "right")
                order = np.argsort(sid, kind="stable")
                first = np.searchsorted(sid[order], sid[order], "left")
                nth = np.empty(len(k), np.int64)
                nth[order] = np.arange(len(k)) - first
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(sid.astype(np.int32)), pa.array(np.full(len(k), chunk)), pa.array(nth)], ["k", "sid", "chunk", "nth"])

    chunks = spark.range(0, -(-slots // CHUNK))
    drawn = chunks.mapInArrow(run, "k long, sid int, chunk long, nth long")
    counts = drawn.groupBy("sid", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("sid", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = drawn.join(bases, ["sid", "chunk"]).select("k", "sid", (F.col("base") + F.col("nth")).alias("rank"))
    got = counts.groupBy("sid").agg(F.sum("n").alias("got"))
    wanted = _source_table(spark, [p | {"need": n} for p, n in zip(plan, need)], _SOURCES + ", need long")
    short = (
        wanted.join(got, "sid", "left")
        .withColumn("got", F.coalesce("got", F.lit(0)))
        .where("got < need")
        .select("sid", F.explode(F.expr("sequence(got, need - 1)")).alias("rank"))
        .select((F.lit(slots) + F.col("rank")).alias("k"), "sid", "rank")
    )
    both = ranked.unionByName(short).join(wanted, "sid").where("rank < need")
    length = F.expr("least(block, source_size - block_no * block)")
    return (
        both.withColumn("block_no", F.expr("rank % blocks"))
        .withColumn("pass", F.expr("rank div blocks"))
        .withColumn("take", F.greatest(F.lit(0), F.least(length, F.expr("quota - pass * source_size - block_no * block"))))
        .select("k", "sid", "rank", "block_no", "pass", "take")
    )


def _source_table(spark: SparkSession, plan: list[dict], schema: str = _SOURCES) -> DataFrame:
    out = spark.createDataFrame([tuple(p.values()) for p in plan], schema)
    return F.broadcast(out) if len(plan) <= BROADCAST_SOURCES else out


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(id, size, source_size, target, taken, text_hash) for each row of ``docs``."""
    spark = docs.sparkSession
    sized, _ = staged(
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), word_count(text_of(text_col)).alias("size"), text_hash_of(docs, text_col).alias("text_hash")),
        "sizes",
    )
    plan = _plan(spark, sized, weights, share, most)
    if not plan:
        return spark.createDataFrame([], f"{id_col} long, size long, source_size long, target double, taken long, text_hash long")
    pieces = _pieces(sized, _source_table(spark, plan))
    slots = schedule(spark, plan)
    read = F.greatest(F.lit(0), F.least("to", "take") - F.col("from"))
    return (
        pieces.join(slots, ["sid", "block_no"], "left")
        .groupBy("sid", "grp", "nth", "id", "size", "source_size", "target", "text_hash")
        .agg(F.sum(F.coalesce(read, F.lit(0))).cast("long").alias("taken"))
        .select(F.col("id").alias(id_col), "size", "source_size", "target", "taken", "text_hash")
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Whole rows as often as the mix takes them: words taken over size, rounded."""
    taken = mix(docs, id_col, text_col, source_col, weights, share, most)
    times = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    counts, _ = staged(
        taken.where("size > 0").groupBy(F.col(id_col).alias("_id"), F.col("text_hash").alias("_hash")).agg(F.max(times).alias("_times")).where("_times > 0"), "times"
    )
    # distinct keys are hashed and rows stream past them, so texts are never sorted
    met = docs.join(counts.hint("shuffle_hash"), docs[id_col].cast("long").eqNullSafe(counts["_id"]) & (text_hash_of(docs, text_col) == counts["_hash"]))
    return met.withColumn("_nth", F.explode(F.sequence(F.lit(1), "_times"))).select(*[docs[c] for c in docs.columns])


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("text_hash")
