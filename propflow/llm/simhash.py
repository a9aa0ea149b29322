"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has 64 bits; each is set if it is set in over half the XXH64
hashes of the text's word shingles.  Two fingerprints that differ in at most
``radius`` bits share a value within ``radius / 2`` bits of both, so every
distinct fingerprint emits all values within half the radius (65 for radius 2),
and equal values meet in a shuffle.  Within a value's bucket the fingerprints,
at most 65 distinct ones, are chained in order rather than paired; each link is
verified and deduplicated, and links give components.

Texts that share four fifths of their shingles differ in about ten bits of 64,
and no ball of that radius can be emitted.  ``similar`` therefore takes a wide
fingerprint of ``TABLES`` words of 32 bits and emits the ball of radius 1 of each
word, so two texts collide if a word of theirs differs in two bits or fewer.  Every
colliding pair is either in one component already, by links of equal words that
were verified before, or is verified by the distance of the whole wide fingerprints.

Cases: a null text counts as empty.  A text of fewer words than a shingle has
one shingle, the whole sequence; one without words has fingerprint zero and is
linked like any other.  A null identifier is never a component's smallest unless
it has no other.  Rows alike in identifier count once each.  Other columns are
not read.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from propflow.llm.components import components
from propflow.llm.shared import give_back, keep_rows, numbered, staged, table, text_hash_of, text_of

#: Fixed values of XXH64.
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(0x9E3779B185EBCA87),
    np.uint64(0xC2B2AE3D27D4EB4F),
    np.uint64(0x165667B19E3779F9),
    np.uint64(0x85EBCA77C2B2AE63),
    np.uint64(0x27D4EB2F165667C5),
)
SEED = np.uint64(42)
#: 32-bit words of a wide fingerprint.  Each is a table of its own in which alike texts may meet.
TABLES = 12
#: Bits of a wide fingerprint in which alike texts may differ: a similarity of 0.8 turns 0.1515
#: of all bits (58) on average, with a deviation of 7, so this keeps five sixths of the pairs that are just alike.
WIDE_DISTANCE = 66
#: Text bytes and shingles that a task works on at a time.
BLOCK_BYTES, BLOCK_SHINGLES = 1 << 18, 1 << 15
#: Rows of a bucket that a task compares with as many, and pairs of which it counts the bits at a time.
BUCKET_ROWS, BLOCK_PAIRS = 4096, 1 << 18


def _rotl(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: np.uint64 = SEED) -> np.ndarray:
    """XXH64 of the slices ``data[starts:ends]`` of a byte array, all at once."""
    data = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    four = np.ndarray((len(data) - 3,), "<u4", data, 0, (1,))
    length = (ends - starts).astype(np.uint64)
    at = starts.astype(np.int64).copy()
    with np.errstate(over="ignore"):
        out = np.full(len(at), seed + _P5, np.uint64)
        long = np.flatnonzero(length >= 32)
        if len(long):
            lanes = [np.full(len(long), v, np.uint64) for v in (seed + _P1 + _P2, seed + _P2, seed, seed - _P1)]
            left = length[long] >> np.uint64(5)
            step, on = 0, np.arange(len(long))
            while len(on):
                for k in range(4):
                    lanes[k][on] = _round(lanes[k][on], eight[at[long[on]] + 8 * k])
                at[long[on]] += 32
                step += 1
                on = on[left[on] > step]
            mixed = _rotl(lanes[0], 1) + _rotl(lanes[1], 7) + _rotl(lanes[2], 12) + _rotl(lanes[3], 18)
            for lane in lanes:
                mixed = (mixed ^ _round(np.zeros_like(lane), lane)) * _P1 + _P4
            out[long] = mixed
        out += length
        left = (length & np.uint64(31)).astype(np.int64)
        for _ in range(3):
            on = np.flatnonzero(left >= 8)
            if not len(on):
                break
            lane = _round(np.zeros(len(on), np.uint64), eight[at[on]])
            out[on] = _rotl(out[on] ^ lane, 27) * _P1 + _P4
            at[on] += 8
            left[on] -= 8
        on = np.flatnonzero(left >= 4)
        out[on] = _rotl(out[on] ^ (four[at[on]].astype(np.uint64) * _P1), 23) * _P2 + _P3
        at[on] += 4
        left[on] -= 4
        for _ in range(3):
            on = np.flatnonzero(left > 0)
            if not len(on):
                break
            out[on] = _rotl(out[on] ^ (data[at[on]].astype(np.uint64) * _P5), 11) * _P1
            at[on] += 1
            left[on] -= 1
        out ^= out >> np.uint64(33)
        out *= _P2
        out ^= out >> np.uint64(29)
        out *= _P3
        out ^= out >> np.uint64(32)
    return out


def lane(h: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th hash derived from each hash: the hash itself, then mixes of it."""
    if not k:
        return h
    with np.errstate(over="ignore"):
        h = (h + np.uint64(k) * _P3) * _P1
        h = (h ^ (h >> np.uint64(29))) * _P2
        return h ^ (h >> np.uint64(32))


def fingerprints(data: np.ndarray, offsets: np.ndarray, words: int = 3, lanes: int = 1) -> np.ndarray:
    """SimHash of the texts ``data[offsets[i]:offsets[i + 1]]``, UTF-8 bytes.

    With several lanes, a row of as many 64-bit fingerprints for each text.
    """
    n = len(offsets) - 1
    result = np.zeros(n, np.uint64) if lanes == 1 else np.zeros((n, lanes), np.uint64)
    solid = ~((data == 0x20) | ((data >= 0x09) & (data <= 0x0D)))
    place = np.flatnonzero(solid)
    if not len(place):
        return result
    doc = np.searchsorted(offsets, place, "right") - 1
    begins = np.r_[True, (np.diff(place) > 1) | (np.diff(doc) > 0)]
    word = np.cumsum(begins) - 1
    # the words, lower-cased, with one space before each
    clean = np.full(len(place) + word[-1] + 1, 0x20, np.uint8)
    letters = data[place]
    clean[np.arange(len(place)) + word + 1] = np.where((letters >= 0x41) & (letters <= 0x5A), letters | 0x20, letters)
    first = np.flatnonzero(begins)
    starts = first + np.arange(len(first)) + 1
    ends = np.r_[starts[1:] - 1, len(clean)]
    owner = doc[first]
    counts = np.bincount(owner, minlength=n)
    lead = np.cumsum(counts) - counts
    # a text of w words has max(1, w - words + 1) shingles, one without words none
    shingles = np.where(counts > 0, np.maximum(counts - words + 1, 1), 0)
    of = np.repeat(np.arange(n), shingles)
    head = np.arange(len(of)) - np.repeat(np.cumsum(shingles) - shingles, shingles) + lead[of]
    tail = head + np.minimum(counts[of], words) - 1
    votes = np.zeros((lanes, n, 64), np.int64)
    for a in range(0, len(of), BLOCK_SHINGLES):
        part = slice(a, a + BLOCK_SHINGLES)
        h = xxh64(clean, starts[head[part]], ends[tail[part]])
        cut = np.flatnonzero(np.r_[True, np.diff(of[part]) > 0])
        for k in range(lanes):
            bits = np.unpackbits(lane(h, k).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            votes[k, of[part][cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int64)
    over = votes * 2 > shingles[None, :, None]
    prints = np.packbits(over, axis=2, bitorder="little").view("<u8")[:, :, 0]
    return prints[0] if lanes == 1 else np.ascontiguousarray(prints.T)


def _text_blocks(column: pa.Array, most: int = BLOCK_BYTES):
    """Ranges of rows whose texts are about ``most`` bytes; a longer text is alone."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp, text_hash): the fingerprint of each row as a signed 64-bit number."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [fingerprints(data, offsets, words) for data, offsets in _text_blocks(batch.column(2))]
            if parts:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts).view(np.int64)), batch.column(1)], ["id", "fp", "text_hash"])
        give_back()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_hash_of(docs, text_col).alias("text_hash"), text_of(text_col).alias("text"))
    return rows.mapInArrow(scan, "id long, fp long, text_hash long")


def _ball(radius: int) -> list[int]:
    """All 64-bit masks of at most ``radius`` bits, as signed numbers."""
    import itertools

    masks = [sum(1 << k for k in bits) for n in range(radius + 1) for bits in itertools.combinations(range(64), n)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(prints: DataFrame, distance: int = 2) -> DataFrame:
    """(u, v): links that connect all fingerprints within ``distance`` of each other.

    ``prints`` has a long column fp of distinct values.  For an odd distance the
    ball's radius is rounded up, and verification drops what is too far.
    """
    masks = F.array(*[F.lit(m).cast("long") for m in _ball((distance + 1) // 2)])
    variants = prints.select("fp", F.explode(masks).alias("mask")).select(F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"), "fp")
    if distance % 2 == 0:
        # All of a bucket are within half the distance of its variant: chaining them loses nothing.
        from pyspark.sql import Window

        before = F.lag("fp").over(Window.partitionBy("variant").orderBy("fp"))
        met = variants.select("fp", before.alias("other")).where("other IS NOT NULL")
    else:
        other = variants.withColumnRenamed("fp", "other")
        met = variants.join(other, "variant").where("other < fp").select("fp", "other")
    return met.select(F.col("fp").alias("u"), F.col("other").alias("v")).where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 2) -> DataFrame:
    """(id, fingerprint, component_id, text_hash) for each row of ``docs``."""
    rows, _ = staged(simhash(docs, id_col, text_col, words), "fingerprints")
    # Copies share a fingerprint: from here on each value counts once.
    prints, _ = staged(rows.groupBy("fp").agg(F.min("id").alias("least")), "prints")
    root = components(links(prints, distance))
    grouped = prints.join(root, prints.fp == root.u, "left").select("fp", "least", F.coalesce("v", "fp").alias("root"))
    grouped, _ = staged(grouped, "grouped")
    smallest = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    final, _ = staged(grouped.join(smallest, "root").select(F.col("fp").alias("of"), "component_id"), "classes")
    return rows.join(final, F.col("fp") == F.col("of")).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_hash"
    )


def wide_simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """(id, fp, text_hash): the wide fingerprint of each row, as an array of signed 64-bit numbers."""
    lanes = TABLES // 2

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [fingerprints(data, offsets, words, lanes) for data, offsets in _text_blocks(batch.column(2))]
            if parts:
                flat = np.concatenate(parts).view(np.int64).ravel()
                fp = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, lanes, dtype=np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0), fp, batch.column(1)], ["id", "fp", "text_hash"])
        give_back()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_hash_of(docs, text_col).alias("text_hash"), text_of(text_col).alias("text"))
    return rows.mapInArrow(scan, "id long, fp array<long>, text_hash long")


def _words_of(fp: Column) -> Column:
    return F.array(*[F.shiftrightunsigned(fp[t // 2], 32 * (t % 2)).bitwiseAND(F.lit(0xFFFFFFFF)) for t in range(TABLES)])


def _apart(a: Column, b: Column) -> Column:
    """Bits in which two wide fingerprints differ."""
    return sum((F.bit_count(a[k].bitwiseXOR(b[k])) for k in range(TABLES // 2)), F.lit(0))


def _near(pairs: DataFrame, prints: DataFrame, distance: int) -> DataFrame:
    """The pairs (u, v, and more) of nodes whose whole fingerprints are within ``distance``."""
    left, right = (prints.select(F.col("node").alias(n), F.col("fp").alias(f)) for n, f in (("u", "a"), ("v", "b")))
    return pairs.join(left, "u").join(right, "v").where(_apart(F.col("a"), F.col("b")) <= distance).select(*pairs.columns)


def _leaders() -> Column:
    """Four nodes of a group, or as many as there are: aggregated, whatever the group's size."""
    mixed = F.xxhash64("node")
    return F.array_distinct(F.array(F.min("node"), F.max("node"), F.min_by("node", mixed), F.max_by("node", mixed)))


def equal_word_links(prints: DataFrame, distance: int = WIDE_DISTANCE) -> DataFrame:
    """(u, v): verified links of nodes to leaders, four of the nodes that have an equal word.

    They connect most of a large group at the cost of a few rows a node.
    """
    tables = prints.select("node", F.posexplode(_words_of(F.col("fp"))).alias("t", "word"))
    led = tables.groupBy("t", "word").agg(_leaders().alias("leaders")).where("size(leaders) > 1")
    met = tables.join(led, ["t", "word"]).select(F.col("node").alias("u"), F.explode("leaders").alias("v")).where("u <> v").distinct()
    return _near(met, prints, distance)


def _near_in_buckets(distance: int):
    """A function of rows (variant, i, j, side, comp, fp) in order of the first three: links (u, v) of components.

    In each run of (variant, i, j) the rows of side 0 or 2 meet those of side 1 or 2.
    """
    lanes = TABLES // 2

    def near(table: pa.Table) -> Iterator[pa.RecordBatch]:
        side, comp = (table.column(c).to_numpy() for c in ("side", "comp"))
        fp = table.column("fp").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, lanes)
        starts = np.flatnonzero(_begins(table))
        run = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(side)]))
        x, y = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        first, last = np.searchsorted(run[y], run[x]), np.searchsorted(run[y], run[x], "right")
        upto = np.cumsum(last - first)
        at = 0
        while at < len(x):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BLOCK_PAIRS, "right")))
            met = (last - first)[at:to]
            left = np.repeat(x[at:to], met)
            right = y[np.arange(len(left)) - np.repeat(np.cumsum(met) - met, met) + np.repeat(first[at:to], met)]
            other = comp[left] != comp[right]
            left, right = left[other], right[other]
            apart = sum((np.bitwise_count(fp[left, k] ^ fp[right, k]).astype(np.int16) for k in range(lanes)), np.zeros(len(left), np.int16))
            links = np.unique(np.stack([comp[left], comp[right]], 1)[apart <= distance], axis=0)
            if len(links):
                yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["u", "v"])
            at = to

    def _begins(table: pa.Table) -> np.ndarray:
        keys = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("variant", "i", "j")], 1)
        return np.r_[True, (keys[1:] != keys[:-1]).any(1)] if len(keys) else np.zeros(0, bool)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # rows from the last run on, which may go on in the next batch
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            starts = np.flatnonzero(_begins(held))
            if len(starts) > 1:
                yield from near(held.slice(0, starts[-1]))
                held = held.slice(starts[-1]).combine_chunks()
        if held is not None and held.num_rows:
            yield from near(held)
        give_back()

    return scan


def colliding_links(prints: DataFrame, distance: int = WIDE_DISTANCE, block: int = BUCKET_ROWS) -> DataFrame:
    """(u, v): links of components, of all whose nodes collide and are near.

    ``prints`` has node, fp and comp.  A bucket holds the words within a bit of its
    variant.  Whatever a bucket holds of one component needs no comparison, however
    much it is, so only buckets of several components go on.  There the nodes
    outside the bucket's largest component are compared with all its nodes, inside
    the tasks: fingerprints are dealt to buckets, a row for each node and bucket, and
    no pair is ever a row.  A bucket of more than ``block`` rows is dealt in blocks,
    and each pair of its blocks is compared by itself.
    """
    from pyspark.sql import Window

    masks = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(m).cast("long").alias("bits")) for k, m in enumerate([0, *(1 << k for k in range(32))])])
    tables = prints.select("node", "comp", F.posexplode(_words_of(F.col("fp"))).alias("t", "word"))
    variants = tables.select("node", "comp", "t", "word", F.explode(masks).alias("mask")).select(
        F.shiftleft(F.col("t").cast("long"), 32).bitwiseOR(F.col("word").bitwiseXOR(F.col("mask.bits"))).alias("variant"),
        F.shiftleft("node", 6).bitwiseOR(F.col("mask.k")).alias("tag"),  # a node, and which of its variants this is
        "comp",
    )
    bucket = Window.partitionBy("variant")
    mixed = variants.withColumns({"low": F.min("comp").over(bucket), "high": F.max("comp").over(bucket)}).where("low < high").drop("low", "high")
    mixed, _ = staged(mixed, "mixed")
    # Equal words share 33 buckets and others two.  One is enough: that of the words themselves, or
    # else that in which the higher of the bits that differ is cleared.  Rows without such a partner go.
    rows = mixed.withColumn("k", F.col("tag").bitwiseAND(F.lit(63)).cast("int"))
    rows = rows.withColumn("cleared", (F.col("k") > 0) & (F.expr("shiftright(variant, greatest(k - 1, 0)) & 1") == 0))
    rows = rows.withColumns({"top": F.max(F.when(F.col("cleared"), F.col("k"))).over(bucket), "least": F.min("k").over(bucket), "same": F.count_if(F.col("k") == 0).over(bucket)})
    rows = rows.where("k < top OR (cleared AND k > least) OR (k = 0 AND same > 1)").select("variant", "tag", "comp")
    rows = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("variant", "comp")))
    rows = rows.withColumns({"main": F.max(F.struct("n", "comp")).over(bucket)["comp"], "blocks": F.ceil(F.count(F.lit(1)).over(bucket) / block).cast("int")})
    few = F.col("comp") != F.col("main")
    rows = rows.withColumns({"few": few, "mixed": F.bool_or(few).over(bucket)}).where("mixed")
    # a node's fingerprint joins all that it has in one row of each table
    held = rows.groupBy(F.shiftright("tag", 6).alias("node"), F.shiftright("variant", 32).alias("t")).agg(F.collect_list(F.struct("variant", "few", "blocks")).alias("held"))
    print_of = held.join(prints.select("node", "comp", "fp"), "node")

    def dealt(e: Column) -> Column:
        """Pairs of blocks (i, j) that a row goes to: to meet all others, to be met, or both."""
        mine = F.pmod(F.xxhash64("node"), e["blocks"]).cast("int")
        every = F.sequence(F.lit(0), e["blocks"] - 1)
        place = lambda i, j, side: F.struct(e["variant"].alias("variant"), i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
        meets = F.when(e["few"], F.transform(every, lambda k: place(mine, k, 0))).otherwise(F.array().cast("array<struct<variant:bigint,i:int,j:int,side:int>>"))
        is_met = F.transform(every, lambda k: place(k, mine, 1))
        return F.when(e["blocks"] == 1, F.array(F.struct(e["variant"].alias("variant"), mine.alias("i"), mine.alias("j"), F.when(e["few"], 2).otherwise(1).alias("side")))).otherwise(F.concat(meets, is_met))

    # rows of hot buckets are many to a node, so they are dealt anew before they become rows
    print_of = print_of.repartition(F.xxhash64("node", "t"))
    met = print_of.select("comp", "fp", F.explode(F.flatten(F.transform("held", dealt))).alias("p")).select("p.*", "comp", "fp")
    met = met.repartition("variant", "i", "j").sortWithinPartitions("variant", "i", "j")
    return met.mapInArrow(_near_in_buckets(distance), "u long, v long").distinct()


def wide_components(prints: DataFrame, distance: int = WIDE_DISTANCE) -> DataFrame:
    """``prints`` (node, fp, and more) with ``comp``, a node of the component: all links of colliding nodes count."""

    def marked(nodes: DataFrame, comp: str, links: DataFrame) -> DataFrame:
        root = components(links).withColumnsRenamed({"u": "_u", "v": "_v"})
        return nodes.join(root, nodes[comp] == root["_u"], "left").select(*prints.columns, F.coalesce("_v", comp).alias("comp"))

    early, _ = staged(marked(prints, "node", equal_word_links(prints, distance)), "early")
    return marked(early, "comp", colliding_links(early, distance))


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, distance: int = WIDE_DISTANCE) -> DataFrame:
    """(id, component, component_id, text_hash) for each row: classes of alike texts.

    ``component`` numbers the class, ``component_id`` is its smallest identifier.
    """
    rows, _ = staged(wide_simhash(docs, id_col, text_col, words), "fingerprints")
    prints = rows.groupBy("fp").agg(F.min("id").alias("least"))
    # dense numbers shuffle small
    prints, _ = staged(numbered(prints, ["fp"], "node")[0], "prints")
    grouped, _ = staged(wide_components(prints, distance).select("fp", "least", F.col("comp").alias("root")), "grouped")
    smallest = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    final, _ = staged(grouped.join(smallest, "root").select(F.col("fp").alias("of"), F.col("root").alias("component"), "component_id"), "classes")
    return rows.join(final, F.col("fp") == F.col("of")).select(F.col("id").alias(id_col), "component", "component_id", "text_hash")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, distance: int = WIDE_DISTANCE) -> DataFrame:
    """One row, with all its columns, of each class of ``similar``: that of the smallest identifier."""
    verdicts, _ = staged(similar(docs, id_col, text_col, words, distance).withColumnRenamed(id_col, "id"), "verdicts")
    kept = F.col("id").eqNullSafe(F.col("component_id"))
    return keep_rows(docs, verdicts.select("id", "text_hash", F.col("component").cast("string").alias("group"), kept.alias("kept")), id_col, text_col)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")
