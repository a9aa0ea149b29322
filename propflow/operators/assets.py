"""Assets: files by content, their sources, near duplicates and contact sheets."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def provenance(kind: Column, path: Column, member: Column | None = None, url: Column | None = None, preferred: Column | None = None) -> Column:
    """Where a copy of an asset came from, as one struct."""
    none = F.lit(None).cast("string")
    return F.struct(
        kind.alias("kind"),
        path.alias("relative_path"),
        (none if member is None else member).alias("archive_member"),
        (none if url is None else url).alias("listing_url"),
        (F.lit(False) if preferred is None else preferred).alias("preferred"),
    )


def exact_assets(candidates: DataFrame, key: str = "sha256", position: str = "position") -> DataFrame:
    """One row an asset: its first candidate, all distinct sources in order, and the copies beyond the first.

    ``candidates`` has the key, a position, a struct ``source`` and ``preferred``;
    a column ``dhash``, where there is one, must not differ within an asset.
    """
    checks = {"dhashes": F.count_distinct("dhash")} if "dhash" in candidates.columns else {}
    rest = [c for c in candidates.columns if c not in (key, "source", "preferred")]
    sources = F.array_sort(F.collect_set("source"))
    out = candidates.groupBy(key).agg(
        F.min_by(F.struct(*rest), F.col(position)).alias("first"),
        sources.alias("sources"),
        F.bool_or(F.coalesce("preferred", F.lit(False))).alias("preferred"),
        *[v.alias(k) for k, v in checks.items()],
    )
    if checks:
        out = out.withColumn("conflict", F.col("dhashes") > 1).drop("dhashes")
    return out.withColumn("exact_duplicate_count", F.greatest(F.size("sources") - 1, F.lit(0)))


def upsert(existing: DataFrame, batch: DataFrame, key: str = "sha256") -> DataFrame:
    """Assets after a batch: known ones get its sources, new ones are added.

    Both have key, ``sources`` (array of struct) and ``preferred``; a known
    asset's other columns stay as they are.
    """
    new = batch.join(existing.select(key), key, "left_anti")
    more = batch.select(key, F.col("sources").alias("_sources"), F.col("preferred").alias("_preferred"))
    kept = existing.join(more, key, "left").withColumns(
        {
            "sources": F.array_sort(F.array_distinct(F.concat("sources", F.coalesce("_sources", F.array().cast(existing.schema["sources"].dataType))))),
            "preferred": F.col("preferred") | F.coalesce("_preferred", F.lit(False)),
        }
    )
    both = kept.drop("_sources", "_preferred").unionByName(new, allowMissingColumns=True)
    return both.withColumn("exact_duplicate_count", F.greatest(F.size("sources") - 1, F.lit(0)))


def append_unique(items: Column) -> Column:
    """Distinct items in the order of their canonical JSON text."""
    return F.transform(F.array_sort(F.transform(F.array_distinct(items), lambda x: F.struct(F.to_json(F.struct(x.alias("x"))).alias("t"), x.alias("x")))), lambda s: s["x"])


def replace_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key it does not have."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


#: Most values that one hash is sent under.
MOST_PROBES = 4096
#: What a value sent costs against a meeting verified.
PROBE_COST = 4
#: And what a pair of a block of hashes costs, whose bits are counted by the array.
PAIR_COST = 0.01
#: Hashes of a block, and fewest and most blocks.
BLOCK_HASHES, FEWEST_BLOCKS, MOST_BLOCKS = 20_000, 8, 64
#: Pairs whose bits are counted at a time.
BLOCK_PAIRS = 1 << 18


def _bands(bits: int, distance: int, count: int) -> list[tuple[int, int, int]]:
    """(start, width, radius) of each band, from the first bit on; bands that need no meeting are left out.

    Hashes within ``distance`` = count * r + s differ in r bits or fewer in one of
    the first s + 1 bands, or in fewer than r in one of the others.
    """
    r, s = divmod(distance, count)
    edges = [bits * k // count for k in range(count + 1)]
    found = [(edges[k], edges[k + 1] - edges[k], r if k <= s else r - 1) for k in range(count)]
    return [b for b in found if b[2] >= 0]


def _ball(width: int, radius: int) -> int:
    return sum(math.comb(width, k) for k in range(min(width, radius) + 1))


def band_plan(hashes: int, bits: int, distance: int) -> list[tuple[int, int, int]]:
    """The bands that so many hashes are best met by: values sent weighed against chance meetings.

    None if all pairs are compared for less than that.
    """

    def cost(bands: list[tuple[int, int, int]]) -> float:
        sent = sum(_ball(w, r) for _, w, r in bands)
        met = sum(_ball(w, r) / 2.0**w for _, w, r in bands)
        return hashes * sent * PROBE_COST + hashes * hashes / 2 * met

    fewest = -(-bits // 30)
    plans = [_bands(bits, distance, n) for n in range(fewest, max(fewest, min(bits, distance + 1)) + 1)]
    best = min([p for p in plans if sum(_ball(w, r) for _, w, r in p) <= MOST_PROBES] or plans[-1:], key=cost)
    return best if cost(best) < hashes * hashes / 2 * PAIR_COST else []


def _numbers(h: Column, bits: int) -> list[Column]:
    """The bits of a hex hash as signed numbers of 64, the last one from the end."""
    digits = math.ceil(bits / 4)
    whole = F.lpad(h, -(-digits // 16) * 16, "0")
    return [F.conv(F.substring(whole, at + 1, 16), 16, -10).cast("long") for at in range(0, -(-digits // 16) * 16, 16)]


def _band_of(numbers: list[Column], bits: int, start: int, width: int) -> Column:
    """The bits of a band, 30 at most, as a number; a band may lie over two numbers."""
    first = len(numbers) * 64 - bits + start
    last = first + width - 1
    low = F.shiftrightunsigned(numbers[last // 64], 63 - last % 64)
    if first // 64 < last // 64:
        low = low.bitwiseOR(F.shiftleft(numbers[first // 64], last % 64 + 1))
    return low.bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _near_within(distance: int):
    """A function of a pair of blocks (i, j, side, h, n): the near pairs between them, or within a block paired with itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(batches)
        side = held.column("side").to_numpy()
        h = held.column("h").combine_chunks()
        n = np.array(held.column("n").combine_chunks().flatten()).view(np.uint64).reshape(len(side), -1)
        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        alone = held.column("i")[0] == held.column("j")[0]
        two = one if alone else two
        columns = [np.ascontiguousarray(n[two, k]) for k in range(n.shape[1])]
        step = max(1, BLOCK_PAIRS // max(1, len(two)))
        for at in range(0, len(one), step):
            rows = one[at : at + step]
            apart = sum(np.bitwise_count(n[rows, k][:, None] ^ c[None, :]).astype(np.int16) for k, c in enumerate(columns))
            x, y = np.nonzero(apart <= distance)
            if alone:
                x, y = x[x + at < y], y[x + at < y]
            if len(x):
                yield pa.RecordBatch.from_arrays([h.take(pa.array(rows[x])), h.take(pa.array(two[y])), pa.array(apart[x, y].astype(np.int32))], ["x", "y", "distance"])

    return run


def _near_in_blocks(distinct: DataFrame, count: int, distance: int) -> DataFrame:
    """(a, b, distance) by comparing all pairs: hashes are dealt into blocks, and each pair of blocks is a task's."""
    blocks = min(MOST_BLOCKS, max(FEWEST_BLOCKS, -(-count // BLOCK_HASHES)))
    of = F.pmod(F.xxhash64("h"), F.lit(blocks)).cast("int")
    pair = lambda k: F.struct(F.least(k, of).alias("i"), F.greatest(k, of).alias("j"), (k < of).cast("int").alias("side"))
    dealt = distinct.select("h", "n", F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), pair)).alias("p")).select("p.*", "h", "n")
    # a partition for each pair of blocks, which are few bytes and much work, so that none are put together
    dealt = dealt.repartition(blocks * (blocks + 1) // 2, "i", "j")
    met = dealt.groupBy("i", "j").applyInArrow(_near_within(distance), "x string, y string, distance int")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance")


def near_hashes(hashes: DataFrame, bits: int, distance: int, dhash: str = "dhash") -> DataFrame:
    """(a, b, distance): pairs of distinct hex hashes, a before b, that differ in at most ``distance`` bits.

    Multi-index hashing: every band of a hash is sent as it is, and with all
    values within the band's radius; the two meet in an equi-join on band and
    value, and are then compared.  A pair counts in the first band in which it
    is within the radius.  Where bands tell too little apart, for a distance that
    is large for the bits, all pairs are compared, in blocks.
    """
    if distance >= bits:
        raise ValueError("a distance of all bits leaves no band to meet in")
    distinct = hashes.select(F.col(dhash).alias("h")).where("h IS NOT NULL").distinct()
    distinct = distinct.select("h", F.array(*_numbers(F.col("h"), bits)).alias("n"))
    parts = range(-(-math.ceil(bits / 4) // 16))
    count = distinct.count()
    bands = band_plan(count, bits, distance)
    if not bands:
        return _near_in_blocks(distinct, count, distance)
    own = F.array(*[_band_of([F.col("n")[i] for i in parts], bits, start, width) for start, width, _ in bands])
    # hashes are few bytes and much work: each set of them is a task's (dealt by the hash itself, the planner would drop the step)
    tasks = int(hashes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = distinct.repartition(max(tasks, -(-count // BLOCK_HASHES)), F.xxhash64("h"))
    sent = spread.select("h", "n", F.posexplode(own).alias("band", "value"))
    # bits of a band that a value may differ in: all masks of its ball
    masks = [(k, sum(1 << i for i in places)) for k, (_, width, radius) in enumerate(bands) for n in range(radius + 1) for places in itertools.combinations(range(width), n)]
    balls = hashes.sparkSession.createDataFrame(masks, "band int, mask long")
    # as many rows as MOST_PROBES at most
    probes = sent.join(F.broadcast(balls), "band").select("band", F.col("value").bitwiseXOR(F.col("mask")).alias("value"), F.col("h").alias("a"), F.col("n").alias("x"))
    index = sent.select("band", "value", F.col("h").alias("b"), F.col("n").alias("y"))
    differing = [F.col("x")[i].bitwiseXOR(F.col("y")[i]) for i in parts]
    apart = sum((F.bit_count(d) for d in differing), F.lit(0))
    within = [F.bit_count(_band_of(differing, bits, start, width)) <= radius for start, width, radius in bands]
    first = F.coalesce(*[F.when(w, F.lit(k)) for k, w in enumerate(within)])
    met = probes.join(index, ["band", "value"]).where("a < b").where(apart <= distance)
    return met.where(F.col("band") == first).select("a", "b", apart.alias("distance"))


def near_classes(assets: DataFrame, bits: int, distance: int, key: str = "asset_id", dhash: str = "dhash") -> tuple[DataFrame, DataFrame]:
    """Near duplicates as classes: a class is all assets of one hash, and its smallest asset stands for it.

    Gives (key, class_id, copies, n_links) for each asset that has a hash, with
    the number of other assets within ``distance`` of it, and (left_class,
    right_class, distance, left_copies, right_copies) for each pair of classes
    within ``distance``.  Pairs of assets are those of two linked classes and
    those within a class; none is written out, so a million equal images are one
    row here, and a million rows of members.
    """
    sized = assets.where(F.col(dhash).isNotNull()).groupBy(F.col(dhash).alias("h")).agg(F.min(key).alias("class_id"), F.count(F.lit(1)).alias("copies"))
    close = near_hashes(assets, bits, distance, dhash)
    one, two = (sized.select(F.col("h").alias(h), F.col("class_id").alias(f"{side}_class"), F.col("copies").alias(f"{side}_copies")) for h, side in (("a", "x"), ("b", "y")))
    met = close.join(one, "a").join(two, "b")
    swapped = F.col("x_class") > F.col("y_class")
    side = lambda name, x, y: F.when(swapped, F.col(f"{x}_{name}")).otherwise(F.col(f"{y}_{name}"))
    links = met.select(side("class", "y", "x").alias("left_class"), side("class", "x", "y").alias("right_class"), "distance", side("copies", "y", "x").alias("left_copies"), side("copies", "x", "y").alias("right_copies"))
    ends = met.select(F.col("a").alias("h"), F.col("y_copies").alias("others")).unionByName(met.select(F.col("b").alias("h"), F.col("x_copies").alias("others")))
    linked = ends.groupBy("h").agg(F.sum("others").alias("others"))
    classes = sized.join(linked, "h", "left").select("h", "class_id", "copies", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    members = assets.select(key, F.col(dhash).alias("h")).join(classes, "h").select(key, "class_id", "copies", "n_links")
    return members, links


def near_pairs(assets: DataFrame, bits: int, distance: int, key: str = "asset_id", dhash: str = "dhash") -> DataFrame:
    """Pairs of assets whose hashes differ in at most ``distance`` bits.

    Hashes are compared once each, however many assets share one (flat images
    all do).  Assets of one hash are pairs, too; where they are very many, take
    ``near_classes``, which writes none of them out.
    """
    close = near_hashes(assets, bits, distance, dhash)
    one = assets.select(F.col(key).alias("x"), F.col(dhash).alias("a"))
    two = assets.select(F.col(key).alias("y"), F.col(dhash).alias("b"))
    unlike = close.join(one, "a").join(two, "b").select("x", "y", "distance")
    alike = one.join(two, F.col("a") == F.col("b")).where("x < y").select("x", "y", F.lit(0).alias("distance"))
    pairs = unlike.unionByName(alike)
    return pairs.select(F.least("x", "y").alias(f"left_{key}"), F.greatest("x", "y").alias(f"right_{key}"), "distance", F.lit("candidate_for_manual_review").alias("status"))


def grid(count: Column, columns: Column | None = None) -> tuple[Column, Column]:
    """Columns and rows of a sheet of ``count`` cells."""
    wide = F.ceil(F.sqrt(count)).cast("int") if columns is None else F.least(columns, count).cast("int")
    wide = F.greatest(F.lit(1), wide)
    return wide, F.ceil(count / wide).cast("int")


def contact_sheet(images: DataFrame, sheet: str, order: list[str], cell: tuple[int, int] = (320, 240), columns: int | None = None) -> DataFrame:
    """Cells of each sheet: index, row, column, x, y, in order; ``too_large`` where the sheet would pass the limits."""
    whole = Window.partitionBy(sheet)
    out = images.withColumns({"index": F.row_number().over(whole.orderBy(*order)) - 1, "n": F.count(F.lit(1)).over(whole)})
    wide, high = grid(F.col("n"), None if columns is None else F.lit(columns))
    out = out.withColumns({"columns": wide, "rows": high})
    large = (F.col("columns") * cell[0] > 16_384) | (F.col("rows") * cell[1] > 16_384) | (F.col("columns") * F.col("rows") * cell[0] * cell[1] > 100_000_000)
    return out.withColumns(
        {
            "row": F.expr("index div columns").cast("int"),
            "column": (F.col("index") % F.col("columns")).cast("int"),
            "too_large": large,
        }
    ).withColumns({"x": F.col("column") * cell[0], "y": F.col("row") * cell[1]})


def sheet_fingerprint(assets: DataFrame, sheet: str, key: str = "asset_id", cell: tuple[int, int] = (320, 240)) -> DataFrame:
    """One digest a sheet over its sorted asset ids and cell size."""
    ids = F.array_join(F.array_sort(F.collect_list(F.col(key).cast("string"))), "\n")
    return assets.groupBy(sheet).agg(F.sha2(F.concat(ids, F.lit(f"\n{cell[0]}x{cell[1]}")), 256).alias("fingerprint"))


def fitted_size(width: Column, height: Column, box: tuple[int, int] = (320, 240)) -> tuple[Column, Column]:
    """Size of an image scaled to fit a box, as a thumbnail is."""
    scale = F.least(box[0] / width, box[1] / height)
    return F.greatest(F.lit(1), F.round(width * scale).cast("int")), F.greatest(F.lit(1), F.round(height * scale).cast("int"))


def xstack_layout(count: int, cell: tuple[int, int] = (320, 240)) -> str:
    """The layout string of a sheet's filter."""
    wide = max(1, math.ceil(math.sqrt(count)))
    return "|".join(f"{i % wide * cell[0]}_{i // wide * cell[1]}" for i in range(count))
