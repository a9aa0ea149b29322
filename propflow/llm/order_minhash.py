"""Document fingerprints by Order MinHash, in DataFrame functions only.

A text's k-mers are its runs of five words, each with the number of times it has
occurred before in the text.  Hashes of numbered k-mers fall into 32 bins; of
each bin the two smallest are selected, put back into text order, and their
tuple is hashed.  A tuple agrees only where both k-mers are shared and stand in
the same order, so the share of bins that agree falls with edit distance, not
only with the set of words.  One hash of each k-mer serves all bins.

The next document (by falling identifier) is found without a global sort in one
task: identifiers are cut into ranges at quantiles, each range gets a copy of
the first row of the range after it, and rows take their follower within it.

Cases: a null text counts as empty.  A text of fewer words than a k-mer has one
k-mer, all its words; one without words has the empty fingerprint, which is
alike (1.0) to another empty one and to no other.  Null identifiers come last.
Rows alike in identifier are ordered by a hash of their texts.  A table of one
row is its own next document.  Equal hashes of a bin are taken in text order.  A
very long text is worked on whole, in one task; positions have 30 bits, more than
a string of 2 ** 31 bytes has words.  Other columns are not read, whatever their
names.  An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from propflow.llm.shared import partitions, table, text_of

WORDS = 5
#: Bins are the top BIN_BITS of a hash.
BIN_BITS, PLACE_BITS = 5, 30
TUPLE = 2
_VALUE = 63 - PLACE_BITS
_BIN = 63 - BIN_BITS


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _packed(h: Column, place: Column) -> Column:
    """Bin, hash and place of a k-mer in one number, which sorts by them."""
    return F.shiftleft(F.shiftrightunsigned(h, 64 - _VALUE), PLACE_BITS).bitwiseOR(place.cast("long"))


def _numbered(hashes: Column) -> Column:
    """Packed k-mers where some occur more than once: by sorted runs of equal hashes."""

    def runs(s: Column) -> Column:
        n = F.size(s)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda j: (j == 0) | (F.get(s, j)["h"] != F.get(s, j - 1)["h"]))

        def spread(starts: Column) -> Column:
            spans = F.transform(starts, lambda a, q: F.struct(a.alias("a"), F.coalesce(F.get(starts, q + 1), n).alias("b")))
            return F.flatten(
                F.transform(
                    spans,
                    lambda r: F.transform(
                        F.sequence(r["a"], r["b"] - 1),
                        lambda j: _packed(F.when(j == r["a"], F.get(s, j)["h"]).otherwise(F.xxhash64(F.get(s, j)["h"], j - r["a"])), F.get(s, j)["i"]),
                    ),
                )
            )

        return _let(starts, spread)

    return _let(F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), runs)


def _tuples(ordered: Column) -> Column:
    """Bin and hashed tuple of each bin in use, from packed k-mers in order."""

    def of_bin(x: Column) -> Column:
        return F.shiftrightunsigned(x, _BIN)

    def value(x: Column) -> Column:
        return F.shiftrightunsigned(x, PLACE_BITS)

    def place(x: Column) -> Column:
        return x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1))

    def pair(chosen: Column) -> Column:
        def tuple_at(x: Column, j: Column) -> Column:
            y = F.get(chosen, j + 1)
            both = F.when(
                y.isNull() | (of_bin(y) != of_bin(x)), F.xxhash64(value(x))
            ).otherwise(F.when(place(x) <= place(y), F.xxhash64(value(x), value(y))).otherwise(F.xxhash64(value(y), value(x))))
            first = (j == 0) | (of_bin(F.get(chosen, j - 1)) != of_bin(x))
            return F.when(first, F.shiftleft(of_bin(x), 32).bitwiseOR(F.shiftrightunsigned(both, 32)))

        return F.filter(F.transform(chosen, tuple_at), lambda t: t.isNotNull())

    return _let(F.filter(ordered, lambda x, j: (j < TUPLE) | (of_bin(F.get(ordered, j - TUPLE)) != of_bin(x))), pair)


def sketch(text: Column) -> Column:
    """The fingerprint of a text as array<long>: bins in use in order, with their tuples' hashes."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def hashes(w: Column) -> Column:
        last = F.greatest(F.size(w) - WORDS, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WORDS)]))

    def packed(h: Column) -> Column:
        plain = F.transform(h, lambda x, i: _packed(x, i))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), plain).otherwise(_numbered(h))

    whole = _let(words, lambda w: F.when(F.size(w) > 0, _let(hashes(w), lambda h: _let(F.sort_array(packed(h)), _tuples))))
    return F.coalesce(whole, F.array().cast("array<long>"))


def as_text(tuples: Column) -> Column:
    return F.array_join(F.transform(tuples, lambda t: F.lpad(F.lower(F.hex(t)), 10, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of the bins in use in either that agree; 1 if neither has any."""
    either = F.size(F.array_union(F.transform(a, lambda t: F.shiftrightunsigned(t, 32)), F.transform(b, lambda t: F.shiftrightunsigned(t, 32))))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def _ranges(rows: DataFrame, count: int) -> Column:
    """The number of the range of ``id``, rising with it, for about ``count`` even ranges; null is -1."""
    side = math.ceil(math.sqrt(count))
    shares = [i / (side * side) for i in range(1, side * side)]
    found = rows.select(F.percentile_approx("id", shares, 10_000 * side)).first()[0] if shares else None
    bounds = sorted(set(found or []))
    if not bounds:
        return F.when(F.col("id").isNull(), F.lit(-1)).otherwise(F.lit(0))
    # two short searches instead of a long one
    rows_of = [bounds[i : i + side] for i in range(0, len(bounds), side)]
    tops = F.array(*[F.lit(b[-1]) for b in rows_of])
    lists = F.array(*[F.array(*[F.lit(x) for x in b]) for b in rows_of])
    coarse = F.size(F.filter(tops, lambda b: b < F.col("id")))
    fine = F.size(F.filter(F.coalesce(F.get(lists, coarse), F.array().cast("array<long>")), lambda b: b < F.col("id")))
    return F.when(F.col("id").isNull(), F.lit(-1)).otherwise(coarse * side + fine)


def with_next(rows: DataFrame) -> DataFrame:
    """Rows (id, text, more columns) with ``next``, a struct of the row that follows by falling id."""
    count = 4 * partitions(rows.sparkSession)
    placed = rows.withColumn("range", _ranges(rows, count)).withColumn("tie", F.xxhash64("text"))
    order = F.struct(F.col("id").isNull().alias("none"), F.bitwise_not(F.col("id")).alias("down"), "tie")
    # one row for each range: the number of ranges bounds what is collected and broadcast
    firsts = {r["range"]: r["first"] for r in placed.groupBy("range").agg(F.min(order).alias("first")).collect()}
    falling = sorted(firsts, reverse=True)
    if not falling:
        return rows.withColumn("next", F.lit(None).cast(rows.schema))
    links = [(follower, here, firsts[follower]["down"], firsts[follower]["tie"]) for here, follower in zip(falling, falling[1:] + falling[:1])]
    links_df = rows.sparkSession.createDataFrame(links, "_range int, _before int, _down long, _tie long")
    on = (F.col("range") == F.col("_range")) & F.bitwise_not(F.col("id")).eqNullSafe(F.col("_down")) & (F.col("tie") == F.col("_tie"))
    copies = placed.join(F.broadcast(links_df), on).withColumn("range", F.col("_before")).drop("_range", "_before", "_down", "_tie")
    both = placed.withColumn("copied", F.lit(False)).unionByName(copies.withColumn("copied", F.lit(True)))
    falling_rows = Window.partitionBy("range").orderBy("copied", F.col("id").isNull(), F.desc("id"), "tie")
    return both.withColumn("next", F.lead(F.struct(*rows.columns)).over(falling_rows)).where(~F.col("copied")).select(*rows.columns, "next")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of texts, of texts with their last third replaced, and likenesses."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    # fingerprinted before the shuffle, so that a text is not fingerprinted again as another's next
    rows = with_next(rows.withColumn("a", sketch(F.col("text"))))
    rows = rows.select("id", "text", "a", F.col("next.text").alias("after"), F.col("next.a").alias("c"), F.length("text").alias("n"))
    rows = rows.withColumn("cut", F.expr("n div 3"))
    rows = rows.withColumn("edited", F.expr("concat(left(text, cast(n - cut as int)), left(after, cast(cut as int)))"))
    rows = rows.select("id", "n", "edited", "a", sketch(F.col("edited")).alias("b"), "c")
    return rows.select(
        F.col("id").alias(id_col),
        F.col("n").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("a")).alias("fingerprint"),
        as_text(F.col("b")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"),
        likeness(F.col("a"), F.col("c")).alias("near_next"),
    )


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))
