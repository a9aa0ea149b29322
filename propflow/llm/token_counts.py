"""Token counts from an exact histogram of encoded lengths.

Documents are aggregated by encoded length; suffix sums over the lengths answer,
for every context limit, how many documents reach it, how many tokens they hold
and how many tokens a corpus truncated to it keeps.  Quantiles come from the
running count; ``limits`` and ``quantiles`` give such answers as rows.  Suffix sums are taken in two levels, blocks of lengths and
lengths within a block, so that no task gets all lengths.

Cases: a null text counts as empty, of length 0.  Null identifiers and repeated
rows count once each; a very long text is one length.  Quantiles are lengths that
occur: the least that the asked share of documents does not exceed.  Other columns
are not read, whatever their names.  An empty table gives an empty histogram, no
quantile (null) and totals of zero.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from propflow.llm.byte_bpe import encoder as encoder_of
from propflow.llm.shared import staged, table, text_of

#: Lengths of a block of the suffix sums.
BLOCK = 512
#: Context limits and shares that the query answers for.
LIMITS = [256, 512, 1000, 2048, 4096, 8192, 32_768, 131_072]
SHARES = [0.0, 0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 0.999, 1.0]


def encoded_lengths(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """(n_tokens) for each row."""
    with open(tokenizer, encoding="utf-8") as f:
        file = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(file.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                lengths = [len(ids) for ids in encoder.encode(batch.column(0).slice(a, 256).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(np.array(lengths, np.int64))], ["n_tokens"])

    return docs.select(text_of(text_col).alias("text")).mapInArrow(run, "n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """One row for each length that occurs.

    docs, tokens: of this length.  docs_up_to: documents of this length or less,
    the rank that quantiles are read from.  docs_from, tokens_from: of this
    length or more.  truncated_total: tokens left if every document is cut to
    this length.  For a limit L that does not occur, with the next length M that
    does, the truncated total is M's less (M - L) * docs_from of M.
    """
    counts = lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("docs")).select("n_tokens", "docs", F.expr(f"n_tokens div {BLOCK}").alias("block"), (F.col("docs") * F.col("n_tokens")).alias("tokens"))
    # used twice below, and much smaller than what it is made from
    counts, _ = staged(counts, "lengths")
    sums = counts.groupBy("block").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    # one row for each block of lengths: the longest text bounds them
    none = F.lit(0).cast("long")
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(
        "block",
        F.coalesce(F.sum("d").over(after), none).alias("docs_after"),
        F.coalesce(F.sum("t").over(after), none).alias("tokens_after"),
        F.coalesce(F.sum("d").over(before), none).alias("docs_before"),
        F.coalesce(F.sum("t").over(before), none).alias("tokens_before"),
    )
    up = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    inside = counts.withColumns(
        {
            "docs_up": F.sum("docs").over(up),
            "tokens_up": F.sum("tokens").over(up),
            "docs_down": F.sum("docs").over(down),
            "tokens_down": F.sum("tokens").over(down),
        }
    )
    return (
        inside.join(bases, "block")
        .withColumn("docs_from", F.expr("docs_down + docs_after"))
        .select(
            "n_tokens",
            "docs",
            "tokens",
            F.expr("docs_up + docs_before").alias("docs_up_to"),
            "docs_from",
            F.expr("tokens_down + tokens_after").alias("tokens_from"),
            F.expr("tokens_before + tokens_up - tokens + n_tokens * docs_from").alias("truncated_total"),
        )
    )


def limits(histogram: DataFrame, lengths: list[int]) -> DataFrame:
    """(limit, docs_from, tokens_from, truncated_total) for any context limits, from the suffix sums.

    docs_from, tokens_from: documents of the limit's length or more and their
    tokens; truncated_total: tokens left if every document is cut to the limit.
    """
    total = F.coalesce(F.sum("tokens"), F.lit(0)).alias("total")
    # the sums of the next length that occurs hold for the limit, but for the tokens between the two
    at = [F.min(F.when(F.col("n_tokens") >= n, F.struct("n_tokens", "docs_from", "tokens_from", "truncated_total"))).alias(f"at{i}") for i, n in enumerate(lengths)]
    found = histogram.agg(total, *at)
    none = F.lit(0).cast("long")

    def answer(i: int, n: int):
        x = F.col(f"at{i}")
        cut = x["truncated_total"] - (x["n_tokens"] - n) * x["docs_from"]
        return F.struct(F.lit(n).cast("long").alias("limit"), F.coalesce(x["docs_from"], none).alias("docs_from"), F.coalesce(x["tokens_from"], none).alias("tokens_from"), F.coalesce(cut, F.col("total")).alias("truncated_total"))

    return found.select(F.explode(F.array(*[answer(i, n) for i, n in enumerate(lengths)])).alias("x")).select("x.*")


def quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the least length that so large a share of documents does not exceed."""
    docs = histogram.agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0]
    ranks = [max(1, math.ceil(Fraction(str(share)) * docs)) for share in shares]
    found = histogram.agg(*[F.min(F.when(F.col("docs_up_to") >= rank, F.col("n_tokens"))).alias(f"q{i}") for i, rank in enumerate(ranks)])
    rows = [F.struct(F.lit(float(share)).alias("share"), F.col(f"q{i}").alias("n_tokens")) for i, share in enumerate(shares)]
    return found.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of kind ``length``, ``limit`` and ``quantile``; n_tokens is the length, the limit, or the quantile of ``share``."""
    import public_tokenizers

    lengths = encoded_lengths(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    histogram, _ = staged(length_histogram(lengths), "histogram")
    kind = lambda name: F.lit(name).alias("kind")
    rows = histogram.select(kind("length"), "*")
    rows = rows.unionByName(limits(histogram, LIMITS).withColumnRenamed("limit", "n_tokens").select(kind("limit"), "*"), allowMissingColumns=True)
    return rows.unionByName(quantiles(histogram, SHARES).select(kind("quantile"), "*"), allowMissingColumns=True)
