"""Connected components of a link table, by alternating large-star and small-star.

Every round writes its links to the shared folder, so lost executors cost a
reread.  No round gathers the neighbours of a node in one task: minima are
aggregated map-side, and joined back to the links by a join that the adaptive
planner can split where a node has very many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propflow.llm.shared import discard, staged

#: Links that a task contracts at a time before the first round.
CONTRACT_ROWS = 200_000


def _contracted(links: DataFrame) -> DataFrame:
    """The same components from fewer links: each block of a task as stars."""

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= CONTRACT_ROWS:
                yield block(held)
                held, rows = [], 0
        if rows:
            yield block(held)

    def block(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b = (np.concatenate([x.column(k).to_numpy() for x in batches]) for k in (0, 1))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        a, b = at[: len(a)], at[len(a) :]
        low = np.arange(len(nodes))
        while True:  # labels fall to the smallest index, jumping over pointers
            before = low.copy()
            least = np.minimum(low[a], low[b])
            np.minimum.at(low, low[a], least)
            np.minimum.at(low, low[b], least)
            low = low[low]
            if (low == before).all():
                break
        child = np.flatnonzero(low != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[child]), pa.array(nodes[low[child]])], ["u", "v"])

    return links.mapInArrow(stars, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """(u, v): each node but the smallest of its component, with the smallest.

    ``links`` has long columns u and v; a node without links does not appear.
    Repeated links, loops and either direction are allowed.
    """
    spark = links.sparkSession
    pairs = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    state, path = staged(_contracted(pairs).distinct(), "links")
    mark = None
    while True:
        found = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if found == mark or not found[0]:
            return state
        mark = found
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # minima as tables of their own: the joins can then be split where a node has very many links
        least, first = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "minima")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large, second = staged(large, "large")
        least, third = staged(large.groupBy("u").agg(F.min("v").alias("m")), "minima")
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x"))
            .select("x.u", "x.v")
            .where("u <> v")
            .distinct()
        )
        old = path
        state, path = staged(small, "links")
        discard(spark, old, first, second, third)
