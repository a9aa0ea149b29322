"""Target-distribution importance resampling over partition-local word tries.

Documents are drawn so that their words look like a target's.  A feature is a run
of words, and its bucket a CRC-32 of its bytes.  Each task keeps the distinct
features it meets in a trie: a node holds how often its feature came and the CRC
state of the path to it, so the checksum of a shared prefix is taken once, and a
feature's bucket is the state of its node.  Tasks send totals of buckets, at most
``buckets`` rows each time, and Spark adds them up.  Gains of buckets (a bounded
number) go back to the tasks, which attach them to trie nodes and score
documents by the paths of their words.  Gumbel noise from a hash of the
identifier makes the highest scores a draw without replacement.

Cases: a null text has no words; a text without words has weight 0 and is never
drawn where ``least_words`` is above 0.  A null identifier hashes as the empty
text and comes last among ties; rows alike in score and identifier are ordered by
weight and size, and past that are interchangeable; each row counts and may be
drawn.  A very long text is read in parts cut between words.  An empty table (or
target) gives counts of zero, gains of smoothing alone, and an empty result where
there are no documents.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propflow.llm.shared import give_back, numbered, staged, table, text_of

#: Capitals A-Z to small letters, and all ASCII that is neither digit nor letter to a blank.
_CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of text whose features are looked at together; nodes at which a task sends its totals and begins a new trie.
BLOCK_BYTES, MOST_NODES = 4 << 20, 250_000


class WordTrie:
    """A radix trie over byte strings; nodes hold counts, CRC states and gains.

    An edge is a string of bytes.  Node 0 is the empty string.
    """

    def __init__(self) -> None:
        self.labels: list[bytes] = [b""]
        self.children: list[dict[int, int] | None] = [None]
        self.crcs: list[int] = [0]
        self.counts: list[int] = [0]
        self.gains: list[int | None] = [None]

    def __len__(self) -> int:
        return len(self.labels)

    def _node(self, label: bytes, crc: int, children: dict[int, int] | None = None) -> int:
        for column, value in ((self.labels, label), (self.children, children), (self.crcs, crc), (self.counts, 0), (self.gains, None)):
            column.append(value)
        return len(self.labels) - 1

    def node(self, feature: bytes) -> int:
        """The node of a feature, made if need be.  A new node's CRC goes on from that of its parent."""
        at, done, labels, children, crcs = 0, 0, self.labels, self.children, self.crcs
        while done < len(feature):
            below = children[at]
            if below is None:
                below = children[at] = {}
            child = below.get(feature[done])
            if child is None:
                rest = feature[done:]
                child = below[feature[done]] = self._node(rest, zlib.crc32(rest, crcs[at]))
                return child
            label = labels[child]
            if feature.startswith(label, done):
                at, done = child, done + len(label)
                continue
            same, most = 1, min(len(label), len(feature) - done)
            while same < most and label[same] == feature[done + same]:
                same += 1
            fork = below[feature[done]] = self._node(label[:same], zlib.crc32(label[:same], crcs[at]), {label[same]: child})
            labels[child] = label[same:]
            at, done = fork, done + same
        return at

    def add(self, feature: bytes, n: int) -> None:
        self.counts[self.node(feature)] += n

    def totals(self, buckets: int) -> np.ndarray:
        """Sums of counts by bucket."""
        out = np.zeros(buckets, np.int64)
        np.add.at(out, np.array(self.crcs, np.int64) % buckets, np.array(self.counts, np.int64))
        return out

    def gain(self, feature: bytes, gains: list[int]) -> int:
        """The gain attached to a feature's node; attached when the path is first walked."""
        node = self.node(feature)
        found = self.gains[node]
        if found is None:
            found = self.gains[node] = gains[self.crcs[node] % len(gains)]
        return found


def words_of(text: bytes, most: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    """Words of a text, some at a time where it is longer than ``most`` bytes."""
    at = 0
    while at < len(text):
        part = text[at : at + most].translate(_CLEAN)
        stop = at + most
        if stop < len(text):
            cut = part.rfind(b" ")
            while cut < 0:  # a word longer than a part
                more = text[stop : stop + most].translate(_CLEAN)
                gap = more.find(b" ")
                part, stop = part + (more if gap < 0 else more[: gap + 1]), stop + (len(more) if gap < 0 else gap + 1)
                cut = len(part) - 1 if gap >= 0 or stop >= len(text) else -1
            part, stop = part[: cut + 1], min(stop, at + cut + 1)
        yield part.split()
        at = stop


def features_of(words: list[bytes], longest: int, before: list[bytes]) -> list[bytes]:
    """Runs of up to ``longest`` words that end in ``words``; ``before`` are the words before them."""
    out = list(words)
    for size in range(2, longest + 1):
        lead = before[len(before) - min(size - 1, len(before)) :] if before else []
        line = lead + words
        out += map(b" ".join, zip(*(line[k:] for k in range(size))))
    return out


def _documents(batches: Iterator[pa.RecordBatch], column: int, longest: int) -> Iterator[tuple[pa.RecordBatch, int, int, list[bytes]]]:
    """(batch, row, words, features) over all rows; a long text gives several."""
    for batch in batches:
        texts = batch.column(column).cast(pa.binary())
        for row in range(batch.num_rows):
            before: list[bytes] = []
            given = False
            for words in words_of(texts[row].as_py()):
                yield batch, row, len(words), features_of(words, longest, before) if longest > 1 else words
                before, given = ((before + words)[-(longest - 1) :] if longest > 1 else []), True
            if not given:
                yield batch, row, 0, []


def bucket_totals(docs: DataFrame, text_col: str = "text", longest: int = 1, buckets: int = 10_000) -> DataFrame:
    """(bucket, n): how many features of all texts fall in each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, held, size = WordTrie(), Counter(), 0

        def sent() -> pa.RecordBatch:
            totals = trie.totals(buckets)
            met = np.flatnonzero(totals)
            return pa.RecordBatch.from_arrays([pa.array(met), pa.array(totals[met])], ["bucket", "n"])

        for _, _, _, features in _documents(batches, 0, longest):
            held.update(features)
            size += sum(map(len, features))
            if size > BLOCK_BYTES:
                for feature, n in held.items():
                    trie.add(feature, n)
                held, size = Counter(), 0
                if len(trie) > MOST_NODES:
                    yield sent()
                    trie = WordTrie()
        for feature, n in held.items():
            trie.add(feature, n)
        yield sent()
        del trie, held
        give_back()

    return docs.select(text_of(text_col).alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", longest: int = 1, buckets: int = 10_000, scale: int = 1000) -> list[int]:
    """The gain of each bucket: ``scale`` times the log ratio of smoothed shares, floored."""
    both = bucket_totals(target, text_col, longest, buckets).select("bucket", F.col("n").alias("t"), F.lit(0).cast("long").alias("s"))
    both = both.unionByName(bucket_totals(docs, text_col, longest, buckets).select("bucket", F.lit(0).cast("long").alias("t"), F.col("n").alias("s")))
    met = both.groupBy("bucket").agg(F.sum("t").alias("t"), F.sum("s").alias("s"))
    # as many rows as buckets at most, whatever the corpus
    found = met.collect()
    t, s = np.zeros(buckets), np.zeros(buckets)
    for row in found:
        t[row.bucket], s[row.bucket] = row.t, row.s
    all_t, all_s = float(sum(r.t for r in found)), float(sum(r.s for r in found))
    return np.floor(scale * np.log((t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets)))).astype(np.int64).tolist()


def weights(docs: DataFrame, gain: list[int], id_col: str = "doc_id", text_col: str = "text", longest: int = 1) -> DataFrame:
    """(id, n_words, n_features, weight) for each row: the floored mean of its features' gains."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, trie = sent.value, WordTrie()
        now, sums = None, None
        block: list[tuple[int, list[bytes]]] = []
        size = 0

        def settle() -> None:
            nonlocal trie, size
            if len(trie) > MOST_NODES:
                trie = WordTrie()
            of = {feature: trie.gain(feature, table) for feature in set().union(*(f for _, f in block))}
            for row, features in block:
                sums[row] += sum(map(of.__getitem__, features))
            block.clear()
            size = 0

        def made(batch: pa.RecordBatch) -> pa.RecordBatch:
            weight = [total // n if n else 0 for total, n in zip(sums, counts)]
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n_words, counts, weight))], ["id", "n_words", "n_features", "weight"])

        for batch, row, n, features in _documents(batches, 1, longest):
            if batch is not now:
                if now is not None:
                    settle()
                    yield made(now)
                now, sums, counts, n_words = batch, [0] * batch.num_rows, [0] * batch.num_rows, [0] * batch.num_rows
            counts[row] += len(features)
            n_words[row] += n
            block.append((row, features))
            size += sum(map(len, features))
            if size > BLOCK_BYTES:
                settle()
        if now is not None:
            settle()
            yield made(now)
        del trie, block
        give_back()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(score, "id long, n_words long, n_features long, weight long")


def resampled(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 10,
    least_words: int = 20,
    seed: int = 2024,
    id_col: str = "doc_id",
    text_col: str = "text",
    longest: int = 1,
    buckets: int = 10_000,
) -> DataFrame:
    """(id, n_features, weight, score, rank) for each row of ``docs``; rank is null for rows that are not drawn.

    Of the rows with at least ``least_words`` words, ``percent`` in a hundred are drawn, rounded down.
    """
    spark = docs.sparkSession
    rows = weights(docs, gains(docs, target, text_col, longest, buckets), id_col, text_col, longest)
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored, _ = staged(rows.withColumn("score", F.col("weight") + noise), "scored")
    fit = F.col("n_words") >= least_words
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("weight").desc(), F.col("n_features").desc()]
    able, n = numbered(scored.where(fit), order, "nth")
    drawn = percent * n // 100
    out = able.select("id", "n_features", "weight", "score", F.when(F.col("nth") < drawn, F.col("nth") + 1).alias("rank"))
    rest = scored.where(~fit).select("id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return out.unionByName(rest).withColumnRenamed("id", id_col)


#: DuckDB's SQL.  CRC-32 is folded over the bytes of each distinct word, by a table of 256 states.
SQL = r"""
WITH states AS (
    SELECT list(c ORDER BY b) AS states FROM (
        SELECT b, list_reduce(list_concat([b], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) t(b)
    )
),
texts AS (
    SELECT 0 AS kind, doc_id, coalesce(text, '') AS text FROM documents UNION ALL SELECT 1, NULL, coalesce(text, '') FROM benchmark
),
words AS (
    SELECT kind, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM texts
),
every AS (SELECT kind, doc_id, unnest(words) AS word FROM words),
bytes AS (
    SELECT word, list_transform(range(length(hex(encode(word))) // 2), lambda k: (instr('0123456789ABCDEF', hex(encode(word))[2 * k + 1]) - 1) * 16 + instr('0123456789ABCDEF', hex(encode(word))[2 * k + 2]) - 1) AS bytes
    FROM (SELECT DISTINCT word FROM every)
),
buckets AS (
    SELECT word, xor(list_reduce(list_concat([4294967295], bytes), lambda c, b: xor(states[1 + (xor(c, b) & 255)], c >> 8)), 4294967295) % 10000 AS bucket FROM bytes, states
),
counted AS (SELECT bucket, count(*) FILTER (kind = 0) AS s, count(*) FILTER (kind = 1) AS t FROM every JOIN buckets USING (word) GROUP BY bucket),
totals AS (SELECT sum(s) AS all_s, sum(t) AS all_t FROM counted),
gain AS (
    SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * (all_s + 10000)::DOUBLE / ((s + 1)::DOUBLE * (all_t + 10000)::DOUBLE))) AS BIGINT) AS gain FROM counted, totals
),
means AS (
    SELECT doc_id, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM every JOIN buckets USING (word) JOIN gain USING (bucket) WHERE kind = 0 GROUP BY doc_id
),
scored AS (
    SELECT doc_id, len(words) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT + 0.5)::DOUBLE / 4294967296.0::DOUBLE))) AS BIGINT) AS score
    FROM words LEFT JOIN means USING (doc_id) WHERE kind = 0
),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of ``documents``, drawn towards ``benchmark``."""
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
