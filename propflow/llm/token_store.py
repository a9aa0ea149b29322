"""Content-addressed store of token ids.

Layout of a store (a folder that Spark writes and reads):

``parts/``    kind 0: digest, data: every distinct chunk of ids once, little-endian
``recipes/``  nth, doc_id, start, n_tokens, digests, root: one row a document, in
              ascending doc_id order over the files and within each
``manifest/`` level, node, docs, n_tokens, root: the nodes of a Merkle tree over the
              recipes, up to its root; and one row with the width of an id

A rolling hash over the last ids cuts a document's ids into chunks where its low
bits are zero, so equal passages of ids give equal chunks wherever they stand.
A chunk's digest is the SHA-256 of its data; a recipe's root is the Merkle root
of its digests.  A leaf of the tree covers a recipe's place, identifier, start,
length and root; a node covers at most FAN leaves or nodes, and the top one all.

Reading back verifies all of these.  Checksums of documents come from checksums of
chunks, which combine without the data: reading back shuffles some bytes for each
chunk a document uses, not its ids.

Cases: a null text counts as empty and consists of the end id.  Null identifiers
come first in the order; rows alike in identifier stand one after the other, and
may be any number: a salt deals them to several tasks.  A very long text is one
recipe of many chunks.  An empty table gives an empty store.  Other columns are
not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from propflow.llm.byte_bpe import ByteEncoder
from propflow.llm.byte_bpe import encoder as encoder_of
from propflow.llm.shared import discard, partitions, shared_root, staged, table, text_of

END_ID = 0
#: Ids that the rolling hash sees; a cut where so many low bits are zero; bounds of a chunk.
WINDOW, CUT_BITS, LEAST, MOST = 8, 9, 64, 4096
#: Digests a task remembers, so as to send a chunk once.
SEEN = 200_000
#: Children of a node of the manifest.
FAN = 1024

_FACTORS = np.random.default_rng(20240229).integers(1, 1 << 62, WINDOW, dtype=np.uint64) | np.uint64(1)


def places(ids: np.ndarray) -> np.ndarray:
    """Ends that the rolling hash proposes.

    The hash sees WINDOW ids and no cut is nearer than LEAST to the last, so that
    documents one after the other in an array do not touch each other's cuts.
    """
    x = ids.astype(np.uint64) + np.uint64(1)
    x = (x * np.uint64(0x9E3779B97F4A7C15)) ^ (x << np.uint64(17))
    h = np.zeros(len(ids), np.uint64)
    for j in range(min(WINDOW, len(ids))):
        h[j:] += x[: len(ids) - j] * _FACTORS[j]
    return np.flatnonzero((h >> np.uint64(64 - CUT_BITS)) == 0) + 1


def cuts(n: int, proposed: list[int]) -> list[int]:
    """Ends of the chunks of a document of n ids from the proposed ones."""
    out, last = [], 0
    for p in proposed:
        while p - last > MOST:
            last += MOST
            out.append(last)
        if p - last >= LEAST:
            out.append(last := p)
    while n - last > MOST:
        last += MOST
        out.append(last)
    if last < n:
        out.append(n)
    return out


def merkle(digests: list[bytes]) -> bytes:
    """Merkle root; an odd node at the end of a level moves up as it is."""
    level = digests
    while len(level) > 1:
        pairs = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() for i in range(0, len(level) - 1, 2)]
        level = pairs + level[len(pairs) * 2 :]
    return level[0]


_PARTS = "kind int, deal long, digest binary, doc_id long, n_tokens long, digests binary, data binary"
_ARROW_PARTS = pa.schema(
    [("kind", pa.int32()), ("deal", pa.int64()), ("digest", pa.binary()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("digests", pa.binary()), ("data", pa.binary())]
)


def _cut_up(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Chunks (kind 0) and recipes (kind 1) of all documents; ``deal`` spreads rows that are alike."""
    with open(tokenizer, encoding="utf-8") as f:
        file = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(file.value)
        end = np.array([end_id], encoder.dtype)
        sha256, width = hashlib.sha256, encoder.dtype.itemsize
        salt = TaskContext.get().partitionId() << 36
        seen: set[bytes] = set()
        chunks: list[tuple] = []
        recipes: list[tuple] = []
        held = 0

        def out():
            digests, data = zip(*chunks) if chunks else ((), ())
            ids, ns, lists, salts = zip(*recipes) if recipes else ((), (), (), ())
            c, r = len(digests), len(ids)
            lead = np.frombuffer(b"".join(digests), ">i8")[::4].astype(np.int64)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.array([0, 1], np.int32), [c, r])),
                    pa.array(np.r_[lead, np.array(salts, np.int64)]),
                    pa.array([*digests, *[None] * r], pa.binary()),
                    pa.array([*[None] * c, *ids], pa.int64()),
                    pa.array([*[None] * c, *ns], pa.int64()),
                    pa.array([*[None] * c, *lists], pa.binary()),
                    pa.array([*data, *[None] * r], pa.binary()),
                ],
                schema=_ARROW_PARTS,
            )

        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                each = list(encoder.encode(part.column(1).to_pylist()))
                stops = np.cumsum([len(ids) + 1 for ids in each]).tolist()
                stream = np.concatenate([x for ids in each for x in (ids, end)])
                raw = stream.tobytes()
                found = places(stream)
                bounds = np.searchsorted(found, [0, *stops], "right").tolist()
                start = 0
                for k, (doc_id, stop) in enumerate(zip(part.column(0).to_pylist(), stops)):
                    n = stop - start
                    digests, last = [], start
                    for at in cuts(n, (found[bounds[k] : bounds[k + 1]] - start).tolist()) if n > LEAST else (n,):
                        data = raw[last * width : (start + at) * width]
                        last = start + at
                        digest = sha256(data).digest()
                        digests.append(digest)
                        if digest not in seen:
                            if len(seen) >= SEEN:
                                seen.clear()
                            seen.add(digest)
                            chunks.append((digest, data))
                            held += len(data)
                    recipes.append((doc_id, n, b"".join(digests), salt))
                    salt += 1
                    held += 32 * len(digests)
                    start = stop
                if held > 4 << 20:
                    yield out()
                    chunks, recipes, held = [], [], 0
        if recipes:
            yield out()

    return docs.mapInArrow(run, _PARTS)


_RECIPES = "part int, inner long, before long, doc_id long, n_tokens long, digests binary, root binary"


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Recipes in order, with the ids and recipes before them in their part, and their roots."""
    part, base, rows = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        n = batch.column("n_tokens").to_numpy()
        inner = base + np.cumsum(n) - n
        base = int(inner[-1] + n[-1]) if len(n) else base
        roots = [merkle([d[i : i + 32] for i in range(0, len(d), 32)]) for d in batch.column("digests").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(n), part, np.int32)), pa.array(inner), pa.array(np.arange(rows, rows + len(n))), batch.column("doc_id"), batch.column("n_tokens"), batch.column("digests"), pa.array(roots, pa.binary())],
            ["part", "inner", "before", "doc_id", "n_tokens", "digests", "root"],
        )
        rows += len(n)


def _tree(recipes: DataFrame) -> DataFrame:
    """(level, node, docs, n_tokens, root): a Merkle tree over recipes by their place; no task holds more than FAN children of a node."""
    leaf = F.sha2(F.concat_ws("|", F.lit("0"), "nth", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "start", "n_tokens", F.hex("root")).cast("binary"), 256)
    below = recipes.select(F.col("nth").alias("child"), F.lit(1).cast("long").alias("docs"), "n_tokens", leaf.alias("root"))
    out, level = None, 0
    while out is None or out.count() > 1:
        level += 1
        out, _ = staged(
            below.groupBy(F.expr(f"child div {FAN}").alias("node"))
            .agg(F.sum("docs").alias("docs"), F.sum("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("child", "root"))).alias("children"))
            .select(F.lit(level).alias("level"), "node", "docs", "n_tokens", F.sha2(F.concat(F.lit("1|"), F.array_join(F.col("children.root"), "|")).cast("binary"), 256).alias("root")),
            "manifest",
        )
        levels = out if level == 1 else levels.unionByName(out)
        below = out.select(F.col("node").alias("child"), "docs", "n_tokens", "root")
    return levels


def write_store(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> None:
    """Encode all texts, each closed by ``end_id``, into the store at ``path``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    n = partitions(spark)
    # A task sends each of its chunks once, so that a chunk of a third of all documents is no hot key.
    dealt = _cut_up(rows, tokenizer, end_id).repartition(n, "deal")
    once = F.row_number().over(Window.partitionBy("kind", "deal", "digest").orderBy("n_tokens"))
    dealt.withColumn("once", once).where("once = 1").drop("once", "deal").write.partitionBy("kind").option("compression", "lz4").parquet(f"{path}/parts")
    parts = spark.read.schema("kind int, digest binary, doc_id long, n_tokens long, digests binary, data binary").parquet(f"{path}/parts")
    # rows alike in identifier and text are told apart by a number, so that no task has to take them all
    recipes, kept = staged(parts.where("kind = 1").select("doc_id", "n_tokens", "digests", F.monotonically_increasing_id().alias("tie")), "unordered")
    ranged, numbered = staged(recipes.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").mapInArrow(_numbered, _RECIPES), "recipes")
    # one row for each part: as many as partitions were asked for
    totals = sorted(map(tuple, ranged.groupBy("part").agg(F.sum("n_tokens"), F.count(F.lit(1))).collect()))
    bases, at, rows_before = [], 0, 0
    for part, total, count in totals:
        bases.append((part, at, rows_before))
        at += total
        rows_before += count
    base = spark.createDataFrame(bases, "part int, base long, rows_before long")
    place = [(F.col("rows_before") + F.col("before")).alias("nth"), "doc_id", (F.col("base") + F.col("inner")).alias("start")]
    # ranged again, since a scan packs files by size: the files then ascend in name order, and the rows within each
    ordered = ranged.join(F.broadcast(base), "part").select(*place, "n_tokens", "digests", "root")
    ordered.repartitionByRange(n, "nth").sortWithinPartitions("nth").write.parquet(f"{path}/recipes")
    width = ByteEncoder(open(tokenizer, encoding="utf-8").read()).dtype.itemsize
    about = spark.createDataFrame([(0, width, 0, 0, "bytes of an id")], "level int, node long, docs long, n_tokens long, root string")
    _tree(spark.read.parquet(f"{path}/recipes")).unionByName(about).write.parquet(f"{path}/manifest")
    discard(spark, kept, numbered)


def _width(manifest: DataFrame) -> int:
    found = [r.node for r in manifest.where("level = 0").limit(2).collect()]
    if len(found) != 1 or found[0] not in (2, 4):
        raise ValueError("the manifest does not tell the width of an id")
    return found[0]


def chunks_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("kind int, digest binary, data binary").parquet(f"{path}/parts").where("kind = 0").select("digest", "data")


#: The polynomial of CRC-32 with its bits reversed, a fixed value.
_POLY = np.uint32(0xEDB88320)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of reversed polynomials modulo the CRC's."""
    out = np.zeros_like(a)
    b = b.copy()
    for k in range(31, -1, -1):
        out ^= np.where((a >> np.uint32(k)) & np.uint32(1), b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), _POLY, np.uint32(0))
    return out


def _powers(lengths: np.ndarray) -> np.ndarray:
    """x ** (8 * length) for each length in bytes."""
    power = np.full(len(lengths), 0x80000000, np.uint32)  # 1
    step = np.full(1, 0x00800000, np.uint32)  # x ** 8
    left = lengths.astype(np.int64).copy()
    while left.any():
        odd = np.flatnonzero(left & 1)
        power[odd] = _times(power[odd], np.broadcast_to(step, len(odd)))
        step = _times(step, step)
        left >>= 1
    return power


def crc_joined(crcs: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """CRC-32 of joined strings: runs of ``counts`` parts each, from the parts' CRCs and lengths in bytes.

    A part's CRC counts times x to the power of the bits after it, so all parts are shifted at once.
    """
    ends = np.cumsum(counts)
    total = np.cumsum(lengths.astype(np.int64))
    after = np.repeat(total[ends - 1], counts) - total
    shifted = _times(crcs.astype(np.uint32), _powers(after))
    return np.bitwise_xor.reduceat(shifted, ends - counts)


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of a store, verified.

    Checksums are over ids of 32 bits.  A digest, root or length that does not
    agree with the data stops the job.
    """
    manifest = spark.read.parquet(f"{path}/manifest")
    width = _width(manifest)
    dtype = np.dtype(f"<u{width}")

    def leaf(batches):
        for batch in batches:
            out = []
            for digest, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if hashlib.sha256(data).digest() != digest:
                    raise ValueError("a chunk's data does not have its digest")
                out.append((digest, len(data) // width, zlib.crc32(np.frombuffer(data, dtype).astype("<u4").tobytes())))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.int64(), pa.int64()))], ["digest", "n", "crc"])

    leaves, _ = staged(chunks_of(spark, path).mapInArrow(leaf, "digest binary, n long, crc long"), "leaves")
    recipes = spark.read.parquet(f"{path}/recipes")
    # the tree has a node for every FAN recipes; a store without recipes has none
    seen, known = _tree(recipes), manifest.where("level > 0")
    alike = seen.join(known.withColumnsRenamed({"root": "_root", "docs": "_docs", "n_tokens": "_n"}), ["level", "node"], "full").where("NOT (root <=> _root AND docs <=> _docs AND n_tokens <=> _n)")
    if alike.limit(1).count():
        raise ValueError("the manifest does not agree with the recipes")
    count = F.expr("length(digests) div 32")
    uses = recipes.select(
        "doc_id", "start", "n_tokens", "root", F.posexplode(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(F.col("digests"), i * 32 + 1, F.lit(32)))).alias("nth", "digest")
    )
    met = (
        uses.join(leaves, "digest", "left")
        .groupBy("start")
        .agg(F.min("doc_id").alias("doc_id"), F.min("n_tokens").alias("n_tokens"), F.min("root").alias("root"), F.array_sort(F.collect_list(F.struct("nth", "digest", "n", "crc"))).alias("leaves"))
        .select("doc_id", "start", "n_tokens", "root", F.transform("leaves", lambda x: x["digest"]).alias("digests"), F.transform("leaves", lambda x: x["n"]).alias("n"), F.transform("leaves", lambda x: x["crc"]).alias("crc"))
    )

    def joined(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ns, crcs = batch.column("n").to_pylist(), batch.column("crc").to_pylist()
            for root, digests, n, total in zip(batch.column("root").to_pylist(), batch.column("digests").to_pylist(), ns, batch.column("n_tokens").to_pylist()):
                if None in n or sum(n) != total or merkle(digests) != root:
                    raise ValueError("a recipe does not agree with its chunks")
            counts = np.array([len(n) for n in ns])
            crc = crc_joined(np.concatenate(crcs), 4 * np.concatenate(ns).astype(np.int64), counts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc.astype(np.int64))], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return met.mapInArrow(joined, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids array<int>): the documents themselves, from their chunks."""
    width = _width(spark.read.parquet(f"{path}/manifest"))
    recipes = spark.read.parquet(f"{path}/recipes")
    count = F.expr("length(digests) div 32")
    uses = recipes.select("doc_id", "start", F.posexplode(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(F.col("digests"), i * 32 + 1, F.lit(32)))).alias("nth", "digest"))
    met = uses.join(chunks_of(spark, path), "digest").groupBy("doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("nth", "data"))).alias("parts"))

    def opened(batches):
        for batch in batches:
            ids = [np.frombuffer(b"".join(x["data"] for x in parts), f"<u{width}").astype(np.int32) for parts in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "start", "ids"])

    return met.mapInArrow(opened, "doc_id long, start long, ids array<int>")


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_root(spark)}/token-store-{uuid.uuid4().hex}"
    write_store(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_checksums(spark, path)
