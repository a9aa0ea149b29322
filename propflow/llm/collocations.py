"""Phrase collocation mining over position bitmaps.

Texts are lower-cased, split into pieces and words, and gathered into shards: the
words of some documents of one language, one after the other, with a gap after
each piece.  In a shard every word has a bitmap of the positions where it stands.
Shifting a phrase's bitmap by one and ANDing it with a word's gives the bitmap of
the phrase with that word after it, and its popcount how often that comes; a gap
has no word, so no phrase leaves its piece.  Popcounts are summed over shards.

A bitmap is held compressed, as the sorted positions of its ones.  A position has
one word, so bitmaps of different words are disjoint, and looking up the words
at the shifted positions ANDs with the bitmaps of all words at once; runs of equal
words are the popcounts.  Phrases are extended depth-first: all that begin with a
range of words, to their full length, before the next range, so a task holds the
bitmaps of one range at a time.

What is rare in the whole corpus can't be part of a frequent phrase.  Three rounds
use that: popcounts of words, of pairs of frequent words, and of longer phrases all
of whose pairs are frequent.  In each round a shard sends its popcounts packed, one
piece for each part of the keys (as many as shuffle partitions); a part adds up what
all shards sent it, and tells each shard which of its own words or pairs are frequent.
Nothing is broadcast or collected, and a key, however frequent, comes once a shard.

Cases: a null text has no words, a null language is ``und``.  Repeated rows and
null identifiers count like any other row.  A very long text is cut into shards
at the end of a piece; a piece or word however long stays whole.  Ties are
settled by bytes of the phrase.  An empty table gives an empty result.  Other
columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from propflow.llm.shared import discard, give_back, partitions, staged, table, text_of

#: Capitals A-Z to small letters; marks and line ends that close a piece to a full stop.
_CLEAN = bytes(b + 32 if 65 <= b <= 90 else 46 if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))
#: Blanks between words are these two; other white space that bytes.split() knows closes a piece.
_GAP = b"."
#: Words of a shard (one more piece may follow), bytes of text cleaned at a time, and positions of a range of words.
SHARD_WORDS, PART_BYTES, RANGE_ONES = 1 << 18, 1 << 20, 1 << 18
#: Parts that a language's candidates are ranked in before they meet.
RANK_PARTS = 64


def _narrow(numbers: np.ndarray, most: int) -> bytes:
    """Numbers up to ``most`` in two bytes each where they fit, in four where not."""
    return numbers.astype("<u2" if most < 1 << 16 else "<i4").tobytes()


def _wide(data: bytes, most: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if most < 1 << 16 else "<i4").astype(np.int32)


class _Shard:
    """Words of one language being gathered: numbers of words in order, 0 after each piece."""

    def __init__(self) -> None:
        self.number: defaultdict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.number[_GAP]  # the gap is number 0
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, words: list[bytes]) -> None:
        self.parts.append(np.fromiter(map(self.number.__getitem__, words), np.int32, len(words)))
        self.size += len(words)


def _pieces(text: bytes, most: int = PART_BYTES) -> Iterator[list[bytes]]:
    """Words of a text, and a gap after each piece; some pieces at a time."""
    at = 0
    while at < len(text):
        part = text[at : at + most].translate(_CLEAN)
        stop = at + most
        while stop < len(text) and _GAP not in part:
            part, stop = part + text[stop : stop + most].translate(_CLEAN), stop + most
        if stop < len(text):
            stop = at + part.rindex(_GAP) + 1
            part = part[: stop - at]
        yield (part + _GAP).replace(_GAP, b" . ").split()
        at = stop


def shards(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = SHARD_WORDS) -> DataFrame:
    """(shard, lang, words, ids, most, n): distinct words of a shard by their numbers from 1 to ``most``, the numbers at its positions, and how many have one."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, _Shard] = {}

        def closed(lang: str) -> pa.RecordBatch:
            done = open_.pop(lang)
            words = list(done.number)[1:]
            line = np.concatenate(done.parts)
            return pa.RecordBatch.from_arrays(
                [pa.array([lang]), pa.array([b" ".join(words)], pa.binary()), pa.array([_narrow(line, len(words))], pa.binary()), pa.array([len(words)]), pa.array([int(np.count_nonzero(line))])],
                ["lang", "words", "ids", "most", "n"],
            )

        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for lang, text in zip(batch.column(0).to_pylist(), texts):
                for words in _pieces(text.as_py()):
                    shard = open_.setdefault(lang, _Shard())
                    shard.add(words)
                    if shard.size > most:
                        yield closed(lang)
        for lang in list(open_):
            yield closed(lang)
        give_back()

    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text_of(text_col).alias("text"))
    made = rows.mapInArrow(gather, "lang string, words binary, ids binary, most long, n long")
    return made.withColumn("shard", F.monotonically_increasing_id())


def _packed(keys: np.ndarray) -> bytes:
    """Ascending numbers as differences, their bytes by place: what is alike stands together, and shuffles small."""
    return np.diff(keys, prepend=keys.dtype.type(0)).view(np.uint8).reshape(len(keys), -1).T.tobytes()


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.cumsum(np.frombuffer(data, np.uint8).reshape(width, -1).T.copy().view(kind).ravel(), dtype=kind)


def _dealt(part: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Parts and their rows, of rows sorted by part."""
    first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
    for a, b in zip(first, [*first[1:], len(part)]):
        yield int(part[a]), slice(a, b)


def _part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def _as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


_WORDS = pa.schema([("part", pa.int64()), ("shard", pa.int64()), ("lang", pa.string()), ("words", pa.binary()), ("at", pa.binary()), ("n", pa.binary())])
_KEYS = pa.schema([("part", pa.int64()), ("shard", pa.int64()), ("size", pa.int64()), ("keys", pa.binary()), ("n", pa.binary())])
#: What a part gives: kind 0 tells a shard which of its keys are frequent, and their ids; kind 1 is a frequent word or key.
_FOUND = pa.schema([("kind", pa.int64()), ("shard", pa.int64()), ("keys", pa.binary()), ("ids", pa.binary()), ("lang", pa.string()), ("word", pa.string()), ("id", pa.int64()), ("size", pa.int64()), ("left", pa.int64()), ("right", pa.int64()), ("f", pa.int64())])
_DDL = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"`{f.name}` {_DDL[f.type]}" for f in schema)


def _ids(part: int, count: int, parts: int) -> np.ndarray:
    """Numbers of a part's own; they are below 2 ** 31, so that two fit one key."""
    if count and part + parts * (count - 1) >= 1 << 31:
        raise ValueError("more than 2 ** 31 frequent words or pairs")
    return part + parts * np.arange(count, dtype=np.int64)


def _word_counts(shards: DataFrame, parts: int) -> DataFrame:
    """Popcounts of words, packed by shard and part; ``at`` has the words' numbers in their shard."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, lang, joined, ids in zip(*(c.to_pylist() for c in batch.columns)):
                words = joined.split(b" ") if joined else []
                n = np.bincount(_wide(ids, len(words)), minlength=len(words) + 1)[1:]
                part = np.fromiter((zlib.crc32(w) % parts for w in words), np.int64, len(words))
                order = np.argsort(part, kind="stable")
                rows = [(p, shard, lang, b" ".join([words[k] for k in order[x]]), _packed(order[x] + 1), n[order[x]].tobytes()) for p, x in _dealt(part[order])]
                yield _as_batch(rows, _WORDS)
        give_back()

    return shards.select("shard", "lang", "words", "ids").mapInArrow(count, _ddl(_WORDS))


def _frequent_words(counts: DataFrame, least: int, parts: int) -> DataFrame:
    def add(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        totals: dict[str, dict[bytes, int]] = {}
        for row in range(table.num_rows):
            of = totals.setdefault(table["lang"][row].as_py(), {})
            for word, n in zip(table["words"][row].as_py().split(b" "), np.frombuffer(table["n"][row].as_py(), np.int64).tolist()):
                of[word] = of.get(word, 0) + n
        often = sorted((lang, word) for lang, of in totals.items() for word, n in of.items() if n >= least)
        number = dict(zip(often, _ids(part, len(often), parts).tolist()))
        rows = []
        for row in range(table.num_rows):
            lang = table["lang"][row].as_py()
            ids = [number.get((lang, w)) for w in table["words"][row].as_py().split(b" ")]
            at = _unpacked(table["at"][row].as_py(), "<i8")
            there = [k for k, x in enumerate(ids) if x is not None]
            if there:
                rows.append((0, table["shard"][row].as_py(), at[there].tobytes(), np.array([ids[k] for k in there], np.int64).tobytes(), *[None] * 7))
        rows += [(1, None, None, None, lang, word.decode(), k, 1, None, None, totals[lang][word]) for (lang, word), k in number.items()]
        return pa.Table.from_batches([_as_batch(rows, _FOUND)])

    return counts.groupBy("part").applyInArrow(add, _ddl(_FOUND))


def _frequent_keys(counts: DataFrame, least: int, parts: int, tell: bool) -> DataFrame:
    def add(table: pa.Table) -> pa.Table:
        part, rows = table["part"][0].as_py(), []
        sizes = table["size"].to_numpy()
        for size in np.unique(sizes).tolist():
            of = np.flatnonzero(sizes == size)
            keys = [_unpacked(table["keys"][int(k)].as_py(), "<i8") for k in of]
            every, n = np.concatenate(keys), np.concatenate([np.frombuffer(table["n"][int(k)].as_py(), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel() for k in of])
            order = np.argsort(every, kind="stable")
            every = every[order]
            first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
            total = np.add.reduceat(n[order].astype(np.int64), first)
            often, total = every[first][total >= least], total[total >= least]
            ids = _ids(part, len(often), parts) if tell else [None] * len(often)
            if tell and len(often):
                for k, mine in zip(of, keys):
                    at = np.minimum(np.searchsorted(often, mine), len(often) - 1)
                    there = often[at] == mine
                    if there.any():
                        rows.append((0, table["shard"][int(k)].as_py(), mine[there].tobytes(), ids[at[there]].tobytes(), *[None] * 7))
            rows += [(1, *[None] * 5, None if i is None else int(i), size, key >> 32, key & 0xFFFFFFFF, f) for i, key, f in zip(ids, often.tolist(), total.tolist())]
        return pa.Table.from_batches([_as_batch(rows, _FOUND)])

    return counts.groupBy("part").applyInArrow(add, _ddl(_FOUND))


def _told(found: DataFrame) -> DataFrame:
    """(shard, told): what a shard was told, a piece for each part at most."""
    return found.where("kind = 0").groupBy("shard").agg(F.collect_list(F.struct("keys", "ids")).alias("told"))


def _joined(told: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order, and their ids."""
    keys, ids = (np.frombuffer(b"".join(x[c] for x in told), "<i8") for c in ("keys", "ids"))
    order = np.argsort(keys)
    return keys[order], ids[order]


def _recoded(shards: DataFrame, found: DataFrame) -> DataFrame:
    """(shard, own, line): positions of the frequent words of a shard, numbered anew from 1, and their numbers in the corpus."""

    def recode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                most = batch.column(2)[row].as_py()
                at, word = _joined(batch.column(3)[row].as_py())
                new = np.zeros(most + 1, np.int32)
                new[at] = np.arange(1, len(at) + 1)
                line = _narrow(new[_wide(batch.column(1)[row].as_py(), most)], len(at))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), pa.array([word.tobytes()], pa.binary()), pa.array([line], pa.binary())], ["shard", "own", "line"])
        give_back()

    return shards.select("shard", "ids", "most").join(_told(found).hint("shuffle_hash"), "shard").mapInArrow(recode, "shard long, own binary, line binary")


def ranges_of(counts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of words whose bitmaps have about ``most`` ones together; a word with more is alone."""
    total, a = np.cumsum(counts), 0
    while a < len(counts):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def extended(line: np.ndarray, longest: int, pairs: np.ndarray | None = None, most: int = RANGE_ONES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(phrases, popcounts) of a shard, as rows of word numbers, from two words to ``longest``.

    ``line`` has the word number at each position, 0 where there is none.  With
    ``pairs`` (sorted codes first << 32 | second), only pairs among them may
    follow each other, and phrases of two words are not given.
    """
    line = np.concatenate([line, np.zeros(1, line.dtype)])  # a shift never leaves the line
    if pairs is None:
        linked = None
    else:  # a bitmap of the positions whose word and the next are such a pair
        code = line[:-1].astype(np.int64) << 32 | line[1:]
        found = np.minimum(np.searchsorted(pairs, code), len(pairs) - 1)
        linked = np.concatenate([pairs[found] == code, [False]])
    # all bitmaps, that of word 1 first
    ones = np.argsort(line, kind="stable")
    counts = np.bincount(line)
    ones, counts = ones[counts[0] :], counts[1:]
    starts = np.cumsum(counts) - counts
    for a, b in ranges_of(counts, most):
        bitmap = ones[starts[a] : starts[b - 1] + counts[b - 1]]
        owner = np.repeat(np.arange(b - a), counts[a:b])  # the phrase that each one belongs to
        phrases = np.arange(a + 1, b + 1)[:, None]
        for size in range(2, longest + 1):
            if linked is not None:
                goes_on = linked[bitmap]
                bitmap, owner = bitmap[goes_on], owner[goes_on]
            bitmap = bitmap + 1  # shift
            word = line[bitmap]  # AND with every word's bitmap
            if linked is None:
                there = word > 0
                bitmap, owner, word = bitmap[there], owner[there], word[there]
            if not len(bitmap):
                break
            by = owner.astype(np.int64) << 32 | word
            order = np.argsort(by, kind="stable")
            by, bitmap = by[order], bitmap[order]
            first = np.flatnonzero(np.r_[True, by[1:] != by[:-1]])
            popcounts = np.diff(np.r_[first, len(by)])
            phrases = np.column_stack([phrases[by[first] >> 32], by[first] & 0xFFFFFFFF])
            owner = np.repeat(np.arange(len(first)), popcounts)
            if linked is None or size > 2:
                yield phrases, popcounts


def _sent(shard: int, size: int, keys: np.ndarray, n: np.ndarray, parts: int) -> list[tuple]:
    """Keys of a shard, of which one may come in several ranges, packed by part."""
    part = _part_of(keys, parts)
    order = np.lexsort((keys, part))
    return [(p, shard, size, _packed(keys[order[x]]), n[order[x]].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()) for p, x in _dealt(part[order])]


def _pair_counts(coded: DataFrame, parts: int) -> DataFrame:
    """Popcounts of pairs of frequent words; a key is the words' numbers, first << 32 | second."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard, own, line = (c[row].as_py() for c in batch.columns)
                own = np.frombuffer(own, "<i8")
                found = [(own[p[:, 0] - 1] << 32 | own[p[:, 1] - 1], n) for p, n in extended(_wide(line, len(own)), 2)]
                if found:
                    yield _as_batch(_sent(shard, 2, *map(np.concatenate, zip(*found)), parts), _KEYS)
        give_back()

    return coded.select("shard", "own", "line").mapInArrow(count, _ddl(_KEYS))


def _long_counts(coded: DataFrame, found: DataFrame, longest: int, parts: int) -> DataFrame:
    """Popcounts of phrases of three words and four, all of whose pairs are frequent; a key is the numbers of the first pair and the last."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard, own, line, told = (c[row].as_py() for c in batch.columns)
                own = np.frombuffer(own, "<i8")
                keys, ids = _joined(told)
                # the pairs in the shard's own numbers
                order = np.argsort(own)
                local = [order[np.searchsorted(own[order], w)] + 1 for w in (keys >> 32, keys & 0xFFFFFFFF)]
                codes = local[0] << 32 | local[1]
                by_code = np.argsort(codes)
                codes, ids = codes[by_code], ids[by_code]
                sizes: dict[int, list] = {}
                for p, n in extended(_wide(line, len(own)), longest, codes):
                    first, last = (ids[np.searchsorted(codes, p[:, k] << 32 | p[:, k + 1])] for k in (0, p.shape[1] - 2))
                    sizes.setdefault(p.shape[1], []).append((first << 32 | last, n))
                rows = [r for size, several in sizes.items() for r in _sent(shard, size, *map(np.concatenate, zip(*several)), parts)]
                if rows:
                    yield _as_batch(rows, _KEYS)
        give_back()

    return coded.join(_told(found).hint("shuffle_hash"), "shard").select("shard", "own", "line", "told").mapInArrow(count, _ddl(_KEYS))


def frequent_phrases(docs: DataFrame, least: int = 30, longest: int = 4, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Phrases of up to ``longest`` (two to four) words that come ``least`` times or oftener in their language.

    Gives (ids, f) with phrases of one word on as arrays of word numbers, (word_id,
    lang, word), and (lang, n) with the words of each language.  A word has a
    number of its own in each language.
    """
    if not 2 <= longest <= 4:
        raise ValueError("phrases have two to four words")
    parts = partitions(docs.sparkSession)
    told, shards_path = staged(shards(docs, text_col, lang_col), "shards")
    totals, _ = staged(told.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    words, _ = staged(_frequent_words(_word_counts(told, parts), least, parts), "vocabulary")
    coded, coded_path = staged(_recoded(told, words), "coded")
    discard(docs.sparkSession, shards_path)
    pairs, _ = staged(_frequent_keys(_pair_counts(coded, parts), least, parts, tell=True), "pairs")
    vocabulary = words.where("kind = 1").select(F.col("id").alias("word_id"), "lang", "word", "f")
    two = pairs.where("kind = 1").select("id", F.array("left", "right").alias("ids"), "f")
    found = vocabulary.select(F.array("word_id").alias("ids"), "f").unionByName(two.drop("id"))
    if longest > 2:
        more, _ = staged(_frequent_keys(_long_counts(coded, pairs, longest, parts), least, parts, tell=False), "phrases")
        first, last = (two.select(F.col("id").alias(side), F.col("ids").alias(f"{side}_ids")) for side in ("left", "right"))
        # the planner thinks this table smaller than it is, for the columns it leaves out are empty
        met = more.select("size", "left", "right", "f").join(first.hint("merge"), "left").join(last.hint("merge"), "right")
        found = found.unionByName(met.select(F.concat("left_ids", F.slice("right_ids", (5 - F.col("size")).cast("int"), 2)).alias("ids"), "f"))
    discard(docs.sparkSession, coded_path)
    return staged(found, "found")[0], vocabulary.drop("f"), totals


def _exact(column: str) -> Column:
    return F.col(column).cast("decimal(20,0)")


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, covered: int = 80, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language by the score of their weakest cut.

    The score of a cut is floor(2000000 a / (l + r)) for a phrase that comes a times
    and whose parts come l and r times.  A phrase goes if a longer one that holds
    it comes at least ``covered`` hundredths as often.
    """
    found, words, totals = frequent_phrases(docs, least, longest, text_col, lang_col)
    several = found.where(F.size("ids") > 1)
    # each part of a frequent phrase is as frequent, and so is found
    cut = several.select("ids", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cut = cut.select("ids", "a", "k", F.slice("ids", F.lit(1), F.col("k")).alias("first"), F.slice("ids", F.col("k") + 1, F.size("ids")).alias("rest"))
    left, right = found.select(F.col("ids").alias("first"), F.col("f").alias("l")), found.select(F.col("ids").alias("rest"), F.col("f").alias("r"))
    scores = cut.join(left, "first").join(right, "rest").withColumn("score", F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    weakest = scores.groupBy("ids").agg(F.min("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("x")).select("ids", "a", "x.score", "x.l", "x.r")
    # phrases within longer ones, with the most that any of those comes
    inner = (
        several.where(F.size("ids") > 2)
        .select("f", "ids", F.explode(F.expr("flatten(transform(sequence(2, size(ids) - 1), n -> transform(sequence(1, size(ids) - n + 1), k -> slice(ids, k, n))))")).alias("inner"))
        .groupBy("inner")
        .agg(F.max("f").alias("most"))
    )
    kept = weakest.join(inner, weakest.ids == inner.inner, "left").where(F.col("most").isNull() | (_exact("most") * 100 < _exact("a") * covered)).drop("inner", "most")
    kept, _ = staged(kept.withColumn("of", F.monotonically_increasing_id()), "kept")
    spelt = kept.select("of", F.posexplode("ids").alias("k", "word_id")).join(words.select("word_id", "lang", "word").hint("merge"), "word_id")
    # as many words as a phrase has
    phrases = spelt.groupBy("of").agg(F.min("lang").alias("lang"), F.array_join(F.array_sort(F.collect_list(F.struct("k", "word")))["word"], " ").alias("phrase"))
    rows = kept.drop("ids").join(phrases, "of")
    # the first of each part are few, whatever a language has, and hold the first of all
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    rows = rows.withColumn("part", part).withColumn("nth", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).where(F.col("nth") <= top)
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
),
lines AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
runs AS (SELECT lang, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM lines, (VALUES (1), (2), (3), (4)) sizes(size) WHERE len(words) >= size),
phrases AS (SELECT lang, words[i:i + size - 1] AS words, size, count(*)::HUGEINT AS f FROM runs GROUP BY ALL),
found AS (SELECT * FROM phrases WHERE f >= 30),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM phrases WHERE size = 1 GROUP BY lang),
cuts AS (SELECT lang, words, f AS a, size, unnest(range(1, size)) AS k FROM found WHERE size > 1),
scored AS (
    SELECT c.lang, c.words, c.a, c.k, l.f AS l, r.f AS r, (2000000 * c.a) // (l.f + r.f) AS score
    FROM cuts c JOIN found l ON l.lang = c.lang AND l.words = c.words[1:c.k] JOIN found r ON r.lang = c.lang AND r.words = c.words[c.k + 1:c.size]
),
weakest AS (SELECT lang, words, a, arg_min(struct_pack(l := l, r := r, score := score), struct_pack(score := score, k := k)) AS x FROM scored GROUP BY lang, words, a),
inside AS (SELECT lang, words, f, size, n, unnest(range(1, size - n + 2)) AS i FROM found, (VALUES (2), (3)) lengths(n) WHERE n < size),
covers AS (SELECT lang, words[i:i + n - 1] AS words, max(f) AS most FROM inside GROUP BY ALL),
kept AS (SELECT w.lang, array_to_string(w.words, ' ') AS phrase, w.a, x.l AS l, x.r AS r, x.score AS score FROM weakest w LEFT JOIN covers c ON c.lang = w.lang AND c.words = w.words WHERE most IS NULL OR 100 * most < 80 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
