"""Language identification by bit-sliced Bloom filters of character n-grams.

Learning counts the n-grams of the labelled texts by language, in Spark.  A
language's filter holds the n-grams that make up at least ``share`` of its text
and are not rarer there than ``ratio`` of where they are most usual, so it has no
more than 1 / share entries however large the corpus.  The filters of all
languages are sliced: one table of masks, in which bit l of a place belongs to
language l, so the places of an n-gram, ANDed, give all languages that contain
it at once.  A text's popcounts by language, less those that its filter's fill
would give by chance, decide.

An n-gram is ``size`` characters of the lower-cased text, in which every run of
characters other than letters is one separator, at both ends too.

Cases: a text that is null or has no letter is ``und`` with score 0.  Where no
filter knows anything of a text, or two languages tie, the one with more learned
text comes first, then the smaller name.  If there is nothing to learn from, all
texts are ``und``.  A null identifier counts as the empty text for the fold, and
repeated rows are learned from and judged once each.  A very long text is read
in parts, across whose borders n-grams go on.  An empty table gives an empty result.  Other columns are
not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from propflow.llm.shared import give_back, once_a_process, staged, table

UNKNOWN = "und"
#: Characters of an n-gram: three code points of 21 bits fill a number exactly.
SIZE = 3
#: Places of a filter, as a power of two, and how many of them an n-gram has.
PLACE_BITS, HASHES = 20, 3
#: The least share of a language's n-grams that an n-gram of its filter has, and the least part of its highest share among languages.
SHARE, RATIO = 1e-5, 0.05
#: Characters that are looked at together, and n-grams of a language that a task counts before it sends them.
BLOCK_CHARS, HELD_GRAMS = 1 << 20, 1 << 21

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return once_a_process("letters", "", lambda _: np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))


def grams(text: str, is_letter: np.ndarray, most: int = BLOCK_CHARS) -> Iterator[np.ndarray]:
    """The n-grams of a text, in order, as numbers, those of ``most`` characters at a time; none if it has no letter."""
    before = np.zeros(0, np.uint64)  # the last SIZE - 1 characters and separators so far
    in_word = met = False
    for at in range(0, len(text), most):
        points = np.frombuffer(text[at : at + most].lower().encode("utf-32-le", "surrogatepass"), "<u4")
        solid = is_letter[points]
        # a separator after each word, as zero; and one before the first
        keep = solid.copy()
        keep[1:] |= solid[:-1]
        keep[0] |= in_word
        line = np.where(solid, points, 0).astype(np.uint64)[keep]
        if not met and solid.any():
            line, met = np.concatenate([np.zeros(1, np.uint64), line]), True
        in_word = bool(solid[-1])
        if in_word and at + most >= len(text):
            line = np.concatenate([line, np.zeros(1, np.uint64)])
        line = np.concatenate([before, line])
        before = line[-2:]
        if len(line) > 2:
            yield line[:-2] << np.uint64(42) | line[1:-1] << np.uint64(21) | line[2:]


def places(gram: np.ndarray, hashes: int = HASHES, bits: int = PLACE_BITS) -> np.ndarray:
    """(hashes, n): the places of each n-gram in a filter."""
    with np.errstate(over="ignore"):
        h = (gram + _A) * _B
        h = (h ^ (h >> np.uint64(31))) * _A
        h ^= h >> np.uint64(29)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([((h + np.uint64(k) * step) & np.uint64((1 << bits) - 1)).astype(np.int64) for k in range(hashes)])


def learned_grams(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, gram, n): how often each n-gram comes in the texts of each language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_letter = letters()
        held: dict[str, list] = {}
        sizes: dict[str, int] = {}

        def folded(parts: list) -> tuple[np.ndarray, np.ndarray]:
            gram, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
            return gram, np.bincount(at, np.concatenate([n for _, n in parts]), len(gram)).astype(np.int64)

        def sent(lang: str) -> pa.RecordBatch:
            gram, n = folded(held.pop(lang))
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for block in grams(text.as_py(), is_letter):
                    held.setdefault(lang, []).append((block, np.ones(len(block), np.int64)))
                    sizes[lang] = sizes.get(lang, 0) + len(block)
                    if sizes[lang] > HELD_GRAMS:
                        held[lang] = [folded(held[lang])]
                        sizes[lang] = len(held[lang][0][0])
                        if sizes[lang] > HELD_GRAMS // 2:
                            yield sent(lang)
                            sizes[lang] = 0
        for lang in list(held):
            yield sent(lang)
        give_back()

    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Names of the languages, those with more text first, and their filters.

    ``masks`` is (words of 64 languages, places); ``chance`` the part of unknown
    n-grams that each language's filter takes for its own.
    """

    names: list[str]
    masks: np.ndarray
    chance: np.ndarray
    hashes: int = HASHES
    bits: int = PLACE_BITS

    def languages(self, gram: np.ndarray) -> np.ndarray:
        """(words, n): masks of all languages whose filters contain each n-gram."""
        where = places(gram, self.hashes, self.bits)
        found = self.masks[:, where[0]]
        for k in range(1, self.hashes):
            found &= self.masks[:, where[k]]
        return found

    def popcounts(self, gram: np.ndarray) -> np.ndarray:
        """How many of the n-grams each language contains."""
        found = self.languages(gram)
        return np.array([np.count_nonzero(found[k // 64] >> np.uint64(k % 64) & np.uint64(1)) for k in range(len(self.names))], np.int64)

    def decide(self, counts: np.ndarray, n: int) -> tuple[str, float]:
        """The language, and the share of the text's n-grams that it really contains."""
        real = np.clip((counts / n - self.chance) / (1 - self.chance), 0, 1)
        best = int(real.argmax())
        return self.names[best], float(real[best])


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", share: float = SHARE, ratio: float = RATIO, bits: int = PLACE_BITS, hashes: int = HASHES) -> Model:
    """Filters from the rows of ``docs`` that have both a text and a language."""
    counted, _ = staged(learned_grams(docs, lang_col, text_col), "grams")
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    # a row a language: names go with the model
    names = [r.lang for r in totals.orderBy(F.col("total").desc(), "lang").collect()]
    masks = np.zeros((max(1, -(-len(names) // 64)), 1 << bits), np.uint64)
    if names:
        order = docs.sparkSession.createDataFrame(list(zip(names, range(len(names)))), "lang string, bit int")
        known = F.broadcast(totals.join(order, "lang"))
        rates = counted.join(known, "lang").withColumn("rate", F.col("n") / F.col("total"))
        highest = rates.groupBy("gram").agg(F.max("rate").alias("highest"), F.collect_list(F.struct("bit", "rate")).alias("of"))
        kept = highest.select("gram", "highest", F.explode("of").alias("x")).where((F.col("x.rate") >= share) & (F.col("x.rate") >= ratio * F.col("highest"))).select("gram", "x.bit")

        def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = places(batch.column(0).to_numpy().view(np.uint64), hashes, bits).ravel()
                bit = np.tile(batch.column(1).to_numpy(), hashes).astype(np.int64)
                mask = np.left_shift(np.uint64(1), (bit % 64).astype(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(bit // 64), pa.array(at), pa.array(mask)], ["word", "place", "mask"])

        slices = kept.mapInArrow(positions, "word long, place long, mask long").groupBy("word", "place").agg(F.bit_or("mask").alias("mask"))
        # never more rows than the table of masks has cells, whatever the corpus
        found = slices.toArrow()
        masks[found["word"].to_numpy(), found["place"].to_numpy()] = found["mask"].to_numpy().view(np.uint64)
    fill = np.array([np.count_nonzero(masks[k // 64] >> np.uint64(k % 64) & np.uint64(1)) / masks.shape[1] for k in range(len(names))])
    return Model(names, masks, np.minimum(fill**hashes, 0.999), hashes, bits)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """(id, *more, lang_pred, score) for each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, is_letter = sent.value, letters()
        for batch in batches:
            names, scores = [], []
            for text in batch.column(batch.num_columns - 1):
                n, counts = 0, 0
                for block in grams(text.as_py() or "", is_letter) if model.names else ():
                    n, counts = n + len(block), counts + model.popcounts(block)
                name, score = model.decide(counts, n) if n else (UNKNOWN, 0.0)
                names.append(name)
                scores.append(score)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names[:-1], "lang_pred", "score"])
        give_back()

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), *more, F.col(text_col).cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(judge, f"{schema}, lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from learning."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score): learned from the rows that are not held out."""
    return predict(docs, learn(docs.where(~held_out(id_col)), lang_col, text_col), id_col, text_col, held_out(id_col).alias("held_out"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(table(spark, sf_dir, "documents"))
