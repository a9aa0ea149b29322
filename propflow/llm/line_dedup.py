"""Line deduplication by winnowing over line hashes, in DataFrame functions only.

1. Lines (trimmed, blank ones left out) are hashed.  At each line two windows of
   just ``least_words`` words or more are laid, one that starts and one that ends
   there.  The line of the smallest hash in a window is selected: a document's
   fingerprints are the selected lines, each once however many windows select it.
   Whatever run of so many words two places share, they share a window, and so a
   fingerprint.
2. Fingerprints that occur once in the corpus are left behind, and with them all
   windows that selected them.
3. Positions are joined on the fingerprint.  A line common to unlike passages is
   selected in all of them, so the windows' lines, hashed, are part of the key, and
   each position meets the first place of its window alone, never all others.
4. A meeting is a pair of documents and a shift of lines.  Their lines are laid
   side by side at that shift and compared by digest, and matches are extended to
   the left and to the right up to where the texts part.  Runs of ``least_words``
   words or more are deleted at the later place, first by document, then by line.

Hashes of 64 bits only propose; what is deleted was compared by 128 bits of the
SHA-256 of every line.

Cases: a null text counts as empty, one empty line.  A null identifier comes
after all others.  Rows alike in identifier
and text share one result.  A run repeated within a document is deleted there
too.  Texts of fewer words than a window are left alone; a very long text is one
row and its lines as many.  Blank lines within a deleted run go with it, but for
those between two lines that are each as long as a window.  An empty table gives
an empty result.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from propflow.llm.shared import staged, table, text_hash_of, text_of

LEAST_WORDS = 50
_BLANKS = " \t\x0b\x0c\r"
_LAST = (1 << 63) - 1


def _lines(docs: DataFrame) -> DataFrame:
    """(id, tie, lines): of each row its lines that are not blank, as structs of place, hash, digest and words."""
    trimmed = F.transform(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(_BLANKS)))
    found = F.transform(
        trimmed,
        lambda x, i: F.struct(i.alias("pos"), F.xxhash64(x).alias("h"), F.unhex(F.left(F.sha2(x, 256), F.lit(32))).alias("d"), F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")).alias("w")),
    )
    return docs.select("id", "tie", F.filter(found, lambda x: x["w"] > 0).alias("lines"))


def windows(lines: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(id, tie, first, at, fingerprint, content): all windows, both ways, by the numbers of their lines.

    ``at`` is the line that the window selects and ``fingerprint`` its hash.
    """
    doc = ["id", "tie"]
    rows = lines.select(*doc, F.posexplode("lines").alias("nth", "x")).select(*doc, "nth", "x.h", "x.w")
    rows = rows.repartition(*doc).dropDuplicates([*doc, "nth"])
    end = F.sum("w").over(Window.partitionBy(*doc).orderBy("nth").rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("w"))
    right = Window.partitionBy(*doc).orderBy("start").rangeBetween(0, least_words - 1)
    left = Window.partitionBy(*doc).orderBy("end").rangeBetween(1 - least_words, 0)

    def laid(over, words):
        return F.when(
            words >= least_words,
            F.struct(
                F.min("nth").over(over).alias("first"),
                F.min(F.struct("h", "nth")).over(over).alias("least"),
                F.xxhash64(F.collect_list("h").over(over)).alias("content"),
            ),
        )

    both = placed.select(*doc, laid(right, F.max("end").over(right) - F.col("start")).alias("r"), laid(left, F.col("end") - F.min("start").over(left)).alias("l"))
    found = both.select(*doc, F.explode(F.array_compact(F.array_distinct(F.array("r", "l")))).alias("x"))
    return found.select(*doc, "x.first", F.col("x.least.nth").alias("at"), F.col("x.least.h").alias("fingerprint"), "x.content")


def fingerprints(laid: DataFrame) -> DataFrame:
    """(id, tie, at, fingerprint): the lines that windows select, each once."""
    return laid.select("id", "tie", "at", "fingerprint").distinct()


def meetings(laid: DataFrame) -> DataFrame:
    """(id, tie, other, other_tie, shift): places that share a window with the first place that has it.

    Line n of the document is line n - shift of the other, which is an earlier
    document or the document itself.
    """
    # counted before they are shuffled: a fingerprint of a third of all documents is a row a task
    again = fingerprints(laid).groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fingerprint")
    again, _ = staged(again, "repeated")
    met = laid.join(again, "fingerprint", "left_semi")
    key = ["fingerprint", "content"]
    place = F.struct("id", "tie", "first")
    firsts, _ = staged(met.groupBy(*key).agg(F.min(place).alias("origin"), F.max(place).alias("final")).where("origin <> final").drop("final"), "origins")
    later = met.join(firsts, key).where(F.struct("id", "tie", "first") > F.col("origin"))
    return later.select("id", "tie", F.col("origin.id").alias("other"), F.col("origin.tie").alias("other_tie"), (F.col("first") - F.col("origin.first")).alias("shift")).distinct()


def repeated_runs(lines: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(id, tie, removed): the line numbers of later repeats, for each document with any."""
    laid, _ = staged(windows(lines, least_words), "windows")
    found, _ = staged(meetings(laid), "meetings")
    doc = ["id", "tie"]
    known = found.select(*doc).unionByName(found.select(F.col("other").alias("id"), F.col("other_tie").alias("tie"))).distinct()
    sides, _ = staged(lines.join(known.hint("shuffle_hash"), doc, "left_semi").dropDuplicates(doc), "sides")
    others = sides.select(F.col("id").alias("other"), F.col("tie").alias("other_tie"), F.col("lines.d").alias("other_lines"))
    pairs = found.join(others, ["other", "other_tie"]).drop("other", "other_tie").join(sides, doc)
    shift = F.col("shift")
    low, high = F.greatest(F.lit(0), shift), F.least(F.size("lines"), F.size("other_lines") + shift)
    # lines at which the two part, with the ends of what there is to compare
    parted = F.filter(F.sequence(low - 1, high), lambda i: (i < low) | (i >= high) | (F.get("lines", i)["d"] != F.get("other_lines", i - shift)))
    pairs = pairs.select(*doc, "lines", parted.alias("parted"))
    runs = F.transform("parted", lambda i, k: F.struct((i + 1).alias("a"), (F.coalesce(F.get("parted", k + 1), i) - 1).alias("z")))

    def words(r):
        return F.aggregate(F.slice("lines", r["a"] + 1, r["z"] - r["a"] + 1), F.lit(0), lambda n, x: n + x["w"])

    def long(k):
        return F.get("lines", k)["w"] >= least_words

    def place(k):
        return F.get("lines", k)["pos"]

    def gone(r):
        # with the blank lines up to the next line of the run
        return F.flatten(F.transform(F.sequence(r["a"], r["z"]), lambda k: F.sequence(place(k), F.when((k < r["z"]) & ~(long(k) & long(k + 1)), place(k + 1) - 1).otherwise(place(k)))))

    enough = F.filter(runs, lambda r: (r["z"] >= r["a"]) & (words(r) >= least_words))
    removed = pairs.select(*doc, F.explode(F.array_distinct(F.flatten(F.transform(enough, gone)))).alias("line"))
    return removed.groupBy(*doc).agg(F.collect_set("line").alias("removed"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """(id, text, n_lines, removed array of line numbers) with later repeated runs deleted from text."""
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("id"),
        text_hash_of(docs, text_col).alias("tie"),
        text_of(text_col).alias("text"),
        F.col(id_col).isNull().alias("none"),
    )
    lines, _ = staged(_lines(rows), "lines")
    runs, _ = staged(repeated_runs(lines, least_words), "runs")
    # runs are hashed and texts stream past them, so that texts are never sorted
    runs = runs.withColumnsRenamed({"id": "_id", "tie": "_tie", "removed": "_removed"}).hint("shuffle_hash")
    met = rows.join(runs, (F.col("id") == F.col("_id")) & (F.col("tie") == F.col("_tie")), "left")
    met = met.withColumn("lines", F.split("text", "\n", -1)).withColumn("removed", F.sort_array(F.coalesce("_removed", F.array().cast("array<int>"))))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("removed"))
    left = F.when(F.size("removed") == 0, F.col("text")).otherwise(
        F.array_join(F.transform(kept, lambda k: F.get(F.col("lines"), k)), "\n")
    )
    return met.select(F.when(~F.col("none"), F.col("id")).alias(id_col), left.alias(text_col), F.size("lines").cast("long").alias("n_lines"), "removed")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_lines",
        F.size("removed").cast("long").alias("removed_lines"),
        F.array_join(F.transform("removed", lambda x: x.cast("string")), ",").alias("removed"),
        F.sha2("text", 256).alias("clean_sha256"),
    )


SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), numbered AS (
  SELECT doc_id, unnest(range(len(lines))) AS pos, unnest(lines) AS raw FROM docs
), trimmed AS (
  SELECT doc_id, pos, trim(raw, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line,
         len(regexp_extract_all(raw, '[^\x20\x09-\x0D]+')) AS w
  FROM numbered
), placed AS (
  SELECT doc_id, pos, line, w,
         (sum(w) OVER (PARTITION BY doc_id ORDER BY pos))::BIGINT AS e,
         (sum(w) OVER (PARTITION BY doc_id ORDER BY pos) - w)::BIGINT AS s
  FROM trimmed WHERE w > 0
), laid AS (
  SELECT doc_id, pos AS first, max(pos) OVER r AS last, max(e) OVER r - s AS words, list(line) OVER r AS content
  FROM placed WINDOW r AS (PARTITION BY doc_id ORDER BY s RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
  UNION ALL
  SELECT doc_id, min(pos) OVER l, pos, e - min(s) OVER l, list(line) OVER l
  FROM placed WINDOW l AS (PARTITION BY doc_id ORDER BY e RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)
), ranked AS (
  SELECT doc_id, first, last,
         dense_rank() OVER (PARTITION BY content ORDER BY doc_id, first) AS nth
  FROM laid WHERE words >= 50
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS pos FROM ranked WHERE nth > 1
), kept AS (
  SELECT n.doc_id,
         string_agg(n.raw, chr(10) ORDER BY n.pos) FILTER (WHERE g.pos IS NULL) AS clean,
         string_agg(n.pos::VARCHAR, ',' ORDER BY n.pos) FILTER (WHERE g.pos IS NOT NULL) AS removed,
         count(*) AS n_lines, count(g.pos) AS removed_lines
  FROM numbered n LEFT JOIN gone g ON n.doc_id = g.doc_id AND n.pos = g.pos GROUP BY n.doc_id
)
SELECT doc_id, n_lines, removed_lines, coalesce(removed, '') AS removed, sha256(coalesce(clean, '')) AS clean_sha256 FROM kept
"""
