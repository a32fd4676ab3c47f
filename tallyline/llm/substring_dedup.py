"""Substring dedup: every run of consecutive sentences hashed, joined over the whole corpus, repeats taken out.

Every run of SIZE consecutive sentences of every document is hashed, short or long, and all equal
runs meet. Of equal runs the first in order of (doc_id, text hash, place) stays; every sentence that
a later one covers goes, so a repeated passage of SIZE sentences or more goes whole, however short
its sentences are. What stands between the rest is kept as it was. Passages within one document
that repeat go as those across documents do. A caller may ask that a span of removed sentences in a
row has a least number of words.

Runs are told apart by two independent 64-bit hashes, 128 bits in all. A passage of fewer sentences
than a run stays: two neighbouring sentences of two words each are alike by chance all over a corpus.

Defined results for odd rows: a null or empty text has no sentences and stays as it is; rows with
equal doc_id and text are one document and get the same result; rows with one doc_id and different
texts are different documents, in order of their texts' hashes, and null ids come first; columns
n_sentences and n_removed of the caller are replaced, other extra columns pass through; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences of a run.
SIZE = 3
#: A sentence ends after a full stop, exclamation or question mark before white space, and after a line.
BOUNDARY = r"(?<=[.!?])(?=[\x20\x09-\x0D])|(?<=\n)"
BLANK = " \t\n\x0b\x0c\r"


def pieces(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), BOUNDARY)


def text_key(text: str) -> Column:
    return F.xxhash64(text)


def runs(docs: DataFrame, text: str = "text", size: int = SIZE) -> DataFrame:
    """doc_id, the text's key h, and per run of so many sentences its two hashes and its place p among the sentences."""
    trimmed = F.filter(F.transform(pieces(text), lambda p: F.btrim(p, F.lit(BLANK))), lambda t: t != "")
    hashed = docs.select("doc_id", text_key(text).alias("h"), F.transform(trimmed, lambda t: F.struct(F.xxhash64(t).alias("x"), F.xxhash64(F.lit(1), t).alias("y"))).alias("s"))

    def run(i: Column) -> Column:
        each = [F.get("s", i + j) for j in range(size)]
        return F.struct(F.xxhash64(*(s["x"] for s in each)).alias("x"), F.xxhash64(*(s["y"] for s in each)).alias("y"), i.alias("p"))

    long = hashed.where(F.size("s") >= size)
    return long.select("doc_id", "h", F.explode(F.transform(F.sequence(F.lit(0), F.size("s") - size), run)).alias("r")).select("doc_id", "h", "r.*")


def marked(docs: DataFrame, text: str = "text", size: int = SIZE) -> DataFrame:
    """doc_id, h and starts: the places of the runs that aren't the first of their kind, for documents that have any.

    The first grouping combines before the shuffle, so that a run that very many documents share
    sends few rows; the join back to its places is one that Spark splits when a hash is hot.
    """
    every = runs(docs, text, size)
    repeated = every.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "h", "p")).alias("first")).where("n > 1").drop("n")
    later = every.join(repeated, ["x", "y"]).where(~F.struct("doc_id", "h", "p").eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "h").agg(F.collect_set("p").alias("starts"))


def covered(starts: str, size: int) -> Column:
    """Places of all sentences that the runs with these starts cover, in order."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(starts, lambda p: F.sequence(p, p + size - 1)))))


def in_spans(at: str, words: str, least: int) -> Column:
    """Those places that stand in spans of places in a row with so many words."""
    before, after = F.concat(F.array(F.lit(-2)), F.col(at)), F.concat(F.slice(at, F.lit(2), F.size(at)), F.array(F.lit(-2)))
    first = F.filter(F.zip_with(at, F.slice(before, F.lit(1), F.size(at)), lambda p, q: F.when(p != q + 1, p)), lambda p: p.isNotNull())
    last = F.filter(F.zip_with(at, after, lambda p, q: F.when(q != p + 1, p)), lambda p: p.isNotNull())
    counted = lambda s: F.aggregate(F.slice(words, s["a"] + 1, s["z"] - s["a"] + 1), F.lit(0), lambda n, w: n + w)
    long = F.filter(F.zip_with(first, last, lambda a, z: F.struct(a.alias("a"), z.alias("z"))), lambda s: counted(s) >= least)
    return F.flatten(F.transform(long, lambda s: F.sequence(s["a"], s["z"])))


def deduplicated(docs: DataFrame, text: str = "text", size: int = SIZE, least_words: int = 0) -> DataFrame:
    """The documents with repeated sentences taken out of the text, n_sentences and n_removed."""
    found = marked(docs, text, size).select(F.col("doc_id").alias("__tl_id"), F.col("h").alias("__tl_h"), covered("starts", size).alias("__tl_lost"))
    out = docs.drop("n_sentences", "n_removed").withColumn("__tl_key", text_key(text))
    out = out.join(found, F.col("doc_id").eqNullSafe(F.col("__tl_id")) & (F.col("__tl_key") == F.col("__tl_h")), "left")
    trimmed = F.transform("__tl_p", lambda p: F.btrim(p, F.lit(BLANK)))
    # Places count the pieces with characters alone; what has none stays.
    at = F.filter(F.transform(trimmed, lambda t, i: F.when(t != "", i)), lambda i: i.isNotNull())
    out = out.withColumn("__tl_p", pieces(text)).withColumn("__tl_at", at)
    if least_words:
        words = F.transform(F.filter(trimmed, lambda t: t != ""), lambda t: F.size(F.split(t, r"[\x20\x09-\x0D]+")))
        out = out.withColumn("__tl_words", F.when(F.col("__tl_lost").isNotNull(), words)).withColumn("__tl_lost", in_spans("__tl_lost", "__tl_words", least_words)).drop("__tl_words")
    gone = F.transform("__tl_lost", lambda n: F.get("__tl_at", n))
    kept = F.array_except(F.sequence(F.lit(0), F.size("__tl_p") - 1), "__tl_gone")
    return (
        out.withColumn("__tl_gone", gone)
        .withColumns(
            {
                "n_sentences": F.size("__tl_at").cast("long"),
                "n_removed": F.coalesce(F.size("__tl_gone"), F.lit(0)).cast("long"),
                text: F.when(F.size("__tl_gone") > 0, F.array_join(F.transform(kept, lambda i: F.get("__tl_p", i)), "")).otherwise(F.col(text)),
            }
        )
        .drop("__tl_key", "__tl_id", "__tl_h", "__tl_lost", "__tl_p", "__tl_at", "__tl_gone")
    )


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    from tallyline.session import table

    return deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_sentences", "n_removed", "text")


#: A document's id alone orders its runs here: in the given tables ids tell the documents apart.
ORACLE = rf"""
WITH pieces AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(coalesce(text, ''), '([.!?])([\x20\x09-\x0D])', '\1' || chr(1) || '\2', 'g'), '\n', chr(10) || chr(1), 'g'), chr(1)) AS ps FROM documents),
p AS (SELECT doc_id, i, ps[i] AS piece, trim(ps[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM pieces)),
s AS (SELECT doc_id, i, t, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS n FROM p WHERE t <> ''),
w AS (SELECT doc_id, n, t {"".join(f"|| chr(2) || lead(t, {k}) OVER (PARTITION BY doc_id ORDER BY n) " for k in range(1, SIZE))}AS x FROM s),
later AS (SELECT doc_id, n FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY doc_id, n) AS c FROM w WHERE x IS NOT NULL) WHERE c > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(n, n + {SIZE})) AS n FROM later),
flags AS (SELECT p.doc_id, p.i, p.piece, s.n IS NOT NULL AS sentence, gone.n IS NOT NULL AS lost FROM p
  LEFT JOIN s ON s.doc_id = p.doc_id AND s.i = p.i LEFT JOIN gone ON gone.doc_id = p.doc_id AND gone.n = s.n)
SELECT f.doc_id, count(*) FILTER (sentence) AS n_sentences, count(*) FILTER (lost) AS n_removed,
  coalesce(string_agg(piece, '' ORDER BY i) FILTER (NOT lost), '') AS text FROM flags f GROUP BY f.doc_id
"""
