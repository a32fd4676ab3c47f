"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Defined results for odd rows: a null or empty text has no words and fails the base rules; nulls
in other columns and extra columns pass through; repeated rows are judged one by one; an empty
table gives an empty result; a column named like a measure is replaced by the measure.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates words: space and the ASCII controls from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
#: Words of a window whose return within a text counts as repetition.
WINDOW = 8

#: Frequent function words of the languages that the rules know.
STOP_WORDS = (
    "the of and to in that it is was for on with as be at by are this from or an not "
    "le la les de des du et en un une est que qui dans pour sur au pas par il ne se ce "
    "der die das und ist nicht ein eine von zu mit den im auf als auch es dem sich "
    "el los las y que una por con para del al lo como su no"
).split()


@dataclass(frozen=True)
class Rule:
    """A measure of a text must lie between two bounds; a missing bound holds always."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: The verdict's thresholds, after the widely published heuristics for web text.
RULES = (
    Rule("words", "n_words", 20, None),
    Rule("repeated windows", "repeat_share", high=0.30),
    Rule("word length", "mean_word_length", 3.0, 12.0),
    Rule("symbols", "symbols_per_word", high=0.20),
    Rule("repeated lines", "dup_line_share", high=0.50),
    Rule("distinct words", "distinct_word_share", low=0.05),
    Rule("shouts", "shouts_per_word", high=0.30),
    Rule("stop words", "stop_share", low=0.01),
)


def verdict(rules: tuple[Rule, ...]) -> Column:
    """True where every rule holds; a measure that can't be computed fails its rule."""
    held = F.lit(True)
    for r in rules:
        if r.low is not None:
            held = held & F.coalesce(F.col(r.measure) >= r.low, F.lit(False))
        if r.high is not None:
            held = held & F.coalesce(F.col(r.measure) <= r.high, F.lit(False))
    return held


def first_failure(rules: tuple[Rule, ...]) -> Column:
    """Name of the first rule that fails, else null."""
    return F.coalesce(*(F.when(~verdict((r,)), F.lit(r.name)) for r in rules))


def covered(starts: Column, width: int) -> Column:
    """Number of places that windows of this width cover, from the ascending array of their starts."""
    return F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(-1_000_000).alias("last")),
        lambda a, s: F.struct((a["n"] + F.least(F.lit(width), s - a["last"])).alias("n"), s.alias("last")),
        lambda a: a["n"].cast("long"),
    )


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measures that rules speak of; each text is split once and never leaves the JVM.

    A repeated window is found by sorting (hash, start) of the text's own windows, so that equal
    ones are neighbours; only texts with a repeated hash are sorted.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    no_text = docs.withColumn("__tl_t", body)
    words = F.array_remove(F.split("__tl_t", f"{SPACE}+"), "")
    lines = F.filter(F.split("__tl_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    split = no_text.withColumns({"__tl_w": words, "__tl_l": lines})
    n = F.size("__tl_w")
    counted = split.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.array_join("__tl_w", "")).cast("long"),
            "n_symbols": (F.length("__tl_t") - F.length(F.regexp_replace("__tl_t", SYMBOL, ""))).cast("long"),
            "n_lines": F.size("__tl_l").cast("long"),
            "n_dup_lines": (F.size("__tl_l") - F.size(F.array_distinct("__tl_l"))).cast("long"),
            "__tl_distinct": F.size(F.array_distinct("__tl_w")),
            "__tl_stop": F.size(F.filter("__tl_w", lambda w: w.isin(*STOP_WORDS, *(s.capitalize() for s in STOP_WORDS)))),
            "__tl_shout": F.size(F.filter("__tl_w", lambda w: w.endswith("!!"))),
            "__tl_h": F.when(n >= WINDOW, F.transform("__tl_w", lambda w: F.xxhash64(w))),
        }
    )
    for step in (1, 2, 4):  # hashes of windows of 2, 4 and 8 words
        later = F.slice("__tl_h", F.lit(1 + step), F.greatest(F.size("__tl_h") - step, F.lit(0)))
        both = F.zip_with(F.slice("__tl_h", F.lit(1), F.greatest(F.size("__tl_h") - step, F.lit(0))), later, lambda a, b: F.xxhash64(a, b))
        counted = counted.withColumn("__tl_h", F.when(F.col("__tl_h").isNotNull(), both))
    same = F.size(F.array_distinct("__tl_h")) < F.size("__tl_h")
    by_hash = counted.withColumn("__tl_s", F.when(same, F.array_sort(F.transform("__tl_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    again = F.transform(
        "__tl_s",
        lambda p, k: F.when(
            ((k > 0) & (F.get("__tl_s", k - 1)["h"] == p["h"])) | F.coalesce(F.get("__tl_s", k + 1)["h"] == p["h"], F.lit(False)),
            p["i"],
        ),
    )
    starts = by_hash.withColumn("__tl_again", F.when(F.col("__tl_s").isNotNull(), F.array_sort(F.filter(again, lambda i: i.isNotNull()))))
    per_word = F.greatest(F.col("n_words"), F.lit(1))
    return (
        starts.withColumn("n_repeat_words", F.coalesce(covered(F.col("__tl_again"), WINDOW), F.lit(0).cast("long")))
        .withColumns(
            {
                "repeat_share": F.col("n_repeat_words") / per_word,
                "mean_word_length": F.col("word_chars") / per_word,
                "symbols_per_word": F.col("n_symbols") / per_word,
                "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
                "distinct_word_share": F.col("__tl_distinct") / per_word,
                "shouts_per_word": F.col("__tl_shout") / per_word,
                "stop_share": F.col("__tl_stop") / per_word,
            }
        )
        .drop("__tl_t", "__tl_w", "__tl_l", "__tl_h", "__tl_s", "__tl_again", "__tl_distinct", "__tl_stop", "__tl_shout")
    )


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Measures of each text, base_failed, the verdict kept, and the first rule that failed."""
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (
        measured(docs, text)
        .withColumn("base_failed", base)
        .withColumns({"kept": ~F.col("base_failed") & verdict(rules), "failed_rule": first_failure(rules)})
    )


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    from tallyline.session import table

    out = apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_STOP = ", ".join(f"'{w}'" for s in STOP_WORDS for w in (s, s.capitalize()))

ORACLE = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS txt FROM documents),
s AS (SELECT doc_id, txt, regexp_extract_all(txt, '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(txt, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM s WHERE len(w) >= 8)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, CAST(sum(least(8, coalesce(nxt - i, 8))) AS BIGINT) AS n_repeat_words
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM dup) GROUP BY doc_id),
m AS (SELECT s.doc_id, CAST(len(w) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(txt, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(txt) - length(regexp_replace(txt, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines,
  len(list_distinct(w)) AS n_distinct,
  len(list_filter(w, lambda x: x IN ({_STOP}))) AS n_stop, len(list_filter(w, lambda x: x LIKE '%!!')) AS n_shout
  FROM s LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  (n_words >= 20 AND 100 * n_repeat_words <= 30 * n_words
   AND word_chars >= 3 * n_words AND word_chars <= 12 * n_words
   AND n_symbols::DOUBLE / n_words <= 0.2 AND n_dup_lines::DOUBLE / greatest(n_lines, 1) <= 0.5
   AND n_distinct::DOUBLE / n_words >= 0.05 AND n_shout::DOUBLE / n_words <= 0.3
   AND n_stop::DOUBLE / n_words >= 0.01) AS kept
FROM m
"""
