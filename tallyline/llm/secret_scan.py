"""Secret scans with built-in functions only: patterns, then sliding-window entropy over the rest.

What pattern spans leave over of a run of token characters is cut into the longest runs of each
class's characters, and over each run that is as long as a window and has what its class asks for the
class's window slides: hexadecimal digits, both cases with digits, one case with several digits, any token
characters where letters and digits change often, letters where the cases change often. A string of several
classes is so scanned as each. Overlapping hot windows, also of different classes, are one span; what lies
between two hot stretches stays. The allow-list excuses a piece that holds one of its words.

Places in arrays are summed and looked up in blocks, so that a text with very many matches takes
time nearly in proportion to them. Spans are code points, end exclusive. Defined results for odd rows: a null or empty text has no
spans; nulls in other columns and extra columns pass through; repeated rows are scanned one by
one; spans that start together are ordered by kind as listed; an empty table gives an empty one.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The pattern kinds, in the order in which spans that start together are listed.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
#: A run that is long enough starts where the shortest run would: the length goes into the pattern.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_VALUE = 12
KINDS = ("assign", "access", "hex", "entropy")

#: Candidates of the entropy scan: whole runs of token characters.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"


@dataclass(frozen=True)
class CharClass:
    """Characters of a class, the window slid over runs of them, the bits that make it hot, and patterns that a run must hold."""

    name: str
    alphabet: str
    window: int
    bits: float
    chars: str
    needs: tuple[str, ...]

    @property
    def run(self) -> str:
        return f"[{self.chars}]{{{self.window},}}"


LOWER, UPPER, DIGITS, SIGNS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "+/_=-"
#: No class takes prose or plain numbers: digits and letters are asked for together, or cases that change again and again.
CLASSES = (
    CharClass("hex", DIGITS + "ABCDEFabcdef", 20, 3.0, "0-9A-Fa-f", ("[0-9]", "[A-Fa-f]")),
    CharClass("base64", UPPER + LOWER + DIGITS + SIGNS, 20, 3.7, "A-Za-z0-9+/_=-", ("[0-9]", "[A-Z]", "[a-z]")),
    CharClass("lower", LOWER + DIGITS, 20, 3.6, "a-z0-9", ("([^0-9]*[0-9]){4}", "[a-z]")),
    CharClass("upper", UPPER + DIGITS, 20, 3.6, "A-Z0-9", ("([^0-9]*[0-9]){4}", "[A-Z]")),
    CharClass("mixed", UPPER + LOWER + DIGITS + SIGNS, 20, 3.7, "A-Za-z0-9+/_=-", ("([A-Za-z][0-9].*){4}",)),
    CharClass("letters", UPPER + LOWER, 20, 3.6, "A-Za-z", ("([a-z][A-Z].*){4}",)),
)
#: Characters that a piece must have to be scanned, the least window of all classes.
LEAST = min(c.window for c in CLASSES)
#: What every string has that some class takes: a letter beside a digit, or two changes of case.
PROMISING = r"[0-9].*[A-Za-z]|[A-Za-z].*[0-9]|[a-z][A-Z].*[a-z][A-Z]"
#: Elements of a block, by which sums and look-ups over long arrays go.
BLOCK = 256
#: Strings that look random but are known to be harmless.
ALLOWED = r"[Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Pp][Ll][Aa][Cc][Ee][Hh][Oo][Ll][Dd][Ee][Rr]|[Dd][Uu][Mm][Mm][Yy]|0123456789|[Aa][Bb][Cc][Dd][Ee][Ff][Gg]"


SPANS = "array<struct<start:int,ord:int,end:int,kind:string,value:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blocks_of(array: Column) -> Column:
    """A non-empty array in blocks."""
    return let(array, lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda k: F.slice(x, k * BLOCK + 1, F.lit(BLOCK))))


def sums_before(lengths: Column) -> Column:
    """The sum of all earlier elements, for each of a non-empty array: within blocks, after the sums of the blocks before."""
    total = lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + x)

    def running(values: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(values, first, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    return let(blocks_of(lengths), lambda blocks: F.flatten(F.zip_with(blocks, running(F.transform(blocks, total), F.lit(0)), running)))


def matches(text: Column, pattern: str, kind: str) -> Column:
    """Array of (start, ord, end, kind, value) of the leftmost non-overlapping matches.

    What lies between the matches gives their places, for Spark has no function that returns
    them all. Only texts with a match are taken apart.
    """
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.filter(F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).alias("gap"), h.alias("hit"))), lambda p: p["hit"].isNotNull())

    def span(p: Column, before: Column) -> Column:
        start = before + p["gap"]
        end = start + F.length(p["hit"])
        return F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("ord"), end.alias("end"), F.lit(kind).alias("kind"), p["hit"].alias("value"))

    found = let(pairs, lambda all_: F.zip_with(all_, sums_before(F.transform(all_, lambda p: p["gap"] + F.length(p["hit"]))), span))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPANS))


def left_over(candidates: str, blocks: str) -> Column:
    """(start, ord, end, kind, value) of the pieces of candidates that no base span touches; blocks are those of the sorted base spans with their reach."""

    def pieces(c: Column) -> Column:
        near = F.filter(blocks, lambda b: (b["from"] < c["end"]) & (b["to"] > c["start"]))
        touching = F.filter(F.flatten(F.transform(near, lambda b: b["spans"])), lambda b: (b["start"] < c["end"]) & (b["end"] > c["start"]))
        cut = lambda out, a, z: F.when(z > a, F.concat(out, F.array(F.struct(a.alias("a"), z.alias("z"))))).otherwise(out)
        start = F.struct(c["start"].alias("at"), F.array().cast("array<struct<a:int,z:int>>").alias("out"))
        step = lambda s, b: F.struct(F.greatest(s["at"], b["end"]).alias("at"), cut(s["out"], s["at"], b["start"]).alias("out"))
        free = F.aggregate(touching, start, step, lambda s: cut(s["out"], s["at"], c["end"]))
        return F.transform(
            free,
            lambda p: F.struct(p["a"].alias("start"), c["ord"].alias("ord"), p["z"].alias("end"), c["kind"].alias("kind"), F.substring(c["value"], p["a"] - c["start"] + 1, p["z"] - p["a"]).alias("value")),
        )

    return F.flatten(F.transform(candidates, pieces))


def reach(base: str) -> Column:
    """Blocks of the sorted spans, with the first start and the last end of each."""
    spans = blocks_of(F.col(base))
    last = lambda b: F.array_max(F.transform(b, lambda s: s["end"]))
    return F.when(F.size(base) > 0, F.transform(spans, lambda b: F.struct(F.get(b, 0)["start"].alias("from"), last(b).alias("to"), b.alias("spans")))).otherwise(
        F.array().cast(f"array<struct<from:int,to:int,spans:{SPANS}>>")
    )


STRETCHES = "array<struct<a:int,z:int>>"


def joined_up(out: Column, a: Column, z: Column) -> Column:
    """The stretches with one more that begins no earlier than the last: it is drawn into the last where the two meet."""
    last = F.get(out, F.size(out) - 1)
    one = lambda x, y: F.array(F.struct(x.cast("int").alias("a"), y.cast("int").alias("z")))
    meets = F.coalesce(last["z"] >= a, F.lit(False))
    return F.when(meets, F.concat(F.slice(out, 1, F.size(out) - 1), one(last["a"], F.greatest(last["z"], z)))).otherwise(F.concat(out, one(a, z)))


def hot_stretches(value: Column, c: CharClass) -> Column:
    """Stretches (a, z) of windows that overlap or meet and whose Shannon entropy reaches the class's bits.

    The window slides by one character: one count falls, one rises, and the sum of n log n
    changes by those two terms alone.
    """
    w, size = c.window, len(c.alphabet)
    nlogn = F.array(*(F.lit(n * math.log2(n) if n else 0.0) for n in range(w + 2)))
    at = F.transform(F.split(value, ""), lambda ch: F.instr(F.lit(c.alphabet), ch) - 1)
    none = F.array().cast(STRETCHES)

    def step(s: Column, k: Column) -> Column:
        new, old = F.get(s["at"], k), F.get(s["at"], k - w)
        gone = F.when(k >= w, old).otherwise(F.lit(-1))
        up, down = F.get(s["n"], new), F.get(s["n"], gone)
        moved = F.when(new == gone, F.lit(0.0)).otherwise(
            F.get(nlogn, up + 1) - F.get(nlogn, up) + F.coalesce(F.get(nlogn, down - 1) - F.get(nlogn, down), F.lit(0.0))
        )
        total = s["s"] + moved
        hot = (k >= w - 1) & (F.round(F.lit(math.log2(w)) - total / w, 9) >= c.bits)
        return F.struct(
            s["at"].alias("at"),
            F.transform(s["n"], lambda x, i: x + (i == new).cast("int") - (i == gone).cast("int")).alias("n"),
            total.alias("s"),
            F.when(hot, joined_up(s["out"], k - (w - 1), k + 1)).otherwise(s["out"]).alias("out"),
        )

    start = F.struct(at.alias("at"), F.array_repeat(F.lit(0), size).alias("n"), F.lit(0.0).alias("s"), none.alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.length(value) - 1), start, step, lambda s: s["out"])


def scanned(piece: Column) -> Column:
    """Spans of a piece (start, ord, end, kind, value): each class's runs in it, the hot stretches of these, those that meet drawn together."""

    def of_class(c: CharClass) -> Column:
        fit = lambda v: functools.reduce(Column.__and__, (v.rlike(x) for x in c.needs))
        runs = F.filter(matches(piece["value"], c.run, "entropy"), lambda r: fit(r["value"]))
        moved = lambda r: F.transform(hot_stretches(r["value"], c), lambda x: F.struct((r["start"] + x["a"]).alias("a"), (r["start"] + x["z"]).alias("z")))
        return F.flatten(F.transform(runs, moved))

    every = F.array_sort(F.concat(*(of_class(c) for c in CLASSES)))
    drawn = F.aggregate(every, F.array().cast(STRETCHES), lambda out, x: joined_up(out, x["a"], x["z"]))
    return F.transform(
        drawn,
        lambda x: F.struct(
            (piece["start"] + x["a"]).alias("start"), piece["ord"].alias("ord"), (piece["start"] + x["z"]).alias("end"), piece["kind"].alias("kind"),
            F.substring(piece["value"], x["a"] + 1, x["z"] - x["a"]).alias("value"),
        ),
    )


def scan(docs: DataFrame, text: str = "text", allowed: str = ALLOWED) -> DataFrame:
    """Add the array secret_spans of (start, ord, end, kind, value), in order, and n_assign, n_access, n_hex."""
    body, t = docs.withColumn("__tl_t", F.coalesce(F.col(text), F.lit(""))), F.col("__tl_t")
    base = body.withColumns(
        {
            "__tl_assign": F.filter(matches(t, ASSIGN, "assign"), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= ASSIGN_VALUE),
            "__tl_access": matches(t, ACCESS, "access"),
            "__tl_hex": matches(t, HEX, "hex"),
            "__tl_cand": F.filter(matches(t, CANDIDATE, "entropy"), lambda s: s["value"].rlike(PROMISING)),
        }
    ).withColumn("__tl_base", F.array_sort(F.concat("__tl_assign", "__tl_access", "__tl_hex")))
    free = F.filter(left_over("__tl_cand", "__tl_reach"), lambda s: (F.length(s["value"]) >= LEAST) & ~s["value"].rlike(allowed))
    return (
        base.withColumn("__tl_reach", F.when(F.size("__tl_cand") > 0, reach("__tl_base")))
        .withColumn("__tl_free", F.when(F.size("__tl_cand") > 0, free))
        .withColumn("__tl_hot", F.when(F.size("__tl_free") > 0, F.flatten(F.transform("__tl_free", scanned))))
        .withColumns(
            {
                "base_spans": F.col("__tl_base"),
                "secret_spans": F.when(F.size("__tl_hot") > 0, F.array_sort(F.concat("__tl_base", "__tl_hot"))).otherwise(F.col("__tl_base")),
                "n_assign": F.size("__tl_assign").cast("long"),
                "n_access": F.size("__tl_access").cast("long"),
                "n_hex": F.size("__tl_hex").cast("long"),
            }
        )
        .drop("__tl_t", "__tl_assign", "__tl_access", "__tl_hex", "__tl_cand", "__tl_base", "__tl_reach", "__tl_free", "__tl_hot")
    )


def joined(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The same documents with every span replaced by the mark and n_chars counted anew; no row goes."""
    columns, found = docs.columns, scan(docs)

    def step(a: Column, s: Column) -> Column:
        fresh = s["start"] >= a["at"]
        before = F.when(fresh, F.concat(F.substring(F.col("text"), a["at"] + 1, s["start"] - a["at"]), F.lit(mark))).otherwise("")
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["out"], before).alias("out"))

    clean = F.aggregate(
        "secret_spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        step,
        lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length(F.col("text")))),
    )
    out = found.withColumn("text", F.when(F.size("secret_spans") > 0, clean).otherwise(F.col("text")))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.size("secret_spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*columns)


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    from tallyline.session import table

    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined("base_spans"), 256).alias("base_sha256"), joined("secret_spans").alias("spans")
    )


def _spans_sql(kind: str, pattern: str, keep: str) -> str:
    p = pattern.replace("'", "''")
    return rf"""{kind}_m AS (SELECT doc_id, regexp_extract_all(txt, '{p}') AS h, string_split_regex(txt, '{p}') AS g FROM t WHERE regexp_matches(txt, '{p}')),
{kind}_s AS (SELECT doc_id, {KINDS.index(kind)} AS ord, '{kind}' AS kind, v,
    CAST(list_sum(list_transform(g[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s,
    length(v) AS n FROM (SELECT doc_id, g, h, i, h[i] AS v FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM {kind}_m)) WHERE {keep})"""


def _oracle() -> str:
    assign = ASSIGN.replace("'", "''")
    pieces = "SELECT doc_id, s, v FROM left_over WHERE NOT regexp_matches(v, '" + ALLOWED + "')"
    runs = " UNION ALL ".join(
        rf"""SELECT doc_id, s0, s0 + CAST(list_sum(list_transform(g[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s,
  '{c.name}' AS cls, h[i] AS v, {c.window} AS w, {c.bits} AS bits
  FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM (SELECT doc_id, s AS s0, regexp_extract_all(v, '{c.run}') AS h, string_split_regex(v, '{c.run}') AS g FROM piece WHERE regexp_matches(v, '{c.run}')))
  WHERE {" AND ".join(f"regexp_matches(h[i], '{x}')" for x in c.needs)}"""
        for c in CLASSES
    )
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS txt FROM documents),
{_spans_sql("assign", ASSIGN, f"length(regexp_extract(v, '{assign}', 2)) >= {ASSIGN_VALUE}")},
{_spans_sql("access", ACCESS, "true")},
{_spans_sql("hex", HEX, "true")},
{_spans_sql("entropy", CANDIDATE, "true")},
base AS (SELECT doc_id, kind, ord, s, s + n AS e FROM (SELECT * FROM assign_s UNION ALL SELECT * FROM access_s UNION ALL SELECT * FROM hex_s)),
near AS (SELECT c.doc_id, c.s AS cs, c.s + c.n AS ce, b.s AS bs, b.e AS be FROM entropy_s c JOIN base b ON b.doc_id = c.doc_id AND b.s < c.s + c.n AND c.s < b.e),
cuts AS (SELECT doc_id, cs, ce, greatest(cs, coalesce(max(be) OVER (PARTITION BY doc_id, cs ORDER BY bs, be ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), cs)) AS a, bs AS z FROM near
  UNION ALL SELECT doc_id, cs, ce, max(be), ce FROM near GROUP BY doc_id, cs, ce
  UNION ALL SELECT doc_id, s, s + n, s, s + n FROM entropy_s c WHERE NOT EXISTS (SELECT 1 FROM near WHERE near.doc_id = c.doc_id AND cs = c.s)),
left_over AS (SELECT cuts.doc_id, 3 AS ord, 'entropy' AS kind, substr(v, CAST(a - cs + 1 AS BIGINT), CAST(z - a AS BIGINT)) AS v, a AS s, z - a AS n
  FROM cuts JOIN entropy_s c ON c.doc_id = cuts.doc_id AND c.s = cs WHERE z - a >= {LEAST}),
piece AS ({pieces}),
run AS ({runs}),
win AS (SELECT doc_id, s0, s, cls, v, w, bits, unnest(range(0, length(v) - w + 1)) AS k FROM run),
ch AS (SELECT doc_id, s0, s, cls, w, bits, k, c, count(*) AS n FROM (SELECT doc_id, s0, s, cls, w, bits, k, unnest(string_split(substr(v, CAST(k + 1 AS BIGINT), w), '')) AS c FROM win) GROUP BY doc_id, s0, s, cls, w, bits, k, c),
ent AS (SELECT doc_id, s0, s, cls, w, bits, k, log2(w) - sum(n * log2(n)) / w AS h FROM ch GROUP BY doc_id, s0, s, cls, w, bits, k),
stretch AS (SELECT DISTINCT doc_id, s0, s + k AS a, s + k + w AS z FROM ent WHERE round(h, 9) >= bits),
steps AS (SELECT *, coalesce(max(z) OVER (PARTITION BY doc_id, s0 ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < a, true) AS fresh FROM stretch),
isles AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, s0 ORDER BY a, z) AS isle FROM steps),
hot AS (SELECT doc_id, 'entropy' AS kind, 3 AS ord, min(a) AS s, max(z) AS e FROM isles GROUP BY doc_id, s0, isle),
b AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
  count(*) FILTER (kind = 'hex') AS n_hex, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) AS txt FROM base GROUP BY doc_id),
a AS (SELECT doc_id, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) AS txt
  FROM (SELECT * FROM base UNION ALL SELECT doc_id, kind, ord, s, e FROM hot) GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(b.txt, '')) AS base_sha256, coalesce(a.txt, '') AS spans
FROM t LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id)
"""


ORACLE = _oracle()
