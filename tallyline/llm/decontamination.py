"""Benchmark decontamination: normalised word windows of test items, looked up in whole documents.

The set of window hashes is broadcast, up to a bound. A larger benchmark is cut by hash into parts
of that size: the first part is looked up as the documents pass, each further part in a job of its
own whose hits alone are written and joined back, so that a worker holds one part at a time. A hit
on a hash is compared word by word, all occurrences of a window in a block at once.

Defined results for odd rows: a null or empty text (or item) has no words and no windows; an item
of fewer words than a window is one window; repeated items share their windows and all count;
windows of an item with a null item_id are hits as others are, but hit_items doesn't name it;
repeated documents are judged one by one, with equal results; columns n_words, n_hit, hit_items,
hit_spans and contaminated of the caller are replaced, nulls in other columns and all other extra
columns pass through; an empty benchmark hits nothing and empty documents give an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.blocks import Hasher, cuts, flat, runs, texts, with_column
from tallyline.session import let_workers_import, written

WINDOW = 10
#: Windows that are broadcast at once; about 60 MB in a worker.
MAX_WINDOWS = 200_000

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words are runs of digits, letters a-z and all that isn't ASCII.
IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[128:] = True
#: Fixed odd multiplier of the windows' polynomial hash.
NEXT = np.uint64(0xD6E8FEB86659FD93)


class Words:
    """Words of a block of texts: normalised bytes, where words start and end, their hashes, the words before each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.bytes = LOWER[data[offsets[0] : offsets[-1]]]
        inside = IN_WORD[self.bytes]
        self.starts, self.ends = runs(inside, offsets)
        self.before = np.searchsorted(self.starts, offsets - offsets[0])
        self.hasher = Hasher(self.bytes, inside)
        self.hashes = self.hasher.of(self.starts, self.ends)

    def windows(self, size: int) -> np.ndarray:
        """Hash of the words from each place on; windows that run over the end of a text are among them."""
        n = len(self.hashes) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        h = self.hashes[:n].copy()
        for k in range(1, size):
            h = h * NEXT + self.hashes[k : n + k]
        return h

    def are(self, at: np.ndarray, words: list[bytes]) -> np.ndarray:
        """Whether these are the words from each place on."""
        same = np.ones(len(at), bool)
        for k, word in enumerate(words):
            same &= self.ends[at + k] - self.starts[at + k] == len(word)
        for k, word in enumerate(words):
            some = np.flatnonzero(same)
            for c in range(0, len(some), 10_000):
                part = some[c : c + 10_000]
                there = self.bytes[self.starts[at[part] + k][:, None] + np.arange(len(word))]
                same[part] = (there == np.frombuffer(word, np.uint8)).all(1)
        return same

    def text(self, at: int, size: int) -> bytes:
        return b" ".join(self.bytes[s:e].tobytes() for s, e in zip(self.starts[at : at + size], self.ends[at : at + size], strict=True))


def item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = flat(texts(batch))
        ids = batch.column("item_id").to_pylist()
        for i, j in cuts(offsets):
            w = Words(data, offsets[i : j + 1])
            rows = []
            for k in range(j - i):
                a, b = int(w.before[k]), int(w.before[k + 1])
                size = min(WINDOW, b - a)
                h = w.windows(size) if size else []
                rows += [(int(h[p].astype(np.int64)), size, w.text(p, size), ids[i + k]) for p in range(a, b - size + 1) if size]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.string()))], names=["hash", "size", "words", "item"]
            )


class Index:
    """Benchmark windows by size: sorted hashes behind a small bitmap, with the words and items of each."""

    def __init__(self, rows: list[tuple[int, int, bytes, list[str]]]):
        self.words, self.items, self.sizes = [], [], {}
        for size in sorted({r[1] for r in rows}):
            these = sorted((r[0] & (2**64 - 1), r[2], r[3]) for r in rows if r[1] == size)
            hashes = np.array([r[0] for r in these], np.uint64)
            bitmap = np.zeros(1 << 20, bool)
            bitmap[hashes >> np.uint64(44)] = True
            self.sizes[size] = hashes, bitmap, len(self.words)
            self.words += [r[1] for r in these]
            self.items += [r[2] for r in these]

    def hits(self, w: Words) -> Iterator[tuple[np.ndarray, int, int]]:
        """(first words, words, number of the window) of each window that occurs in a block."""
        for size, (hashes, bitmap, base) in self.sizes.items():
            h = w.windows(size)
            at = np.flatnonzero(bitmap[h >> np.uint64(44)])
            low = np.searchsorted(hashes, h[at])
            found = hashes[np.minimum(low, len(hashes) - 1)] == h[at]
            at, low = at[found], low[found]
            whole = at + size <= w.before[np.searchsorted(w.before, at, "right")]
            at, low = at[whole], low[whole]
            order = np.argsort(low, kind="stable")
            at, low = at[order], low[order]
            cut = np.append(np.flatnonzero(np.append(True, low[1:] != low[:-1])) if len(low) else [], len(low)).astype(int)
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                k = int(low[a])
                while k < len(hashes) and hashes[k] == hashes[low[a]]:  # windows that share a hash
                    same = w.are(at[a:b], self.words[base + k].split(b" "))
                    if same.any():
                        yield at[a:b][same], size, base + k
                    k += 1


def finder(index) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds n_words, the stretches of words that windows cover, and the items of these windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.value
        for batch in batches:
            data, offsets = flat(texts(batch))
            n = batch.num_rows
            counts = np.zeros(n, np.int64)
            starts, ends, owners = [], [], []
            items: dict[int, set[str]] = {}
            for i, j in cuts(offsets):
                w = Words(data, offsets[i : j + 1])
                counts[i:j] = np.diff(w.before)
                first, last = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for at, size, window in known.hits(w):
                    first.append(at)
                    last.append(at + size)
                    for k in np.unique(np.searchsorted(w.before, at, "right") - 1).tolist():
                        items.setdefault(i + k, set()).update(known.items[window])
                first, last = np.concatenate(first), np.concatenate(last)
                order = np.argsort(first, kind="stable")
                first, reach = first[order], np.maximum.accumulate(last[order])
                # No window goes over the end of its text, so stretches of different texts don't meet; those that touch are one.
                text = np.searchsorted(w.before, first, "right") - 1
                new = np.flatnonzero(np.append(True, (first[1:] > reach[:-1]) | (text[1:] != text[:-1]))) if len(first) else np.zeros(0, np.int64)
                starts.append(first[new] - w.before[text[new]])
                ends.append(reach[np.append(new[1:] - 1, len(first) - 1)] - w.before[text[new]] if len(new) else np.zeros(0, np.int64))
                owners.append(i + text[new])
            bounds = pa.array(np.searchsorted(np.concatenate([*owners, [n]]), np.arange(n + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(bounds, pa.array(np.concatenate([*x, []]).astype(np.int32))) for x in (starts, ends)]
            named = pa.array([sorted(items.get(k, ())) for k in range(n)], pa.list_(pa.string()))
            yield with_column(batch, n_words=pa.array(counts), __tl_starts=lists[0], __tl_ends=lists[1], hit_items=named)

    return run


def covered(spans: Column) -> Column:
    """Words in any of the spans, which are in order."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    step = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(a["to"], x["s"]))).alias("n"), F.greatest(a["to"], x["e"]).alias("to"))
    return F.aggregate(spans, start, step, lambda a: a["n"].cast("long"))


def find(docs: DataFrame, benchmark: DataFrame, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """Add n_words, n_hit, hit_items (sorted strings), contaminated, and hit_spans of (s, e) in words."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(item_windows, "hash bigint, size int, words binary, item string")
    # A part holds so many windows of items; one that very many items share is dealt over the parts too.
    windows = written(items.distinct(), "windows")
    parts = max(1, -(-windows.count() // max_windows))

    def looked_up(rows: DataFrame, part: int) -> DataFrame:
        own = windows.where(F.pmod(F.xxhash64("hash", "item"), F.lit(parts)) == part)
        of = own.groupBy("hash", "size", "words").agg(F.sort_array(F.collect_set("item")).alias("items")).collect()
        index = spark.sparkContext.broadcast(Index([(r["hash"], r["size"], bytes(r["words"]), r["items"]) for r in of]))
        ints, none = F.array().cast("array<int>"), F.array().cast("array<string>")
        schema = rows.withColumns({"n_words": F.lit(0).cast("long"), "__tl_starts": ints, "__tl_ends": ints, "hit_items": none}).schema
        return rows.withColumns({"n_words": F.lit(0).cast("long"), "__tl_starts": ints, "__tl_ends": ints, "hit_items": none}).mapInArrow(finder(index), schema)

    spans = F.zip_with("__tl_starts", "__tl_ends", lambda s, e: F.struct(s.alias("s"), e.alias("e")))
    out = looked_up(docs.drop("n_words", "n_hit", "hit_items", "hit_spans", "contaminated"), 0).withColumn("hit_spans", spans).drop("__tl_starts", "__tl_ends")
    key = F.xxhash64(*(["doc_id"] if "doc_id" in docs.columns else []), "text")
    if parts > 1:
        more = []
        for part in range(1, parts):
            hit = looked_up(docs.select(key.alias("__tl_hit"), "text"), part).where(F.size("__tl_starts") > 0)
            more.append(written(hit.select("__tl_hit", spans.alias("__tl_spans"), F.col("hit_items").alias("__tl_items")), "hits"))
        # Rows with one key have one text and so the same hits.
        each = reduce(DataFrame.union, more).distinct().groupBy("__tl_hit")
        hits = each.agg(F.flatten(F.collect_list("__tl_spans")).alias("__tl_spans"), F.array_distinct(F.flatten(F.collect_list("__tl_items"))).alias("__tl_items"))
        out = out.withColumn("__tl_key", key).join(hits, F.col("__tl_key") == F.col("__tl_hit"), "left")
        none = F.array()
        out = out.withColumns(
            {
                "hit_spans": F.array_sort(F.array_union("hit_spans", F.coalesce("__tl_spans", none.cast("array<struct<s:int,e:int>>")))),
                "hit_items": F.array_sort(F.array_union("hit_items", F.coalesce("__tl_items", none.cast("array<string>")))),
            }
        ).drop("__tl_key", "__tl_hit", "__tl_spans", "__tl_items")
    return out.withColumn("n_hit", covered(F.col("hit_spans"))).withColumn("contaminated", F.col("n_hit") > 0)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no benchmark window occurs."""
    return find(docs, benchmark).where(~F.col("contaminated")).select(*docs.columns)


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    from tallyline.session import table

    let_workers_import(spark)
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


#: Hit words are those of any window that occurs: each window's words are laid out and counted once.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, k)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS xs
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(xs, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
