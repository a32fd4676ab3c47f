"""Periodic runs of words: stretches that repeat with a period, found by uniting suffixes by falling common prefix.

A run is a stretch of words whose smallest period is q, of max(LEAST, EXPONENT * q) words at least, that
no neighbouring word extends with period q. Of a run that begins at i the suffixes at i and i + q agree in
exactly its length less q words. So when the suffixes of a text are united by decreasing common prefix l
(Kruskal's order over neighbours in the suffix array), the run's two suffixes come into one class at
l = length - q, and no suffix of the class stands between them. Each union merges the smaller class's
ordered positions into the larger's, and every two that become neighbours at a distance d with
(EXPONENT - 1) * d <= l seed a run, which an exact check of its ends and smallest period confirms.

Texts of a block are handled in arrays together: words to numbers, suffix array by doubling with the ranks
of each round kept, common prefixes by descent over these. Texts in which no shortest such prefix comes twice
have no runs and are set aside first by hashes; all else compares the words themselves.

Defined results for odd rows: a null or empty text, or one of white space, has no words and no runs; repeated
rows are rows like others; an empty table gives an empty one; extra columns pass through, those of the names
that are added are replaced; a null doc_id keeps its text as it is where texts are changed by their id.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallyline.llm.blocks import Hasher, cuts, flat, runs, texts, with_column

LEAST, EXPONENT = 6, 4
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
Runs = list[tuple[int, int, int]]


def shortest_prefix(least: int, exponent: int) -> int:
    """Words in which the two suffixes of any run agree at least."""
    return min(max(least, exponent * q) - q for q in range(1, least + 1))


def suffixes(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of texts in a row whose words have numbers of their own, and the ranks after 1, 2, 4, ... words.

    ends: where each position's text ends. Rounds go on while suffixes are alike, over these alone.
    """
    n = len(words)
    order = np.argsort(words, kind="stable")
    rank = np.empty(n, np.int64)
    fresh = np.concatenate([[True], np.diff(words[order]) != 0])
    rank[order] = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    levels, h = [rank.copy()], 1
    slots = np.arange(n)
    while True:
        alike = np.zeros(len(slots), bool)
        same = rank[order[slots[1:]]] == rank[order[slots[:-1]]]
        alike[1:] |= same
        alike[:-1] |= same
        slots = slots[alike]
        if not len(slots):
            return order, levels
        at = order[slots]
        after = at + h
        inside = after < ends[at]
        second = np.where(inside, rank[np.where(inside, after, 0)] + 1, 0)
        key = rank[at] * (n + 1) + second
        turn = np.argsort(key, kind="stable")
        at, key = at[turn], key[turn]
        order[slots] = at
        fresh = np.concatenate([[True], np.diff(key) != 0])
        rank[at] = slots[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        levels.append(rank.copy())
        h *= 2


def common_prefixes(order: np.ndarray, levels: list[np.ndarray], ends: np.ndarray) -> np.ndarray:
    """Words in which each suffix agrees with the next one in order."""
    a, b = order[:-1], order[1:]
    done = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + done, b + done
        inside = (x < ends[a]) & (y < ends[b])
        same = inside & (levels[k][np.where(inside, x, 0)] == levels[k][np.where(inside, y, 0)])
        done += same << k
    return done


def near_only(order: np.ndarray, prefix: np.ndarray, shortest: int, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes that may be of a run's class between its two, and their common prefixes.

    Such a one has another with the same first words no farther off than its longest common prefix / (exponent - 1).
    """
    n = len(order)
    linked = np.concatenate([[False], prefix >= shortest, [False]])
    best = np.maximum(np.concatenate([[0], prefix]), np.concatenate([prefix, [0]]))
    group = np.cumsum(~linked[:-1])
    turn = np.lexsort((order, group))
    apart = np.where(np.diff(group[turn]) == 0, np.diff(order[turn]), 1 << 60)
    least = np.minimum(np.concatenate([[1 << 60], apart]), np.concatenate([apart, [1 << 60]]))
    near = np.empty(n, np.int64)
    near[turn] = least
    kept = np.flatnonzero((linked[:-1] | linked[1:]) & (near * (exponent - 1) <= best))
    if len(kept) < 2:
        return order[:0], prefix[:0]
    return order[kept], np.minimum.reduceat(prefix[: kept[-1]], kept[:-1])


def seeds(order: np.ndarray, prefix: np.ndarray, shortest: int, exponent: int) -> list[tuple[int, int, int]]:
    """Positions a < b that become neighbours in a class when it is united at l words, near enough for a run: (a, b, l)."""
    links = np.flatnonzero(prefix >= shortest)
    links = links[np.argsort(-prefix[links], kind="stable")]
    parent = list(range(len(order)))
    classes: list[list[int] | None] = [[p] for p in order.tolist()]
    found = []
    for t, most in zip(links.tolist(), prefix[links].tolist(), strict=True):
        x, y = t, t + 1
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        large, small = classes[x], classes[y]
        if len(large) < len(small):
            x, y, large, small = y, x, small, large
        parent[y], classes[y] = x, None
        reach = most // (exponent - 1)
        for p in small:
            k = bisect_left(large, p)
            if k and p - large[k - 1] <= reach:
                found.append((large[k - 1], p, most))
            if k < len(large) and large[k] - p <= reach:
                found.append((p, large[k], most))
            large.insert(k, p)
    return found


def primes(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return [*out, n] if n > 1 else out


def confirmed(found: list[tuple[int, int, int]], words: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int, exponent: int) -> dict[int, Runs]:
    """The seeds that are whole runs, by the text's start: ends that can't be extended, and no smaller period."""
    out: dict[int, Runs] = {}
    for a, b, most in dict.fromkeys(found):
        q, first, last = b - a, int(starts[a]), int(ends[a])
        length = most + q
        if length < max(least, exponent * q) or (a > first and words[a - 1] == words[b - 1]):
            continue
        if b + most > last or (b + most < last and words[a + most] == words[b + most]):
            continue
        if any((words[a : b + most - q // p] == words[a + q // p : b + most]).all() for p in primes(q)):
            continue
        out.setdefault(first, []).append((a - first, length, q))
    return out


def numbered(data: np.ndarray, begins: np.ndarray, stops: np.ndarray, of: np.ndarray) -> np.ndarray:
    """A number for each word, the same for equal words of one text alone."""
    seen: dict[tuple[int, bytes], int] = {}
    raw = data.tobytes()
    keys = zip(of.tolist(), (raw[a:b] for a, b in zip(begins.tolist(), stops.tolist(), strict=True)), strict=True)
    return np.fromiter((seen.setdefault(k, len(seen)) for k in keys), np.int64, len(of))


def repeating(hashes: np.ndarray, counts: np.ndarray, width: int) -> np.ndarray:
    """Which texts have a window of this many words twice, by hashes of the words in a row: never too few."""
    if len(hashes) < width:
        return np.zeros(len(counts), bool)
    of = np.repeat(np.arange(len(counts)), counts)
    window = np.zeros(len(hashes) - width + 1, np.uint64)
    for k in range(width):
        window = (window ^ hashes[k : len(window) + k]) * np.uint64(0x9E3779B97F4A7C15)
        window ^= window >> np.uint64(29)
    whole = of[: len(window)] == of[width - 1 :]
    of, window = of[: len(window)][whole], window[whole]
    key = np.sort((window & ~np.uint64(0xFFFFF)) | (of & 0xFFFFF).astype(np.uint64))
    twice = key[1:][key[1:] == key[:-1]]
    out = np.zeros(len(counts), bool)
    low = np.unique((twice & np.uint64(0xFFFFF)).astype(np.int64))
    if len(counts) <= 1 << 20:
        out[low] = True
    else:
        out[np.isin(np.arange(len(counts)) & 0xFFFFF, low)] = True
    return out


def found_runs(words: np.ndarray, counts: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> list[Runs]:
    """Runs of each of the texts in a row, by start and period; equal numbers stand for equal words of one text, and no number is in two texts."""
    if not len(words):
        return [[] for _ in counts]
    stops = np.cumsum(counts)
    starts, ends = np.repeat(stops - counts, counts), np.repeat(stops, counts)
    order, levels = suffixes(words, ends)
    shortest = shortest_prefix(least, exponent)
    kept, prefix = near_only(order, common_prefixes(order, levels, ends), shortest, exponent)
    found = confirmed(seeds(kept, prefix, shortest, exponent), words, starts, ends, least, exponent)
    return [sorted(found.get(s, []), key=lambda r: (r[0], r[2])) if c else [] for s, c in zip((stops - counts).tolist(), counts.tolist(), strict=True)]


def dropped(run_list: Runs, n: int) -> np.ndarray:
    """Words that some run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, q in run_list:
        edge[start + q] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) > 0


def tail(n: int, doc_id: int | None) -> np.ndarray | None:
    """For one text in ten by its id, the words' places after its end is made periodic; else None."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % p
    return places


class Block:
    """Texts of a block in UTF-8: their words, changed by change(n, doc_id) where it gives places, their runs and what is kept."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, doc_ids: list[int | None], change: Callable | None, least: int, exponent: int):
        self.data = data[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        begins, stops = runs(~SPACE[self.data], offsets)
        first = np.searchsorted(begins, offsets)
        self.counts = np.diff(first)
        changed = {}
        if change:
            for k, n in enumerate(self.counts.tolist()):
                if (places := change(n, doc_ids[k])) is not None:
                    changed[k] = places
        if changed:
            at = np.arange(len(begins))
            for k, places in changed.items():
                at[first[k] : first[k + 1]] = first[k] + places
            begins, stops = begins[at], stops[at]
        self.begins, self.stops, self.first = begins, stops, first
        hashes = Hasher(self.data).of(begins, stops) if len(begins) else np.zeros(0, np.uint64)
        some = repeating(hashes, self.counts, shortest_prefix(least, exponent))
        self.runs: list[Runs] = [[] for _ in self.counts]
        if some.any():
            which = np.flatnonzero(some)
            mask = np.repeat(some, self.counts)
            counts = self.counts[which]
            words = numbered(self.data, begins[mask], stops[mask], np.repeat(np.arange(len(which)), counts))
            for k, r in zip(which.tolist(), found_runs(words, counts, least, exponent), strict=True):
                self.runs[k] = r
        self.own = {k for k, r in enumerate(self.runs) if r} | set(changed)
        self.raw = self.data.tobytes()

    def collapsed(self) -> Iterator[bytes]:
        """Each text's kept words joined by one space; texts as they were are copied whole."""
        inside = np.zeros(len(self.data), bool)
        plain = np.ones(len(self.counts), bool)
        plain[list(self.own)] = False
        mask = np.repeat(plain, self.counts)
        edge = np.zeros(len(self.data) + 1, np.int8)
        edge[self.begins[mask]] += 1
        edge[self.stops[mask]] -= 1
        inside = np.cumsum(edge[:-1], dtype=np.int8) > 0
        last = np.zeros(len(mask), bool)
        last[self.first[1:][self.counts > 0] - 1] = True
        spaces = self.stops[mask & ~last]
        out = self.data.copy()
        out[spaces] = 32
        inside[spaces] = True
        done = np.concatenate([[0], np.cumsum(inside)])
        out = out[inside].tobytes()
        begins, stops = self.begins, self.stops
        for k, n in enumerate(self.counts.tolist()):
            a = int(self.first[k])
            if not n:
                yield b""
            elif plain[k]:
                yield out[int(done[begins[a]]) : int(done[stops[a + n - 1]])]
            else:
                kept = a + np.flatnonzero(~dropped(self.runs[k], n))
                yield b" ".join([self.raw[x:y] for x, y in zip(begins[kept].tolist(), stops[kept].tolist(), strict=True)])


DIGESTS = {
    **dict.fromkeys(("n_runs", "start", "length", "period", "exponent_milli"), T.LongType()), "runs_sha256": T.StringType(), "collapsed_sha256": T.StringType(),
}
WHOLE = {"runs": T.ArrayType(RUN), "collapsed": T.StringType()}


def detect_batches(full: bool, change: Callable | None, least: int, exponent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def whole(block: Block) -> Iterator[tuple]:
        for r, text in zip(block.runs, block.collapsed(), strict=True):
            yield [dict(zip(("start", "length", "period"), x, strict=True)) for x in r], text.decode()

    def digests(block: Block) -> Iterator[tuple]:
        for r, text in zip(block.runs, block.collapsed(), strict=True):
            start, length, q = max(r, key=lambda x: (x[1], -x[0], -x[2])) if r else (None, None, None)
            listed = "".join(f"{a},{b},{c}\n" for a, b, c in r)
            yield len(r), start, length, q, 1000 * length // q if r else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new = WHOLE if full else DIGESTS
        run_kind = pa.struct([(n, pa.int64()) for n in RUN.names])
        kinds = [pa.list_(run_kind), pa.string()] if full else [pa.int64() if isinstance(t, T.LongType) else pa.string() for t in DIGESTS.values()]
        for batch in batches:
            data, offsets = flat(texts(batch))
            doc_ids = batch.column("doc_id").to_pylist()
            rows = []
            for i, j in cuts(offsets):
                rows += (whole if full else digests)(Block(data, offsets[i : j + 1], doc_ids[i:j], change, least, exponent))
            columns = zip(*rows, strict=True) if rows else [[]] * len(new)
            yield with_column(batch.drop_columns(["text"]), **{n: pa.array(list(c), k) for n, c, k in zip(new, columns, kinds, strict=True)})

    return run


def detected(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT, full: bool = True, change: Callable[[int, int | None], np.ndarray | None] | None = None) -> DataFrame:
    """Documents with their runs and the text without its repetitions (words joined by one space), in place of text.

    full: the runs and texts themselves; else n_runs, the longest run and digests. change(n, doc_id) may give
    the places of the words to read in place of a text's own, or None.
    """
    if least < 2 or exponent < 2:
        raise ValueError("a run has two words and two periods at least")
    new = WHOLE if full else DIGESTS
    docs = docs.drop(*new)
    fields = [f for f in docs.schema.fields if f.name != "text"]
    return docs.mapInArrow(detect_batches(full, change, least, exponent), T.StructType([*fields, *(T.StructField(n, t) for n, t in new.items())]))


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    from tallyline.session import let_workers_import, table

    let_workers_import(spark)
    return detected(table(spark, sf_dir, "documents").select("doc_id", "text"), full=False, change=tail)
