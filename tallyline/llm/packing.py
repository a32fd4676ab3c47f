"""Packing of documents into few sequences of bounded length, by linear grouping and best fit.

Lengths are whole numbers up to the capacity, so how many pieces there are of each length is a table
of bounded size however many pieces there are. The driver plans on that table alone:

1. pieces as long as a sequence have one of their own;
2. the large ones, longest first, are cut into groups of equal cardinality (of equal length where there
   are no more lengths than groups), and in a group all count as its longest; for these few sizes a linear programme over configurations (columns made as needed by
   a knapsack) says how many sequences hold which sizes;
3. actual lengths take the groups' places, so every sequence's true room is known;
4. what is left of the large ones (fewer than a sequence for each configuration) and all small ones,
   longest first, go where they fit best, many equal ones at a time.

The plan is a list of runs, each a stretch of equal pieces, by rank among those of their length, laid
into sequences in a row. Its size is bounded by the capacity and the groups, not by the pieces. Tasks
then look every piece up by its length and rank. Ranks are counted in the tasks that make the pieces
and summed over tasks, so no task sees all pieces of a length.

Defined results for odd rows: a null or empty text is the end id alone; repeated rows are rows like
others; a null doc_id is kept; an empty table gives an empty one; extra columns don't matter.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.llm.token_files import encoded, encoder

CAPACITY = 4096
#: Pieces of a capacity's this part or more are large; how many groups these are cut into (each is tried, the fewest sequences win).
LARGE = 8
#: Columns of a piece's rank: the task that made it, and how many of its length that had made before.
RANK = ("_chunk", "_nth")
GROUPS = (16, 64)


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, most_rounds: int = 3000) -> list[tuple[np.ndarray, int]]:
    """Whole numbers of sequences by configuration (how many pieces of each size), rounded down from the least of the linear programme."""
    m = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    amounts = demand / np.diag(basis)
    most = int(capacity // sizes.min())
    for _ in range(most_rounds):
        worth = np.linalg.solve(basis.T, np.ones(m))
        best, last = np.zeros(capacity + 1), []
        for _ in range(most):
            with_one = np.full((m, capacity + 1), -np.inf)
            for g, s in enumerate(sizes.tolist()):
                with_one[g, s:] = best[: capacity + 1 - s] + worth[g]
            chosen = with_one.argmax(0)
            value = np.maximum(with_one[chosen, np.arange(capacity + 1)], best)
            last.append(np.where(value > best, chosen, -1))
            if (value == best).all():
                break
            best = value
        if best[capacity] <= 1 + 1e-9:
            break
        column, room = np.zeros(m), capacity
        for chosen in reversed(last):
            if chosen[room] >= 0:
                column[chosen[room]] += 1
                room -= int(sizes[chosen[room]])
        step = np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, amounts / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        amounts = amounts - ratio[out] * step
        amounts[out] = ratio[out]
        basis[:, out] = column
    return [(basis[:, j].round().astype(int), int(np.floor(x + 1e-7))) for j, x in enumerate(amounts) if x >= 1 - 1e-7]


class Plan:
    """Where pieces go: sequences so far, those with room by that room, and the runs laid down."""

    def __init__(self, counts: dict[int, int], capacity: int, groups: int):
        self.capacity, self.sequences = capacity, 0
        self.rooms: dict[int, list[tuple[int, int]]] = {}
        self.order: list[int] = []
        #: length, first rank, pieces, first sequence, pieces in each sequence, offset of the first in its sequence
        self.runs: list[tuple[int, int, int, int, int, int]] = []
        if n := counts.get(capacity):
            self.lay(capacity, 0, n, self.opened(n), 1, 0)
        large = sorted((s for s in counts if capacity // LARGE <= s < capacity), reverse=True)
        rest = [(s, 0, n) for s, n in counts.items() if s < capacity // LARGE]
        if large:
            rest += self.grouped(np.array(large), np.array([counts[s] for s in large]), groups)
        for s, rank, n in sorted(rest, reverse=True):
            self.best_fit(s, rank, n)

    def opened(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def lay(self, length: int, rank: int, n: int, sequence: int, each: int, offset: int) -> None:
        self.runs.append((length, rank, n, sequence, each, offset))

    def has_room(self, room: int, sequence: int, n: int) -> None:
        if room and n:
            if room not in self.rooms:
                self.rooms[room] = []
                insort(self.order, room)
            self.rooms[room].append((sequence, n))

    def grouped(self, lengths: np.ndarray, counts: np.ndarray, groups: int) -> list[tuple[int, int, int]]:
        """Lay configurations of grouped sizes with actual lengths in them; what is left as (length, rank, pieces)."""
        ends = np.cumsum(counts)
        total = int(ends[-1])
        starts = list(range(0, total, -(-total // groups))) if len(lengths) > groups else [0, *ends[:-1].tolist()]
        sizes = [int(lengths[np.searchsorted(ends, x, "right")]) for x in starts]
        keep = [k for k in range(len(starts)) if k == 0 or sizes[k] != sizes[k - 1]]
        starts, sizes = [starts[k] for k in keep], np.array([sizes[k] for k in keep])
        stops = [*starts[1:], total]
        at = list(starts)
        for column, n in configurations(sizes, np.diff([*starts, total]).astype(float), self.capacity):
            held = np.flatnonzero(column).tolist()
            places = np.repeat(held, column[held]).tolist()
            n = min(n, *((stops[g] - at[g]) // int(column[g]) for g in held))
            if n > 0:
                self.substituted(places, at, n, lengths, ends)
        out = []
        for a, b in zip(at, stops, strict=True):
            out += self.by_length(a, b, lengths, ends)
        return out

    @staticmethod
    def by_length(a: int, b: int, lengths: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
        """The ranks a to b of all large pieces as (length, rank among its length, pieces)."""
        out = []
        while a < b:
            k = int(np.searchsorted(ends, a, "right"))
            n = min(b, int(ends[k])) - a
            out.append((int(lengths[k]), a - (int(ends[k - 1]) if k else 0), n))
            a += n
        return out

    def substituted(self, places: list[int], at: list[int], n: int, lengths: np.ndarray, ends: np.ndarray) -> None:
        """Lay n sequences of one configuration: each of its places takes the next n pieces of its group."""
        stretches = []
        for g in places:
            stretches.append(self.by_length(at[g], at[g] + n, lengths, ends))
            at[g] += n
        edges = sorted({0, n, *(int(x) for s in stretches for x in np.cumsum([c for _, _, c in s]))})
        first, heads = self.opened(n), [0] * len(stretches)
        done = [0] * len(stretches)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            offset = 0
            for j, s in enumerate(stretches):
                while done[j] + s[heads[j]][2] <= a:
                    done[j] += s[heads[j]][2]
                    heads[j] += 1
                length, rank, _ = s[heads[j]]
                self.lay(length, rank + a - done[j], b - a, first + a, 1, offset)
                offset += length
            self.has_room(self.capacity - offset, first + a, b - a)

    def best_fit(self, s: int, rank: int, n: int) -> None:
        """Equal pieces into the sequences with the least room that holds them, then into new ones.

        A sequence that takes one has the least room again, so it goes on until it is full.
        """
        while n:
            k = bisect_left(self.order, s)
            if k < len(self.order):
                room = self.order[k]
                held = self.rooms[room]
                sequence, m = held.pop()
                if not held:
                    del self.rooms[room], self.order[k]
            else:
                room, m = self.capacity, -(-n // (self.capacity // s))
                sequence = self.opened(m)
            each = room // s
            whole = min(m, n // each)
            if whole:
                self.lay(s, rank, whole * each, sequence, each, self.capacity - room)
                self.has_room(room - each * s, sequence, whole)
                rank, n = rank + whole * each, n - whole * each
            if whole < m:
                part = min(n, each)
                if part:
                    self.lay(s, rank, part, sequence + whole, part, self.capacity - room)
                    rank, n, whole = rank + part, n - part, whole + 1
                    self.has_room(room - part * s, sequence + whole - 1, 1)
                self.has_room(room, sequence + whole, m - whole)


def planned(counts: dict[int, int], capacity: int = CAPACITY, groups: tuple[int, ...] = GROUPS) -> Plan:
    """The plan with the fewest sequences for so many pieces of each length."""
    return min((Plan(counts, capacity, g) for g in groups), key=lambda p: p.sequences)


class Ranks:
    """Counts the pieces of each length in a task: a piece is the task's number and how many of its length came before it."""

    def __init__(self, capacity: int):
        from pyspark import TaskContext

        self.part, self.seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)

    def added(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        length = batch.column("length").to_numpy()
        order = np.argsort(length, kind="stable")
        counts = np.bincount(length, minlength=len(self.seen))
        nth = np.empty(len(length), np.int64)
        nth[order] = np.arange(len(length)) - (np.cumsum(counts) - counts)[length[order]]
        nth += self.seen[length]
        self.seen += counts
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(nth), self.part)), pa.array(nth)], names=[*batch.schema.names, *RANK])


def cut_batches(tokenizer: str, capacity: int, full: bool, ranked: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ranks = encoder(tokenizer), Ranks(capacity)
        for batch in batches:
            for doc_ids, sizes, ids in encoded(batch, words):
                sizes = sizes.astype(np.int64)
                parts = -(-sizes // capacity)
                of = np.repeat(np.arange(len(sizes)), parts)
                part = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
                start = part * capacity
                length = np.minimum(sizes[of] - start, capacity)
                at = np.concatenate([np.zeros(1, np.int64), np.cumsum(length)])
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                rows = {
                    "doc_id": pa.array(doc_ids, pa.int64()).take(pa.array(of)), "piece": pa.array(part, pa.int32()), "start": pa.array(start, pa.int64()),
                    "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
                }
                if full:
                    rows["ids"] = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
                out = pa.RecordBatch.from_arrays(list(rows.values()), names=list(rows))
                yield ranks.added(out) if ranked else out

    return run


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, full: bool = True, ranked: bool = False) -> DataFrame:
    """doc_id, piece, start, length and checksum of the ids of every document, cut where it exceeds the capacity; full: the ids too.

    ranked: with what placed() counts otherwise, so that it needs no pass of its own for that.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * full + f", {RANK[0]} long, {RANK[1]} long" * ranked
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut_batches(tokenizer, capacity, full, ranked), schema)


def number_batches(capacity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = Ranks(capacity)
        for batch in batches:
            yield ranks.added(batch)

    return run


def placed(rows: DataFrame, capacity: int = CAPACITY, groups: tuple[int, ...] = GROUPS) -> DataFrame:
    """Rows with a length of 1 to the capacity get sequence_id and offset; columns of these names are replaced, and those of RANK are read as ranks and go."""
    from tallyline.session import written

    rows = rows.drop("sequence_id", "offset", "_base")
    ranked = rows
    if not set(RANK) <= set(rows.columns):
        rows = rows.drop(*RANK)
        ranked = rows.mapInArrow(number_batches(capacity), T.StructType([*rows.schema.fields, *(T.StructField(n, T.LongType()) for n in RANK)]))
    rows, kept = rows.drop(*RANK), written(ranked, "pieces")
    counts = written(kept.groupBy("length", "_chunk").agg(F.count(F.lit(1)).alias("_n")), "counts")
    plan = planned({r["length"]: r["_n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("_n")).collect()}, capacity, groups)  # at most a row for each length
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("length", "_chunk", F.coalesce(before, F.lit(0)).alias("_base"))
    runs = np.array(sorted(plan.runs), np.int64).reshape(-1, 6)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (runs[:, 0] << 48) | runs[:, 1]
        for batch in batches:
            rank = batch.column("_base").to_numpy() + batch.column("_nth").to_numpy()
            length = batch.column("length").to_numpy()
            at = np.searchsorted(keys, (length << 48) | rank, "right") - 1
            within = rank - runs[at, 1]
            each = runs[at, 4]
            new = {"sequence_id": pa.array(runs[at, 3] + within // each), "offset": pa.array(runs[at, 5] + within % each * length)}
            batch = batch.drop_columns(["_chunk", "_nth", "_base"])
            yield pa.RecordBatch.from_arrays([*batch.columns, *new.values()], names=[*batch.schema.names, *new])

    fields = [*rows.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    return kept.join(bases.hint("merge"), ["length", "_chunk"]).select(*rows.columns, "_chunk", "_nth", "_base").mapInArrow(place, T.StructType(fields))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and the ids of each sequence, its pieces in order of their offsets."""
    held = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return held.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))


def op12_best_fit_packing(spark, sf_dir: str, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    from tallyline.session import batches_of_texts, let_workers_import, table

    let_workers_import(spark)
    batches_of_texts(spark)
    return placed(pieces(table(spark, sf_dir, "documents"), tokenizer, full=False, ranked=True))
