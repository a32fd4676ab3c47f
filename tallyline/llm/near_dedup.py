"""MinHash near-dedup: a chosen-path set similarity join, confirmed on full sets.

Documents with equal sets are one class. Every class starts at the root of each of several
independent trees and goes to the child that two of its minwise tokens name. Small nodes are
compared pair by pair by sketches. A large node first reads, token by token, the value that most of
its classes have: such tokens say nothing there, so each class goes on by the first FAN tokens, in
an order of the node's own, in which it differs from the rest. A child has less than about half of
its node's classes, and branching goes on until every node is small. Pairs that differ from the
rest too little to meet further down meet at the node's pivots, the classes that agree most with
it: all classes of a large node are compared with these, in blocks. So a node's work grows with its
classes, and nothing depends on how many there are. Nodes that hold the same classes count once.

Recall. A pair of similarity s shares a tree's first child with probability s^2, and a large node's
with 1 - (1 - s)^FAN where the node's classes have little in common: twelve trees miss about one
pair in 80,000 at 0.8 where one large node is on the way. The sketch that comes before the comparison of full sets is the same in all
trees; its slack of 0.13 is 3.7 standard deviations, which loses about one pair in 10,000 at 0.8 and
fewer above. Where a node's classes have nearly the least similarity to begin with (texts of one
template), a pair at 0.8 shares few of the tokens that branch, and more are missed; the README has
measured figures. Links are confirmed on the full sets, so none is wrong.

Candidates come in two rounds: a forest of each group first; then, between the components that its
confirmed links make, all pairs, or one product of the group's incidence matrix where they are many.

Defined results for odd rows: a text with fewer words than a shingle is one shingle, a null or
empty one has none and is linked with nothing; repeated rows are one class and share a component;
rows with one doc_id and different texts are different documents; the least doc_id of a component
names it, and null ids don't name any: where all ids of a component are null its name is null and
all its rows are kept; rows with a null id aren't kept where another row of their component has
one; extra columns pass through, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm.blocks import Hasher, cuts, flat, runs, texts
from tallyline.llm.components import components
from tallyline.session import forget, let_workers_import, written

TREES = 12
#: Tokens that name the first children, and minwise tokens of a class in all; their low bytes are its sketch.
FIRST, TOKENS = 2, 128
#: Children that a class of a large node goes to, classes of a node that is compared at once, of a block of a larger one, and its pivots.
FAN, SMALL, BLOCK, PIVOTS = 2, 100, 300, 64
#: Least similarity, and how far below it a sketch may lie.
SIMILARITY, SLACK = 0.8, 0.13
#: Similarity of a sketch from which a link is likely enough to prefer the partner that other nodes prefer.
SURE = 0.87
#: Columns of a part of the incidence matrix.
COLUMNS = 1 << 14
#: Votes of a node's blocks that are held at once, and blocks whose best pivots are chosen together.
VOTES, BLOCKS = 4096, 16
#: Copies of what the classes of one component all need.
SALTS = 16
#: Ids up to which the selection of documents to confirm is broadcast; beyond, it is a shuffled join.
MAX_BROADCAST = 200_000
#: A key with more than a thousandth of the rows is hot; there are at most a thousand, so these may be broadcast.
HOT = 1000
#: Rows of a file of a small table, and the most files of one that counts as small.
FILE_ROWS, FEW = 50_000, 16

SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_random = np.random.default_rng(7)
MASKS, ODDS = _random.integers(0, 2**64, TOKENS, dtype=np.uint64), _random.integers(0, 2**63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = np.uint64(0xD6E8FEB86659FD93)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(29))


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each distinct shingle of a block's texts, in order."""
    raw = LOWER[data[offsets[0] : offsets[-1]]]
    inside = ~SPACE[raw]
    starts, ends = runs(inside, offsets)
    before = np.searchsorted(starts, offsets - offsets[0])
    words = Hasher(raw, inside).of(starts, ends)
    n = np.diff(before)
    text = np.repeat(np.arange(len(n)), n)
    left = before[text + 1] - np.arange(len(words))  # words from here to the text's end
    h = words.copy()
    for k in range(1, size):
        more = np.zeros(len(words), np.uint64)
        more[: len(words) - k] = words[k:]
        h = np.where(left > k, h * STEP + more, h)
    whole = (left >= size) | ((n[text] < size) & (np.arange(len(words)) == before[text]))
    h, text = mixed(h[whole] + n[text[whole]].astype(np.uint64) * (n[text[whole]] < size)), text[whole]
    order = np.argsort(h)
    order = order[np.argsort(text[order], kind="stable")]
    h, text = h[order], text[order]
    first = np.append(True, (text[1:] != text[:-1]) | (h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
    return text[first], h[first]


def class_of(h: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One hash for each set of the sorted shingle hashes that start at these places."""
    return mixed(np.add.reduceat(h, at) + mixed(np.bitwise_xor.reduceat(h * STEP, at)) + n.astype(np.uint64)).astype(np.int64)


def profiler(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """doc_id, the row's key, n_shingles, the class of the set (null without any), its minwise tokens and their low bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(texts(batch))
            ids = batch.column("doc_id")
            for i, j in cuts(offsets):
                text, h = shingles(data, offsets[i : j + 1], size)
                n = np.bincount(text, minlength=j - i)
                some = np.flatnonzero(n)
                at = np.searchsorted(text, some)
                tokens = np.empty((len(some), TOKENS), "<u4")
                if len(some):
                    for k in range(TOKENS):
                        tokens[:, k] = np.minimum.reduceat((((h ^ MASKS[k]) * ODDS[k]) >> np.uint64(32)).astype(np.uint32), at)
                where = np.full(j - i, -1)
                where[some] = np.arange(len(some))
                valid = where >= 0
                classes = np.zeros(j - i, np.int64)
                if len(some):
                    classes[valid] = class_of(h, at, n[some])
                yield pa.RecordBatch.from_arrays(
                    [
                        ids[i:j].cast(pa.int64()),
                        batch.column("key")[i:j],
                        pa.array(n, pa.int64()),
                        pa.array(classes, mask=~valid),
                        pa.array([tokens[w].tobytes() if w >= 0 else None for w in where.tolist()], pa.binary()),
                        pa.array([tokens[w].astype(np.uint8).tobytes() if w >= 0 else None for w in where.tolist()], pa.binary()),
                    ],
                    names=["doc_id", "key", "n_shingles", "class", "tokens", "sketch"],
                )

    return run


def _tokens(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("tokens").cast(pa.large_binary())
    data, offsets = flat(column)
    return data[offsets[0] : offsets[-1]].view("<u4").reshape(len(column), TOKENS)


def _children(node: np.ndarray, tokens: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mixed(mixed(node * STEP + token.astype(np.uint64)) + tokens[np.arange(len(node)), token].astype(np.uint64) * STEP).astype(np.int64)


def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens, n = _tokens(batch), batch.num_rows
        nodes = []
        for t in range(TREES):
            node = np.full(n, t + 1, np.uint64)
            for k in range(FIRST):
                node = _children(node, tokens, np.full(n, FIRST * t + k)).astype(np.uint64)
            nodes.append(node.astype(np.int64))
        node = np.concatenate(nodes)
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.concat_arrays([batch.column("class")] * TREES)], names=["node", "class"])


def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per run of a node's rows and token, the middle value and its count: a value that most rows have is the middle one."""
    for batch in batches:
        tokens, node = _tokens(batch), batch.column("node").to_numpy()
        cut = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        rows = []
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(node)], strict=True):
            middle = np.sort(tokens[a:b], axis=0)[(b - a) // 2]
            rows.append((int(node[a]), b - a, middle.tobytes(), (tokens[a:b] == middle).sum(0).astype("<u8").tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["node", "n", "values", "counts"])


def _elected(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The middle value of each token by weight, and its count."""
    order = np.argsort(values, axis=0, kind="stable")
    v, c = np.take_along_axis(values, order, 0), np.take_along_axis(counts, order, 0)
    at = (np.cumsum(c, axis=0) * np.uint64(2) < c.sum(0)).sum(0)
    middle = v[np.minimum(at, len(v) - 1), np.arange(TOKENS)]
    return middle, np.where(values == middle, counts, np.uint64(0)).sum(0)


def elections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From votes sorted by node: each token's value that more than half of the node's rows have, with a bit above it; else 0."""
    now, n, held = None, 0, ([], [])

    def result() -> pa.RecordBatch:
        v, c = _elected(np.stack(held[0]), np.stack(held[1]))
        common = np.where(2 * c.astype(np.int64) > n, v.astype("<u8") | np.uint64(1 << 32), np.uint64(0))
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([common.tobytes()], pa.binary())], names=["node", "common"])

    for batch in batches:
        for node, m, values, counts in zip(*(batch.column(c).to_pylist() for c in ("node", "n", "values", "counts")), strict=True):
            if node != now:
                if now is not None:
                    yield result()
                now, n, held = node, 0, ([], [])
            n += m
            held[0].append(np.frombuffer(values, "<u4"))
            held[1].append(np.frombuffer(counts, "<u8"))
            if len(held[0]) >= VOTES:
                v, c = _elected(np.stack(held[0]), np.stack(held[1]))
                held = ([v], [c])
    if now is not None:
        yield result()


def branches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each row of a large node: in how many tokens it has what most have, and its children by the first tokens in which it doesn't."""
    for batch in batches:
        tokens, node = _tokens(batch), batch.column("node").to_numpy().astype(np.uint64)
        data, offsets = flat(batch.column("common").cast(pa.large_binary()))
        common = data[offsets[0] : offsets[-1]].view("<u8").reshape(len(node), TOKENS)
        same = (tokens | np.uint64(1 << 32)) == common
        order = mixed(node[:, None] * STEP + np.arange(TOKENS, dtype=np.uint64)) >> np.uint64(1)
        order[same] = np.uint64(2**64 - 1)
        first = np.argpartition(order, FAN, axis=1)[:, :FAN]
        away = ~np.take_along_axis(same, first, 1)
        children = np.stack([_children(node, tokens, first[:, k]) for k in range(FAN)], axis=1)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(away.sum(1))]), pa.int32()), pa.array(children[away]))
        columns = [batch.column("node"), batch.column("block"), batch.column("blocks"), batch.column("class"), pa.array(same.sum(1), pa.int32()), lists]
        yield pa.RecordBatch.from_arrays(columns, names=["node", "block", "blocks", "class", "agree", "children"])


def few_files(df: DataFrame, rows: int) -> DataFrame:
    """About so many rows, dealt to few tasks before they are written where a shuffle has many more partitions than they need.

    Where Hadoop has no native library, an executor starts a process for the mode of each file and folder that it makes.
    """
    n = max(1, -(-rows // FILE_ROWS))
    return df.repartition(n) if n <= FEW and int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) > 4 * n else df


def with_sizes(rows: DataFrame, scratch: list[DataFrame]) -> DataFrame:
    """(node, class, n) of the rows whose node has n > 1 classes; of nodes that hold the same classes one stays. Tables written go to scratch.

    Rows of hot nodes stay where they are, so that no task gets such a node whole.
    """
    members = [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("class")).alias("x"), F.bit_xor(F.xxhash64("class", F.lit(1))).alias("y")]
    counts = rows.groupBy("node").agg(*members).where("n > 1")
    total = rows.count()
    counts = counts.select("node", "n", (F.min("node").over(Window.partitionBy("n", "x", "y")) == F.col("node")).alias("keep"))
    counts = written(few_files(counts, total), "sizes")
    scratch.append(counts)
    cut = max(10 * SMALL, total // HOT)
    marked = rows.join(F.broadcast(counts.where(F.col("n") > cut)), "node", "left")
    rest = marked.where(F.col("n").isNull()).select("node", "class").join(counts.where(F.col("keep") & (F.col("n") <= cut)), "node")
    return marked.where("keep").select("node", "class", "n").union(rest.select("node", "class", "n"))


def leaves(classes: DataFrame) -> DataFrame:
    """(node, block, class) of the groups to compare: small nodes, and blocks of large ones, each with its node's pivots."""
    done, scratch, frontier = [], [], classes.mapInArrow(roots, "node bigint, class bigint")
    n, most = TREES * classes.count(), 0
    while True:
        frontier = written(few_files(frontier, n), "frontier")
        n = frontier.count()
        most += n
        sized = written(few_files(with_sizes(frontier, scratch), n), "nodes")
        scratch += [frontier, sized]
        done.append(sized.where(F.col("n") <= SMALL).select("node", F.lit(0).alias("block"), "class"))
        large = sized.where(F.col("n") > SMALL)
        if large.isEmpty():
            break
        large = large.select("node", "class", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
        large = large.withColumn("block", F.pmod(F.xxhash64("class", "node"), F.col("blocks")).cast("int"))
        known = written(large.join(classes.select("class", "tokens"), "class").repartition("node", "block").sortWithinPartitions("node", "block"), "large")
        cast = known.select("node", "tokens").mapInArrow(votes, "node bigint, n bigint, values binary, counts binary")
        # Written first: joined as it comes, a task of the next step would hold two Python workers at once.
        common = cast.repartition("node").sortWithinPartitions("node").mapInArrow(elections, "node bigint, common binary")
        common = written(few_files(common, n), "common")
        spans = known.select("node", "block").distinct()
        judged = known.join(spans.join(common, "node"), ["node", "block"]).select("node", "block", "blocks", "class", "tokens", "common")
        judged = judged.mapInArrow(branches, "node bigint, block int, blocks int, class bigint, agree int, children array<bigint>")
        judged = written(few_files(judged, n), "judged")
        # In two steps, so that few rows of a very large node come to one task.
        pivots = judged.select("node", "blocks", "class", "agree", F.floor(F.col("block") / BLOCKS).alias("part"))
        for keys in (["node", "part"], ["node"]):
            rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("agree"), F.xxhash64("class"), "class"))
            pivots = pivots.withColumn("rank", rank).where(F.col("rank") <= PIVOTS).drop("rank")
        everywhere = pivots.select("node", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "class")
        done.append(written(few_files(judged.select("node", "block", "class").union(everywhere).distinct(), n), "blocks"))
        scratch += [known, common, judged, done[-1]]
        frontier = judged.select(F.explode("children").alias("node"), "class")
    groups = written(few_files(reduce(DataFrame.union, done), most), "groups")
    forget(*scratch)
    return groups


def grouped(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], work: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Hand sorted rows on in whole groups of the keys; a group that goes over batches waits for its end."""
    rest: pa.Table | None = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        if rest is not None:
            now = pa.concat_tables([rest, now]).combine_chunks()
        last = np.ones(now.num_rows, bool)
        for k in keys:
            c = now.column(k).to_numpy()
            last &= c == c[-1]
        cut = 0 if last.all() else len(last) - int(np.argmin(last[::-1]))
        rest = now.slice(cut)
        if cut:
            yield from work(now.slice(0, cut).combine_chunks())
    if rest is not None and rest.num_rows:
        yield from work(rest.combine_chunks())


def forest(x: np.ndarray, y: np.ndarray, of: np.ndarray) -> list[int]:
    """Places of the pairs that join two trees, taken in order; of gives the tree that each end starts in."""
    root: dict[int, int] = {}

    def top(i: int) -> int:
        while (j := root.get(i, i)) != i:
            root[i] = root.get(j, j)
            i = j
        return i

    keep = []
    for k, (i, j) in enumerate(zip(of[x].tolist(), of[y].tolist(), strict=True)):
        i, j = top(i), top(j)
        if i != j:
            root[i] = j
            keep.append(k)
    return keep


def comparer(similarity: float, spanning: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Candidate pairs of sorted (node, block) groups by sketch.

    spanning: a forest of each group, sure links first, those with the partner of the least hash
    before others, so that different nodes name the same ones. Else pairs of two labels; a group with
    more than two such pairs a class names these classes with its node and block instead.
    """
    least, sure = int(np.ceil((similarity - SLACK) * TOKENS)), int(SURE * TOKENS)

    def compare(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        node, block, cls, label, n = (rows.column(c).to_numpy() for c in ("node", "block", "class", "label", "n_shingles"))
        data, offsets = flat(rows.to_batches()[0].column("sketch").cast(pa.large_binary()))
        sketch = data[offsets[0] : offsets[-1]].reshape(len(node), TOKENS)
        found, d = [], 1
        at = np.arange(len(node) - 1)
        while len(at):
            at = at[at + d < len(node)]
            at = at[(node[at] == node[at + d]) & (block[at] == block[at + d])]
            a, b = at, at + d
            fit = (label[a] != label[b]) & (np.minimum(n[a], n[b]) >= similarity * np.maximum(n[a], n[b]) - 1e-9)
            a, b = a[fit], b[fit]
            for k in range(0, len(a), 20_000):
                x, y = a[k : k + 20_000], b[k : k + 20_000]
                alike = (sketch[x] == sketch[y]).sum(1)
                good = alike >= least
                found.append(np.stack([x[good], y[good], alike[good]]))
            d += 1
        if not found:
            return
        x, y, alike = np.concatenate(found, axis=1)
        group = np.cumsum(np.append(True, (node[1:] != node[:-1]) | (block[1:] != block[:-1]))) - 1
        rowwise = np.zeros(0, np.int64)
        if spanning:
            h = mixed(cls.astype(np.uint64))
            order = np.lexsort((np.where(alike >= sure, np.minimum(h[x], h[y]), np.uint64(0)), -np.minimum(alike, sure), group[x]))
            x, y = x[order], y[order]
            keep = forest(x, y, np.arange(len(cls)))
            x, y = x[keep], y[keep]
        elif len(x):
            dense = np.bincount(group[x], minlength=group[-1] + 1) > 2 * np.bincount(group, minlength=group[-1] + 1)
            rowwise = np.unique(np.concatenate([x[dense[group[x]]], y[dense[group[x]]]]))
            x, y = x[~dense[group[x]]], y[~dense[group[x]]]
        u, v = np.minimum(cls[x], cls[y]), np.maximum(cls[x], cls[y])
        none = pa.nulls(len(u), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), none, none], names=["u", "v", "node", "block"])
        if len(rowwise):
            columns = [pa.array(cls[rowwise]), pa.nulls(len(rowwise), pa.int64()), pa.array(node[rowwise]), pa.array(block[rowwise], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["u", "v", "node", "block"])

    return lambda batches: grouped(batches, ("node", "block"), compare)


def labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Add each class's label so far; one without links is its own."""
    if labels is None:
        return rows.withColumn("label", F.col("class"))
    return rows.join(labels.withColumnRenamed("u", "class"), "class", "left").withColumn("label", F.coalesce("label", "class"))


def candidates(groups: DataFrame, classes: DataFrame, labels: DataFrame | None, similarity: float) -> DataFrame:
    """(u, v) of near sketches, or (u, null, node, block) of classes in groups with many."""
    rows = labelled(groups.join(classes.select("class", "sketch", "n_shingles"), "class"), labels)
    rows = rows.select("node", "block", "class", "label", "n_shingles", "sketch")
    ordered = rows.repartition("node", "block").sortWithinPartitions("node", "block", "class")
    return ordered.mapInArrow(comparer(similarity, labels is None), "u bigint, v bigint, node bigint, block bigint").distinct()


def multiplier(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links of sorted (node, block) groups between two labels, by the product of incidence matrices: a forest over the labels."""

    def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        keys = [rows.column(k).to_numpy() for k in ("node", "block")]
        new = np.flatnonzero(np.append(True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])))
        for a, b in zip(new, np.append(new[1:], rows.num_rows), strict=True):
            yield from multiply(rows.slice(a, b - a))

    def multiply(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        cls, label = (rows.column(c).to_numpy() for c in ("class", "label"))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("set")]
        size = np.array([len(x) for x in sets])
        _, column = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(len(sets)), size)
        order = np.argsort(column, kind="stable")
        column, row = column[order], row[order]
        both = np.zeros((len(sets), len(sets)), np.float32)
        for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
            i, j = np.searchsorted(column, [low, low + COLUMNS])
            part = np.zeros((len(sets), min(COLUMNS, int(column[-1]) + 1 - low)), np.float32)
            part[row[i:j], column[i:j] - low] = 1
            both += part @ part.T
        n = np.rint(both).astype(np.int64)
        x, y = np.nonzero((100 * n >= percent * (size[:, None] + size[None, :] - n)) & (label[:, None] < label[None, :]))
        keep = forest(x, y, label)
        u, v = np.minimum(cls[x[keep]], cls[y[keep]]), np.maximum(cls[x[keep]], cls[y[keep]])
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return lambda batches: grouped(batches, ("node", "block"), work)


def setter(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(class, set) of the texts whose set is the class asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(texts(batch))
            asked = batch.column("class").to_numpy()
            for i, j in cuts(offsets):
                text, h = shingles(data, offsets[i : j + 1], size)
                some, at, n = np.unique(text, return_index=True, return_counts=True)
                if not len(some):
                    continue
                right = class_of(h, at, n) == asked[i + some]
                sets = [h[a : a + k].tobytes() for a, k in zip(at[right].tolist(), n[right].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(asked[i + some][right]), pa.array(sets, pa.binary())], names=["class", "set"])

    return run


def confirmer(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b in zip(batch.column("set_u"), batch.column("set_v"), strict=True):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                good.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([pc.filter(batch.column(c), pa.array(good, pa.bool_())) for c in ("u", "v")], names=["u", "v"])

    return run


def row_key() -> Column:
    """Tells rows apart by id and text; it may be that two have the same, so what is found by it is looked at again."""
    return F.xxhash64("doc_id", "text")


def sets_of(ids: DataFrame, docs: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """(class, set) of the classes asked for; one document stands for each, and no other has its set made."""
    ids = written(ids, "ids")
    few = ids.count() <= MAX_BROADCAST
    asked = classes.select("class", F.col("key").alias("__tl_key")).join(F.broadcast(ids) if few else ids, "class")
    keyed = docs.select(row_key().alias("__tl_key"), "text")
    chosen = keyed.join(F.broadcast(asked) if few else asked, "__tl_key").select("class", "text")
    return written(chosen.mapInArrow(setter(size), "class bigint, set binary").dropDuplicates(["class"]), "sets")


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs whose full sets of shingles are similar enough."""
    both = pairs.join(sets.select(F.col("class").alias("u"), F.col("set").alias("set_u")), "u").join(sets.select(F.col("class").alias("v"), F.col("set").alias("set_v")), "v")
    return both.select("u", "v", "set_u", "set_v").mapInArrow(confirmer(round(100 * similarity)), "u bigint, v bigint")


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("u", "v")).alias("class")).where(F.col("class").isNotNull()).distinct()


def linked_classes(docs: DataFrame, classes: DataFrame, size: int, similarity: float) -> DataFrame:
    """(u, label) of the classes with a confirmed link: the least class that each reaches."""
    groups = leaves(classes)
    n = groups.count()
    first = written(few_files(candidates(groups, classes, None, similarity).select("u", "v"), n), "pairs")
    sets = sets_of(ends(first), docs, classes, size)
    links = written(few_files(confirmed(first, sets, similarity), n), "links")
    forget(sets)
    labels = written(few_files(components(links), n), "labels")
    second = written(few_files(candidates(groups, classes, labels, similarity), n), "pairs")
    pairs = second.where(F.col("v").isNotNull()).select("u", "v").join(first, ["u", "v"], "left_anti")
    dense = labelled(second.where(F.col("v").isNull()).select("node", "block", F.col("u").alias("class")), labels)
    sets = sets_of(ends(pairs).union(dense.select("class")).distinct(), docs, classes, size)
    full = dense.join(sets, "class").repartition("node", "block").sortWithinPartitions("node", "block", "class")
    more = confirmed(pairs, sets, similarity).union(full.mapInArrow(multiplier(round(100 * similarity)), "u bigint, v bigint"))
    more = written(few_files(more, n), "links")
    forget(sets, groups, first, second)
    if more.isEmpty():
        return labels
    return written(few_files(components(more.union(labels.select("u", F.col("label").alias("v")))), n), "labels")


def near_duplicates(docs: DataFrame, size: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, key, class, n_shingles, component_id and kept of every row of docs (doc_id, text).

    The default shingles are of five words.
    """
    let_workers_import(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    profiles = docs.withColumn("key", row_key()).mapInArrow(profiler(size), "doc_id bigint, key bigint, n_shingles bigint, class bigint, tokens binary, sketch binary")
    profiles = written(profiles, "profiles")
    grouped = profiles.where(F.col("class").isNotNull()).groupBy("class")
    whole = [F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"), F.min("key").alias("key"), *(F.first(c).alias(c) for c in ("n_shingles", "tokens", "sketch"))]
    n = profiles.count()
    classes = written(grouped.agg(*whole), "classes")
    rows = profiles.select("doc_id", "key", "class", "n_shingles")
    labels = linked_classes(docs, classes, size, similarity)
    # A component may hold a third of all classes: its name is copied to salts, over which its classes are dealt.
    linked = labels.withColumnRenamed("u", "class").join(classes.select("class", "least"), "class")
    names = linked.groupBy("label").agg(F.min("least").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = linked.withColumn("salt", F.pmod(F.xxhash64("class"), F.lit(SALTS)).cast("int"))
    by_class = dealt.join(names, ["label", "salt"]).select("class", "component_id")
    named = classes.select("class", "least", "n").join(by_class, "class", "left")
    named = written(few_files(named.select("class", "n", F.coalesce("component_id", "least").alias("component_id")), n), "named")
    # A class may hold a third of all rows: hot ones are told to every task, and their rows stay where they are.
    cut = max(HOT, named.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // HOT)
    hot = named.where(F.col("n") > cut).select("class", F.struct("component_id").alias("hot"))
    rest = named.where(F.col("n") <= cut).select("class", F.col("component_id").alias("cold"))
    marked = rows.join(F.broadcast(hot), "class", "left")
    known = marked.where(F.col("hot").isNotNull()).select("doc_id", "key", "class", "n_shingles", "hot.component_id")
    other = marked.where(F.col("hot").isNull()).select("doc_id", "key", "class", "n_shingles")
    own = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("cold"))
    out = known.union(other.join(rest, "class", "left").select("doc_id", "key", "class", "n_shingles", own.alias("component_id")))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return out.withColumn("kept", kept).select("doc_id", "key", "class", "n_shingles", "component_id", "kept")


def deduplicated(docs: DataFrame, size: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each component, the one with the least doc_id; texts without shingles all stay.

    Of repeated rows with that doc_id and one text any single one stays; other texts of that doc_id
    stay where they are their own component's first.
    """
    found = near_duplicates(docs, size, similarity).where("kept").groupBy(F.col("key").alias("__tl_key"))
    found = written(found.agg(F.count("class").alias("__tl_n")), "kept")
    kept = docs.withColumn("__tl_key", row_key()).join(found, "__tl_key").select(*(f"`{c}`" for c in docs.columns), "__tl_key", "__tl_n")
    if found.where("__tl_n > 1").isEmpty():
        return kept.drop("__tl_key", "__tl_n")
    once = kept.where("__tl_n > 1").dropDuplicates(["__tl_key"])
    return kept.where("__tl_n <= 1").union(once).drop("__tl_key", "__tl_n")


def op7_near_dedup(spark, sf_dir: str) -> DataFrame:
    from tallyline.session import table

    out = near_duplicates(table(spark, sf_dir, "documents"), size=2)
    return out.select("doc_id", "n_shingles", "component_id", "kept")
