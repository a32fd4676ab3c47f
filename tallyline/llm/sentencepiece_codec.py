"""SentencePiece encoding and decoding by vectorised merge rounds over flat symbol arrays.

The distinct words of a block lie one after another in one array of symbol numbers. A round finds
the best rank of any neighbouring pair in each word, merges that pair's occurrences from the left,
and compacts the array; words without a pair drop out, and the rounds end when none is left.

Defined results for odd rows: a null or empty text is encoded as the begin and end ids and decoded
as an empty text; characters that the model lacks become bytes; nulls in other columns and extra
columns pass through; repeated rows are encoded one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallyline.llm.blocks import cuts, flat, texts, tokenizer_file, with_column
from tallyline.llm.word_cache import WordCache

#: What stands for a space in pieces (U+2581), and its bytes.
MARK, MARK_BYTES = "▁", "▁".encode()
REPLACEMENT = "�".encode()


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message: varints, fixed words as bytes, and strings."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            value, at, shift = value | (b & 127) << shift, at + 1, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
            yield key >> 3, value
        else:
            if key & 7 == 2:
                size, at = varint(at)
            else:
                size = 4 if key & 7 == 5 else 8
            yield key >> 3, data[at : at + size]
            at += size


class Codec:
    """A BPE model file: its pieces, ranks of pairs, and byte pieces.

    Only what such a model says of its pieces is used: normalisation is taken to be the identity
    with a leading space and spaces kept, and pieces to have spaces at their start alone. A model
    that differs is refused.
    """

    NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6

    def __init__(self, path: str, cached: int = 100_000):
        with open(path, "rb") as f:
            message = f.read()
        pieces, spec = [], {}
        for number, value in fields(message):
            if number == 1:
                piece = dict(fields(value))
                pieces.append((piece[1].decode(), float(np.frombuffer(piece.get(2, bytes(4)), "<f4")[0]), piece.get(3, self.NORMAL)))
            elif number == 3:
                spec = dict(fields(value))
        kinds = np.array([k for _, _, k in pieces])
        if spec.get(2) or spec.get(3, 1) == 0 or spec.get(4, 1) != 0 or not set(kinds.tolist()) <= {1, 2, 3, 6}:
            raise ValueError("a model with its own normalisation, or with pieces that the user defined, is not supported")
        if any(MARK in p.lstrip(MARK) for p, _, k in pieces if k == self.NORMAL):
            raise ValueError("a model whose pieces go over from one word to the next is not supported")
        self.begin, self.end = (next(i for i, p in enumerate(pieces) if p[0] == s) for s in ("<s>", "</s>"))
        self.bytes_at = np.array([i for i, p in enumerate(pieces) if p[2] == self.BYTE], np.uint32)
        self.control = np.flatnonzero((kinds == self.CONTROL) | (kinds == self.UNKNOWN))

        ids = {p: i for i, (p, _, k) in enumerate(pieces) if k == self.NORMAL}
        extra = sorted({c for p in ids for c in p}.difference(ids))  # characters that only longer pieces have
        symbols = ids | {c: len(pieces) + i for i, c in enumerate(extra)}
        self.chars = {c: symbols[c] for c in symbols if len(c) == 1}
        self.none = len(pieces) + len(extra)
        ranks = {s: r for r, s in enumerate(sorted({-p[1] for p in pieces if p[2] == self.NORMAL}))}
        merges: list[tuple[int, int, int]] = []
        for piece, i in ids.items():
            rank = ranks[-pieces[i][1]]
            merges += [(symbols[piece[:k]] << 20 | symbols[piece[k:]], rank, i) for k in range(1, len(piece)) if piece[:k] in symbols and piece[k:] in symbols]
        merges.sort()
        self.pairs, self.ranks, self.made = (np.array([m[c] for m in merges], np.int64) for c in range(3))
        # A piece after whose making a better pair may stand beside it: of such, one is made at a time.
        best_beside = np.full(self.none + 1, np.iinfo(np.int64).max)
        for side in (self.pairs >> 20, self.pairs & (1 << 20) - 1):
            np.minimum.at(best_beside, side, self.ranks)
        self.lone = best_beside[self.made] < self.ranks
        self.n_ranks = len(ranks)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[self._slot(self.pairs)] = True

        self.surface = [p.replace(MARK, " ").encode() if k == self.NORMAL else b"" for p, _, k in pieces]
        self.surface[next(i for i, p in enumerate(pieces) if p[2] == self.UNKNOWN)] = " ⁇ ".encode()
        self.byte_of = {int(i): b for b, i in enumerate(self.bytes_at)}
        for i, b in self.byte_of.items():
            self.surface[i] = bytes([b])
        self.is_byte = kinds == self.BYTE
        self.cache = WordCache(self._encode, cached)

    @staticmethod
    def _slot(pairs: np.ndarray) -> np.ndarray:
        return (pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)

    def _lookup(self, pairs: np.ndarray) -> np.ndarray:
        """Place of each pair among the merges, or -1."""
        out = np.full(len(pairs), -1)
        maybe = np.flatnonzero(self.filter[self._slot(pairs)])
        at = np.searchsorted(self.pairs, pairs[maybe])
        at[at == len(self.pairs)] = 0
        hit = self.pairs[at] == pairs[maybe]
        out[maybe[hit]] = at[hit]
        return out

    def _merged(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and their words after all merges, in the order of the words; at must not hold symbols of none."""
        done_symbols, done_words, never = [], [], np.int64(self.n_ranks)
        # where[i] is the place of the pair (i, i + 1) among the merges, kept from round to round.
        where = self._lookup(symbols[:-1] << 20 | symbols[1:])
        where[word[:-1] != word[1:]] = -1
        where = np.append(where, -1)
        place = np.arange(len(symbols))  # for the order of what is done
        done_place = []
        while len(symbols):
            rank = np.where(where >= 0, self.ranks[where], never)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            sizes = np.diff(np.append(first, len(word)))
            best = np.minimum.reduceat(rank, first)
            open_ = best < never
            if not open_.all():
                ends = np.repeat(~open_, sizes)
                done_symbols.append(symbols[ends])
                done_words.append(word[ends])
                done_place.append(place[ends])
                keep = ~ends
                symbols, word, where, rank, place = symbols[keep], word[keep], where[keep], rank[keep], place[keep]
                best, sizes = best[open_], sizes[open_]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == np.repeat(best, sizes))
            # Of overlapping occurrences every second goes, counted from the left of each chain.
            chain = np.append(True, (at[1:] != at[:-1] + 1) | (word[at[1:]] != word[at[:-1]]))
            head = np.maximum.accumulate(np.where(chain, np.arange(len(at)), 0))
            take = (np.arange(len(at)) - head) % 2 == 0
            # Pairs of one rank are one piece, but may be split in different ways: the leftmost alone goes then, too.
            in_word = np.append(True, word[at[1:]] != word[at[:-1]])
            start = np.maximum.accumulate(np.where(in_word, np.arange(len(at)), 0))
            mixed = where[at] != where[at[start]]
            single = self.lone[where[at[start]]] | np.logical_or.reduceat(mixed, np.flatnonzero(in_word))[np.cumsum(in_word) - 1]
            take &= in_word | ~single
            at = at[take]
            symbols[at] = self.made[where[at]]
            gone = np.zeros(len(symbols), bool)
            gone[at + 1] = True
            keep = ~gone
            at = at - np.searchsorted(at, at)  # one symbol fewer for each merge to the left
            symbols, word, where, place = symbols[keep], word[keep], where[keep], place[keep]
            touched = np.unique(np.concatenate([at, at[at > 0] - 1]))
            inner = touched[touched + 1 < len(symbols)]
            where[touched] = -1
            inner = inner[word[inner] == word[inner + 1]]
            where[inner] = self._lookup(symbols[inner] << 20 | symbols[inner + 1])
        if not done_place:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        order = np.argsort(np.concatenate(done_place), kind="stable")
        return np.concatenate(done_symbols)[order], np.concatenate(done_words)[order]

    def _encode(self, raw: list[bytes]) -> list[bytes]:
        """Little-endian ids of each word; a word has spaces at its start alone."""
        words = [w.decode().replace(" ", MARK) for w in raw]
        if not words:
            return []
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        kinds, which = np.unique(points, return_inverse=True)
        symbols = np.array([self.chars.get(chr(p), self.none) for p in kinds.tolist()], np.int64)[which]
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        merged, of = self._merged(symbols, word)
        # Characters without a piece never merge, so the n-th of them is the n-th left over.
        lost = merged >= len(self.surface)
        if lost.any():
            chars, at = {len(self.surface) + i: c for i, c in enumerate(sorted(c for c, s in self.chars.items() if s >= len(self.surface)))}, np.flatnonzero(lost)
            unknown = iter(points[symbols == self.none].tolist())
            spelt = [(chr(next(unknown)) if s == self.none else chars[s]).encode() for s in merged[at].tolist()]
            sizes = np.ones(len(merged), np.int64)
            sizes[at] = [len(x) for x in spelt]
            out = np.repeat(merged, sizes)
            out[np.repeat(lost, sizes)] = self.bytes_at[np.frombuffer(b"".join(spelt), np.uint8)]
            merged, of = out, np.repeat(of, sizes)
        data, ends = merged.astype("<u4").tobytes(), (np.searchsorted(of, np.arange(len(words)), "right") * 4).tolist()
        return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a block in a row, without begin and end, and how many each has."""
        raw = data[offsets[0] : offsets[-1]]
        sizes = np.diff(offsets)
        if MARK_BYTES in (held := raw.tobytes()):  # U+2581 in a text counts as a space
            parts = [held[a:b].replace(MARK_BYTES, b" ") for a, b in zip((offsets[:-1] - offsets[0]).tolist(), (offsets[1:] - offsets[0]).tolist(), strict=True)]
            raw, sizes = np.frombuffer(b"".join(parts), np.uint8), np.array([len(p) for p in parts])
        at = np.cumsum(sizes) - sizes
        some = sizes > 0
        raw = np.insert(raw, at[some], 32)  # a space before each text
        sizes = sizes + some
        edges = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(sizes), np.int64)
        space, line = raw == 32, raw == 10
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        cut |= line
        cut[1:] |= line[:-1]
        cut[edges[:-1][some]] = True
        starts = np.flatnonzero(cut)
        ids, each = self.cache.gathered(raw, starts, np.append(starts[1:], len(raw)))
        done = np.concatenate([np.zeros(1, np.int64), np.cumsum(each)])
        return ids, np.diff(done[np.searchsorted(starts, edges)])

    def decode(self, ids: list[int]) -> bytes:
        """The text of these ids in UTF-8, without the leading space of the first piece; bytes that form no character are replaced."""
        table, ids = self.surface, [i for i in ids if i != self.begin and i != self.end]
        if ids and table[ids[0]][:1] == b" " and not self.is_byte[ids[0]]:
            out = table[ids[0]][1:] + b"".join(map(table.__getitem__, ids[1:]))
        else:
            out = b"".join(map(table.__getitem__, ids))
        try:
            out.decode()
            return out
        except UnicodeDecodeError:
            return self._repaired(ids)

    def _repaired(self, ids: list[int]) -> bytes:
        out, run = [], bytearray()

        def flush() -> None:
            at = 0
            while at < len(run):
                for size in (1, 2, 3, 4):
                    try:
                        run[at : at + size].decode()
                    except UnicodeDecodeError:
                        continue
                    out.append(bytes(run[at : at + size]))
                    at += size
                    break
                else:
                    out.append(REPLACEMENT)
                    at += 1
            run.clear()

        for k, i in enumerate(ids):
            if self.is_byte[i]:
                run.append(self.byte_of[i])
            else:
                flush()
                out.append(self.surface[i][1:] if k == 0 and self.surface[i][:1] == b" " else self.surface[i])
        flush()
        return b"".join(out)


_codecs: dict[str, Codec] = {}


def codec(model: str) -> Codec:
    if model not in _codecs:
        _codecs[model] = Codec(tokenizer_file(model))
    return _codecs[model]


def framed(ids: np.ndarray, sizes: np.ndarray, begin: int, end: int) -> np.ndarray:
    """The ids of texts in a row, each with a begin and an end id."""
    out = np.empty(len(ids) + 2 * len(sizes), np.int32)
    ends = np.cumsum(sizes + 2)
    mark = np.zeros(len(out), bool)
    mark[ends - 1] = mark[ends - sizes - 2] = True
    out[~mark] = ids
    out[ends - 1], out[ends - sizes - 2] = end, begin
    return out


def coder(path: str, full: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """full: the ids and the decoded text themselves, else their digests. A block's rows are handed on before the next block is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        ends = np.array([c.begin], "<u4").tobytes(), np.array([c.end], "<u4").tobytes()
        for batch in batches:
            data, offsets = flat(texts(batch))
            for i, j in cuts(offsets):
                made, read = [], []
                ids, sizes = c.encode(data, offsets[i : j + 1])
                raw, at = ids.astype("<u4").tobytes(), np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    text = c.decode(ids[a:b].tolist())
                    if full:
                        read.append(text.decode())
                    else:
                        made.append(hashlib.sha256(ends[0] + raw[4 * a : 4 * b] + ends[1]).hexdigest())
                        read.append(hashlib.sha256(text).hexdigest())
                rows, n = batch.slice(i, j - i), pa.array(sizes + 2, pa.int64())
                if full:
                    edges = pa.array(np.concatenate([[0], np.cumsum(sizes + 2)]), pa.int32())
                    lists = pa.ListArray.from_arrays(edges, pa.array(framed(ids, sizes, c.begin, c.end), pa.int32()))
                    yield with_column(rows, n_tokens=n, ids=lists, decoded=pa.array(read, pa.string()))
                else:
                    yield with_column(rows, n_tokens=n, ids_sha256=pa.array(made, pa.string()), decoded_sha256=pa.array(read, pa.string()))

    return run


def _with(docs: DataFrame, path: str, full: bool) -> DataFrame:
    new = [("n_tokens", T.LongType())]
    new += [("ids", T.ArrayType(T.IntegerType())), ("decoded", T.StringType())] if full else [("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    docs = docs.drop(*(n for n, _ in new))
    return docs.mapInArrow(coder(path, full), T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in new)]))


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """Add n_tokens, ids with begin and end, and the decoded text; columns of these names are replaced."""
    return _with(docs, model, True)


def digests(docs: DataFrame, model: str) -> DataFrame:
    """Add n_tokens and the SHA-256 of the ids and of the decoded text; columns of these names are replaced."""
    return _with(docs, model, False)


def model_path() -> str:
    """The model's name; each worker finds its own copy."""
    return "piece_bpe_32k.model"


def op4_sentencepiece(spark, sf_dir: str, model: str | None = None) -> DataFrame:
    from tallyline.session import let_workers_import, table

    let_workers_import(spark)
    out = digests(table(spark, sf_dir, "documents").select("doc_id", "text"), model or model_path())
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
