"""Token-id files: ids in as many bits as the vocabulary needs, in blocks that are found by offset.

A file holds consecutive documents: ``PIDS`` and the blocks, then a footer of the documents' ids
and places, the blocks' offsets, and the footer's own size. Every block holds the same number of
ids, so the block and bit of any id follow from its place; one block is unpacked by one numpy
expression. Files are written by tasks under names of their own and listed in a manifest that
Spark commits, so a task that runs twice leaves a file that nothing lists.

Defined results for odd rows: a null or empty text has the end id alone; documents with one doc_id
are ordered by their text's hash; a null doc_id comes first; extra columns don't matter; an empty
table gives no files and an empty result.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm.blocks import cuts, flat, runs, texts, tokenizer_file
from tallyline.llm.word_cache import WordCache

MAGIC = b"PIDS"
#: Ids of a block; a multiple of 8, so that blocks of any width end on a byte.
BLOCK_IDS = 1 << 15
END = 1
FOOTER = struct.Struct("<BIQQQ")


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as big-endian fields of this many bits, the last byte filled with zeros."""
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    fields = (ids[:, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint32)).astype(np.uint8) & 1
    return np.packbits(fields.ravel()).tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    """The first n ids of a packed block."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f">u{bits // 8}", n).astype(np.uint32)
    fields = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits).reshape(n, bits)
    return fields.astype(np.uint32) @ (np.uint32(1) << np.arange(bits - 1, -1, -1, dtype=np.uint32))


class Writer:
    """Appends documents to a file; holds one block and 17 bytes a document."""

    def __init__(self, out, bits: int):
        self.out, self.bits = out, bits
        self.left, self.n_left = [], 0
        self.doc_ids, self.sizes, self.offsets, self.at = [], [], [0], len(MAGIC)
        out.write(MAGIC)

    def add(self, doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> None:
        self.doc_ids += doc_ids
        self.sizes.append(sizes)
        self.left.append(ids)
        self.n_left += len(ids)
        if self.n_left >= BLOCK_IDS:
            ids = np.concatenate(self.left)
            whole = len(ids) - len(ids) % BLOCK_IDS
            for k in range(0, whole, BLOCK_IDS):
                self._block(ids[k : k + BLOCK_IDS])
            self.left, self.n_left = [ids[whole:]], len(ids) - whole

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.out.write(data)
        self.at += len(data)
        self.offsets.append(self.at - len(MAGIC))

    def close(self) -> int:
        if self.n_left:
            self._block(np.concatenate(self.left))
        sizes = np.concatenate(self.sizes) if self.sizes else np.zeros(0, np.uint64)
        known = np.array([d is not None for d in self.doc_ids], np.uint8)
        docs = np.array([d or 0 for d in self.doc_ids], "<i8")
        footer = docs.tobytes() + known.tobytes() + sizes.astype("<u8").tobytes() + np.array(self.offsets, "<u8").tobytes()
        self.out.write(footer + FOOTER.pack(self.bits, BLOCK_IDS, len(docs), len(self.offsets), len(footer)))
        return int(sizes.sum())


class Reader:
    """Documents of a file and any run of its ids, by reading the footer and then only the blocks asked for."""

    def __init__(self, file):
        self.file, end = file, file.size()
        self.bits, self.block, n, blocks, size = FOOTER.unpack(file.read_at(FOOTER.size, end - FOOTER.size))
        footer = file.read_at(size, end - FOOTER.size - size)
        docs, known = np.frombuffer(footer, "<i8", n), np.frombuffer(footer, np.uint8, n, 8 * n)
        self.doc_ids = pa.array(docs, mask=known == 0)
        self.starts = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.frombuffer(footer, "<u8", n, 9 * n).astype(np.int64))])
        self.offsets = np.frombuffer(footer, "<u8", blocks, 17 * n).astype(np.int64)

    def ids(self, start: int, stop: int) -> np.ndarray:
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        data = self.file.read_at(int(self.offsets[last + 1] - self.offsets[first]), int(self.offsets[first]) + len(MAGIC))
        most = min((last + 1) * self.block, int(self.starts[-1])) - first * self.block
        return unpack(data, most, self.bits)[start - first * self.block : stop - first * self.block]


_encoders: dict[str, Encoder] = {}
#: Kinds of bytes: white space, signs, and what only letters have: a-z, the lead byte of é or ß and their second bytes.
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
SIGN = np.isin(np.arange(256), np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ASCII_LETTER = np.isin(np.arange(256), np.arange(97, 123))
LEAD, NO_LETTERS = 0xC3, (0x97, 0xB7)


def stretches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of what stands between white space; letters and the signs right after them are two stretches.

    The tokenizer splits at white space and where a run of letters ends, and never looks on.
    A word with anything else in it, or with letters after signs, stays whole.
    """
    starts, ends = runs(~SPACE[data], offsets)
    letter, sign = ASCII_LETTER[data], SIGN[data]
    second = data[1:]
    pair = (data[:-1] == LEAD) & (second >= 0x80) & (second != NO_LETTERS[0]) & (second != NO_LETTERS[1])
    letter[:-1] |= pair
    letter[1:] |= pair
    odd = ~(letter | sign | SPACE[data])
    odd[1:] |= sign[:-1] & letter[1:]
    odds = np.concatenate([np.zeros(1, np.int32), np.cumsum(odd, dtype=np.int32)])
    turns = np.flatnonzero(letter[:-1] & sign[1:]) + 1
    word = np.searchsorted(starts, turns, "right") - 1
    turns = turns[(odds[ends[word]] == odds[starts[word] + 1]) & ~odd[starts[word]]]
    return np.sort(np.concatenate([starts, turns]), kind="stable"), np.sort(np.concatenate([ends, turns]), kind="stable")


class Encoder:
    """The tokenizer's ids, stretch by stretch.

    Letters alone end with one token that closes a word, which tells the words of one long call apart.
    """

    def __init__(self, path: str, size: int = 200_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        n = self.tokenizer.get_vocab_size()
        self.bits = int(n - 1).bit_length()
        self.closes = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(n)])
        self.words = WordCache(self._encode, size)

    def _encode(self, raw: list[bytes]) -> list[bytes]:
        words = [w.decode() for w in raw]
        plain = [w.lower().isalpha() for w in words]
        letters = [w for w, p in zip(words, plain, strict=True) if p]
        rest = [w for w, p in zip(words, plain, strict=True) if not p]
        out = dict(zip(rest, self._whole(rest), strict=True))
        for k in range(0, len(letters), 1000):
            some = letters[k : k + 1000]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(some):
                data, at = ids.tobytes(), [0, *(ends * 4).tolist()]
                out.update(zip(some, (data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)), strict=True))
            else:
                out.update(zip(some, self._whole(some), strict=True))
        return [out[w] for w in words]

    def _whole(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has.

        ASCII is lower-cased first, which saves look-ups, unless a mark that may join the letter
        before it (U+0300 to U+036F) is about: that could change what the two form.
        """
        data = data[offsets[0] : offsets[-1]]
        if not ((data[:-1] == 0xCC) | (data[:-1] == 0xCD)).any():
            data = LOWER[data]
        starts, ends = stretches(data, offsets)
        ids, sizes = self.words.gathered(data, starts, ends)
        done = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        return ids, np.diff(done[np.searchsorted(starts, offsets - offsets[0])])


def encoder(tokenizer: str) -> Encoder:
    if tokenizer not in _encoders:
        _encoders[tokenizer] = Encoder(tokenizer_file(tokenizer))
    return _encoders[tokenizer]


def encoded(batch: pa.RecordBatch, words: Encoder) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Document ids, numbers of ids with the end id, and the ids, block by block."""
    data, offsets = flat(texts(batch))
    doc_ids = batch.column("doc_id").to_pylist()
    for i, j in cuts(offsets, 1 << 21):  # longer blocks repeat more of their words
        ids, sizes = words.ids(data, offsets[i : j + 1])
        yield doc_ids[i:j], (sizes + 1).astype(np.uint64), np.insert(ids, np.cumsum(sizes), END)


def writer(folder: str, tokenizer: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words = encoder(tokenizer)
        part, name = TaskContext.get().partitionId(), uuid.uuid4().hex
        store, root = fs.FileSystem.from_uri(folder)
        out = None
        for batch in batches:
            for doc_ids, sizes, ids in encoded(batch, words):
                if out is None:
                    store.create_dir(root, recursive=True)
                    stream = store.open_output_stream(f"{root}/part-{part:06d}-{name}.pids")
                    out = Writer(stream, words.bits)
                out.add(doc_ids, sizes, ids)
        if out:
            n = out.close()
            stream.close()
            row = [[part], [f"part-{part:06d}-{name}.pids"], [len(out.doc_ids)], [n], [words.bits]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in row], names=["part", "file", "n_docs", "n_ids", "bits"])

    return run


def reader(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with store.open_input_file(f"{root}/{file}") as f:
                    r = Reader(f)
                    for i, j in cuts(r.starts, 1 << 20):
                        ids, at = r.ids(int(r.starts[i]), int(r.starts[j])).astype("<u4"), r.starts[i : j + 1] - r.starts[i]
                        crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
                        yield pa.RecordBatch.from_arrays(
                            [r.doc_ids[i:j], pa.array(r.starts[i:j] + base), pa.array(np.diff(at)), pa.array(crc, pa.int64())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    return run


def write_ids(docs: DataFrame, folder: str, tokenizer: str) -> DataFrame:
    """Write the documents' ids in ascending doc_id order; returns the files with the place of each one's first id.

    Ranges of doc_id go to tasks, so the files in order of part are the whole in order.
    """
    from tallyline.session import written

    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
    files = written(ordered.mapInArrow(writer(folder, tokenizer), "part long, file string, n_docs long, n_ids long, bits long"), "manifest")
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return files.withColumn("base", F.coalesce(before, F.lit(0).cast("long")))


def read_ids(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and the checksum of the ids of every document, from the files."""
    spread = files.select("file", "base").repartition(max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "file")
    return spread.mapInArrow(reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_token_files(spark, sf_dir: str, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    from tallyline.session import let_workers_import, scratch, table

    let_workers_import(spark)
    folder = scratch(spark, "ids")
    return read_ids(write_ids(table(spark, sf_dir, "documents"), folder, tokenizer), folder)


def in_memory(documents: list[tuple[int | None, list[int]]], bits: int) -> bytes:
    """A whole file as bytes, for small sets."""
    out = io.BytesIO()
    w = Writer(out, bits)
    for doc_id, ids in documents:
        w.add([doc_id], np.array([len(ids)], np.uint64), np.array(ids, np.uint32))
    w.close()
    return out.getvalue()
