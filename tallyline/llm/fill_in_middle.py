"""Fill-in-middle rearrangement over texts that are stored as seekable compressed frames.

A text is cut into frames of bounded size, each compressed by zstandard on its own, and each carries
the units (lines), code points and bytes before it. The end of any unit is found by those counts and
one decompressed frame; prefix, middle and suffix are then streams of frames in order, so that of a
long text only a few frames are open at a time.

Where a text is cut follows from a digest of the seed and its doc_id alone, so a task that runs twice
gives the same rows. A rearranged text is taken apart again from its own frames by its marks.

Defined results for odd rows: a null or empty text is plain, without units, and comes out empty; a
text that holds a mark is plain; a null doc_id counts as an empty one; repeated rows are rows like
others; an empty table gives an empty one; extra columns pass through, those of the names that are
added are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallyline.llm.blocks import flat, texts, with_column

#: Bytes of text in a frame, at most.
FRAME = 1 << 15
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
#: What a stored frame has: its bytes, and the units, code points and bytes of the text before it.
STORED = T.ArrayType(T.StructType([T.StructField("data", T.BinaryType()), *(T.StructField(n, T.LongType()) for n in ("units", "chars", "bytes"))]))
BEFORE = ("units", "chars", "bytes")


def starts_of_characters(data: bytes) -> int:
    """Code points that begin in these bytes of UTF-8."""
    return len(data) - int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) == 0x80))


def pieces(chunks: Iterable[bytes], size: int) -> Iterator[bytes]:
    """The same bytes in pieces of at most this size that end with a unit if they can, else with a code point."""
    left = b""
    for chunk in chunks:
        left += chunk
        at = 0
        while len(left) - at > size:
            end = left.rfind(b"\n", at, at + size) + 1
            if not end:
                end = at + size
                while left[end] & 0xC0 == 0x80:
                    end -= 1
            yield left[at:end]
            at = end
        left = left[at:]
    if left:
        yield left


class Frames:
    """Frames of a text and, before each and after the last, the units, code points and bytes so far."""

    def __init__(self, frames: list[bytes], before: list[tuple[int, int, int]]):
        self.frames, self.before = frames, before
        self._open: dict[int, bytes] = {}
        self._reader = zstandard.ZstdDecompressor()

    @classmethod
    def of(cls, chunks: Iterable[bytes], size: int = FRAME, level: int = 1) -> Frames:
        packer, frames, before = zstandard.ZstdCompressor(level=level), [], [(0, 0, 0)]
        for piece in pieces(chunks, size):
            units, chars, done = before[-1]
            frames.append(packer.compress(piece))
            before.append((units + piece.count(b"\n"), chars + starts_of_characters(piece), done + len(piece)))
        return cls(frames, before)

    def frame(self, k: int) -> bytes:
        """The text of a frame; the two used last stay open."""
        if k not in self._open:
            if len(self._open) > 1:
                self._open.pop(next(iter(self._open)))
            self._open[k] = self._reader.decompress(self.frames[k])
        return self._open[k]

    @property
    def size(self) -> int:
        return self.before[-1][2]

    @property
    def units(self) -> int:
        """Lines, a last one without its end included."""
        if not self.frames:
            return 0
        return self.before[-1][0] + (not self.frame(len(self.frames) - 1).endswith(b"\n"))

    def after(self, unit: int) -> tuple[int, int]:
        """Byte and code point where this many units have ended; opens the frame where the last of them ends."""
        if unit <= 0:
            return 0, 0
        if unit > self.before[-1][0]:
            return self.before[-1][2], self.before[-1][1]
        low, high = 0, len(self.frames)
        while high - low > 1:
            at = (low + high) // 2
            low, high = (at, high) if self.before[at][0] < unit else (low, at)
        units, chars, done = self.before[low]
        data = self.frame(low)
        end = int(np.flatnonzero(np.frombuffer(data, np.uint8) == 10)[unit - units - 1]) + 1
        return done + end, chars + starts_of_characters(data[:end])

    def stream(self, start: int, stop: int) -> Iterator[bytes]:
        """The bytes from start to stop, frame by frame."""
        low, high = 0, len(self.frames)
        while high - low > 1:
            at = (low + high) // 2
            low, high = (at, high) if self.before[at][2] <= start else (low, at)
        for k in range(low, len(self.frames)):
            first, last = self.before[k][2], self.before[k + 1][2]
            if first >= stop or start >= stop:
                return
            yield self.frame(k)[max(0, start - first) : min(last, stop) - first]

    def find(self, mark: bytes, start: int = 0) -> int:
        """Byte where the mark first stands at or after start, also across frames; -1 if it doesn't."""
        left, at = b"", start
        for data in self.stream(start, self.size):
            data = left + data
            if (k := data.find(mark)) >= 0:
                return at + k
            left = data[max(0, len(data) - len(mark) + 1) :]
            at += len(data) - len(left)
        return -1


def draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits from the seed and the document's id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))


class Rearranged:
    """How one text is cut, and the streams of its rearranged form."""

    def __init__(self, text: Frames, doc_id: int | None, seed: int, rate: int, spm_rate: int):
        h1, h2, h3, h4 = draws(seed, doc_id)
        self.text, self.n = text, text.units
        if not text.size or h3 % 100 >= rate or any(text.find(m) >= 0 for m in MARKS):
            self.form, self.prefix_chars, self.middle_chars = "plain", None, None
            return
        self.form = "spm" if h4 % 100 < spm_rate else "psm"
        first, second = sorted((h1 % (self.n + 1), h2 % (self.n + 1)))
        (self.a, chars), (self.b, both) = text.after(first), text.after(second)
        self.prefix_chars, self.middle_chars = chars, both - chars

    def chunks(self) -> Iterator[bytes]:
        """The output in order; each part is a stream of frames."""
        size, stream = self.text.size, self.text.stream
        if self.form == "plain":
            yield from stream(0, size)
            return
        prefix, suffix = (PREFIX, 0, self.a), (SUFFIX, self.b, size)
        for mark, start, stop in (*((prefix, suffix) if self.form == "psm" else (suffix, prefix)), (MIDDLE, self.a, self.b)):
            yield mark
            yield from stream(start, stop)


def restored(output: Frames, form: str) -> Iterator[bytes]:
    """The text that a form's output was made of, taken apart at its marks."""
    if form == "plain":
        yield from output.stream(0, output.size)
        return
    middle = output.find(MIDDLE)
    second = output.find(SUFFIX if form == "psm" else PREFIX, len(PREFIX))
    one, two = (len(PREFIX), second), (second + len(PREFIX), middle)
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    for start, stop in (prefix, (middle + len(MIDDLE), output.size), suffix):
        yield from output.stream(start, stop)


def store_batches(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(texts(batch))
            edges, frames, before = [0], [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                f = Frames.of((data[k : min(b, k + (1 << 20))].tobytes() for k in range(a, b, 1 << 20)), size)
                frames += f.frames
                before += f.before[:-1]
                edges.append(len(frames))
            counts = np.array(before, np.int64).reshape(-1, 3)
            kind = pa.struct([("data", pa.binary()), *((n, pa.int64()) for n in BEFORE)])
            rows = pa.StructArray.from_arrays([pa.array(frames, pa.binary()), *(pa.array(counts[:, k]) for k in range(3))], fields=list(kind))
            yield with_column(batch.drop_columns(["text"]), frames=pa.ListArray.from_arrays(pa.array(edges, pa.int32()), rows))

    return run


def stored(docs: DataFrame, size: int = FRAME) -> DataFrame:
    """The documents with frames in place of text; a frame is of this many bytes of text at most."""
    docs = docs.drop("frames")
    fields = [f for f in docs.schema.fields if f.name != "text"]
    return docs.mapInArrow(store_batches(size), T.StructType([*fields, T.StructField("frames", STORED)]))


def loaded(batch: pa.RecordBatch) -> Iterator[Frames]:
    """The stored texts of a batch, one at a time."""
    column = batch.column("frames")
    edges, rows = column.offsets.to_numpy() - column.offsets[0].as_py(), column.flatten()
    data, before = rows.field("data"), np.stack([rows.field(n).to_numpy() for n in BEFORE], axis=1)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        own, counts = data[a:b].to_pylist(), [tuple(x) for x in before[a:b].tolist()]
        f = Frames(own, counts)
        if own:
            last = f._reader.decompress(own[-1])
            u, c, d = counts[-1]
            counts.append((u + last.count(b"\n"), c + starts_of_characters(last), d + len(last)))
        else:
            counts.append((0, 0, 0))
        yield f


def digest(chunks: Iterable[bytes]) -> str:
    h = hashlib.sha256()
    for chunk in chunks:
        h.update(chunk)
    return h.hexdigest()


#: What is added to a document: its units, its form, where it is cut, and the texts or their digests.
MADE = {"n": T.LongType(), "form": T.StringType(), "prefix_chars": T.LongType(), "middle_chars": T.LongType()}
TEXTS, DIGESTS = ("output", "restored"), ("output_sha256", "restored_sha256")


def transform_batches(seed: int, rate: int, spm_rate: int, full: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def told(chunks: Iterable[bytes]) -> str:
        return b"".join(chunks).decode() if full else digest(chunks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), loaded(batch), strict=True):
                made = Rearranged(text, doc_id, seed, rate, spm_rate)
                output = Frames.of(made.chunks())
                rows.append((made.n, made.form, made.prefix_chars, made.middle_chars, told(output.stream(0, output.size)), told(restored(output, made.form))))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = [pa.array(list(x), k) for x, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)]
            yield with_column(batch.drop_columns(["frames"]), **dict(zip((*MADE, *(TEXTS if full else DIGESTS)), columns, strict=True)))

    return run


def transformed(store: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50, full: bool = True) -> DataFrame:
    """Stored documents rearranged: rate of 100 aren't left plain, spm_rate of 100 of those have the suffix first.

    full: the output and the text rebuilt from it, else their digests, for which no text is whole in memory.
    """
    new = MADE | dict.fromkeys(TEXTS if full else DIGESTS, T.StringType())
    store = store.drop(*new)
    fields = [f for f in store.schema.fields if f.name != "frames"]
    return store.mapInArrow(transform_batches(seed, rate, spm_rate, full), T.StructType([*fields, *(T.StructField(n, t) for n, t in new.items())]))


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    from tallyline.session import let_workers_import, table

    let_workers_import(spark)
    return transformed(stored(table(spark, sf_dir, "documents").select("doc_id", "text")), full=False)


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
h AS (
    SELECT *, string_split(t, chr(10)) AS parts,
        (length(t) - length(replace(t, chr(10), '')))::BIGINT + CASE WHEN t <> '' AND t[-1] <> chr(10) THEN 1 ELSE 0 END AS n,
        ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[25:32])::BIGINT AS h4
    FROM d
),
c AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
    FROM h
),
p AS (
    SELECT *, CASE WHEN a = 0 THEN '' WHEN a = n THEN t ELSE array_to_string(parts[1:a], chr(10)) || chr(10) END AS prefix,
        CASE WHEN b = 0 THEN '' WHEN b = n THEN t ELSE array_to_string(parts[1:b], chr(10)) || chr(10) END AS head
    FROM c
),
q AS (SELECT *, substr(head, length(prefix) + 1) AS middle, substr(t, length(head) + 1) AS suffix FROM p)
SELECT doc_id, n, form,
    CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM q
"""
