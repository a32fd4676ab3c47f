"""Arrow batches inside tasks: text columns as flat byte arrays, cut into blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a block holds before the next document starts a new one.
BLOCK = 1 << 20


def tokenizer_file(name: str) -> str:
    """A vocabulary file by its path, or by its name alone among the public tokenizers; asked for where the file is opened."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def texts(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The column as strings; null counts as empty."""
    return pc.fill_null(batch.column(name).cast(pa.large_string()), "")


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large_string column and the offsets of its values."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def cuts(offsets: np.ndarray, block: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of values of about a block of bytes each; a longer value has a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + block, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def with_column(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """The batch with these columns set, those that are there replaced in place."""
    names, arrays = list(batch.schema.names), list(batch.columns)
    for name, array in columns.items():
        if name in names:
            arrays[names.index(name)] = array
        else:
            names.append(name)
            arrays.append(array)
    return pa.RecordBatch.from_arrays(arrays, names=names)


#: Fixed odd multipliers of the polynomial hashes.
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
SEEDS = np.random.default_rng(9).integers(1, 2**63, 256, dtype=np.uint64)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the powers 0 to n modulo 2 to the 64, and their inverses."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, 1 << 20)
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        _powers[:] = [np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, x, np.uint64), dtype=np.uint64)]) for x in (BASE, inverse)]
    return _powers[0], _powers[1]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of marked bytes; no run goes over from one text to the next."""
    n, first = len(inside), offsets[:-1] - offsets[0]
    first = first[first < n]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    starts[first] = inside[first]
    ends[:-1] &= ~inside[1:]
    before = first[first > 0] - 1
    ends[before] = inside[before]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


class Hasher:
    """64-bit hashes of stretches of bytes: differences of one running polynomial sum, moved to a common power."""

    def __init__(self, data: np.ndarray, inside: np.ndarray | None = None):
        """Bytes that aren't inside add nothing."""
        up, self.down = powers(len(data))
        terms = SEEDS[data]
        terms *= up[: len(data)]
        if inside is not None:
            terms[~inside] = 0
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(terms, out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        h ^= h >> np.uint64(31)
        h *= MIX
        return h ^ (h >> np.uint64(29))
