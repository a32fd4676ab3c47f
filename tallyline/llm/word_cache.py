"""Encoded stretches of text that come again: a text's ids are gathered from its stretches' ids."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from tallyline.llm.blocks import Hasher


class WordCache:
    """Bytes of the ids of each word, made in batches when a word is new.

    encode(words) returns the bytes of each; it must not depend on a word's neighbours. At most
    2 x size short words are held: those met since the last turnover, and those met before it.
    """

    def __init__(self, encode: Callable[[list], list[bytes]], size: int, longest: int = 40):
        self.encode, self.size, self.longest = encode, size, longest
        self.new: dict = {}
        self.old: dict = {}

    def each(self, words: list) -> list[bytes]:
        """The bytes of each word."""
        out = list(map(self.new.get, words))
        missing = [i for i, x in enumerate(out) if x is None]
        if missing:
            need = {words[i] for i in missing}
            found = {w: x for w in need if (x := self.old.get(w)) is not None}
            fresh = [w for w in need if w not in found]
            found.update(zip(fresh, self.encode(fresh), strict=True))
            for i in missing:
                out[i] = found[words[i]]
            if len(self.new) > self.size:
                self.old, self.new = self.new, {}
            self.new.update((w, x) for w, x in found.items() if len(w) <= self.longest)
        return out

    def gathered(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The 32-bit ids of all stretches of bytes in a row, and how many each of them has.

        Equal stretches share a hash, so only one of each is looked up.
        """
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        _, first, which = np.unique(Hasher(data).of(starts, ends) + (ends - starts).astype(np.uint64), return_index=True, return_inverse=True)
        raw = data.tobytes()
        each = self.each([raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
        ids = np.frombuffer(b"".join(each), np.uint32)
        sizes = np.fromiter(map(len, each), np.int64, len(each)) // 4
        at = (np.cumsum(sizes) - sizes)[which]
        sizes = sizes[which]
        done = np.cumsum(sizes)
        return ids[np.repeat(at - (done - sizes), sizes) + np.arange(done[-1])], sizes
