"""Token ids of whole Arrow columns of text by a public byte-level BPE tokenizer (runs inside Spark tasks).

A space between two characters that aren't white space always begins a pre-token of a byte-level BPE, so a text can be
cut there and each distinct piece ("unit") encoded once and looked up from then on; the ids equal those of the whole text.
"""

from __future__ import annotations

import os
from functools import cache

import numpy as np
import pyarrow as pa

from . import words

MOST_UNITS = 1_500_000  # units that a worker remembers before it starts anew: about 60 MB
JOINED = 2000


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.wide = max(vocabulary.values(), default=0) >= 2**16
        self.kind = np.dtype("<u4" if self.wide else "<u2")
        self.spaced = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)  # ids whose text begins with a space
        self.spaced[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True
        self._clear()

    def _clear(self) -> None:
        self.key, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.at, self.n, self.used = np.zeros(1 << 16, self.kind), np.zeros(1 << 12, np.int64), 0, 0

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)(texts, add_special_tokens=False)]

    def _keep(self, flat: np.ndarray, n: np.ndarray) -> None:
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + len(n) + 1 > len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.at[self.n + 1 : self.n + len(n) + 1] = self.used + np.cumsum(n)
        self.used, self.n = self.used + len(flat), self.n + len(n)

    def _learn(self, key: np.ndarray, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Encode new units: those with one space, their first character, many at once, for in what comes back exactly the units' first ids begin with a space."""
        data = raw.tobytes()
        spaces = np.concatenate([[0], np.cumsum(raw == 32)])
        plain = (raw[start] == 32) & (spaces[end] - spaces[start] == 1) & (raw[end - 1] > 32) & (end - start > 1)
        order = np.argsort(~plain, kind="stable")
        plain = int(plain.sum())
        first = self.n
        for a in range(0, plain, JOINED):
            some = order[a : min(plain, a + JOINED)]
            flat = np.array(self._encode([b"".join(data[start[i] : end[i]] for i in some).decode()])[0], self.kind)
            heads = np.flatnonzero(self.spaced[flat])
            if len(heads) != len(some):
                raise ValueError("this tokenizer doesn't begin words with their space")
            self._keep(flat, np.diff(heads, append=len(flat)))
        for x in self._encode([data[start[i] : end[i]].decode() for i in order[plain:]]):
            self._keep(np.array(x, self.kind), np.array([len(x)]))
        slot = np.empty(len(key), np.int64)
        slot[order] = np.arange(first, self.n)
        to = np.searchsorted(self.key, key)
        self.key, self.slot = np.insert(self.key, to, key), np.insert(self.slot, to, slot)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids end to end, and the number of each text's ids. Null texts have none."""
        raw, at = words.buffers(column)
        start = _cuts(raw, at)
        if not len(start):
            return np.zeros(0, self.kind), np.zeros(len(column), np.int64)
        end = np.append(start[1:], len(raw))
        key = words._ranges(words._BYTE[raw], start, end, words._BYTES)
        if self.n > MOST_UNITS:
            self._clear()
        new = np.flatnonzero(~self._known(key))
        fresh, first = np.unique(key[new], return_index=True)
        if len(fresh):
            self._learn(fresh, raw, start[new[first]], end[new[first]])
        unit = self.slot[np.searchsorted(self.key, key)]
        n = self.at[unit + 1] - self.at[unit]
        to = np.cumsum(n)
        flat = self.ids[np.repeat(self.at[unit] - (to - n), n) + np.arange(int(n.sum()))]
        total = np.concatenate([[0], to])
        edge = np.searchsorted(start, at)
        return flat, total[edge[1:]] - total[edge[:-1]]

    def _known(self, key: np.ndarray) -> np.ndarray:
        if not len(self.key):
            return np.zeros(len(key), dtype=bool)
        return self.key[np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)] == key


@cache
def encoder(path: str) -> Encoder:
    """A worker's encoder: what it has learned in one task serves the next."""
    return Encoder(path)


def _cuts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where units begin: each text's first byte, and each space between two characters that aren't white space."""
    if not len(raw):
        return np.zeros(0, np.int64)
    b = np.concatenate([np.full(3, 32, np.uint8), raw, np.full(1, 32, np.uint8)])
    i = np.flatnonzero(b == 32)
    i = i[(i >= 4) & (i < len(b) - 1)]
    before, after = b[i - 1], b[i + 1]
    fine = (before > 32) & (before != 127) & (after > 32) & (after != 127)
    # characters that might be one of Unicode's white spaces: those that begin with C2, E1, E2 or E3
    odd = lambda x: (x == 0xC2) | ((x >= 0xE1) & (x <= 0xE3))
    fine &= ~odd(after) & ~((before >= 0x80) & ((b[i - 2] == 0xC2) | odd(b[i - 3])))
    begins = np.zeros(len(raw), dtype=bool)
    begins[i[fine] - 3] = begins[at[:-1][np.diff(at) > 0]] = True
    return np.flatnonzero(begins)
