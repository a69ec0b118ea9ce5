"""Word hashes of many texts at once, by array operations over their bytes."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Bytes that are worked on at once.
CHUNK = 1 << 18

_byte = np.arange(256)
#: Letters, digits and every byte of a non-ASCII character.
ALNUM = ((_byte >= 48) & (_byte <= 57)) | ((_byte >= 65) & (_byte <= 90)) | ((_byte >= 97) & (_byte <= 122)) | (_byte >= 128)
#: Everything but the six white-space characters of ASCII.
NOT_BLANK = ~(((_byte >= 9) & (_byte <= 13)) | (_byte == 32))
_LOWER = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte).astype(np.uint64) + np.uint64(1)

_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64, for i below n."""
    global _powers
    if len(_powers[0]) < n:
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            up, down = np.full(n, BASE), np.full(n, inverse)
            up[0] = down[0] = 1
            _powers = np.cumprod(up), np.cumprod(down)
    return _powers


def forget() -> None:
    """Drop the powers; those of a very long text would stay in memory as long as the worker lives."""
    global _powers
    _powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters close ones (the finaliser of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Scan:
    """The words of all texts as places in their joined bytes (``start``, ``end``), and where each text's words begin (``bounds``, one
    more entry than texts)."""

    def __init__(self, texts: list[bytes], member: np.ndarray = ALNUM):
        raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        first = np.concatenate([[0], np.cumsum(sizes)])
        edge = np.flatnonzero(np.diff(member[raw].view(np.int8), prepend=np.int8(0)))
        self.raw, self.start, self.end = raw, edge[::2], edge[1::2]
        self.bounds = np.searchsorted(self.start, first)
        with np.errstate(over="ignore"):
            up, self.down = powers(len(raw) + 1)
            self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LOWER[raw] * up[: len(raw)])])

    def _hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.total[end] - self.total[start]) * self.down[start] + (end - start).astype(np.uint64))

    def hashes(self) -> np.ndarray:
        """Of whole words, A-Z taken as a-z."""
        return self._hash(self.start, self.end)

    def beginnings(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Which words have ``n`` bytes or more, and the hashes of their first ``n``."""
        long = np.flatnonzero(self.end - self.start >= n)
        return long, self._hash(self.start[long], self.start[long] + n)


def word_hashes(texts: list[bytes], member: np.ndarray = ALNUM) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, A-Z taken as a-z, and where each text's words begin (one more entry than texts)."""
    scan = Scan(texts, member)
    return scan.hashes(), scan.bounds


class Lookup:
    """Which of many hashes are among the sorted ``keys``? A table of bits answers for most."""

    def __init__(self, keys):
        self.keys = np.unique(np.asarray(keys, np.uint64))
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def find(self, h):
        """Positions in ``h`` that hold a key, and the key's number."""
        if not len(self.keys) or not len(h):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.flatnonzero(self.bits[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        same = self.keys[k] == h[at]
        return at[same], k[same]


def shingle_hashes(h: np.ndarray, bounds: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words, and where each text's begin. A text of fewer words is one run; one without words has none."""
    size = np.diff(bounds)
    with np.errstate(over="ignore"):
        runs = np.zeros(len(h), np.uint64)
        for k in range(n):  # the last n - 1 of each text are overwritten or left out below
            part = h[k:]
            runs[: len(part)] = runs[: len(part)] * np.uint64(0x100000001B3) + part
        for i in np.flatnonzero((size > 0) & (size < n)):
            x = np.uint64(size[i])
            for w in h[bounds[i] : bounds[i + 1]]:
                x = x * np.uint64(0x100000001B5) + w
            runs[bounds[i]] = x
    count = np.where(size >= n, size - n + 1, np.minimum(size, 1))
    keep = np.repeat(bounds[:-1], count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
    return mix(runs[keep]), np.concatenate([[0], np.cumsum(count)])


def in_chunks(texts: list[bytes], most: int = CHUNK):
    """Slices of ``texts`` of about ``most`` bytes, a longer text alone."""
    i = 0
    while i < len(texts):
        j, size = i + 1, len(texts[i])
        while j < len(texts) and size + len(texts[j]) <= most:
            size += len(texts[j])
            j += 1
        yield i, j
        i = j


def small_batches(batches, rows: int = 500):
    """Arrow batches cut small, so that a worker never holds the texts of a whole batch as Python strings."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
