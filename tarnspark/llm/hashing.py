"""Hashes of words, shingles and byte windows, made for a whole batch of texts at once."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(5)
_BYTE = _rng.integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C55  # odd, so it has an inverse modulo 2**64
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse up to n."""
    if len(_powers[0]) <= n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            x = np.full(n + 1, np.uint64(base))
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0][: n + 1], _powers[1][: n + 1]


class Windows:
    """Hashes of any stretch of a byte string, from prefix sums."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[:-1], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))

    def at(self, starts: np.ndarray, n: int) -> np.ndarray:
        """Of stretches of n bytes, as ``every`` has them."""
        return mix64((self.sums[starts + n] - self.sums[starts]) * self.down[starts])

    def every(self, n: int) -> np.ndarray:
        """Of all stretches of n bytes, by start."""
        m = len(self.sums) - n
        return mix64((self.sums[n:] - self.sums[:m]) * self.down[:m]) if m > 0 else np.zeros(0, np.uint64)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (split at ASCII white space) of all texts, and the number of words up to each text's end."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    turn = np.flatnonzero(np.diff(blank.astype(np.int8), prepend=np.int8(1)))
    starts, ends = turn[::2], turn[1::2]
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    return Windows(data).of(starts, ends), np.searchsorted(starts, text_ends)


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles of ``size`` words; of a shorter text, one of all its words."""
    found: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        stop, n = at, 0
        while stop < len(texts) and (n == 0 or n < 2 << 20):
            n += len(texts[stop] or "")
            stop += 1
        words, until = word_hashes([(t or "").encode().lower() for t in texts[at:stop]])
        rolled = np.zeros(0, np.uint64)
        if len(words) >= size:
            rolled = np.zeros(len(words) - size + 1, np.uint64)
            for k in range(size):
                rolled = mix64(rolled + words[k : len(words) - size + 1 + k] * np.uint64(2 * k + 1))
        begin = 0
        for end in until:
            if end - begin >= size:
                found.append(np.unique(rolled[begin : end - size + 1]))
            elif end > begin:
                short = np.full(1, end - begin, np.uint64)
                for k in range(begin, end):
                    short = mix64(short * np.uint64(3) + words[k : k + 1])
                found.append(short)
            else:
                found.append(np.zeros(0, np.uint64))
            begin = end
        at = stop
    return found
