"""Word shingles as 64-bit hashes, many documents at once in numpy."""

from collections.abc import Iterator

import numpy as np

#: Bytes to bytes: A-Z become a-z, white space becomes a space.
LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if b in b" \t\n\v\f\r" else b for b in range(256))
SAME = bytes(32 if b in b" \t\n\v\f\r" else b for b in range(256))

_random = np.random.Generator(np.random.PCG64(7))
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least n of them."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        up = np.full(size, _BASE, np.uint64)
        down = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[size]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def chunks(texts: list[str], size: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Runs of texts of about so many characters; a longer text is a run alone."""
    at = 0
    while at < len(texts):
        to, chars = at + 1, len(texts[at])
        while to < len(texts) and chars + len(texts[to]) <= size:
            chars += len(texts[to])
            to += 1
        yield at, to
        at = to


class Words:
    """Words of several texts in one byte string, with hashes of any run of words."""

    def __init__(self, texts: list[str], fold: bytes):
        split = [t.encode().translate(fold).split() for t in texts]
        self.counts = np.array([len(w) for w in split], np.int64)
        raw = np.frombuffer(b" ".join(b" ".join(w) for w in split if w) + b" ", np.uint8)
        n = self.counts.sum()
        gaps = np.flatnonzero(raw == 32) if n else np.zeros(0, np.int64)
        self.starts, self.ends = np.append(0, gaps[:-1] + 1)[:n], gaps
        self.firsts = np.cumsum(self.counts) - self.counts
        up, self.down = _power_tables(len(raw) + 1)
        self.sums = np.append(np.uint64(0), np.cumsum(_BYTE[raw] * up[: len(raw)]))

    def hashes(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of the words first..last of each pair, single spaces between them."""
        s, e = self.starts[first], self.ends[last]
        return mix((self.sums[e] - self.sums[s]) * self.down[s] + (e - s).astype(np.uint64))


def shingle_sets(texts: list[str], k: int = 5, fold: bytes = LOWER) -> list[np.ndarray]:
    """Each text's sorted distinct k-word shingles; fewer words are one shingle, none give none."""
    w = Words(texts, fold)
    wide = np.maximum(w.counts - k + 1, (w.counts > 0).astype(np.int64))
    offsets = np.cumsum(wide) - wide
    first = np.repeat(w.firsts - offsets, wide) + np.arange(wide.sum())
    last = np.minimum(first + k - 1, np.repeat(w.firsts + w.counts - 1, wide))
    h = w.hashes(first, last)
    return [np.unique(x) for x in np.split(h, offsets[1:])] if len(texts) else []
