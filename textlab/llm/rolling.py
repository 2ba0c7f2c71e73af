"""Vectorised hashing of words, shingles and windows (numpy, used inside tasks).

Words are the maximal runs of bytes other than 0x20 and 0x09-0x0D of the UTF-8
text.  A word's 64-bit hash is a polynomial over random byte values, mixed; a
window's hash is a polynomial over its symbols' hashes.  Long texts go through
in pieces of ``PIECE`` bytes cut at white space, so that working memory stays
bounded by the piece (or the longest word)."""

from __future__ import annotations

import numpy as np

U = np.uint64
MASK = (1 << 64) - 1
PIECE = 1 << 21
_ODD = 0x9E3779B97F4A7C15 | 1
_INV = pow(_ODD, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTE = mix64(np.arange(1, 257, dtype=U) * U(_ODD))
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64 (kept, grown by doubling)."""
    p = _powers.get(base, np.ones(1, U))
    while len(p) < n:
        p = np.concatenate([p, p * U(pow(base, len(p), 1 << 64))])
    _powers[base] = p
    return p[:n]


def word_bounds(buf: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a byte array."""
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = ~gap[buf]
    d = np.diff(inside)
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def _pieces(raw: bytes):
    at = 0
    while len(raw) - at > PIECE:
        end = at + PIECE
        cut = max(raw.rfind(b" ", at, end), raw.rfind(b"\n", at, end))
        while cut <= at and end < len(raw):  # one word longer than a piece
            s, n = raw.find(b" ", end), raw.find(b"\n", end)
            cut = end = min(x if x >= 0 else len(raw) for x in (s, n))
        yield at, raw[at:cut]
        at = cut
    yield at, raw[at:]


def word_hashes(raw: bytes, gap: np.ndarray = SPACE) -> np.ndarray:
    """Hash of every word of UTF-8 bytes, in order; ``gap`` marks the bytes between words."""
    out = []
    for _, piece in _pieces(raw):
        buf = np.frombuffer(piece, np.uint8)
        s, e = word_bounds(buf, gap)
        if not len(s):
            continue
        n = e - s
        ends = np.cumsum(n)
        # bytes of all words on end; position of each within its word
        body = buf[~gap[buf]]
        within = np.arange(len(body)) - np.repeat(ends - n, n)
        value = BYTE[body] * powers(_ODD, int(n.max()))[within]
        out.append(mix64(np.add.reduceat(value, ends - n) + n.astype(U) * U(0xD6E8FEB86659FD93)))
    return np.concatenate(out) if out else np.zeros(0, U)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the distinct k-word shingles, sorted.  Fewer than k words: the
    whole sequence is the only shingle; no words: none."""
    if not len(words):
        return np.zeros(0, U)
    m = min(k, len(words))
    h = np.zeros(len(words) - m + 1, U)
    for i in range(m):
        h = h * U(0xC2B2AE3D27D4EB4F) + words[i:len(words) - m + 1 + i]
    return np.unique(mix64(h + U(m)))


class Windows:
    """Prefix sums over symbol hashes: the hash of any range in O(1)."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.sum = np.zeros(n + 1, U)
        np.cumsum(symbols * powers(_ODD, n), out=self.sum[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sum[end] - self.sum[start]) * powers(_INV, len(self.sum))[start]
                     + (end - start).astype(U) * U(0xA0761D6478BD642F))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    pad = -len(x) % w
    blocks = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1:w - 1 + n])
