"""Vectorised Rabin-Karp hashing over the code points of many texts at once (NumPy, whole batches)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_B = 0x9E3779B97F4A7C15 | 1
_BINV = pow(_B, -1, 1 << 64)
_POW: dict[int, np.ndarray] = {}
#: Code points hashed at once; a longer single text is hashed in one piece of its own.
CHUNK_CHARS = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    have = _POW.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_CHARS + (1 << 16))
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        have = _POW[base] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (splitmix finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def prefix(c: np.ndarray) -> np.ndarray:
    """P[i] = sum of c[j] * B^j for j < i, modulo 2^64."""
    out = np.zeros(len(c) + 1, dtype=np.uint64)
    np.cumsum((c.astype(np.uint64) + np.uint64(1)) * _powers(_B, len(c)), out=out[1:], dtype=np.uint64)
    return out


def spans(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end), equal for equal contents wherever they stand."""
    return mix((p[end] - p[start]) * _powers(_BINV, len(p))[start])


def windows(c: np.ndarray, k: int) -> np.ndarray:
    """Hash of every window of k code points; empty if c is shorter."""
    if len(c) < k:
        return np.zeros(0, dtype=np.uint64)
    p = prefix(c)
    return mix((p[k:] - p[:-k]) * _powers(_BINV, len(c) - k + 1))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every run of w entries, by doubling."""
    m, size = x, 1
    while size * 2 <= w:
        m = np.minimum(m[: len(m) - size], m[size:])
        size *= 2
    return np.minimum(m[: len(x) - w + 1], m[w - size : w - size + len(x) - w + 1])


def chunks(texts: list[str | None], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of texts whose joint length stays near the limit."""
    i, total = 0, 0
    for j, t in enumerate(texts):
        n = len(t) if t else 0
        if total and total + n > limit:
            yield i, j
            i, total = j, 0
        total += n
    if i < len(texts):
        yield i, len(texts)


def joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and the n + 1 offsets at which the texts begin and end."""
    lengths = np.fromiter((len(t) if t else 0 for t in texts), dtype=np.int64, count=len(texts))
    return codes("".join(t or "" for t in texts)), np.concatenate(([0], np.cumsum(lengths)))


def winnow(c: np.ndarray, offsets: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Selected k-windows (text index, position in the text, hash).

    Of every w neighbouring windows of one text the one of least hash is kept, so two texts that share k + w - 1
    code points keep at least one window of that stretch in common.
    """
    h = windows(c, k)
    if len(h) < w:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(0, dtype=np.uint64)
    bits = np.uint64(max(21, int(len(h)).bit_length()))
    packed = ((h >> bits) << bits) | np.arange(len(h), dtype=np.uint64)
    low = sliding_min(packed, w)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    first, last = owner[: len(low)], owner[k + w - 2 : k + w - 2 + len(low)]
    at = (low[first == last] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    at = at[np.concatenate(([True], at[1:] != at[:-1]))] if len(at) else at
    return owner[at], at - offsets[owner[at]], h[at]


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))
