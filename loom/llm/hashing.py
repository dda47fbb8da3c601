"""Vectorised hashing inside tasks: words, rolling hashes, window minima (numpy on whole texts)."""

from __future__ import annotations

import numpy as np

U = np.uint64
_ROOT = 0x9E3779B97F4A7C15
_INV = pow(_ROOT, -1, 2 ** 64)
_POWERS = {"up": np.ones(1, U), "down": np.ones(1, U)}
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads every input bit over the word."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTE_CODE = mixed(np.arange(1, 257, dtype=U) * U(_ROOT))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """root^0..n and its inverses modulo 2^64, kept for the longest text seen by the worker."""
    if len(_POWERS["up"]) <= n:
        m = max(n + 1, 2 * len(_POWERS["up"]))
        for name, root in (("up", _ROOT), ("down", _INV)):
            steps = np.full(m, U(root))
            steps[0] = U(1)
            _POWERS[name] = np.cumprod(steps, dtype=U)
    return _POWERS["up"], _POWERS["down"]


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """S with S[b] - S[a] = sum of codes[i] * root^i for a <= i < b."""
    up, _ = _powers(len(codes) + 1)
    out = np.zeros(len(codes) + 1, U)
    np.cumsum(codes * up[:len(codes)], dtype=U, out=out[1:])
    return out


def spans_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of codes[start:end] for each span; equal content at any place hashes alike."""
    _, down = _powers(len(sums))
    return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def rolling(sums: np.ndarray, n: int) -> np.ndarray:
    """spans_hash of all windows of n codes."""
    count = len(sums) - n
    if count <= 0:
        return np.zeros(0, U)
    _, down = _powers(len(sums))
    return mixed((sums[n:] - sums[:-n]) * down[:count] + U(n * 0xD6E8FEB86659FD93 % 2 ** 64))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of each word of UTF-8 text."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~SPACE[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_codes(data: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit code per word, with the words' byte spans."""
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + 32, data)
    start, end = word_spans(data)
    return spans_hash(prefix_sums(BYTE_CODE[data]), start, end), start, end


def window_minima(values: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every n consecutive values."""
    out, have = values, 1
    while have * 2 <= n:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = n - have
    return np.minimum(out[:-rest], out[rest:]) if rest else out
