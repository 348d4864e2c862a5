"""Words and word shingles of many texts at once, as 64-bit hashes in flat arrays."""

from __future__ import annotations

import numpy as np

#: Words in a shingle.
SHINGLE = 5
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
# Letters, digits and every byte of a letter outside ASCII belong to words.
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_powers: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(kind: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), _U(base), np.uint64)
        steps[0] = 1
        have = _powers[kind] = np.cumprod(steps)
    return have[:n]


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every word: runs of letters and digits, lower-cased."""
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    inside = _IN_WORD[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside)).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    # A polynomial over the bytes, taken as a difference of sums and moved to the front; arithmetic is modulo 2^64.
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + _U(1)) * _power("up", _BASE, len(data)), out=sums[1:])
    hashes = mix64((sums[ends] - sums[starts]) * _power("down", _BACK, len(data))[starts] + (ends - starts).astype(np.uint64))
    borders = np.cumsum([len(r) + 1 for r in raw])
    return np.searchsorted(borders, starts, side="right"), hashes


def shingles(texts: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, count), each shingle once per text, sorted; a text of fewer words is one shingle."""
    text, hashes = words(texts)
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    whole = np.ones(n, bool)
    for j in range(size):
        fits = np.zeros(n, bool)
        fits[: n - j] = text[j:] == text[: n - j]
        total[fits] += mix64(hashes[np.flatnonzero(fits) + j] + _U(j + 1))
        whole &= fits
    first = np.concatenate(([True], text[1:] != text[:-1]))
    short = np.bincount(text, minlength=len(texts))[text] < size
    keep = whole | (first & short)
    text, total = text[keep], mix64(total[keep])
    order = np.lexsort((total, text))
    text, total = text[order], total[order]
    new = np.concatenate(([True], (text[1:] != text[:-1]) | (total[1:] != total[:-1])))
    at = np.flatnonzero(new)
    return text[at], total[at], np.diff(np.append(at, len(text)))
