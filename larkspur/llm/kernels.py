"""Vectorised text kernels: words, rolling hashes and grouping on flat byte arrays."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Fixed odd multiplier of the polynomial hash modulo 2^64, and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

_powers: dict[int, np.ndarray] = {}


def _table(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        have = np.full(size, base, U)
        have[0] = 1
        np.cumprod(have, out=have)
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial over the bytes, for span_hash()."""
    out = np.zeros(len(data) + 1, U)
    terms = data.astype(U)
    terms += U(1)
    terms *= _table(BASE, len(data))
    np.cumsum(terms, out=out[1:])
    return out


def running_hash(values: np.ndarray) -> np.ndarray:
    """prefix_hash() of 64-bit values."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(mix(values.astype(U) + U(1)) * _table(BASE, len(values)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans; equal bytes have equal hashes wherever they stand."""
    inverse = _table(INVERSE, len(prefix))
    return mix((prefix[end] - prefix[start]) * inverse[start])


def window_hash(prefix: np.ndarray, width: int) -> np.ndarray:
    """The hash of every window of so many bytes."""
    n = len(prefix) - width
    if n <= 0:
        return np.zeros(0, U)
    return mix((prefix[width : width + n] - prefix[:n]) * _table(INVERSE, n))


def fold_case(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, as bytes."""
    return np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint8)


def byte_class(outside: list[tuple[int, int]]) -> np.ndarray:
    """A table of 256 flags: false for the bytes in the inclusive ranges."""
    flags = np.ones(256, bool)
    for a, b in outside:
        flags[a : b + 1] = False
    return flags


#: `[^\x20\x09-\x0D]+`
NOT_SPACE = byte_class([(0x20, 0x20), (0x09, 0x0D)])
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after lower-casing
ALNUM = byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])


def words(data: np.ndarray, starts: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and document number of each word: a longest run of bytes of the class within one document."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    flags = inside[data]
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    begins = flags.copy()
    begins[1:] &= ~flags[:-1] | edge[1:n]
    ends = flags.copy()
    ends[:-1] &= ~flags[1:] | edge[1:n]
    a = np.flatnonzero(begins)
    return a, np.flatnonzero(ends) + 1, np.searchsorted(starts, a, "right") - 1


def first_of(sorted_docs: np.ndarray, n_docs: int) -> np.ndarray:
    """Where the entries of each document begin in an array ordered by document (one more at the end)."""
    return np.searchsorted(sorted_docs, np.arange(n_docs + 1))


def ngrams(word_hash: np.ndarray, n: int) -> np.ndarray:
    """The hash of each n consecutive words; windows over a document's end must be masked by the caller."""
    size = len(word_hash) - n + 1
    if size <= 0:
        return np.zeros(0, U)
    out = word_hash[:size].copy()
    for k in range(1, n):
        out *= U(BASE)
        out += word_hash[k : k + size]
    return mix(out)


def repeated(keys: np.ndarray) -> np.ndarray:
    """Flags of the values that stand in the array twice or more."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def seen_before(keys: np.ndarray) -> np.ndarray:
    """Flags of the values that stand further left in the array too."""
    order = np.argsort(keys, kind="stable")
    out = np.zeros(len(keys), bool)
    out[order[1:][keys[order][1:] == keys[order][:-1]]] = True
    return out


def run_starts(x: np.ndarray) -> np.ndarray:
    """Begin of each run of equal values."""
    if not len(x):
        return np.zeros(0, np.int64)
    return np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1])


def covered(n: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Flags of the places that lie in any of the half-open spans."""
    change = np.bincount(begin, minlength=n + 1) - np.bincount(end, minlength=n + 1)
    return np.cumsum(change[:n]) > 0


def spans_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The longest runs of set flags as half-open spans."""
    change = np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8))
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)
