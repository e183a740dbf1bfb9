"""Word shingle sets of whole texts as sorted 64-bit hashes, for a batch of texts at once."""

from __future__ import annotations

import numpy as np

_R = np.random.default_rng(0x5EED)
#: A random number for each byte; A-Z count as a-z.
BYTE = _R.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE[65:91] = BYTE[97:123]
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * STEP[3]
    x = (x ^ (x >> np.uint64(29))) * STEP[1]
    return x ^ (x >> np.uint64(32))


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and how many words each text has."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    joined = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    solid = np.flatnonzero(~SPACE[joined])
    if not len(solid):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    first = np.flatnonzero(np.diff(solid, prepend=-2) > 1)
    lens = np.diff(first, append=len(solid))
    power = np.multiply.accumulate(np.concatenate([[STEP[0]], np.full(max(0, lens.max() - 1), STEP[2], np.uint64)]))
    place = np.arange(len(solid)) - np.repeat(first, lens)
    with np.errstate(over="ignore"):
        hashes = mixed(np.add.reduceat(BYTE[joined[solid]] * power[place], first))
    ends = np.cumsum([len(x) + 1 for x in raw])
    upto = np.searchsorted(solid[first], ends)
    return hashes, np.diff(upto, prepend=0)


def shingle_sets(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all texts, one text after the other, sorted within each; and the size of each set.

    A text of fewer than `size` words, but one at least, has its whole sequence as its only shingle.
    """
    h, n = words(texts)
    begin = np.cumsum(n) - n
    doc = np.repeat(np.arange(len(texts)), n)
    place = np.arange(len(h)) - np.repeat(begin, n)
    with np.errstate(over="ignore"):
        s = np.zeros(max(0, len(h) - size + 1), np.uint64)
        for i in range(size):
            s = (s ^ (s >> np.uint64(31))) * STEP[2] + h[i : len(h) - size + 1 + i]
        whole = (place <= np.repeat(n, n) - size)[: len(s)]
        s, of = mixed(s[whole]), doc[: len(s)][whole]
        short = np.flatnonzero((n > 0) & (n < size))
        if len(short):
            extra = []
            for d in short:
                x = STEP[1] + np.uint64(n[d])
                for y in h[begin[d] : begin[d] + n[d]]:
                    x = (x ^ (x >> np.uint64(31))) * STEP[0] + y
                extra.append(x)
            s, of = np.concatenate([s, mixed(np.array(extra, np.uint64))]), np.concatenate([of, short])
    order = np.lexsort((s, of))
    s, of = s[order], of[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (of[1:] != of[:-1])
    return s[new], np.bincount(of[new], minlength=len(texts))


def set_class(s: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set: equal sets, equal names. Empty sets get 0."""
    out = np.zeros(len(n), np.uint64)
    if len(s):
        full = n > 0
        with np.errstate(over="ignore"):
            out[full] = mixed(np.add.reduceat(mixed(s ^ STEP[0]), (np.cumsum(n) - n)[full]) + n[full].astype(np.uint64) * STEP[1])
    return out
