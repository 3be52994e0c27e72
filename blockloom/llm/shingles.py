"""Sets of hashed word shingles and their one-permutation signatures, in numpy."""

from __future__ import annotations

import numpy as np

from .tokens import slices

WORDS_EACH = 5
_RNG = np.random.default_rng(20240601)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _RNG.integers(1, 2**63, WORDS_EACH + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP = 1_000_000
_POWERS: list[np.ndarray] = []


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size, out = max(n, _STEP + 64), []
        for b in (_BASE, _INVERSE):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            out.append(np.cumprod(x))
        _POWERS[:] = out
    return _POWERS[0], _POWERS[1]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the words of data, a hash depending on the word's bytes only."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    edge = np.diff(_SPACE[b].astype(np.int8), prepend=1, append=1)
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    power, inverse = _powers(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * power[: len(b)], out=total[1:])
    return starts, mix64((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def _words(data: bytes) -> np.ndarray:
    """Hashes of the words of one text of any length, in steps that end at white space."""
    out, at = [], 0
    while at < len(data):
        end = at + _STEP
        if end < len(data):
            while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
                end += 1
        out.append(word_hashes(data[at:end])[1])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _windows(w: np.ndarray) -> np.ndarray:
    n = len(w) - WORDS_EACH + 1
    h = np.zeros(n, np.uint64)
    for k in range(WORDS_EACH):
        h += w[k : k + n] * _MIX[k]
    return h


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Of every text the sorted distinct 64-bit hashes of its shingles of WORDS_EACH words, A-Z lower-cased; of a text
    with fewer words one hash of all of them; of a text without words an empty array."""
    out = []
    for a, b in slices(len(texts), [len(t) for t in texts], _STEP):
        datas = [t.encode("utf-8", "surrogatepass").lower() for t in texts[a:b]]  # bytes: only A-Z change
        if sum(map(len, datas)) <= 4 * _STEP:
            starts, w = word_hashes(b"\n".join(datas))
            ends = np.searchsorted(starts, np.cumsum([len(d) + 1 for d in datas]))
        else:
            each = [_words(d) for d in datas]
            w, ends = np.concatenate(each), np.cumsum([len(x) for x in each])
        h = mix64(_windows(w)) if len(w) >= WORDS_EACH else None
        at = 0
        for end in ends.tolist():
            n = end - at
            if n >= WORDS_EACH:
                out.append(np.unique(h[at : end - WORDS_EACH + 1]))
            elif n:
                short = _MIX[WORDS_EACH : WORDS_EACH + 1] * np.uint64(n)
                for k in range(at, end):
                    short = mix64(short + w[k : k + 1])
                out.append(short)
            else:
                out.append(np.zeros(0, np.uint64))
            at = end
    return out


class Signer:
    """One-permutation hashing: the hash's high bits name a bin, a bin keeps its least hash; a bin that stays empty
    borrows from bins drawn by hashes of (bin, attempt), the same for all sets, until one is not empty (optimal
    densification), so two sets agree in a bin with probability equal to their similarity."""

    def __init__(self, bins: int, bands: int) -> None:
        assert bins & (bins - 1) == 0
        self.bins, self.bands, self.rows = bins, bands, bins // bands
        self.edges = np.arange(bins, dtype=np.uint64) << np.uint64(64 - bins.bit_length() + 1)
        tries = np.arange(1, 64, dtype=np.uint64)[:, None] * np.uint64(bins) + np.arange(bins, dtype=np.uint64)
        self.donors = (mix64(tries * _MIX[0]) >> np.uint64(33)).astype(np.int64) % bins
        self.salt = mix64(np.arange(1, bands + 1, dtype=np.uint64) * _MIX[1])

    def sign(self, s: np.ndarray) -> np.ndarray:
        at = np.searchsorted(s, self.edges)
        has = at < np.append(at[1:], len(s))
        sig = np.zeros(self.bins, np.uint64)
        sig[has] = s[at[has]]
        left = np.flatnonzero(~has)
        for row in self.donors:
            if not len(left):
                break
            d = row[left]
            found = has[d]
            sig[left[found]] = sig[d[found]]
            left = left[~found]
        if len(left):  # after 63 draws: the next bin that is not empty
            full = np.flatnonzero(has)
            sig[left] = sig[full[np.searchsorted(full, left) % len(full)]]
        return sig

    def band_keys(self, sig: np.ndarray) -> np.ndarray:
        part = sig[: self.bands * self.rows].reshape(self.bands, self.rows)
        h = self.salt.copy()
        for k in range(self.rows):
            h = mix64(h * _MIX[2] + part[:, k])
        return h
