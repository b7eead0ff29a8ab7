"""Word shingles of many texts at once, as 64-bit hashes."""

from __future__ import annotations

import hashlib

import numpy as np

WORDS = 5
#: Fixed random odd numbers for mixing.
_RANDOM = np.random.Generator(np.random.PCG64(20))
_BYTE = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RANDOM.integers(0, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        _powers[name] = np.multiply.accumulate(steps)
    return _powers[name][:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words (runs without ASCII white space), and where each text's words begin; one more end."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = _SPACE[data]
    edges = np.diff(space.astype(np.int8), prepend=np.int8(1))
    starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * _power("up", _BASE, len(data)), dtype=np.uint64)])
    hashes = mixed((sums[ends] - sums[starts]) * _power("down", _BACK, len(data))[starts] + (ends - starts).astype(np.uint64))
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    return hashes, np.searchsorted(starts, begins)


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The shingles of all texts in order (repeats included), where each text's begin, and a digest of each text's words.

    A text of fewer than ``WORDS`` words is one shingle; one without words has none.
    """
    hashes, begins = word_hashes(texts)
    digests = [hashlib.md5(hashes[a:b].tobytes()).digest() for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]
    n_words = np.diff(begins)
    padded = np.concatenate([hashes, np.zeros(WORDS, np.uint64)])
    total = np.zeros(len(hashes), dtype=np.uint64)
    for j in range(WORDS):
        total += padded[j : j + len(hashes)] * _PLACE[j]
    counts = np.where(n_words >= WORDS, n_words - WORDS + 1, np.minimum(n_words, 1))
    offsets = np.concatenate([[0], np.cumsum(counts)])
    at = np.repeat(begins[:-1] - offsets[:-1], counts) + np.arange(offsets[-1])
    out = mixed(total[at])
    for i in np.flatnonzero((n_words > 0) & (n_words < WORDS)):
        own = hashes[begins[i] : begins[i + 1]]
        out[offsets[i]] = mixed(np.array([(own * _PLACE[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))]))[0]
    return out, offsets, digests


def portions(texts: list[bytes], size: int = 1 << 20):
    """The texts in runs of about ``size`` bytes; a longer text is a run of its own."""
    some, held = [], 0
    for t in texts:
        if some and held + len(t) > size:
            yield some
            some, held = [], 0
        some.append(t)
        held += len(t)
    if some:
        yield some
