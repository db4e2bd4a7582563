"""Word shingles of one text as 64-bit hashes, and SuperMinHash signatures of them (numpy)."""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

WIDTH = 5
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xFFFFFFFF)
_HALF = np.uint64(32)
EMPTY_SLOT = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles of a UTF-8 text.

    A-Z become lower case and words end at ASCII white space. A text with fewer words is one
    shingle, the number of its words hashed along; one without words has none.
    """
    tokens = text.lower().split()
    n = len(tokens)
    if not n:
        return np.empty(0, np.uint64)
    hashed = np.fromiter(map(xxh3_64_intdigest, tokens), np.uint64, n)
    width = min(width, n)
    out = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        out = (out ^ hashed[k : n - width + 1 + k]) * _MULTIPLIER
        out ^= out >> np.uint64(29)
    return np.unique(mix(out))


def signatures(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """SuperMinHash of each set: in round j every element draws a fraction and the j-th entry of
    a random permutation of its own; the entry's slot keeps the least of (j, fraction).

    Later rounds only give larger values, so a set is done after the first round that leaves
    it no empty slot: one round or two for a set several times as large as ``slots``. The
    sets are worked on together, round by round. An empty set's slots stay ``EMPTY_SLOT``.
    """
    least = np.full(len(sets) * slots, EMPTY_SLOT, np.uint64)
    elements = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    first = np.repeat(np.arange(len(sets)) * slots, [len(s) for s in sets])  # slot 0 of the element's set
    drawn: list[np.ndarray] = []
    permutation = None
    for j in range(slots):
        x = mix(elements + np.uint64((int(_MULTIPLIER) * (j + 1)) % 2**64))
        pick = (np.uint64(j) + ((x & _LOW) * np.uint64(slots - j) >> _HALF)).astype(np.int64)
        if j == 0:
            slot = pick
        elif j == 1:
            slot = np.where(pick == drawn[0], 0, pick)  # the first swap put entry 0 there
        else:
            rows = np.arange(len(elements))
            if permutation is None:
                permutation = np.tile(np.arange(slots, dtype=np.int16), (len(elements), 1))
                for i, earlier in enumerate(drawn):
                    kept = permutation[:, i].copy()
                    permutation[:, i] = permutation[rows, earlier]
                    permutation[rows, earlier] = kept
            slot = permutation[rows, pick].astype(np.int64)
            permutation[rows, pick] = permutation[:, j]
        np.minimum.at(least, first + slot, (np.uint64(j) << _HALF) | (x >> _HALF))
        open_sets = (least.reshape(-1, slots) == EMPTY_SLOT).any(axis=1)
        alive = open_sets[first // slots]
        if not alive.any():
            break
        if not alive.all():
            elements, first, pick = elements[alive], first[alive], pick[alive]
            drawn = [d[alive] for d in drawn]
            permutation = None if permutation is None else permutation[alive]
        if j < 2:
            drawn.append(pick)
    return least.reshape(-1, slots)


def band_hashes(least: np.ndarray, bands: int) -> np.ndarray:
    """For each signature, one signed 64-bit hash for each of ``bands`` equal runs of slots."""
    rows = least.reshape(len(least), bands, -1)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), rows.shape[:2])
    for k in range(rows.shape[2]):
        out = mix((out + rows[:, :, k]) * _MULTIPLIER)
    return out.view(np.int64)
