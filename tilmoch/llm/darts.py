"""DartMinHash signatures of weighted word sets, for whole batches at once.

Each element throws hashed darts at the plane of (weight, rank), the same darts
wherever the element occurs. A dart counts in a set if it lands below the element's
weight there. Every dart carries a coordinate; the earliest dart per coordinate is
the signature, so two sets agree in a coordinate with the probability of their
weighted Jaccard similarity.

The weight axis is split into dyadic strips: (1/2, 1], (1/4, 1/2], ... down to the
lowest, which reaches to 0. A strip of width v is cut into cells of rank length 1/v,
so each cell has area 1 and a Poisson(1) number of darts. An element only throws in
the strips that begin below its weight, so what it throws is in proportion to its
weight. Ranks are raised until every coordinate has a dart.
"""

from __future__ import annotations

import numpy as np

from tilmoch.llm.codepoints import mix64, ranges

#: Strips of the weight axis: the lowest begins at 0.
STRIPS = 7
_WIDTH = np.array([2.0 ** -(STRIPS - 1), *(2.0**-j for j in range(STRIPS - 1, 0, -1))])
_FLOOR = np.concatenate([[0.0], np.cumsum(_WIDTH)[:-1]])
#: Cumulative distribution of a Poisson(1) count, as 53-bit thresholds (a dozen darts in a cell is beyond them).
_POISSON = np.array([np.exp(-1) * sum(1 / np.prod(np.arange(1, j + 1, dtype=float)) for j in range(n + 1)) for n in range(12)])
_CUTS = (_POISSON * 2.0**53).astype(np.uint64)
#: The signature of a coordinate without a dart.
EMPTY = np.inf


def _throw(words: np.ndarray, weights: np.ndarray, counts: np.ndarray, k: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Earliest rank of each row and coordinate among the darts with lo <= rank < hi of its row."""
    rows = np.repeat(np.arange(len(counts)), counts)
    sig = np.full(len(counts) * k, EMPTY)
    for strip in range(STRIPS):
        own = np.flatnonzero(weights > _FLOOR[strip])
        if not len(own):
            continue
        width = _WIDTH[strip]
        first = np.floor(lo[rows[own]] * width).astype(np.int64)
        span = np.ceil(hi[rows[own]] * width).astype(np.int64) - first
        e = np.repeat(own, span)
        cell = (np.repeat(first, span) + ranges(span)).astype(np.uint64)
        base = mix64(words[e] ^ mix64((cell + np.uint64(1)) * np.uint64(STRIPS) + np.uint64(strip)))
        n = np.searchsorted(_CUTS, base >> np.uint64(11), side="right")
        d = np.repeat(np.arange(len(e)), n)
        h = mix64(base[d] + (ranges(n).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        h2 = mix64(h ^ np.uint64(0xD6E8FEB86659FD93))
        at = e[d]
        rank = (cell[d].astype(np.float64) + (h >> np.uint64(11)).astype(np.float64) * 2.0**-53) / width
        weight = _FLOOR[strip] + width * ((h2 >> np.uint64(32)).astype(np.float64) * 2.0**-32)
        good = (weight < weights[at]) & (rank >= lo[rows[at]]) & (rank < hi[rows[at]])
        coordinate = ((h2[good] & np.uint64(0xFFFFFFFF)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(sig, rows[at[good]] * k + coordinate, rank[good])
    return sig.reshape(-1, k)


def signatures(words: np.ndarray, weights: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Rows x k ranks of the earliest darts, which name them; weights lie in (0, 1]. A row without words has only empty coordinates."""
    sig = np.full((len(counts), k), EMPTY)
    mass = np.zeros(len(counts))
    full = np.flatnonzero(counts)
    if not len(full):
        return sig
    first = np.cumsum(counts) - counts
    mass[full] = np.add.reduceat(weights, first[full])
    todo = full
    lo = np.zeros(len(counts))
    hi = k * (np.log(k) + 1.5) / np.maximum(mass, 1e-9)
    while len(todo):
        pick = np.repeat(first[todo], counts[todo]) + ranges(counts[todo])
        new = _throw(words[pick], weights[pick], counts[todo], k, lo[todo], hi[todo])
        sig[todo] = np.minimum(sig[todo], new)  # later throws are of higher rank
        lo[todo], hi[todo] = hi[todo], 2 * hi[todo]
        todo = todo[np.isinf(sig[todo]).any(axis=1)]
    return sig


def bands(sig: np.ndarray, rows: int) -> np.ndarray:
    """Rows x bands keys: each band hashes its coordinates and its place."""
    b = sig.shape[1] // rows
    bits = np.ascontiguousarray(sig).view(np.uint64)
    key = np.broadcast_to(np.arange(b, dtype=np.uint64), (len(sig), b)).copy()
    for j in range(rows):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + bits[:, j : b * rows : rows])
    return key
