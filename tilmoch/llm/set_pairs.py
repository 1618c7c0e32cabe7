"""Pairs of similar word sets: streamed pairing of keyed rows, and verification by banded dynamic programming.

A pair (A, B) has Jaccard similarity >= t exactly if |A ∆ B| <= (1-t)/(1+t) (|A|+|B|).
Read as strings of distinct words in one common order, |A ∆ B| is their edit
distance with insertions and deletions, so the similarity join is an edit-distance
join with a bound that depends on the two lengths.

Keyed rows carry a 64-bit parity sketch of their set: each word flips one bit.
Two sketches differ in at most |A ∆ B| bits, so pairs whose sketches differ in
more can be dropped without a look at the words (no true pair is lost).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilmoch.llm.codepoints import mix64, ranges

#: Rows of one key that are paired in memory; keys with more rows take the way of ``hot`` rows.
RUN_LIMIT = 4096
EPS = 1e-9


def edit_bound(threshold: float) -> float:
    return (1 - threshold) / (1 + threshold)


def parity_sketch(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """64 bits per set: the parity of its words' bits."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        bit = np.uint64(1) << (mix64(words.view(np.uint32).astype(np.uint64) + np.uint64(0x5851F42D)) & np.uint64(63))
        out[full] = np.bitwise_xor.reduceat(bit, (np.cumsum(counts) - counts)[full])
    return out


def run_pairs(key: np.ndarray, limit: int, side: np.ndarray | None = None, most: int = 1 << 20) -> tuple[Iterator[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Index pairs i < j of equal keys in a sorted array, for runs up to limit, in blocks of about most pairs; and the mask of rows in longer runs.

    With side (0 before 1 within a key) only pairs of a row of side 0 and one of side 1 are formed.
    """
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(start, len(key)))
    hot = np.repeat(size > limit, size)
    end = np.repeat(start + size, size)
    first = np.arange(1, len(key) + 1)
    if side is not None:
        first = np.where(side == 0, end - np.repeat(np.add.reduceat(side, start), size), end)
    n = np.where(hot, 0, end - first)
    total = np.cumsum(n)

    def blocks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        at = 0
        while at < len(key):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right")))
            yield np.repeat(np.arange(at, to), n[at:to]), np.repeat(first[at:to], n[at:to]) + ranges(n[at:to])
            at = to

    return blocks(), hot


PAIRS = "a bigint, b bigint, hot bigint, at bigint, label bigint"


def place(n: np.ndarray, pos: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Size, position and side of a keyed row in one number."""
    return (n.astype(np.int64) << 32) | (pos.astype(np.int64) << 1) | side.astype(np.int64)


def place_columns(at: str = "at") -> dict[str, Column]:
    a = F.col(at)
    return {"n": F.shiftright(a, 32), "pos": F.shiftright(a.bitwiseAND(0xFFFFFFFF), 1), "side": a.bitwiseAND(1)}


def paired(rows: DataFrame, keep: Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray], np.ndarray], limit: int = RUN_LIMIT, across: bool = False) -> DataFrame:
    """``(a, b, hot, at, label)`` for rows ``(key, nid, ...bigint columns)``: pairs of one key that pass keep.

    Rows are hash-partitioned by key and stream through each task in key order, so
    memory is bounded by a batch and one run. Rows of a key with more than limit
    rows come out as (nid, null, key, at, label) and are paired otherwise. Across, only
    pairs of two sides (the lowest bit of ``at``) are formed.
    """
    names = rows.columns
    none = lambda n: pa.nulls(n, pa.int64())

    def hot_rows(c: dict[str, np.ndarray]) -> pa.RecordBatch:
        n = len(c["nid"])
        more = [pa.array(c[x]) if x in c else none(n) for x in ("at", "label")]
        return pa.RecordBatch.from_arrays([pa.array(c["nid"]), none(n), pa.array(c["key"]), *more], ["a", "b", "hot", "at", "label"])

    def emit(cols: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        pairs, hot = run_pairs(cols["key"], limit, cols["at"] & 1 if across else None)
        for x, y in pairs:
            ok = keep(cols, x, y)
            a, b = cols["nid"][x[ok]], cols["nid"][y[ok]]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), none(len(a)), none(len(a)), none(len(a))], ["a", "b", "hot", "at", "label"])
        if hot.any():
            yield hot_rows({n: v[hot] for n, v in cols.items()})

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: dict[str, np.ndarray] | None = None
        longer = None  # the key of a run that went over the limit and is still open
        for batch in batches:
            cols = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in names}
            if not len(cols["key"]):
                continue
            if longer is not None:
                same = int(np.searchsorted(cols["key"] != longer, True)) if (cols["key"] != longer).any() else len(cols["key"])
                if same:
                    yield hot_rows({n: v[:same] for n, v in cols.items()})
                    cols = {n: v[same:] for n, v in cols.items()}
                if not len(cols["key"]):
                    continue
                longer = None
            if rest is not None:
                cols = {n: np.concatenate([rest[n], v]) for n, v in cols.items()}
            cut = int(np.searchsorted(cols["key"], cols["key"][-1]))
            if len(cols["key"]) - cut > limit:
                yield from emit(cols)
                longer, rest = cols["key"][-1], None
                continue
            yield from emit({n: v[:cut] for n, v in cols.items()}) if cut else ()
            rest = {n: v[cut:] for n, v in cols.items()}
        if rest is not None:
            yield from emit(rest)

    order = ["key", F.col("at").bitwiseAND(1)] if across else ["key"]
    return rows.repartition("key").sortWithinPartitions(*order).mapInArrow(stream, PAIRS)


def close_sketch(bound: float) -> Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray], np.ndarray]:
    """keep for ``paired``: sizes and sketches allow an edit distance within the bound."""

    def keep(c: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
        n = c["at"] >> 32
        most = bound * (n[i] + n[j]) + EPS
        ok = np.abs(n[i] - n[j]) <= most
        ok &= np.bitwise_count((c["sk"][i] ^ c["sk"][j]).view(np.uint64)) <= most
        return ok

    return keep


def allowed(threshold: float, d: int = 0) -> Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray], np.ndarray]:
    """keep for ``paired``: two strings whose common word d (from 0) is at these positions have room for enough common words, and near sketches.

    With a column ``label``, pairs of one label are dropped: they are connected already.
    """
    near = close_sketch(edit_bound(threshold))
    share = threshold / (1 + threshold)

    def keep(c: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
        n, p = c["at"] >> 32, (c["at"] & 0xFFFFFFFF) >> 1
        ok = d + np.minimum(n[i] - p[i], n[j] - p[j]) >= share * (n[i] + n[j]) - EPS
        if "label" in c:
            ok &= c["label"][i] != c["label"][j]
        ok[ok] = near(c, i[ok], j[ok])
        return ok

    return keep


def _flat(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    off = np.asarray(arr.offsets).astype(np.int64)
    return np.asarray(arr.flatten()), np.diff(off)


def banded_distance(a: np.ndarray, an: np.ndarray, b: np.ndarray, bn: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Insert-delete distance of each pair of strings, or most + 1 where it is more; all pairs advance together.

    A path of cost <= most from (0, 0) to (|a|, |b|) leaves the diagonals between its
    ends by at most (most - ||b| - |a||) / 2, so only those diagonals are filled. A
    pair is dropped once no cell can reach the end within its bound.
    """
    out = most + 1
    gap = bn - an
    slack = (most - np.abs(gap)) // 2
    live = np.flatnonzero(slack >= 0)
    a0, b0 = np.cumsum(an) - an, np.cumsum(bn) - bn
    width = np.abs(gap) + 2 * slack + 1
    order = live[np.lexsort((an[live], width[live]))]
    big = np.int32(1 << 28)
    for at in np.array_split(order, max(1, len(order) // 8192)):
        if not len(at):
            continue
        cells = np.arange(int(width[at].max()))
        lo = np.minimum(0, gap[at]) - slack[at]
        d = (lo[:, None] + cells).astype(np.int32)  # j - i of each cell
        row = np.where((d >= 0) & (d <= bn[at][:, None]), d, big)
        i = 0
        while len(at):
            ends = an[at] == i
            if ends.any():
                c = (gap[at] - lo)[ends]
                out[at[ends]] = np.minimum(row[np.flatnonzero(ends), c], most[at[ends]] + 1)
            go = ~ends & ((row + np.abs(gap[at][:, None] - d)).min(axis=1) <= most[at])
            if not go.all():
                at, lo, d, row = at[go], lo[go], d[go], row[go]
            if not len(at):
                break
            i += 1
            j = d + i
            inside = (j >= 0) & (j <= bn[at][:, None])
            wb = b[np.clip(b0[at][:, None] + j - 1, 0, len(b) - 1)]
            same = (a[a0[at] + i - 1][:, None] == wb) & (j >= 1)
            new = np.where(same & inside, row, big)
            new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)
            new = np.where(inside, new, big)
            new = np.minimum.accumulate(new - d, axis=1) + d  # insertions along the row
            row = np.where(inside, new, big).astype(np.int32)
    return out


def verified(pairs: DataFrame, sets: DataFrame, bound: float) -> DataFrame:
    """``(a, b)`` of pairs whose word sets (``sets: nid, w`` sorted in one order) are within the edit bound."""
    left = sets.select(F.col("nid").alias("a"), F.col("w").alias("wa"))
    right = sets.select(F.col("nid").alias("b"), F.col("w").alias("wb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "wa", "wb")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, an = _flat(batch.column("wa"))
            b, bn = _flat(batch.column("wb"))
            most = np.floor(bound * (an + bn) + EPS).astype(np.int64)
            ok = (banded_distance(a, an, b, bn, most) <= most) & (an > 0) & (bn > 0)
            if ok.any():
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(ok)), batch.column("b").filter(pa.array(ok))], ["a", "b"])

    return both.mapInArrow(check, "a bigint, b bigint")
