"""Filling fixed-capacity containers: multiway Karmarkar-Karp differencing in blocks."""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilmoch.session import shared_table

#: Expected documents per block; a block is packed in one task.
BLOCK = 4096


def differencing(sizes: Sequence[int], k: int) -> list[tuple[int, object]]:
    """k near-equal windows by the largest differencing method.

    A partial partition is a sorted list of (sum, place, members) windows, missing
    windows being empty. The two partitions with the largest difference between
    their fullest and emptiest window are merged with opposing imbalances: the
    fullest windows of one meet the emptiest of the other.
    """
    heap: list[tuple[int, int, list]] = []
    for i, s in enumerate(sizes):
        heap.append((-s if k > 1 else 0, i, [(s, i, i)]))
    heapq.heapify(heap)
    place = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(a) < len(b):
            a, b = b, a
        over = len(a) + len(b) - k
        if len(b) == 1:
            s, _, m = b[0]
            if over > 0:
                s0, _, m0 = a.pop(0)
                s, m = s + s0, (m0, m)
            insort(a, (s, place, m))
            merged = a
        elif over <= 0:
            merged = sorted(a + b, key=lambda x: x[:2])
        else:
            joint = [(x[0] + y[0], place, (x[2], y[2])) for x, y in zip(reversed(a[:over]), b[:over])]
            merged = sorted(joint + a[over:] + b[over:], key=lambda x: x[:2])
            merged = [(s, place * (k + 1) + j, m) for j, (s, _, m) in enumerate(merged)]
        place += 1
        low = merged[0][0] if len(merged) == k else 0
        heapq.heappush(heap, (low - merged[-1][0], place, merged))
    return [(s, m) for s, _, m in heap[0][2]] if heap else []


def members(tree: object) -> list[int]:
    out, stack = [], [tree]
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):
            stack += x
        else:
            out.append(x)
    return out


def _repaired(windows: list[tuple[int, object]], sizes: Sequence[int], capacity: int, rounds: int = 4) -> list[list[int]] | None:
    """Windows none of which is above capacity, by moving items out of overfull ones; None if some find no place.

    What an overfull window gives up is its smallest items, largest of these first,
    until the rest fits. They go where they leave the least room. While some find no
    place, the emptiest windows are emptied too and all is placed again, largest first.
    """
    boxes, load, loose = [], [], []
    for s, m in windows:
        own = sorted(members(m), key=lambda i: sizes[i])
        while s > capacity:
            i = next((j for j, x in enumerate(own) if sizes[x] >= s - capacity), len(own) - 1)
            s -= sizes[own[i]]
            loose.append(own.pop(i))
        boxes.append(own)
        load.append(s)
    for again in range(rounds + 1):
        room = sorted((capacity - s, j) for j, s in enumerate(load))
        left = []
        for i in sorted(loose, key=lambda i: -sizes[i]):
            at = bisect_left(room, (sizes[i], -1))
            if at == len(room):
                left.append(i)
                continue
            r, j = room.pop(at)
            boxes[j].append(i)
            load[j] += sizes[i]
            insort(room, (r - sizes[i], j))
        if not left:
            return boxes
        if again == rounds or sum(sizes[i] for i in left) > sum(r for r, _ in room):
            return None
        loose = left
        for _, j in room[-(len(left) << (again + 2)) :]:
            loose += boxes[j]
            boxes[j], load[j] = [], 0
    return None


def fill_windows(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window of each item, none above capacity (items must fit).

    The window count starts at a lower bound; windows that differencing leaves
    overfull are repaired, and where that fails the count rises.
    """
    if not len(sizes):
        return np.zeros(0, np.int64)
    order = np.argsort(-sizes, kind="stable")
    s = sizes[order].tolist()
    big = int((sizes * 2 > capacity).sum())  # no two of these share a window
    k = max(1, -(-int(sizes.sum()) // capacity), big)
    fit = lambda k: _repaired(differencing(s, k), s, capacity)
    boxes, low, step = fit(k), k - 1, 1
    while boxes is None:  # the rise doubles until everything fits, then the last rise is halved down
        low, k, step = k, k + step, 2 * step
        boxes = fit(k)
    while k - low > 1:
        mid = (k + low) // 2
        fewer = fit(mid)
        if fewer is None:
            low = mid
        else:
            k, boxes = mid, fewer
    out = np.zeros(len(sizes), np.int64)
    for j, m in enumerate(boxes):
        out[order[m]] = j
    return out


def place_block(ids: np.ndarray, sizes: np.ndarray, capacity: int) -> dict[str, np.ndarray]:
    """Parts, containers and sums of one block: oversized items first fill containers of their own, their rest is packed with the others."""
    whole = sizes // capacity
    rest = sizes - whole * capacity
    own = np.where(sizes > capacity, whole, 0)
    left = np.where(sizes > capacity, rest, sizes)
    keep = (left > 0) | (own == 0)  # what exactly fills its containers leaves no rest
    n_own = int(own.sum())
    idx = np.flatnonzero(keep)
    window = fill_windows(left[idx], capacity)
    row = np.concatenate([np.repeat(np.arange(len(ids)), own), idx])
    part = np.concatenate([_ranges(own), own[idx]])
    tokens = np.concatenate([np.full(n_own, capacity), left[idx]])
    box = np.concatenate([np.arange(n_own), window + n_own])
    total = np.bincount(box, weights=tokens).astype(np.int64)[box] if len(box) else box
    return {"doc": ids[row], "part": part, "tokens": tokens, "box": box, "total": total}


def _ranges(n: np.ndarray) -> np.ndarray:
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def pack(items: DataFrame, capacities: Iterable[tuple[int, int]], block: int = BLOCK) -> DataFrame:
    """``(spec_id, doc_id, part, tokens, container_id, container_tokens, capacity_tokens)``.

    items has ``doc_id bigint, tokens bigint`` with one row per document;
    capacities are (spec_id, capacity) pairs, a parameter table. An item above a
    capacity is cut into full containers of its own and a rest that is packed like
    any item; no other item is split. Items of 0 or null tokens take part with size
    0. Blocks are drawn by a hash of the id, about ``block`` items each whatever the
    number of items, and packed independently, many by one task where there are many;
    each may end with a container that another block could have filled. Null or
    non-positive capacities are left out; no items or no capacities give an empty
    result.
    """
    specs = sorted({(int(i), int(c)) for i, c in capacities if i is not None and c is not None and c > 0})
    rows = items.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens"))
    rows = shared_table(rows, "sizes")  # read twice: the items are not counted token by token again
    n = rows.count()
    blocks = max(1, -(-n // block))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)))
    names = ["spec_id", "doc_id", "part", "tokens", "container_id", "container_tokens", "capacity_tokens"]

    def run(t: pa.Table) -> pa.Table:
        order = np.argsort(t["doc_id"].to_numpy(), kind="stable")
        ids, sizes = t["doc_id"].to_numpy()[order], t["tokens"].to_numpy()[order]
        base = int(t["block"][0].as_py()) << 32
        out = []
        for spec, capacity in specs:
            p = place_block(ids, sizes, capacity)
            m = len(p["doc"])
            cols = [np.full(m, spec), p["doc"], p["part"], p["tokens"], p["box"] + base, p["total"], np.full(m, capacity)]
            out.append(pa.Table.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names))
        return pa.concat_tables(out) if out else pa.Table.from_arrays([pa.array([], pa.int64())] * len(names), names)

    # as many partitions as the session can use, not as many as there are blocks; else adaptive execution may put all these small rows into one task
    spark = items.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    rows = rows.repartition(min(blocks, tasks), "block")
    return rows.groupBy("block").applyInArrow(run, ", ".join(f"{c} bigint" for c in names))


def fill_report(placed: DataFrame) -> DataFrame:
    """Per spec: containers, tokens, least possible containers (by tokens) and the share of capacity in use."""
    boxes = placed.groupBy("spec_id", "capacity_tokens", "container_id").agg(F.sum("tokens").alias("used"))
    out = boxes.groupBy("spec_id", "capacity_tokens").agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"))
    return out.select("*", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least"), (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("fill"))
