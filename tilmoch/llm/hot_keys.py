"""Pairs of rows that share a hot key: the key is split by the next common words, never joined with itself.

A key stands for the first d common words of its rows' strings (d = 0: for nothing
but that the rows belong together). If two strings are similar enough, their next
common word lies within the first k' + d + 1 words of each. So the rows of a key are
keyed again by each such word beyond the last one, and a pair meets under its next
common word alone; what still is hot goes one word deeper. Strings that share no
further word are similar only if the d words are share enough of both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilmoch.llm import set_pairs
from tilmoch.llm.codepoints import mix64, ranges
from tilmoch.llm.set_pairs import EPS, allowed, paired, place_columns
from tilmoch.session import shared_table

ROWS = "key bigint, nid bigint, sk bigint, at bigint, label bigint"


def next_words(rows: DataFrame, strings: DataFrame, threshold: float, d: int) -> DataFrame:
    """``(key, nid, sk, at, label)``: each row ``(key, nid, at, label)`` once per word that can be its common word d."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {x: batch.column(x).to_numpy(zero_copy_only=False) for x in ("key", "nid", "at", "label")}
            w, n = set_pairs._flat(batch.column("w"))
            last = (c["at"] & 0xFFFFFFFF) >> 1
            low = last + 1 if d else np.zeros(len(n), np.int64)
            high = np.minimum(n, n - np.ceil(threshold * n - EPS).astype(np.int64) + d + 1)
            m = np.maximum(high - low, 0)
            r = np.repeat(np.arange(len(n)), m)
            pos = low[r] + ranges(m)
            first = np.cumsum(n) - n
            word = w[first[r] + pos].view(np.uint32).astype(np.uint64)
            key = (mix64(mix64(c["key"][r].view(np.uint64)) ^ (word + np.uint64(1 << 34))) >> np.uint64(1)).view(np.int64)
            sk = set_pairs.parity_sketch(w, n).view(np.int64)
            cols = [key, c["nid"][r], sk[r], set_pairs.place(n[r], pos, c["at"][r] & 1), c["label"][r]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["key", "nid", "sk", "at", "label"])

    return rows.join(strings.select("nid", "w"), "nid").select("key", "nid", "at", "label", "w").mapInArrow(emit, ROWS)


def with_partners(rows: DataFrame, threshold: float, d: int, across: bool) -> DataFrame:
    """The rows that have room, by sizes and places of common word d - 1, with some other row of their key (of the other side, across); the others have no pair there."""
    at = place_columns()
    rows = rows.select("*", at["n"].alias("n"), at["pos"].alias("pos"), at["side"].alias("side"))
    kinds = rows.groupBy("key", "n", "pos", "side").agg(F.count("*").alias("c"))
    other = kinds.select(F.col("key").alias("k2"), F.col("n").alias("n2"), F.col("pos").alias("p2"), F.col("side").alias("s2"))
    same = (F.col("n") == F.col("n2")) & (F.col("pos") == F.col("p2")) & (F.col("side") == F.col("s2"))
    most = F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("p2")) + (d - 1) if d else F.least("n", "n2")
    room = most >= threshold / (1 + threshold) * (F.col("n") + F.col("n2")) - EPS
    fits = (F.col("side") != F.col("s2")) if across else ~(same & (F.col("c") < 2))
    some = kinds.join(other, (F.col("key") == F.col("k2")) & fits & room, "left_semi")
    return rows.join(some.select("key", "n", "pos", "side"), ["key", "n", "pos", "side"], "left_semi").drop("n", "pos", "side")


def _similarity(w1: str, w2: str):
    o = F.size(F.array_intersect(w1, w2))
    return o / F.greatest(F.lit(1), F.size(w1) + F.size(w2) - o)


def starred(rows: DataFrame, strings: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Rows similar to their key's pivot (its least nid) take the pivot's label, and the links ``(a, b)`` that say so; keys of one label are dropped."""
    w = strings.select("nid", "w")
    pivots = rows.groupBy("key").agg(F.min(F.struct("nid", "label")).alias("p")).select("key", F.col("p.nid").alias("pn"), F.col("p.label").alias("pl"))
    pivots = pivots.join(w.select(F.col("nid").alias("pn"), F.col("w").alias("pw")), "pn")
    near = rows.join(w, "nid").join(pivots, "key").withColumn("near", _similarity("w", "pw") >= threshold - EPS)
    near = shared_table(near.select("key", "nid", "at", F.when(F.col("near"), F.col("pl")).otherwise(F.col("label")).alias("label"), "pn", "near"), "starred")
    some = near.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    links = near.where("near AND nid <> pn").select(F.least("pn", "nid").alias("a"), F.greatest("pn", "nid").alias("b"))
    return near.join(some, "key", "left_semi").select("key", "nid", "at", "label"), links


def block_rows(rows: DataFrame, strings: DataFrame, limit: int) -> DataFrame:
    """``(key, nid, sk, at, label, block, own)``: the rows of each key in blocks of about limit, one key per pair of blocks, so that no task holds a whole key."""
    sizes = rows.groupBy("key").agg(F.ceil(F.count("*") / limit).alias("blocks"))
    x = rows.join(sizes, "key").join(strings.select("nid", "w"), "nid").withColumn("block", F.pmod(F.xxhash64("nid"), F.col("blocks")))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    key = F.shiftrightunsigned(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")), 1)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, n = set_pairs._flat(batch.column("w"))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(set_pairs.parity_sketch(w, n).view(np.int64))], [*batch.schema.names[:-1], "sk"])

    x = x.select(key.alias("key"), "nid", "at", "label", "block", (F.col("block") == F.col("other")).cast("bigint").alias("own"), "w")
    return x.mapInArrow(sketch, "key bigint, nid bigint, at bigint, label bigint, block bigint, own bigint, sk bigint")


def hot_pairs(hot: DataFrame, strings: DataFrame, threshold: float, limit: int, d: int, depth: int = 8, across: bool = False, star: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """``(a, b)`` candidates among the rows ``(a, hot, at)`` of hot keys that stand for d common words; and links already proven.

    With star the pairs are only to connect what is similar: rows similar to a pivot
    are linked to it and need no pairs among themselves, so a key whose rows are all
    copies of one text with small edits costs one comparison a row. Keys that are hot
    after depth further words are paired in blocks, exactly and without a task that
    holds them whole.
    """
    rows = hot.select(F.col("hot").alias("key"), F.col("a").alias("nid"), "at").distinct().withColumn("label", F.col("nid"))
    own = shared_table(strings.join(rows.select("nid").distinct(), "nid", "left_semi").select("nid", "w"), "hot_strings")
    pairs, links = [], []
    for level in range(depth + 1):
        rows = shared_table(with_partners(rows, threshold, d, across), "hot_rows")
        if rows.isEmpty():
            break
        if star:
            rows, more = starred(rows, own, threshold)
            links.append(more)
        at = place_columns()
        if level == depth:
            near = set_pairs.close_sketch(set_pairs.edit_bound(threshold))
            keep = lambda c, i, j: (c["label"][i] != c["label"][j]) & ((c["block"][i] != c["block"][j]) | (c["own"][i] == 1)) & near(c, i, j)
            pairs.append(paired(block_rows(rows, own, limit), keep, 1 << 40, across).select("a", "b"))
            break
        if d:  # these d words and no other in common
            done = rows.select("key", "nid", "label", at["n"].alias("n"), at["side"].alias("side")).where(F.lit(d) >= threshold * F.col("n") - EPS)
            fits = F.col("n") + F.col("m") <= d * (1 + threshold) / threshold + EPS
            if across:
                e, t = done.where("side = 1").select("key", "n", F.col("nid").alias("x")), done.where("side = 0").select("key", F.col("n").alias("m"), F.col("nid").alias("y"))
                both = e.join(t, "key").where(fits)
            else:  # the shortest string of a key has room for all that have room for any
                least = done.groupBy("key").agg(F.min(F.struct(F.col("n").alias("m"), F.col("nid").alias("y"))).alias("p")).select("key", "p.*")
                both = done.select("key", "n", F.col("nid").alias("x")).join(least, "key").where(fits & (F.col("x") != F.col("y")))
            pairs.append(both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
        found = shared_table(paired(next_words(rows, own, threshold, d), allowed(threshold, d), limit, across), "hot_pairs")
        pairs.append(found.where("hot IS NULL").select("a", "b"))
        rows = found.where("hot IS NOT NULL").select(F.col("hot").alias("key"), F.col("a").alias("nid"), "at", "label")
        d += 1
    union = lambda parts: parts[0] if len(parts) == 1 else union([parts[0].union(parts[1]), *parts[2:]])
    empty = rows.select(F.col("nid").alias("a"), F.col("nid").alias("b")).limit(0)
    return union([empty, *pairs]), union([empty, *links]) if star else None
