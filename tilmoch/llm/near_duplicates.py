"""Near-duplicate records with small edits: DartMinHash bands and an exact join on the rarest words, exact check, components.

The bands weigh frequent words down, the link does not: two records that share
frequent words and differ in rarer ones can be similar enough without a common
band, and a band held by very many rows is not enumerated. The join on the rarest
words (see cross_split) has every pair of the threshold, whatever its weights, so
either way no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilmoch.llm import cross_split, darts, set_pairs
from tilmoch.llm.components import components
from tilmoch.llm.hot_keys import hot_pairs
from tilmoch.llm.set_pairs import allowed, close_sketch, edit_bound, paired, verified
from tilmoch.llm.sketches import code_counts, codes_of, count_codes
from tilmoch.llm.text_columns import joined, plain_key, word_set
from tilmoch.session import shared_table

#: Words in more than this share of the records, and in more than RARE records, weigh less, down to LEAST_WEIGHT.
HEAVY_SHARE = 1 / 2000
RARE = 50
LEAST_WEIGHT = 0.02
#: Coordinates per band and bands: a pair of weighted similarity 0.6 shares a band with probability 1 - (1 - 0.36)**13 = 0.997.
BAND_ROWS, BANDS = 2, 13


def representatives(df: DataFrame, key: str, tokens: Column, source: Column) -> DataFrame:
    """``(id, nid, n, w)``: one row per group of format copies (same words in order, same source), under its smallest key.

    ``w`` are the distinct words as sorted hashes, ``nid`` a number of the row.
    """
    rows = df.select(F.col(f"`{key}`").alias("id"), word_set(joined(tokens)).alias("s"), plain_key(source).alias("source")).where("id IS NOT NULL")
    rows = rows.select("id", F.xxhash64("s.seq", "source").alias("d1"), F.xxhash64(F.lit(7), "s.cls", "s.seq", "source").alias("d2"), "s.w")
    groups = rows.groupBy("d1", "d2").agg(F.min("id").alias("id"), F.first("w").alias("w"))
    groups = groups.select("id", F.monotonically_increasing_id().alias("nid"), F.size("w").alias("n"), "w")
    return shared_table(groups, "sets")


def word_weights(rows: int, share: float = HEAVY_SHARE) -> np.ndarray:
    """The weight of a word for each count code: full up to the limit, least for a word of every record, squared fall in the logarithm between."""
    limit = max(RARE, share * rows)
    if rows <= limit:
        return np.ones(256)
    fall = np.log(rows / np.maximum(code_counts(), 1)) / np.log(rows / limit)
    return np.clip(np.clip(fall, 0, 1) ** 2, LEAST_WEIGHT, 1)


def band_rows(sets: DataFrame, codes: np.ndarray, rows: int, share: float = HEAVY_SHARE, r: int = BAND_ROWS, b: int = BANDS) -> DataFrame:
    """``(key, nid, sk, at)``: b band keys per set, from r dart coordinates each."""
    shared = sets.sparkSession.sparkContext.broadcast((codes, word_weights(rows, share)))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, weight = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                w, n = set_pairs._flat(part.column("w"))
                sig = darts.signatures(darts.mix64(w.view(np.uint32).astype(np.uint64)), weight[codes_of(w, table)], n, r * b)
                some = n > 0
                key = darts.bands(sig[some], r).view(np.int64)
                nid = part.column("nid").to_numpy(zero_copy_only=False)[some]
                sk = set_pairs.parity_sketch(w, n).view(np.int64)[some]
                zero = np.zeros(len(nid), np.int64)
                cols = [key.ravel(), *(np.repeat(x, b) for x in (nid, sk, set_pairs.place(n[some], zero, zero)))]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["key", "nid", "sk", "at"])

    return sets.select("nid", "w").mapInArrow(emit, "key bigint, nid bigint, sk bigint, at bigint")


def hot_links(hot: DataFrame, sets: DataFrame, threshold: float, limit: int, d: int = 0, depth: int = 8) -> DataFrame:
    """``(a, b)``: links that connect the rows ``(key, nid, at)`` of each hot key exactly as all their links would, without all their pairs."""
    pairs, links = hot_pairs(hot.select(F.col("key").alias("hot"), F.col("nid").alias("a"), "at"), sets, threshold, limit, d, depth, star=True)
    return verified(pairs.distinct(), sets, edit_bound(threshold)).union(links).distinct()


def near_duplicate_groups(df: DataFrame, key: str, tokens: Column, source: Column, threshold: float = 0.6, limit: int = set_pairs.RUN_LIMIT, depth: int = 8) -> DataFrame:
    """``(id, group_id)`` of every representative that is linked to another, group_id the smallest id of its group.

    Two representatives are linked if their sets of words have a Jaccard similarity
    of at least threshold; order and repeats of words make no difference. Records
    without words are linked to nothing; a null source equals a null source; a key
    that occurs twice is one record; null keys are left out; an empty table gives
    an empty result; other columns are not read.
    """
    sets = representatives(df, key, tokens, source)
    codes = count_codes(sets, "w")
    bound = edit_bound(threshold)
    found = shared_table(paired(band_rows(sets, codes, sets.count()), close_sketch(bound), limit).where("hot IS NULL").select("a", "b"), "pairs")
    strings = cross_split.ordered_strings(sets, codes)
    met = shared_table(paired(cross_split.segment_rows(strings, threshold, across=False), allowed(threshold), limit), "pairs")
    edges = verified(found.union(met.where("hot IS NULL").select("a", "b")).distinct(), sets, bound)
    hot = met.where("hot IS NOT NULL").select(F.col("hot").alias("key"), F.col("a").alias("nid"), "at")
    if not hot.isEmpty():
        edges = edges.union(hot_links(hot, strings, threshold, limit, 1, depth))
    cc = shared_table(components(edges), "components")
    named = cc.join(sets.select("nid", "id"), "nid").select("cid", "id")
    return named.join(named.groupBy("cid").agg(F.min("id").alias("group_id")), "cid").select("id", "group_id")


def group_pairs(groups: DataFrame) -> DataFrame:
    """``(id_a, id_b)``: every two ids of a group, smaller first. As many rows as that is: at scale keep the groups instead."""
    a = groups.select("group_id", F.col("id").alias("id_a"))
    b = groups.select("group_id", F.col("id").alias("id_b"))
    return a.join(b, "group_id").where("id_a < id_b").select("id_a", "id_b")
