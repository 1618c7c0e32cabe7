"""Same or near-same records across splits: an edit-distance segment join of evaluation and training strings.

A record's string is its distinct words, rarest first. Two sets are similar enough
exactly if the insert-delete distance of their strings is within a bound set by
their lengths (see set_pairs).

An evaluation string of n words is cut into k + 1 segments that cover it: its k
rarest words as segments of one word, which an insertion cannot break, and all the
rest as one segment. k is the least number for which no partner can break every
segment: without the k words, and without one more word or with one insertion, less
than a share t of the words would be common. So of each pair one segment stands
unchanged in the training string. The first that does is a word at a position where
the edits before it leave room for enough common words, within the training
string's own first k' + 1 words; or it is the rest, and then the training string is
the rest and nothing else. Training strings offer those substrings; equal ones meet,
positions and sketches are tested, and what passes is verified by banded dynamic
programming over the whole strings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilmoch.llm import set_pairs
from tilmoch.llm.codepoints import mix64, ranges
from tilmoch.llm.hot_keys import hot_pairs
from tilmoch.llm.set_pairs import EPS, allowed, edit_bound, paired, place, verified
from tilmoch.llm.sketches import codes_of, count_codes
from tilmoch.llm.text_columns import joined, list_array, word_set
from tilmoch.session import shared_table


def ordered_strings(sets: DataFrame, codes: np.ndarray) -> DataFrame:
    """sets with their words ``w`` rarest first; words of one count are ordered by hash."""
    shared = sets.sparkSession.sparkContext.broadcast(codes)

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, n = set_pairs._flat(batch.column("w"))
            key = (codes_of(w, shared.value).astype(np.int64) << 32) + (w.astype(np.int64) + 2**31)
            w = w[np.lexsort((key, np.repeat(np.arange(len(n)), n)))]
            at = batch.schema.get_field_index("w")
            yield batch.set_column(at, "w", list_array(w, n, pa.int32()))

    return sets.mapInArrow(order, sets.schema)


def cut_words(n: np.ndarray, threshold: float) -> np.ndarray:
    """k of evaluation strings of n words: how many one-word segments they are cut into before the rest."""
    lost = n - np.ceil(threshold * n - EPS).astype(np.int64)
    return np.minimum(n, np.maximum(lost, np.floor(n - threshold * (n + 1) + EPS).astype(np.int64) + 1))


def _stretch_hash(w: np.ndarray, n: np.ndarray, skip: np.ndarray) -> np.ndarray:
    """A hash of each string without its first words, as a key that is no single word's."""
    out = np.zeros(len(n), np.uint64)
    pos = ranges(n)
    h = mix64(w.view(np.uint32).astype(np.uint64) + (np.uint64(1) << np.uint64(33)))  # the words of a string are distinct and in one order
    h[pos < np.repeat(skip, n)] = 0
    full = np.flatnonzero(n)
    if len(full):
        out[full] = np.add.reduceat(h, (np.cumsum(n) - n)[full])
    return ((mix64(out) >> np.uint64(2)) | (np.uint64(1) << np.uint64(61))).view(np.int64)


def segment_rows(strings: DataFrame, threshold: float, across: bool = True) -> DataFrame:
    """``(key, nid, sk, at)``: segments of the evaluation strings (side 1) and substrings of the training strings (side 0).

    Not across, every string offers its first k' + 1 words, so that the first common
    word of any two strings is a key of both.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, n = set_pairs._flat(batch.column("w"))
            side = batch.column("side").to_numpy(zero_copy_only=False).astype(np.int64) if across else np.zeros(len(n), np.int64)
            nid = batch.column("nid").to_numpy(zero_copy_only=False)
            pos = ranges(n)
            k = cut_words(n, threshold)
            own = n - np.ceil(threshold * n - EPS).astype(np.int64) + 1
            at = np.flatnonzero(pos < np.repeat(np.where(side == 1, k, own), n))
            r = np.repeat(np.arange(len(n)), n)[at]
            sk = set_pairs.parity_sketch(w, n).view(np.int64)
            cols = [w[at].astype(np.int64), nid[r], sk[r], place(n[r], pos[at], side[r])]
            if across:
                skip = np.where(side == 1, k, 0)
                # a rest can only match where it alone is share enough of its string
                some = np.flatnonzero((n > skip) & (n - skip >= threshold * n - EPS))
                more = [_stretch_hash(w, n, skip)[some], nid[some], sk[some], place(n[some], skip[some], side[some])]
                cols = [np.concatenate(x) for x in zip(cols, more)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "nid", "sk", "at"])

    columns = ["nid", "side", "w"] if across else ["nid", "w"]
    return strings.select(*columns).mapInArrow(emit, "key bigint, nid bigint, sk bigint, at bigint")


def cross_split_pairs(df: DataFrame, key: str, tokens: Column, is_eval: Column, threshold: float = 0.6, limit: int = set_pairs.RUN_LIMIT, depth: int = 8) -> DataFrame:
    """``(eval_id, train_id)``: every evaluation and training record whose word sets have a Jaccard similarity >= threshold.

    Records with the same set on one side are joined once, under a class; the pairs
    of classes are spelled out to ids at the end, since the result names every pair.
    Segments with more than limit strings go the way of ``hot_keys``: they are split
    by the next common words. ``is_eval`` is true for evaluation rows, false for
    training rows; rows where it is null belong to neither. Records without words
    match nothing; a key that occurs twice is one record; null keys are left out; an
    empty table gives an empty result; other columns are not read.
    """
    base = df.select(F.col(f"`{key}`").alias("id"), word_set(joined(tokens)).alias("s"), is_eval.cast("int").alias("side")).where("id IS NOT NULL AND side IS NOT NULL AND s.cls <> 0")
    base = shared_table(base.select("id", "side", "s.cls", "s.w"), "records")  # read for the word counts, the classes, and for the ids without the words
    classes = base.groupBy("cls", "side").agg(F.first("w").alias("w")).select("cls", "side", F.monotonically_increasing_id().alias("nid"), "w")
    strings = shared_table(ordered_strings(classes, count_codes(base, "w")), "strings")
    found = shared_table(paired(segment_rows(strings, threshold), allowed(threshold), limit, across=True), "pairs")
    pairs = found.where("hot IS NULL").select("a", "b")
    hot = found.where("hot IS NOT NULL")
    if not hot.isEmpty():
        # a hot rest is a training string and what it is the rest of: every pair of it is a result
        rest = hot.where(F.col("hot") >= F.lit(1 << 61))
        e, t = rest.where("at % 2 = 1").select("hot", F.col("a").alias("x")), rest.where("at % 2 = 0").select("hot", F.col("a").alias("y"))
        pairs = pairs.union(e.join(t, "hot").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
        pairs = pairs.union(hot_pairs(hot.where(F.col("hot") < F.lit(1 << 61)), strings, threshold, limit, 1, depth, across=True)[0])
    near = verified(pairs.distinct(), strings, edit_bound(threshold))
    names = strings.select("nid", "cls", "side")
    near = near.join(names.select(F.col("nid").alias("a"), F.col("cls").alias("ca"), "side"), "a").join(names.select(F.col("nid").alias("b"), F.col("cls").alias("cb")), "b")
    near = shared_table(near.select(F.when(F.col("side") == 1, F.col("ca")).otherwise(F.col("cb")).alias("ce"), F.when(F.col("side") == 1, F.col("cb")).otherwise(F.col("ca")).alias("ct")), "near")
    members = base.select("id", "cls", "side").distinct()
    e = members.where("side = 1").select(F.col("cls").alias("ce"), F.col("id").alias("eval_id"))
    t = members.where("side = 0").select(F.col("cls").alias("ct"), F.col("id").alias("train_id"))
    return near.join(e, "ce").join(t, "ct").select("eval_id", "train_id")


__all__ = ["allowed", "cross_split_pairs", "cut_words", "ordered_strings", "segment_rows"]
