"""Consistent form, word form and word hashes as columns (Arrow batches, no per-row Python)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilmoch.llm import codepoints as C


@F.arrow_udf(T.StringType())
def consistent_text(text: pa.Array) -> pa.Array:
    """The text in consistent form (see codepoints); null stays null."""
    return C.fold(text)[0]


@F.arrow_udf(T.StructType().add("text", T.StringType()).add("changed", T.BooleanType()))
def consistent_form(text: pa.Array) -> pa.Array:
    """The text in consistent form and whether that differs from the text; null gives (null, false)."""
    out, changed = C.fold(text)
    return pa.StructArray.from_arrays([out, pa.array(changed)], ["text", "changed"])


@F.arrow_udf(T.StringType())
def words_text(text: pa.Array) -> pa.Array:
    """The words of the text joined with single blanks; null stays null."""
    return C.word_form(text)


def joined(tokens: Column) -> Column:
    """The text of a token array: its non-null tokens joined with blanks; null for a null array."""
    return F.array_join(tokens, " ")


def plain_key(name: Column) -> Column:
    """A name apart from case, blanks and punctuation; null stays null."""
    return F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", "")


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    off = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values, kind))


def word_sets(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each text: its distinct words as sorted 32-bit hashes (flat) and their number, a hash of the set, a hash of the sequence.

    Texts without words, and nulls, have an empty set with hash 0.
    """
    words, counts, sets, seqs = [], [], [], []
    for part in C.slices(text):
        h, n = C.word_hashes(*C.decode(part))
        row = np.repeat(np.arange(len(n)), n)
        first = np.cumsum(n) - n
        seq = np.zeros(len(n), np.uint64)
        full = np.flatnonzero(n)
        if len(h):
            place = C.ranges(n).astype(np.uint64)
            seq[full] = np.add.reduceat(C.mix64(h ^ C.mix64(place + np.uint64(1))), first[full])
            w = (h >> np.uint64(32)).astype(np.uint32).view(np.int32)
            order = np.argsort((row.astype(np.int64) << 32) + (w.astype(np.int64) + 2**31), kind="stable")
            w, row = w[order], row[order]
            new = np.ones(len(w), bool)
            new[1:] = (w[1:] != w[:-1]) | (row[1:] != row[:-1])
            w, row = w[new], row[new]
            n = np.bincount(row, minlength=len(n))
            first = np.cumsum(n) - n
            s = np.zeros(len(n), np.uint64)
            s[full] = C.mix64(np.add.reduceat(C.mix64(w.view(np.uint32).astype(np.uint64) + np.uint64(1)), first[full]))
        else:
            w, s = np.zeros(0, np.int32), np.zeros(len(n), np.uint64)
        words.append(w)
        counts.append(n)
        sets.append(s)
        seqs.append(seq)
    if not words:
        z = np.zeros(0, np.int64)
        return z.astype(np.int32), z, z, z
    return np.concatenate(words), np.concatenate(counts), np.concatenate(sets).view(np.int64), np.concatenate(seqs).view(np.int64)


@F.arrow_udf(T.StructType().add("w", T.ArrayType(T.IntegerType())).add("cls", T.LongType()).add("seq", T.LongType()))
def word_set(text: pa.Array) -> pa.Array:
    """Distinct words as sorted 32-bit hashes, a hash of the set and a hash of the word sequence."""
    w, n, s, q = word_sets(text)
    return pa.StructArray.from_arrays([list_array(w, n, pa.int32()), pa.array(s), pa.array(q)], ["w", "cls", "seq"])
