"""Duplicates hidden by formatting: bottom-up digests of nested records, grouped and confirmed.

Every node of a record gets a digest from the digests of its children. Leaves are
normalised first. The children of an ordered node (array) are hashed in order;
those of an unordered node (struct, map) as sorted (name, digest) pairs, so key
order does not matter. Records with one root digest are compared in full
normalised structure before they count as copies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilmoch.llm.sketches import bloom, in_bloom
from tilmoch.llm.text_columns import joined, plain_key, words_text
from tilmoch.session import shared_table


def normal_leaf(value: Column, kind: T.DataType) -> Column:
    """A leaf apart from case, blanks and punctuation, as text; null is its own value."""
    text = F.lower(value.cast("string"))
    if isinstance(kind, T.StringType):
        text = F.trim(F.regexp_replace(F.regexp_replace(text, r"['ʻʼ‘’`]", ""), r"[^\p{L}\p{N}]+", " "))
    return F.coalesce(F.concat(F.lit("="), text), F.lit("~"))


def canonical(value: Column, kind: T.DataType, leaf=normal_leaf) -> Column:
    """The full normalised structure as text: what the digest stands for, used to confirm."""
    if isinstance(kind, T.ArrayType):
        inner = F.transform(value, lambda x: canonical(x, kind.elementType, leaf))
        return F.coalesce(F.concat(F.lit("["), F.array_join(F.transform(inner, lambda s: F.concat(F.length(s).cast("string"), F.lit(":"), s)), ""), F.lit("]")), F.lit("~"))
    if isinstance(kind, T.StructType):
        parts = [F.concat(F.lit(f.name), F.lit(":"), canonical(value[f.name], f.dataType, leaf)) for f in sorted(kind.fields, key=lambda f: f.name)]
        body = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
        return F.when(value.isNull(), F.lit("~")).otherwise(body)
    if isinstance(kind, T.MapType):
        each = F.transform(F.map_entries(value), lambda e: F.concat(canonical(e["key"], kind.keyType, leaf), F.lit(":"), canonical(e["value"], kind.valueType, leaf)))
        return F.coalesce(F.concat(F.lit("{"), F.array_join(F.array_sort(each), ","), F.lit("}")), F.lit("~"))
    return leaf(value, kind)


def digest(value: Column, kind: T.DataType, leaf=normal_leaf) -> Column:
    """Merkle digest (128 bits as hex) of a nested value, bottom-up."""
    if isinstance(kind, T.ArrayType):
        return F.md5(F.coalesce(F.array_join(F.transform(value, lambda x: digest(x, kind.elementType, leaf)), ","), F.lit("~")))
    if isinstance(kind, T.StructType):
        parts = [F.concat(F.lit(f.name + ":"), digest(value[f.name], f.dataType, leaf)) for f in kind.fields]
        return F.when(value.isNull(), F.md5(F.lit("~"))).otherwise(F.md5(F.array_join(F.array_sort(F.array(*parts)), ",")))
    if isinstance(kind, T.MapType):
        each = F.transform(F.map_entries(value), lambda e: F.concat(digest(e["key"], kind.keyType, leaf), F.lit(":"), digest(e["value"], kind.valueType, leaf)))
        return F.md5(F.coalesce(F.array_join(F.array_sort(each), ","), F.lit("~")))
    return F.md5(leaf(value, kind))


def grouped_copies(df: DataFrame, key: str, root: Column, full: Column) -> DataFrame:
    """``(first_key, copy_key)`` for rows whose root digest and full structure are equal.

    ``first_key`` is the smallest key of the group; one row for each other
    key. A key that occurs twice counts once.
    Rows with a null key are left out. First only keys and digests are grouped; the
    digests that several keys hold go into a Bloom filter of a fixed size, and full
    structures travel for the rows that pass it alone: those that may have a copy.
    Group minima are taken with map-side combining, so a group of any size costs one
    row per map task; its members then meet it in a join on the digest, where adaptive
    execution splits a hot digest. df is read twice.
    """
    rows = df.select(F.col(f"`{key}`").alias("_k"), F.unhex(root).alias("_d"), full.alias("_f")).where("_k IS NOT NULL")
    short = F.conv(F.substring(F.hex("_d"), 1, 15), 16, 10).cast("bigint")
    several = rows.groupBy("_d").agg(F.min("_k").alias("lo"), F.max("_k").alias("hi")).where("lo < hi")
    shared = df.sparkSession.sparkContext.broadcast(bloom(several.select(short.alias("h")), "h"))

    @F.arrow_udf(T.BooleanType())
    def may_repeat(h: pa.Array) -> pa.Array:
        return pa.array(in_bloom(h.to_numpy(zero_copy_only=False).view(np.uint64), shared.value))

    rows = shared_table(rows.where(may_repeat(short)), "repeats")
    # the digest leads every comparison; the structure beside it confirms, so that no collision can merge two groups
    groups = rows.groupBy("_d", "_f").agg(F.min("_k").alias("first_key"), F.max("_k").alias("_last")).where("_last > first_key")
    groups = groups.select(F.col("_d").alias("_gd"), F.col("_f").alias("_gf"), "first_key")
    hits = rows.join(groups, (F.col("_d") == F.col("_gd")) & (F.col("_f") == F.col("_gf")) & (F.col("_k") > F.col("first_key")))
    return hits.select("first_key", F.col("_k").alias("copy_key")).distinct()


def record_copies(df: DataFrame, key: str, tokens: Column, source: Column) -> DataFrame:
    """Copies of token records: the same words in order and the same source apart from case, blanks and punctuation.

    Null tokens are a record without words; a null source equals a null source.
    An empty table gives an empty result. Other columns of df are not read.
    """
    rows = df.select(
        F.col(f"`{key}`").alias("_key"),
        F.struct(F.coalesce(words_text(joined(tokens)), F.lit("")).alias("tokens"), plain_key(source).alias("source")).alias("_r"),
    )
    ready = lambda v, _kind: F.coalesce(F.concat(F.lit("="), v), F.lit("~"))  # noqa: E731 — both leaves are normal already
    kind = rows.schema["_r"].dataType
    return grouped_copies(rows, "_key", digest(F.col("_r"), kind, ready), canonical(F.col("_r"), kind, ready))


def payload_records(df: DataFrame, key: str, payload: str) -> DataFrame:
    """``(key, tokens, source)`` of JSON lines; broken lines, and lines without a token array, are left out.

    Key order, blanks between parts and further keys make no difference.
    """
    text = F.col(f"`{payload}`")
    schema = "tokens array<string>, source string, _broken string"
    r = F.from_json(text, schema, {"columnNameOfCorruptRecord": "_broken", "allowSingleQuotes": "false"})
    rows = df.where(F.rtrim(F.regexp_replace(text, r"[\s]+$", "")).endswith("}")).select(F.col(f"`{key}`").alias("key"), r.alias("_r"))
    return rows.where("_r._broken IS NULL AND _r.tokens IS NOT NULL").select("key", "_r.tokens", "_r.source")


def copy_counts(copies: DataFrame) -> DataFrame:
    """``(first_key, copies)``: each group once, with its number of records."""
    return copies.groupBy("first_key").agg((F.count("*") + 1).alias("copies"))
