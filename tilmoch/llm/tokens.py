"""Token counts under an existing tokenizer, exact and without encoding a text twice over.

A byte-level BPE tokenizer first splits a text by a pattern whose pieces never run
across the place between a character that is no white space and white space after
it, and whose look-ahead never reaches over such a place (see ``cuts``). The
tokens of the parts cut there are therefore exactly the tokens of the text. That
is used twice: oversized documents are cut into chunks that different workers
count, and within a batch the text is cut into short pieces of which only the
distinct ones are encoded.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilmoch.llm import codepoints as C
from tilmoch.llm.text_columns import plain_key

TOKENIZERS = "/opt/tokenizers"
DEFAULT = f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken"
# Fixed value: the published pre-split pattern of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Documents above this many characters are cut into chunks of about as many bytes.
OVERSIZED = 1 << 15
_CACHE_LIMIT = 400_000


class Counter:
    """Counts tokens of whole Arrow arrays with one tokenizer file; ``cuttable`` says if white-space cuts are proven for it."""

    def __init__(self, path: str) -> None:
        self.cache: dict[str, int] = {}
        if path.endswith(".tiktoken"):
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.cuttable, self._encode = True, lambda texts: [len(x) for x in map(enc._core_bpe.encode_ordinary, texts)]
        elif path.endswith(".json"):
            import json

            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.encode_special_tokens = True
            with open(path) as f:
                pre = json.load(f).get("pre_tokenizer") or {}
            # a prefix blank before every text would make parts differ from the whole
            self.cuttable = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space")
            self._encode = lambda texts: [len(x.ids) for x in tok.encode_batch(list(texts), add_special_tokens=False)]
        elif path.endswith(".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            self.cuttable, self._encode = False, lambda texts: [len(x) for x in sp.encode(list(texts), num_threads=1)]
        else:
            raise ValueError(f"unknown tokenizer file {path}")

    def distinct(self, texts: list[str]) -> np.ndarray:
        new = [t for t in texts if t not in self.cache]
        if len(self.cache) + len(new) > _CACHE_LIMIT:
            self.cache.clear()
            new = texts
        self.cache.update(zip(new, self._encode(new)))
        get = self.cache.__getitem__
        return np.fromiter(map(get, texts), np.int64, len(texts))

    def count(self, arr: pa.Array) -> np.ndarray:
        """Tokens of each text; 0 for null and empty ones."""
        out = []
        for part in C.slices(arr, 1 << 23):
            data, off = C.offsets_of(part)
            at = cuts(data, off) if self.cuttable else off[:-1][off[1:] > off[:-1]]
            n = np.zeros(len(off) - 1, np.int64)
            if len(at):
                ends = np.append(at, len(data)).astype(np.int32 if len(data) < 2**31 else np.int64)
                kind = pa.StringArray if len(data) < 2**31 else pa.LargeStringArray
                pieces = kind.from_buffers(len(at), pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())).dictionary_encode()
                each = self.distinct(pieces.dictionary.to_pylist())[pieces.indices.to_numpy()]
                sums = np.concatenate([[0], np.cumsum(each)])
                lo = np.searchsorted(at, off)
                n = np.diff(sums[lo])
            out.append(n)
        return np.concatenate(out) if out else np.zeros(0, np.int64)


@functools.cache
def counter(path: str) -> Counter:
    return Counter(path)


def cuts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Byte places where a piece starts: every row's start, and ASCII white space after a character that is no white space.

    Every alternative of the pattern but the white-space runs takes white space only
    as an optional first blank, so none continues over such a place; the look-ahead
    ``\\s+(?!\\S)`` only asks for the character after a run of white space, which
    never ends at such a place. Non-ASCII white space before the place rules it out.
    """
    space = np.zeros(len(data), bool)
    space[:] = (data == 32) | ((data >= 9) & (data <= 13))
    at = np.flatnonzero(space)
    at = at[at > 0]
    p1 = data[at - 1]
    ok = ~space[at - 1] & ~((p1 >= 0x1C) & (p1 <= 0x1F))
    p2 = np.where(at > 1, data[np.maximum(at - 2, 0)], 0)
    p3 = np.where(at > 2, data[np.maximum(at - 3, 0)], 0)
    ok &= ~((p2 == 0xC2) & ((p1 == 0xA0) | (p1 == 0x85)))
    ok &= ~((p3 == 0xE2) & (p2 == 0x80) & ((p1 <= 0x8A) | (p1 == 0xA8) | (p1 == 0xA9) | (p1 == 0xAF)) & (p1 >= 0x80))
    ok &= ~((p3 == 0xE2) & (p2 == 0x81) & (p1 == 0x9F)) & ~((p3 == 0xE3) & (p2 == 0x80) & (p1 == 0x80)) & ~((p3 == 0xE1) & (p2 == 0x9A) & (p1 == 0x80))
    starts = off[:-1][off[1:] > off[:-1]]
    return np.union1d(at[ok], starts)


def _cyrillic(arr: pa.Array) -> np.ndarray:
    """Rows with more Cyrillic than ASCII letters."""
    data, off = C.offsets_of(arr)
    low = data | 0x20
    score = ((data >= 0xD0) & (data <= 0xD3)).astype(np.int64) - ((low >= 97) & (low <= 122) & (data < 128))
    total = np.concatenate([[0], np.cumsum(score)])
    return np.diff(total[off]) > 0


def chunk_texts(df: DataFrame, columns: list[str], text: str, size: int, cuttable: bool) -> DataFrame:
    """``(columns, chunk, text)``: texts cut at proven places into chunks of about size bytes; a stretch without such a place stays whole."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.column(text).slice(i, 1)
                data, off = C.offsets_of(one)
                at = cuts(data, off) if cuttable else off[:1]
                grid = np.unique(np.concatenate([at[:1], at[np.minimum(np.searchsorted(at, np.arange(size, len(data), size)), len(at) - 1)]]))
                ends = np.append(grid, len(data)).astype(np.int32)
                parts = pa.StringArray.from_buffers(len(grid), pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes()))
                own = [batch.column(c).take(pa.array(np.full(len(grid), i))) for c in columns]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.arange(len(grid)), pa.int64()), parts], [*columns, "chunk", "text"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)
    return df.select(*columns, text).mapInArrow(cut, f"{kinds}, chunk bigint, text string")


def token_counts(df: DataFrame, key: str, text: Column, tokenizer: str = DEFAULT, oversized: int = OVERSIZED) -> DataFrame:
    """``(key, tokens, cyrillic)``: the exact number of tokens of each text, one row per row of df, whatever its length and however often its key occurs.

    Null and empty texts have 0 tokens. ``cyrillic`` is true if Cyrillic letters
    outnumber ASCII ones. Texts up to oversized characters are counted where they
    are read. Longer ones are cut at proven boundaries, their chunks are spread over
    all workers by row and chunk number, and chunk counts are summed per row. Other
    columns are not read; an empty table gives an empty result. Rows are numbered
    where they are read, so df must come in one order each time (a scan does).
    """
    rows = df.select(F.col(f"`{key}`").alias("key"), text.alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, tokens bigint, cyrillic boolean"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer)
        for batch in batches:
            t = batch.column("text")
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(c.count(t)), pa.array(_cyrillic(t))], ["key", "tokens", "cyrillic"])

    def count_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer)
        for batch in batches:
            t = batch.column("text")
            size = pa.array(np.where(_cyrillic(t), 1, -1) * np.diff(C.offsets_of(t)[1]))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("key"), pa.array(c.count(t)), size], ["row", "key", "tokens", "lean"])

    fits = rows.where(F.coalesce(F.length("text"), F.lit(0)) <= oversized).mapInArrow(count, schema)
    if not counter(tokenizer).cuttable:
        return fits.unionByName(rows.where(F.length("text") > oversized).mapInArrow(count, schema))
    big = rows.withColumn("row", F.monotonically_increasing_id()).where(F.length("text") > oversized)
    parts = chunk_texts(big, ["row", "key"], "text", oversized, True).repartition("row", "chunk").mapInArrow(count_chunks, f"row bigint, key {kind}, tokens bigint, lean bigint")
    return fits.unionByName(parts.groupBy("row").agg(F.first("key").alias("key"), F.sum("tokens").alias("tokens"), (F.sum("lean") > 0).alias("cyrillic")).drop("row"))


def language(lang: Column, catalog_lang: Column, cyrillic: Column) -> Column:
    """One spelling per language; null takes the catalog's; Uzbek in Cyrillic script is uz-Cyrl whatever the label's detail."""
    code = F.lower(F.regexp_replace(F.coalesce(lang, catalog_lang, F.lit("und")), "_", "-"))
    uzbek = code.isin("uz", "uzb", "uz-latn", "uz-cyrl")
    return F.when(uzbek & cyrillic, "uz-Cyrl").when(code.isin("uz", "uzb", "uz-latn"), "uz").when(code == "uz-cyrl", "uz-Cyrl").otherwise(code)


def source_name(source: Column) -> Column:
    """The key under which all spellings of a source meet."""
    return plain_key(source)


def slice_totals(rows: DataFrame) -> DataFrame:
    """Documents and tokens by table, source, language and domain: each slice, each of the three alone, and all.

    ``level`` names the grouping; columns outside it are null. Sums are combined
    map-side, so a source with a third of all rows costs one row per task.
    """
    level = F.expr("grouping_id()").alias("g")
    names = {0b000: "source,lang,domain", 0b011: "source", 0b101: "lang", 0b110: "domain", 0b111: "all"}
    view = rows.groupingSets([["tbl", "source", "lang", "domain"], ["tbl", "source"], ["tbl", "lang"], ["tbl", "domain"], ["tbl"]], "tbl", "source", "lang", "domain")
    out = view.agg(F.count("*").alias("rows"), F.sum("tokens").alias("tokens"), level)
    name = F.create_map(*[F.lit(x) for k, v in names.items() for x in (k, v)])
    return out.select("tbl", name[F.col("g").cast("int")].alias("level"), "source", "lang", "domain", "rows", "tokens")
