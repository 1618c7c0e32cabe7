"""Evaluation texts leaking into training text: a hash set of item n-grams against windows of corpus words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilmoch.llm import codepoints as C
from tilmoch.llm.sketches import bloom, in_bloom
from tilmoch.session import shared_table

#: An n-gram takes about 40 bytes on a worker; above this many the item side is no longer broadcast but joined.
BROADCAST_NGRAMS = 2_000_000


def windows(h: np.ndarray, n: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of width consecutive words within a row, and the place of its first word."""
    if len(h) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g = np.zeros(len(h) - width + 1, np.uint64)
    for j in range(width):
        g += h[j : j + len(g)] * np.uint64((0x9E3779B97F4A7C15 * (2 * j + 1)) % 2**64)
        g ^= g >> np.uint64(29)
    left = np.repeat(np.cumsum(n), n) - np.arange(len(h))  # words from here to the end of the row
    at = np.flatnonzero(left[: len(g)] >= width)
    return C.mix64(g[at] + np.uint64(width)), at


def item_ngrams(items: list[tuple[str, str]], width: int) -> dict:
    """Sorted window hashes of all items, their words, and which items hold each; an item shorter than width is one window."""
    texts = pa.array([t for _, t in items], pa.string())
    h, n = C.word_hashes(*C.decode(texts)) if len(items) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    first = np.cumsum(n) - n
    found: dict[int, dict[int, tuple[list[int], np.ndarray]]] = {}
    for i in range(len(items)):
        k = min(int(n[i]), width)
        if not k:
            continue
        own = h[first[i] : first[i] + n[i]]
        g, at = windows(own, n[i : i + 1], k)
        for x, a in zip(g.tolist(), at.tolist()):
            found.setdefault(k, {}).setdefault(x, ([], own[a : a + k]))[0].append(i)
    tables = []
    for k, grams in sorted(found.items()):
        keys = np.array(sorted(grams), np.uint64)
        holders = [sorted(set(grams[x][0])) for x in keys.tolist()]
        tables.append({"k": k, "keys": keys, "words": np.stack([grams[x][1] for x in keys.tolist()]), "n": np.array([len(x) for x in holders]), "items": np.array([i for x in holders for i in x])})
    return {"ids": [i for i, _ in items], "tables": tables}


def _hits(part: pa.Array, grams: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, item, first word and width of each verified window hit."""
    h, n = C.word_hashes(*C.decode(part))
    row = np.repeat(np.arange(len(n)), n)
    first = np.cumsum(n) - n
    rows, items, places, widths = [], [], [], []
    for t in grams["tables"]:
        g, at = windows(h, n, t["k"])
        k = np.searchsorted(t["keys"], g)
        k[k == len(t["keys"])] = 0
        hit = np.flatnonzero(t["keys"][k] == g)
        if not len(hit):
            continue
        k, at = k[hit], at[hit]
        same = (h[at[:, None] + np.arange(t["k"])] == t["words"][k]).all(axis=1)  # word by word
        k, at = k[same], at[same]
        c = t["n"][k]
        start = (np.cumsum(t["n"]) - t["n"])[k]
        rows.append(np.repeat(row[at], c))
        items.append(t["items"][np.repeat(start, c) + C.ranges(c)])
        places.append(np.repeat(at - first[row[at]], c))
        widths.append(np.full(len(items[-1]), t["k"]))
    if not rows:
        z = np.zeros(0, np.int64)
        return z, z, z, z
    return np.concatenate(rows), np.concatenate(items), np.concatenate(places), np.concatenate(widths)


def leaks(corpus: DataFrame, items: DataFrame, width: int = 8, limit: int = BROADCAST_NGRAMS) -> DataFrame:
    """``(row_key, item_id, n_words)``: corpus rows that hold width consecutive words of an item, or all of a shorter one.

    corpus has ``row_key, text``, items ``item_id, text``. ``n_words`` is how many
    words of the row lie in such windows. Null and empty texts hold nothing, an
    item without words is found nowhere, rows that occur twice come out once and
    empty tables give an empty result. The items are a stated evaluation set; their
    windows are counted first, and broadcast only up to limit. The scan is narrow;
    only hits are shuffled. Beyond limit, windows of the widths that items have meet in a
    join, those of the corpus past a Bloom filter of the items' windows; the result is the same.
    """
    spark = corpus.sparkSession
    items = items.select(F.col("item_id").cast("string"), "text").where("text IS NOT NULL AND item_id IS NOT NULL")
    corpus = corpus.select(F.col("row_key").cast("string").alias("row_key"), "text").where("text IS NOT NULL AND row_key IS NOT NULL")
    size = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0  # at least its number of windows
    if size > limit:
        return _leaks_joined(corpus, items, width)
    local = [(r[0], r[1]) for r in items.toLocalIterator()]
    grams = spark.sparkContext.broadcast(item_ngrams(sorted(local), width))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = pa.array(grams.value["ids"], pa.string())
        for batch in batches:
            text, done = batch.column("text"), 0
            for part in C.slices(text):
                r, i, place, k = _hits(part, grams.value)
                if len(r):
                    order = np.lexsort((place, i, r))
                    r, i, place, k = r[order], i[order], place[order], k[order]
                    new = np.ones(len(r), bool)
                    new[1:] = (r[1:] != r[:-1]) | (i[1:] != i[:-1])
                    reach = np.concatenate([[0], (place + k)[:-1]])
                    fresh = np.where(new, k, np.minimum(k, place + k - reach))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("row_key").take(pa.array(r[new] + done)), ids.take(pa.array(i[new])), pa.array(np.add.reduceat(fresh, np.flatnonzero(new)), pa.int64())], ["row_key", "item_id", "n_words"]
                    )
                done += len(part)

    hits = corpus.mapInArrow(scan, "row_key string, item_id string, n_words bigint")
    return hits.groupBy("row_key", "item_id").agg(F.max("n_words").alias("n_words"))


def _windows_of(df: DataFrame, keys: list[str], widths: list[int], bits: np.ndarray | None, short: bool) -> DataFrame:
    """``(keys, place, g, ws)``: hash, words and first word of each window of the widths; short gives a row of fewer words than the last width as one window.

    With bits, only windows that pass the Bloom filter come out.
    """
    shared = df.sparkSession.sparkContext.broadcast(bits)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in C.slices(batch.column("text")):
                h, n = C.word_hashes(*C.decode(part))
                row = np.repeat(np.arange(len(n)), n)
                first = np.cumsum(n) - n
                for k in widths:
                    g, at = windows(h, n, k)
                    ok = np.ones(len(g), bool) if shared.value is None else in_bloom(g, shared.value)
                    if short and k < widths[-1]:
                        ok &= n[row[at]] == k
                    g, at = g[ok], at[ok]
                    if len(g):
                        ws = pa.FixedSizeListArray.from_arrays(pa.array(h[at[:, None] + np.arange(k)].ravel().view(np.int64)), k).cast(pa.list_(pa.int64()))
                        own = [batch.column(x).take(pa.array(row[at] + done)) for x in keys]
                        yield pa.RecordBatch.from_arrays([*own, pa.array(at - first[row[at]]), pa.array(g.view(np.int64)), ws], [*keys, "place", "g", "ws"])
                done += len(part)

    kinds = ", ".join(f"{x} {df.schema[x].dataType.simpleString()}" for x in keys)
    return df.mapInArrow(cut, f"{kinds}, place bigint, g bigint, ws array<bigint>")


def _joined_hits(corpus: DataFrame, items: DataFrame, keys: list[str], width: int) -> DataFrame:
    """``(keys, item_id, place, k)``: hits by a join on window hashes, of the widths that items have and past a Bloom filter of their windows."""
    theirs = shared_table(_windows_of(items, ["item_id"], list(range(1, width + 1)), None, True).select("item_id", "g", "ws").distinct(), "windows")
    widths = sorted(r[0] for r in theirs.select(F.size("ws")).distinct().toLocalIterator())
    mine = _windows_of(corpus, keys, widths, bloom(theirs, "g"), False)
    return mine.join(theirs.withColumnRenamed("ws", "words"), "g").where("ws = words").select(*keys, "item_id", "place", F.size("ws").cast("bigint").alias("k"))


def _leaks_joined(corpus: DataFrame, items: DataFrame, width: int) -> DataFrame:
    hits = _joined_hits(corpus.withColumn("row", F.monotonically_increasing_id()), items, ["row", "row_key"], width)
    end = F.col("place") + F.col("k")
    before = F.coalesce(F.max(end).over(W.partitionBy("row", "item_id").orderBy("place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    covered = hits.withColumn("fresh", end - F.greatest(F.col("place"), before)).groupBy("row", "row_key", "item_id").agg(F.sum("fresh").alias("n"))
    return covered.groupBy("row_key", "item_id").agg(F.max("n").alias("n_words"))


def cut_words(text: pa.Array, row: np.ndarray, place: np.ndarray, width: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The texts in consistent form without the given stretches of words, and how many words each lost."""
    cps, off, start, end, n = C.word_spans(*C.decode(text))
    first = (np.cumsum(n) - n)[row] + place
    edge = np.zeros(len(cps) + 1, np.int64)
    np.add.at(edge, start[first], 1)
    np.add.at(edge, end[first + width - 1], -1)
    keep = np.cumsum(edge[:-1]) == 0
    lost = np.zeros(int(n.sum()) + 1, np.int64)
    np.add.at(lost, first, 1)
    np.add.at(lost, first + width, -1)
    gone = np.concatenate([[0], np.cumsum(np.cumsum(lost[:-1]) > 0)])
    ends = np.concatenate([[0], np.cumsum(keep)])
    word_off = np.concatenate([[0], np.cumsum(n)])
    return C.encode(cps[keep], ends[off], C.nulls(text)), gone[word_off[1:]] - gone[word_off[:-1]]


def _scrubbed(text: pa.Array, grams: dict) -> tuple[pa.Array, np.ndarray]:
    """Texts without any window of an item, and the words each lost; what a cut brings together is looked at again."""
    lost = np.zeros(len(text), np.int64)
    todo, now = np.arange(len(text)), text
    while len(todo):
        r, _, place, k = _hits(now, grams)
        if not len(r):
            break
        some, r = np.unique(r, return_inverse=True)
        now, n = cut_words(now.take(pa.array(some)), r, place, k)
        todo = todo[some]
        lost[todo] += n
        back = np.arange(len(text))
        back[todo] = len(text) + np.arange(len(todo))
        text = pa.concat_arrays([text, now]).take(pa.array(back))
    return text, lost


def without_leaks(corpus: DataFrame, items: DataFrame, width: int = 8, limit: int = BROADCAST_NGRAMS, documents: bool = False) -> DataFrame:
    """``(row_key, text, removed_words)``: the corpus without what leaked, one row per row that stays.

    Every stretch of words that holds width consecutive words of an item, or all of a
    shorter one, is cut out; where a cut brings words together that make up such a
    window, these go too, so nothing that ``leaks`` finds is left. A text that loses
    words comes in consistent form, any other as it was. With documents, rows that hold
    a window are left out whole. Null texts stay null, empty tables give an empty
    result. Up to limit item words the step is narrow; beyond it hits come from the join.
    """
    spark = corpus.sparkSession
    items = items.select(F.col("item_id").cast("string"), "text").where("text IS NOT NULL AND item_id IS NOT NULL")
    rows = corpus.select(F.col("row_key").cast("string").alias("row_key"), "text")
    size = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    schema = "row_key string, text string, removed_words bigint"
    if size > limit:
        out = _without_joined(rows, items, width)
    else:
        grams = spark.sparkContext.broadcast(item_ngrams(sorted((r[0], r[1]) for r in items.toLocalIterator()), width))

        def scrub(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                done = 0
                for part in C.slices(batch.column("text")):
                    text, lost = _scrubbed(part, grams.value)
                    yield pa.RecordBatch.from_arrays([batch.column("row_key").slice(done, len(part)), text, pa.array(lost)], ["row_key", "text", "removed_words"])
                    done += len(part)

        out = rows.mapInArrow(scrub, schema)
    return out.where("removed_words = 0") if documents else out


def _without_joined(rows: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """The same by joins on the row number: rounds of hits and cuts until a round finds none."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("at")
            n = np.asarray(at.value_lengths())
            flat = at.flatten()
            text, lost = cut_words(batch.column("text"), np.repeat(np.arange(len(n)), n), flat.field("place").to_numpy(), flat.field("k").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("row_key"), text, pa.array(lost + batch.column("removed_words").to_numpy())], ["row", "row_key", "text", "removed_words"])

    now = shared_table(rows.select(F.monotonically_increasing_id().alias("row"), "row_key", "text", F.lit(0).cast("bigint").alias("removed_words")), "corpus")
    fresh = now
    while True:
        hits = _joined_hits(fresh.where("text IS NOT NULL"), items, ["row"], width).select("row", "place", "k").distinct()
        hits = shared_table(hits.groupBy("row").agg(F.collect_list(F.struct("place", "k")).alias("at")), "hits")  # no more than the windows of one text
        if hits.isEmpty():
            return now.drop("row")
        fresh = shared_table(now.join(hits, "row").select("row", "row_key", "text", "removed_words", "at").mapInArrow(cut, now.schema), "cut")
        now = now.join(hits.select("row"), "row", "left_anti").unionByName(fresh)
