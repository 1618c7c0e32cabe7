"""Corpus preparation: grouping source tokens, leakage-safe deduplication, sampling, splitting, upsampling, mixing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilmoch.functions import bio as B
from tilmoch.functions import lexicon as L
from tilmoch.functions import text as S
from tilmoch.functions.numbers import positive_int, spoken_year, year_words


def source_row_reasons(df: DataFrame) -> DataFrame:
    """NUM7 on a source table of strings: ``sentence, token_order`` as numbers, ``reason`` null where the row is good."""
    sentence, order = positive_int(F.col("Sentence")), positive_int(F.col("TokenOrder"))
    tag = S.squeeze(F.col("NER_Tag"))
    reason = F.coalesce(
        F.when(sentence["reason"].isNotNull(), F.concat(sentence["reason"], F.lit("_sentence"))),
        F.when(order["reason"].isNotNull(), F.concat(order["reason"], F.lit("_order"))),
        F.when(F.coalesce(F.length(S.squeeze(F.col("Token"))), F.lit(0)) == 0, "missing_token"),
        F.when(tag.isNull() | ~tag.isin(*L.BIO_LABELS), "unknown_tag"),
    )
    return df.select(sentence["value"].alias("sentence"), order["value"].alias("token_order"), F.col("Token").alias("token"), tag.alias("tag"), reason.alias("reason"))


def grouped_sentences(rows: DataFrame) -> DataFrame:
    """AGG1 / AGG2: ``(id, tokens, ner_tags, reason)`` per sentence in token order.

    One bad row, a repeated order or tags that are no BIO reject the whole sentence
    with the first reason; rows without a sentence number belong to none.
    """
    cells = F.array_sort(F.collect_list(F.struct("token_order", "token", "tag")))
    g = rows.where("sentence IS NOT NULL").groupBy("sentence").agg(cells.alias("c"), F.min("reason").alias("bad"), F.count("*").alias("n"), F.countDistinct("token_order").alias("d"))
    g = g.select("sentence", "bad", "n", "d", F.transform("c", lambda x: x["token"]).alias("tokens"), F.transform("c", lambda x: x["tag"]).alias("ner_tags"))
    reason = F.coalesce("bad", F.when(F.col("d") < F.col("n"), "duplicate_order"), F.when(B.bio_reason(F.col("tokens"), F.col("ner_tags")).isNotNull(), F.concat(F.lit("bio_"), B.bio_reason(F.col("tokens"), F.col("ner_tags")))))
    return g.select(F.format_string("sentence-%06d", "sentence").alias("id"), "tokens", "ner_tags", reason.alias("reason"))


def stable_rank(key: Column, seed: int) -> Column:
    """SRT1: SHA-256 of ``seed:id``, a rank that no partitioning changes."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key), 256)


#: Samples up to this size are a distributed top-k; larger ones are cut by bucket sizes, so that no task sorts them.
TOP_K = 20_000


def _first(ranked: DataFrame, cap: int, key: str) -> DataFrame:
    """The first cap rows by ``_rank`` (a string) and key.

    Beyond TOP_K the sizes of the buckets of equal first characters say which buckets
    are in whole; only the one at the cut is ranked.
    """
    if cap <= TOP_K:
        return ranked.orderBy("_rank", key).limit(cap)
    ranked = ranked.withColumn("_b", F.substring("_rank", 1, 4))
    sizes = sorted((r["_b"], r["count"]) for r in ranked.groupBy("_b").count().toLocalIterator())  # at most 65,536 buckets
    left, whole, cut = cap, "", None
    for b, n in sizes:
        if n > left:
            cut = b
            break
        left, whole = left - n, b
    out = ranked.where(F.col("_b") <= whole)
    if cut is not None:
        out = out.unionByName(ranked.where(F.col("_b") == cut).orderBy("_rank", key).limit(left))
    return out.drop("_b")


def stable_sample(df: DataFrame, cap: int, seed: int, key: str = "id") -> DataFrame:
    """TOP1: the first cap rows by stable rank, without a global sort of the table."""
    return _first(df.withColumn("_rank", stable_rank(F.col(key), seed)), cap, key).drop("_rank")


def stable_sample_preferring(df: DataFrame, cap: int, seed: int, preferred: Column, key: str = "id") -> DataFrame:
    """TOP2: preferred rows first by one rank, the rest of the cap by another (seed + 17)."""
    p = F.coalesce(preferred, F.lit(False))
    rank = F.when(p, F.concat(F.lit("0"), stable_rank(F.col(key), seed))).otherwise(F.concat(F.lit("1"), stable_rank(F.col(key), seed + 17)))
    return _first(df.withColumn("_rank", rank), cap, key).drop("_rank")


def placed(ranked: DataFrame, key: str = "id") -> DataFrame:
    """WIN5: ``_at`` is each row's place (from 1) by ``_rank`` (hexadecimal) and key, ``_all`` the number of rows.

    Places are exact without one global window: rows fall into buckets by rank, bucket
    sizes give each bucket its first place, and rows are ranked within buckets.
    """
    ranked = ranked.withColumn("_b", F.conv(F.substring("_rank", 1, 3), 16, 10).cast("int"))
    sizes = ranked.groupBy("_b").agg(F.count("*").alias("_n"))
    first = sizes.select("_b", (F.sum("_n").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_first"), F.sum("_n").over(W.partitionBy()).alias("_all"))
    return ranked.join(first, "_b").withColumn("_at", F.col("_first") + F.row_number().over(W.partitionBy("_b").orderBy("_rank", key))).drop("_b", "_first")


def held_out(df: DataFrame, fraction: float, seed: int, group: str = "source", key: str = "id", least: int = 1000) -> DataFrame:
    """TOP3: ``part`` is dev for the first rows of each group by stable rank: the rounded share, at least one and never all, none of a single row.

    Group sizes come from an aggregate. A rank is a uniform number, so rows well
    below the cut's quantile are dev and rows well above it train without any sort;
    only the narrow band around it is ranked, after the number of rows below it.
    So a group with a third of all rows is not sorted by one task. Groups of fewer
    than least rows are ranked whole; the result is the same.
    """
    n = df.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_n"))
    cut = F.when(F.col("_n") >= 2, F.least(F.greatest(F.lit(1), F.bround(F.col("_n") * fraction).cast("bigint")), F.col("_n") - 1)).otherwise(0)
    sized = df.join(n.withColumn("_cut", cut), F.col(group).eqNullSafe(F.col("_g"))).withColumn("_rank", stable_rank(F.col(key), seed))
    share = F.conv(F.substring("_rank", 1, 13), 16, 10).cast("double") / 2.0**52
    # ten deviations of the rank at the cut; whether the cut does lie in the band is counted, and where not the group is ranked whole
    middle, margin = F.col("_cut") / F.col("_n"), 10 * F.sqrt(F.col("_cut") + 25) / F.col("_n")
    zone = F.when(F.col("_n") < least, 1).when(share < middle - margin, 0).when(share <= middle + margin, 1).otherwise(2)
    sized = sized.withColumn("_zone", zone)
    counts = sized.groupBy(F.col("_g").alias("_bg")).agg(F.count_if(F.col("_zone") == 0).alias("_below"), F.count_if(F.col("_zone") == 1).alias("_band"))
    sized = sized.join(counts, F.col("_g").eqNullSafe(F.col("_bg"))).drop("_bg")
    caught = F.col("_cut").between(F.col("_below"), F.col("_below") + F.col("_band"))
    sized = sized.withColumn("_zone", F.when(caught, F.col("_zone")).otherwise(1)).withColumn("_below", F.when(caught, F.col("_below")).otherwise(0)).drop("_band")
    place = F.col("_below") + F.row_number().over(W.partitionBy("_g").orderBy("_rank", key))
    band = sized.where("_zone = 1").withColumn("part", F.when(place <= F.col("_cut"), "dev").otherwise("train"))
    rest = sized.where("_zone <> 1").withColumn("part", F.when(F.col("_zone") == 0, "dev").otherwise("train"))
    return band.unionByName(rest).drop("_g", "_n", "_cut", "_rank", "_zone", "_below")


def split_80_10_10(df: DataFrame, seed: int, key: str = "id") -> DataFrame:
    """TOP4: train, validation and test by stable rank: floor of 80 and 10 percent, the rest test."""
    x = placed(df.withColumn("_rank", stable_rank(F.col(key), seed)), key)
    train, val = F.floor(F.col("_all") * 0.8), F.floor(F.col("_all") * 0.1)
    part = F.when(F.col("_at") <= train, "train").when(F.col("_at") <= train + val, "validation").otherwise("test")
    return x.withColumn("part", part).drop("_rank", "_all", "_at")


def filter_additions(df: DataFrame, seen: DataFrame, protected: DataFrame, denied: list[str], tokens: str = "tokens", key: str = "id") -> DataFrame:
    """JOIN2: every row with ``fp`` and a ``reason``: denylist, protected text, duplicate (of a seen text or of an earlier id); null if accepted.

    seen and protected have a column ``fp``. All three meet in one aggregate per
    fingerprint, combined before the shuffle; tokens travel once, to the join with it.
    """
    rows = df.withColumn("fp", S.fingerprint(F.array_join(tokens, " ")))
    mark = lambda x, p, s: x.select("fp", F.lit(None).cast(df.schema[key].dataType).alias("_k"), F.lit(p).alias("_p"), F.lit(s).alias("_s"))
    marks = rows.select("fp", F.col(key).alias("_k"), F.lit(False).alias("_p"), F.lit(False).alias("_s")).unionByName(mark(protected, True, False)).unionByName(mark(seen, False, True))
    marks = marks.groupBy("fp").agg(F.min("_k").alias("_first"), F.bool_or("_p").alias("_p"), F.bool_or("_s").alias("_s"))
    rows = rows.join(marks.where("_first IS NOT NULL"), "fp")
    ok = ~F.col("fp").isin(*denied) if denied else F.lit(True)
    reason = F.when(~ok, "denylist").when(F.col("_p"), "protected_exact_text").when(F.col("_s") | (F.col(key) > F.col("_first")), "normalized_duplicate")
    return rows.withColumn("reason", reason).drop("_p", "_s", "_first")


def overlapping(df: DataFrame, protected: DataFrame, low: int = 3, high: int = 5, key: str = "id") -> DataFrame:
    """JOIN3: ids of rows (``words``) that share an n-gram of low to high words with a protected row (``words``)."""
    mine = df.select(key, F.explode(B.ngrams(F.col("words"), low, high)).alias("g"))
    theirs = protected.select(F.explode(B.ngrams(F.col("words"), low, high)).alias("g")).distinct()
    return mine.join(theirs, "g", "left_semi").select(key).distinct()


def upsampled(df: DataFrame, factors: dict[str, int], tags: str = "ner_tags", key: str = "id") -> DataFrame:
    """UPS1: each row as often as the largest factor among its entity types; copies have ids ``::up1``, ``::up2``..."""
    types = B.entity_types(F.col(tags))
    factor = F.greatest(F.lit(1), F.lit(1), *[F.when(F.array_contains(types, t), f).otherwise(1) for t, f in factors.items()])
    out = df.withColumn("_c", F.explode(F.sequence(F.lit(0), factor - 1)))
    return out.withColumn(key, F.when(F.col("_c") == 0, F.col(key)).otherwise(F.concat(key, F.lit("::up"), F.col("_c").cast("string")))).drop("_c")


def length_summary(df: DataFrame, size: Column, by: list[str]) -> DataFrame:
    """AGG4: least, greatest, mean (6 places) and total length."""
    x = df.withColumn("_n", size)
    return x.groupBy(*by).agg(F.count("*").alias("rows"), F.min("_n").cast("bigint").alias("min_len"), F.max("_n").cast("bigint").alias("max_len"), F.bround(F.avg("_n"), 6).alias("mean_len"), F.sum("_n").alias("total_len"))


def name_lexicon(df: DataFrame, least_ratio: float = 0.6, denied: list[str] = ()) -> DataFrame:
    """AGG6: word keys that are PER tokens at least once and in least_ratio of their occurrences."""
    pairs = df.select(F.explode(S.zip2(F.transform("tokens", S.plain_comparison_key), F.col("ner_tags"))).alias("p")).select(F.col("p.0").alias("name"), F.col("p.1").isin("B-PER", "I-PER").alias("per"))
    g = pairs.where("name IS NOT NULL AND length(name) > 0 AND per IS NOT NULL").groupBy("name").agg(F.count("*").alias("total_count"), F.count_if("per").alias("per_count"))
    g = g.withColumn("per_ratio", F.bround(F.col("per_count") / F.col("total_count"), 6)).where((F.col("per_count") >= 1) & (F.col("per_count") / F.col("total_count") >= least_ratio))
    return g.where(~F.col("name").isin(*denied)) if denied else g


def list_digests(df: DataFrame, group: str, key: str) -> DataFrame:
    """STR24: ``(group, digest, n)``: SHA-256 of each group's keys in order, joined with line feeds.

    The digest is defined over the whole list, so a group streams through one task in
    key order; that task holds a batch and the state of the digest, never the list.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, digests, counts, now, state, n = [], [], [], None, None, 0
        for batch in batches:
            g, k = batch.column(0), batch.column(1)
            ends = np.flatnonzero(np.array(pc.not_equal(g[1:], g[:-1]))) + 1 if len(g) > 1 else np.zeros(0, int)
            for lo, hi in zip([0, *ends.tolist()], [*ends.tolist(), len(g)]):
                if lo == hi:
                    continue
                part, name = "\n".join(k.slice(lo, hi - lo).to_pylist()), g[lo].as_py()
                if state is None or name != now:
                    if state is not None:
                        names, digests, counts = [*names, now], [*digests, state.hexdigest()], [*counts, n]
                    now, state, n = name, hashlib.sha256(), 0
                state.update((("\n" if n else "") + part).encode())
                n += hi - lo
        if state is not None:
            names, digests, counts = [*names, now], [*digests, state.hexdigest()], [*counts, n]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(digests, pa.string()), pa.array(counts, pa.int64())], [group, "digest", "n"])

    x = df.select(group, key).where(F.col(group).isNotNull() & F.col(key).isNotNull())
    return x.repartition(group).sortWithinPartitions(group, key).mapInArrow(run, f"{group} string, digest string, n bigint")


def label_phrases(df: DataFrame, label: str) -> DataFrame:
    """ARR13: distinct alphabetic phrases of one label, with the number of records and the first id that holds each."""
    spans = F.filter(B.spans_of(F.col("ner_tags")), lambda s: s["type"] == label)
    norm = S.augmentation_tokens(F.col("tokens"))
    rows = df.select("id", F.explode(spans).alias("s"), norm.alias("t")).select("id", F.slice("t", F.col("s.first") + 1, F.col("s.last") - F.col("s.first") + 1).alias("w"))
    rows = rows.where(~F.exists("w", lambda x: ~x.rlike(r"^\p{L}+$")))
    return rows.groupBy(F.array_join("w", " ").alias("phrase")).agg(F.countDistinct("id").alias("records"), F.min("id").alias("first_id"))


# --- mining years from transcripts ------------------------------------------


def mined_years(df: DataFrame, text: str, key: str) -> DataFrame:
    """SPN21 and SPN22: ``(key, phrase, year, suffix, form)`` of spoken and of digit years before a form of ``yil``.

    A spoken phrase is the longest of up to seven number words that parses; it is
    left out after another number word and before a word of duration. Runs inside
    one row: transcripts are short arrays.
    """
    words = S.letter_words(F.col(text))
    base = df.select(F.col(key), words.alias("w"))
    base = base.select(key, "w", F.transform("w", lambda x: S.delete(F.lower(x), S.ASCII_APOSTROPHES)).alias("k"))
    at = F.filter(F.transform("k", lambda k, i: F.when(k.isin(*L.YEAR_SUFFIXES), i)), lambda i: i.isNotNull() & (i > 0))
    rows = base.select(key, "w", "k", F.explode(at).alias("i")).where(~F.coalesce(F.get("k", F.col("i") + 1).isin(*L.DURATION_FOLLOWERS), F.lit(False)))
    i = F.col("i")
    numbers = [*[k for k, v in L.CARDINALS.items()], "va"]
    starts = F.filter(F.sequence(F.greatest(F.lit(0), i - 7), i - 1), lambda s: spoken_year(F.slice("k", s + 1, i - s)).isNotNull())
    first = F.get(starts, F.lit(0))
    spoken = rows.withColumn("s", first).where("s IS NOT NULL").where(~((F.col("s") > 0) & F.get("k", F.greatest(F.col("s") - 1, F.lit(0))).isin(*numbers)))
    spoken = spoken.select(key, F.slice("w", F.col("s") + 1, i - F.col("s") + 1).alias("phrase"), spoken_year(F.slice("k", F.col("s") + 1, i - F.col("s"))).alias("year"), F.get("k", i).alias("suffix"), F.lit("observed_spoken").alias("form"))
    digits = F.get("k", i - 1)
    year = F.when(digits.rlike("^[0-9]{1,9}$"), digits.try_cast("int"))
    numeric = rows.withColumn("year", year).where("year BETWEEN 1800 AND 2035")
    numeric = numeric.select(key, F.concat(year_words(F.col("year")), F.array(F.get("w", i))).alias("phrase"), "year", F.get("k", i).alias("suffix"), F.lit("digit_calendar_year_to_spoken").alias("form"))
    return spoken.unionByName(numeric)


def best_per_phrase(mined: DataFrame) -> DataFrame:
    """AGG8: one record per phrase key, spoken ones before those made from digits, then the smallest key; an associative minimum."""
    k = mined.withColumn("phrase_key", F.array_join(S.word_keys(F.col("phrase")), " "))
    pick = F.min(F.struct(F.when(F.col("form") == "observed_spoken", 0).otherwise(1).alias("o"), F.col("key").alias("key"), F.col("phrase").alias("phrase"), F.col("year").alias("year"), F.col("suffix").alias("suffix"), F.col("form").alias("form")))
    return k.groupBy("phrase_key").agg(pick.alias("b")).select("phrase_key", "b.phrase", "b.year", "b.suffix", "b.form")
