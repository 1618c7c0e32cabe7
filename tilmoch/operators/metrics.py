"""Scores of transcripts and entity spans: error rates, multiset F1, mentions, alignment."""

from __future__ import annotations

import difflib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilmoch.functions import bio as B
from tilmoch.functions import lexicon as L
from tilmoch.functions import text as S

#: Texts of more words or characters than this are compared by bit vectors.
LONG = 2000


def bit_distance(a: list | str, b: list | str) -> int:
    """Edit distance by bit vectors of any length: one step per element of b, whatever the number of distinct ones."""
    if not a:
        return len(b)
    masks: dict = {}
    for i, x in enumerate(a):
        masks.setdefault(x, []).append(i)
    for x, places in masks.items():
        bits = bytearray(len(a) // 8 + 1)
        for i in places:
            bits[i >> 3] |= 1 << (i & 7)
        masks[x] = int.from_bytes(bits, "little")
    full, top, out = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = full, 0  # where the column of the table rises and falls
    for x in b:
        eq = masks.get(x, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        right_up, right_down = (down | ~(diagonal | up)) & full, up & diagonal
        out += bool(right_up & top) - bool(right_down & top)
        right_up, right_down = (right_up << 1) | 1, right_down << 1
        vertical = eq | down
        up, down = (right_down | ~(vertical | right_up)) & full, right_up & vertical
    return out


@F.arrow_udf(T.IntegerType())
def _long_texts(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    return pa.array([None if a is None or b is None else bit_distance(a, b) for a, b in zip(ref.to_pylist(), hyp.to_pylist())], pa.int32())


def char_edits(ref: Column, hyp: Column) -> Column:
    """Edit distance of two texts in characters, long ones by bit vectors."""
    long = F.greatest(F.length(ref), F.length(hyp)) > LONG
    # the function of long texts gets nulls for all others
    return F.when(long, _long_texts(F.when(long, ref), F.when(long, hyp))).otherwise(F.levenshtein(F.when(~long, ref), F.when(~long, hyp)))


def rate(errors: Column, units: Column) -> Column:
    """A rate with an empty reference is null."""
    return F.when(units > 0, errors / units)


def _edit_counts(ref: list[np.ndarray], hyp: list[np.ndarray], cells: int = 1 << 21) -> np.ndarray:
    """Substitutions, deletions and insertions of each pair on one best path; pairs of like lengths are filled together, about cells numbers at a time."""
    n, m = np.array([len(x) for x in ref], np.int64), np.array([len(x) for x in hyp], np.int64)
    out = np.zeros((len(ref), 3), np.int64)
    order, at = np.lexsort((n, m)), 0
    while at < len(order):
        to = at + 1
        while to < len(order) and (to + 1 - at) * (m[order[to]] + 1) <= cells:
            to += 1
        part = order[at:to]
        out[part] = _filled([ref[i] for i in part], [hyp[i] for i in part])
        at = to
    return out


def _filled(ref: list[np.ndarray], hyp: list[np.ndarray]) -> np.ndarray:
    rows = len(ref)
    n, m = np.array([len(x) for x in ref]), np.array([len(x) for x in hyp])
    a, b = np.full((rows, max(1, int(n.max()))), -1, np.int64), np.full((rows, max(1, int(m.max()))), -2, np.int64)
    for i in range(rows):
        a[i, : n[i]], b[i, : m[i]] = ref[i], hyp[i]
    # cost in the high bits, then substitutions: a best path with the fewest of them, and its deletions
    gap = np.int64(1) << np.int64(32)
    slope = np.arange(b.shape[1] + 1) * gap
    row = np.broadcast_to(slope, (rows, b.shape[1] + 1)).copy()
    out = np.where(n == 0, row[np.arange(rows), m], 0)
    for i in range(1, int(n.max()) + 1):
        diagonal = row[:, :-1] + np.where(a[:, i - 1 : i] == b, 0, gap + 1)
        new = row + gap
        new[:, 1:] = np.minimum(new[:, 1:], diagonal)
        row = np.minimum.accumulate(new - slope, axis=1) + slope  # insertions along the row
        ends = np.flatnonzero(n == i)
        out[ends] = row[ends, m[ends]]
    edits, subs = out >> 32, out & ((1 << 32) - 1)
    # deletions - insertions = length difference, and both add up to the rest of the edits
    deletions = (edits - subs + (n - m)) // 2
    return np.stack([subs, deletions, edits - subs - deletions], axis=1)


def _coded(ref: pa.Array, hyp: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Both word arrays with each distinct word of the batch as a number; null arrays count as empty."""
    a, b = ref.flatten(), hyp.flatten()
    codes = pa.concat_arrays([a, b]).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)

    def parts(x: pa.Array, codes: np.ndarray) -> list[np.ndarray]:
        size = np.asarray(x.value_lengths().fill_null(0))
        return np.split(codes, np.cumsum(size)[:-1]) if len(size) else []

    return parts(ref, codes[: len(a)]), parts(hyp, codes[len(a) :])


@F.arrow_udf(T.LongType())
def word_edits(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    """Edit distance of two word arrays, all pairs of a batch together; very long ones by bit vectors. Null arrays count as empty."""
    a, b = _coded(ref, hyp)
    long = np.array([max(len(x), len(y)) > LONG for x, y in zip(a, b)], bool)
    out = np.zeros(len(a), np.int64)
    short = np.flatnonzero(~long)
    if len(short):
        out[short] = _edit_counts([a[i] for i in short], [b[i] for i in short]).sum(axis=1)
    for i in np.flatnonzero(long):
        out[i] = bit_distance(a[i].tolist(), b[i].tolist())
    return pa.array(out)


@F.arrow_udf(T.StructType().add("substitutions", T.LongType()).add("deletions", T.LongType()).add("insertions", T.LongType()))
def edit_split(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    """AGG13: substitutions, deletions and insertions between two word arrays.

    The total is the edit distance; among best paths one with the fewest
    substitutions is counted. Null arrays count as empty.
    """
    out = _edit_counts(*_coded(ref, hyp)) if len(ref) else np.zeros((0, 3), np.int64)
    return pa.StructArray.from_arrays([pa.array(out[:, i]) for i in range(3)], ["substitutions", "deletions", "insertions"])


def transcript_rates(df: DataFrame, ref: str, hyp: str) -> DataFrame:
    """AGG13: raw and normalized word errors and normalized character errors with their units, per row; a null hypothesis is an empty one."""
    r, h = F.coalesce(F.col(ref), F.lit("")), F.coalesce(F.col(hyp), F.lit(""))
    split = lambda x: F.filter(F.split(S.squeeze(x), " "), lambda w: w != "")
    t = df.withColumn("_rn", S.normalize_evaluation(r)).withColumn("_hn", S.normalize_evaluation(h))
    t = t.withColumn("_rw", split(r)).withColumn("_hw", split(h)).withColumn("_rnw", split(F.col("_rn"))).withColumn("_hnw", split(F.col("_hn")))
    t = t.withColumn("raw_word_errors", word_edits(F.col("_rw"), F.col("_hw")).cast("bigint")).withColumn("raw_words", F.size("_rw").cast("bigint"))
    t = t.withColumn("word_errors", word_edits(F.col("_rnw"), F.col("_hnw")).cast("bigint")).withColumn("words", F.size("_rnw").cast("bigint"))
    t = t.withColumn("char_errors", char_edits(F.col("_rn"), F.col("_hn")).cast("bigint")).withColumn("chars", F.length("_rn").cast("bigint"))
    return t.drop("_rn", "_hn", "_rw", "_hw", "_rnw", "_hnw")


def corpus_rates(rates: DataFrame, by: list[str]) -> DataFrame:
    """AGG14: errors over units of a group, not a mean of rates."""
    s = rates.groupBy(*by).agg(F.count("*").alias("samples"), *[F.sum(c).alias(c) for c in ("raw_word_errors", "raw_words", "word_errors", "words", "char_errors", "chars")])
    return s.withColumn("raw_wer", F.round(rate(F.col("raw_word_errors"), F.col("raw_words")), 9)).withColumn("normalized_wer", F.round(rate(F.col("word_errors"), F.col("words")), 9)).withColumn("normalized_cer", F.round(rate(F.col("char_errors"), F.col("chars")), 9))


def f1_columns(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """Precision, recall and F1, each 0 where its denominator is."""
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    f = F.when(2 * tp + fp + fn > 0, 2.0 * tp / (2 * tp + fp + fn)).otherwise(0.0)
    return [F.round(p, 9).alias("precision"), F.round(r, 9).alias("recall"), F.round(f, 9).alias("f1")]


def span_counts(gold: DataFrame, pred: DataFrame, by: list[str], key: list[str]) -> DataFrame:
    """JOIN7: tp, fp, fn per group from the multiset intersection of gold and predicted rows with equal key."""
    cols = list(dict.fromkeys([*by, *key]))
    both = gold.select(*cols, F.lit(1).alias("g"), F.lit(0).alias("p")).unionByName(pred.select(*cols, F.lit(0).alias("g"), F.lit(1).alias("p")))
    c = both.groupBy(*cols).agg(F.sum("g").alias("g"), F.sum("p").alias("p"))
    return c.groupBy(*by).agg(F.sum(F.least("g", "p")).alias("tp"), F.sum(F.greatest(F.col("p") - F.col("g"), F.lit(0))).alias("fp"), F.sum(F.greatest(F.col("g") - F.col("p"), F.lit(0))).alias("fn"))


def entity_scores(gold: DataFrame, pred: DataFrame, key: list[str], labels: list[str] = L.LABELS) -> DataFrame:
    """AGG11: scores per label, ``overall`` from summed counts, and ``macro`` as the mean F1 of all labels, those without support as 0."""
    counts = span_counts(gold, pred, ["label"], key)
    dim = gold.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    per = dim.join(counts, "label", "left").select("label", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("tp", "fp", "fn")))
    per = per.select("*", *f1_columns(F.col("tp"), F.col("fp"), F.col("fn")))
    total = per.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).select(F.lit("overall").alias("label"), "tp", "fp", "fn", *f1_columns(F.col("tp"), F.col("fp"), F.col("fn")))
    macro = per.agg(F.round(F.avg("f1"), 9).alias("f1")).select(F.lit("macro").alias("label"), *(F.lit(None).cast("bigint").alias(c) for c in ("tp", "fp", "fn")), F.lit(None).cast("double").alias("precision"), F.lit(None).cast("double").alias("recall"), "f1")
    return per.unionByName(total).unionByName(macro).withColumn("support", F.col("tp") + F.col("fn"))


def mention_accuracy(df: DataFrame, entities: str, hyp: str, by: list[str]) -> DataFrame:
    """AGG15: gold mentions found in the hypothesis, per label; a phrase counts at most as often as it is gold. Null where a label has none."""
    hw = F.filter(F.split(S.normalize_evaluation(F.coalesce(F.col(hyp), F.lit(""))), " "), lambda w: w != "")
    rows = df.withColumn("_row", F.monotonically_increasing_id()).withColumn("_hw", hw)
    e = rows.select("_row", *by, "_hw", F.explode(entities).alias("e")).select("_row", *by, "_hw", F.col("e.label").alias("label"), S.normalize_evaluation(F.col("e.text")).alias("phrase"))
    g = e.groupBy("_row", *by, "label", "phrase", "_hw").agg(F.count("*").alias("n"))
    found = F.least(F.col("n"), B.occurrences(F.col("_hw"), F.filter(F.split("phrase", " "), lambda w: w != "")).cast("bigint"))
    out = g.groupBy(*by, "label").agg(F.sum(found).alias("found"), F.sum("n").alias("gold"))
    return out.withColumn("accuracy", F.round(rate(F.col("found"), F.col("gold")), 9))


def tag_spans(df: DataFrame, tags: str, keys: list[str]) -> DataFrame:
    """WIN4: ``(keys, label, first, last)`` rows of the BIO runs of a tag column."""
    return df.select(*keys, F.explode(B.spans_of(F.col(tags))).alias("s")).select(*keys, F.col("s.type").alias("label"), F.col("s.first").alias("first"), F.col("s.last").alias("last"))


SPAN = "array<struct<text:string,label:string,start:int,end:int>>"


@F.arrow_udf(T.ArrayType(T.StructType().add("text", T.StringType()).add("label", T.StringType()).add("start", T.IntegerType()).add("end", T.IntegerType())))
def _aligned(ref: pa.Array, hyp: pa.Array, ref_tokens: pa.Array, hyp_tokens: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for r, h, rt, ht, es in zip(ref.to_pylist(), hyp.to_pylist(), ref_tokens.to_pylist(), hyp_tokens.to_pylist(), spans.to_pylist()):
        rt, ht, found = rt or [], ht or [], []
        blocks = difflib.SequenceMatcher(None, [x["form"] for x in ht], [x["form"] for x in rt], autojunk=False).get_matching_blocks()
        to = {b.a + k: b.b + k for b in blocks for k in range(b.size)}
        beyond = len(r or "") + 1  # the next free place past the end
        for e in es or []:
            if (h or "")[e["start"] : e["end"]] != e["text"]:
                raise ValueError(f"the span {e['start']}-{e['end']} of {e['text']!r} is no slice of its text")
            own = [i for i, x in enumerate(ht) if e["start"] <= x["start"] and x["end"] <= e["end"]]
            whole = own and ht[own[0]]["start"] == e["start"] and ht[own[-1]]["end"] == e["end"]
            hits = [to[i] for i in own if i in to]
            if whole and len(hits) == len(own) and hits[-1] - hits[0] == len(own) - 1:
                s, t = rt[hits[0]]["start"], rt[hits[-1]]["end"]
                found.append({"text": r[s:t], "label": e["label"], "start": s, "end": t})
            else:
                found.append({"text": e["text"], "label": e["label"], "start": beyond, "end": beyond + 1})
                beyond += 2
        out.append(found)
    return pa.array(out, pa.list_(pa.struct([("text", pa.string()), ("label", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))


def align_to_reference(ref: Column, hyp: Column, spans: Column) -> Column:
    """JOIN11: spans of a hypothesis moved to the reference where they begin and end with a word and their words match it in one run.

    Any other span gets a place of its own past the reference's end: the first at one
    past it, each further one two on. A span that is no slice of its text is an error.

    Matching is by longest common blocks (Ratcliff and Obershelp), which no
    relational operator gives, so it runs on Arrow batches.
    """
    return _aligned(ref, hyp, S.metric_tokens(ref), S.metric_tokens(hyp), spans.cast(SPAN))


def project_spans(df: DataFrame, text: str, spans: str, keys: list[str]) -> DataFrame:
    """JOIN12: ``(keys, label, text, start, end)`` of spans moved from a raw text to its STR2 form.

    The lengths of the normalized prefix, and of prefix and span, give the new
    offsets. A span whose parts do not normalize apart (the slice differs from the
    normalized span) is left out.
    """
    rows = df.select(*keys, F.col(text).alias("_t"), F.posexplode(spans).alias("_i", "e"))
    head, body = F.col("_t").substr(F.lit(1), F.col("e.start")), F.col("_t").substr(F.col("e.start") + 1, F.col("e.end") - F.col("e.start"))
    stop = "\u0002"  # keeps a trailing blank of the prefix from being stripped
    rows = rows.withColumn("_w", S.normalize_runtime(F.col("_t"))).withColumn("_b", S.normalize_runtime(body))
    rows = rows.withColumn("_s", F.length(S.normalize_runtime(F.concat(head, F.lit(stop)))) - 1).withColumn("_e", F.col("_s") + F.length("_b"))
    good = F.col("_w").substr(F.col("_s") + 1, F.length("_b")) == F.col("_b")
    return rows.where(good).select(*keys, F.col("e.label").alias("label"), F.col("_b").alias("text"), F.col("_s").alias("start"), F.col("_e").alias("end"))
