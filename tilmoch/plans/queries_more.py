"""Queries of the analysis view, joins, reports, selection, sources and pipelines."""

from __future__ import annotations

import itertools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilmoch.functions import bio as B
from tilmoch.functions import lexicon as L
from tilmoch.functions import text as S
from tilmoch.operators import analysis as A
from tilmoch.operators import audio as U
from tilmoch.operators import corpus as K
from tilmoch.operators import metrics as M
from tilmoch.operators import reports as R
from tilmoch.operators import spans as P
from tilmoch.operators import templates as TP
from tilmoch.plans import pipeline as PL
from tilmoch.plans.queries import NER, STT, ner, sql_of, q, query, sql_evaluation, sql_full_text, sql_list, sql_runtime, stt, table
from tilmoch.session import checkpoint_dir, shared_table
from tilmoch.sources import io

SQL_NAME_KEY = r"regexp_replace(lower(source), '[^\p{L}\p{N}]+', '', 'g')"

# --- analysis view ----------------------------------------------------------


def _view(spark: SparkSession, sf: str) -> DataFrame:
    return A.with_view(table(spark, sf, "speech_ner_eval").select("id", "text"), "text")


@query(None)
def spn14_spn18_view(spark: SparkSession, sf: str) -> DataFrame:
    """SPN14 to SPN18: the analysis text of every spoken item and how many pieces of each kind it has."""
    v = _view(spark, sf)
    n = lambda k: F.size(F.filter("view.pieces", lambda p: p["kind"] == k)).cast("bigint").alias(k)
    return v.select("id", F.col("view.analysis_text").alias("analysis_text"), *[n(k) for k in ("identity", *A.PRIORITY)])


@query("SELECT 0::BIGINT AS wrong_slices, 0::BIGINT AS wrong_sources, 0::BIGINT AS out_of_order")
def spn14_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces are slices of the analysis text, unchanged ones equal their source, and both offsets rise."""
    v = _view(spark, sf).select("text", "view")
    ps, at, t = F.col("view.pieces"), F.col("view.analysis_text"), F.col("text")
    wrong = F.filter(ps, lambda p: at.substr(p["analysis_start"] + 1, p["analysis_end"] - p["analysis_start"]) != p["text"])
    source = F.filter(ps, lambda p: (p["kind"] == "identity") & (t.substr(p["source_start"] + 1, p["source_end"] - p["source_start"]) != p["text"]))
    order = F.filter(ps, lambda p, i: (i > 0) & (p["analysis_start"] < F.get(ps, F.greatest(i - 1, F.lit(0)))["analysis_end"]))
    return v.select(F.size(wrong).alias("a"), F.size(source).alias("b"), F.size(order).alias("c")).agg(F.sum("a").alias("wrong_slices"), F.sum("b").alias("wrong_sources"), F.sum("c").alias("out_of_order"))


_GOLD_VIEW = [
    (1, "mening ismim am Akmal oltinchi avgust kuni soatda uchda Toshkent shahrida", "mening ismim, Akmal 6-avgust kuni soat 3 da Toshkent shahrida"),
    (2, "ikki ming yigirma oltinchi yil davlat universitetida", "2026-yil Davlat universitetida"), (3, "karimov Akmal am keldi", "Karimov Akmal, keldi"), (4, "Salom.", "Salom."),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, {q(b)})" for i, _, b in _GOLD_VIEW) + ") v(id, analysis_text)")
def spn15_spn18_golden(spark: SparkSession, sf: str) -> DataFrame:
    x = spark.createDataFrame([(i, t) for i, t, _ in _GOLD_VIEW], "id int, text string")
    return A.with_view(x, "text").select("id", F.col("view.analysis_text").alias("analysis_text"))


@query("SELECT * FROM (VALUES (1, 18, 33, 'oltinchi avgust'), (2, 0, 30, 'ikki ming yigirma oltinchi yil'), (3, NULL, NULL, NULL)) v(id, s, e, surface)")
def spn19_join8_projection(spark: SparkSession, sf: str) -> DataFrame:
    """SPN19 on golden spans: a changed day and month, a changed year, and a span across a filler."""
    x = spark.createDataFrame([(1, "keldi Akmal bilan oltinchi avgust kuni", 18, 26), (2, "ikki ming yigirma oltinchi yil keldi", 0, 8), (3, "ismim am Akmal", 0, 12)], "id int, text string, s int, e int")
    x = A.with_view(x, "text").withColumn("p", A.projected(F.col("view"), F.col("s"), F.col("e")))
    return x.select("id", F.col("p.start").alias("s"), F.col("p.end").alias("e"), F.col("text").substr(F.col("p.start") + 1, F.col("p.end") - F.col("p.start")).alias("surface"))


@query("SELECT * FROM (VALUES ('DATE', 0, 30, 0.9::DOUBLE), ('LOC', 36, 53, 0.8::DOUBLE)) v(label, s, e, score)")
def spn20_join9_admitted(spark: SparkSession, sf: str) -> DataFrame:
    """SPN20 on a golden transcript: a date completed to its full phrase, a place by its head, a person without evidence and one below threshold left out."""
    text = "ikki ming yigirma oltinchi yil kuni toshkent shahrida Akmal"
    x = spark.createDataFrame([(text,)], "t string")
    x = A.with_view(x, "t").withColumn("tok", S.word_tokens(F.col("t")))
    x = P.with_temporal(x, "tok", "dates")
    a = F.col("view.analysis_text")
    at = lambda w: (F.instr(a, w) - 1).cast("int")
    one = lambda label, w, score: F.struct(F.lit(label).alias("label"), at(w).alias("start"), (at(w) + len(w)).alias("end"), F.lit(score).alias("score"))
    x = x.withColumn("es", F.array(one("DATE", "2026-yil", 0.9), one("LOC", "Toshkent shahrida", 0.8), one("PER", "Akmal", 0.9), one("DATE", "kuni", 0.5)))
    x = A.with_admitted(x, "view", "es", "tok", "dates", 0.7, "c")
    x = x.select(F.explode_outer("c").alias("c")).where("c IS NOT NULL")
    return x.select("c.label", F.col("c.start").alias("s"), F.col("c.end").alias("e"), "c.score")


_BIO_ROWS = [(1, "B-PER", 0.9, 0, 5), (1, "I-PER", 0.7, 6, 13), (1, "O", 0.9, 14, 19), (1, "I-LOC", 0.9, 20, 28), (2, "B-ORG", 0.4, 0, 4), (2, "B-TEMPORAL", 0.95, 5, 9), (2, "I-TEMPORAL", 0.95, 10, 14), (2, "B-TEMPORAL", 0.9, 15, 19)]


@query("SELECT * FROM (VALUES (1, 'PER', 0, 13, 0.8::DOUBLE), (1, 'LOC', 20, 28, 0.9::DOUBLE), (2, 'DATE', 5, 14, 0.95::DOUBLE), (2, 'DATE', 15, 19, 0.9::DOUBLE)) v(id, label, s, e, score)")
def spn10_decode(spark: SparkSession, sf: str) -> DataFrame:
    x = spark.createDataFrame(_BIO_ROWS, "id int, label string, score double, start int, end int").groupBy("id").agg(F.collect_list(F.struct("label", "score", "start", "end")).alias("p"))
    x = PL.decode_bio(x, "p", 0.6, {"PER": "PER", "LOC": "LOC", "ORG": "ORG", "TEMPORAL": "DATE"})
    return x.select("id", F.explode("entities").alias("e")).select("id", "e.label", F.col("e.start").alias("s"), F.col("e.end").alias("e"), F.round("e.score", 6).alias("score"))


@query("SELECT id, e.label AS label, e.text AS text, (instr(text, e.text) - 1)::BIGINT AS s, (instr(text, e.text) - 1 + length(e.text))::BIGINT AS e FROM (SELECT id, text, unnest(entities) AS e FROM prompts) WHERE instr(text, e.text) > 0 AND instr(text[instr(text, e.text) + 1:], e.text) = 0")
def spn23_unique_surfaces(spark: SparkSession, sf: str) -> DataFrame:
    """SPN23: prompt entities whose surface occurs exactly once, with offsets."""
    x = table(spark, sf, "prompts").select("id", "text", F.explode("entities").alias("e"))
    at = F.instr("text", F.col("e.text"))
    again = F.instr(F.col("text").substr(at + 1, F.length("text")), F.col("e.text"))
    return x.where((at > 0) & (again == 0)).select("id", "e.label", "e.text", (at - 1).cast("bigint").alias("s"), (at - 1 + F.length("e.text")).cast("bigint").alias("e"))


# --- joins ------------------------------------------------------------------


@query("SELECT coalesce(a.k, b.k) AS sample_id, CASE WHEN a.k IS NULL THEN 'unexpected' ELSE 'missing' END AS side FROM (SELECT DISTINCT sample_id AS k FROM stt_predictions WHERE model_key = 'stt_orta') a FULL JOIN (SELECT DISTINCT sample_id AS k FROM stt_predictions WHERE model_key = 'stt_oqim') b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def join4_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """JOIN4: samples that one of two models did not transcribe."""
    x = table(spark, sf, "stt_predictions")
    return R.key_mismatch(x.where("model_key = 'stt_orta'"), x.where("model_key = 'stt_oqim'"), "sample_id")


# The ablations with their models, normalization, run and mode.
ABLATIONS = [("A", "audio", "stt_kichik", False, "clean"), ("B", "audio", "stt_kichik", True, "clean"), ("C", "audio", "stt_kichik", True, "augmented"), ("D", "audio", "stt_orta", False, "clean"), ("E", "audio", "stt_orta", True, "clean"), ("F", "audio", "stt_orta", True, "augmented"), ("G", "gold", None, True, "clean"), ("H", "gold", None, True, "augmented")]


@query(
    "WITH a(ablation, origin, model_key, normalized, run) AS (VALUES " + ", ".join(f"('{a}', '{o}', {q(m) if m else 'NULL'}, {str(n).lower()}, '{r}')" for a, o, m, n, r in ABLATIONS) + f""")
    , g AS (SELECT sample_id, any_value(gold_transcript) AS gold_transcript FROM {STT} GROUP BY 1)
    SELECT ablation, count(*) AS samples, sum(length(CASE WHEN normalized THEN {sql_runtime('t')} ELSE t END))::BIGINT AS chars
    FROM (SELECT ablation, normalized, coalesce(raw_transcript, '') AS t FROM a JOIN {STT} p USING (model_key) UNION ALL SELECT ablation, normalized, gold_transcript FROM a, g WHERE origin = 'gold') GROUP BY ablation
    """
)
def join6_ablation_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """JOIN6: texts that go into each ablation: a model's transcripts or the gold ones, normalized or not."""
    a = spark.createDataFrame(ABLATIONS, "ablation string, origin string, model_key string, normalized boolean, run string")
    p = stt(spark, sf)
    heard = a.where("origin = 'audio'").join(p, "model_key").select("ablation", "normalized", F.coalesce("raw_transcript", F.lit("")).alias("t"))
    # every gold text belongs to every gold ablation: the fixed list is exploded on the row, no product of tables
    gold = p.groupBy("sample_id").agg(F.min("gold_transcript").alias("t"))
    gold = gold.select(F.explode(F.array(*[F.struct(F.lit(x[0]).alias("ablation"), F.lit(x[3]).alias("normalized")) for x in ABLATIONS if x[1] == "gold"])).alias("a"), "t").select("a.ablation", "a.normalized", "t")
    t = heard.unionByName(gold)
    return t.groupBy("ablation").agg(F.count("*").alias("samples"), F.sum(F.length(F.when(F.col("normalized"), S.normalize_runtime(F.col("t"))).otherwise(F.col("t")))).alias("chars"))


@query(
    """
    WITH g AS (SELECT id, e.label AS label, e."start" AS s, e."end" AS t FROM (SELECT id, unnest(entities) AS e FROM speech_ner_eval)), p AS (SELECT id, e.label AS label, e."start" AS s, e."end" AS t FROM (SELECT id, unnest(model_entities) AS e FROM speech_ner_eval))
    SELECT g.id, g.label AS gold_label, p.label AS model_label, g.s::BIGINT AS gold_start, p.s::BIGINT AS model_start, (least(g.t, p.t) - greatest(g.s, p.s))::BIGINT AS shared, g.s >= p.s AND g.t <= p.t AS contained FROM g JOIN p ON g.id = p.id AND g.s < p.t AND p.s < g.t
    """
)
def join8_join9_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """JOIN8 and JOIN9: overlapping and contained spans within a text, an equi-join on the text with an interval condition."""
    x = table(spark, sf, "speech_ner_eval")
    g = x.select("id", F.explode("entities").alias("g")).select("id", F.col("g.label").alias("gold_label"), F.col("g.start").alias("gs"), F.col("g.end").alias("ge"))
    p = x.select("id", F.explode("model_entities").alias("p")).select("id", F.col("p.label").alias("model_label"), F.col("p.start").alias("ps"), F.col("p.end").alias("pe"))
    j = g.join(p, "id").where("gs < pe AND ps < ge")
    return j.select("id", "gold_label", "model_label", F.col("gs").cast("bigint").alias("gold_start"), F.col("ps").cast("bigint").alias("model_start"), (F.least("ge", "pe") - F.greatest("gs", "ps")).cast("bigint").alias("shared"), ((F.col("gs") >= F.col("ps")) & (F.col("ge") <= F.col("pe"))).alias("contained"))


_ALIGN = [
    (1, "Toshkent shahriga keldi", "Toshkentda keldi", [("Toshkent", "LOC", 0, 8), ("keldi", "PER", 11, 16), ("kel", "ORG", 11, 14)]),
    (2, "Ali Vali bugun", "Ali va Vali bugun", [("Ali va Vali", "PER", 0, 11), ("bugun", "DATE", 12, 17), ("Ali", "PER", 0, 3)]),
    (3, "bir ikki uch", "BIR  ikki", [("BIR  ikki", "ORG", 0, 9), (" ikki", "ORG", 4, 9)]),
]


@query("SELECT * FROM (VALUES (1, 0, 'LOC', 'Toshkent', 24, 25), (1, 1, 'PER', 'keldi', 18, 23), (1, 2, 'ORG', 'kel', 26, 27), (2, 0, 'PER', 'Ali va Vali', 15, 16), (2, 1, 'DATE', 'bugun', 9, 14), (2, 2, 'PER', 'Ali', 0, 3), (3, 0, 'ORG', 'bir ikki', 0, 8), (3, 1, 'ORG', ' ikki', 13, 14)) v(id, i, label, text, s, e)")
def join11_golden(spark: SparkSession, sf: str) -> DataFrame:
    """JOIN11: part of a word, an inserted word, a blank too many and moved words; places past the end are numbered as they are given out."""
    x = spark.createDataFrame(_ALIGN, f"id int, r string, h string, es {M.SPAN}")
    x = x.select("id", F.posexplode(M.align_to_reference(F.col("r"), F.col("h"), F.col("es"))).alias("i", "e"))
    return x.select("id", "i", "e.label", "e.text", F.col("e.start").alias("s"), F.col("e.end").alias("e"))


@query(
    """
    SELECT count(*) AS spans, 0::BIGINT AS wrong_slices, 0::BIGINT AS wrong_places
    FROM (SELECT unnest(gold_entities) AS e, raw_transcript AS r FROM (SELECT DISTINCT ON (prediction_id) * FROM stt_predictions) WHERE raw_transcript IS NOT NULL) WHERE instr(r, e.text) > 0
    """
)
def join11_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """JOIN11: gold entities found on the recognised text and moved to the gold transcript: each a slice of it, or at a place past its end."""
    p = stt(spark, sf).where("raw_transcript IS NOT NULL").select("prediction_id", "gold_transcript", "raw_transcript", "gold_entities")
    # a span on the transcript: the place of each gold surface in it, where it has one
    at = lambda e: F.instr("raw_transcript", e["text"]) - 1
    spans = F.filter(F.transform("gold_entities", lambda e: F.struct(e["text"].alias("text"), e["label"].alias("label"), at(e).alias("start"), (at(e) + F.length(e["text"])).alias("end"))), lambda e: e["start"] >= 0)
    x = p.select("gold_transcript", M.align_to_reference(F.col("gold_transcript"), F.col("raw_transcript"), spans).alias("a"))
    x = x.select("gold_transcript", F.inline_outer("a")).where("label IS NOT NULL").withColumn("n", F.length("gold_transcript"))
    slice_ = F.col("gold_transcript").substr(F.col("start") + 1, F.col("end") - F.col("start"))
    inside = F.col("end") <= F.col("n")
    return x.agg(F.count("*").alias("spans"), F.count_if(inside & (slice_ != F.col("text"))).alias("wrong_slices"), F.count_if(~inside & ((F.col("start") <= F.col("n")) | (F.col("end") != F.col("start") + 1))).alias("wrong_places"))


@query("SELECT 'a' AS id, 'PER' AS label, 'Oʻquvchi' AS text, 0::BIGINT AS s, 8::BIGINT AS e UNION ALL SELECT 'a', 'DATE', '2026-yil 5-avgust', 9, 26")
def join12_golden(spark: SparkSession, sf: str) -> DataFrame:
    x = spark.createDataFrame([("a", "  O'quvchi   2026 - yil  5 - avgust keldi.", [("PER", 2, 10), ("DATE", 13, 35)])], "id string, t string, es array<struct<label:string,start:int,end:int>>")
    return M.project_spans(x, "t", "es", ["id"]).select("id", "label", "text", F.col("start").cast("bigint").alias("s"), F.col("end").cast("bigint").alias("e"))


@query("SELECT 0::BIGINT AS wrong_slices, count(*) AS spans FROM (SELECT unnest(gold_entities) FROM (SELECT gold_entities FROM stt_predictions))")
def join12_projection(spark: SparkSession, sf: str) -> DataFrame:
    """JOIN12: every gold span moved to the normalized gold transcript cuts its normalized surface out of it."""
    x = table(spark, sf, "stt_predictions").select(F.monotonically_increasing_id().alias("r"), "gold_transcript", "gold_entities")
    p = M.project_spans(x, "gold_transcript", "gold_entities", ["gold_transcript"])
    bad = S.normalize_runtime(F.col("gold_transcript")).substr(F.col("start") + 1, F.col("end") - F.col("start")) != F.col("text")
    return p.agg(F.coalesce(F.count_if(bad), F.lit(0)).alias("wrong_slices"), F.count("*").alias("spans"))


# --- aggregates -------------------------------------------------------------


@query(None)
def agg7_mining_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """AGG7: accepted phrases by form, suffix and year, and all, in one pass of grouping sets."""
    d = table(spark, sf, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("key"), "text")
    m = K.best_per_phrase(K.mined_years(d, "text", "key"))
    return m.groupingSets([["form"], ["suffix"], ["year"], []], "form", "suffix", "year").agg(F.count("*").alias("n"), F.grouping_id().alias("level")).select("form", "suffix", F.col("year").cast("bigint").alias("year"), "n", F.col("level").cast("bigint").alias("level"))


@query(
    f"""
    WITH d AS (SELECT {sql_full_text('text')} AS k, {SQL_NAME_KEY} AS nk, doc_id FROM documents WHERE text IS NOT NULL), c AS (SELECT source, {SQL_NAME_KEY} AS nk, row_number() OVER (ORDER BY source) AS place FROM source_catalog)
    SELECT k AS full_text, arg_min(coalesce(c.source, d.nk, 'unknown'), {{'p': coalesce(place, 1000000), 'd': doc_id}}) AS source, count(*) AS n FROM d LEFT JOIN c USING (nk) GROUP BY k
    """
)
def agg9_first_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """AGG9: equal texts of several sources belong to the first source in list order, however it is spelled; texts of unlisted and null sources come last."""
    from pyspark.sql import Window as W

    c = table(spark, sf, "source_catalog").select(F.col("source").alias("name"), S.name_key(F.col("source")).alias("nk"), F.row_number().over(W.orderBy("source")).alias("place"))
    d = table(spark, sf, "documents").where("text IS NOT NULL").select(S.full_text(F.col("text")).alias("full_text"), S.name_key(F.col("source")).alias("nk"), "doc_id").join(c, "nk", "left")
    d = d.withColumn("source", F.coalesce("name", "nk", F.lit("unknown"))).withColumn("place", F.coalesce("place", F.lit(1_000_000)))
    return d.groupBy("full_text").agg(F.min_by("source", F.struct("place", "doc_id")).alias("source"), F.count("*").alias("n"))


@query("SELECT id, i::BIGINT AS word, g AS label, p AS score FROM (SELECT *, row_number() OVER (PARTITION BY id, i ORDER BY p DESC, c) AS rn FROM (SELECT id, unnest(ner_tags) AS g, generate_subscripts(ner_tags, 1) AS i, 0 AS c, 0.5::DOUBLE AS p FROM " + NER + " UNION ALL SELECT id, 'O', unnest(range(1, len(ner_tags) + 1)), 1, CASE WHEN len(ner_tags) % 2 = 0 THEN 0.5 ELSE 0.75 END::DOUBLE FROM " + NER + ")) WHERE rn = 1")
def agg10_best_labels(spark: SparkSession, sf: str) -> DataFrame:
    """AGG10: the likeliest label per word over overlapping chunks, the first on a tie."""
    x = ner(spark, sf)
    a = x.select("id", F.posexplode("ner_tags").alias("i", "label"), F.lit(0).alias("c"), F.lit(0.5).alias("score"))
    b = x.select("id", F.posexplode(F.transform("ner_tags", lambda t: F.lit("O"))).alias("i", "label"), F.lit(1).alias("c"), F.when(F.size("ner_tags") % 2 == 0, 0.5).otherwise(0.75).alias("score"))
    best = F.min_by(F.struct("label", "score"), F.struct(-F.col("score"), "c"))
    return a.unionByName(b).groupBy("id", "i").agg(best.alias("b")).select("id", (F.col("i") + 1).cast("bigint").alias("word"), "b.label", "b.score")


@query(
    f"""
    WITH t AS (SELECT id, unnest(ner_tags) AS g, unnest([CASE WHEN k % 7 = 0 THEN 'O' ELSE g END FOR g, k IN ner_tags]) AS p, len(ner_tags) AS n FROM {NER})
    SELECT count(*) AS tokens, round(avg(CASE WHEN g = p THEN 1 ELSE 0 END), 9) AS token_accuracy FROM t
    """
)
def agg18_token_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """AGG18: token accuracy of predictions that miss every seventh tag."""
    x = ner(spark, sf).select(F.explode(S.zip2(F.col("ner_tags"), F.transform("ner_tags", lambda g, k: F.when((k + 1) % 7 == 0, "O").otherwise(g)))).alias("t"))
    return x.agg(F.count("*").alias("tokens"), F.round(F.avg((F.col("t.0") == F.col("t.1")).cast("int")), 9).alias("token_accuracy"))


@query(
    f"""
    WITH x AS (SELECT id, ner_tags AS g, list_transform(range(1, len(ner_tags) + 1), lambda k: CASE WHEN k % 7 = 0 THEN 'O' ELSE ner_tags[k] END) AS p FROM {NER}),
    r AS (SELECT id, 'g' AS side, unnest(g) AS t, generate_subscripts(g, 1) AS i FROM x UNION ALL SELECT id, 'p', unnest(p), generate_subscripts(p, 1) FROM x),
    b AS (SELECT *, sum(CASE WHEN t LIKE 'B-%' OR t = 'O' OR t[3:] <> coalesce(pt, 'O')[3:] THEN 1 ELSE 0 END) OVER (PARTITION BY id, side ORDER BY i) AS run FROM (SELECT *, lag(t) OVER (PARTITION BY id, side ORDER BY i) AS pt FROM r)),
    s AS (SELECT id, side, any_value(t[3:]) AS label, min(i) AS f, max(i) AS l FROM b WHERE t <> 'O' GROUP BY id, side, run),
    c AS (SELECT label, count(*) FILTER (WHERE side = 'g') AS g, count(*) FILTER (WHERE side = 'p') AS p FROM s GROUP BY id, label, f, l)
    SELECT label, sum(least(g, p))::BIGINT AS tp, sum(greatest(p - g, 0))::BIGINT AS fp, sum(greatest(g - p, 0))::BIGINT AS fn FROM c GROUP BY label
    """
)
def agg18_type_counts(spark: SparkSession, sf: str) -> DataFrame:
    """AGG18: entity-level counts per type from gaps and islands on both sides."""
    x = ner(spark, sf).select("id", "ner_tags", F.transform("ner_tags", lambda g, k: F.when((k + 1) % 7 == 0, "O").otherwise(g)).alias("p"))
    return M.span_counts(M.tag_spans(x, "ner_tags", ["id"]), M.tag_spans(x, "p", ["id"]), ["label"], ["id", "label", "first", "last"])


@query(f"SELECT split, count(*) AS examples, sum(len(tokens))::BIGINT AS words, sum(len(list_filter(ner_tags, lambda t: t <> 'O')))::BIGINT AS entity_words FROM {NER} GROUP BY split")
def agg25_dataset(spark: SparkSession, sf: str) -> DataFrame:
    return ner(spark, sf).groupBy("split").agg(F.count("*").alias("examples"), F.sum(F.size("tokens")).alias("words"), F.sum(F.size(F.filter("ner_tags", lambda t: t != "O"))).alias("entity_words"))


@query("SELECT model_key, count(*) AS seeds, round(avg(metrics.raw_wer), 9) AS mean, round(stddev_pop(metrics.raw_wer), 9) AS deviation, round(max(metrics.raw_wer) - min(metrics.raw_wer), 9) AS spread FROM " + STT + " WHERE metrics.raw_wer IS NOT NULL GROUP BY model_key")
def agg24_stability(spark: SparkSession, sf: str) -> DataFrame:
    x = stt(spark, sf).select("model_key", F.col("metrics.raw_wer").alias("value")).where("value IS NOT NULL")
    return R.stability(x, ["model_key"])


# --- reports ----------------------------------------------------------------


@query(None)
def err1_agg23_stt_errors(spark: SparkSession, sf: str) -> DataFrame:
    """ERR1 / AGG23: transcripts per error category."""
    x = stt(spark, sf).select("gold_transcript", "raw_transcript", "gold_entities", "conditions")
    return R.category_counts(R.with_stt_errors(x, "gold_transcript", "raw_transcript", "gold_entities", "conditions"), "errors", R.STT_CATEGORIES)


def _surfaces(col: str, score: bool) -> Column:
    s = lambda t: S.squeeze(F.regexp_replace(F.lower(F.translate(t, S.CANONICAL_APOSTROPHES, "ʻ" * 6)), r"\p{P}", " "))
    return F.transform(col, lambda e: F.struct(e["label"].alias("label"), s(e["text"]).alias("surface"), (e["score"] if score else F.lit(None).cast("double")).alias("score")))


@query(None)
def err2_join13_ner_errors(spark: SparkSession, sf: str) -> DataFrame:
    """ERR2 / JOIN13: spoken items per error category of the model's entities."""
    x = table(spark, sf, "speech_ner_eval").select("id", R.ner_errors(_surfaces("entities", False), _surfaces("model_entities", True)).alias("errors"))
    return R.category_counts(x, "errors", R.NER_CATEGORIES)


@query(
    f"""
    WITH x AS (SELECT prediction_id, gold_entities AS es, raw_transcript AS r, normalized_transcript AS n, {sql_runtime('raw_transcript')} AS e, {sql_evaluation('raw_transcript')} AS re, {sql_evaluation('normalized_transcript')} AS ne FROM {STT}),
    c AS (SELECT prediction_id, unnest([CASE WHEN n <> e AND regexp_matches(n, '[''’‘ʼ`]') THEN 'Incorrect apostrophe replacement' END, CASE WHEN n <> e AND regexp_matches(r, '[0-9]') AND contains(n, ' - ') THEN 'Incorrect date punctuation' END,
        CASE WHEN n <> e AND regexp_matches(n, '[0-9]\\s+:\\s+[0-9]') THEN 'Incorrect time punctuation' END, CASE WHEN n <> e AND (contains(n, '  ') OR n <> trim(n)) THEN 'Whitespace corruption' END, CASE WHEN n <> e AND re <> ne THEN 'Meaning changed' END,
        CASE WHEN n IS NOT NULL AND len(list_filter(es, lambda s: s."start" < 0 OR s."end" <= s."start" OR s."end" > length(n) OR n[s."start" + 1:s."end"] <> s.text)) > 0 THEN 'Offset mismatch' END]) AS error FROM x)
    SELECT prediction_id, error FROM c WHERE error IS NOT NULL
    """
)
def err3_normalization_errors(spark: SparkSession, sf: str) -> DataFrame:
    """ERR3: all categories that can occur, the gold spans read as spans of the normalized transcript."""
    x = stt(spark, sf).select("prediction_id", F.explode_outer(R.normalization_errors(F.col("raw_transcript"), F.col("normalized_transcript"), F.col("gold_entities"))).alias("error"))
    return x.where("error IS NOT NULL")


@query(
    f"""
    WITH s AS (SELECT sample_id, any_value(speaker_id) AS speaker_id, any_value(gold_entities) AS es, any_value(conditions) AS c, any_value(audio_duration_seconds) AS d FROM {STT} WHERE model_key = 'stt_orta' GROUP BY sample_id)
    SELECT count(*) AS recordings, count(DISTINCT speaker_id) AS speakers, count(*) FILTER (WHERE NOT d BETWEEN 5 AND 20) AS bad_durations,
        {', '.join(f"sum(len(list_filter(es, lambda e: e.label = '{x}')))::BIGINT AS n_{x}" for x in L.LABELS)} FROM s
    """
)
def agg21_compliance(spark: SparkSession, sf: str) -> DataFrame:
    x = stt(spark, sf).where("model_key = 'stt_orta'").select(F.col("sample_id").alias("id"), "speaker_id", F.col("gold_entities").alias("entities"), "conditions", F.col("audio_duration_seconds").alias("seconds"))
    return R.compliance(x).select("recordings", "speakers", "bad_durations", *(f"n_{x}" for x in L.LABELS))


_FLAGS = list(itertools.product([False, True], repeat=5))


@query(
    "WITH f(recording_id, recorded, audio_present, consent_confirmed, transcript_reviewed, entity_spans_reviewed) AS (VALUES " + ", ".join(f"({i}, {', '.join(str(x).lower() for x in f)})" for i, f in enumerate(_FLAGS)) + """)
    SELECT recording_id::BIGINT AS recording_id, (CASE WHEN recorded <> audio_present THEN 1 ELSE 0 END + CASE WHEN recorded AND NOT consent_confirmed THEN 1 ELSE 0 END + CASE WHEN transcript_reviewed AND NOT recorded THEN 1 ELSE 0 END + CASE WHEN entity_spans_reviewed AND NOT transcript_reviewed THEN 1 ELSE 0 END)::BIGINT AS issues
    FROM f WHERE issues > 0
    """
)
def agg22_audit(spark: SparkSession, sf: str) -> DataFrame:
    """AGG22: every combination of the checklist's flags against its rules."""
    x = spark.createDataFrame([(i, *f) for i, f in enumerate(_FLAGS)], "recording_id bigint, recorded boolean, audio_present boolean, consent_confirmed boolean, transcript_reviewed boolean, entity_spans_reviewed boolean")
    return R.collection_issues(x).groupBy("recording_id").agg(F.count("*").alias("issues"))


@query(
    f"""
    WITH m AS (SELECT model_key AS run, avg(metrics.raw_wer) AS wer, avg(metrics.normalized_cer) AS cer, avg(timing.stt_seconds) AS seconds FROM {STT} GROUP BY 1)
    SELECT run, row_number() OVER (ORDER BY wer NULLS LAST, cer NULLS LAST, seconds NULLS LAST, run) AS place FROM m
    """
)
def top6_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """TOP6: models by mean word error, character error and time, ties by name."""
    m = stt(spark, sf).groupBy(F.col("model_key").alias("run")).agg(F.avg("metrics.raw_wer").alias("wer"), F.avg("metrics.normalized_cer").alias("cer"), F.avg("timing.stt_seconds").alias("seconds"))
    return R.ranked_runs(m, "run", [("wer", False), ("cer", False), ("seconds", False)]).select("run", F.col("place").cast("bigint").alias("place"))


@query(
    f"""
    WITH m AS (SELECT model_key AS run, device AS split, 'raw_wer' AS metric, round(avg(metrics.raw_wer), 9) AS v FROM {STT} GROUP BY 1, 2 UNION ALL SELECT model_key, device, 'seconds', round(avg(timing.stt_seconds), 9) FROM {STT} GROUP BY 1, 2)
    SELECT a.metric, a.split, a.v AS base_value, b.v AS other_value, round(b.v - a.v, 9) AS delta, CASE WHEN b.v - a.v > 0 THEN 'improvement' WHEN b.v - a.v < 0 THEN 'regression' ELSE 'same' END AS change FROM m a JOIN m b USING (metric, split) WHERE a.run = 'stt_kichik' AND b.run = 'stt_orta' AND a.v IS NOT NULL AND b.v IS NOT NULL AND abs(a.v - b.v) > 1e-6
    """
)
def join14_err6_deltas(spark: SparkSession, sf: str) -> DataFrame:
    x = stt(spark, sf)
    long = [x.groupBy(F.col("model_key").alias("run"), F.col("device").alias("split")).agg(F.round(F.avg(c), 9).alias("value")).withColumn("metric", F.lit(n)) for n, c in (("raw_wer", "metrics.raw_wer"), ("seconds", "timing.stt_seconds"))]
    d = R.metric_deltas(long[0].unionByName(long[1]), "stt_kichik", "stt_orta")
    return d.where("base_value IS NOT NULL AND other_value IS NOT NULL AND abs(delta) > 1e-6").select("metric", "split", "base_value", "other_value", "delta", "change")


@query(
    f"""
    WITH a AS (SELECT DISTINCT unnest(tokens) AS t FROM {NER} WHERE split = 'train'), b AS (SELECT DISTINCT unnest(tokens) AS t FROM {NER} WHERE split = 'test')
    SELECT (SELECT count(*) FROM (FROM a INTERSECT FROM b)) AS both, (SELECT count(*) FROM (FROM a EXCEPT FROM b)) AS train_only, (SELECT count(*) FROM (FROM b EXCEPT FROM a)) AS test_only
    """
)
def set2_vocabularies(spark: SparkSession, sf: str) -> DataFrame:
    """SET2: words in both vocabularies or in one alone, in one aggregation instead of three set operations."""
    t = ner(spark, sf).where("split IN ('train', 'test')").select("split", F.explode("tokens").alias("t"))
    w = t.groupBy("t").agg(F.bool_or(F.col("split") == "train").alias("a"), F.bool_or(F.col("split") == "test").alias("b"))
    return w.agg(F.count_if(F.col("a") & F.col("b")).alias("both"), F.count_if(F.col("a") & ~F.col("b")).alias("train_only"), F.count_if(~F.col("a") & F.col("b")).alias("test_only"))


# --- sources, sinks, pipelines ----------------------------------------------


@query(f"SELECT id, array_to_string(tokens, ' ') AS text, split FROM {NER} WHERE id IN (SELECT id FROM ({sql_of('val1_reasons')}) WHERE reason IS NULL)")
def src3_snk6_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """SRC2, SRC3, SRC17, SNK1, SNK6: records written as JSON lines per split, read back with the fixed schema and validated."""
    x = ner(spark, sf).where(B.bio_reason(F.col("tokens"), F.col("ner_tags")).isNull())
    path = f"{checkpoint_dir(spark).rstrip('/')}/records-{uuid.uuid4().hex}"
    io.write_splits(x, path)
    parts = [io.read_records(spark, f"{path}/split={s}").withColumn("split", F.lit(s)) for s in ("train", "validation", "test")]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("id", F.array_join("tokens", " ").alias("text"), "split")


@query("SELECT line_id FROM raw_lines WHERE json_valid(payload) AND json_type(payload, '$.tokens') = 'ARRAY'")
def src5_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """SRC5: lines that parse as records; broken ones are told apart, not dropped by chance."""
    r = F.from_json("payload", "tokens array<string>, source string, _broken string", {"columnNameOfCorruptRecord": "_broken", "allowSingleQuotes": "false"})
    return table(spark, sf, "raw_lines").select("line_id", r.alias("r")).where("r._broken IS NULL AND r.tokens IS NOT NULL").select("line_id")


@query(f"SELECT list_name, word AS key, count(*) AS n FROM (SELECT 'months' AS list_name, unnest({sql_list(L.MONTHS)}) AS word UNION ALL SELECT 'heads', unnest({sql_list(L.folded(L.ORGANIZATION_HEADS))})) GROUP BY 1, 2")
def src8_lexicon(spark: SparkSession, sf: str) -> DataFrame:
    return io.lexicon_table(spark, {"months": L.MONTHS, "heads": L.folded(L.ORGANIZATION_HEADS)}).groupBy("list_name", "key").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS texts, sum(length(text))::BIGINT AS chars FROM documents WHERE text IS NOT NULL")
def src13_text_column(spark: SparkSession, sf: str) -> DataFrame:
    return io.read_text_column(spark, f"{sf}/documents.parquet", "text").agg(F.count("*").alias("texts"), F.sum(F.length("text")).alias("chars"))


@query(f"SELECT id, list_sort([e.label FOR e IN entities]) = ['DATE', 'LOC', 'ORG', 'PER'] AS complete, len(regexp_extract_all(text, '\\S+')) BETWEEN 12 AND 38 AS length_ok FROM prompts")
def src19_prompts(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "prompts")
    return p.select("id", (F.array_sort(F.transform("entities", lambda e: e["label"])) == F.array(*map(F.lit, ["DATE", "LOC", "ORG", "PER"]))).alias("complete"), F.size(F.regexp_extract_all("text", F.lit(r"(\S+)"))).between(12, 38).alias("length_ok"))


@query("SELECT speaker_id, len(conditions)::BIGINT AS conditions FROM speakers WHERE len(conditions) = len(list_distinct(conditions))")
def src20_speakers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "speakers").where(F.size("conditions") == F.size(F.array_distinct("conditions"))).select("speaker_id", F.size("conditions").cast("bigint").alias("conditions"))


_SOURCE = [("1", "1", "Akmal", "B-PER"), ("1", "2", "keldi", "O"), ("2", "1", "x", "O"), ("2", "1", "y", "O"), ("3", "2", "b", "I-PER"), ("3", "1", "a", "O"), ("x", "1", "a", "O"), ("4", "1", "q", "ALIEN"), ("4", "2", "r", "O"), ("5", "2", "ketdi", "O"), ("5", "1", "Ali", "B-PER")]


@query("SELECT * FROM (VALUES ('sentence-000001', 'Akmal keldi', NULL), ('sentence-000002', 'x y', 'duplicate_order'), ('sentence-000003', 'a b', 'bio_orphan'), ('sentence-000004', 'q r', 'unknown_tag'), ('sentence-000005', 'Ali ketdi', NULL)) v(id, text, reason)")
def agg1_agg2_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """AGG1, AGG2, NUM7, DRV1: golden source rows grouped to sentences, bad ones rejected whole with a reason."""
    x = spark.createDataFrame(_SOURCE, "Sentence string, TokenOrder string, Token string, NER_Tag string")
    return K.grouped_sentences(K.source_row_reasons(x)).select("id", F.array_join("tokens", " ").alias("text"), "reason")


def _train(spark: SparkSession, sf: str) -> DataFrame:
    return ner(spark, sf).where((F.col("split") == "train") & B.bio_reason(F.col("tokens"), F.col("ner_tags")).isNull())


@query(
    f"""
    WITH t AS (SELECT id FROM {NER} WHERE split = 'train' AND id IN (SELECT id FROM ({sql_of('val1_reasons')}) WHERE reason IS NULL))
    SELECT count(*) AS originals, round_even(count(*) * 3 / 7, 0)::BIGINT AS variants, 0::BIGINT AS too_many_or_none, 0::BIGINT AS unchanged, 0::BIGINT AS wrong_ids FROM t
    """
)
def drv2_top5_augmented(spark: SparkSession, sf: str) -> DataFrame:
    """DRV2, TOP5, AGG26: the train records and safe variants of three sevenths of them, each with one to three transforms."""
    x = PL.augmented(_train(spark, sf), 42)[0]
    own = x.where("source_id IS NULL").select(F.col("id").alias("source_id"), F.col("tokens").alias("t0"), F.col("ner_tags").alias("g0"))
    v = x.where("source_id IS NOT NULL").join(own, "source_id", "left")
    checks = v.agg(
        F.count("*").alias("variants"), F.count_if(~F.size("transformations").between(1, 3)).alias("too_many_or_none"), F.count_if((F.col("tokens") == F.col("t0")) & (F.col("ner_tags") == F.col("g0"))).alias("unchanged"),
        F.count_if(~F.coalesce(F.col("id").rlike(r"__aug_\d{4,}(_\d+)?$") & F.startswith("id", "source_id"), F.lit(False))).alias("wrong_ids"),
    )
    return x.where("source_id IS NULL").agg(F.count("*").alias("originals")).join(checks)


@query(None)
def drv7_set1_mix(spark: SparkSession, sf: str) -> DataFrame:
    """DRV7, SET1, AGG26: the training mix's rows per part. The base is cleared of protected texts first, since the mix refuses it otherwise."""
    x = shared_table(ner(spark, sf).where(B.bio_reason(F.col("tokens"), F.col("ner_tags")).isNull()).select("id", "tokens", "ner_tags", "source", "split"), "records")
    kind = F.xxhash64("id") % 3
    train = x.where("split = 'train'")
    test = x.where("split = 'test'")
    held = test.select(S.fingerprint(F.array_join("tokens", " ")).alias("fp"))
    base = train.where(kind == 0).withColumn("fp", S.fingerprint(F.array_join("tokens", " "))).where(~F.col("fp").isin(*PL.DENIED)).join(held, "fp", "left_anti").drop("fp")
    m = PL.training_mix(base, train.where(kind == 1), train.where(kind == -1), train.where((kind != 0) & (F.abs(kind) != 1)), test, 42, {"expert": 2000, "temporal": 1000, "speech": 1000}, {"LOC": 2, "ORG": 2}, 0.1)
    return m["train"].unionByName(m["dev"]).groupBy("part").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


@query("SELECT 0::BIGINT AS missing_labels, 17::BIGINT AS labels")
def drv9_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """DRV9: observed tags against the fixed vocabulary."""
    seen = ner(spark, sf).select(F.explode("ner_tags").alias("t")).distinct()
    known = spark.createDataFrame(list(enumerate(L.BIO_LABELS)), "i int, t string")
    j = seen.join(known, "t", "full_outer")
    return j.agg(F.count_if(F.col("i").isNull()).alias("missing_labels"), F.count("i").alias("labels"))


@query(None)
def api2_transcripts(spark: SparkSession, sf: str) -> DataFrame:
    """API2 / UDF3: all transcripts through normalization, view, rules and resolution."""
    x = stt(spark, sf).where("raw_transcript IS NOT NULL").select("prediction_id", "raw_transcript").withColumn("m", F.array().cast(PL.ENTITY))
    return PL.analyze_transcripts(x, "raw_transcript", "m").select("prediction_id", F.inline_outer("entities")).where("label IS NOT NULL").select("prediction_id", "label", "start", "end", "text", "source")


@query("SELECT id, e.label AS label, e.text AS text FROM (SELECT id, unnest(model_entities) AS e FROM speech_ner_eval)")
def udf1_plugged_model(spark: SparkSession, sf: str) -> DataFrame:
    """UDF1: a plugged-in model; here one that looks its answers up, sent along as a parameter (the fixed evaluation set, counted first)."""
    items = table(spark, sf, "speech_ner_eval").select("text", "model_entities")
    if items.count() > 10_000:
        raise ValueError("this stand-in model sends its answers along: at most 10,000")
    known = {r["text"]: [e.asDict() for e in r["model_entities"]] for r in items.collect()}

    def make() -> PL.Predict:
        return lambda texts: [known.get(t, []) for t in texts]

    x = PL.with_predictions(table(spark, sf, "speech_ner_eval").select("id", "text"), "text", make)
    return x.select("id", F.inline(F.transform("model_entities", lambda e: F.struct(e["label"].alias("label"), e["text"].alias("text")))))


@query("SELECT sample_id, (count(*) > 0) AS seen FROM stt_predictions GROUP BY 1")
def snk3_csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """SNK3, SNK7, SRC21: sample ids as CSV in key order and back."""
    x = table(spark, sf, "stt_predictions").select("sample_id").distinct().withColumn("seen", F.lit(True))
    path = f"{checkpoint_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    io.write_csv(x, path, ["sample_id", "seen"], "sample_id")
    return spark.read.schema("sample_id string, seen boolean").option("header", True).csv(path)



# --- templates and audio ----------------------------------------------------


@query(
    f"""
    SELECT template, n::BIGINT AS n FROM (VALUES ('per_intro_or_relation', 60), ('per_one_edit_intro', {len(L.PERSON_NAMES)}), ('spoken_calendar', 60), ('relative_calendar', 6), ('spoken_year', 165), ('per_train_inventory', 64),
        ('entity_boundary_curriculum', 288), ('entity_head_hard_negative', 6), ('eponymic_loc_per_contrast', 120), ('hard_negative', 65)) v(template, n)
    """
)
def arr20_templates(spark: SparkSession, sf: str) -> DataFrame:
    """ARR20: authored sentences per kind; all are strict BIO."""
    t = TP.authored_templates(spark, ner(spark, sf).where("size(tokens) = size(ner_tags)"))
    return t.where(B.bio_reason(F.col("tokens"), F.col("ner_tags")).isNull()).groupBy("template").agg(F.count("*").alias("n"))


@query("SELECT id::BIGINT AS id, ends FROM (VALUES (1, '3000'), (2, '2000,4000,6000,10000')) v(id, ends)")
def agg27_quiet_cuts(spark: SparkSession, sf: str) -> DataFrame:
    """AGG27: a short recording stays whole; in a long one each cut falls into the first pause of the second half of a chunk."""
    wave = lambda n: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when((i % 1000 < 200) | (i % 1000 >= 800), 0.0).otherwise(F.sin(i * 0.7)))
    x = spark.range(1, 3).select("id", F.when(F.col("id") == 1, wave(3000)).otherwise(wave(10000)).alias("s"))
    x = x.select("id", U.quiet_cuts(F.col("s"), F.lit(1000), F.when(F.col("id") == 1, F.lit(5.0)).otherwise(F.lit(4.0))).alias("c"))
    return x.select("id", F.array_join(F.transform("c", lambda v: (F.round(v / 1000) * 1000).cast("int")), ",").alias("ends"))


@query("SELECT * FROM (VALUES (1, '0.5,-0.25', '1.0,-0.5')) v(id, mixed, scaled)")
def aud2_samples(spark: SparkSession, sf: str) -> DataFrame:
    """AUD2: two channels mixed down, and a recording above full scale."""
    x = spark.createDataFrame([(1, [[1.0, 0.0], [-0.5, 0.0]], [2.0, -1.0])], "id int, c array<array<double>>, s array<double>")
    return x.select("id", F.array_join(U.mono(F.col("c")), ",").alias("mixed"), F.array_join(U.peak_scaled(F.col("s")), ",").alias("scaled"))


# --- subword labels, re-aggregation, held-out phrases ------------------------

_IDS = "{" + ", ".join(f"{q(n)}: {i}" for i, n in enumerate(L.BIO_LABELS)) + "}"


def _word_ids(tokens: Column) -> Column:
    """Stand-in subwords of at most four characters, with a special one at either end."""
    own = F.flatten(F.transform(tokens, lambda t, i: F.array_repeat(i, F.greatest(F.lit(1), F.ceil(F.length(t) / 4)).cast("int"))))
    return F.concat(F.array(F.lit(None).cast("int")), own, F.array(F.lit(None).cast("int")))


@query(
    f"""
    SELECT id, sum(greatest(1, ceil(length(t) / 4)))::BIGINT + 2 AS subwords, count(*) AS labelled, sum(list_position({sql_list(L.BIO_LABELS)}, g) - 1)::BIGINT AS label_sum
    FROM (SELECT id, unnest(tokens) AS t, unnest(ner_tags) AS g FROM {NER} WHERE len(tokens) = len(ner_tags)) GROUP BY id
    """
)
def arr17_labels(spark: SparkSession, sf: str) -> DataFrame:
    """ARR17, ARR19: subword label ids; the first subword of a word is labelled, all others are -100."""
    x = ner(spark, sf).where("size(tokens) = size(ner_tags)").withColumn("w", _word_ids(F.col("tokens"))).withColumn("l", B.align_labels(F.col("w"), F.col("ner_tags")))
    real = F.filter("l", lambda v: v >= 0)
    return x.select("id", F.size("w").cast("bigint").alias("subwords"), F.size(real).cast("bigint").alias("labelled"), F.aggregate(real, F.lit(0), lambda a, v: a + v).cast("bigint").alias("label_sum"))


@query(
    f"""
    WITH t AS (SELECT id, g, 1 + coalesce(sum(n) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
        FROM (SELECT id, g, i, greatest(1, ceil(length(t) / 4)) AS n FROM (SELECT id, unnest(tokens) AS t, unnest(ner_tags) AS g, generate_subscripts(tokens, 1) AS i FROM {NER} WHERE len(tokens) = len(ner_tags))))
    SELECT count(DISTINCT id) FILTER (WHERE pos >= 48) AS truncated, count(*) FILTER (WHERE pos >= 48) AS lost_words, count(*) FILTER (WHERE pos >= 48 AND g <> 'O') AS lost_entity_words FROM t
    """
)
def arr18_truncation(spark: SparkSession, sf: str) -> DataFrame:
    """ARR18: records cut after 48 subwords, and the words and entity words that lose their label."""
    x = ner(spark, sf).where("size(tokens) = size(ner_tags)").select("ner_tags", _word_ids(F.col("tokens")).alias("w"))
    kept = F.size(F.array_distinct(F.filter(F.slice("w", 1, 48), lambda i: i.isNotNull())))
    x = x.select(F.slice("ner_tags", kept + 1, F.greatest(F.size("ner_tags") - kept, F.lit(0))).alias("lost"))
    return x.agg(F.count_if(F.size("lost") > 0).alias("truncated"), F.sum(F.size("lost")).alias("lost_words"), F.sum(F.size(F.filter("lost", lambda t: t != "O"))).alias("lost_entity_words"))


@query(
    """
    WITH g AS (SELECT id, e.label AS label, e."start" AS s, e."end" AS t FROM (SELECT id, unnest(entities) AS e FROM speech_ner_eval)), p AS (SELECT id, e.label AS label, e."start" AS s, e."end" AS t FROM (SELECT id, unnest(model_entities) AS e FROM speech_ner_eval)),
    c AS (SELECT coalesce(a.label, b.label) AS label, coalesce(a.n, 0) AS g, coalesce(b.n, 0) AS p FROM (SELECT id, label, s, t, count(*) AS n FROM g GROUP BY ALL) a FULL JOIN (SELECT id, label, s, t, count(*) AS n FROM p GROUP BY ALL) b ON a.id = b.id AND a.label = b.label AND a.s = b.s AND a.t = b.t)
    SELECT label, sum(least(g, p))::BIGINT AS tp, sum(greatest(p - g, 0))::BIGINT AS fp, sum(greatest(g - p, 0))::BIGINT AS fn FROM c GROUP BY label
    """
)
def agg12_reaggregated(spark: SparkSession, sf: str) -> DataFrame:
    """AGG12: counts per text and label, summed over texts; no mean of per-text scores."""
    from tilmoch.plans.queries import _gold_pred

    gold, pred = _gold_pred(spark, sf)
    per = M.span_counts(gold, pred, ["id", "label"], ["id", "label", "start", "end"])
    return per.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


@query("SELECT 236::BIGINT AS records, 236::BIGINT AS exact, 0::BIGINT AS partial")
def agg19_year_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """AGG19 / DRV8: held-out year phrases that the rules find as one DATE over the whole text, and in part."""
    from tilmoch.functions import numbers as N

    x = spark.range(1800, 2036).select(F.concat(F.array_join(N.year_words(F.col("id")), " "), F.lit(" yilda")).alias("t")).withColumn("m", F.array().cast(PL.ENTITY))
    x = P.extract(x, "t", "m").select("t", "entities")
    date = F.filter("entities", lambda e: e["label"] == "DATE")
    x = x.select(F.size(date).alias("n"), F.exists(date, lambda e: (e["start"] == 0) & (e["end"] == F.length("t"))).alias("whole"))
    return x.agg(F.count("*").alias("records"), F.count_if("whole").alias("exact"), F.count_if(~F.col("whole") & (F.col("n") > 0)).alias("partial"))


@query(None)
def agg17_ablation_summary(spark: SparkSession, sf: str) -> DataFrame:
    """AGG17: surface scores of the rules alone on each model's transcripts, one row per model with the labels' F1 as columns."""
    x = stt(spark, sf).select("prediction_id", "model_key", F.coalesce("raw_transcript", F.lit("")).alias("t"), "gold_entities").withColumn("m", F.array().cast(PL.ENTITY)).withColumn("n", S.normalize_runtime(F.col("t")))
    found = P.extract(x, "n", "m").select("prediction_id", "model_key", F.inline_outer("entities")).where("label IS NOT NULL")
    key = ["model_key", "label"]
    pred = found.select("prediction_id", *key, S.normalize_evaluation(F.col("text")).alias("surface"))
    gold = x.select("prediction_id", "model_key", F.explode("gold_entities").alias("e")).select("prediction_id", "model_key", "e.label", S.normalize_evaluation(F.col("e.text")).alias("surface"))
    c = M.span_counts(gold, pred, key, ["prediction_id", *key, "surface"])
    c = c.select(*key, "tp", "fp", "fn", *M.f1_columns(F.col("tp"), F.col("fp"), F.col("fn")))
    return c.groupBy("model_key").pivot("label", L.LABELS).agg(F.first("f1")).na.fill(0.0)


@query(None)
def err4_records(spark: SparkSession, sf: str) -> DataFrame:
    """ERR4, ERR5: one row per transcript of the primary model with its error categories."""
    x = stt(spark, sf).where("model_key = 'stt_orta'").select("prediction_id", "gold_transcript", "raw_transcript", "gold_entities", "conditions")
    x = R.with_stt_errors(x, "gold_transcript", "raw_transcript", "gold_entities", "conditions")
    return x.select("prediction_id", F.array_join("errors", "; ").alias("errors"))


@query(f"SELECT phrase, min(id) AS first_id FROM (SELECT id, lower(array_to_string(tokens[1:2], ' ')) AS phrase FROM {NER} WHERE ner_tags[1] = 'B-PER' AND ner_tags[2] = 'I-PER' AND len(tokens) = len(ner_tags)) GROUP BY phrase ORDER BY first_id, phrase LIMIT 64")
def top7_first_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """TOP7: the first 64 opening names by record id, a limit that is the feature."""
    x = ner(spark, sf).where((F.get("ner_tags", F.lit(0)) == "B-PER") & (F.get("ner_tags", F.lit(1)) == "I-PER") & (F.size("tokens") == F.size("ner_tags")))
    return x.select("id", F.lower(F.array_join(F.slice("tokens", 1, 2), " ")).alias("phrase")).groupBy("phrase").agg(F.min("id").alias("first_id")).orderBy("first_id", "phrase").limit(64)
