"""Queries of the composed pipelines, strict readers and reports, most on golden rows."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilmoch.functions import bio as B
from tilmoch.operators import corpus as K
from tilmoch.operators import reports as R
from tilmoch.operators import spans as P
from tilmoch.plans import pipeline as PL
from tilmoch.plans.queries import NER, ner, q, query, sql_full_text, sql_of, table
from tilmoch.session import checkpoint_dir
from tilmoch.sources import evaluation as E
from tilmoch.sources import io


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _values(rows: list[tuple], names: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(q(x) if isinstance(x, str) else "NULL" if x is None else str(x) for x in r) + ")" for r in rows) + f") v({names})"


# --- transforms on golden rows ------------------------------------------------

_SPACED = [
    (1, "5-may kuni", "B-TEMPORAL I-TEMPORAL", "5 may kuni", "B-TEMPORAL I-TEMPORAL I-TEMPORAL", "hyphen_spacing"), (2, "soat 18:30 da", "O B-TEMPORAL O", "soat 18 : 30 da", "O B-TEMPORAL I-TEMPORAL I-TEMPORAL O", "colon_spacing"),
    (3, "Abu-Dabi - shahar", "B-LOC O O", "Abu-Dabi shahar", "B-LOC O", "hyphen_spacing"), (4, "12-13:45 keldi", "B-TEMPORAL O", "12 13 : 45 keldi", "B-TEMPORAL I-TEMPORAL I-TEMPORAL I-TEMPORAL O", "hyphen_spacing colon_spacing"),
    (5, "oddiy gap", "O O", "oddiy gap", "O O", ""), (6, "a:b 3: :4", "O O O", "a:b 3: :4", "O O O", ""),
]


@query(_values([(i, t, g, a) for i, _, _, t, g, a in _SPACED], "id, spaced, tags, applied"))
def arr6_arr7_arr8_golden(spark: SparkSession, sf: str) -> DataFrame:
    """ARR6 to ARR8: hyphens in tokens with a digit, a lone O hyphen, clocks, both at once, and what stays."""
    x = spark.createDataFrame([(i, t.split(), g.split()) for i, t, g, *_ in _SPACED], "id int, t array<string>, g array<string>")
    x = x.select("id", B.apply_transforms(F.col("t"), F.col("g"), ["hyphen_spacing", "colon_spacing"]).alias("r"))
    return x.select("id", F.array_join("r.tokens", " ").alias("spaced"), F.array_join("r.tags", " ").alias("tags"), F.array_join("r.applied", " ").alias("applied"))


_APPLY = [
    (1, "Ali keldi .", "B-PER O O", "lowercase remove_punctuation reduce_capitalization"), (2, "o'zbek", "O", "apostrophe_representation"), (3, "18:30", "B-TEMPORAL", "colon_spacing"),
    (4, "5-may", "B-TEMPORAL", "hyphen_spacing"), (5, "gap", "O", ""), (6, "Gap ketdi", "O O", "lowercase"), (7, ". !", "O O", ""),
]


@query(_values([(i, a) for i, _, _, a in _APPLY], "id, applicable"))
def arr9_golden(spark: SparkSession, sf: str) -> DataFrame:
    """ARR9: which transforms would change a record."""
    x = spark.createDataFrame([(i, t.split(), g.split()) for i, t, g, _ in _APPLY], "id int, t array<string>, g array<string>")
    return x.select("id", F.array_join(B.applicable(F.col("t"), F.col("g")), " ").alias("applicable"))


_SPOKEN = [
    (1, "5-may kuni", "B-TEMPORAL O", "beshinchi may kuni", "B-TEMPORAL I-TEMPORAL O"), (2, "20 avgust keldi", "B-TEMPORAL I-TEMPORAL O", "yigirmanchi avgust keldi", "B-TEMPORAL I-TEMPORAL O"),
    (3, "2025-yil", "B-TEMPORAL", "ikki ming yigirma besh yil", "B-TEMPORAL I-TEMPORAL I-TEMPORAL I-TEMPORAL I-TEMPORAL"), (4, "2007 yilda", "B-TEMPORAL I-TEMPORAL", "ikki ming yetti yil", "B-TEMPORAL I-TEMPORAL I-TEMPORAL I-TEMPORAL"),
    (5, "1998-yil", "B-TEMPORAL", "yil", "B-TEMPORAL"), (6, "5-may", "O", "5-may", "O"), (7, "Oʻn 32-may", "O B-TEMPORAL", "oʻn 32-may", "O B-TEMPORAL"),
]


@query(_values([(i, t, g) for i, _, _, t, g in _SPOKEN], "id, spoken, tags"))
def arr10_golden(spark: SparkSession, sf: str) -> DataFrame:
    """ARR10: day and month in one or two tokens, years inside and outside 2000 to 2030, and digits that are no TEMPORAL."""
    x = spark.createDataFrame([(i, t.split(), g.split()) for i, t, g, *_ in _SPOKEN], "id int, t array<string>, g array<string>")
    x = B.with_spoken_temporal(x, "t", "g", "a", "b")
    return x.select("id", F.array_join("a", " ").alias("spoken"), F.array_join("b", " ").alias("tags"))


@query(f"SELECT count(*) AS variants, 0::BIGINT AS lengths, 0::BIGINT AS orphans, 0::BIGINT AS fillers FROM {NER} WHERE id IN (SELECT id FROM ({sql_of('val1_reasons')}) WHERE reason IS NULL) AND len(list_filter(ner_tags, lambda t: t[3:] IN ('PER', 'LOC', 'ORG', 'TEMPORAL'))) > 0")
def arr11_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """ARR11: variants have as many tags as tokens, strict BIO, and at most one filler more than before."""
    x = ner(spark, sf).where(B.bio_reason(F.col("tokens"), F.col("ner_tags")).isNull() & B.viable(F.col("ner_tags")))
    v = B.with_speech_variant(x.select("id", "tokens", "ner_tags"), 42)
    fillers = lambda c: F.size(F.filter(c, lambda t: F.lower(t).isin(*B.SPEECH_FILLERS)))
    return v.agg(
        F.count("*").alias("variants"), F.count_if(F.size("spoken_tokens") != F.size("spoken_tags")).alias("lengths"), F.count_if(F.coalesce(B.bio_reason(F.col("spoken_tokens"), F.col("spoken_tags")).isin("orphan", "label"), F.lit(False))).alias("orphans"),
        F.count_if(~(fillers("spoken_tokens") - fillers("tokens")).between(0, 1)).alias("fillers"),
    )


# --- spans, errors, mined years on golden rows --------------------------------


_SPANS = [
    (1, "mening ismim Akmal", None, "PER", 13, 18), (2, "ertaga Buxoro shahriga boramiz", ("Buxoro", "LOC", 7, 13, 0.9), "DATE", 0, 6), (2, "ertaga Buxoro shahriga boramiz", ("Buxoro", "LOC", 7, 13, 0.9), "LOC", 7, 22),
    (3, "Samarqand davlat universitetida oqiydi", ("Samarqand", "LOC", 0, 9, 0.9), "ORG", 0, 31), (4, "ikki ming yigirma beshinchi yil keldi", None, "DATE", 0, 31), (5, "hech narsa yoq", None, None, None, None), (6, "Chust ketdi", ("Chust", "LOC", 0, 5, 0.9), "LOC", 0, 5),
]


@query(_values([(i, label, s, e) for i, _, _, label, s, e in _SPANS if label], "id, label, s, e"))
def spn8_spn12_golden(spark: SparkSession, sf: str) -> DataFrame:
    """SPN2, SPN6, SPN8, SPN9, SPN12: rules and model entities on spoken texts; a head after a model's place completes and retypes it."""
    x = {i: (i, t, [m] if m else []) for i, t, m, *_ in _SPANS}
    x = spark.createDataFrame(list(x.values()), f"id int, t string, m {PL.ENTITY}")
    x = P.extract(x, "t", "m").select("id", F.inline_outer("entities")).where("label IS NOT NULL")
    return x.select("id", "label", F.col("start").alias("s"), F.col("end").alias("e"))


_NER_ERRORS = [
    (1, [("PER", "ali", None)], [("PER", "ali", 0.9)], ""), (2, [("PER", "ali", None)], [("PER", "ali", 0.5)], "Low-confidence correct prediction"), (3, [("PER", "ali", None)], [("LOC", "ali", 0.9)], "Person classified as location"),
    (4, [("LOC", "chust shahri", None)], [("LOC", "chust", 0.9)], "Incomplete entity"), (5, [("LOC", "chust", None)], [("LOC", "chust shahri", 0.9)], "Excessive entity span"),
    (6, [("DATE", "5 may", None)], [], "Missed date; Date classified as number only"), (7, [], [("DATE", "2025", 0.9)], "Number incorrectly classified as date; False positive"), (8, [("PER", "ali", None)], [("DATE", "ali", 0.9)], "Missed person"),
    (9, [("ORG", "bank", None), ("ORG", "bank", None)], [("ORG", "bank", 0.9)], "Missed organization"), (10, [("LOC", "a", None), ("LOC", "a b", None)], [("LOC", "a b", 0.9)], "Missed location; Excessive entity span"),
]


@query(_values([(i, e) for i, _, _, e in _NER_ERRORS], "id, errors"))
def err2_join13_golden(spark: SparkSession, sf: str) -> DataFrame:
    """ERR2, JOIN13: every rule of the matching, a repeated entity, and a first entity that takes the prediction of a later one."""
    kind = "array<struct<label:string,surface:string,score:double>>"
    x = spark.createDataFrame([(i, g, p) for i, g, p, _ in _NER_ERRORS], f"id int, g {kind}, p {kind}")
    return x.select("id", F.array_join(R.ner_errors(F.col("g"), F.col("p")), "; ").alias("errors"))


_STT_ERRORS = [
    (1, "Ali keldi", "ali keldi.", [("Ali", "PER")], [], ""), (2, "Ali keldi", "Vali keldi", [("Ali", "PER")], ["background_noise"], "Person mistranscribed; Noise-related error"), (3, "Ali tez keldi", "Ali keldi", [("Ali", "PER")], [], "Word omitted"),
    (4, "Ali keldi", "Ali keldi keldi", [("Ali", "PER")], [], "Word inserted; Repetition"), (5, "oʻzbek tili", "ozbek tili", [], [], "Apostrophe error"), (6, "soat 18:30 da", "soat 18:40 da", [("18:30", "DATE")], [], "Time mistranscribed; Numeric-format error"),
    (7, "bugun yomgʻir", None, [], ["uzbek_russian_code_switching"], "Word omitted; Code-switching error"),
]


@query(_values([(i, e) for i, *_, e in _STT_ERRORS], "id, errors"))
def err1_golden(spark: SparkSession, sf: str) -> DataFrame:
    """ERR1: one transcript per category, an equal one, and a null one."""
    x = spark.createDataFrame([(i, g, r, es, c) for i, g, r, es, c, _ in _STT_ERRORS], "id int, g string, r string, es array<struct<text:string,label:string>>, c array<string>")
    return R.with_stt_errors(x, "g", "r", "es", "c").select("id", F.array_join("errors", "; ").alias("errors"))


_MINED = [
    ("a", "men ikki ming besh yilda keldim"), ("b", "2005 yilda tugʻilgan"), ("c", "bir ming toʻqqiz yuz toʻqson sakkiz yili va 1998 yili"), ("d", "besh yil davomida"), ("e", "2050 yil"), ("f", None), ("g", "ikki ming va besh yil"), ("h", "2001 yil keyin"),
]


@query(_values([
    ("accepted", "all", 3), ("connector", "va", 1), ("suffix", "yilda", 1), ("suffix", "yili", 1), ("suffix", "yil", 1), ("transformation", "observed_spoken", 3), ("year", "2005", 2), ("year", "1998", 1),
], "what, value, n"))
def agg7_drv5_golden(spark: SparkSession, sf: str) -> DataFrame:
    """SPN21, SPN22, AGG7, AGG8, DRV5, DRV6: years mined from two shards, merged and counted; spoken forms stand before those made from digits."""
    x = spark.createDataFrame(_MINED, "key string, text string")
    shards = [PL.year_records(K.best_per_phrase(K.mined_years(x.where(c), "text", "key")), "d", "r") for c in ("key < 'c'", "key >= 'c'")]
    return PL.year_statistics(PL.merged_years(shards[0].unionByName(shards[1]), "d", "r"))


@query("SELECT 0::BIGINT AS lost, 0::BIGINT AS wrong_years")
def drv6_merged_years(spark: SparkSession, sf: str) -> DataFrame:
    """DRV5, DRV6: the year records of all documents, in two shards by a hash, merge to those of the whole."""
    d = table(spark, sf, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("key"), "text")
    mined = K.mined_years(d, "text", "key")
    half = F.pmod(F.xxhash64("key"), F.lit(2))
    shards = [PL.year_records(K.best_per_phrase(mined.where(half == i)), "d", "r") for i in (0, 1)]
    merged = PL.merged_years(shards[0].unionByName(shards[1]), "d", "r").select("phrase_key", "year", "form")
    whole = K.best_per_phrase(mined).select("phrase_key", F.col("year").alias("y"), F.col("form").alias("f"))
    j = merged.join(whole, "phrase_key", "full_outer")
    return j.agg(F.count_if(F.col("year").isNull() | F.col("y").isNull() | (F.col("form") != F.col("f"))).alias("lost"), F.count_if(F.col("year") != F.col("y")).alias("wrong_years"))


# --- imports and augmentation --------------------------------------------------

_SHEET = [
    (1, ["Sentence #", "Word", "GOLD-TAG"]), (2, ["1", "Ali", "S-PER"]), (3, ["1", "keldi", "O"]), (4, ["2", "kecha", "S-DATE"]), (5, ["2", "ketdi", "O"]), (6, ["3", "oq", "E-LOC"]), (7, ["4", "x", "Q-PER"]), (8, ["5", "Erta", "B-DATE"]), (9, ["5", "tong", "E-DATE"]), (11, ["7", "Erta", "B-DATE"]), (12, ["7", "kech", "E-DATE"]), (10, ["6", "a", "S-ALIEN"]),
]


@query(_values([
    ("expert", "uz-expert:One:1", "Ali keldi", "B-PER O"), ("expert", "uz-expert:One:2", "kecha ketdi", "B-TEMPORAL O"), ("expert", "uz-expert:One:5", "Erta tong", "B-TEMPORAL I-TEMPORAL"), ("temporal", "uz-temporal:One:5", "Erta tong", "B-TEMPORAL I-TEMPORAL"), ("expert", "uz-expert:One:7", "Erta kech", "B-TEMPORAL I-TEMPORAL"), ("temporal", "uz-temporal:One:7", "Erta kech", "B-TEMPORAL I-TEMPORAL"),
    ("expert", "orphan", "1", None), ("expert", "malformed", "1", None), ("expert", "unsupported", "1", None), ("temporal", "no TEMPORAL entity", "1", None), ("temporal", "excluded normalized duplicate", "1", None), ("temporal", "orphan", "1", None), ("temporal", "malformed", "1", None), ("temporal", "unsupported", "1", None),
], "mode, id, text, tags"))
def drv4_src12_import(spark: SparkSession, sf: str) -> DataFrame:
    """DRV4, SRC7, SRC12, ARR1: a worksheet with aliased headers, in both modes, with reject counts and an excluded phrase."""
    rows = spark.createDataFrame(_SHEET, "row_number int, cells array<string>")
    sentences = E.sheet_sentences(rows, "One", "gold-tag")
    path = _folder(spark, "excluded")
    spark.createDataFrame([(json.dumps({"tokens": ["Kecha", "ketdi"]}),)], "value string").write.text(path)
    excluded = E.read_excluded_phrases(spark, [path])
    out = None
    for mode in ("expert", "temporal"):
        good, bad = PL.imported_sentences(sentences, mode, "uz", excluded)
        part = good.select(F.lit(mode).alias("mode"), "id", F.array_join("tokens", " ").alias("text"), F.array_join("ner_tags", " ").alias("tags"))
        part = part.unionByName(bad.select(F.lit(mode).alias("mode"), F.col("reason").alias("id"), F.col("n").cast("string").alias("text"), F.lit(None).cast("string").alias("tags")))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    f"""
    WITH good AS (SELECT *, {sql_full_text("array_to_string(tokens, ' ')")} AS k FROM {NER} WHERE id IN (SELECT id FROM ({sql_of('val1_reasons')}) WHERE reason IS NULL)),
    t AS (SELECT *, k IN (SELECT k FROM good WHERE split = 'test') AS guarded FROM good WHERE split = 'train')
    SELECT count(*) AS source_record_count, count(*) FILTER (WHERE guarded) AS excluded_protected_source_record_count, count(*) FILTER (WHERE NOT guarded) AS retained_source_record_count,
        count(*) FILTER (WHERE NOT guarded AND len(list_filter(ner_tags, lambda g: g[3:] IN ('PER', 'LOC', 'ORG', 'TEMPORAL'))) > 0) AS speech_variant_count FROM t
    """
)
def drv3_speech(spark: SparkSession, sf: str) -> DataFrame:
    """DRV3, AGG26: spoken variants and authored sentences for the train records, none of them near a test text."""
    good = ner(spark, sf).where(B.bio_reason(F.col("tokens"), F.col("ner_tags")).isNull())
    stats = PL.speech_augmented(good.where("split = 'train'"), good.where("split = 'test'"), 42)[1]
    names = ["source_record_count", "excluded_protected_source_record_count", "retained_source_record_count", "speech_variant_count"]
    return spark.createDataFrame([tuple(stats[n] for n in names)], ", ".join(f"{n} bigint" for n in names))


# --- strict readers -------------------------------------------------------------


@query(
    """
    SELECT sample_id AS id, len(gold_entities)::BIGINT AS spans FROM (SELECT DISTINCT ON (sample_id) sample_id, gold_entities, conditions, speaker_id FROM stt_predictions WHERE speaker_id IS NOT NULL AND len(conditions) > 0 ORDER BY sample_id, prediction_id)
    """
)
def src18_src21_evaluation_set(spark: SparkSession, sf: str) -> DataFrame:
    """SRC18, SRC21, JOIN4: the samples written as metadata and checklist, read back by the strict readers."""
    x = table(spark, sf, "stt_predictions").where("speaker_id IS NOT NULL AND size(conditions) > 0")
    x = x.groupBy("sample_id").agg(F.min_by(F.struct("gold_transcript", "gold_entities", "conditions", "speaker_id"), "prediction_id").alias("s"))
    x = x.select(F.col("sample_id").alias("id"), F.concat(F.lit("audio/"), "sample_id", F.lit(".wav")).alias("file"), "s.gold_transcript", F.col("s.gold_entities").alias("entities"), "s.speaker_id", F.array_distinct("s.conditions").alias("conditions"))
    path, checks = _folder(spark, "metadata"), _folder(spark, "checklist")
    io.write_jsonl(x, path, "id")
    samples = E.read_metadata(spark, path)
    flags = [F.lit(False).alias(c) for c in E.CHECKLIST[4:]]
    io.write_csv(samples.select(F.col("id").alias("recording_id"), "speaker_id", F.col("id").alias("prompt_id"), F.col("file").alias("audio_file"), *flags), checks, E.CHECKLIST, "recording_id")
    good = E.read_checklist(spark, checks, samples)
    return samples.join(good.select(F.col("recording_id").alias("id")), "id").select("id", F.size("entities").cast("bigint").alias("spans"))


@query("SELECT (SELECT count(*) FROM prompts) * (SELECT count(*) FROM speakers) AS recordings, (SELECT count(*) FROM speakers) AS speakers")
def snk8_src19_src20_plan(spark: SparkSession, sf: str) -> DataFrame:
    """SNK8, SRC19, SRC20: prompts and speakers written and read back by the strict readers, and the recording plan of both."""
    prompts, speakers = _folder(spark, "prompts"), _folder(spark, "speakers")
    io.write_jsonl(table(spark, sf, "prompts").select("id", "text", "entities", "speech_conditions", "content_tags"), prompts, "id")
    rows = [r.asDict() for r in table(spark, sf, "speakers").select("speaker_id", "conditions").toLocalIterator()]
    spark.createDataFrame([(json.dumps(rows),)], "value string").coalesce(1).write.text(speakers)
    path = _folder(spark, "plan")
    io.write_recording_plan(E.read_prompts(spark, prompts), E.read_speakers(spark, speakers), path)
    plan = spark.read.option("header", True).csv(path)
    return plan.agg(F.count("*").alias("recordings"), F.countDistinct("speaker_id").alias("speakers"))


_AUDIO = [(1, "a.wav", 10, 5.0, None), (2, None, None, None, "does not exist"), (3, "a.wav", 0, 5.0, "is empty"), (4, "a.txt", 10, 5.0, "format is not allowed"), (5, "b.MP3", 27 << 20, 5.0, "exceeds the upload size limit"), (6, "a.ogg", 10, None, "could not be decoded"), (7, "a.ogg", 10, 0.0, "contains no frames"), (8, "a.ogg", 10, 60.5, "exceeds the duration limit"), (9, "a.ogg", 10, 60.0, None)]


@query(_values([(i, r) for i, *_, r in _AUDIO], "id, reason"))
def aud1_policy(spark: SparkSession, sf: str) -> DataFrame:
    """AUD1: a recording per rule of the policy."""
    x = spark.createDataFrame([(i, p, n, s) for i, p, n, s, _ in _AUDIO], "id int, path string, size bigint, seconds double")
    return x.select("id", E.audio_reason(F.col("path"), F.col("size"), F.col("seconds")).alias("reason"))


# --- chunks, variants, reports ---------------------------------------------------


@query(f"SELECT id, i::BIGINT AS unit, g AS label FROM (SELECT id, unnest(ner_tags) AS g, generate_subscripts(ner_tags, 1) - 1 AS i FROM {NER} WHERE len(tokens) = len(ner_tags))")
def udf1_agg10_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """UDF1, AGG10: records in overlapping chunks of six words; the labels of the chunks, worse at their ends, come together to those of the record."""
    x = ner(spark, sf).where("size(tokens) = size(ner_tags)").withColumn("u", F.arrays_zip("tokens", "ner_tags"))
    c = PL.overflow_chunks(x, "id", "u", 6)
    p = c.select("id", "first", F.size("units").alias("n"), F.posexplode("units").alias("i", "u"))
    # an answer at the cut of a chunk, where the next or the last one has the word too, is wrong and less sure
    edge = (F.col("i") == 0) & (F.col("first") > 0)
    p = p.select("id", "first", "i", F.when(edge, F.lit("wrong")).otherwise(F.col("u.ner_tags")).alias("label"), F.when(edge, 0.5).otherwise(0.9).alias("score"))
    return PL.best_units(p, "id").select("id", F.col("unit").cast("bigint").alias("unit"), "label")


@query(
    """
    WITH g AS (SELECT id, unnest(entities) AS e FROM speech_ner_eval), p AS (SELECT id, unnest(model_entities) AS e FROM speech_ner_eval),
    v AS (SELECT 'sure' AS variant, 0.7 AS least UNION ALL SELECT 'all', 0.0),
    r AS (SELECT variant, id, e.label AS label, e."start" AS s, e."end" AS t, 1 AS g, 0 AS p FROM g, v UNION ALL SELECT variant, id, e.label, e."start", e."end", 0, 1 FROM p, v WHERE e.score >= least),
    c AS (SELECT variant, label, sum(g) AS g, sum(p) AS p FROM r GROUP BY variant, id, label, s, t),
    n AS (SELECT variant, coalesce(label, 'overall') AS label, sum(least(g, p))::BIGINT AS tp, sum(greatest(p - g, 0))::BIGINT AS fp, sum(greatest(g - p, 0))::BIGINT AS fn FROM c GROUP BY GROUPING SETS ((variant, label), (variant)))
    SELECT *, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 9) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 9) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 9) AS f1 FROM n
    """
)
def agg20_variants(spark: SparkSession, sf: str) -> DataFrame:
    """AGG20: exact scores of two prediction variants, all of the model's entities and those of score 0.7 or more."""
    x = table(spark, sf, "speech_ner_eval")
    gold = x.select("id", F.explode("entities").alias("e")).select("id", "e.label", "e.start", "e.end")
    pred = x.select("id", F.explode("model_entities").alias("e")).select("id", "e.label", "e.start", "e.end", "e.score")
    return R.variant_scores(gold, {"all": pred, "sure": pred.where("score >= 0.7")}, ["id", "label", "start", "end"])


@query(None)
def agg20_views(spark: SparkSession, sf: str) -> DataFrame:
    """AGG20: the display model and the combined rules and model on all spoken items."""
    x = table(spark, sf, "speech_ner_eval").select("id", "text", "entities", "model_entities")
    found = P.extract(x.select("id", "text", "model_entities"), "text", "model_entities", "found").select("id", F.inline_outer("found")).where("label IS NOT NULL").select("id", "label", "start", "end")
    gold = x.select("id", F.explode("entities").alias("e")).select("id", "e.label", "e.start", "e.end")
    pred = x.select("id", F.explode("model_entities").alias("e")).select("id", "e.label", "e.start", "e.end")
    return R.variant_scores(gold, {"raw_display_model": pred, "combined_final": found}, ["id", "label", "start", "end"])


_REPORT = [("a", ["Word omitted", "Repetition"], ["Missed person"], []), ("b", ["Word omitted"], [], ["Meaning changed"]), ("c", [], [], [])]


@query(_values([("STT errors", "Word omitted", 2), ("STT errors", "Repetition", 1), ("NER errors", "Missed person", 1), ("Normalization errors", "Meaning changed", 1)], "title, category, n"))
def err5_snk4_report(spark: SparkSession, sf: str) -> DataFrame:
    """ERR5, SNK4, AGG23: the Markdown report of golden records, read back from its text."""
    x = spark.createDataFrame(_REPORT, "id string, stt_error array<string>, ner_error array<string>, normalization_error array<string>")
    samples = spark.createDataFrame([(i, "s", [], ["quiet"], 9.0) for i in "abc"], "id string, speaker_id string, entities array<struct<label:string>>, conditions array<string>, seconds double")
    text, _ = R.run_report(x, samples, "E", "records.jsonl", gate=False)
    title, rows = None, []
    for line in text.splitlines():
        if line.startswith("## "):
            title = line[3:]
        elif title and line.startswith("| ") and not line.startswith(("| Category", "| ---")):
            category, n = (c.strip() for c in line.strip("|").split("|"))
            rows.append((title, category, int(n)))
    return spark.createDataFrame(rows, "title string, category string, n int").where("n > 0")


@query(
    f"""
    SELECT model_key, device, count(*) AS samples, count(*) FILTER (WHERE raw_transcript IS NULL OR trim(raw_transcript) = '') AS failed, round(sum(timing.stt_seconds) / nullif(sum(audio_duration_seconds) FILTER (WHERE timing.stt_seconds IS NOT NULL), 0), 9) AS real_time_factor
    FROM (SELECT DISTINCT ON (prediction_id) * FROM stt_predictions) GROUP BY 1, 2
    """
)
def err7_stt_summary(spark: SparkSession, sf: str) -> DataFrame:
    """ERR7: one row per model and device, written as CSV with fixed fields and read back."""
    x = table(spark, sf, "stt_predictions").dropDuplicates(["prediction_id"])
    seconds = F.sum(F.when(F.col("timing.stt_seconds").isNotNull(), F.col("audio_duration_seconds")))
    failed = F.coalesce(F.trim("raw_transcript") == "", F.lit(True))
    g = x.groupBy("model_key", "device").agg(F.count("*").alias("samples"), F.count_if(failed).alias("failed"), F.round(F.sum("timing.stt_seconds") / F.nullif(seconds, F.lit(0.0)), 9).alias("real_time_factor"))
    path = _folder(spark, "benchmark")
    io.write_csv(g, path, g.columns, "model_key")
    return spark.read.schema(g.schema).option("header", True).csv(path)
