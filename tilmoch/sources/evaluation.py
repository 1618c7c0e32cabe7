"""Readers of evaluation sets, recording plans, reviewed names and training runs: fixed schemas, loud failures."""

from __future__ import annotations

import json
import math
import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilmoch.functions import lexicon as L
from tilmoch.functions import text as S
from tilmoch.operators.reports import CONDITIONS, CONTENT, key_mismatch
from tilmoch.sources.io import AUDIO_SUFFIXES, SourceError, read_jsonl, require

SPAN = "array<struct<text:string,label:string,start:int,end:int>>"
SAMPLE = f"id string, file string, gold_transcript string, entities {SPAN}, speaker_id string, conditions array<string>"
PROMPT = "id string, text string, entities array<struct<text:string,label:string>>, speech_conditions array<string>, content_tags array<string>"
CHECKLIST = ["recording_id", "speaker_id", "prompt_id", "audio_file", "consent_confirmed", "recorded", "transcript_reviewed", "entity_spans_reviewed"]


def _keys(schema: str) -> list[str]:
    depth, names, word = 0, [], ""
    for ch in schema + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            names.append(word.split()[0])
            word = ""
        else:
            word += ch
    return sorted(names)


def _exact(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines whose objects have exactly the keys of the schema."""
    lines = require(spark.read.text(path), F.trim("value") == "", "blank line")
    lines = require(lines, ~F.coalesce(F.array_sort(F.json_object_keys("value")) == F.array(*map(F.lit, _keys(schema))), F.lit(False)), "a record with missing or further keys")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(c) == "", F.lit(True))


def _once(df: DataFrame, column: str) -> DataFrame:
    """df, or an error if a value of the column occurs twice: one aggregate, combined before the shuffle."""
    if not df.groupBy(column).count().where("count > 1").isEmpty():
        raise SourceError(f"{column} is not unique")
    return df


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """SRC18: samples with exactly the fixed keys, unique ids and files, relative paths inside the folder, and ordered spans that are slices of the transcript."""
    df = _exact(spark, path, SAMPLE)
    es, t = F.col("entities"), F.col("gold_transcript")
    span = F.exists(es, lambda e: F.coalesce(~e["label"].isin(*L.LABELS) | (e["start"] < 0) | (e["end"] <= e["start"]) | (e["end"] > F.length(t)) | (t.substr(e["start"] + 1, e["end"] - e["start"]) != e["text"]), F.lit(True)))
    order = F.exists(F.transform(es, lambda e, i: (i > 0) & (e["start"] < F.get(es, F.greatest(i - 1, F.lit(0)))["end"])), lambda b: b)
    away = F.col("file").startswith("/") | F.array_contains(F.split("file", "/"), "..")
    repeated = F.coalesce(F.size("conditions") == 0, F.lit(True)) | (F.size("conditions") != F.size(F.array_distinct("conditions"))) | F.exists("conditions", lambda c: F.trim(c) == "")
    bad = _blank("id") | _blank("file") | _blank("gold_transcript") | _blank("speaker_id") | es.isNull() | span | order | away | repeated
    df = require(df, bad, "a sample with a blank field, a wrong span or an unsafe path")
    return _once(_once(df, "id"), "file")


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """SRC19: prompts of 12 to 38 words with all four labels, known conditions and content tags."""
    df = _exact(spark, path, PROMPT)
    words = F.size(F.filter(F.split(S.squeeze(F.col("text")), " "), lambda w: w != ""))
    labels = F.array_sort(F.array_distinct(F.transform("entities", lambda e: e["label"]))) == F.array(*map(F.lit, sorted(L.LABELS)))
    known = lambda c, names: F.size(F.array_except(c, F.array(*map(F.lit, names)))) == 0
    good = S.identifier_ok(F.col("id")) & words.between(12, 38) & labels & known("speech_conditions", CONDITIONS) & known("content_tags", CONTENT)
    return _once(require(df, ~F.coalesce(good, F.lit(False)), "a prompt outside the rules"), "id")


def read_speakers(spark: SparkSession, path: str, least: int = 5) -> DataFrame:
    """SRC20: a JSON array of at least five speakers with unique ids and known conditions."""
    df = spark.read.schema("speaker_id string, conditions array<string>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    good = S.identifier_ok(F.col("speaker_id")) & (F.size(F.array_except("conditions", F.array(*map(F.lit, CONDITIONS)))) == 0)
    df = _once(require(df, ~F.coalesce(good, F.lit(False)), "a speaker outside the rules"), "speaker_id")
    if df.count() < least:
        raise SourceError(f"at least {least} speakers are required")
    return df


def read_checklist(spark: SparkSession, path: str, samples: DataFrame) -> DataFrame:
    """SRC21: a checklist with exactly the fixed header and true/false cells, one row per sample (``id, speaker_id, file``)."""
    head = spark.read.option("header", True).csv(path).columns
    if head != CHECKLIST:
        raise SourceError(f"the header is {head}")
    raw = spark.read.schema(", ".join(f"{c} string" for c in CHECKLIST)).option("header", True).option("mode", "FAILFAST").csv(path)
    bad = F.lit(False)
    for c in CHECKLIST[:4]:
        bad = bad | _blank(c)
    for c in CHECKLIST[4:]:
        bad = bad | ~F.coalesce(F.lower(F.trim(c)).isin("true", "false"), F.lit(False))
    df = require(raw, bad, "a checklist row with a blank or non-boolean cell")
    df = _once(df.select(*CHECKLIST[:4], *[(F.lower(F.trim(c)) == "true").alias(c) for c in CHECKLIST[4:]]), "recording_id")
    own = samples.select(F.col("id").alias("recording_id"), F.col("speaker_id").alias("_s"), F.col("file").alias("_f"))
    if not key_mismatch(own, df, "recording_id").isEmpty():
        raise SourceError("checklist and samples differ in their ids")
    if not df.join(own, "recording_id").where("speaker_id <> _s OR audio_file <> _f").isEmpty():
        raise SourceError("checklist and samples differ in a speaker or file")
    return df


def read_excluded_phrases(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """SRC7: the distinct ``phrase_key`` of the token lists of JSON lines; a row without a list of strings fails."""
    df = read_jsonl(spark, paths[0], "tokens array<string>")
    for p in paths[1:]:
        df = df.unionByName(read_jsonl(spark, p, "tokens array<string>"))
    df = require(df.withColumn("id", F.lit("x")).select("id", "tokens"), F.col("tokens").isNull() | F.exists("tokens", lambda t: t.isNull()), "a record without string tokens")
    return df.where("id IS NOT NULL").select(S.phrase_key(F.col("tokens")).alias("phrase_key")).distinct()


def _object(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    if not isinstance(data, dict):
        raise SourceError(f"{path} is no object")
    return data


def _name_rows(spark: SparkSession, rows: list[tuple], schema: str, key: Column) -> DataFrame:
    return spark.createDataFrame(rows, schema).withColumn("key", key)


def read_counted_names(spark: SparkSession, path: str) -> DataFrame:
    """SRC9: ``(name, key)`` of a lexicon whose names are a list or the keys of an object."""
    names = _object(path).get("names")
    if not isinstance(names, list | dict) or not all(isinstance(n, str) for n in names):
        raise SourceError("names are a list or an object")
    return _name_rows(spark, [(n,) for n in names], "name string", S.comparison_key(F.col("name"))).dropDuplicates(["key"])


def read_person_names(spark: SparkSession, path: str) -> DataFrame:
    """SRC10: ``(canonical, key)`` of reviewed names; an empty list, an empty name or two names of one key are errors."""
    names = _object(path).get("names")
    if not isinstance(names, list) or not names or not all(isinstance(n, str) and n for n in names):
        raise SourceError("names are a list of words")
    return _once(_name_rows(spark, [(n,) for n in names], "canonical string", S.comparison_key(F.col("canonical"))), "key")


def read_person_phrases(spark: SparkSession, path: str) -> DataFrame:
    """SRC11: ``(phrase, canonical, key)`` of reviewed phrases of two to four words, key an array of word keys."""
    items = _object(path).get("phrases")
    if not isinstance(items, list) or not all(isinstance(x, dict) and isinstance(x.get("phrase"), str) and isinstance(x.get("canonical"), str) and x["phrase"] and x["canonical"] for x in items):
        raise SourceError("phrases are objects of phrase and canonical")
    words = F.filter(F.split(S.squeeze(F.col("phrase")), " "), lambda w: w != "")
    df = _name_rows(spark, [(x["phrase"], x["canonical"]) for x in items], "phrase string, canonical string", F.transform(words, S.plain_comparison_key))
    bad = ~F.size("key").between(2, 4) | F.exists("key", lambda k: F.length(k) == 0)
    if not df.where(bad).isEmpty():
        raise SourceError("a phrase has two to four words")
    return _once(df, "key")


def sheet_sentences(rows: DataFrame, sheet: str, tag_column: str, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """SRC12: ``(sheet, sentence, tokens, source_tags)`` of worksheet rows (``row_number, cells``), tokens in row order.

    The header is the first row; a column is found by any of its aliases, apart from
    case and outer blanks. A short row, or one with a blank sentence or token, fails.
    """
    names = {"sentence": ["sentence", "sentence #", "sentence id"], "token": ["token", "word"], "tag": [tag_column]} | (aliases or {})
    head = rows.orderBy("row_number").limit(1).collect()
    if not head:
        raise SourceError("an empty sheet")
    cells = [(c or "").strip().lower() for c in head[0]["cells"]]
    at = {}
    for k, options in names.items():
        found = [cells.index(o.strip().lower()) for o in options if o.strip().lower() in cells]
        if not found:
            raise SourceError(f"no column {options} in {cells}")
        at[k] = found[0]
    x = rows.where(F.col("row_number") > head[0]["row_number"]).select("row_number", *[F.get("cells", F.lit(i)).alias(k) for k, i in at.items()])
    x = require(x.select(F.col("sentence"), "token", "tag", "row_number"), _blank("sentence") | _blank("token") | F.col("tag").isNull(), "a short row or a blank cell")
    g = x.groupBy(F.trim("sentence").alias("sentence")).agg(F.array_sort(F.collect_list(F.struct("row_number", "token", "tag"))).alias("c"))
    return g.select(F.lit(sheet).alias("sheet"), "sentence", F.transform("c", lambda c: c["token"]).alias("tokens"), F.transform("c", lambda c: c["tag"]).alias("source_tags"))


def audio_reason(path: Column, size: Column, seconds: Column, most_seconds: float = 60.0, most_bytes: int = 25 << 20, suffixes: Sequence[str] = AUDIO_SUFFIXES) -> Column:
    """AUD1: why a recording is refused, by what is known of it; null if it is not. Null seconds mean that it could not be decoded."""
    return (
        F.when(path.isNull() | size.isNull(), "does not exist").when(size <= 0, "is empty").when(~F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*suffixes), "format is not allowed")
        .when(size > most_bytes, "exceeds the upload size limit").when(seconds.isNull(), "could not be decoded").when(F.isnan(seconds) | (seconds <= 0), "contains no frames").when(seconds > most_seconds, "exceeds the duration limit")
    )


def read_runs(spark: SparkSession, runs: dict[str, str], validation: Sequence[str], test: Sequence[str]) -> DataFrame:
    """SRC25 / SRC26: metrics of named training runs in long form ``(run, split, metric, value)``.

    The checkpoint pointer must stay inside its run, metrics must be finite and in
    [0, 1], and the pointer's metric must equal the validation one to 1e-12. Small
    files of a handful of runs, read on the driver.
    """
    rows = []
    for name, root in sorted(runs.items()):
        root = os.path.realpath(root)
        read = lambda f: _object(os.path.join(root, f))  # noqa: B023, E731
        pointer, metadata = read("best_checkpoint.json"), read("run_metadata.json")
        raw = pointer.get("checkpoint")
        if not isinstance(raw, str) or not raw or os.path.isabs(raw) or os.path.commonpath([root, os.path.realpath(os.path.join(root, raw))]) != root:
            raise SourceError(f"the checkpoint of {name} is not inside its run")
        if not os.path.isdir(os.path.join(root, raw)):
            raise SourceError(f"the checkpoint of {name} does not exist")
        if metadata.get("best_checkpoint") != raw:
            raise SourceError(f"pointer and metadata of {name} differ")
        values = {}
        for split, file, wanted in (("validation", "eval_metrics.json", validation), ("test", "evaluation_test_metrics.json", test)):
            data = read(file)
            for m in wanted:
                v = data.get(m)
                if isinstance(v, bool) or not isinstance(v, int | float) or not math.isfinite(v) or not 0 <= v <= 1:
                    raise SourceError(f"{m} of {name} is no number in [0, 1]")
                values[split, m] = float(v)
        if pointer.get("metric_for_best_model") != "overall_f1" or not math.isclose(float(pointer.get("metric_value", -1)), values.get(("validation", "eval_overall_f1"), -2), rel_tol=0, abs_tol=1e-12):
            raise SourceError(f"the pointer of {name} does not name its validation metric")
        rows += [(name, s, m, v) for (s, m), v in values.items()]
    return spark.createDataFrame(rows, "run string, split string, metric string, value double")
