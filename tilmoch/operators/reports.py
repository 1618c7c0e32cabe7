"""Error taxonomies, selection, stability, compliance and collection reports."""

from __future__ import annotations

from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilmoch.functions import bio as B
from tilmoch.functions import text as S
from tilmoch.operators.metrics import edit_split, f1_columns, span_counts

# The categories of each taxonomy in report order.
STT_CATEGORIES = [
    "Person mistranscribed", "Location mistranscribed", "Organization mistranscribed", "Date mistranscribed", "Time mistranscribed", "Word omitted", "Word inserted", "Repetition",
    "Apostrophe error", "Numeric-format error", "Suffix error", "Code-switching error", "Noise-related error",
]
NER_CATEGORIES = [
    "Missed person", "Missed location", "Missed organization", "Missed date", "Person classified as location", "Person classified as organization", "Location classified as organization",
    "Organization classified as location", "Date classified as number only", "Number incorrectly classified as date", "Incomplete entity", "Excessive entity span", "False positive",
    "Low-confidence correct prediction",
]
NORMALIZATION_CATEGORIES = [
    "Incorrect apostrophe replacement", "Incorrect date punctuation", "Incorrect time punctuation", "Whitespace corruption", "Meaning changed", "Offset mismatch", "Unsafe autocorrection", "Unsafe date resolution",
]
WORDS_FOR = {"PER": "person", "LOC": "location", "ORG": "organization", "DATE": "date"}
CONFUSED = [("PER", "LOC"), ("PER", "ORG"), ("LOC", "ORG"), ("ORG", "LOC")]
CONDITIONS = "quiet background_noise laptop_microphone phone_microphone fast_speech slow_speech formal_speech conversational_speech uzbek_russian_code_switching".split()
CONTENT = "common_names rare_names cities regions districts villages organizations relative_dates numeric_dates times inflected_entities".split()


def _words(x: Column) -> Column:
    return F.filter(F.split(x, " "), lambda w: w != "")


def with_stt_errors(df: DataFrame, gold: str, raw: str, entities: str, conditions: str, out: str = "errors") -> DataFrame:
    """ERR1: categories of a transcript's errors, in order; none where both texts are equal once normalized."""
    df = df.withColumn("_g", S.normalize_evaluation(F.coalesce(F.col(gold), F.lit("")))).withColumn("_r", S.normalize_evaluation(F.coalesce(F.col(raw), F.lit(""))))
    df = df.withColumn("_gw", _words(F.col("_g"))).withColumn("_rw", _words(F.col("_r"))).withColumn("_e", edit_split(F.col("_gw"), F.col("_rw")))
    # surfaces of the entities: punctuation and case apart, as the normalized transcript has them
    surface = lambda t: S.squeeze(F.regexp_replace(F.regexp_replace(F.lower(F.translate(t, S.CANONICAL_APOSTROPHES, "ʻ" * 6)), r"(?<![\p{L}\p{N}])ʻ|ʻ(?![\p{L}\p{N}])", " "), r"\p{P}", " "))
    lost = F.filter(entities, lambda e: B.occurrences(F.col("_rw"), _words(surface(e["text"]))) == 0)
    df = df.withColumn("_lost", F.transform(lost, lambda e: F.when((e["label"] == "DATE") & e["text"].contains(":"), "TIME").otherwise(e["label"])))
    bare = lambda c: S.delete(F.col(c), "ʻ")
    more = F.exists("_rw", lambda w: (F.size(F.filter("_rw", lambda x: x == w)) > 1) & (F.size(F.filter("_rw", lambda x: x == w)) > F.size(F.filter("_gw", lambda x: x == w))))
    tests = {
        **{f"{w.capitalize()} mistranscribed": F.array_contains("_lost", k) for k, w in [*WORDS_FOR.items(), ("TIME", "time")]},
        "Word omitted": F.col("_e.deletions") > 0, "Word inserted": F.col("_e.insertions") > 0, "Repetition": more, "Apostrophe error": bare("_g") == bare("_r"),
        "Numeric-format error": S.digit_runs(F.col("_g")) != S.digit_runs(F.col("_r")), "Suffix error": F.lit(False),
        "Code-switching error": F.array_contains(conditions, "uzbek_russian_code_switching"), "Noise-related error": F.array_contains(conditions, "background_noise"),
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(tests[c], F.lit(False)), c) for c in STT_CATEGORIES]))
    return df.withColumn(out, F.when(F.col("_g") == F.col("_r"), F.array().cast("array<string>")).otherwise(found)).drop("_g", "_r", "_gw", "_rw", "_e", "_lost")


def _ner_one(gold: list[dict], pred: list[dict]) -> list[str]:
    """Each gold entity claims at most one free prediction by the strongest rule that applies: equal, confused, partial."""
    free, found = list(range(len(pred))), set()
    rules = (
        ("equal", lambda g, p: p["label"] == g["label"] and p["surface"] == g["surface"]),
        ("confused", lambda g, p: p["surface"] == g["surface"]),
        ("partial", lambda g, p: p["label"] == g["label"] and (p["surface"] in g["surface"] or g["surface"] in p["surface"])),
    )
    for g in gold:
        rule, i = next(((name, i) for (name, test), i in product(rules, free) if test(g, pred[i])), (None, None))
        missed = f"Missed {WORDS_FOR[g['label']]}"
        if rule is None:
            found.add(missed)
            if g["label"] == "DATE" and any(c.isdigit() for c in g["surface"]):
                found.add("Date classified as number only")
            continue
        free.remove(i)
        p = pred[i]
        if rule == "equal" and p["score"] is not None and p["score"] < 0.6:
            found.add("Low-confidence correct prediction")
        elif rule == "confused":
            pair = (g["label"], p["label"])
            found.add(f"{WORDS_FOR[pair[0]].capitalize()} classified as {WORDS_FOR[pair[1]]}" if pair in CONFUSED else missed)
        elif rule == "partial":
            found.add("Incomplete entity" if len(p["surface"]) < len(g["surface"]) else "Excessive entity span")
    for i in free:
        found.add("False positive")
        if pred[i]["label"] == "DATE" and pred[i]["surface"].isdigit():
            found.add("Number incorrectly classified as date")
    return [c for c in NER_CATEGORIES if c in found]


@F.arrow_udf(T.ArrayType(T.StringType()))
def ner_errors(gold: pa.Array, pred: pa.Array) -> pa.Array:
    """JOIN13 / ERR2: categories from a stateful matching of ``(label, surface, score)`` arrays."""
    return pa.array([_ner_one(g or [], p or []) for g, p in zip(gold.to_pylist(), pred.to_pylist())], pa.list_(pa.string()))


def normalization_errors(raw: Column, normalized: Column, entities: Column) -> Column:
    """ERR3: categories of a normalized transcript that is not the normal form of its raw one, and of wrong offsets."""
    differs = normalized != S.normalize_runtime(raw)
    wrong = F.exists(entities, lambda e: e["start"].isNull() | e["end"].isNull() | (e["start"] < 0) | (e["end"] <= e["start"]) | (e["end"] > F.length(normalized)) | (normalized.substr(e["start"] + 1, e["end"] - e["start"]) != e["text"]))
    tests = {
        "Incorrect apostrophe replacement": differs & normalized.rlike("['’‘ʼ`]"), "Incorrect date punctuation": differs & raw.rlike(r"\d") & normalized.contains(" - "),
        "Incorrect time punctuation": differs & normalized.rlike(r"\d\s+:\s+\d"), "Whitespace corruption": differs & (normalized.contains("  ") | (normalized != F.trim(normalized))),
        "Meaning changed": differs & (S.normalize_evaluation(raw) != S.normalize_evaluation(normalized)), "Offset mismatch": wrong,
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(tests[c], F.lit(False)), c) for c in NORMALIZATION_CATEGORIES if c in tests]))


def category_counts(df: DataFrame, errors: str, categories: list[str]) -> DataFrame:
    """AGG23: rows per category in fixed order, zeros included."""
    # the outer form keeps the optimizer from copying the whole expression into a size filter below
    n = df.select(F.explode_outer(errors).alias("category")).where("category IS NOT NULL").groupBy("category").agg(F.count("*").alias("n"))
    dim = df.sparkSession.createDataFrame(list(enumerate(categories)), "place int, category string")
    return dim.join(n, "category", "left").select("place", "category", F.coalesce("n", F.lit(0)).alias("n"))


def ranked_runs(metrics: DataFrame, key: str, order: list[tuple[str, bool]]) -> DataFrame:
    """TOP6: runs in selection order; ties go to the smaller key. A handful of rows per comparison."""
    cols = [F.desc_nulls_last(c) if down else F.asc_nulls_last(c) for c, down in order]
    from pyspark.sql import Window as W

    return metrics.withColumn("place", F.row_number().over(W.orderBy(*cols, key)))


def metric_deltas(metrics: DataFrame, base: str, other: str) -> DataFrame:
    """JOIN14 / ERR6: ``(metric, split, base_value, other_value, delta, change)`` of two runs in long form."""
    a = metrics.where(F.col("run") == base).select("metric", "split", F.col("value").alias("base_value"))
    b = metrics.where(F.col("run") == other).select("metric", "split", F.col("value").alias("other_value"))
    d = F.round(F.col("other_value") - F.col("base_value"), 9)
    return a.join(b, ["metric", "split"]).withColumn("delta", d).withColumn("change", F.when(d > 0, "improvement").when(d < 0, "regression").otherwise("same"))


def stability(metrics: DataFrame, by: list[str]) -> DataFrame:
    """AGG24: mean, population deviation and range over seeds."""
    v = F.col("value")
    return metrics.groupBy(*by).agg(F.count("*").alias("seeds"), F.round(F.avg(v), 9).alias("mean"), F.round(F.stddev_pop(v), 9).alias("deviation"), F.round(F.max(v) - F.min(v), 9).alias("spread"))


def compliance(samples: DataFrame, least_mentions: int = 30) -> DataFrame:
    """AGG21: one row of counts, coverage and issues of an evaluation set (``id, speaker_id, entities, conditions, seconds``)."""
    mentions = samples.select(F.explode("entities").alias("e")).agg(*[F.count_if(F.col("e.label") == x).alias(f"n_{x}") for x in WORDS_FOR])
    seen = samples.agg(F.count("*").alias("recordings"), F.countDistinct("speaker_id").alias("speakers"), F.coalesce(F.array_sort(F.array_distinct(F.flatten(F.collect_set("conditions")))), F.array().cast("array<string>")).alias("seen"), F.count_if(~F.col("seconds").between(5, 20)).alias("bad_durations"))
    x = seen.join(mentions)
    missing = lambda need: F.array_except(F.array(*map(F.lit, sorted(need))), F.col("seen"))
    issues = F.array(
        F.when(~F.col("recordings").between(100, 300), F.concat(F.lit("recording count must be between 100 and 300; found "), F.col("recordings").cast("string"))),
        F.when(F.col("speakers") < 5, F.concat(F.lit("at least 5 speakers are required; found "), F.col("speakers").cast("string"))),
        *[F.when(F.col(f"n_{k}") < least_mentions, F.concat(F.lit(f"at least {least_mentions} {k} mentions are required; found "), F.col(f"n_{k}").cast("string"))) for k in WORDS_FOR],
        F.when(F.size(missing(CONDITIONS)) > 0, F.concat(F.lit("missing required conditions: "), F.array_join(missing(CONDITIONS), ", "))),
        F.when(F.size(missing(CONTENT)) > 0, F.concat(F.lit("missing required content coverage: "), F.array_join(missing(CONTENT), ", "))),
        F.when(F.col("bad_durations") > 0, F.concat(F.lit("audio durations outside 5 to 20 seconds: "), F.col("bad_durations").cast("string"))),
    )
    return x.withColumn("issues", F.array_compact(issues)).drop("seen").withColumn("compliant", F.size("issues") == 0)


def collection_issues(df: DataFrame) -> DataFrame:
    """AGG22: rule breaks of checklist rows joined with what audio is present: ``(recording_id, issue)``."""
    # The texts of the report's issues.
    rules = {
        "checklist says recorded but audio is missing": F.col("recorded") & ~F.col("audio_present"), "audio exists but checklist recorded is false": F.col("audio_present") & ~F.col("recorded"),
        "recorded is true without confirmed consent": F.col("recorded") & ~F.col("consent_confirmed"), "transcript review is true before recording": F.col("transcript_reviewed") & ~F.col("recorded"),
        "entity-span review is true before transcript review": F.col("entity_spans_reviewed") & ~F.col("transcript_reviewed"),
    }
    hits = F.array_compact(F.array(*[F.when(test, name) for name, test in rules.items()]))
    return df.select("recording_id", F.explode(hits).alias("issue"))


def key_mismatch(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """JOIN4: keys on one side only, with the side that lacks them."""
    x = a.select(F.col(key).alias("k")).distinct().withColumn("l", F.lit(True))
    y = b.select(F.col(key).alias("k")).distinct().withColumn("r", F.lit(True))
    return x.join(y, "k", "full_outer").where("l IS NULL OR r IS NULL").select(F.col("k").alias(key), F.when(F.col("l").isNull(), "unexpected").otherwise("missing").alias("side"))


def taxonomy_report(counts: dict[str, list[tuple[str, int]]], ablation: str, recordings: int, compliant: bool, records: str) -> str:
    """SNK4: the error counts of each taxonomy as Markdown."""
    # The texts of the report.
    lines = ["# Error analysis", "", f"Primary ablation: **{ablation}**", f"Evaluated recordings: **{recordings}**", f"Dataset status: **{'Phase 8 compliant' if compliant else 'PROVISIONAL'}**", ""]
    lines += [f"This aggregate summary contains no transcripts. Full required error records are local, Git-ignored, and stored at `{records}`.", "", "Automatic classifications are an auditable first pass and require manual review of `notes`.", ""]
    for title, rows in counts.items():
        lines += [f"## {title}", "", "| Category | Count |", "| --- | ---: |", *(f"| {c} | {n} |" for c, n in rows), ""]
    return "\n".join(lines).rstrip() + "\n"


def covered(records: DataFrame, samples: DataFrame, key: str = "id") -> None:
    """ERR5: an error unless the records have exactly the samples' keys, each once."""
    if not key_mismatch(samples, records, key).isEmpty() or not records.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError("the records do not cover the evaluation set exactly")


def run_report(records: DataFrame, samples: DataFrame, ablation: str, path: str, gate: bool = True) -> tuple[str, dict]:
    """ERR5 / AGG23: (Markdown summary, compliance row) of error records ``(id, stt_error, ner_error, normalization_error)``, arrays of categories.

    samples are the evaluation set (see ``compliance``). With gate a set that is not
    compliant is an error; so are records that do not cover it exactly.
    """
    status = compliance(samples).first().asDict(recursive=True)
    if gate and not status["compliant"]:
        raise ValueError("the evaluation set is not compliant: " + "; ".join(status["issues"]))
    covered(records, samples)
    tables = {"STT errors": ("stt_error", STT_CATEGORIES), "NER errors": ("ner_error", NER_CATEGORIES), "Normalization errors": ("normalization_error", NORMALIZATION_CATEGORIES)}
    counts = {t: [(r["category"], r["n"]) for r in category_counts(records, c, names).orderBy("place").collect()] for t, (c, names) in tables.items()}
    return taxonomy_report(counts, ablation, records.count(), status["compliant"], path), status


def variant_scores(gold: DataFrame, variants: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """AGG20: exact scores of each prediction variant (display model, projected candidates, combined) in one aggregation."""
    tagged = lambda df, v: df.select(F.lit(v).alias("variant"), *key)
    union = lambda parts: parts[0] if len(parts) == 1 else union([parts[0].unionByName(parts[1]), *parts[2:]])
    g = union([tagged(gold, v) for v in variants])
    p = union([tagged(df, v) for v, df in variants.items()])
    c = span_counts(g, p, ["variant", "label"], ["variant", *key])
    total = c.groupBy("variant").agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn")]).withColumn("label", F.lit("overall"))
    c = c.unionByName(total.select(*c.columns))
    return c.select("variant", "label", "tp", "fp", "fn", *f1_columns(F.col("tp"), F.col("fp"), F.col("fn")))
