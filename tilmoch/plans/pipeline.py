"""Composed pipelines: transcripts to entities, source tokens to splits, records to a training mix."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilmoch.functions import bio as B
from tilmoch.functions import lexicon as L
from tilmoch.functions import text as S
from tilmoch.functions.numbers import spoken_year
from tilmoch.operators import analysis as A
from tilmoch.operators import corpus as K
from tilmoch.operators import spans as P
from tilmoch.operators import templates as TP
from tilmoch.session import shared_table

ENTITY = "array<struct<text:string,label:string,start:int,end:int,score:double>>"
Predict = Callable[[list[str]], list[list[dict]]]

#: Fingerprints of texts that never enter a mix.
DENIED = ("74021c40cd631abaad79e31cc8ab58daa223f3d73cab1208ab173f3fd48726a0",)
#: Entity type: the markers of its hard names and how often a base row that holds one occurs in the mix.
HARD = {"LOC": (["mamlakat"], 8), "ORG": (["liga", "premyer"], 10)}


def with_predictions(df: DataFrame, text: str, make: Callable[[], Predict], out: str = "model_entities") -> DataFrame:
    """UDF1 / UDF2: entities of a pluggable model. ``make`` runs once per task and returns a function from texts to lists of entity dicts."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out}` {ENTITY}"
    kind = pa.list_(pa.struct([("text", pa.string()), ("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = make()
        for batch in batches:
            found = predict([t or "" for t in batch.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def decode_bio(df: DataFrame, predictions: str, threshold: float, visible: dict[str, str], out: str = "entities") -> DataFrame:
    """SPN10: token predictions (``label, score, start, end``) as entities: runs, mean scores, mapped labels, threshold, no overlaps by score."""
    zero = F.array().cast("array<struct<k:string,start:int,end:int,sum:double,n:int,open:boolean>>")
    order = F.array_sort(F.transform(predictions, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), p["label"].alias("label"), p["score"].alias("score"))))

    def step(acc: Column, p: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        k = F.when(p["label"].rlike("^[BI]-.+"), F.substring(p["label"], 3, 100))
        grows = p["label"].startswith("I-") & (last["k"] == k) & last["open"]
        shut = F.transform(acc, lambda g: F.struct(g["k"].alias("k"), g["start"].alias("start"), g["end"].alias("end"), g["sum"].alias("sum"), g["n"].alias("n"), F.lit(False).alias("open")))
        more = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last["k"].alias("k"), last["start"].alias("start"), p["end"].alias("end"), (last["sum"] + p["score"]).alias("sum"), (last["n"] + 1).alias("n"), F.lit(True).alias("open"))))
        new = F.concat(shut, F.array(F.struct(k.alias("k"), p["start"].alias("start"), p["end"].alias("end"), p["score"].cast("double").alias("sum"), F.lit(1).alias("n"), F.lit(True).alias("open"))))
        return F.when(k.isNull(), shut).when(F.coalesce(grows, F.lit(False)), more).otherwise(new).cast("array<struct<k:string,start:int,end:int,sum:double,n:int,open:boolean>>")

    labels = F.create_map(*[F.lit(v) for kv in visible.items() for v in kv])
    df = df.withColumn("_p", order).withColumn("_g", F.aggregate("_p", zero, step))
    scored = F.transform("_g", lambda g: F.struct((-g["sum"] / g["n"]).alias("neg"), g["start"].alias("start"), (-g["end"]).alias("e"), labels[g["k"]].alias("label"), g["end"].alias("end")))
    df = df.withColumn("_s", F.array_sort(F.filter(scored, lambda s: s["label"].isNotNull() & (-s["neg"] >= threshold))))
    kept = P.greedy(F.col("_s"), "array<struct<neg:double,start:int,e:int,label:string,end:int>>")
    return df.withColumn(out, F.array_sort(F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"), (-s["neg"]).alias("score"))))).drop("_p", "_g", "_s")


def analyze_text(df: DataFrame, text: str, model: str) -> DataFrame:
    """API1: displayed text (STR2) and the model's entities on it, checked for length; rows that fail have an ``error`` and no entities."""
    t = df.withColumn("display_text", S.normalize_runtime(F.col(text)))
    good = S.text_ok(F.col("display_text"))
    return t.withColumn("error", F.when(~F.coalesce(good, F.lit(False)), "text must be nonblank and at most 20000 characters")).withColumn("entities", F.when(F.col("error").isNull(), F.col(model)))


def analyze_transcripts(df: DataFrame, text: str, model: str, analysis_model: str | None = None, threshold: float = 0.7) -> DataFrame:
    """API2: a raw transcript as displayed text, analysis view and resolved entities.

    ``model`` has entities on the displayed text; ``analysis_model``, if given, on the
    analysis text: those are projected back and admitted by their evidence.
    """
    t = df.withColumn("display_text", S.normalize_runtime(F.col(text)))
    t = A.with_view(t, "display_text").withColumn("_tokens", S.word_tokens(F.col("display_text"))).withColumn("_m", F.coalesce(F.col(model), F.array().cast(ENTITY)))
    t = P.with_temporal(t, "_tokens", "_dates")
    extra = F.array().cast(P.CANDIDATE)
    if analysis_model is not None:
        t = A.with_admitted(t, "view", analysis_model, "_tokens", "_dates", threshold, "_extra")
        extra = F.col("_extra").cast(P.CANDIDATE)
    k, m = F.col("_tokens"), F.col("_m")
    parts = [F.col("_dates"), P.phrase_head_candidates(k), P.phrase_candidates(k), P.introduction_candidates(k), P.boundary_candidates(k, m), P.model_candidates(m), extra, P.relation_candidates(k)]
    t = P.with_resolved(t.withColumn("_c", F.concat(*parts)), "_tokens", "_c", "_f")
    return t.withColumn("entities", P.with_canonical(F.col("display_text"), F.col("_f"))).drop("_tokens", "_m", "_dates", "_extra", "_c", "_f")


def prepare_dataset(source: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """DRV1: a source token table as (records with ``part``, rejected sentences with ``reason``)."""
    grouped = K.grouped_sentences(K.source_row_reasons(source))
    good = grouped.where("reason IS NULL").select("id", "tokens", "ner_tags", F.lit("source").alias("source"))
    return K.split_80_10_10(good, seed), grouped.where("reason IS NOT NULL").select("id", "reason")


def refuse(df: DataFrame, what: str) -> None:
    """An error if df has any row."""
    if not df.isEmpty():
        raise ValueError(what)


def _strict(df: DataFrame, what: str) -> None:
    """The guards of a source: strict BIO and no id twice."""
    refuse(df.where(B.bio_reason(F.col("tokens"), F.col("ner_tags")).isNotNull()), f"{what} holds tags that are no BIO")
    refuse(df.groupBy("id").count().where("count > 1"), f"{what} holds an id twice")


def _free_ids(df: DataFrame, taken: DataFrame) -> DataFrame:
    """STR23: ids that are taken get ``_2``, ``_3``..., the first that is free."""
    df, n = df.withColumn("_own", F.col("id")), 2
    taken = taken.select(F.col("id").alias("_t"))
    while not df.join(taken, F.col("id") == F.col("_t"), "left_semi").isEmpty():
        hit = df.join(taken, F.col("id") == F.col("_t"), "left")
        df = hit.withColumn("id", F.when(F.col("_t").isNotNull(), F.concat("_own", F.lit(f"_{n}"))).otherwise(F.col("id"))).drop("_t")
        n += 1
    return df.drop("_own")


RECORD_COLUMNS = ["id", "tokens", "ner_tags", "source"]


def with_chosen(df: DataFrame, seed: int) -> DataFrame:
    """``_chosen``: one to three of the transforms that apply (``_a``), at most one of the two case transforms, all drawn by hashes of the id."""
    number = lambda tag, at: F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:{tag}:"), "id"), 256), at, 8), 16, 10).cast("bigint")
    cases = F.filter("_a", lambda n: n.isin("lowercase", "reduce_capitalization"))
    case = F.get(cases, F.when(F.size(cases) > 0, (number("case", 1) % F.size(cases)).cast("int")))
    names = F.array_compact(F.concat(F.array_except("_a", cases), F.array(case)))
    drawn = F.array_sort(F.transform(names, lambda n: F.struct(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id"), F.lit(":"), n), 256).alias("r"), n.alias("n"))))
    count = (number("count", 1) % F.least(F.lit(3), F.size(names)) + 1).cast("int")
    return df.withColumn("_drawn", drawn).withColumn("_chosen", F.transform(F.slice("_drawn", 1, count), lambda x: x["n"])).drop("_drawn")


def augmented(df: DataFrame, seed: int, share: float = 3 / 7) -> tuple[DataFrame, dict]:
    """DRV2 / TOP5 / AGG26: the rows and safe variants of the first of them that allow a transform, and one row of statistics.

    As many variants as share of the rows, half to even, by places in stable rank; each
    has one to three transforms (see ``with_chosen``) in their fixed order and the id
    ``<id>__aug_<place>``. Rows that are augmented already, that are no strict BIO or
    share an id, and too few rows that allow a transform are errors. Nothing is sorted
    by one task. df has ``id, tokens, ner_tags, source`` and may have ``augmentation``.
    """
    if "augmentation" in df.columns:
        refuse(df.where("augmentation IS NOT NULL"), "a source record is already augmented")
    base = shared_table(df.select(*RECORD_COLUMNS), "source")
    _strict(base, "the source")
    n = base.count()
    wanted = round(n * share)
    viable = base.withColumn("_a", B.applicable(F.col("tokens"), F.col("ner_tags"))).where("size(_a) > 0").withColumn("_rank", K.stable_rank(F.col("id"), seed))
    pick = shared_table(K.placed(viable).where(F.col("_at") <= wanted).drop("_rank", "_all"), "picked")
    if pick.count() < wanted:
        raise ValueError(f"not enough source records that allow a transform: need {wanted}, found {pick.count()}")
    x = with_chosen(pick, seed).withColumn("_t", F.col("tokens")).withColumn("_g", F.col("ner_tags")).withColumn("_done", F.array().cast("array<string>"))
    for name, f in B.TRANSFORMS.items():
        t, g = f(F.col("_t"), F.col("_g"))
        x = x.withColumn("_r", F.when(F.array_contains("_chosen", name), F.struct(t.alias("t"), g.alias("g"))))
        new = F.col("_r").isNotNull() & ((F.col("_r.t") != F.col("_t")) | (F.col("_r.g") != F.col("_g")))
        x = x.withColumn("_done", F.when(new, F.concat("_done", F.array(F.lit(name)))).otherwise(F.col("_done")))
        x = x.withColumn("_t", F.coalesce("_r.t", "_t")).withColumn("_g", F.coalesce("_r.g", "_g"))
    x = x.select(F.concat("id", F.lit("__aug_"), F.lpad(F.col("_at").cast("string"), F.greatest(F.lit(4), F.length(F.col("_at").cast("string"))), F.lit("0"))).alias("id"), F.col("_t").alias("tokens"), F.col("_g").alias("ner_tags"), "source", F.col("id").alias("source_id"), F.col("_done").alias("transformations"))
    x = shared_table(_free_ids(x, base), "variants")
    refuse(x.where("size(transformations) = 0"), "a selected record did not change")
    _strict(x, "the variants")
    counts = {r[0]: r[1] for r in x.select(F.explode("transformations").alias("t")).groupBy("t").count().toLocalIterator()}
    stats = {
        "source_record_count": n, "requested_augmented_record_count": wanted, "augmented_record_count": wanted, "output_record_count": n + wanted, "seed": seed,
        "augmentation_to_source_ratio": round(wanted / n, 6) if n else 0.0, "augmentation_fraction_of_output": round(wanted / (n + wanted), 6) if n else 0.0,
        "transformation_counts": {name: counts.get(name, 0) for name in B.TRANSFORM_ORDER},
    }
    none = base.select(*RECORD_COLUMNS, F.lit(None).cast("string").alias("source_id"), F.array().cast("array<string>").alias("transformations"))
    return none.unionByName(x), stats


def speech_augmented(records: DataFrame, protected: DataFrame, seed: int, denied: tuple[str, ...] = DENIED) -> tuple[DataFrame, dict]:
    """DRV3 / AGG26: the records without protected texts, a spoken variant of each viable one, and authored sentences; and statistics.

    protected has ``tokens``. Records with a protected text are dropped; authored
    sentences that share an n-gram of three to five words with one are left out; any
    protected or denied text in the result is an error, as are tags that are no strict
    BIO and ids that occur twice. Variants are numbered by stable rank.
    """
    base = shared_table(records.select(*RECORD_COLUMNS), "source")
    _strict(base, "the source")
    fp = S.fingerprint(F.array_join("tokens", " "))
    guard = shared_table(protected.select(fp.alias("fp"), F.filter(F.split(S.full_text(F.array_join("tokens", " ")), " "), lambda w: w != "").alias("words")), "guard")
    fps = guard.select("fp").distinct()
    kept = shared_table(base.withColumn("fp", fp).join(fps, "fp", "left_anti").drop("fp"), "kept")
    viable = K.placed(kept.where(B.viable(F.col("ner_tags"))).withColumn("_rank", K.stable_rank(F.col("id"), seed)))
    spoken = B.with_speech_variant(viable, seed)
    number = F.col("_at").cast("string")
    spoken = spoken.select(F.concat("id", F.lit("__speech_"), F.lpad(number, F.greatest(F.lit(4), F.length(number)), F.lit("0"))).alias("id"), F.col("spoken_tokens").alias("tokens"), F.col("spoken_tags").alias("ner_tags"), "source", F.col("id").alias("source_id"), F.lit(None).cast("string").alias("template"))
    spoken = shared_table(_free_ids(spoken, base), "spoken")
    authored = TP.authored_templates(records.sparkSession, kept)
    authored = shared_table(authored.withColumn("words", S.augmentation_tokens(F.col("tokens"))), "authored")  # normal forms are written first: n-grams work inside arrays
    words = authored.select("id", "words")
    clash = shared_table(K.overlapping(words, guard), "clash")
    authored = authored.join(clash, "id", "left_anti").select(*RECORD_COLUMNS, F.lit(None).cast("string").alias("source_id"), "template")
    out = kept.select(*RECORD_COLUMNS, F.lit(None).cast("string").alias("source_id"), F.lit(None).cast("string").alias("template")).unionByName(spoken).unionByName(authored)
    out = shared_table(out, "speech")
    _strict(out, "the speech records")
    found = out.select(fp.alias("fp"))
    refuse(found.join(fps, "fp", "left_semi"), "a protected text is among the speech records")
    if denied:
        refuse(found.where(F.col("fp").isin(*denied)), "a denied text is among the speech records")
    n, k, v = base.count(), kept.count(), spoken.count()
    stats = {
        "source_record_count": n, "retained_source_record_count": k, "excluded_protected_source_record_count": n - k, "speech_variant_count": v, "output_record_count": out.count(),
        "excluded_protected_authored_template_count": clash.count(), "seed": seed, "template_counts": {r[0]: r[1] for r in out.where("template IS NOT NULL").groupBy("template").count().toLocalIterator()},
        "protected_overlap_count": 0, "denylisted_overlap_count": 0,
    }
    return out, stats


def imported_sentences(sentences: DataFrame, mode: str, origin: str, excluded: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """DRV4: sentences ``(sheet, sentence, tokens, source_tags)`` of a workbook as (records, rejected sentences by reason).

    Source tags are BIOES of another type set. In mode temporal only sentences with a
    TEMPORAL span stay, and those whose phrase key is in excluded (``phrase_key``, see
    ``read_excluded_phrases``) go.
    """
    if mode not in ("expert", "temporal"):
        raise ValueError("the mode is expert or temporal")
    x = sentences.withColumn("_b", B.bioes_to_bio(F.col("source_tags"))).withColumn("ner_tags", F.col("_b.tags"))
    reason = F.coalesce(F.when(F.size("tokens") != F.size("source_tags"), "length"), F.col("_b.reason"), B.bio_reason(F.col("tokens"), F.col("ner_tags")))
    if mode == "temporal":
        reason = F.coalesce(reason, F.when(~F.array_contains("ner_tags", "B-TEMPORAL"), "no TEMPORAL entity"))
        if excluded is not None:
            x = x.withColumn("phrase_key", S.phrase_key(F.col("tokens"))).join(excluded.select("phrase_key").distinct().withColumn("_x", F.lit(True)), "phrase_key", "left")
            reason = F.coalesce(reason, F.when(F.col("_x"), "excluded normalized duplicate"))
    x = x.withColumn("reason", reason)
    name = F.concat(F.lit(f"{origin}-{mode}:"), "sheet", F.lit(":"), "sentence")
    good = x.where("reason IS NULL").select(name.alias("id"), "tokens", "ner_tags", F.concat(F.lit(f"{origin}:"), "sheet").alias("source"))
    return good, x.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


def year_records(mined: DataFrame, dataset: str, revision: str) -> DataFrame:
    """DRV5: the best phrases of a corpus (see ``best_per_phrase``) as TEMPORAL records with a digest id."""
    tags = F.transform("phrase", lambda t, i: F.when(i == 0, "B-TEMPORAL").otherwise("I-TEMPORAL"))
    how = F.when(F.col("form") != "observed_spoken", F.struct(F.col("year").cast("string").alias("source_text_form"), F.col("form").alias("transformation")))
    return mined.select(F.concat(F.lit(f"speech-year:{dataset}:"), F.substring(F.sha2("phrase_key", 256), 1, 16)).alias("id"), F.col("phrase").alias("tokens"), tags.alias("ner_tags"), F.lit(f"hf:{dataset}@{revision}").alias("source"), how.alias("augmentation"))


def merged_years(records: DataFrame, dataset: str, revision: str) -> DataFrame:
    """DRV6: year records of several shards as one per phrase, spoken ones first; a record that is not what ``year_records`` makes fails the job.

    Checked are strict BIO, the source, the year suffix and that the words still parse
    as a year. One aggregate per phrase, combined before the shuffle.
    """
    keys = S.word_keys(S.nfkc_all(F.col("tokens")))
    x = records.withColumn("_k", keys).withColumn("_n", F.size("tokens"))
    last = F.get("_k", F.col("_n") - 1)
    year = spoken_year(F.slice("_k", 1, F.greatest(F.col("_n") - 1, F.lit(0))))
    form = F.when(F.col("augmentation").isNull(), "observed_spoken").otherwise(F.col("augmentation.transformation"))
    wrong = (
        F.when(B.bio_reason(F.col("tokens"), F.col("ner_tags")).isNotNull(), "tags that are no BIO").when(~F.col("source").eqNullSafe(F.lit(f"hf:{dataset}@{revision}")), "another source")
        .when((F.col("_n") < 2) | ~F.coalesce(last.isin(*L.YEAR_SUFFIXES), F.lit(False)), "no year suffix").when(year.isNull(), "no calendar year").when(~F.coalesce(form.isin("observed_spoken", "digit_calendar_year_to_spoken"), F.lit(False)), "unknown transformation")
    )
    x = x.withColumn("year", F.when(wrong.isNotNull(), F.raise_error(F.concat(F.lit("shard record with "), wrong)).cast("int")).otherwise(year))
    x = x.select(F.array_join("_k", " ").alias("phrase_key"), F.when(form == "observed_spoken", 0).otherwise(1).alias("o"), "id", "tokens", "ner_tags", "source", "augmentation", "year", last.alias("suffix"), form.alias("form"))
    best = x.groupBy("phrase_key").agg(F.min(F.struct("o", "id", "tokens", "ner_tags", "source", "augmentation", "year", "suffix", "form")).alias("b"))
    return best.select("phrase_key", "b.*").drop("o")


def year_statistics(merged: DataFrame) -> DataFrame:
    """AGG7: ``(what, value, n)``: records, those with a connector, and counts by suffix, form and year."""
    has_va = F.array_contains(F.split("phrase_key", " "), "va")
    long = F.array(*[F.struct(F.lit(w).alias("what"), v.alias("value")) for w, v in (("accepted", F.lit("all")), ("connector", F.when(has_va, "va")), ("suffix", F.col("suffix")), ("transformation", F.col("form")), ("year", F.col("year").cast("string")))])
    return merged.select(F.explode(long).alias("x")).where("x.value IS NOT NULL").groupBy("x.what", "x.value").agg(F.count("*").alias("n"))


def overflow_chunks(df: DataFrame, key: str, units: str, most: int) -> DataFrame:
    """UDF1: ``(key, chunk, first, units)``: arrays of more than most units as windows that overlap by a quarter of most, at least one unit."""
    if most < 2:
        raise ValueError("a chunk holds at least two units")
    step = most - min(max(1, most // 4), most - 1)
    n = F.size(units)
    starts = F.when(n <= most, F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.ceil((n - most) / step).cast("int")), lambda i: i * step))
    x = df.select(key, units, F.posexplode(starts).alias("chunk", "first"))
    return x.select(key, "chunk", "first", F.slice(units, F.col("first") + 1, F.lit(most)).alias("units"))


def best_units(predictions: DataFrame, key: str) -> DataFrame:
    """AGG10: of the predictions ``(key, first, i, label, score)`` of overlapping chunks the likeliest per unit, the earlier chunk on a tie."""
    best = F.min_by(F.struct("label", "score"), F.struct(-F.col("score"), F.col("first")))
    return predictions.groupBy(key, (F.col("first") + F.col("i")).alias("unit")).agg(best.alias("b")).select(key, "unit", "b.label", "b.score")


def training_mix(
    base: DataFrame, expert: DataFrame, temporal: DataFrame, speech: DataFrame, protected: DataFrame, seed: int, caps: dict[str, int], factors: dict[str, int], dev_fraction: float,
    denied: tuple[str, ...] = DENIED, hard: dict[str, tuple[list[str], int]] = HARD,
) -> dict[str, DataFrame]:
    """DRV7 / SET1: base and deduplicated, sampled, upsampled additions; a held-out speech part; exclusions by reason.

    Inputs have ``id, tokens, ner_tags, source``. Ids of the parts get the part's
    name as prefix, so copies of one row by two boosts cannot meet. A base row with a
    protected or denied text is an error. Expert rows that are not sampled do not
    count as seen for later sources; temporal rows do.
    """
    fp = lambda df: df.select(S.fingerprint(F.array_join("tokens", " ")).alias("fp"))
    # each source is filtered once: later parts read what was accepted, not the plans behind it
    guard = shared_table(fp(protected).distinct(), "guard")
    base = shared_table(base.select("id", "tokens", "ner_tags", "source"), "base")
    seen = shared_table(fp(base).distinct(), "seen")
    denied = list(denied)
    if not seen.join(guard, "fp", "left_semi").isEmpty():
        raise ValueError("the base holds a protected text")
    if denied and not seen.where(F.col("fp").isin(denied)).isEmpty():
        raise ValueError("the base holds a text of the denylist")
    filtered = lambda df, seen, name: shared_table(K.filter_additions(df.select("id", "tokens", "ner_tags", "source"), seen, guard, denied), name)
    e = filtered(expert, seen, "expert")
    wanted = F.size(F.array_intersect(B.entity_types(F.col("ner_tags")), F.array(*map(F.lit, ["PER", "ORG", "LOC", "TEMPORAL"])))) > 0
    chosen = K.upsampled(K.stable_sample_preferring(e.where("reason IS NULL").select("id", "tokens", "ner_tags", "source"), caps["expert"], seed, wanted), factors)
    chosen = shared_table(chosen, "chosen")
    seen = seen.unionByName(fp(chosen))
    t = filtered(temporal, seen, "temporal")
    accepted = t.where("reason IS NULL").select("id", "tokens", "ner_tags", "source")
    timed = K.stable_sample(accepted, caps["temporal"], seed + 1)
    s = filtered(speech, seen.unionByName(fp(accepted)), "speech")
    parts = shared_table(K.held_out(s.where("reason IS NULL").select("id", "tokens", "ner_tags", "source"), dev_fraction, seed + 2), "parts")
    train = K.stable_sample(parts.where("part = 'train'").drop("part"), caps["speech"], seed + 3)
    copies = lambda df, label, factor: K.upsampled(df, {label: factor}).where(F.col("id").contains("::up"))
    boost = copies(base.where(F.array_contains(B.entity_types(F.col("ner_tags")), "LOC")), "LOC", factors.get("LOC", 1))
    tag = lambda df, name: df.select(F.concat(F.lit(f"{name}/"), "id").alias("id"), "tokens", "ner_tags", "source", F.lit(name).alias("part"))
    out = tag(base, "base").unionByName(tag(chosen, "expert")).unionByName(tag(timed, "temporal")).unionByName(tag(train, "speech")).unionByName(tag(boost, "base_loc"))
    for label, (markers, factor) in hard.items():
        surface = F.transform(S.nfkc_all(F.col("tokens")), lambda x: S.delete(F.lower(x), S.ASCII_APOSTROPHES))
        marked = base.withColumn("_t", surface).where((F.size("tokens") == F.size("ner_tags")) & B.has_marked(F.col("_t"), F.col("ner_tags"), label, markers)).drop("_t")
        out = out.unionByName(tag(copies(marked, label, factor), f"hard_{label.lower()}"))
    reasons = [x.select(F.lit(name).alias("part"), "reason") for name, x in (("expert", e), ("temporal", t), ("speech", s))]
    why = reasons[0].unionByName(reasons[1]).unionByName(reasons[2]).where("reason IS NOT NULL").groupBy("part", "reason").agg(F.count("*").alias("n"))
    return {"train": out, "dev": tag(parts.where("part = 'dev'"), "speech_dev"), "exclusions": why}
