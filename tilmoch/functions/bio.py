"""BIO tag sequences: validation, conversion and token transforms, as array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilmoch.functions import lexicon as L
from tilmoch.functions import text as S
from tilmoch.functions.numbers import year_words

TRANSFORM_ORDER = ["lowercase", "remove_punctuation", "apostrophe_representation", "reduce_capitalization", "hyphen_spacing", "colon_spacing"]
EDGE_PUNCTUATION = r"^[.,!?;…]*\z"
SPOKEN_PUNCTUATION = r"^[.,!?;:…()\[\]{}\"“”‘’]+\z"
SPEECH_FILLERS = ["am", "um", "ee"]

Pair = tuple[Column, Column]


def shifted(tags: Column) -> Column:
    """Each tag's predecessor, ``O`` before the first."""
    return F.concat(F.array(F.lit("O")), F.slice(tags, 1, F.greatest(F.size(tags) - 1, F.lit(0))))


def tag_type(tag: Column) -> Column:
    return F.when(F.instr(tag, "-") > 0, F.substring_index(tag, "-", -1))


def bio_reason(tokens: Column, tags: Column) -> Column:
    """VAL1: why a sequence is no strict BIO; null if it is. Nothing is repaired."""
    known = F.array(*map(F.lit, L.BIO_LABELS))
    orphan = F.exists(F.zip_with(tags, shifted(tags), lambda t, p: t.startswith("I-") & ~((F.substring(p, 3, 100) == F.substring(t, 3, 100)) & (p != "O"))), lambda b: b)
    return (
        F.when(tokens.isNull() | tags.isNull() | (F.size(tokens) == 0), "empty")
        .when(F.size(tokens) != F.size(tags), "length")
        .when(F.exists(tags, lambda t: t.isNull() | ~F.array_contains(known, F.coalesce(t, F.lit("?")))), "label")
        .when(orphan, "orphan")
    )


def bioes_to_bio(tags: Column) -> Column:
    """ARR1: ``(tags, reason)`` of BIOES tags of other type sets as BIO; types without a counterpart become O, a bad sentence is rejected whole."""
    types, stripped = F.create_map(*[F.lit(v) for kv in L.TYPE_MAP.items() for v in kv]), F.array(*map(F.lit, L.STRIPPED_TYPES))
    clean = F.transform(tags, lambda t: F.upper(S.squeeze(t)))
    prefix = lambda t: F.when(t == "O", "O").otherwise(F.substring_index(t, "-", 1))
    kind = lambda t: F.when(t == "O", None).otherwise(F.regexp_extract(t, "^[^-]*-(.*)$", 1))
    malformed = F.exists(clean, lambda t: t.isNull() | ((t != "O") & ~t.rlike("^[BIES]-.+$")))
    unknown = F.exists(clean, lambda t: (t != "O") & types[kind(t)].isNull() & ~F.array_contains(stripped, kind(t)))
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("active"), F.lit(False).alias("bad"), F.lit(False).alias("closed"))

    def step(s: Column, t: Column) -> Column:
        p, k = prefix(t), F.coalesce(types[kind(t)], F.lit(""))
        off = (p == "O") | (k == "")
        inner = p.isin("I", "E")
        tag = F.when(off, "O").when(p.isin("S", "B"), F.concat(F.lit("B-"), k)).otherwise(F.concat(F.lit("I-"), k))
        active = F.when(off | p.isin("S", "E"), "").otherwise(k)
        return F.struct(F.concat(s["out"], F.array(tag)).alias("out"), active.alias("active"), (s["bad"] | (~off & inner & (s["active"] != k))).alias("bad"), (s["closed"] | p.isin("S", "E")).alias("closed"))

    done = F.aggregate(clean, zero, step)
    reason = F.when(malformed, "malformed").when(unknown, "unsupported").when(done["bad"], "orphan").when((done["active"] != "") & done["closed"], "unterminated")
    return F.struct(F.when(reason.isNull(), done["out"]).alias("tags"), reason.alias("reason"))


def lowercase(tokens: Column, tags: Column) -> Pair:
    """ARR2."""
    return F.transform(tokens, F.lower), tags


def remove_punctuation(tokens: Column, tags: Column) -> Pair:
    """ARR3: without O tokens of punctuation at either end; a sequence of nothing else stays."""
    idx = F.filter(F.transform(S.zip2(tokens, tags), lambda p, i: F.when((p["1"] == "O") & p["0"].rlike(EDGE_PUNCTUATION), None).otherwise(i + 1)), lambda x: x.isNotNull())
    lo, hi = F.array_min(idx), F.array_max(idx)
    cut = lambda a: F.when(lo.isNull(), a).otherwise(F.slice(a, F.coalesce(lo, F.lit(1)), F.coalesce(hi - lo + 1, F.lit(0))))
    return cut(tokens), cut(tags)


def apostrophes(tokens: Column, tags: Column) -> Pair:
    """ARR4: inner apostrophes change sides, ASCII to ʻ and the others to ASCII."""
    inner = lambda chars: rf"(?<=[\p{{L}}\p{{N}}])[{chars}](?=[\p{{L}}\p{{N}}])"
    hold = "\u0001"  # ʻ and ʼ are letters: what was ASCII waits under a mark until the others are done
    flip = lambda t: F.replace(F.regexp_replace(F.regexp_replace(t, inner("'"), hold), rf"(?<=[\p{{L}}\p{{N}}])[’ʻʼ‘`](?=[\p{{L}}\p{{N}}])", "'"), F.lit(hold), F.lit("ʻ"))
    return F.transform(tokens, flip), tags


def reduce_capitals(tokens: Column, tags: Column) -> Pair:
    """ARR5: only entity tokens in lower case."""
    return F.zip_with(tokens, tags, lambda t, g: F.when(g != "O", F.lower(t)).otherwise(t)), tags


def _spread(tag: Column, n: Column) -> Column:
    """A tag over n tokens: the first keeps it, the rest continue it."""
    rest = F.when(tag.startswith("B-"), F.concat(F.lit("I-"), F.substring(tag, 3, 100))).otherwise(tag)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.when(i == 1, tag).otherwise(rest))


def _resplit(tokens: Column, tags: Column, parts: Column) -> Pair:
    """Replace each token by its parts, tags spread over them; a token without parts goes."""
    pairs = F.zip_with(parts, tags, lambda p, g: F.struct(p.alias("p"), g.alias("g")))
    pairs = F.filter(pairs, lambda x: F.size(x["p"]) > 0)
    return F.flatten(F.transform(pairs, lambda x: x["p"])), F.flatten(F.transform(pairs, lambda x: _spread(x["g"], F.size(x["p"]))))


def hyphen_spacing(tokens: Column, tags: Column) -> Pair:
    """ARR6: tokens with a digit are split at inner hyphens, and O hyphens go."""
    cut = lambda t: F.when(t.rlike(r"\d"), F.split(t, r"(?<=[\p{L}\p{N}])-(?=[\p{L}\p{N}])")).otherwise(F.array(t))
    parts = F.zip_with(tokens, tags, lambda t, g: F.when((t == "-") & (g == "O"), F.array().cast("array<string>")).otherwise(cut(t)))
    return _resplit(tokens, tags, parts)


def colon_spacing(tokens: Column, tags: Column) -> Pair:
    """ARR7: clocks are split, the colon a token of its own."""
    parts = F.transform(tokens, lambda t: F.split(t, r"(?<=\d)(?=:\d)|(?<=\d:)(?=\d)"))
    return _resplit(tokens, tags, parts)


TRANSFORMS = dict(zip(TRANSFORM_ORDER, (lowercase, remove_punctuation, apostrophes, reduce_capitals, hyphen_spacing, colon_spacing)))


def apply_transforms(tokens: Column, tags: Column, names: list[str]) -> Column:
    """ARR8: ``(tokens, tags, applied)`` after the named transforms in their fixed order; applied are those that changed something."""
    wanted = set(names)
    if wanted - set(TRANSFORM_ORDER):
        raise ValueError(f"unknown transforms {sorted(wanted - set(TRANSFORM_ORDER))}")
    if {"lowercase", "reduce_capitalization"} <= wanted:
        raise ValueError("lowercase and reduce_capitalization exclude each other")
    applied = []
    for name in TRANSFORM_ORDER:
        if name in wanted:
            new_tokens, new_tags = TRANSFORMS[name](tokens, tags)
            applied.append(F.when((new_tokens != tokens) | (new_tags != tags), F.lit(name)))
            tokens, tags = new_tokens, new_tags
    return F.struct(tokens.alias("tokens"), tags.alias("tags"), F.array_compact(F.array(*applied)).alias("applied"))


def applicable(tokens: Column, tags: Column) -> Column:
    """ARR9: names of the transforms that would change a record, in order."""
    out = []
    for name, f in TRANSFORMS.items():
        t, g = f(tokens, tags)
        out.append(F.when((t != tokens) | (g != tags), F.lit(name)))
    return F.array_compact(F.array(*out))


def ordinal_day_words(day: Column) -> Column:
    """Spoken ordinal words of a day from 1 to 31."""
    units = F.array(*map(F.lit, ["birinchi", "ikkinchi", "uchinchi", "toʻrtinchi", "beshinchi", "oltinchi", "yettinchi", "sakkizinchi", "toʻqqizinchi"]))
    full = F.array(*map(F.lit, ["oʻninchi", "yigirmanchi", "oʻttizinchi"]))
    tens = F.array(*map(F.lit, L.SPOKEN_TENS))
    te, un = F.floor(day / 10).cast("int"), (day % 10).cast("int")
    return F.array_compact(F.when(un == 0, F.array(F.get(full, te - 1))).otherwise(F.array(F.get(tens, te - 1), F.get(units, un - 1))))


def with_spoken_temporal(df: DataFrame, tokens: str, tags: str, out_tokens: str, out_tags: str) -> DataFrame:
    """ARR10: TEMPORAL day-months and years 2000 to 2030 in words, the other tokens normalised.

    A token at the start of a TEMPORAL span may take the next one with it; that one
    is then dropped, since it continues the span. Each step is a column of its own,
    so that no array is computed twice.
    """
    df = df.withColumn("_norm", S.augmentation_tokens(F.col(tokens)))
    n = F.size("_norm")
    rest = lambda a: F.concat(F.slice(a, 2, F.greatest(n - 1, F.lit(0))), F.array(F.lit("")))
    df = df.withColumn("_rows", S.zip2(S.zip2(F.col("_norm"), F.col(tags)), S.zip2(rest(F.col("_norm")), rest(F.col(tags)))))
    months = F.array(*map(F.lit, L.PLAIN_MONTHS))

    def read(r: Column) -> Column:
        t, nt = r["0"]["0"], r["1"]["0"]
        return F.struct(
            t.alias("t"), nt.alias("nt"), r["0"]["1"].alias("g"), (r["0"]["1"] == "B-TEMPORAL").alias("starts"), (r["1"]["1"] == "I-TEMPORAL").alias("pair"),
            F.regexp_extract(t, r"^(\d{1,2})-", 1).try_cast("int").alias("day"), F.regexp_extract(t, r"^\d{1,2}-(.*)$", 1).alias("month"),
            F.when(t.rlike(r"^\d{1,4}\z"), t.try_cast("int")).alias("alone"), F.regexp_extract(t, r"^(\d{1,4})-yil\z", 1).try_cast("int").alias("year"),
        )

    def speak(r: Column) -> Column:
        year_of = lambda y: F.when(y.between(2000, 2030), year_words(y))
        say = lambda w, last, used: F.struct(F.concat(w, F.array(last)).alias("w"), F.lit(used).alias("used"), r["g"].alias("g"))
        return (
            F.when(~r["starts"], F.struct(F.array(r["t"]).alias("w"), F.lit(0).alias("used"), r["g"].alias("g")))
            .when(r["day"].between(1, 31) & F.array_contains(months, r["month"]), say(ordinal_day_words(r["day"]), r["month"], 1))
            .when(r["alone"].between(1, 31) & r["pair"] & F.array_contains(months, r["nt"]), say(ordinal_day_words(r["alone"]), r["nt"], 2))
            .when(r["year"].between(2000, 2030), say(year_of(r["year"]), F.lit("yil"), 1))
            .when(r["t"].rlike(r"^\d+-yil\z"), F.struct(F.array(F.lit("yil")).alias("w"), F.lit(1).alias("used"), r["g"].alias("g")))
            .when(r["pair"] & r["nt"].isin("yil", "yili", "yilda") & r["alone"].between(2000, 2030), say(year_of(r["alone"]), F.lit("yil"), 2))
            .otherwise(F.struct(F.array(r["t"]).alias("w"), F.lit(0).alias("used"), r["g"].alias("g")))
        )

    df = df.withColumn("_read", F.transform("_rows", read)).withColumn("_said", F.transform("_read", speak))
    df = df.withColumn("_kept", F.filter("_said", lambda s, i: (i == 0) | (F.get("_said", F.greatest(i - 1, F.lit(0)))["used"] != 2)))
    df = df.withColumn(out_tokens, F.flatten(F.transform("_kept", lambda s: s["w"]))).withColumn(out_tags, F.flatten(F.transform("_kept", lambda s: _spread(s["g"], F.size(s["w"])))))
    return df.drop("_norm", "_rows", "_read", "_said", "_kept")


def with_speech_variant(df: DataFrame, seed: int, key: str = "id", tokens: str = "tokens", tags: str = "ner_tags") -> DataFrame:
    """ARR11: ``spoken_tokens, spoken_tags``: no O punctuation, ARR10, and one filler whose word and place follow from a hash of the id."""
    df = df.withColumn("_pairs", F.filter(S.zip2(F.col(tokens), F.col(tags)), lambda p: ~((p["1"] == "O") & p["0"].rlike(SPOKEN_PUNCTUATION))))
    df = df.withColumn("_t0", F.transform("_pairs", lambda p: p["0"])).withColumn("_g0", F.transform("_pairs", lambda p: p["1"]))
    df = with_spoken_temporal(df, "_t0", "_g0", "_t1", "_g1")
    df = df.withColumn("_spots", F.filter(F.transform(S.zip2(F.col("_t1"), F.col("_g1")), lambda p, i: F.when((p["1"] == "O") & p["0"].rlike(r"^[\p{L}\p{N}]+\z"), i + 2)), lambda i: i.isNotNull()))
    df = df.withColumn("_digest", F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key), 256), 1, 8), 16, 10).cast("bigint"))
    df = df.withColumn("_spot", F.get("_spots", F.when(F.size("_spots") > 0, (F.col("_digest") % F.size("_spots")).cast("int"))))
    word = F.get(F.array(*map(F.lit, SPEECH_FILLERS)), (F.col("_digest") % 3).cast("int"))
    at = F.coalesce(F.col("_spot"), F.lit(1))
    put = lambda a, v: F.when(F.col("_spot").isNull(), F.col(a)).otherwise(F.concat(F.slice(a, 1, at - 1), F.array(v), F.slice(a, at, F.greatest(F.size(a) - at + 1, F.lit(0)))))
    df = df.withColumn("spoken_tokens", put("_t1", word)).withColumn("spoken_tags", put("_g1", F.lit("O")))
    return df.drop("_pairs", "_t0", "_g0", "_t1", "_g1", "_spots", "_digest", "_spot")


def ngrams(words: Column, low: int = 3, high: int = 5) -> Column:
    """ARR12: the distinct n-grams of low to high words, joined with blanks."""
    n = F.size(words)
    of = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, F.lit(k)), " "))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[of(k) for k in range(low, high + 1)]))


def entity_types(tags: Column) -> Column:
    """ARR14: the sorted distinct types of a record."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(tags, lambda t: t.startswith("B-") | t.startswith("I-")), lambda t: F.substring(t, 3, 100))))


def has_marked(tokens: Column, tags: Column, label: str, markers: list[str]) -> Column:
    """ARR15: a token of the label holds one of the markers."""
    found = lambda t: F.lower(t).rlike("|".join(markers))
    return F.exists(S.zip2(tokens, tags), lambda p: p["1"].endswith(f"-{label}") & found(p["0"]))


def viable(tags: Column) -> Column:
    """ARR16: a record with a person, place, organization or time."""
    return F.exists(tags, lambda t: t.rlike("-(PER|LOC|ORG|TEMPORAL)$"))


def spans_of(tags: Column) -> Column:
    """WIN4: ``(type, first, last)`` of each BIO run, as an array; an I without a run before it opens one."""
    zero = F.array().cast("array<struct<type:string,first:int,last:int>>")
    rows = F.transform(tags, lambda t, i: F.struct(F.when(t == "O", None).otherwise(F.substring(t, 3, 100)).alias("k"), t.startswith("B-").alias("b"), i.alias("i")))

    def step(acc: Column, r: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        grows = ~r["b"] & (last["type"] == r["k"]) & (last["last"] == r["i"] - 1)
        one = F.struct(r["k"].alias("type"), F.when(grows, last["first"]).otherwise(r["i"]).alias("first"), r["i"].alias("last"))
        kept = F.when(grows, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc)
        return F.when(r["k"].isNull(), acc).otherwise(F.concat(kept, F.array(one))).cast("array<struct<type:string,first:int,last:int>>")

    return F.aggregate(rows, zero, step)


def occurrences(haystack: Column, phrase: Column) -> Column:
    """ARR21: how often a word sequence occurs in another, overlaps included."""
    n, k = F.size(haystack), F.size(phrase)
    return F.when((k > 0) & (n >= k), F.size(F.filter(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.slice(haystack, i, F.greatest(k, F.lit(1))) == phrase))).otherwise(0)


def align_labels(word_ids: Column, tags: Column) -> Column:
    """ARR17: label ids of subwords: the first of each word has its word's label, all others and special ones -100."""
    ids = F.create_map(*[F.lit(v) for i, name in enumerate(L.BIO_LABELS) for v in (name, i)])
    prev = F.concat(F.array(F.lit(None).cast("int")), F.slice(word_ids, 1, F.greatest(F.size(word_ids) - 1, F.lit(0))))
    return F.zip_with(word_ids, prev, lambda w, p: F.when(w.isNull() | w.eqNullSafe(p), -100).otherwise(F.coalesce(ids[F.get(tags, w)], F.lit(-100))))
