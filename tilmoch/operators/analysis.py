"""The analysis view of a transcript: a model-facing text aligned with the displayed one, and spans projected back.

The view is columns: replacements are candidate structs over unit indexes, a greedy
fold keeps those that do not overlap, and rendered pieces carry both offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilmoch.functions import lexicon as L
from tilmoch.functions import text as S
from tilmoch.functions.numbers import lookup, year_value
from tilmoch.operators.spans import _at, _in, _phrases, candidate, greedy, head_label, phrase_head_candidates

# Kinds of replacement by falling priority (both case kinds rank alike), and what takes no blank before it.
PRIORITY = {"person_phrase": 0, "person_name": 1, "organization_case": 2, "location_case": 2, "temporal_itn": 3, "filler_comma": 4}
TIGHT = list(",.;:!?%…)]}»")

REPL = "array<struct<p:int,start:int,neg:int,end:int,text:string,kind:string,confidence:double,source_start:int,source_end:int>>"
PIECE = "array<struct<text:string,analysis_start:int,analysis_end:int,source_start:int,source_end:int,kind:string,confidence:double,hard:boolean>>"


def _repl(kind: str | Column, first: Column, stop: Column, text: Column, confidence: Column | float, s: Column | None, e: Column | None) -> Column:
    """A replacement of the units first to stop - 1; without source offsets it is a hard boundary."""
    none = F.lit(None).cast("int")
    k = F.lit(kind) if isinstance(kind, str) else kind
    c = F.lit(confidence) if isinstance(confidence, float) else confidence
    rank = F.create_map(*[F.lit(v) for kv in PRIORITY.items() for v in kv])[k]
    return F.struct(rank.alias("p"), first.alias("start"), (first - stop).alias("neg"), stop.alias("end"), text.alias("text"), k.alias("kind"), c.cast("double").alias("confidence"), (none if s is None else s).alias("source_start"), (none if e is None else e).alias("source_end"))


def _each(units: Column, f) -> Column:  # noqa: ANN001
    return F.array_compact(F.transform(units, f)).cast(REPL)


def reviewed_name(key: Column) -> Column:
    """``(d, c)`` of the single nearest reviewed name within the allowed edits; null otherwise."""
    rejected = L.folded([*L.GREETINGS, *L.PERSON_REJECT, *L.ORGANIZATION_HEADS, *L.LOCATION_HEADS, *L.MONTHS, *L.WEEKDAYS, *L.RELATIVE_DATES, *L.RELATIVE_MODIFIERS, *L.PERIODS])
    near = F.array_sort(F.array(*[F.struct(F.levenshtein(key, F.lit(L.fold(n))).alias("d"), F.lit(n).alias("c")) for n in L.PERSON_NAMES]))
    best, second = F.get(near, F.lit(0)), F.get(near, F.lit(1))
    return F.when(~key.isin(*rejected) & (best["d"] <= S.most_edits(key)) & (best["d"] < second["d"]), best)


def temporal_replacements(units: Column) -> Column:
    """SPN15: ordinal and month, clock with a cardinal up to 24, and exact year phrases before ``yil``."""
    ordinals, cardinals = lookup(L.ORDINALS), lookup(L.CARDINALS)

    def day(u: Column, i: Column) -> Column:
        m, n = _at(units, i + 1), ordinals[u["key"]]
        return F.when(n.between(1, 31) & _in(m["key"], L.MONTHS), _repl("temporal_itn", i, i + 2, F.concat(n.cast("string"), F.lit("-"), m["key"]), 1.0, u["start"], m["end"]))

    def clock(u: Column, i: Column) -> Column:
        v = _at(units, i + 1)
        bare, cut = cardinals[v["key"]], cardinals[F.regexp_replace(v["key"], "(ida|da|ta)$", "")]
        n = F.coalesce(bare, cut)
        locative = F.when(bare.isNotNull(), u["key"] == "soatda").otherwise(F.lit(True))
        text = F.concat(F.lit("soat "), n.cast("string"), F.when(locative, " da").otherwise(""))
        return F.when(_in(u["key"], L.TIME_MARKERS) & n.between(1, 24), _repl("temporal_itn", i, i + 2, text, 1.0, u["start"], v["end"]))

    def year(u: Column, i: Column) -> Column:
        keys = F.transform(units, lambda x: x["key"])
        widths = F.filter(F.sequence(F.least(i, F.lit(7)), F.lit(2), F.lit(-1)), lambda w: year_value(F.slice(keys, i - w + 1, w)).isNotNull())
        w = F.get(widths, F.lit(0))
        text = F.concat(year_value(F.slice(keys, i - w + 1, w)).cast("string"), F.lit("-yil"))
        return F.when((u["key"] == "yil") & (i >= 2), F.when(w.isNotNull(), _repl("temporal_itn", i - w, i + 1, text, 1.0, _at(units, i - w)["start"], u["end"])))

    return F.concat(_each(units, day), _each(units, clock), _each(units, year))


def person_replacements(units: Column) -> Column:
    """SPN16: reviewed phrases; a surname, an exact name and a filler; a name in an introduction or relation."""
    word = lambda u: u["text"].rlike(r"^[\p{L}\p{N}_]")
    keys = F.transform(units, lambda u: u["key"])
    out = []
    for words, canonical in zip(_phrases(), L.PERSON_PHRASES):
        k, phrase = len(words), F.array(*map(F.lit, words))
        out.append(_phrase(units, keys, phrase, k, canonical))

    def surname(u: Column, i: Column) -> Column:
        given, filler = _at(units, i + 1), _at(units, i + 2)
        name = reviewed_name(given["key"])
        ok = S.surname_like(u["key"]) & _in(filler["key"], L.FILLERS) & (name["d"] == 0)
        return F.when(ok, _repl("person_name", i, i + 1, S.upper_first(u["text"]), 0.95, u["start"], u["end"]))

    def given(u: Column, i: Column) -> Column:
        before, filler = F.when(i > 0, _at(units, F.greatest(i - 1, F.lit(0)))), _at(units, i + 1)
        name = reviewed_name(u["key"])
        ok = S.surname_like(before["key"]) & _in(filler["key"], L.FILLERS) & (name["d"] == 0)
        return F.when(ok, _repl("person_name", i, i + 1, name["c"], 1.0, u["start"], u["end"]))

    def context(u: Column, i: Column) -> Column:
        one, two = F.when(i > 0, _at(units, F.greatest(i - 1, F.lit(0)))), F.when(i > 1, _at(units, F.greatest(i - 2, F.lit(0))))
        intro = F.coalesce((one["key"] == "ismim") & (two.isNull() | two["key"].isin("men", "mening")), F.lit(False))
        relation = F.coalesce((_at(units, i + 1)["key"] == "bilan") & F.exists(F.slice(units, i + 3, F.lit(6)), lambda v: _in(v["key"], L.SOCIAL_VERBS)), F.lit(False))
        name = reviewed_name(u["key"])
        ok = word(u) & (intro | relation) & name.isNotNull() & (~relation | (name["d"] == 0))
        confidence = F.when(name["d"] == 0, 1.0).otherwise(F.greatest(F.lit(0.5), 1 - name["d"] / F.length(u["key"])))
        return F.when(ok, _repl("person_name", i, i + 1, name["c"], confidence, u["start"], u["end"]))

    return F.concat(*out, _each(units, surname), _each(units, given), _each(units, context))


def _phrase(units: Column, keys: Column, phrase: Column, k: int, canonical: str) -> Column:
    def one(u: Column, i: Column) -> Column:
        return F.when(F.slice(keys, i + 1, F.lit(k)) == phrase, _repl("person_phrase", i, i + k, F.lit(canonical), 1.0, u["start"], _at(units, i + k - 1)["end"]))

    return _each(units, one)


def head_replacements(units: Column, tokens: Column) -> Column:
    """SPN17: one or two words before a semantic head get a capital; nothing else changes."""
    blockers = [*L.BOUNDARY_STOPWORDS, "nomidagi", *L.MONTHS, *L.WEEKDAYS, *L.RELATIVE_DATES, *L.RELATIVE_MODIFIERS, *L.PERIODS]
    starts = F.transform(units, lambda u: u["start"])

    def one(h: Column, i: Column) -> Column:
        label = head_label(h["key"])
        prior, earlier = F.when(i > 0, _at(tokens, F.greatest(i - 1, F.lit(0)))), F.when(i > 1, _at(tokens, F.greatest(i - 2, F.lit(0))))
        ok = label.isNotNull() & ~h["boundary_before"] & ~_in(prior["key"], blockers) & S.name_word(prior["key"])
        named = (label == "LOC") & reviewed_name(prior["key"]).isNotNull() & ~_in(earlier["key"], blockers) & S.name_word(earlier["key"])
        two = F.coalesce(earlier.isNotNull() & (_in(earlier["key"], L.SAFE_MODIFIERS) | named) & ~prior["boundary_before"], F.lit(False))
        s = F.when(two, earlier["start"]).otherwise(prior["start"])
        text = F.concat(F.when(two, F.concat(S.upper_first(earlier["text"]), F.lit(" "))).otherwise(""), S.upper_first(prior["text"]), F.lit(" "), h["text"])
        first, last = F.array_position(starts, s).cast("int") - 1, F.array_position(starts, h["start"]).cast("int")
        return F.when(ok & (first >= 0) & (last > 0), _repl(F.when(label == "ORG", "organization_case").otherwise("location_case"), first, last, text, 0.95, s, h["end"]))

    return _each(tokens, one)


def filler_replacements(units: Column) -> Column:
    """SPN18: fillers become a comma that no span may cross."""
    return _each(units, lambda u, i: F.when(_in(u["key"], L.FILLERS), _repl("filler_comma", i, i + 1, F.lit(","), 1.0, None, None)))


def with_view(df: DataFrame, text: str, out: str = "view") -> DataFrame:
    """SPN14: ``view (analysis_text, pieces)`` of a display text.

    Replacements are taken by priority, place and length without overlaps. Pieces
    are joined with single blanks, none before closing punctuation, and carry their
    place in the analysis text and in the display text.
    """
    df = df.withColumn("_vw_u", F.transform(S.lexical_units(F.col(text)), lambda u: F.struct(u["text"].alias("text"), u["start"].alias("start"), u["end"].alias("end"), S.plain_comparison_key(u["text"]).alias("key"))))
    df = df.withColumn("_vw_tk", S.word_tokens(F.col(text)))
    u = F.col("_vw_u")
    df = df.withColumn("_vw_r", F.array_sort(F.concat(person_replacements(u), head_replacements(u, F.col("_vw_tk")), temporal_replacements(u), filler_replacements(u))))
    df = df.withColumn("_vw_taken", greedy(F.col("_vw_r"), REPL))
    identity = F.filter(F.transform("_vw_u", lambda x, i: F.when(~F.exists("_vw_taken", lambda r: (r["start"] <= i) & (i < r["end"])), F.struct(F.lit(9).alias("p"), i.alias("start"), F.lit(-1).alias("neg"), (i + 1).alias("end"), x["text"].alias("text"), F.lit("identity").alias("kind"), F.lit(1.0).alias("confidence"), x["start"].alias("source_start"), x["end"].alias("source_end")))), lambda r: r.isNotNull()).cast(REPL)
    df = df.withColumn("_vw_all", F.concat("_vw_taken", identity))
    df = df.withColumn("_vw_seq", F.array_sort(F.transform("_vw_all", lambda r: F.struct(r["start"].alias("at"), r.alias("r")))))
    zero = F.struct(F.lit(0).alias("end"), F.array().cast(PIECE).alias("pieces"))

    def render(acc: Column, x: Column) -> Column:
        r = x["r"]
        s = acc["end"] + F.when((acc["end"] > 0) & ~r["text"].isin(*TIGHT), 1).otherwise(0)
        e = s + F.length(r["text"])
        piece = F.struct(r["text"].alias("text"), s.alias("analysis_start"), e.alias("analysis_end"), r["source_start"].alias("source_start"), r["source_end"].alias("source_end"), r["kind"].alias("kind"), r["confidence"].alias("confidence"), (r["kind"] == "filler_comma").alias("hard"))
        return F.struct(e.alias("end"), F.concat(acc["pieces"], F.array(piece)).cast(PIECE).alias("pieces"))

    df = df.withColumn("_vw_done", F.aggregate("_vw_seq", zero, render)["pieces"])
    text_of = F.aggregate("_vw_done", F.lit(""), lambda acc, p: F.concat(F.rpad(acc, p["analysis_start"], " "), p["text"]))
    return df.withColumn(out, F.struct(text_of.alias("analysis_text"), F.col("_vw_done").alias("pieces"))).drop("_vw_u", "_vw_tk", "_vw_r", "_vw_taken", "_vw_all", "_vw_seq", "_vw_done")


def projected(view: Column, start: Column, end: Column) -> Column:
    """SPN19 / JOIN8: display offsets of an analysis span: the outer source offsets of the pieces it touches; null across a hard boundary."""
    hit = F.filter(view["pieces"], lambda p: (p["analysis_start"] < end) & (start < p["analysis_end"]))
    bad = F.exists(hit, lambda p: p["source_start"].isNull() | p["hard"])
    span = F.struct(F.array_min(F.transform(hit, lambda p: p["source_start"])).alias("start"), F.array_max(F.transform(hit, lambda p: p["source_end"])).alias("end"))
    return F.when((end > start) & (start >= 0) & (end <= F.length(view["analysis_text"])) & (F.size(hit) > 0) & ~bad, span)


def with_admitted(df: DataFrame, view: str, entities: str, tokens: str, dates: str, threshold: float, out: str) -> DataFrame:
    """SPN20 / JOIN9: analysis entities as candidates on the display text.

    Admitted are those at or above threshold whose pieces were changed in a way that
    fits their label; a DATE is completed to the smallest temporal candidate around it.
    """
    v = F.col(view)
    df = df.withColumn("_ad_heads", phrase_head_candidates(F.col(tokens)))

    def read(e: Column) -> Column:
        kinds = F.array_sort(F.array_distinct(F.transform(F.filter(v["pieces"], lambda p: (p["analysis_start"] < e["end"]) & (e["start"] < p["analysis_end"])), lambda p: p["kind"])))
        return F.struct(e["label"].alias("label"), e["score"].alias("score"), projected(v, e["start"], e["end"]).alias("s"), kinds.alias("kinds"))

    df = df.withColumn("_ad_read", F.filter(F.transform(F.filter(entities, lambda e: e["score"] >= threshold), read), lambda r: r["s"].isNotNull()))

    def complete(r: Column) -> Column:
        around = F.filter(dates, lambda d: (d["start"] <= r["s"]["start"]) & (r["s"]["end"] <= d["end"]))
        best = F.get(F.array_sort(F.transform(around, lambda d: F.struct((d["end"] - d["start"]).alias("n"), d["start"].alias("start"), d["end"].alias("end")))), F.lit(0))
        grow = (r["label"] == "DATE") & F.array_contains(r["kinds"], "temporal_itn") & best.isNotNull()
        s, e = F.when(grow, best["start"]).otherwise(r["s"]["start"]), F.when(grow, best["end"]).otherwise(r["s"]["end"])
        has = lambda k: F.array_contains(r["kinds"], k)
        named = F.exists("_ad_heads", lambda h: (h["label"] == r["label"]) & (h["start"] == s) & (h["end"] == e))
        fits = (
            ((r["label"] == "DATE") & has("temporal_itn")) | ((r["label"] == "PER") & (has("person_phrase") | has("person_name"))) | ((r["label"] == "ORG") & has("organization_case"))
            | ((r["label"] == "LOC") & has("location_case")) | (r["label"].isin("ORG", "LOC") & has("person_phrase") & named)
        )
        return F.when(fits, candidate(r["label"], s, e, "normalized_clean_model", F.concat(F.array(F.lit("analysis_normalization")), r["kinds"]), r["score"]))

    return df.withColumn(out, F.array_compact(F.transform("_ad_read", complete))).drop("_ad_heads", "_ad_read")
