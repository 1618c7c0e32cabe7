"""Span rules on transcripts: from word tokens to resolved entity spans.

A transcript is one row with a short array of tokens (``text.word_tokens``). The
temporal grammar works on a *class string*: every token becomes one letter that
says what it can be (month, ordinal, clock value, ...), and the grammar is one
regular expression over those letters. The JVM's matcher then does the
left-to-right scan, and match lengths give token indexes back. Lexicon lookups are
membership tests on literal arrays, so no rule shuffles or leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilmoch.functions import lexicon as L
from tilmoch.functions import text as S
from tilmoch.functions.numbers import fuzzy_year_key, year_value

# Sources by falling priority, and the most words of a span by label.
SOURCES = ["temporal_grammar", "gazetteer_boundary_expansion", "person_gazetteer", "person_introduction", "model_boundary_expansion", "clean_model", "normalized_clean_model", "person_relation"]
MOST_WORDS = {"PER": 3, "LOC": 6, "ORG": 6, "DATE": 12}

CANDIDATE = "array<struct<label:string,start:int,end:int,source:string,score:double,evidence:array<string>>>"


def _in(key: Column, words: list[str]) -> Column:
    return key.isin(*L.folded(words))


def _at(tokens: Column, i: Column) -> Column:
    return F.get(tokens, i)


def candidate(label: Column | str, start: Column, end: Column, source: str, evidence: Column, score: Column | None = None) -> Column:
    lab = F.lit(label) if isinstance(label, str) else label
    return F.struct(
        lab.alias("label"), start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(source).alias("source"),
        (F.lit(None).cast("double") if score is None else score.cast("double")).alias("score"), evidence.alias("evidence"),
    )


def empty() -> Column:
    return F.array().cast(CANDIDATE)


# --- temporal grammar -------------------------------------------------------

# One class letter per token, first match wins: ordinal, relative modifier, month, weekday with a suffix-free form,
# period, relative date, numeric calendar, clock marker, h:mm, plain digits, half or quarter, number word with and
# without a suffix, short unknown word, anything else. A year tail or anchor is a class of its own where it is neither.
_CLASSES = [
    ("o", lambda k: _in(k, list(L.ORDINALS))),
    ("r", lambda k: _in(k, L.RELATIVE_MODIFIERS)),
    ("m", lambda k: S.has_suffix_form(k, L.MONTHS)),
    ("w", lambda k: _in(k, L.WEEKDAYS)),
    ("d", lambda k: _in(k, L.RELATIVE_DATES)),
    ("c", lambda k: S.numeric_calendar(k)),
    ("s", lambda k: _in(k, L.TIME_MARKERS)),
    ("h", lambda k: k.rlike(r"^\d{1,2}:\d{2}$")),
    ("y", lambda k: _in(k, ["yil"])),
    ("t", lambda k: _in(k, L.DATE_TAILS)),
    ("p", lambda k: _in(k, L.PERIODS)),
    ("q", lambda k: _in(k, L.TIME_SPECIALS)),
    ("n", lambda k: _in(k, list(L.CARDINALS))),
    ("N", lambda k: S.has_suffix_form(k, list(L.CARDINALS))),
    ("i", lambda k: k.rlike(r"^\p{Nd}+$")),
    ("b", lambda k: k.rlike(r"^\p{L}{1,4}$") & ~_in(k, [*L.BRIDGE_STOPWORDS, *L.CARDINALS, *L.RELATIVE_MODIFIERS])),
]
# a clock value ends at a suffixed number, at h:mm and at half or quarter; at most four tokens
_CLOCK = "(?:[ni]{0,3}[Nhq]|[ni]{1,4})"
_TAIL = f"[ty]*(?:s{_CLOCK})?"

def token_classes(tokens: Column) -> Column:
    """The class letter of each token, as an array."""

    def letter(t: Column) -> Column:
        k, out = t["key"], F
        for name, test in _CLASSES:
            out = out.when(test(k), name)
        return out.otherwise("x")

    return F.transform(tokens, letter)


def anchored_years(tokens: Column) -> Column:
    """SPN1: ``(first, last)`` token indexes of year phrases that end at a year anchor: the widest of seven down to two words that form a year, with at most one corrected word and no boundary inside."""
    keys = F.transform(tokens, lambda t: t["key"])
    anchors = F.filter(F.transform(tokens, lambda t, i: F.when(_in(t["key"], L.YEAR_ANCHORS), i)), lambda i: i.isNotNull() & (i >= 2))
    known = F.array(*map(F.lit, [*L.CARDINALS, *L.ORDINALS]))

    def first(a: Column) -> Column:
        def ok(w: Column) -> Column:
            part = F.slice(keys, a - w + 1, w)
            fixed = F.transform(part, fuzzy_year_key)
            broken = F.exists(F.slice(tokens, a - w + 2, w - 1), lambda t: t["boundary_before"])
            corrected = F.size(F.filter(part, lambda k: ~F.array_contains(known, k)))
            return ~broken & ~F.exists(fixed, lambda k: k.isNull()) & (corrected <= 1) & year_value(fixed).isNotNull()

        widths = F.filter(F.sequence(F.least(a, F.lit(7)), F.lit(2), F.lit(-1)), ok)
        return F.struct((a - F.get(widths, F.lit(0))).alias("first"), a.alias("last"))

    return F.filter(F.transform(anchors, first), lambda y: y["first"].isNotNull())


_YEAR_TAIL = _TAIL.replace("[ty]*", "[tyY]*")
#: The branches in order; Y stands for the anchor of a year phrase.
GRAMMAR = f"Y|o(?:m|bm){_YEAR_TAIL}|r[wpyY]{_YEAR_TAIL}|m{_YEAR_TAIL}|[wd]{_YEAR_TAIL}|cc?{_YEAR_TAIL}|s{_CLOCK}|h"
_SPANS = "array<struct<first:int,last:int,evidence:array<string>>>"


def with_temporal(df: DataFrame, tokens: str, out: str) -> DataFrame:
    """SPN2: DATE candidates of temporal phrases, by one scan of the class string.

    Year phrases (SPN1) come first; their anchors are Y in the class string. The
    scan takes matches from left to right. A span then takes up to two number words
    before an ordinal month, and a year phrase that starts right after it. Each step
    is a column of its own, so that nothing is evaluated twice.
    """
    t = F.col(tokens)
    df = df.withColumn("_tp_years", anchored_years(t)).withColumn("_tp_classes", token_classes(t))
    df = df.withColumn("_tp_letters", F.transform("_tp_classes", lambda c, i: F.when(F.exists("_tp_years", lambda y: y["last"] == i), "Y").otherwise(c)))
    df = df.withColumn("_tp_string", F.array_join("_tp_letters", ""))
    pattern = F.lit(f"(.*?)({GRAMMAR})")
    df = df.withColumn("_tp_m", S.zip2(F.regexp_extract_all("_tp_string", pattern, F.lit(1)), F.regexp_extract_all("_tp_string", pattern, F.lit(2))))
    ends = F.aggregate("_tp_m", F.array(F.lit(0)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(p["0"]) + F.length(p["1"]))))
    df = df.withColumn("_tp_ends", F.slice(ends, 2, F.size("_tp_m")))
    df = df.withColumn("_tp_raw", F.zip_with("_tp_m", "_tp_ends", lambda p, e: F.struct((e - F.length(p["1"])).alias("first"), (e - 1).alias("last"), p["1"].alias("h"))))
    letters, years = F.col("_tp_letters"), F.col("_tp_years")
    before = lambda k: F.when(k >= 0, F.get(letters, F.when(k >= 0, k)))

    def finish(s: Column) -> Column:
        f, h = s["first"], s["h"]
        lead = F.when(before(f - 1) == "n", F.when(before(f - 2) == "n", 2).otherwise(1)).otherwise(0)
        prev_ordinal = (before(f - 1) == "o") & h.startswith("m")
        year = F.get(F.filter(years, lambda y: y["last"] == f), F.lit(0))["first"]
        first = F.when(h == "Y", year).when(h.startswith("om"), f - lead).when(prev_ordinal, f - 1).otherwise(f)
        kind = (
            F.when(h == "Y", "anchored_year").when(h.startswith("om"), "ordinal_month").when(h.startswith("ob"), "ordinal_bridge_month").when(h.startswith("r"), "relative_modifier")
            .when(h.startswith("c"), "numeric_date").when(h.startswith("s"), "clock_marker").when(h == "h", "numeric_time").otherwise("calendar_anchor")
        )
        after = F.when(h != "Y", F.get(F.filter(years, lambda y: y["first"] == s["last"] + 1), F.lit(0))["last"])
        return F.struct(first.alias("first"), F.coalesce(after, s["last"]).alias("last"), F.array_compact(F.array(kind, F.when(after.isNotNull(), "anchored_year"))).alias("evidence"))

    df = df.withColumn("_tp_spans", F.transform("_tp_raw", finish).cast(_SPANS))
    # a year phrase that a span has taken is no span of its own
    kept = F.aggregate("_tp_spans", F.array().cast(_SPANS), lambda acc, s: F.when(F.exists(acc, lambda o: o["last"] >= s["last"]), acc).otherwise(F.concat(acc, F.array(s))))
    df = df.withColumn("_tp_kept", kept)
    cands = F.transform("_tp_kept", lambda s: candidate("DATE", _at(t, s["first"])["start"], _at(t, s["last"])["end"], "temporal_grammar", s["evidence"])).cast(CANDIDATE)
    return df.withColumn(out, cands).drop("_tp_years", "_tp_classes", "_tp_letters", "_tp_string", "_tp_m", "_tp_ends", "_tp_raw", "_tp_spans", "_tp_kept")


# --- persons and heads ------------------------------------------------------


def head_label(key: Column) -> Column:
    """STR17: ORG or LOC for an inflected semantic head; null otherwise."""
    table = L.head_table()
    org, loc = ([k for k, v in table.items() if v == x] for x in ("ORG", "LOC"))
    return F.when(key.isin(*org), "ORG").when(key.isin(*loc), "LOC")


def _phrases() -> list[list[str]]:
    return [[L.fold(w) for w in p.split()] for p in L.PERSON_PHRASES]


def phrase_matches(tokens: Column) -> Column:
    """SPN3: ``(first, last, canonical)`` of reviewed person phrases without a boundary inside."""
    keys = F.transform(tokens, lambda t: t["key"])

    def of(words: list[str], canonical: str) -> Column:
        k, phrase = F.lit(len(words)), F.array(*map(F.lit, words))
        same = lambda i: (F.slice(keys, i + 1, k) == phrase) & ~F.exists(F.slice(tokens, i + 2, k - 1), lambda t: t["boundary_before"])
        at = F.filter(F.transform(tokens, lambda t, i: i), same)
        return F.transform(at, lambda i: F.struct(i.alias("first"), (i + k - 1).alias("last"), F.lit(canonical).alias("canonical")))

    return F.concat(*[of(w, c) for w, c in zip(_phrases(), L.PERSON_PHRASES)])


def phrase_candidates(tokens: Column) -> Column:
    """SPN4."""
    return F.transform(phrase_matches(tokens), lambda m: candidate("PER", _at(tokens, m["first"])["start"], _at(tokens, m["last"])["end"], "person_gazetteer", F.array(F.lit("exact_person_phrase")))).cast(CANDIDATE)


def phrase_head_candidates(tokens: Column) -> Column:
    """SPN5: a phrase, maybe ``nomidagi``, and a head right after it are one place or organization."""

    def one(m: Column) -> Column:
        skip = F.coalesce((_at(tokens, m["last"] + 1)["key"] == "nomidagi").cast("int"), F.lit(0))
        head = _at(tokens, m["last"] + 1 + skip)
        return candidate(F.when(~head["boundary_before"], head_label(head["key"])), _at(tokens, m["first"])["start"], head["end"], "gazetteer_boundary_expansion", F.array(F.lit("person_phrase_semantic_head")))

    return F.filter(F.transform(phrase_matches(tokens), one), lambda c: c["label"].isNotNull()).cast(CANDIDATE)


def introduction_candidates(tokens: Column) -> Column:
    """SPN6: up to three name words after ``ismim`` and fillers; none if a fourth follows or the next word is ``emas``."""
    temporal = [*L.MONTHS, *L.WEEKDAYS, *L.RELATIVE_DATES, *L.RELATIVE_MODIFIERS, *L.PERIODS, *L.DATE_TAILS, *L.TIME_MARKERS]
    boundary = [*L.INTRO_BOUNDARIES, *temporal]
    stops = [*L.INTRO_FILLERS, *boundary, *L.PERSON_REJECT]
    filler = lambda t: _in(t["key"], L.INTRO_FILLERS)
    stop = lambda t: t["boundary_before"] | _in(t["key"], stops) | ~S.name_word(t["key"])
    n = F.size(tokens)
    idx = F.filter(F.transform(tokens, lambda t, i: F.when(t["key"] == "ismim", i + 1)), lambda i: i.isNotNull() & (i < n))
    # the first index from i on where a test holds, the end of the text otherwise
    seek = lambda i, test: F.coalesce(F.array_min(F.filter(F.transform(tokens, lambda t, j: F.when((j >= i) & test(t), j)), lambda j: j.isNotNull())), n)

    def one(i: Column) -> Column:
        s = seek(i, lambda t: ~filler(t))
        e = F.least(seek(s, stop), s + 3)
        nxt = _at(tokens, e)
        fourth = (e - s == 3) & ~nxt["boundary_before"] & S.name_word(nxt["key"]) & ~_in(nxt["key"], boundary)
        good = (e > s) & ~F.coalesce(fourth, F.lit(False)) & ~F.coalesce(nxt["key"] == "emas", F.lit(False))
        return F.when(good, candidate("PER", _at(tokens, s)["start"], _at(tokens, e - 1)["end"], "person_introduction", F.array(F.lit("ismim_introduction"))))

    return F.array_compact(F.transform(idx, one)).cast(CANDIDATE)


def relation_candidates(tokens: Column) -> Column:
    """SPN7 / WIN2: a known name or surname before ``bilan``, with a social verb among the next six words (after ``birga``)."""
    names = [L.fold(x) for x in L.PERSON_NAMES]

    def one(t: Column, i: Column) -> Column:
        person = F.when(i > 0, _at(tokens, F.greatest(i - 1, F.lit(0))))
        birga = F.coalesce((_at(tokens, i + 1)["key"] == "birga").cast("int"), F.lit(0))
        verbs = F.exists(F.slice(tokens, i + 2 + birga, F.lit(6)), lambda v: _in(v["key"], L.SOCIAL_VERBS))
        ok = (t["key"] == "bilan") & ~t["boundary_before"] & (person["key"].isin(*names) | S.surname_like(person["key"])) & verbs
        return F.when(ok, candidate("PER", person["start"], person["end"], "person_relation", F.array(F.lit("bilan_social_verb"))))

    return F.array_compact(F.transform(tokens, one)).cast(CANDIDATE)


def boundary_candidates(tokens: Column, model: Column) -> Column:
    """SPN8: a model place or organization grows to a semantic head among the next three words and takes its type; a safe modifier before it joins."""
    blockers = [*L.MONTHS, *L.WEEKDAYS, *L.RELATIVE_DATES, *L.RELATIVE_MODIFIERS, *L.PERIODS]
    blocked = sorted({b + e for b in blockers for e in L.HEAD_ENDINGS} | set(L.folded(L.BOUNDARY_STOPWORDS)))

    def one(e: Column) -> Column:
        a = F.get(F.filter(F.transform(tokens, lambda t, i: F.when((t["start"] == e["start"]) & (t["end"] <= e["end"]), i)), lambda i: i.isNotNull()), F.lit(0))
        ahead = F.when(a.isNotNull(), F.slice(tokens, a + 2, F.lit(3)))
        stops = F.transform(ahead, lambda t, j: F.when(t["boundary_before"] | t["key"].isin(*blocked), j))
        heads = F.transform(ahead, lambda t, j: F.when(head_label(t["key"]).isNotNull(), j))
        stop = F.coalesce(F.array_min(F.array_compact(stops)), F.lit(9))
        h = F.array_min(F.array_compact(heads))
        head = F.when(h < stop, F.get(ahead, h))
        before = F.when(a > 0, _at(tokens, F.greatest(a - 1, F.lit(0))))
        safe = ~_at(tokens, a)["boundary_before"] & _in(before["key"], L.SAFE_MODIFIERS)
        start = F.when(F.coalesce(safe, F.lit(False)), before["start"]).otherwise(e["start"])
        ok = e["label"].isin("ORG", "LOC") & head.isNotNull()
        return F.when(ok, candidate(head_label(head["key"]), start, head["end"], "model_boundary_expansion", F.array(F.lit("model_anchor_semantic_head"))))

    return F.array_compact(F.transform(model, one)).cast(CANDIDATE)


def model_candidates(model: Column, source: str = "clean_model") -> Column:
    """Model entities as candidates."""
    return F.transform(model, lambda e: candidate(e["label"], e["start"], e["end"], source, F.array(F.lit(source)), e["score"])).cast(CANDIDATE)


# --- resolution -------------------------------------------------------------


def greedy(sorted_spans: Column, kind: str) -> Column:
    """Keep each span that overlaps none kept before it."""
    return F.aggregate(sorted_spans, F.array().cast(kind), lambda acc, c: F.when(F.exists(acc, lambda o: (c["start"] < o["end"]) & (o["start"] < c["end"])), acc).otherwise(F.concat(acc, F.array(c))))


def with_resolved(df: DataFrame, tokens: str, candidates: str, out: str) -> DataFrame:
    """SPN9: valid candidates, one per label and span, without overlaps by fixed priorities, in text order."""
    rank = F.create_map(*[F.lit(v) for i, s in enumerate(SOURCES) for v in (s, i)])
    most = F.create_map(*[F.lit(v) for kv in MOST_WORDS.items() for v in kv])
    t = F.col(tokens)

    def checked(c: Column, i: Column) -> Column:
        inside = F.filter(t, lambda x: (c["start"] <= x["start"]) & (x["end"] <= c["end"]))
        limit = F.when((c["label"] == "PER") & (c["source"] == "person_gazetteer"), 4).otherwise(most[c["label"]])
        aligned = F.exists(t, lambda x: x["start"] == c["start"]) & F.exists(t, lambda x: x["end"] == c["end"])
        greeting = (c["label"] == "PER") & F.exists(t, lambda x: (c["start"] <= x["start"]) & (x["end"] <= c["end"]) & _in(x["key"], L.GREETINGS))
        ok = aligned & F.size(inside).between(1, limit) & ~greeting
        return F.struct(ok.alias("ok"), rank[c["source"]].alias("p"), (-F.coalesce(c["score"], F.lit(-1.0))).alias("s"), i.alias("i"), c.alias("c"))

    df = df.withColumn("_rs_checked", F.transform(candidates, checked)).withColumn("_rs_good", F.filter("_rs_checked", lambda r: r["ok"]))
    same = lambda o, r: (o["c"]["label"] == r["c"]["label"]) & (o["c"]["start"] == r["c"]["start"]) & (o["c"]["end"] == r["c"]["end"])
    better = lambda o, r: F.struct(o["p"], o["s"], o["i"]) < F.struct(r["p"], r["s"], r["i"])
    df = df.withColumn("_rs_best", F.filter("_rs_good", lambda r: ~F.exists("_rs_good", lambda o: same(o, r) & better(o, r))))
    order = F.transform("_rs_best", lambda r: F.struct(r["p"].alias("p"), r["c"]["start"].alias("start"), (-r["c"]["end"]).alias("e"), r["c"]["label"].alias("l"), r["c"]["source"].alias("src"), r["c"]["end"].alias("end"), r["c"]["score"].alias("score"), r["c"]["evidence"].alias("evidence")))
    df = df.withColumn("_rs_order", F.array_sort(order))
    kind = "array<struct<p:int,start:int,e:int,l:string,src:string,end:int,score:double,evidence:array<string>>>"
    df = df.withColumn("_rs_taken", greedy(F.col("_rs_order"), kind))
    final = F.transform("_rs_taken", lambda k: F.struct(k["start"].alias("start"), k["end"].alias("end"), k["l"].alias("label"), k["src"].alias("source"), k["score"].alias("score"), k["evidence"].alias("evidence")))
    return df.withColumn(out, F.array_sort(final)).drop("_rs_checked", "_rs_good", "_rs_best", "_rs_order", "_rs_taken")


def with_canonical(text: Column, spans: Column) -> Column:
    """SPN13 / JOIN10: PER spans with the reviewed name they mean: an exact phrase, or the single nearest name within the allowed edits."""
    names = [(L.fold(x), x) for x in L.PERSON_NAMES]
    rejected = L.folded([*L.GREETINGS, *L.PERSON_REJECT, *L.ORGANIZATION_HEADS, *L.LOCATION_HEADS, *L.MONTHS, *L.WEEKDAYS, *L.RELATIVE_DATES, *L.RELATIVE_MODIFIERS, *L.PERIODS])
    phrases = F.create_map(*[F.lit(v) for w, c in zip(_phrases(), L.PERSON_PHRASES) for v in (" ".join(w), c)])

    def one(s: Column) -> Column:
        surface = text.substr(s["start"] + 1, s["end"] - s["start"])
        keys = F.transform(S.words(surface), S.plain_comparison_key)
        key = F.get(keys, F.lit(0))
        ok = (s["label"] == "PER") & (F.size(keys) > 0) & ~F.exists(keys, lambda k: k.isin(*rejected))
        near = F.array_sort(F.array(*[F.struct(F.levenshtein(key, F.lit(k)).alias("d"), F.lit(c).alias("c")) for k, c in names]))
        d, c, d2 = F.get(near, F.lit(0))["d"], F.get(near, F.lit(0))["c"], F.get(near, F.lit(1))["d"]
        phrase = phrases[F.array_join(keys, " ")]
        single = (F.size(keys) == 1) & (d <= S.most_edits(key)) & (d < d2)
        name = F.when(ok, F.coalesce(phrase, F.when(single, c)))
        confidence = F.when(phrase.isNotNull() | (d == 0), 1.0).otherwise(F.greatest(F.lit(0.5), 1 - d / F.length(key)))
        origin = F.when(phrase.isNotNull(), "person_phrase_gazetteer").otherwise("name_lexicon_edit_distance")
        return F.struct(
            surface.alias("text"), s["label"].alias("label"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score"), s["source"].alias("source"), s["evidence"].alias("evidence"),
            name.alias("canonical_text"), F.when(name.isNotNull(), confidence).alias("canonical_confidence"), F.when(name.isNotNull(), origin).alias("canonical_source"),
        )

    return F.transform(spans, one)


def extract(df: DataFrame, text: str, model: str, out: str = "entities") -> DataFrame:
    """SPN12: all rules and the model's entities, resolved and with canonical names, as an array column.

    A null text has no entities, a null model list counts as empty. To get rows, use
    the outer generators and filter after them: for the inner ones the optimizer
    pushes a size filter below all the steps and copies them into it.
    """
    none = F.array().cast("array<struct<text:string,label:string,start:int,end:int,score:double>>")
    t = df.withColumn("_ex_tokens", S.word_tokens(F.col(text))).withColumn("_ex_model", F.coalesce(F.col(model), none))
    t = with_temporal(t, "_ex_tokens", "_ex_temporal")
    k, m = F.col("_ex_tokens"), F.col("_ex_model")
    parts = [F.col("_ex_temporal"), phrase_head_candidates(k), phrase_candidates(k), introduction_candidates(k), boundary_candidates(k, m), model_candidates(m), relation_candidates(k)]
    t = with_resolved(t.withColumn("_ex_cands", F.concat(*parts)), "_ex_tokens", "_ex_cands", "_ex_final")
    return t.withColumn(out, with_canonical(F.col(text), F.col("_ex_final"))).drop("_ex_tokens", "_ex_model", "_ex_temporal", "_ex_cands", "_ex_final")
