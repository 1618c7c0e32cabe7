"""Queries over the test tables, one or more per operator, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilmoch.functions import bio as B
from tilmoch.functions import lexicon as L
from tilmoch.functions import numbers as N
from tilmoch.functions import text as S
from tilmoch.operators import corpus as K
from tilmoch.operators import metrics as M
from tilmoch.operators import spans as P

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from tilmoch.plans import queries_more, queries_pipelines  # noqa: F401 — register their queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


def sql_of(name: str) -> str:
    """The SQL of a query that is registered already."""
    return _SQL[name]


# --- tables -----------------------------------------------------------------


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ner(spark: SparkSession, sf: str) -> DataFrame:
    """Prepared records, each id once: deliveries of one id have equal content."""
    return table(spark, sf, "ner_records").select("id", "tokens", "ner_tags", "source", "split").dropDuplicates(["id"])


def stt(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "stt_predictions").drop("loaded_at").dropDuplicates(["prediction_id"])


NER = "(SELECT id, any_value(tokens) AS tokens, any_value(ner_tags) AS ner_tags, any_value(source) AS source, any_value(split) AS split FROM ner_records GROUP BY id)"
STT = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prediction_id ORDER BY loaded_at) AS rn FROM stt_predictions) WHERE rn = 1)"

# --- SQL fragments ----------------------------------------------------------

_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_NARROW = "".join(map(chr, range(0x21, 0x7F)))
_SPACES = "\u00a0\u2007\u2009\u202f\u3000"
SQL_SPACE = r"[\s\x{0085}\p{Z}\x{1c}-\x{1f}\x{0b}]"
SQL_WORD = r"[\p{L}\p{N}_]+(?:[ʻ’‘ʼ''`:/.\-][\p{L}\p{N}_]+)*"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_nfkc(x: str) -> str:
    """NFKC over the characters that occur in the tables."""
    x = f"translate({x}, {q(_WIDE + _SPACES)}, {q(_NARROW + ' ' * len(_SPACES))})"
    for a, b in (("²", "2"), ("³", "3"), ("¹", "1"), ("½", "1⁄2"), ("¼", "1⁄4"), ("¾", "3⁄4"), ("№", "No"), ("…", "..."), ("µ", "μ"), ("ª", "a"), ("º", "o"), ("¨", " ̈"), ("¯", " ̄"), ("´", " ́"), ("¸", " ̧")):
        x = f"replace({x}, '{a}', '{b}')"
    return f"nfc_normalize({x})"


def sql_fold(x: str) -> str:
    return f"translate(replace(lower({x}), 'ß', 'ss'), 'ςſ', 'σs')"


def sql_key(x: str) -> str:
    return f"translate({sql_fold(sql_nfkc(x))}, {q(S.DELETED_APOSTROPHES)}, '')"


def sql_runtime(x: str) -> str:
    n = len(S.CANONICAL_APOSTROPHES)
    x = f"translate(nfc_normalize({x}), {q(S.CANONICAL_APOSTROPHES)}, '{'ʻ' * n}')"
    x = f"regexp_replace({x}, '{SQL_SPACE}+', ' ', 'g')"
    months = "|".join(L.PLAIN_MONTHS)
    for pattern in (r"(\d{4}) ?- ?(yil)", rf"(0?[1-9]|[12]\d|3[01]) ?- ?({months})"):
        for _ in range(2):
            x = rf"regexp_replace({x}, '(^|[^\p{{L}}\p{{N}}_]){pattern}($|[^\p{{L}}\p{{N}}_])', '\1\2-\3\4', 'gi')"
    for _ in range(2):
        x = rf"regexp_replace({x}, '(\d) ?: ?(\d)', '\1:\2', 'g')"
    return rf"trim(regexp_replace({x}, ' ([,.;:!?%…)\]}}»])', '\1', 'g'))"


def sql_evaluation(x: str) -> str:
    x = f"lower({sql_runtime(x)})"
    # an apostrophe stays between two letters or digits, and is a letter itself
    alnum = lambda i: rf"regexp_matches(c[{i}], '[\p{{L}}\p{{N}}]')"
    x = f"(SELECT array_to_string(list_transform(range(1, len(c) + 1), lambda i: CASE WHEN c[i] <> 'ʻ' OR (i > 1 AND i < len(c) AND {alnum('i - 1')} AND {alnum('i + 1')}) THEN c[i] ELSE ' ' END), '') FROM (SELECT string_split({x}, '') AS c))"
    return rf"trim(regexp_replace(regexp_replace({x}, '\p{{P}}', ' ', 'g'), '{SQL_SPACE}+', ' ', 'g'))"


def sql_full_text(x: str) -> str:
    n = len(S.FULL_TEXT_APOSTROPHES)
    x = sql_fold(f"translate({sql_nfkc(x)}, {q(S.FULL_TEXT_APOSTROPHES)}, '{'ʻ' * n}')")
    return rf"trim(regexp_replace({x}, '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"


def sql_word_key(x: str) -> str:
    return f"translate(lower({sql_nfkc(x)}), {q(S.ASCII_APOSTROPHES)}, '')"


def sql_words(x: str) -> str:
    return f"regexp_extract_all({x}, '{SQL_WORD}')"


def sql_list(words: list[str]) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


def big(*cols: str) -> list[Column]:
    return [F.col(c).cast("bigint").alias(c) for c in cols]


# --- text core --------------------------------------------------------------


@query(
    rf"""
    WITH w AS (SELECT coalesce(lang, 'none') AS lang,
        regexp_extract_all(text, '([^\p{{L}}\p{{N}}_]*)({SQL_WORD})', 1) AS g,
        regexp_extract_all(text, '([^\p{{L}}\p{{N}}_]*)({SQL_WORD})', 2) AS w FROM documents WHERE text IS NOT NULL),
    t AS (SELECT lang, unnest(g) AS g, unnest(w) AS w FROM w)
    SELECT lang, count(*) AS n_tokens, count(*) FILTER (WHERE regexp_matches(g, '[^\s\x{{0085}}\p{{Z}}\x{{1c}}-\x{{1f}}\x{{0b}}]')) AS n_boundary,
        count(DISTINCT lower(w)) AS n_types FROM t GROUP BY lang
    """
)
def str10_tokens_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    """STR10 / WIN1 / AGG3: tokens, boundaries and word types of the documents by language."""
    pattern = F.lit(rf"([^\p{{L}}\p{{N}}_]*)({S.WORD})")
    docs = table(spark, sf, "documents").where("text IS NOT NULL").select(F.coalesce("lang", F.lit("none")).alias("lang"), F.regexp_extract_all("text", pattern, F.lit(1)).alias("g"), F.regexp_extract_all("text", pattern, F.lit(2)).alias("w"))
    t = docs.select("lang", F.explode(F.arrays_zip("g", "w")).alias("p")).select("lang", F.lower("p.w").alias("w"), F.col("p.g").rlike(r"[^\s\x{0085}\p{Z}\x{1c}-\x{1f}\x{0b}]").alias("b"))
    # types are counted from per-type rows, so that no task holds a language's whole vocabulary
    types = t.groupBy("lang", "w").agg(F.count("*").alias("n"), F.count_if("b").alias("b"))
    return types.groupBy("lang").agg(F.sum("n").alias("n_tokens"), F.sum("b").alias("n_boundary"), F.count("*").alias("n_types"))


@query(f"SELECT {sql_key('t')} AS key, count(*) AS n, count(DISTINCT t) AS surfaces FROM (SELECT unnest(tokens) AS t FROM {NER}) GROUP BY 1")
def str1_keys(spark: SparkSession, sf: str) -> DataFrame:
    t = ner(spark, sf).select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    return t.select(S.comparison_key(F.col("t")).alias("key"), "n").groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("surfaces"))


@query(f"SELECT prediction_id, {sql_runtime('raw_transcript')} AS display FROM {STT}")
def str2_runtime(spark: SparkSession, sf: str) -> DataFrame:
    return stt(spark, sf).select("prediction_id", S.normalize_runtime(F.col("raw_transcript")).alias("display"))


@query("SELECT 0::BIGINT AS changed_twice")
def str2_idempotent(spark: SparkSession, sf: str) -> DataFrame:
    """Normalizing twice changes nothing more."""
    x = table(spark, sf, "documents").select(S.normalize_runtime(F.col("text")).alias("a"))
    return x.select(F.col("a"), S.normalize_runtime(F.col("a")).alias("b")).agg(F.count_if(F.col("a") != F.col("b")).alias("changed_twice"))


@query(f"SELECT prediction_id, {sql_evaluation('gold_transcript')} AS gold, {sql_evaluation('raw_transcript')} AS raw FROM {STT}")
def str3_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    return stt(spark, sf).select("prediction_id", S.normalize_evaluation(F.col("gold_transcript")).alias("gold"), S.normalize_evaluation(F.col("raw_transcript")).alias("raw"))


@query(f"SELECT translate(lower({sql_nfkc('t')}), {q(S.ASCII_APOSTROPHES)}, '{chr(39) * 2 * len(S.ASCII_APOSTROPHES)}') AS token, {sql_word_key('t')} AS word_key, count(*) AS n FROM (SELECT unnest(tokens) AS t FROM {NER}) GROUP BY 1, 2")
def str4_str5_tokens(spark: SparkSession, sf: str) -> DataFrame:
    t = ner(spark, sf).select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    return t.select(S.normalize_token(F.col("t")).alias("token"), S.word_key(F.col("t")).alias("word_key"), "n").groupBy("token", "word_key").agg(F.sum("n").alias("n"))


@query(f"SELECT p AS phrase, count(*) AS n, min(id) AS first_id FROM (SELECT id, array_to_string([{sql_word_key('t')} FOR t IN tokens], ' ') AS p FROM {NER}) GROUP BY 1")
def str6_phrases(spark: SparkSession, sf: str) -> DataFrame:
    return ner(spark, sf).select("id", S.phrase_key(F.col("tokens")).alias("phrase")).groupBy("phrase").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query(f"SELECT id, {sql_full_text('t')} AS full_text, sha256({sql_full_text('t')}) AS fp FROM (SELECT id, array_to_string(tokens, ' ') AS t FROM {NER})")
def str7_str8_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    x = F.array_join("tokens", " ")
    return ner(spark, sf).select("id", S.full_text(x).alias("full_text"), S.fingerprint(x).alias("fp"))


@query(
    rf"""
    SELECT prediction_id, array_to_string(regexp_extract_all(raw_transcript, '{SQL_WORD}|[^\s\x{{0085}}\p{{Z}}\x{{1c}}-\x{{1f}}\x{{0b}}\p{{L}}\p{{N}}_]'), chr(10)) AS units,
        array_to_string({sql_words('raw_transcript')}, chr(10)) AS words FROM {STT} WHERE raw_transcript IS NOT NULL
    """
)
def str11_units(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("raw_transcript")
    return stt(spark, sf).where("raw_transcript IS NOT NULL").select("prediction_id", F.array_join(F.transform(S.lexical_units(x), lambda u: u["text"]), "\n").alias("units"), F.array_join(S.words(x), "\n").alias("words"))


@query(f"SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all({sql_nfkc('text')}, '[\\p{{L}}\\p{{N}}]+(?:[''`ʻʼʹʾˈ][\\p{{L}}\\p{{N}}]+)*')) AS w FROM documents) GROUP BY 1")
def str12_letter_words(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.explode(S.letter_words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("SELECT 0::BIGINT AS wrong_slices, 0::BIGINT AS out_of_order")
def str10_offsets_hold(spark: SparkSession, sf: str) -> DataFrame:
    """Every word's offsets cut that word out of its text, in order."""
    x = table(spark, sf, "stt_predictions").where("raw_transcript IS NOT NULL").select("prediction_id", F.col("raw_transcript").alias("t"), F.posexplode(S.word_tokens(F.col("raw_transcript"))).alias("i", "k"))
    x = x.select("t", "k", F.lag("k.end").over(W.partitionBy("prediction_id", "t").orderBy("i", "k.start")).alias("before"))
    return x.agg(F.count_if(F.col("t").substr(F.col("k.start") + 1, F.col("k.end") - F.col("k.start")) != F.col("k.text")).alias("wrong_slices"), F.count_if(F.col("before") > F.col("k.end")).alias("out_of_order"))


@query(
    f"""
    SELECT key, len(key) >= 5 AND regexp_matches(key, '(?:{'|'.join(L.SURNAME_ENDINGS)})$') AS surname_like, regexp_full_match(key, '\\p{{L}}+') AS name_word, n
    FROM (SELECT {sql_key('t')} AS key, count(*) AS n FROM (SELECT unnest(tokens) AS t FROM {NER}) GROUP BY 1)
    """
)
def str14_name_words(spark: SparkSession, sf: str) -> DataFrame:
    k = str1_keys(spark, sf).drop("surfaces")
    return k.select("key", S.surname_like(F.col("key")).alias("surname_like"), S.name_word(F.col("key")).alias("name_word"), "n")


@query(f"SELECT DISTINCT w AS word, upper(w[1]) || w[2:] AS cased FROM (SELECT unnest({sql_words('text')}) AS w FROM speech_ner_eval)")
def str15_cased(spark: SparkSession, sf: str) -> DataFrame:
    w = table(spark, sf, "speech_ner_eval").select(F.explode(S.words(F.col("text"))).alias("word")).distinct()
    return w.select("word", S.upper_first(F.col("word")).alias("cased"))


def _regex_month() -> str:
    return f"^(?:{'|'.join(L.MONTHS)})(?:{'|'.join(L.TEMPORAL_SUFFIXES)})?$"


@query(
    rf"""
    WITH k AS (SELECT {sql_key('t')} AS key, count(*) AS n FROM (SELECT unnest(tokens) AS t FROM {NER}) GROUP BY 1)
    SELECT key, regexp_matches(key, '{_regex_month()}') AS is_month,
        regexp_matches(key, '^(?:\d{{1,2}}[./-]\d{{1,2}}(?:[./-]\d{{2,4}})?|\d{{4}}-yil(?:da|dan|ga|gacha)?|(?:0?[1-9]|[12]\d|3[01])-{_regex_month()[1:-1]})$') AS is_calendar,
        regexp_matches(key, '^(?:\p{{Nd}}+|\d{{1,2}}:\d{{2}}|(?:{'|'.join(L.CARDINALS)})(?:{'|'.join(L.TEMPORAL_SUFFIXES)})?|yarim|chorak)$') AS is_time, n
    FROM k WHERE is_month OR is_calendar OR is_time
    """
)
def str16_str20_str21_temporal_keys(spark: SparkSession, sf: str) -> DataFrame:
    k = str1_keys(spark, sf).drop("surfaces")
    out = k.select("key", S.has_suffix_form(F.col("key"), L.MONTHS).alias("is_month"), S.numeric_calendar(F.col("key")).alias("is_calendar"), S.time_value(F.col("key")).alias("is_time"), "n")
    return out.where("is_month OR is_calendar OR is_time")


def _heads_sql() -> str:
    return "VALUES " + ", ".join(f"({q(k)}, {q(v)})" for k, v in sorted(L.head_table().items()))


@query(f"WITH h(key, label) AS ({_heads_sql()}), k AS (SELECT {sql_key('t')} AS key, count(*) AS n FROM (SELECT unnest(tokens) AS t FROM {NER}) GROUP BY 1) SELECT label, key, n FROM k JOIN h USING (key)")
def str17_join1_heads(spark: SparkSession, sf: str) -> DataFrame:
    """STR17 / JOIN1 / SRC8: inflected heads among the tokens, by an equi-join with the head table."""
    heads = spark.createDataFrame(sorted(L.head_table().items()), "key string, label string")
    return str1_keys(spark, sf).join(heads, "key").select("label", "key", "n")


def _names_sql() -> str:
    return "VALUES " + ", ".join(f"({q(L.fold(n))}, {q(n)})" for n in L.PERSON_NAMES)


@query(
    f"""
    WITH names(name_key, canonical) AS ({_names_sql()}),
    k AS (SELECT DISTINCT {sql_key('t')} AS key FROM (SELECT unnest(tokens) AS t FROM {NER})),
    d AS (SELECT key, canonical, levenshtein(key, name_key) AS d FROM k, names WHERE regexp_full_match(key, '[a-z]+')),
    r AS (SELECT key, min(d) AS d, arg_min(canonical, d) AS canonical, count(*) FILTER (WHERE d = m) AS at_best FROM (SELECT *, min(d) OVER (PARTITION BY key) AS m FROM d) GROUP BY key)
    SELECT key, canonical, d::BIGINT AS distance FROM r WHERE at_best = 1 AND d <= CASE WHEN len(key) <= 4 THEN 0 WHEN len(key) <= 7 THEN 1 ELSE 2 END
    """
)
def str18_str19_join10_nearest_names(spark: SparkSession, sf: str) -> DataFrame:
    """JOIN10: keys with one single nearest reviewed name within the allowed edits; the name list is a fixed literal, so no join is needed."""
    k = str1_keys(spark, sf).select("key").where(F.col("key").rlike("^[a-z]+$"))
    near = F.array_sort(F.array(*[F.struct(F.levenshtein("key", F.lit(L.fold(n))).alias("d"), F.lit(n).alias("c")) for n in L.PERSON_NAMES]))
    x = k.withColumn("near", near)
    best, second = F.get("near", F.lit(0)), F.get("near", F.lit(1))
    return x.where((best["d"] < second["d"]) & (best["d"] <= S.most_edits(F.col("key")))).select("key", best["c"].alias("canonical"), best["d"].cast("bigint").alias("distance"))


@query(rf"SELECT prediction_id, regexp_extract_all(gold_transcript, '\d+') <> regexp_extract_all(coalesce(raw_transcript, ''), '\d+') AS digits_differ FROM {STT}")
def str22_digits(spark: SparkSession, sf: str) -> DataFrame:
    return stt(spark, sf).select("prediction_id", (S.digit_runs(F.col("gold_transcript")) != S.digit_runs(F.coalesce("raw_transcript", F.lit("")))).alias("digits_differ"))


@query(
    f"""
    WITH p AS (SELECT array_to_string([{sql_word_key('t')} FOR t IN tokens], ' ') AS p, source FROM {NER})
    SELECT DISTINCT 'speech-year:' || coalesce(source, 'none') || ':' || sha256(p)[1:16] AS record_id FROM p
    """
)
def str23_ids(spark: SparkSession, sf: str) -> DataFrame:
    p = ner(spark, sf).select(S.phrase_key(F.col("tokens")).alias("p"), "source")
    return p.select(F.concat(F.lit("speech-year:"), F.coalesce("source", F.lit("none")), F.lit(":"), F.substring(F.sha2("p", 256), 1, 16)).alias("record_id")).distinct()


@query(f"SELECT coalesce(source, 'none') AS source, sha256(string_agg(id, chr(10) ORDER BY id)) AS digest, count(*) AS n FROM {NER} GROUP BY 1")
def str24_digests(spark: SparkSession, sf: str) -> DataFrame:
    """STR24: the digest of each source's ids."""
    return K.list_digests(ner(spark, sf).select("id", F.coalesce("source", F.lit("none")).alias("source")), "source", "id")


@query("SELECT source, regexp_full_match(revision, '[0-9a-f]{40}') AS revision_ok, regexp_full_match(source, '[A-Za-z0-9][A-Za-z0-9._-]*') AS identifier_ok FROM source_catalog")
def str25_predicates(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "source_catalog").select("source", S.revision_ok(F.col("revision")).alias("revision_ok"), S.identifier_ok(F.col("source")).alias("identifier_ok"))


@query(rf"SELECT doc_id FROM documents WHERE text IS NOT NULL AND len(trim(regexp_replace(text, '{SQL_SPACE}+', ' ', 'g'))) > 0 AND length(text) <= 20000")
def flt2_text_guard(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where(S.text_ok(F.col("text"))).select("doc_id")


# --- numbers ----------------------------------------------------------------

_SQL_UNITS, _SQL_TENS = sql_list(L.SPOKEN_UNITS), sql_list(L.SPOKEN_TENS)


def sql_year_words(y: str) -> str:
    pick = lambda words, n: f"CASE WHEN {n} > 0 THEN {words}[({n})::INT] END"
    th, hu, te, un = f"({y} // 1000)", f"(({y} // 100) % 10)", f"(({y} // 10) % 10)", f"({y} % 10)"
    parts = [pick(_SQL_UNITS, th), "'ming'", pick(_SQL_UNITS, hu), f"CASE WHEN {hu} > 0 THEN 'yuz' END", pick(_SQL_TENS, te), pick(_SQL_UNITS, un)]
    return f"array_to_string(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL), ' ')"


@query(f"SELECT y::BIGINT AS year, {sql_year_words('y')} AS spoken, y::BIGINT AS parsed FROM (SELECT DISTINCT unnest(range(1800, 2036)) AS y)")
def num3_num4_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Every year from 1800 to 2035 as words, and parsed back."""
    y = spark.range(1800, 2036).select(F.col("id").alias("year"))
    w = y.select("year", N.year_words(F.col("year")).alias("w"))
    return w.select("year", F.array_join("w", " ").alias("spoken"), N.spoken_year(S.word_keys(F.col("w"))).cast("bigint").alias("parsed"))


@query("SELECT y::BIGINT AS year, y::BIGINT AS parsed FROM (SELECT unnest(range(1800, 2036)) AS y)")
def num1_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """The stricter grammar reads every year too: the comparison keys of the canonical words."""
    y = spark.range(1800, 2036).select(F.col("id").alias("year"), N.year_words(F.col("id")).alias("w"))
    return y.select("year", N.year_value(F.transform("w", S.plain_comparison_key)).cast("bigint").alias("parsed"))


@query(
    f"""
    WITH k AS (SELECT {sql_key('t')} AS key, count(*) AS n FROM (SELECT unnest(tokens) AS t FROM {NER}) GROUP BY 1),
    known AS (SELECT unnest({sql_list([*L.CARDINALS, *L.ORDINALS])}) AS w),
    near AS (SELECT key, any_value(w) AS w, count(*) AS c FROM k, known WHERE levenshtein(key, w) = 1 AND key NOT IN (SELECT w FROM known) AND regexp_full_match(key, '[a-z]+') GROUP BY key)
    SELECT key, CASE WHEN key = 'yirma' THEN 'yigirma' ELSE w END AS corrected, n FROM k JOIN near USING (key) WHERE c = 1 OR key = 'yirma'
    """
)
def num2_corrections(spark: SparkSession, sf: str) -> DataFrame:
    k = str1_keys(spark, sf).drop("surfaces").where(F.col("key").rlike("^[a-z]+$") & ~F.col("key").isin(*L.CARDINALS, *L.ORDINALS))
    return k.select("key", N.fuzzy_year_key(F.col("key")).alias("corrected"), "n").where("corrected IS NOT NULL")


@query(
    f"""
    WITH y AS (SELECT unnest(range(2000, 2031)) AS y), w AS (SELECT y, {sql_year_words('y')} AS s FROM y)
    SELECT y::BIGINT AS year, s AS spoken FROM w UNION ALL SELECT y, 'ikki ming va ' || s[11:] FROM w WHERE y > 2000
    """
)
def num5_variants(spark: SparkSession, sf: str) -> DataFrame:
    y = spark.range(2000, 2031).select(F.col("id").alias("year"))
    return y.select("year", F.explode(N.year_variants(F.col("year"))).alias("w")).select("year", F.array_join("w", " ").alias("spoken"))


def _values(table_: dict[str, int]) -> str:
    return "VALUES " + ", ".join(f"({q(k)}, {v})" for k, v in table_.items())


@query(
    f"""
    WITH k AS (SELECT {sql_key('t')} AS key, count(*) AS n FROM (SELECT unnest(tokens) AS t FROM {NER}) GROUP BY 1), c(key, v) AS ({_values(L.CARDINALS)}), o(key, v) AS ({_values(L.ORDINALS)})
    SELECT k.key, c.v::BIGINT AS cardinal, o.v::BIGINT AS ordinal, n FROM k LEFT JOIN c ON k.key = c.key LEFT JOIN o ON k.key = o.key WHERE c.v IS NOT NULL OR o.v IS NOT NULL
    """
)
def num6_numbers(spark: SparkSession, sf: str) -> DataFrame:
    k = str1_keys(spark, sf)
    return k.select("key", N.cardinal(F.col("key")).cast("bigint").alias("cardinal"), N.ordinal(F.col("key")).cast("bigint").alias("ordinal"), "n").where("cardinal IS NOT NULL OR ordinal IS NOT NULL")


@query(
    """
    SELECT id, s, CASE WHEN s IS NULL OR trim(s) = '' THEN 'missing' WHEN try_cast(s AS BIGINT) IS NULL OR NOT regexp_full_match(trim(s), '[+-]?\\d+') THEN 'invalid' WHEN try_cast(s AS BIGINT) <= 0 THEN 'nonpositive' END AS reason
    FROM (SELECT id, regexp_extract(id, '-([0-9]+)$', 1) AS s FROM (SELECT DISTINCT id FROM ner_records) UNION ALL SELECT * FROM (VALUES ('a', '0'), ('b', ' '), ('c', 'x1'), ('d', '-4'), ('e', NULL), ('f', ' 12 ')) v(id, s))
    """
)
def num7_integers(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "ner_records").select("id").distinct().select("id", F.regexp_extract("id", "-([0-9]+)$", 1).alias("s"))
    extra = spark.createDataFrame([("a", "0"), ("b", " "), ("c", "x1"), ("d", "-4"), ("e", None), ("f", " 12 ")], "id string, s string")
    x = ids.unionByName(extra)
    return x.select("id", "s", N.positive_int(F.col("s"))["reason"].alias("reason"))


# --- BIO sequences ----------------------------------------------------------

_LABELS_SQL = sql_list(L.BIO_LABELS)


@query(
    f"""
    SELECT id, CASE WHEN tokens IS NULL OR ner_tags IS NULL OR len(tokens) = 0 THEN 'empty' WHEN len(tokens) <> len(ner_tags) THEN 'length'
        WHEN len(list_filter(ner_tags, lambda t: NOT list_contains({_LABELS_SQL}, t))) > 0 THEN 'label'
        WHEN len(list_filter(range(1, len(ner_tags) + 1), lambda i: ner_tags[i] LIKE 'I-%' AND (i = 1 OR ner_tags[i-1] = 'O' OR ner_tags[i-1][3:] <> ner_tags[i][3:]))) > 0 THEN 'orphan' END AS reason
    FROM {NER}
    """
)
def val1_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return ner(spark, sf).select("id", B.bio_reason(F.col("tokens"), F.col("ner_tags")).alias("reason"))


_BIOES = [
    ("a", ["B-GPE", "E-GPE", "O", "S-WORK_OF_ART"]), ("b", ["S-PER", "O", "S-PRODUCT", "S-EVENT"]), ("c", ["S-ALIEN"]), ("d", ["I-PER", "O"]), ("e", ["B-GPE", "O", "S-PER"]),
    ("f", ["S-PER", "B-ORG", "I-ORG"]), ("g", ["B-DATE", "I-DATE", "E-TIME"]), ("h", ["B-PER", "I-PER", "I-PER"]), ("i", ["X-PER"]), ("j", ["b-loc ", "e-loc"]),
]


@query(
    """
    SELECT * FROM (VALUES ('a', 'B-LOC I-LOC O B-WORK', NULL), ('b', 'B-PER O O O', NULL), ('c', NULL, 'unsupported'), ('d', NULL, 'orphan'), ('e', 'B-LOC O B-PER', NULL), ('f', NULL, 'unterminated'),
        ('g', 'B-TEMPORAL I-TEMPORAL I-TEMPORAL', NULL), ('h', 'B-PER I-PER I-PER', NULL), ('i', NULL, 'malformed'), ('j', 'B-LOC I-LOC', NULL)) v(id, tags, reason)
    """
)
def arr1_bioes(spark: SparkSession, sf: str) -> DataFrame:
    """ARR1 on golden rows."""
    x = spark.createDataFrame(_BIOES, "id string, t array<string>").select("id", B.bioes_to_bio(F.col("t")).alias("r"))
    return x.select("id", F.array_join("r.tags", " ").alias("tags"), "r.reason")


@query(
    f"""
    SELECT id, array_to_string([lower(t) FOR t IN tokens], ' ') AS lowered,
        array_to_string(list_transform(range(1, len(tokens) + 1), lambda i: CASE WHEN ner_tags[i] <> 'O' THEN lower(tokens[i]) ELSE tokens[i] END), ' ') AS reduced
    FROM {NER} WHERE len(tokens) = len(ner_tags)
    """
)
def arr2_arr5_case(spark: SparkSession, sf: str) -> DataFrame:
    x = ner(spark, sf).where("size(tokens) = size(ner_tags)")
    return x.select("id", F.array_join(B.lowercase(F.col("tokens"), F.col("ner_tags"))[0], " ").alias("lowered"), F.array_join(B.reduce_capitals(F.col("tokens"), F.col("ner_tags"))[0], " ").alias("reduced"))


@query(
    f"""
    WITH x AS (SELECT id, tokens, ner_tags, list_filter(range(1, len(tokens) + 1), lambda i: NOT (ner_tags[i] = 'O' AND regexp_full_match(tokens[i], '[.,!?;…]*'))) AS k FROM {NER} WHERE len(tokens) = len(ner_tags))
    SELECT id, array_to_string(CASE WHEN len(k) = 0 THEN tokens ELSE tokens[list_min(k):list_max(k)] END, ' ') AS kept, array_to_string(CASE WHEN len(k) = 0 THEN ner_tags ELSE ner_tags[list_min(k):list_max(k)] END, ' ') AS tags FROM x
    """
)
def arr3_punctuation(spark: SparkSession, sf: str) -> DataFrame:
    x = ner(spark, sf).where("size(tokens) = size(ner_tags)")
    t, g = B.remove_punctuation(F.col("tokens"), F.col("ner_tags"))
    return x.select("id", F.array_join(t, " ").alias("kept"), F.array_join(g, " ").alias("tags"))


_ALNUM = r"[\p{L}\p{N}]"


def _sql_flip(t: str) -> str:
    """ARR4 of one token in RE2, which has no look-around: each pass twice, since a match takes its neighbours."""
    for chars, to in (("''", chr(1)), ("’ʻʼ‘`", "''")):
        for _ in range(2):
            t = rf"regexp_replace({t}, '([\p{{L}}\p{{N}}])[{chars}]([\p{{L}}\p{{N}}])', '\1{to}\2', 'g')"
    return f"replace({t}, chr(1), 'ʻ')"


@query(f"SELECT id, array_to_string([{_sql_flip('t')} FOR t IN tokens], ' ') AS flipped FROM {NER} WHERE len(tokens) = len(ner_tags)")
def arr4_apostrophes(spark: SparkSession, sf: str) -> DataFrame:
    x = ner(spark, sf).where("size(tokens) = size(ner_tags)")
    return x.select("id", F.array_join(B.apostrophes(F.col("tokens"), F.col("ner_tags"))[0], " ").alias("flipped"))


@query(None)
def arr6_arr7_arr8_arr9_transforms(spark: SparkSession, sf: str) -> DataFrame:
    """ARR6 to ARR9: which transforms apply to a record, and the record after the spacing ones."""
    x = ner(spark, sf).where("size(tokens) = size(ner_tags)")
    t = B.apply_transforms(F.col("tokens"), F.col("ner_tags"), ["hyphen_spacing", "colon_spacing"])
    return x.select("id", t.alias("r"), B.applicable(F.col("tokens"), F.col("ner_tags")).alias("a")).select("id", F.array_join("r.tokens", " ").alias("spaced"), F.array_join("r.tags", " ").alias("tags"), F.array_join("r.applied", " ").alias("applied"), F.array_join("a", " ").alias("applicable"))


@query(None)
def arr10_arr11_speech_variants(spark: SparkSession, sf: str) -> DataFrame:
    x = ner(spark, sf).where(B.bio_reason(F.col("tokens"), F.col("ner_tags")).isNull() & B.viable(F.col("ner_tags")))
    v = B.with_speech_variant(x.select("id", "tokens", "ner_tags"), 42)
    return v.select("id", F.array_join("spoken_tokens", " ").alias("spoken"), F.array_join("spoken_tags", " ").alias("tags"))


@query(
    f"""
    WITH d AS (SELECT id, string_split(t, ' ') AS w FROM (SELECT id, {sql_full_text("array_to_string(tokens, ' ')")} AS t FROM {NER}) WHERE t <> ''),
    g AS (SELECT id, n, unnest(CASE WHEN len(w) >= n THEN list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' ')) ELSE [] END) AS g FROM d, (SELECT unnest([3, 4, 5]) AS n))
    SELECT id, count(*) AS grams, md5(string_agg(g, chr(10) ORDER BY g)) AS digest FROM (SELECT DISTINCT id, g FROM g) GROUP BY id
    """
)
def arr12_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    t = S.full_text(F.array_join("tokens", " "))
    x = ner(spark, sf).select("id", t.alias("t")).where("t <> ''").select("id", F.array_sort(B.ngrams(F.split("t", " "))).alias("g"))
    return x.where("size(g) > 0").select("id", F.size("g").cast("bigint").alias("grams"), F.md5(F.array_join("g", "\n")).alias("digest"))


@query(
    f"""
    WITH t AS (SELECT id, unnest(tokens) AS t, unnest(ner_tags) AS g, generate_subscripts(tokens, 1) AS i FROM {NER} WHERE len(tokens) = len(ner_tags)),
    s AS (SELECT *, sum(CASE WHEN g LIKE 'B-%' OR g = 'O' OR (g LIKE 'I-%' AND coalesce(p, 'O')[3:] <> g[3:]) OR coalesce(p, 'O') = 'O' THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS run
        FROM (SELECT *, lag(g) OVER (PARTITION BY id ORDER BY i) AS p FROM t)),
    ph AS (SELECT id, run, string_agg({sql_fold(f"translate({sql_nfkc('t')}, {q(S.FULL_TEXT_APOSTROPHES)}, '{'ʻ' * len(S.FULL_TEXT_APOSTROPHES)}')")}, ' ' ORDER BY i) AS phrase FROM s WHERE g IN ('B-PER', 'I-PER') GROUP BY id, run)
    SELECT phrase, count(DISTINCT id) AS records, min(id) AS first_id FROM ph WHERE regexp_full_match(phrase, '\\p{{L}}+( \\p{{L}}+)*') GROUP BY phrase
    """
)
def arr13_win4_phrases(spark: SparkSession, sf: str) -> DataFrame:
    return K.label_phrases(ner(spark, sf).where("size(tokens) = size(ner_tags)"), "PER")


@query(f"SELECT id, array_to_string(list_sort(list_distinct([t[3:] FOR t IN ner_tags IF t <> 'O'])), ',') AS types, len(list_filter(ner_tags, lambda t: t[3:] IN ('PER', 'LOC', 'ORG', 'TEMPORAL'))) > 0 AS viable FROM {NER}")
def arr14_arr16_types(spark: SparkSession, sf: str) -> DataFrame:
    return ner(spark, sf).select("id", F.array_join(B.entity_types(F.col("ner_tags")), ",").alias("types"), B.viable(F.col("ner_tags")).alias("viable"))


@query(f"SELECT DISTINCT id FROM (SELECT id, unnest(tokens) AS t, unnest(ner_tags) AS g FROM {NER} WHERE len(tokens) = len(ner_tags)) WHERE g IN ('B-LOC', 'I-LOC') AND regexp_matches(lower(t), 'obod|tepa')")
def arr15_marked(spark: SparkSession, sf: str) -> DataFrame:
    x = ner(spark, sf).where("size(tokens) = size(ner_tags)")
    return x.where(B.has_marked(F.col("tokens"), F.col("ner_tags"), "LOC", ["obod", "tepa"])).select("id")


# --- corpus -----------------------------------------------------------------


@query(f"SELECT coalesce(split, 'none') AS split, g AS tag, count(*) AS n FROM (SELECT split, unnest(ner_tags) AS g FROM {NER}) GROUP BY 1, 2")
def agg3_tags(spark: SparkSession, sf: str) -> DataFrame:
    return ner(spark, sf).select(F.coalesce("split", F.lit("none")).alias("split"), F.explode("ner_tags").alias("tag")).groupBy("split", "tag").agg(F.count("*").alias("n"))


@query(f"SELECT split, count(*) AS rows, min(len(tokens))::BIGINT AS min_len, max(len(tokens))::BIGINT AS max_len, round_even(avg(len(tokens)), 6) AS mean_len, sum(len(tokens))::BIGINT AS total_len FROM {NER} GROUP BY split")
def agg4_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return K.length_summary(ner(spark, sf), F.size("tokens"), ["split"])


@query(f"SELECT split, round(count(*) / sum(count(*)) OVER (), 9) AS row_share, round(sum(len(tokens)) / sum(sum(len(tokens))) OVER (), 9) AS token_share FROM {NER} GROUP BY split")
def agg5_shares(spark: SparkSession, sf: str) -> DataFrame:
    g = ner(spark, sf).groupBy("split").agg(F.count("*").alias("n"), F.sum(F.size("tokens")).alias("t"))
    all_ = W.partitionBy()
    return g.select("split", F.round(F.col("n") / F.sum("n").over(all_), 9).alias("row_share"), F.round(F.col("t") / F.sum("t").over(all_), 9).alias("token_share"))


@query(
    f"""
    WITH k AS (SELECT {sql_fold('t')} AS f, g FROM (SELECT unnest(tokens) AS t, unnest(ner_tags) AS g FROM {NER} WHERE len(tokens) = len(ner_tags))),
    c AS (SELECT translate(f, {q(S.DELETED_APOSTROPHES)}, '') AS name, count(*) AS total_count, count(*) FILTER (WHERE g IN ('B-PER', 'I-PER')) AS per_count FROM k GROUP BY 1)
    SELECT name, total_count, per_count, round_even(per_count / total_count, 6) AS per_ratio FROM c WHERE name <> '' AND per_count >= 1 AND per_count / total_count >= 0.6
    """
)
def agg6_name_lexicon(spark: SparkSession, sf: str) -> DataFrame:
    return K.name_lexicon(ner(spark, sf).where("size(tokens) = size(ner_tags)"))


@query(
    f"""
    WITH f AS (SELECT id, split, sha256({sql_full_text("array_to_string(tokens, ' ')")}) AS fp FROM {NER}),
    p AS (SELECT DISTINCT fp FROM f WHERE split = 'test'), s AS (SELECT DISTINCT fp FROM f WHERE split = 'validation'),
    t AS (SELECT *, min(id) OVER (PARTITION BY fp) AS first_id FROM f WHERE split = 'train')
    SELECT id, CASE WHEN fp IN (SELECT fp FROM p) THEN 'protected_exact_text' WHEN fp IN (SELECT fp FROM s) OR id > first_id THEN 'normalized_duplicate' END AS reason FROM t
    """
)
def join2_set3_additions(spark: SparkSession, sf: str) -> DataFrame:
    """JOIN2 / SET3: train records against test texts (protected) and validation texts (seen)."""
    x = ner(spark, sf)
    fp = x.select("split", S.fingerprint(F.array_join("tokens", " ")).alias("fp"))
    out = K.filter_additions(x.where("split = 'train'").select("id", "tokens"), fp.where("split = 'validation'"), fp.where("split = 'test'"), ["0" * 64])
    return out.select("id", "reason")


@query(
    f"""
    WITH p AS (SELECT string_split({sql_full_text('text')}, ' ') AS w FROM prompts), d AS (SELECT id, string_split({sql_full_text("array_to_string(tokens, ' ')")}, ' ') AS w FROM {NER}),
    pg AS (SELECT DISTINCT unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g FROM p, (SELECT unnest([3, 4, 5]) AS n) WHERE len(w) >= n),
    dg AS (SELECT id, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g FROM d, (SELECT unnest([3, 4, 5]) AS n) WHERE len(w) >= n)
    SELECT DISTINCT id FROM dg WHERE g IN (SELECT g FROM pg)
    """
)
def join3_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    words = lambda x: F.split(S.full_text(x), " ")
    mine = ner(spark, sf).select("id", words(F.array_join("tokens", " ")).alias("words"))
    return K.overlapping(mine, table(spark, sf, "prompts").select(words(F.col("text")).alias("words")))


@query(f"SELECT id FROM {NER} ORDER BY sha256('42:' || id), id LIMIT 200")
def srt1_top1_sample(spark: SparkSession, sf: str) -> DataFrame:
    return K.stable_sample(ner(spark, sf).select("id"), 200, 42)


@query(
    f"""
    WITH x AS (SELECT id, len(list_filter(ner_tags, lambda t: t[3:] = 'MONEY')) > 0 AS p FROM {NER})
    SELECT id FROM x ORDER BY p DESC, CASE WHEN p THEN sha256('42:' || id) ELSE sha256('59:' || id) END, id LIMIT 500
    """
)
def top2_preferring(spark: SparkSession, sf: str) -> DataFrame:
    x = ner(spark, sf)
    return K.stable_sample_preferring(x, 500, 42, F.array_contains(B.entity_types(F.col("ner_tags")), "MONEY")).select("id")


@query(
    f"""
    WITH x AS (SELECT id, coalesce(source, 'none') AS source FROM {NER}), n AS (SELECT source, count(*) AS n FROM x GROUP BY 1),
    r AS (SELECT id, source, n, row_number() OVER (PARTITION BY source ORDER BY sha256('7:' || id), id) AS place FROM x JOIN n USING (source))
    SELECT id, source, CASE WHEN place <= CASE WHEN n >= 2 THEN least(greatest(1, round_even(n * 0.1, 0)::BIGINT), n - 1) ELSE 0 END THEN 'dev' ELSE 'train' END AS part FROM r
    """
)
def top3_held_out(spark: SparkSession, sf: str) -> DataFrame:
    x = ner(spark, sf).select("id", F.coalesce("source", F.lit("none")).alias("source"))
    return K.held_out(x, 0.1, 7).select("id", "source", "part")


@query(
    f"""
    WITH r AS (SELECT id, row_number() OVER (ORDER BY sha256('3:' || id), id) AS place, count(*) OVER () AS n FROM {NER})
    SELECT id, CASE WHEN place <= floor(n * 0.8) THEN 'train' WHEN place <= floor(n * 0.8) + floor(n * 0.1) THEN 'validation' ELSE 'test' END AS part FROM r
    """
)
def top4_split(spark: SparkSession, sf: str) -> DataFrame:
    return K.split_80_10_10(ner(spark, sf).select("id"), 3).select("id", "part")


@query(
    f"""
    WITH x AS (SELECT id, CASE WHEN list_contains(k, 'LOC') THEN 3 WHEN list_contains(k, 'ORG') THEN 2 ELSE 1 END AS f FROM (SELECT id, [t[3:] FOR t IN ner_tags] AS k FROM {NER}))
    SELECT CASE WHEN c = 0 THEN id ELSE id || '::up' || c END AS id FROM (SELECT id, unnest(range(0, f)) AS c FROM x)
    """
)
def ups1_copies(spark: SparkSession, sf: str) -> DataFrame:
    return K.upsampled(ner(spark, sf), {"ORG": 2, "LOC": 3}).select("id")


@query(None)
def spn21_spn22_agg8_mined_years(spark: SparkSession, sf: str) -> DataFrame:
    """SPN21, SPN22, AGG8, DRV5: years mined from all documents, one record per phrase."""
    d = table(spark, sf, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("key"), "text")
    m = K.best_per_phrase(K.mined_years(d, "text", "key"))
    return m.select("phrase_key", F.array_join("phrase", " ").alias("phrase"), F.col("year").cast("bigint").alias("year"), "suffix", "form")


# --- metrics ----------------------------------------------------------------


def _gold_pred(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    x = table(spark, sf, "speech_ner_eval")
    gold = x.select("id", F.explode("entities").alias("e")).select("id", "e.label", "e.start", "e.end", S.normalize_evaluation(F.col("e.text")).alias("surface"))
    pred = x.select("id", F.explode("model_entities").alias("e")).select("id", "e.label", "e.start", "e.end", S.normalize_evaluation(F.col("e.text")).alias("surface"))
    return gold, pred


def f1_sql(key: str) -> str:
    pick = f"label, {key}"
    return f"""
    WITH g AS (SELECT id, e.label AS label, e."start" AS s, e."end" AS t, {sql_evaluation('e.text')} AS surface FROM (SELECT id, unnest(entities) AS e FROM speech_ner_eval)),
    p AS (SELECT id, e.label AS label, e."start" AS s, e."end" AS t, {sql_evaluation('e.text')} AS surface FROM (SELECT id, unnest(model_entities) AS e FROM speech_ner_eval)),
    gc AS (SELECT {pick}, count(*) AS g FROM g GROUP BY ALL), pc AS (SELECT {pick}, count(*) AS p FROM p GROUP BY ALL),
    c AS (SELECT label, coalesce(g, 0) AS g, coalesce(p, 0) AS p FROM gc FULL JOIN pc USING ({pick})),
    l AS (SELECT d.label, coalesce(sum(least(g, p)), 0)::BIGINT AS tp, coalesce(sum(greatest(p - g, 0)), 0)::BIGINT AS fp, coalesce(sum(greatest(g - p, 0)), 0)::BIGINT AS fn
        FROM (SELECT unnest({sql_list(L.LABELS)}) AS label) d LEFT JOIN c USING (label) GROUP BY d.label),
    a AS (SELECT * FROM l UNION ALL SELECT 'overall', sum(tp)::BIGINT, sum(fp)::BIGINT, sum(fn)::BIGINT FROM l),
    r AS (SELECT *, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 9)::DOUBLE AS "precision", round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 9)::DOUBLE AS recall,
        round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END, 9)::DOUBLE AS f1, tp + fn AS support FROM a)
    SELECT * FROM r UNION ALL SELECT 'macro', NULL, NULL, NULL, NULL, NULL, round(avg(f1), 9), NULL FROM r WHERE label <> 'overall'
    """


@query(f1_sql("id, s, t"))
def join7_agg11_span_f1(spark: SparkSession, sf: str) -> DataFrame:
    gold, pred = _gold_pred(spark, sf)
    return M.entity_scores(gold, pred, ["id", "label", "start", "end"])


@query(f1_sql("id, surface"))
def agg11_surface_f1(spark: SparkSession, sf: str) -> DataFrame:
    gold, pred = _gold_pred(spark, sf)
    return M.entity_scores(gold, pred, ["id", "label", "surface"])


def _coded(words: str, vocabulary: str) -> str:
    return f"array_to_string(list_transform({words}, lambda w: chr((33 + list_position({vocabulary}, w))::INT)), '')"


_RATES_SQL = f"""
    n AS (SELECT prediction_id, model_key, trim(regexp_replace(gold_transcript, '{SQL_SPACE}+', ' ', 'g')) AS r, trim(regexp_replace(coalesce(raw_transcript, ''), '{SQL_SPACE}+', ' ', 'g')) AS h,
        {sql_evaluation('gold_transcript')} AS rn, {sql_evaluation("coalesce(raw_transcript, '')")} AS hn FROM {STT}),
    w AS (SELECT *, [x FOR x IN string_split(r, ' ') IF x <> ''] AS rw, [x FOR x IN string_split(h, ' ') IF x <> ''] AS hw, [x FOR x IN string_split(rn, ' ') IF x <> ''] AS rnw,
        [x FOR x IN string_split(hn, ' ') IF x <> ''] AS hnw, string_split(rn, '') AS rc, string_split(hn, '') AS hc FROM n),
    v AS (SELECT *, list_distinct(list_concat(rw, hw)) AS v1, list_distinct(list_concat(rnw, hnw)) AS v2, list_distinct(list_concat(rc, hc)) AS v3 FROM w),
    rates AS (SELECT prediction_id, model_key, levenshtein({_coded('rw', 'v1')}, {_coded('hw', 'v1')})::BIGINT AS raw_word_errors, len(rw)::BIGINT AS raw_words,
        levenshtein({_coded('rnw', 'v2')}, {_coded('hnw', 'v2')})::BIGINT AS word_errors, len(rnw)::BIGINT AS words,
        CASE WHEN rn = '' OR hn = '' THEN greatest(length(rn), length(hn)) ELSE levenshtein({_coded('rc', 'v3')}, {_coded('hc', 'v3')}) END::BIGINT AS char_errors, length(rn)::BIGINT AS chars FROM v)
"""


@query(f"WITH {_RATES_SQL} SELECT * EXCLUDE (model_key) FROM rates")
def agg13_transcript_rates(spark: SparkSession, sf: str) -> DataFrame:
    r = M.transcript_rates(stt(spark, sf).select("prediction_id", "gold_transcript", "raw_transcript"), "gold_transcript", "raw_transcript")
    return r.drop("gold_transcript", "raw_transcript")


@query(
    f"""
    WITH {_RATES_SQL}
    SELECT model_key, count(*) AS samples, sum(raw_word_errors)::BIGINT AS raw_word_errors, sum(raw_words)::BIGINT AS raw_words, sum(word_errors)::BIGINT AS word_errors, sum(words)::BIGINT AS words, sum(char_errors)::BIGINT AS char_errors,
        sum(chars)::BIGINT AS chars, round(sum(raw_word_errors) / sum(raw_words), 9) AS raw_wer, round(sum(word_errors) / sum(words), 9) AS normalized_wer, round(sum(char_errors) / sum(chars), 9) AS normalized_cer FROM rates GROUP BY model_key
    """
)
def agg14_corpus_rates(spark: SparkSession, sf: str) -> DataFrame:
    r = M.transcript_rates(stt(spark, sf).select("model_key", "gold_transcript", "raw_transcript"), "gold_transcript", "raw_transcript")
    return M.corpus_rates(r, ["model_key"])


@query(f"WITH {_RATES_SQL} SELECT prediction_id, word_errors AS edits, words AS balance FROM rates")
def agg13_edit_split(spark: SparkSession, sf: str) -> DataFrame:
    """Substitutions, deletions and insertions add up to the edits, and account for the length difference."""
    split = lambda x: F.filter(F.split(S.normalize_evaluation(F.coalesce(x, F.lit(""))), " "), lambda w: w != "")
    x = stt(spark, sf).select("prediction_id", split(F.col("gold_transcript")).alias("r"), split(F.col("raw_transcript")).alias("h"))
    x = x.select("prediction_id", M.edit_split(F.col("r"), F.col("h")).alias("e"), F.size("h").alias("n"))
    return x.select("prediction_id", (F.col("e.substitutions") + F.col("e.deletions") + F.col("e.insertions")).alias("edits"), (F.col("n") + F.col("e.deletions") - F.col("e.insertions")).alias("balance"))


@query(
    f"""
    WITH e AS (SELECT prediction_id, model_key, {sql_evaluation("coalesce(raw_transcript, '')")} AS h, unnest(gold_entities) AS e FROM {STT}),
    g AS (SELECT prediction_id, model_key, h, e.label AS label, {sql_evaluation('e.text')} AS phrase, count(*) AS n FROM e GROUP BY ALL),
    c AS (SELECT *, string_split(h, ' ') AS hw, string_split(phrase, ' ') AS pw FROM g),
    f AS (SELECT model_key, label, n, least(n, CASE WHEN phrase = '' OR len(hw) < len(pw) THEN 0 ELSE len(list_filter(range(1, len(hw) - len(pw) + 2), lambda i: hw[i:i + len(pw) - 1] = pw)) END) AS found FROM c)
    SELECT model_key, label, sum(found)::BIGINT AS found, sum(n)::BIGINT AS gold, round(sum(found) / sum(n), 9) AS accuracy FROM f GROUP BY 1, 2
    """
)
def agg15_arr21_mentions(spark: SparkSession, sf: str) -> DataFrame:
    return M.mention_accuracy(stt(spark, sf).select("model_key", "gold_entities", "raw_transcript"), "gold_entities", "raw_transcript", ["model_key"])


@query(
    f"""
    SELECT model_key, count(*) AS samples, count(DISTINCT sample_id) AS sample_ids, round(sum(audio_duration_seconds), 3) AS audio_seconds, round(sum(timing.stt_seconds), 3) AS stt_seconds,
        round(sum(timing.stt_seconds) FILTER (WHERE audio_duration_seconds IS NOT NULL) / sum(audio_duration_seconds), 6) AS real_time_factor, round(avg(timing.stt_seconds), 4) AS mean_seconds, count(metrics.raw_wer) AS scored FROM {STT} GROUP BY model_key
    """
)
def agg16_models(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("timing.stt_seconds")
    g = stt(spark, sf).groupBy("model_key").agg(
        F.count("*").alias("samples"), F.countDistinct("sample_id").alias("sample_ids"), F.round(F.sum("audio_duration_seconds"), 3).alias("audio_seconds"), F.round(F.sum(t), 3).alias("stt_seconds"),
        F.round(F.sum(F.when(F.col("audio_duration_seconds").isNotNull(), t)) / F.sum("audio_duration_seconds"), 6).alias("real_time_factor"), F.round(F.avg(t), 4).alias("mean_seconds"), F.count("metrics.raw_wer").alias("scored"),
    )
    return g


# --- spans ------------------------------------------------------------------


@query(
    """
    SELECT * FROM (VALUES (1, 'oltinchi yu avgust kuni soati uchida', 'oltinchi yu avgust kuni soati uchida'), (2, 'mayli', ''), (3, 'uchta kitob', ''), (4, 'soat sotib oldim', ''),
        (5, 'bir ikki ming yigirma oltinchi yil', 'ikki ming yigirma oltinchi yil'), (6, 'kelasi hafta soat uchda keldi', 'kelasi hafta soat uchda'), (7, '10.08.2026 15:30 da', '10.08.2026|15:30'),
        (8, 'ikki ming yirma oltinchi yilda', 'ikki ming yirma oltinchi yilda'), (9, 'mening ismim Akmal Karimov va ', 'Akmal Karimov'), (10, 'ismim am Doston emas', ''), (11, 'Sardor bilan ertaga uchrashamiz', 'Sardor|ertaga'),
        (12, 'Alisher Navoiy nomidagi teatrda edik', 'Alisher Navoiy nomidagi teatrda')) v(id, text, spans)
    """
)
def spn1_spn9_golden(spark: SparkSession, sf: str) -> DataFrame:
    """The span rules on golden transcripts."""
    texts = ["oltinchi yu avgust kuni soati uchida", "mayli", "uchta kitob", "soat sotib oldim", "bir ikki ming yigirma oltinchi yil", "kelasi hafta soat uchda keldi", "10.08.2026 15:30 da", "ikki ming yirma oltinchi yilda", "mening ismim Akmal Karimov va ", "ismim am Doston emas", "Sardor bilan ertaga uchrashamiz", "Alisher Navoiy nomidagi teatrda edik"]
    x = spark.createDataFrame(list(enumerate(texts, 1)), "id int, text string").withColumn("m", F.array().cast("array<struct<text:string,label:string,start:int,end:int,score:double>>"))
    x = P.extract(x, "text", "m")
    return x.select("id", "text", F.array_join(F.transform("entities", lambda e: e["text"]), "|").alias("spans"))


def _extracted(spark: SparkSession, sf: str) -> DataFrame:
    return P.extract(table(spark, sf, "speech_ner_eval"), "text", "model_entities", "found")


@query(None)
def spn12_spn13_extract(spark: SparkSession, sf: str) -> DataFrame:
    """SPN1 to SPN9, SPN12, SPN13 on all spoken evaluation items."""
    # the outer form: for the inner one the optimizer puts a filter on the whole expression below, which doubles it at every step
    x = _extracted(spark, sf).select("id", F.inline_outer("found")).where("label IS NOT NULL")
    return x.select("id", "label", "start", "end", "text", "source", "canonical_text")


@query("SELECT 0::BIGINT AS overlaps, 0::BIGINT AS wrong_slices")
def spn11_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """SPN11: resolved spans are in order, do not overlap, and their texts are their slices."""
    x = _extracted(spark, sf).select("text", "found", F.size("found").alias("n"))
    bad = F.filter(F.sequence(F.lit(1), F.greatest(F.col("n") - 1, F.lit(1))), lambda i: (F.col("n") > 1) & (F.get("found", i)["start"] < F.get("found", i - 1)["end"]))
    wrong = F.filter("found", lambda e: F.col("text").substr(e["start"] + 1, e["end"] - e["start"]) != e["text"])
    return x.agg(F.coalesce(F.sum(F.size(bad)), F.lit(0)).alias("overlaps"), F.coalesce(F.sum(F.size(wrong)), F.lit(0)).alias("wrong_slices"))


@query(
    """
    SELECT p.id AS prompt_id, s.speaker_id, p.id || '--' || s.speaker_id AS recording_id, array_to_string(list_sort(list_distinct(list_concat(p.speech_conditions, s.conditions))), ',') AS conditions FROM prompts p, speakers s
    """
)
def join5_recording_plan(spark: SparkSession, sf: str) -> DataFrame:
    """JOIN5: every prompt for every speaker. The product is the result itself; both tables are fixed lists."""
    p = table(spark, sf, "prompts").select(F.col("id").alias("prompt_id"), "speech_conditions")
    s = table(spark, sf, "speakers")
    x = p.crossJoin(s)
    return x.select("prompt_id", "speaker_id", F.concat("prompt_id", F.lit("--"), "speaker_id").alias("recording_id"), F.array_join(F.array_sort(F.array_distinct(F.concat("speech_conditions", "conditions"))), ",").alias("conditions"))
