"""Character, key and normalization functions on string columns.

Offsets are code points, half-open. Everything is a Catalyst expression but the
two Unicode normalization forms, which run as Arrow functions on whole batches.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilmoch.functions import lexicon as L

# The apostrophe sets of the different keys.
DELETED_APOSTROPHES = "ʻ’‘ʼ'`ˈʹ´＇"
CANONICAL_APOSTROPHES = "'’‘ʻʼ`"
ASCII_APOSTROPHES = "'`ʻʼʹʾˈ"
FULL_TEXT_APOSTROPHES = "'’‘ʼ`"
FLIPPED_APOSTROPHES = "'’ʻʼ‘`"
#: Every white-space character of the reference semantics.
SPACE = r"[\s\x{0085}\p{Z}\x{1c}-\x{1f}\x{0b}]"
WORD_CHAR = r"[\p{L}\p{N}_]"
WORD = rf"{WORD_CHAR}+(?:[ʻ’‘ʼ'`:/.\-]{WORD_CHAR}+)*"
UNIT = rf"(?:{WORD}|[^\s\x{{0085}}\p{{Z}}\x{{1c}}-\x{{1f}}\x{{0b}}\p{{L}}\p{{N}}_])"
LETTER_WORD = r"[\p{L}\p{N}]+(?:['`ʻʼʹʾˈ][\p{L}\p{N}]+)*"
METRIC_WORD = rf"{WORD_CHAR}+(?:[ʻ’‘ʼ'`\-]{WORD_CHAR}+)*"

TOKEN = T.StructType().add("text", T.StringType()).add("start", T.IntegerType()).add("end", T.IntegerType()).add("boundary_before", T.BooleanType()).add("key", T.StringType())


_PART = "\x00"  # parts the texts of a batch; it neither composes nor changes


def _normalized(x: pa.Array, form: str) -> pa.Array:
    """A normalization form of a whole batch in one call; texts that hold the part mark are done one by one."""
    texts = x.to_pylist()
    whole = _PART.join(t or "" for t in texts)
    if unicodedata.is_normalized(form, whole):
        return x
    parts = unicodedata.normalize(form, whole).split(_PART)
    if len(parts) != len(texts):
        parts = [unicodedata.normalize(form, t or "") for t in texts]
    return pa.array([None if t is None else p for t, p in zip(texts, parts)], pa.string())


@F.arrow_udf(T.StringType())
def nfc(x: pa.Array) -> pa.Array:
    return _normalized(x, "NFC")


@F.arrow_udf(T.StringType())
def nfkc(x: pa.Array) -> pa.Array:
    return _normalized(x, "NFKC")


@F.arrow_udf(T.ArrayType(T.StringType()))
def nfkc_all(x: pa.Array) -> pa.Array:
    """NFKC of every element of a string array."""
    flat = _normalized(x.flatten(), "NFKC")
    sizes = x.value_lengths().fill_null(0).to_pylist()
    off = [0]
    for n in sizes:
        off.append(off[-1] + n)
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), flat, mask=x.is_null() if x.null_count else None)


def zip2(a: Column, b: Column) -> Column:
    """Pairs of two arrays as structs with fields 0 and 1."""
    return F.zip_with(a, b, lambda x, y: F.struct(x.alias("0"), y.alias("1")))


def casefold(x: Column) -> Column:
    """Lower case, with the letters that fold further."""
    return F.translate(F.regexp_replace(F.lower(x), "ß", "ss"), "ςſ", "σs")


def delete(x: Column, chars: str) -> Column:
    return F.translate(x, chars, "")


def squeeze(x: Column) -> Column:
    """White-space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(x, SPACE + "+", " "))


def comparison_key(x: Column) -> Column:
    """STR1: NFKC, casefold, then without the ten apostrophe-like characters."""
    return delete(casefold(nfkc(x)), DELETED_APOSTROPHES)


def plain_comparison_key(x: Column) -> Column:
    """STR1 of text that is in NFKC already."""
    return delete(casefold(x), DELETED_APOSTROPHES)


def normalize_runtime(x: Column) -> Column:
    """STR2: NFC, one apostrophe, single blanks, tight years, day-months and clocks, no blank before closing punctuation."""
    x = F.translate(nfc(x), CANONICAL_APOSTROPHES, "ʻ" * len(CANONICAL_APOSTROPHES))
    x = F.regexp_replace(x, SPACE + "+", " ")
    edge, after = rf"(?<!{WORD_CHAR})", rf"(?!{WORD_CHAR})"
    x = F.regexp_replace(x, rf"(?i){edge}(\d{{4}}) ?- ?(yil){after}", "$1-$2")
    months = "|".join(L.PLAIN_MONTHS)
    x = F.regexp_replace(x, rf"(?i){edge}(0?[1-9]|[12]\d|3[01]) ?- ?({months}){after}", "$1-$2")
    x = F.regexp_replace(x, r"(?<=\d) ?: ?(?=\d)", ":")
    return F.trim(F.regexp_replace(x, r" ([,.;:!?%…)\]}»])", "$1"))


def normalize_evaluation(x: Column) -> Column:
    """STR3: STR2 in lower case, punctuation and outer apostrophes as blanks."""
    x = F.lower(normalize_runtime(x))
    x = F.regexp_replace(x, r"(?<![\p{L}\p{N}])ʻ|ʻ(?![\p{L}\p{N}])", " ")
    return squeeze(F.regexp_replace(x, r"\p{P}", " "))


def normalize_token(x: Column) -> Column:
    """STR4: NFKC, lower case, apostrophe variants as ASCII."""
    return F.translate(F.lower(nfkc(x)), ASCII_APOSTROPHES, "'" * len(ASCII_APOSTROPHES))


def word_key(x: Column) -> Column:
    """STR5: STR4 without apostrophes."""
    return F.replace(normalize_token(x), F.lit("'"), F.lit(""))


def word_keys(words: Column) -> Column:
    """STR5 of an array of words in NFKC."""
    return F.transform(words, lambda w: delete(F.lower(w), ASCII_APOSTROPHES))


def phrase_key(words: Column) -> Column:
    """STR6: the word keys of an array of words, joined with blanks."""
    return F.array_join(word_keys(nfkc_all(words)), " ")


def full_text(x: Column) -> Column:
    """STR7: NFKC, apostrophes as ʻ, casefold, everything else but word characters as blanks."""
    x = casefold(F.translate(nfkc(x), FULL_TEXT_APOSTROPHES, "ʻ" * len(FULL_TEXT_APOSTROPHES)))
    return squeeze(F.regexp_replace(x, r"[^\p{L}\p{N}_]+", " "))


def name_key(x: Column) -> Column:
    """A name apart from case, blanks and punctuation."""
    return F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", "")


def fingerprint(x: Column) -> Column:
    """STR8: SHA-256 of STR7."""
    return F.sha2(full_text(x), 256)


def augmentation_tokens(tokens: Column) -> Column:
    """STR9 of an array of tokens."""
    return F.transform(nfkc_all(tokens), lambda t: casefold(F.translate(t, FULL_TEXT_APOSTROPHES, "ʻ" * len(FULL_TEXT_APOSTROPHES))))


def _spans(x: Column, word: str, gap: str) -> Column:
    """(gap, word) matches of a text as structs with running offsets.

    Matches are contiguous, so the start of each is a running sum of lengths. The
    sum is taken in one pass of an aggregate whose state is the array and its end.
    """
    pattern = F.lit(f"({gap})({word})")
    both = zip2(F.regexp_extract_all(x, pattern, F.lit(1)), F.regexp_extract_all(x, pattern, F.lit(2)))
    size = lambda p: F.length(p["0"]) + F.length(p["1"])
    ends = F.aggregate(both, F.array(F.lit(0)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + size(p))))
    return F.zip_with(both, F.slice(ends, 2, F.size(both)), lambda p, e: F.struct(p["1"].alias("text"), (e - F.length(p["1"])).alias("start"), e.alias("end"), p["0"].alias("gap")))


def word_tokens(x: Column) -> Column:
    """STR10 / WIN1: words with code-point offsets; boundary_before says that the gap before holds more than white space.

    x should be in NFKC for keys to equal STR1 (display text is in NFC; its words rarely differ).
    """
    gap = rf"[^\p{{L}}\p{{N}}_]*"
    return F.transform(
        _spans(x, WORD, gap),
        lambda s: F.struct(s["text"].alias("text"), s["start"].alias("start"), s["end"].alias("end"), s["gap"].rlike(rf"[^\s\x{{0085}}\p{{Z}}\x{{1c}}-\x{{1f}}\x{{0b}}]").alias("boundary_before"), plain_comparison_key(s["text"]).alias("key")),
    )


def words(x: Column) -> Column:
    """The words of STR10 alone."""
    return F.regexp_extract_all(x, F.lit(f"({WORD})"), F.lit(1))


def lexical_units(x: Column) -> Column:
    """STR11: words or single other characters, with offsets."""
    return F.transform(_spans(x, UNIT, SPACE + "*"), lambda s: F.struct(s["text"].alias("text"), s["start"].alias("start"), s["end"].alias("end")))


def letter_words(x: Column) -> Column:
    """STR12: letter-or-digit words that keep inner ASCII-like apostrophes."""
    return F.regexp_extract_all(nfkc(x), F.lit(f"({LETTER_WORD})"), F.lit(1))


def metric_tokens(x: Column) -> Column:
    """STR13: metric words with offsets and their STR3 form; words without one are dropped.

    A metric word holds no blank and no outer apostrophe, so its STR3 form is its
    lower case with one apostrophe and hyphens as blanks.
    """
    norm = lambda w: squeeze(F.regexp_replace(F.lower(F.translate(w, CANONICAL_APOSTROPHES, "ʻ" * len(CANONICAL_APOSTROPHES))), r"(?<![\p{L}\p{N}])ʻ|ʻ(?![\p{L}\p{N}])|\p{P}", " "))
    spans = F.transform(_spans(x, METRIC_WORD, r"[^\p{L}\p{N}_]*"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), norm(s["text"]).alias("form")))
    return F.filter(spans, lambda s: F.length(s["form"]) > 0)


def surname_like(key: Column) -> Column:
    """STR14: five characters or more with a surname ending."""
    return (F.length(key) >= 5) & key.rlike(rf"(?:{'|'.join(L.SURNAME_ENDINGS)})\z")


def name_word(key: Column) -> Column:
    return key.rlike(r"^\p{L}+\z")


def upper_first(x: Column) -> Column:
    """STR15: only the first character in upper case."""
    return F.concat(F.upper(F.substring(x, 1, 1)), x.substr(F.lit(2), F.length(x)))


def has_suffix_form(key: Column, values: list[str]) -> Column:
    """STR16: the key, or the key without one of the nine temporal suffixes, is in the list."""
    return key.rlike(rf"^(?:{'|'.join(values)})(?:{'|'.join(L.TEMPORAL_SUFFIXES)})?\z")


def most_edits(key: Column) -> Column:
    """STR19: allowed edit distance by key length."""
    return F.when(F.length(key) <= 4, 0).when(F.length(key) <= 7, 1).otherwise(2)


def numeric_calendar(key: Column) -> Column:
    """STR20: numeric dates, years with -yil, and day-months from 1 to 31."""
    months = f"(?:{'|'.join(L.MONTHS)})(?:{'|'.join(L.TEMPORAL_SUFFIXES)})?"
    return key.rlike(rf"^(?:\d{{1,2}}[./-]\d{{1,2}}(?:[./-]\d{{2,4}})?|\d{{4}}-yil(?:da|dan|ga|gacha)?|(?:0?[1-9]|[12]\d|3[01])-{months})\z")


def time_value(key: Column) -> Column:
    """STR21: digits, h:mm, a number word with suffix, or half and quarter."""
    numbers = f"(?:{'|'.join(L.CARDINALS)})(?:{'|'.join(L.TEMPORAL_SUFFIXES)})?"
    return key.rlike(rf"^(?:\p{{Nd}}+|\d{{1,2}}:\d{{2}}|{numbers}|{'|'.join(L.TIME_SPECIALS)})\z")


def digit_runs(x: Column) -> Column:
    """STR22: the digit sequences of a text."""
    return F.regexp_extract_all(x, F.lit(r"(\d+)"), F.lit(1))


def identifier_ok(x: Column) -> Column:
    """STR25: a file-safe identifier."""
    return x.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*\z")


def revision_ok(x: Column) -> Column:
    """STR25: an immutable 40-digit revision."""
    return x.rlike(r"^[0-9a-f]{40}\z")


def text_ok(x: Column, most: int = 20000) -> Column:
    """FLT2: nonblank and no longer than most characters."""
    return (F.length(squeeze(x)) > 0) & (F.length(x) <= most)
