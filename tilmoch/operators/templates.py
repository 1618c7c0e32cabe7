"""Authored training sentences from patterns with slots.

A pattern is a line of words; ``word/TAG`` carries a tag, ``<slot>`` or
``<slot:TYPE>`` takes a phrase and tags it as one span, ``<slot+head:TYPE>`` takes a
phrase together with the following word. Patterns meet the phrases of their slot in
an equi-join on the slot's name, and array functions put tokens and tags together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilmoch.functions import bio as B
from tilmoch.functions import lexicon as L
from tilmoch.functions.numbers import year_variants
from tilmoch.operators.corpus import label_phrases

# The patterns by kind.
PATTERNS = [
    ("per_intro_or_relation", "name", "mening ismim <PER> men"), ("per_intro_or_relation", "name", "mening ismim am <PER> men"), ("per_intro_or_relation", "name", "salom ismim <PER> men"),
    ("per_intro_or_relation", "name", "men bugun/B-TEMPORAL <PER> bilan gaplashdim"), ("per_intro_or_relation", "name", "biz <PER> bilan uchrashamiz"),
    ("per_one_edit_intro", "edited_name", "mening ismim <PER>"), ("spoken_calendar", "day_month", "<TEMPORAL> kelaman"), ("relative_calendar", "relative", "<TEMPORAL> uchrashamiz"),
    ("spoken_year", "year", "<TEMPORAL+yil> boshlandi"), ("spoken_year", "year", "<TEMPORAL+yilda> uchrashamiz"), ("spoken_year", "year", "<TEMPORAL+yil> reja tuzdik"),
    ("per_train_inventory", "person", "bugun/B-TEMPORAL <PER> bilan uchrashamiz"),
    *[("entity_boundary_curriculum", "organization", f"<ORG+{h}> ishlayman") for h in ("tashkiloti", "tashkilotida", "kompaniyasi", "kompaniyasida", "markazi", "markazida")],
    *[("entity_boundary_curriculum", "place", f"<LOC+{h}> boraman") for h in ("shahri", "shahrida", "tumani", "tumanida", "viloyati", "viloyatida")],
    *[("entity_head_hard_negative", "none", f"{h} haqida gaplashamiz") for h in ("tashkilot", "kompaniya", "markaz", "shahar", "tuman", "viloyat")],
    ("eponymic_loc_per_contrast", "eponym", "men <PER> bilan gaplashdim"),
    *[("eponymic_loc_per_contrast", "eponym", f"<LOC+{h}> boraman") for h in ("koʻchasi", "koʻchasida", "bogʻi", "bogʻida")],
    *[
        ("hard_negative", "fivefold", t)
        for t in (
            "men oʻn sakkiz yoshdaman", "uchta kitob oldim", "salom um rahmat", "200yil kelaman", "2031-yil emas", "universitet yonida turaman", "park yaqinida kutaman", "bank ochiq emas", "ee men kelaman",
            "soat uchta kitob", "ikki ming tushunarsiz yil", "yigirma beshta odam", "men oʻttiz yoshdaman",
        )
    ],
]
RELATIVE = ["bugun", "ertaga", "kelasi seshanba", "keyingi hafta", "oʻtgan oy", "shu hafta"]
TEMPLATE_DAYS = [1, 6, 16, 21, 31]


def _edited(name: str) -> str:
    return name[:-1] + ("o" if name.endswith("a") else "a")


def phrases(spark: SparkSession, records: DataFrame) -> DataFrame:
    """``(slot, phrase, place)``: fixed phrases, spoken days and years, and the first phrases of each label of the records by id."""
    names = [n.lower() for n in L.PERSON_NAMES]
    rows = [("name", n) for n in names] + [("edited_name", _edited(n)) for n in names] + [("relative", r) for r in RELATIVE] + [("none", "")] + [("fivefold", "")] * 5
    fixed = spark.createDataFrame([(s, p, i) for i, (s, p) in enumerate(rows)], "slot string, phrase string, place int")
    days = spark.createDataFrame([(d, m, i) for i, (d, m) in enumerate((d, m) for d in TEMPLATE_DAYS for m in L.PLAIN_MONTHS)], "day int, month string, place int")
    days = days.select(F.lit("day_month").alias("slot"), F.concat_ws(" ", F.array_join(B.ordinal_day_words(F.col("day")), " "), "month", F.lit("kuni")).alias("phrase"), "place")
    # every eleventh year is left unseen
    years = spark.range(2000, 2031).where("(id - 2000) % 11 <> 5").select(F.explode(year_variants(F.col("id"))).alias("w"), F.col("id").cast("int").alias("place")).select(F.lit("year").alias("slot"), F.array_join("w", " ").alias("phrase"), "place")
    out = fixed.unionByName(days).unionByName(years)
    for slot, label, n in (("person", "PER", 64), ("organization", "ORG", 24), ("place", "LOC", 24), ("eponym", "PER", 24)):
        top = label_phrases(records, label).orderBy("first_id", "phrase").limit(n)
        out = out.unionByName(top.select(F.lit(slot).alias("slot"), "phrase", F.lit(0).alias("place")))
    return out


def _fill(pattern: Column, phrase: Column) -> Column:
    """Words with tags of a pattern whose slot is filled with a phrase."""
    plain = lambda w: F.array(F.struct(F.substring_index(w, "/", 1).alias("t"), F.when(F.instr(w, "/") > 0, F.substring_index(w, "/", -1)).otherwise("O").alias("g")))

    def slot(w: Column) -> Column:
        kind, head = F.regexp_extract(w, r"^<(\w+)", 1), F.regexp_extract(w, r"\+(.*)>$", 1)
        words = F.split(F.when(head == "", phrase).otherwise(F.concat(phrase, F.lit(" "), head)), " ")
        return F.transform(words, lambda x, i: F.struct(x.alias("t"), F.concat(F.when(i == 0, "B-").otherwise("I-"), kind).alias("g")))

    return F.flatten(F.transform(F.split(pattern, " "), lambda w: F.when(w.startswith("<"), slot(w)).otherwise(plain(w))))


def authored_templates(spark: SparkSession, records: DataFrame) -> DataFrame:
    """ARR20: ``(id, tokens, ner_tags, source, template)``: all patterns with all phrases of their slots.

    records have ``id, tokens, ner_tags``. Ids number the sentences of a kind by
    their text, so they do not depend on partitioning.
    """
    patterns = spark.createDataFrame([(k, s, p, i) for i, (k, s, p) in enumerate(PATTERNS)], "template string, slot string, pattern string, place int").withColumnRenamed("place", "pattern_place")
    x = patterns.join(phrases(spark, records), "slot").withColumn("_f", _fill(F.col("pattern"), F.col("phrase")))
    x = x.select("template", "pattern_place", "place", "phrase", F.transform("_f", lambda r: r["t"]).alias("tokens"), F.transform("_f", lambda r: r["g"]).alias("ner_tags"))
    return x.select(F.concat_ws("-", F.lit("speech-template"), "template", F.format_string("%03d", "pattern_place"), F.format_string("%04d", "place"), F.substring(F.sha2("phrase", 256), 1, 8)).alias("id"), "tokens", "ner_tags", F.lit("speech_ner_template").alias("source"), "template")
