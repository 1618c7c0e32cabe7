"""Word lists of the Uzbek rules, and tables made from them.

The lists are fixed values: results depend on every entry, so they stand here as
plain text in their natural order. All matching is on comparison keys (lower case,
no apostrophes), so the lists are folded once, here.
"""

from __future__ import annotations

# Heads of organization and location names, modifiers, stop words, verbs.
ORGANIZATION_HEADS = (
    "universitet institut akademiya maktab vazirlik qo'mita agentlik departament kompaniya korxona bank markaz "
    "jamiyat uyushma zavod fabrika teatr kollej litsey idora fond tashkilot klinika kasalxona"
).split()
LOCATION_HEADS = (
    "park bog' ko'cha xiyobon maydon shahar viloyat tuman qishloq mahalla bekat aeroport stadion bozor daryo ko'l "
    "tog' metro stansiya ko'prik mavze"
).split()
SAFE_MODIFIERS = (
    "yangi davlat milliy xalqaro markaziy respublika oliy eski buyuk sharqiy g'arbiy shimoliy janubiy katta kichik asosiy"
).split()
INTRO_FILLERS = "am um ee eh xa ha hmm".split()
INTRO_BOUNDARIES = (
    "va lekin ammo yoki bilan uchun men biz siz u ular bugun kecha ertaga kelasi keyingi otgan shu boraman boramiz "
    "bo'laman bo'lamiz kelaman keldik keladi"
).split()
PERSON_REJECT = "mi nima kim emas yo'q yoq men biz siz u ular assalomu alaykum salom xayr rahmat".split()
BOUNDARY_STOPWORDS = (
    "am um ee eh ha xa men biz siz u ular va lekin ammo yoki bilan uchun bugun kecha ertaga kelasi keyingi otgan shu "
    "boraman boramiz bo'laman bo'lamiz kelaman keldik keladi"
).split()
SOCIAL_VERBS = "ko'rishamiz uchrashamiz gaplashamiz gaplashdim boramiz keldik keladi kutamiz".split()
GREETINGS = "assalomu alaykum salom xayr rahmat".split()
HEAD_ENDINGS = ["", *"i ida iga idan si sida siga sidan da dan ga ka ni ning lari larida".split()]

# Temporal words.
MONTHS = "yanvar fevral mart aprel may iyun iyul avgust sentabr sentyabr oktabr oktyabr noyabr dekabr".split()
PLAIN_MONTHS = "yanvar fevral mart aprel may iyun iyul avgust sentabr oktabr noyabr dekabr".split()
WEEKDAYS = "dushanba seshanba chorshanba payshanba juma shanba yakshanba".split()
RELATIVE_DATES = "bugun kecha ertaga indin hozir".split()
RELATIVE_MODIFIERS = "kelasi keyingi otgan shu".split()
PERIODS = "hafta oy yil".split()
DATE_TAILS = "kun kuni kunida yil yili yilda".split()
TIME_MARKERS = "soat soati soatda".split()
TIME_SPECIALS = "yarim chorak".split()
BRIDGE_STOPWORDS = "va am um ee eh ha xa men biz u ular bilan uchun lekin ammo yoki mi emas yoq".split()
TEMPORAL_SUFFIXES = "gacha idan ida dan da de ta te ga".split()
YEAR_ANCHORS = "yil yili yilda yilida yilning yildan yilgacha yilni".split()
YEAR_SUFFIXES = "yil yili yilda yilni yilga yildan".split()
DURATION_FOLLOWERS = "davomida mobaynida ichida oldin keyin".split()
FILLERS = "am um mmm ee eee".split()

# Number words as keys, with their values in order.
UNITS = "bir ikki uch tort besh olti yetti sakkiz toqqiz".split()
TENS = "on yigirma ottiz qirq ellik oltmish yetmish sakson toqson".split()
SPOKEN_UNITS = "bir ikki uch toʻrt besh olti yetti sakkiz toʻqqiz".split()
SPOKEN_TENS = "oʻn yigirma oʻttiz qirq ellik oltmish yetmish sakson toʻqson".split()
ORDINAL_UNITS = "birinchi ikkinchi uchinchi tortinchi beshinchi oltinchi yettinchi sakkizinchi toqqizinchi".split()
ORDINAL_TENS = "oninchi yigirmanchi ottizinchi qirqinchi elliginchi oltmishinchi yetmishinchi saksoninchi toqsoninchi".split()

# Reviewed names and phrases.
PERSON_NAMES = "Akmal Ali Aziz Doston Javohir Muhammad Nodir Rajab Sardor Shohruh Temur Umid".split()
PERSON_PHRASES = ["Alisher Navoiy"]
SURNAME_ENDINGS = "ov ev yev ova eva yeva zoda ogli qizi".split()

CARDINALS = {w: i + 1 for i, w in enumerate(UNITS)} | {w: 10 * (i + 1) for i, w in enumerate(TENS)} | {"yuz": 100, "ming": 1000}
ORDINALS = {w: i + 1 for i, w in enumerate(ORDINAL_UNITS)} | {w: 10 * (i + 1) for i, w in enumerate(ORDINAL_TENS)} | {"yuzinchi": 100, "minginchi": 1000}

# BIO labels in id order, and the mapping of other tag sets.
BIO_TYPES = "LOC ORG PER MISC TEMPORAL NUMERIC WORK MONEY".split()
BIO_LABELS = ["O", *(f"B-{t}" for t in BIO_TYPES), *(f"I-{t}" for t in BIO_TYPES)]
TYPE_MAP = {
    "PER": "PER", "PERSON": "PER", "ORG": "ORG", "GPE": "LOC", "LOC": "LOC", "FAC": "LOC", "DATE": "TEMPORAL", "TIME": "TEMPORAL",
    "DURATION": "TEMPORAL", "MONEY": "MONEY", "CARDINAL": "NUMERIC", "ORDINAL": "NUMERIC", "QUANTITY": "NUMERIC", "PERCENT": "NUMERIC",
    "AGE": "NUMERIC", "WORK_OF_ART": "WORK", "DOCUMENT": "WORK", "LAW": "WORK", "MISC": "MISC",
}
STRIPPED_TYPES = "EVENT NORP POSITION PRODUCT LANGUAGE AWARD MEDIA PROGRAM VEHICLE COURSE PHONE URL".split()
LABELS = ["PER", "LOC", "ORG", "DATE"]


def fold(word: str) -> str:
    """Comparison key of an ASCII list entry."""
    return word.lower().replace("'", "").replace("ʻ", "")


def folded(words: list[str]) -> list[str]:
    return list(dict.fromkeys(fold(w) for w in words))


def head_table() -> dict[str, str]:
    """Inflected semantic heads by key: head or softened head plus an ending; organizations win over locations."""
    out: dict[str, str] = {}
    for label, heads in (("LOC", LOCATION_HEADS), ("ORG", ORGANIZATION_HEADS)):
        for head in folded(heads):
            stems = [head] + [head[:-1] + "g"] * head.endswith(("k", "q")) + ["shahr"] * (head == "shahar")
            out |= {stem + ending: label for stem in stems for ending in HEAD_ENDINGS}
    return out
