"""Numbers as words: three grammars that differ on purpose, and the renderings back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilmoch.functions import lexicon as L


def lookup(table: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(v) for kv in table.items() for v in kv])


def year_value(keys: Column) -> Column:
    """NUM1: the year of cardinal keys with an ordinal only in last place; null if the keys form none from 1000 to 2199.

    ``ming`` needs a group of 1 or 2 before it, ``yuz`` one of 1 to 9.
    """
    values, ordinals = lookup(L.CARDINALS | L.ORDINALS), F.array(*map(F.lit, L.ORDINALS))
    zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("group"), F.lit(True).alias("ok"))
    inner = F.slice(keys, 1, F.greatest(F.size(keys) - 1, F.lit(0)))

    def step(s: Column, k: Column) -> Column:
        v = values[k]
        ok = s["ok"] & v.isNotNull() & ((v != 1000) | s["group"].between(1, 2)) & ((v != 100) | s["group"].between(1, 9))
        v = F.coalesce(v, F.lit(0))
        total = F.when(v == 1000, s["total"] + s["group"] * 1000).otherwise(s["total"])
        group = F.when(v == 1000, 0).when(v == 100, F.least(s["group"], F.lit(9)) * 100).otherwise(s["group"] + v)
        return F.struct(total.alias("total"), group.alias("group"), ok.alias("ok"))

    done = F.aggregate(keys, zero, step)
    year = done["total"] + done["group"]
    return F.when(done["ok"] & ~F.exists(inner, lambda k: F.array_contains(ordinals, k)) & (F.size(keys) > 0) & year.between(1000, 2199), year)


def fuzzy_year_key(key: Column) -> Column:
    """NUM2: a known year word, ``yigirma`` for its contraction, or the only known word one edit away; else null."""
    known = F.array(*map(F.lit, [*L.CARDINALS, *L.ORDINALS]))
    near = F.filter(known, lambda k: F.levenshtein(k, key) == 1)
    return F.when(F.array_contains(known, key), key).when(key == "yirma", "yigirma").when(F.size(near) == 1, F.get(near, F.lit(0)))


def spoken_year(keys: Column) -> Column:
    """NUM3: the year of cardinal word keys, ``va`` allowed between numbers, bare ``yuz`` and ``ming`` too; null outside 1800 to 2035."""
    values = lookup({k: v for k, v in L.CARDINALS.items() if v < 100})
    zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("now"), F.lit(False).alias("ming"), F.lit(True).alias("va"), F.lit(True).alias("ok"))

    def step(s: Column, k: Column) -> Column:
        v = values[k]
        is_va, yuz, ming = k == "va", k == "yuz", k == "ming"
        ok = s["ok"] & (is_va & ~s["va"] | v.isNotNull() | yuz & ~(s["ming"] & (s["now"] == 0)) | ming & ~s["ming"])
        one = F.when(s["now"] == 0, 1).otherwise(F.least(s["now"], F.lit(10000)))
        total = F.when(ming, s["total"] + one * 1000).otherwise(s["total"])
        now = F.when(ming, 0).when(yuz, one * 100).when(is_va, s["now"]).otherwise(s["now"] + F.coalesce(v, F.lit(0)))
        return F.struct(total.alias("total"), now.alias("now"), (s["ming"] | ming).alias("ming"), is_va.alias("va"), ok.alias("ok"))

    done = F.aggregate(keys, zero, step)
    year = done["total"] + done["now"]
    return F.when(done["ok"] & ~done["va"] & year.between(1800, 2035), year)


def year_words(year: Column) -> Column:
    """NUM4: canonical spoken words of a year from 1800 to 2035, an empty array otherwise."""
    units, tens = F.array(*map(F.lit, L.SPOKEN_UNITS)), F.array(*map(F.lit, L.SPOKEN_TENS))
    pick = lambda words, n: F.get(words, n - 1)  # noqa: E731 — null for 0, and array_compact drops it
    th, hu, te, un = F.floor(year / 1000), F.floor(year / 100) % 10, F.floor(year / 10) % 10, year % 10
    parts = F.array(pick(units, th.cast("int")), F.lit("ming"), pick(units, hu.cast("int")), F.when(hu > 0, "yuz"), pick(tens, te.cast("int")), pick(units, un.cast("int")))
    return F.when(year.between(1800, 2035), F.array_compact(parts)).otherwise(F.array().cast("array<string>"))


def year_variants(year: Column) -> Column:
    """NUM5: the words of a year from 2000 to 2030, and those with ``va`` after the thousand."""
    w = F.when(year.between(2000, 2030), year_words(year)).otherwise(F.array().cast("array<string>"))
    with_va = F.concat(F.slice(w, 1, 2), F.array(F.lit("va")), F.slice(w, 3, F.greatest(F.size(w) - 2, F.lit(0))))
    return F.when(F.size(w) > 2, F.array(w, with_va)).otherwise(F.array(w))


def cardinal(key: Column) -> Column:
    """NUM6: value of an exact cardinal key."""
    return lookup(L.CARDINALS)[key]


def ordinal(key: Column) -> Column:
    """NUM6: value of an exact ordinal key."""
    return lookup(L.ORDINALS)[key]


def positive_int(x: Column) -> Column:
    """NUM7: ``(value, reason)`` of a text that should be a positive integer; the reason is null if it is."""
    clean = F.trim(x)
    v = clean.try_cast("bigint")
    reason = F.when(x.isNull() | (clean == ""), "missing").when(v.isNull() | ~clean.rlike(r"^[+-]?\d+$"), "invalid").when(v <= 0, "nonpositive")
    return F.struct(F.when(reason.isNull(), v).alias("value"), reason.alias("reason"))
