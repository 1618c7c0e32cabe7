import pytest
from pyspark.sql import functions as F

from tilmoch.functions import text as S
from tilmoch.plans import pipeline as PL

REC = "id string, tokens array<string>, ner_tags array<string>, source string"


def mix(spark, base, denied=()):
    of = lambda *rows: spark.createDataFrame(list(rows), REC)
    row = lambda i, words, tag="O": (i, words.split(), [tag, *["O"] * (len(words.split()) - 1)], "s")
    temporal = of(row("t1", "kecha keldi", "B-TEMPORAL"), row("t2", "bugun ketdi", "B-TEMPORAL"), row("t3", "sirli gap"), row("t4", "Yangi gap"), row("t5", "rad etilgan"))
    speech = of(row("s1", "bugun ketdi"), *[row(f"s{k}", f"nutq {k}") for k in range(2, 6)])
    return PL.training_mix(of(*[row(*b) for b in base]), of(row("e1", "yangi gap", "B-PER")), temporal, speech, of(row("p1", "Sirli gap")), 1, {"expert": 9, "temporal": 1, "speech": 9}, {"LOC": 2}, 0.25, denied)


def test_mix_has_every_addition(spark):
    base = [("b1", "Mamlaʼkatlar soni", "B-LOC"), ("b2", "Superliga tugadi", "B-ORG"), ("b3", "Toshkent katta", "B-LOC"), ("b4", "mamlakat yoq", "O")]
    denied = tuple(r[0] for r in spark.createDataFrame([("rad etilgan",)], "x string").select(S.fingerprint(F.col("x"))).collect())
    m = mix(spark, base, denied)
    n = {r["part"]: r["count"] for r in m["train"].groupBy("part").count().collect()}
    assert n == {"base": 4, "expert": 1, "temporal": 1, "speech": 3, "base_loc": 2, "hard_loc": 7, "hard_org": 9}
    assert m["train"].select("id").distinct().count() == m["train"].count() and m["dev"].count() == 1
    why = {tuple(r) for r in m["exclusions"].collect()}
    # the temporal row that is not sampled still keeps its text from the speech part
    assert why == {("temporal", "protected_exact_text", 1), ("temporal", "normalized_duplicate", 1), ("temporal", "denylist", 1), ("speech", "normalized_duplicate", 1)}


@pytest.mark.parametrize("denied", [(), None])
def test_mix_refuses_a_base_with_a_guarded_text(spark, denied):
    words = "SIRLI gap!" if denied == () else "qora royxat"
    if denied is None:
        denied = tuple(r[0] for r in spark.createDataFrame([(words,)], "x string").select(S.fingerprint(F.col("x"))).collect())
    with pytest.raises(ValueError, match="the base holds"):
        mix(spark, [("b1", words, "O")], denied)
