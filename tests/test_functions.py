import unicodedata

import pytest
from pyspark.sql import functions as F

from tilmoch.functions import bio as B
from tilmoch.functions import lexicon as L
from tilmoch.functions import numbers as N
from tilmoch.functions import text as S
from tilmoch.operators import metrics as M
from tilmoch.operators import reports as R
from tilmoch.operators import spans as P
from tilmoch.plans import pipeline as PL

MODEL = "array<struct<text:string,label:string,start:int,end:int,score:double>>"


def one(spark, col, *values, types="x string"):
    return [r[0] for r in spark.createDataFrame([v if isinstance(v, tuple) else (v,) for v in values], types).select(col).collect()]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("2026 - yil 5 - avgust kuni", "2026-yil 5-avgust kuni"), ("15 : 30 : 45", "15:30:45"), ("32 - avgust", "32 - avgust"), ("Toshkent - Samarqand", "Toshkent - Samarqand"),
        ("  O'quvchi   keldi . ", "Oʻquvchi keldi."), ("a 　b", "a b"), ("é", "é"), ("", ""), (None, None), ("x ,y", "x,y"),
    ],
)
def test_runtime(spark, raw, want):
    assert one(spark, S.normalize_runtime(F.col("x")), raw) == [want]


def test_evaluation(spark):
    got = one(spark, S.normalize_evaluation(F.col("x")), "«Oʻquvchi», keldi! 'ha'", "ʻa b", None)
    assert got == ["oʻquvchi keldi ha", "a b", None]


def test_normal_forms_equal_the_standard(spark):
    texts = ["á á ﬁ ½ №", "ｆｕｌｌ", "a\x00b̈", "", "ÅÅ"]
    assert one(spark, S.nfc(F.col("x")), *texts) == [unicodedata.normalize("NFC", t) for t in texts]
    assert one(spark, S.nfkc(F.col("x")), *texts) == [unicodedata.normalize("NFKC", t) for t in texts]
    got = spark.createDataFrame([(["ﬁ", None, "½"],), (None,), ([],)], "x array<string>").select(S.nfkc_all(F.col("x"))).collect()
    assert [r[0] for r in got] == [["fi", None, "1⁄2"], None, []]


def test_word_tokens_keep_offsets(spark):
    t = "Salom, oʻrtoq 2026-yil 😊 soat 15:30!"
    toks = one(spark, S.word_tokens(F.col("x")), t)[0]
    assert [k["text"] for k in toks] == ["Salom", "oʻrtoq", "2026-yil", "soat", "15:30"]
    assert all(t[k["start"] : k["end"]] == k["text"] for k in toks)
    assert [k["boundary_before"] for k in toks] == [False, True, False, True, False]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("oltinchi yu avgust kuni soati uchida", ["oltinchi yu avgust kuni soati uchida"]), ("uchta kitob", []), ("bir ikki ming yigirma oltinchi yil", ["ikki ming yigirma oltinchi yil"]),
        ("shu yakshanba kuni keldi", ["shu yakshanba kuni"]), ("soat 15 yarim", ["soat 15 yarim"]), ("mening ismim Akmal Karimov va", ["Akmal Karimov"]), ("ismim Ali emas", []),
        ("Karimov bilan birga uchrashamiz", ["Karimov"]), ("Alisher Navoiy, keldi", ["Alisher Navoiy"]), ("", []), ("yil yil yil", []),
    ],
)
def test_span_rules(spark, text, want):
    df = spark.createDataFrame([(text, [])], f"t string, m {MODEL}")
    assert [e["text"] for e in P.extract(df, "t", "m").first()["entities"]] == want


def test_span_rules_take_nulls_and_clashing_names(spark):
    df = spark.createDataFrame([(None, None, 1), ("bugun", None, 2)], f"t string, m {MODEL}, _m int").withColumn("_tokens", F.lit(7))
    got = P.extract(df, "t", "m").orderBy("_m").collect()
    assert [r["_tokens"] for r in got] == [7, 7] and not got[0]["entities"] and got[1]["entities"][0]["text"] == "bugun"
    assert P.extract(df.limit(0), "t", "m").count() == 0


def test_boundary_expansion_retypes(spark):
    df = spark.createDataFrame([("biz yangi Toshkent universitetida edik", [("Toshkent", "LOC", 10, 18, 0.9)])], f"t string, m {MODEL}")
    e = P.extract(df, "t", "m").first()["entities"]
    assert [(x["label"], x["text"], x["source"]) for x in e] == [("ORG", "yangi Toshkent universitetida", "model_boundary_expansion")]


def test_years(spark):
    keys = [("ikki ming va besh".split(), 2005), ("yuz".split(), None), ("va besh".split(), None), ("ming ming".split(), None), ("ming toqqiz yuz".split(), 1900), ([], None)]
    assert one(spark, N.spoken_year(F.col("x")), *[(k,) for k, _ in keys], types="x array<string>") == [y for _, y in keys]
    strict = [("ikki ming yigirma oltinchi".split(), 2026), ("ikki ming va besh".split(), None), ("besh".split(), None), ("uch ming".split(), None)]
    assert one(spark, N.year_value(F.col("x")), *[(k,) for k, _ in strict], types="x array<string>") == [y for _, y in strict]


def test_bio_reasons(spark):
    cases = [((["a"], ["O"]), None), ((["a"], ["I-PER"]), "orphan"), ((["a", "b"], ["B-PER", "I-LOC"]), "orphan"), ((["a"], []), "length"), (([], []), "empty"), ((None, None), "empty"), ((["a"], [None]), "label")]
    got = spark.createDataFrame([c for c, _ in cases], "t array<string>, g array<string>").select(B.bio_reason(F.col("t"), F.col("g"))).collect()
    assert [r[0] for r in got] == [w for _, w in cases]


def test_transforms(spark):
    df = spark.createDataFrame([([".", "2026-yil", "Soʻz", "a'b", "10:15", "-", "!"], ["O", "B-TEMPORAL", "B-PER", "O", "B-TEMPORAL", "O", "O"])], "t array<string>, g array<string>")
    r = df.select(B.apply_transforms(F.col("t"), F.col("g"), B.TRANSFORM_ORDER[1:3] + B.TRANSFORM_ORDER[3:]).alias("r")).first()["r"]
    assert r["tokens"] == ["2026", "yil", "so'z", "aʻb", "10", ":", "15"]
    assert r["tags"] == ["B-TEMPORAL", "I-TEMPORAL", "B-PER", "O", "B-TEMPORAL", "I-TEMPORAL", "I-TEMPORAL"]
    assert r["applied"] == B.TRANSFORM_ORDER[1:]
    with pytest.raises(ValueError):
        B.apply_transforms(F.col("t"), F.col("g"), ["lowercase", "reduce_capitalization"])


def test_edit_split_and_rates(spark):
    df = spark.createDataFrame([("a", "x"), ("a b b b", "a b b b"), ("", ""), ("a b", None), ("a b c d", "a x c")], "r string, h string")
    t = M.transcript_rates(df, "r", "h")
    assert [r["word_errors"] for r in t.collect()] == [1, 0, 0, 2, 2]
    total = M.corpus_rates(t.where("r LIKE 'a' OR r LIKE 'a b b b'").withColumn("k", F.lit(1)), ["k"]).first()
    assert total["normalized_wer"] == 0.2
    e = spark.createDataFrame([(["a", "b", "c"], ["a", "x", "c", "d"]), ([], ["q"]), (None, None)], "r array<string>, h array<string>").select(M.edit_split("r", "h").alias("e")).collect()
    assert [tuple(x["e"]) for x in e] == [(1, 0, 1), (0, 0, 1), (0, 0, 0)]


def test_scores_count_multisets(spark):
    gold = spark.createDataFrame([("PER", 0, 5), ("PER", 6, 11), ("LOC", 12, 20)], "label string, s int, e int")
    pred = spark.createDataFrame([("PER", 0, 5), ("PER", 6, 11), ("ORG", 12, 20)], "label string, s int, e int")
    got = {r["label"]: r for r in M.entity_scores(gold, pred, ["label", "s", "e"]).collect()}
    assert (got["PER"]["tp"], got["LOC"]["fn"], got["ORG"]["fp"], got["macro"]["f1"]) == (2, 1, 1, 0.25)


def test_ner_error_matching(spark):
    kind = "array<struct<label:string,surface:string,score:double>>"
    g = [[("PER", "akmal karimov", None)], [("PER", "akmal", None)], [("DATE", "2026 yil", None)], [("LOC", "chust", None)], []]
    p = [[("PER", "akmal", 0.9)], [("LOC", "akmal", 0.9)], [], [("LOC", "chust", 0.5)], [("DATE", "7", 0.9)]]
    got = spark.createDataFrame(list(zip(g, p)), f"g {kind}, p {kind}").select(R.ner_errors("g", "p")).collect()
    assert [r[0] for r in got] == [["Incomplete entity"], ["Person classified as location"], ["Missed date", "Date classified as number only"], ["Low-confidence correct prediction"], ["Number incorrectly classified as date", "False positive"]]


def test_alignment_past_the_end(spark):
    df = spark.createDataFrame([("Akmal Karimov keldi", "Akmal Kerimov keldi", [("Akmal Kerimov", "PER", 0, 13), ("keldi", "DATE", 14, 19)])], "r string, h string, es array<struct<text:string,label:string,start:int,end:int>>")
    a = df.select(M.align_to_reference(F.col("r"), F.col("h"), F.col("es")).alias("a")).first()["a"]
    assert a[0]["start"] > 19 and (a[1]["start"], a[1]["end"], a[1]["text"]) == (14, 19, "keldi")


def test_plugged_model_and_decode(spark):
    df = spark.createDataFrame([("a b",)], "t string")
    x = PL.with_predictions(df, "t", lambda: lambda texts: [[{"text": t[:1], "label": "PER", "start": 0, "end": 1, "score": 0.9}] for t in texts])
    assert x.first()["model_entities"][0]["text"] == "a"


def test_heads_soften(spark):
    t = L.head_table()
    assert t["shahrida"] == "LOC" and t["markazi"] == "ORG" and t["kochaga"] == "LOC" and t["parki"] == "LOC" and "parkcha" not in t
