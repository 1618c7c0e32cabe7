"""No result depends on a size: beyond every limit the exact way gives what the short one does."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilmoch.operators import corpus as K
from tilmoch.operators import metrics as M
from tilmoch.plans import pipeline as PL
from tilmoch.sources import io


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_bit_distance():
    rnd = random.Random(3)
    for _ in range(400):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randint(0, 80))] for _ in range(2))
        assert M.bit_distance(a, b) == distance(a, b)


def test_edit_counts_of_mixed_lengths():
    rnd = random.Random(5)
    a = [np.array([rnd.randint(0, 5) for _ in range(rnd.choice([0, 1, 5, 60]))], np.int64) for _ in range(60)]
    b = [np.array([rnd.randint(0, 5) for _ in range(rnd.choice([0, 1, 5, 60]))], np.int64) for _ in range(60)]
    for cells in (1, 300, 1 << 20):
        got = M._edit_counts(a, b, cells)
        assert got.sum(axis=1).tolist() == [distance(x.tolist(), y.tolist()) for x, y in zip(a, b)]
        assert (got[:, 1] - got[:, 2]).tolist() == [len(x) - len(y) for x, y in zip(a, b)] and (got >= 0).all()


def test_error_rates_of_very_long_transcripts(spark):
    words = [f"w{i}" for i in range(25_000)]
    other = words.copy()
    for i in range(0, 25_000, 100):
        other[i] = f"x{i}"
    rows = [("long", " ".join(words), " ".join(other)), ("short", "bir ikki uch", "bir uch"), ("null", "bir", None), ("empty", "", "")]
    r = {x["id"]: x for x in M.transcript_rates(spark.createDataFrame(rows, "id string, g string, h string"), "g", "h").collect()}
    assert (r["long"]["raw_word_errors"], r["long"]["words"]) == (250, 25_000) and r["long"]["char_errors"] == 250
    assert (r["short"]["word_errors"], r["null"]["word_errors"], r["empty"]["word_errors"]) == (1, 1, 0)


@pytest.mark.parametrize("least", [1000, 1])
def test_held_out_is_exact_for_large_and_small_groups(spark, least):
    rows = [(f"r{i}", "big") for i in range(20_000)] + [(f"s{i}", "small") for i in range(7)] + [("n1", None), ("n2", None), ("one", "single")]
    df = spark.createDataFrame(rows, "id string, source string")
    got = {r["id"]: r["part"] for r in K.held_out(df, 0.1, 3, least=least).collect()}
    ranks = dict(df.select("id", K.stable_rank(F.col("id"), 3)).collect())
    for source, n in (("big", 2000), ("small", 1), (None, 1), ("single", 0)):
        ids = sorted((i for i, s in rows if s == source), key=ranks.get)
        assert {i for i in ids if got[i] == "dev"} == set(ids[:n])
    assert len(got) == len(rows)


def test_samples_beyond_the_top_k(spark, monkeypatch):
    df = spark.range(3000).select(F.col("id").cast("string").alias("id"))
    small = {c: sorted(r["id"] for r in K.stable_sample(df, c, 5).collect()) for c in (0, 1, 700, 3000, 5000)}
    mixed = {c: sorted(r["id"] for r in K.stable_sample_preferring(df, c, 5, F.col("id").endswith("7")).collect()) for c in (10, 300, 1700)}
    monkeypatch.setattr(K, "TOP_K", -1)
    assert small == {c: sorted(r["id"] for r in K.stable_sample(df, c, 5).collect()) for c in small} and len(small[700]) == 700
    assert mixed == {c: sorted(r["id"] for r in K.stable_sample_preferring(df, c, 5, F.col("id").endswith("7")).collect()) for c in mixed}


def test_places_are_exact(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("id"), K.stable_rank(F.col("id").cast("string"), 1).alias("_rank"))
    rows = K.placed(df).collect()
    assert [r["id"] for r in sorted(rows, key=lambda r: r["_at"])] == [r["id"] for r in sorted(rows, key=lambda r: r["_rank"])] and {r["_all"] for r in rows} == {5000}


def test_list_digests_stream(spark):
    import hashlib

    rows = [(f"k{i:05d}", "a" if i % 3 else "b") for i in range(2000)] + [("z", None), (None, "a")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = {r["g"]: (r["digest"], r["n"]) for r in K.list_digests(spark.createDataFrame(rows, "k string, g string"), "g", "k").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for g in "ab":
        own = sorted(k for k, x in rows if x == g and k)
        assert got[g] == (hashlib.sha256("\n".join(own).encode()).hexdigest(), len(own))


def test_a_span_that_is_no_slice_is_an_error(spark):
    df = spark.createDataFrame([("Ali keldi", "Ali keldi", [("Vali", "PER", 0, 4)])], f"r string, h string, es {M.SPAN}")
    with pytest.raises(Exception, match="no slice"):
        df.select(M.align_to_reference(F.col("r"), F.col("h"), F.col("es"))).collect()


def test_a_manifest_is_checked_without_writing(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    io.write_manifest(str(tmp_path))
    before = {n: os.stat(tmp_path / n).st_mtime_ns for n in os.listdir(tmp_path)}
    assert io.verify_manifest(str(tmp_path))
    assert before == {n: os.stat(tmp_path / n).st_mtime_ns for n in os.listdir(tmp_path)}


REC = "id string, tokens array<string>, ner_tags array<string>, source string"


def test_augmentation_guards(spark):
    row = lambda i, t: (i, t.split(), ["O"] * len(t.split()), "s")
    good = spark.createDataFrame([row(f"r{i}", "Salom dunyo .") for i in range(7)] + [row("r0__aug_0001", "Yana gap")], REC)
    out, stats = PL.augmented(good, 1)
    rows = out.collect()
    assert stats["augmented_record_count"] == 3 and len(rows) == 11 and len({r["id"] for r in rows}) == 11
    for r in rows:
        if r["source_id"]:
            assert 1 <= len(r["transformations"]) <= 3 and r["id"].startswith(r["source_id"] + "__aug_0")
    with pytest.raises(ValueError, match="not enough"):
        PL.augmented(spark.createDataFrame([row(f"r{i}", "gap") for i in range(7)], REC), 1)
    with pytest.raises(ValueError, match="twice"):
        PL.augmented(spark.createDataFrame([row("a", "Gap ."), row("a", "Gap .")], REC), 1)
    with pytest.raises(ValueError, match="already"):
        PL.augmented(good.withColumn("augmentation", F.lit("x")), 1)
    with pytest.raises(ValueError, match="BIO"):
        PL.augmented(spark.createDataFrame([("a", ["x"], ["I-PER"], "s")], REC), 1)
