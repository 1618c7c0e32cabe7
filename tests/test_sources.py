import json
import os

import pytest
from pyspark.sql import functions as F

from tilmoch.plans import pipeline as PL
from tilmoch.sources import io
from tilmoch.streaming.mining import stream_mined_years, windowed_year_counts


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_tsv_header_is_checked(spark, tmp_path):
    good = write(tmp_path / "a.tsv", "Sentence\tTokenOrder\tToken\tNER_Tag\tpos\n1\t1\tAli\tB-PER\tN\n1\t2\tkeldi\tO\tV\n")
    splits, rejected = PL.prepare_dataset(io.read_tsv(spark, good), 1)
    assert [r["tokens"] for r in splits.collect()] == [["Ali", "keldi"]] and rejected.count() == 0
    with pytest.raises(io.SourceError):
        io.read_tsv(spark, write(tmp_path / "b.tsv", "Sentence\tToken\n1\tx\n"))


def test_jsonl_fails_loudly(spark, tmp_path):
    p = write(tmp_path / "r.jsonl", json.dumps({"id": "a", "tokens": ["x"], "ner_tags": ["O"], "source": "s"}) + "\n")
    assert io.read_records(spark, p).first()["id"] == "a"
    for bad in ("{broken\n", "\n", json.dumps({"id": "a", "tokens": ["x"], "ner_tags": ["I-PER"]}) + "\n", json.dumps({"tokens": ["x"], "ner_tags": ["O"]}) + "\n"):
        with pytest.raises(Exception):  # noqa: B017, PT011 — raised inside the job
            io.read_records(spark, write(tmp_path / "bad.jsonl", bad)).collect()
    assert io.read_protected(spark, write(tmp_path / "p.jsonl", '{"text": "a b"}\n\n{"tokens": ["c", "d"], "ner_tags": 5}\n')).count() == 2


def test_writers_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([("b", 2), ("a", 1)], "id string, n int")
    out = str(tmp_path / "out")
    io.write_jsonl(df, out, "id")
    assert [json.loads(r["value"]) for r in spark.read.text(out).collect()] == [{"id": "a", "n": 1}, {"id": "b", "n": 2}]
    io.write_manifest(out)
    assert io.verify_manifest(out)
    part = next(p for p in os.listdir(out) if p.startswith("part"))
    with open(os.path.join(out, part), "a", encoding="utf-8") as f:
        f.write("x")
    assert not io.verify_manifest(out)
    with pytest.raises(io.SourceError):
        io.write_csv(df, str(tmp_path / "c"), ["id"], "id")
    with pytest.raises(io.SourceError):
        io.guard_outputs([out], [out])


def test_lexicon_and_recordings(spark, tmp_path):
    assert io.read_lexicon(write(tmp_path / "l.json", '{"a": ["x", "y"]}')) == {"a": ["x", "y"]}
    with pytest.raises(io.SourceError):
        io.read_lexicon(write(tmp_path / "m.json", '{"a": ["x", "x"]}'))
    d = tmp_path / "audio"
    d.mkdir()
    (d / "one.wav").write_bytes(b"1")
    (d / "two.ogg").write_bytes(b"22")
    assert {r["stem"] for r in io.list_recordings(spark, str(d)).collect()} == {"one", "two"}
    (d / "two.wav").write_bytes(b"3")
    with pytest.raises(Exception):  # noqa: B017, PT011
        io.list_recordings(spark, str(d)).collect()


def test_stream_equals_batch(spark, tmp_path):
    rows = [("a", "men 1998 yilda keldim", "2025-01-01 10:00:00"), ("b", "ikki ming besh yilda", "2025-01-01 11:00:00"), ("c", "1998 yilda yana", "2025-01-02 10:00:00"), ("d", None, "2025-01-02 10:00:00")]
    df = spark.createDataFrame(rows, "key string, text string, ts string").withColumn("ts", F.to_timestamp("ts"))
    src = str(tmp_path / "in")
    df.write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    q = stream_mined_years(stream).writeStream.format("memory").queryName("mined").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["year"] for r in spark.sql("SELECT year FROM mined").collect()) == [1998, 2005]
    q = windowed_year_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["year"], r["n"]) for r in spark.sql("SELECT year, n FROM counted").collect()) == [(1998, 1), (1998, 1), (2005, 1)]
