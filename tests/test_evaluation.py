import json

import pytest
from pyspark.sql import functions as F

from tilmoch.operators import reports as R
from tilmoch.plans import pipeline as PL
from tilmoch.sources import evaluation as E
from tilmoch.sources import io

SAMPLE = {"id": "a", "file": "audio/a.wav", "gold_transcript": "Ali keldi", "entities": [{"text": "Ali", "label": "PER", "start": 0, "end": 3}], "speaker_id": "s1", "conditions": ["quiet"]}


def lines(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows), encoding="utf-8")
    return str(path)


def test_metadata_is_strict(spark, tmp_path):
    assert E.read_metadata(spark, lines(tmp_path / "a", [SAMPLE])).first()["entities"][0]["text"] == "Ali"
    span = SAMPLE["entities"][0]
    wrong = [
        {"file": "../a.wav"}, {"file": "/a.wav"}, {"entities": [span | {"end": 4}]}, {"entities": [span, span]}, {"entities": [span | {"label": "X"}]}, {"conditions": []}, {"conditions": ["quiet", "quiet"]},
        {"speaker_id": " "}, {"further": 1}, {"entities": [span | {"start": None}]},
    ]
    for i, change in enumerate(wrong):
        with pytest.raises(Exception):  # noqa: B017, PT011 — raised inside the job
            E.read_metadata(spark, lines(tmp_path / f"w{i}", [SAMPLE | change])).collect()
    with pytest.raises(io.SourceError):
        E.read_metadata(spark, lines(tmp_path / "twice", [SAMPLE, SAMPLE | {"file": "audio/b.wav"}]))


def test_checklist(spark, tmp_path):
    samples = E.read_metadata(spark, lines(tmp_path / "m", [SAMPLE]))
    head = ",".join(E.CHECKLIST)
    write = lambda name, text: (tmp_path / name).write_text(text) and str(tmp_path / name)
    good = E.read_checklist(spark, write("g.csv", f"{head}\na,s1,p,audio/a.wav,true,FALSE,false,false\n"), samples).first()
    assert good["consent_confirmed"] is True and good["recorded"] is False
    for i, row in enumerate(["b,s1,p,audio/a.wav,true,true,true,true", "a,s2,p,audio/a.wav,true,true,true,true", "a,s1,p,audio/a.wav,yes,true,true,true"]):
        with pytest.raises(Exception):  # noqa: B017, PT011
            E.read_checklist(spark, write(f"b{i}.csv", f"{head}\n{row}\n"), samples).collect()
    with pytest.raises(io.SourceError):
        E.read_checklist(spark, write("h.csv", "recording_id\na\n"), samples)


def test_reviewed_names(spark, tmp_path):
    write = lambda name, data: (tmp_path / name).write_text(json.dumps(data)) and str(tmp_path / name)
    assert E.read_counted_names(spark, write("c.json", {"names": {"Ali": 3, "Vali": 1}})).count() == 2
    assert E.read_person_names(spark, write("n.json", {"names": ["Ali"]})).first()["canonical"] == "Ali"
    phrase = E.read_person_phrases(spark, write("p.json", {"phrases": [{"phrase": "alisher navoiy", "canonical": "Alisher Navoiy"}]})).first()
    assert phrase["key"] == ["alisher", "navoiy"]
    for read, data in ((E.read_person_names, {"names": ["Ali", "ALI"]}), (E.read_person_names, {"names": []}), (E.read_person_phrases, {"phrases": [{"phrase": "ali", "canonical": "Ali"}]}), (E.read_counted_names, {"names": 5})):
        with pytest.raises(io.SourceError):
            read(spark, write("x.json", data))


def test_runs(spark, tmp_path):
    def run(name, value, pointer=0.5, checkpoint="checkpoint-1"):
        root = tmp_path / name
        (root / "checkpoint-1").mkdir(parents=True)
        for f, data in (("best_checkpoint.json", {"checkpoint": checkpoint, "metric_for_best_model": "overall_f1", "metric_value": pointer}), ("run_metadata.json", {"best_checkpoint": checkpoint}), ("eval_metrics.json", {"eval_overall_f1": value}), ("evaluation_test_metrics.json", {"test_f1": 0.4})):
            (root / f).write_text(json.dumps(data))
        return str(root)

    got = E.read_runs(spark, {"a": run("a", 0.5)}, ["eval_overall_f1"], ["test_f1"])
    assert sorted(map(tuple, got.collect())) == [("a", "test", "test_f1", 0.4), ("a", "validation", "eval_overall_f1", 0.5)]
    for i, kw in enumerate(({"value": 1.5}, {"value": 0.6}, {"value": 0.5, "checkpoint": "../a"})):
        with pytest.raises(io.SourceError):
            E.read_runs(spark, {"b": run(f"b{i}", **kw)}, ["eval_overall_f1"], ["test_f1"])


def test_shards_are_checked(spark):
    kind = "id string, tokens array<string>, ner_tags array<string>, source string, augmentation struct<source_text_form:string,transformation:string>"
    good = ("x", ["ikki", "ming", "yilda"], ["B-TEMPORAL", "I-TEMPORAL", "I-TEMPORAL"], "hf:d@r", None)
    assert PL.merged_years(spark.createDataFrame([good, good], kind), "d", "r").first()["year"] == 2000
    for bad in (good[:3] + ("hf:e@r", None), ("x", ["ikki", "ming", "kun"], *good[2:]), ("x", ["bir", "yil"], ["B-TEMPORAL", "I-TEMPORAL"], "hf:d@r", None), ("x", good[1], ["O", "I-PER", "O"], "hf:d@r", None), good[:4] + (("1", "other"),)):
        with pytest.raises(Exception, match="shard record"):
            PL.merged_years(spark.createDataFrame([bad], kind), "d", "r").collect()


def test_report_gate(spark):
    records = spark.createDataFrame([("a", [], [], [])], "id string, stt_error array<string>, ner_error array<string>, normalization_error array<string>")
    samples = spark.createDataFrame([("a", "s", [], ["quiet"], 9.0)], "id string, speaker_id string, entities array<struct<label:string>>, conditions array<string>, seconds double")
    with pytest.raises(ValueError, match="not compliant"):
        R.run_report(records, samples, "E", "x")
    text, status = R.run_report(records, samples, "E", "x", gate=False)
    assert text.startswith("# Error analysis\n") and "PROVISIONAL" in text and not status["compliant"] and text.endswith(" |\n")
    with pytest.raises(ValueError, match="cover"):
        R.run_report(records.withColumn("id", F.lit("b")), samples, "E", "x", gate=False)


def test_statistics_and_chunks(spark, tmp_path):
    p = str(tmp_path / "d" / "s.json")
    io.write_statistics(spark.createDataFrame([(1, "oʻ")], "b int, a string"), p)
    assert open(p, encoding="utf-8").read() == '{\n  "a": "oʻ",\n  "b": 1\n}\n'
    with pytest.raises(io.SourceError):
        io.write_statistics(spark.range(2), p)
    df = spark.createDataFrame([(n, list(range(n))) for n in (0, 1, 4, 5, 9, 10)], "id int, u array<int>")
    rows = PL.overflow_chunks(df, "id", "u", 4).collect()
    for n in (0, 1, 4, 5, 9, 10):
        own = sorted((r["first"], r["units"]) for r in rows if r["id"] == n)
        assert {x for _, u in own for x in u} == set(range(n)) and all(len(u) <= 4 for _, u in own)
        assert all(b - a == 3 for (a, _), (b, _) in zip(own, own[1:]))
