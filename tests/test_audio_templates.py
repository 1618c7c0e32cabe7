import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilmoch.functions import bio as B
from tilmoch.operators import audio as U
from tilmoch.operators import templates as TP
from tilmoch.sources import io


def test_templates_are_strict(spark):
    df = spark.createDataFrame([("a", ["Ali", "Vali", "keldi"], ["B-PER", "I-PER", "O"]), ("b", ["Chust"], ["B-LOC"])], "id string, tokens array<string>, ner_tags array<string>")
    t = TP.authored_templates(spark, df)
    rows = t.withColumn("bad", B.bio_reason(F.col("tokens"), F.col("ner_tags"))).collect()
    assert not [r for r in rows if r["bad"]] and len({r["id"] for r in rows}) == len(rows)
    text = {" ".join(r["tokens"]): r["ner_tags"] for r in rows}
    assert text["bugun ali vali bilan uchrashamiz"] == ["B-TEMPORAL", "B-PER", "I-PER", "O", "O"]
    assert text["chust shahrida boraman"] == ["B-LOC", "I-LOC", "O"]
    assert text["oʻn oltinchi may kuni kelaman"] == ["B-TEMPORAL"] + ["I-TEMPORAL"] * 3 + ["O"]
    assert "ikki ming besh yil boshlandi" not in text and "ikki ming va olti yilda uchrashamiz" in text


@pytest.mark.parametrize("seconds", [2, 9, 31])
def test_cuts_cover_and_stay_short(spark, seconds):
    x = np.random.default_rng(seconds).normal(0, 0.1, seconds * 800)
    ends = U._cut_points(x, 800, 6.0)
    assert ends[-1] == len(x) and all(0 < b - a <= 4800 for a, b in zip([0, *ends], ends))
    df = spark.createDataFrame([(x.tolist(),), (None,), ([],)], "s array<double>")
    got = [r[0] for r in df.select(U.quiet_cuts(F.col("s"), F.lit(800), F.lit(6.0))).collect()]
    assert got == [ends, None, [0]]


def test_wav_header(spark):
    head = b"RIFF" + struct.pack("<I", 36) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, 16000, 64000, 4, 16) + b"data" + struct.pack("<I", 0)
    df = spark.createDataFrame([(bytearray(head),), (bytearray(b"OggS....................................."),)], "c binary")
    got = [r[0] for r in df.select(U.wav_header(F.col("c"))).collect()]
    assert tuple(got[0]) == (2, 16000, 16, True) and got[1] is None


def test_worksheet(spark, tmp_path):
    m = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    r = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    p = "http://schemas.openxmlformats.org/package/2006/relationships"
    path = str(tmp_path / "b.xlsx")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{m}" xmlns:r="{r}"><sheets><sheet name="One" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{p}"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{m}"><si><t>Token</t></si><si><r><t>Ta</t></r><r><t>g</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{m}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="2"><c r="B2"><v>7</v></c><c r="C2" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>')
    assert [tuple(x) for x in io.read_sheet(spark, path, "One").collect()] == [(1, ["Token", None, "Tag"]), (2, [None, "7", "x"])]
    with pytest.raises(io.SourceError):
        io.read_sheet(spark, path, "Two")
