"""Readers with fixed schemas and loud failures, and byte-stable writers."""

from __future__ import annotations

import hashlib
import json
import os
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilmoch.functions import bio as B

AUGMENTATION = "struct<source_id:string,transformations:array<string>,template:string,source_text_form:string,transformation:string>"
RECORD = f"id string, tokens array<string>, ner_tags array<string>, source string, augmentation {AUGMENTATION}"
SOURCE_COLUMNS = ["Sentence", "TokenOrder", "Token", "NER_Tag", "pos"]
AUDIO_SUFFIXES = ["wav", "mp3", "ogg", "flac", "m4a"]


class SourceError(ValueError):
    """A source does not have the form its reader demands."""


def require(df: DataFrame, bad: Column, what: str) -> DataFrame:
    """df with a check that fails the job on the first row where bad holds: no extra pass over the data."""
    first = df.columns[0]
    return df.withColumn(first, F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit(what)).cast(df.schema[first].dataType)).otherwise(F.col(f"`{first}`")))


def read_tsv(spark: SparkSession, path: str, columns: Sequence[str] = SOURCE_COLUMNS) -> DataFrame:
    """SRC1: a tab-separated table of strings whose header holds exactly the columns, in any order."""
    head = spark.read.option("sep", "\t").option("header", True).csv(path).columns
    if sorted(head) != sorted(columns):
        raise SourceError(f"the header is {head}, not {list(columns)}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in head])
    return spark.read.schema(schema).option("sep", "\t").option("header", True).option("mode", "FAILFAST").csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: str, skip_blank: bool = False) -> DataFrame:
    """SRC2 / SRC5 / SRC6: JSON lines of a fixed schema; a broken line fails the job, and a blank one unless skip_blank."""
    if not skip_blank:
        lines = require(spark.read.text(path), F.trim("value") == "", "blank line")
        text = lines.select("value")
    else:
        text = spark.read.text(path).where(F.trim("value") != "")
    return text.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """SRC3: prepared records with an id and strict BIO."""
    df = read_jsonl(spark, path, RECORD)
    bad = F.coalesce(F.trim("id") == "", F.lit(True)) | B.bio_reason(F.col("tokens"), F.col("ner_tags")).isNotNull()
    return require(df, bad, "record without id or with tags that are no BIO")


def read_protected(spark: SparkSession, path: str) -> DataFrame:
    """SRC4: only the texts of a protected file; its labels are never read."""
    df = read_jsonl(spark, path, "text string, tokens array<string>", skip_blank=True)
    out = df.select(F.coalesce("text", F.array_join("tokens", " ")).alias("text"))
    return require(out, F.col("text").isNull(), "protected row without text or tokens")


def read_splits(spark: SparkSession, folder: str, train: str | None = None) -> DataFrame:
    """SRC17: the prepared splits with their names; another file may stand in for train."""
    parts = [read_records(spark, train if s == "train" and train else f"{folder}/{s}.jsonl").withColumn("split", F.lit(s)) for s in ("train", "validation", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def read_text_column(spark: SparkSession, paths: str | list[str], column: str) -> DataFrame:
    """SRC13 / SRC14: one string column of Parquet files; no other column is read."""
    return spark.read.parquet(*([paths] if isinstance(paths, str) else paths)).select(F.col(column).cast("string").alias("text")).where("text IS NOT NULL")


def parquet_shards(folder: str, split: str, config: str | None = None) -> list[str]:
    """SRC15: sorted shards of one split and configuration; none is an error."""
    here = os.path.join(folder, config) if config else folder
    found = sorted(os.path.join(here, f) for f in os.listdir(here) if f.startswith(split) and f.endswith(".parquet"))
    if not found:
        raise SourceError(f"no shards of {split} in {here}")
    return found


def read_lexicon(path: str) -> dict[str, list[str]]:
    """SRC8 to SRC11: a JSON object of word lists, a small file read on the driver; repeated words are an error."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    if not isinstance(data, dict) or not all(isinstance(v, list) and all(isinstance(w, str) and w for w in v) for v in data.values()):
        raise SourceError("a lexicon is an object of lists of words")
    for name, words in data.items():
        if len(set(words)) != len(words):
            raise SourceError(f"repeated words in {name}")
    return data


def lexicon_table(spark: SparkSession, lists: dict[str, list[str]]) -> DataFrame:
    """A lexicon as ``(list_name, key)`` rows."""
    return spark.createDataFrame([(n, w) for n, ws in lists.items() for w in ws], "list_name string, key string")


def read_sheet(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    """SRC12: rows of one worksheet as ``(row_number, cells)``; only the workbook's XML is parsed."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "p": "http://schemas.openxmlformats.org/package/2006/relationships"}
    with zipfile.ZipFile(path) as z:
        book = ET.fromstring(z.read("xl/workbook.xml"))
        rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels")).findall("p:Relationship", ns)}
        ids = {s.get("name"): s.get(f"{{{ns['r']}}}id") for s in book.find("m:sheets", ns)}
        if sheet not in ids:
            raise SourceError(f"no sheet {sheet}")
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{{{ns['m']}}}t")) for s in ET.fromstring(z.read("xl/sharedStrings.xml"))]
        target = rels[ids[sheet]].lstrip("/")
        rows = []
        for r in ET.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{{{ns['m']}}}row"):
            cells: list[str | None] = []
            for c in r.findall("m:c", ns):
                col = 0
                for ch in "".join(x for x in c.get("r", "A1") if x.isalpha()):
                    col = col * 26 + ord(ch) - 64
                cells += [None] * (col - 1 - len(cells))
                v, inline = c.find("m:v", ns), c.find("m:is", ns)
                text = "".join(t.text or "" for t in inline.iter(f"{{{ns['m']}}}t")) if inline is not None else None if v is None else v.text
                cells.append(shared[int(text)] if c.get("t") == "s" and text is not None else text)
            rows.append((int(r.get("r", len(rows) + 1)), cells))
    return spark.createDataFrame(rows, "row_number int, cells array<string>")


def list_recordings(spark: SparkSession, folder: str) -> DataFrame:
    """SRC22: one audio file per stem; two files of one stem fail. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("length").alias("bytes"))
    files = files.withColumn("stem", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)).where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*AUDIO_SUFFIXES))
    return require(files.groupBy("stem").agg(F.min("path").alias("path"), F.max("bytes").alias("bytes"), F.count("*").alias("_n")), F.col("_n") > 1, "two recordings of one stem").drop("_n")


def guard_outputs(outputs: Iterable[str], inputs: Iterable[str]) -> None:
    """No output may be an input or another output."""
    out = [os.path.realpath(p) for p in outputs]
    if len(set(out)) != len(out) or set(out) & {os.path.realpath(p) for p in inputs}:
        raise SourceError("outputs must differ from each other and from all inputs")


def write_jsonl(df: DataFrame, path: str, key: str) -> None:
    """SNK1: JSON lines with sorted keys in key order; Spark's commit makes the folder appear whole."""
    cols = [F.col(f"`{c}`") for c in sorted(df.columns)]
    df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("value"), F.col(f"`{key}`").alias("_k")).sort("_k").select("value").write.mode("errorifexists").text(path)


def write_csv(df: DataFrame, path: str, fields: Sequence[str], key: str) -> None:
    """SNK3 / SNK7: exactly the fields, in key order; further columns are an error."""
    extra = set(df.columns) - set(fields)
    if extra:
        raise SourceError(f"columns that are not written: {sorted(extra)}")
    df.select(*fields).sort(key).write.mode("errorifexists").option("header", True).csv(path)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """SNK6: one folder per split."""
    df.write.mode("errorifexists").partitionBy(split).json(path)


def folder_digest(folder: str) -> dict[str, dict]:
    """Size and SHA-256 of every file of a folder but its manifest. Folders of this machine or a mounted file system."""
    out = {}
    for root, _, names in os.walk(folder):
        for n in sorted(names):
            p = os.path.join(root, n)
            if not n.startswith("_manifest.json") and not n.endswith(".crc"):
                h = hashlib.sha256()
                with open(p, "rb") as f:
                    for block in iter(lambda: f.read(1 << 20), b""):
                        h.update(block)
                out[os.path.relpath(p, folder)] = {"bytes": os.path.getsize(p), "sha256": h.hexdigest()}
    return out


def write_manifest(folder: str) -> dict[str, dict]:
    """SNK5: sizes and SHA-256 of all files of a finished folder, written last."""
    out = folder_digest(folder)
    _atomic(os.path.join(folder, "_manifest.json"), json.dumps(out, sort_keys=True, indent=1))
    return out


def verify_manifest(folder: str) -> bool:
    """Whether a folder holds exactly the files of its manifest, unchanged; nothing is written."""
    with open(os.path.join(folder, "_manifest.json"), encoding="utf-8") as f:
        return json.load(f) == folder_digest(folder)


def _atomic(path: str, text: str) -> None:
    """A small text file that appears whole or not at all."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    tmp = f"{path}.{os.getpid()}.tmp"
    try:
        with open(tmp, "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(tmp, path)
    finally:
        if os.path.exists(tmp):
            os.remove(tmp)


def write_statistics(row: DataFrame | dict, path: str) -> dict:
    """SNK2: one row of statistics as pretty JSON with sorted keys; more than one row is an error."""
    if isinstance(row, DataFrame):
        rows = row.limit(2).collect()
        if len(rows) != 1:
            raise SourceError("statistics are one row")
        row = rows[0].asDict(recursive=True)
    _atomic(path, json.dumps(row, ensure_ascii=False, sort_keys=True, indent=2, default=str) + "\n")
    return row


def write_text(path: str, text: str) -> None:
    """SNK4: a text report in one step."""
    _atomic(path, text)


def write_recording_plan(prompts: DataFrame, speakers: DataFrame, path: str) -> DataFrame:
    """SNK8 / JOIN5: one row per prompt and speaker with an unchecked checklist, as CSV; a path that exists is an error.

    The product is the plan itself; both sides are fixed lists.
    """
    plan = prompts.select(F.col("id").alias("prompt_id")).crossJoin(speakers.select("speaker_id"))
    name = F.concat("prompt_id", F.lit("--"), "speaker_id")
    no = [F.lit(False).alias(c) for c in ("consent_confirmed", "recorded", "transcript_reviewed", "entity_spans_reviewed")]
    plan = plan.select(name.alias("recording_id"), "speaker_id", "prompt_id", F.concat(F.lit("audio/"), name, F.lit(".wav")).alias("audio_file"), *no)
    write_csv(plan, path, plan.columns, "recording_id")
    return plan
