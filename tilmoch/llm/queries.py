"""The pN_ queries: each operator with its production parameters on its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilmoch.llm import oracles as O
from tilmoch.llm.consistent import consistent_texts
from tilmoch.llm.cross_split import cross_split_pairs
from tilmoch.llm.eval_leaks import leaks, without_leaks
from tilmoch.llm.format_copies import copy_counts, payload_records, record_copies
from tilmoch.llm.mixing import mix, shares
from tilmoch.llm.near_duplicates import group_pairs, near_duplicate_groups
from tilmoch.llm.packing import fill_report, pack
from tilmoch.llm.quality import text_quality
from tilmoch.llm.text_columns import joined, plain_key
from tilmoch.llm.tokens import language, slice_totals, source_name, token_counts


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of every document and record, with one name per source, one spelling per language, and the domain."""
    cat = table(spark, sf, "source_catalog").groupBy(source_name(F.col("source")).alias("k")).agg(F.min(F.struct(F.col("source").alias("name"), F.col("lang").alias("cat_lang"), F.col("domain").alias("cat_domain"))).alias("c")).select("k", "c.*")
    docs, ner = table(spark, sf, "documents"), table(spark, sf, "ner_records")
    # what a row is labelled with travels beside its key, so that no join brings it back; each table is counted on its own, once
    doc = token_counts(docs.select(F.struct(F.col("doc_id").cast("string").alias("id"), "source", "lang", "domain").alias("key"), "text"), "key", F.col("text"))
    rec = token_counts(ner.select(F.struct("id", "source").alias("key"), joined(F.col("tokens")).alias("text")), "key", F.col("text"))
    # a second delivery is the same row: its key counts once
    rec = rec.groupBy("key.id").agg(F.max("tokens").alias("tokens"), F.max("key.source").alias("source"), F.max("cyrillic").alias("cyrillic"))
    none = F.lit(None).cast("string")
    n = doc.select(F.lit("documents").alias("tbl"), "key.id", "key.source", "key.lang", "key.domain", "tokens", "cyrillic")
    n = n.unionByName(rec.select(F.lit("ner_records").alias("tbl"), "id", "source", none.alias("lang"), none.alias("domain"), "tokens", "cyrillic"))
    n = n.join(cat, source_name(F.col("source")) == F.col("k"), "left")
    return n.select(
        "tbl", F.col("id").alias("row_key"), "tokens", F.coalesce("name", F.when(F.col("source").isNotNull(), source_name(F.col("source"))), F.lit("unknown")).alias("source"),
        language(F.col("lang"), F.col("cat_lang"), F.col("cyrillic")).alias("lang"), F.coalesce("domain", "cat_domain", F.lit("unknown")).alias("domain"),
    )


def p1_totals(spark: SparkSession, sf: str) -> DataFrame:
    return slice_totals(p1_rows(spark, sf))


def p1_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, rows without a token, and totals of a slicing that miss the whole, per table."""
    rows = p1_rows(spark, sf)
    total = slice_totals(rows).groupBy("tbl", "level").agg(F.sum("rows").alias("r"), F.sum("tokens").alias("t")).groupBy("tbl").agg((F.countDistinct("r", "t") - 1).alias("missed"))
    return rows.groupBy("tbl").agg(F.count("*").alias("rows"), F.count_if(F.col("tokens") == 0).alias("empty")).join(total, "tbl")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    ner = record_copies(table(spark, sf, "ner_records"), "id", F.col("tokens"), F.col("source"))
    raw = payload_records(table(spark, sf, "raw_lines"), "line_id", "payload")
    raw = record_copies(raw, "key", F.col("tokens"), F.col("source"))
    both = ner.select(F.lit("ner_records").alias("tbl"), "first_key", "copy_key")
    return both.unionByName(raw.select(F.lit("raw_lines").alias("tbl"), "first_key", "copy_key"))


def p2_copies(spark: SparkSession, sf: str) -> DataFrame:
    """Each group of copies once, with its number of records."""
    found = p2_found(spark, sf)
    return copy_counts(found.select(F.struct("tbl", "first_key").alias("first_key"))).select("first_key.tbl", "first_key.first_key", "copies")


def _corpora(spark: SparkSession, sf: str) -> DataFrame:
    ner = table(spark, sf, "ner_records").where("split = 'train'").select(F.concat(F.lit("n"), "id").alias("row_key"), joined(F.col("tokens")).alias("text"))
    docs = table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("row_key"), "text")
    return ner.unionByName(docs)


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "prompts").select(F.col("id").alias("item_id"), "text").unionByName(table(spark, sf, "speech_ner_eval").select(F.col("id").alias("item_id"), "text"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    hits = leaks(_corpora(spark, sf), _items(spark, sf))
    corpus = F.when(F.col("row_key").startswith("n"), "ner_records").otherwise("documents")
    return hits.select(corpus.alias("corpus"), F.expr("substring(row_key, 2)").alias("row_key"), "item_id")


def p3_clean(spark: SparkSession, sf: str) -> DataFrame:
    """The corpora without the leaked spans, and how many words each row lost."""
    rows = without_leaks(_corpora(spark, sf), _items(spark, sf))
    corpus = F.when(F.col("row_key").startswith("n"), "ner_records").otherwise("documents")
    return rows.select(corpus.alias("corpus"), F.expr("substring(row_key, 2)").alias("row_key"), "text", "removed_words")


def p3_untouched(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of the rows that hold no item, which stay when leaking rows are removed whole."""
    rows = without_leaks(_corpora(spark, sf), _items(spark, sf), documents=True)
    corpus = F.when(F.col("row_key").startswith("n"), "ner_records").otherwise("documents")
    return rows.select(corpus.alias("corpus"), F.expr("substring(row_key, 2)").alias("row_key")).distinct()


def _fields(spark: SparkSession, sf: str) -> DataFrame:
    parts = [
        consistent_texts(table(spark, sf, "ner_records"), "id", "tokens", "ner_records.tokens"),
        consistent_texts(table(spark, sf, "stt_predictions"), "prediction_id", "raw_transcript", "stt_predictions.raw_transcript"),
        consistent_texts(table(spark, sf, "prompts"), "id", "text", "prompts.text"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _fields(spark, sf).where("changed").select("field", "row_key").distinct()


def p4_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Every text in consistent form, and whether it needed it."""
    return _fields(spark, sf)


def _cross(spark: SparkSession, sf: str) -> DataFrame:
    ner = table(spark, sf, "ner_records")
    return cross_split_pairs(ner, "id", F.col("tokens"), F.when(F.col("split") == "train", False).when(F.col("split").isin("validation", "test"), True))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _cross(spark, sf).where("eval_id <> train_id")
    return pairs.select(F.least("eval_id", "train_id").alias("id_a"), F.greatest("eval_id", "train_id").alias("id_b")).distinct()


def p5_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Overlapping pairs, evaluation records and training records per evaluation split and source."""
    ner = table(spark, sf, "ner_records").select("id", "split", plain_key(F.col("source")).alias("source_key"))
    first = ner.groupBy("id").agg(F.min("split").alias("split"), F.min("source_key").alias("source_key"))
    pairs = _cross(spark, sf).join(first.withColumnRenamed("id", "eval_id"), "eval_id")
    return pairs.groupBy("split", "source_key").agg(F.count("*").alias("pairs"), F.countDistinct("eval_id").alias("eval_ids"), F.countDistinct("train_id").alias("train_ids"))


def _groups(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicate_groups(table(spark, sf, "ner_records"), "id", F.col("tokens"), F.col("source"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return group_pairs(_groups(spark, sf))


def p6_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Group of each near-duplicate id."""
    return _groups(spark, sf)


def _doc_tokens(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.struct("doc_id", *more).alias("key"), "text")
    return token_counts(docs, "key", F.col("text")).select("key.*", "tokens")


def p7_placed(spark: SparkSession, sf: str) -> DataFrame:
    """Container of each document, or of each part of one above the capacity, for each capacity."""
    specs = [(r["spec_id"], r["capacity_tokens"]) for r in table(spark, sf, "container_specs").select("spec_id", "capacity_tokens").toLocalIterator()]
    return pack(_doc_tokens(spark, sf), specs)


def p7_fill(spark: SparkSession, sf: str) -> DataFrame:
    return fill_report(p7_placed(spark, sf))


def p7_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Documents, overfull containers and documents cut without need of each capacity, and whether it takes more than one percent of containers too many."""
    placed = p7_placed(spark, sf)
    per = placed.groupBy("spec_id", "doc_id").agg(F.count("*").alias("parts"), F.sum("tokens").alias("n"), F.max("capacity_tokens").alias("cap"))
    per = per.groupBy("spec_id").agg(F.count("*").alias("documents"), F.count_if((F.col("n") <= F.col("cap")) & (F.col("parts") > 1)).alias("split_in_vain"))
    fill = fill_report(placed).select("spec_id", (F.col("fullest") > F.col("capacity_tokens")).cast("bigint").alias("overfull"), (F.col("containers") > 1.01 * F.col("least") + 1).cast("bigint").alias("wasteful"))
    return per.join(fill, "spec_id")


def _targets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "mix_targets").withColumn("source", source_name(F.col("source")))


def p8_uses(spark: SparkSession, sf: str) -> DataFrame:
    """Uses of every document of a plan's sources."""
    docs = _doc_tokens(spark, sf, "source").withColumn("source", source_name(F.col("source")))
    return mix(docs, _targets(spark, sf))


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return shares(p8_uses(spark, sf), _targets(spark, sf))


def p8_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Targets of each plan, those used beyond their repeats, the sum of the actual shares, and sources that miss their share by more than one document of each source explains."""
    uses = p8_uses(spark, sf)
    most = uses.groupBy("plan", "source").agg(F.max("tokens").alias("longest"))
    s = shares(uses, _targets(spark, sf)).join(most, ["plan", "source"], "left")
    all_ = s.where("have_tokens > 0").groupBy("plan").agg(F.sum("target_share").alias("able"), F.sum("longest").alias("slack"))
    s = s.join(all_, "plan")
    want = F.col("target_share") / F.col("able")
    far = (F.col("have_tokens") > 0) & (F.abs(F.col("used_tokens") - want * F.col("plan_tokens")) > F.col("longest") + want * F.col("slack"))
    return s.groupBy("plan").agg(F.count("*").alias("targets"), F.count_if(F.col("most_uses") > F.col("max_repeats")).alias("over_repeated"), F.round(F.sum("actual_share"), 6).alias("whole"), F.count_if(far).alias("missed"))


def _quality(spark: SparkSession, sf: str) -> DataFrame:
    return text_quality(table(spark, sf, "documents"), "doc_id", F.col("text")).withColumnRenamed("key", "doc_id")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return _quality(spark, sf).where("kind <> 'prose'").select("doc_id")


def p9_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return _quality(spark, sf)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_checks": O.P1_CHECKS, "p2_found": O.P2, "p3_found": O.P3, "p5_found": O.P5, "p6_found": O.P6, "p6_groups": O.P6_GROUPS, "p7_checks": O.P7_CHECKS, "p8_checks": O.P8_CHECKS,
    }
