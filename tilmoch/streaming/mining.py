"""Years mined from a stream of transcripts: the same operators as the batch, one phrase kept once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilmoch.functions import text as S
from tilmoch.operators.corpus import mined_years


def stream_mined_years(texts: DataFrame, time: str = "ts", key: str = "key", text: str = "text", delay: str = "7 days") -> DataFrame:
    """New phrases of a stream of ``(key, text, ts)``: each phrase key comes out once within the delay.

    State is one row per phrase key and is dropped by the watermark, so it does not
    grow with the stream. An extension: the batch has no time.
    """
    rows = texts.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(time).cast("timestamp").alias("ts")).where("text IS NOT NULL")
    # the time travels in the key, since the miner keeps one key column
    mined = mined_years(rows.select(F.struct("key", "ts").alias("key"), "text"), "text", "key")
    mined = mined.select(F.col("key.key").alias("key"), F.col("key.ts").alias("ts"), "phrase", "year", "suffix", "form", F.array_join(S.word_keys(F.col("phrase")), " ").alias("phrase_key"))
    return mined.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["phrase_key"])


def windowed_year_counts(texts: DataFrame, time: str = "ts", key: str = "key", text: str = "text", window: str = "1 day", delay: str = "7 days") -> DataFrame:
    """Mined years per tumbling window, late rows up to the delay included."""
    rows = texts.select(F.struct(F.col(key).alias("key"), F.col(time).cast("timestamp").alias("ts")).alias("key"), F.col(text).alias("text")).where("text IS NOT NULL")
    mined = mined_years(rows, "text", "key").select(F.col("key.ts").alias("ts"), "year", "form").withWatermark("ts", delay)
    return mined.groupBy(F.window("ts", window).alias("w"), "year", "form").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "year", "form", "n")
