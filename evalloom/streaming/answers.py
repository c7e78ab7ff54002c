"""Answers scored as they come in: once per question, whatever arrives again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.operators.label import capture_tags, label_answers

SCHEMA = "qid STRING, field STRING, answerable BOOLEAN, gold_aliases ARRAY<STRING>, lookalike_values ARRAY<STRING>, response STRING, timestamp TIMESTAMP"


def incoming(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_a_batch).json(folder)


def scored_stream(answers: DataFrame, late: str = "1 day") -> DataFrame:
    """Labels and capture tags of a stream of answers. A qid counts once within `late`; its state is dropped after that."""
    once = answers.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["qid"])
    return capture_tags(label_answers(once))


def made_up_rates(scored: DataFrame, window: str = "10 minutes") -> DataFrame:
    """Counts of made-up answers in windows of event time; scored_stream's watermark bounds the state."""
    return scored.where(~F.col("answerable")).groupBy(F.window("timestamp", window), "field").agg(F.count("*").alias("n"), F.count_if(F.col("label") == "made_up").alias("made_up"))


def append_scored(scored: DataFrame, path: str, checkpoint: str):
    """A query that appends scored answers as Parquet; restarted with the same checkpoint, it writes nothing twice."""
    return scored.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
