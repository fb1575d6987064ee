"""The same operators on streams: all of them work on one row at a time, so there is no state and no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from proseline.functions.cleaning import TextCleaner
from proseline.operators.chunking import TextChunker, chunk_rows


def read_text_stream(spark: SparkSession, path: str) -> DataFrame:
    """(name, text) of whole files as they come in."""
    return spark.readStream.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))


def chunk_stream(df: DataFrame, text_col: str, chunker: TextChunker, keep: list[str], cleaner: TextCleaner | None = None) -> DataFrame:
    """Cleaned, if asked for, and chunked rows of a stream."""
    text = F.col(text_col) if cleaner is None else cleaner.run(F.col(text_col))
    return chunk_rows(df.select(*keep, text.alias("__in")), "__in", chunker, keep, balance=False)


def write_parquet_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Everything that is there now, exactly once: the file sink keeps a log beside its files."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
