"""Readers of text files and of JSON fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proseline.functions.cleaning import trim

SPLIT_CASES = T.StructType([T.StructField("content", T.StringType(), False), T.StructField("cases", T.ArrayType(T.StringType()))])
LIMITS = (64, 128, 256, 512, 768, 1024, 1536, 2048)
_CASE = T.StructType([T.StructField("first", T.StringType()), T.StructField("last", T.StringType())])
CHUNK_CASES = T.StructType([T.StructField("content", T.StringType(), False), T.StructField("test_cases", T.StructType([T.StructField(f"case_{n}", _CASE) for n in LIMITS]))])


def read_texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(name, content): one row for each whole file, untrimmed. A file of nothing but white space raises when it is read."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value"))
    content = F.when(trim(F.col("value")) == "", F.raise_error(F.concat(F.lit("empty file: "), F.col("file"))).cast("string")).otherwise(F.col("value"))
    return files.select(F.regexp_replace("file", r"\.[^.]*$", "").alias("name"), content.alias("content"))


def read_split_cases(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(content, cases); malformed JSON raises."""
    return spark.read.json(path, schema=SPLIT_CASES, multiLine=True, mode="FAILFAST")


def read_chunk_cases(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(content, test_cases); malformed JSON raises."""
    return spark.read.json(path, schema=CHUNK_CASES, multiLine=True, mode="FAILFAST")


def chunk_case(limit: int):  # noqa: ANN201
    """The expected first and last chunk for one limit, as a column of read_chunk_cases()."""
    if limit not in LIMITS:
        raise ValueError(f"no case for {limit}; there are {LIMITS}")
    return F.col(f"test_cases.case_{limit}")
