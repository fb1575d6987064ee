"""Statistics of chunks, as plain aggregations over exploded chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chunk_statistics(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, averages (whole numbers), largest and smallest sizes in tokens and characters, by keys.

    Rows without a count, as texts that cannot be chunked have, are no chunks.
    """
    chunks = chunks.where("token_count is not null")
    out = [F.count("*").alias("chunk_count")]
    for unit in ("token", "char"):
        n = F.col(f"{unit}_count").cast("long")
        out += [F.floor(F.sum(n) / F.count("*")).alias(f"avg_{unit}_size"), F.max(n).alias(f"largest_{unit}_size"), F.min(n).alias(f"smallest_{unit}_size"), F.sum(n).alias(f"all_chunks_{unit}_count")]
    return chunks.groupBy(*keys).agg(*out)


def chunk_sizes(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Each text's chunk sizes in order, besides its statistics. For keys of one text: the lists grow with its chunks."""
    sized = chunks.where("token_count is not null").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("chunk_idx", "token_count", "char_count"))).alias("s"), F.first("separator").alias("initial_separator"))
    lists = sized.select(*keys, "initial_separator", F.transform("s", lambda x: x["token_count"]).alias("chunk_token_sizes"), F.transform("s", lambda x: x["char_count"]).alias("chunk_char_sizes"))
    return chunk_statistics(chunks, keys).join(lists, keys)


def balance(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """The balance report: how many chunks, and their average, largest and smallest tokens."""
    return chunk_statistics(chunks, keys).select(*keys, "chunk_count", "avg_token_size", "largest_token_size", "smallest_token_size")
