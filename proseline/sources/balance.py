"""Spreading small tables over all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes a core up to which dealing a table out costs little.
SMALL = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out evenly if it has no more than SMALL bytes for each core, by the size that the planner knows.

    A file of one row group is one task, however many cores there are. Larger tables are left
    alone: for them a shuffle of all text would cost more than it gives. No files are listed.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= cores * SMALL else df
