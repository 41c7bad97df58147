"""How many partitions a table's rows are dealt to, so that what a task sorts or groups doesn't grow with the table."""

from __future__ import annotations

from pyspark.sql import DataFrame


def partitions_for(rows: DataFrame, each: int = 400_000) -> int | None:
    """The partitions that rows take at some each a partition; none if they are too few to fill the cores. A number of its own also
    keeps Spark from joining partitions that are small only while they are compressed. Of a Parquet table only footers are read."""
    n = -(-rows.count() // each)
    return n if n > rows.sparkSession.sparkContext.defaultParallelism else None


def dealt(df: DataFrame, n: int | None, *keys: str) -> DataFrame:
    """df by keys in n partitions, so that grouping and joining by them needs no further shuffle; df itself without n."""
    return df if n is None else df.repartition(n, *keys)
