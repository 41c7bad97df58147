"""Incremental scans: changed files arrive as a stream, and each micro-batch replaces what their repositories had.

This is an addition; the batch operators define the results. A micro-batch writes a new version of the table and then a
mark of its number: one that is replayed after a failure ends in the same content, and one that is marked is passed over,
so that it never lands on top of newer state."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from meshlens.operators.store import Store, replace_by_repo


def follow(changes: DataFrame, store: Store, table: str, extract: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """changes (repo, ...): a stream of whole repositories' files; extract makes the table's rows of a batch."""

    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def apply(batch: DataFrame, number: int) -> None:
        mark = f"{table}-{stream}-{number}"
        if store.exists(mark):
            return
        rows = extract(batch)
        repos = batch.select(F.col("repo").alias("name")).distinct()
        store.write(table, replace_by_repo(store.read(table), rows, repos) if store.exists(table) else rows)
        store.write(mark, batch.sparkSession.createDataFrame([(number,)], "number long"))

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
