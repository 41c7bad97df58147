"""Notes that outlive a session: a table (id, repo, kind, note, created_at)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlens.operators.store import append_with_ids

# The kinds of notes; any other kind is a note.
KINDS = ("pattern", "convention", "gotcha", "note")
SCHEMA = "id long, repo string, kind string, note string, created_at string"


def known_kind(kind):
    return F.when(kind.isin(*KINDS), kind).otherwise(F.lit("note"))


def remember(memory: DataFrame, notes: DataFrame, *order: str) -> DataFrame:
    """memory with notes (repo, kind, note, created_at) behind it, numbered on in the given order."""
    return append_with_ids(memory, notes.withColumn("kind", known_kind(F.col("kind"))), *order).select("id", "repo", "kind", "note", "created_at")


def recall(memory: DataFrame, repo: str, kind: str | None = None) -> DataFrame:
    """A repository's notes, those of one kind if it is given, oldest first."""
    rows = memory.where(F.col("repo") == repo)
    return (rows.where(F.col("kind") == kind) if kind else rows).orderBy("id")


def forget(memory: DataFrame, ids: DataFrame) -> DataFrame:
    """memory without the notes of ids (id)."""
    return memory.join(ids, "id", "left_anti")
