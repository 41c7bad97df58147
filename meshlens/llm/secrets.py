"""Secret scans with an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its content. Content is scanned once for
each rule version, however many paths or versions hold it, and pairs that the ledger already has
aren't scanned again. Findings are joined back to all paths.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlens.llm.common import Scratch

# The patterns of the base kinds, in their listed order, with the least length that counts.
RULES: dict[str, tuple[str, int, int, int]] = {
    "assign": (r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6, 1),
    "access": (r"AKIA[A-Z0-9]+", 0, 20, 1),
    "hex": (r"[0-9a-f]{24,}", 0, 24, 1),
    "pem": (r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 1, 1),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 1, 1),
}
BASE = ("assign", "access", "hex")
FOUND = "blob binary, findings array<struct<kind string, version int, spans array<struct<begin int, stop int>>>>"


def spans(pattern: re.Pattern, group: int, least: int, text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches whose group has at least so many characters, in code points."""
    return [m.span() for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]


def scan(blobs: DataFrame, rules: dict = RULES) -> DataFrame:
    """blobs (blob, text, kinds to scan) -> FOUND, with a finding list, maybe empty, for each kind asked for."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = {k: re.compile(p) for k, (p, _, _, _) in rules.items()}
        for frame in frames:
            out = []
            for text, kinds in zip(frame["text"], frame["kinds"]):
                out.append([{"kind": k, "version": rules[k][3], "spans": [{"begin": a, "stop": b} for a, b in spans(compiled[k], rules[k][1], rules[k][2], text)]} for k in kinds])
            yield pd.DataFrame({"blob": frame["blob"], "findings": out})

    return blobs.select("blob", "text", "kinds").mapInPandas(run, FOUND)


class Ledger:
    """A table of FOUND rows in a folder that all executors share: what every scan so far has found, with an
    entry for each pair of content and rule version that has been scanned. Scans only append to it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        spark.createDataFrame([], FOUND).write.mode("ignore").parquet(folder)

    @classmethod
    def named(cls, spark: SparkSession) -> Ledger:
        """The ledger in the folder that the session's spark.meshlens.secrets.ledger names, which later runs go on with;
        without that setting a new one that nothing else uses."""
        return cls(spark, spark.conf.get("spark.meshlens.secrets.ledger", None) or f"{Scratch(spark, 'secrets').root}/ledger")

    def read(self) -> DataFrame:
        return self.spark.read.schema(FOUND).parquet(self.folder)

    def update(self, versions: DataFrame, text: str = "text", rules: dict = RULES) -> None:
        """Scan the content of versions for the rule versions it hasn't been scanned for, and keep what is found."""
        scan_unseen(versions, self.read(), text, rules).write.mode("append").parquet(self.folder)

    def spans(self, rules: dict = RULES) -> DataFrame:
        """blob, and spans: all findings by the rules' present versions, by start and then by the rules' order. Only
        content with a finding has a row."""
        place = F.create_map(*[x for i, k in enumerate(rules) for x in (F.lit(k), F.lit(i))])
        present = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(r[3]).alias("version")) for k, r in rules.items()])
        kept = F.filter("findings", lambda f: F.array_contains(present, F.struct(f["kind"].alias("kind"), f["version"].alias("version"))))
        flat = F.flatten(F.transform(kept, lambda f: F.transform(f["spans"], lambda s: F.struct(s["begin"].alias("begin"), place[f["kind"]].alias("place"), s["stop"].alias("stop"), f["kind"].alias("kind")))))
        each = self.read().select("blob", flat.alias("spans")).where(F.size("spans") > 0)
        # a blob has a row for each scan that had a rule version new to it
        return each.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))


def scan_unseen(versions: DataFrame, ledger: DataFrame, text: str = "text", rules: dict = RULES) -> DataFrame:
    """FOUND for the pairs of content and rule version that the ledger (rows of FOUND) doesn't have.

    Null content is empty content. The content is grouped by its address, one row a task and address
    at most, so a third of all rows with one content are no hot group."""
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    blobs = versions.select(F.unhex(F.sha2(content, 256)).alias("blob"), content.alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    present = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(r[3]).alias("version")) for k, r in rules.items()])
    scanned = F.transform("findings", lambda f: F.struct(f["kind"].alias("kind"), f["version"].alias("version")))
    have = ledger.groupBy("blob").agg(F.flatten(F.collect_list(scanned)).alias("have"))
    todo = F.transform(F.array_except(present, F.coalesce(F.col("have"), F.array().cast("array<struct<kind:string,version:int>>"))), lambda x: x["kind"])
    return scan(blobs.join(have, "blob", "left").withColumn("kinds", todo).where(F.size("kinds") > 0), rules)


def find_secrets(versions: DataFrame, ledger: Ledger, text: str = "text", rules: dict = RULES) -> DataFrame:
    """row (struct of all columns of versions), blob, and spans, after the ledger's update with versions.
    Rows without findings have an empty list.

    The findings are a table of their own when they are joined, so that Spark knows their size: few of them are
    broadcast, and of many, the rows of one content that a third of all rows have can be split."""
    ledger.update(versions, text, rules)
    found = Scratch(versions.sparkSession, "findings").cut(ledger.spans(rules))
    rows = versions.select(F.struct("*").alias("row"), F.unhex(F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256)).alias("blob"))
    return rows.join(found, "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(found.schema["spans"].dataType)))


def redact(found: DataFrame, text: str = "text", mark: str = "[REDACTED]") -> DataFrame:
    """The columns of the versions, with every span of text that a finding covers replaced by mark."""
    schema = found.schema["row"].dataType
    spanned = F.transform("spans", lambda s: F.struct(s["begin"].alias("begin"), s["stop"].alias("stop")))
    merged = F.aggregate(
        spanned,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, s: F.when(s["stop"] <= acc["at"], acc).otherwise(F.struct(
            F.concat(acc["out"], F.when(s["begin"] >= acc["at"], F.concat(F.substr(F.col(f"row.{text}"), acc["at"] + 1, s["begin"] - acc["at"]), F.lit(mark))).otherwise(F.lit(""))).alias("out"),
            s["stop"].alias("at"))),
        lambda acc: F.concat(acc["out"], F.substr(F.col(f"row.{text}"), acc["at"] + 1)),
    )
    clean = F.when(F.size("spans") > 0, merged).otherwise(F.col(f"row.{text}"))
    return found.select(*[clean.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in schema.names])
