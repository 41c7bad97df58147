"""From signals to dependencies: grouping by ordered pair of repositories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlens.functions import predicates as P

# Modules of standard libraries and names without a meaning, never services.
NOISE = ("os", "sys", "re", "json", "path", "typing", "dataclasses", "pathlib", "unknown", "")

SURFACE = "struct<channel:string,method:string,path:string,key:string,matched:boolean,match_kind:string,evidence:string>"


def ordered(value: str, *order: str) -> Column:
    """All values of a group as an array in the given order, whatever partition they come from."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("kept_")))), lambda s: s["kept_"])


def by_first(value: str, *order: str) -> Column:
    """The distinct values of a group, by the least of each order column among a value's rows; where these are equal, by the value."""
    rows = F.collect_list(F.struct(F.col(value).alias("kept_"), *order))

    def place(kept: Column) -> Column:
        own = F.filter(rows, lambda r: r["kept_"].eqNullSafe(kept))
        return F.struct(*[F.array_min(own[name]).alias(name) for name in order], kept.alias("kept_"))

    return F.transform(F.array_sort(F.transform(F.array_distinct(rows["kept_"]), place)), lambda s: s["kept_"])


def strongest(tier: str = "tier") -> Column:
    return F.max_by(tier, F.struct(P.tier_rank(F.col(tier)), F.col(tier)))


def resolve(signals: DataFrame) -> DataFrame:
    """signals (from_repo, to_repo, dep_type, confidence, evidence, tier, ord [, place] [, surface]) -> dependencies.

    ord is the first of a dependency's. Surfaces are distinct in order of first appearance; types, too, and where two begin at one ord, the one of
    the least evidence of all its signals comes first, then the one of the first place, if signals have places. Evidence keeps repetitions, the
    confidence is the best one and the tier the strongest. Signals to the repository itself, to nothing and to standard libraries are dropped."""
    rows = signals.where((F.col("to_repo") != F.col("from_repo")) & ~F.col("to_repo").isin(*NOISE))
    aggregates = [
        by_first("dep_type", "ord", "evidence", *(["place"] if "place" in signals.columns else [])).alias("dep_types"), F.max("confidence").alias("confidence"),
        ordered("evidence", "ord", "evidence").alias("evidence"), strongest().alias("tier"), F.min("ord").alias("ord"),
    ]
    if "surface" in signals.columns:
        aggregates.append(F.array_distinct(F.filter(ordered("surface", "ord", "evidence"), lambda s: s.isNotNull())).alias("surfaces"))
    return rows.groupBy("from_repo", "to_repo").agg(*aggregates)


def first_per(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each group: the reference's first-wins and best-wins rules."""
    return df.withColumn("rank_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("rank_ = 1").drop("rank_")


def without_import_only(deps: DataFrame) -> DataFrame:
    return deps.where(~((F.size("dep_types") == 1) & (F.col("dep_types")[0] == "import")))
