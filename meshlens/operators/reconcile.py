"""Binding references to the repositories whose declared identity they name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlens.functions import identity as I
from meshlens.operators.checkpoints import checkpointed
from meshlens.operators.resolve import ordered, strongest

# Names of client libraries, never repositories.
NOISE = ("requests", "httpx", "urllib", "aiohttp", "axios", "fetch", "got", "ky", "unknown", "")


def catalog(aliases: DataFrame) -> DataFrame:
    """aliases (repo, alias, source, confidence, ord), alias normalized -> with stem and tokens."""
    rows = aliases.where(F.coalesce("alias", F.lit("")) != "")
    return rows.withColumns({"stem": I.stem(F.col("alias")), "tokens": I.tokens(F.col("alias"))})


def _two_best(rows: DataFrame, key: str) -> DataFrame:
    """(key, two): the best entry of the catalog for a key, highest confidence and then first, and the best one of another
    repository. Whichever repository may not be named, one of the two is the answer, so a key never brings more rows along."""
    own = rows.groupBy(key, "repo").agg(F.max_by(F.struct("confidence", "ord", "source"), F.struct("confidence", -F.col("ord"))).alias("e")).select(key, "repo", "e.*")
    order = Window.partitionBy(key).orderBy(F.desc("confidence"), "ord", "repo")
    ranked = own.withColumn("rank", F.row_number().over(order)).where("rank <= 2")
    return ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "repo", "confidence", "source"))).alias("two"))


def _contained(norms: DataFrame, by_alias: DataFrame) -> DataFrame:
    """Pairs (norm, alias, place, two) where the tokens of one are all among the other's. The contained side has its rarest
    token in common with the other, so pairs come from two joins on that token, and a frequent token pairs little."""
    names, known = norms.select("norm", "tokens"), by_alias.select(F.col("alias").alias("norm"), "tokens")
    often = checkpointed(names.union(known).select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("often")))

    def rarest(rows: DataFrame) -> DataFrame:
        return rows.select("norm", F.explode("tokens").alias("token")).join(often, "token").groupBy("norm").agg(F.min_by("token", F.struct("often", "token")).alias("token"))

    asked = names.withColumnRenamed("tokens", "asked")
    inner = asked.join(rarest(names), "norm").join(by_alias.select("alias", "tokens", F.explode("tokens").alias("token")), "token").where(F.size(F.array_except("asked", "tokens")) == 0)
    outer = asked.withColumn("token", F.explode("asked")).join(by_alias.select("alias", "tokens").join(rarest(known).withColumnRenamed("norm", "alias"), "alias"), "token").where(F.size(F.array_except("tokens", "asked")) == 0)
    pairs = inner.select("norm", "alias").union(outer.select("norm", "alias")).distinct()
    return pairs.join(by_alias.select("alias", "place", "two"), "alias")


def _subsets(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What containment offers: (norm, latest) whoever may not be named, and (norm, excluded, instead) of what stands behind
    the repository that may not.

    The catalog's order decides as a fold: a later alias replaces an earlier one if its confidence exceeds the earlier
    one's scaled one. The fold ends at the earliest entry whose scaled confidence no later one exceeds, which is the last
    of its confidence; so of each confidence only the last entry counts (and the last one of another repository), and a
    name that many aliases contain takes a few entries along."""
    entries = pairs.select("norm", "alias", "place", F.col("two")[0].alias("best"), F.try_element_at("two", F.lit(2)).alias("next"))
    last = entries.groupBy("norm", F.col("best.confidence").alias("confidence"), F.col("best.repo").alias("repo")).agg(F.max(F.struct("place", "alias", F.col("best.source").alias("source"))).alias("e"))
    order = Window.partitionBy("norm", "confidence").orderBy(F.desc("e"))
    last = last.withColumn("rank", F.row_number().over(order)).where("rank <= 2").select("norm", F.struct("e.place", "e.alias", "repo", "confidence", "e.source").alias("e"))
    latest = last.groupBy("norm").agg(F.collect_list("e").alias("latest"))
    behind = entries.where("next is not null").groupBy("norm", F.col("best.repo").alias("excluded"), F.col("next.confidence").alias("confidence")).agg(F.max(F.struct("place", "alias", F.col("next.repo").alias("repo"), F.col("next.confidence").alias("confidence"), F.col("next.source").alias("source"))).alias("e"))
    return latest, behind.groupBy("norm", "excluded").agg(F.collect_list("e").alias("instead"))


_MATCH = "struct<repo:string,confidence:double,source:string,reason:string>"


def _match(exclude: Column, instead: Column) -> Column:
    """The binding of a reference with columns exact, stem and latest that may not name a repository: the first kind that hits."""
    other = lambda entries: F.filter(entries, lambda e: e["repo"] != exclude)

    def first(entries: str, scaled, reason: str) -> Column:
        best = F.try_element_at(other(F.col(entries)), F.lit(1))
        return F.when(best.isNotNull(), F.struct(best["repo"].alias("repo"), scaled(best["confidence"]).alias("confidence"), best["source"].alias("source"), F.lit(reason).alias("reason")))

    def step(best: Column, x: Column) -> Column:
        taken = F.struct(x["repo"].alias("repo"), F.least(F.lit(0.7), x["confidence"] * 0.75).alias("confidence"), x["source"].alias("source"), F.lit("subset").alias("reason"))
        return F.when(best.isNull() | (x["confidence"] > best["confidence"]), taken).otherwise(best)

    none = F.array().cast("array<struct<place:bigint,alias:string,repo:string,confidence:double,source:string>>")
    entries = F.array_sort(F.concat(F.coalesce(other(F.col("latest")), none), F.coalesce(instead, none)))
    return F.coalesce(
        first("exact", lambda c: F.least(F.lit(1.0), c), "exact"), first("stem", lambda c: F.least(F.lit(0.95), c * 0.95), "stem"),
        F.aggregate(entries, F.lit(None).cast(_MATCH), step),
    )


def bind(refs: DataFrame, aliases: DataFrame) -> DataFrame:
    """refs (ref, exclude) -> (ref, exclude, match struct(repo, confidence, source, reason) or null, self_match: the
    repository bound to if none is excluded).

    The first kind that hits wins: the exact identity, the plural-folded one, then containment of one side's
    tokens in the other's. All of it is worked out once for each normal form; the catalog, too, is one row for each alias.
    References then pick by joins on their normal form, whose right sides have one row a key."""
    known = catalog(aliases)
    by_alias = checkpointed(known.groupBy("alias").agg(F.min("ord").cast("long").alias("place"), F.first("tokens").alias("tokens")).join(_two_best(known, "alias"), "alias"))
    asked = refs.select("ref", "exclude").distinct().withColumn("norm", I.normalize_identity(F.col("ref")))
    norms = asked.where("norm <> ''").select("norm").distinct().withColumns({"stem_": I.stem(F.col("norm")), "tokens": I.tokens(F.col("norm"))})
    stems = _two_best(known, "stem").select(F.col("stem").alias("stem_"), F.col("two").alias("stem"))
    norms = checkpointed(norms.join(by_alias.select(F.col("alias").alias("norm"), F.col("two").alias("exact")), "norm", "left").join(stems, "stem_", "left").drop("stem_"))
    few = lambda entries: F.coalesce(F.size(entries), F.lit(0)) < 2  # noqa: E731  with two repositories one is never excluded
    latest, instead = _subsets(checkpointed(_contained(norms.where(few("exact") & few("stem")), by_alias)))
    rows = asked.join(norms.join(latest, "norm", "left").drop("tokens"), "norm", "left").join(instead, (F.col("exclude") == F.col("excluded")) & (asked["norm"] == instead["norm"]), "left").drop(instead["norm"])
    return rows.select("ref", "exclude", _match(F.coalesce("exclude", F.lit("")), F.col("instead")).alias("match"), _match(F.lit(""), F.lit(None))["repo"].alias("self_match"))


def disposed(deps: DataFrame, aliases: DataFrame) -> DataFrame:
    """deps with match, self_match (the repository bound to without the exclusion) and disposition: resolved,
    drop-import, drop-self or keep. Kept names of client libraries count as unresolved like other kept ones."""
    bound = bind(deps.select(F.col("to_repo").alias("ref"), F.col("from_repo").alias("exclude")), aliases)
    rows = deps.join(bound.withColumnsRenamed({"ref": "to_repo", "exclude": "from_repo"}), ["from_repo", "to_repo"], "left")
    import_only = (F.size("dep_types") == 1) & (F.col("dep_types")[0] == "import")
    own_name = F.coalesce(F.col("self_match") == F.col("from_repo"), F.lit(False)) | ((F.col("to_repo") == F.col("from_repo")) & ~I.normalize_identity(F.col("to_repo")).isin(*NOISE))
    return rows.withColumn("disposition", F.when(F.col("match").isNotNull(), "resolved").when(import_only, "drop-import").when(own_name, "drop-self").otherwise("keep"))


def reconcile(deps: DataFrame, aliases: DataFrame) -> DataFrame:
    """deps (from_repo, to_repo, dep_types, confidence, evidence, tier, ord) bound to the catalog and merged anew."""
    kept = disposed(deps, aliases).where(F.col("disposition").isin("resolved", "keep"))
    note = F.concat(F.lit("resolved:"), F.col("match.reason"), F.lit("("), F.col("match.source"), F.lit(")"))
    rows = kept.select(
        "from_repo", F.coalesce("match.repo", "to_repo").alias("to_repo"), "dep_types", "tier", "ord", F.col("to_repo").alias("old"),
        F.least(F.lit(1.0), F.greatest("confidence", F.coalesce("match.confidence", F.lit(0.0)))).alias("confidence"),
        F.when(F.col("match").isNotNull(), F.concat("evidence", F.array(note))).otherwise(F.col("evidence")).alias("evidence"),
    )
    return rows.groupBy("from_repo", "to_repo").agg(
        F.array_distinct(F.flatten(ordered("dep_types", "ord", "old"))).alias("dep_types"), F.max("confidence").alias("confidence"),
        F.flatten(ordered("evidence", "ord", "old")).alias("evidence"), strongest().alias("tier"), F.count("*").alias("merged_from"),
    )


def stats(deps: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row: resolved, dropped_self, merged, unresolved."""
    rows = disposed(deps, aliases).withColumn("target", F.coalesce("match.repo", "to_repo"))
    kept = F.col("disposition").isin("resolved", "keep")
    return rows.agg(
        F.count_if(F.col("disposition") == "resolved").alias("resolved"), F.count_if(F.col("disposition") == "drop-self").alias("dropped_self"),
        (F.count_if(kept) - F.count_distinct(F.when(kept, F.struct("from_repo", "target")))).alias("merged"),
        F.count_if(F.col("disposition").isin("keep", "drop-import")).alias("unresolved"),
    )


def _inside(name: str) -> Column:
    """All stretches of a name: containment is then an equality, not a comparison of all pairs of names."""
    size = F.length(name)
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), size), lambda i: F.transform(F.sequence(F.lit(1), size - i + 1), lambda n: F.substr(F.col(name), i, n)))))


def contained_names(deps: DataFrame, repos: DataFrame) -> DataFrame:
    """deps (to_repo, confidence, ord) -> (ord, to_repo, confidence): where one of the names holds the other, lower case and
    without hyphens and underscores, the first such repository (repo) by name and 0.2 more confidence, 1 at most."""
    bare = lambda c: F.regexp_replace(F.lower(c), "[-_]", "")
    asked = deps.select("to_repo", bare("to_repo").alias("asked")).distinct().where("asked <> ''")
    known = repos.select("repo", bare("repo").alias("known")).distinct().where("known <> ''")
    longer = asked.withColumn("known", F.explode(_inside("asked"))).join(known, "known").select("to_repo", "repo")
    shorter = known.withColumn("asked", F.explode(_inside("known"))).join(asked, "asked").select("to_repo", "repo")
    first = longer.union(shorter).groupBy("to_repo").agg(F.min("repo").alias("repo"))
    rows = deps.join(first, "to_repo", "left")
    return rows.select("ord", F.coalesce("repo", "to_repo").alias("to_repo"), F.when(F.col("repo").isNotNull(), F.least(F.lit(1.0), F.col("confidence") + 0.2)).otherwise(F.col("confidence")).alias("confidence"))
