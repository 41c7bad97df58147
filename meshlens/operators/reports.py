"""Documents for people and agents. Spark selects and orders the rows; only report-sized results come to the driver."""

from __future__ import annotations

import datetime
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlens.operators import lookups, traversal
from meshlens.operators.lookups import parse_endpoint, scoped_dependents  # noqa: F401


#: A context document tells so many endpoints: a feature of the document.
ENDPOINTS = 40


def impact_markdown(report: DataFrame, dependents: DataFrame) -> str:
    r = report.first()
    out = [f"# Impact of changing {r.repo}", "", f"{r.n_dependents} direct dependents, {r.n_blast} repositories within reach.", "", "## Direct dependents", ""]
    out += [f"- {d.from_repo} ({d.confidence:.2f})" + (f": {', '.join(d.endpoints)}" if d.endpoints else "") for d in dependents.toLocalIterator()] or ["None."]
    out += ["", "## Within reach", "", r.blast.replace(",", ", ") or "None.", "", "## Events", "", r.events.replace(",", ", ") or "None."]
    return "\n".join(out) + "\n"


def context_markdown(repo: str, deps: DataFrame, routes: DataFrame, symbols: DataFrame, calls: DataFrame, notes: DataFrame, today: str | None = None) -> str:
    """What an agent should know before it works on a repository, as of a day (today's in UTC). Of its endpoints the first 40
    are told, and how many there are."""
    today = today or datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%d")
    out = [f"# {repo}", "", f"As of {today}.", "", "## Calls", ""]
    for d in lookups.dependencies_of(deps, repo).toLocalIterator():
        kind = "kafka" if "kafka" in d.dep_types else next((t for t in d.dep_types if t in ("http", "feign", "grpc")), "other")
        out.append(f"- {d.to_repo} ({kind}, {d.confidence:.2f})")
    out += ["", "## Called by", ""] + [f"- {d.from_repo} ({d.confidence:.2f})" for d in lookups.dependents_of(deps, repo).toLocalIterator()]
    blast = traversal.blast_radius(deps, deps.sparkSession.createDataFrame([(repo,)], "origin string"), 2).select("node").distinct().orderBy("node")
    out += ["", "## Within reach of a change", ""] + [f"- {b.node}" for b in blast.toLocalIterator()]
    out += ["", "## Events", ""] + [f"- {e.topic}" for e in lookups.events_emitted(deps.where(F.col("from_repo") == repo)).orderBy("topic").toLocalIterator()]
    out += ["", "## Endpoints", ""] + [f"- {r.method or 'ANY'} {r.path}" for r in lookups.routes_of(routes, repo).limit(ENDPOINTS).collect()]
    out += [f"{routes.where(F.col('repo') == repo).count()} in all."]
    out += ["", "## Call sites elsewhere", ""] + [f"- {c.callee_name}: {c.repo} {c.file}:{c.line}" for c in lookups.cross_repo_call_sites(symbols, calls, repo).collect()]
    out += ["", "## Notes", ""] + [f"- [{n.kind}] {n.note}" for n in notes.where(F.col("repo") == repo).orderBy("id").toLocalIterator()]
    return "\n".join(out) + "\n"


def export_json(deps: DataFrame, repo: str) -> str:
    """The graph of one repository as a JSON document."""
    rows = deps.where(F.col("from_repo") == repo).orderBy("to_repo").collect()
    found = [{"target": r.to_repo, "types": r.dep_types, "confidence": r.confidence, "tier": r.tier, "evidence": [{"file": e.rpartition(":")[0] or e, "line": int(e.rpartition(":")[2]) if e.rpartition(":")[2].isdigit() else 0} for e in r.evidence]} for r in rows]
    return json.dumps({"repo": repo, "dependencies": found, "summary": {"total_deps": len(found), "high_confidence": sum(r["confidence"] >= 0.8 for r in found)}}, indent=2)


def violations(deps: DataFrame) -> DataFrame:
    """Rows of an export that break its constraints, with the rule that they break."""
    types = F.array(*[F.lit(t) for t in ("import", "http", "feign", "grpc", "kafka", "soap", "rabbitmq", "db")])
    rules = {
        "target is missing": F.coalesce("to_repo", F.lit("")) == "", "confidence is out of range": ~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)),
        "unknown type": F.size(F.array_except("dep_types", types)) > 0, "no type": F.coalesce(F.size("dep_types"), F.lit(0)) < 1,
    }
    broken = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return deps.select("from_repo", "to_repo", F.explode(broken).alias("rule"))
