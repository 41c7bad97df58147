"""Predicates and scores of signals as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meshlens.functions.paths import text

# Hosts and path parts of XML namespaces.
NAMESPACE_HOSTS = ("www.w3.org", "w3.org", "schemas.xmlsoap.org", "xmlsoap.org", "xmlns.example.com", "www.xml.org", "xml.org")
NAMESPACE_MARKERS = ("apache.org/xml/features", "xml.org/sax/features", "xml.org/sax/properties", "w3.org/", "xmlsoap.org/")
# Endings of names that hold values, not services.
VALUE_HOLDERS = (
    "constants", "constant", "const", "enums", "enum", "dtos", "dto", "models", "model", "entities", "entity",
    "configuration", "configs", "config", "settings", "properties", "exceptions", "exception", "errors", "error",
    "utils", "util", "helpers", "helper", "mappers", "mapper", "types", "type", "schemas", "schema", "vo", "pojo",
)
# Configuration keys that name an endpoint, schemes that aren't HTTP, and the ranks of tiers.
URL_KEY = r"(?i)(?:url|uri|endpoint|base-?url|address|host)\z"
OTHER_SCHEME = r"(?i)^(?:jdbc|r2dbc|mongodb(?:\+srv)?|redis|rediss|amqp|amqps|kafka|zookeeper|ldap|ldaps|file|classpath):"
TIERS = {"call-site": 4, "config": 3, "inferred": 2, "import": 1}


def is_namespace_noise(url: Column) -> Column:
    u = F.lower(F.regexp_replace(text(url), r"^\$ENV:", ""))
    host = F.substring_index(F.regexp_extract(u, r"^[a-z]+://([^/]+)", 1), ":", 1)
    marked = F.lit(False)
    for m in NAMESPACE_MARKERS:
        marked = marked | u.contains(m)
    return (u != "") & (host.isin(*NAMESPACE_HOSTS) | marked)


def score_target(target: Column) -> Column:
    """struct(target, confidence, tier) of the argument of a network call."""
    t = text(target)
    getenv, process = r"getenv\([\"']([^\"']+)[\"']", r"process\.env\.(\w+)"
    name = F.when(t.rlike(getenv), F.regexp_extract(t, getenv, 1)).when(t.rlike(process), F.regexp_extract(t, process, 1)).otherwise(t)
    made = lambda to, c, tier: F.struct(to.alias("target"), F.lit(c).alias("confidence"), F.lit(tier).alias("tier"))
    return (
        F.when(t.startswith("http://") | t.startswith("https://"), made(t, 1.0, "call-site"))
        .when(t.startswith("$ENV:"), made(t, 0.7, "call-site"))
        .when(t.contains("os.getenv") | t.contains("os.environ") | t.contains("process.env"), made(F.concat(F.lit("$ENV:"), name), 0.7, "call-site"))
        .otherwise(made(t, 0.4, "inferred"))
    )


def looks_like_http_target(key: Column, value: Column) -> Column:
    v = F.trim(text(value))
    hostlike = F.substring_index(v, "/", 1).contains(".") | v.contains(":")
    return (v != "") & ~v.contains("${") & ~v.contains("{{") & ~v.rlike(OTHER_SCHEME) & (v.startswith("http://") | v.startswith("https://") | (text(key).rlike(URL_KEY) & hostlike))


def is_value_holder(module: Column) -> Column:
    last = F.lower(F.regexp_extract(F.trim(text(module)), r"([^./\\]*)\z", 1))
    return (last != "") & last.rlike(f"(?:{'|'.join(VALUE_HOLDERS)})\\z")


def resolve_placeholder(value: Column) -> Column:
    """${NAME:default} -> default; a placeholder without default, alone or within, -> empty."""
    v = F.trim(F.trim(text(value)), F.lit("\"'"))
    whole = r"^\$\{([^:}]+)(?::([^}]*))?\}\z"
    return F.when(v.rlike(whole), F.trim(F.regexp_extract(v, whole, 2))).when(v.contains("${"), F.lit("")).otherwise(v)


def tier_rank(tier: Column) -> Column:
    out = F.lit(0)
    for name, rank in TIERS.items():
        out = F.when(tier == name, rank).otherwise(out)
    return out


def confidence_label(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "high").when(confidence >= 0.5, "medium").otherwise("low")


def fanout_confidence(hops: Column) -> Column:
    return F.round(F.greatest(F.lit(0.4), F.lit(0.9) - F.lit(0.15) * hops), 2)
