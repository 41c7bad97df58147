"""Service identities as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meshlens.functions.paths import text

# Parts of names that carry no identity, and infrastructure suffixes of host names.
GENERIC = ("svc", "service", "services", "api", "apis", "srv", "app", "server", "backend", "gateway", "url", "uri", "endpoint", "host", "addr", "base", "baseurl")
SUFFIX = r"\.(?:internal|local|svc\.cluster\.local|cluster\.local|com|io|net|org|dev)\z"
IMPORT_STOPWORDS = ("client", "service", "impl", "api", "util", "helper")


def normalize_identity(value: Column) -> Column:
    """https://payments-svc.internal/v1 -> payments; generic parts go unless all are."""
    s = F.lower(F.trim(text(value)))
    s = F.regexp_replace(F.regexp_replace(s, r"^\$env:", ""), r"^https?://", "")
    s = F.substring_index(F.substring_index(s, "/", 1), ":", 1)
    s = F.regexp_replace(F.regexp_replace(s, SUFFIX, ""), r"[._\s]+", "-")
    parts = F.filter(F.split(s, "-"), lambda t: t != "")
    core = F.filter(parts, lambda t: ~t.isin(*GENERIC))
    return F.array_join(F.when(F.size(core) > 0, core).otherwise(parts), "-")


def stem(norm: Column) -> Column:
    """A plural last part loses its s: payments -> payment."""
    return F.regexp_replace(text(norm), r"(^|-)([^-]{3,})s\z", "$1$2")


def tokens(norm: Column) -> Column:
    """Distinct parts of at least three characters."""
    return F.array_distinct(F.filter(F.split(text(norm), "-"), lambda t: F.length(t) >= 3))


def service_from_url(url: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(text(url), r"^https?://", ""), r"^\$ENV:", "")
    host = F.regexp_replace(F.substring_index(F.substring_index(bare, "/", 1), ":", 1), r"\.(?:internal|local|svc\.cluster\.local)\z", "")
    return F.when(host == "", bare).otherwise(host)


def import_name(name: Column) -> Column:
    """com.company.payments.Client -> payments."""
    parts = F.split(F.lower(F.trim(text(name))), r"\.")
    kept = F.filter(parts, lambda p: ~p.isin(*IMPORT_STOPWORDS))
    return F.when(F.size(kept) > 0, F.element_at(kept, -1)).otherwise(F.element_at(parts, -1))


def slug(name: Column) -> Column:
    """Lower case; every character but letters, digits and hyphens becomes a hyphen, none of them at the ends."""
    return F.trim(F.regexp_replace(F.lower(text(name)), r"[^\p{L}\p{N}-]", "-"), F.lit("-"))
