"""URL, host and IRI scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import c

#: Second levels under which names are registered in .np, and tracking keys.
NP_SECOND = ("gov", "com", "edu", "org", "net", "mil")
TRACKING = "(utm_|fbclid|gclid|ref)"


def host(url: str | Column) -> Column:
    return F.lower(F.regexp_extract(c(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def registrable_domain(name: str | Column) -> Column:
    """The last two labels, or three under .np; a host of one label is itself; null if there is none."""
    labels = F.split(F.lower(F.trim(F.regexp_replace(c(name), r"^\.+|\.+$", ""))), r"\.")
    n = F.when(F.element_at(labels, -1) == "np", 3).otherwise(2)
    size = F.size(labels)
    return F.nullif(F.array_join(F.slice(labels, F.greatest(size - n + 1, F.lit(1)), n), "."), F.lit(""))


def article_url(url: str | Column) -> Column:
    """Lower-case scheme and host without www, no trailing slash, no tracking keys, no fragment."""
    u = F.regexp_replace(F.trim(c(url)), "#.*$", "")
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    path = F.regexp_replace(F.regexp_extract(u, r"^[^:]+://[^/?]*([^?]*)", 1), "/+$", "")
    keys = F.filter(F.split(F.regexp_extract(u, r"\?(.*)$", 1), "&"), lambda k: (k != "") & ~F.lower(k).rlike("^" + TRACKING))
    query = F.array_join(keys, "&")
    base = F.concat(scheme, F.lit("://"), F.regexp_replace(host(u), r"^www\d*\.", ""), F.when(path == "", "/").otherwise(path))
    return F.when(query == "", base).otherwise(F.concat(base, F.lit("?"), query))


def article_ident(url: str | Column, day: str | Column) -> Column:
    """``YYYYMMDD.hex8`` of the day and of the normalized URL: the same in every run."""
    return F.concat_ws(".", F.date_format(c(day), "yyyyMMdd"), F.substring(F.sha2(article_url(url), 256), 1, 8))


def iri(base: str, kind: str, *parts: str | Column) -> Column:
    """``<base>/<kind>/<part>/...`` in lower case; null if a part is null or isn't a plain segment."""
    values = [F.lower(c(p).cast("string")) for p in parts]
    fine = F.lit(True)
    for v in values:
        fine = fine & v.rlike(r"^[a-z0-9][a-z0-9._-]*$")
    return F.when(fine, F.concat_ws("/", F.lit(f"{base.rstrip('/')}/{kind}"), *values))


def iri_parts(base: str, x: str | Column) -> Column:
    """struct(kind, path) of an IRI under ``base``, or null."""
    form = "^" + base.rstrip("/").replace(".", r"\.") + r"/([a-z-]+)/([a-z0-9._/-]+)$"
    return F.when(c(x).rlike(form), F.struct(F.regexp_extract(c(x), form, 1).alias("kind"), F.regexp_extract(c(x), form, 2).alias("path")))


#: The types of IRIs, and how many segments each has after its type, at least and at most.
TYPES = {"entity": (2, 99), "courtcase": (2, 2), "material": (1, 99), "case": (1, 1)}


def canonical_iri(base: str, x: str | Column, kind: str = "entity") -> Column:
    """An IRI of any scheme and host under ``base``, so that one thing has one key; null if it isn't ``/<kind>/`` and as many plain segments as the kind has. Dockets' are brought to lower case."""
    least, most = TYPES[kind]
    raw = F.lower(F.trim(c(x))) if kind == "courtcase" else F.trim(c(x))
    path = F.regexp_extract(raw, rf"^[A-Za-z][A-Za-z0-9+.-]*://[^/]+(/{kind}(?:/[a-z0-9][a-z0-9._-]*){{{least},{most}}})/?$", 1)
    return F.when(path != "", F.concat(F.lit(base.rstrip("/")), path))


def publisher_key(authority: str | Column, url: str | Column) -> Column:
    """Who published a source: its authority in lower case, else the registrable domain of its URL, without www; null without both."""
    named = F.nullif(F.lower(F.trim(c(authority))), F.lit(""))
    return F.coalesce(named, registrable_domain(F.nullif(host(url), F.lit(""))))
