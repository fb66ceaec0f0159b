"""Addresses of postings: cleaning, source and identifier."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

#: Host part -> source name; host part -> the one query key that is kept. Fixed values.
SITES = (("linkedin.com", "linkedin"), ("indeed.", "indeed"), ("glassdoor.", "glassdoor"))
KEPT_KEYS = (("indeed.", "jk"), ("glassdoor.", "jl"))
ID_KEYS = ("jk", "jobid", "jobId", "currentJobId")


def host(url: Column | str) -> Column:
    return F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def path(url: Column | str) -> Column:
    return F.regexp_extract(col(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)


def query_values(url: Column | str, key: str) -> Column:
    """All non-empty values of a query key, decoded."""
    query = F.regexp_extract(col(url), r"^[^?#]*\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: p.startswith(f"{key}=") & (F.length(p) > len(key) + 1))
    return F.transform(pairs, lambda p: F.try_url_decode(F.substr(p, F.lit(len(key) + 2))))


def clean(url: Column | str) -> Column:
    """Without fragment and query, but for the key that identifies a posting on known hosts."""
    url = F.trim(col(url))
    base = F.regexp_extract(url, r"^([^?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    base = F.concat(F.lower(scheme), F.substr(base, F.length(scheme) + 1))
    kept = F.lit("")
    for part, key in reversed(KEPT_KEYS):
        pairs = F.array_join(F.transform(query_values(url, key), lambda v: F.concat(F.lit(f"{key}="), v)), "&")  # noqa: B023
        kept = F.when(F.contains(host(url), F.lit(part)), pairs).otherwise(kept)
    return F.rtrim(F.concat(base, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")), F.lit("?"))


def source(url: Column | str) -> Column:
    """The site whose name occurs anywhere in the address, else 'manual'."""
    low, out = F.lower(col(url)), F.lit("manual")
    for part, name in reversed(SITES):
        out = F.when(F.contains(low, F.lit(part)), name).otherwise(out)
    return out


def posting_id(url: Column | str) -> Column:
    """A query key, else a run of seven digits or more in the path, else its last part, else the host."""
    tries = [F.get(query_values(url, k), F.lit(0)) for k in ID_KEYS]
    tries.append(F.nullif(F.regexp_extract(path(url), r"(\d{7,})", 1), F.lit("")))
    last = F.regexp_extract(F.rtrim(path(url), F.lit("/")), r"([^/]*)$", 1)
    return F.coalesce(*tries, F.nullif(last, F.lit("")), host(url))
