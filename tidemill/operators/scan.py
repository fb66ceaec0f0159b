"""Private data in texts: what the patterns find, less what is allowed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns by kind: fixed values.
PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "profile_url": r"https://www\.linkedin\.com/in/[A-Za-z0-9\-_%]+",
    "phone": r"\+\d[\d\s\-()]{7,}\d",
}
#: The other fixed values: credential keys, and which files of a tree are texts.
CREDENTIAL = r'(app_id|app_secret|app_token|table_id|view_id):\s*"([^"\n]+)"'
TEXT_SUFFIXES = (".md", ".txt", ".py", ".yaml", ".yml", ".tex", ".toml", ".json", ".gitignore")
TEXT_NAMES = (".gitignore", "Makefile")
IGNORED = (".git", "__pycache__", "cv/generated")
ALLOWED = {
    "email": ("you@example.com",),
    "profile_url": ("https://www.linkedin.com/in/your-profile",),
    "phone": ("+44 0000 000000",),
}


#: Allowed values up to which their table is broadcast.
FEW_ALLOWED = 10_000


def findings(texts: DataFrame, text: str, keep: tuple[str, ...], allowed: DataFrame | None = None) -> DataFrame:
    """(keep, kind, value) per match, without the (kind, value) pairs of allowed."""
    def of(kind: str, pattern: str) -> Column:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    each = [of(k, p) for k, p in PATTERNS.items()]
    found = texts.select(*keep, F.explode(F.concat(*each)).alias("m")).select(*keep, "m.*")
    if allowed is None:  # a few fixed values, as literals
        for kind, values in ALLOWED.items():
            found = found.where(~((F.col("kind") == kind) & F.col("value").isin(*values)))
        return found
    few = F.broadcast(allowed) if allowed.limit(FEW_ALLOWED + 1).count() <= FEW_ALLOWED else allowed
    return found.join(few, ["kind", "value"], "left_anti").select(*keep, "kind", "value")


def credentials(files: DataFrame, service: str, allowed: tuple[str, ...]) -> DataFrame:
    """(path, kind, value) of credential keys in YAML files whose name holds the service's."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    rows = files.where(F.regexp_like(name, F.lit(r"\.ya?ml$")) & F.contains(name, F.lit(service)))
    keys, values = (F.regexp_extract_all("content", F.lit(CREDENTIAL), F.lit(g)) for g in (1, 2))
    out = rows.select("path", F.explode(F.arrays_zip(keys.alias("kind"), values.alias("value"))).alias("m"))
    value = F.trim("m.value")
    return out.select("path", "m.kind", value.alias("value")).where((F.col("value") != "") & ~F.col("value").isin(*allowed))


def is_text_path(path: Column) -> Column:
    """By suffix or exact name; a path that holds an ignored part anywhere is left out."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    suffix = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    ignored = F.contains(path, F.lit(IGNORED[0])) | F.contains(path, F.lit(IGNORED[1])) | F.contains(path, F.lit(IGNORED[2]))
    return (name.isin(*TEXT_NAMES) | suffix.isin(*TEXT_SUFFIXES)) & ~ignored


def clean(found: DataFrame) -> bool:
    """Whether nothing was found."""
    return found.isEmpty()
