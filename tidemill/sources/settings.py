"""Readers of settings: search targets, the profile, and the materials of tailored documents."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..rules import parse
from ..schema import MATERIAL
from .files import path_exists

#: The profile where the settings name none: fixed values.
PROFILE = {
    "full_name": "Your Name",
    "email": "you@example.com",
    "phone": "+44 0000 000000",
    "linkedin_url": "https://www.linkedin.com/in/your-profile",
    "portfolio_url": "https://your-portfolio.example.com",
    "closing_name": "Your Name",
}


def read_settings(spark: SparkSession, path: str, comment_mode: str = "yaml") -> dict[str, Any]:
    """A settings file, from any file system that Spark reads; a missing file is an empty mapping."""
    if not path_exists(spark, path):
        return {}
    return parse(spark.read.text(path, wholetext=True).first()["value"], comment_mode)


def profile(settings: dict[str, Any], defaults: dict[str, str] | None = None) -> dict[str, str]:
    """The defaults, each replaced by what the settings' identity section says, if anything."""
    given = settings.get("identity") or {}
    return {k: str(given[k]) if given.get(k) else v for k, v in (defaults or PROFILE).items()}


def material_rows(items: list[dict[str, Any]] | None, kind: str) -> list[tuple]:
    """Items of one kind as rows of MATERIAL, numbered in order; numbers are rendered as text."""
    text = lambda x: None if x is None else str(x)
    texts = lambda x: [str(v) for v in x or []]
    rows = []
    for k, item in enumerate(items or []):
        variants = {str(f): texts(b) for f, b in (item.get("bullet_variants") or {}).items()}
        name = text(item.get("name") or item.get("company"))
        plain = [text(item.get(c)) for c in ("title", "location", "date_range", "repo_url")]
        rows.append((kind, text(item.get("id")), name, *plain, texts(item.get("tags")), texts(item.get("bullets")), variants, texts(item.get("role_targets")), k))
    return rows


def materials(spark: SparkSession, experience: dict[str, Any], projects: dict[str, Any]) -> DataFrame:
    """The materials table from the settings of experience and projects; one person's, so a few rows."""
    rows = material_rows(experience.get("experience"), "experience") + material_rows(projects.get("projects"), "project")
    return spark.createDataFrame(rows, T.StructType(MATERIAL.fields))


def word_lists(settings: dict[str, Any], section: str) -> dict[str, list[str]]:
    """Group -> words of the skills or snippets section."""
    return {str(k): [str(x) for x in v or []] for k, v in (settings.get(section) or {}).items()}
