"""One run from settings to effects: search, merge, score, tailor, send; on failure one alert.

Everything outside Spark is named, so that a test can put fakes in its place.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import rules
from ..functions.text import fill
from ..operators.dedupe import fetch_key, keep_first
from ..operators.sync import remote_lookup
from ..sources import files, remote, settings
from ..sources.scratch import materialise
from . import pipeline
from .collect import DETAILS, collect, search_rows

#: Layout of each search site, in the order of precedence of their postings, and the cached postings that stand in for it.
LAYOUTS = {"linkedin": 1, "indeed": 2}
CACHED = "manual_{}_jobs.json"
#: Names of the other files below the folder of inputs; those that are missing are empty.
LINES, NORMAL_LINES, MANUAL = "manual_job_inputs.txt", "manual_job_inputs.normalized", "manual_indeed_jobs.json"
#: Look-back in hours where the settings name none.
HOURS = 24


@dataclass(frozen=True)
class Outside:
    """What a run talks to, as "module:attribute"; search and details by site."""

    search: dict[str, str]
    details: dict[str, str]
    records: str
    fields: str
    sender: str


@dataclass(frozen=True)
class Places:
    """Paths of the settings files, the template, and the folders of inputs and outputs."""

    targets: str
    scoring: str
    remote: str
    profile: str
    experience: str
    projects: str
    skills: str
    snippets: str
    template: str
    inputs: str
    output: str


@dataclass(frozen=True)
class Result:
    """What a run did: its tables, written below the output folder, and how many rows were sent (or would be) by action."""

    merged: DataFrame
    chosen: DataFrame
    documents: DataFrame
    sent: DataFrame
    counts: dict[str, int]


def template(spark: SparkSession, path: str, profile: dict[str, str]) -> str:
    """The text of a template, with the profile's values in place of their marks."""
    text = spark.read.text(path, wholetext=True)
    return text.select(fill("value", {f"{{{{{k.upper()}}}}}": v for k, v in profile.items()}).alias("t")).first().t


def searched(spark: SparkSession, site: str, search: dict, outside: Outside, inputs: str, today: str) -> DataFrame:
    """The postings of one site; each search and each detail page is fetched once."""
    layout = LAYOUTS[site]
    options = {
        "fetcher": outside.search[site], "layout": layout, "hours": int(search.get("posted_within_hours", HOURS)),
        "regions": json.dumps([str(r) for r in search.get("regions") or []]), "titles": json.dumps([str(t) for t in search.get("titles") or []]),
    }
    pages = materialise(spark.read.format("search_pages").options(**options).load().drop("hours"), "search-pages")
    once = keep_first(search_rows(pages, layout, today), [fetch_key()], ("seq", "card_no"))
    details = materialise(remote.fetch_details(once, outside.details[site], layout, DETAILS[layout]), "details")
    cached = files.read_numbered_postings(spark, f"{inputs}/{CACHED.format(site)}")
    return collect(pages, details, layout, today, site, fallback=cached)


def sources(spark: SparkSession, targets: dict, outside: Outside, inputs: str, today: str) -> list[DataFrame]:
    """All sources in order of precedence: the chosen sites, the lines typed by hand (also written out in normal form), and saved postings."""
    search = targets.get("job_search") or {}
    chosen = pipeline.chosen_sources(search)
    found = [searched(spark, site, search, outside, inputs, today) for site in LAYOUTS if site in chosen]
    lines = materialise(keep_first(files.read_lines(spark, f"{inputs}/{LINES}", today), ["url"]).drop("first_seen"), "lines")
    files.write_lines(lines, f"{inputs}/{NORMAL_LINES}")
    return [*found, lines, files.read_numbered_postings(spark, f"{inputs}/{MANUAL}")]


def run(spark: SparkSession, places: Places, outside: Outside, today: str, dry_run: bool = False) -> Result:
    """The stages one after another; a dry run looks nothing up in the remote table and sends nothing."""
    remote.register(spark)
    read = lambda path: settings.read_settings(spark, path)
    targets, table = read(places.targets), read(places.remote)
    search, schedule, fields = targets.get("job_search") or {}, targets.get("schedule") or {}, table.get("fields") or {}
    profile = settings.profile(read(places.profile))
    definitions = spark.read.format("remote_fields").option("client", outside.fields).load()
    if dry_run:
        known = spark.createDataFrame([], T.StructType([T.StructField("url", T.StringType()), T.StructField("record_id", T.StringType())]))
    else:
        records = spark.read.format("remote_records").option("client", outside.records).load()
        known = remote_lookup(records.select("seq", "record_id", F.get_json_object("fields", f"$['{fields['url']}']").alias("cell")), "cell", "seq")
    found = pipeline.run(
        sources(spark, targets, outside, places.inputs, today), rules.load(places.scoring, spark=spark),
        settings.materials(spark, read(places.experience), read(places.projects)), materialise(known, "known-records"),
        skills=settings.word_lists(read(places.skills), "skills"), snippets=settings.word_lists(read(places.snippets), "snippets"),
        profile=profile, template=template(spark, places.template, profile), folder=places.output,
        min_score=int(search.get("shortlist_min_score", pipeline.MIN_SCORE)), k=int(schedule.get("max_jobs_per_run", pipeline.TOP_K)),
        fields=fields, definitions=materialise(definitions, "definitions"), defaults=table.get("defaults") or {},
    )
    for name, df in (("jobs", found.merged.drop("first_seen")), ("scored_jobs", found.chosen.drop("first_seen"))):
        files.write_json(df, f"{places.output}/{name}")
    pipeline.write_documents(found.documents, places.output)
    return Result(found.merged, found.chosen, found.documents, remote.apply_upserts(found.plan, outside.sender, dry_run), found.counts)


def run_guarded(spark: SparkSession, places: Places, outside: Outside, today: str, dry_run: bool = False) -> Result:
    """`run`; if it fails, one alert is sent, unless the settings turn alerts off, and the error raised again."""

    def alert(kind: str, text: str) -> None:
        wanted = (settings.read_settings(spark, places.remote).get("alerts") or {}).get("enabled", True)
        if wanted:
            remote.alert("Daily pipeline failed", text, outside.sender)

    return pipeline.guarded(lambda: run(spark, places, outside, today, dry_run), alert)
