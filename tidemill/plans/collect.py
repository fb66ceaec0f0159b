"""Collection: search pages to postings, with details for the first of them, or the cached ones instead."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.extract import description, is_blocked, mine_json, parse_cards
from ..operators.dedupe import fetch_key, keep_first, limit_per, or_else

#: Rows per search, rows with details, and the least number of rows kept, by layout: fixed values.
ROWS, DETAILS, LEAST_ROWS = {1: 25, 2: 12}, {1: 24, 2: 18}, 24
_PAGE = ("seq", "region", "search_keyword")
_FIELDS = ("company", "position", "url", "date", "location", "easy_apply", "job_id")


def search_rows(pages: DataFrame, layout: int, today: str, rows: int | None = None) -> DataFrame:
    """The postings of search pages (seq, region, search_keyword, html), the first `rows` of each page.

    A page of the second layout that refuses the request gives none; where it has embedded postings,
    its cards are not read.
    """
    key = [*_PAGE, "card_no"]
    if layout == 2:
        open_ = pages.where(~is_blocked("html"))
        mined = mine_json(open_, keep=_PAGE).select(*key, *_FIELDS)
        plain = open_.join(mined.select("seq").distinct(), "seq", "left_anti")
        found = mined.unionByName(parse_cards(plain, 2, today, keep=_PAGE).select(*key, *_FIELDS))
    else:
        found = parse_cards(pages, 1, today, keep=_PAGE).select(*key, *_FIELDS)
    return limit_per(found, "seq", ROWS[layout] if rows is None else rows, "card_no")


def first_rows(rows: DataFrame, n: int) -> DataFrame:
    """The first n rows in order of search and card; n is one of the fixed limits."""
    return rows.orderBy("seq", "card_no").limit(n)


def hydrate(rows: DataFrame, details: DataFrame, layout: int, n: int | None = None) -> DataFrame:
    """rows with a description: that of the detail page for the first n rows, '' for all others.

    details: (job_id, html), one row per identifier, as `remote.fetch_details` gives them.
    """
    first = first_rows(rows, DETAILS[layout] if n is None else n).where("job_id <> ''").select("seq", "card_no", "job_id")
    texts = first.join(details.select("job_id", description("html", layout).alias("description")), "job_id").drop("job_id")
    out = rows.drop("description").join(texts, ["seq", "card_no"], "left")  # at most n rows on the right
    return out.withColumn("description", F.coalesce("description", F.lit("")))


def collect(
    pages: DataFrame, details: DataFrame, layout: int, today: str, source: str, rows: int | None = None, fallback: DataFrame | None = None
) -> DataFrame:
    """All postings of a site: parsed, once per address (else company, position and place), with details, or the fallback if none.

    The result has seq (the place in first-seen order, not dense) and the columns of a posting. Layout 1
    keeps three times the rows of a search, but LEAST_ROWS at least.
    """
    found = search_rows(pages, layout, today, rows)
    one = keep_first(found, [fetch_key()], ("seq", "card_no")).drop("first_seen")
    if layout == 1:
        one = first_rows(one, max(3 * (ROWS[1] if rows is None else rows), LEAST_ROWS))
    whole = hydrate(one, details, layout)
    out = whole.select(
        (F.col("seq") * 1_000_000 + F.col("card_no")).cast("long").alias("seq"), "company", "position", "url", "date", "location",
        F.lit(source).alias("source"), "description", "easy_apply", "search_keyword", "job_id",
    )
    return out if fallback is None else or_else(out, fallback.select(*out.columns))
