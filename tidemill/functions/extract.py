"""Fields out of raw pages."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import WS, col, squeeze, strip_html, unescape
from .urls import query_values

#: Patterns of the two page layouts: fixed values.
CARDS = (r"(?is)<li[^>]*>(.*?)</li>", r"(?is)<article[^>]*>(.*?)</article>")
LINK_1 = r'(?i)href="(https://(?:[a-z]{2,3}\.)?linkedin\.com/jobs/view/[^"?]*?(\d+)[^"]*)"'
TITLE_1 = r'(?is)class="base-search-card__title[^"]*"[^>]*>\s*(.*?)\s*</h3>'
COMPANY_1 = r'(?is)class="base-search-card__subtitle[^"]*"[^>]*>\s*(?:<a[^>]*>)?(.*?)(?:</a>)?\s*</h4>'
LOCATION_1 = r'(?is)class="job-search-card__location[^"]*"[^>]*>\s*(.*?)\s*</span>'
TIME_1 = r'(?i)<time[^>]*datetime="([^"]+)"'
LINK_2 = r'(?i)href="(/[^"]*viewjob[^"]*)"'
TITLE_2 = r'(?i)title="([^"]+)"'
COMPANY_2 = r'(?s)data-testid="company-name"[^>]*>\s*(.*?)\s*</'
LOCATION_2 = r'(?s)data-testid="text-location"[^>]*>\s*(.*?)\s*</'
DATE_2 = r'(?s)data-testid="myJobsStateDate"[^>]*>\s*(.*?)\s*</'
BODY_1 = r'(?is)class="show-more-less-html__markup[^"]*"[^>]*>(.*?)</div>'
BODY_2 = (r'(?is)<div[^>]+id="jobDescriptionText"[^>]*>(.*?)</div>', r'(?is)"jobDescriptionText":"((?:\\.|[^"])*)"')
BLOCKED = ("blocked - indeed.com", "waf_block", "cf-challenge")
SITE_2 = "https://uk.indeed.com"


def cards(page: Column | str, layout: int) -> Column:
    """The bodies of all cards of a page, in order."""
    return F.regexp_extract_all(col(page), F.lit(CARDS[layout - 1]), F.lit(1))


def first(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(text, pattern, group)


def is_blocked(page: Column | str) -> Column:
    """Whether a page of the second layout is one that refuses the request."""
    low = F.lower(col(page))
    return F.contains(low, F.lit(BLOCKED[0])) | F.contains(low, F.lit(BLOCKED[1])) | F.contains(low, F.lit(BLOCKED[2]))


def card_fields(card: Column | str, layout: int, today: str) -> dict[str, Column]:
    """The posting's fields in a card; url is '' where link, title or company is missing."""
    card = col(card)
    if layout == 1:
        link, title, company = first(card, LINK_1), first(card, TITLE_1), first(card, COMPANY_1)
        url, job_id = F.split(unescape(link), r"\?", 2)[0], first(card, LINK_1, 2)
        date = F.coalesce(F.nullif(first(card, TIME_1), F.lit("")), F.lit(today))
        place, easy = strip_html(first(card, LOCATION_1)), F.contains(card, F.lit("Easy Apply"))
        there = F.regexp_like(card, F.lit(TITLE_1)) & F.regexp_like(card, F.lit(COMPANY_1))
    else:
        link, title, company = unescape(first(card, LINK_2)), first(card, TITLE_2), first(card, COMPANY_2)
        url = F.concat(F.lit(SITE_2), link)
        job_id = F.coalesce(F.get(query_values(url, "jk"), F.lit(0)), F.lit(""))
        date, place = strip_html(first(card, DATE_2)), strip_html(first(card, LOCATION_2))
        easy = F.contains(card, F.lit("Indeed Apply")) | F.contains(card, F.lit("Easily apply"))
        there = F.regexp_like(card, F.lit(TITLE_2)) & F.regexp_like(card, F.lit(COMPANY_2))
    return {
        "company": strip_html(company), "position": strip_html(title), "url": F.when((link != "") & there, url).otherwise(""),
        "date": date, "location": place, "easy_apply": easy, "job_id": job_id,
    }


def parse_cards(pages: DataFrame, layout: int, today: str, page: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per complete card: keep, card_no and the posting's fields."""
    each = pages.select(*keep, F.posexplode(cards(page, layout)).alias("card_no", "card"))
    fields = card_fields("card", layout, today)
    return each.select(*keep, "card_no", *[c.alias(n) for n, c in fields.items()]).where("url <> ''")


def description(page: Column | str, layout: int) -> Column:
    """The description on a detail page, or ''."""
    page = col(page)
    if layout == 1:
        return strip_html(first(page, BODY_1))
    markup, quoted = first(page, BODY_2[0]), first(page, BODY_2[1])
    body = F.when(F.regexp_like(page, F.lit(BODY_2[0])), markup).otherwise(quoted)
    plain = F.coalesce(F.get_json_object(F.concat(F.lit('{"v":"'), body, F.lit('"}')), "$.v"), body)
    return F.when(F.contains(body, F.lit("<")), strip_html(body)).otherwise(squeeze(unescape(plain)))


#: Marks of embedded postings: fixed values.
_ID = r'"jobkey":"([^"]+)"'
_EASY = ('"Indeed Apply"', '"indeedApply"', '"isIndeedApply":true')
#: Field -> the JSON keys that may hold it, in order of preference.
_KEYS = {
    "position": ("displayTitle", "title"),
    "company": ("company", "companyName"),
    "location": ("formattedLocation", "location"),
    "date": ("datePublished", "pubDate"),
}
_BEFORE, _AFTER = 1200, 2400


#: The rest of a JSON string as far as its end; a lone escape at the end of a cut text is left out.
_CLOSED = re.compile(r'(?:[^"\\]++|\\.)*+"', re.S)


def _raw_value(text: str, key: str, start: int, end: int) -> str:
    """The first match of "key":"((?:\\\\.|[^"])*)" between two places, '' without one, in time linear in what lies between.

    A string that is cut before its end stops at its last quote, though that is escaped.
    """
    mark = f'"{key}":"'
    at = text.find(mark, start, end)
    if at < 0:
        return ""
    at += len(mark)
    closed = _CLOSED.match(text, at, end)
    stop = closed.end() - 1 if closed else text.rfind('"', at, end)
    return text[at : max(at, stop)]


def _mined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of what is kept and a page -> rows of what is kept, at, job_id, easy_apply and the raw values of all keys."""
    mark, keys = re.compile(_ID), [k for keys in _KEYS.values() for k in keys]
    kinds = [pa.int32(), pa.string(), pa.bool_(), *[pa.string()] * len(keys)]
    for b in batches:
        pages, rows = [], []
        for page, text in enumerate(b.column(b.num_columns - 1)):
            text = text.as_py() or ""
            for at, m in enumerate(mark.finditer(text)):
                start, end = max(0, m.start() - _BEFORE), m.end() + _AFTER
                easy = any(text.find(e, start, end) >= 0 for e in _EASY)
                pages.append(page)
                rows.append((at, m[1], easy, *(_raw_value(text, k, start, end) for k in keys)))
            if rows and (len(rows) >= 5_000 or page == b.num_rows - 1):
                kept = [c.take(pa.array(pages)) for c in b.columns[:-1]]
                found = [pa.array(v, t) for v, t in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([*kept, *found], [*b.schema.names[:-1], "at", "job_id", "easy_apply", *[f"raw_{k}" for k in keys]])
                pages, rows = [], []


def json_value(keys: tuple[str, ...]) -> Column:
    """The first string of the columns of raw values that has more than white space, JSON escapes decoded, or ''."""
    out = []
    for key in keys:
        raw = F.col(f"raw_{key}")
        plain = F.coalesce(F.get_json_object(F.concat(F.lit('{"v":"'), raw, F.lit('"}')), "$.v"), raw)
        plain = F.when(F.contains(raw, F.lit("\\")), plain).otherwise(raw)
        out.append(F.when(F.regexp_like(plain, F.lit(f"[^{WS[1:]}")), plain))
    return F.coalesce(*out, F.lit(""))


def mine_json(pages: DataFrame, page: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """Postings embedded as JSON: a row per identifier, from the text around it, once per page.

    keep: columns that tell the pages apart. A page is searched where it stands, around each identifier, and
    only the values found leave it.
    """
    keys = [f"raw_{k}" for keys in _KEYS.values() for k in keys]
    wanted = pages.select(*keep, page)
    kinds = [T.StructField("at", T.IntegerType()), T.StructField("job_id", T.StringType()), T.StructField("easy_apply", T.BooleanType())]
    schema = T.StructType([*wanted.schema.fields[:-1], *kinds, *[T.StructField(k, T.StringType()) for k in keys]])
    each = wanted.mapInArrow(_mined, schema)
    # the values come out of a generator of one row, so that each is made once, not again in the filter
    values = F.struct(*[strip_html(json_value(keys)).alias(f) for f, keys in _KEYS.items()])
    fields = each.select(*keep, "at", "job_id", "easy_apply", F.inline(F.array(values))).where("position <> '' AND company <> ''")
    # one page's postings are few: the first of each (identifier, title, company), numbered in order
    rest = F.struct("location", "date", "easy_apply")
    once = fields.groupBy(*keep, "job_id", "position", "company").agg(F.min(F.struct("at", rest.alias("rest"))).alias("m"))
    in_page = Window.partitionBy(*keep).orderBy("m.at")
    return once.select(
        *keep, (F.row_number().over(in_page) - 1).alias("card_no"), "position", "company", "m.rest.*", "job_id",
        F.concat(F.lit(f"{SITE_2}/viewjob?jk="), "job_id").alias("url"),
    )
