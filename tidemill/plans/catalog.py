"""The registered queries over the test tables, and the SQL each is checked against.

Postings are bound to the tables as follows: from pages, company is the host, position the first
heading, description the article, location the language; from documents, company is the source,
position and description the text; from conversations, company is the role, position and description
the text. Long positions are reported by their digest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions import urls as U
from ..operators import dedupe, matching, rank, scan, scoring, sync
from ..schema import MATERIAL
from ..sources.files import normal_line, parse_lines, read_lines, read_postings, write_json, write_lines
from ..sources.scratch import new_path
from ..sources.settings import PROFILE
from . import pipeline, samples
from . import oracle as Q

TODAY = "2024-01-01"


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def page_postings(spark: SparkSession, d: str) -> DataFrame:
    pages = _t(spark, d, "pages")
    return pages.select(
        F.col("page_id").alias("seq"), U.host("url").alias("company"),
        X.strip_html(F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1)).alias("position"),
        "url", F.lit("").alias("date"), F.regexp_extract("html", r'<html lang="([^"]*)"', 1).alias("location"),
        F.lit("pages").alias("source"),
        X.strip_html(F.regexp_extract("html", r"(?is)<article[^>]*>(.*?)</article>", 1)).alias("description"),
        F.contains("url", F.lit("?")).alias("easy_apply"), F.lit("").alias("search_keyword"), U.posting_id("url").alias("job_id"),
    )


def document_postings(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = _t(spark, d, "documents"), _t(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    joined = docs.join(labels, "doc_id", "left")
    return joined.select(
        F.col("doc_id").alias("seq"), F.col("source").alias("company"), F.coalesce("text", F.lit("")).alias("position"),
        F.lit("").alias("url"), F.lit("").alias("date"), F.col("lang").alias("location"), F.lit("documents").alias("source"),
        F.col("text").alias("description"), (F.coalesce("q", F.lit(0)) == 1).alias("easy_apply"),
        F.lit("").alias("search_keyword"), F.lit("").alias("job_id"),
    )


def turn_postings(spark: SparkSession, d: str) -> DataFrame:
    turns = _t(spark, d, "conversations")
    return turns.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.col("role").alias("company"), F.coalesce("text", F.lit("")).alias("position"),
        F.lit("").alias("url"), F.lit("").alias("date"), F.lit("").alias("location"), F.lit("turns").alias("source"),
        F.col("text").alias("description"), (F.col("turn") == 0).alias("easy_apply"), F.lit("").alias("search_keyword"), F.lit("").alias("job_id"),
    )


def text_normal(spark, d):
    docs = _t(spark, d, "documents")
    return docs.select(
        "doc_id", F.md5(X.squeeze("text")).alias("squeezed"), F.md5(X.token("text")).alias("tokens"),
        F.md5(X.posting_key("source", "text")).alias("posting_key"), F.md5(X.slug("text")).alias("slug"),
        F.md5(X.body_of("source", "text", "lang")).alias("body"),
    )


def url_fields(spark, d):
    pages = _t(spark, d, "pages").withColumn("cleaned", U.clean("url"))
    return pages.select("page_id", "cleaned", U.source("url").alias("site"), U.posting_id("url").alias("posting_id"))


def url_dedupe(spark, d):
    pages = _t(spark, d, "pages").select(F.col("page_id").alias("seq"), U.clean("url").alias("url"))
    return dedupe.keep_first(pages, ["url"]).select("seq", "url", "first_seen")


def page_fields(spark, d):
    return page_postings(spark, d).where("company <> '' AND position <> ''").select(
        "seq", "company", "position", "location", F.md5("description").alias("description_md5"), F.length("description").cast("long").alias("n")
    )


def page_cards(spark, d):
    from ..functions.extract import cards

    pages = _t(spark, d, "pages")
    each = pages.select("page_id", F.posexplode(cards("html", 1)).alias("card_no", "card"))
    return each.select("page_id", F.col("card_no").cast("long").alias("card_no"), X.strip_html("card").alias("card"))


def merge_sources(spark, d):
    out = pipeline.merge(page_postings(spark, d), document_postings(spark, d), turn_postings(spark, d))
    return out.select(
        "file_ord", "seq", "company", F.md5("position").alias("position"), "source", F.length("description").cast("long").alias("n"),
        F.col("first_seen.file_ord").alias("first_file"), F.col("first_seen.seq").alias("first_seq"),
    )


def fetch_dedupe(spark, d):
    docs = document_postings(spark, d)
    return dedupe.keep_first(docs, [dedupe.fetch_key()]).select("seq", "company", F.md5("position").alias("position"), "location")


def generation_dedupe(spark, d):
    turns = turn_postings(spark, d)
    return dedupe.keep_first(turns, [X.posting_key("company", "position")]).select("seq", "company", F.md5("position").alias("position"))


def hard_filters(spark, d):
    out = pipeline.rejected(document_postings(spark, d), samples.rules())
    return out.select("seq", "reason")


def keyword_scores(spark, d):
    return _scores(document_postings(spark, d))


def page_scores(spark, d):
    return _scores(page_postings(spark, d))


def _scores(postings: DataFrame) -> DataFrame:
    out = pipeline.scored(postings, samples.rules())
    b = lambda n: F.col(f"score_breakdown.{n}")
    return out.select(
        "seq", "matching_score", *[b(n).alias(n) for n in (
            "role_track_fit", "best_track", "evidence_skill_fit", "seniority_training_fit", "delivery_workflow_fit", "visa_work_auth_fit",
            "visa_bucket", "application_effort_bonus", "unsupported_stack_penalty", "experience_penalty", "risk_penalty")],
        *[F.array_join(b(n), ",").alias(n) for n in ("evidence_groups", "unsupported_stack_flags", "risk_flags")],
    )


def breakdown_text(spark, d):
    out = pipeline.scored(page_postings(spark, d), samples.rules())
    return out.select("seq", scoring.breakdown_text().alias("breakdown"))


def scored_dedupe(spark, d):
    best = dedupe.best_scored(pipeline.scored(document_postings(spark, d), samples.rules()))
    return best.select("seq", "company", "matching_score", "first_seen")


def shortlist_pages(spark, d):
    out = pipeline.shortlist(page_postings(spark, d), samples.rules(), min_score=30, k=10)
    return out.select("seq", "company", "position", "matching_score", "first_seen")


def sentence_split(spark, d):
    docs = _t(spark, d, "documents")
    return docs.select("doc_id", F.posexplode(X.sentences("text")).alias("pos", "sentence")).select(
        "doc_id", F.col("pos").cast("long").alias("pos"), F.md5("sentence").alias("sentence_md5")
    )


def context_sentences(spark, d):
    docs = _t(spark, d, "documents")
    found = rank.context_sentences("text", samples.CONTEXT, samples.HIGH_VALUE, samples.BANNED)
    return docs.select("doc_id", F.posexplode(found).alias("rank", "sentence")).select("doc_id", F.col("rank").cast("long").alias("rank"), "sentence")


def _signals(spark, d):
    return rank.with_signals(turn_postings(spark, d))


def role_signals(spark, d):
    return _signals(spark, d).select(
        "seq", "role_family", F.array_join("matched_keywords", ",").alias("matched"), F.array_join("focus_terms", ",").alias("focus")
    )


def materials(spark: SparkSession) -> DataFrame:
    rows = [(k, i, n, t, "", "", "", tags, b, v, targets, o) for k, i, n, t, tags, b, v, targets, o in samples.MATERIALS]
    return spark.createDataFrame(rows, T.StructType(MATERIAL.fields))


def material_ranking(spark, d):
    out = rank.rank_materials(_signals(spark, d), materials(spark), {"experience": 1, "project": 2}, {"experience": 2, "project": 1})
    return out.select("seq", "kind", "item_rank", "id", "item_score", F.array_join("selected_bullets", "|").alias("bullets"))


def part_materials(spark: SparkSession, d: str) -> DataFrame:
    """A material item per part: tags and bullets are runs of its name and kind, so that some occur in many texts."""
    part = _t(spark, d, "part")
    words = F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")
    piece = F.lower(F.substr(F.col("p_type"), F.pmod(F.col("p_partkey"), F.lit(5)).cast("int") + 1, F.lit(3)))
    kind = F.when(F.col("p_size") > 25, "project").otherwise("experience")
    return part.select(
        kind.alias("kind"), F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit("").alias("title"),
        F.lit("").alias("location"), F.lit("").alias("date_range"), F.lit("").alias("repo_url"),
        F.concat(words, F.array(piece, F.lit("the"), piece)).alias("tags"), F.array("p_name", F.concat("p_type", F.lit(" data api"))).alias("bullets"),
        F.create_map(F.lit("data_scientist"), F.array(F.concat(F.lit("sql "), "p_brand"))).alias("bullet_variants"),
        F.when(F.col("p_size") % 5 == 0, F.array(F.lit("data_scientist"), F.lit("software_engineer"))).otherwise(F.array().cast("array<string>")).alias("role_targets"),
        F.col("p_partkey").cast("int").alias("ord"),
    )


def sparse_ranking(spark, d):
    """Items as many as parts, ranked for each turn without meeting all of them."""
    out = rank.rank_materials(_signals(spark, d), part_materials(spark, d), {"experience": 1, "project": 2}, {"experience": 2, "project": 1})
    return out.select("seq", "kind", "item_rank", "id", "item_score", F.array_join("selected_bullets", "|").alias("bullets"))


def benchmark_phrases(spark: SparkSession, d: str) -> DataFrame:
    """A rule table: every run of two and of three words of each benchmark item, its place as its points."""
    words = F.split(F.lower(X.squeeze("text")), " ")
    run = lambda n: F.transform("w", lambda w, i: F.struct(i.alias("i"), F.array_join(F.slice("w", i + 1, n), " ").alias("phrase")))
    each = _t(spark, d, "benchmark").select("item_id", words.alias("w")).select("item_id", F.explode(F.concat(run(2), run(3))).alias("x"))
    return each.select(
        F.lit("item").alias("section"), F.col("item_id").cast("string").alias("grp"), "x.phrase", F.col("x.i").cast("int").alias("phrase_ord"),
        F.col("x.i").cast("double").alias("value"),
    )


def rule_matches(spark, d):
    texts = _t(spark, d, "documents").select("doc_id", F.lower(X.squeeze("text")).alias("body"))
    found = matching.rule_hits(texts, benchmark_phrases(spark, d), "doc_id", "body")
    return found.select("doc_id", F.col("grp").alias("item"), "n", "value")


def private_data(spark, d):
    docs = _t(spark, d, "documents")
    allowed = docs.sparkSession.createDataFrame([("email", "you@example.com"), ("phone", "+44 0000 000000")], "kind string, value string")
    return scan.findings(docs, "text", ("doc_id",), allowed)


def upsert_plan(spark, d):
    orders = _t(spark, d, "orders")
    local = orders.select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("http://c/"), F.col("o_custkey")).alias("url"), "o_orderstatus")
    remote = _t(spark, d, "customer").select(
        F.concat(F.lit("rec"), "c_custkey").alias("record_id"), F.col("c_custkey").alias("at"),
        F.to_json(F.struct(F.concat(F.lit("http://c/"), F.floor(F.col("c_custkey") / 2)).alias("link"))).alias("cell"),
    )
    return sync.plan_upserts(local, sync.remote_lookup(remote, "cell", "at")).select("seq", "url", "record_id", "action")


def upsert_counts(spark, d):
    return sync.action_counts(upsert_plan(spark, d)).select("action", "n")


def manifest_join(spark, d):
    scored = _t(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("company"), F.lit("x").alias("position"), F.col("s_suppkey").alias("seq_s"), F.lit("u").alias("url"))
    made = _t(spark, d, "customer").select(
        F.col("c_nationkey").cast("string").alias("company"), F.lit("x").alias("position"), F.col("c_custkey").alias("seq"), F.col("c_name").alias("resume_path")
    )
    remote = spark.createDataFrame([], "url string, record_id string")
    return sync.plan_upserts(scored, remote, made).select("seq_s", "resume_path", "action")


def payload_fields(spark, d):
    nation = _t(spark, d, "nation")
    values = nation.select("n_nationkey", F.explode(F.create_map(
        F.lit("link"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise(""),
        F.lit("status"), F.col("n_name"), F.lit("tags"), F.col("n_name"), F.lit("made"), F.col("n_name"),
        F.lit("score_breakdown"), F.col("n_name"), F.lit("note"), F.lit(""),
    )).alias("field", "value"))
    fields = spark.createDataFrame([("link", "Url"), ("status", "SingleSelect"), ("tags", "MultiSelect"), ("made", "CreatedTime")], "field string, ui_type string")
    return sync.payload(values, fields).select("n_nationkey", "field", "json")


def region_titles(spark, d):
    regions, titles = _t(spark, d, "region"), _t(spark, d, "nation")
    return regions.crossJoin(F.broadcast(titles)).select(  # a fixed table of nations
        (F.col("r_regionkey") * 1000 + F.col("n_nationkey")).cast("long").alias("seq"), "r_name", "n_name"
    )


def query_limits(spark, d):
    orders = _t(spark, d, "orders").select("o_custkey", "o_orderkey")
    return dedupe.limit_per(orders, "o_custkey", 3, "o_orderkey")


def hydrated(spark, d):
    first = _t(spark, d, "orders").select("o_orderkey", "o_custkey").orderBy("o_orderkey").limit(24)
    return first.join(_t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey", "left").select(
        "o_orderkey", F.coalesce("c_name", F.lit("")).alias("detail")
    )


def hydrated_postings(spark, d):
    """All orders as postings of one search; the first of them get the description of their customer's page."""
    from .collect import hydrate

    rows = _t(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.lit(0).alias("card_no"), F.col("o_custkey").cast("string").alias("job_id"), F.lit("").alias("description"))
    return hydrate(rows, customer_pages(spark, d), 1).select("seq", "job_id", "description")


def json_handover(spark, d):
    """Postings of pages as one stage leaves them, a JSON array per part, and the next one reads them."""
    path = new_path(spark, "postings")
    write_json(page_postings(spark, d).drop("seq"), path, array=True)
    back = read_postings(spark, path)
    return back.select("url", "company", F.md5("position").alias("position"), F.md5("description").alias("description"), "location", "source", "easy_apply")


def line_handover(spark, d):
    """The lines of manual_lines written as a file of lines, and read and parsed again."""
    path = new_path(spark, "lines")
    write_lines(_manual_rows(spark, d), path)
    return read_lines(spark, path, TODAY).select("source", "job_id", "date", normal_line().alias("line"))


def fallback_rows(spark, d):
    nation, region = _t(spark, d, "nation"), _t(spark, d, "region")
    live = nation.where("n_nationkey < 0").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    return dedupe.or_else(live, region.select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")))


def live_rows(spark, d):
    """The other way of fallback_rows: there are live rows, so the fallback is not used."""
    nation, region = _t(spark, d, "nation"), _t(spark, d, "region")
    live = nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    return dedupe.or_else(live, region.select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")))


def text_escapes(spark, d):
    part = _t(spark, d, "part").select("p_partkey", F.concat("p_brand", F.lit("_{&%$\\"), "p_type").alias("t"))
    template = F.lit("Hi {{NAME}}, {{NAME}}: {{KIND}}")
    return part.select("p_partkey", X.latex("t").alias("escaped"), X.fill(template, {"{{NAME}}": F.col("t"), "{{KIND}}": "x"}).alias("filled"))


def _manual_rows(spark, d):
    lines = _t(spark, d, "pages").select(
        F.col("page_id").alias("seq"),
        F.concat(F.when(F.col("page_id") % 7 == 0, "# ").when(F.col("page_id") % 5 == 0, "ftp").otherwise(" "), "url", F.lit(" | Acme  Co | Dev |  | a  b")).alias("value"),
    )
    rows = parse_lines(lines, TODAY, keep=("seq",))
    return dedupe.keep_first(rows, ["url"])


def manual_lines(spark, d):
    return _manual_rows(spark, d).select("seq", "source", "job_id", normal_line().alias("line"))


def search_pages(spark, d):
    """A search page per nation of the suppliers' cards; two suppliers share an address, and some cards lack a company."""
    part = lambda c: c.cast("string")
    supplier, nation = _t(spark, d, "supplier"), _t(spark, d, "nation")
    card = F.concat(
        F.lit('<li><a href="https://uk.linkedin.com/jobs/view/role-at-'), F.lit("x-"), part(F.floor(F.col("s_suppkey") / 2)), F.lit('?refId=1">a</a>'),
        F.lit('<h3 class="base-search-card__title"> '), F.col("s_name"), F.lit(" &amp; &Eacute;&#8211; </h3>"),
        F.when(F.col("s_suppkey") % 11 == 0, "").otherwise(F.concat(F.lit('<h4 class="base-search-card__subtitle">'), F.col("n_name"), F.lit("</h4>"))),
        F.when(F.col("s_suppkey") % 3 == 0, "Easy Apply").otherwise(""), F.lit("</li>"),
    )
    joined = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    cards = joined.groupBy("n_nationkey", "n_name").agg(F.sort_array(F.collect_list(F.struct("s_suppkey", card.alias("card")))).alias("cards"))
    return cards.select(
        F.col("n_nationkey").alias("seq"), F.lit("r").alias("region"), F.col("n_name").alias("search_keyword"),
        F.array_join(F.transform("cards", lambda x: x["card"]), "").alias("html"),
    )


def customer_pages(spark, d):
    """A detail page of the first layout per customer."""
    body = F.concat(F.lit('<div class="show-more-less-html__markup">'), "c_name", F.lit("<br>&lt;"), "c_mktsegment", F.lit("</div>"))
    return _t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("job_id"), body.alias("html"))


def collected_pages(spark, d):
    from .collect import collect

    cached = page_postings(spark, d)
    out = collect(search_pages(spark, d), customer_pages(spark, d), 1, TODAY, "linkedin", rows=9, fallback=cached)
    return out.select("seq", "company", "position", "url", "date", "easy_apply", "job_id", "search_keyword", "description")


def mined_pages(spark, d):
    """Postings embedded in a page per customer, with windows that reach into the neighbours' text."""
    from ..functions.extract import mine_json

    order = _t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority", F.substr(F.col("o_orderdate").cast("string"), F.lit(1), F.lit(10)).alias("day"))

    def entry(x):
        key, half = x["o_orderkey"], F.floor(x["o_orderkey"] / 2).cast("string")
        place = F.when(key % 3 == 0, F.concat(F.lit('"formattedLocation":"F&eacute;'), x["o_orderstatus"], F.lit('",'))).otherwise('"location":"L",')
        title = F.concat(F.lit('"displayTitle":"'), x["o_orderpriority"], F.lit(" &amp;  "), half, F.lit('",'))
        return F.concat(
            F.lit('{"jobkey":"'), half, F.lit('",'), F.when(key % 7 != 0, title).otherwise(""),
            F.lit('"companyName":"C '), x["o_orderstatus"], F.lit('",'), place, F.lit('"pubDate":"'), x["day"], F.lit('"'),
            F.when(key % 5 == 0, ',"isIndeedApply":true').otherwise(""), F.lit("}"), F.repeat(F.lit("x é"), (key % 700).cast("int")),
        )

    # the rows are shuffled narrow; a page's text is made where its rows meet
    each = order.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderstatus", "o_orderpriority", "day"))).alias("e"))
    pages = each.select(F.col("o_custkey").alias("page"), F.array_join(F.transform("e", entry), "").alias("html"))
    out = mine_json(pages, keep=("page",))
    return out.select("page", F.col("card_no").cast("long").alias("card_no"), "position", "company", "location", "date", "easy_apply", "job_id", "url")


def search_pages_2(spark, d):
    """Search pages of the second layout, one per nation: embedded postings, cards, or a page that refuses."""
    part = lambda c: c.cast("string")
    supplier, nation = _t(spark, d, "supplier"), _t(spark, d, "nation")
    job = part(F.floor(F.col("s_suppkey") / 2))
    firm = F.when(F.col("s_suppkey") % 11 == 0, "").otherwise(F.col("n_name"))
    mined = F.concat(
        F.lit('{"jobkey":"'), job, F.lit('","title":"'), "s_name", F.lit('","company":"'), firm, F.lit('","location":"L","datePublished":"D"'),
        F.when(F.col("s_suppkey") % 3 == 0, ',"indeedApply"').otherwise(""), F.lit("}"), F.repeat(F.lit(" "), F.lit(4000)),
    )
    card = F.concat(
        F.lit('<article class="a"><a href="/viewjob?jk='), job, F.lit('&amp;x=1" title="'), "s_name", F.lit('">b</a><span data-testid="company-name"> '), "n_name",
        F.lit("</span>"), F.when(F.col("s_suppkey") % 11 == 0, "").otherwise('<div data-testid="text-location">P &lt;1</div>'),
        F.lit('<span data-testid="myJobsStateDate"> two  days </span>'), F.when(F.col("s_suppkey") % 3 == 0, "Easily apply").otherwise(""), F.lit("</article>"),
    )
    kind = F.col("n_nationkey") % 3
    joined = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    cards = joined.groupBy("n_nationkey", "n_name").agg(
        F.sort_array(F.collect_list(F.struct("s_suppkey", F.when(kind == 0, mined).otherwise(card).alias("card")))).alias("cards")
    )
    return cards.select(
        F.col("n_nationkey").alias("seq"), F.lit("r").alias("region"), F.col("n_name").alias("search_keyword"),
        F.concat(F.when(F.col("n_nationkey") % 5 == 4, "<p>CF-Challenge</p>").otherwise(""), F.array_join(F.transform("cards", lambda x: x["card"]), "")).alias("html"),
    )


def collected_pages_2(spark, d):
    from .collect import collect

    customer = _t(spark, d, "customer")
    body = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit('<div id="jobDescriptionText" x> <b>'), "c_name", F.lit("</b>&lt;")))
    body = F.concat(body, F.lit(" </div>"))
    quoted = F.concat(F.lit('"jobDescriptionText":"'), "c_name", F.lit('\\n\\u00e9 &amp;'), "c_mktsegment", F.lit('"'))
    details = customer.select(F.col("c_custkey").cast("string").alias("job_id"), F.coalesce(body, quoted).alias("html"))
    out = collect(search_pages_2(spark, d), details, 2, TODAY, "indeed", rows=9)
    return out.select("seq", "company", "position", "url", "date", "location", "easy_apply", "job_id", "search_keyword", "description")


def tailored_documents(spark, d):
    """Both documents of every turn, as digests of their whole texts."""
    turns = turn_postings(spark, d)
    ending = F.element_at(F.array(*[F.lit(x) for x in samples.ENDINGS]), (F.col("seq") % len(samples.ENDINGS) + 1).cast("int"))
    jobs = turns.withColumns({"company": F.concat("company", F.lit("_&")), "description": F.concat("position", ending), "matching_score": F.lit(80), "first_seen": F.col("seq")})
    made = pipeline.tailor(jobs, materials(spark), samples.SKILLS, samples.SNIPPETS, PROFILE, samples.TEMPLATE, "out")
    return made.select(
        "seq", F.md5("resume").alias("resume"), F.md5("letter").alias("letter"), F.md5("coverletter_pdf_path").alias("pdf"),
        F.array_join("selected_projects", ",").alias("projects"),
    )


#: Texts of the daily run: fixed inputs, in place of files.
TEMPLATE = "\\section{Experience}\n\\section{Projects}\n\\section{Technical Skills}\n\\end{document}"


def daily(spark: SparkSession, d: str) -> pipeline.Run:
    """The whole run over postings of all three tables."""
    sources = page_postings(spark, d), document_postings(spark, d), turn_postings(spark, d)
    remote = _t(spark, d, "pages").select(
        F.to_json(F.struct(U.clean("url").alias("link"))).alias("cell"), F.concat(F.lit("rec"), "page_id").alias("record_id"), F.col("page_id").alias("at")
    )
    definitions = spark.createDataFrame([("Link", "Url"), ("State", "SingleSelect")], "field string, ui_type string")
    return pipeline.run(
        sources, samples.rules(), materials(spark), sync.remote_lookup(remote, "cell", "at"), skills={"ai_engineer": ["the"]}, snippets={},
        profile=PROFILE, template=TEMPLATE, folder="out", min_score=30, k=10, fields=samples.FIELDS, definitions=definitions,
    )


def daily_run(spark, d):
    plan = daily(spark, d).plan
    return plan.select(
        F.col("first_seen.file_ord").alias("first_file"), F.col("first_seen.seq").alias("first_seq"), "seq", "url", "matching_score",
        F.md5("resume_path").alias("resume_path"), "record_id", "action", F.md5("payload").alias("payload"),
    )


_QUERIES = (
    text_normal, url_fields, url_dedupe, page_fields, page_cards, merge_sources, fetch_dedupe, generation_dedupe, hard_filters,
    keyword_scores, page_scores, breakdown_text, scored_dedupe, shortlist_pages, sentence_split, context_sentences, role_signals,
    material_ranking, sparse_ranking, rule_matches, private_data, upsert_plan, upsert_counts, manifest_join, payload_fields, region_titles, query_limits, hydrated,
    hydrated_postings, json_handover, line_handover,
    fallback_rows, live_rows, text_escapes, manual_lines, collected_pages, collected_pages_2, mined_pages, tailored_documents, daily_run,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {f.__name__: getattr(Q, f.__name__)() for f in _QUERIES if hasattr(Q, f.__name__)}
