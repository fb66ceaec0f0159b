import html
import html.entities
import random
import time

from pyspark.sql import functions as F

from tidemill.functions import extract, text, urls


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_white_space_is_unicode(spark):
    odd = "a\u00a0\u2028b\x0b\x1c\x85c\u3000"
    assert one(spark, text.squeeze(F.lit(odd)), text.squeeze(F.lit(None).cast("string"))) == ("a b c", "")


def test_tokens_keys_slugs(spark):
    assert one(
        spark, text.token(F.lit("Café C++/C#  2x")), text.posting_key(F.lit(""), F.lit("")), text.slug(F.lit("Ünï_code -- x!")), text.slug(F.lit("--"))
    ) == ("caf c c 2x", "|", "ünï-code-x", "job")


def test_tokens_take_one_pass(spark):
    texts = ["\u00a0A\u2028 b\x0b\x1c\x85C\u3000", "\u0130\u212a ΟΔΟΣ x", "\n\t", "", None, "é"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    twice = F.trim(F.regexp_replace(F.lower(text.squeeze("t")), "[^a-z0-9]+", " "))
    assert all(a == b for a, b in df.select(text.token("t"), twice).collect())
    assert df.select(text.token("t").alias("k"))._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1


def test_latex_escapes_backslash_first(spark):
    assert one(spark, text.latex(F.lit("a\\b&{c}"))) == (r"a\textbackslash\{\}b\&\{c\}",)


def test_half_even(spark):
    assert one(spark, F.bround(F.lit(2.5)), F.bround(F.lit(1.5))) == (2.0, 2.0)


def test_html(spark):
    page = "<p>A &amp; B</p>&lt;b&gt; &#233; Caf&eacute; &#8211; &amp;lt;"
    assert one(spark, text.strip_html(F.lit(page)), text.strip_html(F.lit(None).cast("string"))) == ("A & B <b> é Café – &lt;", "")


def test_entities_equal_the_standard_library(spark):
    r = random.Random(1)
    cases = ["&notit; &notin; &copy2 &amp &#x41; &#x80; &#129; &#0; &#xD800; &#99999999999; &#1; &unknown; & x &; a&b &ltfoo; &#x1F600; &#xFFFE; &#38;lt;", "plain", ""]
    names = sorted(html.entities.html5)
    cases += ["".join(r.choice([f"&{r.choice(names)}", f"&#{r.randint(0, 70000)};", "x ", "&", ";"]) for _ in range(6)) for _ in range(400)]
    found = spark.createDataFrame([(c,) for c in cases], "c string").select("c", text.unescape(F.col("c")).alias("u")).collect()
    assert [(x.c, x.u) for x in found] == [(x.c, html.unescape(x.c)) for x in found]


def test_section_replacement_is_literal(spark):
    t = "\\section{A}old\\section{B}x\\section{A}y\\section{B}"
    got = one(spark, text.replace_section(F.lit(t), "A", F.lit("$1\\new"), "B"))[0]
    assert got == "$1\\new\n\n\\section{B}x$1\\new\n\n\\section{B}"


def test_urls(spark):
    cases = {
        "HTTPS://uk.indeed.com/viewjob?jk=ab%20c&x=1#f": ("https://uk.indeed.com/viewjob?jk=ab c", "indeed", "ab c"),
        "https://www.linkedin.com/jobs/view/dev-2024-at-x-1234567890?trk=a": ("https://www.linkedin.com/jobs/view/dev-2024-at-x-1234567890", "linkedin", "1234567890"),
        "https://www.glassdoor.com/j?jl=77&jl=78&z": ("https://www.glassdoor.com/j?jl=77&jl=78", "glassdoor", "j"),
        "https://x.org/a/b/?q=1": ("https://x.org/a/b/", "manual", "b"),
        "https://x.org": ("https://x.org", "manual", "x.org"),
    }
    for raw, want in cases.items():
        cleaned = urls.clean(F.lit(raw))
        assert one(spark, cleaned, urls.source(cleaned), urls.posting_id(cleaned)) == want


CARD_1 = """<li class="x"><a href="https://uk.linkedin.com/jobs/view/dev-2-at-acme-99?refId=1">l</a>
<h3 class="base-search-card__title t"> Dev &amp; Ops </h3><h4 class="base-search-card__subtitle"><a href="u">Acme</a></h4>
<span class="job-search-card__location">Leeds</span><time datetime="2024-05-01"></time> Easy Apply</li>"""
CARD_2 = """<article><a href="/rc/viewjob?jk=k1&amp;from=s" title="Dev">x</a><span data-testid="company-name">Acme</span>
<div data-testid="text-location"> Leeds </div>Easily apply</article>"""


def test_cards(spark):
    pages = spark.createDataFrame([(1, CARD_1 + "<li>no link</li>")], "id int, html string")
    row = extract.parse_cards(pages, 1, "2024-01-01").first()
    assert (row.company, row.position, row.location, row.date, row.easy_apply, row.job_id) == ("Acme", "Dev & Ops", "Leeds", "2024-05-01", True, "2")
    assert row.url == "https://uk.linkedin.com/jobs/view/dev-2-at-acme-99"
    row = extract.parse_cards(spark.createDataFrame([(1, CARD_2)], "id int, html string"), 2, "").first()
    assert (row.url, row.job_id, row.company, row.easy_apply) == ("https://uk.indeed.com/rc/viewjob?jk=k1&from=s", "k1", "Acme", True)


def test_embedded_json(spark):
    page = '{"jobkey":"a1","displayTitle":"D\\u00e9v","company":"X","formattedLocation":"L"}' + " " * 5000 + '{"jobkey":"a2","title":"T"}'
    rows = extract.mine_json(spark.createDataFrame([(7, page + " " * 5000 + page)], "id int, html string"), keep=("id",)).collect()
    assert [(r.id, r.job_id, r.position, r.company, r.location) for r in rows] == [(7, "a1", "Dév", "X", "L")]


def test_embedded_json_cut_and_escaped(spark):
    mark = '{"jobkey":"a"}'
    # a value that the window cuts ends at its last quote, a key inside another's value counts, blanks give way to the next key
    cut = '"title":"' + '\\"x' * 1000
    nested = '"displayTitle":" ","title":"A\\"company":"B &amp; <b>C</b>"'
    pages = spark.createDataFrame([(1, mark + '"company":"C",' + cut), (2, nested + mark), (3, None), (4, "none")], "id int, html string")
    began = time.time()
    got = {r.id: r for r in extract.mine_json(pages, keep=("id",)).collect()}
    assert time.time() - began < 60  # steps in proportion to the window, not to the choices at its escapes
    assert set(got) == {1, 2} and (got[2].position, got[2].company) == ('A"company', "B & C") and got[1].company == "C"
    window = (mark + '"company":"C",' + cut)[: len(mark) - 1 + 2400]
    assert got[1].position == window[: window.rindex('"')].partition('"title":"')[2]  # its last escape is lone, so that none is undone


def test_descriptions_and_blocks(spark):
    one_ = '<div class="show-more-less-html__markup x">A<br>b</div><div>c</div>'
    two = '<div class="q" id="jobDescriptionText">A <b>b</b></div>'
    three = '"jobDescriptionText":"line\\nnext \\u0041"'
    got = one(
        spark, extract.description(F.lit(one_), 1), extract.description(F.lit(two), 2), extract.description(F.lit(three), 2),
        extract.description(F.lit(""), 2), extract.is_blocked(F.lit("x CF-Challenge")),
    )
    assert got == ("A b", "A b", "line next A", "", True)
