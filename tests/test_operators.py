import json
import random

from pyspark.sql import functions as F

from tidemill.operators import dedupe, matching, rank, scan, scoring, sync
from tidemill.plans import documents, pipeline
from tidemill.rules import Rules, build
from tidemill.schema import MATERIAL

POST = "seq long, company string, position string, url string, location string, description string, easy_apply boolean"


def postings(spark, rows):
    return spark.createDataFrame(rows, POST)


def test_merge_is_a_fold_whatever_the_partitioning(spark):
    r = random.Random(1)
    rows = [(i, r.choice("ab"), r.choice("xy"), "", "", "d" * r.randint(0, 2), r.random() < 0.5) for i in range(400)]
    best, first = {}, {}
    for row in rows:
        k = (row[1], row[2])
        first.setdefault(k, row[0])
        rank_ = (bool(row[5]), row[6], len(row[5]))
        if k not in best or rank_ > best[k][0]:
            best[k] = (rank_, row[0])
    want = {(first[k], best[k][1]) for k in best}
    for parts in (1, 7):
        shuffled = r.sample(rows, len(rows))
        got = dedupe.merge_sources(postings(spark, shuffled).repartition(parts))
        assert {(x.first_seen, x.seq) for x in got.collect()} == want


def test_link_only_rows_collapse(spark):
    df = postings(spark, [(1, "", "", "u1", "", "", False), (2, "", "", "u2", "", "abc", False)])
    scored = pipeline.scored(df, Rules())
    out = dedupe.best_scored(scored).collect()
    assert [(x.seq, x.first_seen) for x in out] == [(2, 1)]


RULES = build(
    {
        "hard_filters": {"title_contains": ["lead"]},
        "role_tracks": {"a": {"title_keywords": ["dev"], "jd_keywords": ["x1"]}, "b": {"title_keywords": ["ops"], "jd_keywords": ["x1", "x1"]}},
        "track_evidence_weights": {"a": {"g": 0.5}},
        "strong_evidence_skills": {"g": ["py"], "h": ["sql"]},
        "unsupported_critical_stack": {"s": {"keywords": ["k1", "k2"], "penalty_if_core": 10}},
        "penalty_adjustments": {"training_markers": ["train"], "unsupported_stack_penalty_reduction_factor": 0.25},
        "experience_penalties": {"medium": ["3+ years"]},
        "visa_soft_risks": ["defence work", "export"],
    }
)


def scores(spark, position, description, easy=False, rules=RULES):
    df = postings(spark, [(1, "c", position, "", "", description, easy)])
    return pipeline.scored(df, rules).first()


def test_tracks_ties_and_repeated_keywords(spark):
    b = scores(spark, "Dev Ops", "").score_breakdown
    assert (b.best_track, b.role_track_fit) == ("a", 6)  # a tie goes to the first
    b = scores(spark, "Dev Ops", "x1").score_breakdown
    assert (b.best_track, b.role_track_fit) == ("b", 10)  # a keyword listed twice counts twice


def test_evidence_weights(spark):
    b = scores(spark, "Dev", "py sql").score_breakdown
    assert (b.evidence_skill_fit, b.evidence_groups) == (2, ["g"])  # 5 * 0.5 half to even; h has no weight
    b = scores(spark, "Ops", "py sql").score_breakdown
    assert (b.evidence_skill_fit, b.evidence_groups) == (10, ["g", "h"])  # a track without weights gives 1


def test_gaps_and_penalties(spark):
    assert scores(spark, "", "k1 k2").score_breakdown.unsupported_stack_penalty == 10
    assert scores(spark, "", "k1 k2 train").score_breakdown.unsupported_stack_penalty == 2  # 2.5 half to even
    assert scores(spark, "", "k1 k2 surplus").score_breakdown.unsupported_stack_penalty == 0
    b = scores(spark, "", "13+ years export defence work").score_breakdown
    assert (b.experience_penalty, b.risk_penalty, b.risk_flags, b.visa_bucket) == (8, 5, ["defence_security_sector"], "soft_risk")
    assert scores(spark, "", "", True).score_breakdown.application_effort_bonus == 5


def test_hard_filter_is_substring_of_title_only(spark):
    df = postings(spark, [(1, "", "Leading", "", "", "", False), (2, "", "Dev", "", "", "leader", False)])
    assert [r.seq for r in pipeline.rejected(df, RULES).collect()] == [1]


def test_breakdown_text_without_breakdown(spark):
    df = postings(spark, [(1, "c", "Dev", "", "", "", False)])
    out = pipeline.scored(df, RULES).withColumn("score_breakdown", F.when(F.lit(False), F.col("score_breakdown")))
    assert out.select(scoring.breakdown_text()).first()[0] == f"total={out.first().matching_score}"


def test_context_sentences_stop_after_eight(spark):
    s = "This team sentence is long enough to be taken here, number {}."
    text = " ".join(s.format(i) for i in range(9)) + " The production reliability workflow sentence comes too late to be taken."
    got = spark.range(1).select(rank.context_sentences(F.lit(text))).first()[0]
    assert len(got) == 4 and got[0].endswith("number 0.")


def test_private_data(spark):
    df = spark.createDataFrame([(1, "a@b.co you@example.com +44 0000 000000 +1 234-567-8901")], "id int, t string")
    assert {(r.kind, r.value) for r in scan.findings(df, "t", ("id",)).collect()} == {("email", "a@b.co"), ("phone", "+1 234-567-8901")}
    paths = ["/r/.gitignore", "/r/a.py", "/r/Makefile", "/r/.git/x.md", "/r/b.bin", "/r/cv/generated/a.tex"]
    got = spark.createDataFrame([(p,) for p in paths], "p string").where(scan.is_text_path(F.col("p"))).collect()
    assert [r.p for r in got] == ["/r/a.py", "/r/Makefile"]
    files = spark.createDataFrame([("/r/svc.yaml", 'app_id: "X1"\ntable_id: "MINE"'), ("/r/other.yaml", 'app_id: "X1"')], "path string, content string")
    assert [(r.kind, r.value) for r in scan.credentials(files, "svc", ("MINE",)).collect()] == [("app_id", "X1")]


def test_remote_cells_and_last_wins(spark):
    cells = ['"u1"', '[{"link":"u2","text":"t"}]', '{"text":" u3 "}', "[]", '{"link":"u2"}']
    df = spark.createDataFrame([(i, f"r{i}", c) for i, c in enumerate(cells)], "seq long, record_id string, cell string")
    assert {(r.url, r.record_id) for r in sync.remote_lookup(df, "cell", "seq").collect()} == {("u1", "r0"), ("u2", "r4"), ("u3", "r2")}


def test_tailored_documents(spark):
    materials = spark.createDataFrame(
        [
            ("experience", "e", "Lab", "Intern", "Leeds", "2025", "", ["testing"], ["Did testing of tools."], {}, ["software_engineer"], 0),
            ("project", "p", "Proj_1", None, "", "2025", "http://r", ["api"], ["Built an api."], {"software_engineer": ["Wrote python."]}, [], 0),
        ],
        MATERIAL,
    )
    jobs = spark.createDataFrame([(1, "Acme", "Software Engineer", "u", "", "python api testing for a team", False, 80)], POST + ", matching_score int")
    template = "top\\section{Experience}a\\section{Projects}b\\section{Technical Skills}c\\end{document}"
    profile = {k: k for k in ("full_name", "email", "phone", "linkedin_url", "portfolio_url", "closing_name")}
    out = pipeline.tailor(jobs, materials, {"software_engineer": ["SQL", "Python"], "other": []}, {}, profile, template, "out").first()
    assert out.selected_projects == ["Proj_1"] and out.resume_path == "out/resumes/acme-software-engineer.tex"
    assert "% Selected role family: software_engineer" in out.resume and "\\textbf{Programming / Interfaces}{: Python, SQL}" in out.resume
    assert "Did testing of tools, with an emphasis on testing and debugging." in out.resume and "\\href{http://r}{Proj\\_1}" in out.resume
    assert out.resume.endswith("\\end{document}") and "\\section{Experience}\n" in out.resume
    assert "I am applying for the Software Engineer role at Acme" in out.letter and documents.INTERNSHIP in out.letter


def test_fallback_and_limits(spark):
    a, b = spark.createDataFrame([], "k int, seq int"), spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "k int, seq int")
    assert dedupe.or_else(a, b).count() == 3 and dedupe.or_else(b, a).count() == 3
    assert {(r.k, r.seq) for r in dedupe.limit_per(b, "k", 1).collect()} == {(1, 1), (2, 3)}


def test_merged_postings_go_on_to_the_shortlist(spark):
    one = postings(spark, [(1, "a", "dev", "", "", "x1", False), (2, "b", "dev", "", "", "", False), (3, "c", "ops", "", "", "x1", False)])
    two = postings(spark, [(1, "A", "Dev", "", "", "x1 longer", False), (2, "d", "dev", "", "", "x1", False)])
    merged = pipeline.merge(one, two)
    assert sorted((r.company, tuple(r.first_seen)) for r in merged.collect()) == [("A", (0, 1)), ("b", (0, 2)), ("c", (0, 3)), ("d", (1, 2))]
    out = pipeline.shortlist(merged, RULES, min_score=0, k=3).collect()
    assert [(r.company, tuple(r.first_seen)) for r in out] == [("c", (0, 3)), ("A", (0, 1)), ("d", (1, 2))]


def test_run_of_the_stages(spark, tmp_path):
    materials = spark.createDataFrame([("project", "p", "Proj", None, "", "", "", ["x1"], ["Did it."], {}, [], 0)], MATERIAL)
    one = postings(spark, [(1, "a", "dev", "u1", "", "x1", False), (2, "b", "ops", "", "", "x1", False)])
    two = postings(spark, [(1, "c", "dev", "u3", "", "x1", False), (1, "", "dev", "", "", "x1", False)])
    remote = spark.createDataFrame([("u1", "r1")], "url string, record_id string")
    definitions = spark.createDataFrame([("Link", "Url"), ("Made", "CreatedTime")], "field string, ui_type string")
    fields = {"company": "Company", "position": "Role", "url": "Link", "status": "State", "progress": "Made", "matching_score": "Score", "resume_draft": "Resume"}
    profile = {k: k for k in ("full_name", "email", "phone", "linkedin_url", "portfolio_url", "closing_name")}
    texts = {"skills": {"ai_engineer": ["SQL"]}, "snippets": {"mine": ["At the mill I ground."]}, "profile": profile, "template": "\\section{Experience}\\section{Projects}\\section{Technical Skills}\\end{document}"}
    folder = f"file://{tmp_path}/docs"
    found = pipeline.run([one, two], RULES, materials, remote, **texts, folder=folder, min_score=0, k=9, fields=fields, definitions=definitions, internship="mine")
    plan = {(r.company, r.url): r for r in found.plan.collect()}
    assert {k: n for k, n in found.counts.items() if n} == {"merged": 4, "kept": 4, "chosen": 4, "tailored": 4} and found.actions.get == {"create": 3, "update": 1}
    assert {k: (r.action, r.record_id) for k, r in plan.items()} == {("a", "u1"): ("update", "r1"), ("b", ""): ("create", None), ("c", "u3"): ("create", None), ("", ""): ("create", None)}
    assert json.loads(plan["a", "u1"].payload) == {"Company": "a", "Link": {"link": "u1", "text": "u1"}, "Resume": f"{folder}/resumes/a-dev.tex", "Role": "dev", "Score": plan["a", "u1"].matching_score, "State": "Need Review"}
    assert "Link" not in json.loads(plan["b", ""].payload)
    made = {r.company: r for r in found.documents.collect()}
    assert made[""].resume_path.endswith("/resumes/dev.tex") and "At the mill I ground." in made["a"].letter and len(made) == 4
    pipeline.write_documents(found.documents, folder)
    assert (tmp_path / "docs/coverletters/a-dev.tex").read_text() == made["a"].letter
    assert spark.read.json(f"{folder}/generated_manifest").count() == 4
    args = (found.chosen, materials, texts["skills"], texts["snippets"], profile, texts["template"], "out")
    short = pipeline.tailor_to_fit(lambda t: F.length("letter") < F.when(F.col("company") == "a", 1).otherwise(10_000), *args, min_score=0)
    assert {r.company: r.attempt for r in short.collect()} == {"a": 3, "b": 0, "c": 0, "": 0}


def test_collection(spark):
    from tests.test_functions import CARD_1, CARD_2
    from tidemill.plans import collect

    more = CARD_1.replace("acme-99", "acme-77").replace("dev-2-at", "dev-at").replace("Acme", "Other")
    pages = spark.createDataFrame([(0, "r", "k", CARD_1 + more + CARD_1), (1, "r", "l", more)], "seq int, region string, search_keyword string, html string")
    details = spark.createDataFrame([("77", '<div class="show-more-less-html__markup">Body &eacute;</div>')], "job_id string, html string")
    out = collect.collect(pages, details, 1, "2024-01-01", "site").orderBy("seq").collect()
    assert [(r.seq, r.company, r.description, r.search_keyword, r.source) for r in out] == [(0, "Acme", "", "k", "site"), (1, "Other", "Body é", "k", "site")]
    assert [r.company for r in collect.collect(pages, details, 1, "", "site", rows=1).orderBy("seq").collect()] == ["Acme", "Other"]
    mined = '{"jobkey":"a1","displayTitle":"D","company":"X"}'
    two = spark.createDataFrame([(0, "r", "k", CARD_2 + mined), (1, "r", "k", CARD_2), (2, "r", "k", "cf-challenge" + CARD_2.replace("k1", "k2"))], pages.schema)
    none = spark.createDataFrame([], details.schema)
    assert {r.job_id for r in collect.collect(two, none, 2, "", "site").collect()} == {"a1", "k1"}
    cached = postings(spark, [(5, "c", "p", "u", "", "", False)]).withColumns({c: F.lit("") for c in ("date", "source", "search_keyword", "job_id")})
    assert [r.seq for r in collect.collect(two.where("seq = 2"), none, 2, "", "site", fallback=cached).collect()] == [5]


def test_plan_normalises_texts_once(spark):
    df = postings(spark, [(1, "c", "Dev", "", "", "x1", False)])
    plan = pipeline.scored(df, RULES)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("concat_ws( , coalesce(position") == 1 and plan.index("Filter") < plan.index("Generate")


def test_payload_kinds(spark):
    values = spark.createDataFrame([(1, "n", "5", True), (1, "m", "5", True), (1, "z", "0", True), (1, "s", "5", True), (1, "q", 'a"b', False)], "seq int, field string, value string, number boolean")
    kinds = spark.createDataFrame([("m", "MultiSelect"), ("z", "SingleSelect"), ("s", "SingleSelect")], "field string, ui_type string")
    assert sync.records(sync.payload(values, kinds)).first().payload == '{"m":["5"],"n":5,"q":"a\\"b","s":"5"}'


def test_manifest_misses(spark):
    scored = postings(spark, [(1, "a", "x", "u", "", "", False), (2, "b", "x", "v", "", "", False)])
    made = spark.createDataFrame([("a", "x", 1, "old"), ("a", "x", 2, "new")], "company string, position string, seq int, resume_path string")
    out = sync.plan_upserts(scored, spark.createDataFrame([("v", "r")], "url string, record_id string"), made)
    assert {(r.seq, r.resume_path, r.action) for r in out.collect()} == {(1, "new", "create"), (2, None, "update")}


def test_phrases_of_any_length(spark):
    r = random.Random(3)
    texts = [(k, "".join(r.choice("ab \n🙂é") for _ in range(r.randint(0, 60)))) for k in range(60)] + [(90, None), (91, ""), (92, "ab" * 5000)]
    phrases = {"".join(r.choice("ab 🙂é") for _ in range(r.randint(1, 7))) for _ in range(200)} | {"a", "🙂", "\n", "ab" * 40}
    docs = spark.createDataFrame(texts, "id long, body string").repartition(3)
    rules = spark.createDataFrame([(p,) for p in [*phrases, "", None, *list(phrases)[:5]]], "phrase string")
    want = {(k, p) for k, t in texts if t for p in phrases if p in t}
    for few in (10**6, 0):
        matching.FEW_ANCHORS = matching.FEW_PAIRS = few
        found = [tuple(x) for x in matching.phrase_matches(docs, rules, "id", "body").collect()]
        assert len(found) == len(want) and set(found) == want
    matching.FEW_ANCHORS, matching.FEW_PAIRS = 200_000, 100_000
    assert matching.phrase_matches(docs, rules.limit(0), "id", "body").count() == 0
    assert matching.phrase_matches(docs.limit(0), rules, "id", "body").count() == 0


def test_rule_table_counts_like_the_literals(spark):
    df = scoring.with_texts(postings(spark, [(1, "c", "Dev", "", "", "x1 py export k1 train 3+ years", False), (2, "c", "ops lead", "", "", "sql", False)]))
    rows = df.select("seq", "body").collect()
    got = {(r.seq, r.section, r.grp): (r.n, r.value) for r in matching.rule_hits(df.select("seq", "body"), matching.rule_table(spark, RULES), "seq", "body").collect()}
    want = {}
    for r in rows:
        for section, grp, _, phrase, _, value in matching.rule_rows(RULES):
            if phrase in r.body:
                n, v = want.get((r.seq, section, grp), (0, 0.0))
                want[r.seq, section, grp] = (n + 1, v + (value or 0.0))
    assert got == want and got[1, "track_body", "b"] == (2, 4.0)  # listed twice, counted twice


def test_sparse_ranking_equals_the_dense_one(spark):
    r = random.Random(4)
    words = ["data", "python", "api", "the", "c++", "ai", "sensor", "zz", "ros2", "sql", "é", "backend tools"]
    pick = lambda n: [r.choice(words) + r.choice(["", " x", "!"]) for _ in range(r.randint(0, n))]
    rows = []
    for k in range(120):
        kind = r.choice(["experience", "project", "other"])
        variants = {"data_scientist": pick(3)} if k % 3 else None
        rows.append((kind, f"i{k}", f"n{k}", "", "", "", "", pick(4) if k % 7 else None, pick(4) if k % 5 else None, variants, r.sample(list(rank.FAMILIES), r.randint(0, 2)) if k % 4 else None, k))
    items = spark.createDataFrame(rows, MATERIAL)
    jobs = postings(spark, [(k, "c", " ".join(pick(3)), "", "", " ".join(pick(12)) + " testing workflow", False) for k in range(80)])
    signals = rank.with_signals(jobs)
    limits = ({"experience": 1, "project": 3}, {"experience": 2, "project": 2})
    both = []
    for few, entries in ((1000, 1 << 20), (0, 1 << 20), (0, 40)):
        rank.FEW_MATERIALS, rank.BLOCK_ENTRIES = few, entries
        ranked = rank.rank_materials(signals, items, *limits)
        both.append(sorted((x.seq, x.kind, x.item_rank, x.id, x.item_score, tuple(x.selected_bullets)) for x in ranked.collect()))
        if few == 0:
            plan = ranked._jdf.queryExecution().executedPlan().toString()
            assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    rank.FEW_MATERIALS, rank.BLOCK_ENTRIES = 1000, 1 << 20
    assert both[0] == both[1] == both[2] and len(both[0]) > 100
    none = rank.rank_materials(signals.limit(0), items, *limits)
    assert none.count() == 0
    assert "item_score" in ranked.columns and "norm_tags" not in ranked.columns


def test_each_text_is_normalised_once(spark):
    jobs = postings(spark, [(1, "c", "data", "", "", "d", False)])
    plan = rank.with_signals(jobs).select("seq", "role_family", "matched_keywords", "focus_terms")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= 4  # two steps each for title and body


def test_pages_are_made_after_their_rows_met(spark, sf):
    from tidemill.plans import catalog

    plan = catalog.mined_pages(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    collected = plan.partition("collect_list(struct(")[2].partition(")")[0]
    assert "o_orderpriority" in collected and "concat" not in collected and "entry" not in collected


def test_items_of_equal_entries_are_indexed_once(spark):
    rows = [(t, kind, k, 5) for k in range(40) for kind in ("experience", "project", "other") for t in (["", "ta"] if k % 2 else [""])]
    entries = spark.createDataFrame(rows, "term string, kind string, ord int, points int").repartition(3)
    got = {(x.kind, x.ord) for x in rank._first_of_equals(entries, {"experience": 1, "project": 2}).collect()}
    assert got == {("experience", 0), ("experience", 1), ("project", 0), ("project", 1), ("project", 2), ("project", 3)}


def test_phrases_are_found_without_a_row_per_run(spark):
    phrases = ["a", "bc", "the ", "é😀é", "12345678", "123456789", "zz top zz", "8 characters and more"]
    texts = [(1, "x123456789 bc"), (2, "12345678"), (3, "the é😀é of 8 characters and more"), (4, "zz top z"), (5, ""), (6, None)]
    df, table = spark.createDataFrame(texts, "k int, t string"), spark.createDataFrame([(p,) for p in phrases], "phrase string")
    found = matching.phrase_matches(df, table, "k", "t")
    assert {(x.k, x.phrase) for x in found.collect()} == {(k, p) for k, t in texts for p in phrases if t and p in t}
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_rules_are_searched_for_once(spark):
    df = postings(spark, [(1, "c", "Dev", "", "", "x1", False)])
    plan = pipeline.scored(df, RULES)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[defence work,export]") == 1 and plan.count("[k1,k2]") == 1


def test_shortlist_takes_no_texts_of_its_own_through_the_shuffle(spark):
    df = postings(spark, [(1, "c", " Dev ", "", "l", "x1  y", False), (2, "c", "dev", "", "", "", False)])
    out = pipeline.shortlist(df, RULES, min_score=0)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert all("body" not in line and "title" not in line for line in plan.split("\n") if "Aggregate [" in line) and "Aggregate [" in plan
    assert out.columns == [*pipeline.scored(df, RULES).columns, "first_seen"]
    assert [(r.seq, r.title, r.body, r.first_seen) for r in out.collect()] == [(1, "dev", "dev x1 y l", 1)]
