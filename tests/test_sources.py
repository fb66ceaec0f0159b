import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tidemill import rules
from tidemill.plans import pipeline
from tidemill.sources import files, remote, settings
from tidemill.streaming.incremental import keep_merged, latest


def page(layout, asked):
    title = asked["keywords" if layout == 1 else "q"]
    if title == "broken":
        raise OSError("down")
    return "x WAF_BLOCK" if title == "refused" else "/".join(asked.values())


def detail(layout, job_id):
    if job_id == "j2":
        raise OSError("down")
    return f"page of {job_id} in {layout}"


def field_client():
    return {"items": [{"field_name": "Link", "ui_type": "Url"}, {"field_name": "State", "ui_type": "SingleSelect"}]}


def records(page_size, token):
    at = int(token or 0)
    items = [{"record_id": f"r{i}", "fields": {"url": f"u{i}"}} for i in range(at, min(at + 2, 5))]
    return {"items": items, "has_more": at + 2 < 5, "page_token": str(at + 2)}


def send(action, record_id, payload, key):
    # a worker does not see the environment of a test, so there the payload names the file
    with open(json.loads(payload).get("to") or os.environ["TIDEMILL_SENT"], "a") as f:
        f.write(json.dumps([action, record_id, payload, key]) + "\n")


def test_search_pages(spark):
    remote.register(spark)
    df = spark.read.format("search_pages").options(
        fetcher="tests.test_sources:page", regions='["r1","r2"]', titles='["a","broken","b"]'
    ).load()
    got = [(r.seq, r.html) for r in df.orderBy("seq").collect()]
    assert got == [(0, "a/r1/r86400/DD/0"), (2, "b/r1/r86400/DD/0"), (3, "a/r2/r86400/DD/0"), (5, "b/r2/r86400/DD/0")]
    two = spark.read.format("search_pages").options(fetcher="tests.test_sources:page", titles='["a","refused"]', layout=2, hours=5).load()
    assert [(r.seq, r.html) for r in two.collect()] == [(0, "a//1/date")]
    with pytest.raises(remote.Blocked):
        remote.refuse_blocked("<title>Blocked - Indeed.com</title>")


def counted(layout, asked):
    """A page that leaves a mark of each call; the look-back tells how often the test may call."""
    with open(asked["location"].partition("@")[2] or os.devnull, "a") as f:
        f.write(f"{asked['keywords']} {asked['f_TPR']}\n")
    return "page"


def test_filters_choose_the_searches(spark, tmp_path):
    remote.register(spark)
    log = tmp_path / "calls"
    df = spark.read.format("search_pages").options(
        fetcher="tests.test_sources:counted", regions=json.dumps([f"r1@{log}", "r2"]), titles='["a","b","c"]', hours="[24,48]"
    ).load()
    some = df.where((F.col("region") == f"r1@{log}") & F.col("search_keyword").isin("a", "b", "zz") & (F.col("hours") == 48) & (F.length("html") > 0))
    assert sorted((r.seq, r.search_keyword, r.hours) for r in some.collect()) == [(1, "a", 48), (3, "b", 48)]
    assert sorted(log.read_text().split("\n")[:-1]) == ["a r172800", "b r172800"]  # no other search was made
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "region" not in plan.partition("Filter")[2].split("\n")[0] and "length(html" in plan
    assert df.where("region = 'r3'").count() == 0 and df.where("region = 'r2' AND search_keyword = 'c'").count() == 2


def viewed(page_size, token, view):
    return {"items": [{"record_id": f"{view}{k}"} for k in range(2)]} if view != "closed" else 1 / 0


def test_views_are_partitions(spark):
    remote.register(spark)
    df = spark.read.format("remote_records").options(client="tests.test_sources:viewed", views='["a","closed","b"]').load()
    assert [(r.view, r.seq, r.record_id) for r in df.where("view IN ('a', 'b')").orderBy("view", "seq").collect()] == [("a", 0, "a0"), ("a", 1, "a1"), ("b", 0, "b0"), ("b", 1, "b1")]


def test_details_and_field_definitions(spark):
    remote.register(spark)
    rows = spark.createDataFrame([(0, 0, "j1"), (0, 1, ""), (0, 2, "j2"), (1, 0, "j3"), (1, 1, "j4")], "seq int, card_no int, job_id string")
    found = remote.fetch_details(rows, "tests.test_sources:detail", 2, 4)
    assert {(r.job_id, r.html) for r in found.collect()} == {("j1", "page of j1 in 2"), ("j3", "page of j3 in 2")}
    fields = spark.read.format("remote_fields").option("client", "tests.test_sources:field_client").load()
    assert {tuple(r) for r in fields.collect()} == {("Link", "Url"), ("State", "SingleSelect")}


def test_remote_records_follow_pages(spark):
    remote.register(spark)
    df = spark.read.format("remote_records").option("client", "tests.test_sources:records").load()
    assert [r.record_id for r in df.orderBy("seq").collect()] == [f"r{i}" for i in range(5)]


def test_upserts_and_alert(spark, tmp_path, monkeypatch):
    sent = tmp_path / "sent"
    monkeypatch.setenv("TIDEMILL_SENT", str(sent))
    to = json.dumps({"to": str(sent)})
    plan = spark.createDataFrame([("create", None, to), ("update", "r1", to)], "action string, record_id string, payload string")
    assert {(r.action, r.n) for r in remote.apply_upserts(plan, "tests.test_sources:send").collect()} == {("create", 1), ("update", 1)}
    assert not sent.exists()  # a dry run sends nothing
    assert remote.alert("s", "d" * 300, "tests.test_sources:send")["details"] == "d" * 120
    with pytest.raises(ZeroDivisionError):
        pipeline.guarded(lambda: 1 / 0, lambda kind, text: remote.alert(kind, text, "tests.test_sources:send"))
    assert len(sent.read_text().splitlines()) == 2
    for _ in range(2):  # the same row has the same key in every attempt
        remote.apply_upserts(plan, "tests.test_sources:send", dry_run=False).collect()
    keys = [json.loads(line)[3] for line in sent.read_text().splitlines()[2:]]
    assert len(keys) == 4 and len(set(keys)) == 2

    def broken(kind, text):
        raise OSError("no alert")

    with pytest.raises(ZeroDivisionError):
        pipeline.guarded(lambda: 1 / 0, broken)
    assert pipeline.chosen_sources({"source": " a "}) == {"a"} and pipeline.chosen_sources({"sources": ["x", "y"]}) == {"x", "y"}
    assert pipeline.chosen_sources({}) == {"linkedin"} == pipeline.chosen_sources({"source": "", "sources": []})


def growing(page_size, token, view):
    """The remote table: what was sent so far, to the file that the view names."""
    with open(view) as f:
        sent = [json.loads(json.loads(line)[2]) for line in f]
    return {"items": [{"record_id": f"r{k}", "fields": {"url": {"link": x["url"]}}} for k, x in enumerate(sent)]}


def test_counts_are_of_what_was_sent(spark, tmp_path):
    """The plan looks into a remote table that grows while it is sent."""
    from tidemill.operators import sync

    sent = tmp_path / "sent"
    sent.touch()
    remote.register(spark)
    there = spark.read.format("remote_records").options(client="tests.test_sources:growing", views=json.dumps([str(sent)])).load()
    seen = sync.remote_lookup(there.select("seq", "record_id", F.get_json_object("fields", "$.url").alias("cell")), "cell", "seq")
    rows = spark.createDataFrame([(f"u{k % 2}", k) for k in range(4)], "url string, seq int")
    plan = sync.plan_upserts(rows, seen).select("action", "record_id", F.to_json(F.struct("url", F.lit(str(sent)).alias("to"))).alias("payload"))
    assert [tuple(r) for r in remote.apply_upserts(plan, "tests.test_sources:send", dry_run=False).collect()] == [("create", 4)]
    lines = [json.loads(x) for x in sent.read_text().splitlines()]
    assert len(lines) == 4 and len({x[3] for x in lines}) == 4  # equal rows are all sent, by keys of their own
    assert {x[3].partition(":")[2] for x in lines} == {"0", "1"}
    again = remote.apply_upserts(plan, "tests.test_sources:send", dry_run=False)
    assert [tuple(r) for r in again.collect()] == [("update", 4)]
    assert remote.apply_upserts(plan.limit(0), "tests.test_sources:send", dry_run=False).count() == 0


def test_a_plan_that_fails_sends_nothing(spark, tmp_path):
    sent = tmp_path / "sent"
    to = json.dumps({"to": str(sent)})
    plan = spark.range(8, numPartitions=4).select(
        F.when(F.col("id") == 7, F.raise_error(F.lit("no"))).otherwise("create").alias("action"), F.lit(None).cast("string").alias("record_id"), F.lit(to).alias("payload")
    )
    with pytest.raises(Exception, match="no"):
        remote.apply_upserts(plan, "tests.test_sources:send", dry_run=False)
    assert not sent.exists()


def test_staged_files_of_an_aborted_job_go(tmp_path):
    from pyspark.sql import Row

    writer = remote._StageWriter({"staging": f"file://{tmp_path}/s"})
    done = writer.write(iter([Row(action="create", record_id=None, payload="p", key="k")]))
    assert (tmp_path / "s" / done.file).exists()
    writer.abort([done, None])
    assert not list((tmp_path / "s").iterdir())
    writer.commit([writer.write(iter([Row(action="create", record_id=None, payload="p", key="k")] * 2)), None])
    part = next(p for p in (tmp_path / "s").iterdir() if p.name.startswith("part-"))
    assert [json.loads(x)["key"] for x in part.read_text().splitlines()] == ["k:0", "k:1"]


def test_json_round_trips(spark, tmp_path):
    rows = [(f"c{k}", "é\n\"x\"" if k % 3 else "", k % 2 == 0) for k in range(50)]
    df = spark.createDataFrame(rows, "company string, description string, easy_apply boolean")
    for name, array in (("lines", False), ("array", True)):
        path = f"file://{tmp_path}/{name}"
        files.write_json(df.repartition(3), path, array)
        back = files.read_postings(spark, path)
        assert {(r.company, r.description, r.easy_apply) for r in back.collect()} == set(rows) and back.count() == 50
    for part in (tmp_path / "array").glob("part-*"):
        assert isinstance(json.loads(part.read_text()), list)
    files.write_json(df.limit(0), f"file://{tmp_path}/none", True)
    assert files.read_postings(spark, f"file://{tmp_path}/none").count() == 0
    files.write_json(df.limit(0), f"file://{tmp_path}/none2")
    assert files.read_postings(spark, f"file://{tmp_path}/none2").count() == 0


def test_text_tree_has_hidden_files(spark, tmp_path):
    root = tmp_path / "tree"
    names = ["a.py", "__init__.py", "_config.yml", ".env.json", "_site/x.md", ".conf/y.yaml"]
    others = [".git/config.yml", ".gitignore", "sub/__pycache__/c.py", "plain", "data.bin"]
    for n in names + others:
        (root / n).parent.mkdir(parents=True, exist_ok=True)
        (root / n).write_text("mail me: a@b.org")
    (root / "data.bin").unlink()
    with open(root / "data.bin", "wb") as f:
        f.truncate(5 << 30)  # never opened
    found = files.read_text_tree(spark, f"file://{root}")
    assert sorted(r.path for r in found.collect()) == sorted(f"file://{root}/{n}" for n in names)
    from tidemill.operators import scan

    assert scan.findings(found, "content", ("path",)).count() == 6 and not scan.clean(scan.findings(found, "content", ("path",)))
    assert scan.clean(scan.findings(found.where("path LIKE '%none%'"), "content", ("path",)))
    (tmp_path / "nothing").mkdir()
    assert files.read_text_tree(spark, f"file://{tmp_path}/nothing").count() == 0


def test_line_numbers_do_not_depend_on_splits(spark, tmp_path):
    for name in ("l1.txt", "l2.txt"):
        (tmp_path / name).write_text("".join(f"http://x.org/{name}/{k} | é{'y' * (k % 37)}\n" for k in range(3000)) + "http://last")
    got = []
    for size in ("128m", "2k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        lines = files.numbered_lines(spark, f"file://{tmp_path}/l*.txt")
        got.append({(r.file.rpartition("/")[2], r.seq, r.value) for r in lines.collect()})
        parts = lines.select("file").distinct().count()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = {(n, k, x) for n in ("l1.txt", "l2.txt") for k, x in enumerate((tmp_path / n).read_text().split("\n"))}
    assert parts == 2 and got == [want, want]


def test_files(spark, tmp_path):
    path = f"file://{tmp_path}"
    assert files.read_postings(spark, f"{path}/none.json").count() == 0
    (tmp_path / "p.json").write_text(json.dumps([{"company": "A", "url": "u", "description": None}, {"position": "é"}]))
    rows = files.read_postings(spark, f"{path}/p.json").collect()
    assert [(r.company, r.position, r.description, r.easy_apply) for r in rows] == [("A", "", "", False), ("", "é", "", False)]
    (tmp_path / "l.txt").write_text("# c\n\nhttp://x.org/a?q=1 | A  B | Dev | L | d | more\nftp://no\nhttp://x.org/a#f\n")
    lines = files.read_lines(spark, f"{path}/l.txt", "2024-01-01")
    assert [(r.url, r.company, r.job_id) for r in lines.orderBy("seq").collect()] == [("http://x.org/a", "A B", "a"), ("http://x.org/a", "", "a")]
    files.write_lines(lines.orderBy("seq").limit(1), f"{path}/out")
    assert spark.read.text(f"{path}/out").first()[0] == "http://x.org/a | A B | Dev | L | d"
    tree = files.read_text_tree(spark, f"{path}/l.txt")
    assert tree.count() == 1 and files.read_lines(spark, f"{path}/none", "").count() == 0


def test_written_files(spark, tmp_path):
    path = f"file://{tmp_path}"
    rows = spark.createDataFrame([(f"{path}/a/x.tex", "é1"), (f"{path}/b/y.tex", None)], "path string, text string")
    for _ in range(2):
        files.write_named_texts(rows)
    assert (tmp_path / "a/x.tex").read_text() == "é1" and (tmp_path / "b/y.tex").read_text() == ""
    files.write_json(rows, f"{path}/j")
    assert spark.read.json(f"{path}/j").count() == 2


def test_settings(spark, tmp_path):
    path = f"file://{tmp_path}"
    assert settings.read_settings(spark, f"{path}/none.yaml") == {} and settings.profile({}) == settings.PROFILE
    (tmp_path / "p.yaml").write_text("identity:\n  full_name: Ann\n  email: ''\n  phone: 123\n")
    found = settings.profile(settings.read_settings(spark, f"{path}/p.yaml"))
    assert (found["full_name"], found["email"], found["phone"]) == ("Ann", settings.PROFILE["email"], "123")
    (tmp_path / "e.yaml").write_text("experience:\n  - id: e1\n    company: Lab\n    title: Intern\n    tags:\n      - api\n    bullets:\n      - Did it.\n    bullet_variants:\n      ai_engineer:\n        - Did AI.\n    role_targets:\n      - ai_engineer\n")
    (tmp_path / "q.yaml").write_text("projects:\n  - id: p1\n    name: Proj\n    date_range: 2025\n    repo_url: http://r\n")
    rows = settings.materials(spark, *(settings.read_settings(spark, f"{path}/{n}.yaml") for n in "eq")).orderBy("kind").collect()
    assert [(r.kind, r.id, r.name, r.date_range, r.ord) for r in rows] == [("experience", "e1", "Lab", None, 0), ("project", "p1", "Proj", "2025", 0)]
    assert rows[0].bullet_variants == {"ai_engineer": ["Did AI."]} and rows[1].bullets == []
    assert settings.materials(spark, {}, {}).count() == 0
    assert settings.word_lists({"skills": {"a": ["x", 1], "b": None}}, "skills") == {"a": ["x", "1"], "b": []}
    (tmp_path / "r.yaml").write_text("hard_filters:\n  title_contains:\n    - Lead\n")
    assert rules.load(f"{path}/r.yaml", spark=spark).hard_title == ["lead"] == rules.load(str(tmp_path / "r.yaml")).hard_title


def test_incremental_merge(spark, tmp_path):
    from tidemill.operators.dedupe import merge_sources

    schema = "seq long, company string, position string, url string, description string, easy_apply boolean"
    source, target = tmp_path / "in", f"file://{tmp_path}/out"
    stream = lambda: spark.readStream.schema(schema).json(str(source))
    assert latest(spark, target) is None
    r = random.Random(7)
    rows = [(k, r.choice("abc"), r.choice("xyz"), r.choice(["", "", f"u{r.randint(0, 5)}"]), r.choice(["", "d", "dd", None, "é" * 5]), r.choice([True, False, None])) for k in range(120)]
    rows.append((200, "new", "new", "", "", False))
    r.shuffle(rows)
    cuts = [0, 60, 61, 110, 121]
    for n, (i, j) in enumerate(zip(cuts, cuts[1:])):
        spark.createDataFrame(rows[i:j], schema).coalesce(1).write.mode("append").json(str(source))
        keep_merged(stream(), target, f"file://{tmp_path}/cp").awaitTermination()
        want = {tuple(x) for x in merge_sources(spark.createDataFrame(rows[:j], schema)).collect()}
        got = [tuple(x) for x in latest(spark, target).select(*schema.replace(",", "").split()[::2], "first_seen").collect()]
        assert len(got) == len(want) and set(got) == want
        assert spark.read.parquet(f"{target}/b{n}").count() <= j - i  # no more than the batch
    (tmp_path / "out/b1/_SUCCESS").unlink()
    with pytest.raises(FileNotFoundError):  # the history is gone
        latest(spark, target)
