"""The run from settings to effects, with files for the outside world."""

import json

import pytest

from tests.test_functions import CARD_2
from tidemill.plans import daily

CARD_1 = (
    '<li><a href="https://uk.linkedin.com/jobs/view/dev-{0}?x=1">a</a><h3 class="base-search-card__title">{1}</h3>'
    '<h4 class="base-search-card__subtitle">{2}</h4></li>'
)


def _log(place, line):
    with open(place, "a") as f:
        f.write(line + "\n")


def search(layout, asked):
    log = asked["location" if layout == 1 else "l"]
    _log(log, f"search {layout} {asked['keywords' if layout == 1 else 'q']}")
    if layout == 2:
        return "waf_block"
    return "".join(CARD_1.format(k, f"Dev {k}", "Acme") for k in (11, 12, 13))


def detail(layout, job_id):
    if job_id == "13":
        raise OSError("down")
    return f'<div class="show-more-less-html__markup">python and data {job_id}</div>'


def records(page_size, token):
    return {"items": [{"record_id": "r11", "fields": {"The URL": {"link": "https://uk.linkedin.com/jobs/view/dev-11"}}}]}


def definitions():
    return {"items": [{"field_name": "The URL", "ui_type": "Url"}, {"field_name": "Status", "ui_type": "SingleSelect"}]}


def send(action, record_id, payload, key):
    x = json.loads(payload)
    _log(x.get("Log") or x["details"].partition("@")[2], json.dumps([action, record_id, payload, key]))


@pytest.fixture
def world(tmp_path):
    """Settings, inputs and templates as files."""
    texts = {
        "targets.yaml": "schedule:\n  max_jobs_per_run: 4\njob_search:\n  sources:\n    - linkedin\n    - indeed\n  shortlist_min_score: 1\n  regions:\n"
        f"    - {tmp_path}/calls\n  titles:\n    - dev\n    - ops\n",
        "scoring.yaml": "role_tracks:\n  a:\n    title_keywords:\n      - dev\n    jd_keywords:\n      - python\nhard_filters:\n  title_contains:\n    - lead\n",
        "remote.yaml": f"fields:\n  company: Company\n  position: Position\n  url: The URL\n  status: Status\n  progress: Log\n  matching_score: Score\ndefaults:\n  status: New\n  progress: {tmp_path}/sent\n",
        "profile.yaml": "identity:\n  full_name: Ann Lee\n",
        "experience.yaml": "experience:\n  - id: e\n    company: Lab\n    title: Intern\n    tags:\n      - python\n    bullets:\n      - Built data tools.\n",
        "projects.yaml": "projects:\n  - id: p\n    name: Proj\n    tags:\n      - data\n    bullets:\n      - Made it.\n",
        "skills.yaml": "skills:\n  software_engineer:\n    - Python\n",
        "snippets.yaml": "snippets:\n  internship:\n    - I built tools.\n",
        "resume.tex": "{{FULL_NAME}}\n\\\\section{Experience}\n\\\\section{Projects}\n\\\\section{Technical Skills}\n\\\\end{document}",
        "in/manual_job_inputs.txt": "# mine\nhttp://x.org/1 | Beta | Dev lead | | no\nhttp://x.org/2?q=1 | Beta | Dev | | python\nhttp://x.org/2 | Beta | Dev | | again\n",
        "in/manual_indeed_jobs.json": json.dumps([{"company": "Acme", "position": "Dev 12", "url": "", "description": "python"}, {"company": "Gamma", "position": "Cook", "url": "u"}]),
    }
    (tmp_path / "in").mkdir()
    for name, text in texts.items():
        (tmp_path / name).write_text(text.replace("\\\\", "\\"))
    at = lambda n: f"file://{tmp_path}/{n}"
    names = ("targets", "scoring", "remote", "profile", "experience", "projects", "skills", "snippets")
    places = daily.Places(**{n: at(f"{n}.yaml") for n in names}, template=at("resume.tex"), inputs=at("in"), output=at("out"))
    here = "tests.test_daily:{}".format
    each = lambda n: {site: here(n) for site in daily.LAYOUTS}
    return tmp_path, places, daily.Outside(each("search"), each("detail"), here("records"), here("definitions"), here("send"))


def test_whole_run(spark, world):
    folder, places, outside = world
    found = daily.run_guarded(spark, places, outside, "2024-01-01")
    # each search was made once; the site that refuses gave nothing
    calls = (folder / "calls").read_text().split("\n")[:-1]
    assert sorted(calls) == ["search 1 dev", "search 1 ops", "search 2 dev", "search 2 ops"]
    merged = {(r.company, r.position): r for r in found.merged.collect()}
    assert set(merged) == {("Acme", "Dev 11"), ("Acme", "Dev 12"), ("Acme", "Dev 13"), ("Beta", "Dev lead"), ("Beta", "Dev"), ("Gamma", "Cook")}
    assert merged["Acme", "Dev 11"].description == "python and data 11" and merged["Acme", "Dev 13"].description == ""
    chosen = [(r.company, r.position) for r in found.chosen.collect()]
    assert chosen == [("Acme", "Dev 11"), ("Acme", "Dev 12"), ("Beta", "Dev"), ("Acme", "Dev 13")]
    assert {r.action: r.n for r in found.sent.collect()} == {"update": 1, "create": 3}
    assert {k: n for k, n in found.counts.items() if n} == {"merged": 7, "kept": 6, "title_hard_filter": 1, "chosen": 4, "tailored": 4}
    sent = [json.loads(x) for x in (folder / "sent").read_text().splitlines()]
    assert len(sent) == 4 and {x[1] for x in sent} == {"r11", None} and len({x[3] for x in sent}) == 4
    assert {json.loads(x[2])["Status"] for x in sent} == {"New"}
    assert (folder / "out/resumes/acme-dev-11.tex").read_text().count("Ann Lee") == 1
    assert "I built tools." in (folder / "out/coverletters/beta-dev.tex").read_text()
    assert spark.read.json(f"{places.output}/scored_jobs").count() == 4 and spark.read.json(f"{places.output}/generated_manifest").count() == 4
    assert [r.value for r in spark.read.text(f"{places.inputs}/{daily.NORMAL_LINES}").collect()] == ["http://x.org/1 | Beta | Dev lead |  | no", "http://x.org/2 | Beta | Dev |  | python"]
    dry = daily.run(spark, places, outside, "2024-01-01", dry_run=True)
    assert {r.action: r.n for r in dry.sent.collect()} == {"create": 4}
    assert len((folder / "sent").read_text().splitlines()) == 4


def test_cached_postings_and_one_alert(spark, world):
    folder, places, outside = world
    # an inner stage fails: the template is missing; its path carries the place of the alert
    broken = daily.Places(**{**places.__dict__, "template": f"file:///none/x@{folder}/alerts"})
    with pytest.raises(Exception, match="none"):
        daily.run_guarded(spark, broken, outside, "2024-01-01")
    assert not (folder / "sent").exists()
    (folder / "in/manual_indeed_jobs.json").write_text(json.dumps([{"company": "Cached", "position": "Dev", "url": "c", "description": "python"}]))
    two = {**json.loads("{}"), "job_search": {"sources": ["indeed"], "titles": ["dev"], "regions": [f"{folder}/calls"]}}
    found = daily.sources(spark, two, outside, places.inputs, "2024-01-01")
    assert len(found) == 3 and [(r.seq, r.company) for r in found[0].collect()] == [(0, "Cached")]
    assert len(daily.sources(spark, {"job_search": {"source": "other"}}, outside, places.inputs, "2024-01-01")) == 2
