"""The stages as compositions of DataFrames: one lazy plan, no process or file between stages."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import posting_key
from ..operators.dedupe import best_scored, keep_first, merge_sources, union_all
from ..operators.rank import rank_materials, with_signals
from ..operators.scoring import reject_reason, score, with_texts
from ..operators.sync import assemble, payload, plan_upserts, records
from ..rules import Rules
from ..sources.files import write_json, write_named_texts
from ..sources.scratch import materialise
from .documents import letter, manifest, resume, sections, skills_section

#: Defaults: fixed values.
TOP_K, MIN_SCORE, DOCUMENT_SCORE = 10, 70, 60
EXPERIENCES = 1
#: Limits of the attempts at documents of one page each, tried in this order.
ATTEMPTS = (
    {"experience_bullets": 4, "project_bullets": 3, "projects": 3, "skills": 12, "compact": False},
    {"experience_bullets": 3, "project_bullets": 3, "projects": 3, "skills": 10, "compact": False},
    {"experience_bullets": 3, "project_bullets": 2, "projects": 3, "skills": 9, "compact": True},
    {"experience_bullets": 2, "project_bullets": 2, "projects": 2, "skills": 8, "compact": True},
)


def merge(*sources: DataFrame) -> DataFrame:
    """The best posting of each key over all sources, with its place in first-seen order."""
    return merge_sources(union_all(*sources), ("file_ord", "seq"))


#: The reasons of the hard filters, as they are counted: fixed values.
REASONS = ("title_hard_filter", "experience_hard_filter", "visa_hard_filter", "student_status_hard_filter")


def scored(postings: DataFrame, rules: Rules, counted: Observation | None = None) -> DataFrame:
    """Postings that pass the hard filters, with their scores; rows are filtered before they are scored.

    counted: gets the number of rows kept and of those rejected by each reason, in the same pass.
    """
    texts = with_texts(postings)
    if counted is None:
        return score(texts.where(reject_reason(rules) == ""), rules)
    reason = F.col("__reason")
    counts = [F.count_if(reason == r).alias(r) for r in REASONS]
    judged = texts.withColumn("__reason", reject_reason(rules)).observe(counted, F.count_if(reason == "").alias("kept"), *counts)
    return score(judged.where(reason == "").drop("__reason"), rules)


def rejected(postings: DataFrame, rules: Rules) -> DataFrame:
    """The postings that a hard filter drops, with the reason."""
    return with_texts(postings).withColumn("reason", reject_reason(rules)).where("reason <> ''")


def shortlist(postings: DataFrame, rules: Rules, min_score: int = MIN_SCORE, k: int = 0, counted: Observation | None = None) -> DataFrame:
    """The k best postings by score, one per company and position; ties in first-seen order.

    Their title and body, which are texts again, are made anew for the k, so that no posting takes them through the shuffle.
    """
    every = scored(postings, rules, counted)
    best = best_scored(every.drop("title", "body"))
    first = best.where(F.col("matching_score") >= min_score).orderBy(F.desc("matching_score"), "first_seen").limit(k or TOP_K)
    return with_texts(first).select(*[c for c in every.columns if c != "first_seen"], "first_seen")


def _place() -> Column:
    """A key that is unique over several sources, which may use the same seq: the place in first-seen order."""
    return F.to_json(F.struct("first_seen"))


def tailor(
    chosen: DataFrame, materials: DataFrame, skills: dict[str, list[str]], snippets: dict[str, list[str]], profile: dict[str, str],
    template: str, folder: str, min_score: int = DOCUMENT_SCORE, attempt: int = 0, internship: str = "internship",
) -> DataFrame:
    """Résumé and letter text and the manifest's columns per posting with min_score or more, within the limits of one attempt."""
    limits = ATTEMPTS[attempt]
    one = keep_first(chosen.where(F.col("matching_score") >= min_score), [posting_key("company", "position")])
    signals = with_signals(one.withColumn("place", _place()))
    bullets = {"experience": limits["experience_bullets"], "project": limits["project_bullets"]}
    ranked = rank_materials(signals, materials, {"experience": EXPERIENCES, "project": limits["projects"]}, bullets, "place")
    whole = signals.join(sections(ranked, "place"), "place").withColumn("skills_section", skills_section(skills, limits["skills"]))
    texts = resume(template).alias("resume"), letter(snippets, profile, limits["compact"], internship).alias("letter")
    return whole.select(*manifest(folder), *texts, "seq")


def tailor_to_fit(fits: Callable[[DataFrame], Column], chosen: DataFrame, *args, **kwargs) -> DataFrame:
    """`tailor` by the first attempt whose texts fit, else by the last, with its number as `attempt`.

    fits: from the table of one attempt to a condition on its resume and letter, say on the pages that a
    compiler counts in them; null is no. Every attempt is made of the postings that did not fit before, and
    of these only, and written down, so that no posting is rendered or judged twice; the rounds end as soon
    as all fit.
    """
    left, done, last = materialise(chosen, "to-fit"), None, len(ATTEMPTS) - 1
    for k in range(len(ATTEMPTS)):
        made = tailor(left, *args, **kwargs, attempt=k)
        fit = F.lit(True) if k == last else F.coalesce(fits(made), F.lit(False))
        made = materialise(made.withColumns({"attempt": F.lit(k), "fit": fit}), "attempt")
        fitting = made.where("fit").drop("fit")
        done = fitting if done is None else done.unionByName(fitting)
        rest = made.where("NOT fit").select(F.col("company").alias("c"), F.col("position").alias("p"))
        if k == last or rest.isEmpty():
            break
        same = F.col("company").eqNullSafe(F.col("c")) & F.col("position").eqNullSafe(F.col("p"))
        left = materialise(left.join(rest, same, "left_semi"), "to-fit")
    return done


def write_documents(made: DataFrame, folder: str) -> None:
    """Each résumé and letter under its path, and the manifest as JSON beside them."""
    texts = made.select(F.explode(F.array(
        F.struct(F.col("resume_path").alias("path"), F.col("resume").alias("text")),
        F.struct(F.col("coverletter_path").alias("path"), F.col("letter").alias("text")),
    )).alias("d")).select("d.*")
    write_named_texts(texts)
    write_json(made.drop("resume", "letter", "seq", "attempt"), f"{folder}/generated_manifest")


def guarded(action: Callable[[], object], alert: Callable[[str, str], object]):
    """Run an action; on failure send one alert and raise the error again, also if the alert fails too."""
    try:
        return action()
    except Exception as error:
        try:
            alert(type(error).__name__, str(error))
        except Exception as second:
            error.add_note(f"the alert failed: {second!r}")
        raise


#: The source where the settings name none: a fixed value.
DEFAULT_SOURCE = "linkedin"


def chosen_sources(search: dict) -> set[str]:
    """The configured set of sources, else the single one; the default where neither names any."""
    many = {str(s) for s in search.get("sources") or []}
    return many or {str(search.get("source", DEFAULT_SOURCE)).strip() or DEFAULT_SOURCE}


@dataclass(frozen=True)
class Run:
    """What one run of the stages gives: the plan lazily, over stages that were each evaluated once and written down."""

    merged: DataFrame
    chosen: DataFrame
    documents: DataFrame
    plan: DataFrame
    #: Rows merged, kept by the hard filters, rejected by each reason, chosen and tailored, counted while they were made.
    counts: dict[str, int]
    #: create and update, once the plan has been evaluated.
    actions: Observation


def run(
    sources: Sequence[DataFrame], rules: Rules, materials: DataFrame, remote: DataFrame, *, skills: dict[str, list[str]], snippets: dict[str, list[str]],
    profile: dict[str, str], template: str, folder: str, min_score: int = MIN_SCORE, k: int = 0, document_score: int | None = None,
    fields: dict[str, str] | None = None, definitions: DataFrame | None = None, defaults: dict[str, str] | None = None,
    internship: str = "internship",
) -> Run:
    """The stages one after another: merge the sources, score and shortlist, tailor documents, plan the upserts.

    sources: postings with seq, in order of precedence among equals, as `collect` and `read_lines` give
    them. remote: (url, record_id), as `sync.remote_lookup` gives it. With fields and definitions the plan
    has the payload of each row, ready for `remote.apply_upserts`.
    """
    seen = {name: Observation() for name in ("merged", "judged", "chosen", "tailored")}
    rows = lambda name: (seen[name], F.count(F.lit(1)).alias(name))
    merged = materialise(merge(*sources).observe(*rows("merged")), "merged")
    chosen = materialise(shortlist(merged, rules, min_score, k, seen["judged"]).observe(*rows("chosen")), "chosen")
    least = min_score if document_score is None else document_score
    made = materialise(tailor(chosen, materials, skills, snippets, profile, template, folder, least, internship=internship).observe(*rows("tailored")), "documents")
    paths = made.select("company", "position", "seq", "resume_path", "coverletter_path", "selected_projects")
    plan = plan_upserts(chosen, remote, paths)
    if fields is not None and definitions is not None:
        # two sources may use the same seq, so rows are keyed by their place
        keyed = plan.withColumn("place", _place())
        shaped = payload(assemble(keyed, fields, defaults, key="place"), definitions, fields.get("score_breakdown", ""))
        plan = keyed.join(records(shaped, "place"), "place").drop("place")
    actions = Observation()
    plan = plan.observe(actions, *[F.count_if(F.col("action") == a).alias(a) for a in ("create", "update")])
    return Run(merged, chosen, made, plan, {k: v for o in seen.values() for k, v in o.get.items()}, actions)
