"""Tailored documents as text columns: sections, letter and manifest. Compiling them is not done here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_any, latex, replace_section, slug, squeeze
from ..operators.rank import ordered_skills

#: Wording of the documents: fixed values.
GROUP_TITLES = {
    "ai_engineer": "AI / ML", "software_engineer": "Programming / Interfaces",
    "data_scientist": "Evaluation / Delivery", "robotics_engineer": "Engineering Tools",
}
OPENINGS = {
    "ai_engineer": "building practical AI systems",
    "software_engineer": "building maintainable software systems",
    "data_scientist": "using data, metrics and tooling to support better decisions",
    "robotics_engineer": "building reliable robotics and perception software",
}
BACKGROUNDS = {
    "ai_engineer": "My background combines applied AI, backend integration, reproducible workflows and evaluation-minded delivery.",
    "software_engineer": "My background combines backend engineering, testing, debugging and maintainable application structure.",
    "data_scientist": "My background combines data analysis, internal tooling, quality checks and communication around metrics and findings.",
    "robotics_engineer": "My background combines robotics software, perception workflows, modular integration and testing-minded debugging.",
}
ALIGNMENTS = {
    "ai_engineer": "AI workflow design, retrieval and reproducible application orchestration",
    "software_engineer": "backend structure, API-oriented implementation and testing-minded workflow design",
    "data_scientist": "data representation, evaluation logic and practical workflow support",
    "robotics_engineer": "perception software, modular integration and system-focused debugging",
}
STUDIES = {
    True: " Across my studies, internship and projects, I have built systems with reproducible workflows and clear communication.",
    False: " Across my studies, internship experience and software projects, I have built systems that combine implementation detail with reproducible workflows and clear communication.",
}
#: Words, whether all or any of them have to be in the posting, and the sentence that they lead to.
FOCUS_FALLBACKS = (
    (("production", "reliability"), "all", "What attracts me most is the chance to help move systems into reliable, production-ready use."),
    (("internal tools", "stakeholder"), "any", "What attracts me most is the practical focus on building tools that support real internal users and decisions."),
    (("team", "product"), "all", "What attracts me most is the opportunity to work closely across product, engineering and data-facing workflows."),
)
LAST_FOCUS = "What attracts me most is the chance to build practical software and AI systems that are useful for real users."
OWN_FOCUS = "What attracts me most is the practical direction described in the role itself: "
INTERNSHIP = "During my internship, I built internal tooling and supported evaluation-focused delivery work."
INTERNSHIP_TAIL = " That experience strengthened my ability to connect technical implementation with usability, metrics and day-to-day collaboration."
DATA_TAIL = " During my internship, I also built internal analysis tooling and supported metric-oriented reporting and review."
ROBOTICS_TAIL = " That work complemented my internship experience by reinforcing testing-minded engineering habits and system integration awareness."


def _by_family(words: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for family, text in words.items():
        out = F.when(F.col("role_family") == family, text).otherwise(out)
    return out


def focus_sentence(snippets: dict[str, list[str]]) -> Column:
    """The first telling sentence of the posting, else what its words suggest, else a snippet."""
    body = F.lower(squeeze("description"))
    mission = (snippets.get("team_mission") or [LAST_FOCUS])[0]
    out = F.lit(mission)
    for words, how, text in reversed(FOCUS_FALLBACKS):
        each = [contains_any(body, [w]) for w in words]
        out = F.when(each[0] & each[1] if how == "all" else each[0] | each[1], text).otherwise(out)
    own = F.concat(F.lit(OWN_FOCUS), F.get("company_focus", F.lit(0)))
    return F.when(F.size("company_focus") > 0, own).otherwise(out)


def paragraphs(snippets: dict[str, list[str]], compact: bool = False, internship: str = "internship") -> Column:
    """The letter's paragraphs as an array; compact leaves out the fourth. Needs project_names.

    internship: the key of the snippet about it.
    """
    one = F.concat(
        F.lit("I am applying for the "), "position", F.lit(" role at "), "company", F.lit(" because I am interested in "),
        _by_family(OPENINGS, "building practical software systems"),
        F.lit(" that move beyond experimentation and become reliable tools for real users. "), focus_sentence(snippets),
    )
    two = F.concat(_by_family(BACKGROUNDS, BACKGROUNDS["software_engineer"]), F.lit(STUDIES[compact]))
    named = F.array_join(F.slice("project_names", 1, 2), ", ")
    three = F.concat(
        F.lit("My strongest evidence for this role comes from "),
        F.when(F.size("project_names") > 0, named).otherwise("my most relevant projects"),
        F.lit(". In these projects, I worked across "), _by_family(ALIGNMENTS, "real delivery work"),
        F.lit(", which maps well to roles that expect early-career engineers to contribute to real delivery work."),
    )
    usual = (snippets.get(internship) or [INTERNSHIP])[0] + INTERNSHIP_TAIL
    four = (
        F.when(F.col("role_family") == "data_scientist", (snippets.get("data_delivery") or [usual])[0] + DATA_TAIL)
        .when(F.col("role_family") == "robotics_engineer", (snippets.get("robotics") or [usual])[0] + ROBOTICS_TAIL)
        .otherwise(usual)
    )
    five = F.concat(
        F.lit("I believe I would be a strong fit because I bring hands-on experience in Python, delivery-focused engineering work, documentation and collaborative problem-solving, and I am motivated to contribute as I continue growing in a strong team at "),
        "company", F.lit("."),
    )
    return F.array(one, two, three, five) if compact else F.array(one, two, three, four, five)


def letter(snippets: dict[str, list[str]], profile: dict[str, str], compact: bool = False, internship: str = "internship") -> Column:
    p = {k: latex(F.lit(v)) for k, v in profile.items()}
    body = F.array_join(F.transform(paragraphs(snippets, compact, internship), lambda x: latex(x)), "\n\n")
    lines = [
        F.lit("% Generated tailored cover letter.\n\\documentclass[a4paper,11pt]{letter}\n\n\\usepackage[a4paper,top=0.7in,bottom=0.7in,left=0.8in,right=0.8in]{geometry}\n\\usepackage[hidelinks]{hyperref}\n\\usepackage{parskip}\n\n\\begin{document}\n\n\\begin{letter}{}\n\n\\begin{center}"),
        F.concat(F.lit("    {\\Large \\textbf{"), p["full_name"], F.lit("}}\\\\[2pt]")),
        F.concat(F.lit("    \\href{mailto:"), p["email"], F.lit("}{"), p["email"], F.lit("}\n    \\;|\\;")),
        F.concat(p["phone"], F.lit("\n    \\;|\\;")),
        F.concat(F.lit("    \\href{"), p["linkedin_url"], F.lit("}{LinkedIn}\n    \\;|\\;")),
        F.concat(F.lit("    \\href{"), p["portfolio_url"], F.lit("}{Portfolio}\n\\end{center}\n\n\\vspace{-0.1cm}\n")),
        F.concat(F.lit("\\opening{Dear "), latex("company"), F.lit(" Hiring Team,}\n")),
        F.concat(body, F.lit("\n")),
        F.concat(F.lit("\\closing{Yours sincerely,\\\\[2pt] "), p["closing_name"], F.lit("}\n\n\\end{letter}\n\n\\end{document}")),
    ]
    return F.concat_ws("\n", *lines)


def _subheading(one: Column, two: Column, three: Column, four: Column) -> Column:
    return F.concat(
        F.lit("  \\resumeSubheading\n    {"), one, F.lit("}{"), two, F.lit("}\n    {"), three, F.lit("}{"), four,
        F.lit("}\n    \\resumeItemListStart\n"),
    )


def _bullets(x: Column) -> Column:
    rows = F.transform(x, lambda b: F.concat(F.lit("      \\item \\small{"), latex(b), F.lit("}\n")))
    return F.concat(F.array_join(rows, ""), F.lit("    \\resumeItemListEnd\n"))


def sections(ranked: DataFrame, key: str = "seq") -> DataFrame:
    """Per posting: the experience and projects sections, and the names and ids of its projects, in rank order."""
    name = F.when(F.coalesce("repo_url", F.lit("")) != "", F.concat(F.lit("\\href{"), "repo_url", F.lit("}{"), latex("name"), F.lit("}"))).otherwise(latex("name"))
    job = _subheading(latex("name"), latex("location"), latex("title"), latex("date_range"))
    project = _subheading(name, F.lit(""), latex(F.coalesce("title", F.lit("Project"))), latex("date_range"))
    text = F.concat(F.when(F.col("kind") == "experience", job).otherwise(project), _bullets(F.col("selected_bullets")))
    items = ranked.select(key, "kind", F.struct("item_rank", "id", "name", text.alias("text")).alias("item"))
    mine = lambda k: F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.col("item"))))  # noqa: E731  a few per posting
    grouped = items.groupBy(key).agg(mine("experience").alias("e"), mine("project").alias("p"))

    def section(title: str, x: str) -> Column:
        body = F.array_join(F.transform(x, lambda i: F.concat(i["text"], F.lit("\n"))), "")
        return F.concat(F.lit(f"\\section{{{title}}}\n\\resumeSubHeadingListStart\n\n"), body, F.lit("\\resumeSubHeadingListEnd"))

    return grouped.select(
        key, section("Experience", "e").alias("experience_section"), section("Projects", "p").alias("project_section"),
        F.transform("p", lambda i: i["name"]).alias("project_names"), F.transform("p", lambda i: i["id"]).alias("project_ids"),
    )


def skills_section(skills: dict[str, list[str]], limit: int = 12) -> Column:
    def row(x: Column) -> Column:
        title = x["group"]
        for group, text in GROUP_TITLES.items():
            title = F.when(x["group"] == group, text).otherwise(title)
        return F.concat(F.lit("    \\textbf{"), title, F.lit("}{: "), latex(x["skills"]), F.lit("} \\\\"))

    rows = F.transform(F.filter(ordered_skills(skills, limit), lambda x: x["skills"] != ""), row)
    return F.concat(
        F.lit("\\section{Technical Skills}\n\\resumeSubHeadingListStart\n  \\item{\n"), F.array_join(rows, "\n"), F.lit("\n  }\n\\resumeSubHeadingListEnd")
    )


def resume(template: str) -> Column:
    """The template with its three sections replaced and a header. Needs the sections' columns."""
    out = replace_section(F.lit(template), "Experience", F.col("experience_section"), "Projects")
    out = replace_section(out, "Projects", F.col("project_section"), "Technical Skills")
    quoted = F.regexp_replace("skills_section", r"([\\$])", r"\\$1")
    out = F.regexp_replace(out, F.lit(r"(?s)\\section\{Technical Skills\}.*?\\end\{document\}"), F.concat(quoted, F.lit("\n\n\\\\end{document}")))
    header = F.concat(
        F.lit("% Generated for "), "company", F.lit(" - "), "position", F.lit("\n% Selected role family: "), "role_family",
        F.lit("\n% Selected projects: "), F.array_join("project_ids", ", "), F.lit("\n"),
    )
    return F.concat(header, out)


def manifest(folder: str) -> list[Column]:
    """The manifest's columns for the documents of a posting."""
    name = slug(F.concat_ws("-", F.coalesce("company", F.lit("")), F.coalesce("position", F.lit(""))))
    path = lambda kind, suffix: F.concat(F.lit(f"{folder}/{kind}/"), name, F.lit(suffix))
    return [
        F.col("company"), F.col("position"), path("resumes", ".tex").alias("resume_path"), path("coverletters", ".tex").alias("coverletter_path"),
        path("resumes", ".pdf").alias("resume_pdf_path"), path("coverletters", ".pdf").alias("coverletter_pdf_path"),
        F.col("matching_score"), F.col("project_names").alias("selected_projects"),
    ]
