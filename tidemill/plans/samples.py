"""Small rule sets and materials for the registered queries, in the vocabulary of the test tables."""

from __future__ import annotations

from ..rules import Rules, build, parse

RULES_TEXT = """
weights:
  role_track_fit: 25
  evidence_skill_fit: 30
  seniority_training_fit: 20
  delivery_workflow_fit: 10
  visa_work_auth_fit: 10
  application_effort_bonus: 5
hard_filters:
  title_contains:
    - idiot
    - le la
  experience_hard_filters:
    - of the of the
    - wh wh
  visa_hard_filters:
    - zz top
  student_status_hard_filters: []
experience_penalties:
  heavy:
    - than than
    - thst the
  medium:
    - and the
visa_medium_risks:
  - enst die
  - que la
visa_soft_risks:
  - defence
  - inthe
  - onwh
role_tracks:
  plain:
    title_keywords: [ ]
    jd_keywords:
      - nothing here
  english:
    title_keywords:
      - the
      - and
      - tion
    jd_keywords:
      - with
      - that
      - er the
      - ing of
  german:
    title_keywords:
      - der
      - und
    jd_keywords:
      - die
      - sch
      - keit
      - lich
  romance:
    title_keywords:
      - de
      - la
    jd_keywords:
      - que
      - ment
      - ción
      - eau
track_evidence_weights:
  english:
    words: 1.0
    ends: 0.5
    rare: 0.25
  german:
    words: 0.3
    ends: 0.9
  romance:
    words: 0.0
    accents: 0.7
strong_evidence_skills:
  words:
    - the
    - that
    - is
  ends:
    - tion
    - ung
    - ment
  accents:
    - é
    - ñ
  rare:
    - thstinnt
    - wh
unsupported_critical_stack:
  gap_a:
    keywords:
      - anin
      - thon
      - ereth
    penalty_if_core: 10
  gap_b:
    keywords:
      - lyat
      - oust
    penalty_if_core: 6
penalty_adjustments:
  training_markers:
    - oner
    - bleen
  unsupported_stack_penalty_reduction_factor: 0.25
seniority_positive:
  title_keywords:
    the: 10
    an: 5
  jd_phrases:
    this: 4
    for: 3
    mit: 6
seniority_negative:
  title_keywords:
    re: -8
  jd_phrases:
    was: -2
delivery_workflow_fit:
  it: 2
  to: 1
  en: 1
  hand: 4
visa_work_auth_fit:
  positive:
    on the: 9
    le la: 12
  neutral_default: 5
  soft_risk_score: 4
  medium_risk_score: 3
risk_penalties:
  clearance_eligibility_risk: 7
  defence_security_sector: 4
  regulated_or_export_risk: 3
application_effort_bonus:
  easy_apply: 5
"""


def rules() -> Rules:
    return build(parse(RULES_TEXT.replace("[ ]", "[]")))


#: Our names of values -> remote fields.
FIELDS = {
    "company": "Company", "position": "Role", "url": "Link", "status": "State", "progress": "Progress", "matching_score": "Score",
    "score_breakdown": "Breakdown", "resume_draft": "Resume",
}
CONTEXT = ("the", "ing", "der", "que")
HIGH_VALUE = ("ing", "that")
BANNED = ("idiot", "zz top")
#: (kind, id, name, title, tags, bullets, bullet_variants, role_targets, ord)
MATERIALS = [
    ("experience", "e1", "Mill", "Miller", ["the", "ing"], ["Ground the grain with that api.", "Kept the race clear; no data lost"], {"data_scientist": ["Und die sql Räder ..."]}, ["ai_engineer"], 0),
    ("experience", "e2", "Weir", "Keeper", ["der", "sch"], ["Held und raised the backend gates...", "Said so again"], {}, ["data_scientist"], 1),
    ("project", "p1", "Sluice", None, ["tion", "la"], ["Motion with that module and vision.", "No words", "Rag, rag and a report of it"], {"robotics_engineer": ["La vision que tourne, testing"]}, ["ai_engineer", "robotics_engineer"], 0),
    ("project", "p2", "Race", None, ["que"], ["Le ciment api docker"], {}, ["software_engineer"], 1),
    ("project", "p3", "Dam", None, ["zz"], ["Plain data"], {}, [], 2),
]

#: Wording and templates of the tailored documents' query: fixed inputs, in place of files.
SKILLS = {"ai_engineer": ["the", "Zeta & co", "and"], "empty": [], "data_scientist": ["ing", "B_1", "of", "Alpha"], "other": ["zzz", "ER"]}
SNIPPETS = {"team_mission": ["I like the {mission}."], "data_delivery": ["I shipped data & reports."], "internship": ["In 2024 I worked at 100% speed."]}
TEMPLATE = "\\begin{document}\n\\section{Experience}\nold\n\\section{Projects}\nold $1\n\\section{Technical Skills}\nold\n\\end{document}"
#: What is appended to a turn's text by the last digit of its number, so that every way to a focus sentence is gone.
ENDINGS = (
    " The team will help to maintain the production workflow and its tooling for internal users.", " A team with a product.",
    " For internal tools", " production and reliability", "",
)
