"""SQL, for another engine, that gives the rows of each query of the catalog. Written from the definitions."""

from __future__ import annotations

from ..functions import extract as E
from ..operators import rank
from ..sources.settings import PROFILE
from . import documents, samples

WS = r"[\s\x0B\x1c-\x1f\x{85}\p{Z}]"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def squeeze(x: str) -> str:
    return rf"trim(regexp_replace(coalesce({x}, ''), '{WS}+', ' ', 'g'), ' ')"


def token(x: str) -> str:
    return f"trim(regexp_replace(lower({squeeze(x)}), '[^a-z0-9]+', ' ', 'g'), ' ')"


def key(a: str, b: str) -> str:
    return f"({token(a)} || '|' || {token(b)})"


def strip_html(x: str) -> str:
    """The test tables hold no references but these."""
    t = f"regexp_replace(coalesce({x}, ''), '<[^>]+>', ' ', 'g')"
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&ndash;", "–"), ("&mdash;", "—"), ("&Eacute;", "É"), ("&eacute;", "é"), ("&#8211;", "–"), ("&amp;", "&")):
        t = f"replace({t}, {_q(a)}, {_q(b)})"
    return squeeze(t)


def host(u: str) -> str:
    return f"regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"


def clean(u: str) -> str:
    """Test tables hold none of the hosts that keep a query key."""
    return f"rtrim(regexp_extract({u}, '^([^?#]*)', 1), '?')"


def posting_id(u: str) -> str:
    path = f"regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)', 1)"
    keys = ", ".join(f"nullif(regexp_extract({u}, '[?&]{k}=([^&#]+)', 1), '')" for k in ("jk", "jobid", "jobId", "currentJobId"))
    return f"coalesce({keys}, nullif(regexp_extract({path}, '([0-9]{{7,}})', 1), ''), nullif(regexp_extract(rtrim({path}, '/'), '([^/]*)$', 1), ''), {host(u)})"


PAGES = f"""page_postings AS (
  SELECT page_id AS seq, {host('url')} AS company, {strip_html("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} AS position, url,
    regexp_extract(html, '<html lang="([^"]*)"', 1) AS location, 'pages' AS source,
    {strip_html("regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1)")} AS description, contains(url, '?') AS easy_apply FROM pages)"""
DOCS = """doc_postings AS (
  SELECT d.doc_id AS seq, source AS company, coalesce(text, '') AS position, '' AS url, lang AS location, 'documents' AS source,
    text AS description, coalesce(q, 0) = 1 AS easy_apply
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1) l ON d.doc_id = l.doc_id)"""
TURNS = """turn_postings AS (
  SELECT conv_id * 1000 + turn AS seq, role AS company, coalesce(text, '') AS position, '' AS url, '' AS location, 'turns' AS source,
    text AS description, turn = 0 AS easy_apply FROM conversations)"""


def _slug(x: str) -> str:
    return f"coalesce(nullif(trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '-'), ''), 'job')"


def text_normal() -> str:
    slug = _slug("text")
    body = "source || ' ' || text || ' ' || lang"
    return f"""SELECT doc_id, md5({squeeze('text')}) AS squeezed, md5({token('text')}) AS tokens, md5({key('source', 'text')}) AS posting_key,
      md5({slug}) AS slug, md5(lower({squeeze(body)})) AS body FROM documents"""


def url_fields() -> str:
    low = f"lower({clean('url')})"
    site = f"CASE WHEN contains({low}, 'linkedin.com') THEN 'linkedin' WHEN contains({low}, 'indeed.') THEN 'indeed' WHEN contains({low}, 'glassdoor.') THEN 'glassdoor' ELSE 'manual' END"
    return f"SELECT page_id, {clean('url')} AS cleaned, {site} AS site, {posting_id(clean('url'))} AS posting_id FROM pages"


def url_dedupe() -> str:
    return f"SELECT min(page_id) AS seq, {clean('url')} AS url, min(page_id) AS first_seen FROM pages GROUP BY 2"


def page_fields() -> str:
    return f"""WITH {PAGES} SELECT seq, company, position, location, md5(description) AS description_md5, length(description) AS n
      FROM page_postings WHERE company <> '' AND position <> ''"""


def page_cards() -> str:
    return f"""WITH c AS (SELECT page_id, regexp_extract_all(html, '(?is)<li[^>]*>(.*?)</li>', 1) AS a FROM pages),
      e AS (SELECT page_id, unnest(range(len(a))) AS card_no, unnest(a) AS card FROM c)
      SELECT page_id, card_no, {strip_html('card')} AS card FROM e"""


_MERGED = f"""{PAGES}, {DOCS}, {TURNS}, u AS (
        SELECT 0 AS file_ord, * FROM page_postings UNION ALL BY NAME SELECT 1 AS file_ord, * FROM doc_postings
        UNION ALL BY NAME SELECT 2 AS file_ord, * FROM turn_postings),
      k AS (SELECT *, CASE WHEN url <> '' THEN url ELSE {key('company', 'position')} END AS k FROM u),
      r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY (length(description) > 0) DESC, easy_apply DESC, length(description) DESC, file_ord, seq) AS n1,
        first_value(file_ord) OVER (PARTITION BY k ORDER BY file_ord, seq) AS first_file, first_value(seq) OVER (PARTITION BY k ORDER BY file_ord, seq) AS first_seq FROM k),
      merged AS (SELECT * EXCLUDE (n1, k) FROM r WHERE n1 = 1)"""


def merge_sources() -> str:
    return f"WITH {_MERGED} SELECT file_ord, seq, company, md5(position) AS position, source, length(description) AS n, first_file, first_seq FROM merged"


def fetch_dedupe() -> str:
    return f"""WITH {DOCS} SELECT min(seq) AS seq, company, md5(position) AS position, location FROM doc_postings GROUP BY company, doc_postings.position, location"""


def generation_dedupe() -> str:
    return f"""WITH {TURNS}, r AS (SELECT *, row_number() OVER (PARTITION BY {key('company', 'position')} ORDER BY seq) AS n FROM turn_postings)
      SELECT seq, company, md5(position) AS position FROM r WHERE n = 1"""


# -- scoring, spelled out from the rule set ---------------------------------------------------------


def _any(text: str, words) -> str:
    return "(" + (" OR ".join(f"contains({text}, {_q(w)})" for w in words) or "false") + ")"


def _hits(text: str, words) -> str:
    return "(" + (" + ".join(f"contains({text}, {_q(w)})::int" for w in words) or "0") + ")"


def _points(text: str, pairs) -> str:
    return "(" + (" + ".join(f"CASE WHEN contains({text}, {_q(w)}) THEN {v} ELSE 0 END" for w, v in pairs) or "0") + ")"


def _scored(source: str, name: str) -> str:
    r = samples.rules()
    reason = f"""CASE WHEN {_any('title', r.hard_title)} THEN 'title_hard_filter' WHEN {_any('body', r.hard_experience)} THEN 'experience_hard_filter'
      WHEN {_any('body', r.hard_visa)} THEN 'visa_hard_filter' WHEN {_any('body', r.hard_student)} THEN 'student_status_hard_filter' ELSE '' END"""
    raws = [f"6 * {_hits('title', t)} + 2 * {_hits('body', b)}" for t, b in r.tracks.values()]
    best = "CASE " + " ".join(f"WHEN most > 0 AND raw[{i + 1}] = most THEN {_q(t)}" for i, t in enumerate(r.tracks)) + " ELSE '' END"
    weight = {}
    for g in r.evidence:
        cases = " ".join(f"WHEN best_track = {_q(t)} THEN {w.get(g, 0.0)}::double" for t, w in r.evidence_weights.items() if w)
        weight[g] = f"(CASE {cases} ELSE 1.0::double END)"
    counts = {g: f"({_hits('body', k)} > 0 AND {weight[g]} > 0)" for g, k in r.evidence.items()}
    evidence = " + ".join(f"CASE WHEN {counts[g]} THEN least(10, 3 + 2 * {_hits('body', k)}) * {weight[g]} ELSE 0.0::double END" for g, k in r.evidence.items())
    groups = "list_filter([" + ", ".join(f"CASE WHEN {counts[g]} THEN {_q(g)} END" for g in r.evidence) + "], lambda x: x IS NOT NULL)"
    eased, trained = _any("body", ("preferred", "nice to have", "familiarity", "bonus", "desirable", "plus")), _any("body", r.training)
    fires = {g: f"({_hits('body', k)} >= 2 AND NOT {eased})" for g, (k, _) in r.gaps.items()}
    stack = " + ".join(f"CASE WHEN {fires[g]} THEN CASE WHEN {trained} THEN greatest(1, round_even({p} * {r.reduction}, 0))::int ELSE {p} END ELSE 0 END" for g, (_, p) in r.gaps.items())
    flags = "list_filter([" + ", ".join(f"CASE WHEN {fires[g]} THEN {_q(g)} END" for g in r.gaps) + "], lambda x: x IS NOT NULL)"
    visa = " ".join(f"WHEN contains(body, {_q(w)}) THEN {{0}}" .format(min(10, v)) for w, v in r.visa_positive)
    bucket = " ".join(f"WHEN contains(body, {_q(w)}) THEN 'positive'" for w, _ in r.visa_positive)
    medium, soft = _any("body", r.medium_risks), _any("body", r.soft_risks)
    sector = _any("body", [s for s in r.soft_risks if any(t in s for t in ("defence", "defense", "national security", "homeland security", "government clients"))])
    k = r.risk
    return f"""{source}, texts AS (SELECT *, lower({squeeze('position')}) AS title, lower({squeeze("position || ' ' || description || ' ' || location")}) AS body FROM {name}),
      reasons AS (SELECT *, {reason} AS reason FROM texts),
      a AS (SELECT *, [{', '.join(raws)}] AS raw FROM reasons WHERE reason = ''), b AS (SELECT *, list_max(raw) AS most FROM a),
      c AS (SELECT *, {best} AS best_track, least(25, most)::int AS role_track_fit FROM b),
      parts AS (SELECT *, least(30, round_even({evidence}, 0))::int AS evidence_skill_fit, {groups} AS groups,
        greatest(0, least(20, {_points('title', r.title_points)} + {_points('body', r.body_points)}))::int AS seniority_training_fit,
        least(10, {_points('body', r.delivery)})::int AS delivery_workflow_fit,
        (CASE {visa} WHEN {medium} THEN {r.visa_medium} WHEN {soft} THEN {r.visa_soft} ELSE {r.visa_neutral} END)::int AS visa_work_auth_fit,
        CASE {bucket} WHEN {medium} THEN 'medium_risk' WHEN {soft} THEN 'soft_risk' ELSE 'neutral' END AS visa_bucket,
        (CASE WHEN easy_apply THEN 5 ELSE 0 END)::int AS application_effort_bonus, ({stack})::int AS unsupported_stack_penalty, {flags} AS stack_flags,
        (CASE WHEN {_any('body', r.heavy)} THEN 15 WHEN {_any('body', r.medium)} THEN 8 ELSE 0 END)::int AS experience_penalty,
        (CASE WHEN {medium} THEN {k['clearance_eligibility_risk']} ELSE 0 END + CASE WHEN NOT {soft} THEN 0 WHEN {sector} THEN {k['defence_security_sector']} ELSE {k['regulated_or_export_risk']} END)::int AS risk_penalty,
        list_filter([CASE WHEN {medium} THEN 'clearance_eligibility_risk' END, CASE WHEN NOT {soft} THEN NULL WHEN {sector} THEN 'defence_security_sector' ELSE 'regulated_or_export_risk' END], lambda x: x IS NOT NULL) AS risks
        FROM c),
      scored AS (SELECT *, greatest(0, least(100, role_track_fit + evidence_skill_fit + seniority_training_fit + delivery_workflow_fit + visa_work_auth_fit
        + application_effort_bonus - unsupported_stack_penalty - experience_penalty - risk_penalty))::int AS matching_score FROM parts)"""


def hard_filters() -> str:
    return f"WITH {_scored(DOCS, 'doc_postings')} SELECT seq, reason FROM reasons WHERE reason <> ''"


_PARTS = """SELECT seq, matching_score, role_track_fit, best_track, evidence_skill_fit, seniority_training_fit, delivery_workflow_fit, visa_work_auth_fit,
      visa_bucket, application_effort_bonus, unsupported_stack_penalty, experience_penalty, risk_penalty,
      array_to_string(groups, ',') AS evidence_groups, array_to_string(stack_flags, ',') AS unsupported_stack_flags, array_to_string(risks, ',') AS risk_flags FROM scored"""


def keyword_scores() -> str:
    return f"WITH {_scored(DOCS, 'doc_postings')} {_PARTS}"


def page_scores() -> str:
    return f"WITH {_scored(PAGES, 'page_postings')} {_PARTS}"


def breakdown_text() -> str:
    dash = lambda x: f"coalesce(nullif({x}, ''), '-')"
    text = f"""'total=' || matching_score || chr(10) || 'fit: track=' || role_track_fit || ' (' || {dash('best_track')} || '), evidence=' || evidence_skill_fit
      || ' [' || {dash("array_to_string(groups, ', ')")} || '], seniority=' || seniority_training_fit || chr(10) || 'workflow/visa: delivery=' || delivery_workflow_fit
      || ', visa=' || visa_work_auth_fit || ' (' || {dash('visa_bucket')} || '), easy_apply_bonus=' || application_effort_bonus || chr(10)
      || 'penalties: stack=' || unsupported_stack_penalty || ' [' || {dash("array_to_string(stack_flags, ', ')")} || '], experience=' || experience_penalty
      || ', risk=' || risk_penalty || ' [' || {dash("array_to_string(risks, ', ')")} || ']'"""
    return f"WITH {_scored(PAGES, 'page_postings')} SELECT seq, {text} AS breakdown FROM scored"


def _best(source: str, name: str, order: str = "seq") -> str:
    return f"""{_scored(source, name)}, ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY matching_score DESC, length(description) DESC, easy_apply DESC, {order}) AS n1,
      min(seq) OVER (PARTITION BY k) AS first_seen FROM (SELECT *, {key('company', 'position')} AS k FROM scored))"""


def scored_dedupe() -> str:
    return f"WITH {_best(DOCS, 'doc_postings')} SELECT seq, company, matching_score, first_seen FROM ranked WHERE n1 = 1"


def shortlist_pages() -> str:
    return f"""WITH {_best(PAGES, 'page_postings')} SELECT seq, company, position, matching_score, first_seen FROM ranked
      WHERE n1 = 1 AND matching_score >= 30 ORDER BY matching_score DESC, first_seen LIMIT 10"""


def _sentences(x: str) -> str:
    return f"string_split(regexp_replace({squeeze(x)}, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1))"


def sentence_split() -> str:
    return f"""WITH s AS (SELECT doc_id, {_sentences('text')} AS a FROM documents), e AS (SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS s FROM s)
      SELECT doc_id, pos, md5(s) AS sentence_md5 FROM e"""


def context_sentences() -> str:
    low = "lower(s)"
    return f"""WITH s AS (SELECT doc_id, {_sentences('text')} AS a FROM documents), e AS (SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS s FROM s),
      f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM e
        WHERE NOT {_any(low, samples.BANNED)} AND length(s) BETWEEN 40 AND 240 AND {_any(low, samples.CONTEXT)}),
      g AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY 2 * {_hits(low, samples.HIGH_VALUE)} + {_hits(low, samples.CONTEXT)} DESC, pos) AS r FROM f WHERE n <= 8)
      SELECT doc_id, r - 1 AS rank, s AS sentence FROM g WHERE r <= 4"""


def _points_of(name: str) -> str:
    words = rank.FAMILIES[name]
    return f"{_hits('body', words)} + 2 * {_hits('title', words)} + CASE WHEN {_any('title', rank.TITLE_BOOST.get(name, ()))} THEN 6 ELSE 0 END"


def _list(words) -> str:
    return "[" + ", ".join(_q(w) for w in words) + "]::varchar[]"


_SIGNALS = f"""t AS (SELECT *, {token('position')} AS title, {token("position || ' ' || description")} AS body FROM turn_postings),
  p AS (SELECT *, [{', '.join(_points_of(n) for n in rank.FAMILIES)}] AS raw FROM t),
  f AS (SELECT *, CASE WHEN list_max(raw) = 0 THEN 'software_engineer' {' '.join(f"WHEN raw[{i + 1}] = list_max(raw) THEN {_q(n)}" for i, n in enumerate(rank.FAMILIES))} END AS role_family FROM p),
  g AS (SELECT *, list_filter(CASE {' '.join(f"WHEN role_family = {_q(n)} THEN {_list(ws)}" for n, ws in rank.FAMILIES.items())} END, lambda w: contains(body, w))[1:8] AS matched,
    list_filter({_list(rank.FOCUS)}, lambda w: contains(body, w))[1:4] AS focus FROM f)"""
_ROLE = f"{TURNS}, {_SIGNALS}"


def role_signals() -> str:
    return f"WITH {_ROLE} SELECT seq, role_family, array_to_string(matched, ',') AS matched, array_to_string(focus, ',') AS focus FROM g"


def _inside(words: str, text: str) -> str:
    return f"len(list_filter({words}, lambda k: contains({token(text)}, k)))"


def _best_items(items: str, keep=(1, 2), bullets=(2, 1)) -> str:
    """Rows (seq, kind, id, ord, matched, focus, cand, item_score) as the CTE items -> best, the ranked items of the two kinds,
    and x, their bullets."""
    supported = " ".join(f"WHEN k = {_q(t)} THEN {_any(token('bullet'), words)}" for t, words in rank.FOCUS_GUARDS.items())
    phrase = " ".join(f"WHEN term = {_q(t)} THEN {_q(p)}" for t, p in rank.FOCUS.items())
    return f"""{items},
      r AS (SELECT *, row_number() OVER (PARTITION BY seq, kind ORDER BY item_score DESC, ord) AS item_rank FROM items),
      best AS (SELECT * FROM r WHERE item_rank <= CASE kind WHEN 'experience' THEN {keep[0]} ELSE {keep[1]} END),
      e AS (SELECT seq, kind, item_rank, unnest(range(len(cand))) AS i, unnest(cand) AS bullet, matched, focus FROM best),
      b AS (SELECT *, row_number() OVER (PARTITION BY seq, kind, item_rank ORDER BY 3 * {_inside('matched', 'bullet')} + 2 * {_inside('focus', 'bullet')} DESC, i) AS n FROM e),
      w AS (SELECT *, trim(bullet, ' ') AS text, list_filter(focus, lambda k: CASE {supported} END)[1] AS term FROM b WHERE n <= CASE kind WHEN 'experience' THEN {bullets[0]} ELSE {bullets[1]} END),
      x AS (SELECT seq, kind, item_rank, list(CASE WHEN term IS NULL THEN text ELSE regexp_replace(text, '\\.+$', '') || ', ' || CASE {phrase} END || '.' END ORDER BY n) AS bullets FROM w GROUP BY ALL)"""


_RANKED = "SELECT seq, kind, item_rank, id, item_score::int AS item_score, array_to_string(bullets, '|') AS bullets FROM best JOIN x USING (seq, kind, item_rank)"


def _sample_items() -> str:
    items = []
    for kind, id_, name, title, tags, bullets, variants, targets, ord_ in samples.MATERIALS:
        own = " ".join(f"WHEN role_family = {_q(n)} THEN {_list(b)}" for n, b in variants.items())
        cand = f"(CASE {own} ELSE []::varchar[] END || {_list(bullets)})" if own else _list(bullets)
        tagged = " + ".join(f"contains(body, {token(_q(t))})::int" for t in tags)
        items.append(f"""SELECT seq, {_q(kind)} AS kind, {_q(id_)} AS id, {_q(name)} AS name, {'NULL' if title is None else _q(title)}::varchar AS title, {ord_} AS ord, matched, focus, {cand} AS cand,
          5 * ({tagged}) + CASE WHEN list_contains({_list(targets)}, role_family) THEN 8 ELSE 0 END
          + 2 * coalesce(list_sum(list_transform({cand}, lambda b: {_inside('matched', 'b')})), 0) AS item_score FROM g""")
    return f"items AS ({' UNION ALL '.join(items)})"


def material_ranking() -> str:
    return f"WITH {_ROLE}, {_best_items(_sample_items())} {_RANKED}"


def sparse_ranking() -> str:
    """Every turn meets every part here; words are normal already, so that tags and bullets need no normalising."""
    piece = "lower(substr(p_type, p_partkey::int % 5 + 1, 3))"
    return f"""WITH {_ROLE}, m AS (SELECT CASE WHEN p_size > 25 THEN 'project' ELSE 'experience' END AS kind, 'p' || p_partkey AS id, p_partkey AS ord, p_size, p_name, p_type, p_brand,
        list_transform(string_split(lower(p_name || ' ' || p_type), ' ') || [{piece}, 'the', {piece}], lambda t: {token('t')}) AS tags FROM part),
      tagged AS (SELECT kind, ord, t, count(*) AS n FROM (SELECT kind, ord, unnest(tags) AS t FROM m) GROUP BY ALL),
      found AS (SELECT seq, t FROM g JOIN (SELECT DISTINCT t FROM tagged) ON contains(body, t)),
      points AS (SELECT seq, kind, ord, 5 * sum(n) AS p FROM found JOIN tagged USING (t) GROUP BY ALL),
      families AS (SELECT DISTINCT role_family, matched FROM g),
      own AS (SELECT *, CASE WHEN role_family = 'data_scientist' THEN ['sql ' || p_brand] ELSE []::varchar[] END || [p_name, p_type || ' data api'] AS cand FROM families, m),
      base AS (SELECT role_family, matched, kind, id, ord, cand, CASE WHEN p_size % 5 = 0 AND role_family IN ('data_scientist', 'software_engineer') THEN 8 ELSE 0 END
        + 2 * coalesce(list_sum(list_transform(cand, lambda b: {_inside('matched', 'b')})), 0) AS s FROM own),
      {_best_items("""items AS (SELECT g.seq, b.kind, b.id, b.ord, g.matched, g.focus, b.cand, b.s + coalesce(p, 0) AS item_score FROM g
        JOIN base b ON g.role_family = b.role_family AND g.matched = b.matched LEFT JOIN points p ON p.seq = g.seq AND p.kind = b.kind AND p.ord = b.ord)""")} {_RANKED}"""


def rule_matches() -> str:
    return f"""WITH i AS (SELECT item_id, string_split(lower({squeeze('text')}), ' ') AS w FROM benchmark),
      p AS (SELECT item_id, k, array_to_string(w[k + 1 : k + n], ' ') AS phrase FROM (SELECT *, unnest(range(len(w))) AS k FROM i), (VALUES (2), (3)) s(n)),
      d AS (SELECT doc_id, lower({squeeze('text')}) AS body FROM documents),
      f AS (SELECT doc_id, phrase FROM d JOIN (SELECT DISTINCT phrase FROM p WHERE phrase <> '') ON contains(body, phrase))
      SELECT doc_id, item_id::varchar AS item, count(*) AS n, sum(k)::double AS value FROM f JOIN p USING (phrase) GROUP BY ALL"""


def collected_pages() -> str:
    return f"""WITH c AS (SELECT s_nationkey AS page, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS card_no, s_suppkey, s_name, n_name, s_suppkey // 2 AS id
        FROM supplier JOIN nation ON s_nationkey = n_nationkey),
      whole AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY card_no) AS n FROM c WHERE s_suppkey % 11 <> 0),
      r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY page, card_no) AS again FROM whole WHERE n <= 9),
      one AS (SELECT *, row_number() OVER (ORDER BY page, card_no) AS place FROM r WHERE again = 1)
      SELECT (page * 1000000 + card_no)::bigint AS seq, n_name AS company, s_name || ' & É–' AS position, 'https://uk.linkedin.com/jobs/view/role-at-x-' || id AS url,
        '2024-01-01' AS date, s_suppkey % 3 = 0 AS easy_apply, id::varchar AS job_id, n_name AS search_keyword,
        CASE WHEN place <= 24 AND c_custkey IS NOT NULL THEN c_name || ' <' || c_mktsegment ELSE '' END AS description
      FROM one LEFT JOIN customer ON c_custkey = id WHERE place <= 27"""


def mined_pages() -> str:
    mark = E._ID

    def value(keys) -> str:
        found = ", ".join(f"""nullif({squeeze(f"regexp_extract(near, '(?s){_j(k)}:{_J}', 1)")}, '')""" for k in keys)
        return strip_html(f"coalesce({found}, '')")

    easy = " OR ".join(f"contains(near, {_q(e)})" for e in E._EASY)
    entry = """'{"jobkey":"' || o_orderkey // 2 || '",' || CASE WHEN o_orderkey % 7 <> 0 THEN '"displayTitle":"' || o_orderpriority || ' &amp;  ' || o_orderkey // 2 || '",' ELSE '' END
      || '"companyName":"C ' || o_orderstatus || '",' || CASE WHEN o_orderkey % 3 = 0 THEN '"formattedLocation":"F&eacute;' || o_orderstatus || '",' ELSE '"location":"L",' END
      || '"pubDate":"' || strftime(o_orderdate, '%Y-%m-%d') || '"' || CASE WHEN o_orderkey % 5 = 0 THEN ',"isIndeedApply":true' ELSE '' END || '}' || repeat('x é', o_orderkey % 700)"""
    return f"""WITH p AS (SELECT o_custkey AS page, string_agg({entry}, '' ORDER BY o_orderkey) AS html FROM orders GROUP BY 1),
      m AS (SELECT *, regexp_extract_all(html, '{mark}', 1) AS ids, regexp_extract_all(html, '{mark}') AS hits, string_split_regex(html, '{mark}') AS gaps FROM p),
      x AS (SELECT page, unnest(range(len(ids))) AS place, unnest(ids) AS job_id, unnest(list_transform(hits, lambda h: length(h))) AS size, unnest(list_transform(gaps[1:len(ids)], lambda h: length(h))) AS gap FROM m),
      y AS (SELECT *, (sum(size + gap) OVER (PARTITION BY page ORDER BY place))::bigint AS stop FROM x),
      z AS (SELECT *, greatest(0, stop - size - 1200) AS start FROM y),
      n AS (SELECT z.page, place, job_id, substr(html, start + 1, stop + 2400 - start) AS near FROM z JOIN p ON z.page = p.page),
      f AS (SELECT page, place, job_id, {', '.join(f'{value(keys)} AS {name}' for name, keys in E._KEYS.items())}, {easy} AS easy_apply FROM n),
      o AS (SELECT *, row_number() OVER (PARTITION BY page, job_id, position, company ORDER BY place) AS again FROM f WHERE position <> '' AND company <> '')
      SELECT page, row_number() OVER (PARTITION BY page ORDER BY place) - 1 AS card_no, position, company, location, date, easy_apply, job_id,
        '{E.SITE_2}/viewjob?jk=' || job_id AS url FROM o WHERE again = 1"""


#: A JSON string's content, and a key as it stands in a pattern.
_J = r'"((?:\\.|[^"])*)"'


def _j(name: str) -> str:
    return f'"{name}"'


def collected_pages_2() -> str:
    return f"""WITH c AS (SELECT s_nationkey AS page, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS place, s_suppkey, s_name, n_name, s_suppkey // 2 AS id
        FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_nationkey % 5 <> 4),
      mined AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY place) - 1 AS card_no FROM c WHERE page % 3 = 0 AND s_suppkey % 11 <> 0),
      found AS (SELECT page, card_no, s_suppkey, s_name, n_name, id, '{E.SITE_2}/viewjob?jk=' || id AS url, 'D' AS date, 'L' AS location FROM mined
        UNION ALL SELECT page, place, s_suppkey, s_name, n_name, id, '{E.SITE_2}/viewjob?jk=' || id || '&x=1', 'two days', CASE WHEN s_suppkey % 11 = 0 THEN '' ELSE 'P <1' END FROM c WHERE page % 3 <> 0),
      r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY card_no) AS n FROM found),
      u AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page, card_no) AS again FROM r WHERE n <= 9),
      one AS (SELECT *, row_number() OVER (ORDER BY page, card_no) AS place FROM u WHERE again = 1)
      SELECT (page * 1000000 + card_no)::bigint AS seq, n_name AS company, s_name AS position, url, date, location, s_suppkey % 3 = 0 AS easy_apply, id::varchar AS job_id,
        n_name AS search_keyword, CASE WHEN place > 18 OR c_custkey IS NULL THEN '' WHEN c_custkey % 2 = 0 THEN c_name || ' <' ELSE c_name || ' é &' || c_mktsegment END AS description
      FROM one LEFT JOIN customer ON c_custkey = id"""


def latex(x: str) -> str:
    for a, b in (("\\", r"\textbackslash{}"), ("&", r"\&"), ("%", r"\%"), ("$", r"\$"), ("#", r"\#"), ("_", r"\_"), ("{", r"\{"), ("}", r"\}")):
        x = f"replace({x}, {_q(a)}, {_q(b)})"
    return x


def _family(words: dict, other: str) -> str:
    return "CASE role_family " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in words.items()) + f" ELSE {_q(other)} END"


def tailored_documents() -> str:
    D, snippets = documents, samples.SNIPPETS
    nl = lambda *x: " || ".join(x)
    ending = "[" + ", ".join(_q(x) for x in samples.ENDINGS) + f"][seq % {len(samples.ENDINGS)} + 1]"
    low = "lower(s)"
    context = f"""se AS (SELECT seq, unnest(range(len(a))) AS pos, unnest(a) AS s FROM (SELECT seq, {_sentences('description')} AS a FROM g)),
      el AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY pos) AS n FROM se WHERE NOT {_any(low, rank.BANNED)} AND length(s) BETWEEN 40 AND 240 AND {_any(low, rank.CONTEXT)}),
      own AS (SELECT seq, arg_max(s, [2 * {_hits(low, rank.HIGH_VALUE)} + {_hits(low, rank.CONTEXT)}, -pos]) AS sentence FROM el WHERE n <= 8 GROUP BY seq)"""
    bullet = f"array_to_string(list_transform(bullets, lambda b: '      \\item \\small{{' || {latex('b')} || '}}' || chr(10)), '')"
    head = lambda one, three: nl("'  \\resumeSubheading' || chr(10) || '    {'", one, "'}{}' || chr(10) || '    {'", three, "'}{}' || chr(10) || '    \\resumeItemListStart' || chr(10)")
    text = f"{head(latex('name'), latex("coalesce(title, CASE kind WHEN 'project' THEN 'Project' ELSE '' END)"))} || {bullet} || '    \\resumeItemListEnd' || chr(10)"
    section = lambda kind, title: f"'\\section{{{title}}}' || chr(10) || '\\resumeSubHeadingListStart' || chr(10) || chr(10) || coalesce(string_agg(text || chr(10), '' ORDER BY item_rank) FILTER (WHERE kind = '{kind}'), '') || '\\resumeSubHeadingListEnd'"
    groups = []
    for k, (group, names) in enumerate((g, n) for g, n in samples.SKILLS.items() if n):
        each = ", ".join(f"{{'a': CASE WHEN contains(body, {token(_q(n))}) THEN 0 ELSE 1 END, 'l': {_q(n.lower())}, 'k': {i}, 's': {_q(n)}}}" for i, n in enumerate(names))
        listed = f"array_to_string(list_transform(list_sort([{each}])[1:12], lambda x: x.s), ', ')"
        line = nl(f"'    \\textbf{{{D.GROUP_TITLES.get(group, group)}}}{{: '", latex(listed), "'} \\\\'")
        groups.append(f"{{'o': CASE WHEN role_family = {_q(group)} THEN -1 ELSE {k} END, 'g': {_q(group)}, 'line': {line}}}")
    skills = f"'\\section{{Technical Skills}}' || chr(10) || '\\resumeSubHeadingListStart' || chr(10) || '  \\item{{' || chr(10) || array_to_string(list_transform(list_sort([{', '.join(groups)}]), lambda x: x.line), chr(10)) || chr(10) || '  }}' || chr(10) || '\\resumeSubHeadingListEnd'"
    focus = "CASE WHEN sentence IS NOT NULL THEN " + f"{_q(D.OWN_FOCUS)} || sentence"
    for words, how, sentence in D.FOCUS_FALLBACKS:
        focus += f" WHEN {(' AND ' if how == 'all' else ' OR ').join(f'contains(plain, {_q(w)})' for w in words)} THEN {_q(sentence)}"
    focus += f" ELSE {_q(snippets['team_mission'][0])} END"
    usual = snippets["internship"][0] + D.INTERNSHIP_TAIL
    paragraphs = [
        f"'I am applying for the ' || position || ' role at ' || company || ' because I am interested in ' || {_family(D.OPENINGS, '')} || ' that move beyond experimentation and become reliable tools for real users. ' || {focus}",
        f"{_family(D.BACKGROUNDS, '')} || {_q(D.STUDIES[False])}",
        f"'My strongest evidence for this role comes from ' || array_to_string(projects[1:2], ', ') || '. In these projects, I worked across ' || {_family(D.ALIGNMENTS, '')} || ', which maps well to roles that expect early-career engineers to contribute to real delivery work.'",
        _family({"data_scientist": snippets["data_delivery"][0] + D.DATA_TAIL, "robotics_engineer": usual + D.ROBOTICS_TAIL}, usual),
        "'I believe I would be a strong fit because I bring hands-on experience in Python, delivery-focused engineering work, documentation and collaborative problem-solving, and I am motivated to contribute as I continue growing in a strong team at ' || company || '.'",
    ]
    tex = lambda v: v.replace("\\", r"\textbackslash{}").replace("&", r"\&").replace("%", r"\%").replace("$", r"\$").replace("#", r"\#").replace("_", r"\_")
    p = {k: tex(v) for k, v in PROFILE.items()}
    top = (
        "% Generated tailored cover letter.\n\\documentclass[a4paper,11pt]{letter}\n\n\\usepackage[a4paper,top=0.7in,bottom=0.7in,left=0.8in,right=0.8in]{geometry}\n"
        "\\usepackage[hidelinks]{hyperref}\n\\usepackage{parskip}\n\n\\begin{document}\n\n\\begin{letter}{}\n\n\\begin{center}\n"
        f"    {{\\Large \\textbf{{{p['full_name']}}}}}\\\\[2pt]\n    \\href{{mailto:{p['email']}}}{{{p['email']}}}\n    \\;|\\;\n{p['phone']}\n    \\;|\\;\n"
        f"    \\href{{{p['linkedin_url']}}}{{LinkedIn}}\n    \\;|\\;\n    \\href{{{p['portfolio_url']}}}{{Portfolio}}\n\\end{{center}}\n\n\\vspace{{-0.1cm}}\n\n\\opening{{Dear "
    )
    end = f" Hiring Team,}}\n\n"
    close = f"\n\n\\closing{{Yours sincerely,\\\\[2pt] {p['closing_name']}}}\n\n\\end{{letter}}\n\n\\end{{document}}"
    letter = nl(_q(top), latex("company"), _q(end), " || chr(10) || chr(10) || ".join(latex(f"({x})") for x in paragraphs), _q(close))
    resume = nl("'% Generated for ' || company || ' - ' || position || chr(10) || '% Selected role family: ' || role_family || chr(10) || '% Selected projects: '",
        "array_to_string(ids, ', ')", "chr(10)", _q(samples.TEMPLATE.partition("\\section")[0]), "experience", "chr(10) || chr(10)", "project", "chr(10) || chr(10)", skills, "chr(10) || chr(10) || '\\end{document}'")
    return f"""WITH {TURNS}, d AS (SELECT seq, company || '_&' AS company, position, position || {ending} AS description FROM turn_postings),
      first AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY {key('company', 'position')} ORDER BY seq) AS n FROM d) WHERE n = 1),
      {_SIGNALS.replace('FROM turn_postings', 'FROM first')}, {context},
      {_best_items(_sample_items(), (1, 3), (4, 3))},
      texts AS (SELECT best.seq, kind, item_rank, id, name, {text} AS text FROM best JOIN x USING (seq, kind, item_rank)),
      parts AS (SELECT seq, {section('experience', 'Experience')} AS experience, {section('project', 'Projects')} AS project,
        list(name ORDER BY item_rank) FILTER (WHERE kind = 'project') AS projects, list(id ORDER BY item_rank) FILTER (WHERE kind = 'project') AS ids FROM texts GROUP BY seq),
      whole AS (SELECT g.*, parts.* EXCLUDE (seq), sentence, lower({squeeze('description')}) AS plain FROM g JOIN parts ON g.seq = parts.seq LEFT JOIN own ON g.seq = own.seq)
      SELECT seq, md5({resume}) AS resume, md5({letter}) AS letter, md5('out/coverletters/' || {_slug("company || '-' || position")} || '.pdf') AS pdf, array_to_string(projects, ',') AS projects FROM whole"""


def daily_run() -> str:
    j = lambda x: f"to_json({x})::varchar"
    path = f"'out/resumes/' || {_slug("company || '-' || position")} || '.tex'"
    return f"""WITH {_best(_MERGED, 'merged', 'first_file, first_seq')},
      placed AS (SELECT * EXCLUDE (first_file, first_seq), min([first_file, first_seq]) OVER (PARTITION BY k) AS first FROM ranked),
      chosen AS (SELECT *, {path} AS path FROM placed WHERE n1 = 1 AND matching_score >= 30 ORDER BY matching_score DESC, first LIMIT 10),
      remote AS (SELECT {clean('url')} AS url, arg_max('rec' || page_id, page_id) AS record_id FROM pages GROUP BY 1)
      SELECT first[1] AS first_file, first[2] AS first_seq, seq, c.url, matching_score, md5(path) AS resume_path, record_id,
        CASE WHEN record_id IS NULL THEN 'create' ELSE 'update' END AS action,
        md5('{{"Company":' || {j('company')} || CASE WHEN c.url <> '' THEN ',"Link":{{"text":' || {j('c.url')} || ',"link":' || {j('c.url')} || '}}' ELSE '' END || ',"Progress":"","Resume":'
          || {j('path')} || ',"Role":' || {j('position')} || ',"Score":' || matching_score || ',"State":"Need Review"}}') AS payload
      FROM chosen c LEFT JOIN remote r ON c.url = r.url"""


def private_data() -> str:
    patterns = {"email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "profile_url": r"https://www\.linkedin\.com/in/[A-Za-z0-9\-_%]+", "phone": r"\+\d[\d\s\-()]{7,}\d"}
    each = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest(regexp_extract_all(text, {_q(p)})) AS value FROM documents" for k, p in patterns.items())
    return f"SELECT doc_id, kind, value FROM ({each}) WHERE (kind, value) NOT IN (('email', 'you@example.com'), ('phone', '+44 0000 000000'))"


_UPSERT = """local AS (SELECT o_orderkey AS seq, 'http://c/' || o_custkey AS url FROM orders),
  remote AS (SELECT 'http://c/' || (c_custkey // 2) AS url, arg_max('rec' || c_custkey, c_custkey) AS record_id FROM customer GROUP BY 1),
  plan AS (SELECT seq, l.url, record_id, CASE WHEN record_id IS NOT NULL THEN 'update' ELSE 'create' END AS action FROM local l LEFT JOIN remote r ON l.url = r.url)"""


def upsert_plan() -> str:
    return f"WITH {_UPSERT} SELECT seq, url, record_id, action FROM plan"


def upsert_counts() -> str:
    return f"WITH {_UPSERT} SELECT action, count(*) AS n FROM plan GROUP BY action"


def manifest_join() -> str:
    return """SELECT s_suppkey AS seq_s, resume_path, 'create' AS action FROM supplier LEFT JOIN
      (SELECT c_nationkey, arg_max(c_name, c_custkey) AS resume_path FROM customer GROUP BY 1) ON s_nationkey = c_nationkey"""


def payload_fields() -> str:
    j = "to_json(n_name)::varchar"
    return f"""SELECT n_nationkey, 'link' AS field, '{{"text":' || {j} || ',"link":' || {j} || '}}' AS json FROM nation WHERE n_nationkey % 2 = 0
      UNION ALL SELECT n_nationkey, 'status', {j} FROM nation UNION ALL SELECT n_nationkey, 'tags', '[' || {j} || ']' FROM nation
      UNION ALL SELECT n_nationkey, 'note', '""' FROM nation"""


def region_titles() -> str:
    return "SELECT (r_regionkey * 1000 + n_nationkey)::bigint AS seq, r_name, n_name FROM region, nation"


def query_limits() -> str:
    return "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 3"


def hydrated() -> str:
    return """SELECT o_orderkey, coalesce(c_name, '') AS detail FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 24)
      LEFT JOIN customer ON c_custkey = o_custkey"""


def hydrated_postings() -> str:
    return """SELECT o_orderkey AS seq, o_custkey::varchar AS job_id, CASE WHEN row_number() OVER (ORDER BY o_orderkey) <= 24 AND c_custkey IS NOT NULL
      THEN c_name || ' <' || c_mktsegment ELSE '' END AS description FROM orders LEFT JOIN customer ON c_custkey = o_custkey"""


def json_handover() -> str:
    return f"WITH {PAGES} SELECT url, company, md5(position) AS position, md5(description) AS description, location, source, easy_apply FROM page_postings"


def line_handover() -> str:
    return f"SELECT source, job_id, '2024-01-01' AS date, line FROM ({manual_lines()})"


def fallback_rows() -> str:
    return "SELECT r_regionkey AS k, r_name AS name FROM region"


def live_rows() -> str:
    return "SELECT n_nationkey AS k, n_name AS name FROM nation"


def text_escapes() -> str:
    t = r"(p_brand || '_{&%$\' || p_type)"
    e = t
    for a, b in (("\\", r"\textbackslash{}"), ("&", r"\&"), ("%", r"\%"), ("$", r"\$"), ("#", r"\#"), ("_", r"\_"), ("{", r"\{"), ("}", r"\}")):
        e = f"replace({e}, '{a}', '{b}')"
    return f"SELECT p_partkey, {e} AS escaped, 'Hi ' || {t} || ', ' || {t} || ': x' AS filled FROM part"


def manual_lines() -> str:
    return f"""WITH l AS (SELECT page_id AS seq, {clean('url')} AS url FROM pages WHERE page_id % 7 <> 0 AND page_id % 5 <> 0),
      r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq) AS n FROM l)
      SELECT seq, 'manual' AS source, {posting_id('url')} AS job_id, url || ' | Acme Co | Dev |  | a b' AS line FROM r WHERE n = 1"""
