"""SQL for the operators that SQL can express on whole tables, written from their definitions.

Left out: the repeated substrings (a row per byte is too slow), sharding, tokens (of either encoder) and their
files, and the linked secrets; the tests hold those against brute force.
"""

from __future__ import annotations

import string

from . import quality

_LOWER = f"translate({{}}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_CLEAN = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def op2_decontaminate() -> str:
    words = _CLEAN.format(_LOWER.format("coalesce(text, '')"))
    return f"""WITH d AS (SELECT doc_id, {words} AS w FROM documents),
      i AS (SELECT item_id, {words} AS w FROM benchmark),
      win AS (SELECT DISTINCT item_id::varchar AS item, least(10, len(w)) AS n, array_to_string(w[k + 1 : k + 10], ' ') AS s
        FROM (SELECT *, unnest(range(greatest(1, len(w) - 9))) AS k FROM i WHERE len(w) > 0)),
      sizes AS (SELECT DISTINCT n FROM win),
      dw AS (SELECT doc_id, n, k, array_to_string(w[k + 1 : k + n], ' ') AS s FROM (SELECT *, unnest(range(len(w) - n + 1)) AS k FROM d, sizes WHERE len(w) >= n)),
      m AS (SELECT doc_id, k, dw.n, item FROM dw JOIN win ON dw.n = win.n AND dw.s = win.s),
      hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT doc_id, k, n FROM m)) GROUP BY doc_id),
      found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
      SELECT d.doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
        sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
      FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN found ON d.doc_id = found.doc_id"""


def op3_jaccard_join() -> str:
    words = _WORDS.format(_LOWER.format("coalesce(text, '')"))
    return f"""WITH RECURSIVE d AS (SELECT doc_id, {words} AS w FROM documents),
      s AS (SELECT DISTINCT doc_id, array_to_string(w[k + 1 : k + 5], ' ') AS g FROM (SELECT *, unnest(range(greatest(1, len(w) - 4))) AS k FROM d WHERE len(w) > 0)),
      n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
      c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
      l AS (SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * both_ >= 75 * (x.n + y.n - both_)),
      e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
      r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.c = e.a)
      SELECT d.doc_id, coalesce(n, 0)::bigint AS n_shingles, (SELECT min(c) FROM r WHERE r.doc_id = d.doc_id) AS component_id
      FROM d LEFT JOIN n ON d.doc_id = n.doc_id"""


def op8_chat_formatting() -> str:
    escaped = "(length(t) + length(t) - length(translate(t, '\\[<', '')))"
    role = "(length(r) + length(r) - length(translate(r, '\\[<' || chr(10), '')))"
    return f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
        UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
      SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) AS turns_sha256,
        sum(CASE WHEN r = 'assistant' THEN length(t) ELSE 0 END)::bigint AS loss_chars,
        sha256(coalesce(string_agg(t, '' ORDER BY turn, r, t) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
        sum(CASE WHEN r = 'assistant' THEN 9 + {escaped} ELSE 14 + {role} + {escaped} END)::bigint AS formatted_chars
      FROM c GROUP BY conv_id"""


def op10_quality_rules() -> str:
    words = _WORDS.format("t")
    over = ("100 * n_symbols > {} * n_words", "100 * n_dup_lines > {} * n_lines", "10 * word_chars > {} * n_words")
    fails = lambda cuts: "(" + " OR ".join(f"coalesce({o.format(c)}, false)" for o, c in zip(over, cuts)) + ")"
    counts = " UNION ALL ".join(
        f"SELECT stratum, {k} AS step, count(*) AS n, count_if({fails(step)}) AS k FROM good GROUP BY stratum" for k, step in enumerate(quality.LADDER)
    )
    steps = ", ".join(f"({k}, {', '.join(map(str, step))})" for k, step in enumerate(quality.LADDER))
    p, q = repr(quality.RISK), repr(1 - quality.RISK)
    tail = f"list_sum(list_transform(range(0, k::bigint + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}::double) + (n - i) * ln({q}::double))))"
    return rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS stratum FROM documents),
      w AS (SELECT *, {words} AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
      x AS (SELECT doc_id, array_to_string(w[k + 1 : k + 8], ' ') AS s, k FROM (SELECT doc_id, w, unnest(range(len(w) - 7)) AS k FROM w WHERE len(w) > 7)),
      y AS (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, s) AS times FROM x),
      z AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + 8)) AS p FROM y WHERE times > 1) GROUP BY doc_id),
      m AS (SELECT w.doc_id, stratum, len(w)::bigint AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint AS n_symbols, len(lines)::bigint AS n_lines, (len(lines) - len(list_distinct(lines)))::bigint AS n_dup_lines,
        coalesce(z.n, 0)::bigint AS n_repeat_words FROM w LEFT JOIN z ON w.doc_id = z.doc_id),
      v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
      good AS (SELECT v.* FROM v JOIN (SELECT doc_id FROM labels GROUP BY doc_id HAVING max(quality) > 0) l ON v.doc_id = l.doc_id WHERE NOT base_failed),
      tests AS ({counts}),
      sized AS (SELECT * FROM tests WHERE n >= ceil(ln({quality.DELTA} / (SELECT count(DISTINCT stratum) FROM good)) / ln({q}))),
      judged AS (SELECT *, k < {p} * n AND {tail} <= {quality.DELTA} / (SELECT count(*) FROM sized WHERE step = 0) AS ok FROM sized),
      last AS (SELECT stratum, coalesce(min(step) FILTER (WHERE NOT ok), {len(quality.LADDER)}) - 1 AS step FROM judged GROUP BY ALL),
      rules AS (SELECT stratum, s.* FROM last JOIN (VALUES {steps}) s(step, symbols, dup_lines, long_words) ON last.step = s.step)
      SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        NOT base_failed AND NOT {fails(('symbols', 'dup_lines', 'long_words'))} AS kept
      FROM v LEFT JOIN rules ON v.stratum = rules.stratum"""


def op11_fill_in_middle() -> str:
    draw = "('0x' || substr(h, {}, 8))::bigint".format
    joined = "array_to_string(u[{}:{}], '')".format
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::varchar, '')) AS h FROM documents),
      u AS (SELECT *, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') AS u FROM d),
      r AS (SELECT *, len(u) AS n, {draw(1)} % (len(u) + 1) AS x, {draw(9)} % (len(u) + 1) AS y,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {draw(17)} % 100 >= 100 THEN 'plain'
          WHEN {draw(25)} % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
      p AS (SELECT *, {joined(1, 'least(x, y)')} AS pre, {joined('least(x, y) + 1', 'greatest(x, y)')} AS mid, {joined('greatest(x, y) + 1', 'n')} AS suf FROM r)
      SELECT doc_id, n::bigint AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END::bigint AS prefix_chars,
        CASE WHEN form <> 'plain' THEN length(mid) END::bigint AS middle_chars,
        sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE t END) AS output_sha256,
        sha256(t) AS restored_sha256 FROM p"""


def op12_source_divergence() -> str:
    share = "1 + 1000000000::hugeint * ({} + 1) // ({} + v)".format
    f = "(({0} - {1}) * ({0} - {1}) // {1})".format
    terms = r"regexp_extract_all({}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')".format(_LOWER.format("coalesce(text, '')"))
    return f"""WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {terms} AS w FROM documents),
      t AS (SELECT id, lang, source, unnest(w) AS term FROM d),
      kept AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY ALL HAVING count(DISTINCT id) >= 3),
      c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
      g AS (SELECT lang, source, coalesce(any_value(x.total), 0) AS total FROM (SELECT DISTINCT lang, source FROM d)
        LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) x USING (lang, source) GROUP BY ALL),
      l AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
      s AS (SELECT lang, source, term, coalesce(n, 0) AS n, {share('coalesce(n, 0)', 'total')} AS p, {share('lang_n', 'lang_total')} AS q
        FROM g JOIN l USING (lang) JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
      x AS (SELECT a.lang, a.source, b.source AS item, sum({f('a.p', 'b.p')}) AS value
        FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
      r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
        UNION ALL SELECT lang, source, 'term', term, {f('p', 'q')} FROM s WHERE n > 0 AND p > q)
      SELECT lang, source, part, item, value::bigint AS value, rank::int AS rank FROM
        (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) WHERE part = 'pair' OR rank <= 200"""


def sql() -> dict[str, str]:
    return {f.__name__: f() for f in (op2_decontaminate, op3_jaccard_join, op8_chat_formatting, op10_quality_rules, op11_fill_in_middle, op12_source_divergence)}
