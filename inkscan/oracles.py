"""Oracle SQL for DuckDB, written from the operators' definitions and not from their Spark code.

The driver's texts have no blank lines, lists with pictographs or Cyrillic; the SQL covers what
they hold, unit tests the rest.  RE2 has no lookaround, so contexts are matched and put back.
"""

from __future__ import annotations

import re

from inkscan import rules
from inkscan.operators.base import SPECS
from inkscan.operators.lexical import STOP_WORDS
from inkscan.queries import ADDED

WORD = r"[\p{L}\p{N}]+(?:[''’-][\p{L}\p{N}]+)*"
ABBREVIATIONS = "стр|тыс|руб|млрд|млн|prof|mrs|etc|inc|ltd|fig|гг|др|пр|им|см|ул|mr|ms|dr|vs|eg|ie|st|no|т|е|г|д|с|п|e|i|g"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def docs(add: str = "") -> str:
    return f"docs AS (SELECT doc_id, coalesce(text, '') || {q(add)} AS text FROM documents)"


def context(add: str = "") -> str:
    """docs, words (w: list), paras (kind), sents (n, first) and prose."""
    token = f"(?i:{ABBREVIATIONS}|\\p{{L}})"
    return rf"""{docs(add)},
words AS (SELECT doc_id, text, list_transform(regexp_extract_all(text, '{WORD}'), lambda x: lower(x)) AS w FROM docs),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS pi FROM docs),
trimmed AS (SELECT doc_id, pi, regexp_replace(line, '^\s+|\s+$', '', 'g') AS p FROM lines),
paras AS (SELECT doc_id, pi, p, CASE WHEN regexp_matches(p, '^(?:[-*•–—]|\d+[.)])\s') THEN 'list'
    WHEN regexp_matches(p, '^(?:#{{1,6}}\s+.+|[^.!?…:;]{{2,80}})$') AND len(regexp_extract_all(p, '{WORD}')) <= 10 THEN 'heading' ELSE 'text' END AS kind FROM trimmed WHERE p <> ''),
marked AS (SELECT *, regexp_replace(p, '([.!?…]+["»”’)]*)(\s+|$)', '\1' || chr(1) || '\2', 'g') AS m FROM paras),
once AS (SELECT *, regexp_replace(regexp_replace(m, '((?:^|[^\p{{L}}]){token})\.' || chr(1) || '(\s+[\p{{Ll}}\d])', '\1.\2', 'g'), '(\d)\.' || chr(1) || '(\s+\d)', '\1.\2', 'g') AS m1 FROM marked),
twice AS (SELECT *, regexp_replace(regexp_replace(m1, '((?:^|[^\p{{L}}]){token})\.' || chr(1) || '(\s+[\p{{Ll}}\d])', '\1.\2', 'g'), '(\d)\.' || chr(1) || '(\s+\d)', '\1.\2', 'g') AS m2 FROM once),
cut AS (SELECT doc_id, pi, kind, unnest(string_split(m2, chr(1))) AS s, unnest(generate_series(1, len(string_split(m2, chr(1))))) AS si FROM twice),
sents AS (SELECT doc_id, pi, si, kind, regexp_replace(s, '^\s+|\s+$', '', 'g') AS s, len(regexp_extract_all(s, '{WORD}')) AS n, lower(regexp_extract(s, '{WORD}')) AS first FROM cut WHERE regexp_matches(s, '[\p{{L}}\p{{N}}]')),
prose AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pi, si) AS i FROM sents WHERE kind = 'text')"""


def scored(detector: str, ctes: str, source: str, value: str, ok: str) -> str:
    """value, applicable and score of a detector: ``source`` has doc_id and what ``value`` and ``ok`` name."""
    s = SPECS[detector]
    lo, hi = s.lo["en"], s.hi["en"]
    t = f"(v - {lo}) / ({hi} - {lo})::DOUBLE"
    t = f"1.0 - {t}" if s.direction == "down" else t
    return f"""WITH {ctes},
found AS (SELECT doc_id, ({ok}) AS ok, ({value})::DOUBLE AS v FROM {source})
SELECT doc_id, round(CASE WHEN ok THEN coalesce(v, 0.0) ELSE 0.0 END, 6)::DOUBLE AS value, coalesce(ok, false) AS applicable,
  round(CASE WHEN ok AND v IS NOT NULL THEN least(1.0, greatest(0.0, {t})) ELSE 0.0 END, 6)::DOUBLE AS score FROM found"""


def count(pattern: str, flags: str = "g", text: str = "text") -> str:
    inline = "(?i)" if "i" in flags else ""
    return f"len(regexp_extract_all({text}, {q(inline + pattern)}))"


def phrases(listed: list[str]) -> str:
    """Hits of phrases that no letter or digit precedes; the one before is matched too."""
    return count(rf"(?:^|[^\p{{L}}\p{{N}}])(?:{'|'.join(re.escape(p) for p in sorted(listed, key=lambda x: -len(x)))})", "gi")


def per_doc(column: str, source: str = "prose", more: str = "") -> str:
    return f"by_doc AS (SELECT d.doc_id, {column} FROM docs d LEFT JOIN {source} p ON p.doc_id = d.doc_id{more} GROUP BY d.doc_id)"


N = "len(w)"
EN = rules.LEXICON


def _markers(lang: str = "en") -> str:
    """Hits of each marker between characters that are no letters.  Two that share the one between them are one match of the first pattern, and one of the second."""
    edge = r"[^\p{L}]"
    parts = [f"{weight} * ({count(rf'(?:^|{edge})(?:{pattern})(?:$|{edge})', 'gi')} + {count(rf'(?:^|{edge})(?:{pattern}){edge}(?:{pattern})(?:$|{edge})', 'gi')})" for pattern, weight, _ in rules.MARKERS[lang]]
    return " + ".join(parts)


def _list(items: list[str]) -> str:
    return "[" + ", ".join(q(x) for x in items) + "]"


def build() -> dict[str, str]:
    out: dict[str, str] = {}
    out["detect_lang"] = rf"WITH {docs()}, n AS (SELECT doc_id, {count(r'\p{Cyrillic}')} AS c, {count(r'\p{Latin}')} AS l FROM docs) SELECT doc_id, CASE WHEN c + l > 0 AND c >= l THEN 'ru' ELSE 'en' END AS lang, round(CASE WHEN c + l > 0 THEN least(c, l)::DOUBLE / (c + l) ELSE 0.0 END, 6)::DOUBLE AS mixed_share FROM n"
    out["text_counts"] = f"""WITH {context()},
s AS (SELECT doc_id, count(*) AS n_sentences, sum(n) AS sentence_words FROM sents GROUP BY doc_id),
k AS (SELECT doc_id, count(*) FILTER (kind = 'text') AS n_text, count(*) FILTER (kind = 'heading') AS n_heading, count(*) FILTER (kind = 'list') AS n_list FROM paras GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, len(list_distinct(w))::BIGINT AS n_types, coalesce(n_sentences, 0)::BIGINT AS n_sentences, coalesce(sentence_words, 0)::BIGINT AS sentence_words,
  coalesce(n_text, 0)::BIGINT AS n_text, coalesce(n_heading, 0)::BIGINT AS n_heading, coalesce(n_list, 0)::BIGINT AS n_list FROM words LEFT JOIN s USING (doc_id) LEFT JOIN k USING (doc_id)"""
    out["rejected"] = "SELECT doc_id, CASE WHEN NOT regexp_matches(coalesce(text, ''), '\\S') THEN 'empty' ELSE 'too_long' END AS status FROM documents WHERE NOT regexp_matches(coalesce(text, ''), '\\S') OR length(text) > 100000"
    # typography
    mixed = "list_filter(regexp_extract_all(text, '\\p{L}+'), lambda x: (regexp_matches(x, '\\p{Cyrillic}')::INT + regexp_matches(x, '\\p{Latin}')::INT + regexp_matches(x, '\\p{Greek}')::INT) >= 2)"
    out["t01"] = scored("T-01", docs(" pаypаl sοund plain"), "docs", f"len({mixed})", "true")
    out["t02"] = scored("T-02", docs(" a​b c­d"), "docs", "length(text) - length(translate(text, chr(8203) || chr(173), ''))", "true")
    out["t04"] = scored("T-04", docs(ADDED), "docs", "(contains(text, '\"') AND regexp_matches(text, '[«»]'))::INT + (contains(text, '\"') AND regexp_matches(text, '[“”]'))::INT + (regexp_matches(text, '[«»]') AND regexp_matches(text, '[“”]'))::INT + (regexp_matches(text, '\\s-\\s') AND contains(text, '—'))::INT", "true")
    md = r"(?m)\*\*[^*\n]+\*\*|__[^_\n]+__|^#{1,6}\s|^\s*[-*]\s|^\s*\d+\.\s|`[^`\n]+`|^>\s|\[[^\]]+\]\([^)]+\)"
    out["t05"] = scored("T-05", docs(" **bold** and `code` and [a](b)"), "docs", count(md), "true")
    out["t06"] = scored("T-06", docs(), "docs", "0", "false")
    dashes = "(length(text) - length(replace(text, '—', '')))"
    out["t03"] = f"""WITH {context(ADDED)}, n AS (SELECT doc_id, len(w) AS n, {dashes} AS dashes, contains(text, '…') AND NOT contains(text, '...') AS dots, NOT regexp_matches(text, '\\s-\\s') AS clean FROM words),
b AS (SELECT *, n >= 30 AS ok, dashes * 1000.0::DOUBLE / n AS v FROM n), s AS (SELECT *, least(1.0, greatest(0.0, (v - 1.0) / 8.0)) AS base, CASE WHEN dots THEN 0.1 ELSE 0 END + CASE WHEN dashes >= 3 AND clean THEN 0.1 ELSE 0 END AS bonus FROM b)
SELECT doc_id, round(CASE WHEN ok THEN v ELSE 0.0 END, 6)::DOUBLE AS value, ok AS applicable, round(CASE WHEN NOT ok THEN 0.0 WHEN base > 0 THEN least(1.0, base + bonus) ELSE base END, 6)::DOUBLE AS score FROM s"""
    # rhythm
    out["r01"] = scored("R-01", context() + ", " + per_doc("count(p.n) AS k, CASE WHEN avg(p.n) > 0 THEN stddev_pop(p.n) / avg(p.n) ELSE 0 END AS cv"), "by_doc", "cv", "k >= 5")
    out["r02"] = scored("R-02", context() + ", " + per_doc("count(p.n) AS k, avg((p.n <= 5 OR p.n >= 35)::INT) AS far"), "by_doc", "far", "k >= 5")
    blocks = "blocks AS (SELECT doc_id, pi, count(*) AS ns, sum(n) AS nw FROM prose GROUP BY doc_id, pi)"
    out["r03"] = scored("R-03", f"{context()}, {blocks}, " + per_doc("count(p.nw) AS k, stddev_pop(p.nw) / avg(p.nw) AS cv, avg((p.ns BETWEEN 3 AND 4)::INT) AS share", "blocks"), "by_doc", "cv * (1 - 0.4 * greatest(0.0, share - 0.5))", "k >= 3")
    lags = ", ".join(f"sum((n - m) * (lead_{k} - m)) AS a{k}" for k in (2, 3, 4))
    leads = ", ".join(f"lead(n, {k}) OVER (PARTITION BY doc_id ORDER BY i) AS lead_{k}" for k in (2, 3, 4))
    best = ", ".join(f"CASE WHEN k > {lag + 2} AND spread > 0 THEN a{lag} / spread ELSE 0 END" for lag in (2, 3, 4))
    out["r04"] = scored("R-04", f"{context()}, x AS (SELECT doc_id, n, avg(n) OVER (PARTITION BY doc_id) AS m, {leads} FROM prose), y AS (SELECT doc_id, count(*) AS k, sum((n - m) * (n - m)) AS spread, {lags} FROM x GROUP BY doc_id), z AS (SELECT docs.doc_id, coalesce(k, 0) AS k, spread, a2, a3, a4 FROM docs LEFT JOIN y USING (doc_id))", "z", f"greatest(-1.0, {best})", "k >= 9")
    out["r05"] = scored("R-05", f"{context()}, c AS (SELECT doc_id, max(c) AS top FROM (SELECT doc_id, first, count(*) AS c FROM prose GROUP BY doc_id, first) GROUP BY doc_id), a AS (SELECT doc_id, count(*) AS k, sum((first = before)::INT) AS again FROM (SELECT doc_id, first, lag(first) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM prose) GROUP BY doc_id), z AS (SELECT docs.doc_id, coalesce(k, 0) AS k, top, coalesce(again, 0) AS again FROM docs LEFT JOIN a USING (doc_id) LEFT JOIN c USING (doc_id))", "z", "least(1.0, top::DOUBLE / k + 0.5 * again / k)", "k >= 6")
    # lexicon
    out["l01"] = scored("L-01", context(ADDED), "words", f"({_markers()}) * 1000.0 / len(w)", "len(w) >= 20")
    out["l02"] = scored("L-02", f"{context()}, shares AS (SELECT doc_id, len(w) AS n, list_transform(generate_series(1, len(w) - 49, 10), lambda i: len(list_distinct(w[i:i + 49])) / 50.0::DOUBLE) AS r FROM words)", "shares", "CASE WHEN list_avg(r) > 0 THEN coalesce(list_stddev_pop(r), 0) / list_avg(r) ELSE 0 END", "n >= 150")
    out["l03"] = scored("L-03", f"{context()}, plain AS (SELECT doc_id, list_filter(w, lambda x: NOT regexp_full_match(x, '\\d+')) AS w FROM words), k AS (SELECT doc_id, len(w) AS n, unnest(w[1:300]) AS x FROM plain), c AS (SELECT doc_id, x, count(*) AS c FROM k GROUP BY doc_id, x), h AS (SELECT doc_id, avg((c = 1)::INT) AS share FROM c GROUP BY doc_id), z AS (SELECT plain.doc_id, len(w) AS n, share FROM plain LEFT JOIN h USING (doc_id))", "z", "share", "n >= 100")
    passive = r"\b(?:is|are|was|were|be|been|being)\s+(?:\w+ly\s+)?\w+(?:ed|en)\b"
    nominal = "len(list_filter(w, lambda x: length(x) > 6 AND regexp_matches(x, '(tion|ment|ness|ity|ance|ence)$')))"
    out["l04"] = scored("L-04", context(ADDED), "words", f"({phrases(EN['hedges']['en'])} * 2 + greatest(0.0, {nominal} - len(w) * 0.04) + {count(passive, 'gi')} * 0.5) * 1000.0 / len(w)", "len(w) >= 40")
    noise = f"len(list_filter(w, lambda x: list_contains({_list(EN['noise']['en'])}, x)))"
    names = r"len(regexp_extract_all(substr(s, 2), '[\s,(«\"]\p{Lu}\p{Ll}{2,}'))"
    dates = count(r"\b(?:19|20)\d{2}\b|\b\d{1,2}[./]\d{1,2}(?:[./]\d{2,4})?\b")
    out["l05"] = scored("L-05", f"{context(ADDED)}, caps AS (SELECT doc_id, sum(least(3, {names})) AS caps FROM sents GROUP BY doc_id), z AS (SELECT words.*, coalesce(caps, 0) AS caps FROM words LEFT JOIN caps USING (doc_id))", "z", f"({noise} + {count('[!?]')} + {count(r'\([^)]{1,60}\)')} + {dates} + {count(r'\.\.\.|:\)|\)\)|;\)|:D')} + caps * 0.5) * 1000.0 / len(w)", "len(w) >= 40")
    own = f"list_transform(w, lambda x: NOT list_contains({_list(STOP_WORDS['en'])}, x))"
    out["l06"] = scored("L-06", f"{context()}, o AS (SELECT doc_id, w, {own} AS own FROM words), g AS (SELECT doc_id, w, list_transform(list_filter(generate_series(1, len(w) - 2), lambda i: own[i]::INT + own[i + 1]::INT + own[i + 2]::INT >= 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS g FROM o)", "g", "(len(g) - len(list_distinct(g))) * 1000.0 / len(w)", "len(w) >= 80")
    out["l07"] = scored("L-07", docs(ADDED), "docs", "0", "false")
    # structure
    out["s06"] = scored("S-06", context(ADDED), "words", f"{count(r'\b(?:(?:it' + chr(39) + r'?s|this is|that' + chr(39) + r'?s|is|are)\s+not\s+(?:just|only|merely|simply|about)\s[^.!?]{1,60}?[,;—–-]\s*(?:it' + chr(39) + r'?s|but|this is|they' + chr(39) + r'?re|it is)\s[\w-]+|not only\s[^.!?]{1,80}?\sbut also\s[\w-]+|isn' + chr(39) + r'?t (?:just|only)\s[^.!?]{1,60}?[—–-]\s*it' + chr(39) + r'?s\s[\w-]+)', 'gi')} * 1000.0 / len(w)", "len(w) >= 40")
    ends = rf"(?i)(?:^|[^\p{{L}}\p{{N}}])(?:{'|'.join(EN['conclusion']['en'])})"
    out["s01"] = scored("S-01", f"{context(ADDED)}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pi) AS a, row_number() OVER (PARTITION BY doc_id ORDER BY pi DESC) AS b FROM paras), ns AS (SELECT doc_id, pi, count(*) AS ns FROM sents GROUP BY doc_id, pi), t AS (SELECT doc_id, count(*) AS k, count(*) FILTER (kind = 'heading') AS h, count(*) FILTER (kind = 'list') AS l, bool_or(b <= 2 AND regexp_matches(p, {q(ends)})) AS e, bool_or(a = 1 AND kind = 'text' AND coalesce(ns, 0) <= 3) AS f FROM r LEFT JOIN ns USING (doc_id, pi) GROUP BY doc_id), z AS (SELECT words.doc_id, len(w) AS n, coalesce(k, 0) AS k, h, l, e, f FROM words LEFT JOIN t USING (doc_id))", "z", "least(1.0, CASE WHEN h >= 2 THEN 0.3 ELSE 0 END + CASE WHEN (CASE WHEN l > 0 THEN l ELSE greatest(0, h - 1) END) BETWEEN 3 AND 7 THEN 0.3 ELSE 0 END + CASE WHEN e THEN 0.4 ELSE 0 END + CASE WHEN f AND h + l > 0 THEN 0.1 ELSE 0 END)", "k >= 3 AND n >= 60")
    triad = r"\b[\w-]+(?:\s[\w-]+)?,\s[\w-]+(?:\s[\w-]+)?,?\s(?:and|or)\s[\w-]+(?:\s[\w-]+)?"
    out["s02"] = scored("S-02", f"{context()}, m AS (SELECT doc_id, w, regexp_replace(text, {q('(?i)' + triad)}, chr(1) || '\\0', 'g') AS m FROM words)", "m", "(len(regexp_extract_all(m, chr(1))) - len(regexp_extract_all(m, ',\\s{0,2}' || chr(1)))) * 1000.0 / len(w)", "len(w) >= 60")
    starts = "|".join(EN["template_headings"]["en"])
    out["s03"] = scored("S-03", f"{context()}, h AS (SELECT doc_id, trim(regexp_replace(p, '^#+\\s*|\\*\\*', '', 'g')) AS h FROM paras WHERE kind = 'heading' OR regexp_matches(p, '^#{{1,6}}\\s') OR regexp_matches(p, '^\\*\\*[^*]+\\*\\*$')), t AS (SELECT doc_id, regexp_matches(lower(h), '^(?:{starts})') OR (contains(h, ':') AND len(list_filter(regexp_split_to_array(h, '\\s+'), lambda x: regexp_matches(x, '^[A-Za-z]') AND length(x) > 3)) >= 2 AND len(list_filter(regexp_split_to_array(h, '\\s+'), lambda x: regexp_matches(x, '^[a-z]') AND length(x) > 3)) = 0) AS hit FROM h), " + per_doc("coalesce(sum(p.hit::INT), 0) AS k", "t"), "by_doc", "k", "true")
    said = lambda name, where: f"regexp_matches(lower({where}), {q('(?:^|[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}])(?:' + '|'.join(map(re.escape, EN[name]['en'])) + ')')})::INT"
    section = r"^\s*(?:\d+[.)]\s+)?[\p{Lu}][^.!?\n]{1,60}(?:[.:]\s*[^.!?\n]{0,40})?$"
    out["s07"] = scored("S-07", f"{context(ADDED)}, f AS (SELECT doc_id, pi, line, len(regexp_split_to_array(line, '\\s+')) AS n, lead(len(regexp_split_to_array(line, '\\s+'))) OVER (PARTITION BY doc_id ORDER BY pi) AS next FROM lines WHERE trim(line) <> ''), k AS (SELECT doc_id, count(*) FILTER (n <= 8 AND next > 8 AND regexp_matches(line, {q(section)})) AS labels, arg_max(line, pi) AS last FROM f GROUP BY doc_id), z AS (SELECT words.*, labels, last FROM words JOIN k USING (doc_id))", "z", f"{said('assistant_openers', 'substr(text, 1, 220)')} + {said('assistant_recaps', 'right(text, 900)')} + ({said('assistant_offers', 'last')} * regexp_matches(last, '[?.!]\\s*$')::INT) + CASE WHEN labels >= 2 THEN least(1.5, labels * 0.4) ELSE 0 END", "len(w) >= 60")
    out["normalise"] = "SELECT doc_id, md5(coalesce(text, '') || ' paypal code alpha') AS text_md5, 3::BIGINT AS replaced, 1::BIGINT AS removed FROM documents"
    out["labels_long"] = "SELECT doc_id, 'quality' AS label, quality AS value FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels"
    out["s04"] = scored("S-04", f"{context()}, " + per_doc("count(p.p) AS k", "paras", " AND p.kind = 'list'"), "by_doc", "0", "k >= 3")
    words_of = f"list_distinct(list_filter(list_transform(regexp_extract_all(x, '{WORD}'), lambda y: lower(y)), lambda y: length(y) > 3))"
    opener = rf"(?i)(?:^|[^\p{{L}}\p{{N}}])(?:{'|'.join(EN['summary_openers']['en'])})"
    out["s05"] = scored("S-05", f"{context()}, b AS (SELECT doc_id, pi, count(*) AS ns, arg_min(s, si) AS a, arg_max(s, si) AS z FROM prose GROUP BY doc_id, pi HAVING count(*) >= 3), c AS (SELECT *, {words_of.replace('(x,', '(a,')} AS wa, {words_of.replace('(x,', '(z,')} AS wz FROM b), d AS (SELECT doc_id, regexp_matches(substr(z, 1, 40), {q(opener)}) OR (len(wa) > 0 AND len(wz) > 0 AND len(list_intersect(wa, wz))::DOUBLE / len(list_distinct(list_concat(wa, wz))) >= 0.25) AS hit FROM c), " + per_doc("count(p.hit) AS k, avg(p.hit::INT) AS share", "d"), "by_doc", "share", "k >= 2")
    # score of the four detectors of the smallest path
    four = {"R-01": out["r01"], "R-02": out["r02"]}
    out["partial_score"] = f"""WITH a AS ({four['R-01']}), b AS ({four['R-02']}), c AS ({out['t03'].replace(q(ADDED), q(''))}), d AS ({out['l05'].replace(q(ADDED), q(''))}),
s AS (SELECT a.doc_id, floor(1 / (1 + exp(-({rules.TEXT_BIAS} + {rules.TEXT_WEIGHTS['R-01']} * a.score + {rules.TEXT_WEIGHTS['R-02']} * b.score + {rules.TEXT_WEIGHTS['T-03']} * c.score + {rules.TEXT_WEIGHTS['L-05']} * d.score)::DOUBLE)) * 1000 + 0.5) / 10 AS score FROM a JOIN b USING (doc_id) JOIN c USING (doc_id) JOIN d USING (doc_id))
SELECT doc_id, score::DOUBLE AS score, CASE WHEN score < 35 THEN 'human' WHEN score < 65 THEN 'mixed' ELSE 'ai' END AS verdict FROM s"""
    # models, data sets, sessions
    grams = r"""s AS (SELECT ' ' || regexp_replace(regexp_replace(regexp_replace(translate(lower(text), 'ё', 'е'), '[^\p{L}\p{N}\s.,!?-]', '', 'g'), '\d', '0', 'g'), '\s+', ' ', 'g') || ' ' AS s FROM docs),
g AS (SELECT unnest(list_transform(generate_series(1, length(s) - 2), lambda i: substr(s, i, 3))) AS gram FROM s), c AS (SELECT gram, count(*) AS n FROM g GROUP BY gram)"""
    out["ngram_train"] = f"WITH {docs()}, {grams}, k AS (SELECT * FROM c WHERE n >= 3), x AS (SELECT substr(gram, 1, 2) AS context, sum(n) AS context_n FROM k GROUP BY 1), a AS (SELECT count(DISTINCT ch) AS alphabet FROM (SELECT unnest(string_split(gram, '')) AS ch FROM c)) SELECT gram, n::BIGINT AS n, context_n::BIGINT AS context_n, alphabet::BIGINT AS alphabet FROM k JOIN x ON context = substr(gram, 1, 2) CROSS JOIN a"
    labelled = "l AS (SELECT lang, n_chars::DOUBLE AS score, quality = 1 AS label FROM documents JOIN labels USING (doc_id))"
    out["roc_auc"] = f"WITH {labelled} SELECT a.lang, round(coalesce((SELECT avg(CASE WHEN p.score > n.score THEN 1.0::DOUBLE WHEN p.score = n.score THEN 0.5 ELSE 0 END) FROM l p JOIN l n ON p.lang = n.lang AND p.label AND NOT n.label WHERE p.lang = a.lang), 0.5), 6)::DOUBLE AS auc FROM (SELECT DISTINCT lang FROM l) a"
    out["fpr_f1"] = f"WITH {labelled}, c AS (SELECT lang, count(*) FILTER (score >= 1000 AND label) AS tp, count(*) FILTER (score >= 1000 AND NOT label) AS fp, count(*) FILTER (score < 1000 AND label) AS fn, count(*) FILTER (NOT label) AS neg FROM l GROUP BY lang) SELECT lang, round(CASE WHEN neg > 0 THEN fp::DOUBLE / neg ELSE 0 END, 6)::DOUBLE AS fpr, round(CASE WHEN tp > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END, 6)::DOUBLE AS f1 FROM c"
    out["dedupe_prefix"] = "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY substr(text, 1, 200) ORDER BY doc_id) = 1"
    out["stratified_split"] = "SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) % 5 = 0 AS is_test FROM documents"
    out["capped_sample"] = "SELECT doc_id, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY md5(doc_id::VARCHAR), doc_id) <= 20"
    out["top_sources"] = "SELECT source, count(*)::BIGINT AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 30"
    out["session_history"] = "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3"
    return out


ORACLES = build()
