"""Oracle SQL of the queries over built rows, and of whole reports; written from the definitions, as in ``oracles``."""

from __future__ import annotations

from inkscan import built, rules
from inkscan.operators.base import SPECS
from inkscan.operators.typography import YO_WORDS
from inkscan.oracles import EN, ORACLES, WORD, _list, _markers, context, count, docs, phrases, q, scored
from inkscan.oracles_features import FEATURES
from inkscan.queries import ADDED, CODE_ADDED

FIVE = {"R-01": "r01", "R-02": "r02", "R-03": "r03", "T-03": "t03", "L-05": "l05"}
USUAL = {a[1]: a for a in rules.ADVICE}


def _with(sql: str, add: str) -> str:
    """An oracle over texts with another passage after them, and without rounding."""
    sql = sql.replace(f"|| {q(ADDED)} AS text", "|| '' AS text").replace("|| '' AS text", f"|| {q(add)} AS text")
    return sql.replace(", 6)::DOUBLE", ", 15)::DOUBLE")


def _five(add: str, p: str, sqls: dict[str, str] | None = None) -> str:
    """CTEs {p}s: per document n, and v, k, s (value, applicable, score) of the detectors, z and score; {p}items: advice; all with prefix p.

    ``sqls`` are the detectors' oracles over the texts with ``add``, by default those of the five.
    """
    sqls = sqls or {d: _with(ORACLES[name], add) for d, name in FIVE.items()}
    ids, names = list(sqls), [d.replace("-", "").lower() for d in sqls]
    w = {d: rules.TEXT_WEIGHTS.get(d, SPECS[d].weight) for d in ids}
    parts = ", ".join(f"{p}{name} AS ({sql})" for name, sql in zip(names, sqls.values(), strict=True))
    columns = ", ".join(f"{p}{n}.value AS v{i}, {p}{n}.applicable AS k{i}, {p}{n}.score AS s{i}" for i, n in enumerate(names))
    joins = " ".join(f"JOIN {p}{n} USING (doc_id)" for n in names)
    z = f"({rules.TEXT_BIAS}::DOUBLE" + "".join(f" + s{i} * {w[d]}::DOUBLE" for i, d in enumerate(ids)) + ")"
    sc = lambda x: f"(floor(1.0::DOUBLE / (1.0::DOUBLE + exp(-({x}))) * 1000.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE)"
    gain = lambda less: f"greatest(0.0::DOUBLE, floor((score - {sc(f'z - ({less})')}) * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE)"
    fired = lambda i: f"(k{i} AND s{i} >= 0.35)"
    items, combined = [], {}
    for k, (rule, listed, least, effort) in enumerate(rules.COMBOS):
        members = [ids.index(d) for d in listed if d in ids]
        if not members:
            continue
        holds = f"({' + '.join(f'{fired(i)}::INT' for i in members)}) >= {least}"
        combined |= {i: holds for i in members}
        all_ = " + ".join(f"CASE WHEN {fired(i)} THEN s{i} * {w[ids[i]]}::DOUBLE ELSE 0.0::DOUBLE END" for i in members)
        who = "concat_ws('+', " + ", ".join(f"CASE WHEN {fired(i)} THEN '{ids[i]}' END" for i in sorted(members)) + ")"
        items.append(f"SELECT doc_id, '{rule}' AS rule, CASE WHEN {' OR '.join(f'({fired(i)} AND s{i} >= 0.75)' for i in members)} THEN 'high' ELSE 'medium' END AS sev, {effort} AS effort, {gain(all_)} AS gain, {1000 + k} AS place, {who} AS det, '{rule}' AS id FROM {p}s WHERE {holds}")
    for i, d in enumerate(ids):
        rule, _, effort, usual, _ = USUAL[d]
        held = f"{fired(i)}" + (f" AND NOT ({combined[i]})" if i in combined else "")
        g = gain(f"s{i} * {w[d]}::DOUBLE")
        items.append(f"SELECT doc_id, '{rule}' AS rule, CASE WHEN s{i} >= 0.75 THEN 'high' WHEN s{i} >= 0.5 THEN 'medium' ELSE 'low' END AS sev, {effort} AS effort, CASE WHEN {g} > 0 THEN {g} ELSE s{i} * {usual}::DOUBLE / 4 END AS gain, {i} AS place, '{d}' AS det, '{d}' AS id FROM {p}s WHERE {held}")
    return f"""{parts},
{p}t AS (SELECT doc_id, length(text) AS n, coalesce(text, '') AS text FROM ({docs_sql(add)})),
{p}x AS (SELECT doc_id, n, {columns} FROM {p}t {joins} WHERE regexp_matches(text, '\\S') AND n <= 100000),
{p}y AS (SELECT *, {z} AS z FROM {p}x),
{p}s AS (SELECT *, {sc('z')} AS score FROM {p}y),
{p}i AS ({' UNION ALL '.join(items)}),
{p}items AS (SELECT *, floor(gain / effort * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS priority FROM {p}i)"""


def docs_sql(add: str) -> str:
    return f"SELECT doc_id, coalesce(text, '') || {q(add)} AS text FROM documents"


def five_report(sqls: dict[str, str] | None = None, units: float = 1000.0, scores: bool = True) -> str:
    ids = list(sqls or FIVE)
    at = {d: i for i, d in enumerate(ids)}

    def category(name: str) -> str:
        own = [d for d in ids if SPECS[d].category == name]
        weight = " + ".join(f"CASE WHEN k{at[d]} THEN {SPECS[d].weight}::DOUBLE ELSE 0.0 END" for d in own)
        total = " + ".join(f"CASE WHEN k{at[d]} THEN s{at[d]} * {SPECS[d].weight}::DOUBLE ELSE 0.0 END" for d in own)
        names = "concat_ws('+', " + ", ".join(f"CASE WHEN k{at[d]} THEN '{d}' END" for d in own) + ")"
        shown = f"floor(({total}) / ({weight}) * 100.0::DOUBLE + 0.5::DOUBLE)::BIGINT || '/' || " if scores else ""
        return f"CASE WHEN {' OR '.join(f'k{at[d]}' for d in own)} THEN '{name}/' || {shown}{names} END"

    present = [c for c in rules.CATEGORIES if any(SPECS[d].category == c for d in ids)]
    active = " + ".join("(" + " OR ".join(f"(k{at[d]} AND s{at[d]} >= 0.5)" for d in ids if SPECS[d].category == c) + ")::INT" for c in present)
    metrics = ", ".join(f"CASE WHEN k{at[d]} THEN '{d}/' || (v{at[d]} >= {SPECS[d].corridor['en'][0]} AND v{at[d]} <= {SPECS[d].corridor['en'][1]})::VARCHAR END" for d in ids)
    milli = lambda x: f"floor({x} * {units}::DOUBLE + 0.5::DOUBLE)::BIGINT"
    line = f"rule || '/' || sev || '/' || effort || '/' || {milli('gain')} || '/' || {milli('priority')} || '/' || det"
    return f"""WITH {_five('', 'b_', sqls)},
a AS (SELECT doc_id, string_agg({line}, ',' ORDER BY priority DESC, gain DESC, place) AS advice, array_to_string(list(rule ORDER BY priority DESC, gain DESC, place)[1:2], ',') AS top FROM b_items GROUP BY doc_id),
c AS (SELECT *, {active} AS active, least(n / 2000.0::DOUBLE, CASE WHEN n < 300 THEN 0.2::DOUBLE ELSE 1.0::DOUBLE END) AS by_length FROM b_s),
d AS (SELECT *, by_length * 0.6::DOUBLE + least(1.0::DOUBLE, 0.4::DOUBLE + active * 0.15::DOUBLE) * 0.4::DOUBLE AS value FROM c)
SELECT doc_id, score, CASE WHEN score < 35 THEN 'human' WHEN score < 65 THEN 'mixed' ELSE 'ai' END AS verdict, floor(value * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS confidence,
  CASE WHEN value >= 0.75::DOUBLE THEN 'high' WHEN value >= 0.45::DOUBLE THEN 'medium' ELSE 'low' END AS level,
  concat_ws(',', CASE WHEN n < 300 THEN 'short_text' END, CASE WHEN active <= 1 THEN 'few_signals' END) AS reasons,
  concat_ws(',', {', '.join(map(category, present))}) AS categories, coalesce(advice, '') AS advice, coalesce(top, '') AS top_advice, concat_ws(',', {metrics}) AS metrics,
  CASE WHEN n < 300 THEN 'short_text' ELSE '' END AS warnings
FROM d LEFT JOIN a USING (doc_id)"""


def five_recheck(before: dict[str, str] | None = None, after: dict[str, str] | None = None) -> str:
    moved = " + ".join(f"(b.k{i} AND a.k{i} AND abs(a.v{i} - b.v{i}) > 1e-9)::INT" for i in range(len(before or FIVE)))
    ids = lambda p: f"{p}ids AS (SELECT doc_id, list(id) AS ids FROM {p}items GROUP BY doc_id)"
    joined = lambda keep: f"array_to_string(list_sort(list_filter({keep[0]}, lambda x: {keep[1]}list_contains({keep[2]}, x))), ',')"
    return f"""WITH {_five('', 'b_', before)}, {_five(ADDED, 'a_', after)}, {ids('b_')}, {ids('a_')},
p AS (SELECT b.doc_id, b.score AS score_before, a.score AS score_after, coalesce(x.ids, []) AS was, coalesce(y.ids, []) AS now, {moved} AS moved
  FROM b_s b JOIN a_s a USING (doc_id) LEFT JOIN b_ids x USING (doc_id) LEFT JOIN a_ids y USING (doc_id))
SELECT doc_id, score_before, score_after, {joined(('was', 'NOT ', 'now'))} AS closed, {joined(('now', 'NOT ', 'was'))} AS opened, {joined(('was', '', 'now'))} AS remaining, moved::BIGINT AS n_moved FROM p"""


def perplexity() -> str:
    norm = lambda c: rf"' ' || regexp_replace(regexp_replace(regexp_replace(translate(lower({c}), 'ё', 'е'), '[^\p{{L}}\p{{N}}\s.,!?-]', '', 'g'), '\d', '0', 'g'), '\s+', ' ', 'g') || ' '"
    cut_up = "unnest(list_transform(generate_series(1, length(t) - 2), lambda i: substr(t, i, 3))) AS gram"
    return scored("P-01", f"""{context()},
g AS (SELECT {cut_up} FROM (SELECT {norm('text')} AS t FROM docs)), c AS (SELECT gram, count(*) AS n FROM g GROUP BY gram), m AS (SELECT * FROM c WHERE n >= 3),
x AS (SELECT substr(gram, 1, 2) AS context, sum(n) AS context_n FROM m GROUP BY 1), a AS (SELECT count(DISTINCT ch) AS alphabet FROM (SELECT unnest(string_split(gram, '')) AS ch FROM c)),
pg AS (SELECT doc_id, i, {cut_up} FROM (SELECT doc_id, i, {norm('s')} AS t FROM prose WHERE n >= 4)),
b AS (SELECT doc_id, i, avg(-log2((coalesce(m.n, 0) + 0.1::DOUBLE) / (coalesce(context_n, 0) + 0.1::DOUBLE * alphabet))) AS bits FROM pg LEFT JOIN m USING (gram) LEFT JOIN x ON context = substr(pg.gram, 1, 2) CROSS JOIN a GROUP BY doc_id, i),
e AS (SELECT doc_id, count(*) AS k, stddev_pop(bits) / avg(bits) AS v0 FROM b GROUP BY doc_id), z AS (SELECT docs.doc_id, coalesce(k, 0) AS k, v0 FROM docs LEFT JOIN e USING (doc_id))""", "z", "v0", "k >= 6")


def _pairs(detectors: list[tuple[str, str, str]], source: str, ctes: str, keys: str) -> str:
    """value and score of several detectors: (id, value, condition) over ``source``."""
    columns = []
    for d, value, ok in detectors:
        s = SPECS[d]
        name = d[0].lower() + d[2:]
        v = f"CASE WHEN {ok} THEN coalesce(({value})::DOUBLE, 0.0) ELSE 0.0 END"
        columns.append(f"round({v}, 6)::DOUBLE AS {name}_value, round(CASE WHEN {ok} THEN least(1.0, greatest(0.0, ({v} - {s.lo['en']}) / ({s.hi['en']} - {s.lo['en']})::DOUBLE)) ELSE 0.0 END, 6)::DOUBLE AS {name}_score")
    return f"WITH {ctes} SELECT {keys}, {', '.join(columns)} FROM {source}"


def document_detectors() -> str:
    m = """m AS (SELECT doc_id, text, len(w) AS n, ['docx', 'odt', 'rtf', 'txt', 'md'][doc_id % 5 + 1] AS format, doc_id % 2 = 0 AS has_author, doc_id % 3 AS made, doc_id % 4 = 0 AS same,
  CASE WHEN doc_id % 11 = 0 THEN NULL ELSE (doc_id % 7)::DOUBLE END AS minutes, doc_id % 4 AS revisions, doc_id % 6 = 0 AS web, doc_id % 3 AS rsids, doc_id % 2 = 1 AS one_font, doc_id % 9 = 0 AS html FROM words)"""
    md = count(r"(?m)\*\*[^*\n]+\*\*|^#{1,6}\s")
    return _pairs([
        ("D-01", "CASE WHEN made = 0 THEN 1.5 ELSE 0 END + CASE WHEN made = 2 AND NOT has_author THEN 0.5 ELSE 0 END + CASE WHEN same THEN 0.5 ELSE 0 END", "format NOT IN ('txt', 'md')"),
        ("D-02", "n / greatest(1.0::DOUBLE, minutes) + CASE WHEN revisions <= 2 AND n / greatest(1.0::DOUBLE, minutes) > 40 THEN 50 ELSE 0 END", "(format IN ('docx', 'odt') AND minutes IS NOT NULL AND n >= 100)"),
        ("D-03", "CASE WHEN format = 'docx' AND rsids <= 1 THEN 1.5 ELSE 0 END + CASE WHEN web AND one_font THEN 0.7 ELSE 0 END", "(format IN ('docx', 'odt') AND n >= 150)"),
        ("D-04", f"least(1.5::DOUBLE, {md} * 0.3::DOUBLE) + web::INT + (NOT one_font)::INT + html::INT", "format NOT IN ('txt', 'md')"),
    ], "m", f"{context(' **bold**')}, {m}", "doc_id")


def image_detectors() -> str:
    sides = "(512, 576, 640, 704, 768, 832, 896, 960, 1024, 1152, 1216, 1280, 1344, 1536, 1792, 2048)"
    i = """i AS (SELECT doc_id, ['jpeg', 'png', 'webp'][doc_id % 3 + 1] AS format, [512, 1024, 640, 777][doc_id % 4 + 1] AS w, [512, 1792, 1000, 64, 0][doc_id % 5 + 1] AS h, doc_id % 2 = 0 AS camera,
  doc_id % 2 = 1 AND doc_id % 7 = 0 AS made, doc_id % 13 = 0 AS xmp, doc_id % 5 = 0 AS png, doc_id % 4 = 0 AS c2pa, doc_id % 8 = 0 OR doc_id % 12 = 0 AS signed, doc_id % 6 = 3 AS standard, doc_id % 100 + 1 AS quality FROM documents)"""
    return _pairs([
        ("I-01", "CASE WHEN NOT c2pa THEN 0 WHEN signed THEN 1 ELSE 0.3 END", "true"),
        ("I-02", "CASE WHEN png THEN 4 ELSE 0 END + CASE WHEN made THEN 2 ELSE 0 END + CASE WHEN xmp THEN 2 ELSE 0 END + CASE WHEN format = 'jpeg' AND NOT camera THEN 0.5 ELSE 0 END", "true"),
        ("I-03", f"CASE WHEN w IN {sides} AND h IN {sides} THEN 1 ELSE 0 END + CASE WHEN w % 64 = 0 AND h % 64 = 0 THEN 0.6 ELSE 0 END + CASE WHEN (w = 1024 AND h = 1792) OR (w = h AND w IN {sides}) THEN 0.4 ELSE 0 END", "(w > 0 AND h > 0)"),
        ("I-06", "CASE WHEN standard AND NOT camera THEN 1 ELSE 0 END + CASE WHEN standard AND quality >= 95 THEN 0.5 ELSE 0 END", "format = 'jpeg'"),
    ], "i", i, "doc_id")


def code_report(add: str) -> str:
    name = r"\b(?:def|function|func|let|const|var|class|async def)\s+([A-Za-z_]\w*)|\b([a-z_][A-Za-z0-9_]*)\s*=(?:[^=]|$)"
    short = "i j k n x y idx cfg ctx req res resp err tmp buf ptr num cnt len str obj arr val args kwargs db fn cb el ev e df ok id s v t m p q r w h conn msg src dst env opts params".split()
    guess = [("php", r"<\?php"), ("java", r"\bpublic (?:static )?class\b|System\.out\.println"), ("csharp", r"\busing System\b|Console\.WriteLine"), ("typescript", r":\s*(?:string|number|boolean)\b|\binterface \w+ \{|\btype \w+ ="), ("javascript", r"\b(?:const|let|function)\b|=>"), ("cpp", r"#include\s*<")]
    language = rf"CASE WHEN regexp_matches(code, '(?m)^\s*(def |import |from \S+ import |class \w+[:(])') AND NOT regexp_matches(code, '(?m)[;{{]\s*$') THEN 'python' WHEN regexp_matches(code, '(?m)^\s*package \w+\s*$') AND regexp_matches(code, '\bfunc\b') THEN 'go' " + " ".join(f"WHEN regexp_matches(code, {q(p)}) THEN '{n}'" for n, p in guess) + " ELSE 'unknown' END"
    hashed = "language IN ('python', 'ruby', 'shell')"
    trim = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
    quoted = "'[\"''`]'"
    comment = rf"""CASE WHEN {hashed} THEN CASE WHEN regexp_matches(x, '^\s*#') AND NOT regexp_matches(x, '^\s*#!') THEN {trim(r"regexp_extract(x, '^\s*#\s?(.*)$', 1)")}
    WHEN regexp_matches(x, '\s#\s.+$') AND NOT regexp_matches(regexp_extract(x, '\s#\s.+$'), {quoted}) THEN {trim(r"regexp_extract(x, '\s#\s(.+)$', 1)")} END
  ELSE CASE WHEN regexp_matches(x, '^\s*(?:\/\/|\/?\*+)') THEN {trim(r"regexp_extract(x, '^\s*(?:\/\/|\/?\*+)\s?(.*)$', 1)")}
    WHEN regexp_matches(x, '\s\/\/\s?.+$') AND NOT regexp_matches(regexp_extract(x, '\s\/\/\s?.+$'), {quoted}) THEN {trim(r"regexp_extract(x, '\s\/\/\s?(.+)$', 1)")} END END"""
    obvious = r"(?i)^(?:increment|decrement|initiali[sz]e|import|define|create|set|get|return|loop|iterate|check if|call|print|add|update|declare|instantiate|open|close|read|write|convert|calculate)\b.{0,40}$"
    functions, documented = (count(p, text="code") for p in (r"(?m)^\s*(?:def |async def |func |function |public |private |protected )", r"(?m)^\s*(?:def|class) [^\n]+:\n\s*(?:\"{3}|'{3})"))
    parts = "list_filter(regexp_split_to_array(lower(regexp_replace(x, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '_+'), lambda p: p <> '')"
    ctes = rf"""t AS (SELECT conv_id, turn, coalesce(text, '') || {q(add)} AS code FROM conversations), l AS (SELECT *, {language} AS language, string_split(code, chr(10)) AS lines FROM t),
c AS (SELECT *, list_filter(list_transform(lines, lambda x: {comment}), lambda x: x IS NOT NULL) AS comments, len(list_filter(lines, lambda x: regexp_matches(x, '\S'))) AS n_full,
  list_distinct(list_transform(generate_series(1, len(regexp_extract_all(code, {q(name)}))), lambda i: CASE WHEN regexp_extract_all(code, {q(name)}, 1)[i] <> '' THEN regexp_extract_all(code, {q(name)}, 1)[i] ELSE regexp_extract_all(code, {q(name)}, 2)[i] END)) AS names,
  list_filter(list_transform(lines, lambda x: regexp_extract(x, '^(\s+)\S', 1)), lambda x: x <> '') AS indents,
  list_filter(generate_series(1, len(lines)), lambda i: regexp_matches(lines[i], '^\s*(?:def |async def |func |function |public |private )')) AS placed FROM l),
k AS (SELECT *, len(comments)::DOUBLE / n_full AS density, len(list_filter(comments, lambda x: regexp_matches(x, '(?i)^step\s*\d+|^шаг\s*\d+|^\d+\.\s'))) AS steps, len(list_filter(comments, lambda x: regexp_matches(x, {q(obvious)}))) AS obvious,
  {functions} AS functions, {documented} AS documented, len(list_filter(indents, lambda x: contains(x, chr(9)))) AS tabs,
  len(list_filter(lines, lambda x: regexp_matches(x, '\S[ \t]+$') OR length(x) > 100)) > 0 AS loose,
  list_transform(generate_series(1, len(placed) - 1), lambda i: (placed[i + 1] - placed[i])::DOUBLE) AS gaps,
  len(list_filter(names, lambda x: len({parts}) >= 2 AND len(list_filter({parts}, lambda p: length(p) < 4 OR list_contains({_list(short)}, p))) = 0)) AS spoken FROM c)"""
    chat = count("|".join(rules.CHAT_MARKERS), "gi", "code")
    return _pairs([
        ("C-01", "CASE WHEN density > 0.25 THEN least(1.5::DOUBLE, (density - 0.25::DOUBLE) * 6) ELSE 0 END + CASE WHEN steps >= 2 THEN 1 ELSE 0 END + CASE WHEN obvious >= 2 THEN least(1.5::DOUBLE, obvious * 0.3::DOUBLE) ELSE 0 END + CASE WHEN functions >= 3 AND documented >= functions THEN 0.8 ELSE 0 END", "n_full >= 8"),
        ("C-02", "spoken::DOUBLE / len(names)", "len(names) >= 6"),
        ("C-03", f"CASE WHEN regexp_matches(code, {q(chr(105) + 'f __name__ == [' + chr(39) + chr(34) + ']__main__[' + chr(39) + chr(34) + ']:' + r'\s*' + chr(92) + 'n' + r'\s+main\(\)')}) THEN 0.8 ELSE 0 END + CASE WHEN {count(r'except\s+Exception(?:\s+as\s+\w+)?\s*:', text='code')} >= 2 THEN least(1.2::DOUBLE, {count(r'except\s+Exception(?:\s+as\s+\w+)?\s*:', text='code')} * 0.4::DOUBLE) ELSE 0 END + least(1.5::DOUBLE, {count('print' + chr(92) + '([^)' + chr(92) + 'n]*🚀[^)' + chr(92) + 'n]*' + chr(92) + ')', text='code')} * 0.5::DOUBLE)", "len(lines) >= 8"),
        ("C-04", "CASE WHEN NOT (tabs > 0 AND tabs < len(indents)) AND NOT loose THEN 0.8 ELSE 0 END + CASE WHEN len(placed) >= 4 AND coalesce(list_stddev_pop(gaps), 0) / list_avg(gaps) < 0.25 THEN 0.8 ELSE 0 END", "len(lines) >= 20"),
        ("C-05", chat, "true"),
    ], "k", ctes, "conv_id, turn, language")


def build() -> dict[str, str]:
    out = {"five_report": five_report(), "five_recheck": five_recheck(), "p01": perplexity(), "document_detectors": document_detectors(), "image_detectors": image_detectors(), "code_report": code_report(built.CODE), "code_detectors": code_report(CODE_ADDED)}
    t03 = _with(ORACLES["t03"], ADDED)
    out["dash_evidence"] = f"""WITH s AS ({t03}), p AS (SELECT doc_id, string_split(text, '—') AS p FROM ({docs_sql(ADDED)}) JOIN s USING (doc_id) WHERE applicable AND score >= 0.35),
u AS (SELECT doc_id, unnest(list_transform(generate_series(1, len(p) - 1), lambda k: list_sum(list_transform(p[1:k], lambda x: length(x))) + k - 1)) AS start FROM p) SELECT doc_id, start::BIGINT AS start, (start + 1)::BIGINT AS "end", '—' AS label FROM u"""
    russian = f"docs AS (SELECT doc_id, coalesce(text, '') || repeat({q(built.RU)}, (1 + length(coalesce(text, '')) // 150)::INT) AS text FROM documents)"
    yo = [w.replace("ё", "е") for w in YO_WORDS]
    hits = rf"list_filter(list_transform(regexp_extract_all(text, '\p{{L}}+'), lambda x: lower(x)), lambda x: list_contains({_list(yo)}, replace(x, 'ё', 'е')))"
    s = SPECS["T-06"]
    t06 = scored("T-06", f"{russian}, h AS (SELECT doc_id, {hits} AS h FROM docs)", "h", "len(list_filter(h, lambda x: contains(x, 'ё')))::DOUBLE / len(h)", "len(h) >= 4")
    out["t06_ru"] = t06.replace(f"(v - {s.lo['en']}) / ({s.hi['en']} - {s.lo['en']})", f"(v - {s.lo['ru']}) / ({s.hi['ru']} - {s.lo['ru']})")
    scripts = rf"len(regexp_extract_all(text, '\p{{Cyrillic}}')) AS cy, len(regexp_extract_all(text, '\p{{Latin}}')) AS la, len(regexp_extract_all(text, '{WORD}')) AS n"
    out["l01_ru"] = scored("L-01", f"{russian}, m AS (SELECT doc_id, text, {scripts} FROM docs)", "m", f"(({_markers('ru')}) + CASE WHEN least(cy, la)::DOUBLE / (cy + la) > 0.2 THEN {_markers()} ELSE 0 END) * 1000.0 / n", "n >= 20")
    term = r"^\s*(?:[-*•–]|\d+[.)])\s*(?:\*\*[^*]+:\*\*|\*\*[^*]+\*\*:|[\p{Lu}][\p{L}\s-]{1,40}:)\s+\S"
    out["s04_lists"] = scored("S-04", f"{context(built.LISTED)}, k AS (SELECT doc_id, count(*) AS k, count(*) FILTER (regexp_matches(p, {q(term)})) AS even FROM paras WHERE kind = 'list' GROUP BY doc_id)", "docs LEFT JOIN k USING (doc_id)", "even::DOUBLE / k", "k >= 3")
    said = count(r"\b[A-Z][a-z]+(?:\s[A-Z][a-z]+)?(?:\s\(\d{4}\))?,?\s(?:showed|demonstrated|argued|argues|described|noted|notes|observed|proved|introduced|formulated|emphasized|emphasizes|highlighted|warned|contended)\b")
    out["l07_said"] = scored("L-07", f"{context(built.SAID)}, m AS (SELECT doc_id, len(w) AS n, {said} AS said, {phrases(EN['academic_markers']['en'])} AS cliches FROM words)", "m", "(said * 1.5 + cliches) * 1000.0 / n", "n >= 300 AND said >= 4")
    # of the four passages: a missing source and a page beyond its source's, two pages beyond, too few references, mostly ranges
    out["b01_cited"] = scored("B-01", docs(), "docs", "[2.5, 2.0, 0.0, 0.5][doc_id % 4 + 1]", "doc_id % 4 <> 2")
    formula = r"\$\$[^$]+\$\$|\\(?:text|rightarrow|frac|cdot)\{?"
    out["s08_sections"] = scored("S-08", f"{context(built.SECTIONS)}, m AS (SELECT doc_id, text, len(w) AS n FROM words)", "m", f"1.7 + CASE WHEN 6 * 1000.0 / n > 12 THEN 0.5 ELSE 0 END + CASE WHEN n > 300 AND regexp_matches(text, {q(formula)}) THEN 0.7 ELSE 0 END", "true")
    out["b01"] = scored("B-01", docs(), "docs", "0", "true")  # five references without a bibliography, in one block of many
    out["s08"] = scored("S-08", f"{context()}, m AS (SELECT doc_id, text, len(w) AS n FROM words)", "m", "0.7", f"n > 300 AND regexp_matches(text, {q(formula)})")
    out["rejected_built"] = "SELECT doc_id, CASE WHEN doc_id % 10 = 0 OR (doc_id % 100 <> 1 AND NOT regexp_matches(coalesce(text, ''), '\\S')) THEN 'empty' ELSE 'too_long' END AS status FROM documents WHERE doc_id % 10 = 0 OR doc_id % 100 = 1 OR NOT regexp_matches(coalesce(text, ''), '\\S') OR length(text) > 100000"
    out["file_kinds"] = "SELECT page_id, ['docx', 'odt', 'rtf', 'txt', 'md', 'jpeg', 'webp', 'py', 'rs', 'exe'][page_id % 10 + 1] AS ext, CASE WHEN page_id % 10 < 5 THEN 'document' WHEN page_id % 10 < 7 THEN 'image' WHEN page_id % 10 < 9 THEN 'code' END AS kind FROM pages"
    out["parsed_documents"] = r"""WITH l AS (SELECT doc_id, list_filter(string_split(regexp_replace(coalesce(text, '') || chr(10) || 'last line', '[\x00-\x08\x0B-\x1F]', ' ', 'g'), chr(10)), lambda x: regexp_matches(x, '\S')) AS l FROM documents),
t AS (SELECT doc_id, CASE WHEN doc_id % 4 = 2 THEN list_transform(l, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) ELSE l END AS l FROM l)
SELECT doc_id, ['docx', 'odt', 'rtf', 'txt'][doc_id % 4 + 1] AS format, 'ok' AS status, md5(array_to_string(l, chr(10) || chr(10))) AS text_md5, len(l)::BIGINT AS n_places, true AS ends_with_text, CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 1 END::BIGINT AS page FROM t"""
    out["parsed_images"] = """SELECT doc_id, 'ok' AS status, ['png', 'jpeg', 'webp'][doc_id % 3 + 1] AS format, (16 + doc_id % 1000)::BIGINT AS width, (8 + doc_id % 700)::BIGINT AS height, 'Maker ' || doc_id AS software,
CASE WHEN doc_id % 3 = 0 THEN 'seed ' || doc_id END AS prompt, doc_id % 6 = 3 AS c2pa, doc_id % 6 = 3 AS ai_claim, CASE WHEN doc_id % 6 = 3 THEN 'OpenAI' ELSE '' END AS issuers, CASE WHEN doc_id % 3 = 1 THEN 1 + doc_id % 200 END::BIGINT AS first_quant FROM documents"""
    code_line = r"[{};]\s*$|^\s*(?:def|class|import|from|return|if|for|while|const|let|var|function|public|private|func|package|#include)\b|^\s{2,}\S|=>|==|\(\)\s*[:{]"
    out["pasted_kinds"] = rf"""WITH l AS (SELECT conv_id, turn, list_filter(string_split(coalesce(text, '') || CASE WHEN turn % 3 = 0 THEN {q(chr(10) + 'import os' + chr(10) + 'x = f(1)' + chr(10) + 'return x;' + chr(10))} ELSE {q(chr(10) + 'plain words' + chr(10))} END, chr(10)), lambda x: regexp_matches(x, '\S')) AS l FROM conversations)
SELECT conv_id, turn, len(l) >= 3 AND len(list_filter(l, lambda x: regexp_matches(x, {q(code_line)})))::DOUBLE / len(l) > 0.5 AS is_code FROM l"""
    labelled = "l AS (SELECT lang, source, n_chars::DOUBLE AS score, quality = 1 AS label FROM documents JOIN labels USING (doc_id))"
    auc = "coalesce(avg(CASE WHEN p.score > n.score THEN 1.0::DOUBLE WHEN p.score = n.score THEN 0.5 ELSE 0 END), 0.5)"
    group = lambda g: f"""SELECT '{g}' AS grouping, c.m AS member, c.n::BIGINT AS n, round(coalesce(auc, 0.5), 6)::DOUBLE AS auc, round(CASE WHEN neg > 0 THEN fp::DOUBLE / neg ELSE 0 END, 6)::DOUBLE AS fpr, round(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END, 6)::DOUBLE AS tpr
FROM (SELECT {g} AS m, count(*) AS n, count(*) FILTER (score >= 1000 AND label) AS tp, count(*) FILTER (score >= 1000 AND NOT label) AS fp, count(*) FILTER (score < 1000 AND label) AS fn, count(*) FILTER (NOT label) AS neg FROM l GROUP BY {g}) c
LEFT JOIN (SELECT p.{g} AS m, {auc} AS auc FROM l p JOIN l n ON p.{g} IS NOT DISTINCT FROM n.{g} AND p.label AND NOT n.label GROUP BY p.{g}) a ON a.m IS NOT DISTINCT FROM c.m"""  # noqa: E731
    out["held_out"] = f"WITH {labelled} {group('lang')} UNION ALL {group('source')}"
    out["whole_auc"] = f"WITH {labelled} SELECT round({auc}, 6)::DOUBLE AS auc FROM l p JOIN l n ON p.label AND NOT n.label"
    out["dataset_split"] = "WITH k AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY substr(text, 1, 200) ORDER BY doc_id) AS r FROM documents WHERE length(text) BETWEEN 400 AND 4000) SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) % 5 = 0 AS is_test FROM k WHERE r = 1"
    wide = lambda name, text: rf"SELECT doc_id::VARCHAR AS source, 'en' AS lang, {str(name != 'human').lower()} AS ai, '{name}' AS model, md5(regexp_replace({text}, '^\s+|\s+$', '', 'g')) AS text_md5 FROM documents"
    out["wide_corpus"] = " UNION ALL ".join([wide("human", "text"), wide("m1", "'m1 ' || text"), wide("m2", "text || ' m2'")])
    out["bias_rule"] = "WITH z AS (SELECT lang, ln(n_chars + 1.0::DOUBLE) AS z FROM documents JOIN labels USING (doc_id) WHERE quality = 1), r AS (SELECT lang, z, row_number() OVER (PARTITION BY lang ORDER BY z) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM z) SELECT lang, round(least(1.0::DOUBLE, ln(65.0::DOUBLE / 35.0::DOUBLE) - z), 6)::DOUBLE AS bias FROM r WHERE i = floor(n * 0.95::DOUBLE)"
    advised = lambda d: ",".join(a[0] for a in rules.ADVICE if a[1] == d)
    rows = ", ".join(f"({q(d[0])}, {q(d[1])}, {q(d[2])}, {float(d[3])}::DOUBLE, {q(d[4])}, {q(d[5])}, {q(advised(d[0]))})" for d in rules.DETECTORS)
    out["rules_catalog"] = f"SELECT * FROM (VALUES {rows}) t(id, category, kind, weight, metric, direction, rules)"
    out["paragraph_places"] = f"WITH {context()}, l AS (SELECT doc_id, count(*) AS n, arg_max(s, pi * 1000000 + si) AS s FROM sents GROUP BY doc_id) SELECT docs.doc_id, coalesce(n, 0)::BIGINT AS n, (length(text) - strpos(reverse(text), reverse(s)) + 1)::BIGINT AS last_end FROM docs LEFT JOIN l USING (doc_id)"
    lines = "l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)"
    out["sentence_heat"] = rf"WITH {lines}, p AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM l) SELECT doc_id, (after - 1 - length(line))::BIGINT AS start, (after - 1)::BIGINT AS {chr(34)}end{chr(34)}, floor(least(1.0::DOUBLE, 0.075::DOUBLE + len(regexp_extract_all(line, '[-!?]')) * 0.3::DOUBLE * 0.12::DOUBLE * 0.6::DOUBLE) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS heat FROM p WHERE line <> ''"
    # every detector on the texts as they are
    plain = {d: ORACLES.get(d.replace("-", "").lower()) for d in SPECS if SPECS[d].kind == "text" and d != "P-02"}
    plain |= {"P-01": out["p01"], "S-08": out["s08"], "S-04": out["s04_lists"].replace(q(built.LISTED), "''"), "L-07": out["l07_said"].replace(q(built.SAID), "''"), "B-01": scored("B-01", docs(), "docs", "0", "false")}
    added = [q(x) for x in (ADDED, " pаypаl sοund plain", " a​b c­d", " **bold** and `code` and [a](b)")]
    for d in plain:
        for x in added:
            plain[d] = plain[d].replace(f"|| {x} AS text", "|| '' AS text")
    rows = [f"SELECT doc_id, '{d}' AS id, '{SPECS[d].category}' AS category, value, applicable, score FROM ({sql})" for d, sql in plain.items()]
    out["native_rows"] = " UNION ALL ".join(rows)
    exact = {d: sql.replace(", 6)::DOUBLE", ", 15)::DOUBLE") for d, sql in plain.items()}
    out["native_reports"] = five_report(exact, 1e6, scores=False)
    native = {d: sql for d, sql in exact.items() if d[0] != "P"}
    out["native_recheck"] = five_recheck(native, {d: sql.replace("|| '' AS text", f"|| {q(ADDED)} AS text") for d, sql in native.items()})
    turns = "documents AS (SELECT row_number() OVER (ORDER BY conv_id, turn) AS doc_id, conv_id, turn, coalesce(text, '') || ' Plain words follow.' AS text FROM conversations)"
    out["session_stream"] = f"""WITH {turns}, {_five('', 'b_')}, ids AS (SELECT doc_id, list(id) AS ids FROM b_items GROUP BY doc_id),
v AS (SELECT doc_id, conv_id, turn, score, coalesce(ids, []) AS now, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS version FROM b_s JOIN documents USING (doc_id) LEFT JOIN ids USING (doc_id)),
p AS (SELECT *, lag(score) OVER w AS score_before, lag(now) OVER w AS was FROM v WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id::VARCHAR AS session_id, version, score, CASE WHEN turn <> 0 THEN score_before END AS score_before,
  CASE WHEN turn = 0 OR was IS NULL THEN '' ELSE array_to_string(list_sort(list_filter(was, lambda x: NOT list_contains(now, x))), ',') END AS closed,
  CASE WHEN turn = 0 OR was IS NULL THEN '' ELSE array_to_string(list_sort(list_filter(now, lambda x: NOT list_contains(was, x))), ',') END AS opened FROM p"""
    return out


ALL = {**ORACLES, **build(), **FEATURES}
