"""Oracle SQL of the queries of ``features``, written from the definitions, as in ``oracles``."""

from __future__ import annotations

from inkscan import rules
from inkscan.functions.regexlib import literal_heads
from inkscan.operators.base import SPECS
from inkscan.oracles import ORACLES, docs, q
from inkscan.queries import ADDED

#: Steps of plain descent, of rate 1, which the penalty makes converge.
STEPS = 1500


def _rows() -> str:
    share = lambda pattern: f"least(1.0::DOUBLE, len(regexp_extract_all(coalesce(text, ''), '{pattern}')) * 10.0::DOUBLE / greatest(length(coalesce(text, '')), 1))"
    return f"r AS (SELECT doc_id, {share('[#*$%&|<>]')} AS x1, {share('!')} AS x2, least(1.0::DOUBLE, length(coalesce(text, '')) / 5000.0::DOUBLE) AS x3, (1 - quality)::DOUBLE AS y FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL)"


def _descent(d: int, rows: str | None = None) -> str:
    """CTEs r (rows) and f (bias b and weights w1.. at the end of a bounded descent)."""
    ws = [f"w{i}" for i in range(1, d + 1)]
    z = " + ".join(["b", *(f"w{i} * x{i}" for i in range(1, d + 1))])
    p = f"1.0::DOUBLE / (1.0::DOUBLE + exp(-({z})))"
    moved = ", ".join(f"greatest(0.0::DOUBLE, w{i} - avg(({p} - y) * x{i}) - 0.1::DOUBLE * w{i})" for i in range(1, d + 1))
    return f"""{rows or _rows()},
s(step, b, {', '.join(ws)}) AS (
  SELECT 0, 0.0::DOUBLE, {', '.join('0.0::DOUBLE' for _ in ws)}
  UNION ALL
  SELECT step + 1, b - avg({p} - y), {moved} FROM s, r WHERE step < {STEPS} GROUP BY step, b, {', '.join(ws)}),
f AS (SELECT * FROM s WHERE step = {STEPS})"""


def _edited() -> str:
    """Stock phrases between characters that are no letters, in small letters and with a capital, replaced one marker after another."""
    text, hits = "text", []
    for pattern, _, options in rules.MARKERS["en"]:
        put = "" if options[0] == "remove" else options[0]
        if len(literal_heads(pattern)) > 1:
            variants = pattern.split("|")
        else:
            variants = [pattern]
        for v in variants:
            for first, now in ((v[0], put), (v[0].upper(), put[:1].upper() + put[1:])):
                own = rf"(^|[^\p{{L}}]){first}(?i:{v[1:]})($|[^\p{{L}}])"
                hits.append(f"len(regexp_extract_all(text, {q(own)}))")
                text = f"regexp_replace({text}, {q(own)}, {q(chr(92) + '1' + now + chr(92) + '2')}, 'g')"
    return f"WITH {docs(ADDED)} SELECT doc_id, md5({text}) AS text_md5, ({' + '.join(hits)})::BIGINT AS n_phrases, 0::BIGINT AS removed FROM docs"


def _worded() -> str:
    percent = lambda x: f"floor({x} * 100.0::DOUBLE + 0.5::DOUBLE)::BIGINT || '%'"
    two = "printf('%.2f', floor(value * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE)"
    lo, hi = (round(x * 100) for x in SPECS["R-01"].corridor["en"])
    metric = SPECS["L-06"].metric
    lows = {lang: tuple(int(x) for x in SPECS["L-06"].corridor[lang]) for lang in ("en", "ru")}
    told = {
        ("R-01", "en"): ("'Sentences of one length'", f"'Their lengths vary by ' || {percent('value')} || '; people''s by {lo}% to {hi}%.'"),
        ("R-01", "ru"): ("'Предложения одной длины'", f"'Длины колеблются на ' || {percent('value')} || '; у людей — на {lo}%–{hi}%.'"),
        ("L-06", "en"): (q(f"{metric} is out of the usual range"), f"'Measured ' || {two} || '; people''s texts lie between {lows['en'][0]} and {lows['en'][1]}.'"),
        ("L-06", "ru"): (q(f"Показатель {metric} вне обычных границ"), f"'Измерено ' || {two} || '; у людей — от {lows['ru'][0]} до {lows['ru'][1]}.'"),
    }
    rule = {"R-01": "R-01.low_burstiness", "L-06": "L-06.ngrams"}
    exact = {d: ORACLES[d.replace("-", "").lower()].replace(", 6)::DOUBLE", ", 15)::DOUBLE") for d in rule}
    rows = [f"SELECT doc_id, '{lang}' AS lang, '{rule[d]}' AS rule, {title} AS title, {explain} AS explain FROM ({exact[d]}) JOIN ok USING (doc_id) WHERE applicable AND score >= 0.35" for (d, lang), (title, explain) in told.items()]
    return r"WITH ok AS (SELECT doc_id FROM documents WHERE regexp_matches(coalesce(text, ''), '\S') AND length(text) <= 100000) " + " UNION ALL ".join(rows)


def _by(grouping: str, member: str) -> str:
    auc = "coalesce(avg(CASE WHEN p.score > n.score THEN 1.0::DOUBLE WHEN p.score = n.score THEN 0.5 ELSE 0 END), 0.5)"
    return f"""SELECT '{grouping}' AS grouping, c.m AS member, c.n::BIGINT AS n, round(coalesce(auc, 0.5), 6)::DOUBLE AS auc, round(CASE WHEN neg > 0 THEN fp::DOUBLE / neg ELSE 0 END, 6)::DOUBLE AS fpr, round(CASE WHEN pos > 0 THEN tp::DOUBLE / pos ELSE 0 END, 6)::DOUBLE AS tpr
FROM (SELECT {member} AS m, count(*) AS n, count(*) FILTER (score >= 1000 AND label) AS tp, count(*) FILTER (score >= 1000 AND NOT label) AS fp, count(*) FILTER (label) AS pos, count(*) FILTER (NOT label) AS neg FROM l GROUP BY 1) c
LEFT JOIN (SELECT p.m, {auc} AS auc FROM (SELECT *, {member} AS m FROM l WHERE label) p JOIN (SELECT *, {member} AS m FROM l WHERE NOT label) n ON p.m IS NOT DISTINCT FROM n.m GROUP BY p.m) a ON a.m IS NOT DISTINCT FROM c.m"""


def _calibrated() -> str:
    """Four detectors' scores as features; the bias falls until the negative at the 95th percentile is at 65."""
    ids = ["R-01", "R-02", "L-05", "L-06"]
    # the passage that some oracles add isn't there
    sqls = [ORACLES[d.replace("-", "").lower()].replace(f"|| {q(ADDED)} AS text", "|| '' AS text").replace(", 6)::DOUBLE", ", 15)::DOUBLE") for d in ids]
    parts = ", ".join(f"d{i} AS ({sql})" for i, sql in enumerate(sqls, 1))
    rows = f"{parts}, r AS (SELECT doc_id, {', '.join(f'd{i}.score AS x{i}' for i in range(1, 5))}, quality::DOUBLE AS y FROM labels {' '.join(f'JOIN d{i} USING (doc_id)' for i in range(1, 5))} WHERE quality IS NOT NULL)"
    z = " + ".join(f"round(w{i}, 4) * x{i}" for i in range(1, 5))
    names = " UNION ALL ".join(f"SELECT '{d}' AS name, round(w{i}, 4)::DOUBLE AS weight FROM f" for i, d in enumerate(ids, 1))
    return f"""WITH RECURSIVE {_descent(4, rows)}, n AS (SELECT {z} AS z FROM f, r WHERE y = 0),
p AS (SELECT z FROM (SELECT z, row_number() OVER (ORDER BY z) - 1 AS i, count(*) OVER () AS k FROM n) WHERE i = floor(0.95::DOUBLE * k))
SELECT 'bias' AS name, round(least(b, ln(65.0::DOUBLE / 35.0::DOUBLE) - z), 4)::DOUBLE AS weight FROM f, p UNION ALL {names}"""


_P = "1.0::DOUBLE / (1.0::DOUBLE + exp(-(b + w1 * x1 + w2 * x2 + w3 * x3)))"
_SLOPES = ", ".join([f"avg({_P} - y) AS g0", *(f"avg(({_P} - y) * x{i}) + 0.1::DOUBLE * any_value(w{i}) AS g{i}" for i in (1, 2, 3))])

FEATURES: dict[str, str] = {
    "logistic_fit": f"""WITH RECURSIVE {_descent(3)}, g AS (SELECT any_value(b) AS b, any_value(w1) AS w1, any_value(w2) AS w2, any_value(w3) AS w3, {_SLOPES} FROM f, r)
{' UNION ALL '.join(f"SELECT '{n}' AS name, round({w}, 5)::DOUBLE AS weight, round({s}, 5)::DOUBLE + 0.0 AS slope FROM g" for n, w, s in (('bias', 'b', 'g0'), ('symbols', 'w1', 'g1'), ('shouts', 'w2', 'g2'), ('length', 'w3', 'g3')))}""",
    "leave_one_out": f"""WITH RECURSIVE {_descent(1)}, z AS (SELECT doc_id, x1 AS x, y, b + w1 * x1 AS z, 1.0::DOUBLE / (1.0::DOUBLE + exp(-(b + w1 * x1))) AS p FROM f, r),
h AS (SELECT count(*) AS n, avg(p * (1 - p)) AS h0, avg(p * (1 - p) * x) AS h1, avg(p * (1 - p) * x * x) + 0.1::DOUBLE AS h2 FROM z),
a AS (SELECT z.*, (h2 - 2 * h1 * x + h0 * x * x) / (h0 * h2 - h1 * h1) / n AS a FROM z, h)
SELECT doc_id, round(100.0::DOUBLE * p, 3)::DOUBLE AS score, round(100.0::DOUBLE / (1.0::DOUBLE + exp(-(z + (p - y) * a / (1.0::DOUBLE - p * (1 - p) * a)))), 3)::DOUBLE AS score_without FROM a""",
    "calibration": _calibrated(),
    "edited_texts": _edited(),
    "advice_in_words": _worded(),
    "held_out_both": "WITH l AS (SELECT lang, source, n_chars::DOUBLE AS score, quality = 1 AS label FROM documents JOIN labels USING (doc_id)) "
    + " UNION ALL ".join((_by("lang", "lang"), _by("source", "source"), _by("lang/source", "coalesce(lang, '-') || '/' || coalesce(source, '-')"))),
    "json_arrays": "SELECT doc_id, md5(text) AS text_md5, lang, source, n_chars FROM documents",
    "grown_model": ORACLES["ngram_train"],
}
