"""Advice in words, and the edits it names carried out: templates as column expressions, phrases replaced on the row."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkscan import rules
from inkscan.functions.regexlib import WS, cutter, let, running
from inkscan.operators.base import SPECS, advice_rules
from inkscan.operators.findings import NO_SPANS, with_markers_of
from inkscan.operators.normalize import normalize_text

#: A name, with the digits and the kind (f or %) that a number is shown with.
PLACE = re.compile(r"\{(\w+)(?::\.(\d)(f|%))?\}")

#: Our own wording: rule -> language -> (title, what was seen, what to do).  Others get the general one.
GENERAL = {
    "en": ("{metric} is out of the usual range", "Measured {value:.2f}; people's texts lie between {lo} and {hi}.", ("Bring it nearer to that range.",)),
    "ru": ("Показатель {metric} вне обычных границ", "Измерено {value:.2f}; у людей — от {lo} до {hi}.", ("Приблизьте его к этим границам.",)),
}
TEXTS: dict[str, dict[str, tuple[str, str, tuple[str, ...]]]] = {
    "T-01.homoglyphs": {
        "en": ("Letters of two alphabets in one word", "Words affected: {value:.0f}.", ("Type the words anew, or let the edit do it.",)),
        "ru": ("Буквы двух алфавитов в одном слове", "Таких слов: {value:.0f}.", ("Наберите слова заново или примените правку.",)),
    },
    "T-02.invisible": {
        "en": ("Invisible characters", "Found: {value:.0f}.", ("Remove them; the edit does.",)),
        "ru": ("Невидимые символы", "Найдено: {value:.0f}.", ("Удалите их; правка это сделает.",)),
    },
    "R-01.low_burstiness": {
        "en": ("Sentences of one length", "Their lengths vary by {value:.0%}; people's by {lo:.0%} to {hi:.0%}.", ("Set a short sentence beside a long one.",)),
        "ru": ("Предложения одной длины", "Длины колеблются на {value:.0%}; у людей — на {lo:.0%}–{hi:.0%}.", ("Поставьте короткое предложение рядом с длинным.",)),
    },
    "L-01.markers": {
        "en": ("Stock phrases", "{value:.1f} per thousand words; up to {hi:.0f} is usual.", ("Say it plainly, or leave it out.",)),
        "ru": ("Штампы", "{value:.1f} на тысячу слов; обычно до {hi:.0f}.", ("Скажите проще или уберите.",)),
    },
    "T-03.perfect_typography": {
        "en": ("Dashes", "{value:.1f} per thousand words; up to {hi:.0f} is usual.", ("Use a comma, or two sentences.",)),
        "ru": ("Тире", "{value:.1f} на тысячу слов; обычно до {hi:.0f}.", ("Поставьте запятую или разбейте фразу.",)),
    },
}


def fixed(value: Column, digits: int) -> Column:
    """A number with so many digits, halves rounded up."""
    scale = 10.0**digits
    return F.format_string(f"%.{digits}f", F.floor(value * scale + 0.5) / scale)


def fill(template: str, numbers: dict[str, Column], words: dict[str, Column] | None = None) -> Column:
    """A template as a column: the template is parsed once, when the plan is built.

    ``{x}`` shows a whole number as it is and any other with two digits, ``{x:.1f}`` so many digits, ``{x:.0%}`` a
    percentage; words stand as they are.  Names that are unknown, null or empty leave nothing; what they leave
    behind (double spaces, empty quotes) is tidied up.
    """
    words, parts, at = words or {}, [], 0
    for m in PLACE.finditer(template):
        parts.append(F.lit(template[at : m.start()]))
        name, digits, kind = m.groups()
        if name in numbers:
            x = numbers[name].cast("double")
            if digits is None:
                shown = F.when(x == F.floor(x), F.format_string("%d", F.floor(x).cast("long"))).otherwise(fixed(x, 2))
            else:
                shown = F.concat(fixed(x * 100, int(digits)), F.lit("%")) if kind == "%" else fixed(x, int(digits))
            parts.append(F.when(x.isNotNull(), shown).otherwise(""))
        elif name in words:
            parts.append(F.coalesce(words[name].cast("string"), F.lit("")))
        at = m.end()
    whole = F.concat(*parts, F.lit(template[at:])) if parts else F.lit(template[at:])
    tidy = F.regexp_replace(F.regexp_replace(whole, f"[{WS}]{{2,}}", " "), "«»|“”", "…")
    return F.btrim(tidy)


def in_words(reports: DataFrame, lang: str = "en", texts: dict[str, dict[str, tuple[str, str, tuple[str, ...]]]] | None = None) -> DataFrame:
    """``reports`` whose advice also has title, explain and actions in the language.

    ``texts`` adds to, or takes the place of, the templates here: a table of a user's own.  The number is that of the
    first detector of an item; its usual range is the detector's corridor.
    """
    known = {**TEXTS, **(texts or {})}

    def worded(item: Column) -> Column:
        out = None
        for rule, members in [*((a[0], [a[1]]) for a in advice_rules()), *((c[0], list(c[1])) for c in rules.COMBOS)]:
            title, explain, actions = known.get(rule, {}).get(lang) or GENERAL[lang]
            s = SPECS[members[0]]
            value = F.get(F.filter("metrics", lambda m: m["detector"] == item["detectors"][0]), F.lit(0))["value"]  # noqa: B023
            numbers = {"value": value, "lo": F.lit(float(s.corridor[lang][0])), "hi": F.lit(float(s.corridor[lang][1])), "gain": item["gain"]}
            words = {"metric": F.lit(s.metric), "severity": item["severity"]}
            said = F.struct(fill(title, numbers, words).alias("title"), fill(explain, numbers, words).alias("explain"), F.array(*(fill(a, numbers, words) for a in actions)).alias("actions"))
            out = F.when(item["rule"] == rule, said) if out is None else out.when(item["rule"] == rule, said)
        return let(out, lambda w: item.withField("title", w["title"]).withField("explain", w["explain"]).withField("actions", w["actions"]))

    return reports.withColumn("advice", F.transform("advice", worded))


#: First choices that mean: leave it out.
OUT = ("remove", "удалить")


def phrase_edits(lang: str) -> Column:
    """(start, end, label) of marker hits in ``text``, the label being what takes their place; markers whose first choice isn't a text have none."""

    def edits(marker: Column, spans: Column) -> Column:
        first = F.element_at(marker["options"], 1)
        put = F.when(first.isin(*OUT), "").otherwise(first)
        return F.when(~first.contains("…"), F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), put.alias("label")))).otherwise(F.expr(NO_SPANS))

    return F.array_sort(with_markers_of(lang, edits))


def applied(text: Column, edits: Column) -> Column:
    """(text, n): the sorted edits (start, end, label) carried out, but for those that begin within an earlier one; a capital stays one."""

    def done(edits: Column) -> Column:
        reach = running(F.transform(edits, lambda e: e["end"]), lambda a, b: F.greatest(a, b), F.lit(0))
        before = F.slice(F.concat(F.array(F.lit(0)), reach), F.lit(1), F.size(edits))
        free = F.filter(F.zip_with(before, edits, lambda at, e: F.struct(at.alias("at"), e.alias("e"))), lambda x: x["e"]["start"] >= x["at"])
        return let(F.transform(free, lambda x: x["e"]), carried_out)

    def carried_out(edits: Column) -> Column:
        after = F.slice(F.concat(F.array(F.lit(0)), F.transform(edits, lambda e: e["end"])), F.lit(1), F.size(edits))

        def pieces(piece: Callable[[Column, Column], Column]) -> Column:
            def put(at: Column, e: Column) -> Column:
                first = F.substring(piece(e["start"], e["end"]), 1, 1)
                now = F.when(first != F.lower(first), F.concat(F.upper(F.substring(e["label"], 1, 1)), F.substring(e["label"], 2, 1000))).otherwise(e["label"])
                return F.concat(piece(at, e["start"]), now)

            rest = piece(F.element_at(edits, -1)["end"], F.length(text))
            return F.struct(F.concat(F.array_join(F.zip_with(after, edits, put), ""), rest).alias("text"), F.size(edits).alias("n"))

        return cutter(text, pieces)

    none = F.struct(text.alias("text"), F.lit(0).alias("n"))
    return let(edits, lambda e: F.when(F.size(e) > 0, done(e)).otherwise(none))


def with_fixes(df: DataFrame, lang: str = "en") -> DataFrame:
    """``df`` with ``fixed`` (text, n_phrases, replaced, removed): marker phrases replaced, look-alike letters and invisible characters cleaned up.

    A null text counts as empty.  The plan is narrow; whoever wants to see the gain analyses ``fixed.text`` again.
    """
    named = df.withColumn("text", F.coalesce("text", F.lit("")))
    edited = named.withColumn("_edited", applied(F.col("text"), phrase_edits(lang)))
    clean = edited.withColumn("_clean", normalize_text(F.col("_edited.text")))
    fixed_ = F.struct(F.col("_clean.text").alias("text"), F.col("_edited.n").alias("n_phrases"), F.col("_clean.replaced").alias("replaced"), F.col("_clean.removed").alias("removed"))
    return clean.withColumn("fixed", fixed_).drop("_edited", "_clean")
