"""L-01 to L-06: marker phrases, diversity, rare words, hedging, noise, repeated trigrams."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkscan import rules
from inkscan.functions.regexlib import WORD_START, WS, begins, count, cv, every, js, let, literal_heads, per1000, phrases, sql, stretches, trie
from inkscan.operators.base import by_lang, let_result, register, result

# Stop words.
STOP_WORDS = {
    "ru": "и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только ее мне было вот от меня еще нет о из ему теперь когда даже ну ли если уже или ни быть был него до вас нибудь опять уж вам ведь там потом себя ничего ей может они тут где есть надо ней для мы тебя их чем была сам чтоб без будто чего раз тоже себе под будет ж тогда кто этот того потому этого какой совсем ним здесь этом один почти мой тем чтобы нее сейчас были куда зачем всех никогда можно при наконец два об другой хоть после над больше тот через эти нас про всего них какая много разве три эту моя впрочем хорошо свою этой перед иногда лучше чуть том нельзя такой им более всегда конечно всю между это".split(),
    "en": "the a an and or but of to in on at for with by from is are was were be been it this that these those as not no so if then than there their they we you he she i his her its our your my me us them which who what when where how all any can will would should could do does did have has had into about over also just more most such only own same too very".split(),
}
# Patterns of passives, dates, smileys and names inside sentences.
PASSIVE = {
    "en": begins("iawb") + WORD_START + js(r"(?:is|are|was|were|be|been|being)\s+(?:\w+ly\s+)?\w+(?:ed|en)\b", "i"),
    "ru": r"(?iu)(?<!\p{L})\p{L}+(?:ется|ются|ится|ятся|ался|алась|ались|ено|ена|ены|ан[ао]?|ят[ао]?)(?!\p{L})",
}
NUMBERS = r"(?=[0123456789])(?<!\w)" + js(r"(?:(?:19|20)\d{2}\b|\d{1,2}[./]\d{1,2}(?:[./]\d{2,4})?\b)")
SMILEYS = r"(?=[.:;)])(?:\.\.\.|:\)|\)\)|;\)|:D)"
NAMES = rf"\p{{Lu}}(?<=[{WS},(«\"]\p{{Lu}})\p{{Ll}}{{2,}}"
BASE_SHARE = {"ru": 0.06, "en": 0.04}


def marker_pattern(pattern: str) -> str:
    return js(rf"(?<![\p{{L}}])(?:{pattern})(?![\p{{L}}])", "i")


def marker_index(lang: str) -> tuple[str, list[list[str]]]:
    """A pattern that finds where any marker may begin, and per marker the beginnings of its phrases."""
    heads = [sorted({h.lower() for h in literal_heads(p)}) for p, _, _ in rules.MARKERS[lang]]
    # of beginnings within each other the shortest stands for all of them
    every = sorted({h for own in heads for h in own})
    short = {h: next(k for k in sorted(every, key=len) if h.startswith(k)) for h in every}
    return f"{begins(''.join({h[0] for h in short.values()}))}(?iu)(?<!\\p{{L}})(?=({trie(sorted(set(short.values())))}))", [sorted({short[h] for h in own}) for own in heads]


def any_marker(lang: str) -> str:
    """A pattern that finds something exactly where some marker's does."""
    return marker_index(lang)[0] + marker_pattern("|".join(p for p, _, _ in rules.MARKERS[lang]))


def said_parts(lang: str, text: Column | None = None) -> Column:
    """What of a text holds markers: where none goes across sentences, those that hold one, else the whole text; mostly nothing."""
    text = F.col("text") if text is None else text
    return F.when(text.rlike(any_marker(lang)), text).otherwise("") if crosses_sentences(lang) else stretches(text, "[.!?]", any_marker(lang))


def present_markers(lang: str, text: Column | None = None) -> Column:
    """(place, pattern, weight, options, heads) of the markers that may stand in the text: one pass finds where phrases begin, and only those are looked for."""
    pattern, heads = marker_index(lang)
    rows = [
        f"named_struct('place', {i}, 'pattern', {sql(marker_pattern(p))}, 'weight', {float(weight)}D, 'options', array({', '.join(map(sql, options))}), 'heads', array({', '.join(map(sql, own))}))"
        for i, ((p, weight, options), own) in enumerate(zip(rules.MARKERS[lang], heads, strict=True))
    ]
    found = F.array_distinct(F.transform(every(F.col("text") if text is None else text, pattern, 1), lambda h: F.lower(F.upper(F.translate(h, "İ", "i")))))
    return let(found, lambda f: F.when(F.size(f) > 0, F.filter(F.expr(f"array({', '.join(rows)})"), lambda m: F.arrays_overlap(f, m["heads"]))))


def crosses_sentences(lang: str) -> bool:
    """Whether a marker of the table may hold one of ``.!?``; of classes and what stands for any character that is assumed."""
    return any(re.search(r"[.!\[]|\\[?DPSW]", p) for p, _, _ in rules.MARKERS[lang])


def marker_weight(lang: str) -> Column:
    """Sum of the weights of all marker hits; markers count apart, so overlapping ones all do."""

    def added(text: Column) -> Column:
        return F.aggregate(present_markers(lang, text), F.lit(0.0), lambda a, m: a + F.regexp_count(text, m["pattern"]) * m["weight"])

    return F.coalesce(let(said_parts(lang), added), F.lit(0.0))


@register("L-01")
def markers() -> Column:
    mixed = F.col("mixed_share") > 0.2
    ru = F.when(mixed | (F.col("lang") == "ru"), marker_weight("ru")).otherwise(0.0)
    en = F.when(mixed | (F.col("lang") == "en"), marker_weight("en")).otherwise(0.0)
    return result("L-01", per1000(ru + en, F.col("n_words")), F.col("n_words") >= 20)


@register("L-02")
def flat_diversity() -> Column:
    starts = F.when(F.col("n_words") >= 150, F.expr("sequence(1, n_words - 49, 10)"))
    shares = F.transform(starts, lambda i: F.size(F.array_distinct(F.slice("words", i, F.lit(50)))) / 50.0)
    return result("L-02", cv(shares), F.col("n_words") >= 150)


def hapax_share(words: Column) -> Column:
    """Words used once among the distinct ones: in sorted order, those unlike both neighbours."""

    def once(s: Column) -> Column:
        n = F.size(s)
        before = F.slice(F.concat(F.array(F.lit("")), s), F.lit(1), n)
        after = F.concat(F.slice(s, F.lit(2), n), F.array(F.lit("")))
        near = F.zip_with(before, after, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        flags = F.zip_with(s, near, lambda w, x: (w != x["a"]) & (w != x["b"]))
        return F.size(F.filter(flags, lambda x: x)) / F.size(F.array_distinct(s))

    return let(F.sort_array(words), once)


@register("L-03")
def thin_tail() -> Column:
    plain = F.filter("words", lambda w: ~w.rlike(r"\A\d+\z"))
    return let_result("L-03", let(plain, lambda p: F.when(F.size(p) >= 100, hapax_share(F.slice(p, 1, 300)))))


def nominal_words(lang: str) -> Column:
    listed = rules.LEXICON["nominal_suffixes"][lang]
    plain = all(s.isalpha() for s in listed)
    ends = lambda w: reduce(or_, (w.endswith(s) for s in listed)) if plain else w.rlike(rf"(?:{'|'.join(listed)})\z")
    return F.size(F.filter("words", lambda w: (F.length(w) > 6) & ends(w)))


@register("L-04")
def hedging() -> Column:
    def load(lang: str) -> Column:
        hedges = count(F.col("text"), phrases(rules.LEXICON["hedges"][lang]))
        excess = F.greatest(F.lit(0.0), nominal_words(lang) - F.col("n_words") * BASE_SHARE[lang])
        return hedges * 2 + excess + count(F.col("text"), PASSIVE[lang]) * 0.5

    return result("L-04", per1000(by_lang(load), F.col("n_words")), F.col("n_words") >= 40)


@register("L-05")
def noise() -> Column:
    text, mixed = F.col("text"), F.col("mixed_share") > 0.2
    listed = {lang: F.size(F.filter("words", lambda w: w.isin(*rules.LEXICON["noise"][lang]))) for lang in ("ru", "en")}  # noqa: B023
    words = F.when(mixed, F.size(F.filter("words", lambda w: w.isin(*rules.LEXICON["noise"]["ru"], *rules.LEXICON["noise"]["en"])))).otherwise(by_lang(listed.get))
    marks = count(text, "[!?]") + count(text, r"\([^)]{1,60}\)") + F.when(text.rlike("[0-9]"), count(text, NUMBERS)).otherwise(0) + count(text, SMILEYS)
    names = F.aggregate("sents", F.lit(0), lambda a, s: a + F.least(F.lit(3), F.regexp_count(F.substring(s["text"], F.lit(2), F.length(s["text"])), F.lit(NAMES))))
    return result("L-05", per1000(words + marks + names * 0.5, F.col("n_words")), F.col("n_words") >= 40)


def content_trigrams(lang: str) -> Column:
    """Word trigrams with at least two words that are no stop words."""
    words = F.transform("words", lambda w: F.struct(w.alias("w"), F.when(w.isin(*STOP_WORDS[lang]), 0).otherwise(1).alias("own")))
    n = F.col("n_words") - 2

    def three(words: Column) -> Column:
        two = F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        return F.zip_with(two, F.slice(words, F.lit(3), n), lambda ab, c: F.when(ab["a"]["own"] + ab["b"]["own"] + c["own"] >= 2, F.concat_ws(" ", ab["a"]["w"], ab["b"]["w"], c["w"])))

    return F.array_compact(let(words, three))


@register("L-06")
def repeated_trigrams() -> Column:
    grams = F.when(F.col("n_words") >= 80, by_lang(content_trigrams))
    again = let(grams, lambda g: F.size(g) - F.size(F.array_distinct(g)))
    return result("L-06", per1000(again, F.col("n_words")), F.col("n_words") >= 80)
