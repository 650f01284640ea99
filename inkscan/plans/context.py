"""The text context: language, words, paragraphs and sentences, as columns of each document's row.

All of it is narrow: no shuffle, so it runs unchanged on a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkscan.functions.regexlib import WORD, WS, WS_CHARACTERS, every, js, let, running_sum, trim

# Abbreviations after which a full stop ends no sentence.
ABBREVIATIONS = "т е г гг др пр им см стр руб тыс млн млрд ул д с п mr mrs ms dr prof vs etc e i g eg ie inc ltd st no fig".split()
LIST = js(r"^\s*(?:[-*•–—]|\d+[.)]|\p{Extended_Pictographic})\s+")
#: What a list item may begin with.
LIST_FIRST = js(r"[\s*•–—\d\p{Extended_Pictographic}-]")
HEADING = js(r"^(?:#{1,6}\s+.+|[^.!?…:;]{2,80})$")
#: Between sentences while they are cut; a noncharacter that texts don't hold.
MARK = "\uFDD0"

# A sentence ends with .!?… and closing quotes before white space or the end, unless a lone full stop follows an
# abbreviation or a single letter and a small letter or digit comes next, or stands between two digits.
# The mark itself is looked for first, then what follows it: abbreviations are only looked for where both may stand in a sentence.
SENTENCE_END = (
    rf"(?=[.!?…])(?!(?=\.[{WS}]+[\p{{Ll}}\d])(?<=(?<!\p{{L}})(?iu:{'|'.join(sorted(ABBREVIATIONS, key=lambda a: -len(a)))}|\p{{L}})))"
    rf"(?!(?<=\d)\.[{WS}]+\d)"
    rf"[.!?…]+[\"»”’)]*(?=[{WS}]|\z)"
)


#: Runs of letters of a script; where ranges tell, no letter's script is looked up.
CYRILLIC_RUN, LATIN_RUN = r"[\x{400}-\x{481}[[\x{482}-\x{1FFFF}]&&\p{IsCyrillic}]]+", r"[[^\x{2E5}-\x{52F}]&&\p{IsLatin}]+"


def script_counts(text: Column) -> tuple[Column, Column]:
    """Cyrillic and Latin letters of a text with Cyrillic ones; of any other 0 and 0, as its language and share of the lesser script do not depend on them."""
    some, without = text.rlike(CYRILLIC_RUN), lambda run: F.length(text) - F.length(F.regexp_replace(text, run, ""))
    return F.when(some, without(CYRILLIC_RUN)).otherwise(0), F.when(some, without(LATIN_RUN)).otherwise(0)


def words_of(text: Column) -> Column:
    return F.transform(every(text, WORD), F.lower)


def n_words_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def pieces_of(paragraph: Column) -> Column:
    """Trimmed sentences with a letter or digit."""
    pieces = F.split(F.regexp_replace(paragraph, SENTENCE_END, "$0" + MARK), MARK, -1)
    return F.filter(F.transform(pieces, trim), lambda s: s.rlike(r"[\p{L}\p{N}]"))


def counted(pieces: Column) -> Column:
    """Sentences with their words, which are looked for once: (text, n words, first word)."""
    return F.transform(pieces, lambda s: let(every(s, WORD), lambda w: F.struct(s.alias("text"), F.size(w).alias("n"), F.lower(F.get(w, F.lit(0))).alias("first"))))


LINE_MARK = js(r"^\s*(?:[-*•–—]|\d+[.)]|\p{Extended_Pictographic})\s+|^#{1,6}\s", "m")


def paragraphs_of(text: Column, has_blank: Column | None = None) -> Column:
    """Blocks between blank lines, or lines where there is no blank one; a block with list items or headings falls into lines.

    Whether there is a blank line is seen from the lines, where it is not told.
    """
    by_blank = F.transform(F.split(text, rf"\n[{WS}]*\n", -1), trim)
    broken = F.flatten(F.transform(by_blank, lambda b: F.when(b.contains("\n") & b.rlike(LINE_MARK), F.transform(F.split(b, "\n", -1), trim)).otherwise(F.array(b))))

    def of_lines(lines: Column) -> Column:
        between = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 2, F.lit(0)))
        return F.when(F.array_contains(between, "") if has_blank is None else has_blank, broken).otherwise(lines)

    return F.filter(let(F.transform(F.split(text, "\n", -1), trim), of_lines), lambda p: p != "")


def _placed(parts: Column, gaps: Column | int, at: Column) -> Column:
    """(text, start) of the trimmed ``parts`` of a text that starts at ``at``, with ``gaps`` between them, or one of a length between all."""

    def each(parts: Column, gaps: Column | int) -> Column:
        sized = F.zip_with(parts, F.transform(parts, lambda _: F.lit(gaps)) if isinstance(gaps, int) else gaps, lambda p, g: F.struct(p.alias("p"), F.length(p).alias("n"), F.coalesce(g, F.lit(0)).alias("g")))

        def placed(sized: Column) -> Column:
            ends = running_sum(F.transform(sized, lambda x: x["n"] + x["g"]))
            begun = F.zip_with(sized, ends, lambda x, e: F.struct(x["p"].alias("p"), (at + e - x["g"] - F.length(F.ltrim(x["p"], F.lit(WS_CHARACTERS)))).alias("s")))
            return F.transform(begun, lambda x: F.struct(trim(x["p"]).alias("text"), x["s"].alias("start")))

        return let(sized, placed)

    return let(parts, lambda parts: each(parts, gaps) if isinstance(gaps, int) else let(gaps, lambda gaps: each(parts, gaps)))


def sentence_places(text: Column) -> Column:
    """(start, end) of all sentences, in the order of the context's, in code points.

    The text is cut as the context cuts it, and the lengths of pieces and of what lies between them are added up.
    """
    blank = rf"\n[{WS}]*\n"
    lines = lambda p: _placed(F.split(p["text"], "\n", -1), 1, p["start"])
    whole = F.struct(text.alias("text"), F.lit(0).alias("start"))
    blocks = _placed(F.split(text, blank, -1), F.transform(every(text, blank), F.length), F.lit(0))
    broken = F.flatten(F.transform(blocks, lambda b: F.when(b["text"].contains("\n") & b["text"].rlike(LINE_MARK), lines(b)).otherwise(F.array(b))))
    paragraphs = F.filter(F.when(text.rlike(blank), broken).otherwise(lines(whole)), lambda p: p["text"] != "")

    def sentences(p: Column) -> Column:
        pieces = F.split(F.regexp_replace(p["text"], SENTENCE_END, "$0" + MARK), MARK, -1)
        held = F.filter(_placed(pieces, 0, p["start"]), lambda s: s["text"].rlike(r"[\p{L}\p{N}]"))
        return F.transform(held, lambda s: F.struct(s["start"].alias("start"), (s["start"] + F.length(s["text"])).alias("end")))

    return F.flatten(F.transform(paragraphs, sentences))


def kind_of(paragraph: Column) -> Column:
    # a first character and a length in bytes tell most paragraphs apart, without a look at the rest
    may_head = (F.octet_length(paragraph) <= 4 * 80) | paragraph.startswith("#")
    heading = may_head & ~paragraph.contains("\n") & paragraph.rlike(HEADING) & (n_words_of(paragraph) <= 10)
    return F.when(F.substring(paragraph, 1, 1).rlike(LIST_FIRST) & paragraph.rlike(LIST), "list").when(heading, "heading").otherwise("text")


def with_context(df: DataFrame, lang: Column | None = None, markdown: Column | None = None) -> DataFrame:
    """``df`` with columns lang, mixed_share, words, n_words, blocks (text, kind), cut (text, kind, pieces), paras (text, kind, sents), sents, prose and is_markdown.

    Blocks, cut and paras are the same paragraphs: a detector reads the first that tells enough, as sentences and their words cost most.

    ``text`` null counts as empty.  ``lang`` forces the language; else more Cyrillic letters than
    Latin ones make it ru, anything else en.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    cyrillic, latin = script_counts(F.col("text"))
    df = df.withColumn("text", text).withColumn("scripts", F.struct(cyrillic.alias("c"), latin.alias("l")))
    c, latin = F.col("scripts.c"), F.col("scripts.l")
    detected = F.when((c + latin > 0) & (c >= latin), "ru").otherwise("en")
    df = df.withColumn("lang", detected if lang is None else F.coalesce(lang, detected))
    df = df.withColumn("mixed_share", F.when(c + latin > 0, F.least(c, latin) / (c + latin)).otherwise(0.0)).drop("scripts")
    df = df.withColumn("words", words_of(F.col("text"))).withColumn("n_words", F.size("words"))
    df = df.withColumn("blocks", F.transform(paragraphs_of(F.col("text")), lambda p: F.struct(p.alias("text"), kind_of(p).alias("kind"))))
    df = df.withColumn("cut", F.transform("blocks", lambda p: F.struct(p["text"].alias("text"), p["kind"].alias("kind"), pieces_of(p["text"]).alias("pieces"))))
    df = df.withColumn("paras", F.transform("cut", lambda p: F.struct(p["text"].alias("text"), p["kind"].alias("kind"), counted(p["pieces"]).alias("sents"))))
    df = df.withColumn("sents", F.flatten(F.transform("paras", lambda p: p["sents"])))
    df = df.withColumn("prose", F.flatten(F.transform(F.filter("paras", lambda p: p["kind"] == "text"), lambda p: p["sents"])))
    return df.withColumn("is_markdown", F.lit(False) if markdown is None else markdown)
