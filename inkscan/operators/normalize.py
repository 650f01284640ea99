"""Clean-up of look-alike letters and invisible characters, on the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkscan.functions.regexlib import every, let
from inkscan.operators.typography import CYRILLIC, GREEK, GREEK_AS_LATIN, INVISIBLE, LATIN, ODD_NBSP

_GREEK_CYRILLIC = "".join(CYRILLIC[LATIN.index(c)] if c in LATIN else c for c in GREEK_AS_LATIN)
#: A whole word with a Cyrillic or Greek letter; no other is of two scripts.
_OTHER = r"[^\x00-\x7F]&&[\p{IsCyrillic}\p{IsGreek}]"
LOOK_ALIKE = rf"(?<!\p{{L}})[\p{{L}}&&[^[{_OTHER}]]]*+[\p{{L}}&&[{_OTHER}]]\p{{L}}*+"


def normalize_text(text: Column) -> Column:
    """(text, replaced, removed): invisibles go, odd no-break spaces become spaces, words of two scripts become of one."""
    odd = F.regexp_count(text, F.lit(ODD_NBSP))
    gone = F.regexp_count(text, F.lit(f"[{INVISIBLE}]"))
    clean = F.regexp_replace(F.regexp_replace(text, ODD_NBSP, " "), f"[{INVISIBLE}]", "")

    def mended(word: Column) -> Column:
        c, latin = F.regexp_count(word, F.lit(r"\p{IsCyrillic}")), F.regexp_count(word, F.lit(r"\p{IsLatin}"))
        to_cyrillic = F.translate(F.translate(word, LATIN, CYRILLIC), GREEK, _GREEK_CYRILLIC)
        to_latin = F.translate(F.translate(word, CYRILLIC[:-1], LATIN[:-1]), GREEK, GREEK_AS_LATIN)
        mixed = ((c > 0) & (latin > 0)) | word.rlike(f"[{GREEK}]")
        return F.when(~mixed, word).when(c >= latin, to_cyrillic).otherwise(to_latin)

    def letters_changed(p: Column) -> Column:
        return F.aggregate(F.zip_with(F.split(p["was"], ""), F.split(p["now"], ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda b, x: b + x)

    def done(clean: Column) -> Column:
        # words with such letters and what stands between them alternate
        words, gaps = every(clean, LOOK_ALIKE), F.split(clean, LOOK_ALIKE, -1)

        def put(pairs: Column) -> Column:
            changed = F.aggregate(F.filter(pairs, lambda p: p["was"] != p["now"]), F.lit(0), lambda a, p: a + letters_changed(p))
            joined = F.array_join(F.zip_with(gaps, F.concat(F.transform(pairs, lambda p: p["now"]), F.array(F.lit(""))), lambda g, w: F.concat(g, w)), "")
            return F.struct(joined.alias("text"), changed.alias("replaced"), (gone + odd).alias("removed"))

        return let(F.transform(words, lambda w: F.struct(w.alias("was"), mended(w).alias("now"))), put)

    return let(clean, done)
