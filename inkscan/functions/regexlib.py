"""Regular expressions with browser semantics, written for the Java engine.

``js`` rewrites what differs: ``\\b``, ``\\s`` and ``\\S`` (ASCII boundaries, Unicode space), script
and pictograph classes, and ``$`` at the very end.  ``(?iu)`` gives Unicode case folding.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as browsers see it, for use inside brackets.  Java asks the members of a class one after another, so they are few.
WS = r"\t\n\x0B\f\r \p{Z}\uFEFF"


def boundary(letter: str) -> str:
    return f"(?:(?<!{letter})(?={letter})|(?<={letter})(?!{letter}))"


#: Between ASCII letters, digits or _ and all else; where case is folded, what folds to an ASCII letter counts as one, and is listed so that Java folds nothing.
BOUNDARY, FOLDED_BOUNDARY = boundary(r"\w"), boundary(r"(?-iu)[\w\x{130}\x{131}\x{17F}\x{212A}]")
WORD = "[\\p{L}\\p{N}]+(?:['’-][\\p{L}\\p{N}]+)*"


def ranges(points: Iterable[int]) -> str:
    """Ascending code points for use inside brackets.  Neighbours beyond ASCII become ranges, as Java asks each member apart; below, it has a table of single ones."""
    out: list[list[int]] = []
    for c in points:
        if out and out[-1][1] == c - 1 and c > 0x80:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in out)


@cache
def pictographs() -> str:
    """Code point ranges of pictographs, for use inside brackets."""
    import regex

    one = regex.compile(r"\p{Extended_Pictographic}")
    return ranges([c for c in range(0xA9, 0x1FB00) if not 0xD800 <= c < 0xE000 and one.match(chr(c))])


def js(pattern: str, flags: str = "") -> str:
    """A browser pattern for Java: flags ``i`` (Unicode case folding) and ``m``."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == "\\b" and not inside:
            out.append(FOLDED_BOUNDARY if "i" in flags else BOUNDARY)
        elif two == "\\s":
            out.append(WS if inside else f"[{WS}]")
        elif two == "\\S" and not inside:
            out.append(f"[^{WS}]")
        elif pattern.startswith(r"\p{Extended_Pictographic}", i):
            out.append(pictographs() if inside else f"[{pictographs()}]")
            i += len(r"\p{Extended_Pictographic}")
            continue
        elif two[:1] == "\\":
            out.append(two)
        elif two[:1] == "$" and not inside and "m" not in flags:
            out.append(r"\z")
            i += 1
            continue
        elif two[:1] == "[" and inside:
            out.append(r"\[")
            i += 1
            continue
        else:
            inside = {"[": True, "]": False}.get(two[:1], inside)
            out.append(two[:1])
            i += 1
            continue
        i += 2
    head = ("(?iu)" if "i" in flags else "") + ("(?m)" if "m" in flags else "")
    return head + "".join(out)


def escaped(phrase: str) -> str:
    return "".join("\\" + c if c in r".*+?^${}()|[]\-" else c for c in phrase)


def sql(text: str) -> str:
    """A string as SQL says it, for tables that are told as one expression."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def trie(listed: list[str]) -> str:
    """A pattern that matches the longest of the phrases at a place: their tree, letter by letter.

    Alternatives that begin alike are told apart where they part, so a place that begins none of them
    costs one look and not one per phrase.
    """
    tree: dict = {}
    for phrase in listed:
        at = tree
        for c in phrase:
            at = at.setdefault(c, {})
        at[""] = {}

    def pattern(at: dict) -> str:
        path = ""
        while len(at) == 1 and "" not in at:  # nothing parts here
            c, at = next(iter(at.items()))
            path += escaped(c)
        ways = [escaped(c) + pattern(below) for c, below in sorted(at.items()) if c]
        if not ways:
            return path
        rest = "(?:" + "|".join(ways) + ")"
        return path + (rest + "?" if "" in at else rest)

    return pattern(tree)


def begins(letters: str) -> str:
    """A look ahead that holds wherever one of the letters may stand, in either case: a quick test before slow ones, and before any flags.

    It may hold elsewhere too.  It fails at all other ASCII characters, for which Java has a table, and at other letters of the basic
    Cyrillic block where these are a few ranges; all else passes, as letters that fold to one of these may stand there.
    """
    cases = {ord(c) for x in letters for c in (x.lower(), x.upper()) if len(c) == 1}
    others, cyrillic = (ranges(c for c in block if c not in cases) for block in (range(0x80), range(0x400, 0x460)))
    # Java asks the members of a class one inside another, so the second is asked apart, and only where it is short
    return f"(?![{others}])" + (f"(?![{cyrillic}])" if cyrillic.count("x") <= 4 else "")


#: ``\b`` before a letter, and before what is none, where case is folded; before any flags.
WORD_START, AFTER_WORD = (rf"(?<{sign}[\w\x{{130}}\x{{131}}\x{{17F}}\x{{212A}}])" for sign in "!=")


def stretches(text: Column, between: str, holds: str) -> Column:
    """The parts of a text between the characters ``between`` that hold a pattern, with full stops between them.

    Matches of a slow pattern that cross none of these characters, look at none as at a letter, and always hold ``holds`` are the same in
    what is left, which is little or nothing of most texts.
    """
    parts = F.filter(F.split(text, between, -1), lambda part: part.rlike(holds))
    return F.when(text.rlike(holds), F.array_join(parts, ".")).otherwise("")


def placed_stretches(text: Column, between: str, holds: str) -> Column:
    """(text, start) of the same parts, with their places in the text; none where nothing holds the pattern."""

    def placed(parts: Column) -> Column:
        begun = F.zip_with(parts, running_sum(F.transform(parts, lambda p: F.length(p) + 1)), lambda p, e: F.struct(p.alias("text"), (e - F.length(p) - 1).alias("start")))
        return F.filter(begun, lambda p: p["text"].rlike(holds))

    return F.when(text.rlike(holds), let(F.split(text, between, -1), placed)).otherwise(F.expr("cast(array() as array<struct<text:string,start:int>>)"))


def spans_within(parts: Column, pattern: str | Column) -> Column:
    """The spans of a pattern in such parts, in places of the whole text."""
    shifted = lambda p: F.transform(spans_of(p["text"], pattern), lambda s: F.struct((s["start"] + p["start"]).alias("start"), (s["end"] + p["start"]).alias("end"), s["label"].alias("label")))
    return F.flatten(F.transform(parts, shifted))


def phrases(listed: list[str], flags: str = "iu") -> str:
    """Any of the phrases, the longest that stands there, not after a letter or digit; what follows may go on."""
    return f"{begins(''.join({p[0] for p in listed}))}(?{flags})(?<![\\p{{L}}\\p{{N}}])(?:{trie(listed)})"


def literal_heads(pattern: str) -> list[str]:
    """What the matches of a pattern begin with, an entry per alternative: its letters up to the first that may be missing or vary."""
    depth, alternatives, at = 0, [""], 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            alternatives[-1] += pattern[at : at + 2]
            at += 2
            continue
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            alternatives.append("")
        else:
            alternatives[-1] += c
        at += 1
    heads = []
    for a in alternatives:
        if a.startswith("(?:"):  # a choice at the very start: each of its ways
            end, depth = 3, 1
            while depth:
                depth += {"(": 1, ")": -1}.get(a[end], 0)
                end += 1
            if a[end : end + 1] not in ("?", "*", "{"):
                heads += literal_heads(a[3 : end - 1])
                continue
        n = next((i for i, c in enumerate(a) if c in "\\([{?*+.|^$"), len(a))
        heads.append(a[: n - 1] if n < len(a) and a[n] in "?*{" else a[:n])
    return heads


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def every(text: Column, pattern: str | Column, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


#: The same characters one by one.
WS_CHARACTERS = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(WS_CHARACTERS))


def blank(text: Column) -> Column:
    return ~text.rlike(f"[^{WS}]")


def running(values: Column, f: Callable[[Column, Column], Column], first: Column) -> Column:
    """Running results of an associative ``f`` over an array, each with its own element; ``first`` changes nothing under ``f``.

    By doubling: every step combines each element with that 1, 2, 4 .. places before it, so an array of n
    elements costs n log n, where gathering them one by one would copy the array n times.
    """

    def step(acc: Column, k: Column) -> Column:
        shifted = F.concat(F.array_repeat(first, F.call_function("shiftleft", F.lit(1), k)), acc)
        return F.zip_with(F.slice(shifted, F.lit(1), F.size(acc)), acc, f)

    def doubled(values: Column) -> Column:
        steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values))).cast("int") - 1)
        return F.when(F.size(values) > 1, F.aggregate(steps, values, step)).otherwise(values)

    return let(values, doubled)


def running_sum(values: Column) -> Column:
    return running(values, lambda a, b: a + b, F.lit(0))


def running_sum_long(values: Column) -> Column:
    return running(values, lambda a, b: a + b, F.lit(0).cast("long"))


def spans_of(text: Column, pattern: str | Column) -> Column:
    """(start, end, label) of every match, in code points.

    Gaps and matches alternate; ends are running sums over both.
    """
    none = F.expr("cast(array() as array<struct<start:int,end:int,label:string>>)")

    def placed(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        ends = running_sum(F.zip_with(gaps, found, lambda g, m: F.length(g) + F.length(m)))
        return F.zip_with(ends, found, lambda e, m: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("label")))

    return let(every(text, pattern), lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(none))


#: Code points in a block of a text that is cut at many places.
BLOCK = 256


def cutter(text: Column, f: Callable[[Callable[[Column, Column], Column]], Column]) -> Column:
    """``f`` of a function that gives the text between two places (code points from 0, end exclusive).

    A place in a string is found by counting from its start; here the text is cut into blocks once, and a
    piece costs its own length and two blocks.
    """

    def pieces(blocks: Column) -> Column:
        def piece(start: Column, end: Column) -> Column:
            first = F.floor(start / BLOCK).cast("int")
            n = F.floor((end - 1) / BLOCK).cast("int") - first + 1
            held = F.array_join(F.slice(blocks, first + 1, F.greatest(n, F.lit(0))), "")
            return F.when(end > start, F.substring(held, start - first * BLOCK + 1, end - start)).otherwise("")

        return f(piece)

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), pieces)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``value``, which is computed once however often ``f`` uses it, inside lambdas too."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def held(value: Column) -> Column:
    """``value`` behind a bar: neither it nor a filter on what is made of it is copied into the plan below.

    Spark pushes filters, also those that it adds itself under ``explode``, through projections and repeats what they
    compute.  A condition that always holds, and that the optimizer takes for one that may change, keeps an
    expensive column where it stands.  Filters on other columns stay above it as well.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def _mean(v: Column) -> Column:
    return F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)).otherwise(0.0)


def _std(v: Column, m: Column) -> Column:
    squares = F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - m) * (x - m))
    return F.when(F.size(v) > 1, F.sqrt(squares / F.size(v))).otherwise(0.0)


def mean(numbers: Column) -> Column:
    return let(numbers, _mean)


def cv(numbers: Column) -> Column:
    """Population deviation over mean; 0 where the mean is."""
    return let(numbers, lambda v: let(_mean(v), lambda m: F.when(m != 0, _std(v, m) / m).otherwise(0.0)))


def share(part: Callable[[Column], Column], whole: Column) -> Column:
    """The share of an array's elements that ``part`` keeps."""
    return let(whole, lambda v: F.size(F.filter(v, part)) / F.size(v))


def per1000(n: Column, words: Column) -> Column:
    return F.when(words > 0, n * 1000.0 / words).otherwise(0.0)
