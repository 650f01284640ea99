"""C-01 to C-05 over source code, with the helpers that tell code from prose and name its language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkscan import rules
from inkscan.functions.regexlib import blank, count, cv, every, js, trim
from inkscan.operators.base import register, result

# Languages by file extension, and the patterns of the detectors.
BY_EXTENSION = {
    "py": "python", "js": "javascript", "mjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript",
    "go": "go", "java": "java", "cs": "csharp", "php": "php", "rb": "ruby", "rs": "rust", "kt": "kotlin", "swift": "swift",
    "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "sh": "shell", "sql": "sql", "scala": "scala",
}
PYTHON, STATEMENT_END = js(r"^\s*(def |import |from \S+ import |class \w+[:(])", "m"), js(r"[;{]\s*$", "m")
GO_PACKAGE, GO_FUNC = js(r"^\s*package \w+\s*$", "m"), js(r"\bfunc\b")
BY_PATTERN = [
    ("php", r"<\?php"), ("java", js(r"\bpublic (?:static )?class\b|System\.out\.println")), ("csharp", js(r"\busing System\b|Console\.WriteLine")),
    ("typescript", js(r":\s*(?:string|number|boolean)\b|\binterface \w+ \{|\btype \w+ =")), ("javascript", js(r"\b(?:const|let|function)\b|=>")), ("cpp", js(r"#include\s*<")),
]
CODE_LINE = js(r"[{};]\s*$|^\s*(?:def|class|import|from|return|if|for|while|const|let|var|function|public|private|func|package|#include)\b|^\s{2,}\S|=>|==|\(\)\s*[:{]")
HASH, SLASH = js(r"^\s*#(?!!)\s?(.*)$"), js(r"^\s*(?:\/\/|\/?\*+)\s?(.*)$")
HASH_INLINE, SLASH_INLINE = js(r"\s#\s(.+)$"), js(r"\s\/\/\s?(.+)$")
STEP = js(r"^step\s*\d+|^шаг\s*\d+|^\d+\.\s", "i")
OBVIOUS = js(r"^(?:increment|decrement|initiali[sz]e|import|define|create|set|get|return|loop|iterate|check if|call|print|add|update|declare|instantiate|open|close|read|write|convert|calculate)\b.{0,40}$", "i")
FUNCTION = js(r"^\s*(?:def |async def |func |function |public |private |protected )", "m")
DOCSTRING = js(r"""^\s*(?:def|class) [^\n]+:\n\s*(?:\"{3}|'{3})""", "m")
BLOCK_COMMENT = js(r"\/\*\*[\s\S]*?\*\/\s*\n\s*(?:export |public |private |function |async )")
NAMED = js(r"\b(?:def|function|func|let|const|var|class|async def)\s+([A-Za-z_]\w*)|\b([a-z_][A-Za-z0-9_]*)\s*=(?!=)")
SHORT_NAMES = "i j k n x y idx cfg ctx req res resp err tmp buf ptr num cnt len str obj arr val args kwargs db fn cb el ev e df ok id s v t m p q r w h conn msg src dst env opts params".split()
MAIN = js(r"""if __name__ == ['"]__main__['"]:\s*\n\s+main\(\)""")
CATCH_ALL = js(r"except\s+Exception(?:\s+as\s+\w+)?\s*:|catch\s*\(\s*(?:Exception|error|err|e)\s*(?::\s*\w+)?\)")
EMOJI_LOG = js(r"(?:print|console\.\w+|log(?:ger)?\.\w+|fmt\.Print\w*)\([^)\n]*\p{Extended_Pictographic}[^)\n]*\)")
INDENT, LOOSE_END = js(r"^(\s+)\S"), js(r"\S[ \t]+$")
FUNCTION_LINE = js(r"^\s*(?:def |async def |func |function |public |private )")


def language(code: Column, name: Column | None = None) -> Column:
    """By the file's extension, else the first pattern that holds, else unknown."""
    guess = F.when(code.rlike(PYTHON) & ~code.rlike(STATEMENT_END), "python").when(code.rlike(GO_PACKAGE) & code.rlike(GO_FUNC), "go")
    for lang, pattern in BY_PATTERN:
        guess = guess.when(code.rlike(pattern), lang)
    guess = guess.otherwise("unknown")
    if name is None:
        return guess
    known = F.create_map(*(F.lit(x) for pair in BY_EXTENSION.items() for x in pair))
    return F.coalesce(F.element_at(known, F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)\z", 1))), guess)


def looks_like_code(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: ~blank(x))
    return (F.size(lines) >= 3) & (F.size(F.filter(lines, lambda x: x.rlike(CODE_LINE))) / F.size(lines) > 0.5)


def with_code_context(df: DataFrame, code: str = "code", name: str | None = None) -> DataFrame:
    """Columns code, language, lines, comments, and lang (thresholds don't differ by it)."""
    df = df.withColumn("code", F.coalesce(F.col(code), F.lit(""))).withColumn("lang", F.lit("en"))
    df = df.withColumn("language", language(F.col("code"), None if name is None else F.col(name))).withColumn("lines", F.split("code", "\n", -1))
    hashed = F.col("language").isin("python", "ruby", "shell")

    def comment(line: Column) -> Column:
        full = F.when(hashed, F.when(line.rlike(HASH), F.regexp_extract(line, HASH, 1))).otherwise(F.when(line.rlike(SLASH), F.regexp_extract(line, SLASH, 1)))
        inline = F.when(hashed, F.regexp_extract(line, HASH_INLINE, 0)).otherwise(F.regexp_extract(line, SLASH_INLINE, 0))
        said = F.when(hashed, F.regexp_extract(line, HASH_INLINE, 1)).otherwise(F.regexp_extract(line, SLASH_INLINE, 1))
        return trim(F.coalesce(full, F.when((inline != "") & ~inline.rlike("[\"'`]"), said)))

    return df.withColumn("comments", F.array_compact(F.transform("lines", comment)))


def _full_lines() -> Column:
    return F.filter("lines", lambda x: ~blank(x))


@register("C-01")
def comments() -> Column:
    code, full = F.col("code"), F.size(_full_lines())
    density = F.size("comments") / full
    steps, obvious = (F.size(F.filter("comments", lambda c: c.rlike(p))) for p in (STEP, OBVIOUS))  # noqa: B023
    functions, documented = count(code, FUNCTION), count(code, DOCSTRING) + count(code, BLOCK_COMMENT)
    flags = F.when(density > 0.25, F.least(F.lit(1.5), (density - 0.25) * 6)).otherwise(0.0)
    flags = flags + F.when(steps >= 2, 1.0).otherwise(0.0) + F.when(obvious >= 2, F.least(F.lit(1.5), obvious * 0.3)).otherwise(0.0)
    return result("C-01", flags + F.when((functions >= 3) & (documented >= functions), 0.8).otherwise(0.0), full >= 8)


def identifiers(code: Column) -> Column:
    first, second = every(code, NAMED, 1), every(code, NAMED, 2)
    return F.array_distinct(F.zip_with(first, second, lambda a, b: F.when(F.coalesce(a, F.lit("")) != "", a).otherwise(b)))


@register("C-02")
def naming() -> Column:
    names = identifiers(F.col("code"))

    def dictionary(name: Column) -> Column:
        parts = F.filter(F.split(F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2")), "_+", -1), lambda p: p != "")
        return (F.size(parts) >= 2) & F.forall(parts, lambda p: (F.length(p) >= 4) & ~p.isin(*SHORT_NAMES))

    return result("C-02", F.size(F.filter(names, dictionary)) / F.size(names), F.size(names) >= 6)


@register("C-03")
def boilerplate() -> Column:
    code = F.col("code")
    broad, emoji = count(code, CATCH_ALL), count(code, EMOJI_LOG)
    flags = F.when(code.rlike(MAIN), 0.8).otherwise(0.0) + F.when(broad >= 2, F.least(F.lit(1.2), broad * 0.4)).otherwise(0.0)
    return result("C-03", flags + F.least(F.lit(1.5), emoji * 0.5), F.size("lines") >= 8)


@register("C-04")
def style() -> Column:
    indents = F.filter(F.transform("lines", lambda x: F.regexp_extract(x, INDENT, 1)), lambda x: x != "")
    tabs = F.size(F.filter(indents, lambda x: x.contains("\t")))
    mixed = (tabs > 0) & (tabs < F.size(indents))
    loose = F.exists("lines", lambda x: x.rlike(LOOSE_END) | (F.length(x) > 100))
    placed = F.filter(F.transform("lines", lambda x, i: F.when(x.rlike(FUNCTION_LINE), i)), lambda i: i.isNotNull())
    n = F.greatest(F.size(placed) - 1, F.lit(0))
    gaps = F.zip_with(F.slice(placed, F.lit(1), n), F.slice(placed, F.lit(2), n), lambda a, b: (b - a).cast("double"))
    flags = F.when(~mixed & ~loose, 0.8).otherwise(0.0) + F.when((F.size(placed) >= 4) & (cv(gaps) < 0.25), 0.8).otherwise(0.0)
    return result("C-04", flags, F.size("lines") >= 20)


@register("C-05")
def chat_markers() -> Column:
    return result("C-05", count(F.col("code"), js("|".join(rules.CHAT_MARKERS), "i")))
