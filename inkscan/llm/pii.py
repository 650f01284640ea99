"""Personal data: patterns, and terms that reveal a protected entity.

Patterns find e-mail addresses, IP addresses, card and phone numbers.  Each distinct value is a
protected entity.  The corpus then says how strongly the words of the texts that mention it reveal
it: with P(e) the share of documents that hold the entity and P(e|t) the share among documents that
hold the term, the term discloses log2(P(e|t) / P(e)) of the log2(1 / P(e)) bits that name the entity.
Terms that disclose at least ``DISCLOSURE`` of them, in documents with at least ``SUPPORT`` different
surroundings of the entity, are spans wherever they stand, in all texts.  DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkscan.functions.regexlib import cutter, let, running, running_sum, spans_of
from inkscan.llm.shared import cut

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: Code points around a mention that make its surroundings; different surroundings that a term needs; share of the bits.
WINDOW, SUPPORT, DISCLOSURE = 80, 2, 0.9
#: Rows up to which a table of terms is sent to all tasks; a larger one is shuffled.
SENT_ROWS = 100_000

# The first three as in the contract, but possessive, and begun only where a run of their characters
# begins or the last match ended: the same matches in linear time, without recursion.  A card's chain of
# fewer than 14 digits is never a match, so the least number stands in the pattern.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WORD = r"[\p{L}\p{N}]+"
NO_SPANS = "cast(array() as array<struct<start:int,place:int,kind:string,end:int,value:string>>)"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.reverse(_digits(value))

    def worth(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda total, i: total + worth(i)) % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p) <= "255")))
    if kind == "card":
        return n.between(14, 19) & _luhn(value)
    return n.between(10, 15) if kind == "phone" else F.lit(True)


def matches(text: Column, pattern: str) -> Column:
    """Every match as (start, end, label), in code points, end exclusive; costs n log n in the matches."""
    return spans_of(text, pattern)


def base_spans(text: Column) -> Column:
    """(start, place, kind, end, value) of all that the patterns find, by start and then kind."""
    text = F.coalesce(text, F.lit(""))
    each = []
    for place, kind in enumerate(KINDS):
        found = F.filter(matches(text, PATTERNS[kind]), lambda m: _passes(kind, m["label"]))  # noqa: B023
        spans = F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(place).alias("place"), F.lit(kind).alias("kind"), m["end"].alias("end"), m["label"].alias("value")))  # noqa: B023
        may = {"email": text.contains("@"), "phone": text.contains("+")}.get(kind, text.rlike("[0-9]"))
        each.append(F.when(may, spans).otherwise(F.expr(NO_SPANS)))
    return F.array_sort(F.concat(*each))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _send(small: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(small) if rows <= SENT_ROWS else small.hint("merge")


def words_of(text: Column) -> Column:
    """The distinct words, lower-cased."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower))


def term_spans(text: Column, terms: Column) -> Column:
    """A span for every occurrence of one of ``terms``; words and what lies between them alternate, and their lengths are added up."""
    parts = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"), F.lit(0))

    def placed(parts: Column) -> Column:
        ends = running_sum(F.transform(parts, lambda p: F.length(p)))
        spans = F.zip_with(ends, parts, lambda e, p: F.when(F.array_contains(terms, F.lower(p)), F.struct((e - F.length(p)).alias("start"), F.lit(len(KINDS)).alias("place"), F.lit(TERM).alias("kind"), e.alias("end"), F.lit("").alias("value"))))
        return F.array_compact(spans)

    return let(parts, placed)


def revealing_terms(documents: DataFrame, found: DataFrame, window: int, support: int, disclosure: float) -> DataFrame:
    """(term): the words that reveal an entity of ``found`` (key, text, spans), by all of ``documents`` (text)."""
    one = cut(found.groupBy("key").agg(F.first("text").alias("text"), F.first("spans").alias("spans"), F.count("*").alias("copies")))
    total = documents.count()
    def mentions(piece: Callable[[Column, Column], Column]) -> Column:
        around = lambda s: piece(F.greatest(s["start"] - window, F.lit(0)), s["end"] + window)
        return F.transform("spans", lambda s: F.struct(F.concat_ws(":", s["kind"], F.lower(s["value"])).alias("entity"), F.xxhash64(around(s)).alias("around")))

    mention = one.select("key", "copies", F.explode(cutter(F.col("text"), mentions)).alias("m")).select("key", "copies", "m.*")
    # a document is one surrounding of an entity, however often it holds it
    held = mention.groupBy("key", "entity").agg(F.first("copies").alias("copies"), F.xxhash64(F.array_sort(F.collect_set("around"))).alias("around"))
    entities = cut(held.groupBy("entity").agg(F.sum("copies").alias("of_entity"), F.countDistinct("around").alias("n")).where((F.col("n") >= support) & (F.col("of_entity") < total)).drop("n"))
    by_key = cut(held.join(_send(entities, entities.count()), "entity").select("key", "entity", "around", "of_entity"))
    keys = cut(by_key.select("key").distinct())
    # words of the text without the entities themselves
    rest = masked(F.col("text"), F.col("spans"), lambda s: F.lit(" "))
    words = one.join(_send(keys, keys.count()), "key").select("key", "copies", F.explode(words_of(rest)).alias("term")).where(F.length("term") > 1)
    words = cut(words)
    # a term of one document is never supported; the others are counted in all documents
    terms = cut(words.groupBy("term").agg(F.count("*").alias("keys")).where(F.col("keys") >= support).select("term"))
    said, rows = documents.select(F.explode(words_of(F.col("text"))).alias("term")), terms.count()
    # a large table of terms meets counts, not words
    said = said.join(F.broadcast(terms), "term") if rows <= SENT_ROWS else said
    counts = cut(said.groupBy("term").agg(F.count("*").alias("of_term")).join(terms, "term", "left_semi"))
    all_ = F.lit(float(max(total, 2)))
    bits = F.log2(all_ / F.col("of_entity"))
    # an entity is in no more of a term's documents than it is in itself: most words are too common for most entities
    may = F.log2(all_ * F.least("of_entity", "of_term") / F.col("of_entity") / F.col("of_term")) >= disclosure * bits - 1e-9
    met = words.join(_send(counts, counts.count()), "term").join(by_key, "key").where(may)
    both = met.groupBy("entity", "term").agg(F.first("of_entity").alias("of_entity"), F.first("of_term").alias("of_term"), F.countDistinct("around").alias("around"), F.sum("copies").alias("of_both"))
    tell = F.log2(all_ * F.col("of_both") / F.col("of_entity") / F.greatest("of_term", "of_both"))
    return both.where((F.col("around") >= support) & (bits > 0) & (tell >= disclosure * bits)).select("term").distinct()


def find(documents: DataFrame, keep: list[str], window: int = WINDOW, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """``keep``, text, base (the patterns' spans) and spans (with the terms') for every document.

    A null text counts as empty.  Rows of equal id and text have equal spans; every input row gives a
    row.  A term's span that lies in a pattern's, as all others, stays beside it.
    """
    df = documents.select(*(F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text").alias("key"))
    may = F.coalesce(F.col("text").rlike("[0-9@]"), F.lit(False))
    with_base = df.where(may).withColumn("base", base_spans(F.col("text")))
    # texts that hold something, found once
    found = cut(with_base.where(F.size("base") > 0).select("key", "text", F.col("base").alias("spans")))
    flagged = cut(revealing_terms(df.select("text"), found, window, support, disclosure))
    said = df.select("key", F.explode(words_of(F.col("text"))).alias("term")).join(_send(flagged, flagged.count()), "term")
    terms = cut(said.groupBy("key").agg(F.collect_set("term").alias("terms")))
    every = with_base.unionByName(df.where(~may).withColumn("base", F.expr(NO_SPANS))).join(_send(terms, terms.count()), "key", "left")
    spans = F.when(F.col("terms").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", term_spans(F.col("text"), F.col("terms")))))
    return every.select(*(F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)), F.col("text"), "base", spans.alias("spans"))


def digests(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, the number of spans of each kind, base_sha256, spans, n_term."""
    df = find(documents, ["doc_id"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return df.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count(TERM).alias("n_term"))


def bracketed(span: Column) -> Column:
    return F.concat(F.lit("["), F.upper(span["kind"]), F.lit("]"))


def masked(text: Column, spans: Column, put: Callable[[Column], Column] = bracketed) -> Column:
    """``text`` with each of the sorted spans replaced by its kind in brackets; spans that overlap become one, of the first one's kind."""

    def replaced(spans: Column) -> Column:
        # what the spans before a span cover ends at the greatest of their ends
        reach = running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b), F.lit(0))
        before = F.slice(F.concat(F.array(F.lit(0)), reach), F.lit(1), F.size(spans))
        heads = F.filter(F.zip_with(before, spans, lambda at, s: F.struct(at.alias("at"), s.alias("s"))), lambda x: x["s"]["start"] >= x["at"])
        whole = lambda piece: F.concat(
            F.array_join(F.transform(heads, lambda x: F.concat(piece(x["at"], x["s"]["start"]), put(x["s"]))), ""), piece(F.element_at(reach, -1), F.length(text))
        )
        return cutter(text, whole)

    return F.when(F.size(spans) > 0, let(spans, replaced)).otherwise(text)
