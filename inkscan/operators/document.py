"""D-01 to D-04 over a parsed document's text and its ``meta`` struct."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkscan.functions.regexlib import FOLDED_BOUNDARY, count, js
from inkscan.operators.base import add_up, register, result

META = (
    "struct<format:string,author:string,creator:string,producer:string,application:string,created:string,modified:string,totalTimeMin:double,"
    "revisions:int,styles:array<string>,rsids:int,fonts:array<string>,colors:array<string>,htmlFragments:int>"
)
# Programs that generate documents, styles of pasted pages, fonts of chats.
GENERATORS = r"(?i)python-docx|reportlab|pandoc|wkhtmltopdf|microsoft print to pdf|chrome|skia/pdf|headless|puppeteer|weasyprint|docx\.js|openxml sdk|fpdf|tcpdf|html2pdf|jspdf|pdfkit|latex|chatgpt|openai|claude|gemini"
WEB_STYLES = r"(?iu)normal \(web\)|html|обычный \(веб\)"
CHAT_FONTS = rf"(?iu)söhne|sohne|ui-sans-serif|segoe ui|-apple-system|inter{FOLDED_BOUNDARY}"
LEFT_MARKDOWN = js(r"\*\*[^*\n]+\*\*|^#{1,6}\s", "m")


def _meta(field: str) -> Column:
    return F.col(f"meta.{field}")


def _given(field: str) -> Column:
    return F.coalesce(_meta(field) != "", F.lit(False))


@register("D-01")
def metadata() -> Column:
    fields = ["creator", "producer", "application", "author"]
    named = add_up([F.when(F.coalesce(_meta(f).rlike(GENERATORS), F.lit(False)), 1.5).otherwise(0.0) for f in fields])
    none = ~(_given("creator") | _given("producer") | _given("application") | _given("author"))
    same = _given("created") & _given("modified") & (_meta("created") == _meta("modified"))
    return result("D-01", named + F.when(none, 0.5).otherwise(0.0) + F.when(same, 0.5).otherwise(0.0), ~_meta("format").isin("txt", "md"))


@register("D-02")
def edit_time() -> Column:
    pace = F.col("n_words") / F.greatest(F.lit(1.0), _meta("totalTimeMin"))
    extra = F.when((_meta("revisions") <= 2) & (pace > 40), 50.0).otherwise(0.0)
    return result("D-02", pace + extra, _meta("format").isin("docx", "odt") & _meta("totalTimeMin").isNotNull() & (F.col("n_words") >= 100))


@register("D-03")
def paste() -> Column:
    at_once = F.when((_meta("format") == "docx") & (_meta("rsids") <= 1), 1.5).otherwise(0.0)
    plain = F.when((F.size(_meta("styles")) <= 1) & (F.size(_meta("fonts")) <= 1), 0.7).otherwise(0.0)
    return result("D-03", at_once + plain, _meta("format").isin("docx", "odt") & (F.col("n_words") >= 150))


@register("D-04")
def chat_format() -> Column:
    marks = F.least(F.lit(1.5), count(F.col("text"), LEFT_MARKDOWN) * 0.3)
    web = F.exists(_meta("styles"), lambda s: s.rlike(WEB_STYLES)).cast("int")
    font = F.exists(_meta("fonts"), lambda s: s.rlike(CHAT_FONTS)).cast("int")
    return result("D-04", marks + web + (_meta("htmlFragments") > 0).cast("int") + font, ~_meta("format").isin("txt", "md"))
