"""Registered queries of operators whose input the tables don't hold: files, images and metadata built from each row."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkscan.functions.regexlib import held, let
from inkscan.operators import evaluate, findings, image, scoring
from inkscan.operators.base import REGISTRY
from inkscan.operators.catalog import catalog
from inkscan.operators.code import looks_like_code
from inkscan.operators.document import META
from inkscan.plans import analyze
from inkscan.plans.context import sentence_places
from inkscan.sources import files
from inkscan.sources.corpora import from_wide

FIVE = ["R-01", "R-02", "R-03", "T-03", "L-05"]
RU = (
    " Её ёлка ещё стоит, и ее брат нашел твердый счёт. Важно отметить, что комплексный подход играет ключевую роль в современном мире."
    " Таким образом, уникальный опыт, его отчёт и учет в целом позволяет значительно расти. В заключение добавим: самолет летит вперед.\n"
)
LISTED = "\n- **Speed**: it runs\n- Price: it is low\n- plain item here\n1. **Scope:** all of it\n2) nothing here\n"
SAID = " Smith argued that. Jones (2020) showed it, and Mary Miller noted so. Brown observed this. It is a seminal, nuanced work, and this paper argues for a paradigm shift."
CITED = [
    " It holds [1, p. 3-5] [2] [3; 4, p. 90] [5].\nReferences\n1. Smith A. First book. 200 p.\n2. Jones B. Second book.\n3. Miller C. Third. 40 p.\n4. Brown D. Fourth. 80 p.",
    " It holds [1, p. 30-50] [2, p. 70] [2, p. 5] [1] [2].\nReferences\n1. Smith A. First book. 20 p.\n2. Jones B. Second book. 60 p.",
    " It holds [1] [2] [3].\nReferences\n1. Smith A. First book. 200 p.",
    " It holds [1, p. 1-2] [1, p. 3-4] [1, p. 5-6] [1, p. 7-8] [1, p. 9-10] [1, p. 11] [1].",
]
_FILL = "plain words stand here and more follow them " * 12
SECTIONS = "".join(f"\n# Part {n}\n{_FILL}**bold {n}** or **more** and [{k}, p. 4] end." for n, k in (("one", 1), ("two", 2), ("three", 3)))
CODE = """
# Step 1: import the module
import os
# Step 2: define the loader
def load_items(first_name, other):
    # create the list
    user_total = 0
    item_count = 1
    try:
        order_value = user_total
    except Exception as e:
        print("🚀 failed")
    except Exception:
        final_result = None
    x = 2
    return user_total
def save_items(first_name):
    return first_name
# Example usage:
if __name__ == "__main__":
    main()
"""
QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _texts(spark: SparkSession, sf_dir: str, add: str = "") -> DataFrame:
    from inkscan.queries import texts

    return texts(spark, sf_dir, add)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from inkscan.queries import table

    return table(spark, sf_dir, name)


def _flat(results: DataFrame, keep: list[str], ids: list[str]) -> DataFrame:
    return results.select(*keep, *(F.round(f"{d}.{x}", 6).alias(f"{d[0].lower()}{d[2:]}_{x}") for d in ids for x in ("value", "score")))


def _one(name: str, found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.round(f"{name}.value", 6).alias("value"), F.col(f"{name}.applicable").alias("applicable"), F.round(f"{name}.score", 6).alias("score"))


def _joined(items, *parts):
    return F.array_join(F.transform(items, lambda x: F.concat_ws("/", *(p(x) for p in parts))), ",")


def _to_15_digits(x):
    """As SQL rounds: scaled in doubles.  From 2^52 on there is no fraction to round."""
    return F.when(x * 1e15 < float(1 << 52), F.floor(x * 1e15 + 0.5).cast("double")).otherwise(x * 1e15) / F.lit(1e15)


def _five(df: DataFrame) -> DataFrame:
    """Reports of values and scores to 15 digits, as in their SQL: a last digit decides where a score lies on a border."""
    results = analyze.detect(df.where(analyze.status() == "ok"), ["doc_id"], FIVE)
    exact = lambda d: F.struct(_to_15_digits(F.col(d)["value"]).alias("value"), F.col(d)["applicable"].alias("applicable"), _to_15_digits(F.col(d)["score"]).alias("score"))
    return analyze.report(results.select("doc_id", "lang", "text", "sents", "mixed_share", *(exact(f"`{d}`").alias(d) for d in FIVE)), ["doc_id"], FIVE)


def _told(r: DataFrame, units: float = 1000.0, scores: bool = True) -> DataFrame:
    """A report's columns as text; gains and priorities in whole parts of 1, of which there are ``units``; categories with or without their scores."""
    parts = lambda x: F.floor(x * units + 0.5).cast("string")
    advice = lambda items: _joined(items, lambda a: a["rule"], lambda a: a["severity"], lambda a: a["effort"].cast("string"), lambda a: parts(a["gain"]), lambda a: parts(a["priority"]), lambda a: F.array_join(a["detectors"], "+"))
    return r.select(
        "doc_id", "score", "verdict", F.col("confidence.value").alias("confidence"), F.col("confidence.level").alias("level"), F.array_join("confidence.reasons", ",").alias("reasons"),
        _joined(F.col("categories"), lambda c: c["category"], *([lambda c: c["score"].cast("string")] if scores else []), lambda c: F.array_join(c["detectors"], "+")).alias("categories"),
        advice(F.col("advice")).alias("advice"), F.array_join(F.transform(scoring.top_advice(F.col("advice"), 2), lambda a: a["rule"]), ",").alias("top_advice"),
        _joined(F.col("metrics"), lambda m: m["detector"], lambda m: m["inside"].cast("string")).alias("metrics"), F.array_join("warnings", ",").alias("warnings"),
    )


@query
def five_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole reports by five detectors: score, confidence, categories, advice with a combination, and metrics."""
    return _told(_five(_texts(spark, sf_dir)))


@query
def native_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole reports by all text detectors that SQL has a form of (all but P-02), with a model trained on the texts."""
    from inkscan.operators import ngram

    df, ids = _texts(spark, sf_dir), [d for d in analyze.TEXT if d != "P-02"]
    return _told(analyze.analyze(df, ["doc_id"], ids, ngram.train(df, min_count=3)), 1e6, scores=False)


@query
def five_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the added passage changes in those reports."""
    from inkscan.queries import ADDED

    d = scoring.diff(_five(_texts(spark, sf_dir)), _five(_texts(spark, sf_dir, ADDED)), "doc_id")
    return d.select("doc_id", "score_before", "score_after", *(F.array_join(F.array_sort(c), ",").alias(c) for c in ("closed", "opened", "remaining")), F.size("metrics").cast("long").alias("n_moved"))


@query
def native_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the added passage changes in the reports of all text detectors but P-01 and P-02."""
    from inkscan.queries import ADDED

    before, after = (analyze.analyze(_texts(spark, sf_dir, add), ["doc_id"], [d for d in analyze.TEXT if d[0] != "P"]) for add in ("", ADDED))
    d = scoring.diff(before, after, "doc_id")
    return d.select("doc_id", "score_before", "score_after", *(F.array_join(F.array_sort(c), ",").alias(c) for c in ("closed", "opened", "remaining")), F.size("metrics").cast("long").alias("n_moved"))


@query
def dash_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of dashes in the texts where they are a finding."""
    from inkscan.queries import ADDED

    return findings.finding_spans(analyze.detect(_texts(spark, sf_dir, ADDED), ["doc_id"], ["T-03"]), ["doc_id"], ["T-03"]).select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "label")


@query
def proven_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports with their findings and sentence heat, and what an editor would highlight."""
    from inkscan.queries import ADDED

    ids = ["T-03", "L-01", "S-02", "S-06"]
    r = analyze.analyze(_texts(spark, sf_dir, ADDED), ["doc_id"], ids, proofs=True)
    hot = F.size(F.filter("sentences", lambda s: s["heat"] >= 0.2)).cast("long")
    shown = F.size(findings.shown(["T-03", "L-01"])).cast("long")
    return r.select("doc_id", "score", F.size("findings").cast("long").alias("n_findings"), F.size("sentences").cast("long").alias("n_sentences"), hot.alias("n_hot"), shown.alias("n_shown"))


@query
def t06_ru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one("T-06", analyze.detect(_russian(spark, sf_dir), ["doc_id"], ["T-06"]))


@query
def l01_ru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one("L-01", analyze.detect(_russian(spark, sf_dir), ["doc_id"], ["L-01"]))


def _russian(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text followed by a Russian passage, often enough to make it a Russian text."""
    return _texts(spark, sf_dir).withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.expr(f"repeat('{RU}', cast(1 + length(coalesce(text, '')) div 150 as int))")))


@query
def s04_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one("S-04", analyze.detect(_texts(spark, sf_dir, LISTED), ["doc_id"], ["S-04"]))


@query
def l07_said(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one("L-07", analyze.detect(_texts(spark, sf_dir, SAID), ["doc_id"], ["L-07"]))


@query
def b01_cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of four passages with references after every text, by its id."""
    add = F.element_at(F.array(*map(F.lit, CITED)), (F.col("doc_id") % 4 + 1).cast("int"))
    return _one("B-01", analyze.detect(_texts(spark, sf_dir).withColumn("text", F.concat(F.coalesce("text", F.lit("")), add)), ["doc_id"], ["B-01"]))


@query
def s08_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one("S-08", analyze.detect(_texts(spark, sf_dir, SECTIONS), ["doc_id"], ["S-08"]))


@query
def rejected_built(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth text blank, every hundredth repeated until it is too long."""
    df = _texts(spark, sf_dir)
    text = F.when(F.col("doc_id") % 10 == 0, "\n\t  \n").when(F.col("doc_id") % 100 == 1, F.expr("repeat(concat(coalesce(text, ''), ' x'), cast(100000 div (length(coalesce(text, '')) + 2) + 1 as int))")).otherwise(F.col("text"))
    return analyze.rejected(df.withColumn("text", text), ["doc_id"])


@query
def document_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-01 to D-04, with metadata that depend on the id."""
    i = "doc_id"
    meta = F.expr(f"""cast(struct(
        element_at(array('docx', 'odt', 'rtf', 'txt', 'md'), cast({i} % 5 + 1 as int)) as format, if({i} % 2 = 0, 'Ann', null) as author,
        case {i} % 3 when 0 then 'python-docx' when 1 then 'Writer' end as creator, null as producer, null as application, '2024-01-01' as created,
        if({i} % 4 = 0, '2024-01-01', '2024-02-01') as modified, if({i} % 11 = 0, null, cast({i} % 7 as double)) as totalTimeMin, cast({i} % 4 as int) as revisions,
        if({i} % 6 = 0, array('Normal (Web)'), array('A', 'B')) as styles, cast({i} % 3 as int) as rsids, if({i} % 2 = 1, array('Arial'), array('Segoe UI', 'X')) as fonts,
        array() as colors, cast(if({i} % 9 = 0, 1, 0) as int) as htmlFragments) as {META})""")
    return _flat(analyze.detect(_texts(spark, sf_dir, " **bold**").withColumn("meta", meta), ["doc_id"], analyze.DOCUMENT), ["doc_id"], analyze.DOCUMENT)


@query
def image_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-01 to I-03 and I-06, of metadata that depend on the id; every other table of an image is a standard one."""
    i, ids = "doc_id", ["I-01", "I-02", "I-03", "I-06"]
    luma = ", ".join(map(str, image.LUMA))
    standard = f"transform(array({luma}), v -> cast(least(255, greatest(1, floor((v * (case when {i} % 100 + 1 < 50 then 5000 / ({i} % 100 + 1) else 200 - 2 * ({i} % 100 + 1) end) + 50) / 100))) as int))"
    meta = F.expr(f"""cast(struct(
        element_at(array('jpeg', 'png', 'webp'), cast({i} % 3 + 1 as int)) as format, cast(element_at(array(512, 1024, 640, 777), cast({i} % 4 + 1 as int)) as int) as width,
        cast(element_at(array(512, 1792, 1000, 64, 0), cast({i} % 5 + 1 as int)) as int) as height,
        if({i} % 2 = 0, map('Make', 'Canon'), map('Software', if({i} % 7 = 0, 'Midjourney v6', 'Editor'))) as exif, if({i} % 13 = 0, 'a TrainedAlgorithmicMedia b', '') as xmp,
        if({i} % 5 = 0, map('parameters', 'steps: 20', 'Comment', 'sampler x'), cast(map() as map<string,string>)) as png_text, {i} % 4 = 0 as c2pa,
        if({i} % 8 = 0, array('OpenAI'), array()) as issuers, {i} % 12 = 0 as ai_claim, array(if({i} % 6 = 3, {standard}, array_repeat(7, 64))) as quant) as {files.IMAGE})""")
    df = _table(spark, sf_dir, "documents").select("doc_id", meta.alias("image"), F.lit("en").alias("lang"))
    return _flat(df.select("doc_id", *(REGISTRY[d]().alias(d) for d in ids)), ["doc_id"], ids)


@query
def pixel_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-04, I-05 and I-07 of an image whose pixels are the bytes of a text, over and over."""
    ids = ["I-04", "I-05", "I-07"]
    data = F.expr("cast(substring(repeat(concat('x', coalesce(text, '')), cast(16384 div (length(coalesce(text, '')) + 1) + 1 as int)), 1, 16384) as binary)")
    px = F.struct(F.lit(64).alias("width"), F.lit(64).alias("height"), F.substring(data, 1, 16384).alias("data"))
    df = _texts(spark, sf_dir).select("doc_id", px.alias("pixels"), F.lit("en").alias("lang"))
    return _flat(df.select("doc_id", *(REGISTRY[d]().alias(d) for d in ids)), ["doc_id"], ids)


@query
def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a file of a page's name would be; every page gets one of ten endings."""
    ends = ["docx", "ODT", "rtf", "txt", "md", "jpeg", "WebP", "py", "rs", "exe"]
    path = F.concat(F.coalesce("url", F.lit("")), F.lit("."), F.element_at(F.array(*map(F.lit, ends)), (F.col("page_id") % 10 + 1).cast("int")))
    return _table(spark, sf_dir, "pages").select("page_id", files.extension(path).alias("ext"), files.kind_of(path).alias("kind"))


def _zip(**parts: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/") + ".xml", text)
    return out.getvalue()


def _document(kind: str, lines: list[str]) -> bytes:
    if kind == "docx":
        body = "".join(f"<w:p><w:r><w:t>{escape(x)}</w:t></w:r>{'<w:r><w:br w:type=\"page\"/></w:r>' if i == 0 else ''}</w:p>" for i, x in enumerate(lines))
        return _zip(word__document=f"<w:document xmlns:w='u'><w:body>{body}</w:body></w:document>", docProps__core="<c xmlns:d='x'><d:creator>Ann</d:creator></c>")
    if kind == "odt":
        return _zip(content="<o xmlns:t='u'>" + "".join(f"<t:p>{escape(x)}</t:p>" for x in lines) + "</o>")
    if kind == "rtf":
        def coded(c: str) -> str:
            if c in "\\{}":
                return "\\" + c
            return c if c < "\x80" else "".join(f"\\u{int.from_bytes(u, 'little', signed=True)}?" for u in (c.encode("utf-16-le")[k : k + 2] for k in range(0, len(c.encode("utf-16-le")), 2)))

        return ("{\\rtf1{\\fonttbl{\\f0 Arial;}}" + "\\par ".join("".join(map(coded, x)) for x in lines) + "}").encode("latin-1")
    return "\r\n\r\n".join(lines).encode()


@query
def parsed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a file of one of four formats, parsed again: its paragraphs are the text's lines."""
    kinds = ["docx", "odt", "rtf", "txt"]

    @F.pandas_udf("binary")
    def made(kind: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([_document(k, [x for x in t.split("\n") if x.strip()]) for k, t in zip(kind, text, strict=True)], dtype=object)

    kind = F.element_at(F.array(*map(F.lit, kinds)), (F.col("doc_id") % 4 + 1).cast("int"))
    clean = F.regexp_replace("text", r"[\x00-\x08\x0B-\x1F\x{FFFE}\x{FFFF}]", " ")
    df = _texts(spark, sf_dir, "\nlast line").select(F.concat(F.col("doc_id").cast("string"), F.lit("."), kind).alias("path"), made(kind, clean).alias("content"))
    p = files.parse_files(df)
    end = F.element_at("places", -1)
    return p.select(
        F.regexp_extract("path", r"^(-?\d+)\.", 1).cast("long").alias("doc_id"), F.col("meta.format").alias("format"), "status", F.md5(F.col("text").cast("binary")).alias("text_md5"),
        F.size("places").cast("long").alias("n_places"), (end["end"] == F.length("text")).alias("ends_with_text"), end["page"].cast("long").alias("page"),
    )


@query
def parsed_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A PNG, JPEG or WebP with a size, a program and a quantisation table from each id, parsed again."""

    @F.pandas_udf("binary")
    def made(ids: pd.Series) -> pd.Series:
        def one(i: int) -> bytes:
            w, h, name = 16 + i % 1000, 8 + i % 700, f"Maker {i}".encode() + b"\0"
            tags = b"II*\0\x08\0\0\0\x01\0" + struct.pack("<HHII", 0x0131, 2, len(name), 26) + b"\0\0\0\0" + name
            if i % 3 == 0:
                chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
                packed = chunk(b"zTXt", b"prompt\0\0" + zlib.compress(f"seed {i}".encode()))
                return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + packed + chunk(b"eXIf", tags) + (chunk(b"caBX", b"jumb c2pa OpenAI trainedAlgorithmicMedia") if i % 2 else b"") + chunk(b"IEND", b"")
            if i % 3 == 1:
                part = lambda k, b: b"\xff" + bytes([k]) + struct.pack(">H", len(b) + 2) + b
                return b"\xff\xd8" + part(0xE1, b"Exif\0\0" + tags) + part(0xDB, b"\0" + bytes([1 + i % 200] * 64)) + part(0xC0, b"\x08" + struct.pack(">HH", h, w) + b"\x01\x01\x11\0") + b"\xff\xd9"
            chunks = b"VP8X" + struct.pack("<I", 10) + b"\0\0\0\0" + (w - 1).to_bytes(3, "little") + (h - 1).to_bytes(3, "little") + b"EXIF" + struct.pack("<I", len(tags)) + tags + b"\0" * (len(tags) % 2)
            return b"RIFF" + struct.pack("<I", len(chunks) + 4) + b"WEBP" + chunks

        return pd.Series([one(int(i)) for i in ids], dtype=object)

    name = F.element_at(F.array(F.lit("png"), F.lit("jpg"), F.lit("webp")), (F.col("doc_id") % 3 + 1).cast("int"))
    df = _table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit("."), name).alias("path"), made("doc_id").alias("content"))
    i = F.col("image")
    return files.parse_files(df).select(
        F.regexp_extract("path", r"^(\d+)\.", 1).cast("long").alias("doc_id"), "status", i["format"].alias("format"), i["width"].cast("long").alias("width"), i["height"].cast("long").alias("height"),
        F.element_at(i["exif"], "Software").alias("software"), F.element_at(i["png_text"], "prompt").alias("prompt"), i["c2pa"].alias("c2pa"), i["ai_claim"].alias("ai_claim"), F.array_join(i["issuers"], ",").alias("issuers"),
        F.get(F.get(i["quant"], F.lit(0)), F.lit(0)).cast("long").alias("first_quant"),
    )


@query
def pasted_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a turn, every third with lines of code after it, is taken for source code."""
    add = F.when(F.col("turn") % 3 == 0, "\nimport os\nx = f(1)\nreturn x;\n").otherwise("\nplain words\n")
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", looks_like_code(F.concat(F.coalesce("text", F.lit("")), add)).alias("is_code"))


@query
def held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC, FPR and TPR by language and by source; text length stands for a score."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    df = docs.join(_table(spark, sf_dir, "labels"), "doc_id").withColumn("label", F.col("quality") == 1).withColumn("score", F.col("n_chars").cast("double"))
    r = evaluate.held_out_report(df, "score", "label", ["lang", "source"], 1000)
    return r.select("grouping", "member", "n", *(F.round(c, 6).alias(c) for c in ("auc", "fpr", "tpr")))


@query
def whole_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One figure over all labelled rows, without a group."""
    df = _table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(_table(spark, sf_dir, "labels"), "doc_id").withColumn("label", F.col("quality") == 1)
    return evaluate.roc_auc(df.withColumn("score", F.col("n_chars").cast("double")), "score", "label").select(F.round("auc", 6).alias("auc"))


@query
def dataset_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of 400 to 4000 characters, one of those that begin alike, every fifth of a language for tests."""
    some = evaluate.dedupe_by_prefix(evaluate.of_length(_table(spark, sf_dir, "documents").select("doc_id", "lang", "text")), "doc_id")
    return evaluate.stratified_split(some.drop("text"), ["lang"], ["doc_id"]).select("doc_id", "lang", "is_test")


@query
def wide_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with columns for people and two models as samples; the columns are made from each text."""
    df = _texts(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("human"), F.concat(F.lit("m1 "), "text").alias("m1"), F.concat("text", F.lit(" m2")).alias("m2"))
    long = from_wide(df, "human", ["m1", "m2"], "en", F.col("id"))
    return long.select("source", "lang", "ai", "model", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query
def bias_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit of the bias by language; the logarithm of a text's length stands for its logit."""
    df = _table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(_table(spark, sf_dir, "labels").where("quality = 1"), "doc_id")
    return evaluate.bias_limit(df.withColumn("z", F.log(F.col("n_chars") + 1.0)), "z", ["lang"], 1.0).select("lang", F.round("bias", 6).alias("bias"))


@query
def session_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a session of a stream, every turn, a minute after the one before it, as a version: what five detectors find, and what changed."""
    from inkscan.functions.lineage import shared_path
    from inkscan.streaming.sessions import recheck_stream, store_history

    schema = spark.read.parquet(f"{sf_dir}/conversations.parquet").schema
    # a pattern stands for a file and for a folder of files alike
    turns = spark.readStream.schema(schema).parquet(f"{sf_dir}/conversations.parque[t]")
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" Plain words follow."))
    stream = turns.select(F.col("conv_id").cast("string").alias("session_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn").cast("long") * 60).alias("at"), (F.col("turn") == 0).alias("fresh"), text.alias("text"))
    path = shared_path(spark, "versions")
    store_history(recheck_stream(stream, ids=FIVE), path, f"{path}-progress", once=True).awaitTermination()
    return spark.read.parquet(path).select("session_id", "version", "score", "score_before", "closed", "opened")


@query
def rules_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark).select("id", "category", "kind", "weight", "metric", "direction", F.array_join("rules", ",").alias("rules"))


@query
def native_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per text and detector, of all text detectors that SQL has a form of (all but P-02)."""
    from inkscan.operators import ngram

    df, ids = _texts(spark, sf_dir), [d for d in analyze.TEXT if d != "P-02"]
    rows = analyze.detector_rows(analyze.detect(df, ["doc_id"], ids, ngram.train(df, min_count=3)), ["doc_id"], ids)
    return rows.select("doc_id", "id", "category", F.round("value", 6).alias("value"), "applicable", F.round("score", 6).alias("score"))


@query
def paragraph_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of sentences of each text, and where the last one ends, in code points."""
    found = let(sentence_places(F.coalesce(F.col("text"), F.lit(""))), lambda p: F.struct(F.size(p).cast("long").alias("n"), F.try_element_at(p, F.lit(-1))["end"].cast("long").alias("last_end")))
    return _texts(spark, sf_dir).select("doc_id", held(found).alias("found")).select("doc_id", "found.n", "found.last_end")


@query
def code_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-01 to C-05 over every turn with a passage of Python after it."""
    from inkscan.operators.code import with_code_context

    df = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.coalesce("text", F.lit("")), F.lit(CODE)).alias("code"))
    ctx = with_code_context(df).select("conv_id", "turn", "language", *(REGISTRY[d]().alias(d) for d in analyze.CODE))
    return _flat(ctx, ["conv_id", "turn", "language"], analyze.CODE)
