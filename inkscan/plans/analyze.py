"""The whole analysis of a table of texts, documents, images or code: one report per row, without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkscan.operators import academic, code, document, image, lexical, rhythm, scoring, stats, structure, typography  # noqa: F401  (they register)
from inkscan.operators.base import SPECS, as_rows, per_detector, registered
from inkscan.functions.regexlib import blank, held
from inkscan.operators.code import looks_like_code, with_code_context
from inkscan.operators.findings import evidence, marker_hints
from inkscan.operators.ngram import with_perplexity
from inkscan.plans.context import with_context

LONGEST = 100_000
TEXT = [d for d, s in SPECS.items() if s.kind == "text"]
DOCUMENT = ["D-01", "D-02", "D-03", "D-04"]
CODE = [d for d, s in SPECS.items() if s.kind == "code"]
IMAGE = [d for d, s in SPECS.items() if s.kind == "image"]
#: Detectors without Python and without a model.
NATIVE_TEXT = [d for d in TEXT if d not in ("P-01", "P-02")]


def status(text: str = "text"):
    """ok, empty or too_long; lengths count UTF-16 units."""
    n = F.length(text) + F.regexp_count(F.col(text), F.lit(r"[\x{10000}-\x{10FFFF}]"))
    return F.when(F.coalesce(blank(F.col(text)), F.lit(True)), "empty").when(n > LONGEST, "too_long").otherwise("ok")


def detect(df: DataFrame, keep: list[str], ids: list[str] | None = None, model: tuple[DataFrame, int] | None = None) -> DataFrame:
    """``keep``, lang, text, sents and a result column per detector of the texts in ``text``.

    A parsed document's ``meta`` goes along; one of format md is markdown, where T-05 doesn't apply.
    """
    ids = registered("text") if ids is None else ids
    extra = ["meta"] if "meta" in df.columns else []
    markdown = F.coalesce(F.col("meta.format") == "md", F.lit(False)) if extra else None
    out = with_context(df.select(*dict.fromkeys([*keep, "text"]), *extra), markdown=markdown)
    if "P-01" in ids:
        none = F.struct(F.lit(0.0).alias("value"), F.lit(False).alias("applicable"), F.lit(0.0).alias("score"))
        out = out.withColumn("P-01", none) if model is None else with_perplexity(out, *model)
    own = [d for d in ids if d != "P-01"]
    # families one after another, so no generated method grows too large
    for family in dict.fromkeys(d[0] for d in own):
        out = out.select("*", *per_detector([d for d in own if d[0] == family]))
    return out.select(*dict.fromkeys([*keep, "lang", "text", "sents", "mixed_share", *extra]), *(f"`{d}`" for d in ids))


def detector_rows(results: DataFrame, keep: list[str], ids: list[str]) -> DataFrame:
    """The long form: a row per document and detector."""
    return results.select(*keep, F.explode(as_rows(ids)).alias("r")).select(*keep, "r.*")


def report(results: DataFrame, keep: list[str], ids: list[str], kind: str = "text", ui_lang: str = "en") -> DataFrame:
    """``keep``, score, verdict, confidence, categories, advice, metrics and warnings.

    Advice on marker phrases holds what may stand in their place.  What the results give is computed once (``held``), so
    the columns can be unnested and filtered; filters on ``keep`` belong before the analysis.
    """
    length = F.length("text") if kind in ("text", "document") else None
    warnings = F.array_compact(F.array(F.when(F.length("text") < 300, "short_text"))) if length is not None else F.array().cast("array<string>")
    none = F.expr("cast(array() as array<struct<phrase:string,options:array<string>>>)")
    hints = marker_hints(F.col("text"), ui_lang) if "L-01" in ids else none
    said = F.when(F.col("`L-01`.score") >= 0.35, hints).otherwise(none) if "L-01" in ids else none
    scored = results.select("*", held(scoring.logit(ids, kind)).alias("z"), held(scoring.rows_of(ids, kind, ui_lang)).alias("_rows"), said.alias("_hints")).select("*", scoring.as_score(F.col("z")).alias("score"))
    rows = F.col("_rows")
    advised = F.transform(scoring.advice(rows, F.col("z")), lambda a: a.withField("hints", F.when(a["rule"] == "L-01.markers", F.col("_hints")).otherwise(none)))
    return scored.select(
        *keep, "score", scoring.verdict(F.col("score")).alias("verdict"), scoring.confidence(rows, kind, length).alias("confidence"),
        scoring.categories(rows).alias("categories"), advised.alias("advice"), scoring.metrics(rows).alias("metrics"), warnings.alias("warnings"),
    )


def analyze(df: DataFrame, keep: list[str], ids: list[str] | None = None, model: tuple[DataFrame, int] | None = None, proofs: bool = False) -> DataFrame:
    """Reports of the texts that can be analysed; the others are ``rejected``.  Without a model P-01 is not applicable.

    ``ids`` are the detectors, by default all text detectors that are registered when the plan is built.

    With ``proofs`` a report also holds its findings (spans of the text) and a heat per sentence.
    """
    ids = registered("text") if ids is None else ids
    results = detect(df.where(status() == "ok"), keep, ids, model)
    if not proofs:
        return report(results, keep, ids)
    proven = evidence(results.withColumn("overall", scoring.combine(ids)), ids)
    return report(proven, [*keep, "findings", "sentences"], ids)


def rejected(df: DataFrame, keep: list[str]) -> DataFrame:
    return df.select(*keep, status().alias("status")).where("status <> 'ok'")


def analyze_code(df: DataFrame, keep: list[str], code: str = "code", name: str | None = None) -> DataFrame:
    ctx = with_code_context(df, code, name)
    return report(ctx.select(*keep, "lang", *per_detector(CODE)), keep, CODE, "code")


def analyze_images(df: DataFrame, keep: list[str]) -> DataFrame:
    """Reports of images: ``image`` holds the metadata, ``pixels`` (width, height, data as RGBA) the decoded image where there is one."""
    pixels = F.col("pixels") if "pixels" in df.columns else F.lit(None).cast("struct<width:int,height:int,data:binary>")
    ctx = df.select(*keep, "image", pixels.alias("pixels"), F.lit("en").alias("lang"))
    return report(ctx.select(*keep, "lang", *per_detector(IMAGE)), keep, IMAGE, "image")


def document_results(df: DataFrame, keep: list[str], model: tuple[DataFrame, int] | None = None) -> DataFrame:
    """Results of the text detectors and D-01 to D-05, which is the text's own score."""
    share = scoring.combine(TEXT) / 100
    own = F.struct(share.alias("value"), F.lit(True).alias("applicable"), share.alias("score"))
    return detect(df, keep, [*TEXT, *DOCUMENT], model).withColumn("D-05", own)


def analyze_documents(df: DataFrame, keep: list[str], model: tuple[DataFrame, int] | None = None) -> DataFrame:
    """Reports of parsed documents (text, meta)."""
    return report(document_results(df, keep, model), keep, [*TEXT, *DOCUMENT, "D-05"], "document")


def analyze_pasted(df: DataFrame, keep: list[str], model: tuple[DataFrame, int] | None = None) -> DataFrame:
    """(keep, kind and a report's columns) of texts without a file: what looks like source code is analysed as code."""
    code_like = F.coalesce(looks_like_code(F.col("text")), F.lit(False))
    df = df.select(*keep, "text").withColumn("kind", F.when(code_like, "code").otherwise("text"))
    texts = analyze(df.where("kind = 'text'"), [*keep, "kind"], model=model)
    return texts.unionByName(analyze_code(df.where("kind = 'code'").withColumnRenamed("text", "code"), [*keep, "kind"]))


def analyze_files(files: DataFrame, model: tuple[DataFrame, int] | None = None) -> DataFrame:
    """(path, kind, status and a report's columns) of what ``read_files`` gives; what can't be analysed has a status and no report."""
    said = F.when((F.col("status") == "ok") & (F.col("kind") == "document"), status()).otherwise(F.col("status"))
    df, keep = files.withColumn("status", said), ["path", "kind", "status"]
    good = df.where("status = 'ok'")
    reports = analyze_documents(good.where("kind = 'document'"), keep, model)
    reports = reports.unionByName(analyze_code(good.where("kind = 'code'").select(*keep, F.col("text").alias("code")), keep, name="path"))
    reports = reports.unionByName(analyze_images(good.where("kind = 'image'"), keep))
    return reports.unionByName(df.where("status <> 'ok'").select(*keep), allowMissingColumns=True)
