"""Files as rows: documents (docx, odt, rtf, txt, md), images' metadata, and code.

``spark.read.format("binaryFile")`` deals the files out; each file is parsed in a task.  A file
that cannot be parsed is a row with a status, never an error.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkscan.operators.code import BY_EXTENSION
from inkscan.operators.document import META

DOCUMENTS, IMAGES, LARGEST = ("docx", "odt", "rtf", "txt", "md"), ("jpg", "jpeg", "png", "webp"), 20 * 1024 * 1024
IMAGE = "struct<format:string,width:int,height:int,exif:map<string,string>,xmp:string,png_text:map<string,string>,c2pa:boolean,issuers:array<string>,ai_claim:boolean,quant:array<array<int>>>"
PLACES = "array<struct<start:int,end:int,paragraph:int,page:int>>"
SCHEMA = f"path string, kind string, status string, text string, places {PLACES}, meta {META}, image {IMAGE}"
# EXIF tags, and who may sign a manifest.
EXIF_TAGS = {0x010F: "Make", 0x0110: "Model", 0x0131: "Software", 0x0132: "DateTime", 0x013B: "Artist", 0x8298: "Copyright", 0x010E: "ImageDescription", 0x9003: "DateTimeOriginal", 0xA434: "LensModel", 0x829A: "ExposureTime", 0x8827: "ISO"}
ISSUERS = ("Adobe Firefly", "Adobe", "OpenAI", "DALL-E", "ChatGPT", "Google", "Microsoft", "Midjourney", "Stability", "Leica", "Nikon", "Canon", "Sony", "Truepic")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)\z", 1))


def kind_of(path: Column) -> Column:
    """document, image or code by the extension; null for any other."""
    ext = extension(path)
    return F.when(ext.isin(*DOCUMENTS), "document").when(ext.isin(*IMAGES), "image").when(ext.isin(*BY_EXTENSION), "code")


def _blank(kind: str) -> dict:
    return {"format": kind, "author": None, "creator": None, "producer": None, "application": None, "created": None, "modified": None, "totalTimeMin": None, "revisions": None, "styles": [], "rsids": 0, "fonts": [], "colors": [], "htmlFragments": 0}


def _name(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _attribute(e: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


def _first(root: ElementTree.Element | None, name: str) -> str | None:
    found = next((e.text for e in root.iter() if _name(e) == name and e.text and e.text.strip()), None) if root is not None else None
    return found.strip() if found else None


def _part(z: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    return ElementTree.fromstring(z.read(name)) if name in z.namelist() else None


def assemble(paragraphs: list[tuple[str, int]]) -> tuple[str, list[dict]]:
    """Paragraphs (text, page) joined by blank lines, and where each that isn't blank stands in the text."""
    kept = [(t, page) for t, page in paragraphs if t.strip()]
    places, at = [], 0
    for i, (t, page) in enumerate(kept):
        places.append({"start": at, "end": at + len(t), "paragraph": i + 1, "page": page})
        at += len(t) + 2
    return "\n\n".join(t for t, _ in kept), places


def docx(data: bytes) -> tuple[str, list[dict], dict]:
    """Paragraphs of the body with their pages, with edit sessions, styles, fonts and properties."""
    z, meta = zipfile.ZipFile(io.BytesIO(data)), _blank("docx")
    body, core, app, styles = (_part(z, n) for n in ("word/document.xml", "docProps/core.xml", "docProps/app.xml", "word/styles.xml"))
    names = {_attribute(s, "styleId"): next((_attribute(n, "val") for n in s if _name(n) == "name"), None) for s in (styles.iter() if styles is not None else ()) if _name(s) == "style"}
    texts, page, seen = [], 1, {k: set() for k in ("rsid", "style", "font", "color")}
    for e in body.iter():
        kind = _name(e)
        if kind in ("p", "r") and (r := _attribute(e, "rsidR")):
            seen["rsid"].add(r)
        if kind == "rFonts":
            seen["font"] |= {f for k in ("ascii", "hAnsi") if (f := _attribute(e, k))}
        if kind == "color" and (c := _attribute(e, "val")):
            seen["color"].add(c)
        meta["htmlFragments"] += kind == "altChunk"
        if kind == "p":
            style = next((_attribute(s, "val") for s in e.iter() if _name(s) == "pStyle"), None) or "Normal"
            seen["style"].add(names.get(style) or style)
            page += sum(_name(n) == "lastRenderedPageBreak" or _name(n) == "br" and _attribute(n, "type") == "page" for n in e.iter())
            texts.append(("".join({"t": n.text or "", "tab": "\t"}.get(_name(n), "") for n in e.iter()), page))
    meta |= {"author": _first(core, "creator") or _first(core, "lastModifiedBy"), "created": _first(core, "created"), "modified": _first(core, "modified"), "application": _first(app, "Application")}
    revision, minutes = _first(core, "revision"), _first(app, "TotalTime")
    meta |= {"revisions": int(revision) if revision else None, "totalTimeMin": float(minutes) if minutes else None, "rsids": len(seen["rsid"]), "styles": sorted(seen["style"]), "fonts": sorted(seen["font"]), "colors": sorted(seen["color"])}
    return *assemble(texts), meta


def odt(data: bytes) -> tuple[str, list[dict], dict]:
    """All paragraphs, then all headings, with the generator and the editing time."""
    z, meta = zipfile.ZipFile(io.BytesIO(data)), _blank("odt")
    body, info = _part(z, "content.xml"), _part(z, "meta.xml")
    blocks = [e for kind in ("p", "h") for e in body.iter() if _name(e) == kind]
    meta |= {"styles": sorted({_attribute(e, "style-name") or "Standard" for e in blocks}), "author": _first(info, "initial-creator") or _first(info, "creator"), "created": _first(info, "creation-date"), "modified": _first(info, "date")}
    meta["creator"] = meta["application"] = _first(info, "generator")
    meta["fonts"] = sorted({f for e in body.iter() if _name(e) == "font-face" and (f := _attribute(e, "name"))})
    if m := re.fullmatch(r"PT(?:(\d+)H)?(?:(\d+)M)?(?:([\d.]+)S)?", _first(info, "editing-duration") or ""):
        meta["totalTimeMin"] = int(m[1] or 0) * 60 + int(m[2] or 0) + float(m[3] or 0) / 60
    cycles = _first(info, "editing-cycles")
    meta["revisions"] = int(cycles) if cycles else None
    return *assemble([("".join(e.itertext()), 1) for e in blocks]), meta


def rtf(data: bytes) -> tuple[str, list[dict], dict]:
    """A pass over the tokens that keeps a stack of groups; groups of tables and pictures are left out."""
    source, meta = data.decode("latin-1"), _blank("rtf")
    info = {k: m[1].strip() for k in ("author", "generator") if (m := re.search(rf"\\{k} ([^;{{}}]*)", source))}
    meta |= {"author": info.get("author"), "application": info.get("generator"), "fonts": sorted(set(re.findall(r"\\f\d+[^{};]* ([^{};\\]+);", source)))}
    out, stack, skip, left = [], [], False, 0
    for m in re.finditer(r"\\u(-?\d+) ?|\\'([0-9a-fA-F]{2})|\\([a-z]+)(-?\d+)? ?|\\(.)|([{}])|[\r\n]+|(.)", source, re.S):
        unicode, byte, word, _, sign, brace, char = m.groups()
        if brace == "{":
            stack.append(skip)
        elif brace:
            skip = stack.pop() if stack else False
        elif word in ("fonttbl", "colortbl", "stylesheet", "info", "pict", "themedata", "generator") or sign == "*":
            skip = True
        elif skip:
            continue
        elif unicode:
            out.append(chr(int(unicode) % 65536))
            left = 1
        elif left and (byte or char):  # the stand-in for a character given by number
            left = 0
        elif byte:
            out.append(bytes.fromhex(byte).decode("cp1251", "replace"))
        elif word in ("par", "line"):
            out.append("\n")
        elif word == "tab":
            out.append("\t")
        elif sign in ("{", "}", "\\"):
            out.append(sign)
        elif char:
            out.append(char)
    # characters beyond the first plane come as two numbers
    text = "".join(out).encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
    return *assemble([(p.strip(), 1) for p in text.split("\n")]), meta


def plain(data: bytes, kind: str) -> tuple[str, list[dict], dict]:
    """The text as it is; its places are the blocks between blank lines."""
    text = data.decode("utf-8", "replace").removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    places, at = [], 0
    for block in re.split(r"(\n\s*\n)", text):
        if block.strip():
            places.append({"start": at, "end": at + len(block), "paragraph": len(places) + 1, "page": 1})
        at += len(block)
    return text, places, _blank(kind)


def exif(data: bytes) -> dict[str, str]:
    """Known tags of the first directory and its sub-directory."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    out: dict[str, str] = {}
    if order is None or len(data) < 8:
        return out

    def directory(at: int, depth: int) -> None:
        if depth > 2 or at + 2 > len(data):
            return
        for k in range(struct.unpack_from(order + "H", data, at)[0]):
            e = at + 2 + 12 * k
            if e + 12 > len(data):
                return
            tag, kind, n = struct.unpack_from(order + "HHI", data, e)
            size = {2: 1, 3: 2, 4: 4, 5: 8}.get(kind, 0) * n
            where = e + 8 if size <= 4 else struct.unpack_from(order + "I", data, e + 8)[0]
            if tag == 0x8769:
                directory(struct.unpack_from(order + "I", data, e + 8)[0], depth + 1)
            elif tag in EXIF_TAGS and size and where + size <= len(data):
                if kind == 2:
                    out[EXIF_TAGS[tag]] = data[where : where + n].split(b"\0")[0].decode("utf-8", "replace")
                elif kind == 5:
                    top, bottom = struct.unpack_from(order + "II", data, where)
                    out[EXIF_TAGS[tag]] = f"{top}/{bottom}"
                else:
                    out[EXIF_TAGS[tag]] = str(struct.unpack_from(order + {3: "H", 4: "I"}[kind], data, where)[0])

    directory(struct.unpack_from(order + "I", data, 4)[0], 0)
    return out


def image(data: bytes) -> dict:
    """Size, EXIF, XMP, text chunks, quantisation tables and signs of a manifest; raises for other formats."""
    out = {"format": None, "width": None, "height": None, "exif": {}, "xmp": "", "png_text": {}, "quant": []}
    if data[:2] == b"\xff\xd8":
        out["format"], at = "jpeg", 2
        while at + 4 <= len(data) and data[at] == 0xFF:
            kind, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            if kind == 0xE1 and body[:6] == b"Exif\0\0":
                out["exif"] = exif(body[6:])
            elif kind == 0xE1 and b"xap/1.0" in body[:40]:
                out["xmp"] += body.decode("utf-8", "replace")
            elif kind == 0xDB:
                while body:
                    wide = body[0] >> 4
                    out["quant"].append(list(struct.unpack_from(">64H" if wide else "64B", body, 1)))
                    body = body[1 + 64 * (1 + wide) :]
            elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                out["height"], out["width"] = struct.unpack_from(">HH", body, 1)
            elif kind == 0xDA:
                break
            at += 2 + size
    elif data[:8] == b"\x89PNG\r\n\x1a\n":
        out["format"], at = "png", 8
        while at + 8 <= len(data):
            size, kind = struct.unpack_from(">I4s", data, at)
            body = data[at + 8 : at + 8 + size]
            if kind == b"IHDR":
                out["width"], out["height"] = struct.unpack_from(">II", body)
            elif kind in (b"tEXt", b"zTXt", b"iTXt"):
                key, _, rest = body.partition(b"\0")
                if kind == b"zTXt":
                    rest = zlib.decompress(rest[1:])
                elif kind == b"iTXt":
                    packed, rest = rest[0], rest[2:].split(b"\0", 2)[2]
                    rest = zlib.decompress(rest) if packed else rest
                out["png_text"][key.decode("latin-1")] = rest.decode("utf-8", "replace")
            elif kind == b"eXIf":
                out["exif"] = exif(body)
            at += 12 + size
        out["xmp"] = out["png_text"].get("XML:com.adobe.xmp", "")
    elif data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        out["format"], at = "webp", 12
        while at + 8 <= len(data):
            kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            body = data[at + 8 : at + 8 + size]
            if kind == b"VP8X":
                out["width"], out["height"] = (int.from_bytes(body[k : k + 3], "little") + 1 for k in (4, 7))
            elif kind == b"VP8 " and out["width"] is None:
                out["width"], out["height"] = (struct.unpack_from("<H", body, k)[0] & 0x3FFF for k in (6, 8))
            elif kind == b"VP8L" and out["width"] is None:
                bits = int.from_bytes(body[1:5], "little")
                out["width"], out["height"] = (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
            elif kind == b"EXIF":
                out["exif"] = exif(body.removeprefix(b"Exif\0\0"))
            elif kind == b"XMP ":
                out["xmp"] = body.decode("utf-8", "replace")
            at += 8 + size + size % 2
    else:
        raise ValueError("not an image")
    low = data.lower()
    out["c2pa"] = b"c2pa" in low or b"jumb" in low
    out["issuers"] = [i for i in ISSUERS if out["c2pa"] and i.lower().encode() in low]
    out["ai_claim"] = out["c2pa"] and (b"trainedalgorithmicmedia" in low or b"compositesynthetic" in low)
    return out


def parse_one(path: str, content: bytes) -> dict:
    """A row of ``SCHEMA``."""
    ext = (re.search(r"\.([A-Za-z0-9]+)$", path) or ["", ""])[1].lower()
    row = {"path": path, "kind": None, "status": "ok", "text": None, "places": None, "meta": None, "image": None}
    if len(content) > LARGEST:
        return row | {"status": "too_large"}
    try:
        if ext in DOCUMENTS:
            read = {"docx": docx, "odt": odt, "rtf": rtf}.get(ext, lambda d: plain(d, ext))
            text, places, meta = read(content)
            return row | {"kind": "document", "text": text, "places": places, "meta": meta}
        if ext in IMAGES:
            return row | {"kind": "image", "image": image(content)}
    except Exception:  # whatever a broken file does to a parser, it is that file's status
        return row | {"status": "invalid"}
    if ext in BY_EXTENSION:
        return row | {"kind": "code", "text": content.decode("utf-8", "replace")}
    return row | {"status": "unsupported"}


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, status, text, places, meta, image) of every file under ``path``."""
    return parse_files(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def parse_files(files: DataFrame) -> DataFrame:
    """As ``read_files``, of the columns path and content.

    Where ``length`` is there too, as Spark's reader of binary files gives it, a file that is too large is never read.
    """

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([parse_one(p, bytes(c)) for p, c in zip(frame["path"], frame["content"], strict=True)], columns=["path", "kind", "status", "text", "places", "meta", "image"])

    if "length" not in files.columns:
        return files.select("path", "content").mapInPandas(parse, SCHEMA)
    parsed = files.where(F.col("length") <= LARGEST).select("path", "content").mapInPandas(parse, SCHEMA)
    large = files.where(F.col("length") > LARGEST).select("path", F.lit("too_large").alias("status"))
    return parsed.unionByName(large, allowMissingColumns=True)
