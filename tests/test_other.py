"""Files, images, code, documents and sessions."""

import io
from datetime import datetime
import struct
import zipfile
import zlib

import numpy as np
from pyspark.sql import functions as F

from inkscan.operators import image
from inkscan.operators.base import REGISTRY
from inkscan.plans import analyze
from inkscan.sources import files
from inkscan.streaming.sessions import recheck_stream

BODY = "<w:document xmlns:w='u'><w:body>" + "<w:p w:rsidR='01'><w:pPr><w:pStyle w:val='a1'/></w:pPr><w:r><w:rPr><w:rFonts w:ascii='Segoe UI'/></w:rPr><w:t>Hello there</w:t></w:r></w:p>" * 2 + "</w:body></w:document>"


def archive(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/") + ".xml", text)
    return out.getvalue()


def png():
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1024, 1024, 8, 2, 0, 0, 0)) + chunk(b"tEXt", b"parameters\0steps: 20") + chunk(b"IEND", b"")


def test_files(spark, tmp_path):
    styles = "<w:styles xmlns:w='u'><w:style w:styleId='a1'><w:name w:val='Normal (Web)'/></w:style></w:styles>"
    made = {
        "a.docx": archive(word__document=BODY, word__styles=styles, docProps__core="<c xmlns:d='x'><d:creator>python-docx</d:creator><d:revision>1</d:revision></c>", docProps__app="<p><TotalTime>2</TotalTime></p>"),
        "b.odt": archive(content="<o xmlns:t='u'><t:h>Head</t:h><t:p>Text one</t:p></o>", meta="<m xmlns:x='u'><x:generator>Office</x:generator><x:editing-duration>PT1H2M</x:editing-duration></m>"),
        "c.rtf": rb"{\rtf1{\fonttbl{\f0 Arial;}}{\info{\author Ann}}Hello \'ef\u1080 ?\par Second}", "d.txt": b"\xef\xbb\xbfone\r\ntwo", "e.png": png(), "f.jpg": b"\xff\xd8broken", "g.docx": b"no zip", "h.py": b"import os\n", "i.xyz": b"?",
        "j.jpg": b"\xff\xd8\xff\xdb\x00\x43\x00" + bytes(min(255, max(1, int((v * 50 + 50) // 100))) for v in image.LUMA) + b"\xff\xc0\x00\x0b\x08" + struct.pack(">HH", 64, 128) + b"\x01\x01\x11\x00\xff\xd9",
    }
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    df = files.read_files(spark, str(tmp_path)).cache()
    r = {x.path.rpartition("/")[2]: x for x in df.collect()}
    assert {k: x.status for k, x in r.items() if x.status != "ok"} == {"g.docx": "invalid", "i.xyz": "unsupported"}
    a = r["a.docx"]
    assert a.text == "Hello there\n\nHello there" and a.meta.author == "python-docx" and a.meta.styles == ["Normal (Web)"] and a.meta.rsids == 1 and a.meta.totalTimeMin == 2
    assert r["b.odt"].text == "Text one\n\nHead" and r["b.odt"].meta.totalTimeMin == 62 and r["c.rtf"].text == "Hello пи\n\nSecond" and r["c.rtf"].meta.author == "Ann"
    assert r["d.txt"].text == "one\ntwo" and r["h.py"].kind == "code" and r["e.png"].image.width == 1024 and r["j.jpg"].image.height == 64
    found = df.where("kind = 'image'").withColumn("lang", F.lit("en")).select("path", *(REGISTRY[d]().alias(d) for d in ("I-01", "I-02", "I-03", "I-06"))).collect()
    by = {x.path.rpartition("/")[2]: x for x in found}
    assert by["e.png"]["I-02"].score == 1 and by["e.png"]["I-03"].score == 1 and by["j.jpg"]["I-06"].value == 1.0 and by["e.png"]["I-01"].value == 0
    reports = {x.path.rpartition("/")[2]: x for x in analyze.analyze_documents(df.where("kind = 'document'"), ["path"]).collect()}
    assert any(c.category == "metadata" and c.score > 50 for c in reports["a.docx"].categories)


def test_pixels(spark):
    rng = np.random.default_rng(0)
    noise = np.dstack([rng.integers(0, 256, (128, 128, 3)), np.full((128, 128), 255)]).astype(np.uint8)
    flat = np.full((128, 128, 4), 128, dtype=np.uint8)
    rows = [(1, (128, 128, bytearray(noise.tobytes()))), (2, (128, 128, bytearray(flat.tobytes()))), (3, (16, 16, bytearray(16 * 16 * 4))), (4, None)]
    df = spark.createDataFrame(rows, "id int, pixels struct<width:int,height:int,data:binary>").withColumn("lang", F.lit("en"))
    r = {x.id: x for x in df.select("id", *(REGISTRY[d]().alias(d) for d in ("I-04", "I-05", "I-07"))).collect()}
    assert r[2]["I-05"].score == 1 and r[1]["I-05"].value < 0.1 and 0.2 < r[1]["I-07"].value < 0.6
    assert not r[3]["I-05"].applicable and not r[4]["I-04"].applicable and r[1]["I-04"].score < 1


def test_code(spark):
    ai = '# Step 1: import the module\nimport os\n\n# Step 2: define the function\n' + "".join(f'def load_user_{n}(first_value):\n    """Do it."""\n    # create the list\n    result_value = 0\n    return result_value\n\n' for n in ("alpha", "bravo", "delta", "gamma")) + "# Example usage:\nif __name__ == '__main__':\n    main()\n"
    human = "import os\nx=1\ndef f(a):\n  return a+1 \ny = f(x)\nfor i in range(3):\n\tprint(i)\nz=2\nw=3\nq=4\nprint(y)\n"
    r = {x.id: x for x in analyze.analyze_code(spark.createDataFrame([(1, ai), (2, human), (3, ""), (4, None)], "id int, code string"), ["id"]).collect()}
    assert r[1].score > r[2].score and len(r) == 4
    from inkscan.operators.code import language, looks_like_code

    df = spark.createDataFrame([("def f():\n  pass", "x"), ("const a = 1;", "x"), ("plain words", "a.rs"), ("plain words", "x")], "c string, n string")
    assert [x[0] for x in df.select(language(F.col("c"), F.col("n"))).collect()] == ["python", "javascript", "rust", "unknown"]
    assert [x[0] for x in spark.createDataFrame([(ai,), ("Some prose.\nMore of it.\nAnd more.",)], "c string").select(looks_like_code(F.col("c"))).collect()] == [True, False]


def test_sessions(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("s", datetime(2024, 5, 1, 10), True, "It is crucial to delve into the vibrant tapestry of robust realms. " * 10)], "session_id string, at timestamp, fresh boolean, text string").coalesce(1).write.mode("append").json(f"{tmp_path}/in/a")
    stream = spark.readStream.schema("session_id string, at timestamp, fresh boolean, text string").option("recursiveFileLookup", "true").json(f"{tmp_path}/in")
    query = recheck_stream(stream).writeStream.format("memory").queryName("versions").option("checkpointLocation", f"{tmp_path}/cp").start()
    query.processAllAvailable()
    spark.createDataFrame([("s", datetime(2024, 5, 1, 10, 5), False, "I went home yesterday. Huh! My dog (a big one) ate it... Why? Nobody knows, honestly, we tried. " * 10)], "session_id string, at timestamp, fresh boolean, text string").coalesce(1).write.mode("append").json(f"{tmp_path}/in/b")
    query.processAllAvailable()
    query.stop()
    r = spark.table("versions").orderBy("version").collect()
    assert [x.version for x in r] == [1, 2] and r[0].score_before is None and r[1].score_before == r[0].score and "L-01" in r[1].closed.split(",")
