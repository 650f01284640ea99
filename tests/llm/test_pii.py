import hashlib
import math
import random
import re
import time

from pyspark.sql import functions as F

from inkscan.llm import pii


def brute(text):
    text = text or ""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0:
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(out)]


def texts():
    draw = random.Random(3)
    parts = ["a@b.c", "x.y@", "@", ".", "é🚀", " ", "-", "1", "25", "256", "10.0.0.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 12345-678", "+1", "a", "+", "(", "00", "378282246310005", "b.com", "%"]
    return [None, "", "a@b.cd+x@e.f", "1.2.3.4.5.6.7.8", "000255.01.1.1 99999999999.1.1.1", "a" * 50_000 + "@", "1 " * 20_000, "1-" * 9 + "x", "a." * 20_000 + "@b.c", *("".join(draw.choices(parts, k=draw.randint(1, 25))) for _ in range(400))]


def test_patterns(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(2, "a@b.c", "again"), (None, "a@b.c", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = pii.digests(df).collect()
    assert len(got) == len(rows)
    want = sorted(((i, hashlib.sha256(",".join(brute(t)).encode()).hexdigest()) for i, t, _ in rows), key=repr)
    assert sorted(((r.doc_id, r.base_sha256) for r in got), key=repr) == want
    for r in got:
        assert sum((r.n_email, r.n_ip, r.n_card, r.n_phone, r.n_term)) == len(r.spans.split(",") if r.spans else [])
    assert pii.digests(df.where("false")).collect() == []


def test_terms_that_reveal(spark):
    filler = [f"plain words number {'abcdefghij'[i % 10]} go here and there" for i in range(300)]
    known = [f"the {'abcdefgh'[i]}lpha office of Zanzibaro writes from zed@corp.example and here again" for i in range(8)]
    rows = list(enumerate(filler + known + ["someone else is at other@corp.example and here"]))
    got = {r.doc_id: r for r in pii.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(300, 308):
        start = rows[i][1].index("Zanzibaro")
        assert f"term:{start}:{start + 9}" in got[i].spans.split(",") and got[i].n_email == 1
        assert not any(s.startswith(f"term:{rows[i][1].index('here')}:") for s in got[i].spans.split(","))
    assert got[308].n_term == 0 and all(got[i].spans == "" for i in range(300))


def test_masked(spark):
    df = spark.createDataFrame([(1, "é a@b.c, then +49 30 1234 5678."), (2, "none"), (3, None), (4, "4111111111111111@b.c")], "doc_id long, text string")
    got = {r.doc_id: r.m for r in pii.find(df, ["doc_id"]).withColumn("m", pii.masked(F.col("text"), F.col("spans"))).collect()}
    assert got == {1: "é [EMAIL], then [PHONE].", 2: "none", 3: None, 4: "[EMAIL]"}


def test_terms_far_from_the_mention(spark):
    """Co-occurrence is per document; a flagged term is marked wherever it stands, also where the address doesn't."""
    pad = "plain words go here and there " * 10
    rows = [f"{pad} number {'abcdefghij'[i % 10]}" for i in range(300)]
    rows += [f"Zanzibaro {pad} {'abcdefgh'[i]}lpha mail zed@corp.example {'abcdefgh'[i]} {pad}\nyours, ZANZIBARO" for i in range(8)]
    rows += [f"É🚀 Zanzibaro {pad}", f"{pad} mail twice@corp.example once and {pad} again twice@corp.example solitary"]
    df = spark.createDataFrame([*enumerate(rows), (300, rows[300])], "doc_id long, text string")
    got = pii.find(df, ["doc_id"]).withColumn("m", pii.masked(F.col("text"), F.col("spans"))).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        want = {(m.start(), m.end()) for m in re.finditer("zanzibaro", r.text, re.IGNORECASE)}
        assert want <= {(s.start, s.end) for s in r.spans if s.kind == "term"} and "zanzibaro" not in r.m.lower(), r.doc_id
    # one document alone supports nothing
    assert all("solitary" in r.m for r in got if r.doc_id == 309)
    assert all(r.m == r.text for r in got if r.doc_id < 300)


def brute_terms(rows, window=80, support=2, disclosure=0.9):
    """The words that disclose an entity, by dictionaries over (id, text)."""
    docs = [(i, t or "") for i, t in rows]
    words = [{w.lower() for w in re.findall(r"[^\W_]+", t)} for _, t in docs]
    held = {}
    for n, (_, t) in enumerate(docs):
        for s in brute(t):
            kind, a, b = s.split(":")
            a, b = int(a), int(b)
            held.setdefault(f"{kind}:{t[a:b].lower()}", {}).setdefault(n, set()).add(t[max(a - window, 0) : b + window])
    out = set()
    for places in held.values():
        by_doc = {n: tuple(sorted(x)) for n, x in places.items()}
        if len(set(by_doc.values())) < support or len(by_doc) >= len(docs):
            continue
        rest = {}
        for n in by_doc:
            t = docs[n][1]
            for s in sorted((tuple(map(int, s.split(":")[1:])) for s in brute(t)), reverse=True):
                t = t[: s[0]] + " " + t[s[1] :]
            for w in {w.lower() for w in re.findall(r"[^\W_]+", t)}:
                rest.setdefault(w, []).append(n)
        bits = math.log2(len(docs) / len(by_doc))
        for w, ns in rest.items():
            if len(w) > 1 and len({by_doc[n] for n in ns}) >= support:
                of_term = max(sum(w in x for x in words), len(ns))
                if math.log2(len(docs) * len(ns) / len(by_doc) / of_term) >= disclosure * bits:
                    out.add(w)
    return out


def test_terms_as_brute_force(spark):
    draw = random.Random(11)
    people = [(f"user{i}@corp{i % 3}.example", f"Name{'abcdefghij'[i]}", f"Town{'abcde'[i % 5]}") for i in range(10)]
    plain = ["plain", "words", "go", "here", "and", "there", "again", "office", "mail"]
    rows = []
    for i in range(240):
        t = draw.choices(plain, k=draw.randint(5, 40))
        if draw.random() < 0.4:
            mail, name, town = draw.choice(people)
            for x in (mail, name, town) if draw.random() < 0.8 else (name,):
                t.insert(draw.randint(0, len(t)), x)
        rows.append((i, " ".join(t)))
    rows += [(300, None), (301, ""), (302, "café 10.0.0.1 élan"), (303, "10.0.0.1 other élan"), (304, "élan 10.0.0.1 more")]
    got = {r.t for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).selectExpr("explode(filter(spans, s -> s.kind = 'term')) s", "text").selectExpr("lower(substring(text, s.start + 1, s.end - s.start)) t").collect()}
    want = brute_terms(rows)
    assert got == want and len(want) > 5


def test_many_matches_in_one_text(spark):
    """A text of forty thousand addresses costs about as much per address as a short one, found and masked."""
    n = 40_000
    text = " ".join(f"u{i}@h.ex" for i in range(n))
    df = spark.createDataFrame([(1, text), (2, "é" * 700 + " a@b.c 10.0.0.1 " + "🚀" * 300)], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in pii.find(df, ["doc_id"]).select("doc_id", F.size("base").alias("n"), pii.masked(F.col("text"), F.col("spans")).alias("m"), "spans").collect()}
    assert time.time() - began < 90
    assert got[1].n == n and got[1].m == " ".join(["[EMAIL]"] * n)
    at = [m.start() for m in re.finditer("u", text)]
    assert [s.start for s in got[1].spans] == at
    assert got[2].m == "é" * 700 + " [EMAIL] [IP] " + "🚀" * 300


def test_masking_overlaps(spark):
    """Spans within and across each other become one of the first one's kind, wherever blocks of the text end."""
    text = "".join(chr(97 + i % 26) for i in range(1000))
    spans = [(0, 2), (250, 300), (255, 257), (256, 310), (310, 311), (511, 513), (600, 900), (700, 720), (899, 950), (999, 1000)]
    want, at = [], 0
    for a, b in spans:
        want += [text[at:a], "#"] if a >= at else []
        at = max(at, b)
    column = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in spans))
    got = spark.createDataFrame([(text,)], "text string").select(pii.masked(F.col("text"), column, lambda s: F.lit("#")).alias("m")).first().m
    assert got == "".join(want) + text[at:]
