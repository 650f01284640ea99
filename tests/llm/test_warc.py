import base64
import hashlib
import random

from inkscan.llm import warc


def brute(rows):
    top, seen = {}, []
    for i, _, html in rows:
        raw = (html or "").encode()
        d = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        seen.append((i, len(raw), d))
        if i is not None:
            top[d] = max(top.get(d, i), i)
    return sorted(((i, n, d, "revisit" if i is not None and i < top[d] else "response", top[d] if i is not None and i < top[d] else None) for i, n, d in seen), key=repr)


def test_round_trip(spark):
    draw = random.Random(1)
    bodies = [None, "", "<html>é🚀</html>", "a\r\n\r\nWARC/1.1\r\nb: c\r\n\r\n", "\r\n\r\n", "x" * 300_000, *(f"<p>{i}</p>" for i in range(30))]
    urls = [None, "", "http://a.example.org/x?y", "http://a.example.org/x", "nothing", "http://b.com/line\nend\r", "https://É.net/"]
    rows = [(i, draw.choice(urls), draw.choice(bodies)) for i in range(150)]
    rows += [(149, rows[149][1], rows[149][2]), (3, "http://q", "<p>1</p>"), (None, None, None), (None, "u", "<p>5</p>"), (-4, "u", "<p>6</p>")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, record string").repartition(3)
    index = warc.archive(df, per_file=20)
    got = index.collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == brute(rows)
    keys = [(r.url_key.encode(), r.captured, -1 if r.page_id is None else r.page_id) for r in got]
    assert [k[:2] for k in keys] == sorted(k[:2] for k in keys)
    assert len({r.run for r in got}) > 5
    assert warc.archive(df.where("false")).collect() == []


def test_least_bytes(spark):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")]
    got = {r.page_id: r.record_type for r in warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string"), least_bytes=3).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_losers():
    draw = random.Random(2)
    for k in (0, 1, 2, 3, 7, 8):
        lines = [[("r", draw.choice("abc"), str(draw.randint(0, 9)), draw.randint(0, 5), None, "", 0, "", None, j) for j in range(draw.randint(0, 20))] for _ in range(k)]
        runs = [sorted(x, key=warc._order) for x in lines]
        merged = [runs[r][i] for r, i in warc.merge([len(r) for r in runs], lambda r, i: warc._order(runs[r][i]))]  # noqa: B023
        assert list(map(warc._order, merged)) == sorted(warc._order(x) for r in runs for x in r)


def test_files_are_bounded_by_bytes(spark, tmp_path):
    """Large records come in files of fewer, so no file holds much more than is allowed; all are read back."""
    rows = [(i, f"http://h/{i}", chr(97 + i % 26) * (10 if i % 4 else 4000 * (1 + i % 3)) + str(i // 8)) for i in range(200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = warc.archive(df, f"{tmp_path}/w", per_file=50, most_bytes=20_000).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == brute(rows)
    held = {}
    for r in got:
        held.setdefault(r.run, []).append(r.payload_bytes if r.record_type == "response" else 0)
    assert max(len(x) for x in held.values()) <= 50 and max(map(sum, held.values())) <= 50_000 and len(held) > 10
