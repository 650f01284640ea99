import re

import pytest
from pyspark.sql import functions as F

from inkscan.llm import mixing, url_filter
from inkscan.llm.queries import ORACLES, QUERIES
from tests.llm.oracles import same


@pytest.mark.parametrize("name", sorted(ORACLES))
@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_oracle(spark, name, sf):
    rows = same(spark, QUERIES[name], ORACLES[name], sf)
    if name == "op2_urls":
        assert {r[5] for r in rows} == {"allow", "block"} and len({r[4] for r in rows}) >= 4 and len({r[3] for r in rows}) >= 2


def brute_url(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for h, p, v in url_filter.HOST_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    hit = any(re.search(url_filter.expression(f), (url or "").lower()) for _, p in url_filter.PATTERN_RULES for f in url_filter.forms(p))
    return host, path, None, "block" if hit else "allow"


def test_urls(spark):
    urls = [None, "", "nothing", "http://", "HTTP://WWW.Example.ORG/es/x?q#f", "http://example.org/en/17", "http://org", "http://org/", "http://xorg/", "ftp://a.com/fr/://b", "http://a.com?/fr/", "http://a.com#x/de/",
            "http://spam-farm.example.net/x", "http://a.adult-x.example.net", "http://x.net/casino/", "http://x.net/warez/", "http://x.net/?utm_source=ads", "http://É.net/Ä?", "http://a\nb.org/\nx", "://h/p", "http://x.net/" + "a-" * 30000]
    rows = [(i, u, "x") for i, u in enumerate(urls)] + [(4, urls[4], "again"), (None, urls[5], "x")]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, host string")).collect()
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got), key=repr) == sorted(((i, *brute_url(u)) for i, u, _ in rows), key=repr)
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_mixing(spark):
    rows = [(i, "w " * (1 + i % 7), ["a", "b", "c", "d", None][i % 5], "x") for i in range(4000)]
    rows += [(5000, None, "a", "x"), (5001, "", "e", "x"), (5002, "w", "f", "x"), (7, "w " * 8, "c", "again"), (None, "w w", "b", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = mixing.mix(df, ["doc_id", "source"])
    assert got.count() == len(rows)
    by = {r.source: r for r in got.groupBy("source").agg(F.sum("size").alias("size"), F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.sum("taken").alias("taken")).collect()}
    total = sum(r.size for r in by.values())
    assert abs(sum(r.target for r in by.values()) - total) < 1e-6 * total
    for r in by.values():
        assert r.size == r.source_size and r.target <= 3 * r.size + 1e-9
        assert abs(r.taken - r.target) <= 0.06 * max(r.target, 60)
    assert by["f"].target == 3 and got.where("taken > 3 * size").count() == 0
    assert sorted(map(repr, got.collect())) == sorted(map(repr, mixing.mix(df.repartition(7), ["doc_id", "source"]).collect()))
    assert mixing.mix(df.where("false"), ["doc_id"]).collect() == []
    assert mixing.mix(df.where("text is null"), ["doc_id"]).collect()[0].taken == 0


def test_tokens_of_rules_are_whole_in_every_match(spark):
    urls = []
    for name, rule in url_filter.PATTERN_RULES:
        for form in url_filter.forms(rule):
            assert url_filter.tokens_of(form), name
            text = form.replace("||", "http://www.").replace("^", "/", 1).replace("^", "?").replace("*", "x1")
            for url in (text if "://" in text else f"http://a.net{text}", f"{text}9" if "://" in text else f"ftp://b.net{text}&y"):
                assert not re.search(url_filter.expression(form), url) or set(url_filter.tokens_of(form)) <= set(re.split(url_filter.TOKEN, url)), (name, url)
                urls.append(url)
            assert re.search(url_filter.expression(form), urls[-2]), (name, urls[-2])
    urls += ["http://www.sportsbetting.net/", "http://www.sports-betting.net/", "http://a.net/sportsbettings/", "http://a.net/scasino/x", "casino", "x://casino"]
    got = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), host_rules=()).collect()
    compiled = [(n, re.compile("|".join(f"(?:{url_filter.expression(f)})" for f in url_filter.forms(p)))) for n, p in url_filter.PATTERN_RULES]
    names = {u: min((n for n, p in compiled if p.search(u)), default=None) for u in urls}
    assert {urls[r.page_id]: r.pattern for r in got} == names and names["http://www.sportsbetting.net/"] == "sports betting" and names["http://a.net/scasino/x"] is None


def test_filters():
    assert url_filter.forms("^(a|b|)c(d|)^") == ["^acd^", "^ac^", "^bcd^", "^bc^", "^cd^", "^c^"]
    assert url_filter.tokens_of("||adult-*.") == ["adult"] and url_filter.tokens_of("^x1*y^z|") == ["z"] and url_filter.tokens_of("abc") == []
    # a form without a whole token is no less a rule
    assert re.search(url_filter.expression("bad*thing"), "http://x/sobad-a-things")


def test_a_very_long_text(spark):
    df = spark.createDataFrame([(1, "w " * 2_000_000, "a"), (2, "x" * 3_000_000, "b"), (3, " " * 1_000_000, None)], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.mix(df, ["doc_id"]).collect()}
    assert [got[i].size for i in (1, 2, 3)] == [2_000_000, 1, 0] and got[2].taken <= 3 and got[3].taken == 0


def test_rules_from_a_table(spark, monkeypatch):
    """Thousands of rules from a table, sent or shuffled, judge as the same rules in a list; a table beyond the bound is an error."""
    listed = [(f"rule {i:05d}", f"^word{i}^") for i in range(5000)] + [("late", "||bad-*."), ("either", "^(a|b|)zz^")]
    table = spark.createDataFrame([(*r, "x") for r in listed] + [(None, "^x^", ""), ("none", None, ""), listed[0] + ("again",)], "name string, rule string, url string")
    pages = spark.createDataFrame([(i, f"http://h.net/word{i * 7}/x") for i in range(900)] + [(1000, "http://bad-x.net/"), (1001, "http://q.net/azz"), (1002, "http://q.net/"), (1003, "http://example.org/es/word1/")], "page_id long, url string")
    want = {i: f"rule {i * 7:05d}" if i * 7 < 5000 else None for i in range(900)} | {1000: "late", 1001: "either", 1002: None, 1003: None}
    for sent in (10, 500_000):
        monkeypatch.setattr(url_filter, "SENT_FORMS", sent)
        got = url_filter.judge(pages, pattern_rules=table).collect()
        assert {r.page_id: r.pattern for r in got} == want and {r.verdict for r in got if r.page_id == 1003} == {"block"}
    with pytest.raises(ValueError):
        url_filter.read_rules(table, most=100)
    assert len(url_filter.PATTERN_RULES) > 200 and sum(len(url_filter.forms(p)) for _, p in url_filter.PATTERN_RULES) > 3000


def test_mix_is_near_each_target(spark):
    """What a source's documents add up to is within four deviations of independent draws of the source's target."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(df, ["doc_id", "source"]).collect()
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    for own in by.values():
        rate = own[0].target / own[0].source_size
        spread = (sum(r.size**2 for r in own) * (rate % 1) * (1 - rate % 1)) ** 0.5
        assert abs(sum(r.taken for r in own) - own[0].target) <= 4 * spread + 1e-6
