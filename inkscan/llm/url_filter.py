"""URL filters: host and path rules, and pattern rules indexed by their rarest literal token.

Host rules block or allow a host with its subdomains under a path prefix; the longest that fits
wins.  Where none fits, pattern rules decide.  A pattern rule is a filter over the lower-cased url:

* ``^`` is a separator, anything but a letter or digit, or an end of the url;
* ``*`` is any characters;
* ``||`` at the start is the start of the host or of one of its labels, ``|`` an end of the url;
* ``(a|b|)`` are alternatives, of which one may be empty; all else stands for itself.

Each choice of alternatives is a form of the rule, with a regular expression and the tokens (runs of
letters and digits) that every url it matches holds whole.  Tokens are counted over all urls, each
form is indexed under its rarest one, a url's tokens fetch the forms that may match, and only
those run.  DataFrame functions only.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkscan.llm.shared import cut

#: (host, path, verdict)
HOST_RULES: tuple[tuple[str, str, str], ...] = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)

#: Words that name a kind of site where they stand alone in a url.
WORDS: dict[str, str] = {
    "adult": "porn xxx sex escort escorts camgirls hentai milf nsfw fetish erotic adultdating livecams",
    "gambling": "casino casinos poker slots roulette blackjack betting bookmaker jackpot bingo baccarat lottery sportsbook",
    "piracy": "warez keygen crack cracked torrent torrents serialz nulled putlocker camrip yts",
    "malware": "malware trojan exploitkit botnet ransomware stealer",
    "spam": "viagra cialis payday replica essaywriting backlinks doorway linkfarm",
    "tracking": "adserver adclick doubleclick popunder clicktrack pixeltrack adsystem",
}
#: What such words are joined with in names of sites, and the ends of hosts that are nothing but such a word.
BEFORE, AFTER = "free online live best top cheap hot my the real".split(), "online hub club zone world shop site app".split()
ENDS = "com net org info biz xyz top club site online".split()


def compound_rules(words: dict[str, str] = WORDS, before: Sequence[str] = tuple(BEFORE), after: Sequence[str] = tuple(AFTER), ends: Sequence[str] = tuple(ENDS)) -> list[tuple[str, str]]:
    """Filters made from word lists: each word with what stands before or after it, and as a host of its own."""
    out = []
    for kind, listed in words.items():
        for w in listed.split():
            out.append((f"{kind}: .. {w}", f"^({'|'.join(before)})(-|){w}(s|)^"))
            out.append((f"{kind}: {w} ..", f"^{w}(-|)({'|'.join(after)})^"))
            out.append((f"{kind}: host {w}", f"||{w}.({'|'.join(ends)})^"))
    return out


#: (name, filter); with the compounds some four thousand forms.
PATTERN_RULES: tuple[tuple[str, str], ...] = (
    ("adult host", "||adult-*."),
    ("spam farm", "||spam-farm."),
    ("online casino", "^(online-|online|)casino(s|)^"),
    ("sports betting", "^sports(-|)bet(s|ting|)^"),
    ("malware host", "^malware-*."),
    ("login bait", "^(login|signin|account)-(verify|update|secure)^"),
    ("feed tracking of ads", "^utm_source=ads^"),
    ("free download bait", "^(free|full)-(crack|keygen|serial)^"),
    ("pills shop", "||(cheap|buy)-(viagra|cialis|pills)*."),
    *((f"{kind}: {word}", f"^{word}^") for kind, words in WORDS.items() for word in words.split()),
    *compound_rules(),
)

TOKEN = "[^a-z0-9]+"
#: Urls that a pattern blocks, up to which they are sent to all tasks.
SENT_URLS = 100_000
#: Rules that are read from a table at most, and rows of the index up to which it is sent to all tasks; a larger one is shuffled.
MOST_RULES, SENT_FORMS = 1_000_000, 500_000


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    host = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _by_host(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; longest by its text, the first of equals."""
    ordered = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    if not ordered:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for h, p, _ in ordered]
    name = F.coalesce(*(F.when(f, h + p) for f, (h, p, _) in zip(fits, ordered, strict=True)))
    verdict = F.coalesce(*(F.when(f, v) for f, (_, _, v) in zip(fits, ordered, strict=True)))
    return name, verdict


def forms(rule: str) -> list[str]:
    """A filter without alternatives for each choice among them."""
    parts = re.split(r"\(([^()]*)\)", rule)
    return ["".join(choice) for choice in product(*(p.split("|") if i % 2 else [p] for i, p in enumerate(parts)))]


def expression(form: str) -> str:
    """The regular expression of a form, the same for Java's engine and others."""
    out = {"||": "^[a-z]+://([^/?#]*[.])?", "|": "^"}.get(form[:2] if form[:2] == "||" else form[:1], "")
    body = form.lstrip("|")
    ends = body.endswith("|")
    for i, c in enumerate(body.removesuffix("|")):
        if c == "^":
            out += "(^|[^a-z0-9])" if not i and not out else "([^a-z0-9]|$)"
        else:
            out += ".*" if c == "*" else c if c.isalnum() or c in "/:=_-" else f"[{c}]"
    return out + "$" * ends


def tokens_of(form: str) -> list[str]:
    """Runs of letters and digits that stand between separators, and so are tokens of every match."""
    return re.findall(r"(?<![a-z0-9*])(?<=[^a-z0-9])[a-z0-9]+(?=[^a-z0-9*])", form)


def read_rules(table: DataFrame, most: int = MOST_RULES) -> list[tuple[str, str]]:
    """The pattern rules of a table (name, rule), by name; a table of more than ``most`` is an error and not cut short."""
    rows = table.select(F.col("name").cast("string"), F.col("rule").cast("string")).where("name is not null and rule <> ''").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rules")
    return sorted(map(tuple, rows))


def _rule_index(tokens: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(token, name, pattern): each form of a rule under the one of its tokens that the fewest urls hold; hinted to be sent where it is small."""
    listed = [(name, expression(form), token) for name, rule in rules for form in forms(rule) for token in tokens_of(form)]
    send = (lambda df: F.broadcast(df)) if len(listed) <= SENT_FORMS else (lambda df: df.hint("merge"))
    table = tokens.sparkSession.createDataFrame(listed, "name string, pattern string, token string")
    counted = tokens.join(send(table.select("token").distinct()), "token").groupBy("token").agg(F.count("*").alias("urls"))
    rated = table.join(counted, "token", "left").withColumn("urls", F.coalesce("urls", F.lit(0)))
    return send(rated.groupBy("name", "pattern").agg(F.min(F.struct("urls", "token")).alias("rarest")).select("rarest.token", "name", "pattern"))


def judge(
    pages: DataFrame,
    host_rules: Sequence[tuple[str, str, str]] = HOST_RULES,
    pattern_rules: Sequence[tuple[str, str]] | DataFrame = PATTERN_RULES,
) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, pattern (the first pattern rule by name that blocks it, or null).

    A host rule's verdict stands; elsewhere a url is blocked if a pattern rule matches it.  A null
    url, or one without ``://``, has an empty host and path, and is allowed if no pattern matches.
    Every row gives a row, repeated ones too; other columns are ignored.  A form without a whole
    token can't be indexed and runs on every url; none of ``PATTERN_RULES`` is such.  Pattern rules
    may come as a table (name, rule) instead.
    """
    pattern_rules = read_rules(pattern_rules) if isinstance(pattern_rules, DataFrame) else pattern_rules
    df = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url"))
    low = F.lower(F.coalesce("url", F.lit("")))
    name, verdict = _by_host(F.col("host"), F.col("path"), host_rules)
    df = df.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url"))).withColumn("low", low)
    always = [F.when(F.col("low").rlike(expression(f)), n) for n, rule in pattern_rules for f in forms(rule) if not tokens_of(f)]
    df = df.select("page_id", "url", "host", "path", name.alias("rule"), verdict.alias("by_rule"), F.array_compact(F.array(*always)).alias("always") if always else F.array().cast("array<string>").alias("always"))
    # urls that differ only in what follows are judged each: only distinct ones with candidates are joined back
    open_ = F.col("by_rule").isNull() & F.col("url").isNotNull()
    urls = df.where(open_).select("url").distinct()
    tokens = urls.select("url", F.explode(F.array_distinct(F.split(F.lower("url"), TOKEN))).alias("token")).where("token <> ''")
    index = _rule_index(tokens, pattern_rules)
    fetched = tokens.join(index, "token")  # one row per form of a rule
    matched = cut(fetched.where(F.expr("lower(url) rlike pattern")).groupBy("url").agg(F.min("name").alias("matched")))
    small = F.broadcast(matched) if matched.count() <= SENT_URLS else matched
    out = df.where(open_).join(small, "url", "left").unionByName(df.where(~open_).withColumn("matched", F.lit(None).cast("string")))
    pattern = F.when(F.col("by_rule").isNull(), F.array_min(F.array_compact(F.concat("always", F.array("matched")))))
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(pattern.isNotNull(), "block").otherwise("allow")).alias("verdict"), pattern.alias("pattern"))


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle(host_rules: Sequence[tuple[str, str, str]] = HOST_RULES, pattern_rules: Sequence[tuple[str, str]] = PATTERN_RULES) -> str:
    """The same rows in DuckDB's SQL: every rule runs on every url, without an index."""
    hosts = ", ".join(f"({_quote(h)}, {_quote(p)}, {_quote(v)})" for h, p, v in host_rules)
    patterns = ", ".join(f"CASE WHEN regexp_matches(lower(coalesce(url, '')), {_quote('|'.join(f'(?:{expression(f)})' for f in forms(p)))}) THEN {_quote(n)} END" for n, p in sorted(pattern_rules))
    return f"""
WITH rules(h, p, v) AS (VALUES {hosts}),
parts AS (
  SELECT page_id, url,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
split AS (
  SELECT page_id, url,
    translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM parts),
named AS (
  SELECT *, (SELECT max_by(h || p, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule,
    coalesce({patterns}) AS matched
  FROM split)
SELECT page_id, host, path, rule,
  coalesce((SELECT v FROM rules WHERE h || p = rule), CASE WHEN matched IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
  CASE WHEN rule IS NULL THEN matched END AS pattern
FROM named"""
