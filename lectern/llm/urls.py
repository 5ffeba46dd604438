"""URL filter: pattern rules indexed by their rarest literal token.

A rule names literal tokens that every matching URL must contain whole. The rarest of them, counted over the URLs
themselves, is the rule's only index entry. A URL's tokens fetch candidate rules and only those run their regular
expressions, so the cost of a URL depends on the rules that its rare tokens name and not on the length of the rule list.

Rules are written one a line and are matched without regard to case against host and path:

=========== ==================================================================================================
``word``    a bare word: a whole token anywhere
``a/b``     anything else: a literal part
``*``       any run of characters
``^``       a separator, that is no letter, digit, ``_``, ``-``, ``.`` or ``%``; or the end
``||``      at the start: the host begins here, or a label of it
``|``       at the start or the end: the address begins or ends here
``@@``      at the start: an exception, which allows and wins over all that block
``!``       at the start: a comment
=========== ==================================================================================================
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN = r"[A-Za-z0-9]+"


#: Levels of rules: those that block, their exceptions, and rules on hosts, which stand above both.
BLOCKS, EXCEPTIONS, HOSTS = 0, 1, 2


@dataclass(frozen=True)
class Rule:
    """``pattern`` is searched in host + path. The longest ``name`` wins among rules of the highest ``level``."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    level: int = BLOCKS


def host_rule(name: str, verdict: str) -> Rule:
    """A rule such as ``example.net/en/``: its host and all subdomains, paths that start with the rule's path."""
    host, slash, rest = name.partition("/")
    return Rule(name, verdict, r"^(?:[^/]*\.)?" + re.escape(host.lower()) + re.escape(slash + rest), tuple(re.findall(TOKEN, host.lower())), HOSTS)


def parse_rule(line: str) -> Rule | None:
    """The rule of a line; None for comments and blank lines. Tokens are those that no neighbouring text can lengthen."""
    name = line.strip()
    if not name or name.startswith("!"):
        return None
    body = name.removeprefix("@@")
    verdict, level = ("allow", EXCEPTIONS) if body != name else ("block", BLOCKS)
    if re.fullmatch(TOKEN, body):
        return Rule(name, verdict, rf"(?i)(?<![A-Za-z0-9]){body}(?![A-Za-z0-9])", (body,), level)
    domain, start = body.startswith("||"), body.startswith("|")
    core = body.lstrip("|")
    end = core.endswith("|")
    core = core.removesuffix("|")
    parts = re.findall(r"[*^]|[^*^]+", core)
    said = {"*": ".*", "^": r"(?:[^A-Za-z0-9_.%-]|\z)"}
    pattern = "(?is)" + (r"^(?:[^/]*\.)?" if domain else "^" if start else "") + "".join(said.get(x) or re.escape(x) for x in parts) + (r"\z" if end else "")
    tokens = []
    for i, x in enumerate(parts):
        if x in said:
            continue
        for m in re.finditer(TOKEN, x):
            opens = m.start() > 0 or (i > 0 and parts[i - 1] == "^") or (i == 0 and start)
            closes = m.end() < len(x) or (i + 1 < len(parts) and parts[i + 1] == "^") or (i + 1 == len(parts) and end)
            if opens and closes:
                tokens.append(m[0])
    return Rule(name, verdict, pattern, tuple(tokens), level)


def read_rules(spark: SparkSession, path: str) -> tuple[Rule, ...]:
    """The rules of text files. They go to the driver: a rule list is bounded, as people keep it."""
    return tuple(r for x in spark.read.text(path).distinct().orderBy("value").collect() if (r := parse_rule(x["value"])))


#: Rules that the contract of the query fixes.
FIXED = (host_rule("net/", "block"), host_rule("example.net/en/", "allow"), host_rule("example.com/de/", "block"), host_rule("org/fr/", "allow"))
#: The method's own rules: pages that carry no prose worth training on, and such as look like them.
LINES = """
! trade, games of chance and adult pages
casino
poker
porn
xxx
viagra
||bet.*.com^
||ads.
||adserver.
||track*.example.
/adclick/
/banner/*/click^
/out.php^
/redirect/
||click.*/go/

! doors and forms
login
signin
signup
logout
unsubscribe
captcha
/user/register^
/account/password^
/wp-login.php|
/wp-admin/
/oauth/authorize^

! shops
cart
checkout
/shop/basket^
/order/confirm^
@@/cart/guide/
@@/docs/login^
@@/blog/*/checkout^

! machines
cgi
tracker
/cgi-bin/
/feed/|
/rss.xml|
/sitemap.xml|
/sitemap*.xml|
/robots.txt|
/api/v1/
/api/v2/
/xmlrpc.php^
/search/*/page/
/tag/*/page/
/calendar/*/day/
/print/view^

! files
.zip|
.exe|
.jpg|
.png|
.gif|
.mp4|
.css|
.js|
.woff|
.iso|
.tar.gz|
"""
GENERAL = tuple(r for x in LINES.splitlines() if (r := parse_rule(x)))
DEFAULT_VERDICT = "allow"
#: Up to so many bytes of rules are planned as one constant; a longer list is joined as a table.
CONSTANT_BYTES = 1 << 20


def _lower(text: Column) -> Column:
    """A-Z only: other letters are no part of a token."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _tokens() -> Column:
    """The distinct tokens of host and path in lower case."""
    return F.array_distinct(F.regexp_extract_all(_lower(F.concat("__host", "__path")), F.lit(TOKEN), 0))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path as written, A-Z of the host lower-cased; both empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return _lower(host), path


def _rarest(parted: DataFrame, rules: Sequence[Rule]) -> dict[Rule, str]:
    """The rarest token of each rule over all URLs. What comes to the driver is bounded by the rule list."""
    contested = sorted({t.lower() for r in rules if len({*map(str.lower, r.tokens)}) > 1 for t in r.tokens})
    seen = {}
    if contested:
        tokens = parted.select(F.explode(_tokens()).alias("t"))
        seen = {r["t"]: r["count"] for r in tokens.where(F.col("t").isin(contested)).groupBy("t").count().collect()}
    return {r: min(map(str.lower, r.tokens), key=lambda t: (seen.get(t, 0), t)) for r in rules}


def _folded(spark: SparkSession, text: str, n: int, kind: str) -> Column:
    """The rules dealt to ``n`` buckets by the hash of their token, as a constant that the optimiser folds once."""
    rules = F.from_json(F.lit(text), kind)
    bucket = lambda r: F.pmod(F.xxhash64(r["token"]), F.lit(n))
    dealt = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.filter(rules, lambda r: bucket(r) == i))
    made = spark.range(1).select(F.to_json(dealt).alias("b")).head()["b"]
    return F.from_json(F.lit(made), f"array<{kind}>")


def filter_urls(pages: DataFrame, rules: Sequence[Rule] = (*FIXED, *GENERAL), default: str = DEFAULT_VERDICT, constant_bytes: int = CONSTANT_BYTES) -> DataFrame:
    """All columns of ``pages`` and __host, __path, __rule (name of the winning rule or null), __level and __verdict.

    A null URL or one without ``://`` has an empty host and path, fits no rule and gets the default verdict. Repeated
    rows are judged each. Rules without a literal token are refused: they would run on every URL.
    """
    if bare := [r.name for r in rules if not r.tokens]:
        raise ValueError(f"rules without a literal token: {bare}")
    host, path = split_url(F.col("url"))
    parted = pages.withColumn("__host", host).withColumn("__path", path)
    index = _rarest(parted, rules)
    found = _tokens()
    place = lambda r: F.struct(r["level"].alias("level"), F.length(r["name"]).alias("size"), r["name"].alias("name"), r["verdict"].alias("verdict"))
    entries = [{"token": t, "level": r.level, "name": r.name, "verdict": r.verdict, "pattern": r.pattern} for r, t in index.items()]
    if len(text := json.dumps(entries)) <= constant_bytes:
        # one constant, folded once: token buckets of rules, so that a lookup is an array access
        n = max(1, 2 * len(entries))
        kind = "array<struct<token string, level int, name string, verdict string, pattern string>>"
        constant = F.array(*[F.lit(None).cast(kind)] * n) if not entries else _folded(pages.sparkSession, text, n, kind)
        fetched = F.flatten(F.transform(found, lambda t: F.filter(F.get(constant, F.pmod(F.xxhash64(t), F.lit(n)).cast("int")), lambda r: r["token"] == t)))
        matched = F.transform(F.filter(fetched, lambda r: F.regexp_like(F.concat("__host", "__path"), r["pattern"])), place)
        best = parted.withColumn("__best", F.array_max(matched))
    else:
        # a long list: tokens meet rules in a join that adaptive execution splits where a token is hot
        table = pages.sparkSession.createDataFrame([(e["token"], e["level"], e["name"], e["verdict"], e["pattern"]) for e in entries], "token string, level int, name string, verdict string, pattern string")
        keyed = parted.withColumn("__key", F.concat("__host", F.lit("\n"), "__path"))
        urls = keyed.select("__key", "__host", "__path").distinct()
        hits = urls.withColumn("token", F.explode(found)).join(table, "token").where(F.regexp_like(F.concat("__host", "__path"), F.col("pattern")))
        won = hits.groupBy("__key").agg(F.max(F.struct("level", F.length("name").alias("size"), "name", "verdict")).alias("__best"))
        best = keyed.join(won, "__key", "left").drop("__key")
    return best.withColumn("__rule", F.col("__best.name")).withColumn("__level", F.col("__best.level")).withColumn("__verdict", F.coalesce("__best.verdict", F.lit(default))).drop("__best")
