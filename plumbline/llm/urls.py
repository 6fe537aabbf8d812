"""URL filters: rules indexed by their rarest literal token, so that a URL runs few regular expressions.

Two kinds of rules go into one index:

* site rules name a host and the start of a path; they hold for the host and its subdomains, and the longest one wins;
* pattern rules are texts with ``*`` for anything, ``^`` for one separator character or the end, ``||`` at the start for
  the start of a host label, ``|`` at an end for that end of the URL.

Every rule is filed under one token (a run of letters and digits that any fitting URL must hold as a whole run), the one
that the fewest URLs of the table hold. The tokens of a URL fetch its candidate rules; only these are matched. Rules
without such a token are candidates for every URL. Built-in expressions only.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_RULES = 200_000  # a longer rule list is joined without a broadcast
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class SiteRule(NamedTuple):
    action: str
    host: str
    path: str


class PatternRule(NamedTuple):
    action: str
    pattern: str


# '.' and '-' are no separators for ^
PLAIN_PATTERNS = (
    PatternRule("block", "||spam-"),
    PatternRule("block", "-pills."),
    PatternRule("block", "^casino^"),
    PatternRule("block", "/adclick^"),
    PatternRule("block", "://*/popunder/"),
)

# words that fill a host label or begin one before a hyphen, as in casino.example.com and m.casino-win.example.com
HOST_WORDS = (
    *("casino", "casinos", "poker", "slots", "roulette", "blackjack", "jackpot", "betting", "sportsbet", "bets"),
    *("free-bets", "free-bet", "free-spins", "free-casino", "online-casino", "online-poker", "online-slots", "live-casino"),
    *("adult", "porn", "porno", "xxx", "sex-cams", "sexcams", "live-sex", "escorts", "hentai"),
    *("ads", "ad-server", "adserver", "adservice", "adclick", "ads-track", "ad-track", "adtrack", "track-ads", "popunder", "popads", "clickbait"),
    *("cheap-pills", "pills", "viagra", "cialis", "levitra", "cheap-meds", "online-pharmacy", "cheap-pharmacy", "discount-pharmacy", "buy-pills"),
    *("link-farm", "linkfarm", "spam-farm", "get-rich", "make-money", "payday-loans", "replica-watches"),
)
# whole path segments
PATH_WORDS = ("adclick", "adclicks", "adserver", "adserve", "popunder", "popup-ads", "banner-ads", "track-click", "casino-bonus", "free-spins", "viagra", "cialis", "xxx", "porn")

ADULT_ALLOWED = ("education", "learning", "literacy", "care", "social-care")

DEFAULT_PATTERNS = (
    *PLAIN_PATTERNS,
    *(PatternRule("block", f"||{word}{end}") for word in HOST_WORDS for end in "-."),
    *(PatternRule("block", f"/{word}^") for word in PATH_WORDS),
    *(PatternRule("allow", f"||adult-{word}") for word in ADULT_ALLOWED),
)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    rest = F.coalesce(F.when(F.contains(url, F.lit("://")), F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_regex(rule: SiteRule | PatternRule) -> str:
    """Site rules are matched with host and path together, patterns with the lower-cased URL."""
    if isinstance(rule, SiteRule):
        return r"^(?:[^/]*\.)?" + re.escape(rule.host + rule.path) + ("" if rule.path else "(?:/|$)")
    body, head, tail = rule.pattern.lower(), "", ""
    if body.startswith("||"):
        body, head = body[2:], r"^[^/?#]*://(?:[^/?#]*\.)?"
    elif body.startswith("|"):
        body, head = body[1:], "^"
    if body.endswith("|"):
        body, tail = body[:-1], "$"
    parts = {"*": ".*", "^": r"(?:[^a-z0-9_.%-]|$)"}
    return "(?s)" + head + "".join(parts.get(c) or re.escape(c) for c in body) + tail


def rule_tokens(rule: SiteRule | PatternRule) -> list[str]:
    """Tokens that every fitting URL holds as whole runs of a-z and 0-9."""
    if isinstance(rule, SiteRule):
        text, open_start, open_end = (rule.host + rule.path).lower(), False, True
    else:
        text = rule.pattern.lower()
        open_start, open_end = not text.startswith("|"), not text.endswith("|")
        text = text.strip("|")
    found = []
    for token in re.finditer("[a-z0-9]+", text):
        before, after = text[: token.start()], text[token.end() :]
        whole_start = before[-1] != "*" if before else not open_start
        whole_end = after[0] != "*" if after else not open_end
        if whole_start and whole_end:
            found.append(token[0])
    return sorted(set(found))


def url_tokens(url: Column) -> Column:
    return F.array_distinct(F.split(F.translate(url, UPPER, LOWER), "[^a-z0-9]+"))


def index_rules(urls: DataFrame, sites: Sequence[SiteRule], patterns: Sequence[PatternRule]) -> DataFrame:
    """The rules with the token each is filed under: ``token, site, action, rule, regex``."""
    spark = urls.sparkSession
    rows = [(rule_tokens(r), isinstance(r, SiteRule), r.action, r.host + r.path if isinstance(r, SiteRule) else r.pattern, rule_regex(r)) for r in [*sites, *patterns]]
    rules = spark.createDataFrame(rows, "tokens array<string>, site boolean, action string, rule string, regex string")
    wanted = rules.select(F.explode("tokens").alias("token")).distinct()
    wanted = F.broadcast(wanted) if len(rows) <= BROADCAST_RULES else wanted
    seen = urls.select(F.explode(url_tokens(F.col("url"))).alias("token")).join(wanted, "token", "left_semi")
    seen = seen.groupBy("token").agg(F.count(F.lit(1)).alias("urls"))
    filed = rules.select("site", "rule", "action", "regex", F.explode_outer("tokens").alias("token")).join(seen, "token", "left")
    rarest = F.min(F.struct(F.coalesce("urls", F.lit(0)).alias("urls"), F.coalesce("token", F.lit("")).alias("token")))
    return filed.groupBy("site", "action", "rule", "regex").agg(rarest.alias("best")).select("best.token", "site", "action", "rule", "regex")


def judge_urls(
    pages: DataFrame,
    sites: Sequence[SiteRule],
    patterns: Sequence[PatternRule] = DEFAULT_PATTERNS,
    default: str = "allow",
) -> DataFrame:
    """All columns of ``pages(url, ...)`` with ``host``, ``path``, ``rule`` and ``verdict``.

    The longest fitting site rule decides (of equal ones an allow rule) and is named in ``rule``. Else ``rule`` is null and
    the patterns decide: a fitting allow pattern allows, a fitting block pattern blocks, and ``default`` holds for the rest.
    A null url has empty host and path and gets the default. Columns of these names in ``pages`` are replaced. Repeated
    rows are judged one by one, an empty table stays empty.
    """
    pages = pages.drop("host", "path", "rule", "verdict")
    host, path = split_url(F.col("url"))
    urls = pages.select("url").where("url IS NOT NULL")
    rules = index_rules(urls, sites, patterns)
    if len(sites) + len(patterns) <= BROADCAST_RULES:
        rules = F.broadcast(rules)
    tokens = F.array_distinct(F.concat(url_tokens(F.col("url")), F.array(F.lit(""))))
    lower = F.translate("url", UPPER, LOWER)
    candidates = urls.distinct().select("url", F.concat(host, path).alias("place"), lower.alias("lower"), F.explode(tokens).alias("token"))
    subject = F.when(F.col("site"), F.col("place")).otherwise(F.col("lower"))
    fits = candidates.join(rules, "token").where(F.rlike(subject, F.col("regex")))
    allow = F.col("action") == "allow"
    site, pattern = F.col("site"), ~F.col("site")
    best = F.max(F.when(site, F.struct(F.length("rule").alias("size"), allow.alias("allow"), "rule", "action"))).alias("_best")
    decided = fits.groupBy("url").agg(
        best, F.max(F.when(pattern, allow)).alias("_allowed"), F.max(F.when(pattern, ~allow)).alias("_blocked")
    )
    # a hot url is one row on the right side, so the large side of this join can be split
    out = pages.alias("p").join(decided.alias("d"), F.col("p.url") == F.col("d.url"), "left")
    host, path = split_url(F.col("p.url"))
    own = F.when(F.col("d._allowed"), "allow").when(F.col("d._blocked"), "block").otherwise(F.lit(default))
    kept = [F.col(f"p.`{c}`") for c in pages.columns]
    return out.select(*kept, host.alias("host"), path.alias("path"), F.col("d._best.rule").alias("rule"), F.coalesce("d._best.action", own).alias("verdict"))
