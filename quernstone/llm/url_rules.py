"""URL filtering by pattern rules indexed by their rarest literal token; DataFrame functions only.

A rule is a host suffix with a path prefix (``example.com/en/``) or a pattern in the usual blocker notation
(``||`` anchors a host label, ``^`` a separator or the end, ``*`` anything, a final ``|`` the end). Each rule is one
regular expression over "host/path" text plus the literal tokens that any matching URL must contain. Tokens are
counted over all URLs; each rule is filed under its rarest one. A URL's tokens fetch candidate rules by an equi-join
and only those run their regular expression. Rules without a sure token are candidates for every URL.

Which rule counts: host/path rules before patterns; among them the longest; a pattern blocks or allows where none fits.

Defined cases: a null url, or one without "://", has an empty host and path, so only an all-matching pattern fits;
an empty rule set gives the default verdict; repeated pages are judged each; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.runtime import broadcast_if_small

TOKEN = "[a-z0-9]+"
#: Index entries up to which the rule side is broadcast; a larger rule set is joined by a shuffle.
BROADCAST_RULES = 50_000
#: Pattern rules of the default list.
BLOCK_PATTERNS = ("||spam-farm.", "||cheap-pills.", "||www.cheap-pills.", "||free-casino.", "||adult-", "/casino/*/bonus^")


@dataclass(frozen=True)
class Rule:
    name: str
    action: str
    regex: str
    tokens: tuple[str, ...]
    rank: int  # the highest wins


def host_rule(host: str, path: str, action: str) -> Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""
    whole = re.findall(TOKEN, host.lower()) + [t for s in path.split("/")[1:-1] if re.fullmatch(TOKEN, s) for t in [s]]
    return Rule(host + path, action, rf"^(?:[^/]*\.)?{re.escape(host.lower())}(?![^/]){re.escape(path)}", tuple(whole), 1_000_000 + len(host + path))


def pattern_rule(pattern: str, action: str = "block") -> Rule:
    """A rule in blocker notation; its sure tokens are those with a literal boundary on both sides."""
    body, start, end = pattern, pattern.startswith("||"), pattern.endswith("|") and len(pattern) > 2
    body = body[2:] if start else body
    body = body[:-1] if end else body
    regex = "".join({"*": ".*", "^": r"(?:[^A-Za-z0-9_.%-]|$)"}.get(c, re.escape(c)) for c in body)
    sure = [m[0] for m in re.finditer(TOKEN, body.lower()) if (body[m.start() - 1] != "*" if m.start() else start) and (body[m.end()] != "*" if m.end() < len(body) else end)]
    return Rule(pattern, action, (r"^(?:[^/]*\.)?" if start else "") + regex + ("$" if end else ""), tuple(sure), len(pattern))


def url_host(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z in lower case; else empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to "?", "#" or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def index_rules(urls: DataFrame, rules: Sequence[Rule], tokens: Column) -> DataFrame:
    """(token, name, action, regex, rank): each rule under its rarest sure token as counted over ``urls``."""
    spark = urls.sparkSession
    text = json.dumps([{"name": r.name, "action": r.action, "regex": r.regex, "rank": r.rank, "tokens": list(dict.fromkeys(r.tokens))} for r in rules])
    listed = spark.range(1).select(F.explode(F.from_json(F.lit(text), "array<struct<name:string,action:string,regex:string,rank:int,tokens:array<string>>>")).alias("r")).select("r.*")
    sure = listed.filter(F.size("tokens") > 0).select("name", "action", "regex", "rank", F.explode("tokens").alias("token"))
    wanted = broadcast_if_small(sure.select("token").distinct(), BROADCAST_RULES)
    counts = urls.select(F.explode(tokens).alias("token")).join(wanted, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = sure.join(counts, "token", "left").groupBy("name", "action", "regex", "rank").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("token"))).alias("token"))
    return rarest.select("token", "name", "action", "regex", "rank")


def judge_urls(pages: DataFrame, rules: Sequence[Rule], *, default: str = "allow", url_col: str = "url", keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """One row per page: ``keep``, host, path, rule (null if only a pattern or nothing fits), verdict, matched.

    ``matched`` is the name of the rule or pattern that decided. One shuffle, by row, after a map-side combine.
    """
    place = F.concat(F.col("host"), F.col("path"))
    tokens = F.array_distinct(F.regexp_extract_all(F.translate(place, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(TOKEN), F.lit(0)))
    rows = pages.select(*keep, url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    index = index_rules(rows, rules, tokens)
    always = F.array(*[F.when(place.rlike(r.regex), F.struct(F.lit(r.rank).alias("rank"), F.lit(r.name).alias("name"), F.lit(r.action).alias("action"))) for r in rules if not r.tokens])
    nothing = F.lit(None).cast("struct<rank:int,name:string,action:string>")
    always = F.array_max(always) if any(not r.tokens for r in rules) else nothing
    seen = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("token", F.explode_outer(tokens))
    fetched = seen.join(broadcast_if_small(index, BROADCAST_RULES), "token", "left")
    hit = F.when(F.col("regex").isNotNull() & F.rlike(place, F.col("regex")), F.struct("rank", "name", "action"))
    best = fetched.groupBy("row").agg(*[F.first(c).alias(c) for c in (*keep, "host", "path")], F.max(hit).alias("hit"))
    best = best.withColumn("best", F.greatest("hit", always)).drop("hit")
    sure = F.col("best.rank") >= 1_000_000
    return best.select(
        *keep, "host", "path",
        F.when(sure, F.col("best.name")).alias("rule"),
        F.coalesce("best.action", F.lit(default)).alias("verdict"),
        F.col("best.name").alias("matched"),
    )
