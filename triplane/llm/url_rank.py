"""URL filters: rules by host and path, and link-graph propagation for the rest.

A url that a rule fits takes the verdict of the longest such rule. All other urls take the verdict of their host, from
two walks over the edges between hosts: trust flows from the hosts of allowed pages along links (personalised PageRank),
distrust flows from the hosts of blocked pages against them, to those that link there. A host's seed is the share of its
pages under such rules. A host is blocked if its distrust reaches :data:`THRESHOLD` and exceeds its trust.

Edges come from absolute links in the pages' html, outside of scripts, styles and comments, counted per pair of hosts before
the shuffle; links within a host are none. Each round is one join and one sum over the edges, written to the shared folder;
rounds end when no host moves by more than :data:`SETTLED` of the threshold, or at once without edges, and raise if they
don't. Rank that reaches a host without links ends there.

Urls that are null or have no ``://`` have an empty host and path; no rule fits them and they are allowed, as are hosts
that no walk reaches. Null html has no links. Repeated pages keep their rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplane.shared import discard, materialise

#: (host, path prefix, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
DAMPING = 0.85
THRESHOLD = 0.5 * (1 - DAMPING)
SETTLED = 1e-3
#: What is left of a seed after so many rounds is 0.85**200, about 1e-14.
MOST_ROUNDS = 200
_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "^(?s:.*?)://([^/?#]*)", 1), *_LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, like ``net/``, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for own, prefix, what in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is asked first
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(prefix)
        rule, verdict = F.when(fits, own + prefix).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``(src, dst, n)``: links from pages of one host to another."""
    shown = F.regexp_replace(F.coalesce(html, F.lit("")), "(?is)<!--.*?(?:-->|\\z)|<(script|style)\\b.*?(?:</\\1\\b|\\z)", " ")
    links = F.regexp_extract_all(shown, F.lit("(?i)<a\\s[^>]*?href\\s*=\\s*[\"']?\\s*((?:[a-z][a-z0-9+.-]*:)?//[^\"'\\s>]*)"), 1)
    to = F.transform(links, lambda x: host_of(F.when(x.startswith("//"), F.concat(F.lit("x:"), x)).otherwise(x)))
    each = pages.select(host_of(F.col(url)).alias("src"), F.explode(to).alias("dst"))
    return each.where("src != dst AND src != '' AND dst != ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def walk(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING) -> DataFrame:
    """``(host, rank)``: rank flows from ``src`` to ``dst`` in proportion to ``n``, and starts anew at ``seeds`` (host, seed).

    Rank and seeds are not normalised to one: a seed alone keeps ``(1 - damping)`` of itself.
    """
    out = edges.groupBy("src").agg(F.sum("n").alias("total"))
    share = materialise(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("share")))
    base = materialise(seeds.select("host", ((1 - damping) * F.col("seed")).alias("base")))
    rank, before = base.select("host", F.col("base").alias("rank")), None
    for _ in range(MOST_ROUNDS):
        flow = rank.join(share, rank["host"] == share["src"]).groupBy(F.col("dst").alias("host")).agg((damping * F.sum(F.col("rank") * F.col("share"))).alias("flow"))
        after = base.join(flow, "host", "full").select("host", (F.coalesce("base", F.lit(0.0)) + F.coalesce("flow", F.lit(0.0))).alias("rank"))
        after = materialise(after)
        old = rank.select("host", F.col("rank").alias("old"))
        moved = after.join(old, "host", "full").agg(F.max(F.abs(F.coalesce("rank", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))))).first()[0]
        if before is not None:
            discard(before)
        rank = before = after
        if (moved or 0.0) <= SETTLED * THRESHOLD:
            return rank
    raise RuntimeError("ranks did not settle")


def verdicts(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    named = pages.select("page_id", host.alias("host"), path.alias("path"))
    judged = named.withColumns({"rule": rule, "by_rule": verdict})
    share = lambda what: F.avg(F.when(F.col("by_rule") == what, 1.0).otherwise(0.0))
    seeds = judged.where("host != ''").groupBy("host").agg(share("allow").alias("good"), share("block").alias("bad"))
    seeds = materialise(seeds)
    edges = materialise(host_edges(pages))
    trust = walk(edges, seeds.where("good > 0").select("host", F.col("good").alias("seed")))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = walk(back, seeds.where("bad > 0").select("host", F.col("bad").alias("seed")))
    both = trust.join(distrust.select("host", F.col("rank").alias("distrust")), "host", "full")
    bad = F.coalesce("distrust", F.lit(0.0))
    blocked = materialise(both.where((bad >= threshold) & (bad > F.coalesce("rank", F.lit(0.0)))).select("host", F.lit("block").alias("by_host")))
    met = judged.join(blocked, "host", "left")
    return met.select("page_id", "host", "path", "rule", F.coalesce("by_rule", "by_host", F.lit("allow")).alias("verdict"))
