"""URL filter: rules by host and path, and trust that flows over the host graph.

Hosts with allowed pages are trusted seeds, hosts with blocked pages are blocked seeds, each by the share of
its pages. Trust flows along links, distrust against them, as personalised PageRank; the same walks
from all pages give what a host would have if every page were a seed. Distrust and trust relative
to these, distrust less trust, decide a host: at `threshold` or more it is blocked. What comes over links
alone counts in the same way without the host's own seeds, so that many pages of its own, or links
from many hosts, don't shield a host that links to blocked ones; its own trust still counts for it.
The walks go on until the change is below `tolerance`, or for `rounds` rounds if given.

All of it is DataFrame functions. Links are counted per pair of hosts before the walk, so that a host
with very many pages or links is a few rows. A URL that is null or has no `://` has empty host
and path, fits no rule and is allowed. Rows that share an id are separate rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import col, landed

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"""(?i)(?:href|src)\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str


@dataclass(frozen=True)
class UrlRules:
    rules: tuple[Rule, ...]
    follow: float = 0.85
    rounds: int | None = None
    tolerance: float = 1e-9
    threshold: float = 0.5


def _lower(host: Column) -> Column:
    return F.translate(host, _UPPER, _UPPER.lower())


def _ruled(rules: tuple[Rule, ...], what) -> Column:
    """What the longest rule that fits says; null if none fits."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = (F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)
        out = F.when(fits & F.col("path").startswith(rule.path), F.lit(what(rule))).otherwise(out)
    return out


def parsed(pages: DataFrame, rules: UrlRules, key: str = "page_id", url: str = "url") -> DataFrame:
    """(id, host, path, rule, ruling) of every row."""
    text = F.coalesce(col(url).cast("string"), F.lit(""))
    rows = pages.select(col(key).alias("id"), _lower(F.regexp_extract(text, _PARTS, 1)).alias("host"), F.regexp_extract(text, _PARTS, 2).alias("path"))
    return rows.withColumns({"rule": _ruled(rules.rules, lambda r: r.host + r.path), "ruling": _ruled(rules.rules, lambda r: r.verdict)})


def edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst, n): links between different hosts."""
    source = _lower(F.regexp_extract(F.coalesce(col(url).cast("string"), F.lit("")), _PARTS, 1))
    links = pages.select(source.alias("src"), F.explode_outer(F.regexp_extract_all(col(html).cast("string"), F.lit(_LINK), F.lit(1))).alias("dst"))
    links = links.select("src", _lower(F.col("dst")).alias("dst")).where("src <> '' and dst <> '' and src <> dst")
    return links.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def host_scores(hosts: DataFrame, links: DataFrame, rules: UrlRules) -> DataFrame:
    """(host, trust, distrust, linked) from (host, pages, allowed, blocked) and (src, dst, n); `linked` is the
    distrust that comes over links, relative to what would come from seeds everywhere."""
    links = landed(links, "host-links")
    out = links.groupBy("src").agg(F.sum("n").alias("total"))
    into = links.groupBy("dst").agg(F.sum("n").alias("total"))
    forward = landed(links.join(out, "src").select(F.col("src").alias("host"), F.col("dst").alias("to"), (F.col("n") / F.col("total")).alias("w")), "links-forward")
    back = landed(links.join(into, "dst").select(F.col("dst").alias("host"), F.col("src").alias("to"), (F.col("n") / F.col("total")).alias("w")), "links-back")
    ends = links.select(F.col("src").alias("host")).union(links.select("dst")).distinct()
    # Walks: trust and all pages along links, distrust and all pages against them.
    seeds = {"t": "allowed", "p": "pages", "d": "blocked", "q": "pages"}
    start = hosts.join(ends, "host", "full").select("host", *[((1 - rules.follow) * F.coalesce(c, F.lit(0))).alias(f"{k}0") for k, c in seeds.items()])
    state = landed(start.select("*", *[F.col(f"{k}0").alias(k) for k in seeds]), "hosts")
    done = 0
    while rules.rounds is None or done < rules.rounds:
        done += 1
        flows = None
        for way, names in ((forward, "tp"), (back, "dq")):
            sent = way.join(state, "host").groupBy(F.col("to").alias("host")).agg(*[F.sum(F.col("w") * F.col(k)).alias(f"{k}1") for k in names])
            flows = sent if flows is None else flows.join(sent, "host", "full")
        moved = state.join(flows, "host", "left").select(
            "host", *[f"{k}0" for k in seeds], *[(F.col(f"{k}0") + rules.follow * F.coalesce(f"{k}1", F.lit(0.0))).alias(k) for k in seeds],
            sum(F.abs(rules.follow * F.coalesce(f"{k}1", F.lit(0.0)) + F.col(f"{k}0") - F.col(k)) for k in seeds).alias("change"),
        )
        moved = landed(moved, "hosts")
        change, mass = moved.agg(F.sum("change"), F.sum(F.col("p") + F.col("q"))).first()
        state = moved.drop("change")
        if not change or change <= rules.tolerance * mass:
            break
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    # Without links nothing is left but the rounding of the subtraction.
    over = F.when(F.col("q") - F.col("q0") > 1e-12 * F.col("q"), (F.col("d") - F.col("d0")) / (F.col("q") - F.col("q0"))).otherwise(0.0)
    return state.select("host", share("t", "p").alias("trust"), share("d", "q").alias("distrust"), over.alias("linked"))


def judged(pages: DataFrame, rules: UrlRules, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(id, host, path, rule, verdict, trust, distrust) of every row."""
    rows = parsed(pages, rules, key, url)
    hosts = rows.where("host <> ''").groupBy("host").agg(
        F.count(F.lit(1)).alias("pages"), F.count(F.when(F.col("ruling") == "allow", 1)).alias("allowed"), F.count(F.when(F.col("ruling") == "block", 1)).alias("blocked")
    )
    scores = landed(host_scores(hosts, edges(pages, url, html), rules), "host-scores")
    verdict = F.when(F.coalesce(F.greatest("distrust", "linked") - F.col("trust") >= rules.threshold, F.lit(False)), "block").otherwise("allow")
    joined = rows.join(scores, "host", "left")
    return joined.select("id", "host", "path", "rule", F.coalesce("ruling", verdict).alias("verdict"), "trust", "distrust")
