"""URL filters: longest rules first, then link-graph propagation over hosts, in DataFrame operations only.

Host edges come from the links of the pages. Trust flows along links from hosts whose ruled pages are
allowed (personalised PageRank); distrust flows against links from hosts whose ruled pages are blocked,
each host taking the mean over its own links, so that other hosts' links to the same place do not thin it;
trusted seeds take none and pass none on.
A seed host keeps the verdict of its rules; any other is blocked where its distrust passes the
threshold and its trust. Hosts mixed in the rules are no seeds. A null url, or one without `://`,
has an empty host and path and is allowed by default; null html has no links; repeated pages are
judged one by one and count once each; no pages give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import bounded_join, checkpoint

#: (verdict, host/path) of the rules.
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
DAMPING = 0.85
#: Rounds go on until no host's score moves by more than this, which the damping reaches within MOST_ROUNDS.
TOLERANCE, MOST_ROUNDS = 1e-4, 60
#: Share of a lone blocked seed's distrust above which a host is blocked: reached where about half of the
#: host's links go straight to blocked seeds, or all of them over up to five steps.
SHARE = 0.4
THRESHOLD = SHARE * (1 - DAMPING)


def ascii_lower(c: Column) -> Column:
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower(c))


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Adds host, path, rule and rule_verdict; the longest rule that fits wins."""
    out = pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        host, slash, rest = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return out.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, weight: links between different hosts, weighted by their share of the source's links."""
    links = pages.where(F.col("host") != "").select("host", F.explode(F.regexp_extract_all("html", F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""), 1)).alias("to"))
    pairs = links.select(F.col("host").alias("src"), host_of(F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), "to")).otherwise(F.col("to"))).alias("dst")).where("dst <> '' and dst <> src").groupBy("src", "dst").agg(F.count("*").alias("n"))
    return pairs


def _spread(scores: DataFrame, edges: DataFrame, seed: str, source: str, to: str) -> DataFrame:
    """One round: a share of each host's score goes over its edges, the rest comes from the seeds."""
    moved = edges.join(scores.select(F.col("host").alias(source), F.col("score").alias("_s")), source).groupBy(F.col(to).alias("host")).agg(F.sum(F.col("_s") * F.col("share")).alias("_in"))
    return scores.join(moved, "host", "left").select("host", seed, F.col("score").alias("_before"), (F.lit(1 - DAMPING) * F.col(seed) + F.lit(DAMPING) * F.coalesce("_in", F.lit(0.0))).alias("score"))


def propagate(hosts: DataFrame, edges: DataFrame, seed: str, reverse: bool) -> DataFrame:
    """Damped scores of every host from the weights in ``seed``, along or against the edges; shares are of the links of ``src``."""
    source, to = ("dst", "src") if reverse else ("src", "dst")
    out = edges.groupBy("src").agg(F.sum("n").alias("_all"))
    shares = checkpoint(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("_all")).alias("share")))
    scores = hosts.select("host", seed, (F.lit(1 - DAMPING) * F.col(seed)).alias("score"))
    for _ in range(MOST_ROUNDS):
        scores = checkpoint(_spread(scores, shares, seed, source, to))
        if (scores.agg(F.max(F.abs(F.col("score") - F.col("_before")))).first()[0] or 0.0) <= TOLERANCE:
            break
    return scores.select("host", F.col("score").alias(seed))


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of every page."""
    known = ruled(pages.select("page_id", "url", "html"), rules)
    seen = known.groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("rule_verdict") == "allow").alias("allowed"), F.count_if(F.col("rule_verdict") == "block").alias("blocked"))
    edges = checkpoint(host_edges(known))
    linked = edges.select(F.col("src").alias("host")).union(edges.select(F.col("dst").alias("host"))).distinct()
    hosts = checkpoint(
        seen.join(linked, "host", "full")
        .select("host", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "allowed", "blocked")))
        .select("host", ((F.col("blocked") == 0) & (F.col("allowed") * 2 > F.col("n"))).cast("double").alias("trust"), ((F.col("allowed") == 0) & (F.col("blocked") * 2 > F.col("n"))).cast("double").alias("distrust"))
    )
    doubted = edges.join(hosts.where("trust > 0").select(F.col("host").alias("src")), "src", "left_anti")
    seeds = hosts.select("host", (F.col("trust") > 0).alias("_trusted"), (F.col("distrust") > 0).alias("_blocked"))
    scores = checkpoint(propagate(hosts, edges, "trust", False).join(propagate(hosts, doubted, "distrust", True), "host").join(seeds, "host"))
    judged = bounded_join(known.drop("html", "url"), scores, "host", "left")
    bad = F.col("_blocked") | ~F.col("_trusted") & (F.col("distrust") > THRESHOLD) & (F.col("distrust") > F.col("trust"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.when(bad, "block").otherwise("allow")).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
