"""URL filter: rules by host and path, and trust spread over the links between hosts.

A host's share of pages that a rule allows is its seed of trust, its share of pages that a rule
blocks its seed of distrust. Personalised PageRank runs from the trusted seeds along the links;
distrust runs from the blocked seeds against them, to the hosts that link there. Both are
compared with the rank that the host would have if every host were a whole seed: what a host
hears is the part of its rank that is trust (of those that link to it) or distrust (of those it
links to). A host with one blocked page in a hundred so passes on a hundredth, and unknown
hosts count as neither. Ruled pages pass on their own seed only, not what their host hears, so
links from a blocked host to good ones do not wash it. A page that no rule fits has its host's verdict: the ruled pages stand
for their share of the host, what it hears for the rest; block where distrust is above `limit`
and above that part of trust and distrust together, else allow. Rounds go on until one moves
less than `tolerance` a host or for `rounds`. The graph has a row per host and per pair of
linked hosts and direction, so a round moves those rows only, for all four ranks at once, and
deletes the table of the round before.

Defined results: a null url, or one without "://", has an empty host and path; such a host
takes no part in the graph and is allowed, as is every host that no seed reaches. A null
html has no links. Repeated rows give one row each.
"""

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.session import cut_lineage, discard

#: The rules of the query, as (host, path, verdict).
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]
DAMPING = 0.85


def ascii_lower(column):
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url):
    """Host (lower case) and path of a url column; both empty where there is no '://'."""
    url = F.coalesce(url, F.lit(""))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host, path, rules):
    """The longest fitting rule as struct(rule, verdict), or null; ties go to the rule listed first."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for at, way, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1]))[::-1]:
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(way)
        found = F.when(fits, F.struct(F.lit(at + way).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def links(pages: DataFrame) -> DataFrame:
    """Links between different hosts: src, dst, n. `pages`: host, html."""
    found = pages.select(F.col("host").alias("src"), F.explode(F.expr(
        r"""regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*["'']?\\s*((?:[a-z][a-z0-9+.-]*:)?//[^/?#"''\\s>]+)', 1)"""
    )).alias("to"))
    dst = ascii_lower(F.regexp_extract("to", "//(.+)$", 1))
    return (found.select("src", dst.alias("dst")).filter("src <> '' AND dst <> '' AND src <> dst")
            .groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")))


def spread(seeds: DataFrame, edges: DataFrame, rounds: int | None, tolerance: float) -> DataFrame:
    """host, good, bad, rest, heard_trust, heard_distrust. `seeds`: host, good, bad (shares of its pages); `edges`: src, dst, n.
    Ranks along the links (ahead: trust, and all as seeds) and against them (back: distrust, and all as seeds).
    `rounds`: None goes on until a round moves less than `tolerance` a host; a round moves at most DAMPING of the last."""
    seed = {"trust": F.col("good"), "ahead": F.lit(1.0), "distrust": F.col("bad"), "back": F.lit(1.0)}
    rest = F.greatest(1 - F.col("good") - F.col("bad"), F.lit(0.0))
    hosts = cut_lineage(seeds.select("host", "good", "bad", rest.alias("rest"), *(v.alias(k) for k, v in seed.items()),
                                     *(F.lit(0.0).alias("in_" + k) for k in seed)))
    heard = [F.when(F.col("in_" + whole) > 0, F.col("in_" + part) / F.col("in_" + whole)).otherwise(0.0).alias("heard_" + part)
             for part, whole in (("trust", "ahead"), ("distrust", "back"))]
    if edges.isEmpty():
        return hosts.select("host", "good", "bad", "rest", *heard)
    ways = edges.select(F.col("src").alias("giver"), F.col("dst").alias("host"), F.lit(True).alias("along"), "n").union(
        edges.select(F.col("dst"), F.col("src"), F.lit(False), "n"))
    total = ways.groupBy("giver", "along").agg(F.sum("n").alias("total"))
    ways = cut_lineage(ways.join(total, ["giver", "along"]).select("giver", "host", "along", (F.col("n") / F.col("total")).alias("part")))
    n = hosts.count()
    for _ in count() if rounds is None else range(rounds):
        given = ways.join(hosts.select(F.col("host").alias("giver"), *seed), "giver").groupBy("host").agg(
            *(F.sum(F.when(F.col("along") == (k in ("trust", "ahead")), F.col("part") * F.col(k))).alias("in_" + k) for k in seed))
        new = {k: (1 - DAMPING) * v + DAMPING * F.col("rest") * F.coalesce("in_" + k, F.lit(0.0)) for k, v in seed.items()}
        moved = sum((F.abs(v - F.col(k)) for k, v in new.items()), F.lit(0.0))
        old, hosts = hosts, cut_lineage(hosts.drop(*("in_" + k for k in seed)).join(given, "host", "left").select(
            "host", "good", "bad", "rest", *(v.alias(k) for k, v in new.items()),
            *(F.coalesce("in_" + k, F.lit(0.0)).alias("in_" + k) for k in seed), moved.alias("moved")))
        discard(old)
        if (hosts.agg(F.sum("moved")).first()[0] or 0.0) < tolerance * n:
            break
    discard(ways)
    return hosts.select("host", "good", "bad", "rest", *heard)


def host_scores(pages: DataFrame, rounds: int | None = 20, tolerance: float = 1e-6) -> DataFrame:
    """host, trust, distrust, each from 0 to 1. `pages`: host, html, verdict of the rules or null."""
    edges = cut_lineage(links(pages))
    shares = pages.filter("host <> ''").groupBy("host").agg(
        F.avg(F.when(F.col("verdict") == "allow", 1.0).otherwise(0.0)).alias("good"),
        F.avg(F.when(F.col("verdict") == "block", 1.0).otherwise(0.0)).alias("bad"))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("host")).distinct()
    found = spread(shares.join(ends, "host", "full").fillna(0.0), edges, rounds, tolerance)
    return found.select("host", (F.col("good") + F.col("rest") * F.col("heard_trust")).alias("trust"),
                        (F.col("bad") + F.col("rest") * F.col("heard_distrust")).alias("distrust"))


def judge(pages: DataFrame, rules=tuple(RULES), limit: float = 0.5, rounds: int | None = 20) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of every row of `pages` (page_id, url, html)."""
    host, path = split_url(F.col("url").cast("string"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"), F.col("html").cast("string").alias("html"))
    found = split.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    scores = host_scores(found.select("host", "html", F.col("found.verdict").alias("verdict")),
                         rounds)
    bad = F.col("distrust") > limit * F.greatest(F.lit(1.0), F.col("trust") + F.col("distrust"))
    return (found.drop("html").join(scores, "host", "left")
            .select("page_id", "host", "path", F.col("found.rule").alias("rule"),
                    F.coalesce("found.verdict", F.when(bad, "block").otherwise("allow")).alias("verdict"),
                    F.coalesce("trust", F.lit(0.0)).alias("trust"),
                    F.coalesce("distrust", F.lit(0.0)).alias("distrust")))
