"""Operator 10: URL filters: rules first, then trust and distrust propagated over the host link graph.

Rules are (verdict, host, path): a rule fits its host and all subdomains where the url's path starts with its path; the
longest fitting rule wins. Urls that no rule judges get their host's verdict: personalised PageRank from trusted seeds
along links, and from blocked seeds along reversed links (who links to blocked hosts is distrusted). Seeds are hosts
with pages that rules allow or block, weighted by those pages. A host is blocked where its distrust exceeds both its
trust and `threshold` times the mean; all others, the unreached included, are allowed.

Ranks settle to a tolerance, whatever the length of the paths between hosts; nothing is cut after a number of links.

Null urls and urls without "://" have empty host and path and get "allow" unless a rule fits. Null html has no links.
Repeated pages count as often as they come; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm.common import Scratch, read_table

RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
DAMPING, THRESHOLD = 0.85, 1.0
#: Ranks have settled where they move less than this in a round, all together; more rounds than ROUNDS are an error.
TOLERANCE, ROUNDS = 1e-7, 300
#: Host of each absolute or protocol-relative link.
LINK = r"(?i)<a\s[^>]*?href\s*=\s*[\"']?(?:https?:)?//([^/?#\"'\s>]+)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """struct(rule, verdict) of the longest fitting rule, null where none fits. Rules are a short list, not a table."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, own, start in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(own + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, links): links between different hosts, aggregated per partition before the shuffle."""
    linked = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), 1)).alias("dst"))
    return linked.withColumn("dst", F.translate("dst", UPPER, LOWER)).where("src <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("links"))


def propagate(nodes: DataFrame, edges: DataFrame, scratch: Scratch, damping: float = DAMPING, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """Ranks (host, trust, distrust) of nodes (host, trusted, blocked: restart shares).

    A walk restarts with probability 1 - damping; at a host without links it ends. Each round joins ranks with edges that
    carry their out-share, which is one row per pair of hosts, and sums per target before the shuffle. Rounds go on until
    the ranks have settled, which takes about log(tolerance) / log(damping) of them.
    """
    out, back = edges.groupBy("src").agg(F.sum("links").alias("n")), edges.groupBy("dst").agg(F.sum("links").alias("m"))
    steps = edges.join(out, "src").join(back, "dst").select("src", "dst", (F.col("links") / F.col("n")).alias("ahead"), (F.col("links") / F.col("m")).alias("reverse"))
    steps = scratch.save(steps, "steps")
    ranks = nodes.select("host", (F.col("trusted") * (1 - damping)).alias("trust"), (F.col("blocked") * (1 - damping)).alias("distrust"), "trusted", "blocked")
    if steps.isEmpty():
        return ranks.select("host", "trust", "distrust")
    ranks = scratch.save(ranks, "ranks0")
    for k in range(1, rounds + 1):
        ahead = steps.join(ranks, steps.src == ranks.host).select(F.col("dst").alias("host"), (F.col("trust") * F.col("ahead")).alias("_t"), F.lit(0.0).alias("_d"))
        reverse = steps.join(ranks, steps.dst == ranks.host).select(F.col("src").alias("host"), F.lit(0.0).alias("_t"), (F.col("distrust") * F.col("reverse")).alias("_d"))
        flow = ahead.unionByName(reverse).groupBy("host").agg(F.sum("_t").alias("_t"), F.sum("_d").alias("_d"))
        after = ranks.join(flow, "host", "left").select(
            "host", (F.col("trusted") * (1 - damping) + damping * F.coalesce("_t", F.lit(0.0))).alias("trust"),
                (F.col("blocked") * (1 - damping) + damping * F.coalesce("_d", F.lit(0.0))).alias("distrust"),
            "trusted", "blocked", (F.abs(F.col("trust") - (F.col("trusted") * (1 - damping) + damping * F.coalesce("_t",
                F.lit(0.0)))) + F.abs(F.col("distrust") - (F.col("blocked") * (1 - damping) + damping * F.coalesce("_d", F.lit(0.0))))).alias("_moved"),
        )
        after = scratch.save(after, f"ranks{k}")
        moved = after.agg(F.sum("_moved")).first()[0] or 0.0
        ranks = after.drop("_moved")
        if k > 1:
            scratch.drop(f"ranks{k - 2}")
        if moved < tolerance:
            break
    else:
        raise RuntimeError(f"ranks did not settle in {rounds} rounds")
    return ranks.select("host", "trust", "distrust")


def judge(pages: DataFrame, scratch: Scratch, rules: tuple[tuple[str, str, str], ...] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict of pages (page_id, url, html)."""
    placed = pages.select("page_id", "html", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    placed = placed.withColumn("_rule", longest_rule(F.col("host"), F.col("path"), rules))
    judged = placed.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.col("_rule.verdict").alias("_verdict"))
    edges = scratch.save(host_edges(placed), "edges")
    hosts = judged.groupBy("host").agg(F.count_if(F.col("_verdict") == "allow").alias("a"), F.count_if(F.col("_verdict") == "block").alias("b"))
    known = scratch.save(hosts.unionByName(edges.select(F.col("dst").alias("host"), F.lit(0).cast("long").alias("a"),
        F.lit(0).cast("long").alias("b"))).groupBy("host").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "hosts")
    total = known.agg(F.sum("a"), F.sum("b"), F.count("*")).first()
    n = total[2] or 1
    nodes = known.select("host", (F.col("a") / F.lit(float(total[0] or 1))).alias("trusted"), (F.col("b") / F.lit(float(total[1] or 1))).alias("blocked"))
    ranks = propagate(nodes, edges, scratch)
    bad = ranks.where((F.col("distrust") > F.col("trust")) & (F.col("distrust") > threshold / n * (1 - DAMPING)) & (F.col("host") != "")).select("host", F.lit(True).alias("_bad"))
    return judged.join(bad, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("_verdict", F.when(F.col("_bad"), "block").otherwise("allow")).alias("verdict"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "pages"), Scratch(spark, "url-filter"))
