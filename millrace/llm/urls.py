"""URL filter: rules, and trust and distrust propagated over links between hosts (operator 2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import checkpointed, salted

UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HREF = r"""(?i)href\s*+=\s*+["']?(?:[a-z][a-z0-9+.-]*+:)?//([^/?#"'>\s]++)"""

# (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def lowered(c: Column) -> Column:
    return F.translate(c, UPPER, LOWERED)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty for a null or one without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return lowered(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting(host: Column, path: Column, rules) -> Column:
    """The longest rule that fits, as a struct (rule, verdict), or null."""
    out = F.lit(None)
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_links(pages: DataFrame) -> DataFrame:
    """src, dst, n: how many links lead from one host's pages to another host; relative links and those within a host don't count."""
    found = pages.select(F.col("host").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(HREF)))).alias("dst"))
    return found.select("src", lowered(F.col("dst")).alias("dst")).where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagated(hosts: DataFrame, links: DataFrame, damping: float = 0.85, rounds: int = 20, tolerance: float = 1e-4, shares: bool = False) -> DataFrame:
    """host, trust, distrust: personalised PageRank from seeds, trust along links, distrust against them.

    hosts: host, good and bad (seed weights, 0 to 1). A host passes its trust on in proportion to its links, and
    its distrust to those who link to it in proportion to theirs. With `shares` nothing is divided among receivers:
    a host's distrust is that of the hosts it links to, averaged over its links, and its trust that of the hosts
    that link to it, averaged over theirs; so neither depends on how many others link alike. Ends after `rounds`, or once no score changes
    by more than `tolerance`; each round is one join and one aggregation over the links, and is written.
    """
    out = links.groupBy("src").agg(F.sum("n").alias("out"))
    into = links.groupBy("dst").agg(F.sum("n").alias("into"))
    gives, takes = ("into", "out") if shares else ("out", "into")
    edges = checkpointed(links.join(out, "src").join(into, "dst").select("src", "dst", (F.col("n") / F.col(gives)).alias("gives"), (F.col("n") / F.col(takes)).alias("takes")))
    nodes = hosts.select("host", "good", "bad").union(edges.select(F.explode(F.array("src", "dst")).alias("host"), F.lit(0.0), F.lit(0.0)))
    seeds = checkpointed(nodes.groupBy("host").agg(F.max("good").alias("good"), F.max("bad").alias("bad")))
    now = seeds.select("host", "good", "bad", (F.col("good") * (1 - damping)).alias("trust"), (F.col("bad") * (1 - damping)).alias("distrust"))
    if edges.isEmpty():
        return now.select("host", "trust", "distrust")
    for _ in range(rounds):
        forth = edges.join(now, edges["src"] == now["host"]).select(F.col("dst").alias("host"), (F.col("trust") * F.col("gives")).alias("t"), F.lit(0.0).alias("d"))
        back = edges.join(now, edges["dst"] == now["host"]).select(F.col("src").alias("host"), F.lit(0.0).alias("t"), (F.col("distrust") * F.col("takes")).alias("d"))
        sums = forth.union(back).groupBy("host").agg((F.sum("t") * damping).alias("t"), (F.sum("d") * damping).alias("d"))
        fresh = now.join(sums, "host", "left").select("host", "good", "bad", (F.col("good") * (1 - damping) + F.coalesce("t", F.lit(0.0))).alias("trust"), (F.col("bad") * (1 - damping) + F.coalesce("d", F.lit(0.0))).alias("distrust"), F.col("trust").alias("t0"), F.col("distrust").alias("d0"))
        fresh = checkpointed(fresh)
        moved = fresh.agg(F.max(F.greatest(F.abs(F.col("trust") - F.col("t0")), F.abs(F.col("distrust") - F.col("d0"))))).first()[0]
        now = fresh.drop("t0", "d0")
        if moved is None or moved <= tolerance:
            break
    return now.select("host", "trust", "distrust")


def filter_urls(pages: DataFrame, rules=RULES, least: float = 0.1) -> DataFrame:
    """page_id, host, path, rule and verdict of every page; then the host's trust and distrust.

    A page that a rule fits gets the rule's verdict. The others get their host's: block if its distrust by shares
    (see propagated) is `least` or more and its distrust exceeds its trust, else allow. A host's seed weights are the shares of its pages that rules allow
    and block. A null url, or one without ://, has empty host and path and is allowed; null html has no links;
    rows that repeat are judged one by one; an empty table gives no rows; other columns are left out.
    """
    host, path = split_url(F.col("url"))
    parsed = pages.select("page_id", "html", host.alias("host"), path.alias("path"))
    parsed = parsed.withColumn("fit", fitting(F.col("host"), F.col("path"), rules))
    share = lambda v: F.avg(F.coalesce((F.col("fit.verdict") == v).cast("double"), F.lit(0.0)))
    hosts = parsed.where("host <> ''").groupBy("host").agg(share("allow").alias("good"), share("block").alias("bad"))
    links = checkpointed(host_links(parsed))
    by_share = propagated(hosts, links, shares=True).select("host", F.col("distrust").alias("share"))
    scores = propagated(hosts, links).join(by_share, "host")
    method = F.when((F.col("share") >= least) & (F.col("distrust") > F.col("trust")), "block").otherwise("allow")
    return salted(parsed.drop("html"), scores, ["host"], "page_id", how="left").select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.verdict"), method).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
