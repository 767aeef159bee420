r"""URL filters: rules first, then trust and distrust propagated over the hosts' link graph.

A rule is host and path; it fits its host and all subdomains if the URL's path starts with the rule's, and the longest rule
that fits decides. Every host with a page that a rule judges is a seed: of trust with the share of its own pages that are allowed, of
distrust with the share that are blocked, so a host's size doesn't count. Links of the pages' ``a`` elements become weighted host edges in one
grouped count. Personalised PageRank walks the edges from the trusted seeds, and the reversed edges from the blocked ones (a host
that links to bad hosts is suspect), until what is still on its way is less than ``TOLERANCE`` of what an average host has; ``trust`` and ``distrust`` of all hosts sum up to the seeds' shares. Where no rule says otherwise, a
host is blocked if it has more distrust than trust and at least ``MARGIN`` of an average host's distrust: a seed's own pages count as the mass with which its walk begins, and nowhere else.
``decided_by`` tells what gave a verdict: a rule, the rank of a seed, the rank that links brought, or, without any rank, nothing.

All tables are by host: pages are read once for links and once for verdicts, and the host table is broadcast only if it is counted to be
small; otherwise the join shuffles and adaptive execution splits a host with a third of all pages. Both walks run in the same
rounds, each round a join and a grouped sum over the mass that still moves, stored in the shared folder. Edges lie in buckets by where they start, so only the moving mass is exchanged.

Defined results: a null URL or one without ``://`` has empty host and path, no rule, and the method's verdict for the
empty host; null html has no links; links of a host to itself don't count; repeated rows are judged alike and count as pages; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import broadcast_if_small, discard, stored, stored_by

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
MARGIN = 1.0
DAMPING = 0.85
TOLERANCE = 1e-3
_COMMENT = r"(?s)<!--.*?(?:-->|\z)"
_LINK = r"""(?i)<a\s(?:[^>]*?(?<![\w-]))?href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rules_of_hosts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host) -> (host, rules: array of (path, rule, verdict), longest first) for hosts that some rule's host fits."""
    labels = F.split("host", r"\.")
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("rule_host")
    fits = hosts.select("host", suffix).join(broadcast_if_small(rules), "rule_host")
    ordered = F.sort_array(F.collect_set(F.struct(F.length("rule").alias("n"), "rule", "path", "verdict")), asc=False)
    return fits.groupBy("host").agg(ordered.alias("rules"))


def walk(edges: DataFrame, seeds: DataFrame, least: float, damping: float = DAMPING) -> DataFrame:
    """(kind, host, rank) stored: personalised PageRank of each kind; edges (kind, source, target, share), seeds (kind, host, weight) with sum 1.

    A round moves the mass of the one before along the edges, damped; a host's rank is the sum of all that came by. Mass of hosts without links
    is lost and returns to the seeds in proportion, which scales all ranks of a kind alike, so they are scaled to the sum 1 at the end.
    Rounds end when less than ``least`` of the mass is still to come. A round leaves ``damping`` of the mass at most, as shares of a source sum up to 1, so
    log(least) / log(damping) rounds always suffice: about 170 for a thousand million hosts.
    """
    place = lambda host: F.concat_ws(" ", "kind", host)
    lying = stored_by(edges.select(place("source").alias("at"), "kind", "target", "share"), "edges", "at")
    moving = [stored(seeds.select("kind", "host", F.col("weight").alias("mass")), "moving")]
    while True:
        last = moving[-1]
        left = last.groupBy("kind").agg(F.sum("mass").alias("mass")).agg(F.max("mass")).first()[0] or 0.0
        if left * damping / (1 - damping) < least:
            break
        sent = lying.join(last.select(place("host").alias("at"), "mass"), "at")
        moving.append(stored(sent.groupBy("kind", F.col("target").alias("host")).agg((F.sum(F.col("mass") * F.col("share")) * damping).alias("mass")), "moving"))
    came = moving[0]
    for more in moving[1:]:
        came = came.union(more)
    rank = stored(came.groupBy("kind", "host").agg(F.sum("mass").alias("mass")), "came")
    discard(lying, *moving)
    total = rank.groupBy("kind").agg(F.sum("mass").alias("total")).withColumnRenamed("kind", "of")
    return rank.join(F.broadcast(total), F.col("kind") == F.col("of")).select("kind", "host", (F.col("mass") / F.col("total")).alias("rank"))  # two rows at most


def host_verdicts(pages: DataFrame, judged: DataFrame, margin: float = MARGIN) -> DataFrame:
    """(host, trust, distrust, host_verdict, evidence) for each host of ``judged`` (host, rule_verdict)."""
    hosts = stored(
        judged.groupBy("host").agg(
            F.count(F.lit(1)).alias("pages"),
            F.sum(F.when(F.col("rule_verdict") == "allow", 1).otherwise(0)).alias("allowed"),
            F.sum(F.when(F.col("rule_verdict") == "block", 1).otherwise(0)).alias("blocked"),
        ),
        "hosts",
    )
    marked = hosts.select(
        "host", F.explode(F.array(F.struct(F.lit("trust").alias("kind"), F.col("allowed").alias("n")), F.struct(F.lit("distrust").alias("kind"), F.col("blocked").alias("n")))).alias("s"), "pages"
    ).where("s.n > 0").select("host", "s.kind", (F.col("s.n") / F.col("pages")).alias("part"))
    totals = {r["kind"]: r["part"] for r in marked.groupBy("kind").agg(F.sum("part").alias("part")).collect()}
    weight = F.lit(0.0)
    for kind, part in totals.items():
        weight = F.when(F.col("kind") == kind, F.col("part") / part).otherwise(weight)
    seeds = stored(marked.select("kind", "host", weight.alias("weight")), "seeds")
    links = stored(
        pages.select(host_of(F.col("url")).alias("source"), F.explode(F.regexp_extract_all(F.regexp_replace("html", _COMMENT, ""), F.lit(_LINK), F.lit(1))).alias("target"))
        .select("source", F.translate("target", UPPER, UPPER.lower()).alias("target"))
        .where("source <> target AND source <> ''")
        .groupBy("source", "target").agg(F.count(F.lit(1)).alias("n")),
        "links",
    )
    both = links.select(F.lit("trust").alias("kind"), "source", "target", "n").union(links.select(F.lit("distrust"), "target", "source", "n"))
    out = both.groupBy("kind", F.col("source").alias("of")).agg(F.sum("n").alias("total"))
    edges = both.join(out.withColumnRenamed("kind", "k"), (F.col("kind") == F.col("k")) & (F.col("source") == F.col("of"))).select("kind", "source", "target", (F.col("n") / F.col("total")).alias("share"))
    n_hosts = hosts.count()
    rank = walk(edges, seeds, TOLERANCE / max(n_hosts, 1)).groupBy("host").agg(
        *[(F.sum(F.when(F.col("kind") == kind, F.col("rank")).otherwise(0.0)) * totals.get(kind, 0.0)).alias(kind) for kind in ("trust", "distrust")]
    )
    joined = hosts.join(rank, "host", "left").withColumns({kind: F.coalesce(kind, F.lit(0.0)) for kind in ("trust", "distrust")})
    led = (F.col("distrust") > F.col("trust")) & (F.col("distrust") * n_hosts >= margin * totals.get("distrust", 0.0))
    evidence = F.when(F.col("allowed") + F.col("blocked") > 0, "seed").when((F.col("trust") > 0) | (F.col("distrust") > 0), "links").otherwise("nothing")
    return joined.select("host", "trust", "distrust", F.when(led, "block").otherwise("allow").alias("host_verdict"), evidence.alias("evidence"))


def filter_urls(pages: DataFrame, rules=RULES, margin: float = MARGIN) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust, decided_by), a row for each row of ``pages`` (page_id, url, html); ``rules``: (verdict, host, path), one or more."""
    literal = lambda v, h, p: F.struct(F.lit(h).alias("rule_host"), F.lit(p).alias("path"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))
    rule_table = stored(pages.sparkSession.range(1).select(F.inline(F.array(*[literal(*r) for r in rules]))), "rules")
    named = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    by_host = stored(rules_of_hosts(named.select("host").distinct(), rule_table), "host-rules").withColumnRenamed("host", "of")
    first = F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"]))
    judged = named.join(broadcast_if_small(by_host), F.col("host") == F.col("of"), "left").withColumn("hit", F.get(first, F.lit(0))).select(
        "page_id", "host", "path", F.col("hit.rule").alias("rule"), F.col("hit.verdict").alias("rule_verdict")
    )
    verdicts = stored(host_verdicts(pages, judged.select("host", "rule_verdict"), margin), "verdicts").withColumnRenamed("host", "of")
    return judged.join(broadcast_if_small(verdicts), F.col("host") == F.col("of")).select(
        "page_id", "host", "path", "rule", F.coalesce("rule_verdict", "host_verdict").alias("verdict"), "trust", "distrust", F.when(F.col("rule").isNotNull(), "rule").otherwise(F.col("evidence")).alias("decided_by")
    )


def op9_url_filter(spark, sf_dir):
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
