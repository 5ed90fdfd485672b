"""URL filters: rules first, link-graph propagation for the rest.

A rule fits its host and all subdomains if the path starts with the rule's; the
longest fitting rule decides (of equally long ones the later in the list).
Pages without a rule are judged by their host.  Hosts are the nodes of a graph:

- a link is an edge from the page's host to the linked one; a link without a
  host (``/path``, ``#top``) stays on its own host, other schemes than those
  with ``//`` (``mailto:``) are no links;
- a host and its parent (all labels but the first, at least two) are joined
  both ways, parents without pages included.  Names of over 253 characters and
  numeric addresses have no parent.

Of the mass that leaves a host, ``STRUCTURE`` goes evenly to parent and
children and the rest over its links; all of it, where it has only one kind.
Personalised PageRank spreads trust from hosts with allowed pages along the
edges, and distrust from hosts with blocked pages against them, each in
proportion to such pages.  A host is blocked if its distrust is above its trust
by more than ``MARGIN`` times an even share of all mass (1 / hosts).  A host
that neither reaches is allowed.

The walk is summed as a series.  After ``ceil(log(tolerance) / log(damping))``
rounds at most ``tolerance`` of each kind's mass is still on its way, whatever
the graph, so there is no test of convergence.

A null url, or one without ``://``, has an empty host and path, fits no rule,
and is judged as the empty host.  Null html has no links.  Hosts are compared as
they stand, ports included.  Repeated rows count each; an empty table gives no
rows; extra columns are ignored; very long urls and pages are read whole.  Only
Spark expressions run here.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import discard, lookup_join, materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_S = r"[\x20\x09-\x0D]"
HREF = rf"(?i)<a{_S}[^>]*?href{_S}*={_S}*[\"']?{_S}*([^\"'\x20\x09-\x0D>]*)"
DAMPING, TOLERANCE, STRUCTURE, MARGIN = 0.7, 1e-4, 0.2, 1.0
#: Edges of a node that one task gets; a node with more is dealt over several.
HUB = 50_000
#: Rounds between two tables, which bound the plan and share one shuffle of the edges.
EVERY = 7
#: (verdict, host, path), as given.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def host_of(url: Column) -> Column:
    rest = F.substr(url, F.locate("://", url) + 3)
    return F.when(F.coalesce(F.locate("://", url), F.lit(0)) > 0, F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.substr(url, F.locate("://", url) + 3)
    return F.when(F.coalesce(F.locate("://", url), F.lit(0)) > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def links(pages: DataFrame) -> DataFrame:
    """src, dst and n of pages of host and html."""
    href = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("href"))
    named = F.translate(F.regexp_extract("href", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]+)", 1), UPPER, LOWER)
    other = F.rlike("href", F.lit(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:|//)"))
    dst = F.when(named != "", named).when(~other, F.col("src"))
    return href.select("src", dst.alias("dst")).filter("dst is not null").groupBy("src", "dst").agg(F.count("*").alias("n"))


def family(hosts: DataFrame) -> DataFrame:
    """child and parent, all the way up, of a column host."""
    named = hosts.filter((F.char_length("host") <= 253) & ~F.rlike("host", F.lit(r"(^|\.)[0-9]+(:[0-9]*)?$"))).select(F.split("host", r"\.").alias("l"))
    suffix = lambda at: F.array_join(F.slice("l", at, F.size("l")), ".")
    up = F.transform(F.sequence(F.lit(1), F.size("l") - 2), lambda i: F.struct(suffix(i).alias("child"), suffix(i + 1).alias("parent")))
    return named.filter(F.size("l") > 2).select(F.explode(up).alias("p")).select("p.*").distinct()


def walks(edges: DataFrame, related: DataFrame, structure: float = STRUCTURE) -> tuple[DataFrame, DataFrame]:
    """Edges a, salt, b, linked, joined, and what a node a gives to each: a, by_link, by_join, salts.

    A node is a host after "t" or "d", the kind of its mass.
    """
    both = edges.select("src", "dst", F.col("n").cast("double").alias("linked"), F.lit(0.0).alias("joined"))
    both = both.unionByName(related.select(F.col("child").alias("src"), F.col("parent").alias("dst"), F.lit(0.0).alias("linked"), F.lit(1.0).alias("joined")))
    both = both.unionByName(related.select(F.col("parent").alias("src"), F.col("child").alias("dst"), F.lit(0.0).alias("linked"), F.lit(1.0).alias("joined")))
    way = lambda k, a, b: F.struct(F.concat(F.lit(k), F.col(a)).alias("a"), F.concat(F.lit(k), F.col(b)).alias("b"))
    steps = both.select(F.explode(F.array(way("t", "src", "dst"), way("d", "dst", "src"))).alias("e"), "linked", "joined")
    steps = steps.groupBy("e.a", "e.b").agg(F.sum("linked").alias("linked"), F.sum("joined").alias("joined"))
    steps = materialise(steps, "url-steps")
    out = steps.groupBy("a").agg(F.sum("linked").alias("l"), F.sum("joined").alias("j"), F.ceil(F.count("*") / HUB).cast("int").alias("salts"))
    by_link = F.when(F.col("l") > 0, F.when(F.col("j") > 0, 1.0 - structure).otherwise(1.0) / F.col("l")).otherwise(0.0)
    by_join = F.when(F.col("j") > 0, F.when(F.col("l") > 0, structure).otherwise(1.0) / F.col("j")).otherwise(0.0)
    out = materialise(out.select("a", by_link.alias("by_link"), by_join.alias("by_join"), "salts"), "url-out")
    hubs = out.filter("salts > 1").select("a", "salts")
    salt = F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))).cast("int")
    dealt = lookup_join(steps, materialise(hubs, "url-hubs"), "a").select("a", salt.alias("salt"), "b", "linked", "joined")
    return dealt, out


def propagate(hosts: DataFrame, edges: DataFrame, tolerance: float = TOLERANCE, damping: float = DAMPING, structure: float = STRUCTURE) -> DataFrame:
    """host, trust and distrust of all hosts that either reaches, and nodes, the number of all.

    hosts: host, allowed, blocked (page counts).  edges: src, dst, n.
    """
    related = materialise(family(hosts.select("host").unionByName(edges.select(F.col("dst").alias("host"))).distinct()), "url-family")
    nodes = hosts.select("host").union(edges.select("dst")).union(related.select("parent")).distinct().count()
    seed = lambda k, c: F.struct(F.concat(F.lit(k), F.col("host")).alias("node"), F.lit(k).alias("kind"), F.col(c).cast("double").alias("n"))
    seeds = hosts.select(F.explode(F.array(seed("t", "allowed"), seed("d", "blocked"))).alias("s")).select("s.*").filter("n > 0")
    total = seeds.groupBy("kind").agg(F.sum("n").alias("all"))
    seeds = seeds.join(F.broadcast(total), "kind").select("node", (F.col("n") / F.col("all")).alias("moving"))
    steps, out = walks(edges, related, structure)
    state = materialise(seeds.select("node", "moving", F.col("moving").alias("total")), "url-state")
    written = state
    for i in range(1, math.ceil(math.log(tolerance) / math.log(damping)) + 1):
        # One row stays with the node's total; the others, one a salt, move on.  Nothing is read twice.
        told = state.join(out.withColumnRenamed("a", "node"), "node", "left")
        told = told.select(F.col("node").alias("a"), F.explode(F.sequence(F.lit(-1), F.coalesce("salts", F.lit(0)) - 1)).alias("salt"), "moving", "total", "by_link", "by_join")
        moved = F.coalesce(F.col("moving") * damping * (F.col("by_link") * F.col("linked") + F.col("by_join") * F.col("joined")), F.lit(0.0))
        gone = told.join(steps, ["a", "salt"], "left").select(F.coalesce("b", "a").alias("node"), moved.alias("moving"), F.when(F.col("salt") < 0, F.col("total")).otherwise(moved).alias("total"))
        state = gone.groupBy("node").agg(F.sum("moving").alias("moving"), F.sum("total").alias("total"))
        if i % EVERY == 0:
            state = materialise(state, "url-state")
            discard(written)
            written = state
    part = lambda k: F.sum(F.when(F.substring("node", 1, 1) == k, F.col("total")).otherwise(0.0)) * (1.0 - damping)
    scores = state.groupBy(F.substring("node", 2, 1 << 30).alias("host")).agg(part("t").alias("trust"), part("d").alias("distrust"))
    return scores.withColumn("nodes", F.lit(nodes))


def judge_pages(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, margin: float = MARGIN) -> DataFrame:
    """page_id, host, path, rule and verdict, host_trust and host_distrust; one row a page."""
    url = F.col("url")
    placed = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), "html")
    ruled = placed.withColumn("f", fitting_rule(F.col("host"), F.col("path"), rules))
    count = lambda v: F.count(F.when(F.col("f.verdict") == v, 1))
    hosts = materialise(ruled.groupBy("host").agg(count("allow").alias("allowed"), count("block").alias("blocked")), "url-hosts")
    scores = propagate(hosts, materialise(links(placed), "url-links"))
    above = F.round(F.col("distrust") - F.col("trust") - margin / F.col("nodes"), 9) > 0
    judged = materialise(scores.select("host", F.when(above, "block").otherwise("allow").alias("by_host"), F.round("trust", 9).alias("trust"), F.round("distrust", 9).alias("distrust")), "url-scores")
    both = lookup_join(ruled.drop("html"), judged, "host")
    return both.select(
        "page_id",
        "host",
        "path",
        F.col("f.rule").alias("rule"),
        F.coalesce(F.col("f.verdict"), F.col("by_host"), F.lit("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("host_trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("host_distrust"),
    )


def _rules_sql() -> str:
    """The longest fitting rule's column as CASE."""
    order = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    case = lambda at: " ".join(f"WHEN {fits(h, p)} THEN '{(v, h + p)[at]}'" for v, h, p in order)
    return f"CASE {case(1)} END AS rule, CASE {case(0)} END AS said"


ORACLE = rf"""
WITH RECURSIVE u AS (
  SELECT page_id, html, coalesce(instr(url, '://'), 0) AS spot, substr(url, instr(url, '://') + 3) AS rest FROM pages),
p AS (
  SELECT page_id, html, CASE WHEN spot > 0 THEN translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') ELSE '' END AS host,
         CASE WHEN spot > 0 THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM u),
r AS (SELECT page_id, host, path, {_rules_sql()} FROM p),
hosts AS (SELECT host, count(*) FILTER (said = 'allow') AS allowed, count(*) FILTER (said = 'block') AS blocked FROM r GROUP BY host),
href AS (SELECT host AS src, unnest(regexp_extract_all(html, '{HREF.replace("'", "''")}', 1)) AS href FROM p),
named AS (
  SELECT src, href, translate(regexp_extract(href, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]+)', 1), '{UPPER}', '{LOWER}') AS name FROM href),
links AS (
  SELECT src, dst, count(*) AS n
  FROM (SELECT src, CASE WHEN name <> '' THEN name WHEN NOT regexp_matches(href, '^(?:[A-Za-z][A-Za-z0-9+.-]*:|//)') THEN src END AS dst FROM named) x
  WHERE dst IS NOT NULL GROUP BY src, dst),
label AS (
  SELECT DISTINCT string_split(host, '.') AS l FROM (SELECT host FROM hosts UNION SELECT dst FROM links) h
  WHERE length(host) <= 253 AND NOT regexp_matches(host, '(^|\.)[0-9]+(:[0-9]*)?$')),
family AS (
  SELECT DISTINCT array_to_string(l[i:], '.') AS child, array_to_string(l[i + 1:], '.') AS parent
  FROM (SELECT l, unnest(range(1, len(l) - 1)) AS i FROM label WHERE len(l) > 2) s),
nodes AS (SELECT count(*) AS nodes FROM (SELECT host FROM hosts UNION SELECT dst FROM links UNION SELECT parent FROM family) h),
edge AS (
  SELECT src, dst, CAST(n AS DOUBLE) AS linked, 0e0 AS joined FROM links
  UNION ALL SELECT child, parent, 0e0, 1e0 FROM family UNION ALL SELECT parent, child, 0e0, 1e0 FROM family),
step AS (
  SELECT kind, a, b, sum(linked) AS linked, sum(joined) AS joined
  FROM (SELECT 't' AS kind, src AS a, dst AS b, linked, joined FROM edge UNION ALL SELECT 'd', dst, src, linked, joined FROM edge) e GROUP BY kind, a, b),
share AS (
  SELECT kind, a, b,
         CASE WHEN l > 0 THEN linked / l * CASE WHEN j > 0 THEN {1 - STRUCTURE} ELSE 1e0 END ELSE 0e0 END
       + CASE WHEN j > 0 THEN joined / j * CASE WHEN l > 0 THEN {STRUCTURE}e0 ELSE 1e0 END ELSE 0e0 END AS share
  FROM (SELECT *, sum(linked) OVER (PARTITION BY kind, a) AS l, sum(joined) OVER (PARTITION BY kind, a) AS j FROM step) s),
seed AS (
  SELECT 't' AS kind, host, allowed / CAST(sum(allowed) OVER () AS DOUBLE) AS m FROM hosts WHERE allowed > 0
  UNION ALL SELECT 'd', host, blocked / CAST(sum(blocked) OVER () AS DOUBLE) FROM hosts WHERE blocked > 0),
walk AS (
  SELECT 0 AS k, kind, host, m FROM seed
  UNION ALL
  SELECT w.k + 1, w.kind, s.b, sum(w.m * {DAMPING}e0 * s.share) FROM walk w JOIN share s ON s.kind = w.kind AND s.a = w.host
  WHERE w.k < {math.ceil(math.log(TOLERANCE) / math.log(DAMPING))} GROUP BY w.k, w.kind, s.b),
score AS (
  SELECT host, coalesce(sum(m) FILTER (kind = 't'), 0) * (1e0 - {DAMPING}e0) AS trust, coalesce(sum(m) FILTER (kind = 'd'), 0) * (1e0 - {DAMPING}e0) AS distrust
  FROM walk GROUP BY host)
SELECT r.page_id, r.host, r.path, r.rule,
       coalesce(r.said, CASE WHEN round(s.distrust - s.trust - {MARGIN}e0 / (SELECT nodes FROM nodes), 9) > 0 THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(round(s.trust, 9), 0e0) AS host_trust, coalesce(round(s.distrust, 9), 0e0) AS host_distrust
FROM r LEFT JOIN score s ON s.host = r.host
"""
