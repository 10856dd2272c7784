"""URL filter: rules by host and path, and trust and distrust propagated over the host graph.

Pages that a rule decides are the seeds: the share of a host's pages that rules allow is its seed
of trust, the share they block its seed of distrust. Trust flows along the links from host to host
(personalised PageRank from the trusted seeds); distrust flows against them (the same on the
reversed graph from the blocked seeds), since a host that links to blocked hosts earns it. A host
is blocked where its distrust exceeds its trust by a threshold.

Scores are integers, in billionths of the seed of a host all of whose pages are decided alike, so
that a sum does not depend on the order of its parts. Mass at hosts without links leaves the graph;
handing it back to the seeds, as is also usual, would scale all scores of a side alike.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.llm.common import stored

UNIT = 1_000_000_000
DAMPING = 85
# power iteration leaves at most this part of the seeds' mass undistributed
TOLERANCE = 0.04
# the only host that links to a wholly blocked one gets past it (0.85 of a seed); many that do share that mass
THRESHOLD = 3 * UNIT // 4
# how many links the tie between a host and its domain counts for
KIN = 1
ROUNDS_WRITTEN = 4

# fixed values: the longest host name of the DNS; a link to a host in an attribute
LONGEST_HOST = 253
LINK = r"""[\x09-\x0D\x20][hH][rR][eE][fF][\x09-\x0D\x20]*+=[\x09-\x0D\x20]*+["']?+[\x09-\x0D\x20]*+(?:[hH][tT][tT][pP][sS]?:)?//([^/?#"'<>\x09-\x0D\x20]+)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


# fixed values of the registered query
RULES = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"),
         Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))


def rounds(damping: int = DAMPING, tolerance: float = TOLERANCE) -> int:
    """How many rounds bring the undistributed mass below the tolerance."""
    return math.ceil(math.log(tolerance) / math.log(damping / 100))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, and what follows up to ``?`` or ``#``.

    Both are empty where the url is null or holds no ``://``. Host letters A-Z become lower case.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(raw) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(raw, _UPPER, _LOWER), path


def matched(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(page_id, html, host, path, rule, ruled): the rule that fits and its verdict, or nulls.

    A rule fits its host and all subdomains if the path starts with the rule's. The longest rule,
    host and path together, wins; of equally long ones that with the longer host, then a blocking
    one. The rules become one expression of the plan: meant for hundreds of them.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    plain = (pages.select(F.col("page_id"), F.col("html").cast("string").alias("html"), host.alias("host"), path.alias("path")))
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), len(r.host), r.verdict == "block")):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        rule, ruled = F.when(fits, r.host + r.path).otherwise(rule), F.when(fits, r.verdict).otherwise(ruled)
    return plain.withColumns({"rule": rule, "ruled": ruled})


def links(pages: DataFrame) -> DataFrame:
    """(src, dst, w): how many pages of a host link to another host; relative links stay on their host."""
    target = F.explode(F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), 1), lambda h: F.translate(h, _UPPER, _LOWER))))
    return (pages.filter((F.col("host") != "") & F.col("html").contains("//")).select(F.col("host").alias("src"), target.alias("dst"))
            .filter("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("w")))


def kinship(hosts: DataFrame) -> DataFrame:
    """(src, dst, w): links both ways between each host or domain and the domain above it, down to two labels.

    So hosts of one domain reach each other through it, the less the more of them there are.
    """
    labels = F.split("host", r"\.")
    domain = lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), ".")
    steps = F.transform(F.sequence(F.lit(1), F.size(labels) - 2), lambda i: F.struct(domain(i).alias("low"), domain(i + 1).alias("high")))
    pairs = (hosts.filter(F.length("host").between(1, LONGEST_HOST) & (F.size(labels) > 2))
             .select(F.explode(steps).alias("s")).select("s.*").distinct())
    both = F.explode(F.array(F.struct(F.col("low").alias("src"), F.col("high").alias("dst")),
                             F.struct(F.col("high").alias("src"), F.col("low").alias("dst"))))
    return pairs.select(both.alias("e")).select("e.src", "e.dst", F.lit(KIN).cast("bigint").alias("w"))


def propagated(seeds: DataFrame, edges: DataFrame, n_rounds: int) -> DataFrame:
    """(host, trust, distrust): the seeds' masses after so many rounds of power iteration.

    ``seeds`` holds (host, trust, distrust), ``edges`` (src, dst, w). Both sides run in the same
    rounds as rows of one table. Contributions are summed before the shuffle; a host with a third
    of all links is split by the skew join. The table is written every few rounds, which ends the
    lineage.
    """
    ends = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("src").alias("src"), F.col("dst").alias("dst")),
                             F.struct(F.lit(1).alias("side"), F.col("dst").alias("src"), F.col("src").alias("dst"))))
    arcs = edges.groupBy("src", "dst").agg(F.sum("w").alias("w")).select(ends.alias("e"), "w").select("e.*", "w")
    out = arcs.groupBy("side", "src").agg(F.sum("w").alias("out"))
    arcs = stored(arcs.join(out, ["side", "src"]), "url-arcs")
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("trust").alias("x")),
                              F.struct(F.lit(1).alias("side"), F.col("distrust").alias("x"))))
    seed = stored(seeds.select("host", sides.alias("s")).select("s.side", "host", "s.x").filter("x > 0"), "url-seeds")
    moved = f"CAST(x AS DECIMAL(20,0)) * CAST(w * {DAMPING} AS DECIMAL(18,0)) div CAST(out * 100 AS DECIMAL(18,0))"
    now = seed
    for i in range(1, n_rounds + 1):
        given = arcs.join(now.withColumnRenamed("host", "src"), ["side", "src"]).select("side", F.col("dst").alias("host"), F.expr(moved).alias("x"))
        now = seed.unionByName(given).groupBy("side", "host").agg(F.sum("x").alias("x"))
        if i % ROUNDS_WRITTEN == 0 or i == n_rounds:
            now = stored(now, "url-round")
    return now.groupBy("host").agg(F.coalesce(F.sum(F.expr("CASE WHEN side = 0 THEN x END")), F.lit(0)).alias("trust"),
                                   F.coalesce(F.sum(F.expr("CASE WHEN side = 1 THEN x END")), F.lit(0)).alias("distrust"))


def scores(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(host, trust, distrust) of every host that pages stand on or link to and that any mass reaches."""
    of_pages = stored(matched(pages, rules).select("host", "ruled", "html"), "url-ruled")
    share = lambda v: F.expr(f"count_if(ruled = '{v}') * CAST({UNIT} AS BIGINT) div count(*)")
    seeds = (of_pages.filter("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust")))
    seeds, linked = stored(seeds, "url-hosts"), stored(links(of_pages), "url-links")
    hosts = seeds.select("host").union(linked.select("dst")).distinct()
    return propagated(seeds, linked.unionByName(kinship(hosts)), rounds())


def judged(pages: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: int = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust), one row per row of ``pages``.

    The verdict is that of the rule, else ``block`` where the host's distrust exceeds its trust by
    at least ``threshold``, else ``allow``; so a host that nothing reaches, and a page without a
    host, is allowed. Nulls in any column are kept as they are; repeated rows count as so many
    pages; an empty table gives no rows; other columns of the input play no part.
    """
    found = scores(pages, rules)
    plain = matched(pages.select("page_id", "url", F.lit(None).cast("string").alias("html")), rules).drop("html")
    verdict = F.coalesce("ruled", F.when(F.col("distrust") - F.col("trust") >= threshold, "block").otherwise("allow"))
    return (plain.join(stored(found, "url-scores"), "host", "left")
            .withColumns({"trust": F.coalesce("trust", F.lit(0)), "distrust": F.coalesce("distrust", F.lit(0))})
            .select("page_id", "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust"))
