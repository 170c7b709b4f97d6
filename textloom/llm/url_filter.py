"""URL filters: rules, and trust and distrust propagated over the host graph, with DataFrame functions only.

Rules name a host and a path. Pages that no rule fits get a verdict from their host's scores:
trust starts at pages that rules allow and follows the links between hosts; distrust starts at
pages that rules block and follows them backwards, to those who link there. Both are personalised
PageRank in units of pages: a host's score is its own seed pages and the damped scores that reach
it. Links within a host are no votes.
"""

from __future__ import annotations

import itertools
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import cut, hub_bound, hub_join, sheltered, spread_join, unsheltered

# Verdict, host and path of each rule.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: ``ROUNDS`` is what the SQL spells out; the operator goes on until scores settle.
DAMPING, ROUNDS = 0.85, 10
#: Scores have settled when none moves by more than this in a round, for each of its host's pages.
TOLERANCE = 1e-6
#: A host is blocked from so much distrust for each of its pages on, if that is more than its trust.
BLOCK_AT = 0.5
#: Lineage is cut after so many rounds.
CUT_EVERY = 5
LINK = r"""(?is)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, "(?s)://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits; null if none does."""
    fits = [(v, h, p) for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r))]
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in reversed(fits):
        own = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(own, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_edges(pages: DataFrame, host: str, html: str) -> DataFrame:
    """(src, dst, n) of the links from host to host; links without a host and to the own one are left out."""
    links = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(LINK), F.lit(1))
    target = lambda x: F.when(x.contains("://"), host_of(x)).when(x.startswith("//"), host_of(F.concat(F.lit("x:"), x)))
    found = pages.select(F.col(host).alias("src"), F.explode(F.transform(links, target)).alias("dst"))
    return found.filter(F.col("dst") != F.col("src")).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int | None = None) -> DataFrame:
    """(host, trust, distrust) from edges (src, dst, n) and seeds (host, good, bad).

    In each round a host's trust goes, damped, to those it links to by their share of its links,
    and its distrust to those that link to it by their share of the links to it; the host's own
    seed is added anew. Hosts that are only linked to take part with no seed. Without ``rounds``,
    it goes on until no score moves by more than ``TOLERANCE`` for each of the host's ``pages``
    (one where seeds don't have them); damping makes moves smaller by each round.

    A hub's edges are in parts of a bounded number, among which its scores are repeated, so no task
    gets all edges of a host; what reaches a host is summed up before it is shuffled.
    """
    edges = cut(edges)
    total = edges.count()
    out = cut(edges.groupBy(F.col("src").alias("_h")).agg(F.sum("n").alias("_out"), F.count(F.lit(1)).alias("_rows")))
    into = cut(edges.groupBy(F.col("dst").alias("_i")).agg(F.sum("n").alias("_in"), F.count(F.lit(1)).alias("_rows")))
    shared = hub_join(cut(hub_join(edges, out, "src", "_h", "_rows", total)), into, "dst", "_i", "_rows", total)
    ahead = shared.select(F.col("src").alias("from"), F.col("dst").alias("to"), (F.col("n") / F.col("_out")).alias("t"), F.lit(0.0).alias("d"))
    back = shared.select(F.col("dst").alias("from"), F.col("src").alias("to"), F.lit(0.0).alias("t"), (F.col("n") / F.col("_in")).alias("d"))
    flows = cut(ahead.union(back).groupBy("from", "to").agg(F.sum("t").alias("t"), F.sum("d").alias("d")))
    bound = hub_bound(2 * total)
    hubs = flows.groupBy(F.col("from").alias("_hub")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= bound)
    hubs = cut(hubs.select("_hub", F.ceil(F.col("_n") / bound).cast("int").alias("_parts")))  # at most BROADCAST_ROWS
    part = F.pmod(F.xxhash64("to"), F.coalesce("_parts", F.lit(1))).cast("int").alias("part")
    flows = cut(flows.join(F.broadcast(hubs), F.col("from") == F.col("_hub"), "left").select("from", part, "to", "t", "d"))
    hosts = seeds.select("host").union(edges.select("src")).union(edges.select("dst")).distinct()
    start = hosts.join(seeds.withColumnRenamed("host", "_host"), F.col("host") == F.col("_host"), "left")
    pages = F.coalesce("pages", F.lit(1)) if "pages" in seeds.columns else F.lit(1)
    start = start.join(F.broadcast(hubs), F.col("host") == F.col("_hub"), "left")
    start = cut(start.select("host", F.coalesce("_parts", F.lit(1)).alias("_parts"), *(F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("good", "bad")), F.greatest(pages, F.lit(1)).alias("_pages")))
    scores = start.select("host", "_parts", F.col("good").alias("trust"), F.col("bad").alias("distrust"))
    moved = lambda seed, flow: F.col(seed) + F.coalesce(flow, F.lit(0.0)) * damping
    for k in range(1, rounds + 1) if rounds is not None else itertools.count(1):
        repeated = scores.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        sent = flows.join(repeated, (F.col("from") == F.col("host")) & (F.col("part") == F.col("_part"))).groupBy("to").agg(F.sum(F.col("t") * F.col("trust")).alias("_t"), F.sum(F.col("d") * F.col("distrust")).alias("_d"))
        before, scores = scores, start.join(sent, F.col("host") == F.col("to"), "left").select("host", "_parts", moved("good", "_t").alias("trust"), moved("bad", "_d").alias("distrust"))
        if k % CUT_EVERY == 0 and k != rounds:
            scores = cut(scores)
            if rounds is None and settled(before, scores, start):
                break
    return scores.drop("_parts")


def settled(before: DataFrame, after: DataFrame, start: DataFrame) -> bool:
    old = before.select(F.col("host").alias("_old"), F.col("trust").alias("_t"), F.col("distrust").alias("_d"))
    both = after.join(old, F.col("host") == F.col("_old")).join(start.select(F.col("host").alias("_own"), "_pages"), F.col("host") == F.col("_own"))
    move = F.greatest(F.abs(F.col("trust") - F.col("_t")), F.abs(F.col("distrust") - F.col("_d"))) / F.col("_pages")
    return (both.agg(F.max(move)).first()[0] or 0.0) <= TOLERANCE


def judge_urls(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", rules: tuple[tuple[str, str, str], ...] = RULES, block_at: float = BLOCK_AT) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict`` to each page.

    The longest rule that fits decides; else the host's scores do. Null urls and urls without
    ``://`` have an empty host and path, and form a host like any other. Null html has no links.
    Repeated rows count as pages of their own; null keys and further columns pass through, but
    for columns named like the new ones, which are replaced.
    """
    new = ("host", "path", "rule", "verdict")
    columns = [c for c in pages.columns if c not in new]
    placed = sheltered(pages.select(*dict.fromkeys([*columns, key, url, html])), tuple({key, url, html} - set(columns)), key=F.col(key), html=F.col(html), host=host_of(F.col(url)), path=path_of(F.col(url)))
    placed = placed.withColumn("ruled", matching_rule(F.col("host"), F.col("path"), rules))
    counted = placed.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("ruled.verdict") == "allow").alias("good"), F.count_if(F.col("ruled.verdict") == "block").alias("bad"))
    seeds = cut(counted)
    edges = host_edges(placed, "host", "html")
    scores = propagate(edges, seeds.select("host", "good", "bad", "pages")).withColumnRenamed("host", "scored")
    # Only hosts with pages need a verdict, and of those only the blocked ones need a row.
    scored = seeds.join(scores, F.col("host") == F.col("scored"))
    bad = cut(scored.filter((F.col("distrust") > F.col("trust")) & (F.col("distrust") >= F.col("pages") * F.lit(block_at))).select(F.col("host").alias("blocked")))
    judged = spread_join(placed.drop("html"), bad, "host", "blocked", bad.count(), F.col("key"), "left")
    verdict = F.coalesce(F.col("ruled.verdict"), F.when(F.col("blocked").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return judged.select(*unsheltered(columns), "host", "path", F.col("ruled.rule").alias("rule"), verdict.alias("verdict"))
