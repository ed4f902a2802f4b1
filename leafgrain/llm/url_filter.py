"""URL filters: rules by host and path, and trust that spreads over the links between hosts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgrain.llm.common import materialize

#: Share of a host's score that it passes on, rounds at most, and the total change that ends them.
DAMPING, ROUNDS, REST = 0.85, 30, 1e-6
#: A host is blocked if its distrust is more than this many times its trust.
MARGIN = 1.0
#: Edges of a host that are joined with one copy of its score.
SLICE = 10_000
#: A host that owns more than one in this many pages is hot; so there are fewer such hosts than this.
HOT_SHARE = 1_000
#: Fixed value: an absolute or scheme-relative reference in HTML, and its host.
REFERENCE = r"""(?i)\bhref\s{0,8}=\s{0,8}["']?\s{0,8}(?:https?:)?//([^/?#"'\s<>]+)"""
Rule = tuple[str, str, str]


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, in lower case; empty without it."""
    return F.coalesce(lowered(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule (verdict, host, path) that fits; null where none does."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = lambda r: ((host == r[1]) | host.endswith("." + r[1])) & path.startswith(r[2])
    pick = lambda value: F.coalesce(*(F.when(fits(r), F.lit(value(r))) for r in ordered)) if ordered else F.lit(None).cast("string")
    return pick(lambda r: r[1] + r[2]), pick(lambda r: r[0])


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, share): links between different hosts; the shares of a host's links add up to one."""
    links = pages.select(F.col("host").alias("src"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(REFERENCE), 1), lowered))).alias("dst"))
    links = links.where("src <> '' and src <> dst").groupBy("src", "dst").count()
    total = links.groupBy("src").agg(F.sum("count").alias("all")).withColumnRenamed("src", "_src")
    return links.join(total, F.col("src") == F.col("_src")).select("src", "dst", (F.col("count") / F.col("all")).alias("share"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, rest: float = REST) -> DataFrame:
    """(kind, host, score): each kind's seeds spread over its edges (kind, src, dst, share) as personalised PageRank.

    score = (1 - damping) * seed + damping * (what the hosts before pass on). Scores are not normed to one in all, so
    a kind with more seeds does not weigh less for each; hosts without links pass nothing on. Rounds end when the total
    change is below ``rest`` of the seeds. A host with many edges is cut into slices, with a copy of its score each.
    """
    seeds = materialize(seeds.groupBy("kind", "host").agg(F.sum("seed").alias("seed")).where("seed > 0"), "seeds")
    degree = edges.groupBy("kind", "src").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))
    degree = materialize(degree.select(F.col("kind").alias("_kind"), F.col("src").alias("_src"), "slices"), "degrees")
    known = (F.col("kind") == F.col("_kind")) & (F.col("src") == F.col("_src"))
    sliced = edges.join(degree, known).withColumn("slice", F.pmod(F.xxhash64("dst"), F.col("slices")).cast("int"))
    sliced = materialize(sliced.select("kind", "src", "slice", "dst", "share"), "edges")
    start = (1 - damping) * F.col("seed")
    score = seeds.select("kind", "host", start.alias("score"))
    if sliced.isEmpty():
        return score
    whole = seeds.agg(F.sum("seed")).first()[0] or 0.0
    # What a round adds is what the round before added, passed on: score is the sum of all waves.
    wave = score
    for _ in range(rounds):
        copies = wave.join(degree, (F.col("kind") == F.col("_kind")) & (F.col("host") == F.col("_src")))
        copies = copies.select("kind", F.col("host").alias("src"), "score", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
        passed = copies.join(sliced, ["kind", "src", "slice"]).groupBy("kind", F.col("dst").alias("host"))
        wave = materialize(passed.agg((damping * F.sum(F.col("score") * F.col("share"))).alias("score")), "wave")
        score = materialize(score.union(wave).groupBy("kind", "host").agg(F.sum("score").alias("score")), "scores")
        if (wave.agg(F.sum("score")).first()[0] or 0.0) <= rest * whole:
            break
    return score


def host_verdicts(pages: DataFrame, margin: float = MARGIN) -> DataFrame:
    """(host, trust, distrust, blocked) of every host with a score, from pages (host, html, by_rule).

    A host's pages that rules allow make it trusted and those that rules block distrusted, each by its share of the
    pages that a rule decides. Trust goes along the links, distrust against them: who links to blocked hosts is
    suspect. A host whose distrust exceeds ``margin`` times its trust is blocked.
    """
    ruled = pages.where("by_rule is not null and host <> ''").groupBy("host").agg(F.avg((F.col("by_rule") == "allow").cast("double")).alias("good"))
    kinds = F.array(F.struct(F.lit("trust").alias("kind"), F.col("good").alias("seed")), F.struct(F.lit("distrust").alias("kind"), (1 - F.col("good")).alias("seed")))
    seeds = ruled.select("host", F.explode(kinds).alias("_k")).select("_k.kind", "host", "_k.seed")
    edges = materialize(host_edges(pages), "links")
    backward = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "share")
    total = backward.groupBy("src").agg(F.sum("share").alias("all")).withColumnRenamed("src", "_src")
    backward = backward.join(total, F.col("src") == F.col("_src")).select("src", "dst", (F.col("share") / F.col("all")).alias("share"))
    both = edges.withColumn("kind", F.lit("trust")).unionByName(backward.withColumn("kind", F.lit("distrust")))
    score = propagate(seeds, both)
    part = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0)).alias(kind)
    hosts = score.groupBy("host").agg(part("trust"), part("distrust"))
    # Rounding of sums may not decide between equal scores.
    return hosts.withColumn("blocked", F.round(F.col("distrust") - margin * F.col("trust"), 9) > 0)


def judge_urls(pages: DataFrame, rules: Sequence[Rule], margin: float = MARGIN) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page.

    The longest rule (verdict, host, path) that fits decides: its host is the page's or above it, its path begins the
    page's. Where none fits, the page's host decides by trust and distrust spread over the links found in ``html``;
    hosts without evidence are allowed.

    A null url, or one without ``://``, has an empty host and path, fits no rule and is allowed. A null html has no
    links. Repeated rows and null ids stay rows of their own. An empty table gives no rows; other columns are not read.

    Only the graph of hosts is iterated, never the pages. The verdict of hot hosts is looked up from a broadcast of
    fewer than ``HOT_SHARE`` rows, so no join gathers the pages of one host.
    """
    pages = pages.select("page_id", "url", "html").withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule, by_rule = rule_for(F.col("host"), F.col("path"), rules)
    pages = pages.withColumn("rule", rule).withColumn("by_rule", by_rule)
    blocked = materialize(host_verdicts(pages, margin).where("blocked").select(F.col("host").alias("_host")), "blocked")
    open_pages = pages.select("page_id", "host", "path", "rule").where(F.col("by_rule").isNull())
    sizes = open_pages.groupBy("host").agg(F.count("*").alias("n"))
    hot = sizes.where(F.col("n") > open_pages.agg((F.count("*") / HOT_SHARE).alias("bar")).scalar()).select(F.col("host").alias("_hot"))
    hot = materialize(hot.join(blocked.withColumn("_bad", F.lit(True)), F.col("_hot") == F.col("_host"), "left").select("_hot", F.coalesce("_bad", F.lit(False)).alias("_bad")), "hot")
    verdict = lambda bad: F.when(bad, "block").otherwise("allow").alias("verdict")
    names = ["page_id", "host", "path", "rule"]
    met = open_pages.join(F.broadcast(hot), F.col("host") == F.col("_hot"), "left")
    parts = [
        pages.where(F.col("by_rule").isNotNull()).select(*names, F.col("by_rule").alias("verdict")),
        met.where(F.col("_bad").isNotNull()).select(*names, verdict(F.col("_bad"))),
        met.where(F.col("_bad").isNull()).join(blocked, F.col("host") == F.col("_host"), "left").select(*names, verdict(F.col("_host").isNotNull()))]
    return reduce(DataFrame.union, parts)
