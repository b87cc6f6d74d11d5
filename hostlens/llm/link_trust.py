"""URL filter: rules first, then trust and distrust propagated over the host graph."""

from __future__ import annotations

from itertools import cycle

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostlens.llm.common import LOWER, UPPER
from hostlens.session import cut, scratch_path

DAMPING = 0.85
TOLERANCE = 1e-6  # change of all ranks together in a step under which the propagation ends
CUT_EVERY = 8  # steps between two looks at the change
MOST_RULES = 100_000  # rules up to this number are sent to all tasks
# links of a page: the value of href or src, quoted or not
LINK = r"""(?i)(?:href|src)\s*=\s*["']?([^"'\s>]+)"""


def url_host(url: Column) -> Column:
    """Between the first :// and /, ?, # or the end, A-Z lower-cased; empty without ://."""
    rest = F.substring_index(F.substring_index(F.substring_index(
        _after(url), "/", 1), "?", 1), "#", 1)
    return F.translate(rest, UPPER, LOWER)


def _after(url: Column) -> Column:
    """What follows the first ://, else empty."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, url.substr(at + 3, F.length(url))), F.lit(""))


def url_path(url: Column) -> Column:
    """From the end of the host up to ?, # or the end."""
    rest = F.substring_index(F.substring_index(_after(url), "?", 1), "#", 1)
    at = F.instr(rest, "/")
    return F.when(at > 0, rest.substr(at, F.length(rest))).otherwise(F.lit(""))


def match_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """The pages with `rule` and `rule_verdict` of the longest rule that fits, else null.

    `pages` has a unique `page_key`, `host` and `path`; `rules` has `rule_host`,
    `rule_path` and `verdict`. Each host is looked up with all its suffixes at label bounds.
    Of rules of equal length and text, block wins. Rules are broadcast up to MOST_RULES.
    """
    labels = F.split("host", r"\.")
    hosts = pages.select("host").distinct().select("host", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))).alias("rule_host"))
    if rules.limit(MOST_RULES + 1).count() <= MOST_RULES:
        rules = F.broadcast(rules)
    fitting = hosts.join(rules, "rule_host").groupBy("host").agg(F.collect_list(F.struct(
        "rule_path", F.concat("rule_host", "rule_path").alias("rule"), "verdict")).alias("fits"))
    # no more rules than a host has labels, times the rules of one host
    best = F.array_max(F.transform(
        F.filter("fits", lambda r: F.startswith(F.col("path"), r["rule_path"])),
        lambda r: F.struct(F.length(r["rule"]).alias("length"), r["rule"].alias("rule"),
                           (r["verdict"] == "block").alias("blocks"))))
    return (
        pages.join(fitting, "host", "left").withColumn("best", best)
        .withColumn("rule", F.col("best.rule"))
        .withColumn("rule_verdict", F.when(F.col("best.blocks"), "block")
                    .when(F.col("best").isNotNull(), "allow"))
        .drop("fits", "best")
    )


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): links between hosts, and each host with its parent domains.

    Links without a host stay on their own host and make no edge. A subdomain and its
    parent vouch for each other with weight 1 (parents of at least two labels).
    """
    links = pages.select(F.col("host").alias("src"), F.explode(
        F.regexp_extract_all("html", F.lit(LINK), 1)).alias("link"))
    links = links.filter(F.col("link").contains("//")).select(
        "src", url_host(F.when(F.startswith(F.col("link"), F.lit("//")), F.concat(
            F.lit(":"), F.col("link"))).otherwise(F.col("link"))).alias("dst"))
    links = links.filter((F.col("dst") != "") & (F.col("src") != "")
                         & (F.col("src") != F.col("dst")))
    links = links.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    labels = F.split("host", r"\.")
    chain = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
        lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    steps = (
        pages.filter("host <> ''").select("host").distinct()
        .select(F.explode(F.arrays_zip(
            F.slice(chain, 1, F.greatest(F.size(chain) - 1, F.lit(0))).alias("child"),
            F.slice(chain, 2, F.size(chain)).alias("parent"))).alias("s"))
        .select(F.col("s.child").alias("child"), F.col("s.parent").alias("parent")).distinct()
    )
    family = steps.select(F.inline(F.array(
        F.struct(F.col("child").alias("src"), F.col("parent").alias("dst")),
        F.struct(F.col("parent").alias("src"), F.col("child").alias("dst")),
    ))).withColumn("weight", F.lit(1.0))
    return links.unionByName(family).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def personalised_rank(
    edges: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE, damping: float = DAMPING,
) -> DataFrame:
    """(kind, host, rank): damping * incoming rank + (1 - damping) * seed, from the seeds.

    `edges` (kind, src, dst, weight) and `seeds` (kind, host, seed) may hold several graphs,
    told apart by `kind`, which are ranked together; the seeds of each sum to 1. Rank at
    hosts without outgoing edges is not passed on. Steps go on until one changes all ranks by
    less than the tolerance together, which is looked at every CUT_EVERY steps; each step
    changes them by damping times the one before at most, so that comes. Edges are normalised
    once and written; each step is one join on the source and one aggregation with partial
    sums, so a host with very many edges is no single task's work. The ranks of each step are
    written, in turn to one of two tables: all steps have the same short plan, and the driver
    holds no more of them the longer it takes.
    """
    out = edges.groupBy("kind", "src").agg(F.sum("weight").alias("all"))
    flow = cut(edges.join(out, ["kind", "src"]).select(
        "kind", F.col("src").alias("host"), "dst",
        (F.col("weight") / F.col("all")).alias("share")), "trust-flow")
    rank = cut(seeds.select("kind", "host", F.col("seed").alias("rank")), "trust-seeds")
    base = rank.withColumn("rank", F.col("rank") * (1 - damping))
    tables = cycle([scratch_path(edges.sparkSession, "trust-rank") for _ in range(2)])
    nothing = F.lit(0.0)
    while True:
        for step in range(1, CUT_EVERY + 1):
            passed = flow.join(rank, ["kind", "host"]).select(
                "kind", F.col("dst").alias("host"),
                (F.col("rank") * F.col("share") * damping).alias("rank"))
            whole = passed.unionByName(base)
            if step < CUT_EVERY:
                rank = cut(whole.groupBy("kind", "host").agg(F.sum("rank").alias("rank")),
                           path=next(tables))
        both = whole.withColumn("old", nothing).unionByName(rank.select(
            "kind", "host", nothing.alias("rank"), F.col("rank").alias("old")))
        found = cut(both.groupBy("kind", "host").agg(
            F.sum("rank").alias("rank"), F.sum("old").alias("old")), path=next(tables))
        rank = found.select("kind", "host", "rank")
        change = found.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
        if change is None or change < tolerance:
            return rank


def judge_urls(
    pages: DataFrame, rules: DataFrame, threshold: float = 0.0, tolerance: float = TOLERANCE,
    id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of every page.

    Pages that a rule decides are the seeds: a host's share of all allowed pages is its
    trust seed, its share of all blocked pages its distrust seed. Trust follows links,
    distrust goes against them (who links to blocked hosts loses). A host whose trust minus
    distrust is below the threshold blocks the pages without a rule; hosts that nothing
    reaches have 0 and are allowed at the default threshold. Differences are rounded to 12
    decimals, so a tie is a tie.

    A null url or one without :// has an empty host and path, is fitted by no rule and is
    allowed. Null html has no links. Rows with equal ids are judged one by one. An empty
    table gives an empty result.
    """
    url, blank = F.col(url_col), F.lit("")
    rows = pages.select(F.col(id_col).alias("page_id"), url_host(url).alias("host"),
                        url_path(url).alias("path"))
    judged = cut(match_rules(rows, rules), "url-rules")
    edges = cut(host_edges(pages.select(url_host(url).alias("host"), F.coalesce(
        F.col(html_col), blank).alias("html"))), "url-edges")
    counts = cut(judged.filter("rule_verdict is not null").groupBy("host").agg(
        F.sum((F.col("rule_verdict") == "allow").cast("double")).alias("allowed"),
        F.sum((F.col("rule_verdict") == "block").cast("double")).alias("blocked")), "url-seeds")
    sums = counts.agg(F.sum("allowed"), F.sum("blocked")).first()

    def seeds(kind: str, column: str, whole: float | None) -> DataFrame:
        return counts.filter(F.col(column) > 0).select(
            F.lit(kind).alias("kind"), "host", (F.col(column) / F.lit(whole or 1.0)).alias("seed"))

    both = edges.select(F.inline(F.array(
        F.struct(F.lit("trust").alias("kind"), "src", "dst", "weight"),
        F.struct(F.lit("distrust").alias("kind"), F.col("dst").alias("src"),
                 F.col("src").alias("dst"), "weight"))))
    ranks = personalised_rank(both, seeds("trust", "allowed", sums[0]).unionByName(
        seeds("distrust", "blocked", sums[1])), tolerance)
    scores = ranks.groupBy("host").agg(*[
        F.sum(F.when(F.col("kind") == kind, F.col("rank"))).alias(kind)
        for kind in ("trust", "distrust")])
    apart = F.round(F.coalesce("trust", F.lit(0.0)) - F.coalesce("distrust", F.lit(0.0)), 12)
    return judged.join(scores, "host", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("rule_verdict", F.when(apart < threshold, "block").otherwise("allow"))
        .alias("verdict"),
        F.round(F.coalesce("trust", F.lit(0.0)), 9).alias("trust"),
        F.round(F.coalesce("distrust", F.lit(0.0)), 9).alias("distrust"))
