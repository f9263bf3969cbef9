"""URL verdicts: path rules, and for the rest trust and distrust spread over the graph of hosts.

Host edges come from the pages' absolute links. Personalised PageRank starts from the hosts that
allow rules fit (by the share of their pages) and follows links; distrust starts from hosts that block rules fit and
follows links backwards, as who links to blocked hosts is suspect. A host is blocked if its distrust is over the
threshold and over its trust. Everything is a DataFrame join; ranks are written tables.

Of rules of one length that fit, the one last by name counts. Equal trust and distrust allow. Very long pages are read whole.
A null url, and one without "://", has an empty host and path, and no rule fits it. Null html has no links. Rows that
share an id are judged each. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.llm.shared import discard, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A link's host: what follows "//" in an href, quoted or not.
HREF_HOST = r"""(?i)<a\s[^>]*?href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]*)"""


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; rules are (verdict, host, path)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(fits, name + start).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def spread(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, bound: int = 10_000) -> DataFrame:
    """Personalised PageRank of each kind: edges (kind, src, dst, share), shares of a src sum to 1; seeds (kind, host, seed) -> (kind, host, rank).

    Ranks only grow from round to round, as they start from the seeds' own. The loop ends when a round changes no host's rank by more than tolerance of it, so not before every host that the seeds reach is reached. Each round is
    a written table, so that its plan doesn't hold those of the rounds before; what a hub passes on is summed in each task first, and its links are split where its partition is skewed.
    """
    own = seeds.select("kind", "host", ((1 - damping) * F.col("seed")).alias("rank"))
    old: list[str] = []
    rank = written(own, old)
    for _ in range(bound):
        before = rank.select(F.col("kind").alias("of"), F.col("host").alias("at"), F.col("rank").alias("had"))
        moved = edges.join(before, (edges.kind == F.col("of")) & (edges.src == F.col("at"))).select("kind", F.col("dst").alias("host"), (damping * F.col("had") * F.col("share")).alias("rank"), F.lit(0.0).alias("had"))
        kept = before.select(F.col("of").alias("kind"), F.col("at").alias("host"), F.lit(0.0).alias("rank"), "had")
        summed = moved.unionByName(own.withColumn("had", F.lit(0.0))).unionByName(kept).groupBy("kind", "host").agg(F.sum("rank").alias("rank"), F.sum("had").alias("had"))
        new: list[str] = []
        rank = written(summed, new)
        discard(edges.sparkSession, old)
        old = new
        if rank.where(F.abs(F.col("rank") - F.col("had")) > tolerance * F.col("rank")).isEmpty():
            return rank.select("kind", "host", "rank")
    raise RuntimeError(f"ranks did not settle in {bound} rounds")


def _shares(edges: DataFrame) -> DataFrame:
    out = edges.groupBy("src").agg(F.sum("n").alias("all"))
    return edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("share"))


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                 damping: float = 0.85, threshold: float = 0.01) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust: one row per row of pages.

    A host is blocked whose distrust is above its trust and above threshold times the rank that each host with pages would have if all had the same. A hundredth of it lets a host that a long chain of links or a crowd of other sources
    parts from anything blocked go, and keeps hosts with blocked pages of their own, whose distrust is 0.15 of their share of the seeds at least.
    """
    few = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    named = few.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    judged = named.select("page_id", "host", "path", rule.alias("rule"), said.alias("said"))
    targets = F.transform(F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(HREF_HOST), 1)), lambda h: F.translate(h, UPPER, LOWER))
    linked = named.where("host <> ''").select(F.col("host").alias("src"), F.explode(targets).alias("dst")).where("dst <> '' and dst <> src")
    edges = written(linked.groupBy("src", "dst").agg(F.count("*").alias("n")))
    seeds = written(judged.where("host <> ''").groupBy("host").agg(
        F.count_if(F.col("said") == "allow").alias("good"), F.count_if(F.col("said") == "block").alias("bad"), F.count("*").alias("n")))

    def start(column: str) -> DataFrame:
        share = seeds.where(F.col(column) > 0).select("host", (F.col(column) / F.col("n")).alias("s"))
        return share.select("host", (F.col("s") / share.agg(F.sum("s")).scalar()).alias("seed"))

    trusts, distrusts = F.lit("trust").alias("kind"), F.lit("distrust").alias("kind")  # distrust goes from a link's target to its source
    linked = written(_shares(edges).select(trusts, "*").unionByName(_shares(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")).select(distrusts, "*")))
    ranks = spread(linked, written(start("good").select(trusts, "*").unionByName(start("bad").select(distrusts, "*"))), damping)
    both = ranks.groupBy("host").agg(*(F.coalesce(F.max(F.when(F.col("kind") == k, F.col("rank"))), F.lit(0.0)).alias(k) for k in ("trust", "distrust")))
    least = threshold / F.greatest(seeds.agg(F.count("*")).scalar(), F.lit(1))
    method = F.when((F.col("distrust") > least) & (F.col("distrust") > F.col("trust")), "block").otherwise("allow")
    return judged.join(both, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("said", method).alias("verdict"), "trust", "distrust")
