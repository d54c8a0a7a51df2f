"""URL filters: path rules first, then trust and distrust spread over a host graph.

A rule is host/path with a verdict. It fits its host and all subdomains of it where the url's path
starts with the rule's path; the longest rule that fits decides. Pages that no rule fits take the
verdict of their host: personalised PageRank from trusted hosts along the edges, the same from
blocked hosts against them, and a threshold on trust and on how far a host's own links lead to blocked ones. Hosts are seeds if rules allow (block) at
least half of their pages. Edges are links in the pages between hosts, and, both ways, a host and
its parent host where both have pages.

A null url, and one without ``://``, has an empty host and path, fits no rule and is allowed, as is
every page whose host the propagation doesn't reach. Null html has no links; long html is searched whole.
Repeated rows get equal verdicts; an empty table gives an empty one. Other columns than page_id, url and
html aren't looked at. Pages of a hot host meet its score by broadcast; a host with very many links is
split by Spark's handling of skewed joins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, spread_join

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules that are compiled into the plan; more of them are joined by the suffixes of the hosts.
COMPILED = 200


@dataclass(frozen=True)
class Rule:
    """``text`` is a host, a slash, and the rest of a path; ``verdict`` is allow or block."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


# The rules of the contract.
RULES = (Rule("com/", "allow"), Rule("example.com/en/", "block"), Rule("www.example.com/en/", "allow"), Rule("net/es/", "block"), Rule("net/fr/", "block"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """The text and the verdict of the rule that decides, or nulls. Of rules alike, block decides."""
    text = verdict = F.lit(None).cast("string")
    for r in sorted(set(rules), key=lambda r: (len(r.text), r.text, r.verdict)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def judged_by_rules(pages: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    host, path = host_and_path(F.col("url"))
    df = pages.withColumns({"host": host, "path": path})
    if len(rules) > COMPILED:
        return judged_by_join(df, rules)
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    return df.withColumns({"rule": rule, "_ruled": verdict})


def judged_by_join(df: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """As by compiled rules, for any number of them: each host is joined once with the rules of its suffixes."""
    known = df.sparkSession.createDataFrame([(r.host, r.path, len(r.text), r.text, r.verdict) for r in set(rules)], "suffix string, start string, size int, text string, verdict string")
    hosts = df.groupBy("host").agg(F.count(F.lit(1)).alias("_n"))
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    suffixes = hosts.select("host", "_n", F.explode(ends).alias("suffix"))
    own = suffixes.join(known, "suffix").groupBy("host", "_n").agg(F.collect_list(F.struct("size", "text", "verdict", "start")).alias("_rules"))
    fits = F.filter("_rules", lambda r: F.col("path").startswith(r["start"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(r["size"].alias("size"), r["text"].alias("text"), r["verdict"].alias("verdict"))))
    found = spread_join(df, cut(own, "rules"), ["host"], "left").withColumn("_best", best)
    return found.select(*df.columns, F.col("_best.text").alias("rule"), F.col("_best.verdict").alias("_ruled"))


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst) of different hosts from the pages' absolute links. Needs host and html."""
    links = F.regexp_extract_all("html", F.lit(r"""(?i)(?:href|src)\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""), F.lit(1))
    found = pages.where(F.col("html").contains("//")).select(F.col("host").alias("src"), F.explode(links).alias("_u"))
    # A link without a scheme takes that of its page; only its host matters here.
    url = F.when(F.col("_u").startswith("//"), F.concat(F.lit("http:"), "_u")).otherwise(F.col("_u"))
    return found.select("src", host_and_path(url)[0].alias("dst")).where("src <> '' AND dst <> '' AND src <> dst").distinct()


def propagate(seeds: DataFrame, edges: DataFrame, rounds: int = 100, damping: float = 0.85, back: tuple[str, ...] = (), rest: float = 0.02) -> DataFrame:
    """(kind, host, score) by personalised PageRank: when four rounds move less than ``rest`` of each kind's mass, or after ``rounds``.

    seeds: (kind, host, weight); edges: (kind, src, dst, share), shares of a source (of exposure: of a
    target) adding up to 1.
    Weights are scaled to a sum of 1 for each kind. Mass at hosts without edges goes back to the seeds of
    the kinds in ``back``, and isn't passed on of others.
    """
    total = seeds.groupBy("kind").agg(F.sum("weight").alias("_all"))
    seeds = cut(seeds.join(total, "kind").select("kind", "host", (F.col("weight") / F.col("_all")).alias("score")), "seeds")
    edges = cut(edges, "edges")
    sources = cut(edges.select("kind", F.col("src").alias("host")).distinct(), "sources")
    state, done = seeds, 0
    while done < rounds:
        after = state
        for _ in range(min(4, rounds - done)):
            done += 1
            passed = after.withColumnRenamed("host", "src").join(edges, ["kind", "src"]).select("kind", F.col("dst").alias("host"), (F.col("score") * F.col("share") * damping).alias("score"))
            ends = after.where(F.col("kind").isin(*back)) if back else after.limit(0)
            lost = ends.join(sources, ["kind", "host"], "left_anti").groupBy("kind").agg(F.sum("score").alias("_lost"))  # a row for each kind
            again = F.col("score") * (1 - damping + damping * F.coalesce("_lost", F.lit(0.0)))
            restart = seeds.join(F.broadcast(lost), "kind", "left").select("kind", "host", again.alias("score"))
            after = passed.unionByName(restart).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        after = cut(after, "ranks")
        moved = after.unionByName(state.withColumn("score", -F.col("score"))).groupBy("kind", "host").agg(F.abs(F.sum("score")).alias("d")).groupBy("kind").agg(F.sum("d").alias("d")).agg(F.max("d")).first()[0]
        state = after
        if (moved or 0.0) < rest:
            break
    return state


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, rounds: int = 100, ratio: float = 2.0, least: float = 0.05) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for every row of ``pages`` (page_id, url, html).

    A host is blocked if its exposure is at least ``ratio`` times its trust and ``least`` times the mean
    mass of a blocked seed. Exposure is spread from blocked hosts like distrust, but a host takes of each
    host that it links to the share of that link in its own links: it doesn't shrink as others link there.
    """
    rows = judged_by_rules(pages.select("page_id", "url", "html"), rules)
    share = lambda verdict: F.avg(F.when(F.col("_ruled") == verdict, 1.0).otherwise(0.0))
    hosts = cut(rows.where("host <> ''").groupBy("host").agg(share("allow").alias("_allow"), share("block").alias("_block"), F.count(F.lit(1)).alias("_n")), "hosts")
    seeds = hosts.where("_allow >= 0.5").select(F.lit("trust").alias("kind"), "host", F.lit(1.0).alias("weight"))
    blocked = F.explode(F.array(F.lit("distrust"), F.lit("exposure"))).alias("kind")
    seeds = seeds.unionByName(hosts.where("_block >= 0.5").select(blocked, "host", F.lit(1.0).alias("weight")))
    up = hosts.select(F.col("host").alias("src"), F.regexp_extract("host", r"^[^.]+\.(.+)$", 1).alias("dst"))
    family = up.join(hosts.select(F.col("host").alias("dst")), "dst", "left_semi").select("src", "dst")
    links = host_edges(rows).unionByName(family).unionByName(family.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    both = links.select(F.lit("trust").alias("kind"), "src", "dst").unionByName(links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst")))
    degree = both.groupBy("kind", "src").agg(F.count(F.lit(1)).alias("_n"))
    edges = both.join(degree, ["kind", "src"]).select("kind", "src", "dst", (1 / F.col("_n")).alias("share"))
    own = links.join(links.groupBy("src").agg(F.count(F.lit(1)).alias("_n")), "src")
    edges = edges.unionByName(own.select(F.lit("exposure").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), (1 / F.col("_n")).alias("share")))
    ranks = propagate(seeds, edges, rounds, back=("trust", "distrust"))
    of = lambda kind: F.round(F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0)), 12)
    n = seeds.agg(F.count(F.when(F.col("kind") == "distrust", 1)).alias("_n"))  # one row
    scores = ranks.groupBy("host").agg(of("trust").alias("trust"), of("distrust").alias("distrust"), of("exposure").alias("_exposure")).join(F.broadcast(n))
    bad = (F.col("_exposure") > 0) & (F.col("_exposure") >= ratio * F.col("trust")) & (F.col("_exposure") * F.col("_n") >= least)
    scores = scores.select("host", "trust", "distrust", bad.alias("_bad")).join(hosts.select("host", "_n"), "host")
    out = spread_join(judged_by_rules(pages.select("page_id", "url"), rules), cut(scores, "scores"), ["host"], "left")
    own = F.when(F.coalesce("_bad", F.lit(False)), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("_ruled", own).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
