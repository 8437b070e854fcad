"""URLs judged by rules, and by character language models where no rule fits.

The models are Markov models of variable order: each character is predicted
from up to three before it, and every order is smoothed with the next shorter
one. One is counted over the URLs that rules accept, one over those they
reject. A URL's score is the mean log-likelihood ratio of its characters; the
bound between allow and block lies where the scores of the two kinds of ruled
URLs, each within its own spread, are equally far off.

All of it is DataFrame work. Each distinct URL is scored once. Character groups
of four are counted over all URLs; the ratio is worked out once for each
distinct group and joined back: groups so frequent that there can be at most
``FREQUENT`` of them come from a broadcast, the others from a shuffle, so no
frequent group gathers in one task. Verdicts go back to the pages by URL, from
written tables, so that adaptive execution splits a URL that very many pages have.

A null URL and one without ``://`` have an empty host and path, and are scored
as they are, null as empty. Equal URLs get equal verdicts. Rules of equal
length go in their order. If rules accept or reject no URL at all, the rest is
allowed. Other columns pass through; the result columns replace older ones.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adclick.sources.scratch import materialise

ORDER = 3
PRIOR = 1.0
FREQUENT = 50_000


class Rule(NamedTuple):
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(__url, instr(__url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _fits(rule: Rule) -> Column:
    host = F.col("host")
    return ((host == rule.host) | host.endswith(f".{rule.host}")) & F.col("path").startswith(rule.path)


def _ruled(rules: Sequence[Rule], value: str) -> Column:
    """Text or verdict of the longest rule that fits; null if none does."""
    ordered = sorted(rules, key=lambda r: -len(r.text))
    return F.coalesce(*[F.when(_fits(r), F.lit(getattr(r, value))) for r in ordered], F.lit(None).cast("string"))


def _groups(urls: DataFrame) -> DataFrame:
    """Every character of each URL, and of its end, with those before it."""
    padded = F.concat(F.lit("^" * ORDER), F.coalesce("__url", F.lit("")), F.lit("$"))
    places = F.sequence(F.lit(1), F.length(padded) - ORDER)
    return urls.withColumn("__padded", padded).select(
        "__url", "__ruled", F.explode(F.transform(places, lambda i: F.substring(F.col("__padded"), i, F.lit(ORDER + 1)))).alias("g")
    )


def _ratios(counts: DataFrame) -> DataFrame:
    """(g, ratio): the smoothed log-likelihood ratio of each group's last
    character, from counts ``a`` among accepted and ``r`` among rejected URLs."""
    sums = [F.sum("a").alias("a"), F.sum("r").alias("r")]
    total = counts.agg(F.sum("a").alias("a"), F.sum("r").alias("r"), F.countDistinct(F.substring("g", ORDER + 1, 1)).alias("v")).first()
    p = {k: (F.col(k) + PRIOR) / F.lit((total[k] or 0) + PRIOR * max(total["v"], 1)) for k in ("a", "r")}
    known = counts.groupBy(F.substring("g", ORDER + 1, 1).alias("g")).agg(*sums).select("g", p["a"].alias("pa"), p["r"].alias("pr"))
    for order in range(1, ORDER + 1):
        first = ORDER + 1 - order
        grams = counts.groupBy(F.substring("g", first, order + 1).alias("g")).agg(*sums)
        contexts = grams.groupBy(F.substring("g", 1, order).alias("c")).agg(F.sum("a").alias("ca"), F.sum("r").alias("cr"))
        grams = grams.withColumn("c", F.substring("g", 1, order)).withColumn("s", F.substring("g", 2, order))
        shorter = known.select(F.col("g").alias("s"), "pa", "pr")
        grams = grams.join(contexts, "c").join(shorter, "s")
        known = grams.select("g", *[((F.col(k) + PRIOR * F.col(f"p{k}")) / (F.col(f"c{k}") + PRIOR)).alias(f"p{k}") for k in ("a", "r")])
    return known.select("g", (F.log("pa") - F.log("pr")).alias("ratio"))


def judge(pages: DataFrame, rules: Sequence[Rule], url: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict`` and ``score``
    (null where a rule decides)."""
    pages = pages.drop("host", "path", "rule", "verdict", "score")
    names = pages.columns
    parsed = pages.withColumn("__url", F.col(url))
    host, path = split_url(F.col("__url"))
    parsed = parsed.withColumn("host", host).withColumn("path", path)
    parsed = parsed.withColumn("rule", _ruled(rules, "text")).withColumn("__ruled", _ruled(rules, "verdict"))

    urls = materialise(parsed.select("__url", "__ruled").distinct(), "urls")
    groups = _groups(urls)
    kinds = [F.count_if(F.col("__ruled") == v).alias(k) for k, v in (("a", "allow"), ("r", "block"))]
    counts = materialise(groups.groupBy("g").agg(F.count("*").alias("n"), *kinds), "groups")
    ratios = materialise(_ratios(counts).join(counts.select("g", "n"), "g"), "ratios")
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") > total / FREQUENT  # so there are fewer than FREQUENT
    frequent = F.broadcast(ratios.where(often).select("g", "ratio"))
    rest = groups.join(frequent, "g", "left_anti").join(ratios.where(~often).select("g", "ratio"), "g")
    found = groups.join(frequent, "g").unionByName(rest)
    scores = found.groupBy("__url", "__ruled").agg(F.avg("ratio").alias("score"))
    scores = materialise(scores, "scores")

    spread = scores.groupBy("__ruled").agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s"))
    known = {r["__ruled"]: (r["m"], r["s"] + 1e-9) for r in spread.where("__ruled is not null").collect()}
    if len(known) == 2:
        (ma, sa), (mr, sr) = known["allow"], known["block"]
        guess = F.when(F.col("score") >= (ma * sr + mr * sa) / (sa + sr), "allow").otherwise("block")
    else:
        guess = F.lit("allow")
    ruled = parsed.where("__ruled is not null")
    ruled = ruled.select(*names, "host", "path", "rule", F.col("__ruled").alias("verdict"), F.lit(None).cast("double").alias("score"))
    open_ = scores.where("__ruled is null").select(F.coalesce("__url", F.lit("")).alias("__of"), "score")
    # a null URL is scored as the empty one
    open_ = open_.dropDuplicates(["__of"])
    open_ = materialise(open_, "open")
    free = parsed.where("__ruled is null").withColumn("__of", F.coalesce("__url", F.lit(""))).join(open_, "__of")
    return ruled.unionByName(free.select(*names, "host", "path", "rule", guess.alias("verdict"), "score"))
