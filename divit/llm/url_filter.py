"""URL filters: rules first, then trust and distrust propagated over the link graph. DataFrame functions only.

A url that no rule fits is judged by its host. Trust starts at hosts with pages that a rule allows and runs along
links (personalised PageRank); distrust starts at hosts with blocked pages and runs against them. Edges are the distinct pairs
of hosts that pages link with absolute or protocol-relative addresses; ports don't tell hosts apart there. A host and a parent domain that is itself a host of pages or
links are joined both ways by an edge of the weight `KIN`: what only shares a suffix, as sites under one registry do, or a numeric address's digits, is no kin. A host passes on
`DAMPING` of its mass by the weights of its edges, or less where these sum to less than one link, so kinship alone carries little. Both masses start with the
number of pages behind them, so they compare; a host is blocked where its distrust exceeds `ratio` times the sum of its trust and of what its pages
without a rule would start with. Mass at hosts without edges goes no further. Rounds end when the mass under way is at most `LEFT` of what started.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import quoted, settle

#: Propagation ends when the mass still under way is at most LEFT of all that started; STRIDE rounds run between two looks.
DAMPING, LEFT, STRIDE, RATIO = 0.85, 1e-3, 4, 1.0
#: The weight of an edge between a host and its parent; a link weighs 1.
KIN = 0.1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ://: the host, A-Z lower-cased, and the path up to ? or #; both empty where there is none."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest (verdict, host/path) that fits; equal lengths can't both fit one url unless they are the same rule."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r)):
        name, _, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, left: float = LEFT) -> DataFrame:
    """Personalised PageRank of several kinds at once: edges(kind, src, dst, weight), seeds(kind, host, seed) -> (kind, host, mass).

    What arrives at a host in each round stays there by 1 - damping and goes on by damping, split by weight (weights that sum to less than 1 carry less), until at most `left` of all seeds is under way.
    Hosts without edges of a kind keep what arrives, and pass nothing on. No seeds: no rows.
    """
    degree = edges.groupBy("kind", "src").agg(F.greatest(F.sum("weight"), F.lit(1.0)).alias("degree"))
    flow = settle(edges.join(degree, ["kind", "src"]).select("kind", "src", "dst", (F.lit(damping) * F.col("weight") / F.col("degree")).alias("rate")), "flow")
    moving = settle(seeds.select("kind", "host", F.col("seed").cast("double").alias("mass")), "seeds")
    start = total = moving.agg(F.coalesce(F.sum("mass"), F.lit(0.0))).first()[0]
    arrived = moving
    while total > left * start:
        rounds = []
        for _ in range(STRIDE):
            sent = moving.withColumnRenamed("host", "src").join(flow, ["kind", "src"]).select("kind", F.col("dst").alias("host"), (F.col("mass") * F.col("rate")).alias("mass"))
            moving = sent.groupBy("kind", "host").agg(F.sum("mass").alias("mass"))
            rounds.append(moving)
        both = rounds[0].withColumn("turn", F.lit(1))
        for k, r in enumerate(rounds[1:], 2):
            both = both.unionByName(r.withColumn("turn", F.lit(k)))
        both = settle(both, "mass")
        moving = both.where(f"turn = {STRIDE}").drop("turn")
        arrived = settle(arrived.unionByName(both.drop("turn")).groupBy("kind", "host").agg(F.sum("mass").alias("mass")), "arrived")
        total = moving.agg(F.coalesce(F.sum("mass"), F.lit(0.0))).first()[0]
    return arrived.groupBy("kind", "host").agg(((1 - damping) * F.sum("mass")).alias("mass"))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], ratio: float = RATIO, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A verdict on each page's url.

    Returns one row per input row: `id_col`, host, path, rule (null if none fits), verdict (allow or block), trust and distrust (of its host).
    Null urls and urls without :// have an empty host and path, fit no rule, take no part in the graph and are allowed. Null html has no links; null ids stay null;
    repeated rows count each as a seed. An empty table gives no rows; extra columns are not read.
    """
    host, path = host_and_path(F.col(quoted(url_col)))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    parsed = pages.select(F.col(quoted(id_col)).alias("id"), host.alias("host"), path.alias("path")).withColumn("rule", rule).withColumn("ruled", verdict)
    parsed = settle(parsed.withColumn("node", F.regexp_replace("host", ":[0-9]*$", "")), "urls")
    targets = F.array_distinct(F.regexp_extract_all(F.col(quoted(html_col)), F.lit(r"""(?i)href\s*=\s*["']?(?:https?:)?//([^/?#"'\s<>]+)"""), F.lit(1)))
    linked = pages.select(host.alias("src"), F.explode(targets).alias("dst")).select("src", F.translate("dst", _UPPER, _LOWER).alias("dst"))
    linked = settle(linked.select(*(F.regexp_replace(c, ":[0-9]*$", "").alias(c) for c in ("src", "dst"))).where("src <> '' and dst <> '' and src <> dst").distinct(), "links")
    known = parsed.select(F.col("node").alias("name")).unionByName(linked.select(F.col("dst").alias("name"))).where("name <> ''").distinct()
    # Each host with all its ancestors of two labels or more; those that are hosts stay.
    chain = "transform(sequence(1, size(p) - 2), i -> array_join(slice(p, i + 1, size(p)), '.'))"
    up = known.where("name not rlike '^[0-9.]*$'").select("name", F.split("name", r"\.").alias("p")).where("size(p) >= 3").select("name", F.explode(F.expr(chain)).alias("parent"))
    up = up.join(known.select(F.col("name").alias("parent")), "parent", "left_semi")
    both = up.select(F.col("name").alias("src"), F.col("parent").alias("dst")).unionByName(up.select(F.col("parent").alias("src"), F.col("name").alias("dst")))
    weighed = linked.withColumn("weight", F.lit(1.0)).unionByName(both.withColumn("weight", F.lit(KIN)))
    forward = weighed.groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    edges = forward.select(F.lit("trust").alias("kind"), "src", "dst", "weight").unionByName(forward.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    kind = F.when(F.col("ruled") == "allow", "trust").otherwise("distrust")
    seeds = parsed.where("ruled is not null and node <> ''").groupBy(kind.alias("kind"), F.col("node").alias("host")).agg(F.count("*").cast("double").alias("seed"))
    mass = propagate(edges, seeds)
    ranks = mass.groupBy("host").agg(*(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("mass"))), F.lit(0.0)).alias(k) for k in ("trust", "distrust")))
    ranks = settle(ranks, "ranks")
    neutral = parsed.where("ruled is null and node <> ''").groupBy(F.col("node").alias("host")).agg((F.count("*") * (1 - DAMPING)).alias("neutral"))
    ranks = neutral.join(ranks, "host", "full").withColumnRenamed("host", "node")
    out = parsed.join(ranks, "node", "left").withColumn("trust", F.coalesce("trust", F.lit(0.0))).withColumn("distrust", F.coalesce("distrust", F.lit(0.0)))
    judged = F.when(F.col("distrust") > ratio * (F.col("trust") + F.coalesce("neutral", F.lit(0.0))), "block").otherwise("allow")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", judged).alias("verdict"), "trust", "distrust")
