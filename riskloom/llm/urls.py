"""URL filter: block rules, then a tree of path templates per host with smoothed labelled purity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import lower_ascii
from riskloom.plans.frames import digest_long, written

#: (verdict, host, path) of the rules the query applies.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first `://` up to `/`, `?` or `#`, A-Z lower-cased; path up to `?` or `#`; else empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    host = lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null without one. A rule fits its host and subdomains.

    Rules are a short parameter list, so they become one expression and no join.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def template_tree(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    wide: int = 24,
    likeness: float = 1.96,
    strength: float = 4.0,
    purity: float = 0.75,
) -> DataFrame:
    """`pages` rows with host, path, rule, template, score and verdict.

    Pages under a rule are the labelled ones. Per host, segments with a digit become `*` (a trailing
    extension stays), as do all children of a node with more than `wide` different ones. The tree is as deep as the
    paths are. Each node counts its labelled and blocked pages; a branch whose blocked share is
    within `likeness` standard errors of its parent's is merged into the parent, any other shrinks towards the
    parent's score with the weight of `strength` pages; above the host stands 0.5. A template is blocked when its
    score reaches `purity`.

    Pages are counted per (host, path pattern) before anything else, so a hot host or template is a few
    partial rows per task; nothing is collected. Patterns and nodes are known by the SHA-256 of long names, so a path of
    thousands of segments costs a short row per segment. A null url, or one without `://`, has an empty host and
    path and forms one template of its own. Repeated rows are judged alike; other columns stay as they are,
    and equally named ones are replaced. Empty tables give empty results.
    """
    host, path = host_and_path(F.col("url"))
    clash = [c for c in ("host", "path", "rule", "template", "score", "verdict") if c in pages.columns]
    rows = pages.drop(*clash).withColumn("host", host).withColumn("path", path)
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    parts = F.split(F.regexp_replace("path", "^/", ""), "/")
    shape = F.transform(parts, lambda s: F.when(s.rlike("[0-9]"), F.concat(F.lit("*"), F.regexp_extract(s, r"(\.[A-Za-z]+)$", 1))).otherwise(s))
    rows = rows.withColumns({"rule": rule, "verdict": verdict, "__shape": shape}).withColumn("__name", F.concat_ws("/", "__shape"))
    rows = rows.withColumn("__name", digest_long("__name"))

    blocked = F.sum((F.col("verdict") == "block").cast("long"))
    patterns = rows.groupBy("host", "__name").agg(
        F.count("verdict").alias("labelled"), F.coalesce(blocked, F.lit(0)).alias("blocked"), F.first("__shape").alias("__shape")
    )
    above = F.concat_ws("/", F.slice("__shape", F.lit(1), F.col("level")))
    steps = patterns.select("*", F.posexplode("__shape").alias("level", "segment")).withColumn("parent", above)
    steps = steps.select("host", "__name", "labelled", "blocked", "level", "segment", digest_long("parent").alias("parent"))
    children = steps.groupBy("host", "level", "parent", "segment").agg(F.lit(1).alias("one"))
    broad = children.groupBy("host", "level", "parent").agg(F.sum("one").alias("n")).where(F.col("n") > wide)
    steps = steps.join(broad.withColumn("broad", F.lit(True)), ["host", "level", "parent"], "left")
    general = F.when(F.col("broad"), F.lit("*")).otherwise(F.col("segment"))
    templates = (
        steps.withColumn("segment", general)
        .groupBy("host", "__name")
        .agg(
            F.transform(F.array_sort(F.collect_list(F.struct("level", "segment"))), lambda x: x["segment"]).alias("parts"),
            F.first("labelled").alias("labelled"),
            F.first("blocked").alias("blocked"),
        )
    )
    templates = written(templates)
    # the nodes of each template from its host down; 0 is the host
    nodes = templates.select("host", "__name", "labelled", "blocked", "parts", F.explode(F.sequence(F.lit(0), F.size("parts"))).alias("at"))
    nodes = nodes.withColumn("node", F.concat_ws("/", F.slice("parts", F.lit(1), F.col("at"))))
    nodes = nodes.select("host", "__name", "labelled", "blocked", "at", digest_long("node").alias("node"))
    counts = nodes.groupBy("host", "at", "node").agg(F.sum("labelled").alias("n"), F.sum("blocked").alias("k"))
    chain = (
        nodes.join(counts, ["host", "at", "node"])
        .groupBy("host", "__name")
        .agg(F.array_sort(F.collect_list(F.struct("at", "n", "k"))).alias("chain"))
        .join(templates.select("host", "__name", "parts"), ["host", "__name"])
    )
    start = F.struct(F.lit(0.5).alias("score"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("k"))

    def descend(up: Column, node: Column) -> Column:
        pooled = (up["k"] + node["k"]) / (up["n"] + node["n"])
        spread = F.sqrt(pooled * (1 - pooled) * (1 / up["n"] + 1 / node["n"]))
        gap = F.abs(up["k"] / up["n"] - node["k"] / node["n"])
        alike = (node["n"] == 0) | ((up["n"] > 0) & (gap <= likeness * spread))
        own = (node["k"] + strength * up["score"]) / (node["n"] + strength)
        kept = F.struct(own.alias("score"), node["n"].cast("long").alias("n"), node["k"].cast("long").alias("k"))
        return F.when(alike, up).otherwise(kept)

    scored = chain.select(
        "host", "__name",
        F.concat(F.lit("/"), F.concat_ws("/", "parts")).alias("template"),
        F.aggregate("chain", start, descend)["score"].alias("score"),
    )
    own = F.when(F.col("score") >= purity, "block").otherwise("allow")
    return (
        rows.drop("__shape")
        .join(scored, ["host", "__name"], "left")
        .withColumn("verdict", F.coalesce("verdict", own))
        .drop("__name")
    )
