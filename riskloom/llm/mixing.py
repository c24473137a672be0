"""Mixing sources to target weights: integer budgets down a domain-language-source tree, then seeded prefixes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from riskloom.plans.frames import written

_BIG = "decimal(38,0)"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _weight(level: str, weights: Mapping[str, int]) -> Column:
    out = F.lit(1)
    for value, w in weights.items():
        out = F.when(F.col(level) == value, F.lit(int(w))).otherwise(out)
    return out.cast(_BIG)


def _pour(nodes: DataFrame, parents: list[str], level: str) -> DataFrame:
    """Splits `grant` of each parent over its children by weight, none above its capacity.

    Children are ranked by capacity per unit of weight. The first ones that a fair share would overfill take
    their capacity; what they leave goes to their siblings by weight. Integers only: shares round down.
    """
    order = W.partitionBy(*parents).orderBy(F.col("capacity").cast("double") / F.col("weight").cast("double"), level)
    ahead, behind = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    zero = F.lit(0).cast(_BIG)
    ranked = nodes.withColumns(
        {
            "__taken": F.coalesce(F.sum("capacity").over(ahead), zero).cast(_BIG),
            "__weights": F.sum("weight").over(behind).cast(_BIG),
        }
    )
    left = F.greatest(F.col("grant") - F.col("__taken"), zero).cast(_BIG)
    full = left.cast(_BIG) * F.col("weight") >= F.col("capacity") * F.col("__weights")
    ranked = ranked.withColumns({"__left": left, "__full": full})
    # once a child is not filled no later one is: its fair share fixes the level of the rest
    first = F.min(F.when(~F.col("__full"), F.struct(F.col("capacity").cast("double") / F.col("weight").cast("double"), level, "__left", "__weights"))).over(W.partitionBy(*parents))
    share = F.expr("cast(div(first.__left * weight, first.__weights) as decimal(38,0))")
    ranked = ranked.withColumn("first", first)
    filled = F.col("first").isNull() | (
        F.struct(F.col("capacity").cast("double") / F.col("weight").cast("double"), level) < F.struct(F.col("first.col1"), F.col(f"first.{level}"))
    )
    given = F.when(filled, F.least("capacity", F.greatest(F.col("grant") - F.col("__taken"), zero))).otherwise(F.least(share, F.col("capacity")))
    return ranked.withColumn("grant", given.cast(_BIG)).drop("__taken", "__weights", "__left", "__full", "first")


def _checked(weights: Mapping[str, Mapping[str, int]]) -> None:
    for level, named in weights.items():
        wrong = {v: w for v, w in named.items() if w != int(w) or w < 0}
        if wrong:
            raise ValueError(f"weights of {level} must be whole numbers from 0: {wrong}")


def leaf_budgets(
    leaves: DataFrame, levels: Sequence[str], total: int, weights: Mapping[str, Mapping[str, int]], epochs: int
) -> DataFrame:
    """`leaves` (levels, tokens) with `capacity` = epochs x tokens and `grant`, the tokens each may give.

    Going down, each node's grant is split over its children by weight; a child short of text passes what it
    lacks to its siblings, and a whole subtree that is short passes the rest to its own siblings. A value of weight 0
    is left out with all below it: its leaves have no row.
    """
    _checked(weights)
    tree = leaves.withColumn("capacity", (F.col("tokens") * epochs).cast(_BIG))
    for level in levels:
        tree = tree.where(_weight(level, weights.get(level, {})) > 0)
    grants = None
    for depth, level in enumerate(levels):
        keys = list(levels[: depth + 1])
        nodes = tree.groupBy(*keys).agg(F.sum("capacity").cast(_BIG).alias("capacity"))
        nodes = nodes.withColumn("weight", _weight(level, weights.get(level, {})))
        if grants is None:
            nodes = nodes.withColumn("grant", F.lit(total).cast(_BIG))
        else:
            nodes = nodes.join(grants, keys[:-1])
        grants = _pour(nodes, keys[:-1], level).select(*keys, "grant")
    return tree.join(grants, list(levels)).select(*levels, "tokens", F.col("capacity").cast("long").alias("capacity"), F.col("grant").cast("long").alias("grant"))


def _order(seed: int, epoch: Column, key: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit(""))))


def mix(
    docs: DataFrame,
    total: int | None = None,
    share: tuple[int, int] = (1, 2),
    weights: Mapping[str, Mapping[str, int]] | None = None,
    epochs: int = 3,
    seed: int = 7,
    domain: Column | None = None,
) -> DataFrame:
    """`docs` rows the mixture draws, with domain, n_tokens and `copies` (how often the document is used).

    Leaves are (domain, lang, source). `total` tokens (by default `share` = numerator, denominator of all
    tokens) go down the tree (see `leaf_budgets`); weights are integers per level and value, 1 where not
    given; 0 leaves the value out, negative or broken ones are an error. A leaf with `grant` tokens uses all its documents in grant div tokens whole epochs, then those
    documents that lie, in the seeded order of the next epoch, wholly within the remaining tokens.

    The cut in that order is found per leaf: documents are counted per leaf and 12-bit slice of the hash
    first, and only the slice that holds the cut is ordered one by one. A hot source therefore spreads over
    4096 slices, and each document is compared with its leaf's cut instead of joined with a chosen list.

    Null lang or source is a leaf value of its own (empty text); null text has no words and is used in whole
    epochs only if its leaf has any. Rows repeating a doc_id share one place in the order and are taken or left
    together. Columns named domain, n_tokens or copies are replaced. An empty table gives no rows.
    """
    weights = weights or {}
    columns = [c for c in docs.columns if c not in ("domain", "n_tokens", "copies")]
    if domain is None:
        domain = F.concat(F.lit("d"), F.pmod(F.crc32(F.coalesce("source", F.lit(""))), F.lit(4)).cast("string"))
    names = {"__domain": domain, "__lang": F.coalesce("lang", F.lit("")), "__source": F.coalesce("source", F.lit("")), "__n": word_count(F.col("text"))}
    marked = docs.select(*columns, *[c.alias(n) for n, c in names.items()])
    levels = ["__domain", "__lang", "__source"]
    sizes = written(marked.select("doc_id", *levels, "__n"))
    leaves = sizes.groupBy(*levels).agg(F.sum("__n").alias("tokens"))
    if total is None:
        everything = leaves.agg(F.sum("tokens")).first()[0] or 0
        total = everything * share[0] // share[1]
    named = {f"__{k}": v for k, v in weights.items()}
    plan = written(leaf_budgets(leaves, levels, total, named, epochs)).withColumns(
        {"whole": F.expr("if(tokens > 0, grant div tokens, 0)"), "rest": F.expr("if(tokens > 0, grant % tokens, 0)")}
    )
    order = _order(seed, F.col("whole"), F.col("doc_id"))
    slices = sizes.join(plan, levels).where("rest > 0").withColumn("h", order).withColumn("slice", F.substring("h", 1, 3))
    sums = slices.groupBy(*levels, "slice").agg(F.sum("__n").alias("s"))
    upto = W.partitionBy(*levels).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("s").over(upto), F.lit(0)))
    at = sums.join(plan, levels).where("base <= rest and base + s > rest").select(*levels, "slice", "base")
    inside = slices.join(at, [*levels, "slice"]).groupBy(*levels, "base", "rest", "h").agg(F.sum("__n").alias("n"))
    running = F.col("base") + F.sum("n").over(W.partitionBy(*levels).orderBy("h").rowsBetween(W.unboundedPreceding, 0))
    cut = inside.withColumn("upto", running).where("upto > rest").groupBy(*levels).agg(F.min("h").alias("cut"))
    plan = written(plan.join(cut, levels, "left").select(*levels, "whole", "rest", "cut"))
    drawn = marked.join(plan, levels, "left").withColumn("__h", _order(seed, F.col("whole"), F.col("doc_id")))
    extra = (F.col("rest") > 0) & (F.col("cut").isNull() | (F.col("__h") < F.col("cut")))
    copies = (F.col("whole") + extra.cast("int")).cast("long")
    return drawn.select(*columns, F.col("__domain").alias("domain"), F.col("__n").alias("n_tokens"), copies.alias("copies")).where("copies > 0")
