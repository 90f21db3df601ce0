"""Mixing sources to target weights by hierarchical budgets.

A token budget is handed down a tree, such as domain, language, source, in
proportion to the nodes' weights. A node can take as many tokens as its leaves
hold in `max_epochs` readings; what a node can't take goes to its siblings by their weights, and
leaves its parent only when all of them are full. Each leaf reads its documents
in a seeded order of its own for every epoch: whole epochs first, then the prefix
of the next that fills its budget. The prefix ends at a threshold in that
order, found through shards of the leaf, so no leaf is gathered or ranked whole.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargolens.llm.common import SENT_ROWS, bound_arrow, durable, hex_shard, join_by_count, shard_number, word_count

NONE = "<null>"


def ratio_shard(ratio: Column) -> Column:
    """A number that never falls as the ratio grows: 64 for each factor of e."""
    return F.floor(F.log1p(ratio) * 64).cast("bigint")


def water_fill(nodes: DataFrame, parent: Sequence[str], name: str) -> DataFrame:
    """nodes (parent..., name, cap, weight, budget of the parent; a written table) with `given`: each node min(cap, level * weight), with the level that spends the budget.

    Nodes fill up in order of cap / weight. The level after the first k are full
    is (budget - their caps) / weight of the others; the first node that it
    leaves below its cap shows the true level. Nodes are sorted within shards of
    their ratio only; sums by shard tell what comes before and after each.
    """
    within = F.struct(*(F.col(c) for c in parent)) if parent else F.struct(F.lit(0).alias("root"))
    steps = nodes.withColumns({"within": within, "ratio": F.col("cap") / F.col("weight")}).withColumn("part", ratio_shard(F.col("ratio")))
    sums = steps.groupBy("within", "part").agg(F.sum("cap").alias("caps"), F.sum("weight").alias("weights"))
    shards = Window.partitionBy("within").orderBy("part")  # some thousand rows for each parent at most
    sums = sums.select("within", "part", F.coalesce(F.sum("caps").over(shards.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("full"), F.sum("weights").over(shards.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("open"))
    before = Window.partitionBy("within", "part").orderBy("ratio", name).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("budget") - F.col("full") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.col("open") - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    leveled = steps.join(sums, ["within", "part"]).withColumn("level", level)
    order = F.struct("ratio", name)
    true = durable(leveled.groupBy("within").agg(F.min_by(F.when(F.col("level") < F.col("ratio"), F.col("level")), F.when(F.col("level") < F.col("ratio"), order)).alias("true_level"), F.count(F.lit(1)).alias("many")), "levels")
    told = join_by_count(steps, true, "within", "many")
    given = F.when(F.col("true_level").isNull() | (F.col("ratio") <= F.col("true_level")), F.col("cap")).otherwise(F.floor(F.col("true_level") * F.col("weight")))
    return told.select(*parent, name, "cap", "weight", F.greatest(given, F.lit(0)).cast("bigint").alias("given"))


def weight_of(level: Column, weights: Mapping[str, int]) -> Column:
    out = F.lit(weights.get("*", 1))
    for value, w in weights.items():
        if value != "*":
            out = F.when(level == value, w).otherwise(out)
    return out.cast("bigint")


def epoch_key(seed: int, epoch: Column, ident: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(ident.cast("string"), F.lit("null"))))


def leaf_budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, int]], share: float, max_epochs: int) -> DataFrame:
    """leaves (levels..., tokens and others; a written table) with `given`: the leaf's budget. The whole budget is `share` of all tokens. Budgets are whole tokens: what rounding down leaves of a parent's budget, less than a token a child, is not given out."""
    total = leaves.agg(F.sum("tokens").alias("t")).first()["t"] or 0
    budget = min(int(total * share), total * max_epochs)
    above = None
    for k, name in enumerate(levels):
        parent = list(levels[:k])
        nodes = leaves.groupBy(*parent, name).agg((F.sum("tokens") * max_epochs).alias("cap")).withColumn("weight", weight_of(F.col(name), weights.get(name, {})))
        nodes = nodes.withColumn("budget", F.lit(budget).cast("bigint")) if above is None else nodes.join(above.select(*parent, F.col("given").alias("budget")), parent)
        above = durable(water_fill(durable(nodes, "nodes"), parent, name).select(*parent, name, "given"), "budgets")
    return leaves.join(above, list(levels))


def mix_to_weights(
    docs: DataFrame, *, levels: Mapping[str, str], weights: Mapping[str, Mapping[str, int]], share: float = 1.0, max_epochs: int = 2, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", n_tokens: Column | None = None, carry: Sequence[str] | None = None
) -> DataFrame:
    """Columns row, id, one per level, n_tokens, leaf_budget and epoch: one row each time a document is read.

    levels names the tree's levels from the top, each a SQL expression of docs'
    columns; null is a node of its own. weights holds each level's positive integer weights by
    value, "*" for the others (1 by default). share times all tokens (words of the text by
    default) is the budget, at most what max_epochs hold. A leaf's document is
    read in an epoch while the tokens before it are fewer than the leaf's
    budget, so a leaf ends within one document of it. Rows with one id have one place in the order and go
    together (null ids too), so a leaf may pass its budget by all of them. Null and empty
    texts hold no tokens; a leaf without any is not read. An
    empty table gives an empty one. Without weights for a value no document is
    lost by itself, only by the budget. docs is read twice.
    """
    spark, names = docs.sparkSession, list(levels)
    bound_arrow(spark)
    inner = [f"level{k}" for k in range(len(names))]
    base = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in (docs.columns if carry is None else carry))).alias("row"),
        F.col(f"`{id_col}`").alias("id"),
        (word_count(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))) if n_tokens is None else F.greatest(F.lit(0), F.coalesce(n_tokens.cast("bigint"), F.lit(0)))).alias("n_tokens"),
        *(F.coalesce(F.expr(c).cast("string"), F.lit(NONE)).alias(k) for k, c in zip(inner, levels.values(), strict=True)),
    )
    leaf = F.struct(*inner).alias("leaf")
    counted = durable(base.select("id", "n_tokens", leaf), "lengths")
    leaves = durable(counted.groupBy("leaf").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("many")).select("leaf.*", "tokens", "many"), "leaves")
    given = leaf_budgets(leaves, inner, {k: weights.get(n, {}) for k, n in zip(inner, names, strict=True)}, share, max_epochs)
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("given") / F.col("tokens"))).otherwise(0).cast("bigint")
    plan = given.withColumn("whole", whole).select(leaf, "many", F.col("given").alias("leaf_budget"), "whole", (F.col("given") - F.col("whole") * F.col("tokens")).alias("rest"))
    plan = durable(plan, "plan")

    # The shard of each leaf in which its prefix ends, then the threshold inside that shard
    shards = shard_number(spark)
    partly = durable(plan.where("rest > 0").select("leaf", "many", "whole", "rest"), "partly")
    keyed = join_by_count(counted, partly, "leaf", "many").withColumn("key", epoch_key(seed, F.col("whole"), F.col("id"))).withColumn("shard", hex_shard(F.col("key"), shards))
    sums = keyed.groupBy("leaf", "shard", "rest").agg(F.sum("n_tokens").alias("t"))
    before = F.coalesce(F.sum("t").over(Window.partitionBy("leaf").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = durable(sums.withColumn("before", before).where("before < rest and before + t >= rest").select("leaf", "shard", "before"), "ends")
    inside = Window.partitionBy("leaf").orderBy("key", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    near = keyed.join(ends, ["leaf", "shard"]).withColumn("reached", F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    thresholds = near.where("reached < rest").groupBy("leaf").agg(F.max("key").alias("threshold"))
    final = durable(plan.join(thresholds, "leaf", "left").select("leaf", "many", "leaf_budget", "whole", "threshold"), "thresholds")

    # Whole rows meet their leaf where they are, unless there are very many leaves
    placed = base.withColumn("leaf", leaf)
    told = placed.join(F.broadcast(final), "leaf") if final.count() <= SENT_ROWS else join_by_count(placed, final, "leaf", "many")
    read = told.withColumn("extra", F.coalesce((epoch_key(seed, F.col("whole"), F.col("id")) <= F.col("threshold")).cast("bigint"), F.lit(0)))
    read = read.where("whole + extra > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("whole") + F.col("extra") - 1)))
    return read.select("row", "id", *(F.col(k).alias(n) for k, n in zip(inner, names, strict=True)), "n_tokens", "leaf_budget", "epoch")
