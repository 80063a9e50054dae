"""Mixing sources to target weights over a tree of domains, languages and sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textorbit.session import cut

#: Documents of a leaf are looked at one by one in a bucket of about so many only.
BUCKET_ROWS = 4_096


def _weight(levels: Sequence[str], weights: dict[str, int]) -> Column:
    """Weight of a node by its path, else by ``*/`` and its name, else 1."""
    if not weights:
        return F.lit(1).cast("long")
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    path = F.concat_ws("/", *levels)
    return F.coalesce(table[path], table[F.concat(F.lit("*/"), F.col(levels[-1]))], F.lit(1)).cast("long")


def share_budget(nodes: DataFrame, parents: Sequence[str], name: str) -> DataFrame:
    """Divide each parent's ``budget`` among its children by ``weight`` up to ``capacity``.

    Children whose share exceeds their capacity get the capacity, and what they leave goes
    to their siblings by weight.  Whole tokens; a remainder below the number of children
    is left over.  Adds ``granted``.
    """
    siblings = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    ordered = siblings.orderBy(F.col("capacity") / F.col("weight"), name)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    onward = ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    rows = nodes.withColumn("used", F.coalesce(F.sum("capacity").over(before), F.lit(0)))
    rows = rows.withColumn("heavy", F.sum("weight").over(onward))
    full = wide("capacity") * wide("heavy") <= (F.col("budget") - F.col("used")).cast("decimal(38,0)") * wide("weight")
    rows = rows.withColumn("full", full)
    rows = rows.withColumn("left", F.col("budget") - F.sum(F.expr("if(full, capacity, 0)")).over(siblings))
    rows = rows.withColumn("open", F.sum(F.expr("if(full, 0, weight)")).over(siblings))
    part = F.expr("cast(`left` as decimal(38,0)) * weight div open")
    granted = F.when(F.col("full"), F.col("capacity")).otherwise(part).cast("long")
    return rows.withColumn("granted", granted).drop("used", "heavy", "full", "left", "open")


def leaf_budgets(leaves: DataFrame, levels: Sequence[str], weights: dict[str, int], budget: int) -> DataFrame:
    """Budget of every leaf, from the root's ``budget`` down.

    ``leaves`` has the level columns and ``capacity``.  A node never gets more than its
    leaves can give, so what a leaf lacks is made up by its siblings first, and only what
    they can't give by the siblings of its ancestors.
    """
    # What lies below a weight of 0 has nothing to give, so its ancestors don't count it.
    for depth in range(len(levels)):
        leaves = leaves.where(_weight(levels[: depth + 1], weights) > 0)
    rows = leaves.withColumn("budget", F.lit(budget).cast("long"))
    for depth, name in enumerate(levels):
        parents, path = list(levels[:depth]), list(levels[: depth + 1])
        nodes = rows.groupBy(*path).agg(F.sum("capacity").alias("capacity"), F.first("budget").alias("budget"))
        nodes = nodes.withColumn("weight", _weight(path, weights))
        granted = share_budget(nodes, parents, name).select(*path, "granted")
        rows = rows.join(granted, path).drop("budget").withColumnRenamed("granted", "budget")
    return rows


def mix(
    docs: DataFrame,
    weights: dict[str, int],
    levels: Sequence[str] = ("domain", "lang", "source"),
    tokens: str = "tokens",
    doc_id: str = "doc_id",
    budget: Column | None = None,
    epochs: int = 2,
    seed: int = 7,
    row: str | None = None,
) -> DataFrame:
    """How often each document is taken so that token weights follow the tree.

    ``weights`` holds whole numbers by path ("web", "web/en", "web/en/src3") or by name on
    any path ("*/en"); other nodes weigh 1, and a weight of 0 leaves out a node and all below it,
    whose tokens are no reason to grant its parents more.  The root
    gets as many tokens as the aggregate ``budget`` over the leaves' ``total`` says (default:
    all), and a leaf gives at most ``epochs`` times what it has.  A leaf takes all its documents as many times as its budget holds them, then, in the next
    epoch's order (seed, epoch and id hashed), the longest prefix within the rest.

    Returns a row for each row of ``docs``: ``doc_id``, the levels, ``tokens`` and ``copies``
    (0: not taken).  A null level is the empty name; null or negative tokens are 0, and
    documents without tokens are taken with full epochs only.  Rows equal in id and leaf
    follow one another in the order.  An empty table gives an empty result.  ``row`` names a
    column that is unique by row: it is returned too, and orders rows without an id and equal ones.

    Only sums by leaf, and by leaf and hash bucket, are shuffled for all rows; documents
    are ordered in the one bucket of a leaf in which its prefix ends.
    """
    levels = list(levels)
    size = F.greatest(F.coalesce(F.col(tokens).cast("long"), F.lit(0)), F.lit(0))
    names = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in levels]
    carried = [] if row is None else [row]
    rows = cut(docs.select(F.col(doc_id).alias("doc_id"), *carried, *names, size.cast("long").alias("tokens")))
    leaves = rows.groupBy(*levels).agg(F.sum("tokens").alias("total"), F.count("*").alias("docs"))
    leaves = cut(leaves.withColumn("capacity", F.col("total") * F.lit(epochs)))
    asked = F.sum("total") if budget is None else budget
    largest, tokens_asked = leaves.agg(F.coalesce(F.max("docs"), F.lit(0)), F.coalesce(asked, F.lit(0))).first()
    digits = 0
    while digits < 7 and largest > BUCKET_ROWS * 16**digits:
        digits += 1
    granted = leaf_budgets(leaves, levels, weights, int(tokens_asked))
    whole = F.when(F.col("total") > 0, F.expr("budget div total")).otherwise(0)
    plan = leaves.select(*levels, "total").join(granted.select(*levels, "budget"), levels, "left")
    plan = plan.withColumn("budget", F.coalesce("budget", F.lit(0))).withColumn("whole", whole)
    plan = cut(plan.withColumn("rest", F.col("budget") - F.col("whole") * F.col("total")).drop("budget"))
    own = F.col("doc_id").cast("string")
    if row is not None:
        own = F.coalesce(own, F.concat(F.lit("row "), F.col(row).cast("string")))
    rank = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), own))
    rows = rows.join(plan, levels).withColumn("rank", rank).withColumn("bucket", F.substring("rank", 1, digits))
    buckets = rows.where("rest > 0").groupBy(*levels, "bucket", "rest").agg(F.sum("tokens").alias("held"))
    running = Window.partitionBy(*levels).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("before", F.coalesce(F.sum("held").over(running), F.lit(0)))
    last = buckets.where("before + held > rest").groupBy(*levels)
    last = last.agg(F.min("bucket").alias("edge"), F.min("before").alias("before"))
    rows = rows.join(last, levels, "left")
    inside = F.expr("int(rest > 0 and bucket < edge)")
    plain = rows.where("edge is null or bucket != edge").withColumn("part", F.coalesce(inside, F.lit(0)))
    order = Window.partitionBy(*levels).orderBy("rank", "doc_id", "tokens", *carried)
    reached = F.col("before") + F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    edge = rows.where("bucket = edge").withColumn("part", (reached <= F.col("rest")).cast("int"))
    out = plain.unionByName(edge)
    return out.select("doc_id", *carried, *levels, "tokens", (F.col("whole") + F.col("part")).cast("long").alias("copies"))
