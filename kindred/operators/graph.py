"""Groups of records that links tie together, and a split that keeps them whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.session import prefix_sums, stored


def connected(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, group): the least node of each node's component. links: (a, b); null ends and loops are left out.

    Alternating stars: every node's larger neighbours are tied to the least of its neighbourhood, then its smaller ones, until all links are
    stars around their least node; that takes about log squared of the longest path, and hubs shrink with every round.
    """
    edges = stored(links.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links0")
    for i in range(max_rounds):
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("leaf")), F.struct(F.col("v").alias("node"), F.lit(0).alias("leaf")))).alias("e")).select("e.*")
        # in a star a leaf has one link, and no node is both a leaf and a centre
        if ends.groupBy("node").agg(F.sum("leaf").alias("n"), F.min("leaf").alias("centre")).filter("n > 1 or (n = 1 and centre = 0)").isEmpty():
            roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("group"))
            return edges.select(F.col("u").alias("node"), F.col("v").alias("group")).unionByName(roots)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        edges = stored(small, f"links{i + 1}")
    raise RuntimeError(f"not finished after {max_rounds} rounds")


def product_groups(left: DataFrame, right: DataFrame, gold: DataFrame) -> DataFrame:
    """(side, rid, group): records of both sides (rid), those that gold pairs link in one group, the others alone."""
    node = lambda side, c: F.concat(F.lit(f"{side}:"), F.col(c))
    groups = connected(gold.select(node("L", "left_rid").alias("a"), node("R", "right_rid").alias("b")))
    every = left.select(F.lit("L").alias("side"), "rid").unionByName(right.select(F.lit("R").alias("side"), "rid")).distinct()
    named = every.withColumn("node", F.concat_ws(":", "side", "rid")).join(groups, "node", "left")
    return named.select("side", "rid", F.coalesce("group", "node").alias("group"))


def group_split(groups: DataFrame, dev_share: float = 0.4, seed: int = 13) -> DataFrame:
    """(side, rid, group, split): the first dev_share of the groups, in hashed order, are dev with all their records, the others test."""
    each = groups.select("group").distinct().withColumns({"key": F.xxhash64("group", F.lit(seed)), "one": F.lit(1), "all": F.lit(1)})
    n = each.count()
    placed = prefix_sums(each, ["all"], ["key", "group"], "one", "at")
    split = placed.select("group", F.when(F.col("at") < F.floor(F.lit(n * dev_share)), "dev").otherwise("test").alias("split"))
    return groups.join(split, "group").select("side", "rid", "group", "split")


def split_statistics(manifest: DataFrame) -> DataFrame:
    """(split, source, n): records by split and source."""
    return manifest.groupBy("split", "source").agg(F.count("*").alias("n"))


def manifest(split: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(source, rid, split): each record of either side (source, rid) with its split (side, rid, split)."""
    of = lambda side, records: records.select("source", "rid").distinct().join(split.filter(F.col("side") == side).select("rid", "split"), "rid").select("source", "rid", "split")
    return of("L", left).unionByName(of("R", right))


def gold_by_split(gold: DataFrame, split: DataFrame) -> DataFrame:
    """(split, n): gold pairs (left_rid, right_rid) by the split of their left record."""
    at = split.filter("side = 'L'").select(F.col("rid").alias("left_rid"), "split")
    return gold.select("left_rid", "right_rid").distinct().join(at, "left_rid").groupBy("split").agg(F.count("*").alias("n"))


def with_split(pairs: DataFrame, split: DataFrame) -> DataFrame:
    """pairs with the split of their left record, which alone decides; null for a record without one."""
    return pairs.join(split.filter("side = 'L'").select(F.col("rid").alias("left_rid"), "split"), "left_rid", "left")


def sample_left(pairs: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """The pairs of n left records, those with the smallest hash: a sample for the judge that is the same on every run."""
    chosen = pairs.select("left_rid").distinct().orderBy(F.xxhash64("left_rid", F.lit(seed)), "left_rid").limit(n)
    return pairs.join(chosen, "left_rid", "left_semi")
