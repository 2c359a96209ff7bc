"""Splits that keep linked records together (problem 6).

Borůvka contraction: in each round every super-vertex takes its lightest edge (weights are hashes of the links, so they are distinct and
the same on every attempt), pointers are followed towards the roots, and the graph is contracted. The chosen links are the minimum
spanning forest, which is kept as a table. Roots are then stratified by the size of their group and dealt to the splits in proportion.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.components import clean_rid
from kindred.session import prefix_sums, stored


def spanning_forest(links: DataFrame, jumps: int = 3, max_rounds: int = 60) -> tuple[DataFrame, DataFrame]:
    """((v, c), (a, b)): the root c of every vertex that links (a, b) tie to another, and the links of a minimum spanning forest.

    After jumps pointer doublings a pointer may still be short of its root; the vertices on the way are then contracted apart and
    joined in a later round, by a forest edge that was chosen already, so the forest stays free of cycles (weights are distinct).
    Null ends and loops link nothing. Empty links give two empty tables.
    """
    pairs = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a is not null and b is not null and a <> b").distinct()
    edges = stored(pairs.select(F.col("a").alias("u"), F.col("b").alias("v"), F.struct(F.xxhash64("a", "b").alias("w"), "a", "b").alias("e")), "forest-edges0")
    first, maps, chosen = edges, [], []
    while not edges.isEmpty():
        if len(maps) == max_rounds:
            raise RuntimeError(f"not finished after {max_rounds} rounds")
        ends = edges.select("u", F.struct("e", F.col("v").alias("to")).alias("best")).unionByName(edges.select(F.col("v").alias("u"), F.struct("e", F.col("u").alias("to")).alias("best")))
        best = stored(ends.groupBy("u").agg(F.min("best").alias("best")).select("u", "best.to", "best.e"), "lightest")
        chosen.append(best.select("e.a", "e.b").distinct())
        back = best.select(F.col("u").alias("to"), F.col("to").alias("back"))
        parent = best.select("u", "to").join(back, "to").select("u", F.when((F.col("back") == F.col("u")) & (F.col("u") < F.col("to")), F.col("u")).otherwise(F.col("to")).alias("p"))
        for _ in range(jumps):
            parent = stored(parent, "pointers")
            parent = parent.join(parent.toDF("p", "pp"), "p").select("u", F.col("pp").alias("p"))
        maps.append(stored(parent, f"roots{len(maps)}"))
        low, high = maps[-1].toDF("u", "cu"), maps[-1].toDF("v", "cv")
        left = edges.join(low, "u").join(high, "v").filter("cu <> cv")
        left = left.groupBy(F.least("cu", "cv").alias("u"), F.greatest("cu", "cv").alias("v")).agg(F.min("e").alias("e"))
        edges = stored(left, f"forest-edges{len(maps)}")
    if not maps:
        return first.select(F.col("u").alias("v"), F.col("v").alias("c")), first.select("e.a", "e.b")
    forest = chosen[0]
    for more in chosen[1:]:
        forest = forest.unionByName(more)
    whole = maps[-1].toDF("v", "c")
    for lower in reversed(maps[:-1]):
        whole = lower.toDF("v", "c").join(whole.toDF("c", "top"), "c", "left").select("v", F.coalesce("top", "c").alias("c"))
    return whole, stored(forest.distinct(), "forest")


def grouped(records: DataFrame, links: DataFrame) -> DataFrame:
    """(rid, group_rid) for every clean rid of records (column rid) and at either end of links (left_rid, right_rid); unlinked ones alone."""
    ends = links.select(clean_rid(F.col("left_rid")).alias("a"), clean_rid(F.col("right_rid")).alias("b"))
    rids = ends.select(F.explode(F.array("a", "b")).alias("rid")).unionByName(records.select(clean_rid(F.col("rid")).alias("rid"))).filter("rid is not null").distinct()
    roots, _ = spanning_forest(ends)
    low = roots.groupBy("c").agg(F.min("v").alias("low"))
    named = roots.join(low, "c").select(F.col("v").alias("rid"), F.col("low").alias("group_rid"))
    return rids.join(named, "rid", "left").select("rid", F.coalesce("group_rid", "rid").alias("group_rid"))


def torn(groups: DataFrame, manifest: DataFrame) -> DataFrame:
    """(group_rid): groups whose records stand in two or more splits of an earlier manifest (rid, split); null and blank splits do not count.

    Spelling of rid and split is cleaned of blanks and letter case. A record of the manifest that groups lacks is a group of its own.
    """
    split = F.nullif(F.lower(F.regexp_replace("split", r"[\s\x{A0}]+", "")), F.lit(""))
    stands = manifest.select(clean_rid(F.col("rid")).alias("rid"), split.alias("split")).filter("rid is not null and split is not null")
    found = stands.join(groups.select("rid", "group_rid"), "rid", "left").groupBy(F.coalesce("group_rid", "rid").alias("group_rid")).agg(F.min("split").alias("lo"), F.max("split").alias("hi"))
    return found.filter("lo <> hi").select("group_rid")


def deal(groups: DataFrame, targets: DataFrame, seed: int = 13) -> DataFrame:
    """(rid, group_rid, split): all records of a group in one split, the splits near their shares in targets (split, target_share).

    Groups are stratified by size band (powers of two). Within a band they stand in hashed order and each goes to the split in whose
    stretch of the band's records its middle lies. targets holds a few rows by definition; shares are taken relative to their sum.
    """
    shares = sorted((r.split, float(r.target_share)) for r in targets.filter("split is not null and target_share > 0").collect())
    total, upto, middle = sum(s for _, s in shares), 0.0, F.col("middle")
    shares.sort(key=lambda x: -x[1])
    split = None
    for name, share in shares:
        upto += share / total
        split = F.when(middle < upto, name) if split is None else split.when(middle < upto, name)
    split = split.otherwise(shares[-1][0])
    sizes = groups.groupBy("group_rid").agg(F.count("*").alias("n")).withColumns({"band": F.floor(F.log2("n")).cast("int"), "key": F.xxhash64("group_rid", F.lit(seed))})
    placed = prefix_sums(sizes, ["band"], ["key", "group_rid"], "n", "before")
    bands = sizes.groupBy("band").agg(F.sum("n").alias("of"))  # at most 64 rows
    dealt = placed.join(F.broadcast(bands), "band").withColumn("middle", (F.col("before") + F.col("n") / 2) / F.col("of")).select("group_rid", split.alias("split"))
    return groups.select("rid", "group_rid").join(dealt, "group_rid").select("rid", "group_rid", "split")
