"""One group identifier for everything that pairwise matches link, directly or not (problem 2).

Low-diameter decomposition: every vertex draws an exponential shift; those with large shifts start early and grow breadth first, and a
vertex joins the cluster that reaches it first. Clusters are contracted to super-vertices, edges inside them vanish, and the
decomposition recurses on what is left. The assignments of all levels are composed from the last to the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.session import stored


def clean_rid(rid: Column) -> Column:
    """The clean form of a record identifier: without blanks, upper case; null where nothing is left."""
    return F.nullif(F.upper(F.regexp_replace(rid, r"[\s\x{A0}\x{FEFF}\x{200B}]+", "")), F.lit(""))


def decompose(edges: DataFrame, level: int, beta: float, rounds: int) -> DataFrame:
    """(v, c): one low-diameter decomposition of the symmetric edges (src, dst); every vertex lies within rounds of its centre c.

    Shifts are exponential with rate beta, cut at rounds, and drawn by hashing the vertex and level: the same on every attempt of a task.
    """
    unit = (F.pmod(F.xxhash64("src", F.lit(level)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    ends = edges.select("src").distinct()
    # a step of length nought to itself lets one join and one aggregate do each round
    steps = edges.select("src", "dst", F.lit(1.0).alias("far")).unionByName(ends.select("src", F.col("src").alias("dst"), F.lit(0.0).alias("far")))
    labels = ends.select("src", (rounds - F.least(-F.log(unit) / beta, F.lit(float(rounds)))).alias("at"), F.col("src").alias("c"))
    for _ in range(rounds):
        reached = steps.join(labels, "src").groupBy("dst").agg(F.min(F.struct((F.col("at") + F.col("far")).alias("at"), "c")).alias("l"))
        labels = reached.select(F.col("dst").alias("src"), "l.at", "l.c")
    return labels.select(F.col("src").alias("v"), "c")


def low_diameter_components(links: DataFrame, beta: float = 0.4, rounds: int = 5, max_levels: int = 60) -> DataFrame:
    """(v, c): c is the same for two vertices exactly if the links (a, b) connect them. Vertices without a link to another are left out.

    Null ends and loops link nothing; repeated and reversed links count once. An empty table gives an empty result. Hubs and groups that
    hold most of the links are aggregated partially before each shuffle and split by the adaptive skew join. Raises RuntimeError if
    max_levels levels do not finish, which is not to be expected below 2**60 vertices.
    """
    pairs = links.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).filter("src is not null and dst is not null and src <> dst").distinct()
    edges = stored(pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), "edges0")
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        if len(maps) == max_levels:
            raise RuntimeError(f"not finished after {max_levels} levels")
        maps.append(stored(decompose(edges, len(maps), beta, rounds), f"clusters{len(maps)}"))
        low, high = maps[-1].toDF("src", "s"), maps[-1].toDF("dst", "d")
        left = edges.filter("src < dst").join(low, "src").join(high, "dst").filter("s <> d")
        left = left.select(F.least("s", "d").alias("src"), F.greatest("s", "d").alias("dst")).distinct()
        edges = stored(left.unionByName(left.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), f"edges{len(maps)}")
    if not maps:
        return edges.select(F.col("src").alias("v"), F.col("dst").alias("c"))
    whole = maps[-1]
    for lower in reversed(maps[:-1]):
        whole = lower.join(whole.toDF("c", "top"), "c", "left").select("v", F.coalesce("top", "c").alias("c"))
    return whole


def groups(links: DataFrame, left: str = "left_rid", right: str = "right_rid", components=low_diameter_components) -> DataFrame:
    """(rid, group_rid): one row for each clean rid at either end of a row of links; group_rid is the smallest rid of its group.

    A row with one end null or blank links nothing, but its other end counts; a record linked to itself is a group of its own.
    """
    ends = links.select(clean_rid(F.col(left)).alias("a"), clean_rid(F.col(right)).alias("b"))
    rids = ends.select(F.explode(F.array("a", "b")).alias("rid")).filter("rid is not null").distinct()
    found = components(ends)
    low = found.groupBy("c").agg(F.min("v").alias("low"))
    named = found.join(low, "c").select(F.col("v").alias("rid"), F.col("low").alias("group_rid"))
    return rids.join(named, "rid", "left").select("rid", F.coalesce("group_rid", "rid").alias("group_rid"))
