from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from kindred.llm import components, splits

LINKS = "left_rid string, right_rid string, rid string, split string"


def brute(rows):
    root: dict[str, str] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in rows:
        ends = [x.strip().upper() for x in (a, b) if x and x.strip()]
        for x in ends:
            find(x)
        if len(ends) == 2:
            x, y = sorted(map(find, ends))
            root[y] = x
    return {x: find(x) for x in root}


def graph(seed):
    r = random.Random(seed)
    path = [(f"L{i:04d}", f"L{i + 1:04d}") for i in range(150)]
    star = [("R0000", f"M{i:04d}") for i in range(120)]
    noise = [(f"N{r.randrange(80):02d}", f"N{r.randrange(80):02d}") for _ in range(60)]
    dirty = [("l0000 ", "\tL0001"), ("Z1", "Z1"), ("Q1", None), (None, "Q2"), ("", "Q3"), (None, None), ("X2", "x1"), ("X1", "X2"), ("X2", "X1")]
    rows = path + star + noise + dirty + dirty
    r.shuffle(rows)
    return rows


def table(spark, rows):
    return spark.createDataFrame([(a, b, "clash", "clash") for a, b in rows], LINKS)


@pytest.mark.parametrize("seed", [1, 2])
def test_low_diameter_components(spark, seed):
    rows = graph(seed)
    got = components.groups(table(spark, rows)).collect()
    assert {r.rid: r.group_rid for r in got} == brute(rows) and len(got) == len(brute(rows))


def test_no_links(spark):
    for rows in ([], [(None, None)], [("a", None)]):
        got = {r.rid: r.group_rid for r in components.groups(table(spark, rows)).collect()}
        assert got == brute(rows)


def test_one_decomposition_keeps_clusters_small(spark):
    pairs = spark.range(400).select(F.col("id").cast("string").alias("src"), (F.col("id") + 1).cast("string").alias("dst"))
    edges = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    got = {int(r.v): int(r.c) for r in components.decompose(edges, 0, 0.4, 5).collect()}
    assert len(got) == 401 and max(abs(v - c) for v, c in got.items()) <= 5 and len(set(got.values())) < 250
    assert all(got[c] == c for c in set(got.values()))


@pytest.fixture(scope="module")
def grouped(spark):
    rows = graph(3)
    records = spark.createDataFrame([(f"A{i:03d}", "x") for i in range(400)] + [(None, "x"), ("a001", "x")], "rid string, group_rid string")
    return rows, splits.grouped(records, table(spark, rows)).cache()


def test_boruvka_groups_and_forest(spark, grouped):
    rows, groups = grouped
    want = brute(rows) | {f"A{i:03d}": f"A{i:03d}" for i in range(400)}
    assert {r.rid: r.group_rid for r in groups.collect()} == want
    ends = table(spark, rows).select(components.clean_rid(F.col("left_rid")).alias("a"), components.clean_rid(F.col("right_rid")).alias("b"))
    roots, forest = splits.spanning_forest(ends)
    tree = [(r.a, r.b) for r in forest.collect()]
    linked = [x for x in brute(rows) if any(x in (a, b) for a, b in tree)]
    assert len(tree) == len(linked) - len({brute(rows)[x] for x in linked})  # no cycles, nothing missing
    assert {brute(tree)[x] == brute(rows)[x] for x in linked} == {True} and roots.count() == len(linked)


def test_torn_groups(spark, grouped):
    _, groups = grouped
    rows = [("l0000 ", " TRAIN"), ("L0100", "test"), ("M0001", "train"), ("m0002", "Train "), ("A001", "test"), ("A001", None), ("W9", "test"), ("w9", "train"), (None, "test"), ("Q1", "  ")]
    got = splits.torn(groups, spark.createDataFrame([(a, b, "clash") for a, b in rows], "rid string, split string, group_rid string")).collect()
    assert sorted(r.group_rid for r in got) == ["L0000", "W9"]


def test_deal_keeps_groups_and_shares(spark, grouped):
    _, groups = grouped
    targets = spark.createDataFrame([("train", 0.6), ("validation", 0.2), ("test", 0.2), (None, 0.5)], "split string, target_share double")
    got = splits.deal(groups, targets).collect()
    assert len(got) == groups.count() and len({(r.group_rid, r.split) for r in got}) == len({r.group_rid for r in got})
    small = [r for r in got if r.rid.startswith("A")]
    assert sum(r.split == "train" for r in small) / len(small) == pytest.approx(0.6, abs=0.1)
    assert splits.deal(groups.limit(0), targets).count() == 0
