from __future__ import annotations

import random
import time
from pathlib import Path

import numpy as np
import pytest

from kindred import session
from kindred.llm import listings, matching, products

UNITS = [("length", "mm"), ("mass", "g"), ("volume", "ml"), ("power", "W"), ("storage", "MB"), ("temperature", "°C")]
BRANDS = [(1, "Pereal Lovi", "Fuganaazu"), (2, "Sokira", None), (3, "Dehefart", None)]
SCHEMA = "rid string, title string, description string, brand string, model string, product string"
SYLLABLES = ["te", "va", "do", "fi", "ki", "foo", "hu", "na", "suo", "ma", "no", "ba", "go", "lu", "pe", "ri"]
R = random.Random(4)
FAMILIES = [(BRANDS[i % 3][1], "".join(R.choice(SYLLABLES) for _ in range(5)).capitalize()) for i in range(48)]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(BRANDS, "brand_id int, brand string, also_known_as string"), spark.createDataFrame(UNITS, "kind string, unit string")


def offers(prefix, n):
    """Two sizes of each family, n offers of each, with slips, missing fields and sale talk."""
    out, truth = [], {}
    for f, (brand, family) in enumerate(FAMILIES):
        for s, litres in enumerate((2, 7)):
            code = f"QZ{chr(65 + f % 26)}{1000 + f * 10 + s}"
            for i in range(n):
                rid = f"{prefix}{f:02d}{s}{i:03d}"
                name = family[:4] + family[5:] if i == 3 else family
                size = f"{litres} litres" if i % 2 else f"{litres * 1000} ml"
                title = [f"{brand} {name} {size} Water Boiler", f"Water Boiler | {name} | {size} | HOT DEAL", f"{brand} {name} - {code} - Kettle", f"{name} {size} Kettle Free Shipping"][i % 4]
                out.append((rid, title, None if i % 3 else f"Holds up to {litres} l. Part no. {code}.", brand.upper() if i % 2 else None, code if i % 4 == 0 else None, "clash"))
                truth[rid] = (f, s)
    return out, truth


def test_listings(spark, tables):
    rows, truth = offers("M", 12)
    rows += [rows[0], ("M9", f"Spare Lid for Sokira {FAMILIES[1][1]} Kettle QZB1010", None, "Sokira", None, ""), ("M8", None, None, None, None, ""), ("M7", "", "", "", "", ""), (None, "x", None, None, None, "")]
    groups = listings.group_listings(spark.createDataFrame(rows, SCHEMA), *tables).cache()
    assert groups.count() == len(truth) + 3
    got = {(r.rid_a, r.rid_b) for r in listings.pairs(groups).collect()}
    want = {(a, b) for a in truth for b in truth if a < b and truth[a] == truth[b]}
    assert not got - want and len(got & want) / len(want) > 0.9
    empty = spark.createDataFrame([], SCHEMA)
    assert listings.group_listings(empty, *tables).count() == 0


def test_titles_decide(spark, tables):
    """A title that shares family, code and size with a product, and no other wording, is not of it; nor are brands and sizes that conflict."""
    family, code = "Tevadofiki", "QZA1234"
    rows = [(f"M{i}", f"Sokira {family} {code} Water Boiler 2 litres", None, "Sokira", code, "") for i in range(8)]
    rows += [("A1", f"{family} 2 litres cardboard poster showing mountains sunset forest landscape wallpaper decoration print", None, None, None, "")]
    rows += [("A2", f"{family} {code} cardboard poster showing mountains sunset forest landscape wallpaper decoration print", None, None, None, "")]
    rows += [("B1", f"Dehefart {family} {code} Water Boiler 2 litres", None, "Dehefart", None, ""), ("C1", f"{family} {code} Water Boiler 9 litres", None, None, None, "")]
    rows += [(f"N{i}", f"{brand} {name} Kettle {i} litres Official", None, brand, None, "") for i, (brand, name) in enumerate(FAMILIES, 2)]
    got = {r.rid: r["product"] for r in listings.group_listings(spark.createDataFrame(rows, SCHEMA), *tables).collect()}
    ours = {r for r in got if got[r] == got["M0"]}
    assert ours == {f"M{i}" for i in range(8)}, ours


@pytest.mark.parametrize("labels", [True, False])
def test_match(spark, tables, labels):
    a, ta = offers("L", 2)
    b, tb = offers("R", 4)
    gold = [(x, y, int(ta[x] == tb[y])) for x in ta for y in tb if labels and ta[x][0] == tb[y][0]]
    left, right = (spark.createDataFrame([*r, r[0], (None, None, None, None, None, ""), (r[0][0][0] + "null", None, None, None, None, "")], SCHEMA) for r in (a, b))
    x = matching.matches(matching.match(left, right, spark.createDataFrame(gold, "left_rid string, right_rid string, label int"), *tables))
    got = {(r.left_rid, r.right_rid) for r in x.collect()}
    want = {(x, y) for x in ta for y in tb if ta[x] == tb[y]}
    assert not got - want, sorted(got - want)
    assert len(got & want) / len(want) >= (0.9 if labels else 0.7), sorted(want - got)


def test_match_of_nothing(spark, tables):
    empty = spark.createDataFrame([], SCHEMA)
    assert matching.match(empty, empty, spark.createDataFrame([], "left_rid string, right_rid string, label int"), *tables).count() == 0


def test_posterior_stays_finite():
    r = np.random.default_rng(1)
    x = np.hstack([r.normal(size=(5000, 3)) * 30, np.ones((5000, 1))])
    y = (x[:, 0] > 0).astype(float)
    w = matching._posterior(x, y, np.array([-9.0, 4.0, 0.0, -7.0]))
    assert np.isfinite(w).all() and (((x @ w) > 0) == (y == 1)).mean() > 0.99


def test_buckets_find_the_near_ones(spark):
    """Candidates of hyperplane tables against all pairs, at the operator's own threshold: 0.9 of them or more."""
    near, recall = 0.6, 0.95
    r = np.random.default_rng(3)
    base = r.normal(size=(1500, 192))
    other = base + r.normal(size=base.shape) * r.uniform(0.2, 1.6, size=(1500, 1))
    count, bits = matching.tables_for(3000, near, recall)

    def side(v, prefix):
        v = np.round(v / np.linalg.norm(v, axis=1, keepdims=True) * matching.GRID) / matching.GRID
        rows = [(f"{prefix}{i}", x, [int(z) for z in k], [int(z) for z in c]) for i, (x, k, c) in enumerate(zip(matching.in_bytes(v), *matching.hashes(v, count, bits), strict=True))]
        return v, spark.createDataFrame(rows, "rid string, vector binary, buckets array<int>, code array<bigint>")

    (u, a), (v, b) = side(base, "a"), side(other, "b")
    want = {(f"a{i}", f"b{j}") for i, j in zip(*np.nonzero(u @ v.T >= near + 0.02), strict=True)}
    got = {(r.left_rid, r.right_rid): r.cosine for r in matching.candidates(a, b, near).collect()}
    assert len(want) > 1000 and len(want & set(got)) / len(want) >= 0.9 and min(got.values()) >= near


def test_slices_of_hash_tables_find_the_same(spark, monkeypatch):
    """A few hash tables at a time find what all of them at once find; no join sees the buckets of more of them, however many the corpus needs."""
    near, r = 0.6, np.random.default_rng(3)
    base = r.normal(size=(300, matching.DIM + matching.FIXED))
    count, bits = 23, 6
    v = np.vstack([base, base + r.normal(size=base.shape) * r.uniform(0.2, 1.6, size=(300, 1))])
    v = np.round(v / np.linalg.norm(v, axis=1, keepdims=True) * matching.GRID) / matching.GRID
    rows = [(f"r{i}", i < 300, bytearray((x * matching.GRID).astype(np.int16).tobytes()), [int(z) for z in c]) for i, (x, c) in enumerate(zip(v, matching.signs(v, count, bits), strict=True))]
    found = spark.createDataFrame(rows, "rid string, is_left boolean, grid binary, code array<bigint>")
    whole = [(f"r{i}", i < 300, bytearray(x), [int(z) for z in k], [int(z) for z in c]) for i, (x, k, c) in enumerate(zip(matching.in_bytes(v), *matching.hashes(v, count, bits), strict=True))]
    whole = spark.createDataFrame(whole, "rid string, is_left boolean, vector binary, buckets array<int>, code array<bigint>")
    want = sorted(matching.candidates(whole.filter("is_left"), whole.filter("not is_left"), near).collect())
    sizes, sharing = [], matching.sharing

    def counted(left, right, *rest):
        sizes.append(left.selectExpr("max(size(buckets))").first()[0])
        return sharing(left, right, *rest)

    monkeypatch.setattr(matching, "sharing", counted)
    monkeypatch.setattr(matching, "SLICE_ROWS", 600 * 5)
    assert sorted(matching._met(found, 600, count, bits, near).collect()) == want and len(want) > 100
    assert sizes == [5, 5, 5, 5, 3]


def test_match_leaves_only_its_result_on_disk(spark, tables, monkeypatch, tmp_path):
    """What match() wrote on its way is deleted as soon as nothing reads it: stored tables and shuffle files."""
    monkeypatch.setattr(session, "_tables", lambda _: f"file://{tmp_path}")
    local = [str(x) for x in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    shuffled = lambda: {p for d in local for p in Path(d).rglob("shuffle_*.data")}
    earlier, codec = shuffled(), spark.conf.get("spark.sql.parquet.compression.codec")
    (a, ta), (b, tb) = offers("L", 2), offers("R", 4)
    gold = spark.createDataFrame([(x, y, int(ta[x] == tb[y])) for x in ta for y in tb if ta[x][0] == tb[y][0]], "left_rid string, right_rid string, label int")
    x = matching.match(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), gold, *tables)
    assert [p.name.rpartition("-")[0] for p in tmp_path.iterdir()] == ["compared"]
    until = time.time() + 20
    while len(left := shuffled() - earlier) > 2 and time.time() < until:
        time.sleep(0.2)
    assert len(left) <= 2, left
    assert matching.matches(x).count() > 0 and spark.conf.get("spark.sql.parquet.compression.codec") == codec


def test_vectors_see_past_slips_and_partitions_play_no_part(spark, tables):
    """A pair with neither the name nor a code in common is found by its vectors; the result is the same however the rows lie."""
    a, ta = offers("L", 2)
    b, tb = offers("R", 4)
    empty = spark.createDataFrame([], "left_rid string, right_rid string, label int")
    found = []
    for n in (3, 11):
        left, right = (spark.createDataFrame(r, SCHEMA).repartition(n) for r in (a, b))
        x = matching.match(left, right, empty, *tables)
        found.append(sorted((r.left_rid, r.right_rid, r.confidence) for r in matching.matches(x).collect()))
    assert found[0] == found[1]
    alone = x.filter("same_family = 0 and same_code = 0 and near_family = 1").collect()
    assert any(ta[r.left_rid] == tb[r.right_rid] for r in alone)


def test_editions_are_told_by_the_corpus(spark, tables):
    rows = []
    for i, (brand, family) in enumerate(FAMILIES):
        rows += [(f"e{i}", f"{brand} {family} Neo Water Boiler", None, brand, None, ""), (f"f{i}", f"Kettle {family} Neo {brand}", None, brand, None, ""), (f"g{i}", f"{brand} {family} Kettle", None, brand, None, ""), (f"h{i}", f"{brand} Kettle {family}", None, brand, None, "")]
    x = products.parsed(spark.createDataFrame(rows, SCHEMA), *tables)
    families = products.family_words(x, tables[0])
    got = {r.rid: r.edition for r in products.with_editions(products.with_family(x, families), families).collect()}
    assert {v for k, v in got.items() if k[0] in "EF"} == {"neo"} and {v for k, v in got.items() if k[0] in "GH"} == {""}
