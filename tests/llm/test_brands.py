from __future__ import annotations

import random

import pytest

from kindred.llm import brands

ENTRIES = [(1, "Pereal Lovi", "Fuganaazu"), (2, "Dehefart", None), (3, "Dehefalt", None), (4, "Sokira", None), (5, "Sazu Bevaolo Lend", None), (6, "Muor Nehol Fadial", "Nordik")]


def distance(a, b):
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_against_brute_force():
    trie, r = brands.BrandTrie(ENTRIES), random.Random(7)
    names = [(brands.letters(brands.folded(n)), i) for i, b, o in ENTRIES for n in (b, o) if n]
    for _ in range(600):
        w = list(r.choice(names)[0])
        for _ in range(r.randrange(4)):
            p = r.randrange(len(w))
            kind = r.random()
            if kind < 0.3:
                w[p] = r.choice("aeioudlr")
            elif kind < 0.5:
                w.insert(p, r.choice("aeioudlr"))
            elif kind < 0.7 and len(w) > 2:
                del w[p]
            elif p + 1 < len(w):
                w[p], w[p + 1] = w[p + 1], w[p]
        word = "".join(w)
        for k in (0, 1, 2):
            want: dict[int, int] = {}
            for n, i in names:
                if (d := distance(word, n)) <= k:
                    want[i] = min(want.get(i, 9), d)
            assert trie.within(word, k) == want, (word, k)


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("PEREAL LOVI GMBH", 1), ("Lovi, Pereal", 1), ("P. Lovi", 1), ("www.pereallovi.example", 1), ("Pereal Lovi Watering Cans", 1), ("Peréal Lovi", 1), ("P3real Lov1", 1), ("Pеrеаl Lоvi", 1),
        ("Fuganaazu", 1), ("Pereal Lovi (formerly Fuganaazu)", 1), ("by Sokira", 4), ("Sokira - USA", 4), ("The Sokira Company", 4), ('"Sokira"', 4), ("Sok.ira", 4), ("Skira", 4), ("S B L", 5), ("SBL", 5),
        ("M.N.F.", 6), ("Dehefart™", 2), ("Dehfealt", 3), ("N/A", 0), ("???", 0), ("-", 0), ("", 0), (None, 0), ("  ", 0), ("Loana Vuolt", 0), ("generic", 0), ("x" * 50_000, 0),
    ],
)
def test_meanings(value, want):
    assert brands.BrandTrie(ENTRIES).meant(value) == want


def test_map_brands(spark):
    listed = spark.createDataFrame(ENTRIES, "brand_id int, brand string, also_known_as string")
    rows = [("a", "sokira", 9), ("a", "sokira", 9), ("b", "Sokira", 9), ("c", None, 9), ("d", " ", 9), ("e", "Kukiamo", 9), (None, "x", 9)]
    records = spark.createDataFrame(rows, "rid string, brand string, brand_id int")
    assert sorted(map(tuple, brands.map_brands(records, listed).collect())) == [("a", 4), ("e", 0)]
    assert sorted(map(tuple, brands.unmatched(records, listed).collect())) == [("Kukiamo", 1), ("x", 1)]
    assert brands.map_brands(records.limit(0), listed).count() == 0 and brands.map_brands(records, listed.limit(0)).filter("brand_id <> 0").count() == 0
