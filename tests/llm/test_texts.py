from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kindred.llm import mixing, packing, repetition, truncation
from kindred.llm.tokens import with_tokens


def brute_share(words, run=4):
    mark = [False] * len(words)
    for i in range(len(words) - run + 1):
        if any(words[j : j + run] == words[i : i + run] for j in range(i)):
            mark[i : i + run] = [True] * run
    return sum(mark) / len(words) if words else 0.0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c"]), max_size=40))
def test_repeated_share(words):
    assert repetition.repeated_share(words) == pytest.approx(brute_share(words))


def test_words():
    assert repetition.words_of("The CAT-5 sat, on 12 mats!") == ["the", "cat", "sat", "on", "mats"] and repetition.words_of(None) == [] and repetition.words_of(" 1 2 ") == []


def documents(spark, n=400):
    r = random.Random(1)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    rows = []
    for i in range(n):
        words = [r.choice(vocabulary) for _ in range(r.randrange(30, 120))]
        if i % 5 == 0:
            words += words[: int(len(words) * r.uniform(0.6, 1.0))]
        rows.append((i, " ".join(words), "clash"))
    rows += [(n, None, ""), (n + 1, "", ""), (n + 2, "same " * 20_000, ""), (n + 3, rows[0][1], ""), (n + 3, rows[0][1], "")]
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string, score string")


def test_repetitive_finds_all_and_scores_hold_out(spark):
    rows, df = documents(spark)
    want = {i for i, t, _ in rows if t and brute_share(t.split()[:3000]) >= 0.3}
    got = [r.doc_id for r in repetition.repetitive(df, sample_rows=150).collect()]
    assert set(got) == want and len(got) == len(want)
    scored = repetition.repetition(df, sample_rows=150).collect()
    assert len(scored) == len(rows)
    right = sum((r.score >= 0.5) == (r.repeated_share >= 0.3) for r in scored)
    assert right / len(scored) > 0.97
    assert repetition.repetitive(df.limit(0)).count() == 0


def test_model_without_both_classes():
    m = repetition.fit(np.zeros((5, 4 * repetition.BUCKETS)), np.zeros(5))
    x = repetition.features(["a", "b", "c", "d"] * 5)
    assert m.score(x[None])[0] > 0.5 > m.score(np.zeros((1, 4 * repetition.BUCKETS)))[0]


def test_buckets_have_weights_of_their_own():
    """Rows whose sums are all alike differ only in the bucket that repeats; the same n-gram falls into the same bucket in every text."""
    x = np.zeros((300, 4 * repetition.BUCKETS))
    x[np.arange(300), np.where(np.arange(300) % 2 == 0, 3, 7)] = 1
    y = (np.arange(300) % 2 == 0).astype(float)
    assert ((repetition.fit(x, y).score(x) >= 0.5) == (y == 1)).all()
    tail = ["again", "again"]
    ours = [set(np.flatnonzero(repetition.features([*head, *tail]))) for head in (["one"], ["one", "two", "three"])]
    assert ours[0] & set(range(repetition.BUCKETS)) == ours[1] & set(range(repetition.BUCKETS))


def descriptions(spark):
    r = random.Random(2)
    nouns, places = ["lid", "ring", "handle", "cable", "frame"], ["small kitchens", "damp cellars", "long evenings"]
    say = [lambda: f"Wipe the {r.choice(nouns)} with a damp cloth after use.", lambda: f"Made for {r.choice(places)} and {r.choice(places)}.", lambda: f"The {r.choice(nouns)} can be removed for cleaning.", lambda: f"It weighs {r.randrange(1, 9)}.{r.randrange(9)} kg."]
    rows = []
    for i in range(600):
        text = " ".join(r.choice(say)() for _ in range(r.randrange(2, 6)))
        rows.append((f"r{i}", "free", text, 1))
        rows.append((f"c{i}", "limited", text[:90], 1))
    rows += [
        ("x1", "free", "The ring can be removed for cleaning. Wipe the lid with a da", 1), ("x2", "free", "It weighs 3 kg. Made for small kitchens and", 1), ("x3", "free", "Made for long evenings [more]", 1), ("x4", "free", "Made for dam…", 1),
        ("x5", "free", "The lid can be removed for clea<b", 1), ("ok1", "free", "The ring can be removed for cleaning", 1), ("ok2", "free", "Made for damp cellars and small kitchens", 1), ("n1", "free", None, 1), ("n2", "free", " ", 1), ("n3", None, "It weighs 1.2 kg.", 1), ("x1", "free", "The ring can be removed for cleaning. Wipe the lid with a da", 1),
    ]
    return rows, spark.createDataFrame(rows, "rid string, source string, description string, n int")


def test_truncated(spark):
    rows, df = descriptions(spark)
    got = {(r.rid, r.why) for r in truncation.truncated(df).collect()}
    by = dict(got)
    assert by["x1"] == by["x2"] == "words" and by["x3"] == by["x4"] == by["x5"] == "words,mark"
    assert not {"ok1", "ok2", "n1", "n2", "n3"} & set(by) and not [k for k in by if k.startswith("r")]
    assert {k for k in by if k.startswith("c")} == {k for k, _, t, _ in rows if k.startswith("c") and len(t) >= 90}
    share = {r.source: r.share for r in truncation.rates(df, truncation.truncated(df)).collect()}
    assert share["limited"] > 0.5 > share["free"]
    assert truncation.truncated(df.limit(0)).count() == 0


def test_words_alone_find_most_cuts_and_a_source_may_have_two_limits(spark):
    rows, _ = descriptions(spark)
    texts = [t for _, s, t, _ in rows if s == "free" and t and len(t) > 130]
    planted = [(f"a{i}", "twice", t[: 90 if i % 2 else 120]) for i, t in enumerate(texts)] + [(f"w{i}", "whole", t) for i, t in enumerate(texts)]
    got = truncation.signs(spark.createDataFrame(planted, "rid string, source string, description string")).toPandas()
    cut = got[got.source == "twice"]
    assert cut.words.mean() > 0.8 and (cut.words | cut.limit).mean() > 0.95
    assert not (got[got.source == "whole"].words | got[got.source == "whole"].limit).any()


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 60), st.data())
def test_plan_uses_every_piece_once(capacity, data):
    counts = np.array([0, *data.draw(st.lists(st.integers(0, 6), min_size=capacity, max_size=capacity))])
    used = np.zeros_like(counts)
    for lengths, k in packing.plan(counts):
        assert sum(lengths) <= capacity and k > 0
        for x in lengths:
            used[x] += k
    assert (used == counts).all()


def test_exact_triples_are_found():
    counts = np.zeros(101, int)
    counts[[51, 24, 15, 10]] = [3, 3, 3, 3]
    assert packing.plan(counts) == [((51, 24, 15, 10), 3)]


def test_places_of_plan():
    made = [((5, 5), 2), ((5, 3), 1)]
    begin, first = packing.places(made)[5]
    assert begin.tolist() == [0, 2, 4] and first.tolist() == [0, 0, 2]


def test_pack(spark):
    rows, df = documents(spark, 120)
    sizes = spark.createDataFrame([("small", 64), ("large", 300), (None, 5)], "pack_name string, capacity_tokens int")
    got = packing.pack(df, sizes).toPandas()
    lengths = {r.doc_id: r.n_tokens for r in with_tokens(df).collect() if r.n_tokens}
    for name, capacity in (("small", 64), ("large", 300)):
        own = got[got.pack_name == name]
        assert own.groupby("bin_id").n_tokens.sum().max() <= capacity
        whole = own.drop_duplicates(["doc_id", "piece"]).groupby("doc_id").n_tokens.sum().to_dict()
        assert whole == lengths
        assert all(n == 1 for i, n in own.drop_duplicates(["doc_id", "piece"]).doc_id.value_counts().items() if lengths[i] <= capacity)
    for r in packing.fill(packing.pack(df, sizes), sizes).collect():
        assert r.share_filled > 0.97
    assert packing.pack(df.limit(0), sizes).count() == 0


def test_mixture(spark):
    rows, df = documents(spark, 300)
    df = df.selectExpr("doc_id", "text", "case when doc_id % 3 = 0 then ' Big' when doc_id % 30 = 1 then 'SMALL ' when doc_id % 3 = 1 then 'mid' end as source", "1 as budget")
    weights = spark.createDataFrame([("big", 0.5, 1, 0), ("mid", 0.3, 1, 0), ("small", 0.2, 3, 0), ("none", 0.1, 2, 0), (None, 0.5, 1, 0)], "source string, target_share double, max_repeats int, used int")
    used, report = mixing.mixture(df, weights)
    report = {r.source: r for r in report.collect()}
    assert report["none"].used == 0 and set(report) == {"big", "mid", "small", "none"}
    limit = {"big": 1, "mid": 1, "small": 3}
    rows = used.collect()
    assert all(1 <= r.n_uses <= limit[r.source] for r in rows) and len({r.doc_id for r in rows}) >= len(rows) - 1
    for s, share in (("big", 0.5), ("mid", 0.3), ("small", 0.2)):
        assert report[s].used <= report[s].budget and report[s].actual_share == pytest.approx(share, abs=0.05)
    assert any(report[s].used == report[s].available * limit[s] for s in limit)  # the scarcest source is used up
    nothing, empty = mixing.mixture(df.limit(0), weights)
    assert nothing.count() == 0 and empty.agg({"used": "sum"}).first()[0] == 0
