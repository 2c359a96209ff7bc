"""Listings of the same product (problem 3).

Blocks are rare words of the titles: the word of the corpus that names the product family, slips put right. In a block the products are
profiles, one for each maker's code, or for each size where no listing has a code. A listing is compared with the profiles of its block,
never with all other listings: profiles with conflicting numbers, codes, editions or brands are vetoed, the character n-grams of title and profile weighted by inverse frequency
must be near, and of the profiles left the one that agrees in most quantities is taken, of several such one that is clearly the nearest.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kindred.llm.products import KINDS, TOLERANCE, agreements, family_words, parsed, with_editions, with_family, with_text
from kindred.operators.graph import connected
from kindred.session import stored

GRAM_BUCKETS = 1 << 14
WORD_BUCKETS = 1 << 16
#: the most frequent words of a product's titles that its profile keeps, and by how much the nearest of profiles equally good otherwise must be nearer
PROFILE_WORDS, CLEAR = 32, 0.1


def _hashes(text: str) -> list[int]:
    text = f" {text} "
    return [xxhash.xxh32_intdigest(text[i : i + 3]) % GRAM_BUCKETS for i in range(len(text) - 2)]


def text_weights(rows: DataFrame) -> np.ndarray:
    """Inverse frequencies over all titles (column text): of the hashed character trigrams, then of the hashed words: an array of fixed size."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(GRAM_BUCKETS + WORD_BUCKETS, np.int64)
        for b in batches:
            for word, n in zip(b.word, b.n, strict=True):
                total[list(set(_hashes(word)))] += n
                total[GRAM_BUCKETS + xxhash.xxh32_intdigest(word) % WORD_BUCKETS] += n
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    n_titles = rows.count()
    words = rows.select(F.explode("text").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    got = words.mapInPandas(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(GRAM_BUCKETS + WORD_BUCKETS)
    df[got.bucket.to_numpy(dtype=int)] = got.n
    return np.log((1 + n_titles) / (1 + np.minimum(df, n_titles)) + 1e-3 + 1).astype(np.float32)


def gram_cosine(weights: np.ndarray):
    """A function of four columns: the cosine of the character trigrams of two lists of words (of a title, of a profile), each word counting so often.

    A trigram weighs its inverse frequency times that of the word it stands in, so words of sales talk count little. 0 where one is null or empty.
    """

    @F.pandas_udf("double")
    def cosine(a: pd.Series, k: pd.Series, b: pd.Series, n: pd.Series) -> pd.Series:
        grams: dict[str, list[tuple[int, float]]] = {}
        known: dict[tuple, tuple[dict[int, float], float]] = {}

        def vector(words, counts) -> tuple[dict[int, float], float]:
            v: dict[int, float] = {}
            for word, k in zip(words, counts, strict=True):
                if word not in grams:
                    w = float(weights[GRAM_BUCKETS + xxhash.xxh32_intdigest(word) % WORD_BUCKETS])
                    grams[word] = [(h, w * float(weights[h])) for h in _hashes(word)]
                for h, w in grams[word]:
                    v[h] = v.get(h, 0.0) + k * w
            return v, sum(x * x for x in v.values()) ** 0.5

        out = []
        for x, j, y, m in zip(a, k, b, n, strict=True):
            if x is None or y is None or not len(x) or not len(y):
                out.append(0.0)
                continue
            if (key := tuple(y)) not in known or known[key][2] != tuple(m):
                known[key] = (*vector(y, m), tuple(m))
            (u, nu), (v, nv, _) = vector(x, j), known[key]
            out.append(sum(w * v[h] for h, w in u.items() if h in v) / (nu * nv) if nu and nv else 0.0)
        return pd.Series(out, dtype=float)

    return cosine


def _common_words(rows: DataFrame, by: list[str], out: str) -> DataFrame:
    """(by, out): the most frequent words of each group's titles, as structs of n and word."""
    words = rows.select(*by, F.explode("text").alias("word")).groupBy(*by, "word").agg(F.count("*").cast("int").alias("n"))
    return words.groupBy(*by).agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "word")), False), 1, PROFILE_WORDS).alias(out))


def _profiles(rows: DataFrame, key: str, block_words: DataFrame) -> DataFrame:
    """(family, variant, product, pq, p_said, p_brand, p_words, p_counts, p_code, p_n): what all rows of a product say, each value once.

    p_said tells in how many rows each quantity stands, p_counts in how many titles each of the profile's words. A product of few listings hardly holds
    all wordings of its kind of goods, so the words of the block's titles count as well as its own.
    """
    q = [F.array_distinct(F.flatten(F.collect_set(f"q.{k}"))).alias(k) for k in KINDS]
    rows = rows.withColumn("product", F.col(key))
    by = rows.groupBy("family", "variant", "product").agg(*q, F.mode("brand_id", True).alias("p_brand"), F.max("code").alias("p_code"), F.count("*").alias("p_n"))
    told = lambda kind: F.transform(F.coalesce(f"q.{kind}", F.array().cast("array<bigint>")), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("v")))
    said = F.explode(F.concat(*[told(k) for k in KINDS])).alias("x")
    said = rows.select("product", said).groupBy("product", "x").agg(F.count("*").alias("n")).groupBy("product").agg(F.collect_list(F.struct("x.kind", "x.v", "n")).alias("p_said"))
    by = by.join(_common_words(rows, ["product"], "w"), "product", "left").join(said, "product", "left").join(block_words, ["family", "variant"], "left")
    words = F.concat(F.coalesce("w", F.array().cast("array<struct<n:int,word:string>>")), F.coalesce("b", F.array().cast("array<struct<n:int,word:string>>")))
    return by.select("family", "variant", "product", F.struct(*KINDS).alias("pq"), "p_said", "p_brand", words["word"].alias("p_words"), words["n"].alias("p_counts"), "p_code", "p_n")


def _cosine(cosine) -> Column:
    """How near a row's title is to the profile it has met."""
    return cosine("text", F.array_repeat(F.lit(1), F.size("text")), "p_words", "p_counts")


def _brands_fit() -> Column:
    return F.expr("p_brand is null or brand_id is null or p_brand = brand_id")


def _unlike_others() -> Column:
    """Whether a row is the only one of its own profile to say its value of a kind, where two or more other values are said."""
    def of(kind: str) -> Column:
        own, others = F.coalesce(F.col(f"q.{kind}"), F.array().cast("array<bigint>")), F.filter("p_said", lambda s: s["kind"] == kind)
        slack = (lambda u, v: F.lit(2)) if kind == "temperature" else (lambda u, v: F.greatest(F.abs(u), F.abs(v)) * TOLERANCE)
        near = F.filter(others, lambda s: F.exists(own, lambda u: F.abs(u - s["v"]) <= slack(u, s["v"])))
        rows = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda x, s: x + s["n"])
        alone = (F.size(own) > 0) & (rows(near) <= F.size(own)) & (rows(others) - rows(near) >= 2)
        return F.coalesce(alone, F.lit(False))

    return reduce(Column.__or__, [of(k) for k in KINDS])


def _confirmed(rows: DataFrame, profiles: DataFrame, cosine, near: float) -> DataFrame:
    """(rid, product): the rows (with their product) that fit the profile of their own product: brand and quantities veto, the title is near."""
    met = rows.join(profiles.drop("family", "variant"), "product").filter(_brands_fit()).filter(~_unlike_others())
    return met.filter(_cosine(cosine) >= near).select("rid", "product")


def _assign(rows: DataFrame, profiles: DataFrame, cosine, near: float, need: int) -> DataFrame:
    """(rid, product) for rows that fit a profile of their block: no veto, title near, at least need quantities agreeing, and none as good.

    Of profiles that agree in as many quantities the nearest is taken if it is clearly nearer than the others.
    """
    agree, conflict = agreements("q", "pq")
    met = rows.join(profiles, ["family", "variant"])
    met = met.filter(_brands_fit()).withColumns({"agree": agree, "conflict": conflict}).filter(f"conflict = 0 and agree >= {need}")
    met = met.withColumn("cosine", _cosine(cosine)).filter(F.col("cosine") >= near)
    best = met.groupBy("rid").agg(F.max(F.struct("agree", "cosine", "product")).alias("best"), F.collect_set(F.struct("agree", "cosine", "product")).alias("all"))
    rivals = F.filter("all", lambda x: (x.agree == F.col("best.agree")) & (x.cosine > F.col("best.cosine") - CLEAR))
    return best.filter(F.size(F.array_distinct(F.transform(rivals, lambda x: x["product"]))) == 1).select("rid", F.col("best.product").alias("product"))


def group_listings(listings: DataFrame, brand_list: DataFrame, target_units: DataFrame, near: float = 0.55) -> DataFrame:
    """(rid, product): for every listing with a rid the product group it belongs to; one that fits no other is a group of its own.

    Accessories are apart from what they are made for. A listing without code and quantities joins a family's product only if the family
    has one. Null, empty and odd titles leave a listing alone. Rows repeated for a rid count once.
    """
    rows = stored(parsed(listings, brand_list, target_units), "parsed")
    families = stored(family_words(rows, brand_list), "families")
    rows = stored(with_editions(with_family(rows, families), families).withColumn("variant", F.concat_ws(":", "edition", "part_of")), "with-editions")
    rows = stored(with_text(rows, families), "named")
    cosine = gram_cosine(text_weights(rows))
    in_block = rows.filter("family is not null").select("rid", "family", "variant", "text", "code", "brand_id", "q")
    block_words = stored(_common_words(in_block, ["family", "variant"], "b"), "block-words")
    # 1. a product for each code, and for each other maker that uses it
    coded = in_block.filter("code is not null").withColumn("product", F.concat_ws("|", F.lit("code"), "family", "variant", "code"))
    profiles = stored(_profiles(coded, "product", block_words), "coded")
    placed = stored(_confirmed(coded, profiles, cosine, near), "placed")
    others = coded.join(profiles.select("product", "p_brand"), "product").filter("brand_id <> p_brand").drop("p_brand").withColumn("product", F.concat_ws("|", "product", F.col("brand_id").cast("string")))
    others = stored(others, "others")
    other_profiles = stored(_profiles(others, "product", block_words), "other-makers")
    placed = placed_codes = stored(placed.unionByName(_confirmed(others, other_profiles, cosine, near)), "placed")
    profiles = stored(profiles.unionByName(other_profiles), "coded")
    # 2. listings without a code, to the profile whose quantities they share
    open_ = in_block.filter("code is null")
    joined = stored(_assign(open_, profiles, cosine, near, 1), "joined")
    rest = open_.join(joined, "rid", "left_anti")
    # 3. products no listing of which has a code: by size, in the kind of quantity that most of the block's rest has
    long = rest.select("rid", "family", "variant", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.array_max(f"q.{k}").alias("v")) for k in KINDS])).alias("x")).select("rid", "family", "variant", "x.*").filter("v is not null")
    counts = long.groupBy("family", "variant", "kind").agg(F.count("*").alias("n"))
    main = counts.groupBy("family", "variant").agg(F.max(F.struct(F.when(F.col("kind").isin("volume", "power", "storage"), F.col("n") * 2).otherwise(F.col("n")).alias("w"), "kind")).alias("m")).select("family", "variant", F.col("m.kind").alias("kind"))
    sized = long.join(main, ["family", "variant", "kind"])
    values = sized.groupBy("family", "variant", "v").agg(F.count("*").alias("n"))
    before = W.partitionBy("family", "variant").orderBy("v")
    starts = values.withColumn("first", (F.coalesce(F.col("v") > F.lag("v").over(before) * (1 + TOLERANCE), F.lit(True))).cast("int"))
    sizes = starts.withColumn("cluster", F.sum("first").over(before)).select("family", "variant", "v", "cluster")
    keyed = sized.join(sizes, ["family", "variant", "v"]).select("rid", F.concat_ws("|", F.lit("size"), "family", "variant", "kind", F.col("cluster").cast("string")).alias("product"))
    by_size = stored(rest.join(keyed, "rid"), "by-size")
    more = stored(_profiles(by_size, "product", block_words), "sizes")
    fitting = stored(_confirmed(by_size, more, cosine, near), "fitting")
    # a size and a code that say nothing of each other are one product if neither has another choice
    conflict = agreements("q", "pq")[1]
    choice = more.withColumnsRenamed({"product": "size", "pq": "q", "p_brand": "brand_id", "p_words": "text", "p_counts": "text_n"}).select("family", "variant", "size", "q", "brand_id", "text", "text_n").join(profiles, ["family", "variant"])
    choice = choice.filter((conflict == 0) & _brands_fit()).filter(cosine("text", "text_n", "p_words", "p_counts") >= near).select("size", "product")
    sure = choice.groupBy("size").agg(F.count("*").alias("n"), F.first("product").alias("product")).filter("n = 1")
    sure = stored(sure.join(choice.groupBy("product").agg(F.count("*").alias("m")).filter("m = 1"), "product").select("size", "product"), "sure")
    sized_rows = fitting.join(sure.withColumnRenamed("product", "one"), F.col("product") == F.col("size"), "left").select("rid", F.coalesce("one", "product").alias("product"))
    placed = stored(placed.unionByName(joined).unionByName(sized_rows), "placed-so-far")
    more = more.join(sure.select(F.col("size").alias("product")), "product", "left_anti").select(*profiles.columns)
    rest = rest.join(by_size.select("rid"), "rid", "left_anti")
    profiles = stored(profiles.unionByName(more), "profiles")
    last = stored(_assign(rest, profiles, cosine, near, 1), "last")
    rest = rest.join(last, "rid", "left_anti")
    # 4. what says nothing goes where there is but one product; a family of which nothing is said at all is one
    only = profiles.groupBy("family", "variant").agg(F.count("*").alias("n"), F.first("product").alias("product"), F.first("p_brand").alias("p_brand"))
    conflict = agreements("q", "pq")[1]
    sole = profiles.join(only.filter("n = 1").select("family", "variant"), ["family", "variant"], "left_semi")
    fits = rest.join(sole, ["family", "variant"]).filter(_brands_fit()).filter(conflict == 0).filter(_cosine(cosine) >= near).select("rid", "product")
    silent = rest.join(only.select("family", "variant"), ["family", "variant"], "left_anti").withColumn("product", F.concat_ws("|", F.lit("family"), "family", "variant"))
    silent = _confirmed(silent, _profiles(silent, "product", block_words), cosine, near)
    placed = stored(placed.unionByName(last).unionByName(fits).unionByName(silent).groupBy("rid").agg(F.min("product").alias("product")), "placed-at-last")
    out = rows.select("rid", "variant", "code", "brand_id", "q").join(placed, "rid", "left")
    # 5. one maker's code is one product, even where titles spell the family in ways that no rule brings together, or leave it out: brands and codes
    # are the same here and titles are not, so quantities alone veto
    named = coded.drop("product").join(placed_codes, "rid").filter("brand_id is not null").groupBy("variant", "code", "brand_id").agg(F.min("product").alias("one"), F.collect_set("product").alias("products"))
    named = stored(named, "makers-codes")
    met = named.filter("size(products) > 1").select("one", F.explode("products").alias("product")).filter("one <> product")
    met = met.join(profiles.select(F.col("product").alias("one"), "pq"), "one").join(profiles.select("product", F.col("pq").alias("q")), "product").filter(conflict == 0)
    # products that meet under several makers or codes are one, however long the chain
    same = stored(connected(met.select(F.col("one").alias("a"), F.col("product").alias("b"))), "same")
    out = out.join(same.toDF("product", "whole"), "product", "left").withColumn("product", F.coalesce("whole", "product")).drop("whole")
    one = named.join(profiles.select(F.col("product").alias("one"), "pq"), "one").join(same.toDF("one", "whole"), "one", "left").select("variant", "code", "brand_id", F.coalesce("whole", "one").alias("one"), "pq")
    out = out.join(one, ["variant", "code", "brand_id"], "left")
    return out.select("rid", F.coalesce("product", F.when(conflict == 0, F.col("one")), F.concat(F.lit("rid|"), F.col("rid"))).alias("product"))


def pairs(groups: DataFrame) -> DataFrame:
    """(rid_a, rid_b): all pairs of one product, rid_a < rid_b."""
    a, b = groups.toDF("rid_a", "product"), groups.toDF("rid_b", "product")
    return a.join(b, "product").filter("rid_a < rid_b").select("rid_a", "rid_b")
