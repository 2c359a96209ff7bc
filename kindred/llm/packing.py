"""Containers of fixed capacity filled with texts (problem 8).

Only the counts of lengths matter, and there are no more lengths than tokens in a container: the plan is made on that histogram,
whatever the number of texts. Lengths are taken from the longest on; a single, pair or triple of other lengths that fills the gap exactly is looked
up in indexes of length sums and used as often as all its lengths are left. What remains is packed best fit. Texts are then dealt to the
places of the plan by their rank among the texts of the same length.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.tokens import with_tokens
from kindred.session import prefix_sums, stored


def plan(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths in a container, number of such containers)] for counts[l] texts of length l, l from 1 to the capacity len(counts)-1."""
    n, capacity = counts.astype(np.int64).copy(), len(counts) - 1
    done: dict[tuple[int, ...], int] = defaultdict(int)

    def take(lengths: tuple[int, ...]) -> None:
        need = {x: lengths.count(x) for x in lengths}
        times = min(int(n[x]) // k for x, k in need.items())
        if times:
            for x, k in need.items():
                n[x] -= k * times
            done[tuple(sorted(lengths, reverse=True))] += times

    for a in range(capacity, 0, -1):
        if not n[a]:
            continue
        gap = capacity - a
        if gap == 0:
            take((a,))
            continue
        if n[gap]:
            take((a, gap))
        # pairs b + c = gap: both ends of the index of counts, read against each other
        if n[a] and gap > 1:
            b = np.arange(gap - 1, (gap - 1) // 2, -1)
            for x in b[(n[b] > 0) & (n[gap - b] > 0)]:
                if not n[a]:
                    break
                take((a, int(x), int(gap - x)))
        # triples b + c + d = gap: sums of pairs are indexed by a convolution of the lengths that are left
        if n[a] and gap > 2:
            have = (n[: gap + 1] > 0).astype(np.float64)
            have[0] = 0
            size = 1 << (2 * gap + 1).bit_length()
            f = np.fft.rfft(have, size)
            sums = np.fft.irfft(f * f, size)[: gap + 1] > 0.5
            b = np.arange(gap - 2, 0, -1)
            for x in b[(n[b] > 0) & sums[gap - b]]:
                if not n[a]:
                    break
                rest = int(gap - x)
                c = np.arange(rest - 1, (rest - 1) // 2, -1)
                for y in c[(n[c] > 0) & (n[rest - c] > 0)]:
                    take((a, int(x), int(y), int(rest - y)))
                    if not n[a] or not n[x]:
                        break
    # best fit of the rest, longest first: into the fullest containers that still have room
    open_: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    for a in range(capacity, 0, -1):
        left = int(n[a])
        while left:
            room = min((r for r in open_ if r >= a and open_[r]), default=None)
            if room is None:
                each = capacity // a
                full, part = divmod(left, each)
                for lengths, k in (((a,) * each, full), ((a,) * part, 1)):
                    if k and lengths:
                        at = open_[capacity - a * len(lengths)]
                        at[lengths] = at.get(lengths, 0) + k
                break
            lengths, k = open_[room].popitem()
            fits = min(k, left)
            if k > fits:
                open_[room][lengths] = k - fits
            at = open_[room - a]
            at[(*lengths, a)] = at.get((*lengths, a), 0) + fits
            left -= fits
    for by in open_.values():
        for lengths, k in by.items():
            done[tuple(sorted(lengths, reverse=True))] += k
    return sorted(done.items(), reverse=True)


def places(made: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length, the ranks at which stretches of its texts begin and the first container of each stretch."""
    begin: dict[int, list[int]] = defaultdict(list)
    first: dict[int, list[int]] = defaultdict(list)
    upto: dict[int, int] = defaultdict(int)
    base = 0
    for lengths, k in made:
        for x in lengths:
            begin[x].append(upto[x])
            first[x].append(base)
            upto[x] += k
        base += k
    return {x: (np.array(begin[x]), np.array(first[x])) for x in begin}


def pack(documents: DataFrame, pack_sizes: DataFrame) -> DataFrame:
    """(pack_name, bin_id, doc_id, piece, first_token, n_tokens): every text in one container of each kind of pack_sizes.

    A text larger than a container is cut into pieces of the capacity and a rest. Null and empty texts fill nothing and are left out.
    Containers hold no more than their capacity. Ranks among texts of a length are distributed prefix sums, so a length that a third of
    all texts have is no single task's work; the histogram sent to the driver has at most as many rows as a container has tokens.
    """
    spark = documents.sparkSession
    sized = stored(with_tokens(documents.select("doc_id", "text")).select("doc_id", "n_tokens").filter("n_tokens > 0 and doc_id is not null"), "sized")
    sizes = {r.pack_name: int(r.capacity_tokens) for r in pack_sizes.filter("capacity_tokens > 0 and pack_name is not null").collect()}  # a few rows by definition
    kinds = spark.createDataFrame(sorted(sizes.items()), "pack_name string, capacity int") if sizes else spark.createDataFrame([], "pack_name string, capacity int")
    cut = sized.crossJoin(F.broadcast(kinds))  # each text once for each kind
    pieces = cut.withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_tokens") - 1) / F.col("capacity")).cast("int"))))
    pieces = pieces.select("pack_name", "doc_id", "piece", (F.col("piece") * F.col("capacity")).cast("bigint").alias("first_token"), F.least(F.col("capacity").cast("bigint"), F.col("n_tokens") - F.col("piece") * F.col("capacity")).cast("int").alias("n_tokens"))
    ranked = prefix_sums(pieces.withColumns({"one": F.lit(1), "key": F.xxhash64("doc_id", "piece")}), ["pack_name", "n_tokens"], ["key", "doc_id", "piece"], "one", "rank")
    histogram = pieces.groupBy("pack_name", "n_tokens").agg(F.count("*").alias("n")).toPandas()
    where: dict[str, dict[int, tuple[np.ndarray, np.ndarray]]] = {}
    for name, capacity in sizes.items():
        counts = np.zeros(capacity + 1, np.int64)
        own = histogram[histogram.pack_name == name]
        counts[own.n_tokens.to_numpy(dtype=int)] = own.n
        where[name] = places(plan(counts))

    @F.pandas_udf("bigint")
    def bin_of(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for name, length, rank in batches:
            out = np.zeros(len(name), np.int64)
            for key, rows in pd.DataFrame({"p": name.to_numpy(), "l": length.to_numpy(), "i": np.arange(len(name))}).groupby(["p", "l"]).i:
                begin, first = where[key[0]][int(key[1])]
                r = rank.to_numpy()[rows]
                at = np.searchsorted(begin, r, side="right") - 1
                out[rows] = first[at] + r - begin[at]
            yield pd.Series(out)

    return ranked.select("pack_name", bin_of("pack_name", "n_tokens", "rank").alias("bin_id"), "doc_id", "piece", "first_token", "n_tokens")


def fill(packed: DataFrame, pack_sizes: DataFrame) -> DataFrame:
    """(pack_name, capacity_tokens, n_bins, n_tokens, share_filled) of each kind of container."""
    by = packed.groupBy("pack_name").agg(F.count_distinct("bin_id").alias("n_bins"), F.sum("n_tokens").alias("n_tokens"))
    share = F.round(F.col("n_tokens") / (F.col("n_bins") * F.col("capacity_tokens")), 6)
    return pack_sizes.select("pack_name", "capacity_tokens").distinct().join(by, "pack_name").withColumn("share_filled", share)
