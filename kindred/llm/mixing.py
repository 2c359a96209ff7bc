"""A mixture of sources by target shares (problem 9).

Every document draws a hash-random key. Within each source documents are range-sorted by it, distributed prefix sums of their tokens
are taken, and the source is cut at its exact budget; where a budget exceeds what the source has, its order is gone through again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.tokens import with_tokens
from kindred.session import prefix_sums, stored


def clean_source(source: Column) -> Column:
    """Small letters, blanks around dropped; null where nothing is left."""
    return F.nullif(F.lower(F.regexp_replace(source, r"^[\s\x{A0}]+|[\s\x{A0}]+$", "")), F.lit(""))


def budgets(sizes: DataFrame, weights: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, available, budget): how many tokens each source gives.

    The whole is the largest that every source with documents can fill up to its share within its repeats; sources without documents
    give nothing, and the others' shares are scaled up for them. sizes: (source, available).
    """
    w = weights.select(clean_source(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("target_share"), "max_repeats").filter("source is not null and target_share > 0 and max_repeats > 0")
    x = w.join(sizes, "source", "left").fillna(0, ["available"])
    present = x.filter("available > 0").agg(F.sum("target_share").alias("present"))
    x = x.crossJoin(F.broadcast(present))  # one row
    whole = x.filter("available > 0").agg(F.min(F.col("available") * F.col("max_repeats") / (F.col("target_share") / F.col("present"))).alias("whole"))
    x = x.crossJoin(F.broadcast(whole))  # one row
    budget = F.when(F.col("available") > 0, F.floor(F.col("whole") * F.col("target_share") / F.col("present") + 1e-6)).otherwise(0).cast("bigint")
    return x.select("source", "target_share", "max_repeats", "available", budget.alias("budget"))


def mixture(documents: DataFrame, weights: DataFrame, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """((doc_id, source, n_tokens, n_uses), (source, target_share, max_repeats, available, budget, used, actual_share)).

    A document is used once more in each pass in which it ends within the source's budget, so no document is used more than max_repeats
    times and no source exceeds its budget by a token; what is missing to the budget is less than one document. Documents without
    text, without a source or of a source without weight are not used. Source names are compared without blanks and letter case.
    """
    sized = stored(with_tokens(documents.select("doc_id", clean_source(F.col("source")).alias("source"), "text")).select("doc_id", "source", "n_tokens").filter("source is not null and n_tokens > 0 and doc_id is not null"), "sized")
    plan = stored(budgets(sized.groupBy("source").agg(F.sum("n_tokens").alias("available")), weights), "budgets")  # as many rows as weights
    wanted = sized.join(F.broadcast(plan.select("source", "budget", "available", "max_repeats")), "source").withColumn("key", F.xxhash64("doc_id", F.lit(seed)))
    placed = prefix_sums(wanted, ["source"], ["key", "doc_id"], "n_tokens", "before")
    uses = F.floor((F.col("budget") - F.col("before") - F.col("n_tokens")) / F.col("available")) + 1
    used = stored(placed.select("doc_id", "source", "n_tokens", F.least(uses, F.col("max_repeats")).cast("int").alias("n_uses")).filter("n_uses > 0"), "mixture")
    by = used.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_uses")).alias("used"))
    report = plan.join(by, "source", "left").fillna(0, ["used"])
    whole = report.agg(F.sum("used").alias("whole"))
    report = report.crossJoin(F.broadcast(whole)).withColumn("actual_share", F.round(F.try_divide(F.col("used"), F.col("whole")), 6)).drop("whole")
    return used, report
