"""What leaves the pipeline: accepted mappings, unmatched records and the queue for review."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators.decide import final_match


def with_human(pairs: DataFrame, decisions: DataFrame) -> DataFrame:
    """pairs with human_decision: the latest of decisions (left_rid, right_rid, human_decision, ts), or the empty string."""
    latest = decisions.groupBy("left_rid", "right_rid").agg(F.max_by("human_decision", "ts").alias("human_decision"))
    return pairs.join(latest, ["left_rid", "right_rid"], "left").withColumn("human_decision", F.coalesce("human_decision", F.lit("")))


# The columns of what leaves the pipeline.
MAPPING_COLUMNS = ["left_rid", "right_rid", "left_title", "right_title", "decision", "human_decision", "fuzzy_score", "jev_score", "material_diffs"]
QUEUE_COLUMNS = ["left_rid", "right_rid", "left_title", "right_title", "human_decision", "fuzzy_score", "jev_score", "material_diffs", "rule_reason"]
# End of the fixed values.


def _with_score(pairs: DataFrame) -> DataFrame:
    """pairs with jev_score: the judge's score by that name, or what judge_score holds, or null where no judge was asked."""
    if "jev_score" in pairs.columns:
        return pairs
    return pairs.withColumn("jev_score", F.col("judge_score") if "judge_score" in pairs.columns else F.lit(None).cast("double"))


def accepted(pairs: DataFrame) -> DataFrame:
    return _with_score(pairs.filter(final_match())).select(MAPPING_COLUMNS)


def unmatched(left: DataFrame, right: DataFrame, mapping: DataFrame) -> DataFrame:
    """(source, rid, title) of records on either side that no accepted pair holds."""
    a = left.join(mapping.select(F.col("left_rid").alias("rid")).distinct(), "rid", "left_anti")
    b = right.join(mapping.select(F.col("right_rid").alias("rid")).distinct(), "rid", "left_anti")
    return a.select("source", "rid", "title").unionByName(b.select("source", "rid", "title"))


def review_queue(pairs: DataFrame) -> DataFrame:
    return _with_score(pairs.filter("decision = 'review'")).select(QUEUE_COLUMNS)


def bundle(pairs: DataFrame, left: DataFrame, right: DataFrame) -> dict[str, DataFrame]:
    """The three tables of an export by name: mappings, unmatched, review_queue."""
    mappings = accepted(pairs)
    return {"mappings": mappings, "unmatched": unmatched(left, right, mappings), "review_queue": review_queue(pairs)}


def decided(pairs: DataFrame, verdict: str, at: datetime) -> DataFrame:
    """(left_rid, right_rid, human_decision, ts): rows to append to the decisions of people: every pair accepted, rejected or '' (taken back) at a time."""
    if verdict not in ("accepted", "rejected", ""):
        raise ValueError(verdict)
    return pairs.select("left_rid", "right_rid", F.lit(verdict).alias("human_decision"), F.lit(at).alias("ts")).distinct()


def decision_counts(pairs: DataFrame, decision: str = "decision") -> DataFrame:
    """(decision, n): how many pairs got each decision."""
    return pairs.groupBy(F.col(decision).alias("decision")).agg(F.count("*").alias("n"))


def search(pairs: DataFrame, pattern: str | None = None, decisions: list[str] | None = None, only_different: bool = False) -> DataFrame:
    """Pairs whose titles match a regular expression whatever the case, of given decisions, with material differences; best first."""
    x = pairs
    if pattern:
        x = x.filter(F.col("left_title").rlike(f"(?i){pattern}") | F.col("right_title").rlike(f"(?i){pattern}"))
    if decisions is not None:
        x = x.filter(F.col("decision").isin(decisions))
    if only_different:
        x = x.filter(F.length("material_diffs") > 0)
    return x.orderBy("decision", F.col("fuzzy_score").desc(), "left_rid", "right_rid")
