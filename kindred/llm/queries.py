"""Named queries of the operators for training data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kindred.llm import brands, components, listings, matching, mixing, oracle, packing, repetition, splits, truncation
from kindred.plans.tables import records, table
from kindred.session import stored

Query = Callable[[SparkSession, str], DataFrame]


def p1_matches(spark: SparkSession, d: str) -> DataFrame:
    columns = ("rid", "title", "description", "brand", "model", "price")
    left, right = table(spark, d, "catalog_left").select(*columns), table(spark, d, "catalog_right").select(*columns)
    pairs = matching.match(left, right, table(spark, d, "gold_mapping"), table(spark, d, "brand_list"), table(spark, d, "target_units"))
    return matching.matches(pairs).select("left_rid", "right_rid", "confidence")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_matches(spark, d).select("left_rid", "right_rid")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return components.groups(table(spark, d, "mappings").select("left_rid", "right_rid"))


def _listing_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "listings").select("rid", "title", "description", "brand", "model")
    return listings.group_listings(rows, table(spark, d, "brand_list"), table(spark, d, "target_units"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return listings.pairs(stored(_listing_groups(spark, d), "products"))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return _listing_groups(spark, d)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return brands.map_brands(records(spark, d, "rid", "brand"), table(spark, d, "brand_list"))


def p5_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return brands.unmatched(records(spark, d, "brand"), table(spark, d, "brand_list"))


def _groups(spark: SparkSession, d: str) -> DataFrame:
    return stored(splits.grouped(records(spark, d, "rid"), table(spark, d, "mappings").select("left_rid", "right_rid")), "groups")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.torn(_groups(spark, d), table(spark, d, "split_manifest"))


def p6_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.deal(_groups(spark, d), table(spark, d, "split_targets"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(records(spark, d, "rid", "source", "description")).select("rid").distinct()


def p7_rates(spark: SparkSession, d: str) -> DataFrame:
    texts = records(spark, d, "rid", "source", "description")
    return truncation.rates(texts, truncation.truncated(texts))


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "pack_sizes"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p8_pack(spark, d), table(spark, d, "pack_sizes"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents").select("doc_id", "source", "text"), table(spark, d, "source_weights"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents").select("doc_id", "source", "text"), table(spark, d, "source_weights"))[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetitive(table(spark, d, "documents").select("doc_id", "text"))


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetition(table(spark, d, "documents").select("doc_id", "text"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_matches, p2_found, p3_found, p3_groups, p5_found, p5_unmatched, p6_found, p6_splits, p7_found, p7_rates, p8_pack, p8_fill, p9_mixture, p9_shares, p10_found, p10_shares)}

_CLEAN = "nullif(upper(regexp_replace({0}, '\\s+', '', 'g')), '')"
_GROUPS = f"""
  ends AS (SELECT {_CLEAN.format('left_rid')} AS a, {_CLEAN.format('right_rid')} AS b FROM mappings),
  edges AS (SELECT DISTINCT a AS src, b AS dst FROM ends WHERE a <> b UNION SELECT DISTINCT b, a FROM ends WHERE a <> b),
  rids AS (SELECT a AS rid FROM ends WHERE a IS NOT NULL UNION SELECT b FROM ends WHERE b IS NOT NULL),
  reached AS (SELECT rid, rid AS other FROM rids UNION SELECT r.rid, e.dst FROM reached r JOIN edges e ON r.other = e.src),
  grouped AS (SELECT rid, min(other) AS group_rid FROM reached GROUP BY rid)
"""
ORACLES: dict[str, str] = oracle.ORACLES | {
    "p2_found": f"WITH RECURSIVE {_GROUPS} SELECT rid, group_rid FROM grouped",
    "p6_found": f"""WITH RECURSIVE {_GROUPS},
  stands AS (SELECT {_CLEAN.format('rid')} AS rid, nullif(lower(regexp_replace(split, '\\s+', '', 'g')), '') AS split FROM split_manifest)
SELECT coalesce(g.group_rid, s.rid) AS group_rid FROM stands s LEFT JOIN grouped g ON s.rid = g.rid WHERE s.split IS NOT NULL AND s.rid IS NOT NULL
GROUP BY 1 HAVING count(DISTINCT s.split) > 1""",
    "p10_found": r"""WITH w AS (
  SELECT doc_id, list_filter(list_transform(regexp_split_to_array(lower(text), '[\s\x{A0}\x{2000}-\x{200A}\x{202F}\x{3000}]+'), lambda x: regexp_replace(x, '\P{L}+', '', 'g')), lambda x: x <> '') AS ws
  FROM documents WHERE text IS NOT NULL),
  g AS (SELECT doc_id, i, array_to_string(ws[i:i+3], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 2)) AS i FROM w)),
  again AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(i) OVER (PARTITION BY doc_id, gram) AS first FROM g) WHERE i > first),
  marked AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2, i + 3]) AS pos FROM again) GROUP BY doc_id)
SELECT m.doc_id FROM marked m JOIN w ON w.doc_id = m.doc_id WHERE m.n >= 0.3 * len(w.ws) - 1e-9""",
}
