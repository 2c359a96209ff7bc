"""Catalog rows to records: columns mapped, texts cleaned, identifiers and attributes extracted."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions import text as T


@dataclass(frozen=True)
class ColumnMap:
    """Which columns hold what; only id and title are needed."""

    id: str = "rid"
    title: str = "title"
    description: str | None = None
    brand: str | None = None
    model: str | None = None
    price: str | None = None
    currency: str | None = None
    default_currency: str | None = None

    def to_dict(self) -> dict:
        return asdict(self)


def guess_columns(names: list[str], default_currency: str | None = "USD") -> ColumnMap:
    """A column map by the usual names, whatever their case; the first two columns stand in for id and title."""

    def first(*wanted: str) -> str | None:
        return next((n for n in names if n.lower() in wanted), None)

    return ColumnMap(
        id=first("id") or names[0],
        title=first("name", "title") or names[min(1, len(names) - 1)],
        description=first("description"),
        brand=first("manufacturer", "brand"),
        model=first("model", "mpn"),
        price=first("price"),
        default_currency=default_currency,
    )


FULL = ColumnMap(description="description", brand="brand", model="model", price="price", currency="currency")


def one_row_each(catalog: DataFrame, rid: str = "rid") -> DataFrame:
    """One row for each rid, of every other column the least value; rows without rid are left out."""
    return catalog.filter(F.col(rid).isNotNull()).groupBy(rid).agg(*[F.min(c).alias(c) for c in catalog.columns if c != rid])


def build_records(catalog: DataFrame, columns: ColumnMap = FULL, source: str | None = None) -> DataFrame:
    """A record for each row: source, rid, the cleaned fields, their normal forms, identifiers and attributes.

    Missing text is the empty string; missing price, currency and number of pieces are null. source: a name for the whole catalog, or
    null to take the column source.
    """
    pick = lambda c: T.text_of(F.col(c).cast("string")) if c else F.lit("")
    base = catalog.select(
        (F.lit(source) if source is not None else F.col("source")).alias("source"),
        F.col(columns.id).cast("string").alias("rid"),
        pick(columns.title).alias("title"),
        pick(columns.description).alias("description"),
        pick(columns.brand).alias("brand"),
        pick(columns.model).alias("model"),
        pick(columns.price).alias("price_raw"),
        (F.nullif(pick(columns.currency), F.lit("")) if columns.currency else F.lit(None).cast("string")).alias("_currency"),
    )
    base = base.withColumns({"title_norm": T.normalized(F.col("title")), "desc_norm": T.normalized(F.col("description")), "_brand": T.normalized(F.col("brand"))})
    full = F.concat(F.col("title"), F.lit(" "), F.col("description"))
    tokens = T.model_tokens(F.col("model"), T.without_compatibility(F.col("title")))
    return (
        base.withColumns(
            {
                "price": T.price(F.col("price_raw")),
                "currency": F.coalesce("_currency", T.price_currency(F.col("price_raw")), F.lit(columns.default_currency)),
                "brand_norm": F.when(F.col("brand") == "", T.first_word(F.col("title"))).otherwise(F.col("_brand")),
                "explicit_model": T.canonical_model(F.col("model")),
                "model_tokens": tokens,
                "pack_qty": T.pack_quantity(full),
                "condition": T.condition(full),
                "capacities": T.capacities(F.col("title_norm")),
                "accessory_hint": T.is_accessory(F.col("title")),
                "bundle_hint": T.is_bundle(F.col("title")),
            }
        )
        .withColumns(
            {
                "compat_model_tokens": F.array_except(T.model_tokens(F.col("title")), F.col("model_tokens")),
                "desc_model_tokens": F.array_except(T.model_tokens(F.col("description")), F.col("model_tokens")),
            }
        )
        .drop("_currency", "_brand")
    )


def common_tokens(records: DataFrame, max_df: int = 8) -> DataFrame:
    """(token, df): identifiers that more than max_df records of the catalog share."""
    each = records.select("rid", F.explode(F.array_distinct("model_tokens")).alias("token"))
    return each.groupBy("token").agg(F.count("*").alias("df")).filter(F.col("df") > max_df)


def prune_common(left: DataFrame, right: DataFrame, max_df: int = 8) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(left, right, pruned tokens with df): identifiers common in either catalog are taken out of model_tokens of both.

    Tokens are taken out by a join on the token, so the list of common tokens may be long. Of a token common in both, the right's df is told.
    """
    a, b = common_tokens(left, max_df).withColumn("side", F.lit(1)), common_tokens(right, max_df).withColumn("side", F.lit(2))
    pruned = a.unionByName(b).groupBy("token").agg(F.max_by("df", "side").alias("df"))

    def without(records: DataFrame) -> DataFrame:
        held = records.select("rid", F.posexplode("model_tokens").alias("i", "token")).join(pruned.select("token"), "token", "left_anti")
        kept = held.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("i", "token"))).alias("k")).select("rid", F.transform("k", lambda s: s["token"]).alias("_kept"))
        return records.join(kept, "rid", "left").withColumn("model_tokens", F.coalesce("_kept", F.array().cast("array<string>"))).drop("_kept")

    return without(left), without(right), pruned


def flattened(records: DataFrame) -> DataFrame:
    """Records for display: lists joined by blanks, the map as JSON."""
    lists = ["model_tokens", "desc_model_tokens", "compat_model_tokens"]
    return records.withColumns({c: F.array_join(c, " ") for c in lists} | {"capacities": F.to_json("capacities")})


def visible_fields(records: DataFrame, description_chars: int | None = None) -> DataFrame:
    """(rid, fields): what a judge sees of a record, as JSON: title always, the others where they are not empty."""
    text = F.col("description") if description_chars is None else F.substr(F.col("description"), F.lit(1), F.lit(description_chars))
    some = lambda c: F.nullif(c, F.lit(""))
    shown = F.struct(F.col("title"), some(text).alias("description"), some(F.col("brand")).alias("brand"), some(F.col("model")).alias("model"), some(F.col("price_raw")).alias("price"))
    return records.select("rid", F.to_json(shown).alias("fields"))
