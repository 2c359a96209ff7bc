"""Texts cut off by field limits or on the way (problem 7), found with SQL expressions alone.

Texts are split into units (sentences, fields of a list), and units are counted before anything is exploded, once for each spelling. For
the last three words of every text it is counted how often they stand inside units and how often at the end of one, where a text could
end; if the last word is the beginning of a longer one after the same two words, each such place is inside. Words that are frequent inside and almost never
at an end mark a cut. What the words cannot tell (a cut between two sentences) is told by two other signs, reported beside them: a
mark of omission or markup left open, and a length of the source at which its texts pile up and most of them are cut by their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.session import stored

_MARK = r"(?:…|�|\[(?:more|\.\.\.|…)\]|\((?:more|\.\.\.)\)|<[a-zA-Z/]{0,4}|&[a-zA-Z]{1,5})\s*$"


def _normal(unit: Column) -> Column:
    """A unit with small letters and single blanks, numbers as 9, codes as shapes; a colon or comma belongs to its word, a closing mark does not."""
    text = F.translate(F.regexp_replace(unit, r"[.!?\s]+$", ""), "012345678", "999999999")
    text = F.regexp_replace(text, r"(?<![\p{L}\p{N}])(?:[A-Z]{3}|[a-z]{3})(?=[-/]?99)", "aaa")
    text = F.regexp_replace(text, r"(?=[9½¼¾])(?<![\p{L}\p{N}])(?:9[9.,/½¼¾]*(?<![.,])|[½¼¾])", "9")
    return F.trim(F.regexp_replace(F.lower(text), r"\s{2,}|[\t\x{A0}]", " "))


def _units(text: Column) -> Column:
    """Sentences and list fields of a text, without markup and marks of omission."""
    plain = F.regexp_replace(F.regexp_replace(text, _MARK, ""), r"<[^<>]{1,40}>", "\n")
    cut = r"(?=[\s;])(?:(?<=[.!?])(?<!\b[Nn]o\.)(?<!/oz\.)\s+(?=[^\p{Ll}\s])|\s*\n[\s-]*|\s+\|\s+|;\s+)"
    return F.filter(F.split(plain, cut), lambda u: F.trim(u) != "")


def _trigrams(words: Column) -> Column:
    padded = F.concat(F.array(F.lit("<s>"), F.lit("<s>")), words)
    return F.transform(
        F.sequence(F.lit(0), F.size(words) - 1),
        lambda i: F.struct(F.concat_ws(" ", F.get(padded, i), F.get(padded, i + 1)).alias("head"), F.get(padded, i + 2).alias("last")),
    )


def limits(texts: DataFrame, least: float = 0.4, z: float = 2.0) -> DataFrame:
    """(source, size): lengths at which a source cuts its texts. texts: (source, size, cut), one row a text; cut: whether its words say so.

    A source may have several limits. A length is one if the share of its texts that are cut is above least beyond chance: Wilson's lower
    bound at z deviations, so three texts that are all cut are enough, one or two never are.
    """
    by = texts.groupBy("source", "size").agg(F.count("*").alias("n"), F.count_if("cut").alias("k"))
    p, n = F.col("k") / F.col("n"), F.col("n")
    low = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    return by.filter((F.col("k") > 0) & (low > least)).select("source", "size")


def signs(records: DataFrame, key: str = "rid", text: str = "description", source: str = "source", terminal: float = 0.08) -> DataFrame:
    """(key, source, words, limit, mark): for each text of a record what says that it was cut.

    terminal: the share of their places at ends that is still almost never; half of it where a full stop follows. A text's own end is one of them, so its last words are
    judged only where they stand about a dozen times elsewhere. Null, empty and blank texts give no row. Rows that stand twice
    count twice. A null source is a source of its own.
    """
    rows = records.select(F.col(key).alias("id"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.col(text).alias("text")).filter("trim(text) <> ''")
    mark = F.substr("text", F.greatest(F.length("text") - 11, F.lit(1))).rlike(_MARK)
    # texts are taken apart once; what follows reads units
    rows = stored(rows.select("id", "source", F.length("text").alias("size"), mark.alias("mark"), _units(F.col("text")).alias("units")), "units")
    # every unit as typed is counted before its words are looked at
    units = rows.select(F.explode("units").alias("unit")).groupBy("unit").agg(F.count("*").alias("n"))
    units = units.select(_normal(F.col("unit")).alias("words"), "n").filter("words <> ''").groupBy("words").agg(F.sum("n").alias("n"))
    units = units.select(F.split("words", " ").alias("words"), "n")
    grams = units.select(F.posexplode(_trigrams(F.col("words"))).alias("i", "t"), "n", (F.size("words") - 1).alias("at"))
    within = grams.groupBy("t.head", "t.last").agg(F.sum(F.when(F.col("i") < F.col("at"), F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(F.col("i") == F.col("at"), F.col("n")).otherwise(0)).alias("n_end"))
    within = stored(within, "trigrams")
    end = F.try_element_at("units", F.lit(-1))
    rows = rows.select("id", "source", "size", "mark", F.split(_normal(end), " ").alias("w"), F.coalesce(end.rlike(r"(?:^|[^.])[.!?]\s*$"), F.lit(False)).alias("closed"))
    word = lambda i: F.coalesce(F.get("w", F.size("w") - i), F.lit("<s>"))
    rows = stored(rows.select("id", "source", "size", "mark", "closed", F.concat_ws(" ", word(3), word(2)).alias("head"), F.get("w", F.size("w") - 1).alias("last")), "ends")
    ends = rows.filter("last <> ''").select("head", "last", "closed").distinct()
    within = within.join(ends.select("head").distinct(), "head", "left_semi")
    # a last word may be the beginning of one that stands elsewhere; it is then inside, wherever that one stands, unless a full stop follows
    longer = F.length("last")
    begun = within.select("head", F.posexplode(F.transform(F.sequence(F.lit(1), longer), lambda i: F.substr(F.col("last"), F.lit(1), i))).alias("i", "begun"), F.col("n"), F.col("n_end"), longer.alias("longer"))
    part = F.col("i") + 1 < F.col("longer")
    begun = begun.groupBy("head", F.col("begun").alias("last")).agg(F.sum(F.when(part, F.col("n") + F.col("n_end")).otherwise(0)).alias("n_part"), F.sum(F.when(part, 0).otherwise(F.col("n"))).alias("n_whole"), F.sum(F.when(part, 0).otherwise(F.col("n_end"))).alias("n_end"))
    n_in = F.col("n_whole") + F.when(F.col("closed"), 0).otherwise(F.col("n_part"))
    rare = ends.join(begun, ["head", "last"]).filter(F.col("n_end") < F.when(F.col("closed"), terminal / 2).otherwise(terminal) * (n_in + F.col("n_end"))).select("head", "last", "closed", F.lit(True).alias("words"))
    rows = stored(rows.join(rare, ["head", "last", "closed"], "left").select("id", "source", "size", "mark", F.coalesce("words", F.lit(False)).alias("words")), "judged")
    at = limits(rows.select("source", "size", F.col("words").alias("cut"))).withColumn("limit", F.lit(True))
    rows = rows.join(at, ["source", "size"], "left")
    return rows.select(F.col("id").alias(key), "source", "words", F.coalesce("limit", F.lit(False)).alias("limit"), "mark")


def truncated(records: DataFrame, key: str = "rid", text: str = "description", source: str = "source", terminal: float = 0.08) -> DataFrame:
    """(key, source, why): each distinct text of a record that was cut, with all signs found, joined by commas: words, limit, mark."""
    x = signs(records, key, text, source, terminal)
    return x.select(key, "source", F.concat_ws(",", *[F.when(F.col(c), c) for c in ("words", "limit", "mark")]).alias("why")).filter("why <> ''").distinct()


def rates(records: DataFrame, cut: DataFrame, text: str = "description", source: str = "source", key: str = "rid") -> DataFrame:
    """(source, n_texts, n_cut, share): for each source its records with a text, those of them in cut, and their share."""
    have = records.filter(F.trim(text) != "").select(F.coalesce(F.col(source), F.lit("")).alias("source"), key).distinct().groupBy("source").agg(F.count("*").alias("n_texts"))
    gone = cut.select("source", key).distinct().groupBy("source").agg(F.count("*").alias("n_cut"))
    return have.join(gone, "source", "left").fillna(0, ["n_cut"]).withColumn("share", F.round(F.col("n_cut") / F.col("n_texts"), 6))
