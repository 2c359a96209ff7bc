"""What titles and descriptions say about a product, as columns: shared by the operators that match records and group listings.

Nothing here knows a list of brands, families or kinds of goods: which words name a product family is told by the corpus. A word that stands
in titles of one brand mostly, and hardly ever in the brand field, names a family; slips are put right by words one edit away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.brands import meanings
from kindred.llm.components import clean_rid
from kindred.operators import units
from kindred.session import stored

#: a maker's code: three letters and four digits, written in many ways; with a blank between them the letters may also be a word before a number
_CODE = r"(?<![\p{L}\p{N}])((?:[A-Z]{3}|[a-z]{3})(?:[-/]?\d{4}|[-/]?\d{2}-\d{2})(?:[-/]?[A-Za-z])?)(?![\p{L}\p{N}]|[.,]\d)"
_APART = r"(?<![\p{L}\p{N}])((?:[A-Z]{3}|[a-z]{3}) (?:\d{4}|\d{2}-\d{2})(?:[-/]?[A-Za-z])?)(?![\p{L}\p{N}]|[.,]\d)"
#: six kinds of quantity, by definition; a reading may differ by a share or, for temperatures, by degrees, through rounding
KINDS = ["length", "mass", "volume", "power", "storage", "temperature"]
TOLERANCE = 0.03


def squeezed(code: Column) -> Column:
    return F.nullif(F.upper(F.regexp_replace(code, r"[^\p{L}\p{N}]", "")), F.lit(""))


def plain(text: Column) -> Column:
    """Small letters without accents."""
    return F.translate(F.lower(text), "áàâäãåéèêëíìîïóòôöõúùûüñçšž", "aaaaaaeeeeiiiiooooouuuuncsz")


def title_words(title: Column) -> Column:
    """Words of two letters or more, plain, each once; codes are no words."""
    rest = F.regexp_replace(F.regexp_replace(title, _CODE, " "), _APART, " ")
    return F.array_distinct(F.regexp_extract_all(plain(rest), F.lit(r"(?<![\p{L}\p{N}])(\p{L}{2,})(?![\p{L}\p{N}])"), F.lit(1)))


def three_letter_words(titles: DataFrame) -> DataFrame:
    """One row with an array words: words of three letters that stand before something else than a code's digits at least as often as before
    them. titles: (title). There are at most 26 to the third of them."""
    alone = titles.select(F.explode(F.regexp_extract_all(plain(F.col("title")), F.lit(r"(?<![\p{L}\p{N}])([a-z]{3})(?![\p{L}\p{N}]|[-/]\d)"), F.lit(1))).alias("w"), F.lit(1).alias("n"), F.lit(0).alias("c"))
    before = titles.select(F.explode(F.regexp_extract_all("title", F.lit(_APART), F.lit(1))).alias("w")).select(F.lower(F.substr("w", F.lit(1), F.lit(3))).alias("w"), F.lit(0).alias("n"), F.lit(1).alias("c"))
    by = alone.unionByName(before).groupBy("w").agg(F.sum("n").alias("n"), F.sum("c").alias("c")).filter("c > 0 and n >= 2 * c")
    return by.agg(F.collect_list("w").alias("_not_codes"))


def parsed(records: DataFrame, brand_list: DataFrame, target_units: DataFrame) -> DataFrame:
    """One row for each rid: (rid, title, words, code, part_of, brand_id, brand, q, price); q holds the quantities of each kind.

    code is the maker's code in the title, model or description; part_of names the accessory that a title says it is. Of several deliveries of
    a rid the least value of each column counts. Null titles have no words; a brand that means no entry is null, and so is the price where
    records have no such column or it holds no number.
    """
    columns = ["title", "description", "brand", "model", *(["price"] if "price" in records.columns else [])]
    one = records.select(clean_rid(F.col("rid")).alias("rid"), *columns).filter("rid is not null").groupBy("rid").agg(*[F.min(c).alias(c) for c in columns])
    one = stored(one, "delivered")
    not_codes = three_letter_words(one.select("title"))
    model = F.regexp_extract(squeezed(F.col("model")), r"^([A-Z]{3}\d{4}[A-Z]?)$", 1)
    said = F.regexp_extract(F.regexp_extract("description", r"(?i)part no\.\s*(\S+)", 1), _CODE, 1)
    apart = F.filter(F.regexp_extract_all("title", F.lit(_APART), F.lit(1)), lambda c: ~F.array_contains("_not_codes", F.lower(F.substr(c, F.lit(1), F.lit(3)))))
    code = F.coalesce(squeezed(F.regexp_extract("title", _CODE, 1)), squeezed(F.get(apart, 0)), F.nullif(model, F.lit("")), squeezed(said))
    small = F.lower(F.coalesce("title", F.lit("")))
    part = F.regexp_extract(small, r"(\p{L}+ \p{L}+) for ", 1)
    price = F.replace(F.regexp_extract("price", r"(\d[\d,]*(?:\.\d+)?)", 1), F.lit(","), F.lit("")).try_cast("double") if "price" in columns else F.lit(None).cast("double")
    texts = one.crossJoin(F.broadcast(not_codes))  # one row
    texts = texts.select("rid", "title", "brand", title_words(F.col("title")).alias("words"), code.alias("code"), part.alias("part_of"), F.when(price > 0, price).alias("price"))
    out = meanings(texts, brand_list)
    read = units.quantities(one, "rid", ["title", "description"], units.unit_table(records.sparkSession, target_units))
    by_kind = read.groupBy("rid").agg(*[F.sort_array(F.collect_set(F.when(F.col("kind") == k, F.col("base_value")))).alias(k) for k in KINDS])
    q = F.struct(*[F.col(k) for k in KINDS])
    found = out.join(by_kind, "rid", "left")
    return found.select("rid", "title", "words", "code", "part_of", F.nullif("brand_id", F.lit(0)).alias("brand_id"), "brand", q.alias("q"), "price")


def _near(x: Column, y: Column, kind: str) -> Column:
    """Whether some values of two arrays are as near as rounding allows."""
    slack = (lambda u, v: F.lit(2)) if kind == "temperature" else (lambda u, v: F.greatest(F.abs(u), F.abs(v)) * TOLERANCE)
    return F.exists(x, lambda u: F.exists(y, lambda v: F.abs(u - v) <= slack(u, v)))


def agreements(a: str, b: str) -> tuple[Column, Column]:
    """How many kinds of quantity of two q columns agree, and how many conflict: both sides have the kind, and some or no values are near."""
    agree, conflict = F.lit(0), F.lit(0)
    none = F.array().cast("array<bigint>")
    for k in KINDS:
        x, y = F.coalesce(F.col(f"{a}.{k}"), none), F.coalesce(F.col(f"{b}.{k}"), none)
        both, some = (F.size(x) > 0) & (F.size(y) > 0), _near(x, y, k)
        agree = agree + F.when(both & some, 1).otherwise(0)
        conflict = conflict + F.when(both & ~some, 1).otherwise(0)
    return agree, conflict


def family_words(rows: DataFrame, brand_list: DataFrame, brand_share: float = 0.2, own: float = 0.5, slips: bool = True) -> DataFrame:
    """(word, family, df): words of titles that name a product family, and, with slips, slips of such words with the family word meant.

    rows: (rid, words, brand_id, brand). A word of four letters or more names a family if at most brand_share of the titles' own brand fields hold it, and own of the titles
    whose brand is known are of one brand. A slip is a word one edit or swap away from a word of more titles, or two edits if both have six letters, whose
    titles are of the same brand or of none known; or of any brand, if the other has twenty times as many titles. A slip of a word that names no family names none.
    Counts cover all rows, and only their ratios matter.
    """
    typed = F.split(plain(F.coalesce("brand", F.lit(""))), r"[^\p{L}]+")
    each = rows.select(F.explode("words").alias("word"), "brand_id", typed.alias("typed")).filter("length(word) >= 4")
    each = each.groupBy("word", "brand_id").agg(F.count("*").alias("n"), F.sum(F.array_contains("typed", F.col("word")).cast("int")).alias("in_brand"))
    known = F.when(F.col("brand_id").isNotNull(), F.col("n")).otherwise(0)
    words = each.groupBy("word").agg(F.sum("n").alias("df"), F.sum("in_brand").alias("in_brand"), F.sum(known).alias("known"), F.max(F.struct(known.alias("n"), "brand_id")).alias("top"))
    # the words of the reference list name brands, whatever the titles say
    listed = brand_list.select(F.explode(F.split(F.lower(F.concat_ws(" ", "brand", "also_known_as")), r"[^\p{L}]+")).alias("word")).distinct().withColumn("listed", F.lit(True))
    words = words.join(F.broadcast(listed), "word", "left")
    family = F.col("listed").isNull() & (F.col("in_brand") <= brand_share * F.col("df")) & (F.col("top.n") >= own * F.col("known"))
    words = words.select("word", "df", family.alias("is_family"), F.col("top.brand_id").alias("of"))
    # a word one edit away from its own brand's name is a slip of that
    letters = lambda w: F.array_sort(F.split(w, ""))
    names = brand_list.select(F.col("brand_id").alias("of"), F.explode(F.split(plain(F.concat_ws(" ", "brand", "also_known_as")), r"[^\p{L}]+")).alias("name")).filter("length(name) >= 4").groupBy("of").agg(F.collect_set("name").alias("names"))
    slip = F.exists("names", lambda b: (F.levenshtein("word", b) == 1) | (letters(F.col("word")) == letters(b)))
    words = stored(words.join(F.broadcast(names), "of", "left").select("word", "df", (F.col("is_family") & ~F.coalesce(slip, F.lit(False))).alias("is_family"), "of"), "words")
    if not slips:
        return words.filter("is_family").select("word", F.col("word").alias("family"), "df")
    less = lambda w: F.explode(F.concat(F.array(w), F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))))
    right = words.select(F.col("word").alias("meant"), F.col("df").alias("meant_df"), "is_family", F.col("of").alias("meant_of"), less(F.col("word")).alias("cut"))
    wrong = words.select("word", "df", "of", less(F.col("word")).alias("cut"))
    met = wrong.join(right, "cut").filter("word <> meant and (meant_df > df or meant_df = df and meant > word)").drop("cut").distinct()
    one = (F.levenshtein("word", "meant") == 1) | (letters(F.col("word")) == letters(F.col("meant")))  # or two letters swapped
    two = (F.levenshtein("word", "meant") <= 2) & (F.least(F.length("word"), F.length("meant")) >= 6)
    same = F.expr("of is null or meant_of is null or of = meant_of or not is_family")
    found = met.filter(((one | two) & same) | (one & (F.col("meant_df") >= 20 * F.col("df"))))
    found = found.groupBy("word").agg(F.max(F.struct(one.alias("one"), "meant_df", "meant", "is_family")).alias("best")).select("word", "best.*")
    kept = words.filter("is_family").join(found.select("word"), "word", "left_anti").select("word", F.col("word").alias("family"), "df")
    return kept.unionByName(found.filter("is_family").select("word", F.col("meant").alias("family"), F.col("meant_df").alias("df")))


def with_editions(rows: DataFrame, families: DataFrame, share: float = 0.7, z: float = 2.0) -> DataFrame:
    """rows with a column edition: the words of the title, joined by colons, that set one edition of a family apart from another; '' for none.

    Such words stand right after a family's name nearly always (Wilson's lower bound of that share, at z deviations, is at least share), and after
    many names: of twenty titles that have one, more than one family. The corpus tells them; there is no list.
    """
    tokens = F.regexp_extract_all(plain(F.coalesce("title", F.lit(""))), F.lit(r"\p{L}+|[^\s\p{L}]+"), F.lit(0))
    seen = rows.select("rid", F.posexplode(tokens).alias("i", "word"), tokens.alias("t")).filter(F.col("word").rlike(r"^\p{L}{2,}$"))
    seen = seen.select("word", F.when(F.col("i") > 0, F.get("t", F.col("i") - 1)).alias("before")).groupBy("word", "before").agg(F.count("*").alias("n"))
    names = families.select(F.col("word").alias("before"), F.col("family")).distinct()
    by = seen.join(names, "before", "left").groupBy("word").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("family").isNotNull(), F.col("n")).otherwise(0)).alias("k"), F.count_distinct("family").alias("families"))
    p, n = F.col("k") / F.col("n"), F.col("n")
    low = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    marks = by.filter((low >= share) & (F.col("families") * 20 > n)).select("word").join(names.select(F.col("before").alias("word")), "word", "left_anti")
    held = rows.select("rid", F.explode("words").alias("word")).join(marks, "word").groupBy("rid").agg(F.array_join(F.array_sort(F.collect_set("word")), ":").alias("edition"))
    return rows.join(held, "rid", "left").withColumn("edition", F.coalesce("edition", F.lit("")))


def with_family(rows: DataFrame, families: DataFrame) -> DataFrame:
    """rows with a column family: the rarest family word of the title that other titles have, too, else a word of its own; or null. odd: the family
    words of the title that no other title has, which may be slips."""
    met = rows.select("rid", F.explode("words").alias("word")).join(families, "word").groupBy("rid")
    best = met.agg(F.min(F.struct(F.col("df") < 2, "df", "family")).alias("f"), F.array_sort(F.collect_set(F.when(F.col("df") < 2, F.col("word")))).alias("odd"))
    return rows.join(best.select("rid", F.col("f.family").alias("family"), "odd"), "rid", "left")


def with_text(rows: DataFrame, families: DataFrame) -> DataFrame:
    """rows with a column text: the words of the title, slips of family words put right."""
    right = rows.select("rid", F.explode("words").alias("word")).join(families.select("word", "family"), "word", "left")
    return rows.join(right.groupBy("rid").agg(F.collect_set(F.coalesce("family", "word")).alias("text")), "rid", "left")
