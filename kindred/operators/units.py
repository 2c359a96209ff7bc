"""Quantities in free text, converted to one unit for each kind.

Conversions are edges of a graph of units: an edge says that one unit is an affine function of another. The shortest composition
from every unit to the common unit of its kind is worked out once, every cycle is checked for consistency, and the result is a table
(spelling, kind, scale, offset) that readings are equi-joined with. Readings are cut out of the texts by regular expressions of the JVM.
"""

from __future__ import annotations

from collections import deque
from fractions import Fraction as Q

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: one unit of the first is scale units of the second, plus offset
CONVERSIONS: list[tuple[str, str, Q, Q]] = [
    ("cm", "mm", Q(10), Q(0)), ("m", "cm", Q(100), Q(0)), ("in", "mm", Q("25.4"), Q(0)), ("ft", "in", Q(12), Q(0)), ("m", "mm", Q(1000), Q(0)),
    ("yd", "ft", Q(3), Q(0)),
    ("kg", "g", Q(1000), Q(0)), ("oz", "g", Q("28.349523125"), Q(0)), ("lb", "oz", Q(16), Q(0)), ("mg", "g", Q(1, 1000), Q(0)),
    ("l", "ml", Q(1000), Q(0)), ("cl", "ml", Q(10), Q(0)), ("l", "cl", Q(100), Q(0)), ("floz", "ml", Q("29.5735295625"), Q(0)),
    ("qt", "floz", Q(32), Q(0)), ("gal", "qt", Q(4), Q(0)), ("pt", "floz", Q(16), Q(0)),
    ("kw", "w", Q(1000), Q(0)), ("gb", "mb", Q(1000), Q(0)), ("tb", "gb", Q(1000), Q(0)), ("tb", "mb", Q(1000000), Q(0)),
    ("f", "c", Q(5, 9), Q(-160, 9)),
]
#: the node of the unit graph that each common unit is
COMMON = {"mm": "mm", "g": "g", "ml": "ml", "W": "w", "MB": "mb", "°C": "c"}
#: spellings, lower case, without dots and blanks
SPELLINGS: dict[str, str] = {
    "mm": "mm millimetre millimetres millimeter millimeters", "cm": "cm centimetre centimetres centimeter centimeters",
    "m": "m metre metres meter meters", "in": "in inch inches \" '' ” ″", "ft": "ft foot feet ' ’ ′", "yd": "yd yds yard yards", "mg": "mg milligram milligrams", "pt": "pint pints",
    "kg": "kg kgs kilo kilos kilogram kilograms", "g": "g gr gm gms gram grams", "oz": "oz ounce ounces", "lb": "lb lbs pound pounds",
    "ml": "ml millilitre millilitres milliliter milliliters", "cl": "cl centilitre centilitres centiliter centiliters",
    "l": "l ltr ltrs litre litres liter liters", "floz": "floz fluidounce fluidounces", "qt": "qt qts quart quarts", "gal": "gal gals gallon gallons",
    "w": "w watt watts", "kw": "kw kilowatt kilowatts", "mb": "mb megabyte megabytes", "gb": "gb gigabyte gigabytes", "tb": "tb terabyte terabytes",
    "c": "c °c ºc degc degreesc degreecelsius degreescelsius degreescentigrade celsius", "f": "f °f ºf degf degreesf degreefahrenheit degreesfahrenheit fahrenheit",
}


def compositions(common: dict[str, str], edges: list[tuple[str, str, Q, Q]] = CONVERSIONS) -> dict[str, tuple[str, Q, Q]]:
    """For each unit reachable from a common unit (kind -> unit): its kind and the shortest composed function to it, as (kind, scale, offset).

    Raises ValueError where two paths between the same units disagree, or where a unit would belong to two kinds.
    """
    near: dict[str, list[tuple[str, Q, Q]]] = {}
    for a, b, s, o in edges:
        near.setdefault(b, []).append((a, s, o))
        near.setdefault(a, []).append((b, 1 / s, -o / s))
    found: dict[str, tuple[str, Q, Q]] = {}
    for kind, unit in common.items():
        root = COMMON.get(unit, unit.lower())
        queue = deque([(root, Q(1), Q(0))])
        while queue:
            u, s, o = queue.popleft()
            if u in found:
                if found[u] != (kind, s, o):
                    raise ValueError(f"conversions disagree on {u}: {found[u]} and {(kind, s, o)}")
                continue
            found[u] = (kind, s, o)
            # v is s2*v+o2 units of u, and u is s*u+o of the common unit
            queue.extend((v, s * s2, s * o2 + o) for v, s2, o2 in near.get(u, []))
    return found


def unit_table(spark: SparkSession, target_units: DataFrame) -> DataFrame:
    """(spelling, kind, scale, offset): every spelling with its function to the kind's unit in target_units (six rows by definition; fixed size)."""
    common = {r.kind: r.unit for r in target_units.collect()}
    table = compositions(common)
    rows = [(word, table[u][0], float(table[u][1]), float(table[u][2])) for u, words in SPELLINGS.items() if u in table for word in words.split()]
    return spark.createDataFrame(rows, "spelling string, kind string, scale double, offset double")


_FRACTION = "½¼¾⅓⅔⅛⅜⅝⅞"
_WORDS = "one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve"
_NUM = rf"(?:\d{{1,3}}(?:,\d{{3}})+(?:\.\d+)?(?!\d)|\d+[.,]\d+|\d+ ?[{_FRACTION}]|\d+[ -]\d+/\d+|\d+/\d+|\d+|\.\d+|[{_FRACTION}])"
_IN = r"in\b(?! (?:\d|its |the |our |tests|a |an |all |use|one |store))"
_DEG = r"(?:degrees?|deg\.?) ?(?:celsius|centigrade|fahrenheit|c\b|f\b)|[°º] ?[cf]\b"
_UNIT = (
    rf"(?:milli(?:met(?:re|er)s?|lit(?:re|er)s?)\b|centi(?:met(?:re|er)s?|lit(?:re|er)s?)\b|met(?:re|er)s?\b|lit(?:re|er)s?\b|ltrs?\b|mm\b|cm\b|ml\b|cl\b|mb\b|inch(?:es)?\b|{_IN}"
    r"|feet\b|foot\b|ft\b|yards?\b|yds?\b|pints?\b|mg\b|milligrams?\b|fl\.? ?oz\b|fluid[ -]ounces?\b|ounces?\b|oz\b|kilo(?:gram)?s?\b|kgs?\b|grams?\b|gms?\b|gr\b|g\b|pounds?\b|lbs?\b|gallons?\b|gals?\b|quarts?\b|qts?\b"
    rf"|kilowatts?\b|kw\b|watts?\b|w\b|(?:mega|giga|tera)bytes?\b|gb\b|tb\b|{_DEG}|[cf]\b|l\b|m\b|''|\"|”|″|'(?!\w)|’(?!\w)|′)"
)
_LABEL = r"(?:net weight|weight|mass|power|size|length|height|width|depth|capacity|volume|memory|storage|space|temperature|dimensions|diameter)"
_UNIT_WORD = r"[a-z.°º'\"” ]{1,18}?"
_START = r"(?<![\p{L}\p{N}.,/])"
_MANY = rf"{_NUM}(?: ?[x×/] ?{_NUM})*"
#: label first: "Weight in g: 2100", "Power/W 180", "Mass [gm] 310", "Measurements in inches: 5 x 6"
_LABELLED = rf"\b(?:{_LABEL}(?: in | ?\(| ?\[|/)|measurements in |dimensions: (?=\p{{L}}{{2,11}} [\d.])){_UNIT_WORD}[)\]]?:? -?{_MANY}(?![\p{{L}}\p{{N}}]|[.,]\d)"
_COMPOUND = rf"{_START}\d+ ?(?:(?:feet|foot|ft|'|’|′)\.? ?(?:and )?{_NUM} ?(?:inch(?:es)?\b|in\b|''|\"|”|″)|(?:lbs?|pounds?)\.? ?(?:and )?{_NUM} ?(?:oz|ounces?)\b)"
_SIDES = rf"{_START}{_NUM}(?: ?[x×] ?{_NUM})+[ -]?{_UNIT}"
_MINUS = r"(?:minus |(?<![\p{L}\p{N}])[-−–](?=[\d.]))"
_GAP = r"(?: ?- ?| )?"
#: model codes, three letters and four digits written in many ways; short words that may stand before a number are no code
_CODE = (
    r"(?=[A-Za-z]{3}[-/ \d])(?<![\p{L}\p{N}])(?!(?i:can|rug|rod|pan|gun|pot|bin|cam|box|day|new|top|hot|out|for|and|the|set|now) )"
    r"(?:[A-Z]{3}|[a-z]{3})(?:[-/ ]?\d{4}|[-/ ]\d{2}-\d{2})(?:[-/ ]?[A-Za-z])?(?![\p{L}\p{N}]|[.,]\d)"
)
#: each alternative looks at one letter first, so most places of a text are passed over at once
PHRASE = (
    rf"(?i)(?:(?=[\d.{_FRACTION}])(?:{_COMPOUND}|{_SIDES}|{_START}{_NUM}{_GAP}{_UNIT})"
    rf"|(?=[-−–m]){_MINUS}{_START}{_NUM}{_GAP}{_UNIT}"
    rf"|(?=[nwmpslhdcvt]){_LABELLED}|(?=[otfsne])\b(?:{_WORDS})(?:-| ){_UNIT})"
)


def clean(text: Column) -> Column:
    """Markup to blanks, every kind of blank to one blank."""
    text = F.regexp_replace(text, r"<[^<>]{0,40}>|&nbsp;", " ")
    text = F.replace(F.replace(text, F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))
    text = F.regexp_replace(text, r"\s{2,}|[\n\t\x{A0}\x{2000}-\x{200A}\x{202F}\x{3000}]+", " ")
    return F.regexp_replace(text, _CODE, "#")


def _number(n: Column) -> Column:
    """The value of one number as written: thousands' commas, decimal commas, vulgar fractions, mixed numbers, words."""
    n = F.lower(F.trim(n))
    whole = F.regexp_extract(n, r"^(\d+)[ -]?(?:\d+/\d+|[½¼¾⅓⅔⅛⅜⅝⅞])$", 1)
    top, low = F.regexp_extract(n, r"(?:^|[ -])(\d+)/(\d+)$", 1), F.regexp_extract(n, r"(?:^|[ -])(\d+)/(\d+)$", 2)
    eighths = {"½": 1 / 2, "¼": 1 / 4, "¾": 3 / 4, "⅓": 1 / 3, "⅔": 2 / 3, "⅛": 1 / 8, "⅜": 3 / 8, "⅝": 5 / 8, "⅞": 7 / 8}
    vulgar = F.element_at(F.create_map(*[F.lit(x) for kv in eighths.items() for x in kv]), F.right(n, F.lit(1)))
    words = F.element_at(F.create_map(*[F.lit(x) for i, w in enumerate(_WORDS.split("|"), 1) for x in (w, float(i))]), n)
    plain = (
        F.when(n.rlike(r"^[1-9]\d{0,2}(,\d{3})+(\.\d+)?$"), F.replace(n, F.lit(","), F.lit("")))
        .otherwise(F.replace(n, F.lit(","), F.lit(".")))
        .try_cast("double")
    )
    return (
        F.when(n.rlike("^[a-z]"), words)
        .when(n.rlike(f"[{_FRACTION}]$"), F.coalesce(whole.try_cast("double"), F.lit(0.0)) + vulgar)
        .when(n.contains("/"), F.coalesce(whole.try_cast("double"), F.lit(0.0)) + F.try_divide(top.cast("double"), low.cast("double")))
        .otherwise(plain)
    )


def readings(df: DataFrame, key: str, texts: list[str]) -> DataFrame:
    """(key, spelling, value): each number with a unit's spelling in any of the text columns; no row for texts that are null or empty."""
    phrases = df.select(F.col(key).alias("_key"), F.explode(F.array(*[clean(F.col(t)) for t in texts])).alias("_text")).filter("_text is not null")
    phrases = phrases.select("_key", F.explode(F.regexp_extract_all("_text", F.lit(PHRASE), F.lit(0))).alias("_raw"))
    # five-gee phones and four-kay screens are generations, not grams
    phrases = phrases.filter(~F.col("_raw").rlike(r"^(?:[2-6]G|\d+G?)$"))
    p = F.lower("_raw")
    nums = F.regexp_extract_all(p, F.lit(f"({_NUM}|\\b(?:{_WORDS})(?= |-))"), F.lit(1))
    first_unit = F.regexp_extract(p, r"(?:measurements in |dimensions: |" + _LABEL + r"(?: in | ?\(| ?\[|/))([^\d\])]*?)[)\]]?:? -?[\d.,½¼¾⅓⅔⅛⅜⅝⅞]", 1)
    last_unit = F.regexp_extract(p, rf"({_UNIT})$", 1)
    labelled = p.rlike(r"^(?:measurements|dimensions|" + _LABEL + ")")
    unit = F.regexp_replace(F.when(labelled, first_unit).otherwise(last_unit), r"[\s.-]", "")
    compound = p.rlike(rf"^\d+ ?(?:feet|foot|ft|lbs?|pounds?|'|’|′)\.? ?(?:and )?{_NUM} ?\D+$") & ~labelled & (F.size(nums) == 2)
    by = F.when(unit.isin("oz", "ounce", "ounces"), F.lit(16.0)).otherwise(F.lit(12.0))
    sign = F.when(p.rlike(r"^(?:minus |[-−–])|: -[\d.]| -[\d.]+$"), F.lit(-1.0)).otherwise(F.lit(1.0))
    values = F.when(compound, F.array(_number(F.get(nums, F.lit(0))) * by + _number(F.get(nums, F.lit(1))))).otherwise(F.transform(nums, lambda n: _number(n)))
    return phrases.select(F.col("_key").alias(key), unit.alias("spelling"), sign.alias("sign"), F.explode(values).alias("value"))


def quantities(df: DataFrame, key: str, texts: list[str], units: DataFrame) -> DataFrame:
    """(key, kind, base_value): each distinct quantity in the texts, in the common unit, rounded half away from zero.

    units is unit_table(); its few rows are joined by spelling. Only temperatures may be negative. Texts that are null or empty, and
    numbers too large for a double, give no row; repeated rows of a key give each quantity once.
    """
    found = readings(df, key, texts).join(F.broadcast(units), "spelling")
    value = F.when(F.col("kind") == "temperature", F.col("value") * F.col("sign")).otherwise(F.col("value")) * F.col("scale") + F.col("offset")
    return found.filter("value is not null").select(key, "kind", F.round(value).cast("bigint").alias("base_value")).distinct()
