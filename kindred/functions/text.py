"""Cleaning, normalising and extraction from product texts, as column expressions (no Python in the rows)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that decide results; they must equal those of the pipeline whose results these functions match.
STOPWORDS = ["the", "a", "an", "and", "or", "of", "for", "with", "in", "on", "to", "by", "from", "at", "is", "new", "black", "white", "silver"]
COMMON_NUMBERS = ["1080", "1920", "720", "1280", "1024", "768", "480", "2000", "2007", "2008", "2009", "2010", "100", "1000", "3000", "5000", "10000"]
#: (spellings, unit, factor), applied in this order
UNITS = [
    (r"tb|terabytes?", "gb", 1000.0),
    (r"gb|gigabytes?", "gb", 1.0),
    (r"mb|megabytes?", "gb", 0.001),
    (r"ghz", "mhz", 1000.0),
    (r"mhz", "mhz", 1.0),
    (r"inch|inches|in\.|\"|''", "in", 1.0),
    (r"mp|megapixels?", "mp", 1.0),
    (r"watts?|w", "w", 1.0),
]
PACK = r"\b(\d+)\s*[- ]?\s*(?:pack|pk|pcs|pieces|count|ct)\b|\bpack of (\d+)\b|\bset of (\d+)\b|\b(\d+)\s*x\b"
CONDITION = r"\b(refurbished|refurb|renewed|used|pre-owned|open box|open-box|remanufactured)\b"
BUNDLE = r"\b(bundle|kit|with case|w/ case|combo|includes|included|\+)\b"
ACCESSORY = (
    r"\b(case|cover|cable|adapter|charger|battery|batteries|mount|bracket|stand|remote|filter|bag|strap|lens cap|lens hood|cartridge|ink|toner|belt|stylus"
    r"|earpad|ear pad|skin|screen protector|holster|dock|cradle|replacement)\b"
)
COMPATIBILITY = r"\b(for|fits|compatible with|works with|designed for|to fit)\b"
#: a number with one of these is a specification, no identifier
SPEC_SUFFIXES = (
    "p i k x gb mb tb kb hz khz mhz ghz mbps gbps kbps w mm cm m in ft mp rpm bit bits ohm ohms dpi ppm fps mah wh v a lb lbs oz hr hrs ms nm db cd awg ch pc pcs pk ct"
    " d g kg l ml sec min yr deg btu cu rms pin port ports bay watt watts inch disc discs pack piece pieces way zone zones sheet sheets page pages cup cups qt gal ton"
    " speed cyl step line lines hd dvd hour hours day days month months year years channel channels player players button buttons key keys slice slices quart amp amps"
    " stage stages position positions setting settings tray trays door doors drawer drawers burner burners element elements rack racks shelf shelves degree degrees"
    " foot feet user users room rooms person people seat seats"
).split()
#: and so is one of these with a number
SPEC_PREFIXES = r"mpeg mp usb ddr ieee 802\.?11 h x wi-?fi dvi hdmi dts dolby ac dc v rs sata pci pcie dvd cd blu ray core duo i gen ver version type class cat".split()
PRICE = r"([$€£])?\s*([0-9][0-9,]*(?:\.\d{1,2})?)"
# End of the fixed values.

_SPEC = rf"(?i)^(?:\d+(?:\.\d+)?(?:{'|'.join(SPEC_SUFFIXES)})|(?:{'|'.join(SPEC_PREFIXES)})\d+[a-z]*)$"
_MIXED = r"\b([A-Za-z0-9][A-Za-z0-9/\-.]{2,}[A-Za-z0-9])\b"
_DIGITS = r"\b(\d{5,}(?:[-/]\d+)?)\b"


def text_of(c: Column) -> Column:
    """Text with straight quotes and single blanks; the empty string for null."""
    c = F.translate(F.coalesce(c, F.lit("")), "’“”", "'\"\"")
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def _unit_number(n: Column, factor: float) -> Column:
    v = n.cast("double") * factor
    whole = F.abs(v - F.round(v)) < 1e-9
    return F.when(whole, F.round(v).cast("bigint").cast("string")).otherwise(F.round(v, 3).cast("string"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often use names it."""
    return F.get(F.transform(F.array(value), use), 0)


def canonical_units(c: Column) -> Column:
    """Numbers with units of lower-case text rewritten to one unit of each kind, with blanks around."""
    for spellings, unit, factor in UNITS:
        rx = rf"(?<![a-z0-9\-])(\d+(?:\.\d+)?)\s*-?\s*(?:{spellings})\b"
        c = let(c, _replacer(rx, _rewriter(unit, factor)))
    return c


def _replacer(rx: str, new: Callable[[Column], Column]) -> Callable[[Column], Column]:
    def replaced(text: Column) -> Column:
        numbers = F.transform(F.regexp_extract_all(text, F.lit(rx), F.lit(1)), new)
        joined = F.zip_with(F.split(text, rx, -1), numbers, lambda rest, number: F.concat(rest, F.coalesce(number, F.lit(""))))
        return F.when(text.rlike(rx), F.array_join(joined, "")).otherwise(text)

    return replaced


def _rewriter(unit: str, factor: float):
    return lambda n: F.concat(F.lit(" "), _unit_number(n, factor), F.lit(f"{unit} "))


def normalized(c: Column) -> Column:
    """Lower case, units canonical, of other marks only / - and . kept."""
    c = canonical_units(F.lower(text_of(c)))
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[^a-z0-9/\-.\s]", " "), r"\s+", " "))


def tokens(normal: Column) -> Column:
    """Words of a normalised text without stop words, in order, with repeats."""
    words = F.split(F.trim(F.regexp_replace(normal, r"[/\-.\s]+", " ")), " ")
    return F.filter(words, lambda w: (w != "") & ~w.isin(STOPWORDS))


def canonical_model(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[-/. ]", "")


def without_compatibility(title: Column) -> Column:
    """The title up to what it says it is for."""
    at = F.regexp_instr(title, F.lit(f"(?i){COMPATIBILITY}"))
    return F.when(at > 1, F.substr(title, F.lit(1), at - 1)).otherwise(title)


def model_tokens(*texts: Column) -> Column:
    """Identifiers in cleaned texts, canonical, each once in order of appearance: mixed letters and digits that are no specification, then long numbers, text by text."""
    found = []
    for t in texts:
        mixed = F.filter(F.regexp_extract_all(t, F.lit(_MIXED), F.lit(1)), lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]") & ~m.rlike(_SPEC) & ~F.regexp_replace(m, r"[-/. ]", "").rlike(_SPEC))
        canon = F.transform(mixed, canonical_model)
        found.append(F.filter(canon, lambda m: F.length(m) >= 4))
        digits = F.transform(F.regexp_extract_all(t, F.lit(_DIGITS), F.lit(1)), canonical_model)
        found.append(F.filter(digits, lambda m: ~m.isin(COMMON_NUMBERS)))
    return F.array_distinct(F.concat(*found))


def pack_quantity(c: Column) -> Column:
    """The first stated number of pieces, if it lies between 1 and 1000; else null."""
    groups = [F.nullif(F.regexp_extract(c, f"(?i){PACK}", i), F.lit("")) for i in (1, 2, 3, 4)]
    q = F.coalesce(*groups).try_cast("bigint")
    return F.when((q > 1) & (q < 1000), q.cast("int"))


def condition(c: Column) -> Column:
    w = F.lower(F.regexp_extract(c, f"(?i){CONDITION}", 1))
    return F.when(w == "", "unknown").when(w.startswith("refurb") | w.isin("renewed", "remanufactured"), "refurbished").when(w.isin("used", "pre-owned"), "used").otherwise("open_box")


def capacities(normal: Column) -> Column:
    """A map from gb, mhz, in, mp and w to the sorted distinct values in a normalised title; units not named are left out."""
    rx = r"\b(\d+(?:\.\d+)?)(gb|mhz|in|mp|w)\b"
    found = F.arrays_zip(F.regexp_extract_all(normal, F.lit(rx), F.lit(2)).alias("unit"), F.regexp_extract_all(normal, F.lit(rx), F.lit(1)).alias("value"))
    entries = F.transform(F.array_distinct(found.getField("unit")), lambda u: F.struct(u.alias("key"), F.array_sort(F.array_distinct(F.transform(F.filter(found, lambda x: x["unit"] == u), lambda x: x["value"].cast("double")))).alias("value")))
    return F.map_from_entries(entries)


def price(raw: Column) -> Column:
    return F.replace(F.regexp_extract(raw, PRICE, 2), F.lit(","), F.lit("")).try_cast("double")


def price_currency(raw: Column) -> Column:
    mark = F.regexp_extract(raw, PRICE, 1)
    return F.when(mark == "$", "USD").when(mark == "€", "EUR").when(mark == "£", "GBP")


def first_word(title: Column) -> Column:
    return F.lower(F.element_at(F.split(title, " "), 1))


def is_accessory(title: Column) -> Column:
    return title.rlike(f"(?i){ACCESSORY}")


def is_bundle(title: Column) -> Column:
    return title.rlike(f"(?i){BUNDLE}")
