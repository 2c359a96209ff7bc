from __future__ import annotations

from fractions import Fraction as Q

import pytest

from kindred.operators import units

TARGETS = [("length", "mm"), ("mass", "g"), ("volume", "ml"), ("power", "W"), ("storage", "MB"), ("temperature", "°C")]


@pytest.fixture(scope="module")
def table(spark):
    return units.unit_table(spark, spark.createDataFrame(TARGETS, "kind string, unit string"))


def found(spark, table, *texts):
    df = spark.createDataFrame([(str(i), t, None) for i, t in enumerate(texts)], "rid string, title string, description string")
    out = {}
    for r in units.quantities(df, "rid", ["title", "description"], table).collect():
        out.setdefault(int(r.rid), set()).add((r.kind, r.base_value))
    return [out.get(i, set()) for i in range(len(texts))]


CASES = [
    ("2 pints of paint", {("volume", 946)}), ("a 3 yards rope", {("length", 2743)}), ("1,500 mg", {("mass", 2)}),
    ("Lamp 27 CM tall", {("length", 270)}), ("2,07\xa0feet", {("length", 631)}), ("9,500 mm hose", {("length", 9500)}), ("0,81 Ltr", {("volume", 810)}),
    ("4½ quarts", {("volume", 4259)}), ("32-1/2 fl oz", {("volume", 961)}), ("1/2 kilowatts", {("power", 500)}), (".59qt", {("volume", 558)}), ("½ gal.", {("volume", 1893)}),
    ("7 lb 15 oz", {("mass", 3600)}), ("2lb3oz", {("mass", 992)}), ("5ft. 3in.", {("length", 1600)}), ("1'10\"", {("length", 559)}), ("six watts", {("power", 6)}),
    ("Dimensions: W 12.2 in x D 9.9 in.", {("length", 310), ("length", 251)}), ("441×66mm", {("length", 441), ("length", 66)}), ("Dimensions: cm 47 / 9.5", {("length", 470), ("length", 95)}),
    ("Measurements in inches: 5 x 10 x 2", {("length", 127), ("length", 254), ("length", 51)}), ("Weight in g: 2100", {("mass", 2100)}), ("Power/watts: 300", {("power", 300)}),
    ("Memory (mb): 34000", {("storage", 34000)}), ("Mass [oz.] 10", {("mass", 283)}), ("Net weight/oz. 28.6", {("mass", 811)}), ("1.2 TB", {("storage", 1200000)}),
    ("minus 15 degrees Celsius", {("temperature", -15)}), ("-24 °C", {("temperature", -24)}), ("Works at up to -18 F.", {("temperature", -28)}), ("Box Freezer -29°C", {("temperature", -29)}), ("Grill - 180 °C", {("temperature", 180)}), ("10-20 °C", {("temperature", 20)}), ("30ºF", {("temperature", -1)}), ("−28 deg C", {("temperature", -28)}), ("76 F", {("temperature", 24)}),
    ("Capacity (FL OZ): 17.2", {("volume", 509)}), ("18.1 in. Curtain, 18.1 inch", {("length", 460)}), ("19-inch", {("length", 483)}),
]
NONE = ["NXF-5506G", "ZCM6258 G", "Pairs with 5G phones and 4K screens", "2 in 1", "No. 1 in tests", "Ranked number 9 in its class", "Voted 8 in our poll", "set of 4 parts", "Batch code UX11M", "12 Colours", "Open 24/7", "", "5-year warranty", "FMF 3988 L"]


def test_readings(spark, table):
    got = found(spark, table, *[c for c, _ in CASES], *NONE, None)
    for (text, want), have in zip(CASES, got, strict=False):
        assert have == want, text
    for text, have in zip(NONE, got[len(CASES) :], strict=False):
        assert not have, text


def test_repeats_count_once_and_clashing_columns_do_not_matter(spark, table):
    df = spark.createDataFrame([("a", "1 kg", "1000 g", 7)] * 3, "rid string, title string, description string, value int")
    assert [tuple(r) for r in units.quantities(df, "rid", ["title", "description"], table).collect()] == [("a", "mass", 1000)]
    assert units.quantities(df.limit(0), "rid", ["title"], table).count() == 0


def test_very_long_text(spark, table):
    assert found(spark, table, "word " * 50_000 + "3 kg") == [{("mass", 3000)}]


def test_compositions_are_shortest_and_consistent():
    c = units.compositions({"length": "mm", "temperature": "°C"})
    assert c["ft"] == ("length", Q("304.8"), Q(0)) and c["f"] == ("temperature", Q(5, 9), Q(-160, 9))
    with pytest.raises(ValueError, match="disagree"):
        units.compositions({"length": "mm"}, [*units.CONVERSIONS, ("m", "ft", Q(3), Q(0))])
