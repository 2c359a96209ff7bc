from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kindred.functions import similarity as S
from kindred.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "s string").select(f(F.col("s")).alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, ""), ("  A b ", "a b"), ('52" tv', "52 tv"), ('52"tv', "52in tv"), ("1.5TB and 320 GB", "1500gb and 320gb"), ("512 mb", "0.512gb"), ("2.4GHz", "2400mhz"),
        ("It’s 10 megapixels!", "it s 10mp"), ("usb2-100 watt", "usb2-100 watt"), ("100-watt", "100w"),
    ],
)
def test_normalized(spark, text, want):
    assert one(spark, text, T.normalized) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Sony PS-LX350H Turntable", ["pslx350h"]), ("Monitor 1080p 320GB usb2 DDR3", []), ("Cable 12345-67 and 10000", ["1234567"]), ("X1 AB-12/C AB12C", ["ab12c"]), ("", []),
        ("5 Disc CD Player CDPCE375 cdp-ce375", ["cdpce375"]),
    ],
)
def test_model_tokens(spark, text, want):
    assert one(spark, text, T.model_tokens) == want


@pytest.mark.parametrize(("text", "want"), [("8x zoom", 8), ("1080 x 720", None), ("3-pack", 3), ("pack of 12", 12), ("set of 1", None), ("none", None), ("99999999999999999999 pcs", None)])
def test_pack_quantity(spark, text, want):
    assert one(spark, text, T.pack_quantity) == want


def test_attributes(spark):
    assert one(spark, "Refurb phone, open box", T.condition) == "refurbished" and one(spark, "pre-owned", T.condition) == "used" and one(spark, "plain", T.condition) == "unknown"
    assert one(spark, "$1,299.50 was 1400", T.price) == 1299.5 and one(spark, "£ 12", T.price_currency) == "GBP" and one(spark, "call", T.price) is None
    assert one(spark, "Handset For The KXTG6700B", T.without_compatibility) == "Handset " and one(spark, "for all", T.without_compatibility) == "for all"
    assert one(spark, "320gb 52in 320gb 7gb", T.capacities) == {"gb": [7.0, 320.0], "in": [52.0]}
    assert one(spark, "a+b", T.is_bundle) and not one(spark, "a + b", T.is_bundle) and one(spark, "camera case", T.is_accessory)
    assert one(spark, "the black 12.5in lcd-tv", T.tokens) == ["12", "5in", "lcd", "tv"]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            row[j], last = max(row[j], row[j - 1], last + (x == y)), row[j]
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", max_size=30), st.text("abc ", max_size=30))
def test_lcs_and_ratios(a, b):
    assert S.lcs_length(a, b) == lcs(a, b)
    for ratio in S.RATIOS.values():
        assert 0 <= ratio(a, b) <= 1 and ratio(a, b) == pytest.approx(ratio(b, a))
    if a and b:
        short, long = sorted((a, b), key=len)
        windows = [long[max(0, i) : i + len(short)] for i in range(1 - len(short), len(long))]
        best = max(S.indel_ratio(short, w) for w in windows if w)
        if len(a) == len(b):
            best = max(best, max(S.indel_ratio(long, w) for w in (short[max(0, i) : i + len(long)] for i in range(1 - len(long), len(short))) if w))
        assert S.partial_ratio(a, b) == pytest.approx(best)


def test_ratio_edges():
    assert S.indel_ratio("", "") == 1 and S.token_set_ratio("", "a") == 0 and S.token_set_ratio("a b", "b a c") == 1 and S.token_sort_ratio("b a", "a b") == 1 and S.partial_ratio("", "a") == 0
