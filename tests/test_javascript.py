"""Texts, numbers and hosts as a JavaScript service has them."""

import json

import pytest
from pyspark.sql import functions as F

from factmill.functions import text, urls
from factmill.operators import coerce


def column(spark, values, f):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string").repartition(3)
    return [r[1] for r in sorted(df.select("i", f(F.col("v"))).collect())]


def test_cuts_and_lengths_count_utf16_units(spark):
    values = ["abcdef", "a😀b", "ab😀", "😀😀", "", None, "éé￮😀"]
    cut = lambda v, n: None if v is None else v.encode("utf-16-be")[: 2 * n].decode("utf-16-be", "replace")
    for n in (1, 2, 3, 4, 5):
        assert column(spark, values, lambda c, n=n: text.left_units(c, n)) == [cut(v, n) for v in values]
    assert column(spark, values, text.units) == [None if v is None else len(v.encode("utf-16-be")) // 2 for v in values]
    assert column(spark, ["x " + "😀" * 5], lambda c: text.clean_public_text(c, 5)) == ["x 😀�"]


NUMBERS = ["1", "1.50", "1e10", "1.5e20", "1e21", "1.25e+22", "1e-6", "1.5e-6", "1e-7", "123456789.125", "0.001", "0.0001234", "-0", "-0.0", "0", "100", "1e2", "-2.50e3", "9007199254740991", "12345678901234567890", "1e300", "5e-324", "-1e-9", "0.1", "3.0", "12345678", "2e23"]
#: What String() of each gives.
WRITTEN = ["1", "1.5", "10000000000", "150000000000000000000", "1e+21", "1.25e+22", "0.000001", "0.0000015", "1e-7", "123456789.125", "0.001", "0.0001234", "0", "0", "0", "100", "100", "-2500", "9007199254740991", "12345678901234567000", "1e+300", "5e-324", "-1e-9", "0.1", "3", "12345678", "2e+23"]


def test_numbers_are_written_as_javascript_does(spark):
    got = column(spark, NUMBERS, lambda c: coerce.coerce_string(F.try_parse_json(c)))
    assert got == WRITTEN
    nested = column(spark, [f'{{"label": {{"value": {n}}}}}' for n in NUMBERS[:9]], lambda c: coerce.coerce_string(F.try_parse_json(c)))
    assert nested == WRITTEN[:9]


def test_objects_of_any_depth_and_width_stand_for_their_text(spark):
    deep = "x"
    for k in range(200):
        deep = {coerce.TEXT_KEYS[k % 6]: deep}
    wide = {f"k{k}": "no" for k in range(1000)} | {"label": {"text": {"title": [], "name": None}, "name": {"label": "y"}}}
    # The way down to the only text is the last of all: every other member is an object that holds none.
    full = {"label": "z"}
    for _ in range(60):
        full = {k: {"value": "", "text": False} for k in coerce.TEXT_KEYS[:-1]} | {"label": full}
    values = [json.dumps(x) for x in (deep, wide, full, {"value": {}}, {"value": "", "text": True, "content": 0}, [], "", {"other": {"value": "q"}}, {"value": ["a"], "name": "{{{"})]
    assert column(spark, values, lambda c: coerce.coerce_string(F.try_parse_json(c))) == ["x", "y", "z", None, "0", None, "", None, "{{{"]


@pytest.mark.parametrize(
    ("url", "shown"),
    [
        ("https://bücher.de/", "https://xn--bcher-kva.de/"),
        ("https://BÜCHER.de/a b", "https://xn--bcher-kva.de/a%20b"),
        ("http://www.例子.com", "http://www.xn--fsqu00a.com/"),
        ("http://b%C3%BCcher.de/?b=1&a=2", "http://xn--bcher-kva.de/?a=2&b=1"),
        ("https://ｃｌｉｎｉｃ.com/", "https://clinic.com/"),
        ("https://clinic。com/", "https://clinic.com/"),
        ("https://faß.de/", None),
        ("https://пример.рф/", None),
        ("https://exa％mple.com/", None),
        ("https://clinic.org/?\U0001f600=1&￮=2", "https://clinic.org/?%F0%9F%98%80=1&%EF%BF%AE=2"),
    ],
)
def test_hosts_and_parameters(spark, url, shown):
    assert column(spark, [url], urls.safe_public_url) == [shown]
