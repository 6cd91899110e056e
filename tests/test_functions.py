"""Scalar rules, each against its hand-written expectation."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from navlens.functions import ids as IDS
from navlens.functions import scalars as SC
from navlens.functions import text as TX


def one(spark, expr, value, typ="string"):
    return spark.createDataFrame([(value,)], f"x {typ}").select(expr.alias("y")).collect()[0]["y"]


@pytest.mark.parametrize("text,expected", [
    ("[1,2]", ["1", "2"]), ("1,2", ["1", "2"]), ('["1","2"]', ["1", "2"]), ("['1', '2']", ["1", "2"]),
    ("[abc,def]", ["abc", "def"]), ("7", ["7"]), ("[]", []), ("", []), (" 1 ,\t2,, ", ["1", "2"]),
])
def test_parse_id_list(spark, text, expected):
    assert one(spark, IDS.parse_id_list(F.col("x")), text) == expected


@pytest.mark.parametrize("text,expected", [
    ("123", "123"), (" '45' ", "45"), ('"67"', "67"), ("1.5e+3", "1500"), ("1.9E+1", "19"),
    ("-2.5e+0", "-2"), ("12e-1", "1"), ("xe+", "xe+"),
])
def test_normalize_id(spark, text, expected):
    assert one(spark, IDS.normalize_id(F.col("x")), text) == expected


@pytest.mark.parametrize("text,expected", [("1", True), ("True", True), ("TRUE", True), ("true", True),
                                           ("yes", False), ("0", False), (None, False)])
def test_parse_bool(spark, text, expected):
    assert one(spark, SC.parse_bool(F.col("x")), text) is expected


@pytest.mark.parametrize("text,expected", [("12", 12), ("12.7", 12), ("-3.9", -3), ("", None), ("x", None)])
def test_parse_int(spark, text, expected):
    assert one(spark, SC.parse_int(F.col("x")), text) == expected


@pytest.mark.parametrize("text,expected", [
    ("2024-01-02 03:04:05", dt.datetime(2024, 1, 2, 3, 4, 5)),
    ("2024-01-02T03:04:05", dt.datetime(2024, 1, 2, 3, 4, 5)), ("", None), ("garbage", None)])
def test_parse_datetime(spark, text, expected):
    assert one(spark, SC.parse_datetime(F.col("x")), text) == expected


@pytest.mark.parametrize("x,n", [(0.25, 1), (0.125, 2), (2.5, 0), (3.5, 0), (12.75, 1), (66.66666, 1)])
def test_python_rounding_is_half_even(spark, x, n):
    # exact binary ties round to even like Python's round(); values such as 0.35
    # (binary 0.3499..) are the documented divergence: decimal half-even gives 0.4
    assert one(spark, SC.py_round(F.col("x"), n), x, "double") == round(x, n)


def test_int_truncates(spark):
    assert one(spark, SC.trunc_int(F.col("x")), 3.9, "double") == 3
    assert one(spark, SC.trunc_int(F.col("x")), -3.9, "double") == -3


@pytest.mark.parametrize("url,expected", [("https://a/b/c", "c"), ("https://a/b/", "Page"), ("x", "x")])
def test_url_leaf(spark, url, expected):
    assert one(spark, SC.url_leaf(F.col("x")), url) == expected


def test_decode_escapes(spark):
    assert one(spark, TX.decode_escapes(F.col("x")), "\\u041f\\u0440\\u0438\\u0432\\u0435\\u0442 ok \\u0021") == \
        "Привет ok !"
    assert one(spark, TX.decode_escapes(F.col("x")), "plain") == "plain"


def test_pct_change_guard(spark):
    df = spark.createDataFrame([(0, 5), (4, 5)], "o long, n long")
    assert [r[0] for r in df.select(SC.pct_change(F.col("o"), F.col("n"))).collect()] == [0.0, 25.0]
