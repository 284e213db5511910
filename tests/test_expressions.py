import datetime as dt
import math

import pytest

from latticework.frame import ArrayFrame
from latticework.schema import ArrayError
from latticework.sources.literal import literal


@pytest.fixture(scope="module")
def one(spark):
    return literal(spark, "<a:int64, d:double, s:string, t:datetime, n:int64 null, f:double>[i=0:0,1,0]", "[(7, 2.5, 'Anne', '2012-04-12 12:14:01', null, nan)]")


CASES = {
    "a / 2": 3, "-a / 2": -3, "a % 4": 3, "a + d": 9.5, "a / 2.0": 3.5, "d / 0": math.inf, "-d / 0.0": -math.inf, "a * n": None, "s + '!'": "Anne!", "strlen(s)": 4,
    "substr(s, 1, 2)": "nn", "strchar(s)": "A", "regex(s, 'A.*')": True, "regex(s, 'nn')": False, "iif(a > 3, 'x', 'y')": "x", "n is null": True, "is_null(n) and a = 7": True,
    "not (a = 7)": False, "a between 7 and 9": True, "f = f": False, "f <> f": True, "f < 1": False, "is_nan(f)": True, "min(a, 3)": 3, "max(d, 3.0)": 3.0, "ceil(d)": 3, "floor(d)": 2,
    "pow(a, 2)": 49.0, "log(0.0)": -math.inf, "day_of_week(t)": 4, "hour_of_day(t)": 12, "strftime(t, '%B %d, %Y')": "April 12, 2012", "strftime(t, '%l:%M:%S %p')": "12:14:01 PM",
    "strftime(t, '%r')": "12:14:01 PM", "strftime(t, '%F')": "2012-04-12", "t - datetime('2012-04-12 12:14:00')": 1, "t + 59": dt.datetime(2012, 4, 12, 12, 15), "get_offset(append_offset(t, 3600))": 3600,
    "togmt(append_offset(t, 3600))": dt.datetime(2012, 4, 12, 11, 14, 1), "strip_offset(apply_offset(t, 60))": dt.datetime(2012, 4, 12, 12, 15, 1), "int32(d)": 2, "double(a)": 7.0, "string(a)": "7", "bool(0)": False,
    "hygecdf(0.5, 100, 0, 1)": 0.0, "hygecdf(-1, 0, 1, 1)": 0.0, "hygecdf(1, 1, 0, 1)": 1.0, "hygequant(0.5, 1, 0, 1)": 1.0, "hygequant(0.2, 1, 1, 1)": 0.0, "isprime(999999999999999989)": True, "isprime(999999999999999991)": False, "isprime(n)": None,
    "isprime(a)": True, "isprime(9)": False, "fact(5)": 120, "re(complex(1, 2) * complex(3, 4))": -5.0, "i + 1": 1, "format(d, '%.2f')": "2.50",
}


@pytest.mark.parametrize("text", CASES)
def test_values(one, text):
    got = one.apply("r", text).df.first()["r"]
    want = CASES[text]
    assert got == want and (want is None) == (got is None)


def test_division_by_zero_of_integers(one):
    with pytest.raises(Exception, match="(?i)zero"):
        one.apply("r", "a / 0").df.collect()


@pytest.mark.parametrize("text", ["12/24/2010 17:12:20", "24.12.2010 17:12:20", "2010-12-24 17:12:20.5312", "2010-12-24 17.12.20.53", "2010-12-24 17.12.20", "24Dec2010:17:12:20", "24-Dec-2010 5.12.20 PM"])
def test_datetime_formats(spark, text):
    got = literal(spark, "<t:datetime>[i=0:0,1,0]", f"[('{text}')]").df.first()["t"]
    assert got == dt.datetime(2010, 12, 24, 17, 12, 20)


@pytest.mark.parametrize("text", ["a +", "(a", "a ! b", "nosuch(a)", "s - 1", "s * 'x'"])
def test_bad_expressions(one, text):
    with pytest.raises(ArrayError):
        one.apply("r", text)


def test_filter_reaches_the_scan(spark):
    a = ArrayFrame.from_table(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet"), ["l_orderkey"])
    plan = a.between(10, 20).project("l_quantity").df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_orderkey,10)" in plan and "l_comment" not in plan and "l_tax" not in plan.split("ReadSchema")[1]
