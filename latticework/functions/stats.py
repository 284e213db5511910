"""Functions that Spark SQL can't say: hypergeometric distribution, and primes of any long. Arrow batches, never rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

_DONE: set[str] = set()


def registered() -> None:
    """Register the functions in the active session, once."""
    spark = SparkSession.active()
    if spark.sparkContext.applicationId in _DONE and spark.catalog.functionExists("lattice_isprime"):
        return

    # nested, so that workers need not import this package
    def chances(m: float, n: float, k: float):
        """(least outcome, chances of the outcomes from there on) of k draws from m marked and n other ones; None where it isn't defined."""
        import math

        if not all(math.isfinite(x) and x >= 0 and x == int(x) for x in (m, n, k)) or k > m + n:
            return None
        lo, hi = int(max(0, k - n)), int(min(k, m))
        log = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
        return lo, [math.exp(log(m, x) + log(n, k - x) - log(m + n, k)) for x in range(lo, hi + 1)]

    def mapped(one, *columns: pd.Series) -> pd.Series:
        import numpy as np

        return pd.Series([None if any(v is None or v is pd.NA for v in row) or any(isinstance(v, float) and np.isnan(v) for v in row[1:4]) else one(*row) for row in zip(*columns)], dtype="float64")

    @F.pandas_udf("double")
    def pmf(x: pd.Series, m: pd.Series, n: pd.Series, k: pd.Series) -> pd.Series:
        def one(x, m, n, k):
            found = chances(m, n, k)
            if found is None:
                return float("nan")
            i = x - found[0]
            return found[1][int(i)] if i == int(i) and 0 <= i < len(found[1]) else 0.0

        return mapped(one, x, m, n, k)

    @F.pandas_udf("double")
    def cdf(x: pd.Series, m: pd.Series, n: pd.Series, k: pd.Series, lower: pd.Series) -> pd.Series:
        def one(x, m, n, k, lower):
            import math

            found = chances(m, n, k)
            if found is None or math.isnan(x):
                return float("nan")
            upto = len(found[1]) if x == math.inf else max(0, min(len(found[1]), math.floor(x) - found[0] + 1)) if x != -math.inf else 0
            p = 1.0 if upto == len(found[1]) else min(1.0, math.fsum(found[1][:upto]))
            return p if lower else 1.0 - p

        return mapped(one, x, m, n, k, lower)

    @F.pandas_udf("double")
    def quant(p: pd.Series, m: pd.Series, n: pd.Series, k: pd.Series) -> pd.Series:
        def one(p, m, n, k):
            found = chances(m, n, k)
            if found is None or not 0 <= p <= 1:
                return float("nan")
            total = 0.0
            for i, c in enumerate(found[1]):
                total += c
                if total >= p - 1e-12:
                    return float(found[0] + i)
            return float(found[0] + len(found[1]) - 1)

        return mapped(one, p, m, n, k)

    @F.pandas_udf("boolean")
    def prime(x: pd.Series) -> pd.Series:
        small = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37)  # witnesses that decide every 64-bit number

        def one(v: int) -> bool:
            if v < 2:
                return False
            for q in small:
                if v % q == 0:
                    return v == q
            d, r = v - 1, 0
            while d % 2 == 0:
                d, r = d // 2, r + 1
            for a in small:
                y = pow(a, d, v)
                if y in (1, v - 1):
                    continue
                for _ in range(r - 1):
                    y = y * y % v
                    if y == v - 1:
                        break
                else:
                    return False
            return True

        return pd.Series([None if v is None or pd.isna(v) else one(int(v)) for v in x], dtype="boolean")

    for name, f in {"hygepmf": pmf, "hygecdf": cdf, "hygequant": quant, "isprime": prime}.items():
        spark.udf.register(f"lattice_{name}", f)
    _DONE.add(spark.sparkContext.applicationId)
