"""Column expressions shared by the jobs.

All are built-in Spark expressions, so they stay inside whole-stage codegen.

Rounding rule used throughout: ratios are computed in DOUBLE, then snapped to
six decimals (``DECIMAL(38,6)``) and rounded there. Rounding an exact decimal
is deterministic (HALF_UP for ``round``, HALF_EVEN for ``bround``) and does not
depend on how a binary double happens to sit near a tie.

Averages of money are ``CAST(SUM(x) AS DOUBLE) / COUNT(x)``: the sum is an
exact decimal whatever the order of rows, so the quotient is the same on every
run and every partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SNAP = "decimal(38,6)"


def col(c) -> Column:
    if isinstance(c, str):
        return F.col(c)
    if isinstance(c, (int, float)):
        return F.lit(c)
    return c


def idiv(a, b) -> Column:
    """Integer division truncating toward zero (SQL ``div``), exact in BIGINT."""
    return F.call_function("div", col(a), col(b))


def money_from_cents(cents, precision: int = 12) -> Column:
    """BIGINT cents -> DECIMAL(precision, 2), exactly."""
    return (col(cents).cast("decimal(18,0)") / F.lit(100)).cast(f"decimal({precision},2)")


def nz(c) -> Column:
    """NULLIF(c, 0): guards every division (ANSI mode raises on /0)."""
    return F.nullif(col(c), F.lit(0))


def dbl(c) -> Column:
    return col(c).cast("double")


def ratio(num, den) -> Column:
    """num / NULLIF(den, 0) in DOUBLE."""
    return dbl(num) / dbl(nz(den))


def round_up(x, n: int) -> Column:
    """Round half away from zero at n decimals, via an exact 6-decimal snap."""
    return F.round(col(x).cast(SNAP), n)


def round_even(x, n: int) -> Column:
    """Round half to even at n decimals (pandas / Python ``round``)."""
    return F.bround(col(x).cast(SNAP), n)


def pct(num, den, n: int) -> Column:
    """ROUND(100 * num / NULLIF(den, 0), n)."""
    return round_up(ratio(num, den) * F.lit(100.0), n)


def mean(c) -> Column:
    """Exact-sum mean: CAST(SUM(c) AS DOUBLE) / COUNT(c). NULL on no rows."""
    return dbl(F.sum(col(c))) / dbl(nz(F.count(col(c))))


def int_mean(c) -> Column:
    """T-SQL AVG(int): SUM div COUNT (truncating)."""
    return idiv(F.sum(col(c)), nz(F.count(col(c))))


def count_if(cond) -> Column:
    """COUNT(CASE WHEN cond THEN 1 END)."""
    return F.count(F.when(cond, F.lit(1)))


def sum_if(cond, value) -> Column:
    """SUM(CASE WHEN cond THEN value ELSE 0 END)."""
    return F.sum(F.when(cond, value).otherwise(F.lit(0)))


def month_key(d) -> Column:
    return F.date_format(col(d), "yyyy-MM")


def weekday_mon0(d) -> Column:
    """Day of week with Monday = 0 (pandas ``dt.dayofweek``)."""
    return F.weekday(col(d))


def clip(x, lo: float, hi: float) -> Column:
    """pandas ``clip(lo, hi)``: NULL stays NULL (greatest/least would skip it)."""
    x = col(x)
    return F.when(x.isNull(), F.lit(None)).otherwise(F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def hash_uniform(key, seed: int) -> Column:
    """Deterministic U[0,1) draw per key: first 32 bits of md5(key || ':' || seed).

    Independent of row order and partitioning, unlike ``rand(seed)``.
    """
    h = F.substring(F.md5(F.concat(col(key).cast("string"), F.lit(f":{seed}"))), 1, 8)
    return F.conv(h, 16, 10).cast("double") / F.lit(4294967296.0)


def to_output(df: DataFrame) -> DataFrame:
    """Normalise result types for cross-engine comparison and export:
    DECIMAL -> DOUBLE, DATE/TIMESTAMP -> ISO text, small ints -> BIGINT."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if isinstance(t, T.DecimalType) or isinstance(t, T.FloatType):
            c = c.cast("double")
        elif isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        elif isinstance(t, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)
