"""Statistics of an evaluation: intervals, paired tests, calibration, quantiles. All as DataFrame plans."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z = 1.959964


def wilson(hits: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """95% score interval of a share; null without trials."""
    p = F.try_divide(hits, n)
    mid, wide = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    ok = lambda x: F.when(n > 0, x)
    return ok(F.greatest((mid - wide) / scale, F.lit(0.0))), ok(F.least((mid + wide) / scale, F.lit(1.0)))


def _series(x, power=pow):
    """By how much ln x! exceeds Stirling's formula, from 32 on: off by less than 1e-16 there."""
    return 1 / (12 * x) - 1 / (360 * power(x, 3)) + 1 / (1260 * power(x, 5)) - 1 / (1680 * power(x, 7))


#: The same for 1 to 31, from ln x! itself.
_SMALL = [0.0, *(math.lgamma(x + 1) - (x + 0.5) * math.log(x) + x - math.log(2 * math.pi) / 2 for x in range(1, 32))]


def _excess(x: Column) -> Column:
    small = F.get(F.array(*(F.lit(v) for v in _SMALL)), F.least(x, F.lit(len(_SMALL) - 1)).cast("int"))
    return F.when(x < len(_SMALL), small).otherwise(_series(F.greatest(x, F.lit(1)).cast("double"), lambda y, k: F.pow(y, F.lit(k))))


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided p of the discordant counts: twice the binomial tail, at most 1; 1 if there are none.

    The tail is its largest term, by Stirling's formula with its series, times a sum of ratios, each term from the one
    before. More than 5 roots of n below the largest, all further terms together are less than a double's last digit of the sum."""
    n, low = (b + c).cast("long"), F.least(b, c).cast("long")
    high, apart = n - low, (n - 2 * low) / F.greatest(n, F.lit(1))
    power = -low * F.log1p(-apart) - high * F.log1p(apart) + _excess(n) - _excess(low) - _excess(high)
    some = F.sqrt(n / (2 * math.pi * F.greatest(low, F.lit(1)) * F.greatest(high, F.lit(1)))) * F.exp(power)
    largest = F.when(low == 0, F.exp(-n * math.log(2.0))).otherwise(some)
    steps = F.sequence(F.lit(0).cast("long"), F.least(low, F.ceil(5 * F.sqrt(n.cast("double"))).cast("long") + 10))

    def add(acc, j):
        term = F.when(j == 0, F.lit(1.0)).otherwise(acc["term"] * (low - j + 1) / (high + j))
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    ratios = F.aggregate(steps, F.struct(F.lit(0.0).alias("term"), F.lit(0.0).alias("sum")), add, lambda acc: acc["sum"])
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(2 * largest * ratios, F.lit(1.0)))


def paired(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Per group: both, a_only, b_only, neither and p of McNemar's exact test on two boolean columns."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).alias
    x, y = F.col(a), F.col(b)
    g = df.groupBy(*by).agg(n(x & y)("both"), n(x & ~y)("a_only"), n(~x & y)("b_only"), n(~x & ~y)("neither"))
    return g.withColumn("p", mcnemar(F.col("a_only"), F.col("b_only")))


def holm(df: DataFrame, by: list[str], p: str = "p") -> DataFrame:
    """``df`` with p_holm: the step-down correction within each family."""
    w = Window.partitionBy(*by).orderBy(p)
    m = F.count("*").over(Window.partitionBy(*by))
    raw = F.least(F.lit(1.0), (m - F.row_number().over(w) + 1) * F.col(p))
    return df.withColumn("_raw", raw).withColumn("p_holm", F.max("_raw").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_raw")


def quantiles(df: DataFrame, by: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """Per group, the element at floor(q x (n - 1)) of the sorted values. Equal values are counted first, so a task
    sorts the distinct values of a group only."""
    w = Window.partitionBy(*by)
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    upto = counted.withColumn("_upto", F.sum("_c").over(w.orderBy(value))).withColumn("_n", F.sum("_c").over(w))
    place = lambda q: F.floor(F.lit(q) * (F.col("_n") - 1))
    return upto.groupBy(*by).agg(*(F.max(F.when((F.col("_upto") - F.col("_c") <= place(q)) & (place(q) < F.col("_upto")), F.col(value))).alias(name) for name, q in qs.items()))


def auroc(df: DataFrame, score: str, positive: str, by: list[str] | None = None) -> DataFrame:
    """Mann-Whitney area, ties one half. Counts per distinct score come first, so ties never swell."""
    by = by or []
    c = df.groupBy(*by, score).agg(F.sum(F.col(positive).cast("long")).alias("pos"), F.sum((~F.col(positive)).cast("long")).alias("neg"))
    w = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("below", F.coalesce(F.sum("neg").over(w), F.lit(0)))
    g = c.groupBy(*by).agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return g.select(*by, "n_pos", "n_neg", F.try_divide("u", F.col("n_pos") * F.col("n_neg")).alias("auroc"))


def reliability(df: DataFrame, p: str, right: str, bins: int = 10) -> DataFrame:
    """Per equal-width bin (the last one closed): n, mean_p, share right."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(right).cast("double")).alias("accuracy"))


def calibration(df: DataFrame, p: str, right: str, bins: int = 10) -> DataFrame:
    """One row: n, expected calibration error, Brier score."""
    r = reliability(df, p, right, bins)
    ece = r.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("accuracy"))) / F.sum("n")).alias("ece"))
    brier = df.agg(F.avg(F.pow(F.col(p) - F.col(right).cast("double"), F.lit(2.0))).alias("brier"))
    return ece.crossJoin(brier)  # one row with one row


def token_cost(tokens: Column, price_per_million: float) -> Column:
    return tokens * price_per_million / 1e6


def host_cost(records: Column, requests: Column, per_record: float, per_request: float) -> Column:
    """Cost model of a hosted search: a charge per record kept and per request."""
    return records * per_record + requests * per_request
