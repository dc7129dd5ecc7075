"""Exact quantiles of groups of any size: order statistics by histograms that are refined.

No task holds a group's values. A pass counts each group's values by bins between bounds and keeps, for the order statistics wanted, the
bin that holds them with the least and greatest value in it; these are the bounds of the next pass. It ends when the bounds are equal, so
values that are tied or constant end at once, and skewed ones once their bin is fine enough. Bins are monotone in the value, which is all
that the counts need to be exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticeworks.sources.store import stored

#: Bins of a pass.
BINS = 2048


def _bin(x: Column, low: Column, high: Column) -> Column:
    """A value's bin: -1 for minus infinity, BINS and BINS + 1 for infinity and NaN, which come last."""
    # halves, so that the span of all doubles is finite; a span whose half is nothing has no value between its ends
    part = F.try_divide(x / 2 - low / 2, high / 2 - low / 2)
    place = F.floor(F.coalesce(part, F.when(x == low, 0.0).otherwise(1.0)) * BINS)
    inside = F.when(low == high, 0).otherwise(F.least(place, F.lit(BINS - 1)))
    return F.when(F.isnan(x), BINS + 1).when(x == float("inf"), BINS).when(x == float("-inf"), -1).otherwise(inside).cast("int")


def order_statistics(values: DataFrame, by: list[str], ranks: DataFrame) -> DataFrame:
    """(by, rank, x): of values (by, x) without nulls the value at each wanted place (by, rank) in rising order, counted from 0."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    bounds = values.groupBy(*by).agg(F.min(finite(F.col("x"))).alias("low"), F.max(finite(F.col("x"))).alias("high"))
    zero = F.lit(0.0)
    todo = stored(ranks.join(bounds, by).select(*by, "rank", F.lit(0).cast("long").alias("before"), F.coalesce("low", zero).alias("low"), F.coalesce("high", zero).alias("high"), F.lit(True).alias("whole")))
    found = None
    while True:
        # a target's own values: all of them at first, then those between its bounds
        own = values.join(todo.withColumnRenamed("rank", "_rank"), by).where(F.col("whole") | ((F.col("x") >= F.col("low")) & (F.col("x") <= F.col("high"))))
        counted = own.groupBy(*by, "_rank", "before", _bin(F.col("x"), F.col("low"), F.col("high")).alias("bin")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        upto = Window.partitionBy(*by, "_rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # a row for each bin
        placed = counted.withColumn("upto", F.col("before") + F.sum("n").over(upto))
        hit = placed.where((F.col("upto") > F.col("_rank")) & (F.col("upto") - F.col("n") <= F.col("_rank")))
        hit = stored(hit.select(*by, F.col("_rank").alias("rank"), (F.col("upto") - F.col("n")).alias("before"), "low", "high"))
        single = F.col("low") == F.col("high")  # NaN equals NaN here
        done = hit.where(single).select(*by, "rank", F.col("low").alias("x"))
        found = done if found is None else found.unionByName(done)
        todo = hit.where(~single).withColumn("whole", F.lit(False))
        if todo.isEmpty():
            return found


def quantiles(df: DataFrame, by: list[str], columns: dict[str, tuple[Column, float]]) -> DataFrame:
    """(by, name, ..): for each name a pair of a column and a share in [0, 1], interpolated between the two nearest values as a continuous
    quantile is; nulls do not count, and a group without values has null. The rows are read once for all names and then from a stored
    table of values."""
    cells = F.array(*(F.struct(F.lit(name).alias("_name"), c.cast("double").alias("x")) for name, (c, _) in columns.items()))
    long = stored(df.select(*by, F.explode(cells).alias("c")).select(*by, "c._name", "c.x").where("x IS NOT NULL"))
    share = F.lit(None).cast("double")
    for name, (_, q) in columns.items():
        share = F.when(F.col("_name") == name, F.lit(float(q))).otherwise(share)
    key = [*by, "_name"]
    sizes = stored(long.groupBy(*key).agg(F.count("*").alias("n")).withColumn("at", share * (F.col("n") - 1)))
    sizes = sizes.withColumn("low", F.floor("at")).withColumn("high", F.ceil("at"))
    ranks = sizes.select(*key, F.explode(F.array_distinct(F.array("low", "high"))).alias("rank"))
    # nulls as keys of a group meet under a name of their own
    code = F.xxhash64(*key, *(F.col(k).isNull() for k in by))
    coded = stored(sizes.select(code.alias("_g"), *key, "at", "low", "high"))
    x = order_statistics(long.select(code.alias("_g"), "x"), ["_g"], ranks.select(code.alias("_g"), "rank"))
    pair = lambda side: x.select("_g", F.col("rank").alias(side), F.col("x").alias(f"x_{side}"))
    both = coded.join(pair("low"), ["_g", "low"]).join(pair("high"), ["_g", "high"])
    value = F.when(F.col("x_low") == F.col("x_high"), F.col("x_low")).otherwise(F.col("x_low") + (F.col("at") - F.col("low")) * (F.col("x_high") - F.col("x_low")))
    return both.groupBy(*by).agg(*(F.max(F.when(F.col("_name") == name, value)).alias(name) for name in columns))
