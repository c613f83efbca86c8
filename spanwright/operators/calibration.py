"""Fits on histograms: ramps, monotone tables, isotonic steps and band thresholds.

Scores and measures are small integers, so every fit works on one row a value,
whatever the number of scored rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwright.functions.offsets import count_below

#: Highest share of independent controls at or above the ``high`` threshold.
HIGH_FALSE_ALARM = 0.02


def lower_median(rows: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """keys, median: the smallest value at which half of the weight (1 a row if not given) is reached."""
    cells = rows.groupBy(*keys, value).agg((F.sum(weight) if weight else F.count("*")).alias("w_"))
    run = F.sum("w_").over(Window.partitionBy(*keys).orderBy(value))
    total = F.sum("w_").over(Window.partitionBy(*keys))
    return cells.withColumn("run_", run).withColumn("total_", total).where(F.col("run_") >= F.col("total_") / 2).groupBy(*keys).agg(F.min(value).alias("median"))


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: list[float], weight: str | None = None, cuts: int = 256) -> DataFrame:
    """keys and quantiles (an array in the order of shares): the smallest value at which each share of the weight (1 a row if not given) is reached.

    Exact, and no task holds all values of a key: an approximate sketch cuts each
    key's values into ranges, the ranges' sums tell which of them hold a share, and
    only those are summed value by value. Null values take no part.
    """
    known = rows.where(F.col(value).isNotNull())
    at = F.percentile_approx(value, [i / cuts for i in range(1, cuts)], 10 * cuts)
    bounds = known.groupBy(*keys).agg(F.array_distinct(at).alias("cuts_"))
    cells = known.groupBy(*keys, value).agg((F.sum(weight) if weight else F.count("*")).alias("w_"))
    ranged = cells.join(F.broadcast(bounds), keys).withColumn("range_", count_below(F.col("cuts_"), F.col(value))).drop("cuts_")  # a row a key
    order = Window.partitionBy(*keys).orderBy("range_")
    sums = ranged.groupBy(*keys, "range_").agg(F.sum("w_").alias("own_"))
    sums = sums.withColumn("before_", F.coalesce(F.sum("own_").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total_", F.sum("own_").over(Window.partitionBy(*keys)))
    asked = sums.withColumn("share_", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(shares)])))
    goal = F.col("share_.p") * F.col("total_")
    asked = asked.where((F.col("before_") + F.col("own_") >= goal) & ((F.col("before_") < goal) | (F.col("before_") == 0)))
    inside = ranged.join(asked.select(*keys, "range_", "before_", "total_", "share_"), [*keys, "range_"])
    run = F.col("before_") + F.sum("w_").over(Window.partitionBy(*keys, "range_", "share_.i").orderBy(value))
    reached = inside.withColumn("run_", run).where(F.col("run_") >= F.col("share_.p") * F.col("total_")).groupBy(*keys, "share_.i").agg(F.min(value).alias("q_"))
    return reached.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "q_"))), lambda x: x["q_"]).alias("quantiles"))


def fit_ramps(measures: DataFrame, weight: str | None = None) -> DataFrame:
    """signal, lo, hi of measures (signal, positive, x, and the weight of a row if named): from the controls' median to that of the positives, never falling."""
    m = lower_median(measures.where("positive is not null"), ["signal", "positive"], "x", weight)
    pick = lambda side: F.coalesce(F.max(F.when(F.col("positive") == side, F.col("median"))), F.lit(0))
    return m.groupBy("signal").agg(pick(False).alias("lo"), pick(True).alias("top")).select("signal", "lo", F.greatest("lo", "top").alias("hi"))


def ramp(x: Column, lo: Column, hi: Column, points: int) -> Column:
    """Points in proportion to the way from lo to hi."""
    return F.when(x <= lo, F.lit(0)).when(x >= hi, F.lit(points)).otherwise(F.floor((x - lo) * points / (hi - lo))).cast("int")


def fit_lookup(cells: DataFrame, cap: int) -> DataFrame:
    """e, l, points of cells (e, l, positive, control): the smoothed share of positives up to cap, never falling along e or l."""
    grid = cells.select("e").distinct().join(cells.select("l").distinct())
    full = grid.join(cells, ["e", "l"], "left").fillna(0, ["positive", "control"])
    own = F.floor(cap * (F.col("positive") + 1) / (F.col("positive") + F.col("control") + 2)).cast("long")
    along = full.withColumn("points", own).withColumn("points", F.max("points").over(Window.partitionBy("e").orderBy("l")))
    return along.select("e", "l", F.max("points").over(Window.partitionBy("l").orderBy("e")).alias("points"))


def isotonic(cells: DataFrame) -> DataFrame:
    """score, fitted of cells (score, n, y): the rising step function nearest in squares, by the greatest lower mean.

    The fit at a score is the largest, over starts up to it, of the smallest
    mean from that start to any end at or after it.
    """
    upto = Window.orderBy("score")
    c = cells.withColumn("ny", F.sum("y").over(upto)).withColumn("nn", F.sum("n").over(upto))
    start = c.select(F.col("score").alias("a"), (F.col("ny") - F.col("y")).alias("y0"), (F.col("nn") - F.col("n")).alias("n0"))
    end = c.select(F.col("score").alias("b"), "ny", "nn")
    means = start.join(end, F.col("a") <= F.col("b")).withColumn("mean", (F.col("ny") - F.col("y0")) / (F.col("nn") - F.col("n0")))
    least = means.withColumn("least", F.min("mean").over(Window.partitionBy("a").orderBy(F.desc("b"))))
    return least.groupBy(F.col("b").alias("score")).agg(F.max("least").alias("fitted"))


def error_rates(scores: DataFrame, most: int, weight: str | None = None) -> DataFrame:
    """t, leak, alarm, independent for thresholds 1 to most, of scores (score, positive, independent, and a weight if named): shares of positives below t and of (independent) controls at t or above."""
    w = F.col(weight) if weight else F.lit(1)
    n = lambda c: F.sum(F.when(c, w).otherwise(0))
    control = ~F.col("positive")
    hist = scores.groupBy(F.col("score").alias("t")).agg(n(F.col("positive")).alias("p"), n(control).alias("c"), n(control & F.col("independent")).alias("i"))
    grid = scores.sparkSession.range(1, most + 2).select(F.col("id").cast("int").alias("t"))
    full = grid.join(hist, "t", "full_outer").fillna(0, ["p", "c", "i"])
    below, above = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("t").rowsBetween(0, Window.unboundedFollowing)
    all_ = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    share = lambda c, w: F.coalesce(F.sum(c).over(w) / F.nullif(F.sum(c).over(all_), F.lit(0)), F.lit(0.0))
    return full.select("t", share("p", below).alias("leak"), share("c", above).alias("alarm"), share("i", above).alias("independent")).where(F.col("t").between(1, most + 1))


def _plateau(costs: DataFrame) -> DataFrame:
    """One row, t: the middle of the first run of least cost."""
    low = costs.withColumn("least", F.min("cost").over(Window.partitionBy())).where(F.col("cost") <= F.col("least") + 1e-12)
    runs = low.withColumn("run", F.col("t") - F.row_number().over(Window.orderBy("t")))
    first = runs.groupBy("run").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    return first.agg(F.min_by(F.floor((F.col("a") + F.col("b")) / 2).cast("int"), "a").alias("t"))


def fit_thresholds(scores: DataFrame, floor_high: int, most: int, weight: str | None = None) -> DataFrame:
    """low, medium, high (one row): high by independent false alarms, medium and low by the cost of leaks and alarms below the next."""
    rates = error_rates(scores, most, weight)
    high = rates.where((F.col("t") >= max(floor_high, 3)) & (F.col("t") <= most) & (F.col("independent") <= HIGH_FALSE_ALARM)).agg(F.coalesce(F.min("t"), F.lit(most + 1)).alias("high"))
    medium = _plateau(rates.join(high).where((F.col("t") >= 2) & (F.col("t") < F.col("high"))).withColumn("cost", F.col("leak") + F.col("alarm"))).withColumnRenamed("t", "medium")
    low = _plateau(rates.join(medium).where(F.col("t") < F.col("medium")).withColumn("cost", 2 * F.col("leak") + F.col("alarm"))).withColumnRenamed("t", "low")
    return low.join(medium).join(high)


def band_outcomes(scores: DataFrame, threshold: int, by: str) -> DataFrame:
    """For each stratum rows, the measurable share, and among measurable rows the shares of positives below and of (independent) controls from the threshold on."""
    ok, over = F.col("measurable"), F.col("score") >= threshold
    share = lambda part, whole: F.round(F.coalesce(F.try_divide(F.count_if(part & whole), F.count_if(whole)), F.lit(0.0)), 6)
    control = ok & ~F.col("positive")
    return scores.groupBy(by).agg(
        F.count("*").alias("n"), share(ok, F.lit(True)).alias("measurable"), share(~over, ok & F.col("positive")).alias("leak"),
        share(over, control).alias("alarm"), share(over, control & F.col("independent")).alias("independent_alarm"),
    )


def half_weights(counts: DataFrame) -> DataFrame:
    """counts (generated, n by any keys) with weight: authored rows are scaled up to half of the total if they are fewer."""
    n = lambda of, name: F.sum(F.when(of, F.col("n"))).alias(name)
    total = counts.agg(n(F.col("generated"), "made"), n(~F.col("generated"), "authored"))
    scale = F.when(~F.col("generated") & (F.col("made") > F.col("authored")), F.col("made") / F.col("authored")).otherwise(1.0)
    return counts.crossJoin(F.broadcast(total)).withColumn("weight", scale).drop("made", "authored")
