"""A grid of scoring configurations, fitted at once on cells of the rows, with one fold left out at a time.

Rows are counted once by fold, side, kind and measures. Every configuration and
every left-out fold works on those cells: medians of a fit without a fold come
from the totals less that fold's counts, scores of all configurations from one
explosion of the cells, thresholds from running sums over scores. What is scored
grows with cells, configurations and folds, never with rows.

Rows have ``fold``, ``evaluation`` (not fitted on), ``positive`` (null takes no
part), ``independent`` (a control that is no twin), ``context``, ``negative``
(booleans) and whole-number measures; nulls in booleans count as false, in
measures as 0. Measures may have any name but those and n and w. Only development
rows fit anything.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwright.functions.text import let
from spanwright.storage import written

from .calibration import HIGH_FALSE_ALARM, lower_median, ramp

# The caps of the grid, and how far a configuration may be from the best and still be chosen.
RANDOMNESS, LEXICAL, CONTEXTUAL, TOLERANCE = [30, 40, 50, 60], [10, 20], [30, 40, 50, 60], 0.01
#: Name of the fit that leaves out no fold.
ALL = ""


@dataclass(frozen=True)
class Spec:
    """Measures of each group and the points that a group can give at most; within a group the k-th best measure counts 2 ** -k."""

    name: str
    randomness: tuple[str, ...]
    lexical: tuple[str, ...]
    r: int
    l: int  # noqa: E741
    c: int

    @property
    def most(self) -> int:
        return (self.r if self.randomness else 0) + (self.l if self.lexical else 0) + self.c

    @property
    def parameters(self) -> int:
        """Fitted constants: two a measure, two caps, context, negative evidence and three thresholds."""
        return 2 * (len(self.randomness) + len(self.lexical)) + 7


def grid(randomness: dict[str, tuple[str, ...]], lexical: dict[str, tuple[str, ...]]) -> list[Spec]:
    """Every pair of measure sets with every combination of caps; without lexical measures their cap is 0."""
    return [
        Spec(f"{rn}-{ln}-r{r}-l{cap}-c{c}", rs, ls, r, cap, c)
        for rn, rs in randomness.items() for ln, ls in lexical.items() for r in RANDOMNESS for cap in (LEXICAL if ls else [0]) for c in CONTEXTUAL
    ]


def neighbours(spec: Spec, pool: list[Spec]) -> list[Spec]:
    """Specs of the same measures of which one cap is one step of the grid away."""

    def steps(a: int, b: int, caps: list[int]) -> int:
        return abs(caps.index(a) - caps.index(b)) if a != b else 0

    def near(s: Spec) -> bool:
        if (s.randomness, s.lexical) != (spec.randomness, spec.lexical):
            return False
        return sorted([steps(spec.r, s.r, RANDOMNESS), steps(spec.l, s.l, LEXICAL), steps(spec.c, s.c, CONTEXTUAL)]) == [0, 0, 1]

    return [s for s in pool if near(s)]


def cells(rows: DataFrame, measures: list[str], weight: str | None = None) -> DataFrame:
    """The rows counted by all that scoring looks at: n rows of weight w."""
    flags = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("evaluation", "independent", "context", "negative")]
    keys = ["fold", "positive", *flags, *[F.coalesce(F.col(m), F.lit(0)).cast("long").alias(m) for m in measures]]
    return rows.where(F.col("positive").isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), (F.sum(weight) if weight else F.count("*")).cast("double").alias("w"))


def _ramps(counted: DataFrame, folds: DataFrame, measures: list[str]) -> DataFrame:
    """left_out, ends (map of measure to lo and hi): medians of controls and positives without each fold, from totals less the fold's own."""
    named = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("x")) for m in measures]))
    own = counted.where(~F.col("evaluation")).select("fold", "positive", "w", named.alias("m")).groupBy("m.measure", "positive", "m.x", "fold").agg(F.sum("w").alias("w"))
    total = own.groupBy("measure", "positive", "x").agg(F.sum("w").alias("total")).join(F.broadcast(folds))  # a row a fold
    less = own.select("measure", "positive", "x", F.col("fold").alias("left_out"), F.col("w").alias("less"))
    rest = total.join(less, ["measure", "positive", "x", "left_out"], "left").withColumn("w", F.col("total") - F.coalesce("less", F.lit(0.0))).where("w > 0")
    median = lower_median(rest, ["left_out", "measure", "positive"], "x", "w")
    pick = lambda side: F.coalesce(F.max(F.when(F.col("positive") == side, F.col("median"))), F.lit(0))
    ends = median.groupBy("left_out", "measure").agg(pick(False).alias("lo"), pick(True).alias("top"))
    both = F.struct(F.col("lo").alias("lo"), F.greatest("lo", "top").alias("hi"))
    return ends.groupBy("left_out").agg(F.map_from_entries(F.collect_list(F.struct(F.col("measure"), both))).alias("ends"))


def _group(measures: Column, cap: Column, values: Column) -> Column:
    """Points of a group: the ramps of its measures from best to worst, each counting half of the one before, up to the cap."""
    points = F.transform(measures, lambda m: let(F.element_at(F.col("ends"), m), lambda e: ramp(F.element_at(values, m), F.coalesce(e["lo"], F.lit(0)), F.coalesce(e["hi"], F.lit(0)), cap)))
    ranked = F.sort_array(points, asc=False)
    halves = F.transform(ranked, lambda p, i: F.floor(p / F.pow(F.lit(2.0), i)).cast("int"))
    return F.least(cap, F.aggregate(halves, F.lit(0), lambda a, x: a + x))


def histograms(counted: DataFrame, specs: list[Spec], measures: list[str]) -> DataFrame:
    """spec (index), left_out, held (rows of that fold), evaluation, positive, independent, score, n, w."""
    spark = counted.sparkSession
    folds = counted.where(~F.col("evaluation")).select(F.col("fold").alias("left_out")).distinct().unionByName(spark.createDataFrame([(ALL,)], "left_out string"))
    table = spark.createDataFrame([(i, list(s.randomness), list(s.lexical), s.r, s.l, s.c) for i, s in enumerate(specs)], "spec int, randomness array<string>, lexical array<string>, r int, l int, c int")
    values = F.map_from_arrays(F.array(*map(F.lit, measures)), F.array(*measures))
    plain = counted.select("fold", "evaluation", "positive", "independent", "context", "negative", "n", "w", values.alias("values"))
    plain = plain.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # a cell becomes many rows
    every = plain.join(F.broadcast(_ramps(counted, folds, measures)))  # a row a fold
    every = every.where(~F.col("evaluation") | (F.col("left_out") == ALL)).join(F.broadcast(table))  # a row a configuration
    score = _group(F.col("randomness"), F.col("r"), F.col("values")) + _group(F.col("lexical"), F.col("l"), F.col("values")) + F.when(F.col("context"), F.col("c")).otherwise(0)
    score = F.when(F.col("negative"), 0).otherwise(score)  # negative evidence weighs as much as all positive evidence
    held = F.coalesce(F.col("fold") == F.col("left_out"), F.lit(False))
    keys = ["spec", "left_out", held.alias("held"), "evaluation", "positive", "independent", score.cast("int").alias("score")]
    return every.select(*keys, "n", "w").groupBy("spec", "left_out", "held", "evaluation", "positive", "independent", "score").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))


def _plateau(costs: DataFrame, name: str) -> DataFrame:
    """spec, left_out and the middle of the first run of thresholds of least cost."""
    own = Window.partitionBy("spec", "left_out")
    low = costs.withColumn("least", F.min("cost").over(own)).where(F.col("cost") <= F.col("least") + 1e-12)
    runs = low.withColumn("run", F.col("t") - F.row_number().over(own.orderBy("t"))).groupBy("spec", "left_out", "run").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    return runs.groupBy("spec", "left_out").agg(F.min_by(F.floor((F.col("a") + F.col("b")) / 2).cast("int"), "a").alias(name))


def thresholds(hist: DataFrame, specs: list[Spec]) -> DataFrame:
    """spec, left_out, low, medium, high, fitted on development rows outside the left-out fold.

    high: the least threshold above what each group, and randomness and lexical
    together, can give, at which independent controls are flagged seldom enough;
    medium and low: the middles of the least costs of leaks and alarms below the
    next (a leak counts twice for low).
    """
    spark = hist.sparkSession
    limits = spark.createDataFrame([(i, max(s.r + s.l, s.c) + 1, s.most) for i, s in enumerate(specs)], "spec int, floor int, most int")
    own = hist.where("not evaluation and not held")
    at = lambda test, name: F.sum(F.when(test, F.col("w")).otherwise(0.0)).alias(name)
    control = ~F.col("positive")
    counts = own.groupBy("spec", "left_out", F.col("score").alias("t")).agg(at(F.col("positive"), "p"), at(control, "q"), at(control & F.col("independent"), "i"))
    steps = own.select("spec", "left_out").distinct().join(F.broadcast(limits), "spec").withColumn("t", F.explode(F.sequence(F.lit(0), F.col("most") + 1)))
    full = steps.join(counts, ["spec", "left_out", "t"], "left").fillna(0.0, ["p", "q", "i"])
    group = Window.partitionBy("spec", "left_out")
    below, above = group.orderBy("t").rowsBetween(Window.unboundedPreceding, -1), group.orderBy("t").rowsBetween(0, Window.unboundedFollowing)
    share = lambda c, w: F.coalesce(F.try_divide(F.sum(c).over(w), F.sum(c).over(group)), F.lit(0.0))
    rates = full.select("spec", "left_out", "t", "floor", "most", F.coalesce(share("p", below), F.lit(0.0)).alias("leak"), share("q", above).alias("alarm"), share("i", above).alias("independent")).where("t >= 1")
    allowed = F.when((F.col("t") >= F.greatest("floor", F.lit(3))) & (F.col("t") <= F.col("most")) & (F.col("independent") <= HIGH_FALSE_ALARM), F.col("t"))
    high = rates.groupBy("spec", "left_out").agg(F.coalesce(F.min(allowed), F.max("most") + 1).alias("high"))
    under = rates.join(high, ["spec", "left_out"])
    medium = _plateau(under.where("t >= 2 and t < high").withColumn("cost", F.col("leak") + F.col("alarm")), "medium")
    low = _plateau(under.join(medium, ["spec", "left_out"]).where("t < medium").withColumn("cost", 2 * F.col("leak") + F.col("alarm")), "low")
    return high.join(medium, ["spec", "left_out"]).join(low, ["spec", "left_out"], "left").select("spec", "left_out", F.coalesce("low", F.lit(1)).alias("low"), "medium", "high")


def balanced_errors(hist: DataFrame, fitted: DataFrame) -> DataFrame:
    """spec, left_out, development, evaluation, held: the shares of positives below and of controls from medium on, summed, for the rows of each part; held is null without both kinds."""
    over = F.col("score") >= F.col("medium")
    total = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))

    def error(part: Column, strict: bool = False) -> Column:
        positive, control = part & F.col("positive"), part & ~F.col("positive")
        shares = [F.try_divide(total(positive & ~over), total(positive)), F.try_divide(total(control & over), total(control))]
        return shares[0] + shares[1] if strict else F.coalesce(shares[0], F.lit(0.0)) + F.coalesce(shares[1], F.lit(0.0))

    both = hist.join(fitted, ["spec", "left_out"]).groupBy("spec", "left_out")
    return both.agg(error(~F.col("evaluation") & ~F.col("held")).alias("development"), error(F.col("evaluation")).alias("evaluation"), error(F.col("held"), True).alias("held"))


def run(rows: DataFrame, specs: list[Spec], measures: list[str], weight: str | None = None) -> DataFrame:
    """A row a configuration: thresholds, balanced errors, conformance, the range of medium and the worst held-out error over left-out folds, the mean error of its neighbourhood, whether it is admissible, and its rank among those of fewest constants (1 is selected).

    Conforming configurations have rising thresholds, a high that can be reached
    and that no group alone, nor randomness and lexical together, reaches.
    """
    spark = rows.sparkSession
    counted = written(cells(rows, measures, weight), "cells")  # rows are read once, and later plans begin here
    hist = written(histograms(counted, specs, measures), "histograms")
    fitted = written(thresholds(hist, specs), "thresholds")
    errors = written(balanced_errors(hist, fitted).join(fitted, ["spec", "left_out"]), "errors")
    full = errors.where(F.col("left_out") == ALL).select("spec", "low", "medium", "high", F.col("development").alias("error"), F.col("evaluation").alias("evaluation_error"))
    out = errors.where(F.col("left_out") != ALL).groupBy("spec").agg(F.min("medium").alias("medium_from"), F.max("medium").alias("medium_to"), F.min("high").alias("high_from"), F.max("high").alias("high_to"), F.coalesce(F.max("held"), F.lit(0.0)).alias("worst_held"))
    names = spark.createDataFrame([(i, s.name, s.r, s.l, s.c, s.most, s.parameters) for i, s in enumerate(specs)], "spec int, name string, r int, l int, c int, most int, parameters int")
    place = {s: i for i, s in enumerate(specs)}
    around = spark.createDataFrame([(i, place[o]) for i, s in enumerate(specs) for o in [s, *neighbours(s, specs)]], "spec int, other int")
    hood = around.join(full.select(F.col("spec").alias("other"), "error"), "other").groupBy("spec").agg(F.avg("error").alias("neighbourhood"))
    all_ = full.join(names, "spec").join(out, "spec", "left").join(hood, "spec")
    conforms = (F.col("low") >= 1) & (F.col("low") < F.col("medium")) & (F.col("medium") < F.col("high")) & (F.col("high") <= F.col("most")) & (F.col("r") + F.col("l") < F.col("high")) & (F.col("c") < F.col("high"))
    whole = Window.partitionBy()  # a row a configuration
    judged = all_.withColumn("conforms", conforms).withColumn("best", F.min(F.when(F.col("conforms"), F.col("neighbourhood"))).over(whole))
    judged = judged.withColumn("admissible", F.coalesce(F.col("conforms") & (F.col("neighbourhood") <= F.col("best") + TOLERANCE), F.lit(False)))
    judged = judged.withColumn("fewest", F.min(F.when(F.col("admissible"), F.col("parameters"))).over(whole)).withColumn("ranked", F.col("admissible") & (F.col("parameters") == F.col("fewest")))
    order = [F.desc("ranked"), F.col("medium_to") - F.col("medium_from"), F.round("neighbourhood", 9), F.round(F.abs(F.col("error") - F.col("evaluation_error")), 9), "name"]
    judged = judged.withColumn("rank", F.when(F.col("ranked"), F.row_number().over(Window.orderBy(*order))))
    return judged.select("name", "low", "medium", "high", "error", "evaluation_error", "neighbourhood", "conforms", "admissible", "parameters", "medium_from", "medium_to", "high_from", "high_to", "worst_held", "rank")
