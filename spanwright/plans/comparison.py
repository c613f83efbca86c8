"""Queries that compare runs: factorial effects, review-state moves, job minutes, retention, noise, capped scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanwright.operators import calibration, scoring
from spanwright.sources import fixtures as fx

from .base import base
from .evaluation import add
from .measurement import Inputs

_CELL = "SELECT doc_id, family, s, max((outcome IN ('PARTIAL', 'MISS'))::INTEGER) FILTER (scanner = 'cut') AS cut, max((outcome IN ('PARTIAL', 'MISS'))::INTEGER) FILTER (scanner = 'wide') AS wide FROM so GROUP BY 1, 2, 3"
_CELLS = f"a AS ({base(1)}{_CELL}), b AS ({base(2)}{_CELL})"


@add(f"WITH {_CELLS} SELECT family, count(*) AS spans, sum(b.cut - a.cut)::BIGINT AS version_effect, sum(a.wide - a.cut)::BIGINT AS scanner_effect, sum((b.wide - b.cut) - (a.wide - a.cut))::BIGINT AS interaction FROM a JOIN b USING (doc_id, family, s) GROUP BY 1", plain=True)
def factorial_effects(spark, sf_dir):
    """Leaks added by a version, by a scanner and by both together, over spans that all four cells measured."""

    def cells(version):
        leak = F.col("outcome").isin("PARTIAL", "MISS").cast("int")
        rows = Inputs(spark, sf_dir, version).measured.where(F.size("truth") > 0)
        each = scoring.score_documents(rows, ["cut", "wide"])
        s = each.select("scanner", "doc_id", F.explode_outer("scored").alias("s")).select("scanner", "doc_id", "s.family", "s.start", "s.outcome").where(F.col("scanner").isin("cut", "wide"))
        pick = lambda name: F.max(F.when(F.col("scanner") == name, leak)).alias(f"{name}{version}")
        return s.groupBy("doc_id", "family", "start").agg(pick("cut"), pick("wide"))

    x = cells(1).join(cells(2), ["doc_id", "family", "start"])
    one = F.col("wide1") - F.col("cut1")
    two = F.col("wide2") - F.col("cut2")
    return x.groupBy("family").agg(F.count("*").alias("spans"), F.sum(F.col("cut2") - F.col("cut1")).alias("version_effect"), F.sum(one).alias("scanner_effect"), F.sum(two - one).alias("interaction"))


@add("WITH t AS (SELECT o_custkey % 100 AS stratum, o_orderkey % 17 = 0 AS before, o_orderkey % 19 = 0 AS after FROM orders) SELECT stratum::BIGINT AS stratum, count(*) FILTER (before AND NOT after) AS reviewed, count(*) FILTER (after AND NOT before) AS reopened, count(*) FILTER (before AND after) AS waiting FROM t GROUP BY 1", plain=True)
def review_state_effect(spark, sf_dir):
    """Cases that left or entered the unassessed state between two snapshots."""
    o = fx.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).cast("long").alias("stratum"), (F.col("o_orderkey") % 17 == 0).alias("b"), (F.col("o_orderkey") % 19 == 0).alias("a"))
    n = lambda c, name: F.count_if(c).alias(name)
    b, a = F.col("b"), F.col("a")
    return o.groupBy("stratum").agg(n(b & ~a, "reviewed"), n(a & ~b, "reopened"), n(b & a, "waiting"))


@add("WITH j AS (SELECT l_linestatus AS job, datediff('day', o_orderdate, l_shipdate) * 37 AS seconds FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT job, count(*) AS runs, sum(seconds)::BIGINT AS seconds, sum(ceil(seconds / 60.0))::BIGINT AS minutes FROM j GROUP BY 1", plain=True)
def job_minutes(spark, sf_dir):
    """Billed minutes: every run is rounded up by itself, then summed."""
    both = fx.table(spark, sf_dir, "lineitem").join(fx.table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    j = both.select(F.col("l_linestatus").alias("job"), (F.datediff("l_shipdate", "o_orderdate") * 37).alias("seconds"))
    return j.groupBy("job").agg(F.count("*").alias("runs"), F.sum("seconds").alias("seconds"), F.sum(F.ceil(F.col("seconds") / 60)).alias("minutes"))


_KEPT = "WITH v AS (SELECT ps AS part, id, row_number() OVER (PARTITION BY ps ORDER BY id DESC) AS age FROM (SELECT l_partkey AS ps, l_orderkey AS id FROM lineitem GROUP BY 1, 2))"


@add(_KEPT + " SELECT part, id FROM v WHERE age > 2 AND id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')", plain=True)
def retention_plan(spark, sf_dir):
    """Bundles to delete: all present but the current, the previous and those still live."""
    x = fx.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_orderkey").alias("id")).distinct()
    age = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("id")))
    live = fx.table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("id"))
    return x.withColumn("age", age).where("age > 2").join(live, "id", "left_anti").select("part", "id")


@add("WITH s AS (SELECT event_type, user_id % 10 AS run, quantile_disc(value, 0.5) AS m FROM events GROUP BY 1, 2) SELECT event_type, round((max(m) - min(m)) / min(m), 6) AS spread, max_by(run, m)::BIGINT AS slowest, greatest(0.05, ceil(20 * 2 * (max(m) / min(m) - 1)) / 20) AS trigger FROM s GROUP BY 1", plain=True)
def noise_triggers(spark, sf_dir):
    """Spread of medians between runs, and the trigger of twice that noise in steps of five percent."""
    e = fx.table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 10).cast("long").alias("run"), "value")
    s = calibration.quantiles(e, ["event_type", "run"], "value", [0.5]).select("event_type", "run", F.get("quantiles", F.lit(0)).alias("m"))
    most, least = F.max("m"), F.min("m")
    trigger = F.greatest(F.lit(0.05), F.ceil(20 * 2 * (most / least - 1)) / 20)
    return s.groupBy("event_type").agg(F.round((most - least) / least, 6).alias("spread"), F.max_by("run", "m").alias("slowest"), trigger.alias("trigger"))


@add("WITH p AS (SELECT p_partkey AS id, least(60, greatest(0, (p_size - 5) * 60 // 45)) AS a, least(40, floor(p_retailprice)::INTEGER % 50) AS b, p_partkey % 30 AS c FROM part) SELECT id, greatest(a, b, c) + (a + b + c - greatest(a, b, c) - least(a, b, c)) // 2 + least(a, b, c) // 4 AS total, least(100, greatest(a, b, c) + (a + b + c - greatest(a, b, c) - least(a, b, c)) // 2 + least(a, b, c) // 4) AS score FROM p", plain=True)
def halving_scores(spark, sf_dir):
    """Contributions of a group, each further one counting half of the one before, up to a cap."""
    p = fx.table(spark, sf_dir, "part")
    ramp = F.expr("least(60, greatest(0, (p_size - 5) * 60 div 45))").cast("long")
    parts = F.array(ramp, F.least(F.lit(40), F.expr("cast(floor(p_retailprice) as int)") % 50).cast("long"), (F.col("p_partkey") % 30).cast("long"))
    halved = F.transform(F.reverse(F.array_sort(parts)), lambda x, i: F.call_function("shiftright", x, i))
    total = F.aggregate(halved, F.lit(0).cast("long"), lambda a, x: a + x)
    return p.select(F.col("p_partkey").alias("id"), total.alias("total"), F.least(F.lit(100).cast("long"), total).alias("score"))
