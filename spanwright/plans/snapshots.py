"""Queries on stored cases, compared states, versions, schedules and bands."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanwright.operators import calibration, snapshots
from spanwright.sources import bundles, cases
from spanwright.sources import fixtures as fx
from spanwright.storage import new_path
from spanwright.streaming import chunks

from .base import base
from .evaluation import add
from .measurement import Inputs


def _stored(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    path = new_path(spark, "cases")
    cases.write_parts(cases.cases(i.docs, i.truth, i.fixtures), path)
    return path


@add('SELECT fx.doc_id, source, kind, tier, sha256(text) AS sha, family, s AS start, e AS "end" FROM fx JOIN (SELECT doc_id, text FROM docs) d USING (doc_id) LEFT JOIN truth t USING (doc_id)')
def stored_cases(spark, sf_dir):
    """Cases written as JSON lines and read again."""
    rows = cases.read_parts(spark, _stored(spark, sf_dir))
    return rows.select("doc_id", "source", "kind", "tier", F.sha2("text", 256).alias("sha"), F.explode_outer("spans").alias("x")).select("doc_id", "source", "kind", "tier", "sha", "x.family", "x.start", "x.end")


@add("SELECT count(*) AS rows, 0::BIGINT AS problems FROM fx")
def stored_parts(spark, sf_dir):
    """Rows of the parts and how many differ from the manifest."""
    path = _stored(spark, sf_dir)
    return cases.parts(spark, f"{path}/parts").agg(F.sum("rows").alias("rows")).crossJoin(cases.part_problems(spark, path).agg(F.count("*").alias("problems")))


@add("SELECT doc_id, family, ['outside', 'empty', 'outside-envelope'][doc_id % 5] AS problem FROM truth WHERE doc_id % 5 BETWEEN 1 AND 3 UNION ALL SELECT doc_id, NULL, 'repeated-id' FROM docs WHERE doc_id % 9 = 4")
def case_problems(spark, sf_dir):
    """Cases of which some break a rule, by id."""
    i = Inputs(spark, sf_dir)
    rule = F.col("doc_id") % 5
    end = F.when(rule == 1, F.col("bytes") + 9).when(rule == 2, F.col("start")).otherwise(F.col("end"))
    broken = i.truth.withColumn("end", end).withColumn("env_start", F.when(rule == 3, F.col("start") + 1).when(rule < 3, F.lit(None)).otherwise(F.col("env_start")))
    rows = cases.cases(i.docs, broken, i.fixtures)
    none = F.array().cast(cases.SPANS)
    rows = rows.withColumn("spans", F.explode(F.when(F.col("doc_id") % 9 == 4, F.array("spans", none)).otherwise(F.array("spans"))))
    return cases.case_problems(rows)


_KEPT = ["leaked_spans", "leaked_bytes", "collateral_bytes", "findings"]
_DIFF = ", ".join(f"CASE WHEN a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL AND a.{c} IS DISTINCT FROM b.{c} THEN '{c}' END" for c in _KEPT)


@add(f"WITH a AS ({base()} SELECT * FROM rows WHERE doc_id % 23 <> 0), b AS ({base(2)} SELECT * FROM rows WHERE doc_id % 19 <> 0), c AS (SELECT coalesce(a.scanner, b.scanner) AS scanner, coalesce(a.doc_id, b.doc_id) AS doc_id, a.doc_id IS NULL AS added, b.doc_id IS NULL AS removed, concat_ws(',', {_DIFF}) AS differing FROM a FULL JOIN b ON a.scanner = b.scanner AND a.doc_id = b.doc_id) SELECT scanner, doc_id, CASE WHEN added THEN 'added' WHEN removed THEN 'removed' WHEN differing <> '' THEN 'changed' ELSE 'same' END AS state, differing FROM c", plain=True)
def snapshot_contrast(spark, sf_dir):
    """Rows of two scanner versions, of which each lacks some documents."""
    before = Inputs(spark, sf_dir).rows().where("doc_id % 23 <> 0")
    after = Inputs(spark, sf_dir, 2).rows().where("doc_id % 19 <> 0")
    return snapshots.contrast(before, after, ["scanner", "doc_id"], _KEPT).withColumn("differing", F.array_join("differing", ","))


_TAIL = "CASE o_orderkey % 5 WHEN 0 THEN '-alpha.' || o_orderkey % 11 WHEN 1 THEN '-beta.' || o_orderkey % 11 ELSE '' END"


@add(f"WITH o AS (SELECT o_custkey, o_orderkey % 3 AS a, o_orderkey % 12 AS b, {_TAIL} AS t, least(o_orderkey % 5, 2) AS w, CASE WHEN o_orderkey % 5 < 2 THEN o_orderkey % 11 ELSE 0 END AS n, o_orderdate AS seen FROM orders), s AS (SELECT o_custkey, a, b, t, w, n, min(seen) AS first_seen FROM o GROUP BY ALL) SELECT o_custkey, 'v' || a || '.' || b || t AS newest, first_seen FROM s QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY a DESC, b DESC, (w + 1) % 3 DESC, n DESC) = 1", plain=True)
def newest_versions(spark, sf_dir):
    """The newest version of each customer and when it was first seen; a release comes before the words that go on from it."""
    o, k = fx.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    tail = F.when(k % 5 == 0, F.concat(F.lit("-alpha."), (k % 11).cast("string"))).when(k % 5 == 1, F.concat(F.lit("-beta."), (k % 11).cast("string"))).otherwise("")
    return snapshots.newest(o.withColumn("version", F.concat(F.lit("v"), (k % 3).cast("string"), F.lit("."), (k % 12).cast("string"), tail)), "o_custkey", "version", "o_orderdate")


@add("WITH d AS (SELECT event_type, count(DISTINCT date_trunc('day', ts)) AS n FROM events GROUP BY 1), p AS (SELECT event_type, unnest(range(2 * n)) AS place FROM d) SELECT event_type, place, place // 2 AS round, CASE WHEN place // 2 % 2 = place % 2 THEN 'baseline' ELSE 'candidate' END AS side FROM p", plain=True)
def round_schedule(spark, sf_dir):
    """A round for each day of an event type, the sides taking turns at being first."""
    days = fx.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_distinct(F.date_trunc("day", "ts")).alias("n"))
    return snapshots.round_order(days, "event_type", "n")


# Least share of spans found, by kind.
FLOORS = {"must-redact": 0.9, "policy": 0.5}


@add(f"SELECT scanner, kind, tier, point, floor, margin >= 0 AS met FROM (SELECT *, round(point - floor, 9) AS margin FROM (SELECT scanner, kind, tier, round((spans - leaked_spans)::DOUBLE / spans, 6) AS point, CASE kind {' '.join(f'WHEN {k!r} THEN {v}::DOUBLE' for k, v in FLOORS.items())} END AS floor FROM grp WHERE tier <> 'T0' AND spans > 0) WHERE floor > 0) QUALIFY row_number() OVER (PARTITION BY scanner ORDER BY margin, kind, tier) = 1")
def lowest_margins(spark, sf_dir):
    groups = Inputs(spark, sf_dir).rows().where("tier <> 'T0'").groupBy("scanner", "kind", "tier").agg(F.sum("spans").alias("spans"), F.sum("leaked_spans").alias("leaked"))
    floor = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in FLOORS.items()])
    points = groups.withColumn("point", F.round(F.try_divide(F.col("spans") - F.col("leaked"), F.col("spans")), 6)).withColumn("floor", floor)
    return snapshots.lowest_margin(points, "scanner", ["kind", "tier"], "point", "floor")


@add("WITH x AS (SELECT l_linenumber AS stratum, l_quantity::INTEGER >= 26 AS o, l_returnflag = 'R' AS p, l_linestatus = 'O' AS i, l_tax > 0 AS m FROM lineitem) SELECT stratum, count(*) AS n, round(avg(m::INTEGER), 6) AS measurable, round(count(*) FILTER (m AND p AND NOT o)::DOUBLE / count(*) FILTER (m AND p), 6) AS leak, round(count(*) FILTER (m AND NOT p AND o)::DOUBLE / count(*) FILTER (m AND NOT p), 6) AS alarm, round(count(*) FILTER (m AND NOT p AND i AND o)::DOUBLE / count(*) FILTER (m AND NOT p AND i), 6) AS independent_alarm FROM x GROUP BY 1", plain=True)
def band_outcomes(spark, sf_dir):
    """Rates at one band by stratum; rows without tax stand for those that can't be measured."""
    x = fx.table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("stratum"), F.col("l_quantity").cast("int").alias("score"), (F.col("l_returnflag") == "R").alias("positive"), (F.col("l_linestatus") == "O").alias("independent"), (F.col("l_tax") > 0).alias("measurable"))
    return calibration.band_outcomes(x, 26, "stratum")


@add("WITH c AS (SELECT l_linestatus, l_returnflag <> 'R' AS generated, count(*) AS n FROM lineitem GROUP BY 1, 2), t AS (SELECT sum(n) FILTER (generated) AS g, sum(n) FILTER (NOT generated) AS a FROM c) SELECT l_linestatus, generated, n, round(CASE WHEN NOT generated AND g > a THEN g::DOUBLE / a ELSE 1 END, 6) AS weight FROM c, t", plain=True)
def half_weights(spark, sf_dir):
    """Weights under which generated rows are no more than half of all."""
    c = fx.table(spark, sf_dir, "lineitem").groupBy("l_linestatus", (F.col("l_returnflag") != "R").alias("generated")).agg(F.count("*").alias("n"))
    return calibration.half_weights(c).withColumn("weight", F.round("weight", 6))


@add('SELECT scanner, doc_id, family, s AS start, e AS "end", action FROM fnd')
def cached_observations(spark, sf_dir):
    """Findings stored by content and read through the current bundle; storing the same rows in another order writes nothing."""
    found, root = Inputs(spark, sf_dir).findings, new_path(spark, "bundles")
    bundles.commit(spark, root, {"findings": found})
    _, wrote = bundles.commit(spark, root, {"findings": found.repartition(5)})
    if wrote:
        raise ValueError("equal rows were stored twice")
    return bundles.resolve(spark, root)["findings"]


@add('SELECT doc_id, family, s AS start, e AS "end", es AS env_start, ee AS env_end FROM truth')
def chunked_values(spark, sf_dir):
    """True values of documents that come in chunks of 97 bytes."""
    return chunks.values(chunks.cut(fx.documents(spark, sf_dir), 97))
