"""Queries on strata, personal-data outcomes, support status, budgets and replays."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanwright.functions import stats
from spanwright.functions import text as tx
from spanwright.operators import calibration, independence, scoring
from spanwright.sources import fixtures as fx

from .base import base, wilson_sql
from .evaluation import _VALUE, _values, add
from .measurement import Inputs

_STATUS = "WITH a AS (SELECT o_orderpriority AS method, o_orderstatus AS stratum, CASE WHEN o_totalprice > 300000 THEN 'fail' WHEN o_totalprice > 20000 THEN 'pass' WHEN o_totalprice > 8000 THEN 'review-required' ELSE 'not-measured' END AS status FROM orders) "


def _assertions(spark, sf_dir):
    price = F.col("o_totalprice")
    status = F.when(price > 300000, "fail").when(price > 20000, "pass").when(price > 8000, "review-required").otherwise("not-measured")
    return fx.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("method"), F.col("o_orderstatus").alias("stratum"), status.alias("status"))


_N = "count(*) FILTER (status IN ('pass', 'fail'))"


@add(_STATUS + f"SELECT method, stratum, count(*) AS total, {_N} AS resolved, round({_N}::DOUBLE / count(*), 6) AS resolved_rate, {wilson_sql(_N, 'count(*)', False)} AS resolved_bound FROM a GROUP BY 1, 2", plain=True)
def resolved_rate_by_stratum(spark, sf_dir):
    done = F.sum(F.col("status").isin("pass", "fail").cast("int"))
    g = _assertions(spark, sf_dir).groupBy("method", "stratum").agg(F.count("*").alias("total"), done.alias("resolved"))
    return g.select("*", F.round(F.col("resolved") / F.col("total"), 6).alias("resolved_rate"), stats.wilson(F.col("resolved"), F.col("total"), False).alias("resolved_bound"))


@add(_STATUS + f", g AS (SELECT method, stratum, count(*) AS total, {_N} AS resolved FROM a GROUP BY 1, 2) SELECT method, stratum, total, resolved FROM g WHERE resolved::DOUBLE / total < 0.985", plain=True)
def unresolved_groups(spark, sf_dir):
    done = F.sum(F.col("status").isin("pass", "fail").cast("int"))
    g = _assertions(spark, sf_dir).groupBy("method", "stratum").agg(F.count("*").alias("total"), done.alias("resolved"))
    return g.where(F.col("resolved") / F.col("total") < 0.985)


@add(_STATUS + "SELECT method, count(*) FILTER (status = 'pass') AS pass, count(*) FILTER (status = 'fail') AS fail, count(*) FILTER (status = 'review-required') AS review, count(*) FILTER (status = 'not-measured') AS not_measured FROM a GROUP BY 1", plain=True)
def assertion_tallies(spark, sf_dir):
    p = _assertions(spark, sf_dir).groupBy("method").pivot("status", ["pass", "fail", "review-required", "not-measured"]).count()
    return p.fillna(0).withColumnsRenamed({"review-required": "review", "not-measured": "not_measured"})


_DELTA = """, g AS (SELECT scanner, kind, tier, files, spans, overbroad, leaked_spans FROM grp), p AS (SELECT scanner, kind, sum(CASE WHEN tier = 'T0' THEN files ELSE 0 END)::BIGINT AS pending FROM g GROUP BY 1, 2)
SELECT g.scanner, g.kind, g.tier, array_to_string(list_filter([CASE WHEN pending > 0 AND g.kind <> 'must-not-flag' THEN 't0-share' END, CASE WHEN overbroad > 0 THEN 'overbroad-twin' END, CASE WHEN leaked_spans > 0 OR spans >= 5 THEN 'interval' END], lambda x: x IS NOT NULL), ',') AS causes FROM g JOIN p USING (scanner, kind) WHERE g.tier <> 'T0'"""


@add(_DELTA)
def accounting_delta(spark, sf_dir):
    """Why the two accounting versions can differ in a group."""
    g = scoring.groups(Inputs(spark, sf_dir).rows())
    p = g.groupBy("scanner", "kind").agg(F.sum(F.when(F.col("tier") == "T0", F.col("files")).otherwise(0)).alias("pending"))
    causes = F.array(F.when((F.col("pending") > 0) & (F.col("kind") != "must-not-flag"), "t0-share"), F.when(F.col("overbroad") > 0, "overbroad-twin"), F.when((F.col("leaked_spans") > 0) | (F.col("spans") >= 5), "interval"))
    return g.where("tier <> 'T0'").join(p, ["scanner", "kind"]).select("scanner", "kind", "tier", F.array_join(F.filter(causes, lambda c: c.isNotNull()), ",").alias("causes"))


_AXES = """, f AS (SELECT t.doc_id, t.family, t.s, sc.scanner, min(CASE WHEN f.s IS NOT NULL THEN f.s::BIGINT * 1000000 + f.e END) AS first, min_by(f.family, f.s::BIGINT * 1000000 + f.e) FILTER (f.s IS NOT NULL) AS label, t.e
FROM truth t CROSS JOIN sc LEFT JOIN fnd f ON f.scanner = sc.scanner AND f.doc_id = t.doc_id AND t.s < f.e AND f.s < t.e GROUP BY t.doc_id, t.family, t.s, t.e, sc.scanner)
SELECT scanner, doc_id, family, s AS start, CASE WHEN first IS NULL THEN 'missed' WHEN label IS NULL THEN 'unattributed' WHEN label = family THEN 'correct' ELSE 'other-type' END AS identity,
CASE WHEN first IS NULL THEN 'none' WHEN first = s::BIGINT * 1000000 + e THEN 'exact' WHEN first // 1000000 <= s AND first % 1000000 >= e THEN 'overbroad' ELSE 'partial' END AS range FROM f"""


def _axes(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    t = i.truth.select("doc_id", "family", "start", "end").crossJoin(F.broadcast(i.scanners))
    f = i.findings.select(F.col("scanner").alias("fs"), F.col("doc_id").alias("fd"), F.struct(F.col("start").alias("s"), F.col("end").alias("e"), F.col("family").alias("label")).alias("f"))
    both = t.join(f, (F.col("scanner") == F.col("fs")) & (F.col("doc_id") == F.col("fd")) & (F.col("start") < F.col("f.e")) & (F.col("f.s") < F.col("end")), "left")
    first = both.groupBy("scanner", "doc_id", "family", "start", "end").agg(F.min("f").alias("f"))
    identity = F.when(F.col("f").isNull(), "missed").when(F.col("f.label").isNull(), "unattributed").when(F.col("f.label") == F.col("family"), "correct").otherwise("other-type")
    holds = (F.col("f.s") <= F.col("start")) & (F.col("f.e") >= F.col("end"))
    equal = (F.col("f.s") == F.col("start")) & (F.col("f.e") == F.col("end"))
    span = F.when(F.col("f").isNull(), "none").when(equal, "exact").when(holds, "overbroad").otherwise("partial")
    return first.select("scanner", "doc_id", "family", "start", identity.alias("identity"), span.alias("range"))


@add(_AXES)
def pii_axis_outcomes(spark, sf_dir):
    """Identity and range of the first overlapping finding of each value."""
    return _axes(spark, sf_dir)


@add(f"{_AXES.replace('SELECT scanner, doc_id, family, s AS start, CASE', ', x AS (SELECT scanner, doc_id, family, CASE', 1)}), b AS (SELECT scanner, family, doc_id, bool_and(identity = 'correct') AS identified, bool_or(identity = 'missed') AS missed, bool_and(range = 'exact') AS exact FROM x GROUP BY 1, 2, 3) SELECT scanner, family, count(*) AS cases, count(*) FILTER (identified) AS identified, count(*) FILTER (missed) AS missed, count(*) FILTER (exact) AS exact, CASE WHEN count(*) < 4 THEN 'partial' ELSE 'measured' END AS status FROM b GROUP BY 1, 2")
def pii_metrics(spark, sf_dir):
    """Two levels: a case counts once, by all or any of its values."""
    case = _axes(spark, sf_dir).groupBy("scanner", "family", "doc_id").agg(F.bool_and(F.col("identity") == "correct").alias("identified"), F.bool_or(F.col("identity") == "missed").alias("missed"), F.bool_and(F.col("range") == "exact").alias("exact"))
    n = lambda c: F.sum(F.col(c).cast("int")).alias(c)
    return case.groupBy("scanner", "family").agg(F.count("*").alias("cases"), n("identified"), n("missed"), n("exact")).withColumn("status", F.when(F.col("cases") < 4, "partial").otherwise("measured"))


@add("WITH a AS (SELECT c_nationkey AS stratum, count(*) AS n, sum((c_acctbal < 0)::INTEGER)::BIGINT AS bad FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1), b AS (SELECT c_nationkey AS stratum, count(*) AS n, sum((c_acctbal < 0)::INTEGER)::BIGINT AS bad FROM customer WHERE c_custkey % 2 = 1 GROUP BY 1) SELECT coalesce(a.stratum, b.stratum)::BIGINT AS stratum, a.bad AS before, b.bad AS after, CASE WHEN a.n IS NULL OR b.n IS NULL THEN 'roster-differs' WHEN b.bad::DOUBLE / b.n > a.bad::DOUBLE / a.n THEN 'regression' ELSE 'no-regression' END AS verdict FROM a FULL JOIN b ON a.stratum = b.stratum", plain=True)
def strata_comparison(spark, sf_dir):
    c = fx.table(spark, sf_dir, "customer").withColumn("bad", (F.col("c_acctbal") < 0).cast("int"))
    one = lambda r, n, b: c.where(F.col("c_custkey") % 2 == r).groupBy(F.col("c_nationkey").cast("long").alias("stratum")).agg(F.count("*").alias(n), F.sum("bad").alias(b))
    both = one(0, "n0", "before").join(one(1, "n1", "after"), "stratum", "full_outer")
    verdict = F.when(F.col("n0").isNull() | F.col("n1").isNull(), "roster-differs").when(F.col("after") / F.col("n1") > F.col("before") / F.col("n0"), "regression").otherwise("no-regression")
    return both.select("stratum", "before", "after", verdict.alias("verdict"))


@add(", m AS (SELECT family, count(*) AS positives, count(DISTINCT doc_id) AS documents, count(DISTINCT source) AS axes FROM truth JOIN fx USING (doc_id) GROUP BY 1) SELECT family, positives, documents, axes, CASE WHEN positives >= 20 AND axes >= 5 THEN 'stable' WHEN positives >= 5 THEN 'provisional' ELSE 'pending' END AS status, greatest(0, 20 - positives) AS missing FROM m")
def support_status(spark, sf_dir):
    m = Inputs(spark, sf_dir).measured.select("doc_id", "source", F.explode("truth.family").alias("family")).groupBy("family").agg(F.count("*").alias("positives"), F.count_distinct("doc_id").alias("documents"), F.count_distinct("source").alias("axes"))
    status = F.when((F.col("positives") >= 20) & (F.col("axes") >= 5), "stable").when(F.col("positives") >= 5, "provisional").otherwise("pending")
    return m.select("*", status.alias("status"), F.greatest(F.lit(0).cast("long"), 20 - F.col("positives")).alias("missing"))


@add(", b AS (SELECT family, scanner, source, tier, doc_id FROM so JOIN fx USING (doc_id) WHERE outcome IN ('PARTIAL', 'MISS')) SELECT scanner, family, count(*) AS rows, count(DISTINCT doc_id) AS documents, count(DISTINCT source) AS axes, count(DISTINCT tier) AS tiers FROM b GROUP BY 1, 2")
def failure_axes(spark, sf_dir):
    b = Inputs(spark, sf_dir).spans().where(F.col("outcome").isin(scoring.LEAKED))
    return b.groupBy("scanner", "family").agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("documents"), F.count_distinct("source").alias("axes"), F.count_distinct("tier").alias("tiers"))


_UNIT = ", u AS (SELECT so.scanner, so.family, so.doc_id, so.s, so.e, coalesce(sum(least(so.e, f.e) - greatest(so.s, f.s)) FILTER (f.action = 'redact'), 0) AS gone, so.outcome FROM so LEFT JOIN fnd f ON f.scanner = so.scanner AND f.doc_id = so.doc_id AND so.s < f.e AND f.s < so.e GROUP BY so.scanner, so.family, so.doc_id, so.s, so.e, so.outcome)"


@add(_UNIT + " SELECT scanner, family, outcome <> 'MISS' AS detected, CASE WHEN gone >= e - s THEN 'removed' WHEN gone > 0 THEN 'partial-leak' ELSE 'leaked' END AS sanitized, count(*) AS spans FROM u GROUP BY 1, 2, 3, 4")
def unit_diagnostics_segments(spark, sf_dir):
    """Detection by sanitisation, in spans only (bytes that redacting findings remove)."""
    i = Inputs(spark, sf_dir)
    f = i.findings.where("action = 'redact'").select(F.col("scanner").alias("fs"), F.col("doc_id").alias("fd"), F.col("start").alias("a"), F.col("end").alias("b"))
    s = i.spans()
    both = s.join(f, (F.col("scanner") == F.col("fs")) & (F.col("doc_id") == F.col("fd")) & (F.col("start") < F.col("b")) & (F.col("a") < F.col("end")), "left")
    gone = F.sum(F.when(F.col("a").isNull(), 0).otherwise(F.least("end", "b") - F.greatest("start", "a")))
    u = both.groupBy("scanner", "family", "doc_id", "start", "end", "outcome").agg(gone.alias("gone"))
    state = F.when(F.col("gone") >= F.col("end") - F.col("start"), "removed").when(F.col("gone") > 0, "partial-leak").otherwise("leaked")
    return u.groupBy("scanner", "family", (F.col("outcome") != "MISS").alias("detected"), state.alias("sanitized")).agg(F.count("*").alias("spans"))


@add(_VALUE + ", n AS (SELECT doc_id, family, s, unnest([v[i:i + 11] for i in range(1, greatest(2, length(v) - 10))]) AS part FROM v WHERE length(v) >= 12), d AS (SELECT DISTINCT doc_id, family, s, part FROM n) SELECT part, count(*) AS places, count(DISTINCT doc_id) AS documents FROM d GROUP BY 1 HAVING count(DISTINCT doc_id) > 1")
def leak_fragment_scan(spark, sf_dir):
    """Twelve-character fragments of values that occur in several documents, by an inverted index."""
    v = _values(spark, sf_dir).where(F.length("v") >= 12)
    parts = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("v") - 11), lambda i: F.substring(F.col("v"), i, F.lit(12))))
    d = v.select("doc_id", F.explode(parts).alias("part"))
    return d.groupBy("part").agg(F.count("*").alias("places"), F.count_distinct("doc_id").alias("documents")).where("documents > 1")


_REPLAY = "SELECT scanner, {v} AS replay, sha256(concat_ws(':', scanner, doc_id, family, s, e, action)) AS h FROM fnd"


@add(f"WITH h AS (({base()}{_REPLAY.format(v=1)}) UNION ALL ({base(2)}{_REPLAY.format(v=2)})), b AS (SELECT scanner, replay, h[1:4] AS part, sha256(string_agg(h, '' ORDER BY h)) AS d FROM h GROUP BY 1, 2, 3), r AS (SELECT scanner, replay, sha256(string_agg(d, '' ORDER BY part)) AS digest FROM b GROUP BY 1, 2) SELECT scanner, count(DISTINCT digest) AS digests, CASE WHEN count(DISTINCT digest) = 1 THEN 'complete' ELSE 'unstable' END AS status FROM r GROUP BY 1", plain=True)
def replay_stability(spark, sf_dir):
    """Whether a replay with the scanners' second version, over documents in another distribution, gives a scanner's findings alike; by a digest that no order changes."""

    def replay(docs, version):
        f = fx.findings(docs, version)
        return independence.frozen_digest(f.select("scanner", F.sha2(F.concat_ws(":", "scanner", "doc_id", "family", "start", "end", "action"), 256).alias("h")), "scanner", "h")

    docs = fx.documents(spark, sf_dir)
    r = replay(docs, 1).unionByName(replay(docs.repartition(13, "doc_id"), 2))
    r = r.repartition("scanner")  # an own shuffle of a row a replay: a union of tables that are dealt alike counts as dealt by scanner even where its parts aren't
    return r.groupBy("scanner").agg(F.count_distinct("digest").alias("digests")).withColumn("status", F.when(F.col("digests") == 1, "complete").otherwise("unstable"))


@add("WITH m AS (SELECT l_returnflag AS surface, quantile_disc(l_extendedprice, 0.95) AS p95, min(l_extendedprice) AS least, max(l_extendedprice) AS most FROM lineitem GROUP BY 1) SELECT surface, p95, least, most, p95 <= 100000 AS time_ok, least >= 900 AS rate_ok, CASE WHEN p95 <= 100000 AND least >= 900 THEN 'accepted' ELSE 'rejected' END AS verdict FROM m", plain=True)
def acceptance_checks(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("surface"), "l_extendedprice")
    p95 = calibration.quantiles(rows, ["surface"], "l_extendedprice", [0.95]).select("surface", F.get("quantiles", F.lit(0)).alias("p95"))
    x = rows.groupBy("surface").agg(F.min("l_extendedprice").alias("least"), F.max("l_extendedprice").alias("most")).join(p95, "surface")
    a, b = F.col("p95") <= 100000, F.col("least") >= 900
    return x.select("surface", "p95", "least", "most", a.alias("time_ok"), b.alias("rate_ok"), F.when(a & b, "accepted").otherwise("rejected").alias("verdict"))


@add("SELECT p.p_type AS family, count(DISTINCT md5(regexp_replace(p.p_name, '[0-9]+', '<n>', 'g'))) AS shapes, count(DISTINCT p.p_name) AS names, least(count(DISTINCT md5(regexp_replace(p.p_name, '[0-9]+', '<n>', 'g'))), count(DISTINCT p.p_name)) AS upper_bound FROM part p GROUP BY 1", plain=True)
def independent_shapes(spark, sf_dir):
    p = fx.table(spark, sf_dir, "part")
    shape = F.count_distinct(F.md5(F.regexp_replace("p_name", "[0-9]+", "<n>")))
    g = p.groupBy(F.col("p_type").alias("family")).agg(shape.alias("shapes"), F.count_distinct("p_name").alias("names"))
    return g.withColumn("upper_bound", F.least("shapes", "names"))


@add(""", sp AS (SELECT doc_id, list({'s': s, 'e': e} ORDER BY s, e) AS sp FROM truth GROUP BY 1),
sk0 AS (SELECT doc_id, text, list_reduce(list_prepend({'o': '', 'n': 0, 'z': 0}, list_transform(sp, lambda x: {'o': '', 'n': x.s, 'z': x.e})), lambda a, x: CASE WHEN x.n < a.z THEN a ELSE {'o': a.o || hex(encode(text)[a.z + 1:x.n]) || hex('⟨S⟩'), 'n': 0, 'z': x.z} END) AS r FROM sp JOIN docs USING (doc_id)),
sk AS (SELECT doc_id, trim(regexp_replace(regexp_replace(decode(unhex(r.o || hex(encode(text)[r.z + 1:]))), '[A-Za-z0-9+/=_.~-]{16,}', '⟨V⟩', 'g'), '[ \t]+', ' ', 'g'), ' ') AS skeleton FROM sk0),
va AS (SELECT t.family, t.doc_id, decode(encode(text)[t.s + 1:t.e]) AS value, d.source AS axis, skeleton FROM truth t JOIN docs d USING (doc_id) JOIN sk USING (doc_id)),
fi AS (SELECT family, value, min_by(axis, doc_id) AS fa FROM va GROUP BY 1, 2), bo AS (SELECT va.*, fa FROM va JOIN fi USING (family, value)),
li AS (SELECT DISTINCT family, axis AS a, fa AS b FROM bo WHERE axis <> fa), un AS (SELECT family, a, b FROM li UNION SELECT family, b, a FROM li),
re AS (SELECT family, a AS node, list_sort(list_distinct(list_concat([a], list(b)))) AS n1 FROM un GROUP BY 1, 2),
ax AS (SELECT family, count(*) AS nodes FROM re GROUP BY 1), lo AS (SELECT family, count(*) - count(DISTINCT root) AS lost FROM (SELECT r.family, r.node, min(least(list_min(r.n1), list_min(q.n1))) AS root FROM re r JOIN re q ON q.family = r.family AND list_contains(r.n1, q.node) GROUP BY 1, 2) GROUP BY 1)
SELECT bo.family, count(DISTINCT doc_id) AS raw, count(DISTINCT value) AS distinct_values, count(DISTINCT skeleton) AS distinct_skeletons, least(count(DISTINCT value), count(DISTINCT skeleton)) AS upper_bound, count(DISTINCT axis) AS axes, count(DISTINCT axis) - coalesce(any_value(lost), 0) AS independent_axes, count(*) FILTER (axis <> fa) AS same_value_across_axes
FROM bo LEFT JOIN lo ON lo.family = bo.family GROUP BY 1""")
def independence_by_family(spark, sf_dir):
    """How many positives of each family are independent in value, skeleton and source."""
    rows = Inputs(spark, sf_dir).measured.where(F.size("truth") > 0)
    rows = rows.select("doc_id", "text", F.col("source").alias("axis"), F.sha2(independence.skeleton(F.col("text"), F.col("truth")), 256).alias("skeleton"), F.explode("truth").alias("v"))
    values = rows.select(F.col("v.family").alias("family"), "doc_id", tx.byte_slice(F.col("text"), F.col("v.start"), F.col("v.end")).alias("value"), "axis", "skeleton")
    return independence.by_family(values, spark)


@add("WITH t AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'click'), q AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'), c AS (SELECT q.event_id, max(t.ts) AS ts FROM q JOIN t ON t.user_id = q.user_id AND t.ts <= q.ts GROUP BY 1) SELECT q.event_id, c.ts AS click_ts FROM q JOIN c USING (event_id)", plain=True)
def as_of_click(spark, sf_dir):
    """Extra: the latest click of the same user at or before each error, by one sort of both streams."""
    e = fx.table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "error"))
    order = Window.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "click", 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("event_type") == "click", F.col("ts")), ignorenulls=True).over(order)
    return e.withColumn("click_ts", last).where("event_type = 'error' AND click_ts IS NOT NULL").select("event_id", "click_ts")
