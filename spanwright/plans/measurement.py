"""Scoring queries over the derived measurement tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanwright.functions import lattice, ranges, stats, text, validators
from spanwright.operators import calibration, scoring
from spanwright.sources import fixtures as fx

from .base import base, wilson_sql

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None, version: int = 1, plain: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql if plain else base(version) + sql
        return f

    return add


class Inputs:
    """The measurement tables of one session and folder; ``rows`` and ``spans`` are scored in the documents' rows, without a shuffle."""

    def __init__(self, spark: SparkSession, sf_dir: str, version: int = 1):
        self.docs = fx.documents(spark, sf_dir)
        self.measured = fx.measured(self.docs, version)
        self.truth = self.measured.select("doc_id", "bytes", F.explode("truth").alias("x")).select("doc_id", "x.*", "bytes")
        self.fixtures = self.measured.select("doc_id", "source", "kind", "tier", "bytes")
        self.findings = self.measured.select("doc_id", F.explode("found").alias("f")).select("f.scanner", "doc_id", "f.family", "f.start", "f.end", "f.action")
        self.scanners = spark.createDataFrame([(s,) for s in fx.SCANNERS], "scanner string")

    def scored(self) -> DataFrame:
        return scoring.score_documents(self.measured, fx.SCANNERS)

    def spans(self) -> DataFrame:
        """scanner, doc_id, source, kind, tier, family, start, end, env_start, env_end, outcome, leaked_bytes."""
        return self.scored().select("scanner", "doc_id", "source", "kind", "tier", F.explode("scored").alias("s")).select("scanner", "doc_id", "source", "kind", "tier", "s.*")

    def rows(self) -> DataFrame:
        return scoring.row_counts(self.scored()).drop("truth", "found", "scored", "text")


def long(c) -> F.Column:
    return F.col(c).cast("long") if isinstance(c, str) else c.cast("long")


@query("SELECT doc_id, family, s AS start, e AS \"end\", coalesce(es, s) AS env_start, coalesce(ee, e) AS env_end FROM truth")
def span_truth_extract(spark, sf_dir):
    return Inputs(spark, sf_dir).truth.select("doc_id", "family", "start", "end", F.coalesce("env_start", "start").alias("env_start"), F.coalesce("env_end", "end").alias("env_end"))


@query("SELECT scanner, doc_id, family, s AS start, e AS \"end\", outcome, leaked_bytes FROM so")
def span_outcome_lattice(spark, sf_dir):
    return Inputs(spark, sf_dir).spans().select("scanner", "doc_id", "family", "start", "end", "outcome", "leaked_bytes")


@query("SELECT scanner, family, outcome, count(*) AS spans FROM so GROUP BY 1, 2, 3")
def span_outcome_histogram(spark, sf_dir):
    return Inputs(spark, sf_dir).spans().groupBy("scanner", "family", "outcome").agg(F.count("*").alias("spans"))


@query("SELECT scanner, doc_id, kind, tier, leaked_spans, leaked_bytes, collateral_bytes, findings, flagged FROM rows")
def row_leaked_collateral(spark, sf_dir):
    return Inputs(spark, sf_dir).rows().select("scanner", "doc_id", "kind", "tier", long("leaked_spans").alias("leaked_spans"), "leaked_bytes", "collateral_bytes", "findings", "flagged")


@query("SELECT scanner, doc_id, s AS start, e AS \"end\" FROM isl")
def interval_union(spark, sf_dir):
    merged = Inputs(spark, sf_dir).scored().select("scanner", "doc_id", F.explode("merged").alias("r"))
    return merged.select("scanner", "doc_id", "r.start", "r.end")


@query(", iso AS (SELECT *, sum((pm IS NULL OR s >= pm)::INTEGER) OVER (PARTITION BY scanner, doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS h FROM isl0) SELECT scanner, doc_id, min(s) AS start, max(e) AS \"end\" FROM iso GROUP BY scanner, doc_id, h")
def interval_union_strict(spark, sf_dir):
    return ranges.union(Inputs(spark, sf_dir).findings, ["scanner", "doc_id"], touching=False)


@query("SELECT scanner, doc_id, outside FROM outb WHERE doc_id IN (SELECT doc_id FROM truth)")
def bytes_outside(spark, sf_dir):
    rows = Inputs(spark, sf_dir).scored().where((F.size("truth") > 0) & (F.size("merged") > 0))
    return rows.select("scanner", "doc_id", F.col("collateral_bytes").alias("outside"))


_DIAGNOSED = """, ex AS (SELECT scanner, doc_id, count(*) FILTER (outcome = 'EXACT') AS tp, count(*) AS spans, string_agg(outcome, ',' ORDER BY s, e, family) AS code FROM so GROUP BY 1, 2),
fd AS (SELECT DISTINCT scanner, doc_id, s, e FROM fnd), fp AS (SELECT fd.scanner, fd.doc_id, count(*) AS n, count(*) FILTER (t.doc_id IS NULL) AS fp FROM fd LEFT JOIN (SELECT DISTINCT doc_id, s, e FROM truth) t USING (doc_id, s, e) GROUP BY 1, 2),
cl0 AS (SELECT scanner, doc_id, s, e FROM al UNION ALL SELECT scanner, doc_id, s, e FROM lic CROSS JOIN sc), cl1 AS (SELECT *, max(e) OVER (PARTITION BY scanner, doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM cl0),
cl2 AS (SELECT *, sum((pm IS NULL OR s > pm)::INTEGER) OVER (PARTITION BY scanner, doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM cl1), cl AS (SELECT scanner, doc_id, min(s) AS s, max(e) AS e FROM cl2 GROUP BY scanner, doc_id, g),
ci AS (SELECT i.scanner, i.doc_id, sum(least(i.e, c.e) - greatest(i.s, c.s)) AS b FROM isl i JOIN cl c ON c.scanner = i.scanner AND c.doc_id = i.doc_id AND i.s < c.e AND c.s < i.e GROUP BY 1, 2), ct AS (SELECT scanner, doc_id, sum(e - s) AS b FROM isl GROUP BY 1, 2)
SELECT sc.scanner, fx.doc_id, (coalesce(ct.b, 0) - coalesce(ci.b, 0))::BIGINT AS collateral_bytes, coalesce(ex.tp, 0) AS tp, coalesce(fp.fp, 0) AS fp, coalesce(ex.spans - ex.tp, 0) AS fn, CASE WHEN ex.spans IS NULL AND fp.n IS NULL THEN 1 ELSE 0 END AS tn,
CASE WHEN tier = 'T0' THEN 'observed:' || coalesce(fp.n, 0) WHEN ex.spans IS NOT NULL THEN ex.code WHEN fp.n IS NULL THEN 'clean' ELSE 'flagged:' || fp.n END AS code
FROM fx CROSS JOIN sc LEFT JOIN ex ON ex.scanner = sc.scanner AND ex.doc_id = fx.doc_id LEFT JOIN fp ON fp.scanner = sc.scanner AND fp.doc_id = fx.doc_id LEFT JOIN ct ON ct.scanner = sc.scanner AND ct.doc_id = fx.doc_id LEFT JOIN ci ON ci.scanner = sc.scanner AND ci.doc_id = fx.doc_id"""


@query(_DIAGNOSED)
def row_diagnostics(spark, sf_dir):
    """Exact matches, codes and collateral bytes of every row, where licence words are companions."""
    rows = Inputs(spark, sf_dir).measured
    rows = rows.withColumn("companions", F.coalesce(ranges.match_ranges(F.col("text"), fx.LICENCE), F.array().cast("array<struct<start:int,end:int>>")))
    each = scoring.diagnostics(scoring.score_documents(rows, fx.SCANNERS, "companions"))
    return each.select("scanner", "doc_id", "collateral_bytes", "tp", "fp", "fn", "tn", "code")


@query("SELECT scanner, doc_id, s AS start, e AS \"end\", count(*) AS reported, max(family) AS family FROM fnd GROUP BY 1, 2, 3, 4")
def finding_dedup(spark, sf_dir):
    return Inputs(spark, sf_dir).findings.groupBy("scanner", "doc_id", "start", "end").agg(F.count("*").alias("reported"), F.max("family").alias("family"))


@query("SELECT scanner, tier, count(*) AS files, sum(flagged::INTEGER)::BIGINT AS flagged, sum(findings)::BIGINT AS findings FROM rows WHERE kind = 'must-not-flag' AND tier <> 'T0' GROUP BY 1, 2")
def control_flagging(spark, sf_dir):
    rows = Inputs(spark, sf_dir).rows().where("kind = 'must-not-flag' AND tier <> 'T0'")
    return rows.groupBy("scanner", "tier").agg(F.count("*").alias("files"), F.sum(F.col("flagged").cast("int")).alias("flagged"), F.sum("findings").alias("findings"))


@query("SELECT * FROM grp")
def group_metrics_v10(spark, sf_dir):
    return scoring.groups(Inputs(spark, sf_dir).rows())


_OPEN = "(files::DOUBLE / (files + pending) >= CASE WHEN kind = 'must-redact' THEN 0.7 ELSE 0.0 END)"
_ACCOUNT = f""", pend AS (SELECT scanner, kind, files AS pending FROM grp WHERE tier = 'T0'),
g AS (SELECT grp.*, coalesce(pend.pending, 0) AS pending FROM grp LEFT JOIN pend ON pend.scanner = grp.scanner AND pend.kind = grp.kind WHERE grp.tier <> 'T0')
SELECT scanner, kind, tier, files, pending, spans, leaked_spans, flagged_files, round(files::DOUBLE / (files + pending), 6) AS measurable_share,
CASE WHEN NOT {_OPEN} THEN 'insufficient-evidence' WHEN (CASE WHEN kind = 'must-not-flag' THEN files ELSE spans END) = 0 THEN 'none' WHEN (CASE WHEN kind = 'must-not-flag' THEN files ELSE spans END) < 5 THEN 'insufficient-evidence' ELSE 'measured' END AS status,
CASE WHEN kind <> 'must-not-flag' AND {_OPEN} AND spans >= 5 THEN round(leaked_spans::DOUBLE / spans, 6) END AS leak_rate,
CASE WHEN kind <> 'must-not-flag' AND {_OPEN} AND spans >= 5 THEN {wilson_sql('leaked_spans', 'spans', True)} END AS leak_bound,
CASE WHEN kind <> 'must-not-flag' AND {_OPEN} AND spans >= 5 THEN round(leaked_bytes::DOUBLE / secret_bytes, 6) END AS leaked_byte_rate,
CASE WHEN kind <> 'must-not-flag' AND {_OPEN} AND spans >= 5 THEN round(collateral_bytes::DOUBLE / secret_bytes, 6) END AS collateral_ratio,
CASE WHEN kind = 'must-not-flag' AND {_OPEN} AND files >= 5 THEN round(flagged_files::DOUBLE / files, 6) END AS alarm_rate,
CASE WHEN kind = 'must-not-flag' AND {_OPEN} AND files >= 5 THEN {wilson_sql('flagged_files', 'files', True)} END AS alarm_bound FROM g"""


@query(_ACCOUNT)
def group_accounting_v11(spark, sf_dir):
    return scoring.account(scoring.groups(Inputs(spark, sf_dir).rows()))


@query(f"SELECT k::BIGINT AS k, n::BIGINT AS n, {wilson_sql('k', 'n', True)} AS upper, {wilson_sql('k', 'n', False)} AS lower FROM (SELECT l_linenumber AS k, l_linenumber + (l_orderkey % 50) AS n FROM lineitem GROUP BY 1, 2)", plain=True)
def wilson_bounds(spark, sf_dir):
    x = fx.table(spark, sf_dir, "lineitem").select(long("l_linenumber").alias("k"), (F.col("l_linenumber") + F.col("l_orderkey") % 50).alias("n")).distinct()
    return x.select("k", "n", stats.wilson(F.col("k"), F.col("n"), True).alias("upper"), stats.wilson(F.col("k"), F.col("n"), False).alias("lower"))


@query("SELECT scanner, family, kind, sum(CASE WHEN outcome IN ('PARTIAL', 'MISS') THEN 1 ELSE 0 END)::BIGINT AS leaked, count(*) AS spans FROM so JOIN fx USING (doc_id) WHERE tier <> 'T0' GROUP BY 1, 2, 3")
def run_summary_by_detector(spark, sf_dir):
    rows = Inputs(spark, sf_dir).spans().where("tier <> 'T0'")
    return rows.groupBy("scanner", "family", "kind").agg(F.sum(F.col("outcome").isin(scoring.LEAKED).cast("int")).alias("leaked"), F.count("*").alias("spans"))


@query("SELECT scanner, kind, count(*) AS files, sum(spans)::BIGINT AS spans, sum(leaked_spans)::BIGINT AS leaked_spans, sum(flagged::INTEGER)::BIGINT AS flagged FROM rows WHERE tier <> 'T0' GROUP BY 1, 2")
def run_summary_overall(spark, sf_dir):
    rows = Inputs(spark, sf_dir).rows().where("tier <> 'T0'")
    return rows.groupBy("scanner", "kind").agg(F.count("*").alias("files"), F.sum("spans").alias("spans"), F.sum("leaked_spans").alias("leaked_spans"), F.sum(F.col("flagged").cast("int")).alias("flagged"))


_TALLY = "FROM so JOIN fx USING (doc_id) GROUP BY GROUPING SETS ((scanner, outcome), (scanner, family, outcome), (scanner, source, outcome), (scanner, tier, outcome))"


@query(f"SELECT scanner, family, source, tier, outcome, count(*) AS spans, grouping(family, source, tier)::BIGINT AS level {_TALLY}")
def method_summaries_grouping_sets(spark, sf_dir):
    rows = Inputs(spark, sf_dir).spans()
    sets = [["scanner", "outcome"], ["scanner", "family", "outcome"], ["scanner", "source", "outcome"], ["scanner", "tier", "outcome"]]
    grouped = rows.groupingSets([[F.col(c) for c in s] for s in sets], "scanner", "family", "source", "tier", "outcome")
    level = F.grouping("family").cast("long") * 4 + F.grouping("source").cast("long") * 2 + F.grouping("tier").cast("long")
    return grouped.agg(F.count("*").alias("spans"), level.alias("level"))


@query("SELECT source, family, tier, count(*) AS spans FROM truth JOIN fx USING (doc_id) GROUP BY ROLLUP (source, family, tier)")
def family_tally_rollup(spark, sf_dir):
    rows = Inputs(spark, sf_dir).measured.select("source", "tier", F.explode("truth.family").alias("family"))
    return rows.rollup("source", "family", "tier").agg(F.count("*").alias("spans"))


_PAIR = ", p AS (SELECT a.doc_id, a.kind, a.tier, b.scanner AS peer, CASE WHEN a.kind = 'must-not-flag' THEN a.flagged ELSE a.leaked_spans > 0 END AS ours, CASE WHEN a.kind = 'must-not-flag' THEN b.flagged ELSE b.leaked_spans > 0 END AS theirs FROM rows a JOIN rows b ON a.doc_id = b.doc_id AND a.scanner = 'exact' AND b.scanner <> 'exact')"


def _pairs(spark, sf_dir):
    """Each peer's result on a document beside that of ``exact``, from one row a document."""
    bad = F.when(F.col("kind") == "must-not-flag", F.col("flagged")).otherwise(F.col("leaked_spans") > 0)
    measured = Inputs(spark, sf_dir).measured
    judged = lambda rows, scanners: scoring.row_counts(scoring.score_documents(rows, scanners))
    ours = judged(measured, ["exact"]).select(*measured.columns, bad.alias("ours"))
    return judged(ours, [x for x in fx.SCANNERS if x != "exact"]).select("doc_id", "kind", "tier", "ours", F.col("scanner").alias("peer"), bad.alias("theirs"))


@query(_PAIR + " SELECT peer, kind, tier, count(*) FILTER (NOT ours AND NOT theirs) AS both_good, count(*) FILTER (ours AND NOT theirs) AS only_ours_bad, count(*) FILTER (NOT ours AND theirs) AS only_theirs_bad, count(*) FILTER (ours AND theirs) AS both_bad FROM p WHERE tier <> 'T0' GROUP BY 1, 2, 3")
def pair_model_cells(spark, sf_dir):
    n = lambda c: F.sum(c.cast("int")).alias
    o, t = F.col("ours"), F.col("theirs")
    return _pairs(spark, sf_dir).where("tier <> 'T0'").groupBy("peer", "kind", "tier").agg(n(~o & ~t)("both_good"), n(o & ~t)("only_ours_bad"), n(~o & t)("only_theirs_bad"), n(o & t)("both_bad"))


@query(_PAIR + " SELECT peer, doc_id, kind, CASE WHEN ours THEN 'peer-better' ELSE 'peer-worse' END AS direction FROM p WHERE ours <> theirs AND tier <> 'T0'")
def pair_differences(spark, sf_dir):
    rows = _pairs(spark, sf_dir).where("ours <> theirs AND tier <> 'T0'")
    return rows.select("peer", "doc_id", "kind", F.when(F.col("ours"), "peer-better").otherwise("peer-worse").alias("direction"))


@query(", d AS (SELECT doc_id, bit_or(CASE WHEN scanner = 'exact' THEN 1 ELSE 0 END)::INTEGER AS a, count(DISTINCT scanner) AS tools, list_sort(list(DISTINCT scanner)) AS names FROM fnd GROUP BY doc_id) SELECT doc_id, tools, array_to_string(names, ',') AS names, CASE WHEN a = 0 THEN 'peer-only' WHEN tools = 1 THEN 'product-only' ELSE 'both' END AS class FROM d")
def differential_disagreements(spark, sf_dir):
    names = F.array_sort(F.array_distinct(F.transform("found", lambda f: f["scanner"])))
    per = Inputs(spark, sf_dir).measured.select("doc_id", names.alias("names")).where(F.size("names") > 0)
    state = F.when(~F.array_contains("names", "exact"), "peer-only").when(F.size("names") == 1, "product-only").otherwise("both")
    return per.select("doc_id", F.size("names").cast("long").alias("tools"), F.array_join("names", ",").alias("names"), state.alias("class"))


_FLAGS = "(CASE WHEN leaked_spans > 0 THEN 1 ELSE 0 END + CASE WHEN flagged THEN 2 ELSE 0 END + CASE WHEN overbroad > 0 THEN 4 ELSE 0 END)"


@query(f", q AS (SELECT scanner, doc_id, {_FLAGS}::INTEGER AS flags FROM rows), n AS (SELECT *, row_number() OVER (PARTITION BY scanner ORDER BY flags DESC, doc_id)::INTEGER AS place FROM q WHERE flags > 0) SELECT scanner, doc_id, flags, place FROM n WHERE place BETWEEN 51 AND 100 OR place <= 50 AND flags > 0")
def rows_filter_page(spark, sf_dir):
    """The first two pages of 50 rows that need a look, most flags first."""
    rows = Inputs(spark, sf_dir).rows()
    flags = F.when(F.col("leaked_spans") > 0, 1).otherwise(0) + F.when(F.col("flagged"), 2).otherwise(0) + F.when(F.col("overbroad") > 0, 4).otherwise(0)
    place = F.row_number().over(Window.partitionBy("scanner").orderBy(F.desc("flags"), "doc_id"))
    return rows.select("scanner", "doc_id", flags.alias("flags")).where("flags > 0").withColumn("place", place).where("place <= 100")


def _outcome_sql(v):
    return base(v) + "SELECT doc_id, family, s, e, outcome FROM so WHERE scanner = 'cut'"


_RANK = "CASE {} WHEN 'EXACT' THEN 4 WHEN 'COVERED' THEN 3 WHEN 'OVERBROAD' THEN 2 WHEN 'PARTIAL' THEN 1 WHEN 'MISS' THEN 0 END"


@query(f"SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.family, b.family) AS family, coalesce(a.s, b.s) AS start, a.outcome AS before, b.outcome AS after, CASE WHEN a.outcome IS NULL THEN 'added' WHEN b.outcome IS NULL THEN 'removed' WHEN a.outcome = b.outcome THEN 'same' WHEN {_RANK.format('b.outcome')} > {_RANK.format('a.outcome')} THEN 'fixed' ELSE 'worse' END AS verdict FROM ({_outcome_sql(1)}) a FULL JOIN ({_outcome_sql(2)}) b ON a.doc_id = b.doc_id AND a.family = b.family AND a.s = b.s", plain=True)
def candidate_verdicts(spark, sf_dir):
    rank = lambda c: F.array_position(F.array(*map(F.lit, lattice.OUTCOMES)), F.col(c))
    one = lambda rows, found, name: rows.withColumn("found", found).transform(lambda d: scoring.score_documents(d, ["cut"])).withColumnRenamed("scored", name).drop("scanner", "own", "merged", "collateral_bytes")
    rows = Inputs(spark, sf_dir).measured
    again = fx.reported(F.col("text"), F.col("doc_id"), F.col("truth"), 2)
    rows = one(one(rows, F.col("found"), "first"), again, "second")
    tagged = lambda c, k: F.transform(c, lambda s: F.struct(F.lit(k).alias("version"), s["family"].alias("family"), s["start"].alias("start"), s["outcome"].alias("outcome")))
    each = rows.select("doc_id", F.explode(F.concat(tagged("first", 1), tagged("second", 2))).alias("s")).select("doc_id", "s.*")
    of = lambda k, name: F.max(F.when(F.col("version") == k, F.col("outcome"))).alias(name)
    both = each.groupBy("doc_id", "family", "start").agg(of(1, "before"), of(2, "after"))
    verdict = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") == F.col("after"), "same").when(rank("after") > rank("before"), "fixed").otherwise("worse")
    return both.withColumn("verdict", verdict)


_MASK = "lower(text)"
for _pattern, _mark in text.NORMAL_FORM:
    _MASK = f"regexp_replace({_MASK}, '{_pattern}', '{_mark}', 'g')"


@query(f"SELECT sha256({_MASK}) AS shape, count(*) AS documents, min(doc_id) AS first, count(DISTINCT source) AS sources FROM documents GROUP BY 1 HAVING count(*) > 1", plain=True)
def duplicate_clusters(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(text.normalize_values(F.col("text")), 256).alias("shape"))
    return d.groupBy("shape").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first"), F.count_distinct("source").alias("sources")).where("documents > 1")


@query("SELECT doc_id, family, s AS start, sha256(CASE WHEN length(ln) > 64 THEN right(ln, 64) ELSE ln END) AS line FROM (SELECT t.*, regexp_extract(decode(encode(text)[1:s]), '[^\\n]*$') AS ln FROM truth t JOIN docs USING (doc_id))")
def line_context(spark, sf_dir):
    x = Inputs(spark, sf_dir).measured.select("doc_id", "text", F.explode("truth").alias("x")).select("doc_id", "text", "x.*")
    return x.select("doc_id", "family", "start", F.sha2(text.line_before(F.col("text"), F.col("start")), 256).alias("line"))


@query("""SELECT n::BIGINT AS n, CASE WHEN NOT regexp_full_match(v, '[0-9]{2,19}') THEN 'malformed' WHEN list_sum(list_transform(range(1, length(v) + 1), lambda i: CASE WHEN (length(v) - i) % 2 = 0 THEN v[i]::INTEGER WHEN v[i]::INTEGER > 4 THEN v[i]::INTEGER * 2 - 9 ELSE v[i]::INTEGER * 2 END)) % 10 = 0 THEN 'valid' ELSE 'checksum' END AS luhn,
CASE WHEN NOT regexp_full_match(v9, '[0-9]{9}') THEN 'malformed' WHEN v9[1:3] IN ('000', '666') OR v9[1] = '9' OR v9[4:5] = '00' OR v9[6:9] = '0000' THEN 'unallocated' ELSE 'valid' END AS ssn,
CASE WHEN v[1] = '4' THEN 'visa' WHEN v[1:2]::INTEGER BETWEEN 51 AND 55 THEN 'mastercard' WHEN v[1:2]::INTEGER IN (34, 37) THEN 'amex' ELSE 'other' END AS brand
FROM (SELECT o_orderkey AS n, (o_orderkey * 7919 + 1000000007)::VARCHAR AS v, lpad((o_orderkey * 104729 % 1000000000)::VARCHAR, 9, '0') AS v9 FROM orders)""", plain=True)
def luhn_ssn_card(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("n"), (F.col("o_orderkey") * 7919 + 1000000007).cast("string").alias("v"), F.lpad((F.col("o_orderkey") * 104729 % 1000000000).cast("string"), 9, "0").alias("v9"))
    return o.select("n", validators.luhn(F.col("v")).alias("luhn"), validators.ssn(F.col("v9")).alias("ssn"), validators.card_brand(F.col("v")).alias("brand"))


@query("SELECT event_type, quantile_disc(value, 0.5) AS median, quantile_disc(value, 0.95) AS p95, count(*) AS n FROM events GROUP BY 1", plain=True)
def nearest_rank_percentiles(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events")
    found = calibration.quantiles(e, ["event_type"], "value", [0.5, 0.95])
    return e.groupBy("event_type").agg(F.count("*").alias("n")).join(found, "event_type", "left").select("event_type", F.get("quantiles", F.lit(0)).alias("median"), F.get("quantiles", F.lit(1)).alias("p95"), "n")


@query("""WITH s AS (SELECT event_type, event_id % 2 AS side, quantile_disc(value, 0.5) AS m, quantile_disc(value, 0.95) AS p FROM events GROUP BY 1, 2)
SELECT a.event_type, round(b.m / a.m, 6) AS median_ratio, round(b.p / a.p, 6) AS p95_ratio, CASE WHEN b.m / a.m > 1.05 THEN 'regression' WHEN b.p / a.p > 1.25 THEN 'invalid-measurement' ELSE 'within-budget' END AS verdict
FROM s a JOIN s b ON a.event_type = b.event_type AND a.side = 0 AND b.side = 1""", plain=True)
def paired_ratio_verdicts(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events").select("event_type", "value", (F.col("event_id") % 2).alias("side"))
    q = calibration.quantiles(e, ["event_type", "side"], "value", [0.5, 0.95])
    one = lambda k, i: F.max(F.when(F.col("side") == k, F.get("quantiles", F.lit(i))))
    x = q.groupBy("event_type").agg(one(0, 0).alias("m0"), one(1, 0).alias("m1"), one(0, 1).alias("p0"), one(1, 1).alias("p1")).where("m0 is not null and m1 is not null")
    m, p = F.col("m1") / F.col("m0"), F.col("p1") / F.col("p0")
    return x.select("event_type", F.round(m, 6).alias("median_ratio"), F.round(p, 6).alias("p95_ratio"), F.when(m > 1.05, "regression").when(p > 1.25, "invalid-measurement").otherwise("within-budget").alias("verdict"))


@query("WITH s AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256(doc_id::VARCHAR)) AS place FROM documents) SELECT source, doc_id, place::INTEGER AS place FROM s WHERE place <= 5", plain=True)
def quota_sample(spark, sf_dir):
    """Five documents of each source in hash order."""
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.sha2(F.col("doc_id").cast("string"), 256)))
    return fx.table(spark, sf_dir, "documents").select("source", "doc_id", place.alias("place")).where("place <= 5")


@query("WITH r AS (SELECT l_shipdate < TIMESTAMP '1998-01-01' AS positive, (l_quantity::INTEGER) AS score, count(*) AS n FROM lineitem GROUP BY 1, 2), t AS (SELECT unnest(range(1, 51))::INTEGER AS threshold) SELECT threshold, sum(CASE WHEN positive AND score < threshold THEN n ELSE 0 END)::BIGINT AS leaked, sum(CASE WHEN NOT positive AND score >= threshold THEN n ELSE 0 END)::BIGINT AS alarms FROM r, t GROUP BY 1", plain=True)
def band_threshold_sweep(spark, sf_dir):
    """Leaks and alarms at each threshold, from one histogram and two running sums."""
    rows = fx.table(spark, sf_dir, "lineitem").select((F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp")).alias("positive"), F.col("l_quantity").cast("int").alias("score"))
    hist = rows.groupBy("score").agg(F.sum(F.col("positive").cast("int")).alias("p"), F.sum((~F.col("positive")).cast("int")).alias("q"))
    grid = spark.range(1, 51).select(F.col("id").cast("int").alias("threshold"))
    full = grid.join(hist, grid["threshold"] == hist["score"], "full_outer").select(F.coalesce("threshold", "score").alias("threshold"), F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("q", F.lit(0)).alias("q"))
    up = Window.orderBy("threshold").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.orderBy("threshold").rowsBetween(0, Window.unboundedFollowing)
    out = full.withColumn("leaked", F.coalesce(F.sum("p").over(up), F.lit(0))).withColumn("alarms", F.sum("q").over(down))
    return out.where("threshold between 1 and 50").select("threshold", "leaked", "alarms")


@query("WITH g AS (SELECT least(9, floor(l_discount * 100))::INTEGER AS bin, l_discount AS p, (l_returnflag = 'R')::INTEGER AS y FROM lineitem) SELECT bin, count(*) AS n, round(avg(p), 6) AS confidence, round(avg(y), 6) AS accuracy, round(avg((p - y) * (p - y)), 6) AS brier FROM g GROUP BY 1", plain=True)
def ece_brier(spark, sf_dir):
    g = fx.table(spark, sf_dir, "lineitem").select(F.least(F.lit(9), F.floor(F.col("l_discount") * 100)).cast("int").alias("bin"), F.col("l_discount").alias("p"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return g.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("confidence"), F.round(F.avg("y"), 6).alias("accuracy"), F.round(F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))), 6).alias("brier"))


@query("SELECT scanner, action, kind, count(*) AS findings, count(DISTINCT doc_id) AS files FROM fnd JOIN fx USING (doc_id) GROUP BY 1, 2, 3")
def action_split(spark, sf_dir):
    found = Inputs(spark, sf_dir).measured.select("doc_id", "kind", F.explode("found").alias("f")).select("doc_id", "kind", "f.scanner", "f.action")
    return found.groupBy("scanner", "action", "kind").agg(F.count("*").alias("findings"), F.count_distinct("doc_id").alias("files"))


@query(", c AS (SELECT source, kind, count(*) AS n FROM fx GROUP BY 1, 2), w AS (SELECT *, min(CASE WHEN n >= 5 THEN n END) OVER (PARTITION BY source) AS least, count(*) FILTER (n < 5) OVER (PARTITION BY source) AS small FROM c) SELECT source, kind, CASE WHEN n < 5 OR (small = 1 AND n = least) THEN -1 ELSE n END AS n, n < 5 OR (small = 1 AND n = least) AS suppressed FROM w")
def suppressed_strata(spark, sf_dir):
    """Counts below five are withheld (-1); if only one of a source is, its smallest other as well."""
    c = Inputs(spark, sf_dir).fixtures.groupBy("source", "kind").agg(F.count("*").alias("n"))
    w = Window.partitionBy("source")
    c = c.withColumn("least", F.min(F.when(F.col("n") >= 5, F.col("n"))).over(w)).withColumn("small", F.sum((F.col("n") < 5).cast("int")).over(w))
    hide = F.coalesce((F.col("n") < 5) | ((F.col("small") == 1) & (F.col("n") == F.col("least"))), F.lit(False))
    return c.select("source", "kind", F.when(~hide, F.col("n")).otherwise(-1).alias("n"), hide.alias("suppressed"))
