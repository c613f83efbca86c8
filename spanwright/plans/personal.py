"""Queries on personal-data cases: a case is a document, its occurrences are the true values; what is expected follows from ids and places."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanwright.operators import personal
from spanwright.sources import fixtures as fx

from .base import wilson_sql
from .evaluation import add
from .measurement import Inputs

METHODS = ["schema-only", "context-discrimination", "pii-benign", "jurisdiction-collision"]
_SENSITIVITY, _CLASSES = ["not-established", "non-sensitive", "sensitive", "sensitive", "sensitive"], ["neutral", "sensitive", "non-sensitive"]


def _rows(spark, sf_dir):
    rows = Inputs(spark, sf_dir).measured.where(F.size("truth") > 0)
    each = rows.select("doc_id", "source", "found", F.explode("truth").alias("v")).withColumn("scanner", F.explode(F.array(*map(F.lit, fx.SCANNERS))))
    near = F.filter("found", lambda f: (f["scanner"] == F.col("scanner")) & (f["start"] < F.col("v.end")) & (F.col("v.start") < f["end"]))
    place = F.col("v.start")
    jurisdiction = F.when(place % 5 == 0, F.lit(None).cast("string")).when(place % 5 == 1, "other").otherwise("same")
    first = F.array_min(F.transform(near, lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end"), f["family"].alias("family"), f["action"].alias("action"), jurisdiction.alias("jurisdiction"))))
    each = each.withColumn("finding", first)
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), i + 1)
    i = F.col("doc_id")
    each = each.select(
        "scanner", i.alias("case_id"), "source", pick(METHODS, (i % 4).cast("int")).alias("method"), (i % 9 != 0).alias("valid"), (i % 2 == 0).alias("scoped"), pick(_SENSITIVITY, place % 5).alias("sensitivity"), pick(_CLASSES, place % 3).alias("context_class"), "v", "finding",
    )
    return each.select(
        "scanner", "case_id", "source", "method", "valid", "scoped", "sensitivity", "context_class", personal.type_outcome(F.col("valid"), F.col("v.family"), F.col("scoped"), F.col("finding")).alias("type"),
        personal.sensitivity_outcome(F.col("sensitivity"), F.col("finding.action") == "redact").alias("sensed"), personal.range_outcome(F.col("v.start"), F.col("v.end"), F.col("finding")).alias("range"),
    )


def _list(names):
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


_ROWS = f""", fo AS (SELECT t.doc_id, t.family, t.s, t.e, sc.scanner, min_by({{'s': f.s, 'e': f.e, 'f': f.family, 'a': f.action}}, f.s::BIGINT * 4294967296 + f.e) FILTER (f.s IS NOT NULL) AS f FROM truth t CROSS JOIN sc LEFT JOIN fnd f ON f.scanner = sc.scanner AND f.doc_id = t.doc_id AND t.s < f.e AND f.s < t.e GROUP BY 1, 2, 3, 4, 5),
ro AS (SELECT scanner, fo.doc_id, source, {_list(METHODS)}[fo.doc_id % 4 + 1] AS method, fo.doc_id % 9 <> 0 AS valid, fo.doc_id % 2 = 0 AS scoped, {_list(_SENSITIVITY)}[s % 5 + 1] AS sens, {_list(_CLASSES)}[s % 3 + 1] AS cls, fo.family, s, e, f, CASE s % 5 WHEN 0 THEN NULL WHEN 1 THEN 'other' ELSE 'same' END AS j FROM fo JOIN fx USING (doc_id)),
rw AS (SELECT *, CASE WHEN NOT valid AND f IS NULL THEN 'pass:invalid-correct' WHEN NOT valid THEN 'fail:invalid-accepted' WHEN f IS NULL THEN 'fail:miss' WHEN f.f IS NULL THEN 'not-measured:not-measured' WHEN f.f <> family AND scoped AND j = 'other' THEN 'fail:wrong-jurisdiction' WHEN f.f <> family THEN 'fail:wrong-family'
  WHEN scoped AND j IS NULL THEN 'not-measured:not-measured' WHEN scoped AND j = 'other' THEN 'fail:wrong-jurisdiction' ELSE 'pass:correct' END AS ty,
  CASE WHEN sens = 'not-established' THEN 'review-required:unresolved' WHEN sens = 'sensitive' THEN CASE WHEN f.a = 'redact' THEN 'pass:correct' ELSE 'fail:miss' END WHEN f.a = 'redact' THEN 'fail:false-positive' ELSE 'pass:correct' END AS se,
  CASE WHEN f IS NULL THEN 'miss' WHEN f.s = s AND f.e = e THEN 'exact' WHEN f.s <= s AND f.e >= e THEN 'overbroad' ELSE 'partial' END AS ra FROM ro)"""


def _bucket(axis: str, event: str, of: str = "true") -> str:
    any_ = lambda t: f"coalesce(bool_or({of} AND {t}), false)"
    found = f"CASE WHEN {any_(f'starts_with({axis}, {chr(39)}review{chr(39)})')} THEN 'unresolved' WHEN {any_(f'starts_with({axis}, {chr(39)}not-m{chr(39)})')} THEN 'not-measured' WHEN {any_(event)} THEN 'numerator' ELSE 'other' END"
    return found if of == "true" else f"CASE WHEN bool_or({of}) THEN {found} ELSE 'not-applicable' END"


def _only(test: str, bucket: str) -> str:
    return f"CASE WHEN {test} THEN {bucket} ELSE 'not-applicable' END"


_END = "CASE WHEN bool_or(cls <> 'neutral' AND starts_with(se, 'review')) THEN 'unresolved' WHEN bool_and(cls = 'neutral' OR starts_with(se, 'pass')) THEN 'numerator' ELSE 'other' END"
_BUCKETS = {
    "type-miss-rate": _only("any_value(valid)", _bucket("ty", "ty = 'fail:miss'")), "wrong-family-rate": _only("any_value(valid)", _bucket("ty", "ty = 'fail:wrong-family'")), "wrong-jurisdiction-rate": _only("any_value(valid AND scoped)", _bucket("ty", "ty = 'fail:wrong-jurisdiction'")),
    "sensitive-miss-rate": _bucket("se", "se = 'fail:miss'", "sens = 'sensitive'"), "non-sensitive-flag-rate": _bucket("se", "se = 'fail:false-positive'", "sens = 'non-sensitive'"), "context-discrimination-rate": _only("method = 'context-discrimination'", _END),
    "benign-suppression-rate": _only("method = 'pii-benign'", _bucket("se", "starts_with(se, 'pass')")), "jurisdiction-collision-rate": _only("method = 'jurisdiction-collision'", _bucket("ty", "starts_with(ty, 'pass')")),
    "range-collateral-rate": _only("any_value(valid) AND NOT bool_and(ra = 'miss')", "CASE WHEN bool_or(ra IN ('overbroad', 'partial')) THEN 'numerator' ELSE 'other' END"), "measurable-type": _bucket("ty", "true"), "measurable-sensitivity": f"CASE WHEN bool_or(sens = 'not-established') THEN 'unresolved' ELSE {_bucket('se', 'true')} END",
}
_CASES = ", ca AS (SELECT scanner, doc_id, method, " + ", ".join(f'{b} AS "{name}"' for name, b in _BUCKETS.items()) + " FROM rw GROUP BY 1, 2, 3)"
_LONG = ", lo AS (" + " UNION ALL ".join(f"SELECT scanner, '{'measurable-share' if m.startswith('measurable') else m}' AS metric, \"{m}\" AS b FROM ca" + (" WHERE method = 'context-discrimination'" if m.startswith("context") else "") for m in _BUCKETS) + ")"
_N = "CASE WHEN metric = 'measurable-share' THEN eligible ELSE measured END"


@add(_ROWS + _CASES + _LONG + f""", co AS (SELECT scanner, metric, count(*) AS total, count(*) FILTER (b <> 'not-applicable') AS eligible, count(*) FILTER (b IN ('numerator', 'other')) AS measured, count(*) FILTER (b = 'numerator') AS numerator, count(*) FILTER (b = 'unresolved') AS unresolved, count(*) FILTER (b = 'not-measured') AS not_measured, count(*) FILTER (b = 'not-applicable') AS not_applicable FROM lo GROUP BY 1, 2),
n AS (SELECT *, CASE WHEN eligible = 0 THEN 'not-applicable' WHEN measured = 0 AND unresolved > 0 THEN 'unresolved' WHEN measured = 0 THEN 'not-measured' WHEN unresolved + not_measured > 0 THEN 'partial' ELSE 'measured' END AS status, {_N} AS effective_n FROM co)
SELECT *, CASE WHEN effective_n >= 5 THEN round(numerator::DOUBLE / effective_n, 6) END AS rate, CASE WHEN effective_n >= 5 THEN CASE WHEN metric IN ({', '.join(map(repr, personal.ERRORS))}) THEN {wilson_sql('numerator', 'effective_n', True)} ELSE {wilson_sql('numerator', 'effective_n', False)} END END AS bound FROM n""")
def pii_accounting(spark, sf_dir):
    """The ten metrics of every scanner."""
    return personal.account(_rows(spark, sf_dir))


@add(_ROWS + " SELECT source, cls AS context_class, count(*) FILTER (starts_with(se, 'pass')) AS pass, count(*) FILTER (starts_with(se, 'fail')) AS fail, count(*) FILTER (starts_with(se, 'review')) AS review_required, 0::BIGINT AS not_measured FROM rw WHERE method = 'context-discrimination' GROUP BY 1, 2")
def pii_context_strata(spark, sf_dir):
    return personal.context_strata(_rows(spark, sf_dir), "source")
