"""Accounting of personal-data cases: what type, sensitivity and range a scanner gave each occurrence, and ten metrics over cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwright.functions.stats import bound, point

#: Metrics whose bound is the upper one (errors) and those whose is the lower one.
ERRORS = ["type-miss-rate", "wrong-family-rate", "wrong-jurisdiction-rate", "sensitive-miss-rate", "non-sensitive-flag-rate", "range-collateral-rate"]
SHARES = ["context-discrimination-rate", "benign-suppression-rate", "jurisdiction-collision-rate", "measurable-share"]
_STATE = "struct<status:string,state:string>"


def _state(status: str, state: str) -> Column:
    return F.struct(F.lit(status).alias("status"), F.lit(state).alias("state"))


def type_outcome(valid: Column, family: Column, scoped: Column, finding: Column) -> Column:
    """status and state of the type: finding is null or a struct with family and jurisdiction (``same``, ``other`` or null) of the first finding that overlaps the occurrence."""
    none, other = finding.isNull(), finding["jurisdiction"] == "other"
    return (
        F.when(~valid & none, _state("pass", "invalid-correct")).when(~valid, _state("fail", "invalid-accepted")).when(none, _state("fail", "miss"))
        .when(finding["family"].isNull(), _state("not-measured", "not-measured"))
        .when((finding["family"] != family) & scoped & F.coalesce(other, F.lit(False)), _state("fail", "wrong-jurisdiction")).when(finding["family"] != family, _state("fail", "wrong-family"))
        .when(scoped & finding["jurisdiction"].isNull(), _state("not-measured", "not-measured")).when(scoped & other, _state("fail", "wrong-jurisdiction")).otherwise(_state("pass", "correct"))
    )


def sensitivity_outcome(expected: Column, flagged: Column) -> Column:
    """status and state of the sensitivity: expected sensitive, non-sensitive or not-established; flagged: the finding calls it sensitive (null: no finding)."""
    seen = F.coalesce(flagged, F.lit(False))
    return (
        F.when(expected == "not-established", _state("review-required", "unresolved")).when((expected == "sensitive") & seen, _state("pass", "correct"))
        .when(expected == "sensitive", _state("fail", "miss")).when(seen, _state("fail", "false-positive")).otherwise(_state("pass", "correct"))
    )


def range_outcome(start: Column, end: Column, finding: Column) -> Column:
    """miss, exact, overbroad or partial."""
    exact = (finding["start"] == start) & (finding["end"] == end)
    return F.when(finding.isNull(), "miss").when(exact, "exact").when((finding["start"] <= start) & (finding["end"] >= end), "overbroad").otherwise("partial")


def _bucket(axis: str, event: Column, eligible: Column | None = None) -> Column:
    """What a case counts as: one row that awaits review leaves it unresolved, else one that isn't measured not measured, else one event makes it the numerator."""
    of = F.lit(True) if eligible is None else eligible
    status = F.col(f"{axis}.status")
    any_ = lambda test: F.bool_or(F.coalesce(of & test, F.lit(False)))
    found = F.when(any_(status == "review-required"), "unresolved").when(any_(status == "not-measured"), "not-measured").when(any_(event), "numerator").otherwise("other")
    return found if eligible is None else F.when(F.bool_or(F.coalesce(of, F.lit(False))), found).otherwise("not-applicable")


def cases(rows: DataFrame) -> DataFrame:
    """scanner, case_id, method and, for each metric, what the case counts as; measurable-share counts type and sensitivity apart.

    rows: scanner, case_id, method, valid, scoped (both of the case), sensitivity,
    context_class, type and sensed (outcomes), range.
    """
    type_, sensed = F.col("type.state"), F.col("sensed.state")
    valid, scoped, method = F.first("valid"), F.first("scoped"), F.col("method")
    only = lambda test, bucket: F.when(test, bucket).otherwise("not-applicable")
    endpoints = F.col("context_class") != "neutral"
    end = F.when(F.bool_or(endpoints & (F.col("sensed.status") == "review-required")), "unresolved").when(F.bool_or(endpoints & (F.col("sensed.status") == "not-measured")), "not-measured")
    ranges = F.when(F.bool_or(F.col("range") == "not-applicable"), "not-measured").when(F.bool_or(F.col("range").isin("overbroad", "partial")), "numerator").otherwise("other")
    open_ = F.bool_or(F.col("sensitivity") == "not-established")
    made = {
        "type-miss-rate": only(valid, _bucket("type", type_ == "miss")), "wrong-family-rate": only(valid, _bucket("type", type_ == "wrong-family")),
        "wrong-jurisdiction-rate": only(valid & scoped, _bucket("type", type_ == "wrong-jurisdiction")),
        "sensitive-miss-rate": _bucket("sensed", sensed == "miss", F.col("sensitivity") == "sensitive"), "non-sensitive-flag-rate": _bucket("sensed", sensed == "false-positive", F.col("sensitivity") == "non-sensitive"),
        "context-discrimination-rate": only(method == "context-discrimination", end.when(F.bool_and(~endpoints | (F.col("sensed.status") == "pass")), "numerator").otherwise("other")),
        "benign-suppression-rate": only(method == "pii-benign", _bucket("sensed", F.col("sensed.status") == "pass")),
        "jurisdiction-collision-rate": only(method == "jurisdiction-collision", _bucket("type", F.col("type.status") == "pass")),
        "range-collateral-rate": only(valid & ~F.bool_and(F.col("range") == "miss"), ranges),
        "measurable-type": _bucket("type", F.lit(True)), "measurable-sensitivity": F.when(open_, "unresolved").otherwise(_bucket("sensed", F.lit(True))),
    }
    return rows.groupBy("scanner", "case_id", "method").agg(*[c.alias(name) for name, c in made.items()])


def account(rows: DataFrame) -> DataFrame:
    """scanner, metric, counts of cases, status, effective_n, rate and bound of the ten metrics.

    not-applicable without an eligible case; without a measured one unresolved or
    not-measured; partial if some are not measured. Rates are over measured cases,
    measurable-share over all that are eligible; fewer than five give none. The
    context metric counts cases of its method only.
    """
    one = cases(rows)
    metric = lambda name, column: F.struct(F.lit(name).alias("metric"), F.col(f"`{column}`").alias("bucket"))
    named = [metric(m, m) for m in [*ERRORS, *SHARES[:-1]]] + [metric("measurable-share", c) for c in ("measurable-type", "measurable-sensitivity")]
    each = one.select("scanner", "method", F.explode(F.array(*named)).alias("m")).select("scanner", "method", "m.*")
    each = each.where((F.col("metric") != "context-discrimination-rate") | (F.col("method") == "context-discrimination"))
    n = lambda *names: F.count_if(F.col("bucket").isin(*names))
    counts = each.groupBy("scanner", "metric").agg(
        F.count("*").alias("total"), n("not-applicable").alias("not_applicable"), n("numerator", "other", "unresolved", "not-measured").alias("eligible"), n("numerator", "other").alias("measured"),
        n("numerator").alias("numerator"), n("unresolved").alias("unresolved"), n("not-measured").alias("not_measured"),
    )
    state = (
        F.when(F.col("eligible") == 0, "not-applicable").when((F.col("measured") == 0) & (F.col("unresolved") > 0), "unresolved").when(F.col("measured") == 0, "not-measured")
        .when(F.col("unresolved") + F.col("not_measured") > 0, "partial").otherwise("measured")
    )
    counts = counts.withColumn("status", state).withColumn("effective_n", F.when(F.col("metric") == "measurable-share", F.col("eligible")).otherwise(F.col("measured")))
    k, size = F.col("numerator"), F.col("effective_n")
    ends = F.when(F.col("metric").isin(ERRORS), bound(k, size, True)).otherwise(bound(k, size, False))
    return counts.select("scanner", "metric", "total", "eligible", "measured", "numerator", "unresolved", "not_measured", "not_applicable", "status", "effective_n", point(k, size).alias("rate"), ends.alias("bound"))


def context_strata(rows: DataFrame, by: str) -> DataFrame:
    """by (such as a language), context_class and how many rows of the context method have each sensitivity status."""
    own = rows.where("method = 'context-discrimination'")
    n = lambda s: F.count_if(F.col("sensed.status") == s).alias(s.replace("-", "_"))
    return own.groupBy(by, "context_class").agg(*[n(s) for s in ("pass", "fail", "review-required", "not-measured")])
