"""Outcome lattice of spans, scores of rows and groups, and v1.1 accounting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanwright.functions import lattice
from spanwright.functions.lattice import LEAKED
from spanwright.functions.ranges import bytes_outside, overlaps, union
from spanwright.functions.stats import MIN_DENOMINATOR, bound, point, status


def span_problems(spans: DataFrame) -> DataFrame:
    """doc_id, family, start, end, problem of spans (with env_start, env_end, bytes) that overlap the one before, leave the text or their envelope."""
    t = spans.withColumn("before", F.lag("end").over(Window.partitionBy("doc_id").orderBy("start", "end")))
    found = F.array(F.when(F.col("start") < F.col("before"), "overlap"), F.when((F.col("start") < 0) | (F.col("end") > F.col("bytes")), "outside"), F.when((F.col("env_start") > F.col("start")) | (F.col("env_end") < F.col("end")), "envelope"))
    return t.select("doc_id", "family", "start", "end", F.explode(F.filter(found, lambda p: p.isNotNull())).alias("problem"))


def score_spans(spans: DataFrame, findings: DataFrame, scanners: DataFrame) -> DataFrame:
    """scanner, doc_id, family, start, end, outcome, leaked_bytes of each span for each scanner.

    A finding that equals the span is EXACT; one that holds it is COVERED within
    the envelope, else OVERBROAD; any other overlap is PARTIAL. Each finding is
    judged by itself; leaked bytes are what the union of findings lacks.
    """
    s = spans.crossJoin(F.broadcast(scanners))  # scanners: a handful of names
    f = findings.select("scanner", "doc_id", F.col("start").alias("f_start"), F.col("end").alias("f_end"))
    equal = (F.col("f_start") == F.col("start")) & (F.col("f_end") == F.col("end"))
    holds = (F.col("f_start") <= F.col("start")) & (F.col("f_end") >= F.col("end"))
    inside = (F.col("f_start") >= F.coalesce("env_start", "start")) & (F.col("f_end") <= F.coalesce("env_end", "end"))
    best = F.when(equal, 4).when(holds & inside, 3).when(holds, 2).when(F.col("f_start").isNotNull(), 1).otherwise(0)
    near = s.alias("s").join(f.alias("f"), (F.col("s.scanner") == F.col("f.scanner")) & (F.col("s.doc_id") == F.col("f.doc_id")) & overlaps(F.col("start"), F.col("end"), F.col("f_start"), F.col("f_end")), "left")
    keys = ["scanner", "doc_id", "family", "start", "end"]
    ranked = near.select("s.*", "f_start", "f_end", best.alias("rank"))
    scored = ranked.groupBy(*keys).agg(F.max("rank").alias("rank"), F.first("env_start").alias("env_start"), F.first("env_end").alias("env_end"))
    names = F.element_at(F.array(*map(F.lit, ["MISS", "PARTIAL", "OVERBROAD", "COVERED", "EXACT"])), F.col("rank") + 1)
    scored = scored.withColumn("outcome", names)
    merged = union(findings.select("scanner", "doc_id", "start", "end"), ["scanner", "doc_id"])
    m = merged.select(F.col("scanner").alias("m_scanner"), F.col("doc_id").alias("m_doc"), F.col("start").alias("m_start"), F.col("end").alias("m_end"))
    hit = scored.join(m, (F.col("scanner") == F.col("m_scanner")) & (F.col("doc_id") == F.col("m_doc")) & overlaps(F.col("start"), F.col("end"), F.col("m_start"), F.col("m_end")), "left")
    seen = F.sum(F.when(F.col("m_start").isNull(), 0).otherwise(F.least("end", "m_end") - F.greatest("start", "m_start")))
    out = hit.groupBy(*keys, "env_start", "env_end", "outcome").agg(seen.alias("seen"))
    lost = F.when(F.col("outcome").isin(LEAKED), F.col("end") - F.col("start") - F.col("seen")).otherwise(F.lit(0))
    return out.withColumn("leaked_bytes", lost.cast("long")).drop("seen")


def score_rows(fixtures: DataFrame, spans: DataFrame, findings: DataFrame, scanners: DataFrame) -> DataFrame:
    """One row a scanner and fixture: counts by outcome, leaked and collateral bytes; for controls findings and flagged."""
    scored = score_spans(spans, findings, scanners)
    count = lambda *o: F.sum(F.col("outcome").isin(*o).cast("int"))
    per = scored.groupBy("scanner", "doc_id").agg(
        F.count("*").alias("spans"), *[count(o).alias(o.lower()) for o in ("EXACT", "COVERED", "OVERBROAD", "PARTIAL", "MISS")],
        count(*LEAKED).alias("leaked_spans"), F.sum("leaked_bytes").alias("leaked_bytes"), F.sum(F.col("end") - F.col("start")).cast("long").alias("secret_bytes"),
    )
    allowed = scored.select("scanner", "doc_id", F.coalesce("env_start", "start").alias("start"), F.coalesce("env_end", "end").alias("end"))
    ranges = findings.select("scanner", "doc_id", "start", "end")
    collateral = bytes_outside(ranges, allowed, ["scanner", "doc_id"])
    found = findings.groupBy("scanner", "doc_id").agg(F.count("*").alias("findings"))
    keys = ["scanner", "doc_id"]
    rows = fixtures.crossJoin(F.broadcast(scanners)).join(per, keys, "left").join(collateral, keys, "left").join(found, keys, "left")
    zero = [c for c in per.columns if c not in keys] + ["outside", "findings"]
    rows = rows.fillna(0, zero).withColumnRenamed("outside", "collateral_bytes")
    return rows.withColumn("flagged", (F.col("kind") == "must-not-flag") & (F.col("findings") > 0))


def score_documents(rows: DataFrame, scanners: list[str], companions: str | None = None) -> DataFrame:
    """A row a scanner and document of rows (truth and found, arrays of spans and findings, among others), without a shuffle.

    scanner; own: its findings; merged: their union; scored: the spans with
    outcome and leaked_bytes (see ``score_spans``); collateral_bytes: those of the
    union outside what the spans allow. The column ``companions``, if named, is an
    array of ranges (start, end) that belong to a value: they are not scored, and
    their bytes are no collateral.
    """
    each = rows.withColumn("scanner", F.explode(F.array(*map(F.lit, scanners))))
    each = each.withColumn("own", F.filter("found", lambda f: f["scanner"] == F.col("scanner")))
    each = each.withColumn("merged", lattice.union(lattice.as_ranges(F.col("own"))))
    each = each.withColumn("scored", lattice.scored(F.col("truth"), F.col("own"), F.col("merged")))
    allowed = lattice.envelopes(F.col("truth"))
    allowed = lattice.union(allowed if companions is None else F.concat(allowed, lattice.as_ranges(F.col(companions))))
    outside = lattice.let(allowed, lambda a: lattice.total(F.col("merged")) - lattice.shared_bytes(F.col("merged"), a))
    return each.withColumn("collateral_bytes", outside)


def row_counts(each: DataFrame) -> DataFrame:
    """score_documents with the counts of ``score_rows``."""
    n = lambda *o: F.size(F.filter("scored", lambda s: s["outcome"].isin(*o))).cast("long")
    total = lambda f: F.aggregate("scored", F.lit(0).cast("long"), lambda t, s: t + f(s))
    return each.withColumns({
        "spans": F.size("scored").cast("long"), **{o.lower(): n(o) for o in ("EXACT", "COVERED", "OVERBROAD", "PARTIAL", "MISS")}, "leaked_spans": n(*LEAKED),
        "leaked_bytes": total(lambda s: s["leaked_bytes"]), "secret_bytes": total(lambda s: s["end"] - s["start"]), "findings": F.size("own").cast("long"),
        "flagged": (F.col("kind") == "must-not-flag") & (F.size("own") > 0),
    }).drop("own", "merged")


def diagnostics(each: DataFrame) -> DataFrame:
    """score_documents with tp, fp, fn and tn of exact ranges (no headline figures), and code, the result of a row in short.

    A span that a finding equals is tp, any other fn; a finding that equals no span
    is fp, one of equal range counts once. Of a control every finding is fp, and
    silence is tn. code: the outcomes of the spans in order; clean or flagged:n of
    a control; observed:n of a row that isn't assessed.
    """
    ranges = F.array_distinct(lattice.as_ranges(F.col("own")))
    control, n = F.size("truth") == 0, F.size(ranges).cast("long")
    tp = F.size(F.filter("scored", lambda s: s["outcome"] == "EXACT")).cast("long")
    listed = F.array_sort(F.transform("scored", lambda s: F.struct(s["start"], s["end"], s["family"], s["outcome"].alias("outcome"))))
    code = (
        F.when(F.col("tier") == "T0", F.concat(F.lit("observed:"), n.cast("string"))).when(control & (n == 0), "clean").when(control, F.concat(F.lit("flagged:"), n.cast("string")))
        .otherwise(F.array_join(F.transform(listed, lambda s: s["outcome"]), ","))
    )
    other = F.size(F.array_except(ranges, lattice.as_ranges(F.col("truth")))).cast("long")
    return each.withColumns({"tp": tp, "fn": F.size("scored").cast("long") - tp, "fp": other, "tn": F.when(control & (n == 0), 1).otherwise(0), "code": code})


def control_counts(each: DataFrame) -> DataFrame:
    """The counts of ``score_controls`` for rows with scanner, scope_family and own (see ``score_documents``)."""
    other = lambda f: f["family"].isNotNull() & F.col("scope_family").isNotNull() & (f["family"] != F.col("scope_family"))
    n = lambda test: F.size(F.filter("own", test)).cast("long")
    return each.select(
        "scanner", "doc_id", "scope_family", F.size("own").cast("long").alias("findings"), F.exists("own", lambda f: ~F.coalesce(other(f), F.lit(False))).alias("flagged"),
        F.exists("own", lambda f: F.coalesce(other(f), F.lit(False))).alias("co_detected"), n(lambda f: f["action"] == "warn").alias("warned"), n(lambda f: f["action"] == "redact").alias("redacted"),
    )


def score_controls(controls: DataFrame, findings: DataFrame, scanners: DataFrame) -> DataFrame:
    """scanner, doc_id, scope_family, findings, flagged, co_detected, warned, redacted of controls (doc_id, scope_family).

    Without a scope any finding flags the control. With one, findings of another
    known family are co-detections and don't; those without a family do.
    """
    every = controls.crossJoin(F.broadcast(scanners))  # scanners: a handful of names
    f = findings.select("scanner", "doc_id", F.col("family").alias("found"), "action")
    other = F.col("found").isNotNull() & F.col("scope_family").isNotNull() & (F.col("found") != F.col("scope_family"))
    n = lambda c, name: F.count_if(c).alias(name)
    hit = F.col("action").isNotNull()
    rows = every.join(f, ["scanner", "doc_id"], "left").groupBy("scanner", "doc_id", "scope_family").agg(n(hit, "findings"), n(hit & other, "other"), n(F.col("action") == "warn", "warned"), n(F.col("action") == "redact", "redacted"))
    return rows.select("scanner", "doc_id", "scope_family", "findings", (F.col("other") < F.col("findings")).alias("flagged"), (F.col("other") > 0).alias("co_detected"), "warned", "redacted")


def pair_twins(rows: DataFrame, twins: DataFrame) -> DataFrame:
    """Positives of rows (score_rows) with their twins (score_controls, doc_id being the positive's), if they have one.

    scanner, doc_id, kind, tier, miss, spans, covered (nothing leaks), acceptable
    (nothing leaks and nothing is overbroad), scope_family, flagged, co_detected.
    """
    counts = [(F.col("leaked_spans") == 0).alias("covered"), (F.col("exact") + F.col("covered") == F.col("spans")).alias("acceptable")]
    positive = rows.where("tier <> 'T0' and kind <> 'must-not-flag'").select("scanner", "doc_id", "kind", "tier", "miss", "spans", *counts)
    return positive.join(twins.select("scanner", "doc_id", "scope_family", "flagged", "co_detected"), ["scanner", "doc_id"], "left")


def account_twins(pairs: DataFrame, coverage_floor: float = 0.5, least: int = MIN_DENOMINATOR) -> DataFrame:
    """Twin figures by scanner, kind and tier of pair_twins.

    Two counts of discriminated pairs (the older one lets overbroad spans pass),
    coverage (pairs a positive) with its lower bound, and the rate with its lower
    bound: withheld as insufficient-coverage below the floor, else as
    insufficient-evidence below ``least`` pairs.
    """
    has = F.col("flagged").isNotNull()
    n = lambda c, name: F.count_if(c).alias(name)
    g = pairs.groupBy("scanner", "kind", "tier").agg(
        F.count("*").alias("positives"), n(has, "pairs"), n(F.col("covered") & ~F.col("flagged"), "discriminated_v10"),
        n(F.col("acceptable") & ~F.col("flagged"), "discriminated"), n(F.col("co_detected"), "co_detected"),
    )
    state = F.when(F.col("pairs") < coverage_floor * F.col("positives"), "insufficient-coverage").when(F.col("pairs") < least, "insufficient-evidence").otherwise("measured")
    shown = lambda c: F.when(F.col("status") == "measured", c)
    return g.withColumn("status", state).select(
        "*", point(F.col("pairs"), F.col("positives"), least).alias("coverage"), bound(F.col("pairs"), F.col("positives"), False, least).alias("coverage_bound"),
        shown(point(F.col("discriminated"), F.col("pairs"), least)).alias("rate"), shown(bound(F.col("discriminated"), F.col("pairs"), False, least)).alias("rate_bound"),
    )


def twin_probe(rows: DataFrame, twins: DataFrame, families: DataFrame, scanners: DataFrame) -> DataFrame:
    """scanner, family, twins, pairs, discriminated, state of every scanner and family (family, reason).

    A pair is a twin (score_controls) with its positive (score_rows) that is
    assessed and no control; it is discriminated if every span of the positive is
    EXACT or COVERED and nothing flags the twin. A family without twins is
    un-probeable if it has a reason, else unrecorded; with twins but no pair it is
    not-measured; else discriminated if every pair is, or not-discriminated.
    """
    known = rows.select("scanner", "doc_id", "tier", "kind", (F.col("exact") + F.col("covered") == F.col("spans")).alias("acceptable"))
    both = twins.select("scanner", "doc_id", F.col("scope_family").alias("family"), "flagged").join(known, ["scanner", "doc_id"], "left")
    pair = F.coalesce((F.col("tier") != "T0") & (F.col("kind") != "must-not-flag"), F.lit(False))
    counts = both.groupBy("scanner", "family").agg(F.count("*").alias("twins"), F.count_if(pair).alias("pairs"), F.count_if(pair & F.col("acceptable") & ~F.col("flagged")).alias("discriminated"))
    every = families.crossJoin(F.broadcast(scanners)).join(F.broadcast(counts), ["scanner", "family"], "left")  # scanners and families: a handful of names
    state = (
        F.when(F.col("twins").isNull(), F.when(F.col("reason").isNull(), "unrecorded").otherwise("un-probeable"))
        .when(F.col("pairs") == 0, "not-measured").when(F.col("discriminated") == F.col("pairs"), "discriminated").otherwise("not-discriminated")
    )
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("twins", "pairs", "discriminated")]
    return every.select("scanner", "family", *zero, state.alias("state"))


def absolute(rows: DataFrame) -> DataFrame:
    """rows (score_rows, or controls without counts) with type and status of the assertion that a row makes by itself.

    A positive passes if every span is EXACT or COVERED and no byte beside the
    allowed ones is touched; a control if nothing flags it; T0 awaits review.
    """
    positive = F.col("spans") > 0
    good = F.when(positive, (F.col("exact") + F.col("covered") == F.col("spans")) & (F.col("collateral_bytes") == 0)).otherwise(~F.col("flagged"))
    status = F.when(F.col("tier") == "T0", "review-required").when(good, "pass").otherwise("fail")
    kind = F.when(F.col("tier") == "T0", "absolute").when(positive, "present-within-envelope").otherwise("absent")
    return rows.withColumn("type", kind).withColumn("status", status)


def relation(before: DataFrame, after: DataFrame, kind: str, also: Sequence[str] = ()) -> DataFrame:
    """scanner, doc_id, type, status (and the columns ``also`` of after) of rows (absolute, with positive and outcomes) and their variants.

    Both must pass by themselves; must-flip asks for a positive and a control,
    same-detection for equal outcomes. Two missed positives are no invariance.
    """
    side = lambda rows, p: rows.select("scanner", "doc_id", *(also if p == "b_" else ()), *[F.col(c).alias(p + c) for c in ("status", "positive", "outcomes")])
    both = side(before, "a_").join(side(after, "b_"), ["scanner", "doc_id"])
    more = (F.col("a_positive") & ~F.col("b_positive")) if kind == "must-flip" else F.col("a_outcomes").eqNullSafe(F.col("b_outcomes"))
    passed = (F.col("a_status") == "pass") & (F.col("b_status") == "pass") & more
    review = (F.col("a_status") == "review-required") | (F.col("b_status") == "review-required")
    return both.select(*also, "scanner", "doc_id", F.lit(kind).alias("type"), F.when(review, "review-required").when(passed, "pass").otherwise("fail").alias("status"))


def outcomes(spans: DataFrame) -> DataFrame:
    """scanner, doc_id, outcomes: those of the spans in their order, joined by a comma."""
    listed = F.array_sort(F.collect_list(F.struct("start", "end", "family", "outcome")))
    return spans.groupBy("scanner", "doc_id").agg(F.array_join(F.transform(listed, lambda s: s["outcome"]), ",").alias("outcomes"))


def groups(rows: DataFrame) -> DataFrame:
    """Counts by scanner, kind and tier; rows of T0 are only counted. No totals over kinds or tiers."""
    scored = F.col("tier") != "T0"
    total = lambda c: F.sum(F.when(scored, F.col(c)).otherwise(0)).cast("long").alias(c)
    return rows.groupBy("scanner", "kind", "tier").agg(
        F.count("*").alias("files"), *[total(c) for c in ("spans", "secret_bytes", "exact", "covered", "overbroad", "partial", "miss", "leaked_spans", "leaked_bytes")],
        F.sum(F.when(scored & (F.col("kind") != "must-not-flag"), F.col("collateral_bytes")).otherwise(0)).cast("long").alias("collateral_bytes"),
        F.sum((scored & F.col("flagged")).cast("int")).alias("flagged_files"), F.sum(F.when(scored & F.col("flagged"), F.col("findings")).otherwise(0)).cast("long").alias("control_findings"),
    )


def account(counts: DataFrame, measurable_floor: float = 0.7) -> DataFrame:
    """Rates with Wilson bounds; withheld below five trials, or if too many rows of the kind are still T0."""
    waiting = F.sum(F.when(F.col("tier") == "T0", F.col("files")).otherwise(0)).over(Window.partitionBy("scanner", "kind"))  # a few rows a scanner
    rows = counts.withColumn("pending", waiting).where("tier <> 'T0'")
    share = F.col("files") / (F.col("files") + F.col("pending"))
    floor = F.when(F.col("kind") == "must-redact", measurable_floor).otherwise(0.0)
    open_ = share >= floor
    rate = lambda k, n, up, trials=None: (F.when(open_, point(k, n)).otherwise(F.lit(None)), F.when(open_, bound(k, trials if trials is not None else n, up)))
    leak, leak_b = rate(F.col("leaked_spans"), F.col("spans"), True)
    byte = F.when(open_ & (F.col("spans") >= 5), F.round(F.col("leaked_bytes") / F.col("secret_bytes"), 6))
    ratio = F.when(open_ & (F.col("spans") >= 5), F.round(F.col("collateral_bytes") / F.col("secret_bytes"), 6))
    alarm, alarm_b = rate(F.col("flagged_files"), F.col("files"), True)
    control = F.col("kind") == "must-not-flag"
    trials = F.when(control, F.col("files")).otherwise(F.col("spans"))
    return rows.select(
        "scanner", "kind", "tier", "files", "pending", "spans", "leaked_spans", "flagged_files",
        F.round(share, 6).alias("measurable_share"), F.when(open_, status(trials)).otherwise("insufficient-evidence").alias("status"),
        F.when(~control, leak).alias("leak_rate"), F.when(~control, leak_b).alias("leak_bound"), F.when(~control, byte).alias("leaked_byte_rate"), F.when(~control, ratio).alias("collateral_ratio"),
        F.when(control, alarm).alias("alarm_rate"), F.when(control, alarm_b).alias("alarm_bound"),
    )
