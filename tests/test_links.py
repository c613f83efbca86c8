"""Fits, the experiment grid, matching, re-keyed decisions, needles and differences of JSON."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwright.operators import calibration, experiments, jsondiff, logistic, matching, needles, snapshots


def descent(x, y, w, steps, rate, l2):
    mean, scale = x.mean(0), x.std(0)
    scale[scale == 0] = 1
    z, weights, bias = (x - mean) / scale, np.zeros(x.shape[1]), 0.0
    for _ in range(steps):
        e = (1 / (1 + np.exp(-(z @ weights + bias))) - y) * w
        bias, weights = bias - rate * e.sum() / w.sum(), weights - rate * (z.T @ e / w.sum() + l2 * weights)
    return weights, bias


@pytest.mark.parametrize("cells", [logistic.CELLS, 0])
def test_logistic_equals_plain_descent(spark, cells):
    rng = np.random.default_rng(2)
    x = np.stack([rng.integers(0, 6, 300), rng.integers(0, 3, 300), np.full(300, 7)], 1).astype(float)
    y = (x[:, 0] + rng.integers(0, 6, 300) > 5).astype(float)
    w = rng.integers(1, 4, 300).astype(float)
    rows = spark.createDataFrame([(*map(float, r), bool(v), float(u)) for r, v, u in zip(x, y, w)] + [(None, 1.0, 1.0, True, 1.0), (1.0, 1.0, 1.0, None, 1.0)], "a double, b double, c double, y boolean, w double").repartition(3)
    steps = 60 if cells else 4
    f = logistic.fit(rows, ["a", "b", "c"], "y", "w", steps=steps, cells_in_driver=cells)
    weights, bias = descent(x, y, w, steps, 0.5, 1e-3)
    assert np.allclose(f.weights, weights, atol=1e-9) and abs(f.bias - bias) < 1e-9
    p = rows.dropna().select(f.column().alias("p")).collect()
    assert all(0 < r["p"] < 1 for r in p)


def test_platt_and_diagnostics(spark):
    scores = [1, 2, 3, 4, 5, 6] * 5
    labels = [s > 3 for s in scores]
    f = logistic.platt(spark.createDataFrame(list(zip(scores, labels)), "s int, y boolean"), "s", "y")
    assert f.weights[0] > 1
    d = logistic.diagnostics(spark.createDataFrame([(0.05, False), (0.95, True), (0.95, False), (1.0, True)], "p double, y boolean"), "p", "y").first()
    assert math.isclose(d["brier"], (0.0025 + 0.0025 + 0.9025) / 4) and math.isclose(d["expected_calibration_error"], (0.05 + abs(2.9 - 2)) / 4)
    assert logistic.fit(spark.createDataFrame([], "s int, y boolean"), ["s"], "y").bias == 0


def plain_grid(rows, specs, measures):
    """The grid by loops over rows."""

    def median(xs):
        xs = sorted(xs)
        return xs[(len(xs) + 1) // 2 - 1] if xs else 0

    def fitted(spec, dev):
        ends = {}
        for m in (*spec.randomness, *spec.lexical):
            lo, hi = (median([r[m] for r in dev if r["positive"] is side]) for side in (False, True))
            ends[m] = (lo, max(lo, hi))

        def group(names, cap, r):
            points = sorted((0 if r[m] <= ends[m][0] else cap if r[m] >= ends[m][1] else cap * (r[m] - ends[m][0]) // (ends[m][1] - ends[m][0]) for m in names), reverse=True)
            return min(cap, sum(p >> i for i, p in enumerate(points)))

        def score(r):
            return 0 if r["negative"] else group(spec.randomness, spec.r, r) + group(spec.lexical, spec.l, r) + (spec.c if r["context"] else 0)

        share = lambda xs, test: sum(map(test, xs)) / len(xs) if xs else 0.0
        pos, ctl = [score(r) for r in dev if r["positive"]], [score(r) for r in dev if not r["positive"]]
        ind = [score(r) for r in dev if not r["positive"] and r["independent"]]
        high = next((t for t in range(max(spec.r + spec.l + 1, spec.c + 1, 3), spec.most + 1) if share(ind, lambda s: s >= t) <= 0.02), spec.most + 1)

        def middle(ts, cost):
            costs = [(t, cost(t)) for t in ts]
            best = min(c for _, c in costs)
            first = last = next(t for t, c in costs if c <= best + 1e-12)
            while any(t == last + 1 and c <= best + 1e-12 for t, c in costs):
                last += 1
            return (first + last) // 2

        both = lambda k: lambda t: k * share(pos, lambda s: s < t) + share(ctl, lambda s: s >= t)
        medium = middle(range(2, high), both(1))
        return score, (middle(range(1, medium), both(2)), medium, high)

    def error(score, medium, own):
        pos, ctl = [score(r) for r in own if r["positive"]], [score(r) for r in own if not r["positive"]]
        return (sum(s < medium for s in pos) / len(pos) if pos else 0) + (sum(s >= medium for s in ctl) / len(ctl) if ctl else 0), bool(pos and ctl)

    known = [r for r in rows if r["positive"] is not None]
    dev, ev = [r for r in known if not r["evaluation"]], [r for r in known if r["evaluation"]]
    out = {}
    for spec in specs:
        score, (low, medium, high) = fitted(spec, dev)
        held = []
        for fold in sorted({r["fold"] for r in dev}):
            s, t = fitted(spec, [r for r in dev if r["fold"] != fold])
            e, both = error(s, t[1], [r for r in dev if r["fold"] == fold])
            held.append((t[1], t[2], e if both else 0))
        out[spec.name] = (low, medium, high, round(error(score, medium, dev)[0], 9), round(error(score, medium, ev)[0], 9), min(h[0] for h in held), max(h[0] for h in held), min(h[1] for h in held), max(h[1] for h in held), round(max(h[2] for h in held), 9))
    return out


def test_experiment_grid(spark):
    rng = random.Random(4)
    rows = []
    for i in range(160):
        positive = rng.choice([True, False, False, None] if i % 9 == 0 else [True, False])
        rows.append({"fold": f"f{i % 3}", "evaluation": i % 4 == 0, "positive": positive, "independent": rng.random() < 0.6, "context": rng.random() < (0.7 if positive else 0.2), "negative": rng.random() < 0.05, "r": rng.randint(0, 12) + 6 * bool(positive), "l": rng.randint(4, 40), "m": rng.randint(1, 4)})
    specs = experiments.grid({"q": ("r",)}, {"l2": ("l", "m"), "l0": ()})[::5]
    schema = "fold string, evaluation boolean, positive boolean, independent boolean, context boolean, negative boolean, r int, l int, m int"
    got = experiments.run(spark.createDataFrame([tuple(r.values()) for r in rows], schema), specs, ["r", "l", "m"]).collect()
    names = ["low", "medium", "high", "error", "evaluation_error", "medium_from", "medium_to", "high_from", "high_to", "worst_held"]
    assert {r["name"]: tuple(round(r[n], 9) for n in names) for r in got} == plain_grid(rows, specs, ["r", "l", "m"])
    ranks = sorted(r["rank"] for r in got if r["rank"])
    assert ranks == list(range(1, len(ranks) + 1)) and all(r["admissible"] for r in got if r["rank"])
    # Rows that are not fitted on move no threshold.
    other = [{**r, "positive": not r["positive"] if r["positive"] is not None else None, "r": 0} if r["evaluation"] else r for r in rows]
    moved = experiments.run(spark.createDataFrame([tuple(r.values()) for r in other], schema), specs, ["r", "l", "m"]).collect()
    assert {r["name"]: (r["low"], r["medium"], r["high"], r["error"]) for r in moved} == {r["name"]: (r["low"], r["medium"], r["high"], r["error"]) for r in got}


def test_experiment_grid_starts_from_written_tables(spark):
    rows = spark.createDataFrame([(f"f{i % 2}", i % 4 == 0, i % 3 == 0, True, i % 5 == 0, False, i % 9) for i in range(40)], "fold string, evaluation boolean, positive boolean, independent boolean, context boolean, negative boolean, r int")
    out = experiments.run(rows, experiments.grid({"q": ("r",)}, {"l0": ()})[::7], ["r"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" not in plan  # nothing of the rows' plan is left in it
    assert len(out.collect()) == len(experiments.grid({"q": ("r",)}, {"l0": ()})[::7])


def test_neighbours_are_one_step_away():
    pool = experiments.grid({"q1": ("r",)}, {"l1": ("l",), "l0": ()})
    of = lambda name: {s.name for s in experiments.neighbours(next(s for s in pool if s.name == name), pool)}
    assert of("q1-l0-r60-l0-c40") == {"q1-l0-r50-l0-c40", "q1-l0-r60-l0-c30", "q1-l0-r60-l0-c50"}
    assert of("q1-l1-r30-l10-c30") == {"q1-l1-r40-l10-c30", "q1-l1-r30-l20-c30", "q1-l1-r30-l10-c40"}


def test_weights_in_fits(spark):
    rows = spark.createDataFrame([("s", False, 1, 1.0), ("s", False, 9, 5.0), ("s", True, 20, 1.0)], "signal string, positive boolean, x int, w double")
    assert calibration.fit_ramps(rows, "w").first()["lo"] == 9 and calibration.fit_ramps(rows).first()["lo"] == 1
    scores = spark.createDataFrame([(2, True, False, 1.0), (8, True, False, 9.0), (5, False, True, 1.0)], "score int, positive boolean, independent boolean, w double")
    assert calibration.error_rates(scores, 9, "w").where("t = 5").first()["leak"] == 0.1


def test_newest_in_natural_order(spark):
    order = ["0.1.0", "0.1.0-alpha.9", "0.1.0-alpha.10", "0.1.0-beta.2", "0.1.9", "0.1.10", "0.10.0", "1.0.0"]
    for k in range(1, len(order) + 1):
        rows = spark.createDataFrame([("k", v, i) for i, v in enumerate(reversed(order[:k]))], "k string, v string, at int")
        assert snapshots.newest(rows, "k", "v", "at").first()["newest"] == order[k - 1]


def test_matching_by_falling_keys(spark):
    left = [("a", "1", "x"), ("b", "2", "y"), ("c", "2", "y"), ("d", "4", "z"), ("e", None, "w"), ("f", "9", "q")]
    right = [("A", "1", "other"), ("B", "2", "y"), ("D", "5", "z"), ("E", None, "w"), ("G", "7", None)]
    schema = "id string, k1 string, k2 string"
    got = {(r["left_id"], r["right_id"], r["round"], r["state"]) for r in matching.by_keys(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["k1", "k2"]).collect()}
    assert got == {("a", "A", 1, "matched"), ("d", "D", 2, "matched"), ("e", "E", 2, "matched"), ("b", None, None, "ambiguous"), ("c", None, None, "ambiguous"), (None, "B", None, "ambiguous"), ("f", None, None, "unmatched"), (None, "G", None, "unmatched")}


def test_rekeyed_decisions(spark):
    schema = "id string, case_id string, variant string, peer string, property string, digest string"
    old = [("o1", "x1", "", "p", "peer-only", "d1"), ("o2", "x2", "", "p", "peer-only", "d2"), ("o3", "x3", "", "p", "peer-only", "d3"), ("o4", "x3", "", "p", "peer-only", "d3"), ("o5", "gone", "", "p", "peer-only", "d5"), ("o6", "x6", "", "p", "peer-only", "d6"), ("o7", "x7", "v", "p", "peer-only", "d7")]
    new = [("n1", "c1", "", "p", "peer-only", "d1"), ("n2", "c2", "", "p", "peer-only", "dX"), ("n3", "c3", "", "p", "peer-only", "d3"), ("n4", "c1", "", "q", "peer-only", "d1"), ("n5", "c9", "", "p", "peer-only", "d9"), ("n6", "c6", "", "p", "peer-only", "d6"), ("n7", "c7", None, "p", "peer-only", "d7")]
    joined = spark.createDataFrame([(f"x{i}", f"c{i}") for i in (1, 2, 3, 6, 7)], "old_case string, new_case string")
    ledger = spark.createDataFrame([(f"o{i}",) for i in (1, 2, 3, 4, 5, 7)], "id string")
    rows = matching.rekey(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), joined, ledger).collect()
    got = {r["id"]: (r["old_id"], r["reason"]) for r in rows}
    assert got == {
        "n1": ("o1", None), "n2": (None, "content-differs"), "n3": (None, "ambiguous"), "n4": (None, "peer-not-in-old-run"), "n5": (None, "case-not-joined"), "n6": (None, "no-old-occurrence"), "n7": (None, "no-old-occurrence"),
        "o1": ("o1", None), "o2": (None, "content-differs"), "o3": (None, "ambiguous"), "o4": (None, "ambiguous"), "o5": (None, "case-not-joined"), "o6": (None, "not-in-ledger"), "o7": (None, "no-new-occurrence"),
    }


def test_needles(spark):
    rng = random.Random(3)
    secrets = ["".join(rng.choice("abcé1") for _ in range(rng.randint(3, 30))) for _ in range(25)] + ["0" * 20, "aaab" * 5, "abcdefghijkl", ""]
    texts = ["".join(rng.choice("abc1 ") for _ in range(30)) + s[rng.randint(0, 3) :] + "x" for s in secrets] + [secrets[0] + "é" + secrets[1], "0" * 15, "zz" + "0" * 20, None, ""]
    want = set()
    for i, t in enumerate(texts):
        for s in secrets:
            if not s or not t:
                continue
            parts = [s] if len(s) <= 12 else [s[k : k + 12] for k in range(len(s) - 11) if len(set(s[k : k + 12])) >= 4]
            full = s in t
            if full or any(p in t for p in parts):
                want.add((i, s, full, True))
    got = needles.scan(spark.createDataFrame(list(enumerate(texts)), "text_id long, text string").repartition(3), spark.createDataFrame([(s,) for s in [*secrets, secrets[0]]], "secret string")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_needles_that_share_a_part(spark, monkeypatch):
    monkeypatch.setattr(needles, "BLOCK", 4, raising=False)
    secrets = [f"{chr(97 + k % 5)}{k}.example.com" for k in range(30)] + [f"{k}-{k}" for k in range(5)]
    texts = [f"mail {k} {secrets[k]} {secrets[(7 * k) % 30][3:]}" for k in range(30)] + ["x.example.org", "3-3 b.example.com", "3-3 b.example.com"]
    parts = {s: [s] if len(s) <= 12 else [w for w in (s[k : k + 12] for k in range(len(s) - 11)) if len(set(w)) >= 4] for s in secrets}
    want = {(i, s, s in t, True) for i, t in enumerate(texts) for s in secrets if any(p in t for p in parts[s])}
    found = needles.scan(spark.createDataFrame(list(enumerate(texts)), "text_id long, text string").repartition(3), spark.createDataFrame([(s,) for s in secrets], "secret string"))
    got = [tuple(r) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)
    pairs = found._jdf.queryExecution().sparkPlan().toString()  # pairs come out of their join as they are
    assert "Join" in pairs and "Aggregate" not in pairs.split("Join")[0]


def test_differences_by_meaning(spark):
    a = {"v": 1, "rows": [{"id": "x", "n": 1}, {"id": "y", "n": 2}], "same": [1, {"q": None}], "skip": 1}
    b = {"v": "1", "rows": [{"id": "y", "n": 3}, {"id": "z"}], "same": [1, {"q": None}], "new": True, "skip": 2}
    rules = [("^/rows$", ["id"])]
    found = sorted(jsondiff.differences(a, b, rules, frozenset(["skip"])))
    assert found == [("/new", "/new"), ("/rows/x", "/rows/*(removed)"), ("/rows/y/n", "/rows/*/n"), ("/rows/z", "/rows/*(added)"), ("/v", "/v")]
    assert list(jsondiff.differences([{"id": 1, "a": 1}, {"id": 1, "a": 2}], [{"id": 1, "a": 1}, {"id": 1, "a": 2}], [("^$", ["id"])])) == []
    deep_a, deep_b = 1, 2
    for _ in range(5000):
        deep_a, deep_b = [deep_a], [deep_b]
    assert len(list(jsondiff.differences(deep_a, deep_b, []))) == 1
    pairs = spark.createDataFrame([(1, json.dumps(a), json.dumps(b)), (2, "{", "{}"), (3, None, "{}"), (4, "{}", "{}")], "id int, before string, after string")
    got = {(r["id"], r["kind"], r["class"]) for r in jsondiff.effects(pairs, rules, [("^/rows/", "outcome"), ("^/v$", "identity")]).collect()}
    assert got == {(1, "/v", "identity"), (1, "/new", "unexplained"), (1, "/skip", "unexplained"), (1, "/rows/*(removed)", "outcome"), (1, "/rows/*(added)", "outcome"), (1, "/rows/*/n", "outcome"), (2, "", "unexplained"), (3, "", "unexplained")}


def test_personal_outcomes_and_metrics(spark):
    """Every outcome of a type, and the precedence of what a case counts as."""
    from spanwright.operators import personal

    finding = "struct<start:int,end:int,family:string,action:string,jurisdiction:string>"
    f = lambda s=0, e=9, family="us-id", j="same": (s, e, family, "redact", j)
    cases = [
        (True, True, f()), (True, True, f(family=None)), (True, True, f(family="x")), (True, True, f(family="x", j="other")), (True, False, f(family="x", j="other")), (True, True, f(j=None)), (True, True, f(j="other")), (True, False, f(j=None)),
        (True, True, None), (False, True, None), (False, True, f()),
    ]
    rows = spark.createDataFrame(cases, f"valid boolean, scoped boolean, finding {finding}")
    got = [r[0]["state"] for r in rows.select(personal.type_outcome(F.col("valid"), F.lit("us-id"), F.col("scoped"), F.col("finding"))).collect()]
    assert got == ["correct", "not-measured", "wrong-family", "wrong-jurisdiction", "wrong-family", "not-measured", "wrong-jurisdiction", "correct", "miss", "invalid-correct", "invalid-accepted"]
    ranges = spark.createDataFrame([(f(0, 9),), (f(0, 12),), (f(3, 12),), (None,)], f"finding {finding}").select(personal.range_outcome(F.lit(0), F.lit(9), F.col("finding"))).collect()
    assert [r[0] for r in ranges] == ["exact", "overbroad", "partial", "miss"]
    row = lambda case, method, type_, sens, sensed, cls="sensitive", r="exact": ("t", case, method, True, False, sens, cls, type_, sensed, r)
    good, bad, open_, gone = ("pass", "correct"), ("fail", "miss"), ("review-required", "unresolved"), ("not-measured", "not-measured")
    table = [
        row(1, "context-discrimination", good, "sensitive", good), row(1, "context-discrimination", bad, "non-sensitive", good, "non-sensitive", "miss"), row(1, "context-discrimination", good, "not-established", open_, "neutral"),
        row(2, "context-discrimination", gone, "sensitive", bad), row(3, "pii-benign", good, "non-sensitive", ("fail", "false-positive"), r="partial"), row(4, "jurisdiction-collision", good, "sensitive", good),
    ]
    schema = "scanner string, case_id int, method string, valid boolean, scoped boolean, sensitivity string, context_class string, type struct<status:string,state:string>, sensed struct<status:string,state:string>, range string"
    got = {r["metric"]: r for r in personal.account(spark.createDataFrame(table, schema)).collect()}
    counts = lambda m: tuple(got[m][c] for c in ("total", "eligible", "measured", "numerator", "unresolved", "not_measured"))
    assert counts("type-miss-rate") == (4, 4, 3, 1, 0, 1) and got["type-miss-rate"]["status"] == "partial" and got["type-miss-rate"]["rate"] is None
    assert counts("context-discrimination-rate") == (2, 2, 2, 1, 0, 0) and counts("benign-suppression-rate") == (4, 1, 1, 0, 0, 0) and counts("jurisdiction-collision-rate") == (4, 1, 1, 1, 0, 0)
    assert counts("sensitive-miss-rate") == (4, 3, 3, 1, 0, 0) and counts("range-collateral-rate") == (4, 4, 4, 1, 0, 0) and counts("wrong-jurisdiction-rate")[1] == 0 and got["wrong-jurisdiction-rate"]["status"] == "not-applicable"
    share = got["measurable-share"]
    assert (share["total"], share["effective_n"], share["numerator"], share["unresolved"], share["not_measured"]) == (8, 8, 6, 1, 1) and share["rate"] == 0.75


def test_frozen_rows_and_companions(spark):
    from spanwright.operators import corpus, independence, rendering

    schema = "id int, group string, sha256 string"
    now = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", "z")], schema)
    old = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (2, "q", "w"), (9, "a", "x")], schema)
    digest = lambda rows: independence.frozen_digest(rows.select(F.lit(1).alias("k"), independence.entry(F.col("id"), F.col("sha256")).alias("h")), "k", "h").first()["digest"]
    got = {tuple(r) for r in corpus.frozen_problems(old, now, digest(now)).collect()}
    assert got == {(1, "repeated"), (2, "regrouped"), (2, "edited"), (9, "removed"), (None, "stale-digest")}
    assert corpus.frozen_problems(now, now, digest(now)).count() == 0
    swapped = spark.createDataFrame([(1, "a", "y"), (2, "b", "x"), (3, "c", "z")], schema)
    assert digest(swapped) != digest(now)
    spans = "doc_id int, start int, end int"
    found = spark.createDataFrame([(1, 0, 4), (1, 10, 12), (1, 30, 40), (2, 0, 4)], spans)
    left = rendering.unexpected(spark.createDataFrame([(1, 11, 20)], spans), found, spark.createDataFrame([(1, 0, 5), (1, 31, 45)], spans))
    assert {tuple(r) for r in left.collect()} == {(1, 30, 40), (2, 0, 4)}
