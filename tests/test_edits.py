"""Edit hunks, twin audits, offset maps, variants and reshaped values."""

import random

import pytest
from pyspark.sql import functions as F

from spanwright.functions import lattice, offsets
from spanwright.functions import text as tx
from spanwright.operators import edits, evasion, independence, scoring, variants
from spanwright.sources import fixtures as fx


@pytest.mark.parametrize(
    ("a", "b", "n"),
    [("Header: Token x", "Y-Build-Id: x", 1), ("same", "same", 0), ("aa\nbb value cc\ndd", "aa\nbX value cY\ndd", 2), ("", "abc", 1), ("abc", "", 1), ("a\nb", "x\ny", 2)],
)
def test_hunks(a, b, n):
    assert len(edits.hunks(a, b)) == n


def test_hunks_lead_from_one_text_to_the_other():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ("".join(rng.choice("ab\né") for _ in range(rng.randint(0, 25))) for _ in range(2))
        at, built = 0, ""
        for i, j, k, m in edits.hunks(a, b):
            assert at <= i <= j and (i < j or k < m)
            built += a[at:i] + b[k:m]
            at = j
        assert built + a[at:] == b
    assert edits.hunks("a" * 3000 + "x", "b" * 3000) is None


def test_twin_audit(spark):
    value, other = "zz_ABCDEFGHIJKL", "zz_MNOPQRSTUVWX"
    text = f"# api key for service\nAPI_KEY={value}\n"
    start = text.index(value)
    twins = [
        ("length", "length", text.replace(value, value[:-1])), ("comment", "length", f"# key for a different thing\nAPI_KEY={value[:-1]}\n"), ("context", "context", text.replace("API_KEY", "BUILD_ID")),
        ("both", "context", text.replace("API_KEY", "BUILD_ID").replace(value, other)), ("two", "context", f"# unrelated build note\nBUILD_ID={value}\n"), ("same", "length", text), ("none", None, text), ("null", "length", None),
    ]
    rows = [(name, "gone" if name == "none" else "p", kind, t) for name, kind, t in twins]
    positives = spark.createDataFrame([("p", text, [(start, start + len(value))])], "doc_id string, text string, spans array<struct<start:int,end:int>>")
    got = {r["twin_id"]: r["flags"] for r in edits.audit_twins(spark.createDataFrame(rows, "twin_id string, positive_id string, mutation_kind string, text string"), positives).collect()}
    assert got["length"] == [] and got["context"] == [] and got["comment"] == ["value-and-context"] and got["two"] == ["multiple-context-edits"]
    assert "context-twin-edits-value" in got["both"] and got["same"] == ["identical"] and got["none"] == ["missing-positive"] and got["null"] == ["diff-too-large"]


def test_changed_range(spark):
    pairs = [("abcd", "abXd"), ("aaa", "aa"), ("é1", "é2"), ("x", "x"), ("", "q"), ("aXa", "aa")]
    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(edits.changed_range(F.col("a"), F.col("b"))).collect()]
    assert [None if g is None else tuple(g) for g in got] == [(2, 3, 3), (2, 3, 2), (2, 3, 3), None, (0, 0, 1), (1, 2, 1)]


def test_offsets_move_with_their_characters(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice('a"\\\n\r\té密🔑\x01 ') for _ in range(rng.randint(0, 40))) for _ in range(60)] + ["\n\n", "\r\n\n", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = []
    for i, t in enumerate(texts):
        for _ in range(3 if t else 0):
            a, b = sorted(rng.sample(range(len(t) + 1), 2)) if len(t) else (0, 0)
            spans.append((i, "f", len(t[:a].encode()), len(t[:b].encode()), None, None))
    made = variants.generate(rows)
    texts_of = {(r["doc_id"], r["operator"]): r["text"] for r in made.where("status = 'generated'").collect()}
    carried = variants.carry(spark.createDataFrame(spans, "doc_id long, family string, start int, end int, env_start int, env_end int"), made).collect()
    raw = {i: (t or "").encode() for i, t in enumerate(texts)}
    want = {"encoding.crlf": lambda s: s.replace("\r\n", "\n").replace("\n", "\r\n")}
    by = {}
    for r in carried:
        by.setdefault((r["doc_id"], r["operator"]), []).append(r)
    assert {k for k in texts_of if texts[k[0]]} == set(by)
    for (i, operator), own in by.items():
        new = texts_of[i, operator].encode()
        for r, (_, _, a, b, _, _) in zip(sorted(own, key=lambda r: (r["start"], r["end"])), sorted((s for s in spans if s[0] == i), key=lambda s: (s[2], s[3]))):
            old = raw[i][a:b].decode()
            piece = new[r["start"] : r["end"]].decode()
            assert r["env_start"] is None and r["bytes"] == len(new)
            if operator == "encoding.json-string":
                import json

                assert json.loads(f'"{piece}"') == old
            elif operator == "encoding.crlf":
                assert piece.replace("\r\n", "\n") == old.replace("\r\n", "\n")
            else:
                assert piece == old
    assert want["encoding.crlf"](texts[-3]) == texts_of[len(texts) - 3, "encoding.crlf"]
    assert made.where("text is null and status = 'generated'").count() == 0


def test_count_below(spark):
    rows = spark.createDataFrame([([1, 1, 4, 9], x) for x in range(12)] + [([], 3)], "a array<int>, x int")
    got = [r[0] for r in rows.select(offsets.count_below(F.col("a"), F.col("x"))).collect()]
    assert got == [sum(v < x for v in (1, 1, 4, 9)) for x in range(12)] + [0]


def test_scores_in_rows_equal_those_of_joins(spark):
    docs = fx.documents(spark, "/root/testdata/sf0.001")
    measured = fx.measured(docs)
    scanners = spark.createDataFrame([(s,) for s in fx.SCANNERS], "scanner string")
    names = ["scanner", "doc_id", "spans", "exact", "covered", "overbroad", "partial", "miss", "leaked_spans", "leaked_bytes", "secret_bytes", "collateral_bytes", "findings", "flagged"]
    joined = scoring.score_rows(measured.select("doc_id", "source", "kind", "tier", "bytes"), fx.spans(docs), fx.findings(docs), scanners).select(names)
    own = scoring.row_counts(scoring.score_documents(measured, fx.SCANNERS)).select(names)
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, joined.collect()))


def test_companions_and_diagnostics(spark):
    """Companion bytes are no collateral, nor are they scored; codes and exact counts of rows."""
    finding = lambda s, e, f=None: ("t", f, s, e, "redact")
    span = lambda s, e, a=None, b=None: ("f", s, e, a, b)
    rows = [
        (1, "must-redact", "T1", [span(10, 20)], [(0, 4)], [finding(0, 4), finding(10, 20)]), (2, "must-redact", "T1", [span(5, 10), span(20, 30, 18, 32)], [], [finding(0, 100)]), (3, "must-redact", "T2", [span(5, 10), span(20, 30)], [], []),
        (4, "must-not-flag", "T2", [], [(0, 4)], [finding(0, 4)]), (5, "must-not-flag", "T2", [], [], []), (6, "must-redact", "T0", [span(1, 2)], [], [finding(0, 1)]), (7, "policy", "T3", [span(10, 20)], [], [finding(10, 15), finding(10, 15, "g")]),
    ]
    frame = spark.createDataFrame(rows, f"doc_id int, kind string, tier string, truth array<{fx.SPAN}>, companions array<struct<start:int,end:int>>, found array<{fx.FINDING}>")
    each = scoring.diagnostics(scoring.score_documents(frame, ["t"], "companions"))
    got = {r["doc_id"]: (r["code"], r["tp"], r["fp"], r["fn"], r["tn"], r["collateral_bytes"]) for r in each.collect()}
    assert got == {
        1: ("EXACT", 1, 1, 0, 0, 0), 2: ("OVERBROAD,OVERBROAD", 0, 1, 2, 0, 100 - 5 - 14), 3: ("MISS,MISS", 0, 0, 2, 0, 0), 4: ("flagged:1", 0, 1, 0, 0, 0), 5: ("clean", 0, 0, 0, 1, 0), 6: ("observed:1", 0, 1, 1, 0, 1), 7: ("PARTIAL", 0, 1, 1, 0, 0),
    }
    leaked = {r["doc_id"]: r["leaked_bytes"] for r in scoring.row_counts(scoring.score_documents(frame, ["t"], "companions")).collect()}
    assert leaked[3] == 15 and leaked[7] == 5


def test_union_and_outcome_of_arrays(spark):
    row = spark.sql("select array(named_struct('start', 5, 'end', 9), named_struct('start', 0, 'end', 5), named_struct('start', 20, 'end', 21), named_struct('start', 6, 'end', 7)) as r")
    assert [tuple(x) for x in row.select(lattice.union(F.col("r"))).first()[0]] == [(0, 9), (20, 21)]


BASES = [
    (1, "must-redact:statistical", "api_key=", "q7Lp0Zt5Rk9Xm2Wv8Bn4", "\n"), (2, "must-redact:statistical", "", "q7Lp0Zt5Rk9Xm2Wv8Bn4", ""), (3, "must-redact:deterministic", "x\ntoken: '", "zzp_q7Lp0Zt5Rk9Xm2Wv8Bn4", "' # é\nend"), (4, "control:flagged", "see ", "plain-documentation-words", " here"),
]


def test_variants_keep_the_secret_in_its_span(spark):
    bases = spark.createDataFrame(BASES, "base_id int, stratum string, before string, value string, after string")
    rows = evasion.variants(bases).collect()
    assert rows == evasion.variants(bases).collect() and len({(r["attack_class"], r["operator"], r["base_id"]) for r in rows}) == len(rows)
    assert {r["attack_class"] for r in rows} == set(evasion.OPERATORS) and all(len(ops) >= 5 for ops in evasion.OPERATORS.values()) and len(evasion.OPERATORS) == 9
    of = {b[0]: b for b in BASES}
    for r in rows:
        raw, base = r["text"].encode(), of[r["base_id"]]
        assert r["env_start"] <= r["start"] <= r["end"] <= r["env_end"] <= len(raw)
        secret = raw[r["start"] : r["end"]].decode()
        if r["attack_class"] in ("context-perturbation", "placeholder-wrapping"):
            assert secret == base[3]
        if r["expectation"] == "control":
            assert "q7Lp0Zt5Rk9Xm2Wv8Bn4" not in raw[r["env_start"] : r["env_end"]].decode()
        if r["operator"].startswith(("benign", "full-grammar")):
            assert r["expectation"] == "control" and base[1] == "must-redact:statistical"
        if base[0] == 3 and r["attack_class"] in ("periodic-body", "class-distribution"):
            assert secret.startswith("zzp_")
    one = {r["operator"]: r for r in rows if r["base_id"] == 3}
    assert "token = " in one["spaced-separator"]["text"] and one["comment-prefix"]["text"].startswith("x\n# token=")


def test_values_split(spark):
    body = "q7Lp0Zt5Rk9Xm2Wv8Bn4"
    armour = ("-----BEGIN SYNTHETIC KEY-----\n", body, "\n-----END SYNTHETIC KEY-----")
    rows = spark.createDataFrame([(f"zzp_{body}",), (body,), ("".join(armour),), ("ab_cd",)], "v string")
    parts = evasion.split_value(F.col("v"))
    assert [tuple(r) for r in rows.select(parts["head"], parts["body"], parts["tail"]).collect()] == [("zzp_", body, ""), ("", body, ""), armour, ("", "ab_cd", "")]


def test_whole_values_only_are_excluded(spark):
    whole = {
        "{{ secrets.API_KEY }}": "template-reference", "${API_KEY}": "environment-reference", "${API_KEY:-x}": "environment-reference", "$API_KEY": "environment-reference", "%API_KEY%": "environment-reference", "$(vault read x)": "command-substitution",
        "`date`": "command-substitution", "<your-api-key>": "angle-placeholder", "********": "mask", "xxxx": "mask", "your-api-key-here": "placeholder-vocabulary", "REDACTED-EXAMPLE-VALUE": "placeholder-vocabulary",
    }
    none = ["EXAMPLEq7Lp0Zt5", "q7Lp${HOME}0Zt5", "****q7Lp0Zt5", "{{x}}q7Lp0Zt5", "api-key", "xx", "q7Lp0Zt5", ""]
    rows = spark.createDataFrame([(v,) for v in [*whole, *none]], "v string")
    assert [r[0] for r in rows.select(tx.exclusion_grammar(F.col("v"))).collect()] == [*whole.values(), *[None] * len(none)]


def test_outcomes_of_variants(spark):
    found = "array<struct<start:int,end:int,band:string,statistical:boolean,exclusion:string>>"
    rows = [
        ("c", "o1", 1, "must-redact", 5, 10, 5, 12, [(5, 10, "low", True, None)]), ("c", "o2", 1, "must-redact", 5, 10, 5, 12, [(3, 12, "none", False, "mask")]), ("c", "o3", 1, "must-redact", 5, 10, 5, 12, [(6, 10, "high", True, None)]),
        ("d", "o4", 2, "control", 5, 10, 5, 10, [(1, 3, "medium", True, None)]), ("d", "o5", 2, "control", 5, 10, 5, 10, []),
    ]
    frame = spark.createDataFrame(rows, f"attack_class string, operator string, base_id int, expectation string, start int, end int, env_start int, env_end int, found {found}")
    got = {r["operator"]: r for r in evasion.outcomes(frame).collect()}
    assert [(got[o]["legacy_flagged"], got[o]["candidate_flagged"]) for o in ("o1", "o2", "o3", "o4", "o5")] == [(True, False), (True, True), (False, False), (True, True), (False, False)]
    assert got["o2"]["collateral"] == 2 and got["o4"]["collateral"] == 2 and got["o2"]["negative_evidence"] and not got["o1"]["negative_evidence"]
    total = {r["attack_class"]: r for r in evasion.tally(evasion.outcomes(frame)).collect()}
    assert total[None]["variants"] == 5 and total[None]["leaked_spans"] == 2 and total["c"]["leaked_only_under_candidate"] == 1 and total["d"]["false_alarms"] == 1


def test_skeletons(spark):
    rows = spark.createDataFrame([(1, "K=aaaa bbbb", [(2, 6)]), (2, "K=zz  bbbb", [(2, 4)]), (3, "é aXYZ_0123456789abcdef b", []), (4, "ab", [(0, 1), (0, 2)])], "i int, t string, s array<struct<start:int,end:int>>")
    assert [r[0] for r in rows.select(independence.skeleton(F.col("t"), F.col("s"))).collect()] == ["K=⟨S⟩ bbbb", "K=⟨S⟩ bbbb", "é ⟨V⟩ b", "⟨S⟩b"]


def test_axes_joined_by_a_value(spark):
    rows = [("f", 1, "v", "a", "s1"), ("f", 2, "v", "b", "s2"), ("f", 3, "w", "b", "s1"), ("f", 4, "w", "c", "s1"), ("f", 5, "x", "d", "s1"), ("g", 6, "y", "a", "s1")]
    got = {r["family"]: r for r in independence.by_family(spark.createDataFrame(rows, "family string, doc_id int, value string, axis string, skeleton string"), spark).collect()}
    assert (got["f"]["axes"], got["f"]["independent_axes"], got["f"]["same_value_across_axes"], got["f"]["upper_bound"]) == (4, 2, 2, 2) and got["g"]["independent_axes"] == 1
