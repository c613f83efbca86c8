"""Hand-computed tables for the outcome lattice, ranges, bounds and validators."""

import pytest
from pyspark.sql import functions as F

from spanwright import catalog, streaming
from spanwright.functions import ranges, stats, text, validators
from spanwright.operators import calibration, independence, scoring
from spanwright.sources import fixtures as fx

SPAN = "doc_id long, family string, start int, end int, env_start int, env_end int, bytes int"


def outcome(spark, spans, findings):
    s = spark.createDataFrame([(1, "f", *x, 1000) for x in spans], SPAN)
    f = spark.createDataFrame([("t", 1, *x) for x in findings], "scanner string, doc_id long, start int, end int")
    rows = scoring.score_spans(s, f, spark.createDataFrame([("t",)], "scanner string")).orderBy("start").collect()
    return [(r["outcome"], r["leaked_bytes"]) for r in rows]


@pytest.mark.parametrize(
    ("envelope", "findings", "expected"),
    [
        (None, [(10, 20)], ("EXACT", 0)),
        ((4, 26), [(4, 26)], ("COVERED", 0)),
        ((4, 26), [(8, 22)], ("COVERED", 0)),
        ((4, 26), [(0, 30)], ("OVERBROAD", 0)),
        (None, [(9, 21)], ("OVERBROAD", 0)),
        (None, [(10, 15)], ("PARTIAL", 5)),
        (None, [(0, 10)], ("MISS", 10)),
        ((4, 26), [(0, 30), (10, 20)], ("EXACT", 0)),
        ((4, 26), [(0, 30), (6, 24)], ("COVERED", 0)),
        (None, [(10, 15), (15, 20)], ("PARTIAL", 0)),
        (None, [(8, 14), (16, 22)], ("PARTIAL", 2)),
        (None, [], ("MISS", 10)),
    ],
)
def test_lattice(spark, envelope, findings, expected):
    assert outcome(spark, [(10, 20, *(envelope or (None, None)))], findings) == [expected]


def test_union_and_bytes_outside(spark):
    table = lambda rows: spark.createDataFrame([(1, *r) for r in rows], "k int, start int, end int")
    got = lambda df: sorted((r["start"], r["end"]) for r in df.collect())
    assert got(ranges.union(table([(5, 8), (1, 3), (7, 10)]), ["k"])) == [(1, 3), (5, 10)]
    assert got(ranges.union(table([(1, 3), (3, 5)]), ["k"])) == [(1, 5)]
    assert got(ranges.union(table([(1, 3), (3, 5)]), ["k"], touching=False)) == [(1, 3), (3, 5)]
    assert ranges.bytes_outside(table([(0, 10)]), table([(2, 4), (6, 7)]), ["k"]).first()["outside"] == 7


@pytest.mark.parametrize(
    ("k", "n", "upper", "lower"),
    [(0, 5, 0.434491, 0), (0, 10, 0.27754, 0), (5, 10, 0.76341, 0.23659), (10, 10, 1, 0.72246), (1, 139, 0.039625, 0.001271), (45, 50, 0.956525, 0.786395), (0, 1000, 0.003827, 0)],
)
def test_wilson(spark, k, n, upper, lower):
    r = spark.range(1).select(stats.wilson(F.lit(k), F.lit(n), True).alias("u"), stats.wilson(F.lit(k), F.lit(n), False).alias("l")).first()
    assert (r["u"], r["l"]) == (upper, lower)


def test_withheld_is_not_zero(spark):
    r = spark.range(1).select(stats.status(F.lit(0)).alias("a"), stats.status(F.lit(4)).alias("b"), stats.point(F.lit(1), F.lit(4)).alias("c"), stats.bound(F.lit(0), F.lit(5), True).alias("d")).first()
    assert tuple(r) == ("none", "insufficient-evidence", None, 0.434491)


def test_validators(spark):
    v = spark.createDataFrame([(x,) for x in ("1230", "12344", "1231", "", "0", "1" * 20)], "v string").select(validators.luhn(F.col("v")))
    assert [r[0] for r in v.collect()] == ["valid", "valid", "checksum", "malformed", "malformed", "malformed"]
    i = spark.createDataFrame([(x,) for x in ("ZZ50SYNTHETIC000000", "ZZ75SYNTHETIC00", "ZZ51SYNTHETIC000000", "zz50")], "v string").select(validators.iban(F.col("v")))
    assert [r[0] for r in i.collect()] == ["valid", "valid", "checksum", "malformed"]
    s = spark.createDataFrame([(x,) for x in ("890626879", "666121234", "12345678")], "v string").select(validators.ssn(F.col("v")))
    assert [r[0] for r in s.collect()] == ["valid", "unallocated", "malformed"]


def test_match_ranges_count_bytes(spark):
    r = spark.createDataFrame([("é 12 ü 345",)], "t string").select(ranges.match_ranges("t", "[0-9]+").alias("x")).first()["x"]
    assert [(y["start"], y["end"]) for y in r] == [(3, 5), (9, 12)]


def test_context_classes(spark):
    cases = [("API_KEY=", ""), ('  "dbPassword": "', '"'), ("--auth-token ", ""), ("build_id: ", ""), ("Authorization: Bearer ", ""), ("scheme://user:", "@host"), ("scheme://user:", " host"), ("see ", " here"), ("", "")]
    got = spark.createDataFrame(cases, "b string, a string").select(text.context_class(F.col("b"), F.col("a"))).collect()
    assert [r[0] for r in got] == ["credential-name", "credential-name", "credential-name", "other-name", "authorization-header", "url-userinfo", "other-name", "bare", "bare"]


def test_negative_classes_and_longest_token(spark):
    from spanwright.plans.candidates import CASES

    got = spark.createDataFrame(CASES, "b string, v string, a string").select(text.negative_class(F.col("v"), F.col("b"), F.col("a"))).collect()
    ref, env, cmd = "template-reference", "environment-reference", "command-substitution"
    assert [r[0] for r in got] == [ref, ref, env, env, env, cmd, cmd, "angle-placeholder", "mask", "none", "placeholder-vocabulary", "none", "dotted-reference", "none", "none"]
    t = spark.createDataFrame([("GITHUB_TOKEN=${GITHUB_TOKEN}",), ("é abcd",), (" \t\r\n",), ("",), ("ab [cd`ef|é日]",)], "t string").select(text.longest_token(F.col("t")).alias("r")).collect()
    assert [tuple(r["r"]) if r["r"] else None for r in t] == [(0, 12), (3, 7), None, None, (0, 2)]


def test_normal_form(spark):
    t = "Id 3F2504E0-4F89-11D3-9A0C-0305E82C3301 hash deadbee1 deadbeef v12 AbCdEfGhIjKlMnOpQrStUvWxYz"
    assert spark.createDataFrame([(t,)], "t string").select(text.normalize_values(F.col("t"))).first()[0] == "id  ⟨uuid⟩  hash  ⟨hex⟩  deadbeef v0  ⟨tok⟩ "


def test_scoped_controls(spark):
    controls = spark.createDataFrame([(1, "card"), (2, "card"), (3, None), (4, "card")], "doc_id long, scope_family string")
    found = spark.createDataFrame([("x", 1, "card", "warn"), ("x", 2, "email", "redact"), ("x", 3, "email", "warn"), ("x", 4, None, "warn"), ("x", 4, "email", "warn")], "scanner string, doc_id long, family string, action string")
    rows = scoring.score_controls(controls, found, spark.createDataFrame([("x",), ("y",)], "scanner string"))
    got = {(r["scanner"], r["doc_id"]): (r["findings"], r["flagged"], r["co_detected"], r["warned"]) for r in rows.collect()}
    assert got == {("x", 1): (1, True, False, 1), ("x", 2): (1, False, True, 0), ("x", 3): (1, True, False, 1), ("x", 4): (2, True, True, 2), **{("y", i): (0, False, False, 0) for i in range(1, 5)}}


def test_isotonic_and_thresholds(spark):
    cells = spark.createDataFrame([(1, 2, 1), (2, 2, 0), (3, 1, 1), (5, 2, 1), (7, 1, 1)], "score int, n long, y long")
    got = [(r["score"], round(r["fitted"], 4)) for r in calibration.isotonic(cells).orderBy("score").collect()]
    assert got == [(1, 0.25), (2, 0.25), (3, 0.6667), (5, 0.6667), (7, 1.0)]
    rows = [(s, True, False) for s in (6, 7, 8, 9)] + [(s, False, True) for s in (1, 1, 2, 3)]
    got = calibration.fit_thresholds(spark.createDataFrame(rows, "score int, positive boolean, independent boolean"), 3, 10).first().asDict()
    assert got == {"low": 2, "medium": 3, "high": 4}


def test_similar_pairs(spark):
    words = [f"word{chr(97 + i)}" for i in range(20)]
    docs = [(1, " ".join(words)), (2, " ".join(words[:19] + ["other"])), (3, " ".join(words[:8])), (4, "one"), (5, "One!"), (6, "")]
    got = {(r["a"], r["b"]): round(r["similarity"], 4) for r in independence.similar_pairs(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {(1, 2): round(17 / 19, 4), (4, 4): 1.0}


def test_near_copies_send_their_sets_once(spark):
    words = ["word" + chr(97 + k // 26 // 26) + chr(97 + k // 26 % 26) + chr(97 + k % 26) for k in range(800)]
    docs = [(i, " ".join(w for k, w in enumerate(words) if k != 19 * i + 3)) for i in range(40)] + [(40, " ".join(words[:500])), (41, "other words here"), (42, " ".join(words[:4])), (43, " ".join(words[:3]))]
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} for i, t in docs}
    want = {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6) for a in sets for b in sets if a < b and 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    found = independence.similar_pairs(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    rows = found.collect()
    assert {(r["a"], r["b"]): round(r["similarity"], 6) for r in rows} == want and len(rows) == len(want)
    assert "array_intersect" not in found._jdf.queryExecution().optimizedPlan().toString()  # no set is joined to each of its pairs


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long")
    assert {r["comp"] for r in independence.components(spark, edges).collect()} == {0}


def test_stream_equals_batch(spark, tmp_path):
    source = "/root/testdata/sf0.001/documents.parquet"
    docs = spark.read.parquet(source)
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    spans = lambda d: streaming.extract_stream(d.select("doc_id", "text", "source", F.octet_length("text").alias("bytes")))
    streaming.run_once(spark, str(tmp_path / "in"), docs.schema, spans, str(tmp_path / "state"), str(tmp_path / "out"))
    want, got = spans(docs), spark.read.parquet(str(tmp_path / "out"))
    assert want.exceptAll(got).count() == 0 == got.exceptAll(want).count()


def test_every_query_has_sql():
    assert set(catalog.ORACLE_SQL) == set(catalog.QUERIES)


def test_findings_of_a_second_version_differ(spark):
    docs = fx.documents(spark, "/root/testdata/sf0.001")
    truth = fx.spans(docs)
    assert fx.findings(docs, 2).exceptAll(fx.findings(docs, 1)).count() > 0
