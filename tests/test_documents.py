"""Vectors of values, rendered texts and corpus checks against expected ones."""

import pytest
from pyspark.sql import functions as F

from spanwright.functions import features
from spanwright.operators import corpus, rendering

# Published vectors of the definition.
VECTORS = [
    ("", ",".join(["0"] * 30)),
    ("aaaaaaaaaaaaaaaa", "16,16,0,1,16,0,0,0,16,0,0,0,0,0,1,0,26,0,0,62,62,16,1000,933,1,1000,2,1,0,0"),
    ("abcabcabcabcabcabc", "18,18,0,3,6,103872,103872,1869696,18,0,0,0,0,0,1,0,26,1000,337,166,70,1,0,823,3,1000,3,4,65536,65536"),
    ("XXXX-XXXX-XXXX-XXXX", "19,19,0,2,16,41239,16248,783541,0,16,0,3,0,0,2,6,58,629,107,105,74,4,666,833,5,1000,5,2,65536,65536"),
    ("Q7vK2mZp9LxR4tWb8NcY3hJd6FsG1eUa", "32,32,0,32,1,327680,327680,10485760,12,12,8,0,0,0,3,31,62,1000,839,1000,125,1,0,0,0,0,0,32,327680,327680"),
    ("\U0001f600a\U0001f603b\U0001f600a\U0001f603b", "20,8,0,4,2,131072,131072,1048576,4,0,0,0,0,4,2,7,28,1000,416,500,31,1,0,428,4,1000,4,6,125718,103872"),
    ("ab", "2,2,0,2,1,65536,65536,131072,2,0,0,0,0,0,1,0,26,1000,212,1000,7,1,0,0,0,0,0,2,65536,65536"),
    ("aabc", "4,4,0,3,2,98304,65536,393216,4,0,0,0,0,0,1,0,26,946,319,750,15,2,333,0,0,0,0,2,65536,65536"),
]
RESIDUALS = [("aaaa", 1), ("acegik", 2), ("97531", 2), ("aZbYcXdW", 4), ("Qv7-Qv7-", 6), ("Qv7-k", 5), ("".join(chr(0x1F600 + i) for i in range(16)), 2)]


def test_logarithms():
    assert [features.log2_q16(x) for x in (0, 1, 3, 5, 10, 62, 255, 1 << 20)] == [0, 0, 103872, 152169, 217705, 390214, 523917, 20 << 16]


def test_vectors(spark):
    values = [v for v, _ in VECTORS] + [v for v, _ in RESIDUALS] + ["ab" * 400, None]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string").select("i", features.evidence(F.col("v")).alias("x")).orderBy("i").collect()
    assert [",".join(map(str, r["x"])) for r in rows[: len(VECTORS)]] == [x for _, x in VECTORS]
    assert [r["x"][27] for r in rows[len(VECTORS) : -2]] == [n for _, n in RESIDUALS]
    long = dict(zip(features.NAMES, rows[-2]["x"], strict=True))
    assert (long["byte_len"], long["analysed_chars"], long["truncated"], long["smallest_period"]) == (800, 256, 1, 2)
    assert rows[-1]["x"] is None


@pytest.mark.parametrize(
    ("spans", "expected"),
    [([], "é key=abc end"), ([(7, 10)], "é key=<SECRET_1> end"), ([(7, 10), (8, 14), (11, 14)], "é key=<SECRET_1> <SECRET_2>"), ([(1, 2)], "�<SECRET_1> key=abc end"), (None, "é key=abc end")],
)
def test_render(spark, spans, expected):
    rows = spark.createDataFrame([("é key=abc end", spans)], "t string, s array<struct<start:int,end:int>>")
    assert rows.select(F.make_valid_utf8(rendering.render(F.col("t"), F.col("s")).cast("string")).alias("o")).first()["o"] == expected


def test_what_is_left_and_outcomes(spark):
    docs = spark.createDataFrame([(1, "k=abc, abc"), (2, "v=xyz")], "doc_id long, text string")
    truth = spark.createDataFrame([(1, "f", 2, 5, 0, 5), (2, "f", 2, 5, None, None)], "doc_id long, family string, start int, end int, env_start int, env_end int")
    found = spark.createDataFrame([("a", 1, 2, 5, "redact"), ("a", 2, 2, 5, "warn"), ("b", 1, 0, 5, "redact"), ("b", 2, 4, 5, "redact"), ("b", 1, 5, 6, "warn")], "scanner string, doc_id long, start int, end int, action string")
    out = {(r["scanner"], r["doc_id"]): (bytes(r["output"]).decode(), r["targets"][0]["leaked"]) for r in rendering.rendered(docs, truth, found, ["a", "b"]).collect()}
    assert out == {("a", 1): ("k=<SECRET_1>, abc", False), ("a", 2): ("v=xyz", True), ("b", 1): ("<SECRET_1>, abc", False), ("b", 2): ("v=xy<SECRET_1>", False)}
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "scanner string")
    states = {(r["scanner"], r["doc_id"]): r["outcome"] for r in rendering.target_outcomes(truth, found, names).collect()}
    assert states == {("a", 1): "exact", ("a", 2): "warn-only", ("b", 1): "envelope", ("b", 2): "partial", ("c", 1): "miss", ("c", 2): "miss"}
    assert [(r["scanner"], r["start"]) for r in rendering.unexpected(truth, found).collect()] == [("b", 5)]


def test_corpus_checks(spark):
    rows = spark.createDataFrame([(1, "x", "s"), (2, "x", "t"), (3, "y", "s"), (4, None, None)], "id long, group string, sha256 string")
    found = {r["axis"]: (r["n"], r["problem"]) for r in corpus.distribution(rows, "group", ["x", "z"], 1, 0.4).collect()}
    assert found == {"x": (2, "dominates"), "y": (1, "unknown"), "z": (0, "few"), None: (1, "unknown")}
    assert [tuple(r) for r in corpus.repeated(rows, "id", {"sha": F.col("sha256"), "group": F.col("group")}).orderBy("key").collect()] == [("group", 1, 2), ("sha", 1, 3)]
    frozen = spark.createDataFrame([(1, "x", "s"), (2, "q", "q"), (9, "x", "s")], "id long, group string, sha256 string")
    assert sorted(tuple(r) for r in corpus.frozen_problems(frozen, rows).collect()) == [(2, "edited"), (2, "regrouped"), (9, "removed")]
    assert corpus.distribution(rows.limit(0), "group", ["x"], 1, 0.4).collect()[0]["problem"] == "few"
