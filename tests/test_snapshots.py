"""Stored cases, compared states and versions against expected rows."""

import glob
import os

from pyspark.sql import functions as F

from spanwright.operators import calibration, snapshots
from spanwright.sources import cases

ROW = "doc_id long, source string, kind string, tier string, text string, spans " + cases.SPANS


def test_parts_and_manifest(spark, tmp_path):
    span = {"family": "f", "start": 0, "end": 2, "env_start": None, "env_end": None}
    rows = spark.createDataFrame([(i, "s", "k", "T1", None if i == 3 else f"é{i}\n", [span] if i % 2 else []) for i in range(50)], ROW).repartition(2)
    path = str(tmp_path / "c")
    cases.write_parts(rows, path, most=10)
    back = cases.read_parts(spark, path)
    assert back.where("unreadable is not null").count() == 0
    assert sorted(map(str, back.drop("unreadable").collect())) == sorted(map(str, rows.collect()))
    assert cases.parts(spark, f"{path}/parts").agg(F.max("rows")).first()[0] == 10 and cases.part_problems(spark, path).count() == 0
    part = sorted(glob.glob(f"{path}/parts/part-*"))[0]
    with open(part, "a") as f:
        f.write("no json\n")
    os.remove(f"{path}/parts/.{os.path.basename(part)}.crc")
    assert [r["problem"] for r in cases.part_problems(spark, path).collect()] == ["changed"]
    assert [r["unreadable"] for r in cases.read_parts(spark, path).where("unreadable is not null").collect()] == ["no json"]


def test_case_problems(spark):
    spans = [("ok", 0, 2, None, None), ("cut", 1, 3, None, None), ("far", 0, 9, None, None), ("none", 2, 2, None, None), ("env", 2, 4, 3, 4)]
    rows = spark.createDataFrame([(1, "s", "k", "T1", "éabc", spans), (2, "s", "k", "T1", None, []), (2, "s", "k", "T1", "x", [])], ROW)
    assert {(r["doc_id"], r["family"], r["problem"]) for r in cases.case_problems(rows).collect()} == {
        (1, "cut", "inside-character"), (1, "far", "outside"), (1, "none", "empty"), (1, "env", "outside-envelope"), (2, None, "repeated-id"),
    }


def test_contrast(spark):
    a = spark.createDataFrame([(1, 1, None), (2, 2, "x"), (3, 3, "y")], "k int, n int, s string")
    b = spark.createDataFrame([(1, 1, None), (2, 2, None), (4, 4, "z")], "k int, n int, s string")
    assert {r["k"]: (r["state"], r["differing"]) for r in snapshots.contrast(a, b, ["k"], ["n", "s"]).collect()} == {1: ("same", []), 2: ("changed", ["s"]), 3: ("removed", []), 4: ("added", [])}


def test_versions_rounds_and_margins(spark):
    seen = spark.createDataFrame([("a", "v1.9", 1), ("a", "v1.10", 3), ("a", "v1.10", 2), ("b", "v2", 5)], "k string, v string, t int")
    assert {tuple(r) for r in snapshots.newest(seen, "k", "v", "t").collect()} == {("a", "v1.10", 2), ("b", "v2", 5)}
    assert [r["side"][0] for r in snapshots.round_order(spark.createDataFrame([("x", 4), ("y", 0)], "k string, n int"), "k", "n").orderBy("place").collect()] == list("bccbbccb")
    groups = spark.createDataFrame([("s", "x", 0.8, 0.9), ("s", "y", 0.6, 0.5), ("s", "z", 0.0, 0.0), ("s", "w", None, 0.9)], "s string, g string, point double, floor double")
    assert [tuple(r) for r in snapshots.lowest_margin(groups, "s", ["g"], "point", "floor").collect()] == [("s", "x", 0.8, 0.9, False)]


def test_bands_and_weights(spark):
    rows = [("a", 9, True, True, True), ("a", 1, True, True, True), ("a", 9, False, True, True), ("a", 9, False, False, True), ("a", 1, False, False, False)]
    x = spark.createDataFrame(rows, "g string, score int, positive boolean, independent boolean, measurable boolean")
    assert tuple(calibration.band_outcomes(x, 5, "g").first()) == ("a", 5, 0.8, 0.5, 1.0, 1.0)
    counts = spark.createDataFrame([(True, 30), (False, 10)], "generated boolean, n long")
    assert {r["generated"]: r["weight"] for r in calibration.half_weights(counts).collect()} == {True: 1.0, False: 3.0}
    assert {r["weight"] for r in calibration.half_weights(counts.where("generated")).collect()} == {1.0}
