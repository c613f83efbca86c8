"""Cases of the findings of rounds 3 and 4."""

import random
import time

import duckdb
from pyspark.sql import functions as F

from spanwright import catalog
from spanwright.functions import text as tx
from spanwright.functions.ranges import match_ranges
from spanwright.operators import edits, independence
from spanwright.sources import cases, fixtures as fx
from spanwright.streaming import chunks

VALUE = "19.37.233.111"


def _both(spark, tmp_path, name, rows):
    """Rows of a query over made documents, and those of its SQL."""
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    out = catalog.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    return sorted(map(repr, (tuple(r[c] for c in names) for r in out.collect()))), sorted(map(repr, want.fetchall()))


def test_ids_that_stand_twice_in_a_union_of_joins(spark):
    """joined without broadcast, both sides of the union count as dealt by id."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.createDataFrame([(i, f"text {i}", "s1") for i in range(40)], "doc_id long, text string, source string")
        truth = docs.select("doc_id", F.lit("x").alias("family"), F.lit(0).alias("start"), F.lit(2).alias("end"), F.lit(None).cast("int").alias("env_start"), F.lit(None).cast("int").alias("env_end"))
        rows = cases.cases(docs, truth, docs.select("doc_id", "source", F.lit("k").alias("kind"), F.lit("T1").alias("tier")))
        found = cases.case_problems(rows.unionByName(rows.where("doc_id % 9 = 4"))).collect()
        assert sorted(r["doc_id"] for r in found) == [4, 13, 22, 31] and {r["problem"] for r in found} == {"repeated-id"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_twins_of_texts_that_begin_or_end_with_a_value(spark, tmp_path):
    """edits of the context aren't beside a value."""
    texts = [VALUE, f"{VALUE} and more words here", f"ab {VALUE}", f"1234567890123456, {VALUE}", f"a b c d e f g h i j k l {VALUE}, {VALUE}", f"{'x y ' * 900}{VALUE}{' z' * 900}"]
    rows = [(10 * n + way, t, "s1") for n, t in enumerate(texts) for way in range(10)]
    got, want = _both(spark, tmp_path, "twin_edits", rows)
    assert got == want and len(got) == len(rows)


def test_twins_of_values_whose_characters_repeat(spark, tmp_path):
    """F1 of round 4: a run at a value's beginning doesn't make three edits of two, one that goes on after it doesn't move an edit out of it, and a long value is compared."""
    texts = ["5555512345678901", "x" * 30 + " " + "0" * 18, "ab 10.0.0.12000 c", "aaaaaa.36@a.example.c", f"see {'ab' * 2000}.36@a.example.c", f"1¤¤¤¤.!é0😀1a-!😀11§§ {VALUE}"]
    rows = [(10 * n + way, t, "s1") for n, t in enumerate(texts) for way in range(10)]
    got, want = _both(spark, tmp_path, "twin_edits", rows)
    assert got == want and len(got) == len(rows)


def test_replays_of_two_versions(spark, tmp_path):
    """the second replay is of the scanners' second version, so cut gives other findings."""
    got, want = _both(spark, tmp_path, "replay_stability", [(n, f"ab {VALUE} c", "s1") for n in range(30)])
    assert got == want and [r for r in got if "cut" in r] == ["('cut', 2, 'unstable')"]


def _evaluations(df, mark):
    """How often an expression stands in the optimized plan."""
    return df._jdf.queryExecution().optimizedPlan().toString().count(mark)


def test_texts_are_searched_once(spark):
    """a filter on what is found doesn't search again, and a lambda doesn't search once a match."""
    spark.conf.set("spark.sql.maxPlanStringLength", "10000000")
    d = spark.createDataFrame([(1, "ab 1.2.3.4 c", "s1", 12)], "doc_id long, text string, source string, bytes int")
    assert _evaluations(fx.measured(d).where("size(truth) > 0").select("doc_id", "truth"), "RLIKE") == len(fx.PATTERNS)
    token = tx.once(d, "t", tx.longest_token(F.col("text"))).where("t is not null").select("t.start", "t.end")
    assert _evaluations(token, "split(") == 1 and tuple(token.first()) == (3, 10)
    assert _evaluations(d.select(match_ranges(F.col("text"), "[0-9]+").alias("r")), "regexp_extract_all(") == 1


def test_bytes_are_taken_once(spark):
    """the bytes of a text are taken outside of what is done once a step or chunk."""
    d = spark.createDataFrame([("xaé", "xaèy")], "a string, b string")
    one = d.select(edits.changed_range(F.col("a"), F.col("b")).alias("r"))
    assert _evaluations(one, "cast(a") == 1 and tuple(one.first()["r"]) == (3, 4, 5)
    cut = chunks.cut(spark.createDataFrame([(1, "aébc")], "doc_id long, text string"), 2)
    assert _evaluations(cut, "cast(text") == 1 and [bytes(r["chunk"]) for r in cut.orderBy("k").collect()] == [b"a\xc3", b"\xa9b", b"c"]


def test_chunks_cost_no_group_of_their_own(spark):
    """F2 of round 4: a task reads its documents' chunks one after the other, and a long open line isn't copied and searched again with each chunk."""
    line = f"ab {VALUE} c\n"
    rows = [(1, 1, b" c", True), (1, 0, f"ab {VALUE}".encode(), False), (1, 0, f"ab {VALUE}".encode(), False), (2, 0, line.encode(), False), (2, 2, line.encode(), True), (3, 0, (line + VALUE).encode(), False), (4, 0, b"", True), (None, 0, VALUE.encode(), True)]
    out = chunks.values(spark.createDataFrame(rows, "doc_id long, k int, chunk binary, last boolean").repartition(3))
    assert "InPandas" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(out.collect(), key=str) == sorted([(1, "ipv4", 3, 16, None, None), (2, "ipv4", 3, 16, None, None), (3, "ipv4", 3, 16, None, None), (None, "ipv4", 0, 13, None, None)], key=str)
    reader, piece, began = chunks.Reader(), b"x" * 97, time.process_time()
    found = [f for k in range(60_000) for f in reader.take(k, piece, False)] + list(reader.take(60_000, f" {VALUE}".encode(), True))
    assert found == [("ipv4", 97 * 60_000 + 1, 97 * 60_000 + 14, None, None)] and time.process_time() - began < 20


def test_a_large_group_of_near_copies_is_compared_by_blocks(spark, tmp_path, monkeypatch):
    """F3 of round 4: pairs of a large group aren't written or shuffled, and none is lost or comes out twice, within blocks, between them and beside them."""
    kept, wrote, rng = independence.written, {}, random.Random(5)

    def counted(df, name):
        wrote[name] = kept(df, name)
        return wrote[name]

    monkeypatch.setattr(independence, "written", counted)
    monkeypatch.setattr(independence, "HEAVY", 12, raising=False)
    monkeypatch.setattr(independence, "BLOCK", 16, raising=False)
    monkeypatch.setattr(independence, "BLOCK_SHINGLES", 2000, raising=False)
    monkeypatch.setattr(independence, "WIDE", 64, raising=False)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base, texts = [word() for _ in range(120)], []
    for _ in range(90):  # one large group, of which some are at the threshold
        share = rng.choice([0.01, 0.03, 0.1, 0.15])
        texts.append(" ".join(w if rng.random() > share else word() for w in base))
    for _ in range(6):  # linked with each other by light shingles, one side in a block
        words = [word() for _ in range(60)]
        texts += [" ".join(words), " ".join([*words, *base[:24]])]
    texts += ["one two three", "one two three four", "one two three", *["x y z " * k for k in range(1, 40)], *[" ".join(word() for _ in range(50)) for _ in range(60)]]
    rng.shuffle(texts)
    got, want = _both(spark, tmp_path, "near_duplicate_pairs", [(n, t, "s1") for n, t in enumerate(texts)])
    assert got == want and len(got) > 1000 and wrote["pairs"].count() < len(got) / 5
