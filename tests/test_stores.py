"""Bundles of tables and documents in chunks."""

import random

import pytest
from pyspark.sql import functions as F

from spanwright.sources import bundles
from spanwright.sources import fixtures as fx
from spanwright.streaming import chunks


def test_interrupted_commits_leave_the_old_set(spark, tmp_path):
    root = str(tmp_path)
    one, two = spark.createDataFrame([(1, "a"), (2, None)], "i int, s string"), spark.createDataFrame([(3, "b")], "i int, s string")
    with pytest.raises(ValueError):
        bundles.resolve(spark, root)
    first, wrote = bundles.commit(spark, root, {"t": one, "u": two})
    assert wrote == 2 and bundles.commit(spark, root, {"u": two, "t": one.repartition(3)}) == (first, 0)
    second, _ = bundles.stage(spark, root, {"t": two})  # stops before the pointer
    assert second != first and bundles.resolve(spark, root)["t"].count() == 2
    (tmp_path / "pointers" / "9").mkdir()  # stops within it
    (tmp_path / "pointers" / "9" / "part-0.json").write_text('{"bundle": "x"}')
    assert sorted(map(tuple, bundles.resolve(spark, root)["t"].collect())) == [(1, "a"), (2, None)]
    bundles.commit(spark, root, {"t": two})
    assert bundles.resolve(spark, root)["t"].first()["i"] == 3 and bundles.resolve(spark, root, first)["t"].count() == 2
    assert bundles.problems(spark, root) == [] == bundles.problems(spark, root, first)
    of = bundles.digest(two)[0]
    one.select("i", "s").limit(1).write.mode("overwrite").parquet(f"{root}/objects/{of}")
    assert bundles.problems(spark, root) == [("t", "changed")]
    assert bundles.digest(one)[0] != bundles.digest(one.withColumn("i", F.col("i").cast("long")))[0]


TEXTS = ["mail ab.1@xy.example.org, é token = \"" + "a1" * 20 + "\"\n+1 (212) 555-0123 4111111111111111", "\n\n1.2.3.4\n", "", None, "nothing", "5.6.7.8" * 3]


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "family", "start", "end", "env_start", "env_end").collect()), key=str)


def test_every_cut_gives_the_values_of_the_whole(spark):
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(TEXTS)], "doc_id long, text string, source string")
    want = rows_of(fx.spans(docs.withColumn("bytes", F.octet_length("text"))))
    assert want
    for size in (1, 2, 3, 7, 16, 1000):
        assert rows_of(chunks.values(chunks.cut(docs, size))) == want


def test_chunks_in_any_order(spark):
    rng = random.Random(1)
    raw = TEXTS[0].encode()
    for _ in range(50):
        cuts = sorted(rng.sample(range(len(raw)), rng.randint(0, 9)))
        parts = [raw[a:b] for a, b in zip([0, *cuts], [*cuts, len(raw)])]
        order = list(range(len(parts)))
        rng.shuffle(order)
        reader, found = chunks.Reader(), []
        for k in order + order[:1]:
            found += reader.take(k, parts[k], k == len(parts) - 1)
        whole = list(chunks.Reader().take(0, raw, True))
        assert sorted(found, key=str) == sorted(whole, key=str) and reader.done


def test_stream_of_chunks(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(TEXTS)], "doc_id long, text string, source string")
    cut = chunks.cut(docs, 11)
    for part in (1, 0):  # later chunks come in an earlier batch
        cut.where(F.col("k") % 2 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(cut.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = chunks.values_stream(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert rows_of(spark.read.parquet(str(tmp_path / "out"))) == rows_of(fx.spans(docs.withColumn("bytes", F.octet_length("text"))))
