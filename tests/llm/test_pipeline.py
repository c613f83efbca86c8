"""The pipeline's stages on a small table."""

import corpus_pipeline
import pytest

from spanwright.llm.storage import written

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark):
    en = "the thing that was with them and then there was another thing with that".split()
    rows = [(i, " ".join(en[(i * k) % len(en)] + str(k % (i + 2)) for k in range(40)), "en", f"s{i % 2}", 1) for i in range(24)]
    rows += [(50, rows[3][1], "en", "s0", 1), (51, rows[3][1], "en", "s0", 1), (60, None, None, None, None), (61, "12 34", None, "s1", 5), (62, "mail re.46@mail8.example.com now with the thing that was there", "en", "s1", 1)]
    docs, out = spark.createDataFrame(rows, DOCS), []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, ""), f"test-{name}")
        out.append(docs)
    return out


def test_language_stage_drops_texts_without_letters(stages):
    kept = {r["doc_id"] for r in stages[0].collect()}
    assert not kept & {60, 61} and {*range(24), 50, 51, 62} == kept


def test_duplicate_stage_keeps_the_smallest_id(stages):
    kept = {r["doc_id"] for r in stages[1].collect()}
    assert 3 in kept and not kept & {50, 51} and 62 in kept


def test_values_are_replaced(stages):
    assert "re.46@" not in next(r["text"] for r in stages[2].collect() if r["doc_id"] == 62)


def test_mix_and_encoding(stages):
    assert all(s.columns == ["doc_id", "text", "lang", "source", "n_chars"] for s in stages[:4])
    assert stages[3].count() == stages[4].count() and all(r["round_trip"] for r in stages[4].collect())


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, ""), f"empty-{name}")
    assert docs.count() == 0
