"""Null and repeated ids, null, empty and long texts, clashing columns and empty tables, for each operator."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwright.llm import ann, language_id, licenses, mixing, ngram_join, piece_scan, pii, substring_dedup, token_store, topk

#: Names that operators use inside.
CLASHES = ["pii", "n_pii", "size", "row", "copy", "c", "d", "r", "count", "score", "lang_pred", "doc", "start", "hashes", "takes", "chunk", "base", "times"]


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with null and repeated ids, null and empty texts, a text of a megabyte, and columns of clashing names."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long = text(250_000)
    same = text(40)
    rows = [(1, text(60)), (1, text(30)), (2, same), (2, same), (3, None), (3, ""), (None, text(50)), (None, None), (4, long), (5, same), (6, "mail a.b@c.example.org and 4111 1111 1111 1111")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    table = [(i, t, "en", f"s{k % 2}", 0, *[f"{c}{k}" for c in CLASHES]) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(table, schema).repartition(3)


@pytest.fixture(scope="module")
def plain(odd):
    return {(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()}


def test_language_id(odd, plain):
    model = language_id.fit(odd.where("doc_id is not null"))
    got = language_id.identify(odd, model, prefix="new_").collect()
    assert {(r["doc_id"], r["text"]) for r in got} == plain and all(r["score"].startswith("score") for r in got)
    assert {r["new_lang_pred"] for r in got if not r["text"]} == {"und"}
    assert language_id.identify(odd.limit(0), model).count() == 0


def test_letters_marks_and_original_ranges(spark):
    model = language_id.fit(spark.createDataFrame([(1, "one two three", "en"), (2, "uno dos tres", "es")], "doc_id long, text string, lang string"))
    texts = ["́́", "\U00030001" * 5, "İstanbul one", "́one", "12 ́"]
    got = language_id.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, spans=True).orderBy("doc_id").collect()
    assert [r["lang_pred"] == "und" for r in got] == [True, False, False, False, True]
    assert (got[2]["lang_spans"][0]["start"], got[2]["lang_spans"][-1]["end"]) == (0, len(texts[2]))
    assert got[3]["lang_spans"][0]["start"] == 1


def test_substring_dedup(odd):
    got = substring_dedup.remove_repeats(odd).collect()
    assert len(got) == 11
    by = lambda i: sorted((r["n_words"], r["n_removed"]) for r in got if r["doc_id"] == i)
    assert by(1) == [(30, 0), (60, 0)] and by(2) == [(40, 0)] * 2 and by(5) == [(40, 40)] and by(3) == [(0, 0)] * 2
    assert by(None) == [(0, 0), (50, 0)] and by(4) == [(250_000, 0)]
    assert substring_dedup.remove_repeats(odd.limit(0)).count() == 0


def test_ids_far_apart_and_remembered_hashes(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i * 10**12 if i % 2 else i, f"{passage} a{i}") for i in range(40)]
    table = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    at_once = substring_dedup.AT_ONCE
    try:
        substring_dedup.AT_ONCE = 300
        got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(table).collect()}
    finally:
        substring_dedup.AT_ONCE = at_once
    assert got == {i: 0 if i == min(got) else 30 for i in got}


def test_memory_of_hashes():
    memory = substring_dedup.Memory()
    memory.add(np.array([5, 9], np.uint64), np.array([3, 4]))
    memory.add(np.array([9, 7], np.uint64), np.array([2, 8]))
    met, doc = memory.smallest(np.array([5, 6, 7, 9], np.uint64))
    assert met.tolist() == [True, False, True, True] and doc[met].tolist() == [3, 8, 2]


def test_token_store(odd):
    got = token_store.store_and_digest(odd, token_store.tokenizer_path()).orderBy("start").collect()
    assert len(got) == 11 and [r["doc_id"] for r in got][:2] == [None, None]
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]
    assert [r["n_tokens"] for r in got if r["doc_id"] == 3] == [1, 1]


def test_ngram_join(odd):
    got = ngram_join.near_duplicates(odd).collect()
    assert len(got) == 11
    by = lambda i: sorted(((r["class_id"], r["n_links"]) for r in got if r["doc_id"] == i), key=str)
    assert by(None) == [(None, 0)] * 2 and by(2) == [(2, 2)] * 2 and by(5) == [(2, 2)] and by(4) == [(4, 0)]
    assert ngram_join.near_duplicates(odd.limit(0)).count() == 0


def test_pseudonyms(odd, plain):
    got = pii.pseudonymise(odd).collect()
    assert len(got) == 11 and all(r["pii"].startswith("pii") and r["size"].startswith("size") for r in got)
    assert {(r["doc_id"], r["text"]) for r in got if r["n_pii"] == 0} == {p for p in plain if p[0] != 6} and [r["n_pii"] for r in got if r["doc_id"] == 6] == [2]
    assert pii.pseudonymise(odd.limit(0)).count() == 0


def test_long_values(spark):
    """Texts that a pattern could only follow by recursion, and values of any length."""
    secret = "Ab3" * 400
    cases = ["x@" + "a." * 500_000, "password=" + secret, "token: abc-def/ghi_jkl", "n" * 300 + "@example.org", "1 " * 50_000 + "x", "password=" + "a" * 1_000_000, "token: https://example.org"]
    got = [r["text"] for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got[0] == cases[0] and got[4] == cases[4] and got[6] == cases[6]
    assert got[1].startswith("password=") and secret[60:120] not in got[1] and len(got[1]) == len(cases[1])
    assert "def" not in got[2] and got[2][:7] == "token: " and got[2][10] == "-" and got[2][14] == "/"
    assert got[3].endswith("@example.org") and got[3] != cases[3] and got[5] != cases[5]


def test_dates_come_back_and_stay_apart(spark):
    """Every day of a year in both orders: pseudonyms are different, read the same way, and can be undone."""
    days = spark.sql("select explode(sequence(date'2019-12-20', date'2021-01-10')) as d")
    forms = days.select(F.explode(F.array(*[F.date_format("d", f) for f in ("MM/dd/yyyy", "dd/MM/yyyy", "dd.MM.yyyy", "yyyy-MM-dd")])).alias("v")).distinct()
    rows = forms.select("v", pii.pseudonym(F.col("v")).alias("p")).withColumn("u", pii.pseudonym(F.col("p"), undo=True)).collect()
    assert all(r["u"] == r["v"] for r in rows) and len({r["p"] for r in rows}) == len(rows)
    assert not [r for r in rows if (int(r["v"][3:5]) > 12 if "/" in r["v"] else False) != (int(r["p"][3:5]) > 12 if "/" in r["v"] else False)]


def test_licences(odd):
    assert licenses.scan(odd).count() == 11 and licenses.scan(odd.limit(0)).count() == 0


def test_mixing(odd):
    got = mixing.mix(odd).collect()
    assert len(got) == 11 and all(r["taken"] <= 2 * r["size"] for r in got)
    out = mixing.mixed_documents(odd)
    assert out.columns == odd.columns
    rows = out.collect()
    assert sum(len(r["text"].split()) for r in rows) == sum(r["taken"] for r in got) and all(r["n_chars"] == len(r["text"]) and r["copy"].startswith("copy") for r in rows)
    assert mixing.mixed_documents(odd.limit(0)).count() == 0


def test_taken_is_that_of_the_permuted_blocks(spark):
    """taken, recomputed by hand from the streams, the draws and the permutations."""
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randint(0, 90)), "abc"[i % 3]) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    light = mixing.placed(mixing.sizes(docs).where("size > 0")).collect()
    sources = mixing.with_targets(mixing.sizes(docs).groupBy("source").agg(F.sum("size").alias("source_size")))
    times = {(r["source"], r["block"]): r["times"] for r in mixing.taken_blocks(sources).collect()}
    assert max(times.values()) <= 2
    want = {r["doc_id"]: sum(times.get((r["source"], p // mixing.BLOCK), 0) for p in range(r["start"], r["start"] + r["size"])) for r in light}
    got = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()}
    assert got == {i: want.get(i, 0) for i, *_ in rows}
    for s in "abc":
        own = sorted((r["start"], r["start"] + r["size"]) for r in light if r["source"] == s)
        assert own[0][0] == 0 and all(a[1] == b[0] for a, b in zip(own, own[1:]))


def test_running_sums_in_parts(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 4)
    rows = [(k, i, i + 1) for k in ("a", None) for i in range(23)]
    got = mixing.running(spark.createDataFrame(rows, "k string, i long, v long"), "k", "i", "v", "before").collect()
    assert len(got) == 46 and all(r["before"] == r["i"] * (r["i"] + 1) // 2 for r in got)


def test_piece_scan(odd):
    got = piece_scan.encode_digest(odd, piece_scan.model_path()).collect()
    assert len(got) == 11 and all(r["round_trip"] for r in got)
    assert piece_scan.encode_digest(odd.limit(0), piece_scan.model_path()).count() == 0


def test_vectors(spark):
    rows = [(i % 30 if i < 60 else None, [float(i % 30), 1.0, float(-i % 7)], "x", 1, 2) for i in range(70)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string, rank int, ids int")
    for got in (topk.exact_topk(table).collect(), ann.nearest(table).collect()):
        assert {r["query_id"] for r in got} == {0, 20} and max(r["rank"] for r in got) == 20
    assert ann.nearest(table.limit(0)).count() == 0


def test_products_of_large_components(spark):
    """Sums that doubles cannot hold, and those that saturate long."""
    for size in (2.0**19, 2.0**26, 2.0**45):
        x = np.floor(np.random.default_rng(int(size)).uniform(-size, size, (60, 64))).astype("f4").astype(float)
        table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
        ints = [[int(64 * v) for v in row] for row in x]
        got = [(r["query_id"], r["vec_id"], r["score"]) for r in topk.exact_topk(table).orderBy("query_id", "rank").collect()]
        want = []
        for q in (0, 20, 40):
            scores = [(-max(1 - 2**63, min(2**63 - 1, sum(a * b for a, b in zip(ints[q], ints[j])))), j) for j in range(60) if j != q]
            want += [(q, j, -s) for s, j in sorted(scores)[:20]]
        assert got == want
