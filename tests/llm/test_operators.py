"""Each operator against a brute-force version, and on nulls, empty tables, ties and repeats."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwright.llm import ann, components, kernel, language_id, licenses, mixing, ngram_join, piece_scan, pii, substring_dedup, token_store, topk

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, extra int"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}" if i % 4 else None, 7) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    out = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 80))) for _ in range(60)]
    passage = out[3] + " " + out[4]
    for i in range(10, 30):
        out[i] = out[i] + "\n" + passage if i % 2 else out[i - 10].replace("a", "a", 1)
    near = " ".join(rng.choice(vocabulary) + str(k) for k in range(120)).split()
    for i in range(30, 45):
        own = list(near)
        own[i] = "x"
        out[i] = " ".join(own)
    return [*out, None, "", "a", "a b c", "a b c", "   \t\n"]


def test_words_are_those_of_the_pattern(texts):
    import pyarrow as pa

    words = kernel.Words(pa.array([*texts, "a b 　c\x0bd"]))
    got = [[words.data[s:e].tobytes().decode() for s, e in zip(words.start[i:j], words.end[i:j])] for i, j in zip(words.first[:-1], words.first[1:])]
    assert got == [WORD.findall(t or "") for t in [*texts, "a b 　c\x0bd"]]


def mirrored(n):
    """Two different words of n letters a and b that sum to equal polynomials modulo 2 ** 64 for every odd base."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_of_equal_polynomials_stay_apart(spark, n):
    import pyarrow as pa
    from tokenizers import Tokenizer

    one, two = mirrored(n)
    words = kernel.Words(pa.array([f"{one} {two} {one}"]))
    hashed = words.hashes()
    assert hashed[0] == hashed[2] != hashed[1] and words.hashes(kernel.OTHER_SEED)[0] not in hashed
    assert kernel.equal_segments(words.data, words.start, words.end, np.zeros(3, int)).tolist() == [True, False, True]
    around = " ".join(f"w{i}" for i in range(6))
    table = docs(spark, [f"{around} {one} {around}", f"{around} {two} {around}"])
    assert {r["n_removed"] for r in substring_dedup.remove_repeats(table).collect()} == {0}
    five = docs(spark, [f"a b {one} c d", f"a b {two} c d"])
    assert {r["n_links"] for r in ngram_join.near_duplicates(five).collect()} == {0}
    tokenizer = Tokenizer.from_file(token_store.tokenizer_path())
    texts = [f"one {one} two", f"one {two} two"]
    got = [r["n_tokens"] for r in token_store.store_and_digest(docs(spark, texts).coalesce(1), token_store.tokenizer_path()).orderBy("start").collect()]
    assert got == [len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for t in texts]


def test_hash_depends_on_every_byte():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, 200, np.uint8)
    for size in (1, 7, 8, 9, 16, 17, 63, 64, 65, 150):
        variants = [base[:size]] + [np.where(np.arange(size) == i, base[:size] ^ 1, base[:size]) for i in range(size)]
        data = np.concatenate(variants)
        starts = np.arange(len(variants)) * size
        assert len(set(kernel.segment_hashes(data, starts, starts + size).tolist())) == len(variants)
        assert kernel.equal_segments(data, starts, starts + size, np.zeros(len(variants), int)).tolist() == [True] + [False] * size


def test_segments_of_equal_hash_are_compared(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_store, "segment_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64) % np.uint64(3))
    texts = ["one two six ten", "six one, two ten", "one two six ten"]
    path = token_store.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    assert token_store.encode(pa.array(texts), path).to_pylist() == [[*tokenizer.encode(t, add_special_tokens=False).ids, 0] for t in texts]


def test_substring_dedup(spark, texts):
    seen, want = {}, {}
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        for p in range(len(w) - 12):
            seen.setdefault(tuple(w[p : p + 13]), i)
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        gone = set()
        for p in range(len(w) - 12):
            if seen[tuple(w[p : p + 13])] < i:
                gone |= set(range(p, p + 13))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(docs(spark, texts)).collect()}
    assert got == want and any(x[1] for x in want.values())
    assert substring_dedup.remove_repeats(docs(spark, texts).limit(0)).count() == 0


def test_ngram_join(spark, texts):
    sets = []
    for t in texts:
        w = WORD.findall(t or "")
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    n = len(sets)
    link = {(i, j) for i in range(n) for j in range(n) if i != j and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    root = list(range(n))
    for _ in range(n):
        for i, j in link:
            root[i] = root[j] = min(root[i], root[j])
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.near_duplicates(docs(spark, texts)).collect()}
    assert got == {i: (root[i], sum((i, j) in link for j in range(n))) for i in range(n)}
    assert ngram_join.near_duplicates(docs(spark, texts).limit(0)).count() == 0


def test_links_with_empty_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 120)
    words = [f"w{i}" for i in range(100)]
    near = [" ".join(words), " ".join([*words[:-1], "x"])]
    got = ngram_join.near_duplicates(docs(spark, near)).collect()
    assert [(r["class_id"], r["n_links"]) for r in got] == [(0, 1)] * 2
    table = {"rep": [0, 1], "copies": [1, 1], "side": [1, 1], "grams": [[*range(100)], [*range(1, 101)]]}
    import pyarrow as pa

    counts = [ngram_join._verify(pa.table({**table, "alone": [alone] * 2}), 0.8).column("links").to_pylist() for alone in (True, False)]
    assert counts == [[1, 1], [0, 0]]


def test_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 6)
    base = [f"w{k}" for k in range(100)]
    rows = []
    for i in range(40):
        own = list(base)
        own[i] = f"x{i}"
        rows.append(" ".join(own))
    got = ngram_join.near_duplicates(docs(spark, rows)).collect()
    assert {(r["class_id"], r["n_links"]) for r in got} == {(0, 39)}


def test_bands_reach_the_recall():
    bands, rows = ngram_join.choose_bands(0.8, 0.999, 128)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 and bands * rows <= 128


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["comp"] for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100}


def vectors(spark, n=300, dim=12):
    x = np.random.default_rng(1).standard_normal((n, dim)).astype("f4")
    x[50:90] = x[20]
    rows = [(i, [float(v) for v in x[i]], 1) for i in range(n)]
    return spark.createDataFrame([*rows, (900, None, 1), (901, [float("nan")] * dim, 1), (902, [None] * dim, 1), (903, [0.0] * dim, 1), (904, [1.0] * 3, 1)], "vec_id long, embedding array<float>, label int"), x


def brute(x, ids, k):
    score = x @ x.T
    return {(int(q), r + 1): int(ids[j]) for a, q in enumerate(ids) if q % 20 == 0 for r, j in enumerate(sorted((j for j in range(len(ids)) if j != a), key=lambda j: (-score[a, j], ids[j]))[:k])}


def test_exact_topk(spark):
    table, x = vectors(spark)
    ints = np.vstack([np.floor(64 * x.astype("f8")), np.zeros((1, x.shape[1]))])
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in topk.exact_topk(table).collect()}
    assert got == brute(ints, [*range(300), 903], 20)
    assert topk.exact_topk(table.limit(0)).count() == 0


def test_repeated_rows_in_several_packs(spark, monkeypatch):
    from spanwright.llm import vector_blocks

    monkeypatch.setattr(vector_blocks, "PACK", 64)
    table, x = vectors(spark)
    many = table.unionByName(table).unionByName(table.where("vec_id = 20").crossJoin(spark.range(25)).drop("id"))
    ints = np.vstack([np.floor(64 * x.astype("f8")), np.zeros((1, x.shape[1]))])
    rows = topk.exact_topk(many).collect()
    assert {(r["query_id"], r["rank"]): r["vec_id"] for r in rows} == brute(ints, [*range(300), 903], 20) and len(rows) == 15 * 20
    near = ann.nearest(many).collect()
    full = {q: [r["vec_id"] for r in near if r["query_id"] == q] for q in range(0, 300, 20)}
    assert all(len(v) == len(set(v)) == 20 for v in full.values())
    want = brute(x.astype("f8"), range(300), 20)
    assert len({((r["query_id"], r["rank"]), r["vec_id"]) for r in near} & set(want.items())) >= 0.9 * len(want)


def test_coordinate_pruning_loses_nothing():
    rng = np.random.default_rng(3)
    a = rng.integers(-60, 60, (8, 6))
    b = np.concatenate([a * 2, rng.integers(-90, 90, (500, 6))])
    best = [(np.zeros(0, np.int64), np.zeros(0))] * 8
    from spanwright.llm.vector_blocks import merge

    ids = np.array([[i] for i in range(len(b))], object)
    for i, rows, scores in topk._scan(a, topk._prepare(b), 5, best, np.full(8, -1), ids):
        best[i] = merge(best[i], rows, scores, ids, -1, 5)
    for i in range(8):
        assert list(best[i][0]) == sorted(range(len(b)), key=lambda j: (-(a[i] @ b[j]), j))[:5]


@pytest.mark.parametrize("size", [1e20, 3e38])
def test_nearest_of_large_components(spark, size):
    x = (np.random.default_rng(7).uniform(-1, 1, (120, 12)) * size).astype("f4")
    table = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(table, every=40).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    exact = x.astype(float) @ x.astype(float).T
    for q in (0, 40, 80):
        order = [i for i in np.argsort(-exact[q], kind="stable").tolist() if i != q][:20]
        assert len(got[q] & set(order)) >= 18


def test_nearest_recall(spark):
    table, x = vectors(spark)
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in ann.nearest(table).collect()}
    want = brute(x.astype("f8"), range(300), 20)
    assert len(set(got.items()) & set(want.items())) >= 0.9 * len(want) and 903 not in got.values()
    pack = ann.encode(x)
    value, wide = ann.estimate(x[:20], pack, slice(0, 300))
    assert (np.abs(value - x[:20] @ x.T) <= wide + 1e-4).mean() > 0.95


def test_language_spans_and_viterbi(spark):
    en, de = "the thing that was with them and then there", "der die und nicht schon über für eine straße"
    rows = spark.createDataFrame([(i, " ".join(random.Random(i).sample((en if i % 2 else de).split(), 6)), "en" if i % 2 else "de") for i in range(60)], "doc_id long, text string, lang string")
    model = language_id.fit(rows)
    asked = spark.createDataFrame([(1, en, 9), (2, de, 9), (3, None, 9), (4, "12 34", 9), (5, f"{en} {en} {de} {de}", 9), (6, "日本", 9)], "doc_id long, text string, score int")
    got = {r["doc_id"]: r for r in language_id.identify(asked, model, spans=True).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 4)] == ["en", "de", "und", "und"]
    assert [s["lang"] for s in got[5]["lang_spans"]] == ["en", "de"] and got[3]["score"] == 0
    assert language_id.fit(rows.limit(0)).langs == []
    rng = np.random.default_rng(2)
    scores, bounds = rng.standard_normal((700, 3)) * 3, np.array([0, 0, 5, 300, 700])
    want = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        value, back = np.zeros(3), []
        for t in range(a, b):
            stay = value >= value.max() - 2.0
            back.append((stay, value.argmax()))
            value = np.maximum(value, value.max() - 2.0) + scores[t]
        label, own = value.argmax(), []
        for stay, top in reversed(back):
            own.append(label)
            label = label if stay[label] else top
        want += own[::-1]
    assert list(language_id.viterbi(scores, bounds, 2.0, chunk=16)) == want


def test_token_store(spark, texts):
    from tokenizers import Tokenizer

    more = [*texts, "it's  a test ,x <|endoftext|> 　 y", "é à ü x\tz", "a<|endoftext|>,b. c ×, d÷. é, É! 3.14,15:9 x) \"y\" it's, we'll. 日本, . ,a ,, ..b  ,c\n,d", ", . ! x", " a", ".5", "a.", "\u00a0,x y\u2003, z."]
    path = token_store.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    at = 0
    got = {r["doc_id"]: r for r in token_store.store_and_digest(docs(spark, more), path).collect()}
    for i, t in enumerate(more):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_store.store_and_digest(docs(spark, more).limit(0), path).count() == 0


def test_orc_pruning_by_id(spark, texts, tmp_path):
    path = str(tmp_path / "t")
    token_store.write_tokens(docs(spark, texts), path, token_store.tokenizer_path())
    some = token_store.read_tokens(spark, path, [3, 5])
    assert {r["doc_id"] for r in some.collect()} == {3, 5}
    assert "PushedFilters: [In(doc_id" in some._jdf.queryExecution().toString()


def test_mixing(spark, texts):
    rows = {r["doc_id"]: r for r in mixing.mix(docs(spark, texts)).collect()}
    size = {i: len(WORD.findall(t or "")) for i, t in enumerate(texts)}
    assert {i: r["size"] for i, r in rows.items()} == size and all(r["taken"] <= 2 * r["size"] for r in rows.values())
    of = {i: f"s{i % 3}" if i % 4 else None for i in size}
    total = {s: sum(n for i, n in size.items() if of[i] == s) for s in {*of.values()}}
    order = sorted((s for s in total if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    capped: set = set()
    while True:
        left = 1.5 * sum(total.values()) - sum(2 * total[s] for s in capped)
        open_ = [s for s in order if s not in capped]
        target = {s: 2.0 * total[s] if s in capped else left * weight[s] / sum(weight[o] for o in open_) for s in order}
        over = {s for s in open_ if target[s] > 2 * total[s]}
        if not over:
            break
        capped |= over
    for i, r in rows.items():
        assert abs(r["target"] - target[of[i]]) < 1e-6 and r["source_size"] == total[of[i]]
    for s in order:
        assert abs(sum(r["taken"] for i, r in rows.items() if of[i] == s) - target[s]) <= 2 * mixing.BLOCK
    assert rows == {r["doc_id"]: r for r in mixing.mix(docs(spark, texts)).collect()}
    assert mixing.mix(docs(spark, texts).limit(0)).count() == 0
    out = mixing.mixed_documents(docs(spark, texts)).collect()
    assert sum(len(r["text"].split()) for r in out) == sum(r["taken"] for r in rows.values())


def test_permutation_is_one(spark):
    x = spark.range(1000).select(mixing.permuted(F.col("id"), F.lit(1000).cast("long"), F.lit(3)).alias("p"))
    assert sorted(r["p"] for r in x.collect()) == list(range(1000))


def test_pseudonyms(spark):
    values = ["re.46@mail8.example.com", "+1 (743) 555-3824", "4041 8949 7460 8795", "152.143.123.131", "890-62-6879", "2024-02-29", "password=b7db7aa4", "GB82WEST12345698765432"]
    clean = ["4041894974608796", "999.1.1.1", "666-12-1234", "2024-02-30", "version 2.0. of it", ""]
    table = spark.createDataFrame([(i, f"see {v}, and again {v}." if v else v, 1) for i, v in enumerate(values + clean)] + [(99, None, 1)], "doc_id long, text string, extra int")
    got = {r["doc_id"]: r for r in pii.pseudonymise(table).collect()}
    for i, v in enumerate(values):
        first, second = re.fullmatch(r"see (.*), and again (.*)\.", got[i]["text"]).groups()
        assert first == second != v and got[i]["n_pii"] == 2 and len(first) >= len(v) - 6
    for i, v in enumerate(clean, len(values)):
        assert got[i]["text"] == (f"see {v}, and again {v}." if v else v) and got[i]["n_pii"] == 0
    assert got[99]["text"] is None
    one = spark.createDataFrame([(v,) for v in values], "v string").select("v", pii.pseudonym(F.col("v")).alias("p"))
    assert all(r["v"] == r["u"] for r in one.withColumn("u", pii.pseudonym(F.col("p"), undo=True)).collect())


def test_pseudonyms_next_to_other_digits(spark):
    """Values among digits, grouped and separated forms: what must be gone, what must stay and how many are replaced."""
    card = "4111 1111 1111 1111"
    cases = [
        (f"{card} 12/27", [card], "12/27", 1), (f"{card} 123", [card], " 123", 1), ("4111111111111111 123", ["4111111111111111"], " 123", 1), ("12 4111111111111111", ["4111111111111111"], "12 ", 1),
        ("4111111111111111 5500005555555559", ["4111111111111111", "5500005555555559"], "", 2), (f"{card} 890-62-6879", [card, "890-62-6879"], "", 2), (f"{card} 10.1.2.3", [card, "10.1.2.3"], "", 2),
        (f"{card} 555-123-4567", [card, "555-123-4567"], "", 2), (f"{card} 2024-02-29", [card, "2024-02-29"], "", 2), (f"{card} 2nd", [card], " 2nd", 1),
        ("GB82 WEST 1234 5698 7654 32", ["1234 5698 7654 32"], "WEST", 1), ("BE68 5390 0754 7034 THIS IS", ["5390 0754 7034"], " THIS IS", 1),
        ("2024-02-29T10:00", ["2024-02-29"], "T10:00", 1), ("(743) 555-3824", ["555-3824"], "", 1), ("743-555-3824", ["555-3824"], "", 1), ("+1-743-555-3824", ["743-555-3824"], "+1-", 1),
        ("+44 20 7946 0958", ["7946 0958"], "+44 ", 1), ("030 1234567", ["1234567"], "0", 1), ("+33 1 23 45 67 89", ["23 45 67 89"], "+33 ", 1), ("0171-1234567", ["1234567"], "0", 1),
        ("4111 1111 1111 1112 12", [], "4111 1111 1111 1112 12", 0), ("DE89 3704 0044 0532 0130 01", [], "DE89 3704 0044 0532 0130 01", 0),
    ]
    table = spark.createDataFrame([(i, f"see {t}, so") for i, (t, *_) in enumerate(cases)] + [(99, "12 " * 30000 + "4111111111111111")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.pseudonymise(table).collect()}
    for i, (t, gone, stays, n) in enumerate(cases):
        out = got[i]["text"]
        assert not [g for g in gone if g in out] and stays in out and got[i]["n_pii"] == n, (t, out, got[i]["n_pii"])
    assert "4111111111111111" not in got[99]["text"] and got[99]["n_pii"] >= 1
    alone = spark.createDataFrame([(c,) for c in ("GB82 WEST 1234 5698 7654 32", "743-555-3824", "030 1234567", "01 23 45 67 89", "+44 20 7946 0958")], "v string").select("v", pii.pseudonym(F.col("v")).alias("p"))
    assert all(r["v"] == r["u"] != r["p"] for r in alone.withColumn("u", pii.pseudonym(F.col("p"), undo=True)).collect())


def test_licences(spark):
    rng = random.Random(1)
    filler = ["\n".join(" ".join(f"word{rng.randint(0, 300)}" for _ in range(12)) for _ in range(5)) for _ in range(40)]
    asked = [*filler, "x y\nReleased under the MIT License.", "Licensed under CC BY-NC 4.0.", "This is licensed under the Foo Bar terms of 1999 by Baz", None, ""]
    got = [r["families"] for r in licenses.scan(docs(spark, asked)).orderBy("doc_id").collect()]
    unknown = [r["n_unknown"] for r in licenses.scan(docs(spark, asked)).orderBy("doc_id").collect()]
    assert got[:40] == [""] * 40 and got[40:] == ["mit", "cc-by-nc", "", "", ""] and unknown[42] == 1 and sum(unknown) == 1


def test_wrapped_licences_and_prose(spark):
    """Hard-wrapped statements, one in a very long line, comment marks, and prose that only holds licence words."""
    rng = random.Random(2)
    prose = lambda n: " ".join(rng.choice("house river garden letter winter market people evening street bread music doctor".split()) for _ in range(n))
    filler = ["\n".join(prose(14) for _ in range(4)) for _ in range(60)]
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software"
    gpl = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version."
    bsd = prose(30) + "\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n" + prose(20)
    asked = [mit, gpl, bsd, prose(4000) + " Licensed under the Apache License, Version 2.0. " + prose(4000), "the licence of the shop was renewed and the rights of the tenants", "a notice about the public market and the terms of the winter " + prose(30)]
    rows = licenses.scan(docs(spark, [*filler, *asked])).orderBy("doc_id").collect()
    assert [r["families"] for r in rows] == [""] * 60 + ["mit", "gpl", "bsd", "apache-2.0", "", ""]
    assert [r["n_statements"] for r in rows][:60] == [0] * 60 and [r["n_unknown"] for r in rows][-2:] == [0, 0]


def test_licence_model_ignores_the_layout(spark):
    table = docs(spark, [" ".join(f"word{(i * k) % 97}" for k in range(30)) for i in range(80)])
    a, b = licenses.fit(table), licenses.fit(table.repartition(7))
    assert (a.weights == b.weights).all() and a.threshold == b.threshold < 1 and a.rejected < 0.1


def test_piece_scan(spark, texts):
    path = piece_scan.model_path()
    more = [*texts, "x" * 400 + "  y   z " * 9, "日本語" * 60, " lead  and trail  " * 9]
    sp = piece_scan.Pieces.of(path).sp
    for giant, chunk in ((65536, 16384), (50, 64)):
        got = {r["doc_id"]: r for r in piece_scan.encode_digest(docs(spark, more), path, giant, chunk).collect()}
        for i, t in enumerate(more):
            ids = np.array(sp.encode(t or ""), "<u4")
            assert (got[i]["n_tokens"], got[i]["ids_crc32"], got[i]["round_trip"]) == (len(ids), zlib.crc32(ids.tobytes()), True)


def test_crc_join():
    a, b = b"some bytes", b"and more of them"
    assert piece_scan.crc_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_forms_of_personal_data(spark):
    """Values in clear before, each replaced in its own format, undone again, and lookalikes that stay."""
    values = [
        '{"password": "hunter2hunter2"}', "pwd=hunter2hunter2", "api-key: abcd1234efgh", "Bearer eyJhbGciOi.J9-xyz1", "ghp_" + "a1B2c3D4e5" * 4, "http://user:secretpass1@host/", "5/3/1980", "12/25/1980", "3/15/1980", "1.12.2001",
        "1980/03/05", "2001:db8::1", "2001:db8:0:1:2:3:4:5", "fe80::1ff:fe23", "müller@example.de", "жанна.1@example.org", "'client_secret' = 'q9w8e7r6t5'",
    ]
    stay = ["std::vector", "cafe::bed", "12:30:45", "a ratio of 3/4/5", "Bearer certificates are old", "31/31/1980", "the password is not here", "x@y"]
    rows = spark.createDataFrame(list(enumerate(values + stay)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.pseudonymise(rows).collect()}
    for i, v in enumerate(values):
        new = got[i]["text"]
        assert new != v and got[i]["n_pii"] == 1, v
        shape = lambda t: re.sub(r"[0-9A-Za-z\u00C0-\u04FF]+", "w", t)
        assert shape(new) == shape(v), (v, new)
    assert not any(x in got[i]["text"] for i, x in ((0, "hunter2"), (1, "hunter2"), (5, "secretpass"), (14, "mül"), (15, "жан")))
    assert [got[len(values) + k]["text"] for k in range(len(stay))] == stay
    assert got[14]["text"].endswith("@example.de") and got[5]["text"].startswith("http://user:") and got[5]["text"].endswith("@host/") and got[4]["text"].startswith("ghp_")
    undone = pii.pseudonymise(spark.createDataFrame([(1, "5/3/1980"), (2, "müller@example.de"), (3, "2001:db8::1"), (4, "3/15/1980")], "doc_id long, text string")).select("doc_id", pii.pseudonym(F.col("text"), undo=True).alias("t")).orderBy("doc_id").collect()
    assert [r["t"] for r in undone] == ["5/3/1980", "müller@example.de", "2001:db8::1", "3/15/1980"]


def test_licences_as_they_are_written(spark):
    model = licenses.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    named = {
        "SPDX-License-Identifier: MIT": "mit", "SPDX-License-Identifier: Apache-2.0": "apache-2.0", "licensed under GPL-2.0-only": "gpl", "GNU General Public License v2": "gpl", "BSD 2-Clause": "bsd", "Released under the Apache license": "apache-2.0",
        "Licensed under the MPL 2.0": "mpl", "covered by the Artistic License 2.0": "artistic", "CC-BY-NC-ND 4.0": "cc-by-nc-nd",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.": "mit",
        "Licensed under the Foobar Terms": "unknown",
    }
    clean = ["ich gehe mit dem Hund in die Stadt und mit dir", "This is a plain sentence about the weather and a public park", "the software was slow in this version"]
    rows = spark.createDataFrame(list(enumerate([*named, *clean])), "doc_id long, text string")
    got = {r["doc_id"]: [f["family"] for f in r["found"]] for r in licenses.statements(rows, model).collect()}
    assert [got[i] for i in range(len(named))] == [[f] for f in named.values()] and not any(got[len(named) + k] for k in range(len(clean)))
    assert model.rejected < 0.1
