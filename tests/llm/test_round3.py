"""Spelling variants, the filter audit and suffix search against brute force, and their defined cases."""

import hashlib
import random
import re
import zlib
from itertools import permutations

import pytest

from spanwright.llm import filter_audit, spelling, suffix_search
from spanwright.llm.queries import ORACLE_SQL

CLASHES = ["n", "word", "part", "mask", "digest", "text_digest", "hits", "items", "n_hit", "near", "form", "rows", "first"]


def near(a, b):
    """Whether one code point was inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def joined_by_parts(words, cuts):
    """The pairs of near_words over parts of sorted words, with those found by the entries of shared nodes."""
    got, met = [], {}
    edges = [0, *cuts, len(words)]
    for i, j in zip(edges[:-1], edges[1:]):
        part = words[i:j]
        left = spelling._common(part[0], words[i - 1]) if i else -1
        right = spelling._common(part[-1], words[j]) if j < len(words) else -1
        reach = lambda w, edge, most: -1 if most < 0 else min(spelling._common(w, edge), most)
        shared = [max(reach(w, part[0], left), reach(w, part[-1], right)) for w in part]
        got += [tuple(sorted((part[x], part[y]))) for x, y in spelling.near_words(part, shared)]
        for w, h in zip(part, shared):
            for depth, before, after, letter, last in spelling._entries(w, h) if h >= 0 else []:
                met.setdefault((depth, before, after), []).append((w, letter, last))
    for own in met.values():
        got += [tuple(sorted((w, v))) for w, letter, last in own for v, other, _ in own if letter is not None and v != w and (w > v if other is not None else last)]
    return sorted(got)


@pytest.mark.parametrize("levels", [48, 1, 2, 3])
def test_trie_join(monkeypatch, levels):
    monkeypatch.setattr(spelling, "LEVELS", levels)
    rng = random.Random(levels)
    for _ in range(120):
        alphabet = rng.choice(["ab", "abcé"])
        words = sorted({"".join(rng.choice(alphabet) for _ in range(rng.randint(1, rng.choice([4, 9])))) for _ in range(rng.randint(2, 60))})
        cuts = sorted(rng.sample(range(1, len(words)), min(len(words) - 1, rng.randint(0, 3))))
        assert joined_by_parts(words, cuts) == sorted((a, b) for i, b in enumerate(words) for a in words[:i] if near(a, b))


def test_trie_join_of_long_words():
    base = "abcdefghij" * 3000
    words = sorted([base, base[:-1], base[:500] + "x" + base[501:], base + "k", "z" + base, base[:20000] + base[20001:]])
    assert joined_by_parts(words, [3]) == sorted((a, b) for i, b in enumerate(words) for a in words[:i] if abs(len(a) - len(b)) < 2 and near(a, b))


def wanted_variants(rows):
    count = {}
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = None if i is None else zlib.crc32(f"{i}:{run}".encode())
            if h is not None and h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            count[run] = count.get(run, 0) + 1
    count = {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}
    links = {w: [v for v in count if abs(len(v) - len(w)) < 2 and near(v, w)] for w in count}
    form = {w: min(vs, key=lambda v: (-count[v], v)) for w, vs in links.items() if vs}
    form = {w: f for w, f in form.items() if count[f] >= 5 * count[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n, len(links[w]), count[form[w]] if w in form else None) for w, n in count.items()}


def test_variants(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PART_WORDS", 30)
    rng = random.Random(8)
    base = ["".join(rng.choice("abéÀ") for _ in range(rng.randint(6, 8))) for _ in range(60)]
    often = [w for k, w in enumerate(base) for _ in range(1 + 3 * (k % 20))]
    rows = [(i, " ".join(rng.choice(often) for _ in range(200)) + ".") for i in range(150)]
    rows += [(None, "Wörter wörter " * 9), (7, None), (8, ""), (9, "x" * 300_000 + " " + "long" * 20_000), (1, rows[1][1]), (1, rows[1][1]), (77, "Übung÷mit×Maß _abcdef9ghijkl " * 6)]
    table = spark.createDataFrame([(i, t, *CLASHES) for i, t in rows], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHES)).repartition(3)
    got = spelling.variants(table).collect()
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == wanted_variants(rows) and len(got) == len({r["word"] for r in got})
    assert any(r["form"] for r in got) and spelling.variants(table.limit(0)).count() == 0


def test_roots_of_a_chain(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(20)], "word string, form string")
    assert {r["root"] for r in spelling.with_roots(forms).collect()} == {"w20"}


def audited(rows, marks):
    """Every order applied to the rows one filter after the other."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    failing = []
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > least[t]}
        failing.append((lang or "", {k for k, v in f.items() if v}, *marks.get(i, (0, 0))))
    out, removed_by = {}, {}
    for part in {p for p, *_ in failing}:
        own = [x[1:] for x in failing if x[0] == part]
        for order in map("".join, permutations("ABCDE")):
            for step, name in enumerate(order, 1):
                before = set(order[: step - 1])
                here = [x for x in own if name in x[0] and not x[0] & before]
                removed_by[part, name] = removed_by.get((part, name), 0) + len(here)
                out[part, order, step] = [sum(not x[0] & (before | {name}) for x in own), len(here), sum(name in x[0] and bool(x[0] & before) for x in own), sum(x[0] == {name} for x in own), sum(x[1] for x in here), sum(x[2] for x in here)]
    return {k: (*v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_audit(spark):
    rng = random.Random(2)
    text = lambda n, few: " ".join(rng.choice(["Ab", "CD", "e"]) if few else f"w{rng.randint(0, 999)}{rng.choice(['', '', '', '|'])}" for _ in range(n))
    rows = [(i, text(rng.choice([5, 250, 260]), rng.random() < 0.4), rng.choice(["de", "en", None, ""])) for i in range(80)]
    rows += [(100 + i, rows[i % 7][1], rows[i % 9][2]) for i in range(40)] + [(3, rows[3][1], "fr"), (3, rows[3][1], "fr"), (None, rows[3][1], "en"), (None, None, "en"), (200, None, "en"), (201, "", None), (202, "w " * 200_000, "en")]
    labels = [(i, i % 2, (i // 2) % 2) for i in range(0, 120, 3)] + [(3, 0, 0), (None, 1, 1), (6, None, None)]
    table = spark.createDataFrame([(i, t, lang, *CLASHES) for i, t, lang in rows], "doc_id long, text string, lang string, " + ", ".join(f"`{c}` string" for c in CLASHES)).repartition(3)
    marks = {}
    for i, q, x in labels:
        if i is not None:
            old = marks.get(i, (0, 0))
            marks[i] = (max(old[0], int(q == 1)), max(old[1], int(x == 1)))
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(table, frame).collect()
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in names) for r in got} == audited(rows, marks)
    assert len(got) == 600 * len({lang or "" for *_, lang in rows}) and filter_audit.audit(table.limit(0), frame).count() == 0


def tokens(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def wanted_overlaps(rows, items, width=10):
    windows = {}
    for item, t in items:
        w = tokens(t)
        if item is not None and w:
            n = min(width, len(w))
            for p in range(len(w) - n + 1):
                windows.setdefault(tuple(w[p : p + n]), set()).add(item)
    out = []
    for i, t in rows:
        w = tokens(t)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[p : p + n]))) is not None:
                    hit |= set(range(p, p + n))
                    found |= own
        names = ",".join(sorted(map(str, found)))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def leaked(spark):
    rng = random.Random(6)
    words = ["the", "Of", "ÄB", "äb", "x1", "9", "né", "and", "to", "in"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", "-", "\n", "_", ". "]) for _ in range(n))
    items = [(i, text(rng.choice([3, 9, 10, 11, 40, 90]))) for i in range(40)]
    items += [(7, text(30)), (None, text(20)), (50, None), (51, "..."), (52, items[5][1]), (53, "x1 x1 x1"), (54, text(400))]
    rows = [(i, text(60) + items[i % 40][1] * (i % 3 > 0) + text(20) + items[(i * 7) % 40][1][: 30 + i]) for i in range(70)]
    rows += [(1, rows[2][1]), (1, rows[2][1]), (None, rows[5][1]), (80, None), (81, ""), (82, text(60_000)), (83, items[-1][1] * 3), (84, items[8][1])]
    table = spark.createDataFrame([(i, t, *CLASHES) for i, t in rows], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHES)).repartition(3)
    return table, spark.createDataFrame([(i, t, "n") for i, t in items], "item_id long, text string, n string"), rows, items


@pytest.mark.parametrize("sizes", [None, (400, 12, 3000)])
def test_suffix_search(leaked, monkeypatch, sizes):
    table, items, rows, raw = leaked
    if sizes:  # several blocks, parts of items, and shards
        for name, value in zip(("BLOCK_BYTES", "PART_WORDS", "AT_ONCE"), sizes):
            monkeypatch.setattr(suffix_search, name, value)
        monkeypatch.setattr(suffix_search.blocks, "__defaults__", (suffix_search.WINDOW, sizes[0]))
    got = suffix_search.overlaps(table, items).collect()
    want = wanted_overlaps(rows, raw)
    assert sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in got), key=str) == want and {x[-1] for x in want} == {True, False}
    clean = suffix_search.decontaminate(table, items)
    assert clean.columns == table.columns and sorted((r["doc_id"], r["text"]) for r in clean.collect()) == sorted(((i, t) for i, t in rows if not wanted_overlaps([(i, t)], raw)[0][-1]), key=lambda x: x[0])


def test_empty_sides(leaked):
    table, items, rows, _ = leaked
    assert suffix_search.overlaps(table.limit(0), items).count() == 0 and suffix_search.matches(table, items.limit(0)).count() == 0
    none = suffix_search.overlaps(table, items.limit(0)).collect()
    assert len(none) == len(rows) and not any(r["contaminated"] or r["n_items"] for r in none)


def test_matches(spark):
    passage = [f"p{i}" for i in range(30)]
    items = spark.createDataFrame([(1, " ".join(passage)), (2, " ".join(["q", *passage[5:17]]))], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b " + " ".join(passage[3:25]) + " c"), (2, " ".join(passage[:9])), (3, " ".join(passage))], "doc_id long, text string")
    got = {(r["item_id"], r["item_start"], r["doc_id"], r["doc_start"], r["length"]) for r in suffix_search.matches(docs, items).collect()}
    assert got == {(1, 3, 1, 2, 22), (1, 0, 3, 0, 30), (2, 1, 1, 4, 12), (2, 1, 3, 5, 12)}


def test_suffix_array():
    import numpy as np

    rng = np.random.default_rng(4)
    for n, k in ((1, 1), (50, 2), (400, 3)):
        seq = rng.integers(0, k, n)
        assert suffix_search.suffix_array(seq, n).tolist() == sorted(range(n), key=lambda i: seq[i:].tolist())


@pytest.mark.parametrize("name", ["op11_spelling", "op12_filter_audit", "op13_decontamination"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    from spanwright.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    want = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, folder).select(columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall())) and got
