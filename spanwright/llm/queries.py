"""The queries of this subpackage, over whole tables and with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import fit, held_out, identify

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out())
    model = fit(docs.where(~F.col("held_out")))
    return identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import exact_topk

    return exact_topk(_table(spark, sf_dir, "embeddings"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(_table(spark, sf_dir, "embeddings"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"))


def op4_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_store import store_and_digest, tokenizer_path

    return store_and_digest(_table(spark, sf_dir, "documents"), tokenizer_path())


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pseudonymise

    return pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(_table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .piece_scan import encode_digest, model_path

    return encode_digest(_table(spark, sf_dir, "documents"), model_path())


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import variants

    return variants(_table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import audit

    return audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_search import overlaps

    return overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (op1_language_id, op2_exact_topk, op3_substring_dedup, op4_token_orc, op5_ann, op6_ngram_join, op7_pii, op8_licenses, op9_mixing, op10_sentencepiece, op11_spelling, op12_filter_audit, op13_decontamination)
}

ORACLE_SQL = {
    "op2_exact_topk": """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (
  SELECT DISTINCT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op3_substring_dedup": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
x AS (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 11)) AS p FROM d WHERE len(ws) >= 13),
g AS (SELECT r, doc_id, p, md5(array_to_string(ws[p:p + 12], ' ')) AS h FROM x),
m AS (SELECT h, min(doc_id) AS least FROM g GROUP BY h),
hit AS (SELECT r, p FROM g JOIN m USING (h) WHERE g.doc_id > m.least),
gone AS (SELECT DISTINCT r, p + k AS p FROM hit, (SELECT unnest(range(13)) AS k)),
w AS (SELECT d.r, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM d),
kept AS (SELECT w.r, string_agg(w.w, ' ' ORDER BY w.p) AS t FROM w ANTI JOIN gone ON gone.r = w.r AND gone.p = w.p GROUP BY w.r),
n AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN n ON n.r = d.r LEFT JOIN kept ON kept.r = d.r""",
    "op11_spelling": """
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
runs AS (
  SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS w FROM documents)),
each AS (SELECT doc_id, w, count(*) AS n FROM runs WHERE length(w) >= 6 GROUP BY ALL),
bytes AS (
  SELECT *, flatten(list_transform(string_split(doc_id::VARCHAR || ':' || w, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END)) AS b FROM each),
hashed AS (
  SELECT w, n, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) AS h FROM bytes, crc),
vocabulary AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, sum(n)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5),
cut AS (SELECT word, k, substr(word, 1, k - 1) || substr(word, k + 1) AS d FROM (SELECT word, unnest(range(1, length(word) + 1)) AS k FROM vocabulary)),
near AS (
  SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.k = b.k AND a.d = b.d AND a.word <> b.word
  UNION SELECT c.word, v.word FROM cut c JOIN vocabulary v ON c.d = v.word
  UNION SELECT v.word, c.word FROM cut c JOIN vocabulary v ON c.d = v.word),
best AS (
  SELECT near.word, count(*) AS n_near, arg_min(other, (-v.n, other)) AS other, max(v.n) AS most FROM near JOIN vocabulary v ON v.word = other GROUP BY near.word),
forms AS (
  SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN most >= 5 * v.n THEN other END AS form, CASE WHEN most >= 5 * v.n THEN most END AS form_n
  FROM vocabulary v LEFT JOIN best USING (word)),
steps(word, stop) AS (SELECT word, word FROM forms UNION SELECT s.word, f.form FROM steps s JOIN forms f ON f.word = s.stop WHERE f.form IS NOT NULL)
SELECT forms.word, forms.form, steps.stop AS root, forms.n, forms.n_near, forms.form_n::BIGINT AS form_n
FROM forms JOIN steps USING (word) JOIN forms l ON l.word = steps.stop AND l.form IS NULL""",
    "op12_filter_audit": """
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
least AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
f AS (
  SELECT w.doc_id, part, (CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN w.doc_id > least THEN 'E' ELSE '' END) AS fails
  FROM w JOIN least USING (t)),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
x AS (SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN marks USING (doc_id) GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS own, '[' || substr(filter_order, 1, step - 1) || '-]' AS earlier FROM o, (SELECT unnest(range(1, 6))::INTEGER AS step)),
r AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN NOT contains(fails, own) AND NOT regexp_matches(fails, earlier) THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN contains(fails, own) AND NOT regexp_matches(fails, earlier) THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN contains(fails, own) AND regexp_matches(fails, earlier) THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN contains(fails, own) AND NOT regexp_matches(fails, earlier) THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN contains(fails, own) AND NOT regexp_matches(fails, earlier) THEN toxic ELSE 0 END) AS toxic_lost
  FROM x, s GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM r""",
    "op13_decontamination": """
WITH tokens AS (
  SELECT r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[p:p + least(10, len(ws)) - 1], ' ') AS g
  FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS p FROM items WHERE len(ws) > 0)),
places AS (
  SELECT r, p, n, array_to_string(ws[p:p + n - 1], ' ') AS g
  FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM tokens, (SELECT DISTINCT n FROM windows) WHERE len(ws) >= n)),
found AS (SELECT r, p, places.n, item_id FROM places JOIN windows USING (n, g)),
hit AS (SELECT r, count(DISTINCT w) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS w FROM (SELECT DISTINCT r, p, n FROM found)) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS names FROM (SELECT DISTINCT r, item_id::VARCHAR AS i FROM found) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM tokens LEFT JOIN hit USING (r) LEFT JOIN named USING (r)""",
}
