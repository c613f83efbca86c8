"""Queries on the shape of values, rendered documents and the state of a corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanwright.functions import features
from spanwright.functions import text as tx
from spanwright.operators import corpus, independence, rendering
from spanwright.sources import fixtures as fx

from .base import base
from .candidates import _LONGEST, _q
from .evaluation import add
from .measurement import Inputs

# doc_id, s, v: where each document's longest token starts, and that token.
_LONGEST_OF = f""", lp AS (SELECT doc_id, text, regexp_extract_all(text, {_q(tx.TOKEN)}) AS m, regexp_split_to_array(text, {_q(tx.TOKEN)}) AS x FROM docs), li AS (SELECT *, {_LONGEST}::INTEGER AS i FROM lp WHERE len(m) > 0),
lt AS (SELECT doc_id, (coalesce(list_sum(list_transform(x[1:i], lambda y: strlen(y))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: strlen(y))), 0))::INTEGER AS s, m[i] AS v FROM li)"""
_LOG = "[" + ", ".join(map(str, features.LOGARITHMS)) + "]"


def _entropy(n: str, counts: str) -> tuple[str, str]:
    at = lambda x: f"lg[{x} + 1]"
    shannon = f"CASE WHEN {n} = 0 THEN 0 ELSE greatest({at(n)} - list_sum(list_transform({counts}, lambda c: c * {at('c')})) // {n}, 0) END"
    return shannon, f"CASE WHEN {n} = 0 THEN 0 ELSE {at(n)} - {at(f'list_max({counts})')} END"


def _eff(size: str) -> str:
    return f"CASE WHEN {size} >= 2 THEN least(1000, 1000 * h // lg[{size} + 1]) ELSE 0 END"


_COUNTS = "list_transform(list_distinct({0}), lambda x: len(list_filter({0}, lambda y: y = x)))"
_OTHER = "len(list_distinct(list_filter(s, lambda x: x > 127)))"
_FEATURES = f""", vals AS (SELECT DISTINCT family, decode(encode(text)[s + 1:e]) AS value FROM truth JOIN docs USING (doc_id)),
v0 AS (SELECT family, value, list_transform(range(1, least(length(value), 256) + 1), lambda i: unicode(substring(value, i, 1))::BIGINT) AS s, {_LOG} AS lg FROM vals),
v1 AS (SELECT *, len(s) AS n, {_COUNTS.format('s')} AS cn, list_transform(s, lambda x: CASE WHEN x BETWEEN 97 AND 122 THEN 0 WHEN x BETWEEN 65 AND 90 THEN 1 WHEN x BETWEEN 48 AND 57 THEN 2 WHEN x BETWEEN 33 AND 126 THEN 3 WHEN x <= 32 OR x = 127 THEN 4 ELSE 5 END) AS cl,
  list_transform(s, lambda x, i: CASE WHEN i > 2 THEN (s[i - 2] * 2097152 + s[i - 1]) * 2097152 + x ELSE -1 END) AS tri, list_filter(range(1, len(s) + 1), lambda i: i = 1 OR s[i] <> s[i - 1]) AS st,
  list_transform(range(2, len(s) + 1), lambda i: s[i - 1] * 2097152 + s[i]) AS bi FROM v0),
v2 AS (SELECT *, {_entropy('n', 'cn')[0]} AS h, {_entropy('n', 'cn')[1]} AS mh, list_transform(range(0, 6), lambda k: len(list_filter(cl, lambda c: c = k))) AS cc,
  list_filter(s, lambda x, i: NOT ((i > 1 AND s[i - 1] = x) OR (i > 2 AND x + s[i - 2] = 2 * s[i - 1]) OR (i > 4 AND x + s[i - 4] = 2 * s[i - 2]) OR (i > 2 AND list_position(tri, tri[i]) < i))) AS rs,
  list_transform(range(2, least(n // 2, 32) + 1), lambda k: 1000 * len(list_filter(range(1, n - k + 1), lambda i: s[i] = s[i + k])) // (n - k)) AS ac FROM v1),
v3 AS (SELECT *, {_COUNTS.format('rs')} AS rc, len(rs) AS rn, len(cn) AS d, {' + '.join(f'CASE WHEN cc[{k + 1}] > 0 THEN {size} ELSE 0 END' for k, size in enumerate(features.ALPHABETS))} + {_OTHER} AS al FROM v2)
SELECT family, value, array_to_string([strlen(value), n, (length(value) > 256)::INTEGER, d, list_max(cn), h, mh, n * h, cc[1], cc[2], cc[3], cc[4], cc[5], cc[6], len(list_filter(cc, lambda c: c > 0)),
  len(list_filter(range(2, n + 1), lambda i: cl[i] <> cl[i - 1])), al, {_eff('d')}, {_eff('al')}, 1000 * d // n, 1000 * n // 256, list_max(list_transform(st, lambda p, i: coalesce(st[i + 1], n + 1) - p)),
  CASE WHEN n > 1 THEN 1000 * len(list_filter(range(2, n + 1), lambda i: s[i] = s[i - 1])) // (n - 1) ELSE 0 END, CASE WHEN n > 1 THEN 1000 * (len(bi) - len(list_distinct(bi))) // (n - 1) ELSE 0 END,
  coalesce(list_filter(range(1, n // 2 + 1), lambda p: s[1:n - p] = s[p + 1:n])[1], 0), coalesce(list_max(ac), 0), CASE WHEN list_max(ac) > 0 THEN list_position(ac, list_max(ac)) + 1 ELSE 0 END,
  rn, {_entropy('rn', 'rc')[0]}, {_entropy('rn', 'rc')[1]}], ',') AS features FROM v3"""


@add(_FEATURES)
def feature_vector(spark, sf_dir):
    """Thirty numbers of each different true value."""
    i = Inputs(spark, sf_dir)
    values = i.truth.join(i.docs.select("doc_id", "text"), "doc_id").select("family", tx.byte_slice(F.col("text"), F.col("start"), F.col("end")).alias("value")).distinct()
    return values.select("family", "value", F.array_join(features.evidence(F.col("value")).cast("array<string>"), ",").alias("features"))


def _rendered(spans: str, name: str) -> str:
    """CTE of doc_id, scanner, out: the bytes of texts with the greedily kept spans replaced, in hexadecimal."""
    return f"""{name}0 AS (SELECT doc_id, scanner, list_reduce(list([{{'s': s, 'e': e}}] ORDER BY s, e), lambda a, x: CASE WHEN x[1].s >= a[len(a)].e THEN list_concat(a, x) ELSE a END) AS k FROM ({spans}) GROUP BY 1, 2),
{name} AS (SELECT doc_id, scanner, array_to_string(list_transform(k, lambda x, i: hex(encode(text)[CASE WHEN i = 1 THEN 0 ELSE k[i - 1].e END + 1:x.s]) || hex('<SECRET_' || i || '>')), '') || hex(encode(text)[k[len(k)].e + 1:]) AS out FROM {name}0 JOIN docs USING (doc_id))"""


def _bytes(x: str) -> str:
    """Hexadecimal text with a mark before each byte, so that values are found at whole bytes only."""
    return f"regexp_replace({x}, '(..)', '.\\1', 'g')"


_LEFT = ", " + _rendered("SELECT DISTINCT doc_id, '' AS scanner, s, e FROM truth", "ref") + ", " + _rendered("SELECT doc_id, scanner, s, e FROM fnd WHERE action = 'redact'", "own") + f""", tg AS (SELECT t.doc_id, sc.scanner, t.family, t.s, t.e, d.text, {_bytes('hex(encode(d.text)[t.s + 1:t.e])')} AS v, {_bytes('ref.out')} AS ref, coalesce(own.out, hex(encode(d.text))) AS raw, {_bytes('raw')} AS out
  FROM truth t CROSS JOIN sc JOIN docs d USING (doc_id) JOIN ref USING (doc_id) LEFT JOIN own ON own.doc_id = t.doc_id AND own.scanner = sc.scanner)"""


@add(_LEFT + " SELECT doc_id, scanner, sha256(unhex(any_value(raw))) AS sha, count(*) FILTER (strlen(out) - strlen(replace(out, v, '')) > strlen(ref) - strlen(replace(ref, v, ''))) AS leaked FROM tg GROUP BY 1, 2")
def rendered_documents(spark, sf_dir):
    """Documents as each scanner's findings leave them, and how many true values still stand there."""
    i = Inputs(spark, sf_dir)
    out = rendering.rendered(i.docs, i.truth, i.findings, fx.SCANNERS)
    return out.select("doc_id", "scanner", F.sha2("output", 256).alias("sha"), F.size(F.filter("targets", lambda t: t["leaked"])).cast("long").alias("leaked"))


@add("""SELECT sc.scanner, t.doc_id, t.family, t.s AS start, t.e AS "end", ['miss', 'partial', 'warn-only', 'envelope', 'exact'][1 + max(CASE WHEN f.s IS NULL THEN 0
  WHEN f.s = t.s AND f.e = t.e THEN CASE WHEN f.action = 'redact' THEN 4 ELSE 2 END WHEN f.s <= t.s AND f.e >= t.e AND f.s >= t.es AND f.e <= t.ee THEN CASE WHEN f.action = 'redact' THEN 3 ELSE 2 END ELSE 1 END)] AS outcome
FROM truth t CROSS JOIN sc LEFT JOIN fnd f ON f.scanner = sc.scanner AND f.doc_id = t.doc_id AND f.s < t.e AND t.s < f.e GROUP BY 1, 2, 3, 4, 5""")
def target_outcomes(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return rendering.target_outcomes(i.truth, i.findings, i.scanners)


@add("SELECT scanner, family, action, count(*) AS findings, sum(e - s)::BIGINT AS bytes FROM fnd f WHERE NOT EXISTS (SELECT 1 FROM truth t WHERE t.doc_id = f.doc_id AND f.s < t.e AND t.s < f.e) GROUP BY 1, 2, 3")
def unexpected_findings(spark, sf_dir):
    """Findings away from every true value, by what they claim."""
    i = Inputs(spark, sf_dir)
    return rendering.unexpected(i.truth, i.findings).groupBy("scanner", "family", "action").agg(F.count("*").alias("findings"), F.sum(F.col("end") - F.col("start")).alias("bytes"))


@add("SELECT doc_id, family, s AS start, length(decode(encode(text)[1:s]))::BIGINT AS chars, length(regexp_replace(decode(encode(text)[1:s]), '[\\x{10000}-\\x{10FFFF}]', 'ab', 'g'))::BIGINT AS units FROM truth JOIN docs USING (doc_id)")
def offset_forms(spark, sf_dir):
    """Where a value starts in bytes, code points and UTF-16 units."""
    i = Inputs(spark, sf_dir)
    before = tx.byte_slice(F.col("text"), F.lit(0), F.col("start"))
    both = i.truth.select("doc_id", "family", "start").join(i.docs.select("doc_id", "text"), "doc_id")
    return both.select("doc_id", "family", "start", F.length(before).cast("long").alias("chars"), F.floor(F.octet_length(F.encode(before, "UTF-16BE")) / 2).alias("units"))


# Sources that a corpus should have, one of which no row has.
AXES = ["src0", "src1", "src2", "web"]


@add(f"WITH c AS (SELECT source AS axis, count(*) AS n FROM documents GROUP BY 1), k AS (SELECT unnest([{', '.join(map(repr, AXES))}]) AS axis), a AS (SELECT coalesce(c.axis, k.axis) AS axis, k.axis IS NOT NULL AS known, coalesce(n, 0) AS n, coalesce(n, 0)::DOUBLE / (SELECT sum(n) FROM c) AS share FROM c FULL JOIN k ON k.axis = c.axis) SELECT axis, n, round(share, 6) AS share, nullif(concat_ws(',', CASE WHEN NOT known THEN 'unknown' WHEN n < 15 THEN 'few' END, CASE WHEN share > 0.25 THEN 'dominates' END), '') AS problem FROM a", plain=True)
def distribution_problems(spark, sf_dir):
    return corpus.distribution(fx.table(spark, sf_dir, "documents"), "source", AXES, 15, 0.25)


@add("WITH x AS (SELECT doc_id AS id, unnest(['sha', 'length']) AS key, unnest([sha256(text), strlen(text) || source]) AS value FROM documents), f AS (SELECT key, value, min(id) AS prior FROM x WHERE value IS NOT NULL GROUP BY 1, 2) SELECT key, prior, id FROM x JOIN f USING (key, value) WHERE id > prior", plain=True)
def repeated_rows(spark, sf_dir):
    """Documents whose text, or length and source, one of smaller id has."""
    docs = fx.table(spark, sf_dir, "documents")
    return corpus.repeated(docs, "doc_id", {"sha": F.sha2("text", 256), "length": F.concat(F.octet_length("text").cast("string"), F.col("source"))})


@add("SELECT CASE WHEN doc_id % 7 = 0 THEN -1 - doc_id ELSE doc_id END AS id, unnest(CASE WHEN doc_id % 7 = 0 THEN ['removed'] WHEN doc_id % 15 = 0 THEN ['regrouped', 'edited'] WHEN doc_id % 3 = 0 THEN ['regrouped'] WHEN doc_id % 5 = 0 THEN ['edited'] ELSE [] END) AS problem FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, 'repeated' FROM documents WHERE text IS NOT NULL AND doc_id % 21 = 4 UNION ALL SELECT NULL, 'stale-digest'", plain=True)
def frozen_subset_problems(spark, sf_dir):
    """The present documents against an older state of them, in which some ids, sources and texts are others, some ids stand twice, and the digest noted is that of the present."""
    docs = fx.table(spark, sf_dir, "documents").where("text is not null")
    now = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("group"), F.sha2("text", 256).alias("sha256"))
    i = F.col("id")
    old = now.select(F.when(i % 7 == 0, -1 - i).otherwise(i).alias("id"), F.when(i % 3 == 0, F.lit("older")).otherwise(F.col("group")).alias("group"), F.when(i % 5 == 0, F.sha2("sha256", 256)).otherwise(F.col("sha256")).alias("sha256"))
    noted = independence.frozen_digest(now.select(F.lit(1).alias("all"), independence.entry(F.col("id"), F.col("sha256")).alias("h")), "all", "h").first()
    return corpus.frozen_problems(old.unionByName(old.where(i % 21 == 4)), now, noted["digest"] if noted else "")
