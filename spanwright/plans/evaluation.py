"""Queries on variants, twins, review state, validation, similarity, personal-data metrics and budgets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanwright import streaming
from spanwright.functions import text as tx
from spanwright.operators import calibration, independence, scoring, variants
from spanwright.sources import fixtures as fx

from .measurement import Inputs, query

add = query


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_REFUSED = {name: f"NOT regexp_matches(text, {_quoted(f.refused)})" if f.refused else "text IS NOT NULL" for name, f in variants.FRAMES.items()}
_LF, _PAIR = "(strlen(text) - strlen(replace(text, chr(10), '')))", "((strlen(text) - strlen(replace(text, chr(13) || chr(10), ''))) // 2)"
_V = "WITH v AS (" + " UNION ALL ".join(
    f"SELECT doc_id, '{name}' AS operator, {_REFUSED[name]} AS ok, {_quoted(f.before)} || text || {_quoted(f.after)} AS t, {len(f.before.encode())}::BIGINT AS moved, text FROM documents" for name, f in variants.FRAMES.items()
) + f""" UNION ALL SELECT doc_id, '{variants.CRLF}', {_LF} > {_PAIR}, replace(replace(text, chr(13) || chr(10), chr(10)), chr(10), chr(13) || chr(10)), {_LF} - {_PAIR}, text FROM documents
UNION ALL SELECT doc_id, '{variants.JSON_STRING}', text IS NOT NULL, to_json(text)::VARCHAR, strlen(to_json(text)::VARCHAR) - strlen(text) - 1, text FROM documents)
"""


@add(_V + "SELECT doc_id, operator, CASE WHEN ok THEN 'generated' ELSE 'unsupported' END AS status, CASE WHEN ok THEN moved ELSE 0 END::INTEGER AS moved, CASE WHEN ok THEN sha256(t) ELSE '' END AS sha FROM v", plain=True)
def generated_variants(spark, sf_dir):
    v = variants.generate(fx.documents(spark, sf_dir))
    return v.select("doc_id", "operator", "status", "moved", F.coalesce(F.sha2("text", 256), F.lit("")).alias("sha"))


@add(_V + "SELECT operator, count(*) FILTER (ok) AS generated, count(*) FILTER (NOT ok) AS unsupported FROM v GROUP BY 1", plain=True)
def operators_table(spark, sf_dir):
    v = variants.generate(fx.documents(spark, sf_dir))
    n = lambda s: F.sum((F.col("status") == s).cast("int")).alias(s)
    return v.groupBy("operator").agg(n("generated"), n("unsupported"))


_VALUE = ", v AS (SELECT t.doc_id, t.family, t.s, t.e, decode(encode(text)[s + 1:e]) AS v FROM truth t JOIN docs USING (doc_id))"


def _values(spark, sf_dir):
    x = Inputs(spark, sf_dir).measured.select("doc_id", "text", F.explode("truth").alias("x")).select("doc_id", "text", "x.*")
    return x.select("doc_id", "family", "start", tx.byte_slice(F.col("text"), F.col("start"), F.col("end")).alias("v"))


def _seeded(name: str, size: str) -> str:
    digits = f"string_split(sha256(v || ':{name}')[1:8], '')"
    return f"(list_reduce(list_prepend(0::BIGINT, list_transform({digits}, lambda c: (strpos('0123456789abcdef', c) - 1)::BIGINT)), lambda a, b: a * 16 + b) % ({size}))"


_OTHERS = f"replace('{variants.ALPHABET}', upper(v[1]), '')"
_PLACES = "list_filter(range(1, length(v) + 1), lambda i: regexp_matches(v[i], '[._-]'))"
_REST = "len(string_split(v, '.')) - 1"
_EDITED = {
    "lexical.length-minus-one": "v[1:length(v) - 1]", "lexical.length-plus-one": "v || 'A'",
    "lexical.replace-last": "v[1:length(v) - 1] || CASE WHEN right(v, 1) = 'A' THEN 'B' ELSE 'A' END", "lexical.invalid-alphabet": "v[1:length(v) - 1] || '!'",
    "lexical.prefix-change": f"{_OTHERS}[{_seeded('lexical.prefix-change', f'length({_OTHERS})')} + 1] || v[2:]",
    "boundary.remove-delimiter": f"CASE WHEN regexp_matches(v, '[._-]') THEN v[1:{_PLACES}[{_seeded('boundary.remove-delimiter', f'len({_PLACES})')} + 1] - 1] || v[{_PLACES}[{_seeded('boundary.remove-delimiter', f'len({_PLACES})')} + 1] + 1:] END",
    "structural.remove-segment": f"CASE WHEN contains(v, '.') THEN array_to_string(list_filter(string_split(v, '.'), lambda x, i: i - 1 <> 1 + {_seeded('structural.remove-segment', _REST)}), '.') END",
}
_FULL = {**fx.PATTERNS, "token": "[0-9a-f]{40}"}
_STILL = " OR ".join(f"(family = '{f}' AND regexp_full_match(n, {_quoted(p)}))" for f, p in _FULL.items())


@add(_VALUE + ", m AS (" + " UNION ALL ".join(f"SELECT doc_id, family, s AS start, '{name}' AS operator, {edit} AS n FROM v" for name, edit in _EDITED.items()) + f") SELECT doc_id, family, start, operator, n AS value, CASE WHEN {_STILL} THEN 'same-detection' ELSE 'review-required' END AS expectation FROM m WHERE n IS NOT NULL")
def mutation_contract_validity(spark, sf_dir):
    """Each edited value, and whether it still matches its family's pattern."""
    made = F.explode(F.array(*[F.struct(F.lit(n).alias("operator"), variants.edit_value(F.col("v"), n).alias("value")) for n in variants.EDITS]))
    x = _values(spark, sf_dir).select("doc_id", "family", "start", made.alias("m")).select("doc_id", "family", "start", "m.*").where("value is not null")
    ok = F.lit(False)
    for family, p in _FULL.items():
        ok = ok | ((F.col("family") == family) & F.col("value").rlike(rf"\A(?:{p})\z"))
    return x.withColumn("expectation", F.when(ok, "same-detection").otherwise("review-required"))


_LEDGER = "WITH q AS (SELECT o_orderkey AS id, o_orderdate AS seen FROM orders WHERE o_orderkey % 3 = 0), l AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'O' THEN 'open' ELSE 'not-assertable' END AS status FROM orders WHERE o_orderkey % 2 = 0) "


def _ledger(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders")
    queue = o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("seen"))
    status = F.when(F.col("o_orderstatus") == "F", "resolved").when(F.col("o_orderstatus") == "O", "open").otherwise("not-assertable")
    return queue, o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), status.alias("status"))


@add(_LEDGER + "SELECT coalesce(status, 'unknown') AS status, count(*) AS entries, min(seen) AS oldest FROM q LEFT JOIN l USING (id) GROUP BY 1", plain=True)
def ledger_review_state(spark, sf_dir):
    queue, ledger = _ledger(spark, sf_dir)
    return queue.join(ledger, "id", "left").groupBy(F.coalesce("status", F.lit("unknown")).alias("status")).agg(F.count("*").alias("entries"), F.min("seen").alias("oldest"))


@add(_LEDGER + "SELECT id FROM q WHERE id NOT IN (SELECT id FROM l WHERE status IN ('resolved', 'not-assertable'))", plain=True)
def unresolved_in_queue(spark, sf_dir):
    queue, ledger = _ledger(spark, sf_dir)
    return queue.join(ledger.where(F.col("status").isin("resolved", "not-assertable")), "id", "left_anti").select("id")


_BROKEN = ", br AS (SELECT doc_id, family, CASE WHEN doc_id % 5 = 1 THEN s - bytes ELSE s END AS s, CASE WHEN doc_id % 5 = 2 THEN e + bytes ELSE e END AS e, CASE WHEN doc_id % 5 = 3 THEN s + 1 ELSE es END AS es, ee, bytes FROM truth UNION ALL SELECT doc_id, family, s + 1, e + 1, es, ee, bytes FROM truth WHERE doc_id % 5 = 4)"


@add(_BROKEN + ", p AS (SELECT *, lag(e) OVER (PARTITION BY doc_id ORDER BY s, e) AS pe FROM br) SELECT doc_id, family, s AS start, e AS \"end\", 'overlap' AS problem FROM p WHERE s < pe UNION ALL SELECT doc_id, family, s, e, 'outside' FROM br WHERE s < 0 OR e > bytes UNION ALL SELECT doc_id, family, s, e, 'envelope' FROM br WHERE es > s OR ee < e")
def corpus_problems(spark, sf_dir):
    """Problems of the true spans, broken in four ways by id: before the text, beyond it, outside the envelope, overlapping."""
    t = Inputs(spark, sf_dir).truth
    way = F.col("doc_id") % 5
    start, end = F.when(way == 1, F.col("start") - F.col("bytes")).otherwise(F.col("start")), F.when(way == 2, F.col("end") + F.col("bytes")).otherwise(F.col("end"))
    broken = t.select("doc_id", "family", start.alias("start"), end.alias("end"), F.when(way == 3, F.col("start") + 1).otherwise(F.col("env_start")).alias("env_start"), "env_end", "bytes")
    twice = t.where(way == 4).select("doc_id", "family", (F.col("start") + 1).alias("start"), (F.col("end") + 1).alias("end"), "env_start", "env_end", "bytes")
    return scoring.span_problems(broken.unionByName(twice))


@add(", f AS (SELECT scanner, doc_id, count(*) AS n, md5(string_agg(s || ':' || e, ',' ORDER BY s, e)) AS digest FROM (SELECT DISTINCT scanner, doc_id, s, e FROM fnd) GROUP BY 1, 2) SELECT doc_id, count(DISTINCT digest) AS signatures, count(*) AS scanners FROM f GROUP BY 1")
def surface_signatures(spark, sf_dir):
    """How many different result signatures scanners give a document."""
    f = Inputs(spark, sf_dir).findings.select("scanner", "doc_id", "start", "end").distinct()
    sign = F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "end"))), lambda x: F.concat(x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))), ","))
    return f.groupBy("scanner", "doc_id").agg(sign.alias("digest")).groupBy("doc_id").agg(F.count_distinct("digest").alias("signatures"), F.count("*").alias("scanners"))


@add("WITH h AS (SELECT source, sha256(doc_id || chr(9) || sha256(text)) AS h FROM documents), b AS (SELECT source, h[1:4] AS part, sha256(string_agg(h, '' ORDER BY h)) AS d, count(*) AS n FROM h GROUP BY 1, 2) SELECT source, sha256(string_agg(d, '' ORDER BY part)) AS digest, sum(n)::BIGINT AS documents FROM b GROUP BY 1", plain=True)
def frozen_digest(spark, sf_dir):
    """A digest of each source's ids and texts, whatever their order."""
    d = fx.table(spark, sf_dir, "documents").select("source", independence.entry(F.col("doc_id"), F.sha2("text", 256)).alias("h"))
    return independence.frozen_digest(d, "source", "h").withColumnRenamed("rows", "documents")


@add("WITH RECURSIVE e AS (SELECT s_suppkey AS a, s_suppkey + 7 AS b FROM supplier WHERE s_suppkey % 5 <> 0 AND s_suppkey + 7 IN (SELECT s_suppkey FROM supplier)), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS reach FROM u UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.reach) SELECT node, min(reach) AS comp FROM r GROUP BY 1", plain=True)
def connected_components(spark, sf_dir):
    s = fx.table(spark, sf_dir, "supplier").select("s_suppkey")
    e = s.where("s_suppkey % 5 <> 0").select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") + 7).alias("b"))
    return independence.components(spark, e.join(s, e["b"] == s["s_suppkey"], "left_semi"))


@add("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2", plain=True)
def event_monitor(spark, sf_dir):
    return streaming.monitor(fx.table(spark, sf_dir, "events"))


_STRATA = "WITH s AS (SELECT c_nationkey % 5 AS stratum, count(*) AS cases, sum((c_acctbal < 0)::INTEGER)::BIGINT AS bad FROM customer GROUP BY 1) "


@add(_STRATA + "SELECT stratum::BIGINT AS stratum, cases, bad, round((stratum + 1) / 15.0 * bad / cases, 6) AS adverse_mass FROM s", plain=True)
def population_mass_weighted(spark, sf_dir):
    """Adverse cases weighted by the declared mass of their stratum (1 to 5 fifteenths)."""
    c = fx.table(spark, sf_dir, "customer").groupBy((F.col("c_nationkey") % 5).cast("long").alias("stratum")).agg(F.count("*").alias("cases"), F.sum((F.col("c_acctbal") < 0).cast("int")).alias("bad"))
    return c.withColumn("adverse_mass", F.round((F.col("stratum") + 1) / 15.0 * F.col("bad") / F.col("cases"), 6))


@add("WITH c AS (SELECT l_quantity::INTEGER AS x, floor(l_extendedprice / 10000)::INTEGER AS b, avg((l_returnflag = 'R')::INTEGER) AS rate FROM lineitem GROUP BY 1, 2) SELECT x, b, round(max(rate) OVER (PARTITION BY b ORDER BY x), 6) AS monotone FROM c", plain=True)
def monotone_lookup(spark, sf_dir):
    """A two-way table of rates, made non-decreasing along one axis by a running maximum."""
    c = fx.table(spark, sf_dir, "lineitem").groupBy(F.col("l_quantity").cast("int").alias("x"), F.floor(F.col("l_extendedprice") / 10000).cast("int").alias("b")).agg(F.avg((F.col("l_returnflag") == "R").cast("int")).alias("rate"))
    return c.select("x", "b", F.round(F.max("rate").over(Window.partitionBy("b").orderBy("x")), 6).alias("monotone"))


@add("WITH w AS (SELECT l_shipmode_key AS g, v, wt, sum(wt) OVER (PARTITION BY l_shipmode_key ORDER BY v) AS run, sum(wt) OVER (PARTITION BY l_shipmode_key) AS total FROM (SELECT l_linenumber AS l_shipmode_key, l_extendedprice AS v, sum(l_quantity) AS wt FROM lineitem GROUP BY 1, 2)) SELECT g, min(v) AS median FROM w WHERE run >= total / 2 GROUP BY 1", plain=True)
def weighted_lower_median(spark, sf_dir):
    x = fx.table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("g"), F.col("l_extendedprice").alias("v"), F.col("l_quantity").alias("wt"))
    return calibration.quantiles(x, ["g"], "v", [0.5], "wt").select("g", F.get("quantiles", F.lit(0)).alias("median"))
