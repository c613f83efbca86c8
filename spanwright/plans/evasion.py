"""Queries on reshaped values: the variants of drawn bases, and what two detectors make of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanwright.functions import text as tx
from spanwright.operators import evasion
from spanwright.operators.evasion import BLOCKS, CUTS, EMBEDDED, FLAT, GRAMMARS, LENGTHS, MIDDLES, MIXTURES, RUNS, SEGMENTS, SEQUENCES, TILES, WRAPS
from spanwright.sources import fixtures as fx

from .base import base
from .candidates import _HEAD, _NEGATIVE, _q
from .documents import _LONGEST_OF
from .evaluation import add
from .measurement import Inputs


def bases(spark, sf_dir):
    """Documents with one true value, and controls with their longest token; those of a token are statistical, controls flagged by ``wide`` are flagged."""
    rows = Inputs(spark, sf_dir).measured.where(F.col("bytes") <= evasion.MOST_BYTES).where("tier <> 'T0'")  # larger ones are no bases
    token = tx.longest_token(F.col("text"))
    control = F.col("kind") == "must-not-flag"
    at = F.when(control, F.struct(token["start"].cast("int").alias("start"), token["end"].cast("int").alias("end"))).when(F.size("truth") == 1, F.struct(F.get("truth", F.lit(0))["start"].alias("start"), F.get("truth", F.lit(0))["end"].alias("end")))
    flagged = F.exists("found", lambda f: f["scanner"] == "wide")
    stratum = F.when(control & flagged, "control:flagged").when(control, "control:unflagged").when(F.get("truth", F.lit(0))["family"] == "token", "must-redact:statistical").otherwise("must-redact:deterministic")
    rows = tx.once(rows, "at", at).select(F.col("doc_id").alias("base_id"), "text", "at", stratum.alias("stratum")).where("at is not null")
    piece = lambda a, b: tx.byte_slice(F.col("text"), a, b)
    found = rows.select("base_id", "stratum", piece(F.lit(0), F.col("at.start")).alias("before"), piece(F.col("at.start"), F.col("at.end")).alias("value"), piece(F.col("at.end"), F.octet_length("text")).alias("after"))
    return evasion.select_bases(found)


def _list(x: str) -> str:
    return f"string_split({x}, '')"


def _glue(x: str) -> str:
    return f"array_to_string({x}, '')"


def _each(change: str) -> str:
    """Each character of the body (c at place i from 1) changed, white space left alone."""
    return _glue(f"list_transform(ch, lambda c: CASE WHEN regexp_matches(c, '\\s') THEN c ELSE {change} END)")


_BODY = {
    **{f"block-repeat-{k}": _glue(f"list_transform(ch, lambda c, i: ch[i - (i - 1) % {k}])") for k in BLOCKS}, "double-each": _glue("list_transform(ch, lambda c: c || c)"),
    **{f"insert-run-{r}": f"{_glue('ch[1:n // 2]')} || repeat(coalesce(ch[n // 2 + 1], 'a'), {r}) || {_glue('ch[n // 2 + 1:]')}" for r in RUNS},
    **{f"tile-{p}": _glue(f"list_transform(ch, lambda c, i: ch[(i - 1) % least({p}, n) + 1])") for p in TILES},
    "mirror": _glue("list_concat(ch[1:(n + 1) // 2], list_reverse(ch[1:(n + 1) // 2]))[1:n]"), "lower": "lower(body)", "upper": "upper(body)",
    "digits": _each("(unicode(c) % 10)::VARCHAR"), "hex": _each("'0123456789abcdef'[unicode(c) % 16 + 1]"), "alnum-only": _each("CASE WHEN regexp_matches(c, '[A-Za-z0-9]') THEN c ELSE 'A' END"), "binary-alphabet": _each("CASE WHEN unicode(c) % 2 = 1 THEN 'b' ELSE 'a' END"),
    **{f"truncate-{k}": f"CASE WHEN n > {k} THEN {_glue(f'ch[1:{k}]')} END" for k in CUTS},
    **{f"segment-{k}-{word}": _glue(f"list_transform(ch, lambda c, i: CASE WHEN i > 1 AND (i - 1) % {k} = 0 THEN '{mark}' || c ELSE c END)") for k, mark, word in SEGMENTS},
    **{f"flatten-after-{k}": f"CASE WHEN n > {k} THEN {_glue(f'ch[1:{k}]')} || repeat(ch[{k}], n - {k}) END" for k in FLAT},
}
_WHOLE = {
    **{name: f"v[1:length(v) // 2] || {_q(put)} || v[length(v) // 2 + 1:]" for name, put in MIDDLES},
    **{f"length-{n}": f"CASE WHEN length(v) < {n} THEN left(repeat(v, {n} // length(v) + 1), {n}) END" for n in LENGTHS},
}
_AROUND = {
    "pad-before-bound": ("repeat('a', greatest(0, 257 - length(v)))", "''"), "pad-after": ("''", "repeat('a', 64)"),
    **{f"wrap-{k}": (_q(a), _q(b)) for k, (a, b) in enumerate(WRAPS, 1)}, **{name: (_q(a), _q(b)) for name, a, b in EMBEDDED}, **{f"mixture-{k}": (_q(a), _q(b)) for k, (a, b) in enumerate(MIXTURES, 1)},
}
_REPLACED = {
    **{f"benign-sequence-{k}": f"left(repeat({_q(s)}, length(v) // {len(s)} + 1), length(v))" for k, s in enumerate(SEQUENCES, 1)},
    **{f"full-grammar-{k}": _q(g) for k, g in enumerate(GRAMMARS, 1)},
}
_P = "lead || coalesce(name || '=', '')"
_LINES = {
    "spaced-separator": ("lead || name || ' = '", "rest"), "colon-separator": ("lead || name || ': '", "rest"), "double-quoted": (f"{_P} || '\"'", "'\"' || rest"), "single-quoted": (f"{_P} || ''''", "'''' || rest"),
    "export-prefix": ("lead || 'export ' || name || '='", "rest"), "name-lower": ("lead || lower(name) || '='", "rest"), "name-upper": ("lead || upper(name) || '='", "rest"), "trailing-semicolon": (_P, "';' || rest"),
    "comment-prefix": (f"'# ' || {_P}", "rest"), "json-member": ("'{\"' || coalesce(name, 'value') || '\": \"'", "'\"}' || rest"), "tab-indent": (f"chr(9) || {_P}", "rest"), "non-credential-name": ("lead || 'build_ref='", "rest"),
}


def _row(group: str, k: int, op: evasion.Operator) -> str:
    b, left, secret, right, a, fits = "b", "''", "v", "''", "a", "true"
    if op.kind == "body":
        secret = f"head || ({_BODY[op.name]}) || tail"
    elif op.kind == "whole":
        secret = _WHOLE[op.name]
    elif op.kind == "around":
        left, right = _AROUND[op.name]
    elif op.kind == "replace":
        secret, fits = _REPLACED[op.name], "stratum = 'must-redact:statistical'"
    else:
        b, a = (f"above || {_LINES[op.name][0]}", f"{_LINES[op.name][1]} || below")
    kept = "'control'" if op.kind == "replace" else "CASE WHEN starts_with(stratum, 'must') THEN 'must-redact' ELSE 'control' END"
    return f"SELECT {k} AS k, '{group}' AS attack_class, '{op.name}' AS operator, base_id, {kept} AS expectation, {b} AS b, {left} AS l, {secret} AS s, {right} AS r, {a} AS a, b || v || a AS old, '{op.kind}' AS how, v FROM pt WHERE {fits}"


_OPS = [(g, op) for g, ops in evasion.OPERATORS.items() for op in ops]
_QUOTA = "CASE stratum " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in evasion.QUOTAS.items()) + " END"
_BASES = f"""{_LONGEST_OF}, nt AS (SELECT doc_id, count(*) AS c, min(s) AS s, min(e) AS e, min(family) AS family FROM truth GROUP BY 1),
bc AS (SELECT fx.doc_id AS base_id, text, coalesce(nt.s, lt.s) AS s, coalesce(nt.e, lt.s + strlen(lt.v)) AS e, CASE WHEN kind = 'must-not-flag' THEN CASE WHEN fx.doc_id IN (SELECT doc_id FROM fnd WHERE scanner = 'wide') THEN 'control:flagged' ELSE 'control:unflagged' END WHEN family = 'token' THEN 'must-redact:statistical' ELSE 'must-redact:deterministic' END AS stratum
  FROM fx JOIN docs USING (doc_id) LEFT JOIN nt ON nt.doc_id = fx.doc_id LEFT JOIN lt ON lt.doc_id = fx.doc_id AND kind = 'must-not-flag' WHERE tier <> 'T0' AND coalesce(nt.c, 1) = 1 AND (kind <> 'must-not-flag' OR lt.v IS NOT NULL)),
bv AS (SELECT base_id, stratum, decode(encode(text)[1:s]) AS b, decode(encode(text)[s + 1:e]) AS v, decode(encode(text)[e + 1:]) AS a, strlen(text) AS bytes FROM bc),
bs AS (SELECT * FROM bv WHERE length(v) BETWEEN {evasion.LEAST_CHARS} AND {evasion.MOST_CHARS} AND bytes <= {evasion.MOST_BYTES} AND (starts_with(stratum, 'control') OR NOT {{grammar}}) QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY sha256('evasion/1:' || base_id), base_id) <= {_QUOTA}),
ph AS (SELECT *, regexp_extract(v, {_q(evasion.PREFIX)}) AS px, regexp_extract(b, '[^\\n]*$') AS ln, regexp_extract(a, '^[^\\n]*') AS le FROM bs),
pq AS (SELECT *, CASE WHEN length(px) < length(v) - 8 THEN px ELSE '' END AS head, '' AS tail, left(b, length(b) - length(ln)) AS above, right(a, length(a) - length(le)) AS below, regexp_matches(ln, {_q(evasion.NAME_BEFORE)}) AS named FROM ph),
pr AS (SELECT *, v[length(head) + 1:] AS body, CASE WHEN named THEN regexp_extract(ln, {_q(evasion.NAME_BEFORE)}, 1) END AS name, CASE WHEN named THEN regexp_replace(ln, {_q(evasion.NAME_BEFORE)}, '') ELSE ln END AS lead, CASE WHEN named THEN regexp_replace(le, '^[\\x22'']', '') ELSE le END AS rest FROM pq),
pt AS (SELECT *, string_split(body, '') AS ch, length(body) AS n FROM pr)"""
_GRAMMAR = f"(SELECT ({_NEGATIVE}) NOT IN ('none', 'dotted-reference') FROM (SELECT bv.v AS v, '' AS b, '' AS a))"
_MADE = _BASES.replace("{grammar}", _GRAMMAR) + ", va0 AS (" + " UNION ALL ".join(_row(g, k, op) for k, (g, op) in enumerate(_OPS)) + """),
va AS (SELECT k, attack_class, operator, base_id, expectation, b || l || s || r || a AS text, strlen(b || l)::INTEGER AS s0, strlen(b || l || s)::INTEGER AS e0, strlen(b)::INTEGER AS es0, strlen(b || l || s || r)::INTEGER AS ee0 FROM va0
  WHERE b || l || s || r || a IS NOT NULL AND (how = 'replace' OR CASE WHEN how = 'line' THEN b || l || s || r || a <> old ELSE l || s || r <> v END))"""


@add(_MADE + ' SELECT attack_class, operator, base_id, expectation, sha256(text) AS sha, s0 AS start, e0 AS "end", es0 AS env_start, ee0 AS env_end FROM va')
def evasion_variants(spark, sf_dir):
    return evasion.variants(bases(spark, sf_dir)).withColumn("text", F.sha2("text", 256)).withColumnRenamed("text", "sha").withColumns({c: F.col(c).cast("int") for c in ("start", "end", "env_start", "env_end")})


def detected(variants):
    """variants with found: true values by pattern; those of tokens are statistical and banded by their different characters."""
    rows = variants.withColumn("values", fx.true_values(F.col("text")))

    def finding(v):
        value = tx.byte_slice(F.col("text"), v["start"], v["end"])
        symbols = F.size(F.array_distinct(F.split(value, "")))
        band = F.when(symbols < 6, "none").when(symbols < 10, "low").when(symbols < 14, "medium").otherwise("high")
        return F.struct(v["start"].alias("start"), v["end"].alias("end"), band.alias("band"), (v["family"] == "token").alias("statistical"), tx.exclusion_grammar(value).alias("exclusion"))

    return rows.withColumn("found", F.transform("values", finding)).drop("values")


_FOUND = f", vd AS (SELECT base_id * 1000 + k AS doc_id, text, '' AS source, va.* EXCLUDE (text) FROM va), vt AS ({base().replace(_HEAD, _HEAD.replace('documents', 'vd'))} SELECT doc_id, family, s, e FROM truth)" + f""",
vf AS (SELECT vd.*, vt.s, vt.e, vt.family = 'token' AS statistical, decode(encode(text)[vt.s + 1:vt.e]) AS v, '' AS b, '' AS a FROM vd JOIN vt USING (doc_id)),
vg AS (SELECT *, NOT statistical OR len(list_distinct(string_split(v, ''))) >= 10 AS kept, ({_NEGATIVE}) NOT IN ('none', 'dotted-reference') AS negative, e - s - CASE WHEN expectation = 'must-redact' THEN greatest(0, least(e, ee0) - greatest(s, es0)) ELSE 0 END AS outside, s <= s0 AND e >= e0 AS covers FROM vf),
vo AS (SELECT vd.doc_id, vd.attack_class, vd.expectation = 'must-redact' AS positive, CASE WHEN vd.expectation = 'must-redact' THEN vd.e0 - vd.s0 ELSE 0 END AS bytes, coalesce(bool_or(CASE WHEN vd.expectation = 'must-redact' THEN covers ELSE true END) FILTER (vg.doc_id IS NOT NULL), false) AS legacy,
  coalesce(bool_or(CASE WHEN vd.expectation = 'must-redact' THEN covers ELSE true END) FILTER (kept), false) AS candidate, coalesce(sum(outside), 0) AS lo, coalesce(sum(outside) FILTER (kept), 0) AS co, coalesce(bool_or(negative), false) AS negative
  FROM vd LEFT JOIN vg ON vg.doc_id = vd.doc_id GROUP BY 1, 2, 3, 4)"""


@add(_MADE + _FOUND + """ SELECT attack_class, count(*) AS variants, count(*) FILTER (NOT positive) AS controls, count(*) FILTER (positive AND candidate) AS detection_preserved, count(*) FILTER (positive AND legacy) AS legacy_detection_preserved, count(*) FILTER (positive AND NOT candidate) AS leaked_spans,
  count(*) FILTER (positive AND NOT legacy) AS legacy_leaked_spans, count(*) FILTER (positive AND legacy AND NOT candidate) AS leaked_only_under_candidate, count(*) FILTER (NOT positive AND candidate) AS false_alarms, count(*) FILTER (NOT positive AND legacy) AS legacy_false_alarms,
  sum(bytes)::BIGINT AS must_redact_bytes, sum(co)::BIGINT AS collateral_bytes, sum(lo)::BIGINT AS legacy_collateral_bytes, count(*) FILTER (negative) AS negative_evidence_applied FROM vo GROUP BY ROLLUP (attack_class)""")
def evasion_outcomes(spark, sf_dir):
    """What reshaping does to detection, by attack class and in total."""
    return evasion.tally(evasion.outcomes(detected(evasion.variants(bases(spark, sf_dir)))))
