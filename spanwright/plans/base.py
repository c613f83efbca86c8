"""The derived measurement tables as SQL, for comparison with the DataFrame side."""

from __future__ import annotations

from spanwright.sources.fixtures import LICENCE, PATTERNS, SCANNERS

_RAW = "\n  UNION ALL ".join(f"SELECT doc_id, bytes, '{f}' AS family, regexp_extract_all(text, '{p}') AS m, regexp_split_to_array(text, '{p}') AS x FROM docs" for f, p in PATTERNS.items())
_AT = "(list_sum(list_transform(x[1:i], lambda s: strlen(s))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda s: strlen(s))), 0))::INTEGER"


def base(version: int = 1) -> str:
    cut = "CASE WHEN doc_id % 2 = 1 THEN e ELSE s + (e - s) // 2 END" if version == 2 else "s + (e - s) // 2"
    return f"""WITH docs AS (SELECT doc_id, text, source, strlen(text)::INTEGER AS bytes FROM documents),
raw AS ({_RAW}),
pos AS (SELECT doc_id, bytes, family, m, x, unnest(range(1, len(m) + 1)) AS i FROM raw WHERE len(m) > 0),
hit AS (SELECT doc_id, bytes, family, {_AT} AS a, {_AT} + strlen(m[i])::INTEGER AS b FROM pos),
truth AS (SELECT doc_id, family, CASE WHEN family = 'token' THEN a + 9 ELSE a END AS s, CASE WHEN family = 'token' THEN b - 1 ELSE b END AS e,
  CASE WHEN family = 'token' THEN a END AS es, CASE WHEN family = 'token' THEN b END AS ee, bytes FROM hit),
fx AS (SELECT d.doc_id, d.source, CASE WHEN t.doc_id IS NULL THEN 'must-not-flag' WHEN d.doc_id % 10 = 9 THEN 'policy' ELSE 'must-redact' END AS kind,
  CASE WHEN d.doc_id % 17 = 0 THEN 'T0' ELSE 'T' || (coalesce(nullif(regexp_extract(d.source, '[0-9]+'), ''), '0')::INTEGER % 3 + 1) END AS tier, d.bytes
  FROM docs d LEFT JOIN (SELECT DISTINCT doc_id FROM truth) t ON t.doc_id = d.doc_id),
lraw AS (SELECT doc_id, regexp_extract_all(text, '{LICENCE}') AS m, regexp_split_to_array(text, '{LICENCE}') AS x FROM docs),
lpos AS (SELECT doc_id, m, x, unnest(range(1, len(m) + 1)) AS i FROM lraw WHERE len(m) > 0),
lic AS (SELECT doc_id, {_AT} AS s, {_AT} + strlen(m[i])::INTEGER AS e FROM lpos),
fnd0 AS (SELECT 'exact' AS scanner, doc_id, family, s, e FROM truth
  UNION ALL SELECT 'wide', doc_id, family, greatest(s - 9, 0), least(e + 1, bytes) FROM truth
  UNION ALL SELECT 'cut', doc_id, family, s, {cut} FROM truth
  UNION ALL SELECT 'greedy', doc_id, NULL, s, least(e + 20, bytes) FROM truth WHERE doc_id % 3 <> 1
  UNION ALL SELECT 'wide', doc_id, 'licence', s, e FROM lic UNION ALL SELECT 'greedy', doc_id, NULL, s, e FROM lic),
fnd AS (SELECT *, CASE WHEN doc_id % 5 = 0 THEN 'warn' ELSE 'redact' END AS action FROM fnd0),
sc AS (SELECT unnest([{', '.join(repr(x) for x in SCANNERS)}]) AS scanner),
rk AS (SELECT sc.scanner, t.doc_id, t.family, t.s, t.e, any_value(t.es) AS es, any_value(t.ee) AS ee, max(CASE WHEN f.s = t.s AND f.e = t.e THEN 4
    WHEN f.s <= t.s AND f.e >= t.e AND f.s >= coalesce(t.es, t.s) AND f.e <= coalesce(t.ee, t.e) THEN 3
    WHEN f.s <= t.s AND f.e >= t.e THEN 2 WHEN f.s IS NOT NULL THEN 1 ELSE 0 END) AS r
  FROM truth t CROSS JOIN sc LEFT JOIN fnd f ON f.scanner = sc.scanner AND f.doc_id = t.doc_id AND t.s < f.e AND f.s < t.e GROUP BY 1, 2, 3, 4, 5),
isl0 AS (SELECT scanner, doc_id, s, e, max(e) OVER (PARTITION BY scanner, doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM fnd),
isl1 AS (SELECT *, sum((pm IS NULL OR s > pm)::INTEGER) OVER (PARTITION BY scanner, doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM isl0),
isl AS (SELECT scanner, doc_id, g, min(s) AS s, max(e) AS e FROM isl1 GROUP BY 1, 2, 3),
so AS (SELECT rk.scanner, rk.doc_id, rk.family, rk.s, rk.e, rk.es, rk.ee, ['MISS', 'PARTIAL', 'OVERBROAD', 'COVERED', 'EXACT'][r + 1] AS outcome,
  (CASE WHEN r < 2 THEN rk.e - rk.s - sum(CASE WHEN i.s IS NULL THEN 0 ELSE least(rk.e, i.e) - greatest(rk.s, i.s) END) ELSE 0 END)::BIGINT AS leaked_bytes
  FROM rk LEFT JOIN isl i ON i.scanner = rk.scanner AND i.doc_id = rk.doc_id AND rk.s < i.e AND i.s < rk.e GROUP BY rk.scanner, rk.doc_id, rk.family, rk.s, rk.e, rk.es, rk.ee, r),
al0 AS (SELECT scanner, doc_id, coalesce(es, s) AS s, coalesce(ee, e) AS e, max(coalesce(ee, e)) OVER (PARTITION BY scanner, doc_id ORDER BY coalesce(es, s), coalesce(ee, e) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM so),
al1 AS (SELECT *, sum((pm IS NULL OR s > pm)::INTEGER) OVER (PARTITION BY scanner, doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM al0),
al AS (SELECT scanner, doc_id, g, min(s) AS s, max(e) AS e FROM al1 GROUP BY 1, 2, 3),
ins AS (SELECT i.scanner, i.doc_id, sum(least(i.e, a.e) - greatest(i.s, a.s)) AS b FROM isl i JOIN al a ON a.scanner = i.scanner AND a.doc_id = i.doc_id AND i.s < a.e AND a.s < i.e GROUP BY 1, 2),
outb AS (SELECT t.scanner, t.doc_id, (t.b - coalesce(ins.b, 0))::BIGINT AS outside FROM (SELECT scanner, doc_id, sum(e - s) AS b FROM isl GROUP BY 1, 2) t LEFT JOIN ins ON ins.scanner = t.scanner AND ins.doc_id = t.doc_id),
per AS (SELECT scanner, doc_id, count(*) AS spans, count(*) FILTER (outcome = 'EXACT') AS exact, count(*) FILTER (outcome = 'COVERED') AS covered, count(*) FILTER (outcome = 'OVERBROAD') AS overbroad,
  count(*) FILTER (outcome = 'PARTIAL') AS partial, count(*) FILTER (outcome = 'MISS') AS miss, count(*) FILTER (outcome IN ('PARTIAL', 'MISS')) AS leaked_spans,
  sum(leaked_bytes)::BIGINT AS leaked_bytes, sum(e - s)::BIGINT AS secret_bytes FROM so GROUP BY 1, 2),
fc AS (SELECT scanner, doc_id, count(*) AS findings FROM fnd GROUP BY 1, 2),
rows AS (SELECT sc.scanner, fx.doc_id, fx.source, fx.kind, fx.tier, fx.bytes, coalesce(per.spans, 0) AS spans, coalesce(exact, 0) AS exact, coalesce(covered, 0) AS covered, coalesce(overbroad, 0) AS overbroad,
  coalesce(partial, 0) AS partial, coalesce(miss, 0) AS miss, coalesce(leaked_spans, 0) AS leaked_spans, coalesce(leaked_bytes, 0) AS leaked_bytes, coalesce(secret_bytes, 0) AS secret_bytes,
  coalesce(outside, 0) AS collateral_bytes, coalesce(findings, 0) AS findings, fx.kind = 'must-not-flag' AND coalesce(findings, 0) > 0 AS flagged
  FROM fx CROSS JOIN sc LEFT JOIN per ON per.scanner = sc.scanner AND per.doc_id = fx.doc_id LEFT JOIN outb ON outb.scanner = sc.scanner AND outb.doc_id = fx.doc_id LEFT JOIN fc ON fc.scanner = sc.scanner AND fc.doc_id = fx.doc_id),
grp AS (SELECT scanner, kind, tier, count(*) AS files, {', '.join(f"sum(CASE WHEN tier <> 'T0' THEN {c} ELSE 0 END)::BIGINT AS {c}" for c in ('spans', 'secret_bytes', 'exact', 'covered', 'overbroad', 'partial', 'miss', 'leaked_spans', 'leaked_bytes'))},
  sum(CASE WHEN tier <> 'T0' AND kind <> 'must-not-flag' THEN collateral_bytes ELSE 0 END)::BIGINT AS collateral_bytes,
  sum((tier <> 'T0' AND flagged)::INTEGER)::BIGINT AS flagged_files, sum(CASE WHEN tier <> 'T0' AND flagged THEN findings ELSE 0 END)::BIGINT AS control_findings FROM rows GROUP BY 1, 2, 3)
"""


def wilson_sql(k: str, n: str, upper: bool) -> str:
    sign = "+" if upper else "-"
    p = f"(({k})::DOUBLE / ({n}))"
    return f"CASE WHEN ({n}) > 0 THEN round(greatest(0.0, least(1.0, ({p} + 3.8416 / (2 * ({n})::DOUBLE) {sign} 1.96 * sqrt({p} * (1 - {p}) / ({n})::DOUBLE + 3.8416 / (4 * ({n})::DOUBLE * ({n})::DOUBLE))) / (1 + 3.8416 / ({n})::DOUBLE))), 6) END"
