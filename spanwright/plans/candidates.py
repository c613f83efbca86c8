"""Queries on the text around values, shapes of documents, fits and scoped controls."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanwright.functions import offsets
from spanwright.functions import text as tx
from spanwright.operators import calibration, independence, scoring, variants
from spanwright.sources import fixtures as fx

from .base import base, wilson_sql
from .evaluation import _V, _VALUE, _values, add
from .measurement import Inputs


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_AROUND = ", ln AS (SELECT t.doc_id, t.family, t.s, decode(encode(text)[s + 1:e]) AS v, right(regexp_extract(decode(encode(text)[1:s]), '[^\\n]*$'), 64) AS b, left(regexp_replace(regexp_extract(decode(encode(text)[e + 1:]), '^[^\\n]*'), '\\r\\z', ''), 64) AS a FROM truth t JOIN docs USING (doc_id))"
# Values with the text around them, one of each grammar and lookalikes, beside the true values.
CASES = [
    ("{{ ", "secrets.KEY", " }}"), ("", "{{ secrets.KEY }}", ""), ("T=${", "HOME_DIR", "}"), ("T=$", "HOME_DIR", ""), ("T=%", "HOME", "%"), ("T=$(", "vault read x", ")"), ("", "`id`", ""),
    ("T=<", "your-token", ">"), ("T=", "xxxxxxxx", ""), ("T=", "xx", ""), ("T=", "your_api_key_here", ""), ("T=", "api_key", ""), ("k = ", "process.env.KEY", ""), ("T={{ ", "qJ7", ""), ("x$$", "HOME", ""),
]
_CASE_ROWS = ", ".join("(" + ", ".join(_q(x) for x in c) + ")" for c in CASES)
_PARTS = f"string_split(regexp_replace(lower(regexp_replace(coalesce(nullif(regexp_extract(b, {_q(tx.ASSIGNED_NAME)}, 1), ''), nullif(regexp_extract(b, {_q(tx.FLAG_NAME)}, 1), '')), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '[.-]', '_', 'g'), '_')"
_CONTEXT = f"CASE WHEN regexp_matches(b, {_q(tx.URL_USER)}) AND starts_with(a, '@') THEN 'url-userinfo' WHEN regexp_matches(b, {_q(tx.AUTHORIZATION)}) THEN 'authorization-header' WHEN {_PARTS} IS NULL THEN 'bare' WHEN list_has_any({_PARTS}, {_list(tx.CREDENTIAL_PARTS)}) THEN 'credential-name' ELSE 'other-name' END"
_WHOLE_ENVIRONMENT = r"^\$\{[A-Za-z_][A-Za-z0-9_]*(?::?-[^}]*)?\}\z|^\$[A-Za-z_][A-Za-z0-9_]*\z|^%[A-Za-z_][A-Za-z0-9_]*%\z"
_WHOLE_NAME = rf"^{tx.IDENTIFIER}\z"
_WORDS = r"list_filter(regexp_split_to_array(lower(v), '[_.\s-]+'), lambda w: w <> '')"
_NEGATIVE = rf"""CASE WHEN regexp_matches(v, '^\{{\{{[^{{}}]*\}}\}}\z') OR (regexp_matches(b, '\{{\{{\s*\z') AND regexp_matches(a, '^\s*\}}\}}') AND NOT regexp_matches(v, '[{{}}]')) THEN 'template-reference'
WHEN regexp_matches(v, {_q(_WHOLE_ENVIRONMENT)}) OR (regexp_matches(v, {_q(_WHOLE_NAME)}) AND ((regexp_matches(b, '\$\{{\z') AND regexp_matches(a, '^(?::?-[^}}]*)?\}}')) OR (regexp_matches(b, '(?:^|[^$])\$\z') AND NOT regexp_matches(a, '^[A-Za-z0-9_]')) OR (regexp_matches(b, '%\z') AND regexp_matches(a, '^%')))) THEN 'environment-reference'
WHEN regexp_matches(v, '^\$\([^()]*\)\z|^`[^`]*`\z') OR (regexp_matches(b, '\$\(\s*\z') AND regexp_matches(a, '^\s*\)') AND NOT regexp_matches(v, '[()]')) THEN 'command-substitution'
WHEN regexp_matches(v, '^<[A-Za-z0-9_ .-]+>\z') OR (regexp_matches(v, '^[A-Za-z0-9_ .-]+\z') AND regexp_matches(b, '<\z') AND regexp_matches(a, '^>')) THEN 'angle-placeholder'
WHEN length(v) >= 3 AND list_contains({_list(tx.MASKS)}, v[1]) AND replace(v, v[1], '') = '' THEN 'mask'
WHEN len({_WORDS}) > 0 AND list_has_all({_list(tx.PLACEHOLDER_WORDS)}, {_WORDS}) AND list_has_any({_WORDS}, {_list(tx.PLACEHOLDER_MARKS)}) THEN 'placeholder-vocabulary'
WHEN regexp_matches(v, {_q(tx.DOTTED)}) AND contains(v, '.') THEN 'dotted-reference' ELSE 'none' END"""


def _around(spark, sf_dir):
    x = Inputs(spark, sf_dir).measured.select("doc_id", "text", F.explode("truth").alias("x")).select("doc_id", "text", "x.*")
    return x.select("doc_id", "family", "start", tx.byte_slice(F.col("text"), F.col("start"), F.col("end")).alias("v"), tx.line_before(F.col("text"), F.col("start")).alias("b"), tx.line_after(F.col("text"), F.col("end")).alias("a"))


def _classed(spark, sf_dir):
    """True values as they stand, and the made cases once a document."""
    made = F.explode(F.array(*[F.struct(F.lit(n).alias("start"), F.lit(b).alias("b"), F.lit(v).alias("v"), F.lit(a).alias("a")) for n, (b, v, a) in enumerate(CASES)]))
    cases = fx.documents(spark, sf_dir).select("doc_id", F.lit("made").alias("family"), made.alias("x")).select("doc_id", "family", "x.start", "x.v", "x.b", "x.a")
    return _around(spark, sf_dir).unionByName(cases)


_CLASSED = _AROUND + f", cl AS (SELECT doc_id, family, s AS start, v, b, a FROM ln UNION ALL SELECT doc_id, 'made', n, v, b, a FROM docs, (SELECT (row_number() OVER () - 1)::INTEGER AS n, col0 AS b, col1 AS v, col2 AS a FROM (VALUES {_CASE_ROWS})))"


@add(_CLASSED + f" SELECT doc_id, family, start, {_NEGATIVE} AS class FROM cl")
def negative_class(spark, sf_dir):
    return _classed(spark, sf_dir).select("doc_id", "family", "start", tx.negative_class(F.col("v"), F.col("b"), F.col("a")).alias("class"))


@add(_CLASSED + f" SELECT doc_id, family, start, {_CONTEXT} AS class FROM cl")
def context_class(spark, sf_dir):
    return _classed(spark, sf_dir).select("doc_id", "family", "start", tx.context_class(F.col("b"), F.col("a")).alias("class"))


_LONGEST = "list_position(list_transform(m, lambda t: length(t)), list_max(list_transform(m, lambda t: length(t))))"


@add(f"WITH p AS (SELECT doc_id, regexp_extract_all(text, {_q(tx.TOKEN)}) AS m, regexp_split_to_array(text, {_q(tx.TOKEN)}) AS x FROM documents), i AS (SELECT *, {_LONGEST}::INTEGER AS i FROM p WHERE len(m) > 0), s AS (SELECT doc_id, m[i] AS t, (coalesce(list_sum(list_transform(x[1:i], lambda y: strlen(y))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: strlen(y))), 0))::INTEGER AS start FROM i) SELECT doc_id, start, (start + strlen(t))::INTEGER AS \"end\" FROM s", plain=True)
def longest_token(spark, sf_dir):
    """Byte range of the earliest longest token of each document, which a control contributes."""
    d = tx.once(fx.table(spark, sf_dir, "documents").select("doc_id", "text"), "t", tx.longest_token(F.col("text")))
    return d.where("t is not null").select("doc_id", "t.start", "t.end")


@add(_VALUE + " SELECT sha256(v) AS value, count(DISTINCT doc_id) AS documents, count(DISTINCT family) AS families, min(doc_id) AS first FROM v GROUP BY 1 HAVING count(DISTINCT doc_id) > 1")
def shared_value_clusters(spark, sf_dir):
    """Values that several positives use."""
    g = _values(spark, sf_dir).groupBy(F.sha2("v", 256).alias("value")).agg(F.count_distinct("doc_id").alias("documents"), F.count_distinct("family").alias("families"), F.min("doc_id").alias("first"))
    return g.where("documents > 1")


_FORM = "lower(text)"
for _pattern, _mark in tx.NORMAL_FORM:
    _FORM = f"regexp_replace({_FORM}, {_q(_pattern)}, '{_mark}', 'g')"


def _similar_sql(table: str, key: str, width: int, least: float) -> str:
    return f"""WITH w AS (SELECT {key} AS id, list_filter(regexp_split_to_array({_FORM}, '[^\\p{{L}}\\p{{N}}⟨⟩_]+'), lambda x: x <> '') AS ws FROM {table}),
s AS (SELECT id, list_distinct(list_transform(range(1, greatest(len(ws) - {width} + 2, 2)), lambda i: array_to_string(ws[i:i + {width - 1}], ' '))) AS g FROM w WHERE len(ws) > 0),
c AS (SELECT min(id) AS id, count(*) AS copies, len(any_value(g)) AS n, list_sort(g) AS g FROM s GROUP BY list_sort(g)), u AS (SELECT id, unnest(g) AS t FROM c),
k AS (SELECT x.id AS a, y.id AS b, count(*) AS k FROM u x JOIN u y ON x.t = y.t AND x.id < y.id GROUP BY 1, 2)
SELECT a, b, x.copies AS copies_a, y.copies AS copies_b, round(k::DOUBLE / (x.n + y.n - k), 6) AS similarity FROM k JOIN c x ON x.id = a JOIN c y ON y.id = b WHERE k::DOUBLE / (x.n + y.n - k) >= {least}
UNION ALL SELECT id, id, copies, copies, 1.0 FROM c WHERE copies > 1"""


@add(_similar_sql("documents", "doc_id", 3, 0.5), plain=True)
def near_duplicate_pairs(spark, sf_dir):
    """Pairs of documents that are similar in normal form, by classes of equal ones."""
    d = fx.table(spark, sf_dir, "documents").select("doc_id", "text")
    return independence.similar_pairs(d).withColumn("similarity", F.round("similarity", 6))


@add(_similar_sql("benchmark", "item_id", 2, 0.01), plain=True)
def benchmark_similarity(spark, sf_dir):
    """Benchmark items that share more than a hundredth of their word pairs."""
    b = fx.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return independence.similar_pairs(b, 0.01, 2).withColumn("similarity", F.round("similarity", 6))


@add("""WITH r AS (SELECT doc_id, (doc_id * 37 % 50)::INTEGER AS s, (doc_id * 37 % 50 + doc_id % 7)::INTEGER AS e, strlen(text)::INTEGER AS n, text FROM documents UNION ALL SELECT doc_id, 0, strlen(text)::INTEGER + (doc_id % 2)::INTEGER, strlen(text)::INTEGER, text FROM documents)
SELECT doc_id, s AS start, e AS "end", CASE WHEN s < 0 OR e <= s THEN 'empty' WHEN e > n THEN 'outside' WHEN (hex(encode(text)[s + 1:s + 1]) BETWEEN '80' AND 'BF') OR (hex(encode(text)[e + 1:e + 1]) BETWEEN '80' AND 'BF') THEN 'inside-character' ELSE 'valid' END AS state FROM r""", plain=True)
def range_states(spark, sf_dir):
    """Whether made ranges of each document are byte ranges of whole characters."""
    d = fx.documents(spark, sf_dir)
    at = (F.col("doc_id") * 37 % 50).cast("int")
    made = F.array(F.struct(at.alias("start"), (at + F.col("doc_id") % 7).cast("int").alias("end")), F.struct(F.lit(0).alias("start"), (F.col("bytes") + F.col("doc_id") % 2).cast("int").alias("end")))
    x = d.select("doc_id", "text", "bytes", F.explode(made).alias("r")).select("doc_id", "text", "bytes", "r.*")
    return x.select("doc_id", "start", "end", tx.range_state(F.col("text"), F.col("start"), F.col("end")).alias("state"))


# Scores of line items stand in for those of candidates: returned ones are the positives, open ones the independent controls.
def _scored(spark, sf_dir):
    x = fx.table(spark, sf_dir, "lineitem")
    return x.select(F.col("l_quantity").cast("int").alias("score"), (F.col("l_returnflag") == "R").alias("positive"), (F.col("l_linestatus") == "O").alias("independent"), "l_discount", "l_tax", "l_extendedprice")


_SCORED = "WITH x AS (SELECT l_quantity::INTEGER AS score, l_returnflag = 'R' AS positive, l_linestatus = 'O' AS independent, l_discount, l_tax, l_extendedprice FROM lineitem)"
_BIN = {"discount": ("l_discount", 100), "tax": ("l_tax", 100), "price": ("l_extendedprice", 1)}


def _ramp_sql(weight: str) -> str:
    measured = " UNION ALL ".join(f"SELECT '{n}' AS signal, positive, {weight} AS w, floor({c} * {k} + 0.5)::BIGINT AS v FROM x" for n, (c, k) in _BIN.items())
    return _SCORED + f""", h AS (SELECT count(*) FILTER (NOT independent) AS made, count(*) FILTER (independent) AS own FROM x), m AS ({measured}),
r AS (SELECT signal, positive, v, sum(sum(w)) OVER (PARTITION BY signal, positive ORDER BY v) AS run, sum(sum(w)) OVER (PARTITION BY signal, positive) AS total FROM m GROUP BY 1, 2, 3),
q AS (SELECT signal, min(v) FILTER (NOT positive AND run >= total / 2) AS lo, min(v) FILTER (positive AND run >= total / 2) AS hi FROM r GROUP BY 1) SELECT signal, lo, greatest(lo, hi) AS hi FROM q"""


def _measures(rows, *more):
    made = F.explode(F.array(*[F.struct(F.lit(n).alias("signal"), F.floor(F.col(c) * k + 0.5).cast("long").alias("x")) for n, (c, k) in _BIN.items()]))
    return rows.select("positive", *more, made.alias("m")).select("m.signal", "positive", *more, "m.x")


@add(_ramp_sql("1"), plain=True)
def fit_ramps(spark, sf_dir):
    """Two constants a signal: the medians of controls and of positives."""
    return calibration.fit_ramps(_measures(_scored(spark, sf_dir)))


@add(_ramp_sql("CASE WHEN independent AND (SELECT made > own FROM h) THEN (SELECT made::DOUBLE / own FROM h) ELSE 1 END"), plain=True)
def weighted_ramps(spark, sf_dir):
    """The same medians where rows that stand for generated ones weigh no more than half of all."""
    rows = _scored(spark, sf_dir)
    counts = rows.groupBy((~F.col("independent")).alias("generated")).agg(F.count("*").alias("n"))
    weights = calibration.half_weights(counts).select((~F.col("generated")).alias("independent"), "weight")
    return calibration.fit_ramps(_measures(rows.join(F.broadcast(weights), "independent"), "weight"), "weight")  # two rows of weights


@add(_SCORED + ", c AS (SELECT score // 8 AS e, floor(l_extendedprice / 20000)::BIGINT AS l, sum(positive::INTEGER) AS p, sum((NOT positive)::INTEGER) AS n FROM x GROUP BY 1, 2), g AS (SELECT * FROM (SELECT DISTINCT e FROM c), (SELECT DISTINCT l FROM c)), f AS (SELECT e, l, floor(40 * (coalesce(p, 0) + 1)::DOUBLE / (coalesce(p, 0) + coalesce(n, 0) + 2))::BIGINT AS own FROM g LEFT JOIN c USING (e, l)) SELECT a.e::BIGINT AS e, a.l, max(b.own) AS points FROM f a JOIN f b ON b.e <= a.e AND b.l <= a.l GROUP BY 1, 2", plain=True)
def fit_lookup(spark, sf_dir):
    """Smoothed shares of positives by two measures, never falling along either."""
    x = _scored(spark, sf_dir).groupBy(F.floor(F.col("score") / 8).cast("long").alias("e"), F.floor(F.col("l_extendedprice") / 20000).cast("long").alias("l"))
    return calibration.fit_lookup(x.agg(F.count_if(F.col("positive")).alias("positive"), F.count_if(~F.col("positive")).alias("control")), 40)


@add(_SCORED + ", c AS (SELECT score, count(*) AS n, sum(positive::INTEGER) AS y FROM x GROUP BY 1), m AS (SELECT s.score AS a, t.score AS b, sum(c.y)::DOUBLE / sum(c.n) AS mean FROM c s JOIN c t ON s.score <= t.score JOIN c ON c.score BETWEEN s.score AND t.score GROUP BY 1, 2), l AS (SELECT m.a, c.score, min(m.mean) AS least FROM m JOIN c ON m.a <= c.score AND m.b >= c.score GROUP BY 1, 2) SELECT score, round(max(least), 6) AS fitted FROM l GROUP BY 1", plain=True)
def isotonic_fit(spark, sf_dir):
    cells = _scored(spark, sf_dir).groupBy("score").agg(F.count("*").alias("n"), F.count_if(F.col("positive")).alias("y"))
    return calibration.isotonic(cells).withColumn("fitted", F.round("fitted", 6))


_RATES = ", r AS (SELECT t::INTEGER AS t, (SELECT avg((score < t)::INTEGER) FROM x WHERE positive) AS leak, (SELECT avg((score >= t)::INTEGER) FROM x WHERE NOT positive) AS alarm, (SELECT avg((score >= t)::INTEGER) FROM x WHERE NOT positive AND independent) AS independent FROM (SELECT unnest(range(1, 52)) AS t))"


def _best(costs: str) -> str:
    return f"(SELECT ((min(t) + max(t)) // 2)::INTEGER FROM (SELECT t, run, min(run) OVER () AS first FROM (SELECT t, t - row_number() OVER (ORDER BY t) AS run FROM (SELECT t, cost, min(cost) OVER () AS least FROM ({costs})) WHERE cost <= least + 1e-12)) WHERE run = first)"


@add(_SCORED + _RATES + f", h AS (SELECT coalesce(min(t), 51)::INTEGER AS high FROM r WHERE t BETWEEN 3 AND 50 AND independent <= 0.02), m AS (SELECT high, {_best('SELECT t, leak + alarm AS cost FROM r WHERE t >= 2 AND t < (SELECT high FROM h)')} AS medium FROM h) SELECT {_best('SELECT t, 2 * leak + alarm AS cost FROM r WHERE t < (SELECT medium FROM m)')} AS low, medium, high FROM m", plain=True)
def fit_thresholds(spark, sf_dir):
    return calibration.fit_thresholds(_scored(spark, sf_dir), 3, 50)


# Twins: the derived tables once more, over texts whose first value is changed.
_HEAD = "docs AS (SELECT doc_id, text, source, strlen(text)::INTEGER AS bytes FROM documents)"
_FIRST = "f AS (SELECT doc_id, min_by(family, s::BIGINT * 4294967296 + e) AS scope_family, min_by(e, s::BIGINT * 4294967296 + e) AS upto FROM truth GROUP BY 1) SELECT d.doc_id, decode(encode(text)[1:upto - 1]) || '!' || decode(encode(text)[upto + 1:]) AS text, d.source, scope_family FROM docs d JOIN f USING (doc_id)"
assert _HEAD in base()
_TWINS = f"tdocs AS ({base()}, {_FIRST}), tfnd AS ({base().replace(_HEAD, _HEAD.replace('documents', 'tdocs'))} SELECT * FROM fnd), tw AS (SELECT scanners.scanner, t.doc_id, scope_family, count(f.scanner) AS findings, count(f.scanner) FILTER (f.family IS NULL OR f.family = scope_family) > 0 AS flagged, count(f.scanner) FILTER (f.family IS NOT NULL AND f.family <> scope_family) > 0 AS co_detected, count(*) FILTER (f.action = 'warn') AS warned, count(*) FILTER (f.action = 'redact') AS redacted FROM tdocs t CROSS JOIN (SELECT unnest(['exact', 'wide', 'cut', 'greedy', 'silent']) AS scanner) scanners LEFT JOIN tfnd f ON f.scanner = scanners.scanner AND f.doc_id = t.doc_id GROUP BY 1, 2, 3)"


def _twins(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    changed = fx.measured(fx.twins(i.measured))
    return i, scoring.control_counts(scoring.score_documents(changed, fx.SCANNERS))


@add(f"WITH {_TWINS} SELECT scanner, doc_id, scope_family, findings, flagged, co_detected, warned, redacted FROM tw", plain=True)
def twin_rows(spark, sf_dir):
    """Each twin as a control scoped to its family."""
    return _twins(spark, sf_dir)[1]


_PAIRED = f"WITH {_TWINS}, ro AS ({base()} SELECT * FROM rows), pr AS (SELECT ro.scanner, ro.doc_id, ro.kind, ro.tier, ro.miss, ro.spans, ro.leaked_spans = 0 AS covered, ro.exact + ro.covered = ro.spans AS acceptable, tw.scope_family, tw.flagged, tw.co_detected FROM ro JOIN tw USING (scanner, doc_id) WHERE ro.tier <> 'T0' AND ro.kind <> 'must-not-flag')"


@add(_PAIRED + " SELECT scanner, kind, tier, count(*) AS pairs, count(*) FILTER (covered AND NOT flagged) AS discriminated, count(*) FILTER (co_detected) AS co_detected, round(count(*) FILTER (covered AND NOT flagged)::DOUBLE / count(*), 6) AS rate FROM pr GROUP BY 1, 2, 3", plain=True)
def twin_discrimination(spark, sf_dir):
    i, tw = _twins(spark, sf_dir)
    good = F.count_if(F.col("covered") & ~F.col("flagged"))
    return scoring.pair_twins(i.rows(), tw).where("flagged is not null").groupBy("scanner", "kind", "tier").agg(F.count("*").alias("pairs"), good.alias("discriminated"), F.count_if(F.col("co_detected")).alias("co_detected"), F.round(good / F.count("*"), 6).alias("rate"))


# Families that are asked about: those of the patterns, one that can have no twin, and one that nobody has looked at.
PROBED = [*[(f, None) for f in fx.PATTERNS], ("licence", "prose has no near value"), ("iban", None)]
_PROBED = ", ".join(f"('{f}', {f'{chr(39)}{r}{chr(39)}' if r else 'NULL'})" for f, r in PROBED)


@add(_PAIRED.replace("JOIN tw USING (scanner, doc_id) WHERE ro.tier", "RIGHT JOIN tw USING (scanner, doc_id) WHERE true OR ro.tier").replace("pr AS (SELECT ro.scanner, ro.doc_id,", "pr AS (SELECT tw.scanner, tw.doc_id,") + f""", pf AS (SELECT col0 AS family, col1 AS reason FROM (VALUES {_PROBED})), sn AS (SELECT unnest([{', '.join(map(repr, fx.SCANNERS))}]) AS scanner),
g AS (SELECT scanner, scope_family AS family, count(*) AS twins, count(*) FILTER (tier <> 'T0' AND kind <> 'must-not-flag') AS pairs, count(*) FILTER (tier <> 'T0' AND kind <> 'must-not-flag' AND acceptable AND NOT flagged) AS discriminated FROM pr GROUP BY 1, 2)
SELECT sn.scanner, pf.family, coalesce(twins, 0) AS twins, coalesce(pairs, 0) AS pairs, coalesce(discriminated, 0) AS discriminated, CASE WHEN twins IS NULL THEN CASE WHEN reason IS NULL THEN 'unrecorded' ELSE 'un-probeable' END WHEN pairs = 0 THEN 'not-measured' WHEN discriminated = pairs THEN 'discriminated' ELSE 'not-discriminated' END AS state
FROM sn CROSS JOIN pf LEFT JOIN g ON g.scanner = sn.scanner AND g.family = pf.family""", plain=True)
def twin_probe_states(spark, sf_dir):
    """The one state of every scanner and family."""
    i, tw = _twins(spark, sf_dir)
    families = spark.createDataFrame(PROBED, "family string, reason string")
    return scoring.twin_probe(i.rows(), tw, families, i.scanners)


_SOME = _PAIRED.replace("JOIN tw USING (scanner, doc_id) WHERE ro.tier", "LEFT JOIN (SELECT * FROM tw WHERE doc_id % 4 < 2 OR doc_id % 10 = 9) tw USING (scanner, doc_id) WHERE ro.tier")


@add(_SOME + f""", g AS (SELECT scanner, kind, tier, count(*) AS positives, count(flagged) AS pairs, count(*) FILTER (covered AND NOT flagged) AS discriminated_v10, count(*) FILTER (acceptable AND NOT flagged) AS discriminated, count(*) FILTER (co_detected) AS co_detected FROM pr GROUP BY 1, 2, 3),
st AS (SELECT *, CASE WHEN pairs < 0.5 * positives THEN 'insufficient-coverage' WHEN pairs < 5 THEN 'insufficient-evidence' ELSE 'measured' END AS status FROM g)
SELECT *, CASE WHEN positives >= 5 THEN round(pairs::DOUBLE / positives, 6) END AS coverage, CASE WHEN positives >= 5 THEN {wilson_sql('pairs', 'positives', False)} END AS coverage_bound, CASE WHEN status = 'measured' THEN round(discriminated::DOUBLE / pairs, 6) END AS rate, CASE WHEN status = 'measured' THEN {wilson_sql('discriminated', 'pairs', False)} END AS rate_bound FROM st""", plain=True)
def twin_accounting(spark, sf_dir):
    """Twin coverage and rates where only some positives (by id) have a twin."""
    i, tw = _twins(spark, sf_dir)
    return scoring.account_twins(scoring.pair_twins(i.rows(), tw.where("doc_id % 4 < 2 or doc_id % 10 = 9")))


_ABSOLUTE = "CASE WHEN tier = 'T0' THEN 'review-required' WHEN (spans > 0 AND exact + covered = spans AND collateral_bytes = 0) OR (spans = 0 AND NOT flagged) THEN 'pass' ELSE 'fail' END"


@add(f"SELECT scanner, doc_id, CASE WHEN tier = 'T0' THEN 'absolute' WHEN spans > 0 THEN 'present-within-envelope' ELSE 'absent' END AS type, {_ABSOLUTE} AS status FROM rows")
def absolute_assertions(spark, sf_dir):
    return scoring.absolute(Inputs(spark, sf_dir).rows()).select("scanner", "doc_id", "type", "status")


@add(f"WITH {_TWINS}, ro AS ({base()} SELECT *, {_ABSOLUTE} AS status FROM rows) SELECT scanner, doc_id, 'must-flip' AS type, CASE WHEN status = 'review-required' THEN 'review-required' WHEN status = 'pass' AND NOT flagged AND spans > 0 THEN 'pass' ELSE 'fail' END AS status FROM (SELECT ro.scanner, ro.doc_id, ro.status, ro.spans, tw.flagged FROM ro JOIN tw USING (scanner, doc_id))", plain=True)
def must_flip_assertions(spark, sf_dir):
    """Each positive against its twin."""
    i, tw = _twins(spark, sf_dir)
    before = scoring.absolute(i.rows()).withColumn("positive", F.col("spans") > 0).withColumn("outcomes", F.lit(""))
    tier = before.select("scanner", "doc_id", "tier")
    after = tw.join(tier, ["scanner", "doc_id"]).withColumns({c: F.lit(0) for c in ("spans", "exact", "covered", "collateral_bytes")})
    after = scoring.absolute(after).withColumn("positive", F.lit(False)).withColumn("outcomes", F.lit(""))
    return scoring.relation(before, after, "must-flip")


# Each text once more within what the operators of one frame put around it, and with other line ends.
SAME = [*variants.FRAMES, variants.CRLF]
_OUTCOMES = f"SELECT r.scanner, r.doc_id, {_ABSOLUTE} AS status, o.outcomes FROM rows r LEFT JOIN (SELECT scanner, doc_id, string_agg(outcome, ',' ORDER BY s, e, family) AS outcomes FROM so GROUP BY 1, 2) o USING (scanner, doc_id)"
_SIDES = ", ".join(f"w{k} AS ({_V}SELECT doc_id, t AS text FROM v WHERE ok AND operator = '{name}'), d{k} AS (SELECT doc_id, w{k}.text, source FROM w{k} JOIN documents USING (doc_id)), b{k} AS ({base().replace(_HEAD, _HEAD.replace('documents', f'd{k}'))} {_OUTCOMES})" for k, name in enumerate(SAME))
_JOINED = " UNION ALL ".join(f"SELECT '{name}' AS operator, a.scanner, a.doc_id, 'same-detection' AS type, CASE WHEN a.status = 'review-required' OR b.status = 'review-required' THEN 'review-required' WHEN a.status = 'pass' AND b.status = 'pass' AND a.outcomes IS NOT DISTINCT FROM b.outcomes THEN 'pass' ELSE 'fail' END AS status FROM a JOIN b{k} b USING (scanner, doc_id)" for k, name in enumerate(SAME))


@add(f"WITH a AS ({base()} {_OUTCOMES}), {_SIDES} {_JOINED}", plain=True)
def same_detection_assertions(spark, sf_dir):
    """Each document against its variants: true values are carried into a variant by its offset map, scanners read the variant's text."""

    def judged(rows, keys):
        each = scoring.absolute(scoring.row_counts(scoring.score_documents(rows, fx.SCANNERS)))
        listed = F.array_join(F.transform(F.array_sort(F.transform("scored", lambda s: F.struct(s["start"], s["end"], s["family"], s["outcome"].alias("outcome")))), lambda s: s["outcome"]), ",")
        return each.select("scanner", *keys, "status", (F.col("spans") > 0).alias("positive"), F.when(F.col("spans") > 0, listed).alias("outcomes"))

    measured = Inputs(spark, sf_dir).measured
    made = variants.generate(measured, SAME).where("status = 'generated'").select(F.col("doc_id").alias("of"), "operator", F.col("text").alias("new"), "map")
    moved = lambda c: lambda s: offsets.moved(s[c], F.col("map")).cast("int").alias(c)
    at = [moved(c) for c in ("start", "end", "env_start", "env_end")]
    both = measured.drop("found").join(made, F.col("doc_id") == F.col("of"))
    rows = both.select("doc_id", "operator", "source", "kind", "tier", F.col("new").alias("text"), F.transform("truth", lambda s: F.struct(s["family"].alias("family"), *[m(s) for m in at])).alias("truth"))
    rows = rows.withColumn("found", fx.reported(F.col("text"), F.col("doc_id"), fx.true_values(F.col("text"))))
    before = judged(measured, ["doc_id"])
    return scoring.relation(before, judged(rows, ["doc_id", "operator"]), "same-detection", ["operator"])
