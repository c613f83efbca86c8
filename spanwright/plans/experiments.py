"""Queries on logistic fits and on the grid of scoring configurations."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanwright.functions import text as tx
from spanwright.operators import experiments, logistic
from spanwright.sources import fixtures as fx

from .documents import _LONGEST_OF
from .evaluation import add
from .measurement import Inputs

_CELLS = "WITH RECURSIVE c AS (SELECT l_quantity::DOUBLE AS a, l_discount::DOUBLE AS b, l_tax::DOUBLE AS d, (l_returnflag = 'R')::INTEGER::DOUBLE AS y, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2, 3, 4)"
_FEATURES = ["a", "b", "d"]


def _descent(features: list[str], steps: int, rate: float, l2: float) -> str:
    """CTEs z (standardised cells), m (mean and scale) and s (weights after each step)."""
    mean = ", ".join(f"sum(n * {f}) / sum(n) AS m{f}" for f in features)
    scale = ", ".join(f"coalesce(nullif(sqrt(sum(n * ({f} - m{f}) ** 2) / sum(n)), 0), 1) AS s{f}" for f in features)
    dot = " + ".join(f"w{f} * z.{f}" for f in features)
    step = ", ".join(f"w{f} - {rate} * (g{f} / total + {l2} * w{f})" for f in features)
    grad = ", ".join(f"sum((1 / (1 + exp(-({dot} + bias))) - y) * n * z.{f}) AS g{f}" for f in features)
    kept = ", ".join(f"any_value(w{f}) AS w{f}" for f in features)
    return f""", m0 AS (SELECT {mean}, sum(n) AS total FROM c), m AS (SELECT any_value(COLUMNS(m0.*)), {scale} FROM c, m0),
z AS (SELECT y, n, {', '.join(f'({f} - m{f}) / s{f} AS {f}' for f in features)} FROM c, m),
s AS (SELECT 0 AS k, {', '.join(f'0.0::DOUBLE AS w{f}' for f in features)}, 0.0::DOUBLE AS bias UNION ALL
  SELECT k + 1, {step}, bias - {rate} * gbias / total FROM (SELECT k, {kept}, any_value(bias) AS bias, {grad}, sum((1 / (1 + exp(-({dot} + bias))) - y) * n) AS gbias FROM s, z WHERE k < {steps} GROUP BY k), m0)"""


def _rows(spark, sf_dir):
    x = fx.table(spark, sf_dir, "lineitem")
    return x.select(F.col("l_quantity").alias("a"), F.col("l_discount").alias("b"), F.col("l_tax").alias("d"), (F.col("l_returnflag") == "R").alias("y"))


@add(_CELLS + _descent(_FEATURES, 400, 0.5, 0.001) + " SELECT unnest(['a', 'b', 'd', 'bias']) AS feature, round(unnest([wa, wb, wd, bias]), 5) AS weight, round(unnest([ma, mb, md, 0]), 5) AS mean, round(unnest([sa, sb, sd, 1]), 5) AS scale FROM s, m WHERE k = 400", plain=True)
def fit_logistic(spark, sf_dir):
    """Weights of three measures of line items, for whether they were returned."""
    f = logistic.fit(_rows(spark, sf_dir), _FEATURES, "y", steps=400)
    rows = [(n, w, m, s) for n, w, m, s in zip(f.features, f.weights.tolist(), f.mean.tolist(), f.scale.tolist(), strict=True)] + [("bias", f.bias, 0.0, 1.0)]
    return spark.createDataFrame([(n, round(w, 5), round(m, 5), round(s, 5)) for n, w, m, s in rows], "feature string, weight double, mean double, scale double")


_SCORES = "WITH RECURSIVE c AS (SELECT floor(l_extendedprice / 1000)::DOUBLE AS a, (l_returnflag = 'R')::INTEGER::DOUBLE AS y, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2)"


@add(_SCORES + _descent(["a"], 3000, 0.1, 0.0) + ", p AS (SELECT c.a, c.y, c.n, 1 / (1 + exp(-(wa * ((c.a - ma) / sa) + bias))) AS p FROM c, m, s WHERE k = 3000), b AS (SELECT least(9, floor(p * 10)) AS bin, sum(n) AS n, sum(n * p) AS p, sum(n * y) AS y, sum(n * (p - y) * (p - y)) AS e FROM p GROUP BY 1), d AS (SELECT sum(e) / sum(n) AS brier, sum(abs(p - y)) / sum(n) AS ece FROM b) SELECT round(wa, 6) AS slope, round(bias, 6) AS bias, round(ma, 6) AS mean, round(sa, 6) AS scale, round(brier, 6) AS brier, round(ece, 6) AS expected_calibration_error FROM s, m, d WHERE k = 3000", plain=True)
def platt_fit(spark, sf_dir):
    """The logistic curve of one whole-number score, with its error and calibration error."""
    x = fx.table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_extendedprice") / 1000).cast("double").alias("a"), (F.col("l_returnflag") == "R").alias("y"))
    f = logistic.platt(x, "a", "y")
    d = logistic.diagnostics(x.withColumn("p", f.column()), "p", "y")
    six = lambda v: F.round(v if hasattr(v, "alias") else F.lit(float(v)), 6)
    return d.select(six(f.weights[0]).alias("slope"), six(f.bias).alias("bias"), six(f.mean[0]).alias("mean"), six(f.scale[0]).alias("scale"), six(F.col("brier")).alias("brier"), six(F.col("expected_calibration_error")).alias("expected_calibration_error"))


MEASURES = ["symbols", "length", "classes"]
SPECS = experiments.grid({"q1": ("symbols",)}, {"l2": ("length", "classes"), "l1": ("length",), "l0": ()})
_CLASSES = ["[a-z]", "[A-Z]", "[0-9]", "[^a-zA-Z0-9]"]


def candidates(spark, sf_dir):
    """True values of positives and the longest token of each control, with measures, folds (by source) and sides (by id)."""
    rows = Inputs(spark, sf_dir).measured
    token = tx.longest_token(F.col("text"))
    of_control = F.array_compact(F.array(F.when(F.col("kind") == "must-not-flag", token)))
    spans = F.concat(F.transform("truth", lambda v: F.struct(v["start"].cast("int").alias("start"), v["end"].cast("int").alias("end"))), F.transform(of_control, lambda t: F.struct(t["start"].cast("int").alias("start"), t["end"].cast("int").alias("end"))))
    each = rows.select("doc_id", "text", "source", "kind", F.explode(spans).alias("s"))
    v = tx.byte_slice(F.col("text"), F.col("s.start"), F.col("s.end"))
    each = each.withColumn("v", v).withColumn("before", F.hex(F.substring(F.col("text").cast("binary"), F.col("s.start"), F.lit(1))))
    number = F.regexp_extract("source", "[0-9]+", 0)
    positive = F.when(F.col("kind") == "must-redact", True).when(F.col("kind") == "must-not-flag", False)
    classes = sum((F.col("v").rlike(p).cast("int") for p in _CLASSES), F.lit(0))
    context = (F.col("s.start") > 0) & F.col("before").isin("22", "3D", "3A", "28")
    return each.select(
        F.concat(F.lit("s"), F.coalesce(F.nullif(number, F.lit("")).cast("int") % 5, F.lit(0)).cast("string")).alias("fold"), (F.col("doc_id") % 4 == 3).alias("evaluation"), positive.alias("positive"),
        ((F.col("kind") == "must-not-flag") & (F.col("doc_id") % 3 != 0)).alias("independent"), context.alias("context"), F.col("v").rlike(r"^[xX*.-]+$").alias("negative"),
        F.size(F.array_distinct(F.split("v", ""))).alias("symbols"), F.length("v").alias("length"), classes.alias("classes"),
    )


_CANDIDATES = _LONGEST_OF + f""",
cv AS (SELECT doc_id, s, decode(encode(text)[s + 1:e]) AS v FROM truth JOIN docs USING (doc_id) UNION ALL SELECT doc_id, s, v FROM lt JOIN fx USING (doc_id) WHERE kind = 'must-not-flag'),
ca AS (SELECT 's' || coalesce(nullif(regexp_extract(fx.source, '[0-9]+'), '')::INTEGER % 5, 0) AS fold, cv.doc_id % 4 = 3 AS evaluation, CASE kind WHEN 'must-redact' THEN true WHEN 'must-not-flag' THEN false END AS positive,
  kind = 'must-not-flag' AND cv.doc_id % 3 <> 0 AS independent, s > 0 AND hex(encode(text)[s:s]) IN ('22', '3D', '3A', '28') AS context, regexp_matches(v, '^[xX*.-]+$') AS negative,
  len(list_distinct(string_split(v, ''))) AS symbols, length(v) AS length, {' + '.join(f"regexp_matches(v, '{p}')::INTEGER" for p in _CLASSES)} AS classes FROM cv JOIN fx USING (doc_id) JOIN docs USING (doc_id)),
ce AS (SELECT fold, evaluation, positive, independent, context, negative, symbols, length, classes, count(*) AS n FROM ca WHERE positive IS NOT NULL GROUP BY ALL),
fo AS (SELECT DISTINCT fold AS left_out FROM ce WHERE NOT evaluation UNION ALL SELECT ''),
me AS (SELECT fold, positive, n, unnest(['symbols', 'length', 'classes']) AS measure, unnest([symbols, length, classes]) AS x FROM ce WHERE NOT evaluation),
md AS (SELECT left_out, measure, positive, x, sum(sum(n)) OVER (PARTITION BY left_out, measure, positive ORDER BY x) AS run, sum(sum(n)) OVER (PARTITION BY left_out, measure, positive) AS total FROM me, fo WHERE fold <> left_out GROUP BY 1, 2, 3, 4),
mm AS (SELECT left_out, measure, coalesce(min(x) FILTER (NOT positive AND run >= total / 2), 0) AS lo, coalesce(min(x) FILTER (positive AND run >= total / 2), 0) AS top FROM md GROUP BY 1, 2),
ra AS (SELECT left_out, {', '.join(f"max(lo) FILTER (measure = '{m}') AS lo_{m}, max(greatest(lo, top)) FILTER (measure = '{m}') AS hi_{m}" for m in MEASURES)} FROM mm GROUP BY 1),
sp AS (SELECT col0 AS spec, col1 AS name, col2 AS lx, col3 AS r, col4 AS l, col5 AS c, col6 AS most, col7 AS parameters FROM (VALUES {', '.join(f"({i}, '{s.name}', {len(s.lexical)}, {s.r}, {s.l}, {s.c}, {s.most}, {s.parameters})" for i, s in enumerate(SPECS))}))"""


def _ramp(m: str, cap: str) -> str:
    return f"(CASE WHEN {m} <= lo_{m} THEN 0 WHEN {m} >= hi_{m} THEN {cap} ELSE floor(({m} - lo_{m}) * {cap} / (hi_{m} - lo_{m})) END)::INTEGER"


_PAIRS = ", ".join(f"({i}, {SPECS.index(o)})" for i, s in enumerate(SPECS) for o in [s, *experiments.neighbours(s, SPECS)])


def _middle(cost: str, where: str, name: str) -> str:
    return f"""{name}c AS (SELECT spec, left_out, t, {cost} AS cost FROM {where}), {name}r AS (SELECT *, t - row_number() OVER (PARTITION BY spec, left_out ORDER BY t) AS run FROM (SELECT *, min(cost) OVER (PARTITION BY spec, left_out) AS least FROM {name}c) WHERE cost <= least + 1e-12),
{name}p AS (SELECT spec, left_out, ((min(t) + max(t)) // 2)::INTEGER AS {name} FROM {name}r GROUP BY spec, left_out, run QUALIFY row_number() OVER (PARTITION BY spec, left_out ORDER BY min(t)) = 1)"""


_GRID = _CANDIDATES + f""", sk AS (SELECT spec, left_out, fold = left_out AS held, evaluation, positive, independent, most, r, l, c, n, CASE WHEN negative THEN 0 ELSE least(r, {_ramp('symbols', 'r')})
  + least(l, CASE lx WHEN 0 THEN 0 WHEN 1 THEN {_ramp('length', 'l')} ELSE greatest({_ramp('length', 'l')}, {_ramp('classes', 'l')}) + least({_ramp('length', 'l')}, {_ramp('classes', 'l')}) // 2 END) + CASE WHEN context THEN c ELSE 0 END END AS score
  FROM ce, ra, sp WHERE NOT evaluation OR left_out = ''),
hi AS (SELECT spec, left_out, held, evaluation, positive, independent, score, sum(n) AS n FROM sk GROUP BY ALL),
ts AS (SELECT spec, left_out, unnest(range(1, most + 2)) AS t, r, l, c, most FROM sp, fo),
own AS (SELECT * FROM hi WHERE NOT evaluation AND NOT held),
tt AS (SELECT spec, left_out, sum(n) FILTER (positive) AS p, sum(n) FILTER (NOT positive) AS q, sum(n) FILTER (NOT positive AND independent) AS i FROM own GROUP BY 1, 2),
ro AS (SELECT ts.spec, ts.left_out, ts.t, ts.r, ts.l, ts.c, ts.most, coalesce(sum(n) FILTER (positive AND score < t), 0) AS p, coalesce(sum(n) FILTER (NOT positive AND score >= t), 0) AS q, coalesce(sum(n) FILTER (NOT positive AND independent AND score >= t), 0) AS i FROM ts LEFT JOIN own ON own.spec = ts.spec AND own.left_out = ts.left_out GROUP BY ALL),
rt AS (SELECT ro.spec, ro.left_out, t, r, l, c, most, coalesce(ro.p::DOUBLE / tt.p, 0) AS leak, coalesce(ro.q::DOUBLE / tt.q, 0) AS alarm, coalesce(ro.i::DOUBLE / tt.i, 0) AS ind FROM ro JOIN tt ON tt.spec = ro.spec AND tt.left_out = ro.left_out),
hg AS (SELECT spec, left_out, coalesce(min(t) FILTER (t >= greatest(r + l, c) + 1 AND t >= 3 AND t <= most AND ind <= 0.02), max(most) + 1)::INTEGER AS high FROM rt GROUP BY 1, 2),
un AS (SELECT rt.*, high FROM rt JOIN hg USING (spec, left_out)), {_middle('leak + alarm', 'un WHERE t >= 2 AND t < high', 'medium')},
um AS (SELECT un.*, medium FROM un JOIN mediump USING (spec, left_out)), {_middle('2 * leak + alarm', 'um WHERE t < medium', 'low')},
th AS (SELECT spec, left_out, coalesce(low, 1)::INTEGER AS low, medium, high FROM hg JOIN mediump USING (spec, left_out) LEFT JOIN lowp USING (spec, left_out)),
er AS (SELECT spec, left_out, any_value(low) AS low, any_value(medium) AS medium, any_value(high) AS high, {', '.join(f"coalesce(sum(n) FILTER ({w} AND positive AND score < medium)::DOUBLE / sum(n) FILTER ({w} AND positive), 0) + coalesce(sum(n) FILTER ({w} AND NOT positive AND score >= medium)::DOUBLE / sum(n) FILTER ({w} AND NOT positive), 0) AS {name}" for name, w in (('dev', 'NOT evaluation AND NOT held'), ('ev', 'evaluation')))},
  CASE WHEN sum(n) FILTER (held AND positive) > 0 AND sum(n) FILTER (held AND NOT positive) > 0 THEN coalesce(sum(n) FILTER (held AND positive AND score < medium), 0)::DOUBLE / sum(n) FILTER (held AND positive) + coalesce(sum(n) FILTER (held AND NOT positive AND score >= medium), 0)::DOUBLE / sum(n) FILTER (held AND NOT positive) END AS he
  FROM hi JOIN th USING (spec, left_out) GROUP BY 1, 2),
fu AS (SELECT * FROM er WHERE left_out = ''), lo AS (SELECT spec, min(medium) AS medium_from, max(medium) AS medium_to, min(high) AS high_from, max(high) AS high_to, coalesce(max(he), 0) AS worst_held FROM er WHERE left_out <> '' GROUP BY 1),
nb AS (SELECT col0 AS spec, avg(dev) AS neighbourhood FROM (VALUES {_PAIRS}) JOIN fu ON fu.spec = col1 GROUP BY 1),
aq AS (SELECT sp.name, fu.spec, low, medium, high, dev AS error, ev AS evaluation_error, neighbourhood, parameters, medium_from, medium_to, high_from, high_to, worst_held,
  low >= 1 AND low < medium AND medium < high AND high <= most AND r + l < high AND c < high AS conforms FROM fu JOIN sp USING (spec) JOIN nb USING (spec) LEFT JOIN lo USING (spec)),
ad AS (SELECT *, coalesce(conforms AND neighbourhood <= min(CASE WHEN conforms THEN neighbourhood END) OVER () + 0.01, false) AS admissible FROM aq),
rq AS (SELECT *, admissible AND parameters = min(CASE WHEN admissible THEN parameters END) OVER () AS ranked FROM ad)
SELECT name, low, medium, high, round(error, 6) AS error, round(evaluation_error, 6) AS evaluation_error, round(neighbourhood, 6) AS neighbourhood, conforms, admissible, parameters::INTEGER AS parameters, medium_from, medium_to, high_from, high_to, round(worst_held, 6) AS worst_held,
  CASE WHEN ranked THEN row_number() OVER (ORDER BY ranked DESC NULLS LAST, medium_to - medium_from, round(neighbourhood, 9), round(abs(error - evaluation_error), 9), name) END::INTEGER AS rank FROM rq"""


@add(_GRID)
def experiment_grid(spark, sf_dir):
    """Every configuration of the grid fitted on development rows and without each fold, and the one that the rule selects."""
    out = experiments.run(candidates(spark, sf_dir), SPECS, MEASURES)
    return out.withColumns({c: F.round(c, 6) for c in ("error", "evaluation_error", "neighbourhood", "worst_held")})
