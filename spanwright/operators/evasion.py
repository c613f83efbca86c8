"""Values and their lines reshaped the way someone would who wants a scanner to miss them, and what scanners make of that.

A base is a short text with one value. Each operator of a class reshapes the
value, puts a harmless one in its place, or rewrites its line; spans and
envelopes of the variants follow from the lengths of the parts, so nothing is
searched. Bases are drawn by quota in hash order; no operator is random.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwright.functions.ranges import overlap_bytes
from spanwright.functions.text import exclusion_grammar

# Bounds of a base, bands from the lowest, and the band from which a statistical finding counts.
LEAST_CHARS, MOST_CHARS, MOST_BYTES = 12, 200, 4096
BANDS, CUT = ["none", "low", "medium", "high"], "medium"
#: How a vendor's prefix, a key's armour and an assigned name before a value look.
PREFIX = r"^[A-Za-z0-9]{1,10}[_-](?:[A-Za-z0-9]{1,8}[_-])?"
ARMOUR = r"\A(-----BEGIN [A-Z0-9 ]+-----\r?\n)([\s\S]*?)(\r?\n-----END [A-Z0-9 ]+-----)\z"
NAME_BEFORE = r"([A-Za-z_][A-Za-z0-9_.-]*)(?:\s*[:=]\s*[\x22']?|[\x22']?\s*:\s*[\x22']?)\z"
# Parameters of the operators.
BLOCKS, RUNS, TILES, CUTS, FLAT, LENGTHS = [2, 3, 4], [8, 16, 32], [2, 4, 8, 16], [16, 24], [4, 8, 12, 16, 20, 24, 32], [255, 256, 257]
SEGMENTS = [(4, "-", "dash"), (8, "-", "dash"), (8, ".", "dot"), (6, "_", "underscore")]
WRAPS = [("EXAMPLE", ""), ("", "EXAMPLE"), ("your_", "_here"), ("REPLACE_ME_", ""), ("xxxx", "xxxx"), ("TODO-", ""), ("sample.", ""), ("<", ">")]
MIXTURES = [("", "-EXAMPLE-VALUE"), ("REDACTED-", ""), ("****", ""), ("", "xxxx"), ("changeme-", ""), ("{{ secrets.API_KEY }}", ""), ("your-api-key-", "-here")]
EMBEDDED = [("template-prefix", "{{x}}", ""), ("windows-env-suffix", "", "%PATH%"), ("dotted-env-prefix", "process.env.", ""), ("env-braces-whole", "${", "}"), ("env-dollar-whole", "$", ""), ("backtick-whole", "`", "`")]
MIDDLES = [("env-in-middle", "${HOME}"), ("command-in-middle", "$(date)")]
_LOWER, _UPPER, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
SEQUENCES = [_LOWER, _DIGIT + "abcdef", _UPPER + _DIGIT, _UPPER + _LOWER + _DIGIT, _UPPER + _LOWER + _DIGIT + "+/"]
GRAMMARS = [
    "{{ secrets.API_KEY }}", "${API_KEY}", "${API_KEY:-changeme}", "$API_KEY", "%API_KEY%", "$(vault read -field=value kv/app)",
    "<your-api-key>", "********", "xxxxxxxxxxxxxxxx", "your-api-key-here", "REPLACE_ME", "REDACTED-EXAMPLE-VALUE",
]


def split_value(value: Column) -> dict[str, Column]:
    """head, body and tail: what stays fixed around the part of a value that is reshaped."""
    armoured = value.rlike(ARMOUR)
    prefix = F.regexp_extract(value, PREFIX, 0)
    head = F.when(F.length(prefix) < F.length(value) - 8, prefix).otherwise("")
    of = lambda k: F.regexp_extract(value, ARMOUR, k)
    return {"head": F.when(armoured, of(1)).otherwise(head), "body": F.when(armoured, of(2)).otherwise(F.substring(value, F.length(head) + 1, F.length(value))), "tail": F.when(armoured, of(3)).otherwise("")}


def split_line(before: Column, after: Column) -> dict[str, Column]:
    """above, lead, name (null without), rest and below: the text before the value's line, the line up to the assigned name, the name, the line after the value, and the text below."""
    line = F.substring_index(before, "\n", -1)
    found = line.rlike(NAME_BEFORE)
    end = F.substring_index(after, "\n", 1)
    return {
        "above": F.substring(before, F.lit(1), F.length(before) - F.length(line)), "lead": F.when(found, F.regexp_replace(line, NAME_BEFORE, "")).otherwise(line),
        "name": F.when(found, F.regexp_extract(line, NAME_BEFORE, 1)), "rest": F.when(found, F.regexp_replace(end, r"\A[\x22']", "")).otherwise(end),
        "below": F.substring(after, F.length(end) + 1, F.length(after)),
    }


@dataclass(frozen=True)
class Operator:
    """kind value: body or whole value to its new form with what is put before and after the secret; replace: a harmless value by length; line: what stands before and after the value on its line."""

    name: str
    kind: str
    make: Callable


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _joined(chars: Column) -> Column:
    return F.array_join(chars, "")


def _body(name: str, change: Callable[[Column, Column], Column]) -> Operator:
    """change(characters of the body, their number) gives the new body; null where the operator doesn't fit."""
    return Operator(name, "body", change)


def _around(name: str, before: Column | str, after: Column | str) -> Operator:
    return Operator(name, "around", lambda v: (before(v) if callable(before) else F.lit(before), after(v) if callable(after) else F.lit(after)))


def _whole(name: str, change: Callable[[Column], Column]) -> Operator:
    return Operator(name, "whole", change)


def _cycled(length: Column, symbols: Callable[[Column], Column]) -> Column:
    """The symbols at places 0 to length - 1, joined."""
    return F.when(length > 0, _joined(F.transform(F.sequence(F.lit(0), length - 1), symbols))).otherwise("")


def _code(c: Column) -> Column:
    return F.ascii(c)


def _mapped(change: Callable[[Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda chars, n: _joined(F.transform(chars, lambda c: F.when(c.rlike(r"\s"), c).otherwise(change(c))))


def _run(r: int) -> Callable[[Column, Column], Column]:
    """The middle symbol r times more."""

    def change(chars: Column, n: Column) -> Column:
        half = F.floor(n / 2).cast("int")
        return F.concat(_joined(F.slice(chars, F.lit(1), half)), F.repeat(F.coalesce(F.get(chars, half), F.lit("a")), F.lit(r)), _joined(F.slice(chars, half + 1, F.greatest(n, F.lit(1)))))

    return change


def _mirrored(chars: Column, n: Column) -> Column:
    half = F.slice(chars, F.lit(1), F.ceil(n / 2).cast("int"))
    return _joined(F.slice(F.concat(half, F.reverse(half)), F.lit(1), n))


def _flat(kept: int) -> Callable[[Column, Column], Column]:
    return lambda chars, n: F.when(n > kept, F.concat(_joined(F.slice(chars, F.lit(1), F.lit(kept))), F.repeat(F.get(chars, F.lit(kept - 1)), n - kept)))


def _tiled(p: int) -> Callable[[Column, Column], Column]:
    return lambda chars, n: _joined(F.transform(chars, lambda c, i: F.get(chars, i % F.least(F.lit(p), n))))


def _blocks(k: int) -> Callable[[Column, Column], Column]:
    return lambda chars, n: _joined(F.transform(chars, lambda c, i: F.get(chars, i - i % k)))


def _segmented(k: int, mark: str) -> Callable[[Column, Column], Column]:
    return lambda chars, n: _joined(F.transform(chars, lambda c, i: F.when((i > 0) & (i % k == 0), F.concat(F.lit(mark), c)).otherwise(c)))


def _padded(n: int) -> Callable[[Column], Column]:
    """The value repeated from its start up to n symbols."""
    return lambda v: F.when(F.length(v) < n, F.substring(F.repeat(v, F.ceil(F.lit(n) / F.length(v)).cast("int")), F.lit(1), F.lit(n)))


def _middle(put: str) -> Callable[[Column], Column]:
    half = lambda v: F.floor(F.length(v) / 2).cast("int")
    return lambda v: F.concat(F.substring(v, F.lit(1), half(v)), F.lit(put), F.substring(v, half(v) + 1, F.length(v)))


def _line(name: str, before: Callable[[dict], Column], after: Callable[[dict], Column] = lambda p: p["rest"]) -> Operator:
    return Operator(name, "line", lambda p: (before(p), after(p)))


def _assigned(p: dict, name: Column | None = None, mark: str = "=") -> Column:
    """The name and its mark, or nothing where there is no name."""
    return F.coalesce(F.concat(p["name"] if name is None else name, F.lit(mark)), F.lit(""))


_PLAIN = lambda p: F.concat(p["lead"], _assigned(p))
#: Attack classes and their operators.
OPERATORS: dict[str, list[Operator]] = {
    "controlled-repetition": [*[_body(f"block-repeat-{k}", _blocks(k)) for k in BLOCKS], _body("double-each", lambda c, n: _joined(F.transform(c, lambda x: F.concat(x, x)))), *[_body(f"insert-run-{r}", _run(r)) for r in RUNS]],
    "periodic-body": [*[_body(f"tile-{p}", _tiled(p)) for p in TILES], _body("mirror", _mirrored), *[Operator(f"benign-sequence-{k}", "replace", lambda n, s=s: _cycled(n, lambda i: F.substring(F.lit(s), i % len(s) + 1, F.lit(1)))) for k, s in enumerate(SEQUENCES, 1)]],
    "class-distribution": [
        _body("lower", lambda c, n: F.lower(_joined(c))), _body("upper", lambda c, n: F.upper(_joined(c))), _body("digits", _mapped(lambda c: (_code(c) % 10).cast("string"))),
        _body("hex", _mapped(lambda c: F.lower(F.hex(_code(c) % 16)))), _body("alnum-only", _mapped(lambda c: F.when(c.rlike("[A-Za-z0-9]"), c).otherwise("A"))), _body("binary-alphabet", _mapped(lambda c: F.when(_code(c) % 2 == 1, "b").otherwise("a"))),
    ],
    "length-segmentation": [
        *[_body(f"truncate-{k}", lambda c, n, k=k: F.when(n > k, _joined(F.slice(c, F.lit(1), F.lit(k))))) for k in CUTS], *[_body(f"segment-{k}-{word}", _segmented(k, mark)) for k, mark, word in SEGMENTS],
        _around("pad-before-bound", lambda v: F.repeat(F.lit("a"), F.greatest(F.lit(0), 257 - F.length(v))), ""), _around("pad-after", "", "a" * 64),
    ],
    "placeholder-wrapping": [_around(f"wrap-{k}", a, b) for k, (a, b) in enumerate(WRAPS, 1)],
    "embedded-reference": [*[_whole(name, _middle(put)) for name, put in MIDDLES], *[_around(name, a, b) for name, a, b in EMBEDDED]],
    "context-perturbation": [
        _line("spaced-separator", lambda p: F.concat(p["lead"], p["name"], F.lit(" = "))), _line("colon-separator", lambda p: F.concat(p["lead"], p["name"], F.lit(": "))),
        *[_line(f"{word}-quoted", lambda p, q=q: F.concat(_PLAIN(p), F.lit(q)), lambda p, q=q: F.concat(F.lit(q), p["rest"])) for word, q in (("double", '"'), ("single", "'"))],
        _line("export-prefix", lambda p: F.concat(p["lead"], F.lit("export "), p["name"], F.lit("="))),
        *[_line(f"name-{word}", lambda p, f=f: F.concat(p["lead"], f(p["name"]), F.lit("="))) for word, f in (("lower", F.lower), ("upper", F.upper))],
        _line("trailing-semicolon", _PLAIN, lambda p: F.concat(F.lit(";"), p["rest"])), _line("comment-prefix", lambda p: F.concat(F.lit("# "), _PLAIN(p))),
        _line("json-member", lambda p: F.concat(F.lit('{"'), F.coalesce(p["name"], F.lit("value")), F.lit('": "')), lambda p: F.concat(F.lit('"}'), p["rest"])),
        _line("tab-indent", lambda p: F.concat(F.lit("\t"), _PLAIN(p))), _line("non-credential-name", lambda p: F.concat(p["lead"], F.lit("build_ref="))),
    ],
    "negative-evidence-mixture": [*[_around(f"mixture-{k}", a, b) for k, (a, b) in enumerate(MIXTURES, 1)], *[Operator(f"full-grammar-{k}", "replace", lambda n, g=g: F.lit(g)) for k, g in enumerate(GRAMMARS, 1)]],
    "boundary-discontinuity": [*[_body(f"flatten-after-{k}", _flat(k)) for k in FLAT], *[_whole(f"length-{n}", _padded(n)) for n in LENGTHS]],
}
#: Strata of bases and how many of each are drawn.
QUOTAS = {"must-redact:statistical": 16, "must-redact:deterministic": 11, "control:flagged": 6, "control:unflagged": 4}


def select_bases(candidates: DataFrame, quotas: dict[str, int] = QUOTAS, version: str = "evasion/1") -> DataFrame:
    """Of candidates (base_id, stratum, before, value, after among others) the first of each stratum in hash order, as many as its quota.

    Only values of LEAST_CHARS to MOST_CHARS in texts of at most MOST_BYTES are
    bases, and no positive that is itself a reference or placeholder.
    """
    size = F.octet_length("before") + F.octet_length("value") + F.octet_length("after")
    fits = F.length("value").between(LEAST_CHARS, MOST_CHARS) & (size <= MOST_BYTES) & (F.col("stratum").startswith("control") | exclusion_grammar(F.col("value")).isNull())
    quota = F.coalesce(*[F.when(F.col("stratum") == k, q) for k, q in quotas.items()], F.lit(0))
    order = F.sha2(F.concat(F.lit(f"{version}:"), F.col("base_id").cast("string")), 256)
    place = F.row_number().over(Window.partitionBy("stratum").orderBy(order, "base_id"))
    return candidates.where(fits & (quota > 0)).withColumn("place", place).where(F.col("place") <= max(quotas.values())).where(F.col("place") <= quota).drop("place")


def variants(bases: DataFrame) -> DataFrame:
    """attack_class, operator, base_id, expectation, text, start, end, env_start, env_end: every operator's variant of every base (base_id, stratum, before, value, after).

    start and end are the bytes of what a positive must have covered, or of a
    control's reshaped value; the envelope is the whole reshaped value. Harmless
    values stand only in statistical positives, as controls. What leaves the text
    as it is is no variant.
    """
    rows = bases.select("base_id", "stratum", "before", "value", "after")
    rows = rows.withColumns({f"v_{k}": c for k, c in split_value(F.col("value")).items()}).withColumns({f"l_{k}": c for k, c in split_line(F.col("before"), F.col("after")).items()})
    rows = rows.withColumn("chars", _chars(F.col("v_body"))).withColumn("n", F.size("chars"))
    line = {k: F.col(f"l_{k}") for k in ("lead", "name", "rest")}
    positive = F.col("stratum").startswith("must-redact")
    kept = F.when(positive, "must-redact").otherwise("control")
    none = F.lit("")

    def variant(group: str, op: Operator) -> Column:
        before, after, left, right, expectation, fits = F.col("before"), F.col("after"), none, none, kept, F.lit(True)
        secret = F.col("value")
        if op.kind == "body":
            secret = F.concat(F.col("v_head"), op.make(F.col("chars"), F.col("n")), F.col("v_tail"))
        elif op.kind == "whole":
            secret = op.make(F.col("value"))
        elif op.kind == "around":
            left, right = op.make(F.col("value"))
        elif op.kind == "replace":
            secret, expectation, fits = op.make(F.length("value")), F.lit("control"), F.col("stratum") == "must-redact:statistical"
        else:
            a, b = op.make(line)
            before, after = F.concat(F.col("l_above"), a), F.concat(b, F.col("l_below"))
        made = F.struct(F.lit(group).alias("attack_class"), F.lit(op.name).alias("operator"), expectation.alias("expectation"), before.alias("b"), left.alias("l"), secret.alias("s"), right.alias("r"), after.alias("a"))
        text = F.concat(before, left, secret, right, after)
        return F.when(fits & (text.isNotNull()) & (text != F.concat("before", "value", "after") if op.kind == "line" else ((F.concat(left, secret, right) != F.col("value")) | F.lit(op.kind == "replace"))), made)

    made = F.filter(F.array(*[variant(g, op) for g, ops in OPERATORS.items() for op in ops]), lambda v: v.isNotNull())
    x = rows.select("base_id", F.explode(made).alias("v")).select("base_id", "v.*")
    size = lambda *c: sum((F.octet_length(n) for n in c), F.lit(0))
    return x.select("attack_class", "operator", "base_id", "expectation", F.concat("b", "l", "s", "r", "a").alias("text"), size("b", "l").alias("start"), size("b", "l", "s").alias("end"), size("b").alias("env_start"), size("b", "l", "s", "r").alias("env_end"))


def outcomes(variants: DataFrame) -> DataFrame:
    """Each variant with what scanning found: variants with ``found``, an array of findings (start, end, band, statistical, exclusion).

    A positive is flagged if a finding covers all of its secret, a control by any
    finding. The candidate drops statistical findings below the band CUT.
    Collateral bytes are summed over findings, within the envelope they are none
    (controls have none). Negative evidence is applied where a finding's value
    has an exclusion.
    """
    strong = F.array(*[F.lit(b) for b in BANDS[BANDS.index(CUT) :]])
    positive = F.col("expectation") == "must-redact"
    kept = F.filter("found", lambda f: ~f["statistical"] | F.array_contains(strong, f["band"]))
    rows = variants.withColumn("kept", kept)
    covers = lambda c: F.exists(c, lambda f: (f["start"] <= F.col("start")) & (f["end"] >= F.col("end")))
    inside = lambda f: F.when(positive, overlap_bytes(f["start"], f["end"], F.col("env_start"), F.col("env_end"))).otherwise(0)
    outside = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, f: n + f["end"] - f["start"] - inside(f))
    flagged = lambda c: F.when(positive, covers(c)).otherwise(F.size(c) > 0)
    return rows.select(
        "attack_class", "operator", "base_id", "expectation", flagged("found").alias("legacy_flagged"), flagged("kept").alias("candidate_flagged"),
        F.when(positive, F.col("end") - F.col("start")).otherwise(0).cast("long").alias("must_redact_bytes"), outside("found").alias("legacy_collateral"), outside("kept").alias("collateral"),
        F.exists("found", lambda f: f["exclusion"].isNotNull()).alias("negative_evidence"),
    )


def tally(results: DataFrame) -> DataFrame:
    """Counts of outcomes for each attack class and, with a null class, for all; the total is the sum of the classes."""
    positive, c, l_ = F.col("expectation") == "must-redact", F.col("candidate_flagged"), F.col("legacy_flagged")  # noqa: E741
    n = lambda test, name: F.count_if(test).alias(name)
    total = lambda col, name: F.coalesce(F.sum(col), F.lit(0).cast("long")).alias(name)
    return results.rollup("attack_class").agg(
        F.count("*").alias("variants"), n(~positive, "controls"), n(positive & c, "detection_preserved"), n(positive & l_, "legacy_detection_preserved"), n(positive & ~c, "leaked_spans"), n(positive & ~l_, "legacy_leaked_spans"),
        n(positive & ~c & l_, "leaked_only_under_candidate"), n(~positive & c, "false_alarms"), n(~positive & l_, "legacy_false_alarms"), total("must_redact_bytes", "must_redact_bytes"),
        total("collateral", "collateral_bytes"), total("legacy_collateral", "legacy_collateral_bytes"), n(F.col("negative_evidence"), "negative_evidence_applied"),
    )
