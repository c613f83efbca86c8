"""What a document looks like once a scanner's findings are replaced, and what is left of its values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwright.functions.text import byte_slice, let

#: Only findings of this action replace text.
REPLACING = "redact"
_SPAN = "array<struct<start:int,end:int>>"


def render(text: Column, spans: Column) -> Column:
    """The bytes of the text with each of the spans (array of start and end) replaced by a numbered mark; one that begins within an earlier one is left out.

    A span may cut a character, so the rest need not be valid UTF-8; ``make_valid_utf8`` makes a text of it.
    """
    raw = F.encode(text, "UTF-8")
    part = lambda start, end: F.hex(F.substring(raw, start + 1, end - start))
    none = F.array().cast(_SPAN)
    last = lambda kept: F.coalesce(F.try_element_at(kept, F.lit(-1))["end"], F.lit(0))
    kept = F.aggregate(F.array_sort(F.coalesce(spans, none)), none, lambda a, x: F.when(x["start"] >= last(a), F.concat(a, F.array(x))).otherwise(a))

    def join(k: Column) -> Column:
        parts = F.transform(k, lambda x, i: F.concat(part(F.coalesce(F.get(k, i - 1)["end"], F.lit(0)), x["start"]), F.hex(F.concat(F.lit("<SECRET_"), (i + 1).cast("string"), F.lit(">")))))
        return F.unhex(F.concat(F.array_join(parts, ""), part(last(k), F.octet_length(text))))

    return let(kept, join)


def outputs(text: Column, found: Column, scanners: list[str]) -> Column:
    """Array of the text as bytes after each of the scanners, by its findings in the row (scanner, start, end, action)."""
    of = lambda name: F.transform(F.filter(found, lambda f: (f["scanner"] == name) & (f["action"] == REPLACING)), lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end")))
    return F.array(*[render(text, of(name)) for name in scanners])


def occurrences(text: Column, value: Column) -> Column:
    return F.try_divide(F.octet_length(text) - F.octet_length(F.replace(text, value, F.lit(""))), F.octet_length(value)).cast("int")


def rendered(docs: DataFrame, truth: DataFrame, findings: DataFrame, scanners: list[str]) -> DataFrame:
    """doc_id, scanner, output (bytes), targets (family, start, end, leaked): a target leaks if its value stands more often in the output than where every target is replaced.

    Documents with a true value; the texts are shuffled once, whatever the number of scanners.
    """
    targets = truth.groupBy("doc_id").agg(F.collect_list(F.struct("family", "start", "end")).alias("targets"))
    found = findings.where(F.col("action") == REPLACING).groupBy("doc_id").agg(F.collect_list(F.struct("scanner", "start", "end")).alias("found"))
    whole = docs.select("doc_id", "text").join(targets, "doc_id").join(found, "doc_id", "left")
    every = F.transform("targets", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    whole = whole.withColumn("reference", render(F.col("text"), every)).withColumn("scanner", F.explode(F.array(*map(F.lit, scanners))))
    own = F.transform(F.filter("found", lambda f: f["scanner"] == F.col("scanner")), lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end")))
    output = whole.withColumn("output", render(F.col("text"), own))

    def judged(t: Column) -> Column:
        leaked = let(byte_slice(F.col("text"), t["start"], t["end"]), lambda v: occurrences(F.col("output").cast("string"), v) > occurrences(F.col("reference").cast("string"), v))
        return F.struct(t["family"].alias("family"), t["start"].alias("start"), t["end"].alias("end"), leaked.alias("leaked"))

    return output.select("doc_id", "scanner", "output", F.transform("targets", judged).alias("targets"))


def target_outcomes(truth: DataFrame, findings: DataFrame, scanners: DataFrame) -> DataFrame:
    """The best state of each target: exact, envelope, warn-only, partial or miss; the first two need a replacing finding."""
    f = findings.select("scanner", "doc_id", F.col("start").alias("f_start"), F.col("end").alias("f_end"), "action")
    near = (F.col("f_start") < F.col("end")) & (F.col("start") < F.col("f_end"))
    both = truth.crossJoin(F.broadcast(scanners)).join(f, ["scanner", "doc_id"], "left")
    exact = (F.col("f_start") == F.col("start")) & (F.col("f_end") == F.col("end"))
    inside = (F.col("f_start") <= F.col("start")) & (F.col("f_end") >= F.col("end")) & (F.col("f_start") >= F.col("env_start")) & (F.col("f_end") <= F.col("env_end"))
    rank = F.when((exact | inside) & (F.col("action") != REPLACING), 2).when(exact, 4).when(inside, 3).when(near, 1).otherwise(0)
    best = both.groupBy("scanner", "doc_id", "family", "start", "end").agg(F.max(rank).alias("rank"))
    state = F.element_at(F.array(*map(F.lit, ["miss", "partial", "warn-only", "envelope", "exact"])), F.col("rank") + 1)
    return best.select("scanner", "doc_id", "family", "start", "end", state.alias("outcome"))


def unexpected(truth: DataFrame, findings: DataFrame, companions: DataFrame | None = None) -> DataFrame:
    """Findings that share no byte with a target of their document and do not lie within one of its companions (doc_id, start, end)."""
    t = truth.select("doc_id", F.col("start").alias("t_start"), F.col("end").alias("t_end"))
    out = findings.join(t, (findings["doc_id"] == t["doc_id"]) & (F.col("start") < F.col("t_end")) & (F.col("t_start") < F.col("end")), "left_anti")
    if companions is None:
        return out
    c = companions.select(F.col("doc_id").alias("c_doc"), F.col("start").alias("c_start"), F.col("end").alias("c_end"))
    return out.join(c, (F.col("doc_id") == F.col("c_doc")) & (F.col("start") >= F.col("c_start")) & (F.col("end") <= F.col("c_end")), "left_anti")
