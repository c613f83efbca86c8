"""Generated variants of texts, with offset maps that carry ranges into them, and edits of single values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwright.functions.offsets import crlf_moves, json_moves, moved, offset_map


@dataclass(frozen=True)
class Frame:
    """Text put before and after, and the pattern of texts that can't stand there unchanged (None: all can)."""

    before: str
    after: str
    refused: str | None


# What each operator puts around a text, and which characters it refuses.
FRAMES = {
    "context.unicode-prefix": Frame("# 🔑 密钥 café\n", "", None),
    "context.indent": Frame("    ", "", None),
    "context.json": Frame('{"value":"', '"}', r"[\x22\\\x00-\x1f]"),
    "context.quote": Frame('"', '"', r"[\x22\\\x00-\x1f]"),
    "context.single-quote": Frame("'", "'", r"['\\\x00-\x1f]"),
    "context.yaml": Frame("value: '", "'\n", r"['\x00-\x1f]"),
    "context.markdown": Frame("`", "`", r"[`\r\n]"),
}
#: Operators that rewrite characters of the text.
CRLF, JSON_STRING = "encoding.crlf", "encoding.json-string"
OPERATORS = [*FRAMES, CRLF, JSON_STRING]


def _json_escaped(text: Column) -> Column:
    """The text as it stands between the quotes of a JSON string."""
    quoted = F.to_json(F.struct(text.alias("v")))
    return F.substring(quoted, F.lit(7), F.length(quoted) - 8)


def apply(name: str, text: Column) -> tuple[Column, Column, Column]:
    """Whether an operator supports a text, the new text and the offset map."""
    if name == CRLF:
        alone = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) > (F.length(text) - F.length(F.replace(text, F.lit("\r\n"), F.lit("")))) / 2
        return alone, F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\n"), F.lit("\r\n")), offset_map(0, crlf_moves(text))
    if name == JSON_STRING:
        return F.lit(True), F.concat(F.lit('"'), _json_escaped(text), F.lit('"')), offset_map(1, json_moves(text))
    frame = FRAMES[name]
    supported = F.lit(True) if frame.refused is None else ~text.rlike(frame.refused)
    return supported, F.concat(F.lit(frame.before), text, F.lit(frame.after)), offset_map(len(frame.before.encode()))


def generate(docs: DataFrame, names: list[str] = OPERATORS) -> DataFrame:
    """doc_id, operator, status (generated or unsupported), text and map (null if unsupported), moved (bytes by which the end of the text moves) of each operator for each text.

    A null text supports no operator.
    """
    rows = docs.select("doc_id", "text")
    maps = {}
    for i, name in enumerate(names):  # Python columns stand in a projection of their own
        supported, text, shift = apply(name, F.col("text"))
        rows = rows.withColumn(f"map_{i}", shift)
        maps[name] = (F.coalesce(supported, F.lit(False)) & F.col("text").isNotNull(), text, F.col(f"map_{i}"))
    made = []
    for name, (supported, text, shift) in maps.items():
        end = moved(F.octet_length("text"), shift) - F.octet_length("text")
        made.append(F.struct(
            F.lit(name).alias("operator"), F.when(supported, "generated").otherwise("unsupported").alias("status"), F.when(supported, text).alias("text"),
            F.when(supported, shift).alias("map"), F.when(supported, end).otherwise(0).cast("int").alias("moved"),
        ))
    return rows.select("doc_id", F.explode(F.array(*made)).alias("v")).select("doc_id", "v.*")


def carry(spans: DataFrame, variants: DataFrame) -> DataFrame:
    """The spans (doc_id, family, start, end, env_start, env_end) of each document in its generated variants, with operator and bytes of the new text."""
    rows = variants.where("status = 'generated'").select("doc_id", "operator", "map", F.octet_length("text").alias("bytes"))
    both = spans.drop("bytes").join(rows, "doc_id")
    at = {c: moved(F.col(c), F.col("map")).cast("int").alias(c) for c in ("start", "end", "env_start", "env_end")}
    return both.select("doc_id", "operator", "family", *at.values(), "bytes")


def seeded(seed: Column, name: str, size: Column) -> Column:
    """A number from 0 below size that depends on the seed and the operator's name only."""
    digits = F.substring(F.sha2(F.concat(seed, F.lit(":" + name)), 256), 1, 8)
    return (F.conv(digits, 16, 10).cast("long") % size).cast("int")


ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DELIMITERS = r"[._-]"
EDITS = [
    "lexical.length-minus-one", "lexical.length-plus-one", "lexical.replace-last", "lexical.invalid-alphabet",
    "lexical.prefix-change", "boundary.remove-delimiter", "structural.remove-segment",
]


def edit_value(value: Column, name: str, seed: Column | None = None) -> Column:
    """Edits of one property of a value; null where the value lacks it. Choices depend on the seed (the value if not given)."""
    n, seed = F.length(value), value if seed is None else seed

    def prefix() -> Column:
        """Another first letter than the value's."""
        others = F.replace(F.lit(ALPHABET), F.upper(F.left(value, F.lit(1))), F.lit(""))
        return F.concat(F.substring(others, seeded(seed, name, F.length(others)) + 1, F.lit(1)), F.substring(value, F.lit(2), n))

    def delimiter() -> Column:
        """One of the delimiters taken out."""
        places = F.filter(F.sequence(F.lit(1), n), lambda i: F.substring(value, i, F.lit(1)).rlike(DELIMITERS))
        at = F.get(places, seeded(seed, name, F.size(places)))
        return F.when(value.rlike(DELIMITERS), F.concat(F.substring(value, F.lit(1), at - 1), F.substring(value, at + 1, n)))

    def segment() -> Column:
        """One of the segments after the first, split at dots, taken out."""
        parts = F.split(value, r"\.", -1)
        chosen = 1 + seeded(seed, name, F.size(parts) - 1)
        return F.when(F.contains(value, F.lit(".")), F.array_join(F.filter(parts, lambda _, i: i != chosen), "."))

    return {
        "lexical.length-minus-one": lambda: F.substring(value, F.lit(1), n - 1),
        "lexical.length-plus-one": lambda: F.concat(value, F.lit("A")),
        "lexical.replace-last": lambda: F.concat(F.substring(value, F.lit(1), n - 1), F.when(F.right(value, F.lit(1)) == "A", "B").otherwise("A")),
        "lexical.invalid-alphabet": lambda: F.concat(F.substring(value, F.lit(1), n - 1), F.lit("!")),
        "lexical.prefix-change": prefix,
        "boundary.remove-delimiter": delimiter,
        "structural.remove-segment": segment,
    }[name]()
