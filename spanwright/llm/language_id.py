"""Language identification of whole texts, with labelled spans of mixed-language text.

Script ranges narrow the candidate languages of each word, hashed letter
trigrams give per-word log-likelihoods, and a Viterbi pass with a switching
penalty labels runs of words. Long texts are cut into chunks of CHUNK words
whose transfer matrices are combined, so the number of sequential steps does not
follow the length of the longest text.

A letter is a code point of category L; a word is a letter and the letters and
marks that follow it.

Defined cases: a null or empty text or one without letters is ``und`` with score 0
and no spans; without labelled rows every text is ``und``; words of a script that
no language was seen in are neutral. Ties go to the language first by code point.
Very long texts are a slice of their own; rows that repeat or have a null id are
each predicted; extra columns are kept by ``identify``; an empty table gives no
rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Labelled documents of each language that a model is fitted on (expected number; all if fewer).
SAMPLE_PER_LANG = 1500
#: Cost, in nats, of a change of language between two words.
SWITCH_PENALTY = 12.0
BUCKETS = 1 << 16
CHUNK = 128
#: Share of a language's letters from which a script counts as its own.
SCRIPT_SHARE = 0.01

# First code points of Unicode script ranges, and the script that starts there.
SCRIPT_RANGES = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"),
    (0x0B80, "tamil"), (0x0C00, "other"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"),
    (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x323B0, "other"),
]
SCRIPTS = sorted({name for _, name in SCRIPT_RANGES})
_STARTS = np.array([x for x, _ in SCRIPT_RANGES])
_IDS = np.array([SCRIPTS.index(name) for _, name in SCRIPT_RANGES], np.int8)
_TABLES: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """Of each code point: 1 for a letter, 2 for a mark, else 0."""
    if "letters" not in _TABLES:
        _TABLES["letters"] = np.array([" LM".find(unicodedata.category(chr(i))[0]) for i in range(0x110000)], np.int8).clip(0)
    return _TABLES["letters"]


@dataclass
class Model:
    """langs: labels in order; weights: log-likelihood by bucket and language; scripts: by script and language."""

    langs: list[str]
    weights: np.ndarray
    scripts: np.ndarray


class Letters:
    """Trigram buckets and words of some texts; a word is a letter and the letters and marks that follow it."""

    def __init__(self, texts: list[str]):
        low = [x.lower() for x in texts]
        points = np.frombuffer("\n".join(low).encode("utf-32-le", "replace"), np.uint32)
        lens = np.fromiter(map(len, low), np.int64, len(low))
        begins = np.cumsum(lens + 1) - lens - 1
        kind = _letters()[points]
        place = np.arange(len(points))
        either = kind > 0
        opens = np.maximum.accumulate(np.where(either & ~np.append(False, either[:-1])[: len(either)], place, 0))
        is_letter = either & (np.maximum.accumulate(np.where(kind == 1, place, -1)) >= opens)  # marks before the first letter are left out
        edge = np.zeros(len(points) + 2, np.uint32)
        edge[1:-1] = np.where(is_letter, points, 1)
        at = np.flatnonzero(is_letter)
        mixed = edge[at] * np.uint32(0x9E3779B1) ^ (edge[at + 1] * np.uint32(0x85EBCA77) + np.uint32(0x165667B1)) ^ edge[at + 2] * np.uint32(0xC2B2AE3D)
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x2C1B3C6D)
        self.bucket = (mixed >> np.uint32(16)).astype(np.int32) % BUCKETS
        self.first = np.flatnonzero(np.diff(at, prepend=-2) > 1)  # of each word, among the letters
        self.count = np.diff(np.append(self.first, len(at)))
        opening = at[self.first]
        self.script = _IDS[np.searchsorted(_STARTS, points[opening], "right") - 1]
        self.bounds = np.searchsorted(opening, np.append(begins, len(points) + 1))  # words of each text
        self.at, self.begins = at, begins


def _batches(it: Iterator[pa.RecordBatch], limit: int = 1 << 19) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    from .kernel import slices

    for batch in it:
        for i, j in slices(batch.column("text"), limit):
            part = batch.slice(i, j - i)
            yield part, [x or "" for x in part.column("text").to_pylist()]


def fit(labelled: DataFrame, per_lang: int = SAMPLE_PER_LANG, key: str = "doc_id") -> Model:
    """Learns from ``text`` and non-null ``lang``; ``key`` only draws the bounded sample."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(SCRIPTS), 0), bool))
    parts = 1_000_000
    keep = F.lit(parts)
    for lang, n in sizes.items():
        if n > per_lang:
            keep = F.when(F.col("lang") == lang, max(1, round(parts * per_lang / n))).otherwise(keep)
    sample = rows.where(F.pmod(F.xxhash64(F.coalesce(F.col(key), F.lit(0))), F.lit(parts)) < keep).select("lang", "text")

    def counts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for part, texts in _batches(it):
            x = Letters(texts)
            ids = np.repeat(np.repeat(np.arange(len(texts)), np.diff(x.bounds)), x.count)
            script = np.repeat(x.script, x.count)
            langs = np.array(part.column("lang").to_pylist(), object)
            for lang in set(langs):
                own = (langs == lang)[ids]
                got = np.concatenate([np.bincount(x.bucket[own], minlength=BUCKETS), np.bincount(script[own], minlength=len(SCRIPTS))])
                total[lang] = total.get(lang, 0) + got
        for lang, got in total.items():
            at = np.flatnonzero(got)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(at), "slot": at, "n": got[at]})

    found = sample.mapInArrow(counts, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(sizes)
    table = np.zeros((BUCKETS + len(SCRIPTS), len(langs)))
    table[found["slot"].to_numpy(np.int64), [langs.index(x) for x in found["lang"]]] = found["n"]
    grams, scripts = table[:BUCKETS], table[BUCKETS:]
    weights = np.log((grams + 0.2) / (grams.sum(0) + 0.2 * BUCKETS))
    return Model(langs, weights.astype(np.float32), scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(0), 1))


def viterbi(scores: np.ndarray, bounds: np.ndarray, penalty: float = SWITCH_PENALTY, chunk: int = CHUNK) -> np.ndarray:
    """Best label of each word. scores: by word and label; bounds: the words of each text."""
    n_words, n = scores.shape
    out = np.zeros(n_words, np.int16)
    lens = np.diff(bounds)
    pieces = -(-lens // chunk)
    if not pieces.sum():
        return out
    doc = np.repeat(np.arange(len(lens)), pieces)
    first = np.cumsum(pieces) - pieces
    nth = np.arange(len(doc)) - first[doc]
    start = bounds[doc] + nth * chunk
    size = np.minimum(lens[doc] - nth * chunk, chunk)
    order = np.argsort(-size, kind="stable")  # so that those still running are a prefix
    running = [int(np.searchsorted(-size[order], -t, "left")) for t in range(chunk)]

    def steps(value: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        back = []
        for t in range(int(size.max())):
            k = running[t]
            own = value[order[:k]]
            top = own.max(-1, keepdims=True)
            stay = own >= top - penalty
            if keep:
                back.append((stay, own.argmax(-1)))
            now = np.maximum(own, top - penalty)
            word = scores[start[order[:k]] + t]
            value[order[:k]] = now + (word if now.ndim == 2 else word[:, None, :])
        return value, back

    ident = np.where(np.eye(n, dtype=bool), 0.0, -1e30)
    matrix, _ = steps(np.broadcast_to(ident, (len(doc), n, n)).copy(), False)
    enter = np.zeros((len(doc), n))  # best score before each chunk, by label
    by_len = np.argsort(-pieces, kind="stable")
    for k in range(1, int(pieces.max())):
        now = first[by_len[: np.searchsorted(-pieces[by_len], -k, "left")]] + k
        enter[now] = (enter[now - 1][:, :, None] + matrix[now - 1]).max(1)
    leave = np.zeros(len(doc), np.int64)
    last = (first + pieces - 1)[pieces > 0]
    leave[last] = (enter[last][:, :, None] + matrix[last]).max(1).argmax(1)
    for k in range(1, int(pieces.max())):
        own = by_len[: np.searchsorted(-pieces[by_len], -k, "left")]
        now = first[own] + pieces[own] - k  # the k-th chunk from the end
        leave[now - 1] = (enter[now] + matrix[now, :, leave[now]]).argmax(1)
    _, back = steps(enter.copy(), True)
    label = leave
    for t in reversed(range(int(size.max()))):
        k = running[t]
        at = order[:k]
        out[start[at] + t] = label[at]
        stay, top = back[t]
        label[at] = np.where(stay[np.arange(k), label[at]], label[at], top)
    return out


def word_scores(model: Model, x: Letters) -> np.ndarray:
    out = np.zeros((len(x.first), len(model.langs)))
    ends = x.first + x.count
    for k in range(len(model.langs)):
        sums = np.zeros(len(x.bucket) + 1)
        np.cumsum(model.weights[x.bucket, k], out=sums[1:])
        out[:, k] = sums[ends] - sums[x.first]
    allowed = model.scripts[x.script]
    known = allowed.any(1)
    out[known[:, None] & ~allowed] -= 50.0
    out[~known] = 0.0
    return out


def _origin(text: str, at: int, known: dict[int, np.ndarray], row: int) -> int:
    """The character of text from which the one at this place of its lower-cased form comes (a few characters become two)."""
    if row not in known:
        known[row] = np.repeat(np.arange(len(text)), [len(c.lower()) for c in text]) if len(text.lower()) != len(text) else np.zeros(0, np.int64)
    return int(known[row][at]) if len(known[row]) else at


def label_texts(model: Model, texts: list[str], spans: bool) -> pd.DataFrame:
    n = len(model.langs)
    pred, score, listed = np.full(len(texts), "und", object), np.zeros(len(texts)), [[] for _ in texts]
    if n and texts:
        x = Letters(texts)
        labels = viterbi(word_scores(model, x), x.bounds)
        words = np.diff(x.bounds)
        doc = np.repeat(np.arange(len(texts)), words)
        letters = np.bincount(doc * n + labels, weights=x.count, minlength=len(texts) * n).reshape(-1, n)
        has = letters.sum(1) > 0
        best = letters.argmax(1)
        pred[has] = np.array(model.langs, object)[best[has]]
        score[has] = letters.max(1)[has] / letters.sum(1)[has]
        if spans:
            origins: dict[int, np.ndarray] = {}
            edge = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(labels, prepend=-1) != 0))
            for i, j in zip(edge, np.append(edge[1:], len(doc)), strict=False):
                d = doc[i]
                begin = _origin(texts[d], int(x.at[x.first[i]] - x.begins[d]), origins, d)
                end = _origin(texts[d], int(x.at[x.first[j - 1] + x.count[j - 1] - 1] - x.begins[d]), origins, d) + 1
                listed[d].append({"start": begin, "end": end, "lang": model.langs[labels[i]]})
    return pd.DataFrame({"lang_pred": pred, "score": score, "spans": listed})


def identify(docs: DataFrame, model: Model, spans: bool = False, prefix: str = "") -> DataFrame:
    """docs with lang_pred, score (share of the letters in that language) and, if asked for, ``lang_spans``.

    Spans are character ranges of the text. The new names may be given a prefix;
    columns of docs with those names are replaced.
    """
    new = [prefix + n for n in ("lang_pred", "score", *["lang_spans"] * spans)]
    docs = docs.drop(*new)
    types = f"`{prefix}lang_pred` string, `{prefix}score` double" + f", `{prefix}lang_spans` array<struct<start: long, end: long, lang: string>>" * spans
    full = StructType([*docs.schema.fields, *StructType.fromDDL(types).fields])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _batches(it):
            got = label_texts(model, texts, spans)
            cols = [pa.array(got["lang_pred"], pa.string()), pa.array(got["score"], pa.float64())]
            if spans:
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
                cols.append(pa.array(got["spans"].tolist(), kind))
            yield pa.RecordBatch.from_arrays([*part.columns, *cols], names=full.names)

    return docs.mapInArrow(run, full)


def held_out(key: str = "doc_id"):
    """Whether a document belongs to the fold that nothing is learned from (also if its id is null)."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(True))
