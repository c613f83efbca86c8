"""Near-duplicate join on word n-grams: MinHash banding, then exact Jaccard.

Bands and rows are chosen for a target recall at the threshold. Documents with
equal n-gram sets are one class; classes that share a band hash are candidates.
Candidates are linked to the smallest class of their band hash (a star, not all
pairs), and the full n-gram sets of each connected set of candidates are
compared in blocks: every pair of classes is verified once, and only counts and
a spanning set of links leave a block. So no link between classes in one
candidate set is lost, and output is linear in the documents.

Defined cases: n-grams are over words as they stand; a text of fewer than
NGRAM words (but at least one) is one n-gram of all its words; a null or empty
text has no n-grams, no links and is its own class; a very long text is a slice
of its own. Rows that repeat an id give a row each and link to each other like
copies. A row with a null id gives a row without class and links, and takes no
part. Columns other than doc_id and text play no part; an empty table gives no
rows. n_links counts the other rows of similarity THRESHOLD or more, copies
included.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .kernel import Words, mix, slices, text_buffer, window_hashes
from .storage import written

NGRAM, THRESHOLD, RECALL, MAX_HASHES = 5, 0.8, 0.9995, 128
BLOCK, BLOCK_BYTES = 192, 8 << 20
#: Bytes of text that are hashed at once.
AT_ONCE = 1 << 20
#: Columns of the incidence matrix that are multiplied at once.
COLUMNS = 4096


def choose_bands(threshold: float, recall: float, max_hashes: int) -> tuple[int, int]:
    """(bands, rows): the most rows a band for which max_hashes still give the recall at the threshold."""
    for rows in range(max_hashes, 0, -1):
        hit = threshold**rows
        bands = math.ceil(math.log(1 - recall) / math.log(1 - hit)) if hit < 1 else 1
        if bands * rows <= max_hashes:
            return bands, rows
    raise ValueError("no banding of so few hashes reaches this recall")


def gram_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text, sorted, with the n + 1 bounds."""
    words = Words(column)
    hashed = words.hashes()
    h = window_hashes(hashed, NGRAM)
    at = np.arange(len(h))
    at = at[words.doc[at] == words.doc[at + NGRAM - 1]]
    doc, key = words.doc[at], h[at]
    for i in np.flatnonzero((words.count > 0) & (words.count < NGRAM)):
        own = hashed[words.first[i] : words.first[i + 1]]
        doc, key = np.append(doc, i), np.append(key, window_hashes(own, len(own)) ^ np.uint64(len(own)))
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]))[: len(doc)]
    doc, key = doc[new], key[new]
    return key, np.searchsorted(doc, np.arange(len(words.count) + 1))


def _signatures(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    draw = np.random.default_rng(20240307)
    factor = draw.integers(0, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i, j in slices(batch.column("text"), AT_ONCE):
                part = batch.slice(i, j - i)
                key, bounds = gram_sets(part.column("text"))
                full = np.flatnonzero(np.diff(bounds))
                low = np.zeros((len(part), bands * rows), np.uint64)
                for k in range(bands * rows if len(full) else 0):
                    low[full, k] = np.minimum.reduceat((key * factor[k]) >> np.uint64(24), bounds[full])
                sign = np.zeros((len(part), bands), np.uint64)
                for b in range(bands):
                    for r in range(rows):
                        sign[:, b] = mix(sign[:, b] * np.uint64(31) + low[:, b * rows + r])
                total = np.append(np.uint64(0), np.cumsum(mix(key)))
                other = np.append(np.uint64(0), np.cumsum(mix(key ^ np.uint64(0xA5A5A5A5A5A5A5A5))))
                n = np.diff(bounds)
                empty = n == 0
                chars = np.diff(text_buffer(part.column("text"))[1])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * bands), pa.array(sign.view(np.int64).ravel()))
                ids = np.asarray(part.column("doc_id"))
                one = np.where(empty, ids.view(np.uint64), total[bounds[1:]] - total[bounds[:-1]])
                two = np.where(empty, np.uint64(0), other[bounds[1:]] - other[bounds[:-1]])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(chars.astype(np.int64)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), lists], names=["doc_id", "grams", "bytes", "h1", "h2", "bands"])

    return docs.mapInArrow(run, "doc_id long, grams long, bytes long, h1 long, h2 long, bands array<long>")


def _verify(group: pa.Table, threshold: float) -> pa.Table:
    """Links of the classes of a group: all if it is a block by itself, else those between its two sides, one of which may be empty."""
    rep, copies = np.asarray(group.column("rep")), np.asarray(group.column("copies"))
    side = np.asarray(group.column("side"))
    sets = group.column("grams").combine_chunks()
    bounds, flat = np.asarray(sets.offsets), np.asarray(sets.values)
    size = np.diff(bounds)
    owner = np.repeat(np.arange(len(rep)), size)
    order = np.argsort(flat, kind="stable")
    key, owner = flat[order], owner[order]
    first = np.append(True, key[1:] != key[:-1])
    column = np.cumsum(first) - 1
    often = np.bincount(column)[column] > 1  # n-grams of one class are in no intersection
    _, column = np.unique(column[often], return_inverse=True)
    owner = owner[often]
    both = np.zeros((len(rep), len(rep)), np.float32)
    cuts = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + COLUMNS, COLUMNS))
    for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if b > a:
            own, back = np.unique(owner[a:b], return_inverse=True)
            part = np.zeros((len(own), COLUMNS), np.float32)
            part[back, column[a:b] - i * COLUMNS] = 1
            both[np.ix_(own, own)] += part @ part.T
    union = size[:, None] + size[None, :] - both
    linked = both >= threshold * union * (1 - 1e-12)
    np.fill_diagonal(linked, False)
    if not group.column("alone")[0].as_py():
        linked &= side[:, None] != side[None, :]
    links = linked @ copies.astype(np.float64)
    root = np.arange(len(rep))  # of each class, the smallest class that it reaches in this group
    while True:
        low = np.minimum(root, np.where(linked, root[None, :], len(rep)).min(1, initial=len(rep)))
        low = low[low]
        if (low == root).all():
            break
        root = low
    return pa.table({"rep": rep, "near": rep[root], "links": links.astype(np.int64)})


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id (smallest id of the linked set), n_links of each row of docs (doc_id, text)."""
    bands, rows = choose_bands(threshold, recall, MAX_HASHES)
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs = every.where(F.col("doc_id").isNotNull())
    signed = written(_signatures(docs, bands, rows), "signatures")
    found = signed.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.max("grams").alias("grams"), F.max("bytes").alias("bytes"), F.min("bands").alias("bands"))
    classes = written(found, "classes")
    keyed = classes.where("grams > 0").select("rep", F.posexplode("bands").alias("band", "hash"))
    least = written(keyed.groupBy("band", "hash").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least < most").drop("most"), "bands")
    stars = keyed.join(least, ["band", "hash"]).where("rep > least").select(F.col("rep").alias("a"), F.col("least").alias("b")).distinct()
    sets = components(stars)
    sizes = sets.join(classes.select(F.col("rep").alias("node"), "bytes"), "node").groupBy("comp").agg(F.count("*").alias("n"), F.sum("bytes").alias("total"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("total") / BLOCK_BYTES)).cast("int")
    members = sets.join(sizes.select("comp", blocks.alias("blocks")), "comp").join(classes.select(F.col("rep").alias("node"), "copies"), "node")
    members = written(members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "members")
    texts = docs.join(members, docs["doc_id"] == members["node"]).select(F.col("node").alias("rep"), "text", "comp", "copies", "blocks", "block")

    def explode_sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i, j in slices(batch.column("text"), AT_ONCE):
                part = batch.slice(i, j - i)
                key, bounds = gram_sets(part.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(key.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in ("rep", "comp", "copies", "blocks", "block")] + [lists], names=["rep", "comp", "copies", "blocks", "block", "grams"])

    full = texts.mapInArrow(explode_sets, "rep long, comp long, copies long, blocks int, block int, grams array<long>")
    pairs = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).withColumn("side", (F.col("block") == F.col("hi")).cast("int")).withColumn("alone", F.col("lo") == F.col("hi"))
    checked = written(pairs.select("comp", "lo", "hi", "rep", "copies", "side", "alone", "grams").groupBy("comp", "lo", "hi").applyInArrow(lambda g: _verify(_once(g), threshold), "rep long, near long, links long"), "links")
    links = checked.groupBy("rep").agg(F.sum("links").alias("links"))
    linked = components(checked.where("rep <> near").select(F.col("rep").alias("a"), F.col("near").alias("b")))
    result = classes.select("rep", "h1", "h2", "copies").join(links, "rep", "left").join(linked.withColumnRenamed("node", "rep"), "rep", "left")
    result = written(result.select("h1", "h2", F.coalesce("comp", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "result")
    unnamed = every.where(F.col("doc_id").isNull()).select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return signed.select("doc_id", "h1", "h2").join(result, ["h1", "h2"]).select("doc_id", "class_id", "n_links").unionByName(unnamed)


def _once(group: pa.Table) -> pa.Table:
    """A class whose id stands in several rows of the input counts once."""
    _, first = np.unique(np.asarray(group.column("rep")), return_index=True)
    return group.take(pa.array(first)) if len(first) < len(group) else group.take(pa.array(np.sort(first)))
