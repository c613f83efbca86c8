"""SentencePiece encoding and decoding, with a max-plus scan over chunks of giant documents.

The model is a merge-trained (BPE) one, so its ids are not those of highest
score: a sequence of pieces is the encoding if and only if each piece encodes to
itself and each two neighbours are the encoding of their concatenation. That
makes encoding a path problem: a state at a text position is the piece that ends
there, a step to a next piece has weight 0 if the two are compatible and minus
infinity if not, and exactly one path is finite.

Texts up to GIANT characters are encoded whole by the library. Longer ones are
cut into chunks of CHUNK characters. A boundary's states are the pieces that may
cover it. Each chunk yields a matrix of path weights from the states at its left
boundary to those at its right; matrices of a text are combined associatively
(max-plus), which fixes the state at each boundary; then every chunk is traced
back on its own. No piece goes on from a character that is not a space into a
space, so all paths meet at the first such place of a chunk: only text before
the first and after the last of them is searched by state, the middle is the
library's.

Defined cases: a null or empty text has no ids and decodes to the empty text;
repeated rows and ids are kept apart by row; runs without any space take more
time (every state is searched through the chunk), not other results.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import slices
from .storage import written

GIANT, CHUNK = 65_536, 16_384
SPACE = "▁"
_STATE: dict = {}


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """The model's vocabulary with its merge order, and the compatibility of pieces."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        sp = self.sp
        self.bytes = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if sp.is_byte(i)}
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.id = {sp.id_to_piece(i): i for i in plain}
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
        self.longest = max(map(len, self.id), default=1)
        self._merged: dict[str, tuple] = {}
        self._pair: dict[tuple, bool] = {}

    @classmethod
    def of(cls, path: str) -> Pieces:
        if path not in _STATE:
            _STATE[path] = cls(path)
        return _STATE[path]

    def merged(self, text: str) -> tuple:
        """Pieces of a short text by merging, best score first and leftmost on ties."""
        if text not in self._merged:
            parts = list(text)
            while True:
                best = max(((self.score.get(a + b), -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.score), default=None)
                if best is None:
                    break
                i = -best[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            if len(self._merged) > 100_000:
                self._merged.clear()
            self._merged[text] = tuple(parts)
        return self._merged[text]

    def may_follow(self, a: str, b: str) -> bool:
        if (a, b) not in self._pair:
            if len(self._pair) > 200_000:
                self._pair.clear()
            self._pair[a, b] = self.merged(a + b) == (a, b)
        return self._pair[a, b]

    def starting(self, text: str, at: int) -> list[str]:
        """Pieces that may stand at a place: single characters and pieces that encode to themselves."""
        out = [text[at]]
        for n in range(2, min(self.longest, len(text) - at) + 1):
            piece = text[at : at + n]
            if piece in self.id and self.merged(piece) == (piece,):
                out.append(piece)
        return out

    def ids(self, piece: str) -> list[int]:
        """Of a piece; a character outside the vocabulary falls back to its bytes."""
        if piece in self.id:
            return [self.id[piece]]
        got = [self.bytes.get(f"<0x{b:02X}>") for b in piece.encode()]
        return [self.sp.unk_id()] if None in got else got

    def encode_words(self, text: str) -> list[int]:
        """Ids of text that begins with one space mark before another character."""
        return self.sp.encode(text[1:].replace(SPACE, " "))


def covering(pieces: Pieces, text: str, at: int) -> list[tuple[int, str]]:
    """(start, piece) of the pieces that may cover position ``at`` (start < at <= end)."""
    out = []
    for s in range(max(0, at - pieces.longest), at):
        out += [(s, p) for p in pieces.starting(text, s) if s + len(p) >= at]
    return out


def hard(text: str, at: int) -> bool:
    """Whether a piece always begins at ``at``: a lone space mark between other characters."""
    return 0 < at < len(text) - 1 and text[at] == SPACE and text[at - 1] != SPACE and text[at + 1] != SPACE


def reach(pieces: Pieces, text: str, state: tuple[int, str] | None, upto: int, goal) -> dict:
    """Paths from a state (None: nothing before position 0) to states that end at or after ``upto``.

    Returns state -> list of pieces after the first state, only for states that goal accepts.
    """
    first = (0, "") if state is None else state
    open_ = {first[0] + len(first[1]): {first: None}}
    seen: dict = {first: None}
    done: dict = {}
    for at in range(min(open_), upto):
        for prev in open_.pop(at, {}):
            for piece in pieces.starting(text, at):
                new = (at, piece)
                if new not in seen and (prev[1] == "" or pieces.may_follow(prev[1], piece)):
                    seen[new] = prev
                    open_.setdefault(at + len(piece), {})[new] = None
    for states in open_.values():
        for s in states:
            if goal(s):
                path, x = [], s
                while x != first:
                    path.append(x[1])
                    x = seen[x]
                done[s] = path[::-1]
    return done


class Chunk:
    """Characters a..b of a marked text, in a window of it that holds ``longest`` more on both sides."""

    def __init__(self, pieces: Pieces, text: str, a: int, b: int, first: bool, last: bool):
        self.p, self.text, self.a, self.b, self.first, self.last = pieces, text, a, b, first, last
        self.left = [None] if first else covering(pieces, text, a)
        self.right = [None] if last else covering(pieces, text, b)
        inside = [i for i in range(a + (1 if first else pieces.longest), b - (0 if last else pieces.longest)) if hard(text, i)]
        self.cut = (inside[0], inside[-1]) if inside else None

    def _paths(self, lefts: list, rights: list) -> dict:
        """(left state, right state) -> pieces or ids between them, for connected states."""
        text, p = self.text, self.p
        end = len(text) if self.last else self.b
        ends = (lambda s: s[0] + len(s[1]) == len(text)) if self.last else (lambda s: s in set(rights))
        out = {}
        if self.cut is None:
            for left in lefts:
                for s, path in reach(p, text, left, end, ends).items():
                    out[left, None if self.last else s] = [i for x in path for i in p.ids(x)]
            return out
        i, j = self.cut
        head = {x: path for x in lefts for path in reach(p, text, x, i, lambda s: s[0] + len(s[1]) == i).values()}
        tail = {(None if self.last else s): path for s, path in reach(p, text, (j, ""), end, ends).items()}
        middle = p.encode_words(text[i:j]) if j > i else []
        for left, before in head.items():
            for right, after in tail.items():
                out[left, right] = [k for x in before for k in p.ids(x)] + middle + [k for x in after for k in p.ids(x)]
        return out

    def matrix(self) -> np.ndarray:
        found = self._paths(self.left, self.right)
        return np.array([[0.0 if (x, y) in found else -np.inf for y in self.right] for x in self.left])

    def trace(self, left: int, right: int) -> list[int]:
        """Ids that begin in this chunk's own path: after the left state up to and with the right state."""
        x, y = self.left[left], self.right[right]
        return self._paths([x], [y])[x, y]


def combine(matrices: list[np.ndarray]) -> list[int]:
    """The state at each boundary, from a pairwise (associative) max-plus product of the chunks' matrices."""

    def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a[:, :, None] + b[None, :, :]).max(1)

    prefix, step = list(matrices), 1
    while step < len(prefix):
        prefix = [product(prefix[i - step], prefix[i]) if i >= step else prefix[i] for i in range(len(prefix))]
        step *= 2
    state = [0] * (len(matrices) + 1)
    for k in reversed(range(1, len(matrices))):
        state[k] = int((prefix[k - 1][0] + matrices[k][:, state[k + 1]]).argmax())
    return state


def marked(text: str) -> str:
    return SPACE + text.replace(" ", SPACE)


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))


def crc_join(first: int, second: int, length: int) -> int:
    """CRC-32 of two byte strings together, from theirs and the second's length."""
    row = [0xEDB88320] + [1 << i for i in range(31)]

    def times(m: list[int], v: int) -> int:
        out, i = 0, 0
        while v:
            if v & 1:
                out ^= m[i]
            v, i = v >> 1, i + 1
        return out

    square = lambda m: [times(m, x) for x in m]
    m, n = square(square(square(row))), length  # one zero byte
    while n:
        if n & 1:
            first = times(m, first)
        m, n = square(m), n >> 1
    return first ^ second


#: Characters of whole texts that are encoded at once; Python holds tens of bytes for each id of them.
AT_ONCE = 1 << 19
PARTS = "doc_id long, row long, nth int, ids array<int>, text string"
Batches = Iterator[pa.RecordBatch]


def _whole(path: str, batches: Batches) -> Batches:
    """Ids of whole texts (row and nth are 0)."""
    sp = Pieces.of(path).sp
    for batch in batches:
        for i, j in slices(batch.column("text"), AT_ONCE):
            part = batch.slice(i, j - i)
            ids = pa.array(sp.encode(part.column("text").to_pylist(), num_threads=1), pa.list_(pa.int32()))
            zero = np.zeros(len(part), np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(zero), pa.array(zero.astype(np.int32)), ids, part.column("text")], names=["doc_id", "row", "nth", "ids", "text"])


def _digest(path: str, batches: Batches) -> Batches:
    """Number and checksum of the ids of each part, and whether they decode to its text."""
    sp = Pieces.of(path).sp
    for batch in batches:
        bounds, flat = np.asarray(batch.column("ids").offsets), np.asarray(batch.column("ids").values)
        texts, rows, nth = batch.column("text").to_pylist(), batch.column("row").to_pylist(), batch.column("nth").to_pylist()
        ids = [flat[i:j].tolist() for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
        good = [sp.decode(x) == t if r == 0 else decode_pieces(sp, x, n == 0) == t.replace(SPACE, " ")[n == 0 :] for x, t, r, n in zip(ids, texts, rows, nth, strict=True)]
        crc = [_crc(flat[i:j]) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), batch.column("nth"), pa.array(np.diff(bounds).astype(np.int64)), pa.array(crc, pa.int64()), pa.array(good, pa.bool_())], names=["doc_id", "row", "nth", "n_tokens", "ids_crc32", "round_trip"])


def encode(docs: DataFrame, path: str, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """row, doc_id, nth, ids, text: the ids of each document, giant ones in parts, with the text they must decode to."""
    return _encoded(docs, path, giant, chunk, lambda parts: parts, PARTS)


def _encoded(docs: DataFrame, path: str, giant: int, chunk: int, then, kind: str) -> DataFrame:
    """``then`` of the parts of all documents, worked in the tasks that encode them."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    whole = docs.where(F.length("text") <= giant)
    short = whole.mapInArrow(lambda it: then(_whole(path, it)), kind)
    # Windows of the marked text of giant documents; row tells rows of one id apart.
    margin = 40
    text = F.concat(F.lit(SPACE), F.translate("text", " ", SPACE))
    big = docs.where(F.length("text") > giant).withColumn("row", F.xxhash64("text", F.monotonically_increasing_id())).withColumn("text", text).withColumn("n", F.ceil(F.length("text") / chunk).cast("int"))
    cut = big.withColumn("nth", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("from", F.greatest(F.lit(0), F.col("nth") * chunk - margin))
    cut = cut.select("doc_id", "row", "nth", "n", "from", F.substring("text", F.col("from") + 1, F.lit(chunk + 2 * margin)).alias("text"))
    chunks = written(cut, "chunks")

    def chunk_of(pieces: Pieces, r: dict) -> Chunk:
        a = r["nth"] * chunk - r["from"]
        last = r["nth"] == r["n"] - 1
        return Chunk(pieces, r["text"], a, len(r["text"]) if last else a + chunk, r["nth"] == 0, last)

    def matrices(it: Batches) -> Batches:
        pieces = Pieces.of(path)
        for batch in it:
            for r in batch.to_pylist():
                m = chunk_of(pieces, r).matrix()
                yield pa.RecordBatch.from_pydict({"row": [r["row"]], "nth": [r["nth"]], "height": [m.shape[0]], "open": [np.isfinite(m).ravel().tolist()]})

    found = chunks.mapInArrow(matrices, "row long, nth long, height long, open array<boolean>")

    def states(group: pa.Table) -> pa.Table:
        group = group.sort_by("nth")
        m = [np.where(np.array(x, bool), 0.0, -np.inf).reshape(h, -1) for x, h in zip(group.column("open").to_pylist(), group.column("height").to_pylist(), strict=True)]
        s = combine(m)
        return pa.table({"row": group.column("row"), "nth": group.column("nth"), "left": pa.array(s[:-1], pa.int64()), "right": pa.array(s[1:], pa.int64())})

    chosen = found.groupBy("row").applyInArrow(states, "row long, nth long, left long, right long").withColumnsRenamed({"row": "r", "nth": "k"})

    def trace(it: Batches) -> Batches:
        pieces = Pieces.of(path)
        for batch in it:
            for r in batch.to_pylist():
                c = chunk_of(pieces, r)
                ids = c.trace(r["left"], r["right"])
                x, y = c.left[r["left"]], c.right[r["right"]]
                begin = 0 if x is None else x[0] + len(x[1])
                end = len(c.text) if y is None else y[0] + len(y[1])
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([r["doc_id"]], pa.int64()), "row": [r["row"]], "nth": pa.array([r["nth"]], pa.int32()), "ids": pa.array([ids], pa.list_(pa.int32())), "text": [c.text[begin:end]]})

    joined = chunks.join(chosen, (chunks["row"] == chosen["r"]) & (chunks["nth"] == chosen["k"])).drop("r", "k")
    return short.unionByName(joined.mapInArrow(lambda it: then(trace(it)), kind))


def decode_pieces(sp, ids: list[int], first: bool) -> str:
    """Text of a part's ids; the space mark that encoding puts first is dropped from the first part only."""
    raw = b"".join(bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).encode() for i in ids)
    text = raw.decode(errors="replace").replace(SPACE, " ")
    return text[1:] if first else text


def encode_digest(docs: DataFrame, path: str, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 and round_trip (whether decoding gives the text back) of each row of docs."""
    kind = "doc_id long, row long, nth int, n_tokens long, ids_crc32 long, round_trip boolean"
    parts = _encoded(docs, path, giant, chunk, lambda it: _digest(path, it), kind)

    def joined(group: pa.Table) -> pa.Table:
        group = group.sort_by("nth")
        crc = 0
        for n, c in zip(group.column("n_tokens").to_pylist(), group.column("ids_crc32").to_pylist(), strict=True):
            crc = crc_join(crc, c, 4 * n)
        return pa.table({"doc_id": group.column("doc_id").slice(0, 1), "n_tokens": pa.array([sum(group.column("n_tokens").to_pylist())], pa.int64()), "ids_crc32": pa.array([crc], pa.int64()), "round_trip": pa.array([all(group.column("round_trip").to_pylist())])})

    kept = written(parts, "encoded")
    out = "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean"
    long_ = kept.where("row <> 0").groupBy("row").applyInArrow(joined, out)
    return kept.where("row = 0").select("doc_id", "n_tokens", "ids_crc32", "round_trip").unionByName(long_)
