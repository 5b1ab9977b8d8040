"""SentencePiece encoding and decoding, giant documents by a max-plus scan over their chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factmill.llm.common import by_bytes, materialize, small_batches

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Characters of a chunk; longer documents have several.
CHUNK = 32_768
#: Characters of context on both sides of a chunk: no piece is longer.
REACH = 16
#: Chunks whose matrices are combined by one task; a document's blocks of so many chunks are combined by another.
BLOCK = 64
#: Chunks of one Arrow batch that the cutting task hands on.
ROWS = 64
#: Bytes of text that a task encodes at a time, bytes of remembered words, length of a remembered word, and
#: remembered pairs of pieces. What a task holds is bounded by these, whatever the texts are.
RUN_BYTES, HELD_BYTES, WORD, PAIRS = 1 << 20, 16 << 20, 64, 50_000
NONE = -np.inf


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


@lru_cache(maxsize=2)
def processor(proto: bytes) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_proto=proto)


@lru_cache(maxsize=2)
class Pieces:
    """The vocabulary of a byte-pair model. Its encoding is the one sequence of pieces in which each two neighbours
    encode to themselves, so a path of pieces is scored 0 where all neighbours do and minus infinity elsewhere."""

    def __init__(self, proto: bytes) -> None:
        self.sp = processor(proto)
        n = self.sp.get_piece_size()
        special = [self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i) or self.sp.is_unused(i) for i in range(n)]
        self.rank = {self.sp.id_to_piece(i): i for i in range(n) if not special[i]}
        self.score = {p: self.sp.get_score(i) for p, i in self.rank.items()}
        self.bytes = [self.sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if max(map(len, self.rank)) > REACH or any(SPACE in p.lstrip(SPACE) for p in self.rank):
            raise ValueError("pieces are too long, or hold a space after other characters")
        self.pairs: dict[tuple[str, str], bool] = {}
        self.words = Words(proto)

    def merged(self, text: str) -> list[str]:
        """Pairs merged best first, the leftmost of equals, as the model defines."""
        parts = list(text)
        while True:
            found = [(-self.score[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.rank]
            if not found:
                return parts
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def fits(self, a: str, b: str) -> bool:
        if (known := self.pairs.get((a, b))) is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merged(a + b) == [a, b]
        return known

    def stands(self, piece: str) -> bool:
        """Whether a piece encodes to itself."""
        if (known := self.pairs.get((piece, ""))) is None:
            known = self.pairs[piece, ""] = self.merged(piece) == [piece]
        return known

    def matches(self, text: str, start: int) -> list[str]:
        """Pieces that begin at a place: single characters always, longer ones from the vocabulary."""
        found = [text[start : start + n] for n in range(1, min(REACH, len(text) - start) + 1)]
        return [p for p in found if len(p) == 1 or (p in self.rank and self.stands(p))]

    def ids(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            i = self.rank.get(p)
            out.extend([i] if i is not None else [self.bytes[b] for b in p.encode("utf-8")])
        return out


class Words:
    """Encodes texts word by word, as no piece crosses from a character to a space: each distinct word, with the
    spaces before it, goes through the library once as long as it is remembered. Words longer than WORD are not."""

    def __init__(self, proto: bytes) -> None:
        self.sp = processor(proto)
        self.one = self.sp.piece_to_id(SPACE)
        self.clear()

    def clear(self) -> None:
        self.codes: dict[str, int] = {}
        self.values, self.sizes, self.held = np.zeros(0, np.int32), np.zeros(0, np.int64), 0

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has."""
        found = self.sp.encode([w[1:] for w in words], num_threads=1)
        found = [[self.one] if w == " " else ids for w, ids in zip(words, found, strict=True)]
        return np.array([i for x in found for i in x], np.int32), np.array([len(x) for x in found], np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin and end."""
        if self.held > HELD_BYTES:
            self.clear()
        known, codes, ends, new, long = self.codes, [], [], [], []
        for text in texts:
            if text:
                for w in re.findall(" +[^ ]*", " " + text.replace(SPACE, " ")):
                    code = known.get(w)
                    if code is None:
                        if len(w) > WORD:
                            long.append(w)
                            code = -len(long)
                        else:
                            code = known[w] = len(known)
                            new.append(w)
                    codes.append(code)
            ends.append(len(codes))
        if new:
            values, sizes = self._ids(new)
            self.values, self.sizes = np.concatenate([self.values, values]), np.concatenate([self.sizes, sizes])
            # A word in a dictionary takes some 150 bytes beside its characters.
            self.held += sum(map(len, new)) + 150 * len(new) + values.nbytes
        values, sizes = self.values, self.sizes
        if long:
            more = self._ids(long)
            values, sizes = np.concatenate([values, more[0]]), np.concatenate([sizes, more[1]])
        at = np.array(codes, np.int64)
        at = np.where(at < 0, len(known) - 1 - at, at)
        size, starts = sizes[at], np.cumsum(sizes) - sizes
        upto = np.concatenate(([0], np.cumsum(size)))
        out = values[np.repeat(starts[at] - upto[:-1], size) + np.arange(upto[-1])] if len(at) else np.zeros(0, np.int32)
        return out, upto[np.array([0, *ends])]


def spaced(text: str) -> str:
    """The text as the model reads it: a space in front, spaces as SPACE."""
    return SPACE + text.replace(" ", SPACE)


def is_edge(text: str, at: int) -> bool:
    """Whether no piece can cover both sides of a place: a space after another character."""
    return text[at] == SPACE and text[at - 1] != SPACE


State = tuple[int, str]  # where a piece begins, counted from the cut, and the piece; it ends at the cut or behind it
START: State = (0, "")


def states_at(vocabulary: Pieces, text: str, cut: int) -> list[State]:
    """The pieces that end at a cut or cover it. The text reaches REACH to both sides, or ends."""
    found = [(s, p) for s in range(max(0, cut - REACH), cut) for p in vocabulary.matches(text, s) if s + len(p) >= cut]
    return [(s - cut, p) for s, p in found]


def paths(vocabulary: Pieces, text: str, entries: list[tuple[int, str, np.ndarray]], stop: int) -> list[tuple[int, str, np.ndarray, int]]:
    """Nodes (begin, piece, scores for each entry, best predecessor of the first entry) of all pieces that begin
    before ``stop`` and follow from the entries (end, piece, scores); an empty piece fits anything. Entries are the
    first nodes, their begin is where they end."""
    nodes: list[tuple[int, str, np.ndarray, int]] = [(end, p, scores, -1) for end, p, scores in entries]
    ending: dict[int, list[int]] = {}
    for i, (end, _, _) in enumerate(entries):
        ending.setdefault(end, []).append(i)
    for at in range(min(ending, default=stop), stop):
        before = ending.get(at)
        if not before:
            continue
        for piece in vocabulary.matches(text, at):
            fits = [i for i in before if not nodes[i][1] or vocabulary.fits(nodes[i][1], piece)]
            if fits:
                scores = np.max([nodes[i][2] for i in fits], axis=0)
                best = max(fits, key=lambda i: nodes[i][2][0])
                ending.setdefault(at + len(piece), []).append(len(nodes))
                nodes.append((at, piece, scores, best))
    return nodes


def trace(nodes: list[tuple[int, str, np.ndarray, int]], last: int) -> list[str]:
    out = []
    while last >= 0 and nodes[last][3] >= 0:
        out.append(nodes[last][1])
        last = nodes[last][3]
    return out[::-1]


class Chunk:
    """One chunk of a document: its text with REACH of context, where it begins and ends in that text, and the states
    at both cuts. Between its first and its last edge nothing depends on the states."""

    def __init__(self, vocabulary: Pieces, text: str, begin: int, end: int, first: bool, last: bool) -> None:
        self.v, self.text, self.begin, self.end = vocabulary, text, begin, end
        self.first, self.last, self.words = first, last, vocabulary.words
        self.before = [START] if first else states_at(vocabulary, text, begin)
        self.after = [(0, "")] if last else states_at(vocabulary, text, end)
        # An edge that every piece from before the cut has ended at.
        edges = [at for at in range(begin + (REACH if not first else 1), end) if is_edge(text, at)]
        self.inner = (edges[0], edges[-1]) if edges else None

    def _entries(self) -> list[tuple[int, str, np.ndarray]]:
        n = len(self.before)
        return [(self.begin + s + len(p), p, np.where(np.arange(n) == i, 0.0, NONE)) for i, (s, p) in enumerate(self.before)]

    def _leaving(self, nodes: list, size: int) -> np.ndarray:
        """Scores of the states behind: rows for entries."""
        at = {(b - self.end, p): scores for b, p, scores, _ in nodes}
        if self.last:
            done = [scores for b, p, scores, _ in nodes if b + (len(p) if _ >= 0 else 0) == self.end]
            return np.max(done, axis=0)[:, None] if done else np.full((size, 1), NONE)
        return np.stack([at.get(s, np.full(size, NONE)) for s in self.after], axis=1)

    def transfer(self) -> np.ndarray:
        """Best score from each state before to each state behind."""
        n = len(self.before)
        if self.inner is None:
            return self._leaving(paths(self.v, self.text, self._entries(), self.end), n)
        into = paths(self.v, self.text, self._entries(), self.inner[0])
        reached = [scores for b, p, scores, back in into if b + (len(p) if back >= 0 else 0) == self.inner[0]]
        arrive = np.max(reached, axis=0) if reached else np.full(n, NONE)
        out = self._leaving(paths(self.v, self.text, [(self.inner[1], "", np.zeros(1))], self.end), 1)
        return arrive[:, None] + out

    def _last_node(self, nodes: list, target: State) -> int:
        if self.last:
            return max((i for i, (b, p, _, back) in enumerate(nodes) if b + (len(p) if back >= 0 else 0) == self.end and nodes[i][2][0] > NONE), default=-1)
        return next((i for i, (b, p, s, back) in enumerate(nodes) if back >= 0 and (b - self.end, p) == target and s[0] > NONE), -1)

    def shown(self, source: State, target: State) -> bytes:
        """The text behind the source state up to and with the target state."""
        end = self.end if self.last else self.end + target[0] + len(target[1])
        return self.text[self.begin + source[0] + len(source[1]) : end].replace(SPACE, " ").encode("utf-8", "surrogatepass")

    def pieces(self, source: State, target: State) -> list[int]:
        """Ids behind the source state up to and with the target state."""
        entry = [(self.begin + source[0] + len(source[1]), source[1], np.zeros(1))]
        if self.inner is None:
            nodes = paths(self.v, self.text, entry, self.end)
            return self.v.ids(trace(nodes, self._last_node(nodes, target)))
        a, b = self.inner
        into = paths(self.v, self.text, entry, a)
        at = next((i for i, (s, p, x, back) in enumerate(into) if s + (len(p) if back >= 0 else 0) == a and x[0] > NONE), -1)
        out = paths(self.v, self.text, [(b, "", np.zeros(1))], self.end)
        middle = self.words.encode([self.text[a + 1 : b].replace(SPACE, " ")])[0].tolist() if b > a else []
        return [*self.v.ids(trace(into, at)), *middle, *self.v.ids(trace(out, self._last_node(out, target)))]


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None, :, :]).max(1)


def prefix_products(mats: list[np.ndarray]) -> list[np.ndarray]:
    """All prefixes' products by a scan in pairs, as max-plus products are associative."""
    if len(mats) == 1:
        return mats
    pairs = [max_plus(a, b) for a, b in zip(mats[0::2], mats[1::2], strict=False)]
    upto = prefix_products(pairs)
    out = []
    for i, m in enumerate(mats):
        out.append(m if i == 0 else upto[i // 2] if i % 2 else max_plus(upto[i // 2 - 1], m))
    return out


def chosen_states(mats: list[np.ndarray]) -> list[int]:
    """The state at each cut on the best path, from the end backwards."""
    upto = prefix_products(mats)
    states = [int(upto[-1][0].argmax())]
    for k in range(len(mats) - 1, 0, -1):
        states.append(int((upto[k - 1][0] + mats[k][:, states[-1]]).argmax()))
    return [0, *states[::-1]]


PART = "rid long, doc_id long, n_chars long, marked boolean, k int, n int, text string, begin int, end int"
MOVES = "rid long, block int, k int, height int, matrix array<float>"


def _batch(rows: list[tuple], *fields: tuple[str, pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _cut(chunk: int):
    """Every long text into its chunks, each with REACH of context on both sides: one pass over the text."""
    fields = [(c.split()[0], {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}[c.split()[1]]) for c in PART.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                seen = spaced(row["text"])
                n = -(-len(seen) // chunk)
                for first in range(0, n, ROWS):
                    rows = []
                    for k in range(first, min(first + ROWS, n)):
                        start, stop = max(k * chunk - REACH, 0), min((k + 1) * chunk, len(seen))
                        rows.append((row["rid"], row["doc_id"], row["n_chars"], SPACE in row["text"], k, n, seen[start : stop + REACH], k * chunk - start, stop - start))
                    yield _batch(rows, *fields)

    return run


def _chunk_of(vocabulary: Pieces, r: dict) -> Chunk:
    return Chunk(vocabulary, r["text"], r["begin"], r["end"], r["k"] == 0, r["k"] == r["n"] - 1)


def _transfer(proto: bytes, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Pieces(proto)
        for batch in batches:
            for r in batch.select(["rid", "k", "n", "text", "begin", "end"]).to_pylist():
                m = _chunk_of(v, r).transfer()
                yield _batch([(r["rid"], r["k"] // block, r["k"], m.shape[0], m.ravel().tolist())], *MOVE_FIELDS)

    return run


MOVE_FIELDS = (("rid", pa.int64()), ("block", pa.int32()), ("k", pa.int32()), ("height", pa.int32()), ("matrix", pa.list_(pa.float32())))


def _matrices(group: pa.Table, order: str) -> tuple[list[int], list[np.ndarray]]:
    rows = sorted(group.select([order, "height", "matrix"]).to_pylist(), key=lambda r: r[order])
    return [r[order] for r in rows], [np.asarray(r["matrix"], float).reshape(r["height"], -1) for r in rows]


def _product(group: pa.Table) -> pa.Table:
    """One matrix for a block of chunks."""
    m = prefix_products(_matrices(group, "k")[1])[-1]
    row = (group["rid"][0].as_py(), group["block"][0].as_py(), m.shape[0], m.ravel().tolist())
    return pa.Table.from_batches([_batch([row], *(f for f in MOVE_FIELDS if f[0] != "k"))])


ENDS = "rid long, block int, a int, b int"


def _scan(group: pa.Table) -> pa.Table:
    """The states at both ends of each block of a document, on the best path."""
    blocks, mats = _matrices(group, "block")
    states = chosen_states(mats)
    rid = group["rid"][0].as_py()
    return pa.table({"rid": pa.array([rid] * len(blocks), pa.int64()), "block": pa.array(blocks, pa.int32()), "a": pa.array(states[:-1], pa.int32()), "b": pa.array(states[1:], pa.int32())})


def _inside(chunks: pa.Table, ends: pa.Table) -> pa.Table:
    """The states at both ends of each chunk of a block, between those of the block."""
    ks, mats = _matrices(chunks, "k")
    a, b = ends["a"][0].as_py(), ends["b"][0].as_py()
    states = [a, *chosen_states([mats[0][a : a + 1], *mats[1:-1], mats[-1][:, b : b + 1]] if len(mats) > 1 else [mats[0][a : a + 1, b : b + 1]])[1:-1], b]
    rid = chunks["rid"][0].as_py()
    return pa.table({"rid": pa.array([rid] * len(ks), pa.int64()), "k": pa.array(ks, pa.int32()), "a": pa.array(states[:-1], pa.int32()), "b": pa.array(states[1:], pa.int32())})


def _backtrace(proto: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, table = Pieces(proto), surfaces(proto)
        for batch in batches:
            for r in batch.to_pylist():
                c = _chunk_of(v, r)
                source, target = c.before[r["a"]], c.after[r["b"]]
                ids = c.pieces(source, target)
                same = b"".join(table[ids].tolist()) == c.shown(source, target) and not r["marked"]
                yield _batch([(r["rid"], r["k"], ids, same)], ("rid", pa.int64()), ("k", pa.int32()), ("ids", pa.list_(pa.int32())), ("same", pa.bool_()))

    return run


def _short(proto: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, table = Pieces(proto).words, surfaces(proto)
        for batch in batches:
            for some in by_bytes(batch, "text", RUN_BYTES):
                texts = some.column("text").to_pylist()
                values, ends = words.encode(texts)
                same = [b"".join(table[values[a:b]].tolist()).removeprefix(b" ") == t.encode("utf-8", "surrogatepass") for t, a, b in zip(texts, ends, ends[1:], strict=False)]
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("n_chars"), ids, pa.array(same, pa.bool_())], ["doc_id", "n_chars", "ids", "same"])

    return run


def encode(docs: DataFrame, proto: bytes, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """docs: doc_id, text (other columns are ignored). Returns per row doc_id, n_chars, ids, which equal those of the
    library for the whole text, and same: whether the ids stand for the text. Null or empty text: no ids. Repeated
    rows get a row each. No rows: no rows.

    A document of fewer than ``chunk`` characters is one chunk and encoded as such. A longer one is cut every ``chunk``
    characters, wherever that falls: each chunk gives a max-plus matrix from the pieces that may cover its first cut
    to those that may cover its last. The matrices are combined in blocks of ``block`` chunks, and those of a document's
    blocks by a scan; the states chosen at the blocks' ends fix those inside; then each chunk is traced back between
    the two states chosen for it. Chunks are dealt over all tasks at both passes, and no task sees a whole document
    but the one that cuts it and the one that makes a row of its ids.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(text).cast("long").alias("n_chars"), text.alias("text"))
    short = rows.where(F.col("n_chars") < chunk).mapInArrow(_short(proto), "doc_id long, n_chars long, ids array<int>, same boolean")
    long = rows.where(F.col("n_chars") >= chunk).withColumn("rid", F.monotonically_increasing_id())
    # Written, as the ids of rows must not change between the two passes.
    part = materialize(long.mapInArrow(_cut(chunk), PART), "chunks")
    dealt = part.repartition("rid", "k")
    moves = materialize(dealt.mapInArrow(_transfer(proto, block), MOVES), "moves")
    blocks = moves.groupBy("rid", "block").applyInArrow(_product, "rid long, block int, height int, matrix array<float>")
    ends = blocks.groupBy("rid").applyInArrow(_scan, ENDS)
    states = moves.groupBy("rid", "block").cogroup(ends.groupBy("rid", "block")).applyInArrow(_inside, "rid long, k int, a int, b int")
    met = dealt.join(states, ["rid", "k"]).select("rid", "k", "n", "text", "begin", "end", "marked", "a", "b")
    traced = met.mapInArrow(_backtrace(proto), "rid long, k int, ids array<int>, same boolean")
    # One document's chunks: a row again.
    joined = traced.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("parts"), F.bool_and("same").alias("same"))
    heads = part.where(F.col("k") == 0).select("rid", "doc_id", "n_chars")
    giant = heads.join(joined, "rid").select("doc_id", "n_chars", F.flatten("parts.ids").alias("ids"), "same")
    return short.unionByName(giant)


@lru_cache(maxsize=2)
def surfaces(proto: bytes) -> np.ndarray:
    """What each id stands for, in bytes."""
    sp = processor(proto)
    out = np.empty(sp.get_piece_size(), object)
    for i in range(len(out)):
        piece = sp.id_to_piece(i)
        out[i] = bytes([int(piece[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else " \u2047 ".encode() if sp.is_unknown(i) else piece.replace(SPACE, " ").encode()
    return out


def _decode(proto: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = surfaces(proto)
        for batch in batches:
            texts = []
            for ids in batch.column("ids"):
                raw = b"".join(table[ids.values.to_numpy()].tolist()) if ids.is_valid and len(ids.values) else b""
                texts.append(raw.removeprefix(b" ").decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return run


def decode(encoded: DataFrame, proto: bytes) -> DataFrame:
    """Adds decoded, the text of ids (array of int; null or empty: empty); a column of that name is replaced. Spaces
    come back as they were, but U+2581 in a text comes back as a space, as in the library."""
    small_batches(encoded.sparkSession)
    encoded = encoded.drop("decoded")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(_decode(proto), f"{schema}, decoded string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encodes and decodes every text: doc_id, n_chars, n_tokens, ids, round_trip (whether the text came back). The
    tasks that encode also decode, so a task holds one Python worker."""
    out = encode(docs, Path(path or model_path()).read_bytes())
    return out.select("doc_id", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("same").alias("round_trip"))
