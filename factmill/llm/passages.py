"""Quality of documents by attention over their passages (multiple-instance learning)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factmill.llm.common import materialize, small_batches

#: Words of a passage. Texts beyond PIECE bytes are read in pieces, at each of which passages begin anew.
WORDS, PIECE = 64, 1 << 20
#: The model is fitted on so many labelled documents of each class at most, those of the least hashes, and on so many of
#: their passages in all; a document that doesn't fit the rest of these is passed over.
SAMPLE, PASSAGES = 3000, 60_000
#: Passes over the sample, sizes of a passage's encoding and of the gates, rate of learning, shrinking of weights.
PASSES, HIDDEN, GATES, RATE, SHRINK = 100, 24, 12, 0.02, 1e-4
CLASSES, GRAMS = 12, 64


def _class_of_bytes() -> np.ndarray:
    out = np.full(256, 10, np.uint8)  # other symbols
    for k, members in enumerate((range(97, 123), range(65, 91), range(48, 58), b" ", b"\t\n\v\f\r", b".", b",;:", b"!?", b"'\"()-", b"|/\\<>_=+~")):
        out[list(members)] = k
    out[128:] = 11
    return out


CLASS = _class_of_bytes()
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
LETTER = np.isin(CLASS, [0, 1, 11])
LOWERED = np.where(CLASS == 1, np.arange(256) + 32, np.arange(256)).astype(np.uint32)
#: Kinds of bytes that few words end in.
MARKS = [7, 9, 10]
#: What a byte at a place of a word counts in the word's hash.
POWERS = np.cumprod(np.full(256, 0x9E3779B97F4A7C15, np.uint64))



def _repeated(owner: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether an equal key of the same owner stands before."""
    order = np.lexsort((np.arange(len(key)), key, owner))
    same = (owner[order][1:] == owner[order][:-1]) & (key[order][1:] == key[order][:-1])
    out = np.zeros(len(key), bool)
    out[order[1:]] = same
    return out


def encode(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """data: the bytes of pieces, one after another from starts. Per passage, in order, its piece and its features: shares
    of kinds of bytes and of hashed byte trigrams; lengths, endings and repetition of its words. A piece without words is
    one passage."""
    size, pieces = len(data), len(starts)
    space, at = SPACE[data], np.arange(size)
    edge = np.zeros(size + 3, bool)
    edge[starts] = True
    fresh = edge[:size].copy()
    fresh[1:] |= space[:-1]
    words = np.flatnonzero(fresh & ~space)
    owner = np.searchsorted(starts, words, side="right") - 1
    order = np.arange(len(words)) - np.searchsorted(owner, np.arange(pieces))[owner]
    new = order % WORDS == 0
    bare = np.setdiff1d(np.arange(pieces), owner)
    piece = np.concatenate([owner[new], bare])
    begin = np.concatenate([np.where(order[new] == 0, starts[owner[new]], words[new]), starts[bare]])
    rank = np.lexsort((begin, piece))
    piece, begin, place = piece[rank], begin[rank], np.argsort(rank)
    n = len(piece)
    lengths = np.diff(np.append(begin, size))
    of_byte, of_word = np.repeat(np.arange(n), lengths), place[np.cumsum(new) - 1]

    shares = lambda i, k: np.bincount(i, minlength=n * k).reshape(n, k) / np.maximum(lengths, 1)[:, None]
    low = np.append(LOWERED[data], np.zeros(2, np.uint32))
    grams = (low[:-2] * np.uint32(2654435761) + low[1:-1] * np.uint32(2246822519) + low[2:] * np.uint32(3266489917)) >> np.uint32(26)
    # Trigrams within one passage.
    cut = np.zeros(size + 3, bool)
    cut[begin] = True
    within = ~(cut[1 : size + 1] | cut[2 : size + 2]) & (at < size - 2)

    start = np.zeros(size, np.int64)
    start[words] = words
    hashed = np.where(space, 0, data).astype(np.uint64) * POWERS[(at - np.maximum.accumulate(start)) % len(POWERS)]
    ends = np.flatnonzero(~space & (np.append(space[1:], True) | edge[1 : size + 1])) + 1
    last, long = CLASS[data[ends - 1]], (ends - words).astype(float)
    any_of = lambda x: np.logical_or.reduceat(x & ~space, words) if len(words) else np.zeros(0, bool)
    letters, small = any_of(LETTER[data]), any_of(CLASS[data] == 0)
    keys = np.add.reduceat(hashed, words) if len(words) else np.zeros(0, np.uint64)
    pairs, inner = keys[1:] * np.uint64(31) + keys[:-1], of_word[1:] == of_word[:-1]
    count = np.bincount(of_word, minlength=n)
    share = lambda x: np.bincount(of_word, x, n) / np.maximum(count, 1)
    paired = np.append(False, _repeated(np.where(inner, of_word[1:], -1), pairs) & inner) if len(words) else np.zeros(0, bool)
    mean = share(long)
    of_words = [np.log1p(mean), np.log1p(np.sqrt(np.maximum(share(long**2) - mean**2, 0))), share(~letters), share(letters & ~small), share(np.isin(last, MARKS)), share(_repeated(of_word, keys)), share(paired), count / WORDS]
    return piece, np.concatenate([shares(of_byte * CLASSES + CLASS[data], CLASSES), np.sqrt(shares(of_byte[within] * GRAMS + grams[within], GRAMS)), np.stack(of_words, axis=1)], axis=1)


def _encoded(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row of each piece, piece (from 0) of each passage, and features, for some PIECE bytes of the texts at a time."""
    texts = texts.cast(pa.large_string()).cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    rows, starts, ends = [], [], []
    for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        while b - a > PIECE:
            gaps = np.flatnonzero(SPACE[data[a : a + PIECE]])
            cut = a + (int(gaps[-1]) + 1 if len(gaps) else PIECE)
            rows, starts, ends, a = [*rows, row], [*starts, a], [*ends, cut], cut
        rows.append(row)
        starts.append(a)
        ends.append(b)
    i = 0
    while i < len(rows):
        j = i + 1
        while j < len(rows) and ends[j] - starts[i] <= PIECE:
            j += 1
        piece, x = encode(data[starts[i] : ends[j - 1]], np.array(starts[i:j]) - starts[i])
        yield np.array(rows[i:j]), piece, x
        i = j


def _starts(groups: np.ndarray) -> np.ndarray:
    """Where each run of equal numbers begins."""
    return np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))


def _squashed(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


@dataclass
class Model:
    """Means and spreads of features; W, b: a passage's encoding; V, U, w: its gated attention; c, d: the document's score
    from the weighted encoding."""

    mean: np.ndarray
    spread: np.ndarray
    weights: dict[str, np.ndarray]

    def gated(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """Encodings of passages, the two factors of their gates, and what they weigh before normalisation."""
        p = self.weights
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), _squashed(h @ p["U"])
        return h, t, s, (t * s) @ p["w"]

    def pooled(self, e: np.ndarray, h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per group from starts: the greatest of e, the sum of exp(e) relative to it, and of h so weighted."""
        most = np.maximum.reduceat(e, starts)
        a = np.exp(e - np.repeat(most, np.diff(np.append(starts, len(e)))))
        return most, np.add.reduceat(a, starts), np.add.reduceat(a[:, None] * h, starts)

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Score and passages of each text."""
        n = len(texts)
        rows, parts, count = [], [], np.zeros(n, np.int64)
        for row, piece, x in _encoded(texts):
            h, _, _, e = self.gated(self.scaled(x))
            parts.append(self.pooled(e, h, _starts(piece)))
            rows.append(row)
            count += np.bincount(row[piece], minlength=n)
        # The pieces of a long text are merged by their sums.
        most, total, z = (np.concatenate(x) for x in zip(*parts, strict=True))
        starts = _starts(np.concatenate(rows))
        top = np.maximum.reduceat(most, starts)
        factor = np.exp(most - np.repeat(top, np.diff(np.append(starts, len(most)))))
        z = np.add.reduceat(z * factor[:, None], starts) / np.add.reduceat(total * factor, starts)[:, None]
        return _squashed(z @ self.weights["c"] + self.weights["d"]), count

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -8, 8)


def train(x: np.ndarray, starts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Model:
    """x: features of the passages of labelled documents, which begin at starts; y: their labels; weight: what each document
    counts. Whole-batch steps of Adam on the weighted log loss, from fixed random numbers."""
    r = np.random.default_rng(1)
    f = x.shape[1]
    draw = lambda *shape: r.normal(size=shape) / np.sqrt(shape[0])
    p = {"W": draw(f, HIDDEN), "b": np.zeros(HIDDEN), "V": draw(HIDDEN, GATES), "U": draw(HIDDEN, GATES), "w": draw(GATES), "c": draw(HIDDEN), "d": np.zeros(())}
    model = Model(x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3), p)
    x = model.scaled(x)
    sizes, weight = np.diff(np.append(starts, len(x))), weight / weight.sum()
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for step in range(1, PASSES + 1):
        h, t, s, e = model.gated(x)
        most, total, z = model.pooled(e, h, starts)
        a = np.exp(e - np.repeat(most, sizes)) / np.repeat(total, sizes)
        z = z / total[:, None]
        g = (_squashed(z @ p["c"] + p["d"]) - y) * weight
        to_z = np.repeat(g[:, None] * p["c"], sizes, axis=0)
        by_a = (h * to_z).sum(axis=1)
        to_e = a * (by_a - np.repeat(np.add.reduceat(a * by_a, starts), sizes))
        to_t, to_s = to_e[:, None] * p["w"] * s * (1 - t * t), to_e[:, None] * p["w"] * t * s * (1 - s)
        to_x = (a[:, None] * to_z + to_t @ p["V"].T + to_s @ p["U"].T) * (1 - h * h)
        grad = {"W": x.T @ to_x, "b": to_x.sum(axis=0), "V": h.T @ to_t, "U": h.T @ to_s, "w": (t * s).T @ to_e, "c": z.T @ g, "d": g.sum()}
        for k in p:
            d = grad[k] + SHRINK * p[k]
            first[k] = 0.9 * first[k] + 0.1 * d
            second[k] = 0.999 * second[k] + 0.001 * d * d
            p[k] = p[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def is_held_out(doc_id: Column) -> Column:
    """Rows that nothing is learnt from: CRC-32 of the id as text is 1 modulo 3. A null id is none of them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _encode_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number and features of each text's passages."""
    for batch in batches:
        held: list[list[np.ndarray]] = [[] for _ in range(batch.num_rows)]
        for row, piece, x in _encoded(batch.column("text")):
            for at, part in zip(row[piece][_starts(piece)], np.split(x, _starts(piece)[1:]), strict=True):
                held[at].append(part)
        whole = [np.concatenate(parts).astype(np.float32) for parts in held]
        yield pa.RecordBatch.from_arrays([batch.column("rank"), batch.column("label"), pa.array([len(x) for x in whole], pa.int64()), pa.array([x.tobytes() for x in whole], pa.binary())], ["rank", "label", "n", "x"])


def fit(docs: DataFrame, labels: DataFrame) -> Model | float:
    """docs: doc_id, text. labels: doc_id, label (0 or 1; other values and null say nothing). A model of the label, or the
    share of label 1 (a half without any label) where labels of one kind only are known.

    An id whose labels disagree counts for neither; of texts of one id the least counts. Only the sample, which SAMPLE and
    PASSAGES bound, reaches the driver; it is weighted so that both classes count as in all labels.
    """
    small_batches(docs.sparkSession)
    known = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").select("doc_id", F.col("label").cast("int").alias("label"))
    known = materialize(known.withColumn("rank", F.xxhash64("doc_id")), "labels")
    sizes = dict(known.groupBy("label").count().collect())
    if len(sizes) < 2:
        return (sizes.get(1, 0) + 1) / (sum(sizes.values()) + 2)
    chosen = None
    for label in (0, 1):
        some = known.where(F.col("label") == label).orderBy("rank", "doc_id").limit(SAMPLE)
        chosen = some if chosen is None else chosen.union(some)
    met = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label", "rank").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    coded = materialize(met.select("rank", "label", "text").mapInArrow(_encode_rows, "rank long, label int, n long, x binary"), "sample")
    kept, left = [], PASSAGES
    for rank, n in sorted(map(tuple, coded.select("rank", "n").collect())):
        if n <= left:
            kept.append((rank,))
            left -= n
    rows = sorted(map(tuple, coded.join(F.broadcast(docs.sparkSession.createDataFrame(kept, "rank long")), "rank").select("rank", "label", "n", "x").collect())) if kept else []
    if len({r[1] for r in rows}) < 2:
        return (sizes[1] + 1) / (sizes[0] + sizes[1] + 2)
    n, y = np.array([r[2] for r in rows]), np.array([float(r[1]) for r in rows])
    x = np.concatenate([np.frombuffer(r[3], np.float32).reshape(r[2], -1) for r in rows]).astype(float)
    weight = np.where(y == 1, sizes[1] / y.sum(), sizes[0] / (1 - y).sum())
    return train(x, np.cumsum(n) - n, y, weight)


def score(docs: DataFrame, model: Model | float, text: str = "text") -> DataFrame:
    """docs without its text, with ``score`` (0 to 1, to nine places, so that it doesn't depend on which rows are computed
    together) and ``passages``. Null and empty texts, and those without words, have one passage."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        for batch in batches:
            texts = batch.column(text)
            if isinstance(held, float):
                found, count = np.full(len(texts), held), np.zeros(len(texts), np.int64)
                for row, piece, _ in _encoded(texts):
                    count += np.bincount(row[piece], minlength=len(texts))
            else:
                found, count = held.scores(texts)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(np.round(found, 9)), pa.array(count)], [*rest, "score", "passages"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != text]
    return docs.select(*(f"`{c}`" for c in rest), text).mapInArrow(run, ", ".join([*fields, "score double, passages long"]))


def quality_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """documents: doc_id, text; labels: doc_id, quality. Per row doc_id, held_out, score, predicted (1 from a score of a
    half), passages. Nothing but the text makes a score, and rows held out teach nothing. Other columns are left out."""
    docs = documents.select("doc_id", "text")
    seen = labels.where(~is_held_out(F.col("doc_id"))).select("doc_id", F.col("quality").alias("label"))
    out = score(docs, fit(docs, seen))
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages")
