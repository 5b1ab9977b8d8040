"""Threshold-scaled sketches of word shingles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factmill.llm.common import shuffle_partitions, small_batches

WORDS = 5
#: One hash in so many is kept of a text of more than FEW distinct shingles; all are kept of others.
SCALE, FEW = 2, 256
#: Bytes hashed at a time; a longer text makes a longer run.
RUN_BYTES = 1 << 20
_ODD = 0x9E3779B97F4A7C15
_STEP = 0xD6E8FEB86659FD93
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as far as asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, RUN_BYTES + 65536)
            for name, base in (("up", _ODD), ("down", pow(_ODD, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


_powers = _Powers()


def shingle_hashes(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of lower-cased texts, and the count for each text. A text of fewer words is one
    shingle; a text of none has none. Words hash alike wherever they stand."""
    joined = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(joined.lower(), np.uint8)
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    up, down = _powers.upto(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    word = _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    stops = np.cumsum([len(t) + 1 for t in texts])
    each = np.diff(np.searchsorted(starts, stops), prepend=0)
    first = np.cumsum(each) - each
    rolled = np.zeros(len(word), np.uint64)
    left = np.repeat(first + each, each) - np.arange(len(word))  # words from here to the text's end
    for k in range(words):
        has = np.flatnonzero(left > k)
        rolled[has] = _mix(rolled[has] * np.uint64(_STEP) + word[has + k] + np.uint64(k + 1))
    whole = (left >= words) | (np.arange(len(word)) == np.repeat(first, each))
    counts = np.where(each == 0, 0, np.maximum(each - words + 1, 1))
    return rolled[whole], counts


class Sketch(NamedTuple):
    """Sorted distinct shingle hashes below 2**64 / scale."""

    scale: int
    hashes: np.ndarray

    def at(self, scale: int) -> np.ndarray:
        """The hashes that a sketch of a larger scale would hold."""
        return self.hashes if scale <= self.scale else self.hashes[self.hashes < np.uint64((1 << 64) // scale)]


def thinned(hashes: np.ndarray, scale: int = 1) -> Sketch:
    """The sketch of sorted distinct hashes of a scale: all of them, or one in SCALE where they are more than FEW."""
    if scale == 1 and len(hashes) > FEW:
        return Sketch(SCALE, hashes[hashes < np.uint64((1 << 64) // SCALE)])
    return Sketch(scale, hashes)


def sketches(texts: list[str], words: int = WORDS) -> list[Sketch]:
    """The sketch of each text; that of a text without words is empty."""
    out: list[Sketch] = []
    run: list[bytes] = []
    size = 0

    def flush() -> None:
        hashes, counts = shingle_hashes(run, words)
        at = 0
        for n in counts.tolist():
            out.append(thinned(np.unique(hashes[at : at + n])))
            at += n
        run.clear()

    for t in texts:
        b = t.encode("utf-8", "surrogatepass")
        if run and size + len(b) > RUN_BYTES:
            flush()
            size = 0
        run.append(b)
        size += len(b) + 1
    if run:
        flush()
    return out


def merge(a: Sketch, b: Sketch) -> Sketch:
    """The sketch of two shingle sets together, from their sketches alone."""
    scale = max(a.scale, b.scale)
    return thinned(np.union1d(a.at(scale), b.at(scale)), scale)


def containment(a: Sketch, b: Sketch) -> float:
    """Share of a's shingles that b has, from those below the limit of both. Two empty sketches: 1, one empty: 0. Where
    nothing of a short text's sketch is below a long one's limit, they say nothing of each other: 0, unless equal."""
    scale = max(a.scale, b.scale)
    x, y = a.at(scale), b.at(scale)
    if not len(x) or not len(y):
        return float(a.scale == b.scale and np.array_equal(a.hashes, b.hashes))
    return len(np.intersect1d(x, y, assume_unique=True)) / len(x)


def as_text(sketch: Sketch) -> str:
    """The scale, a colon, and the hashes in hex, 16 digits each."""
    return f"{sketch.scale}:{sketch.hashes.astype('>u8').tobytes().hex()}"


def from_text(text: str) -> Sketch:
    scale, hashes = text.split(":")
    return Sketch(int(scale), np.frombuffer(bytes.fromhex(hashes), ">u8").astype(np.uint64))


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one run in order, then the row that follows the run (own: false). Each row waits for its next."""
    waiting: tuple | None = None
    for batch in batches:
        ids, texts, own = (batch.column(c).to_pylist() for c in ("doc_id", "text", "own"))
        pairs = []
        for row in zip(ids, texts, sketches(texts), own, strict=True):
            if waiting is None:
                waiting = row
            elif waiting[3]:
                pairs.append((waiting, row))
                waiting = row
        if not pairs:
            continue
        edited = []
        for (_, text, _, _), (_, after, _, _) in pairs:
            half = len(text) // 2
            edited.append(text[: len(text) - half] + after[:half])
        out = []
        for ((doc_id, text, own_sketch, _), (_, after, next_sketch, _)), new, sketch in zip(pairs, edited, sketches(edited), strict=True):
            sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
            out.append((doc_id, len(text), sha, as_text(own_sketch), as_text(sketch), containment(own_sketch, sketch), containment(own_sketch, next_sketch)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), TYPES, strict=True)], NAMES)


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text (other columns are ignored). For each document its sketch, that of its edited text (its last
    half replaced by the start of the next document in descending doc_id; after the last: the first), and how much of
    its sketch the edited text and the next document contain, as the fingerprints alone tell.

    Null text: empty. Null doc_id: after all others. Rows of equal doc_id follow each other by text. One document is
    its own next. No documents: no rows.

    The texts are shuffled once, in runs of doc_id cut at quantiles; the first row of each run is also sent to the
    run before it, so no run waits for another.
    """
    spark = docs.sparkSession
    small_batches(spark)
    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    runs = shuffle_partitions(spark)
    steps = [k / runs for k in range(1, runs)] or [0.5]
    cuts = sorted(set(slim.agg(F.percentile_approx("doc_id", steps, 10_000)).first()[0] or []), reverse=True)
    above = F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<bigint>"), lambda c: c > F.col("doc_id")))
    placed = slim.withColumn("run", F.when(F.col("doc_id").isNull(), len(cuts)).otherwise(above).cast("int"))
    heads = sorted((r[0], r[1]) for r in placed.groupBy("run").agg(F.max("doc_id")).collect())
    if not heads:
        return spark.createDataFrame([], SCHEMA)
    # The run before each head; the first head comes again after the last run. One row for each run.
    sent = spark.createDataFrame([(head, heads[k - 1][0]) for k, (_, head) in enumerate(heads)], "head long, before int")
    spot = lambda run, own: F.struct(run.alias("run"), F.lit(own).alias("own"))
    met = placed.join(F.broadcast(sent), F.col("doc_id").eqNullSafe(F.col("head")), "left")
    spots = F.filter(F.array(spot(F.col("run"), True), spot(F.col("before"), False)), lambda s: s["run"].isNotNull())
    dealt = met.select("doc_id", "text", F.explode(spots).alias("spot")).select("doc_id", "text", "spot.run", "spot.own")
    order = [F.col("run"), F.col("own").desc(), F.col("doc_id").desc_nulls_last(), F.col("text")]
    return dealt.repartitionById(runs + 1, F.col("run")).sortWithinPartitions(*order).mapInArrow(_walk, SCHEMA)
