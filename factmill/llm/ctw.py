"""Language-model scores by context-tree weighting over bytes."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factmill.llm.common import materialize, small_batches

#: Bytes of context. They run across spaces.
DEPTH = 5
END = b"\n"
#: Distinct words, and keys, that a task holds before it hands its counts on, and bytes of texts taken at a time.
HELD_WORDS, HELD_KEYS, RUN_BYTES = 200_000, 1 << 20, 2 << 20
#: Rows of context counts taken at a time (whole two-byte contexts).
TREE_ROWS = 200_000
#: Frequent words and keys whose scores every task holds: so many at most, no word longer than HEAD_BYTES. The rest is joined.
HEAD_WORDS, HEAD_BYTES, HEAD_KEYS = 100_000, 64, 1 << 20
#: Bits of a key below its two nearest bytes of context.
NEAR = 8 * (DEPTH - 1)
LN_HALF = math.log(0.5)


def tokens(text: str | None) -> list[bytes]:
    """Words of the text with A-Z lower-cased, then one end."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def gram_keys(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of every word, closed by a space (the end has none): the DEPTH bytes before it, the nearest
    highest, then the byte itself, as one number; spaces stand before a word. And the count for each word. Whole
    running texts, closed by END, may stand in place of words."""
    pad = b" " * DEPTH
    raw = np.frombuffer(b"".join(pad + w if w.endswith(END) else pad + w + b" " for w in words), np.uint8).astype(np.int64)
    counts = np.array([len(w) + (not w.endswith(END)) for w in words], np.int64)
    starts = np.cumsum(counts + DEPTH) - counts - DEPTH
    key = np.zeros(max(len(raw) - DEPTH, 0), np.int64)
    for k in range(1, DEPTH + 1):
        key <<= 8
        key |= raw[DEPTH - k : len(raw) - k]
    key <<= 8
    key |= raw[DEPTH:]
    # The bytes before later texts are context alone.
    kept = np.ones(len(key), bool)
    kept[(starts[1:, None] + np.arange(-DEPTH, 0)).ravel()] = False
    return key[kept], counts


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log of gamma for x >= 1/2: Stirling's series, eight steps up."""
    y = x + 8
    low = np.log(x)
    for k in range(1, 8):
        low += np.log(x + k)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - low


def block_log(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a sequence of so many zeros and ones."""
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - _lgamma(zeros + ones + 1.0) - math.log(math.pi)


def _stop(own: np.ndarray, weighted: np.ndarray) -> np.ndarray:
    """Posterior weight of ending the context here."""
    return np.exp(LN_HALF + own - weighted)


def subtree(keys: np.ndarray, counts: np.ndarray, top: int = 2) -> tuple[list[dict], np.ndarray]:
    """Levels from DEPTH up to ``top``, whole below each context of ``top`` bytes: for every (context, node of the
    byte's binary tree) its counts, weighted log probability and stopping weight. Also the bit of each key and node."""
    byte = keys & 255
    steps = np.arange(8)[:, None]
    node, bit = 1 << steps | byte >> (8 - steps), byte >> (7 - steps) & 1
    levels: list[dict] = []
    for d in range(DEPTH, top - 1, -1):
        ids, at = np.unique((keys >> (8 * (DEPTH - d) + 8)) << 8 | node, return_inverse=True)
        at = at.reshape(node.shape)
        ones = np.bincount(at.ravel(), (counts * bit).ravel(), len(ids))
        zeros = np.bincount(at.ravel(), (counts * (1 - bit)).ravel(), len(ids))
        own = block_log(zeros, ones)
        if levels:
            child = levels[-1]
            up = np.searchsorted(ids, (child["ids"] >> 16) << 8 | child["ids"] & 255)
            below = np.bincount(up, child["weighted"], len(ids))
            weighted = np.logaddexp(LN_HALF + own, LN_HALF + below)
        else:
            weighted = own
        levels.append({"ids": ids, "at": at, "zeros": zeros, "ones": ones, "weighted": weighted, "stop": _stop(own, weighted), "one": (ones + 0.5) / (zeros + ones + 1)})
    return levels, bit


def top_levels(rows: list[tuple]) -> dict[str, np.ndarray]:
    """From (byte of context, node, weighted log below, zeros, ones): stopping weights and chances of a one for
    contexts of one byte and of none."""
    below, zeros, ones = (np.zeros((256, 256)) for _ in range(3))
    for b, node, w, z, o in rows:
        below[b, node], zeros[b, node], ones[b, node] = w, z, o
    own = block_log(zeros, ones)
    weighted = np.logaddexp(LN_HALF + own, LN_HALF + below)
    z0, o0 = zeros.sum(0), ones.sum(0)
    own0 = block_log(z0, o0)
    weighted0 = np.logaddexp(LN_HALF + own0, LN_HALF + weighted.sum(0))
    return {"stop1": _stop(own, weighted), "one1": (ones + 0.5) / (zeros + ones + 1), "stop0": _stop(own0, weighted0), "one0": (o0 + 0.5) / (z0 + o0 + 1)}


def code_bits(keys: np.ndarray, counts: np.ndarray, top: dict[str, np.ndarray]) -> np.ndarray:
    """Code length in bits of each key's byte after its context, all depths mixed."""
    levels, bit = subtree(keys, counts)
    p = levels[0]["one"][levels[0]["at"]]
    for level in levels[1:]:
        w = level["stop"][level["at"]]
        p = w * level["one"][level["at"]] + (1 - w) * p
    node, near = levels[0]["ids"][levels[0]["at"]] & 255, keys >> (8 * DEPTH)
    for w, one in ((top["stop1"][near, node], top["one1"][near, node]), (top["stop0"][node], top["one0"][node])):
        p = w * one + (1 - w) * p
    return -np.log2(np.where(bit == 1, p, 1 - p)).sum(0)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[bytes] = Counter()
    others: set[bytes] = set()
    size = 0

    def out() -> pa.RecordBatch:
        rest = [w for w in others if w not in seen]
        return pa.RecordBatch.from_arrays([pa.array([*seen, *rest], pa.binary()), pa.array([*seen.values(), *[0] * len(rest)], pa.int64())], ["word", "c"])

    for batch in batches:
        for text, held in zip(batch.column("text"), batch.column("held_out").to_pylist(), strict=True):
            found = tokens(text.as_py())
            (others if held else seen).update(found)
            size += len(found) if len(found) > 1000 else 0
            if len(seen) + len(others) > HELD_WORDS or (size > RUN_BYTES):
                yield out()
                seen.clear()
                others.clear()
                size = 0
    yield out()


def running(text: str | None) -> bytes:
    """The tokens of a text with a space after each word."""
    return b" ".join(tokens(text))


def _runs(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        if size > RUN_BYTES:
            yield start, i
            start, size = i, 0
        size += len(t) + DEPTH + 1
    if start < len(texts):
        yield start, len(texts)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of several lists of keys with counts, and the sums of their counts."""
    keys, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


#: Lists of keys that are held before they are merged.
LISTS = 8


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys with their counts in texts not held out; those of the others with zero."""
    held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held[0][0]), pa.array(held[0][1].astype(float))], ["key", "n"])

    for batch in batches:
        texts = [running(t.as_py()) for t in batch.column("text")]
        learnt = ~batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
        for a, b in _runs(texts):
            for own in (True, False):
                some = [t for t, x in zip(texts[a:b], learnt[a:b], strict=True) if x == own]
                if some:
                    keys, n = np.unique(gram_keys(some)[0], return_counts=True)
                    held.append((keys, n * own))
            if len(held) > LISTS:
                held = [_merged(held)]
            if len(held[0][0]) > HELD_KEYS:
                yield out()
                held[0] = held[0][0][:0], held[0][1][:0]
    held = [_merged(held)]
    yield out()


def _by_context(work):
    """Runs work over rows (key, n) sorted by key, whole two-byte contexts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            held.append((batch.column("key").to_numpy(), batch.column("n").to_numpy()))
            if sum(len(k) for k, _ in held) < TREE_ROWS:
                continue
            keys, n = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = int(np.searchsorted(keys, keys[-1] >> NEAR << NEAR))
            held = [(keys[cut:], n[cut:])]
            if cut:
                yield work(keys[:cut], n[:cut])
        if held and sum(len(k) for k, _ in held):
            yield work(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _level_two(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    last = subtree(keys, n)[0][-1]
    ids = last["ids"]
    return pa.RecordBatch.from_arrays([pa.array((ids >> 16).astype(np.int32)), pa.array((ids & 255).astype(np.int32)), *(pa.array(last[k]) for k in ("weighted", "zeros", "ones"))], ["near", "node", "weighted", "zeros", "ones"])


def train(docs: DataFrame) -> tuple[DataFrame, DataFrame, int, int]:
    """docs: text, held_out. Returns (word, c) for every distinct token of all documents, with its count in those not
    held out; (key, n, bits) for every byte after its context, with the code length under the model that those not held
    out give; and their count of tokens and of distinct tokens.

    Everything below a two-byte context is weighted by the task that holds it, the two levels above (256 contexts at
    most) on the driver. The model has as many contexts as the corpus shows.
    """
    small_batches(docs.sparkSession)
    vocabulary = docs.select("text", "held_out").mapInArrow(_word_counts, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))
    vocabulary = materialize(vocabulary, "vocabulary")
    total, distinct = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    grams = materialize(docs.select("text", "held_out").mapInArrow(_grams, "key long, n double").groupBy("key").agg(F.sum("n").alias("n")), "grams")
    dealt = grams.repartition(F.shiftright("key", NEAR)).sortWithinPartitions("key")
    second = dealt.mapInArrow(_by_context(_level_two), "near int, node int, weighted double, zeros double, ones double")
    # 256 contexts of 255 nodes at most.
    top = top_levels([tuple(r) for r in second.groupBy("near", "node").agg(F.sum("weighted"), F.sum("zeros"), F.sum("ones")).collect()])
    costs = lambda keys, n: pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n), pa.array(code_bits(keys, n, top))], ["key", "n", "bits"])
    return vocabulary, materialize(dealt.mapInArrow(_by_context(costs), "key long, n double, bits double"), "bits"), total, distinct


def _frequent(rows: DataFrame, count: str, limit: int) -> DataFrame:
    """The rows of the greatest counts, limit at most: those above one that a histogram of eighths of powers of two gives."""
    some = rows.where(F.col(count) > 0)
    step = F.floor(F.log2(count) * 8)
    kept, least = 0, None
    for s, n in sorted(((r[0], r[1]) for r in some.groupBy(step.alias("s")).count().collect()), reverse=True):
        if kept + n > limit:
            break
        kept, least = kept + n, s
    return some.where(step >= least) if least is not None else some.limit(0)


def head_words(words: DataFrame, limit: int = HEAD_WORDS) -> dict[bytes, int]:
    """The most frequent words with their counts."""
    return {bytes(r[0]): r[1] for r in _frequent(words.where(F.octet_length("word") <= HEAD_BYTES), "c", limit).select("word", "c").collect()}


#: Slots of the table of frequent keys, a power of two. Of keys that meet in a slot the most frequent stays; the others
#: are joined, as rare keys are.
SLOT_BITS = 22
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _slots(keys: np.ndarray, size: int) -> np.ndarray:
    return (keys.view(np.uint64) * _SPREAD) >> np.uint64(65 - size.bit_length())


def slot_table(keys: np.ndarray, bits: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each slot a key (-1 for none) and its cost; keys by rising frequency, as the last write to a slot stands."""
    held, cost = np.full(size, -1, np.int64), np.zeros(size)
    at = _slots(keys, size)
    held[at], cost[at] = keys, bits
    return held, cost


SCORED = "rid long, n_tokens long, n_known long, base double, n_bytes long, bits double, words array<struct<word: binary, n: int>>, keys array<struct<key: bigint, n: bigint>>"


def _score(words: dict[bytes, float], frequent: np.ndarray, their_bits: np.ndarray, slots: int):
    """Per text, in one pass over it: its counts, the sums over the words and the keys that every task holds, and its
    other words and keys with their counts. Keys are sent as they are; each task makes its table of slots."""
    word_type, key_type = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int32())])), pa.struct([("key", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, cost = slot_table(frequent, their_bits, slots)
        for batch in batches:
            kept = [c for c in batch.schema.names if c != "text"]
            split = [tokens(t.as_py()) for t in batch.column("text")]
            texts = [b" ".join(found) for found in split]
            for a, b in _runs(texts):
                rows = []
                for found in split[a:b]:
                    known, base, size, rest = 0, 0.0, 0, []
                    for w, n in Counter(found).items():
                        size += n * len(w)
                        if (x := words.get(w)) is None:
                            rest.append({"word": w, "n": n})
                        else:
                            known += n
                            base += n * x
                    rows.append((len(found), known, base, size + len(found) - 1, rest))
                keys, counts = gram_keys(texts[a:b])
                starts = np.cumsum(counts) - counts
                at = _slots(keys, len(head))
                hit = head[at] == keys
                bits = np.add.reduceat(np.where(hit, cost[at], 0.0), starts)
                others = [np.unique(keys[s : s + n][~hit[s : s + n]], return_counts=True) for s, n in zip(starts.tolist(), counts.tolist(), strict=True)]
                ends = np.cumsum([0, *(len(k) for k, _ in others)]).astype(np.int32)
                rest_keys = pa.StructArray.from_arrays([pa.array(np.concatenate([x[k] for x in others])) for k in (0, 1)], fields=list(key_type))
                n_tokens, n_known, base, n_bytes, rest_words = zip(*rows, strict=True)
                own = batch.slice(a, b - a)
                columns = [pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(n_bytes, pa.int64()), pa.array(bits), pa.array(rest_words, word_type), pa.ListArray.from_arrays(pa.array(ends), rest_keys)]
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in kept), *columns], [*kept, "n_tokens", "n_known", "base", "n_bytes", "bits", "words", "keys"])

    return run


def score_documents(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text (other columns are ignored). Returns per row doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score, n_bytes and bits_per_byte.

    Held out are rows whose crc32(doc_id as text) is divisible by ten; the model and the base learn from the others.
    Null doc_id: its text is empty. Null text: empty, one end. Repeated rows are scored, and learnt from, each.
    No training rows: every token is unknown to both models, which still give every text a probability.
    """
    small_batches(docs.sparkSession)
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0
    rows = docs.select(F.col("doc_id"), held.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    words, bits, total, distinct = train(rows)
    under = total + 0.1 * (distinct + 1)
    base = lambda c: math.log10((c + 0.1) / under)
    head = {w: base(c) for w, c in head_words(words).items()}
    # HEAD_KEYS rows at most.
    frequent = _frequent(bits, "n", HEAD_KEYS).select("key", "n", "bits").toArrow().sort_by("n")
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    # The number of a row stands for it in the joins, as doc_id may repeat. It is given once and written with the row.
    ids = rows.withColumn("rid", F.monotonically_increasing_id()).select("rid", "doc_id", "held_out", "text")
    scored = ids.mapInArrow(_score(head, frequent["key"].to_numpy(), frequent["bits"].to_numpy(), 1 << SLOT_BITS), SCORED.replace("rid long", f"rid long, doc_id {doc_type}, held_out boolean"))
    scored = materialize(scored, "scored")
    zero, none = F.lit(0).cast("long"), F.lit(0.0)
    rest = scored.select("rid", F.explode("words").alias("t")).select("rid", "t.word", "t.n").join(words, "word")
    log10 = F.log10((F.col("c") + 0.1) / F.lit(under))
    late = rest.select("rid", F.when(F.col("c") > 0, F.col("n")).otherwise(0).cast("long").alias("n_known"), (F.col("n") * log10).alias("base"), none.alias("bits"))
    rare = scored.select("rid", F.explode("keys").alias("t")).select("rid", "t.key", "t.n").join(bits.select("key", F.col("bits").alias("b")), "key")
    late = late.union(rare.select("rid", zero, none, F.col("n") * F.col("b")))
    sums = late.groupBy("rid").agg(*(F.sum(c).alias(f"late_{c}") for c in ("n_known", "base", "bits")))
    out = scored.drop("words", "keys").join(sums, "rid", "left")
    whole = lambda c: F.col(c) + F.coalesce(F.col(f"late_{c}"), F.lit(0))
    return out.select(
        "doc_id", "held_out", "n_tokens", whole("n_known").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), whole("base").alias("base_score"), (whole("bits") * -math.log10(2)).alias("score"), "n_bytes",
        (whole("bits") / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )
